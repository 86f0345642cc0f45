"""Phase timers and a resource sampler of the driver and the executors, as tables."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "dataset string, elapsed_s double, ram_mb double, vram_mb double, cpu_pct double, gpu_util_pct double, executor string"
TIMINGS = "dataset string, phase string, duration_s double"
SPANS = "dataset string, phase string, begin_s double, end_s double"
#: the resident memory of an executor's processes where Spark measures it, else the memory that its JVM uses
RESIDENT = ("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory", "ProcessTreeOtherRSSMemory")
JVM = ("JVMHeapMemory", "JVMOffHeapMemory")


class Executors:
    """What Spark's own monitoring interface tells of each executor: the largest memory so far, and the part of its cores that tasks have kept busy
    since the last call. Without the interface (spark.ui.enabled is false), or where it does not answer, nothing."""

    def __init__(self, url: str | None):
        self.url, self.before = url, {}

    @classmethod
    def of(cls, spark: SparkSession | None) -> Executors:
        web = None if spark is None else spark.sparkContext.uiWebUrl
        return cls(None if web is None else f"{web}/api/v1/applications/{spark.sparkContext.applicationId}/executors")

    def sample(self, now: float) -> list[tuple[str, float, float]]:
        """(executor, MB, percent of one core) of all but the driver, which is measured as a process."""
        if self.url is None:
            return []
        try:
            with urllib.request.urlopen(self.url, timeout=2) as r:
                known = json.load(r)
        except (OSError, ValueError):
            return []
        out = []
        for e in known:
            if e["id"] == "driver":
                continue
            peak = e.get("peakMemoryMetrics") or {}
            resident = sum(peak.get(k, 0) for k in RESIDENT)
            memory = resident or sum(peak.get(k, 0) for k in JVM) or e.get("memoryUsed", 0)
            at, busy = self.before.get(e["id"], (None, 0))
            cpu = float("nan") if at is None or now <= at else max(e["totalDuration"] - busy, 0) / 10 / (now - at)
            self.before[e["id"]] = (now, e["totalDuration"])
            out.append((e["id"], memory / 1e6, cpu))
        return out


class Profiler:
    """Polls the driver's process and the executors every interval seconds while in use, and times phases."""

    def __init__(self, dataset: str, interval: float = 0.5, spark: SparkSession | None = None, executors: Executors | None = None):
        self.dataset, self.interval = dataset, interval
        self.executors = executors or Executors.of(spark)
        self.spans: list[tuple] = []
        self.samples: list[tuple] = []
        self.timings: list[tuple] = []
        self._stop = threading.Event()
        self._lock = threading.Lock()

    def __enter__(self) -> Profiler:
        self._began = time.monotonic()
        self._thread = threading.Thread(target=self._poll, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self.timings.append((self.dataset, "total", time.monotonic() - self._began))

    def _poll(self) -> None:
        try:
            import psutil

            p = psutil.Process()
        except ImportError:
            p = None
        nan = float("nan")
        while True:
            ram, cpu = (p.memory_info().rss / 1e6, p.cpu_percent()) if p else (nan, nan)
            at = time.monotonic() - self._began
            rows = [("driver", ram, cpu), *self.executors.sample(at)]
            with self._lock:
                self.samples += [(self.dataset, at, mb, nan, pct, nan, name) for name, mb, pct in rows]
            if self._stop.wait(self.interval):
                return

    @contextmanager
    def phase(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.timings.append((self.dataset, name, time.monotonic() - began))
            self.spans.append((self.dataset, name, began - self._began, time.monotonic() - self._began))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        with self._lock:
            return spark.createDataFrame(self.samples, SAMPLES), spark.createDataFrame(self.timings, TIMINGS)

    def usage(self, spark: SparkSession) -> DataFrame:
        """(dataset, phase, executor, samples, max_ram_mb, mean_cpu_pct): the samples taken within each phase."""
        spans = spark.createDataFrame(self.spans, SPANS)  # a few phases
        samples = self.tables(spark)[0]
        within = (samples["dataset"] == spans["dataset"]) & samples["elapsed_s"].between(F.col("begin_s"), F.col("end_s"))
        met = samples.join(F.broadcast(spans), within).select(spans["dataset"], "phase", "executor", "ram_mb", "cpu_pct")
        return met.groupBy("dataset", "phase", "executor").agg(F.count("*").alias("samples"), F.max("ram_mb").alias("max_ram_mb"), F.avg(F.nanvl("cpu_pct", F.lit(None).cast("double"))).alias("mean_cpu_pct"))
