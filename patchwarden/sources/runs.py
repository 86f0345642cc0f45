"""Finished runs as tables: <root>/<experiment>/<run>/metrics/*.csv, and what runs write.

All runs' files of a kind are read in one scan; a run that lacks one, or cannot be read, shows up
with status and error, not as a failed job."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary as S

FILES = ("per_dataset", "summary", "per_image", "profiling_samples", "profiling_timings")
SERIES = ["ram_mb", "vram_mb", "cpu_pct", "gpu_util_pct"]
METRICS = ["image_auroc", "image_ap", "image_f1", "pixel_auroc", "pixel_ap", "pixel_f1"]
PHASES = ("fit", "calibration", "infer", "metrics", "artifacts", "total")


def number(c: Column) -> Column:
    """A CSV field as a double; NaN where it is none."""
    return F.coalesce(F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double"), F.lit(float("nan")))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(experiment, run, run_dir) of every directory with metrics, through Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/metrics")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    dirs = sorted(str(f.getPath().getParent()) for f in found)
    rows = [(d.split("/")[-2], d.split("/")[-1], d) for d in dirs]
    return spark.createDataFrame(rows, "experiment string, run string, run_dir string")


def read_csv(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """All runs' files of a kind with experiment and run; None if no run has one."""
    if kind not in FILES:
        raise ValueError(f"unknown file {kind}")
    glob = f"{root}/*/*/metrics/{kind}.csv"
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    if not len(found):
        return None
    part = None
    at = r"/([^/]+)/([^/]+)/metrics/[^/]+(?:/[^/]+)?$"
    by_header: dict[tuple, list[str]] = {}
    for f in found:  # files of one header make one scan
        p = str(f.getPath())
        by_header.setdefault(tuple(spark.read.csv(p, header=True).columns), []).append(p)
    for paths in by_header.values():
        x = spark.read.csv(paths, header=True).withColumns({"experiment": F.regexp_extract(F.col("_metadata.file_path"), at, 1), "run": F.regexp_extract(F.col("_metadata.file_path"), at, 2)})
        part = x if part is None else part.unionByName(x, allowMissingColumns=True)
    return part


#: columns that a file must have to be of use
REQUIRED = {"summary": {"dataset"}, "profiling_samples": set(), "profiling_timings": {"phase", "duration_s"}}


def problems(spark: SparkSession, root: str) -> DataFrame:
    """(experiment, run, error): what is missing or cannot be used in the files of each run that has a fault."""
    errors: dict[tuple[str, str], list[str]] = {}
    for r in discover(spark, root).collect():  # a row a run
        for kind, columns in REQUIRED.items():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{r.run_dir}/metrics/{kind}.csv")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if not fs.exists(path):
                text = f"{kind}: missing"
            else:
                try:
                    have = set(spark.read.csv(str(path), header=True).columns)
                    lacks = sorted(columns - have)
                    text = f"{kind}: empty" if not have else f"{kind}: lacks {', '.join(lacks)}" if lacks else ""
                except Exception as e:  # any reader's complaint is the run's, not the report's
                    text = f"{kind}: {str(e).splitlines()[0][:200]}"
            if text:
                errors.setdefault((r.experiment, r.run), []).append(text)
    return spark.createDataFrame([(*k, "; ".join(v)) for k, v in sorted(errors.items())], "experiment string, run string, error string")


def summarize(spark: SparkSession, root: str, metrics: list[str] | None = None) -> DataFrame:
    """One row a run: metrics, resources, phase times, status and error; experiment ascending, newest first."""
    metrics = metrics or METRICS
    run = ["experiment", "run"]
    out = discover(spark, root).withColumn("timestamp", F.col("run"))
    nan = F.lit(float("nan"))
    s = read_csv(spark, root, "summary")
    if s is not None and "dataset" in s.columns:
        rows = s.select(*run, "dataset", *((number(F.col(m)) if m in s.columns else nan).alias(m) for m in metrics))
        out = out.join(S.run_metrics(rows, run, metrics), run, "left")
    else:
        out = out.withColumns({m: nan for m in metrics}).withColumn("from_mean", F.lit(None).cast("boolean"))
    p = read_csv(spark, root, "profiling_samples")
    if p is not None:
        out = out.join(S.resource_aggregates(p.select(*run, *((number(F.col(c)) if c in p.columns else nan).alias(c) for c in SERIES)), run, SERIES), run, "left")
    t = read_csv(spark, root, "profiling_timings")
    if t is not None and {"phase", "duration_s"} <= set(t.columns):
        times = S.phase_pivot(t.select(*run, "phase", number(F.col("duration_s")).alias("duration_s")), run, PHASES)
        out = out.join(times.withColumnsRenamed({f"time_{p}_s": "run_total_time_s" if p == "total" else f"sum_{p}_s" for p in PHASES}), run, "left")
    bad = problems(spark, root)
    out = out.join(bad, run, "left")
    lost = F.col("from_mean").isNull()
    out = out.withColumn("status", F.when(lost, "failed").otherwise("ok")).withColumn("error", F.coalesce("error", F.when(lost, "summary: no usable rows")))
    return S.summary_table([out]).withColumnsRenamed({"experiment": "experiment_name", "timestamp": "run_timestamp"}).drop("run")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; the output committer makes it appear whole."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown_table(rows: list, columns: list[str]) -> str:
    cell = lambda v: "nan" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])


def markdown_report(summary: DataFrame, metrics: list[str], time: str = "run_total_time_s", k: int = 10) -> str:
    """Leaderboards, fastest and slowest runs and failures of a summary; all parts are top-k or failures."""
    ids = ["experiment_name", "run_dir"]
    parts = ["# Experiment summary", f"{summary.count()} runs"]
    board = S.leaderboard(summary, metrics, k, ids).orderBy("metric", "rank").collect()
    for m in metrics:
        rows = [r for r in board if r.metric == m]
        if rows:
            parts += [f"## {m}", markdown_table(rows, ["rank", *ids, "value"])]
    if time in summary.columns:
        rows = S.fastest_slowest(summary, time, 5, ids).orderBy("kind", "rank").collect()
        if rows:
            parts += ["## Fastest and slowest", markdown_table(rows, ["kind", "rank", *ids, "value"])]
    failed = summary.where("status <> 'ok'").select(*ids, "error").orderBy(*ids).collect()
    if failed:
        parts += ["## Failed runs", markdown_table(failed, [*ids, "error"])]
    return "\n\n".join(parts) + "\n"


def write_bytes(path: str, data: bytes) -> None:
    """A small file of the driver, through a temporary name and Hadoop's file system, so any of its schemes will do."""
    spark = SparkSession.active()
    jvm = spark._jvm
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    with_stream = fs.create(part, True)
    try:
        with_stream.write(bytearray(data))
    finally:
        with_stream.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"could not write {path}")


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


def reproducibility(folder: str, config_text: str, repository: str = ".") -> dict[str, str]:
    """Writes the configuration and the revision of the code beside a run's results."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True).stdout.strip()
    state = {"revision": git("rev-parse", "HEAD"), "dirty": str(bool(git("status", "--porcelain")))}
    write_text(f"{folder}/config.yaml", config_text)
    write_text(f"{folder}/revision.txt", "".join(f"{k}: {v}\n" for k, v in state.items()))
    return state
