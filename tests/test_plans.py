"""Pipeline, configuration, sources, sinks, streams and the driver's contract."""

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwarden.operators import summary as S
from patchwarden.operators.whitening import WhiteningConfig
from patchwarden.plans import artifacts, catalog, config, experiment, sql
from patchwarden.plans.pipeline import FitConfig, Model, fit
from patchwarden.plans.profiling import Profiler
from patchwarden.sources import images as I
from patchwarden.sources import runs as R
from patchwarden.streaming import state

SF = "/root/testdata/sf0.001"


# --- oracle parity --------------------------------------------------------------------------------


def rows_of(df):
    cell = lambda v: "nan" if v is None or isinstance(v, float) and v != v else round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.oracle()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.catalogue()[name](spark, SF).toPandas(), duck.sql(sql.oracle()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["greedy_exact", "greedy_passes"])
def test_greedy_equals_sql_at_other_sizes(spark, tmp_path, name):
    """The share of the rows follows the table: 24 of 1200, none of 40."""
    import duckdb

    for n in (1200, 40):
        spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(F.col("vec_id") < n).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{n}/embeddings.parquet/*.parquet'")
        got, want = catalog.catalogue()[name](spark, f"{tmp_path}/{n}").toPandas(), con.sql(sql.oracle()[name]).df()
        assert len(got) == n // 50 and rows_of(got) == rows_of(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["image_idx", "score"] and e.entry(spark).count() == 20
    assert set(sql.oracle()) <= set(catalog.catalogue()) <= set(e.queries())


# --- the pipeline -----------------------------------------------------------------------------------


@pytest.mark.parametrize("c", [
    FitConfig(n_clusters=20, chunk=16, reweight=3), FitConfig(bank="budgeted", n_clusters=10, scorer="max", whitening=None, pca_ratio=0.9), FitConfig(contract="OFFLINE", bank="greedy", coreset_share=0.05, mode="TOPK_SOFT", reweight=3, whitening=WhiteningConfig(method="LEDOIT_WOLF")),
    FitConfig(bank="kmeans", n_clusters=10, mode="TOPP_MEAN", reweight=1),
])
def test_fit_save_load(spark, tmp_path, c):
    p = catalog.patches(spark, SF)
    m = fit(p, c)
    want = {r.image_idx: r.score for r in m.image_scores(p).collect()}
    assert len(want) == 20 and all(math.isfinite(v) for v in want.values())
    m.save(str(tmp_path))
    got = {r.image_idx: r.score for r in Model.load(spark, str(tmp_path)).image_scores(p).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("bad", [{"contract": "OFFLINE"}, {"bank": "greedy"}, {"bank": "tail_aware"}, {"bank": "x"}, {"k": 0}, {"mode": "x"}])
def test_what_does_not_fit_together(bad):
    with pytest.raises(ValueError):
        FitConfig(**bad)


# --- configuration ------------------------------------------------------------------------------------

YAML = """
experiment: {name: demo, seed: 1}
paths: {output_root: OUT}
runtime: {device: cpu}
pipeline:
  training: {contract: STREAMING, fit_epochs: {feature_agg: 1, proj1: 1, transform: 1, proj2: 1, mem_agg: 1}}
  slots:
    dataloader: {plugin: mvtec_dataloader_augment, params: {dataset_root: ROOT, categories: [nut], batch_size: 2, img_size: [32, 32], train_augment_enabled: true, train_augment_cfg: {hflip: {enable: true, p: 0.5}}}}
    backbone: {plugin: pretrained_backbone, params: {backbone: wideresnet50, embedding_layers: [layer2, layer3]}}
    patch_align: {plugin: pc_patchify_align, params: {patchsize: 3, patchstride: 1}}
    preprocess: {plugin: pc_preprocess, params: {pretrain_embed_dimension: 16}}
    feature_agg: {plugin: ipca, params: {target_embed_dimension: 12, pca_variance_ratio: 0.99}}
    proj1: {plugin: none}
    transform: {plugin: cholesky, params: {covariance_regularization: {method: FIXED, shrinkage: 0.07}}}
    proj2: {plugin: none}
    mem_agg: {plugin: kcenter, params: {n_clusters: 30, kcenter_mode: merge_reduce, kcenter_chunk_coreset_size: 16}}
    materialize: {plugin: kcenter}
    distance: {plugin: euclidean_nn, params: {k: 1}}
    scoring: {plugin: paper_eq7, params: {paper_reweight_num_nn: 3}}
evaluation: {calibration: {mode: zscore}, pixel_metrics: {aupro: {pixel_enabled: true, num_thresholds: 16}}}
artifacts: {enabled: true, save_mode: top_k, max_images_per_dataset: 1}
"""


def test_config_reads_and_refuses():
    c = config.parse(YAML)
    assert (c.fit.bank, c.fit.n_clusters, c.fit.chunk, c.fit.whitening.shrinkage, c.loader.augment.hflip) == ("kcenter", 30, 16, 0.07, 0.5)
    for old, new in [("seed: 1", "sead: 1"), ("method: FIXED, ", ""), ("contract: STREAMING", "contract: BATCH"), ("plugin: kcenter, params", "plugin: kmedian, params"), ("mode: zscore", "mode: ecdf"), ("img_size: [32, 32]", "img_size: [32]"), ("mem_agg: 1", "mem_agg: 2")]:
        with pytest.raises(ValueError):
            config.parse(YAML.replace(old, new))
    auto = config.parse(YAML.replace("kcenter_mode: merge_reduce, ", "").replace("n_clusters: 30", "n_clusters: auto"))
    assert (auto.fit.bank, auto.fit.n_clusters) == ("budgeted", "auto")


# --- images -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    r = np.random.default_rng(0)

    def put(path, x):
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(artifacts.png_bytes(x))

    for c in ("nut", "pen"):
        for i in range(4):
            put(root / c / "train" / "good" / f"{i:03d}.png", r.integers(90, 110, (48, 48, 3)).astype(np.uint8))
        for i in range(2):
            put(root / c / "test" / "good" / f"{i:03d}.png", r.integers(90, 110, (48, 48, 3)).astype(np.uint8))
            x = r.integers(90, 110, (48, 48, 3)).astype(np.uint8)
            x[10:26, 12:28] = 255
            m = np.zeros((48, 48), np.uint8)
            m[10:26, 12:28] = 255
            put(root / c / "test" / "crack" / f"{i:03d}.png", x)
            if i == 0:
                put(root / c / "ground_truth" / "crack" / f"{i:03d}_mask.png", m)
    return str(root)


def test_images_and_masks(spark, tree):
    c = I.LoaderConfig(tree, ("nut", "pen"), 2, (48, 48), (48, 48))
    got = I.load_images(spark, c, "test").orderBy("dataset", "image_idx").collect()
    assert [(r.dataset, r.image_idx, r.batch_idx, r.label) for r in got][:4] == [("nut", 0, 0, 1), ("nut", 1, 0, 0), ("nut", 2, 1, 0), ("nut", 3, 1, 0)]
    x = artifacts.denormalize(np.array(got[0].image).reshape(3, 48, 48))
    assert (x[12, 14] == 255).all() and np.array(got[0].mask).sum() == 256
    assert I.resolve_layers("resnetv2_50_21k", ["layer2", "stem"]) == ["stages.1", "stem"]
    with pytest.raises(ValueError):
        I.LoaderConfig(tree, ("nut",), per_category={"cup": {}})


def test_channel_order(spark, tmp_path):
    x = np.zeros((4, 4, 3), np.uint8)
    x[..., 0] = 200
    os.makedirs(tmp_path / "a/train/good")
    (tmp_path / "a/train/good/0.png").write_bytes(artifacts.png_bytes(x))
    os.makedirs(tmp_path / "a/ground_truth/d")
    (tmp_path / "a/ground_truth/d/0_mask.png").write_bytes(artifacts.png_bytes(x[..., 0]))
    r = I.load_images(spark, I.LoaderConfig(str(tmp_path), ("a",), 1, (4, 4), (4, 4)), "train").first()
    assert artifacts.denormalize(np.array(r.image).reshape(3, 4, 4))[0, 0].tolist() == [200, 0, 0]


def test_seeded_joint_augmentation():
    a = I.Augmentation(1.0, 1.0, 1.0, 1.0, 1.0)
    image, mask = np.random.default_rng(1).random((16, 16, 3)), np.eye(16)
    one, two = (I.augment(image, mask, a, I.rng_of(5, 1, 3, e, "pass_consistent")) for e in (1, 2))
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])
    other = I.augment(image, mask, a, I.rng_of(5, 1, 3, 2, "independent"))
    assert not np.array_equal(one[0], other[0])


def test_whole_experiment(spark, tree, tmp_path):
    text = YAML.replace("ROOT", tree).replace("OUT", str(tmp_path))
    folder = experiment.run_experiment(spark, config.parse(text), text)
    summary = R.summarize(spark, str(tmp_path)).collect()
    assert len(summary) == 1 and summary[0].status == "ok" and summary[0].from_mean
    # crack/001 has no mask and so counts as normal, which costs the ranking one of three pairs
    assert 0.6 < summary[0].image_auroc <= 1 and 0.5 < summary[0].pixel_auroc <= 1 and summary[0].run_total_time_s > 0
    rows = spark.read.csv(f"{folder}/metrics/per_dataset.csv", header=True).collect()
    assert {r.dataset for r in rows} == {"nut"} and len(rows[0]) == 33
    images = [f for _, _, fs in os.walk(f"{folder}/artifacts") for f in fs]
    assert len(images) == 6
    assert os.path.exists(f"{folder}/config.yaml") and "revision" in open(f"{folder}/revision.txt").read()


# --- runs -------------------------------------------------------------------------------------------------


def test_summaries_with_failures(spark, tmp_path):
    def put(path, text):
        os.makedirs(tmp_path / path, exist_ok=True)
        for name, body in text.items():
            (tmp_path / path / f"{name}.csv").write_text(body)

    put("b/20240101/metrics", {"summary": "dataset,image_auroc\na,0.5\nc,bad\nMEAN,0.9\n", "profiling_timings": "dataset,phase,duration_s\na,fit,1\na,fit,2\na,total,5\n", "profiling_samples": "dataset,elapsed_s,ram_mb\na,0,10\na,1,nan\na,2,30\n"})
    put("b/20240201/metrics", {"summary": "dataset,image_auroc\na,0.5\nc,bad\n", "profiling_timings": "dataset,phase,duration_s\na,infer,4\n"})
    put("a/20240101/metrics", {})
    got = R.summarize(spark, str(tmp_path), ["image_auroc"]).collect()
    assert [(r.experiment_name, r.run_timestamp, r.status) for r in got] == [("a", "20240101", "failed"), ("b", "20240201", "ok"), ("b", "20240101", "ok")]
    first, last = got[1], got[2]
    assert (last.image_auroc, last.sum_fit_s, last.sum_infer_s, last.run_total_time_s, last.max_ram_mb, last.mean_ram_mb) == (0.9, 3, 0, 5, 30, 20)
    assert first.image_auroc == 0.5 and not first.from_mean and math.isnan(first.run_total_time_s) and first.sum_infer_s == 4
    put("c/20240101/metrics", {"summary": "name,value\na,1\n", "profiling_timings": "phase\nfit\n", "profiling_samples": ""})
    errors = {(r.experiment, r.run): r.error for r in R.problems(spark, str(tmp_path)).collect()}
    assert errors["a", "20240101"] == "summary: missing; profiling_samples: missing; profiling_timings: missing" and errors["b", "20240201"] == "profiling_samples: missing"
    assert errors["c", "20240101"] == "summary: lacks dataset; profiling_samples: empty; profiling_timings: lacks duration_s" and ("b", "20240101") not in errors
    bad = [r for r in R.summarize(spark, str(tmp_path), ["image_auroc"]).collect() if r.experiment_name == "c"][0]
    assert bad.status == "failed" and bad.error.startswith("summary: lacks dataset")
    R.write_text(f"file://{tmp_path}/x/report.md", "one")
    R.write_text(f"file://{tmp_path}/x/report.md", "two")
    assert (tmp_path / "x/report.md").read_text() == "two"
    text = R.markdown_report(R.summarize(spark, str(tmp_path), ["image_auroc"]), ["image_auroc"])
    assert "0.9000" in text and "Failed runs" in text and "fastest" in text
    assert R.summarize(spark, str(tmp_path / "none")).count() == 0


def test_fastest_slowest(spark):
    t = spark.createDataFrame([(str(i), "ok", float(i)) for i in range(5)] + [("x", "failed", 0.0)], "run_dir string, status string, t double")
    got = [(r.kind, r["rank"], r.run_dir) for r in S.fastest_slowest(t, "t", 2).orderBy("kind", "rank").collect()]
    assert got == [("fastest", 1, "0"), ("fastest", 2, "1"), ("slowest", 1, "4"), ("slowest", 2, "3")]


def test_profiler(spark):
    with Profiler("d", 0.01) as p:
        with p.phase("fit"):
            pass
    samples, timings = p.tables(spark)
    assert samples.count() >= 1 and [r.phase for r in timings.collect()] == ["fit", "total"]


def test_profiler_names_executors(spark):
    """A stand-in for Spark's monitoring interface: two executors, one with process metrics, busy in the second phase; the driver's entry is not counted twice."""
    import http.server
    import threading
    import time

    from patchwarden.plans.profiling import Executors

    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            k = len(calls)
            body = [{"id": "driver", "memoryUsed": 1, "totalDuration": 0}, {"id": "1", "memoryUsed": 7_000_000, "totalDuration": 0}, {"id": "2", "memoryUsed": 1, "totalDuration": 100 * k, "peakMemoryMetrics": {"JVMHeapMemory": 5_000_000, "ProcessTreeJVMRSSMemory": 20_000_000, "ProcessTreePythonRSSMemory": 30_000_000}}]
            out = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with Profiler("d", 0.02, executors=Executors(f"http://127.0.0.1:{server.server_port}/executors")) as p:
        with p.phase("fit"):
            time.sleep(0.3)
        with p.phase("infer"):
            time.sleep(0.3)
    server.shutdown()
    samples, _ = p.tables(spark)
    assert {r.executor for r in samples.select("executor").distinct().collect()} == {"driver", "1", "2"}
    got = {(r.phase, r.executor): r for r in p.usage(spark).collect()}
    assert set(got) == {(a, b) for a in ("fit", "infer") for b in ("driver", "1", "2")}
    assert got["fit", "1"].max_ram_mb == 7 and got["infer", "2"].max_ram_mb == 50
    assert got["infer", "1"].mean_cpu_pct == 0 and got["infer", "2"].mean_cpu_pct > 50
    assert Executors.of(spark).sample(0.0) == [] and Executors("http://127.0.0.1:9/none").sample(0.0) == []  # no interface, no answer


def test_artifacts(tmp_path):
    image = np.full((4, 4, 3), 100, np.uint8)
    mask = np.eye(4)
    paths = artifacts.write_artifacts(str(tmp_path), "a", image, mask, np.arange(16.0).reshape(4, 4), 8.0)
    assert len(paths) == 6 and all(open(p, "rb").read(8) == b"\x89PNG\r\n\x1a\n" for p in paths)
    assert struct.unpack(">II", open(paths[0], "rb").read()[16:24]) == (4, 4)
    assert artifacts.mask_overlay(image, mask, 0.5)[0, 0].tolist() == [178, 50, 50]
    assert artifacts.heatmap(np.zeros((2, 2))).shape == (2, 2, 3)


# --- streams ------------------------------------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(5).write.parquet(str(tmp_path / "events"))
    got = {r.event_type: (r.n, r.mean, r["std"]) for r in state.stream_scalar_moments(spark, str(tmp_path / "events"), "event_type", "value").collect()}
    for r in e.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect():
        assert got[r.event_type][0] == r.n and np.allclose(got[r.event_type][1:], (r.m, r.s))
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    v.repartitionByRange(4, "vec_id").write.parquet(str(tmp_path / "vectors"))
    m = state.stream_vector_moments(spark, str(tmp_path / "vectors"), "embedding")
    x = np.array([r.embedding for r in v.collect()], float)
    assert m.n == len(x) and np.allclose(m.cov, np.cov(x.T))


def test_stream_bank_equals_batch_bank(spark):
    from patchwarden.operators import coreset as B

    p = catalog.patches(spark, SF)
    want = B.merge_reduce(p, "features", "batch", "vec_id", 50, 32).orderBy("bank_id").collect()
    got = state.stream_merge_reduce(spark, f"{SF}/embeddings.parquet", "embedding", "vec_id", 64, 50, 32).orderBy("bank_id").collect()
    assert len(got) == len(want) and all(np.allclose(a.features, b.features) for a, b in zip(got, want))


def _features(bank):
    return [r.features for r in bank.orderBy("bank_id").collect()]


def _files(v, folder, wheres):
    """A file of rows for each condition, which a stream reads in this order."""
    for w in wheres:
        v.where(w).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("files", [["vec_id < 70", "vec_id BETWEEN 70 AND 202", "vec_id > 202"], ["vec_id > 350", "vec_id < 131", "vec_id BETWEEN 131 AND 350"], ["vec_id % 3 = 2", "vec_id % 3 = 0", "vec_id % 3 = 1"]])
def test_stream_bank_of_files_that_cut_blocks(spark, tmp_path, files):
    """Files that end inside blocks and come in any order give the batch's bank, also in two runs; what is pushed waits no longer."""
    from patchwarden.operators import coreset as B
    from patchwarden.operators import tail as T

    v, p = spark.read.parquet(f"{SF}/embeddings.parquet"), catalog.patches(spark, SF)
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    for part in (files[:2], files[2:]):
        _files(v, source, part)
        rows = spark.read.parquet(str(source)).selectExpr("vec_id", "vec_id div 8 AS b", "cast(embedding AS array<double>) AS features")
        want = _features(B.merge_reduce(rows, "features", "b", "vec_id", 20, 6))
        assert _features(state.stream_merge_reduce(spark, str(source), "embedding", "vec_id", 8, 20, 6, folder)) == want
    assert spark.read.parquet(*(f"{folder}/waiting/{n}" for n in os.listdir(tmp_path / "state" / "waiting"))).where("b >= 62").count() == 4  # the block that is not full
    c = T.TailConfig(k=40, pool=60, chunk=32)
    assert np.allclose(_features(state.stream_tail_aware(spark, str(source), "embedding", "vec_id", 64, c)), _features(T.tail_aware_bank(p, "features", "batch", "vec_id", c)))


@pytest.mark.parametrize("key", ["vec_id + 1003", "vec_id - 100", "vec_id + 40 * (vec_id div 50)", "vec_id / 2"])
def test_stream_bank_of_missing_blocks(spark, tmp_path, key):
    """Keys that do not begin with 0, have gaps or are no whole numbers: blocks count in their order, as in the batch."""
    from patchwarden.operators import coreset as B

    v = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("key", F.expr(key))
    _files(v, tmp_path / "in", ["vec_id > 299", "vec_id < 90", "vec_id BETWEEN 90 AND 299"])
    rows = v.selectExpr("key", "floor(key / 8) AS b", "cast(embedding AS array<double>) AS features")
    assert _features(state.stream_merge_reduce(spark, str(tmp_path / "in"), "embedding", "key", 8, 20, 6)) == _features(B.merge_reduce(rows, "features", "b", "key", 20, 6))


def test_pushed_blocks_get_no_more_rows(spark, tmp_path):
    """A batch that runs again changes nothing; rows of a block that is pushed are refused."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    waiting, first = state.Waiting(spark, f"file://{tmp_path}/waiting"), state.BinaryCounter(20, 6)
    push = lambda c, where, k: state._push_batch([c], v.where(where), waiting, state.UpdateContext(1, 1, k), "embedding", "vec_id", 8)
    push(first, "vec_id BETWEEN 5 AND 60", 0)
    assert not first.levels and waiting.rows(0).count() == 56
    counters = []
    for _ in range(2):
        c = state.BinaryCounter(20, 6)
        push(c, "vec_id < 5", 1)
        counters.append(c)
    assert [c.blocks for c in counters] == [7, 7] and all(np.array_equal(counters[1].levels[k], x) for k, x in counters[0].levels.items())
    push(c, "vec_id = 62", 2)
    assert waiting.rows(c.blocks).count() == 6 and waiting.table._names() == ["000001-000000000000", "000001-000000000002"]
    with pytest.raises(ValueError, match="block 0 had all its 8 rows"):
        push(c, "vec_id = 3", 3)


def _parts(spark, folder, n):
    """The embeddings as n files of whole blocks of 64, one a micro-batch."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").cache()
    size = -(-v.count() // (64 * n)) * 64
    for k in range(n):
        v.where(f"vec_id div {size} = {k}").coalesce(1).write.mode("append").parquet(str(folder))
    return np.array([r.embedding for r in v.orderBy("vec_id").collect()], float)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """A stream that is started again on its folder reads new files only, and a batch that runs twice counts once."""
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    half = v.count() // 2
    v.where(f"vec_id < {half}").coalesce(1).write.parquet(str(source))
    first = state.stream_vector_moments(spark, str(source), "embedding", folder)
    assert first.n == half and state.stream_vector_moments(spark, str(source), "embedding", folder).n == half
    v.where(f"vec_id >= {half}").coalesce(1).write.mode("append").parquet(str(source))
    both = state.stream_vector_moments(spark, str(source), "embedding", folder)
    x = np.array([r.embedding for r in v.collect()], float)
    assert both.n == len(x) and np.allclose(both.cov, np.cov(x.T))
    table = state.StateTable(spark, f"{folder}/state")
    again = state.UpdateContext(1, 1, 1)
    assert table.last(again.name).first().n == half  # what the second batch would start from again
    assert len(table._names()) == 2 and not state.UpdateContext(1, 2, 5).last_pass
    assert state.stream_vector_moments(spark, str(source), "embedding", passes=2).n == 2 * len(x)


def written_bytes(folder):
    return {p: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder / p) for f in names if f.endswith(".parquet")) for p in sorted(os.listdir(folder))}


def test_deltas_follow_the_changed_keys(spark, tmp_path):
    """Many keys, few of which change in a batch: a batch writes these only; bases are made now and then; a batch that runs again, also the one that made a base, changes nothing."""
    folder = f"file://{tmp_path}/state"
    t = state.DeltaState(spark, folder, ["key"], every=4)
    want: dict = {}

    def batch(k, keys):
        rows = [(key, k * 1000 + i, float(k)) for i, key in enumerate(keys)]
        want.update({r[0]: r[1:] for r in rows})
        t.write(spark.createDataFrame(rows, "key string, n long, mean double").coalesce(1), state.UpdateContext(1, 1, k))

    def rows():
        return {r.key: (r.n, r.mean) for r in t.latest().collect()}

    batch(0, [f"k{i}" for i in range(20000)])
    first = written_bytes(tmp_path / "state" / "delta")
    for k in range(1, 11):
        batch(k, [f"k{k}", f"k{k + 1}", f"new{k}"])
        assert rows() == want
        if k in (3, 4, 7):  # again, as after a failure: 3 and 7 make a base
            batch(k, [f"k{k}", f"k{k + 1}", f"new{k}"])
            assert rows() == want
    sizes = written_bytes(tmp_path / "state" / "delta")
    assert max(sizes.values()) < 0.05 * max(first.values())  # the first delta is in a base now
    assert t.bases._names() == ["000001-000000000003", "000001-000000000007"] and min(sizes) > "000001-000000000003"
    assert {r.key: r.n for r in t.latest("000001-000000000008").collect()}["k10"] == 10  # as it was before


def test_keyed_streams_go_on_where_they_stopped(spark, tmp_path):
    """Compacted after every batch or hardly ever, stopped and started again: the moments of all rows."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "value")
    parts = e.randomSplit([1.0] * 5, 3)
    for every in (1, 2, 100):
        source, folder = tmp_path / f"in{every}", f"file://{tmp_path}/state{every}"
        for k, p in enumerate(parts):
            p.coalesce(1).write.mode("append").parquet(str(source))
            if k in (2, 4):
                got = {r.event_type: (r.n, r.mean, r["std"]) for r in state.stream_scalar_moments(spark, str(source), "event_type", "value", folder, every).collect()}
        want = {r[0]: r[1:] for r in e.groupBy(F.col("event_type").cast("string")).agg(F.count("value"), F.avg("value"), F.stddev_pop("value")).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("bad,kind", [((0, 1, 0), ValueError), ((2, 1, 0), ValueError), ((1, 0, 0), ValueError), ((1, 1, -1), ValueError), ((1.0, 1, 0), TypeError), ((True, 1, 0), TypeError), ((1, 1, None), TypeError)])
def test_pass_metadata_is_validated(bad, kind):
    with pytest.raises(kind):
        state.UpdateContext(*bad)


def test_passes_are_counted_from_one(spark, tmp_path):
    seen = []

    def update(batch, before, context):
        seen.append((context.pass_number, context.passes, context.batch_id, context.last_pass))
        return batch.limit(1).select("n_regionkey")

    state.run_stream(spark, lambda: state.read_stream(spark, f"{SF}/nation.parquet"), update, f"file://{tmp_path}/s", 2)
    assert seen == [(1, 2, 0, False), (2, 2, 0, True)]


def test_sequential_streams_equal_batches(spark, tmp_path):
    from patchwarden.operators import coreset as B
    from patchwarden.operators import tail as T
    from patchwarden.operators.reduction import fit_pca
    from patchwarden.operators.whitening import fit_whitening

    x = _parts(spark, tmp_path / "in", 3)
    p = catalog.patches(spark, SF)
    rows = lambda b: np.array([r.features for r in b.orderBy("bank_id").collect()])
    path = str(tmp_path / "in")
    assert np.allclose(rows(state.stream_budgeted(spark, path, "embedding", "vec_id", 9)), rows(B.budgeted_kcenter(p, "features", "vec_id", 9)))
    km = rows(state.stream_minibatch_kmeans(spark, path, "embedding", "vec_id", 5, 64, 7))
    assert np.allclose(km, rows(B.minibatch_kmeans(p, "features", "vec_id", 5, 64, 7)))
    c = T.TailConfig(k=40, pool=60, chunk=32)
    seen = {}
    want = rows(T.tail_aware_bank(p, "features", "batch", "vec_id", c, seen))
    assert np.allclose(rows(state.stream_tail_aware(spark, path, "embedding", "vec_id", 64, c)), want)
    assert seen["bank"] == len(want) == seen["main"] + seen["tail"] + seen["filled"] and seen["budget"] == 40
    assert np.allclose(state.stream_pca(spark, path, "embedding").variances, fit_pca(p, "features").variances)
    assert np.allclose(state.stream_whitening(spark, path, "embedding").inverse, fit_whitening(p, "features").inverse) and len(x)


def test_layers_hue_and_self_distances(spark):
    ran = []
    stages = [(n, lambda v: v + 1) for n in ("stages.0", "stages.1", "stages.2")]
    f = I.LayerExtractor(stages, ["stages.1"], (lambda n, v: ran.append(n),))
    assert set(f(np.zeros(2))) == {"stages.1"} and ran == ["stages.0", "stages.1"]
    with pytest.raises(ValueError):
        I.LayerExtractor(stages, ["none"])
    import colorsys

    x = np.random.default_rng(1).random((4, 5, 3))
    for turn in (0.0, 0.1, -0.3):
        got = I.shift_hue(x, turn)
        for v, g in zip(x.reshape(-1, 3), got.reshape(-1, 3)):
            h, s, b = colorsys.rgb_to_hsv(*v)
            assert np.allclose(colorsys.hsv_to_rgb((h + turn) % 1, s, b), g)
    from patchwarden.plans.pipeline import FitConfig, Model, fit

    model = fit(catalog.patches(spark, SF), FitConfig(bank="kcenter", n_clusters=20, scorer="max", self_distances=True))
    assert "self_distance" in model.bank.columns and model.telemetry == {"rows": 20, "budget": 20}
    assert model.image_scores(catalog.patches(spark, SF)).count() > 0 and Model is type(model)
    with pytest.raises(ValueError):
        FitConfig(bank="kcenter", scorer="eq7", self_distances=True)


def test_registry_and_families(spark):
    from patchwarden.operators import knn as J
    from patchwarden.plans import registry

    registry.register_functions(spark)
    assert spark.sql("SELECT sq_dist(array(1D, 2D), array(1D, 4D)), sq_norm(array(3D, 4D))").first()[:] == (4.0, 25.0)
    with pytest.raises(ValueError):
        registry.register_bank("kcenter", ("OFFLINE",), None)
    bank = catalog.prototypes(spark, SF)
    assert J.bank_family(bank) == "nearest" and J.bank_family(catalog.components(spark, SF)) == "density"
    assert "self_distance" in J.materialize_bank(bank, True).columns
    q = catalog.patches(spark, SF).select("vec_id", "features")
    assert J.query_bank(q, catalog.components(spark, SF), 1).columns == ["vec_id", "component_id", "log_prob", "distance"]
    with pytest.raises(ValueError):
        J.bank_family(q)


def test_phase_map(spark):
    t = spark.createDataFrame([("r", "fit", 1.0), ("r", "fit", 2.0), ("r", "infer", 5.0)], "run string, phase string, duration_s double")
    assert S.phase_map(t, ["run"]).first().phases == {"fit": 3.0, "infer": 5.0}
