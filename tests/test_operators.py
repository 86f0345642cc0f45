"""Numeric operators against numpy, by hand and by invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchwarden.functions import kernels as N
from patchwarden.functions import linalg as L
from patchwarden.functions import vectors as V
from patchwarden.operators import balls as BA
from patchwarden.operators import calibration as CA
from patchwarden.operators import coreset as B
from patchwarden.operators import dedup as D
from patchwarden.operators import knn as J
from patchwarden.operators import metrics as M
from patchwarden.operators import moments as MO
from patchwarden.operators import reduction as R
from patchwarden.operators import scoring as C
from patchwarden.operators import segmentation as G
from patchwarden.operators import selection as S
from patchwarden.operators import tail as T
from patchwarden.operators import tolerance as TO
from patchwarden.operators import whitening as W


def frame(spark, x, batch=5):
    rows = [(i, i // batch, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, batch long, features array<double>")


def grid(n, d):
    return np.arange(n * d, dtype=float).reshape(n, d) / (n * d - 1)


def bank_of(df):
    return np.array([r.features for r in df.orderBy("bank_id").collect()])


RNG = np.random.default_rng(4)
X = RNG.normal(size=(90, 6)) @ RNG.normal(size=(6, 6))


# --- moments, whitening, reduction ------------------------------------------------------------


def test_moments_match_numpy(spark):
    m = MO.fit_moments(frame(spark, X).repartition(7), "features")
    assert m.n == 90 and np.allclose(m.mean, X.mean(0)) and np.allclose(m.cov, np.cov(X.T))
    one = MO.fit_moments(frame(spark, X[:1]), "features")
    assert not one.cov.any()
    twice = m.repeated(2)
    assert np.allclose(twice.mean, m.mean) and np.allclose(twice.cov, m.m2 * 2 / 179)
    with pytest.raises(ValueError):
        MO.fit_moments(frame(spark, X).limit(0), "features")


def test_moments_tree(spark, monkeypatch):
    monkeypatch.setattr(MO, "FAN_IN", 2)
    assert np.allclose(MO.fit_moments(frame(spark, X).repartition(9), "features").cov, np.cov(X.T))


def test_mahalanobis_identity(spark):
    c = np.array([[2, 0.3], [0.3, 0.8]])
    mean = np.array([1.0, -2.0])
    m = W.whitening_of(MO.Moments(100, mean, c * 99), W.WhiteningConfig(method="JITTER_ONLY"))
    q = np.array([[2, -1], [0.5, -2.5]])
    z = np.array([r.z for r in m.transform(frame(spark, q), "features").orderBy("vec_id").collect()])
    want = np.einsum("ij,jk,ik->i", q - mean, np.linalg.inv(c), q - mean)
    assert np.allclose((z**2).sum(1), want, rtol=1e-10)


def test_singular_covariance_factors():
    s = L.regularize(np.ones((3, 3)), 0.25, 1e-8)
    factor, jitter = L.stable_cholesky(s)
    assert np.isfinite(factor).all() and jitter == 0
    assert L.stable_cholesky(np.ones((3, 3)), 1e-6)[1] >= 1e-6
    with pytest.raises(ValueError):
        L.stable_cholesky(-np.eye(2), 1e-6, 1e-3)


def test_shrinkage_intensities(spark):
    s, n, d = np.cov(X.T), 90, 6
    t2, t = (s * s).sum(), np.trace(s)
    assert math.isclose(L.oas(s, n), min(1, ((1 - 2 / d) * t2 + t * t) / ((n + 1 - 2 / d) * (t2 - t * t / d))))
    assert L.oas(s, 1) == L.rblw(s, 2) == 1.0 and L.oas(np.eye(3), 50) == 1.0
    b = np.cov(X.T, bias=True)
    c = X - X.mean(0)
    beta = sum(((np.outer(r, r) - b) ** 2).sum() for r in c) / n**2
    delta = ((b - np.trace(b) / d * np.eye(d)) ** 2).sum()
    df = frame(spark, X)
    m = MO.fit_moments(df, "features")
    assert math.isclose(L.ledoit_wolf(m.m2 / n, n, MO.fourth_moment(df, "features", m.mean)), min(beta, delta) / delta, rel_tol=1e-9)
    stream = W.shrinkage(W.WhiteningConfig(method="LEDOIT_WOLF"), m, None)
    assert math.isclose(stream, L.rblw(s, n))
    with pytest.raises(ValueError):
        W.WhiteningConfig(method="OAS", shrinkage=0.5)


def test_whitened_covariance_is_identity(spark):
    df = frame(spark, X)
    z = W.fit_whitening(df, "features", W.WhiteningConfig(method="JITTER_ONLY")).transform(df, "features")
    assert np.allclose(MO.fit_moments(z, "z").cov, np.eye(6))


def test_pca(spark):
    df = frame(spark, X)
    m = R.fit_pca(df, "features", 0.95)
    w = np.linalg.eigvalsh(np.cov(X.T))[::-1]
    k = int(np.argmax(np.cumsum(w) / w.sum() >= 0.95)) + 1
    assert len(m.components) == k and np.allclose(m.variances, w[:k])
    y = np.array([r.reduced for r in m.transform(df, "features").orderBy("vec_id").collect()])
    assert np.allclose(np.cov(y.T), np.diag(w[:k]), atol=1e-9)
    again = R.fit_pca(df.repartition(3), "features", 0.95)
    assert np.allclose(again.components, m.components)
    assert len(L.principal(np.zeros((3, 3)), 0.9)[0]) == 1


# --- banks ------------------------------------------------------------------------------------


def test_farthest_first_rules():
    x = grid(9, 3)
    assert N.farthest_first(x, 9).tolist() == list(range(9))
    assert N.farthest_first(np.arange(27.0).reshape(9, 3), 3).tolist() == [0, 8, 4]
    same = np.ones((5, 2))
    assert N.farthest_first(same, 3).tolist() == [0, 0, 0]
    assert N.farthest_from(same, np.ones((1, 2)), 3).tolist() == [0, 1, 2]


def reference_merge_reduce(x, batch, k, chunk):
    cap, levels = min(k, chunk), {}
    for a in range(0, len(x), batch):
        b = x[a : a + batch]
        b, level = b[N.farthest_first(b, min(cap, len(b)))], 0
        while level in levels:
            b = np.concatenate([levels.pop(level), b])
            b = b[N.farthest_first(b, min(cap, len(b)))]
            level += 1
        levels[level] = b
    y = np.concatenate([levels[i] for i in sorted(levels)])
    return y[N.farthest_first(y, min(k, len(y)))]


@pytest.mark.parametrize("n", [4, 9, 35, 40, 90])
def test_merge_reduce_counts_like_a_binary_counter(spark, n):
    got = bank_of(B.merge_reduce(frame(spark, X[:n]).repartition(3), "features", "batch", "vec_id", 12, 4))
    assert np.allclose(got, reference_merge_reduce(X[:n], 5, 12, 4))
    gaps = frame(spark, X[:n]).withColumn("batch", F.col("batch") * 3 + 7)
    assert np.allclose(bank_of(B.merge_reduce(gaps, "features", "batch", "vec_id", 12, 4)), got)


def test_kcenter_budget(spark):
    got = bank_of(B.merge_reduce(frame(spark, grid(9, 3), 4), "features", "batch", "vec_id", 3, 2))
    assert got.shape[0] <= 3 and got.shape[1] == 3
    with pytest.raises(ValueError):
        B.enforce_budget(frame(spark, X), 10)
    assert B.enforce_budget(frame(spark, X), 10, contract="OFFLINE") == 90


@pytest.mark.parametrize("candidates,rows,top,lag", [(2, 13, 2, 2), (1000, 4096, 64, 8)])
def test_selections_in_passes_equal_those_in_a_block(spark, monkeypatch, candidates, rows, top, lag):
    """With repeated rows, so that distances tie."""
    x = np.concatenate([X, X[:20]])
    df = frame(spark, x).repartition(3).cache()
    kinds = {"farthest": lambda: B.farthest_first(df, "features", "vec_id", 12), "all": lambda: B.farthest_first(df, "features", "vec_id", len(x)), "more": lambda: B.farthest_first(df, "features", "vec_id", 500), "greedy": lambda: B.greedy(df, "features", "vec_id", 0.1), "approximate": lambda: B.greedy(df, "features", "vec_id", 0.1, True, 3)}
    want = {k: bank_of(f()) for k, f in kinds.items()}
    assert np.allclose(want["farthest"], x[N.farthest_first(x, 12)]) and np.allclose(want["more"], x)
    monkeypatch.setattr(B, "BLOCK_BYTES", 1)
    for name, value in (("CANDIDATES", candidates), ("BLOCK_ROWS", rows), ("TOP", top), ("LAG", lag)):
        monkeypatch.setattr(S, name, value)
    for k, f in kinds.items():
        assert np.array_equal(bank_of(f()), want[k]), k


def test_passes_are_lazy(spark, monkeypatch):
    """Blocks far below the best candidate are left alone, a row meets each pick once at most, and a pass does not cost more the more picks there are."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 3)) * 0.01, rng.normal(size=(100, 3)) * 5])
    for name, value in (("CANDIDATES", 4), ("BLOCK_ROWS", 20), ("TOP", 4), ("LAG", 6)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(B, "BLOCK_BYTES", 1)
    log = []
    got = bank_of(B.farthest_first(frame(spark, x).coalesce(1), "features", "vec_id", 40, log))
    assert np.array_equal(got, x[N.farthest_first(x, 40)])
    assert sum(p.picks for p in log) == 39 and log[0].blocks == 25
    assert sum(p.distances for p in log) <= 40 * len(x)
    assert sum(p.blocks for p in log[1:]) < 25 * (len(log) - 1) * 0.6
    assert max(p.distances for p in log[1:]) <= len(x) * 4 * 6


def test_lowered_is_exact():
    rng = np.random.default_rng(4)
    z, p = rng.normal(size=(300, 5)) + 100, rng.normal(size=(700, 5)) + 100
    z[:50] = p[:50]
    d = np.full(300, np.inf)
    want = np.min([N.distances(z, q) for q in p], 0)
    assert np.array_equal(S.lowered(d, z, p), want) and np.array_equal(S.lowered(want, z, p[:9]), want)


def test_budgeted_kcenter(spark):
    c = X[:5].copy()
    for r in X[5:]:
        d = np.linalg.norm(c[:, None] - c[None], axis=2) + np.diag([np.inf] * 5)
        if np.linalg.norm(c - r, axis=1).min() > d.min():
            c[int(np.argmin(d.min(1)))] = r
    assert np.allclose(bank_of(B.budgeted_kcenter(frame(spark, X).repartition(4), "features", "vec_id", 5)), c)


@pytest.mark.parametrize("approximate", [False, True])
def test_greedy_leaves_one_task_where_picks_are_many(spark, monkeypatch, approximate):
    """Rows fit a block, but rows times picks are more than a task may do."""
    want = bank_of(B.greedy(frame(spark, X), "features", "vec_id", 0.1, approximate, 3))
    monkeypatch.setattr(B, "TASK_WORK", 1)
    monkeypatch.setattr(B, "one_block", None)
    assert np.allclose(bank_of(B.greedy(frame(spark, X), "features", "vec_id", 0.1, approximate, 3)), want)


def test_greedy(spark):
    d = np.linalg.norm(X[:, None] - X[None], axis=2)
    anchor, picks = np.linalg.norm(d, axis=1), []
    for _ in range(9):
        picks.append(int(np.argmax(anchor)))
        anchor = np.minimum(anchor, d[:, picks[-1]])
    assert np.allclose(bank_of(B.greedy(frame(spark, X), "features", "vec_id", 0.1)), X[picks])
    approx = bank_of(B.greedy(frame(spark, X), "features", "vec_id", 0.1, True, 3))
    assert len(approx) == 9 and all((np.abs(X - r).sum(1) == 0).any() for r in approx)
    with pytest.raises(ValueError):
        B.greedy(frame(spark, X), "features", "vec_id", 1.0)


def test_kmeans_banks(spark):
    df = frame(spark, grid(12, 3), 6)
    for b in (B.kmeans(df, "features", 3, 7), B.minibatch_kmeans(df, "features", "vec_id", 3, 6, 7)):
        x = bank_of(b)
        assert x.shape == (3, 3) and np.isfinite(x).all()
    assert B.cluster_count("auto", "auto", "OFFLINE", 300) == 30 and B.cluster_count("auto", (2, 50), "STREAMING", 0) == 50


@pytest.mark.parametrize("strategy", T.STRATEGIES)
@pytest.mark.parametrize("dedup", ["exact_row", "quantized", "tolerance"])
def test_tail_aware_bank(spark, strategy, dedup):
    z = (X - X.mean(0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(X.T))).T
    c = T.TailConfig(k=8, strategy=strategy, main_fraction=0.75, pool=10, p_min=0.0, p_max=0.3, dedup=dedup, eps=1e-6, chunk=4)
    got = bank_of(T.tail_aware_bank(frame(spark, z), "features", "batch", "vec_id", c))
    assert got.shape == (8, 6) and len(np.unique(got, axis=0)) == 8
    assert all(np.isclose(z, r).all(1).any() for r in got)
    main = reference_merge_reduce(z, 5, 6, 4)
    assert np.allclose(got[: len(main)], main)


def test_tail_rules():
    with pytest.raises(ValueError):
        T.TailConfig(k=10, pool=1)
    with pytest.raises(ValueError):
        T.TailConfig(k=10, epochs=1)
    assert T.TailConfig(k=10, main_fraction=0.25).main_budget == 2  # half to even


# --- dedup ------------------------------------------------------------------------------------


def test_dedup(spark):
    x = np.array([[0.05, 1], [0.15, 1], [0.05, 1], [0.25, 1], [-0.0, 2], [0.0, 2]])
    df = frame(spark, x)
    ids = lambda d: sorted(r.vec_id for r in d.collect())
    assert ids(D.dedup_first(df, "features", "vec_id")) == [0, 1, 3, 4]
    assert ids(D.dedup_first(df, "features", "vec_id", "quantized", 1)) == [0, 1, 4]
    assert ids(D.dedup_tolerance(df, "features", "vec_id", 0.11)) == [0, 3, 4]
    pool = frame(spark, x[:1])
    assert ids(D.in_pool(df, pool)) == [0, 2] and ids(D.not_in_pool(df, pool)) == [1, 3, 4, 5]
    assert ids(D.in_pool(df, pool, strategy="tolerance", eps=0.11)) == [0, 1, 2]
    assert [r.vec_id for r in D.stable_top_k(df.withColumn("s", F.col("features")[1]), "s", "vec_id", 3).collect()] == [4, 5, 0]


# --- neighbours and scores ----------------------------------------------------------------------


def test_knn_both_ways(spark):
    bank = frame(spark, X[:40]).select(F.col("vec_id").alias("bank_id"), "features")
    q = frame(spark, X).select("vec_id", "features")
    d = ((X[:, None] - X[None, :40]) ** 2).sum(2)
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(40), d[i]))[:4])}
    for limit in (1 << 20, 0):
        got = {(r.vec_id, r.rank): (r.bank_id, r.sq_dist) for r in J.knn_join(q, bank, 4, bank_bytes=limit).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


def test_position_knn_in_blocks(spark, monkeypatch):
    """Most rows at one position; blocks of some rows."""
    rows = [(i, 0 if i % 4 else i % 3, [float(v) for v in r]) for i, r in enumerate(X)]
    q = spark.createDataFrame(rows, "vec_id long, pos int, features array<double>")
    bank = q.withColumnRenamed("vec_id", "bank_id").repartition(3)
    want = []
    for i, p, v in rows:
        near = sorted((((X[j] - X[i]) ** 2).sum(), j) for j, (_, o, _) in enumerate(rows) if o == p)[:3]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    for size in (2048, 5):
        monkeypatch.setattr(J, "QUERY_CHUNK", size)
        monkeypatch.setattr(J, "BANK_CHUNK", size)
        got = J.position_knn(q, bank, ["pos"], 3).select("vec_id", "rank", "bank_id").collect()
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("gamma,threshold", [(0.4, 0.12), (0.9, 0.02), (0.0, 0.3), (0.5, 0.0)])
def test_pni_gate_joins_no_patch_with_all_priors(spark, gamma, threshold):
    """60 images of 2 x 2 patches, each with prototypes of its own and one that many share: scores are those of all pairs, and no step has a row for
    each patch and each prototype of its position."""
    r = np.random.default_rng(6)
    n, bank = 60, r.normal(size=(61, 3))
    x = np.where(r.random((n, 4, 1)) < 0.4, bank[60], bank[:60, None]) + r.normal(size=(n, 4, 3)) * 0.01
    p = spark.createDataFrame([(i, c, c // 2, c % 2, x[i, c].tolist()) for i in range(n) for c in range(4)], "image_idx long, patch_pos long, row long, col long, features array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)], "bank_id long, features array<double>")
    k = J.knn_join(p, b, 1)
    prior = C.position_prior(k.select("row", "col", "bank_id"))
    got = C.pni_gate(p, k.drop("row", "col"), b, prior, 3, True, gamma, threshold, 1.0).collect()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, most = store.executionMetrics(last.executionId()), 0
    for m in range(last.metrics().size()):
        metric = last.metrics().apply(m)
        found = values.get(metric.accumulatorId())
        if metric.name() == "number of output rows" and found.isDefined():
            most = max(most, int(found.get().split("\n")[-1].split(" ")[0].replace(",", "")))
    assert 240 <= most <= 2400  # 240 patches, up to 60 prototypes a position
    d = ((x[:, :, None] - bank) ** 2).sum(-1)
    label = d.argmin(2)
    for row in got:
        share = np.bincount(np.delete(label[row.image_idx], row.patch_pos), minlength=61) / 3
        mixed = gamma * np.bincount(label[:, row.patch_pos], minlength=61) / n + (1 - gamma) * share
        of = d[row.image_idx, row.patch_pos]
        assert abs(row.score - (of[mixed >= threshold].min() if (mixed >= threshold).any() else of.min())) < 1e-9
    assert len(got) == 240


def test_top_k_is_bounded_and_keeps_ties(monkeypatch):
    """Memory does not grow with the bank; of many equal rows those of the lowest ids come first, in any pieces."""
    import tracemalloc

    r = np.random.default_rng(7)
    q, bank = r.normal(size=(1024, 8)), r.normal(size=(60_000, 8))
    tracemalloc.start()
    BA.top_k(q, np.arange(len(bank)), bank, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # 1024 x 60,000 doubles are 470 MB
    copies = np.concatenate([r.normal(size=(50, 8)) + 9, np.repeat(r.normal(size=(1, 8)), 400, 0), r.normal(size=(50, 8)) + 9])
    copies[3] = np.nan
    for sizes in ((512, 4096, 1 << 14, 1 << 20), (7, 30, 11, 1 << 20), (7, 30, 11, 100)):
        for name, v in zip(("QUERY_PIECE", "BANK_PIECE", "PAIRS", "MOST_PAIRS"), sizes):
            monkeypatch.setattr(BA, name, v)
        i, d = BA.top_k(copies[60:90] + 0.01, np.arange(len(copies)), copies, 3)
        assert (i == [50, 51, 52]).all() and np.allclose(d, 8 * 1e-4)
        assert BA.top_k(copies[:5], np.arange(len(copies)), copies, 1)[0][[0, 1, 2, 4], 0].tolist() == [0, 1, 2, 4]


def test_top_k_makes_no_second_bank():
    """A batch of queries takes less memory than the bank, which every worker holds."""
    import tracemalloc

    r = np.random.default_rng(8)
    bank = r.normal(size=(120_000, 64))
    q = bank[[5, 99_999, 70_000]] + 1e-3
    tracemalloc.start()
    i, d = BA.top_k(q, np.arange(len(bank)), bank, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i[:, 0].tolist() == [5, 99_999, 70_000] and np.allclose(d, 64e-6)
    assert peak < bank.nbytes / 4


@pytest.mark.parametrize("k", [1, 4, 70])
def test_ball_knn_skips_balls(spark, monkeypatch, k):
    """Equal to brute force, ties by id included, with most pairs of balls left out."""
    monkeypatch.setattr(BA, "QUERY_ROWS", 8)
    monkeypatch.setattr(BA, "BANK_ROWS", 25)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 4)) * 8
    bank = np.round(centers[rng.integers(0, 12, 500)] + rng.normal(size=(500, 4)) * 0.3, 1)
    bank = np.concatenate([bank, bank[:60]])  # ties
    query = np.concatenate([bank[:200], centers + 0.1, centers[:1] * 50])
    frame_ = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    met = []
    got = {(r.id, r.rank): (r.bank_id, r.sq_dist) for r in BA.ball_knn(frame_(query), frame_(bank), k, met).collect()}
    d = ((query[:, None] - bank[None]) ** 2).sum(-1)
    want = {}
    for q in range(len(query)):
        for rank, b in enumerate(sorted(range(len(bank)), key=lambda b: (d[q, b], b))[:k], 1):
            want[q, rank] = (b, d[q, b])
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert np.allclose([got[x][1] for x in want], [v[1] for v in want.values()])
    compared, pairs = met[0]
    assert compared < pairs * (0.6 if k < 70 else 1.01)


def test_best_components_prunes(spark):
    """The best component of each row, with ties and narrow and wide components; few pairs are evaluated, and a row a patch comes back."""
    rng = np.random.default_rng(7)
    mean = rng.normal(size=(200, 6)) * 5
    variance = rng.uniform(0.5, 1.5, (200, 6))
    mean[150], variance[150] = mean[20], variance[20]
    weight = np.ones(200)
    x = np.concatenate([mean[rng.integers(0, 200, 300)] + rng.normal(size=(300, 6)) * 0.5, mean[20:21]])
    ids = np.arange(200)
    logs = np.log(weight / weight.sum())
    lp = C._log_prob(x, mean, variance, logs)
    got, d, pairs = C.best_components(x, ids, mean, variance, logs)
    assert got.tolist() == [min(np.flatnonzero(np.isclose(r, r.max(), rtol=0, atol=1e-9)).tolist()) for r in lp] and np.allclose(d, -lp.max(1))
    assert pairs < 0.1 * len(x) * 200 and got[-1] == 20
    comps = spark.createDataFrame([(i, 1.0, m.tolist(), v.tolist()) for i, (m, v) in enumerate(zip(mean, variance))], "component_id long, weight double, mean array<double>, variance array<double>")
    q = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "n long, features array<double>").repartition(3)
    for limit in (1 << 28, 5000):
        rows = C.best_component(q, comps, limit).orderBy("n").collect()
        assert [r.component_id for r in rows] == got.tolist() and np.allclose([r.distance for r in rows], d)


def test_density_in_blocks(spark):
    c = spark.createDataFrame([(i, float(i + 1), [float(i), 1.0], [1.0 + i, 0.0]) for i in range(5)], "component_id long, weight double, mean array<double>, variance array<double>")
    q = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(7)], "k long, features array<double>")
    one, many = (sorted(map(tuple, C.density_join(q, c, size).collect())) for size in (1 << 20, 100))
    assert len(one) == 35 and one == many
    for k, i, lp, d in one:
        v = np.array([1.0 + i, 1e-12])
        want = np.log((i + 1) / 15) - 0.5 * ((np.array([k - i, 1.0]) ** 2 / v).sum() + np.log(v).sum() + 2 * np.log(2 * np.pi))
        assert np.isclose(lp, want) and d == -lp


def test_pool_is_the_best_of_distinct_rows(spark, monkeypatch):
    """Repeated rows, tied scores, more parts than one merge takes: the pool is that of a dedup of all rows, and what leaves a partition is bounded."""
    monkeypatch.setattr(T, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (600, 3)).astype(float)
    x[:5] = -0.0
    score = np.abs(x).sum(1)
    rows = [(i, [float(v) for v in r], float(s)) for i, (r, s) in enumerate(zip(x, score))]
    df = spark.createDataFrame(rows, "o long, features array<double>, tail_score double").repartition(7).cache()
    for size in (1, 9, 40, 1000):
        seen, want = set(), []
        for i in range(600):
            key = (x[i] + 0.0).tobytes()
            if key not in seen:
                seen.add(key)
                want.append((-score[i], i))
        got = T.best_of(df, T.TailConfig(k=2, pool=size))
        assert [(r.o, r.features) for r in got.collect()] == [(i, (x[i] + 0.0).tolist()) for _, i in sorted(want)[:size]]
        parts = T.best_distinct(df, size)
        assert parts.count() <= size
    quantized = T.best_of(df, T.TailConfig(k=2, pool=9, dedup="quantized", decimals=0))
    assert [r.o for r in quantized.collect()] == [i for _, i in sorted(want)[:9]]
    assert T.best_of(df.limit(0), T.TailConfig(k=2, pool=9)).count() == 0


def tolerance_cases():
    rng = np.random.default_rng(12)
    chain = np.stack([np.arange(120) * 0.09, np.zeros(120), np.zeros(120)], 1)
    crowd = rng.normal(size=(150, 3)) * 0.02
    return {
        "spread": (rng.normal(size=(300, 3)), 0.4), "chain": (chain, 0.1), "chain back": (chain[::-1], 0.1), "shuffled chain": (chain[rng.permutation(120)], 0.1), "crowded cell": (crowd, 0.1),
        "crowd and others": (np.concatenate([crowd, rng.normal(size=(60, 3)), crowd[:20] + 0.05])[rng.permutation(230)], 0.11), "on the edge": (np.arange(60.0)[:, None] * np.array([[0.5, 0.0]]), 0.5), "none": (rng.normal(size=(50, 4)), 0.0), "all": (rng.normal(size=(80, 2)), 100.0),
    }


@pytest.mark.parametrize("case", list(tolerance_cases()))
def test_tolerance_in_parallel_rounds(spark, monkeypatch, case):
    """Small blocks, long chains of conflicts over them, one crowded cell: what stays is what stays one after another."""
    monkeypatch.setattr(TO, "BLOCK_ROWS", 20)
    x, eps = tolerance_cases()[case]
    rounds = []
    got = TO.first_within(frame(spark, x).repartition(3), "vec_id", "features", "vec_id", eps, rounds)
    assert sorted(r.rid for r in got.collect()) == N.tolerance_kept(x, eps).tolist()
    assert rounds[-1] == 0 and len(rounds) <= (3 if case in ("none", "all", "crowded cell") else 20)


@pytest.mark.parametrize("case", list(tolerance_cases()))
def test_tolerance_by_order(spark, monkeypatch, case):
    """Rounds over the first undecided rows, of several blocks each."""
    monkeypatch.setattr(TO, "BLOCK_ROWS", 20)
    monkeypatch.setattr(TO, "ROUND_ROWS", 50)
    monkeypatch.setattr(TO, "MEETINGS", -1)
    x, eps = tolerance_cases()[case]
    rounds = []
    got = TO.first_within(frame(spark, x).repartition(3), "vec_id", "features", "vec_id", eps, rounds)
    assert sorted(r.rid for r in got.collect()) == N.tolerance_kept(x, eps).tolist()
    assert rounds[-1] == 0 and len(rounds) <= (1 if case in ("all", "crowded cell") else 15)


def test_tolerance_sends_no_pairs_of_blocks_where_all_meet(spark, monkeypatch):
    """Many dimensions and a wide tolerance: all blocks meet, so none is sent to others."""
    monkeypatch.setattr(TO, "BLOCK_ROWS", 50)
    x = np.random.default_rng(4).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def refused(eps):
        raise AssertionError("pairs of blocks")

    monkeypatch.setattr(TO, "_between", refused)
    got = TO.first_within(frame(spark, x).repartition(3), "vec_id", "features", "vec_id", 0.9)
    assert sorted(r.rid for r in got.collect()) == N.tolerance_kept(x, 0.9).tolist()


def test_tolerance_without_one_task(spark):
    df = frame(spark, np.concatenate([X, X]))
    kept = D.dedup_tolerance(df, "features", "vec_id", 0.05)
    assert "SinglePartition" not in kept._jdf.queryExecution().toString()
    assert sorted(r.vec_id for r in kept.collect()) == N.tolerance_kept(np.concatenate([X, X]), 0.05).tolist()
    assert D.dedup_tolerance(df.limit(0), "features", "vec_id", 0.05).count() == 0


def test_tolerance_keeps_in_order():
    r = np.random.default_rng(3)
    x = np.concatenate([r.random((700, 3)), r.random((20, 3)).repeat(5, 0)])
    kept = []
    for i, v in enumerate(x):
        if not kept or np.linalg.norm(x[kept] - v, axis=1).min() > 0.15:
            kept.append(i)
    state = N.Kept(0.15)
    got = np.concatenate([state.add(x[a : a + 90]) + a for a in range(0, len(x), 90)])
    assert got.tolist() == kept and N.tolerance_kept(x[400:], 0.15, x[[k for k in kept if k < 400]]).tolist() == [k - 400 for k in kept if k >= 400]


def test_knn_ties_and_small_banks(spark):
    bank = spark.createDataFrame([(7, [1.0, 0.0]), (3, [-1.0, 0.0])], "bank_id long, features array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, features array<double>")
    assert [(r.rank, r.bank_id) for r in J.knn_join(q, bank, 5).orderBy("rank").collect()] == [(1, 3), (2, 7)]
    assert {r.bank_id: r.self_distance for r in J.self_distance(bank).collect()} == {3: 2.0, 7: 2.0}
    assert J.self_distance(bank.limit(1)).collect() == []


def scores(spark, rows):
    return spark.createDataFrame([(i, p, float(s)) for i, r in enumerate(rows) for p, s in enumerate(r)], "image_idx long, patch_pos long, score double")


def image(df):
    return [r.score for r in df.orderBy("image_idx").collect()]


def test_reference_max(spark):
    assert image(C.image_max(scores(spark, [[0.1, 0.2, 0.4, 0.3], [1, 2, 0.5, 0.25]]))) == [0.4, 2.0]


def test_eq7(spark):
    s = scores(spark, [[0.1, 0.2, 0.4, 0.3], [1, 2, 0.5, 0.25]])
    knn = s.select("image_idx", "patch_pos", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("bank_id"), F.col("score").alias("sq_dist"))
    feats = s.select("image_idx", "patch_pos", F.array(F.col("patch_pos").cast("double"), F.col("image_idx").cast("double")).alias("features"))
    bank = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [9.0, 9.0])], "bank_id long, features array<double>")
    assert image(C.eq7_image(knn, feats, bank, 1)) == [0.4, 2.0]
    got = image(C.eq7_image(knn, feats, bank, 2))
    for i, (p, v) in enumerate([(2, 0.4), (1, 2.0)]):
        d = [p**2 + i**2, (p - 1) ** 2 + i**2]
        w = max(0.0, min(1.0, 1 - math.exp(v - max(d)) / sum(math.exp(x - max(d)) for x in d)))
        assert math.isclose(got[i], w * v) and got[i] <= v


def test_soft_and_mass_means(spark):
    s = scores(spark, [[4.0, 3.0, 2.0, 1.0], [-1.0, -2.0, -3.0, 0.0]])
    e = np.exp((np.array([4, 3]) - 4) / 0.5)
    assert math.isclose(image(C.top_k_soft(s, 2, 0.5))[0], (e * [4, 3]).sum() / e.sum())
    assert image(C.top_p_mean(s, 0.4, 32)) == [4.0, 0.0]
    assert image(C.top_p_mean(s, 0.41, 32))[0] == 3.5
    assert image(C.top_p_mean(s, 1.0, 3))[0] == 3.0


def test_neighbourhood(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (5, 5)], "row long, col long")
    got = {tuple(r) for r in J.grid_neighbours(cells, 3, True).collect()}
    assert got == {(0, 0, 0, 1), (0, 1, 0, 0), (5, 5, 5, 5)}


# --- metrics ------------------------------------------------------------------------------------


def labelled(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


def brute_auroc(y, s):
    p, n = s[y > 0], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=2, max_size=40).filter(lambda v: 0 < sum(a for a, _ in v) < len(v)))
def test_ranking_metrics(spark, rows):
    y, s = np.array([int(a) for a, _ in rows]), np.array([float(b) for _, b in rows])
    df = labelled(spark, y, s)
    assert math.isclose(M.auroc(df, "label", "score").first()[0], brute_auroc(y, s))
    assert math.isclose(M.auroc(df.withColumn("score", -F.col("score")), "label", "score").first()[0], 1 - brute_auroc(y, s), abs_tol=1e-12)
    ap, last, f1 = 0.0, 0.0, []
    for t in sorted(set(s), reverse=True):
        tp, n = ((s >= t) & (y > 0)).sum(), (s >= t).sum()
        ap += (tp / y.sum() - last) * tp / n
        last = tp / y.sum()
        f1.append((2 * tp / (n + y.sum()), t))
    assert math.isclose(M.average_precision(df, "label", "score").first()[0], ap)
    top = max(f for f, _ in f1)
    r = M.best_f1(df, "label", "score").first()
    assert math.isclose(r.f1, top) and r.threshold == max(t for f, t in f1 if f >= top - 1e-12)


def test_undefined_metrics(spark):
    one = labelled(spark, [1, 1], [0.1, 0.2])
    assert math.isnan(M.auroc(one, "label", "score").first()[0]) and math.isnan(M.average_precision(one, "label", "score").first()[0])
    c = M.confusion(labelled(spark, [0, 0], [0.1, 0.2]), "label", "score", 0.5).first()
    assert (c.precision, c.recall, c.f1, c.accuracy) == (0, 0, 0, 1) and c.balanced_accuracy == 0.5
    assert M.threshold_for(one.limit(0), "label", "score") == 0.5 == M.threshold_for(one, "label", "score", "fixed_0_5")
    assert math.isnan(M.aupro(M.image_cells(labelled(spark, [0, 0], [1, 2]), "label", "score")).first()[0])


def brute_aupro(maps, masks, max_fpr, steps):
    regions = [(i, N.regions(m) == k) for i, m in enumerate(masks) for k in range(1, N.regions(m).max() + 1)]
    points = []
    for i, t in enumerate(np.linspace(maps.max(), maps.min(), steps)):
        p = maps >= t
        points.append(((p & ~masks).sum() / (~masks).sum(), i, np.mean([(p[k] & r).sum() / r.sum() for k, r in regions])))
    points = sorted(x for x in points if x[0] <= max_fpr)
    f, o = np.array([x[0] for x in points]), np.maximum.accumulate([x[2] for x in points])
    if f[0] > 0:
        f, o = np.insert(f, 0, 0), np.insert(o, 0, o[0])
    if f[-1] < max_fpr:
        f, o = np.append(f, max_fpr), np.append(o, o[-1])
    return np.trapezoid(o, f) / max_fpr


@pytest.mark.parametrize("seed", range(3))
def test_aupro(spark, seed):
    r = np.random.default_rng(seed)
    maps = np.round(r.normal(size=(6, 8, 8)), 1)
    masks = r.random((6, 8, 8)) > 0.75
    df = spark.createDataFrame([(m.ravel().tolist(), k.ravel().astype(int).tolist()) for m, k in zip(maps, masks)], "map array<double>, mask array<int>")
    assert math.isclose(M.aupro(M.pixel_cells(df, "map", "mask", 8, 8), 0.4, 64).first()[0], brute_aupro(maps, masks, 0.4, 64), rel_tol=1e-9)


def test_regions_are_four_connected():
    m = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 0]], bool)
    assert N.regions(m).tolist() == [[1, 0, 2], [0, 2, 2], [3, 0, 0]]
    assert not N.regions(np.zeros((2, 2), bool)).any()


def test_calibration(spark):
    train, test = labelled(spark, [0] * 4, [1, 2, 2, 5]), labelled(spark, [0] * 4, [0, 2, 4, 9])
    x = np.array([1, 2, 2, 5.0])
    z = [r.calibrated for r in CA.zscore(test, train, "score").orderBy("score").collect()]
    assert np.allclose(z, (np.array([0, 2, 4, 9]) - x.mean()) / x.std())
    assert [r.calibrated for r in CA.ecdf(test, train, "score").orderBy("score").collect()] == [0, 0.75, 0.75, 1]
    with pytest.raises(ValueError):
        CA.check_mode("ecdf", "STREAMING")


def test_mean_row_skips_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", float("nan"), 4)], "dataset string, m double, n long")
    r = M.with_mean(df, "dataset").where("dataset = 'MEAN'").first()
    assert (r.m, r.n) == (1.0, 3.0)


# --- grids and expressions ------------------------------------------------------------------------


def test_resize_and_smooth():
    g = np.arange(4.0).reshape(2, 2)
    assert np.allclose(N.smooth_resize(g, (4, 4), 0)[0], [0, 0.25, 0.75, 1])
    w = N.gaussian_weights(8, 1.0)
    assert np.allclose(w.sum(1), 1)
    assert np.allclose(N.smooth_resize(np.ones((3, 3)), (5, 5), 4.0), 1)


def test_patchify_and_pool(spark):
    df = spark.createDataFrame([(0, [float(v) for v in range(16)])], "id long, map array<double>")
    rows = G.patchify(df, "map", 4, 4, 3, 2).orderBy("row", "col").collect()
    assert len(rows) == 4 and rows[0].patch == [0, 0, 0, 0, 0, 1, 0, 4, 5]
    got = df.select(V.adaptive_pool(F.col("map"), 16, 5).alias("p")).first().p
    assert np.allclose(got, N.adaptive_mean(np.arange(16.0), 5))


@pytest.mark.parametrize("dim", [2, 3, 6, 7])
def test_chi2_tail(spark, dim):
    xs = [0.0, 0.5, 3.0, 12.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.chi2_sf(F.col("x"), dim).alias("p")).orderBy("x").collect()]
    h = np.linspace(0, 400, 4_000_001)
    pdf = h ** (dim / 2 - 1) * np.exp(-h / 2) / (2 ** (dim / 2) * math.gamma(dim / 2)) if dim > 1 else None
    want = [np.trapezoid(pdf[h >= x], h[h >= x]) for x in xs]
    assert np.allclose(got, want, atol=1e-4)


def test_finite_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],)], "v array<double>")
    with pytest.raises(ValueError, match="1 rows"):
        V.require_finite(df, "v")
    assert V.vector_dim(df, "v") == 2
