"""Near-duplicate vectors against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import types as T

from patchwarden.llm import near_vectors as N
from patchwarden.llm import queries

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType()), T.StructField("node", T.LongType())])


def vectors():
    """Copies, near copies in groups of two to hundreds, chains of links, scaled copies, lone vectors, and every odd case."""
    r = np.random.default_rng(3)
    rows = []

    def add(v, label):
        rows.append((len(rows) * 3 + 1, None if v is None else [None if x is None else float(x) for x in v], label))

    for label in (0, 1):
        for _ in range(300):
            add(r.normal(size=16), label)
        for size in (2, 3, 10, 60, 250):
            c = r.normal(size=16)
            for _ in range(size):
                add(c + 0.12 * r.normal(size=16), label)
    c, d = np.eye(16)[0], np.eye(16)[1]
    for k in range(12):  # a chain: only neighbours link
        add(np.cos(k * 0.3) * c + np.sin(k * 0.3) * d, 2)
    v = r.normal(size=16)
    for label in (3, 3, 3, 4, None, None):
        add(v, label)
    for x in (v * 2, v * 1e200, v * 1e-200, [*v[:-1], None], [*v[:-1], float("nan")], [*v[:-1], float("inf")], np.zeros(16), [], None, v[:8], v[:8]):
        add(x, 3)
    rows += [(None, rows[0][1], 0), (rows[1][0], rows[0][1], 0), (None, None, 5), (None, list(map(float, range(1, 17))), 6), (None, list(map(float, range(1, 17))), 6)]
    return [(*x, "x", 7) for x in rows]


def brute(rows, cosine=N.COSINE):
    """Counts and components by comparing all rows."""
    unit = []
    for _, v, label, *_ in rows:
        ok = v and None not in v and label is not None and np.isfinite(v).all() and np.any(v)
        unit.append((np.array(v) / np.abs(v).max()) / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), comp, None if comp is None or rows[i][0] is None else rows[i][0] == comp))
    return collections.Counter(out)


@pytest.mark.parametrize("limit", [4096, 250])
def test_near_vectors(spark, limit):
    rows = vectors()
    got = N.near_vectors(spark.createDataFrame(rows, ROWS).repartition(4), limit=limit, target=1.0)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)


def nodes_of(spark, rows):
    unit = [(k, 0, (np.array(v) / np.linalg.norm(v)).tobytes(), 1) for k, (_, v, label, *_) in enumerate(rows) if label == 0]
    return spark.createDataFrame(unit, "node long, grp long, vec binary, m long")


def totals(found):
    return {r[0]: r[1] for r in found.where("node IS NOT NULL").groupBy("node").sum("links").collect()}


def test_graph_and_exact_way(spark, monkeypatch):
    """The graph alone, cut into small overlapping shards, finds nearly all links, none that is not one, and its recall is audited."""
    nodes = nodes_of(spark, [x for x in vectors() if x[1] and None not in x[1] and len(x[1]) == 16]).cache()
    exact = N.all_links(nodes, block=100)
    want = totals(exact)
    assert totals(N.all_links(nodes, block=100000)) == want
    monkeypatch.setattr(N, "CLUSTERS", 6)  # more than one level of clusters
    for limit, least in ((100000, 0.99), (400, 0.9), (100, 0.4)):  # shards below a group of near copies lose links of it
        out = N.graph_links(nodes, limit=limit)
        got = totals(out)
        assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
        part = sum(got.values()) / sum(want.values())
        assert part >= least
        links = out.where("node IS NOT NULL").groupBy("node").sum("links").toDF("node", "links")
        assert N.recall(nodes, links, audit=10000) == pytest.approx(part)
    assert N.recall(nodes, nodes.selectExpr("node", "0L AS links")) == 0.0


def test_low_recall_widens_the_search(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(N, "recall", lambda *a: calls.append(1) or 0.0)
    rows = [x for x in vectors() if x[2] in (2, 3)]
    assert collections.Counter(map(tuple, N.near_vectors(spark.createDataFrame(rows, ROWS)).collect())) == brute(rows)
    assert len(calls) == 3


def test_pruning_keeps_what_no_edge_covers():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), 1)[:, :30]
    out = N._pruned(x, np.arange(80), near, 12, 1.2)
    dist = lambda a, b: float(np.sqrt(max(2 - 2 * x[a] @ x[b], 0)))
    for q in range(80):
        kept = []
        for c in near[q].tolist():
            if c != q and len(kept) < 12 and all(1.2 * dist(p, c) > dist(q, c) for p in kept):
                kept.append(c)
        assert [k for k in out[q].tolist() if k >= 0] == kept


def test_greedy_search_finds_the_nearest():
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = N.shard_graph(x, 1)
    near = np.repeat(np.arange(1500)[:, None], np.bincount(a).max(), 1)
    near[a, np.arange(len(a)) - np.searchsorted(a, a)] = b
    small = x.astype(np.float32)
    ids, sims = N.greedy(small, near, np.arange(200), np.array([0]), 16)
    best = np.argsort(-(x[:200] @ x.T), 1)[:, :8]
    assert np.mean([len(set(i.tolist()) & set(j.tolist())) / 8 for i, j in zip(ids, best)]) > 0.9
    assert np.allclose(np.take_along_axis(small[:200] @ small.T, ids, 1), sims, atol=1e-5)


def test_op11_query(spark, tmp_path):
    rows = vectors()[:400]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collections.Counter(map(tuple, queries.op11_embedding_dedup(spark, str(tmp_path)).collect())) == brute(rows)
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op11_embedding_dedup(spark, f"{tmp_path}/none").count() == 0
