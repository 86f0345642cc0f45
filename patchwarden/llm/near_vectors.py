"""Near-duplicate vectors of equal label by a robust-pruned flat graph.

1. Equal vectors of a label are one node, found by an aggregate with map-side combine, so exact copies cost nothing below.
2. Labels of more than SHARD nodes are cut into clusters, the clusters into clusters again, until each shard has SHARD nodes at most. Centers are fitted
   on some SAMPLE nodes of a cluster; every node goes to its OVERLAP nearest centers, so shards overlap (two at the second cut, one at further ones: a node has
   2 * OVERLAP copies at most).
   A cluster's nodes are dealt over as many tasks as it has SHARDs, whatever their share of the rows.
3. Each shard builds a graph: a node's POOL nearest are pruned robustly (a candidate goes if an edge that stays is nearer to it
   by ALPHA than the node is), some far nodes are added so that tight groups can be entered and left, and edges get their reverse.
4. The adjacency lists that a node has from its shards are united: one flat graph.
5. All nodes are searched in all their shards: a greedy search with a beam starts at the shard's medoid and at the node itself; where it finds
   something in range, the range is expanded: all neighbours of what is in range, or nearly, are visited until nothing new is in range.
   What is found is verified in double precision, both ways. A pair is counted in the first shard that both have, so pairs
   never leave their task: a shard returns a number for each node and a forest of its links.
6. The recall is audited: AUDIT nodes, half of them with links, are compared with all nodes. Below RECALL shards
   overlap more and beams are wider; if that does not help, all blocks of a label are compared with each other.

Defined results: a null label, a null, empty or zero vector and one with null or non-finite components links with nothing, its row is a component of
its own; vectors of different lengths do not link; rows with null or equal vec_ids are rows like others, a null one names no
component if another row does; an empty table gives an empty result; other columns are left out. Nodes and shards are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K
from ._shared import _contract, components, join_hot, materialize

COSINE = 0.93
#: vectors of a shard, and clusters of a shard that is cut
SHARD, CLUSTERS = 4096, 256
#: vectors of a cluster that its centers are fitted on
SAMPLE = 4096
OVERLAP, DEGREE, FAR, POOL, ALPHA, BEAM = 2, 20, 4, 48, 1.2, 16
#: how far out of range (in cosine) the expansion of a range still goes on
SLACK = 0.05
AUDIT, RECALL = 512, 0.98
#: nodes of a packed block of the exact way
BLOCK = 1024


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, vec): the vector in doubles and with length 1, null where it links with nothing."""
    for b in batches:
        out = []
        for x in b.column(1).to_pylist():
            v = np.array(x if x is not None and None not in x else [], np.float64)
            top = np.abs(v).max() if len(v) else 0.0
            if np.isfinite(top) and top > 0:  # scaled first: squares of large and small numbers stay finite
                v = v / top
                out.append((v / np.sqrt(v @ v) + 0.0).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1 + 1), pa.array(out, pa.binary())], names=["vec_id", "label_hash", "vec"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _fit(seed: int, clusters: int, limit: int, overlap: int):
    """A sample of a cluster's vectors to its new centers: k-means on the sphere, started from vectors far from each other."""

    def fit(t: pa.Table) -> pa.Table:
        by = np.argsort(t.column("node").to_numpy())
        x = _matrix(t.column("vec"))[by]
        n = t.column("n")[0].as_py()
        k = min(max(-(-2 * overlap * n // limit), 2 * overlap), clusters, len(x))
        rng = np.random.default_rng(seed)
        at = [int(rng.integers(len(x)))]
        near = x @ x[at[0]]
        for _ in range(k - 1):
            p = np.maximum(1 - near, 0)
            at.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x))))
            near = np.maximum(near, x @ x[at[-1]])
        c = x[at].copy()
        for _ in range(8):
            own = np.argmax(x @ c.T, 1)
            for j in range(k):
                s = x[own == j].sum(0)
                if (size := np.sqrt(s @ s)) > 1e-9:
                    c[j] = s / size
        return pa.table({"shard": t.column("shard").slice(0, 1), "centers": pa.array([c.tobytes()], pa.binary())})

    return fit


def _assign(overlap: int):
    """Vectors of a part of a cluster and its centers to (node, cluster, vec): the nearest ``overlap`` centers of each."""

    def assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x = _matrix(left.column("vec")) if left.num_rows else np.zeros((0, 1))
        if not right.num_rows or not left.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "vec": pa.array([], pa.binary())})
        c = np.frombuffer(right.column("centers")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        m = min(overlap, len(c))
        near = np.argpartition(-(x @ c.T), m - 1, 1)[:, :m]
        rows = np.repeat(np.arange(len(x)), m)
        take = left.take(pa.array(rows))
        return pa.table({"node": take.column("node"), "shard": take.column("shard"), "part": pa.array(near.ravel().astype(np.int32)), "vec": take.column("vec")})

    return assign


def shards(nodes: DataFrame, overlap: int = OVERLAP, limit: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """nodes (node, grp, vec) to (node, shard, vec): overlapping clusters of each group, of ``limit`` nodes at most."""
    done = None
    left = nodes.select("node", F.col("grp").alias("shard"), "vec")
    r = 0
    while True:
        share = (overlap, min(overlap, 2))[r] if r < 2 else 1
        sizes = materialize(left.groupBy("shard").agg(F.count("*").alias("w")).withColumn("n", F.col("w")), "vectors-sizes", True)
        sized = join_hot(left, sizes, "shard", "w")
        small = sized.where(F.col("n") <= limit).select("node", "shard", "vec")
        done = small if done is None else done.unionByName(small)
        if not sizes.where(F.col("n") > limit).limit(1).count():
            return done
        big = materialize(sized.where(F.col("n") > limit), "vectors-big")
        chosen = big.where(F.expr(f"pmod(xxhash64(node, {r}), n) < {sample}"))
        centers = materialize(chosen.groupBy("shard").applyInArrow(_fit(r, CLUSTERS, limit, share), "shard long, centers binary"), "vectors-centers", True)
        salts = F.expr(f"int((n + {limit - 1}) div {limit})")
        dealt = big.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
        copies = sizes.where(F.col("n") > limit).join(centers, "shard").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "centers")
        cut = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_assign(share), "node long, shard long, part int, vec binary")
        left = materialize(cut.select("node", F.xxhash64("shard", "part").alias("shard"), "vec"), "vectors-cut")
        r += 1


def _pruned(x: np.ndarray, rows: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: of each row's pool of places, sorted by distance, those that stay (-1 behind them)."""
    q, c = x[rows], x[pool]
    to_q = np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bpd->bp", q, c), 0))
    between = alpha * np.sqrt(np.maximum(2 - 2 * np.matmul(c, c.transpose(0, 2, 1)), 0))
    alive = pool != rows[:, None]
    out = np.full((len(rows), degree), -1, np.int64)
    every = np.arange(len(rows))
    for k in range(degree):
        pick = np.argmax(alive, 1)
        ok = alive[every, pick]
        if not ok.any():
            break
        out[ok, k] = pool[every, pick][ok]
        alive &= ~ok[:, None] | (between[every, pick] > to_q)
        alive[every, pick] = False
    return out


def shard_graph(x: np.ndarray, seed: int, degree: int = DEGREE, pool: int = POOL) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a shard's graph over the rows of x, both ways."""
    n = len(x)
    x = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    heads, tails = [], []
    m = min(pool + 1, n)
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        s = x[rows] @ x.T
        near = np.argpartition(-s, m - 1, 1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1, kind="stable"), 1)
        kept = np.concatenate([_pruned(x, rows, near, degree, ALPHA), rng.integers(0, n, (len(rows), FAR))], 1)
        ok = (kept >= 0) & (kept != rows[:, None])
        heads.append(np.repeat(rows, ok.sum(1)))
        tails.append(kept[ok])
    a, b = np.concatenate(heads), np.concatenate(tails)
    # reverse edges, the nearest first
    sim = np.einsum("ed,ed->e", x[a], x[b]) if len(a) < 1 << 18 else np.concatenate([np.einsum("ed,ed->e", x[a[i : i + (1 << 18)]], x[b[i : i + (1 << 18)]]) for i in range(0, len(a), 1 << 18)])
    far = rng.random(len(a)) < FAR / (degree + FAR)  # some of them whatever their distance
    by = np.lexsort((np.where(far, -2, -sim), b))
    place = np.arange(len(b)) - np.searchsorted(b[by], b[by])
    by = by[place < degree + FAR]
    edges = np.unique(np.concatenate([a * n + b, b[by] * n + a[by]]))
    return edges // n, edges % n


def _build(degree: int, pool: int):
    """A shard's vectors to (node, shard, vec, neighbours)."""

    def build(t: pa.Table) -> pa.Table:
        by = np.argsort(t.column("node").to_numpy(), kind="stable")
        node = t.column("node").to_numpy()[by]
        by = by[np.concatenate([[True], node[1:] != node[:-1]])]
        t = t.take(pa.array(by))
        node = t.column("node").to_numpy()
        a, b = shard_graph(_matrix(t.column("vec")), len(node), degree, pool)
        ends = np.searchsorted(a, np.arange(len(node) + 1))
        K.release()
        return pa.table({"node": t.column("node"), "shard": t.column("shard"), "vec": t.column("vec"), "near": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(node[b]))})

    return build


def greedy(x: np.ndarray, near: np.ndarray, query: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for some rows of x, all together: (places in the beam, their cosines; -1 and -2 where it is not full). near: neighbours of
    each place, the place itself where there are fewer. start: places to start from."""
    n, q = len(x), len(query)
    every = np.arange(q)[:, None]
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -2, np.float32)
    opened = np.ones((q, beam), bool)
    fresh = np.concatenate([np.repeat(start[None, :], q, 0), query[:, None]], 1)
    while True:
        first = np.ones(fresh.shape, bool)
        order = np.argsort(fresh, 1, kind="stable")
        sorted_ = np.take_along_axis(fresh, order, 1)
        first[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        new = first & ~seen[every, sorted_]
        seen[every, sorted_] = True
        s = np.where(new, np.matmul(x[sorted_], x[query][:, :, None])[:, :, 0], -2).astype(np.float32)
        ids, sims, opened = (np.concatenate(v, 1) for v in ((ids, np.where(new, sorted_, -1)), (sims, s), (opened, ~new)))
        top = np.argpartition(-sims, beam - 1, 1)[:, :beam]
        ids, sims, opened = (np.take_along_axis(v, top, 1) for v in (ids, sims, opened))
        best = np.argmax(np.where(opened, -3, sims), 1)[:, None]
        todo = ~opened[every, best][:, 0]
        if not todo.any():
            return ids, sims
        opened[every, best] = True
        fresh = np.where(todo[:, None], near[ids[every, best][:, 0]], query[:, None])


def expanded(x: np.ndarray, near: np.ndarray, query: int, seeds: np.ndarray, cosine: float) -> np.ndarray:
    """Places in range of a query that are connected with the seeds over places in range, or within SLACK of it."""
    seen = np.zeros(len(x), bool)
    seen[seeds] = True
    front, found = seeds, [seeds]
    while len(front):
        reach = near[front].ravel()
        reach = np.unique(reach[~seen[reach]])
        seen[reach] = True
        front = reach[x[reach] @ x[query] >= cosine - SLACK]
        found.append(front)
    out = np.concatenate(found)
    return out[x[out] @ x[query] >= cosine - 1e-4]


def shard_links(x: np.ndarray, near: np.ndarray, cosine: float, beam: int) -> list[np.ndarray]:
    """For each row of x the other rows with at least this cosine that the search finds, verified in double precision, both ways."""
    n = len(x)
    small = x.astype(np.float32)
    medoid = np.array([int(np.argmax(small @ small.mean(0)))])
    heads, tails = [], []
    for lo in range(0, n, 256):
        query = np.arange(lo, min(lo + 256, n))
        ids, sims = greedy(small, near, query, medoid, beam)
        for k in np.flatnonzero(((sims >= cosine - SLACK) & (ids != query[:, None])).any(1)).tolist():
            got = expanded(small, near, int(query[k]), ids[k][(sims[k] >= cosine - SLACK) & (ids[k] >= 0)], cosine)
            got = got[got != query[k]]
            got = got[x[got] @ x[query[k]] >= cosine]
            heads.append(np.full(len(got), query[k]))
            tails.append(got)
    if not heads:
        return [np.zeros(0, np.int64)] * n
    a, b = np.concatenate(heads), np.concatenate(tails)
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


_FOUND = "node long, links long, u long, v long"


def _found(node: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    forest = _contract(a, b)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table({
        "node": pa.chunked_array([pa.array(node), none(len(forest))]), "links": pa.chunked_array([pa.array(count.astype(np.int64)), none(len(forest))]),
        "u": pa.chunked_array([none(len(node)), forest.column(0)]), "v": pa.chunked_array([none(len(node)), forest.column(1)]),
    })


def _search(cosine: float, beam: int):
    """A shard's nodes (node, shard, vec, m, near, shards) to each node's number of linked rows in pairs whose first common shard this is, and to
    a forest of the links."""

    def search(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        node, m, x = t.column("node").to_numpy(), t.column("m").to_numpy(), _matrix(t.column("vec"))
        n, shard = len(node), t.column("shard")[0].as_py()
        lists = t.column("near").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(node, flat), n - 1)
        ok = node[at] == flat  # neighbours of other shards are left out
        row = np.repeat(np.arange(n), np.diff(ends))[ok]
        width = np.bincount(row, minlength=n)
        near = np.repeat(np.arange(n)[:, None], max(int(width.max()), 1), 1)
        near[row, np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = at[ok]
        links = shard_links(x, near, cosine, beam)
        own = t.column("shards").combine_chunks()
        where = np.repeat(np.arange(n), own.value_lengths().to_numpy())
        values, code = np.unique(own.flatten().to_numpy(), return_inverse=True)
        member = np.zeros((n, len(values)), bool)
        member[where, code] = True
        here = int(np.searchsorted(values, shard))
        count = np.zeros(n, np.int64)
        for k, got in enumerate(links):
            if len(got):
                first = ~(member[got, :here] & member[k, :here]).any(1) if here else np.ones(len(got), bool)
                count[k] = m[got[first]].sum()
        a = np.repeat(np.arange(n), [len(g) for g in links])
        b = np.concatenate(links) if n else a
        K.release()
        return _found(node, count, node[a[a < b]], node[b[a < b]])

    return search


def graph_links(nodes: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, beam: int = BEAM, limit: int = SHARD) -> DataFrame:
    """nodes (node, grp, vec, m) to rows (node, links) to be added up and rows (u, v): edges of the links' components."""
    placed = shards(nodes, overlap, limit)
    built = materialize(placed.groupBy("shard").applyInArrow(_build(DEGREE, POOL * (beam // BEAM)), "node long, shard long, vec binary, near array<long>"), "vectors-built")
    flat = built.groupBy("node").agg(F.first("vec").alias("vec"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set("shard").alias("shards"))
    flat = materialize(flat.join(nodes.select("node", "m"), "node").select("*", F.explode("shards").alias("shard")), "vectors-graph")
    return materialize(flat.groupBy("shard").applyInArrow(_search(cosine, beam), _FOUND), "vectors-found")


# --- the exact way --------------------------------------------------------------------------


def _pack(t: pa.Table) -> pa.Table:
    one = lambda x: pa.array([x], pa.binary())
    return pa.table({"grp": t.column("grp").slice(0, 1), "blk": t.column("blk").slice(0, 1), "ids": one(t.column("node").to_numpy().tobytes()), "ms": one(t.column("m").to_numpy().astype("<i8").tobytes()), "vecs": one(b"".join(t.column("vec").to_pylist()))})


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, *r in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ms, ids2, ms2 = (np.frombuffer(v, "<i8") for v in (r[0], r[1], r[3], r[4]))
                x, y = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((r[2], ids), (r[5], ids2)))
                hit = x @ y.T >= cosine
                if same:
                    np.fill_diagonal(hit, False)
                a, b = np.nonzero(hit)
                yield from _found(np.concatenate([ids, ids2]) if not same else ids, np.concatenate([hit @ ms2, hit.T @ ms]) if not same else hit @ ms2, ids[a], ids2[b]).combine_chunks().to_batches()

    return compare


def all_links(nodes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """graph_links' rows by comparing all blocks of a group with each other."""
    sizes = materialize(nodes.groupBy("grp").agg(F.count("*").alias("w")).withColumn("n", F.col("w")), "vectors-groups", True)
    blk = F.pmod(F.xxhash64("node"), F.expr(f"(n + {block - 1}) div {block}")).cast("long").alias("blk")
    packed = join_hot(nodes, sizes, "grp", "w").select("grp", blk, "node", "m", "vec").groupBy("grp", "blk").applyInArrow(_pack, "grp long, blk long, ids binary, ms binary, vecs binary")
    packed = materialize(packed, "vectors-packed")
    other = packed.select("grp", *(F.col(c).alias(f"{c}2") for c in ("blk", "ids", "ms", "vecs")))
    pairs = packed.join(other, "grp").where("blk <= blk2").select((F.col("blk") == F.col("blk2")).alias("same"), "ids", "ms", "vecs", "ids2", "ms2", "vecs2")
    return materialize(pairs.mapInArrow(_compare(cosine), _FOUND), "vectors-found")


def recall(nodes: DataFrame, links: DataFrame, cosine: float = COSINE, audit: int = AUDIT) -> float:
    """The part of the links of ``audit`` nodes, half of them with links, that is found: links (node, links) against all nodes."""
    spark = nodes.sparkSession
    order = F.xxhash64("node", F.lit(11))
    linked = links.where("links > 0").select("node", "links").orderBy(order).limit(audit // 2)
    some = links.select("node", "links").orderBy(order).limit(audit // 2)
    chosen = nodes.join(F.broadcast(linked.union(some).distinct()), "node").select("node", "grp", "vec", "links").toArrow()  # ``audit`` rows at most
    if not chosen.num_rows:
        return 1.0
    group, vec, ids = chosen.column("grp").to_numpy(), chosen.column("vec").to_pylist(), chosen.column("node").to_numpy()
    sent = spark.sparkContext.broadcast((group, vec, ids))

    def true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vec, ids = sent.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            node, grp, m = (b.column(c).to_numpy() for c in (0, 1, 2))
            for g in np.intersect1d(grp, group).tolist():
                at, own = np.flatnonzero(grp == g), np.flatnonzero(group == g)
                hit = np.frombuffer(b"".join([vec[k] for k in own]), np.float64).reshape(len(own), -1) @ _matrix(b.column(3).take(pa.array(at))).T >= cosine
                total[own] += (hit & (ids[own][:, None] != node[at])) @ m[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(total)], names=["k", "n"])

    true = nodes.select("node", "grp", "m", "vec").mapInArrow(true_links, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    want = np.zeros(chosen.num_rows, np.int64)
    want[true.column("k").to_numpy()] = true.column("n").to_numpy()
    got = np.minimum(chosen.column("links").to_numpy(), want)
    return float(got.sum() / want.sum()) if want.sum() else 1.0


def near_vectors(vectors: DataFrame, cosine: float = COSINE, limit: int = SHARD, target: float = RECALL) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding, label): vec_id, n_links (other rows of its label with at least this cosine), component_id (the
    smallest vec_id reachable by links, itself included) and kept (whether that is its own)."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label_hash"))
    rows = raw.mapInArrow(_vectors, "vec_id long, label_hash long, vec binary")
    grp = F.xxhash64("label_hash", F.octet_length("vec"))
    rows = materialize(rows.select("vec_id", F.when(F.col("label_hash").isNotNull() & F.col("vec").isNotNull(), F.xxhash64(grp, "vec")).alias("node"), grp.alias("grp"), "vec"), "vectors-rows")
    nodes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("m")), "vectors-nodes")
    for found in (lambda: graph_links(nodes, cosine, limit=limit), lambda: graph_links(nodes, cosine, 2 * OVERLAP, 4 * BEAM, limit), lambda: all_links(nodes, cosine)):
        out = found()
        links = materialize(out.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links")), "vectors-links", True)
        if recall(nodes, links, cosine) >= target:
            break
    comp, _ = components(out.where("u IS NOT NULL").select("u", "v"), "vectors")
    named = materialize(nodes.select("node", "least", "m").join(links, "node", "left").join(comp, "node", "left").select("node", "least", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp")), "vectors-named", True)
    first = materialize(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("w")), "vectors-least", True)
    labels = join_hot(named, first, "comp", "w").select("node", (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id", F.col("m").alias("w"))
    out = join_hot(rows.select("vec_id", "node"), materialize(labels, "vectors-labels", True), "node", "w", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
