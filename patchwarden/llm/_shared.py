"""Scratch tables in the cluster's shared folder, and distributed connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder
from . import _text as K


#: rows that go to a Python worker at once; texts are long, and Spark's default of 10,000 is not meant for them
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has not bounded them itself: both the JVM and the worker
    hold a batch as a whole, beside what they make of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. small: a table much smaller than what it is made from is
    dealt anew after the work, into as many partitions as its size asks for, so no file is tiny and the work
    keeps its own partitions."""
    spark = df.sparkSession
    small_batches(spark)
    if small:
        df = df.hint("rebalance")
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str = "text") -> tuple[Column, Column]:
    """A 128-bit hash of the text: with it doc_id names a row where doc_ids are null or repeated."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: a key is hot from 1 / HOT of all rows, so there are HOT hot keys at most
HOT = 1 << 16


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """left joined with right, which has one row of a few values a key and tells in ``weight`` how many rows of left the key
    has. The rows of a hot key stay where they are, as its row of right is broadcast; the others are
    shuffled. So no key brings its rows together in one task. Both are written tables, as they are read
    more than once; the weight is left out. most: another bound than HOT, for rows that hold texts."""
    most = most or HOT
    keys = [key] if isinstance(key, str) else key
    n, total = right.agg(F.count("*"), F.sum(weight)).first()
    if n <= most:
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    hot = F.col(weight) >= -(-total // most)
    few, rest = right.where(hot).drop(weight), right.where(~hot).drop(weight)
    others = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return left.join(F.broadcast(few), keys).unionByName(others)


MAX_BITMAP = 29


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap's size for n hashes: 32 slots each, within fixed bounds."""
    return max(16, min(MAX_BITMAP, (32 * max(n, 1)).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A one-hash Bloom filter of the long column, 2**bits slots (64 MB at most, whatever the
    input): made in segments on the executors. It only thins rows before an exact join; with more hashes than
    slots it lets all of them pass."""
    return bitmaps(hashes.select(hashes.columns[0]), bits)[0]


def bitmaps(hashes: DataFrame, bits: int) -> tuple[bytes, ...]:
    """A bitmap of the long column, and one of its rows that each of the further columns is true for, in one pass."""
    size = 1 << 16
    flags = hashes.columns[1:]
    names = ["bits", *(f"bits_{k}" for k in range(len(flags)))]

    def segment(t: pa.Table) -> pa.Table:
        slot, out = t.column("slot").to_numpy() % size, {"seg": pa.array([t.column("seg")[0].as_py()], pa.int64())}
        for n, f in zip(names, [None, *flags]):
            x = np.zeros(size, bool)
            x[slot if f is None else slot[t.column(f).to_numpy()]] = True
            out[n] = pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())
        return pa.table(out)

    slots = hashes.groupBy(F.pmod(hashes.columns[0], F.lit(1 << bits)).alias("slot")).agg(F.lit(True).alias("in"), *(F.max(f).alias(f) for f in flags)).drop("in").withColumn("seg", F.expr(f"slot div {size}"))
    out = tuple(bytearray((1 << bits) // 8) for _ in names)
    for r in slots.groupBy("seg").applyInArrow(segment, "seg long, " + ", ".join(f"{n} binary" for n in names)).collect():
        for x, n in zip(out, names):
            x[r.seg * size // 8 : (r.seg + 1) * size // 8] = r[n]
    return tuple(map(bytes, out))


def in_bitmap(table: bytes, bits: int):
    """A test of int64 hashes against a bitmap."""
    t = np.frombuffer(table, np.uint8)

    def test(h: np.ndarray) -> np.ndarray:
        slot = h & ((1 << bits) - 1)
        return (t[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    return test


# --- connected components -----------------------------------------------------------------


#: edges that one task may contract: 16 MB
LOCAL_EDGES = 1 << 20


def _contract(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Union-find: the same connections with at most one edge a node, from each to the smallest
    node of its component."""
    nodes, x = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    a, c = x[: len(u)], x[len(u) :]
    while True:  # min-label hooking with pointer jumping
        ra, rc = parent[a], parent[c]
        lo, hi = np.minimum(ra, rc), np.maximum(ra, rc)
        if (lo == hi).all():
            break
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[child], pa.int64()), pa.array(nodes[parent[child]], pa.int64())], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _contract(b.column(0).to_numpy(), b.column(1).to_numpy())


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of the only partition together."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        yield _contract(*(np.concatenate(x) for x in zip(*parts)))


def components(edges: DataFrame, name: str, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, int]:
    """(node, comp) of every node but the smallest of its component, comp being that smallest node;
    and a number of edges that is at least the number of these rows.

    Distributed union-find over edges of two long columns. Edges are contracted inside each
    partition to a forest. A forest of up to local_edges edges (counted first) is contracted by
    one task. A larger one goes through alternating large-star and small-star rounds, whose
    number grows with the logarithm of a component's diameter; a star's edges are spread over tasks, and every
    step is a written table, so a lost executor costs one step's tasks. Nothing but counts and checksums reaches the driver.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long")
    e, state = _observed(e, f"{name}-forest")
    if state[0] <= local_edges:
        return e.repartition(1).mapInArrow(_one_forest, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("comp")), state[0]
    # edges always point from the larger node u to the smaller node v
    while True:
        both = e.union(e.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("w")), f"{name}-low")
        large = materialize(join_hot(both, low, "u", "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")), f"{name}-least")
        small = join_hot(large, least, "u", "w").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before = state
        e, state = _observed(small, f"{name}-round")
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")), state[0]


def _observed(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """e materialized, with its number of edges and two checksums, which come with the write."""
    seen = Observation()
    out = materialize(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")), name, True)
    got = seen.get
    return out, (got["n"], got["s"], got["x"])


# --- links between sets -------------------------------------------------------------------

BLOCK = 512
#: bytes of payloads whose sets a task keeps at hand
KNOWN_BYTES = 1 << 19
#: members of a posting list that meet each other by a join; longer lists go through blocks
LIST = 64


def _hub_pairs(members: DataFrame, name: str, percent: int = 0) -> DataFrame:
    """members (tok, node, n, comp, o) to pairs (a, b) of each member of a list with the list's first by o, unless they
    are of one component or of sizes that cannot reach the threshold. The first ones come from an aggregate, and a long list's members stay where they are."""
    first = members.groupBy("tok").agg(F.min(F.struct("o", "node", "comp", "n")).alias("h"), F.count("*").alias("w")).where("w > 1")
    first = materialize(first.select("tok", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp"), F.col("h.n").alias("hub_n"), "w"), f"{name}-first", True)
    met = join_hot(members, first, "tok", "w").where((F.col("comp") != F.col("hub_comp")) & sizes_fit("n", "hub_n", percent))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def longs(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, elements one after another) of sets of packed longs."""
    return np.array([len(x) // 8 for x in payloads], np.int64), np.frombuffer(b"".join(payloads), "<i8")


class Kind(NamedTuple):
    """How payloads are read: many of them as (sizes, distinct longs one after another), one of them as a set, and how
    many elements two such sets share."""

    many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    one: Callable[[bytes], Any]
    common: Callable[[Any, Any], int]
    #: bytes of a bitmap of the elements' hashes in front of each payload, 0 without one
    bitmap: int = 0


def _common_longs(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


LONGS = Kind(longs, lambda b: np.frombuffer(b, "<i8"), _common_longs)


def _may_reach(b: pa.RecordBatch, percent: int, size: int) -> np.ndarray:
    """Whether pairs can reach the threshold: a bit of one bitmap that the other has not is an element that is not
    shared, so what is left bounds the intersection. No pair that reaches it is lost."""
    bits = []
    for c in (4, 5):
        x = b.column(c)
        _, offsets, data = x.buffers()
        start = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x)]
        bits.append(np.frombuffer(data, np.uint8)[start[:, None] + np.arange(size)].view("<u8"))
    n = [b.column(c).to_numpy() for c in (2, 3)]
    left = [n[k] - np.bitwise_count(bits[k] & ~bits[1 - k]).sum(1, dtype=np.int64) for k in (0, 1)]
    common = np.minimum(*left)
    return 100 * common >= percent * (n[0] + n[1] - common)


def _verify_pairs(percent: int, kind: Kind):
    """(a, b, sizes and payloads of both) to the pairs (a, b) that reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Any] = {}  # sets stand in several pairs, a hub's in many
        held = 0

        def read(x: bytes) -> Any:
            nonlocal held
            got = known.get(x)
            if got is None:
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
                held += len(x)
                got = known[x] = kind.one(x)
            return got

        for b in batches:
            n_a, n_b, one, two = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4), b.column(5)
            if kind.bitmap and b.num_rows:
                left = pa.array(_may_reach(b, percent, kind.bitmap))
                b = b.filter(left)
                n_a, n_b, one, two = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(5).to_pylist()
                common = _common_counts(one, two, kind)
                over = 100 * common - percent * (n_a + n_b - common)
                keep = over >= 0
                for i in np.flatnonzero(np.abs(over) <= 300).tolist():  # hashes could decide: these are compared as they are
                    c = kind.common(read(one[i]), read(two[i]))
                    keep[i] = 100 * c >= percent * (n_a[i] + n_b[i] - c)
                at = pa.array(np.flatnonzero(keep))
            else:
                common = np.array([kind.common(read(x), read(y)) for x, y in zip(one.to_pylist(), two.to_pylist())], np.int64)
                at = pa.array(np.flatnonzero(100 * common >= percent * (n_a + n_b - common)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return verify


#: elements of sets that are compared at a time
COMPARED = 1 << 17


def _common_counts(one: list[bytes], two: list[bytes], kind: Kind) -> np.ndarray:
    """Sizes of the intersections of pairs of sets of 44-bit hashes, in whole arrays: the elements of a pair's sets are sorted together."""
    place: dict[bytes, int] = {}
    x, y = (np.array([place.setdefault(p, len(place)) for p in side], np.int64) for side in (one, two))
    if not len(x):
        return x
    size, values = kind.many(list(place))
    start, values = np.cumsum(size) - size, values.astype(np.uint64)
    work = np.cumsum(size[x] + size[y])
    out = np.zeros(len(x), np.int64)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + COMPARED, "right")))
        parts = []
        for s in (x[lo:hi], y[lo:hi]):
            n = size[s]
            at = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts.append(np.repeat(np.arange(hi - lo, dtype=np.uint64), n) << np.uint64(44) | values[at])
        both = np.sort(np.concatenate(parts))
        out[lo:hi] = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(44)).astype(np.int64), minlength=hi - lo)
        lo = hi
    return out


def sizes_fit(x: str, y: str, percent: int) -> Column:
    """Whether two sizes allow the threshold: a Jaccard similarity is at most their ratio."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _pack_sets(t: pa.Table) -> pa.Table:
    """One row for a block of sets."""
    one = lambda c, d: pa.array([t.column(c).to_numpy().astype(d).tobytes()], pa.binary())
    toks = t.column("toks").to_pylist()
    prefix = t.column("prefix").combine_chunks()
    return pa.table({
        "grp": t.column("grp").slice(0, 1), "blk": t.column("blk").slice(0, 1), "nodes": one("node", "<i8"), "comps": one("comp", "<i8"), "ns": one("n", "<i8"), "ells": one("ell", "<i8"),
        "lens": pa.array([np.array([len(x) for x in toks], "<i8").tobytes()], pa.binary()), "toks": pa.array([b"".join(toks)], pa.binary()),
        "plens": pa.array([prefix.value_lengths().to_numpy().astype("<i8").tobytes()], pa.binary()), "prefix": pa.array([prefix.flatten().to_numpy().astype("<i8").tobytes()], pa.binary()),
    })


_PACKED = "grp long, blk long, nodes binary, comps binary, ns binary, ells binary, lens binary, toks binary, plens binary, prefix binary"


def _overlaps(x: np.ndarray, xl: np.ndarray, y: np.ndarray, yl: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks: elements x in runs of lengths xl."""
    out = np.zeros((len(xl), len(yl)), np.float32)
    common = np.intersect1d(x, y)
    xr, yr = np.repeat(np.arange(len(xl)), xl), np.repeat(np.arange(len(yl)), yl)
    for i in range(0, len(common), 4096):
        part = common[i : i + 4096]
        m = []
        for v, r, n in ((x, xr, len(xl)), (y, yr, len(yl))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            ok = part[at] == v
            d = np.zeros((n, len(part)), np.float32)
            d[r[ok], at[ok]] = 1
            m.append(d)
        out += m[0] @ m[1].T
    return out


def _cut(payloads: bytes, lens: np.ndarray, rows: np.ndarray, kind: Kind) -> dict[int, np.ndarray]:
    """The decoded sets of some rows of a block, by row."""
    end, rows = np.cumsum(lens), np.unique(rows)
    sizes, values = kind.many([payloads[end[k] - lens[k] : end[k]] for k in rows.tolist()])
    return dict(zip(rows.tolist(), np.split(values, np.cumsum(sizes)[:-1])))


def _block_links(percent: int, kind: Kind):
    """Pairs of blocks to the links that join components: candidates share min(ell) prefix elements,
    each is verified exactly, and of the links found a spanning forest is enough."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                same, r = r[0], [v if k in (5, 13) else np.frombuffer(v, "<i8") for k, v in enumerate(r[1:])]
                (nodes, comps, ns, ells, lens, toks, plens, prefix), (nodes2, comps2, ns2, ells2, lens2, toks2, plens2, prefix2) = r[:8], r[8:]
                cand = _overlaps(prefix, plens, prefix2, plens2) >= np.minimum(ells[:, None], ells2[None, :])
                cand &= comps[:, None] != comps2[None, :]
                cand &= 100 * np.minimum(ns[:, None], ns2[None, :]) >= percent * np.maximum(ns[:, None], ns2[None, :])
                if same:
                    cand = np.triu(cand, 1)
                i, j = np.nonzero(cand)
                if not len(i):
                    continue
                one, two = _cut(toks, lens, i, kind), _cut(toks2, lens2, j, kind)
                if len(i) > 4 * (len(nodes) + len(nodes2)):
                    xs, ys = list(one), list(two)  # ascending
                    x, y = ([d[k] for k in ks] for d, ks in ((one, xs), (two, ys)))
                    common = _overlaps(np.concatenate(x), np.array(list(map(len, x))), np.concatenate(y), np.array(list(map(len, y))))[np.searchsorted(xs, i), np.searchsorted(ys, j)]
                    ok = 100 * common >= percent * (ns[i] + ns2[j] - common)
                else:
                    common = np.array([_common_longs(one[p], two[q]) for p, q in zip(i.tolist(), j.tolist())])
                    ok = 100 * common >= percent * (ns[i] + ns2[j] - common)
                # components that links join, and the links as edges between components
                del cand, one, two
                K.release()
                yield from _forest([pa.RecordBatch.from_arrays([pa.array(comps[i[ok]]), pa.array(comps2[j[ok]])], names=["u", "v"])])

    return links


def link_sets(sets: DataFrame, percent: int, name: str, rounds: int = 1, kind: Kind = LONGS) -> DataFrame:
    """(node, comp) of all nodes that have a verified link; comp is the smallest node linked.

    sets: (node long, n long, toks binary, ell int, prefix array<long>, off double). n is the set's
    size, toks its elements as ``kind`` reads them (at least those that other sets may hold), prefix the elements to find candidates by: two sets are candidates if they share min(ell) of their prefixes. off says
    how far from its neighbours a set is likely to be.

    A posting list of m sets stands for m * m / 2 pairs. Only connectivity is asked for, so first
    each list's members meet one hub, its most central member (in further rounds another one), which is
    linear; what links is contracted. Lists inside one component are done. Of the open ones, those of up to LIST
    members are joined with themselves: ids of sets of different components, counted over the lists that they share,
    then verified. Longer lists form clusters of the sets that share them, and blocks of a cluster that share such a
    list are compared, block by block: candidates are found and verified by matrix products in one task, and
    a forest of the links comes back. No pair between two components is left out.
    """
    payload = sets.select("node", "n", "toks")
    postings = sets.select(F.explode("prefix").alias("tok"), "node", "n", "ell", "off")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (payload.withColumnsRenamed({"node": x, "n": f"n_{x}", "toks": f"t_{x}"}) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(_verify_pairs(percent, kind), "a long, b long")

    comp = named = None
    for r in range(rounds):
        order = F.struct("off", F.xxhash64("node")) if r == 0 else F.struct(F.lit(0.0), F.xxhash64("node", F.lit(r)))
        hubs = postings.select("tok", "node", "n", F.col("node").alias("comp"), order.alias("o")) if comp is None else named.select("tok", "node", "n", "comp", order.alias("o"))
        found = verified(_hub_pairs(hubs, f"{name}-hub", percent))
        # what is linked so far is as good as its components
        comp, _ = components(found if comp is None else found.union(comp), f"{name}-hub")
        labels = materialize(postings.join(comp, "node", "left").select("tok", "node", "n", "ell", "off", F.coalesce("comp", "node").alias("comp")), f"{name}-labels", True)
        mixed = materialize(labels.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("tok", "m", F.col("m").alias("w")), f"{name}-mixed", True)
        seen = Observation()
        named = materialize(join_hot(labels, mixed, "tok", "w").observe(seen, F.count("*").alias("n"), F.count_if(F.col("m") > LIST).alias("long")), f"{name}-open", True)
        if not seen.get["n"]:
            return comp
    some = named.where(F.col("m") <= LIST)
    one, two = (some.select("tok", F.col("node").alias(x), F.col("comp").alias(f"c_{x}"), F.col("ell").alias(f"l_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = one.join(two, "tok").where("a < b AND c_a <> c_b").where(sizes_fit("n_a", "n_b", percent)).groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.least("l_a", "l_b")).alias("l")).where("c >= l")
    links = verified(materialize(met.select("a", "b"), f"{name}-pairs", True)).union(comp)
    if seen.get["long"]:
        links = links.union(_long_lists(sets, named, percent, name, kind))
    return components(links, name)[0]


def _long_lists(sets: DataFrame, named: DataFrame, percent: int, name: str, kind: Kind) -> DataFrame:
    """A forest of the links between components that share an open list of more than LIST members.
    named: (tok, node, comp, m) of all open lists."""
    n = partitions(sets.sparkSession)
    lists = named.where(F.col("m") > LIST)
    chain = _hub_pairs(lists.select("tok", "node", "n", F.col("node").alias("comp"), F.xxhash64("node").alias("o")), f"{name}-chain")
    cluster, edges = components(chain, f"{name}-cluster")
    member = cluster.select("node", F.col("comp").alias("cluster")).union(cluster.select("comp", "comp").distinct())
    sizes = member.groupBy("cluster").agg(F.count("*").alias("w"))
    member, sizes = materialize(member, f"{name}-members", True), materialize(sizes.withColumn("size", F.col("w")), f"{name}-sizes", True)
    open_sets = named.groupBy("node").agg(F.min("comp").alias("comp"), F.collect_list("tok").alias("open"), F.max(F.struct("m", "tok")).alias("top"))
    small = F.col("size") <= BLOCK // 4
    bins = -(-2 * edges // (BLOCK // 2)) or 1  # a cluster of m sets has m - 1 edges at least
    # small clusters share bins; the sets of a large one are dealt over blocks by the longest list they stand in
    key = F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster"))
    blk = F.when(small, 0).otherwise(F.xxhash64("top.tok", F.pmod(F.xxhash64("node"), F.ceil(F.col("top.m") / BLOCK))))
    dealt = join_hot(member, sizes, "cluster", "w").join(open_sets, "node").select("node", "comp", "open", F.xxhash64(small, key).alias("grp"), blk.cast("long").alias("blk"))
    dealt = materialize(dealt, f"{name}-dealt", True)
    packed = materialize(
        dealt.join(sets.select("node", "n", "toks", "ell"), "node").withColumnRenamed("open", "prefix").select("grp", "blk", "node", "comp", "n", "ell", "toks", "prefix").groupBy("grp", "blk").applyInArrow(_pack_sets, _PACKED),
        f"{name}-blocks",
    )
    at = lists.select("tok", "node").join(dealt.select("node", "grp", "blk"), "node").select("tok", "grp", "blk").distinct()
    meet = at.join(at.withColumnRenamed("blk", "blk2"), ["tok", "grp"]).where("blk <= blk2").select("grp", "blk", "blk2").distinct()
    fields = ["nodes", "comps", "ns", "ells", "lens", "toks", "plens", "prefix"]
    other = packed.select("grp", F.col("blk").alias("blk2"), *(F.col(f).alias(f"{f}2") for f in fields))
    pairs = meet.join(packed, ["grp", "blk"]).join(other, ["grp", "blk2"]).select((F.col("blk") == F.col("blk2")).alias("same"), *fields, *(f"{f}2" for f in fields))
    return pairs.repartition(n).mapInArrow(_block_links(percent, kind), "u long, v long")
