"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; two link when their Jaccard similarity
reaches the threshold. Steps, all distributed and exact up to hashes of 48 bits and more of
shingles, 64 of sets:

0. Every document's set gets a digest. Equal sets are one group with the smallest doc_id as its representative,
   found by an aggregate with map-side combine. A run of documents packs a set once, and of the largest groups
   (1 / HOT of all rows or more) only the representative is packed at all, so copies cost nothing below.
1. Shingles with more than about 1/65,000 of all occurrences are found from counts that every run of documents
   pre-aggregates over its distinct sets; there are 131,072 at most. They never meet in a bucket: a set
   carries its own ones, to the bucket of its digest.
2. Other shingles are packed, per run of documents and hash bucket, into binary rows: 6 bytes a shingle and
   13 for each set that has one in the bucket. Buckets follow the shuffle partitions, up to MAX_BUCKETS, and runs
   grow with the buckets, so rows do not become tiny.
3. In its bucket, a shingle's document frequency is counted over distinct sets. Only shingles of two or
   more different sets go on; they are all that an intersection can hold.
4. A set goes on only if its shared shingles alone could reach the needed overlap
   T = ceil(threshold * size). It orders them rarest first and takes the prefix of
   shared - T + l shingles. The length l is chosen per document by the estimated cost: the
   prefix's posting lists against the verifications that survive when l matches are required.
   Two linked sets share at least min(l, l') of their prefixes' shingles.
5. ``link_sets`` verifies candidates exactly and finds components; in a group of
   thousands of near copies it compares with hubs first and never emits the group's pairs.

Defined results: null or wordless texts have no shingles and form their own component; rows with
one doc_id are judged one by one (each row's component is the smallest doc_id of its class);
a null doc_id takes part in links but names no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K
from ._shared import HOT, join_hot, link_sets, materialize, partitions

SHINGLE = 5
PERCENT = 75
MAX_ELL = 4
FLUSH = 1 << 19
#: a shingle is frequent from 1 / FREQUENT of all occurrences
FREQUENT = 1 << 17
FREQUENT_DF = (1 << 32) - 1
#: above this a bucket grows with the data: 64 million shingles at 100 TB
MAX_BUCKETS = 1 << 18
_BODY = np.dtype("<u4")
_MASK = np.uint64((1 << 48) - 1)


def _sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    low = K.LOWER[buf]
    w = K.words(low, off, K.NOT_SPACE)
    h = K.span_hash(K.prefix_hash(low), w.starts, w.ends)
    g = K.window_hash(h, k)
    out = []
    for a, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - a >= k:
            x = np.sort(g[a : e - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(K.whole_hash(h[a:e]) if e > a else np.zeros(0, np.uint64))
    return out


def _runs(batches: Iterator[pa.RecordBatch], k: int, flush: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(doc_ids, NO_ID for null, and sets) of runs of documents with about ``flush`` shingles."""
    ids: list[int] = []
    sets: list[np.ndarray] = []
    size = 0
    for b in batches:
        doc_ids = b.column(0).fill_null(K.NO_ID).to_pylist()
        for lo, hi, buf, off in K.blocks(b.column(1)):
            new = _sets(buf, off, k)
            ids += doc_ids[lo:hi]
            sets += new
            size += sum(map(len, new))
            if size >= flush:
                yield np.array(ids, np.int64), sets
                ids, sets, size = [], [], 0
        K.release()
    if ids:
        yield np.array(ids, np.int64), sets
    K.release()


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit digests) of each set."""
    n = np.array([len(x) for x in sets], np.int64)
    h, e = np.concatenate(sets), np.cumsum(n)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix64(h + np.uint64(salt)))])
        out.append(K.mix64(s[e] - s[e - n] + n.astype(np.uint64) * np.uint64(salt)).view(np.int64))
    return n, *out


_HEADS = "id long, d1 long, d2 long, n long, tok long, c long"


def _heads(k: int):
    """(doc_id, text) to rows (id, d1, d2, n) of every document (id null as it is, n never), rows (tok, c) of shingles that have 1 / FREQUENT of a
    run's distinct sets and occur twice in it, and a row (c) of all shingles counted. A shingle with
    2 / FREQUENT of all occurrences loses less than half of them to runs where it is rarer."""

    def batch(m: int, **columns) -> pa.RecordBatch:
        names = [f.split()[0] for f in _HEADS.split(", ")]
        return pa.RecordBatch.from_arrays([(v if isinstance(v := columns[c], pa.Array) else pa.array(v, pa.int64())) if c in columns else pa.nulls(m, pa.int64()) for c in names], names=names)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        nulls: list[np.ndarray] = []  # as the batches come

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
                yield b

        for ids, sets in _runs(noted(), k, FLUSH):
            n, d1, d2 = _digests(sets)
            none = np.concatenate(nulls)
            yield batch(len(ids), id=pa.array(ids, mask=none[: len(ids)]), d1=d1, d2=d2, n=n)
            nulls[:] = [none[len(ids) :]]
            x = np.sort(np.concatenate([sets[i] for i in np.unique(d1, return_index=True)[1].tolist()]))
            total += len(x)
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(x)))
            many = c >= max(2, len(x) / FREQUENT)
            yield batch(int(many.sum()), tok=x[at[many]].view(np.int64), c=c[many])
        yield batch(1, c=[total])

    return heads


def frequent_shingles(heads: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles with at least 1 / FREQUENT of all occurrences counted; FREQUENT at most."""
    n = materialize(heads.where("n IS NULL").groupBy("tok").agg(F.sum("c").alias("n")), "ngram-counts", True)
    total = n.where("tok IS NULL").agg(F.sum("n")).first()[0] or 0
    top = n.where("tok IS NOT NULL").where(F.col("n") >= max(2, -(-total // FREQUENT))).select("tok").toArrow()
    return np.sort(top.column("tok").to_numpy().astype(np.int64).view(np.uint64))


def _bits(parts: int) -> int:
    """Buckets as a power of two."""
    return max(5, min(MAX_BUCKETS.bit_length() - 1, (max(parts, 1) - 1).bit_length()))


def _tokens(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes as the bucket's number over the lower 48 bits."""
    low = np.uint64(64 - bits)
    return ((h & _MASK) | (h >> low << low)).view(np.int64)


def _pack(k: int, bits: int, shared=None):
    """(doc_id, text) to (bucket, body): the shingles of a run of documents, each set once, and at the bucket of
    its digest the frequent shingles of a set. shared: hashes of the frequent shingles, sorted, and the
    digests (sorted by d1) of the largest groups with their representatives."""
    buckets = 1 << bits
    small = np.uint16 if bits <= 16 else np.uint32

    def body(node, n, count, h, o_node, o_n, o_count, own) -> bytes:
        many = count[count >= 255]
        t = h & _MASK
        sizes = np.array([len(node), len(many), len(h), len(o_node), len(own)], _BODY)
        parts = (
            sizes, node, n.astype("<u4"), np.minimum(count, 255).astype("u1"), many.astype("<u4"), (t & np.uint64(0xFFFFFFFF)).astype("<u4"), (t >> np.uint64(32)).astype("<u2"),
            o_node, o_n.astype("<u4"), o_count.astype("<u4"), own,
        )
        return b"".join(x.tobytes() for x in parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, copies = (np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)) if shared is None else shared.value
        for ids, sets in _runs(batches, k, max(FLUSH, buckets << 4)):
            n, d1, d2 = _digests(sets)
            keep = np.zeros(len(ids), bool)
            by = np.lexsort((ids, d1))
            keep[by[np.concatenate([[True], d1[by][1:] != d1[by][:-1]])]] = True
            if len(copies):
                at = np.minimum(np.searchsorted(copies[:, 0], d1), len(copies) - 1)
                keep &= ~((copies[at, 0] == d1) & (copies[at, 1] == d2) & (ids > copies[at, 2]))
            keep &= n > 0
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            h, n, d1 = np.concatenate([sets[i] for i in rows.tolist()]), n[rows], d1[rows]
            del sets, d2
            doc = np.repeat(np.arange(len(rows)), n)
            often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            own_h, own_doc = h[often], doc[often]
            home = (d1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            o_by = np.argsort(home[own_doc], kind="stable")
            o_edges = np.searchsorted(home[own_doc][o_by], np.arange(buckets + 1))
            bucket = (h >> np.uint64(64 - bits)).astype(small)
            rare = np.flatnonzero(~often)
            by = rare[np.argsort(bucket[rare], kind="stable")]
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            out: tuple[list, list] = ([], [])
            for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(o_edges) > 0)).tolist():
                at, o_at = by[edges[b] : edges[b + 1]], o_by[o_edges[b] : o_edges[b + 1]]
                d, first = np.unique(doc[at], return_index=True)  # doc is ascending in a bucket
                o, o_first = np.unique(own_doc[o_at], return_index=True)
                out[0].append(b)
                out[1].append(body(d1[d], n[d], np.diff(np.append(first, len(at))), h[at], d1[o], n[o], np.diff(np.append(o_first, len(o_at))), own_h[o_at]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "body"])
            del h, doc, often, bucket, rare, by, out
            K.release()

    return pack


def _unpack(body: bytes) -> list[np.ndarray]:
    """node, n, count of rare shingles, their low and high parts; node, n, count of frequent ones, and these."""
    sizes, at, out = np.frombuffer(body, _BODY, 5).tolist(), 20, []
    for kind, m in zip(("<i8", "<u4", "u1", "<u4", "<u4", "<u2", "<i8", "<u4", "<u4", "<u8"), (0, 0, 0, 1, 2, 2, 3, 3, 3, 4)):
        out.append(np.frombuffer(body, kind, sizes[m], at))
        at += out[-1].nbytes
    count = out[2].astype(np.int64)
    count[count == 255] = out.pop(3)
    out[2] = count
    return out


_SHARED = "node long, n long, toks binary, dfs binary"


def _repeated(x: np.ndarray) -> np.ndarray:
    """Whether each element occurs more than once."""
    s = np.sort(x)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    hit = np.zeros(len(x), bool)
    if len(twice):
        for i in range(0, len(x), 1 << 18):
            part = x[i : i + (1 << 18)]
            hit[i : i + (1 << 18)] = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
    return hit


def _bucket(t: pa.Table, bits: int) -> pa.Table:
    """All shingles of a bucket: for each distinct set with shared shingles here a row (node, n, toks,
    dfs), and one for each set at home here with frequent shingles."""
    bucket = t.column("bucket")[0].as_py()
    parts = [_unpack(x) for x in t.column("body").to_pylist()]
    node, n, count, low, high, o_node, o_n, o_count, own = (np.concatenate(x) for x in zip(*parts))
    del parts
    # one run for each distinct set
    first = np.unique(node, return_index=True)[1]
    if len(first) < len(node):
        chosen = np.zeros(len(node), bool)
        chosen[first] = True
        keep = np.repeat(chosen, count)
        low, high = low[keep], high[keep]
        node, n, count = node[chosen], n[chosen], count[chosen]
        del keep
    run = np.repeat(np.arange(len(node), dtype=np.int32), count)
    hit = _repeated(low)  # by the lower 32 bits first: most shingles stand alone, and go here
    tok, run = high[hit].astype(np.int64) << 32 | low[hit], run[hit]
    del low, high, hit
    hit = _repeated(tok)
    tok, run = tok[hit], run[hit]
    x = np.sort(tok)
    df = np.searchsorted(x, tok, "right") - np.searchsorted(x, tok, "left")
    del x, hit
    tok = (tok.view(np.uint64) | np.uint64(bucket) << np.uint64(64 - bits)).view(np.int64)
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
    end = np.append(start[1:], len(run))
    r = run[start]
    # frequent shingles of the distinct sets at home here
    stop = np.cumsum(o_count.astype(np.int64))
    mine = np.unique(o_node, return_index=True)[1]
    extra = [_tokens(own[stop[i] - o_count[i] : stop[i]], bits) for i in mine.tolist()]
    toks, dfs = tok.astype("<i8").tobytes(), df.astype("<u4").tobytes()
    out = {
        "node": pa.array(np.concatenate([node[r], o_node[mine]])),
        "n": pa.array(np.concatenate([n[r], o_n[mine]]).astype(np.int64)),
        "toks": pa.array([toks[8 * a : 8 * e] for a, e in zip(start.tolist(), end.tolist())] + [x.astype("<i8").tobytes() for x in extra], pa.binary()),
        "dfs": pa.array([dfs[4 * a : 4 * e] for a, e in zip(start.tolist(), end.tolist())] + [np.full(len(x), FREQUENT_DF, "<u4").tobytes() for x in extra], pa.binary()),
    }
    del tok, run, df
    K.release()
    return pa.table(out)


def _prefixes(percent: int, max_ell: int):
    """A set's shared shingles to (node, n, toks sorted, ell, prefix)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for n, toks, dfs in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                t = np.concatenate([np.frombuffer(x, "<i8") for x in toks])
                df = np.concatenate([np.frombuffer(x, "<u4") for x in dfs]).astype(np.int64)
                by = np.lexsort((t, df))
                need = -(-percent * n // 100)
                spare = len(t) - need
                cost = np.cumsum(df[by])
                ells = np.arange(1, min(max_ell, need) + 1)
                lists = cost[np.minimum(spare + ells, len(t)) - 1]
                # reading a posting against verifying a pair of sets of this size
                best = int(np.argmin(lists + lists / ells**2 * max(1.0, n / 16)))
                ell = int(ells[best])
                out[0].append(np.sort(t).tobytes())
                out[1].append(ell)
                out[2].append(t[by[: spare + ell]].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], names=["node", "n", "toks", "ell", "prefix"])

    return prefixes


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, max_ell: int = MAX_ELL) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and rep, the smallest doc_id with
    the same set."""
    spark = docs.sparkSession
    bits = _bits(partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(rows.mapInArrow(_heads(shingle), _HEADS), "ngram-heads")
    heads = seen.where("n IS NOT NULL").select("id", "d1", "d2", "n")
    groups = materialize(heads.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "ngram-groups")
    total = groups.agg(F.sum("m")).first()[0] or 0
    top = groups.where(F.col("m") >= max(2, -(-total // HOT))).select("d1", "d2", "rep").orderBy("d1").toArrow()  # HOT rows at most
    copies = np.stack([top.column(c).fill_null(K.NO_ID).to_numpy().astype(np.int64) for c in ("d1", "d2", "rep")], 1)
    shared = spark.sparkContext.broadcast((frequent_shingles(seen), copies))
    packed = rows.mapInArrow(_pack(shingle, bits, shared), "bucket int, body binary")
    found = materialize(packed.groupBy("bucket").applyInArrow(lambda t: _bucket(t, bits), _SHARED), "ngram-buckets")
    sets = found.groupBy("node").agg(
        F.max("n").alias("n"), F.sum(F.octet_length("toks")).alias("b"), F.collect_list("toks").alias("toks"), F.collect_list("dfs").alias("dfs")
    ).where(f"100 * (b div 8) >= {percent} * n")
    cand = materialize(sets.select("node", "n", "toks", "dfs").mapInArrow(_prefixes(percent, max_ell), "node long, n long, toks binary, ell int, prefix array<long>"), "ngram-sets")
    off = 1 - F.octet_length("toks") / (8 * F.col("n"))
    comp = link_sets(cand.select("node", "n", "toks", "ell", "prefix", off.alias("off")), percent, "ngram")
    linked = comp.select(F.col("node").alias("d1"), "comp").union(comp.select("comp", "comp").distinct())
    named = materialize(groups.join(linked, "d1"), "ngram-linked", True)
    least = materialize(named.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("w")), "ngram-least", True)
    moved = join_hot(named, least, "comp", "w").select("d1", "d2", "least")
    labels = groups.join(moved, ["d1", "d2"], "left").where("m > 1 OR least IS NOT NULL").select("d1", "d2", "rep", F.coalesce("least", "rep").alias("least"), F.col("m").alias("w"))
    out = join_hot(heads, materialize(labels, "ngram-labels", True), ["d1", "d2"], "w", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.coalesce("rep", "id").alias("rep"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component (that whose doc_id names it), same columns.
    Rows without shingles stay. Where doc_ids repeat or one is null, the rows are numbered and
    written first, as doc_id does not tell them apart."""
    ids = docs.groupBy(F.col("doc_id").alias("id")).count()
    if ids.where("count > 1 OR id IS NULL").limit(1).count():
        return _keep_one_row(docs, shingle, percent)
    drop = materialize(ngram_components(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("drop_id")).distinct(), "ngram-drop", True)
    return docs.join(drop, docs["doc_id"] == drop["drop_id"], "left_anti").select(*docs.columns)


def _keep_one_row(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """keep_one by row numbers: of a component, the row of the smallest doc_id stays, null last."""
    numbered = materialize(docs.select(*docs.columns, F.monotonically_increasing_id().alias("__row")), "ngram-rows")
    comp = ngram_components(numbered.select(F.col("__row").alias("doc_id"), "text"), shingle, percent)
    rows = numbered.select("__row", F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(comp.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("first"))
    kept = materialize(first.select(F.col("first.__row").alias("__kept")), "ngram-kept", True)
    return numbered.join(kept, F.col("__row") == F.col("__kept"), "left_semi").select(*docs.columns)
