"""Fuzzy line dedup by MinHash: one line stays of each group of equal or similar lines.

A line's character shingles (6 characters of its lower-cased text; a shorter line is one shingle) give a
one-permutation MinHash signature, its bands are the posting lists of candidate pairs, candidates are
confirmed by the exact Jaccard similarity of their shingle sets, and distributed union-find joins them. The first
line of a component, by doc_id and line number, stays; the others go from their documents.

Equal lines are found by their 64-bit hash alone and are one node, whatever their
number, so a line that stands in a third of all documents makes no pairs, and it is counted once
a run of documents before anything is shuffled. Bands travel packed
in binary rows, 14 bytes each, and only those met by two different lines become rows.

Equal lines are found at any length. Similar ones are found by 10 bands of 6 bins: with independent bins a pair at the
threshold 0.8 would be found with probability 1 - (1 - 0.8^6)^10 = 0.95, at 0.9 with 0.9995; bins that a short line leaves
empty borrow from others (recall by length is measured in the tests). A bitmap of its shingles goes with a line's text,
by which most false candidates are dismissed, in whole arrays and without losing a pair. Lines of
nothing but white space are left alone. Defined results: null and empty texts stay as they are; rows with equal doc_id
and text count as one document and keep the same lines, rows with equal doc_id and different texts are different
documents; null doc_id stands behind all others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as K
from ._shared import Kind, bitmap, bitmap_bits, bitmaps, in_bitmap, join_hot, link_sets, materialize, partitions, text_key

WIDTH = 6
BANDS, ROWS, BINS = 10, 6, 64
#: bytes of a line's bitmap of shingles
BITMAP = 64
PERCENT = 80
FLUSH = 100_000
#: bytes of texts whose shingles are made at a time: 8 bytes each, several times over, stay in a core's cache
PACKED = 1 << 18
#: keys of lines that a task remembers, so that it sends a text once
SENT = 1 << 16
_COUNT = np.dtype([("key", "<i8"), ("n", "<i4")])


class _Lines:
    """The lines of a block that hold a word: their bytes, lower-cased, their keys and places."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.low = K.LOWER.take(buf)
        self.all = K.lines(self.low, off)
        starts, ends = self.all.starts, self.all.ends
        holds = starts < ends
        holds[holds] = K.NOT_SPACE[self.low[starts[holds]]]
        rest = np.flatnonzero(~holds & (starts < ends))  # lines that begin with white space
        if len(rest):
            size = ends[rest] - starts[rest]
            at = np.cumsum(size) - size
            word = K.NOT_SPACE[self.low[np.repeat(starts[rest] - at, size) + np.arange(size.sum())]]
            holds[rest] = np.logical_or.reduceat(word, at)
        self.at = np.flatnonzero(holds)
        self.starts, self.ends = self.all.starts[self.at], self.all.ends[self.at]
        self.sums = K.prefix_hash(self.low)
        self.key = K.span_hash(self.sums, self.starts, self.ends).view(np.int64)

    def shingles(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the shingles of some lines."""
        return _shingles_of(self.low, self.sums, self.starts[rows], self.ends[rows])


def _shingles_of(low: np.ndarray, sums: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the shingles of lines. In lines of ASCII a character is a byte; in others characters are
    found first. Shingles of up to 8 bytes are hashed as one number, longer ones by running sums (None: made where there are any)."""
    wide = np.flatnonzero(low >= 0x80)
    odd = np.searchsorted(wide, ends) > np.searchsorted(wide, starts)  # in any order of lines
    # the 8 bytes from each place on, as aligned numbers, which are gathered several times faster
    padded = np.ndarray((len(low),), "<u8", np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,)).copy()
    out = []
    for rows, cp in ((np.flatnonzero(~odd), None), (np.flatnonzero(odd), True)):
        if not len(rows):
            continue
        if cp is None:
            first, size = starts[rows], ends[rows] - starts[rows]
        else:
            cp = np.append(np.flatnonzero(K.code_points(low)), len(low))
            first = np.searchsorted(cp, starts[rows])
            size = np.searchsorted(cp, ends[rows]) - first
        n = np.maximum(size - WIDTH + 1, 1)
        at = np.cumsum(n) - n
        i = np.repeat(first - at, n)
        i += np.arange(len(i))
        if cp is None:
            h = _short_hash(padded.take(i), WIDTH)
            short = np.flatnonzero(size < WIDTH)  # one shingle each
            h[at[short]] = _short_hash(padded[first[short]], size[short])
        else:
            length = np.append(cp, [len(low)] * WIDTH)[WIDTH:] - cp  # bytes of the shingle from each character on
            short = np.flatnonzero(size < WIDTH)
            length, i = length.take(i), cp.take(i)
            length[at[short]] = ends[rows[short]] - starts[rows[short]]
            h = _short_hash(padded.take(i), length)
            if (long := np.flatnonzero(length > 8)).size:
                from_ = i.take(long)
                h[long] = K.span_hash(K.prefix_hash(low) if sums is None else sums, from_, from_ + length.take(long))
        out.append((np.repeat(rows, n), h))
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _short_hash(eight: np.ndarray, length) -> np.ndarray:
    """Hash of the first length bytes (8 at most count) of each number."""
    x = eight & _MASKS.take(np.minimum(length, 8))
    y = np.empty_like(x)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= np.right_shift(x, np.uint64(32), y)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, np.uint64(29), y)
    return x


def _tries() -> np.ndarray:
    """For each bin the order in which it borrows: itself, then the others by hash, each bin another way."""
    b = np.arange(BINS, dtype=np.uint64)
    h = K.mix64(b[:, None] * np.uint64(BINS) + b[None, :] + np.uint64(1))
    h[np.arange(BINS), np.arange(BINS)] = 0
    return np.argsort(h, 1, kind="stable")


_TRIES = _tries()
_OWN = np.arange(BINS, dtype=np.uint64) * np.uint64(0x1000000000001)


def signatures(line: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash (n lines x BINS) of shingles (line, h); an empty bin takes the value of the first
    filled one in its own order, so empty bins do not all copy one neighbour."""
    cell = line * BINS
    cell += (h >> np.uint64(58)).view(np.int64)
    low = np.full(n * BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(low, cell, (h >> np.uint64(26)).astype(np.uint32))
    sig = (low.reshape(n, BINS) + _OWN).ravel()  # a value tells the bin that it is from
    full = low != 0xFFFFFFFF
    left = np.flatnonzero(~full)
    for t in range(1, BINS):
        if not len(left):
            break
        own = left & (BINS - 1)
        at = left - own + _TRIES[own, t]
        got = full[at]
        sig[left[got]] = sig[at[got]]
        left = left[~got]
    return sig.reshape(n, BINS)


def _bands(sig: np.ndarray) -> np.ndarray:
    """(lines x BANDS) hashes of ROWS bins each."""
    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sig), 0)
    for r in range(ROWS):
        h = h * np.uint64(0xE7037ED1A0B428DB) + sig[:, r * BANDS : (r + 1) * BANDS]
    return K.mix64(h)


def _pack(buckets: int):
    """text to (bucket, low, high, nodes, counts): bands of a run's distinct lines, and how often
    each line occurs in the run, so a line of many documents travels once a run."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        bands: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        seen = 0

        def flush() -> pa.RecordBatch:
            key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            node = key
            h = np.concatenate(bands)[first].ravel()
            node = np.repeat(node, BANDS)
            bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.uint16)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            o = np.zeros(len(key), _COUNT)
            o["key"] = key
            np.add.at(o["n"], back, np.concatenate(counts))
            ob = ((o["key"].view(np.uint64) >> np.uint64(48)) % np.uint64(buckets)).astype(np.uint16)
            oby = np.argsort(ob, kind="stable")
            oedges = np.searchsorted(ob[oby], np.arange(buckets + 1))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for b in range(buckets):
                at, oat = by[edges[b] : edges[b + 1]], oby[oedges[b] : oedges[b + 1]]
                if len(at) or len(oat):
                    t = h[at]
                    for c, v in zip(rows, (b, (t & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (t >> np.uint64(32)).astype("<u2").tobytes(), node[at].tobytes(), o[oat].tobytes())):
                        c.append(v)
            keys.clear()
            bands.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "low", "high", "nodes", "counts"])

        for b in batches:
            for _, _, buf, off in K.blocks(b.column(0), PACKED):
                ln = _Lines(buf, off)
                if not len(ln.key):
                    continue
                _, first, n = np.unique(ln.key, return_index=True, return_counts=True)
                by = np.argsort(first)  # in the order of the text, which is read faster
                first = first[by]
                keys.append(ln.key[first])
                counts.append(n[by])
                bands.append(_bands(signatures(*ln.shingles(first), len(first))))
                seen += len(ln.key)
                if seen >= FLUSH:
                    yield flush()
                    seen = 0
            K.release()
        if keys:
            yield flush()
        K.release()

    return pack


def _bucket(t: pa.Table) -> pa.Table:
    """A bucket's postings (tok, key) of bands that different lines share, and rows (null, key, n) of
    the lines that occur n > 1 times."""
    bucket = t.column("bucket")[0].as_py()
    cat = lambda c, d: np.concatenate([np.frombuffer(x, d) for x in t.column(c).to_pylist()])
    tok = cat("low", "<u4").astype(np.int64) | cat("high", "<u2").astype(np.int64) << 32
    node = cat("nodes", "<i8")
    by = np.argsort(tok)
    tok = tok[by]
    eq = tok[1:] == tok[:-1]
    met = np.zeros(len(tok), bool)
    met[1:] = eq
    met[:-1] |= eq
    tok, node = tok[met], node[by[met]]  # most bands stand alone: few are left to be ordered by node
    by = np.lexsort((node, tok))
    tok, node = tok[by], node[by]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
    tok, node = tok[new], node[new]
    same = np.zeros(len(tok), bool)
    if len(tok):
        eq = tok[1:] == tok[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    tok, node = tok[same] | np.int64(bucket & 0x7FFF) << 48, node[same]
    o = cat("counts", _COUNT)
    key, back = np.unique(o["key"], return_inverse=True)
    n = np.bincount(back, o["n"], len(key)).astype(np.int64)
    again = n > 1
    K.release()
    return pa.table({
        "tok": pa.chunked_array([pa.array(tok), pa.nulls(int(again.sum()), pa.int64())]), "key": pa.chunked_array([pa.array(node), pa.array(key[again])]),
        "n": pa.chunked_array([pa.nulls(len(tok), pa.int64()), pa.array(n[again])]),
    })


def _gathered(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some lines one after another, and where each begins and ends."""
    size = ends - starts
    stop = np.cumsum(size)
    i = np.repeat(starts - (stop - size), size)
    i += np.arange(len(i))
    return low.take(i), stop - size, stop


def _fetch(slots, bits: int):
    """(doc_id, text, h1, h2) to (key, id, h1, h2, line, text, n) of the lines whose key passes the first bitmap; the
    text and the number of its shingles go with the first of a run's equal lines, and only if
    the key passes the second."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, compared = (in_bitmap(x, bits) for x in slots.value)
        sent: set[int] = set()  # keys whose text went out lately
        for b in batches:
            ids = b.column(0)
            h1, h2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo, _, buf, off in K.blocks(b.column(1), PACKED):
                ln = _Lines(buf, off)
                hit = np.flatnonzero(wanted(ln.key))
                key, at = ln.key[hit], ln.at[hit]
                doc = ln.all.doc[at]
                texts: list = [None] * len(at)
                sizes: list = [None] * len(at)
                first = np.sort(np.unique(key, return_index=True)[1])
                first = first[compared(key[first])]
                first = first[[k not in sent for k in key[first].tolist()]] if len(first) else first
                if len(sent) > SENT:
                    sent.clear()
                sent.update(key[first].tolist())
                low, starts, ends = _gathered(ln.low, ln.starts[hit[first]], ln.ends[hit[first]])
                shingles = _shingles_of(low, None, starts, ends)
                marks = _bitmaps(*shingles, len(first))
                raw = low.tobytes()
                for k, (i, n) in enumerate(zip(first.tolist(), _distinct(*shingles, len(first))[0].tolist())):
                    texts[i] = marks[k].tobytes() + raw[starts[k] : ends[k]]
                    sizes[i] = n
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(lo + doc)), pa.array(h1[lo + doc]), pa.array(h2[lo + doc]), pa.array((at - ln.all.first[doc]).astype(np.int32)), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["key", "id", "h1", "h2", "line", "text", "n"])
            K.release()

    return fetch


_LOW = np.uint64((1 << 44) - 1)


def _distinct(line: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of different shingles of n lines, 44 bits of these shingles' hashes line by line)."""
    if n < 1 << 20:  # a line's number and a hash sort as one number
        x = np.sort(line.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
        x = x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]
        return np.bincount((x >> np.uint64(44)).astype(np.int64), minlength=n), (x & _LOW).view(np.int64)
    h = h >> np.uint64(20)
    by = np.lexsort((h, line))
    line, h = line[by], h[by]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return np.bincount(line[new], minlength=n), h[new].view(np.int64)


def _bitmaps(line: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n lines x BITMAP bytes) with a bit set for each shingle's hash."""
    out = np.zeros((n, 8 * BITMAP), bool)
    out[line, (h & np.uint64(8 * BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(out, 1)


def _shingles(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some lines' shingles: sizes, and elements one after another. A payload is a bitmap and the text."""
    parts, at = [], 0
    ends = np.cumsum([len(x) - BITMAP for x in payloads])
    while at < len(payloads):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PACKED, "right")))
        low = np.frombuffer(b"".join(x[BITMAP:] for x in payloads[at:to]), np.uint8)
        stop = (ends[at:to] - (ends[at - 1] if at else 0)).astype(np.int64)
        parts.append(_distinct(*_shingles_of(low, None, np.concatenate([[0], stop[:-1]]).astype(np.int64), stop), to - at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _line_set(payload: bytes) -> set:
    """A line's shingles as they are: bytes where characters are, else text."""
    x = payload[BITMAP:]
    x = x if x.isascii() else x.decode()
    return {x[k : k + WIDTH] for k in range(max(len(x) - WIDTH + 1, 1))}


def _common(x: set, y: set) -> int:
    """Shared shingles; of an ASCII line with another one, compared as text."""
    if type(next(iter(x))) is not type(next(iter(y))):
        x, y = ({v.decode() if isinstance(v, bytes) else v for v in z} for z in (x, y))
    return len(x & y)


LINES = Kind(_shingles, _line_set, _common, BITMAP)


def _without(schema_names: list[str]):
    """Rows with a list of line numbers to texts without these lines."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index("text"))
            drop = b.column(names.index("__drop")).to_pylist()
            n_lines, n_removed, out = [], [], []
            for t, d in zip(texts.to_pylist(), drop):
                parts = t.split("\n") if t else []
                n_lines.append(len(parts))
                n_removed.append(len(d) if d else 0)
                if d:
                    gone = set(d)
                    t = "\n".join(p for i, p in enumerate(parts) if i not in gone)
                out.append(t)
            new = {"text": pa.array(out, pa.string()), "__lines": pa.array(n_lines, pa.int64()), "__removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(names.index(c)) for c in schema_names], names=schema_names)

    return without


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, h1, h2, drop): for each document that loses lines, their numbers. id is its doc_id, h1 and h2 are the text's
    hash."""
    spark = docs.sparkSession
    buckets = max(32, min(partitions(spark), 1 << 15))
    h1, h2 = text_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1.alias("h1"), h2.alias("h2"))
    packed = rows.select("text").mapInArrow(_pack(buckets), "bucket int, low binary, high binary, nodes binary, counts binary")
    found = materialize(packed.groupBy("bucket").applyInArrow(_bucket, "tok long, key long, n long"), "lines-buckets")
    postings = found.where("tok IS NOT NULL").select("tok", F.col("key").alias("node"))
    again = found.where("tok IS NULL").select("key", "n")
    bands = materialize(postings.groupBy(F.col("node").alias("key")).agg(F.collect_list("tok").alias("prefix")), "lines-bands", True)
    wanted = bands.select("key", F.lit(True).alias("compared")).union(again.select("key", F.lit(False)))
    bits = bitmap_bits(wanted.count())
    slots = spark.sparkContext.broadcast(bitmaps(wanted, bits))
    fetched = materialize(rows.mapInArrow(_fetch(slots, bits), "key long, id long, h1 long, h2 long, line int, text binary, n long"), "lines-texts")
    texts = fetched.where("text IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    sets = texts.join(bands, "key").select(F.col("key").alias("node"), "n", F.col("text").alias("toks"), F.lit(1).alias("ell"), "prefix", F.lit(0.0).alias("off"))
    comp = link_sets(materialize(sets, "lines-sets", True), percent, "lines", kind=LINES)
    linked = comp.select(F.col("node").alias("key"), "comp").union(comp.select("comp", "comp").distinct())
    labels = again.join(linked, "key", "full").select("key", F.coalesce("comp", "key").alias("g"), F.coalesce("n", F.lit(1)).alias("w"))
    occ = fetched.select("key", "id", "h1", "h2", "line")
    grouped = materialize(join_hot(occ, materialize(labels, "lines-labels", True), "key", "w").select("id", "h1", "h2", "line", "g"), "lines-groups", True)
    first = grouped.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "line", "h1", "h2")).alias("f"))
    # by the whole place, as no line's group is a key: a document's lines and those of them that are first meet once, sets do away with copies of a document
    place = ("id", "h1", "h2")
    met = grouped.select(*place, "line", F.lit(None).cast("int").alias("kept")).unionByName(first.select(*(F.col(f"f.{c}").alias(c) for c in place), F.lit(None).cast("int").alias("line"), F.col("f.line").alias("kept")))
    drop = met.groupBy(*place).agg(F.array_except(F.collect_set("line"), F.collect_set("kept")).alias("drop"))
    return drop.where(F.size("drop") > 0)


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with its lines' duplicates removed, and two more columns: n_lines and n_removed. A bitmap of the texts that lose lines, 64 MB at most, lets the
    other documents pass where they are; only those that lose lines are joined with their line numbers."""
    base = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    drop = materialize(removed_lines(docs, percent), "lines-drop", True)
    bits = bitmap_bits(drop.count())
    slots = docs.sparkSession.sparkContext.broadcast(bitmap(drop.select("h1"), bits))

    @F.pandas_udf("boolean")
    def loses(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(slots.value, bits)(h.to_numpy()))

    h1, h2 = text_key()
    hashed = docs.select(*base, h1.alias("__h1"))
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    others = hashed.where(~loses("__h1")).select(*base, lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__d1")) & (h2 == F.col("__d2"))
    named = drop.select(F.col("id").alias("__id"), F.col("h1").alias("__d1"), F.col("h2").alias("__d2"), F.col("drop").alias("__drop"))
    # a document has one row in named, so a hash table of these is small beside the texts, which need not be sorted
    joined = hashed.where(loses("__h1")).join(named.hint("shuffle_hash"), same, "left").select(*base, "__drop")
    schema = T.StructType([*(f for f in docs.schema if f.name in base), T.StructField("__lines", T.LongType()), T.StructField("__removed", T.LongType())])
    return joined.mapInArrow(_without([f.name for f in schema]), schema).withColumnsRenamed({"__lines": "n_lines", "__removed": "n_removed"}).unionByName(others)
