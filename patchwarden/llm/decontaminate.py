"""Benchmark decontamination by winnowing.

Words are hashed, every run of K words gives a k-gram hash, and of each SPAN - K + 1 neighbouring
k-grams the minimum is kept. Two texts that share SPAN words in a row share the k-grams of that
span, so they share a kept fingerprint: no shared span can be missed. Documents meet the
benchmark on fingerprints; a hit is then extended to the windows of SPAN words around it, and
these are confirmed word by word. A benchmark item of fewer words is one window, which its hash
at every document position finds.

The benchmark side has two ways with the same results. Up to ``broadcast_bytes`` of benchmark
text (measured first), its windows go to every worker and documents are judged in one map,
without a shuffle. Beyond it, a Bloom bitmap of bounded size thins the documents' fingerprints,
and what is left meets the benchmark's in an equi-join.

Defined results: null or wordless texts have no words and no hits; items without words match
nothing; rows with the same doc_id are judged one by one; items with the same item_id count
once, and so do those with a null one, which the digest leaves out; with an empty benchmark nothing is hit. Other columns pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K
from ._shared import bitmap, bitmap_bits, in_bitmap, join_hot, materialize, text_key

SPAN = 10
KGRAM = 6
BROADCAST_BYTES = 32 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
KEYED = f"{OUT}, h1 long, h2 long"


def _winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of w neighbours. Documents stand behind
    each other; a window over a border can only add positions."""
    n = len(g)
    if n < w:
        return np.arange(n)
    low = g[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, g[i : n - w + 1 + i], out=low)
    high = np.zeros(n, np.uint64)
    for i in range(w):
        np.maximum(high[i : n - w + 1 + i], low, out=high[i : n - w + 1 + i])
    return np.flatnonzero(high == g)


class _Block:
    """Lower-cased words of a block with their hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf = K.LOWER[buf]
        self.w = K.words(self.buf, off, K.ALNUM)
        self.h = K.span_hash(K.prefix_hash(self.buf), self.w.starts, self.w.ends)
        self.raw = None

    def text(self, lo: int, hi: int) -> str:
        """Words lo to hi joined by spaces."""
        if self.raw is None:
            self.raw = self.buf.tobytes()
        return b" ".join(self.raw[a:b] for a, b in zip(self.w.starts[lo:hi].tolist(), self.w.ends[lo:hi].tolist())).decode("utf-8", "replace")

    def fingerprints(self, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, hashes): winnowed k-grams, and all windows of the short lengths."""
        g = K.window_hash(self.h, KGRAM)
        at = _winnow(g, SPAN - KGRAM + 1)
        yield KGRAM, at, g[at]
        for m in short:
            g = K.window_hash(self.h, m)
            yield -m, np.arange(len(g)), g


def _bench_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark rows to (fp, off, len, window, item_id): each kept fingerprint with the windows around it."""
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        ids = b.column(0)
        for lo, _, buf, off in K.blocks(b.column(1)):
            blk = _Block(buf, off)
            g = K.window_hash(blk.h, KGRAM).view(np.int64)
            kept = np.zeros(len(blk.h), bool)
            kept[_winnow(g.view(np.uint64), SPAN - KGRAM + 1)] = True
            for d in range(len(off) - 1):
                a, e = int(blk.w.first[d]), int(blk.w.first[d + 1])
                item = ids[lo + d].as_py()
                if a == e:
                    continue
                if e - a < SPAN:
                    h = K.whole_hash(blk.h[a:e]).view(np.int64)[0]
                    add = [(int(h), 0, e - a, blk.text(a, e))]
                else:
                    add = [(int(g[p]), p - s, SPAN, blk.text(s, s + SPAN)) for s in range(a, e - SPAN + 1) for p in range(s, s + SPAN - KGRAM + 1) if kept[p]]
                for fp, o, m, t in add:
                    for c, v in zip(rows, (fp, o, m, t, item)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["fp", "off", "len", "window", "item_id"])


def bench_windows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_bench_windows, "fp long, off int, len int, window string, item_id long")


def _candidates(blk: _Block, short: list[int], known) -> Iterator[tuple[int, int, int]]:
    """(document, start, length) of windows around fingerprints for which known holds."""
    doc = blk.w.doc
    first = blk.w.first
    for m, at, fps in blk.fingerprints(short):
        hit = at[known(fps)]
        for p in hit.tolist():
            d = int(doc[p])
            a, e = int(first[d]), int(first[d + 1])
            if m < 0:
                if p - m <= e:
                    yield d, p, -m
            else:
                for s in range(max(a, p + KGRAM - SPAN), min(p, e - SPAN) + 1):
                    yield d, s, SPAN


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest()


def _member(fps: np.ndarray):
    fps = np.unique(fps)
    return lambda x: (fps[np.minimum(np.searchsorted(fps, x), len(fps) - 1)] == x) if len(fps) else np.zeros(len(x), bool)


def _judge_in_map(windows):
    """Judges documents against broadcast windows {text: items} and their fingerprints."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, short, index = windows.value
        known = _member(fps)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for _, _, buf, off in K.blocks(b.column(1)):
                blk = _Block(buf, off)
                n = len(off) - 1
                covered: dict[int, set] = {}
                items: dict[int, set] = {}
                seen = set()
                for d, s, m in _candidates(blk, short, known):
                    if (s, m) in seen:
                        continue
                    seen.add((s, m))
                    if (got := index.get(blk.text(s, s + m))) is not None:
                        covered.setdefault(d, set()).update(range(s, s + m))
                        items.setdefault(d, set()).update(got)
                cols[0].extend(blk.w.count.tolist())
                cols[1].extend(len(covered.get(d, ())) for d in range(n))
                cols[2].extend(len(items.get(d, ())) for d in range(n))
                cols[3].extend(_digest(items.get(d, set())) for d in range(n))
            hit = pa.array(cols[1], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), hit, pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array([x > 0 for x in cols[1]], pa.bool_()), b.column(2), b.column(3)], names=[x.split()[0] for x in KEYED.split(", ")])

    return judge


def _find_in_map(slots, bits: int, short: list[int]):
    """Documents to one row of counts, with the candidate windows that pass the bitmap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = in_bitmap(slots.value, bits)
        known = lambda x: test(x.view(np.int64))
        item = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("window", pa.string())]))
        for b in batches:
            n_words: list = []
            found: list = []
            for _, _, buf, off in K.blocks(b.column(1)):
                blk = _Block(buf, off)
                hits: list[dict] = [{} for _ in range(len(off) - 1)]
                for d, s, m in _candidates(blk, short, known):
                    if (s, m) not in hits[d]:
                        hits[d][s, m] = blk.text(s, s + m)
                n_words += blk.w.count.tolist()
                found += [[{"start": int(s - blk.w.first[d]), "len": m, "window": t} for (s, m), t in x.items()] for d, x in enumerate(hits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(n_words, pa.int64()), pa.array(found, item)], names=["doc_id", "h1", "h2", "row_key", "n_words", "hits"])

    return find


def _by_join(docs: DataFrame, bench: DataFrame, short: list[int]) -> DataFrame:
    """The way for benchmarks of any size: bitmap, equi-join on the window, aggregate by document."""
    spark = docs.sparkSession
    n = bench.count()
    bits = bitmap_bits(n)
    slots = spark.sparkContext.broadcast(bitmap(bench.select("fp"), bits))
    rows = docs.select("doc_id", "text", "h1", "h2", F.monotonically_increasing_id().alias("row_key"))
    marked = materialize(rows.mapInArrow(_find_in_map(slots, bits, short), "doc_id long, h1 long, h2 long, row_key long, n_words long, hits array<struct<start:int,len:int,window:string>>"), "decon-marked")
    found = marked.select("row_key", F.explode("hits").alias("h")).select("row_key", "h.*")
    # a passage of many documents: counted before it meets the benchmark, and its rows stay where they are
    met = found.groupBy("window").agg(F.count("*").alias("w")).join(bench.select("window").distinct(), "window")
    spans = materialize(join_hot(found, materialize(met, "decon-windows", True), "window", "w"), "decon-spans")
    covered = spans.select("row_key", F.explode(F.sequence("start", F.expr("start + len - 1"))).alias("w")).groupBy("row_key").agg(F.count_distinct("w").alias("n_hit"))
    pairs = materialize(spans.select("row_key", "window").distinct(), "decon-pairs")
    items = (
        pairs.join(bench.select("window", "item_id").distinct(), "window")
        .groupBy("row_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    )
    none = F.array().cast("array<string>")
    got = F.coalesce("items", none)
    return marked.select("doc_id", "h1", "h2", "row_key", "n_words").join(covered, "row_key", "left").join(items, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), (F.size(got) + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.array_join(got, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "h1", "h2",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _verdicts(docs, benchmark, broadcast_bytes).drop("h1", "h2")


def _verdicts(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The rows of contamination with the text's hash, h1 and h2."""
    spark = docs.sparkSession
    h1, h2 = text_key()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1.alias("h1"), h2.alias("h2"))
    bench = materialize(bench_windows(benchmark), "decon-bench", True)
    size = bench.agg(F.coalesce(F.sum(F.octet_length("window") + 32), F.lit(0))).first()[0]
    short = sorted(r.len for r in bench.where(F.col("len") < SPAN).select("len").distinct().collect())  # at most SPAN - 1 values
    if size > broadcast_bytes:
        return _by_join(docs, bench, short)
    index: dict[str, list] = {}
    fps = []
    for r in bench.collect():  # bounded by broadcast_bytes
        fps.append(r.fp)
        index.setdefault(r.window, set()).add(r.item_id)
    windows = spark.sparkContext.broadcast((np.array(fps, np.int64).view(np.uint64), short, index))
    return docs.mapInArrow(_judge_in_map(windows), KEYED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows of which more than max_hit_share of the words stand in a benchmark
    window; same columns. Judged rows are joined back by doc_id and the text's hash, as doc_id may be null
    or repeated; equal texts have equal verdicts."""
    verdict = _verdicts(docs, benchmark, broadcast_bytes).where("contaminated").where(F.col("n_hit") > F.col("n_words") * max_hit_share)
    bad = materialize(verdict.select(F.col("doc_id").alias("bad_id"), F.col("h1").alias("bad_h1"), F.col("h2").alias("bad_h2")).distinct(), "decon-bad", True)
    h1, h2 = text_key(docs["text"])
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (h1 == bad["bad_h1"]) & (h2 == bad["bad_h2"])
    return docs.join(bad, same, "left_anti").select(*docs.columns)
