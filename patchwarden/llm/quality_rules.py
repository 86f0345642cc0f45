"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts (words, symbols, repeats). Fixed base rules drop very short and very
repetitive documents. Instead of further fixed cutoffs, every (language, source) gets its own
fences, read from quantile sketches of the documents that pass the base rules. A sketch is a
log-linear histogram: 16 buckets an octave, so any quantile is off by at most 1/16 of its
value, and two sketches merge by adding counts. It is an ordinary ``groupBy().count()`` with
map-side combine, so a source with a third of all rows costs no more than any other, and a
small source falls back to the merged sketch of its language, then of the whole corpus.

Defined results: null text has no words (base_failed); null lang or source is a group of its own;
repeated rows are judged one by one, each counting in the sketches; an empty table gives an
empty result. Extra columns pass through, whatever their names, but that ``text_stats`` and
``quality_rules`` replace those named like one of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as K
from ._shared import materialize

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: metric: (numerator, denominator, scale, slack beyond the fence, also a lower fence)
METRICS = {
    "symbol_pct": ("n_symbols", "n_words", 100, 30, False),
    "word_len_x10": ("word_chars", "n_words", 10, 20, True),
    "dup_line_pm": ("n_dup_lines", "n_lines", 1000, 500, False),
    "repeat_pm": ("n_repeat_words", "n_words", 1000, 100, False),
}
MIN_GROUP = 50
SPREAD = 3
_SYMBOL = K.byte_table(lambda b: chr(b) in "#*$%&|<>")


def _block_stats(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    w = K.words(buf, off, K.NOT_SPACE)
    inside = K.NOT_SPACE[buf]
    chars = K.per_doc(inside & K.code_points(buf), off)
    symbols = K.per_doc(_SYMBOL[buf], off)
    sums = K.prefix_hash(buf)
    ln = K.lines(buf, off)
    wordy = np.searchsorted(w.starts, ln.ends) > np.searchsorted(w.starts, ln.starts)
    line_doc = ln.doc[wordy]
    key = K.mix64(K.span_hash(sums, ln.starts[wordy], ln.ends[wordy]) ^ K.mix64(line_doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    dup = n_lines - np.bincount(line_doc[first], minlength=n)
    h = K.window_hash(K.span_hash(sums, w.starts, w.ends), 5)
    covered = np.zeros(n, np.int64)
    if len(h):
        doc = w.doc
        at = np.flatnonzero(doc[: len(h)] == doc[4:])
        key = K.mix64(h[at] ^ K.mix64(doc[at].astype(np.uint64)))
        s = np.sort(key)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
            cover = np.zeros(len(doc) + 6, np.int64)
            np.add.at(cover, at[hit], 1)
            np.add.at(cover, at[hit] + 5, -1)
            covered = np.bincount(doc[np.cumsum(cover)[: len(doc)] > 0], minlength=n)
    return [w.count, chars, symbols, dup, covered, n_lines]


def _with_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.schema.names
        parts = [_block_stats(buf, off) for _, _, buf, off in K.blocks(b.column(names.index("text")))]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(STATS))]
        del parts
        K.release()
        keep = [(c, x) for c, x in zip(names, b.columns) if c not in STATS]
        yield pa.RecordBatch.from_arrays([x for _, x in keep] + [pa.array(c.astype(np.int64)) for c in cols], names=[c for c, _ in keep] + STATS)


def text_stats(docs: DataFrame) -> DataFrame:
    """docs with the counts of STATS; columns of docs named like one are replaced."""
    kept = [f for f in docs.schema if f.name not in STATS]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in STATS)])
    return docs.mapInArrow(_with_stats, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _value(metric: str) -> Column:
    num, den, scale, _, _ = METRICS[metric]
    return F.expr(f"({scale} * {num}) div greatest({den}, 1)")


def sketch_bucket(v: Column) -> Column:
    """Bucket of a non-negative long: v below 16, then 16 buckets an octave."""
    e = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (e * 16 + F.call_function("shiftright", v, e)).cast("long")


def bucket_floor(b: Column) -> Column:
    """Smallest value of a bucket."""
    octave = F.greatest((b / 16).cast("int") - 1, F.lit(0))
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (b % 16 + 16), octave)).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, n): level 0 is a source of a language, 1 a language,
    2 everything. Sketches of higher levels are sums of lower ones."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), sketch_bucket(_value(m)).alias("bucket")) for m in METRICS))
    fine = stats.where(~base_failed()).select("lang", "source", F.explode(cells).alias("c")).groupBy("lang", "source", "c.metric", "c.bucket").agg(F.count("*").alias("n"))
    return (
        fine.groupingSets([["lang", "source", "metric", "bucket"], ["lang", "metric", "bucket"], ["metric", "bucket"]], "lang", "source", "metric", "bucket")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
        .select(F.when(F.col("gid") == 0, 0).when(F.col("gid") == 4, 1).otherwise(2).alias("level"), "lang", "source", "metric", "bucket", "n")
    )


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>) for every (lang, source) of stats."""
    w = Window.partitionBy("level", "lang", "source", "metric")
    ranked = sketches(stats).withColumn("total", F.sum("n").over(w)).withColumn("cum", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    q = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.max("total").alias("total"),
        bucket_floor(F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket")))).alias("q1"),
        bucket_floor(F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket")))).alias("q3"),
    )
    slack = F.create_map(*(F.lit(x) for m, v in METRICS.items() for x in (m, v[3])))[F.col("metric")]
    q = q.withColumn("lo", F.col("q1") - SPREAD * (F.col("q3") - F.col("q1")) - slack).withColumn("hi", F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + slack)
    wide = q.groupBy("level", "lang", "source").pivot("metric", list(METRICS)).agg(F.first("total").alias("total"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    fences = [f"{m}_{x}" for m in METRICS for x in ("lo", "hi")]
    any_total = f"{next(iter(METRICS))}_total"
    levels = [wide.where(F.col("level") == k).select(*(["lang", "source"][: 2 - k]), *([F.col(c).alias(f"{c}{k}") for c in fences]), (F.col(any_total) if k < 2 else F.lit(MIN_GROUP)).alias(f"total{k}")) for k in range(3)]
    groups = stats.groupBy("lang", "source").count().drop("count")
    g = groups.alias("g").join(levels[0].alias("a"), F.expr("g.lang <=> a.lang and g.source <=> a.source"), "left").select("g.*", *(f"{c}0" for c in [*fences, "total"]))
    g = g.alias("g").join(levels[1].alias("a"), F.expr("g.lang <=> a.lang"), "left").select("g.*", *(f"{c}1" for c in [*fences, "total"]))
    g = g.join(F.broadcast(levels[2]), how="left")  # one row
    pick = lambda c: F.when(F.col("total0") >= MIN_GROUP, F.col(f"{c}0")).when(F.col("total1") >= MIN_GROUP, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return g.select("lang", "source", *(pick(f"{m}_{x}").alias(f"{x}_{m}") for m in METRICS for x in ("lo", "hi")))


def judge(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """stats with base_failed and kept; fences joined by language and source."""
    bad = F.lit(False)
    for m, (*_, lower) in METRICS.items():
        bad = bad | F.coalesce(_value(m) > F.col(f"__hi_{m}"), F.lit(False))
        if lower:
            bad = bad | F.coalesce(_value(m) < F.col(f"__lo_{m}"), F.lit(False))
    f = fences.withColumnsRenamed({c: f"__{c}" for c in fences.columns})
    joined = stats.join(f, F.expr("lang <=> __lang and source <=> __source"), "left")
    return joined.select(*(stats[c] for c in stats.columns), base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: every column but the text, the counts, base_failed and kept.

    Texts are read once; counts and thresholds are small written tables, so the plan of the last
    join knows their sizes (broadcast where small, else a join that splits skewed keys)."""
    stats = materialize(text_stats(docs.drop("base_failed", "kept")).drop("text"), "quality-stats")
    return judge(stats, materialize(thresholds(stats), "quality-fences", True))


def quality_filter(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, same columns. Counts are made anew next to the text in
    the second pass, which is cheaper than shuffling the texts to a join by document."""
    fences = materialize(thresholds(materialize(text_stats(docs.select("text", "lang", "source")).drop("text"), "quality-stats")), "quality-fences", True)
    alias = {c: f"__{c}" for c in docs.columns if c in (*STATS, "base_failed", "kept")}
    out = judge(text_stats(docs.withColumnsRenamed(alias)), fences).where("kept").drop(*STATS, "base_failed", "kept")
    return out.withColumnsRenamed({v: k for k, v in alias.items()}).select(*docs.columns)
