"""Quality classifier by co-training two views of a document.

The text view sees hashed words and counts of the text; the metadata view sees lang, source and
length. Each is a logistic regression. Over some rounds each view labels the rows of an unlabelled
pool that it is sure of, and hands them to the other as weaker training rows. What a view hands on is gated:
of the labelled rows that it was not trained on, those it is as sure of must bear it out, by half of what
guessing the class gets wrong, and by GATE at least; else it hands on none of that class. Then each view is
calibrated on these rows (a slope below zero, worse than chance, becomes zero), and a last regression on the two
calibrated logits combines them, with weights of zero or more; the output says which views have a weight. The same is
done for both labels, quality and toxic.

Fitting uses a bounded sample: ``max_labelled`` labelled and ``max_pool`` other rows at most, different
whole texts chosen by hash, so neither a hot doc_id nor a text in a third of all rows fills it; weights
have a fixed size. Scoring covers every row in one map, without a shuffle.

Defined results: null texts and null metadata are views without features; where there are no labels
the scores are null and everything is kept; with labels of one class that class's share is the score;
a label row repeated or in conflict counts as its mean, rounded up; a text repeated under one doc_id is learned
from once; rows are scored one by one; an empty table gives an empty result; columns other than doc_id, text,
lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K
from ._shared import materialize
from .quality_rules import _block_stats

MAX_LABELLED = 6000
MAX_POOL = 6000
ROUNDS = 3
SURE = 0.95
SHARE = 0.1
#: least precision of a view's sure labels of a class, and on how many held-out rows it must show
GATE, GATE_ROWS = 0.9, 5
TEXT_BITS = 16
META_BITS = 12
DENSE = 6
LABELS = ("quality", "toxic")
VIEWS = ("text", "meta")


def _rows(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(word slots, their weights, dense counts) of each document of a block."""
    n = len(off) - 1
    low = K.LOWER[buf]
    w = K.words(low, off, K.LETTERS)
    slot = (K.span_hash(K.prefix_hash(low), w.starts, w.ends) >> np.uint64(64 - TEXT_BITS)).astype(np.int64)
    key, tf = np.unique(w.doc << TEXT_BITS | slot, return_counts=True)
    doc = key >> TEXT_BITS
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(doc, value**2, n))
    value = value / norm[doc]
    cut = np.searchsorted(doc, np.arange(n + 1))
    slot = key & ((1 << TEXT_BITS) - 1)
    words, chars, symbols, dup, repeat, lines = (x.astype(float) for x in _block_stats(buf, off))
    one = np.maximum(words, 1)
    dense = np.stack([np.log1p(words), chars / one / 10, np.minimum(symbols / one, 4), dup / np.maximum(lines, 1), repeat / one, (words < 10).astype(float)], 1)
    return [slot[a:b] for a, b in zip(cut, cut[1:])], [value[a:b] for a, b in zip(cut, cut[1:])], dense


def _meta_slots(lang: list, source: list, sizes: np.ndarray) -> np.ndarray:
    """Four slots a row: lang, source, both, and the text's length in octaves."""
    octave = np.floor(np.log2(sizes + 1)).astype(int)
    cells = [c for g, s, o in zip(lang, source, octave.tolist()) for c in (f"l{g}", f"s{s}", f"b{g}\n{s}", f"n{o}")]
    buf, off = K.text_buffer(pa.array(cells, pa.string()))
    return (K.span_hash(K.prefix_hash(buf), off[:-1], off[1:]) >> np.uint64(64 - META_BITS)).astype(np.int64).reshape(-1, 4)


class View:
    """Logistic regression on sparse rows (indices, values, row starts)."""

    def __init__(self, dim: int, l2: float, steps: int = 80, rate: float = 0.3):
        self.dim, self.l2, self.steps, self.rate = dim, l2, steps, rate
        self.w, self.b = np.zeros(dim), 0.0

    def logits(self, x) -> np.ndarray:
        idx, val, start = x
        s = np.concatenate([[0.0], np.cumsum(self.w[idx] * val)])
        return s[start[1:]] - s[start[:-1]] + self.b

    def fit(self, x, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam on the weighted log loss, from zero; the bias starts at the class share."""
        idx, val, start = x
        row = np.repeat(np.arange(len(y)), np.diff(start))
        weight = weight / max(weight.sum(), 1e-9)
        p = np.clip((weight * y).sum(), 1e-3, 1 - 1e-3)
        self.w, self.b = np.zeros(self.dim), float(np.log(p / (1 - p)))
        m, v, mb, vb = np.zeros(self.dim), np.zeros(self.dim), 0.0, 0.0
        for t in range(1, self.steps + 1):
            e = weight * (1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30))) - y)
            g = np.bincount(idx, e[row] * val, self.dim) + self.l2 * self.w
            gb = e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, c = 1 - 0.9**t, 1 - 0.999**t
            self.w -= self.rate * (m / a) / (np.sqrt(v / c) + 1e-8)
            self.b -= self.rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)


def _take(x, rows: np.ndarray):
    idx, val, start = x
    n = np.diff(start)[rows]
    at = np.arange(int(n.sum())) + np.repeat(start[:-1][rows] - (np.cumsum(n) - n), n)
    return idx[at], val[at], np.concatenate([[0], np.cumsum(n)])


def _dense_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a small ridge-stabilised logistic regression (Newton steps)."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 0.1 * w)
    return w


class Classifier:
    """Two views, their calibration and their combination; or a constant."""

    def __init__(self):
        self.share: float | None = None
        self.views: list[View] = []
        self.calibrate: list[np.ndarray] = []
        self.combine = np.zeros(3)
        self.used = ""
        self.exchanged: list[tuple[int, int]] = []

    def fit(self, views: list, y: np.ndarray, pool: list) -> Classifier:
        """views, pool: the rows of the two views; y: labels. Every fourth row calibrates."""
        if not len(y) or y.min() == y.max():
            self.share = float(y.mean()) if len(y) else None
            return self
        cal = np.arange(len(y)) % 4 == 3
        if len(set(y[cal])) < 2 or len(set(y[~cal])) < 2:
            cal = np.zeros(len(y), bool)
        train, check = np.flatnonzero(~cal), np.flatnonzero(cal) if cal.any() else np.arange(len(y))
        n_pool = len(pool[0][2]) - 1
        given = [np.full(n_pool, -1.0), np.full(n_pool, -1.0)]  # labels that a view got from the other
        self.views = [View((1 << TEXT_BITS) + DENSE, 1e-5), View(1 << META_BITS, 1e-3)]
        for r in range(ROUNDS + 1):
            for k, view in enumerate(self.views):
                got = np.flatnonzero(given[k] >= 0)
                a, b = _take(views[k], train), _take(pool[k], got)
                x = (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], a[2][-1] + b[2][1:]]))
                view.fit(x, np.concatenate([y[train], given[k][got]]), np.concatenate([np.ones(len(train)), np.full(len(got), 0.5)]))
            if r == ROUNDS:
                break
            news = []
            for k, view in enumerate(self.views):
                p, sure = _sure(view.logits(pool[k]))
                held, held_sure = _sure(view.logits(_take(views[k], check))) if cal.any() else (np.zeros(0), np.zeros(0, bool))
                passes = [_precise(y[check] == c, held_sure & ((held >= 0.5) == c), np.mean(y[train] == c)) if len(held) else False for c in (0, 1)]
                free = np.flatnonzero((given[1 - k] < 0) & sure & np.where(p >= 0.5, passes[1], passes[0]))
                best = free[np.argsort(-np.abs(p[free] - 0.5), kind="stable")][: int(SHARE * n_pool)]
                given[1 - k][best] = (p[best] >= 0.5).astype(float)
                news.append(len(best))
            self.exchanged.append((news[0], news[1]))
        z = []
        for k, view in enumerate(self.views):
            x = view.logits(_take(views[k], check))
            c = _dense_fit(x[:, None], y[check])
            if c[0] < 0:
                c = np.array([0.0, _dense_fit(np.zeros((len(x), 0)), y[check])[0]])
            self.calibrate.append(c)
            z.append(x * c[0] + c[1])
        self.combine = _dense_fit(np.stack(z, 1), y[check])
        if self.combine[:2].min() < 0:
            k = int(self.combine[:2].argmax())
            w = _dense_fit(z[k][:, None], y[check])
            self.combine = np.array([0.0, 0.0, w[1]])
            self.combine[k] = max(w[0], 0.0)
        self.used = "+".join(v for v, w, c in zip(VIEWS, self.combine, self.calibrate) if w > 0 and c[0] > 0)
        return self

    def predict(self, views: list) -> np.ndarray:
        if not self.views:
            return np.full(len(views[0][2]) - 1, np.nan if self.share is None else self.share)
        z = [v.logits(x) * c[0] + c[1] for v, x, c in zip(self.views, views, self.calibrate)]
        return 1 / (1 + np.exp(-np.clip(z[0] * self.combine[0] + z[1] * self.combine[1] + self.combine[2], -30, 30)))


def _sure(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and whether they are beyond SURE on either side."""
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    return p, np.maximum(p, 1 - p) >= SURE


def _precise(right: np.ndarray, chosen: np.ndarray, share: float) -> bool:
    """Whether enough rows are chosen and enough of them right, for a class of this share."""
    return chosen.sum() >= GATE_ROWS and bool(right[chosen].mean() >= max(GATE, (1 + share) / 2))


class Model:
    def __init__(self, mean: np.ndarray, std: np.ndarray, heads: list[Classifier]):
        self.mean, self.std, self.heads = mean, std, heads


def _assemble(slots, values, dense, meta, mean, std) -> list:
    """Rows of the two views. The dense counts are the text view's last slots."""
    d = (dense - mean) / std
    n = len(slots)
    idx = np.concatenate([np.concatenate([s, (1 << TEXT_BITS) + np.arange(DENSE)]) for s in slots]) if n else np.zeros(0, np.int64)
    val = np.concatenate([np.concatenate([v, r]) for v, r in zip(values, d)]) if n else np.zeros(0)
    start = np.concatenate([[0], np.cumsum([len(s) + DENSE for s in slots])]).astype(np.int64)
    return [(idx.astype(np.int64), val, start), (meta.ravel(), np.ones(meta.size), np.arange(0, 4 * n + 1, 4))]


_KEY = ("part", "place", "doc_id", "h1", "h2")
_FEATURES = "part int, place long, doc_id long, h1 long, h2 long, quality int, toxic int, slots binary, vals binary, dense binary, meta binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, quality, toxic, text, lang, source) to keys and labels with the features of both views."""
    k = len(_KEY)
    for b in batches:
        lang, source = b.column(k + 3).to_pylist(), b.column(k + 4).to_pylist()
        for lo, hi, buf, off in K.blocks(b.column(k + 2)):
            slots, values, dense = _rows(buf, off)
            meta = _meta_slots(lang[lo:hi], source[lo:hi], np.diff(off))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).slice(lo, hi - lo) for i in range(k + 2)), pa.array([s.astype("<i4").tobytes() for s in slots], pa.binary()), pa.array([v.astype("<f4").tobytes() for v in values], pa.binary()),
                 pa.array([r.tobytes() for r in dense], pa.binary()), pa.array([r.astype("<i4").tobytes() for r in meta], pa.binary())],
                names=[f.split()[0] for f in _FEATURES.split(", ")],
            )


def _first(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """n rows at most, the first by a hash of cols, which is their place."""
    place = F.xxhash64(F.lit("cotrain"), *cols)
    return df.withColumn("place", place).orderBy("place", *cols).limit(n)


def chosen(docs: DataFrame, marks: DataFrame, max_labelled: int, max_pool: int) -> DataFrame:
    """Keys (part, place, doc_id, h1, h2, quality, toxic) of the rows to fit on: max_labelled of part 0 and max_pool of part 1, without their texts. All rows are told
    apart by doc_id and text; of equal texts without labels that of the smallest doc_id stands for all."""
    keys = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "cotrain-keys")
    drawn = F.broadcast(_first(marks, max_labelled, "doc_id").drop("place"))  # max_labelled rows of three numbers
    marked = _first(keys.join(drawn, "doc_id").dropDuplicates(["doc_id", "h1", "h2"]), max_labelled, "doc_id", "h1", "h2")
    share = min(1.0, 2 * max_pool / max(keys.select(F.approx_count_distinct("h1", 0.02)).first()[0], 1))
    some = keys.where(F.pmod(F.xxhash64(F.lit("pool"), "h1"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    pool = _first(some.join(marks.select("doc_id"), "doc_id", "left_anti"), max_pool, "h1", "h2").withColumns({c: F.lit(None).cast("int") for c in LABELS})
    cols = [*_KEY[1:], *LABELS]
    return materialize(marked.select(F.lit(0).alias("part"), *cols).unionByName(pool.select(F.lit(1).alias("part"), *cols)), "cotrain-chosen", True)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model:
    """Co-trained classifiers of docs (doc_id, text, lang, source) and labels (doc_id, quality, toxic). Texts are read twice, for keys and for the features of the
    chosen rows, and no task holds more of them than a batch."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.ceil(F.avg(c)).cast("int").alias(c) for c in LABELS))
    keys = chosen(docs, marks, max_labelled, max_pool)
    named = keys.select("part", "place", *(F.col(c).alias(f"k_{c}") for c in ("doc_id", "h1", "h2")), *LABELS)
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_doc_id")) & (h1 == F.col("k_h1")) & (h2 == F.col("k_h2"))
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(named), same)  # max_labelled + max_pool rows of numbers
    rows = rows.select("part", "place", *(F.col(f"k_{c}").alias(c) for c in ("doc_id", "h1", "h2")), *LABELS, "text", "lang", "source")
    every = rows.mapInArrow(_features, _FEATURES).dropDuplicates(list(_KEY)).toPandas().sort_values(list(_KEY))  # bounded by max_labelled and max_pool
    got = [every[every["part"] == p] for p in (0, 1)]
    parts = []
    for t in got:
        read = lambda c, d: [np.frombuffer(x, d) for x in t[c]]
        parts.append((read("slots", "<i4"), read("vals", "<f4"), np.array(read("dense", "f8")).reshape(-1, DENSE), np.array(read("meta", "<i4"), np.int64).reshape(-1, 4)))
    dense = np.concatenate([p[2] for p in parts])
    mean, std = (dense.mean(0), np.maximum(dense.std(0), 1e-3)) if len(dense) else (np.zeros(DENSE), np.ones(DENSE))
    x, rest = (_assemble(*p, mean, std) for p in parts)
    heads = []
    for c in LABELS:
        y = got[0][c].to_numpy(float) if len(got[0]) else np.zeros(0)
        ok = np.flatnonzero(~np.isnan(y))
        heads.append(Classifier().fit([_take(v, ok) for v in x], y[ok], rest))
    return Model(mean, std, heads)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            lang, source = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi, buf, off in K.blocks(b.column(1)):
                slots, values, dense = _rows(buf, off)
                views = _assemble(slots, values, dense, _meta_slots(lang[lo:hi], source[lo:hi], np.diff(off)), m.mean, m.std)
                p = [pa.array(h.predict(views), pa.float64(), from_pandas=True) for h in m.heads]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *p], names=["doc_id", *(f"{c}_score" for c in LABELS)])

    return score


def score(docs: DataFrame, model: Model, min_quality: float = 0.5, max_toxic: float = 0.5) -> DataFrame:
    """(doc_id, quality_score, toxic_score, kept, quality_views, toxic_views) for every row of docs; the last
    two name the views that a score combines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    scored = rows.mapInArrow(_score(shared), "doc_id long, quality_score double, toxic_score double")
    kept = F.coalesce(F.col("quality_score") >= min_quality, F.lit(True)) & F.coalesce(F.col("toxic_score") < max_toxic, F.lit(True))
    return scored.withColumns({"kept": kept, **{f"{c}_views": F.lit(h.used) for c, h in zip(LABELS, model.heads)}})


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
