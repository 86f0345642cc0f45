"""Language identification: words first, shorter and shorter character n-grams for the rest.

Each known word scores every language by the log of its frequency there. A word that is not known is
scored by the longest character n-grams (5, then 4, ... 1) of which it has a known one. Scores
add up over a document's words; the best language wins (ties: the first by name), and its
posterior among the learned languages is the score.

The model is fitted on a bounded sample of labelled rows: about ``per_lang`` different texts of each
language and ``max_sample`` of all (all where there are fewer), chosen by a hash of the text, so neither
a hot doc_id nor a text that stands in a third of all rows enlarges it. Whole texts are read, and every word and
n-gram of the sample is in the model with its counts in every language; counts are made once, on the executors,
and what is collected and broadcast is bounded by the sample. Prediction
covers every row with whole texts in one map, without a shuffle.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where no
language could be learned; rows are judged one by one; a text repeated in a language is learned
from once; rows with null lang or text are never learned from; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as K
from ._shared import materialize

#: texts that a model is fitted on: of a language, of all languages
PER_LANG = 2000
MAX_SAMPLE = 20_000
ORDER = 5
#: n-grams that are looked up at once
STEP = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial counts (lang, ord, gram, n); ord 0 are words."""
    import re

    word = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
    lower = str.maketrans({chr(b): chr(b + 32) for b in range(0x41, 0x5B)})
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(word.findall((text or "").translate(lower)))
        for lang, words in counts.items():
            grams = Counter()
            for w, n in words.items():
                grams[0, w] += n
                for k in range(1, ORDER + 1):
                    for i in range(len(w) - k + 1):
                        grams[k, w[i : i + k]] += n
            items = list(grams.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([x[0][0] for x in part], pa.int32()), pa.array([x[0][1] for x in part]), pa.array([x[1] for x in part], pa.int64())], names=["lang", "ord", "gram", "n"])


class Model:
    """Per order (0: words): sorted 64-bit hashes, the score of what a language has not, and of each
    hash the languages that have it with what they score above that."""

    def __init__(self, langs: list[str], orders: list[tuple[np.ndarray, ...]]):
        self.langs, self.orders = langs, orders

    def lookup(self, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, rows of scores) of hashes."""
        keys, start, lang, above, none = self.orders[order]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros((len(h), len(self.langs)))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        out = np.repeat(none[None, :], len(h), 0)
        row = np.flatnonzero(known)
        first = start[at[row]]
        n = start[at[row] + 1] - first
        entry = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        out[np.repeat(row, n), lang[entry]] += above[entry]
        return known, out


def _hash_strings(strings: pa.Array | pa.ChunkedArray) -> np.ndarray:
    buf, off = K.text_buffer(strings)
    return K.span_hash(K.prefix_hash(buf), off[:-1], off[1:])


def fit(train: DataFrame, per_lang: int = PER_LANG, max_sample: int = MAX_SAMPLE) -> Model:
    """A model of train (lang, text; non-null lang)."""
    h1, h2 = F.xxhash64(F.lit("language sample"), "text"), F.xxhash64(F.lit("language text"), "text")
    train = train.where("text IS NOT NULL").select("lang", "text", h1.alias("h1"), h2.alias("h2"))
    sizes = {r.lang: max(r.n, 1) for r in train.groupBy("lang").agg(F.approx_count_distinct("h1", 0.02).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    nothing = (np.zeros(0, np.uint64), np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros(len(langs)))
    if not langs:
        return Model([], [nothing] * (ORDER + 1))
    each = min(per_lang, max(1, max_sample // len(langs)))
    share = F.coalesce(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))))[F.col("lang")], F.lit(1.0))
    chosen = train.where(F.pmod("h1", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "h1", "h2"])
    counts = chosen.select("lang", "text").mapInArrow(_gram_counts, "lang string, ord int, gram string, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    rows = materialize(counts, "language-counts").toArrow()  # bounded by the sample
    number = {g: j for j, g in enumerate(langs)}
    orders = []
    for o in range(ORDER + 1):
        part = rows.filter(pc.equal(rows.column("ord"), o))
        if not part.num_rows:
            orders.append(nothing)
            continue
        h, n = _hash_strings(part.column("gram")), part.column("n").to_numpy()
        lang = np.array([number[g] for g in part.column("lang").to_pylist()])
        by = np.lexsort((lang, h))
        h, n, lang = h[by], n[by], lang[by]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.bincount(lang, n, len(langs)) + 1.0
        orders.append((h[start], np.append(start, len(h)), lang.astype(np.int32), (np.log(n + 0.5) - np.log(0.5)).astype(np.float32), np.log(0.5 / total)))
    return Model(langs, orders)


def _word_scores(m: Model, buf: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Scores (words x languages) of distinct words."""
    known, out = m.lookup(0, h)
    out = np.where(known[:, None], out, 0.0)
    left = np.flatnonzero(~known)
    if len(left):
        cp = np.append(np.flatnonzero(K.code_points(buf)), len(buf))  # ends of n-grams are starts of code points
        first, last = np.searchsorted(cp, starts), np.searchsorted(cp, ends)
        for k in range(ORDER, 0, -1):
            n = np.maximum(last[left] - first[left] - k + 1, 0)
            if n.sum():
                word = np.repeat(np.arange(len(left)), n)
                i = first[left][word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
                hits, score = np.zeros(len(left)), np.zeros((len(left), len(m.langs)))
                for a in range(0, len(word), STEP):
                    w, c = word[a : a + STEP], i[a : a + STEP]
                    ok, s = m.lookup(k, K.span_hash(sums, cp[c], cp[c + k]))
                    w, s = w[ok], s[ok]
                    hits += np.bincount(w, minlength=len(left))
                    for j in range(len(m.langs)):
                        score[:, j] += np.bincount(w, s[:, j], len(left))
                got = hits > 0
                out[left[got]] = score[got] / hits[got, None]
                left = left[~got]
            if not len(left):
                break
    return out


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            column = b.column(2)
            pred: list[str] = []
            score: list[np.ndarray] = []
            for lo, hi, raw, off in K.blocks(column):
                buf = K.LOWER[raw]
                n = hi - lo
                w = K.words(buf, off, K.LETTERS)
                sums = K.prefix_hash(buf)
                h = K.span_hash(sums, w.starts, w.ends)
                total = np.zeros((n, max(1, len(m.langs))))
                if len(h) and m.langs:
                    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
                    s = _word_scores(m, buf, sums, w.starts[at], w.ends[at], h[at])[inv]
                    doc = w.doc
                    for j in range(len(m.langs)):
                        total[:, j] = np.bincount(doc, s[:, j], n)
                e = np.exp(total - total.max(1, keepdims=True))
                best = total.argmax(1)
                letters = K.per_doc((buf >= 0x61) & (buf <= 0x7A), off) > 0
                for d in np.flatnonzero(~letters):
                    letters[d] = any(c.isalpha() for c in column[lo + int(d)].as_py() or "")
                ok = letters & bool(m.langs)
                pred += [m.langs[j] if x else "und" for j, x in zip(best.tolist(), ok.tolist())]
                score.append(np.where(ok, 1 / e.sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, per_lang: int = PER_LANG, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text")
    return predict(docs, fit(train, per_lang, max_sample))
