"""Periodic runs of words, after Stoye and Gusfield.

A run is a stretch of consecutive words with smallest period q, at least ``power`` periods and ``least`` words long, that no
neighbouring word extends with that period. Texts are handled in blocks of whole documents, block by block in a task:

1. A word of such a run stands ``power`` times in it. Words that are rarer in their document, and again in the stretches that
   are left, end a stretch; most texts have none that is long enough. This is exact, it cuts no run.
2. The suffix tree of all stretches: prefix doubling gives the suffix array and, for each power of two, the exact names of
   the substrings of that length; the names give the longest common prefixes. Internal nodes are intervals of them, made
   binary, with the leaves of a node's two halves side by side. A word of another stretch is another letter, so no
   match leaves its stretch.
3. At each node of depth d the leaves of the smaller half are visited: n log n visits at most. If i is a leaf of one half
   and i + d (or i - d) of the other, a branching tandem repeat of root length d begins at i (or i - d): its rotation
   by one word to the right is none.
4. Repeats are rotated to the left as far as they go, by the names of step 2: repeat and rotations are one maximal
   run. Repeats whose root is a power of a shorter one merge with the run of the shorter root.

Words are told apart by 64-bit hashes. Defined results: null, empty and wordless texts have no runs and an empty collapsed text; a row of
the input is a row of the result, with its doc_id as it is, null and repeated ones too; other columns are left out; an
empty table gives an empty result. Memory follows the longest stretch that step 1 leaves: some 4 * log2(longest repeat) bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K

LEAST, POWER = 6, 4
#: (leaf, node) visits that are looked at together
VISITS = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _stretches(letter: np.ndarray, least: int, power: int, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, letters, pieces) of the words that may stand in a run. letter and piece: word and document of each place;
    the pieces that come back are stretches, the letters differ between them."""
    at = np.arange(len(letter))
    while True:
        _, back, n = np.unique(K.mix64(letter + K.mix64(piece.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        keep = n[back] >= power
        whole = keep.all()
        at, letter, piece = at[keep], letter[keep], piece[keep]
        if not len(at):
            return at, back[keep], piece
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
        piece = np.cumsum(new) - 1
        long = np.bincount(piece)[piece] >= least
        if whole and long.all():
            return at, back, piece
        at, letter, piece = at[long], letter[long], piece[long]


def _names(letter: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """names[k][i]: a number that two places share if, and only if, the same 2**k letters (fewer where their
    stretch ends, so only the place itself) follow; ordered as the substrings. The last list has no number twice."""
    n = len(letter)
    name = np.unique(letter, return_inverse=True)[1].astype(np.int32)
    out, step, here = [name], 1, np.arange(n)
    while True:
        nxt = here + step
        follow = np.where(nxt < end, name[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
        # a place whose stretch ends here has a name of its own already, or gets one by 0
        values, name = np.unique(name.astype(np.int64) * (n + 1) + follow, return_inverse=True)
        name = name.astype(np.int32)
        out.append(name)
        if len(values) == n:
            return out
        step *= 2


def _common(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes at i and j, i and j never equal."""
    i, j, n = i.copy(), j.copy(), len(names[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(names) - 2, -1, -1):
        same = (i < n) & (j < n)
        same[same] = names[k][i[same]] == names[k][j[same]]
        for x in (out, i, j):
            x[same] += 1 << k
    return out


def _halves(lcp: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For some splits k of the suffix array (between k - 1 and k): first and last place of the node's interval, where
    of equal depths the leftmost split is the upper one."""
    levels = [lcp]
    while 2 << (len(levels) - 1) <= len(lcp):
        a, h = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(a[:-h], a[h:]))
    d, lo, hi = lcp[nodes], nodes.copy(), nodes.copy()
    for k in range(len(levels) - 1, -1, -1):
        a, w = levels[k], 1 << k
        left = lo - w >= 0
        left[left] = a[lo[left] - w] > d[left]
        lo[left] -= w
        right = hi + w < len(lcp)
        right[right] = a[hi[right] + 1] >= d[right]
        hi[right] += w
    return lo - 1, hi


def _repeats(names: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, root length) of the branching tandem repeats with roots of up to ``longest`` letters."""
    rank = names[-1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    n = len(rank)
    lcp = np.concatenate([[-1], _common(names, order[:-1], order[1:])])  # lcp[k]: of the places k - 1 and k in the order
    nodes = np.flatnonzero((lcp > 0) & (lcp <= longest))
    if not len(nodes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = _halves(lcp, nodes)
    depth = lcp[nodes]
    small = nodes - first <= last - nodes + 1  # whether the left half is the smaller one
    lo, size = np.where(small, first, nodes), np.where(small, nodes - first, last - nodes + 1)
    other, other_end = np.where(small, nodes, first), np.where(small, last, nodes - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(size)
    a = 0
    while a < len(nodes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + VISITS, "right")))
        node = np.repeat(np.arange(a, b), size[a:b])
        leaf = order[lo[node] + np.arange(len(node)) - np.repeat(ends[a:b] - size[a:b] - (ends[a - 1] if a else 0), size[a:b])]
        for way in (1, -1):
            mate = leaf + way * depth[node]
            ok = np.flatnonzero((mate >= 0) & (mate < n))
            r = rank[mate[ok]]
            ok = ok[(r >= other[node[ok]]) & (r <= other_end[node[ok]])]
            found.append((np.minimum(leaf[ok], mate[ok]), depth[node[ok]]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found))


def _rotated(names: list[np.ndarray], start: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """First places of the runs that end with the repeats (at, d): rotated to the left as long as letters d apart agree."""
    at = at.copy()
    for k in range(len(names) - 2, -1, -1):
        w = 1 << k
        back = at - w >= start[at]
        back[back] = names[k][at[back] - w] == names[k][at[back] - w + d[back]]
        at[back] -= w
    return at


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (first place, length, period) of all runs, sorted. words: a 64-bit number for each word, doc: its document."""
    at, letter, piece = _stretches(words, least, power, doc)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    size = np.bincount(piece)
    end = np.cumsum(size)[piece]
    start = end - size[piece]
    names = _names(letter, end)
    i, d = _repeats(names, max(int(size.max()) // power, 1))
    stop = i + 2 * d
    near = stop - start[i] >= np.maximum(least, power * d)  # a run cannot begin before its stretch
    i, d, stop = i[near], d[near], stop[near]
    first = _rotated(names, start, i, d)
    length = stop - first
    ok = length >= np.maximum(least, power * d)
    runs = np.stack([at[first[ok]], length[ok], d[ok]], 1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # one place and length: the smallest period is the root, the others are its powers
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _search(least: int, power: int):
    """(doc_id, text) to SCHEMA."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")[:6]] + ["runs", "collapsed"]
        for b in batches:
            for lo, hi, buf, off in K.blocks(b.column(1)):
                w = K.words(buf, off, K.NOT_SPACE)
                doc = w.doc
                runs = find_runs(K.span_hash(K.prefix_hash(buf), w.starts, w.ends), doc, least, power)
                cut = np.searchsorted(runs[:, 0], w.first)
                n_runs = np.diff(cut)
                best: list[tuple] = [(None, None, None)] * (hi - lo)
                listed: list[list] = [[] for _ in range(hi - lo)]
                raw = buf.tobytes()
                texts: list = [b" ".join(raw[x:y].split()) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                for k in np.flatnonzero(n_runs).tolist():
                    base = int(w.first[k])
                    own = [(s - base, n, q) for s, n, q in runs[cut[k] : cut[k + 1]].tolist()]
                    best[k] = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                    listed[k] = [dict(zip(("start", "length", "period"), r)) for r in sorted(own, key=lambda r: (r[0], r[2]))]
                    edge = np.zeros(int(w.count[k]) + 1, np.int64)
                    for s, n, q in own:
                        edge[s + q] += 1
                        edge[s + n] -= 1
                    parts = texts[k].split(b" ")
                    texts[k] = b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
                cols = [b.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(n_runs.astype(np.int64)), *(pa.array([x[c] for x in best], pa.int64()) for c in range(3)), pa.array(listed, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            K.release()

    return search


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_runs, the run with the greatest length / period (start, length, period: ties go
    to the smallest start, then period; null without runs), all runs by start and period, and the text collapsed: a word that
    stands in any run after its first period goes, the others are joined by one space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(least, power), SCHEMA)
