"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the library's agenda: the candidate merge of the best score, leftmost among
equals, is applied until none is left. With dropout, each candidate (a pair of symbols at a place
of a document) is skipped when a hash keyed by seed, document and the candidate's span falls
below the rate. A skipped candidate never returns, so the segmentation varies with seed,
document and place, yet any task that repeats the work finds the same one. With dropout 0 the
ids are those of the library.

Words are independent, as no piece holds a space after another character; a block's words
run through the agenda together, one merge each a step, in whole-array numpy operations. Words of
more than LONG symbols use a heap, so a long unbroken text costs n log n.

Characters outside the vocabulary, and a literal U+2581, become byte tokens: every text decodes
to itself, white space and all. Defined results: null texts have null ids and decode to null,
empty texts have none; rows are encoded one by one, and rows with equal doc_id and text get
equal ids; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as K

LONG = 128
_NONE = np.int32(np.iinfo(np.int32).max)
#: bytes of texts whose words run through the agenda together; small enough for the cache
BLOCK = 1 << 17
_SPACE = 0x2581
_M = (1 << 64) - 1


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback, as arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = n = sp.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        pieces: dict[str, int] = {}
        text = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[p] = i
                text[i] = p.replace("▁", " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the model has pieces over word borders")
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.zeros(n, np.int64)
        rank[np.argsort(-scores, kind="stable")] = np.cumsum(np.diff(np.sort(-scores), prepend=-np.inf) > 0)
        chars = {c for p in pieces for c in p}
        ids = dict(pieces)
        for c in sorted(chars - set(pieces)):  # parts of pieces that are no piece themselves
            ids[c] = len(ids) + n
        self.char = np.full(0x110000, -1, np.int64)
        for c in chars:
            self.char[ord(c)] = ids[c]
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (i, int(rank[i]))
        self.pairs = pairs
        key = np.array(list(pairs), np.int64)
        value = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        bits = max(16, (4 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table_key = np.full((1 << bits) + 64, -1, np.int64)
        self.table_id = np.zeros((1 << bits) + 64, np.int32)
        self.table_rank = np.zeros((1 << bits) + 64, np.int32)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left):  # each free slot takes one key; the others move on by one
            at = slot[left] + self.probes
            free = self.table_key[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            t = at[take]
            self.table_key[t] = key[left[take]]
            self.table_id[t], self.table_rank[t] = value[left[take], 0], value[left[take], 1]
            left = left[~take]
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots in the table, whether the pair has an entry)."""
        key = (a.astype(np.int64) << 20) | b
        at = self._slot(key)
        got = self.table_key[at]
        ok = got == key
        left = np.flatnonzero(~ok & (got >= 0))
        for p in range(1, self.probes):
            if not len(left):
                break
            got = self.table_key[at[left] + p]
            hit = got == key[left]
            at[left[hit]] += p
            ok[left[hit]] = True
            left = left[~hit & (got >= 0)]
        return at, ok & (a >= 0) & (b >= 0)


def _keep(base, lo, mid, hi, rate: int):
    """Whether a candidate is not skipped; numpy arrays of uint64 or Python integers."""
    if isinstance(lo, int):
        x = (base + lo * 0xD6E8FEB86659FD93 + mid * 0xA0761D6478BD642F + hi * 0xE7037ED1A0B428DB) & _M
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & _M
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & _M
        x ^= x >> 32
        return x >= rate
    u = np.uint64
    return K.mix64(base + lo.astype(u) * u(0xD6E8FEB86659FD93) + mid.astype(u) * u(0xA0761D6478BD642F) + hi.astype(u) * u(0xE7037ED1A0B428DB)) >= u(rate)


class Encoder:
    def __init__(self, model: PieceModel, dropout: float = 0.0, seed: int = 0):
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be in [0, 1)")
        self.m, self.seed = model, seed
        self.rate = int(dropout * 2.0**64)

    def block(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        m = self.m
        sizes = np.array([len(t) + (len(t) > 0) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        cp = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if not len(cp):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        sym = m.char[cp]
        sym[cp == _SPACE] = -1
        gap = cp == 0x20
        sym[gap] = m.char[_SPACE]
        head = gap.copy()
        head[1:] &= ~gap[:-1]
        head[first[sizes > 0]] = True
        starts = np.flatnonzero(head)
        doc = np.repeat(np.arange(len(texts)), sizes)
        base = K.mix64(K.mix64(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(K.mix64(np.array([self.seed], np.int64).view(np.uint64))[0]))
        out = np.full(len(cp), -1, np.int64)
        length = np.diff(np.append(starts, len(cp)))
        for s, n in zip(starts[length > LONG].tolist(), length[length > LONG].tolist()):
            d = int(doc[s])
            self._heap(out, sym[s : s + n].tolist(), s, s - int(first[d]), int(base[d]))
        short = length <= LONG
        self._agenda(out, sym, np.repeat(short, length), starts[short], length[short], doc, first, base)
        # out holds a symbol at each token's first character; the rest is -2
        at = np.flatnonzero(out != -2)
        ids, owner = out[at], doc[at]
        odd = np.flatnonzero((ids < 0) | (ids >= m.size))
        if len(odd):
            u, inv = np.unique(cp[at[odd]], return_inverse=True)
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in u.tolist()]
            n = np.ones(len(ids), np.int64)
            n[odd] = np.array([len(c) for c in coded])[inv]
            put = np.repeat(np.cumsum(n) - n, n)
            which = np.arange(len(put)) - put
            long = np.repeat(ids, n)
            padded = np.zeros((len(u), 4), np.int64)
            for i, c in enumerate(coded):
                padded[i, : len(c)] = m.bytes[list(c)]
            row = np.full(len(ids), -1)
            row[odd] = inv
            row = np.repeat(row, n)
            b = row >= 0
            long[b] = padded[row[b], which[b]]
            ids, owner = long, np.repeat(owner, n)
        return ids, np.bincount(owner, minlength=len(texts))

    def _ranks(self, sym, nxt, pos, mid, end, base, rel):
        at, ok = self.m.merged(sym, nxt)
        rank = np.full(len(sym), _NONE, np.int32)
        i = np.flatnonzero(ok)
        if self.rate and len(i):
            i = i[_keep(base[i], pos[i] - rel[i], mid[i] - rel[i], end[i] - rel[i], self.rate)]
        rank[i] = self.m.table_rank[at[i]]
        return rank, at

    def _agenda(self, out, sym_all, use, starts, length, doc, first, base) -> None:
        pos = np.flatnonzero(use).astype(np.int32)
        out[pos] = -2
        if not len(pos):
            return
        sym = sym_all[pos].astype(np.int32)
        seg = np.repeat(np.arange(len(starts), dtype=np.int32), length)
        seg_doc = doc[starts]
        seg_base, seg_rel = base[seg_doc], first[seg_doc]
        stop = np.cumsum(length)  # rows' end of each segment
        end = np.append(pos[1:], np.int32(0))
        seg_end = starts + length
        end[stop - 1] = seg_end
        last = np.zeros(len(pos), bool)
        last[stop - 1] = True

        def ranked(rows):
            r = np.full(len(rows), _NONE, np.int32)
            slot = np.zeros(len(rows), np.int32)
            ok = ~last[rows]
            i = rows[ok]
            g = seg[i]
            r[ok], slot[ok] = self._ranks(sym[i], sym[i + 1], pos[i], pos[i + 1], end[i + 1], seg_base[g], seg_rel[g])
            return r, slot

        rank, slot = ranked(np.arange(len(pos)))
        count = length
        while True:
            head = np.cumsum(count) - count
            best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), head)
            live = best >> 32 != _NONE
            if not live.any():
                out[pos] = sym
                return
            at = best[live] & 0xFFFFFFFF
            sym[at] = self.m.table_id[slot[at]]
            end[at] = end[at + 1]
            last[at] = last[at + 1]
            keep = np.repeat(live, count)
            if not live.all():  # finished words leave
                gone = np.flatnonzero(~keep)
                out[pos[gone]] = sym[gone]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            rows = np.flatnonzero(keep)
            sym, seg, pos, end, last, rank, slot = (x[rows] for x in (sym, seg, pos, end, last, rank, slot))
            count = count[live] - 1
            before = at[at > np.cumsum(count) - count] - 1
            rows = np.concatenate([at, before])
            rank[rows], slot[rows] = ranked(rows)

    def _heap(self, out, sym: list[int], offset: int, rel: int, base: int) -> None:
        """The agenda of one long word; positions in candidates' keys count from the document's start."""
        n = len(sym)
        pairs = self.m.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap: list[tuple] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (got := pairs.get(sym[i] << 20 | sym[j])):
                if not self.rate or _keep(base, rel + i, rel + j, rel + end[j], self.rate):
                    heapq.heappush(heap, (got[1], i, j, end[j], got[0]))

        for i in range(n - 1):
            push(i)
        alive = [True] * n
        while heap:
            _, i, j, e, new = heapq.heappop(heap)
            if not alive[i] or nxt[i] != j or end[j] != e or end[i] != j:
                continue
            sym[i], end[i], nxt[i] = new, e, nxt[j]
            alive[j] = False
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        out[offset : offset + n] = np.where(alive, sym, -2)


def decode_block(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of runs of ids; the dummy prefix of each is taken off."""
    n = model.start[ids + 1] - model.start[ids]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(model.start[ids] - (ends - n), n)
    raw = model.text[at].tobytes()
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(bounds, bounds[1:])]


_models: dict[str, PieceModel] = {}


def load(model_file: str) -> PieceModel:
    """The model, built once a Python worker."""
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def sp_encode(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 0, column: str = "token_ids", proof: str | None = None) -> DataFrame:
    """docs and a column array<int> of token ids. One map, without a shuffle. With proof, one more
    column of that name: whether the ids decode to the text, found in the same worker."""
    names = [c for c in docs.columns if c not in (column, proof)]
    rows = docs.select(*names)
    key = rows.columns.index("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load(model_file), dropout, seed)
        for b in batches:
            texts = b.column(names.index("text"))
            keys = b.column(key).cast(pa.int64()).fill_null(K.NO_ID).to_numpy()
            for lo, hi, _, _ in K.blocks(texts, BLOCK):
                part = texts.slice(lo, hi - lo)
                whole = [t or "" for t in part.to_pylist()]
                ids, counts = enc.block(whole, keys[lo:hi])
                off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)), mask=part.is_null())
                more = [pa.array([x == t for x, t in zip(decode_block(enc.m, ids, counts), whole)], pa.bool_())] if proof else []
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in b.columns), lists, *more], names=[*names, column, *([proof] if proof else [])])
            K.release()

    fields = [T.StructField(column, T.ArrayType(T.IntegerType())), *([T.StructField(proof, T.BooleanType())] if proof else [])]
    return rows.mapInArrow(encode, T.StructType([*rows.schema, *fields]))


def sp_decode(rows: DataFrame, model_file: str, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows and the text that their token ids stand for; columns pass through, but a former ``into``."""
    names = [c for c in rows.columns if c != into]
    rows = rows.select(*names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model_file)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column(names.index(column))
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().fill_null(0).to_numpy()
                texts = pa.array([None if n else t for t, n in zip(decode_block(m, ids, counts), lists.is_null().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*names, into])
            K.release()

    return rows.mapInArrow(decode, T.StructType([*rows.schema, T.StructField(into, T.StringType())]))


def codec_report(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_hash, lossless): encoded, decoded and compared."""
    coded = sp_encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_file, dropout, seed, proof="lossless")
    return coded.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"), "lossless",
    )
