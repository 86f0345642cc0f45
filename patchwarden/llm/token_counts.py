"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Documents up to ``chunk`` characters are encoded whole, in batches. A longer one is encoded in
chunks that overlap, with each token's offsets, and neighbouring chunks are spliced at a
boundary inside their overlap that is proven stable: both chunks have a token boundary there,
and no vocabulary piece contains the two characters on its sides next to each other. No merge can ever
cross such a place, in these chunks or in the whole text, so the tokens left of it depend on
the left side only and those right of it on the right side only, and the spliced counts equal
those of the whole text. Where an overlap has no such place, it is widened until it
does or reaches the end of the text; overlap and chunk grow sixteenfold each time, so a text without any
stable place is encoded about twice, not once a chunk.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are counted one by one;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as K

CHUNK = 32_768
OVERLAP = 256


class PieceCounter:
    """Counts tokens of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.joined = set()  # neighbouring characters inside some piece
        size = self.sp.get_piece_size()
        self.chars = np.zeros(size, np.int64)  # of a token; the first byte of a character counts as it
        for i in range(size):
            p = self.sp.id_to_piece(i).replace("▁", " ")
            if self.sp.is_byte(i):
                self.chars[i] = not 0x80 <= int(p[3:5], 16) <= 0xBF
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i)):
                self.joined.update(zip(p, p[1:]))
                self.chars[i] = len(p)
        self.widened = 0

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(small, self.sp.encode([texts[i] for i in small], num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.spliced(t)
        return out

    def _ends(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Ends of the tokens of text[lo:hi], as offsets in text; one character less for the
        dummy prefix. The bytes of a character that is no piece share one end."""
        return np.cumsum(self.chars[self.sp.encode(text[lo:hi], num_threads=1)]) + (lo - 1)

    def _stable(self, text: str, at: int) -> bool:
        a, b = text[at - 1], text[at]
        return (" " if a == "▁" else a, " " if b == "▁" else b) not in self.joined

    def spliced(self, text: str) -> int:
        total, lo, cut = 0, 0, 0  # tokens up to cut are counted; the next chunk is encoded from lo <= cut
        n, overlap, step = len(text), self.overlap, self.chunk
        hi = min(n, self.chunk)
        ends = self._ends(text, 0, hi)
        while hi < n:
            next_hi = min(n, hi + step)
            start = max(cut, hi - overlap)
            later = self._ends(text, start, next_hi)
            both = np.intersect1d(ends[(ends > start) & (ends < hi)], later)
            at = next((x for x in both[::-1].tolist() if self._stable(text, x)), None)
            if at is None:  # no proven common boundary: widen, by taking more on both sides
                overlap, step = 16 * overlap, 16 * step
                self.widened += 1
                if start == cut:
                    hi, ends = next_hi, later if start == lo else self._ends(text, lo, next_hi)
                continue
            total += int(((ends > cut) & (ends <= at)).sum() if cut else (ends <= at).sum())
            lo, cut, hi, ends, overlap, step = start, at, next_hi, later, self.overlap, self.chunk
        return total + (int((ends > cut).sum()) if cut else len(ends))


def token_counts(docs: DataFrame, model_file: str, max_tokens: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs: one map over the texts,
    without a shuffle. Each Python worker loads the model once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file, chunk, overlap)
        for b in batches:
            column = b.column(1)
            n_bytes = np.diff(K.text_buffer(column)[1])
            n_tokens = []
            for i in range(0, len(column), 256):
                n_tokens += counter.counts([t or "" for t in column.slice(i, 256).to_pylist()])
            n_tokens = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > max_tokens)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
