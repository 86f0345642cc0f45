"""Alignment of the tokens of two tokenizers, and corpus-wide counts of linked token ids.

A is a byte-level BPE in a tokenizers .json file and sees a space before the text; B is a BPE model of sentencepiece with byte fallback,
which adds that space itself. Both cut the same bytes, so a token is a range of bytes. Byte offsets where an A and
a B token both end cut a text's tokens into groups; the two tokens that end there are linked.

The relational form is one table of tokens for each side: (unit, position, id) with the running sum of lengths as end, an
equi-join of the sides on (unit, end), the running count of these cuts as a token's group, the joined rows as links. A unit is the
piece of text from a space behind a character that is none up to the next such space: no token of either side crosses its ends (A's
pre-tokenizer begins a token there, no piece of B has a space behind anything else; both are checked when the files are
read). So each run of documents aligns each of its different units once, whatever their number of occurrences, and a document is the
sequence of its units. The tables of a run live in a task as columns: exploding every token of the corpus into Spark rows
costs some forty bytes of shuffle a byte of text (see ``exploded`` and the README). The part that is about the whole corpus, the
counts of id pairs, is Spark's: summed in each run, then by a shuffle, and the best count of each B id by a second one.

Counts come back to the documents without a shuffle of the links: a document carries its different pairs packed, the pairs with at
least 1 / BROADCAST of all links (BROADCAST at most) are broadcast as arrays, only the rarer ones are shuffled.

Defined results: null and empty texts, and texts whose joined bytes on either side differ from space + text (such as those with U+2581), have no tokens:
zeros and empty groups. Rows are told apart by a number of their own, so null and repeated doc_ids are rows like others; other columns are left
out; an empty table gives an empty result. Pairs of equal count are all best. Different units with one 64-bit hash would be taken for each other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as K
from ._shared import materialize

#: bytes of text in a run
RUN_BYTES = 8 << 20
#: pairs of ids that are broadcast at most: 13 bytes each
BROADCAST = 1 << 20
#: The pre-tokenizer's pattern of byte-level BPE files that name no other (a fixed value of that format).
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"


class Side(NamedTuple):
    """A tokenizer: its bytes of each id, and the ids of a text that begins with a space."""

    tokens: list[bytes]
    encode: object

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.tokens], np.int64)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def byte_side(path: str) -> Side:
    """A byte-level BPE file. Where its ids follow its merges, ranks give the same tokens and a faster library reads them;
    any other file is left to the library it is made for."""
    import tiktoken
    from tokenizers import Tokenizer

    @cache
    def library() -> Tokenizer:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return t

    def own(text: str) -> list[int]:
        return library().encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if kind["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without normalizer and added space is needed")
    alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    tokens = [b""] * (max(kind["vocab"].values()) + 1)
    for t, k in kind["vocab"].items():
        tokens[k] = t.encode() if t in special else bytes(alphabet[c] for c in t)
    merges = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
    ids = [kind["vocab"]["".join(m)] for m in merges]
    ranks = {tokens[k]: k for t, k in kind["vocab"].items() if t not in special}
    single = [k for t, k in ranks.items() if len(t) == 1]
    if pre.get("use_regex", True) and ids == sorted(ids) and len(ids) == len(set(ids)) and len(single) + len(ids) == len(ranks) and max(single) < min(ids):
        fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return Side(tokens, lambda text: own(text) if long_space(text) else fast.encode_ordinary(text))
    return Side(tokens, own)


#: white space of twice this length has a block of it
SPACE_BLOCK = 1 << 15


def long_space(text: str) -> bool:
    """Whether a block of the text is nothing but white space: the faster library's pattern stops at some hundred thousands of it in a row."""
    return any(text[k].isspace() and text[k : k + SPACE_BLOCK].isspace() for k in range(0, len(text), SPACE_BLOCK))


@cache
def piece_side(path: str) -> Side:
    """A sentencepiece model that adds a space in front and whose pieces have spaces only in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(k) or sp.is_unknown(k):
            tokens.append(b"")
        else:
            tokens.append(piece.replace(_SPACE, " ").encode())
            if " " in tokens[-1].decode().lstrip(" "):
                raise ValueError("a piece has a space inside, so units would not be independent")
    if b"".join(tokens[i] for i in sp.encode("a  b")) != b" a  b":
        raise ValueError("a model that keeps spaces and adds one in front is needed")
    return Side(tokens, lambda text: sp.encode(text[1:]))


def closed(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space: one outside ASCII that might be one counts as one."""
    before = buf[at - 1]
    ok = (before > 0x20) & (before != 0x7F)
    wide = np.flatnonzero(before >= 0x80)
    two, three = buf[np.maximum(at[wide] - 2, 0)], buf[np.maximum(at[wide] - 3, 0)]
    ok[wide] = (two != 0xC2) & ((three < 0xE1) | (three > 0xE3))
    return ok


def unit_starts(buf: np.ndarray) -> np.ndarray:
    """Whether a unit may begin at a byte: a space behind a character that is no white space."""
    cut = np.zeros(len(buf), bool)
    sp = np.flatnonzero(buf[1:] == 0x20) + 1
    cut[sp[closed(buf, sp)]] = True
    return cut


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below n, from the left, and how many there are."""
    text = [str(k).encode() for k in range(n)]
    width = max(map(len, text))
    return np.frombuffer(b"".join(t.ljust(width + 1, b"\0") for t in text), np.uint8).reshape(n, width + 1), np.array([len(t) for t in text], np.int64)


class Aligned(NamedTuple):
    """Units: token numbers of both sides, groups, whether the bytes are right, places of its groups in a text (each with a ; behind), and the
    place of its linked ids, n_groups of them, in pair as a << 32 | b."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    right: np.ndarray
    text: bytes
    text_at: np.ndarray
    text_end: np.ndarray
    pair: np.ndarray
    pair_at: np.ndarray


def _coded(side: Side, units: list[bytes], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray] | list[bool]:
    """(ids, lengths) of units one after another, or which units come back as they were if not all do. Those that are ``joined``, the first ones, are encoded as one
    text, whose tokens cannot cross them."""
    n = int(joined.sum())
    text = b"".join(units[:n])
    ids = side.encode(text.decode()) if n else []
    ends = np.cumsum(side.lengths[np.array(ids, np.int64)])
    parts = [ids]
    if b"".join([side.tokens[k] for k in ids]) != text or not np.isin(np.cumsum([len(u) for u in units[:n]]), ends, assume_unique=True).all():
        parts, n = [], 0
    parts += [side.encode(u.decode()) for u in units[n:]]
    if n < len(units):
        right = [b"".join([side.tokens[k] for k in p]) == u for p, u in zip(parts[1 if n else len(parts) - len(units) :], units[n:])]
        if not all(right):
            return [True] * n + right
    ids = np.array([k for p in parts for k in p], np.int64)
    return ids, side.lengths[ids]


def align_units(units: list[bytes], joined: np.ndarray, a: Side, b: Side) -> Aligned:
    """Both sides of units that each begin with a space. joined: those that no white space ends."""
    n_units = len(units)
    by = np.argsort(~joined, kind="stable")  # the others stand behind, each on its own
    units, joined = [units[k] for k in by.tolist()], joined[by]
    right = np.ones(n_units, bool)
    while True:
        kept = np.flatnonzero(right)
        now = units if len(kept) == n_units else [units[k] for k in kept.tolist()]
        coded = [_coded(side, now, joined[kept]) for side in (a, b)] if now else []
        wrong = [c for c in coded if isinstance(c, list)]
        if not wrong:
            break
        right[kept[~np.all(wrong, 0)]] = False
    size = np.where(right, [len(u) for u in units], 0)
    out = _aligned(coded, size, a, b) if coded else (np.zeros(n_units, np.int64),) * 3 + (b"", np.zeros(n_units + 1, np.int64), np.zeros(0, np.int64))
    n_a, n_b, n_groups, text, text_off, pair = out
    pair_off = np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int64)
    back = np.argsort(by)  # to the order that was asked for
    return Aligned(n_a[back], n_b[back], n_groups[back], right[back], text, text_off[:-1][back], text_off[1:][back], pair, pair_off[:-1][back])


def _aligned(coded: list, size: np.ndarray, a: Side, b: Side) -> tuple:
    """Both sides' tokens of units with these sizes in bytes (0: left out): numbers of tokens and groups, groups as text with offsets, linked pairs."""
    n_units = len(size)
    stop = np.cumsum(size)
    (ia, la), (ib, lb) = coded
    ea, eb = np.cumsum(la), np.cumsum(lb)
    ua, ub = np.searchsorted(stop, ea), np.searchsorted(stop, eb)  # the unit of each token
    cut, at_a, at_b = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    ga, gb = np.searchsorted(cut, ea), np.searchsorted(cut, eb)  # the running count of cuts before a token's end
    # tokens as text: the groups one after another, in each A's then B's tokens
    by = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
    ids = np.concatenate([ia, ib])[by]
    mark = np.full(len(ids), ord(","), np.uint8)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    mark[place[at_a]] = ord("|")
    mark[place[len(ia) + at_b]] = ord(";")
    digits, width = _table(len(a.tokens), len(b.tokens))
    chars, w = digits[ids], width[ids]
    chars[np.arange(len(ids)), w] = mark
    flat = chars[np.arange(chars.shape[1]) <= w[:, None]]
    ucut = np.searchsorted(stop, cut)
    n_groups = np.bincount(ucut, minlength=n_units)
    text_size = np.bincount(np.concatenate([ua, ub])[by], w + 1, n_units).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(text_size)]).astype(np.int64)
    return np.bincount(ua, minlength=n_units), np.bincount(ub, minlength=n_units), n_groups, flat.tobytes(), off, ia[at_a] << 32 | ib[at_b]


@cache
def _table(n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    return _decimals(max(n_a, n_b))


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary, pair long, n long"
_NAMES = [f.split()[0] for f in _ALIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in _ALIGNED.split(", ")]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one after another."""
    stop = np.cumsum(counts)
    return np.repeat(starts - (stop - counts), counts) + np.arange(stop[-1] if len(stop) else 0)


def _documents(path_a: str, path_b: str, run_bytes: int):
    """(doc_id, text) to a row for each document, with its different pairs and their numbers packed, and rows (pair, n) of a
    run's pairs."""

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)

    def run(ids: list, texts: list[bytes], row: int) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(path_a), piece_side(path_b)
        full = np.array([len(t) > 0 for t in texts], bool)
        whole = np.frombuffer(b"".join([b" " + t for t in texts if t]), np.uint8)
        size = np.array([len(t) + 1 for t in texts if t], np.int64)
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        n_docs = len(texts)
        out = {c: np.zeros(n_docs, np.int64) for c in ("n_a", "n_b", "n_groups")}
        sha, packed, times = [""] * n_docs, [b""] * n_docs, [b""] * n_docs
        if len(whole):
            cut = unit_starts(whole)
            cut[off[:-1]] = True
            for x, t in zip(off[:-1].tolist(), (t for t in texts if t)):
                if t.endswith(b" "):  # spaces at the end belong to the last unit
                    cut[x + 1 + len(t.rstrip(b" "))] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(whole))
            key = K.span_hash(K.prefix_hash(whole), starts, ends)
            _, first, unit = np.unique(key, return_index=True, return_inverse=True)
            raw = whole.tobytes()
            al = align_units([raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())], closed(whole, ends[first]), a, b)
            del key, cut
            u_off = np.searchsorted(starts, off)
            bad = np.concatenate([[0], np.cumsum(~al.right[unit])])
            good = bad[u_off[1:]] == bad[u_off[:-1]]
            docs = np.flatnonzero(full)
            for c, v in (("n_a", al.n_a), ("n_b", al.n_b), ("n_groups", al.n_groups)):
                s = np.concatenate([[0], np.cumsum(v[unit])])
                out[c][docs] = np.where(good, s[u_off[1:]] - s[u_off[:-1]], 0)
            pieces = [al.text[x:y] for x, y in zip(al.text_at.tolist(), al.text_end.tolist())]
            _, code = np.unique(al.pair, return_inverse=True)
            values = al.pair[np.unique(code, return_index=True)[1]] if len(code) else al.pair
            total = np.zeros(len(values), np.int64)
            for k, (d, x, y, fine) in enumerate(zip(docs.tolist(), u_off[:-1].tolist(), u_off[1:].tolist(), good.tolist())):
                if not fine:
                    continue
                own = unit[x:y]
                sha[d] = hashlib.sha256(b"".join([pieces[i] for i in own.tolist()])[:-1]).hexdigest()
                links = np.sort(code[_expand(al.pair_at[own], al.n_groups[own])])
                at = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
                n = np.diff(np.append(at, len(links)))
                total[links[at]] += n
                p = values[links[at]]
                packed[d] = (p >> 32).astype("<u4").tobytes() + (p & 0xFFFFFFFF).astype("<u4").tobytes()
                times[d] = n.astype("<u4").tobytes()
            seen = np.flatnonzero(total)
            yield batch(len(seen), pair=values[seen], n=total[seen])
            del al, pieces, unit, raw
        lo = 0
        step = 2000
        while lo < n_docs:
            s = slice(lo, lo + step)
            m = len(ids[s])
            yield batch(m, row=np.arange(row + lo, row + lo + m), doc_id=ids[s], groups_sha256=sha[s], pairs=packed[s], times=times[s], **{c: v[s] for c, v in out.items()})
            lo += step
        K.release()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids.append(d)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= run_bytes:
                    yield from run(ids, texts, row)
                    row += len(ids)
                    ids, texts, size = [], [], 0
        if ids:
            yield from run(ids, texts, row)

    return documents


def _scored(known):
    """Documents with packed pairs to (row, n_best, count_sum, rare): sums over the pairs that are known, and the others as they are."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for packed, times in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                two = np.frombuffer(packed, "<u4").reshape(2, -1).astype(np.int64)
                pair, n = two[0] << 32 | two[1], np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                out[0].append(int(n[hit][best[at[hit]]].sum()))
                out[1].append(int((n[hit] * counts[at[hit]]).sum()))
                out[2].append([{"pair": p, "times": m} for p, m in zip(pair[~hit].tolist(), n[~hit].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))], names=["row", "n_best", "count_sum", "rare"])

    return scored


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n) of runs to (a, b, pair, count, best): the links of each pair, and whether no pair with its b has more."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.expr("pair & 4294967295"))
    top = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(top, "b").select(F.shiftright("pair", 32).alias("a"), "b", "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, run_bytes: int = RUN_BYTES, most: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the table of linked id pairs: a, b,
    pair, count, best). n_best: links whose count is the highest of their b; count_sum: sum of the counts over the links."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(rows.mapInArrow(_documents(path_a, path_b, run_bytes), _ALIGNED), "align-documents")
    counts = materialize(pair_counts(seen.where("row IS NULL").select("pair", "n")), "align-pairs", True)
    n, total = counts.agg(F.count("*"), F.sum("count")).first()
    hot = F.lit(True) if n <= most else F.col("count") >= -(-total // most)
    top = counts.where(hot).select("pair", "count", "best").toArrow()
    key, count, best = (top.column(c).to_numpy() for c in ("pair", "count", "best"))
    by = np.argsort(key)
    known = spark.sparkContext.broadcast((key[by], count[by], best[by]))
    documents = seen.where("row IS NOT NULL")
    scored = documents.select("row", "pairs", "times").mapInArrow(_scored(known), "row long, n_best long, count_sum long, rare array<struct<pair:long,times:long>>")
    scored = materialize(scored, "align-scored", True)
    sums = scored.select("row", "n_best", "count_sum")
    if n > most:
        rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.where(~hot).select("pair", "count", "best"), "pair")
        sums = sums.union(rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), F.sum(F.col("times") * F.col("count")))).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = documents.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


# --- the same with every token of the corpus as a row ---------------------------------------


def _ids(path_a: str, path_b: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(path_a), piece_side(path_b)
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for t in batch.column(2).to_pylist():
                x, y = (a.encode(" " + t), b.encode(" " + t)) if t else ([], [])
                whole = (" " + t).encode() if t else b""
                ok = all(b"".join([s.tokens[k] for k in v]) == whole for s, v in ((a, x), (b, y)))
                out[0].append(x if ok else [])
                out[1].append(y if ok else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=["row", "doc_id", "a", "b"])

    return encode


def exploded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """token_alignment's rows by Spark's operators alone: tokens exploded with their positions, ends as windowed sums of lengths, an equi-join on row and
    end, groups as running counts of cuts. It shuffles and sorts each token several times: for small corpora and as a
    check of the other form."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = materialize(rows.mapInArrow(_ids(path_a, path_b), "row long, doc_id long, a array<int>, b array<int>"), "align-ids")
    order = Window.partitionBy("row").orderBy("pos")

    def side(c: str, tokens: list[bytes]) -> DataFrame:
        sizes = F.broadcast(spark.createDataFrame(list(enumerate(map(len, tokens))), "id int, size int"))  # one row an id of the vocabulary
        return coded.select("row", F.posexplode(c).alias("pos", "id")).join(sizes, "id").select("row", "pos", "id", F.sum("size").over(order).alias("end"))

    a, b = side("a", byte_side(path_a).tokens), side("b", piece_side(path_b).tokens)
    links = a.select("row", "end", F.col("id").alias("ia")).join(b.select("row", "end", F.col("id").alias("ib")), ["row", "end"])

    def text(x: DataFrame) -> DataFrame:
        """The ids of each group."""
        closes = links.select("row", "end", F.lit(1).alias("cut"))
        grouped = x.join(closes, ["row", "end"], "left").withColumn("grp", F.count("cut").over(order) - F.coalesce("cut", F.lit(0)))
        listed = grouped.groupBy("row", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("l"))
        return listed.select("row", "grp", F.array_join(F.transform("l", lambda v: v["id"].cast("string")), ",").alias("ids"))

    groups = text(a).withColumnRenamed("ids", "x").join(text(b).withColumnRenamed("ids", "y"), ["row", "grp"])
    joined = groups.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("grp", F.concat_ws("|", "x", "y").alias("g")))).alias("l")).select("row", F.sha2(F.array_join(F.transform("l", lambda v: v["g"]), ";").cast("binary"), 256).alias("sha"))
    counts = links.groupBy("ia", "ib").agg(F.count("*").alias("count"))
    best = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("ib")))
    sums = links.join(best, ["ia", "ib"]).groupBy("row").agg(F.count("*").alias("g"), F.count_if("best").alias("best"), F.sum("count").alias("s"))
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("g", "n_groups"), ("g", "n_links"), ("best", "n_best"), ("s", "count_sum"))]
    out = coded.select("row", "doc_id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b")).join(sums, "row", "left").join(joined, "row", "left")
    return out.select("doc_id", "n_a", "n_b", *zero, F.coalesce("sha", F.lit("")).alias("groups_sha256"))
