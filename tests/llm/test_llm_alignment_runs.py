"""Token alignment and periodic runs against brute force."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchwarden.llm import periodic_runs, queries, token_alignment

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_runs", T.StringType()), T.StructField("start", T.LongType())])
SPACES = " \t\n\r\x0b\x0c"


def brute_runs(w, least=6, power=4):
    found = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            s = w[i : i + n]
            if n >= max(least, power * q) and not any(all(s[x] == s[x + p] for x in range(n - p)) for p in range(1, q)):
                found.add((i, n, q))
            i = j + 1
    return sorted(found)


def random_words(r):
    w = []
    k = r.randrange(1, 4)
    while len(w) < r.randrange(0, 80):
        w += [r.randrange(k) for _ in range(r.randrange(1, 7))] * r.randrange(1, 8)
        if r.random() < 0.3:
            w.append(r.randrange(5))
    return w


def test_runs_are_all_runs():
    r = random.Random(1)
    for _ in range(600):
        docs = [random_words(r) for _ in range(r.randrange(1, 4))]
        found = periodic_runs.find_runs(np.array(sum(docs, []), np.uint64), np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
        want, base = [], 0
        for w in docs:
            want += [(s + base, n, q) for s, n, q in brute_runs(w)]
            base += len(w)
        assert sorted(map(tuple, found.tolist())) == sorted(want)


@pytest.mark.parametrize("power,least", [(2, 2), (3, 9)])
def test_runs_of_other_exponents(power, least):
    r = random.Random(2)
    for _ in range(300):
        w = random_words(r)
        assert [tuple(x) for x in periodic_runs.find_runs(np.array(w, np.uint64), np.zeros(len(w), np.int64), least, power).tolist()] == brute_runs(w, least, power)


def test_runs_of_long_stretches():
    thue = [0]
    for _ in range(14):
        thue += [1 - v for v in thue]
    assert len(periodic_runs.find_runs(np.array(thue, np.uint64), np.zeros(len(thue), np.int64))) == 0
    fib = ["a", "ab"]
    while len(fib[-1]) < 20000:
        fib.append(fib[-1] + fib[-2])
    w = [ord(c) for c in fib[-1]] + [7] * 5000 + list(range(3)) * 4000
    got = [tuple(x) for x in periodic_runs.find_runs(np.array(w, np.uint64), np.zeros(len(w), np.int64)).tolist()]
    assert (len(fib[-1]), 5000, 7 - 6) in got and (len(w) - 12000, 12000, 3) in got


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [x for x in text.split(" ") if x]


def periodic_texts():
    r = random.Random(3)
    texts = [None, "", " \n", "one", "la " * 6, "la " * 5, "a b " * 4, "a b\n" * 3, "é à x " * 9 + "é", "no\x0brun\x0chere " * 4, "x " * 2000, "A a " * 8, "日本 語 " * 7]
    return texts + ["".join(f"w{x}" + r.choice(SPACES) for x in random_words(r)) for _ in range(200)]


def test_periodic_runs_rows(spark):
    texts = periodic_texts()
    rows = [(None if i % 50 == 0 else i // 2, t, "x", 1) for i, t in enumerate(texts)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3))
    seen = collections.Counter((x.doc_id, x.n_words, x.n_runs, x.start, x.length, x.period, tuple(tuple(v) for v in x.runs), x.collapsed) for x in got.collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        w = split(t or "")
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        want[(d, len(w), len(runs), *best, tuple(sorted(runs, key=lambda x: (x[0], x[2]))), collapse(w, runs))] += 1
    assert seen == want
    assert got.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"]
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_op13_query(spark, tmp_path):
    texts = periodic_texts() + [" ".join(f"t{k % 97}" for k in range(400))] * 40
    spark.createDataFrame([(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for i, t in enumerate(texts):
        d = None if i == 3 else i
        w = split(t or "")
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        r = got[d]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
        assert r.runs_sha256 == sha("".join(f"{x},{y},{z}\n" for x, y, z in sorted(runs, key=lambda v: (v[0], v[2]))))
        assert r.collapsed_sha256 == sha(collapse(w, runs))
    assert planted > 10


# --- token alignment ------------------------------------------------------------------------


def aligned_texts():
    r = random.Random(4)
    odd = [
        None, "", " ", "  ", "\n", "a", "<|endoftext|> a </s> b <unk>  c  d  e\n f\n\n  g 's don't  \t x", "a ▁ b", "日本語 テキスト 😀 x" * 50, "x" * 5000 + " é à\x00 b", "trailing  ",
        " lead  two\r\n three\x1c four\x85 five ", "nbsp  a  b　 c", "ends é", "é  ", "a \n", "we're I'll 12 345 6 ... --- ??", "repeat this", "repeat this",
    ]
    pick = ["the", "token", "Éclair", "straße", "3.14", "ж", "…", "don't", "\n", "  ", "日本", "á", "https://x.y/z?q=1", "—", "{}", "\t"]
    return odd + [" ".join(r.choice(pick) + (str(r.randrange(50)) if r.random() < 0.3 else "") for _ in range(r.randrange(60))) for _ in range(150)]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_MODEL))
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
    alphabet = token_alignment.byte_alphabet()
    out, links = [], []
    for t in texts:
        row = [0, 0, []]
        if t:
            raw = (" " + t).encode()
            a = [(k, bytes(alphabet[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + t, add_special_tokens=False).ids]
            b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(t)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                ends = [[], []]
                for e, side in zip(ends, (a, b)):
                    at = 0
                    for _, x in side:
                        at += len(x)
                        e.append(at)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups, lo = [], 0
                for c in cuts:
                    groups.append(tuple([k for (k, _), e in zip(side, es) if lo < e <= c] for side, es in ((a, ends[0]), (b, ends[1]))))
                    lo = c
                row = [len(a), len(b), groups]
        out.append(row)
        links.append([(x[-1], y[-1]) for x, y in row[2]])
    count = collections.Counter(p for l in links for p in l)
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for (n_a, n_b, groups), l in zip(out, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((n_a, n_b, len(groups), len(l), sum(count[p] == top[p[1]] for p in l), sum(count[p] for p in l), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, count, top


@pytest.mark.parametrize("run_bytes,most", [(1 << 20, 1 << 20), (700, 40), (1, 1)])
def test_alignment_against_brute_force(spark, run_bytes, most):
    texts = aligned_texts() if run_bytes > 1 else aligned_texts()[:40]
    ids = [None if i % 40 == 1 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in zip(ids, texts)], DOCS).repartition(3)
    paths = [queries.tokenizer_path(x) for x in (queries.BYTE_MODEL, queries.PIECE_MODEL)]
    got, pairs = token_alignment.token_alignment(docs, *paths, run_bytes=run_bytes, most=most)
    want, count, top = brute_alignment(texts)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((d, *w) for d, w in zip(ids, want))
    assert {((r.a, r.b), r["count"], r.best) for r in pairs.collect()} == {(p, n, n == top[p[1]]) for p, n in count.items()}
    if run_bytes == 1 << 20:
        assert collections.Counter(map(tuple, token_alignment.exploded(docs, *paths).collect())) == collections.Counter(map(tuple, got.collect()))


def test_byte_side_is_the_files_own_library():
    """Also where white space, punctuation, digits, letters or marks stand by the million."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_MODEL)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    side = token_alignment.byte_side(path)
    n = 1_000_000
    many = [" " * n + "a", "x" + "\n" * n, " \n\t" * (n // 3) + "x", "-" * n, "7" * n, "a" * n, "é" * (n // 2), "a\u0301" * (n // 4), "\u3000" * (n // 4) + "b", ("a" * 50 + " " * 50) * 3000, " " * 70_000 + "b" + " " * 40_000]
    for text in many + [t for t in aligned_texts() if t]:
        assert side.encode(" " + text) == own.encode(" " + text, add_special_tokens=False).ids


def test_alignment_of_an_empty_table(spark):
    paths = [queries.tokenizer_path(x) for x in (queries.BYTE_MODEL, queries.PIECE_MODEL)]
    assert token_alignment.token_alignment(spark.createDataFrame([], DOCS), *paths)[0].count() == 0


def test_op12_query(spark, tmp_path):
    texts = aligned_texts()[:60]
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()
    assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(brute_alignment(texts)[0])]
