"""The llm operators against brute force, on small fixtures with every odd case."""

import collections
import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from patchwarden.llm import cotrain, decontaminate, html_extract, language_id, line_dedup, ngram_join, quality_rules, queries, sp_codec, sql, token_counts, url_filter
from patchwarden.llm import _text as K
import patchwarden.llm._shared as S
from patchwarden.llm._shared import components, join_hot, link_sets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LOW = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["alpha", "beta", "gamma", "delta", "straße", "Éclair", "日本"]) + str(r.randrange(400)) for _ in range(n)]


def corpus():
    """Exact and near copies, shared passages, repeated lines, nulls, empties, one long text."""
    r = random.Random(5)
    passage = " ".join(words(60, 99))
    base = words(120, 1)
    texts = [None, "", "   \n\t ", "one", "Two words", "a b c d e", " ".join(base), " ".join(base), " ".join(base).upper(), "\n".join(["same line of text that is long enough here"] * 4), "x" * 5000, "日本語" * 400, "▁▁ ▁a \r\n tail"]
    for i in range(25):
        t = list(base)
        for _ in range(i % 9):
            t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(t))
    for i in range(25):
        texts.append("\n".join([" ".join(words(30, 1000 + i)), passage if i % 2 else "License: this line stands in very many documents.", " ".join(words(20, 2000 + i))]))
    texts.append(" ".join(words(9000, 7)))
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s1"][i % 4], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, "a document without a number " * 3, "en", "s1", 3), (6, " ".join(base), "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def model():
    return queries.tokenizer_path(queries.PIECE_MODEL)


def test_clashing_columns(spark):
    """Extra columns with the operators' own names neither crash nor change anything."""
    names = ["n_words", "n_lines", "n_removed", "kept", "base_failed", "f_lang", "lo_symbol_pct", "rep", "id", "drop", "tok", "node", "comp", "bad_id", "drop_id", "hits", "score", "quality", "toxic", "decoded", "bucket", "window"]
    rows = [(i, " ".join(words(40, i % 3)), "en", "s", 1, *["x"] * len(names)) for i in range(6)]
    d = spark.createDataFrame(rows, T.StructType([*DOCS, *(T.StructField(c, T.StringType()) for c in names)]))
    bench = spark.createDataFrame([(1, "alpha beta gamma", "x")], "item_id long, text string, window string")
    lab = spark.createDataFrame([(0, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    assert ngram_join.keep_one(d).columns == quality_rules.quality_filter(d).columns == decontaminate.decontaminate(d, bench).columns == d.columns
    assert [r.doc_id for r in ngram_join.keep_one(d).orderBy("doc_id").collect()] == [0, 1, 2]
    assert quality_rules.quality_filter(d).where("kept = 'x' AND n_words = 'x'").count() == 6
    lines = line_dedup.line_dedup(d)
    assert lines.columns == [c for c in d.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"] and lines.agg({"n_removed": "sum"}).first()[0] == 3
    for limit in (1 << 20, 0):
        assert decontaminate.contamination(d, bench, limit).count() == 6
    assert sp_codec.sp_decode(sp_codec.sp_encode(d, model()), model()).where("decoded = text").count() == 6
    assert token_counts.token_counts(d, model()).count() == language_id.language_id(d).count() == cotrain.quality_classifier(d, lab).count() == quality_rules.quality_rules(d).count() == 6


# --- kernels -----------------------------------------------------------------------------


def test_words_lines_and_hashes():
    texts = [r[1] for r in corpus()]
    for limit in (1, 100, 1 << 20):
        n = 0
        for lo, hi, buf, off in K.blocks(pa.array(texts, pa.string()), limit):
            w, ln = K.words(buf, off, K.NOT_SPACE), K.lines(buf, off)
            sums = K.prefix_hash(buf)
            h = K.span_hash(sums, w.starts, w.ends)
            raw = buf.tobytes()
            for d, t in enumerate(texts[lo:hi]):
                got = [raw[a:b].decode() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]])]
                assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")
                got = [raw[a:b].decode() for a, b in zip(ln.starts[ln.first[d] : ln.first[d + 1]], ln.ends[ln.first[d] : ln.first[d + 1]])]
                assert got == ((t or "").split("\n") if t else [])
            by = collections.defaultdict(set)
            for a, b, x in zip(w.starts, w.ends, h):
                by[raw[a:b]].add(int(x))
            assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by) if by else True
            n += hi - lo
        assert n == len(texts)


def test_hashes_of_long_texts(monkeypatch):
    """Segments change no hash, of spans that cross some of them either."""
    buf, off = K.text_buffer(pa.array(["x" * 700 + " one two " + " ".join(words(300, 3)) + " " + "yz" * 400, "tail"]))
    w = K.words(buf, off, K.NOT_SPACE)
    want = K.span_hash(K.prefix_hash(buf), w.starts, w.ends)
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(K, "SEGMENT", size)
        assert (K.span_hash(K.prefix_hash(buf), w.starts, w.ends) == want).all() and len(K._powers()[0]) == size + 1


def test_components_against_union_find(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    for limit, hot in ((1 << 20, 1 << 16), (0, 3)):
        monkeypatch.setattr(S, "HOT", hot)
        got = components(spark.createDataFrame(edges, "u long, v long").repartition(7), "t", limit)[0].collect()
        assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)
    left = spark.createDataFrame([(k, i) for k in range(20) for i in range(200 if k == 3 else k % 3)] + [(None, 7)], "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}", 200 if k == 3 else 2) for k in range(0, 20, 3)], "k long, v string, w long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right.drop("w"), "k", how).collect()), key=str)
        assert sorted(map(tuple, join_hot(left, right, "k", "w", how).collect()), key=str) == want
        assert join_hot(left, right.limit(0), "k", "w", how).count() == (left.count() if how == "left" else 0)


def test_blocks_join_what_hubs_miss(spark, monkeypatch):
    """A cycle of sets, each like its neighbours only: one component, found through blocks."""
    monkeypatch.setattr(S, "BLOCK", 8)
    rows = []
    for i in range(60):
        x = np.sort(np.array([(i + k) * 7 for k in range(20)], "<i8"))
        rows.append((i, 20, bytearray(x.tobytes()), 1, [int(v) for v in x] + [-1], 0.0))
    sets = spark.createDataFrame(rows, "node long, n long, toks binary, ell int, prefix array<long>, off double")
    for limit in (64, 10, 0):  # lists by a join, some or all of them by blocks
        monkeypatch.setattr(S, "LIST", limit)
        comp = link_sets(sets, 75, "t", rounds=1)
        assert {r.node: r.comp for r in comp.collect()} == {i: 0 for i in range(1, 60)}


# --- 1 -------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                p, q = find(a), find(b)
                parent[p] = q
    least = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[find(k)] += [] if i is None else [i]
    out = [(i, len(s), min(least[find(k)], default=None)) for k, (i, s) in enumerate(sets)]
    return sorted(out, key=str)


@pytest.mark.parametrize("ell,frequent,flush", [(1, 1 << 17, 1 << 19), (4, 1 << 17, 1 << 19), (4, 700, 1 << 19), (2, 1500, 500)])
def test_ngram_components(docs, ell, frequent, flush, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    if frequent < 1000:
        heads = docs.select("doc_id", "text").mapInArrow(ngram_join._heads(5), ngram_join._HEADS)
        assert len(ngram_join.frequent_shingles(heads)) > 0
    got = ngram_join.ngram_components(docs, max_ell=ell).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(corpus())


def test_ngram_hot_groups_and_long_lists(spark, docs, monkeypatch):
    """Every other way of the join: broadcast representatives, split hot keys, blocks for all lists."""
    monkeypatch.setattr(S, "HOT", 4)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    want = brute_components(corpus())
    for limit in (64, 0):
        monkeypatch.setattr(S, "LIST", limit)
        got = ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want


def _packed(texts, bits, shared=None):
    class Shared:
        value = shared

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in ngram_join._pack(5, bits, Shared if shared else None)(iter([batch])) for r in b.to_pylist()]
    return rows


def test_packed_rows_stay_small_and_spread():
    """Bytes a shingle from 32 to 32,768 buckets; copies are packed once, whatever their frequent shingles."""
    texts = [" ".join(words(300, k)) for k in range(1500)]
    cost = {bits: sum(len(r["body"]) for r in _packed(texts, bits)) / (1500 * 296) for bits in (5, 8, 12, 15)}
    assert cost[5] < 8 and cost[8] < 15 and cost[15] < 22 and max(cost.values()) < 3 * min(cost.values()), cost
    one, many = (sum(len(r["body"]) for r in _packed([texts[0]] * n, 8)) for n in (1, 1000))
    assert one == many
    n, d1, d2 = ngram_join._digests(ngram_join._sets(*K.text_buffer(pa.array(texts)), 5))
    hot = np.sort(np.concatenate(ngram_join._sets(*K.text_buffer(pa.array(texts[:50])), 5)))
    sizes = collections.Counter()
    for r in _packed(texts, 8, (hot, np.zeros((0, 3), np.int64))):
        sizes[r["bucket"]] += len(r["body"])
    assert len(sizes) == 256 and max(sizes.values()) < 3 * np.mean(list(sizes.values()))
    assert len({b for b in (d1.view(np.uint64) >> np.uint64(56)).tolist()}) > 200
    copies = np.stack([d1, d2, np.full(1500, -1)], 1)[np.argsort(d1)]
    assert _packed(texts, 8, (hot, copies)) == []  # the representatives stand elsewhere


def test_ngram_empty_and_keep_one(docs, empty):
    assert ngram_join.ngram_components(empty).collect() == []
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, 6, None} <= ids and not {7, 13} & ids


# --- 2 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_codec_round_trip(docs, dropout):
    coded = sp_codec.sp_decode(sp_codec.sp_encode(docs, model(), dropout, 11), model())
    for r in coded.collect():
        assert r.decoded == r.text and (r.token_ids is None) == (r.text is None)
    proved = sp_codec.sp_encode(docs.repartition(2), model(), dropout, 11, proof="ok").collect()
    assert all(r.ok for r in proved)
    again = {(r.doc_id, r.text): r.token_ids for r in proved}
    assert all(again[r.doc_id, r.text] == r.token_ids for r in coded.collect())


def test_codec_without_dropout_is_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    for r in sp_codec.sp_encode(docs, model(), 0.0).collect():
        if r.text is not None and "▁" not in r.text:
            assert r.token_ids == sp.encode(r.text)


def test_codec_seeds_vary_and_long_words_agree(monkeypatch):
    m = sp_codec.load(model())
    texts = ["".join(random.Random(1).choice("abcdehilnorst ") for _ in range(3000)), "x" * 700]
    keys = np.arange(2)
    a, b = (sp_codec.Encoder(m, 0.2, s).block(texts, keys) for s in (1, 2))
    assert a[0].tolist() != b[0].tolist()
    monkeypatch.setattr(sp_codec, "LONG", 0)
    assert sp_codec.Encoder(m, 0.2, 1).block(texts, keys)[0].tolist() == a[0].tolist()


def brute_encode(text, key, dropout, seed):
    """The agenda with dropout by its definition, on strings: of all neighbours that make a piece and are not
    skipped, the best score, leftmost, merges; until there is none. Only the keyed hash is shared."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    base = int(K.mix64(K.mix64(np.array([key], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ K.mix64(np.array([seed], np.int64).view(np.uint64)))[0])
    rate = int(dropout * 2.0**64)
    symbols = [("\0" if c == "▁" else "▁" if c == " " else c, k, k + 1) for k, c in enumerate(" " + text)] if text else []
    while True:
        can = []
        for i, ((a, lo, mid), (b, _, hi)) in enumerate(zip(symbols, symbols[1:])):
            if (p := pieces.get(a + b)) is not None and (not rate or sp_codec._keep(base, lo, mid, hi, rate)):
                can.append((-sp.get_score(p), i))
        if not can:
            break
        i = min(can)[1]
        symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], symbols[i][1], symbols[i + 1][2])]
    out = []
    for x, *_ in symbols:
        out += [pieces[x]] if x in pieces else [byte[v] for v in x.replace("\0", "▁").encode()]
    return out


def test_codec_with_dropout_against_brute_force(spark):
    texts = ["", " ", "Hello world, this is a test.", "  two  spaces\n and lines", "straße Éclair 日本語 😀", "▁ literal ▁▁x", "aaaaaaaaaaaaaaaa" * 12, " ".join(words(25, 5)), "tokenization internationalization antidisestablishment"]
    d = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = set()
    for dropout in (0.0, 0.1, 0.4):
        for seed in (0, 7):
            for r in sp_codec.sp_encode(d, model(), dropout, seed).collect():
                assert r.token_ids == brute_encode(r.text, K.NO_ID if r.doc_id is None else r.doc_id, dropout, seed), (r.text, dropout)
                seen.add((r.text, tuple(r.token_ids)))
    assert len(seen) > 3 * len(texts)


def test_codec_empty(empty):
    assert sp_codec.codec_report(empty, model()).collect() == []


# --- 3 -------------------------------------------------------------------------------------


def brute_lines(rows):
    """(doc_id, text) after exact dedup of similar lines; rows with equal id and text are one document."""
    low = lambda x: x.translate(LOW)
    ids = lambda i: (i is None, i or 0)
    docs = {(i, t) for i, t, *_ in rows if t}
    occ = [(ids(i), j, t, low(x)) for i, t in docs for j, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    shingles = {x: {x[k : k + 6] for k in range(max(len(x) - 5, 1))} for *_, x in occ}
    distinct = list(shingles)
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                parent[find(a)] = find(b)
    first, gone = {}, collections.defaultdict(set)
    for i, j, t, x in occ:
        g = find(x)
        key = (i, j, h1(t), h2(t))
        first[g] = min(first.get(g, key), key)
    for i, j, t, x in occ:
        if first[find(x)] != (i, j, h1(t), h2(t)):
            gone[i, t].add(j)
    return collections.Counter((i, t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[ids(i), t])) for i, t, *_ in rows)


_keys = {}
h1, h2 = lambda t: _keys[t][0], lambda t: _keys[t][1]


def learn_keys(spark, texts):
    """Spark's hashes of texts, which order documents of one doc_id."""
    from patchwarden.llm._shared import text_key

    d = spark.createDataFrame([(t,) for t in set(texts) if t], "text string")
    _keys.update({r[0]: (r[1], r[2]) for r in d.select("text", *text_key()).collect()})


def test_line_dedup(spark, docs, empty):
    rows = corpus()
    learn_keys(spark, [r[1] for r in rows])
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.line_dedup(empty).collect() == []


def test_line_shingles_are_of_characters_in_any_order():
    """Lines of wide characters among ASCII ones, some shorter than a shingle or begun by white space: shingles are of their own characters wherever a line stands, and
    in whatever order lines are asked for, as runs ask for them by key."""
    lines = [f"строка номер {i} о погоде и море" if i % 3 else f"line {i} of some text on weather" for i in range(60)] + ["é", "日本", "ab", " \t", "  x日", "", "a\u2028\U0001f600bcdef"]
    sizes = [max(len(x) - line_dedup.WIDTH + 1, 1) for x in lines]
    buf, off = K.text_buffer(pa.array(["\n".join(lines)]))
    block = line_dedup._Lines(buf, off)
    assert block.at.tolist() == [i for i, x in enumerate(lines) if x.strip(" \t")]
    alone = []
    for x in (lines[i] for i in block.at):
        buf, off = K.text_buffer(pa.array([x]))
        alone.append(line_dedup._Lines(buf, off).shingles(np.array([0]))[1].tolist())
    rows = np.random.default_rng(4).permutation(len(block.at))
    line, h = block.shingles(rows)
    for k, r in enumerate(rows.tolist()):
        assert h[line == k].tolist() == alone[r] and len(alone[r]) == sizes[block.at[r]]
    many = line_dedup._shingles([bytes(line_dedup.BITMAP) + lines[i].encode() for i in block.at])
    assert many[0].tolist() == [len(set(x)) for x in alone]


def test_line_bands_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(5)
    texts = pa.array(["\n".join("".join(rng.choice("abc déж日") for _ in range(rng.randint(1, 60))) for _ in range(8)) for _ in range(100)])
    seen = []
    for size in (1 << 20, 700):
        monkeypatch.setattr(line_dedup, "PACKED", size, raising=False)
        monkeypatch.setattr(K.blocks, "__defaults__", (size,))
        out = list(line_dedup._pack(4)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
        seen.append({(r["bucket"], *z) for b in out for r in b.to_pylist() for z in zip(np.frombuffer(r["low"], "<u4").tolist(), np.frombuffer(r["high"], "<u2").tolist(), np.frombuffer(r["nodes"], "<i8").tolist())})
    assert seen[0] == seen[1]


def test_line_texts_go_out_once_a_task(monkeypatch):
    """A line of several runs of texts takes its text and bitmap along once; its places all go out, and shingles are made of these lines only."""
    monkeypatch.setattr(line_dedup, "PACKED", 300, raising=False)
    monkeypatch.setattr(K.blocks, "__defaults__", (300,))
    texts = [f"{'other words ' * 12}{i}\nстрока о погоде\nthe same line in every text" for i in range(20)]
    every = bytes([255]) * (1 << 13)
    slots = type("Slots", (), {"value": (every, every)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts), pa.array(range(20)), pa.array(range(20))], names=["doc_id", "text", "h1", "h2"])
    rows = [r for b in line_dedup._fetch(slots, 16)(iter([batch])) for r in b.to_pylist()]
    assert collections.Counter((r["id"], r["line"]) for r in rows) == collections.Counter((i, k) for i in range(20) for k in range(3))
    sent = [r for r in rows if r["text"] is not None]
    assert sorted(r["text"][line_dedup.BITMAP :].decode() for r in sent) == sorted({x for t in texts for x in t.split("\n")})
    for r in sent:
        sizes, _ = line_dedup._shingles([r["text"]])
        line = r["text"][line_dedup.BITMAP :].decode()
        assert r["n"] == sizes[0] == len({line[k : k + 6] for k in range(len(line) - 5)})


def test_bitmaps_in_one_pass(spark):
    h = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)
    rows = spark.createDataFrame([(int(x), i % 3 == 0) for i, x in enumerate(h)] + [(int(h[0]), False)], "k long, some boolean")
    both, some = S.bitmaps(rows, 20)
    assert both == S.bitmap(rows.select("k"), 20) and some == S.bitmap(rows.where("some").select("k"), 20)
    assert S.in_bitmap(both, 20)(h).all() and S.in_bitmap(some, 20)(h[::3]).all() and not S.in_bitmap(some, 20)(h).all()


def test_line_dedup_odd_rows(spark, monkeypatch):
    """Short lines, blank lines, several null ids, one id with two texts, repeated rows, lines that differ in case, hot keys."""
    monkeypatch.setattr(S, "HOT", 3)
    texts = ["All rights reserved.\n\none line of its own\n日本語です", "ALL RIGHTS RESERVED.\n\nanother line of its own\n日本語です\nx", "all rights of yours!\n \nX\nx", "\n\nall rights reserved.", "日本語です\n日本語です。\n1.\n2.\n1."]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, f"{texts[2]}\nown line of a null"), (1, f"kept by another row of the id\n{texts[1]}"), (3, texts[3]), (None, texts[0]), (9, None), (None, None), (8, "")]
    learn_keys(spark, [t for _, t in rows])
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = line_dedup.line_dedup(d).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == brute_lines(rows)
    assert all(r.n_lines == (len(t.split("\n")) if t else 0) for r in got for i, t in rows if (i, t) == (r.doc_id, r.text) and r.n_removed == 0)


def test_line_recall_by_length():
    """Measured share of similar pairs (0.8 to 0.9) that some band finds."""
    r = random.Random(4)
    recall = {}
    for size in (16, 24, 32, 48, 64, 96, 160):
        a, b = [], []
        while len(a) < 300:
            x = "".join(r.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(size))
            y = x + "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 2 + size // 6))) if r.random() < 0.5 else x[r.randrange(1, 2 + size // 6) :]
            s, t = ({v[k : k + 6] for k in range(len(v) - 5)} for v in (x, y))
            if 0.8 <= len(s & t) / len(s | t) < 0.9:
                a.append(x)
                b.append(y)
        buf, off = K.text_buffer(pa.array([v for p in zip(a, b) for v in p]))
        bands = line_dedup._bands(line_dedup.signatures(*line_dedup._shingles_of(buf, K.prefix_hash(buf), off[:-1], off[1:]), 600))
        recall[size] = float((bands[::2] == bands[1::2]).any(1).mean())
    print("recall of pairs by line length", recall)
    assert min(recall.values()) >= 0.9 and min(v for k, v in recall.items() if k >= 64) >= 0.95, recall


# --- 4 -------------------------------------------------------------------------------------


PAGE = """<html><head><title>t</title><script>var a = "</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies, yes, we do, and here are more words about it.</div><div id="wrap"><ul class="menu"><li><a href=x>Home</a></ul>
<div class="post"><h1>Title, the</h1><p>First &amp; second,\n  text that is long enough to count here.<p>Third &lt;b&gt;<br>line</p><!-- note --><ul><li>one<li>two</ul><form>x</form></div>
<div class="comments"><article class="comment"><p>Nice, great, good, a long comment, indeed it is one, yes.</p></article></div></div><footer>&copy; foot</footer></body></html>"""


def test_html_extract_cases():
    assert html_extract.extract(PAGE) == "Title, the\nFirst & second, text that is long enough to count here.\nThird <b> line\none\ntwo"
    for page, want in [(None, ""), ("", ""), ("<html></html>", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<article><p>x</article><aside><p>y</aside>", "x"), ("<div><p>unclosed <b>bold", "unclosed bold"), ("<script>1", ""), ("a < b and c > d", "a < b and c > d")]:
        assert html_extract.extract(page) == want, page
    deep = "<div>" * 3000 + "<p>deep text</p>"
    assert html_extract.extract(deep) == "deep text"


def test_html_extract_names():
    """Slugs of headings and words that hold a bad one lose no text; names of page parts do."""
    text = "This is a sentence of the article, which is long enough, as it seems."
    for part in ("<h2 id='related-work'>{}</h2>", "<section id='legal-history'><p>{}</p></section>", "<h3 id='search-methods'>{}</h3>", "<div class='commentary'><p>{}</p></div>", "<p id='promoted-to-captain'>{}</p>", "<h2 id=comments>{}</h2>", "<div class=section id=cookie-recipes><p>{}</p></div>", "<div class='has-sidebar'><p>{}</p></div>"):
        assert html_extract.extract(f"<article><p>{text}</p>{part.format('Own words')}<p>{text}</p></article>") == f"{text}\nOwn words\n{text}", part
    for name in ("post comments-open", "discussion", "comment", "reply-story"):
        assert html_extract.extract(f"<article class='{name}'><p>{text}</p></article>") == text, name
    for part in ("<div class=ad>{}</div>", "<div id=cookie-banner>{}</div>", "<div class='site-footer'>{}</div>", "<section id=comments><article class=comment>{}</article></section>", "<div class='ad-slot-3 wide'>{}</div>", "<ul class='share-buttons'><li>{}</ul>", "<div class='sidebar2'>{}</div>", "<div class='related-posts'>{}</div>", "<article class='comment even'>{}</article>", "<p class=ad>{}</p>", "<p><span class='visually-hidden'>{}</span></p>", "<div class=cookiebar>{}</div>"):
        assert html_extract.extract(f"<body><article><p>{text}</p>{part.format(text)}</article></body>") == text, part
        assert html_extract.extract(f"<body><article><p>{text}</p></article>{part.format(text)}</body>") == text, part


def test_html_extract_names_only_weigh():
    """A container that holds most of the page's text stays, whatever it is called; comments stay out
    however long they are, but where there is nothing else."""
    text = "This is a sentence of the article, which is long enough, as it seems."
    want = f"Title\n{text}\n{text}"
    for name in ("has-sidebar", "content with-sidebar", "post-body ad-free", "story legal-news", "layout-no-banner", "entry popular", "search-result-article", "single-post comments-open", "wrap cookie-free", "text social-policy", "page-header-fixed", "content share-enabled", "popular", "sidebar", "comments"):
        for attr in ("class", "id"):
            page = f"<body><nav>menu</nav><div {attr}='{name}'><h1>Title</h1><p>{text}</p><p>{text}</p></div><footer>foot</footer></body>"
            assert html_extract.extract(page) == want, (attr, name)
    for wrap in ("<article>{}</article>", "<div class=post>{}</div>", "<div>{}</div>"):
        body = wrap.format(f"<h1>Title</h1><p>{text}</p><p>{text}</p>")
        for part in (f"<section id=comments>{f'<p>{text} {text}</p>' * 50}</section>", f"<div class=sidebar><p>{text}</p></div>", f"<form><p>{text}</p></form>", f"<div class='cookie-notice'>{text}</div>", f"<nav>{text}</nav>"):
            assert html_extract.extract(f"<body>{body}{part}</body>") == html_extract.extract(f"<body>{part}{body}</body>") == want, part
    assert html_extract.extract(f"<body><form id=aspnet><h1>Title</h1><p>{text}</p><p>{text}</p></form></body>") == want
    assert html_extract.extract(f"<article><header><h1>Title</h1></header><p>{text}</p><p>{text}</p></article>") == want


def walked(page):
    """extract by walks alone: each element gives its points and lengths to each of its ancestors, one by one, and
    each block asks its ancestors whether it stays."""
    H = html_extract
    nodes, blocks = H._parse(page)
    if not blocks:
        return ""
    up = []
    for n in nodes:
        path = [n]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        up.append(path)
    named = (H.PART, H.COMMENTS)
    free, plain = [0] * len(nodes), [0] * len(nodes)
    for n in nodes:
        hidden = False
        for m in up[n.index]:
            free[m.index] += n.chars - n.link_chars
            plain[m.index] += 0 if hidden else n.chars - n.link_chars
            hidden = hidden or m.part in named
    rest, dropped, minus = plain[0], set(), set()
    for n in nodes:
        if n.part in named and free[n.index] and not dropped & {m.index for m in up[n.index]}:
            if rest > 0 if n.part == H.COMMENTS else rest >= H.BESIDE * free[n.index]:
                dropped.add(n.index)
            else:
                rest += plain[n.index]
                minus.add(n.index)
    gone = [bool(dropped & {m.index for m in up[n.index]}) for n in nodes]
    points, chars, links = ([0.0] * len(nodes) for _ in range(3))
    for n in nodes:
        if gone[n.index]:
            continue
        share = 1.0
        for m in up[n.index]:
            points[m.index] += n.points * share
            chars[m.index] += n.chars
            links[m.index] += n.link_chars
            share *= 1.0 if m.tag in H._TEXT else 0.5
    score = [0.0 if n.tag in H._TEXT or gone[n.index] else points[n.index] for n in nodes]
    density = [l / max(c, 1) for l, c in zip(links, chars)]
    rank = lambda n: (chars[n.index] > 0, round((score[n.index] + (n.weight - 25 * (n.index in minus)) * (chars[n.index] > 0)) * (1 - density[n.index]), 6), -n.index)
    best = max(nodes, key=rank)
    kept = {best.index}
    for n in nodes if best.parent is not None else ():
        if n.parent is best.parent and n is not best and chars[n.index]:
            least = 0.2 * score[best.index] if best.good and n.good else max(10.0, 0.2 * score[best.index])
            prose = n.tag in ("h1", "h2", "blockquote", "pre") or n.tag == "p" and chars[n.index] > 80
            if score[n.index] * (1 - density[n.index]) >= least or prose and density[n.index] < 0.25:
                kept.add(n.index)
    return "\n".join(t for t, n in blocks if not gone[n.index] and kept & {m.index for m in up[n.index]})


def test_html_scores_by_walks(spark):
    """Every page of the tables, whole, mixed with each other and in wrappers: the sweep and the walks leave the same text."""
    import duckdb

    pages = [r[0] or "" for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    r = random.Random(1)
    wraps = ['<div class="sidebar">{}</div>', '<form>{}</form><p>Some other text, that is rather long, stands beside it, and more of it.</p>', '<div class="comments">{}</div><div><p>Short.</p></div>', "<ul><li>{}</li><li><a href=x>link, text</a></li></ul>", "<table><tr><td>{}</td><td>cell, two</td></tr></table>"]
    mixed = [wraps[k % 5].format(p) + (r.choice(pages) if k % 3 == 0 else "") for k, p in enumerate(pages[:400])]
    odd = [PAGE, "", "x", "<p>a<p>b", "<article><p>x</article><aside><p>y</aside>"]
    wrong = [p for p in pages + mixed + odd if html_extract.extract(p) != walked(p)]
    assert wrong == [] and len(pages) > 100


def test_html_extract_is_linear():
    n = 100_000
    began = time.perf_counter()
    for page, want in [("<div>" * n + "<p>deep</p>", "deep"), ("<b>" * n + "x", "x"), ("<a " * n, "<a " * (n - 1) + "<a"), ("<!-- x " * n, ""), ("<svg>" * n + "y", "y")]:
        assert html_extract.extract(page) == want
    assert html_extract.extract("<li><ul>" * n + "x" + "</li>" * n) == "x"
    assert time.perf_counter() - began < 60
    began = time.perf_counter()
    for name in ("a" * 1_000_000, "cookie" * 200_000, "nav-" * 250_000):
        assert html_extract.extract(f'<div class="{name}" id="{name}"><p>text</p></div>') == "text"
    assert time.perf_counter() - began < 6


def test_html_extract_rows(spark):
    """Empty and repeated rows, a very long page, columns with clashing names."""
    long = "".join(f"<p>Paragraph {k}, of a very long page, that is.</p>" for k in range(30_000))
    rows = [(1, "u", f"<article>{long}</article>", "x", "y"), (2, None, PAGE, None, None), (2, None, PAGE, None, None), (None, "v", None, "x", "y"), (3, "w", "", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted(map(tuple, html_extract.html_extract(pages).collect()), key=str)
    want = sorted([(i, u, html_extract.extract(h), len(html_extract.extract(h))) for i, u, h, *_ in rows], key=str)
    assert got == want and max(r[2].count("\n") for r in got) == 29_999
    assert html_extract.html_extract(pages.limit(0)).collect() == []


def test_html_extract_several_articles():
    part = lambda k: f"Text {k} of a page, which stands in articles of its own, as it may."
    long = " ".join(part(k) for k in range(7))
    for wrap in ("<body>{}</body>", "<main>{}</main>", "<div class=content>{}</div>"):
        page = wrap.format(f"<h1>Title</h1><article><p>{part(1)}</p></article><article><p>{part(2)}</p><p>{part(3)}</p></article><div role=article><p>{part(5)}</p></div><div><p>{long}</p></div>")
        assert html_extract.extract(page) == "\n".join(["Title", part(1), part(2), part(3), part(5), long]), wrap


def test_html_extract_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.join(html_extract.html_extract(pages), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


# --- 5 -------------------------------------------------------------------------------------


def test_quality_classifier(spark, docs, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = words(40, i) + (["scum", "trash"] if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(x + "***" for x in w) if bad else " ".join(w), "en", f"s{i % 3}", 1))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = cotrain.fit(d, lab)
    assert m.heads[0].exchanged and len(m.heads[0].exchanged) == cotrain.ROUNDS
    got = {x.doc_id: x for x in cotrain.score(d, m).collect()}
    assert len(got) == 400
    right = [(got[i].quality_score >= 0.5) == (i % 5 != 0) and (got[i].toxic_score >= 0.5) == (i % 7 == 0) for i in range(1, 400, 2)]
    assert np.mean(right) > 0.95
    assert cotrain.score(docs, m).count() == len(corpus()) and cotrain.score(empty, m).count() == 0
    none = cotrain.quality_classifier(docs, lab.limit(0)).collect()
    assert all(x.quality_score is None and x.kept for x in none)
    one = cotrain.quality_classifier(docs, spark.createDataFrame([(6, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert all(x.quality_score == 1.0 and x.toxic_score is None for x in one)


def brute_cotrain(rows, labels):
    """Co-training on dense matrices, step by step: the scores of both labels."""
    n = len(rows)
    cell = lambda x, bits: int(K.span_hash(*(lambda b: (K.prefix_hash(b), np.array([0]), np.array([len(b)])))(np.frombuffer(x.encode(), np.uint8)))[0] >> np.uint64(64 - bits))
    text = np.zeros((n, (1 << 16) + 6))
    meta = np.zeros((n, 1 << 12))
    for i, (_, t, lang, source, _) in enumerate(rows):
        tf = collections.Counter(cell(w, 16) for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t.translate(LOW)))
        for c, k in tf.items():
            text[i, c] = np.log1p(k)
        text[i] /= max(np.sqrt((text[i] ** 2).sum()), 1e-300)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        five = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        m = max(len(w), 1)
        text[i, 1 << 16 :] = [np.log1p(len(w)), sum(map(len, w)) / m / 10, min(len(re.findall(r"[#*$%&|<>]", t)) / m, 4), (len(seen) - len(set(seen))) / max(len(seen), 1), rep / m, float(len(w) < 10)]
        for x in (f"l{lang}", f"s{source}", f"b{lang}\n{source}", f"n{int(np.floor(np.log2(len(t.encode()) + 1)))}"):
            meta[i, cell(x, 12)] += 1
    at = {r[0]: i for i, r in enumerate(rows)}
    order = learn_order([r[0] for r in rows], [r[1] for r in rows])
    marked = [i for i in order[0] if rows[i][0] in labels]
    pool = [i for i in order[1] if rows[i][0] not in labels]
    assert at and len(marked) == len(labels)
    d = text[:, 1 << 16 :]
    used = d[marked + pool]
    text[:, 1 << 16 :] = (d - used.mean(0)) / np.maximum(used.std(0), 1e-3)

    def logistic(x, y, weight, l2):
        w, b = np.zeros(x.shape[1]), 0.0
        weight = weight / weight.sum()
        p = np.clip((weight * y).sum(), 1e-3, 1 - 1e-3)
        b, m, v, mb, vb = np.log(p / (1 - p)), 0, 0, 0, 0
        for t in range(1, 81):
            e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
            g, gb = x.T @ e + l2 * w, e.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        return lambda z: z @ w + b

    scores, handed = [], []
    for label in (0, 1):
        y = np.array([labels[rows[i][0]][label] for i in marked], float)
        check = np.arange(len(y)) % 4 == 3
        views, l2 = (text, meta), (1e-5, 1e-3)
        extra = [{}, {}]
        for r in range(4):
            models = []
            for k in (0, 1):
                x = np.concatenate([views[k][marked][~check], views[k][pool][sorted(extra[k])]])
                models.append(logistic(x, np.concatenate([y[~check], [extra[k][j] for j in sorted(extra[k])]]), np.concatenate([np.ones((~check).sum()), np.full(len(extra[k]), 0.5)]), l2[k]))
            if r == 3:
                break
            for k in (0, 1):
                p, q = (1 / (1 + np.exp(-models[k](views[k][z]))) for z in (pool, np.array(marked)[check]))
                good = []
                for c in (0, 1):
                    sure = (np.maximum(q, 1 - q) >= 0.95) & ((q >= 0.5) == c)
                    share = (y[~check] == c).mean()
                    good.append(sure.sum() >= 5 and (y[check][sure] == c).mean() >= max(0.9, (1 + share) / 2))
                free = [j for j in range(len(pool)) if j not in extra[1 - k] and max(p[j], 1 - p[j]) >= 0.95 and good[int(p[j] >= 0.5)]]
                best = sorted(free, key=lambda j: (-abs(p[j] - 0.5), j))[: int(0.1 * len(pool))]
                extra[1 - k].update({j: float(p[j] >= 0.5) for j in best})
        handed.append((len(extra[0]), len(extra[1])))
        z = [cotrain._dense_fit(m(v[marked])[check][:, None], y[check]) for m, v in zip(models, views)]
        z = [c if c[0] >= 0 else np.array([0, cotrain._dense_fit(np.zeros((check.sum(), 0)), y[check])[0]]) for c in z]
        held = np.stack([m(v[marked])[check] * c[0] + c[1] for m, v, c in zip(models, views, z)], 1)
        w = cotrain._dense_fit(held, y[check])
        if w[:2].min() < 0:
            k = int(w[:2].argmax())
            one = cotrain._dense_fit(held[:, [k]], y[check])
            w = np.zeros(3)
            w[k], w[2] = max(one[0], 0), one[1]
        out = sum(wk * (m(v) * c[0] + c[1]) for wk, m, v, c in zip(w, models, views, z)) + w[2]
        scores.append(1 / (1 + np.exp(-out)))
    return scores, handed


_order = {}


def learn_order(ids, texts):
    """Rows in the order in which labelled and other rows are drawn."""
    return [sorted(range(len(ids)), key=lambda i: (_order[ids[i]][k], *_order[ids[i]][2:])) for k in (0, 1)]


def test_cotraining_against_brute_force(spark):
    """Exchange, gate, calibration and combination, on a fixture whose metadata helps one label only."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows, labels = [], {}
    for i in range(360):
        bad, toxic = r.random() < 0.4, r.random() < 0.3
        w = words(20, i) + (["scum"] if toxic and r.random() < 0.9 else [])
        r.shuffle(w)
        source = ("spam" if r.random() < 0.9 else "web") if bad else ("web" if r.random() < 0.9 else "spam")
        rows.append((i, " ".join(x + ("**" if bad and r.random() < 0.5 else "") for x in w), r.choice(["en", "de"]), source, 1))
        if i % 2:
            labels[i] = (int(not bad), int(toxic))
    d = spark.createDataFrame(rows, DOCS)
    keyed = d.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    for x in keyed.select("doc_id", F.xxhash64(F.lit("cotrain"), "doc_id", "h1", "h2"), F.xxhash64(F.lit("cotrain"), "h1", "h2"), "h1", "h2").collect():
        _order[x[0]] = tuple(x[1:])
    lab = spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    m = cotrain.fit(d.repartition(3), lab)
    got = {x.doc_id: x for x in cotrain.score(d, m).collect()}
    want, handed = brute_cotrain(rows, labels)
    assert [tuple(np.sum(h.exchanged, 0)[::-1]) for h in m.heads] == handed and sum(handed[0]) > 0
    for k, c in enumerate(("quality_score", "toxic_score")):
        assert np.abs(np.array([got[i][c] for i in range(360)]) - want[k]).max() < 1e-3
    assert {x.quality_views for x in got.values()} == {m.heads[0].used}


def test_cotraining_sample_is_bounded(spark):
    """Repeated and conflicting labels, one id or text in most rows, clashing columns."""
    rows = [(7, "one and the same text", "en", "s")] * 2000 + [(k, " ".join(words(12, k)), "en", "s") for k in range(100, 400)] + [(None, " ".join(words(12, k)), None, None) for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS quality", "'x' AS h1")
    lab = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (7, 0, 0), (None, 1, 1)] + [(k, k % 2, 0) for k in range(100, 300)], "doc_id long, quality int, toxic int")
    seen = []
    fit = cotrain.Classifier.fit
    cotrain.Classifier.fit = lambda self, views, y, pool: (seen.append((len(y), len(pool[0][2]) - 1)), fit(self, views, y, pool))[1]
    try:
        out = cotrain.score(d, cotrain.fit(d, lab, 150, 60))
    finally:
        cotrain.Classifier.fit = fit
    assert seen[0][0] == 150 and 30 <= seen[0][1] <= 60 and out.count() == len(rows)
    full = cotrain.fit(d, lab)
    assert full.heads[1].share == 0.0 and full.heads[0].share is None


# --- 6 -------------------------------------------------------------------------------------


def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    want = sorted([(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in corpus()], key=str)
    for chunk, overlap in ((32768, 256), (60, 4)):
        assert sorted(map(tuple, token_counts.token_counts(docs, model(), chunk=chunk, overlap=overlap).collect()), key=str) == want
    assert token_counts.token_counts(empty, model()).collect() == []


def test_token_counts_widen():
    c = token_counts.PieceCounter(model(), 50, 2)
    for t in ["abc" * 400, "=" * 900, "\n" * 500, " " * 777 + "x", "😀é" * 300]:
        assert c.counts([t]) == [len(c.sp.encode(t))]
    assert c.widened > 0


def test_token_counts_without_stable_boundaries():
    """A million characters that no place can cut cost a few encodings, not one a chunk."""
    c = token_counts.PieceCounter(model())
    text = "ab" * 500_000
    began = time.perf_counter()
    want = len(c.sp.encode(text))
    library = time.perf_counter() - began
    began = time.perf_counter()
    assert c.counts([text]) == [want]
    assert time.perf_counter() - began < 4 * library + 2


# --- 7 -------------------------------------------------------------------------------------


def brute_contamination(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, got = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k : k + m]))):
                    hit.update(range(k, k + m))
                    got |= x
        ids = ",".join(sorted(map(str, got)))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_both_ways(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    items = [(1, " ".join(words(60, 99)[5:40])), (2, " ".join(words(60, 99)[5:40]).upper()), (3, "two words"), (4, None), (5, "!!"), (10, " ".join(words(120, 1)[50:60])), (11, " ".join(words(9000, 7)[-11:])), (12, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(corpus(), items)
    for limit in (1 << 20, 0):
        assert sorted(map(tuple, decontaminate.contamination(docs, bench, limit).collect()), key=str) == want
        assert decontaminate.contamination(empty, bench, limit).collect() == []
        assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0), limit).collect())
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[5]}


def test_contamination_of_items_without_id(spark):
    """Both ways and the SQL agree: null item_ids are one item, without a part in the digest."""
    import duckdb

    items = [(1, "one two three"), (None, "three four"), (None, "five six"), (2, "seven")]
    rows = [(1, "one two three four"), (2, "three four five six"), (3, "seven and seven"), (4, "nothing")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, column, values in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    want = sorted(con.execute(sql.OP7).fetchall())
    assert [w[3] for w in want] == [2, 1, 1, 0]
    for limit in (1 << 20, 0):
        assert sorted(map(tuple, decontaminate.contamination(d, bench, limit).collect())) == want


def test_rows_of_null_and_repeated_ids(spark):
    """Rows are told apart by doc_id and text: what one loses, the others of its doc_id keep."""
    own = lambda k: " ".join(words(12, 500 + k))
    rep, bad = " ".join(words(15, 600)), " ".join(words(15, 700))
    for i in (None, 7):
        d = spark.createDataFrame([(1, f"{own(0)}\n{rep}"), (i, f"{own(1)}\n{rep}"), (i, f"{own(2)}\n{own(3)}")], "doc_id long, text string").repartition(3)
        assert {r.text for r in line_dedup.line_dedup(d).collect()} == {f"{own(0)}\n{rep}", own(1), f"{own(2)}\n{own(3)}"}
        bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
        d = spark.createDataFrame([(i, own(1)), (i, f"{own(2)} {bad}"), (2, own(3))], "doc_id long, text string").repartition(3)
        for limit in (1 << 20, 0):
            assert {r.text for r in decontaminate.decontaminate(d, bench, broadcast_bytes=limit).collect()} == {own(1), own(3)}
        d = spark.createDataFrame([(i, own(1)), (i, own(1)), (i, own(2)), (i, own(2) + " more"), (8, own(2)), (i, "two words"), (i, "two words"), (i, None), (i, "")], "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()), key=str)
        two = [x for x in got if x[1] and x[1].startswith(own(2))]
        assert len(two) == 1 and two[0][0] == (8 if i is None else 7)
        assert [x for x in got if x not in two] == sorted([(i, own(1)), (i, "two words"), (i, None), (i, "")], key=str)


LAST = 2**63 - 1


@pytest.mark.parametrize("ids", [(None, 1), (1, None), (LAST, 5), (5, LAST), (LAST, None), (None, LAST), (None, None), (-LAST - 1, None)])
def test_one_null_id_and_the_largest_id(spark, ids):
    """No value of doc_id stands for null: of two copies one stays, the null one goes, and the largest id is an id."""
    text, line = " ".join(words(40, 800)), " ".join(words(15, 801))
    d = spark.createDataFrame([(ids[0], text), (ids[1], text), (77, " ".join(words(30, 802)))], "doc_id long, text string").repartition(3)
    least = min((i for i in ids if i is not None), default=None)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_components(d).collect()), key=str)
    assert got == sorted([(i, least) for i in ids] + [(77, 77)], key=str)
    assert sorted((r.doc_id for r in ngram_join.keep_one(d).collect()), key=str) == sorted([least, 77], key=str)
    rows = [(ids[0], f"{line}\nfirst of them"), (ids[1], f"{line}\nsecond of them all")]
    learn_keys(spark, [r[1] for r in rows])
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(rows)


# --- 8 -------------------------------------------------------------------------------------


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = language_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = language_id.language_id(docs).collect()
    assert len(odd) == len(corpus())
    by = {r.doc_id: r.lang_pred for r in odd}
    assert by[0] == by[1] == by[2] == "und" and by[11] in ("en", "de")
    assert language_id.language_id(empty).collect() == []
    assert {r.lang_pred for r in language_id.language_id(docs.where("lang IS NULL")).collect()} == {"und"}


def brute_languages(train, texts):
    """The model and the posteriors, word by word."""
    split = lambda t: re.findall(r"[A-Za-z\x80-\U0010ffff]+", (t or "").translate(LOW))
    grams = lambda w, k: [w] if k == 0 else [w[i : i + k] for i in range(len(w) - k + 1)]
    counts = collections.defaultdict(collections.Counter)
    for lang, t in {(g, t) for g, t in train if g is not None and t is not None}:
        for w in split(t):
            for k in range(6):
                counts[lang, k].update(grams(w, k))
    langs = sorted({g for g, _ in counts} | {g for g, t in train if g is not None and t is not None})
    score = lambda k, x: [math.log((counts[g, k][x] + 0.5) / (sum(counts[g, k].values()) + 1)) for g in langs]
    known = [set().union(*(counts[g, k] for g in langs)) if langs else set() for k in range(6)]
    for t in texts:
        if not langs or not any(c.isalpha() for c in t or ""):
            yield "und", 0.0
            continue
        total = np.zeros(len(langs))
        for w in split(t):
            for k in (0, 5, 4, 3, 2, 1):
                hit = [x for x in grams(w, k) if x in known[k]]
                if hit:
                    total += np.mean([score(k, x) for x in hit], 0)
                    break
        best = int(np.argmax(total))
        yield langs[best], 1 / np.exp(total - total[best]).sum()


def test_language_id_against_brute_force(spark):
    """Ties, repeated rows, unknown words, words that only some languages have."""
    import zlib

    some = ["the cat sat on the mat", "le chat est la", "die Katze ist da, Größe", "the the the", "", None, "12 !?", "catze", "zzz qqq", "xhyw the", "日本語", "a", "le " * 40, "katzenhaus mats chats"]
    rows = [(i, some[i % len(some)], ["en", "fr", "de", None][(i % len(some)) % 4]) for i in range(60)] + [(3, some[3], "en"), (3, some[0], "en"), (None, "nobody learns this", "xx"), (61, "sat", "fr"), (62, "sat", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(tuple, language_id.language_id(d).collect()), key=str)
    train = [(g, t) for i, t, g in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = sorted([(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, g, x) for (i, *_), (g, x) in zip(rows, brute_languages(train, [r[1] for r in rows]))], key=str)
    key = lambda rs: [(r[0], r[1], r[2], round(r[3], 5)) for r in rs]
    assert sorted(key(got), key=str) == sorted(key(want), key=str)


def test_language_sample_is_bounded(spark):
    """A text in most rows, under one doc_id, counts once; small samples still learn every language."""
    rows = [(4, "hot text of one document", "en")] * 3000 + [(k, "mot" + "abcdefghij"[k // 100] + "klmnopqrst"[k // 10 % 10] + "uvwxyzabcd"[k % 10], "fr") for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    m = language_id.fit(d.select("lang", "text"), per_lang=100)
    words = len(m.orders[0][0])
    assert m.langs == ["en", "fr"] and 50 < words < 200 and m.lookup(0, language_id._hash_strings(pa.array(["hot"])))[0][0]


# --- 9 -------------------------------------------------------------------------------------


def test_url_filter(spark, monkeypatch):
    """Odd, repeated, very long and hot urls, with and without split keys; empty tables."""
    urls = ["http://hot.net/a"] * 40 + ["http://long.example.com/de/" + "x" * 300_000, "http://" + "sub." * 3000 + "org/fr/"] + [None, "", "no scheme", "http://", "https://NET/", "http://a.b.net", "http://a.b.net/x?y", "http://example.net/en/1#t", "http://m.Example.NET/en/", "http://notexample.net/en/", "http://example.com/de/", "http://example.com/d", "http://x.org/fr/a", "ftp://y.org?/fr/", "http://a.b.net/x?y", "http://h.de/://x.net/"]
    rules = url_filter.DEFAULT_RULES + [("block", "h.de", "")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    by = spark.createDataFrame(rules, "action string, host string, path string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, by).collect()}
    monkeypatch.setattr(url_filter, "HOT_URLS", 2)
    assert len(got) == len(urls) and got == {r.page_id: r for r in url_filter.url_filter(pages, by).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.translate(LOW)
        fit = [(len(h + p), a, h + p) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit) if fit else (0, "allow", None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule[2], rule[1]), u
    assert url_filter.url_filter(pages.limit(0), spark.createDataFrame(rules, "action string, host string, path string")).collect() == []
    assert {r.verdict for r in url_filter.url_filter(pages, spark.createDataFrame([], "action string, host string, path string")).collect()} == {"allow"}


# --- 10 ------------------------------------------------------------------------------------


def test_quality_rules(docs, empty):
    want = []
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(seen) - len(set(seen)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    got = quality_rules.quality_rules(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got.collect())
    assert quality_rules.quality_rules(empty).collect() == []
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.collect())


@pytest.mark.parametrize("least", [3, 50])
def test_quality_verdicts_against_brute_force(spark, monkeypatch, least):
    """Fences from sorted values, group by group, with the fall back of thin groups."""
    monkeypatch.setattr(quality_rules, "MIN_GROUP", least)
    r = random.Random(6)
    rows = []
    for i in range(240):
        w = words(r.randrange(5, 60), i)
        if i % 17 == 0:
            w = [x + "#*$%" for x in w]
        if i % 23 == 0:
            w = [x * 9 for x in w]
        t = "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))
        rows.append((i, t + ("\n" + t.split("\n")[0]) * (i % 5 == 0) if i % 40 else None, [None, "en", "de", "fr"][i % 4], [None, "a", "b"][i % 3] if i % 50 else f"rare{i}", 1))
    stats = {x.doc_id: x for x in quality_rules.text_stats(spark.createDataFrame(rows, DOCS)).collect()}
    value = lambda x, m: quality_rules.METRICS[m][2] * x[quality_rules.METRICS[m][0]] // max(x[quality_rules.METRICS[m][1]], 1)
    floor = lambda v: v if v < 16 else v >> (v.bit_length() - 5) << (v.bit_length() - 5)
    failed = {i: x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words for i, x in stats.items()}
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    for i, x in stats.items():
        if not failed[i]:
            for key in ((x.lang, x.source), x.lang, "all"):
                for m in quality_rules.METRICS:
                    groups[key, type(key) is tuple][m].append(floor(value(x, m)))
    want = {}
    for i, x in stats.items():
        bad = False
        for m, (*_, slack, lower) in quality_rules.METRICS.items():
            sizes = [k for k in (((x.lang, x.source), True), (x.lang, False)) if len(groups[k][m]) >= least]
            v = sorted(groups[sizes[0] if sizes else ("all", False)][m])
            q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
            got = value(x, m)
            bad |= got > q3 + 3 * (q3 - q1) + slack or lower and got < q1 - 3 * (q3 - q1) - slack
        want[i] = not failed[i] and not bad
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert kept == want and 0 < sum(not v for i, v in kept.items() if not failed[i]) < 60


def test_sketch_buckets_bound_the_error(spark):
    v = [0, 1, 15, 16, 17, 31, 32, 33, 100, 1000, 12345, 10**9]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    b = quality_rules.sketch_bucket(df["v"])
    for r in df.select("v", b.alias("b"), quality_rules.bucket_floor(b).alias("lo")).collect():
        assert r.lo <= r.v <= r.lo * 17 / 16


def test_sample_of_the_classifier_is_chosen_without_texts(spark):
    """Rows to fit on are chosen by their keys; a very long text among them, repeated rows, copies and null ids are one row each."""
    rows = [(k, " ".join(words(12, k)), "en", "s") for k in range(60)] + [(7, " ".join(words(12, 7)), "en", "s")] * 300 + [(k, "a copy without a label", "en", "s") for k in range(100, 400)] + [(None, "nobody knows", None, None), (None, "nobody knows", None, None), (99, "long " * 2_000_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(99, 1, 1)], "doc_id long, quality int, toxic int")
    got = cotrain.chosen(docs, marks, 100, 100).collect()
    assert sorted(r.doc_id for r in got if r.part == 0) == [*range(30), 99]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.part == 1) == [*((False, k) for k in range(30, 60)), (False, 100), (True, 0)]
    assert len(cotrain.chosen(docs, marks, 5, 3).collect()) == 8
    model = cotrain.fit(docs, marks, 100, 100)
    assert all(h.share is None or 0 <= h.share <= 1 for h in model.heads)
    seen = []
    plain = cotrain._first
    try:
        cotrain._first = lambda df, n, *c: seen.append(df.columns) or plain(df, n, *c)
        cotrain.fit(docs, marks, 10, 10)
    finally:
        cotrain._first = plain
    assert seen and not any("text" in c for c in seen)
