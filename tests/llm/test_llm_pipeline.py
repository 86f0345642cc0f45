"""The corpus pipeline: stages, effects and the whole run against its stages' brute-force results."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline as P
from patchwarden.llm import _text as K
from test_llm_operators import LOW, brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_columns(staged):
    assert all(d.columns == P.DOCUMENT_COLUMNS for d in staged[:-1])
    sizes = [d.count() for d in staged]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]


def test_near_duplicates_keep_one_of_each_group(staged):
    rows = [tuple(r) for r in staged[2].collect()]
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert {r.doc_id for r in staged[3].collect()} == want


def test_no_contamination_is_left(spark, staged):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in staged[3].collect()]
    want = {i for i, *_, bad in brute_contamination(rows, items) if not bad}
    assert {r.doc_id for r in staged[4].collect()} == want


def test_lines_are_unique(staged):
    seen = collections.Counter(x.translate(LOW) for r in staged[2].collect() for x in r.text.split("\n") if len(x.encode()) >= 32)
    assert max(seen.values()) == 1
    assert all(r.n_chars == len(r.text) and re.search(r"[^\x20\x09-\x0D]", r.text) for r in staged[2].collect())


def test_tokens_decode(staged):
    assert all(r.lossless and r.n_tokens == len(r.token_ids) for r in staged[5].collect())


def test_run_equals_its_stages(spark, staged):
    got = {(r.doc_id, tuple(r.token_ids)) for r in P.run(spark, SF).collect()}
    assert got == {(r.doc_id, tuple(r.token_ids)) for r in staged[5].collect()}


def test_empty_documents(spark, staged):
    d = staged[0].limit(0)
    for _, stage in P.STAGES:
        d = stage(spark, d, SF)
        assert d.count() == 0


def test_exact_copies_leave_one_document(spark):
    """Short lines of a copy do not outlive it, whatever the doc_ids are."""
    tail = "All rights reserved.\n\nMIT"
    texts = [f"Title {k}\n{' '.join(f'{w}{k}' for w in 'these are the words of a text that stands here more than once'.split())}\n{tail}" for k in range(4)]
    ids = [(0, 10, 11), (1, 1, 12), (None, None, 13), (None, None, None)]
    rows = [(i, t, "en", "s", len(t)) for t, group in zip(texts, ids) for i in group]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = [r.text for r in P.near_duplicates(spark, P.lines(spark, d, SF), SF).collect()]
    assert sorted(t.split("\n")[0] for t in left) == [f"Title {k}" for k in range(4)]


def test_odd_rows_through_the_pipeline(spark):
    """Null and repeated ids, one id with two texts, repeated rows, null texts, a clashing column: clean rows stay."""
    text = lambda k: "\n".join(" ".join(f"{w}{k}x{j}" for w in "some words of a clean document that nobody has seen before today".split()) for j in range(3))
    bad = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(6)), (6, text(6)), (None, text(7)), (None, text(7)), (7, text(1)), (None, text(8) + " " + bad), (5, bad + " " + text(9)), (None, None), (8, None), (9, "")]
    d = spark.createDataFrame([(i, t, None if k % 2 else "en", "s", 1, "z") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n_removed string").repartition(3)
    for _, stage in P.STAGES[:4]:
        columns = d.columns
        d = stage(spark, d, SF)
        assert d.columns == columns
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(6)), (None, text(7))]
    assert {r.n_removed for r in d.collect()} == {"z"}
    assert sorted(((r.doc_id, r.text) for r in d.collect()), key=str) == sorted(want, key=str)
    out = P.tokens(spark, d, SF).collect()
    assert len(out) == 7 and all(r.lossless for r in out)


def test_one_null_copy_goes_through_the_pipeline(spark, tmp_path):
    """Of a document and its copy without a number, the copy goes; the largest number is a number."""
    import random

    r = random.Random(9)
    text = lambda: "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(30)) + "." for _ in range(4))
    a, b, c = text(), text(), text()
    rows = [(3, a, "en", "s", len(a)), (None, a, "en", "s", len(a)), (2**63 - 1, b, "en", "s", len(b)), (None, b, "en", "s", len(b)), (4, c, "en", "s", len(c))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any document, that is for sure")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(x.doc_id for x in P.run(spark, str(tmp_path)).collect()) == [3, 4, 2**63 - 1]
