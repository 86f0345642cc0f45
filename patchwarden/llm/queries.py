"""The opN queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import cotrain, html_extract, language_id, line_dedup, near_vectors, ngram_join, periodic_runs, quality_rules, sp_codec, token_alignment, token_counts, url_filter
from ._shared import table
from .sql import ORACLES


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.codec_report(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.DEFAULT_RULES)
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, spark.sql(f"SELECT * FROM VALUES {rules} AS r(action, host, path)")).drop("url")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_MODEL), tokenizer_path(PIECE_MODEL))[0]


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with a periodic tail in each text whose doc_id's checksum h ends in 0: of its n words, those from a = g % n on (g = h div 10)
    repeat the first 1 + (n - a) div (3 + g % 8) of them."""
    words = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string"))).withColumn(
        "__w", F.when(F.col("__h") % 10 == 0, F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)"))
    )
    sized = words.withColumn("__n", F.size("__w")).withColumn("__g", F.expr("__h div 10")).withColumn("__a", F.expr("CASE WHEN __n > 0 THEN int(__g % __n) END"))
    sized = sized.withColumn("__p", F.expr("int(1 + (__n - __a) div (3 + __g % 8))"))
    planted = "array_join(concat(slice(__w, 1, __a), slice(flatten(array_repeat(slice(__w, __a + 1, __p), int(ceil((__n - __a) / __p)))), 1, __n - __a)), ' ')"
    return sized.select("doc_id", F.expr(f"CASE WHEN __n > 0 THEN {planted} ELSE text END").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_jaccard, op2_sentencepiece, op3_line_dedup, op4_html_extraction, op5_quality_classifier,
        op6_token_counts, op7_decontamination, op8_language_id, op9_url_filter, op10_quality_rules,
        op11_embedding_dedup, op12_token_alignment, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
