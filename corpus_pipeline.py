"""A training-data pipeline over the documents table: each stage's rows are written as Parquet and
read again as the next one's input.

Rows are told apart by doc_id and text, never by doc_id alone. Defined results of all stages: a null text has no
words, so the first stage rejects it; null and repeated doc_ids are kept as they are and change nothing for rows
with other texts; of rows with equal doc_id and text, as of all copies, one stays after the third stage; null lang
and source are groups of their own; columns beyond those of documents pass through the first four stages,
whatever their names, and the last returns its own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwarden.llm import decontaminate, line_dedup, ngram_join, quality_rules, sp_codec
from patchwarden.llm._shared import materialize, table
from patchwarden.llm.queries import PIECE_MODEL, tokenizer_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those under 10 words or of which a fifth and more repeats, and those outside the
    fences of their language and source."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing but white space is left; n_chars follows the text."""
    own = {c: f"__{c}" for c in docs.columns if c in ("n_lines", "n_removed")}  # columns of docs with these names
    kept = line_dedup.line_dedup(docs.withColumnsRenamed(own))
    full = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(full).withColumn("n_chars", F.length("text").cast("long")).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: that of the smallest doc_id (null last; of one
    doc_id any)."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, row by row."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the proof that they decode to the text."""
    coded = sp_codec.sp_encode(docs, tokenizer_path(PIECE_MODEL), proof="lossless")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "lossless")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

#: Fuzzy line dedup and the seeded segmentation have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
