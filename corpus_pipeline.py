"""A corpus pipeline of five training-data operators: rules, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents.

In every stage: columns of docs may be null and have any further names; null and empty texts, texts of any length, repeated rows
and empty tables are what the stage's operator says of them, as each stage's docstring tells.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard_join, line_dedup, pieces, quality_rules
from millrace.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; cutoffs are calibrated on the labelled ones among docs.

    Null and empty texts have no words and go by the base rule. A value equal to its cutoff stays. Repeated rows stay or go together.
    """
    cutoffs = quality_rules.fit_cutoffs(docs, read(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, cutoffs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of recurring runs of lines go, and documents that hold no word then. n_chars follows the text.

    Documents that lose nothing stay as they are, null and empty texts as well. Of copies the one with the least id keeps its lines,
    null ids first; repeated rows are one document.
    """
    out = line_dedup.dedup_lines(docs, min_words=50)
    left = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest id (a null id only where all are).

    Null, empty and blank texts link with nothing and stay, each row. Of repeated rows one stays.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=75).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows stay or go together."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (16-bit little-endian), and two sampled segmentations with their inclusion scores.

    Null and empty texts have no ids and one empty sample; repeated rows get equal rows. Executors have run other stages before, so
    workers hold less and give it back.
    """
    small = {"chunk": 500_000, "cached": 60_000, "release": True}
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), k=2, keep=["doc_id", "lang", "source"], packed=True, **small)
    return out.select("doc_id", "lang", "source", (F.length("ids") / 2).cast("long").alias("n_ids"), "ids", "decoded", "samples")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: Calibrated cutoffs and sampled segmentations can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
