"""Corpus cleaning pipeline: each stage applies one operator of paperquill.llm to all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperquill.llm import decontaminate, near_dup, toxicity
from paperquill.llm import queries as q
from paperquill.llm.base import Scratch, columns_of, fresh, read_table

#: Near-duplicates are texts whose five-word shingles have at least this similarity, in per cent.
NEAR_DUP_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among them."""
    scratch = Scratch(spark, "toxicity")
    model = q.toxicity_model(docs, read_table(spark, sf_dir, "labels"), scratch)
    (score,) = fresh(docs, "score")
    scored = toxicity.score_documents(docs, model, out=score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    scratch = Scratch(spark, "near-dup")
    return near_dup.keep_one(docs, scratch, NEAR_DUP_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark text; of items shorter than a window, without a twentieth of their words."""
    scratch = Scratch(spark, "decontaminate")
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"), scratch)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every kept document, and their decoding, as digests."""
    return q.byte_bpe_digests(docs, public_tokenizers.path(q.BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: The stages as a whole can't be said in SQL: a classifier is trained, and the encoder merges until no pair is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table between two stages is written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
