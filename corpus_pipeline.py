"""Training-data pipeline over ``documents``: language, near duplicates, repeated paragraphs, mixture, packing.

Each stage is handed what its predecessor wrote, works on all of it and returns the columns of ``documents``; the
last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import langid, mixing, neardup, packing, paragraphs
from folioscope.llm.names import free
from folioscope.session import kept, small_batches

TOKENIZER = "word_bpe_49k.json"
LEAST_SCORE = 0.5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half; a missing language is filled in.

    Null texts and texts without a letter have no language and go. Repeated rows fare alike; an empty table gives no rows.
    The session keeps small batches for the stages that follow.
    """
    small_batches(spark)
    found = langid.identify(docs, langid.train(docs))
    told = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (four fifths of their five-word shingles alike): the one with the least doc_id, of
    several the first as they are stored.

    Rows are told apart by their place, not by doc_id: of rows that repeat doc_id and text one stays, and another text under the
    doc_id of a near copy stays. Rows without words, without text or without doc_id are in no group and all stay; an empty table gives no rows.
    """
    row, least = free(docs.columns, "_row"), free(docs.columns, "_least")
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # places are fixed from here on
    known = rows.filter("doc_id is not null")
    found = neardup.near_duplicates(known.select(F.col(row).alias("doc_id"), "text"), NEAR_PERCENT)
    grouped = found.filter("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias(least))
    members = kept(known.select(row, "doc_id").join(grouped, row), "members")
    first = members.groupBy(least).agg(F.min(F.struct("doc_id", row)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = members.join(first, least).filter(F.col(row) != F.col(f"first.{row}")).select(row)
    return rows.join(kept(gone, "gone").hint("merge"), row, "left_anti").select(*docs.columns)


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one has; documents of nothing else go.

    Rows without text or doc_id stay as they are; rows equal in doc_id and text are one place and lose nothing to each other.
    """
    return paragraphs.without_repeats(docs, paragraphs.repeats(docs, by_text=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the expected tokens of sources, languages and topics are evened out.

    Null sources and languages are values of their own; equal rows are drawn or left alike.
    """
    return mixing.mix(docs).filter("sampled").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces in sequences of 4096; null texts are empty, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_paragraphs", drop_repeated_paragraphs),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express none of the models; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, name)
    return docs
