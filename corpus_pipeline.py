"""A training-data pipeline over `documents`: each stage is written as Parquet and read again by the next.

language_id drops null texts and texts without letters, and fills null languages where one could be learnt; how clear a
language is depends on how many there are, so no threshold of the score drops a text. line_dedup drops lines of
recurring templates. near_duplicates keeps one document of each group of a similarity of 0.8 or more. secrets masks what
the scanner accepts. packing, the last, returns the packed pieces.

Defined cases are those of the operators; besides, a document emptied by line dedup stays as an empty text, rows
with a null doc_id pass near-duplicate detection, and rows equal in doc_id and text become one there. n_chars follows
the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, linededup, neardup, packing, secrets
from quire.llm.common import scratch, stored, table

SIMILAR = 80  # percent
END_ID = 1


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = langid.learn(docs)
    told = langid.identify(docs, filters, {c: F.col(c) for c in docs.columns})
    kept = told.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(linededup.drop_lines(docs)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(docs, SIMILAR)
    keepers = groups.where("kept and doc_id is not null").select(F.col("doc_id").alias("keeper")).distinct()
    kept = docs.join(keepers, docs.doc_id == keepers.keeper, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]
ORACLE_SQL = None  # tokenizing and packing are not SQL; tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; tables that a stage made on its way go once its result is written."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir))
            made += held
            held = [made.pop(len(made) - 1 - len(held))]
    return STAGES[-1][1](spark, docs, sf_dir)
