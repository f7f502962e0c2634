"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, token encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.

Defined results in every stage: a null text counts as empty; rows are told apart by a row
number, so rows without an id or with a repeated one are decided each by its own text; an
empty table gives an empty table; further columns are carried along whatever their names.
Ids only choose among copies: the largest stays of equal texts (nulls lose), the least of
near copies (nulls last).

A stage begins with the one before written, so it removes the scratch tables that were made
since then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chalkline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from chalkline.llm.common import forget, release, shared_dir, table
from chalkline.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forget()
    return toxicity.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return exact_dedup.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return simhash.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hash functions, fitted models and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{place}/{name}")
    return docs
