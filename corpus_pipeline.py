"""A training corpus from raw documents: five stages, each one operator of custseg.llm.

quality         documents that the weak-label classifier rejects go
near_duplicates one document of each near-duplicate class stays
repeats         passages of 200 bytes or more that occur again are cut from the texts
mix             documents are repeated or left out so that sources meet their targets
pack            texts become pieces of 2048-token sequences

Every stage works on all rows that the one before it kept; all but the last
return the columns of ``documents`` (``n_chars`` follows a text that was cut).
The classifier takes its annotations from ``labels``.  Nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns are treated as
each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.llm import minhash, mixing, quality, suffix_dedup
from custseg.llm.common import saved, table
from custseg.llm.queries import packed


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack),
]

#: SQL cannot express the stages; tests/llm compares the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
