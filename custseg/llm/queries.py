"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``.

Each applies one operator, with production parameters, to its whole table and
derives the columns of its contract from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.llm import (alignment, ann, chat, langid, maxscore, minhash, mixing, packing, quality, repair,
                         suffix_dedup, toxicity, warc)
from custseg.llm.common import table
from custseg.llm.oracles import ORACLES


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_embeddings(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_embeddings(table(spark, sf_dir, "embeddings"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digests(*chat.prefix_tree(turns.unionByName(extra)))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("record_id", "canonical_url", "status", "target_id",
                      F.array_join(entries, ";").alias("headers"),
                      F.md5("payload").alias("payload_md5"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    plans, rows = repair.repair(repair.damaged(turns))
    found = plans.join(repair.digest(rows).withColumnRenamed("conv_id", "_digest_id"),
                       F.col("conv_id").eqNullSafe(F.col("_digest_id")), "left").drop("_digest_id")
    # a conversation that lost all its rows has no plan
    ids = turns.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learn = F.crc32(F.col("_l").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.classify(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


def queries():
    return {f.__name__: f for f in (
        op1_repeated_passages, op2_near_duplicates, op3_nearest_neighbours, op4_quality, op5_source_mixing, op6_packing, op7_maxscore,
        op8_chat_tree, op9_revisits, op10_language_id, op11_conversation_repair, op12_token_alignment, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
