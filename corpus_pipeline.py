"""The training-data pipeline: named stages, each calling one operator of spindlewatch.llm."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm import cuckoo, langid, mixing, ngramjoin, packing
from spindlewatch.llm.common import stage, table
from spindlewatch.llm.queries import BUDGET, CAPACITY, END_ID, WEIGHTS, vocabulary


#: A text whose best language has less than this share of its probability is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows stay; text without a letter or without a clear language goes."""
    model = langid.fit(docs, vocabulary("piece_bpe_32k.model"))
    return langid.keep(docs, model, LEAST_SHARE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return cuckoo.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of linked texts stays; rows without doc_id can't be linked and stay."""
    same = ngramjoin.classes(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(same, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources meet their targets."""
    return mixing.mixed(docs, WEIGHTS, BUDGET)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of the mix as token sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [("language_id", language), ("exact_dedup", exact_dedup), ("ngram_join", near_dedup), ("source_mix", source_mix), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
