"""The corpus pipeline: each stage reads what the one before has written as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, mixing, sharding, simhash, toxicity
from loomline.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts have no evidence and stay, unless ordinary texts are
    rare among the labels; rows equal in text share their fate; long texts are
    read whole; an empty table stays empty.
    """
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of the smallest doc_id, nulls last.

    Texts without words, null ones among them, are one component; of rows equal
    in doc_id and text one stays; long texts are read whole; an empty table
    stays empty.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; repeated rows share their fate;
    long texts are searched whole; an empty table stays empty.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times.

    Rows without words stay once; rows equal in doc_id and text are each taken as
    often; a null source is a source; an empty table stays empty.
    """
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, texts and all, with its shard and its slot in it.

    Null ids, null and empty texts, long ones and repeated rows are dealt out
    like any other; an empty table stays empty.
    """
    return sharding.deal_out(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Class-conditional models and SimHash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
