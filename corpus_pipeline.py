"""The training-text pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark items go, the rest
is mixed to source targets (a document taken twice is there twice), and every row gets a shard.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitrank.functions.lineage import materialize
from pitrank.llm import decontaminate, mixing, queries, shards, similar, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is under one half, by a model learned from the labelled rows of ``sf_dir``.

    Documents without text get the model's base rate; without labels that is one half and nothing is kept out but these.
    """
    score = toxicity.toxicity("text", *queries.toxicity_model(spark, sf_dir))
    return docs.where(score < 0.5)


def as_filings(docs: DataFrame) -> DataFrame:
    """Documents as records of the operators: the id, the text and the whole row in ``row``; columns of other names can
    then not be in their way."""
    return docs.select(F.col("doc_id").alias("filing_id"), F.col("text").alias("document"), F.struct(*docs.columns).alias("row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of texts linked by five-word Jaccard similarity of 0.8 or more.

    Texts are compared whose SimHash fingerprints are linked, by the operator's pivot tables, or who share a MinHash cell.
    Documents without text are one group; one row of it stays. An empty table stays empty.
    """
    return similar.one_of_each_group(as_filings(docs)).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, allowing for edits. Documents without text stay."""
    return decontaminate.without_leaks(as_filings(docs), queries.items(spark, sf_dir)).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Documents without words are taken 0 times; an unknown source is one."""
    rows = as_filings(docs).withColumn("exchanges", F.array("row.source"))
    return mixing.mixed_filings(rows).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard by document id; documents without id share a slot."""
    return shards.place(docs, queries.SHARDS, key="doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# A learned classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
