"""The numbered queries: thin steps from the driver's tables to the operators of this subpackage and back.

``documents`` stand for filing documents: doc_id is ``filing_id``, text is ``document``, lang is ``language`` and source
is the only entry of ``exchanges``. ``embeddings`` stand for securities: vec_id is ``security_id``, the embedding are its
factor ``exposures`` and label is its ``sic_code``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (codes, decontaminate, edit_counts, language, lexical, mixing, neighbours, pii, quality, shards, simhash,
               token_orc, toxicity)
from ..functions.lineage import new_path
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{i:02d}" for i in range(16)]


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def as_filings(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("filing_id"), F.col("text").alias("document"),
                       F.col("lang").alias("language"), F.array("source").alias("exchanges"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    return as_filings(spark.read.parquet(f"{sf}/documents.parquet"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("item"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows no model may learn from: crc32 of the id as text, by remainder. A NULL id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


@register("op1_decontaminate")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(filings(spark, sf), items(spark, sf)).withColumnRenamed("filing_id", "doc_id")


@register("op2_token_orc")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_orc.write_token_files(filings(spark, sf), path, vocabulary())
    files = token_orc.read_token_files(spark, path)
    return (token_orc.token_starts(token_orc.token_digests(files), files)
            .select(F.col("filing_id").alias("doc_id"), "start", "n_tokens", "ids_crc32"))


@register("op3_edit_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    kept = edit_counts.with_kept_trees(filings(spark, sf), vocabulary())
    return (edit_counts.edited_filings(kept, edit_counts.redactions("document"), vocabulary())
            .select(F.col("filing_id").alias("doc_id"), F.col("edited").alias("_e"))
            .select("doc_id", F.col("_e.n_tokens_before").alias("n_tokens"), F.col("_e.n_leaves_before").alias("n_leaves"),
                    "_e.n_edits", F.col("_e.n_tokens").alias("n_tokens_edited"), F.col("_e.n_chars").alias("n_chars_edited"),
                    "_e.n_chars_reencoded"))


@register("op4_simhash_pivots")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(filings(spark, sf)).withColumnRenamed("filing_id", "doc_id")


def toxicity_model(spark: SparkSession, sf: str):
    labels = (spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
              .select(F.col("doc_id").alias("filing_id"), "toxic"))
    return toxicity.fit(filings(spark, sf), labels)


@register("op5_toxicity_ftrl")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    score = toxicity.toxicity("document", *toxicity_model(spark, sf))
    return (filings(spark, sf).select(F.col("filing_id").alias("doc_id"),
                                      held_out(F.col("filing_id"), 5, 0).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@register("op6_language_bigru")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    rows = filings(spark, sf)
    model = language.fit(rows.where(~held_out(F.col("filing_id"), 4, 2)))
    return (rows.select(F.col("filing_id").alias("doc_id"), held_out(F.col("filing_id"), 4, 2).alias("held_out"),
                        language.language_of("document", *model).alias("_p"))
            .select("doc_id", "held_out", F.col("_p.language").alias("lang_pred"), F.col("_p.score").alias("score")))


@register("op7_sharding_table", oracles.sharding(SHARDS))
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return (shards.place(filings(spark, sf).select("filing_id"), SHARDS, key="filing_id")
            .select(F.col("filing_id").alias("doc_id"), "slot", "shard"))


@register("op8_quality_divergence")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    rows = filings(spark, sf)
    verdict = quality.quality("document", quality.language_references(rows))
    return (rows.select(F.col("filing_id").alias("doc_id"), verdict.alias("_q"))
            .select("doc_id", "_q.*").withColumnRenamed("language", "nearest_language"))


@register("op9_mix_flow", oracles.mixing(mixing.Mix()))
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return (mixing.mixture(filings(spark, sf))
            .select(F.col("filing_id").alias("doc_id"), "size", "source_size", "target", "taken"))


@register("op10_pii_anchors")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return (filings(spark, sf).select(F.col("filing_id").alias("doc_id"), pii.personal_data("document").alias("_p"))
            .select("doc_id", "_p.*"))


def securities(spark: SparkSession, sf: str) -> DataFrame:
    return (spark.read.parquet(f"{sf}/embeddings.parquet")
            .select(F.col("vec_id").alias("security_id"), F.col("embedding").alias("exposures"),
                    F.col("label").alias("sic_code")))


@register("op11_lexical_buckets", oracles.LEXICAL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked_filings(filings(spark, sf), items(spark, sf)).withColumnRenamed("filing_id", "doc_id")


@register("op12_sliced_codes", oracles.CODES)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return codes.exposure_codes(securities(spark, sf)).withColumnsRenamed(
        {"security_id": "vec_id", "sector_error": "label_error"})


@register("op13_collision_neighbours")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.nearest_peers(securities(spark, sf), asked=F.col("security_id") % 20 == 0)
    return found.select(F.col("security_id").alias("query_id"), "rank", F.col("peer_id").alias("vec_id"),
                        F.col("product").alias("score"))


@register("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf)
