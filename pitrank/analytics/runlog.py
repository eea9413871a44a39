"""Append-only log of runs as JSON lines, so the number of configurations tried stays visible.

Every entry has an event key. A job that is retried may append its entries again; readers count an event once.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.spec import BacktestSpec

SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("name", T.StringType()),
    T.StructField("config_hash", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("config", T.StructType([
        T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
        T.StructField("factors", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("ranking_method", T.StringType()), T.StructField("missing_policy", T.StringType()),
        T.StructField("top_n", T.IntegerType()), T.StructField("weighting", T.StringType()),
        T.StructField("frequency", T.StringType()), T.StructField("sleeves", T.BooleanType())])),
    T.StructField("cagr_net", T.DoubleType()), T.StructField("sharpe", T.DoubleType()),
    T.StructField("excess_vs_universe_ew", T.DoubleType()), T.StructField("null_percentile", T.DoubleType()),
    T.StructField("fraction_of_oracle", T.DoubleType())])

FIGURES = ("cagr_net", "sharpe", "excess_vs_universe_ew", "null_percentile", "fraction_of_oracle")


CORRUPT = "_unreadable"


def log_rows(headlines: DataFrame, spec: BacktestSpec, source: str, event: str | None = None, run: str = "run_id") -> DataFrame:
    """Log entries for one-row-per-run headline tables; figures a headline lacks stay NULL.

    ``event`` names what is logged and is chosen once if not given, so appending these rows again repeats their keys.
    Where the headlines have a column ``run``, it is part of the key.
    """
    d = spec.as_dict()
    config = F.struct(*[F.lit(d[f.name]).cast(f.dataType).alias(f.name) if f.name != "factors" else
                        F.create_map(*[F.lit(x) for k, v in d["factors"].items() for x in (k, float(v))]).alias("factors")
                        for f in SCHEMA["config"].dataType.fields])
    have = set(headlines.columns)
    key = F.lit(event or uuid.uuid4().hex)
    if run in have:
        key = F.concat_ws(":", key, F.col(run).cast("string"))
    return headlines.select(
        key.alias("event_id"),
        F.current_timestamp().alias("timestamp"), F.lit(spec.name).alias("name"), F.lit(spec.key()).alias("config_hash"),
        F.lit(source).alias("source"), config.alias("config"),
        *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in FIGURES])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line parsed whole: a file reader would check only the fields that a query asks for."""
    full = T.StructType([*SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    return (lines.where(F.trim("line") != "")
            .select("file", "line", F.from_json("line", full, {"columnNameOfCorruptRecord": CORRUPT}).alias("_e"))
            .select("file", "line", "_e.*"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every event, with a stated schema.

    Entries without a key are events of their own. Blank lines give no row; lines that cannot be read are left to
    :func:`unreadable_lines`. Aggregated with partial maxima, so many repeats of an event are reduced where they lie.
    """
    read = _lines(spark, path).where(F.col(CORRUPT).isNull() & F.col("config_hash").isNotNull())
    # a map can't be compared: entries of one event and time are ordered by their text
    newest = F.max_by(F.struct(*SCHEMA.names), F.struct("timestamp", F.to_json(F.struct(*SCHEMA.names))))
    keyed = (read.where("event_id IS NOT NULL").groupBy(F.col("event_id").alias("_event")).agg(newest.alias("_e"))
             .select("_e.*"))
    return keyed.unionByName(read.where("event_id IS NULL").select(*SCHEMA.names))


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): broken, truncated or mistyped lines of the log, and lines that name no configuration."""
    return _lines(spark, path).where(F.col(CORRUPT).isNotNull() | F.col("config_hash").isNull()).select("file", "line")


def count_runs(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("config_hash").alias("n_trials"))


def latest_runs(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` runs first."""
    return (log.select("timestamp", "name", "config_hash", "source", "cagr_net", "excess_vs_universe_ew", "sharpe",
                       "null_percentile").orderBy(F.desc("timestamp"), F.desc("config_hash")).limit(n))
