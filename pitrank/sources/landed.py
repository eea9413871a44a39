"""Canonical tables stored so that readers move or open as little as possible: by year, or bucketed by security."""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T

from .canonical import Panel, clean_nan

BUCKETS = 64
ORDER = {"returns": "date", "fundamentals": "available_date"}


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int = BUCKETS, order: str = "date",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Stores a canonical table under ``path``, bucketed by security (and the market ``keys``), and names it.

    Rows are dealt by the bucket function before they are written, so every bucket is one file. Windows, lookups and
    joins by security then start from the files without a shuffle. A table of that name or place is replaced.
    """
    owner = [*keys, "security_id"]
    (df.repartition(buckets, *owner).write.mode("overwrite").bucketBy(buckets, *owner).sortBy(*owner, order)
     .option("path", path).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int = BUCKETS,
                    order: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Names a stored bucketed table in a session whose catalog does not know it. Values must be those of the write."""
    owner = ", ".join(f"`{k}`" for k in [*keys, "security_id"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({owner}) "
              f"SORTED BY ({owner}, `{order}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_panel_bucketed(panel: Panel, path: str, prefix: str, buckets: int = BUCKETS, keys: Sequence[str] = ()) -> Panel:
    """Returns and fundamentals bucketed alike; benchmarks have a row per month and stay as they are."""
    stored = {name: clean_nan(write_bucketed(getattr(panel, name), f"{prefix}_{name}", f"{path}/{name}", buckets, order, keys))
              for name, order in ORDER.items()}
    return Panel(benchmarks=panel.benchmarks, **stored)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the jobs started inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def on_buckets(spark: SparkSession):
    """Jobs started inside join on a security's buckets even where a join has more keys than the buckets do.

    Spark would shuffle both sides by all keys; a security's rows are bounded by the panel's months, so its bucket is
    as good. Plans are made when a job starts: write or collect results inside.
    """
    return settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
