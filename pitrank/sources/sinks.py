"""Writers for results and canonical tables. Every writer replaces what the same run or job wrote before."""
from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..plans.backtest import BacktestResult
from ..plans.spec import spec_key
from .canonical import YEAR, Panel

TABLES = ("monthly", "holdings", "rankings", "universe_stats")
RUN = "run_id"
DATES = {"returns": "date", "fundamentals": "available_date", "benchmarks": "date"}


def write_table(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """A table of many runs, partitioned by run. Only the partition of ``run_id`` is replaced.

    The new rows are staged and take the old ones' place when the job commits, so a rerun or a retried job leaves one
    copy and a failed one leaves the old. A run without rows removes what an earlier one of that name left.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run_id {run_id!r} can't name a folder")
    seen = Observation()
    rows = df.withColumn(RUN, F.lit(run_id)).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
    if not seen.get["n"]:
        _remove(df.sparkSession, f"{path}/{RUN}={run_id}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A table of many runs, or one run of it (only its partition is opened). Run ids are text, also if all digits."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(RUN, T.StringType()) if f.name == RUN else f for f in found.fields]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    return rows if run_id is None else rows.where(F.col(RUN) == run_id)


def write_result(result: BacktestResult, path: str, run_id: str | None = None, fmt: str = "parquet",
                 reports: Mapping[str, DataFrame] | None = None) -> dict[str, str]:
    """One table per result, partitioned by run, so runs share a table and a reader prunes to one of them.

    ``reports``: further tables of the run by name, such as calendar years and deciles.
    """
    run = run_id or result.spec.key()
    out = {}
    for name, df in {**{t: getattr(result, t) for t in TABLES}, **(reports or {})}.items():
        out[name] = f"{path}/{name}"
        write_table(df, out[name], run, fmt)
    return out


def write_canonical(df: DataFrame, path: str, name: str, spec: Mapping[str, Any], date_column: str | None = None) -> str:
    """A canonical table under the hash of the job values it was built from, by year where it has a date."""
    target = f"{path}/{spec_key(spec)}/{name}"
    if date_column:
        df.withColumn(YEAR, F.year(date_column)).write.mode("overwrite").partitionBy(YEAR).parquet(target)
    else:
        df.write.mode("overwrite").parquet(target)
    return target


def write_panel(panel: Panel, path: str) -> str:
    """The three canonical tables by year, dealt by year first so that a year is few files; ``read_panel(by_year=True)``.

    Rows of one year go to as many tasks as they fill (rebalancing splits large ones).
    """
    for name, column in DATES.items():
        (getattr(panel, name).withColumn(YEAR, F.year(column)).hint("rebalance", YEAR)
         .write.mode("overwrite").partitionBy(YEAR).parquet(f"{path}/{name}"))
    return path


def write_null_runs(runs: DataFrame, path: str, batch: str) -> None:
    """Figures of luck runs, one partition per batch; the same batch written again replaces itself."""
    write_table(runs, path, batch)


def read_null_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches, with ``run_id`` naming the batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])).parquet(path)
