"""Cutting long lineages with tables written to the cluster's shared folder."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; without one nothing can be shared, so that is an error.

    A folder of one machine would be wrong on a cluster: each executor would write its part to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, inside the folder of the run it belongs to."""
    run = _run.get()
    return f"{shared_folder(spark)}/{f'pitrank-run-{run}/' if run else ''}pitrank-{kind}-{uuid.uuid4().hex}"


@contextmanager
def tables_of_a_run(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, every table that was written in between. Results must have been used up by then.

    A run's tables stand in a folder named by the run, so runs that overlap do not touch each other's.
    """
    run = uuid.uuid4().hex
    before = _run.set(run)
    try:
        yield
    finally:
        _run.reset(before)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pitrank-run-{run}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table that several branches of a plan read, once, and reads it back.

    Unlike a cached table it survives lost executors, and unlike a checkpointed one it keeps column pruning, filter
    pushdown and size statistics. The schema is passed on, so nothing is inferred.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    """Several independent tables at the same time, so that one job's last tasks do not leave the cluster idle."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(lambda context, df: context.run(materialize, df), [copy_context() for _ in dfs], dfs))
