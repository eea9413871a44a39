"""Vectors of securities: which of them can be used, and factor columns packed into one vector.

Records: securities (``security_id``) with their factor ``exposures``, an array of numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import materialize


def packed(snapshots: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Adds ``exposures``: the factor columns of a snapshot or ranking in the given order."""
    return snapshots.withColumn("exposures", F.array(*[F.col(f).cast("double") for f in factors]))


def all_present(vector: Column | str) -> Column:
    """A vector with at least one component and none NULL."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def finite(vector: Column | str) -> Column:
    """The vector in double precision; NaN and infinite components become NULL."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector,
                       lambda x: F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double")))


def common_width(lengths: DataFrame, vector: str) -> int:
    """The number of components that most vectors have; the smaller where two are equally frequent, 0 without vectors.

    Vectors of other lengths can't be compared with these and take no part.
    """
    sizes = lengths.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), "width").first()
    return first["width"] if first else 0


def usable(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector is whole and of the common width, written once, and that width."""
    whole = materialize(vectors.where(all_present(vector)))
    width = common_width(whole, vector)
    return whole.where(F.size(vector) == width), width
