"""Result types of the Arrow functions, as Spark and as Arrow types. Built without a running session."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LONG, DOUBLE, STRING, BOOLEAN, INT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def arrays(kind: T.StructType, columns) -> pa.StructArray:
    """A struct array from one sequence per field."""
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=to_arrow_type(f.dataType))
                                       for f, c in zip(kind, columns)], names=kind.names)


def rows(kind: T.StructType, values: list[tuple]) -> pa.StructArray:
    """A struct array from one tuple per row."""
    return arrays(kind, zip(*values) if values else [[] for _ in kind])
