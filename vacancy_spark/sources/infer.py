"""Column types of text, found in one aggregate.

Each column takes the first type of the lattice that all its values have: boolean, whole number
(32, then 64 bits), double, date, timestamp, else text. Numbers with leading zeros are identifiers and
stay text, as do whole numbers beyond 64 bits; a column without values is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = r"^[+-]?(0|[1-9][0-9]{0,18})$"
_DECIMAL = r"^[+-]?(((0|[1-9][0-9]*)(\.[0-9]*)?)|(\.[0-9]+))([eE][+-]?[0-9]{1,3})?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _fits(c: Column) -> dict[T.DataType, Column]:
    """For each type, whether a text value has it."""
    long = F.when(c.rlike(_WHOLE), c.try_cast("bigint"))
    return {
        T.BooleanType(): F.lower(c).isin("true", "false"),
        T.IntegerType(): long.between(-(1 << 31), (1 << 31) - 1),
        T.LongType(): long.isNotNull(),
        T.DoubleType(): c.rlike(_DECIMAL) & (long.isNotNull() | ~c.rlike(r"^[+-]?[0-9]+$")),
        T.DateType(): c.rlike(_DATE) & c.try_cast("date").isNotNull(),
        T.TimestampType(): (c.rlike(_TIME) | c.rlike(_DATE)) & c.try_cast("timestamp").isNotNull(),
    }


def infer_schema(df: DataFrame) -> T.StructType:
    """Types of the text columns of ``df``: one pass, one row to the driver."""
    checks, counts = [], []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        counts.append(F.count(c).alias(f"n{i}"))
        for j, (kind, fits) in enumerate(_fits(c).items()):
            checks.append((i, j, kind))
            counts.append(F.count_if(fits).alias(f"c{i}_{j}"))
    seen = df.agg(*counts).first() if counts else {}
    types: dict[int, T.DataType] = {}
    for i, j, kind in checks:
        if i not in types and seen[f"n{i}"] and seen[f"c{i}_{j}"] == seen[f"n{i}"]:
            types[i] = kind
    return T.StructType([T.StructField(n, types.get(i, T.StringType())) for i, n in enumerate(df.columns)])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, by name, cast from text; a value that does not fit fails the job."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
