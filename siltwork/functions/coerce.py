"""Coercions of untyped values, in Python for records and as columns for DataFrames.

Zero values are absent: an empty text or list and the number 0 never overwrite anything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.functions.jsonpatch import to_json
from siltwork.schema import Field

INT64 = (-(2**63), 2**63 - 1)
_INT = re.compile(r"[+-]?[0-9]+")


def to_str(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def to_int64(value) -> int:
    """Integers as they are, floats cut towards 0, texts in base 10 (out of range: the nearest end), all else 0."""
    if isinstance(value, bool) or value is None:
        return 0
    if isinstance(value, int):
        number = value
    elif isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return 0
        number = int(value)
    elif isinstance(value, str) and _INT.fullmatch(value):
        number = int(value)
    else:
        return 0
    return min(max(number, INT64[0]), INT64[1])


def to_str_list(value) -> list[str]:
    """Texts become lists of one; null items are dropped; scalars that aren't texts are absent."""
    if isinstance(value, str):
        return [value] if value else []
    if isinstance(value, (list, tuple)):
        return [to_str(v) for v in value if v is not None]
    return []


def typed(field: Field, value):
    """The value of a record's field in its column's type; None if absent."""
    if value is None:
        return None
    if field.strategy == "json_merge":
        return to_json(value) or None
    if field.type == "string":
        return to_str(value) or None
    if field.type == "int64":
        return to_int64(value) or None
    if field.type == "list":
        return to_str_list(value) or None
    return value


def int64_column(c: Column) -> Column:
    """to_int64 of a text column."""
    exact = F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c)
    low, high = F.lit(INT64[0]), F.lit(INT64[1])
    ends = F.when(exact.startswith("-"), low).otherwise(high)
    return F.coalesce(exact.try_cast("bigint"), F.when(exact.isNotNull(), ends), F.lit(0))


def absent_as_null(c: Column, dtype: T.DataType) -> Column:
    """Null for the type's zero value. Null items of lists are dropped first."""
    if isinstance(dtype, T.ArrayType):
        kept = F.array_compact(c)
        return F.when(F.size(kept) > 0, kept)
    if isinstance(dtype, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(dtype, (T.LongType, T.DoubleType)):
        return F.nullif(c, F.lit(0).cast(dtype))
    return c


def column_as(c: Column, source: T.DataType, field: Field) -> Column:
    """A DataFrame's column in a field's type, by the rules for records."""
    to = field.spark_type
    if field.strategy == "json_merge" and isinstance(source, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(c)
    if isinstance(to, T.LongType):
        if isinstance(source, T.StringType):
            return int64_column(c)
        if isinstance(source, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return c.cast("bigint")
        if isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType)):
            return c.try_cast("bigint")
        return F.lit(None).cast("bigint")
    if isinstance(to, T.ArrayType):
        if isinstance(source, T.ArrayType):
            return c.cast("array<string>")
        return F.when(c != "", F.array(c)) if isinstance(source, T.StringType) else F.lit(None).cast("array<string>")
    if isinstance(to, T.StringType) and isinstance(source, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast(to)
