"""Merge strategies as Column expressions.

Two layers. ``aggregate`` brings the incoming rows of a key to one; ``combine`` joins that
row (alias s) with the existing one (alias t).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.jsonpatch import apply_column, reduce_column
from siltwork.schema import Field


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _filled(sql: str, column: str) -> str:
    return sql.replace("{}", quoted(column))


def union_lists(lists: Column) -> Column:
    """The distinct non-null items of lists, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(lists))))


def aggregate(field: Field) -> Column:
    """The incoming aggregate. JSON patches stay an array, sorted as text, until after the join."""
    c = F.col(quoted(field.column))
    if field.agg_expr:
        return F.expr(_filled(field.agg_expr, field.column))
    match field.strategy:
        case "list_union":
            return union_lists(F.collect_list(c))
        case "json_merge":
            patches = F.array_sort(F.collect_list(c))
            return F.when(F.size(patches) > 0, patches)
        case "sum":
            return F.sum(c)
        case "min":
            return F.min(c)
        case _:  # coalesce, overwrite and max: the largest value of a batch
            return F.max(c)


def holds_patches(field: Field) -> bool:
    """Whether the field's aggregate is an array of patches."""
    return field.strategy == "json_merge" and not field.agg_expr


def only_incoming(field: Field, s: Column) -> Column:
    """The output where there are no existing rows: the aggregate as it stands."""
    return reduce_column(s) if holds_patches(field) else s


def combine(field: Field, s: Column, t: Column) -> Column:
    """The output of a join, from the incoming and the existing value."""
    if field.merge_expr:
        return F.expr(_filled(field.merge_expr, field.column))
    if holds_patches(field):
        return apply_column(t, s)
    match field.strategy:
        case "list_union":
            none = F.array().cast("array<string>")
            return union_lists(F.array(F.coalesce(t, none), F.coalesce(s, none)))
        case "json_merge":
            return apply_column(t, F.when(s.isNotNull(), F.array(s)))
        case "max":
            return F.greatest(s, t)
        case "min":
            return F.least(s, t)
        case "sum":
            zero = F.lit(0).cast(field.spark_type)
            return F.coalesce(s, zero) + F.coalesce(t, zero)
        case _:  # pk, coalesce and overwrite: incoming unless absent
            return F.coalesce(s, t)
