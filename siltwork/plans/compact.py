"""The merge as one plan: incoming rows, grouped by key, full outer join with existing rows.

Pure DataFrame to DataFrame. Keys are the primary key and, if given, ``scope`` columns such
as the partition directory, so that one plan merges all partitions, and equal keys in two
partitions never meet. The grouping keys are the join keys: the aggregate's partitioning
serves the join, with one exchange on each side. JSON patches pass the join as arrays, and
one Arrow function applies them after it.

Rows without a full primary key: incoming ones are dropped, existing ones kept as they
are. Columns that neither side has come out null. An empty side is no error.

Where a few keys hold most incoming rows, ``skew`` keeps lists and patches from gathering
in one task: max, min, sum and lists are aggregated in two stages with a salt, and patches
in the order of their text by range, see ``reduce_ranges``. Aggregates given as SQL can't be
split and stay in one stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import jsonpatch
from siltwork.operators.salted import fresh, heavy_hashes
from siltwork.operators.strategies import aggregate, combine, holds_patches, only_incoming, quoted, union_lists
from siltwork.schema import TableSchema

SALTS = 32
HEAVY_SHARE = 0.02


def _keys(schema: TableSchema, scope: Sequence[str]) -> list[str]:
    return [*scope, *schema.pk]


def has_key(schema: TableSchema) -> Column:
    out = F.lit(True)
    for c in schema.pk:
        out = out & F.col(quoted(c)).isNotNull()
    return out


def preaggregate(schema: TableSchema, incoming: DataFrame, scope: Sequence[str] = (), skew: bool | str = "auto") -> DataFrame:
    """One row for each key; only the columns that incoming has. skew: True, False or 'auto' (looked up first)."""
    present = set(incoming.columns)
    fields = [f for f in schema.fields if f.column in present and f.column not in schema.pk]
    rows = incoming.where(has_key(schema))
    if not any(f.agg_expr for f in fields):  # SQL may look at any column
        rows = rows.select(*[F.col(quoted(k)) for k in _keys(schema, scope)], *[F.col(quoted(f.column)) for f in fields])
    keys = [F.col(quoted(k)) for k in _keys(schema, scope)]
    gathers = any(f.type == "list" or holds_patches(f) for f in fields)
    heavy = heavy_hashes(rows, keys, HEAVY_SHARE) if skew is True or (skew == "auto" and gathers) else []
    if not (heavy or skew is True):
        return rows.groupBy(*keys).agg(*[aggregate(f).alias(f.column) for f in fields]) if fields else rows.select(*keys).distinct()
    return _in_two_stages(schema, rows, scope, fields, heavy)


def _in_two_stages(schema: TableSchema, rows: DataFrame, scope: Sequence[str], fields: list, heavy: list[int]) -> DataFrame:
    names = _keys(schema, scope)
    keys = [F.col(quoted(k)) for k in names]
    (salt,) = fresh(rows, "salt")
    row = F.xxhash64(*[F.col(quoted(c)) for c in rows.columns])
    salted = rows.withColumn(salt, F.when(F.xxhash64(*keys).isin(heavy), F.pmod(row, F.lit(SALTS))).otherwise(0))
    split = [f for f in fields if not f.agg_expr and not holds_patches(f)]
    staged = salted.groupBy(*keys, salt).agg(F.lit(0).alias("__silt_any"), *[aggregate(f).alias(f.column) for f in split])
    again = [(union_lists(F.collect_list(quoted(f.column))) if f.strategy == "list_union" else aggregate(f)).alias(f.column) for f in split]
    out = staged.groupBy(*keys).agg(F.lit(0).alias("__silt_any"), *again)
    for f in fields:
        if f.agg_expr:
            part = rows.groupBy(*keys).agg(aggregate(f).alias(f.column))
        elif holds_patches(f):
            part = reduce_ranges(rows, names, f.column)
        else:
            continue
        out = out.join(part, names, "left")
    return out.select(*keys, *[F.col(quoted(f.column)) for f in fields])


def reduce_ranges(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column: array of one patch), all patches of a key in the order of their text.

    Patches are sorted over the cluster by key and text. Each partition brings a key's
    stretch to one change as it streams by, so a key has at most one line a partition in
    the end. The first stretch is applied, the others composed: what they delete, they
    delete from what came before.
    """
    c = quoted(column)
    names = [f"__silt_{i}" for i in range(len(keys))]
    plain = rows.where(F.col(c).isNotNull()).select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(c).alias("__silt_p")).distinct()
    ranged = plain.repartitionByRange(*names, "__silt_p").sortWithinPartitions(*names, "__silt_p")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "__silt_first string", "__silt_applied string", "__silt_composed string"])

    def shrink(batches):
        now = first = applied = composed = None
        n = 0

        def line():
            text = first if n == 1 else None
            return (*now, first, text or jsonpatch.dumps(applied), jsonpatch.dump_composed(composed))

        for pdf in batches:
            out = []
            for *key, text in pdf.itertuples(index=False, name=None):
                value = jsonpatch.loads(text)
                if key == now:
                    applied, composed, n = jsonpatch.patch(applied, value), jsonpatch.compose(composed, value), n + 1
                    continue
                if now is not None:
                    out.append(line())
                now, first, applied, composed, n = key, text, value, value, 1
            yield pd.DataFrame(out, columns=[s.split()[0] for s in schema.split(", ")])
        if now is not None:
            yield pd.DataFrame([line()], columns=[s.split()[0] for s in schema.split(", ")])

    parts = ranged.mapInPandas(shrink, schema).groupBy(*names).agg(
        F.array_sort(F.collect_list(F.struct("__silt_first", "__silt_applied", "__silt_composed"))).alias("s")
    )

    @F.pandas_udf("string")
    def join(applied: pd.Series, composed: pd.Series) -> pd.Series:
        return pd.Series([jsonpatch.reduce_stretches(list(zip(a, c))) for a, c in zip(applied, composed)], dtype=object)

    one = F.array(join(F.col("s.__silt_applied"), F.col("s.__silt_composed")))
    return parts.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], one.alias(column))


def plan(
    schema: TableSchema,
    incoming: DataFrame,
    existing: DataFrame | None = None,
    scope: Sequence[str] = (),
    skew: bool | str = "auto",
) -> DataFrame:
    """The merged rows: scope columns, then the schema's columns in declared order.

    existing None: there are no existing rows, and the aggregate is the result as it
    stands, so the sum of nothing but nulls is null; joined, it is 0.
    """
    s_cols = set(incoming.columns)
    grouped = preaggregate(schema, incoming, scope, skew)
    keys = _keys(schema, scope)
    if existing is None:
        out = [
            (F.col(quoted(f.column)) if f.column in schema.pk else only_incoming(f, F.col(quoted(f.column))))
            if f.column in s_cols
            else F.lit(None)
            for f in schema.fields
        ]
        return grouped.select(*[F.col(quoted(k)) for k in scope], *[c.cast(f.spark_type).alias(f.column) for c, f in zip(out, schema.fields)])
    t_cols = set(existing.columns)
    s, t = grouped.alias("s"), existing.alias("t")
    on = None
    for k in keys:
        same = F.col(f"s.{quoted(k)}") == F.col(f"t.{quoted(k)}")
        on = same if on is None else on & same
    joined = s.join(t, on, "full_outer")
    out = [F.coalesce(F.col(f"s.{quoted(k)}"), F.col(f"t.{quoted(k)}")).alias(k) for k in scope]
    for f in schema.fields:
        sc, tc = F.col(f"s.{quoted(f.column)}"), F.col(f"t.{quoted(f.column)}")
        if f.column in s_cols and f.column in t_cols:
            c = F.coalesce(sc, tc) if f.column in schema.pk and not f.merge_expr else combine(f, sc, tc)
        elif f.column in s_cols:
            c = sc if f.column in schema.pk else only_incoming(f, sc)
        elif f.column in t_cols:
            c = tc
        else:
            c = F.lit(None)
        out.append(c.cast(f.spark_type).alias(f.column))
    return joined.select(*out)
