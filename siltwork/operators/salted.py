"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

1. Heavy keys are those with at least ``share`` of all rows. A sketch of bounded size finds
   their hashes in one pass over the key, without a shuffle of keys: none is missed, a few
   lighter ones may be among them, and at most ``1 / share`` numbers come to the driver.
   They decide which rows are salted, and nothing else: results are exact in any case.
2. Rows of heavy keys get a salt; rows of all other keys get salt 0. Partial results are
   computed by (key, salt), and then merged by the key.

The salt is a hash of the row, with the rank of a repeated row left to the map-side
combine, and not rand(): a task that is run again after a lost executor must send each
row where its first run sent it.

Null keys form one group, as in GROUP BY. An empty table gives an empty result. Input
columns may have any names: those used inside give way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import by_merge

SALT = "__silt_salt"
HEAVY_SHARE = 0.005
TRACKED = 8  # keys the sketch follows for each heavy one there can be
SALTS = 64


@dataclass(frozen=True)
class Partial:
    """One result column: partials by (key, salt), then merged by the key.

    partial: expression over input rows. merge: from the partial column to the result.
    """

    name: str
    partial: Column
    merge: Callable[[str], Column]


def count_rows(name: str) -> Partial:
    return Partial(name, F.count(F.lit(1)), lambda c: F.sum(c))


def count_if(name: str, cond: Column) -> Partial:
    return Partial(name, F.count(F.when(cond, 1)), lambda c: F.sum(c))


def total(name: str, value: Column) -> Partial:
    return Partial(name, F.sum(value), lambda c: F.sum(c))


def largest(name: str, value: Column) -> Partial:
    return Partial(name, F.max(value), lambda c: F.max(c))


def smallest(name: str, value: Column) -> Partial:
    return Partial(name, F.min(value), lambda c: F.min(c))


def latest(name: str, value: Column, order: Column) -> Partial:
    """The value with the largest order; ties go to the larger value, null orders lose."""
    return Partial(
        name,
        F.max(F.when(order.isNotNull(), F.struct(order.alias("o"), value.alias("v")))),
        lambda c: F.max(c)["v"],
    )


def mean(name: str, value: Column) -> Partial:
    part = F.struct(F.sum(value).alias("s"), F.count(value).alias("n"))
    return Partial(name, part, lambda c: F.try_divide(F.sum(F.col(c)["s"]), F.sum(F.col(c)["n"])))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df doesn't have, one for each base."""
    taken = {c.lower() for c in df.columns}
    out = []
    for b in bases:
        name = f"__silt_{b}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def heavy_hashes(df: DataFrame, keys: list[Column], share: float = HEAVY_SHARE) -> list[int]:
    """xxhash64 of the keys that hold at least ``share`` of all rows, and of some that nearly do; at most 1 / share + 1."""
    most = math.ceil(1 / share) + 1
    sketch = F.expr(f"approx_top_k(__silt_h, {most}, {TRACKED * most})")
    top, rows = df.select(F.xxhash64(*keys).alias("__silt_h")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t[0] for t in top or [] if t[1] >= share * rows]


def with_salt(df: DataFrame, key: str, salts: int = SALTS, share: float = HEAVY_SHARE, name: str = SALT) -> DataFrame:
    """df with a salt column: 0 for light keys, 0 <= salt < salts for heavy ones."""
    heavy = heavy_hashes(df, [F.col(f"`{key}`")], share)
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])
    salt = F.when(F.xxhash64(F.col(f"`{key}`")).isin(heavy), F.pmod(row, F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn(name, salt)


def salted_aggregate(
    df: DataFrame, key: str, partials: list[Partial], salts: int = SALTS, share: float = HEAVY_SHARE
) -> DataFrame:
    """(key, one column for each partial), equal to a plain GROUP BY over the key."""
    (salt,) = fresh(df, "salt")
    staged = (
        with_salt(df, key, salts, share, salt)
        .groupBy(F.col(f"`{key}`").alias("__silt_key"), F.col(salt))
        .agg(*[p.partial.alias(f"__silt_p{i}") for i, p in enumerate(partials)])
    )
    merged = staged.groupBy("__silt_key").agg(*[p.merge(f"__silt_p{i}").alias(f"__silt_r{i}") for i, p in enumerate(partials)])
    return merged.select(F.col("__silt_key").alias(key), *[F.col(f"__silt_r{i}").alias(p.name) for i, p in enumerate(partials)])


def salted_count_distinct(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): distinct non-null values of each key.

    Here the value itself is the salt: rows are made distinct by (key, value), so the
    rows of a hot key spread over its values, and then counted by the key.
    """
    pairs = df.select(F.col(f"`{key}`").alias("__silt_key"), F.col(f"`{value}`").alias("__silt_value")).distinct()
    out = pairs.groupBy("__silt_key").agg(F.count("__silt_value").alias("__silt_n"))
    return out.select(F.col("__silt_key").alias(key), F.col("__silt_n").alias(name))


def salted_join(left: DataFrame, right: DataFrame, key: str, by: Column, heavy: list[int], salts: int = SALTS) -> DataFrame:
    """left joined with right on ``key``, the rows of keys whose xxhash64 is heavy dealt to several tasks.

    by: what a heavy key's left rows are dealt by; its right rows are repeated, once for each
    salt. Equal to a plain inner join; null keys meet nothing. Neither side is broadcast.
    """
    if not heavy:
        return left.join(by_merge(right), key)
    is_heavy = F.xxhash64(F.col(f"`{key}`")).isin(heavy)
    dealt = left.withColumn(SALT, F.when(is_heavy, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    repeated = right.withColumn(SALT, F.explode(F.when(is_heavy, every).otherwise(F.array(F.lit(0).cast("bigint")))))
    return dealt.join(by_merge(repeated), [key, SALT]).drop(SALT)
