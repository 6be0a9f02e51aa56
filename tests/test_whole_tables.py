"""Operators over whole tables against SQL, beside the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siltwork.functions import partition
from siltwork.plans import compact
from siltwork.queries import merging as M
from siltwork.schema import table_schema

SF = "/root/testdata/sf0.01"


def expected(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_part_direct_with_regions_to_encode(spark):
    schema = table_schema("t", {"id": (str, "pk"), "region": (str, "partition:area")})
    rows = spark.read.parquet(f"{SF}/partitioned_row.parquet").select(F.coalesce("region", F.lit("")).alias("r"), partition.part_dir(schema).alias("dir"))
    got = sorted((tuple(r) for r in rows.groupBy("r", "dir").count().collect()), key=repr)
    want = expected("""SELECT r, 'area=' || replace(replace(replace(replace(r, '%', '%25'), '/', '%2F'), chr(92), '%5C'), chr(10), '%0A') AS dir, count(*)
        FROM (SELECT coalesce(region, '') AS r FROM partitioned_row) GROUP BY 1, 2""", "partitioned_row")  # fmt: skip
    assert got == want and {"area=coast%2520", "area=hua%2Fdong"} <= {d for _, d, _ in got}


PAID = "CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END"
IF_F = "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END"
AT = "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"
MERGES = [
    ("coalesce", str, IF_F, IF_F, "max(v)", "coalesce(s.v, t.v)"),
    ("overwrite", str, "o_orderpriority", "o_orderpriority", "max(v)", "coalesce(s.v, t.v)"),
    ("max", int, AT, M._AT, "max(v)", "greatest(s.v, t.v)"),
    ("min", int, AT, M._AT, "min(v)", "least(s.v, t.v)"),
    ("sum", int, PAID, PAID, "sum(v)::BIGINT", "coalesce(s.v, 0) + coalesce(t.v, 0)"),
    ("list_union", list[str], "array(o_orderstatus)", "o_orderstatus", "list(DISTINCT v)", "list_sort(list_distinct(list_concat(coalesce(t.v, []), coalesce(s.v, []))))"),
]


@pytest.mark.parametrize("strategy, kind, v, v_sql, agg, combined", MERGES, ids=[m[0] for m in MERGES])
def test_merges_of_all_orders(spark, strategy, kind, v, v_sql, agg, combined):
    """Whole customers are dealt to incoming, existing or both, so that both sides have unmatched keys and no row stays out."""
    dealt = "(o_custkey % 3 = 0 OR o_custkey % 3 = 2 AND o_orderkey % 2 = 1)"
    orders, schema = spark.read.parquet(f"{SF}/orders.parquet"), M._one(strategy, kind)
    incoming, existing = [orders.where(w).select(F.col("o_custkey").alias("k"), F.expr(v).alias("v")) for w in (dealt, f"NOT {dealt}")]
    assert incoming.count() + existing.count() == orders.count()
    got = sorted((tuple(r) for r in compact.plan(schema, incoming, M._existing(schema, existing)).collect()), key=repr)
    side = f"SELECT o_custkey AS k, {agg} AS v FROM (SELECT *, {v_sql} AS v FROM orders)"
    want = expected(f"""WITH s AS ({side} WHERE {dealt} GROUP BY 1), t AS ({side} WHERE NOT {dealt} GROUP BY 1)
        SELECT coalesce(s.k, t.k), {combined} FROM s FULL OUTER JOIN t ON s.k = t.k""", "orders")  # fmt: skip
    assert got == want


def test_coalesce_keeps_key_zero(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"))
    got = sorted((tuple(r) for r in compact.plan(M._one("coalesce"), rows).collect()), key=repr)
    assert got == expected("SELECT user_id AS k, max(event_type) AS v FROM events GROUP BY 1", "events") and 0 in {k for k, _ in got}
