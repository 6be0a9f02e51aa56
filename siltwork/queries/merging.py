"""Queries for the engine's own operators, each with the SQL that gives the same rows.

Conventions: of a table's rows, those with an even key are the existing side and those
with an odd key the incoming one. Lists are sorted, money is whole cents, times are
seconds, and JSON comes out as single values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.engine import Engine
from siltwork.functions import coerce, jsonpatch, partition
from siltwork.ingest import normalise
from siltwork.operators.strategies import aggregate
from siltwork.plans import compact
from siltwork.queries.registry import Registry
from siltwork.schema import PartitionRule, TableSchema, table_schema
from siltwork.session import cut, remove, shared_dir, table
from siltwork.sources import records
from siltwork.sources.jsonl import jsonl_records

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


# --- the flagship: customers' orders merged into one record each -------------------------

MASTER = table_schema(
    "customer_master",
    {
        "cust": (int, "pk"),
        "priority": (str, "overwrite"),
        "status": (list[str], "list_union"),
        "first_order": (int, "min"),
        "last_order": (int, "max"),
        "cents": (int, "sum"),
        "orders": (int, "sum"),
    },
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("priority"),
        F.array("o_orderstatus").alias("status"),
        _seconds("o_orderdate").alias("first_order"),
        _seconds("o_orderdate").alias("last_order"),
        _cents("o_totalprice").alias("cents"),
        F.lit(1).cast("bigint").alias("orders"),
    )


def _split(df: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(incoming, existing)."""
    return df.where(f"{key} % 2 = 1"), df.where(f"{key} % 2 = 0")


def _existing(schema: TableSchema, df: DataFrame) -> DataFrame:
    """Rows brought to one a key, as a first publish leaves them."""
    return compact.plan(schema, df)


_ORDERS_SQL = """o AS (SELECT o_orderkey AS key, o_custkey AS cust, o_orderpriority AS priority, o_orderstatus AS status,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""

_MASTER_SQL = f"""WITH {_ORDERS_SQL},
    s AS (SELECT cust, max(priority) AS priority, list(DISTINCT status) AS status, min(ts) AS lo, max(ts) AS hi, sum(cents) AS cents, count(*) AS n
      FROM o WHERE key % 2 = 1 AND cust % 3 <> 0 GROUP BY cust),
    t AS (SELECT cust, max(priority) AS priority, list(DISTINCT status) AS status, min(ts) AS lo, max(ts) AS hi, sum(cents) AS cents, count(*) AS n
      FROM o WHERE key % 2 = 0 GROUP BY cust)
    SELECT coalesce(s.cust, t.cust) AS cust, coalesce(s.priority, t.priority) AS priority,
      list_sort(list_distinct(list_concat(coalesce(t.status, []), coalesce(s.status, [])))) AS status,
      least(s.lo, t.lo) AS first_order, greatest(s.hi, t.hi) AS last_order,
      CAST(coalesce(s.cents, 0) + coalesce(t.cents, 0) AS BIGINT) AS cents,
      CAST(coalesce(s.n, 0) + coalesce(t.n, 0) AS BIGINT) AS orders
    FROM s FULL OUTER JOIN t ON s.cust = t.cust"""


@query(_MASTER_SQL)
def customer_master_merge(spark: SparkSession, d: str) -> DataFrame:
    incoming, existing = _split(_orders(spark, d))
    return compact.plan(MASTER, incoming.where("cust % 3 <> 0"), _existing(MASTER, existing))


# --- aggregates of a batch, one strategy each --------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _one(strategy: str, kind: object = str, extra: str = "") -> TableSchema:
    return table_schema("t", {"k": (int, "pk"), "v": (kind, f"{strategy}{extra}")})


@query("SELECT user_id AS k, max(event_type) AS v FROM events GROUP BY 1")
def agg_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("coalesce"), _events(spark, d).select(F.col("user_id").alias("k"), F.col("event_type").alias("v")))


@query("SELECT user_id AS k, max(props) AS v FROM events GROUP BY 1")
def agg_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("overwrite"), _events(spark, d).select(F.col("user_id").alias("k"), F.col("props").alias("v")))


_LINES = "SELECT l_partkey AS k, CAST({} AS BIGINT) AS v FROM lineitem GROUP BY 1"


def _lines(spark: SparkSession, d: str, v: Column) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), v.alias("v"))


@query(_LINES.format("max(round(l_extendedprice * 100))"))
def agg_max(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("max", int), _lines(spark, d, _cents("l_extendedprice")))


@query(_LINES.format("min(floor(epoch(l_shipdate)))"))
def agg_min(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("min", int), _lines(spark, d, _seconds("l_shipdate")))


@query(_LINES.format("sum(CAST(round(l_quantity * 100) AS BIGINT))"))
def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("sum", int), _lines(spark, d, _cents("l_quantity")))


@query("SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS v FROM orders GROUP BY 1")
def agg_list_union(spark: SparkSession, d: str) -> DataFrame:
    return compact.plan(_one("list_union", list[str]), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.array("o_orderstatus").alias("v")))


@query("""SELECT id AS k, list_sort(list(DISTINCT p)) AS v FROM (SELECT id, unnest(phones) AS p FROM company WHERE id IS NOT NULL)
    WHERE p IS NOT NULL GROUP BY 1""")
def agg_list_union_skewed(spark: SparkSession, d: str) -> DataFrame:
    """In two stages with salted heavy ids, whether or not there are heavy ones; ids without a phone are left out to match."""
    schema = table_schema("t", {"k": (str, "pk"), "v": list[str]})
    rows = table(spark, d, "company").select(F.col("id").alias("k"), F.col("phones").alias("v"))
    return compact.preaggregate(schema, rows, skew=True).where(F.size("v") > 0)


_EVENT_PATCH = "to_json(map([event_type], [CAST(user_id % 7 + event_id % 5 AS VARCHAR)]))"


def _patches(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("user_id") % 7 + F.col("event_id") % 5).cast("string")
    return _events(spark, d).select("event_id", F.col("user_id").alias("k"), F.to_json(F.create_map("event_type", value)).alias("v"))


def _members(df: DataFrame) -> DataFrame:
    """The members of the JSON objects in v, one a row."""
    return df.select("k", F.explode(F.from_json("v", "map<string,string>")).alias("name", "value"))


_FOLDED = """SELECT user_id AS k, event_type AS name, max(CAST(user_id % 7 + event_id % 5 AS VARCHAR)) AS value FROM events GROUP BY 1, 2"""


@query(_FOLDED)
def agg_json_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches sorted as text: of those for one member the largest text wins, which is the largest value."""
    return _members(compact.plan(_one("json_merge", dict), _patches(spark, d).drop("event_id"), skew=False))


@query(_FOLDED)
def agg_json_patches_skewed(spark: SparkSession, d: str) -> DataFrame:
    """The same by sorted ranges, for keys too large for one task."""
    rows = compact.preaggregate(_one("json_merge", dict), _patches(spark, d).drop("event_id"), skew=True)
    return _members(rows.select("k", jsonpatch.reduce_column("v").alias("v")))


@query("""SELECT source AS k, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source <> '' GROUP BY 1""")
def agg_custom(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"k": (str, "pk"), "docs": (int, "agg:count(*)"), "chars": (int, "agg:sum({})")})
    rows = table(spark, d, "documents").where("source <> ''").select(F.col("source").alias("k"), F.col("doc_id").alias("docs"), F.col("n_chars").alias("chars"))
    return compact.plan(schema, rows)


@query("SELECT p_brand AS k, arg_max(p_name, p_partkey) AS v FROM part GROUP BY 1")
def agg_custom_latest(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"k": (str, "pk"), "v": (str, "agg:max_by(v, at)")})
    rows = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_name").alias("v"), F.col("p_partkey").alias("at"))
    return rows.groupBy("k").agg(aggregate(schema["v"]).alias("v"))


# --- joins of incoming and existing rows ---------------------------------------------------


@query("""SELECT o_custkey AS k, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END)::BIGINT AS v
    FROM orders GROUP BY 1""")
def merge_first_publish(spark: SparkSession, d: str) -> DataFrame:
    """Without existing rows there is no join, and a sum of nulls stays null."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", _cents("o_totalprice")).alias("v"))
    return compact.plan(_one("sum", int), rows)


# Which orders exist before: all of some customers, none of others, and of the rest those with an even key.
_OLD = "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE key % 2 = 0 END"


def _merged(spark: SparkSession, d: str, strategy: str, v: Column, kind: object = int) -> DataFrame:
    schema = _one(strategy, kind)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("k"), v.alias("v"))
    incoming, existing = rows.where(f"NOT ({_OLD})"), rows.where(_OLD)
    return compact.plan(schema, incoming.drop("key"), _existing(schema, existing.drop("key")))


def _merge_sql(v: str, agg: str, combined: str) -> str:
    side = f"SELECT k, {agg} AS v FROM (SELECT o_orderkey AS key, o_custkey AS k, {v} AS v FROM orders)"
    return f"""WITH s AS ({side} WHERE NOT ({_OLD}) GROUP BY 1), t AS ({side} WHERE {_OLD} GROUP BY 1)
        SELECT coalesce(s.k, t.k) AS k, {combined} AS v FROM s FULL OUTER JOIN t ON s.k = t.k"""


_IF_F = "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END"


@query(_merge_sql(_IF_F, "max(v)", "coalesce(s.v, t.v)"))
def merge_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "coalesce", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), str)


@query(_merge_sql("o_orderpriority", "max(v)", "coalesce(s.v, t.v)"))
def merge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "overwrite", F.col("o_orderpriority"), str)


_AT = "CAST(floor(epoch(o_orderdate)) AS BIGINT)"


@query(_merge_sql(_AT, "max(v)", "greatest(s.v, t.v)"))
def merge_max(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "max", _seconds("o_orderdate"))


@query(_merge_sql(_AT, "min(v)", "least(s.v, t.v)"))
def merge_min(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "min", _seconds("o_orderdate"))


@query(_merge_sql("CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END", "sum(v)::BIGINT", "coalesce(s.v, 0) + coalesce(t.v, 0)"))
def merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "sum", F.when(F.col("o_orderstatus") == "F", _cents("o_totalprice")))


@query(_merge_sql("o_orderstatus", "list(DISTINCT v)", "list_sort(list_distinct(list_concat(coalesce(t.v, []), coalesce(s.v, []))))"))
def merge_list_union(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "list_union", F.array("o_orderstatus"), list[str])


_JSON_SIDE = """SELECT user_id AS k, event_type AS n, max(CAST(user_id % 7 + event_id % 5 AS VARCHAR)) AS v FROM events
    WHERE event_id % 2 = {} GROUP BY 1, 2"""


@query(f"""WITH s AS ({_JSON_SIDE.format(1)}), t AS ({_JSON_SIDE.format(0)})
    SELECT coalesce(s.k, t.k) AS k, coalesce(s.n, t.n) AS name, coalesce(s.v, t.v) AS value FROM s FULL OUTER JOIN t ON s.k = t.k AND s.n = t.n""")
def merge_json(spark: SparkSession, d: str) -> DataFrame:
    schema = _one("json_merge", dict)
    incoming, existing = _split(_patches(spark, d), "event_id")
    return _members(compact.plan(schema, incoming.drop("event_id"), _existing(schema, existing.drop("event_id"))))


@query("""WITH base AS (SELECT DISTINCT user_id AS k FROM events)
    SELECT k, CASE WHEN k % 3 <> 0 THEN '1' END AS a_x, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS a_y, k % 3 = 0 AS dropped FROM base""")
def merge_json_nested(spark: SparkSession, d: str) -> DataFrame:
    """Nested members change one by one, and null deletes."""
    users = _events(spark, d).select(F.col("user_id").alias("k")).distinct()
    change = F.concat(
        F.lit('{"a":{'),
        F.concat_ws(",", F.when(F.col("k") % 3 == 0, F.lit('"x":null')), F.when(F.col("k") % 2 == 0, F.lit('"y":"new"'))),
        F.lit("}}"),
    )
    existing = users.select("k", F.lit('{"a":{"x":"1","y":"old"}}').alias("v"))
    out = compact.plan(_one("json_merge", dict), users.select("k", change.alias("v")), existing)
    at = lambda p: F.get_json_object("v", p)
    return out.select("k", at("$.a.x").alias("a_x"), at("$.a.y").alias("a_y"), at("$.a.x").isNull().alias("dropped"))


@query("""WITH s AS (SELECT p_brand AS k, max(p_size) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
      t AS (SELECT p_brand AS k, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(s.k, t.k) AS k, CAST(coalesce(s.v, 0) * 1000 + coalesce(t.v, 0) AS BIGINT) AS v FROM s FULL OUTER JOIN t ON s.k = t.k""")
def merge_custom_expr(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"k": (str, "pk"), "v": (int, "max; expr:coalesce(s.{}, 0) * 1000 + coalesce(t.{}, 0)")})
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("k"), F.col("p_size").cast("bigint").alias("v"))
    incoming, existing = _split(rows)
    return compact.plan(schema, incoming.drop("key"), existing.groupBy("k").agg(F.max("v").alias("v")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(round(l_quantity * 100)) AS BIGINT) AS quantity,
    max(CASE WHEN l_suppkey % 2 = 1 OR n = 1 OR odd = 0 THEN l_returnflag END) AS flag FROM (
      SELECT *, count(*) OVER w AS n, sum(l_suppkey % 2) OVER w AS odd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
    GROUP BY 1, 2""")
def merge_composite_pk(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"l_orderkey": (int, "pk"), "l_linenumber": (int, "pk"), "quantity": (int, "sum"), "flag": (str, "coalesce")})
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), _cents("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")
    )
    incoming, existing = _split(rows, "l_suppkey")
    return compact.plan(schema, incoming.drop("l_suppkey"), _existing(schema, existing.drop("l_suppkey")))


@query("""WITH s AS (SELECT ps AS k, count(*) AS n FROM (SELECT l_partkey + 7 AS ps FROM lineitem) GROUP BY 1)
    SELECT coalesce(s.k, p_partkey) AS k, p_name AS name, s.n IS NULL AS only_existing, p_name IS NULL AS only_incoming,
      coalesce(s.n, 0) AS lines FROM s FULL OUTER JOIN part ON s.k = p_partkey""")
def merge_unmatched_both_sides(spark: SparkSession, d: str) -> DataFrame:
    """Keys moved by seven: the first parts have no lines, and the last lines no part."""
    schema = table_schema("t", {"k": (int, "pk"), "name": str, "lines": (int, "sum")})
    incoming = table(spark, d, "lineitem").select((F.col("l_partkey") + 7).alias("k"), F.lit(1).cast("bigint").alias("lines"))
    existing = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit(0).cast("bigint").alias("lines"))
    out = compact.plan(schema, incoming, existing)
    return out.select("k", "name", (F.col("lines") == 0).alias("only_existing"), F.col("name").isNull().alias("only_incoming"), "lines")


@query("""WITH s AS (SELECT 'n=' || (s_nationkey % 4) AS part, s_suppkey % 10 AS k, CAST(sum(round(s_acctbal * 100)) AS BIGINT) AS v FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1, 2),
      t AS (SELECT 'n=' || (s_nationkey % 4) AS part, s_suppkey % 10 AS k, CAST(sum(round(s_acctbal * 100)) AS BIGINT) AS v FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1, 2)
    SELECT coalesce(s.part, t.part) AS part, coalesce(s.k, t.k) AS k, coalesce(s.v, 0) + coalesce(t.v, 0) AS v
    FROM s FULL OUTER JOIN t ON s.part = t.part AND s.k = t.k""")
def merge_partition_local(spark: SparkSession, d: str) -> DataFrame:
    """Equal keys in two partitions never meet."""
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.format_string("n=%d", F.col("s_nationkey") % 4).alias("part"), (F.col("s_suppkey") % 10).alias("k"), _cents("s_acctbal").alias("v")
    )
    incoming, existing = _split(rows)
    schema = _one("sum", int)
    return compact.plan(schema, incoming.drop("key"), compact.plan(schema, existing.drop("key"), None, ["part"]), ["part"])


_ALL_ORDERS = f"""WITH {_ORDERS_SQL}
    SELECT cust AS k, max(ts) AS hi, min(ts) AS lo, CAST(sum(cents) AS BIGINT) AS cents, list_sort(list(DISTINCT status)) AS status FROM o GROUP BY 1"""
_ASSOC = table_schema("t", {"k": (int, "pk"), "hi": (int, "max"), "lo": (int, "min"), "cents": (int, "sum"), "status": list[str]})


def _assoc(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("key", F.col("cust").alias("k"), F.col("last_order").alias("hi"), F.col("first_order").alias("lo"), "cents", "status")


@query(_ALL_ORDERS)
def merge_two_cycles(spark: SparkSession, d: str) -> DataFrame:
    rows = _assoc(spark, d)
    first = compact.plan(_ASSOC, rows.where("key % 2 = 0"))
    return compact.plan(_ASSOC, rows.where("key % 2 = 1"), first)


@query(_ALL_ORDERS)
def merge_three_batches(spark: SparkSession, d: str) -> DataFrame:
    """However rows are dealt to batches, max, min, sum and list_union give the same."""
    rows, out = _assoc(spark, d), None
    for k in (2, 0, 1):
        out = compact.plan(_ASSOC, rows.where(f"key % 3 = {k}"), out)
    return out


# --- schema evolution and absent values ----------------------------------------------------


@query("""SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS later FROM customer""")
def schema_add_column(spark: SparkSession, d: str) -> DataFrame:
    """Existing files lack a column that incoming ones have; a third one neither has."""
    schema = table_schema("t", {"k": (int, "pk"), "name": str, "segment": str, "later": str})
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    incoming, existing = _split(rows, "k")
    return compact.plan(schema, incoming, existing.drop("segment"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def schema_drop_column(spark: SparkSession, d: str) -> DataFrame:
    """A column that the schema no longer declares falls away."""
    schema = table_schema("t", {"k": (int, "pk"), "name": str})
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    incoming, existing = _split(rows, "k")
    return compact.plan(schema, incoming, existing)


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS name, nullif(event_id % 4, 0) AS score,
    CASE WHEN event_id % 5 <> 0 THEN [event_type] END AS tags FROM events WHERE event_id <> 0 AND event_id % 7 <> 0""")
def zero_as_absent(spark: SparkSession, d: str) -> DataFrame:
    """Empty texts and lists and zeros are absent; rows without a key are dropped."""
    schema = table_schema("t", {"id": (int, "pk"), "name": str, "score": int, "tags": list[str]})
    e = F.col("event_id")
    rows = _events(spark, d).select(
        F.when(e % 7 != 0, e).otherwise(0).alias("id"),
        F.when(e % 3 != 0, F.col("event_type")).otherwise("").alias("name"),
        (e % 4).alias("score"),
        F.when(e % 5 != 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit(1).alias("unknown"),
    )
    return normalise(schema, rows)


# --- partitioning ----------------------------------------------------------------------------


@query("SELECT id, substr(coalesce(id, ''), 1, 2) AS p FROM partitioned_row")
def part_slice(spark: SparkSession, d: str) -> DataFrame:
    rule = PartitionRule("p", "id", 0, 2)
    return table(spark, d, "partitioned_row").select("id", partition.rule_value(rule, partition.text_of("id", _text())).alias("p"))


def _text():
    from pyspark.sql import types as T

    return T.StringType()


def _hash_sql(v: str, n: int) -> str:
    return f"lpad_hex(CAST(concat('0x', substr(sha256({v}), 1, 4)) AS INTEGER) % {n})".replace("lpad_hex(", "(SELECT CASE WHEN length(h) < 2 THEN '0' || h ELSE h END FROM (SELECT lower(to_hex(") + ") AS h))"


@query(f"SELECT DISTINCT id, {_hash_sql('id', 16)} AS b16, {_hash_sql('id', 65536)} AS b65536 FROM partitioned_row WHERE id IS NOT NULL")
def part_hash(spark: SparkSession, d: str) -> DataFrame:
    b = lambda n: partition.rule_value(PartitionRule("b", "id", buckets=n), F.col("id"))
    return table(spark, d, "partitioned_row").where("id IS NOT NULL").select("id", b(16).alias("b16"), b(65536).alias("b65536")).distinct()


@query("""SELECT coalesce(region, '') AS region, 'area=' || replace(replace(replace(coalesce(region, ''), '%', '%25'), '/', '%2F'), chr(92), '%5C') AS dir,
    count(*) AS n FROM partitioned_row GROUP BY 1, 2""")
def part_direct(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"id": (str, "pk"), "region": (str, "partition:area")})
    rows = table(spark, d, "partitioned_row").select(F.coalesce("region", F.lit("")).alias("region"), partition.part_dir(schema).alias("dir"))
    return rows.groupBy("region", "dir").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT file_path, replace(replace(replace(replace(file_path, '%', '%25'), '/', '%2F'), chr(92), '%5C'), chr(10), '%0A') AS encoded FROM stored_file""")
def part_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored_file").select("file_path", partition.encode_column(F.col("file_path")).alias("encoded"))


@query(f"SELECT DISTINCT id, 'p=' || replace(replace(substr(id, 1, 2), '%', '%25'), '/', '%2F') || '/b=' || {_hash_sql('id', 16)} AS dir FROM partitioned_row WHERE id <> ''")
def part_dirs(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("partitioned_row", {"id": (str, "pk; partition:p=[0:2],b=hash(16)")})
    return table(spark, d, "partitioned_row").where("id <> ''").select("id", partition.part_dir(schema).alias("dir")).distinct()


# --- upserts, coercions and readers ----------------------------------------------------------


@query("""WITH s AS (SELECT user_id AS k, max(event_type) AS kind, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1),
      t AS (SELECT user_id AS k, max(event_type) AS kind, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(s.k, t.k) AS k, coalesce(s.kind, t.kind) AS kind, coalesce(s.n, 0) + coalesce(t.n, 0) AS n FROM s FULL OUTER JOIN t ON s.k = t.k
    WHERE coalesce(s.k, t.k) <> 0""")
def upsert_batch_dups(spark: SparkSession, d: str) -> DataFrame:
    """An upsert's repeated keys are aggregated before they meet existing rows."""
    schema = table_schema("t", {"k": (int, "pk"), "kind": str, "n": (int, "sum")})
    rows = _events(spark, d).select("event_id", F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("kind"), F.lit("1").alias("n"))
    incoming, existing = _split(rows, "event_id")
    return compact.plan(schema, normalise(schema, incoming), _existing(schema, normalise(schema, existing)))


_TYPED = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '+' || event_id WHEN 2 THEN ' ' || event_id WHEN 3 THEN event_id || '.0' WHEN 4 THEN '-' || event_id ELSE 'x' || event_id END"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(v AS BIGINT) ELSE 0 END AS v FROM (SELECT event_id, {_TYPED} AS v FROM events)")
def coerce_int64(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", F.expr(_TYPED.replace("VARCHAR", "STRING")).alias("v"))
    return rows.select("event_id", coerce.int64_column(F.col("v")).alias("v"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "title", "lang", "source", F.concat_ws(",", "tags").alias("tags"))


def _clean(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('', 'und', 'N/A') THEN trim({c}) END"


@query(f"SELECT doc_id, coalesce({_clean('lang')}, {_clean('source')}) AS v FROM documents WHERE coalesce({_clean('lang')}, {_clean('source')}) IS NOT NULL")
def reader_first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    v = records.compile_field("lang | source", F.col, ("und", "N/A"))
    return rows.select("doc_id", v.alias("v")).where("v IS NOT NULL")


@query(f"SELECT doc_id, v FROM (SELECT doc_id, list_filter([{_clean('lang')}, {_clean('source')}], lambda x: x IS NOT NULL) AS v FROM documents) WHERE len(v) > 0")
def reader_merge_list(spark: SparkSession, d: str) -> DataFrame:
    v = records.compile_field("lang & source", F.col, ("und", "N/A"))
    return _docs(spark, d).select("doc_id", v.alias("v")).where("v IS NOT NULL")


@query("SELECT doc_id, v FROM (SELECT doc_id, list_filter(tags, lambda x: trim(x) NOT IN ('', 'tools')) AS v FROM documents) WHERE len(v) > 0")
def reader_split_null(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", records.split_column(F.col("tags"), False, ",", ("tools",)).alias("v")).where("v IS NOT NULL")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS kind, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k
    FROM events WHERE event_id % 5 <> 0""")
def reader_jsonl_root(spark: SparkSession, d: str) -> DataFrame:
    """Lines with an array at 'items', one record an item; other lines have none, and are skipped."""
    e = F.col("event_id")
    item = F.struct(e.alias("id"), F.col("event_type").alias("kind"), F.when(e % 2 == 0, F.from_json("props", "k string")).alias("props"))
    text = F.when(e % 5 != 0, F.to_json(F.struct(F.array(item).alias("items")))).otherwise(F.lit('{"other": 1}'))
    options = records.ReadOptions(
        fields={"id": "id", "kind": "missing | kind", "k": "props.k"}, root="items", transform={"kind": lambda c: F.upper(c)}
    )
    return jsonl_records(_events(spark, d).select(text.alias("value")), options)


@query("SELECT doc_id, coalesce(text <> '' AND regexp_matches(text, 'timeout|scheduler'), false) AS hit FROM documents")
def regex_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", records.match_column(F.col("text"), "timeout|scheduler").alias("hit"))


# --- tables on disk: import, merge, read ------------------------------------------------------


def _engine(spark: SparkSession) -> Engine:
    """An engine over a fresh root in the folder that all executors share."""
    return Engine(spark, f"{shared_dir(spark).removeprefix('file://')}/root-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The flagship by files: existing and incoming orders imported and merged in two cycles."""
    engine = _engine(spark)
    t = engine.register(MASTER)
    incoming, existing = _split(_orders(spark, d).where("cust <> 0"))
    t.import_df("existing", existing)
    t.merge()
    t.import_df("odd", incoming.where("cust % 3 <> 0"))
    t.merge()
    out = cut(t.read())
    remove(spark, engine.root)
    return out


@query("SELECT * FROM (" + _MASTER_SQL + ") WHERE cust <> 0")
def table_import_merge_read(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)


@query("SELECT id, max(name) AS name, max(region) AS region, max(nullif(updated_at, 0)) AS updated_at FROM (SELECT id, nullif(name, '') AS name, nullif(region, '') AS region, updated_at FROM partitioned_row WHERE id <> '') GROUP BY 1")
def table_partitioned_merge(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the largest table imported into hashed partitions and merged by one job."""
    schema = table_schema("partitioned_row", {"id": (str, "pk; bloom; partition:p=[0:1],b=hash(4)"), "name": str, "region": str, "updated_at": (int, "overwrite")})
    engine = _engine(spark)
    t = engine.register(schema)
    t.import_df("all", table(spark, d, "partitioned_row"))
    t.merge()
    out = cut(t.read())
    remove(spark, engine.root)
    return out


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE c_custkey <> 0)
    SELECT k, CASE WHEN k % 10 = 0 THEN 'new ' || name ELSE name END AS name, nullif(CASE WHEN k % 10 = 0 THEN cents + 1 ELSE nullif(cents, 0) END, NULL) AS cents FROM t""")
def table_upsert(spark: SparkSession, d: str) -> DataFrame:
    schema = table_schema("t", {"k": (int, "pk; partition:b=hash(2)"), "name": str, "cents": (int, "sum")})
    engine = _engine(spark)
    t = engine.register(schema)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), _cents("c_acctbal").alias("cents"))
    t.import_df("all", rows)
    t.merge()
    t.upsert(rows.where("k % 10 = 0").select("k", F.concat(F.lit("new "), "name").alias("name"), F.lit(1).alias("cents")))
    out = cut(t.read().select("k", "name", F.when(F.col("k") % 10 == 0, F.col("cents")).otherwise(F.nullif("cents", F.lit(0))).alias("cents")))
    remove(spark, engine.root)
    return out


@query("SELECT * FROM (" + _MASTER_SQL + ") WHERE cust = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark)
    t = engine.register(MASTER)
    incoming, existing = _split(_orders(spark, d))
    t.import_df("existing", existing)
    t.merge()
    t.import_df("odd", incoming.where("cust % 3 <> 0"))
    t.merge()
    out = cut(t.lookup(cust=7))
    remove(spark, engine.root)
    return out


@query(f"SELECT count(*) AS n, count(DISTINCT cust) AS keys, CAST(count(*) - count(DISTINCT cust) AS BIGINT) AS dups FROM ({_MASTER_SQL})")
def active_read_count(spark: SparkSession, d: str) -> DataFrame:
    out = customer_master_merge(spark, d)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cust").alias("keys")).withColumn("dups", F.col("n") - F.col("keys"))


# --- the company table itself ------------------------------------------------------------------

COMPANY = table_schema(
    "company",
    {
        "id": (str, "pk; bloom; partition:b=hash(256)"),
        "name": str,
        "phones": list[str],
        "source": (dict, "json_merge"),
        "first_seen": (int, "min"),
        "last_seen": (int, "max"),
        "import_count": (int, "sum"),
        "updated_at": (int, "overwrite"),
    },
)


@query("""WITH s AS (SELECT id, max(nullif(name, '')) AS name, list(phones) FILTER (phones IS NOT NULL) AS ph, min(nullif(first_seen, 0)) AS f,
        max(nullif(last_seen, 0)) AS l, sum(nullif(import_count, 0)) AS n, max(nullif(updated_at, 0)) AS u FROM company WHERE id <> '' GROUP BY id)
    SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name,
      list_sort(list_distinct(list_filter(list_concat(coalesce(t.phones, []), coalesce(flatten(s.ph), [])), lambda x: x IS NOT NULL))) AS phones,
      least(s.f, t.first_seen) AS first_seen, greatest(s.l, t.last_seen) AS last_seen,
      CAST(coalesce(s.n, 0) + coalesce(t.import_count, 0) AS BIGINT) AS import_count, coalesce(s.u, t.updated_at) AS updated_at
    FROM s FULL OUTER JOIN company_main t ON s.id = t.id""")
def company_merge(spark: SparkSession, d: str) -> DataFrame:
    """The company table's declaration over all its rows; sources are compared in company_sources."""
    out = compact.plan(COMPANY, normalise(COMPANY, table(spark, d, "company")), table(spark, d, "company_main"))
    return out.drop("source")


# A batch's patches are folded in the order of their text, and what they fold to is laid over the existing object.
@query("""WITH m AS (SELECT id, source, unnest(json_keys(source)) AS name FROM company WHERE id <> '' AND source <> ''),
      s AS (SELECT id, name, arg_max(CAST(json_extract_string(source, '$."' || name || '".seen') AS BIGINT), source) AS seen FROM m GROUP BY 1, 2),
      o AS (SELECT id, source, unnest(json_keys(source)) AS name FROM company_main WHERE source <> ''),
      t AS (SELECT id, name, CAST(json_extract_string(source, '$."' || name || '".seen') AS BIGINT) AS seen FROM o)
    SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name, CASE WHEN s.id IS NULL THEN t.seen ELSE s.seen END AS seen
    FROM s FULL OUTER JOIN t ON s.id = t.id AND s.name = t.name""")
def company_sources(spark: SparkSession, d: str) -> DataFrame:
    """The members of each id's merged source object, with their values."""
    schema = table_schema("t", {"id": (str, "pk"), "source": (dict, "json_merge")})
    incoming = normalise(schema, table(spark, d, "company").select("id", "source"))
    out = compact.plan(schema, incoming, table(spark, d, "company_main").select("id", "source"))
    members = out.select("id", F.explode(F.from_json("source", "map<string,struct<seen:string>>")).alias("name", "held"))
    return members.select("id", "name", F.col("held.seen").cast("bigint").alias("seen"))
