"""Queries for what happens around a merge: imports, files, recovery, upkeep and readers.

They run the engine over a store of their own, below the folder that all executors share.
Where the outcome is a state of the store, it comes out as rows of names and counts.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.engine import Engine, MergeError, Options
from siltwork.functions import coerce, jsonpatch, partition
from siltwork.ingest import ImportOptions, normalise
from siltwork.plans import compact
from siltwork.queries.registry import Registry
from siltwork.schema import SchemaError, snake_case, table_schema
from siltwork.session import cut, remove, shared_dir, table
from siltwork.sources import records
from siltwork.sources import manifest as M
from siltwork.sources.excel import read_excel
from siltwork.sources.jsonl import jsonl_records
from siltwork.sources.storage import HadoopStorage, KeyMap, MemoryStorage
from siltwork.streaming.imports import import_batch, stream_into

_registry = Registry()
query, queries, oracle_sql = _registry.query, _registry.queries, _registry.oracle_sql

CUSTOMER = table_schema("customers", {"k": (int, "pk"), "name": str, "segment": str, "cents": (int, "sum")})
SPREAD = table_schema("customers", {"k": (int, "pk; partition:b=hash(4)"), "name": str, "segment": str, "cents": (int, "sum")})
_CUSTOMERS = "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, nullif(CAST(round(c_acctbal * 100) AS BIGINT), 0) AS cents FROM customer WHERE c_custkey <> 0"
_SUMS = """SELECT o_custkey AS k, max(o_orderpriority) AS priority, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents
    FROM orders WHERE o_custkey <> 0 GROUP BY 1"""
SUMS = table_schema("sums", {"k": (int, "pk; partition:b=hash(3)"), "priority": (str, "max"), "n": (int, "sum"), "cents": (int, "sum")})


def _customers(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), cents.alias("cents"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.lit(1).cast("bigint").alias("n"), cents.alias("cents"), F.col("o_orderkey").alias("key")
    )


@contextmanager
def _store(spark: SparkSession, **options) -> Iterator[Engine]:
    """An engine over a fresh root, which is removed at the end: what is returned must be cut before."""
    engine = Engine(spark, f"{shared_dir(spark).removeprefix('file://')}/root-{uuid.uuid4().hex}", **options)
    try:
        yield engine
    finally:
        remove(spark, engine.root)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- imports -------------------------------------------------------------------------------------


@query(_SUMS)
def import_several_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each priority's orders come from a source of their own; one cycle merges them all, in all partitions."""
    with _store(spark) as engine:
        t = engine.register(SUMS)
        for source in sorted(r[0] for r in _orders(spark, d).select("priority").distinct().collect()):  # five
            t.import_df(source, _orders(spark, d).where(F.col("priority") == source))
        t.merge()
        return cut(t.read())


@query(_CUSTOMERS)
def import_typed_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of one process, as mappings."""
    with _store(spark) as engine:
        t = engine.register(SPREAD)
        t.import_records("list", [r.asDict() for r in _customers(spark, d).collect()])
        t.merge()
        return cut(t.read())


@query(f"SELECT *, true AS bounded, true AS sorted FROM ({_CUSTOMERS})")
def import_streamed_rows(spark: SparkSession, d: str) -> DataFrame:
    """An iterator of records with few rows a file and few open partitions: files are bounded and sorted by key, and hold every row."""
    schema = table_schema("customers", {"id": (str, "pk; partition:p=[0:1]"), "name": str, "segment": str, "cents": (int, "sum")})
    with _store(spark) as engine:
        t = engine.register(schema)
        rows = ({"id": str(r.k), "name": r.name, "segment": r.segment, "cents": r.cents} for r in _customers(spark, d).where("k <> 0").toLocalIterator())
        files = t.import_rows("feed", rows, ImportOptions(max_rows_per_file=50, max_bytes_per_file=2000, max_open_partitions=4))
        held = spark.read.parquet(*files).withColumn("f", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
        per = held.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
        ok = per.agg(F.max("n").alias("most"), F.min(F.col("ids") == F.array_sort("ids")).alias("sorted")).first()
        t.merge()
        out = t.read().select(F.col("id").cast("bigint").alias("k"), "name", "segment", "cents")
        return cut(out.withColumns({"bounded": F.lit(ok.most <= 50), "sorted": F.lit(ok.sorted)}))


@query(f"SELECT *, true AS sorted FROM ({_CUSTOMERS.replace('c_custkey AS k', 'CAST(c_custkey AS VARCHAR) AS k')})")
def upsert_sorted_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Merged files of an upsert are sorted by the key."""
    schema = table_schema("customers", {"k": (str, "pk; partition:b=hash(2)"), "name": str, "segment": str, "cents": (int, "sum")})
    with _store(spark) as engine:
        t = engine.register(schema)
        t.upsert(_customers(spark, d).where("k <> 0").withColumn("k", F.col("k").cast("string")))
        files = [f for fs in t.active().values() for f in fs]
        held = spark.read.parquet(*files).select("k", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda x: x["k"])
        ok = held.groupBy("f").agg(ids.alias("ids")).agg(F.min(F.col("ids") == F.array_sort("ids"))).scalar().alias("sorted")
        return cut(t.read().withColumn("sorted", ok))


@query("SELECT DISTINCT 'd=' || replace(replace(region, '%', '%25'), '/', '%2F') AS dir, dense_rank() OVER (ORDER BY 'd=' || replace(replace(region, '%', '%25'), '/', '%2F')) AS place FROM partitioned_row WHERE id <> '' AND region <> ''")
def partition_list(spark: SparkSession, d: str) -> DataFrame:
    """Pending partitions in the order in which they are merged."""
    schema = table_schema("t", {"id": (str, "pk"), "region": (str, "partition:d")})
    with _store(spark) as engine:
        t = engine.register(schema)
        t.import_df("all", table(spark, d, "partitioned_row").where("region <> ''").select("id", "region"))
        return _small(spark, [(p, i) for i, p in enumerate(t.pending(), 1)], "dir string, place bigint")


@query(_SUMS)
def stream_imports(spark: SparkSession, d: str) -> DataFrame:
    """Orders come as a stream of files, in micro-batches; a merge after every second one."""
    with _store(spark) as engine:
        t = engine.register(SUMS)
        src = f"{engine.root}/src"
        _orders(spark, d).drop("key").repartition(5).write.parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_into(t, stream, "feed", f"{engine.root}/checkpoint", merge_every=2).awaitTermination()
        t.merge()
        return cut(t.read())


@query(_SUMS)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """A batch is lost after some of its files are pending; a merge takes these; the batch is given again and counts once."""
    with _store(spark) as engine:
        t = engine.register(SUMS)
        move, calls = t.move_in, []

        def lost(staged: dict[str, str]) -> list[str]:
            calls.append(1)
            if len(calls) == 1:
                move(dict(list(staged.items())[:1]))
                raise OSError("lost")
            return move(staged)

        t.move_in = lost
        try:
            import_batch(t, "feed", _orders(spark, d).drop("key"), 0)
        except OSError:
            t.merge()
        import_batch(t, "feed", _orders(spark, d).drop("key"), 0)
        t.merge()
        return cut(t.read())


# --- files and stores ------------------------------------------------------------------------------


@query(_CUSTOMERS.replace("c_mktsegment AS segment", "CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment"))
def schema_probe(spark: SparkSession, d: str) -> DataFrame:
    """Pending files with different columns: what some files lack is null, and found without reading rows."""
    with _store(spark) as engine:
        t = engine.register(CUSTOMER)
        t.import_df("with", _customers(spark, d).where("k % 2 = 1"))
        t.import_df("without", _customers(spark, d).where("k % 2 = 0").drop("segment"))
        t.merge()
        return cut(t.read())


@query(f"SELECT k, name, segment, coalesce(cents, 0) + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS cents FROM ({_CUSTOMERS})")
def legacy_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Files from before there were manifests are adopted by the first merge, once: the second one finds them replaced."""
    with _store(spark) as engine:
        t = engine.register(CUSTOMER)
        old = f"{engine.root}/old"
        normalise(CUSTOMER, _customers(spark, d)).write.parquet(old)
        for o in engine.fs.list(old):
            if o.path.endswith(".parquet"):
                engine.fs.upload(o.path, f"{t.main_dir}/{uuid.uuid4()}.parquet")
        ones = _customers(spark, d).where("k % 5 = 0").select("k", F.lit(1).cast("bigint").alias("cents"))
        for k in (0, 1):
            t.import_df(f"s{k}", ones.where(f"k % 2 = {k}"))
            t.merge()
        return cut(t.read())


@query(_CUSTOMERS.replace("c_name AS name", "CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS name"))
def remote_store(spark: SparkSession, d: str) -> DataFrame:
    """A store that Spark can't read: published files are brought to the shared folder for merges and reads."""
    with _store(spark, storage=MemoryStorage()) as engine:
        t = engine.register(table_schema("customers", {"k": (int, "pk; partition:b=hash(4)"), "name": str, "segment": str, "cents": int}))
        t.import_df("all", _customers(spark, d))
        t.merge()
        t.upsert(_customers(spark, d).where("k % 10 = 0").select("k", F.lit("new").alias("name")))
        return cut(t.read())


@query("SELECT file_path, 'pre/fix/' || file_path AS key, '/data/' || file_path AS back FROM stored_file")
def key_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Paths below a root to keys of a bucket, and back."""
    keys = KeyMap("bucket", "/data", "pre/fix")
    key, back = F.udf(lambda p: keys.key(f"/data/{p}"), useArrow=True), F.udf(keys.path, useArrow=True)
    return table(spark, d, "stored_file").select("file_path", key("file_path").alias("key"), back(key("file_path")).alias("back"))


@query("""SELECT * FROM (VALUES ('download', true), ('list nothing', true), ('list sorted', true), ('missing json', true), ('missing file', true), ('delete twice', true),
    ('upload takes the file', true), ('json replaced', true), ('no bucket', true), ('no root', true), ('outside', true)) AS v(name, held)""")
def storage_contract(spark: SparkSession, d: str) -> DataFrame:
    """What the engine asks of a store, over the shared folder by Hadoop's file systems."""
    st, out = HadoopStorage(spark), []
    base = f"{shared_dir(spark)}/contract-{uuid.uuid4().hex}"

    def fails(f: Callable, kind: type[Exception]) -> bool:
        try:
            f()
        except kind:
            return True
        return False

    with tempfile.TemporaryDirectory() as tmp:
        out.append(("list nothing", st.list(base) == []))
        out.append(("missing json", fails(lambda: st.read_json(f"{base}/x.json"), FileNotFoundError)))
        out.append(("missing file", fails(lambda: st.download(f"{base}/x", f"{tmp}/x"), FileNotFoundError)))
        for v in (1, 2):
            st.write_json(f"{base}/b/x.json", {"v": v})
        out.append(("json replaced", st.read_json(f"{base}/b/x.json") == {"v": 2}))
        with open(f"{tmp}/up", "w") as f:
            f.write("text")
        st.upload(f"file://{tmp}/up", f"{base}/a/up")
        out.append(("upload takes the file", not os.path.exists(f"{tmp}/up")))
        names = [o.path.removeprefix(base) for o in st.list(base) if not o.path.endswith(".crc")]
        out.append(("list sorted", names == ["/a/up", "/b/x.json"]))
        st.download(f"{base}/a/up", f"file://{tmp}/down")
        with open(f"{tmp}/down") as f:
            out.append(("download", f.read() == "text"))
        st.delete(f"{base}/a/up")
        st.delete(f"{base}/a/up")
        out.append(("delete twice", [o.path for o in st.list(f"{base}/a") if not o.path.endswith(".crc")] == []))
    out.append(("no bucket", fails(lambda: KeyMap("", "/data"), ValueError)))
    out.append(("no root", fails(lambda: KeyMap("b", ""), ValueError)))
    out.append(("outside", fails(lambda: KeyMap("b", "/data").key("/other/x"), ValueError)))
    remove(spark, base)
    return _small(spark, out, "name string, held boolean")


# --- recovery and upkeep ----------------------------------------------------------------------------


@query(_SUMS)
def recover_interrupted(spark: SparkSession, d: str) -> DataFrame:
    """A crash between the commit and the removal of what it consumed: the next merge applies nothing twice."""
    with _store(spark) as engine:
        t = engine.register(SUMS)
        t.import_df("even", _orders(spark, d).where("key % 2 = 0"))
        delete, engine.fs.delete = engine.fs.delete, lambda path: None  # nothing is removed any more
        t.merge()
        engine.fs.delete = delete
        left = len([o for objects in t.pending().values() for o in objects])
        t.import_df("odd", _orders(spark, d).where("key % 2 = 1"))
        t.merge()
        if not left or t.pending():
            raise AssertionError("consumed files were to be left, and then removed")
        return cut(t.read())


@query("""SELECT * FROM (VALUES ('active', 3), ('commit records', 3), ('inactive', 0), ('pending', 0), ('staged', 0), ('temporary', 0)) AS v(kind, files)""")
def vacuum_leftovers(spark: SparkSession, d: str) -> DataFrame:
    """What crashes leave behind goes: orphans, temporary files, staged work, superseded commit records, empty folders."""
    with _store(spark) as engine:
        t = engine.register(SUMS)
        for k in (0, 1):
            t.import_df(f"s{k}", _orders(spark, d).where(f"key % 2 = {k}"))
            t.merge()
        part = next(iter(t.active()))
        for p in (f"{t.main_dir}/{part}/files/merged_1_orphan.parquet", f"{t.main_dir}/{part}/files/.x.parquet.tmp", f"{t.inc_dir}/a/{part}/x.parquet.tmp", f"{engine.root}/.staging/old/x.parquet"):
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "w"):
                pass
            for at in (p, os.path.dirname(p)):
                os.utime(at, (0, 0))
        engine.fs.write_json(f"{t.main_dir}/{part}/_commit_old.json", {"tx_id": "old", "input_files": [], "output_files": []})
        t.vacuum()
        active = {f for fs in t.active().values() for f in fs}
        names = [o.path for o in engine.fs.list(engine.root)]
        count = lambda f: len([n for n in names if f(n)])
        kinds = {
            "active": len({os.path.dirname(n) for n in names if n in active}),
            "inactive": count(lambda n: n.startswith(t.main_dir) and n.endswith(".parquet") and n not in active),
            "temporary": count(lambda n: n.endswith(".tmp")),
            "staged": count(lambda n: "/.staging/" in n),
            "pending": count(lambda n: n.startswith(t.inc_dir)),
            "commit records": count(lambda n: os.path.basename(n).startswith("_commit_")),
        }
        return _small(spark, [(k, v) for k, v in sorted(kinds.items())], "kind string, files int")


_GOOD = "SELECT n_name AS area, n_nationkey AS k, '{\"r\":' || n_regionkey || '}' AS v FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey <> 0"


@query(f"SELECT *, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey <> 0) AS failed FROM ({_GOOD})")
def isolated_failures(spark: SparkSession, d: str) -> DataFrame:
    """Partitions that can't be merged, here for bad JSON in two patches of a key, leave the others alone, and their errors come together."""
    schema = table_schema("t", {"area": (str, "pk; partition:a"), "k": int, "v": (dict, "json_merge")})
    nations = table(spark, d, "nation").where("n_nationkey <> 0")
    good = F.concat(F.lit('{"r":'), F.col("n_regionkey"), F.lit("}"))
    bad = F.col("n_nationkey") % 5 == 0
    with _store(spark, options=Options(workers=3)) as engine:
        t = engine.register(schema)
        for k in (1, 2):
            t.import_df(f"s{k}", nations.select(F.col("n_name").alias("area"), F.col("n_nationkey").cast("bigint").alias("k"), F.when(bad, F.lit(f"{{bad {k}")).otherwise(good).alias("v")))
        failed = 0
        try:
            t.merge()
        except MergeError as e:
            failed = len(e.errors)
        return cut(t.read().withColumn("failed", F.lit(failed).cast("bigint")))


@query("""SELECT * FROM (VALUES ('first cycle', 1, 3), ('second cycle', 2, 3), ('upsert', 3, 3)) AS v(step, version, commits)""")
def commit_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each publish of a partition is one version of its manifest, whose last commit has the one record that is kept."""
    with _store(spark) as engine:
        t, out = engine.register(SUMS), []

        def state(step: str) -> None:
            manifests = [M.load(engine.storage, f"{t.main_dir}/{p}") for p in t.active()]
            recorded = [o.path for o in engine.storage.list(t.main_dir) if os.path.basename(o.path).startswith("_commit_")]
            kept = sum(any(p.endswith(f"_commit_{m.last_commit}.json") for p in recorded) for m in manifests)
            (version,) = {m.version for m in manifests}
            out.append((step, version, kept if len(recorded) == len(manifests) else -1))

        for step, k in (("first cycle", 0), ("second cycle", 1)):
            t.import_df(f"s{k}", _orders(spark, d).where(f"key % 2 = {k}"))
            t.merge()
            state(step)
        t.upsert(_orders(spark, d).drop("key"))
        state("upsert")
        return _small(spark, out, "step string, version int, commits int")


# --- declarations and strategies ------------------------------------------------------------------------


@query("SELECT c_custkey AS k, c_name AS full_name, CASE WHEN c_custkey % 2 = 1 THEN 'x' ELSE c_mktsegment END AS seg FROM customer")
def schema_rename(spark: SparkSession, d: str) -> DataFrame:
    """Columns named otherwise than their fields."""
    schema = table_schema("t", {"k": (int, "pk"), "name": (str, "column:full_name"), "segment": (str, "overwrite; column:seg")})
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("seg"))
    return compact.plan(schema, rows.where("k % 2 = 1").withColumn("seg", F.lit("x")), rows)


_ODD = ("select", "group", "a`b", "or der", "x.y")


@query('SELECT s_suppkey AS "select", count(*) AS "group", max(s_name) AS "a`b", min(s_nationkey)::BIGINT AS "or der", max(s_name) AS "x.y" FROM supplier GROUP BY 1')
def schema_reserved_names(spark: SparkSession, d: str) -> DataFrame:
    """Reserved words, blanks, points and backticks in names."""
    schema = table_schema("t", {"select": (int, "pk"), "group": (int, "sum"), "a`b": (str, "max"), "or der": (int, "min"), "x.y": (str, "agg:max({}); expr:coalesce(s.{}, t.{})")})
    cols = ("s_suppkey", F.lit(1).cast("bigint"), "s_name", "s_nationkey", "s_name")
    rows = table(spark, d, "supplier").select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cols, _ODD)])
    rows = rows.withColumn("or der", F.col("`or der`").cast("bigint"))
    return compact.plan(schema, rows.where("`select` % 2 = 1"), compact.plan(schema, rows.where("`select` % 2 = 0")))


@query("""WITH e AS (SELECT user_id AS k, max(CASE WHEN event_id % 3 <> 0 THEN event_id END) AS last FROM events GROUP BY 1)
    SELECT k, last IS NULL AS none, last AS n FROM e""")
def merge_null_patches(spark: SparkSession, d: str) -> DataFrame:
    """Null patches are no patches; a key with no other has none. Of equally long numbers the largest text is the largest."""
    schema = table_schema("t", {"k": (int, "pk"), "v": (dict, "json_merge")})
    e = F.col("event_id")
    value = F.when(e % 3 != 0, F.format_string('{"n":"%012d"}', e))
    out = compact.plan(schema, table(spark, d, "events").select(F.col("user_id").alias("k"), value.alias("v")))
    return out.select("k", F.col("v").isNull().alias("none"), F.get_json_object("v", "$.n").cast("bigint").alias("n"))


@query("""WITH s AS (SELECT l_partkey AS k, max(l_quantity::DOUBLE) AS q, bool_or(l_returnflag = 'R') AS r, max(l_shipdate::TIMESTAMP) AS at FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
      t AS (SELECT l_partkey AS k, max(l_quantity::DOUBLE) AS q, bool_or(l_returnflag = 'R') AS r, max(l_shipdate::TIMESTAMP) AS at FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
    SELECT coalesce(s.k, t.k) AS k, coalesce(s.q, t.q) AS q, coalesce(s.r, t.r) AS r, CAST(floor(epoch(coalesce(s.at, t.at))) AS BIGINT) AS at FROM s FULL OUTER JOIN t ON s.k = t.k""")
def merge_default_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Without a tag, types beyond the three declared ones go by the largest of a batch, and incoming before existing."""
    import datetime

    schema = table_schema("t", {"k": (int, "pk"), "q": float, "r": bool, "at": datetime.datetime}, extended_types=True)
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_returnflag") == "R").alias("r"), F.col("l_shipdate").cast("timestamp").alias("at"), "l_linenumber"
    )
    out = compact.plan(schema, rows.where("l_linenumber % 2 = 1").drop("l_linenumber"), compact.plan(schema, rows.where("l_linenumber % 2 = 0").drop("l_linenumber")))
    return out.withColumn("at", F.unix_seconds("at"))


_TAGS = ("p=[0:2]", "p=[2:4]", "p=[4:2]", "p=[2:2]", "b=hash(1)", "b=hash(65536)", "b=hash(0)", "b=hash(65537)", "area")


@query(f"SELECT tag, tag NOT IN ('p=[4:2]', 'p=[2:2]', 'b=hash(0)', 'b=hash(65537)') AS accepted FROM (SELECT unnest({list(_TAGS)}) AS tag)")
def partition_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Slices need an end beyond their start, and hashes 1 to 65,536 buckets."""

    def accepted(tag: str) -> bool:
        try:
            table_schema("t", {"id": (str, f"pk; partition:{tag}")})
        except SchemaError:
            return False
        return True

    return _small(spark, [(t, accepted(t)) for t in _TAGS], "tag string, accepted boolean")


# --- functions -------------------------------------------------------------------------------------------


@query("SELECT n_name, lower(replace(n_name, ' ', '_')) AS snake, 'http_' || lower(replace(n_name, ' ', '_')) AS prefixed FROM nation")
def name_to_snake_case(spark: SparkSession, d: str) -> DataFrame:
    """Names of types to names of tables: UnitedKingdom to united_kingdom, HTTPFrance to http_france."""
    snake = F.udf(snake_case, useArrow=True)
    camel = F.replace(F.initcap("n_name"), F.lit(" "), F.lit(""))
    return table(spark, d, "nation").select("n_name", snake(camel).alias("snake"), snake(F.concat(F.lit("HTTP"), camel)).alias("prefixed"))


@query("""SELECT c_custkey AS k, to_json({'a_seg': c_mktsegment, 'b_list': [c_custkey, 1], 'c_in': {'n': c_name, 'z': NULL}}) AS v FROM customer""")
def json_serialise(spark: SparkSession, d: str) -> DataFrame:
    """Values as JSON text, keys sorted."""

    @F.pandas_udf("string")
    def text(k: pd.Series, name: pd.Series, seg: pd.Series) -> pd.Series:
        return pd.Series([jsonpatch.to_json({"c_in": {"z": None, "n": n}, "a_seg": s, "b_list": [int(i), 1]}) for i, n, s in zip(k, name, seg)])

    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), text("c_custkey", "c_name", "c_mktsegment").alias("v"))


@query("""SELECT source, CASE source WHEN '' THEN 'default' WHEN '.' THEN '%2E' WHEN '..' THEN '%2E%2E' ELSE replace(replace(source, '%', '%25'), '/', '%2F') END AS folder
    FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents UNION SELECT unnest(['', '.', '..', 'a/b', '100%']) UNION SELECT DISTINCT coalesce(import_source, '') FROM company)""")
def source_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of sources: never empty and never a way out."""
    names = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"))
    names = names.union(table(spark, d, "company").select(F.coalesce("import_source", F.lit("")))).union(_small(spark, [("",), (".",), ("..",), ("a/b",), ("100%",)], "source string"))
    return names.distinct().select("source", F.udf(partition.encode_source, useArrow=True)("source").alias("folder"))


@query("""SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS line, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS flag,
    CAST(l_orderkey AS VARCHAR) AS number FROM lineitem WHERE l_orderkey <> 0""")
def coerce_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and booleans as texts: whole doubles without a fraction."""
    schema = table_schema("t", {"k": (int, "pk"), "line": (int, "pk"), "whole": str, "flag": str, "number": str})
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("whole"), (F.col("l_returnflag") == "R").alias("flag"), F.col("l_orderkey").alias("number")
    )
    return normalise(schema, rows)


@query("""SELECT obs_id AS k, CASE WHEN len(list_filter(phones, lambda x: x IS NOT NULL)) > 0 THEN list_filter(phones, lambda x: x IS NOT NULL) END AS phones,
    CASE WHEN name <> '' THEN [name] END AS names FROM company WHERE obs_id <> 0""")
def coerce_list(spark: SparkSession, d: str) -> DataFrame:
    """Texts become lists of one, null items fall away, and so do lists without any other; numbers are no lists."""
    schema = table_schema("t", {"k": (int, "pk"), "phones": list[str], "names": list[str], "scalar": list[str]})
    rows = table(spark, d, "company").select(F.col("obs_id").alias("k"), "phones", F.col("name").alias("names"), F.col("obs_id").alias("scalar"))
    return normalise(schema, rows).where("scalar IS NULL").drop("scalar")


# --- readers -----------------------------------------------------------------------------------------------


def _workbook(sheets: dict[str, list[list]], formats: tuple[str, ...] = ()) -> bytes:
    """A workbook with inline texts, and numbers given as (number of the format, from 1; number)."""

    def cell(v) -> str:
        return f'<c s="{v[0]}"><v>{v[1]}</v></c>' if isinstance(v, tuple) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    main, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(map(cell, row)) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        codes = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{escape(c)}"/>' for i, c in enumerate(formats))
        used = "<xf/>" + "".join(f'<xf numFmtId="{164 + i}"/>' for i in range(len(formats)))
        z.writestr("xl/styles.xml", f"<styleSheet {main}><numFmts>{codes}</numFmts><cellXfs>{used}</cellXfs></styleSheet>")
    return out.getvalue()


def _read_book(spark: SparkSession, book: bytes, options: records.ReadOptions) -> DataFrame:
    path = f"{shared_dir(spark)}/book-{uuid.uuid4().hex}.xlsx"
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as f:
        f.write(book)
        f.flush()
        HadoopStorage(spark).copy_in(f.name, path)
    out = cut(read_excel(spark, path, options))
    remove(spark, path)
    return out


@query("""SELECT s_suppkey::VARCHAR AS id, s_name AS name, [s_phone, 'n' || s_nationkey] AS contacts, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_nationkey ELSE s_phone END AS first
    FROM (SELECT *, 'p' || s_suppkey AS s_phone FROM supplier)""")
def reader_excel(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by way of a workbook: the second sheet, headings in row 3, null-like cells, lists and first values."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").collect()
    cells = [[str(r.s_suppkey), f" {r.s_name} ", f"p{r.s_suppkey}", f"n{r.s_nationkey}", "N/A" if r.s_suppkey % 3 == 0 else f"p{r.s_suppkey}"] for r in rows]
    book = _workbook({"cover": [["nothing here"]], "data": [["title"], [], ["id", " name ", "phone", "nation", "maybe"], *cells]})
    fields = {"id": "id", "name": "name", "contacts": "phone & nation", "first": "maybe | nation"}
    return _read_book(spark, book, records.ReadOptions(fields=fields, null=("N/A",), header=3, sheet="data"))


@query("""SELECT s_suppkey::VARCHAR AS id, strftime(DATE '1899-12-30' + CAST(45000 + s_suppkey AS INTEGER), '%Y-%m-%d') AS day, format('{:,.2f}', s_acctbal) AS balance,
    (s_suppkey % 100) || '%' AS share, lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || ':30' AS hour FROM supplier""")
def reader_excel_formats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and dates come as the sheet shows them."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").collect()
    cells = [[str(r.s_suppkey), (1, 45000 + r.s_suppkey), (2, repr(float(r.s_acctbal))), (3, (r.s_suppkey % 100) / 100), (4, repr((r.s_suppkey % 24 + 0.5) / 24))] for r in rows]
    book = _workbook({"data": [["id", "day", "balance", "share", "hour"], *cells]}, ("yyyy\\-mm\\-dd", "#,##0.00", "0%", "hh:mm"))
    return _read_book(spark, book, records.ReadOptions(fields={c: c for c in ("id", "day", "balance", "share", "hour")}, header=1))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, '2' AS many, CASE WHEN event_id % 3 = 2 THEN event_type END AS two, 'first' AS wild, '["first","' || event_type || '"]' AS kinds,
    CASE WHEN event_id % 3 > 0 THEN '["' || event_type || '"]' ELSE '[]' END AS later FROM events""")
def reader_jsonl_queries(spark: SparkSession, d: str) -> DataFrame:
    """Paths with lengths, queries and wildcards."""
    e = F.col("event_id")
    items = F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("first").alias("kind")), F.struct((e % 3).alias("n"), F.col("event_type").alias("kind")))
    fields = {"id": "id", "many": "items.#", "two": "items.#(n==2).kind", "wild": "it?m*.0.kind", "kinds": "items.#.kind", "later": "items.#(n>0)#.kind"}
    lines = table(spark, d, "events").select(F.to_json(F.struct(e.alias("id"), items.alias("items"))).alias("value"))
    return jsonl_records(lines, records.ReadOptions(fields=fields))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, Callable[[str], Column]]:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "title")
    return rows, lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")


@query("SELECT doc_id, [trim(lang)] AS v FROM documents WHERE trim(lang) <> ''")
def reader_precedence(spark: SparkSession, d: str) -> DataFrame:
    """An expression with both signs is split at & only: the rest is the name of a column, which there isn't."""
    rows, source = _documents(spark, d)
    return rows.select("doc_id", records.compile_field("lang & source | title", source).alias("v")).where("v IS NOT NULL")


@query("SELECT trim(lang) AS lang, trim(title) AS title FROM (SELECT nullif(trim(lang), '') AS lang, nullif(trim(title), '') AS title FROM documents) WHERE lang IS NOT NULL OR title IS NOT NULL")
def reader_empty_records(spark: SparkSession, d: str) -> DataFrame:
    """Records without any field are dropped."""
    rows, source = _documents(spark, d)
    return records.project(rows, records.ReadOptions(fields={"lang": "lang", "title": "title"}), source)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_id % 4 < 2")
def reader_jsonl_framing(spark: SparkSession, d: str) -> DataFrame:
    """Lines with blanks around them count; blank and broken lines give nothing."""
    e = F.col("event_id")
    line = F.to_json(F.struct(e.alias("id"), F.col("event_type").alias("kind")))
    text = F.when(e % 4 == 0, line).when(e % 4 == 1, F.concat(F.lit(" \t"), line, F.lit(" \r"))).when(e % 4 == 2, F.lit("  \t ")).otherwise(F.lit('{"id": 1, "kind'))
    return jsonl_records(table(spark, d, "events").select(text.alias("value")), records.ReadOptions(fields={"id": "id", "kind": "kind"}))


@query("""SELECT doc_id, CASE WHEN len(tags) > 0 THEN coalesce(tags[1], '') ELSE '' END AS first, coalesce(list_filter(tags, lambda x: x IS NOT NULL), []) AS every,
    [CAST(n_chars AS VARCHAR)] AS number, n_chars AS size, coalesce(regexp_matches(post_kind, '^q'), false) AS asks, false AS bad FROM documents""")
def record_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Untyped records: the first of a list as text, scalars as lists of one, texts as numbers, patterns that are found or bad."""
    kinds = "doc_id bigint, first string, every array<string>, number array<string>, size bigint, asks boolean, bad boolean"

    def read(batches):
        for pdf in batches:
            out = []
            for doc, tags, n, kind in zip(pdf["doc_id"], pdf["tags"], pdf["n_chars"], pdf["post_kind"]):
                r = records.Record(tags=None if tags is None else list(tags), n=int(n), text=str(n), kind=kind)
                out.append((doc, r.text("tags"), r.texts("tags"), r.texts("n"), r.int64("text"), r.match("kind", "^q"), r.match("kind", "(")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    return table(spark, d, "documents").select("doc_id", "tags", "n_chars", "post_kind").mapInPandas(read, kinds)


@query("SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN 9223372036854775807 ELSE 0 END AS v FROM events")
def coerce_records(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of records: floats cut towards 0, texts in base 10, out of range the nearest end, all else 0."""

    @F.pandas_udf("bigint")
    def number(k: pd.Series) -> pd.Series:
        made = [(i + 0.75, f"-{i}", "9" * 30, [i])[i % 4] for i in k]
        return pd.Series([coerce.to_int64(v) for v in made], dtype="int64")

    return table(spark, d, "events").select(F.col("event_id").alias("k"), number("event_id").alias("v"))
