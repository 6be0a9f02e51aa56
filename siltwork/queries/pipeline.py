"""Queries of the general problems 1 and 3, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators import consolidate as C
from siltwork.operators import salted as S
from siltwork.session import cut, remove, shared_dir, table

USABLE_FROM, USABLE_TO = 946684800, 1767225599


def _ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "partitioned_row").select("id", "name", "region", "updated_at", "row_id")
    usable = F.when(F.col("updated_at").between(USABLE_FROM, USABLE_TO), F.col("updated_at"))
    return S.salted_aggregate(
        rows,
        "id",
        [
            S.count_rows("n_rows"),
            S.largest("latest_updated_at", usable),
            S.count_if("n_named", F.trim("name") != ""),
            S.smallest("first_row_id", F.col("row_id")),
            S.latest("latest_name", F.col("name"), usable),
        ],
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "partitioned_row").select("id", "row_id")
    counts = cut(S.salted_aggregate(rows, "id", [S.count_rows("n")]))
    every = counts.agg(F.sum("n")).scalar()
    return counts.where((F.col("n") * 100 >= every) & (F.col("id") != "")).select("id")


def p1_per_id(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).where("id <> ''")


def p1_names_per_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "partitioned_row").where("id <> ''")
    return S.salted_count_distinct(rows, "id", "name", "n_names")


def _live(spark: SparkSession, d: str) -> DataFrame:
    """The frozen listing: planning reads it several times."""
    return cut(C.live_files(*[table(spark, d, t) for t in ("stored_file", "partition_manifest", "commit_record")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the grouping gives a group."""
    return C.plan_groups(_live(spark, d)).where("group_no >= 0").select("part_dir", "file_path")


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = C.plan_groups(_live(spark, d))
    return plan.groupBy("part_dir").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"), F.count_distinct("group_no").alias("n_groups")
    )


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "partitioned_row")
    plan = C.plan_groups(_live(spark, d))
    out_dir = f"{shared_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    try:
        return C.checked(cut(C.rewrite(rows, cut(plan), out_dir)))
    finally:
        remove(spark, out_dir)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_per_id, p1_names_per_id, p3_found, p3_plan, p3_compacted)}


_USABLE = f"CASE WHEN updated_at BETWEEN {USABLE_FROM} AND {USABLE_TO} THEN updated_at END"

_LIVE = r"""
WITH files AS (
  SELECT file_path, coalesce(size_bytes, 0) AS size_bytes, file_path LIKE '%/inc/%' AS is_inc,
    CASE WHEN file_path LIKE '%/inc/%'
      THEN regexp_replace(file_path, '^(.*?)/inc/([^/]+)/[^/]+/([^/]+/[^/]+)/[^/]+$', '\1/main/\2/\3')
      ELSE regexp_extract(file_path, '^(.*?/main/[^/]+/[^/]+/[^/]+)/', 1) END AS part_dir,
    regexp_extract(file_path, '([^/]+)$', 1) AS base
  FROM stored_file),
active AS (
  SELECT DISTINCT part_dir || '/' || regexp_replace(regexp_replace(e, '/+', '/', 'g'), '^(\./)+', '') AS file_path
  FROM (SELECT part_dir, unnest(active_files) AS e FROM partition_manifest)),
used AS (
  SELECT DISTINCT part_dir, regexp_extract(e, '(inc/.*)$', 1) AS tail
  FROM (SELECT c.part_dir, unnest(c.input_files) AS e FROM commit_record c
        JOIN partition_manifest m ON m.part_dir = c.part_dir AND m.last_commit = c.tx_id)),
live AS (
  SELECT f.* FROM files f WHERE NOT is_inc AND file_path IN (SELECT file_path FROM active)
  UNION ALL
  SELECT f.* FROM files f WHERE is_inc AND base LIKE '%.parquet' AND base NOT LIKE '.%' AND NOT EXISTS (
    SELECT 1 FROM used u WHERE u.part_dir = f.part_dir AND u.tail = regexp_extract(f.file_path, '(inc/.*)$', 1))),
small AS (
  SELECT * FROM live WHERE size_bytes < 1048576
  QUALIFY count(*) OVER (PARTITION BY part_dir) >= 2)
"""

_CUM = """, cum AS (SELECT *, sum(size_bytes) OVER (PARTITION BY part_dir ORDER BY file_path ROWS UNBOUNDED PRECEDING) - size_bytes AS start FROM small)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """SELECT id FROM partitioned_row WHERE id <> '' GROUP BY id
            HAVING count(*) * 100 >= (SELECT count(*) FROM partitioned_row)""",
        "p1_per_id": f"""WITH u AS (SELECT *, {_USABLE} AS usable FROM partitioned_row WHERE id <> ''),
            best AS (SELECT id, name FROM u WHERE usable IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY usable DESC, name DESC NULLS LAST) = 1)
            SELECT u.id, count(*) AS n_rows, max(usable) AS latest_updated_at,
            count(CASE WHEN trim(u.name) <> '' THEN 1 END) AS n_named, min(row_id) AS first_row_id, any_value(best.name) AS latest_name
            FROM u LEFT JOIN best ON best.id = u.id GROUP BY u.id""",
        "p1_names_per_id": "SELECT id, count(DISTINCT name) AS n_names FROM partitioned_row WHERE id <> '' GROUP BY id",
        "p3_found": _LIVE + "SELECT part_dir, file_path FROM small",
        "p3_compacted": _LIVE
        + _CUM
        + """, held AS (SELECT file_path, count(*) AS n FROM partitioned_row GROUP BY 1)
            SELECT part_dir, CAST(floor(start / 134217728) AS BIGINT) AS group_no, count(*) AS n_files,
            CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_out
            FROM cum LEFT JOIN held ON held.file_path = cum.file_path GROUP BY 1, 2""",
        "p3_plan": _LIVE
        + _CUM
        + """
            SELECT part_dir, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
            count(DISTINCT floor(start / 134217728)) AS n_groups FROM cum GROUP BY part_dir""",
    }
