"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import leakage, names, packing, reading, seen, survivor
from siltwork.session import cut, table


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every id with a usable name, and the smallest id of its group."""
    return names.groups(table(spark, d, "company"), table(spark, d, "company_main"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs_of(names.linked(table(spark, d, "company"), table(spark, d, "company_main")))


def _seen(spark: SparkSession, d: str, bits: int = seen.BITS) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "company").select("obs_id", "id", "arrived_at")
    return seen.seen_before(rows, table(spark, d, "company_main").select("id"), "id", "obs_id", "arrived_at", bits=bits)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d)[0]


def p4_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rates of the filters that p4_found probes, and of narrow ones over the same keys, whose errors can be counted."""
    return seen.error_report(_seen(spark, d)[1]).unionByName(seen.error_report(_seen(spark, d, seen.MEASURED_BITS)[1]))


def p4_rates_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether the errors counted of narrow filters fit their stated rate, within five standard deviations."""
    off = F.abs(F.col("wrong") - F.col("asked") * F.col("stated_rate")) <= 5 * F.sqrt(F.col("asked") * F.col("stated_rate"))
    return seen.error_report(_seen(spark, d, seen.MEASURED_BITS)[1]).agg(F.coalesce(F.min(off), F.lit(True)).alias("fits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_rows(table(spark, d, "company"), table(spark, d, "import_source"))


def p5_fused(spark: SparkSession, d: str) -> DataFrame:
    return survivor.fuse(survivor.claims(table(spark, d, "company"))).survivors()


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivor.fuse(survivor.claims(table(spark, d, "company"))).report()


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(cut(packing.token_sizes(table(spark, d, "documents"))), table(spark, d, "pack_container"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d), table(spark, d, "pack_container"))


def p6_held(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container: containers over capacity, texts split though they fit, texts whose tokens aren't all there, and texts."""
    kinds = table(spark, d, "pack_container")
    sizes = cut(packing.token_sizes(table(spark, d, "documents")))
    pieces = cut(packing.packed(sizes, kinds))
    capacity = kinds.select("container_kind", "capacity_tokens")
    bins = pieces.groupBy("container_kind", "shard", "bin").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(capacity), "container_kind")  # settings
    over = bins.groupBy("container_kind").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("over"))
    docs = pieces.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("parts"))
    checked = docs.join(sizes, "doc_id", "left").join(F.broadcast(capacity), "container_kind")
    needless = F.col("parts") > F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    by_kind = checked.groupBy("container_kind").agg(
        F.count(F.when(needless, 1)).alias("split"), F.count(F.when(~F.col("held").eqNullSafe(F.col("n_tokens")), 1)).alias("torn"), F.count(F.lit(1)).alias("texts")
    )
    return over.join(by_kind, "container_kind")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: the documents that hold it, and its best alignment."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("score").alias("best_score"), F.max("longest_run").alias("longest_run")
    )


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading.levels(docs, reading.learn(docs, table(spark, d, "reading_label")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words by site and level."""
    site = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("site"))
    return _levels(spark, d).join(site, "doc_id").groupBy("site", "reading_level").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words")
    )


QUERIES = (p2_found, p2_groups, p4_found, p4_error_rates, p4_rates_hold, p5_found, p5_fused, p5_sources, p6_packed, p6_fill, p6_held, p7_found, p7_items, p8_found, p8_profile)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_STAND = ", ".join(f"'{s}'" for s in survivor.STAND_INS)


def oracle_sql() -> dict[str, str]:
    usable = lambda c: f"CASE WHEN {c} BETWEEN {survivor.USABLE_FROM} AND {survivor.USABLE_TO} THEN {c} END"
    return {
        "p4_rates_hold": "SELECT true AS fits",
        "p6_held": """SELECT container_kind, 0 AS over, 0 AS split, 0 AS torn, (SELECT count(*) FROM documents WHERE text <> '') AS texts
            FROM pack_container WHERE capacity_tokens >= 1""",
        "p4_found": """SELECT obs_id FROM (SELECT obs_id, id, row_number() OVER (PARTITION BY id ORDER BY arrived_at, obs_id) AS k
            FROM company WHERE id <> '') WHERE k > 1 OR id IN (SELECT id FROM company_main WHERE id <> '')""",
        "p5_found": f"""
            WITH c AS (SELECT id, obs_id, regexp_replace(name, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS name,
                {usable('first_seen')} AS f, {usable('last_seen')} AS l, {usable('updated_at')} AS u,
                coalesce(trust, -1) AS trust
              FROM company LEFT JOIN import_source s ON lower(trim(company.import_source)) = lower(trim(s.import_source))
              WHERE id IN (SELECT id FROM company WHERE id <> '' GROUP BY id HAVING count(*) >= 2)),
            real AS (SELECT * FROM c WHERE name IS NOT NULL AND lower(name) NOT IN ({_STAND}) AND regexp_matches(name, '[\\p{{L}}\\p{{N}}]')),
            good AS (SELECT * FROM real a WHERE NOT regexp_matches(name, '(\\.\\.\\.|…)$') AND NOT EXISTS (
              SELECT 1 FROM real b WHERE b.id = a.id AND length(b.name) > length(a.name) AND starts_with(b.name, a.name))),
            sane AS (SELECT * FROM c WHERE l IS NULL OR f IS NULL OR l >= f)
            SELECT id, 'name' AS field_name, obs_id FROM good
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY trust DESC, coalesce(u, -1) DESC, obs_id) = 1
            UNION ALL SELECT id, 'first_seen', obs_id FROM sane WHERE f IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, obs_id) = 1
            UNION ALL SELECT id, 'last_seen', obs_id FROM sane WHERE l IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, obs_id) = 1
            UNION ALL SELECT id, 'updated_at', obs_id FROM c WHERE u IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC, obs_id) = 1""",
    }
