"""Consolidating far too many small files into fewer well-sized ones.

Planning is SQL only and reads listings, never data:

1. ``live_files``: the files that readers must see, from the listing, the manifests and
   the commit each manifest names as its last.
2. ``plan_groups``: the frozen listing in a fixed order, a running sum of bytes, and one
   output group for each interval of the target size.
3. ``rewrite``: the records of the planned files are written group by group, and rows in
   and out are counted by group.
4. ``publish``: each partition's manifest takes the new files in place of those they were
   written from. Groups whose counts differ raise before any partition is published.

The running sum is taken in two levels, within ranges of about ``BLOCK_FILES`` files in
path order and then over the ranges' totals, so that a partition which holds a third of
all files isn't sorted in one task, and groups follow the path order at every size.

Null or empty paths are no files. Repeated or differently spelled manifest entries count
once. A manifest entry that is gone from the listing is no file. Null sizes count as 0
bytes; empty tables give empty plans. Only the columns named are read, so others may
have any name.
"""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.session import cut
from siltwork.sources import manifest
from siltwork.sources.storage import Storage

TARGET_BYTES = 128 * 1024 * 1024
SMALL_BYTES = 1_048_576
BLOCK_FILES = 10_000


def clean_path(path: Column) -> Column:
    """The path without repeated slashes, '.' segments and outer blanks."""
    once = F.regexp_replace(F.trim(path), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(once, r"/(\./)+", "/"), r"^(\./)+", "")


def partition_of(path: Column) -> Column:
    """The main directory of a stored file's partition, null for other paths.

    <root>/main/<table>/<p>/<b>/files/<file> and <root>/inc/<table>/<source>/<p>/<b>/<file>.
    """
    main = F.regexp_extract(path, r"^(.*?/main/[^/]+/[^/=]+=[^/]*/[^/=]+=[^/]*)/", 1)
    inc = F.regexp_replace(
        F.regexp_extract(path, r"^(.*?/inc/[^/]+/[^/]+/[^/=]+=[^/]*/[^/=]+=[^/]*)/[^/]+$", 1),
        r"^(.*?)/inc/([^/]+)/[^/]+/([^/]+/[^/]+)$",
        "$1/main/$2/$3",
    )
    return F.when(main != "", main).when(inc != "", inc)


def below_inc(path: Column) -> Column:
    """The part of an inc path below its root: inc/<table>/<source>/..., wherever it begins."""
    return F.regexp_extract(path, r"(?:^|/)(inc/[^/]+/[^/]+/[^/=]+=[^/]*/[^/=]+=[^/]*/[^/]+)$", 1)


def live_files(stored: DataFrame, manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """(part_dir, file_path, size_bytes, n_rows, area) of every live file; area: main or inc."""
    files = stored.select(
        F.col("file_path"),
        partition_of(F.col("file_path")).alias("part_dir"),
        F.col("file_path").rlike("/inc/[^/]+/[^/]+/[^/=]+=[^/]*/[^/=]+=[^/]*/[^/]+$").alias("is_inc"),
        F.element_at(F.split("file_path", "/"), -1).alias("base"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.col("n_rows"),
    ).where("part_dir IS NOT NULL")
    listed = manifests.select("part_dir", F.explode("active_files").alias("entry")).where("trim(entry) <> ''")
    entry = clean_path(F.col("entry"))
    full = F.when(F.instr(entry, F.concat("part_dir", F.lit("/"))) > 0, F.substring(entry, F.instr(entry, F.col("part_dir")), F.length(entry)))
    active = listed.select(
        F.coalesce(full, F.concat("part_dir", F.lit("/"), F.regexp_replace(entry, "^/+", ""))).alias("file_path")
    ).distinct()
    last = manifests.where("last_commit IS NOT NULL").select("part_dir", F.col("last_commit").alias("tx_id"))
    consumed = (
        commits.select("part_dir", "tx_id", "input_files")
        .join(last, ["part_dir", "tx_id"], "left_semi")
        .select("part_dir", F.explode("input_files").alias("entry"))
        .select("part_dir", below_inc(clean_path(F.col("entry"))).alias("tail"))
        .where("tail <> ''")
        .distinct()
    )
    main = files.where("NOT is_inc").join(active, "file_path", "left_semi")
    inc = (
        files.where("is_inc AND base LIKE '%.parquet' AND NOT base LIKE '.%'")
        .withColumn("tail", below_inc(F.col("file_path")))
        .join(consumed, ["part_dir", "tail"], "left_anti")
    )
    cols = ["part_dir", "file_path", "size_bytes", "n_rows"]
    return main.select(*cols, F.lit("main").alias("area")).unionByName(inc.select(*cols, F.lit("inc").alias("area")))


def plan_groups(
    live: DataFrame, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, block_files: int = BLOCK_FILES
) -> DataFrame:
    """(part_dir, file_path, size_bytes, n_rows, group_no) of the files worth rewriting.

    Those are live files below small_bytes in partitions with at least two of them.
    group_no counts intervals of target_bytes in the running sum over the partition's paths,
    from 0. The ranges are written down once: sampling them again could deal files otherwise.
    """
    small = live.where(F.col("size_bytes") < small_bytes).select("part_dir", "file_path", "size_bytes", "n_rows")
    ranges = max(1, -(-small.count() // block_files))
    ranged = cut(small.repartitionByRange(ranges, "part_dir", "file_path").withColumn("block", F.spark_partition_id()))
    in_block = Window.partitionBy("part_dir", "block").orderBy("file_path").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("size_bytes").over(in_block))
    sums = ranged.groupBy("part_dir", "block").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    part = Window.partitionBy("part_dir")
    before = part.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part_dir", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("ahead"), F.sum("files").over(part).alias("n_small"))
    start = F.col("ahead") + F.col("upto") - F.col("size_bytes")
    return running.join(offsets.where("n_small >= 2"), ["part_dir", "block"]).select(
        "part_dir", "file_path", "size_bytes", "n_rows", F.floor(start / target_bytes).cast("bigint").alias("group_no")
    )


def planned_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The stored rows of the planned files, each as often as its file holds it, with (part_dir, group_no)."""
    return rows.join(plan.select("file_path", "part_dir", "group_no"), "file_path")


def rewrite(rows: DataFrame, plan: DataFrame, out_dir: str) -> DataFrame:
    """Writes the planned groups to out_dir and gives (part_dir, group_no, n_files, rows_in, rows_out).

    Each group is one file, __part_dir=<escaped part_dir>/__group_no=<n>/<file>: the exchange
    brings a group to one task, which begins a new file for each of its groups, however many
    it has. Counts are taken from the stored rows before, and from the written files after;
    ``publish`` and ``checked`` raise if they differ.
    """
    spark = rows.sparkSession
    keys = ["part_dir", "group_no"]
    tagged = planned_rows(rows, plan).withColumnsRenamed({k: f"__{k}" for k in keys})
    own = [f"__{k}" for k in keys]
    tagged.repartition(*own).sortWithinPartitions(*own).write.mode("error").option("compression", "zstd").partitionBy(*own).parquet(out_dir)
    held = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    read = plan.join(held, "file_path", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("rows_in"))
    written = spark.read.schema(tagged.schema).parquet(out_dir).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows a file
    rows_out = written.groupBy(*[F.col(f"__{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows_out"))
    return read.join(rows_out, keys, "left").fillna(0, ["rows_in", "rows_out"])


def reconciled(report: DataFrame) -> bool:
    """Whether every group's rows came out as often as they went in."""
    return report.where("rows_in <> rows_out").isEmpty()


def checked(report: DataFrame) -> DataFrame:
    """The report of a rewrite, if it lost or doubled nothing; else an error."""
    if not reconciled(report):
        raise ValueError("consolidation: rows written differ from rows read")
    return report


def publish(storage: Storage, root: str, plan: DataFrame, report: DataFrame, out_dir: str, workers: int = 10) -> int:
    """Puts the groups written to out_dir in place of the planned files; the number of partitions published.

    root is where file paths and part_dirs begin. Each partition has one commit: its
    manifest lists the new files and those active ones that weren't planned, and its commit
    record the inc files that were. A partition that isn't reached stays as it was. The plan
    comes to the driver partition by partition, as paths.
    """
    checked(report)
    written: dict[str, list[str]] = {}
    for o in storage.list(out_dir):
        found = re.search(r"/__part_dir=([^/]+)/__group_no=(\d+)/[^/]+\.parquet$", o.path)
        if found:
            written.setdefault(unquote(found[1]), []).append(o.path)

    def one(part: tuple[str, set[str]]) -> int:
        directory, planned = part
        main = f"{root}/{directory}"
        active = [posixpath.relpath(p, main) for p in manifest.active_files(storage, main)]
        kept = [a for a in active if posixpath.normpath(f"{directory}/{a}") not in planned]
        new = []
        for o in sorted(written[directory]):
            new.append(f"files/merged_{int(time.time() * 1000)}_{uuid.uuid4().hex[:8]}.parquet")
            storage.upload(o, f"{main}/{new[-1]}")
        manifest.commit(storage, main, kept + new, sorted(p for p in planned if "/inc/" in f"/{p}"), lambda p: storage.delete(f"{root}/{p}"))
        return 1

    rows = plan.select("part_dir", "file_path").orderBy("part_dir").toLocalIterator()
    parts = ((d, {r.file_path for r in files}) for d, files in groupby(rows, key=lambda r: r.part_dir))
    done = 0
    with ThreadPoolExecutor(workers) as pool:
        while some := list(islice(parts, 10 * workers)):
            done += sum(pool.map(one, some))
    return done
