"""Engine and tables: pending files, merges, upserts and reads over a root folder.

    <root>/inc/<table>/<source>/<partition>/<file>.parquet    pending
    <root>/main/<table>/<partition>/_manifest.json            the read set, and the commit point
    <root>/main/<table>/<partition>/files/merged_<ms>_<id>.parquet
    <root>/.staging/                                          work that isn't published

One Spark job merges all partitions with pending files; each is then published by its own
manifest. If the job fails, partitions are merged one by one, so that those that can
succeed do, and the others' errors are raised together.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import posixpath
import re
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork import ingest
from siltwork.functions.partition import encode_source, part_dir_of
from siltwork.operators.strategies import holds_patches, only_incoming, quoted
from siltwork.plans import compact
from siltwork.schema import SchemaError, TableSchema, schema_of
from siltwork.session import keep_until_end, remove, shared_dir
from siltwork.sources import manifest as M
from siltwork.sources.storage import HadoopStorage, LocalStorage, Object, Storage, make_dirs

PART_DIR = "__silt_dir"
TMP_AGE, STAGING_AGE = 3600.0, 24 * 3600.0
_SIZE = re.compile(r"\s*\d+(\.\d+)?\s*([kmgt]i?b?|b|bytes)?\s*", re.I)


class MergeError(RuntimeError):
    """Partitions that couldn't be merged, with their errors."""

    def __init__(self, errors: dict[str, Exception]):
        self.errors = errors
        super().__init__("; ".join(f"{d or '(table)'}: {e}" for d, e in sorted(errors.items())))


@dataclass(frozen=True)
class Options:
    """workers: partitions published at once, and merged at once if they go one by one. shuffle_partitions: of merge jobs; None keeps the session's.

    memory_limit is checked, and advises the size of shuffle partitions: a worker's share
    of it over the threads. Bloom filters are left out if a file would be larger than bloom_max_file_bytes.
    """

    workers: int = 10
    memory_limit: str = "2GB"
    threads: int = 4
    shuffle_partitions: int | None = None
    disable_bloom: bool = False
    bloom_max_file_bytes: int = 256 * 1024 * 1024
    extended_types: bool = False

    def __post_init__(self) -> None:
        for name, least in (("workers", 10), ("threads", 4), ("bloom_max_file_bytes", 256 * 1024 * 1024)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, least)
        if not self.memory_limit:
            object.__setattr__(self, "memory_limit", "2GB")
        if not _SIZE.fullmatch(self.memory_limit):
            raise ValueError(f"bad memory limit {self.memory_limit!r}")


class Engine:
    """A root folder with its tables. fs holds pending and staged files, storage the published ones."""

    def __init__(
        self, spark: SparkSession, root: str, storage: Storage | None = None, options: Options | None = None, logger: logging.Logger | None | bool = True
    ):
        self.spark = spark
        remote = "://" in root
        self.root = root.rstrip("/") if remote else os.path.abspath(root)
        self.fs: Storage = HadoopStorage(spark) if remote else LocalStorage()
        self.storage = storage or self.fs
        self.options = options or Options()
        self.log = logging.getLogger("siltwork") if logger is True else logger or _silent()
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.Lock()
        self._live: set[str] = set()
        if not remote:
            make_dirs(f"{self.root}/inc")
            make_dirs(f"{self.root}/main")

    def register(self, declared: type | TableSchema) -> Table:
        schema = declared if isinstance(declared, TableSchema) else schema_of(declared, self.options.extended_types)
        return Table(self, schema)

    def close(self) -> None:
        """Nothing is held open; kept for symmetry with opening."""

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @contextmanager
    def locked(self, directories: Iterable[str]):
        """Holds the locks of partition directories, taken in one order by all."""
        with ExitStack() as stack:
            for d in sorted(set(directories)):
                with self._guard:
                    lock = self._locks.setdefault(d, threading.RLock())
                stack.enter_context(lock)
            yield

    def each(self, do: Callable, items: Iterable) -> list:
        """do(item) of all items, by as many threads as there are workers; the first error is raised when all are done."""
        with ThreadPoolExecutor(self.options.workers) as pool:
            return [f.result() for f in [pool.submit(do, i) for i in items]]

    @contextmanager
    def staging(self, kind: str):
        """A staging folder's path, removed at the end."""
        path = f"{self.root}/.staging/{kind}_{uuid.uuid4()}"
        self._live.add(path)
        try:
            yield path
        finally:
            self._live.discard(path)
            for o in self.fs.list(path):
                self.fs.delete(o.path)
            if "://" not in path:
                shutil.rmtree(path, ignore_errors=True)

    def sweep_staging(self) -> None:
        """Removes staged work that is a day old and not this handle's."""
        base = f"{self.root}/.staging"
        stale = time.time() - STAGING_AGE
        newest: dict[str, float] = {}
        for o in self.fs.list(base):
            top = f"{base}/{posixpath.relpath(o.path, base).split('/')[0]}"
            newest[top] = max(newest.get(top, 0.0), o.modified)
        if "://" not in base and os.path.isdir(base):
            for n in os.listdir(base):
                newest.setdefault(f"{base}/{n}", os.stat(f"{base}/{n}").st_mtime)
        for top, at in newest.items():
            if at < stale and top not in self._live:
                for o in self.fs.list(top):
                    self.fs.delete(o.path)
                if "://" not in top:
                    shutil.rmtree(top, ignore_errors=True)


def _silent() -> logging.Logger:
    log = logging.Logger("siltwork.silent")
    log.addHandler(logging.NullHandler())
    return log


class Table:
    """A registered table."""

    def __init__(self, engine: Engine, schema: TableSchema):
        self.engine, self.schema = engine, schema
        self.inc_dir = f"{engine.root}/inc/{schema.name}"
        self.main_dir = f"{engine.root}/main/{schema.name}"

    # --- pending files ---------------------------------------------------------------

    def writer(self, source: str, options: ingest.ImportOptions | None = None) -> ingest.ImportWriter:
        return ingest.ImportWriter(self.schema, self.engine.fs, f"{self.inc_dir}/{encode_source(source)}", options)

    def import_rows(self, source: str, records: Iterable, options: ingest.ImportOptions | None = None) -> list[str]:
        """Streams an iterable into pending files."""
        return ingest.import_all(self.writer(source, options), records)

    def import_records(self, source: str, records: list) -> list[str]:
        return self.import_rows(source, records)

    def import_df(self, source: str, df: DataFrame, max_rows_per_file: int = ingest.MAX_ROWS_PER_FILE) -> list[str]:
        """The same for a DataFrame, written by the executors; the driver only moves files."""
        with self.engine.staging("import") as path:
            return self.move_in(self.stage_import(source, df, path, max_rows_per_file))

    def stage_import(self, source: str, df: DataFrame, path: str, max_rows_per_file: int = ingest.MAX_ROWS_PER_FILE) -> dict[str, str]:
        """Writes df's rows below path as pending files to be; {staged file: where it goes}. Nothing is pending yet."""
        rows = ingest.with_part_dir(self.schema, ingest.normalise(self.schema, df), PART_DIR)
        ingest.stage(self.schema, rows, PART_DIR, path, not self.engine.options.disable_bloom, max_rows_per_file)
        staged = ingest.staged_files(self.engine.fs, path)
        where = self._directories(path) if staged else {}
        folder = f"{self.inc_dir}/{encode_source(source)}"
        return {o.path: "/".join(p for p in (folder, where[part], f"{uuid.uuid4()}.parquet") if p) for part, objects in sorted(staged.items()) for o in objects}

    def move_in(self, staged: dict[str, str]) -> list[str]:
        """Makes staged files pending; their paths."""
        self.engine.each(lambda f: self.engine.fs.upload(*f), staged.items())
        return list(staged.values())

    def _directories(self, path: str) -> dict[str, str]:
        """Part ids of staged files with their directories, by the rule columns of one row each."""
        if not self.schema.rules:
            return {r[0]: "" for r in self.engine.spark.read.parquet(path).select(ingest.PART_ID).distinct().collect()}
        needed = list(dict.fromkeys(r.column for r in self.schema.rules))
        struct = T.StructType([*self.schema.struct(needed).fields, T.StructField(ingest.PART_ID, T.StringType())])
        one = self.engine.spark.read.schema(struct).parquet(path).groupBy(ingest.PART_ID).agg(F.first(F.struct(*[quoted(c) for c in needed])).alias("r"))
        rows = one.select(ingest.PART_ID, "r.*")
        return {r[0]: r[1] for r in ingest.with_part_dir(self.schema, rows, PART_DIR).select(ingest.PART_ID, PART_DIR).collect()}

    def pending(self) -> dict[str, list[Object]]:
        """Pending files by partition directory, over all sources; hidden and temporary files aren't pending."""
        depth, out = len(self.schema.rules), {}
        for o in self.engine.fs.list(self.inc_dir):
            _, *inner, base = posixpath.relpath(o.path, self.inc_dir).split("/")
            if not base.endswith(".parquet") or base.startswith("."):
                continue
            if len(inner) != depth or any("=" not in p for p in inner):
                continue
            out.setdefault("/".join(inner), []).append(o)
        return dict(sorted(out.items()))

    # --- merging -----------------------------------------------------------------------

    def merge(self) -> int:
        """Merges all pending files; the number of partitions published."""
        self.engine.sweep_staging()
        pending = self.pending()
        if pending:
            done = self._run(list(pending), self._merge_dirs)
            self._clean_inc()
            return done
        return 0

    def upsert(self, rows: DataFrame | Iterable, source: str = "") -> int:
        """Merges rows directly, without pending files; the number of partitions published.

        A retry after a commit applies sums again: upserts carry no replay guard.
        """
        del source  # rows of an upsert have no source
        if isinstance(rows, DataFrame):
            with self.engine.staging("upsert") as path:
                df = ingest.with_part_dir(self.schema, ingest.normalise(self.schema, rows), PART_DIR)
                ingest.stage(self.schema, df, PART_DIR, path, False)
                staged = ingest.staged_files(self.engine.fs, path)
                where = self._directories(path) if staged else {}
                parts = {where[p]: objects for p, objects in staged.items()}
                return self._run(list(parts), lambda dirs: self._compact(dirs, self._staged(parts, dirs), parts, {})) if parts else 0
        typed = [r for r in (ingest.extract(self.schema, x) for x in rows) if r]
        by_dir: dict[str, list[dict]] = {}
        for r in typed:
            by_dir.setdefault(part_dir_of(self.schema, r), []).append(r)

        def some(dirs: list[str]) -> int:
            df = ingest.to_frame(self.engine.spark, self.schema, [r for d in dirs for r in by_dir[d]])
            return self._compact(dirs, lambda chosen: ingest.with_part_dir(self.schema, df, PART_DIR).where(F.col(PART_DIR).isin(chosen)), {}, {})

        return self._run(list(by_dir), some) if by_dir else 0

    def _run(self, dirs: list[str], job: Callable[[list[str]], int]) -> int:
        """One job over all directories; if it fails, one for each of them, with all errors together."""
        left = dirs
        try:
            return job(dirs)
        except (M.CommittedWithCleanupError, SchemaError):
            raise
        except Exception as e:
            if isinstance(e, MergeError):  # the other partitions are published, and mustn't be merged again
                left = [d for d in dirs if d in e.errors]
            if len(dirs) == 1:
                raise e if isinstance(e, MergeError) else MergeError({dirs[0]: e}) from e
            self.engine.log.warning("merge of %s failed for %d partitions, going on one by one: %s", self.schema.name, len(left), str(e).split("\n")[0])
        errors: dict[str, Exception] = {}

        def one(d: str) -> int:
            try:
                return job([d])
            except Exception as e:
                errors[d] = e.errors[d] if isinstance(e, MergeError) else e
                return 0

        with ThreadPoolExecutor(self.engine.options.workers) as pool:
            done = len(dirs) - len(left) + sum(pool.map(one, left))
        if errors:
            raise MergeError(errors)
        return done

    def _merge_dirs(self, dirs: list[str]) -> int:
        pending = {d: f for d, f in self.pending().items() if d in set(dirs)}
        return self._compact(dirs, None, pending, pending)

    def _full(self, d: str) -> str:
        return f"{self.main_dir}/{d}" if d else self.main_dir

    def _staged(self, parts: dict[str, list[Object]], dirs: list[str]) -> Callable[[list[str]], DataFrame]:
        return lambda chosen: ingest.with_part_dir(self.schema, self._scan([o.path for d in chosen for o in parts[d]], self.engine.fs), PART_DIR)

    def _delete_input(self, name: str) -> None:
        """Deletes a consumed input by the name a commit record has: relative to the root, or a full path."""
        full = name if "://" in name or name.startswith("/") else f"{self.engine.root}/{name}"
        self.engine.fs.delete(full)

    def _compact(
        self, dirs: list[str], incoming: Callable[[list[str]], DataFrame] | None, sizes: dict[str, list[Object]], consumed: dict[str, list[Object]]
    ) -> int:
        """Recovers, merges and publishes partition directories, holding their locks."""
        st = self.engine.storage
        with self.engine.locked(self._full(d) for d in dirs):
            self.engine.each(lambda d: M.recover(st, self._full(d), self._delete_input), dirs)
            if incoming is None:  # recovery may have removed pending files that were consumed before
                now = self.pending()
                consumed = sizes = {d: now[d] for d in dirs if d in now}
                dirs = [d for d in dirs if d in now]
                incoming = lambda chosen: self._pending_rows([o for d in chosen for o in consumed[d]])
            if not dirs:
                return 0
            errors: dict[str, Exception] = {}
            cleanup: list[Exception] = []
            for some, bloom in self._by_bloom(dirs, sizes):
                try:
                    self._publish(some, bloom, incoming, consumed, errors, cleanup)
                except SchemaError:
                    raise
                except Exception as e:
                    errors |= {d: e for d in some}
            if errors:
                raise MergeError(errors)
            if cleanup:
                raise cleanup[0]
        return len(dirs)

    def _by_bloom(self, dirs: list[str], sizes: dict[str, list[Object]]) -> list[tuple[list[str], bool]]:
        """Directories with whether their files get Bloom filters: those without whose files might be too large."""
        opt = self.engine.options
        if opt.disable_bloom or not self.schema.bloom_columns:
            return [(dirs, False)]
        files = dict(zip(dirs, self.engine.each(lambda d: {o.path: o.size for o in self.engine.storage.list(self._full(d))}, dirs)))
        large = set()
        for d in dirs:
            active = M.active_files(self.engine.storage, self._full(d))
            most = sum(o.size for o in sizes.get(d, [])) + sum(files[d].get(f, 0) for f in active)
            if max(1, most) > opt.bloom_max_file_bytes or (not most and opt.bloom_max_file_bytes <= 1):
                large.add(d)
        return [(some, bloom) for some, bloom in (([d for d in dirs if d not in large], True), (sorted(large), False)) if some]

    def _publish(
        self, dirs: list[str], bloom: bool, incoming: Callable[[list[str]], DataFrame], consumed: dict[str, list[Object]], errors: dict, cleanup: list
    ) -> None:
        """Merges directories by one job, and commits each of them. Those that can't be committed go to errors."""
        st = self.engine.storage
        active = dict(zip(dirs, self.engine.each(lambda d: M.active(st, self._full(d)), dirs)))
        old, new = [d for d in dirs if active[d][0]], [d for d in dirs if not active[d][0]]
        with self.engine.staging("merge") as path, self._localised([f for d in old for f in active[d][0]]) as local:
            merged = None
            if new:
                merged = compact.plan(self.schema, incoming(new), None, [PART_DIR])
            if old:
                both = compact.plan(self.schema, incoming(old), self._main_rows(local, {active[d][1] for d in old}), [PART_DIR])
                merged = merged.unionByName(both) if merged is not None else both
            staged = self._write(merged, path, bloom)
            columns = merged.drop(PART_DIR).schema.json()

            def one(d: str) -> None:
                names = []
                used = [posixpath.relpath(o.path, self.engine.root) if "://" not in o.path else o.path for o in consumed.get(d, [])]
                try:
                    for o in staged.get(_part_id(d), []):
                        names.append(f"files/merged_{int(time.time() * 1000)}_{uuid.uuid4().hex[:8]}.parquet")
                        st.upload(o.path, f"{self._full(d)}/{names[-1]}")
                    M.commit(st, self._full(d), names, used, self._delete_input, columns=columns)
                except M.CommittedWithCleanupError as e:
                    cleanup.append(e)
                except Exception as e:
                    errors[d] = e
                    return
                self.engine.log.info("merged %s/%s: %d files", self.schema.name, d, len(names))

            self.engine.each(one, dirs)

    def _write(self, merged: DataFrame, path: str, bloom: bool) -> dict[str, list]:
        """Stages the merged rows and checks that the files hold as many as were written."""
        seen = Observation()
        ingest.stage(self.schema, merged.observe(seen, F.count(F.lit(1)).alias("n")), PART_DIR, path, bloom)
        staged = ingest.staged_files(self.engine.fs, path)
        wrote = self.engine.spark.read.parquet(*[_escaped(o.path) for part in staged.values() for o in part]).count() if staged else 0
        expected = seen.get["n"]
        if wrote != expected:
            raise RuntimeError(f"staged files hold {wrote} rows, {expected} were written")
        return staged

    # --- reading -----------------------------------------------------------------------

    def _scan(self, paths: list[str], st: Storage, columns: Iterable[str] = ()) -> DataFrame:
        """The declared columns that the files have, in their declared types, over explicit files.

        columns: the schemas that the files' manifests give; footers are read only where one
        is missing or they differ. Explicit files add no columns from directory names. A
        column whose stored type differs, such as sums that were stored as doubles, is cast.
        """
        spark = self.engine.spark
        if not paths:
            return spark.createDataFrame([], self.schema.struct())
        uris = [_escaped(st.uri(p) or p) for p in paths]
        known = set(columns)
        if len(known) == 1 and "" not in known:
            return self._read(uris, T.StructType.fromJson(json.loads(known.pop())))
        try:
            stored = spark.read.option("mergeSchema", "true").parquet(*uris).schema
        except (AnalysisException, PySparkException) as e:
            if "MERGE" not in str(e).upper():
                raise
            by_type: dict[str, list[str]] = {}
            for u in uris:
                by_type.setdefault(spark.read.parquet(u).schema.json(), []).append(u)
            parts = [self._read(us, spark.read.parquet(us[0]).schema) for us in by_type.values()]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            return out
        return self._read(uris, stored)

    def _read(self, uris: list[str], stored: T.StructType) -> DataFrame:
        have = {f.name: f.dataType for f in stored.fields}
        wanted = [f for f in self.schema.fields if f.column in have]
        struct = T.StructType([T.StructField(f.column, have[f.column]) for f in wanted])
        df = self.engine.spark.read.schema(struct).parquet(*uris)
        same = all(have[f.column].simpleString() == f.spark_type.simpleString() for f in wanted)
        file = F.col("_metadata.file_path").alias("__silt_file")
        cols = [F.col(quoted(f.column)) if same else F.col(quoted(f.column)).cast(f.spark_type).alias(f.column) for f in wanted]
        return df.select(*cols, file)

    def _with_dir(self, df: DataFrame, pattern: str) -> DataFrame:
        """df with the partition directory that its file lies in."""
        if not self.schema.rules:
            return df.drop("__silt_file").withColumn(PART_DIR, F.lit(""))
        if "__silt_file" not in df.columns:
            return df.withColumn(PART_DIR, F.lit(""))
        path = F.url_decode(F.replace(F.col("__silt_file"), F.lit("+"), F.lit("%2B")))
        return df.withColumn(PART_DIR, F.regexp_extract(path, pattern, 1)).drop("__silt_file")

    def _pending_rows(self, objects: list[Object]) -> DataFrame:
        pattern = f"/inc/{re.escape(self.schema.name)}/[^/]+/(.*)/[^/]+$"
        return self._with_dir(self._scan([o.path for o in objects], self.engine.fs), pattern)

    def _main_rows(self, files: dict[str, str], columns: Iterable[str]) -> DataFrame:
        """Rows of active files, given as {stored path: readable path}."""
        names = re.escape(self.schema.name)
        return self._with_dir(self._scan(list(files.values()), self.engine.fs, columns), f"/main/{names}/(.*?)(?:/files)?/[^/]+$")

    @contextmanager
    def _localised(self, paths: list[str]):
        """{stored path: readable path}; files of a store that Spark can't read are there until the end of the block."""
        if not paths or self.engine.storage.uri(paths[0]) is not None:
            yield {p: self.engine.storage.uri(p) for p in paths}
            return
        folder = self._fetch_dir()
        try:
            yield self._fetched(paths, folder)
        finally:
            remove(self.engine.spark, folder)

    def _fetch_dir(self) -> str:
        return f"{shared_dir(self.engine.spark)}/fetch-{uuid.uuid4().hex}"

    def _fetched(self, paths: list[str], folder: str) -> dict[str, str]:
        """Copies of stored files in the folder that all executors share, each by way of one temporary file here."""
        st, shared = self.engine.storage, HadoopStorage(self.engine.spark)

        def one(p: str) -> tuple[str, str]:
            to = f"{folder}/main/{self.schema.name}/{posixpath.relpath(p, self.main_dir)}"
            fd, tmp = tempfile.mkstemp(suffix=".parquet")
            os.close(fd)
            try:
                st.download(p, tmp)
                shared.copy_in(tmp, to)
            finally:
                os.unlink(tmp)
            return p, to

        return dict(self.engine.each(one, paths))

    def _manifests(self) -> dict[str, tuple[list[str], str]]:
        """Active files and their columns by partition directory."""
        found = [posixpath.dirname(o.path) for o in self.engine.storage.list(self.main_dir) if o.path.endswith("/" + M.MANIFEST)]
        held = self.engine.each(lambda d: M.active(self.engine.storage, d), found)
        return dict(sorted(("" if d == self.main_dir else posixpath.relpath(d, self.main_dir), m) for d, m in zip(found, held)))

    def active(self) -> dict[str, list[str]]:
        """Active files by partition directory."""
        return {d: files for d, (files, _) in self._manifests().items()}

    def read(self, dedup: bool = False) -> DataFrame:
        """The merged rows as of now, in the declared columns.

        Lazy: a later merge deletes the files that it replaces. dedup also brings equal keys of
        different partitions to one row, by the strategies' aggregates; only tables whose
        partitions don't derive from the key can have such.
        """
        rows = self._full_rows(self._manifests())
        if not dedup:
            return rows
        grouped = compact.preaggregate(self.schema, rows)
        return grouped.select(
            *[(only_incoming(f, F.col(quoted(f.column))) if holds_patches(f) else F.col(quoted(f.column))).alias(f.column) for f in self.schema.fields]
        )

    def _full_rows(self, held: dict[str, tuple[list[str], str]]) -> DataFrame:
        files = [f for fs, _ in held.values() for f in fs]
        columns = {c for fs, c in held.values() if fs}
        if files and self.engine.storage.uri(files[0]) is None:
            folder = self._fetch_dir()
            keep_until_end(self.engine.spark, folder)
            df = self._scan(list(self._fetched(files, folder).values()), self.engine.fs, columns)
        else:
            df = self._scan(files, self.engine.storage, columns)
        return df.select(*[(F.col(quoted(f.column)) if f.column in df.columns else F.lit(None).cast(f.spark_type)).alias(f.column) for f in self.schema.fields])

    def lookup(self, **key) -> DataFrame:
        """The rows with the key's values. Where the key determines the partition, only its manifest and files are read."""
        missing = [c for c in self.schema.pk if c not in key]
        if missing:
            raise ValueError(f"no value for {', '.join(missing)}")
        if {r.column for r in self.schema.rules} <= set(self.schema.pk):
            d = part_dir_of(self.schema, key)
            held = {d: M.active(self.engine.storage, self._full(d))}
        else:
            held = self._manifests()
        out = self._full_rows(held)
        for c in self.schema.pk:
            out = out.where(F.col(quoted(c)) == F.lit(key[c]))
        return out

    # --- upkeep ------------------------------------------------------------------------

    def recover(self) -> int:
        """Finishes interrupted commits of every partition, with pending files or without; how many there are."""
        dirs = list(self.active())
        with self.engine.locked(self._full(d) for d in dirs):
            self.engine.each(lambda d: M.recover(self.engine.storage, self._full(d), self._delete_input), dirs)
        return len(dirs)

    def vacuum(self) -> None:
        """recover, and the removal of stale temporary files, staged work and empty folders."""
        self.recover()
        self.engine.sweep_staging()
        self._clean_inc()

    def _clean_inc(self) -> None:
        stale = time.time() - TMP_AGE
        for o in self.engine.fs.list(self.inc_dir):
            if o.path.endswith(".parquet.tmp") and o.modified < stale:
                self.engine.fs.delete(o.path)
        if "://" not in self.inc_dir:
            for at, _, _ in sorted(os.walk(self.inc_dir), reverse=True):
                if at != self.inc_dir:
                    try:
                        os.rmdir(at)
                    except OSError:
                        pass


def _part_id(directory: str) -> str:
    return hashlib.sha256(directory.encode()).hexdigest()[:24]


def _escaped(path: str) -> str:
    """A path with the characters that Spark would take for a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
