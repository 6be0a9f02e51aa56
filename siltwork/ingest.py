"""Bringing records in: rows to typed columns, staged Parquet, and the bounded import writer."""

from __future__ import annotations

import dataclasses
import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.coerce import absent_as_null, column_as, typed
from siltwork.functions.partition import part_dir, part_dir_of
from siltwork.operators.strategies import quoted
from siltwork.plans.compact import has_key
from siltwork.schema import TableSchema
from siltwork.sources.storage import Storage

MAX_ROWS_PER_FILE = 100_000
MAX_OPEN_PARTITIONS = 256
PART_ID = "__silt_part"


def normalise(schema: TableSchema, df: DataFrame) -> DataFrame:
    """df in the table's columns: typed, absent values null, rows without a full key dropped.

    Columns are found by name; those the table doesn't know fall away, those df lacks
    stay out. A name that df has twice is an error of df's own.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = [
        absent_as_null(column_as(F.col(quoted(f.column)), have[f.column], f), f.spark_type).alias(f.column)
        for f in schema.fields
        if f.column in have
    ]
    missing = [c for c in schema.pk if c not in have]
    if missing:
        raise ValueError(f"{schema.name}: no column {', '.join(missing)} of the primary key")
    return df.select(*cols).where(has_key(schema))


def extract(schema: TableSchema, record) -> dict | None:
    """A record (dataclass or mapping by column) as typed values by column; None without a full key."""
    if dataclasses.is_dataclass(record):
        values = {f.column: getattr(record, f.attr) for f in schema.fields}
    else:
        values = record
    row = {f.column: v for f in schema.fields if (v := typed(f, values.get(f.column))) is not None}
    return row if all(c in row for c in schema.pk) else None


def to_frame(spark: SparkSession, schema: TableSchema, rows: list[dict]) -> DataFrame:
    """Typed rows as a DataFrame with all of the table's columns."""
    return spark.createDataFrame([tuple(r.get(c) for c in schema.columns) for r in rows], schema.struct())


def with_part_dir(schema: TableSchema, df: DataFrame, name: str) -> DataFrame:
    """df with its partition directory; rule columns that df lacks count as absent."""
    lacking = {r.column for r in schema.rules} - set(df.columns)
    full = df.withColumns({c: F.lit(None).cast(schema[c].spark_type) for c in lacking}) if lacking else df
    return full.withColumn(name, part_dir(schema)).drop(*lacking)


def write_options(schema: TableSchema, bloom: bool = True) -> dict[str, str]:
    out = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}
    if bloom and schema.bloom_columns:
        out["parquet.bloom.filter.adaptive.enabled"] = "true"
        out |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in schema.bloom_columns}
    return out


def part_id(directory) -> object:
    """A partition directory's stand-in in Spark's own directories, which would escape the real name."""
    return F.substring(F.sha2(directory, 256), 1, 24)


def stage(schema: TableSchema, df: DataFrame, directory: str, path: str, bloom: bool = True, max_rows: int = 0) -> None:
    """Writes df below path, one folder for each value of the column ``directory``, sorted by the key.

    The rebalance lets adaptive execution split a partition that holds a large share of
    the rows into several files, and join small ones.
    """
    tagged = df.withColumn(PART_ID, part_id(F.col(directory))).drop(directory)
    spread = tagged.hint("rebalance", PART_ID) if schema.rules else tagged.hint("rebalance")
    writer = spread.sortWithinPartitions(PART_ID, *[quoted(c) for c in schema.pk]).write.mode("error").partitionBy(PART_ID)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.options(**write_options(schema, bloom)).parquet(path)


def staged_files(fs: Storage, path: str) -> dict[str, list]:
    """Written objects by their part id."""
    out: dict[str, list] = {}
    for o in fs.list(path):
        folder, _, base = o.path.rpartition("/")
        if base.endswith(".parquet") and not base.startswith((".", "_")):
            out.setdefault(folder.rpartition("=")[2], []).append(o)
    return out


def estimate_bytes(row: dict) -> int:
    """About what a row takes: the bytes of its texts, 8 for any other value."""
    size = lambda v: len(v.encode()) if isinstance(v, str) else sum(map(size, v)) if isinstance(v, list) else 8
    return sum(size(v) for v in row.values())


@dataclass(frozen=True)
class ImportOptions:
    max_rows_per_file: int = MAX_ROWS_PER_FILE
    max_bytes_per_file: int = 0  # 0: no limit
    max_open_partitions: int = MAX_OPEN_PARTITIONS

    def __post_init__(self) -> None:
        for name, default in (("max_rows_per_file", MAX_ROWS_PER_FILE), ("max_open_partitions", MAX_OPEN_PARTITIONS)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)


class ImportWriter:
    """Streams records of one process into pending files with bounded memory. For one thread only.

    A partition is flushed when its rows or estimated bytes reach their limit; when one
    partition too many is open, the one with most rows is. After an error every call raises
    it again.
    """

    def __init__(self, schema: TableSchema, fs: Storage, directory: str, options: ImportOptions | None = None):
        self.schema, self.fs, self.directory = schema, fs, directory
        self.options = options or ImportOptions()
        self.files: list[str] = []
        self._rows: dict[str, list[dict]] = {}
        self._bytes: dict[str, int] = {}
        self._error: Exception | None = None
        self._closed = False

    def add(self, record) -> None:
        if self._error:
            raise self._error
        if self._closed:
            raise ValueError("the writer is closed")
        try:
            row = extract(self.schema, record)
            if row is None:
                return
            at = part_dir_of(self.schema, row)
            if at not in self._rows and len(self._rows) >= self.options.max_open_partitions:
                self._flush(max(self._rows, key=lambda d: len(self._rows[d])))
            self._rows.setdefault(at, []).append(row)
            self._bytes[at] = self._bytes.get(at, 0) + estimate_bytes(row)
            most = self.options.max_bytes_per_file
            if len(self._rows[at]) >= self.options.max_rows_per_file or (most and self._bytes[at] >= most):
                self._flush(at)
        except Exception as e:
            self._error = e
            raise

    def close(self) -> list[str]:
        """Flushes what is open; the paths of all files written."""
        if self._error:
            raise self._error
        if not self._closed:
            try:
                for at in sorted(self._rows):
                    self._flush(at)
            except Exception as e:
                self._error = e
                raise
            self._closed = True
        return self.files

    def __enter__(self) -> ImportWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    def _flush(self, at: str) -> None:
        rows = self._rows.pop(at, [])
        self._bytes.pop(at, None)
        if not rows:
            return
        texts = [c for c in self.schema.pk if self.schema[c].type == "string"]
        rows.sort(key=lambda r: tuple(r[c] for c in texts))
        path = "/".join(p for p in (self.directory, at, f"{uuid.uuid4()}.parquet") if p)
        write_rows(self.schema, rows, self.fs, path)
        self.files.append(path)


ARROW = {"string": pa.string(), "int64": pa.int64(), "list": pa.list_(pa.field("element", pa.string()))}


def write_rows(schema: TableSchema, rows: list[dict], fs: Storage, path: str) -> None:
    """One Parquet file of rows, written aside and then moved into place. Only Spark's writer adds Bloom filters."""
    arrow = pa.schema([pa.field(f.column, ARROW.get(f.type) or pa.from_numpy_dtype("float64")) for f in schema.fields])
    data = pa.table({f.column: pa.array([r.get(f.column) for r in rows], arrow.field(f.column).type) for f in schema.fields}, schema=arrow)
    fd, tmp = tempfile.mkstemp(suffix=".parquet.tmp")
    os.close(fd)
    try:
        pq.write_table(data, tmp, compression="zstd", compression_level=3)
        fs.upload(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def import_all(writer: ImportWriter, records: Iterable) -> list[str]:
    with writer:
        for r in records:
            writer.add(r)
    return writer.files
