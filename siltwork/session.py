"""Session helpers: shared folder, lineage cuts and the local test session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SILTWORK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one.

    Only where neither the session nor the context has one is a temporary folder of
    this machine set, which is right for local mode alone.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return named or held.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siltwork-checkpoint-")
    sc.setCheckpointDir(named)
    return named


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table in the shared folder, and read again.

    Compressed columns take a fraction of what a checkpoint of rows does. The table is
    there for every executor, whichever are lost. It stays until ``release`` or the end of
    the driver, as frames made from it may be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._silt_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the tables of frames that ``cut`` gave; nothing may read them any more."""
    gone = {getattr(f, "_silt_path", None) for f in frames}
    for spark, path in [x for x in _written if x[1] in gone]:
        remove(spark, path)
        _written.remove((spark, path))


def by_merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges, at whatever size Spark takes df to have.

    Spark would broadcast a table of ``cut`` by the size of its files, and the driver hold
    it whole: compressed columns of a few MB are hundreds of MB as a hash table of rows.
    """
    return df.hint("merge")


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends: frames read from it may be used until then."""
    _written.append((spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system, with all in it; a missing one is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _release_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: only a local folder can still be removed
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
