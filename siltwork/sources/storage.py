"""Where tables live: the storage contract and its backends.

``LocalStorage`` for a folder, ``HadoopStorage`` for any Hadoop file system (s3a, oss,
hdfs, ...), ``MemoryStorage`` as a stand-in for a remote store in tests. Paths are as the
engine names them, under its root; ``KeyMap`` maps them to keys of an object store.
"""

from __future__ import annotations

import errno
import json
import os
import posixpath
import shutil
import tempfile
import threading
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Object:
    path: str
    size: int
    modified: float = 0.0


class NotFound(FileNotFoundError):
    """There is nothing at the path."""


class Storage(Protocol):
    """What the engine asks of a store."""

    def list(self, prefix: str) -> list[Object]:
        """All files below prefix, at any depth, sorted; none if there is no such prefix."""

    def read_json(self, path: str) -> dict: ...

    def write_json(self, path: str, value: dict) -> None:
        """All of it or nothing: a reader sees the old or the new content."""

    def upload(self, local: str, path: str) -> None:
        """Publishes a staged file and removes it."""

    def download(self, path: str, local: str) -> None: ...

    def delete(self, path: str) -> None:
        """A missing file is no error."""

    def uri(self, path: str) -> str | None:
        """What Spark reads the path by; None if it must be downloaded first."""


def sync_dir(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def _tried(write: Callable[[], None]) -> None:
    for left in reversed(range(TRIES)):
        try:
            return write()
        except FileNotFoundError:
            if not left:
                raise


def make_dirs(path: str) -> None:
    """Makes a folder and its parents, and makes their entries durable, topmost first."""
    missing = []
    while path and not os.path.isdir(path):
        missing.append(path)
        path = os.path.dirname(path)
    for p in reversed(missing):
        os.makedirs(p, exist_ok=True)
        sync_dir(os.path.dirname(p))


TRIES = 3


class LocalStorage:
    """A folder of this machine or a shared mount.

    Writes are tried again if a cleaner takes an empty folder away between its making and its use.
    """

    def list(self, prefix: str) -> list[Object]:
        out = []
        for at, _, names in os.walk(prefix):
            for n in names:
                p = os.path.join(at, n)
                try:
                    st = os.stat(p)
                except FileNotFoundError:
                    continue
                out.append(Object(p, st.st_size, st.st_mtime))
        return sorted(out, key=lambda o: o.path)

    def read_json(self, path: str) -> dict:
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError as e:
            raise NotFound(path) from e

    def write_json(self, path: str, value: dict) -> None:
        _tried(lambda: self._write_json(path, value))

    def _write_json(self, path: str, value: dict) -> None:
        folder = os.path.dirname(path)
        make_dirs(folder)
        fd, tmp = tempfile.mkstemp(prefix="." + os.path.basename(path), suffix=".tmp", dir=folder)
        try:
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                json.dump(value, f, ensure_ascii=False)
                f.flush()
                os.fsync(f.fileno())
            os.replace(tmp, path)
        except BaseException:
            Path(tmp).unlink(missing_ok=True)
            raise
        sync_dir(folder)

    def upload(self, local: str, path: str) -> None:
        with open(local, "rb") as f:
            os.fsync(f.fileno())
        _tried(lambda: self._move(local, path))

    def _move(self, local: str, path: str) -> None:
        make_dirs(os.path.dirname(path))
        try:
            os.replace(local, path)
        except OSError as e:
            if e.errno != errno.EXDEV:
                raise
            tmp = f"{path}.tmp"
            shutil.copyfile(local, tmp)
            os.replace(tmp, path)
            os.unlink(local)
        sync_dir(os.path.dirname(path))

    def download(self, path: str, local: str) -> None:
        try:
            shutil.copyfile(path, local)
        except FileNotFoundError as e:
            raise NotFound(path) from e

    def delete(self, path: str) -> None:
        Path(path).unlink(missing_ok=True)

    def uri(self, path: str) -> str | None:
        return os.path.abspath(path)


class MemoryStorage:
    """A store in memory, to be handled as a remote one."""

    def __init__(self) -> None:
        self.files: dict[str, bytes] = {}
        self.calls: dict[str, int] = {}
        self._lock = threading.Lock()

    def _count(self, name: str) -> None:
        with self._lock:
            self.calls[name] = self.calls.get(name, 0) + 1

    def list(self, prefix: str) -> list[Object]:
        self._count("list")
        head = prefix.rstrip("/") + "/"
        with self._lock:
            return sorted((Object(p, len(b)) for p, b in self.files.items() if p.startswith(head)), key=lambda o: o.path)

    def read_json(self, path: str) -> dict:
        self._count("read_json")
        if path not in self.files:
            raise NotFound(path)
        return json.loads(self.files[path])

    def write_json(self, path: str, value: dict) -> None:
        self._count("write_json")
        self.files[path] = json.dumps(value, ensure_ascii=False).encode()

    def upload(self, local: str, path: str) -> None:
        self._count("upload")
        self.files[path] = Path(local).read_bytes()
        os.unlink(local)

    def download(self, path: str, local: str) -> None:
        self._count("download")
        if path not in self.files:
            raise NotFound(path)
        Path(local).write_bytes(self.files[path])

    def delete(self, path: str) -> None:
        self._count("delete")
        self.files.pop(path, None)

    def uri(self, path: str) -> str | None:
        return None


class HadoopStorage:
    """Any file system that Spark's Hadoop configuration knows, by URIs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self, prefix: str) -> list[Object]:
        where, fs = self._at(prefix)
        if not fs.exists(where):
            return []
        out, found = [], fs.listFiles(where, True)
        base = where.toUri().getPath().rstrip("/")
        while found.hasNext():
            st = found.next()
            inner = st.getPath().toUri().getPath().removeprefix(base)
            out.append(Object(prefix.rstrip("/") + inner, st.getLen(), st.getModificationTime() / 1000))
        return sorted(out, key=lambda o: o.path)

    def read_json(self, path: str) -> dict:
        where, fs = self._at(path)
        if not fs.exists(where):
            raise NotFound(path)
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value: dict) -> None:
        """Object stores put whole objects; other file systems get a temporary file and a rename."""
        where, fs = self._at(path)
        tmp, _ = self._at(f"{path}.{os.urandom(4).hex()}.tmp")
        fs.mkdirs(where.getParent())
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        stream.close()
        if fs.exists(where):
            modern = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            modern.rename(modern.makeQualified(tmp), modern.makeQualified(where), options)
        elif not fs.rename(tmp, where):
            raise OSError(f"can't rename to {path}")

    def upload(self, local: str, path: str) -> None:
        """local may be a file of this machine, or one staged in the same file system."""
        where, fs = self._at(path)
        fs.mkdirs(where.getParent())
        source, theirs = self._at(local)
        if theirs.equals(fs) or theirs.getUri().equals(fs.getUri()):
            if not fs.rename(source, where):
                raise OSError(f"can't publish {path}")
        else:
            fs.copyFromLocalFile(True, True, source, where)

    def copy_in(self, local: str, path: str) -> None:
        """Copies a file of this machine to path."""
        where, fs = self._at(path)
        fs.mkdirs(where.getParent())
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), where)

    def download(self, path: str, local: str) -> None:
        where, fs = self._at(path)
        if not fs.exists(where):
            raise NotFound(path)
        fs.copyToLocalFile(False, where, self._at(local)[0], True)

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, False)

    def uri(self, path: str) -> str | None:
        return path


class KeyMap:
    """Paths below a local root to keys below a prefix of a bucket, and back."""

    def __init__(self, bucket: str, root: str, prefix: str = ""):
        if not bucket:
            raise ValueError("a bucket is required")
        if not root:
            raise ValueError("a local root is required")
        self.bucket, self.root, self.prefix = bucket, posixpath.normpath(root), prefix.strip("/")

    def key(self, path: str) -> str:
        inner = posixpath.relpath(posixpath.normpath(path), self.root)
        if inner == ".." or inner.startswith("../"):
            raise ValueError(f"{path} lies outside {self.root}")
        return "/".join(p for p in (self.prefix, "" if inner == "." else inner) if p)

    def path(self, key: str) -> str:
        inner = key
        if self.prefix and (key == self.prefix or key.startswith(self.prefix + "/")):
            inner = key[len(self.prefix) :].lstrip("/")
        return posixpath.join(self.root, inner) if inner else self.root


class BucketStorage(HadoopStorage):
    """A bucket behind a Hadoop connector: the engine's paths are mapped to keys by a KeyMap."""

    def __init__(self, spark: SparkSession, keys: KeyMap, scheme: str = "s3a"):
        super().__init__(spark)
        self.keys, self.scheme = keys, scheme

    def _at(self, path: str):
        inside = path == self.keys.root or path.startswith(self.keys.root + "/")
        return super()._at(self.uri(path) if inside and "/.staging/" not in path else path)

    def list(self, prefix: str) -> list[Object]:
        return [o for o in super().list(prefix) if not o.path.endswith("/")]

    def uri(self, path: str) -> str:
        return f"{self.scheme}://{self.keys.bucket}/{self.keys.key(path)}"
