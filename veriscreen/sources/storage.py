"""Small files and folders in any file system that Spark reaches: paths with a scheme, or in the cluster's default file system."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

COPY = 1 << 20  # bytes that are copied at once


def _at(path: str):
    """The path and its file system, in the session's JVM."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(path: str) -> str:
    """The path with its scheme, links of local ones followed: equal for two names of a file."""
    where, files = _at(path)
    full = files.makeQualified(where).toString()
    return "file:" + os.path.realpath(full.removeprefix("file:")) if full.startswith("file:") else full


def exists(path: str) -> bool:
    where, files = _at(path)
    return files.exists(where)


def names(path: str) -> list[str]:
    """Names in a folder, sorted; checksums of local file systems left out."""
    where, files = _at(path)
    return sorted(n for n in (x.getPath().getName() for x in files.listStatus(where)) if not n.endswith(".crc"))


def new_dir(path: str) -> str:
    """An empty folder at path, made if need be; FileExistsError if it holds anything."""
    where, files = _at(path)
    files.mkdirs(where)
    if names(path):
        raise FileExistsError(f"output directory is not empty: {path}")
    return os.path.expanduser(path).rstrip("/") or "/"


@contextlib.contextmanager
def _created(path: str) -> Iterator:
    """A stream into a new file, which appears under its name when all of it is written."""
    where, shared = _at(path)
    files = shared.newInstance(shared.getUri(), shared.getConf())  # what is set here is no one else's
    try:
        files.setWriteChecksum(False)
        if files.exists(where):
            raise FileExistsError(path)
        part = where.suffix(".part")
        out = files.create(part, True)
        try:
            yield files, out
        except BaseException:
            out.close()
            files.delete(part, False)
            raise
        out.close()
        if files.exists(where) or not files.rename(part, where):
            files.delete(part, False)
            raise FileExistsError(path)
    finally:
        files.close()


def write(path: str, content: bytes) -> None:
    """A new file; FileExistsError if there is one."""
    with _created(path) as (_, out):
        out.write(bytearray(content))


def read(path: str) -> bytes:
    """A small file."""
    where, files = _at(path)
    if not files.exists(where):
        raise FileNotFoundError(path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def stitch(path: str, parts: list[bytes], folders: list[str], skip: int = 0) -> None:
    """A new file of the first part, the files of the first folder in the order of their names, the second part, and so on. The first `skip` bytes of a folder's
    first file that has any are left out. Contents are copied a megabyte at a time, within the JVM."""
    spark = SparkSession.getActiveSession()
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    with _created(path) as (_, out):
        out.write(bytearray(parts[0]))
        for folder, after in zip(folders, parts[1:]):
            left = skip
            for name in names(folder):
                where, source = _at(f"{folder}/{name}")
                if name.startswith(("_", ".")) or not source.getFileStatus(where).getLen():
                    continue
                stream = source.open(where)
                try:
                    stream.seek(left)
                    left = 0
                    copy(stream, out, COPY, False)
                finally:
                    stream.close()
            out.write(bytearray(after))


def copy(source: str, target: str) -> None:
    """A new file with the contents of another."""
    where, files = _at(source)
    duplicate = SparkSession.getActiveSession().sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    with _created(target) as (_, out):
        stream = files.open(where)
        try:
            duplicate(stream, out, COPY, False)
        finally:
            stream.close()


def missing(paths: Iterable[str]) -> list[str]:
    """Of these paths those at which there is nothing; patterns are not looked at."""
    return [p for p in paths if not any(c in p for c in "*?[{") and not exists(p)]
