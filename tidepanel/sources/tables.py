"""Intermediate tables that later steps read more than once, addressed by what they are made of.

A table's name is a hash of its plan and of the files the plan reads (name, size, time of change); for a `derived`
one of a step's name and arguments instead of the plan, which then isn't made again. Asking for the same content
again, in the same query or another of the session, gives the table that is there. Each `lease`
counts the tables asked for inside it; a table that no open lease holds any more is deleted. Outside of leases
tables stay until `clear` or, in a folder of our own, the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
#: (application, name) -> (path, schema), and how many open leases hold it.
_TABLES: dict[tuple[str, str], tuple[str, StructType]] = {}
_HELD: Counter = Counter()
_LEASES: list[set] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="tidepanel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> Iterator[tuple[str, str]]:
    """(path, size and time of change) of a file, or of all files of a folder and those in it."""
    at, fs = _filesystem(spark, folder)
    for s in fs.listStatus(at):
        path = s.getPath().toString()
        if s.isDirectory():
            yield from _listed(spark, path)
        else:
            yield path, f"{s.getLen()} {s.getModificationTime()}"


def files_of(df: DataFrame) -> list[str]:
    """What df reads, one line a file with its size and time of change; a folder is listed once."""
    files, seen = df.inputFiles(), {}
    for parent in {f.rpartition("/")[0] for f in files}:
        at, fs = _filesystem(df.sparkSession, parent)
        for s in fs.listStatus(at):
            seen[s.getPath().toUri().getRawPath()] = f"{s.getLen()} {s.getModificationTime()}"
    return sorted(f"{f} {seen.get(urlsplit(f).path, '')}" for f in files)


def content(df: DataFrame) -> str:
    """A name for what df holds: equal plans over equal files have equal names. The plan's hash covers what its
    text doesn't say (literal rows, functions), the text what the hash may confuse."""
    spark, key = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 20))
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.set(key, before)
    said = [plan, str(df.semanticHash()), df.schema.json(), spark.conf.get("spark.sql.session.timeZone"), *files_of(df)]
    return hashlib.sha256("\0".join(said).encode()).hexdigest()


def _table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, name)
    if key not in _TABLES:
        df, path = build(), f"{shared_dir(spark)}/tables-{key[0]}/{name}"
        df.write.mode("overwrite").parquet(path)  # what a failed attempt left goes
        _TABLES[key] = (path, df.schema)
    if _LEASES and key not in _LEASES[-1]:
        _LEASES[-1].add(key)
        _HELD[key] += 1
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what it is made of is scanned once however often it is used, and a lost
    executor costs no more than the tasks since."""
    return _table(df.sparkSession, content(df), lambda: df)


def derived(spark: SparkSession, step: str, sources: list[str], args: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() makes of the files under `sources` by a step that its name and arguments describe, stored."""
    said = [step, repr(args), spark.conf.get("spark.sql.session.timeZone")]
    for source in sources:
        said += [source, *(f"{path} {state}" for path, state in sorted(_listed(spark, source)))]
    return _table(spark, hashlib.sha256("\0".join(said).encode()).hexdigest(), build)


def _delete(spark: SparkSession, key: tuple[str, str]) -> None:
    at, fs = _filesystem(spark, _TABLES.pop(key)[0])
    fs.delete(at, True)


@contextlib.contextmanager
def lease(spark: SparkSession) -> Iterator[None]:
    """Tables asked for inside live at least as long as the block; what reads them must be done by its end."""
    _LEASES.append(set())
    try:
        yield
    finally:
        for key in _LEASES.pop():
            _HELD[key] -= 1
            if not _HELD[key]:
                del _HELD[key]
                if key in _TABLES:
                    _delete(spark, key)


def clear(spark: SparkSession) -> int:
    """Deletes the session's tables that no open lease holds; how many."""
    app = spark.sparkContext.applicationId
    gone = [k for k in _TABLES if k[0] == app and not _HELD[k]]
    for key in gone:
        _delete(spark, key)
    return len(gone)
