"""What the operators share: a table folder all machines see, keys, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_OPEN: list[Workspace] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all is one machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
    return _OWN[app]


class Workspace:
    """Tables of one run in the shared folder. They cut lineage: a lost executor costs the tasks
    since the last table only. `drop` frees a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count, self._names = 0, set()
        _OPEN.append(self)

    def next(self) -> int:
        """Numbers for table names."""
        self._count += 1
        return self._count

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with shuffle_cleanup(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        self._names.add(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self._names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self._names - set(names)))

    def close(self) -> None:
        """Deletes every table. A result that still reads them must be stored before."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Workspaces opened inside are deleted at the end."""
    mark = len(_OPEN)
    try:
        yield
    finally:
        for ws in _OPEN[mark:]:
            ws.close()
        del _OPEN[mark:]


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """While a table is written: its query's shuffle files go as soon as the query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """While a table is written: rows that a Bloom filter of a shuffled join's other side (one that is a table under
    a condition) leaves out aren't shuffled. The join decides on the rest, so the result is exact at any size."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    put = {"enabled": "true", "applicationSideScanSizeThreshold": "1m", "creationSideThreshold": "8g", "expectedNumItems": "4000000"}
    before = {k: spark.conf.get(prefix + k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v) if v is not None else spark.conf.unset(prefix + k)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(row long, doc struct of all columns), written once: a number that holds for all later steps."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return ws.table(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), "rows")


def fields(doc: str, names: list[str]) -> list[Column]:
    """The columns of a struct, each under its own name whatever it is."""
    return [F.col(doc).getField(c).alias(c) for c in names]


# ---- joins with hot keys ----------------------------------------------------------------------

#: Rows that a key may bring to one task whatever the table's size, and the keys over their share, at most.
KEY_ROWS, HOT_KEYS = 1000, 2000


def split_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", count: str = "n") -> DataFrame:
    """rows joined with keys (one row a key; `count`: how many of rows it has). Keys with more than KEY_ROWS
    and 1 / HOT_KEYS of the rows can't be over HOT_KEYS: these are broadcast and their rows stay where
    they are; all others are joined by a shuffle. rows and keys should be tables, as they are read twice."""
    total, most = keys.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(KEY_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.join(keys, on, how)
    hot, cold = keys.where(F.col(count) > limit), keys.where(F.col(count) <= limit)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on, how).unionByName(rest.join(cold, on, how))


# ---- 64-bit keys in numpy -------------------------------------------------------------------

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain): a bijection that spreads every bit."""
    z = z + _A
    z = (z ^ (z >> np.uint64(30))) * _B
    z = (z ^ (z >> np.uint64(27))) * _C
    return z ^ (z >> np.uint64(31))


# ---- connected components -------------------------------------------------------------------


def components(ws: Workspace, edges: DataFrame, tag: str, max_rounds: int = 40) -> DataFrame:
    """(a long, b long) edges -> (id long, component long): the smallest id reachable, for every id
    of an edge. Alternates large-star and small-star steps (Kiveris et al. 2014) until the edge set
    stands still; every step is a table, so nothing is collected and lineage stays short.
    Self-loops and repeated edges are ignored; no edges give no rows. Rounds grow with the logarithm of a
    component's size; should max_rounds not do, it raises and no result is returned."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = ws.table(now, f"{tag}-0"), None
    for k in range(1, max_rounds):
        # large star: every larger neighbour of v is linked with the least neighbour of v
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("m", "a").alias("m"), "n")
        hubs = (least.agg(F.max("n")).first()[0] or 0) > KEY_ROWS  # then joins are split, and their sides tables
        least = ws.table(least, f"{tag}-l{k}") if hubs else least
        large = (split_join(both, least, ["a"]) if hubs else both.join(least, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.table(large, f"{tag}-m{k}") if hubs else large
        # small star: v and its smaller neighbours are linked with the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = ws.table(least, f"{tag}-s{k}") if hubs else least
        small = split_join(large, least, ["a"]) if hubs else large.join(least, "a")
        now = ws.table(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), f"{tag}-{k}")
        ws.drop(f"{tag}-{k - 1}", f"{tag}-l{k}", f"{tag}-m{k}", f"{tag}-s{k}")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components: no fixed point")
    # a fixed point is a set of stars around each least id
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
