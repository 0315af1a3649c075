"""Token ids in a content-addressed store.

A rolling hash over the last ids cuts every id stream into chunks, so equal passages give equal
chunks wherever they stand. A chunk is stored once, under its digest; a document is a recipe (the
digests and sizes in order) with the Merkle root of these and its length, and a manifest holds the count
of documents and tokens and the Merkle root of the recipes of every part, in their order. Files (Parquet
in the shared folder):

  chunks/    digest binary, n int, ids binary (little-endian, unsigned, `width` bytes an id)
  recipes/   doc_id, part, n_tokens, chunks array<binary>, sizes array<int>, root binary; doc_id ascends
             within a part and over parts
  manifest/  part, docs, tokens, root

Null or empty text: the end id alone. Rows of one doc_id stay separate recipes, ordered by root.
Extra columns are ignored; an empty table gives empty files and an empty result. Reading checks
every chunk against its digest and length, every recipe against its root, its sizes against its chunks, and
the recipes against the manifest, and raises on a difference: a changed, lost or added row is noticed.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .common import Workspace, parts, read
from .texts import arrow_batches, batch_of, column, release, slices

#: Ids the rolling hash sees, the mean and the largest chunk.
WINDOW, MEAN, LARGEST = 4, 256, 4096
END = 1


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def cut_places(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Chunk boundaries in concatenated streams; off (the streams' bounds) are among them. A cut is where
    the rolling hash of the last WINDOW ids begins with zeros, one place in MEAN."""
    key = _SPREAD * ids + (ids.astype(np.uint64) << np.uint64(17) ^ np.uint64(0x2545F4914F6CDD1D))
    h = key.copy()
    for k in range(1, min(WINDOW, len(ids))):
        key = key * _SPREAD
        h[k:] += key[:-k]
    h ^= h >> np.uint64(29)
    at = np.flatnonzero(h * _SPREAD >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + 1
    cuts = np.union1d(at[at < len(ids)], off)
    gaps = np.diff(cuts)
    if len(gaps) and gaps.max() > LARGEST:
        cuts = np.union1d(cuts, np.concatenate([np.arange(s, s + g, LARGEST) for s, g in zip(cuts[:-1][gaps > LARGEST], gaps[gaps > LARGEST], strict=True)]))
    return cuts


def _hash(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    """The root over leaves in their order. What is held is one node a level."""
    levels: list[bytes | None] = []
    for node in leaves:
        for k, other in enumerate(levels):
            if other is None:
                levels[k] = node
                break
            node, levels[k] = _hash(other + node), None
        else:
            levels.append(node)
    root = b""
    for node in levels:
        root = root if node is None else node if not root else _hash(node + root)
    return _hash(b"root" + root)


def recipe_root(digests: list[bytes], sizes: list[int]) -> bytes:
    return merkle([*(d + n.to_bytes(4, "little") for d, n in zip(digests, sizes, strict=True)), sum(sizes).to_bytes(8, "little")])


#: Digests that a task remembers, so that it gives out the ids of a chunk once.
SEEN = 400_000


def chunked(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, chunks array<struct<digest, n, ids>>, root); ids are null where the task gave them
    out before."""

    def run(batches):
        enc, seen = encoder(path), set()
        end = np.array([END], enc.kind).tobytes()
        for batch in batches:
            data, off, _ = column(batch, "text")
            for lo, hi in slices(off):
                o = off[lo : hi + 1]
                raw = [x + end for x in enc.encode(data[o[0] : o[-1]], o - o[0])]
                flat = b"".join(raw)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]) // enc.kind.itemsize
                cuts = cut_places(np.frombuffer(flat, enc.kind), bounds)
                places, sizes = (cuts * enc.kind.itemsize).tolist(), np.diff(cuts).tolist()
                ids, names = [], []
                if len(seen) > SEEN:
                    seen.clear()
                for a, b in zip(places, places[1:], strict=False):
                    x = flat[a:b]
                    name = _hash(x)
                    names.append(name)
                    ids.append(None if name in seen else x)
                    seen.add(name)
                doc_at = np.searchsorted(cuts, bounds)
                roots = [recipe_root(names[a:b], sizes[a:b]) for a, b in zip(doc_at.tolist(), doc_at[1:].tolist(), strict=False)]
                items = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], ["digest", "n", "ids"])
                yield batch_of(doc_id=batch.column(0)[lo:hi].cast(pa.int64()), n_tokens=pa.array(np.diff(bounds).astype(np.int64)), chunks=pa.ListArray.from_arrays(pa.array(doc_at.astype(np.int32)), items), root=pa.array(roots, pa.binary()))
        release()

    arrow_batches(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, chunks array<struct<digest:binary,n:int,ids:binary>>, root binary")


def write_store(ws: Workspace, df: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the three tables; returns them as read back."""
    n = parts(df.sparkSession)
    encoded = ws.table(chunked(df, path), "encoded")
    # a chunk comes at most once or so from a task, however many documents hold it
    rows = encoded.select(F.explode("chunks").alias("c")).where("c.ids IS NOT NULL").select("c.digest", "c.n", "c.ids")
    chunks = ws.table(rows.repartition(n, "digest").dropDuplicates(["digest"]), "chunks")
    recipes = encoded.select("doc_id", "n_tokens", F.col("chunks.digest").alias("chunks"), F.col("chunks.n").alias("sizes"), "root")
    recipes = recipes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    recipes = ws.table(recipes, "recipes")
    ws.drop("encoded")
    return chunks, recipes, ws.table(manifest_of(recipes), "manifest")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(part, docs, tokens, root): the root over the roots of a part's recipes in their order."""

    def run(batches):
        out, now, docs, tokens = [], None, 0, 0

        def roots():
            """Those of one part; leaves the next part's first row in `ahead`."""
            nonlocal docs, tokens
            while ahead and ahead[0][0] == now:
                _, n, root = ahead.pop()
                docs, tokens = docs + 1, tokens + n
                yield root
                ahead.extend(itertools.islice(rows, 1))

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = list(itertools.islice(rows, 1))
        while ahead:
            now, docs, tokens = ahead[0][0], 0, 0
            root = merkle(roots())
            out.append((now, docs, tokens, root))
        p, d, t, r = zip(*out, strict=True) if out else ((), (), (), ())
        yield batch_of(part=pa.array(p, pa.int32()), docs=pa.array(d, pa.int64()), tokens=pa.array(t, pa.int64()), root=pa.array(r, pa.binary()))

    rows = recipes.select("part", "doc_id", "root", "n_tokens").repartition(parts(recipes.sparkSession), "part").sortWithinPartitions("part", "doc_id", "root")
    return rows.select("part", "n_tokens", "root").mapInArrow(run, "part int, docs long, tokens long, root binary")


def checked_parts(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(part, tokens) of the recipes; a difference from the manifest raises."""
    now = manifest_of(recipes).select("part", F.struct("docs", "tokens", "root").alias("now"))
    was = manifest.select("part", F.struct("docs", "tokens", "root").alias("was"))
    same = F.expr("CASE WHEN now <=> was THEN now.tokens ELSE CAST(raise_error('the recipes differ from the manifest') AS LONG) END")
    return now.join(was, "part", "full").select("part", same.alias("tokens"))


# ---- crc32 of joined streams ------------------------------------------------------------------

_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the crc32 polynomial, bits reflected."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds to the whole's if `after` bytes follow it."""
    out, power, after = crc.astype(np.uint32), np.full(1, 1 << 23, np.uint32), after.astype(np.uint64)  # x^8
    while (after > 0).any():
        odd = (after & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()))
        power, after = _times(power, power), after >> np.uint64(1)
    return out


def chunk_crcs(chunks: DataFrame, width: int) -> DataFrame:
    """(digest, length, crc) of the stored chunks, as unsigned 32-bit ids; a wrong digest or length raises."""
    kind = f"<u{width}"

    def run(batches):
        for batch in batches:
            names, sizes, ids = (c.to_pylist() for c in batch.columns)
            if any(_hash(x) != d or len(x) != n * width for d, n, x in zip(names, sizes, ids, strict=True)):
                raise ValueError("a chunk differs from its digest or length")
            flat = memoryview(np.frombuffer(b"".join(ids), kind).astype("<u4")).cast("B")
            at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * 4
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield batch_of(digest=batch.column(0), length=batch.column(1), crc=pa.array(crcs, pa.int64()))

    return chunks.select("digest", "n", "ids").mapInArrow(run, "digest binary, length int, crc long")


def verify(chunks: DataFrame, recipes: DataFrame, manifest: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. A chunk's crc32 and the bytes after it give
    the whole's, so the ids themselves are read where they lie and not shuffled again."""

    def spread(batches):
        for batch in batches:
            names, sizes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            if any(recipe_root(d, n) != r for d, n, r in zip(names, sizes, batch.column(5).to_pylist(), strict=True)):
                raise ValueError("a recipe differs from its root")
            counts = np.array([len(x) for x in names], np.int64)
            row = np.repeat(np.arange(len(names)), counts)
            size = np.array([s for x in sizes for s in x], np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            ends = total[np.cumsum(counts)]
            if (np.diff(np.concatenate([[0], ends])) != batch.column(2).to_numpy()).any():
                raise ValueError("a recipe differs from its length")
            take = lambda k: batch.column(k).take(pa.array(row))
            yield batch_of(doc_id=take(0), start=take(1), n_tokens=take(2), digest=pa.array([d for x in names for d in x], pa.binary()), size=pa.array(size.astype(np.int32)), after=pa.array(ends[row] - total[1:]))

    def term(batches):
        for batch in batches:
            after, crc = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            yield batch_of(doc_id=batch.column(0), start=batch.column(1), n_tokens=batch.column(2), term=pa.array(shift_crc(crc.astype(np.uint32), after * 4).astype(np.int64)))

    per_part = checked_parts(recipes, manifest)  # a row for each part
    before = per_part.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("base"))
    inner = F.sum("n_tokens").over(W.partitionBy("part").orderBy("doc_id", "root").rowsBetween(W.unboundedPreceding, -1))
    placed = recipes.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "part")
    start = (F.col("base") + F.col("inner")).alias("start")  # no recipe is empty, so starts tell them apart
    rows = placed.select("doc_id", start, "n_tokens", "chunks", "sizes", "root").mapInArrow(spread, "doc_id long, start long, n_tokens long, digest binary, size int, after long")
    crc = F.expr("CASE WHEN length IS NULL THEN CAST(raise_error('a chunk is missing') AS LONG) WHEN length <> size THEN CAST(raise_error('a recipe differs from its chunks') AS LONG) ELSE crc END")
    joined = rows.join(chunk_crcs(chunks, width), "digest", "left").select("doc_id", "start", "n_tokens", "after", crc.alias("crc"))
    terms = joined.mapInArrow(term, "doc_id long, start long, n_tokens long, term long")
    return terms.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("term").alias("ids_crc32"))


def restore(chunks: DataFrame, recipes: DataFrame, width: int) -> DataFrame:
    """(doc_id, part, root, ids array<int>): the documents rebuilt from the files."""
    kind = f"<u{width}"

    @F.pandas_udf("array<int>")
    def joined(streams):
        return streams.map(lambda xs: np.frombuffer(b"".join(bytes(x) for x in xs), kind).astype(np.int32))

    # a recipe is numbered before it is spread out
    rows = recipes.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "part", "root", "row", F.posexplode("chunks").alias("k", "digest"))
    whole = rows.join(chunks.select("digest", "ids"), "digest").groupBy("row", "doc_id", "part", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("streams"))
    return whole.select("doc_id", "part", "root", joined("streams").alias("ids"))


def op7_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    ws = Workspace(spark, "store")
    chunks, recipes, manifest = write_store(ws, read(spark, sf_dir, "documents"), path)
    return verify(chunks, recipes, manifest, encoder(path).kind.itemsize)


QUERIES = {"op7_store": op7_store}
