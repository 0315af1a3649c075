"""Importance resampling towards a target distribution.

Features are hashed words and word pairs. The document-by-bucket counts are kept as a table of CSR blocks: each
row holds some documents' ids, word and feature counts, row bounds, bucket numbers and counts. Column sums of the
blocks, and of the target's, are the two distributions; their log ratio is a gain for each bucket; the product
of the blocks with the gains is every document's weight. Documents are drawn without repetition by Gumbel noise
on the weight, and ranked by ranges of the whole order.

Hashes are never made feature by feature: each different word of a slice is hashed once, and a pair's crc32 is
put together from its words'. Texts over SLICE_BYTES are counted in pieces, into one row.

Null or empty text: no features, weight 0. A null id has the noise of an empty one and comes first among equals.
Repeated rows have rows of their own in the result, ranked one after the other; equal rows are alike. Extra
columns are ignored. An empty target has no counts (t = T = 0); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import global_number
from .common import Workspace, read
from .texts import LOWER, SLICE_BYTES, arrow_batches, batch_of, codes, map_texts

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Entries after which a block is closed. A document has at most one entry a bucket, so a block has less than
#: this and the buckets together.
BLOCK = 4096
#: Words up to this many bytes have a table for the advance of a crc32 over them.
_KNOWN = 64


@dataclass(frozen=True)
class Draw:
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


# ---- crc32 of word pairs ------------------------------------------------------------------------


def _advances() -> np.ndarray:
    """[n, 4, 256]: the crc32 (without its masks) of 4 bytes' state after n further zero bytes, byte by byte of the state."""
    step = np.array([_reflected(i) for i in range(256)], np.uint32)
    out = np.zeros((_KNOWN + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


def _reflected(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_TABLE: list[np.ndarray] = []


def pair_hashes(first: np.ndarray, rest: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of a + b from crc32(a), crc32(b) and the length of b (at most _KNOWN + 1)."""
    if not _TABLE:
        _TABLE.append(_advances())
    t, c = _TABLE[0], first
    return t[size, 0, c & 255] ^ t[size, 1, c >> 8 & 255] ^ t[size, 2, c >> 16 & 255] ^ t[size, 3, c >> 24] ^ rest


# ---- features -------------------------------------------------------------------------------------


def words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of word bytes; none crosses texts."""
    solid = WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = solid[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, "right") - 1


def features(low: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and bucket of every feature, words of each text)."""
    start, end, text = words(low, off)
    n = np.bincount(text, minlength=len(off) - 1)
    if not len(start):
        return text, start, n
    which, names = codes(low[WORD[low]], end - start)
    names = names.to_pylist()
    own = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in names), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names)) + 1
    i = np.flatnonzero(text[1:] == text[:-1])
    a, b = which[i], which[i + 1]
    short = size[b] <= _KNOWN + 1
    pairs = np.empty(len(i), np.uint32)
    pairs[short] = pair_hashes(own[a[short]], spaced[b[short]], size[b[short]])
    for k in np.flatnonzero(~short).tolist():
        pairs[k] = zlib.crc32(b" " + names[b[k]], int(own[a[k]]))
    return np.concatenate([text, text[i]]), np.concatenate([own[which], pairs]) % np.uint32(buckets), n


def long_counts(low: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """(features of each bucket, words) of one text, in pieces that end with a word or between words; the pair
    of a piece's first word with the one before it is counted on its own."""
    total, n_words, lo, last = np.zeros(buckets, np.int64), 0, 0, None
    while lo < len(low):
        hi = min(len(low), lo + SLICE_BYTES)
        while hi < len(low) and WORD[low[hi - 1]] and WORD[low[hi]]:
            rest = np.flatnonzero(~WORD[low[hi : hi + SLICE_BYTES]])
            hi = hi + int(rest[0]) if len(rest) else min(len(low), hi + SLICE_BYTES)
        piece = low[lo:hi]
        bounds = np.array([0, len(piece)])
        total += np.bincount(features(piece, bounds, buckets)[1], minlength=buckets)
        start, end, _ = words(piece, bounds)
        if len(start):
            if last is not None:
                total[zlib.crc32(b" " + piece[start[0] : end[0]].tobytes(), zlib.crc32(last)) % buckets] += 1
            last = piece[start[-1] : end[-1]].tobytes()
        n_words, lo = n_words + len(start), hi
    return total, n_words


def blocks(df: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CSR blocks of the counts: ids array<long>, n_words array<long>, bounds array<int>, columns binary (16-bit
    unsigned, falling nowhere within a document), counts binary (32-bit unsigned)."""

    def work(keys, data, off, null):
        low = LOWER[data]
        if len(off) == 2 and len(data) > SLICE_BYTES:
            total, n = long_counts(low, buckets)
            column = np.flatnonzero(total)
            doc, count, n_words = np.zeros(len(column), np.int64), total[column], np.array([n])
        else:
            doc, bucket, n_words = features(low, off, buckets)
            cell, count = np.unique(doc * buckets + bucket, return_counts=True)
            doc, column = np.divmod(cell, buckets)
        bounds = np.searchsorted(doc, np.arange(len(off)))
        lo = 0
        while lo < len(keys):
            hi = min(len(keys), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1))
            a, b = bounds[lo], bounds[hi]
            yield batch_of(
                ids=pa.array([keys[lo:hi].to_pylist()], pa.list_(pa.int64())), n_words=pa.array([n_words[lo:hi]], pa.list_(pa.int64())), bounds=pa.array([bounds[lo : hi + 1] - a], pa.list_(pa.int32())),
                columns=pa.array([column[a:b].astype("<u2").tobytes()], pa.binary()), counts=pa.array([count[a:b].astype("<u4").tobytes()], pa.binary()),
            )
            lo = hi

    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65536")
    return map_texts(df, "ids array<long>, n_words array<long>, bounds array<int>, columns binary, counts binary", work, (key, text))


def _rows(batches, *names):
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names), strict=True):
            yield row


def column_sums(matrix: DataFrame, buckets: int) -> list[int]:
    """Features of each bucket over all blocks."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for columns, counts in _rows(batches, "columns", "counts"):
            total += np.bincount(np.frombuffer(columns.as_py(), "<u2"), np.frombuffer(counts.as_py(), "<u4"), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield batch_of(bucket=at, n=total[at])

    sums = matrix.select("columns", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed distributions."""
    k, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def noise(seed: int, name: str) -> int:
    """Thousandths of a Gumbel draw that depends on the seed and the name alone."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(matrix: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def run(batches):
        for ids, n_words, bounds, columns, counts in _rows(batches, "ids", "n_words", "bounds", "columns", "counts"):
            count = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
            cut = np.array(bounds.as_py())
            upto = np.concatenate([[0], np.cumsum(gain[np.frombuffer(columns.as_py(), "<u2")] * count)])
            n = np.diff(np.concatenate([[0], np.cumsum(count)])[cut])
            weight = np.where(n > 0, np.diff(upto[cut]) // np.maximum(n, 1), 0)
            names = ids.as_py()
            drawn = np.array([noise(seed, "" if i is None else str(i)) for i in names], np.int64)
            yield batch_of(doc_id=pa.array(names, pa.int64()), n_words=np.array(n_words.as_py(), np.int64), n_features=n, weight=weight, score=weight + drawn)

    arrow_batches(matrix.sparkSession)
    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(ws: Workspace, docs: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", target_key: str = "item_id") -> DataFrame:  # noqa: B008
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null if it isn't drawn."""
    ours = ws.table(blocks(docs.select(docs[key].cast("long").alias("doc_id"), "text"), draw.buckets), "matrix")
    theirs = blocks(target.select(target[target_key].cast("long").alias("doc_id"), "text"), draw.buckets)
    gain = gains(column_sums(ours, draw.buckets), column_sums(theirs, draw.buckets))
    rows = ws.table(weighed(ours, gain, draw.seed), "weighed")
    ws.drop("matrix")
    able = F.col("n_words") >= draw.least_words
    most = rows.where(able).count() * draw.percent // 100
    place = global_number(rows.where(able), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")], "rank")
    place = place.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return place.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(Workspace(spark, "importance"), read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance": op13_importance}
