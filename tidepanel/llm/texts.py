"""Numpy on Arrow text columns: words, hashes and slices of bounded size, no Python strings."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix

#: Text bytes that a task expands in numpy at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Text bytes of an Arrow batch, so that a batch of very long texts doesn't fill a worker.
BATCH_BYTES = 8 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A 64-bit value for each byte.
BYTE_KEY = mix(np.arange(1, 257, dtype=np.uint64))
#: Words whose hash a task keeps, and the bytes of the longest.
KNOWN, KNOWN_BYTES = 300_000, 48
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of a key of each byte * base^place before every place: the hash of a span is a difference of two
    of them. Different spans can be made to collide: for finding candidates only."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEY[data] * powers(len(data))[0], out=out[1:])
    return out


def joined(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The binary array of consecutive spans of data with these sizes."""
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def codes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each span's content, contents): equal numbers, equal bytes. Numbers hold for this call."""
    d = joined(data, sizes).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


class _Known(dict):
    def __missing__(self, word: bytes) -> bytes:
        out = hashlib.blake2b(word, digest_size=8).digest()
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


_HASH = _Known()


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit cryptographic hash of each word that word_spans found; one call a different word."""
    which, words = codes(data[~SPACE[data]], end - start)
    return np.frombuffer(b"".join(map(_HASH.__getitem__, words.to_numpy(zero_copy_only=False))), np.uint64)[which]


def twins(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows equal another row in all keys. Sorted by a hash; rows that only share it are told apart."""
    h = np.zeros(len(keys[0]), np.uint64)
    for x in keys:
        h = mix(h + x.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    alike = h[order][1:] == h[order][:-1]
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
    if (alike & ~same).any():
        order = np.lexsort(keys)
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def arrow_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes besides rows. The setting stays: plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_MODEL: dict = {}


def model(key, make: Callable):
    """The model of this worker process, made once. Workers outlive a stage: another key takes its place."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]


def release() -> None:
    """At the end of a task: hands freed memory back, as the worker waits for the next one with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string or binary column, without a copy; a null is an empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    n, null = len(a), np.zeros(len(a), bool)
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    if a.null_count:
        null = a.is_null().to_numpy(zero_copy_only=False)
        a = a.fill_null("" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off, null


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of every text) of the words [^\\x20\\x09-\\x0D]+; none crosses texts.
    off starts at 0."""
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def map_texts(df: DataFrame, schema: str, work: Callable, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """mapInArrow over slices: work(keys Arrow array, data, offsets from 0, is null) yields record
    batches of the schema. columns: a key and a text."""
    arrow_batches(df.sparkSession)
    key, text = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off, null = column(batch, text)
            keys = batch.column(batch.schema.get_field_index(key))
            for lo, hi in slices(off):
                o = off[lo : hi + 1]
                yield from work(keys[lo:hi], data[o[0] : o[-1]], o - o[0], null[lo:hi])
        release()

    return df.select(key, text).mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def sum_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over [off[i], off[i+1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
