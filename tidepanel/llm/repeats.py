"""Exact repeats of long byte strings by blockwise suffix sorting with a difference cover.

Wanted: every place where a string of LENGTH bytes starts that also starts elsewhere.

1. Each window of LENGTH bytes is put in the bucket of its least k-gram hash (its anchor). Equal
   windows have the same anchor at the same offset, so only windows of one bucket can be equal. The
   windows of a text that share one anchor are a block.
2. A bucket with one block is done: nothing in it repeats. Blocks that are equal as a whole (by a 128-bit
   cryptographic hash) are done too: all their windows repeat. What is left are the buckets with different
   blocks, of which one block of each content is kept: their suffixes are sorted.
3. A bucket is dealt in chunks of about CHUNK blocks, most in one. Suffixes are sorted one batch of chunks
   at a time, and of a batch so many offsets from the anchor at a time as give SORT suffixes. Texts lie aligned by anchor. The suffixes at the positions of a difference cover (mod COVER)
   are ranked first, by doubling; a suffix is then placed by its chunk and offset, its first bytes, and,
   where these tie, by the ranks of the cover positions that follow it, so no comparison reads on through
   a long common string. Neighbours that agree to LENGTH bytes are repeats.
4. Chunks of one bucket are merged by one window of each content that is left in them, under a 128-bit name.

Anchors and contents that bring many rows are split (see split_join), so no task takes a bucket whole.

Rows are numbered once, in a table that all later steps read: rows that repeat a doc_id, or have none, are
texts of their own, and repeat each other where they are equal. Null or empty text: nothing repeats, nothing
removed. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bloom_joins, mix, numbered, parts, read, split_join
from .texts import arrow_batches, batch_of, column, map_texts, powers, prefix_hash

#: A perfect difference set: every residue mod COVER is a difference of two of its members.
COVER, MEMBERS = 31, (1, 5, 11, 24, 25, 27)
#: Blocks of a chunk, on average (a bucket's blocks are dealt by a hash), and suffixes that a task sorts at
#: once. They bound a task's memory; results don't depend on them.
CHUNK, SORT = 8192, 200_000

#: The bits of a place in a text (under 2 GiB).
_PLACE = np.uint64((1 << 31) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor place, anchor hash) of each block: the windows that start at
    start..start+windows-1 and have the k-gram at anchor place as their least."""
    prefix = prefix_hash(data)
    out: list[tuple] = []
    if len(data) >= length:
        n = len(data) - k + 1
        gram = mix((prefix[k:] - prefix[:-k]) * powers(len(prefix))[1][:n])
        w = length - k + 1
        for i in np.flatnonzero(np.diff(off) >= length):
            a, g = int(off[i]), gram[off[i] : off[i + 1] - k + 1]
            m = len(g)
            whole = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
            # the least of 33 hash bits, at equal ones the rightmost: equal windows choose the same offset
            whole[:m] = g & ~_PLACE | _PLACE - np.arange(m, dtype=np.uint64)
            whole = whole.reshape(-1, w)
            ahead = np.minimum.accumulate(whole, axis=1).ravel()
            back = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
            at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            count = np.diff(np.append(at, len(least)))
            place = (_PLACE - (least[at] & _PLACE)).astype(np.int64)
            out.append((np.full(len(at), i), at, count, place, g[place]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks_of(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(h, b1, b2, row, start, n, anchor) of every block of every text; (b1, b2) is a hash of its bytes."""

    def work(keys, data, off, null):
        text, start, n, place, h = anchors(data, off, length, k)
        raw, low = memoryview(np.ascontiguousarray(data)), off[text] + start
        names = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), (low + n - 1 + length).tolist(), strict=True)]
        b = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        whole = [pa.array(np.ascontiguousarray(b[:, i])) for i in (0, 1)]
        yield batch_of(h=h.view(np.int64), b1=whole[0], b2=whole[1], row=keys.take(pa.array(text)), start=pa.array(start.astype(np.int32)), n=pa.array(n.astype(np.int32)), anchor=pa.array(place.astype(np.int32)))

    return map_texts(texts, "h long, b1 long, b2 long, row long, start int, n int, anchor int", work, ("row", "text"))


def cover_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Ranks of the cover positions' suffixes to a depth (a multiple of COVER), by doubling; -1 elsewhere.
    The text ends in zeros beyond depth, so that every rank asked for is whole."""
    n = len(text)
    pos = np.flatnonzero(np.isin(np.arange(n) % COVER, MEMBERS))
    pos = pos[pos + depth + 32 <= n]
    rank = np.full(n, -1, np.int64)
    first = words_at(text, pos)
    first[3] &= ~np.uint64(0xFF)  # COVER = 31 of 32 bytes
    rank[pos] = dense(first)
    have, want = 1, depth // COVER
    while have < want:
        step = min(have, want - have)
        now = rank[pos]
        after = rank[np.minimum(pos + step * COVER, n - 1)]
        rank[pos] = dense([now, after])
        have += step
    return rank, depth


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each row by its keys, first key first; equal rows, equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order):
        differs = np.zeros(len(order) - 1, bool)
        for x in keys:
            y = x[order]
            differs |= y[1:] != y[:-1]
        new[1:] = np.cumsum(differs)
    out = np.empty(len(order), np.int64)
    out[order] = new
    return out


def words_at(text: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """The 32 bytes from each position as four big-endian words."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [np.ascontiguousarray(view[pos + 8 * i]).view(">u8").ravel().astype(np.uint64) for i in range(4)]


def repeated_starts(bucket: np.ndarray, starts: np.ndarray, anchor: np.ndarray, texts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block (bucket number, windows, anchor's place in it, bytes): which windows have an equal
    one in another block of the bucket, and which are the first of their content. One suffix batch."""
    # every block begins where its anchor falls on a multiple of COVER
    size = np.array([len(t) for t in texts])
    room = -(-(size + 2 * COVER) // COVER) * COVER
    base = np.concatenate([[0], np.cumsum(room)])
    at = base[:-1] + (-anchor) % COVER
    text = np.zeros(base[-1] + length + 64, np.uint8)
    for p, t in zip(at.tolist(), texts, strict=True):
        text[p : p + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), starts)
    inner = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    pos = at[owner] + inner
    if length >= 4 * COVER:
        depth = (length - COVER) // COVER * COVER
        rank, depth = cover_ranks(text, depth)
        member = np.isin(np.arange(COVER), MEMBERS)
        to_next = np.array([next(d for d in range(COVER) if member[(r + d) % COVER]) for r in range(COVER)])
        most = length - depth
        to_last = np.array([next(d for d in range(most, -1, -1) if member[(r + d) % COVER]) for r in range(COVER)])
        ties = lambda p: [rank[p + to_next[p % COVER]], rank[p + to_last[p % COVER]]]
    else:
        ties = lambda p: [x for i in range(32, length - 32, 32) for x in words_at(text, p + i)]
    hit, first, offset = np.zeros(len(pos), bool), np.ones(len(pos), bool), anchor[owner] - inner
    held = np.cumsum(np.bincount(offset, minlength=1))
    low = 0
    while low < len(held):  # windows of different offsets can't be equal
        high = max(low + 1, int(np.searchsorted(held, (held[low - 1] if low else 0) + SORT, "right")))
        some = np.flatnonzero((offset >= low) & (offset < high)) if high - low < len(held) else np.arange(len(pos))
        at_ = pos[some]
        keys = [bucket[owner[some]], offset[some], *words_at(text, at_), *ties(at_), *words_at(text, at_ + length - 32)]
        order = np.lexsort(keys[::-1])
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
        order = some[order]
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        first[order[1:][same]] = False
        low = high
    ends = np.cumsum(starts)[:-1]
    return np.split(hit, ends), np.split(first, ends)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_chunks(items: DataFrame, length: int) -> DataFrame:
    """(row, start, last, name): repeated runs of windows (no name), and of buckets in several chunks one
    window of each content (row is null if it needs no answer). items are dealt by h, chunk and sorted by them."""

    def flush(rows):
        _, bucket = np.unique(np.array([(r[0], r[1]) for r in rows]), axis=0, return_inverse=True)
        hits, firsts = repeated_starts(bucket.ravel(), np.array([r[5] for r in rows]), np.array([r[6] - r[4] for r in rows]), [r[8] for r in rows], length)
        out = []
        for r, hit, first in zip(rows, hits, firsts, strict=True):
            _, _, chunks, row, start, _, _, wanted, text = r
            if wanted and hit.any():
                a, b = _runs(hit)
                out += [(row, start + int(i), start + int(j) - 1, None) for i, j in zip(a, b, strict=True)]
            if chunks > 1:
                for i in np.flatnonzero(first).tolist():
                    asks = wanted and not hit[i]
                    out.append((row if asks else None, start + i, start + i, hashlib.blake2b(text[i : i + length], digest_size=16).digest()))
        d, a, b, name = zip(*out, strict=True) if out else ((), (), (), ())
        return batch_of(row=pa.array(d, pa.int64()), start=pa.array(a, pa.int32()), last=pa.array(b, pa.int32()), name=pa.array(name, pa.binary()))

    def run(batches):
        rows, now, total = [], [], 0  # whole chunks; the chunk being read
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0][:2] != r[:2]:
                    rows += now
                    now = []
                    if total >= SORT:
                        yield flush(rows)
                        rows, total = [], 0
                now.append(r)
                total += r[5]
        rows += now
        if rows:
            yield flush(rows)

    return items.mapInArrow(run, "row long, start int, last int, name binary")


def repeated_windows(ws: Workspace, texts: DataFrame, length: int, k: int | None = None) -> DataFrame:
    """(row, start, last) of texts (row, text), a table with a number a row: runs of byte places of a text
    where a string of length bytes starts that also starts elsewhere; together all such places. Runs may
    touch or overlap."""
    k = k or length // 2
    found = ws.table(blocks_of(texts, length, k), "blocks")
    anchors_ = ws.table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    # few blocks share their anchor: a filter of those keeps the others where they lie
    with bloom_joins(texts.sparkSession):
        found = ws.table(split_join(found, anchors_.where("n > 1"), ["h"], "left_semi"), "shared")
    ws.drop("blocks", "anchors")
    content = ["h", "b1", "b2"]
    contents = ws.table(found.groupBy(*content).agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n", "anchor")).alias("x")), "contents")
    copies = contents.where("copies > 1").select(*content, F.col("copies").alias("times"))
    settled = split_join(found, copies, content, "left_semi", "times").select("row", "start", (F.col("start") + F.col("n") - 1).alias("last"))
    open_ = ws.table(contents.groupBy("h").agg(F.count("*").alias("blocks"), F.min("copies").alias("least")).where("least = 1 AND blocks > 1").select("h", "blocks"), "buckets")
    chunks = F.ceil(F.col("blocks") / CHUNK).cast("int")
    items = split_join(contents, open_, ["h"], "inner", "blocks").select("h", F.pmod(F.xxhash64("x.row", "x.start"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"), "x.*", (F.col("copies") == 1).alias("wanted"))
    per = ws.table(items.groupBy("row").agg(F.collect_list(F.struct("h", "chunk", "chunks", "start", "n", "anchor", "wanted")).alias("items")), "open")
    cut = ws.table(_cut(texts, per, length), "cut")
    arrow_batches(texts.sparkSession)
    dealt = cut.repartition(parts(texts.sparkSession), "h", "chunk").sortWithinPartitions("h", "chunk")
    done = ws.table(_sorted_chunks(dealt, length), "sorted")
    ws.drop("cut")
    named = done.where("name IS NOT NULL")
    twice = ws.table(named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
    merged = split_join(named.where("row IS NOT NULL"), twice, ["name"], "left_semi")
    runs = done.where("name IS NULL")
    return settled.unionByName(runs.drop("name")).unionByName(merged.drop("name"))


#: Ids that go to every task, at most.
BROADCAST_IDS = 1_000_000


def _cut(texts: DataFrame, per: DataFrame, length: int) -> DataFrame:
    """The bytes of blocks, from the texts that have some."""
    few = per.count() <= BROADCAST_IDS
    ids = per.select("row")
    some = texts.join(F.broadcast(ids) if few else ids, "row", "left_semi")
    arrow_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            data, off, _ = column(batch, "text")
            rows = []
            for i, items in enumerate(batch.column(batch.schema.get_field_index("items")).to_pylist()):
                row, base = batch.column(0)[i].as_py(), int(off[i])
                for x in items:
                    a = base + x["start"]
                    rows.append((x["h"], x["chunk"], x["chunks"], row, x["start"], x["n"], x["anchor"], x["wanted"], data[a : a + x["n"] - 1 + length].tobytes()))
                    if len(rows) >= 8192:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    return some.join(per, "row").select("row", "text", "items").mapInArrow(run, "h long, chunk int, chunks int, row long, start int, n int, anchor int, wanted boolean, bytes binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    names = ("h", "chunk", "chunks", "row", "start", "n", "anchor", "wanted", "bytes")
    return batch_of(**{n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def removed_spans(runs: DataFrame) -> DataFrame:
    """(row, spans array<struct<start, last>>): the runs of each text that has some."""
    return runs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "last"))).alias("spans"))


def covered(n: int, spans: list[dict], length: int) -> np.ndarray:
    """Which bytes lie in a string that starts in a run."""
    edge = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["last"] + length for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def spanned(ws: Workspace, docs: DataFrame, length: int) -> DataFrame:
    """(doc struct of all columns, spans): every row of docs with the runs of its text, null if none."""
    rows = numbered(ws, docs)
    runs = repeated_windows(ws, rows.select("row", F.col("doc.text").alias("text")), length)
    spans = ws.table(removed_spans(runs), "spans")
    ws.keep("rows", "spans")
    if spans.count() > BROADCAST_IDS:
        return rows.join(spans, "row", "left").select("doc", "spans")
    # rows without a run stay where they lie
    ids = F.broadcast(spans.select("row"))
    some = rows.join(ids, "row", "left_semi").join(spans, "row").select("doc", "spans")
    rest = rows.join(ids, "row", "left_anti")
    return some.unionByName(rest.select("doc", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def digests(ws: Workspace, docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row; text: the remaining bytes as
    a string, with a mark where a cut has left part of a character."""
    both = spanned(ws, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)

    def run(batches):
        for batch in batches:
            data, off, _ = column(batch, "text")
            rows = []
            for i, s in enumerate(batch.column(2).to_pylist()):
                x = data[off[i] : off[i + 1]]
                gone = covered(len(x), s or [], length)
                kept = (x[~gone] if s else x).tobytes()
                rows.append((len(x), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            a, b, c, d, e = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield batch_of(doc_id=batch.column(0), n_bytes=pa.array(a, pa.int64()), n_removed=pa.array(b, pa.int64()), n_spans=pa.array(c, pa.int64()), kept_sha256=pa.array(d, pa.string()), text=pa.array(e, pa.string()))

    arrow_batches(docs.sparkSession)
    return both.select("doc.doc_id", "doc.text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(ws: Workspace, docs: DataFrame, length: int) -> DataFrame:
    """The rows of docs with the repeated passages cut out of text; a character goes if all its bytes do."""
    schema = docs.schema
    at = schema.names.index("text")
    both = spanned(ws, docs, length)
    # columns go by place, so that no name can clash
    flat = both.select(*[F.col("doc").getField(c).alias(f"c{i}") for i, c in enumerate(schema.names)], "spans")

    def run(batches):
        for batch in batches:
            data, off, _ = column(batch, f"c{at}")
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(schema)).to_pylist()):
                if spans:
                    x = data[off[i] : off[i + 1]]
                    gone = covered(len(x), spans, length)
                    char = ((x & 0xC0) != 0x80).cumsum() - 1
                    texts[i] = x[np.bincount(char, ~gone)[char] > 0].tobytes().decode("utf-8", "replace")
            out = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    arrow_batches(docs.sparkSession)
    return flat.mapInArrow(run, schema)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(Workspace(spark, "repeats"), read(spark, sf_dir, "documents"), 400)


QUERIES = {"op1_suffix": op1_suffix}
