"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles. One hash deals them in BUCKETS buckets; of the least value in each,
the leading-zero count and some mantissa bits are stored: a 16-bit register. Small sets leave buckets empty:
these are filled by further rounds, in which the hash deals the set anew, so that two sets agree in a
register with the chance of their Jaccard similarity, whatever their sizes. Bands of ROWS registers find
candidates; a collision-corrected Jaccard estimate drops those that are far off; the rest is confirmed on
the full sets, so no false link is returned. At the threshold itself a link is missed with a chance of
5e-8 by the bands and 1e-8 by the estimate.

Equal sets are one class with one representative, so copies never meet pairwise. In each band bucket the
members are first held against one of them; what is then connected needs no further look, and only pairs
from different components of a bucket are held against each other. All of it is joins on bucket or id that
Spark can split.

Rows are numbered once, in a table that all later steps read: rows that repeat a doc_id are documents of
their own, and a group's name is its smallest doc_id, null if it has none. Null or empty text, or one without
words: an empty set, linked with nothing. Texts with fewer words than a shingle: the whole sequence is the
shingle. Words are compared by a 64-bit cryptographic hash. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, KEY_ROWS, Workspace, components, fields, mix, numbered, parts, read, split_join
from .texts import LOWER, arrow_batches, batch_of, map_texts, word_hashes, word_spans

BUCKETS, ROWS = 128, 4
MANTISSA = 11
#: Rounds that deal a set anew; buckets that are empty after them have a hash each.
ROUNDS = 12
#: The estimate's slack in standard errors.
SLACK = 5.6
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_VALUE = (np.uint64(1) << _SHIFT) - np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, ascending."""
    low = LOWER[data]
    s, e, first = word_spans(low, off)
    w = word_hashes(low, s, e)
    h = w.copy()
    for k in range(1, min(width, len(w))):
        h[:-k] = mix(h[:-k] * np.uint64(3) + w[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            x = mix(np.uint64([b - a]))
            for k in range(a, b):
                x = mix(x * np.uint64(3) + w[k])
            out.append(x)
        else:
            out.append(w[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, BUCKETS] registers of uint16; those of an empty set are all alike."""
    low = np.full((len(sets), BUCKETS), _FREE)
    open_ = np.flatnonzero([len(x) > 0 for x in sets])
    for turn in range(ROUNDS):
        if not len(open_):
            break
        got = np.full((len(open_), BUCKETS), _FREE)
        row = np.repeat(np.arange(len(open_)), [len(sets[i]) for i in open_.tolist()])
        h = mix(np.concatenate([sets[i] for i in open_.tolist()]) ^ mix(np.uint64([turn])))
        np.minimum.at(got.reshape(-1), row * BUCKETS + (h >> _SHIFT).astype(np.int64), h & _VALUE)
        now = low[open_]
        low[open_] = now = np.where(now == _FREE, got, now)
        open_ = open_[(now == _FREE).any(1)]
    for i in open_.tolist():
        free = np.flatnonzero(low[i] == _FREE)
        low[i, free] = (mix(sets[i][:, None] ^ mix(free.astype(np.uint64) + np.uint64(1 << 32))) & _VALUE).min(0)
    bits = int(_SHIFT)
    zeros = np.clip(bits - np.frexp(low.astype(np.float64))[1], 0, bits).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(65 - bits))) >> np.uint64(64 - MANTISSA)
    return (np.minimum(zeros, np.uint64(31)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that unrelated sets of a and b shingles have the same register."""
    a, b = np.maximum(a / BUCKETS, 1), np.maximum(b / BUCKETS, 1)
    total = a + b
    out = np.zeros(len(total))
    for j in range(32):
        high, low = 2.0**-j, (2.0 ** -(j + 1) if j < 31 else 0.0)
        out += 2.0 ** -(j + 1 + MANTISSA) * (np.exp(-total * low) - np.exp(-total * high))
    return np.minimum(out * a * b / total, 0.9)


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """(key as given, n_shingles, content: a key of the whole set, registers) of (key, text)."""

    def work(keys, data, off, null):
        sets = shingle_sets(data, off, width)
        yield batch_of(
            key=keys,
            n_shingles=pa.array([len(x) for x in sets], pa.int64()),
            content=pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
            registers=pa.array([x.tobytes() for x in registers(sets)], pa.binary()),
        )

    kind = texts.schema["key"].dataType.simpleString()
    return map_texts(texts, f"key {kind}, n_shingles long, content binary, registers binary", work, ("key", "text"))


def band_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id): a row for every band of every representative."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            # ROWS registers of 16 bits are one word
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, BUCKETS // ROWS)
            h = mix(regs + mix(np.arange(BUCKETS // ROWS, dtype=np.uint64))[None, :])
            yield batch_of(bucket=pa.array(h.ravel().view(np.int64)), id=pa.array(np.repeat(batch.column(0).to_numpy(), BUCKETS // ROWS)))

    return reps.select("id", "registers").mapInArrow(run, "bucket long, id long")


def plausible(ws: Workspace, pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), a table, those whose sizes and estimated Jaccard allow the threshold."""
    x = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    y = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    x = ws.table(pairs.groupBy("a").agg(F.count("*").alias("times")).join(x, "a"), f"sides-{ws.next()}")
    both = split_join(pairs, x, ["a"], "inner", "times").join(y, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    t = percent / 100
    least = t - SLACK * (t * (1 - t) / BUCKETS) ** 0.5

    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            r_a, r_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
            c = collision(n_a, n_b)
            j = ((r_a == r_b).mean(1) - c) / (1 - c) if len(c) else c
            yield batch_of(a=batch.column(0), b=batch.column(1)).filter(pa.array(j >= least))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


#: Ids that go to every task, at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(ws: Workspace, texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles binary) of the rows named by ids (row)."""

    def work(keys, data, off, null):
        yield batch_of(id=keys, shingles=pa.array([x.tobytes() for x in shingle_sets(data, off, width)], pa.binary()))

    needed = texts.join(_small(ids), "row", "left_semi")
    return ws.table(map_texts(needed, "id long, shingles binary", work, ("row", "text")), f"sets-{ws.next()}")


def confirm(ws: Workspace, texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b), a table, those with 100 * intersection >= percent * union on the full sets. The set of a goes
    once to a task that holds pairs of a; an a with many pairs is dealt over several."""
    sets = _sets(ws, texts, pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), width)
    times = ws.table(pairs.groupBy("a").agg(F.count("*").alias("n")), f"sides-{ws.next()}")
    most = max(KEY_ROWS, (times.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    times = times.withColumn("shares", F.ceil(F.col("n") / most).cast("int"))
    hot = F.broadcast(times.where(F.col("n") > most).select("a", "shares"))  # at most HOT_KEYS
    share = F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int")
    asked = pairs.join(hot, "a", "left").select("a", share.alias("share"), "b").join(sets, F.col("b") == F.col("id")).select("a", "share", "b", "shingles")
    first = times.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = first.unionByName(asked).repartition(parts(texts.sparkSession), "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches):
        p = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, ok = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for other, x in zip(b, batch.column(3), strict=True):
                q = np.frombuffer(x.as_buffer(), np.uint64)
                if other is None:
                    p = q.copy()
                    ok.append(False)
                else:
                    i = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * i >= percent * (len(p) + len(q) - i))
            yield batch_of(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64())).filter(pa.array(ok, pa.bool_()))

    arrow_batches(texts.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


#: Members of a bucket that are held against each other as pairs; larger buckets are held in tiles.
FEW = 16
#: Sets and shingles of a tile's side.
TILE, TILE_SHINGLES = 512, 400_000


def _tiles(ws: Workspace, texts: DataFrame, rest: DataFrame, found: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) in large buckets. Buckets whose first members are of one component are one group,
    as they hold much the same documents. Its members of that component (known to hang together) form
    blocks, the others form blocks too; every block of others is held against all blocks, in tiles of
    bounded size. A tile finds links by exact set products and returns one for each component met."""
    heads = rest.groupBy("first").agg(F.count("*").alias("times")).join(found, F.col("first") == F.col("id"), "left")
    heads = ws.table(heads.select("first", F.coalesce("component", "first").alias("g"), "times"), "heads")
    grouped = split_join(rest, heads, ["first"], "inner", "times").select("g", "id", "c").distinct()
    grouped = ws.table(grouped.join(classes.select("id", "n"), "id").withColumn("out", F.col("c") != F.col("g")), "grouped")
    size = grouped.groupBy("g").agg(F.count("*").alias("times"), *[F.ceil(F.greatest(F.count(F.when(x, 1)) / F.lit(TILE), F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)) / F.lit(TILE_SHINGLES))).cast("int").alias(k) for k, x in (("mains", ~F.col("out")), ("outs", F.col("out")))])
    size = ws.table(size.where("outs > 0"), "sizes")
    block = F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))).cast("int")
    placed = split_join(grouped, size, ["g"], "inner", "times").withColumn("k", block)
    outs = F.sequence(F.lit(0), F.col("outs") - 1)
    # a tile is (block of others, other block); blocks of others are numbered from 0, main ones from -1 down
    to_main = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(1), F.greatest("mains", F.lit(1))), lambda i: F.struct(F.col("k").alias("x"), (-i).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    among = F.transform(outs, lambda i: F.struct(F.greatest(i, F.col("k")).alias("x"), F.least(i, F.col("k")).alias("y")))
    mine = F.transform(outs, lambda i: F.struct(i.alias("x"), (-F.col("k") - 1).alias("y")))
    dealt = placed.select("g", "id", "c", F.explode(F.when(F.col("out"), F.concat(to_main, among)).otherwise(mine)).alias("t"), F.when(F.col("out"), F.col("k")).otherwise(-F.col("k") - 1).alias("side"))
    sets = _sets(ws, texts, grouped.select(F.col("id").alias("row")).distinct(), width)

    def tile(pdf):
        import pandas as pd

        x = (pdf["side"] == pdf["x"]).to_numpy()
        y = (pdf["side"] == pdf["y"]).to_numpy()
        sets_ = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        n = np.array([len(s) for s in sets_])
        _, word = np.unique(np.concatenate(sets_), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        common = np.zeros((x.sum(), y.sum()), np.float32)
        place = np.full((2, len(n)), -1)
        place[0, x], place[1, y] = np.arange(x.sum()), np.arange(y.sum())
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        step = 2048
        for low in range(0, int(word[-1]) + 1 if len(word) else 0, step):
            a, b = np.searchsorted(word, [low, low + step])
            w, o = word[a:b] - low, owner[a:b]
            left, right = np.zeros((len(common), step), np.float32), np.zeros((common.shape[1], step), np.float32)
            left[place[0, o[x[o]]], w[x[o]]] = 1
            right[place[1, o[y[o]]], w[y[o]]] = 1
            common += left @ right.T
        common = common.astype(np.int64)
        c, ids_ = pdf["c"].to_numpy(), pdf["id"].to_numpy()
        ok = (100 * common >= percent * (n[x][:, None] + n[y][None, :] - common)) & (c[x][:, None] != c[y][None, :])
        i, j = np.nonzero(ok)
        links = pd.DataFrame({"a": ids_[x][i], "b": ids_[y][j], "c": c[y][j]})
        return links.drop_duplicates(["a", "c"])[["a", "b"]]

    rows = dealt.join(sets, "id").select("g", "id", "c", "side", "t.x", "t.y", "shingles")
    return rows.groupBy("g", "x", "y").applyInPandas(tile, "a long, b long")


def groups(ws: Workspace, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, stays) of a numbered table whose doc has doc_id and text.
    stays: one row of each group, that of its smallest doc_id; rows without one come last."""
    texts = rows.select("row", F.col("doc.text").alias("text"))
    keyed = rows.select(F.struct("row", F.col("doc.doc_id").cast("long").alias("doc_id")).alias("key"), F.col("doc.text").alias("text"))
    sig = ws.table(signatures(keyed, width).select("key.row", "key.doc_id", "n_shingles", F.col("content").alias("key"), "registers"), "signatures")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    reps = sig.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("row", "n_shingles", "registers")).alias("m"), F.min(best).alias("best"), F.count("*").alias("copies"))
    classes = ws.table(reps.select("key", F.col("m.row").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.registers").alias("registers"), "best", "copies"), "classes")
    buckets = ws.table(band_buckets(classes), "buckets")
    shared = ws.table(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "shared")
    members = ws.table(split_join(buckets, shared, ["bucket"]).select("bucket", "first", "id"), "members")
    ws.drop("buckets", "shared")
    # every member against the first of its bucket
    star = ws.table(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    star = ws.table(plausible(ws, star, classes, percent), "star")
    links = ws.table(confirm(ws, texts, star, width, percent), "links-1")
    found = ws.table(components(ws, links, "first"), "components-1")
    # then what is still apart: members of a bucket from different components
    placed = ws.table(members.join(found, "id", "left").select("bucket", "first", "id", F.coalesce("component", "id").alias("c")), "placed")
    apart = ws.table(placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n"), "apart")
    rest = ws.table(split_join(placed, apart, ["bucket"]), "rest")
    few = rest.where(F.col("n") <= FEW).select("bucket", "id", "c")
    other = few.select("bucket", F.col("id").alias("b"), F.col("c").alias("d"))
    pairs = few.join(other, "bucket").where("c <> d AND id < b").select(F.col("id").alias("a"), "b").distinct()
    pairs = ws.table(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    pairs = ws.table(plausible(ws, pairs, classes, percent), "plausible")
    more = ws.table(confirm(ws, texts, pairs, width, percent), "links-2")
    tiled = ws.table(_tiles(ws, texts, rest.where(F.col("n") > FEW), found, classes, width, percent), "links-3")
    comp = ws.table(components(ws, found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more).union(tiled), "second"), "components-2")
    # the best of each component, then of each class
    of_class = ws.table(classes.join(comp, "id", "left").select("key", "best", "copies", F.coalesce("component", "id").alias("component")), "of-class")
    of_comp = ws.table(of_class.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("n")), "of-component")
    named = ws.table(split_join(of_class.drop("best"), of_comp, ["component"]).select("key", "copies", "first"), "named")
    linked = split_join(sig.where("n_shingles > 0"), named, ["key"], "inner", "copies")
    out = linked.select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("stays"))
    alone = sig.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return out.unionByName(alone)


def near_duplicates(ws: Workspace, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs. kept: doc_id = component_id; a row
    without an id is kept if its group has none."""
    out = groups(ws, numbered(ws, docs.select("doc_id", "text")), width, percent)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(ws: Workspace, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each group; rows without words stay."""
    rows = numbered(ws, docs)
    gone = ws.table(groups(ws, rows, width, percent).where(~F.col("stays")).select("row"), "gone")
    ws.keep("rows", "gone")
    return rows.join(_small(gone), "row", "left_anti").select(*fields("doc", docs.columns))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(Workspace(spark, "minhash"), read(spark, sf_dir, "documents"), width=2, percent=80)


QUERIES = {"op9_minhash": op9_minhash}
