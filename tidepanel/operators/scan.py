"""Order over whole tables without one task for all rows.

Rows are dealt into buckets of their order: months of a series, or ranges of a table. What a bucket needs of those
before it (a count, a product, a high, a last value, a linear map) is one summary row a bucket; the summaries are
combined in a window over buckets, or level by level, and joined back; the rest is a window within the bucket.
So a series of any length is spread over tasks by series and bucket, and only summaries meet by series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Blocks of an affine scan: rows of one fold, and summaries of one fold of the next level.
BLOCK = 64


# ---- time buckets -------------------------------------------------------------------------------


def within(by: list[str]):
    """The window of a series' bucket up to the row."""
    return W.partitionBy(*by, "_b").orderBy("d").rowsBetween(W.unboundedPreceding, 0)


def carried(rows: DataFrame, by: list[str], summaries: dict[str, Column], carries: dict[str, Callable]) -> DataFrame:
    """rows with their bucket _b (the month of d) and, for each of carries (name -> function of a window), what
    it makes of the summary rows before the bucket. A function may take another window of its own of the buckets
    in order. Rows have a d; series are told apart by `by`."""
    x = rows.withColumn("_b", F.trunc("d", "month"))
    order = W.partitionBy(*by).orderBy("_b")
    s = x.groupBy(*by, "_b").agg(*[c.alias(k) for k, c in summaries.items()])
    s = s.select(*by, "_b", *[f(order).alias(k) for k, f in carries.items()])
    return x.join(s, [*by, "_b"])


def before(order):
    return order.rowsBetween(W.unboundedPreceding, -1)


def positions(rows: DataFrame, by: list[str], name: str = "k", total: str | None = None) -> DataFrame:
    """rows with their place (from 1) in the order of d in their series, and the series' length as `total`."""
    carries = {"_s0": lambda o: F.coalesce(F.sum("_n").over(before(o)), F.lit(0))}
    if total:
        carries[total] = lambda o: F.sum("_n").over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    x = carried(rows, by, {"_n": F.count(F.lit(1))}, carries)
    return x.withColumn(name, F.col("_s0") + F.row_number().over(W.partitionBy(*by, "_b").orderBy("d"))).drop("_b", "_s0")


def running_product(rows: DataFrame, by: list[str], factor: Column, name: str) -> DataFrame:
    x = carried(rows.withColumn("_sf", factor), by, {"_p": F.product("_sf")}, {"_s0": lambda o: F.coalesce(F.product("_p").over(before(o)), F.lit(1.0))})
    return x.withColumn(name, F.col("_s0") * F.product("_sf").over(within(by))).drop("_b", "_sf", "_s0")


def running_sum(rows: DataFrame, by: list[str], part: Column, name: str) -> DataFrame:
    x = carried(rows.withColumn("_sf", part), by, {"_p": F.sum("_sf")}, {"_s0": lambda o: F.coalesce(F.sum("_p").over(before(o)), F.lit(0))})
    return x.withColumn(name, F.col("_s0") + F.coalesce(F.sum("_sf").over(within(by)), F.lit(0))).drop("_b", "_sf", "_s0")


def running_max(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    x = carried(rows, by, {"_m": F.max(value)}, {"_s0": lambda o: F.max("_m").over(before(o))})
    return x.withColumn(name, F.greatest("_s0", F.max(value).over(within(by)))).drop("_b", "_s0")


def last_known(rows: DataFrame, by: list[str], value: Column, name: str, tie: str | None = None) -> DataFrame:
    """rows with the last value that isn't null up to the row; of one day's rows those with the lesser `tie` come first."""
    order = ["d", tie] if tie else ["d"]
    x = rows.withColumn("_sv", value)
    key = F.struct(*order) if tie else F.col("d")
    x = carried(x, by, {"_l": F.max_by("_sv", F.when(F.col("_sv").isNotNull(), key))}, {"_s0": lambda o: F.last("_l", ignorenulls=True).over(before(o))})
    w = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn(name, F.coalesce(F.last("_sv", ignorenulls=True).over(w), "_s0")).drop("_b", "_sv", "_s0")


def lagged(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """rows with the value of the row before, null or not."""
    x = carried(rows.withColumn("_sv", value), by, {"_l": F.max_by("_sv", "d")}, {"_s0": lambda o: F.lag("_l").over(o)})
    w = W.partitionBy(*by, "_b").orderBy("d")
    first = F.row_number().over(w) == 1
    return x.withColumn(name, F.when(first, F.col("_s0")).otherwise(F.lag("_sv").over(w))).drop("_b", "_sv", "_s0")


# ---- ranges of a table -----------------------------------------------------------------------------


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _part and _at: the range and the place in it (from 0) of the order. Stored; rows should be a
    table, as its ranges are found by a pass of their own."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    out = out.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(out.drop("_m"))


def global_number(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place, from 1, in the order of the whole table."""
    x = ranged(rows, order)
    sizes = x.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before(W.orderBy("_part"))), F.lit(0)).alias("_before"))  # a row for each range
    return x.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


# ---- scan of affine maps ------------------------------------------------------------------------------


def _fold(items: Column, start: Column, step: Callable) -> Column:
    """[start, step(start, first), step(.., second) ..]: the states of a fold, one more than items."""
    return F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def affine_scan(rows: DataFrame, by: list[str], place: str, a: Column, b: list[Column], names: list[str], most: int, keep: list[str]) -> DataFrame:
    """(by, place, keep, names): y = a * (y of the row before) + b for each of b, from y = 0. `place` numbers a
    series' rows from 0 without gaps, `most` is no less than any. Rows are folded in blocks of BLOCK; a block is
    one map (product of a, value from 0), BLOCK maps are one of the next level, until a series is one block; then
    what enters each block is handed down."""
    row = F.struct(F.col(place).alias("i"), a.cast("double").alias("a"), F.array(*[c.cast("double") for c in b]).alias("b"), *keep)
    level = [rows.select(*by, F.expr(f"{place} div {BLOCK}").alias("_blk"), row.alias("_m")).groupBy(*by, "_blk").agg(F.array_sort(F.collect_list("_m")).alias("_ms"))]
    join = lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), F.zip_with(s["b"], m["b"], lambda u, v: m["a"] * u + v).alias("b"))
    zero = F.array(*[F.lit(0.0)] * len(b))
    whole = F.aggregate("_ms", F.struct(F.lit(1.0).alias("a"), zero.alias("b")), join)
    blocks = most // BLOCK
    while blocks > 0:  # BLOCK blocks make one of the next level
        maps = level[-1].select(*by, "_blk", whole.alias("_w")).select(*by, F.expr(f"_blk div {BLOCK}").alias("_up"), F.struct(F.col("_blk").alias("i"), F.col("_w")["a"].alias("a"), F.col("_w")["b"].alias("b")).alias("_m"))
        level.append(maps.groupBy(*by, F.col("_up").alias("_blk")).agg(F.array_sort(F.collect_list("_m")).alias("_ms")))
        blocks //= BLOCK
    enter = level[-1].select(*by, "_blk", zero.alias("_y"))
    states = _fold(F.col("_ms"), F.col("_y"), lambda y, m: F.zip_with(y, m["b"], lambda u, v: m["a"] * u + v))
    for k in range(len(level) - 1, 0, -1):
        down = level[k].join(enter, [*by, "_blk"]).select(*by, F.inline(F.arrays_zip(F.transform("_ms", lambda m: m["i"]).alias("_blk"), F.slice(states, 1, F.size("_ms")).alias("_y"))))
        enter = down.select(*by, "_blk", "_y")
    done = level[0].join(enter, [*by, "_blk"]).select(*by, F.inline(F.arrays_zip(F.col("_ms").alias("_m"), F.slice(states, 2, F.size("_ms")).alias("_y"))))
    return done.select(*by, F.col("_m")["i"].alias(place), *[F.col("_m")[c].alias(c) for c in keep], *[F.col("_y")[i].alias(n) for i, n in enumerate(names)])


# ---- windows of rows ------------------------------------------------------------------------------------

#: Rows of a block of a rolling window, unless the window is longer.
STRETCH = 512


def halo(rows: DataFrame, by: list[str], place: str, k: int) -> tuple[DataFrame, Callable]:
    """(rows, over): windows of the last k rows that don't hold a series in one task. Rows are dealt in blocks of
    their place; those that a later block looks back on go there too. over(aggregate) is the window's value where
    _own, which the caller filters by in the end."""
    size = max(k, STRETCH)
    first, last = F.expr(f"{place} div {size}"), F.expr(f"({place} + {k - 1}) div {size}")
    x = rows.withColumn("_blk", F.explode(F.array_distinct(F.array(first, last)))).withColumn("_own", F.col("_blk") == first)
    w = W.partitionBy(*by, "_blk").orderBy(place)
    return x, lambda c, back=k - 1: c.over(w.rowsBetween(-back, 0))


# ---- exact quantiles ------------------------------------------------------------------------------------

#: Rows of one bucket of values that may be sorted in one task, and the parts that a larger one is cut in.
SORTED, PARTS = 100_000, 1024


def value_bucket(x: Column) -> Column:
    """An order of numbers in steps of a 64th of an octave: smaller numbers, no larger bucket."""
    step = lambda v: F.floor(F.log2(v) * 64) + 80_000
    return F.when(x > 0, step(F.when(x > 0, x))).when(x < 0, -step(F.when(x < 0, -x))).otherwise(0).cast("long")


def quantiles(rows: DataFrame, value: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, n, q: array of the quantiles ps of the values that aren't null, between neighbours by their distance):
    exact, and no state or task holds all values. Counts by bucket say in which bucket each asked place is; only
    the rows of those buckets go on, and those of more than SORTED rows are cut again by value until they aren't
    or hold one value only. by: none for the whole table. rows should be a table, as each cut reads it."""
    by = by or []
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    counted = x.groupBy(*by, value_bucket(F.col("v")).alias("_b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    order = W.partitionBy(*by).orderBy("_b")
    counted = counted.withColumn("n", F.sum("c").over(W.partitionBy(*by))).withColumn("under", F.coalesce(F.sum("c").over(before(order)), F.lit(0)))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in ps]
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(t), F.ceil(t)) for t in at])))
    inside = F.filter(asked, lambda r: (r >= F.col("under")) & (r < F.col("under") + F.col("c")))
    # (by, n, lo, hi, c: rows from lo to hi, under: rows below, rank: a place among them)
    open_ = stored(counted.select(*by, "n", "lo", "hi", "c", "under", F.explode(inside).alias("rank")))
    known, wide = open_.where("lo = hi").select(*by, "n", "rank", F.col("lo").alias("v")), open_.where("lo < hi")
    spans = lambda t: t.select(*by, "lo", "hi").distinct()
    fits = lambda t: [*[x[c] == t[c] for c in by], x["v"] >= t["lo"], x["v"] <= t["hi"]]
    while (wide.agg(F.max("c")).first()[0] or 0) > SORTED:
        s = F.broadcast(spans(wide))  # at most two for each quantile of a group
        part = F.least(F.lit(PARTS - 1), F.floor((x["v"] - s["lo"]) / (s["hi"] - s["lo"]) * PARTS)).cast("long")
        cut = x.join(s, fits(s)).groupBy(*[x[c] for c in by], s["lo"].alias("lo0"), s["hi"].alias("hi0"), part.alias("_b")).agg(F.count(F.lit(1)).alias("c1"), F.min("v").alias("lo1"), F.max("v").alias("hi1"))
        cut = cut.withColumn("under1", F.coalesce(F.sum("c1").over(before(W.partitionBy(*by, "lo0", "hi0").orderBy("_b"))), F.lit(0)))
        again = wide.withColumnsRenamed({"lo": "lo0", "hi": "hi0"}).join(cut, [*by, "lo0", "hi0"]).where("rank >= under + under1 AND rank < under + under1 + c1")
        again = stored(again.select(*by, "n", F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), F.col("c1").alias("c"), (F.col("under") + F.col("under1")).alias("under"), "rank"))
        known, wide = known.unionByName(again.where("lo = hi").select(*by, "n", "rank", F.col("lo").alias("v"))), again.where("lo < hi")
    s = F.broadcast(spans(wide))
    sorted_ = x.join(s, fits(s)).select(*[x[c] for c in by], s["lo"], s["hi"], x["v"])
    sorted_ = sorted_.withColumn("_k", F.row_number().over(W.partitionBy(*by, "lo", "hi").orderBy("v")) - 1)
    found = wide.join(sorted_, [*by, "lo", "hi"]).where("rank = under + _k").select(*by, "n", "rank", "v")
    g = known.unionByName(found).groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    pick = [F.col("m")[F.floor(t)] + (F.col("m")[F.ceil(t)] - F.col("m")[F.floor(t)]) * (t - F.floor(t)) for t in at]
    return g.select(*by, "n", F.array(*pick).alias("q"))
