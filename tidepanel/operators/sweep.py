"""Grids of parameters as data: targets of all runs of a strategy from one plan, however many runs there are.

A panel's running sums (of prices, returns, their squares and losses, and of counts) are made once. A window of w
days is the difference of two places of them, so each row is joined once with the places that any run looks back
to; a moving average, a volatility or a past price of a run is then a look-up in the row. Runs are a small table
that every task has.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..sources.tables import stored
from . import scan as SC

SUMS = ("c", "s", "cr", "sr", "sq", "sl")
#: key -> (targets of all runs, the windows that a run looks back over)
GRID: dict[str, tuple[Callable, Callable]] = {}


def prefixes(panel: DataFrame) -> DataFrame:
    """(d, n, asset, ord, px, priced, c, s, cr, sr, sq, sl): an asset's running count and sum of prices, count and
    sums of returns, squares and squared losses; priced: names of the day with a price."""
    x = R.with_returns(panel.select("d", "n", "asset", "ord", "px"))
    low = F.least("r", F.lit(0.0))
    part = {"c": F.when(F.col("px").isNotNull(), 1), "s": F.col("px"), "cr": F.when(F.col("r").isNotNull(), 1), "sr": F.col("r"), "sq": F.col("r") * F.col("r"), "sl": low * low}
    x = SC.carried(x, ["asset"], {f"_{k}": F.sum(v) for k, v in part.items()}, {f"_{k}0": lambda o, k=k: F.coalesce(F.sum(f"_{k}").over(SC.before(o)), F.lit(0)) for k in part})
    upto = SC.within(["asset"])
    sums = [(F.col(f"_{k}0") + F.coalesce(F.sum(v).over(upto), F.lit(0))).alias(k) for k, v in part.items()]
    return stored(x.select("d", "n", "asset", "ord", "px", F.count("px").over(W.partitionBy("d")).cast("double").alias("priced"), *sums))


def with_past(pre: DataFrame, offsets: list[int]) -> DataFrame:
    """prefixes with _past: offset -> the row so many places before (null there: before the first)."""
    then = pre.select("asset", F.col("n").alias("_n"), F.struct("px", *SUMS).alias("_then"))
    asked = pre.select("asset", "n", F.explode(F.array(*map(F.lit, offsets))).alias("_off")).withColumn("_n", F.col("n") - F.col("_off"))
    found = asked.join(then, ["asset", "_n"]).groupBy("asset", "n").agg(F.map_from_entries(F.collect_list(F.struct("_off", "_then"))).alias("_past"))
    return pre.join(found, ["asset", "n"], "left")


def _over(k: str, w: str) -> Column:
    """The sum of k over the last w days; w: a column."""
    return F.col(k) - F.coalesce(F.col("_past")[F.col(w)][k], F.lit(0))


def mean(w: str) -> Column:
    return F.when(_over("c", w) >= F.col(w), _over("s", w) / F.col(w))


def volatility(w: str, downside: bool) -> Column:
    k = _over("cr", w)
    enough = k >= F.greatest(F.lit(5), F.floor(F.col(w) / 2))
    var = _over("sl", w) / k if downside else F.greatest(F.lit(0.0), _over("sq", w) - _over("sr", w) * _over("sr", w) / k) / (k - 1)
    return F.when(enough & (k > 1), F.sqrt(F.when(enough & (k > 1), var))) * 252**0.5


def past_price(back: str) -> Column:
    return F.when(F.col(back) == 0, F.col("px")).otherwise(F.col("_past")[F.col(back)]["px"])


def _sized(x: DataFrame, equal: Column, slots: Column | None) -> DataFrame:
    """(run_id, d, n, asset, ord, w) from _m and the sizing of each run; names without a price have 0."""
    day = W.partitionBy("run_id", "d")
    vol = F.when(F.col("sizing").contains("Downside"), volatility("vol_window", True)).otherwise(volatility("vol_window", False))
    x = x.withColumn("_vol", F.when(F.col("sizing").startswith("Inverse"), vol))
    inverse = F.when((F.col("_m") > 0) & (F.col("_vol") > 0), 1 / F.nullif("_vol", F.lit(0.0))).otherwise(0.0)
    x = x.withColumn("_i", inverse)
    by_vol = F.coalesce(F.try_divide("_i", F.sum("_i").over(day)), F.lit(0.0))
    if slots is not None:
        by_vol = by_vol * F.coalesce(F.least(F.lit(1.0), F.try_divide(F.sum(F.when(F.col("_i") > 0, 1.0).otherwise(0.0)).over(day), slots)), F.lit(0.0))
    w = F.when(F.col("sizing").startswith("Inverse"), by_vol).otherwise(equal)
    return x.select("run_id", "d", "n", "asset", "ord", F.when(F.col("px").isNotNull(), w).otherwise(0.0).alias("w"))


def _best(score: str) -> Column:
    place = F.row_number().over(W.partitionBy("run_id", "d").orderBy(F.col(score).desc_nulls_last(), "ord"))
    return F.when(F.col(score).isNotNull() & (place <= F.col("top_n")), 1.0).otherwise(0.0)


def _mask(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)


def _trend(x: DataFrame) -> DataFrame:
    x = x.withColumn("_ma", mean("window")).withColumn("_b", F.col("buffer") / 100)
    above, below = F.col("px") > F.col("_ma") * (1 + F.col("_b")), F.col("px") < F.col("_ma") * (1 - F.col("_b"))
    turn = F.when(F.coalesce(below, F.lit(False)), 0.0).when(F.coalesce(above, F.lit(False)), 1.0)
    held = F.coalesce(F.last(turn, ignorenulls=True).over(W.partitionBy("run_id", "asset").orderBy("n").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    x = x.withColumn("_m", F.when(F.col("_b") > 0, held).otherwise(_mask(above)))
    return _sized(x, F.coalesce(F.try_divide("_m", "priced"), F.lit(0.0)), F.col("priced"))


def _momentum(x: DataFrame) -> Column:
    return F.try_divide(past_price("skip"), F.col("_past")[F.col("skip") + F.col("lookback")]["px"]) - 1


def _cross(x: DataFrame) -> DataFrame:
    x = x.withColumn("_s", _momentum(x)).withColumn("_m", _best("_s"))
    return _sized(x, F.coalesce(F.try_divide("_m", F.sum("_m").over(W.partitionBy("run_id", "d"))), F.lit(0.0)), F.col("top_n"))


def _dual(x: DataFrame) -> DataFrame:
    x = x.withColumn("_s", _momentum(x))
    x = x.withColumn("_s", F.when((F.col("_s") > F.col("abs_threshold") / 100) & (F.col("px") > mean("trend_window")), F.col("_s"))).withColumn("_m", _best("_s"))
    return _sized(x, F.col("_m") / F.col("top_n"), F.col("top_n"))


_BACK = lambda p: {p["skip"], p["skip"] + p["lookback"]} - {0}
GRID["sma_trend"] = (_trend, lambda p: {p["window"], p["vol_window"]})
GRID["xs_momentum"] = (_cross, lambda p: _BACK(p) | {p["vol_window"]})
GRID["dual_momentum"] = (_dual, lambda p: _BACK(p) | {p["trend_window"], p["vol_window"]})


def can(key: str, runs: dict[str, dict]) -> bool:
    return key in GRID and all(p.get("ma_type", "SMA") == "SMA" for p in runs.values())


def targets(panel: DataFrame, key: str, runs: dict[str, dict]) -> DataFrame:
    """(run_id, d, n, asset, ord, w) of all runs (run_id -> every parameter of the strategy). At most some hundreds
    of runs, as they go to every task."""
    fn, back = GRID[key]
    table = pa.Table.from_pylist([{"run_id": k, **p} for k, p in runs.items()])  # a literal, so that equal grids are equal plans
    table = panel.sparkSession.createDataFrame(table)
    x = with_past(prefixes(panel), sorted(set().union(*(back(p) for p in runs.values()))))
    return fn(x.crossJoin(F.broadcast(table)))
