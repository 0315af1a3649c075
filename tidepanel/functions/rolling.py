"""Rolling windows over a dense panel: n rows of an asset, a value where at least k are known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from ..operators import scan as S


def asset_days():
    """The window of an asset's days."""
    return W.partitionBy("asset").orderBy("d")


def rolling(agg: Callable, x: Column | str, n: int, k: int | None = None) -> Column:
    w = asset_days().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= (n if k is None else k), agg(x).over(w))


def lagged(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(asset_days())


def with_returns(panel: DataFrame, name: str = "r") -> DataFrame:
    """Returns over the last known price."""
    padded = panel.withColumn("_p", F.last("px", ignorenulls=True).over(asset_days().rowsBetween(W.unboundedPreceding, 0)))
    return padded.withColumn(name, F.try_divide("_p", lagged("_p")) - 1).drop("_p")


def sma(n: int) -> Column:
    return rolling(F.avg, "px", n)


def total_return(n: int) -> Column:
    return F.try_divide(F.col("px"), lagged("px", n)) - 1


def realized_vol(n: int, ppy: int = 252) -> Column:
    """Of column r."""
    return rolling(F.stddev_samp, "r", n, max(5, n // 2)) * ppy**0.5


def downside_vol(n: int, ppy: int = 252, mar: float = 0.0) -> Column:
    low = F.when(F.col("r").isNotNull(), F.least(F.col("r") - mar / ppy, F.lit(0.0)))
    return F.sqrt(rolling(F.avg, low * low, n, max(5, n // 2))) * ppy**0.5


def efficiency_ratio(n: int) -> Column:
    """Needs column step: |px - px before|."""
    ratio = F.try_divide(F.abs(F.col("px") - lagged("px", n)), rolling(F.sum, "step", n))
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def zscore(n: int) -> Column:
    return F.try_divide(F.col("px") - rolling(F.avg, "px", n), rolling(F.stddev_samp, "px", n))


def ewms(panel: DataFrame, names: dict[str, str], alpha: float, least: int) -> DataFrame:
    """Exponential means without adjustment of the columns names, each under its new name; a gap lets old weight
    decay, and days without a value carry the mean on. The columns have their values on the same days. Each value
    is a linear map of the mean before it, so the means are a scan of such maps over blocks of days."""
    known = panel.where(F.col(next(iter(names))).isNotNull()).select("asset", "d", "n", *names)
    x = S.carried(known, ["asset"], {"_c": F.count(F.lit(1)), "_l": F.max("n")}, {"_k0": lambda o: F.coalesce(F.sum("_c").over(S.before(o)), F.lit(0)), "_n0": lambda o: F.lag("_l").over(o)})
    days = W.partitionBy("asset", "_b").orderBy("d")
    x = x.withColumn("_k", F.col("_k0") + F.row_number().over(days) - 1).withColumn("_g", F.col("n") - F.coalesce(F.lag("n").over(days), "_n0"))
    old = F.when(F.col("_g").isNotNull(), F.pow(F.lit(1 - alpha), F.col("_g")))
    share = F.coalesce(alpha / (old + alpha), F.lit(1.0))
    most = panel.agg(F.max("n")).first()[0] or 0
    y = S.affine_scan(x, ["asset"], "_k", 1 - share, [share * F.col(c) for c in names], list(names.values()), most, ["d"])
    y = y.select("asset", "d", F.when(F.col("_k") >= least - 1, F.struct(*names.values())).alias("_y"))
    out = S.last_known(panel.join(y, ["asset", "d"], "left"), ["asset"], F.col("_y"), "_y")
    return out.select(*panel.columns, *[F.col("_y")[c].alias(c) for c in names.values()])


def ewm(panel: DataFrame, column: str, name: str, alpha: float, least: int) -> DataFrame:
    return ewms(panel, {column: name}, alpha, least)


def rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    """Column rsi by Wilder's means; null where nothing fell."""
    diff = F.col("px") - lagged("px")
    out = panel.withColumn("_u", F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0)))).withColumn("_v", F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))))
    out = ewms(out, {"_u": "_up", "_v": "_down"}, 1 / n, n)
    return out.withColumn("rsi", 100 - 100 / (1 + F.try_divide("_up", F.nullif("_down", F.lit(0.0))))).drop("_u", "_v", "_up", "_down")


def pct_rank(score: str, by: str = "d") -> Column:
    """Mean rank over the number of known scores, ascending."""
    known = F.when(F.col(score).isNotNull(), F.col(score))
    rank = F.rank().over(W.partitionBy(by, F.col(score).isNull()).orderBy(score))
    ties = F.count(F.lit(1)).over(W.partitionBy(by, score))
    return F.when(known.isNotNull(), (rank + (ties - 1) / 2) / F.count(score).over(W.partitionBy(by)))


def top_n(score: str, n: int) -> Column:
    """1.0 for the n best of a day, ties by the asset's place."""
    place = F.row_number().over(W.partitionBy("d").orderBy(F.col(score).desc_nulls_last(), "ord"))
    return F.when(F.col(score).isNotNull() & (place <= n), 1.0).otherwise(0.0)


def sticky(enter: Column, leave: Column) -> Column:
    """1 from an entry to the next exit; an exit on the same day wins."""
    state = F.when(F.coalesce(leave, F.lit(False)), 0.0).when(F.coalesce(enter, F.lit(False)), 1.0)
    return F.coalesce(F.last(state, ignorenulls=True).over(asset_days().rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
