"""Cleaning a panel and reporting on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan as S


def normalize_index(rows: DataFrame, date: str, order: str, *keys: str) -> DataFrame:
    """Strings to dates in UTC; rows without a date go, of a date's rows the last by `order` stays."""
    dated = rows.withColumn("d", F.to_date(F.col(date).try_cast("timestamp"))).where("d IS NOT NULL")
    last = W.partitionBy("d", *keys).orderBy(F.col(order).desc())
    return dated.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def drop_empty_assets(panel: DataFrame) -> DataFrame:
    """Without the assets that have no value at all."""
    return panel.join(panel.groupBy("asset").agg(F.count("px").alias("k")).where("k > 0").select("asset"), "asset", "left_semi")


def neutralize_nonpositive(panel: DataFrame) -> DataFrame:
    """Prices that aren't positive become null."""
    return panel.withColumn("px", F.when(F.col("px") > 0, F.col("px")))


def bounded_ffill(panel: DataFrame, column: str, limit: int) -> DataFrame:
    """The last value of up to `limit` places (n) before; 0 fills nothing."""
    if not limit:
        return panel
    x = S.last_known(panel, ["asset"], F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), "n")), "_s")
    filled = F.when(F.col("n") - F.col("_s")["n"] <= limit, F.col("_s")["v"])
    return x.select(*[filled.alias(c) if c == column else c for c in panel.columns])


def quality_report(panel: DataFrame) -> DataFrame:
    """(asset, first_d, last_d, observations, gaps, pct_missing) between an asset's first and last value."""
    seen = F.col("px").isNotNull()
    out = panel.groupBy("asset").agg(F.min(F.when(seen, F.col("d"))).alias("first_d"), F.max(F.when(seen, F.col("d"))).alias("last_d"), F.count("px").alias("observations"), F.min(F.when(seen, F.col("n"))).alias("a"), F.max(F.when(seen, F.col("n"))).alias("b"))
    span = F.col("b") - F.col("a") + 1
    gaps = (span - F.col("observations")).alias("gaps")
    return out.select("asset", "first_d", "last_d", "observations", gaps, F.round(100 * (span - F.col("observations")) / span, 2).alias("pct_missing"))


def quality_flags(report: DataFrame, min_history: int = 60) -> DataFrame:
    """(asset, flag) of what is worth a warning."""
    start = F.min("first_d").over(W.partitionBy())
    flags = F.array(F.when(F.col("first_d") > F.col("start"), "short_history"), F.when(F.col("gaps") > 0, "gaps"), F.when(F.col("observations") < min_history, "too_few"))
    return report.withColumn("start", start).select("asset", F.explode(F.array_compact(flags)).alias("flag"))


def quality_warnings(panel: DataFrame, min_history: int = 60) -> DataFrame:
    """(asset, flag): an asset without any value is `dropped`; of the others, short_history (begins after the
    panel) and gaps; too_few, without an asset, if the panel as a whole has fewer days than min_history."""
    days = panel.agg(F.countDistinct("d").alias("days"), F.min("d").alias("start"))
    report = quality_report(panel).crossJoin(days)
    flags = F.array(F.when(F.col("observations") == 0, "dropped"), F.when(F.col("first_d") > F.col("start"), "short_history"), F.when(F.col("gaps") > 0, "gaps"))
    own = report.select("asset", F.explode(F.array_compact(flags)).alias("flag"))
    return own.unionByName(days.where(F.col("days") < min_history).select(F.lit(None).cast("string").alias("asset"), F.lit("too_few").alias("flag")))


def sanitize_weights(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """Weights on the panel: 0 where there is none, where it isn't finite, or where there's no price."""
    w = F.when(F.col("w").isNotNull() & ~F.isnan("w") & (F.abs("w") != float("inf")), F.col("w")).otherwise(0.0)
    both = panel.select("d", "n", "asset", "ord", "px").join(weights.select("d", "asset", "w"), ["d", "asset"], "left")
    return both.select("d", "n", "asset", "ord", F.when(F.col("px").isNotNull(), w).otherwise(0.0).alias("w"))


def leverage_cap(weights: DataFrame, most: float) -> DataFrame:
    """Days with more gross weight than `most` are scaled down to it."""
    gross = F.sum(F.abs("w")).over(W.partitionBy("d"))
    return weights.withColumn("g", gross).withColumn("w", F.when(F.col("g") > most, F.col("w") * most / F.col("g")).otherwise(F.col("w"))).drop("g")


def execution_lag(weights: DataFrame, lag: int) -> DataFrame:
    """The weight of `lag` days before, 0 at the start."""
    return weights.withColumn("w", F.coalesce(F.lag("w", lag).over(W.partitionBy("asset").orderBy("d")), F.lit(0.0)) if lag > 0 else F.col("w"))


def normalized_prices(panel: DataFrame) -> DataFrame:
    """Prices as a percentage of the asset's first."""
    first = F.first("px", ignorenulls=True).over(W.partitionBy("asset").orderBy("d").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return panel.withColumn("px", F.try_divide("px", first) * 100)
