"""Imported target weights and return streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .align import detect_scale, snap_dates, stream_frequency
from .scan import positions


def scaled_weights(raw: DataFrame) -> DataFrame:
    """Weights as fractions: divided by 100 if the median day's gross weight is between 40 and 160."""
    gross = raw.groupBy("d").agg(F.sum(F.abs("w")).alias("g"))
    return raw.crossJoin(F.broadcast(detect_scale(gross, 40, 160))).withColumn("w", F.col("w") / F.col("divisor")).drop("median", "divisor")


def external_weights(raw: DataFrame, panel: DataFrame, normalize: bool = False) -> DataFrame:
    """(d, asset, w, is_rebal): each file day on the last session up to it; of several on one session the
    latest holds as a whole (what it leaves out is 0), then carried on. Names match whatever the case. normalize scales the rows of file days to a gross of 1, the days between stay."""
    x = scaled_weights(raw)
    latest = snap_dates(x, panel).groupBy("d").agg(F.max("file_d").alias("file_d"))
    names = panel.select("asset", F.upper("asset").alias("_u")).distinct()
    rows = x.select(F.col("d").alias("file_d"), F.upper(F.trim("asset")).alias("_u"), "w").join(latest, "file_d").join(names, "_u").select("d", "asset", "w")
    days = latest.select("d", F.lit(True).alias("is_rebal"))
    dense = panel.select("d", "asset").join(rows, ["d", "asset"], "left").join(days, "d", "left").withColumn("is_rebal", F.coalesce("is_rebal", F.lit(False)))
    dense = dense.withColumn("w", F.when(F.col("is_rebal"), F.coalesce("w", F.lit(0.0))))
    dense = dense.withColumn("w", F.coalesce(F.last("w", ignorenulls=True).over(W.partitionBy("asset").orderBy("d").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    if normalize:
        gross = F.sum(F.abs("w")).over(W.partitionBy("d"))
        dense = dense.withColumn("g", gross).withColumn("w", F.when(F.col("is_rebal") & (F.col("g") > 0), F.col("w") / F.nullif("g", F.lit(0.0))).otherwise(F.col("w"))).drop("g")
    return dense


def weights_report(dense: DataFrame, max_leverage: float = 1.0) -> DataFrame:
    """(rebalances, mean_gross, max_gross, over, under, instruments) of the file's days."""
    day = dense.where("is_rebal").groupBy("d").agg(F.sum(F.abs("w")).alias("g"))
    used = dense.where("is_rebal").groupBy("asset").agg(F.sum(F.abs("w")).alias("s")).agg(F.count_if(F.col("s") > 0).alias("instruments"))
    a = day.agg(F.count("*").alias("rebalances"), F.avg("g").alias("mean_gross"), F.max("g").alias("max_gross"), F.count_if(F.col("g") > max_leverage + 1e-9).alias("over"), F.count_if(F.col("g") < 0.99).alias("under"))
    return a.crossJoin(used)


def scaled_returns(raw: DataFrame) -> DataFrame:
    """Returns as fractions: divided by 100 if the median size is over 0.05."""
    return raw.crossJoin(F.broadcast(detect_scale(raw.select(F.abs("ret").alias("g")), 0.05 + 1e-15, float("inf")))).withColumn("ret", F.col("ret") / F.col("divisor")).drop("median", "divisor")


def returns_sanity(rows: DataFrame) -> DataFrame:
    """(n, missing, extreme, negatives)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret").isNull()).alias("missing"), F.count_if(F.abs("ret") > 1).alias("extreme"), F.count_if(F.col("ret") < 0).alias("negatives"))


def name_report(raw: DataFrame, panel: DataFrame) -> DataFrame:
    """(asset, state): names of the file outside the universe (unknown), and assets without a weight (absent)."""
    file, own = (df.select(F.trim("asset").alias("asset"), F.upper(F.trim("asset")).alias("_u")).distinct() for df in (raw, panel))
    unknown = file.join(own, "_u", "left_anti").select("asset", F.lit("unknown").alias("state"))
    return unknown.unionByName(own.join(file, "_u", "left_anti").select("asset", F.lit("absent").alias("state")))


def weight_flags(dense: DataFrame, normalize: bool = False, max_leverage: float = 1.0, idle: int = 60) -> DataFrame:
    """(flag, n): what is worth a warning in imported weights: short positions, days over and under budget, and
    sessions before the first file day."""
    day = dense.groupBy("d").agg(F.max("is_rebal").alias("is_rebal"), F.sum(F.abs("w")).alias("g"), F.min("w").alias("low"))
    day = positions(day, [], "k").withColumn("k", F.col("k") - 1)
    one = day.agg(F.count_if(F.col("low") < -1e-9).alias("shorts"), F.count_if(F.col("is_rebal") & (F.col("g") > max_leverage + 1e-9)).alias("over"), F.count_if(F.col("is_rebal") & (F.col("g") < 0.99) & F.lit(not normalize)).alias("under"), F.coalesce(F.min(F.when(F.col("is_rebal"), F.col("k"))), F.lit(0)).cast("long").alias("idle"))
    one = one.withColumn("idle", F.when(F.col("idle") > idle, F.col("idle")).otherwise(0))
    return one.unpivot([], ["shorts", "over", "under", "idle"], "flag", "n").where("n > 0")


def prepared_returns(raw: DataFrame, scale: str = "auto") -> DataFrame:
    """(d, series, ret): the return streams of a file as fractions, a missing value 0 on every day of the file.
    scale: auto (percentages if the median size over all series is over 0.05), decimal or percentage."""
    if scale == "auto":
        x = scaled_returns(raw.where("ret IS NOT NULL AND NOT isnan(ret)"))
    else:
        x = raw.withColumn("ret", F.col("ret") / (100.0 if scale == "percentage" else 1.0))
    every = raw.select("d").distinct().crossJoin(raw.select("series").distinct())
    return every.join(x.select("d", "series", "ret"), ["d", "series"], "left").select("d", "series", F.coalesce(F.nanvl("ret", F.lit(None).cast("double")), F.lit(0.0)).alias("ret"))


def return_flags(rows: DataFrame) -> DataFrame:
    """(flag, n) of prepared streams: no loss anywhere, values over 100 %, too few days for their frequency."""
    f = stream_frequency(rows).select("frequency", "periods")
    one = rows.agg(F.count_if(F.col("ret") < 0).alias("losses"), F.count_if(F.abs("ret") > 1).alias("extreme"), F.countDistinct("d").alias("days")).crossJoin(f)
    thin = (F.col("frequency").isin("daily", "weekly") & (F.col("days") < 60)) | ((F.col("frequency") == "monthly") & (F.col("days") < 24))
    flags = F.array(F.when(F.col("losses") == 0, F.struct(F.lit("no_losses").alias("flag"), F.col("days").alias("n"))), F.when(F.col("extreme") > 0, F.struct(F.lit("extreme").alias("flag"), F.col("extreme").alias("n"))), F.when(thin, F.struct(F.lit("thin").alias("flag"), F.col("days").alias("n"))))
    return one.select(F.inline(F.array_compact(flags)))
