"""Joins in time, calendars and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan as S


def exog_asof(exog: DataFrame, calendar: DataFrame, lag_days: int = 1, ffill_limit: int | None = None) -> DataFrame:
    """(d, series, v): on each day of the calendar, each series' last value published `lag_days` before, if at
    most ffill_limit rows (its days and the calendar's, together) lie after it. Months of a series
    are worked on apart, each with the last value before it; no range join."""
    names = exog.select("series").distinct()
    known = exog.select("series", F.date_add("d", lag_days).alias("d"), "v", F.lit(0).alias("src"))
    asked = calendar.select("d").distinct().crossJoin(names).select("series", "d", F.lit(None).cast("double").alias("v"), F.lit(1).alias("src"))
    if ffill_limit is None:
        return S.last_known(known.unionByName(asked), ["series"], F.col("v"), "v", "src").where("src = 1").select("d", "series", "v")
    both = S.positions(known.unionByName(asked).groupBy("series", "d").agg(F.max("v").alias("v"), F.max("src").alias("src")), ["series"], "_k")
    both = S.last_known(both, ["series"], F.when(F.col("v").isNotNull(), F.struct("v", "_k")), "_s")
    return both.where("src = 1").select("d", "series", F.when(F.col("_k") - F.col("_s")["_k"] <= ffill_limit, F.col("_s")["v"]).alias("v"))


def snap_dates(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(file_d, d): the last day of the calendar up to each date; dates before all of it go."""
    asked = dates.select(F.col("d").alias("file_d")).distinct().select("file_d", F.col("file_d").alias("d"), F.lit(None).cast("date").alias("at"), F.lit(1).alias("src"))
    known = calendar.select(F.lit(None).cast("date").alias("file_d"), "d", F.col("d").alias("at"), F.lit(0).alias("src")).distinct()
    x = S.last_known(known.unionByName(asked), [], F.col("at"), "at", "src")
    return x.where("src = 1 AND at IS NOT NULL").select("file_d", F.col("at").alias("d"))


#: Rule -> the period that a day belongs to.
PERIODS = {
    "weekly": lambda d: F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)).cast("int")),
    "monthly": lambda d: F.trunc(d, "month"),
    "quarterly": lambda d: F.trunc(d, "quarter"),
    "annual": lambda d: F.trunc(d, "year"),
    "daily": lambda d: d,
}


def rebalance_calendar(calendar: DataFrame, rule: str) -> DataFrame:
    """(d): the last day of the calendar in each period; of an unknown rule, every day."""
    period = PERIODS.get(rule, PERIODS["daily"])
    return calendar.select("d").distinct().groupBy(period(F.col("d")).alias("p")).agg(F.max("d").alias("d")).select("d")


def signal_to_exec_dates(signals: DataFrame, calendar: DataFrame, lag: int) -> DataFrame:
    """(signal_d, d): the day `lag` places after each signal; those past the end go."""
    cal = calendar.select("d", "n").distinct()
    at = signals.join(cal, "d", "left_semi").join(cal, "d").select(F.col("d").alias("signal_d"), (F.col("n") + lag).alias("n"))
    return at.join(cal, "n").select("signal_d", "d")


def _median_gap(dates: DataFrame) -> DataFrame:
    """(median_gap, k): of the days between neighbours of a set of dates, and how many gaps there are."""
    gaps = S.lagged(dates.select("d").distinct(), [], F.col("d"), "_p").select(F.datediff("d", "_p").cast("double").alias("g"))
    # a gap is a whole number of days, so counts of each length say all
    sizes = gaps.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy("g"))
    k = F.sum("c").over(W.partitionBy())
    x = sizes.select("g", upto.alias("upto"), k.alias("k"))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("g")))
    return x.agg(((at(F.floor((F.col("k") - 1) / 2)) + at(F.ceil((F.col("k") - 1) / 2))) / 2).alias("median_gap"), F.coalesce(F.max("k"), F.lit(0)).alias("k"))


def frequency(dates: DataFrame) -> DataFrame:
    """(median_gap, frequency) of a set of dates."""
    name = F.when(F.col("k") < 2, "undetermined")
    for limit, said in ((1.5, "daily"), (4, "business-daily"), (10, "weekly"), (45, "monthly"), (135, "quarterly"), (250, "semi-annual")):
        name = name.when(F.col("median_gap") <= limit, said)
    return _median_gap(dates).select("median_gap", name.otherwise("annual").alias("frequency"))


def stream_frequency(dates: DataFrame) -> DataFrame:
    """(median_gap, frequency, periods): of a return stream, with the periods of a year."""
    kind = F.when(F.col("k") < 2, F.struct(F.lit("undetermined").alias("frequency"), F.lit(252).alias("periods")))
    for limit, name, periods in ((4, "daily", 252), (10, "weekly", 52), (45, "monthly", 12), (135, "quarterly", 4), (250, "semi-annual", 2)):
        kind = kind.when(F.col("median_gap") <= limit, F.struct(F.lit(name).alias("frequency"), F.lit(periods).alias("periods")))
    x = _median_gap(dates).select("median_gap", kind.otherwise(F.struct(F.lit("annual").alias("frequency"), F.lit(1).alias("periods"))).alias("x"))
    return x.select("median_gap", "x.*")


def exog_flags(exog: DataFrame, calendar: DataFrame, lag_days: int = 1) -> DataFrame:
    """(series, flag): stale (last value over 180 days before the calendar's end), thin (under half of the
    calendar covered), and for the table as a whole (series null) lag: monthly or rarer, with a lag under 15 days."""
    end = calendar.agg(F.max("d").alias("end"))
    rep = exog_report(exog, calendar, lag_days).crossJoin(end)
    flags = F.array(F.when(F.col("last_d") < F.date_sub("end", 180), "stale"), F.when(F.col("coverage") < 50, "thin"))
    own = rep.select("series", F.explode(F.array_compact(flags)).alias("flag"))
    rare = frequency(exog).where(F.col("frequency").isin("monthly", "quarterly", "semi-annual", "annual") & F.lit(lag_days < 15))
    return own.unionByName(rare.select(F.lit(None).cast("string").alias("series"), F.lit("lag").alias("flag")))


def exog_report(exog: DataFrame, calendar: DataFrame, lag_days: int = 1) -> DataFrame:
    """(series, observations, first_d, last_d, coverage, first_usable)."""
    days = calendar.agg(F.countDistinct("d").alias("days"))
    seen = exog_asof(exog, calendar, lag_days).where("v IS NOT NULL").groupBy("series").agg(F.count("*").alias("c"), F.min("d").alias("first_usable"))
    own = exog.where("v IS NOT NULL").groupBy("series").agg(F.count("*").alias("observations"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    return own.join(seen, "series", "left").crossJoin(days).select("series", "observations", "first_d", "last_d", F.round(100 * F.coalesce("c", F.lit(0)) / F.greatest("days", F.lit(1)), 1).alias("coverage"), "first_usable")


def split_roles(exog: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series that are assets of the universe whatever the case (factors), and the others (macro)."""
    names = universe.select(F.upper("asset").alias("u")).distinct()
    key = F.upper(exog["series"]) == names["u"]
    return exog.join(names, key, "left_semi"), exog.join(names, key, "left_anti")


def detect_scale(gross: DataFrame, low: float, high: float) -> DataFrame:
    """(median, divisor): 100 if the median of column g lies between low and high; one row, also of no values."""
    median = S.quantiles(gross, "g", [0.5]).select(F.col("q")[0].alias("median")).agg(F.max("median").alias("median"))
    return median.select("median", F.when((F.col("median") >= low) & (F.col("median") <= high), 100.0).otherwise(1.0).alias("divisor"))
