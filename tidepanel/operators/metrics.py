"""Statistics of return streams: rows (run_id, d, ret[, nav]) in, one row a run out unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan as S

#: What tells streams apart.
RUN = ["run_id"]
FLAT = 1e-5
#: A day that loses (a month that gains) less is one of rounding, as those without a position are.
NOISE = 1e-12


def equity_curve(rows: DataFrame, initial: float = 1.0, by: list[str] = RUN) -> DataFrame:
    """nav: compounded returns, a missing one counted as 0."""
    return S.running_product(rows, by, 1 + F.coalesce("ret", F.lit(0.0)), "nav").withColumn("nav", initial * F.col("nav"))


def drawdown(rows: DataFrame, by: list[str] = RUN) -> DataFrame:
    """dd: nav over its highest so far, less 1."""
    return S.running_max(rows, by, "nav", "_high").withColumn("dd", F.col("nav") / F.col("_high") - 1).drop("_high")


def ratio(mean: Column, sd: Column, ppy: int) -> Column:
    return F.when(sd > FLAT, mean / F.when(sd > FLAT, sd) * ppy**0.5)


def statistics(rows: DataFrame, rf: float = 0.0, ppy: int = 252, by: str = "run_id", span: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate for all: total_return, cagr, vol, sharpe, sortino, mdd, calmar, ulcer, skew, kurtosis,
    best, worst, positive, n. rows: ret and nav; the worst loss is counted from the first nav of `by`. span: start and end
    too; extra: further aggregates."""
    x = drawdown(rows, [by]).withColumn("ex", F.col("ret") - rf / ppy)
    n = F.count("ret").cast("double")
    g1, g2 = F.skewness("ret"), F.kurtosis("ret")
    agg = x.groupBy(by).agg(
        F.min("d").alias("start"), F.max("d").alias("end"), *[c.alias(k) for k, c in (extra or {}).items()],
        F.count(F.lit(1)).alias("n"), F.min_by("nav", "d").alias("first"), F.max_by("nav", "d").alias("last"), F.stddev_samp("ret").alias("sd"),
        F.avg("ex").alias("mean"), F.stddev_samp("ex").alias("sx"), F.stddev_samp(F.when(F.col("ex") < -NOISE, F.col("ex"))).alias("sn"), F.min("dd").alias("mdd"),
        F.sqrt(F.avg(F.pow(100 * F.col("dd"), F.lit(2.0)))).alias("ulcer"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("positive"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )
    cagr = F.when((F.col("n") >= 2) & (F.col("first") > 0), F.pow(F.col("last") / F.when(F.col("first") > 0, F.col("first")), F.lit(float(ppy)) / F.col("n")) - 1)
    out = agg.withColumn("cagr", cagr)
    return out.select(by, *(["start", "end"] if span else []), "n", (F.col("last") / F.nullif("first", F.lit(0.0)) - 1).alias("total_return"), "cagr", (F.col("sd") * ppy**0.5).alias("vol"), ratio(F.col("mean"), F.col("sx"), ppy).alias("sharpe"), ratio(F.col("mean"), F.col("sn"), ppy).alias("sortino"), "mdd", F.try_divide("cagr", F.abs("mdd")).alias("calmar"), "ulcer", "skew", "kurtosis", "best", "worst", "positive", *(extra or {}))


def drawdown_table(rows: DataFrame, top: int = 5) -> DataFrame:
    """(run_id, start, trough, recovery, drawdown, days_to_trough, total_days): the deepest episodes. An
    episode begins where the value falls below its high and ends where it is back; recovery is null while open."""
    low = F.col("dd") < 0
    carries = {"_k0": lambda o: F.coalesce(F.sum("_n").over(S.before(o)), F.lit(0)), "_high0": lambda o: F.last("_peak", ignorenulls=True).over(S.before(o)), "_after": lambda o: F.lead("_first").over(o)}
    x = S.carried(drawdown(rows), RUN, {"_n": F.count(F.lit(1)), "_peak": F.max(F.when(~low, F.col("d"))), "_first": F.min("d")}, carries)
    days = W.partitionBy(*RUN, "_b").orderBy("d")
    x = x.withColumn("k", F.col("_k0") + F.row_number().over(days)).withColumn("next_d", F.coalesce(F.lead("d").over(days), "_after"))
    # the last day at a high tells episodes apart
    x = x.withColumn("high", F.coalesce(F.last(F.when(~low, F.col("d")), ignorenulls=True).over(S.within(RUN)), "_high0"))
    e = x.where(low).groupBy("run_id", "high").agg(F.min("d").alias("start"), F.min_by("d", F.struct("dd", "d")).alias("trough"), F.min("dd").alias("drawdown"), F.min("k").alias("k0"), F.min_by("k", F.struct("dd", "d")).alias("k1"), F.max("k").alias("k2"), F.max_by("next_d", "d").alias("recovery"))
    total = F.col("k2") - F.col("k0") + F.when(F.col("recovery").isNotNull(), 2).otherwise(1)
    e = e.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy("drawdown", "start"))).where(F.col("place") <= top)
    return e.select("run_id", "start", "trough", "recovery", "drawdown", (F.col("k1") - F.col("k0") + 1).cast("long").alias("days_to_trough"), total.cast("long").alias("total_days"))


def var_cvar(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """(run_id, var, cvar): the quantile of returns, and the mean of those up to it."""
    q = S.quantiles(rows, "ret", [level], RUN).select("run_id", F.col("q")[0].alias("var"))
    return rows.join(q, "run_id").groupBy("run_id", "var").agg(F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"))


def beta_alpha(rows: DataFrame, bench: DataFrame, rf: float = 0.0, ppy: int = 252) -> DataFrame:
    """(run_id, beta, alpha, corr, r2, tracking_error, information_ratio) on common days, null under 30."""
    b = bench.select("d", F.col("ret").alias("b"))
    x = rows.join(b, "d").where("ret IS NOT NULL AND b IS NOT NULL").withColumn("y", F.col("ret") - rf / ppy).withColumn("x", F.col("b") - rf / ppy)
    a = x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("y", "x").alias("cov"), F.var_samp("x").alias("var"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.corr("y", "x").alias("c"), F.avg(F.col("ret") - F.col("b")).alias("am"), F.stddev_samp(F.col("ret") - F.col("b")).alias("asd"))
    enough = F.col("n") >= 30
    beta = F.try_divide("cov", F.nullif("var", F.lit(0.0)))
    te = F.col("asd") * ppy**0.5
    cols = {"beta": beta, "alpha": (F.col("my") - beta * F.col("mx")) * ppy, "corr": F.col("c"), "r2": F.col("c") * F.col("c"), "tracking_error": te, "information_ratio": F.try_divide(F.col("am") * ppy, F.nullif(te, F.lit(0.0)))}
    return a.select("run_id", *[F.when(enough, v).alias(k) for k, v in cols.items()])


def monthly_returns(rows: DataFrame) -> DataFrame:
    """(run_id, month, ret): compounded by month; a month without rows inside the span has 0."""
    m = rows.groupBy("run_id", F.trunc("d", "month").alias("month")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    span = m.groupBy("run_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select("run_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(m, ["run_id", "month"], "left").select("run_id", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_pivot(rows: DataFrame) -> DataFrame:
    """(run_id, year, m1..m12)."""
    m = monthly_returns(rows).select("run_id", F.year("month").cast("long").alias("year"), F.month("month").alias("m"), "ret")
    return m.groupBy("run_id", "year").agg(*[F.max(F.when(F.col("m") == k, F.col("ret"))).alias(f"m{k}") for k in range(1, 13)])


def rolling_sharpe(rows: DataFrame, window: int = 252, ppy: int = 252) -> DataFrame:
    x, over = S.halo(S.positions(rows, RUN, "_k"), RUN, "_k", window)
    sd = F.nullif(over(F.stddev_samp("ret")), F.lit(0.0))
    x = x.withColumn("rolling_sharpe", F.when(over(F.count("ret")) >= window, F.try_divide(over(F.avg("ret")), sd) * ppy**0.5))
    return x.where("_own").drop("_k", "_blk", "_own")


#: Assets of one side of a tile.
SIDE = 256


def correlation_matrix(panel: DataFrame) -> DataFrame:
    """(a, b, corr) of returns (column r) of every two assets, on the days both have one. Assets are cut in groups
    of SIDE and days in years: a tile is two groups in a year, its co-moments are matrix products, centred in
    the tile, and tiles are merged by pair. Each row is sent once for every group that its own meets."""
    rows = panel.where("r IS NOT NULL").select("d", "asset", "r")
    names = rows.select("asset").distinct()
    names = names.select("asset", F.expr(f"(row_number() OVER (ORDER BY asset) - 1) div {SIDE}").alias("g"))
    groups = names.agg((F.coalesce(F.max("g"), F.lit(-1)) + 1).alias("m"))
    x = rows.join(names, "asset").crossJoin(F.broadcast(groups)).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    x = x.select("d", "asset", "r", "g", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), F.trunc("d", "year").alias("m"))

    def tile(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot(index="d", columns="asset", values="r").sort_index(axis=1)
        side = pdf.drop_duplicates("asset").set_index("asset")["g"].reindex(wide.columns).to_numpy()
        low, high = pdf["i"].iat[0], pdf["j"].iat[0]
        v = wide.to_numpy()
        ok = ~np.isnan(v)
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        mean = np.where(ok.any(0), np.nansum(v, 0) / np.maximum(ok.sum(0), 1), 0)
        c, k = np.where(ok, v - mean, 0), ok.astype(float)
        # of the days both have a value: number, sums and products of what is left of the assets' own means
        a, b, ka, kb = c[:, left], c[:, right], k[:, left], k[:, right]
        n, sx, sy = ka.T @ kb, a.T @ kb, ka.T @ b
        some = np.maximum(n, 1)
        out = {"n": n, "mx": mean[left][:, None] + sx / some, "my": mean[right][None, :] + sy / some, "xx": (a * a).T @ kb - sx * sx / some, "yy": ka.T @ (b * b) - sy * sy / some, "xy": a.T @ b - sx * sy / some}
        p, q = np.nonzero((n > 0) & (wide.columns.to_numpy()[left][:, None] <= wide.columns.to_numpy()[right][None, :]))
        names_ = wide.columns.to_numpy()
        return pd.DataFrame({"a": names_[left[p]], "b": names_[right[q]], **{key: val[p, q] for key, val in out.items()}})

    t = x.groupBy("i", "j", "m").applyInPandas(tile, "a string, b string, n double, mx double, my double, xx double, yy double, xy double")
    # about the means of all: what is within years, and the years' means about the whole
    t = t.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy"), F.collect_list(F.struct("n", "mx", "my")).alias("means"))
    mean = lambda c: F.aggregate("means", F.lit(0.0), lambda s, m: s + m["n"] * m[c]) / F.col("n")
    t = t.withColumn("mx", mean("mx")).withColumn("my", mean("my"))
    spread = lambda c, e: F.aggregate("means", F.lit(0.0), lambda s, m: s + m["n"] * (m[c] - F.col(c)) * (m[e] - F.col(e)))
    xx, yy, xy = F.col("xx") + spread("mx", "mx"), F.col("yy") + spread("my", "my"), F.col("xy") + spread("mx", "my")
    half = t.select("a", "b", F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)).alias("corr"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(both).alias("p"), "corr").select("p.a", "p.b", "corr")


def return_histogram(rows: DataFrame, bins: int = 90) -> DataFrame:
    """(bin, n): equal bins between the least and the largest return."""
    lim = rows.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * bins))
    return rows.crossJoin(lim).where("ret IS NOT NULL").groupBy(F.coalesce(k, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_line(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """(run_id, line): the quantile that a histogram of returns in percent marks."""
    return S.quantiles(rows, "ret", [level], RUN).select("run_id", (100 * F.col("q")[0]).alias("line"))


def income_summary(days: DataFrame, ppy: int = 252) -> DataFrame:
    """(run_id, total, per_year, payment_days) of simulated runs: income as a share of the portfolio's value."""
    years = F.greatest(F.count(F.lit(1)) / ppy, F.lit(1e-9))
    return days.groupBy("run_id").agg(F.sum("div_income").alias("total"), (F.sum("div_income") / years).alias("per_year"), F.count_if(F.col("div_income") > 0).alias("payment_days"))


def cumulative_income(days: DataFrame) -> DataFrame:
    """(run_id, d, cumulative): income so far, in percent."""
    x = S.running_sum(days.select("run_id", "d", "div_income"), RUN, 100 * F.col("div_income"), "cumulative")
    return x.select("run_id", "d", "cumulative")


_PERCENT = {"total_return", "cagr", "vol", "mdd", "best", "worst", "positive", "alpha", "tracking_error"}


def format_metric(metric: Column, value: Column) -> Column:
    """Percentages with two digits, other numbers too, a dash for none."""
    return F.when(value.isNull(), "—").when(metric.isin(*_PERCENT), F.concat(F.format_number(value * 100, 2), F.lit("%"))).otherwise(F.format_number(value, 2))


def summary(stats: DataFrame) -> DataFrame:
    """(run_id, metric, value) of a statistics table."""
    cols = [c for c in stats.columns if c != "run_id"]
    return stats.select("run_id", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("run_id", cols, "metric", "value")


def report(rows: DataFrame, bench: DataFrame | None = None, rf: float = 0.0, ppy: int = 252) -> DataFrame:
    """(run_id, metric, value): all that a report shows of runs (run_id, d, ret, nav[, turnover, exposure]):
    the statistics, VaR and CVaR, months, turnover and exposure, and with bench (d, ret) the regression on it."""
    names = {"total_return": "total_return", "cagr": "cagr", "vol": "vol", "sharpe": "sharpe", "sortino": "sortino", "calmar": "calmar", "mdd": "mdd", "ulcer": "ulcer", "skew": "skew", "kurtosis": "kurtosis"}
    out = statistics(rows, rf, ppy).select("run_id", *names).join(var_cvar(rows), "run_id")
    m = monthly_returns(rows).groupBy("run_id").agg(F.avg((F.col("ret") > NOISE).cast("double")).alias("positive_months"), F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"))
    out = out.join(m, "run_id")
    extra = []
    if "turnover" in rows.columns:
        extra.append((F.sum("turnover") / (F.count("ret") / ppy)).alias("annual_turnover"))
    if "exposure" in rows.columns:
        extra.append(F.avg("exposure").alias("average_exposure"))
    if extra:
        out = out.join(rows.groupBy("run_id").agg(*extra), "run_id")
    if bench is not None:
        out = out.join(beta_alpha(rows, bench, rf, ppy).drop("corr"), "run_id", "left")
    return summary(out)
