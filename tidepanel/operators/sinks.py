"""Result tables as files, and templates to fill in. Every writer takes a folder and leaves CSV parts in it."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics as M


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def current_holdings(weights: DataFrame, days: DataFrame) -> DataFrame:
    """(run_id, instrument, weight, value): what is held on a run's last day, largest first, and cash.
    weights: run_id, d, asset, w; days: run_id, d, nav, cash_w."""
    last = days.groupBy("run_id").agg(F.max_by(F.struct("d", "nav", "cash_w"), "d").alias("x")).select("run_id", "x.*")
    held = weights.join(last.select("run_id", "d", "nav"), ["run_id", "d"]).where(F.abs("w") > 1e-6)
    held = held.select("run_id", F.col("asset").alias("instrument"), F.col("w").alias("weight"), (F.col("w") * F.col("nav")).alias("value"))
    cash = last.select("run_id", F.lit("Cash").alias("instrument"), F.col("cash_w").alias("weight"), (F.col("cash_w") * F.col("nav")).alias("value"))
    return held.unionByName(cash)


def holdings_history(weights: DataFrame, assets: list[str]) -> DataFrame:
    """A row a day, a column an asset."""
    return weights.groupBy("run_id", "d").pivot("asset", assets).agg(F.first("w"))


def daily_series(days: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """(d, value, return, exposure, cash, turnover, costs[, benchmark]) by run; the benchmark (d, nav) on its days."""
    out = days.select("run_id", "d", F.col("nav").alias("value"), F.col("ret").alias("return"), "exposure", F.col("cash_w").alias("cash"), "turnover", F.col("cost").alias("costs"))
    return out.join(bench.select("d", F.col("nav").alias("benchmark")), "d", "left") if bench is not None else out


def stream_series(rows: DataFrame, bench: DataFrame | None = None, initial: float = 100_000.0) -> DataFrame:
    """(d, return, value[, benchmark_return, benchmark_value]) of return streams (run_id, d, ret)."""
    w = W.partitionBy("run_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    grown = lambda c: initial * F.product(1 + F.coalesce(c, F.lit(0.0))).over(w)
    out = rows.select("run_id", "d", F.col("ret").alias("return"), grown("ret").alias("value"))
    if bench is None:
        return out
    return out.join(bench.select("d", F.col("ret").alias("benchmark_return")), "d", "left").withColumn("benchmark_value", grown("benchmark_return"))


def workbook(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder for each sheet; the names written."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    return sorted(tables)


def weights_template(spark: SparkSession, assets: list[str], months: int = 3) -> DataFrame:
    """(Date, one column an asset): equal weights on month ends from 2020-01-31."""
    share = round(1 / max(1, len(assets)), 4)
    days = spark.range(months).select(F.last_day(F.add_months(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("Date"))
    return days.select("Date", *[F.lit(share).alias(a) for a in assets])


def returns_template(spark: SparkSession, daily: bool = False, rows: int = 6) -> DataFrame:
    """(Date, Strategy, Benchmark): made-up returns by month ends, or by weekdays from 2020-01-01."""
    k = F.col("id").cast("int")
    day = F.date_add(F.lit("2020-01-01").cast("date"), k + F.when(k >= 3, 2).otherwise(0)) if daily else F.last_day(F.add_months(F.lit("2020-01-01").cast("date"), k))
    return spark.range(rows).select(day.alias("Date"), F.round(0.006 + 0.03 * F.randn(0), 4).alias("Strategy"), F.round(0.005 + 0.035 * F.randn(1), 4).alias("Benchmark"))


#: Statistics that head a page.
HEAD = ("cagr", "vol", "sharpe", "sortino", "calmar", "mdd")


def report_tables(days: DataFrame, weights: DataFrame | None = None, bench: DataFrame | None = None, ppy: int = 252) -> dict[str, DataFrame]:
    """What a report's page shows of one run (run_id, d, ret, nav[, turnover, exposure, cash_w]), each a table of
    bounded size: head, statistics (with the regression on bench), drawdowns, months and, with weights, holdings."""
    stats = M.report(days, bench, ppy=ppy).select("metric", "value")
    out = {"head": stats.where(F.col("metric").isin(*HEAD)).select("metric", M.format_metric(F.col("metric"), F.col("value")).alias("value"))}
    out["statistics"] = stats.orderBy("metric")
    out["drawdowns"] = M.drawdown_table(days).drop("run_id").orderBy("drawdown")
    out["months"] = M.monthly_pivot(days).drop("run_id").orderBy("year")
    if weights is not None:
        out["holdings"] = current_holdings(weights, days).drop("run_id").orderBy(F.desc(F.abs("weight")), "instrument").limit(TOP_HOLDINGS)
    return out


#: Holdings on a page, the largest.
TOP_HOLDINGS = 30


def _cell(x) -> str:
    return "–" if x is None else f"{x:,.4f}" if isinstance(x, float) else html.escape(str(x))


def report_page(title: str, tables: dict[str, DataFrame], config: str = "") -> str:
    """One HTML page of report_tables: tiles of the head, then a table each. The rows of tables that don't grow with
    a run come to the driver."""
    tiles = "".join(f"<li><b>{_cell(r.metric)}</b> {_cell(r.value)}</li>" for r in tables["head"].collect())
    parts = []
    for name, df in tables.items():
        if name != "head":
            body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in row) + "</tr>" for row in df.collect())
            parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{body}</table>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{tiles}</ul>{''.join(parts)}<pre>{html.escape(config)}</pre>"


def tearsheet(title: str, stats: DataFrame, config: str = "") -> str:
    """One HTML page of a statistics table (metric, value): a row for each metric."""
    rows = "".join(f"<tr><td>{html.escape(r.metric)}</td><td>{'-' if r.value is None else f'{r.value:,.4f}'}</td></tr>" for r in stats.orderBy("metric").collect())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{rows}</table><pre>{html.escape(config)}</pre>"
