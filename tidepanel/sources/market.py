"""The dense price panel and the tables beside it, from the order tables of a folder.

A panel is long: d date, n long (its place in the calendar), asset string, ord long (the asset's place in
the universe), and values; every asset has a row on every day of the calendar, null where it has no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scan as S
from .tables import derived


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trades(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset"))
    return lines.join(part, "l_partkey")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, asset, e, q): value and quantity of a day's trades by kind of part. Stored: all other tables of the
    trades come from it, so they are read once."""
    return derived(spark, "daily", _trades(sf_dir), (), lambda: _lines(spark, sf_dir).groupBy("d", "asset").agg(F.sum("l_extendedprice").alias("e"), F.sum("l_quantity").alias("q")))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d): the days of trade, from the trades' dates alone."""
    return _lines(spark, sf_dir).select("d").distinct()


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, asset, px): value over quantity of the last 60 days with trades."""
    x, over = S.halo(S.positions(daily(spark, sf_dir), ["asset"], "_k"), ["asset"], "_k", 60)
    return x.select("d", "asset", "_own", (over(F.sum("e")) / over(F.sum("q"))).alias("px")).where("_own").drop("_own")


def densify(rows: DataFrame, value: str = "px", keys: DataFrame | None = None) -> DataFrame:
    """(d, n, asset, ord, value) on calendar x universe, those of rows or of a table `keys` (d, asset) that has the
    same. Both sides are keys of the rows, so their product is the panel itself and nothing more."""
    keys = rows if keys is None else keys
    cal = S.positions(keys.select("d").distinct(), [], "n").select("d", F.col("n").cast("long").alias("n"))
    uni = keys.select("asset").distinct().select("asset", F.row_number().over(W.orderBy("asset")).cast("long").alias("ord"))
    return cal.crossJoin(uni).join(rows.select("d", "asset", value), ["d", "asset"], "left")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of prices as they are."""
    return densify(raw_prices(spark, sf_dir), keys=daily(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str, fill: int = 5) -> DataFrame:
    """The cleaned panel, stored: gaps of at most `fill` days are filled."""
    from ..operators.clean import bounded_ffill

    return derived(spark, "prices", _trades(sf_dir), (fill,), lambda: bounded_ffill(dense(spark, sf_dir), "px", fill))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, px): the whole market's price, stored."""

    def build():
        day = daily(spark, sf_dir).groupBy("d").agg(F.sum("e").alias("e"), F.sum("q").alias("q"))
        x, over = S.halo(S.positions(day, [], "_k"), [], "_k", 60)
        return x.select("d", "_own", (over(F.sum("e")) / over(F.sum("q"))).alias("px")).where("_own").drop("_own")

    return derived(spark, "benchmark", _trades(sf_dir), (), build)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, d, ret, nav): the whole market as a return stream, stored."""
    from ..operators import engine

    return derived(spark, "market", _trades(sf_dir), (), lambda: engine.benchmark_result(benchmark(spark, sf_dir)).select(F.lit("market").alias("run_id"), "d", "ret", "nav"))


def opens(panel: DataFrame) -> DataFrame:
    """(d, asset, px): an opening price a quarter of the way from the close before; none on days of a month's first."""
    before = F.lag("px").over(W.partitionBy("asset").orderBy("d"))
    return panel.select("d", "asset", F.when(F.dayofmonth("d") > 1, before + (F.col("px") - before) / 4).alias("px"))


def dividends(panel: DataFrame) -> DataFrame:
    """(d, asset, v): half a percent of the price on a quarter's last session."""
    last = panel.groupBy(F.trunc("d", "quarter").alias("q")).agg(F.max("d").alias("d")).select("d")
    return panel.join(last, "d", "left_semi").select("d", "asset", (F.col("px") * 0.005).alias("v"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, series, v): orders' total by month, on its last day. Stored: a sum of doubles made twice may differ in its
    last bits, and a month's days would then not be equal."""

    def build():
        month = read(spark, sf_dir, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("d"))
        return month.agg(F.sum("o_totalprice").alias("v")).select("d", F.lit("ORDERS").alias("series"), "v")

    return derived(spark, "macro", [f"{sf_dir}/orders.parquet"], (), build)


def factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, series, v): mean discount by quarter and kind of part, on the quarter's last day."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_discount")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("series"))
    end = F.last_day(F.add_months(F.trunc("d", "quarter"), 2))
    return lines.join(part, "l_partkey").groupBy(end.alias("d"), "series").agg(F.avg("l_discount").alias("v"))


def imported_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, asset, w): share of a month's value by kind of part, on the month's last day."""
    month = daily(spark, sf_dir).groupBy(F.last_day("d").alias("d"), "asset").agg(F.sum("e").alias("e"))
    return month.select("d", "asset", (F.col("e") / F.sum("e").over(W.partitionBy("d"))).alias("w"))


#: DuckDB: the same tables as common table expressions, to begin an oracle with.
SQL = """
WITH RECURSIVE day0 AS (SELECT CAST(l_shipdate AS DATE) AS d, p_type AS asset, SUM(l_extendedprice) AS e, SUM(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pxraw AS (SELECT d, asset, SUM(e) OVER w60 / SUM(q) OVER w60 AS px FROM day0 WINDOW w60 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
cal AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM pxraw)),
uni AS (SELECT asset, row_number() OVER (ORDER BY asset) AS ord FROM (SELECT DISTINCT asset FROM pxraw)),
dense AS (SELECT cal.d, n, uni.asset, ord, px FROM cal CROSS JOIN uni LEFT JOIN pxraw ON pxraw.d = cal.d AND pxraw.asset = uni.asset),
px AS (SELECT d, n, asset, ord, last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS px FROM dense),
pad AS (SELECT *, last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp FROM px),
ret AS (SELECT *, pp / lag(pp) OVER (PARTITION BY asset ORDER BY n) - 1 AS r FROM pad),
bench AS (SELECT d, SUM(e) OVER b60 / SUM(q) OVER b60 AS px FROM (SELECT d, SUM(e) AS e, SUM(q) AS q FROM day0 GROUP BY d) WINDOW b60 AS (ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
bret AS (SELECT d, px, row_number() OVER (ORDER BY d) AS n, px / lag(px) OVER (ORDER BY d) - 1 AS r0, coalesce(px / lag(px) OVER (ORDER BY d) - 1, 0) AS r FROM bench),
macro AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS d, 'ORDERS' AS series, SUM(o_totalprice) AS v FROM orders GROUP BY 1),
factor AS (SELECT CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS d, p_type AS series, AVG(l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
wimp AS (SELECT d, asset, e / SUM(e) OVER (PARTITION BY d) AS w FROM (SELECT last_day(d) AS d, asset, SUM(e) AS e FROM day0 GROUP BY 1, 2))
"""
