"""Every query by name, with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranks as RK
from ..functions import rolling as R
from ..operators import align as A
from ..operators import clean as C
from ..operators import engine as E
from ..operators import imports as I
from ..operators import metrics as M
from ..operators import robustness as B
from ..operators import scan as SC
from ..operators import sinks as K
from ..operators import strategies as S
from ..sources import market as D
from ..sources.tables import stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Short windows, so that the smallest tables have values too.
SHORT, LONG, SKIP = 20, 50, 21


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", others: str = "", digits: int = 6):
    """Registers a query. sql: common table expressions that end in a table `q`, or a whole statement if
    no columns are named; doubles and others: the columns to select from q."""

    def add(fn: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql is not None:
            cols = ", ".join([*others.split(), *(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())])
            _SQL[name] = f"{D.SQL.rstrip()},\n{sql.strip()}\nSELECT {cols} FROM q" if cols else sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- cleaning ----------------------------------------------------------------------------------


@query("densify", "q AS (SELECT *, ln(px) AS log_px FROM dense)", "log_px", "d n asset ord")
def _(spark, sf):
    return D.dense(spark, sf).select("d", "n", "asset", "ord", F.log("px").alias("log_px"))


@query("bounded_ffill", "q AS (SELECT *, ln(px) AS log_px FROM px)", "log_px", "d asset")
def _(spark, sf):
    return D.prices(spark, sf).select("d", "asset", F.log("px").alias("log_px"))


@query("normalize_index", """q AS (SELECT CAST(ts AS DATE) AS d, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)""", "v", "d event_type")
def _(spark, sf):
    rows = D.read(spark, sf, "events").withColumn("text", F.col("ts").cast("string"))
    return C.normalize_index(rows, "text", "event_id", "event_type").select("d", "event_type", F.col("value").alias("v"))


@query("drop_empty_assets", "q AS (SELECT d, asset, ln(px) AS log_px FROM dense WHERE ord <> 2)", "log_px", "d asset")
def _(spark, sf):
    p = D.dense(spark, sf).withColumn("px", F.when(F.col("ord") != 2, F.col("px")))
    return C.drop_empty_assets(p).select("d", "asset", F.log("px").alias("log_px"))


@query("neutralize_nonpositive", "q AS (SELECT d, asset, CASE WHEN px - 1500 > 0 THEN ln(px - 1500) END AS log_px FROM dense)", "log_px", "d asset")
def _(spark, sf):
    p = D.dense(spark, sf).withColumn("px", F.col("px") - 1500)
    return C.neutralize_nonpositive(p).select("d", "asset", F.log("px").alias("log_px"))


_REPORT = """rep AS (SELECT asset, min(d) FILTER (px IS NOT NULL) AS first_d, max(d) FILTER (px IS NOT NULL) AS last_d, count(px) AS observations, max(n) FILTER (px IS NOT NULL) - min(n) FILTER (px IS NOT NULL) + 1 AS span FROM dense GROUP BY asset)"""


@query("quality_report", _REPORT + ", q AS (SELECT *, span - observations AS gaps, round(100.0 * (span - observations) / span, 2) AS pct_missing FROM rep)", "pct_missing", "asset first_d last_d observations gaps")
def _(spark, sf):
    return C.quality_report(D.dense(spark, sf))


@query("quality_flags", _REPORT + """, f AS (SELECT asset, unnest([CASE WHEN first_d > (SELECT min(first_d) FROM rep) THEN 'short_history' END, CASE WHEN span > observations THEN 'gaps' END, CASE WHEN observations < 60 THEN 'too_few' END]) AS flag FROM rep), q AS (SELECT * FROM f WHERE flag IS NOT NULL)""", "", "asset flag")
def _(spark, sf):
    return C.quality_flags(C.quality_report(D.dense(spark, sf)))


@query("quality_warnings", """hd AS (SELECT * FROM dense WHERE ord <> 2), hr AS (SELECT asset, min(d) FILTER (px IS NOT NULL) AS first_d, count(px) AS k, max(n) FILTER (px IS NOT NULL) - min(n) FILTER (px IS NOT NULL) + 1 AS span FROM hd GROUP BY asset), days AS (SELECT count(DISTINCT d) AS k, min(d) AS d0 FROM dense),
q AS (SELECT asset, 'short_history' AS flag FROM hr, days WHERE first_d > d0 UNION ALL SELECT asset, 'gaps' FROM hr WHERE span > k UNION ALL SELECT asset, 'dropped' FROM uni WHERE ord = 2 UNION ALL SELECT NULL, 'too_few' FROM days WHERE k < 5000)""", "", "asset flag")
def _(spark, sf):
    p = D.dense(spark, sf).withColumn("px", F.when(F.col("ord") != 2, F.col("px")))
    return C.quality_warnings(p, 5000)


@query("sanitize_weights", "q AS (SELECT px.d, px.asset, CASE WHEN px.px IS NOT NULL THEN coalesce(w, 0) ELSE 0 END AS w FROM px LEFT JOIN wimp ON px.d = wimp.d AND px.asset = wimp.asset)", "w", "d asset")
def _(spark, sf):
    return C.sanitize_weights(D.imported_weights(spark, sf), D.prices(spark, sf)).select("d", "asset", "w")


@query("leverage_cap", "g AS (SELECT *, sum(abs(3 * w)) OVER (PARTITION BY d) AS g FROM wimp), q AS (SELECT d, asset, CASE WHEN g > 1.5 THEN 3 * w * 1.5 / g ELSE 3 * w END AS w FROM g)", "w", "d asset")
def _(spark, sf):
    return C.leverage_cap(D.imported_weights(spark, sf).withColumn("w", F.col("w") * 3), 1.5)


@query("execution_lag", "q AS (SELECT d, asset, coalesce(lag(w, 2) OVER (PARTITION BY asset ORDER BY d), 0) AS w FROM wimp)", "w", "d asset")
def _(spark, sf):
    return C.execution_lag(D.imported_weights(spark, sf), 2)


@query("normalized_prices", "q AS (SELECT d, asset, px / first_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100 AS px FROM px)", "px", "d asset")
def _(spark, sf):
    return C.normalized_prices(D.prices(spark, sf)).select("d", "asset", "px")


@query("parse_tickers", "SELECT DISTINCT upper(trim(t)) AS ticker FROM (SELECT unnest(string_split_regex(p_name || ', ' || p_brand || ';' || p_type, '[\\n,;]')) AS t FROM part) WHERE trim(t) <> ''")
def _(spark, sf):
    text = F.concat_ws("", "p_name", F.lit(", "), "p_brand", F.lit(";"), "p_type")
    t = D.read(spark, sf, "part").select(F.explode(F.split(text, "[\n,;]")).alias("t"))
    return t.where(F.trim("t") != "").select(F.upper(F.trim("t")).alias("ticker")).distinct()


@query("long_to_wide_last", "q AS (SELECT CAST(ts AS DATE) AS d, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)", "click view", "d")
def _(spark, sf):
    e = D.read(spark, sf, "events").where(F.col("event_type").isin("click", "view") & F.col("value").isNotNull())
    return e.groupBy(F.to_date("ts").alias("d")).pivot("event_type", ["click", "view"]).agg(F.max_by("value", "event_id"))


# ---- joins in time -----------------------------------------------------------------------------


@query("exog_asof", "q AS (SELECT cal.d, 'ORDERS' AS series, v FROM cal ASOF LEFT JOIN (SELECT d + 5 AS d, v FROM macro) m ON cal.d >= m.d)", "v", "d series")
def _(spark, sf):
    return A.exog_asof(D.macro(spark, sf), D.calendar(spark, sf), 5)


@query("exog_asof_limit", "eu AS (SELECT d, max(v) AS v, bool_or(c) AS c FROM (SELECT d + 5 AS d, v, false AS c FROM macro UNION ALL SELECT d, NULL, true FROM cal) GROUP BY d), el AS (SELECT d, c, last_value(v IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS v FROM eu), q AS (SELECT d, 'ORDERS' AS series, v FROM el WHERE c)", "v", "d series")
def _(spark, sf):
    return A.exog_asof(D.macro(spark, sf), D.calendar(spark, sf), 5, 10)


@query("snap_dates", "q AS (SELECT f.d AS file_d, cal.d AS d FROM (SELECT DISTINCT d FROM wimp) f ASOF JOIN cal ON f.d >= cal.d)", "", "file_d d")
def _(spark, sf):
    return A.snap_dates(D.imported_weights(spark, sf), D.daily(spark, sf))


_PERIOD = {"weekly": "d + CAST((6 - (dayofweek(d) + 1) + 7) % 7 AS INTEGER)", "monthly": "date_trunc('month', d)", "quarterly": "date_trunc('quarter', d)", "annual": "date_trunc('year', d)"}
for _rule, _p in _PERIOD.items():

    @query(f"rebalance_{_rule}", f"q AS (SELECT max(d) AS d FROM cal GROUP BY {_p})", "", "d")
    def _(spark, sf, rule=_rule):
        return A.rebalance_calendar(D.calendar(spark, sf), rule)


@query("rebalance_semi", "q AS (SELECT DISTINCT d FROM wimp WHERE d IN (SELECT d FROM cal))", "", "d")
def _(spark, sf):
    return D.imported_weights(spark, sf).select("d").distinct().join(D.calendar(spark, sf).select("d").distinct(), "d", "left_semi")


@query("signal_to_exec_dates", "q AS (SELECT a.d AS signal_d, b.d AS d FROM cal a JOIN cal b ON b.n = a.n + 2 WHERE a.d IN (SELECT d FROM wimp))", "", "signal_d d")
def _(spark, sf):
    return A.signal_to_exec_dates(D.imported_weights(spark, sf).select("d").distinct(), D.dense(spark, sf), 2)


_FREQ = """g AS (SELECT CAST(d - lag(d) OVER (ORDER BY d) AS DOUBLE) AS g FROM (SELECT DISTINCT d FROM {t})), m AS (SELECT quantile_cont(g, 0.5) AS median_gap, count(g) AS k FROM g),
q AS (SELECT median_gap, CASE WHEN k < 2 THEN 'undetermined' WHEN median_gap <= 1.5 THEN 'daily' WHEN median_gap <= 4 THEN 'business-daily' WHEN median_gap <= 10 THEN 'weekly' WHEN median_gap <= 45 THEN 'monthly' WHEN median_gap <= 135 THEN 'quarterly' WHEN median_gap <= 250 THEN 'semi-annual' ELSE 'annual' END AS frequency FROM m)"""


@query("detect_frequency_exog", _FREQ.format(t="factor"), "median_gap", "frequency")
def _(spark, sf):
    return A.frequency(D.factor(spark, sf))


@query("detect_frequency_returns", _FREQ.format(t="bench"), "median_gap", "frequency")
def _(spark, sf):
    return A.frequency(D.benchmark(spark, sf))


@query("exog_report", """s AS (SELECT cal.d, f.series, (SELECT count(*) FROM factor x WHERE x.series = f.series AND x.d + 1 <= cal.d) AS k FROM cal CROSS JOIN (SELECT DISTINCT series FROM factor) f),
c AS (SELECT series, count(*) FILTER (k > 0) AS c, min(d) FILTER (k > 0) AS first_usable FROM s GROUP BY series),
q AS (SELECT f.series, count(*) AS observations, min(f.d) AS first_d, max(f.d) AS last_d, 100.0 * any_value(c.c) / (SELECT count(*) FROM cal) AS coverage, any_value(c.first_usable) AS first_usable FROM factor f JOIN c USING (series) GROUP BY f.series)""", "coverage", "series observations first_d last_d first_usable", 1)
def _(spark, sf):
    return A.exog_report(D.factor(spark, sf), D.daily(spark, sf))


def _mixed_exog(spark, sf):
    return D.macro(spark, sf).unionByName(D.factor(spark, sf).withColumn("series", F.lower("series")))


_MIXED = "ex AS (SELECT * FROM macro UNION ALL SELECT d, lower(series), v FROM factor), "


@query("exog_flags", _MIXED + """xl AS (SELECT series, count(*) AS k, min(d) AS first_d, max(d) AS last_d FROM ex GROUP BY series), xc AS (SELECT series, last_d, round(100.0 * (SELECT count(*) FROM cal WHERE cal.d >= first_d + 1) / (SELECT count(*) FROM cal), 1) AS coverage FROM xl),
xg AS (SELECT CAST(d - lag(d) OVER (ORDER BY d) AS DOUBLE) AS g FROM (SELECT DISTINCT d FROM ex)),
q AS (SELECT series, 'stale' AS flag FROM xc WHERE last_d < (SELECT max(d) FROM cal) - 180 UNION ALL SELECT series, 'thin' FROM xc WHERE coverage < 50 UNION ALL SELECT NULL, 'lag' FROM xg HAVING count(g) >= 2 AND quantile_cont(g, 0.5) > 10)""", "", "series flag")
def _(spark, sf):
    return A.exog_flags(_mixed_exog(spark, sf), D.daily(spark, sf))


@query("name_report", _MIXED + "q AS (SELECT DISTINCT series AS asset, 'unknown' AS state FROM ex WHERE upper(series) NOT IN (SELECT upper(asset) FROM uni) UNION ALL SELECT asset, 'absent' FROM uni WHERE upper(asset) NOT IN (SELECT upper(series) FROM ex))", "", "asset state")
def _(spark, sf):
    return I.name_report(_mixed_exog(spark, sf).withColumnRenamed("series", "asset"), D.daily(spark, sf))


@query("split_roles_factor", _MIXED + "q AS (SELECT * FROM ex WHERE upper(series) IN (SELECT upper(asset) FROM uni))", "v", "d series", 4)
def _(spark, sf):
    return A.split_roles(_mixed_exog(spark, sf), D.daily(spark, sf))[0]


@query("split_roles_macro", _MIXED + "q AS (SELECT * FROM ex WHERE upper(series) NOT IN (SELECT upper(asset) FROM uni))", "v", "d series", 2)
def _(spark, sf):
    return A.split_roles(_mixed_exog(spark, sf), D.daily(spark, sf))[1]


@query("calendar_union", "q AS (SELECT d FROM cal UNION SELECT d FROM macro)", "", "d")
def _(spark, sf):
    return D.calendar(spark, sf).select("d").union(D.macro(spark, sf).select("d")).distinct()


@query("calendar_intersect", "q AS (SELECT d FROM cal INTERSECT SELECT d FROM macro)", "", "d")
def _(spark, sf):
    return D.calendar(spark, sf).select("d").intersect(D.macro(spark, sf).select("d"))


@query("universe_except", "q AS (SELECT series FROM ex EXCEPT SELECT lower(asset) FROM uni)".replace("q AS", "ex AS (SELECT * FROM macro UNION ALL SELECT d, lower(series), v FROM factor), q AS", 1), "", "series")
def _(spark, sf):
    return _mixed_exog(spark, sf).select("series").subtract(D.daily(spark, sf).select(F.lower("asset").alias("series")))


# ---- indicators --------------------------------------------------------------------------------

_RW = "OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


def _rw(n: int) -> str:
    return _RW.format(k=n - 1)


def _guard(agg: str, x: str, n: int, k: int | None = None) -> str:
    return f"CASE WHEN count({x}) {_rw(n)} >= {n if k is None else k} THEN {agg}({x}) {_rw(n)} END"


_LAG = "lag(px{n}) OVER (PARTITION BY asset ORDER BY n)"


def _indicator(name: str, sql: str, column: Callable, digits: int = 6) -> None:
    @query(name, sql, "x", "d asset", digits)
    def _(spark, sf):
        p = R.with_returns(D.prices(spark, sf)).withColumn("step", F.abs(F.col("px") - R.lagged("px")))
        return p.select("d", "asset", column().alias("x"))


_SMA = _guard("avg", "px", LONG)
_VOL = f"{_guard('stddev_samp', 'r', SHORT, 10)} * sqrt(252)"
_STEP = "st AS (SELECT *, abs(px - lag(px) OVER (PARTITION BY asset ORDER BY n)) AS step, px / lag(px, 20) OVER (PARTITION BY asset ORDER BY n) - 1 AS tr FROM ret)"
_ER = f"least(1, greatest(0, abs(px - lag(px, {SHORT}) OVER (PARTITION BY asset ORDER BY n)) / nullif({_guard('sum', 'step', SHORT)}, 0)))"
_indicator("sma", f"q AS (SELECT d, asset, {_SMA} AS x FROM px)", lambda: R.sma(LONG))
_indicator("total_return", "q AS (SELECT d, asset, px / lag(px, 20) OVER (PARTITION BY asset ORDER BY n) - 1 AS x FROM px)", lambda: R.total_return(SHORT))
_indicator("realized_vol", f"q AS (SELECT d, asset, {_VOL} AS x FROM ret)", lambda: R.realized_vol(SHORT))
_indicator("downside_vol", f"lo AS (SELECT *, CASE WHEN r IS NOT NULL THEN least(r, 0) * least(r, 0) END AS l FROM ret), q AS (SELECT d, asset, sqrt({_guard('avg', 'l', SHORT, 10)}) * sqrt(252) AS x FROM lo)", lambda: R.downside_vol(SHORT))
_indicator("efficiency_ratio", f"{_STEP}, q AS (SELECT d, asset, CASE WHEN {_guard('sum', 'step', SHORT)} > 0 AND lag(px, {SHORT}) OVER (PARTITION BY asset ORDER BY n) IS NOT NULL THEN {_ER} END AS x FROM st)", lambda: R.efficiency_ratio(SHORT))
_indicator("zscore", f"q AS (SELECT d, asset, (px - {_guard('avg', 'px', SHORT)}) / nullif({_guard('stddev_samp', 'px', SHORT)}, 0) AS x FROM px)", lambda: R.zscore(SHORT), 5)

_EMA = """w0 AS (SELECT asset, n, d, px, row_number() OVER (PARTITION BY asset ORDER BY n) AS k FROM px WHERE px IS NOT NULL),
em AS (SELECT asset, k, d, px, px AS y, n FROM w0 WHERE k = 1 UNION ALL
  SELECT w0.asset, w0.k, w0.d, w0.px, (pow(1 - 2.0 / 51, w0.n - em.n) * em.y + 2.0 / 51 * w0.px) / (pow(1 - 2.0 / 51, w0.n - em.n) + 2.0 / 51), w0.n FROM em JOIN w0 ON w0.asset = em.asset AND w0.k = em.k + 1)"""


@query("ema", _EMA + ", q AS (SELECT px.d, px.asset, CASE WHEN k >= 50 THEN y END AS x FROM px LEFT JOIN em ON px.asset = em.asset AND px.n = em.n)", "x", "d asset", 4)
def _(spark, sf):
    p = D.prices(spark, sf).select("d", "n", "asset", "px")
    return R.ewm(p, "px", "x", 2 / 51, 50).select("d", "asset", F.when(F.col("px").isNotNull(), F.col("x")).alias("x"))


_RSI = """w0 AS (SELECT asset, n, d, greatest(px - lag(px) OVER (PARTITION BY asset ORDER BY n), 0) AS u, greatest(lag(px) OVER (PARTITION BY asset ORDER BY n) - px, 0) AS v, px - lag(px) OVER (PARTITION BY asset ORDER BY n) AS df FROM px),
w1 AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY n) AS k FROM w0 WHERE df IS NOT NULL),
rs AS (SELECT asset, k, n, u AS yu, v AS yv FROM w1 WHERE k = 1 UNION ALL
  SELECT w1.asset, w1.k, w1.n, (pow(1 - 1.0 / 14, w1.n - rs.n) * rs.yu + 1.0 / 14 * w1.u) / (pow(1 - 1.0 / 14, w1.n - rs.n) + 1.0 / 14), (pow(1 - 1.0 / 14, w1.n - rs.n) * rs.yv + 1.0 / 14 * w1.v) / (pow(1 - 1.0 / 14, w1.n - rs.n) + 1.0 / 14) FROM rs JOIN w1 ON w1.asset = rs.asset AND w1.k = rs.k + 1)"""


@query("rsi", _RSI + ", q AS (SELECT w0.d, w0.asset, CASE WHEN rs.k >= 14 THEN 100 - 100 / (1 + yu / nullif(yv, 0)) END AS x FROM w1 w0 JOIN rs ON rs.asset = w0.asset AND rs.n = w0.n)", "x", "d asset", 4)
def _(spark, sf):
    p = D.prices(spark, sf).withColumn("df", F.col("px") - R.lagged("px"))
    return R.rsi(p).where("df IS NOT NULL").select("d", "asset", F.col("rsi").alias("x"))


_MOM = "mo AS (SELECT *, px / lag(px, 20) OVER (PARTITION BY asset ORDER BY n) - 1 AS s FROM px)"


@query("topn_rank", _MOM + ", q AS (SELECT d, asset, CAST(s IS NOT NULL AND row_number() OVER (PARTITION BY d ORDER BY s DESC NULLS LAST, ord) <= 3 AS DOUBLE) AS x FROM mo)", "x", "d asset")
def _(spark, sf):
    return RK.top_n(D.prices(spark, sf).withColumn("s", R.total_return(SHORT)), "s", 3, "x").select("d", "asset", "x")


@query("pct_rank_avg", _MOM + ", q AS (SELECT d, asset, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY d, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY d, s) - 1) / 2.0) / count(s) OVER (PARTITION BY d) END AS x FROM mo)", "x", "d asset")
def _(spark, sf):
    return RK.pct_rank(D.prices(spark, sf).withColumn("s", R.total_return(SHORT)), "s", "x").select("d", "asset", "x")


_STICKY = f"ma AS (SELECT *, {_SMA} AS ma FROM px), st AS (SELECT *, CASE WHEN coalesce(px < ma * 0.98, false) THEN 0.0 WHEN coalesce(px > ma * 1.02, false) THEN 1.0 END AS s FROM ma), hy AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x FROM st)"


@query("hysteresis_state", _STICKY + ", q AS (SELECT d, asset, CAST(x AS DOUBLE) AS x FROM hy)", "x", "d asset")
def _(spark, sf):
    p = D.prices(spark, sf).withColumn("ma", R.sma(LONG))
    return p.select("d", "asset", R.sticky(F.col("px") > F.col("ma") * 1.02, F.col("px") < F.col("ma") * 0.98).alias("x"))


# ---- sizing and strategies ---------------------------------------------------------------------

_PRICED = "sum(CAST(px IS NOT NULL AS DOUBLE)) OVER (PARTITION BY d)"


def _strategy(name: str, key: str, params: dict, sql: str | None, exog: Callable | None = None, digits: int = 6) -> None:
    @query(name, None if sql is None else f"{sql}, q AS (SELECT d, asset, CASE WHEN px IS NOT NULL THEN coalesce(w, 0) ELSE 0 END AS w FROM sg)", "w", "d asset", digits)
    def _(spark, sf):
        x = exog(spark, sf) if exog else None
        return S.get(key).generate(D.prices(spark, sf), params, x).select("d", "asset", "w")


def _iv(mask: str, vol: str, slots: str | None, table: str) -> str:
    """CTEs iv0, iv: inverse-volatility weights."""
    w = f"coalesce(i / nullif(sum(i) OVER (PARTITION BY d), 0), 0)" + (f" * least(1, sum(CAST(i > 0 AS DOUBLE)) OVER (PARTITION BY d) / nullif({slots}, 0))" if slots else "")
    return f"iv0 AS (SELECT *, CASE WHEN {mask} > 0 AND {vol} > 0 THEN 1 / {vol} ELSE 0 END AS i FROM {table}), iv AS (SELECT *, {w} AS w FROM iv0)"


_V = f"vo AS (SELECT *, {_VOL} AS vol, CAST(px IS NOT NULL AS DOUBLE) AS m FROM ret)"
_strategy("strat_buy_hold", "buy_hold", {}, f"sg AS (SELECT *, CAST(px IS NOT NULL AS DOUBLE) / nullif({_PRICED}, 0) AS w FROM px)")
_strategy("strat_sma_trend", "sma_trend", {"window": LONG}, f"ma AS (SELECT *, {_SMA} AS ma FROM px), sg AS (SELECT *, CAST(coalesce(px > ma, false) AS DOUBLE) / nullif({_PRICED}, 0) AS w FROM ma)")
_strategy("strat_sma_trend_buffer", "sma_trend", {"window": LONG, "buffer": 2.0}, f"{_STICKY}, sg AS (SELECT *, x / nullif({_PRICED}, 0) AS w FROM hy)")
_M2 = f"mo AS (SELECT *, lag(px, {SKIP}) OVER (PARTITION BY asset ORDER BY n) / lag(px, {SKIP + 63}) OVER (PARTITION BY asset ORDER BY n) - 1 AS mom FROM px)"
_TOP3 = "CAST(s IS NOT NULL AND row_number() OVER (PARTITION BY d ORDER BY s DESC NULLS LAST, ord) <= 3 AS DOUBLE)"
_strategy("strat_xs_momentum", "xs_momentum", {"lookback": 63}, f"{_M2}, tp AS (SELECT *, mom AS s FROM mo), t3 AS (SELECT *, {_TOP3} AS m FROM tp), sg AS (SELECT *, m / nullif(sum(m) OVER (PARTITION BY d), 0) AS w FROM t3)")
_strategy("strat_dual_momentum", "dual_momentum", {"lookback": 63, "trend_window": LONG}, f"{_M2}, ma AS (SELECT *, {_SMA} AS ma FROM mo), tp AS (SELECT *, CASE WHEN mom > 0 AND px > ma THEN mom END AS s FROM ma), sg AS (SELECT *, {_TOP3} / 3 AS w FROM tp)")
_PR = "CASE WHEN {s} IS NOT NULL THEN (rank() OVER (PARTITION BY d, {s} IS NULL ORDER BY {s}) + (count(*) OVER (PARTITION BY d, {s}) - 1) / 2.0) / count({s}) OVER (PARTITION BY d) END"
_strategy("strat_trend_quality", "trend_quality", {"mom_window": SHORT, "er_window": SHORT, "ma_window": LONG, "regime_window": LONG}, f"""{_STEP}, c3 AS (SELECT *, tr AS a, CASE WHEN {_guard('sum', 'step', SHORT)} > 0 AND lag(px, {SHORT}) OVER (PARTITION BY asset ORDER BY n) IS NOT NULL THEN {_ER} END AS b, px / {_SMA} - 1 AS c, {_SMA} AS ma FROM st),
sc AS (SELECT *, ({_PR.format(s='a')} + {_PR.format(s='b')} + {_PR.format(s='c')}) / 3 AS score FROM c3), tp AS (SELECT *, CASE WHEN score >= 0.5 - 1e-12 AND px > ma THEN round(score, 9) END AS s FROM sc), sg AS (SELECT *, {_TOP3} / 3 AS w FROM tp)""")
_strategy("strat_risk_parity", "risk_parity", {"vol_window": SHORT}, f"{_V}, {_iv('m', 'vol', None, 'vo')}, cp AS (SELECT d, n, asset, px, least(w, 0.4) AS c FROM iv), sg AS (SELECT *, c / nullif(sum(c) OVER (PARTITION BY d), 0) AS w FROM cp)")
_strategy("strat_vol_target", "vol_target", {"vol_window": SHORT}, f"""eq AS (SELECT *, CAST(px IS NOT NULL AS DOUBLE) / nullif({_PRICED}, 0) AS e FROM ret), bk0 AS (SELECT d, n, coalesce(lag(e) OVER (PARTITION BY asset ORDER BY n), 0) * coalesce(r, 0) AS c FROM eq), bk AS (SELECT d, n, sum(c) AS pr FROM bk0 GROUP BY d, n),
vs AS (SELECT d, coalesce(least(0.1 / nullif(CASE WHEN count(pr) OVER (ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10 THEN stddev_samp(pr) OVER (ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END, 0), CASE WHEN count(pr) OVER (ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10 THEN 1 END), CASE WHEN count(pr) OVER (ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10 THEN 1 ELSE 1 END) AS s FROM bk), sg AS (SELECT eq.d, eq.asset, eq.px, e * s AS w FROM eq JOIN vs USING (d))""")
_REV = f"""{_RSI}, m0 AS (SELECT *, {_SMA} AS ma FROM px), m1 AS (SELECT m0.*, CASE WHEN k >= 14 THEN 100 - 100 / (1 + yu / nullif(yv, 0)) END AS x FROM m0 LEFT JOIN rs ON rs.asset = m0.asset AND rs.n = m0.n),
m2 AS (SELECT *, CASE WHEN coalesce(x > 55, false) THEN 0.0 WHEN coalesce(x < 30, false) THEN 1.0 END AS s FROM m1), m3 AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM m2)"""
_strategy("strat_rsi_reversion", "rsi_reversion", {"trend_filter": LONG}, f"{_REV}, sg AS (SELECT *, held * CAST(coalesce(px > ma, false) AS DOUBLE) / nullif({_PRICED}, 0) AS w FROM m3)")
_strategy("strat_rsi_reversion_plain", "rsi_reversion", {"trend_filter": 0}, f"{_REV}, sg AS (SELECT *, held / nullif({_PRICED}, 0) AS w FROM m3)")
_strategy("strat_fixed_weights", "fixed_weights", {"weights": "STANDARD:0.6; ECONOMY:0.2, X:y"}, "sg AS (SELECT *, CASE asset WHEN 'STANDARD' THEN 0.6 WHEN 'ECONOMY' THEN 0.2 ELSE 0 END::DOUBLE AS w FROM px)")


def _macro_daily(spark, sf):
    return A.exog_asof(D.macro(spark, sf), D.calendar(spark, sf), 5)


def _factor_daily(spark, sf):
    return A.exog_asof(D.factor(spark, sf), D.calendar(spark, sf), 5)


_MG = "mg AS (SELECT cal.d, cal.n, v FROM cal ASOF LEFT JOIN (SELECT d + 5 AS d, v FROM macro) m ON cal.d >= m.d), mw AS (SELECT d, v - CASE WHEN count(v) OVER w >= 12 THEN avg(v) OVER w END > 1e-12 * avg(v) OVER w AS up FROM mg WINDOW w AS (ORDER BY n ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"
_strategy("strat_macro_gate", "macro_gate", {"series": "orders", "window": LONG, "risk_off": 0.25}, f"{_MG}, sg AS (SELECT px.*, CAST(px IS NOT NULL AS DOUBLE) / nullif({_PRICED.replace('PARTITION BY d', 'PARTITION BY px.d')}, 0) * CASE WHEN coalesce(up, false) THEN 1 ELSE 0.25 END AS w FROM px JOIN mw ON px.d = mw.d)", _macro_daily)
_GATED = "{g}, sg AS (SELECT px.*, CAST(px IS NOT NULL AS DOUBLE) / nullif(" + _PRICED.replace("PARTITION BY d", "PARTITION BY px.d") + ", 0) * CASE WHEN coalesce(up, false) THEN 1 ELSE 0.25 END AS w FROM px JOIN mw ON px.d = mw.d)"
_MV = "mg AS (SELECT cal.d, cal.n, v FROM cal ASOF LEFT JOIN (SELECT d + 5 AS d, v FROM macro) m ON cal.d >= m.d), "
_MZ = _MV + f"mw AS (SELECT d, CASE WHEN count(v) OVER w >= 12 THEN (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) END {{t}} AS up FROM mg WINDOW w AS (ORDER BY n ROWS BETWEEN {LONG - 1} PRECEDING AND CURRENT ROW))"
_strategy("strat_macro_gate_rising", "macro_gate", {"series": "orders", "rule": "rising", "window": LONG, "risk_off": 0.25}, _GATED.format(g=_MV + f"mw AS (SELECT d, v - lag(v, {LONG}) OVER (ORDER BY n) > 0 AS up FROM mg)"), _macro_daily)
_strategy("strat_macro_gate_z_above", "macro_gate", {"series": "orders", "rule": "z above", "threshold": 0.5, "window": LONG, "risk_off": 0.25}, _GATED.format(g=_MZ.format(t="> 0.5")), _macro_daily)
_strategy("strat_macro_gate_z_below", "macro_gate", {"series": "orders", "rule": "z below", "threshold": -0.5, "window": LONG, "risk_off": 0.25}, _GATED.format(g=_MZ.format(t="< -0.5")), _macro_daily)
_FD = "fd AS (SELECT px.d, px.n, px.asset, px.ord, px.px, (SELECT arg_max(v, f.d) FROM factor f WHERE f.series = px.asset AND f.d + 5 <= px.d) AS f FROM px)"
_strategy("strat_factor_rank", "factor_rank", {}, f"{_FD}, pk AS (SELECT *, {_PR.format(s='f')} AS s0 FROM fd), tp AS (SELECT *, s0 AS s FROM pk), sg AS (SELECT *, {_TOP3} / 3 AS w FROM tp)", _factor_daily)
_strategy("strat_exog_signal", "exog_signal", {}, f"{_FD}, ws AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(f, 0) ELSE 0 END AS w0 FROM fd), sg AS (SELECT *, w0 / nullif(sum(abs(w0)) OVER (PARTITION BY d), 0) AS w FROM ws)", _factor_daily)
_FW = ", ws AS (SELECT *, CASE WHEN f IS NOT NULL THEN {w} ELSE 0 END AS w0 FROM fd), sg AS (SELECT *, w0 / nullif(sum(abs(w0)) OVER (PARTITION BY d), 0) AS w FROM ws)"
_strategy("strat_exog_signal_binary", "exog_signal", {"mode": "binary", "threshold": 0.05, "allow_short": True}, _FD + _FW.format(w="CASE WHEN f > 0.05 THEN 1 WHEN f < -0.05 THEN -1 ELSE 0 END"), _factor_daily)
_strategy("strat_exog_signal_short", "exog_signal", {"allow_short": True}, _FD + _FW.format(w="f - 0.05"), lambda spark, sf: _factor_daily(spark, sf).withColumn("v", F.col("v") - 0.05))
_strategy("strat_exog_signal_rank", "exog_signal", {"mode": "rank"}, _FD + ", tp AS (SELECT *, f AS s FROM fd), ws AS (SELECT *, CASE WHEN f IS NOT NULL THEN " + _TOP3 + " ELSE 0 END AS w0 FROM tp), sg AS (SELECT *, w0 / nullif(sum(abs(w0)) OVER (PARTITION BY d), 0) AS w FROM ws)", _factor_daily)


@query("size_equal", _MOM + ", mk AS (SELECT *, CAST(coalesce(s > 0, false) AS DOUBLE) AS m FROM mo), q AS (SELECT d, asset, coalesce(m / nullif(sum(m) OVER (PARTITION BY d), 0), 0) AS w FROM mk)", "w", "d asset")
def _(spark, sf):
    p = D.prices(spark, sf).withColumn("m", F.when(F.coalesce(R.total_return(SHORT) > 0, F.lit(False)), 1.0).otherwise(0.0))
    return p.select("d", "asset", S.size_equal(F.col("m")).alias("w"))


@query("size_inverse_vol", f"{_V}, {_iv('m', 'vol', '8', 'vo')}, q AS (SELECT d, asset, w FROM iv)", "w", "d asset")
def _(spark, sf):
    p = R.with_returns(D.prices(spark, sf)).withColumn("m", F.when(F.col("px").isNotNull(), 1.0).otherwise(0.0)).withColumn("v", R.realized_vol(SHORT))
    return p.select("d", "asset", S.size_inverse_vol(F.col("m"), "v", slots=F.lit(8.0)).alias("w"))


# ---- simulation --------------------------------------------------------------------------------


def _run(spark, sf, rule: str = "monthly", lag: int = 1) -> DataFrame:
    p = D.prices(spark, sf)
    t = S.get("buy_hold").generate(p).withColumn("run_id", F.lit("run"))
    return E.legs(p, t, A.rebalance_calendar(p, rule), lag)


_MONTHLY = "SELECT max(d) AS d FROM cal GROUP BY date_trunc('month', d)"
_HELD = "SELECT *, coalesce(m / nullif(sum(m) OVER (PARTITION BY d), 0), 0) AS w FROM rr"


def _trend(n: int) -> str:
    """The weights of sma_trend, in place of _HELD."""
    return f"SELECT *, CASE WHEN px > ma THEN 1.0::DOUBLE ELSE 0 END / nullif(sum(m) OVER (PARTITION BY d), 0) AS w FROM (SELECT *, {_guard('avg', 'px', n)} AS ma FROM rr)"


_NO_CASH = "SELECT d, 0.0::DOUBLE AS rc FROM cal"
_PROXY = "SELECT d, r AS rc FROM bret"
_HALF = f"SELECT * REPLACE (w * 0.5 AS w) FROM ({_HELD})"


def _walk(min_trade: str, rate: str = "0.003", held: str = _HELD, events: str = _MONTHLY, income: str = "0.0::DOUBLE", cash: str = _NO_CASH) -> str:
    """The day recursion over lists of weights; ends in sim(n, d, w, c, v, tr). held: target weights of rr;
    events: days of trade; income: dividends over the price before, of rr; cash: d, rc."""
    return f"""r0 AS (SELECT *, lag(px) OVER (PARTITION BY asset ORDER BY n) AS before FROM px), rr AS (SELECT d, n, asset, px, coalesce(px / lag(px) OVER (PARTITION BY asset ORDER BY n) - 1, 0) AS r, CASE WHEN px IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS m, coalesce({income}, 0) AS dv FROM r0),
tw AS ({held}), tl AS (SELECT *, coalesce(lag(w, 1) OVER (PARTITION BY asset ORDER BY n), 0) AS t FROM tw),
reb AS ({events}), cr AS ({cash}),
dy AS (SELECT tl.d, n, any_value(rc) AS rc, list(r ORDER BY asset) AS r, list(dv ORDER BY asset) AS dv, list(t ORDER BY asset) AS t, bool_or(reb.d IS NOT NULL) AND n > 1 AS ev FROM tl JOIN cr ON cr.d = tl.d LEFT JOIN reb ON tl.d = reb.d GROUP BY tl.d, n),
sim AS (SELECT n, d, list_transform(t, lambda x: 0.0::DOUBLE) AS w, 1.0::DOUBLE AS c, 1.0::DOUBLE AS v, 0.0::DOUBLE AS tr FROM dy WHERE n = 1 UNION ALL
SELECT n, d, CASE WHEN ev AND tr > 0 THEN nw ELSE w2 END, CASE WHEN ev AND tr > 0 THEN 1 - list_sum(nw) ELSE c2 END, v2 * (1 - CASE WHEN ev THEN tr ELSE 0 END * {rate}), CASE WHEN ev THEN tr ELSE 0.0::DOUBLE END FROM (
SELECT *, list_sum(list_transform(list_zip(nw, w2), lambda z: abs(z[1] - z[2]))) AS tr FROM (SELECT *, CASE WHEN g0 > 1 THEN list_transform(nw0, lambda x: x / g0) ELSE nw0 END AS nw FROM (SELECT *, list_sum(list_transform(nw0, lambda x: abs(x))) AS g0 FROM (SELECT *, list_transform(list_zip(w2, dl), lambda z: z[1] + z[2]) AS nw0 FROM (
SELECT *, CASE WHEN ev THEN list_transform(list_zip(t, w2), lambda z: CASE WHEN abs(z[1] - z[2]) < {min_trade} THEN 0.0::DOUBLE ELSE z[1] - z[2] END) ELSE list_transform(t, lambda x: 0.0::DOUBLE) END AS dl FROM (
SELECT n, d, t, ev, list_transform(wg, lambda x: x / (list_sum(wg) + c)) AS w2, c / (list_sum(wg) + c) AS c2, v * (list_sum(wg) + c) AS v2 FROM (
SELECT dy.n, dy.d, dy.t, dy.ev, list_transform(list_zip(sim.w, dy.r), lambda z: z[1] * (1 + z[2])) AS wg, sim.c * (1 + dy.rc) + list_sum(list_transform(list_zip(sim.w, dy.dv), lambda z: z[1] * z[2])) AS c, sim.v FROM sim JOIN dy ON dy.n = sim.n + 1)))))))"""


@query("bt_nav_closed_form", _walk("0") + "), q AS (SELECT d, v AS nav, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS ret, tr AS turnover, tr * 0.003 AS cost FROM sim)", "nav ret turnover cost", "d")
def flagship_runs(spark, sf):
    return E.closed_form(_run(spark, sf), E.Costs().rate).select("d", "nav", "ret", "turnover", "cost")


@query("bt_weights", _walk("0") + "), q AS (SELECT d, asset, sim.w[ord] AS w FROM sim CROSS JOIN uni)", "w", "d asset")
def _(spark, sf):
    return E.weights_after(_run(spark, sf)).select("d", "asset", "w")


@query("bt_exposure", _walk("0") + "), q AS (SELECT d, list_sum(w) AS exposure, 1 - list_sum(w) AS cash_w FROM sim)", "exposure cash_w", "d")
def _(spark, sf):
    return E.closed_form(_run(spark, sf), E.Costs().rate).select("d", "exposure", "cash_w")


_BEFORE = "bf AS (SELECT dy.d, asset, s0.w[ord] AS held, s0.w[ord] * (1 + dy.r[ord]) / (list_sum(list_transform(list_zip(s0.w, dy.r), lambda z: z[1] * (1 + z[2]))) + s0.c) AS weight_before, dy.t[ord] AS weight_after FROM dy JOIN sim s0 ON s0.n = dy.n - 1 JOIN sim s1 ON s1.n = dy.n CROSS JOIN uni WHERE ev AND s1.tr > 0)"


@query("bt_trades", _walk("0") + f"), {_BEFORE}, q AS (SELECT *, weight_after - weight_before AS change FROM bf WHERE held <> 0 OR weight_after <> 0)", "weight_before weight_after change", "d asset")
def _(spark, sf):
    return E.trades(_run(spark, sf)).select("d", "asset", "weight_before", "weight_after", "change")


@query("bt_general", _walk("0.005") + "), q AS (SELECT d, v AS nav, tr AS turnover FROM sim)", "nav turnover", "d")
def _(spark, sf):
    return E.kernel(_run(spark, sf), E.Costs().rate, min_trade=0.005).select("d", "nav", "turnover")


def _half(spark, sf, lag: int = 1) -> DataFrame:
    """Half in the assets, half in cash that follows the benchmark as its proxy."""
    p = D.prices(spark, sf)
    t = S.get("buy_hold").generate(p).withColumn("run_id", F.lit("run")).withColumn("w", F.col("w") * 0.5)
    return E.legs(p, t, A.rebalance_calendar(p, "monthly"), lag, cash=E.cash_returns(p, D.benchmark(spark, sf)))


@query("bt_cash_proxy", _walk("0", held=_HALF, cash=_PROXY) + "), q AS (SELECT d, v AS nav, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS ret, tr AS turnover, tr * 0.003 AS cost, list_sum(w) AS exposure, 1 - list_sum(w) AS cash_w FROM sim)", "nav ret turnover cost exposure cash_w", "d")
def _(spark, sf):
    return E.closed_form(_half(spark, sf), E.Costs().rate).select("d", "nav", "ret", "turnover", "cost", "exposure", "cash_w")


@query("bt_cash_proxy_general", _walk("0.005", held=_HALF, cash=_PROXY) + "), q AS (SELECT d, v AS nav, tr AS turnover FROM sim)", "nav turnover", "d")
def _(spark, sf):
    return E.kernel(_half(spark, sf), E.Costs().rate, min_trade=0.005).select("d", "nav", "turnover")


@query("bt_turnover_costs", _walk("0") + "), q AS (SELECT sum(tr) AS turnover, sum(tr * 0.003) AS cost, count(*) FILTER (tr > 0) AS rebalances FROM sim)", "turnover cost", "rebalances")
def _(spark, sf):
    r = E.closed_form(_run(spark, sf), E.Costs().rate)
    return r.agg(F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.count_if(F.col("turnover") > 0).alias("rebalances"))


@query("benchmark_buy_hold", "q AS (SELECT d, px / first_value(px) OVER (ORDER BY d) AS nav, r AS ret FROM bret)", "nav ret", "d")
def _(spark, sf):
    return E.benchmark_result(D.benchmark(spark, sf))


@query("trim_warmup", _walk("0") + "), ex AS (SELECT *, list_sum(w) AS e, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS r FROM sim), fa AS (SELECT min(n) AS n0 FROM ex WHERE e > 1e-9), q AS (SELECT d, v / first_value(v) OVER (ORDER BY n) AS nav, CASE WHEN n = n0 THEN 0 ELSE r END AS ret FROM ex, fa WHERE n >= n0)", "nav ret", "d")
def _(spark, sf):
    return E.trim_warmup(E.closed_form(_run(spark, sf), E.Costs().rate)).select("d", "nav", "ret")


@query("align_results", _walk("0") + "), bn AS (SELECT d, px / first_value(px) OVER (ORDER BY d) AS y FROM bret), q AS (SELECT d, 100 * v / first_value(v) OVER (ORDER BY d) AS a, 100 * y / first_value(y) OVER (ORDER BY d) AS b FROM sim JOIN bn USING (d))", "a b", "d")
def _(spark, sf):
    return E.align_results(E.closed_form(_run(spark, sf), E.Costs().rate), E.benchmark_result(D.benchmark(spark, sf)))


@query("avg_weight", _walk("0") + "), q AS (SELECT asset, avg(sim.w[ord]) AS w FROM sim CROSS JOIN uni GROUP BY asset)", "w", "asset")
def _(spark, sf):
    return E.weights_after(_run(spark, sf)).groupBy("asset").agg(F.avg("w").alias("w"))


@query("holdings_topk", _walk("0") + "), q AS (SELECT d, asset, sim.w[ord] AS w FROM sim CROSS JOIN uni WHERE n = (SELECT max(n) FROM sim) AND abs(sim.w[ord]) > 1e-6 ORDER BY w DESC LIMIT 30)", "w", "d asset")
def _(spark, sf):
    w = E.weights_after(_run(spark, sf))
    last = w.agg(F.max("d").alias("d"))
    return w.join(last, "d").where(F.abs("w") > 1e-6).orderBy(F.desc("w")).limit(30).select("d", "asset", "w")


LEVELS = (0, 5, 10, 20, 30, 50, 75, 100)


@query("cost_sensitivity", "q AS (SELECT 1)")
def _(spark, sf):
    days = E.closed_form(_run(spark, sf), 0.0)
    return B.cost_levels(days, LEVELS).groupBy("bps").agg(F.max_by("nav", "d").alias("nav"))


_SQL["cost_sensitivity"] = f"{D.SQL.rstrip()},\n{_walk('0', '0.0')}), lv AS (SELECT unnest([0, 5, 10, 20, 30, 50, 75, 100])::DOUBLE AS bps) SELECT bps, round(max_by(v, n) * product(1 - tr * bps / 1e4), 6) + 0.0::DOUBLE AS nav FROM sim CROSS JOIN lv GROUP BY bps"


# ---- metrics, on the market's returns ----------------------------------------------------------


def _market(spark, sf) -> DataFrame:
    return D.market(spark, sf)


_EQ = "eq AS (SELECT d, n, r, product(1 + r) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM bret), dd AS (SELECT *, nav / max(nav) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM eq)"
_STATS = """st AS (SELECT count(*) AS n, arg_min(nav, n) AS f, arg_max(nav, n) AS l, stddev_samp(r) AS sd, avg(r) AS m, stddev_samp(r) FILTER (r < 0) AS sn, min(dd) AS mdd, sqrt(avg(pow(100 * dd, 2))) AS ulcer, max(r) AS best, min(r) AS worst, avg(CAST(r > 0 AS DOUBLE)) AS positive, skewness(r) AS skew, kurtosis(r) AS kurtosis FROM dd),
sx AS (SELECT *, pow(l / f, 252.0 / n) - 1 AS cagr, l / f - 1 AS total_return, sd * sqrt(252) AS vol, m / sd * sqrt(252) AS sharpe, m / sn * sqrt(252) AS sortino FROM st)"""


@query("equity_curve", _EQ + ", q AS (SELECT * FROM eq)", "nav", "d")
def _(spark, sf):
    return M.equity_curve(_market(spark, sf).drop("nav")).select("d", "nav")


@query("drawdown", _EQ + ", q AS (SELECT * FROM dd)", "dd", "d")
def _(spark, sf):
    return M.drawdown(_market(spark, sf)).select("d", "dd")


for _m in ("cagr", "vol", "sharpe", "sortino", "mdd", "calmar", "ulcer", "total_return"):

    @query({"vol": "annual_vol", "mdd": "max_drawdown", "ulcer": "ulcer_index"}.get(_m, _m if _m != "total_return" else "total_gain"), f"{_EQ}, {_STATS}, q AS (SELECT *, cagr / abs(mdd) AS calmar FROM sx)", _m)
    def _(spark, sf, m=_m):
        return M.statistics(_market(spark, sf)).select(m)


@query("summary", f"{_EQ}, {_STATS}, al AS (SELECT CAST(n AS DOUBLE) AS n, total_return, cagr, vol, sharpe, sortino, mdd, cagr / abs(mdd) AS calmar, ulcer, skew, kurtosis, best, worst, positive FROM sx), q AS (UNPIVOT al ON COLUMNS(*) INTO NAME metric VALUE value)", "value", "metric", 5)
def _(spark, sf):
    return M.summary(M.statistics(_market(spark, sf))).select("metric", "value")


@query("drawdown_table", _EQ + """, fl AS (SELECT *, dd < 0 AS low, coalesce(lag(dd < 0) OVER (ORDER BY n), false) AS was, lead(d) OVER (ORDER BY n) AS nd FROM dd), il AS (SELECT *, sum(CAST(low AND NOT was AS INTEGER)) OVER (ORDER BY n) AS k FROM fl),
ep AS (SELECT k, min(d) AS start, arg_min(d, dd) AS trough, arg_max_null(nd, n) AS recovery, min(dd) AS drawdown, arg_min(n, dd) - min(n) + 1 AS days_to_trough, max(n) - min(n) + CASE WHEN arg_max_null(nd, n) IS NULL THEN 1 ELSE 2 END AS total_days FROM il WHERE low GROUP BY k),
q AS (SELECT * FROM (SELECT start, trough, recovery, drawdown, CAST(days_to_trough AS BIGINT) AS days_to_trough, CAST(total_days AS BIGINT) AS total_days, row_number() OVER (ORDER BY drawdown, start) AS p FROM ep) WHERE p <= 5)""", "drawdown", "start trough recovery days_to_trough total_days")
def _(spark, sf):
    return M.drawdown_table(_market(spark, sf)).drop("run_id")


@query("var_cvar", "v AS (SELECT quantile_cont(r, 0.05) AS var FROM bret), q AS (SELECT any_value(var) AS var, avg(r) FILTER (r <= var) AS cvar FROM bret, v)", "var cvar")
def _(spark, sf):
    return M.var_cvar(_market(spark, sf)).select("var", "cvar")


@query("beta_alpha", """ew AS (SELECT d, avg(coalesce(r, 0)) AS y FROM ret GROUP BY d), bb AS (SELECT ew.d, y, r AS x FROM ew JOIN bret ON ew.d = bret.d),
q AS (SELECT covar_samp(y, x) / var_samp(x) AS beta, (avg(y) - covar_samp(y, x) / var_samp(x) * avg(x)) * 252 AS alpha, corr(y, x) AS corr, corr(y, x) * corr(y, x) AS r2, stddev_samp(y - x) * sqrt(252) AS tracking_error, avg(y - x) * 252 / (stddev_samp(y - x) * sqrt(252)) AS information_ratio FROM bb HAVING count(*) >= 30)""", "beta alpha corr r2 tracking_error information_ratio", "", 5)
def _(spark, sf):
    rows = R.with_returns(D.prices(spark, sf)).groupBy("d").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("ret")).withColumn("run_id", F.lit("x"))
    return M.beta_alpha(rows, _market(spark, sf)).drop("run_id")


_MON = "mm AS (SELECT date_trunc('month', d)::DATE AS month, product(1 + r) - 1 AS x FROM bret GROUP BY 1), ms AS (SELECT unnest(generate_series((SELECT min(month) FROM mm), (SELECT max(month) FROM mm), INTERVAL 1 MONTH))::DATE AS month), mr AS (SELECT ms.month, coalesce(x, 0) AS ret FROM ms LEFT JOIN mm ON ms.month = mm.month)"


@query("monthly_returns", _MON + ", q AS (SELECT * FROM mr)", "ret", "month")
def _(spark, sf):
    return M.monthly_returns(_market(spark, sf)).select("month", "ret")


@query("monthly_pivot", _MON + ", q AS (SELECT year(month)::BIGINT AS year, " + ", ".join(f"max(ret) FILTER (month(month) = {k}) AS m{k}" for k in range(1, 13)) + " FROM mr GROUP BY 1)", " ".join(f"m{k}" for k in range(1, 13)), "year")
def _(spark, sf):
    return M.monthly_pivot(_market(spark, sf)).drop("run_id")


@query("rolling_sharpe", "q AS (SELECT d, CASE WHEN count(r) OVER w >= 63 THEN avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) * sqrt(252) END AS rolling_sharpe FROM bret WINDOW w AS (ORDER BY n ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))", "rolling_sharpe", "d", 5)
def _(spark, sf):
    return M.rolling_sharpe(_market(spark, sf), 63).select("d", "rolling_sharpe")


@query("correlation_matrix", "q AS (SELECT x.asset AS a, y.asset AS b, corr(x.r, y.r) AS corr FROM ret x JOIN ret y ON x.d = y.d WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)", "corr", "a b")
def _(spark, sf):
    return M.correlation_matrix(R.with_returns(D.prices(spark, sf)))


@query("return_histogram", "lm AS (SELECT min(r) AS lo, max(r) AS hi FROM bret), q AS (SELECT CAST(least(89, floor((r - lo) / (hi - lo) * 90)) AS BIGINT) AS bin, count(*) AS n FROM bret, lm GROUP BY 1)", "", "bin n")
def _(spark, sf):
    return M.return_histogram(_market(spark, sf))


@query("histogram_line", "q AS (SELECT quantile_cont(100 * r, 0.05) AS line FROM bret)", "line")
def _(spark, sf):
    """The 5 % line of the histogram, in percent."""
    return M.histogram_line(_market(spark, sf)).select("line")


@query("stream_result", "eq AS (SELECT *, product(1 + r) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM bret), q AS (SELECT d, nav, r AS ret, r AS gross_ret, 0.0 AS turnover, 0.0 AS cost, 1.0 AS exposure, 0.0 AS cash_w, 'market' AS asset, 1.0 AS w FROM eq)", "nav ret gross_ret turnover cost exposure cash_w w", "d asset")
def _(spark, sf):
    """A bare return stream in the shape of a simulated run."""
    return E.stream_result(_market(spark, sf)).drop("run_id")


@query("format_metric", f"{_EQ}, {_STATS}, q AS (SELECT 'cagr' AS metric, printf('%,.2f%%', cagr * 100) AS said FROM sx UNION ALL SELECT 'sharpe', printf('%,.2f', sharpe) FROM sx)", "", "metric said")
def _(spark, sf):
    s = M.summary(M.statistics(_market(spark, sf))).where(F.col("metric").isin("cagr", "sharpe"))
    return s.select("metric", M.format_metric(F.col("metric"), F.col("value")).alias("said"))


# ---- robustness --------------------------------------------------------------------------------

_PART = """pe AS (SELECT *, product(1 + r) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM pt), pd AS (SELECT *, nav / max(nav) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM pe),
ps AS (SELECT k, count(*) AS c, min(d) AS start, max(d) AS "end", pow(arg_max(nav, n) / arg_min(nav, n), 252.0 / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(dd) AS mdd FROM pd GROUP BY k HAVING count(*) >= 30)"""


@query("fold_stats", f"pt AS (SELECT *, ntile(5) OVER (ORDER BY n) AS k FROM bret), {_PART}, q AS (SELECT k AS fold, * FROM ps)", "cagr vol sharpe mdd", 'fold start "end"', 5)
def _(spark, sf):
    return B.fold_stats(_market(spark, sf), 5)


@query("in_out_sample", f"pt AS (SELECT *, CASE WHEN n <= floor(count(*) OVER () * 0.6) THEN 'in' ELSE 'out' END AS k FROM bret), {_PART}, q AS (SELECT k AS period, * FROM ps)", "cagr sharpe mdd", 'period start "end"', 5)
def _(spark, sf):
    return B.in_out_sample(_market(spark, sf))


@query("param_grid", "a0 AS (SELECT year(d) AS value, row_number() OVER (ORDER BY year(d) DESC) - 1 AS at FROM cal GROUP BY 1), b0 AS (SELECT asset AS value, ord - 1 AS at FROM uni), q AS (SELECT concat_ws('-', a0.value, b0.value) AS run_id, a0.value::BIGINT AS year, b0.value AS asset FROM a0 CROSS JOIN b0 WHERE a0.at * (SELECT count(*) FROM b0) + b0.at < 20)", "", "run_id year asset")
def _(spark, sf):
    """Start years, the latest first, and assets: a run for each pair, 20 at most in that order."""
    p = D.prices(spark, sf)
    years = p.groupBy(F.year("d").cast("long").alias("value")).count().select("value", (F.row_number().over(W.orderBy(F.desc("value"))) - 1).cast("long").alias("at"))
    assets = p.select((F.col("ord") - 1).alias("at"), F.col("asset").alias("value")).distinct()
    return B.param_grid({"year": years, "asset": assets}, 20)


_BOOT = """rt AS (SELECT n - 1 AS at, r, count(*) OVER () AS nn FROM bret), st AS (SELECT s.range AS sim, k.range AS k, CAST('0x' || substr(md5(concat_ws('-', 42, s.range, k.range)), 1, 15) AS BIGINT) % ((SELECT max(nn) FROM rt) - 21) AS at0 FROM range(500) s, range((SELECT CAST(ceil(max(nn) / 21.0) AS BIGINT) FROM rt)) k),
mp AS (SELECT sim, k * 21 + j.range AS step, product(1 + r) OVER (PARTITION BY sim ORDER BY k * 21 + j.range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM st CROSS JOIN range(21) j JOIN rt ON rt.at = at0 + j.range WHERE k * 21 + j.range < nn)"""


@query("mc_paths", _BOOT + ", q AS (SELECT * FROM mp)", "v", "sim step", 5)
def _(spark, sf):
    return B.bootstrap(_market(spark, sf))


@query("mc_bands", _BOOT + ", q AS (SELECT step, " + ", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM mp GROUP BY step)", "p5 p25 p50 p75 p95", "step", 5)
def _(spark, sf):
    return B.mc_bands(B.bootstrap(_market(spark, sf)))


@query("mc_fan", _BOOT + ", bd AS (SELECT step, " + ", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in (5, 50, 95)) + " FROM mp GROUP BY step), ac AS (SELECT n - 1 AS step, d, product(1 + r) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM bret), q AS (SELECT d, p5, p50, p95, nav / (SELECT nav FROM ac WHERE step = 0) AS actual FROM bd JOIN ac USING (step))", "p5 p50 p95 actual", "d", 5)
def _(spark, sf):
    """Bands of the drawn paths beside the path that was."""
    rows = _market(spark, sf)
    return B.fan(B.mc_bands(B.bootstrap(rows)), rows)


_BOOTS = """md AS (SELECT *, v / max(v) OVER (PARTITION BY sim ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd, v / lag(v, 1, 1.0) OVER (PARTITION BY sim ORDER BY step) - 1 AS r FROM mp),
fs AS (SELECT sim, arg_max(v, step) AS f, pow(arg_max(v, step), 252.0 / count(*)) - 1 AS cagr, min(dd) AS mdd, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM md GROUP BY sim)"""
_BOOTQ = " UNION ALL ".join(f"SELECT '{p}th' AS percentile, quantile_cont(cagr, {p / 100}) AS cagr, quantile_cont(mdd, {p / 100}) AS mdd, quantile_cont(sharpe, {p / 100}) AS sharpe, avg(CAST(f < 1 AS DOUBLE)) AS prob_loss, avg(CAST(mdd < -0.2 AS DOUBLE)) AS prob_dd_20, quantile_cont(cagr, 0.5) AS median_cagr FROM fs" for p in (5, 25, 50, 75, 95))


@query("mc_stats", f"{_BOOT}, {_BOOTS}, q AS ({_BOOTQ})", "cagr mdd sharpe prob_loss prob_dd_20 median_cagr", "percentile", 5)
def _(spark, sf):
    return B.mc_summary(_market(spark, sf))


def _powers(coefficients, x: str) -> str:
    """A polynomial's terms, its highest power first."""
    return "(" + " + ".join(f"({c!r}::DOUBLE) * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients)) + ")"


def _ppf(p: str) -> str:
    """SQL of the normal quantile of a number within (0, 1)."""
    t, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    far = f"{_powers(B._C, t)} / {_powers((*B._D, 1.0), t)}"
    near = f"{_powers(B._A, f'pow({q}, 2)')} * {q} / {_powers((*B._B, 1.0), f'pow({q}, 2)')}"
    return f"CASE WHEN {p} < 0.02425 THEN {far} WHEN {p} > 1 - 0.02425 THEN -({far}) ELSE {near} END"


@query("norm_ppf", f"pp AS (SELECT d, (n - 0.5)::DOUBLE / (SELECT count(*) FROM bret) AS p FROM (SELECT d, row_number() OVER (ORDER BY r, d) AS n FROM bret)), q AS (SELECT d, p, {_ppf('p')} AS z FROM pp)", "p z", "d")
def _(spark, sf):
    """Normal scores of the market's returns: the quantile of each day's place among all."""
    x = SC.global_number(_market(spark, sf), [F.asc("ret"), F.asc("d")], "k")
    p = (F.col("k") - 0.5) / F.col("n")
    return x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n")))).select("d", p.alias("p"), B.norm_ppf(p).alias("z"))


@query("deflated_sharpe", f"""rs AS (SELECT asset, count(r) AS obs, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM ret GROUP BY asset), tn AS (SELECT count(*)::DOUBLE AS k FROM rs), ab AS (SELECT rs.*, 1 - 1 / k AS a, 1 - 1 / (k * exp(1.0)) AS b FROM rs, tn),
dz AS (SELECT *, (1 - 0.5772156649015329) * ({_ppf('a')}) + 0.5772156649015329 * ({_ppf('b')}) AS z FROM ab), q AS (SELECT asset, sharpe, z / sqrt(obs) * sqrt(252.0) AS expected_max, sharpe - z / sqrt(obs) * sqrt(252.0) AS haircut FROM dz)""", "sharpe expected_max haircut", "asset", 5)
def _(spark, sf):
    """Each asset's Sharpe ratio beside what the best of as many assets would show by chance."""
    s = R.with_returns(D.prices(spark, sf)).groupBy("asset").agg(F.count("r").alias("obs"), M.ratio(F.avg("r"), F.stddev_samp("r"), 252).alias("sharpe"))
    chance = B.deflated_sharpe(F.count(F.lit(1)).over(W.partitionBy()), F.col("obs"))
    return s.select("asset", "sharpe", chance.alias("expected_max"), (F.col("sharpe") - chance).alias("haircut"))


def _stats_of(table: str) -> str:
    """Statistics of a table (n, d, v, r, tr)."""
    return f"""e0 AS (SELECT *, v / max(v) OVER (ORDER BY n) - 1 AS dd FROM {table}), e1 AS (SELECT pow(arg_max(v, n) / arg_min(v, n), 252.0 / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / stddev_samp(r) FILTER (r < -1e-12) * sqrt(252) AS sortino, min(dd) AS mdd, sum(tr) / (count(*) / 252.0) AS turnover FROM e0)"""


_STATED = "cagr vol sharpe sortino calmar mdd turnover".split()
_GRID = {"window": [20, 50, 100], "sizing": ["Equal"]}


def _sweep_sql(runs: list[tuple[str, str, str]], rounded: bool = True) -> str:
    """Statistics of runs (columns that name it, its target weights, its dead band); unrounded for what sums them up."""
    cols = ", ".join(f"round({c}, 5) + 0.0::DOUBLE AS {c}" if rounded else c for c in _STATED)
    return " UNION ALL ".join(f"""SELECT {named}, NULL::VARCHAR AS error, {cols} FROM ({D.SQL.rstrip()},
{_walk(band, held=held)}), ru AS (SELECT *, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS r FROM sim), {_stats_of("ru")} SELECT *, cagr / abs(mdd) AS calmar FROM e1)""" for named, held, band in runs)


_WINDOWS = _sweep_sql([(f"""'{n}-Equal' AS run_id, '{n}' AS "window", 'Equal' AS sizing""", _trend(n), "0") for n in _GRID["window"]])


def _swept(spark, sf, grid: dict, **setting) -> DataFrame:
    p = D.prices(spark, sf)
    return B.parameter_sweep(p, "sma_trend", {}, grid, A.rebalance_calendar(p, "monthly"), B.Setting(rate=E.Costs().rate, **setting))


@query("parameter_sweep", _WINDOWS, digits=5)
def _(spark, sf):
    """Moving-average windows: runs as data, over one stored panel."""
    return _swept(spark, sf, _GRID)


def _buffered(n: int, b: float) -> str:
    """The weights of sma_trend with a buffer, in place of _HELD."""
    turn = f"CASE WHEN coalesce(px < ma * {1 - b}, false) THEN 0.0 WHEN coalesce(px > ma * {1 + b}, false) THEN 1.0 END" if b else "CASE WHEN coalesce(px > ma, false) THEN 1.0 ELSE 0.0 END"
    state = "coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    return f"SELECT * REPLACE (CASE WHEN px IS NOT NULL THEN w ELSE 0 END AS w) FROM (SELECT *, {state} / nullif(sum(m) OVER (PARTITION BY d), 0) AS w FROM (SELECT *, {turn} AS s FROM (SELECT *, {_guard('avg', 'px', n)} AS ma FROM rr)))"


_SURFACE = {"window": [20, 50], "buffer": [0.0, 2.0]}
_SURFACE_RUNS = [(f"""'{n}-{b}' AS run_id, '{n}' AS "window", '{b}' AS buffer""", _buffered(n, b / 100), "0") for n in _SURFACE["window"] for b in _SURFACE["buffer"]]
_SURFACE_SQL = _sweep_sql(_SURFACE_RUNS)


@query("sweep_pivot", f"""SELECT "window", round(max(sharpe) FILTER (buffer = '0.0'), 5) AS b0, round(max(sharpe) FILTER (buffer = '2.0'), 5) AS b2 FROM ({_SURFACE_SQL}) GROUP BY 1""", digits=5)
def _(spark, sf):
    return B.sweep_pivot(_swept(spark, sf, _SURFACE), "window", "buffer", "sharpe").withColumnsRenamed({"0.0": "b0", "2.0": "b2"})


@query("sweep_line", f"""SELECT CAST("window" AS DOUBLE) AS "window", round(avg(sharpe), 4) AS sharpe FROM ({_sweep_sql(_SURFACE_RUNS, rounded=False)}) GROUP BY 1""", digits=4)
def _(spark, sf):
    """A line over one parameter: the mean over the other."""
    return B.sweep_line(_swept(spark, sf, _SURFACE), "window", "sharpe")


@query("sweep_spread", f"""WITH sw AS ({_WINDOWS}), tr AS (SELECT count(*) AS trials, max(sharpe) - min(sharpe) AS spread FROM sw), ob AS (SELECT count(DISTINCT CAST(l_shipdate AS DATE)) AS obs FROM lineitem), ab AS (SELECT *, 1 - 1.0::DOUBLE / trials AS a, 1 - 1 / (trials * exp(1.0)) AS b FROM tr, ob),
dz AS (SELECT *, ((1 - 0.5772156649015329) * ({_ppf('a')}) + 0.5772156649015329 * ({_ppf('b')})) / sqrt(obs) * sqrt(252.0) AS z FROM ab) SELECT trials, round(spread, 4) AS spread, round(z, 4) AS expected_max_sharpe, NULL::DOUBLE AS haircut FROM dz""", digits=4)
def _(spark, sf):
    return B.sweep_spread(_swept(spark, sf, _GRID), "sharpe", D.prices(spark, sf).agg(F.max("n")).first()[0])


@query("sweep_surface", digits=5)
def _(spark, sf):
    """Seven windows by seven buffers: 49 runs in one plan."""
    return _swept(spark, sf, {"window": [10, 20, 35, 50, 80, 120, 200], "buffer": [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]})


@query("sweep_banded", _sweep_sql([(f"""'{n}' AS run_id, '{n}' AS "window\"""", _trend(n), "0.02") for n in (20, 100)]), digits=5)
def _(spark, sf):
    """The sweep under a dead band: a walk for each run."""
    return _swept(spark, sf, {"window": [20, 100]}, min_trade=0.02)


@query("sweep_grid_400", digits=5)
def _(spark, sf):
    """Lookbacks, skips, names and trend windows of dual momentum: 400 of 420 combinations, in one plan."""
    p = D.prices(spark, sf)
    grid = {"lookback": [20, 40, 63, 84, 105, 126, 168], "skip": [0, 5, 10, 21], "top_n": [1, 2, 3], "trend_window": [20, 50, 100, 150, 200]}
    return B.parameter_sweep(p, "dual_momentum", {}, grid, A.rebalance_calendar(p, "monthly"), B.Setting(rate=E.Costs().rate))


def _trend_run(spark, sf) -> DataFrame:
    p = D.prices(spark, sf)
    t = S.get("sma_trend").generate(p, {"window": LONG}).withColumn("run_id", F.lit("trend"))
    return stored(E.closed_form(E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1), E.Costs().rate))


_TRENDED = _walk("0", held=_trend(LONG)) + "), ru AS (SELECT *, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS r, list_sum(w) AS e FROM sim)"


@query("walk_forward", f"{_TRENDED}, pt AS (SELECT n, d, r, ntile(5) OVER (ORDER BY n) AS k FROM ru), {_PART}, q AS (SELECT k AS fold, start, \"end\", cagr, vol, CASE WHEN vol > 0.002 THEN sharpe END AS sharpe, mdd FROM ps)", "cagr vol sharpe mdd", 'fold start "end"', 5)
def _(spark, sf):
    return B.walk_forward(_trend_run(spark, sf))


@query("fold_dispersion", f"{_TRENDED}, pt AS (SELECT n, d, r, ntile(5) OVER (ORDER BY n) AS k FROM ru), {_PART}, q AS (SELECT stddev_samp(CASE WHEN vol > 0.002 THEN sharpe END) AS sharpe_dispersion, min(CASE WHEN vol > 0.002 THEN sharpe END) AS sharpe_min, sharpe_dispersion > 0.6 AS high FROM ps)", "sharpe_dispersion sharpe_min", "high", 5)
def _(spark, sf):
    return B.dispersion(B.walk_forward(_trend_run(spark, sf)))


@query("cost_statistics", "q AS (SELECT 1)", digits=5)
def _(spark, sf):
    return B.cost_statistics(E.closed_form(_run(spark, sf), 0.0), LEVELS).drop("run_id")


_SQL["cost_statistics"] = f"""{D.SQL.rstrip()},\n{_walk('0', '0.0')}), lv AS (SELECT unnest([{', '.join(map(str, LEVELS))}])::DOUBLE AS bps), gr AS (SELECT *, v / lag(v, 1, 1.0) OVER (ORDER BY n) AS g FROM sim),
lr AS (SELECT bps, n, g * (1 - tr * bps / 1e4) - 1 AS r FROM gr CROSS JOIN lv), le AS (SELECT *, product(1 + r) OVER (PARTITION BY bps ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM lr), ld AS (SELECT *, v / max(v) OVER (PARTITION BY bps ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM le)
SELECT bps, round(pow(arg_max(v, n) / arg_min(v, n), 252.0 / count(*)) - 1, 5) + 0.0::DOUBLE AS cagr, round(avg(r) / stddev_samp(r) * sqrt(252), 5) + 0.0::DOUBLE AS sharpe, round(min(dd), 5) + 0.0::DOUBLE AS mdd FROM ld GROUP BY bps"""


def _banded(spark, sf, rate: float) -> DataFrame:
    """Half in the assets, cash at its proxy's return, under a dead band."""
    return stored(E.kernel(_half(spark, sf), rate, min_trade=0.005).select("run_id", "d", "nav", "ret", "turnover"))


_HALF_RUN = _walk("0.005", held=_HALF, cash=_PROXY) + "), ru AS (SELECT *, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS r FROM sim)"


@query("walk_forward_banded", f"{_HALF_RUN}, pt AS (SELECT n, d, r, ntile(5) OVER (ORDER BY n) AS k FROM ru), {_PART}, q AS (SELECT k AS fold, start, \"end\", cagr, vol, CASE WHEN vol > 0.002 THEN sharpe END AS sharpe, mdd FROM ps)", "cagr vol sharpe mdd", 'fold start "end"', 5)
def _(spark, sf):
    return B.walk_forward(_banded(spark, sf, E.Costs().rate))


@query("cost_statistics_banded", "q AS (SELECT 1)", digits=5)
def _(spark, sf):
    """Levels of costs of a run with a cash proxy and a dead band: what is traded doesn't depend on them."""
    return B.cost_statistics(_banded(spark, sf, 0.0), LEVELS).drop("run_id")


_SQL["cost_statistics_banded"] = _SQL["cost_statistics"].replace(_walk("0", "0.0"), _walk("0.005", "0.0", held=_HALF, cash=_PROXY))


@query("align_start", f"{_TRENDED}, fa AS (SELECT min(n) AS n0 FROM ru WHERE e > 1e-9), q AS (SELECT 'trend' AS run_id, d, v / first_value(v) OVER (ORDER BY n) AS nav, CASE WHEN n = n0 THEN 0 ELSE r END AS ret FROM ru, fa WHERE n >= n0 UNION ALL SELECT 'market', b.d, px / first_value(px) OVER (ORDER BY b.n), CASE WHEN b.n = n0 THEN 0 ELSE r END FROM bret b, fa WHERE b.n >= n0)", "nav ret", "run_id d")
def _(spark, sf):
    market = E.benchmark_result(D.benchmark(spark, sf)).select(F.lit("market").alias("run_id"), "d", "nav", "ret", F.lit(1.0).alias("exposure"))
    return E.align_start(_trend_run(spark, sf).select("run_id", "d", "nav", "ret", "exposure").unionByName(market)).select("run_id", "d", "nav", "ret")


# ---- options of the simulation -----------------------------------------------------------------


def _held(spark, sf, **options) -> tuple[DataFrame, DataFrame]:
    """(panel, targets) of equal weights."""
    p = D.prices(spark, sf)
    return p, S.get("buy_hold").generate(p).withColumn("run_id", F.lit("run"))


_PAID = "CASE WHEN d IN (SELECT max(d) FROM cal GROUP BY date_trunc('quarter', d)) THEN 0.005 * px / before END"
_SIGNALS = "SELECT b.d FROM cal a JOIN cal b ON b.n = a.n + 1 WHERE a.d IN (SELECT d FROM wimp)"


@query("bt_dividends", _walk("0.005", income=_PAID) + "), q AS (SELECT d, v AS nav, tr AS turnover, list_sum(w) AS exposure FROM sim)", "nav turnover exposure", "d")
def _(spark, sf):
    p, t = _held(spark, sf)
    x = E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1, dividends=D.dividends(p))
    return E.kernel(x, E.Costs().rate, min_trade=0.005).select("d", "nav", "turnover", "exposure")


_INCOME = _walk("0.005", income=_PAID) + "), di AS (SELECT b.d, b.n, list_sum(list_transform(list_zip(a.w, dy.dv), lambda z: z[1] * z[2])) AS income, b.tr * 0.003 AS cost FROM sim a JOIN sim b ON b.n = a.n + 1 JOIN dy ON dy.n = b.n UNION ALL SELECT d, n, 0.0::DOUBLE, 0.0::DOUBLE FROM sim WHERE n = 1)"


def _paid(spark, sf) -> DataFrame:
    p, t = _held(spark, sf)
    x = E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1, dividends=D.dividends(p))
    return E.kernel(x, E.Costs().rate, min_trade=0.005)


@query("dividend_totals", _INCOME + ", q AS (SELECT year(d)::INTEGER AS year, sum(income) AS income, sum(cost) AS cost FROM di GROUP BY 1)", "income cost", "year")
def _(spark, sf):
    """Income and costs by year."""
    return _paid(spark, sf).groupBy(F.year("d").alias("year")).agg(F.sum("div_income").alias("income"), F.sum("cost").alias("cost"))


@query("dividend_summary", _INCOME + ", q AS (SELECT sum(income) AS total, sum(income) / (count(*) / 252.0) AS per_year, count(*) FILTER (income > 0) AS payment_days FROM di)", "total per_year", "payment_days")
def _(spark, sf):
    return M.income_summary(_paid(spark, sf)).drop("run_id")


@query("dividend_cumulative", _INCOME + ", q AS (SELECT d, sum(100 * income) OVER (ORDER BY n) AS cumulative FROM di)", "cumulative", "d")
def _(spark, sf):
    """The line of cumulative income, in percent of the portfolio's value."""
    return M.cumulative_income(_paid(spark, sf)).select("d", "cumulative")


@query("bt_explicit_dates", _walk("0", events=_SIGNALS) + "), q AS (SELECT d, v AS nav, tr AS turnover FROM sim)", "nav turnover", "d")
def _(spark, sf):
    p, t = _held(spark, sf)
    x = E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1, signals=D.imported_weights(spark, sf).select("d").distinct())
    return E.closed_form(x, E.Costs().rate).select("d", "nav", "turnover")


_OPEN = f"""r0 AS (SELECT *, lag(px) OVER (PARTITION BY asset ORDER BY n) AS before FROM px), r1 AS (SELECT *, CASE WHEN day(d) > 1 AND before + (px - before) / 4 > 0 THEN before + (px - before) / 4 ELSE before END AS op FROM r0),
rr AS (SELECT d, n, asset, px, coalesce(op / before - 1, 0) AS ro, coalesce(px / op - 1, 0) AS r, CASE WHEN px IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS m FROM r1), tw AS ({_HELD}), tl AS (SELECT *, coalesce(lag(w, 1) OVER (PARTITION BY asset ORDER BY n), 0) AS t FROM tw), reb AS ({_MONTHLY}),
dy AS (SELECT tl.d, n, list(ro ORDER BY asset) AS ro, list(r ORDER BY asset) AS r, list(t ORDER BY asset) AS t, bool_or(reb.d IS NOT NULL) AND n > 1 AS ev FROM tl LEFT JOIN reb ON tl.d = reb.d GROUP BY tl.d, n),
sim AS (SELECT n, d, list_transform(t, lambda x: 0.0::DOUBLE) AS w, 1.0::DOUBLE AS c, 1.0::DOUBLE AS v, 0.0::DOUBLE AS tr, 0.0::DOUBLE AS port FROM dy WHERE n = 1 UNION ALL
SELECT n, d, list_transform(w3, lambda x: x / (list_sum(w3) + c3)), c3 / (list_sum(w3) + c3), v * (list_sum(w3) + c3), tr, list_sum(w3) + c3 - 1 FROM (
SELECT n, d, v, tr, list_transform(list_zip(w2, r), lambda z: z[1] * (1 + z[2])) AS w3, c2 AS c3 FROM (
SELECT n, d, v, r, CASE WHEN ev THEN tr0 ELSE 0.0::DOUBLE END AS tr, CASE WHEN ev THEN list_transform(nw, lambda x: x * base * (1 - tr0 * 0.003)) ELSE w1 END AS w2, CASE WHEN ev THEN (1 - list_sum(nw)) * base * (1 - tr0 * 0.003) ELSE c END AS c2 FROM (
SELECT *, list_sum(list_transform(list_zip(nw, now), lambda z: abs(z[1] - z[2]))) AS tr0 FROM (SELECT *, list_transform(list_zip(now, t), lambda z: CASE WHEN abs(z[2] - z[1]) < 0.005 THEN z[1] ELSE z[2] END) AS nw0, list_sum(list_transform(nw0, lambda x: abs(x))) AS g0, CASE WHEN g0 > 1 THEN list_transform(nw0, lambda x: x / g0) ELSE nw0 END AS nw FROM (
SELECT *, list_transform(w1, lambda x: x / base) AS now FROM (SELECT dy.n, dy.d, dy.r, dy.t, dy.ev, sim.c, sim.v, list_transform(list_zip(sim.w, dy.ro), lambda z: z[1] * (1 + z[2])) AS w1, list_sum(w1) + sim.c AS base FROM sim JOIN dy ON dy.n = sim.n + 1))))))"""


@query("bt_open_exec", _OPEN + "), q AS (SELECT d, v AS nav, port AS ret, port + tr * 0.003 AS gross_ret, tr AS turnover, tr * 0.003 AS cost FROM sim)", "nav ret gross_ret turnover cost", "d")
def _(spark, sf):
    p, t = _held(spark, sf)
    x = E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1, opens=D.opens(p))
    return E.kernel(x, E.Costs().rate, min_trade=0.005, at_open=True).select("d", "nav", "ret", "gross_ret", "turnover", "cost")


@query("bt_daily_returns", _walk("0.005") + "), q AS (SELECT d, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS ret, v / (1 - tr * 0.003) / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS gross_ret FROM sim)", "ret gross_ret", "d")
def _(spark, sf):
    return E.kernel(_run(spark, sf), E.Costs().rate, min_trade=0.005).select("d", "ret", "gross_ret")


_CHANGED = "bg AS (SELECT dy.d, asset, s0.w[ord] * (1 + dy.r[ord]) / (list_sum(list_transform(list_zip(s0.w, dy.r), lambda z: z[1] * (1 + z[2]))) + s0.c) AS weight_before, s1.w[ord] AS weight_after FROM dy JOIN sim s0 ON s0.n = dy.n - 1 JOIN sim s1 ON s1.n = dy.n CROSS JOIN uni WHERE ev AND s1.tr > 0)"


@query("bt_general_trades", _walk("0.005") + f"), {_CHANGED}, q AS (SELECT *, weight_after - weight_before AS change FROM bg WHERE abs(weight_after - weight_before) > 1e-12)", "weight_before weight_after change", "d asset")
def _(spark, sf):
    x = _run(spark, sf)
    return E.kernel_trades(E.kernel(x, E.Costs().rate, min_trade=0.005), x).select("d", "asset", "weight_before", "weight_after", "change")


_BANDS = (0.0, 0.005, 0.01, 0.02)


@query("bt_segments", " UNION ALL ".join(f"""SELECT '{b}' AS run_id, {", ".join(f"round({c}, 5) + 0.0::DOUBLE AS {c}" for c in _STATED)} FROM ({D.SQL.rstrip()},
{_walk(str(b))}), ru AS (SELECT *, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS r FROM sim), {_stats_of("ru")} SELECT *, cagr / abs(mdd) AS calmar FROM e1)""" for b in _BANDS), digits=5)
def _(spark, sf):
    """Dead bands of four widths: four runs in one simulation."""
    bands = spark.createDataFrame([(str(b), b) for b in _BANDS], "run_id string, band double")
    x = _run(spark, sf).drop("run_id").crossJoin(F.broadcast(bands))
    return B.run_statistics(E.kernel(x, E.Costs().rate, min_trade="band").select("run_id", "d", "nav", "ret", "turnover"))


@query("trades_tail", _walk("0") + f"), {_BEFORE}, q AS (SELECT d, asset, weight_after FROM bf WHERE held <> 0 OR weight_after <> 0 ORDER BY d DESC, asset LIMIT 400)", "weight_after", "d asset")
def _(spark, sf):
    return E.trades(_run(spark, sf)).orderBy(F.desc("d"), "asset").limit(400).select("d", "asset", "weight_after")


@query("current_holdings", _walk("0") + "), la AS (SELECT * FROM sim ORDER BY n DESC LIMIT 1), q AS (SELECT asset AS instrument, la.w[ord] AS weight, la.w[ord] * v AS value FROM la CROSS JOIN uni WHERE abs(la.w[ord]) > 1e-6 UNION ALL SELECT 'Cash', 1 - list_sum(w), (1 - list_sum(w)) * v FROM la)", "weight value", "instrument")
def _(spark, sf):
    x = _run(spark, sf)
    return K.current_holdings(E.weights_after(x), E.closed_form(x, E.Costs().rate)).drop("run_id")


@query("daily_series", _walk("0") + "), bn AS (SELECT d, px / first_value(px) OVER (ORDER BY d) AS y FROM bret), q AS (SELECT sim.d, v AS value, v / lag(v, 1, 1.0) OVER (ORDER BY n) - 1 AS \"return\", list_sum(w) AS exposure, 1 - list_sum(w) AS cash, tr AS turnover, tr * 0.003 AS costs, y AS benchmark FROM sim LEFT JOIN bn USING (d))", 'value "return" exposure cash turnover costs benchmark', "d")
def _(spark, sf):
    return K.daily_series(E.closed_form(_run(spark, sf), E.Costs().rate), E.benchmark_result(D.benchmark(spark, sf))).drop("run_id")


_MONTHS = "mq AS (SELECT avg(CAST(ret > 1e-12 AS DOUBLE)) AS positive_months, max(ret) AS best_month, min(ret) AS worst_month FROM mr)"


@query("report", f"""{_EQ}, {_STATS}, {_MON}, {_MONTHS}, vv AS (SELECT quantile_cont(r, 0.05) AS var FROM bret), vc AS (SELECT any_value(var) AS var, avg(r) FILTER (r <= var) AS cvar FROM bret, vv),
al AS (SELECT total_return, cagr, vol, sharpe, sortino, cagr / abs(mdd) AS calmar, mdd, ulcer, skew, kurtosis, var, cvar, positive_months, best_month, worst_month FROM sx, vc, mq), q AS (UNPIVOT al ON COLUMNS(*) INTO NAME metric VALUE value)""", "value", "metric", 5)
def _(spark, sf):
    return M.report(_market(spark, sf)).select("metric", "value")


_RUN_STATS = """rn AS (SELECT n, d, r, v AS nav, v / max(v) OVER (ORDER BY n) - 1 AS dd, tr, e FROM ru), st AS (SELECT count(*) AS n, arg_min(nav, n) AS f, arg_max(nav, n) AS l, stddev_samp(r) AS sd, avg(r) AS m, stddev_samp(r) FILTER (r < -1e-12) AS sn, min(dd) AS mdd, sqrt(avg(pow(100 * dd, 2))) AS ulcer, skewness(r) AS skew, kurtosis(r) AS kurtosis, sum(tr) / (count(*) / 252.0) AS annual_turnover, avg(e) AS average_exposure FROM rn),
sx AS (SELECT *, pow(l / f, 252.0 / n) - 1 AS cagr, l / f - 1 AS total_return, sd * sqrt(252) AS vol, m / sd * sqrt(252) AS sharpe, m / sn * sqrt(252) AS sortino FROM st), vv AS (SELECT quantile_cont(r, 0.05) AS var FROM rn), vc AS (SELECT any_value(var) AS var, avg(r) FILTER (r <= var) AS cvar FROM rn, vv)"""
_REGRESSED = "bb AS (SELECT rn.r AS y, bret.r AS x FROM rn JOIN bret ON rn.d = bret.d), bx AS (SELECT covar_samp(y, x) / var_samp(x) AS beta, (avg(y) - covar_samp(y, x) / var_samp(x) * avg(x)) * 252 AS alpha, corr(y, x) * corr(y, x) AS r2, stddev_samp(y - x) * sqrt(252) AS tracking_error, avg(y - x) * 252 / (stddev_samp(y - x) * sqrt(252)) AS information_ratio FROM bb)"


@query("report_with_benchmark", f"""{_TRENDED}, {_RUN_STATS}, {_MON.replace("FROM bret", "FROM rn")}, {_MONTHS}, {_REGRESSED}, al AS (SELECT total_return, cagr, vol, sharpe, sortino, cagr / abs(mdd) AS calmar, mdd, ulcer, skew, kurtosis, var, cvar, positive_months, best_month, worst_month, annual_turnover, average_exposure, beta, alpha, r2, tracking_error, information_ratio FROM sx, vc, mq, bx), q AS (UNPIVOT al ON COLUMNS(*) INTO NAME metric VALUE value)""", "value", "metric", 5)
def _(spark, sf):
    return M.report(_trend_run(spark, sf), _market(spark, sf)).select("metric", "value")


@query("return_frequency", "g AS (SELECT CAST(d - lag(d) OVER (ORDER BY d) AS DOUBLE) AS g FROM (SELECT DISTINCT d FROM factor)), m AS (SELECT quantile_cont(g, 0.5) AS median_gap, count(g) AS k FROM g), q AS (SELECT median_gap, CASE WHEN k < 2 THEN 'undetermined' WHEN median_gap <= 4 THEN 'daily' WHEN median_gap <= 10 THEN 'weekly' WHEN median_gap <= 45 THEN 'monthly' WHEN median_gap <= 135 THEN 'quarterly' WHEN median_gap <= 250 THEN 'semi-annual' ELSE 'annual' END AS frequency, CASE WHEN k < 2 OR median_gap <= 4 THEN 252 WHEN median_gap <= 10 THEN 52 WHEN median_gap <= 45 THEN 12 WHEN median_gap <= 135 THEN 4 WHEN median_gap <= 250 THEN 2 ELSE 1 END AS periods FROM m)", "median_gap", "frequency periods")
def _(spark, sf):
    return A.stream_frequency(D.factor(spark, sf))


# ---- imported weights and returns --------------------------------------------------------------

_IMP = """wg AS (SELECT d AS file_d, sum(abs(w * 100)) AS g FROM wimp GROUP BY d), ws AS (SELECT d AS file_d, asset, w * 100 / CASE WHEN (SELECT quantile_cont(g, 0.5) FROM wg) BETWEEN 40 AND 160 THEN 100 ELSE 1 END AS w FROM wimp),
sn AS (SELECT f.file_d, cal.d AS d FROM (SELECT DISTINCT file_d FROM ws) f ASOF JOIN cal ON f.file_d >= cal.d), wr AS (SELECT la.d, asset, w FROM ws JOIN (SELECT d, max(file_d) AS file_d FROM sn GROUP BY d) la USING (file_d)),
wd AS (SELECT px.d, px.n, px.asset, CASE WHEN px.d IN (SELECT d FROM wr) THEN coalesce(wr.w, 0) END AS w0, px.d IN (SELECT d FROM wr) AS is_rebal FROM px LEFT JOIN wr ON px.d = wr.d AND px.asset = wr.asset),
wf AS (SELECT *, coalesce(last_value(w0 IGNORE NULLS) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w FROM wd)"""


def _percent(spark, sf):
    return D.imported_weights(spark, sf).withColumn("w", F.col("w") * 100)


@query("external_weights_dense", _IMP + ", q AS (SELECT * FROM wf)", "w", "d asset is_rebal")
def _(spark, sf):
    return I.external_weights(_percent(spark, sf), D.prices(spark, sf)).select("d", "asset", "is_rebal", "w")


@query("external_weights_normalized", _IMP + ", q AS (SELECT d, asset, is_rebal, CASE WHEN is_rebal THEN w / nullif(sum(abs(w)) OVER (PARTITION BY d), 0) ELSE w END AS w FROM wf)", "w", "d asset is_rebal")
def _(spark, sf):
    return I.external_weights(_percent(spark, sf), D.prices(spark, sf), True).select("d", "asset", "is_rebal", "w")


@query("weights_report", _IMP + ", wy AS (SELECT d, sum(abs(w)) AS g FROM wf WHERE is_rebal GROUP BY d), q AS (SELECT count(*) AS rebalances, avg(g) AS mean_gross, max(g) AS max_gross, count(*) FILTER (g > 1 + 1e-9) AS over, count(*) FILTER (g < 0.99) AS under, (SELECT count(*) FROM (SELECT asset FROM wf WHERE is_rebal GROUP BY asset HAVING sum(abs(w)) > 0)) AS instruments FROM wy)", "mean_gross max_gross", "rebalances over under instruments")
def _(spark, sf):
    return I.weights_report(I.external_weights(_percent(spark, sf), D.prices(spark, sf)))


@query("weight_flags", _IMP + ", fy AS (SELECT d, n, bool_or(is_rebal) AS e, sum(abs(w)) AS g, min(w) AS low FROM wf GROUP BY d, n), fl AS (SELECT unnest(['shorts', 'over', 'under', 'idle']) AS flag, unnest([count(*) FILTER (low < -1e-9), count(*) FILTER (e AND g > 1 + 1e-9), count(*) FILTER (e AND g < 0.99), CASE WHEN min(n) FILTER (e) - 1 > 5 THEN min(n) FILTER (e) - 1 ELSE 0 END]) AS n FROM fy), q AS (SELECT * FROM fl WHERE n > 0)", "", "flag n")
def _(spark, sf):
    return I.weight_flags(I.external_weights(_percent(spark, sf), D.prices(spark, sf)), idle=5)


_STREAMS = "sk AS (SELECT CASE WHEN quantile_cont(abs(r * 100), 0.5) > 0.05 THEN 100 ELSE 1 END AS k FROM ret), rp AS (SELECT d, asset AS series, coalesce(r * 100 / k, 0) AS ret FROM ret, sk)"


def _streams(spark, sf) -> DataFrame:
    return R.with_returns(D.prices(spark, sf)).select("d", F.col("asset").alias("series"), (F.col("r") * 100).alias("ret"))


@query("prepared_returns", _STREAMS + ", q AS (SELECT * FROM rp)", "ret", "d series")
def _(spark, sf):
    return I.prepared_returns(_streams(spark, sf))


@query("return_flags", _STREAMS + ", rm AS (SELECT d, series, abs(ret) * 30 AS ret FROM rp), rs AS (SELECT count(*) FILTER (ret < 0) AS losses, count(*) FILTER (ret > 1) AS extreme, count(DISTINCT d) AS days FROM rm), q AS (SELECT 'no_losses' AS flag, days AS n FROM rs WHERE losses = 0 UNION ALL SELECT 'extreme', extreme FROM rs WHERE extreme > 0 UNION ALL SELECT 'thin', days FROM rs WHERE days < 60)", "", "flag n")
def _(spark, sf):
    return I.return_flags(I.prepared_returns(_streams(spark, sf)).withColumn("ret", F.abs("ret") * 30))


@query("weights_scale_detect", "g AS (SELECT d, sum(abs(w * 100)) AS g FROM wimp GROUP BY d), q AS (SELECT quantile_cont(g, 0.5) AS median, CASE WHEN quantile_cont(g, 0.5) BETWEEN 40 AND 160 THEN 100.0 ELSE 1.0 END::DOUBLE AS divisor FROM g)", "median divisor")
def _(spark, sf):
    return A.detect_scale(_percent(spark, sf).groupBy("d").agg(F.sum(F.abs("w")).alias("g")), 40, 160)


@query("weights_scale_fractions", "g AS (SELECT d, sum(abs(w)) AS g FROM wimp GROUP BY d), q AS (SELECT quantile_cont(g, 0.5) AS median, CASE WHEN quantile_cont(g, 0.5) BETWEEN 40 AND 160 THEN 100.0 ELSE 1.0 END::DOUBLE AS divisor FROM g)", "median divisor")
def _(spark, sf):
    """Weights that are fractions already."""
    return A.detect_scale(D.imported_weights(spark, sf).groupBy("d").agg(F.sum(F.abs("w")).alias("g")), 40, 160)


_PAIRED = "w1 AS (SELECT d + 1 AS d, asset, w FROM wimp WHERE asset <> (SELECT min(asset) FROM uni)), wimp2 AS (SELECT * FROM wimp UNION ALL SELECT * FROM w1)"


@query("external_weights_paired", _PAIRED + ", " + _IMP.replace("FROM wimp", "FROM wimp2") + ", q AS (SELECT * FROM wf)", "w", "d asset is_rebal")
def _(spark, sf):
    """A second file row a day after each, which leaves out an asset: where both fall on one session the later
    holds as a whole."""
    raw = _percent(spark, sf)
    first = raw.agg(F.min("asset").alias("_least"))
    later = raw.crossJoin(F.broadcast(first)).where("asset <> _least").select(F.date_add("d", 1).alias("d"), "asset", "w")
    return I.external_weights(raw.unionByName(later), D.prices(spark, sf)).select("d", "asset", "is_rebal", "w")


@query("returns_scale_detect", "s AS (SELECT CASE WHEN quantile_cont(abs(r * 100), 0.5) > 0.05 THEN 100 ELSE 1 END AS k FROM bret), q AS (SELECT d, r * 100 / k AS ret FROM bret, s)", "ret", "d")
def _(spark, sf):
    return I.scaled_returns(_market(spark, sf).select("d", (F.col("ret") * 100).alias("ret")))


@query("returns_sanity", "q AS (SELECT count(*) AS n, count(*) FILTER (r IS NULL) AS missing, count(*) FILTER (abs(r) > 1) AS extreme, count(*) FILTER (r < 0) AS negatives FROM bret)", "", "n missing extreme negatives")
def _(spark, sf):
    return I.returns_sanity(_market(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, nav, ret) of a monthly trend-following portfolio."""
    p = D.prices(spark, sf_dir)
    t = S.get("sma_trend").generate(p, {"window": LONG}).withColumn("run_id", F.lit("trend"))
    return tidy(E.closed_form(E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1), E.Costs().rate).select("d", "nav", "ret"))
