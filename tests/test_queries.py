"""Queries against DuckDB, and properties of the simulation."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import rolling as R
from tidepanel.operators import align as A
from tidepanel.operators import clean as C
from tidepanel.operators import engine as E
from tidepanel.operators import robustness as B
from tidepanel.operators import strategies as S
from tidepanel.operators import sweep as W
from tidepanel.plans import catalog as K
from tidepanel.sources import market as D

SF = "/root/testdata/sf0.01"
FAST = ["walk_forward_banded", "cost_statistics_banded", "mc_bands", "mc_stats", "mc_fan", "topn_rank", "in_out_sample", "rolling_sharpe", "param_grid", "sweep_pivot", "sweep_line", "sweep_spread", "sweep_banded", "bt_cash_proxy", "bt_cash_proxy_general", "bt_open_exec", "bt_general_trades", "bt_segments", "trades_tail", "dividend_totals", "dividend_summary", "dividend_cumulative", "report_with_benchmark", "fold_dispersion", "external_weights_paired", "weights_scale_detect", "weights_scale_fractions", "histogram_line", "stream_result", "trim_warmup", "bounded_ffill", "exog_asof", "snap_dates", "sma", "rsi", "pct_rank_avg", "strat_dual_momentum", "bt_nav_closed_form", "bt_general", "drawdown_table", "monthly_returns", "fold_stats", "external_weights_normalized", "var_cvar",
        "parameter_sweep", "walk_forward", "cost_statistics", "cost_sensitivity", "align_start", "bt_dividends", "bt_explicit_dates", "bt_daily_returns", "current_holdings", "daily_series", "report", "return_frequency", "correlation_matrix", "strat_macro_gate", "strat_trend_quality",
        "ema", "norm_ppf", "deflated_sharpe", "strat_rsi_reversion_plain", "strat_macro_gate_rising", "strat_macro_gate_z_above", "strat_exog_signal_binary", "strat_exog_signal_short", "strat_exog_signal_rank", "quality_warnings", "exog_asof_limit", "exog_flags", "name_report", "weight_flags", "return_flags", "bt_trades"]


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = K.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=str)
    rel = c.sql(K.oracle_sql()[name])
    at = [rel.columns.index(x) for x in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_sweep_line_rounds_once(spark, tmp_path):
    """Trades whose mean Sharpe ratio is -0.01044975: a mean of ratios rounded to 5 digits is -0.01045."""
    small, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("lineitem", "part"):
        c.sql(f"COPY (SELECT * FROM '{small}/{t}.parquet'{' WHERE l_orderkey % 41 <> 14' if t == 'lineitem' else ''}) TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = {r["window"]: r["sharpe"] for r in K.queries()["sweep_line"](spark, str(tmp_path)).collect()}
    rel = c.sql(K.oracle_sql()["sweep_line"])
    assert got == dict(rel.select('"window"', "sharpe").fetchall()) and got[50.0] == -0.0104


def test_macro_gate_flat_by_rounding(spark):
    """A series that is flat but for its last bit has no score; the orders' totals are made once."""
    panel = _panel(spark, {"a": [1.0] * 60})
    v = [1.1e10, float(np.nextafter(1.1e10, 2e10))]
    series = panel.select("d", F.lit("X").alias("series"), F.when(F.col("n") % 3 == 0, v[1]).otherwise(v[0]).alias("v"))
    for rule, threshold in (("z below", -0.5), ("z above", 0.5)):
        g = S.get("macro_gate").generate(panel, {"series": "X", "rule": rule, "threshold": threshold, "window": 50, "risk_off": 0.25}, series)
        assert {r.w for r in g.select("w").distinct().collect()} == {0.25}
    assert "Aggregate" not in D.macro(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def _panel(spark, values: dict[str, list], start="2020-01-01"):
    days = pd.date_range(start, periods=len(next(iter(values.values())))).date
    rows = [(d, i + 1, a, k + 1, v[i]) for k, (a, v) in enumerate(values.items()) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "d date, n long, asset string, ord long, px double")


def test_closed_form_equals_kernel(spark):
    rng = np.random.default_rng(0)
    p = _panel(spark, {k: (100 * np.cumprod(1 + rng.normal(0, 0.02, 90))).tolist() for k in "abc"})
    t = S.get("buy_hold").generate(p).withColumn("run_id", F.lit("x"))
    x = E.legs(p, t, A.rebalance_calendar(p, "weekly"), 1)
    a = E.closed_form(x, 0.003).orderBy("d").toPandas()
    b = E.kernel(x, 0.003).orderBy("d").toPandas()
    assert np.allclose(a.nav, b.nav, atol=1e-12) and np.allclose(a.turnover, b.turnover, atol=1e-12)
    assert np.allclose(a.exposure + a.cash_w, 1)


@pytest.mark.parametrize("kind", ["proxy", "rate", "short proxy"])
def test_cash_earns(spark, kind):
    """Both simulators against the reference's recursion, half invested, with a proxy that has gaps or a rate."""
    rng = np.random.default_rng(3)
    v = 100 * np.cumprod(1 + rng.normal(0, 0.02, (90, 2)), axis=0)
    p = _panel(spark, {"a": v[:, 0].tolist(), "b": v[:, 1].tolist()})
    px = [None, None, *(50 * np.cumprod(1 + rng.normal(0.001, 0.003, 88))).tolist()]
    px[40:45] = [None] * 5
    if kind == "short proxy":
        px[3:] = [None] * 87
    proxy = _panel(spark, {"c": px}).select("d", "px") if kind != "rate" else None
    if kind == "proxy":
        rc = pd.Series(px, dtype=float).ffill().pct_change(fill_method=None).fillna(0).to_numpy()
    else:
        rc = np.full(90, 0.05 / 252)
    t = S.get("buy_hold").generate(p).withColumn("run_id", F.lit("x")).withColumn("w", F.col("w") * 0.5)
    events = A.rebalance_calendar(p, "weekly")
    x = E.legs(p, t, events, 1, cash=E.cash_returns(p, proxy, 0.05))
    at = {r.d for r in events.collect()}
    w, c, nav, want, left = np.zeros(2), 1.0, 1.0, [], []
    for i, d in enumerate(pd.date_range("2020-01-01", periods=90).date):
        if i:
            w, c = w * v[i] / v[i - 1], c * (1 + rc[i])
            base = w.sum() + c
            nav, w, c = nav * base, w / base, c / base
            if d in at:
                nav *= 1 - np.abs(0.25 - w).sum() * 0.003
                w, c = np.full(2, 0.25), 0.5
        want.append(nav)
        left.append(c)
    a, b = E.closed_form(x, 0.003).orderBy("d").toPandas(), E.kernel(x, 0.003).orderBy("d").toPandas()
    assert np.allclose(a.nav, want, atol=1e-12) and np.allclose(b.nav, want, atol=1e-12) and np.allclose(a.cash_w, left, atol=1e-12)


def test_no_look_ahead(spark):
    rng = np.random.default_rng(1)
    v = (100 * np.cumprod(1 + rng.normal(0, 0.02, 60))).tolist()
    w = [*v[:-1], v[-1] * 2]
    out = []
    for x in (v, w):
        p = _panel(spark, {"a": x, "b": v})
        t = S.get("sma_trend").generate(p, {"window": 5}).withColumn("run_id", F.lit("x"))
        out.append(E.closed_form(E.legs(p, t, A.rebalance_calendar(p, "weekly"), 1), 0.003).orderBy("d").toPandas().ret.to_numpy())
    assert np.allclose(out[0][:-1], out[1][:-1])


@pytest.mark.parametrize("key", sorted(S.REGISTRY))
def test_weights_know_no_future(spark, key):
    """What comes after a day changes no strategy's weights up to it."""
    rng = np.random.default_rng(1)
    v = {k: (100 * np.cumprod(1 + rng.normal(0, 0.03, 40))).tolist() for k in "ABC"}
    w = {k: [*x[:-8], *(y * rng.uniform(0.5, 2) for y in x[-8:])] for k, x in v.items()}
    small = {"window": 5, "vol_window": 5, "lookback": 6, "skip": 2, "trend_window": 5, "mom_window": 5, "er_window": 4, "ma_window": 5, "regime_window": 6, "rsi_window": 4, "trend_filter": 5, "weights": "A:0.5, B:0.5", "series": "M"}
    params = {k: x for k, x in small.items() if k in S.get(key).params}
    days = [d.date() for d in pd.date_range("2020-01-01", periods=40)]
    out = []
    for prices, shift in ((v, 0.0), (w, 5.0)):
        ex = spark.createDataFrame([(d, k, float(np.sin(i + j)) + shift * (i >= 32)) for i, d in enumerate(days) for j, k in enumerate(("A", "B", "C", "M"))], "d date, series string, v double")
        out.append({(r.d, r.asset): r.w for r in S.get(key).generate(_panel(spark, prices), params, ex).collect() if r.d < days[32]})
    assert len(out[0]) == 96 and all(abs(out[0][k] - out[1][k]) < 1e-12 for k in out[0])


def test_fill_and_ewm_as_pandas(spark):
    v = [1.0, None, None, None, 4.0, 5.0, None, 7.0]
    p = _panel(spark, {"a": v})
    s = pd.Series(v, dtype=float)
    got = C.bounded_ffill(p, "px", 2).orderBy("d").toPandas().px
    assert got.fillna(-1).tolist() == s.ffill(limit=2).fillna(-1).tolist()
    assert C.bounded_ffill(p, "px", 0).toPandas().px.isna().sum() == 4
    e = R.ewm(p, "px", "e", 0.3, 2).orderBy("d").toPandas().e
    assert np.allclose(e.fillna(-1), s.ewm(alpha=0.3, adjust=False, min_periods=2).mean().fillna(-1))


def test_ranks_and_ties(spark):
    p = _panel(spark, {"a": [2.0], "b": [2.0], "c": [1.0], "d": [None]})
    got = {r.asset: (r.k, r.t) for r in p.select("asset", R.pct_rank("px").alias("k"), R.top_n("px", 2).alias("t")).collect()}
    want = pd.Series([2.0, 2.0, 1.0]).rank(pct=True)
    assert [got[x][0] for x in "abc"] == want.tolist() and got["d"] == (None, 0.0)
    assert [got[x][1] for x in "abc"] == [1.0, 1.0, 0.0]


def test_signals_of_names_without_a_price(spark):
    """They take part in ranks and shares; what falls to them stays in cash."""
    p = _panel(spark, {"a": [1.0], "b": [None], "c": [1.0], "d": [1.0]})
    ex = spark.createDataFrame([("2020-01-01", k, v) for k, v in (("A", 1.0), ("b", 3.0), ("c", 2.0), ("d", -2.0))], "d string, series string, v double").withColumn("d", F.to_date("d"))

    def w(key, **params):
        return [r.w for r in S.get(key).generate(p, params, ex).orderBy("asset").collect()]

    assert w("exog_signal") == [1 / 6, 0, 2 / 6, 0] and w("exog_signal", allow_short=True) == [1 / 8, 0, 2 / 8, -2 / 8]
    assert w("exog_signal", mode="binary", threshold=1.5, allow_short=True) == [0, 0, 1 / 3, -1 / 3]
    assert w("exog_signal", mode="rank", top_n=2) == [0, 0, 0.5, 0]
    assert w("factor_rank", top_n=2) == [0, 0, 0.5, 0] and w("factor_rank", top_n=2, direction="low") == [0.5, 0, 0, 0.5]
    assert w("factor_rank", top_n=2, hold_cash=False) == [0, 0, 0.5, 0]


def test_empty_panel(spark):
    p = _panel(spark, {"a": [1.0]}).where("d IS NULL")
    t = S.get("buy_hold").generate(p).withColumn("run_id", F.lit("x"))
    assert E.closed_form(E.legs(p, t, A.rebalance_calendar(p, "monthly"), 1), 0.0).count() == 0


def test_bootstrap_spread(spark):
    """Final values spread as those of numpy's draws do, and summaries of blocks are those of the paths."""
    rows = K._market(spark, SF)
    r = np.array([x.ret for x in rows.orderBy("d").collect()])
    n, rng = len(r), np.random.default_rng(42)
    want = np.array([np.log1p(np.concatenate([r[a : a + 21] for a in rng.integers(0, n - 21, -(-n // 21))])[:n]).sum() for _ in range(2000)])
    got = np.log([x.v for x in B.bootstrap(rows).where(F.col("step") == n - 1).collect()])
    assert len(got) == 500 and abs(got.std() / want.std() - 1) < 0.15
    for p in (5, 50, 95):
        assert abs(np.percentile(got, p) - np.percentile(want, p)) < 0.3 * want.std()
    paths = B.bootstrap(rows, sims=40).toPandas().pivot(index="sim", columns="step", values="v").to_numpy()
    steps = np.diff(np.concatenate([np.ones((40, 1)), paths], 1), axis=1) / np.concatenate([np.ones((40, 1)), paths[:, :-1]], 1)
    stats = {r.percentile: r for r in B.mc_summary(rows, sims=40).collect()}
    drop = (paths / np.maximum.accumulate(paths, 1) - 1).min(1)
    for p in (5, 25, 50, 75, 95):
        r = stats[f"{p}th"]
        assert np.allclose([r.cagr, r.mdd, r.sharpe], [np.percentile(paths[:, -1] ** (252 / n) - 1, p), np.percentile(drop, p), np.percentile(steps.mean(1) / steps.std(1, ddof=1) * 252**0.5, p)], atol=1e-9)
    assert B.bootstrap(rows.limit(62)).count() == 0 and B.mc_summary(rows.limit(62)).count() == 0
    gaps = rows.limit(80).withColumn("ret", F.when(F.month("d") > 1, F.col("ret")))
    assert B.bootstrap(gaps, sims=2).groupBy("sim").count().where(F.col("count") != gaps.where("ret IS NOT NULL").count()).count() == 0


def test_kernel_equals_day_walk(spark):
    """Stretches and a walk over trades against a walk over days: dead bands, open execution, dividends, cash, gaps, shorts."""
    rng = np.random.default_rng(5)
    v = {k: (100 * np.cumprod(1 + rng.normal(0, 0.02, 130))).tolist() for k in "abc"}
    v["b"][40:44] = [None] * 4
    p = _panel(spark, v)
    days = [r.d for r in p.select("d").distinct().collect()]
    rows = [(r, d, a, float(x)) for r, size in (("x", 0.9), ("y", 1.4)) for d in days for a, x in zip("abc", rng.dirichlet([1, 1, 1]) * size * np.array([1, 1, -1 if r == "y" else 1]), strict=True)]
    w = spark.createDataFrame(rows, "run_id string, d date, asset string, w double")
    events, cash = A.rebalance_calendar(p, "weekly"), E.cash_returns(p, None, 0.05)
    for options in ({}, {"min_trade": 0.05}, {"at_open": True, "min_trade": 0.03}):
        for lag in (0, 1):
            x = E.legs(p, w, events, lag, cash=cash, opens=D.opens(p) if "at_open" in options else None, dividends=D.dividends(p))
            a, b = (f(x, 0.003, **options).orderBy("run_id", "d").toPandas() for f in (E.kernel, E.day_walk))
            for c in ("nav", "ret", "gross_ret", "turnover", "cost", "exposure", "cash_w", "div_income"):
                assert np.allclose(a[c], b[c], atol=1e-12), (options, lag, c)
            assert all(np.allclose(s, t, atol=1e-12) for s, t in zip(a.w, b.w, strict=True)) and (a.w_before.isna() == b.w_before.isna()).all()


@pytest.mark.parametrize("key,base,grid", [("sma_trend", {"vol_window": 8}, {"window": [5, 9, 20], "buffer": [0.0, 1.5], "sizing": ["Equal", "Inverse Volatility", "Inverse Downside Volatility"]}), ("xs_momentum", {"vol_window": 6}, {"lookback": [5, 10], "skip": [0, 3], "top_n": [1, 2], "sizing": ["Equal", "Inverse Volatility"]}), ("dual_momentum", {"trend_window": 12}, {"lookback": [5, 10], "skip": [0, 3], "top_n": [1, 2]})])
def test_grid_as_data_equals_single_runs(spark, key, base, grid):
    rng = np.random.default_rng(8)
    v = {k: (100 * np.cumprod(1 + rng.normal(0, 0.02, 70))).tolist() for k in "abcd"}
    v["b"][30:33], v["d"][:15] = [None] * 3, [None] * 15
    p = _panel(spark, v)
    runs = {"-".join(map(str, c.values())): S.get(key).check({**base, **c}) for c in B.combinations(grid)}
    got = {(r.run_id, r.d, r.asset): r.w for r in W.targets(p, key, runs).collect()}
    assert len(got) == len(runs) * 70 * 4
    for run, params in list(runs.items())[::3]:
        for r in S.get(key).generate(p, params).collect():
            assert abs(got[run, r.d, r.asset] - r.w) < 1e-9, (run, r.d, r.asset)


def test_sweep_keeps_going(spark):
    p = _panel(spark, {"a": (100 * np.cumprod(1 + np.random.default_rng(2).normal(0, 0.02, 60))).tolist()})
    s = B.parameter_sweep(p, "sma_trend", {}, {"window": [5, 0], "sizing": ["Equal", "None"]}, A.rebalance_calendar(p, "weekly"), B.Setting(rate=0.003)).collect()
    assert sorted((r.run_id, r.error is None, r.cagr is None) for r in s) == [("0-Equal", False, True), ("0-None", False, True), ("5-Equal", True, False), ("5-None", False, True)]
    with pytest.raises(ValueError, match="speed"):
        S.get("sma_trend").check({"speed": 1})
    assert [c["a"] for c in B.combinations({"a": [3, 1, 2], "b": [1, 2]}, 3)] == [3, 3, 1]


def test_trim(spark):
    """A run that starts active, never is, or would keep one row stays as it is."""
    rows = [("a", 1, 1.0, 0.1, 0.5), ("a", 2, 1.1, 0.1, 0.5), ("b", 1, 1.0, 0.0, 0.0), ("b", 2, 1.0, 0.1, 0.0), ("c", 1, 1.0, 0.1, 0.0), ("c", 2, 2.0, 0.2, 0.5), ("d", 1, 1.0, 0.1, 0.0), ("d", 2, 2.0, 0.2, 0.5), ("d", 3, 3.0, 0.3, 0.5)]
    df = spark.createDataFrame([(r, pd.Timestamp(2020, 1, d).date(), n, x, x, e) for r, d, n, x, e in rows], "run_id string, d date, nav double, ret double, gross_ret double, exposure double")
    got = sorted((r.run_id, r.d.day, r.nav, r.ret, r.gross_ret) for r in E.trim_warmup(df).collect())
    assert got == [("a", 1, 1.0, 0.1, 0.1), ("a", 2, 1.1, 0.1, 0.1), ("b", 1, 1.0, 0.0, 0.0), ("b", 2, 1.0, 0.1, 0.1), ("c", 1, 1.0, 0.1, 0.1), ("c", 2, 2.0, 0.2, 0.2), ("d", 2, 1.0, 0.0, 0.0), ("d", 3, 1.5, 0.3, 0.3)]


def test_parse_weights():
    assert S.parse_weights("a:1e-1,b,:3,c: 2 ;d:1:2") == {"A": 0.1, "": 3.0, "C": 2.0}
    assert S.parse_weights("XIC.TO:0.6, zag.to : 0.4; Q:x") == {"XIC.TO": 0.6, "ZAG.TO": 0.4}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
