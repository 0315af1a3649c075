"""Files, configuration, runner and sinks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import align as A
from tidepanel.operators import engine as E
from tidepanel.operators import imports as I
from tidepanel.operators import sinks as K
from tidepanel.operators import strategies as S
from tidepanel.plans import runner
from tidepanel.sources import config, files


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_wide_csv(spark, tmp_path):
    path = _write(tmp_path, "w.csv", "Période; AAA ;BBB;CCC;DDD\n2020-01-01;1.5;2;x;\n2020-01-02;;3;y;\nnot a date;9;9;9;9\n2020-01-02;7;;;\n2020-01-03T10:00:00Z;4;5;;\n")
    d = dt.date
    got = {(r.d, r.asset): r.px for r in files.load_prices(spark, path).collect()}
    # the later row of the 2nd holds as a whole; CCC and DDD have no number
    assert got == {(d(2020, 1, 1), "AAA"): 1.5, (d(2020, 1, 1), "BBB"): 2.0, (d(2020, 1, 2), "AAA"): 7.0, (d(2020, 1, 2), "BBB"): None, (d(2020, 1, 3), "AAA"): 4.0, (d(2020, 1, 3), "BBB"): 5.0}
    empty = _write(tmp_path, "e.csv", "Date,A\n2020-01-01,1\n2020-01-02,\n2020-01-03,2\n")
    assert files.load_prices(spark, empty).count() == 3 and files.load_exog(spark, empty).count() == 2


def test_column_names():
    assert files.layout(["Date", "titre", "Poids Cible"], "weights") == ("Date", "titre", "Poids Cible")
    assert files.layout(["Date", "name", "weight", "value"], "weights") == ("Date", "name", "weight")
    assert files.layout(["d", "instrument", "score"], "exog") == ("d", "instrument", "score")
    assert files.layout(["ticker", "close"]) == ("ticker", None, None)  # no column is left for the date


def test_long_csv(spark, tmp_path):
    path = _write(tmp_path, "l.csv", "date,Ticker,Weight,note\n2020-01-31,A,0.5,q\n2020-01-31,B,0.5,q\n2020-01-31,A,0.6,later\n2020-02-29,A,,q\n")
    assert _rows(files.load_target_weights(spark, path)) == [(dt.date(2020, 1, 31), "A", 0.6), (dt.date(2020, 1, 31), "B", 0.5)]
    assert files.layout(["date", "ticker", "note"]) == ("date", None, None)
    assert files.layout(["when", "Series", "Level"], "exog") == ("when", "Series", "Level")
    assert files.layout(["when", "Date"], date="when") == ("when", None, None)
    assert files.sniff(["a\tb", "1\t2"]) == "\t" and files.sniff(["abc"]) == ","


def test_many_files_and_sheets(spark, tmp_path):
    a = _write(tmp_path, "a.csv", "date,x,y\n2020-01-31,1,2\n")
    b = _write(tmp_path, "b.csv", "date,x,z\n2020-01-31,3,4\n")
    assert [(k, v) for _, k, v in _rows(files.load_many(spark, [a, b]))] == [("x", 1.0), ("x (b.csv)", 3.0), ("y", 2.0), ("z", 4.0)]
    assert files.sheet_names(a) == []
    assert files.universe(["spy", " EFA", "SPY"], "SPY", "bil") == ["SPY", "EFA", "BIL"]


def test_config():
    c = config.Run.from_yaml("label: x\ndata: {tickers: [A]}\nengine: {rebalance: Q, execution_lag: 0}\ncosts: null\n")
    assert (c.label, c.data.tickers, c.engine.rebalance, c.costs.slippage_bps) == ("x", ["A"], "Q", 25.0)
    assert config.Run.from_yaml(c.to_yaml()) == c and [p[:7] for p in c.problems()] == ["WARNING"]
    bad = config.Run.from_dict({"data": {"tickers": [], "use_dividends": True}, "engine": {"rebalance": "X", "execution_lag": -1, "initial_capital": 0, "max_leverage": 0}, "strategy": {"mode": "y"}, "exog": {"enabled": True, "publication_lag_days": -1}})
    assert len(bad.problems()) == 8
    with pytest.raises(TypeError):
        config.Run.from_dict({"engine": {"speed": 1}})


def _prices(spark, days=120):
    rng = np.random.default_rng(4)
    dates = pd.bdate_range("2020-01-01", periods=days).date
    v = 100 * np.cumprod(1 + rng.normal(0, 0.02, (days, 4)), axis=0)
    rows = [(d, a, float(v[i, k])) for k, a in enumerate(("A", "B", "BENCH", "CASH")) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "d date, asset string, px double"), dates, v


def test_runner_and_sinks(spark, tmp_path):
    prices, dates, v = _prices(spark)
    c = config.Run.from_dict({"label": "r", "data": {"tickers": ["A", "B"], "benchmark": "BENCH", "cash_proxy": "CASH", "start": "2020-01-10"}, "strategy": {"name": "sma_trend", "params": {"window": 10}}})
    r = runner.run(prices, c)
    days = r.days.orderBy("d").toPandas()
    assert days.nav.iat[0] == 100_000 and days.exposure.iat[0] > 0 and days.d.min() > dt.date(2020, 1, 22)
    bench = r.benchmark.orderBy("d").toPandas()
    assert bench.d.tolist() == days.d.tolist() and bench.nav.iat[0] == 100_000 and bench.ret.iat[0] == 0
    assert np.allclose(r.weights().groupBy("d").agg(F.sum("w").alias("sum")).join(r.days, "d").select(F.col("sum") + F.col("cash_w")).toPandas(), 1)
    held = K.current_holdings(r.weights(), r.days).toPandas()
    assert abs(held.weight.sum() - 1) < 1e-9 and abs(held.value.sum() - days.nav.iat[-1]) < 1e-3
    tables = {"series": K.daily_series(r.days, r.benchmark), "trades": r.trades(), "holdings": K.holdings_history(r.weights(), ["A", "B"])}
    assert K.workbook(tables, str(tmp_path / "book")) == ["holdings", "series", "trades"]
    back = spark.read.option("header", True).csv(str(tmp_path / "book" / "series"))
    assert back.count() == len(days) and "benchmark" in back.columns
    with pytest.raises(ValueError, match="rebalance"):
        runner.run(prices, config.Run.from_dict({"engine": {"rebalance": "?"}}))
    w = spark.createDataFrame([(dt.date(2020, 2, 1), "a", 60.0), (dt.date(2020, 2, 1), "X", 40.0)], "d date, asset string, w double")
    c.strategy.mode, c.engine.trim_warmup, c.strategy.params = "external_weights", False, {}
    out = runner.run(prices, c, weights=w)
    assert out.days.where("turnover > 0").count() == 1 and abs(out.days.agg(F.max("turnover")).first()[0] - 0.6) < 1e-9
    assert _rows(I.name_report(w, out.panel)) == [("B", "absent"), ("X", "unknown")]
    page = K.report_page("run <1>", K.report_tables(r.days, r.weights(), r.benchmark), c.to_yaml())
    assert page.count("<h2>") == 4 and "run &lt;1&gt;" in page and "cagr" in page and "Cash" in page and "beta" in page and page.count("<li>") == 6
    page = K.tearsheet("a < b", spark.createDataFrame([("cagr", 0.1)], "metric string, value double"))
    assert "a &lt; b" in page and "0.1000" in page
    t = K.weights_template(spark, ["A", "B", "C"]).orderBy("Date").collect()
    assert [tuple(x) for x in t][0] == (dt.date(2020, 1, 31), 0.3333, 0.3333, 0.3333) and t[2].Date == dt.date(2020, 3, 31)
    assert [r.Date.weekday() for r in K.returns_template(spark, True).orderBy("Date").collect()] == [2, 3, 4, 0, 1, 2]


@pytest.mark.parametrize("at_open", [False, True])
def test_kernel_options(spark, at_open):
    """The walk against the recursion day by day: opens with gaps, dividends, a dead band, leverage and borrowing."""
    prices, dates, v = _prices(spark, 60)
    v = v[:, :2]
    panel = runner.cleaned(prices.where("asset IN ('A', 'B')"), 5)
    rng = np.random.default_rng(8)
    o = v * (1 + rng.normal(0, 0.01, v.shape))
    o[5, 0] = 0.0
    div = np.zeros(v.shape)
    div[[7, 20, 41], 1] = 1.5
    long = lambda m, name: spark.createDataFrame([(d, a, float(m[i, k])) for k, a in enumerate("AB") for i, d in enumerate(dates)], f"d date, asset string, {name} double")
    t = panel.select("d", "asset", F.when(F.col("asset") == "A", 0.9).otherwise(0.6).alias("w"), F.lit("x").alias("run_id"))
    events = A.rebalance_calendar(panel, "weekly")
    x = E.legs(panel, t, events, 1, 1.4, None, long(o, "px") if at_open else None, long(div, "v"))
    got = E.kernel(x, 0.003, 0.004, 1.4, 0.05, 1000.0, 252, at_open).orderBy("d").toPandas()
    at = {r.d for r in events.collect()}
    target = np.array([0.9, 0.6]) * 1.4 / 1.5
    w, c, value = np.zeros(2), 1.0, 1000.0
    for i, d in enumerate(dates):
        port, cost, moved, income = 0.0, 0.0, 0.0, 0.0

        def charge(now):
            delta = target - now
            delta[np.abs(delta) < 0.004] = 0
            new = now + delta
            if delta.any() and np.abs(new).sum() > 1.4:
                new = new / np.abs(new).sum() * 1.4
            return new, np.abs(new - now).sum()

        if i:
            op = np.where(o[i] > 0, o[i], v[i - 1]) if at_open else v[i - 1]
            on, inside = op / v[i - 1] - 1, v[i] / op - 1
            first, income = w.copy(), (w * div[i] / v[i - 1]).sum()
            w, c = w * (1 + on), c + income - max(0, np.abs(w).sum() - 1) * 0.05 / 252
            if at_open and d in at:
                base = w.sum() + c
                new, moved = charge(w / base)
                cost = moved * 0.003
                w, c = new * base * (1 - cost), (1 - new.sum()) * base * (1 - cost)
            w = w * (1 + inside)
            port = w.sum() + c - 1
            value *= 1 + port
            w, c = w / (1 + port), c / (1 + port)
        gross = port + cost
        if not at_open and d in at and i >= 1:
            new, moved = charge(w)
            cost = moved * 0.003
            if moved:
                value, w, c = value * (1 - cost), new, 1 - new.sum()
        row = got.iloc[i]
        net = (1 + port) * (1 if at_open else 1 - cost) - 1
        assert np.allclose([row.nav, row.ret, row.gross_ret, row.turnover, row.cost, row.cash_w, row.div_income], [value, net, gross, moved, cost, c, income], atol=1e-9), d
        assert np.allclose(row.w, w)
    k = E.kernel_trades(E.kernel(x, 0.003, 0.004, 1.4, 0.05, 1000.0, 252, at_open), x)
    assert k.where("abs(weight_before + change - weight_after) > 1e-12").count() == 0 and k.count() > 10


def test_imported_rows_of_one_session(spark):
    """Two file days on one session: the later holds as a whole."""
    prices, dates, _ = _prices(spark, 20)
    panel = runner.cleaned(prices.where("asset IN ('A', 'B')"), 5)
    w = spark.createDataFrame([(dt.date(2020, 1, 4), "A", 0.5), (dt.date(2020, 1, 4), "B", 0.5), (dt.date(2020, 1, 5), "A", 1.0)], "d date, asset string, w double")
    out = {(r.d, r.asset): r.w for r in I.external_weights(w, panel).collect()}
    assert out[dt.date(2020, 1, 3), "A"] == 1.0 and out[dt.date(2020, 1, 3), "B"] == 0.0 and out[dates[-1], "B"] == 0.0
    assert _rows(I.weight_flags(I.external_weights(w, panel))) == []


def test_returns_and_exog_reports(spark):
    days = pd.date_range("2020-01-01", periods=20, freq="3D").date
    raw = spark.createDataFrame([(d, "s", 2.0 if i else None) for i, d in enumerate(days)], "d date, series string, ret double")
    x = I.prepared_returns(raw)
    assert sorted({r.ret for r in x.collect()}) == [0.0, 0.02] and x.count() == 20
    assert I.prepared_returns(raw, "decimal").agg(F.max("ret")).first()[0] == 2.0
    assert tuple(A.stream_frequency(raw).first()) == (3.0, "daily", 252) and A.frequency(raw).first().frequency == "business-daily"
    assert _rows(I.return_flags(x)) == [("no_losses", 20), ("thin", 20)]
    cal = spark.createDataFrame([(d,) for d in pd.date_range("2020-01-01", "2021-06-30").date], "d date")
    exog = spark.createDataFrame([(d, "m", 1.0) for d in pd.date_range("2020-01-31", periods=6, freq="ME").date], "d date, series string, v double")
    assert {tuple(r) for r in A.exog_flags(exog, cal, 1).collect()} == {("m", "stale"), (None, "lag")}
    limited = A.exog_asof(exog, cal, 1, ffill_limit=10).where("v IS NOT NULL")
    s = pd.Series(1.0, pd.date_range("2020-01-31", periods=6, freq="ME") + pd.Timedelta(days=1))
    idx = pd.date_range("2020-01-01", "2021-06-30")
    assert limited.count() == int(s.reindex(s.index.union(idx)).ffill(limit=10).reindex(idx).notna().sum())


def test_gate_and_regime(spark):
    prices, dates, _ = _prices(spark, 40)
    panel = runner.cleaned(prices.where("asset IN ('A', 'B')"), 5)
    p = {"mom_window": 5, "er_window": 5, "ma_window": 5, "top_n": 1, "min_score": 0.0}
    assert S.get("trend_quality").generate(panel, {**p, "regime_window": 0}).agg(F.sum("w")).first()[0] > 0
    series = spark.createDataFrame([(dates[10], "x", 1.0), (dates[12], "x", 2.0), (dates[20], "x", 1.0)], "d date, series string, v double")
    g = S.get("macro_gate").generate(panel, {"series": "X", "rule": "rising", "window": 1, "risk_off": 0.5}, series)
    got = [r.w for r in g.groupBy("d").agg(F.sum("w").alias("w")).orderBy("d").collect()]
    assert np.allclose(got, [0.5] * 12 + [1.0] * 8 + [0.5] * 20)
    assert S.get("macro_gate").generate(panel, {"series": "none"}, series).agg(F.min("w")).first()[0] == 0.5
