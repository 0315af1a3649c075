"""Series cut over tasks, against pandas and numpy, at sizes where a series spans many buckets, blocks and levels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import ranks as RK
from tidepanel.functions import rolling as R
from tidepanel.operators import align as A
from tidepanel.operators import clean as C
from tidepanel.operators import metrics as M
from tidepanel.operators import scan as S
from tidepanel.sources import tables


def series(spark, n=3000, keys="ab", gaps=0.2, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("1990-01-01", periods=n).date
    v = {k: np.where(rng.random(n) < gaps, np.nan, rng.normal(size=n)) for k in keys}
    rows = [(k, d, i + 1, None if np.isnan(x[i]) else float(x[i])) for k, x in v.items() for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "asset string, d date, n long, v double"), v


def by_key(df, key, column):
    pdf = df.orderBy("d").toPandas()
    return pdf[pdf.asset == key][column].to_numpy(dtype=float)


def test_carried(spark):
    df, v = series(spark)
    k = S.positions(df, ["asset"], "k", "m")
    p = S.running_product(df, ["asset"], 1 + F.coalesce(F.col("v"), F.lit(0.0)) / 100, "p")
    t = S.running_sum(df, ["asset"], F.col("v"), "t")
    h = S.running_max(df, ["asset"], "v", "h")
    last = S.last_known(df, ["asset"], F.col("v"), "l")
    lag = S.lagged(df, ["asset"], F.col("v"), "g")
    for a, x in v.items():
        s = pd.Series(x)
        assert by_key(k, a, "k").tolist() == list(range(1, 3001)) and set(by_key(k, a, "m")) == {3000}
        assert np.allclose(by_key(p, a, "p"), np.cumprod(1 + s.fillna(0) / 100))
        assert np.allclose(by_key(t, a, "t"), s.fillna(0).cumsum())
        assert np.allclose(by_key(h, a, "h"), s.fillna(-np.inf).cummax().replace(-np.inf, np.nan), equal_nan=True)
        assert np.allclose(by_key(last, a, "l"), s.ffill(), equal_nan=True) and np.allclose(by_key(lag, a, "g"), s.shift(), equal_nan=True)


@pytest.mark.parametrize("alpha,least,block", [(2 / 51, 50, 4), (1 / 14, 14, 64), (0.97, 1, 8)])
def test_means_of_many_levels(spark, alpha, least, block, monkeypatch):
    """3,000 days in blocks of 4 are six levels."""
    monkeypatch.setattr(S, "BLOCK", block)
    df, v = series(spark)
    out = R.ewms(df, {"v": "e"}, alpha, least)
    for a, x in v.items():
        assert np.allclose(by_key(out, a, "e"), pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean(), equal_nan=True)
    assert R.ewms(df.limit(0), {"v": "e"}, alpha, least).count() == 0


def test_windows_and_fills(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 40)
    df, v = series(spark, 900)
    x, over = S.halo(df, ["asset"], "n", 33)
    got = x.withColumn("m", over(F.avg("v"))).where("_own")
    filled = C.bounded_ffill(df, "v", 2)
    for a, y in v.items():
        s = pd.Series(y)
        assert np.allclose(by_key(got, a, "m"), s.rolling(33, min_periods=1).mean(), equal_nan=True)
        assert np.allclose(by_key(filled, a, "v"), s.ffill(limit=2), equal_nan=True)


def test_asof_over_years(spark):
    """Values years apart reach the days between; with a limit they don't."""
    days = spark.createDataFrame([(d.date(),) for d in pd.date_range("2000-01-01", "2009-12-31", freq="7D")], "d date")
    exog = spark.createDataFrame([("x", dt.date(1999, 5, 1), 1.0), ("x", dt.date(2004, 5, 1), 2.0), ("y", dt.date(2009, 1, 1), 3.0)], "series string, d date, v double")
    got = {(r.series, r.d): r.v for r in A.exog_asof(exog, days, 3).collect()}
    assert got["x", dt.date(2000, 1, 1)] == 1.0 and got["x", dt.date(2004, 5, 8)] == 2.0 and got["x", dt.date(2009, 12, 26)] == 2.0
    assert got["y", dt.date(2008, 12, 27)] is None and got["y", dt.date(2009, 1, 10)] == 3.0
    some = {r.d: r.v for r in A.exog_asof(exog.where("series = 'x'"), days, 3, 2).collect()}
    assert [d for d, v in sorted(some.items()) if v == 2.0] == [dt.date(2004, 5, 8), dt.date(2004, 5, 15)]
    assert {r.file_d: r.d for r in A.snap_dates(exog.select("d"), days).collect()} == {dt.date(2004, 5, 1): dt.date(2004, 5, 1), dt.date(2009, 1, 1): dt.date(2008, 12, 27)}


def test_drawdown_of_a_long_stream(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, 4000)
    days = pd.date_range("1990-01-01", periods=4000)
    df = M.equity_curve(spark.createDataFrame([("x", d.date(), float(x)) for d, x in zip(days, r, strict=True)], "run_id string, d date, ret double"))
    nav = np.cumprod(1 + r)
    dd = nav / np.maximum.accumulate(nav) - 1
    assert np.allclose(M.drawdown(df).orderBy("d").toPandas().dd, dd)
    want, i = [], 0
    while i < 4000:
        if dd[i] < 0:
            j = i
            while j < 4000 and dd[j] < 0:
                j += 1
            t = i + int(dd[i:j].argmin())
            want.append((dd[t], days[i].date(), days[t].date(), days[j].date() if j < 4000 else None, t - i + 1, j - i + 1 if j < 4000 else j - i))
            i = j
        i += 1
    want.sort()
    got = M.drawdown_table(df, 7).collect()
    assert [(round(r.drawdown, 9), r.start, r.trough, r.recovery, r.days_to_trough, r.total_days) for r in sorted(got, key=lambda r: r.drawdown)] == [(round(w[0], 9), *w[1:]) for w in want[:7]]
    line = M.rolling_sharpe(df, 600).orderBy("d").toPandas().rolling_sharpe
    s = pd.Series(r)
    assert np.allclose(line, s.rolling(600).mean() / s.rolling(600).std() * 252**0.5, equal_nan=True)


@pytest.mark.parametrize("most", [100_000, 5])
def test_exact_quantiles(spark, most, monkeypatch):
    monkeypatch.setattr(S, "SORTED", most)
    monkeypatch.setattr(S, "PARTS", 3)
    rng = np.random.default_rng(1)
    v = {"a": rng.normal(size=2001), "b": np.concatenate([np.full(700, 0.25), rng.normal(0.25, 1e-9, 801)]), "c": np.array([-3.0]), "d": np.array([0.0, 0.0, -1e-300, 1e300])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("e", None)], "k string, v double")
    ps = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {r.k: r for r in S.quantiles(df, "v", ps, ["k"]).collect()}
    assert set(got) == set(v)
    for k, x in v.items():
        assert got[k].n == len(x) and np.allclose(got[k].q, np.quantile(x, ps), rtol=1e-12, atol=0)
    assert np.allclose(S.quantiles(df, "v", [0.3]).first().q, np.quantile(np.concatenate(list(v.values())), [0.3]))
    assert S.quantiles(df.limit(0), "v", ps).count() == 0


def test_global_numbers(spark):
    rows = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(500)).alias("v"), "id").repartition(7)
    got = S.global_number(rows, [F.desc("v"), F.asc("id")], "k").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1, 5001)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    assert S.global_number(rows.limit(0), [F.asc("id")]).count() == 0


@pytest.mark.parametrize("side", [256, 2])
def test_correlation_of_tiles(spark, side, monkeypatch):
    monkeypatch.setattr(M, "SIDE", side)
    rng = np.random.default_rng(2)
    x = rng.normal(100, 1, (900, 5)) + rng.normal(size=(900, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:300, 4] = np.nan
    days = pd.date_range("2000-01-01", periods=900)
    df = spark.createDataFrame([(d.date(), f"a{k}", None if np.isnan(x[i, k]) else float(x[i, k])) for i, d in enumerate(days) for k in range(5)], "d date, asset string, r double")
    want = pd.DataFrame(x).corr().to_numpy()
    got = {(r.a, r.b): r["corr"] for r in M.correlation_matrix(df).collect()}
    assert len(got) == 25 and all(abs(got[f"a{i}", f"a{j}"] - want[i, j]) < 1e-9 for i in range(5) for j in range(5))


def test_ranks_of_wide_days(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2020, 1, 1 + i), f"n{k}", k + 1, None if k % 11 == 0 else float(np.round(rng.normal(), 1))) for i in range(3) for k in range(400)]
    df = spark.createDataFrame(rows, "d date, asset string, ord long, s double")
    p = df.toPandas()
    p["pct"] = p.groupby("d").s.rank(pct=True)
    p["best"] = p.sort_values(["s", "ord"], ascending=[False, True]).groupby("d").cumcount() < 30
    got = RK.top_n(RK.pct_rank(df, "s", "pct"), "s", 30, "best").toPandas().merge(p, on=["d", "asset"])
    assert len(got) == 1200 and np.allclose(got.pct_x, got.pct_y, equal_nan=True) and ((got.best_x == 1) == got.best_y).all()


def test_tables_by_content(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    make = lambda: spark.read.parquet(path).groupBy(F.pmod("id", F.lit(3)).alias("k")).count()
    with tables.lease(spark):
        a, b = tables.stored(make()), tables.stored(make())
        assert a.inputFiles() == b.inputFiles() and tables.content(make()) != tables.content(make().where("k > 0"))
        with tables.lease(spark):
            c = tables.stored(make())
        assert c.count() == 3  # the outer lease holds it still
        spark.range(20).write.mode("overwrite").parquet(path)
        d = tables.stored(make())
        assert d.inputFiles() != a.inputFiles() and d.agg(F.sum("count")).first()[0] == 20
        calls = []
        step = lambda: tables.derived(spark, "step", [path], (1,), lambda: calls.append(1) or make())
        assert step().count() == step().count() == 3 and len(calls) == 1
    gone = a.inputFiles()[0].removeprefix("file:")
    import os

    assert not os.path.exists(gone.replace("file://", ""))
    assert not any(k[1] == tables.content(make()) for k in tables._TABLES)
    kept = tables.stored(make())
    assert kept.count() == 3 and tables.clear(spark) >= 1
