"""Simulation of a portfolio from target weights.

closed_form says it in windows: between two rebalances a holding is its target times the growth of its
price, so value, drift and turnover of every day follow from the last event before it, and the value over
all events is a product. What is uninvested is one more leg that grows by the cash return. Exact without a
dead band, borrowing, dividends or open execution. kernel says the days between trades in windows too and walks
only over the trades, one row each; day_walk walks every day of a run, for borrowing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import scan as SC
from .align import signal_to_exec_dates


def _asset_days():
    return W.partitionBy("run_id", "asset").orderBy("d")


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 10.0
    slippage_bps: float = 20.0

    @property
    def rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 1e4


def _returns(panel: DataFrame, opens: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """r: price over the price of the row before, less 1; with opens (d, asset, px) its part after the open,
    and r_on the part before it (a missing open is the price before). dv: dividends (d, asset, v) over the
    price before. 0 where a value is missing or isn't finite."""
    before = F.lag("px").over(W.partitionBy("asset").orderBy("d"))
    clean = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c).otherwise(0.0)
    x = panel.withColumn("_p", before)
    if opens is None:
        x = x.withColumn("r_on", F.lit(0.0)).withColumn("r", clean(F.try_divide("px", "_p") - 1))
    else:
        x = x.join(opens.select("d", "asset", F.col("px").alias("_o")), ["d", "asset"], "left")
        x = x.withColumn("_o", F.when((F.col("_o") > 0) & ~F.isnan("_o"), F.col("_o")).otherwise(F.col("_p")))
        x = x.withColumn("r_on", clean(F.try_divide("_o", "_p") - 1)).withColumn("r", clean(F.try_divide("px", "_o") - 1))
    if dividends is None:
        return x.withColumn("dv", F.lit(0.0))
    return x.join(dividends.select("d", "asset", F.col("v").alias("_v")), ["d", "asset"], "left").withColumn("dv", clean(F.try_divide("_v", "_p")))


def cash_returns(days: DataFrame, proxy: DataFrame | None = None, rate: float = 0.0, ppy: int = 252) -> DataFrame:
    """(d, rc): what cash earns each day, 0 on the first: the filled returns of a proxy (d, px) that has two
    prices at least, else a yearly rate over ppy. days: d."""
    days = days.select("d").distinct()
    if proxy is not None and len(proxy.where("px IS NOT NULL AND NOT isnan(px)").take(2)) == 2:
        px = F.when(~F.isnan("px"), F.col("px"))
        filled = SC.last_known(days.join(proxy.select("d", px.alias("px")), "d", "left"), [], F.col("px"), "px")
        return SC.lagged(filled, [], F.col("px"), "_p").select("d", F.coalesce(F.try_divide("px", "_p") - 1, F.lit(0.0)).alias("rc"))
    first = days.agg(F.min("d").alias("_first"))
    return days.crossJoin(F.broadcast(first)).select("d", F.when(F.col("d") > F.col("_first"), F.lit(rate / ppy)).otherwise(0.0).alias("rc"))


def legs(panel: DataFrame, targets: DataFrame, events: DataFrame, lag: int, max_leverage: float = 1.0, cash: DataFrame | None = None, opens: DataFrame | None = None, dividends: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """(run_id, d, n, asset, ord, r_on, r, dv, t, ev, rc): returns, lagged and capped targets, the days of
    trade, and the return of cash. targets: run_id, d, asset, w. events: d. cash: d, rc; without it cash earns
    nothing. signals (d) are imposed days of signal: trades are `lag` sessions later, instead of on events."""
    r = _returns(panel, opens, dividends).select("d", "n", "asset", "ord", "r_on", "r", "dv")
    x = targets.select("run_id", "d", "asset", "w").join(r, ["d", "asset"])
    gross = F.sum(F.abs("w")).over(W.partitionBy("run_id", "d"))
    x = x.withColumn("g", gross).withColumn("w", F.when(F.col("g") > max_leverage, F.col("w") * max_leverage / F.col("g")).otherwise(F.col("w")))
    x = x.withColumn("t", F.coalesce(F.lag("w", lag).over(_asset_days()), F.lit(0.0)) if lag else F.col("w"))
    days = (events if signals is None else signal_to_exec_dates(signals, panel, lag)).select("d", F.lit(True).alias("ev")).distinct()
    x = x.join(cash.select("d", "rc"), "d", "left") if cash is not None else x.withColumn("rc", F.lit(0.0))
    return x.join(days, "d", "left").select("run_id", "d", "n", "asset", "ord", "r_on", "r", "dv", "t", (F.coalesce("ev", F.lit(False)) & (F.col("n") > lag)).alias("ev"), F.coalesce("rc", F.lit(0.0)).alias("rc"))


def holdings(x: DataFrame) -> DataFrame:
    """legs with `x` (holding before trade for each unit held after the last event), `t0` (that holding then)
    and `gc` (growth of cash since)."""
    growth = F.product(1 + F.col("r")).over(_asset_days().rowsBetween(W.unboundedPreceding, 0))
    before = _asset_days().rowsBetween(W.unboundedPreceding, -1)
    out = x.withColumn("i", growth)
    out = out.withColumn("t0", F.last(F.when(F.col("ev"), F.col("t")), ignorenulls=True).over(before)).withColumn("i0", F.last(F.when(F.col("ev"), F.col("i")), ignorenulls=True).over(before))
    out = out.withColumn("c", F.product(1 + F.col("rc")).over(_asset_days().rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("gc", F.col("c") / F.coalesce(F.last(F.when(F.col("ev"), F.col("c")), ignorenulls=True).over(before), F.lit(1.0)))
    return out.withColumn("x", F.coalesce(F.col("t0") * F.col("i") / F.col("i0"), F.lit(0.0))).withColumn("t0", F.coalesce("t0", F.lit(0.0)))


def _worth(h: DataFrame) -> DataFrame:
    """holdings with `v`, the value before trade for each unit after the last event: assets and cash."""
    day = W.partitionBy("run_id", "d")
    cash = (1 - F.sum("t0").over(day)) * (F.max("gc").over(day) - 1)
    return h.withColumn("v", 1 + F.sum(F.col("x") - F.col("t0")).over(day) + cash)


def closed_form(x: DataFrame, rate: float | str, capital: float = 1.0) -> DataFrame:
    """(run_id, d, n, nav, ret, turnover, cost, exposure, cash_w) of legs. rate: the cost of a unit of
    turnover, or the name of a column that has it."""
    h = holdings(x)
    fee = F.col(rate) if isinstance(rate, str) else F.lit(rate)
    # one pass over assets: value first, then turnover needs it, so both come from sums by day
    day = _worth(h)
    held = F.when(F.col("ev"), F.col("t")).otherwise(F.col("x") / F.col("v"))
    day = day.groupBy("run_id", "d", "n", "ev", "v", fee.alias("fee") if not isinstance(rate, str) else F.col(rate).alias("fee")).agg(F.sum(F.abs(F.col("t") - F.col("x") / F.col("v"))).alias("moved"), F.sum(F.abs(held)).alias("exposure"), (1 - F.sum(held)).alias("cash_w"))
    day = day.withColumn("turnover", F.when(F.col("ev"), F.col("moved")).otherwise(0.0)).withColumn("cost", F.col("turnover") * F.col("fee"))
    run = W.partitionBy("run_id").orderBy("d")
    closed = F.coalesce(F.product(F.when(F.col("ev"), F.col("v") * (1 - F.col("cost"))).otherwise(1.0)).over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    day = day.withColumn("nav", capital * closed * F.col("v") * (1 - F.col("cost")))
    ret = F.col("nav") / F.coalesce(F.lag("nav").over(run), F.lit(capital)) - 1
    return day.withColumn("ret", ret).select("run_id", "d", "n", "nav", "ret", "turnover", "cost", "exposure", "cash_w")


def weights_after(x: DataFrame) -> DataFrame:
    """(run_id, d, asset, w): weights at the end of each day."""
    h = _worth(holdings(x))
    return h.select("run_id", "d", "asset", F.when(F.col("ev"), F.col("t")).otherwise(F.col("x") / F.col("v")).alias("w"))


def trades(x: DataFrame) -> DataFrame:
    """(run_id, d, asset, weight_before, weight_after, change) of every trade."""
    h = _worth(holdings(x))
    out = h.where("ev").select("run_id", "d", "asset", (F.col("x") / F.col("v")).alias("weight_before"), F.col("t").alias("weight_after"))
    return out.withColumn("change", F.col("weight_after") - F.col("weight_before")).where("change <> 0")


def kernel(x: DataFrame, rate: float | str, min_trade: float | str = 0.0, max_leverage: float = 1.0, borrow: float = 0.0, capital: float = 1.0, ppy: int = 252, at_open: bool = False) -> DataFrame:
    """(run_id, d, nav, ret, gross_ret, turnover, cost, exposure, cash_w, div_income, w, w_before, w_after) of legs:
    with a dead band, a leverage limit at each trade, a charge on what is borrowed, dividends that stay in cash till
    the next trade, and trades at the close or at the open (the part of a day before it is earned on the old
    weights). w are the day's last weights in the order of `ord`; w_before and w_after, null without a trade, those
    around it. rate and, without borrowing and leverage, min_trade (the dead band): a number or a column.

    Between two days of trade all is linear in the weights after the first of them. So growth and income of each
    asset are windows within a stretch; only the trades themselves depend on each other: a walk over one row for
    each day of trade, a run's rows in one task; and every day's figures follow from the stretch's first weights."""
    if borrow or max_leverage > 1:
        return day_walk(x, rate, min_trade, max_leverage, borrow, capital, ppy, at_open)
    fee = F.col(rate) if isinstance(rate, str) else F.lit(float(rate))
    band = F.col(min_trade) if isinstance(min_trade, str) else F.lit(float(min_trade))
    rows = _stretches(x.withColumn("_fee", fee).withColumn("_band", band), at_open)
    path = W.partitionBy("run_id", "asset", "seg").orderBy("d", "part")
    upto = path.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("g", F.product("f").over(upto)).withColumn("gc", F.product(1 + F.col("rc")).over(upto)).withColumn("_paid", F.coalesce(F.lag("g").over(path), F.lit(1.0)) * F.col("dv"))
    rows = stored(rows.withColumn("i", F.col("gc") * F.sum(F.col("_paid") / F.col("gc")).over(upto)))
    ends = rows.where("trade").groupBy("run_id", "seg").agg(F.array_sort(F.collect_list(F.struct("ord", "g", "i", "t"))).alias("l"), F.max("gc").alias("gc"), F.max("_fee").alias("fee"), F.max("_band").alias("band"))
    ends = ends.select("run_id", "seg", *[F.col("l")[c].alias(c) for c in ("ord", "g", "i", "t")], "gc", "fee", "band")
    names = rows.select("ord").distinct().agg(F.array_sort(F.collect_list("ord")).alias("ords"))  # the universe, one row
    start = rows.select("run_id").distinct().crossJoin(F.broadcast(names))
    states = _trade_walk(start, ends, max_leverage, capital)
    held = states.select("run_id", "seg", F.col("value").alias("v0"), F.col("cash").alias("c0"), F.inline(F.arrays_zip(F.col("ords").alias("ord"), F.col("w").alias("w0"))))
    x0 = rows.join(held, ["run_id", "seg", "ord"]).withColumn("now", F.col("w0") * F.col("g"))
    parts = x0.groupBy("run_id", "seg", "d", "part").agg(
        F.max("trade").alias("trade"), F.max("v0").alias("v0"), (F.sum("now") + F.max("c0") * F.max("gc") + F.sum(F.col("w0") * F.col("i"))).alias("base"), F.sum(F.col("w0") * F.col("_paid")).alias("paid"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "now"))), lambda e: e["now"]).alias("now"),
    )
    parts = parts.withColumn("last", F.coalesce(F.lag("base").over(W.partitionBy("run_id", "seg").orderBy("d", "part")), F.lit(1.0)))
    after = states.where("seg > 0").select("run_id", (F.col("seg") - 1).alias("seg"), "moved", "cost", "w_before", "w_after", F.col("w").alias("w1"), F.col("cash").alias("c1"))
    parts = parts.join(after, ["run_id", "seg"], "left")
    traded = F.col("trade") & F.coalesce(F.col("moved") > 0, F.lit(False))
    parts = parts.withColumns({"moved": F.when(traded, F.col("moved")).otherwise(0.0), "cost": F.when(traded, F.col("cost")).otherwise(0.0), "w_before": F.when(traded, F.col("w_before")), "w_after": F.when(traded, F.col("w_after"))})
    w_end = F.when(traded, F.col("w1")).otherwise(F.transform("now", lambda v: v / F.col("base")))
    parts = parts.withColumn("end", F.struct((F.col("v0") * F.col("base") * (1 - F.col("cost"))).alias("nav"), w_end.alias("w")))
    day = parts.groupBy("run_id", "d").agg(
        F.max_by("end", "part").alias("end"), F.min_by(F.col("v0") * F.col("last"), "part").alias("before"), F.min_by(F.col("paid") / F.col("last"), "part").alias("div_income"), F.min_by(F.col("base") / F.col("last") - 1, "part").alias("port"),
        F.max("moved").alias("turnover"), F.max("cost").alias("cost"), F.max("w_before").alias("w_before"), F.max("w_after").alias("w_after"),
    )
    ret = F.col("end.nav") / F.col("before") - 1
    gross = ret + F.col("cost") if at_open else F.col("port")
    total = lambda f: F.aggregate("end.w", F.lit(0.0), lambda a, v: a + f(v))
    return day.select("run_id", "d", F.col("end.nav").alias("nav"), ret.alias("ret"), gross.alias("gross_ret"), "turnover", "cost", total(F.abs).alias("exposure"), (1 - total(lambda v: v)).alias("cash_w"), "div_income", F.col("end.w").alias("w"), "w_before", "w_after")


def _stretches(x: DataFrame, at_open: bool) -> DataFrame:
    """legs with seg (the days of trade before), f (growth), and trade: whether the row ends its stretch. At the
    open a day of trade has two rows: part 0, before the trade, and part 1, which begins the next stretch."""
    first = x.groupBy("run_id").agg(F.min("d").alias("_first"))
    days = x.groupBy("run_id", "d").agg(F.max("ev").alias("ev")).join(first, "run_id")
    if at_open:  # nothing is held yet on a run's first day
        days = days.withColumn("ev", F.col("ev") & (F.col("d") > F.col("_first")))
    days = SC.carried(days, ["run_id"], {"_e": F.count_if("ev")}, {"_e0": lambda o: F.coalesce(F.sum("_e").over(SC.before(o)), F.lit(0))})
    seg = F.col("_e0") + F.count_if("ev").over(SC.within(["run_id"])) - F.col("ev").cast("long")
    days = days.select("run_id", "d", seg.alias("seg"), F.col("ev").alias("trade"))
    rows = x.drop("ev").join(days, ["run_id", "d"]).withColumn("part", F.lit(0)).withColumn("f", (1 + F.col("r_on")) * (1 + F.col("r")))
    if not at_open:
        return rows
    opened = F.struct(F.lit(0).alias("part"), "seg", (1 + F.col("r_on")).alias("f"), "dv", "rc", F.lit(True).alias("trade"))
    rest = F.struct(F.lit(1).alias("part"), (F.col("seg") + 1).alias("seg"), (1 + F.col("r")).alias("f"), F.lit(0.0).alias("dv"), F.lit(0.0).alias("rc"), F.lit(False).alias("trade"))
    whole = F.struct("part", "seg", "f", "dv", "rc", "trade")
    rows = rows.withColumn("_p", F.explode(F.when(F.col("trade"), F.array(opened, rest)).otherwise(F.array(whole))))
    return rows.select("run_id", "d", "asset", "ord", "t", "_fee", "_band", "_p.*")


def _trade_walk(start: DataFrame, ends: DataFrame, max_leverage: float, capital: float) -> DataFrame:
    """(run_id, seg, value, cash, ords, w, moved, cost, w_before, w_after): the state in which each stretch begins,
    and the trade that led to it. start: run_id, ords; ends: growth and income of each stretch, targets, fee and dead band."""
    schema = "run_id string, seg long, value double, cash double, ords array<long>, w array<double>, moved double, cost double, w_before array<double>, w_after array<double>"

    def run(key, rows):
        import numpy as np
        import pandas as pd

        ords = rows["ords"].iat[0]
        w, cash, value = np.zeros(len(ords)), 1.0, capital
        out = [(key[0], 0, value, cash, ords, w, 0.0, 0.0, None, None)]
        for e in rows.dropna(subset="seg").sort_values("seg").itertuples():
            now = w * e.g
            base = now.sum() + cash * e.gc + (w * e.i).sum()
            now = now / base
            step = e.t - now
            step[np.abs(step) < e.band] = 0
            new = now + step
            gross = np.abs(new).sum()
            if gross > max_leverage and step.any():
                new = new * max_leverage / gross
            moved = np.abs(new - now).sum()
            value *= base
            if moved > 0:
                value *= 1 - moved * e.fee
                w, cash = new, 1 - new.sum()
            else:
                w, cash = now, 1 - now.sum()
            out.append((key[0], int(e.seg) + 1, value, cash, ords, w, moved, moved * e.fee, now if moved > 0 else None, new if moved > 0 else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return start.join(ends.drop("ord"), "run_id", "left").groupBy("run_id").applyInPandas(run, schema)


def day_walk(x: DataFrame, rate: float | str, min_trade: float = 0.0, max_leverage: float = 1.0, borrow: float = 0.0, capital: float = 1.0, ppy: int = 252, at_open: bool = False) -> DataFrame:
    """What kernel returns, by a walk over every day of a run: for a charge on what is borrowed or a leverage over 1,
    where a day's return isn't linear in the weights before it. One row a day with arrays over assets goes to a
    run's task; runs are spread over the cluster."""
    fee = F.col(rate) if isinstance(rate, str) else F.lit(float(rate))
    legs_ = F.array_sort(F.collect_list(F.struct("ord", "r_on", "r", "dv", "t")))
    days = x.withColumn("_fee", fee).groupBy("run_id", "d").agg(legs_.alias("l"), F.max("ev").alias("ev"), F.max("rc").alias("rc"), F.max("_fee").alias("fee"))
    days = days.select("run_id", "d", *[F.col("l")[c].alias(c) for c in ("r_on", "r", "dv", "t")], "ev", "rc", "fee")

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("d")
        r_on, r, dv, t = (np.stack(pdf[c].to_numpy()) for c in ("r_on", "r", "dv", "t"))
        ev, rc, fee = (pdf[c].to_numpy() for c in ("ev", "rc", "fee"))
        w, cash, value, out = np.zeros(r.shape[1]), 1.0, capital, []

        def trade(now, wanted):
            d = wanted - now
            d[np.abs(d) < min_trade] = 0
            new = now + d
            gross = np.abs(new).sum()
            if gross > max_leverage and d.any():
                new = new * max_leverage / gross
            return new, np.abs(new - now).sum()

        for i in range(len(r)):
            moved, cost, income, port, around = 0.0, 0.0, 0.0, 0.0, (None, None)
            if i:
                start = w
                income = float((start * dv[i]).sum())
                cash = cash * (1 + rc[i]) + income - borrow / ppy * max(0.0, np.abs(start).sum() - 1)
                w = start * (1 + r_on[i])
                base = w.sum() + cash
                if at_open and ev[i] and base > 0:
                    new, moved = trade(w / base, t[i])
                    around = (w / base, new) if moved > 0 else around
                    cost = moved * fee[i]
                    w, cash = new * base * (1 - cost), (1 - new.sum()) * base * (1 - cost)
                w = w * (1 + r[i])
                base = w.sum() + cash
                port = base - 1
                value *= base
                w, cash = (w / base, cash / base) if base > 0 else (w, cash)
            gross_ret = port + cost
            if not at_open and ev[i]:
                new, moved = trade(w, t[i])
                if moved > 0:
                    around, cost = (w, new), moved * fee[i]
                    value *= 1 - cost
                    w, cash = new, 1 - new.sum()
            net = (1 + port) * (1 if at_open else 1 - cost) - 1
            out.append((pdf["run_id"].iat[0], pdf["d"].iat[i], value, net, gross_ret, moved, cost, np.abs(w).sum(), cash, income, w, *around))
        return pd.DataFrame(out, columns=["run_id", "d", "nav", "ret", "gross_ret", "turnover", "cost", "exposure", "cash_w", "div_income", "w", "w_before", "w_after"])

    doubles = " double, ".join(("nav", "ret", "gross_ret", "turnover", "cost", "exposure", "cash_w", "div_income"))
    return days.groupBy("run_id").applyInPandas(run, f"run_id string, d date, {doubles} double, w array<double>, w_before array<double>, w_after array<double>")


def _by_asset(walked: DataFrame, x: DataFrame, *columns: str) -> DataFrame:
    """Arrays of the kernel as rows: run_id, d, asset and a value of each."""
    names = x.select("ord", "asset").distinct()
    rank = F.row_number().over(W.orderBy("ord")) - 1
    flat = walked.select("run_id", "d", F.posexplode(F.arrays_zip(*columns)).alias("k", "z"))
    return flat.join(names.select("asset", rank.alias("k")), "k").select("run_id", "d", "asset", *[F.col("z")[c].alias(c) for c in columns])


def kernel_weights(walked: DataFrame, x: DataFrame) -> DataFrame:
    """(run_id, d, asset, w) of a kernel's result on legs x."""
    return _by_asset(walked, x, "w")


def kernel_trades(walked: DataFrame, x: DataFrame) -> DataFrame:
    """(run_id, d, asset, weight_before, weight_after, change) of a kernel's result on legs x."""
    rows = _by_asset(walked.where("w_before IS NOT NULL"), x, "w_before", "w_after")
    out = rows.select("run_id", "d", "asset", F.col("w_before").alias("weight_before"), F.col("w_after").alias("weight_after"))
    return out.withColumn("change", F.col("weight_after") - F.col("weight_before")).where("change <> 0")


def benchmark_result(bench: DataFrame, capital: float = 1.0) -> DataFrame:
    """(d, nav, ret): bought on the first day with a price and held, without cost."""
    p = bench.where("px IS NOT NULL")
    first = p.agg(F.min_by("px", "d").alias("_first"))  # one row
    x = SC.lagged(p.crossJoin(F.broadcast(first)), [], F.col("px"), "_p")
    return x.select("d", (capital * F.col("px") / F.col("_first")).alias("nav"), F.coalesce(F.col("px") / F.col("_p") - 1, F.lit(0.0)).alias("ret"))


def stream_result(rows: DataFrame) -> DataFrame:
    """Return streams (run_id, d, ret, nav) in the shape of simulated runs: one asset that is all of the portfolio,
    nothing traded, no cost."""
    none = F.lit(0.0)
    one = {"gross_ret": F.col("ret"), "turnover": none, "cost": none, "exposure": F.lit(1.0), "cash_w": none, "asset": F.col("run_id"), "w": F.lit(1.0)}
    return rows.select("run_id", "d", "nav", "ret", *[c.alias(k) for k, c in one.items()])


def first_active(run: DataFrame, threshold: float = 1e-9) -> DataFrame:
    """(run_id, first_d): the first day with exposure."""
    return run.groupBy("run_id").agg(F.min(F.when(F.col("exposure") > threshold, F.col("d"))).alias("first_d"))


def trim_warmup(run: DataFrame, capital: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """Each run from its first active day on, or from start (run_id, first_d), rebased to capital; that day's
    returns (ret, and gross_ret if there) are 0. A run stays as it is if it was never active, if it is cut at its
    first day or before, or if under two rows would be left."""
    days = first_active(run) if start is None else start
    kept = F.count_if(F.col("d") >= F.col("first_d"))
    span = run.join(days, "run_id").groupBy("run_id", "first_d").agg(F.min("d").alias("_a"), kept.alias("_n"), F.min_by("nav", F.when(F.col("d") >= F.col("first_d"), F.col("d"))).alias("_base"))
    cut = run.join(span, "run_id").withColumn("_cut", F.coalesce((F.col("first_d") > F.col("_a")) & (F.col("_n") >= 2), F.lit(False)))
    cut = cut.where("NOT _cut OR d >= first_d").withColumn("nav", F.when(F.col("_cut"), capital * F.col("nav") / F.col("_base")).otherwise(F.col("nav")))
    zero = F.col("_cut") & (F.col("d") == F.col("first_d"))
    for c in {"ret", "gross_ret"} & set(run.columns):
        cut = cut.withColumn(c, F.when(zero, 0.0).otherwise(F.col(c)))
    return cut.select(*run.columns)


def align_start(runs: DataFrame, capital: float = 1.0) -> DataFrame:
    """All runs from the latest of their first active days on."""
    days = first_active(runs)
    return trim_warmup(runs, capital, days.select("run_id").crossJoin(days.agg(F.max("first_d").alias("first_d"))))


def align_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(d, a, b): values on common days, 100 on the first."""
    both = a.select("d", F.col("nav").alias("x")).join(b.select("d", F.col("nav").alias("y")), "d").where("x IS NOT NULL AND y IS NOT NULL")
    first = both.agg(F.min_by("x", "d").alias("_x"), F.min_by("y", "d").alias("_y"))  # one row
    return both.crossJoin(F.broadcast(first)).select("d", (100 * F.col("x") / F.col("_x")).alias("a"), (100 * F.col("y") / F.col("_y")).alias("b"))
