"""A run from a configuration: prices, signals, simulation, benchmark."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import engine as E
from ..operators import imports as I
from ..operators import strategies as S
from ..operators.clean import bounded_ffill, drop_empty_assets, neutralize_nonpositive
from ..sources.config import RULES, Run
from ..sources.files import split_panel
from ..sources.market import densify
from ..sources.tables import stored


@dataclass(frozen=True)
class Result:
    """days: what the simulation returns; legs: its input; benchmark (d, nav, ret) or None; panel: the universe."""

    days: DataFrame
    legs: DataFrame
    benchmark: DataFrame | None
    panel: DataFrame

    def weights(self) -> DataFrame:
        return E.kernel_weights(self.days, self.legs)

    def trades(self) -> DataFrame:
        return E.kernel_trades(self.days, self.legs)


def cleaned(prices: DataFrame, fill: int) -> DataFrame:
    """The dense panel of (d, asset, px): without what is never priced, prices positive, short gaps filled."""
    return stored(bounded_ffill(drop_empty_assets(neutralize_nonpositive(densify(prices))), "px", fill))


def run(prices: DataFrame, config: Run, exog: DataFrame | None = None, weights: DataFrame | None = None, opens: DataFrame | None = None, dividends: DataFrame | None = None) -> Result:
    """prices (d, asset, px) of all that config.data names; exog (d, series, v); weights (d, asset, w) for the
    mode external_weights; opens (d, asset, px); dividends (d, asset, v). A config with problems raises."""
    wrong = [x for x in config.problems() if not x.startswith("WARNING")]
    if wrong:
        raise ValueError("; ".join(wrong))
    data, engine, costs = config.data, config.engine, config.costs
    dated = prices.where(F.col("d") >= F.lit(data.start).cast("date"))
    dated = dated.where(F.col("d") <= F.lit(data.end).cast("date")) if data.end else dated
    every = cleaned(dated, data.fill_limit)
    parts = split_panel(every, data.benchmark, data.cash_proxy)
    # ties between names follow the order of the configuration
    place = F.array_position(F.array(*map(F.lit, data.tickers)), F.col("asset"))
    panel = parts["universe"].withColumn("ord", place.cast("long")).where("ord > 0")
    signals = None
    if config.strategy.mode == "external_weights":
        dense = I.external_weights(weights, panel, config.strategy.weights_normalize != "None")
        targets = panel.join(dense.select("d", "asset", "w"), ["d", "asset"])
        signals = dense.where("is_rebal").select("d").distinct() if config.strategy.weights_calendar == "File dates" else None
    else:
        series = A.exog_asof(exog, every, config.exog.publication_lag_days, config.exog.ffill_limit) if exog is not None and config.exog.enabled else None
        targets = S.get(config.strategy.name).generate(panel, config.strategy.params, series)
    cash = E.cash_returns(panel, parts["cash"] if data.cash_proxy else None, costs.cash_rate_pa, engine.periods_per_year)
    at_open = engine.execute_at_open and opens is not None
    legs = E.legs(panel, targets.withColumn("run_id", F.lit(config.label)), A.rebalance_calendar(panel, RULES[engine.rebalance]), engine.execution_lag, engine.max_leverage, cash, opens if at_open else None, dividends if data.use_dividends else None, signals)
    legs = stored(legs)
    days = E.kernel(legs, (costs.commission_bps + costs.slippage_bps) / 1e4, engine.min_trade_weight, engine.max_leverage, costs.borrow_rate_pa, engine.initial_capital, engine.periods_per_year, at_open)
    bench = E.benchmark_result(parts["benchmark"], engine.initial_capital) if data.benchmark else None
    if engine.trim_warmup:  # both from the latest of their first active days on
        days = stored(days)
        sides = {config.label: days} | ({"benchmark": bench.select(F.lit("benchmark").alias("run_id"), "d", "nav", "ret", F.lit(1.0).alias("exposure"))} if bench is not None else {})
        first = functools.reduce(DataFrame.unionByName, [E.first_active(x) for x in sides.values()]).agg(F.max("first_d").alias("first_d"))
        trim = lambda x: E.trim_warmup(x, engine.initial_capital, x.select("run_id").distinct().crossJoin(F.broadcast(first)))
        days, bench = trim(days), trim(sides["benchmark"]).select("d", "nav", "ret") if bench is not None else None
    return Result(days, legs, bench, panel)
