"""Re-runs: folds, splits, grids, cost levels, block bootstrap, deflated Sharpe."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import engine as E
from . import metrics as M
from . import scan as SC
from . import strategies as S
from . import sweep

#: Runs of a sweep that are planned together.
TOGETHER = 24


def _parts(rows: DataFrame, part: str, name: Column, total: str) -> DataFrame:
    """rows in parts by their place _k of `total`, each part with its own nav."""
    x = SC.positions(rows, M.RUN, "_k", total).withColumn(part, name)
    return M.equity_curve(x, by=["run_id", part]).withColumn("_key", F.struct("run_id", part))


def _stats_by(x: DataFrame, part: str, ppy: int) -> DataFrame:
    return M.statistics(x, ppy=ppy, by="_key", span=True).where("n >= 30").withColumn(part, F.col("_key")[part])


def fold_stats(rows: DataFrame, folds: int, ppy: int = 252) -> DataFrame:
    """(fold, start, end, cagr, vol, sharpe, mdd) of equal consecutive parts with 30 rows at least."""
    f = max(2, folds)
    size, more, k = F.expr(f"_n div {f}"), F.col("_n") % f, F.col("_k") - 1  # the first `more` folds have one row more
    fold = F.when(k < more * (size + 1), F.floor(k / (size + 1))).otherwise(more + F.floor((k - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    s = _stats_by(_parts(rows, "fold", fold.cast("long"), "_n"), "fold", ppy)
    return s.select("fold", "start", "end", "cagr", "vol", F.when(F.col("vol") > 0.002, F.col("sharpe")).alias("sharpe"), "mdd")


def in_out_sample(rows: DataFrame, split: float = 0.6, ppy: int = 252) -> DataFrame:
    """(period, start, end, cagr, sharpe, mdd) of the first part and the rest."""
    period = F.when(F.col("_k") <= F.floor(F.col("_n") * split), "in").otherwise("out")
    s = _stats_by(_parts(rows, "period", period, "_n"), "period", ppy)
    return s.select("period", "start", "end", "cagr", "sharpe", "mdd")


def combinations(grid: dict[str, list], max_runs: int = 400) -> list[dict]:
    """The product of the lists, the last fastest, cut at max_runs in that order."""
    return [dict(zip(grid, v, strict=True)) for v in itertools.islice(itertools.product(*grid.values()), max_runs)]


def param_grid(values: dict[str, DataFrame], max_runs: int = 400) -> DataFrame:
    """(run_id, parameters): the product of the lists, cut at max_runs in the order of the lists, the last fastest.
    values: name -> (at, value), a list's values and their places from 0."""
    out, k = None, F.lit(0).cast("long")
    for name, table in values.items():
        side = table.select(F.col("at").alias(f"_{name}"), F.col("value").alias(name)).crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias(f"_n{name}"))))
        out = side if out is None else out.crossJoin(side)
        k = k * F.col(f"_n{name}") + F.col(f"_{name}")
    return out.where(k < max_runs).select(F.concat_ws("-", *values).alias("run_id"), *values)


def cost_levels(days: DataFrame, levels: list[float]) -> DataFrame:
    """(run_id, bps, d, ret, nav): a run without costs (run_id, d, ret, turnover) at every level of costs. Costs
    don't change what is held, so the run is simulated once and a level is a factor on each day."""
    rates = days.sparkSession.createDataFrame([(float(b),) for b in levels], "bps double")
    x = days.select("run_id", "d", "ret", "turnover").crossJoin(rates)
    x = x.withColumn("ret", (1 + F.col("ret")) * (1 - F.col("turnover") * F.col("bps") / 1e4) - 1)
    path = W.partitionBy("run_id", "bps").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return x.select("run_id", "bps", "d", "ret", F.product(1 + F.col("ret")).over(path).alias("nav"))


def cost_statistics(days: DataFrame, levels: list[float], ppy: int = 252) -> DataFrame:
    """(run_id, bps, cagr, sharpe, mdd) of cost_levels."""
    x = cost_levels(days, levels).withColumn("level", F.struct("run_id", "bps"))
    return M.statistics(x, ppy=ppy, by="level").select("level.run_id", "level.bps", "cagr", "sharpe", "mdd")


def run_statistics(runs: DataFrame, ppy: int = 252) -> DataFrame:
    """(run_id, cagr, vol, sharpe, sortino, calmar, mdd, turnover) of simulated runs; turnover is a year's."""
    turnover = F.sum("turnover") / (F.count(F.lit(1)) / ppy)
    return M.statistics(runs, ppy=ppy, extra={"turnover": turnover}).select("run_id", *STATED)


STATED = ("cagr", "vol", "sharpe", "sortino", "calmar", "mdd", "turnover")


@dataclass(frozen=True)
class Setting:
    """How runs are simulated: costs of a unit of turnover, lag, cash (d, rc), dead band, borrowing, leverage."""

    rate: float = 0.0
    lag: int = 1
    cash: DataFrame | None = None
    min_trade: float = 0.0
    borrow: float = 0.0
    max_leverage: float = 1.0
    ppy: int = 252

    def simulate(self, panel: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
        """Days of all runs: in windows where these say it exactly, else by a walk for each run."""
        x = E.legs(panel, targets, events, self.lag, self.max_leverage, self.cash)
        if self.min_trade or self.borrow:
            return E.kernel(x, self.rate, self.min_trade, self.max_leverage, self.borrow, ppy=self.ppy)
        return E.closed_form(x, self.rate)


def parameter_sweep(panel: DataFrame, key: str, base: dict, grid: dict[str, list], events: DataFrame, setting: Setting, exog: DataFrame | None = None, max_runs: int = 400) -> DataFrame:
    """(run_id, the parameters as strings, statistics, error): a run for each combination of the grid, at most
    max_runs in the order of the lists. panel and events should be stored tables. All runs go through one
    simulation, and of the strategies of sweep.GRID their targets come from one plan too; those of others are made
    TOGETHER at a time. A combination that the strategy's rules exclude has an error and no statistics."""
    spark, strategy, rows, runs, out = panel.sparkSession, S.get(key), [], {}, None
    for p in combinations(grid, max_runs):
        run, error = "-".join(map(str, p.values())), None
        try:
            runs[run] = strategy.check({**base, **p})
        except ValueError as e:  # a wrong combination doesn't stop the others
            error = str(e)[:120]
        rows.append((run, *map(str, p.values()), error))
    table = spark.createDataFrame(rows, ", ".join(["run_id string", *(f"`{k}` string" for k in grid), "error string"]))
    if not runs:
        none = F.lit(None).cast("double")
        return table.select("run_id", *grid, *[none.alias(c) for c in STATED], "error")
    if sweep.can(key, runs):
        out = sweep.targets(panel, key, runs)
    else:
        made = [strategy.generate(panel, p, exog).withColumn("run_id", F.lit(run)) for run, p in runs.items()]
        for i in range(0, len(made), TOGETHER):
            part = stored(functools.reduce(DataFrame.unionByName, made[i : i + TOGETHER]))
            out = part if out is None else out.unionByName(part)
    stats = run_statistics(setting.simulate(panel, out, events).select("run_id", "d", "nav", "ret", "turnover"), setting.ppy)
    return table.join(stats, "run_id", "left").select("run_id", *grid, *STATED, "error")


def sweep_pivot(sweep: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    """A row for each value of one parameter, a column for each of another: the surface of a statistic."""
    return sweep.groupBy(rows).pivot(columns).agg(F.avg(value))


def sweep_line(sweep: DataFrame, x: str, value: str) -> DataFrame:
    """(x, value): a statistic's mean over all other parameters, by one."""
    return sweep.groupBy(F.col(x).cast("double").alias(x)).agg(F.avg(value).alias(value))


def sweep_spread(sweep: DataFrame, value: str, obs: int, sharpe: float | None = None) -> DataFrame:
    """(trials, spread, expected_max_sharpe, haircut): the gap between the best and the worst run if over two have
    the statistic, the Sharpe ratio that so many trials would show by chance, and what is left of `sharpe`."""
    one = sweep.agg(F.count(F.lit(1)).alias("trials"), F.count(value).alias("k"), (F.max(value) - F.min(value)).alias("s"))
    chance = deflated_sharpe(F.col("trials"), F.lit(obs))
    left = F.lit(sharpe).cast("double") - chance if sharpe is not None else F.lit(None).cast("double")
    return one.select("trials", F.when(F.col("k") > 2, F.col("s")).alias("spread"), chance.alias("expected_max_sharpe"), left.alias("haircut"))


def walk_forward(runs: DataFrame, folds: int = 5, ppy: int = 252) -> DataFrame:
    """fold_stats of one simulated run: its signals come from the whole history, its folds are judged apart."""
    return fold_stats(runs.select("run_id", "d", "ret"), folds, ppy)


def dispersion(folds: DataFrame, most: float = 0.6) -> DataFrame:
    """(sharpe_dispersion, sharpe_min, high): over folds; high: the result depends on the market's regime."""
    one = folds.agg(F.stddev_samp("sharpe").alias("sharpe_dispersion"), F.min("sharpe").alias("sharpe_min"))
    return one.withColumn("high", F.coalesce(F.col("sharpe_dispersion") > most, F.lit(False)))


def block_starts(spark: SparkSession, n: int, sims: int, block: int, seed: int) -> DataFrame:
    """(sim, k, at): where each block of each path begins, drawn for each (sim, k) by a hash with a seed."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "sim", "k").cast("binary")), 1, 15), 16, 10).cast("long")
    last = F.lit(math.ceil(n / block) - 1).cast("long")
    return spark.range(sims).withColumnRenamed("id", "sim").select("sim", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")).withColumn("at", F.pmod(drawn, F.lit(max(1, n - block))))


def _numbered(rows: DataFrame) -> DataFrame:
    """(at, r): returns by their place from 0."""
    return SC.positions(rows.select("d", F.coalesce("ret", F.lit(0.0)).alias("r")), [], "at").select((F.col("at") - 1).alias("at"), "r")


def mc_paths(rows: DataFrame, starts: DataFrame, n: int, block: int) -> DataFrame:
    """(sim, step, v): compounded blocks of returns, n steps a path. A block's own growth is looked up, what
    enters it is a product over the path's blocks before."""
    index = block_index(rows, block).select(F.col("at"), F.posexplode("grown").alias("j", "g"), "whole")
    x = starts.join(block_index(rows, block).select("at", "whole"), "at")
    before = F.coalesce(F.product("whole").over(W.partitionBy("sim").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    x = x.select("sim", "k", "at", before.alias("_in"))
    out = x.join(index.drop("whole"), "at").select("sim", (F.col("k") * block + F.col("j")).alias("step"), (F.col("_in") * F.col("g")).alias("v"))
    return out.where(F.col("step") < n)


def block_index(rows: DataFrame, block: int) -> DataFrame:
    """(at, grown, whole, high, low, drop, sum, squares): of the block of returns that begins at each place, the
    growth after each of its rows and the summary that blocks are put together from: the growth of the whole, its
    highest, lowest and deepest fall from a high (the start is none), sum and squares of returns. Rows are
    dealt to the blocks that hold them; a place needs no row but its own block's."""
    r = _numbered(rows)
    n = F.broadcast(r.agg(F.count(F.lit(1)).alias("_n")))
    x = r.select("r", F.col("at").alias("_i"), F.explode(F.sequence(F.col("at") - (block - 1), F.col("at"))).alias("at")).crossJoin(n).where((F.col("at") >= 0) & (F.col("at") < F.greatest(F.lit(1), F.col("_n") - block)))
    g = x.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "r"))), lambda e: e["r"]).alias("rs"))
    return summary_of(g.select("at", "rs"))


def summary_of(g: DataFrame) -> DataFrame:
    """(at, rs) with the summary of block_index."""
    start = F.struct(F.array().cast("array<double>").alias("g"), F.lit(1.0).alias("v"), F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("l"), F.lit(0.0).alias("d"))

    def step(s, r):
        v = s["v"] * (1 + r)
        high = F.greatest(s["h"], v)
        return F.struct(F.concat(s["g"], F.array(v)).alias("g"), v.alias("v"), high.alias("h"), F.least(s["l"], v).alias("l"), F.least(s["d"], v / high - 1).alias("d"))

    total = lambda f: F.aggregate("rs", F.lit(0.0), lambda a, r: a + f(r))
    out = g.withColumn("_s", F.aggregate("rs", start, step))
    return out.select("at", F.col("_s.g").alias("grown"), F.col("_s.v").alias("whole"), F.col("_s.h").alias("high"), F.col("_s.l").alias("low"), F.col("_s.d").alias("drop"), total(lambda r: r).alias("sum"), total(lambda r: r * r).alias("squares"))


def bootstrap(rows: DataFrame, sims: int = 500, block: int = 21, seed: int = 42) -> DataFrame:
    """mc_paths over drawn blocks of the returns that aren't null; no rows below three blocks of them."""
    rows = rows.where("ret IS NOT NULL")
    n = rows.count()
    return mc_paths(rows, block_starts(rows.sparkSession, n, sims if n >= 3 * block else 0, block, seed), n, block)


def mc_summary(rows: DataFrame, sims: int = 500, block: int = 21, seed: int = 42, ppy: int = 252) -> DataFrame:
    """(percentile, cagr, mdd, sharpe, prob_loss, prob_dd_20, median_cagr): a row for each percentile over drawn
    paths; the last three are the same in all. A path is a fold over its blocks' summaries (growth, high, deepest
    fall, sums), so no row is made for a path's day; the last block is cut to the path's length."""
    rows = rows.where("ret IS NOT NULL")
    n = rows.count()
    starts = block_starts(rows.sparkSession, n, sims if n >= 3 * block else 0, block, seed)
    blocks, short = math.ceil(n / block), n - (math.ceil(n / block) - 1) * block
    whole = block_index(rows, block).withColumn("cut", F.lit(False))
    r = _numbered(rows)
    ends = r.select("r", F.col("at").alias("_i"), F.explode(F.sequence(F.col("at") - (short - 1), F.col("at"))).alias("at")).where(f"at >= 0 AND at < {max(1, n - block)}")
    ends = summary_of(ends.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "r"))), lambda e: e["r"]).alias("rs"))).withColumn("cut", F.lit(True))
    index = whole.unionByName(ends).drop("grown")
    x = starts.withColumn("cut", F.col("k") == blocks - 1).join(index, ["at", "cut"])
    x = x.groupBy("sim").agg(F.array_sort(F.collect_list(F.struct("k", "whole", "high", "low", "drop", "sum", "squares"))).alias("b"))
    start = F.struct(F.lit(1.0).alias("v"), F.lit(None).cast("double").alias("h"), F.lit(0.0).alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def put(s, b):  # the deepest fall so far: inside the block, or from the high before it to its lowest
        return F.struct((s["v"] * b["whole"]).alias("v"), F.greatest(s["h"], s["v"] * b["high"]).alias("h"), F.least(s["d"], b["drop"], F.coalesce(s["v"] * b["low"] / s["h"] - 1, F.lit(0.0))).alias("d"), (s["s"] + b["sum"]).alias("s"), (s["q"] + b["squares"]).alias("q"))

    f = F.col("f")
    s = x.select("sim", F.aggregate("b", start, put).alias("f"))
    mean = f["s"] / n
    sd = F.sqrt(F.greatest(F.lit(0.0), f["q"] - n * mean * mean) / (n - 1))
    s = s.select("sim", f["v"].alias("f"), f["d"].alias("mdd"), M.ratio(mean, sd, ppy).alias("sharpe"), (F.pow(f["v"], F.lit(ppy / max(1, n))) - 1).alias("cagr"))
    cuts = (5, 25, 50, 75, 95)
    at = ", ".join(str(p / 100) for p in cuts)
    one = s.agg(*[F.expr(f"percentile({c}, array({at}))").alias(c) for c in ("cagr", "mdd", "sharpe")], F.avg((F.col("f") < 1).cast("double")).alias("prob_loss"), F.avg((F.col("mdd") < -0.2).cast("double")).alias("prob_dd_20"), F.expr("percentile(cagr, 0.5)").alias("median_cagr"))
    z = F.arrays_zip(F.array(*[F.lit(f"{p}th") for p in cuts]).alias("percentile"), "cagr", "mdd", "sharpe")
    return one.where("median_cagr IS NOT NULL").select(F.inline(z), "prob_loss", "prob_dd_20", "median_cagr")


def mc_bands(paths: DataFrame) -> DataFrame:
    """(step, p5 .. p95): over the paths of each step; a step has as many values as there are paths."""
    x = paths.groupBy("step").agg(F.sort_array(F.collect_list("v")).alias("q"))
    at = lambda p: F.lit(p / 100) * (F.size("q") - 1)
    low, high = lambda p: F.get("q", F.floor(at(p)).cast("int")), lambda p: F.get("q", F.ceil(at(p)).cast("int"))
    return x.select("step", *[(low(p) + (high(p) - low(p)) * (at(p) - F.floor(at(p)))).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


def fan(bands: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, p5, p50, p95, actual): bands by step on the days of the returns they come from (run_id, d, ret, nav), and
    the path that was, 1 on the first day."""
    x = SC.positions(rows.where("ret IS NOT NULL").select("d", "nav"), [], "step").withColumn("step", F.col("step") - 1)
    first = x.agg(F.min_by("nav", "step").alias("_first"))
    return x.crossJoin(F.broadcast(first)).join(bands, "step").select("d", "p5", "p50", "p95", (F.col("nav") / F.col("_first")).alias("actual"))


# The coefficients of Acklam's published approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """The normal quantile, null outside (0, 1)."""
    inside = (p > 0) & (p < 1)
    tail = F.sqrt(-2 * F.log(F.when(inside, F.least(p, 1 - p))))
    far = _poly(_C, tail) / (_poly(_D, tail) * tail + 1)
    q = p - 0.5
    r = q * q
    near = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return F.when(inside, F.when(p < 0.02425, far).when(p > 1 - 0.02425, -far).otherwise(near))


def deflated_sharpe(trials: Column, obs: Column) -> Column:
    """The best Sharpe ratio that so many trials without skill are expected to show, annualised by 252."""
    gamma = 0.5772156649015329
    fine = (trials >= 2) & (obs >= 30)
    n = F.when(fine, trials.cast("double"))
    z = (1 - gamma) * norm_ppf(1 - 1 / n) + gamma * norm_ppf(1 - 1 / (n * math.e))
    return z / F.sqrt(F.when(fine, obs.cast("double"))) * 252**0.5
