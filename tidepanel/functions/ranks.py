"""Ranks within a day for universes that one task can't hold: what rolling.top_n and pct_rank say by a window over a
day, by counts and partial choices that are combined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scan as S

#: Parts that a day's names are dealt in before the best of all are chosen.
DEALT = 64


def top_n(panel: DataFrame, score: str, n: int, name: str) -> DataFrame:
    """panel with `name`: 1.0 for the n best of a day, ties by the asset's place. Each part of a day sends its n best
    on, so that the last choice sees DEALT * n names, however many a day has."""
    order = [F.desc(score), F.asc("ord")]
    x = panel.where(F.col(score).isNotNull()).select("d", "asset", "ord", score).withColumn("_h", F.pmod(F.xxhash64("asset"), F.lit(DEALT)))
    for part in (["d", "_h"], ["d"]):
        x = x.withColumn("_k", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    best = x.select("d", "asset", F.lit(1.0).alias(name))
    return panel.join(best, ["d", "asset"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def pct_rank(panel: DataFrame, score: str, name: str) -> DataFrame:
    """panel with `name`: the mean rank over the number of known scores of a day, ascending. Equal scores are one row
    with their count; counts of value ranges say how many lie below a range, and within it a window over its
    different values how many lie below each."""
    x = panel.where(F.col(score).isNotNull())
    tied = x.groupBy("d", F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_t")).withColumn("_b", S.value_bucket(F.col("_s")))
    day = W.partitionBy("d").orderBy("_b")
    ranges = tied.groupBy("d", "_b").agg(F.sum("_t").alias("_n"))
    ranges = ranges.select("d", "_b", F.coalesce(F.sum("_n").over(S.before(day)), F.lit(0)).alias("_under"), F.sum("_n").over(W.partitionBy("d")).alias("_all"))
    own = W.partitionBy("d", "_b").orderBy("_s")
    below = F.col("_under") + F.coalesce(F.sum("_t").over(S.before(own)), F.lit(0))
    ranks = tied.join(ranges, ["d", "_b"]).select("d", "_s", ((below + (F.col("_t") + 1) / 2) / F.col("_all")).alias(name))
    return panel.join(ranks.withColumnRenamed("_s", score), ["d", score], "left")
