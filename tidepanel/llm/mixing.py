"""Mixing sources to target weights, in DataFrame operations only.

Leaves are (domain, language, source). Weights go down the tree: a node's budget is shared among its
children by weight, none gets more than its capacity (its tokens times MAX_EPOCHS), and what a child
can't take goes to its siblings by weight. As a node's budget never exceeds its capacity, only what a
whole subtree can't take is shared out further up. A leaf's budget is taken in whole epochs and then as a
prefix of one more, in an order that depends on the seed, the epoch and the id. The prefix ends with the
document that would exceed the budget left out; documents of one id stay together.

The running sum of a prefix is found by hash ranges: sums of 4096 ranges first, then the rows of the one
range where the budget ends. So no leaf is sorted as a whole, and the choice is a comparison of a row's
hash with its leaf's limit: texts are not shuffled.

Null language or source: a node of its own named by the empty string. Null text: no tokens. A weight that
isn't listed is OTHER; negative ones count as 0, and nodes without weight get nothing. Extra columns stay;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, read

OTHER = 0.5


@dataclass(frozen=True)
class Mix:
    """The budget is share * all tokens."""

    domains: dict[str, float] = field(default_factory=lambda: {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 6.0, "de": 1.5, "fr": 1.5, "es": 1.0})
    sources: dict[str, float] = field(default_factory=dict)
    share: float = 0.8
    max_epochs: int = 2
    seed: str = "mix"


def domain_of(source: F.Column) -> F.Column:
    """The default domain: a source's number modulo 4; the domain of the rest is `other`."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("domain"), F.pmod(digits.try_cast("bigint"), F.lit(4)).cast("string"))).otherwise("other")


def tokens_of(text: F.Column) -> F.Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, float], other: float) -> F.Column:
    if not weights:
        return F.lit(1.0)
    x = F.when(F.lit(False), F.lit(0.0))
    for name, w in weights.items():
        x = x.when(F.col(column) == name, F.lit(max(0.0, w)))
    return x.otherwise(F.lit(other))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, budget of the parent, weight, cap) with `given`: the budget by weight, at
    most cap. Children in order of cap / weight are full as long as what is left gives them their cap."""
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = w.orderBy(F.expr("CASE WHEN weight > 0 THEN cap / weight END").asc_nulls_last(), F.col(name))
    live = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
    out = nodes.withColumn("cap_before", F.coalesce(F.sum(live).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    full = (F.col("weight") > 0) & (F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight"))
    out = out.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(w)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(w)
    out = out.withColumn("spent", spent).withColumn("open", open_)
    given = F.when(F.col("full"), F.col("cap")).when((F.col("weight") > 0) & (F.col("open") > 0), F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("budget") - F.col("spent")) * F.col("weight") / F.col("open"))).otherwise(0.0)
    return out.withColumn("given", given).drop("cap_before", "weight_left", "full", "spent", "open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, origin, tokens) with `given` tokens of each leaf."""
    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(float(mix.max_epochs)))
    # a subtree's capacity is what its children with weight can take
    leaf_w, lang_w, dom_w = _weight("origin", mix.sources, OTHER), _weight("language", mix.languages, OTHER), _weight("domain", mix.domains, OTHER)
    leaves = leaves.withColumn("weight", leaf_w)
    langs = leaves.groupBy("domain", "language").agg(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).alias("cap")).withColumn("weight", lang_w)
    doms = langs.groupBy("domain").agg(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).alias("cap")).withColumn("weight", dom_w)
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(mix.share)).alias("wanted"))
    room = doms.agg(F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)), F.lit(0.0)).alias("room"))
    root = total.crossJoin(room).select(F.least("wanted", "room").alias("budget"))  # one row each
    doms = share_out(doms.crossJoin(F.broadcast(root)), [], "domain")
    langs = share_out(langs.join(doms.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], "language")
    leaves = share_out(leaves.join(langs.select("domain", "language", F.col("given").alias("budget")), ["domain", "language"]), ["domain", "language"], "origin")
    return leaves.select("domain", "language", "origin", "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("given"))


LEAF = ["domain", "language", "origin"]


def with_leaf(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"domain": domain_of(F.coalesce("source", F.lit(""))), "language": F.coalesce("lang", F.lit("")), "origin": F.coalesce("source", F.lit(""))})


def _place(seed: str) -> F.Column:
    """A row's place in its epoch's order: 32 hex digits."""
    return F.md5(F.concat_ws("-", F.lit(seed), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))


def limits(ws: Workspace, docs: DataFrame, mix: Mix) -> DataFrame:
    """(leaf, epochs, last): whole epochs, and the last place taken of the next (null: none)."""
    rows = ws.table(with_leaf(docs.select("doc_id", "lang", "source", "text")).select("doc_id", *LEAF, tokens_of(F.col("text")).alias("n")), "tokens")
    leaves = ws.table(budgets(rows.groupBy(*LEAF).agg(F.sum("n").alias("tokens")), mix), "budgets")
    epochs = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0))
    leaves = ws.table(leaves.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") > 0, F.col("given") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0))), "leaves")
    placed = rows.join(_leaf_side(leaves.where("rest > 0").select(*LEAF, "epochs", "rest")), LEAF).withColumn("place", _place(mix.seed))
    placed = placed.withColumn("range", F.substring("place", 1, 3))
    sums = ws.table(placed.groupBy(*LEAF, "rest", "range").agg(F.sum("n").alias("n")), "ranges")
    run = W.partitionBy(*LEAF).orderBy("range")
    sums = sums.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    ends = ws.table(sums.where("before <= rest AND upto > rest").select(*LEAF, "range", "before"), "ends")
    edge = placed.join(_leaf_side(ends), [*LEAF, "range"]).groupBy(*LEAF, "range", "rest", "before", "place").agg(F.sum("n").alias("n"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEAF, "range").orderBy("place"))).where("upto <= rest")
    last = edge.groupBy(*LEAF).agg(F.max("place").alias("inside"))
    # with no row of the end range inside, the ranges before it are; with no end range, all
    out = leaves.join(ends.select(*LEAF, "range"), LEAF, "left").join(last, LEAF, "left")
    limit = F.when(F.col("rest") <= 0, F.lit(None).cast("string")).when(F.col("inside").isNotNull(), F.col("inside")).when(F.col("range").isNotNull(), F.col("range")).otherwise(F.lit("g"))
    return ws.table(out.select(*LEAF, "epochs", limit.alias("last")), "limits")


#: Leaves that go to every task, at most.
BROADCAST_LEAVES = 200_000


def _leaf_side(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def mixed(ws: Workspace, docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with domain, language, origin and copies (0: not chosen)."""
    chosen = with_leaf(docs).join(_leaf_side(limits(ws, docs, mix)), LEAF, "left")
    extra = F.when(F.col("last").isNotNull() & (_place(mix.seed) <= F.col("last")), 1).otherwise(0)
    return chosen.withColumn("copies", (F.coalesce("epochs", F.lit(0)) + extra).cast("long")).drop("epochs", "last")


def select_mix(ws: Workspace, docs: DataFrame, mix: Mix) -> DataFrame:
    """The chosen rows, as often as their epochs say, with the columns of docs. Columns of docs that are
    named as the work columns are kept apart from them."""
    names = docs.columns
    work = docs.select("doc_id", "lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = mixed(ws, work, mix).where("copies > 0")
    rows = rows if mix.max_epochs <= 1 else rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = mixed(Workspace(spark, "mixing"), docs, Mix())
    return out.select("doc_id", "domain", F.col("language").alias("lang"), F.col("origin").alias("source"), tokens_of(F.col("text")).alias("n_tokens"), "copies")


QUERIES = {"op8_mixing": op8_mixing}


def _level(parent: str, name: str, source: str) -> str:
    """One level of share_out in DuckDB."""
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
SELECT *, CASE WHEN f THEN cap WHEN weight > 0 AND opened > 0 THEN least(cap, greatest(0, budget - spent) * weight / opened) ELSE 0 END AS given
FROM (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({over}) AS spent, sum(CASE WHEN f THEN 0 ELSE weight END) OVER ({over}) AS opened
FROM (SELECT *, weight > 0 AND cap * weight_left <= (budget - cap_before) * weight AS f
FROM (SELECT *, coalesce(sum(CASE WHEN weight > 0 THEN cap ELSE 0 END) OVER ({over} ORDER BY CASE WHEN weight > 0 THEN cap / weight END NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(weight) OVER ({over} ORDER BY CASE WHEN weight > 0 THEN cap / weight END NULLS LAST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
      FROM {source})))"""


SQL = {
    "op8_mixing": f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> '' THEN 'domain' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE 'other' END AS domain FROM documents),
leaf AS (SELECT domain, language, origin, sum(n)::DOUBLE AS tokens, sum(n)::DOUBLE * 2 AS cap, 1.0::DOUBLE AS weight FROM t GROUP BY ALL),
lang AS (SELECT domain, language, sum(cap) AS cap, CASE language WHEN 'en' THEN 6.0 WHEN 'de' THEN 1.5 WHEN 'fr' THEN 1.5 WHEN 'es' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM leaf GROUP BY ALL),
dom AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'domain0' THEN 4.0 WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 WHEN 'domain3' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, least((SELECT sum(tokens) * 0.8 FROM leaf), (SELECT sum(cap) FROM leaf)) AS budget FROM lang GROUP BY domain),
dom2 AS ({_level("", "domain", "dom")}),
lang1 AS (SELECT lang.*, dom2.given AS budget FROM lang JOIN dom2 USING (domain)),
lang2 AS ({_level("domain", "language", "lang1")}),
leaf1 AS (SELECT leaf.*, lang2.given AS budget FROM leaf JOIN lang2 USING (domain, language)),
leaf2 AS ({_level("domain, language", "origin", "leaf1")}),
b AS (SELECT domain, language, origin, CAST(tokens AS BIGINT) AS tokens, CAST(floor(given + 1e-6) AS BIGINT) AS given FROM leaf2),
e AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs FROM b),
p AS (SELECT t.*, e.epochs, CASE WHEN e.tokens > 0 THEN e.given - e.epochs * e.tokens ELSE 0 END AS rest, md5('mix-' || CAST(e.epochs AS VARCHAR) || '-' || CAST(doc_id AS VARCHAR)) AS place FROM t JOIN e USING (domain, language, origin)),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain, language, origin ORDER BY place) AS upto FROM p)
SELECT doc_id, domain, language AS lang, origin AS source, n AS n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s
"""
}
