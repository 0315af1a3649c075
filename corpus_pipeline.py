"""The corpus pipeline: quality rules, near-duplicates, repeats, mixing, tokens.

run(spark, sf_dir) applies STAGES to documents. Each stage writes what it needs to the shared folder
(see tidepanel.llm.common) and returns a DataFrame; run() writes the result of each as a table there too,
so a lost executor costs the tasks since the last table.

docs may have any further columns, under any names; they are kept as they are. An empty table passes through
all stages. What a stage does with nulls, equal rows and texts of any length is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, mixing, near_dup, quality, repeats
from tidepanel.llm.common import Workspace, read, scratch

#: Passages of over 50 words are longer than this many bytes; shorter repeats stay.
REPEAT_BYTES = 200
#: Near-duplicates: words of a shingle, percent of Jaccard similarity.
SHINGLE, PERCENT = 5, 80
#: All but a tenth of the tokens are kept, none twice: leaves over their weight give way.
MIX = mixing.Mix(share=0.9, max_epochs=1)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    paths = quality.paths_of()
    return quality.filter_quality(docs, paths, quality.learn(docs, read(spark, sf_dir, "labels"), paths))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least id, rows without an id last. Rows
    without words (null and empty texts too) are in no group and stay; equal rows are a group."""
    return near_dup.without_near_duplicates(Workspace(spark, "pipeline-minhash"), docs, SHINGLE, PERCENT)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand anywhere else too are cut out of every text; whole characters only. n_chars, if
    there is one, follows. Null or empty texts stay; equal rows lose what they share, in all of them."""
    out = repeats.without_repeats(Workspace(spark, "pipeline-repeats"), docs, REPEAT_BYTES)
    if "n_chars" not in docs.columns:
        return out
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[n.alias(c) if c == "n_chars" else out[f"`{c}`"] for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their weights; the rows that were not chosen go."""
    return mixing.select_mix(Workspace(spark, "pipeline-mixing"), docs, MIX)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document; the other columns end here."""
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [("quality", quality_stage), ("minhash", minhash_stage), ("suffix", suffix_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Sketches, suffix sorting and tokens can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote for itself is deleted when its result is stored, and that with the next one's."""
    ws = Workspace(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = ws.table(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
