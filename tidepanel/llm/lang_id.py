"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams (log
odds between the languages with that bit and those without, each language with equal weight) gives the
mean log odds of a text. Decoding is loss-weighted: a bit counts by how well its classifier did on the
training sample, and the codeword of the least logistic loss wins, of equal ones that of the language first in
the alphabet; a small lead flags ambiguity.

Training: rows with text and language, of which at most about SAMPLE a language are taken by a hash of
the id (all, if a language has fewer). Null text or one without a letter: `und` with score 0, as
everything is if there is nothing to learn from. A null id has no remainder: the query's held_out is null, and
the row isn't learnt from. Extra columns are ignored; repeated rows give repeated
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .texts import LOWER, batch_of, map_texts, sum_by

#: Rows of each language to learn from (expected number, by hash), n-gram sizes, hash buckets (2^BITS).
SAMPLE, ORDERS, BITS = 3000, (2, 3), 15
#: Leads under this flag a text as ambiguous.
LEAD = 0.1
#: Languages at most; what they need on the driver is bounded by it.
MOST = 512


def grams(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket of every n-gram, offsets of texts); n-grams don't cross texts."""
    low, out = LOWER[data].astype(np.uint32), []
    for n in ORDERS:
        if len(low) < n:
            out.append((np.zeros(0, np.int64), np.zeros_like(off)))
            continue
        h = np.full(len(low) - n + 1, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= low[k : len(low) - n + 1 + k]
        h *= np.uint32(0x9E3779B1)
        whole = np.ones(len(h), bool)
        for k in range(1, n):  # those that begin in the last n - 1 bytes of a text
            at = off[1:] - k
            at = at[(at >= 0) & (at < len(h))]
            whole[at] = False
        # short texts: a start that belongs to the text before is marked twice, which is harmless
        keep = np.flatnonzero(whole)
        out.append(((h[keep] >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(keep, off)))
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """[n, bits] of +1 and -1: exhaustive up to five languages, beyond that dense random columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (b >> i) & 1 else -1 for b in range(1, 1 << (n - 1))] for i in range(n)], float)
    rng, columns = np.random.default_rng(seed), set()
    while len(columns) < min(int(np.ceil(10 * np.log2(n))), 2 ** (n - 1) - 1):
        c = rng.integers(0, 2, n)
        c = c if c[0] else 1 - c
        if 0 < c.sum() < n:
            columns.add(tuple(c.tolist()))
    return np.array(sorted(columns), float).T * 2 - 1


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # [languages, bits]
    odds: np.ndarray  # [orders * buckets, bits], float32
    weight: np.ndarray  # [bits]
    scale: float


def margins(odds: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[texts, bits]: mean log odds of the n-grams."""
    total, count = np.zeros((len(off) - 1, odds.shape[1])), np.zeros(len(off) - 1)
    for k, (bucket, o) in enumerate(grams(data, off)):
        n = np.diff(o)
        full = n > 0
        if len(bucket):
            # a row for each n-gram is summed in float64 within a text
            total[full] += np.add.reduceat(odds[bucket + (k << BITS)], o[:-1][full], axis=0, dtype=np.float64)
        count += n
    return total / np.maximum(count, 1)[:, None]


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    out = sum_by((low >= 97) & (low <= 122), off) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def training_rows(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(lang, text): rows to learn from, thinned by a hash of the id to the stated bound."""
    rows = df.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST + 1).collect()}
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} languages")
    langs = sorted(counts)
    if not langs:
        return rows.select("lang", "text"), []
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / counts[k]))]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text"), langs


def train(df: DataFrame) -> Model | None:
    """df: rows to learn from (doc_id, text, lang)."""
    rows, langs = training_rows(df)
    if not langs:
        return None
    place = {k: i for i, k in enumerate(langs)}
    size = len(ORDERS) << BITS

    def count(keys, data, off, null):
        which = np.array([place[k] for k in keys.to_pylist()])
        for k, (bucket, o) in enumerate(grams(data, off)):
            key = np.repeat(which, np.diff(o)) * size + bucket + (k << BITS)
            key, n = np.unique(key, return_counts=True)
            yield batch_of(lang=pa.array((key // size).astype(np.int32)), bucket=pa.array((key % size).astype(np.int32)), n=pa.array(n.astype(np.int64)))

    table = np.zeros((len(langs), size))
    for lang, bucket, n in _summed(map_texts(rows, "lang int, bucket int, n long", count, ("lang", "text"))):
        table[lang, bucket] = n
    share = np.concatenate([(t + 0.5) / (t + 0.5).sum(1, keepdims=True) for t in np.split(table, len(ORDERS), axis=1)], axis=1)
    code = codewords(len(langs))
    odds = np.stack([np.log(share[code[:, b] > 0].mean(0)) - (np.log(share[code[:, b] < 0].mean(0)) if (code[:, b] < 0).any() else 0) for b in range(code.shape[1])], axis=1).astype(np.float32)

    def right(keys, data, off, null):
        which = np.array([place[k] for k in keys.to_pylist()])
        m = margins(odds, data, off) * code[which]
        n = code.shape[1]
        yield batch_of(bit=pa.array(np.tile(np.arange(n, dtype=np.int32), len(which))), ok=pa.array((m > 0).ravel().astype(np.float64)), m=pa.array(np.abs(m).ravel()))

    stats = map_texts(rows, "bit int, ok double, m double", right, ("lang", "text")).groupBy("bit").agg(F.avg("ok").alias("ok"), F.avg("m").alias("m")).collect()
    weight, scale = np.zeros(code.shape[1]), 0.0
    for r in stats:
        weight[r["bit"]] = max(2 * r["ok"] - 1, 1e-3)
        scale += r["m"] / len(stats)
    return Model(langs, code, odds, weight / max(weight.sum(), 1e-9), 4 / max(scale, 1e-9))


def _summed(rows: DataFrame):
    """At most languages * orders * buckets rows, whatever the input."""
    return ((r["lang"], r["bucket"], r["n"]) for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator())


def decode(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, lead) by weighted logistic loss against each codeword."""
    loss = np.stack([(np.logaddexp(0, -model.scale * m * c) * model.weight).sum(1) for c in model.code], axis=1)
    best = loss.argmin(1)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, axis=1)[:, ::-1]
    return best, top[:, 0], top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0)


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) from the text alone."""

    def work(keys, data, off, null):
        n = len(off) - 1
        if model is None:
            best, score, lead, ok, langs = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool), ["und"]
        else:
            ok, langs = has_letter(data, off) & ~null, model.langs
            best, score, lead = decode(model, margins(model.odds, data, off))
        names = np.where(ok, np.array(langs, object)[best], "und")
        yield batch_of(doc_id=keys.cast(pa.int64()), lang_pred=pa.array(names, pa.string()), score=np.where(ok, np.clip(score, 0, 1), 0.0), ambiguous=~ok | (lead < LEAD))

    return map_texts(df, "doc_id long, lang_pred string, score double, ambiguous boolean", work)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(docs.where(~out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op6_language": op6_language}
