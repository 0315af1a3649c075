"""URL rules by a cascade of Bloom filters.

A url's keys are its host's domains, each with the starts of its path that are as long as some
listed path. Level 0 encodes the listed keys; level 1 the keys of the corpus's whole universe that
pass level 0 though not listed; level 2 the listed keys that pass level 1, and so on until none is
wrong. Over that universe the cascade knows exactly which keys are listed, so judging a url needs no
join. What the rules say of a listed key (its rule is the key itself) is looked up after that.

Level 0 grows with the list, level k with the false positives of the one before, kept near the
list's length by the first level's error rate; a level over MAX_BYTES raises. Urls without a rule
are blocked if their host is on the block list, else allowed.

Null url, or no ://: host and path empty, no rule, allowed. Extra columns are ignored; repeated rows
give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read
from .texts import batch_of

#: (host, path) -> verdict. The query's rules.
RULES = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
#: Hosts (with their subdomains) that are blocked where no rule fits.
BLOCKED_HOSTS = ("spam-farm.example.org", "casino-win.example.org", "ads-track.example.org")
#: The most bytes of a level, as it goes to every task.
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    m: int
    k: int

    def has(self, h: np.ndarray) -> np.ndarray:
        """h: [n, 2] hashes."""
        ok = np.ones(len(h), bool)
        for i in range(self.k):
            p = (h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(self.m)
            ok &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return ok


def hashes(keys: list[str], level: int) -> np.ndarray:
    """Two 64-bit hashes of each key, other ones at each level."""
    salt = level.to_bytes(4, "little")
    raw = b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16, salt=salt).digest() for k in keys)
    h = np.frombuffer(raw, "<u8").reshape(-1, 2).copy()
    h[:, 1] |= np.uint64(1)
    return h


def shape(n: int, rate: float) -> tuple[int, int]:
    m = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    if m / 8 > MAX_BYTES:
        raise ValueError(f"a level of {m / 8e6:.0f} MB; the bound is {MAX_BYTES / 1e6:.0f} MB")
    return m, max(1, round(math.log2(1 / rate)))


def fill(keys: DataFrame, n: int, rate: float, level: int) -> Level:
    """The level that encodes keys (key string), n of them: words are put together where they are made."""
    m, k = shape(n, rate)

    def words(batches):
        bits = np.zeros((m + 63) // 64, np.uint64)
        for batch in batches:
            h = hashes(batch.column(0).to_pylist(), level)
            for i in range(k):
                p = (h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(m)
                np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield batch_of(at=pa.array(at.astype(np.int64)), word=pa.array(bits[at].view(np.int64)))

    bits = np.zeros((m + 63) // 64, np.uint64)
    for at, word in keys.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toLocalIterator():
        bits[at] = np.array(word, np.int64).view(np.uint64)
    return Level(bits, m, k)


def listed(levels: list[Level], keys: list[str]) -> np.ndarray:
    """Membership in the list, exact over the universe: the first level that a key fails decides."""
    out, at = np.full(len(keys), len(levels) % 2 == 1), np.arange(len(keys))
    for i, level in enumerate(levels):
        if not len(at):
            break
        ok = level.has(hashes([keys[j] for j in at], i))
        out[at[~ok]] = i % 2 == 1
        at = at[ok]
    return out


def build(ws: Workspace, universe: DataFrame, keys: list[str]) -> list[Level]:
    """Levels for a list over the universe (key string, distinct)."""
    spark = universe.sparkSession
    universe = ws.table(universe, "universe")
    total = max(1, universe.count())
    keys = sorted(set(keys))
    if not keys:
        return []
    mine = spark.createDataFrame([(k,) for k in keys], "key string")
    others = universe.join(F.broadcast(mine), "key", "left_anti") if len(keys) < 100_000 else universe.join(mine, "key", "left_anti")
    rate = max(min(0.5, len(keys) / (math.sqrt(2) * total)), 1e-9)
    levels: list[Level] = []
    now, n, side = mine, len(keys), {0: mine, 1: others}
    while n:
        levels.append(fill(now, n, rate if not levels else 0.5, len(levels)))
        # of the other side, the keys that this level takes wrongly
        level, k = levels[-1], len(levels) - 1

        def wrong(batches, level=level, k=k):
            for batch in batches:
                yield batch.filter(pa.array(level.has(hashes(batch.column(0).to_pylist(), k)))) if batch.num_rows else batch

        source = side[len(levels) % 2]
        side[len(levels) % 2] = now = ws.table(source.mapInArrow(wrong, "key string"), f"level-{k}")
        n = now.count()
    return levels


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    """Host with A-Z lower-cased, and path, of a column; both empty without ://."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, locate('://', `{url}`) + 3) ELSE '' END")
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """A url's keys, longest first: host domains with path starts of the listed lengths."""
    if not host:
        return []
    parts = host.split(".")
    out = [(".".join(parts[i:]), path[:n]) for i in range(len(parts)) for n in lengths if len(path) >= n]
    return [h + p for h, p in sorted(out, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def judge(ws: Workspace, df: DataFrame, rules: dict[tuple[str, str], str] = RULES, blocked: tuple[str, ...] = BLOCKED_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of page_id, url."""
    lengths = sorted({len(p) for _, p in rules} | {0})
    host, path = host_and_path("url")
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host.alias("host"), path.alias("path"))

    def keys_of(batches):
        for batch in batches:
            found = {k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in candidates(h, p, lengths)}
            yield batch_of(key=pa.array(sorted(found), pa.string()))

    universe = pages.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct().mapInArrow(keys_of, "key string").distinct()
    said = {h + p: v for (h, p), v in rules.items()}
    levels = build(ws, universe, [*said, *blocked])

    def run(batches):
        for batch in batches:
            per = [candidates(h, p, lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            flat = [k for ks in per for k in ks]
            names = list(dict.fromkeys(flat))
            hit = {k for k, ok in zip(names, listed(levels, names), strict=True) if ok}
            found = [[k for k in ks if k in hit] for ks in per]
            rule = [next((k for k in ks if k in said), None) for ks in found]
            verdict = [said[r] if r else "block" if ks else "allow" for r, ks in zip(rule, found, strict=True)]
            yield batch_of(page_id=batch.column(0), host=batch.column(1), path=batch.column(2), rule=pa.array(rule, pa.string()), verdict=pa.array(verdict, pa.string()))

    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(Workspace(spark, "urls"), read(spark, sf_dir, "pages"))


QUERIES = {"op5_urls": op5_urls}

#: Host, path and rule by plain SQL. The last case (no rule) is the method's: blocked hosts.
SQL = {
    "op5_urls": """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
v AS (SELECT page_id, coalesce(regexp_extract(r, '^([^?#]*)', 1), '') AS r FROM u),
w AS (SELECT page_id, translate(regexp_extract(r, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/]*(.*)$', 1) AS path FROM v),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM w JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed(h) AS (VALUES ('spam-farm.example.org'), ('casino-win.example.org'), ('ads-track.example.org'))
SELECT CAST(w.page_id AS BIGINT) AS page_id, host, path, rule,
       coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE host = listed.h OR ends_with(host, '.' || listed.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM w LEFT JOIN best USING (page_id)
"""
}
