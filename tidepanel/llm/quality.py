"""Quality rules: base counts of a text, and the fertility of a public tokenizer on it.

Fertility: the words of a text are encoded with public vocabularies, one that falls back to bytes and one made of
bytes. In each of them characters per token, the share of byte tokens and the entropy of the token distribution
are held against rejection bands. Entropy is a share of the most that as many tokens could have, so it is defined
at any length. `learn` sets the bounds for each vocabulary, language and script (a text's commonest among letters)
on all rows labelled quality 1: the least characters per token and the least entropy at a low quantile, the most
byte tokens a margin above a high one. Quantiles are exact and no task or driver holds a group's values. A row without a language has those of its script over all
languages. What has too few labels, and the most characters per token, come from BANDS.

Null text: no words, all counts 0, and base_failed, as every text under 50 words. Extra columns are
ignored; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan as SC
from ..sources.tables import lease
from .bpe import vocabulary
from .common import Workspace, read
from .texts import SPACE, arrow_batches, batch_of, codes, column, model, release, slices, sum_by, twins, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Script -> least and most characters per token, most share of byte tokens, least share of entropy.
#: Wide on purpose, for what no label speaks of: a clean text of any register lies well inside them.
BANDS = {
    "latin": (1.15, 9.0, 0.20, 0.5),
    "greek": (0.4, 6.0, 0.90, 0.4),
    "cyrillic": (0.5, 7.0, 0.50, 0.4),
    "arabic": (0.4, 5.0, 0.70, 0.4),
    "cjk": (0.25, 3.0, 0.95, 0.4),
    "other": (0.2, 9.0, 1.0, 0.3),
    "none": (0.6, 9.0, 0.50, 0.2),
}
SCRIPTS = list(BANDS)
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: The quantile of labelled rows that a bound may cost, and the least rows for a bound.
QUANTILE, LEAST = 0.005, 30
#: How far over the high quantile the share of byte tokens may go.
MARGIN = 0.02
MEMO, MEMO_BYTES = 300_000, 48
#: Labelled ids that go to every task, at most; with more, all rows are measured and joined then.
BROADCAST_IDS = 1_000_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = ("n_tokens", "byte_tokens", "entropy")

#: The script of a letter by the first byte of its UTF-8 form; 6 is no letter, 7 a later byte.
_FIRST = np.full(256, 4)
_FIRST[:0x80] = 6
_FIRST[[*range(65, 91), *range(97, 123)]] = 0
_FIRST[0x80:0xC0] = 7
_FIRST[0xC2] = 6
_FIRST[0xC3:0xCB] = 0
_FIRST[0xCD:0xD0] = 1
_FIRST[0xD0:0xD4] = 2
_FIRST[0xD8:0xDC] = 3
_FIRST[0xE2] = 6
_FIRST[0xE3:0xED] = 4
_FIRST[0xE0:0xE2] = 5
_FIRST[0xE3:0xED] = 4
_FIRST[0xED:0x100] = 5


class Fertility:
    """A vocabulary in one task, of sentencepiece (.model) or as ranks of byte strings (.tiktoken); each word counts
    as it does after a space."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes_ = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda words: [array.array("H", x).tobytes() for x in model.encode(words, num_threads=1)]
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes_ = np.zeros(max(ranks.values()) + 1, bool)
            self.bytes_[[i for token, i in ranks.items() if len(token) == 1 and token[0] >= 0x80]] = True
            first = np.zeros(len(self.bytes_), bool)
            first[[i for token, i in ranks.items() if token[:1] == b" "]] = True

            def encode(words: list[str]) -> list[bytes]:
                # all at once: a word begins with the only space of it, and so does its first token
                ids = np.array(model.encode_ordinary(" " + " ".join(words)), np.uint16)
                at = np.append(np.flatnonzero(first[ids]), len(ids))
                if len(at) != len(words) + 1:
                    return [array.array("H", model.encode_ordinary(" " + w)).tobytes() for w in words]
                raw = ids.tobytes()
                return [raw[a:b] for a, b in itertools.pairwise((at * 2).tolist())]

            self.encode = encode
        self.memo: dict[bytes, bytes] = {}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids (uint16) of different words."""
        memo = self.memo
        fresh = [w for w in words if w not in memo]
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = words
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            memo.update(zip(part, self.encode([w.decode("utf-8", "replace") for w in part]), strict=True))
        out = [memo[w] for w in words]
        for w in fresh:
            if len(w) > MEMO_BYTES:
                del memo[w]
        return out


def fertility(paths: tuple[str, ...]) -> list[Fertility]:
    """Loaded once in each worker process."""
    return model(("fertility", paths), lambda: [Fertility(p) for p in paths])


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(off) - 1
    s, e, first = word_spans(data, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": sum_by((data & 0xC0) != 0x80, off) - sum_by(SPACE[data], off), "n_symbols": sum_by(SYMBOLS[data], off)}
    # lines: the bytes between \n, those with a word, less the different ones
    at = np.flatnonzero(data == 10)
    start = np.concatenate([off[:-1], at + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(off, at, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.concatenate([start[1:] - 1, off[-1:]])
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end[last] = off[owner[last] + 1]
    end = np.maximum(start, end)
    solid = np.searchsorted(s, end) > np.searchsorted(s, start)
    content = codes(data[data != 10], end - start)[0][solid]
    owner = owner[solid]
    _, at = np.unique(owner * (content.max(initial=0) + 1) + content, return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[at], minlength=n)
    # windows of three words within a text
    w = codes(data[~SPACE[data]], e - s)[0]
    covered = np.zeros(len(w), bool)
    if len(w) >= 3:
        i = np.flatnonzero(doc[2:] == doc[:-2])
        i = i[twins([doc[i], w[i], w[i + 1], w[i + 2]])]
        for k in range(3):
            covered[i + k] = True
    out["n_repeat_words"] = sum_by(covered, first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def script_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A place in SCRIPTS for each text."""
    kind = _FIRST[data]
    script = np.stack([sum_by(kind == k, off) for k in range(6)])
    return np.where(script.max(0, initial=0) > 0, script.argmax(0) if len(off) > 1 else 0, 6)


def measures(models: list[Fertility], data: np.ndarray, off: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Of each vocabulary: n_tokens, byte_tokens and entropy (of 1 for tokens that are all different; 1 for fewer
    than two) of each text. A slice's different words are encoded once."""
    n, out = len(off) - 1, []
    s, e, first = word_spans(data, off)
    which, words = codes(data[~SPACE[data]], e - s)
    words = words.to_pylist()
    for model in models:
        ids = model.ids(words)
        size = np.array([len(x) // 2 for x in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        each = size[which]  # tokens of every word, then of every token the place among the different words' tokens
        upto = np.concatenate([[0], np.cumsum(each)])
        count = np.diff(upto[first])
        flat = np.frombuffer(b"".join(ids), np.uint16)[np.repeat(begin[which] - upto[:-1], each) + np.arange(upto[-1])].astype(np.int64)
        doc = np.repeat(np.arange(n), count)
        key, times = np.unique(doc << 16 | flat, return_counts=True)
        owner, total = key >> 16, np.maximum(count, 1)
        p = times / total[owner]
        bits = -np.bincount(owner, p * np.log2(p), minlength=n) + 0.0
        out.append({"n_tokens": count, "byte_tokens": sum_by(model.bytes_[flat], upto[first]), "entropy": np.where(count > 1, bits / np.log2(np.maximum(count, 2)), 1.0)})
    return out


def verdict(chars: np.ndarray, script: np.ndarray, ms: list[dict[str, np.ndarray]], langs: list, bands: dict) -> np.ndarray:
    """Inside the bands of every vocabulary. langs: the language of each text or None; bands: what `learn` returns."""
    names = [SCRIPTS[k] for k in script]
    out = np.ones(len(chars), bool)
    for v, m in enumerate(ms):
        low, high, share, even = (np.array([BANDS[k][i] for k in SCRIPTS])[script] for i in range(4))
        for i, key in enumerate(zip(langs, names, strict=True)):
            if (v, *key) in bands:
                low[i], share[i], even[i] = bands[v, *key]
        tokens = np.maximum(m["n_tokens"], 1)
        per = chars / tokens
        out &= (per >= low) & (per <= high) & (m["byte_tokens"] / tokens <= share) & (m["entropy"] >= even)
    return out


def _judged(batch: pa.RecordBatch, paths: tuple[str, ...], bands: dict):
    """(first row, last, counts, script, measures of each vocabulary, base_failed, kept) of the slices of a batch."""
    data, off, _ = column(batch, "text")
    at = batch.schema.get_field_index("lang")
    langs = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
    for lo, hi in slices(off):
        o = off[lo : hi + 1]
        part, o = data[o[0] : o[-1]], o - o[0]
        c, script, ms = base_counts(part, o), script_of(part, o), measures(fertility(paths), part, o)
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        yield lo, hi, c, script, ms, failed, ~failed & verdict(c["word_chars"], script, ms, langs[lo:hi], bands)


def paths_of(names: tuple[str, ...] = VOCABULARIES) -> tuple[str, ...]:
    return tuple(vocabulary(n) for n in names)


def measured(df: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, an array of each measure with a number for each vocabulary, and
    script; of every row."""
    lang = F.col("lang") if "lang" in df.columns else F.lit(None)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.cast("string").alias("lang"))
    arrow_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            keys, langs = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "lang"))
            for lo, hi, c, script, ms, failed, _ in _judged(batch, paths, {}):
                arrays = {k: pa.FixedSizeListArray.from_arrays(pa.array(np.stack([m[k] for m in ms], 1).ravel()), len(ms)) for k in _MEASURES}
                arrays = {k: a.cast(pa.list_(a.type.value_type)) for k, a in arrays.items()}
                yield batch_of(doc_id=keys[lo:hi], lang=langs[lo:hi].cast(pa.string()), **c, base_failed=failed, **arrays, script=pa.array([SCRIPTS[k] for k in script], pa.string()))
        release()

    counts = ", ".join(f"{k} long" for k in _COUNTS)
    return rows.mapInArrow(run, f"doc_id long, lang string, {counts}, base_failed boolean, n_tokens array<long>, byte_tokens array<long>, entropy array<double>, script string")


def judged(rows: DataFrame, bands: dict | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the measures and script of what `measured` returns. bands: see
    `learn`; BANDS alone without."""
    bands = bands or {}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            values = {k: of[k].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in _MEASURES}
            ms = [{k: x[:, v] for k, x in values.items()} for v in range(values["n_tokens"].shape[1])]
            script = np.array([SCRIPTS.index(k) for k in of["script"].to_pylist()])
            failed = of["base_failed"].to_numpy(zero_copy_only=False)
            kept = ~failed & verdict(of["word_chars"].to_numpy(), script, ms, of["lang"].to_pylist(), bands)
            yield batch_of(doc_id=of["doc_id"], **{k: of[k] for k in (*_COUNTS, "base_failed")}, kept=kept, **{k: of[k] for k in (*_MEASURES, "script")})

    counts = ", ".join(f"{k} long" for k in _COUNTS)
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, n_tokens array<long>, byte_tokens array<long>, entropy array<double>, script string")


def score(df: DataFrame, paths: tuple[str, ...], bands: dict | None = None) -> DataFrame:
    """`judged` of what df holds."""
    return judged(measured(df, paths), bands)


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def bands_of(ws: Workspace, found: DataFrame, labels: DataFrame) -> dict:
    """`learn` on a table that `measured` made."""
    rows = found.where("NOT base_failed").join(_good(labels), "doc_id", "left_semi")
    per = F.transform("n_tokens", lambda n: F.col("word_chars") / F.greatest(n, F.lit(1)))
    share = F.zip_with("byte_tokens", "n_tokens", lambda b, n: b / F.greatest(n, F.lit(1)))
    # a row counts for its language and for its script over all languages, which has no name
    of = F.array_compact(F.array(F.struct(F.lit(False).alias("own"), F.lit("").alias("lang")), F.when(F.col("lang").isNotNull(), F.struct(F.lit(True).alias("own"), "lang"))))
    x = rows.select("script", F.explode(of).alias("of"), F.array(per, share, "entropy").alias("m")).select("script", "of.*", F.posexplode("m").alias("what", "m"))
    x = ws.table(x.select("script", "own", "lang", "what", F.posexplode("m").alias("vocabulary", "x")), "values")
    with lease(found.sparkSession):
        groups = SC.quantiles(x, "x", [QUANTILE, 1 - QUANTILE], ["script", "own", "lang", "what", "vocabulary"]).where(F.col("n") >= LEAST).collect()
    ws.drop("values")
    q = {(r["vocabulary"], r["lang"] if r["own"] else None, r["script"], r["what"]): r["q"] for r in groups}
    return {(v, lang, script): (low, q[v, lang, script, 1][1] + MARGIN, q[v, lang, script, 2][0]) for (v, lang, script, k), (low, _) in q.items() if k == 0}


def learn(df: DataFrame, labels: DataFrame, paths: tuple[str, ...]) -> dict:
    """(vocabulary, language, script) -> least characters per token, most byte tokens, least entropy; the language
    None: over all of a script. From every row labelled quality 1 that the base rule doesn't reject; a row for each
    group and vocabulary comes to the driver. labels: doc_id, quality."""
    ws, good = Workspace(df.sparkSession, "quality-bands"), _good(labels)
    if good.count() <= BROADCAST_IDS:
        same = df["doc_id"].cast("long") == good["doc_id"]
        df = df.join(F.broadcast(good), same, "left_semi")
    bands = bands_of(ws, ws.table(measured(df, paths), "measured"), labels)
    ws.close()
    return bands


def filter_quality(df: DataFrame, paths: tuple[str, ...], bands: dict | None = None) -> DataFrame:
    """The rows of documents that pass, unchanged; rows are judged where they lie, without a join."""
    schema = df.schema
    # columns go by place, so that no name can clash
    placed = [F.col(f"`{c}`").alias(c if c in ("text", "lang") else f"c{i}") for i, c in enumerate(schema.names)]
    arrow_batches(df.sparkSession)
    bands = bands or {}

    def run(batches):
        for batch in batches:
            for lo, hi, _, _, _, _, kept in _judged(batch, paths, bands):
                part = batch.slice(lo, hi - lo).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays(part.columns, names=schema.names)
        for f in fertility(paths):  # the worker goes on to the next stages
            f.memo.clear()
        release()

    return df.select(*placed).mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "quality")
    found = ws.table(measured(read(spark, sf_dir, "documents"), paths_of()), "measured")
    out = judged(found, bands_of(ws, found, read(spark, sf_dir, "labels")))
    return out.withColumn("entropy", F.transform("entropy", lambda x: F.round(x, 6)))


QUERIES = {"op10_quality": op10_quality}
