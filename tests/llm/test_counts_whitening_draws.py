"""Token counts, whitening and importance resampling against brute force; odd rows of the other operators."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, embeddings, html_text, importance, lang_id, mixing, quality, token_counts, url_filter, whitening
from tidepanel.llm.common import Workspace

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_tokens int, n_words string, score int, `rank` string"
ALPHABET = [*"abstremdlv'' ..,!<|>0129\n\t", "é", "É", "ß", "×", "÷", "́", "中", " ", "Σ", "İ", "'s", "'re", "'ve", "'ll", "<|endoftext|>", "ﬁ", "\x1c", "\x85", "𝔸", "ǅ"]
ODD = [None, "", " ", "don't 'street 's's ''s x's9 9's a.'s they're", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "x" * 50_000, "'s" * 999, "'" * 999, "12345 6٣Ⅷ", "same text here", "same text here"]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 1, "n", 2, "r") for i, t in enumerate(texts)], DOCS)


# ---- token counts ---------------------------------------------------------------------------------


def test_proven_strings_are_one_token():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    proven = token_counts.prove(bpe.vocabulary())
    vocabulary = t.get_vocab()
    ends = {k for k in vocabulary if k.endswith("</w>")}
    assert 0.9 * len(ends) < len(proven) <= len(ends)
    for raw in random.Random(1).sample(proven, 3000):
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))
        if len(pieces) == 1 and t.normalizer.normalize_str(word) == word:
            assert len(t.encode(word, add_special_tokens=False).ids) == 1, word


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(bpe.vocabulary()), random.Random(2)
    texts = ODD + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    got = {r.doc_id: r for r in token_counts.counts(docs_of(spark, texts), bpe.vocabulary(), 50).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 50), x
    assert token_counts.counts(docs_of(spark, ODD, [7] * len(ODD)), bpe.vocabulary()).count() == len(ODD)
    assert token_counts.counts(docs_of(spark, ["a"], [None]), bpe.vocabulary()).first()[:3] == (None, 1, 1)
    assert token_counts.counts(docs_of(spark, ["a"]).limit(0), bpe.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        token_counts.prove(bpe.vocabulary("byte_bpe_50k.json"))


def test_token_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    want = {(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in token_counts.op11_tokens(spark, SF).collect()} == want


# ---- whitening ----------------------------------------------------------------------------------


def _whitened(rows):
    """(key, x) of usable rows, n, S, eigenvalues, components, by numpy's symmetric eigenvalues."""
    x = [(k, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for k, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(0)
    a = (n * fit - s) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    return x, n, s, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("driver,block", [(64, 4096), (1, 7)])
def test_whitening(spark, driver, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(5, list(map(float, v[7]))), (None, list(map(float, v[0])))]
    odd = [(1000, None), (1001, [float("nan")] * 20), (1002, [None] + [1.0] * 19), (1003, [1.0] * 3), (1004, []), (1005, [float("inf")] + [0.0] * 19)]
    df = spark.createDataFrame([(k, x, 1, "c") for k, x in rows + odd], "vec_id long, embedding array<double>, n int, component string").repartition(11)
    got = whitening.whiten(Workspace(spark, "t"), df, driver=driver).collect()
    x, n, s, e, u = _whitened(rows)
    assert len(got) == 16 * len(rows) and n == 300 and {r.n for r in got} == {300} and {r.identity_error < 1e-9 for r in got} == {True}
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(16):
        sign = None
        for k, vec in x:
            want, r = float((vec - s / n) @ u[:, c] / math.sqrt(e[c])), seen[k, c + 1]
            sign = sign or math.copysign(1, want * r[0].whitened)
            assert min(abs(sign * want - y.whitened) for y in r) < 1e-7
            assert int(((n * vec - s) ** 2).sum()) in {y.deviation for y in r} and all(abs(y.explained - e[c] / e.sum()) < 1e-9 for y in r)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.whiten(Workspace(spark, "t"), make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one} == {(k, c, 1, 0, None, None) for k in (1, 2) for c in (1, 2)}
    flat = whitening.whiten(Workspace(spark, "t"), make([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [3.0, 5.0])])).collect()
    assert {r.component: r.explained for r in flat} == {1: 1.0, 2: 0.0} and all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = whitening.whiten(Workspace(spark, "t"), make([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 1.0])])).collect()
    assert {r.vec_id for r in huge if r.deviation is None} == {1, 2, 3} and all(r.whitened is None if r.component == 2 else np.isfinite(r.whitened) for r in huge)
    assert whitening.whiten(Workspace(spark, "t"), make([(1, None)])).count() == 0 == whitening.whiten(Workspace(spark, "t"), make([])).count()


def test_jacobi_keeps_small_lengths():
    """Columns of very different scale: lengths hold to the last digits, as those of the squared matrix don't."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    want = 10.0 ** -np.arange(9)
    length, v = whitening.jacobi(np.linalg.qr(rng.normal(size=(9, 9)))[0] * want @ q)
    assert np.allclose(length, want, rtol=1e-7) and np.allclose(v.T @ v, np.eye(9), atol=1e-12)


# ---- importance resampling ---------------------------------------------------------------------------

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(x):
    w = _WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (x or "").encode()))
    return w, w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]


def _drawn(docs, target, buckets=10_000):
    s, t, rows = [0] * buckets, [0] * buckets, []
    for k, x in docs:
        w, f = _features(x)
        at = [zlib.crc32(y) % buckets for y in f]
        rows.append((k, len(w), at))
        for b in at:
            s[b] += 1
    for x in target:
        for y in _features(x)[1]:
            t[zlib.crc32(y) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for k, n, at in rows:
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    place = {r[0]: i + 1 for i, r in enumerate(order[: 25 * len(order) // 100])}
    return {(k, f, w, score, place.get(k)) for k, _, f, w, score in out}


@pytest.mark.parametrize("slice_", [1 << 20, 400])
def test_importance(spark, slice_, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_)
    monkeypatch.setattr(importance, "BLOCK", 64)
    rng = random.Random(4)
    words = ["one", "Two", "três", "4", "x" * 70, "y" * 200, "!", "ÄB", "-"]
    texts = [None, "", "-", "x" * 3000, *(" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(120))]
    ids = [*range(len(texts) - 1), None]
    got = importance.resample(Workspace(spark, "t"), docs_of(spark, texts, ids), spark.createDataFrame([(1, "two one ÄB"), (2, None)], "item_id long, text string")).collect()
    want = _drawn(list(zip(ids, texts, strict=True)), ["two one ÄB", None])
    assert {tuple(r) for r in got} == want and sum(r[4] is not None for r in want) > 20


def test_importance_query_and_odd_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in importance.op13_importance(spark, SF).collect()} == _drawn(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(Workspace(spark, "t"), docs_of(spark, ["a"]).limit(0), none).count() == 0
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    same = importance.resample(Workspace(spark, "t"), docs_of(spark, [text] * 8, [3] * 8), none).collect()
    assert len(same) == 8 and len({r[:4] for r in map(tuple, same)}) == 1 and sorted(r["rank"] or 99 for r in same) == [1, 2] + [99] * 6


def test_pair_hashes():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (bytes(rng.choices(range(256), k=rng.randint(1, 60))) for _ in range(2))
        one = lambda x: np.array([x], np.uint32)
        assert int(importance.pair_hashes(one(zlib.crc32(a)), one(zlib.crc32(b)), np.array([len(b)]))[0]) == zlib.crc32(a + b)


# ---- odd rows of the others ----------------------------------------------------------------------------


def test_vectors_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 8)), base[:10]])
    ids = [i if i % 7 else None for i in range(len(v))]
    ids[3] = ids[40] = 5
    rows = [(ids[i], list(map(float, x)), 1, "a") for i, x in enumerate(v)] + [(5, None, 1, "b"), (None, [0.0] * 8, 2, "c"), (7, [1.0, None] + [0.0] * 6, 3, "d")]
    got = embeddings.near_vectors(Workspace(spark, "t"), spark.createDataFrame(rows, "vec_id long, embedding array<double>, `row` int, component_id string")).collect()
    y = v / np.linalg.norm(v, axis=1, keepdims=True)
    g, low = y @ y.T >= 0.9, list(range(len(v)))
    for _ in low:
        for a, b in zip(*np.nonzero(g), strict=True):
            low[a] = low[b] = min(low[a], low[b])
    want = []
    for i in range(len(v)):
        c = min((ids[j] for j in range(len(v)) if low[j] == low[i] and ids[j] is not None), default=None)
        want.append((ids[i], int(g[i].sum()) - 1, c, ids[i] == c))
    want += [(5, 0, 5, True), (None, 0, None, True), (7, 0, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables_and_clashing_names(spark):
    pages = "page_id long, url string, html string, text int, n_chars string, host int, path int, rule int, verdict int"
    page = spark.createDataFrame([(1, "http://a.net/es/x", "<article><p>A b c.</p></article>", 1, "n", 1, 2, 3, 4)], pages)
    assert html_text.extract(page).first()[2:] == ("A b c.", 6) and html_text.extract(page.limit(0)).count() == 0
    assert url_filter.judge(Workspace(spark, "t"), page).first()[1:] == ("a.net", "/es/x", "net/es/", "block")
    assert url_filter.judge(Workspace(spark, "t"), page.limit(0)).count() == 0
    assert quality.score(docs_of(spark, ["a"]).limit(0), quality.paths_of()).count() == 0
    one = quality.score(docs_of(spark, [None, "a b"]), quality.paths_of()).orderBy("doc_id").collect()
    assert [(r.n_words, r.base_failed, r.kept, r.n_tokens) for r in one] == [(0, True, False, [0, 0]), (2, True, False, [2, 2])]


def test_mixing_stage_against_brute_force(spark):
    """Budgets down the tree, prefixes by hash: the mixing stage of the pipeline, row by row."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.lang or "", r.source or "", len(re.findall("[^ \t\n\x0b\f\r]+", r.text or ""))) for r in docs.collect()]
    mix = P.MIX

    def domain(source):
        m = re.search("([0-9]{1,9})$", source)
        return f"domain{int(m[1]) % 4}" if m else "other"

    leaves = {}
    for _, lang, source, n in rows:
        key = (domain(source), lang, source)
        leaves[key] = leaves.get(key, 0) + n

    def share(budget, children):
        """name -> given, of name -> (weight, capacity)."""
        given, open_ = dict.fromkeys(children, 0.0), {k for k, (w, _) in children.items() if w > 0}
        left = budget
        while open_:
            total = sum(children[k][0] for k in open_)
            full = {k for k in open_ if children[k][1] * total <= left * children[k][0] + 1e-12}
            if not full:
                given.update({k: left * children[k][0] / total for k in open_})
                break
            for k in full:
                given[k] = children[k][1]
            left, open_ = left - sum(children[k][1] for k in full), open_ - full
        return given

    cap = lambda keys: sum(leaves[k] * mix.max_epochs for k in keys)
    doms = {d: (mix.domains.get(d, mixing.OTHER), cap([k for k in leaves if k[0] == d])) for d in {k[0] for k in leaves}}
    chosen = set()
    for d, budget in share(min(mix.share * sum(leaves.values()), cap(leaves)), doms).items():
        langs = {x: (mix.languages.get(x, mixing.OTHER), cap([k for k in leaves if k[:2] == (d, x)])) for x in {k[1] for k in leaves if k[0] == d}}
        for x, of_lang in share(budget, langs).items():
            own = {k: (1.0, leaves[k] * mix.max_epochs) for k in leaves if k[:2] == (d, x)}
            for k, of_leaf in share(of_lang, own).items():
                epochs, rest = divmod(math.floor(of_leaf + 1e-6), leaves[k]) if leaves[k] else (0, 0)
                members = [r for r in rows if (domain(r[2]), r[1], r[2]) == k]
                if epochs:
                    chosen |= {r[0] for r in members}
                    continue
                upto = 0
                for r in sorted(members, key=lambda r: hashlib.md5(f"{mix.seed}-{epochs}-{r[0]}".encode()).hexdigest()):
                    upto += r[3]
                    if upto <= rest:
                        chosen.add(r[0])
    got = [r.doc_id for r in P.mixing_stage(spark, docs, SF).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == chosen and 0 < len(got) < len(rows)


def test_language_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(lang_id.op6_language(spark, SF).columns) >= {"doc_id", "held_out", "lang_pred", "score"}
    assert docs.where(F.col("lang").isNotNull()).count() > 0
