"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, common, embeddings, html_text, lang_id, mixing, near_dup, quality, repeats, store, url_filter
from tidepanel.llm.common import Workspace

from .pages_by_hand import PAGES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["x's ''s don't I'LL a1b22c <|endoftext|>x <|StartOfText|> é́ ΑΣ ☃ b\x85c\x1cd 'RE ''re hi,yo...!!  \n\t", "", None, "a" * 3000, "123'd'4've", "İstanbul ﬁ ǅ", "a\x00b\x01c\x7f1", "a'́s 1́,́a ́b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h int, k string, n long"


def table(spark, texts):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, ["en", None, "de"][i % 3], [None, "src0", "src1"][i % 3], 0, 1, "k", 2) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    p = "".join(rng.choice("ab cd") for _ in range(900))
    words = [f"w{i}" for i in range(120)]
    near = [" ".join(words), " ".join(words[:-3] + ["x"]), " ".join(words[:60] * 2), " ".join(words)]
    return [*own, *ODD, "x" * 1000, "z" * 400, "z" * 400 + "q", "ab" * 600, p[:500] + "1", "2" + p[100:700], p[300:] + "3" + p[250:650], p[:420] * 2, "é" * 300, "é" * 250 + "a", *near, "one", "one", "two words"]


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    got = {r.doc_id: r for r in bpe.digests(table(spark, texts), bpe.vocabulary()).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(table(spark, texts), bpe.vocabulary()).collect()}
    both = {r.doc_id: r for r in bpe.round_trip(table(spark, texts), bpe.vocabulary()).collect()}
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == e and got[i].n_tokens == len(e), x
        assert (both[i].n_tokens, both[i].ids, both[i].decoded) == (len(e), e, t.decode(e, skip_special_tokens=False)), x
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(table(spark, ["a"]).limit(0), bpe.vocabulary()).count() == 0


def test_store(spark, texts):
    enc, ws = bpe.encoder(bpe.vocabulary()), Workspace(spark, "t")
    chunks, recipes, manifest = store.write_store(ws, table(spark, texts), bpe.vocabulary())
    got = {r.doc_id: r for r in store.verify(chunks, recipes, manifest, 2).collect()}
    back = {r.doc_id: r.ids for r in store.restore(chunks, recipes, 2).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = enc.tokenizer.encode(x or "", add_special_tokens=False).ids + [1]
        assert back[i] == ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(r.tokens for r in manifest.collect()) == start
    assert chunks.count() == chunks.select("digest").distinct().count()
    shorter = F.transform("sizes", lambda n: n - 1)
    tampered = [
        (chunks.withColumn("ids", chunks["ids"].substr(1, 2)), recipes, manifest),
        (chunks.withColumn("n", F.col("n") + 1), recipes, manifest),
        (chunks.where("n < 4096").limit(5), recipes, manifest),
        (chunks, recipes.withColumn("sizes", shorter), manifest),
        (chunks, recipes.withColumn("chunks", F.reverse("chunks")), manifest),
        (chunks, recipes.withColumn("n_tokens", F.col("n_tokens") + 1), manifest),
        (chunks, recipes.where("doc_id <> 3"), manifest),
        (chunks, recipes.union(recipes.where("doc_id = 3")), manifest),
        (chunks, recipes, manifest.withColumn("docs", F.col("docs") + 1)),
        (chunks, recipes, manifest.where("part > 0")),
    ]
    for bad in tampered:
        with pytest.raises(Exception, match="differ|missing"):
            store.verify(*bad, 2).collect()
    none = store.write_store(Workspace(spark, "t"), table(spark, ["a"]).limit(0), bpe.vocabulary())
    assert store.verify(*none, 2).count() == 0
    twice = store.write_store(Workspace(spark, "t"), table(spark, ["a b", "c"]).withColumn("doc_id", F.lit(None).cast("long")), bpe.vocabulary())
    assert [(r.doc_id, r.start) for r in store.verify(*twice, 2).orderBy("start").collect()] == [(None, 0), (None, twice[1].orderBy("root").first().n_tokens)]


def test_quality(spark, texts):
    path = quality.paths_of()
    got = {r.doc_id: r for r in quality.score(table(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        w, seen, dup, cov = WORD.findall(x), set(), 0, set()
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cov |= {k, k + 1, k + 2}
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cov))
        assert g.base_failed == (len(w) < 50 or 100 * len(cov) > 50 * len(w)) and g.kept <= (not g.base_failed)
    kept = quality.filter_quality(table(spark, texts), path)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept} and kept.columns == table(spark, ["a"]).columns


def test_quality_bands(spark):
    """Bands from half of the labels, held against the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    path = quality.paths_of()
    bands = quality.learn(docs, labels.where("xxhash64(doc_id, 1) % 2 = 0"), path)
    assert set(bands) == {(v, k, "latin") for v in (0, 1) for k in (None, "en", "de", "fr", "es")}
    held = labels.where("xxhash64(doc_id, 1) % 2 <> 0").join(docs, "doc_id")
    share = {}
    for name, df in (("lang", held), ("script", held.drop("lang"))):
        rows = quality.score(df, path, bands).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("gone"))
        share[name] = {r.quality: r.gone for r in rows.collect()}
    # two vocabularies with three bounds, each of which may cost QUANTILE
    assert share["lang"][0] > 0.8 and share["lang"][1] < 6 * quality.QUANTILE
    assert share["script"][0] > 0.5 and share["script"][1] < 6 * quality.QUANTILE


def test_quality_bands_of_all_rows(spark):
    """4,500 labelled rows, of one language and of none: the quantiles are those of every row, repeated ids too."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = [(i // 2 if i < 10 else i, " ".join(rng.choices(words, k=60)), "en" if i % 3 else None) for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    path = quality.paths_of()
    bands = quality.learn(docs, labels, path)
    x = quality.measured(docs, path).where("NOT base_failed").toPandas()
    assert len(x) == 4500 and set(bands) == {(v, k, "latin") for v in (0, 1) for k in (None, "en")}
    for (v, lang, _), band in bands.items():
        y = x[x.lang == lang] if lang else x
        n = np.array([t[v] for t in y.n_tokens])
        want = (np.quantile(y.word_chars / n, quality.QUANTILE), np.quantile([t[v] for t in y.byte_tokens] / n, 1 - quality.QUANTILE) + quality.MARGIN, np.quantile([t[v] for t in y.entropy], quality.QUANTILE))
        assert np.allclose(band, want, atol=1e-12, rtol=0)


def _components(n, links):
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("few,key", [(16, 1000), (1, 1)])
def test_near_dup(spark, texts, few, key, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "KEY_ROWS", key)
    monkeypatch.setattr(common, "KEY_ROWS", key)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    many = [" ".join(w if rng.random() > 0.06 else f"r{rng.random()}" for w in base) for _ in range(25)]
    texts = [*texts, *many]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for x in texts:
        w = WORD.findall((x or "").translate(low))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _components(len(sets), links)
    got = {r.doc_id: r for r in near_dup.near_duplicates(Workspace(spark, "t"), table(spark, texts).select("doc_id", "text"), 2, 80).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(sets))] == [(len(s), want[i], want[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("length,chunk,key,sort", [(400, 8192, 1000, 200_000), (120, 8192, 1000, 50), (120, 1, 1, 200_000)])
def test_repeats(spark, texts, length, chunk, key, sort, monkeypatch):
    """chunk 1: every block a chunk of its own; key 1: every key a hot one; sort 50: an offset at a time."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "SORT", sort)
    monkeypatch.setattr(common, "KEY_ROWS", key)
    raw = [(t or "").encode() for t in texts]
    c = collections.Counter(b[j : j + length] for b in raw for j in range(len(b) - length + 1))
    got = {r.doc_id: r for r in repeats.digests(Workspace(spark, "t"), table(spark, texts), length).collect()}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if c[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()), i


def test_repeats_shuffle_few_rows(spark, texts, monkeypatch):
    """Texts without a repeat aren't dealt anew to be cut, unless more than BROADCAST_IDS have one; blocks that share no anchor
    are left out before a shuffle; the results are the same."""
    docs = table(spark, texts)
    out = repeats.digests(Workspace(spark, "t"), docs, 120)
    assert "LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString() and out.where("n_removed > 0").count() > 0
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    whole = repeats.digests(Workspace(spark, "t"), docs, 120)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    ws = Workspace(spark, "t")
    rows, keys = ws.table(spark.range(100_000).selectExpr("id * 7 AS h", "id", "cast(id AS string) s"), "rows"), ws.table(spark.range(50).selectExpr("id AS h", "id + 2 AS n"), "keys")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with common.bloom_joins(spark):
            spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
            joined = rows.join(keys.where("n > 1"), "h", "left_semi")
            assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(r.h for r in joined.collect()) == list(range(0, 50, 7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("size", [399, 400, 650])
def test_op1_planted_passages(spark, tmp_path, size):
    """A passage of over 50 words goes from both texts if it has 400 bytes; n_bytes is the input's length either way."""
    rng = random.Random(size)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n // 6 + 1))[:n]
    passage = prose(size)
    assert len(passage.split()) > 50
    rows = [(i, f"{prose(900)} {i}{passage}{i + 4} {prose(700)}") for i in range(2)] + [(2, prose(2000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in repeats.op1_suffix(spark, str(tmp_path)).collect()}
    for i, t in rows:
        left = t.replace(passage, "") if size >= 400 else t
        removed = len(t) - len(left)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].text) == (len(t), removed, int(removed > 0), left), i
        assert got[i].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


@pytest.mark.parametrize("cell,side,split", [(4096, 2048, 9999), (40, 16, 9999), (40, 16, 20), (12, 5, 8)])
def test_vectors(spark, cell, side, split, monkeypatch):
    """In one cell, in cells, in cells that are cut again, and in small ones with small tiles."""
    monkeypatch.setattr(embeddings, "SPLIT", split)
    monkeypatch.setattr(embeddings, "LEVEL", 4)
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "SIDE", side)
    monkeypatch.setattr(embeddings, "SLICE", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 8)).astype(np.float32).astype(float)
    x[100:] = (x[:50] + rng.normal(size=(50, 8)) * 0.2).astype(np.float32)
    x[149], x[148] = x[0], 2 * x[0]
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = y @ y.T >= 0.9
    np.fill_diagonal(g, False)
    want = _components(150, list(zip(*np.nonzero(g), strict=True)))
    odd = [None, [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [1.0] * 3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = {r.vec_id: r for r in embeddings.near_vectors(Workspace(spark, "t"), df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(150)] == [(int(g[i].sum()), want[i]) for i in range(150)]
    assert all((got[1000 + i].n_links, got[1000 + i].kept) == (0, True) for i in range(5))
    assert embeddings.near_vectors(Workspace(spark, "t"), df.limit(0)).count() == 0


def test_vectors_by_a_plane():
    """Pairs over a plane count once, where the nearer end visits; ties too."""
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.normal(size=(400, 6)))
    x[200:] = embeddings.unit(x[:200] + rng.normal(size=(200, 6)) * 0.1)
    centres = embeddings.fit(x, 12)
    centres[1] = centres[0] * [-1, 1, 1, 1, 1, 1]
    x[0], x[1] = [0.1, *centres[0][1:]], [-0.1, *centres[0][1:]]  # mirrored by the plane between these two
    x = embeddings.unit(x)
    own, ids = (x @ centres.T).argmax(1), np.arange(400)
    seen = {}
    for c in range(12):
        a, b = np.flatnonzero(own == c), np.flatnonzero(own != c)
        if len(a):
            counts = embeddings.nearer(x[a], x[b], ids[a], ids[b], own[b], {o: centres[o] - centres[c] for o in range(12)})
            for i, j in embeddings.tile_links(x[a], x[b], 0.9):
                keep = counts(i, j)
                dist = (x[b][j] * (centres[own[b][j]] - centres[c])).sum(1) / np.linalg.norm(centres[own[b][j]] - centres[c], axis=1)
                assert (dist[keep] <= 0.2**0.5 / 2 + 1e-9).all()
                for p, q in zip(a[i[keep]].tolist(), b[j[keep]].tolist(), strict=True):
                    seen[min(p, q), max(p, q)] = seen.get((min(p, q), max(p, q)), 0) + 1
    g = x @ x.T >= 0.9
    want = {(p, q) for p, q in zip(*(z.tolist() for z in np.nonzero(g)), strict=True) if p < q and own[p] != own[q]}
    assert len(want) > 20 and set(seen) == want and set(seen.values()) == {1}


def test_html(spark):
    page = "<html><head><title>t</title><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>one\n  two <b>three<br>four</p><script>x='</p>'</script><p>Be.</article><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "<p>", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {1: ("A & B\none two three four\nBe.", 28), 2: ("", 0), 3: ("", 0)}
    # held-out pages; those without an article container are judged by word counts and link densities alone
    x, y = html_text.labelled(150, seed=99)
    kept, has = html_text.judge(html_text.grown(), x), x[:, html_text.FEATURES.index("page_has_article")]
    for some in (has == 0, has == 1):
        assert y[some & kept].mean() > 0.97 and kept[some & (y == 1)].mean() > 0.98


HAND = {
    "<body><ul><li><a href=a>Home</a><li><a href=b>News of the day</a></ul><h1>A title of it</h1><p>First words of a text that goes on for a while and then ends here.<p>And more of it, which says a little about the rest of the story.</p><div><a href=c>Imprint</a> | <a href=d>Terms of use</a></div>": ["A title of it", "First words of a text that goes on for a while and then ends here.", "And more of it, which says a little about the rest of the story."],
    "<main><h1>T</h1><p>Yes.</p></main><div><h3>Comments</h3><p>I have read all of this twice and I don't agree with a single word of what it says here.</p></div>": ["T", "Yes."],
    "<article><p>Short.</p></article><div class=x><p>What a reader says about it at some length, outside of the article that it speaks of.</p></div>": ["Short."],
    "<article><p>One</p><svg><path/></svg><svg/><p>two <script>if (a < b) '</p>'</script>three</p><noscript>no</noscript><iframe src=x/><p>four &lt;b&gt;&nbsp;5</article><script>never ends <p>x</p>": ["One", "two three", "four <b> 5"],
    "<article><p>a <b title='x > y'>b</b> < c<p>d <a href=\"u\">e</a> f g h</article>": ["a b < c", "d e f g h"],
    "<p": [],
    **{page: want for page, want in PAGES},
}


def test_html_by_hand():
    for page, want in HAND.items():
        assert html_text.main_text(page, html_text.grown()).split("\n") == (want or [""]), page


def test_html_is_linear():
    import time

    for bad in ("<a " * 350_000, '<a x="' * 180_000, "<svg>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<!-" * 300_000):
        began = time.process_time()
        html_text.main_text(bad, html_text.grown())
        assert time.process_time() - began < 5


def test_urls(spark):
    urls = {"http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "x://b.net/fr": ("b.net", "/fr", None, "allow"), "x://b.net/fr/": ("b.net", "/fr/", "net/fr/", "block"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://c.com?x=/": ("c.com", "", None, "allow"), "https://m.spam-farm.example.org/en/": ("m.spam-farm.example.org", "/en/", None, "block")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [tuple(r)[1:] for r in url_filter.judge(Workspace(spark, "t"), df).orderBy("page_id").collect()]
    assert got == list(urls.values())


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    mine = keys[::7]
    levels = url_filter.build(Workspace(spark, "t"), spark.createDataFrame([(k,) for k in keys], "key string"), mine)
    assert [k for k, ok in zip(keys, url_filter.listed(levels, keys), strict=True) if ok] == mine and len(levels) > 1


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = {r.doc_id: r.lang for r in docs.where("doc_id % 4 = 0").collect()}
    model = lang_id.train(docs.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in lang_id.identify(docs.where("doc_id % 4 = 0"), model).collect()}
    assert np.mean([got[i].lang_pred == k for i, k in out.items()]) > 0.98
    odd = {r.doc_id: r for r in lang_id.identify(table(spark, [None, "", "12 !?", "é"]), model).collect()}
    assert [odd[i].lang_pred == "und" and odd[i].score == 0 for i in range(4)] == [True, True, True, False]
    assert lang_id.train(docs.limit(0)) is None
    assert len({tuple(c) for c in lang_id.codewords(9).tolist()}) == 9


def test_language_query(spark, tmp_path):
    """held_out by crc32 of the id; a prediction depends on the text alone, and learning not on the rows held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    # other labels, sources and texts where the rows are held out
    other = docs.withColumn("source", F.lit("x")).withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    other.withColumn("text", F.when(out & (F.col("doc_id") % 3 == 0), F.lit(None)).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r.doc_id: r for r in lang_id.op6_language(spark, f"{tmp_path}/{k}").collect()} for k in "ab")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(a) == set(b) == set(truth)
    for i, r in a.items():
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert r.held_out == held and 0 <= r.score <= 1
        assert (b[i].lang_pred, b[i].score) == (("und", 0.0) if held and i % 3 == 0 else (r.lang_pred, r.score))
    held = [i for i in a if a[i].held_out and truth[i]]
    assert len(held) > 200 and np.mean([a[i].lang_pred == truth[i] for i in held]) > 0.98


def test_mixing(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {tuple(r) for r in mixing.op8_mixing(spark, SF).collect()}
    assert got == set(c.sql(mixing.SQL["op8_mixing"]).fetchall())
    rows = table(spark, [*("a b c", None, "d e") * 20])
    out = mixing.select_mix(Workspace(spark, "t"), rows, mixing.Mix(share=0.5, max_epochs=1))
    assert out.columns == rows.columns and 0 < out.count() < 60
    assert mixing.select_mix(Workspace(spark, "t"), rows.limit(0), mixing.Mix()).count() == 0


def _encoders():
    """(words -> ids, is a byte) of both vocabularies."""
    import base64

    import public_tokenizers
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    piece = SentencePieceProcessor(model_file=bpe.vocabulary("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = {i: b for b, i in ranks.items()}
    return [(piece.encode, piece.is_byte), (lambda w: multi.encode_ordinary(" " + w), lambda i: len(raw[i]) == 1 and raw[i][0] >= 0x80)]


def _measured(x, encode, is_byte):
    """Characters a token, share of byte tokens, entropy over the most that so many tokens can have."""
    words = re.findall("[^\x20\x09-\x0d]+", x)
    ids = [i for w in words for i in encode(w)]
    n = max(len(ids), 1)
    p = np.array(list(collections.Counter(ids).values())) / n
    return sum(map(len, words)) / n, sum(map(is_byte, ids)) / n, -(p * np.log2(p)).sum() / np.log2(n) if n > 1 else 1.0


def test_pipeline_quality(spark, texts):
    """The first stage against the base rule and the measures word by word, and the bands against the quantiles of
    the labelled rows; its verdict rejects texts that the base rule keeps."""
    import corpus_pipeline as P

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good, rows, groups = {r.doc_id for r in labels.where("quality = 1").collect()}, [], collections.defaultdict(list)
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(twice) <= 50 * len(w):
            rows.append((r.doc_id, r.lang, [_measured(r.text, *e) for e in _encoders_once()]))
            if r.doc_id in good:
                for key in {r.lang, None}:
                    groups[key].append(rows[-1][2])
    bands = quality.learn(docs, labels, quality.paths_of())
    for key, x in groups.items():
        if len(x) < quality.LEAST:
            assert (0, key, "latin") not in bands
            continue
        for v in (0, 1):
            m = np.array([y[v] for y in x])
            want = (np.quantile(m[:, 0], quality.QUANTILE), np.quantile(m[:, 1], 1 - quality.QUANTILE) + quality.MARGIN, np.quantile(m[:, 2], quality.QUANTILE))
            assert np.allclose(bands[v, key, "latin"], want, atol=1e-9)
    low, high, most, even = quality.BANDS["latin"]
    want = set()
    for doc_id, lang, ms in rows:
        fine = True
        for v, (per, share, entropy) in enumerate(ms):
            a, s, e = bands.get((v, lang, "latin"), (low, most, even))
            fine &= a <= per <= high and share <= s and entropy >= e
        if fine:
            want.add(doc_id)
    assert {r.doc_id for r in P.quality_stage(spark, docs, "/root/testdata/sf0.01").collect()} == want
    assert 0 < len(want) < len(rows)


_ENCODERS = []


def _encoders_once():
    if not _ENCODERS:
        _ENCODERS.extend(_encoders())
    return _ENCODERS


def test_pipeline_minhash(spark, texts):
    import corpus_pipeline as P

    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = [*texts, *(" ".join(w if rng.random() > 0.02 else f"r{rng.random()}" for w in base) for _ in range(25))]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for x in texts:
        w = WORD.findall((x or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = [i for i, k in enumerate(_components(len(sets), links)) if i == k]
    assert sorted(r.doc_id for r in P.minhash_stage(spark, table(spark, texts), SF).collect()) == want and len(want) < len(sets) - 10


def test_pipeline_suffix(spark, texts):
    """A character goes if all its bytes do; n_chars follows."""
    import corpus_pipeline as P

    n, raw = P.REPEAT_BYTES, [(t or "").encode() for t in texts]
    c = collections.Counter(b[j : j + n] for b in raw for j in range(len(b) - n + 1))
    got = {r.doc_id: r for r in P.suffix_stage(spark, table(spark, texts), SF).collect()}
    assert len(got) == len(texts)
    for i, b in enumerate(raw):
        gone, kept, at = bytearray(len(b)), "", 0
        for j in range(len(b) - n + 1):
            if c[b[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        for ch in texts[i] or "":
            size = len(ch.encode())
            kept += "" if all(gone[at : at + size]) else ch
            at += size
        assert (got[i].text or "") == kept and (got[i].text is None) == (texts[i] is None), i
        assert texts[i] is None or got[i].n_chars == len(kept)


def test_pipeline_mixing_and_tokens(spark, texts):
    """Mixing gives rows of its input, none twice, at most nine tenths of the tokens; the tokens are the library's."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = table(spark, texts)
    out = P.mixing_stage(spark, docs, SF)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 0 < len(ids) == len(set(ids)) <= len(texts)
    size = docs.select("doc_id", mixing.tokens_of(F.col("text")).alias("n")).toPandas().set_index("doc_id").n
    assert size[ids].sum() <= 0.9 * size.sum()
    t = Tokenizer.from_file(bpe.vocabulary())
    for r in P.bpe_stage(spark, docs, SF).collect():
        e = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(e), e, t.decode(e, skip_special_tokens=False))


def test_pipeline(spark, texts):
    """A stage's rows are the next one's."""
    import corpus_pipeline as P

    docs = table(spark, texts).drop("h", "k", "n")
    for _, stage in P.STAGES[:-1]:
        before = docs
        docs = Workspace(spark, "t").table(stage(spark, docs, SF), "x")
        assert docs.columns == before.columns and docs.count() <= before.count()
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


NAMES = "doc_id long, text string, lang string, source string, `a.b` int, _id long, _spans int, row long, doc string, spans int, key string, component long, h long, c1 int, `text.x` string"


def _odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", 1, 2, 3, 4, "5", 6, "7", 8, 9, 10, "11") for i, t in rows], NAMES)


def test_stages_keep_columns_and_repeated_rows(spark):
    """Names that clash with the operators' own or hold dots, repeated and missing ids, empty tables."""
    import corpus_pipeline as P

    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    a, shared = words(120), words(60)
    rows = [(1, a), (1, a), (1, words(80) + shared), (None, words(90) + shared), (None, None), (2, ""), (3, a + " more words"), (None, a), (4, "short")]
    for name, stage in P.STAGES[:-1]:
        df = _odd(spark, rows)
        out = stage(spark, df, SF)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        got = out.collect()
        assert all(tuple(r)[2:] == tuple(_odd(spark, rows[:1]).first())[2:] for r in got), name
        if name == "minhash":  # one of the copies and near copies of a; the rest
            assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(1, a), *rows[2:6], rows[8]])
        if name == "suffix":  # copies lose all in every row; what two rows share goes from both, with a null id too
            left = {(r.doc_id, i): r.text for i, r in enumerate(got)}
            assert sum(r.text == "" for r in got) == 4 and not any(shared in (r.text or "") for r in got) and sum(r.text is None for r in got) == 1, left
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert P.STAGES[-1][1](spark, _odd(spark, []), SF).count() == 0


def test_repeated_and_missing_ids(spark):
    x, y = "".join(random.Random(9).choice("abcdef ") for _ in range(700)), "z" * 100
    df = spark.createDataFrame([(7, x + "1"), (7, y + x), (None, "2" + x), (None, y), (8, None)], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in repeats.digests(Workspace(spark, "t"), df, 400).collect()), key=str)
    assert got == sorted([(7, 701, 700, 1), (7, 800, 700, 1), (None, 701, 700, 1), (None, 100, 0, 0), (8, 0, 0, 0)], key=str)
    assert repeats.digests(Workspace(spark, "t"), df.limit(0), 400).count() == 0
    w = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, w), (5, w), (None, w + " x"), (None, "q r s"), (3, None), (5, "other words here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(Workspace(spark, "t"), df, 2, 80).collect()), key=str)
    assert got == sorted([(5, 39, 5, True), (5, 39, 5, True), (None, 40, 5, False), (None, 2, None, True), (3, 0, 3, True), (5, 2, 5, True)], key=str)
    assert near_dup.near_duplicates(Workspace(spark, "t"), df.limit(0), 2, 80).count() == 0


def test_equal_hashes_are_told_apart(spark):
    """Thue-Morse strings: polynomial hashes modulo 2^64 can't tell them from their complements."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    pair = [f"{t}\n{u}\n{t}", f"{t} x y", f"{u} x y"]
    got = {r.doc_id: r for r in quality.score(table(spark, pair), quality.paths_of()).collect()}
    assert got[0].n_dup_lines == 1
    comp = {r.doc_id: r.component_id for r in near_dup.near_duplicates(Workspace(spark, "t"), table(spark, pair), 5, 80).collect()}
    assert comp == {0: 0, 1: 1, 2: 2}


def test_registers_estimate_similarity():
    """Sets of any size agree in a register with the chance of their similarity."""
    rng = np.random.default_rng(1)
    for n in (3, 30, 300, 3000):
        same = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, n + n // 3, dtype=np.uint64)
            a, b = near_dup.registers([np.unique(x[:n]), np.unique(x[n // 3 :])])
            same.append((a == b).mean())
        want = (n - n // 3) / (n + n // 3)
        assert abs(np.mean(same) - want) < 0.02, n
