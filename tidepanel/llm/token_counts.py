"""Token counts by the whole-token shortcut.

`prove` runs the merges on every string of the vocabulary that ends a word, once, on the driver: those that
come out as one token are proven, as merging depends on nothing but the pre-token. In the texts, a pre-token
that is proven counts as one token by a look-up; only the others are merged, each different one once a slice
and a bounded number of them kept.

Pre-tokens are found by numpy where it is certain what the library's rules do: ASCII, and the letters of
Latin-1. A word (between ASCII white space, which no pre-token and no normal form crosses) with any other
character goes through the library's normaliser and pre-tokeniser, and its pre-tokens are looked up and merged
as all others; one that might hold a special token goes through the library as a whole.

Null or empty text: no tokens, 0 bytes. A text of any length is counted whole (its pre-tokens may be as long as
itself). Extra columns are ignored; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_alphabet, vocabulary
from .common import read
from .texts import LOWER, batch_of, codes, map_texts, model, sum_by, word_spans

#: Tokens of a document over which it is over the limit.
LIMIT = 2048
#: Pre-tokens and words whose counts a task keeps, and the bytes of the longest.
MEMO, MEMO_BYTES = 300_000, 64

#: The pattern of pre-tokens and the normal form that `spans` follows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def load(path: str):
    """(tokenizer, its file as a dict). Vocabularies with marks of a word's end only, with the pattern and
    normal form that this module knows."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules = spec["pre_tokenizer"].get("pretokenizers") or [{}]
    known = spec["model"].get("end_of_word_suffix") and (spec.get("normalizer") or {}).get("normalizers") == _NORMAL
    if not known or (rules[0].get("pattern") or {}).get("Regex") != _PATTERN or len(rules) != 2:
        raise ValueError("a vocabulary with marks of words' ends and the known pre-tokens is asked for")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer, spec


def prove(path: str) -> list[bytes]:
    """The pre-tokens that are one token: every vocabulary string with the mark of a word's end whose merges end
    in its own id and nothing else."""
    tokenizer, spec = load(path)
    suffix, alphabet, out = spec["model"]["end_of_word_suffix"], byte_alphabet(), []
    for token, number in spec["model"]["vocab"].items():
        shown = token.removesuffix(suffix)
        if token != shown and shown and all(c in alphabet for c in shown) and [t.id for t in tokenizer.model.tokenize(shown)] == [number]:
            out.append(bytes(alphabet[c] for c in shown))
    return out


class Counter:
    """One vocabulary in one task. proven: what `prove` found."""

    def __init__(self, path: str, proven: list[bytes]):
        self.tokenizer, spec = load(path)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.raw = byte_alphabet()
        self.whole, self.memo, self.words = frozenset(proven), {}, {}
        self.merged = 0

    def pre_token(self, raw: bytes) -> int:
        """Tokens of one pre-token (lower-cased UTF-8)."""
        if raw in self.whole:
            return 1
        n = self.memo.get(raw)
        if n is None:
            self.merged += 1
            n = len(self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.shown)))
            if len(raw) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[raw] = n
        return n

    def word(self, raw: bytes) -> int:
        """Tokens of a word that `spans` leaves to the library."""
        n = self.words.get(raw)
        if n is None:
            text = raw.decode("utf-8", "replace")
            if any(s in raw for s in self.special):
                n = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
                n = sum(self.pre_token(bytes(map(self.raw.__getitem__, p))) for p, _ in pieces)
            if len(raw) <= MEMO_BYTES:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[raw] = n
        return n

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        low, start, end, at, odd_start, odd_end, odd_at = spans(data, off)
        which, names = codes(_pick(low, start, end), end - start)
        each = np.fromiter(map(self.pre_token, names.to_pylist()), np.int64, len(names))
        n = np.bincount(at, each[which], len(off) - 1).astype(np.int64) if len(which) else np.zeros(len(off) - 1, np.int64)
        if len(odd_start):
            raw = data.tobytes()
            odd = np.fromiter((self.word(raw[a:b]) for a, b in zip(odd_start.tolist(), odd_end.tolist(), strict=True)), np.int64, len(odd_start))
            np.add.at(n, odd_at, odd)
        return n


def _pick(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other; spans are in order and apart."""
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return data[np.cumsum(edge[:-1]).astype(bool)]


def spans(data: np.ndarray, off: np.ndarray) -> tuple:
    """(lower-cased bytes, starts, ends and texts of pre-tokens, starts, ends and texts of the words left over)."""
    s, e, first = word_spans(data, off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    low, nothing = LOWER[data], np.zeros(0, np.int64)
    if not len(s):
        return low, nothing, nothing, nothing, s, e, owner
    # letters of Latin-1 are C3 and a byte from 80 to BF, but for the signs of times and division
    nxt = np.append(data[1:], 0)
    lead = (data == 0xC3) & (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    low[tail & (data < 0x9F)] += 0x20
    odd = (data >= 0x80) & ~lead & ~tail
    odd |= (data == 0x3C) & (nxt == 0x7C)  # <| may begin a special token
    left = (sum_by(odd, np.append(s, len(data))) > 0) if odd.any() else np.zeros(len(s), bool)
    # a pre-token begins where a word does, where the kind of byte changes, and at each digit
    kind = _KIND[low]
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin[s] = True
    begin[e] = True
    # 's 't 're 've 'm 'll 'd: an apostrophe that is a pre-token of its own takes these letters along
    lone = np.flatnonzero((low == 0x27) & begin[:-1] & begin[1:])
    lone = lone[lone + 1 < len(low)]
    lone = lone[~np.isin(lone + 1, e, assume_unique=True)]
    a, b = low[lone + 1], np.append(low, 0)[np.minimum(lone + 2, len(low))]
    inside = ~np.isin(lone + 2, e)
    two = inside & (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    begin[lone[one | two] + 1] = False
    begin[lone[one] + 2] = True
    begin[lone[two] + 3] = True
    edges = np.flatnonzero(begin)
    start, end = edges[:-1], edges[1:]
    word = np.searchsorted(s, start, "right") - 1
    keep = (start < e[word]) & ~left[word]
    return low, start[keep], end[keep], owner[word[keep]], s[left], e[left], owner[left]


def counts(df: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    spark = df.sparkSession
    proven = spark.sparkContext.broadcast(prove(path))  # at most the vocabulary

    def work(keys, data, off, null):
        counter = model(("counter", path), lambda: Counter(path, proven.value))
        n = counter.count(data, off)
        yield batch_of(**{key: keys, "n_bytes": np.diff(off), "n_tokens": n, "over_limit": n > limit})

    return map_texts(df, f"{key} {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean", work, (key, text))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return counts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), vocabulary())


QUERIES = {"op11_tokens": op11_tokens}
