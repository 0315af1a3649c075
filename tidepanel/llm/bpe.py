"""BPE encoding and decoding by forced boundaries.

A byte pair that lies inside no vocabulary token (its special tokens included) can't be joined by
any merge. Where such a pair also ends a word of the vocabulary's pre-tokeniser (white space, or
ASCII bytes of two classes, or digits, which stand alone), the cut is certain: what is left and
right of it is encoded on its own and the ids are concatenated. The fragments repeat, so a bounded
memo in every task encodes each of them once.

Null or empty text: no ids, the empty text decoded. A fragment may be as long as its text (no
certain cut): it is then encoded as a whole and not kept. Extra columns are ignored; repeated rows
give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .texts import LOWER, SPACE, batch_of, map_texts, model

#: Fragments that a task keeps, and the bytes of the longest.
MEMO, MEMO_BYTES = 500_000, 48
#: Letters that every normal form and lower-casing treats one by one; a fragment of them is one word.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies (public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def never_inside(path: str) -> np.ndarray:
    """[256, 256]: the pair of bytes is inside no token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, suffix = byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
    never = np.ones((256, 256), bool)
    for token in spec["model"]["vocab"]:
        word = token.removesuffix(suffix) if suffix else token
        raw = bytes(alphabet[c] for c in word if c in alphabet) if all(c in alphabet for c in word) else word.encode()
        for a, b in zip(raw, raw[1:], strict=False):
            never[a, b] = False
    for added in spec.get("added_tokens", []):
        raw = added["content"].encode()
        for a, b in zip(raw, raw[1:], strict=False):
            never[a, b] = False
    return never


def certain_cuts(path: str) -> np.ndarray:
    """[256 * 256] by a * 256 + b: between byte a and byte b of a raw text a cut is certain."""
    never = never_inside(path)[LOWER][:, LOWER]
    kind = np.full(256, 3)  # other ASCII
    kind[128:] = 9  # parts of characters: normalising may change them
    kind[SPACE] = 0
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[[*range(48, 58)]] = 2
    kind[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = 9
    a, b = kind[:, None], kind[None, :]
    words_end = ((a != b) | (a == 2)) & (a != 9) & (b != 9)
    return (never & words_end).ravel()


class Encoder:
    """One vocabulary in one task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not spec["model"].get("end_of_word_suffix"):
            raise ValueError("white space must end words: a vocabulary with a mark of the word's end is asked for")
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.cuts = certain_cuts(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code, self.pack, self.model = "H" if self.kind.itemsize == 2 else "I", struct.pack, self.tokenizer.model
        self.shown = {b: c for c, b in byte_alphabet().items()}
        probe = "thé"  # the short way holds if it agrees with the whole tokenizer
        self.words = False
        whole, self.words = self.direct(probe.encode()), True
        self.words = self.direct(probe.encode()) == whole
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.memo = _Memo(self)

    def direct(self, fragment: bytes) -> bytes:
        if self.words and fragment.islower() and fragment.isalpha():  # ASCII letters stand for themselves
            ids = [t.id for t in self.model.tokenize(fragment.decode("ascii"))]
        else:
            text = fragment.decode("utf-8", "replace")
            if self.words and _LETTERS.fullmatch(text):  # one word already: only the merges are left
                ids = [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.shown))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        """The ids of each text, in their binary form."""
        if len(data) > 1:
            at = np.flatnonzero(self.cuts[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]) + 1
            at = at[~(SPACE[data[at - 1]] | SPACE[data[at]])]  # white space divides already
            data, off = np.insert(data, at, 32), off + np.searchsorted(at, off, "left")
        raw, get = data.tobytes(), self.memo.__getitem__
        if self.lower and b"<|" not in raw:  # else lower-casing could make a special token
            raw = raw.lower()
        for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            yield b"".join(map(get, raw[s:e].split()))

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: the tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, fragment: bytes) -> bytes:
        out = self.encoder.direct(fragment)
        if len(fragment) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[fragment] = out
        return out


def encoder(path: str) -> Encoder:
    """Loaded once in each worker process."""
    return model(("encoder", path), lambda: Encoder(path))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""

    def work(keys, data, off, null):
        enc = encoder(path)
        ids = list(enc.encode(data, off))
        flat = np.frombuffer(b"".join(ids), enc.kind).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) // enc.kind.itemsize
        yield batch_of(**{key: keys, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})

    return map_texts(df, f"{key} {_kind(df, key)}, ids array<int>", work, (key, text))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from array<int> ids; null or empty ids: the empty text."""

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            texts = [enc.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield batch_of(**{key: batch.column(0), "text": pa.array(texts, pa.string())})

    return df.select(key, ids).mapInArrow(run, f"{key} {_kind(df, key)}, text string")


def with_decoded(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded) of (key, ids)."""

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            ids = batch.column(1).to_pylist()
            yield batch_of(**{key: batch.column(0), "n_tokens": pa.array([len(x or []) for x in ids], pa.int64()), "ids": batch.column(1), "decoded": pa.array([enc.decode(x or []) for x in ids], pa.string())})

    return df.select(key, "ids").mapInArrow(run, f"{key} {_kind(df, key)}, n_tokens long, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) of every row: encode and with_decoded in one worker, so that a
    task holds one vocabulary and ids don't cross to a second Python process."""

    def work(keys, data, off, null):
        enc = encoder(path)
        ids = [np.frombuffer(x, enc.kind) for x in enc.encode(data, off)]
        sizes = [len(x) for x in ids]
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        yield batch_of(**{key: keys, "n_tokens": pa.array(sizes, pa.int64()), "ids": lists, "decoded": pa.array([enc.decode(x.tolist()) for x in ids], pa.string())})

    return map_texts(df, f"{key} {_kind(df, key)}, n_tokens long, ids array<int>, decoded string", work, (key, text))


def _kind(df: DataFrame, key: str) -> str:
    return dict(df.dtypes)[key]


def digests(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def work(keys, data, off, null):
        enc, rows = encoder(path), []
        for raw in enc.encode(data, off):
            ids = np.frombuffer(raw, enc.kind).tolist()
            said = " ".join(map(enc.decimal.__getitem__, ids))
            rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        yield batch_of(doc_id=keys.cast(pa.int64()), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(a, pa.string()), decoded_sha256=pa.array(b, pa.string()))

    return map_texts(df, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op2_bpe": op2_bpe}
