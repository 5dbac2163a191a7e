"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's root holds the least (rank, place) of all adjacent pairs, that is
the leftmost of the lowest-ranked merges. A merge changes at most three leaves,
each in logarithmic time, so a word of n symbols costs n log n however long it
is. Words, and the pieces between blanks that hold them, are memoised in bounded
tables of the worker process.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import SEPARATORS, Memo, only

NONE = 1 << 62


class PairTree:
    """Least key over places, with point updates; keys order by rank and then place."""

    def __init__(self, keys: list[int]) -> None:
        n = 1
        while n < len(keys):
            n *= 2
        self.n = n
        self.t = [NONE] * n + keys + [NONE] * (n - len(keys))
        for i in range(n - 1, 0, -1):
            a, b = self.t[2 * i], self.t[2 * i + 1]
            self.t[i] = a if a < b else b

    def set(self, i: int, key: int) -> None:
        t = self.t
        i += self.n
        t[i] = key
        while i > 1:
            other = t[i ^ 1]
            i >>= 1
            if other < key:
                key = other
            if t[i] == key:
                return
            t[i] = key

    @property
    def root(self) -> int:
        return self.t[1]


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``symbols`` by ``ranks`` ((a, b) -> (rank, merged symbol)) until no pair is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    tree = PairTree([NONE if (r := get(p)) is None else r[0] << 32 | i for i, p in enumerate(zip(s, s[1:]))])
    t, put = tree.t, tree.set
    while (least := t[1]) != NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        a = s[i] = ranks[s[i], s[j]][1]
        s[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = get((a, s[k]))
            put(j, NONE)
            put(i, NONE if r is None else r[0] << 32 | i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            r = get((s[h], a))
            put(h, NONE if r is None else r[0] << 32 | h)
    return [x for x in s if x >= 0]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class WordBpe:
    """A tokenizer file of BPE with word ends, over bytes, in lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        # Within a class the property needs no brackets of its own.
        self.word = regex.compile(pattern)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.inner = [self.vocab.get(c) for c in byte_symbols()]
        self.last = [self.vocab.get(c + self.suffix) for c in byte_symbols()]
        self.words = Memo(lambda w: array("I", self.word_ids(w)).tobytes())
        self.pieces = Memo(lambda p: b"".join([self.words[w] for w in self.cut(p)]))

    def normalised(self, text: str) -> str:
        """NFC and the lower case of each character alone; white space is no part of any word."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def cut(self, piece: str):
        """The words of a piece without white space; letters alone, or with a mark behind, need no pattern."""
        if piece.isalpha():
            return (piece,)
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return piece[:-1], piece[-1]
        return self.word.findall(piece)

    def _bytes(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return ids if None not in ids else [i for i in ids if i is not None]

    def word_ids(self, word: str) -> list[int]:
        return merged(self._bytes(word), self.ranks)

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in little-endian order."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.at_special.split(text)):
            out.append(array("I", [self.special[part]]).tobytes() if k % 2 else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Of a text without special tokens. No word holds white space: pieces between it are looked up whole."""
        text = self.normalised(text)
        if any(c in text for c in SEPARATORS):
            return b"".join([self.words[w] for w in self.word.findall(text)])
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        """All tokens of :meth:`encode`'s ids, special ones too, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def tokenizer(path: str) -> WordBpe:
    return only(lambda: WordBpe(path), "bpe", path)


def default_path() -> str:
    """Where the vocabulary file is: the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_ids(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (string) of every whole text.

    Null and empty texts give no ids and an empty string. Repeated rows give a
    row each, in input order within a partition; extra columns are ignored.
    Executors read ``path``, or the installed vocabulary file where it is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = [t.encode(x or "") for x in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(t.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def bpe_round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (long), ids_sha256, decoded_sha256: digests of what :func:`bpe_ids` gives.

    The ids are encoded from the text, and the text is decoded from the array of
    ids alone. Digests are taken where the rows are, so texts aren't sent back to
    the JVM. Nulls, empties and repeats as in :func:`bpe_ids`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1).to_pylist():
                ids = t.encode(x or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(t.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
