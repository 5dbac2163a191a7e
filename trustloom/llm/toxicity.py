"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean over its own bucket and those of its character
n-grams, so that unseen misspellings share vectors with the words they come
from. The vectors of neighbouring words are averaged, over every run of WINDOW
words, and go through a linear softmax; a document's score is that of its most
toxic run, since a long text with one insult is as toxic as a short one. Runs
begin at every word: words put before a passage don't change its score.
Embeddings and softmax are trained jointly, in numpy; the score's cut is then
set on rows of the training sample that the embeddings weren't fitted to.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from trustloom.llm.common import Memo, only

BUCKETS = 1 << 15
DIM = 8
#: Words whose vectors are averaged.
WINDOW = 4
NGRAMS = (3, 4, 5)
#: Steps on whole documents' averages, then rounds of steps on the runs that count.
WARM_UP = 10
ROUNDS = 8
STEPS = 6
#: Runs of a clean document that a round learns from: the likeliest ones, and as many at random.
HARD = 3
#: Words in fewer training texts share one vector, zero: rare words would only be learnt by heart.
MIN_TEXTS = 3
RATE = 0.1
#: Share of the weights that a step at full rate takes away.
DECAY = 0.02
#: The labelled rows learnt from: at most so many of each label.
PER_LABEL = (1500, 1000)
#: One row in so many of the sample sets the cut instead of the embeddings.
CUT_ROWS = 5
_WORD = regex.compile(r"\p{L}+")


def subwords(word: str, buckets: int = BUCKETS) -> set[int]:
    """Buckets of a word and of its character n-grams, edges marked."""
    w = f"<{word}>".encode("utf-32-le")  # four bytes a character
    out = {crc32(w) % buckets}
    for n in NGRAMS:
        out.update([crc32(w[i : i + 4 * n]) % buckets for i in range(0, len(w) - 4 * n + 1, 4)])
    return out


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def best_run(margins: np.ndarray) -> float:
    """The greatest mean over WINDOW neighbours; a shorter text counts as filled up with zeros."""
    if len(margins) <= WINDOW:
        return float(margins.sum()) / WINDOW
    sums = np.cumsum(np.concatenate([[0.0], margins]))
    return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW


@dataclass
class Model:
    margin: np.ndarray  #: of each bucket: its vector times the difference of the softmax's two columns
    bias: float
    slope: float = 1.0

    def word_margin(self, word: str) -> float:
        own = subwords(word)
        return sum(map(self.of.__getitem__, own)) / len(own)

    @cached_property
    def of(self) -> list[float]:
        return self.margin.tolist()

    def raw_scorer(self):
        """text -> margin of its most toxic run, with a bounded memo of the pieces between blanks."""
        memo = Memo(lambda piece: array("d", [self.word_margin(w) for w in words(piece)]).tobytes())
        return lambda text: best_run(np.frombuffer(b"".join(map(memo.__getitem__, text.split())), np.float64))

    def scorer(self):
        """text -> probability."""
        raw = self.raw_scorer()
        return lambda text: 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * raw(text) + self.bias, -60.0, 60.0))))


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, the keys that occur, and where they begin in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    return order, ordered[begin], begin


class _Net:
    """Embeddings and softmax with Adam's state, over a fixed vocabulary."""

    def __init__(self, names: list[str], dim: int, seed: int, steps: int) -> None:
        rng = np.random.default_rng(seed)
        sub = [[BUCKETS], *[sorted(subwords(x)) for x in names[1:]]]  # the last bucket is the rare words' and stays zero
        self.sub_n = np.array([len(s) for s in sub])
        self.sub_of = np.concatenate([np.array(s) for s in sub])
        self.sub_start = np.concatenate([[0], np.cumsum(self.sub_n)[:-1]])
        self.word_of_sub = np.repeat(np.arange(len(sub)), self.sub_n)
        self.back, self.keys, self.begin = _sorted_groups(self.sub_of)
        emb = (rng.standard_normal((BUCKETS + 1, dim)) * 0.1).astype(np.float32)
        emb[BUCKETS] = 0
        self.params = [emb, (rng.standard_normal((dim, 2)) * 0.1).astype(np.float32), np.zeros(2, np.float32)]
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.at, self.steps = 0, steps

    def word_vectors(self) -> np.ndarray:
        return np.add.reduceat(self.params[0][self.sub_of], self.sub_start, axis=0) / self.sub_n[:, None].astype(np.float32)

    def step(self, word: np.ndarray, share: np.ndarray, unit: np.ndarray, y: np.ndarray) -> None:
        """One step on units (averages): ``word`` enters its ``unit`` with weight ``share``; labels weigh alike."""
        emb, out, bias = self.params
        start = np.flatnonzero(np.diff(unit, prepend=-1))
        vectors = np.add.reduceat(self.word_vectors()[word] * share[:, None], start, axis=0)
        z = vectors @ out + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = p.copy()
        g[np.arange(len(g)), y] -= 1
        g *= np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)[:, None]
        d_unit = g @ out.T
        order, keys, begin = _sorted_groups(word)
        d_word = np.zeros((len(self.sub_n), emb.shape[1]), np.float32)
        d_word[keys] = np.add.reduceat((d_unit[unit] * share[:, None])[order], begin, axis=0)
        d_emb = np.zeros_like(emb)
        d_emb[self.keys] = np.add.reduceat((d_word / self.sub_n[:, None].astype(np.float32))[self.word_of_sub][self.back], self.begin, axis=0)
        d_emb[BUCKETS] = 0
        self.at += 1
        rate = RATE * (1 - self.at / (self.steps + 1))
        for k, (q, grad) in enumerate(zip(self.params, (d_emb, vectors.T @ g, g.sum(axis=0)))):
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.99 * self.v[k] + 0.01 * grad * grad
            if k < 2:
                q -= rate * DECAY * q
            q -= rate * (self.m[k] / (1 - 0.9**self.at)) / (np.sqrt(self.v[k] / (1 - 0.99**self.at)) + 1e-7)


def _fit(texts: list[str], y: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The margin of every bucket."""
    vocab: dict[str, int] = {}
    lists = [np.array([vocab.setdefault(x, len(vocab)) for x in words(t)], np.int64) for t in texts]
    in_texts = np.bincount(np.concatenate([np.unique(w) for w in lists]), minlength=len(vocab)) if vocab else np.empty(0)
    names = ["", *[x for x, n in zip(vocab, in_texts) if n >= MIN_TEXTS]]
    number = {x: k for k, x in enumerate(names)}
    known = np.array([number.get(x, 0) for x in vocab], np.int64)
    lists = [known[w] for w in lists]
    net = _Net(names, dim, seed, WARM_UP + ROUNDS * STEPS)
    # Whole documents: each distinct word with its share.
    docs = [np.unique(w, return_counts=True) if len(w) else (np.zeros(1, np.int64), np.ones(1)) for w in lists]
    word, share = np.concatenate([w for w, _ in docs]), np.concatenate([n / n.sum() for _, n in docs]).astype(np.float32)
    unit = np.repeat(np.arange(len(docs)), [len(w) for w, _ in docs])
    for _ in range(WARM_UP):
        net.step(word, share, unit, y)
    # Runs: documents one after the other, with zeros between them and behind short ones.
    gap = np.zeros(WINDOW, np.int64)
    flat = np.concatenate([x for w in lists for x in (w, gap)])
    begin = np.concatenate([[0], np.cumsum([len(w) + WINDOW for w in lists])])
    size = np.array([max(1, len(w) - WINDOW + 1) for w in lists])
    rng = np.random.default_rng(seed)
    fixed = np.full(len(flat) - WINDOW + 1, -np.inf)
    for a, n in zip(begin.tolist(), size.tolist()):
        fixed[a : a + n] = 0
    equal = np.full(WINDOW, 1 / WINDOW, np.float32)
    for _ in range(ROUNDS):
        m = (net.word_vectors() @ (net.params[1][:, 1] - net.params[1][:, 0]))[flat]
        sums = np.cumsum(np.concatenate([[0.0], m]))
        run = sums[WINDOW:] - sums[:-WINDOW] + fixed
        start, label = [], []
        for k, (a, n) in enumerate(zip(begin.tolist(), size.tolist())):
            here = run[a : a + n]
            if y[k]:
                start.append(a + int(here.argmax()))
                label.append(1)
            else:
                hard = np.argpartition(here, -HARD)[-HARD:] if n > HARD else np.arange(n)
                start += [a + i for i in (*hard.tolist(), *rng.integers(0, n, HARD).tolist())]
                label += [0] * (len(start) - len(label))
        word = flat[np.array(start)[:, None] + np.arange(WINDOW)].reshape(-1)
        unit, share = np.repeat(np.arange(len(start)), WINDOW), np.tile(equal, len(start))
        for _ in range(STEPS):
            net.step(word, share, unit, np.array(label))
    return (net.params[0][:BUCKETS] @ (net.params[1][:, 1] - net.params[1][:, 0])).astype(np.float32)


def _cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, bias) of a logistic of z, by Newton's method with smoothed targets."""
    scale = float(z.std()) or 1.0
    u = (z - z.mean()) / scale
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = 1 / len(y)
    w = np.array([1.0, 0.0])
    X = np.stack([u, np.ones(len(u))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (weight * (p - target)) + [1e-3 * w[0], 0]
        h = X.T @ (X * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag([1e-3, 1e-9])
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    slope = max(float(w[0]), 1e-3) / scale
    return slope, float(w[1] - slope * z.mean())


def train(texts: list[str], labels: list[int], dim: int = DIM, seed: int = 0) -> Model:
    """Fit by full-batch Adam. Without both labels the score is the share of toxic rows."""
    y = np.array(labels, np.int64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    place = np.zeros(len(y), np.int64)
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum())
    cut = place % CUT_ROWS == CUT_ROWS - 1
    if len(set(y[cut])) < 2:  # fewer than CUT_ROWS rows of a label: all of them serve both ends
        cut[:] = True
    fit = ~cut if not cut.all() else cut
    margin = _fit([t for t, k in zip(texts, fit) if k], y[fit], dim, seed)
    raw = Model(margin, 0.0).raw_scorer()
    slope, bias = _cut(np.array([raw(t) for t, k in zip(texts, cut) if k]), y[cut])
    return Model(margin, bias, slope)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of the labelled rows that aren't held out.

    For each label the rows come first whose ids have the smallest hashes:
    PER_LABEL of them at most, whole texts of any length. A document with several
    labels is toxic if one says so; unlabelled ids and null texts don't teach.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    known = known.filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # At most PER_LABEL rows of each label: small enough to send to all.
    some = known.filter("_y = 0").orderBy(*order).limit(PER_LABEL[0]).unionByName(known.filter("_y <> 0").orderBy(*order).limit(PER_LABEL[1]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).filter("_t is not null")
    got = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")).collect()
    got.sort(key=lambda r: (r["_y"] != 0, crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [r["_t"] for r in got], [int(r["_y"] != 0) for r in got]


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int); input columns of these names are replaced.

    Every whole text is read, however long; null and empty texts get the score
    of no words. Repeated rows get equal scores, a row each, and an empty table
    gives no rows. The text alone is looked at; the other columns pass through.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = only(lambda: shared.value.scorer(), "toxicity", name)
        at = names.index(text)
        for batch in batches:
            s = np.array([score(x or "") for x in batch.column(at).to_pylist()], np.float64)
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    rows = docs.select(*names)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
