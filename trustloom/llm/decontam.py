"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

Benchmark items and documents are sequences of normalised words. A CGK random
walk reads a window: at step j it writes the word under its pointer and moves on
by a random bit of (j, word). Edit distance d becomes a Hamming distance of order
d squared at most, so a window within the distance of an item often agrees with
it at sampled steps. A key is the words written at a few sampled steps; equal
keys make a candidate, and the exact edit distance decides.

Items are cut into pieces of about PIECE words, and windows have a piece's size:
of a passage within d edits of an item some piece has no more than its share of
them. How many walks a piece's length and edits need for the target recall is
found by simulation (:func:`walks_for`), for each kind of edit.

Before any walk a lossless filter leaves out what can't match: a passage within
d edits of an item of n words shares at least n - q + 1 - q d of the item's runs
of q words, with q the longest run up to 3 of which one must be left. Windows are
taken where as many shared runs of one item lie within n + d words.
"""

from __future__ import annotations

import uuid
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import Memo, only, row_key, stored

#: Edits allowed, as a share of an item's words.
DISTANCE = 0.2
#: Share of the passages within the distance that are to be found.
RECALL = 0.99
#: Words of a piece, about.
PIECE = 24
#: Sampled steps in a key, and keys taken from a walk.
PLACES = 2
BANDS = 12
#: Simulated passages of each kind of edit, and walks that each is tried with.
TRIALS = 200
TRIED = 24
#: Windows whose walks are made together.
WINDOWS = 1 << 14
SEED = 7
#: Benchmark rows handled in one block; larger benchmarks take several passes.
BLOCK_ITEMS = 20_000
#: Bytes of text in one block at most.
BLOCK_BYTES = 8 << 20
MEMO = 150_000
#: Longest run of words by which passages are found.
Q = 3
#: Pairs of a place and an item that are looked at together.
PAIRS = 1 << 22


def normal_word(token: str) -> str:
    """Letters and digits in lower case."""
    return token if token.isalnum() and token.islower() else "".join(c for c in token.lower() if c.isalnum())


def normal_words(text: str) -> list[str]:
    return [w for w in map(normal_word, text.split()) if w]


def numbers(words: dict[str, int]) -> Memo:
    """Number of a raw token's word: 0 if no item has it, -1 for a token without letters and digits."""

    def of(token: str) -> int:
        w = normal_word(token)
        return words.get(w, 0) if w else -1

    return Memo(of, MEMO)


def edits(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in ``text``, 0 included, the least edit distance of ``item`` to a part that ends there."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, x in enumerate(item.tolist()):
        new = np.empty(len(row), np.int64)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != x), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def begins(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in ``text`` where a part with the distance of :func:`edits` begins, as late as may be."""
    row, begin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    steps = begin
    for i, x in enumerate(item.tolist()):
        new, come = row + 1, begin.copy()
        step = row[:-1] + (text != x)
        better = (step < new[1:]) | ((step == new[1:]) & (begin[:-1] > come[1:]))
        new[1:][better], come[1:][better] = step[better], begin[:-1][better]
        level = new - steps
        row = np.minimum.accumulate(level)
        # Of equal costs the one that begins latest: one number holds a level's cost and its place from behind.
        rank = np.minimum.accumulate(level * (len(text) + 2) + (len(text) + 1 - come))
        begin = len(text) + 1 - np.mod(rank, len(text) + 2)
        row = row + steps
    return begin


def passages(item: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(edits, end) of parts of ``text`` within ``most`` edits: again and again the best one apart from those taken."""
    row = edits(item, text)
    ends = np.flatnonzero(row <= most)
    if not len(ends):
        return []
    if ends[-1] - ends[0] < len(item) - most:
        end = int(row.argmin())
        return [(int(row[end]), end)]
    begin = begins(item, text)
    taken: list[tuple[int, int]] = []
    for end in ends[np.argsort(row[ends], kind="stable")].tolist():
        k = bisect(taken, (end, 0), key=lambda x: (x[1], 0)) if taken else 0
        # taken is by place: the part before must end, and the one behind begin, outside this one.
        before, behind = taken[k - 1] if k else None, taken[k] if k < len(taken) else None
        if begin[end] < end and (before is None or before[1] <= begin[end]) and (behind is None or end <= behind[0]):
            taken.insert(k, (int(begin[end]), end))
    return [(int(row[end]), end) for _, end in taken]


# CGK walks -----------------------------------------------------------------------------------------


def steps_of(length: int) -> int:
    """Steps of a walk over a window: it reads a word in two steps on average."""
    return 2 * length


@lru_cache(maxsize=4096)
def sampled(walk: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a walk over windows of a length: the two factors of each step's random bit, and the sampled steps of each band."""
    rng = np.random.default_rng([SEED, walk, length])
    a, b = rng.integers(0, 1 << 63, (2, steps_of(length)), np.int64).astype(np.uint64)
    return a << np.uint64(1) | np.uint64(1), b << np.uint64(1), rng.integers(0, steps_of(length), (BANDS, PLACES))


def walk_keys(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, walk: int) -> np.ndarray:
    """(band, window) -> key: the words that the walk over ids[start : start + length] wrote at the band's steps.

    Words behind ``ends`` count as none, as those behind the window do.
    """
    a, b, places = sampled(walk, length)
    at, last = starts.copy(), np.minimum(starts + length, ends)
    wrote = np.empty((steps_of(length), len(starts)), np.uint64)
    for j in range(len(wrote)):
        inside = at < last
        x = np.where(inside, ids[np.minimum(at, len(ids) - 1)] + 1, 0).astype(np.uint64)
        wrote[j] = x
        at += ((a[j] * x + b[j]) >> np.uint64(63)).astype(np.int64) & inside
    key = np.zeros((BANDS, len(starts)), np.uint64)
    for k in range(PLACES):
        key = (key + wrote[places[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def edited(words: np.ndarray, edits: int, kind: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after random edits: 0 replaces, 1 deletes, 2 inserts, 3 mixes them."""
    out = words.tolist()
    for at in sorted(rng.choice(len(out), edits, replace=False).tolist(), reverse=True):
        new = int(rng.integers(1 << 30, 1 << 31))
        out[at : at + 1] = [[new], [], [out[at], new]][kind if kind < 3 else int(rng.integers(0, 3))]
    return np.array(out, np.int64)


@lru_cache(maxsize=4096)
def walks_for(length: int, edits: int, recall: float = RECALL) -> int:
    """Walks by which the share ``recall`` of the pieces of ``length`` words with ``edits`` edits is met, whatever their kind.

    Simulated with a fixed seed: pieces of distinct words, edited and followed by
    other words, each tried with TRIED walks. A piece's chance of a hit in one
    walk gives its chance of none in many.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng([SEED, length, edits])
    most = 1
    for kind in range(4):
        own, other = [], []
        for t in range(TRIALS):
            piece = np.arange(length) + t * length
            near = np.concatenate([edited(piece, edits, kind, rng), rng.integers(1 << 30, 1 << 31, length)])
            own.append(piece)
            other.append(near[:length])
        starts = np.arange(TRIALS) * length
        a, b = np.concatenate(own), np.concatenate(other)
        hit = np.mean([(walk_keys(a, starts, starts + length, length, w) == walk_keys(b, starts, starts + length, length, w)).any(axis=0) for w in range(TRIED)], axis=0)
        hit = (hit * TRIED + 0.5) / (TRIED + 1)  # none of so many doesn't mean never
        n = most
        while np.mean((1 - hit) ** n) > 1 - recall:
            n += 1
        most = max(most, n)
    return most


def pieces(n: int, edits: int) -> list[tuple[int, int, int]]:
    """(offset, length, edits) of the pieces of an item of ``n`` words."""
    k = max(1, round(n / PIECE))
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a, min(b - a, edits // k)) for a, b in zip(cuts, cuts[1:])]


class Pieces:
    """Pieces of one length and the sorted keys of their walks."""

    def __init__(self, ids: np.ndarray, items: np.ndarray, length: int, walks: int) -> None:
        self.items, self.length, self.walks = items, length, walks
        starts = np.arange(len(items)) * length
        self.keys, self.order = [], []
        for w in range(walks):
            keys = walk_keys(ids, starts, starts + length, length, w)
            order = np.argsort(keys, axis=1, kind="stable")
            self.keys.append(np.take_along_axis(keys, order, axis=1))
            self.order.append(order)

    def candidates(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of windows and pieces that share a key."""
        found = []
        for at in range(0, len(starts), WINDOWS):
            s, e = starts[at : at + WINDOWS], ends[at : at + WINDOWS]
            for w in range(self.walks):
                for known, order, keys in zip(self.keys[w], self.order[w], walk_keys(ids, s, e, self.length, w)):
                    left = np.searchsorted(known, keys, "left")
                    hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == keys)
                    if len(hit):
                        left = left[hit]
                        n = np.searchsorted(known, keys[hit], "right") - left
                        piece = order[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        found.append(np.unique(np.stack([np.repeat(s[hit], n), self.items[piece]]), axis=1))
        return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class Index:
    """Items, where their runs of words stand by run length, and their pieces by length."""

    def __init__(self, items: list[tuple[int, str]], distance: float = DISTANCE, recall: float = RECALL) -> None:
        self.vocab: dict[str, int] = {}
        lists = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in normal_words(t)]) for i, t in items]
        self.base = len(self.vocab) + 2
        self.items = [(i, np.array(w, np.int64)) for i, w in lists if w]
        self.size = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = np.array([int(distance * len(w)) for _, w in self.items], np.int64)
        # The longest runs of which some must survive the edits.
        self.run = np.ones(len(self.items), np.int64)
        for q in range(2, Q + 1):
            self.run[self.size - q + 1 - q * self.edits >= 1] = q
        self.need = np.maximum(1, self.size - self.run + 1 - self.run * self.edits)
        self.holders = {}
        for q in np.unique(self.run).tolist():
            own = np.flatnonzero(self.run == q)
            runs = [np.unique(self.runs(self.items[k][1], q)) for k in own.tolist()]
            of, runs = np.repeat(own, [len(x) for x in runs]), np.concatenate(runs)
            order = np.argsort(runs, kind="stable")
            self.holders[q] = runs[order], of[order]
        self.pieces = self._pieces(recall)

    def _pieces(self, recall: float) -> list[Pieces]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, (n, d) in enumerate(zip(self.size.tolist(), self.edits.tolist())):
            for offset, length, edits in pieces(n, d):
                by.setdefault(length, []).append((k, offset, edits))
        out = []
        for length, own in sorted(by.items()):
            ids = np.concatenate([self.items[k][1][o : o + length] for k, o, _ in own])
            out.append(Pieces(ids, np.array([k for k, _, _ in own]), length, max(walks_for(length, e, recall) for e in {e for _, _, e in own})))
        return out

    def runs(self, w: np.ndarray, q: int) -> np.ndarray:
        """Each run of ``q`` words as one number; -1 where a word is in no item."""
        n = len(w) - q + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            out = out * self.base + w[k : k + n]
            known &= w[k : k + n] > 0
        return np.where(known, out & (2**63 - 1), -1)  # where words are very many, runs may share a number

    def places(self, ids: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, low, high): parts of ``ids`` that hold every passage within an item's edits."""
        for q, (known, of) in self.holders.items():
            runs = self.runs(ids, q)
            left = np.searchsorted(known, runs, "left")
            at = np.flatnonzero((runs >= 0) & (known[np.minimum(left, len(known) - 1)] == runs))
            doc = np.searchsorted(breaks, at, "right") - 1
            same = at + q <= breaks[doc + 1]
            at, doc = at[same], doc[same]
            left = left[at]
            count = np.searchsorted(known, runs[at], "right") - left
            # A step holds whole documents, about so many pairs of a place and an item.
            steps = np.cumsum(count) // PAIRS
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            cuts = first[np.flatnonzero(np.diff(steps[first], prepend=-1))] if len(at) else first
            for a, b in zip(cuts.tolist(), [*cuts.tolist()[1:], len(at)]):
                n = count[a:b]
                pos, d = np.repeat(at[a:b], n), np.repeat(doc[a:b], n)
                item = of[np.repeat(left[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                order = np.lexsort((pos, item))
                pos, d, item = pos[order], d[order], item[order]
                last = np.arange(len(pos)) + self.need[item] - 1
                ok = last < len(pos)
                last = np.minimum(last, len(pos) - 1)
                most = self.size[item] + self.edits[item]
                ok &= (item[last] == item) & (d[last] == d) & (pos[last] - pos <= most - q)
                k, last = np.flatnonzero(ok), last[ok]
                low = np.maximum(pos[last] + q - most[k], breaks[d[k]])
                high = np.minimum(pos[k] + most[k], breaks[d[k] + 1])
                # Both ends grow within a document and item: parts that overlap become one.
                new = np.ones(len(k), bool)
                new[1:] = (item[k][1:] != item[k][:-1]) | (d[k][1:] != d[k][:-1]) | (low[1:] >= high[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(k)) - 1 if len(k) else begin
                yield from zip(d[k][begin].tolist(), item[k][begin].tolist(), low[begin].tolist(), high[end].tolist())

    def matches(self, ids: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, end, edits) over ``ids``, where document k fills breaks[k] to breaks[k + 1]."""
        found = np.array(list(self.places(ids, breaks)), np.int64).reshape(-1, 4)
        doc, item, low, high = found[np.lexsort((found[:, 2], found[:, 1]))].T
        rank = item * (len(ids) + 1) + low
        met = np.zeros(len(doc), bool)
        for p in self.pieces:
            own = np.isin(item, p.items)
            n = (high - low)[own]
            if not len(n):
                continue
            starts = np.repeat(low[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            starts, first = np.unique(starts, return_index=True)
            ends = np.repeat(breaks[doc[own] + 1], n)[first]
            at, of = p.candidates(ids, starts, ends)
            # The part of this item that the window stands in, if there is one.
            k = np.searchsorted(rank, of * (len(ids) + 1) + at, "right") - 1
            inside = (k >= 0) & (item[k] == of) & (at < high[k])
            met[k[inside]] = True
        out = []
        for k in np.flatnonzero(met).tolist():
            number, words = self.items[item[k]]
            out += [(int(doc[k]), number, int(low[k] - breaks[doc[k]]) + end, dist) for dist, end in passages(words, ids[low[k] : high[k]], int(self.edits[item[k]]))]
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded rows and bytes, one partition at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", distance: float = DISTANCE, min_words: int = 1, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, end_word (long), edits (int): each passage of a document within the distance of an item.

    Words are compared without case and punctuation. Items of fewer than
    ``min_words`` words aren't searched for: by default those without a word.
    Items of up to 4 words allow no edit. Null and empty texts hold nothing, and
    texts of any length are read whole. A row per passage, of those that overlap
    the nearest one, of ties the first; repeated documents give theirs each,
    repeated items count as items of their own. Extra columns, whatever their
    names, are ignored; empty tables give no rows. An item's block goes to all
    tasks; blocks have a bounded size, whatever the benchmark's. A passage at
    the full distance is found with a chance of ``recall``, a nearer one with more.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, end_word long, edits int"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        items = [(i, t) for i, t in block if len(normal_words(t)) >= min_words]
        if not items:
            continue
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            def build():
                index = Index(shared.value, distance, recall)
                return index, numbers(index.vocab).__getitem__

            index, number = only(build, "decontam", name)
            names = ["doc_id", "item_id", "end_word", "edits"]
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                at = 0
                while at < len(texts):
                    lists, upto, size = [], at, 0
                    while upto < len(texts) and size < 1 << 20:
                        found = np.fromiter(map(number, (texts[upto] or "").split()), np.int64)
                        found = found[found >= 0]
                        lists.append(found)
                        size += len(found)
                        upto += 1
                    breaks = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                    hits = sorted(index.matches(np.concatenate(lists), breaks)) if breaks[-1] else []
                    if hits:
                        doc = ids.take(pa.array([at + h[0] for h in hits]))
                        yield pa.record_batch([doc, pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int32())], names)
                    at = upto

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a benchmark passage, their columns as they were.

    Rows are told apart by their text, whatever their ids in ``doc_id``: rows of
    a contaminated text go, all others stay, nulls, empties and repeats too.
    """
    rows = docs.withColumn("_text_key", row_key(text))
    bad = benchmark_hits(rows, benchmark, "_text_key", text, **options).select(F.col("doc_id").alias("_bad")).distinct()
    bad = stored(bad, "contaminated")  # so that the planner sends a small table to all
    return rows.join(bad, rows["_text_key"] == bad["_bad"], "left_anti").drop("_text_key")
