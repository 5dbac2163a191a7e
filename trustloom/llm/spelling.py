"""Spelling variants: words of the corpus that differ by one edit, and the common form of each.

Forward and reversed dictionaries: one edit leaves the half in front of it or
the half behind it intact, so near words share a prefix or a suffix of half
their length. Words are dealt in blocks by that half, sorted, and scanned;
blocks that hold too many words are subdivided by the same rule, since the edit
leaves a half of what isn't shared yet intact too. Pairs within a block are
verified by their common prefix and suffix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import stored

#: Letters of a word, and occurrences of it, at least.
MIN_CHARS, MIN_COUNT = 7, 2
#: A form occurs so many times as often as its variant.
FACTOR = 10
#: Of the runs whose hash this divides, a letter is left out.
THINNED = 31
#: Words of a block; larger ones are subdivided.
BLOCK = 150
#: Entries that a task counts before it passes them on.
HELD = 300_000

#: Of Latin-1: A-Z lower-cased, all but ASCII letters and the characters from U+00C0 blanked.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and U+00C0 to U+00FF in Latin-1, a byte a code point, with A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def thinned(run: bytes, start: int) -> bytes:
    """The run, less a code point where THINNED divides the CRC-32 of ``start``'s text and the run in UTF-8."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % THINNED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) to counts of words, bounded in memory."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= MIN_CHARS:
                    word = thinned(run, start)
                    if len(word) >= MIN_CHARS:
                        held[word] += n
            if len(held) >= HELD:
                yield flush()
    yield flush()


def dictionary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, its occurrences: the words of enough letters that occur often enough."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# Blocks: words of m and m + 1 letters that agree but for the shorter's letters in a window [a, b) -----------


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks of its window's halves; an edit within the window lies in one of them."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b"))))
    out = rows.select("word", "n", "size", "m", halves.alias("_w")).select("word", "n", "size", "m", "_w.a", "_w.b")
    ahead, behind = F.substring("word", F.lit(1), F.col("a")), F.col("m") - F.col("b")
    key = F.xxhash64("m", "a", "b", ahead, F.substring("word", F.col("size") - behind + 1, behind))
    return out.select("word", "n", "size", "m", "a", "b", key.alias("key"))


def blocks(words: DataFrame, most: int = BLOCK) -> list[DataFrame]:
    """Tables of rows by block, each block of at most ``most`` words or with a window of one letter.

    Within that window there are no more words than letters, and pairs of letters.
    """
    size = F.length("word").cast("int")
    sizes = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= MIN_CHARS))
    rows, out = _halves(words.select("word", "n", size.alias("size"), sizes.alias("m")).withColumns({"a": F.lit(0), "b": F.col("m")})), []
    while True:
        rows = stored(rows, "blocks")
        wide = rows.filter("b - a > 1")
        large = stored(wide.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key"), "large")
        if not large.take(1):
            return [*out, rows]
        out.append(rows.join(large, "key", "left_anti"))
        rows = _halves(wide.join(large, "key", "left_semi"))


def _eq_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, how many letters agree up to the first that differ."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def near_in(letters: np.ndarray, size: np.ndarray, m: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near words within blocks, by shifting the sorted rows against themselves.

    A pair counts in the one block whose window holds its edit: the place of the
    replaced letter, or the end of the common prefix.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, d = np.flatnonzero(size == m), 0
    while True:
        d += 1
        at = at[at + d < len(block)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            break
        other = at + d
        equal = size[other] == m
        i, j = at[equal], other[equal]
        differ = letters[i] != letters[j]
        place = differ.argmax(axis=1)
        good = (differ.sum(axis=1) == 1) & (place >= a[i]) & (place < b[i])
        found.append((i[good], j[good]))
        i, j = at[~equal], other[~equal]
        place = _eq_run(letters[i, :m], letters[j, :m])
        behind = _eq_run(letters[i, :m][:, ::-1], letters[j, 1 : m + 1][:, ::-1])
        good = (place + behind >= m) & (place >= a[i]) & ((place < b[i]) | (b[i] == m))
        found.append((i[good], j[good]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of rows sorted by (m, key, size, word): each link from both ends as word, near, near_n."""

    def scan(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ms = rows.column("m").to_numpy()
        for m in np.unique(ms).tolist():
            own = rows.filter(pa.array(ms == m)).combine_chunks()
            word, n = own.column("word"), own.column("n")
            key, a, b, size = (own.column(c).to_numpy() for c in ("key", "a", "b", "size"))
            letters = np.array([w.encode("latin-1") for w in word.to_pylist()], f"S{m + 1}").view(np.uint8).reshape(len(key), m + 1)
            block = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            i, j = near_in(letters, size, m, block, a, b)
            if len(i):
                i, j = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                yield from pa.table([word.take(i), word.take(j), n.take(j)], names=["word", "near", "near_n"]).combine_chunks().to_batches()

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        key = rows.column("key").combine_chunks()
        ends = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))
        last = int(ends[-1]) + 1 if len(ends) else 0
        if last:
            yield from scan(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None:
        yield from scan(rest)


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, near, near_n: each two words (``word``, ``n``) that one inserted, deleted or replaced letter apart, from both ends."""
    out = None
    for rows in blocks(words, most):
        here = rows.repartition("key").sortWithinPartitions("m", "key", "size", "word").mapInArrow(_links, "word string, near string, near_n long")
        out = here if out is None else out.unionByName(here)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): pointers are doubled until none leads on.

    Counts grow by FACTOR along a path, so it has few steps and no cycle.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not now.join(ahead, "root", "left_semi").take(1):
            return now
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of the dictionary, near ones counted, with the form of each.

    Every whole text counts; null and empty ones have no words, and a null id
    counts as empty text in the hash. Rows that repeat count each. Of near words
    that occur equally often the first in code-point order is the form. Other
    columns are ignored, and an empty table gives no rows.
    """
    words = stored(dictionary(docs, doc_id, text), "dictionary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("_best"))
    rows = words.join(best, "word", "left")
    top = F.when(-F.col("_best.minus") >= FACTOR * F.col("n"), F.col("_best"))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), top["near"].alias("form"), (-top["minus"]).alias("form_n")), "variants")
    out = rows.join(roots(rows.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
