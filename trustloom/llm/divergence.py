"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Sort-based streaming. Tasks count terms, pre-aggregated over the documents of
a task; the counts are dealt by (lang, term) and sorted by (lang, term, source),
and a run-length scan of each partition adds up document frequency and counts.
Kept terms then go, in buckets, to tasks that emit partial sums for pairs of
sources and the leading terms of each source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import stored

#: A language keeps the terms of at least so many of its documents.
MIN_DOCS = 10
#: Ranks of the part "term".
TOP = 10
#: What stands for the whole in a share.
SCALE = 1_000_000_000
#: Entries that a task counts before it passes them on.
HELD = 150_000
#: Terms a bucket and sources a block, about.
TERMS, SOURCES = 512, 256

#: A-Z lower-cased, other ASCII characters that aren't letters blanked: bytes of longer characters stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = "lang string, term string, source string, docs long, n long"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, in UTF-8, with A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts of each term: documents and occurrences, bounded in memory."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in held.items():
            keys = pa.array(list(docs), pa.binary()).cast(pa.string())
            same = lambda v: pa.array([v] * len(docs), pa.string())
            yield pa.record_batch([same(lang), keys, same(source), pa.array(docs.values(), pa.int64()), pa.array(map(n.__getitem__, docs), pa.int64())], ["lang", "term", "source", "docs", "n"])
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = terms(text)
            if not words:
                continue
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(docs)
            docs.update(set(words))
            n.update(words)
            entries += len(docs)
            if entries >= HELD:
                yield from flush()
                entries = 0
    yield from flush()


def _new(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal values in ``columns`` begins."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return out


def _scan(least: int):
    """Run-length scan of rows sorted by (lang, term, source): a row for each source of each kept term.

    An open term is carried from batch to batch with its sources summed up, a row each.
    """

    def summed(rows: pa.Table) -> pa.Table:
        begin = np.flatnonzero(_new(*(rows.column(c).combine_chunks() for c in ("lang", "term", "source"))))
        sums = {c: np.add.reduceat(rows.column(c).to_numpy(), begin) for c in ("docs", "n")}
        return pa.table([*(rows.column(c).take(pa.array(begin)).combine_chunks() for c in ("lang", "term", "source")), pa.array(sums["docs"]), pa.array(sums["n"])], names=rows.column_names)

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            new = _new(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks())
            docs = np.add.reduceat(rows.column("docs").to_numpy(), np.flatnonzero(new))
            yield from rows.filter(pa.array((docs >= least)[np.cumsum(new) - 1])).drop_columns(["docs"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = summed(pa.concat_tables([rest, rows]) if rest is not None else rows)
            last = int(np.flatnonzero(_new(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()))[-1])
            yield from kept(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield from kept(rest)

    return run


def kept_terms(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n) of the terms in at least ``least`` documents of a language, sources with n > 0.

    Each row is a document, also where rows repeat. Whatever the documents, a
    term has at most one row for each source and flush of a task, so no key is hot.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = clean.mapInArrow(_count, _COUNTS)
    dealt = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(_scan(least), "lang string, term string, source string, n long")


def shares(counts: np.ndarray, whole, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (whole + 2 * terms)), exact also where SCALE * count passes 64 bits."""
    if (int(counts.max()) if counts.size else 0) > (2**63 - 1) // SCALE - 2:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 2) // (whole + 2 * terms)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so squares fit in 64 bits."""
    return (p - q) ** 2 // (p + q)


_PARTIAL = "lang string, source string, part string, item string, value long"


def _partial(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Of a bucket of a language's terms and a block of its sources: partial pair sums, and each source's leading terms.

    ``groups`` are all sources of the language in order; the block's are compared with those behind them.
    """
    out: dict[str, list] = {k: [] for k in ("lang", "source", "part", "item", "value")}

    def add(source, part, items, values) -> None:
        out["lang"] += [lang] * len(items)
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values

    if groups.num_rows:
        groups = groups.sort_by("place")
        lang, names = groups.column("lang")[0].as_py(), groups.column("source").to_pylist()
        whole = groups.column("whole").to_numpy()
        v, of_lang, block = (groups.column(c)[0].as_py() for c in ("v", "lang_n", "block"))
        own = range(block * SOURCES, min((block + 1) * SOURCES, len(names)))
        sums = np.zeros((len(own), len(names)), np.int64)
        if rows.num_rows:
            at = {s: k for k, s in enumerate(names)}
            words = sorted(set(rows.column("term").to_pylist()))
            of_word = {w: k for k, w in enumerate(words)}
            counts = np.zeros((len(names), len(words)), np.int64)
            counts[[at[s] for s in rows.column("source").to_pylist()], [of_word[w] for w in rows.column("term").to_pylist()]] = rows.column("n").to_numpy()
            big = whole.max() > (2**63 - 1) // SCALE - 2
            p = shares(counts.astype(object) if big else counts, (whole.astype(object) if big else whole)[:, None], v)
            q = shares(counts.astype(object).sum(axis=0) if big else counts.sum(axis=0), of_lang, v)
            for k, s in enumerate(own):
                sums[k, s + 1 :] = distance(p[s + 1 :], p[s]).sum(axis=1)
                found = np.flatnonzero((counts[s] > 0) & (p[s] > q))
                value = distance(p[s][found], q[found])
                first = np.lexsort((found, -value))[:TOP]
                add(names[s], "term", [words[w] for w in found[first]], value[first].tolist())
        for k, s in enumerate(own):
            add(names[s], "pair", names[s + 1 :], sums[k, s + 1 :].tolist())
    return pa.table([pa.array(out[k], pa.int64() if k == "value" else pa.string()) for k in out], names=list(out))


def divergence(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each source from the language's others, and its leading terms.

    Part "pair" has a row for each other source; part "term" the TOP terms that
    the source uses more than its language. Null texts, languages and sources
    count as empty ones. Each row is a document: rows that repeat count each,
    and ids aren't looked at. A source without terms has a row for each other
    source, and distance 0 where the language keeps no term; a language with one
    source has no pairs. Ties go to the item that comes first in UTF-8. Other
    columns are ignored, and an empty table gives no rows.

    The work is kept terms times pairs of sources, as the result's size asks for.
    """
    kept = stored(kept_terms(docs, least), "terms")
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = clean.distinct().join(totals, ["lang", "source"], "left").withColumn("whole", F.coalesce("whole", F.lit(0)))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = stored(groups, "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("whole").alias("lang_n"), F.floor((F.count("*") - 1) / SOURCES).alias("blocks"))
    of_lang = of_lang.join(kept.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    of_lang = stored(of_lang.withColumn("buckets", F.floor(F.col("v") / TERMS) + 1), "languages")  # a row a language
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks")))
    left = kept.join(of_lang, "lang").select("lang", "term", "source", "n", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), block.alias("block"))
    right = groups.join(of_lang, "lang").select("*", block.alias("block")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    right = right.select("lang", "source", "place", "whole", "lang_n", "v", "block", "bucket")
    keys = ("lang", "bucket", "block")
    parts = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_partial, _PARTIAL), "partial")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    out = both.unionByName(parts.filter("part = 'term'")).withColumn("rank", rank)
    return out.filter(f"part = 'pair' or rank <= {TOP}").select("lang", "source", "part", "item", "value", "rank")
