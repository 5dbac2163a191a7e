"""Quality rules: per-text counts and cross-document line frequency.

Built from DataFrame functions alone. The rule on line frequency hashes each
normalised line, counts the documents of a host that hold it, removes lines
above the limit and rejects documents that lose most of their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import BLANK, BLANK_CHARS, NOT_BLANK, held, stored, tail

#: A line held by more documents of one host than this is removed.
MAX_DOCS = 30
#: A document that keeps less than this share of its words is depleted.
MIN_KEPT = 0.3
#: Copies of a frequent line's count that its occurrences are spread over.
SALTS = 16


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Null and empty texts count zero everywhere. Repeated three-word windows are
    found by sorting them inside the row, so no word leaves its row and a text
    of any length costs n log n. A first sort, of one number a window, finds
    those that may be alike: part of the window's hash, as many bits as the
    text's length leaves free, above its place. The second sort takes these
    alone, by the 64-bit hashes of all three words: windows are alike if each
    word's hash is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK))
    # One blank for each, then a split at single characters, which needs no pattern. A null stands for the
    # empty string between two blanks: the pieces count the blanks, and the hashes are those of the words.
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), BLANK_CHARS[1:], t)
    pieces = F.transform(F.split(spaced, " ", -1), lambda w: F.when(w != "", F.xxhash64(w)))
    out = held(docs, _pieces=pieces, n_symbols=(F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long"), n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), _length=F.length(t))
    out = held(out, word_chars=(F.col("_length") - F.size("_pieces") + 1).cast("long"), _hashes=F.array_compact("_pieces")).drop("_pieces", "_length")
    three = F.zip_with(F.zip_with("_hashes", tail(F.col("_hashes"), 1), lambda a, b: F.shiftleft(a, 7).bitwiseXOR(b)), tail(F.col("_hashes"), 2), lambda x, c: F.shiftleft(x, 7).bitwiseXOR(c))
    bits = F.greatest(F.ceil(F.log2(F.size("_hashes") + 2)).cast("int"), F.lit(1))
    bits = F.greatest(F.ceil(F.log2(F.size("_hashes") + 2)).cast("int"), F.lit(1))
    # A window's hash above its place: sorted, windows that may be alike stand side by side.
    out = held(out, n_words=F.size("_hashes").cast("long"), _bits=bits, _below=F.call_function("shiftleft", F.lit(1).cast("long"), bits), _windows=F.slice(three, 1, F.greatest(F.size("_hashes") - 2, F.lit(0))))
    pack = lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))
    out = held(out, _sorted=F.sort_array(F.transform("_windows", pack))).drop("_windows", "_bits")
    place = lambda x: x.bitwiseAND(F.col("_below") - 1).cast("int")
    out = held(out, _maybe=_neighbours("_sorted", lambda x, y: x.bitwiseXOR(y).between(F.lit(0), F.col("_below") - 1), place)).drop("_sorted", "_below")
    words_at = lambda i: F.struct(*[F.get("_hashes", i + k).alias(f"w{k}") for k in range(3)], i.alias("at"))
    out = held(out, _sorted=F.sort_array(F.transform("_maybe", words_at))).drop("_hashes", "_maybe")
    alike = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    out = held(out, _at=_neighbours("_sorted", alike, lambda x: x["at"])).drop("_sorted")
    covered = F.aggregate(
        F.zip_with("_at", tail(F.col("_at"), 1), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def _neighbours(array: str, alike: Callable, place: Callable) -> Column:
    """The places, in order, of elements of a sorted array that are like the one before or behind."""
    pairs = F.zip_with(array, tail(F.col(array), 1), lambda x, y: F.when(alike(x, y), F.array(place(x), place(y))))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))


def normalised_line(line: Column) -> Column:
    """Lower case, one space between words; the pattern runs only on lines that need it."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", *BLANK_CHARS[1:])])
    return F.lower(F.btrim(F.when(odd, F.regexp_replace(line, BLANK + "+", " ")).otherwise(line)))


def line_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _lines: a struct(hash, n: words) for every line; blank lines have no words."""
    norm = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), normalised_line)
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    out = held(docs, _norm=norm)
    return out.withColumn("_lines", F.transform("_norm", lambda x: F.struct(F.xxhash64(x).alias("hash"), F.when(x == "", 0).otherwise(spaces(x) + 1).alias("n")))).drop("_norm")


def frequent_lines(lined: DataFrame, doc_id: str = "doc_id", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(_host, _hash) of lines that over ``max_docs`` documents of a host hold.

    A document is a doc_id; rows without one are documents of their own. A line
    counts once in a document: lines are made distinct inside the row, and rows
    whose doc_id comes again, if there are any, are made distinct beside the
    others, so that the count needs one aggregation with a partial step.
    """
    hashes = F.array_distinct(F.transform(F.filter("_lines", lambda x: x["n"] > 0), lambda x: x["hash"]))
    repeated = stored(lined.groupBy(F.col(doc_id).alias("_again")).agg(F.count("*").alias("n")).filter("n > 1 and _again is not null").select("_again"), "repeated")
    same = lined[doc_id] == repeated["_again"]
    rows = lambda part: part.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.explode(hashes).alias("_hash"))
    once = rows(lined.join(repeated, same, "left_anti")).select("_host", "_hash")
    again = rows(lined.join(repeated, same, "left_semi")).distinct().select("_host", "_hash")
    return once.unionByName(again).groupBy("_host", "_hash").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > max_docs).select("_host", "_hash")


def removed_lines(lined: DataFrame, doc_id: str = "doc_id", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document that loses lines: _id, _key, _from, removed (array of struct(no, n)).

    ``lined`` is stored: it has the columns of :func:`line_hashes` and
    _text_key. The frequent lines are stored as well, so that the planner knows
    their size: a small table is sent to all, a large one is joined by salted
    keys.
    """
    found = stored(frequent_lines(lined, doc_id, host, max_docs), "frequent").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = lined.select(F.col(doc_id).alias("_id"), F.col("_text_key").alias("_key"), F.col(host).alias("_from"), F.posexplode("_lines").alias("_no", "_line")).filter("_line.n > 0")
    lines = lines.withColumns({"_line_hash": F.col("_line.hash"), "_n": F.col("_line.n"), "_line_salt": F.pmod(F.xxhash64("_id", "_key", "_no"), F.lit(SALTS)).cast("int")})
    same = lines["_from"].eqNullSafe(found["_host"]) & (lines["_line_hash"] == found["_hash"]) & (lines["_line_salt"] == found["_salt"])
    hit = lines.join(found, same, "left_semi")
    return hit.groupBy("_id", "_key", "_from").agg(F.collect_set(F.struct(F.col("_no").alias("no"), F.col("_n").alias("n"))).alias("removed"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, clean: bool = True) -> DataFrame:
    """``docs`` with the counts of :func:`text_counts`, n_words_removed, base_failed, depleted, kept and, with ``clean``, clean_text.

    Texts are read once for their counts and line hashes, which are stored
    without the texts; ``clean`` reads them again. Without ``clean`` the text
    column is left out. A text fails the base rules under 50 words or when over
    half its words lie in repeated three-word windows. A document is depleted
    when it lost a line and keeps less than ``min_kept`` of its words.

    Rows that agree in id, text and host get equal results; rows of one id are
    one document of their host. A null host is a host of its own, and rows with
    a null id are documents of their own. Null texts stay null, have no lines
    and aren't depleted; texts of any length are read whole. Input columns that
    bear one of the added names are replaced, and those whose names begin with
    an underscore are left out. An empty table gives no rows.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_removed", "base_failed", "depleted", "clean_text", "kept", "removed")
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_") or c in added])
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col(text)))
    lined = stored(text_counts(line_hashes(keyed, text), text).drop(text), "counted")
    gone = removed_lines(lined, doc_id, host, max_docs)
    lost = F.coalesce(F.aggregate("removed", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    at = lambda rows: rows[doc_id].eqNullSafe(gone["_id"]) & (rows["_text_key"] == gone["_key"]) & rows[host].eqNullSafe(gone["_from"])
    out = lined.drop("_lines").join(gone, at(lined), "left").withColumn("n_words_removed", lost)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("depleted", (F.col("n_words_removed") > 0) & (F.col("n_words") - F.col("n_words_removed") < min_kept * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    if not clean:
        return out.drop("_id", "_key", "_from", "_text_key", "removed")
    # One verdict for each (id, text, host), joined back to the texts.
    verdicts = out.select(F.col(doc_id).alias("_i"), F.col("_text_key").alias("_k"), F.col(host).alias("_h"), *[c for c in added if c in out.columns and c != "clean_text"]).dropDuplicates(["_i", "_k", "_h"])
    same = keyed[doc_id].eqNullSafe(verdicts["_i"]) & (keyed["_text_key"] == verdicts["_k"]) & keyed[host].eqNullSafe(verdicts["_h"])
    nos = F.transform("removed", lambda x: x["no"])
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(nos, i))
    out = keyed.join(verdicts, same)
    return out.withColumn("clean_text", F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_i", "_k", "_h", "_text_key", "removed")
