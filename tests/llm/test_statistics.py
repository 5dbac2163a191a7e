"""Quality classifier, source divergence and spelling variants against brute force, and their odd cases."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, SCHEMA
from trustloom.llm import classifier, divergence, spelling


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# Source divergence -----------------------------------------------------------------------------------


def brute_divergence(rows, least):
    """By the definition, with Python's integers."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= least]
        mates = sorted(s for x, s in groups if x == lang)
        c = lambda s, t: sum(n[lang, m][t] for m in mates) if s is None else n[lang, s][t]
        whole = {s: sum(c(s, t) for t in kept) for s in [None, *mates]}
        p = lambda s, t: 1 + 10**9 * (c(s, t) + 2) // (whole[s] + 2 * len(kept))
        f = lambda a, b, t: (p(a, t) - p(b, t)) ** 2 // (p(a, t) + p(b, t))
        pairs = [(m, sum(f(source, m, t) for t in kept)) for m in mates if m != source]
        terms = [(t, f(source, None, t)) for t in kept if c(source, t) > 0 and p(source, t) > p(None, t)]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("which, least", [("odd", 1), ("odd", 2), ("docs", 4)])
def test_divergence_matches_brute_force(request, which, least):
    df = request.getfixturevalue(which)
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    got = [tuple(r) for r in divergence.divergence(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least)


def test_divergence_of_many_sources_ties_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [("x", f"s{k % 300}", "both Both " + "é" * (1 + k % 5) + (" tie odd" if k % 3 else " odd tie")) for k in range(640)]
        df = spark.createDataFrame([*rows, ("y", "alone", "w"), (None, None, None)], "lang string, source string, text string").repartition(5)
        got = {tuple(r) for r in divergence.divergence(df, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_divergence([*rows, ("y", "alone", "w"), (None, None, None)], 10)
    assert not any(r[0] in ("y", "") for r in got)


def test_divergence_of_a_language_without_terms(spark):
    df = spark.createDataFrame([("x", "a", "one"), ("x", "b", None), ("x", "c", "1 2 3")], "lang string, source string, text string")
    got = {tuple(r) for r in divergence.divergence(df).collect()}
    assert got == {("x", s, "pair", t, 0, k + 1) for s in "abc" for k, t in enumerate(sorted({*"abc"} - {s}))}
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 10**11, 3 * 10**12])
    got = divergence.shares(counts, 3 * 10**12 + 10**11 + 5, 4)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (3 * 10**12 + 10**11 + 13) for c in counts.tolist()]


# Spelling variants -----------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by = defaultdict(list)
    for a, b in combinations(sorted(words, key=lambda w: (len(w), w)), 2) if len(words) < 2500 else ():
        if len(b) - len(a) < 2 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda x: (-words[x], x))
        if words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, k, len(by[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_variants_match_brute_force(request, which):
    df = request.getfixturevalue(which)
    df = df if which == "odd" else df.filter("lang <> 'en'")
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    want = brute_variants([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == len(set(got)) and set(got) == want and (which == "odd" or len(want) > 300)


def _words():
    """A crowded dictionary: one stem with every edit, long words, repeated letters, steps of counts."""
    stem = "internationally"
    out = {stem, stem + "s", "s" + stem, "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "ÿÀäöüßé", "ÿÀäöüßè"}
    for k in range(len(stem)):
        out |= {stem[:k] + stem[k + 1 :], *(stem[:k] + c + stem[k + 1 :] for c in "abcdefghijklm"), *(stem[:k] + c + stem[k:] for c in "abé")}
    return sorted(out)


@pytest.mark.parametrize("most", [3, 20, 10_000])
def test_blocks_of_any_size_lose_and_repeat_no_link(spark, most):
    words = _words()
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near) for r in spelling.near_words(df, most).collect()]
    want = {(a, b) for a in words for b in words if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots_by_hand(spark):
    lots = lambda w, n: " ".join([w] * n)
    # Ids are looked for whose hashes leave all these words alone.
    words = ["singular", "singulat", "singulatt", "tiednear", "tiedneas", "tiednea"]
    i = next(i for i in range(10**6) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words))
    text = " ".join(lots(w, n) for w, n in zip(words, (400, 40, 4, 20, 20, 2)))
    df = spark.createDataFrame([(i, text.upper()), (i, None), (None, "")], "doc_id long, text string")
    got = {r.word: r for r in spelling.spelling_variants(df).collect()}
    assert (got["singulatt"].form, got["singulatt"].root, got["singulatt"].form_n) == ("singulat", "singular", 40)
    assert (got["singular"].form, got["singular"].root, got["singular"].n_near) == (None, "singular", 1)
    assert got["tiednea"].form == "tiednear" and got["tiednea"].n_near == 2
    assert spelling.spelling_variants(df.limit(0)).count() == 0


# Quality classifier ----------------------------------------------------------------------------------


def test_isotonic_map():
    x, n, good = np.arange(6.0), np.array([1, 2, 1, 4, 1, 1.0]), np.array([0, 1, 0, 1, 1, 1.0])
    at, value = classifier.isotonic(x, n, good)
    assert value == sorted(value) and value == pytest.approx([0, 2 / 7, 1])
    assert at == pytest.approx([0, (1 * 2 + 2 + 3 * 4) / 7, 4.5])


def test_partition_sums_equal_one_fit(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((90, len(classifier.STATISTICS))), (rng.uniform(size=90) < 0.4).astype(float)
    d = len(classifier.STATISTICS)
    model = classifier.Model(np.zeros(d), np.ones(d), rng.standard_normal((d, 12)), rng.uniform(0, 6, 12), np.zeros(13))
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "statistics array<double>, y double").repartition(5)
    z = np.hstack([model.features(x), y[:, None]])
    assert np.allclose(classifier._equations(df, model), z.T @ z)


def test_statistics_take_pieces_and_odd_texts():
    assert classifier.statistics_of(None) == classifier.statistics_of("") == [0.0] * len(classifier.STATISTICS)
    long = "Word 12, ok!\n" * 200_000
    got = dict(zip(classifier.STATISTICS, classifier.statistics_of(long)))
    assert got["upper"] == pytest.approx(1 / 13) and got["digit"] == pytest.approx(2 / 13) and got["distinct_words"] == pytest.approx(3 / 600_000)
    assert got["distinct_lines"] == pytest.approx(1 / 200_000) and got["log_chars"] == pytest.approx(np.log1p(len(long)))


@pytest.fixture(scope="module")
def larger(spark, sf):
    import os

    d = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    d = d if os.path.isdir(d) else sf
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_quality(spark, larger):
    docs, labels = larger
    rows = classifier.with_statistics(docs).cache()
    model = classifier.train(rows, labels)
    out = {r.doc_id: r for r in classifier.score(rows, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in out]
    good = [out[r.doc_id].score for r in held if r.quality]
    bad = [out[r.doc_id].score for r in held if not r.quality]
    assert len(bad) > 5 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.95 and np.mean([s < 0.7 for s in bad]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    # Held-out labels teach nothing.
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.train(rows, flipped)
    assert np.allclose(model.weight, again.weight, atol=1e-6)


def test_classifier_takes_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 1), (None, 1), (4, None), (77, 0)], "doc_id long, quality int")
    rows = classifier.with_statistics(odd)
    assert "text" not in rows.columns
    out = classifier.score(rows, classifier.train(rows, labels)).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in out if r.doc_id == 5}) == 1 and all(r.lang in ("en", "fr", None) for r in out)
    taught = next(i for i in range(1, 10) if zlib.crc32(str(i).encode()) % 4 != 2)
    for few, want in ((labels.limit(0), 0.5), (spark.createDataFrame([(taught, 1)], "doc_id long, quality int"), 1.0)):
        assert {r.score for r in classifier.score(rows, classifier.train(rows, few)).collect()} == {want}
    none = classifier.with_statistics(odd.limit(0))
    assert classifier.score(none, classifier.train(none, labels)).count() == 0
