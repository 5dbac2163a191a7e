"""Each operator against brute force, a round trip or held-out accuracy, and the odd cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trustloom.llm import bpe, decontam, kdshard, license, pii, quality, queries, rans, simhash, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, fp string, score string, spans string, shard string"
PROSE = " ".join(f"word{i}" for i in range(60))

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (None, "a null id, call +1 (377) 555-0271 now", "en", "a", 1),
    (4, "x y x y x y x y", "en", "a", 1),
    (5, "same text twice", "en", "a", 1),
    (5, "same text twice", "en", "a", 1),
    (6, "same text twice", "en", "b", 1),
    (7, "long " * 30000 + "end", "en", "b", 1),
    (8, "7" * 5000 + " 1.2.3.4 1.2.3.999 4111 1111 1111 1111 a@b.co_x@d.org.", "en", "b", 1),
    (9, "ÉCOLE Straße 𝔘nicode — “quotes” it's <|endoftext|> x y", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    hit = {j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_counts(request, which):
    rows = quality.text_counts(request.getfixturevalue(which)).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.doc_id


def test_quality_line_frequency(spark, empty, odd):
    rows = [(i, f"shared line\nown line number {i} " + PROSE, "h") for i in range(5)] + [(9, "shared line\nSHARED  line\nshort", "h"), (10, "shared line", "other"), (11, None, "h"), (12, "shared line", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(df, max_docs=4).collect()}
    assert got[0].clean_text == rows[0][1].split("\n")[1] and got[0].kept and got[0].n_words_removed == 2
    assert got[9].clean_text == "short" and got[9].depleted and not got[9].kept
    assert not got[10].depleted and got[11].clean_text is None and got[12].n_words_removed == 0
    assert quality.quality_rules(empty).count() == 0 and quality.quality_rules(odd).count() == len(ODD)


def test_quality_long_texts_and_copies(spark):
    unlike = " ".join(f"{i:x}" for i in range(530_000))
    rows = [(1, unlike, "h"), (2, unlike + " 0 1 2 x 0 1 2", "h"), (3, "a b " * 200_000, "h")]
    got = {r.doc_id: r.n_repeat_words for r in quality.text_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 0, 2: 9, 3: 400_000}
    # Five rows of one id are one document, and five without an id are five.
    rows = [(7, "a line of one document\nmore", "h")] * 5 + [(None, "a line of many\nmore than four", "h")] * 5
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=4).collect()
    assert {(r.doc_id, r.n_words_removed) for r in got} == {(7, 0), (None, 7)} and len(got) == 10


def test_license(spark, empty, odd):
    text = "Some prose.\nReleased under the MIT License.\nmore"
    inside = "A line that goes on. This work is licensed under a Creative Commons\nAttribution 4.0 International License. And on."
    df = spark.createDataFrame([(1, text), (1, text), (2, "unrelated words here"), (3, None), (4, ""), (5, inside), (1, inside)], "doc_id long, text string")
    rows = license.license_scan(df).collect()
    assert sorted((r.doc_id, r.license, r.dice) for r in rows if r.dice == 1) == [(1, "CC-BY-4.0", 1.0), (1, "MIT", 1.0), (5, "CC-BY-4.0", 1.0)]
    assert license.license_scan(empty).count() == 0 and license.license_scan(odd).count() == 0


def test_license_families(spark):
    """Tags, openings and notices that only a version or a variant tells apart: the right one is best."""
    copies = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    notice = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    texts = [
        ("MIT", "// SPDX-License-Identifier: MIT\nint main();"),
        ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"),
        ("LGPL-2.1", "/* SPDX-License-Identifier: LGPL-2.1-only */"),
        ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0"),
        ("CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
        ("GPL-3.0", f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n {copies}\n"),
        ("GPL-2.0", notice.format("program", "General Public License", 2)),
        ("LGPL-2.1", notice.format("library", "Lesser General Public License", 2.1)),
        ("ISC", "Copyright (c) 2020, A. Body\n\n" + isc),
        (None, "The license identifier of this version is free software as well."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(set)
    for r in license.license_scan(df).collect():
        if r.best:
            got[r.doc_id].add(r.license)
    assert got == {i: {name} for i, (name, _) in enumerate(texts) if name}


def test_license_hashes_are_those_of_spark(spark):
    rows = spark.createDataFrame([("the", "license"), ("é", "x" * 40)], "a string, b string").withColumn("h", F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))).collect()
    assert all(license.pair_hash(r.a, r.b) == r.h for r in rows)


def test_license_brute(docs):
    want, own = {}, {name: [license.bigrams(t) for t in texts] for name, texts in license.TEMPLATES.items()}
    for r in docs.collect():
        paragraphs = {x for x in re.split(r"\n(?:[\W_]*\n)+", r.text) if "\n" in x}
        segments = {x for x in {*r.text.split("\n"), *re.split(r"[.!?][\t\n\f\r ]+", r.text), *([r.text] if "\n" in r.text else []), *paragraphs} if len(x) >= 3}
        pairs = [license.bigrams(x) for x in segments]
        for name, texts in own.items():
            d = [max(2 * len(x & t) / max(1, len(x) + len(t)) for t in texts) for x in pairs]
            n = sum(x >= license.THRESHOLD for x in d)
            if n:
                want[r.doc_id, name] = (round(max(d), 9), n)
    got = {(r.doc_id, r.license): (round(r.dice, 9), r.n_segments) for r in license.license_scan(docs).collect()}
    assert got == want


def test_license_in_long_lines(spark):
    rows = [(1, "Released under the MIT License " * 200), (2, "=" * 5000 + " Licensed under CC BY 4.0. " + "=" * 5000)]
    got = license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license, round(r.dice, 2)) for r in got} == {(1, "MIT", 0.89), (2, "CC-BY-4.0", 1.0)}


def test_license_wrapped_texts(spark):
    import textwrap

    wrap = lambda *parts, sign="": "\n".join(f"{sign}{line}" for p in parts for line in [*textwrap.wrap(p, 70), ""])
    grant, header = license.TEMPLATES["MIT"][3:6], license.TEMPLATES["GPL-3.0"][2]
    bsd = license.TEMPLATES["BSD-3-Clause"][1:6]
    rows = [(1, wrap("MIT License", "Copyright (c) 2020 A. Body", *grant)), (2, grant[0]), (3, "code\n#\n" + wrap(header, sign="# ") + "\nmore code"), (4, wrap("Copyright 2020 A. Body", *bsd)), (5, wrap("Any prose. " * 30))]
    got = {(r.doc_id, r.license) for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (4, "BSD-3-Clause")} <= got and not any(d == 5 for d, _ in got), got


def test_warc(spark, tmp_path, sf):
    trap = "head WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ntail"
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u\r\n3", None), (4, None, ""), (5, "u", trap), (6, "u", trap * 2), (7, "u", trap), (None, "n", "same"), (8, "é", "é" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    for k, (frame, least) in enumerate([(df, 0), (spark.read.parquet(f"{sf}/pages.parquet"), 0), (df, 5)]):
        path = f"file://{tmp_path}/w{k}"
        warc.write_warc(frame, path, min_revisit=least)
        got = warc.read_warc(spark, path).collect()
        pages = frame.collect()
        assert len(got) == len(pages) and all(r.sound for r in got)
        best = {}
        for p in pages:
            if p.page_id is not None and len((p.html or "").encode()) >= least:
                best[p.html or ""] = max(p.page_id, best.get(p.html or "", p.page_id))
        by = {r.page_id: r for r in got}
        for p in pages:
            data = (p.html or "").encode()
            r = by[p.page_id]
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)
            first = best.get(p.html or "") if p.page_id is not None and len(data) >= least else None
            assert r.refers_to == (None if first in (None, p.page_id) else first), p.page_id
            assert r.record_type == ("response" if r.refers_to is None else "revisit")
            assert bytes(r.payload) == (b"" if r.refers_to is not None else data)
    # Many splits: records over several blocks, chains entered by doubling.
    long = [(k, "u", (trap if k % 3 else "text ") * (1 + k * 37 % 90)) for k in range(120)] + [(500, "u", "x" * 50_000), (501, "u", trap * 3)]
    df = spark.createDataFrame(long, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"file://{tmp_path}/many")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        got = warc.read_warc(spark, f"file://{tmp_path}/many").collect()
        assert sorted(r.page_id for r in got) == [k for k, _, _ in long] and all(r.sound for r in got)
        text = {k: t for k, _, t in long}
        assert all(bytes(r.payload).decode() == text[r.page_id] for r in got if r.refers_to is None) and any(r.refers_to for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def check_shards(rows, n):
    size = Counter()
    slots = defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < n for s in slots)
    return [size[s] for s in range(n)]


def test_shards(spark, docs, odd, empty):
    rows = kdshard.kd_shards(docs, shards=7).collect()
    assert len(rows) == docs.count()
    size = check_shards(rows, 7)
    assert max(size) - min(size) <= 2 * max(r.size for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in rows)
    hot = spark.range(6000).selectExpr("id as doc_id", "'one text' as text", "'en' as lang", "'s' as source")
    size = check_shards(kdshard.kd_shards(hot, shards=40).collect(), 40)
    assert max(size) - min(size) <= 24 * 3
    same = spark.range(4000).selectExpr("1L as doc_id", "'one text' as text", "'en' as lang", "'s' as source")
    size = check_shards(kdshard.kd_shards(same, shards=40).collect(), 40)
    assert max(size) - min(size) <= 24 * 3
    assert len(kdshard.kd_shards(odd, shards=3).collect()) == len(ODD) and kdshard.kd_shards(empty).count() == 0
    assert {r.shard for r in kdshard.kd_shards(docs, target_bytes=50_000).collect()} == set(range(-(-sum(len(t.encode()) + 16 for t in text.values()) // 50_000)))


def test_shards_of_any_ids(spark, docs):
    """Ids as strings, beyond 2^53 and at both ends of long; the same shards however the input is split."""
    wide = [f"{v}" for v in (-(2**63), -(2**63) + 1, 2**63 - 2, 2**63 - 1, 0)] + [f"{2**53 + k}" for k in range(95)]
    rows = spark.createDataFrame([(int(v), "a text of its own " + v, "en", "s") for v in wide], "doc_id long, text string, lang string, source string")
    for df in (rows, rows.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id")), rows.withColumn("doc_id", F.lit(None).cast("string"))):
        got = kdshard.kd_shards(df, shards=8).collect()
        size = check_shards(got, 8)
        assert len(got) == 100 and max(size) - min(size) <= 3 * max(r.size for r in got)
    place = {r.doc_id: r.p for r in rows.select("doc_id", kdshard._id_place(rows).alias("p")).collect()}
    order = [place[k] for k in sorted(place)]
    assert order == sorted(order) and 0 < order[0] and order[-1] < 1 << 31
    near = rows.filter(f"doc_id >= {2**53}").filter(f"doc_id < {2**54}")
    assert [r.p for r in near.select("doc_id", kdshard._id_place(near).alias("p")).orderBy("doc_id").collect()] == list(range(1, 96))
    where = lambda df: {r.doc_id: (r.shard, r.slot) for r in kdshard.kd_shards(df, shards=5).collect()}
    assert where(docs.repartition(3)) == where(docs.repartition(7, "source"))


def test_shards_are_a_kd_tree(spark):
    """A small tree against one built with whole sorts."""
    rng = np.random.default_rng(3)
    rows = [(int(i), int(a), int(b), int(w)) for i, (a, b, w) in enumerate(zip(rng.permutation(500) * 7, rng.permutation(500) ** 2, rng.integers(1, 50, 500)))]
    df = spark.createDataFrame(rows, "id long, a long, b long, size long").cache()
    tree = kdshard.kd_tree(df, ["a", "b"], 6)
    got = {r.id: r.s for r in df.select("id", kdshard._route(tree, lambda n: F.lit(n.first)).alias("s")).collect()}
    whole = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in (1, 2)]

    def build(part, shards, first):
        if shards == 1:
            return {r[0]: first for r in part}
        d = max((1, 2), key=lambda k: (max(r[k] for r in part) - min(r[k] for r in part)) / whole[k - 1])
        part = sorted(part, key=lambda r: r[d])
        aim, sofar, cut = sum(r[3] for r in part) * (shards // 2) / shards, 0, 0
        while sofar + part[cut][3] <= aim:
            sofar, cut = sofar + part[cut][3], cut + 1
        cut += aim - sofar > part[cut][3] / 2
        return build(part[:cut], shards // 2, first) | build(part[cut:], shards - shards // 2, first + shards // 2)

    assert got == build(rows, 6, 0)


TEXTS = ["", " ", "Hello, World! it's 2024 AND we'll see", "naïve ΑΣ ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "𝔘𝔫𝔦 ﬁ é \x85  x\x1c", "don'T 'S", "aaaaaaaaaabbbbbbbbbbaaaaaaaaaa" * 20, "日本語テキスト 12,345.67", "\x00\x01 tab\tnew\nline"]


def test_bpe_matches_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    own = bpe.WordBpe(bpe.default_path())
    for x in [*TEXTS, *[r.text for r in docs.limit(60).collect()]]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(x), "<u4").tolist() == ids, x[:80]
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    for frame in (odd, docs):
        for r in bpe.bpe_ids(frame).join(frame.select("doc_id", "text"), "doc_id").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_ids(odd).count() == len(ODD) and bpe.bpe_round_trip(empty).count() == 0


def naive_merge(s, ranks):
    s = list(s)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
        if not found:
            return s
        _, i = min(found)
        s[i : i + 2] = [ranks[s[i], s[i + 1]][1]]


def test_segment_tree_merges_leftmost_lowest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pairs = {}
        for rank in range(12):
            pairs.setdefault((int(rng.integers(0, 6)), int(rng.integers(0, 6))), (rank, int(rng.integers(0, 6))))
        s = rng.integers(0, 6, int(rng.integers(0, 40))).tolist()
        assert bpe.merged(s, pairs) == naive_merge(s, pairs)


def brute_hits(doc, item, distance):
    a, b = decontam.normal_words(item), decontam.normal_words(doc)
    d = int(distance * len(a))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= d


def test_decontamination(spark, docs, odd, empty, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = np.random.default_rng(3)
    rows = []
    for k, (i, t) in enumerate(items.items()):
        w = t.split()
        n = int(0.2 * len(decontam.normal_words(t)))
        for at in sorted(rng.choice(len(w), n, replace=False).tolist(), reverse=True):
            kind = rng.integers(0, 3)
            w[at : at + 1] = [["changed"], [], [w[at], "added"]][kind]
        rows.append((100_000 + k, "before this " + " ".join(w).upper() + " and after"))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    near = {(100_000 + k, i) for k, i in enumerate(items)}
    true = {(d, i) for (d, i), (_, text) in zip(sorted(near), rows) if brute_hits(text, items[i], decontam.DISTANCE)}
    got = {(r.doc_id, r.item_id) for r in decontam.benchmark_hits(planted, bench).collect()}
    assert got <= near and len(got & true) >= 0.95 * len(true) and len(true) >= 0.9 * len(near)
    some = docs.limit(100).collect()
    want = {(r.doc_id, i) for r in some for i, t in items.items() if set(decontam.normal_words(t)) & set(decontam.normal_words(r.text)) and brute_hits(r.text, t, decontam.DISTANCE)}
    got = {(r.doc_id, r.item_id) for r in decontam.benchmark_hits(docs.limit(100), bench).collect()}
    assert got == want
    assert decontam.benchmark_hits(odd, bench).count() == 0 and decontam.benchmark_hits(empty, bench).count() == 0
    assert decontam.benchmark_hits(docs, bench.limit(0)).count() == 0 and decontam.decontaminated(odd, bench).count() == len(ODD)
    kept = decontam.decontaminated(planted, bench)
    assert kept.columns == planted.columns and kept.count() == len(rows) - len({d for d, _ in near & {(r.doc_id, r.item_id) for r in decontam.benchmark_hits(planted, bench).collect()}})


def test_decontamination_reaches_the_target_recall():
    """Passages at the full distance, of each kind of edit and of any length."""
    rng = np.random.default_rng(4)
    for n in (5, 8, 15, 30, 60, 120, 300, 500):
        many = 200 // max(1, n // 15)
        items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 20 * n, n))) for k in range(many)]
        index = decontam.Index(items)
        for kind in range(4):
            texts = [np.concatenate([[0], decontam.edited(w, int(decontam.DISTANCE * n), kind, rng), [0]]) for _, w in index.items]
            breaks = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            ids = np.concatenate(texts)
            found = {(d, i) for d, i, _, _ in index.matches(np.where(ids < 1 << 30, ids, 0), breaks)}
            assert len(found & {(k, k) for k in range(many)}) >= (decontam.RECALL - 0.01) * many, (n, kind)


def test_decontamination_walks_follow_the_recall():
    assert decontam.walks_for(24, 0) == 1 <= decontam.walks_for(24, 4, 0.5) < decontam.walks_for(24, 4, 0.99)
    assert [sum(n for _, n, _ in decontam.pieces(k, k // 5)) for k in (1, 24, 37, 1000)] == [1, 24, 37, 1000]


def test_decontamination_finds_short_items(spark):
    items = ["What is the capital of France?", "two words", "One", "two words here now then", "!?", "a b a b a b a"]
    texts = ["so what is, the capital of france", "what was the capital of France", "what capital of France", "Two WORDS", "two. other words", "one", "ones", "two words HERE and then", "a b a b a b b", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t and decontam.normal_words(x) and brute_hits(t, x, decontam.DISTANCE)}
    assert {(0, 0), (1, 0), (3, 1), (5, 2)} <= want
    assert {(r.doc_id, r.item_id) for r in decontam.benchmark_hits(docs, bench).collect()} == want


def test_decontamination_gives_a_row_per_passage():
    item = [f"w{k}" for k in range(20)]
    index = decontam.Index([(1, " ".join(item)), (2, "go")])
    for text in (item * 3, item[1:] + item + item[:9] + ["changed"] + item[9:], ["x"] + item + item[:5] + ["x"] + item[6:] + ["go", "go"]):
        ids = np.array([index.vocab.get(x, 0) for x in text], np.int64)
        ends = [e for _, i, e, _ in index.matches(ids, np.array([0, len(ids)])) if i == 1]
        assert len(ends) == (3 if len(text) > 50 else 2), ends
        assert sum(i == 2 for _, i, _, _ in index.matches(ids, np.array([0, len(ids)]))) == text.count("go")


def test_rans_coder():
    rng = np.random.default_rng(0)
    freq = rans.shared_table(np.bincount(rng.zipf(1.3, 20000) % 300, minlength=400), 16)
    assert freq.sum() == 1 << 16 and freq.min() >= 1
    coder = rans.Coder(freq, 16)
    for n in (0, 1, 2, 1023, 1024, 1025, 300_000):
        ids = rng.zipf(1.3, n) % 400
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all() and len(coder.decode(data)) == n
    ids = np.resize(ids, 3 * rans.CHECKPOINT * rans.LANES + 77)
    data = coder.encode(ids)
    step = rans.CHECKPOINT * rans.LANES
    assert (coder.decode(data, 1, 2) == ids[step : 2 * step]).all() and (coder.decode(data, 3) == ids[3 * step :]).all()


def test_token_files(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for frame in (docs, odd):
        rows = rans.token_files(frame).collect()
        assert len(rows) == frame.count()
        sofar = 0
        text = {r.doc_id: r.text for r in frame.collect()}
        rows.sort(key=lambda r: r.start)
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        for r in rows:
            want = np.array([*t.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert r.start == sofar and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes())
            sofar += r.n_tokens
    assert rans.token_files(empty).count() == 0


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """id, fingerprint -> least linked id, by union of all pairs within two bits."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for f in fps:
        for g in a[np.bitwise_count(a ^ np.uint64(f)) <= 2].tolist():
            parent[find(g)] = find(f)
    least = {}
    for i, f in pairs:
        r = find(f)
        least[r] = i if r not in least else min(least[r], i)
    return {i: least[find(f)] for i, f in pairs}


def test_simhash(spark, docs, odd, empty):
    rows = simhash.near_duplicates(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text) and all(int(r.fingerprint, 16) == brute_fp(text[r.doc_id]) for r in rows)
    want = brute_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert {r.doc_id: r.component_id for r in rows} == want
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_all_near_pairs(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    more = [f ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for f in fps[:100].tolist() for k in (1, 2, 3)]
    crowd, f = [], 12345
    for _ in range(400):  # a crowded neighbourhood: all within a few bits of one point
        crowd.append(f ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 3)), replace=False)))
    every = sorted({*fps.tolist(), *more, *crowd, -1, -2, 0, -(1 << 63)})
    df = spark.createDataFrame([(x,) for x in every], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    a = np.array(every, np.int64).view(np.uint64)
    for i, j in combinations(range(len(every)), 2):
        if bin(int(a[i] ^ a[j])).count("1") <= 2:
            assert got[every[i]] == got[every[j]]
    linked = brute_components([(k, int(x)) for k, x in enumerate(a.tolist())])
    groups = defaultdict(set)
    for k, root in linked.items():
        groups[root].add(every[k])
    for g in groups.values():
        assert len({got.get(x) for x in g}) == 1 and (len(g) == 1) == (got.get(next(iter(g))) is None)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(plain):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return [f"{['email', 'ip', 'card', 'phone'][k]}:{s}:{e}" for s, k, e in sorted(out)]


@pytest.mark.parametrize("which", ["odd", "docs", "made"])
def test_pii_base(spark, request, which):
    rng = np.random.default_rng(2)
    if which == "made":
        bits = ["a@b.c", "1.2.3.4", "4111 1111-1111 1111", "+1 (377) 555-0271", " ", "_", ".", "-", "x", "@", "7", "é", "\n", "+49", "..", "  ", "4111111111111111", "00255.1.1.1"]
        frame = spark.createDataFrame([(i, "".join(rng.choice(bits, int(rng.integers(1, 30))))) for i in range(400)], "doc_id long, text string")
    else:
        frame = request.getfixturevalue(which)
    rows = pii.base_spans(frame).select("text", pii.span_text(F.col("spans")).alias("s")).collect()
    for r in rows:
        assert r.s == ",".join(brute_spans(r.text)), r.text[:200]


def test_pii_terms(spark, empty, odd):
    secret = "4111111111111111"
    rows = [(i, f"word{i}abc ago zebrafish pays with {secret} the{'abcdefgh'[i]}x way\nother the line") for i in range(8)]
    rows = [(i, t.replace(str(i) + "abc", "abcdefgh"[i])) for i, t in rows] + [(100 + i, f"plain text the with pays way number {i}") for i in range(60)]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, clean_text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(df, support=5).collect()}
    assert "zebrafish" not in got[0].clean_text and secret not in got[0].clean_text and "[TERM]" in got[0].clean_text and "[CARD]" in got[0].clean_text
    assert "pays with" in got[0].clean_text and got[0].clean_text.endswith("\nother the line")
    assert all(got[100 + i].clean_text == got[100 + i].text and not got[100 + i].spans for i in range(60))
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.clean_text for r in rows}[1] is None and pii.personal_data(empty).count() == 0


def test_pii_terms_in_one_template(spark):
    rows = [(i, f"Contact: kim@example.com for part{i}\nthe order of Bo7 goes out") for i in range(8)]
    rows += [(100 + i, f"the order of number {i} goes out, contact us for more") for i in range(200)]
    rows += [(400 + i, f"write to once{i}@example.com about lone{i}") for i in range(3)] + [(500 + i, "copy@example.com has a copied77 text") for i in range(9)]
    got = {r.doc_id: r.clean_text for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), unit="document").collect()}
    assert got[3] == "Contact: [EMAIL] for part3\nthe order of [TERM] goes out"
    assert got[400] == "write to [EMAIL] about lone0" and got[500] == "[EMAIL] has a copied77 text" and got[100] == rows[8][1]


def test_pii_terms_match_brute_force(spark, docs):
    """Term spans over the whole table with planted values, by counting texts one by one."""
    rng = np.random.default_rng(8)
    people = [f"p{k}@corp{k}.org" for k in range(6)]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(240):
        k = int(rng.integers(0, 6))
        bits = [people[k] if rng.random() < 0.8 else "", f"Name{k}x" if rng.random() < 0.9 else "", "common words here", f"town{int(rng.integers(0, 3))}", f"only{i}", people[(k + 1) % 6] if rng.random() < 0.1 else ""]
        texts.append((10_000 + i, "\n".join(b for b in rng.permutation(bits) if b)))
    texts += texts[-30:] + [(20_000, texts[-1][1]), (20_001, None), (20_002, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")

    def spans_of(t):
        return [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in brute_spans(t)]

    def blanked(t):
        for _, s, e in spans_of(t):
            t = t[:s] + " " * (e - s) + t[e:]
        return t

    def keys_of(t):
        out = set()
        for kind, s, e in spans_of(t):
            v, digits = t[s:e].lower(), re.sub("[^0-9]", "", t[s:e])
            out |= {f"value={t[s:e]}", f"kind={kind}"}
            if kind == "email":
                out.add("domain=" + v.split("@")[-1])
                stem = re.sub("[^a-z]+$", "", v.split("@")[0])
                out |= {f"name={stem}"} if len(stem) > 2 else set()
            else:
                out.add({"ip": "net=" + ".".join(v.split(".")[:2]), "card": "issuer=" + digits[:6], "phone": "area=" + digits[:4]}[kind])
        return out

    term = re.compile(r"[^\W_]+")
    seen, within, entity = Counter(), Counter(), Counter()
    distinct = {t for _, t in texts if t is not None}
    for t in distinct:
        seen.update(set(term.findall(t.lower())))
        keys = keys_of(t)
        entity.update(keys)
        within.update((v, w) for v in keys for w in set(term.findall(blanked(t).lower())))
    # All rows without a text are one empty text.
    n = len(distinct | {""})
    # The pairs that chance is shared out to: terms that some entity may reach.
    found = Counter()
    for t in distinct:
        if keys_of(t):
            found.update(set(term.findall(blanked(t).lower())))
    may = {w for w, k in found.items() if k >= pii.SUPPORT and (k + 1) / (seen[w] + 1) >= (pii.SUPPORT / n) ** (1 - pii.DISCLOSURE)}
    least = lambda v: pii.SUPPORT if v.startswith("value=") else pii.SHARED_SUPPORT
    tried = {(v, w): k for (v, w), k in within.items() if k >= least(v) and w in may}
    risky = defaultdict(set)
    for (v, w), both in tried.items():
        p, share = entity[v] / n, both / seen[w]
        kl = share * np.log(share / p) + ((1 - share) * np.log((1 - share) / (1 - p)) if share < 1 else 0)
        if share > p and np.log((both + p) / (seen[w] + 1) / p) >= pii.DISCLOSURE * -np.log(p) and np.log(len(tried)) - seen[w] * kl <= np.log(pii.CHANCE):
            risky[v].add(w)
    assert {"name2x"} <= risky["value=" + people[2]] and {"name2x"} <= risky["domain=corp2.org"]

    def want(t):
        base = spans_of(t or "")
        own = set().union(*[risky[k] for k in keys_of(t or "")])
        own &= set(term.findall(blanked(t or "").lower()))
        more = [("term", m.start(), m.end()) for m in term.finditer(t or "") if m[0].lower() in own and not any(s < m.end() and m.start() < e for _, s, e in base)]
        order = [*pii.KINDS, "term"]
        return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base + more, key=lambda x: (x[1], order.index(x[0]))))

    got = pii.personal_data(frame, clean=False, unit="document").select("text", pii.span_text(F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts) and any("term" in r.s for r in got)
    for r in got:
        assert r.s == want(r.text), r.text[:200]


def test_pii_terms_that_disclose_a_class(spark):
    """No address stands in two texts; a name goes with a domain, and a word with cards of one issuer."""
    rows = [(i, f"Dear Kowalczyk, write to kowalczyk{i}@clinic.org about item{i}") for i in range(50)]
    rows += [(50 + i, f"plain text number {i} about the way to write") for i in range(100)]
    numbers = [next(str(n) for n in range(k, k + 10) if luhn(str(n))) for k in range(4111110000000000, 4111110000000400, 10)]
    rows += [(150 + i, f"Paid by platinumclub {n} on the way") for i, n in enumerate(numbers)]
    got = {r.doc_id: r.clean_text for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), unit="document").collect()}
    assert "Kowalczyk" not in got[7] and "[TERM]" in got[7] and "write to" in got[7] and "about item7" in got[7]
    assert all(got[50 + i] == rows[50 + i][1] for i in range(100))
    cards = [t for i, t in got.items() if i >= 150 and "[CARD]" in t]
    assert len(cards) == 40 and all("platinumclub" not in t and t.endswith("the way") for t in cards)


def test_pii_kept_texts(docs):
    for r in pii.personal_data(docs).collect():
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at : s.start] + f"[{[*pii.KINDS, 'term'][s.kind].upper()}]"
            at = max(at, s.end)
        assert r.clean_text == want + r.text[at:]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity(spark, odd, empty):
    # Of the smaller table's held-out rows only six are toxic, two of them without any insult: too few to judge by.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    rows = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    part = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out]
    score, truth, said = (np.array(v) for v in zip(*part))
    assert auc(score, truth) > 0.9 and (said == truth).mean() > 0.92 and truth[said == 1].mean() > 0.7
    insult = re.compile("loser|idiot|pathetic|scum|worthless|moron|clown|trash|disgusting|stupid")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    named = [r.predicted for r in rows if r.held_out and y[r.doc_id] and insult.search(text[r.doc_id].lower())]
    assert len(named) > 40 and np.mean(named) > 0.95
    # Against a naive scorer: every run of four words, and the words' n-grams one by one.
    for r in rows[:200]:
        m = [np.mean([model.margin[b] for b in toxicity.subwords(w)]) for w in toxicity.words(text[r.doc_id])]
        runs = [sum(m[i : i + 4]) / 4 for i in range(max(1, len(m) - 3))]
        assert r.score == pytest.approx(1 / (1 + np.exp(-model.slope * max(runs) - model.bias)), abs=1e-6)
    # Words before a passage don't change its score.
    plain = max((t for t in text.values() if not insult.search(t.lower())), key=lambda t: -model.scorer()(t)).split()
    for k in range(5):
        assert model.scorer()(" ".join([*plain[:k], "you worthless idiot clown", *plain[:9]])) > 0.5
    other = toxicity.toxicity(odd, model).collect()
    assert len(other) == len(ODD) and all(0 <= r.score <= 1 for r in other) and toxicity.toxicity(empty, model).count() == 0
    # A misspelling shares n-grams with the word that it comes from.
    assert model.word_margin("idiotic") > model.word_margin("onreat") + 0.2 * model.word_margin("idiot")
    flat = toxicity.train(*toxicity.training_rows(empty, labels))
    assert toxicity.toxicity(odd, flat).count() == len(ODD)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
