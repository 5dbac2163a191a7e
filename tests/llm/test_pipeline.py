"""The corpus pipeline against brute force, stage by stage, and its odd cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_components, brute_fp, brute_hits, brute_spans
from trustloom.llm import bpe, decontam, pii, toxicity


def test_stages_match_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    score = toxicity.train(*toxicity.training_rows(docs, labels)).scorer()
    text = {i: t for i, t in text.items() if score(t or "") < 0.5}
    root = brute_components([(i, brute_fp(t)) for i, t in text.items()])
    text = {i: t for i, t in text.items() if root[i] == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = {t: set(decontam.normal_words(t)) for t in items}
    near = lambda t, i: len(words[i] & set(decontam.normal_words(t))) >= 0.5 * len(words[i]) and brute_hits(t, i, decontam.DISTANCE)
    text = {i: t for i, t in text.items() if not any(near(t, x) for x in items)}
    t = Tokenizer.from_file(bpe.default_path())

    def clean(x):
        want, at = "", 0
        for kind, s, e in (p.split(":") for p in brute_spans(x)):
            if int(s) >= at:
                want += x[at : int(s)] + f"[{kind.upper()}]"
            at = max(at, int(e))
        return want + x[at:]

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == text.keys()
    for i, x in text.items():
        ids = t.encode(clean(x), add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "twice the same text here", "en", "a", 1), (2, "twice the same text here", "en", "a", 1), (3, "twice the same text here", "en", "b", 1), (4, "mail a@b.co " + "w " * 9000, "en", "b", 1)]
    odd = spark.createDataFrame([(*r, "c", "c", "c", "c", "c") for r in rows], SCHEMA)
    for frame, n in ((odd, [6, 3, 6, 6, 6]), (odd.limit(0), [0] * 5)):
        for (name, stage), want in zip(corpus_pipeline.STAGES, n):
            out = stage(spark, frame, sf)
            assert out.count() == want, name
            if name != "bpe":
                assert out.columns == frame.columns, name
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, odd, sf).collect()}
    assert kept == {1, 2, 4}
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.replace_personal_data(spark, odd, sf).filter(F.col("doc_id") == 4).collect()}
    assert cleaned[4].startswith("mail [EMAIL] w") and pii.KINDS


def test_stages_tell_rows_of_one_id_apart(spark, sf):
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    prose = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(None, prose("a")), (None, prose("b")), (None, prose("b")), (None, prose("c")), (1, prose("c")), (2, prose("d")), (2, prose("e")), (3, prose("d")), (1, prose("f")), (2, prose("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, prose("a")), (None, prose("b")), (1, prose("c")), (2, prose("d")), (2, prose("e")), (1, prose("f"))}
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    df = spark.createDataFrame([(None, "x " + passage), (None, prose("a")), (1, passage), (1, prose("b")), (1, None), (None, None)], "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.drop_contaminated(spark, df, sf).collect()}
    assert got == {(None, prose("a")), (1, prose("b")), (1, None), (None, None)}


def test_planted_terms_are_replaced_on_the_way(spark, sf, tmp_path):
    """A name that goes with a domain, in documents that all stages keep, is replaced before the ids are made."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [w for r in docs.filter("doc_id < 60").collect() for w in (r.text or "").split() if w.isalpha()]
    prose = lambda: " ".join(rng.choice(some, 40))
    rows = [(10**9 + i, f"{prose()} Zyxwarden {prose()} zed{i}@vault.example.org {prose()}", "en", "planted", 0) for i in range(30)]
    spark.createDataFrame(rows, docs.schema).unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    t, kept = Tokenizer.from_file(bpe.default_path()), [r for r in rows if r[0] in got]
    assert len(kept) > 20
    for i, text, *_ in kept:
        want = text.replace("Zyxwarden", "[TERM]").replace(text.split("@")[0].split()[-1] + "@vault.example.org", "[EMAIL]")
        assert got[i].n_tokens == len(t.encode(want, add_special_tokens=False).ids)
