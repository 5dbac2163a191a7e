"""The queries opN_<name> over the whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import bpe, classifier, decontam, divergence, kdshard, license, pii, quality, rans, simhash, spelling, toxicity, warc
from trustloom.llm.common import shared_dir, stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_t(spark, sf_dir, "documents"), clean=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_removed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.license_scan(_t(spark, sf_dir, "documents"))
    return out.withColumn("dice", F.round("dice", 6))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write_warc(_t(spark, sf_dir, "pages"), path)
    rows = warc.read_warc(spark, path)
    sure = F.when(F.coalesce("sound", F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload was not read back as it was written")).cast("long"))
    return rows.select("page_id", sure.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshard.kd_shards(_t(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_t(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_hits(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(_t(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(_t(spark, sf_dir, "documents").select("doc_id", "text"), clean=False, unit="document")
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[n(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(*toxicity.training_rows(docs, _t(spark, sf_dir, "labels")))
    out = toxicity.toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(classifier.with_statistics(_t(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    out = classifier.score(rows, classifier.train(rows, _t(spark, sf_dir, "labels")))
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_t(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_t(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules, op2_license_scan, op3_warc, op4_kd_shards, op5_bpe, op6_decontaminate, op7_rans, op8_simhash, op9_pii, op10_toxicity,
    op11_quality_classifier, op12_source_divergence, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}

_RE_BLANK = r"[\x20\x09-\x0D]+"

_OP1 = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_RE_BLANK}'), lambda x: x <> '') as w
  from documents
), l as (
  select doc_id, source, unnest(string_split(t, chr(10))) as line from d
), n as (
  select doc_id, source, line,
    lower(regexp_replace(regexp_replace(line, '{_RE_BLANK}', ' ', 'g'), '^ | $', '', 'g')) as norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')
), f as (
  select source, norm from n group by source, norm having count(distinct doc_id) > {quality.MAX_DOCS}
), gone as (
  select n.doc_id, sum(n.n) as lost from n join f on n.norm = f.norm and n.source is not distinct from f.source group by n.doc_id
), lines as (
  select doc_id, count(*) - count(distinct line) as dup from n group by doc_id
), win as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from d
), win3 as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from win
), rep as (
  select doc_id, count(distinct p) as r from (select doc_id, unnest([i, i + 1, i + 2]) as p from win3 where c > 1) group by doc_id
), m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(lines.dup, 0)::bigint as n_dup_lines, coalesce(rep.r, 0)::bigint as n_repeat_words, coalesce(gone.lost, 0)::bigint as n_words_removed
  from d left join lines using (doc_id) left join rep using (doc_id) left join gone using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words_removed > 0 and n_words - n_words_removed < {quality.MIN_KEPT} * n_words) as kept,
  n_words_removed
from m
"""


def _op2() -> str:
    lists = []
    for name, texts in license.TEMPLATES.items():
        for t in texts:
            w = license.normal(t)
            pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
            lists.append(f"('{name}', [{', '.join(repr(p) for p in pairs)}])")
    th = license.THRESHOLD
    return rf"""
with tpl(license, b) as (values {', '.join(lists)}),
d as (select doc_id, coalesce(text, '') as t from documents),
s as (
  select doc_id, unnest(list_distinct(string_split(t, chr(10)) || regexp_split_to_array(t, '{license.SENTENCE}') || case when contains(t, chr(10)) then [t] else [] end
    || list_filter(regexp_split_to_array(t, '{license.PARAGRAPH}'), lambda x: contains(x, chr(10))))) as seg from d
), w as (
  select doc_id, seg, list_filter(regexp_split_to_array(lower(seg), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from s
), p as (
  select doc_id, seg, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from w where length(seg) >= 3 and len(w) >= 2
), x as (
  select doc_id, seg, license, 2.0 * len(list_intersect(p, b)) / (len(p) + len(b)) as dice
  from p, tpl where len(p) between {th} / (2 - {th}) * len(b) and (2 - {th}) / {th} * len(b)
)
, g as (
  select doc_id, license, max(dice) as dice, count(distinct seg)::bigint as n_segments from x where dice >= {th} group by doc_id, license
)
select doc_id, license, round(dice, 6)::double as dice, n_segments, dice = max(dice) over (partition by doc_id) as best from g
"""

_OP12 = rf"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), c as (
  select lang, source, term, count(*) as n from t group by all
), k as (
  select lang, term from t group by lang, term having count(distinct doc) >= {divergence.MIN_DOCS}
), g as (
  select distinct lang, source from d
), v as (
  select lang, count(k.term) as v from (select distinct lang from d) left join k using (lang) group by lang
), x as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n from g join k using (lang) left join c using (lang, source, term)
), y as (
  select *, sum(n) over (partition by lang, source) as whole, sum(n) over (partition by lang, term) as lang_n, sum(n) over (partition by lang) as lang_whole from x join v using (lang)
), p as (
  select lang, source, term, n, (1 + 1000000000 * (n + 2) // (whole + 2 * v))::bigint as p, (1 + 1000000000 * (lang_n + 2) // (lang_whole + 2 * v))::bigint as q from y
), pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((pa.p - pb.p) * (pa.p - pb.p) // (pa.p + pb.p)), 0)::bigint as value
  from g as a join g as b on a.lang = b.lang and a.source <> b.source
  left join p as pa on pa.lang = a.lang and pa.source = a.source
  left join p as pb on pb.lang = b.lang and pb.source = b.source and pb.term = pa.term
  group by all
), term as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pair union all select * from term)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {divergence.TOP}
"""

#: The CRC-32 is computed by its bits: its table by rule, then a step a byte.
_OP13 = r"""
with recursive crc(t) as (
  select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))
), r as (
  select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents
), o as (
  select doc_id, run, count(*) as n, hex(doc_id || ':' || run) as bytes from r where length(run) >= 7 group by doc_id, run
), h as (
  select run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::bigint), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) as h from o, crc
), w as (
  select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h
), dict as (
  select word, sum(n)::bigint as n from w where length(word) >= 7 group by word having sum(n) >= 2
), gap as (
  select word, n, unnest(range(1, length(word) + 1)) as i from dict
), cut as (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from gap
), links as (
  select distinct a.word, b.word as near, b.n as near_n from cut as a join cut as b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union all select distinct cut.word, dict.word, dict.n from cut join dict on cut.rest = dict.word
  union all select distinct dict.word, cut.word, cut.n from cut join dict on cut.rest = dict.word
), best as (
  select word, count(*) as n_near, (list(near order by near_n desc, near))[1] as near, max(near_n) as near_n from links group by word
), f as (
  select dict.word, dict.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * dict.n then near end as form, case when near_n >= 10 * dict.n then near_n end as form_n from dict left join best using (word)
), path(word, now) as (
  select word, word from f union all select path.word, f.form from path join f on path.now = f.word where f.form is not null
), ends as (
  select path.word, path.now as root from path join f on path.now = f.word where f.form is null
)
select f.word, f.form, ends.root, f.n, f.n_near, f.form_n from f join ends using (word)
"""

ORACLE_SQL = {
    "op1_quality_rules": _OP1,
    "op2_license_scan": _op2(),
    "op12_source_divergence": _OP12,
    "op13_spelling_variants": _OP13,
}
