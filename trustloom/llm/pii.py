"""Personal data: base patterns and information-theoretic sanitisation.

Built from DataFrame functions alone. The base finds e-mail, IP, card and phone
spans. The method then protects each value found, what values share (a domain, a name, an
issuer, a net, an area) and their kind; counts over the whole corpus in how many
texts terms stand with such an entity and in how many at all; and adds spans for
terms that disclose one: their pointwise mutual information with it reaches
``disclosure`` times the entity's information.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import row_key, stored

#: Share of an entity's information content that a term may disclose.
DISCLOSURE = 0.8
#: Least distinct texts in which the term was seen with the entity.
SUPPORT = 3
#: The same where the entity is what values share: that they belong together is itself a guess.
SHARED_SUPPORT = 5
#: Most chance, by a bound for independent terms and entities and over all pairs, of meeting as often as they do.
CHANCE = 1e-3

#: The base patterns, in the order of their kinds. They match
#: what the plain forms match: possessive and bounded repeats, with a look
#: behind, keep the time linear in long runs of the same characters.
KINDS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a row must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
TERM = r"[\p{L}\p{N}]+"


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(match, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda span: _valid(kind, span["value"])


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _placed(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches with their places in code points: the pieces between them give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    pieces = F.split(text, pattern, -1)
    return F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.array_append(a["spans"], F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"))).alias("spans"),
        ),
        lambda a: a["spans"],
    )


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add spans: array of struct(start, kind, end, value), by start and then kind.

    start and end count code points; kind indexes :data:`KINDS`. Null and empty
    texts have none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPANS)
    digit = F.col(text).rlike("[0-9]")
    out = docs.withColumn("_digit", F.coalesce(digit, F.lit(False)))
    for k, (kind, pattern) in enumerate(KINDS.items()):
        may = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            may = may & F.col("_digit")
        # Few rows hold a match at all: a search that stops at the first comes before the full one.
        out = out.withColumn(f"_{kind}", F.when(may & t.rlike(pattern), F.filter(_placed(t, pattern, k), _checker(kind))).otherwise(none))
    out = out.withColumn("spans", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    return out.drop("_digit", *[f"_{k}" for k in KINDS])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def entity_keys(spans: Column) -> Column:
    """What a document's spans are protected as, without repeats: each value, what it shares with others, and its kind.

    An address shares its domain and the name in front of its numbers, an IP
    number its first two parts, a card its issuer's six digits, a phone number
    its first four digits. A term may give away any of these, where single
    values are too rare to tell.
    """
    names = F.array(*[F.lit(k) for k in KINDS])

    def of(s: Column) -> Column:
        v, kind, digits = F.lower(s["value"]), F.get(names, s["kind"]), F.regexp_replace(s["value"], "[^0-9]", "")
        stem = F.regexp_replace(F.substring_index(v, "@", 1), "[^a-z]+$", "")
        email = F.array(F.concat(F.lit("domain="), F.substring_index(v, "@", -1)), F.when(F.length(stem) > 2, F.concat(F.lit("name="), stem)))
        shared = (
            F.when(s["kind"] == 0, email)
            .when(s["kind"] == 1, F.array(F.concat(F.lit("net="), F.substring_index(v, ".", 2))))
            .when(s["kind"] == 2, F.array(F.concat(F.lit("issuer="), F.substring(digits, 1, 6))))
            .otherwise(F.array(F.concat(F.lit("area="), F.substring(digits, 1, 4))))
        )
        return F.concat(F.array(F.concat(F.lit("value="), s["value"]), F.concat(F.lit("kind="), kind)), shared)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(spans, of))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, unit: str = "line") -> DataFrame:
    """(_row, key, term): the terms of each text that disclose a protected entity (:func:`entity_keys`) which it holds.

    ``found`` holds the documents with entities: _text, spans; _row is a key of
    the text. c(e), c(t) and c(e, t) count distinct texts; a term counts with an
    entity where it stands in the same ``unit`` ("line" or "document") outside
    all base spans, and needs ``support`` texts, as the entity does, or
    SHARED_SUPPORT where the entity isn't a value itself. With q =
    (c(e, t) + c(e) / N) / (c(t) + 1), the share of the term's texts that hold
    the entity drawn towards its share p of all N texts, the term discloses
    log(q / p) of the entity's information log(1 / p). Chance is excluded by the
    binomial bound exp(-c(t) KL), times the pairs looked at.

    Terms that can't reach the threshold with any entity go before pairs are
    made: a text meets its own entities with the few terms that are left.
    """
    found = found.withColumn("_row", row_key("_text")).dropDuplicates(["_row"])
    seen_in = found.select("_row", F.explode(entity_keys(F.col("spans"))).alias("key"))
    needed = F.when(F.startswith("key", F.lit("value=")), support).otherwise(max(support, SHARED_SUPPORT))
    entities = stored(seen_in.groupBy("key").agg(F.count("*").alias("with")).filter(F.col("with") >= needed), "entities")
    none = found.select("_row", F.lit("").alias("key"), F.lit("").alias("term")).limit(0)
    if entities.isEmpty():
        return none
    # Of each term: texts that hold it, each text once, and how many of these hold an entity.
    texts = docs.withColumn("_hash", row_key(text))
    copies = stored(texts.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    own = lambda d: d.select(F.explode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    once = texts.join(copies, "_hash", "left_anti")
    again = texts.join(copies, "_hash", "left_semi").groupBy("_hash").agg(F.first(text).alias(text))
    total = texts.agg(F.count("*").alias("n_rows")).crossJoin(copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("more"))).select((F.col("n_rows") - F.col("more")).alias("total"))
    blank = stored(found.select("_row", "spans", blanked(F.col("_text"), F.col("spans")).alias("_blank")), "blank")
    held_by = blank.select(F.explode(_terms(F.col("_blank"))).alias("term")).groupBy("term").agg(F.count("*").alias("met")).filter(F.col("met") >= support)
    seen = own(once).unionByName(own(again)).groupBy("term").agg(F.count("*").alias("in_docs"))
    # An entity of p texts in N asks for a share of the term's texts over p ** (1 - disclosure), the rarest for the least.
    least = F.pow(F.lit(float(support)) / F.col("total"), F.lit(1.0 - disclosure))
    wanted = seen.join(held_by, "term").crossJoin(F.broadcast(total)).filter((F.col("met") + 1.0) / (F.col("in_docs") + 1.0) >= least)
    wanted = stored(wanted.select("term", "in_docs", "total"), "wanted")
    if wanted.isEmpty():
        return none
    if unit == "line":
        rows = blank.select("_row", "_blank", F.explode("spans").alias("s"))
        head = F.substring_index(F.substr("_blank", F.lit(1), F.col("s.start")), "\n", -1)
        tail = F.substring_index(F.substr("_blank", F.col("s.end") + 1), "\n", 1)
        units = rows.select("_row", entity_keys(F.array("s")).alias("_keys"), F.concat_ws(" ", head, tail).alias("_unit"))
    else:
        units = blank.select("_row", entity_keys(F.col("spans")).alias("_keys"), F.col("_blank").alias("_unit"))
    units = units.select("_row", "_keys", F.explode(_terms(F.col("_unit"))).alias("term")).join(wanted.select("term"), "term", "left_semi")
    met = units.select("_row", "term", F.explode("_keys").alias("key")).join(entities, "key", "left_semi").distinct()
    met = stored(met, "met")
    both = stored(met.groupBy("key", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= needed), "pairs")
    tests = both.agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    scored = both.join(wanted, "term").join(entities, "key").crossJoin(F.broadcast(tests))
    p, share = F.col("with") / F.col("total"), F.col("both") / F.col("in_docs")
    scored = scored.withColumns({"p": p, "share": share, "q": (F.col("both") + p) / (F.col("in_docs") + 1.0)})
    rest = F.when(F.col("share") < 1, (1 - F.col("share")) * F.log((1 - F.col("share")) / (1 - F.col("p")))).otherwise(0.0)
    accident = F.log("tests") - F.col("in_docs") * (F.col("share") * F.log(F.col("share") / F.col("p")) + rest)
    sure = (F.col("p") < 1) & (F.col("share") > F.col("p"))
    risky = scored.filter(sure & (F.log(F.col("q") / F.col("p")) >= disclosure * -F.log("p")) & (accident <= F.log(F.lit(CHANCE))))
    return met.join(stored(risky.select("key", "term"), "risky"), ["key", "term"], "left_semi").select("_row", "key", "term")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, clean: bool = True, unit: str = "line") -> DataFrame:
    """``docs`` with base_spans, spans (arrays) and, with ``clean``, clean_text.

    Null and empty texts have no spans; a null text stays null. Texts of any
    length are read whole. Rows that agree in id and text get equal results, a
    row each. In clean_text each span becomes its kind in brackets; spans that
    overlap become the first one's, of those that begin together the first kind's.
    Input columns that bear one of the added names are replaced, and those whose
    names begin with an underscore are left out. An empty table gives no rows.
    ``unit`` is where a term must stand with a value to be counted: "line" or
    "document". Terms that disclose alike are all replaced; no list of terms is
    kept, each text has those of its own words.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_") or c in ("base_spans", "spans", "clean_text")])
    based = base_spans(docs.withColumn("_row", row_key(doc_id, text)), text).withColumnRenamed("spans", "base_spans")
    found = stored(based.filter(F.size("base_spans") > 0).select("_row", F.col(text).alias("_text"), F.col("base_spans").alias("spans")).dropDuplicates(["_row"]), "found")
    # The terms of a text: those that disclose an entity it holds, anywhere in it.
    risky = disclosing_terms(docs, found, text, disclosure, support, unit).groupBy("_row").agg(F.collect_set("term").alias("_terms"))
    placed = found.join(risky.withColumnRenamed("_row", "_of"), row_key("_text") == F.col("_of"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort("_terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    placed = placed.withColumn("_pattern", pattern)
    added = F.filter(_placed(F.col("_text"), F.col("_pattern"), len(KINDS)), lambda a: ~F.exists("spans", lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"])))
    placed = stored(placed.select(F.col("_row"), added.alias("_added")), "added")
    out = based.join(placed, "_row", "left")
    out = out.withColumn("spans", F.when(F.col("_added").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "_added")))).drop("_row", "_added")
    return out.withColumn("clean_text", sanitised(F.col(text), F.col("spans"))) if clean else out


def blanked(text: Column, spans: Column) -> Column:
    """The text with all characters within spans as spaces; places stay as they are."""
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["parts"], F.array(F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0))))).alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)),
    )
    return built


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "term"]])
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("parts")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)),
    )
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(built)
