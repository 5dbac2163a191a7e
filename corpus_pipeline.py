"""Corpus pipeline: toxicity, near-duplicates, decontamination, personal data, BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import bpe, decontam, pii, simhash, toxicity
from trustloom.llm.common import row_key, shared_dir, stored
from trustloom.sources.store import remove, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from labelled rows that aren't held out.

    Null and empty texts have the score of no words and stay or go by it; rows
    that repeat share their fate. Without labels of both kinds the score is the
    share of toxic labels, and all stay unless most labels are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    return toxicity.toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays, and one of rows that repeat as they are.

    Rows are told apart by id and text: null ids come last, equal ids go by a hash of both.
    Null, empty and blank texts are duplicates of one another, as their fingerprints are.
    """
    key = row_key("doc_id", "text")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key"))
    found = stored(simhash.near_duplicates(docs.select(ident.alias("doc_id"), "text")).select(F.col("doc_id.key").alias("key"), F.col("component_id.key").alias("least")), "found")
    gone = stored(found.filter("key <> least").select(F.col("key").alias("_gone")).distinct(), "gone")
    again = stored(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_again")), "again")
    # Merge joins at every size: the stored keys grow with the documents, and texts are dealt out by key once for all three.
    rows = docs.withColumn("_key", key)
    gone, again = gone.hint("merge"), again.hint("merge")
    kept = rows.join(gone, rows["_key"] == gone["_gone"], "left_anti")
    same = kept["_key"] == again["_again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_key"])).drop("_key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none, and repeated rows share their fate."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that disclose them, become their kind in brackets.

    No row goes: null and empty texts stay as they are, and n_chars follows the new text.
    """
    out = pii.personal_data(docs, unit="document")
    text = F.col("clean_text")
    return out.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text: a row per row, null texts as empty ones."""
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: Several stages can't be written in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage stored, and its input once it is done, is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
