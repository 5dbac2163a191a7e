"""Readers of weak-supervision datasets, and the sink of trust tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.decide import keyword_votes, priority_votes

SPLITS = ("train", "validation", "test", "all")


def wrench(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """id, text, y, votes from ``<split>.json``: an object of id -> {label, weak_labels, data: {text}}."""
    if split not in SPLITS:
        raise ValueError(f"split is one of {SPLITS}")
    files = {"train": ["train"], "validation": ["valid"], "test": ["test"], "all": ["train", "valid", "test"]}[split]
    kind = "map<string, struct<label:int, weak_labels:array<int>, data:struct<text:string>>>"
    rows = spark.read.text([f"{folder}/{f}.json" for f in files], wholetext=True)
    rows = rows.select(F.explode(F.from_json("value", kind)).alias("key", "v"))
    return rows.select(F.col("key").cast("long").alias("id"), F.col("v.data.text").alias("text"), F.col("v.label").alias("y"), F.col("v.weak_labels").alias("votes"))


def weasel(spark: SparkSession, path: str, fold: str | None = "train", text: str = "text", label: str = "label") -> DataFrame:
    """text, y from a CSV file with a fold column; labels of -1 count as class 0."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if fold is not None and "fold" in rows.columns:
        rows = rows.filter(F.col("fold") == fold)
    y = F.col(label).cast("int")
    return rows.select(F.col(text).alias("text"), F.when(y == -1, 0).otherwise(y).alias("y"))


def news(spark: SparkSession, path: str, label: str = "label", text: str = "news_title") -> DataFrame:
    """text, label from a tab-separated file."""
    return spark.read.csv(path, header=True, sep="\t").select(F.col(text).alias("text"), F.col(label).alias("label"))


def lexicon(spark: SparkSession, path: str) -> list[str]:
    """Keywords of a text file, a line each: a rule of one labelling function, small by nature."""
    return [r["value"] for r in spark.read.text(path).filter(F.trim("value") != "").collect()]


def rules(spark: SparkSession, files: Mapping[int | str, str]) -> dict[int | str, list[str]]:
    """Labelling rules: the keywords of a lexicon file for each label, in the files' order."""
    return {label: lexicon(spark, path) for label, path in files.items()}


def voted(rows: DataFrame, by: Mapping[int | str, list[str]], first: Mapping[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """Add votes, one a keyword: -1 where it abstains; keywords in ``first`` come before the others and silence them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumn("votes", keyword_votes(t, dict(by)) if first is None else priority_votes(t, dict(first), dict(by)))


def write_trust(df: DataFrame, path: str) -> None:
    """Trust tables as Parquet, for splitters run later with other settings."""
    df.write.mode("overwrite").parquet(path)
