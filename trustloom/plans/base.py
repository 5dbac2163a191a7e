"""The frames that queries start from, and the literal models that they score with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.operators.linear import LinearModel

STOP = ["the", "le", "des", "der", "und", "el", "los"]
LANGS = ["de", "en", "es", "fr"]

#: Multiclass literal model: a row of weights for each language.
COEF = [
    [-0.5, -0.25, 0.5, 2.0, 1.5, -0.5, -1.0],
    [2.5, -0.5, -0.75, -0.5, -1.0, -0.25, -0.5],
    [-0.75, 0.25, -0.5, -1.0, -0.5, 2.0, 1.75],
    [-0.5, 1.5, 1.25, -0.75, -1.25, 0.5, -0.25],
]
INTERCEPT = [-0.1, 0.3, -0.2, 0.05]
MULTI = LinearModel(COEF, INTERCEPT, "log_loss", 0.5)

#: Binary literal model on two features.
BINARY = LinearModel([[0.8, -0.6]], [0.4], "log_loss", 1.0)
BINARY_FLAT = LinearModel([[0.8, -0.6]], None, "log_loss", 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (stop-word indicators), y (language, every fiftieth flipped to the next), flipped."""
    low = F.lower("text")
    x = F.array(*[F.when(F.contains(low, F.lit(f" {w} ")), 1.0).otherwise(0.0) for w in STOP])
    y = F.array_position(F.array(*[F.lit(v) for v in LANGS]), F.col("lang")).cast("int") - 1
    flipped = F.pmod(F.col("doc_id") * 7919 + 13, F.lit(50)) == 0
    rows = E.held(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", y.alias("_y"), flipped.alias("flipped")), x=x)
    return rows.select("id", "x", F.when(F.col("flipped"), F.pmod(F.col("_y") + 1, F.lit(4))).otherwise(F.col("_y")).alias("y"), "flipped")


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (two features), y: the quality label of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    x = F.array(F.col("n_chars") / F.lit(10000.0), F.pmod(F.col("doc_id"), F.lit(97)) / F.lit(97.0))
    return rows.select(F.col("doc_id").alias("id"), x.alias("x"), F.col("quality").cast("int").alias("y"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (size), y (price): one-feature regression."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / F.lit(50.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe stream: users as rows, their events in order as members, oob by event number."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    from pyspark.sql import Window

    member = F.row_number().over(Window.partitionBy("user_id").orderBy(order)).cast("int")
    return e.select(
        F.col("user_id").alias("id"),
        member.alias("member"),
        (F.pmod(F.col("event_id"), F.lit(3)) == 0).alias("oob"),
        (1.0 + F.pmod(F.col("event_id"), F.lit(4))).alias("weight"),
        F.array(F.col("value"), F.col("value") * F.col("value") / 100.0).alias("score"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums agree."""
    def r(f) -> Column:
        kind = f.dataType.simpleString()
        if kind == "double":
            return F.round(f.name, digits).alias(f.name)
        if kind == "array<double>":
            return F.transform(f.name, lambda v: F.round(v, digits)).alias(f.name)
        return F.col(f.name)

    return df.select(*[r(f) for f in df.schema.fields])
