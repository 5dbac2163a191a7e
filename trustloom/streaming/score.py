"""Score a stream of rows with a frozen model: trust per row, and drift per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.functions.probes import Probe, check_probe
from trustloom.operators.linear import LinearModel


def scored(rows: DataFrame, model: LinearModel, probe: Probe | str = "margin") -> DataFrame:
    """Add trust to a stream (or frame) with x and y: a projection, so no state is kept."""
    p = check_probe(probe)
    value = p.column(model.score(p.source, F.col("x")), F.col("y")).cast("double")
    return rows.withColumn("trust", value if p.maximize else -value)


def windowed_trust(rows: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows, mean trust and suspects (trust below zero) of each window; state is dropped after the watermark."""
    marked = rows.withWatermark(time, late)
    out = marked.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg("trust").alias("trust"), F.count_if(F.col("trust") < 0).alias("suspects"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "trust", "suspects")
