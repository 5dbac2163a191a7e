"""Tables in the folder that the driver and all executors share: lineage cuts, and known sizes for the planner."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one in spark.checkpoint.dir.

    Only where the setting is absent and the master is local (tests, a notebook)
    a local temporary folder is made and set for the session; on a cluster
    without the setting this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trustloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/trustloom-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


#: Folders made within each open scope.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored within is removed at the end, on success or failure.

    Results are lazy and read stored tables, so they must be written or
    collected inside. Without a scope tables stay until the folder is cleared.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; one that isn't there is no fault."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table any executor can read again, and gives the
    planner the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def before(counts: DataFrame, count: str, order: str, by: str | None = None) -> Column:
    """Of a row a range (few rows): the sum of ``count`` over the ranges in front of it."""
    keys = [by] if by else []
    return F.coalesce(F.sum(count).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranged(df: DataFrame, *keys: str, name: str = "_range") -> DataFrame:
    """``df`` stored in ranges of ``keys`` of about equal rows, numbered in order by ``name``.

    The bounds are drawn from the rows, so ids or scores that cluster make no
    large range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()), "ranged")
