"""The streaming scorer gives what the batch one gives."""

from pyspark.sql import functions as F

from trustloom.operators.linear import LinearModel
from trustloom.streaming.score import scored, windowed_trust


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 30).alias("ts"),
        F.array((F.col("id") % 7) / 7.0, (F.col("id") % 3) / 3.0).alias("x"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    path = f"file://{tmp_path}/in"
    rows.repartition(3).write.parquet(path)
    model = LinearModel([[1.0, -2.0]], [0.1])
    live = windowed_trust(scored(spark.readStream.schema(rows.schema).parquet(path), model))
    q = live.writeStream.outputMode("complete").format("memory").queryName("trust_out").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start: (r.n, round(r.trust, 9), r.suspects) for r in spark.table("trust_out").collect()}
    want = {r.start: (r.n, round(r.trust, 9), r.suspects) for r in windowed_trust(scored(spark.read.parquet(path), model)).collect()}
    assert got == want and sum(v[0] for v in got.values()) == 200
