from pyspark.sql import functions as F

from skeinwork.operators import dedup
from skeinwork.streaming import usage_stream
from tests.conftest import rows


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_first_deliveries_and_counts(spark, sf, tmp_path):
    usage = spark.read.parquet(f"{sf}/usage_events.parquet")
    usage.orderBy("delivery_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage_stream.read_deliveries(spark, str(tmp_path / "in"))
    got = run(spark, usage_stream.first_deliveries(stream, "36500 days"), "firsts", "append")
    key = F.coalesce(dedup.hex_identity(F.col("id")), F.concat(F.lit("#"), F.col("delivery_id")))
    assert got.count() == usage.select(key, "event").distinct().count()
    batch = usage.groupBy(F.date_trunc("day", "delivered_at").alias("start"), "state").agg(F.count(F.lit(1)).alias("deliveries"), F.sum("bytes").alias("bytes"))
    assert rows(run(spark, usage_stream.counts(stream), "counted", "complete"), "state", "deliveries", "bytes") == rows(batch, "state", "deliveries", "bytes")
