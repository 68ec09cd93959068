"""Usage deliveries as a stream: first copies of each message, and counts in windows of event time.

The batch operators are the reference results; a stream keeps state only as far back as its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import hex_identity

SCHEMA = (
    "delivery_id bigint, batch string, delivered_at timestamp_ntz, id string, event string, payload string, bytes bigint, "
    "entry_s bigint, entry_ns int, coll_s bigint, coll_ns int, state string"
)


def read_deliveries(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Deliveries from Parquet files as they arrive in a folder, with event time as ``at``."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("at", F.col("delivered_at").cast("timestamp"))


def first_deliveries(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first delivery of each message to arrive; ids of more than ``delay`` ago are forgotten.

    Deliveries without an identity are passed on as they are copies of nothing: their key is their own.
    """
    key = F.coalesce(F.concat_ws("\u0001", hex_identity(F.col("id")), F.when(hex_identity(F.col("id")).isNotNull(), F.col("event"))), F.lit(""))
    own = F.concat(F.lit("#"), F.col("delivery_id").cast("string"))
    keyed = stream.withColumn("message", F.when((key == "") | F.col("event").isNull(), own).otherwise(key))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["message"])


def counts(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Deliveries and bytes by window of event time and state; later rows than ``delay`` are dropped."""
    return (
        stream.withWatermark("at", delay).groupBy(F.window("at", window).alias("w"), "state")
        .agg(F.count(F.lit(1)).alias("deliveries"), F.sum("bytes").alias("bytes"))
        .select(F.col("w.start").alias("start"), "state", "deliveries", "bytes")
    )
