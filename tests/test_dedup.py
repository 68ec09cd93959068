from pyspark.sql import functions as F

from skeinwork.operators import dedup
from tests.conftest import rows

SCHEMA = "delivery_id bigint, id string, event string, coll_s bigint, coll_ns int, extra string"
A = "0123456789abcdef0123456789abcdef"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], SCHEMA)


def test_spellings_of_one_id_and_null_ids(spark):
    df = frame(spark, [
        (1, A, "start", 9, 0), (2, "{" + A.upper() + "}", "start", 8, 5), (3, A[:8] + "-" + A[8:], "start", 8, 4),
        (4, A, "finish", 1, 1), (5, None, "start", 1, 1), (6, None, "start", 1, 1), (7, A[:-1], "start", 0, 0), (8, A[:-1], "start", 0, 0),
    ])
    assert rows(dedup.dropped_deliveries(df)) == [(1,), (2,)]


def test_nulls_come_last_and_ties_go_to_the_first_delivery(spark):
    df = frame(spark, [(1, A, "start", None, None), (2, A, "start", 5, None), (3, A, "start", 5, 7), (4, A, "start", 5, 7)])
    assert rows(dedup.kept_deliveries(df), "delivery_id") == [(3,)]


def test_empty_table_and_extra_columns(spark):
    assert dedup.dropped_deliveries(frame(spark, [])).count() == 0
    df = frame(spark, [(1, A, "start", 1, 1)]).withColumn("k0", F.lit(1))
    assert dedup.kept_deliveries(df).columns == df.columns


def test_a_hot_message(spark):
    df = spark.range(3000).select(
        F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 == 0, F.lit(A)).otherwise(F.md5(F.col("id").cast("string"))).alias("id"),
        F.lit("start").alias("event"), (F.lit(5000) - F.col("id")).alias("coll_s"), F.lit(0).alias("coll_ns"),
    )
    assert dedup.dropped_deliveries(df).count() == 999
    plan = dedup.kept_deliveries(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the shuffle


def test_batches_meet_stored_keys(spark):
    key, order = dedup.message_key(), dedup.message_order()
    old = frame(spark, [(1, A, "start", 1, 1), (2, None, "start", 1, 1)])
    new = frame(spark, [(3, A.upper(), "start", 0, 0), (4, A, "finish", 3, 3), (5, A, "finish", 2, 2), (6, None, "start", 1, 1)])
    stored = dedup.stored_keys(dedup.keep_first(old, key, order), key)
    assert rows(dedup.accept_batch(new, stored, key, order), "delivery_id") == [(5,), (6,)]
