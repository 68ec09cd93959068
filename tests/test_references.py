from datetime import datetime

import pytest

from skeinwork.operators import references
from tests.conftest import rows

D = datetime


def test_null_masks_and_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "q"), (4, None, None), (5, "b", "x"), (5, "b", "x")], "n int, r1 string, r2 string")
    parents = spark.createDataFrame([("a", "x"), ("c", "y")], "k1 string, k2 string")
    cols = {"r1": "k1", "r2": "k2"}
    found = {m: rows(references.orphans(refs, parents, cols, m), "n") for m in ("simple", "partial", "full")}
    assert found["simple"] == [(5,), (5,)]
    assert found["partial"] == [(3,), (5,), (5,)]
    assert found["full"] == [(2,), (3,), (5,), (5,)]
    with pytest.raises(ValueError):
        references.orphans(refs, parents, cols, "some")


def test_lifetimes_reasons_and_exempt_values(spark):
    nodes = spark.createDataFrame([
        ("gone", D(2024, 1, 1), D(2024, 2, 1)), ("gone", D(2024, 1, 1), D(2024, 2, 1)), ("gone", D(2024, 3, 1), D(2024, 4, 1)), ("here", D(2024, 1, 1), None), (None, D(2024, 1, 1), None),
    ], "path string, first_seen timestamp_ntz, deleted_at timestamp_ntz")
    at = D(2024, 2, 15)
    edges = spark.createDataFrame([
        (1, "here", "gone", at), (2, "nowhere", "mailto:x", at), (3, "here", "HTTPS://x", D(2023, 1, 1)), (4, None, "", at), (5, "gone", "gone", D(2024, 2, 1)),
        (6, "gone", "here", D(2024, 3, 1)), (7, "nowhere", "here", None), (1, "here", "gone", at), (8, "TEL:1", "URN:x", at),
    ], "edge_id bigint, source string, target string, seen_at timestamp_ntz")
    findings = spark.createDataFrame([(1, None, "lost", at)], "finding_id bigint, subject string, target string, found_at timestamp_ntz")
    assert rows(references.orphan_references(edges, findings, nodes)) == [
        ("findings", 1, "target", "missing", "2024-02"), ("raw_edges", 1, "target", "deleted", "2024-02"), ("raw_edges", 1, "target", "deleted", "2024-02"),
        ("raw_edges", 2, "source", "missing", "2024-02"), ("raw_edges", 3, "source", "late", "2023-01"), ("raw_edges", 5, "source", "deleted", "2024-02"),
        ("raw_edges", 5, "target", "deleted", "2024-02"), ("raw_edges", 7, "source", "missing", None),
    ]


def test_empty_tables(spark, sf):
    edges = spark.createDataFrame([], "edge_id bigint, source string, target string, seen_at timestamp_ntz")
    findings = spark.createDataFrame([], "finding_id bigint, subject string, target string, found_at timestamp_ntz")
    nodes = spark.createDataFrame([], "path string, first_seen timestamp_ntz, deleted_at timestamp_ntz")
    assert references.orphan_references(edges, findings, nodes).count() == 0


def test_a_path_that_a_third_refer_to_is_split(spark):
    from pyspark.sql import functions as F

    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        path = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 1000))
        refs = spark.range(60_000, numPartitions=4).select(F.xxhash64("id").alias("ref"), path.alias("path"), F.lit(D(2024, 2, 1)).cast("timestamp_ntz").alias("at"))
        nodes = spark.createDataFrame([("hot", D(2024, 1, 1), D(2024, 1, 2)), ("p1", D(2024, 1, 1), None)], "path string, first_seen timestamp_ntz, deleted_at timestamp_ntz")
        lost = references.orphans(refs, nodes, {"path": "path"}, "simple", "at", ("first_seen", "deleted_at"))
        assert len(lost.collect()) == 60_000 - refs.where("path = 'p1'").count()
        assert "skew=true" in lost._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
