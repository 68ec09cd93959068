"""Queries of the general data problems 1 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, drift, hierarchy, nested, references, snapshots
from ..session import materialize, table

#: Deliveries from here on are the new batches of ``p1_batches``, those before it the store.
BATCH_CUT = "2025-01-01 00:00:00"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dropped_deliveries(table(spark, d, "usage_events"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.kept_deliveries(table(spark, d, "usage_events")).select("delivery_id", "event", "batch")


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of the new batches that are admitted against what was stored before them."""
    usage = table(spark, d, "usage_events")
    cut = F.lit(BATCH_CUT).cast("timestamp_ntz")
    key, order = dedup.message_key(), dedup.message_order()
    before, after = usage.where(F.col("delivered_at") < cut), usage.where(F.col("delivered_at") >= cut)
    stored = dedup.stored_keys(dedup.keep_first(before, key, order), key)
    return dedup.accept_batch(after, stored, key, order).select("delivery_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "usage_records"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one shape, a typed column for each field."""
    records = table(spark, d, "usage_records")
    parsed = materialize(drift.parse(records, True), "parsed")  # payloads are parsed once
    return drift.typed_table(records, materialize(drift.schema_changes(records, parsed), "changes"), parsed)


def p2_casts(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "usage_records")
    parsed = materialize(drift.parse(records, True), "parsed")
    return drift.failed_casts(records, materialize(drift.schema_changes(records, parsed), "changes"), parsed)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.current_parents(table(spark, d, "raw_edges")))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(hierarchy.current_parents(table(spark, d, "raw_edges")), paths=True)
    return tree.select("node", F.array_join("path", "\n").alias("full_path"), "depth")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.current_parents(table(spark, d, "raw_edges")), paths=True))


def p3_closure(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of an ancestor and a node below it, on and below loops too: impact_radius many for each ancestor."""
    return p3_descendants(spark, d).select("ancestor", "descendant")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "raw_edges"), table(spark, d, "findings"), table(spark, d, "nodes"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p4_found(spark, d))


def p4_composite(spark: SparkSession, d: str) -> DataFrame:
    """Links of a lock whose (snapshot, target, target's hash) no lock node has, under each way to match nulls."""
    links = table(spark, d, "lock_edges").select("snapshot_seq", "target", "target_hash")
    held = table(spark, d, "lock_nodes").select("snapshot_seq", "path", "hash")
    keys = {"snapshot_seq": "snapshot_seq", "target": "path", "target_hash": "hash"}
    found = [references.orphans(links, held, keys, m).withColumn("match", F.lit(m)) for m in ("simple", "partial", "full")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("match", "snapshot_seq", "target", "target_hash").agg(F.count(F.lit(1)).alias("links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.lock_changes(table(spark, d, "lock_nodes"), table(spark, d, "lock_edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_rows(nested.occurrences(table(spark, d, "usage_events")))


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.occurrences(table(spark, d, "usage_events"))).select("identity", "child", "occurrences")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records(table(spark, d, "usage_events"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_kept, p1_batches, p2_found, p2_table, p2_casts, p3_found, p3_paths, p3_descendants, p3_closure,
        p4_found, p4_report, p4_composite, p5_found, p6_found, p6_objects, p6_records,
    )
}
