"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _set_digest(*cols):
    """Two 64-bit hashes of a row, to be combined by XOR over a set of distinct rows."""
    return [F.xxhash64(F.lit(salt), *cols).alias(name) for salt, name in ((11, "__h1"), (29, "__h2"))]


def set_state(rows: DataFrame, by: list[str], values: list[str], prefix: str) -> DataFrame:
    """A 128-bit digest and a count of the distinct ``values`` rows of each group.

    Nulls are values like any other; order and repeats mean nothing. Distinct and XOR both combine
    before the shuffle, and no group is ever collected, however many rows share one key.
    """
    null_safe = [F.struct(F.col(v).isNull(), F.col(v)) for v in values]
    return (
        rows.select(*by, *values)
        .distinct()
        .select(*by, *_set_digest(*null_safe))
        .groupBy(*by)
        .agg(
            F.bit_xor("__h1").alias(f"{prefix}_h1"),
            F.bit_xor("__h2").alias(f"{prefix}_h2"),
            F.count(F.lit(1)).alias(f"{prefix}_n"),
        )
    )


def validity_intervals(states: DataFrame, key: str, seq: str, state: str, order: DataFrame) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive snapshots in which a key keeps one state.

    ``states`` has one row per key and snapshot; ``order`` numbers the delivered snapshots
    (``seq``, ``idx``). Result: key, state, from_idx, to_idx. A window holds one key's rows, at most
    one for each snapshot.
    """
    w = Window.partitionBy(key).orderBy("idx")
    numbered = states.join(F.broadcast(order.select(seq, "idx")), seq)  # one row per snapshot
    marked = numbered.select(
        key,
        state,
        "idx",
        F.when(
            (F.lag("idx").over(w) == F.col("idx") - 1) & F.lag(state).over(w).eqNullSafe(F.col(state)), 0
        ).otherwise(1).alias("__starts"),
    )
    return (
        marked.withColumn("__island", F.sum("__starts").over(w))
        .groupBy(key, "__island")
        .agg(F.first(state).alias(state), F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"))
        .drop("__island")
    )


def snapshot_order(nodes: DataFrame) -> DataFrame:
    """Delivered snapshot numbers in order: snapshot_seq, idx (from 1). One row per snapshot."""
    seqs = nodes.select("snapshot_seq").where("snapshot_seq is not null").distinct()
    return seqs.withColumn("idx", F.row_number().over(Window.orderBy("snapshot_seq")))


def interval_events(intervals: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """Change events of validity intervals: ``snapshot_seq, key, change``.

    An interval that begins where another ended is ``changed``, one that begins after a gap is
    ``added`` (never in the first snapshot), one that ends before the last snapshot without a
    successor is ``removed`` in the snapshot after its end.
    """
    w = Window.partitionBy(key).orderBy("from_idx")
    seen = intervals.select(
        key, "from_idx", "to_idx", F.lag("to_idx").over(w).alias("__before"), F.lead("from_idx").over(w).alias("__next")
    )
    begins = F.when(F.col("__before") == F.col("from_idx") - 1, F.lit("changed")).when(
        F.col("from_idx") > 1, F.lit("added")
    )
    ends = F.when(
        F.col("__next").isNull() | (F.col("__next") > F.col("to_idx") + 1), F.lit("removed")
    )
    events = seen.select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("from_idx").alias("idx"), begins.alias("change")),
                F.struct((F.col("to_idx") + 1).alias("idx"), ends.alias("change")),
            )
        ).alias("e"),
    ).select(key, "e.idx", "e.change").where("change is not null")
    # "removed" after the last snapshot finds no number here
    return events.join(F.broadcast(order), "idx").select("snapshot_seq", key, "change")


def lock_states(lock_nodes: DataFrame, lock_edges: DataFrame) -> DataFrame:
    """One row per snapshot and path: the digest of its hash and of its set of (target, target_hash)."""
    nodes = set_state(lock_nodes.where("path is not null"), ["snapshot_seq", "path"], ["hash"], "n")
    edges = set_state(
        lock_edges.where("source is not null").withColumnRenamed("source", "path"),
        ["snapshot_seq", "path"], ["target", "target_hash"], "e",
    )
    cols = ["n_h1", "n_h2", "n_n", "e_h1", "e_h2", "e_n"]
    return nodes.join(edges, ["snapshot_seq", "path"], "left").select(
        "snapshot_seq", "path", F.struct(*cols).alias("state")
    )


def lock_changes(lock_nodes: DataFrame, lock_edges: DataFrame) -> DataFrame:
    """Paths added, removed or changed in each snapshot against the delivered one before it.

    Edges of a source without a lock node in the same snapshot belong to no entry and are ignored;
    null paths are no entries. One snapshot, or none, gives no rows.
    """
    order = snapshot_order(lock_nodes)
    intervals = validity_intervals(lock_states(lock_nodes, lock_edges), "path", "snapshot_seq", "state", order)
    return interval_events(intervals, "path", order)
