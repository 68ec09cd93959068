"""The bounded log of usage events: classify, pair, cover, expire, evict, admit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .dedup import hex_identity, kept_deliveries

#: Bounds of the store.
RETENTION_S = 7 * 24 * 3600
EVENT_BYTES, STORE_BYTES, STORE_FILES = 256 * 1024, 100 * 1024 * 1024, 10_000


def classify(usage: DataFrame) -> DataFrame:
    """``delivery_id, class``: supported, unsupported (a later revision), malformed or oversized.

    A record is well-formed if it is a JSON object whose event is the delivered one; a revision above 1 is
    one this reader does not know.
    """
    v = F.try_parse_json("payload") if hasattr(F, "try_parse_json") else F.expr("try_parse_json(payload)")
    read = usage.withColumn("__v", v)
    event = F.try_variant_get("__v", "$.event", "string")
    revision = F.try_variant_get("__v", "$.revision", "bigint")
    kind = (
        F.when(F.octet_length("payload") > EVENT_BYTES, "oversized")
        .when(F.col("__v").isNull() | event.isNull() | (event != F.col("event")) | revision.isNull(), "malformed")
        .when(revision >= 2, "unsupported")
        .otherwise("supported")
    )
    return read.select("delivery_id", kind.alias("class"))


def instant(seconds: Column, nanoseconds: Column) -> Column:
    """A time in whole nanoseconds, exact beyond the range of timestamps."""
    return seconds.cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + nanoseconds.cast("decimal(10,0)")


def groups(usage: DataFrame) -> DataFrame:
    """Start and finish of each invocation side by side, of the copies that are kept.

    Columns: id, and for each side its presence, state, bytes, entry and collected time. One aggregation
    by id; conditional maxima combine before the shuffle. Rows without an id belong to no invocation.
    """
    kept = kept_deliveries(usage).withColumn("key", hex_identity(F.col("id"))).where("key is not null")

    def side(event: str) -> list[Column]:
        mine = F.col("event") == event
        cols = {
            "state": F.col("state"), "bytes": F.col("bytes"), "entry": instant(F.col("entry_s"), F.col("entry_ns")),
            "seen": instant(F.col("coll_s"), F.col("coll_ns")),
        }
        return [F.count_if(mine).alias(event)] + [F.max(F.when(mine, c)).alias(f"{event}_{n}") for n, c in cols.items()]

    return kept.groupBy(F.col("key").alias("id")).agg(*side("start"), *side("finish"))


def pairing(grouped: DataFrame) -> DataFrame:
    """``id, pairing``: paired, incomplete (no finish) or orphan (no start)."""
    kind = F.when((F.col("start") > 0) & (F.col("finish") > 0), "paired").when(F.col("start") > 0, "incomplete").otherwise("orphan")
    return grouped.select("id", kind.alias("pairing"))


def coverage(grouped: DataFrame) -> DataFrame:
    """``id, first, last``: the time that a group is known to cover, null where it is not.

    Known if both sides are supported, agree on the entry, and entry <= start <= finish.
    """
    known = (
        (F.col("start_state") == "supported") & (F.col("finish_state") == "supported") & (F.col("start_entry") == F.col("finish_entry"))
        & (F.col("start_entry") <= F.col("start_seen")) & (F.col("start_seen") <= F.col("finish_seen"))
    )
    return grouped.select(
        "id", F.when(known, F.col("start_entry")).alias("first"), F.when(known, F.col("finish_seen")).alias("last"),
        (F.coalesce("start_bytes", F.lit(0)) + F.coalesce("finish_bytes", F.lit(0))).alias("bytes"),
        (F.when(F.col("start") > 0, 1).otherwise(0) + F.when(F.col("finish") > 0, 1).otherwise(0)).cast("long").alias("files"),
    )


def expired(covered: DataFrame, now_s: int) -> DataFrame:
    """Groups last seen at least seven days before ``now_s``, to the nanosecond; unknown ones never expire."""
    age = F.lit(now_s).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") - F.col("last")
    return covered.where(age >= F.lit(RETENTION_S * 1_000_000_000).cast("decimal(28,0)"))


def running_totals(rows: DataFrame, order: list[Column], values: list[str], buckets: int | None = None) -> DataFrame:
    """Sums of ``values`` over all rows before each row in a global order, as ``before_<value>``.

    Rows are range-partitioned by the order, into as many ranges as a shuffle has partitions (64 at least); the sums of the ranges, one row each, are added to the
    running sums inside a range, so that no task holds all rows.
    """
    buckets = buckets or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = rows.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    keys = [F.col(f"__o{i}") for i in range(len(order))]
    parted = materialize(named.repartitionByRange(buckets, *keys).withColumn("__b", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted
    for v in values:
        inside = inside.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(w), F.lit(0)))
    totals = parted.groupBy("__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    up = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("__b", *[F.coalesce(F.sum(f"__t_{v}").over(up), F.lit(0)).alias(f"__s_{v}") for v in values])
    out = inside.join(F.broadcast(starts), "__b")
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"before_{v}") + F.col(f"__s_{v}"))
    return out.drop("__b", *[f"__s_{v}" for v in values], *[f"__o{i}" for i in range(len(order))])


def eviction(covered: DataFrame, byte_limit: int, file_limit: int) -> DataFrame:
    """Groups to evict, oldest known first, then the unknown by id, until what is left fits both limits."""
    total = covered.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("files"), F.lit(0)).alias("files")).first()
    sized = running_totals(covered, [F.col("last").isNull(), F.col("last"), F.col("id")], ["bytes", "files"])
    still = (F.lit(total["bytes"]) - F.col("before_bytes") > byte_limit) | (F.lit(total["files"]) - F.col("before_files") > file_limit)
    return sized.where(still).select("id", "bytes", "files")


def occupancy(usage: DataFrame) -> DataFrame:
    return usage.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def admit_prefix(records: DataFrame, by: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Records of each group in order until the first that does not fit; later ones are left out even if small."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("__sum", F.sum(size).over(w)).where(F.col("__sum") <= limit).drop("__sum")


def exact_sum(value: str) -> Column:
    """A byte count, null (overflow) once it leaves the range of a long; overflow is sticky."""
    return F.try_sum(value)


def os_value(raw: Column) -> Column:
    """Bytes of an operating system string as text where they are UTF-8, else base64, with which it is."""
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.struct(
        F.when(valid, "utf8").otherwise("base64").alias("encoding"),
        F.when(valid, raw.cast("string")).otherwise(F.base64(raw)).alias("value"),
    )
