"""Filling fixed-capacity containers with items, splitting only what exceeds the capacity.

Sizes are whole numbers up to the capacity, so the plan is made on the histogram of sizes, which
has at most ``capacity`` rows whatever the corpus. Items above one third of the capacity go at most
two to a container: each above one half gets its own, and takes the largest one above a third that still fits;
of those left over, the largest is paired with the largest that fits. Smaller items go, largest first, into
the smallest gap that holds them, and open containers only when none does. Containers with the same
contents are kept as ranges, so that planning costs time by distinct sizes and gaps, not by items.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Items of one size that are ranked in one group: all sizes are dealt into so many groups that none holds
#: more on average, even if all items had one size.
ITEMS_PER_GROUP = 200_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, rank, count, bin, stride): items rank.. of a size go to containers bin, bin+1, ...

    ``stride`` items go to each container. Ranks of a size begin at 0, containers at 0.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the sizes of gaps, ascending
    opened = 0

    def put(size: int, count: int, first: int, stride: int = 1) -> None:
        out.append((size, used[size], count, first, stride))
        used[size] += count
        left[size] -= count

    def free(gap: int, first: int, count: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    third = capacity / 3
    large = sorted((s for s in left if s > third), reverse=True)
    ascending = large[::-1]
    for size in large:
        while left[size]:
            # its partner: the largest that fits beside it and is not above one half itself
            room = min(capacity - size, size)
            i = bisect.bisect_right(ascending, room) - 1
            while i >= 0 and not left[ascending[i]]:
                i -= 1
            mate = ascending[i] if i >= 0 else 0
            if mate == size:
                count = left[size] // 2
                if count:
                    put(size, 2 * count, opened, 2)
                    free(capacity - 2 * size, opened, count)
                    opened += count
                    continue
                i -= 1
                while i >= 0 and not left[ascending[i]]:
                    i -= 1
                mate = ascending[i] if i >= 0 else 0
            if mate:
                count = min(left[size], left[mate])
                put(size, count, opened)
                put(mate, count, opened)
                free(capacity - size - mate, opened, count)
            else:
                count = left[size]
                put(size, count, opened)
                free(capacity - size, opened, count)
            opened += count
        ascending = [s for s in ascending if left[s]]
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            i = bisect.bisect_left(order, size)
            if i == len(order):
                stride = capacity // size
                count, rest = divmod(left[size], stride)
                if count:
                    put(size, count * stride, opened, stride)
                    free(capacity - stride * size, opened, count)
                    opened += count
                if rest:
                    put(size, rest, opened, rest)
                    free(capacity - rest * size, opened, 1)
                    opened += 1
                break
            gap = order[i]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            # the smallest gap stays smallest as it is filled, so it takes all that it holds at once
            stride = min(gap // size, left[size])
            bins = min(count, left[size] // stride)
            put(size, bins * stride, first, stride)
            free(gap - stride * size, first, bins)
            if bins < count:
                free(gap, first + bins, count - bins)
    return out


def items(counts: DataFrame, capacity: int) -> DataFrame:
    """Items to place: doc_id, part, first_token, size. Only documents above the capacity have several.

    Documents without tokens give none.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {capacity}"))
    return counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(parts).alias("part")).select(
        "doc_id", "part", (F.col("part") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * capacity).alias("size"),
    )


def pack(counts: DataFrame, capacity: int) -> DataFrame:
    """Assign documents (doc_id, n_tokens) to containers: container, doc_id, part, first_token, size.

    Each document is in one container; one above the capacity is cut into full containers and a rest
    that is placed like any item. Containers are numbered from 0. An empty table gives no rows.
    """
    spark = counts.sparkSession
    placed = materialize(items(counts, capacity), "items")
    salts = 1 + placed.count() // ITEMS_PER_GROUP
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    tally = materialize(salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")), "tally")
    histogram = {r["size"]: r["n"] for r in tally.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    if not histogram:
        return spark.createDataFrame([], "container bigint, doc_id bigint, part bigint, first_token bigint, size bigint")
    earlier = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    offsets = tally.select("size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    steps = spark.createDataFrame(
        pd.DataFrame(plan(histogram, capacity), columns=["size", "first_rank", "count", "bin", "stride"]),
        "size bigint, first_rank bigint, count bigint, bin bigint, stride bigint",
    )
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["size", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "salt")
    # the plan is bounded by the capacity, not by the corpus
    at = F.broadcast(steps.withColumnRenamed("size", "s"))
    inside = (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("count"))
    return ranked.join(at, inside).select(
        (F.col("bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("stride"))).cast("long").alias("container"),
        "doc_id", "part", "first_token", "size",
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Of all containers: their number, the least possible number by volume, and the unused share."""
    total = F.sum("size")
    n = F.max("container") + 1
    return packed.agg(
        n.alias("containers"), F.ceil(total / capacity).alias("least"), (1 - total / (n * capacity)).alias("unused_share")
    )
