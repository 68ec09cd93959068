"""Impact: multi-source breadth-first search, reach counts, betweenness, and diagnostics beside the search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_shared, materialize, reread, write_shared

#: Edges whose reach one task counts: rounds over fewer cost more than their work.
LOCAL_EDGES = 4_000_000


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """Hops ``at, next, way, lines``: way 0 against an edge (its lines lie in the node reached), 1 along it."""
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("next"), F.lit(0).alias("way"), "lines")
    ahead = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.lit(1).alias("way"), F.lit(None).cast("array<bigint>").alias("lines"))
    return back if direction == "inbound" else ahead if direction == "outbound" else back.unionByName(ahead)


def search(edges: DataFrame, seeds: DataFrame, direction: str = "inbound", depth: int | None = 1) -> DataFrame:
    """Nodes reached from ``seeds`` (path): ``node, via, depth, lines``; seeds are not among them.

    Targets that are no nodes are reached too. Of several parents the first in discovery order counts:
    seeds in order of name, then each level by its parent's order, direction and name. Each level is one
    join of the frontier with the hops, less what was visited, written before the next; cycles end.
    """
    hops = steps(edges, direction).where("at <> next")
    spark = edges.sparkSession
    columns = ["node", "via", "depth", "lines", "order"]
    first = seeds.select(F.col("path").alias("node")).distinct().select(
        "node", F.col("node").alias("via"), F.lit(0).alias("depth"), F.lit(None).cast("array<bigint>").alias("lines"), F.array("node").alias("order")
    )
    written = [write_shared(first, "level")]
    level = 0
    while depth is None or level < depth:
        level += 1
        front = reread(spark, written[-1]).select("node", "order")
        found = front.join(hops, F.col("node") == F.col("at")).select(
            F.col("next"), F.struct("order", "way", F.col("node").alias("via")).alias("k"), "lines"
        )
        # the least key is the parent discovered first; min_by combines before the shuffle
        best = found.groupBy("next").agg(F.min("k").alias("k"), F.min_by("lines", "k").alias("lines"))
        visited = reread(spark, *written).select("node")
        fresh = best.join(visited, F.col("next") == F.col("node"), "left_anti").select(
            F.col("next").alias("node"), F.col("k.via").alias("via"), F.lit(level).alias("depth"), "lines",
            # lists of names are compared name by name, whatever characters these hold
            F.concat("k.order", F.array(F.col("k.way").cast("string"), F.col("next"))).alias("order"),
        ).select(*columns)
        written.append(write_shared(fresh, "level"))
        if reread(spark, written[-1]).isEmpty():
            break
    return reread(spark, *written).where("depth > 0").drop("order")


def _number(name: Column, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), name)


def reach_counts(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``node, impact_radius``: how many other paths lead to each node of ``of`` (node), over any number of edges.

    Exact, without a row for each pair. About a pivot, what leads to it (A) and what it leads to (D) split the question:
    nodes of both have the count of A; those of D alone have A and, besides, what leads to them where A is
    taken out, as all that leads to A is in A; nothing of D leads to the others. So many nodes share one
    search where they hang on the same large part of the graph. Paths go by their hash, another one if two share it.
    """
    asked = materialize(of.select("node").distinct(), "asked")
    pairs = edges.where("source <> target").select("source", "target")
    names = pairs.select(F.col("source").alias("name")).unionByName(pairs.select(F.col("target").alias("name"))).unionByName(asked.select(F.col("node").alias("name")))
    turn = 0
    while not names.groupBy(_number(F.col("name"), turn).alias("v")).agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least <> most").isEmpty():
        turn += 1
    numbers = [_number(F.col(c), turn).alias(c) for c in ("source", "target")]
    numbered = asked.select("node", _number(F.col("node"), turn).alias("v"))
    counts = _reach(write_shared(pairs.select(*numbers).distinct(), "hops"), write_shared(numbered.select("v"), "asked"), edges.sparkSession)
    return numbered.join(counts, "v").select("node", F.col("n").alias("impact_radius"))


def _reach(hops: str, asked: str, spark: SparkSession) -> DataFrame:
    """``v, n`` of the nodes in the table ``asked``: pivots by rounds of joins until ``LOCAL_EDGES`` are left, these in one task."""
    todo, done = [(hops, asked, 0)], []
    while todo:
        hops, asked, more = todo.pop()
        seeds = reread(spark, asked)
        if reread(spark, hops).count() > LOCAL_EDGES:
            above = _spread(hops, seeds, "target", "source")
            old, hops = hops, write_shared(reread(spark, hops).join(above.select(F.col("v").alias("target")), "target", "left_semi").select("source", "target"), "hops")
            drop_shared(spark, old)
        links = reread(spark, hops)
        if links.count() <= LOCAL_EDGES:
            done.append(write_shared(_reach_in_one_task(links, seeds).select("v", (F.col("n") + more).alias("n")), "reach"))
        else:
            # the busiest node most likely lies in the largest loop
            ends = links.select(F.col("source").alias("v"), F.lit(1).alias("out")).unionByName(links.select(F.col("target").alias("v"), F.lit(0).alias("out")))
            busy = ends.groupBy("v").agg((F.count_if(F.col("out") == 1) * F.count_if(F.col("out") == 0)).alias("k"))
            pivot = busy.orderBy(F.desc("k"), "v").select("v").limit(1)
            pivot = materialize(pivot, "pivot")
            a, d = _spread(hops, pivot, "target", "source"), _spread(hops, pivot, "source", "target")
            n = a.count()
            below = seeds.join(d, "v", "left_semi")
            done.append(write_shared(below.join(a, "v", "left_semi").select("v", F.lit(more + n - 1).cast("long").alias("n")), "reach"))
            for end, gone, kept, plus in (("source", a, below.join(a, "v", "left_anti"), n), ("target", d, seeds.join(d, "v", "left_anti"), 0)):
                left = write_shared(kept, "asked")
                if not reread(spark, left).isEmpty():
                    # nothing leads from the others into A, and nothing from D to the others
                    todo.append((write_shared(links.join(gone.select(F.col("v").alias(end)), end, "left_anti").select("source", "target"), "hops"), left, more + plus))
        drop_shared(spark, hops)
    return reread(spark, *done)


def _spread(hops: str, begun: DataFrame, at: str, to: str) -> DataFrame:
    """``v``: the nodes ``begun`` and all that links lead to from column ``at`` to column ``to``, level by level."""
    spark = begun.sparkSession
    written = [write_shared(begun, "level")]
    while True:
        step = reread(spark, written[-1]).join(reread(spark, hops), F.col("v") == F.col(at)).select(F.col(to).alias("v")).distinct()
        written.append(write_shared(step.join(reread(spark, *written), "v", "left_anti"), "level"))
        if reread(spark, written[-1]).isEmpty():
            return reread(spark, *written)


def _reach_in_one_task(hops: DataFrame, asked: DataFrame) -> DataFrame:
    every = hops.select("source", "target").unionByName(asked.select(F.lit(None).cast("long").alias("source"), F.col("v").alias("target")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, seeds = [], []
        for batch in batches:
            plain = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            target = batch.column(1).to_numpy()
            seeds.append(target[plain])
            links.append(np.stack([batch.column(0).fill_null(0).to_numpy()[~plain], target[~plain]]))
        if not links:
            return
        v = np.concatenate(seeds)
        source, target = np.concatenate(links, axis=1)
        links.clear()
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(_counts(source, target, v))], names=["v", "n"])

    return every.repartition(1).mapInArrow(run, "v bigint, n bigint")


def _counts(source: np.ndarray, target: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many others lead to each of ``asked`` (distinct), by pivots as in ``reach_counts``."""
    names, flat = np.unique(np.concatenate([asked, source, target]), return_inverse=True)
    seeds, source, target = np.split(flat.astype(np.int32), [len(asked), len(asked) + len(source)])
    size = len(names)
    ins, outs = np.bincount(target, minlength=size), np.bincount(source, minlength=size)
    up = np.concatenate([[0], np.cumsum(ins)]), source[np.argsort(target, kind="stable")]
    down = np.concatenate([[0], np.cumsum(outs)]), target[np.argsort(source, kind="stable")]
    alive, seen, side, found = np.ones(size, bool), np.zeros(size, bool), np.zeros(size, np.int8), np.zeros(size, np.int64)

    def spread(v: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        levels = [np.array([v], np.int32)]
        seen[v] = True
        while len(levels[-1]):
            front = levels[-1]
            many = begins[front + 1] - begins[front]
            at = np.repeat(begins[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
            to = ends[at]
            levels.append(np.unique(to[alive[to] & ~seen[to]]))
            seen[levels[-1]] = True
        every = np.concatenate(levels)
        seen[every] = False
        return every

    # steps to take, the last first: nodes to solve and what to add, or nodes to take out (False) or put back (True)
    work: list[tuple[np.ndarray, int | bool]] = [(np.sort(seeds), 0)]
    while work:
        nodes, more = work.pop()
        if isinstance(more, bool):
            alive[nodes] = more
            continue
        if not len(nodes):
            continue
        v = nodes[0]  # hashes are in no order of the graph
        a = spread(v, *up)
        if len(nodes) == 1:
            found[v] = more + len(a) - 1
            continue
        hub = a[np.argmax(ins[a] * outs[a])]
        if hub != v:
            b = spread(hub, *up)
            if 2 * len(b) > len(a):  # most of what leads here leads there, and others may hang on it
                v, a = hub, b
        d = spread(v, *down)
        side[a] += 1
        side[d] += 2
        kinds = side[nodes]
        side[a] = side[d] = 0
        found[nodes[kinds == 3]] = more + len(a) - 1
        work += [(d, True), (nodes[kinds < 2], more), (d, False), (a, True), (nodes[kinds == 2], more + len(a)), (a, False)]
    return found[seeds]


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``s, v, d, n``: distance and number of shortest paths between all pairs of nodes that are connected.

    Level by level, with path counts summed per pair; only edges whose target is a node count.
    """
    inside = edges.join(nodes.select(F.col("path").alias("target")), "target", "left_semi").where("source <> target").select("source", "target").distinct()
    known = materialize(nodes.select(F.col("path").alias("s"), F.col("path").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("n")), "paths")
    fresh, d = known, 0
    while True:
        d += 1
        step = fresh.join(inside, F.col("v") == F.col("source")).groupBy("s", F.col("target").alias("v")).agg(F.sum("n").alias("n"))
        fresh = materialize(step.join(known, ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "n"), "paths")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, betweenness``: the share of shortest paths between other nodes that run through a node.

    Directed and unweighted, divided by (n-1)(n-2); 0 for up to two nodes. Dependencies are added up
    backwards along the shortest-path edges, one level of distance at a time, for all sources at once.
    """
    total = nodes.count()
    found = materialize(shortest_paths(edges, nodes), "distances")
    inside = edges.where("source <> target").select("source", "target").distinct()
    ahead = found.select("s", F.col("v").alias("target"), F.col("d").alias("d2"), F.col("n").alias("n2"))
    links = materialize(
        found.join(inside, F.col("v") == F.col("source")).select("s", "v", "d", "n", "target").join(ahead, ["s", "target"])
        .where("d2 = d + 1").select("s", "v", "target", "d", (F.col("n") / F.col("n2")).alias("share")), "links",
    )
    deepest = links.agg(F.max("d").alias("m")).first()["m"]
    done = None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        here = links.where(F.col("d") == d)
        if done is None:
            gained = here.select("s", "v", F.col("share").alias("g"))
        else:
            below = done.where(F.col("d") == d + 1).select("s", F.col("v").alias("target"), "delta")
            gained = here.join(below, ["s", "target"], "left").select("s", "v", (F.col("share") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("g"))
        level = materialize(gained.groupBy("s", "v").agg(F.sum("g").alias("delta")).withColumn("d", F.lit(d)), "delta")
        done = level if done is None else done.unionByName(level)
    scale = float((total - 1) * (total - 2)) if total > 2 else 1.0
    every = nodes.select(F.col("path").alias("node"))
    if done is None or total <= 2:
        return every.withColumn("betweenness", F.lit(0.0))
    scores = done.where("s <> v").groupBy(F.col("v").alias("node")).agg((F.sum("delta") / scale).alias("betweenness"))
    return every.join(scores, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def ranked(found: DataFrame, reach: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """Search results with reach and betweenness (0 where none is given), in order of reach by depth plus betweenness, then name."""
    both = found.join(reach, "node", "left")
    both = both.withColumn("betweenness", F.lit(0.0)) if between is None else both.join(between, "node", "left")
    out = both.select(
        "node", "via", "depth", F.coalesce("impact_radius", F.lit(0)).alias("impact_radius"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "lines",
        F.concat(F.lit("review "), F.col("node"), F.lit(" for changes in "), F.col("via")).alias("fix"),
    )
    return out.orderBy(F.desc(F.col("impact_radius") / F.col("depth") + F.col("betweenness")), "node")


def frontier(found: DataFrame, seeds: DataFrame, depth: int | None, nodes: DataFrame | None = None) -> DataFrame:
    """Paths whose edges the search looked at: seeds that are ``nodes`` (if given), and what was reached above the last depth."""
    inner = found if depth is None else found.where(F.col("depth") < depth)
    begun = seeds.select("path") if nodes is None else seeds.select("path").join(nodes.select("path"), "path", "left_semi")
    return begun.unionByName(inner.select(F.col("node").alias("path"))).distinct()


def inspected(edges: DataFrame, front: DataFrame, direction: str) -> DataFrame:
    """Edges that touch the frontier on the side that the direction looks from."""
    parts = []
    if direction in ("inbound", "both"):
        parts.append(edges.join(front.select(F.col("path").alias("target")), "target", "left_semi"))
    if direction in ("outbound", "both"):
        parts.append(edges.join(front.select(F.col("path").alias("source")), "source", "left_semi"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.dropDuplicates(["source", "target"])


def lost_beside(findings: DataFrame, locked_edges: DataFrame, front: DataFrame, direction: str) -> DataFrame:
    """Removed-edge and removed-node findings on locked edges that touch the frontier."""
    touched = inspected(locked_edges.select("source", "target"), front, direction)
    edges = findings.where("name = 'removed-edge'").join(
        touched.select(F.col("source").alias("subject"), "target"), ["subject", "target"], "left_semi"
    )
    ends = touched.select(F.col("source").alias("subject")).unionByName(touched.select(F.col("target").alias("subject"))).distinct()
    nodes = findings.where("name = 'removed-node'").join(ends, "subject", "left_semi")
    return edges.unionByName(nodes.select(edges.columns))


def adjacency_order(edges: DataFrame) -> DataFrame:
    """Each source's targets in order with their place, for stable listings."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("target")))
