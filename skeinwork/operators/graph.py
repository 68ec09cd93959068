"""Composition of independent graphs by key: raw fragments to one set of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fragments(nodes: DataFrame) -> DataFrame:
    """Raw node fragments ``graph, path, metadata`` of alive composed nodes (one row per graph and path)."""
    alive = nodes.where("deleted_at is null and path is not null")
    return (
        alive.select("path", F.explode("blocks").alias("ns", "metadata"))
        .groupBy(F.regexp_replace("ns", "^@", "").alias("graph"), "path")
        .agg(F.max("metadata").alias("metadata"))
    )


def compose_nodes(raw: DataFrame) -> DataFrame:
    """``path, blocks, provenance``: a path's metadata under each graph's namespace, graphs sorted."""
    return raw.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(namespace(F.col("graph")), F.col("metadata"))))).alias("blocks"),
        F.array_sort(F.collect_set(namespace(F.col("graph")))).alias("provenance"),
    )


def namespace(graph: Column) -> Column:
    return F.concat(F.lit("@"), graph)


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Alive nodes, one row per path: ``path, fs_type, fs_hash, anchors, blocks``; the latest lifetime counts."""
    return (
        nodes.where("deleted_at is null and path is not null")
        .groupBy("path")
        .agg(F.max_by(F.struct("fs_type", "fs_hash", "anchors", "blocks"), F.struct("first_seen", "fs_hash")).alias("n"))
        .select("path", "n.*")
    )


def _ends(raw: DataFrame) -> DataFrame:
    return raw.where("source is not null and target is not null and source <> '' and target <> ''")


def linked_pairs(raw: DataFrame) -> DataFrame:
    """``source, target`` of every composed edge, once."""
    return _ends(raw).select("source", "target").distinct()


def link_edges(raw: DataFrame) -> DataFrame:
    """Edges of each graph: distinct occurrences in order of line (unknown lines last), then link and raw.

    An edge without occurrences keeps an empty list. Occurrences are made distinct before they are
    collected, so repeated rows of one edge never reach one task.
    """
    seen = _ends(raw).select("graph", "source", "target", F.explode_outer("occurrences").alias("o")).select(
        "graph", "source", "target", "o.line", "o.link", "o.raw"
    ).distinct()
    some = F.col("line").isNotNull() | F.col("link").isNotNull() | F.col("raw").isNotNull()
    ordered = F.array_sort(F.collect_list(F.when(some, F.struct(F.col("line").isNull().alias("last"), "line", "link", "raw"))))
    return seen.groupBy("graph", "source", "target").agg(ordered.alias("s")).select(
        "graph", "source", "target",
        F.transform("s", lambda o: F.struct(o["line"].alias("line"), o["link"].alias("link"), o["raw"].alias("raw"))).alias("occurrences"),
    )


def compose_edges(edges: DataFrame) -> DataFrame:
    """``source, target, lines, raws, provenance``: one row per pair over all graphs.

    ``lines`` are the distinct known lines and ``raws`` the distinct spellings, both sorted.
    """
    flat = edges.groupBy("source", "target").agg(
        F.flatten(F.collect_list("occurrences")).alias("o"), F.array_sort(F.collect_set(namespace(F.col("graph")))).alias("provenance")
    )
    return flat.select(
        "source", "target",
        known(F.transform("o", lambda x: x["line"])).alias("lines"),
        known(F.transform("o", lambda x: x["raw"])).alias("raws"),
        "provenance",
    )


def edge_blocks(edges: DataFrame) -> DataFrame:
    """``source, target, blocks, provenance``: composed edges with each graph's own block under its namespace.

    A block is the JSON of the graph's occurrences, absent parts left out. A graph that tells nothing of an edge but
    that it has it, such as the file system's, adds provenance and no block.
    """
    said = F.transform("occurrences", lambda o: F.struct(o["line"].alias("line"), o["link"].alias("link"), o["raw"].alias("raw")))
    block = F.when(F.size("occurrences") > 0, F.to_json(F.struct(said.alias("occurrences"))))
    ns = namespace(F.col("graph"))
    one = edges.select("source", "target", ns.alias("ns"), block.alias("block"))
    return one.groupBy("source", "target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("ns", "block"))))).alias("blocks"),
        F.array_sort(F.collect_set("ns")).alias("provenance"),
    )


def raw_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over the raw fragments of all graphs: graphs, distinct node paths, and edges of each graph added up.

    Both sides combine before the shuffle; a path that several graphs tell of is one node.
    """
    names = nodes.select("graph").unionByName(edges.select("graph")).distinct().select(F.lit("graphs").alias("what"))
    parts = names.unionByName(nodes.select("path").distinct().select(F.lit("nodes").alias("what"))).unionByName(edges.select(F.lit("edges").alias("what")))
    return parts.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("graphs", "nodes", "edges")])


def known(values: Column) -> Column:
    """The distinct non-null values of an array, sorted."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


def lock_snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline of a composed graph: lock nodes (path, hash) and edges (source, target, target_hash).

    Nodes without a hash are locked only if they have links; a target that is no node has a null hash.
    """
    locked = nodes.select("path", F.col("fs_hash").alias("hash"))
    lock_edges = edges.select("source", "target").join(
        locked.select(F.col("path").alias("target"), F.col("hash").alias("target_hash")), "target", "left"
    ).select("source", "target", "target_hash")
    sources = edges.select(F.col("source").alias("path")).distinct().withColumn("links", F.lit(True))
    lock_nodes = locked.join(sources, "path", "left").where("hash is not null or links").drop("links")
    return lock_nodes, lock_edges


def merge_lock(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """A scoped update of lock nodes: paths in scope come from ``new``, the others from ``old``."""
    return old.where(~scope).select("path", "hash").unionByName(new.where(scope).select("path", "hash"))


def dropped(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that a new lock no longer holds."""
    return old.select("path").distinct().join(new.select("path"), "path", "left_anti")


def baseline(lock_nodes: DataFrame, lock_edges: DataFrame, snapshot: int) -> tuple[DataFrame, DataFrame]:
    """One snapshot's lock, repeats removed; where a path has two hashes the greater counts."""
    n = lock_nodes.where(F.col("snapshot_seq") == snapshot).groupBy("path").agg(F.max("hash").alias("hash"))
    e = lock_edges.where(F.col("snapshot_seq") == snapshot).groupBy("source", "target").agg(F.max("target_hash").alias("target_hash"))
    return n, e
