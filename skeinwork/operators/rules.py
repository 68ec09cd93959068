"""Drift rules: the current graph against its baseline, and against itself; policy and order of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import fragment, is_uri, matches_globs, percent_decode, relative_from

#: Severities in rank order.
RANKS = {"off": 0, "warn": 1, "error": 2}
DEFAULT_SEVERITY = "warn"


def finding(df: DataFrame, name: str, subject: str, target: str | None = None, lines: Column | None = None, message: Column | None = None, cause: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(name).alias("name"), F.col(subject).alias("subject"), (F.col(target) if target else none).alias("target"),
        (lines if lines is not None else F.lit(None).cast("array<bigint>")).alias("lines"),
        (message if message is not None else F.lit("")).alias("message"), (cause if cause is not None else none).alias("cause"),
    )


def changed(nodes: DataFrame, locked: DataFrame) -> DataFrame:
    """Nodes whose hash is not the locked one, both being known."""
    return nodes.select("path", "fs_hash").join(locked, "path").where("fs_hash <> hash")


def stale_nodes(nodes, edges, locked, locked_edges):
    moved = changed(nodes, locked)
    message = F.concat(F.substring("fs_hash", 1, 13), F.lit(" is not the locked "), F.substring("hash", 1, 13))
    return finding(moved, "stale-node", "path", message=message)


def stale_edges(nodes, edges, locked, locked_edges):
    """Locked edges that still stand, whose target's hash moved since and whose source did not."""
    now = nodes.select(F.col("path").alias("target"), "fs_hash")
    live = locked_edges.join(edges.select("source", "target", "lines"), ["source", "target"]).join(now, "target")
    moved = live.where("fs_hash <> target_hash")
    own = changed(nodes, locked).select(F.col("path").alias("source"))
    return finding(moved.join(own, "source", "left_anti"), "stale-edge", "source", "target", F.col("lines"))


def new_edges(nodes, edges, locked, locked_edges):
    fresh = edges.join(locked_edges.select("source", "target"), ["source", "target"], "left_anti")
    return finding(fresh, "new-edge", "source", "target", F.col("lines"))


def removed_nodes(nodes, edges, locked, locked_edges):
    return finding(locked.join(nodes.select("path"), "path", "left_anti"), "removed-node", "path")


def removed_edges(nodes, edges, locked, locked_edges):
    """Locked edges that are gone though their source is alive."""
    alive = locked_edges.join(nodes.select(F.col("path").alias("source")), "source", "left_semi")
    return finding(alive.join(edges.select("source", "target"), ["source", "target"], "left_anti"), "removed-edge", "source", "target")


def unlocked_nodes(nodes, edges, locked, locked_edges):
    """Lockable nodes (with a hash or links) that the baseline does not hold."""
    sources = edges.select(F.col("source").alias("path")).distinct()
    fresh = nodes.join(locked.select("path"), "path", "left_anti").join(sources.withColumn("links", F.lit(True)), "path", "left")
    return finding(fresh.where("fs_hash is not null or links"), "unlocked-node", "path")


STALENESS = (stale_nodes, stale_edges, new_edges, removed_nodes, removed_edges, unlocked_nodes)


def unresolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is neither a node nor an address, with a suggestion where the base was mistaken.

    A raw spelling without a leading ``./``, ``../`` or ``/`` that itself names a node was meant from the
    top; the least such spelling is the cause.
    """
    paths = nodes.select(F.col("path").alias("target"))
    lost = edges.where(~is_uri(F.col("target"))).join(paths, "target", "left_anti")
    raws = lost.select("source", "target", F.explode("raws").alias("raw")).where(~F.col("raw").rlike(r"^(\.\.?/|/)"))
    meant = raws.join(nodes.select(F.col("path").alias("raw")), "raw", "left_semi").groupBy("source", "target").agg(F.min("raw").alias("meant"))
    cause = F.when(F.col("meant").isNotNull(), F.concat(F.lit("meant from the top: "), relative_from(F.col("source"), F.col("meant"))))
    return finding(lost.join(meant, ["source", "target"], "left"), "unresolved-edge", "source", "target", F.col("lines"), cause=cause)


def unresolved_fragments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fragments that name no anchor of their target, one row each with its lines.

    ``edges`` have occurrences. Unread anchors (null) are unknown, an empty list defines none. A fragment
    is looked for as written and decoded; one that differs from an anchor only by case has that as cause.
    """
    held = nodes.where("anchors is not null").select(F.col("path").alias("target"), "anchors")
    asked = (
        edges.where(~is_uri(F.col("target"))).select("source", "target", F.explode("occurrences").alias("o"))
        .select("source", "target", "o.line", fragment(F.col("o.link")).alias("fragment")).where("fragment is not null")
    )
    grouped = asked.groupBy("source", "target", "fragment").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    grouped = grouped.withColumn("decoded", percent_decode(F.col("fragment")))
    bad = grouped.join(held, "target").where("not array_contains(anchors, fragment) and not array_contains(anchors, decoded)")
    close = F.filter("anchors", lambda a: (F.lower(a) == F.lower(F.col("fragment"))) | (F.lower(a) == F.lower(F.col("decoded"))))
    cause = F.when(F.size(close) > 0, F.concat(F.lit("case differs: "), F.element_at(F.when(F.size(close) > 0, close), 1)))
    return finding(bad, "unresolved-fragment", "source", "target", F.col("lines"), F.concat(F.lit("#"), F.col("fragment")), cause)


def detached_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no directory and neither end of any edge."""
    ends = edges.select(F.col("source").alias("path")).unionByName(edges.select(F.col("target").alias("path"))).distinct()
    return finding(nodes.where("fs_type <> 'directory'").join(ends, "path", "left_anti"), "detached-node", "path")


def no_baseline(nodes: DataFrame, edges: DataFrame, locked: DataFrame | None) -> DataFrame:
    """One finding if something could be locked (it has a hash or links) and there is no baseline or an empty one, else none."""
    sources = edges.select(F.col("source").alias("path"))
    linked = nodes.select("path").join(sources, "path", "left_semi")
    lockable = nodes.where("fs_hash is not null").select("path").unionByName(linked).limit(1)
    lockable = lockable.select(F.lit(".").alias("path"), F.lit(1).alias("k"))
    if locked is not None:
        lockable = lockable.join(locked.limit(1).select(F.lit(1).alias("k")), "k", "left_anti")
    return finding(lockable, "no-baseline", "path")


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANKS.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def apply_policy(findings: DataFrame, severities: dict[str, str], ignore: dict[str, list[str]] | None = None) -> DataFrame:
    """Give each finding its severity, leave out those switched off or ignored, then subsume.

    ``ignore`` has globs for each rule, ``""`` for all. A new edge is left out where its source has an
    unlocked-node finding of the same severity or a higher one; severities themselves never change.
    """
    table = {**severities}
    severity = F.lit(DEFAULT_SEVERITY)
    for name, level in table.items():
        severity = F.when(F.col("name") == name, level).otherwise(severity)
    kept = findings.withColumn("severity", severity).where("severity <> 'off'")
    for name, globs in (ignore or {}).items():
        hit = matches_globs(F.col("subject"), globs)
        kept = kept.where(~(hit & (F.col("name") == name if name else F.lit(True))))
    over = kept.where("name = 'unlocked-node'").groupBy(F.col("subject").alias("__s")).agg(F.max(rank(F.col("severity"))).alias("__r"))
    fresh = kept.where("name = 'new-edge'").join(over, (F.col("subject") == F.col("__s")) & (F.col("__r") >= rank(F.col("severity"))), "left_anti")
    return kept.where("name <> 'new-edge'").unionByName(fresh)


def in_order(findings: DataFrame) -> DataFrame:
    """The total order of findings: name, subject, lines, target (none first), message."""
    return findings.orderBy("name", "subject", F.coalesce("lines", F.array().cast("array<bigint>")), F.col("target").asc_nulls_first(), "message")


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def check(nodes, edges, link_edges, locked, locked_edges, severities, ignore=None) -> DataFrame:
    """All rules under a policy. ``edges`` are composed, ``link_edges`` per graph with occurrences.

    ``locked`` is None where there is no baseline at all: then no staleness rule runs.
    """
    out = no_baseline(nodes, edges, locked)
    for rule in STALENESS if locked is not None else ():
        out = out.unionByName(rule(nodes, edges, locked, locked_edges))
    out = out.unionByName(unresolved_edges(nodes, edges)).unionByName(unresolved_fragments(nodes, link_edges)).unionByName(detached_nodes(nodes, edges))
    return apply_policy(out, severities, ignore)
