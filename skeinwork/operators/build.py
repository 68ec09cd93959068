"""Graphs from a tree's entries: hashes, texts, fragments of each configured graph, and their findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, markdown
from ..functions.paths import fragment, is_uri, matches_globs, resolve_link, without_fragment
from ..session import materialize
from ..sources.config import Config, GraphConfig
from .rules import finding

RAW_EDGES = "graph string, source string, target string, occurrences array<struct<line:bigint,link:string,raw:string>>"


@dataclass
class GraphSet:
    """Raw fragments of all graphs, before composition: nodes (graph, path, metadata), edges, findings."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    entries: DataFrame
    anchors: DataFrame
    hints: list[str]


def content_hash(content: Column) -> Column:
    """The hash of raw bytes, with the algorithm as prefix; text is never normalised before it."""
    return F.concat(F.lit("s2:"), F.sha2(content, 256))


def texts(entries: DataFrame) -> DataFrame:
    """``path, text, valid``: files decoded once, all leading byte order marks off; invalid UTF-8 is marked."""
    raw = F.col("content").cast("string")
    return entries.where("kind = 'file' and content is not null").select(
        "path", F.regexp_replace(raw, "^\\x{FEFF}+", "").alias("text"), F.is_valid_utf8(raw).alias("valid")
    )


def fs_fragment(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of all entries with type and hash, and an edge for each symlink that stays inside."""
    digest = F.when(F.col("kind") == "file", content_hash(F.col("content")))
    nodes = entries.select(
        F.lit("fs").alias("graph"), "path", F.to_json(F.struct(digest.alias("hash"), F.col("kind").alias("type"))).alias("metadata")
    )
    none = F.array().cast("array<struct<line:bigint,link:string,raw:string>>")
    edges = entries.where("kind = 'symlink' and link_target is not null").select(
        F.lit("fs").alias("graph"), F.col("path").alias("source"), F.col("link_target").alias("target"), none.alias("occurrences")
    )
    return nodes, edges


def link_rows(graph: str, found: DataFrame, declared: bool) -> DataFrame:
    """Edges from parsed links (path, links): resolved against their page, occurrences in order of line.

    Blank targets are dropped; a body link to a fragment of its own page is no edge, a declared one is
    kept as it stands. ``raw`` is kept only where resolving changed the spelling, ``link`` only with a
    fragment. Order within a line is that of the text.
    """
    flat = found.select("path", F.posexplode("links").alias("ord", "l")).select(
        "path", "ord", F.col("l.line").alias("line"), F.trim(F.col("l.target")).alias("said")
    ).where("said <> ''")
    own = F.startswith("said", F.lit("#"))
    flat = flat if declared else flat.where(~own)
    uri, frag = is_uri(F.col("said")), fragment(F.col("said"))
    bare = without_fragment(F.col("said"))
    target = F.when(uri, F.coalesce(bare, F.col("said"))).when(own, F.col("said")).otherwise(resolve_link(F.col("path"), bare))
    shaped = flat.withColumn("target", target).withColumn("frag", frag).select(
        "path", "ord", "line", "target",
        F.when(F.col("frag").isNotNull() & ~own, F.concat("target", F.lit("#"), "frag")).alias("link"),
        F.when(F.col("target") != bare, bare).alias("raw"),
    )
    order = F.array_sort(F.collect_list(F.struct(F.col("line").isNull().alias("last"), "line", "ord", "link", "raw")))
    grouped = shaped.groupBy(F.col("path").alias("source"), "target").agg(order.alias("o"))
    seen = F.array_distinct(F.transform("o", lambda o: F.struct(o["line"].alias("line"), o["link"].alias("link"), o["raw"].alias("raw"))))
    return grouped.select(F.lit(graph).alias("graph"), "source", "target", seen.alias("occurrences"))


def build(entries: DataFrame, config: Config) -> GraphSet:
    """All raw graphs of a tree, the file system's first, then the configured ones by name.

    Files are decoded once; a page goes through each graph's parser in one pass for links and anchors.
    """
    nodes, edges = fs_fragment(entries)
    decoded = materialize(texts(entries), "texts")
    good, bad = decoded.where("valid"), decoded.where("not valid").select("path")
    anchors, hints, findings = None, list(config.hints), None
    unreadable = []
    for g in sorted(config.graphs, key=lambda g: g.name):
        mine = good.where(matches_globs(F.col("path"), g.files))
        unreadable.append(bad.where(matches_globs(F.col("path"), g.files)).select("path", F.lit("@" + g.name).alias("ns")))
        if g.parser == "markdown":
            read = materialize(markdown.parse_pages(mine), "pages")
            part = read.select(F.lit(g.name).alias("graph"), "path", F.to_json(F.struct("anchors")).alias("metadata"))
            told = read.select("path", "anchors")
            anchors = told if anchors is None else anchors.unionByName(told)
        else:
            read = materialize(frontmatter.parse_pages(mine, g.edge_keys), "blocks")
            part = read.where("metadata is not null").select(F.lit(g.name).alias("graph"), "path", "metadata")
            broken = finding(read.where("problem is not null"), "unreadable-frontmatter", "path", lines=F.array(F.lit(1).cast("bigint")), message=F.col("problem"))
            findings = broken if findings is None else findings.unionByName(broken)
            hints += _fruitless(g, read)
        nodes = nodes.unionByName(part)
        edges = edges.unionByName(link_rows(g.name, read, g.parser == "frontmatter"))
    spark = entries.sparkSession
    if unreadable:
        every = unreadable[0]
        for u in unreadable[1:]:
            every = every.unionByName(u)
        by = every.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("ns")), ", ").alias("graphs"))
        dark = finding(by, "unreadable-text", "path", message=F.concat(F.lit("not UTF-8, read by "), "graphs"))
        findings = dark if findings is None else findings.unionByName(dark)
    if findings is None:
        findings = spark.createDataFrame([], "name string, subject string, target string, lines array<bigint>, message string, cause string")
    if anchors is None:
        anchors = spark.createDataFrame([], "path string, anchors array<string>")
    return GraphSet(nodes, edges, findings, entries, anchors, hints)


def _fruitless(g: GraphConfig, read: DataFrame) -> list[str]:
    """A hint where declared keys matched nothing, telling whether there was anything to match."""
    if not g.edge_keys:
        return []
    row = read.agg(
        F.count_if(F.size("links") > 0).alias("linked"), F.count_if(F.col("metadata").isNotNull()).alias("read"), F.count_if(F.col("problem").isNotNull()).alias("failed")
    ).first()
    if row["linked"]:
        return []
    return [f"edge-keys-matched-nothing: {g.name} ({', '.join(g.edge_keys)}): {row['read']} blocks read, {row['failed']} unreadable"]


def composed(built: GraphSet) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Composed nodes and edges as the rules take them, and the edges of each graph with occurrences."""
    from .graph import compose_edges, compose_nodes

    typed = built.entries.select("path", F.col("kind").alias("fs_type"), F.when(F.col("kind") == "file", content_hash(F.col("content"))).alias("fs_hash"))
    # anchors of all graphs that publish them; null where no graph read the page
    told = built.anchors.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))
    nodes = typed.join(compose_nodes(built.nodes).select("path", "blocks"), "path", "left").join(told, "path", "left")
    return nodes.select("path", "fs_type", "fs_hash", "anchors", "blocks"), compose_edges(built.edges), built.edges
