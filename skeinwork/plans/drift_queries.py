"""Queries of the drift engine: composition, baseline, rules, impact, projections, usage log and functions.

The graph is the one of the domain tables: alive nodes, all edges read, and the lock of the last snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph, impact, project, rules, snapshots, usage
from ..session import materialize, table

#: The policy that the check queries run under.
SEVERITIES = {"stale-node": "error", "unresolved-edge": "error", "detached-node": "off", "removed-edge": "error"}
IGNORE = {"": ["*/archive/**"], "stale-node": ["**/*.csv"], "new-edge": ["**/img/*"]}
#: The time that retention is measured from, and the bounds that eviction must reach.
NOW_S = 1_751_328_000
EVICT_BYTES, EVICT_FILES = 1_000_000, 1_000
#: Globs and paths of the selector queries.
SELECT_GLOB, SELECT_TREE = "**/docs/*.md", "handbook"
#: Where impact searches start: pages of this name.
SEEDS = "**/docs/index-*.md"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_nodes(table(spark, d, "nodes"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return graph.link_edges(table(spark, d, "raw_edges"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.compose_edges(_links(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ends of the composed edges of all graphs, without what these tell of them."""
    return graph.linked_pairs(table(spark, d, "raw_edges"))


def _lock(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = table(spark, d, "lock_nodes"), table(spark, d, "lock_edges")
    last = nodes.agg(F.max("snapshot_seq")).first()[0]  # one number, from column statistics
    return graph.baseline(nodes, edges, last)


def _text(df: DataFrame) -> DataFrame:
    """Arrays as text, for engines that compare them differently."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c, t in df.dtypes if t.startswith("array<") and "struct" not in t})


def content_hash(spark, d):
    """Hash of each page's bytes; null bytes have none."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("s2:"), F.sha2("raw", 256)).alias("hash"))


def duplicate_hash(spark, d):
    """Contents held by several pages, with the first."""
    hashed = table(spark, d, "documents").where("raw is not null").select("doc_id", F.sha2("raw", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_doc")).where("pages > 1")


def compose_nodes(spark, d):
    composed = graph.compose_nodes(graph.fragments(table(spark, d, "nodes")))
    return composed.select("path", F.size("blocks").cast("long").alias("n_blocks"), F.array_join("provenance", ",").alias("provenance"))


def compose_edges(spark, d):
    return _text(_edges(spark, d))


def link_aggregate(spark, d):
    """Links of each graph with their lines in order, unknown ones last."""
    lines = F.transform("occurrences", lambda o: F.coalesce(o["line"].cast("string"), F.lit("?")))
    return _links(spark, d).select("graph", "source", "target", F.size("occurrences").cast("long").alias("n"), F.array_join(lines, ",").alias("lines"))


def graph_sizes(spark, d):
    """Nodes and edges of each graph."""
    nodes = graph.fragments(table(spark, d, "nodes")).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    edges = _links(spark, d).groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, "graph", "full").select("graph", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def raw_totals(spark, d):
    """Graphs, distinct nodes and edges of the raw fragments."""
    return graph.raw_totals(graph.fragments(table(spark, d, "nodes")), _links(spark, d))


def edge_blocks(spark, d):
    """What each graph tells of each composed edge: its block's number of occurrences and first line."""
    one = graph.edge_blocks(_links(spark, d)).select("source", "target", "provenance", F.explode_outer("blocks").alias("ns", "block"))
    said = F.from_json("block", "occurrences array<struct<line:bigint,link:string,raw:string>>")["occurrences"]
    return one.select(
        "source", "target", F.array_join("provenance", ",").alias("provenance"), "ns", F.size(said).cast("long").alias("n"),
        F.array_min(F.transform(said, lambda o: o["line"])).alias("first_line"),
    )


def lock_nodes_snapshot(spark, d):
    return graph.lock_snapshot(_nodes(spark, d), _edges(spark, d))[0]


def lock_edges_snapshot(spark, d):
    return graph.lock_snapshot(_nodes(spark, d), _edges(spark, d))[1]


def lock_merge(spark, d):
    """The last lock with everything under ``docs`` brought up to date."""
    old = _lock(spark, d)[0]
    new = graph.lock_snapshot(_nodes(spark, d), _edges(spark, d))[0]
    return graph.merge_lock(old, new, P.matches_globs(F.col("path"), ["*/docs/**"]))


def lock_dropped(spark, d):
    return graph.dropped(_lock(spark, d)[0], _nodes(spark, d))


def _rule(rule):
    def run(spark, d):
        locked, locked_edges = _lock(spark, d)
        found = rule(_nodes(spark, d), _edges(spark, d), locked, locked_edges)
        return _text(found.select("name", "subject", "target", "lines", "message"))

    return run


def unresolved_edge(spark, d):
    """Broken links, and whether a mistaken base is the cause."""
    found = rules.unresolved_edges(_nodes(spark, d), _edges(spark, d))
    return _text(found.select("subject", "target", "lines", F.col("cause").isNotNull().alias("has_cause")))


def unresolved_fragment(spark, d):
    return _text(rules.unresolved_fragments(_nodes(spark, d), _links(spark, d)).select("subject", "target", "lines", "message", "cause"))


def detached_node(spark, d):
    return rules.detached_nodes(_nodes(spark, d), _edges(spark, d)).select("subject")


def no_baseline(spark, d):
    """The finding of a graph whose baseline is empty."""
    empty = _lock(spark, d)[0].where("path is null")
    return rules.no_baseline(_nodes(spark, d), _edges(spark, d), empty).select("name", "subject")


def policy_apply(spark, d):
    """The recorded findings under the policy: their own severities are replaced."""
    found = table(spark, d, "findings").where("subject is not null").select("finding_id", "name", "subject", "target")
    return rules.apply_policy(found, SEVERITIES, IGNORE).select("finding_id", "severity")


def check_findings(spark, d):
    """The whole check: every rule, the policy, subsumption."""
    return _text(_check(spark, d).select("name", "severity", "subject", "target", "lines", "message"))


def _check(spark, d):
    locked, locked_edges = _lock(spark, d)
    links = materialize(_links(spark, d), "links")
    edges = materialize(graph.compose_edges(links), "edges")
    nodes = materialize(_nodes(spark, d), "nodes")
    return rules.check(nodes, edges, links, materialize(locked, "lock"), materialize(locked_edges, "lock"), SEVERITIES, IGNORE)


def check_summary(spark, d):
    return rules.summary(_check(spark, d))


def check_sorted(spark, d):
    """Recorded findings in their total order, by rank."""
    found = rules.in_order(table(spark, d, "findings").where("name is not null and subject is not null").select("name", "subject", "lines", "target", "message").distinct())
    summed = usage.running_totals(
        found.withColumn("one", F.lit(1)),
        [F.col("name"), F.col("subject"), F.coalesce("lines", F.array().cast("array<bigint>")), F.coalesce("target", F.lit("")), F.coalesce("message", F.lit(""))],
        ["one"],
    )
    return _text(summed.select("name", "subject", "lines", "target", "message", (F.col("before_one") + 1).alias("place")))


def _seeds(nodes):
    return project.select_nodes(nodes, [SEEDS]).select("path")


def _bfs(direction, depth):
    def run(spark, d):
        edges = materialize(_edges(spark, d), "edges")
        found = impact.search(edges, _seeds(_nodes(spark, d)), direction, depth)
        return found.select("node", F.col("depth").cast("long").alias("depth"))

    return run


def impact_radius(spark, d):
    """Reach of every seed over all links."""
    seeds = _seeds(_nodes(spark, d)).select(F.col("path").alias("node"))
    return impact.reach_counts(materialize(_pairs(spark, d), "pairs"), seeds)


def impact_via(spark, d):
    """One level of impact with the parent found first."""
    found = impact.search(materialize(_edges(spark, d), "edges"), _seeds(_nodes(spark, d)), "both", 1)
    # the parent is the first seed by name, its links backwards before those ahead
    return _text(found.select("node", "via", F.col("depth").cast("long").alias("depth"), "lines"))


def _top(spark, d):
    """The directory graph: links between the first two parts of paths, a small cyclic graph."""
    ends = table(spark, d, "raw_edges").where("graph <> 'outline'").select(
        F.regexp_extract("source", "^([^/]+)/", 1).alias("source"), F.regexp_extract("target", "^([^/]+)/", 1).alias("target")
    ).where("source <> '' and target <> '' and not contains(target, ':')")
    edges = ends.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    # links that most projects have are left out by share, so that distances differ
    busy = edges.where("source <> target").groupBy("source").agg(F.max("n").alias("most"))
    edges = edges.join(busy, "source").where("n >= 0.5 * most").select("source", "target").withColumn("lines", F.lit(None).cast("array<bigint>"))
    edges = materialize(edges, "top")
    nodes = edges.select(F.col("source").alias("path")).unionByName(edges.select(F.col("target").alias("path"))).distinct()
    return materialize(nodes, "top"), edges


def betweenness(spark, d):
    nodes, edges = _top(spark, d)
    return impact.betweenness(edges, nodes).select("node", F.round("betweenness", 9).alias("betweenness"))


def impact_ranked(spark, d):
    """What the seeds reach in one step over all links, by how much that reaches in turn."""
    edges = materialize(_pairs(spark, d), "pairs").withColumn("lines", F.lit(None).cast("array<bigint>"))  # lines are not asked for
    found = materialize(impact.search(edges, _seeds(_nodes(spark, d)), "inbound", 1), "found")
    return impact.ranked(found, impact.reach_counts(edges, found)).select("node", F.col("depth").cast("long").alias("depth"), "impact_radius")


def impact_diagnostics(spark, d):
    """Broken links, and removed ones, beside a search of one level in both directions."""
    nodes, locked_edges = materialize(_nodes(spark, d), "nodes"), _lock(spark, d)[1]
    edges = materialize(_edges(spark, d), "edges")
    seeds = _seeds(nodes)
    front = materialize(impact.frontier(impact.search(edges, seeds, "both", 1), seeds, 1), "front")
    broken = rules.unresolved_edges(nodes, impact.inspected(edges, front, "both"))
    lost = rules.removed_edges(nodes, edges, None, locked_edges)
    return broken.unionByName(impact.lost_beside(lost, locked_edges, front, "both")).select("name", "subject", "target")


def select_glob(spark, d):
    return project.select_nodes(_nodes(spark, d), [SELECT_GLOB]).select("path")


def select_subtree(spark, d):
    return project.select_nodes(_nodes(spark, d), [SELECT_TREE]).select("path", "fs_type")


def project_nodes(spark, d):
    """Nodes with frontmatter, that namespace only."""
    return project.project_nodes(_nodes(spark, d), ["frontmatter"]).select("path", F.element_at("blocks", "@frontmatter").alias("frontmatter"))


def project_fields(spark, d):
    """Nodes that declare a purpose, with nothing but it."""
    kept = project.project_nodes(_nodes(spark, d), ["frontmatter"], ["purpose"])
    return kept.select("path", F.get_json_object(F.element_at("blocks", "@frontmatter"), "$.purpose").alias("purpose"))


def project_edges(spark, d):
    """Frontmatter links of the pages that the glob selects."""
    sources = project.select_nodes(_nodes(spark, d), [SELECT_GLOB]).select("path")
    return project.project_edges(_edges(spark, d), sources, ["frontmatter"]).select("source", "target")


def beneath(spark, d):
    nodes = _nodes(spark, d)
    return project.beneath(nodes, nodes.where("fs_type = 'directory'"))


def _scalar(column, *more):
    def run(spark, d):
        ends = table(spark, d, "raw_edges").where("target is not null and source is not null")
        return ends.select("edge_id", *[c(F).alias(n) for n, c in (column, *more)])

    return run


def link_resolve(spark, d):
    """Spellings of links resolved against their sources."""
    said = table(spark, d, "raw_edges").where("source is not null").select("edge_id", "source", F.posexplode("occurrences").alias("at", "o"))
    said = said.where("o.raw is not null")
    return said.select("edge_id", F.col("at").cast("long").alias("at"), P.resolve_link(F.col("source"), F.col("o.raw")).alias("resolved"))


def slugify(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", P.slug(F.substring_index("text", "\n", 1)).alias("slug"))


def one_line(spark, d):
    return table(spark, d, "nodes").where("path is not null").select("path", P.one_line(F.col("path")).alias("line")).distinct()


def percent_decode(spark, d):
    """Link targets with their escapes decoded."""
    return table(spark, d, "raw_edges").where("target is not null").select("target").distinct().select("target", P.percent_decode(F.col("target")).alias("decoded"))


def usage_classify(spark, d):
    """How the recorded states compare with the classes read from the payloads."""
    usage_events = table(spark, d, "usage_events")
    return usage_events.select("delivery_id", "state").join(usage.classify(usage_events), "delivery_id").groupBy("state", "class").agg(F.count(F.lit(1)).alias("deliveries"))


def event_pairing(spark, d):
    return usage.pairing(usage.groups(table(spark, d, "usage_events")))


def event_coverage(spark, d):
    return usage.coverage(usage.groups(table(spark, d, "usage_events"))).where("last is not null").select("id", "bytes", "files")


def event_ttl(spark, d):
    return usage.expired(usage.coverage(usage.groups(table(spark, d, "usage_events"))), NOW_S).select("id")


def event_eviction(spark, d):
    covered = usage.coverage(usage.groups(table(spark, d, "usage_events")))
    return usage.eviction(materialize(covered, "covered"), EVICT_BYTES, EVICT_FILES).select("id")


def occupancy(spark, d):
    return usage.occupancy(table(spark, d, "usage_events"))


def prefix_admission(spark, d):
    """Findings that fit in 400 bytes of messages for each rule and month, in order of their number."""
    found = table(spark, d, "findings").where("name is not null").select(
        "finding_id", "name", F.date_format("found_at", "yyyy-MM").alias("month"), F.octet_length(F.coalesce("message", F.lit(""))).alias("size")
    )
    return usage.admit_prefix(found, ["name", "month"], ["finding_id"], "size", 400).select("finding_id")


def snapshot_intervals(spark, d):
    """How long each path kept one hash and one set of links."""
    nodes = table(spark, d, "lock_nodes")
    order = snapshots.snapshot_order(nodes)
    states = snapshots.lock_states(nodes, table(spark, d, "lock_edges"))
    found = snapshots.validity_intervals(states, "path", "snapshot_seq", "state", order)
    return found.select("path", F.col("from_idx").cast("long").alias("from_idx"), F.col("to_idx").cast("long").alias("to_idx"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, duplicate_hash, compose_nodes, compose_edges, link_aggregate, graph_sizes, raw_totals, edge_blocks, lock_nodes_snapshot,
        lock_edges_snapshot, lock_merge, lock_dropped, unresolved_edge, unresolved_fragment, detached_node, no_baseline,
        policy_apply, check_findings, check_summary, check_sorted, impact_radius, impact_via, betweenness, impact_ranked,
        impact_diagnostics, select_glob, select_subtree, project_nodes, project_fields, project_edges, beneath,
        link_resolve, slugify, one_line, percent_decode, usage_classify, event_pairing, event_coverage,
        event_ttl, event_eviction, occupancy, prefix_admission, snapshot_intervals,
    )
} | {
    "stale_node": _rule(rules.stale_nodes),
    "stale_edge": _rule(rules.stale_edges),
    "new_edge": _rule(rules.new_edges),
    "removed_node": _rule(rules.removed_nodes),
    "removed_edge": _rule(rules.removed_edges),
    "unlocked_node": _rule(rules.unlocked_nodes),
    "bfs_inbound_1": _bfs("inbound", 1),
    "bfs_inbound_all": _bfs("inbound", None),
    "bfs_outbound_2": _bfs("outbound", 2),
    "bfs_both_2": _bfs("both", 2),
    "link_functions": _scalar(
        ("uri", lambda f: P.is_uri(f.col("target"))),
        ("normal", lambda f: P.normalize_path(f.col("target"))),
        ("relative", lambda f: f.when(~P.is_uri(f.col("target")) & (f.col("source") != "") & (f.col("target") != ""), P.relative_from(f.col("source"), f.col("target")))),
        ("bare", lambda f: P.without_fragment(f.col("target"))),
    ),
}


def _pages(spark, d):
    """Markdown pages that hold the links of the ``markdown`` graph, one to a line under a heading."""
    said = table(spark, d, "raw_edges").where("graph = 'markdown' and source is not null and target is not null and target <> ''")
    links = said.select("source", F.concat(F.lit("/"), F.regexp_replace("target", r"[^A-Za-z0-9_/.:#-]", "-")).alias("to")).distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list("to")), lambda t: F.concat(F.lit("- [link]("), t, F.lit(")"))), "\n")
    return links.groupBy(F.col("source").alias("path")).agg(F.concat(F.lit("# Links\n\n"), body, F.lit("\n")).alias("text"))


def markdown_links(spark, d):
    """Links and lines read back from pages."""
    from ..functions import markdown

    return markdown.parse_pages(_pages(spark, d)).select("path", F.posexplode("links").alias("pos", "l")).select(
        "path", F.col("pos").cast("long").alias("pos"), F.col("l.target").alias("target"), F.col("l.line").alias("line")
    )


def frontmatter_links(spark, d):
    """Declared links and lines read back from pages whose metadata holds the ``frontmatter`` graph's."""
    from ..functions import frontmatter

    said = table(spark, d, "raw_edges").where("graph = 'frontmatter' and source is not null and target is not null and target <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_set("target")), lambda t: F.concat(F.lit("  - '"), F.replace(P.one_line(t), F.lit("'"), F.lit("''")), F.lit("'"))), "\n")
    pages = said.groupBy(F.col("source").alias("path")).agg(F.concat(F.lit("---\npurpose: notes\nsources:\n"), body, F.lit("\n---\n# Page\n")).alias("text"))
    read = frontmatter.parse_pages(pages, ["sources"])
    return read.select("path", F.explode("links").alias("l")).select("path", F.col("l.target").alias("target"), F.col("l.line").alias("line"))


def built_edges(spark, d):
    """Edges of a whole build: entries from pages, hashed, parsed, resolved and aggregated."""
    from ..operators import build
    from ..sources.config import Config, GraphConfig

    entries = _pages(spark, d).select("path", F.lit("file").alias("kind"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("link_target"))
    built = build.build(entries, Config(graphs=[GraphConfig("markdown", "markdown", ["**"])]))
    return built.edges.where("graph = 'markdown'").select("source", "target", F.size("occurrences").cast("long").alias("n"))


QUERIES |= {f.__name__: f for f in (markdown_links, frontmatter_links, built_edges)}
