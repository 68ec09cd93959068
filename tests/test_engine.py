"""The truth table of the rules, policy, impact and projections on small graphs."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.operators import impact, project, rules, usage
from skeinwork.plans import drift_queries
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
NODES = "path string, fs_type string, fs_hash string, anchors array<string>, blocks map<string,string>"
EDGES = "source string, target string, lines array<bigint>, raws array<string>, provenance array<string>"


def graph(spark, hashes, pairs):
    nodes = spark.createDataFrame([(p, "file", h, None, {}) for p, h in hashes.items()], NODES)
    edges = spark.createDataFrame([(s, t, [1], [], ["@m"]) for s, t in pairs], EDGES)
    return nodes, edges


def lock(spark, hashes, pairs):
    return (
        spark.createDataFrame(list(hashes.items()), "path string, hash string"),
        spark.createDataFrame([(s, t, hashes.get(t)) for s, t in pairs], "source string, target string, target_hash string"),
    )


def names(spark, now, then):
    g, b = graph(spark, *now), lock(spark, *then)
    found = rules.STALENESS[0](*g, *b)
    for r in rules.STALENESS[1:]:
        found = found.unionByName(r(*g, *b))
    return rows(found, "name", "subject")


def test_staleness_truth_table(spark):
    pair = [("a", "b")]
    base = ({"a": "1", "b": "2"}, pair)
    assert names(spark, base, base) == []
    assert names(spark, ({"a": "1", "b": "9"}, pair), base) == [("stale-edge", "a"), ("stale-node", "b")]
    assert names(spark, ({"a": "8", "b": "9"}, pair), base) == [("stale-node", "a"), ("stale-node", "b")]
    assert names(spark, ({"b": "2"}, []), base) == [("removed-node", "a")]
    assert names(spark, ({"a": "1", "b": "2"}, []), base) == [("removed-edge", "a")]
    assert names(spark, ({"a": "1", "b": "2", "n": "3"}, [*pair, ("n", "b")]), base) == [("new-edge", "n"), ("unlocked-node", "n")]
    assert names(spark, base, ({"a": "1", "b": None}, pair)) == []


def policy(spark, severities, ignore=None):
    g, b = graph(spark, {"n": "3", "b": "2"}, [("n", "b")]), lock(spark, {"b": "2"}, [])
    found = rules.unlocked_nodes(*g, *b).unionByName(rules.new_edges(*g, *b))
    return rows(rules.apply_policy(found, severities, ignore), "name", "severity")


def test_subsumption_and_policy(spark):
    assert policy(spark, {}) == [("unlocked-node", "warn")]
    assert policy(spark, {"unlocked-node": "off"}) == [("new-edge", "warn")]
    assert policy(spark, {"new-edge": "error"}) == [("new-edge", "error"), ("unlocked-node", "warn")]
    assert policy(spark, {}, {"unlocked-node": ["n"]}) == [("new-edge", "warn")]
    assert policy(spark, {}, {"": ["**"]}) == []


def test_structural_rules(spark):
    nodes = spark.createDataFrame([("a.md", "file", "h", ["x", "Über"], {}), ("d/b.md", "file", "h", None, {}), ("d", "directory", None, None, {}), ("lone", "file", "h", [], {})], NODES)
    edges = spark.createDataFrame([("d/b.md", "d/a.md", [3], ["a.md"], []), ("d/b.md", "a.md", [1], [], []), ("a.md", "https://x", [1], [], []), ("a.md", "d/b.md", [2], [], [])], EDGES)
    assert rows(rules.unresolved_edges(nodes, edges), "subject", "target", "cause") == [("d/b.md", "d/a.md", "meant from the top: ../a.md")]
    assert rows(rules.detached_nodes(nodes, edges), "subject") == [("lone",)]
    occ = "source string, target string, occurrences array<struct<line:bigint,link:string,raw:string>>"
    links = spark.createDataFrame([("d/b.md", "a.md", [(4, "a.md#X", None), (2, "a.md#nope", None), (9, "a.md#nope", None), (1, "a.md#x", None), (1, "a.md#%C3%9Cber", None)]), ("a.md", "d/b.md", [(1, "d/b.md#q", None)])], occ)
    assert rows(rules.unresolved_fragments(nodes, links), "subject", "message", "lines", "cause") == [
        ("d/b.md", "#X", [4], "case differs: x"), ("d/b.md", "#nope", [2, 9], None),
    ]


def test_search(spark):
    nodes, edges = graph(spark, dict.fromkeys("abcd", "h"), [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "c"), ("d", "gone")])
    seeds = spark.createDataFrame([("c",), ("unknown",)], "path string")
    assert rows(impact.search(edges, seeds, "inbound", 1), "node", "via", "depth") == [("a", "c", 1), ("b", "c", 1), ("d", "c", 1)]
    assert rows(impact.search(edges, seeds, "outbound", None), "node", "depth") == [("a", 1), ("b", 2), ("d", 3), ("gone", 4)]
    assert rows(impact.reach_counts(edges, nodes.select(F.col("path").alias("node")))) == [("a", 3), ("b", 3), ("c", 3), ("d", 3)]
    assert impact.search(edges, seeds.where("path = 'none'"), "both", None).count() == 0
    with pytest.raises(ValueError):
        impact.search(edges, seeds, "up", 1)


def leading(pairs, asked):
    """How many other nodes lead to each, one search a node."""
    out = {}
    for v in asked:
        seen, todo = {v}, [v]
        for at in todo:
            new = {s for s, t in pairs if t == at} - seen
            seen |= new
            todo += new
        out[v] = len(seen) - 1
    return out


def random_links(rnd):
    """A loop that some nodes hang on, above and below, chains, and random links beside."""
    n = rnd.randint(2, 40)
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [(f"a{i}", f"r{rnd.randrange(n)}") for i in range(9)] + [(f"r{rnd.randrange(n)}", f"b{i}") for i in range(9)]
    chain = [(f"b{i % 9}", f"c{i}") for i in range(5)] + [(f"c{i}", f"c{i + 1}") for i in range(15)]
    k = rnd.randint(2, 60)
    loose = [(f"n{rnd.randrange(k)}", f"n{rnd.randrange(k)}") for _ in range(rnd.randint(1, 2 * k))]
    return sorted({*ring, *chain, *loose, ("n0", "n0"), ("n1", f"a{rnd.randrange(9)}")})


def test_counts_in_one_task_match_a_search_each():
    for seed in range(150):
        rnd = random.Random(seed)
        links = random_links(rnd)
        names = sorted({v for p in links for v in p} | {"alone"})
        rnd.shuffle(names)
        asked = names[: rnd.randint(1, len(names))]
        number = {v: i * 7919 - 50_000 for i, v in enumerate(names)}
        source, target = (np.array([number[p[i]] for p in links if p[0] != p[1]]) for i in (0, 1))
        got = impact._counts(source, target, np.array([number[v] for v in asked]))
        assert dict(zip(asked, got.tolist())) == leading(links, asked)


@pytest.mark.parametrize("most", [0, 40, 4_000_000])
def test_reach_by_rounds_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(impact, "LOCAL_EDGES", most)
    links = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [(f"r{i}", f"b{i % 3}") for i in range(6)] + [("b0", "c"), ("b1", "c"), ("a", "r3"), ("a", "r4"), ("a", "z"), ("z", "c"), ("c", "c")]
    asked = ["r0", "r5", "b0", "b2", "c", "a", "z", "alone"]
    edges = graph(spark, {}, links)[1]
    got = impact.reach_counts(edges, spark.createDataFrame([(v,) for v in [*asked, "r0"]], "node string"))
    assert {r.node: r.impact_radius for r in got.collect()} == leading(links, asked) and got.count() == len(asked)


def test_reach_of_paths_whose_hashes_agree(spark, monkeypatch):
    right = impact._number
    monkeypatch.setattr(impact, "_number", lambda name, turn: F.length(name).cast("long") if turn == 0 else right(name, turn))
    edges = graph(spark, {}, [("a", "b"), ("b", "c"), ("dd", "c")])[1]
    assert rows(impact.reach_counts(edges, spark.createDataFrame([("b",), ("c",)], "node string"))) == [("b", 1), ("c", 3)]


def test_reach_writes_no_row_for_each_pair(spark, monkeypatch):
    edges = graph(spark, {}, [(f"n{i}", f"n{(i * k + 1) % 200}") for i in range(200) for k in (1, 3, 7)])[1]
    written = []
    monkeypatch.setattr(impact, "write_shared", lambda df, label, write=impact.write_shared: written.append(df.count()) or write(df, label))
    got = impact.reach_counts(edges, edges.select(F.col("source").alias("node")))
    assert {r.impact_radius for r in got.collect()} == {199}
    assert sum(written) < 5 * edges.count()


def test_ranked_query_writes_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    pages = [f"top/docs/index-{i}.md" if i % 2 else f"top/p{i}.md" for i in range(100)]
    spark.createDataFrame([(p, "file", "h", None, {}, T0, None) for p in pages], f"{NODES}, first_seen timestamp_ntz, deleted_at timestamp_ntz").write.parquet(str(tmp_path / "nodes.parquet"))
    links = [("markdown", p, pages[(i * k + 1) % 100], [(n, "l", "r") for n in range(9)]) for i, p in enumerate(pages) for k in (1, 3, 7)]
    spark.createDataFrame(links, "graph string, source string, target string, occurrences array<struct<line:bigint,link:string,raw:string>>").write.parquet(str(tmp_path / "raw_edges.parquet"))
    written = []
    for module in (impact, session):  # materialize finds the writer in its own module
        monkeypatch.setattr(module, "write_shared", lambda df, label, write=session.write_shared: written.append(df.count()) or write(df, label))
    got = drift_queries.impact_ranked(spark, str(tmp_path)).collect()
    assert {r.node for r in got} == {s for _, s, t, _ in links if "index" in t} - {p for p in pages if "index" in p}
    assert {r.impact_radius for r in got} == {99} and sum(written) < 10 * len(pages) + 3 * len(links)


def brandes(nodes, edges):
    """Plain count of shortest paths through each node."""
    out = {v: [t for s, t in edges if s == v and t in nodes and t != v] for v in nodes}
    between = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for t in out[v]:
                if t not in dist:
                    dist[t], count[t] = dist[v] + 1, 0.0
                    order.append(t)
                if dist[t] == dist[v] + 1:
                    count[t] += count[v]
        gain = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for t in out[v]:
                if dist[t] == dist[v] + 1:
                    gain[v] += count[v] / count[t] * (1 + gain[t])
            if v != s:
                between[v] += gain[v]
    n = len(nodes)
    return {v: b / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, b in between.items()}


def test_betweenness(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "a"), ("e", "e"), ("b", "gone")]
    nodes, edges = graph(spark, dict.fromkeys("abcde", "h"), pairs)
    got = {r.node: r.betweenness for r in impact.betweenness(edges, nodes).collect()}
    want = brandes(set("abcde"), sorted(set(pairs)))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    few = impact.betweenness(edges, nodes.limit(2))
    assert {r.betweenness for r in few.collect()} == {0.0}


def test_projections(spark):
    nodes = spark.createDataFrame([
        ("a.md", "file", "h", None, {"@fs": "{}", "@m": '{"p":{"q":1,"r":2},"l":[{"q":3},{"z":1}]}'}), ("d", "directory", None, None, {"@fs": "{}"}), ("d/b.md", "file", "h", None, {"@m": "{}"}),
    ], NODES)
    assert rows(project.select_nodes(nodes, ["d"]), "path") == [("d/b.md",)]
    assert rows(project.select_nodes(nodes, ["*.md", "*.md"]), "path") == [("a.md",)]
    assert project.select_nodes(nodes, []).count() == 0
    assert rows(project.project_nodes(nodes, ["fs"]), "path") == [("a.md",), ("d",)]
    kept = project.project_nodes(nodes, ["m"], ["q"]).collect()
    assert [(r.path, r.blocks) for r in kept] == [("a.md", {"@m": '{"l":[{"q":3}],"p":{"q":1}}'})]
    assert rows(project.beneath(nodes, nodes.where("fs_type = 'directory'"))) == [("d", 1)]
    assert rows(project.suggestions(nodes, "b")) == [("d/b.md",)]


def test_prefix_admission_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1), ("h", 1, 10), ("h", 2, 1)], "g string, n int, size int")
    assert rows(usage.admit_prefix(df, ["g"], ["n"], "size", 10), "g", "n") == [("g", 1), ("h", 1)]


def test_running_totals_match_a_plain_sum(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id", F.lit(2).alias("bytes"))
    got = usage.running_totals(df, [F.col("k"), F.col("id")], ["bytes"], 7)
    ordered = sorted(((r.k, r.id, r.before_bytes) for r in got.collect()))
    assert [b for _, _, b in ordered] == [2 * i for i in range(500)]


def test_os_value(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "b binary")
    assert rows(df.select(usage.os_value(F.col("b")).alias("v")).select("v.*")) == [("base64", "/w=="), ("utf8", "ok")]
