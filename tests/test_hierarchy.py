import random
from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skeinwork.operators import hierarchy
from tests.conftest import rows

SCHEMA = "edge_id bigint, graph string, source string, target string, seen_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def brute(parents):
    full = dict(parents)
    for p in parents.values():
        if p is not None:
            full.setdefault(p, None)
    way, reach = {}, Counter()
    for v in full:
        seen, at = [], v
        while at is not None and at not in seen:
            seen.append(at)
            at = full[at]
        way[v] = (seen, at)
        reach.update(seen[1:])
    out = {}
    for v, (seen, stop) in way.items():
        if stop is None:
            out[v] = (seen[-1], len(seen) - 1, reach[v], 0, seen[::-1])
        else:
            out[v] = ("", -1, reach[v], 2 if stop == v else 1, None)
    return out


def check(spark, parents):
    edges = spark.createDataFrame([(i, "outline", s, t, T0) for i, (s, t) in enumerate(parents.items())], SCHEMA)
    got = {r.node: (r.root, r.depth, r.impact_radius, r.cyclic, r.path) for r in hierarchy.hierarchy(hierarchy.current_parents(edges), paths=True).collect()}
    assert got == brute(parents)


def test_chain_star_loop_and_self_loop(spark):
    parents = {f"c{i}": f"c{i + 1}" for i in range(40)} | {f"s{i}": "hub" for i in range(60)} | {"hub": None}
    parents |= {"x": "y", "y": "z", "z": "x", "t1": "x", "t2": "t1", "me": "me", "on": "me", "p": "q", "q": "p"}
    check(spark, parents)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_parents(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 25)
    check(spark, {f"n{i}": rnd.choice([None, *[f"n{j}" for j in range(n)]]) for i in range(n)})


def test_current_rows(spark):
    later = T0 + timedelta(days=1)
    edges = spark.createDataFrame([
        (1, "outline", "a", "old", T0), (2, "outline", "a", "new", later), (3, "outline", "a", "new", later), (4, "fs", "a", "zzz", later + timedelta(1)),
        (5, "outline", None, "lost", later), (6, "outline", "b", None, T0), (7, "outline", "c", "", T0),
    ], SCHEMA)
    assert rows(hierarchy.current_parents(edges)) == [("", None), ("a", "new"), ("b", None), ("c", ""), ("new", None)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(hierarchy.current_parents(empty)).count() == 0


def test_descendants(spark):
    edges = spark.createDataFrame([(1, "outline", "b", "a", T0), (2, "outline", "c", "b", T0), (3, "outline", "l", "l", T0)], SCHEMA)
    tree = hierarchy.hierarchy(hierarchy.current_parents(edges), paths=True)
    assert rows(hierarchy.descendants(tree)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_descendants_on_and_below_loops(spark):
    parents = {"x": "y", "y": "z", "z": "x", "t1": "x", "t2": "t1", "me": "me", "on": "me", "b": "a", "p": "q", "q": "p"}
    parents |= {f"l{i}": f"l{(i + 1) % 17}" for i in range(17)} | {f"h{i}": f"l{i % 5}" for i in range(9)} | {f"d{i}": f"d{i + 1}" for i in range(12)} | {"d12": "l7"}
    edges = spark.createDataFrame([(i, "outline", s, t, T0) for i, (s, t) in enumerate(parents.items())], SCHEMA)
    want = []
    for v in {**parents, "a": None}:
        seen, at = [v], parents.get(v)
        while at is not None and at not in seen:
            want.append((at, v, len(seen)))
            seen.append(at)
            at = parents.get(at)
    tree = hierarchy.hierarchy(hierarchy.current_parents(edges), paths=True)
    got = rows(hierarchy.descendants(tree), "ancestor", "descendant", "steps")
    assert got == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    assert Counter(a for a, _, _ in got) == {r.node: r.impact_radius for r in tree.collect() if r.impact_radius}


def test_rounds_and_one_task_agree(spark, sf, monkeypatch):
    links = hierarchy.current_parents(spark.read.parquet(f"{sf}/raw_edges.parquet"))
    extra = [(f"c{i}", f"c{(i * 7 + 3) % 40}") for i in range(40)] + [(f"d{i}", f"d{i - 1}" if i else "c5") for i in range(30)] + [("self", "self"), ("alone", None)]
    links = links.unionByName(spark.createDataFrame(extra, "node string, parent string"))
    got = []
    for most in (0, 60, 100_000):
        monkeypatch.setattr(hierarchy, "LOCAL_NODES", most)
        tree = hierarchy.hierarchy(links, paths=True)
        got.append((rows(tree, "node", "root", "depth", "impact_radius", "cyclic"), rows(tree.where("cyclic = 0"), "node", "path"), rows(hierarchy.descendants(tree))))
    assert got[0] == got[1] == got[2]
