import random
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.llm import packing


def lay(histogram, capacity):
    """Contents of each container by a plan."""
    bins = defaultdict(list)
    for size, _, count, first, stride in packing.plan(histogram, capacity):
        for k in range(count):
            bins[first + k // stride].append(size)
    return bins


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_every_item_within_capacity(sizes):
    bins = lay(Counter(sizes), 60)
    assert all(sum(b) <= 60 for b in bins.values())
    assert Counter(x for b in bins.values() for x in b) == Counter(sizes)
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= best_fit_decreasing(sizes, 60) * 1.25 + 1


def test_planning_time_depends_on_sizes_not_items():
    rnd = random.Random(1)
    few = packing.plan({s: rnd.randint(1, 9) for s in range(1, 2049)}, 2048)
    many = packing.plan({s: rnd.randint(1, 10**9) for s in range(1, 2049)}, 2048)
    assert len(many) < 20_000 and len(few) < 20_000


def run(spark, counts, capacity):
    df = spark.createDataFrame(list(counts.items()), "doc_id bigint, n_tokens bigint").withColumn("size", F.lit(-1))
    return packing.pack(df.select("doc_id", "n_tokens"), capacity).collect()


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 250), min_size=1, max_size=80))
def test_pack(spark, sizes):
    got = run(spark, dict(enumerate(sizes)), 100)
    load, by_doc = Counter(), defaultdict(list)
    for r in got:
        load[r.container] += r["size"]
        by_doc[r.doc_id].append((r.part, r.first_token, r["size"]))
    assert all(v <= 100 for v in load.values())
    for i, n in enumerate(sizes):
        parts = sorted(by_doc.get(i, []))
        assert sum(p[2] for p in parts) == n and len(parts) == -(-n // 100)
        assert [p[1] for p in parts] == [100 * k for k in range(len(parts))]


def test_nothing_to_place_and_one_size_for_all(spark):
    assert run(spark, {1: 0}, 10) == []
    got = run(spark, {i: 4 for i in range(101)}, 10)
    assert len({r.container for r in got}) == 51
