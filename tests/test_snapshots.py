from skeinwork.operators import snapshots
from tests.conftest import rows

N, E = "snapshot_seq bigint, path string, hash string, extra int", "snapshot_seq bigint, source string, target string, target_hash string"


def test_changes(spark):
    nodes = [(s, p, h, 1) for s, p, h in [
        (1, "same", "h"), (1, "same", "h"), (2, "same", "h"), (4, "same", "h"), (1, "moved", "a"), (2, "moved", "b"), (4, "moved", "b"), (1, "back", "x"), (4, "back", "x"),
        (2, "new", None), (4, "new", "n"), (1, "gone", "g"), (1, "links", "l"), (2, "links", "l"), (4, "links", "l"), (1, None, "z"),
    ]]
    edges = [(1, "links", "a", None), (1, "links", "b", "h"), (2, "links", "b", "h"), (2, "links", "a", None), (2, "links", "a", None), (4, "links", "a", "k"), (4, "links", "b", "h"), (1, "stray", "a", "b")]
    got = rows(snapshots.lock_changes(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)))
    assert got == [
        (2, "back", "removed"), (2, "gone", "removed"), (2, "moved", "changed"), (2, "new", "added"), (4, "back", "added"), (4, "links", "changed"), (4, "new", "changed"),
    ]


def test_null_hash_is_a_value(spark):
    nodes = spark.createDataFrame([(1, "a", None, 1), (2, "a", "", 1), (3, "a", None, 1), (4, "a", None, 1)], N)
    assert rows(snapshots.lock_changes(nodes, spark.createDataFrame([], E))) == [(2, "a", "changed"), (3, "a", "changed")]


def test_one_snapshot_or_none(spark):
    empty = spark.createDataFrame([], E)
    assert snapshots.lock_changes(spark.createDataFrame([(7, "a", "h", 1)], N), empty).count() == 0
    assert snapshots.lock_changes(spark.createDataFrame([], N), empty).count() == 0
