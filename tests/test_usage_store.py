import json
import os

import pytest

from skeinwork.operators import usage
from skeinwork.sources import usage_store as store
from tests.conftest import rows

A, B = "a" * 32, "b" * 32


def stamp(s, ns=0):
    return {"status": "available", "value": {"seconds": s, "nanoseconds": ns}}


def start(ident, entry=100, seen=101):
    r = store.start_record(ident, stamp(entry), "check", [b"x", b"\xff"], "/srv")
    return r | {"collected_wall_time": stamp(seen)}


def test_names():
    assert store.file_kind(f"{A}.start.json") == ("start", A) and store.file_kind(".lock") == ("lock", None)
    assert store.file_kind(".tmp." + A) == ("temporary", None)
    for bad in ("x", A + ".json", A.upper() + ".start.json", ".tmp.1"):
        with pytest.raises(store.StoreError):
            store.file_kind(bad)
    assert store.partition_id("/a") != store.partition_id("/b") and len(store.new_id()) == 32


def test_classify():
    good = json.dumps(start(A)).encode()
    assert store.classify(good, A, "start")[0] == "supported"
    assert store.classify(good, B, "start")[0] == "malformed" and store.classify(good[:-1], A, "start")[0] == "malformed"
    assert store.classify(good.replace(b'"revision": 1', b'"revision": 2'), A, "start")[0] == "unsupported"
    assert store.classify(good.replace(b'"event"', b'"id": "x", "event"'), A, "start")[0] == "malformed"
    assert store.classify(b" " * (usage.EVENT_BYTES + 1), A, "start")[0] == "oversized"


def test_publish_verify_and_scan(spark, tmp_path):
    folder = str(tmp_path / "p")
    receipt = store.publish(folder, start(A))
    assert store.verify(folder, receipt)
    with pytest.raises(store.StoreError):
        store.publish(folder, start(A))
    with pytest.raises(store.StoreError):
        store.publish(folder, {**start(B), "event": "finish"})
    store.publish(folder, {**start(A, 100, 109), "event": "finish"})
    store.publish(folder, start(B, 200, 201))
    grouped = usage.groups(store.read(spark, folder))
    assert rows(usage.pairing(grouped)) == [(A, "paired"), (B, "incomplete")]
    covered = usage.coverage(grouped)
    assert rows(covered.where("last is not null"), "id") == [(A,)]
    assert rows(usage.expired(covered, 109 + usage.RETENTION_S), "id") == [(A,)] and usage.expired(covered, 108 + usage.RETENTION_S).count() == 0
    assert rows(usage.eviction(covered, 10**9, 2), "id") == [(A,)]
    (tmp_path / "p" / (".tmp." + A)).write_text("left over")
    store.publish(folder, start("c" * 32), evict=[A])
    assert sorted(os.listdir(folder)) == sorted([".lock", f"{B}.start.json", "c" * 32 + ".start.json"])
    (tmp_path / "p" / "stray").write_text("")
    with pytest.raises(store.StoreError):
        store.scan(folder)


def test_lock_is_not_waited_for(tmp_path):
    with store.locked(str(tmp_path)), pytest.raises(store.StoreError), store.locked(str(tmp_path)):
        pass


def test_admission_stops_at_the_first_that_does_not_fit():
    kept, room = store.admit(["aa", "b" * 50, "c"], 20)
    assert kept == {"total": 3, "included": 1, "omitted": 2, "records": ["aa"]} and room == 14
    assert store.bounded_json({"a": 1}, 7) == b'{"a":1}' and store.bounded_json({"a": 1}, 6) is None


def test_invocation(tmp_path):
    run = store.Invocation(str(tmp_path), "check", [b"check"], "/srv", True)
    run.out.add(b"x" * 70_000)
    assert run.finish("clean", [{"name": "n"}])
    names = os.listdir(run.folder)
    assert len(names) == 3
    record = json.loads((tmp_path / store.partition_id("/srv") / f"{run.id}.finish.json").read_text())
    assert record["stdout"]["retained_bytes"] == store.STDOUT_BYTES and record["stdout"]["truncated"] and record["structured"]["findings"]["prefix"]["included"] == 1
    assert not store.Invocation(str(tmp_path), "check", [], "/srv", False).finish("clean")


@pytest.mark.parametrize("change", [{"junk": 1}, {"command": 3}, {"argv": "x"}, {"argv": [{"value": "x"}]}, {"structured": {}}, {"canonical_graph_root": None}])
def test_records_of_other_fields_are_malformed(change):
    assert store.classify(json.dumps(start(A) | change).encode(), A, "start")[0] == "malformed"


def test_a_start_lacks_no_part_and_counts_add_up():
    bare = {k: v for k, v in start(A).items() if k not in ("command", "argv")}
    assert store.classify(json.dumps(bare).encode(), A, "start")[0] == "malformed"
    done = store.finish_record(A, stamp(5), "clean", [{"name": "n"}], [], [], store.Capture(10), store.Capture(10), 7)
    assert store.classify(json.dumps(done).encode(), A, "finish")[0] == "supported"
    done["structured"]["hints"]["omitted"] = 1
    assert store.classify(json.dumps(done).encode(), A, "finish")[0] == "malformed"


def test_plans_are_those_of_the_operators(spark):
    import random

    rnd, now = random.Random(3), 10_000_000
    rows_of = []
    for i in range(160):
        ident, entry = f"{i:032x}", now - rnd.choice([0, 2, 9]) * 86_400 - rnd.randrange(50)
        for event in ("start", "finish")[: rnd.choice([1, 2, 2])]:
            seen = entry + rnd.choice([1, 5, -3])
            rows_of.append((ident, event, f"{ident}.{event}.json", rnd.randrange(100, 900), rnd.choice(["supported"] * 5 + ["malformed"]), entry, 7, seen, 8, None))
    usage_rows = spark.createDataFrame(rows_of, store.INVENTORY).selectExpr("xxhash64(name) as delivery_id", "*")
    covered = usage.coverage(usage.groups(usage_rows))
    old = {r.id for r in usage.expired(covered, now).collect()}
    assert old and set(store.plan(rows_of, 0, now * 10**9, "")) == old
    kept = covered.where(~covered.id.isin(list(old)))
    for size, files in ((60_000, 10_000), (10**9, 90), (20_000, 100)):
        went = {r.id for r in usage.eviction(kept, size, files).collect()}
        assert set(store.plan(rows_of, 0, now * 10**9, "", size, files + 1)) == old | went
    some = next(iter(old))
    assert some not in store.plan(rows_of, 0, now * 10**9, some)
    with pytest.raises(store.StoreError):
        store.plan(rows_of, 101, now * 10**9, "", 100)


def test_publishing_plans_under_its_lock(tmp_path):
    folder = str(tmp_path)
    late = (200 + usage.RETENTION_S) * 10**9
    store.publish(folder, start(A, 100, 101))
    store.publish(folder, {**start(A, 100, 109), "event": "finish"})
    with pytest.raises(store.StoreError):
        store.publish(folder, start(A), now_ns=late)
    assert f"{A}.start.json" in os.listdir(folder)  # a collision takes nothing away
    store.publish(folder, start(B, 200, 201), now_ns=late)
    assert sorted(os.listdir(folder)) == [".lock", f"{B}.start.json"]
