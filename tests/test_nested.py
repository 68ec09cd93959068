import json

from skeinwork.operators import nested
from tests.conftest import rows

SCHEMA = "delivery_id bigint, payload string, event string"


def payload(**kw):
    return {"event": "finish", "elapsed": {"status": "available"}, "entry_wall_time": {"value": {"seconds": 5}}, **kw}


def found(records):
    return {"structured": {"findings": {"prefix": {"records": records}}}}


def run(spark, *payloads):
    data = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "e") for i, p in enumerate(payloads)]
    return nested.occurrences(spark.createDataFrame(data, SCHEMA))


def test_every_child_with_its_parent_and_ordinal(spark):
    p = payload(argv=[{"value": "a"}, None, {"value": "b"}], **found([{"name": "x", "lines": [3, None, 4], "_graphs": "@fs"}, None, {"name": "y"}]))
    p["structured"] |= {"hints": {"records": {"name": "h"}}, "error": {"prefix": {"records": ["boom", None]}}}
    assert rows(nested.child_rows(run(spark, p))) == [
        (0, "arg", -1, 0), (0, "arg", -1, 2), (0, "error", -1, 0), (0, "finding", -1, 0), (0, "finding", -1, 2), (0, "graph", 0, 0), (0, "hint", -1, 0),
        (0, "line", 0, 0), (0, "line", 0, 2),
    ]


def test_strings_that_hold_json_stand_for_it(spark):
    p = payload(argv=json.dumps([1, 2]), structured=json.dumps({"findings": {"prefix": {"records": json.dumps({"lines": "[7, 8]", "_graphs": ["[1]"]})}}}))
    assert rows(nested.child_rows(run(spark, p))) == [
        (0, "arg", -1, 0), (0, "arg", -1, 1), (0, "finding", -1, 0), (0, "graph", 0, 0), (0, "line", 0, 0), (0, "line", 0, 1),
    ]


def test_what_is_no_json_gives_nothing(spark):
    assert nested.child_rows(run(spark, None, "", "{", '{"argv": [1]', '{"argv": NaN}', "[1]", "3", payload(argv=None), payload())).count() == 0


def test_identical_subtrees_are_stored_once(spark):
    one, other = {"name": "x", "lines": [1]}, {"lines": [1], "name": "x"}
    seen = run(spark, payload(**found([one, other])), payload(**found([one])))
    stored = nested.objects(seen)
    assert rows(stored.where("child = 'finding'"), "occurrences") == [(3,)]
    assert nested.reassemble(nested.bridge(seen), stored, "finding").count() == 3
    assert stored.where("child = 'record'").count() == 2  # records with other findings differ


def test_long_odd_and_empty(spark):
    deep = payload(argv=["\ud800", "x" * 100_000])
    assert run(spark, deep).where("child = 'arg'").count() == 2
    assert nested.occurrences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_record_table(spark):
    df = spark.createDataFrame([(1, json.dumps(payload()), "e"), (2, '{"event": 3, "entry_wall_time": "x"}', "e"), (3, "[1]", "e"), (4, None, "e")], SCHEMA)
    assert rows(nested.records(df)) == [(1, "finish", 5, "available"), (2, "3", None, None)]


def test_payloads_are_restored_from_stored_objects(spark, sf):
    odd = ["[1, {\"a\": []}]", "\"text\"", "3", "{\"b\": {\"#\": [\"" + "0" * 32 + "\"]}, \"a\": \"\\ud800\"}", "\"{\\\"argv\\\": [1]}\"", "{", None, payload(argv=[None, None]), payload(argv="[1,  2]")]
    texts = [x if x is None or isinstance(x, str) else json.dumps(x) for x in odd]
    usage = spark.read.parquet(f"{sf}/usage_events.parquet").select("delivery_id", "payload", "event")
    both = spark.createDataFrame([(-i, x, "e") for i, x in enumerate(texts, 1)], SCHEMA).unionByName(usage)
    got = {r.delivery_id: r.payload for r in nested.restore(nested.occurrences(both)).collect()}
    want = {}
    for r in both.collect():
        good, value = nested.parse_json(r.payload)
        if good:
            want[r.delivery_id] = json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert got == want


def test_records_that_differ_anywhere_differ_in_identity():
    one = payload(structured={"outcome": "a", "findings": {"total": 1, "prefix": {"records": [{"name": "x"}]}}})
    others = [json.loads(json.dumps(one)) for _ in range(4)]
    others[0]["structured"]["outcome"] = "b"
    others[1]["structured"]["findings"]["total"] = 2
    others[2]["structured"]["findings"]["prefix"]["records"].append(None)
    others[3]["argv"] = [None, None]
    assert len({nested.merkle_rows(0, json.dumps(p))[-1][5] for p in [one, *others]}) == 5


def test_very_deep_payloads(spark):
    deep = '{"argv": ' + "[" * 900 + "]" * 900 + "}"
    assert rows(nested.child_rows(run(spark, deep))) == [(0, "arg", -1, 0)]
