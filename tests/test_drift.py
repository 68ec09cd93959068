import json

from skeinwork.operators import drift
from tests.conftest import rows

SCHEMA = "record_id bigint, stream string, file_seq bigint, payload string, extra string"


def frame(spark, files, stream="s"):
    out, n = [], 0
    for seq, records in files.items():
        for r in records:
            n += 1
            out.append((n, stream, seq, r if r is None or isinstance(r, str) else json.dumps(r), "x"))
    return spark.createDataFrame(out, SCHEMA)


def changes(spark, files):
    return rows(drift.schema_changes(frame(spark, files)), "file_seq", "change", "field", "new_field")


def many(make, n=12):
    return [make(i) for i in range(n)]


def test_added_removed_retyped(spark):
    assert changes(spark, {
        1: many(lambda i: {"a": i, "b": f"v{i % 3}", "c": {"d": True}}),
        2: many(lambda i: {"a": i + 0.5, "c": {"d": True}, "e": [1]}),
    }) == [(2, "added", "e", ""), (2, "removed", "b", ""), (2, "retyped", "a", "")]


def test_renamed_by_place_and_content(spark):
    first = many(lambda i: {"schema": "x", "mode": ["json", "text"][i % 2], "size": 100 * i, "ok": True})
    second = many(lambda i: {"schema": "x", "output": ["json", "text"][i % 2], "bytes": 100 * i + 7, "ok": True})
    assert changes(spark, {1: first, 4: second}) == [(4, "renamed", "mode", "output"), (4, "renamed", "size", "bytes")]


def test_like_type_but_other_content_is_no_rename(spark):
    first = many(lambda i: {"z": 1, "mode": ["json", "text"][i % 2]})
    second = many(lambda i: {"z": 1, "queue": ["slow", "fast"][i % 2]})
    assert changes(spark, {1: first, 2: second}) == [(2, "added", "queue", ""), (2, "removed", "mode", "")]


def test_what_is_no_field(spark):
    first = [{"t": {"status": "available", "value": 3}, "n": None, "o": {}}]
    second = [{"t": {"status": "unavailable", "value": "why"}}, "not json", "[1]", None, '{"cut": ']
    assert changes(spark, {1: first, 2: second}) == [(2, "removed", "t.value", "")]


def test_files_without_readable_lines_and_empty_tables(spark):
    assert changes(spark, {1: [{"a": 1}], 2: ["x"], 3: [{"a": 1}]}) == [(2, "removed", "a", ""), (3, "added", "a", "")]
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(empty).count() == 0
    assert drift.one_table(empty, drift.schema_changes(empty)).count() == 0


def test_one_table_follows_renames_and_reports_failed_casts(spark):
    first = many(lambda i: {"k": 1, "size": 10 * i, "z": 0})
    second = many(lambda i: {"k": 1, "bytes": 10 * i, "z": 0}) + ["torn"]
    third = [{"k": 1, "bytes": "9 B", "z": 0}]
    df = frame(spark, {1: first, 2: second, 3: third})
    found = drift.schema_changes(df)
    table = {r.record_id: r for r in drift.one_table(df, found).collect()}
    assert len(table) == 26
    assert table[14].fields["size"] == "10" and not table[25].readable and table[26].fields == {"k": "1", "z": "0"}
    assert rows(drift.failed_casts(df, found), "field", "type", "wanted", "values", "example") == [("size", "string", "integer", 1, "9 B")]


def test_renamed_where_one_file_has_many_more_values(spark):
    first = many(lambda i: {"z": 1, "mode": f"v{i % 35}x"}, 105)
    second = many(lambda i: {"z": 1, "queue": f"v{i % 1000}x"}, 2000)
    assert changes(spark, {1: first, 2: second}) == [(2, "renamed", "mode", "queue")]
    assert changes(spark, {1: second, 2: first}) == [(2, "renamed", "queue", "mode")]


def test_typed_table_has_a_column_for_each_field(spark):
    first = many(lambda i: {"k": {"on": True}, "size": 10 * i, "stream": "x", "K.on": 1.5, "tags": ["a"]})
    second = many(lambda i: {"k": {"on": "maybe" if i else False}, "bytes": 10 * i, "stream": "x", "K.on": 2, "tags": "a"}) + ["torn", None]
    df = frame(spark, {1: first, 2: second})
    found = drift.schema_changes(df)
    table = drift.typed_table(df, found)
    assert [(f.name, f.dataType.simpleString()) for f in table.schema][4:] == [
        ("K__on", "double"), ("k__on_", "boolean"), ("size", "bigint"), ("stream_", "string"), ("tags", "string"),
    ]
    got = {r.record_id: r for r in table.select(*table.columns).collect()}
    assert len(got) == 26 and got[14]["size"] == 10 and got[13]["k__on_"] is False and got[14]["k__on_"] is None and not got[25].readable
    assert rows(drift.failed_casts(df, found), "field", "type", "values") == [("k.on", "string", 11)]  # tags: a tie, so texts, which all fit


def test_names_that_come_back_do_not_meet_in_one_record(spark):
    files = {
        1: many(lambda i: {"z": 1, "mode": ["json", "text"][i % 2]}), 2: many(lambda i: {"z": 1, "output": ["json", "text"][i % 2]}),
        3: many(lambda i: {"z": 1, "output": ["json", "text"][i % 2], "mode": f"job {i}"}),
    }
    df = frame(spark, files)
    found = drift.schema_changes(df)
    assert ("renamed", "mode", "output") in rows(found, "change", "field", "new_field")
    fields = {r.record_id: r.fields for r in drift.one_table(df, found).collect()}
    assert set(fields[1]) == set(fields[13]) == {"z", "mode"} and set(fields[25]) == {"z", "mode", "mode#3"}


def test_forms_are_those_of_whole_texts():
    assert drift.form_of("a" * 100 + "1") != drift.form_of("a" * 100) and drift.form_of("x--12y") == "a-9a"
    assert drift.form_of("0af3") == "hex4" and drift.form_of("123456789") == "9" and drift.form_of([1, None, {"a": 1}]) == "[integer,null,object]"
