"""Schemas that drift between files: one table of one shape, and a report of each change.

Payloads become maps of path to raw type and value, and in the same Arrow pass partial statistics of
these by stream, file, path and type: how often, in what place, with which values and forms. Added up, they
say which fields a file has, of what type and with what content; consecutive files are compared by them. A
renamed field is found by its type, its place among the fields that stay and its content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .nested import canonical, parse_json

#: A field of more distinct values than this share of its rows has a form rather than a vocabulary.
OPEN_SHARE = 0.5
#: How many of the fields that stay may lie between a field and its new name.
PLACE_TOLERANCE = 3.0
#: How much likeness a step over such a field costs, and a step over a field that came or went.
MOVED, PASSED = 0.2 / PLACE_TOLERANCE, 0.02

_PARSED = pa.schema([
    ("record_id", pa.int64()), ("stream", pa.string()), ("file_seq", pa.int64()),
    ("values", pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))),
    ("path", pa.string()), ("type", pa.string()), ("what", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("place", pa.float64()),
    ("lo", pa.float64()), ("hi", pa.float64()), ("f1", pa.int64()), ("f2", pa.int64()), ("h", pa.int64()),
])
_PARSED_DDL = (
    "record_id bigint, stream string, file_seq bigint, values map<string,struct<type:string,value:string>>, path string, "
    "type string, what string, key string, n bigint, place double, lo double, hi double, f1 bigint, f2 bigint, h bigint"
)
_TYPE_OF = {bool: "boolean", int: "integer", float: "float", list: "array", str: "string"}
_LARGEST = 1.7976931348623157e308


def raw_type(value) -> str:
    return _TYPE_OF[type(value)]


def leaves(value: dict, prefix: str = "", out: list | None = None) -> list[tuple[str, object]]:
    """Fields of an object in written order: (dotted path, value).

    Objects are ways to their fields, arrays are values, nulls are none; the ``value`` beside a
    ``status`` of ``unavailable`` tells a reason and is no field.
    """
    out = [] if out is None else out
    for key, inner in value.items():
        if inner is None or key == "value" and value.get("status") == "unavailable":
            continue
        if isinstance(inner, dict):
            leaves(inner, f"{prefix}{key}.", out)
        else:
            out.append((prefix + key, inner))
    return out


def text_of(value) -> str:
    """The canonical text of a value."""
    if isinstance(value, str):
        return value
    return str(value) if type(value) is int else canonical(value)


_DIGITS, _LETTERS, _RUN = re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"([^9a])\1+")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+")


def form_of(value) -> str:
    """The form of a whole text: runs of digits, of letters and of any other character, each as one; hexadecimal
    texts with digits and letters by their length. Of an array, the types of its elements."""
    if isinstance(value, list):
        return "[" + ",".join(sorted({"null" if x is None else _TYPE_OF.get(type(x), "object") for x in value})) + "]"
    text = str(value)
    if _HEX.fullmatch(text):
        return f"hex{len(text)}"
    return _RUN.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub("a", text)))


def _safe(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def _number(value) -> float:
    try:
        return max(-_LARGEST, min(_LARGEST, float(value)))
    except OverflowError:
        return _LARGEST if value > 0 else -_LARGEST


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_of(text: str | None) -> int:
    """64-bit hash of a value's text, as a signed number; null is that of no value."""
    return 0 if text is None else _signed(xxhash.xxh64_intdigest(text))


class _Tally:
    """Partial statistics of the fields of one batch of records."""

    def __init__(self) -> None:
        self.files: dict[tuple, dict[tuple, tuple[dict, dict, dict]]] = {}

    def add(self, stream, seq, root: dict, found: list[tuple[str, object]]) -> None:
        keys = list(root)
        layout = keys[0] if keys and keys != sorted(keys) else ""  # sorted keys hide the written order
        fields = self.files.setdefault((stream, seq), {})
        for place, (path, value) in enumerate(found):
            kind = _TYPE_OF[type(value)]
            field = fields.get((path, kind))
            if field is None:
                field = fields[path, kind] = ({}, {}, {})
            layouts, values, forms = field
            seen = layouts.get(layout)
            if seen is None:
                seen = layouts[layout] = [0, 0]
            seen[0] += 1
            seen[1] += place
            if kind == "array":
                form = form_of(value)
                forms[form] = forms.get(form, 0) + 1
                for item in [canonical(x) for x in value] or [None]:
                    values[item] = values.get(item, 0) + 1
            else:
                values[value] = values.get(value, 0) + 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Layouts (``l``) and forms (``f``) of each field, then all values as (field, hash, count)."""
        few, ones, hashes, counts, sizes = [], [], [], [], []
        for (stream, seq), fields in self.files.items():
            for (path, kind), (layouts, values, forms) in fields.items():
                path = _safe(path)
                ident = xxhash.xxh3_128_intdigest(f"{stream}\0{seq}\0{path}\0{kind}")
                ident = (_signed(ident >> 64), _signed(ident & ((1 << 64) - 1)))
                lo, hi = (_number(min(values)), _number(max(values))) if kind in ("integer", "float") else (None, None)
                by = (None, stream, seq, None, path, kind)
                few += [(*by, "l", _safe(layout), n, float(place), lo, hi, *ident, None) for layout, (n, place) in layouts.items()]
                if kind == "string":
                    for value, n in values.items():
                        form = form_of(value)
                        forms[form] = forms.get(form, 0) + n
                few += [(*by, "f", _safe(form), n, None, None, None, *ident, None) for form, n in forms.items()]
                hashes += [hash_of(v if v is None else _safe(text_of(v))) for v in values]
                counts += values.values()
                ones.append(ident)
                sizes.append(len(values))
        yield _batch(few)
        if ones:
            ids = np.repeat(np.array(ones, np.int64), sizes, axis=0)
            held = {"n": pa.array(counts, pa.int64()), "f1": pa.array(ids[:, 0]), "f2": pa.array(ids[:, 1]), "h": pa.array(hashes, pa.int64())}
            yield pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(len(ids), f.type)) for f in _PARSED], schema=_PARSED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_PARSED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PARSED)], schema=_PARSED)


def parse(records: DataFrame, values: bool = False) -> DataFrame:
    """One pass over the payloads: partial statistics and, with ``values``, of every record its values by path.

    Statistics have a field's digest ``f1, f2``, records (all, unreadable ones with null ``values``) a ``record_id``. A value
    is its canonical text. Statistics are those of an Arrow batch, so that what follows is smaller than the
    values. Payloads that are not JSON objects have no fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally, out = _Tally(), []
            for rid, stream, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
                good, root = parse_json(payload)
                held = None
                if good and isinstance(root, dict):
                    found = leaves(root)
                    tally.add(stream, seq, root, found)
                    if values:
                        held = {_safe(p): {"type": raw_type(v), "value": _safe(text_of(v))} for p, v in found}
                if values:
                    out.append((rid, stream, seq, None if held is None else list(held.items()), *[None] * 11))
            if out:
                yield _batch(out)
            yield from tally.batches()

    return records.select("record_id", "stream", "file_seq", "payload").mapInArrow(run, _PARSED_DDL)


_BY = ["stream", "file_seq", "path", "type"]


def field_statistics(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per stream, file, path and type: rows, range, place, distinct values, main form and, of booleans, the share of true.

    Beside it every field's vocabulary: its distinct values as hashes ``h`` under its digest ``f1, f2``. Partial
    statistics are added up by (field, value) with a combine before the shuffle, so one file with a third of all
    records is no single task. ``place`` is taken from records in the file's main layout whose keys are not
    sorted, where it has such.
    """
    field = ["f1", "f2"]
    tall = materialize(
        parsed.where("f1 is not null").groupBy(*field, "h", *_BY, "what", "key").agg(
            F.sum("n").alias("n"), F.sum("place").alias("place"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ), "tallies",
    )
    few, values = tall.where("what is not null"), tall.where("what is null").select(*field, "h", "n")
    main = (
        few.where("what = 'l' and key <> ''").groupBy("stream", "file_seq", "key").agg(F.sum("n").alias("n"))
        .groupBy("stream", "file_seq").agg(F.max_by("key", F.struct("n", "key")).alias("__main"))
    )

    def when(condition: str, value) -> Column:
        return F.when(F.expr(condition), value)

    n, written = F.col("n"), "what = 'l' and key = __main"
    stats = few.join(main, ["stream", "file_seq"], "left").groupBy(*_BY, *field).agg(
        F.sum(when("what = 'l'", n)).alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.coalesce(
            F.sum(when(written, F.col("place"))) / F.sum(when(written, n)), F.sum(when("what = 'l'", F.col("place"))) / F.sum(when("what = 'l'", n))
        ).alias("place"),
        F.max_by("key", when("what = 'f'", F.struct(F.col("key") != "[]", "n", "key"))).alias("form"),
    )
    spread = values.groupBy(*field).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("items"), F.sum(when(f"h = {hash_of('true')}", n)).alias("yes")
    )
    return stats.join(spread, field), values.select(*field, "h")


def files_in_order(records: DataFrame) -> DataFrame:
    """Each file with its number in its stream (from 1) and its neighbours: stream, file_seq, idx, before, after.

    Files whose lines are all unreadable are files too. A window holds one stream's files.
    """
    order = Window.partitionBy("stream").orderBy("file_seq")
    return records.select("stream", "file_seq").distinct().select(
        "stream", "file_seq", F.row_number().over(order).alias("idx"), F.lag("file_seq").over(order).alias("before"),
        F.lead("file_seq").over(order).alias("after"),
    )


def _likeness(a: str, b: str, shared: Column) -> Column:
    """Likeness of two fields' contents, 0 to 1, from their statistics and the number of ``shared`` values; null-safe."""

    def of(name):
        return F.col(f"{a}.{name}"), F.col(f"{b}.{name}")

    (da, db), (ra, rb) = of("distinct_values"), of("items")
    common = shared / F.least(da, db)
    open_ended = (da > OPEN_SHARE * ra) & (db > OPEN_SHARE * rb)
    fa, fb = of("form")
    alike_form = F.when(fa == fb, 1.0).otherwise(0.0)
    (la, lb), (ha, hb) = of("lo"), of("hi")
    overlap = F.least(ha, hb) - F.greatest(la, lb)
    width = F.least(ha - la, hb - lb)
    ranges = (
        F.when((overlap >= 0) & (width <= 0), 1.0)
        .when(overlap > 0, overlap / width * F.least(ha, hb) / F.greatest(ha, hb, F.lit(1e-9)))
        .when((width <= 0) & (F.abs(ha - hb) <= 2), 0.7)  # a number that counts up, such as a revision
        .otherwise(0.0)
    )
    ya, yb = (F.coalesce(y, F.lit(0)) / r for y, r in zip(of("yes"), (ra, rb)))
    text = F.when(open_ended, F.greatest(alike_form, common)).otherwise(common)
    kind = F.col(f"{a}.type")
    return (
        F.when(kind == "boolean", F.least(ya, yb) + F.least(1 - ya, 1 - yb))
        .when(kind.isin("integer", "float"), F.greatest(ranges, F.when(~open_ended, common).otherwise(0.0)))
        .when(kind == "array", F.when(fa == fb, F.greatest(common, F.when(open_ended, 0.6).otherwise(0.0))).otherwise(0.0))
        .otherwise(text)
    )


def _fields_in_order(records: DataFrame, stats: DataFrame) -> DataFrame:
    """Each path of each file with its types and most frequent type's statistics, beside the files before and after.

    ``kept_before`` and ``kept_after`` tell whether the neighbouring file has the path too; ``at_before``,
    ``at_after`` how many paths of that kind are written before it, ``new_before``, ``gone_before`` how many others.
    """
    rest = [c for c in stats.columns if c not in ("stream", "file_seq", "path")]
    fields = stats.groupBy("stream", "file_seq", "path").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.max_by(F.struct(*rest), F.struct("rows", "type")).alias("stat")
    ).join(files_in_order(records), ["stream", "file_seq"])
    path = Window.partitionBy("stream", "path").orderBy("idx")
    fields = fields.select(
        "*", F.coalesce(F.lag("idx").over(path) == F.col("idx") - 1, F.lit(False)).alias("kept_before"), F.lag("types").over(path).alias("types_before"),
        F.coalesce(F.lead("idx").over(path) == F.col("idx") + 1, F.lit(False)).alias("kept_after"),
    )
    earlier = Window.partitionBy("stream", "file_seq").orderBy("stat.place", "path").rowsBetween(Window.unboundedPreceding, -1)

    def count(kept: str, value: bool) -> Column:
        return F.coalesce(F.sum((F.col(kept) == value).cast("long")).over(earlier), F.lit(0))

    return fields.select(
        "*", count("kept_before", True).alias("at_before"), count("kept_before", False).alias("new_before"),
        count("kept_after", True).alias("at_after"), count("kept_after", False).alias("gone_before"),
    )


def schema_changes(records: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Each change of a file against the one before it: stream, file_seq, change, field, new_field.

    Changes are added, removed, retyped and renamed. Gone and new fields of one file meet only in the
    same type and in like places among the fields that stay; the likest pair is taken where each is
    the other's best. ``parsed`` is ``parse(records)``, where it is at hand.
    """
    stats, vocabulary = field_statistics(parse(records) if parsed is None else parsed)
    fields = materialize(_fields_in_order(records, stats), "fields")
    retyped = fields.where("kept_before and types <> types_before").select(
        "stream", "file_seq", F.lit("retyped").alias("change"), F.col("path").alias("field"), F.lit("").alias("new_field")
    )
    gone = fields.where("not kept_after and after is not null").select(
        "stream", F.col("after").alias("file_seq"), F.col("file_seq").alias("before"), F.col("path").alias("field"), F.col("stat").alias("a"),
        F.col("stat.type").alias("type"), F.col("at_after").alias("at_a"), F.col("gone_before").alias("passed_a"),
    )
    new = fields.where("not kept_before and before is not null").select(
        "stream", "file_seq", F.col("path").alias("new_field"), F.col("stat").alias("b"), F.col("stat.type").alias("type"),
        F.col("at_before").alias("at_b"), F.col("new_before").alias("passed_b"),
    )
    moved = F.abs(F.col("at_a") - F.col("at_b"))
    near = F.floor(F.col("at_a") / PLACE_TOLERANCE)
    pairs = gone.withColumn("zone", F.explode(F.array(near - 1, near, near + 1))).join(
        new.withColumn("zone", F.floor(F.col("at_b") / PLACE_TOLERANCE)), ["stream", "file_seq", "type", "zone"]
    ).where(moved <= PLACE_TOLERANCE)
    pairs = materialize(pairs, "pairs")
    pair = ["stream", "file_seq", "field", "new_field"]
    ends = F.explode(F.array(F.struct("a.f1", "a.f2"), F.struct("b.f1", "b.f2")))
    # all distinct values of each pair's two fields, one row a value: containment is exact
    shared = (
        pairs.where("type <> 'boolean'").select(*pair, ends.alias("end")).select(*pair, "end.*").join(vocabulary, ["f1", "f2"])
        .groupBy(*pair, "h").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        .groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"))
    )
    scored = pairs.join(shared, pair, "left").withColumn("like", _likeness("a", "b", F.coalesce("shared", F.lit(0)))).where(
        F.col("like") >= F.when(F.col("type").isin("string", "array"), 0.3).otherwise(0.5)
    ).withColumn("score", F.col("like") - MOVED * moved - PASSED * F.least(F.abs(F.col("passed_a") - F.col("passed_b")), F.lit(5)))

    def best(side: str, other: str) -> Column:
        return F.row_number().over(
            Window.partitionBy("stream", "file_seq", side).orderBy(F.desc("score"), F.asc(other))
        )

    renamed = (
        scored.withColumn("__a", best("field", "new_field")).withColumn("__b", best("new_field", "field"))
        .where("__a = 1 and __b = 1").select("stream", "file_seq", "field", "new_field")
    )
    renamed = materialize(renamed, "renamed")
    removed = gone.select("stream", "file_seq", "field").join(renamed, ["stream", "file_seq", "field"], "left_anti")
    added = new.select("stream", "file_seq", "new_field").join(renamed, ["stream", "file_seq", "new_field"], "left_anti")

    def report(df: DataFrame, change: str, field: str, new_field: Column) -> DataFrame:
        return df.select("stream", F.col("file_seq").cast("long").alias("file_seq"), F.lit(change).alias("change"), F.col(field).alias("field"), new_field.alias("new_field"))

    empty = F.lit("")
    return (
        report(renamed, "renamed", "field", F.col("new_field"))
        .unionByName(report(removed, "removed", "field", empty))
        .unionByName(report(added, "added", "new_field", empty))
        .unionByName(report(retyped, "retyped", "field", empty))
    )


def field_lineage(stats: DataFrame, records: DataFrame, changes: DataFrame) -> DataFrame:
    """The consistent name of every field in every file: stream, file_seq, path, field.

    A field lives from the file it comes in to the one before it is gone. Renames join the lives of its names
    to chains, followed back by pointer doubling until none is left; a chain is named after its first path.
    A path that comes back unrelated takes its old name again, unless the old chain is still there: then it is
    ``path#file_seq`` of the file it came in.
    """
    path = Window.partitionBy("stream", "path").orderBy("idx")
    present = stats.select("stream", "file_seq", "path").distinct().join(files_in_order(records), ["stream", "file_seq"])
    begins = F.when(F.lag("idx").over(path) == F.col("idx") - 1, None).otherwise(F.col("file_seq"))
    present = present.withColumn("__b", begins).withColumn("since", F.last("__b", ignorenulls=True).over(path))
    present = materialize(present.select("stream", "file_seq", "idx", "before", "path", "since"), "present")
    lives = present.groupBy("stream", "path", "since").agg(
        F.min("idx").alias("from"), F.max("idx").alias("to"), F.min_by("before", "idx").alias("before")
    )
    ends = present.select("stream", F.col("file_seq").alias("before"), F.col("path").alias("field"), F.col("since").alias("since_up"))
    names = changes.where("change = 'renamed'").select("stream", F.col("file_seq").alias("since"), F.col("new_field").alias("path"), "field")
    links = materialize(
        lives.join(names, ["stream", "path", "since"]).join(ends, ["stream", "before", "field"])
        .select("stream", "path", "since", F.col("field").alias("up"), "since_up"), "links",
    )
    while True:
        above = links.select("stream", F.col("path").alias("up"), F.col("since").alias("since_up"), F.col("up").alias("__up"), F.col("since_up").alias("__since"))
        if links.join(above, ["stream", "up", "since_up"], "left_semi").isEmpty():
            break
        links = materialize(
            links.join(above, ["stream", "up", "since_up"], "left").select(
                "stream", "path", "since", F.coalesce("__up", "up").alias("up"), F.coalesce("__since", "since_up").alias("since_up")
            ), "links",
        )
    chained = lives.join(links, ["stream", "path", "since"], "left").select(
        "stream", "path", "since", "from", "to", F.coalesce("up", "path").alias("head"), F.coalesce("since_up", "since").alias("head_since")
    )
    chains = chained.groupBy("stream", "head", "head_since").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    before = Window.partitionBy("stream", "head").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    still = F.max("to").over(before) >= F.col("from")
    named = chains.select(
        "stream", "head", "head_since", F.when(still, F.concat("head", F.lit("#"), F.col("head_since").cast("string"))).otherwise(F.col("head")).alias("field")
    )
    of_life = chained.join(named, ["stream", "head", "head_since"]).select("stream", "path", "since", "field")
    return present.join(of_life, ["stream", "path", "since"]).select("stream", "file_seq", "path", "field")


#: The Spark type that a raw type is read as.
TYPES = {"boolean": "boolean", "integer": "bigint", "float": "double", "string": "string", "array": "string"}


def field_types(records: DataFrame, changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """The consistent field and its type for every path of every file: stream, file_seq, path, field, wanted.

    A field's type is the one most of its values have (integers next to floats are floats; ties go by name).
    """
    stats = materialize(field_statistics(parsed)[0].select(*_BY, "rows"), "types")
    named = stats.join(field_lineage(stats, records, changes), ["stream", "file_seq", "path"])
    wanted = named.groupBy("field", "type").agg(F.sum("rows").alias("n")).groupBy("field").agg(
        F.max_by("type", F.struct("n", "type")).alias("most"), F.collect_set("type").alias("all")
    ).select(
        "field",
        F.when((F.col("most") == "integer") & F.array_contains("all", "float"), "float").otherwise(F.col("most")).alias("wanted"),
    )
    found = named.select("stream", "file_seq", "path", "field").distinct().join(wanted, "field")
    return materialize(found.select("stream", "file_seq", "path", "field", "wanted"), "lineage")


def cast_values(records: DataFrame, changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Every record with its values under their consistent names and types: record_id, stream, file_seq, readable, cast.

    ``cast`` holds (field, type, wanted, value, typed): ``typed`` is the canonical text of the cast value, null where the
    cast fails. Records meet one row a file, which tells its paths' fields; values are never shuffled.
    """
    parsed = materialize(parse(records, True), "parsed") if parsed is None else parsed
    of_file = field_types(records, changes, parsed).groupBy("stream", "file_seq").agg(
        F.map_from_entries(F.collect_list(F.struct("path", F.struct("field", "wanted")))).alias("__names")
    )
    rows = parsed.where("f1 is null").select("record_id", "stream", "file_seq", "values").join(of_file, ["stream", "file_seq"], "left")
    cast = F.expr(
        "transform(map_entries(values), e -> named_struct('field', __names[e.key].field, 'type', e.value.type, "
        "'wanted', __names[e.key].wanted, 'value', e.value.value, 'typed', case __names[e.key].wanted "
        "when 'integer' then cast(try_cast(e.value.value as bigint) as string) "
        "when 'float' then cast(try_cast(e.value.value as double) as string) "
        "when 'boolean' then cast(try_cast(e.value.value as boolean) as string) "
        "when 'array' then if(e.value.type = 'array', e.value.value, null) else e.value.value end))"
    )
    return rows.select("record_id", "stream", "file_seq", F.col("values").isNotNull().alias("readable"), cast.alias("cast"))


def one_table(records: DataFrame, changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """All records in one shape: record_id, stream, file_seq, readable, fields (map of field to typed text).

    Unreadable records stay, with an empty map.
    """
    held = F.expr("map_from_entries(transform(filter(cast, c -> c.typed is not null), c -> struct(c.field, c.typed)))")
    return cast_values(records, changes, parsed).select(
        "record_id", "stream", "file_seq", "readable", F.coalesce(held, F.expr("cast(map() as map<string,string>)")).alias("fields")
    )


def typed_table(records: DataFrame, changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """All records with one typed column for each consistent field, in order of name, after record_id, stream, file_seq, readable.

    Values that do not fit are null (``failed_casts`` counts them). Dots and backquotes of a name are written as ``__``; a
    name that is taken, letter case aside, gets underscores at its end. The number of fields is that of the schema, not of the records.
    """
    parsed = materialize(parse(records, True), "parsed") if parsed is None else parsed
    kinds = {r["field"]: r["wanted"] for r in field_types(records, changes, parsed).select("field", "wanted").distinct().collect()}
    first = ["record_id", "stream", "file_seq", "readable"]
    taken, columns = set(first), []
    for field in sorted(kinds):
        name = re.sub("[.`]", "__", field)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.col("fields")[field].cast(TYPES[kinds[field]]).alias(name))
    return one_table(records, changes, parsed).select(*first, *columns)


def failed_casts(records: DataFrame, changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Values that do not fit their field's type, counted by stream, file, field and raw type."""
    failed = cast_values(records, changes, parsed).select("stream", "file_seq", F.explode(F.expr("filter(cast, c -> c.typed is null)")).alias("c"))
    return failed.groupBy("stream", "file_seq", "c.field", "c.type", "c.wanted").agg(
        F.count(F.lit(1)).alias("values"), F.min("c.value").alias("example")
    )
