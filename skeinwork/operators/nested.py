"""Deeply nested records to related flat tables, with identical subtrees stored once.

Each payload becomes a Merkle tree: bottom-up, every object and array is given the digest of its canonical
body, in which the objects and arrays below it stand as references ``{"#":[identity]}``. No key is left out, so
that records that differ anywhere differ in identity and every payload can be restored. Objects are stored once by
identity; each occurrence is a bridge row that links its parent to a child identity by ordinal.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Where child collections lie in a payload: child kind -> path of keys.
COLLECTIONS = {
    "arg": ("argv",),
    "finding": ("structured", "findings", "prefix", "records"),
    "hint": ("structured", "hints", "records"),
    "error": ("structured", "error", "prefix", "records"),
}
#: Collections inside a finding.
INNER = {"line": ("lines",), "graph": ("_graphs",)}

SEEN = pa.schema([
    ("delivery_id", pa.int64()), ("child", pa.string()), ("parent_pos", pa.int64()), ("pos", pa.int64()),
    ("parent_identity", pa.string()), ("identity", pa.string()), ("body", pa.string()), ("n", pa.int64()),
])
_SEEN_DDL = (
    "delivery_id bigint, child string, parent_pos bigint, pos bigint, parent_identity string, identity string, "
    "body string, n bigint"
)
#: Children that are no child of a collection: the objects and arrays between.
PLAIN = ("object", "array")
#: A reference within a body.
_REFERENCE = r'\{"#":\["([0-9a-f]{32})"\]\}'
#: Identities that a task remembers to have written with their bodies; then it begins anew.
REMEMBERED = 200_000


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def parse_json(text: str | None):
    """(True, value) of strict JSON, else (False, None)."""
    if text is None:
        return False, None
    try:
        return True, _decoder.decode(text)
    except (ValueError, RecursionError):
        return False, None


def unwrap(value):
    """A string that holds a JSON array or object stands for it."""
    if not isinstance(value, str) or value.lstrip()[:1] not in ("[", "{"):
        return value
    good, inner = parse_json(value)
    return inner if good and isinstance(inner, (list, dict)) else value


def follow(value, keys):
    """The value at a path of keys, seen through strings that hold objects; None where it is absent."""
    for key in keys:
        value = unwrap(value)
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return unwrap(value)


def elements(value) -> list:
    """A collection as a list: absent or null is empty, a single value an array of one."""
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _writer(ascii_only: bool) -> Callable[[object], str]:
    """A canonical JSON writer that is made once, where the standard library makes one a call."""
    plain = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    if json.encoder.c_make_encoder is None:
        return plain.encode
    text = json.encoder.encode_basestring_ascii if ascii_only else json.encoder.encode_basestring
    made = json.encoder.c_make_encoder(None, plain.default, text, None, ":", ",", True, False, True)
    return lambda value: "".join(made(value, 0))


_write, _write_ascii = _writer(False), _writer(True)


def canonical(value) -> str:
    """One text for equal JSON values: sorted keys, no blanks, unescaped non-ASCII letters."""
    return _write(value)


def identity_of(kind: str, body: str) -> str:
    return hashlib.blake2b(f"{kind}\0{body}".encode(), digest_size=16).hexdigest()


def child_elements(root) -> list[tuple]:
    """Non-null elements of all collections, each finding before its own: (child, parent_pos, pos, value)."""
    out = []
    if not isinstance(root, dict):
        return out
    for kind, keys in COLLECTIONS.items():
        for pos, item in enumerate(elements(follow(root, keys))):
            if item is None:
                continue
            item = unwrap(item)
            out.append((kind, -1, pos, item))
            if kind == "finding" and isinstance(item, dict):
                for inner, inner_keys in INNER.items():
                    found = enumerate(elements(follow(item, inner_keys)))
                    out += [(inner, pos, at, leaf) for at, leaf in found if leaf is not None]
    return out


def merkle_rows(delivery: int, payload: str | None) -> list[tuple]:
    """The tree of one payload: rows (delivery, child, parent_pos, pos, parent_identity, identity, body).

    First the objects and arrays that are no child of their own (child ``object`` or ``array``, no delivery),
    then children, the record itself last (child ``record``). Bodies are ASCII, so lone surrogates stay. A
    string that holds JSON stays a string in its parent's body, what it holds is stored beside it.
    Payloads that are not JSON give no row. A payload that is JSON but no object gives the record alone.
    """
    good, value = parse_json(payload)
    if not good:
        return []
    root = unwrap(value)
    found = child_elements(root)
    kinds = {id(item): child for child, _, _, item in found}
    known: dict[int, str] = {}  # identities by object; all objects live as long as ``value`` and ``found``
    bodies: dict[str, str] = {}
    stored: list[tuple] = []

    def put(v, child: str | None = None) -> str:
        """Store an object or array and all below it."""
        if id(v) in known:
            return known[id(v)]
        child = child or kinds.get(id(v)) or ("object" if isinstance(v, dict) else "array")
        if isinstance(v, dict):
            flat = {k: {"#": [put(x)]} if isinstance(x, (dict, list)) else x for k, x in v.items()}
        else:
            flat = [{"#": [put(x)]} if isinstance(x, (dict, list)) else x for x in v]
        ident = known[id(v)] = leaf(flat, child)
        if child in PLAIN:
            stored.append((None, child, None, None, None, ident, bodies[ident]))
        return ident

    def leaf(flat, child: str) -> str:
        body = _write_ascii(flat)
        ident = identity_of(child, body)
        bodies[ident] = body
        return ident

    top = put(value, "record") if isinstance(value, (dict, list)) else leaf(value, "record")
    rows, findings = [], {}
    for child, parent_pos, pos, item in found:
        ident = put(item) if isinstance(item, (dict, list)) else leaf(item, child)
        if child == "finding":
            findings[pos] = ident
        rows.append((delivery, child, parent_pos, pos, findings[parent_pos] if child in INNER else top, ident, bodies[ident]))
    return [*stored, *rows, (delivery, "record", -1, -1, None, top, bodies[top])]


def occurrences(usage: DataFrame) -> DataFrame:
    """Every occurrence of every child and record, and the plain objects and arrays between, with bodies.

    One pass over the payloads in Arrow batches; nothing is shuffled. A task writes each body once (null in
    later rows), and plain objects once a batch with the number ``n`` of their occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(100_000)  # a payload may be as deep as its parser allows
        written: set[str] = set()
        for batch in batches:
            rows: list[tuple] = []
            plain: dict[str, list] = {}
            for delivery, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in merkle_rows(delivery, payload):
                    ident = row[5]
                    if row[0] is None and row[1] in PLAIN:
                        plain.setdefault(ident, [row, 0])[1] += 1
                    else:
                        rows.append((*row[:6], None if ident in written else row[6], 1))
                        written.add(ident)
                if len(rows) + len(plain) > 20_000:
                    yield _batch(rows, plain, written)
                    rows, plain = [], {}
            yield _batch(rows, plain, written)

    def _batch(rows, plain, written):
        rows += [(*row[:6], None if ident in written else row[6], n) for ident, (row, n) in plain.items()]
        written.update(plain)
        if len(written) > REMEMBERED:
            written.clear()
        cols = list(zip(*rows)) if rows else [[]] * len(SEEN)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SEEN)], schema=SEEN)

    return usage.select("delivery_id", "payload").mapInArrow(run, _SEEN_DDL)


def bridge(seen: DataFrame) -> DataFrame:
    """Parent-child rows: who holds which identity at which ordinal. What a child is, its object tells."""
    return seen.where(f"child not in {PLAIN}").select("delivery_id", "parent_pos", "pos", "parent_identity", "identity")


def objects(seen: DataFrame) -> DataFrame:
    """Each distinct subtree once: identity, child, body, and how often it occurs.

    Grouping by identity combines before the shuffle; equal identities have equal children and bodies.
    """
    return seen.groupBy("identity").agg(
        F.first("child").alias("child"), F.first("body", ignorenulls=True).alias("body"), F.sum("n").alias("occurrences")
    )


def child_rows(seen: DataFrame) -> DataFrame:
    """``delivery_id, child, parent_pos, pos`` of every non-null array element: bridge rows with their stored objects.

    Both are written before the join, whose sides are then plain scans: an identity that a third of all rows
    share is split by adaptive execution, as its object is one row.
    """
    seen = materialize(seen, "seen")
    children = materialize(objects(seen).where(f"child not in {(*PLAIN, 'record')}").select("identity", "child"), "objects")
    return bridge(seen).where("pos >= 0").join(children, "identity").select("delivery_id", "child", "parent_pos", "pos")


def links(stored: DataFrame) -> DataFrame:
    """The references between stored objects: parent_identity, ordinal (in the body's order), identity."""
    return stored.select(F.col("identity").alias("parent_identity"), F.posexplode(_references()).alias("ordinal", "identity"))


def _references() -> Column:
    # quotes within texts are escaped, and an object of a body's own holds no array: this is always a reference
    return F.regexp_extract_all("body", F.lit(_REFERENCE), 1)


def restore(seen: DataFrame) -> DataFrame:
    """``delivery_id, payload``: every JSON payload in canonical form (ASCII) from the stored objects.

    Objects whose references are all resolved are resolved level by level, from the bottom: as many
    joins as payloads are deep, each over the objects still open.
    """
    seen = materialize(seen, "seen")
    stored = materialize(objects(seen).select("identity", "child", "body", _references().alias("refs")), "objects")
    done = [materialize(stored.where("size(refs) = 0").select("identity", "child", F.col("body").alias("text")), "restored")]
    rest = stored.where("size(refs) > 0")
    while not rest.isEmpty():
        texts = done[0]
        for more in done[1:]:
            texts = texts.unionByName(more)
        below = rest.select("identity", F.explode(F.array_distinct("refs")).alias("ref")).join(
            texts.select(F.col("identity").alias("ref"), "text"), "ref", "left"
        ).groupBy("identity").agg(
            F.count_if(F.col("text").isNull()).alias("open"), F.map_from_entries(F.collect_list(F.struct("ref", "text"))).alias("m")
        )
        joined = F.array_join(
            F.zip_with(
                F.split("body", _REFERENCE), F.transform("refs", lambda r: F.col("m")[r]),
                lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))),
            ), "",
        )
        level = materialize(rest.join(below.where("open = 0"), "identity").select("identity", "child", joined.alias("text")), "restored")
        done.append(level)
        rest = materialize(rest.join(level.select("identity"), "identity", "left_anti"), "open")
    records = done[0]
    for more in done[1:]:
        records = records.unionByName(more)
    return bridge(seen).where("pos = -1").join(records.where("child = 'record'").select("identity", F.col("text").alias("payload")), "identity").select(
        "delivery_id", "payload"
    )


def records(usage: DataFrame) -> DataFrame:
    """The record table: one row for each delivery whose payload is a JSON object.

    Columns: delivery_id, record_event, entry_seconds, elapsed_status; absent or oddly typed parts are null.
    """
    path = "$.entry_wall_time.value.seconds"
    v = F.expr("try_parse_json(payload)")
    return (
        usage.select("delivery_id", v.alias("__v"))
        .where("schema_of_variant(__v) like 'OBJECT%'")
        .select(
            "delivery_id",
            F.try_variant_get("__v", "$.event", "string").alias("record_event"),
            F.try_variant_get("__v", path, "bigint").alias("entry_seconds"),
            F.try_variant_get("__v", "$.elapsed.status", "string").alias("elapsed_status"),
        )
    )


def reassemble(bridge_rows: DataFrame, stored: DataFrame, child: str) -> DataFrame:
    """A child table with bodies again: bridge rows joined with the stored objects of one kind."""
    return bridge_rows.join(stored.where(F.col("child") == child).select("identity", "body"), "identity").select(
        "delivery_id", "parent_pos", "pos", "identity", "body"
    )
