"""The usage log on disk: one file for each event, bounded, validated, expired and evicted.

A partition is a folder of ``<32 hex>.start.json`` and ``.finish.json`` files, a lock and temporaries.
Decisions about what to expire and evict are those of ``operators.usage``, made on a DataFrame of the
inventory; this module reads the inventory and does the file operations.
"""

from __future__ import annotations

import base64
import contextlib
import fcntl
import hashlib
import json
import os
import re
import secrets
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.usage import EVENT_BYTES, RETENTION_S, STORE_BYTES, STORE_FILES

#: Schema name and revision of records written here, and the bounds of their parts.
SCHEMA_NAME, REVISION = "skein-usage", 1
STRUCTURED_BYTES, STDOUT_BYTES, STDERR_BYTES, ERROR_RECORDS = 128 * 1024, 64 * 1024, 16 * 1024, 64
_NAME = re.compile(r"(?:(?P<id>[0-9a-f]{32})\.(?P<event>start|finish)\.json|(?P<lock>\.lock)|(?P<temp>\.tmp\.[0-9a-f]{32}))")
INVENTORY = "id string, event string, name string, bytes bigint, state string, entry_s bigint, entry_ns int, coll_s bigint, coll_ns int, payload string"


class StoreError(ValueError):
    pass


def file_kind(name: str) -> tuple[str, str | None]:
    """What a name in the folder is: ('start' | 'finish', id), ('lock', None) or ('temporary', None); others are errors."""
    m = _NAME.fullmatch(name)
    if not m:
        raise StoreError(f"{name!r} does not belong here")
    if m["id"]:
        return m["event"], m["id"]
    return ("lock", None) if m["lock"] else ("temporary", None)


def partition_id(root: str) -> str:
    """The folder of a graph root: a digest that no other use of the same text shares."""
    return hashlib.sha256(b"skein usage partition\0" + os.fsencode(root)).hexdigest()


def new_id() -> str:
    return secrets.token_hex(16)


def os_text(raw: bytes) -> dict:
    """Bytes of the operating system as text, or base64 where they are not UTF-8."""
    try:
        return {"os_encoding": "unix-bytes", "encoding": "utf8", "value": raw.decode()}
    except UnicodeDecodeError:
        return {"os_encoding": "unix-bytes", "encoding": "base64", "value": base64.b64encode(raw).decode()}


def bounded_json(value, limit: int) -> bytes | None:
    """Compact JSON, or None where it has more than ``limit`` bytes."""
    raw = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    return raw if len(raw) <= limit else None


def admit(records: list, room: int) -> tuple[dict, int]:
    """The records that fit, in order, up to the first that does not; and the room left."""
    kept, size = [], 2
    for r in records:
        more = len(json.dumps(r, separators=(",", ":"), ensure_ascii=False).encode()) + (1 if kept else 0)
        if size + more > room:
            break
        kept.append(r)
        size += more
    return {"total": len(records), "included": len(kept), "omitted": len(records) - len(kept), "records": kept}, room - size


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def _stamp(value) -> tuple[int, int] | None:
    """(seconds, nanoseconds) of an available time; None where it is unavailable."""
    if value.get("status") == "unavailable":
        return None
    s, ns = value["value"]["seconds"], value["value"]["nanoseconds"]
    if type(s) is not int or type(ns) is not int or not 0 <= ns < 10**9:
        raise ValueError("no time")
    return s, ns


def _texts(value) -> bool:
    return isinstance(value, list) and all(map(_os_text, value))


def _os_text(value) -> bool:
    if not isinstance(value, dict) or set(value) != {"os_encoding", "encoding", "value"} or not isinstance(value["value"], str):
        return False
    if value["encoding"] == "utf8":
        return value["os_encoding"] == "unix-bytes"
    try:
        base64.b64decode(value["value"], validate=True).decode()
    except UnicodeDecodeError:  # only what is no UTF-8 is written in base64
        return value["os_encoding"] == "unix-bytes" and value["encoding"] == "base64"
    except ValueError:
        pass
    return False


def _count(value) -> bool:
    return type(value) is int and value >= 0


def _part(value) -> bool:
    """Admitted records with their counts, which must add up."""
    return (
        isinstance(value, dict) and set(value) == {"total", "included", "omitted", "records"} and isinstance(value["records"], list)
        and all(_count(value[k]) for k in ("total", "included", "omitted"))
        and value["included"] == len(value["records"]) and value["total"] == value["included"] + value["omitted"]
    )


def _structured(value) -> bool:
    if not isinstance(value, dict) or set(value) != {"findings", "hints", "error"} or not _part(value["hints"]):
        return False
    inner = [value["findings"], value["error"]]
    return all(isinstance(v, dict) and set(v) == {"prefix"} and _part(v["prefix"]) for v in inner)


def _stream(value) -> bool:
    return (
        isinstance(value, dict) and set(value) == {"prefix_base64", "observed_input_bytes", "retained_bytes", "truncated"}
        and isinstance(value["prefix_base64"], str) and _count(value["retained_bytes"]) and isinstance(value["truncated"], bool)
        and isinstance(value["observed_input_bytes"], dict) and _count(value["observed_input_bytes"].get("bytes"))
    )


#: What both events have, and the parts beside it with their tests; a start has the first three of these.
_HEAD = {"schema", "revision", "event", "id", "entry_wall_time", "collected_wall_time"}
_PARTS = {
    "command": lambda v: isinstance(v, str), "argv": _texts, "canonical_graph_root": _os_text, "elapsed": lambda v: isinstance(v, dict),
    "intended_exit": lambda v: isinstance(v, str), "structured": _structured, "stdout": _stream, "stderr": _stream,
}
_START_PARTS = ("command", "argv", "canonical_graph_root")


def classify(raw: bytes, ident: str, event: str) -> tuple[str, dict | None]:
    """supported, unsupported (a later revision), malformed or oversized; and the record if supported.

    A key repeated at any depth makes a record malformed, as readers would differ about it; so do a key that this
    revision does not have, a part that is not as written here, and a start without one of its parts.
    """
    if len(raw) > EVENT_BYTES:
        return "oversized", None
    try:
        record = json.loads(raw, object_pairs_hook=_no_repeats)
        if record["schema"] != SCHEMA_NAME or type(record["revision"]) is not int or record["revision"] < 1:
            return "malformed", None
        if record["revision"] > REVISION:
            return "unsupported", None
        if record["id"] != ident or record["event"] != event:
            return "malformed", None
        _stamp(record["entry_wall_time"]), _stamp(record["collected_wall_time"])
        parts = set(record) - _HEAD
        if not parts <= set(_PARTS) or not all(_PARTS[k](record[k]) for k in parts):
            return "malformed", None
        if event == "start" and parts != set(_START_PARTS):
            return "malformed", None
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return "malformed", None
    return "supported", record


def scan(folder: str) -> list[tuple]:
    """Rows of ``INVENTORY`` for all event files; a folder beyond the hard bounds is an error."""
    rows, size = [], 0
    for name in sorted(os.listdir(folder)):
        kind, ident = file_kind(name)
        if ident is None:
            continue
        info = os.lstat(os.path.join(folder, name))
        size += info.st_size
        if len(rows) >= STORE_FILES or size > STORE_BYTES:
            raise StoreError("the partition is beyond its bounds")
        with open(os.path.join(folder, name), "rb") as f:
            raw = f.read(EVENT_BYTES + 1)
        state, record = classify(raw, ident, kind)
        entry = _stamp(record["entry_wall_time"]) if record else None
        seen = _stamp(record["collected_wall_time"]) if record else None
        text = raw.decode("utf-8", "replace") if state != "oversized" else None
        rows.append((ident, kind, name, info.st_size, state, *(entry or (None, None)), *(seen or (None, None)), text))
    return rows


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory as a table that the operators of ``operators.usage`` take."""
    return spark.createDataFrame(scan(folder), INVENTORY).selectExpr("xxhash64(name) as delivery_id", "*")


@contextlib.contextmanager
def locked(folder: str):
    """The partition's lock, taken at once or not at all."""
    with open(os.path.join(folder, ".lock"), "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise StoreError("another writer holds the partition") from e
        yield


def plan(rows: list[tuple], more: int, now_ns: int, protect: str, byte_limit: int = STORE_BYTES, file_limit: int = STORE_FILES) -> list[str]:
    """Ids that must go before one more file of ``more`` bytes fits: what has expired, then the oldest known, then the unknown by id.

    ``rows`` are those of ``scan``, which bounds them; decisions are those of ``operators.usage`` on the same inventory.
    ``protect`` never goes. An event that does not fit even so is an error.
    """
    sides: dict[str, dict[str, tuple]] = {}
    for ident, event, _, size, state, es, en, cs, cn, _ in rows:
        entry, seen = (None if x is None else x * 10**9 + y for x, y in ((es, en), (cs, cn)))
        sides.setdefault(ident, {})[event] = (size, state, entry, seen)
    order = []
    for ident, of in sides.items():
        last = None
        if len(of) == 2 and all(side[1] == "supported" and None not in side for side in of.values()):
            (_, _, begun, first), (_, _, again, seen) = of["start"], of["finish"]
            last = seen if begun == again and begun <= first <= seen else None
        order.append((last is None, last or 0, ident, sum(side[0] for side in of.values()), len(of)))
    order.sort()
    size, files, gone = sum(r[3] for r in order) + more, sum(r[4] for r in order) + 1, []
    for unknown, last, ident, held, count in order:
        old = not unknown and now_ns - last >= RETENTION_S * 10**9
        if ident != protect and (old or size > byte_limit or files > file_limit):
            gone.append(ident)
            size, files = size - held, files - count
    if size > byte_limit or files > file_limit:
        raise StoreError("there is no room for the event")
    return gone


def publish(folder: str, record: dict, evict: list[str] = (), now_ns: int | None = None) -> dict:
    """Write one event beside the others: temporaries and ``evict`` ids go first, names are never replaced.

    With ``now_ns`` what has expired or must make room is planned here, under the lock, on what the folder then
    holds. A finish needs its start, which is never evicted for it; a start that is there already is an
    error before anything goes. Returns the receipt: name and digest.
    """
    ident, event = record["id"], record["event"]
    raw = bounded_json(record, EVENT_BYTES)
    if raw is None or classify(raw, ident, event)[0] != "supported":
        raise StoreError("the record cannot be published")
    os.makedirs(folder, exist_ok=True)
    with locked(folder):
        if event == "start" and os.path.exists(os.path.join(folder, f"{ident}.start.json")):
            raise StoreError("the event was published before")
        if now_ns is not None:
            evict = {*evict, *plan(scan(folder), len(raw), now_ns, ident)}
        for name in os.listdir(folder):
            kind, other = file_kind(name)
            if kind == "temporary" or other in evict and not (event == "finish" and other == ident):
                os.unlink(os.path.join(folder, name))
        if event == "finish" and not os.path.exists(os.path.join(folder, f"{ident}.start.json")):
            raise StoreError("there is no start to finish")
        temp = os.path.join(folder, f".tmp.{new_id()}")
        with open(temp, "xb") as f:
            f.write(raw)
        name = f"{ident}.{event}.json"
        try:
            os.link(temp, os.path.join(folder, name))  # fails where the name exists
        except FileExistsError as e:
            raise StoreError("the event was published before") from e
        finally:
            os.unlink(temp)
    return {"name": name, "digest": hashlib.sha256(raw).hexdigest()}


def verify(folder: str, receipt: dict) -> bool:
    """Whether what a receipt tells of still stands."""
    try:
        with open(os.path.join(folder, receipt["name"]), "rb") as f:
            return hashlib.sha256(f.read()).hexdigest() == receipt["digest"]
    except OSError:
        return False


@dataclass
class Capture:
    """A stream's first bytes, and how many there were."""

    limit: int
    prefix: bytearray = field(default_factory=bytearray)
    seen: int = 0

    def add(self, raw: bytes) -> None:
        self.seen += len(raw)
        self.prefix += raw[: max(0, self.limit - len(self.prefix))]

    def record(self) -> dict:
        return {
            "prefix_base64": base64.b64encode(self.prefix).decode(), "observed_input_bytes": {"status": "exact", "bytes": self.seen},
            "retained_bytes": len(self.prefix), "truncated": self.seen > len(self.prefix),
        }


def now() -> dict:
    ns = time.time_ns()
    return {"status": "available", "value": {"seconds": ns // 10**9, "nanoseconds": ns % 10**9}}


def start_record(ident: str, entry: dict, command: str, argv: list[bytes], root: str) -> dict:
    return {
        "schema": SCHEMA_NAME, "revision": REVISION, "event": "start", "id": ident, "entry_wall_time": entry, "collected_wall_time": now(),
        "command": command, "argv": [os_text(a) for a in argv], "canonical_graph_root": os_text(os.fsencode(root)),
    }


def finish_record(ident: str, entry: dict, exit_name: str, findings: list, hints: list, errors: list, out: Capture, err: Capture, elapsed_ns: int) -> dict:
    """A finish event; findings, hints and errors are admitted in this order into their shared room."""
    room = STRUCTURED_BYTES
    parts = {}
    for name, records in (("findings", findings), ("hints", hints), ("error", errors[:ERROR_RECORDS])):
        parts[name], room = admit(records, room)
    return {
        "schema": SCHEMA_NAME, "revision": REVISION, "event": "finish", "id": ident, "entry_wall_time": entry, "collected_wall_time": now(),
        "elapsed": {"status": "available", "value": {"seconds": elapsed_ns // 10**9, "nanoseconds": elapsed_ns % 10**9}}, "intended_exit": exit_name,
        "structured": {"findings": {"prefix": parts["findings"]}, "hints": parts["hints"], "error": {"prefix": parts["error"]}},
        "stdout": out.record(), "stderr": err.record(),
    }


class Invocation:
    """One command's events, from entry to exit. The log never fails its command: what cannot be written is not."""

    def __init__(self, folder: str, command: str, argv: list[bytes], root: str, enabled: bool) -> None:
        self.folder = os.path.join(folder, partition_id(root))
        self.id, self.entry, self.clock = new_id(), now(), time.monotonic_ns()
        self.out, self.err = Capture(STDOUT_BYTES), Capture(STDERR_BYTES)
        self.receipt = None
        if enabled:
            with contextlib.suppress(OSError, StoreError):
                self.receipt = publish(self.folder, start_record(self.id, self.entry, command, argv, root), now_ns=time.time_ns())

    def finish(self, exit_name: str, findings: list = (), hints: list = (), errors: list = ()) -> bool:
        if self.receipt is None or not verify(self.folder, self.receipt):
            return False
        record = finish_record(self.id, self.entry, exit_name, list(findings), list(hints), list(errors), self.out, self.err, time.monotonic_ns() - self.clock)
        try:
            publish(self.folder, record, now_ns=time.time_ns())
        except (OSError, StoreError):
            return False
        return True
