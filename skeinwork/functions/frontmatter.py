"""YAML metadata blocks of pages: their values as JSON, and the links that declared keys hold.

PyYAML composes the nodes, so every value has its line; scalars are typed by YAML 1.2's core schema.
Aliases and unknown tags keep no value; of repeated keys the last counts, as in JSON readers.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from .markdown import metadata_end

_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")


class Unreadable(ValueError):
    """A metadata block that is not wholly a YAML mapping."""


def block(text: str) -> str | None:
    """The YAML between the fences of a leading metadata block, its first line being the page's second."""
    end = metadata_end(text)
    if end is None:
        return None
    start = text.index("\n") + 1
    last = text.rfind("\n", 0, end) + 1
    return text[start:last]


def scalar(node: yaml.ScalarNode):
    """A scalar's JSON value: quoted ones are strings, plain ones by the core schema; no number is not finite."""
    text = node.value
    if node.style in ("'", '"', "|", ">"):
        return text
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if _INT.fullmatch(text):
        value = int(text, 0) if text[:2] in ("0o", "0x") else int(text)
        return value if -(2**63) <= value < 2**63 else float(value)
    if _FLOAT.fullmatch(text):
        value = float(re.sub(r"\.(inf|nan)", r"\1", text.lower()))
        return value if math.isfinite(value) else None
    return text


def compose(source: str) -> yaml.MappingNode:
    """The block's mapping node; ``Unreadable`` if it is anything else."""
    if "\0" in source:
        raise Unreadable("the block holds a NUL")
    try:
        root = yaml.compose(source, Loader=yaml.SafeLoader)
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise Unreadable(str(e).split("\n")[0]) from e
    if not isinstance(root, yaml.MappingNode):
        raise Unreadable("the block is not a mapping")
    return root


def to_json(node: yaml.Node, above: tuple[int, ...] = ()):
    """A node as JSON; a node inside itself (by an alias) is null, other keys than strings are their JSON text."""
    if id(node) in above:
        return None
    above = (*above, id(node))
    if isinstance(node, yaml.ScalarNode):
        return scalar(node)
    if isinstance(node, yaml.SequenceNode):
        return [to_json(x, above) for x in node.value]
    out = {}
    for k, v in node.value:
        key = to_json(k, above)
        out[key if isinstance(key, str) else json.dumps(key, sort_keys=True, separators=(",", ":"))] = to_json(v, above)
    return out


def declared(node: yaml.Node, keys: set[str], inside: bool = False, above: tuple[int, ...] = ()) -> Iterator[tuple[str, yaml.Node]]:
    """String leaves below any declared key, at any depth: (value, node). Other keys are still searched."""
    if id(node) in above:
        return
    above = (*above, id(node))
    if isinstance(node, yaml.ScalarNode):
        if inside and isinstance(scalar(node), str):
            yield node.value, node
    elif isinstance(node, yaml.SequenceNode):
        for x in node.value:
            yield from declared(x, keys, inside, above)
    else:
        for k, v in node.value:
            named = isinstance(k, yaml.ScalarNode) and k.value in keys
            yield from declared(v, keys, inside or named, above)


def file_lines(source: str) -> list[int]:
    """For each YAML row (rows end at LF, CR or CRLF) the file's line, which counts LF only; the block starts at 2."""
    out, line = [2], 2
    for m in re.finditer(r"\r\n|\r|\n", source):
        line += "\n" in m[0]
        out.append(line)
    return out


def parse(text: str, keys: set[str]) -> tuple[list[tuple[str, int]], str | None, str | None]:
    """Links (value, line), metadata as canonical JSON, and what made the block unreadable."""
    source = block(text)
    if source is None:
        return [], None, None
    try:
        root = compose(source)
        meta = to_json(root)
    except Unreadable as e:
        return [], None, str(e)
    rows = file_lines(source)
    links = [(v, rows[min(n.start_mark.line, len(rows) - 1)]) for v, n in declared(root, keys)]
    return links, json.dumps(meta, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None


def parse_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``path, links, metadata, problem`` for each page (path, text) that has a metadata block.

    The filter on the first three characters runs in Spark, so that other pages never reach Python.
    """
    wanted = set(keys)
    kind = pa.list_(pa.struct([("target", pa.string()), ("line", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *parse(t, wanted)) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [r for r in rows if r[2] is not None or r[3] is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()), pa.array([[{"target": t, "line": n} for t, n in r[1]] for r in rows], kind),
                    pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()),
                ],
                names=["path", "links", "metadata", "problem"],
            )

    ddl = "path string, links array<struct<target:string,line:bigint>>, metadata string, problem string"
    return pages.select("path", "text").where("startswith(text, '---')").mapInArrow(run, ddl)
