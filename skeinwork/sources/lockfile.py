"""The reviewed baseline as a TOML file, or as a pair of Parquet tables at scale."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib

from pyspark.sql import DataFrame, SparkSession

from .tree import STATE_DIR

FILE = "lock.toml"
HEADER = "# Written by the lock command; review changes to it like code.\n"
NODES, EDGES = "path string, hash string", "source string, target string, target_hash string"


class LockError(ValueError):
    pass


def parse(text: str) -> tuple[list[tuple], list[tuple]]:
    """Lock nodes and edges; unknown fields are errors, as a field unread may be one relied on."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise LockError(str(e)) from e
    if set(raw) - {"nodes"}:
        raise LockError(f"unknown field {sorted(set(raw) - {'nodes'})[0]!r}")
    nodes, edges = [], []
    for path, body in raw.get("nodes", {}).items():
        if set(body) - {"hash", "edges"}:
            raise LockError(f"unknown field in {path!r}")
        nodes.append((path, body.get("hash")))
        for target, entry in body.get("edges", {}).items():
            if set(entry) - {"hash"}:
                raise LockError(f"unknown field in {path!r} -> {target!r}")
            edges.append((path, target, entry.get("hash")))
    return nodes, edges


def render(nodes: list[tuple], edges: list[tuple]) -> str:
    """Deterministic text: paths and targets in order, one table a path."""
    by: dict[str, list[tuple]] = {}
    for s, t, h in edges:
        by.setdefault(s, []).append((t, h))
    q = lambda s: json.dumps(s, ensure_ascii=False).replace("\x7f", "\\u007f")
    out = [HEADER]
    for path, digest in sorted(nodes, key=lambda n: n[0].encode()):
        out.append(f"\n[nodes.{q(path)}]\n" + (f"hash = {q(digest)}\n" if digest is not None else ""))
        if by.get(path):
            out.append(f"[nodes.{q(path)}.edges]\n")
            for target, h in sorted(by[path], key=lambda e: e[0].encode()):
                out.append(f"{q(target)} = " + (f"{{ hash = {q(h)} }}\n" if h is not None else "{}\n"))
    return "".join(out)


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """The lock of a tree, None if there is none."""
    path = os.path.join(root, STATE_DIR, FILE)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        nodes, edges = parse(f.read())
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def write(root: str, nodes: DataFrame, edges: DataFrame) -> str:
    """Write the lock by renaming a finished file over the old one, whose mode is kept.

    For trees on one machine: the text is streamed to the driver row by row. Tables of any size are
    written with ``write_tables``.
    """
    path = os.path.join(root, STATE_DIR, FILE)
    text = render([tuple(r) for r in nodes.toLocalIterator()], [tuple(r) for r in edges.toLocalIterator()])
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path), prefix="lock.")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    if os.path.exists(path):
        os.chmod(temp, os.stat(path).st_mode)
    os.replace(temp, path)
    return path


def write_tables(nodes: DataFrame, edges: DataFrame, where: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{where}/lock_nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{where}/lock_edges.parquet")


def read_tables(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{where}/lock_nodes.parquet"), spark.read.parquet(f"{where}/lock_edges.parquet")
