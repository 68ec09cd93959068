"""Selectors and projections: which nodes or edges, and which of their namespaces and fields."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matches_globs


def has_glob(selector: str) -> bool:
    return any(c in selector for c in "*?[]{}")


def selector_predicate(selector: str, path: Column) -> Column:
    """A glob over keys, or a path: that node exactly, else all below it (not itself, as it is a directory)."""
    if has_glob(selector):
        return matches_globs(path, [selector])
    clean = posixpath.normpath(selector)
    return (path == clean) | F.startswith(path, F.lit(clean + "/"))


def select_nodes(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """Nodes by any selector. A path that is a file selects it alone, one that is a directory what is below.

    No selectors select nothing.
    """
    wanted = F.lit(False)
    for s in dict.fromkeys(selectors):
        hit = selector_predicate(s, F.col("path"))
        if not has_glob(s):
            hit = hit & ~((F.col("path") == posixpath.normpath(s)) & (F.col("fs_type") == "directory"))
        wanted = wanted | hit
    return nodes.where(wanted)


def suggestions(nodes: DataFrame, missing: str, limit: int = 5) -> DataFrame:
    """What may have been meant by a path that is no node, the first few by name."""
    return meant(nodes, missing).orderBy("path").limit(limit)


def meant(nodes: DataFrame, missing: str) -> DataFrame:
    """Keys that end in a path, with or without ``.md``."""
    tails = [missing] if missing.endswith(".md") else [missing, missing + ".md"]
    hit = F.lit(False)
    for t in tails:
        hit = hit | (F.col("path") == t) | F.endswith("path", F.lit("/" + t))
    return nodes.where(hit).select("path").distinct()


def prune_namespaces(blocks: Column, namespaces: list[str] | None) -> Column:
    """The blocks of the given namespaces, named with or without ``@``; all where none is given."""
    if namespaces is None:
        return blocks
    wanted = [n if n.startswith("@") else "@" + n for n in namespaces]
    return F.map_filter(blocks, lambda k, _: k.isin(wanted))


def keep_fields(value, fields: set[str]):
    """The given fields of an object at any depth: a field found is kept whole, empty rests fall away."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            rest = v if k in fields else keep_fields(v, fields)
            if k in fields or rest not in (None, {}, []):
                out[k] = rest
        return out
    if isinstance(value, list):
        return [x for x in (keep_fields(v, fields) for v in value) if x not in (None, {}, [])]
    return None


def prune_fields(text: Column, fields: list[str]) -> Column:
    """``keep_fields`` on JSON text, in Arrow batches; ``{}`` where nothing is left, null stays null."""
    wanted = set(fields)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                kept = keep_fields(json.loads(t), wanted)
            except ValueError:
                kept = None
            return json.dumps(kept or {}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return texts.map(one)

    return run(text)


def project_nodes(nodes: DataFrame, namespaces: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """``path, blocks``: pruned metadata; nodes of which a filter leaves nothing are dropped.

    Only blocks that survive the namespaces go through field pruning, and only there through Python.
    """
    kept = nodes.select("path", prune_namespaces(F.col("blocks"), namespaces).alias("blocks"))
    if fields is not None:
        one = kept.select("path", F.explode("blocks").alias("ns", "text")).withColumn("text", prune_fields(F.col("text"), fields))
        kept = one.where("text <> '{}'").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ns", "text")))).alias("blocks"))
    return kept if namespaces is None and fields is None else kept.where(F.size("blocks") > 0)


def project_edges(edges: DataFrame, sources: DataFrame | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """Edges from the given sources (path) that have any of the namespaces; bare edges stay if none is given."""
    kept = edges if sources is None else edges.join(sources.select(F.col("path").alias("source")), "source", "left_semi")
    if namespaces is None:
        return kept
    wanted = [n if n.startswith("@") else "@" + n for n in namespaces]
    return kept.where(F.arrays_overlap("provenance", F.array(*[F.lit(w) for w in wanted])))


def project_edge_blocks(edges: DataFrame, sources: DataFrame | None = None, namespaces: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """``source, target, blocks`` of edges (as ``graph.edge_blocks`` gives them) with pruned blocks.

    With a namespace or field asked, edges without any block left fall away; without, bare edges stay.
    """
    kept = edges if sources is None else edges.join(sources.select(F.col("path").alias("source")), "source", "left_semi")
    kept = kept.select("source", "target", prune_namespaces(F.col("blocks"), namespaces).alias("blocks"))
    if fields is not None:
        one = kept.select("source", "target", F.explode("blocks").alias("ns", "text")).withColumn("text", prune_fields(F.col("text"), fields))
        kept = one.where("text <> '{}'").groupBy("source", "target").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("ns", "text")))).alias("blocks")
        )
    return kept if namespaces is None and fields is None else kept.where(F.size("blocks") > 0)


def beneath(nodes: DataFrame, directories: DataFrame) -> DataFrame:
    """Number of nodes beneath each directory (path), at any depth: ``path, beneath``.

    Every node is counted at each of its ancestors, found by its own path, so nothing is compared pairwise.
    """
    up = nodes.select(F.explode(ancestors(F.col("path"))).alias("path"))
    counts = up.groupBy("path").agg(F.count(F.lit(1)).alias("beneath"))
    return directories.select("path").join(counts, "path", "left").select("path", F.coalesce("beneath", F.lit(0)).alias("beneath"))


def ancestors(path: Column) -> Column:
    """All proper directory prefixes of a path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def metadata_lines(value, indent: int = 0) -> list[str]:
    """Metadata as text: one line a field, lists as ``- `` items, an empty entry as ``- {}``; controls escaped."""
    pad = "  " * indent
    out = []
    for key in sorted(value):
        inner = value[key]
        if isinstance(inner, dict):
            out += [f"{pad}{_shown(key)}:", *metadata_lines(inner, indent + 1)]
        elif isinstance(inner, list):
            out.append(f"{pad}{_shown(key)}:" + ("" if inner else " []"))
            for item in inner:
                if isinstance(item, dict):
                    lines = metadata_lines(item, indent + 2) or ["{}"]
                    out += [f"{pad}  - {lines[0].strip()}", *lines[1:]]
                else:
                    out.append(f"{pad}  - {_shown(item)}")
        else:
            out.append(f"{pad}{_shown(key)}: {_shown(inner)}")
    return out


def _shown(value) -> str:
    if isinstance(value, str) and value and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in value):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def text_lines(nodes: DataFrame) -> DataFrame:
    """``path, text`` of projected nodes (path, blocks): the path, then its metadata, in Arrow batches."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, blocks: pd.Series) -> pd.Series:
        def one(path, text):
            held = {k: json.loads(v) for k, v in json.loads(text).items()} if text else {}
            return "\n".join([_shown(path), *metadata_lines(held, 1)])

        return pd.Series([one(p, t) for p, t in zip(paths, blocks)])

    return nodes.select("path", run("path", F.to_json("blocks")).alias("text"))


def graph_key(path: str, cwd: str, root: str) -> str | None:
    """A path given on the command line as a key: relative to where it was given, None outside the root."""
    whole = posixpath.normpath(posixpath.join(cwd, path))
    top = posixpath.normpath(root)
    if whole == top:
        return "."
    return whole[len(top.rstrip("/")) + 1 :] if whole.startswith(top.rstrip("/") + "/") else None


def namespaces(asked: list[str] | None, declared: list[str]) -> list[str] | None:
    """Namespaces with ``@``, each once and declared; None asks for all."""
    if asked is None:
        return None
    known = {"@fs", *("@" + d for d in declared)}
    out = list(dict.fromkeys(a if a.startswith("@") else "@" + a for a in asked))
    for name in out:
        if name not in known:
            raise ValueError(f"{name} is no graph here; there are {', '.join(sorted(known))}")
    return out
