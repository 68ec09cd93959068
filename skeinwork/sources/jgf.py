"""JSON graph documents and text lines, one record a line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import lines_suffix, one_line


def node_lines(nodes: DataFrame) -> DataFrame:
    """``path, json``: each node's member of a graph document, empty metadata left out."""
    return nodes.select("path", F.to_json(F.struct(F.when(F.size("blocks") > 0, F.transform_values("blocks", lambda _, v: v)).alias("metadata"))).alias("json"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``source, target, json``: each edge (with blocks) of a graph document, absent parts left out."""
    blocks = F.when(F.size("blocks") > 0, F.col("blocks"))
    return edges.select("source", "target", F.to_json(F.struct("source", "target", blocks.alias("blocks"), "provenance")).alias("json"))


def _members(edges: DataFrame):
    for r in edge_lines(edges).orderBy("source", "target").toLocalIterator():
        body = json.loads(r["json"])
        held = {k: json.loads(v) for k, v in sorted(body.get("blocks", {}).items())}
        yield {"source": body["source"], "target": body["target"], "metadata": held | {"_graphs": body["provenance"]}}


def document(nodes: DataFrame, edges: DataFrame) -> str:
    """A composed graph as one JSON document, streamed to the driver in order; for graphs a reader can take.

    ``edges`` have blocks; nodes with a ``provenance`` column name their graphs.
    """
    out = {"graph": {"directed": True, "nodes": {}, "edges": list(_members(edges))}}
    graphs = F.to_json("provenance") if "provenance" in nodes.columns else F.lit(None).cast("string")
    for r in nodes.select("path", F.to_json("blocks").alias("blocks"), graphs.alias("graphs")).orderBy("path").toLocalIterator():
        held = {k: json.loads(v) for k, v in sorted(json.loads(r["blocks"] or "{}").items())}
        if r["graphs"]:
            held["_graphs"] = json.loads(r["graphs"])
        out["graph"]["nodes"][r["path"]] = {"metadata": held} if held else {}
    return json.dumps(out, ensure_ascii=False)


def raw_document(nodes: DataFrame, edges: DataFrame) -> str:
    """The graphs before composition as one JSON document: a list by name, each with its own nodes and edges."""
    graphs: dict[str, dict] = {}

    def of(name: str) -> dict:
        return graphs.setdefault(name, {"id": name, "directed": True, "nodes": {}, "edges": []})

    for r in nodes.orderBy("graph", "path").toLocalIterator():
        held = json.loads(r["metadata"] or "{}")
        of(r["graph"])["nodes"][r["path"]] = {"metadata": held} if held else {}
    rows = edges.select("graph", "source", "target", F.to_json("occurrences").alias("said")).orderBy("graph", "source", "target")
    for r in rows.toLocalIterator():
        said = json.loads(r["said"] or "[]")
        of(r["graph"])["edges"].append({"source": r["source"], "target": r["target"]} | ({"metadata": {"occurrences": said}} if said else {}))
    return json.dumps({"graphs": [graphs[k] for k in sorted(graphs)]}, ensure_ascii=False)


def finding_json(findings: DataFrame) -> DataFrame:
    """``json``: findings as one object a row, absent parts left out."""
    lines = F.when(F.size("lines") > 0, F.col("lines"))
    message = F.when(F.col("message") != "", F.col("message"))
    return findings.select(F.to_json(F.struct("name", "severity", "subject", "target", lines.alias("lines"), message.alias("message"), "cause")).alias("json"))


def finding_text(findings: DataFrame) -> DataFrame:
    """Findings as text: ``severity[name]: subject:lines -> target (message)``, controls escaped."""
    target = F.when(F.col("target").isNotNull(), F.concat(F.lit(" -> "), one_line(F.col("target")))).otherwise("")
    message = F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit(" ("), one_line(F.col("message")), F.lit(")"))).otherwise("")
    cause = F.when(F.col("cause").isNotNull(), F.concat(F.lit("; cause: "), one_line(F.col("cause")))).otherwise("")
    head = F.concat(F.col("severity"), F.lit("["), F.col("name"), F.lit("]: "), one_line(F.col("subject")))
    lines = F.coalesce(lines_suffix(F.col("lines")), F.lit(""))
    return findings.select(F.concat(head, lines, target, message, cause).alias("text"))
