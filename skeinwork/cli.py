"""Command line over a directory tree: check, graph, nodes, edges, impact, lock, init."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, graph, impact, project, rules
from .session import materialize, ship_package
from .sources import config, jgf, lockfile, tree

#: Exit codes: nothing wrong, findings of severity error, wrong use.
CLEAN, VIOLATIONS, USAGE = 0, 1, 2
#: Bytes of output from which a reader is told that the projection is large.
LARGE = 65_536


class UsageError(ValueError):
    pass


class Run:
    """One command's view of a tree: configuration, composed graph, lock."""

    def __init__(self, spark: SparkSession, root: str, at: str) -> None:
        self.spark, self.root, self.at = spark, root, at
        self.config = config.load(root)
        entries = materialize(tree.read_tree(spark, root, self.config.ignore), "entries")
        self.built = build.build(entries, self.config)
        nodes, edges, links = build.composed(self.built)
        self.nodes, self.links = materialize(nodes, "nodes"), materialize(links, "links")
        self.edges = materialize(graph.compose_edges(self.links), "edges")
        self.blocks = graph.edge_blocks(self.links)
        self.hints = self.built.hints
        try:
            self.lock = lockfile.read(spark, root)
            self.unreadable = False
        except lockfile.LockError as e:
            self.lock, self.unreadable = None, True
            self.hints.append(f"unparseable-lock: {e}")

    def findings(self) -> DataFrame:
        severities, ignore = self.config.policy()
        found = self.built.findings
        locked, locked_edges = self.lock or (None, None)
        found = found.unionByName(rules.no_baseline(self.nodes, self.edges, locked))
        if locked is not None:
            for rule in rules.STALENESS:
                found = found.unionByName(rule(self.nodes, self.edges, locked, locked_edges))
        found = found.unionByName(rules.unresolved_edges(self.nodes, self.edges))
        found = found.unionByName(rules.unresolved_fragments(self.nodes, self.links)).unionByName(rules.detached_nodes(self.nodes, self.edges))
        return rules.apply_policy(found, severities, ignore)

    def namespaces(self, asked: list[str] | None) -> list[str] | None:
        try:
            return project.namespaces(asked, [g.name for g in self.config.graphs])
        except ValueError as e:
            raise UsageError(str(e)) from e

    def keys(self, paths: list[str]) -> list[str]:
        """Paths as given, from the directory they were given in, as keys of the graph."""
        out = []
        for p in paths:
            key = p if project.has_glob(p) else project.graph_key(p, os.path.abspath(self.at), os.path.abspath(self.root))
            if key is None:
                raise UsageError(f"{p} lies outside of the graph")
            out.append(key)
        return out

    def select(self, selectors: list[str]) -> DataFrame:
        chosen = project.select_nodes(self.nodes, selectors)
        for s in selectors:
            if project.select_nodes(self.nodes, [s]).isEmpty():
                if project.has_glob(s):
                    self.hints.append(f"zero-match-selector: {s}")
                elif not self.nodes.where(F.col("path") == s).isEmpty():
                    self.hints.append(f"zero-match-selector: {s} is empty")
                else:
                    near = [r["path"] for r in project.suggestions(self.nodes, s).collect()]
                    rest = project.meant(self.nodes, s).count() - len(near)
                    names = ", ".join(near) + (f" and {rest} more" if rest else "")
                    raise UsageError(f"{s} is not in the graph" + (f"; did you mean {names}?" if near else ""))
        return chosen


def check(run: Run, as_json: bool = False) -> tuple[list[str], int]:
    found = materialize(run.findings(), "found")
    total = rules.summary(found).first()
    code = VIOLATIONS if total["errors"] else CLEAN
    if as_json:
        rows = [json.loads(r["json"]) for r in jgf.finding_json(rules.in_order(found)).toLocalIterator()]
        return [json.dumps({"findings": rows, "errors": total["errors"], "warnings": total["warnings"]}, ensure_ascii=False)], code
    lines = [r["text"] for r in jgf.finding_text(rules.in_order(found)).toLocalIterator()]
    return [*lines, f"{total['errors']} errors, {total['warnings']} warnings"], code


def lock(run: Run, paths: list[str], everything: bool, as_json: bool = False) -> tuple[list[str], int]:
    """Lock the whole graph, or the nodes that paths and globs name; the file is written only if it changes."""
    if everything == bool(paths):
        raise UsageError("lock takes either paths or --all")
    nodes, edges = graph.lock_snapshot(run.nodes, run.edges)
    old = run.lock
    if everything:
        if run.unreadable:
            run.hints.append("replaced-unreadable-lock: the lock could not be read and was written anew")
        gone = graph.dropped(old[0], nodes).count() if old else 0
        if nodes.isEmpty():
            run.hints.append("nothing-to-lock: no node has a hash or links")
        changed = _write_lock(run, nodes, edges)
        told = {"locked": nodes.count(), "dropped": gone, "written": changed}
        return [json.dumps(told) if as_json else f"locked {told['locked']} nodes, dropped {gone}"], CLEAN
    if old is None and run.unreadable:
        raise UsageError("the lock cannot be read; write it anew with --all")
    for p in paths:
        if project.has_glob(p):
            if project.select_nodes(run.nodes, [p]).isEmpty():
                run.hints.append(f"zero-match-selector: {p}")
            continue
        known = run.nodes.where(F.col("path") == p)
        if not known.where("fs_type = 'directory'").isEmpty():
            raise UsageError(f"{p} is a directory with {project.beneath(run.nodes, known).first()['beneath']} entries; name files or a glob")
        if known.isEmpty() and (old is None or old[0].where(F.col("path") == p).isEmpty()):
            raise UsageError(f"{p} is neither in the graph nor in the lock")
    none = run.spark.createDataFrame([], lockfile.NODES), run.spark.createDataFrame([], lockfile.EDGES)
    kept = old or none

    def scope(column: str):
        hit = F.lit(False)
        for p in paths:
            hit = hit | project.selector_predicate(p, F.col(column)) if project.has_glob(p) else hit | (F.col(column) == p)
        return hit

    merged = materialize(graph.merge_lock(kept[0], nodes, scope("path")), "lock")
    merged_edges = materialize(kept[1].where(~scope("source")).unionByName(edges.where(scope("source"))), "lock")
    taken = nodes.where(scope("path")).count()
    if not taken and not graph.dropped(kept[0].where(scope("path")), merged).count():
        run.hints.append(f"nothing-to-lock: {', '.join(paths)}")
    changed = _write_lock(run, merged, merged_edges)
    told = {"locked": taken, "selectors": paths, "written": changed}
    return [json.dumps(told, ensure_ascii=False) if as_json else f"locked {', '.join(paths)}"], CLEAN


def _write_lock(run: Run, nodes: DataFrame, edges: DataFrame) -> bool:
    """Write the lock unless it already holds just this."""
    if run.lock is not None:
        here, there = (nodes.select("path", "hash"), edges.select("source", "target", "target_hash")), run.lock
        if all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in zip(here, (there[0].select("path", "hash"), there[1].select("source", "target", "target_hash")))):
            return False
    lockfile.write(run.root, nodes, edges)
    return True


def show_nodes(run: Run, args) -> list[str]:
    wanted = run.namespaces(args.namespace)
    chosen = run.nodes if args.all else run.select(args.paths)
    kept = project.project_nodes(chosen, wanted, args.field)
    if args.json:
        rows = kept.select("path", F.to_json("blocks").alias("text")).orderBy("path").toLocalIterator()
        return [json.dumps({"path": r["path"], "metadata": {k: json.loads(v) for k, v in json.loads(r["text"] or "{}").items()}}, ensure_ascii=False) for r in rows]
    return [r["text"] for r in project.text_lines(kept).orderBy("path").toLocalIterator()]


def show_edges(run: Run, args) -> list[str]:
    wanted = run.namespaces(args.namespace)
    sources = None if args.all else run.select(args.paths).select("path")
    if args.json or args.field:
        kept = project.project_edge_blocks(run.blocks, sources, wanted, args.field)
        rows = kept.select("source", "target", F.to_json("blocks").alias("text")).orderBy("source", "target").toLocalIterator()
        full = [(r["source"], r["target"], {k: json.loads(v) for k, v in sorted(json.loads(r["text"] or "{}").items())}) for r in rows]
        if args.json:
            return [json.dumps({"source": s, "target": t, "metadata": m}, ensure_ascii=False) for s, t, m in full]
        return [line for s, t, m in full for line in (f"{s} -> {t}", *project.metadata_lines(m, 1))]
    kept = project.project_edges(run.edges, sources, wanted)
    return [f"{r['source']} -> {r['target']}" for r in kept.select("source", "target").orderBy("source", "target").toLocalIterator()]


def show_impact(run: Run, args) -> list[str]:
    """What a change reaches, and beside it what of the links looked at is broken now or was lost since the lock."""
    seeds = run.spark.createDataFrame([(p,) for p in args.paths], "path string")
    lost = seeds.join(run.nodes, "path", "left_anti").collect()
    if lost:
        raise UsageError(f"{lost[0]['path']} is not in the graph")
    depth = None if args.depth == "all" else int(args.depth)
    if depth is not None and depth < 1:
        raise UsageError("depth counts from 1")
    found = materialize(impact.search(run.edges, seeds, args.direction, depth), "found")
    between = impact.betweenness(run.edges, run.nodes) if args.betweenness else None  # all pairs: only if asked for
    out = list(impact.ranked(found, impact.reach_counts(run.edges, found), between).toLocalIterator())
    diagnostics = _beside(run, found, seeds, args.direction, depth)
    if args.json:
        keys = ("node", "via", "depth", "impact_radius", "betweenness", "lines", "fix")
        told = [{k: r[k] for k in keys if r[k] is not None} for r in out]
        return [json.dumps({"impacted": told, "diagnostics": diagnostics}, ensure_ascii=False)]
    text = [f"{r['node']} (depth {r['depth']}, reach {r['impact_radius']}): {r['fix']}" for r in out]
    return text + [f"note[{d['name']}]: {d['subject']}" + (f" -> {d['target']}" if "target" in d else "") for d in diagnostics]


def _beside(run: Run, found: DataFrame, seeds: DataFrame, direction: str, depth: int | None) -> list[dict]:
    """Diagnostics on the edges that the search looked at, under the policy of check."""
    severities, ignore = run.config.policy()
    front = materialize(impact.frontier(found, seeds, depth, run.nodes), "front")
    broken = rules.unresolved_edges(run.nodes, impact.inspected(run.edges, front, direction))
    if run.lock is not None:
        gone = rules.removed_edges(run.nodes, run.edges, *run.lock).unionByName(rules.removed_nodes(run.nodes, run.edges, *run.lock))
        broken = broken.unionByName(impact.lost_beside(gone, run.lock[1], front, direction))
    ordered = rules.in_order(rules.apply_policy(broken, severities, ignore))
    return [json.loads(r["json"]) for r in jgf.finding_json(ordered).toLocalIterator()]


def show_ignores(root: str) -> list[str]:
    """The ignore files that apply from outside and above the tree, by kind, then the configuration's own globs."""
    out = [f"{kind}: {path}" for kind, paths in tree.ignore_sources(root).items() for path in paths]
    return out + [f"configuration: {glob}" for glob in config.load(root).ignore]


def guide() -> str:
    """What the commands, rules and hints are, from the definitions that they run by."""
    p = parser()
    commands = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices
    out = ["# Commands", *(f"- {name}: {' '.join(sub.format_usage().split()[1:])}" for name, sub in commands.items())]
    out += ["", "# Rules", *(f"- {r}" for r in config.RULES), "", "# Severities", ", ".join(config.SEVERITIES), "", "# Exit codes"]
    return "\n".join([*out, f"{CLEAN} clean, {VIOLATIONS} findings of severity error, {USAGE} wrong use", ""])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skeinwork")
    p.add_argument("-C", dest="root", default=".")
    p.add_argument("--max-bytes", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "graph", "init", "guide", "ignores"):
        sub.add_parser(name)
    sub.choices["check"].add_argument("--json", action="store_true")
    sub.choices["graph"].add_argument("--raw", action="store_true")
    for name in ("nodes", "edges"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="*")
        s.add_argument("--all", action="store_true")
        s.add_argument("--namespace", action="append")
        s.add_argument("--field", action="append")
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("impact")
    s.add_argument("paths", nargs="+")
    s.add_argument("--depth", default="1")
    s.add_argument("--direction", default="inbound", choices=("inbound", "outbound", "both"))
    s.add_argument("--betweenness", action="store_true", help="rank by betweenness too: its cost grows with the square of the graph")
    s.add_argument("--json", action="store_true")
    s = sub.add_parser("lock")
    s.add_argument("paths", nargs="*")
    s.add_argument("--all", action="store_true")
    s.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            print(config.init(args.root), file=out)
            return CLEAN
        if args.command == "guide":
            out.write(guide())
            return CLEAN
        root = config.find_root(args.root)
        if root is None:
            raise UsageError("no configuration here or above; write one with init")
        if args.command == "ignores":
            out.write("".join(line + "\n" for line in show_ignores(root)))
            return CLEAN
        if args.command in ("nodes", "edges") and args.all == bool(args.paths):
            raise UsageError(f"{args.command} takes either selectors or --all")
        spark = spark or SparkSession.builder.appName("skeinwork").getOrCreate()
        ship_package(spark)
        run, code = Run(spark, root, args.root), CLEAN
        if getattr(args, "paths", None):
            args.paths = run.keys(args.paths)
        if args.command == "check":
            lines, code = check(run, args.json)
        elif args.command == "lock":
            lines, code = lock(run, args.paths, args.all, args.json)
        elif args.command == "graph":
            lines = [jgf.raw_document(run.built.nodes, run.built.edges) if args.raw else jgf.document(run.nodes, run.blocks)]
        else:
            lines = {"nodes": show_nodes, "edges": show_edges, "impact": show_impact}[args.command](run, args)
        text = "".join(line + "\n" for line in lines)
        size = len(text.encode())
        if args.max_bytes is not None and size > args.max_bytes:  # refused whole, never cut
            raise UsageError(f"the output has {size} bytes, more than {args.max_bytes}")
        out.write(text)
        if args.command in ("nodes", "edges") and size > LARGE:
            run.hints.append(f"large-projection: {size} bytes")
        for hint in run.hints:
            print(f"hint[{hint.split(':')[0]}]:{hint.partition(':')[2]}", file=err)
        return code
    except (UsageError, config.ConfigError, FileExistsError) as e:
        print(f"error: {e}", file=err)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
