"""A directory tree as a Spark data source: ``spark.read.format("skein_tree").option("root", ...).load()``.

Rows: path, kind (file, directory, symlink), content (bytes of readable files, else null), link_target.
The listing prunes ignored subtrees where it is made, on the driver, and deals the files into partitions
by size; contents are read by the executors. With ``content=false`` nothing is opened.
"""

from __future__ import annotations

import os
import posixpath
import re
import stat
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import glob_regex

#: Directories and files that belong to version control, pruned at any depth.
VERSION_CONTROL = (".git", ".hg", ".svn", ".jj")
#: The engine's own state beside the tree.
STATE_DIR = ".skein"
SCHEMA = "path string, kind string, content binary, link_target string"
#: Bytes that one partition reads.
PARTITION_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: where it holds, what it matches, and whether it takes back."""

    base: str
    pattern: re.Pattern
    negated: bool
    directories_only: bool


def ignore_rules(text: str, base: str) -> list[Rule]:
    """The rules of one ignore file that lies in ``base`` (a path from the root, empty for the root)."""
    out = []
    for line in text.splitlines():
        line = line.rstrip("\n")
        line = re.sub(r"(?<!\\) +$", "", line).replace("\\ ", " ")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line[1:] if line.startswith(("\\#", "\\!")) else line
        only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        glob = line.lstrip("/") if anchored else "**/" + line
        out.append(Rule(base, re.compile(glob_regex(glob)), negated, only))
    return out


def is_ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that matches ignores the path; rules are in order of rising precedence."""
    for rule in reversed(rules):
        if rule.directories_only and not is_dir:
            continue
        if rule.base and not path.startswith(rule.base + "/"):
            continue
        if rule.pattern.search(path[len(rule.base) + 1 :] if rule.base else path):
            return not rule.negated
    return False


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.rstrip("\n") if done.returncode == 0 and done.stdout else None


def repository_root(root: str) -> str | None:
    at = os.path.abspath(root)
    while True:
        if any(os.path.lexists(os.path.join(at, d)) for d in (".git", ".jj")):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def ignore_sources(root: str) -> dict[str, list[str]]:
    """Ignore files that apply from outside and above the tree, by kind, in order of rising precedence."""
    repo = repository_root(root)
    out: dict[str, list[str]] = {"global": [], "exclude": [], "above": []}
    if repo is None:
        return out
    world = _git(root, "config", "--path", "--get", "core.excludesFile") or os.path.join(
        os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore"
    )
    inner = _git(root, "rev-parse", "--git-path", "info/exclude")
    for kind, path in (("global", world), ("exclude", inner and os.path.join(root, inner))):
        if path and os.path.isfile(path):
            out[kind].append(path)
    at, chain = os.path.abspath(root), []
    while at != repo:
        at = os.path.dirname(at)
        if os.path.isfile(os.path.join(at, ".gitignore")):
            chain.append(os.path.join(at, ".gitignore"))
    out["above"] = chain[::-1]
    return out


def _read_text(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


class _Outer:
    """Rules from outside the tree see paths from the repository's root."""

    def __init__(self, root: str) -> None:
        self.repo = repository_root(root)
        self.prefix = ""
        self.rules: list[Rule] = []
        if self.repo is None:
            return
        rel = os.path.relpath(os.path.abspath(root), self.repo)
        self.prefix = "" if rel == "." else rel.replace(os.sep, "/") + "/"
        for kind, files in ignore_sources(root).items():
            for path in files:
                base = os.path.relpath(os.path.dirname(path), self.repo).replace(os.sep, "/") if kind == "above" else ""
                self.rules += ignore_rules(_read_text(path), "" if base == "." else base)


def walk(root: str, ignore: list[str] | None = None) -> Iterator[tuple[str, str, int, str | None]]:
    """``(path, kind, size, link_target)`` of everything below ``root`` that is not ignored, sorted by path.

    Links are not followed, hidden entries are included, sockets and pipes are skipped, the root itself
    is left out. ``ignore`` has globs on paths; a directory also matches as ``path/``.
    """
    globs = [re.compile(glob_regex(g)) for g in ignore or []]
    outer = _Outer(root)
    found: list[tuple[str, str, int, str | None]] = []

    def visit(rel: str, rules: list[Rule]) -> None:
        here = os.path.join(root, rel) if rel else root
        if outer.repo is not None and os.path.isfile(os.path.join(here, ".gitignore")):
            rules = rules + ignore_rules(_read_text(os.path.join(here, ".gitignore")), (outer.prefix + rel).strip("/"))
        for entry in os.scandir(here):
            path = f"{rel}/{entry.name}" if rel else entry.name
            if entry.name in VERSION_CONTROL or entry.name == STATE_DIR:
                continue
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            if is_ignored(outer.prefix + path, is_dir, rules):
                continue
            if any(g.search(path) or is_dir and g.search(path + "/") for g in globs):
                continue
            if stat.S_ISLNK(info.st_mode):
                found.append((path, "symlink", 0, link_target(root, path)))
            elif is_dir:
                found.append((path, "directory", 0, None))
                visit(path, rules)
            elif stat.S_ISREG(info.st_mode):
                found.append((path, "file", info.st_size, None))

    visit("", outer.rules)
    return iter(sorted(found, key=lambda x: x[0].encode("utf-8", "surrogateescape")))


def link_target(root: str, path: str) -> str | None:
    """Where a symlink leads, from the root; null if it leaves the tree or leads nowhere."""
    try:
        raw = os.readlink(os.path.join(root, path))
    except OSError:
        return None
    if os.path.isabs(raw):
        top = os.path.realpath(root)
        real = os.path.realpath(raw)
        if not os.path.exists(real) or os.path.commonpath([top, real]) != top:
            return None
        return os.path.relpath(real, top).replace(os.sep, "/")
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(path), raw.replace(os.sep, "/")))
    if joined == ".." or joined.startswith("../") or not os.path.lexists(os.path.join(root, joined)):
        return None
    return joined


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, str | None]]) -> None:
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("root") or options.get("path")
        if not self.root or not os.path.isdir(self.root):
            raise ValueError("option root must name a directory")
        self.ignore = [g for g in (options.get("ignore") or "").split("\n") if g]
        self.content = (options.get("content") or "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        parts, rows, size = [], [], 0
        for row in walk(self.root, self.ignore):
            rows.append(row)
            size += (row[2] if self.content else 0) + 256
            if size >= PARTITION_BYTES:
                parts.append(_Part(rows))
                rows, size = [], 0
        return [*parts, _Part(rows)]

    def read(self, partition: _Part):
        for path, kind, _, target in partition.rows:
            body = None
            if self.content and kind == "file":
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        body = f.read()
                except OSError:
                    pass
            yield (path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), kind, body, target)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, content: bool = True):
    register(spark)
    return spark.read.format("skein_tree").options(root=root, ignore="\n".join(ignore or []), content=str(content).lower()).load()
