"""The configuration file: graphs, rules and globs to ignore, read strictly from TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from .tree import STATE_DIR

FILE = "config.toml"
#: The rules that a configuration may name, and what a rule can be set to.
RULES = (
    "stale-node", "stale-edge", "new-edge", "removed-edge", "removed-node", "unresolved-edge", "unresolved-fragment",
    "detached-node", "unlocked-node", "no-baseline", "unreadable-frontmatter", "unreadable-text",
)
SEVERITIES = ("error", "warn", "off")
PARSERS = ("markdown", "frontmatter")
DEFAULT_FILES = ["**/*.md"]


class ConfigError(ValueError):
    pass


@dataclass
class GraphConfig:
    name: str
    parser: str
    files: list[str] = field(default_factory=lambda: list(DEFAULT_FILES))
    edge_keys: list[str] = field(default_factory=list)


@dataclass
class Config:
    graphs: list[GraphConfig] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    rule_ignore: list[str] = field(default_factory=list)
    severities: dict[str, str] = field(default_factory=dict)
    ignores: dict[str, list[str]] = field(default_factory=dict)
    usage: bool = False
    hints: list[str] = field(default_factory=list)

    def policy(self) -> tuple[dict[str, str], dict[str, list[str]]]:
        """Severities and ignore globs as ``rules.apply_policy`` takes them."""
        return self.severities, {**({"": self.rule_ignore} if self.rule_ignore else {}), **self.ignores}


def _only(table: dict, known: tuple[str, ...], where: str) -> None:
    for key in table:
        if key not in known:
            raise ConfigError(f"unknown key {key!r} in {where}")


def _texts(value, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where} must be a list of strings")
    return value


def parse(text: str) -> Config:
    """A configuration from TOML; unknown keys are errors, unknown rule names only hints."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _only(raw, ("ignore", "graphs", "rules", "usage"), "the file")
    out = Config(ignore=_texts(raw.get("ignore", []), "ignore"))
    for name, table in sorted(raw.get("graphs", {}).items()):
        where = f"graphs.{name}"
        _only(table, ("parser", "files", "edge_keys"), where)
        if not name or name == "fs" or "@" in name or name.startswith("_"):
            raise ConfigError(f"a graph cannot be named {name!r}")
        parser = table.get("parser")
        if parser not in PARSERS:
            raise ConfigError(f"{where} needs a parser: one of {', '.join(PARSERS)}")
        if "edge_keys" in table and parser != "frontmatter":
            raise ConfigError(f"{where}: edge_keys belong to the frontmatter parser")
        out.graphs.append(GraphConfig(
            name, parser, _texts(table.get("files", list(DEFAULT_FILES)), f"{where}.files"),
            _texts(table.get("edge_keys", []), f"{where}.edge_keys"),
        ))
    rules = dict(raw.get("rules", {}))
    out.rule_ignore = _texts(rules.pop("ignore", []), "rules.ignore")
    for name, value in rules.items():
        if name not in RULES:
            out.hints.append(f"unknown-rule: {name}")
            continue
        table = {"severity": value} if isinstance(value, str) else value
        _only(table, ("severity", "ignore"), f"rules.{name}")
        level = table.get("severity", "warn")
        if level not in SEVERITIES:
            raise ConfigError(f"rules.{name}: {level!r} is no severity")
        out.severities[name] = level
        if "ignore" in table:
            out.ignores[name] = _texts(table["ignore"], f"rules.{name}.ignore")
    usage = raw.get("usage", {})
    _only(usage, ("enabled",), "usage")
    out.usage = bool(usage.get("enabled", False))
    return out


def find_root(start: str) -> str | None:
    """The nearest directory at or above ``start`` that has a configuration."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, STATE_DIR, FILE)):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def load(root: str) -> Config:
    state = os.path.join(root, STATE_DIR)
    if os.path.lexists(state) and (os.path.islink(state) or not os.path.isdir(state)):
        raise ConfigError(f"{STATE_DIR} must be a directory")
    with open(os.path.join(state, FILE), encoding="utf-8") as f:
        return parse(f.read())


TEMPLATE = """# Globs of paths to leave out.
ignore = []

[graphs.markdown]
parser = "markdown"
files = ["**/*.md"]

[rules]
unresolved-edge = "error"
"""


def init(root: str) -> str:
    """Write the template; refuses to overwrite."""
    path = os.path.join(root, STATE_DIR, FILE)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        f.write(TEMPLATE)
    return path
