import io
import os
import subprocess

import pytest

from skeinwork import cli
from skeinwork.sources import config, lockfile, tree
from tests.conftest import rows

CONFIG = """
ignore = ["skip/**", "tmp/"]
[graphs.markdown]
parser = "markdown"
[graphs.front]
parser = "frontmatter"
edge_keys = ["sources"]
[rules]
unresolved-edge = "error"
"""


def write(root, files):
    for path, body in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def site(tmp_path):
    write(tmp_path, {
        ".skein/config.toml": CONFIG, "index.md": "# Index\n[s](setup.md#install) [bad](docs/none.md)\n", "setup.md": "\ufeff# Install\n", "docs/a.md": "---\nsources:\n  - ../setup.md\n---\n[x](setup.md)\n",
        "docs/bad.md": b"\xff", "skip/x.md": "[y](z.md)", "tmp/q": "", "lone.txt": "x", ".hidden": "h",
    })
    os.symlink("setup.md", tmp_path / "link.md")
    os.symlink("/etc", tmp_path / "out")
    return tmp_path


def run(spark, site, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(["-C", str(site), *argv], spark, out, err)
    return code, out.getvalue(), err.getvalue()


def test_walk(spark, site):
    found = {r.path: r for r in tree.read_tree(spark, str(site), ["skip/**", "tmp/"]).collect()}
    assert set(found) == {".hidden", "docs", "docs/a.md", "docs/bad.md", "index.md", "link.md", "lone.txt", "out", "setup.md"}
    assert found["docs"].kind == "directory" and found["link.md"].link_target == "setup.md" and found["out"].link_target is None
    assert bytes(found["docs/bad.md"].content) == b"\xff" and found["link.md"].content is None
    assert tree.read_tree(spark, str(site), content=False).where("content is not null").count() == 0


def test_check_lock_and_drift(spark, site):
    code, out, _ = run(spark, site, "check")
    assert code == 1 and "no-baseline" in out and "error[unresolved-edge]: docs/a.md:5 -> docs/setup.md; cause: meant from the top: ../setup.md" in out
    assert "unreadable-text]: docs/bad.md" in out and "detached-node]: lone.txt" in out and "unresolved-fragment" not in out
    assert run(spark, site, "lock", "--all")[0] == 0
    assert "stale" not in run(spark, site, "check")[1]
    (site / "setup.md").write_text("# Other\n")
    out = run(spark, site, "check")[1]
    assert "stale-node]: setup.md" in out and "stale-edge]: index.md:2 -> setup.md" in out and "unresolved-fragment]: index.md:2 -> setup.md (#install)" in out
    assert "stale-edge]: link.md" in out
    assert run(spark, site, "lock", "setup.md")[0] == 0 and "stale-node" not in run(spark, site, "check")[1]
    code, _, err = run(spark, site, "lock", "docs")
    assert code == 2 and "directory" in err


def test_reads(spark, site):
    assert run(spark, site, "edges", "docs/a.md", "--namespace", "front")[1] == "docs/a.md -> setup.md\n"
    assert '@front:' in run(spark, site, "nodes", "docs", "--namespace", "front")[1]
    code, out, _ = run(spark, site, "impact", "setup.md", "--depth", "all")
    assert code == 0 and out.startswith("docs/a.md (depth 1")
    assert run(spark, site, "impact", "none.md")[0] == 2 and run(spark, site, "nodes")[0] == 2
    code, out, _ = run(spark, site, "graph")
    assert code == 0 and out.startswith('{"graph"')
    assert run(spark, site, "--max-bytes", str(len(out.encode())), "graph")[0] == 0
    assert run(spark, site, "--max-bytes", str(len(out.encode()) - 1), "graph")[0] == 2
    code, out, _ = run(spark, site, "nodes", "docs/a.md", "--json")
    assert code == 0 and '"sources": ["../setup.md"]' in out
    assert "    sources:\n      - ../setup.md" in run(spark, site, "nodes", "docs/a.md", "--namespace", "@front")[1]
    assert run(spark, site, "nodes", "docs/a.md", "--namespace", "none")[0] == 2 and run(spark, site, "nodes", "../x")[0] == 2
    assert run(spark, site / "docs", "edges", "a.md", "--namespace", "front")[1] == "docs/a.md -> setup.md\n"
    assert "did you mean docs/a.md" in run(spark, site, "nodes", "a")[2]


def test_git_ignores(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    write(tmp_path, {".gitignore": "*.log\n/build\n!keep.log\nlogs/\n", "a.log": "", "keep.log": "", "build/x": "", "sub/build": "", "sub/.gitignore": "y\n", "sub/y": "", "sub/z": "", "logs/q": "", ".git/info/exclude": "secret\n", "secret": "", "y": ""})
    mine = {p for p, k, _, _ in tree.walk(str(tmp_path)) if k == "file"}
    every = [os.path.relpath(os.path.join(d, f), tmp_path) for d, dirs, files in os.walk(tmp_path) if ".git" not in d.split(os.sep) for f in files]
    told = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--stdin"], input="\n".join(every), capture_output=True, text=True).stdout.split()
    assert mine == set(every) - set(told)


def test_config_is_strict():
    parsed = config.parse(CONFIG + 'stale-node = { severity = "off", ignore = ["a"] }\nnew-rule = "warn"\n')
    assert [g.name for g in parsed.graphs] == ["front", "markdown"] and parsed.severities["stale-node"] == "off" and parsed.hints == ["unknown-rule: new-rule"]
    for bad in ("x = 1", "[graphs.fs]\nparser='markdown'", "[graphs.a]\nparser='csv'", "[graphs.a]\nparser='markdown'\nedge_keys=['x']", "[rules]\nstale-node='loud'", "ignore = 3", "["):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_lock_file_round_trip(spark, tmp_path):
    nodes, edges = [("b\n\"q\"", "h"), ("a", None)], [("a", "z é", None), ("a", "b", "k")]
    text = lockfile.render(nodes, edges)
    back = lockfile.parse(text)
    assert sorted(back[0], key=str) == sorted(nodes, key=str) and sorted(back[1], key=str) == sorted(edges, key=str)
    assert lockfile.render(*back) == text
    for bad in ("other = 1", "[nodes.a]\nx = 1", "[nodes.a.edges]\nb = { y = 1 }", "nodes ="):
        with pytest.raises(lockfile.LockError):
            lockfile.parse(bad)
    lockfile.write_tables(spark.createDataFrame(nodes, lockfile.NODES), spark.createDataFrame(edges, lockfile.EDGES), str(tmp_path))
    assert rows(lockfile.read_tables(spark, str(tmp_path))[0]) == sorted(nodes, key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_guide_and_init(spark, tmp_path):
    code, out, _ = run(spark, tmp_path, "guide")
    assert code == 0 and all(r in out for r in config.RULES)
    assert run(spark, tmp_path, "init")[0] == 0 and run(spark, tmp_path, "init")[0] == 2
    assert config.load(str(tmp_path)).graphs[0].name == "markdown"
    assert run(spark, tmp_path, "check")[0] == 0


def test_text_layout():
    from skeinwork.operators.project import graph_key, metadata_lines

    assert metadata_lines({"b": [{"x": 1, "y": "a\nb"}, {}, 2], "a": {"c": None}}) == ["a:", "  c: null", "b:", "  - x: 1", '    y: "a\\nb"', "  - {}", "  - 2"]
    assert graph_key("../a", "/r/d", "/r") == "a" and graph_key("..", "/r/d", "/r") == "." and graph_key("/x", "/r", "/r") is None


def test_json_forms_and_raw_graph(spark, site):
    import json

    code, out, _ = run(spark, site, "check", "--json")
    told = json.loads(out)
    assert code == 1 and told["errors"] == len([f for f in told["findings"] if f["severity"] == "error"]) and {"name", "subject", "severity"} <= set(told["findings"][0])
    raw = {g["id"]: g for g in json.loads(run(spark, site, "graph", "--raw")[1])["graphs"]}
    assert set(raw) == {"fs", "front", "markdown"} and raw["fs"]["nodes"]["setup.md"]["metadata"]["type"] == "file"
    assert {"source": "index.md", "target": "setup.md", "metadata": {"occurrences": [{"line": 2, "link": "setup.md#install"}]}} in raw["markdown"]["edges"]
    whole = json.loads(run(spark, site, "graph")[1])["graph"]
    edge = next(e for e in whole["edges"] if e["source"] == "docs/a.md" and e["target"] == "setup.md")
    assert edge["metadata"]["@front"]["occurrences"][0]["line"] == 3 and edge["metadata"]["_graphs"] == ["@front"]
    link = next(e for e in whole["edges"] if e["source"] == "link.md")
    assert link["metadata"] == {"_graphs": ["@fs"]}  # the file system tells of an edge, and nothing more
    rows_of = [json.loads(line) for line in run(spark, site, "edges", "index.md", "--json", "--field", "link")[1].splitlines()]
    assert rows_of == [{"source": "index.md", "target": "setup.md", "metadata": {"@markdown": {"occurrences": [{"link": "setup.md#install"}]}}}]
    assert run(spark, site, "edges", "link.md", "--json", "--namespace", "fs")[1] == ""


def test_impact_tells_what_is_broken_beside_it(spark, site):
    import json

    assert run(spark, site, "lock", "--all")[0] == 0
    (site / "docs/a.md").write_text("# A\n")
    out = json.loads(run(spark, site, "impact", "setup.md", "--json")[1])
    assert [r["node"] for r in out["impacted"]] == ["index.md", "link.md"] and all(r["betweenness"] == 0 for r in out["impacted"])
    assert [(d["name"], d["subject"], d["target"]) for d in out["diagnostics"]] == [("removed-edge", "docs/a.md", "setup.md")]
    text = run(spark, site, "impact", "index.md", "--direction", "outbound", "--betweenness")[1]
    assert "note[unresolved-edge]: index.md -> docs/none.md" in text


def test_lock_by_glob_is_written_only_on_change(spark, site):
    import json

    assert json.loads(run(spark, site, "lock", "*.md", "--json")[1]) == {"locked": 3, "selectors": ["*.md"], "written": True}
    lock_file = site / ".skein" / lockfile.FILE
    before = lock_file.stat().st_mtime_ns
    assert not json.loads(run(spark, site, "lock", "index.md", "--json")[1])["written"] and lock_file.stat().st_mtime_ns == before
    assert "zero-match-selector" in run(spark, site, "lock", "*.none")[2] and "nothing-to-lock" in run(spark, site, "lock", "*.none")[2]
    lock_file.write_text("nodes =")
    assert run(spark, site, "lock", "index.md")[0] == 2 and "replaced-unreadable-lock" in run(spark, site, "lock", "--all")[2]


def test_ignores_and_suggestions(spark, tmp_path):
    write(tmp_path, {".skein/config.toml": CONFIG, ".git/info/exclude": "x\n", **{f"d{i}/same.md": "# S\n" for i in range(7)}})
    out = run(spark, tmp_path, "ignores")[1]
    assert "configuration: skip/**" in out
    err = run(spark, tmp_path, "nodes", "same")[2]
    assert "did you mean d0/same.md" in err and "and 2 more?" in err


def test_links_to_names_that_begin_with_dots_stay(tmp_path):
    write(tmp_path, {"..x": "", "in/y": ""})
    for name, to in (("a", "..x"), ("in/b", "../..x"), ("in/c", "../../z"), ("d", "..")):
        os.symlink(to, tmp_path / name)
    found = {p: t for p, k, _, t in tree.walk(str(tmp_path)) if k == "symlink"}
    assert found == {"a": "..x", "in/b": "..x", "in/c": None, "d": None}
