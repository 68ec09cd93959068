import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions import frontmatter, markdown
from skeinwork.functions import paths as P


def value(spark, column, **given_):
    df = spark.createDataFrame([tuple(given_.values())], ", ".join(f"{k} string" for k in given_))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("path,want", [
    ("a/b", "a/b"), ("./a", "a"), ("a/../b", "b"), ("../a", "../a"), ("a/../../b", "../b"), ("..", ".."), (".", "."), ("a/..", "."), ("/a/../..", "/"), ("/../a", "/a"), ("a//b/./c", "a/b/c"), ("../..", "../.."),
])
def test_normalize(spark, path, want):
    assert value(spark, P.normalize_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("source,target,want", [
    ("docs/a.md", "b.md", "docs/b.md"), ("docs/a.md", "../b.md", "b.md"), ("a.md", "b.md", "b.md"), ("docs/a.md", "..", "."), ("docs/a.md", "../..", ".."), ("docs/a.md", "/x", "/x"),
])
def test_resolve(spark, source, target, want):
    assert value(spark, P.resolve_link(F.col("s"), F.col("t")), s=source, t=target) == want


name = st.text("abcé.-", min_size=1, max_size=4).filter(lambda s: s not in (".", ".."))
some_path = st.lists(name, min_size=1, max_size=4).map("/".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(some_path, some_path), min_size=20, max_size=60))
def test_relative_from_is_the_inverse(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, t string")
    back = df.withColumn("back", P.resolve_link(F.col("s"), P.relative_from(F.col("s"), F.col("t"))))
    assert back.where("back <> t").count() == 0
    for r in back.select("s", "t", P.resolve_link(F.col("s"), F.col("t")).alias("r")).collect():
        assert r.r == posixpath.normpath(posixpath.join(posixpath.dirname(r.s), r.t))


def test_text_functions(spark):
    assert value(spark, P.slug(F.col("t")), t="Sizing — Notes_1 Cafe\u0301?") == "sizing--notes_1-cafe\u0301"
    assert value(spark, P.one_line(F.col("t")), t="a\nb\tc\x01d") == "a\\nb\\tc\\u{1}d"
    assert value(spark, P.percent_decode(F.col("t")), t="%C3%BCber+x") == "über+x"
    assert value(spark, P.percent_decode(F.col("t")), t="100%") == "100%"
    assert value(spark, P.percent_decode(F.col("t")), t="%FF") == "%FF"
    assert value(spark, P.fragment(F.col("t")), t="a.md#x#y") == "x#y"
    assert value(spark, P.fragment(F.col("t")), t="a.md#") is None
    assert value(spark, P.render_value(F.col("t")), t="a\nb") == '"a\\nb"'


@pytest.mark.parametrize("target,want", [("http://x", True), ("MAILTO:x", True), ("urn:a", True), ("a:b", False), ("C:/x", False), ("x//y", False), ("", False), (None, False)])
def test_is_uri(spark, target, want):
    assert value(spark, P.is_uri(F.col("t")), t=target) is want


@pytest.mark.parametrize("glob,path,want", [
    ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "d/e/a.md", True), ("docs/**", "docs/a/b", True), ("docs/**", "docs", False),
    ("a?c", "abc", True), ("a?c", "a/c", False), ("{a,b}.md", "b.md", True), ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("a+b.md", "a+b.md", True), ("a*", "a\nb", True),
])
def test_glob(spark, glob, path, want):
    assert value(spark, P.matches_globs(F.col("p"), [glob]), p=path) is want


def test_markdown_links():
    text = "[a](b.md#x) ![i](c.png) <https://x.y> <me@x.y> [m](mailto:z)\n\n[r][ref] [ref][] [ref]\n\n[ref]: d.md 'T'\n"
    assert markdown.parse(text).links == [("b.md#x", 1), ("c.png", 1), ("https://x.y", 1), ("mailto:z", 1), ("d.md", 3), ("d.md", 3), ("d.md", 3)]
    assert markdown.parse("`[n](x)`\n\n    [n](y)\n\n~~~\n[n](z)\n~~~\n- [y](w)\n  [y](v)\n> [q](q)\n").links == [("w", 8), ("v", 9), ("q", 10)]
    assert markdown.parse("[![alt](i.png)](t.md) [a [b](c.md) d](e.md) [x](<a b.md> \"t\") [y](f(1).md)").links == [("t.md", 1), ("i.png", 1), ("c.md", 1), ("a b.md", 1), ("f(1).md", 1)]
    assert markdown.parse("---\ns: [x](y)\n---\n[a](b.md)").links == [("b.md", 4)]
    assert markdown.parse("").links == [] and markdown.parse("[open](").links == [] and markdown.parse("\\[a](b)").links == []


def test_markdown_anchors():
    assert markdown.parse("# Title\n\n## OBS-92\n\nSetext\n------\n\n```\n# no\n```\n").anchors == ["title", "obs-92", "setext"]
    assert markdown.parse("## See **the** `fs` [c](d.md) ![i](j)\n").anchors == ["see-the-fs-c"]
    assert markdown.parse('<a id="FAQ"></a>\n\n## Q\n\n<a title="a > b" name=\'n\' id=x id=y>\n<abbr id="no">\n').anchors == ["FAQ", "q", "x", "n"]
    assert markdown.parse("# a\n# a\n# a-1\n# a\n").anchors == ["a", "a-1", "a-1-1", "a-2"]


def test_long_markdown_is_read_in_linear_time():
    assert len(markdown.parse("x [a](b) `c` *d* [\n" * 20_000).links) == 20_000


def test_frontmatter():
    links, meta, problem = frontmatter.parse("---\nsources:\n  - setup.md\n  - {deep: ../x.md}\nn: 1\nyes: yes\nt: 2024-01-01\nv: [1.5, ~, true, .inf]\n---\nbody", {"sources"})
    assert links == [("setup.md", 3), ("../x.md", 4)] and problem is None
    assert meta == '{"n":1,"sources":["setup.md",{"deep":"../x.md"}],"t":"2024-01-01","v":[1.5,null,true,null],"yes":"yes"}'
    assert frontmatter.parse("---\np: `x`\n---\n", {"p"})[2]
    assert frontmatter.parse("---\n- a\n---\n", {"p"})[2]
    assert frontmatter.parse("---\na: \0\n---\n", {"p"})[2]
    assert frontmatter.parse("no block", {"p"}) == ([], None, None)
    assert frontmatter.parse("---\n\na: 1\n---\n", {"p"}) == ([], None, None)


def test_parsers_in_spark(spark):
    df = spark.createDataFrame([("a.md", "# T\n[x](y)"), ("b.md", None), ("c.md", "---\ns: q.md\n---\n")], "path string, text string")
    got = {r.path: r for r in markdown.parse_pages(df).collect()}
    assert got["a.md"].anchors == ["t"] and got["a.md"].links[0].target == "y" and got["b.md"].links is None and got["c.md"].anchors == []
    assert [(r.path, r.links[0].target) for r in frontmatter.parse_pages(df, ["s"]).collect()] == [("c.md", "q.md")]


@pytest.mark.parametrize("text,want", [
    ("100%-caf%C3%A9", "100%-café"), ("%+A%41%", "%+AA%"), ("%4", "%4"), ("a%zz%20b", "a%zz b"), ("é%C3%A9%", "éé%"), ("%C3x%41", "%C3x%41"), ("", ""), (None, None), ("%00%0A", "\x00\n"), ("%E2%82%AC" * 3000, "€" * 3000),
])
def test_escapes_are_decoded_one_by_one(spark, text, want):
    assert value(spark, P.percent_decode(F.col("t")), t=text) == want
