"""Path, link and text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URI schemes without an authority.
BARE_SCHEMES = ("mailto", "tel", "data", "urn", "javascript")


def is_uri(target: Column) -> Column:
    """Whether a link target is an address: a scheme with an authority, or one of the bare schemes."""
    return F.coalesce(F.lower(target).rlike(rf"^([a-z][a-z0-9+.\-]*://|({'|'.join(BARE_SCHEMES)}):)"), F.lit(False))


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``: leading ``..`` stay, an absolute root stays, nothing left is ``.``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    absolute = F.startswith(path, F.lit("/"))
    start = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        poppable = (F.size(acc) > 0) & (F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(F.lit(".."))), -1) != "..")
        up = F.when(poppable, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(
            F.concat(acc, F.array(part))
        )
        return F.when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    joined = F.array_join(F.aggregate(parts, start, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def parent(path: Column) -> Column:
    """The directory part of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve_link(source: Column, target: Column) -> Column:
    """A link target as a path: joined to its source's directory unless absolute, then normalised."""
    joined = F.when(F.startswith(target, F.lit("/")) | (parent(source) == ""), target).otherwise(
        F.concat(parent(source), F.lit("/"), target)
    )
    return normalize_path(joined)


def relative_from(source: Column, target: Column) -> Column:
    """The inverse of ``resolve_link``: how to write ``target`` from ``source``; ``./`` where it lies below."""
    base = F.filter(F.split(parent(source), "/"), lambda p: p != "")
    to = F.filter(F.split(target, "/"), lambda p: p != "")
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(base), F.size(to)), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when(
            (acc == i - 1) & (i <= F.size(base)) & (i < F.size(to))
            & (F.try_element_at(base, i) == F.try_element_at(to, i)), i
        ).otherwise(acc),
    )
    ups = F.array_repeat(F.lit(".."), F.size(base) - shared)
    rest = F.slice(to, shared + 1, F.greatest(F.size(to) - shared, F.lit(0)))
    written = F.array_join(F.concat(ups, rest), "/")
    return F.when(F.size(ups) == 0, F.concat(F.lit("./"), written)).otherwise(written)


def fragment(link: Column) -> Column:
    """What follows the first ``#``, null where it is absent or empty (the top of the page)."""
    text = F.regexp_extract(link, r"(?s)^[^#]*#(.*)$", 1)
    return F.when(text != "", text)


def without_fragment(link: Column) -> Column:
    return F.substring_index(link, "#", 1)


def slug(text: Column) -> Column:
    """A heading's anchor: lower case, blanks to hyphens, letters, digits, marks, ``-`` and ``_`` kept."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}_\- ]", ""), F.lit(" "), F.lit("-"))


def one_line(value: Column) -> Column:
    """A value on one line: line feeds, returns and tabs as escapes, other controls as ``\\u{hex}``."""
    out = F.replace(F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    plain = ~out.rlike(r"\p{Cc}")
    chars = F.transform(
        F.split(out, ""),
        lambda c: F.when(c.rlike(r"^\p{Cc}$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c),
    )
    return F.when(plain, out).otherwise(F.array_join(chars, ""))


def short_hash(value: Column, chars: int = 13) -> Column:
    return F.substring(value, 1, chars)


def lines_suffix(lines: Column) -> Column:
    """``:3,12`` for an array of lines, nothing for none."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(":"), F.array_join(lines.cast("array<string>"), ","))).otherwise("")


def render_value(value: Column) -> Column:
    """A bare string, or its JSON text where it contains controls."""
    return F.when(value.rlike(r"\p{Cc}"), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)).otherwise(value)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored Java regex: ``*`` and ``?`` stop at ``/``, ``**`` does not; ``[]`` and ``{}`` work."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            out += "[" + ("^" if negated else "") + body[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches; no globs match nothing."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def percent_decode(text: Column) -> Column:
    """``%XX`` escapes decoded as UTF-8; a ``%`` that begins no escape stays, as does ``+``.

    A text that decodes to bytes that are no UTF-8 stays as it is written.
    """
    parts = F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), 0)
    digits = F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(p.cast("binary"))))
    decoded = F.try_validate_utf8(F.unhex(F.array_join(digits, "")).cast("string"))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(decoded, text)).otherwise(text)
