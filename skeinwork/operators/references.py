"""References to records that do not exist, now or at the time of the reference."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Schemes that make a value an address rather than a path.
URI_SCHEMES = ("mailto:", "tel:", "data:", "urn:", "javascript:")


def is_exempt(value: Column) -> Column:
    """Null, empty and URI values refer to nothing in the table."""
    low = F.lower(value)
    uri = value.contains("://")
    for scheme in URI_SCHEMES:
        uri = uri | low.startswith(scheme)
    return value.isNull() | (value == "") | uri


def orphans(
    refs: DataFrame,
    parents: DataFrame,
    columns: dict[str, str],
    match: str = "simple",
    at: str | None = None,
    alive: tuple[str, str] | None = None,
) -> DataFrame:
    """The rows of ``refs`` that have no parent.

    ``columns`` maps reference columns to parent columns. References are grouped by which of these
    are null (at most 2**k masks), and each group is anti-joined on its non-null columns alone.
    ``match`` says what nulls mean, as in SQL's MATCH clause:

    - ``simple``: a reference with any null is accepted;
    - ``partial``: the non-null columns must agree with some parent; all null is accepted;
    - ``full``: some but not all null is an orphan; all null is accepted.

    With ``at`` and ``alive`` = (from, until) the parent must also live at that time, from inclusive
    to exclusive, a null end meaning still alive; a null time asks only that the key exists.
    Every surviving row keeps all its columns, repeats included. Masks that no reference has are not
    joined: one pass over the references finds the few there are, of several columns at most 2**k.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    names = list(columns)
    parts = [refs.limit(0)]
    masks = list(product((False, True), repeat=len(names)))
    if len(names) > 1:
        masks = [tuple(r) for r in refs.select(*[F.col(n).isNull() for n in names]).distinct().collect()]
    for mask in masks:
        null = [n for n, m in zip(names, mask) if m]
        held = [n for n, m in zip(names, mask) if not m]
        part = refs
        for n, m in zip(names, mask):
            part = part.where(F.col(n).isNull() if m else F.col(n).isNotNull())
        if not held or (null and match == "simple"):
            continue
        if null and match == "full":
            parts.append(part)
            continue
        keys = [columns[n] for n in held]
        side = parents.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], *[
            F.col(c).alias(f"__alive{i}") for i, c in enumerate(alive or ())
        ]).distinct()
        cond = F.lit(True)
        for i, n in enumerate(held):
            cond = cond & (F.col(n) == F.col(f"__p{i}"))
        if at and alive:
            lives = (F.col("__alive0") <= F.col(at)) & (F.col("__alive1").isNull() | (F.col(at) < F.col("__alive1")))
            cond = cond & (F.col(at).isNull() | lives)
        parts.append(part.join(side, cond, "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_references(raw_edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Every path-valued end of edges and findings: ref_table, ref_id, field, path, at."""

    def ends(df: DataFrame, name: str, key: str, when: str, fields: list[str]) -> DataFrame:
        one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("path")) for f in fields]))
        return df.select(F.col(key).alias("ref_id"), F.col(when).alias("at"), one.alias("r")).select(
            F.lit(name).alias("ref_table"), "ref_id", "r.field", "r.path", "at"
        )

    both = ends(raw_edges, "raw_edges", "edge_id", "seen_at", ["source", "target"]).unionByName(
        ends(findings, "findings", "finding_id", "found_at", ["subject", "target"])
    )
    return both.where(~is_exempt(F.col("path")))


def orphan_references(raw_edges: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphans among path references: ref_table, ref_id, field, reason, period (``YYYY-MM``).

    A reference whose time is unknown is judged by its key alone and has a null period. ``reason`` is
    ``missing``, ``late`` (every lifetime begins later) or ``deleted``. Orphans, few beside the references, are
    written before the second join, against one row per path: nothing lies between the anti-join and its result
    that needs its partitions whole, so adaptive execution splits the path that most references share.
    """
    lives = nodes.select("path", "first_seen", "deleted_at").where("path is not null")
    lost = orphans(
        path_references(raw_edges, findings), lives, {"path": "path"}, "simple", "at", ("first_seen", "deleted_at")
    )
    lost = materialize(lost, "orphans")
    first = lives.groupBy(F.col("path").alias("__path")).agg(F.min("first_seen").alias("__first"))
    reason = (
        F.when(F.col("__path").isNull(), "missing").when(F.col("__first") > F.col("at"), "late").otherwise("deleted")
    )
    return lost.join(first, F.col("path") == F.col("__path"), "left").select(
        "ref_table", "ref_id", "field", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("period")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphans per table, month and reason."""
    return found.groupBy("ref_table", "field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))
