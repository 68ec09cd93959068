"""Parent-child links to full hierarchies, by tree contraction.

Every node has at most one parent. A round of contraction first rakes all leaves into their parents,
then takes an independent third of the nodes left with one child out of their chain (a node goes if
its hash is larger than both neighbours'), joining child to grandparent. The number of rounds is
logarithmic in the number of nodes, whatever the depth or fan-out. Each round writes one table in
which the removed nodes are marked; reading these in reverse order recovers roots, depths, subtree
sizes and paths, as the nodes a removed one was attached to went later. What was removed in one round reads
what went later, which shrinks from round to round, so that all rounds together read a few times the nodes. What
never contracts to a root is a self-loop, the core of a cycle. Once few nodes are left, one task contracts
the rest leaf by leaf and reverses that, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_shared, reread, write_shared

#: Nodes that one task finishes: rounds over fewer cost more than their work.
LOCAL_NODES = 20_000
_ALIVE, _RAKED, _SPLICED = 0, 1, 2


def current_parents(edges: DataFrame, graph: str = "outline") -> DataFrame:
    """Current links of one graph: ``node, parent``, one row per node; a null parent makes a root.

    Of each source the row with the greatest ``seen_at`` counts (null times lose, ties go to the
    greatest target, null smallest). Targets that are no source become roots. Null sources are no
    nodes. Both steps combine before the shuffle.
    """
    newest = (
        edges.where((F.col("graph") == graph) & F.col("source").isNotNull())
        .groupBy(F.col("source").alias("node"))
        .agg(F.max(F.struct("seen_at", "target")).alias("__m"))
        .select("node", F.col("__m.target").alias("parent"))
    )
    bare = newest.where("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return newest.unionByName(bare).groupBy("node").agg(F.max("parent").alias("parent"))


def _later(a: Column, b: Column, turn: int) -> Column:
    """A total order of nodes that changes from round to round."""
    return F.struct(F.xxhash64(a, F.lit(turn)), a) > F.struct(F.xxhash64(b, F.lit(turn)), b)


def _round(alive: DataFrame, turn: int, paths: bool) -> DataFrame:
    mids = ["mid"] if paths else []
    kids = alive.where("p is not null").groupBy(F.col("p").alias("__k")).agg(F.count(F.lit(1)).alias("__kids"))
    counted = alive.join(kids, F.col("v") == F.col("__k"), "left").withColumn(
        "leaf", F.col("__k").isNull() & F.col("p").isNotNull()
    ).drop("__k", "__kids")
    inner = ~F.col("leaf")
    after = counted.where("p is not null").groupBy(F.col("p").alias("__k")).agg(
        F.coalesce(F.sum(F.when(F.col("leaf"), F.col("sz") + F.col("x"))), F.lit(0)).alias("__raked"),
        F.count_if(inner).alias("__left"),
        F.max(F.when(inner, F.col("v"))).alias("c"),
        F.max(F.when(inner, F.col("x"))).alias("__cx"),
    )
    grown = counted.join(after, F.col("v") == F.col("__k"), "left").withColumn("sz", F.col("sz") + F.coalesce("__raked", F.lit(0)))
    spliced = (
        (F.col("__left") == 1) & F.col("p").isNotNull() & (F.col("v") != F.col("p"))
        & _later(F.col("v"), F.col("p"), turn) & _later(F.col("v"), F.col("c"), turn)
    )
    kind = F.when(F.col("leaf"), _RAKED).when(F.coalesce(spliced, F.lit(False)), _SPLICED).otherwise(_ALIVE)
    marked = grown.withColumn("kind", kind)
    base = F.when(F.col("kind") == _RAKED, F.col("sz")).when(F.col("kind") == _SPLICED, F.col("sz") + F.col("__cx"))
    state = marked.select(
        "v", "p", "w", "x", "sz", *mids, "kind",
        F.when(F.col("kind") == _SPLICED, F.col("c")).alias("c"), base.alias("base"),
    )
    hooks = state.where(F.col("kind") == _SPLICED).select(
        F.col("c").alias("__c"), F.col("p").alias("__p"), F.col("w").alias("__w"),
        (F.col("x") + F.col("sz")).alias("__x"),
        *([F.concat("mid", F.array("v")).alias("__mid")] if paths else []),
    )
    hooked = F.col("__c").isNotNull()
    return state.join(hooks, F.col("v") == F.col("__c"), "left").select(
        "v",
        F.when(hooked, F.col("__p")).otherwise(F.col("p")).alias("p"),
        (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"),
        (F.col("x") + F.coalesce("__x", F.lit(0))).alias("x"),
        "sz",
        *([F.when(hooked, F.concat("__mid", "mid")).otherwise(F.col("mid")).alias("mid")] if paths else []),
        "kind", "c", "base",
    )


def contract(links: DataFrame, paths: bool = False) -> list[str]:
    """Contract ``links`` (node, parent) until ``LOCAL_NODES`` or only roots and cycle cores are alive; the written rounds.

    Columns: v, its parent p, steps w and nodes x (with what they absorbed) between them, absorbed
    size sz, kind (0 alive, 1 raked, 2 spliced), for spliced nodes the child c, and base, the size
    that reversal starts from.
    """
    spark = links.sparkSession
    start = links.select(
        F.col("node").alias("v"), F.col("parent").alias("p"), F.lit(1).cast("long").alias("w"),
        F.lit(0).cast("long").alias("x"), F.lit(1).cast("long").alias("sz"),
        *([F.array().cast("array<string>").alias("mid")] if paths else []), F.lit(_ALIVE).alias("kind"),
        F.lit(None).cast("string").alias("c"), F.lit(None).cast("long").alias("base"),
    )
    rounds = [write_shared(start, "contract0")]
    while True:
        alive = reread(spark, rounds[-1]).where(F.col("kind") == _ALIVE).drop("kind", "c", "base")
        if alive.where("p is not null and p <> v").limit(1).isEmpty() or alive.count() <= LOCAL_NODES:  # roots and cores of cycles
            return rounds
        rounds.append(write_shared(_round(alive, len(rounds), paths), f"contract{len(rounds)}"))


def _solve(rows: list[dict]) -> list[dict]:
    """Contract the links left by hand: rake leaf after leaf, then take the loops that remain, then go back.

    Of a loop the least node is the core; the others lie below it, down the links.
    """
    at = {r["v"]: r for r in rows}
    kids = dict.fromkeys(at, 0)
    for r in rows:
        r["total"] = r["sz"]
        if r["p"] is not None:
            kids[r["p"]] += 1
    raked = [v for v, n in kids.items() if not n and at[v]["p"] is not None]
    for v in raked:  # grows as parents become leaves
        up = at[at[v]["p"]]
        up["total"] += at[v]["x"] + at[v]["total"]
        kids[up["v"]] -= 1
        if not kids[up["v"]] and up["p"] is not None:
            raked.append(up["v"])
    left = set(at) - set(raked)

    def hang(r: dict, up: dict, cyc: int) -> None:
        path = [*up["path"], *r["mid"], r["v"]] if "mid" in r else None
        r.update(root=up["root"], depth=up["depth"] + r["w"], cyc=cyc, path=path)
        r["turn"] = r["depth"] if cyc == 2 else up["turn"]

    for v in sorted(left):
        r = at[v]
        if "cyc" in r:
            continue
        r.update(root=v if r["p"] is None else None, depth=0, cyc=0 if r["p"] is None else 2, path=[v], turn=0)
        if r["p"] is not None:
            loop = [r]
            while loop[-1]["p"] != v:
                loop.append(at[loop[-1]["p"]])
            total = sum(m["total"] + m["x"] for m in loop)
            for m in reversed(loop[1:]):
                hang(m, at[m["p"]], 2)
            for m in loop:
                m["total"] = total
    for v in reversed(raked):
        up = at[at[v]["p"]]
        hang(at[v], up, 1 if up["cyc"] else 0)
    return rows


def _finish(alive: DataFrame, paths: bool) -> DataFrame:
    """Root, depth, size and cycle state of the nodes that were left, in one task of at most ``LOCAL_NODES``
    nodes; beyond that these are roots and cores alone, and each stands for itself."""
    extra = ["path", "turn"] if paths else []
    core = F.col("p").isNotNull()
    if alive.count() > LOCAL_NODES:
        return alive.select(
            "v", F.when(~core, F.col("v")).alias("root"), F.lit(0).cast("long").alias("depth"),
            (F.col("sz") + F.when(core, F.col("x")).otherwise(0)).alias("total"), F.when(core, 2).otherwise(0).alias("cyc"),
            *([F.array("v").alias("path"), F.lit(0).cast("long").alias("turn")] if paths else []),
        )
    kinds = {"v": pa.string(), "root": pa.string(), "depth": pa.int64(), "total": pa.int64(), "cyc": pa.int32(), "path": pa.list_(pa.string()), "turn": pa.int64()}
    schema = pa.schema([(n, k) for n, k in kinds.items() if n not in ("path", "turn") or paths])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _solve([r for batch in batches for r in batch.to_pylist()])
        for i in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows[i : i + 2_000]], schema=schema)

    ddl = "v string, root string, depth bigint, total bigint, cyc int" + (", path array<string>, turn bigint" if extra else "")
    return alive.repartition(1).mapInArrow(run, ddl)


def _resolve(gone: DataFrame, known: DataFrame, kind: int, paths: bool) -> DataFrame:
    """Root, depth, size and cycle state of one round's removed nodes, from those of the nodes that went later."""
    above = known.select(
        F.col("v").alias("__p"), F.col("root").alias("__root"), F.col("depth").alias("__depth"),
        F.col("cyc").alias("__pcyc"), *([F.col("path").alias("__path"), F.col("turn").alias("__turn")] if paths else []),
    )
    hung = gone.join(above, F.col("p") == F.col("__p"))
    looped, total = F.lit(False), F.lit(0)
    if kind == _SPLICED:
        below = known.select(F.col("v").alias("__c"), F.col("total").alias("__total"), F.col("cyc").alias("__ccyc"))
        hung = hung.join(below, F.col("c") == F.col("__c"))
        looped, total = F.col("__ccyc") == 2, F.col("__total")
    depth = F.col("__depth") + F.col("w")
    return hung.select(
        "v",
        F.col("__root").alias("root"),
        depth.alias("depth"),
        F.when(looped, total).otherwise(F.col("base") + total).cast("long").alias("total"),
        F.when(looped, 2).when(F.col("__pcyc") > 0, 1).otherwise(0).alias("cyc"),
        # a loop is met at the parent's turn, as only loop nodes are spliced out of it
        *([F.concat("__path", "mid", F.array("v")).alias("path"), F.when(looped, depth).otherwise(F.col("__turn")).alias("turn")] if paths else []),
    )


def hierarchy(links: DataFrame, paths: bool = False) -> DataFrame:
    """Root, depth, subtree size and cycle state of every node of ``links`` (node, parent).

    Result: node, root, depth, impact_radius (other nodes that reach it), cyclic (2 on a loop, 1 if
    the way up ends in one, else 0), and with ``paths`` the nodes from the root down to this one.
    Where cyclic is not 0, root is empty, depth -1 and the path null; ``paths`` then gives instead
    ``way``, the nodes down from the core of the loop, and ``turn``, the steps of it that lie on the
    loop. ``links`` must have one row per node and no parent that is not a node (see
    ``current_parents``); an empty table gives no rows.
    """
    spark = links.sparkSession
    rounds = contract(links, paths)
    final = reread(spark, rounds[-1]).where(F.col("kind") == _ALIVE)
    done = [write_shared(_finish(final.select("v", "p", "w", "x", "sz", *(["mid"] if paths else [])), paths), "resolved")]
    for written in reversed(rounds[1:]):
        gone = reread(spark, written)
        # a spliced node's neighbours went later; a raked one's parent may have been spliced in its round
        for kind in (_SPLICED, _RAKED):
            done.append(write_shared(_resolve(gone.where(F.col("kind") == kind), reread(spark, *done), kind, paths), "resolved"))
    for written in rounds:
        drop_shared(spark, written)
    tree = F.col("cyc") == 0
    return reread(spark, *done).select(
        F.col("v").alias("node"),
        F.when(tree, F.col("root")).otherwise("").alias("root"),
        F.when(tree, F.col("depth")).otherwise(-1).cast("long").alias("depth"),
        (F.col("total") - 1).alias("impact_radius"),
        F.col("cyc").cast("long").alias("cyclic"),
        *([F.when(tree, F.col("path")).alias("path"), F.when(~tree, F.col("path")).alias("way"), F.when(~tree, F.col("turn")).alias("turn")] if paths else []),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs of an ancestor and another node below it, with the fewest steps between: from ``hierarchy(paths=True)``.

    Pairs per ancestor are its impact_radius. The output is the closure itself; each node's path is read
    once. Above a node on or below a loop come its way down from the loop's core and then, further up, the
    loop's members that the way leaves out: these are joined to it by core, one row a loop.
    """
    looped = tree.where("cyclic > 0").select("node", "cyclic", "way", "turn", F.col("way")[0].alias("core"))
    loops = looped.where("cyclic = 2").groupBy("core").agg(
        F.array_sort(F.collect_list(F.struct("turn", "node")))["node"].alias("members")
    )
    left_out = F.slice("members", F.col("turn").cast("int") + 2, F.size("members"))
    above = tree.where("path is not null").select("node", F.col("path").alias("above")).unionByName(
        looped.join(loops, "core").select("node", F.concat(left_out, "way").alias("above"))
    )
    up = above.select("node", F.size("above").alias("__n"), F.posexplode("above").alias("at", "ancestor"))
    return up.where("at < __n - 1").select("ancestor", F.col("node").alias("descendant"), (F.col("__n") - 1 - F.col("at")).cast("long").alias("steps"))
