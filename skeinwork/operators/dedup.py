"""Messages delivered more than once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY, _RANK = "__skein_key", "__skein_rank"


def hex_identity(ident: Column, digits: int = 32) -> Column:
    """The hexadecimal digits of an identifier in lower case; null unless there are exactly ``digits``.

    Case, hyphens, braces, blanks and line ends do not distinguish identifiers.
    """
    bare = F.lower(F.regexp_replace(ident, "[^0-9a-fA-F]", ""))
    return F.when(F.length(bare) == digits, bare)


def keep_first(messages: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must end in a unique column.

    A row with a null in any key column is no copy of anything and is kept. The rank-one filter
    becomes a group limit that Spark runs before the shuffle as well as after it, so a map task sends
    one row per key; a message with a third of all copies costs the reducer one row per map task.
    An empty input gives an empty output; extra columns pass through unchanged.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & k.isNotNull()
    keyed = messages.withColumn(_KEY, F.when(whole, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])))
    ranked = (
        keyed.where(F.col(_KEY).isNotNull())
        .withColumn(_RANK, F.row_number().over(Window.partitionBy(_KEY).orderBy(*order)))
        .where(F.col(_RANK) == 1)
    )
    return ranked.drop(_KEY, _RANK).unionByName(keyed.where(F.col(_KEY).isNull()).drop(_KEY))


def message_order() -> list[Column]:
    """Arrival order of a usage message: collected seconds, nanoseconds (nulls last), then delivery."""
    return [F.col("coll_s").asc_nulls_last(), F.col("coll_ns").asc_nulls_last(), F.col("delivery_id").asc()]


def message_key() -> list[Column]:
    return [hex_identity(F.col("id")), F.col("event")]


def kept_deliveries(usage: DataFrame) -> DataFrame:
    """The deliveries of usage messages that are kept."""
    return keep_first(usage, message_key(), message_order())


def dropped_deliveries(usage: DataFrame) -> DataFrame:
    """``delivery_id`` of each delivery that is not kept.

    The anti-join runs on the unique delivery number, so no message's copies meet in one task.
    """
    slim = usage.select("delivery_id", "id", "event", "coll_s", "coll_ns")
    return slim.select("delivery_id").join(kept_deliveries(slim).select("delivery_id"), "delivery_id", "left_anti")


def accept_batch(batch: DataFrame, stored: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The rows of a new batch to store: first copies whose key is not among ``stored`` keys.

    ``stored`` has the key columns ``k0, k1, ...`` of what was kept before (see ``stored_keys``). Copies
    inside the batch are ranked away first, so the anti-join sees one row per key on either side.
    """
    first = keep_first(batch, key, order)
    named = first
    for i, k in enumerate(key):
        named = named.withColumn(f"__skein_k{i}", k)
    cond = [F.col(f"__skein_k{i}") == stored[f"k{i}"] for i in range(len(key))]
    return named.join(stored, cond, "left_anti").drop(*[f"__skein_k{i}" for i in range(len(key))])


def stored_keys(kept: DataFrame, key: list[Column]) -> DataFrame:
    return kept.select(*[k.alias(f"k{i}") for i, k in enumerate(key)]).na.drop()
