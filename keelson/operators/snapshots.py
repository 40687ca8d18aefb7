"""What changed between consecutive full snapshots, by multiset difference.

Each snapshot is brought to one row for each asset in one way of writing. EXCEPT ALL both ways drops what is the same in both,
and only the residues, as large as the change, are joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.dims import PREFIX
from keelson.session import materialised

#: The properties that a comparison of two inventories tracks.
TRACKED = ("confidence", "surfaces", "collectors", "quantum-status", "classical-status", "corroborated")


def plain_ref(c: Column) -> Column:
    """The 16 lower-case hex digits of a reference, or null if it has none: spaces, case and a urn or other prefix are ways to write."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\"'{<]+|[\s\"'}>]+$", ""))
    bare = F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+._-]*[:#/])+", "")
    return F.when(bare.rlike("^[0-9a-f]{16}$"), bare)


def plain_property(name: str, c: Column) -> Column:
    """A property in one way of writing; blank is absent. Numbers by value, lists as sets, words without case and spaces."""
    bare = F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
    if name == "confidence":
        return F.coalesce(F.round(bare.try_cast("double"), 9).cast("string"), bare)
    if name in ("surfaces", "collectors"):
        items = F.filter(F.transform(F.split(F.regexp_replace(bare, r"[\[\]\"']", ""), r"[,;|/\s]+"), F.trim), lambda x: x != "")
        return F.nullif(F.array_join(F.array_sort(F.array_distinct(items)), ","), F.lit(""))
    if name == "corroborated":
        return F.when(bare.isin("true", "yes", "1"), "true").when(bare.isin("false", "no", "0"), "false").otherwise(bare)
    return F.regexp_replace(bare, r"[\s_]+", "-")


def valid_rows(components: DataFrame, tracked: Sequence[str] = TRACKED) -> DataFrame:
    """snapshot_no, bom_ref and the tracked properties: of each asset of a snapshot the row delivered last.

    Rows without a snapshot or a plain reference don't count. Of rows delivered at the same time the one whose properties sort last
    is valid, so that the result doesn't depend on the rows' order; a missing delivery time is the earliest.
    """
    names = [_column(t) for t in tracked]
    rows = components.select("snapshot_no", plain_ref(F.col("bom_ref")).alias("bom_ref"), "delivered_at", *[plain_property(t, F.try_element_at("properties", F.lit(PREFIX + t))).alias(n) for t, n in zip(tracked, names)])
    rows = rows.filter("snapshot_no IS NOT NULL AND bom_ref IS NOT NULL")
    last = rows.groupBy("snapshot_no", "bom_ref").agg(F.max(F.struct("delivered_at", *names)).alias("v"))
    return last.select("snapshot_no", "bom_ref", *[F.col(f"v.{n}").alias(n) for n in names])


def _column(name: str) -> str:
    return name.replace("-", "_")


def snapshot_changes(components: DataFrame, tracked: Sequence[str] = TRACKED) -> DataFrame:
    """snapshot_no, bom_ref, change_kind, changes: each snapshot that has a predecessor (its number less one) against it.

    changes is an array of (key, before, after): of a changed asset what differs, of the others what they state. A snapshot of
    which no row has a plain reference is no snapshot.
    """
    names = [_column(t) for t in tracked]
    rows = materialised(valid_rows(components, tracked))  # compared with itself four times
    numbers = rows.select("snapshot_no").distinct()
    compared = numbers.join(numbers.select((F.col("snapshot_no") + 1).alias("snapshot_no")), "snapshot_no", "left_semi")
    now = rows.join(compared, "snapshot_no", "left_semi")
    before = rows.withColumn("snapshot_no", F.col("snapshot_no") + 1).join(compared, "snapshot_no", "left_semi")
    came, went = now.exceptAll(before), before.exceptAll(now)
    a = came.select("snapshot_no", "bom_ref", F.struct(*names).alias("new"))
    b = went.select("snapshot_no", "bom_ref", F.struct(*names).alias("old"))
    both = a.join(b, ["snapshot_no", "bom_ref"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    items = F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"old.{n}").alias("before"), F.col(f"new.{n}").alias("after")) for t, n in zip(tracked, names)])
    return both.select("snapshot_no", "bom_ref", kind.alias("change_kind"), F.filter(items, lambda x: ~x["before"].eqNullSafe(x["after"])).alias("changes"))
