"""References to records that do not exist (problem 1).

Parent keys, deletions and child references are put into one long form of tagged
keys and grouped once by (parent table, key). Child references enter it already
counted per (child table, period), with the span of their load times, so a group has
at most one entry a child table and period however hot its key is. A group stays
when it has no parent, when its parent is deleted, or when some child was loaded
before the parent. Counts are sums over the groups' entries; only entries whose
span straddles the parent's load time are counted row by row. The single rows come
from a join of the children with the groups that stayed, in which hot keys are salted.

Nulls and edge cases: a null or blank reference is no reference; text that is no
UUID is an orphan of its own; a null id is no row; of a row delivered again the
delivery loaded first counts, ties by the smaller reference, none first; a null load time
counts as never loaded (a child without one is not "before" its parent); a null
date counts under a null period; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut

UUID_FORM = r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"
#: At most so many keys are treated as hot; with a share above 1/HOT_KEYS each there can be no more.
HOT_KEYS = 512
SALTS = 32
#: References of one key below this are joined in one task whatever their share.
MIN_HOT = 1000
NEVER = "9999-12-31"


def reference_key(c: Column) -> Column:
    """Canonical key: 32 hex digits of a UUID, '!' and the text otherwise, null if blank."""
    flat = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    hexes = F.regexp_replace(flat, UUID_FORM, "$1$2$3$4$5")
    return F.when(flat.isNull() | (flat == ""), None).when(flat.rlike(UUID_FORM), hexes).otherwise(F.concat(F.lit("!"), flat))


def _children(name: str, df: DataFrame, parent: str, ref: str, row_id: str, loaded: str, period: str) -> DataFrame:
    """One row per row id with its key, its earliest load and its month."""
    at = F.coalesce(F.col(loaded), F.lit(NEVER).cast("timestamp"))
    first = F.min(F.struct(at.alias("at"), reference_key(F.col(ref)).alias("key"), F.col(period).alias("period"))).alias("first")
    return (
        df.where(F.col(row_id).isNotNull())
        .groupBy(F.col(row_id).alias("row_id"))
        .agg(first)
        .where("first.key IS NOT NULL")
        .select(
            F.lit(name).alias("source_table"), F.lit(parent).alias("parent_table"), "row_id", F.col("first.key").alias("key"),
            F.when(F.col("first.at") < F.lit(NEVER).cast("timestamp"), F.col("first.at")).alias("at"), F.date_format("first.period", "yyyy-MM").alias("period"),
        )
    )


def children_of(tables: Mapping[str, DataFrame], parent: str = "tasks", ref: str = "task_id", row_id: str = "id", loaded: str = "loaded_at", period: str = "created_at") -> DataFrame:
    """References of several tables to one parent table; unions of these serve several parents. Written once, as both uses read it."""
    parts = [_children(name, df, parent, ref, row_id, loaded, period) for name, df in tables.items()]
    return cut(reduce(DataFrame.unionByName, parts))


def parents_of(parent: DataFrame, deletions: DataFrame, name: str = "tasks", parent_id: str = "id", loaded: str = "loaded_at", deletion_id: str = "task_id", restored: str = "restored_at") -> DataFrame:
    """parent_table, key, parent_at, is_parent, is_deleted: the parents' side of the long form."""
    tag = lambda live: (F.lit(int(live)).alias("is_parent"), F.lit(int(not live)).alias("is_deleted"))
    live = parent.select(F.lit(name).alias("parent_table"), reference_key(F.col(parent_id)).alias("key"), F.col(loaded).alias("parent_at"), *tag(True))
    gone = deletions.where(F.col(restored).isNull()).select(F.lit(name).alias("parent_table"), reference_key(F.col(deletion_id)).alias("key"), F.lit(None).cast("timestamp").alias("parent_at"), *tag(False))
    return live.unionByName(gone).where(F.col("key").isNotNull())


def orphan_groups(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parent_table, key, is_parent, is_deleted, parent_at, entries of every group with an orphan.

    entries: source_table, period, n, timed (with a load time), lo and hi load time.
    """
    counted = children.groupBy("parent_table", "key", "source_table", "period").agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("timed"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    entry = F.struct("source_table", "period", "n", "timed", "lo", "hi")
    tagged = counted.select("parent_table", "key", F.lit(None).cast("timestamp").alias("parent_at"), F.lit(0).alias("is_parent"), F.lit(0).alias("is_deleted"), entry.alias("entry"))
    long = parents.withColumn("entry", F.lit(None).cast(tagged.schema["entry"].dataType)).unionByName(tagged)
    grouped = long.groupBy("parent_table", "key").agg(
        F.min("parent_at").alias("parent_at"), F.max("is_parent").alias("is_parent"), F.max("is_deleted").alias("is_deleted"), F.collect_list("entry").alias("entries")
    )
    late = F.exists("entries", lambda e: e["lo"] < F.col("parent_at"))
    return grouped.where((F.size("entries") > 0) & ((F.col("is_parent") == 0) | (F.col("is_deleted") == 1) | F.coalesce(late, F.lit(False))))


def _reason(at: Column) -> Column:
    return F.when(F.col("is_parent") == 0, "missing").when(F.col("is_deleted") == 1, "deleted").when(F.col("parent_at") > at, "late")


def orphan_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """source_table, period, reason, orphans, summed from the groups' entries."""
    groups = cut(orphan_groups(parents, children))
    each = groups.select("parent_table", "key", "parent_at", "is_parent", "is_deleted", F.inline("entries"))
    whole = each.withColumn("reason", _reason(F.col("hi"))).where("reason IS NOT NULL")
    sums = whole.select("source_table", "period", "reason", F.when(F.col("reason") == "late", F.col("timed")).otherwise(F.col("n")).alias("n"))
    # loads on both sides of the parent's: the rows decide
    mixed = each.where((F.col("is_parent") == 1) & (F.col("is_deleted") == 0) & (F.col("lo") < F.col("parent_at")) & (F.col("hi") >= F.col("parent_at"))).select("parent_table", "key", "source_table", "period", "parent_at")
    c, m = children.alias("c"), mixed.alias("m")
    same = [F.col(f"c.{k}") == F.col(f"m.{k}") for k in ("parent_table", "key", "source_table")] + [F.col("c.period").eqNullSafe(F.col("m.period")), F.col("c.at") < F.col("m.parent_at")]
    rows = c.join(m, reduce(lambda a, b: a & b, same), "left_semi").groupBy("source_table", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("late"))
    return sums.unionByName(rows).groupBy("source_table", "period", "reason").agg(F.sum("n").alias("orphans"))


def orphan_rows(parents: DataFrame, children: DataFrame) -> DataFrame:
    """source_table, row_id, key, period, reason for every orphan reference.

    Keys above 1/HOT_KEYS of all references of the groups (so at most HOT_KEYS of
    them) are spread over SALTS partitions.
    """
    n = F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    groups = cut(orphan_groups(parents, children).select("parent_table", "key", "parent_at", "is_parent", "is_deleted", n.alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    on = ["parent_table", "key"]
    hot = groups.where(F.col("n") > F.lit(max(total // HOT_KEYS, MIN_HOT))).select(*on, F.lit(True).alias("hot"))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    keyed = groups.join(F.broadcast(hot), on, "left").withColumn("salt", salts).select(*on, "salt", "is_parent", "is_deleted", "parent_at")
    salted = children.join(F.broadcast(hot), on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    out = salted.join(keyed, [*on, "salt"]).withColumn("reason", _reason(F.col("at")))
    return out.where(F.col("reason").isNotNull()).select("source_table", "row_id", "key", "period", "reason")
