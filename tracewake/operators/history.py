"""History of changing entity attributes (problem 4).

Observations become a change log per attribute: an event whenever the attribute
differs from its previous observed value. Each attribute has its own intervals;
the entity's history is made by splitting at the union of all boundaries,
filling every attribute forward and coalescing neighbours that are equal. One
attribute goes the same way as many.

Hot entities (more than 1/HOT_KEYS of all rows) are cut into slices at the quantiles
of their own order, which is time, load time and row id, so that no task sorts one
entity whole, be all its rows at one time; the neighbours across slices come from a
small table of slice ends (at most HOT_KEYS x SLICES rows, hence a safe broadcast).

Nulls and edge cases: a null entity key is a key of its own; a null or blank
commit identifies only its own row id; rows without a time are left out; a null
or blank attribute is no observation; ties in time go to the earlier load, then
to the smaller row id; changes at one instant give versions of no length if there is
one attribute, and are one boundary, at which the last values hold, if there are
several; empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewake.operators.slices import MIN_HOT, same_keys, sliced
from tracewake.session import cut


def normal_text(c: Column) -> Column:
    """Case and amount of white space don't matter; null if blank."""
    flat = F.trim(F.regexp_replace(F.lower(c.cast("string")), r"(?U)\s+", " "))
    return F.when(flat != "", flat)


def first_of_commit(df: DataFrame, keys: list[str], attributes: list[str], commit: str, at: str, loaded: str, row_id: str) -> DataFrame:
    """Of the rows of one commit only the first loaded one counts."""
    norm = F.lower(F.regexp_replace(F.col(commit), r"(?U)^\s+|\s+$", ""))
    token = F.when(norm.isNull() | (norm == ""), F.concat(F.lit("id:"), F.coalesce(F.col(row_id), F.lit("")))).otherwise(norm)
    row = F.struct(
        F.coalesce(F.col(loaded), F.lit("9999-12-31").cast("timestamp")).alias("loaded"), F.col(row_id).alias("row_id"), F.col(at).alias("at"), *[F.col(a).alias(a) for a in attributes]
    )
    return (
        df.select(*keys, token.alias("_commit"), row.alias("_row"))
        .groupBy(*keys, "_commit")
        .agg(F.min("_row").alias("_row"))
        .select(*keys, F.col("_row.at").alias("at"), F.col("_row.loaded").alias("loaded"), F.col("_row.row_id").alias("row_id"), *[F.col(f"_row.{a}").alias(a) for a in attributes])
        .where(F.col("at").isNotNull())
    )


def _neighbour(df: DataFrame, keys: list[str], values: list[str], forward: bool, hot: bool, prefix: str) -> DataFrame:
    """Adds prefix+value of the previous (or next) row of the entity, across slices."""
    order = ["at", "loaded", "row_id"]
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    step = F.lead if forward else F.lag
    out = df.select("*", *[step(v).over(w).alias(prefix + v) for v in values], step(F.lit(1)).over(w).alias("_inside"))
    if not hot:
        return out.drop("_inside")
    ends = F.struct(*[F.col(c) for c in order], *[F.col(v).alias(f"v_{v}") for v in values])
    pick = F.min(ends) if forward else F.max(ends)
    border = df.where("slice > 0").groupBy(*keys, "slice").agg(pick.alias("e"))
    ws = Window.partitionBy(*keys).orderBy("slice")
    border = border.select(*keys, "slice", step("e").over(ws).alias("e"))
    cond = (F.col("l.slice") == F.col("r.slice")) & F.col("l._inside").isNull() & same_keys(keys)
    kept = [c for c in df.columns]
    return out.alias("l").join(F.broadcast(border.alias("r")), cond, "left").select(
        *[F.col(f"l.{c}") for c in kept],
        *[F.when(F.col("l._inside").isNull(), F.col(f"r.e.v_{v}")).otherwise(F.col(f"l.{prefix}{v}")).alias(prefix + v) for v in values],
    )


def change_log(obs: DataFrame, keys: list[str], attribute: str, normal: Column, hot: bool) -> DataFrame:
    """keys, slice, at, loaded, row_id, value for each change of one attribute."""
    seen = obs.select(*keys, "slice", "at", "loaded", "row_id", F.col(attribute).alias("value"), normal.alias("_n")).where(F.col("_n").isNotNull())
    return _neighbour(seen, keys, ["_n"], False, hot, "prev").where(~F.col("_n").eqNullSafe(F.col("prev_n"))).drop("prev_n")


def _none(obs: DataFrame, attribute: str) -> Column:
    return F.lit(None).cast(f"struct<value:{obs.schema[attribute].dataType.simpleString()},n:string>")


def history(
    df: DataFrame,
    keys: list[str],
    attributes: dict[str, Column],
    commit: str = "commit_hash",
    at: str = "created_at",
    loaded: str = "loaded_at",
    row_id: str = "id",
    min_hot: int = MIN_HOT,
) -> DataFrame:
    """keys, the attributes, valid_from, valid_to (null while current).

    attributes: name to normal form; a change is a change of the normal form.
    """
    names = list(attributes)
    order = ["at", "loaded", "row_id"]
    obs, hot = sliced(first_of_commit(df, keys, names, commit, at, loaded, row_id), keys, order, min_hot, df)
    if hot or len(names) > 1:  # read by every attribute's log and by the slices' ends
        obs = cut(obs)
    # union of boundaries: one event row per change, one column per attribute
    events = None
    for a in names:
        log = change_log(obs, keys, a, attributes[a], hot)
        part = log.select(*keys, "slice", *order, *[F.struct(F.col("value").alias("value"), F.col("_n").alias("n")).alias(f"e_{x}") if x == a else _none(obs, x).alias(f"e_{x}") for x in names])
        events = part if events is None else events.unionByName(part)
    merged = events.groupBy(*keys, "slice", *order).agg(*[F.first(f"e_{a}", ignorenulls=True).alias(f"e_{a}") for a in names])
    w = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = merged.select(*keys, "slice", *order, *[F.last(f"e_{a}", ignorenulls=True).over(w).alias(f"e_{a}") for a in names])
    if hot:  # values in force when a slice begins
        filled = cut(filled)
        last = filled.where("slice > 0").groupBy(*keys, "slice").agg(*[F.max_by(f"e_{a}", F.struct(*order)).alias(f"c_{a}") for a in names])
        before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = last.select(*keys, "slice", *[F.last(f"c_{a}", ignorenulls=True).over(before).alias(f"c_{a}") for a in names])
        cond = (F.col("l.slice") == F.col("r.slice")) & same_keys(keys)
        filled = filled.alias("l").join(F.broadcast(carry.alias("r")), cond, "left").select(*[F.col(f"l.{c}") for c in (*keys, "slice", *order)], *[F.coalesce(f"l.e_{a}", f"r.c_{a}").alias(f"e_{a}") for a in names])
    if len(names) > 1:  # boundaries of the same instant are one, at which the last values hold
        filled = _neighbour(filled.withColumn("_at", F.col("at")), keys, ["_at"], True, hot, "after").where(~F.col("_at").eqNullSafe(F.col("after_at"))).drop("_at", "after_at")
    # coalescing: a boundary at which nothing differs is none
    filled = filled.withColumn("_n", F.to_json(F.struct(*[F.col(f"e_{a}.n").alias(a) for a in names])))
    joined = _neighbour(filled, keys, ["_n"], False, hot, "prev").where(~F.col("_n").eqNullSafe(F.col("prev_n")))
    joined = joined.select(*keys, "slice", *order, *[F.col(f"e_{a}.value").cast("string").alias(a) for a in names])
    if hot:
        joined = cut(joined)
    closed = _neighbour(joined.withColumn("_at", F.col("at")), keys, ["_at"], True, hot, "next")
    return closed.select(*keys, *names, F.col("at").alias("valid_from"), F.col("next_at").alias("valid_to"))
