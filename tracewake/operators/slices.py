"""Hot keys cut into slices of their own order, so that no task sorts one key whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut

#: Keys above 1/HOT_KEYS of all rows are hot; there can be no more than HOT_KEYS of them.
HOT_KEYS = 512
SLICES = 64
#: Rows of one key below this are sorted in one task whatever their share.
MIN_HOT = 200_000


def same_keys(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Equality of all keys of two aliased sides; null equals null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def sliced(df: DataFrame, keys: list[str], order: list[str], min_hot: int = MIN_HOT, raw: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(df with slice, whether any key is hot): slice 0 for ordinary keys, 1.. along the order for hot ones.

    raw: cheaper rows to count the keys on, if there are any.
    """
    counts = (df if raw is None else raw).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    floor = max((top["total"] or 0) // HOT_KEYS, min_hot)
    if (top["most"] or 0) <= floor:
        return df.withColumn("slice", F.lit(0)), False
    hot = counts.where(F.col("n") > floor).select(*keys, F.lit(True).alias("hot"))
    df = cut(df)  # read for the edges and for the slices
    own = df.alias("l").join(F.broadcast(hot.alias("r")), same_keys(keys), "left_semi")
    row = F.struct(*order)
    out = (
        df.alias("l")
        .join(F.broadcast(_edges(own, keys, order).alias("r")), same_keys(keys), "left")
        .select("l.*", F.when(F.col("r.edges").isNull(), 0).otherwise(F.size(F.filter("r.edges", lambda e: e < row)) + 1).alias("slice"))
    )
    return out, True


def _edges(own: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, edges: rows of each hot key that cut its order into even slices, from a sample of at most 16 * SLICES rows by hash."""
    row = F.struct(*order)
    picked = own.groupBy(*keys, F.pmod(F.xxhash64(*order), F.lit(SLICES * 16)).alias("b")).agg(F.min_by(row, F.xxhash64(*order, F.lit(1))).alias("e"))
    step = F.greatest(F.floor(F.size("s") / SLICES), F.lit(1)).cast("int")
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("s")).select(*keys, F.array_distinct(F.filter("s", lambda e, i: (i + 1) % step == 0)).alias("edges"))
