"""Table access by name and the columns each table is expected to have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_per_id(df: DataFrame, *cols: str, id_col: str = "id", by: str = "loaded_at") -> DataFrame:
    """One row per id: the earliest loaded delivery, ties by the values themselves.

    Rows with a null id are dropped (they name no record). The aggregate is
    partial, so a heavily redelivered id costs one row per input partition.
    """
    keep = F.struct(F.coalesce(by, F.lit("9999-12-31").cast("timestamp")).alias("_at"), *[F.col(c) for c in cols])
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(keep).alias("_first"))
        .select(id_col, *[F.col(f"_first.{c}").alias(c) for c in cols])
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Top row per key by descending order columns (ties fall to the last column)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
