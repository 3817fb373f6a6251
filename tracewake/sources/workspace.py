"""Source trees, diff files and repository snapshots as tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewake.functions.text import relative_path


def _path_of(uri: Column) -> Column:
    """The path of a local file URI, with one slash or three."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, "^file:(?://(?=/))?", ""), r"\+", "%2B"))


def files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path (relative to root), content of every file; directories that begin with a dot are skipped."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = relative_path(_path_of(F.col("_metadata.file_path")), root)
    out = raw.select(path.alias("path"), F.col("value").alias("content"))
    return out if hidden else out.where(~F.col("path").rlike(r"(?:^|/)\.[^/]+/"))


def diff_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row: the files' texts in the given order, a line feed after each."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("uri"), "value").withColumn("p", _path_of(F.col("uri")))
    at = F.coalesce(*[F.when((F.col("uri") == p) | (F.col("p") == (os.path.abspath(p) if "://" not in p else p)), i) for i, p in enumerate(paths)])
    parts = F.array_sort(F.collect_list(F.struct(at.alias("i"), "value")))
    return raw.agg(F.concat(F.array_join(F.transform(parts, lambda x: x["value"]), "\n"), F.lit("\n")).alias("diff"))


def heads(snapshots: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_name, commit_hash of each repository's newest snapshot, or an error text. snapshots: repo_name, commit_hash, created_at."""
    last = snapshots.where(F.coalesce(F.trim("commit_hash"), F.lit("")) != "").groupBy("repo_name").agg(F.max_by("commit_hash", F.struct("created_at", "commit_hash")).alias("commit_hash"))
    return repos.select("repo_name").distinct().join(last, "repo_name", "left").select("repo_name", "commit_hash", F.when(F.col("commit_hash").isNull(), "no snapshot").alias("error"))
