"""Tasks, results, knowledge and feedback as relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake import schemas
from tracewake.functions.text import clean_keywords
from tracewake.operators import shred
from tracewake.session import broadcast_if_small

PAGE = 20


def point_lookup(df: DataFrame, id_value: str, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == id_value)


def require(df: DataFrame, what: str) -> DataFrame:
    """The same rows; an error at the edge of the API when there are none."""
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df


def input_type(diff: Column, desc: Column, given: Column | None = None) -> Column:
    """The given type, else by which of the inputs are not empty."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    derived = F.when(has(diff) & has(desc), "combined").when(has(diff), "diff").otherwise("description")
    return derived if given is None else F.when(has(given), given).otherwise(derived)


def given_input_type(diff: Column, desc: Column) -> Column:
    """The rule of the command line: combined, unless there is no diff (description) or else no description (diff)."""
    return F.when(F.coalesce(diff, F.lit("")) == "", "description").when(F.coalesce(desc, F.lit("")) == "", "diff").otherwise("combined")


def cache_key(content: Column, paths: list[tuple[str, str]] | Column | None = None) -> Column:
    """SHA-256 over delimited content and (path, head) pairs, lower hex."""
    if isinstance(paths, Column):
        return F.sha2(F.concat_ws("\u001f", content, paths), 256)
    rest = [F.lit(x) for pair in paths or [] for x in pair]
    return F.sha2(F.concat_ws("\u001f", content, *rest), 256)


def new_tasks(df: DataFrame) -> DataFrame:
    """Rows to append: a random id, status pending, created now."""
    return df.select(
        F.uuid().alias("id"),
        input_type(F.col("input_diff"), F.col("input_desc")).alias("input_type"),
        "input_diff",
        "input_desc",
        cache_key(F.concat_ws("\u001f", F.coalesce("input_diff", F.lit("")), F.coalesce("input_desc", F.lit("")))).alias("cache_key"),
        F.lit("pending").alias("status"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def fold_status(events: DataFrame, key: str, seq: list[str], status: str = "status", at: str = "at") -> DataFrame:
    """Current status per key, and when it was last completed or failed (never cleared)."""
    done = F.col(status).isin("completed", "failed")
    return events.groupBy(key).agg(F.max_by(status, F.struct(*seq)).alias("status"), F.max(F.when(done, F.col(at))).alias("completed_at"))


def insert_if_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch to append: the first per key, of keys that don't exist yet.

    First writes are found by a partial minimum, so a hot key costs one row per partition.
    """
    rest = [c for c in batch.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    first = batch.groupBy(*keys).agg(F.min(row).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return first.alias("n").join(existing.select(*keys).alias("o"), same, "left_anti").select(*batch.columns)


def search(knowledge: DataFrame, keywords: list[str], commit: str | None = None, limit: int = 5) -> DataFrame:
    """Symbols beginning with, or summaries holding, any keyword; newest first, top limit.

    Percent and underscore in a keyword are wildcards. No keyword or limit below 1: nothing.
    """
    words = clean_keywords(keywords)
    if not words or limit <= 0:
        return knowledge.limit(0)
    hit = reduce(lambda a, b: a | b, [F.col("symbol").ilike(f"{w}%") | F.col("summary").ilike(f"%{w}%") for w in words])
    df = knowledge.where(hit if commit is None else hit & (F.col("commit_hash") == commit))
    return df.orderBy(F.col("created_at").desc(), "id", "loaded_at").limit(limit)


def mark_unreliable(knowledge: DataFrame, feedback: DataFrame, results: DataFrame) -> DataFrame:
    """Knowledge rows; unreliable also where a false positive's call chain, in any written form, names the symbol."""
    wrong = feedback.where(F.col("type") == "false_positive").select("task_id").distinct()
    named = shred.chain_nodes(results.join(wrong, "task_id", "left_semi")).select(F.col("repo").alias("_r"), F.col("symbol").alias("_s")).distinct()
    hit = named.withColumn("_hit", F.lit(True))
    out = knowledge.join(hit, (F.col("repo_name") == F.col("_r")) & (F.col("symbol") == F.col("_s")), "left")
    return out.withColumn("unreliable", F.coalesce("unreliable", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_r", "_s", "_hit")


def latest_result(results: DataFrame) -> DataFrame:
    """The newest result of each task; a partial maximum, no sort of a task's results."""
    cols = [c for c in results.columns if c not in ("task_id", "created_at", "id")]
    row = F.struct("created_at", "id", *cols)
    return results.groupBy("task_id").agg(F.max(row).alias("r")).select("task_id", F.col("r.created_at").alias("created_at"), F.col("r.id").alias("id"), *[F.col(f"r.{c}").alias(c) for c in cols])


def with_latest_result(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with their newest result, which shows only once the task is completed."""
    r = latest_result(results.select("task_id", "created_at", "id", "token_usage", "step_count")).select(
        F.col("task_id"), F.col("id").alias("result_id"), "token_usage", "step_count"
    )
    t = tasks.alias("t")
    return t.join(r.alias("r"), (F.col("t.id") == F.col("r.task_id")) & (F.col("t.status") == "completed"), "left").drop(F.col("r.task_id"))


def recent(tasks: DataFrame, limit: int = PAGE) -> DataFrame:
    """A page of the newest rows; below 1 means the default page."""
    return tasks.orderBy(F.col("created_at").desc(), "id", "loaded_at").limit(limit if limit > 0 else PAGE)


def accept_feedback(feedback: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): a listed type and an existing task are required."""
    valid = schemas.in_enum(F.col("type"), schemas.FEEDBACK_TYPES)
    known = tasks.select(F.col("id").alias("_t")).distinct()
    checked = feedback.join(known, F.col("task_id") == F.col("_t"), "left").withColumn("reason", F.when(~valid, "type").when(F.col("_t").isNull(), "task")).drop("_t")
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def new_feedback(feedback: DataFrame, tasks: DataFrame, knowledge: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append: a random id, created now, of what is accepted; knowledge as false positives among them leave it)."""
    accepted, _ = accept_feedback(feedback, tasks)
    rows = accepted.select(F.uuid().alias("id"), "task_id", "type", "comment", F.current_timestamp().alias("created_at"))
    return rows, mark_unreliable(knowledge, accepted, results)


def cascade(dependants: DataFrame, deleted: DataFrame, key: str = "task_id") -> DataFrame:
    """Dependants that remain when the given parents are gone."""
    return dependants.join(broadcast_if_small(deleted.select(key)), key, "left_anti")


def new_results(df: DataFrame) -> DataFrame:
    """Result rows to append; a task may have many. Missing counts are 0."""
    return df.select(
        F.uuid().alias("id"), "task_id", "call_chain", "test_scenarios", "entry_points",
        F.coalesce("token_usage", F.lit(0)).alias("token_usage"), F.coalesce("step_count", F.lit(0)).alias("step_count"), F.current_timestamp().alias("created_at"),
    )


def progress_rows(df: DataFrame) -> DataFrame:
    """Progress as stored: a missing list of nodes is an empty one."""
    return df.select("task_id", F.coalesce("current_step", F.lit(0)).alias("current_step"), F.coalesce("analyzed_nodes", F.array().cast("array<string>")).alias("analyzed_nodes"), "updated_at")


def repo_paths(names: DataFrame, repos: DataFrame, name: str = "repo_name") -> DataFrame:
    """Adds path: the repository's path, empty for an unknown one."""
    r = repos.select(F.col("repo_name").alias("_r"), F.col("repo_path").alias("_p")).groupBy("_r").agg(F.min("_p").alias("_p"))
    return names.join(broadcast_if_small(r), F.col(name) == F.col("_r"), "left").withColumn("path", F.coalesce("_p", F.lit(""))).drop("_r", "_p")


def insert_stream(stream: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str):
    """Starts a query that appends a stream's first writes to a table, batch by batch; failures are retried from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch.sparkSession.table(table), batch, keys, order).write.insertInto(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
