"""Queries over tasks, results, knowledge, feedback and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewake import schemas
from tracewake.operators import metrics, store
from tracewake.plans.general import STEP
from tracewake.sources import workspace
from tracewake.sources.tables import first_per_id, table
from tracewake.streaming import state


def order_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.point_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 42, "o_orderkey")


def new_task_fields(spark: SparkSession, d: str) -> DataFrame:
    t = first_per_id(table(spark, d, "analysis_tasks"), "input_diff", "input_desc")
    content = F.concat_ws("\u001f", F.coalesce("input_diff", F.lit("")), F.coalesce("input_desc", F.lit("")))
    return t.select("id", store.input_type(F.col("input_diff"), F.col("input_desc")).alias("input_type"), store.cache_key(content).alias("cache_key"))


def recent_tasks(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(table(spark, d, "analysis_tasks").select("id", "status", "created_at", "loaded_at"), 0)


def status_fold(spark: SparkSession, d: str) -> DataFrame:
    return store.fold_status(table(spark, d, "analysis_tasks").withColumn("at", F.col("loaded_at")), "id", ["loaded_at", "status"])


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "knowledge_base").select("repo_name", "symbol", "commit_hash", "loaded_at", "id")
    old = F.col("loaded_at") < F.lit("2025-03-01").cast("timestamp")
    return store.insert_if_absent(kb.where(old), kb.where(~old), ["repo_name", "symbol", "commit_hash"], ["loaded_at", "id"])


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "knowledge_base").select("id", "repo_name", "symbol", "summary", "commit_hash", "created_at", "loaded_at")
    return store.search(kb, ["parcel", " retries ", "", "ledger%drain"], None, 20)


def keyword_search_commit(spark: SparkSession, d: str) -> DataFrame:
    """As of one commit: the most frequent one, the smaller of equals."""
    kb = table(spark, d, "knowledge_base").select("id", "repo_name", "symbol", "summary", "commit_hash", "created_at", "loaded_at")
    commit = kb.where("commit_hash IS NOT NULL").groupBy("commit_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "commit_hash").first()[0]
    return store.search(kb, ["e", "a"], commit, 20)


def cli_input_types(spark: SparkSession, d: str) -> DataFrame:
    t = first_per_id(table(spark, d, "analysis_tasks"), "input_diff", "input_desc")
    return t.select("id", store.given_input_type(F.col("input_diff"), F.col("input_desc")).alias("input_type"))


def feedback_inserts(spark: SparkSession, d: str) -> DataFrame:
    """What is appended, and how many knowledge rows it leaves unreliable."""
    rows, knowledge = store.new_feedback(table(spark, d, "feedback"), table(spark, d, "analysis_tasks"), table(spark, d, "knowledge_base"), table(spark, d, "analysis_results"))
    kinds = rows.groupBy("type").agg(F.count("id").alias("n"))
    return kinds.unionByName(knowledge.agg(F.count_if("unreliable").alias("n")).withColumn("type", F.lit("unreliable symbols' rows")))


def cache_deleted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", (F.col("event_type") == "error").alias("gone"))
    return state.current(state.written(e), "k", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), deleted="gone").select("k", "event_id")


def mark_unreliable(spark: SparkSession, d: str) -> DataFrame:
    out = store.mark_unreliable(table(spark, d, "knowledge_base"), table(spark, d, "feedback"), table(spark, d, "analysis_results"))
    return out.groupBy("repo_name", "symbol", "unreliable").agg(F.count(F.lit(1)).alias("n"))


def latest_result(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "analysis_results").select("task_id", "created_at", "id", "token_usage", "step_count")
    return store.latest_result(r)


def tasks_with_result(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "analysis_tasks").select("id", "status").distinct()
    return store.with_latest_result(t, table(spark, d, "analysis_results"))


def feedback_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").select("id", "task_id", "type", "comment", "created_at", "loaded_at").orderBy("created_at", "id", "loaded_at")


def feedback_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = store.accept_feedback(table(spark, d, "feedback"), table(spark, d, "analysis_tasks"))
    return rejected.select("id", "task_id", "type", "reason")


def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    bad = schemas.violations(table(spark, d, "analysis_tasks"), {"input_type": schemas.INPUT_TYPES, "status": schemas.STATUSES}, ("id", "created_at"))
    return bad.select("id", "loaded_at", F.array_join("violations", ",").alias("violations"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "task_deletions").where("restored_at IS NULL AND task_id IS NOT NULL")
    return store.cascade(table(spark, d, "analysis_results").select("id", "task_id", "created_at"), gone)


def status_counter(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counter(table(spark, d, "analysis_tasks"), "status")


def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "analysis_results"), "token_usage", metrics.TOKEN_BOUNDS)


def step_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "analysis_results"), "step_count", metrics.STEP_BOUNDS)


def false_positive_rate(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback").where(schemas.in_enum(F.col("type"), schemas.FEEDBACK_TYPES))
    return metrics.share(f, F.col("type") == "false_positive").select(F.round("ratio", 9).alias("ratio"), "n")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("probe_id"), "event_type")
    return state.cache_hits(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "k")


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("probe_id", "k", "hit")


def cache_hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    return metrics.share(_hits(spark, d), F.col("hit")).select(F.round("ratio", 9).alias("ratio"), "n")


def cache_current(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", "event_type")
    return state.current(state.written(e), "k", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).select("k", "event_id", "event_type")


def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = first_per_id(table(spark, d, "analysis_tasks"), "created_at", "cache_key")
    r = first_per_id(table(spark, d, "analysis_results"), "created_at", "step_count", "token_usage")
    hits = t.select(F.to_date("created_at").alias("date"), F.col("cache_key").isNotNull().alias("hit"))
    return metrics.daily(t, r, hits)


def repo_heads(spark: SparkSession, d: str) -> DataFrame:
    return workspace.heads(table(spark, d, "knowledge_base"), table(spark, d, "repos"))


def result_fields(spark: SparkSession, d: str) -> DataFrame:
    new = store.new_results(table(spark, d, "analysis_results"))
    return new.groupBy("task_id").agg(F.sum("token_usage").alias("tokens"), F.sum("step_count").alias("steps"), F.count("id").alias("n"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 100).alias("current_step"), F.when(F.col("event_id") % 3 > 0, F.array("event_type")).alias("analyzed_nodes"), F.col("ts").alias("updated_at"))
    rows = state.written(store.progress_rows(e), "updated_at", state.PROGRESS_HOURS)
    now = state.current(rows, "task_id", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "updated_at")
    return now.select("task_id", "current_step", F.array_join("analyzed_nodes", ",").alias("nodes"))


def repo_paths(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select("repo_name").distinct()
    return store.repo_paths(names, table(spark, d, "repos"))


QUERIES = {
    f.__name__: f
    for f in (
        order_lookup, new_task_fields, recent_tasks, status_fold, insert_if_absent, keyword_search, keyword_search_commit, cli_input_types, feedback_inserts, cache_deleted, mark_unreliable, latest_result, tasks_with_result, feedback_list, feedback_rejects,
        enum_violations, cascade_delete, status_counter, token_histogram, step_histogram, false_positive_rate, cache_probe, cache_hit_ratio, cache_current, daily_metrics, repo_heads, result_fields, progress, repo_paths,
    )
}


def _histogram(c: str, bounds: tuple[int, ...]) -> str:
    rows = " UNION ALL ".join([f"SELECT '{b}' AS le, count(*) FILTER ({c} <= {b}) AS n, count({c}) AS total, coalesce(sum({c}), 0)::BIGINT AS sum_value FROM analysis_results" for b in bounds])
    return f"{rows} UNION ALL SELECT '+Inf', count({c}), count({c}), coalesce(sum({c}), 0)::BIGINT FROM analysis_results"


_HITS = "SELECT v.event_id AS probe_id, cast(v.user_id AS VARCHAR) AS k, EXISTS (SELECT 1 FROM events w WHERE w.event_type = 'purchase' AND w.user_id = v.user_id AND w.ts <= v.ts AND (w.ts < v.ts OR true) AND w.ts + INTERVAL 72 HOUR > v.ts) AS hit FROM events v WHERE v.event_type = 'view'"
_LATEST = "SELECT task_id, created_at, id, token_usage, step_count FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC NULLS LAST, id DESC, token_usage DESC NULLS LAST, step_count DESC NULLS LAST) AS r FROM analysis_results) WHERE r = 1"
_CK = "substr(sha256(concat_ws(chr(31), coalesce(input_diff, ''), coalesce(input_desc, ''))), 1)"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS r FROM {t} WHERE id IS NOT NULL) WHERE r = 1)"
_MARKED = """r AS (SELECT task_id, CASE WHEN json_valid(call_chain) THEN call_chain::JSON END AS c FROM analysis_results WHERE task_id IN (SELECT task_id FROM {fp} WHERE type = 'false_positive')), r1 AS (SELECT STEP AS c FROM r), r2 AS (SELECT STEP AS c FROM r1), r3 AS (SELECT STEP AS c FROM r2), n AS (SELECT unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN json_extract(c, '$.downward_chain.nodes[*]') END) AS e FROM r3), s AS (SELECT DISTINCT coalesce(e ->> '$.repo', e ->> '$.Repo') AS r, coalesce(e ->> '$.func_name', e ->> '$.Function', e ->> '$.symbol') AS s FROM n)""".replace("STEP", STEP.format(x="c"))

SQL = {
    "result_fields": "SELECT task_id, sum(coalesce(token_usage, 0))::BIGINT AS tokens, sum(coalesce(step_count, 0))::BIGINT AS steps, count(*) AS n FROM analysis_results GROUP BY task_id",
    "progress": "SELECT task_id, current_step, nodes FROM (SELECT user_id AS task_id, CASE WHEN event_id % 7 > 0 THEN event_id % 100 ELSE 0 END AS current_step, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS nodes, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE r = 1 AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 00:00:00'",
    "repo_paths": "SELECT n.repo_name, coalesce(r.repo_path, '') AS path FROM (SELECT DISTINCT repo_name FROM documents) n LEFT JOIN repos r ON r.repo_name = n.repo_name",
    "order_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42",
    "new_task_fields": f"SELECT id, CASE WHEN coalesce(input_diff, '') <> '' AND coalesce(input_desc, '') <> '' THEN 'combined' WHEN coalesce(input_diff, '') <> '' THEN 'diff' ELSE 'description' END AS input_type, {_CK} AS cache_key FROM {_FIRST.format(t='analysis_tasks')}",
    "recent_tasks": "SELECT id, status, created_at, loaded_at FROM analysis_tasks ORDER BY created_at DESC, id, loaded_at LIMIT 20",
    "status_fold": "SELECT id, arg_max(status, loaded_at) AS status, max(loaded_at) FILTER (status IN ('completed', 'failed')) AS completed_at FROM analysis_tasks GROUP BY id",
    "insert_if_absent": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY repo_name, symbol, commit_hash ORDER BY loaded_at, id) AS r FROM knowledge_base WHERE loaded_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00') SELECT repo_name, symbol, commit_hash, loaded_at, id FROM b WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM knowledge_base k WHERE k.loaded_at < TIMESTAMPTZ '2025-03-01 00:00:00+00' AND k.repo_name IS NOT DISTINCT FROM b.repo_name AND k.symbol IS NOT DISTINCT FROM b.symbol AND k.commit_hash IS NOT DISTINCT FROM b.commit_hash)",
    "keyword_search": "SELECT id, repo_name, symbol, summary, commit_hash, created_at, loaded_at FROM knowledge_base WHERE "
    + " OR ".join(f"symbol ILIKE '{w}%' OR summary ILIKE '%{w}%'" for w in ("parcel", "retries", "ledger%drain"))
    + " ORDER BY created_at DESC, id, loaded_at LIMIT 20",
    "keyword_search_commit": "WITH c AS (SELECT commit_hash AS h FROM knowledge_base WHERE commit_hash IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, repo_name, symbol, summary, commit_hash, created_at, loaded_at FROM knowledge_base WHERE commit_hash = (SELECT h FROM c) AND (symbol ILIKE 'e%' OR symbol ILIKE 'a%' OR summary ILIKE '%e%' OR summary ILIKE '%a%') ORDER BY created_at DESC, id, loaded_at LIMIT 20",
    "cli_input_types": f"SELECT id, CASE WHEN coalesce(input_diff, '') = '' THEN 'description' WHEN coalesce(input_desc, '') = '' THEN 'diff' ELSE 'combined' END AS input_type FROM {_FIRST.format(t='analysis_tasks')}",
    "cache_deleted": "SELECT k, event_id FROM (SELECT user_id AS k, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00') WHERE r = 1 AND ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-25 00:00:00' AND event_type <> 'error'",
    "feedback_inserts": f"WITH a AS (SELECT * FROM feedback WHERE type IN ('false_positive', 'false_negative', 'correct') AND task_id IN (SELECT id FROM analysis_tasks)), {_MARKED.format(fp='a')} SELECT type, count(*) AS n FROM a GROUP BY type UNION ALL SELECT 'unreliable symbols'' rows', count(*) FROM knowledge_base k LEFT JOIN s ON k.repo_name = s.r AND k.symbol = s.s WHERE coalesce(unreliable, false) OR s.s IS NOT NULL",
    "mark_unreliable": f"WITH {_MARKED.format(fp='feedback')} SELECT repo_name, symbol, coalesce(unreliable, false) OR s.s IS NOT NULL AS unreliable, count(*) AS n FROM knowledge_base k LEFT JOIN s ON k.repo_name = s.r AND k.symbol = s.s GROUP BY ALL",
    "latest_result": _LATEST,
    "tasks_with_result": f"SELECT t.id, t.status, l.id AS result_id, l.token_usage, l.step_count FROM (SELECT DISTINCT id, status FROM analysis_tasks) t LEFT JOIN ({_LATEST}) l ON t.id = l.task_id AND t.status = 'completed'",
    "feedback_list": "SELECT id, task_id, type, comment, created_at, loaded_at FROM feedback",
    "feedback_rejects": "SELECT id, task_id, type, CASE WHEN coalesce(type, '') NOT IN ('false_positive', 'false_negative', 'correct') THEN 'type' ELSE 'task' END AS reason FROM feedback WHERE coalesce(type, '') NOT IN ('false_positive', 'false_negative', 'correct') OR task_id IS NULL OR task_id NOT IN (SELECT id FROM analysis_tasks WHERE id IS NOT NULL)",
    "enum_violations": "SELECT * FROM (SELECT id, loaded_at, concat_ws(',', CASE WHEN coalesce(input_type, '') NOT IN ('diff', 'description', 'combined') THEN 'input_type' END, CASE WHEN coalesce(status, '') NOT IN ('pending', 'running', 'completed', 'failed') THEN 'status' END, CASE WHEN id IS NULL THEN 'id' END, CASE WHEN created_at IS NULL THEN 'created_at' END, CASE WHEN length(cache_key) > 64 THEN 'cache_key' END) AS violations FROM analysis_tasks) WHERE violations <> ''",
    "cascade_delete": "SELECT id, task_id, created_at FROM analysis_results WHERE task_id IS NULL OR task_id NOT IN (SELECT task_id FROM task_deletions WHERE restored_at IS NULL AND task_id IS NOT NULL)",
    "status_counter": "SELECT status, count(*) AS n FROM analysis_tasks GROUP BY status",
    "token_histogram": _histogram("token_usage", metrics.TOKEN_BOUNDS),
    "step_histogram": _histogram("step_count", metrics.STEP_BOUNDS),
    "false_positive_rate": "SELECT round(avg(CASE WHEN type = 'false_positive' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS ratio, count(*) AS n FROM feedback WHERE type IN ('false_positive', 'false_negative', 'correct')",
    "cache_probe": _HITS,
    "cache_hit_ratio": f"SELECT round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS ratio, count(*) AS n FROM ({_HITS})",
    "cache_current": "SELECT k, event_id, event_type FROM (SELECT user_id AS k, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00') WHERE r = 1 AND ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-25 00:00:00'",
    "daily_metrics": f"WITH t AS {_FIRST.format(t='analysis_tasks')}, r AS {_FIRST.format(t='analysis_results')}, a AS (SELECT cast(created_at AS DATE) AS date, cast(count(*) AS INT) AS total_tasks, cast(avg(CASE WHEN cache_key IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DECIMAL(5,4)) AS cache_hit_rate FROM t GROUP BY 1), b AS (SELECT cast(created_at AS DATE) AS date, cast(avg(step_count) AS DECIMAL(10,2)) AS avg_steps, cast(avg(token_usage) AS DECIMAL(10,2)) AS avg_tokens FROM r GROUP BY 1) SELECT a.date, total_tasks, avg_steps, avg_tokens, cache_hit_rate FROM a LEFT JOIN b ON a.date = b.date",
    "repo_heads": "WITH h AS (SELECT repo_name, commit_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC, commit_hash DESC) AS r FROM knowledge_base WHERE coalesce(trim(commit_hash), '') <> '') WHERE r = 1) SELECT r.repo_name, commit_hash, CASE WHEN commit_hash IS NULL THEN 'no snapshot' END AS error FROM (SELECT DISTINCT repo_name FROM repos) r LEFT JOIN h ON h.repo_name = r.repo_name",
}
