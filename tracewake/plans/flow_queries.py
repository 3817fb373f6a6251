"""Queries over conversations, call graphs, reports and keyed state.

The tables hold no conversations, so events stand in: a user's events in id order
are messages; purchases speak as the assistant, views and clicks as tools, the
rest as the user. Line items stand in for call edges: the parts of consecutive
lines of one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewake import schemas
from tracewake.operators import context, graph, report, shred
from tracewake.plans.general import STEP
from tracewake.sources.tables import first_per_id, table
from tracewake.streaming import state

TOOLS = ("search", "read", "glob")


def messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "purchase", "assistant").when(F.col("event_type").isin("view", "click"), "tool").otherwise("user")
    return table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), role.alias("role"), F.concat("event_type", F.lit(" "), "props").alias("content"))


_M = "m AS (SELECT user_id AS conv_id, event_id AS pos, CASE WHEN event_type = 'purchase' THEN 'assistant' WHEN event_type IN ('view', 'click') THEN 'tool' ELSE 'user' END AS role, event_type || ' ' || props AS content FROM events)"


def conv_tiers(spark: SparkSession, d: str) -> DataFrame:
    t = context.token_counts(messages(spark, d)).withColumn("ratio", context.ratio(F.col("tokens"), 600))
    return t.select("conv_id", "messages", "tokens", F.round("ratio", 6).alias("ratio"), context.tier(F.col("ratio")).alias("tier"))


def conv_cleared(spark: SparkSession, d: str) -> DataFrame:
    """The tables' messages are short, so the threshold is a parameter here."""
    out = context.cleared(messages(spark, d), context.F.octet_length("content") >= 14)
    return out.select("conv_id", "pos", "role", "content", "consumed")


def conv_tokens_counted(spark: SparkSession, d: str) -> DataFrame:
    """With a tokenizer's count a message: here runs of letters and digits, as SQL can count them too."""
    return context.token_counts_by(messages(spark, d), F.regexp_count("content", F.lit("[a-z0-9]+")).cast("long"))


def conv_injected(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    reminders_ = context.token_counts(m).select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("remember "), "messages")).when(F.col("conv_id") % 3 == 1, "").alias("reminder"))
    return context.injected(m, reminders_)


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return context.run_outcomes(messages(spark, d), 15)


def system_prompt(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repos").select(F.col("repo_name").alias("ord"), "repo_name", "repo_path", "repo_role", "url")
    return context.system_prompt(repos, "/srv/workspace", "Trace the change.", list(TOOLS), "You analyse code changes.", "Follow callers up to an entry repository.")


def conv_tail(spark: SparkSession, d: str) -> DataFrame:
    return context.tail(messages(spark, d))


def conv_rendered(spark: SparkSession, d: str) -> DataFrame:
    return context.rendered(messages(spark, d)).select("conv_id", F.sha2("history", 256).alias("digest"), F.length("history").alias("chars"))


def conv_compacted(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    summaries = context.token_counts(m).select("conv_id", F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("summary of "), "messages", F.lit(" messages"))).alias("summary"))
    return context.compacted(m, summaries, "Go on from the summary.", 10)


def last_assistant(spark: SparkSession, d: str) -> DataFrame:
    return context.last_assistant(messages(spark, d))


def tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("k", F.get_json_object(F.regexp_extract("content", r"(\{.*\})", 1), "$.k").cast("long"))
    name = F.when(F.col("k") % 4 == 0, "search").when(F.col("k") % 4 == 1, "read").when(F.col("k") % 4 == 2, "glob").otherwise("shell")
    calls = m.where("role = 'assistant'").select("conv_id", F.col("k").alias("call_id"), "pos", name.alias("name"))
    results = m.where("role = 'tool'").select("conv_id", F.col("k").alias("tool_call_id"), "pos", "content")
    return context.paired_calls(calls, results, list(TOOLS))


def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    finish = F.when(F.col("event_type") == "error", "length").when(F.col("event_type") == "signup", "function_call").otherwise("stop")
    calls = F.when(F.col("event_id") % 5 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select(context.stop_reason(finish, calls).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reminders(spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "knowledge_base").where("summary IS NOT NULL").select(F.col("repo_name").alias("task_id"), "repo_name", "symbol", "summary", F.struct(F.col("created_at"), "id", "loaded_at").alias("ord"))
    progress = table(spark, d, "repos").select(F.col("repo_name").alias("task_id"), F.length("repo_name").alias("step"), F.array("repo_role", "repo_path").alias("nodes"))
    return context.reminders(kb, progress, 420).select("task_id", "reminder")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: parts of consecutive lines of an order; orders are short, so the window is small."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst IS NOT NULL").select("src", "dst")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_name LIKE 'red%' AND p_size = 7").select(F.col("p_partkey").alias("node"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(edges(spark, d), _roots(spark, d)).unionByName(graph.callers(edges(spark, d), _roots(spark, d)))


def chain_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(edges(spark, d), _roots(spark, d))


def _owners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    owners = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("repo"))
    role = F.when(F.col("repo").endswith("1"), "entry").otherwise("service")
    return owners, owners.select("repo").distinct().select(F.col("repo").alias("repo_name"), role.alias("repo_role"))


def chain_entries(spark: SparkSession, d: str) -> DataFrame:
    """The walk goes no further than routes of entry repositories; parts of even number stand in for routes."""
    owners, repos = _owners(spark, d)
    stop = owners.join(repos.where("repo_role = 'entry'").select(F.col("repo_name").alias("repo")), "repo", "left_semi").where("node % 2 = 0")
    reached = graph.reachable(edges(spark, d), _roots(spark, d), stop=stop)
    return graph.entry_points(reached.join(stop.select("node"), "node", "left_semi"), owners, repos)


def call_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the roots with the lines of their calls, and callees with their definitions."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sites = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_linenumber").alias("line")).where("dst IS NOT NULL")
    defs = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("func_name"), F.concat(F.lit("src/"), "p_type").alias("file_path"), F.col("p_size").alias("line"), F.col("p_brand").alias("repo"))
    both = [graph.call_hierarchy(sites, defs, _roots(spark, d), incoming).withColumn("incoming", F.lit(incoming)) for incoming in (True, False)]
    return both[0].unionByName(both[1])


def chain_impact(spark: SparkSession, d: str) -> DataFrame:
    owners, _ = _owners(spark, d)
    roots = _roots(spark, d).join(owners, "node")
    return graph.impact(chain_fixpoint(spark, d), owners, roots)


def _results(spark: SparkSession, d: str) -> DataFrame:
    ok = F.ltrim("call_chain").startswith("{") & F.try_parse_json("call_chain").isNotNull() & F.get_json_object("call_chain", "$.task_id").isNotNull()
    r = first_per_id(table(spark, d, "analysis_results"), "call_chain").where(ok)
    return r.select("id", F.from_json("call_chain", schemas.ANALYSIS_RESULT).alias("r"))


def _all_results(spark: SparkSession, d: str) -> DataFrame:
    """As _results, those in JSON strings and outer objects too."""
    r = first_per_id(table(spark, d, "analysis_results"), "call_chain").where("call_chain IS NOT NULL")
    r = r.select("id", shred.result_texts(F.col("call_chain")).alias("t")).where(F.get_json_object("t", "$.task_id").isNotNull())
    return r.select("id", F.from_json("t", schemas.ANALYSIS_RESULT).alias("r"), F.array_contains(F.json_object_keys("t"), "entry_points").alias("has_entries"))


def report_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.col("r.downward_chain.nodes")
    return _results(spark, d).select("id", report.direct_repo(nodes).alias("repo"), report.chain_path(nodes).alias("path"), report.numbered_nodes(F.slice(nodes, 1, 3)).alias("listing"))


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return report.reports(_all_results(spark, d).select("r.*"), "markdown")


def report_terminal(spark: SparkSession, d: str) -> DataFrame:
    return report.reports(_all_results(spark, d).select("r.*"), "terminal")


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON reports, read back: what they hold must be what the results hold.

    A missing list is an empty text, except for entries that the result doesn't name at all; a chain that is no object is "-".
    """
    r = F.from_json("report", schemas.ANALYSIS_RESULT)
    results = _all_results(spark, d).select("r.*", "has_entries")
    out = report.reports(results, "json", keep=("has_entries",)).select("task_id", r.alias("r"), "has_entries")
    text = lambda parts, sep: F.coalesce(F.array_join(parts, sep), F.lit(""))
    nodes = lambda c: text(F.transform(c, lambda n: F.concat_ws(":", n["repo"], n["func_name"], n["file_path"], n["line"].cast("string"), n["node_type"])), "|")
    ups = text(F.transform("r.upward_chains", lambda c: F.when(c.isNull(), "-").otherwise(nodes(c["nodes"]))), "#")
    entries = text(F.transform("r.entry_points", lambda e: F.concat_ws(" ", e["protocol"], e["path"], e["node"]["func_name"])), "|")
    return out.select(
        "task_id", F.col("r.input_type").alias("input_type"), nodes(F.col("r.downward_chain.nodes")).alias("nodes"), ups.alias("upward"), F.when(F.col("has_entries"), entries).alias("entries"),
        F.col("r.impact_summary.direct_count").alias("direct_count"), text("r.impact_summary.cross_repo_impact", "|").alias("cross_repo"), F.col("r.self_check_report").alias("self_check"),
    )


def checkpoint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("tool_call_id", F.when(F.col("role") == "tool", F.concat(F.lit("c"), F.col("pos").cast("string"))))
    return state.restored(state.checkpoint_rows(m))


def checkpoint_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh state holds an unknown tag, every fifth is missing: both start from their seeds."""
    m = messages(spark, d).withColumn("tool_call_id", F.when(F.col("role") == "tool", F.concat(F.lit("c"), F.col("pos").cast("string"))))
    broken = F.concat("envelopes", F.array(F.lit('{"type":"alien","payload":{}}')))
    states = state.checkpoint_rows(m.where("conv_id % 5 > 0")).withColumn("envelopes", F.when(F.col("conv_id") % 7 == 0, broken).otherwise(F.col("envelopes")))
    seeds = m.select("conv_id").distinct().select("conv_id", F.concat(F.lit("task "), F.col("conv_id").cast("string")).alias("content"))
    return state.resumed(states, seeds)


def delta_accumulation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    call = F.col("event_type") == "purchase"
    deltas = e.select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("content"),
        F.when(call, F.col("event_id") % 3).alias("call_index"), F.when(call & (F.col("event_id") % 2 == 0), F.concat(F.lit("id"), F.col("event_id").cast("string"))).alias("call_id"),
        F.when(call, F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("event_id") % 3 + 1).cast("int"))).alias("call_name"), F.when(call, F.col("props")).alias("arguments"), F.when(F.col("event_type") == "error", "stop").alias("finish"),
    )
    out = state.accumulated(deltas)
    args = F.array_join(F.transform("calls", lambda c: F.concat_ws("/", c["call_index"].cast("string"), c["id"], c["name"], c["arguments"])), ";")
    return out.select("stream_id", F.sha2("content", 256).alias("content"), "finish", F.sha2(F.coalesce(args, F.lit("")), 256).alias("calls"))


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the streaming aggregate's batch form."""
    return state.stream_windows(table(spark, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


def result_structs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: their lines' parts as nodes, a brand as the repository, the first line as the root."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("p"), "p_name", "p_brand", "p_size")
    n = li.join(part, "p").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("ord"), F.concat("p_name", F.lit("_"), F.col("p").cast("string")).alias("func_name"), F.lit("f.go").alias("file_path"), F.col("p_size").alias("line"), F.col("p_brand").alias("repo"))
    first = n.groupBy("task_id").agg(F.min("ord").alias("least"))
    nodes = n.join(first, "task_id").withColumn("is_root", F.col("ord") == F.col("least"))
    entries = n.where(F.col("repo").endswith("1")).withColumn("protocol", F.lit(None).cast("string")).withColumn("path", F.concat(F.lit("/"), "func_name"))
    out = graph.result_structs(nodes, entries, n.select("task_id", F.col("func_name").alias("src"), F.col("repo").alias("dst")))
    return out.select(
        "task_id", F.size("nodes").alias("nodes"), F.coalesce(F.size("edges"), F.lit(0)).alias("edges"), F.array_join(F.transform("entry_points", lambda e: F.concat(e["protocol"], F.lit(" "), e["path"])), ",").alias("entries"),
        F.col("impact_summary.direct_count").alias("direct_count"), F.array_join("impact_summary.cross_repo_impact", ",").alias("cross"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        conv_tiers, conv_tokens_counted, conv_cleared, conv_injected, run_outcomes, system_prompt, conv_tail, conv_rendered, conv_compacted, last_assistant, tool_pairs, stop_reasons, reminders, call_edges, call_hierarchy, chain_fixpoint, chain_entries, chain_impact, result_structs,
        report_paths, report_markdown, report_terminal, report_json, checkpoint_roundtrip, checkpoint_resumed, delta_accumulation, window_counts,
    )
}

_TEXT = "role || ': ' || coalesce(content, '')"
_TIER = "CASE WHEN t / 600.0 >= 0.92 THEN 'compact' WHEN t / 600.0 >= 0.80 THEN 'clear' WHEN t / 600.0 >= 0.70 THEN 'restrict' WHEN t / 600.0 >= 0.60 THEN 'remind' ELSE 'none' END"
_TAIL = "SELECT conv_id, pos, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS k FROM m) WHERE k <= 10"
_E = "e AS (SELECT src, dst FROM (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
_ROOTS = "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' AND p_size = 7"
_FIX = f"{_E}, ue AS (SELECT DISTINCT src, dst FROM e), f(node, depth) AS (SELECT p_partkey, 0 FROM ({_ROOTS}) UNION SELECT dst, min(depth) + 1 FROM f JOIN ue ON src = node WHERE depth < 40 GROUP BY dst), x AS (SELECT node, min(depth) AS depth FROM f GROUP BY node)"
_RES = "r AS (SELECT id, json_extract(call_chain::JSON, '$.downward_chain.nodes[*]') AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS k FROM analysis_results WHERE id IS NOT NULL) WHERE k = 1 AND starts_with(ltrim(call_chain), '{') AND json_valid(call_chain) AND (try_cast(call_chain AS JSON) ->> '$.task_id') IS NOT NULL)"
_STEPS = STEP.format(x="c")
_ALL = f"q AS (SELECT id, CASE WHEN json_valid(call_chain) THEN call_chain::JSON END AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS k FROM analysis_results WHERE id IS NOT NULL) WHERE k = 1), q1 AS (SELECT id, {_STEPS} AS c FROM q), q2 AS (SELECT id, {_STEPS} AS c FROM q1), q3 AS (SELECT id, {_STEPS} AS c FROM q2), a AS (SELECT c ->> '$.task_id' AS task_id, c, json_extract(c, '$.downward_chain.nodes[*]') AS n, json_extract(c, '$.upward_chains[*]') AS u, coalesce(json_extract(c, '$.entry_points[*]'), []) AS e FROM q3 WHERE json_type(c) = 'OBJECT' AND (c ->> '$.task_id') IS NOT NULL)"


def _v(x: str, path: str, empty: str = "''") -> str:
    return f"coalesce({x} ->> '$.{path}', {empty})"


def _at(x: str, base: str = "") -> str:
    return f"{_v(x, base + 'file_path')} || ':' || {_v(x, base + 'line', chr(39) + '0' + chr(39))}"


def _list(items: str, one: str, between: str = "''") -> str:
    return f"coalesce(array_to_string(list_transform({items}, lambda x, i: {one}), {between}), '')"


_LEAF = f"CASE WHEN x ->> '$.node_type' = 'leaf' THEN {_v('x', 'func_name')} || ' (底层: ' || {_v('x', 'repo')} || ')' ELSE {_v('x', 'func_name')} || ' (' || {_at('x')} || ')' END"
_PATH = "array_to_string(list_transform(json_extract(x, '$.nodes[*]'), lambda y: coalesce(y ->> '$.func_name', '') || ' (L' || coalesce(y ->> '$.line', '0') || ')'), ' → ') || ' → [变更点]'"
_HAS = "len(coalesce(json_extract(x, '$.nodes[*]'), [])) > 0"
_MARK = "CASE WHEN json_type(e[i]) = 'OBJECT' THEN '入口' || i || ' {w}[' || coalesce(e[i] ->> '$.protocol', '') || '] ' || coalesce(e[i] ->> '$.path', '') || '{w}' ELSE '路径' || i END"
_IMPACT = "coalesce(n[1] ->> '$.repo', 'unknown') || ' 内 ' || coalesce(c ->> '$.impact_summary.direct_count', '0') || ' 个函数'"
_SELF = "coalesce(c ->> '$.self_check_report', '')"
_CASES = "CASE WHEN len(coalesce(json_extract(x, '$.test_scenarios[*]'), [])) > 0 THEN '- **测试场景:**' || chr(10) || array_to_string(list_transform(json_extract_string(x, '$.test_scenarios[*]'), lambda y: '  - ' || y || chr(10)), '') ELSE '' END"
_MARKDOWN = " || ".join([
    "'# 分析报告' || chr(10) || chr(10)",
    f"CASE WHEN len(n) > 0 THEN '**变更函数:** `[' || {_v('n[1]', 'repo')} || '] ' || {_v('n[1]', 'func_name')} || '` (`' || {_at('n[1]')} || '`)' || chr(10) || chr(10) ELSE '' END",
    f"CASE WHEN len(n) > 1 THEN '## 向下追踪（实现路径）' || chr(10) || chr(10) || '```' || chr(10) || {_list('n[2:]', f'{chr(39)}  {chr(39)} || repeat({chr(39)}     {chr(39)}, i - 1) || {chr(39)}└─ {chr(39)} || {_LEAF} || chr(10)')} || '```' || chr(10) || chr(10) ELSE '' END",
    f"CASE WHEN len(u) > 0 THEN '## 向上追踪 → 集成测试入口' || chr(10) || chr(10) || {_list('u', f'{chr(39)}### {chr(39)} || ' + _MARK.replace('{w}', '`') + f' || chr(10) || chr(10) || {chr(39)}```{chr(39)} || chr(10) || CASE WHEN {_HAS} THEN {chr(39)}  └─ {chr(39)} || {_PATH} || chr(10) ELSE {chr(39)}{chr(39)} END || {chr(39)}```{chr(39)} || chr(10) || chr(10)')} ELSE '' END",
    f"CASE WHEN len(e) > 0 THEN '## 集成测试入口' || chr(10) || chr(10) || {_list('e', f'{chr(39)}### 入口{chr(39)} || i || chr(10) || chr(10) || {chr(39)}- **协议:** {chr(39)} || ' + _v('x', 'protocol') + f' || chr(10) || {chr(39)}- **路径:** `{chr(39)} || ' + _v('x', 'path') + f' || {chr(39)}`{chr(39)} || chr(10) || {chr(39)}- **函数:** `{chr(39)} || ' + _v('x', 'node.func_name') + f' || {chr(39)}` (`{chr(39)} || ' + _at('x', 'node.') + f' || {chr(39)}`){chr(39)} || chr(10) || {_CASES} || chr(10)')} ELSE '' END",
    f"'## 影响范围' || chr(10) || chr(10) || '- **直接影响:** ' || {_IMPACT} || chr(10)",
    "coalesce(array_to_string(list_transform(json_extract_string(c, '$.impact_summary.direct_functions[*]'), lambda x: '  - `' || x || '`' || chr(10)), ''), '')",
    "CASE WHEN coalesce((c ->> '$.impact_summary.cross_repo_count')::INT, 0) > 0 THEN '- **跨仓影响:** ' || (c ->> '$.impact_summary.cross_repo_count') || ' 处' || chr(10) || coalesce(array_to_string(list_transform(json_extract_string(c, '$.impact_summary.cross_repo_impact[*]'), lambda x: '  - `' || x || '`' || chr(10)), ''), '') ELSE '' END",
    "chr(10)",
    f"CASE WHEN {_SELF} <> '' THEN '## 自检报告' || chr(10) || chr(10) || '```' || chr(10) || {_SELF} || chr(10) || '```' || chr(10) || chr(10) ELSE '' END",
])
_TERMINAL = " || ".join([
    f"CASE WHEN len(n) > 0 THEN '变更函数: [' || {_v('n[1]', 'repo')} || '] ' || {_v('n[1]', 'func_name')} || ' (' || {_at('n[1]')} || ')' || chr(10) ELSE '' END",
    f"CASE WHEN len(n) > 1 THEN chr(10) || '向下追踪（实现路径）:' || chr(10) || {_list('n[2:]', f'{chr(39)}  {chr(39)} || CASE WHEN i = len(n) - 1 THEN {chr(39)}└─{chr(39)} ELSE {chr(39)}├─{chr(39)} END || {chr(39)} {chr(39)} || {_LEAF} || chr(10)')} ELSE '' END",
    f"CASE WHEN len(u) > 0 THEN chr(10) || '向上追踪 → 集成测试入口:' || chr(10) || {_list('u', f'{chr(39)}  {chr(39)} || ' + _MARK.replace('{w}', '') + f' || chr(10) || CASE WHEN {_HAS} THEN {chr(39)}    └─ {chr(39)} || {_PATH} || chr(10) ELSE {chr(39)}{chr(39)} END')} ELSE '' END",
    f"chr(10) || '影响范围:' || chr(10) || '  直接影响: ' || {_IMPACT} || chr(10)",
    "CASE WHEN coalesce((c ->> '$.impact_summary.cross_repo_count')::INT, 0) > 0 THEN '  跨仓影响: ' || array_to_string(json_extract_string(c, '$.impact_summary.cross_repo_impact[*]'), '、') || chr(10) ELSE '' END",
    f"CASE WHEN {_SELF} <> '' THEN chr(10) || '自检报告:' || chr(10) || {_SELF} || chr(10) ELSE '' END",
])
_NODE = "concat_ws(':', x ->> '$.repo', x ->> '$.func_name', x ->> '$.file_path', x ->> '$.line', x ->> '$.node_type')"

SQL = {
    "report_markdown": f"WITH {_ALL} SELECT task_id, {_MARKDOWN} AS report FROM a",
    "report_terminal": f"WITH {_ALL} SELECT task_id, {_TERMINAL} AS report FROM a",
    "report_json": f"WITH {_ALL} SELECT task_id, c ->> '$.input_type' AS input_type, array_to_string(list_transform(n, lambda x: {_NODE}), '|') AS nodes, array_to_string(list_transform(u, lambda y: CASE WHEN json_type(y) = 'OBJECT' THEN coalesce(array_to_string(list_transform(json_extract(y, '$.nodes[*]'), lambda x: {_NODE}), '|'), '-') ELSE '-' END), '#') AS upward, CASE WHEN json_exists(c, '$.entry_points') THEN array_to_string(list_transform(e, lambda x: concat_ws(' ', x ->> '$.protocol', x ->> '$.path', x ->> '$.node.func_name')), '|') END AS entries, (c ->> '$.impact_summary.direct_count')::INT AS direct_count, array_to_string(json_extract_string(c, '$.impact_summary.cross_repo_impact[*]'), '|') AS cross_repo, c ->> '$.self_check_report' AS self_check FROM a",
    "conv_tokens_counted": f"WITH {_M} SELECT conv_id, count(*) AS messages, (sum(CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(regexp_extract_all(content, '[a-z0-9]+')) + 4 END) + 3)::BIGINT AS tokens FROM m GROUP BY conv_id",
    "conv_injected": f"WITH {_M} SELECT conv_id, -1 AS pos, 'user' AS role, 'remember ' || count(*) AS content FROM m WHERE conv_id % 3 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, pos, role, content FROM m",
    "run_outcomes": f"WITH {_M} SELECT conv_id, count(*) FILTER (role = 'assistant') AS steps, count(*) FILTER (role = 'tool') AS tools, count(*) FILTER (role = 'assistant') >= 15 AS truncated, coalesce(arg_max(content, pos) FILTER (role = 'assistant'), '') AS content FROM m GROUP BY conv_id",
    "system_prompt": "SELECT 'You analyse code changes.' || chr(10) || chr(10) || '## Workspace' || chr(10) || 'Directory: /srv/workspace' || chr(10) || chr(10) || '## Repositories' || string_agg(chr(10) || '- Name: ' || repo_name || chr(10) || '  Path: ' || repo_path || chr(10) || '  Role: ' || repo_role || CASE WHEN coalesce(url, '') <> '' THEN chr(10) || '  URL:  ' || url ELSE '' END, '' ORDER BY repo_name) || chr(10) || chr(10) || '## Analysis Goal' || chr(10) || 'Trace the change.' || chr(10) || chr(10) || '## Available Tools' || chr(10) || '- search' || chr(10) || '- read' || chr(10) || '- glob' || chr(10) || chr(10) || '## Analysis Strategy' || chr(10) || 'Follow callers up to an entry repository.' || chr(10) AS prompt FROM repos",
    "call_hierarchy": f"WITH s AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_linenumber AS line FROM lineitem), g AS (SELECT src, dst, min(line) AS line FROM s WHERE dst IS NOT NULL GROUP BY ALL) SELECT dst AS node, p_name AS func_name, 'src/' || p_type AS file_path, line, p_brand AS repo, true AS incoming FROM g JOIN part ON p_partkey = src WHERE dst IN ({_ROOTS}) UNION ALL SELECT src, p_name, 'src/' || p_type, p_size, p_brand, false FROM g JOIN part ON p_partkey = dst WHERE src IN ({_ROOTS})",
    "checkpoint_resumed": f"WITH {_M} SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS INT) AS pos, role, content, CASE WHEN role = 'tool' THEN 'c' || pos END AS tool_call_id, false AS fresh FROM m WHERE conv_id % 5 > 0 AND conv_id % 7 > 0 UNION ALL SELECT DISTINCT conv_id, 0, 'user', 'task ' || conv_id, NULL, true FROM m WHERE conv_id % 5 = 0 OR conv_id % 7 = 0",
    "result_structs": "WITH n AS (SELECT l_orderkey AS t, l_linenumber AS o, p_name || '_' || p AS f, p_brand AS r FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = p), b AS (SELECT t, arg_min(r, o) AS root FROM n GROUP BY t), c AS (SELECT n.t, count(*) AS nodes, count(DISTINCT (f, r)) AS edges, string_agg('HTTP /' || f, ',' ORDER BY o) FILTER (r LIKE '%1') AS entries, count(*) FILTER (r = root) AS direct_count, array_to_string(list_sort(list_distinct(coalesce(list(r || '.' || f) FILTER (r <> root), []))), ',') AS \"cross\" FROM n JOIN b ON n.t = b.t GROUP BY n.t) SELECT t AS task_id, cast(nodes AS INT) AS nodes, cast(edges AS INT) AS edges, entries, cast(direct_count AS INT) AS direct_count, \"cross\" FROM c",
    "conv_tiers": f"WITH {_M}, c AS (SELECT conv_id, count(*) AS messages, cast(sum(strlen({_TEXT}) // 4) AS BIGINT) AS t FROM m GROUP BY conv_id) SELECT conv_id, messages, t AS tokens, round(t / 600.0::DOUBLE, 6) AS ratio, {_TIER} AS tier FROM c",
    "conv_cleared": f"WITH {_M}, c AS (SELECT *, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS consumed FROM m) SELECT conv_id, pos, role, CASE WHEN role = 'tool' AND consumed AND strlen(content) >= 14 THEN '{context.CLEARED}' ELSE content END AS content, consumed FROM c",
    "conv_tail": f"WITH {_M} {_TAIL}",
    "conv_rendered": f"WITH {_M}, h AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'Tool Result: ' END || content || chr(10) || chr(10), '' ORDER BY pos) AS history FROM m GROUP BY conv_id) SELECT conv_id, sha256(history) AS digest, cast(length(history) AS INT) AS chars FROM h",
    "conv_compacted": f"WITH {_M}, s AS (SELECT conv_id, 'summary of ' || count(*) || ' messages' AS summary FROM m WHERE conv_id % 3 > 0 GROUP BY conv_id) SELECT conv_id, -2 AS pos, 'user' AS role, 'Go on from the summary.' AS content FROM s UNION ALL SELECT conv_id, -1, 'assistant', summary FROM s UNION ALL SELECT * FROM ({_TAIL}) WHERE conv_id % 3 > 0 UNION ALL SELECT conv_id, pos, role, content FROM m WHERE conv_id % 3 = 0",
    "last_assistant": f"WITH {_M} SELECT conv_id, arg_max(content, pos) AS content FROM m WHERE role = 'assistant' GROUP BY conv_id",
    "tool_pairs": f"WITH {_M}, k AS (SELECT *, cast(regexp_extract(content, '\"k\": (\\d+)', 1) AS BIGINT) AS k FROM m), r AS (SELECT conv_id, k, arg_min(content, pos) AS c FROM k WHERE role = 'tool' GROUP BY ALL), a AS (SELECT conv_id, k AS call_id, pos, CASE k % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'read' WHEN 2 THEN 'glob' ELSE 'shell' END AS name FROM k WHERE role = 'assistant') SELECT a.conv_id, call_id, pos, name, CASE WHEN name = 'shell' THEN 'error: unknown tool shell' ELSE c END AS result FROM a LEFT JOIN r ON a.conv_id = r.conv_id AND call_id = r.k",
    "stop_reasons": "SELECT CASE WHEN event_id % 5 = 0 OR event_type = 'signup' THEN 'tool_use' WHEN event_type = 'error' THEN 'max_tokens' ELSE 'end_turn' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "reminders": "WITH k AS (SELECT *, row_number() OVER w AS i FROM knowledge_base WHERE summary IS NOT NULL WINDOW w AS (PARTITION BY repo_name ORDER BY created_at, id, loaded_at)), l AS (SELECT repo_name, i, '- ' || repo_name || '/' || symbol || '：' || summary || chr(10) AS l FROM k WHERE i <= 5), b AS (SELECT *, sum(strlen(l)) OVER (PARTITION BY repo_name ORDER BY i) + strlen('## 相关历史知识' || chr(10)) AS b FROM l), a AS (SELECT repo_name, '## 相关历史知识' || chr(10) || coalesce(string_agg(l, '' ORDER BY i) FILTER (b <= 420), '') AS a FROM b GROUP BY repo_name), p AS (SELECT coalesce(a.repo_name, r.repo_name) AS t, coalesce(a, '') AS a, r.repo_name IS NOT NULL AS has, chr(10) || '## 当前分析进度' || chr(10) AS h, '- 已完成节点：' || repo_role || ', ' || repo_path || chr(10) AS d, '- 当前步骤：' || length(r.repo_name) || chr(10) AS s FROM a FULL JOIN repos r ON a.repo_name = r.repo_name), q AS (SELECT *, CASE WHEN has AND strlen(a || h) <= 420 THEN a || h END AS b FROM p), c AS (SELECT *, CASE WHEN b IS NOT NULL AND strlen(b || d) <= 420 THEN b || d ELSE b END AS c FROM q) SELECT t AS task_id, coalesce(CASE WHEN c IS NOT NULL AND strlen(c || s) <= 420 THEN c || s ELSE c END, a) AS reminder FROM c",
    "call_edges": f"WITH {_E} SELECT src, dst FROM e WHERE src IN ({_ROOTS}) UNION ALL SELECT src, dst FROM e WHERE dst IN ({_ROOTS})",
    "chain_fixpoint": f"WITH RECURSIVE {_FIX} SELECT node, cast(depth AS INT) AS depth FROM x",
    "chain_entries": f"WITH RECURSIVE {_E}, ue AS (SELECT DISTINCT src, dst FROM e), t AS (SELECT p_partkey FROM part WHERE p_brand LIKE '%1' AND p_partkey % 2 = 0), f(node, depth) AS (SELECT p_partkey, 0 FROM ({_ROOTS}) UNION SELECT dst, min(depth) + 1 FROM f JOIN ue ON src = node WHERE depth < 40 AND node NOT IN (SELECT p_partkey FROM t) GROUP BY dst), x AS (SELECT node, min(depth) AS depth FROM f GROUP BY node) SELECT node, cast(depth AS INT) AS depth, p_brand AS repo FROM x JOIN part ON p_partkey = node WHERE node IN (SELECT p_partkey FROM t)",
    "chain_impact": f"WITH RECURSIVE {_FIX} SELECT coalesce(p_brand, 'unknown') AS repo, count(*) AS functions, cast(min(depth) AS INT) AS nearest, coalesce(p_brand, 'unknown') IN (SELECT p_brand FROM part WHERE p_partkey IN ({_ROOTS})) AS is_direct FROM x LEFT JOIN part ON p_partkey = node GROUP BY 1",
    "report_paths": f"WITH {_RES} SELECT id, coalesce(n[1] ->> '$.repo', 'unknown') AS repo, CASE WHEN len(n) > 0 THEN array_to_string(list_transform(n, lambda x: coalesce(x ->> '$.func_name', '') || ' (L' || coalesce(x ->> '$.line', '0') || ')'), ' → ') || ' → [变更点]' ELSE '' END AS path, array_to_string(list_transform(n[1:3], lambda x, i: i || '. [' || coalesce(x ->> '$.repo', '') || '] ' || coalesce(x ->> '$.func_name', '') || CASE WHEN coalesce(x ->> '$.file_path', '') = '' THEN '' ELSE ' (' || (x ->> '$.file_path') || CASE WHEN coalesce((x ->> '$.line')::INT, 0) > 0 THEN ':' || (x ->> '$.line') ELSE '' END || ')' END), chr(10)) AS listing FROM r",
    "checkpoint_roundtrip": f"WITH {_M} SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS INT) AS pos, role, content, CASE WHEN role = 'tool' THEN 'c' || pos END AS tool_call_id FROM m",
    "delta_accumulation": "WITH d AS (SELECT user_id AS s, event_id AS q, event_type AS t, props AS a, event_id % 3 AS i FROM events), w AS (SELECT s, coalesce(string_agg('v' || q, '' ORDER BY q) FILTER (t = 'view'), '') AS c, CASE WHEN bool_or(t = 'error') THEN 'stop' END AS f FROM d GROUP BY s), c AS (SELECT s, i, arg_max('id' || q, q) FILTER (q % 2 = 0) AS id, ['search', 'read', 'glob'][i + 1] AS n, string_agg(a, '' ORDER BY q) AS a FROM d WHERE t = 'purchase' GROUP BY s, i), l AS (SELECT s, string_agg(concat_ws('/', i, id, n, a), ';' ORDER BY i) AS calls FROM c GROUP BY s) SELECT w.s AS stream_id, sha256(w.c) AS content, f AS finish, sha256(coalesce(calls, '')) AS calls FROM w LEFT JOIN l ON w.s = l.s",
    "window_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
