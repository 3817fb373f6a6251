from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tracewake import schemas
from tracewake.operators import context, graph, report
from tracewake.sources import config, workspace
from tracewake.streaming import state


def msgs(spark, rows):
    return spark.createDataFrame(rows, "conv_id string, pos long, role string, content string")


@pytest.mark.parametrize(("r", "name"), [(0.6, "remind"), (0.7, "restrict"), (0.8, "clear"), (0.92, "compact"), (0.599, "none"), (2.0, "compact")])
def test_tiers(spark, r, name):
    assert spark.range(1).select(context.tier(F.lit(r))).first()[0] == name


def test_tokens_and_ratio(spark):
    m = msgs(spark, [("a", 0, "user", "Hello"), ("a", 1, "assistant", "中文"), ("b", 0, "tool", None)])
    assert {r.conv_id: r.tokens for r in context.token_counts(m).collect()} == {"a": 2 + 4, "b": 1}
    assert spark.range(1).select(context.ratio(F.lit(5), 0)).first()[0] == 0.0
    exact = context.token_counts_by(m, F.lit(2))
    assert {r.conv_id: r.tokens for r in exact.collect()} == {"a": 15, "b": 3}


def test_clearing(spark):
    code = "func x() {\n" + "é" * 1000
    rows = [("a", 0, "tool", code), ("a", 1, "tool", code[:500]), ("a", 2, "assistant", "ok"), ("a", 3, "tool", code), ("b", 0, "tool", code.replace("\n", " "))]
    got = {(r.conv_id, r.pos): r.content for r in context.cleared(msgs(spark, rows)).collect()}
    assert got["a", 0] == context.CLEARED and got["a", 1] == code[:500] and got["a", 3] == code and got["b", 0] != context.CLEARED
    size = lambda n: spark.range(1).select(context.is_large_code(F.lit("{\n" + "x" * (n - 2)))).first()[0]
    assert size(2000) and not size(1999)


def test_tail_render_compact_inject(spark):
    m = msgs(spark, [("a", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(15)] + [("b", 0, "tool", "t")])
    assert context.tail(m).count() == 11
    assert context.rendered(m).where("conv_id = 'b'").first().history == "Tool Result: t\n\n"
    s = spark.createDataFrame([("a", "sum"), ("b", "")], "conv_id string, summary string")
    got = [(r.conv_id, r.role, r.content) for r in context.compacted(m, s, "go on", 3).orderBy("conv_id", "pos").collect()]
    assert got == [("a", "user", "go on"), ("a", "assistant", "sum"), ("a", "user", "m12"), ("a", "assistant", "m13"), ("a", "user", "m14"), ("b", "tool", "t")]
    r = spark.createDataFrame([("a", "remember"), ("b", None)], "conv_id string, reminder string")
    assert context.injected(m, r).count() == 17
    assert {r.conv_id: r.content for r in context.last_assistant(m).collect()} == {"a": "m13"}


def test_calls(spark):
    calls = spark.createDataFrame([("a", "1", "read"), ("a", "2", "fly"), ("a", "3", "read")], "conv_id string, call_id string, name string")
    res = spark.createDataFrame([("a", "1", 5, "late"), ("a", "1", 4, "text")], "conv_id string, tool_call_id string, pos long, content string")
    assert {r.call_id: r.result for r in context.paired_calls(calls, res, ["read"]).collect()} == {"1": "text", "2": "error: unknown tool fly", "3": None}


def test_reminder_budget(spark):
    rec = spark.createDataFrame([("t", i, "r", f"s{i}", "x" * 50) for i in range(7)], "task_id string, ord int, repo_name string, symbol string, summary string")
    pro = spark.createDataFrame([("t", 3, ["n" * 60]), ("u", 1, []), ("v", None, None)], "task_id string, step int, nodes array<string>")
    full = {r.task_id: r.reminder for r in context.reminders(rec, pro).collect()}
    assert full["t"].count("- r/s") == 5 and full["t"].endswith("- 当前步骤：3\n") and "已完成节点" in full["t"]
    assert full["u"] == "\n## 当前分析进度\n- 当前步骤：1\n" and full["v"] == ""
    head = len("## 相关历史知识\n".encode())
    line = len(("- r/s0：" + "x" * 50 + "\n").encode())
    part2 = len("\n## 当前分析进度\n".encode())
    tight = {r.task_id: r.reminder for r in context.reminders(rec, pro, head + line + part2 + 30).collect()}["t"]
    assert tight.count("- r/s") == 1 and "已完成节点" not in tight and tight.endswith("- 当前步骤：3\n")
    exact = {r.task_id: r.reminder for r in context.reminders(rec, pro, head + 5 * line).collect()}["t"]
    assert exact.count("- r/s") == 5 and "进度" not in exact


def test_fixpoint_cycles_diamonds_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d"), ("x", "y"), (None, "z"), ("a", "b"), ("d", "e"), ("e", "f"), ("f", "g")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("a",), (None,), ("q",)], "node string")
    got = {r.node: r.depth for r in graph.reachable(e, roots).collect()}
    assert got == {"a": 0, "q": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4, "g": 5}
    assert {r.node for r in graph.reachable(e, roots, 1).collect()} == {"a", "q", "b", "c"}
    assert graph.reachable(e.limit(0), roots).count() == 2 and graph.reachable(e, roots.limit(0)).count() == 0
    nodes = graph.reachable(e, roots)
    assert graph.reached_edges(e, nodes).count() == 9
    assert graph.callers(e, spark.createDataFrame([("d",)], "node string")).count() == 3
    owners = spark.createDataFrame([("a", "r1"), ("d", "r2"), ("b", "r1")], "node string, repo string")
    repos = spark.createDataFrame([("r2", "entry"), ("r1", "service")], "repo_name string, repo_role string")
    assert [(r.node, r.repo) for r in graph.entry_points(nodes, owners, repos).collect()] == [("d", "r2")]
    im = {r.repo: (r.functions, r.is_direct) for r in graph.impact(nodes, owners, spark.createDataFrame([("r1",)], "repo string")).collect()}
    assert im == {"r1": (2, True), "r2": (1, False), "unknown": (5, False)}


def test_reports(spark):
    js = '{"task_id":"t","downward_chain":{"nodes":[{"func_name":"f","file_path":"a.go","line":3,"repo":"r"},{"func_name":"g","file_path":"b.go","line":4,"repo":"r"},{"func_name":"h","repo":"q","node_type":"leaf"}]},"upward_chains":[{"nodes":[{"func_name":"u","line":1},{"func_name":"v","line":2}]},{"nodes":[]}],"entry_points":[{"node":{"func_name":"u","file_path":"c.go","line":1},"protocol":"HTTP","path":"/x","test_scenarios":["s"]}],"impact_summary":{"direct_count":2,"direct_functions":["f"],"cross_repo_count":1,"cross_repo_impact":["q.h"]},"test_scenarios":[{"entry_protocol":"HTTP","entry_path":"/x","description":"d"}],"self_check_report":"fine"}'
    df = spark.createDataFrame([(js,), ('{"task_id":"e"}',)], "j string").select(F.from_json("j", schemas.ANALYSIS_RESULT).alias("r")).select("r.*")
    md = {r.task_id: r.report for r in report.reports(df, "markdown").collect()}
    for part in ("# 分析报告", "`[r] f` (`a.go:3`)", "  └─ g (b.go:4)\n       └─ h (底层: q)", "### 入口1 `[HTTP] /x`", "### 路径2", "u (L1) → v (L2) → [变更点]", "- **直接影响:** r 内 2 个函数", "  - `q.h`", "## 自检报告"):
        assert part in md["t"], part
    assert "\033" not in md["t"] and "unknown 内 0 个函数" in md["e"]
    plain = {r.task_id: r.report for r in report.reports(df, "terminal").collect()}["t"]
    assert "  ├─ g (b.go:4)\n  └─ h (底层: q)" in plain and "入口1 [HTTP] /x" in plain and "\033" not in plain
    coloured = df.select("task_id", report.terminal({"downward": F.col("downward_chain"), "upward": F.col("upward_chains"), "entries": F.col("entry_points"), "scenarios": F.col("test_scenarios"), "impact": F.col("impact_summary"), "self_check": F.col("self_check_report")}, True).alias("r"))
    assert "└─ \033[90mh (底层: q)\033[0m" in coloured.where("task_id = 't'").first().r
    again = report.reports(df, "json").select(F.from_json("report", schemas.ANALYSIS_RESULT).alias("r")).select("r.*")
    assert again.exceptAll(df).count() == 0
    with pytest.raises(ValueError, match="format"):
        report.reports(df, "pdf")


def test_state(spark):
    t = D(2024, 1, 1)
    rows = spark.createDataFrame([("k", t, "old", False), ("k", t + timedelta(hours=1), "new", False), ("g", t, "x", False), ("g", t + timedelta(hours=2), None, True)], "k string, at timestamp, v string, gone boolean")
    live = lambda h: {r.k: r.v for r in state.current(state.written(rows), "k", F.lit(t + timedelta(hours=h)), deleted="gone").collect()}
    assert live(0) == {"k": "old", "g": "x"} and live(3) == {"k": "new"} and live(72) == {"k": "new"} and live(73) == {}
    w = spark.createDataFrame([("k", t), (None, t)], "k string, at timestamp")
    p = spark.createDataFrame([("k", t, 0), ("k", t + timedelta(hours=71), 1), ("k", t + timedelta(hours=72), 2), ("k", t + timedelta(hours=300), 3), ("z", t, 4)], "k string, at timestamp, probe_id long")
    assert {r.probe_id: r.hit for r in state.cache_hits(w, p, "k").collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_checkpoint_and_deltas(spark):
    m = spark.createDataFrame([("a", 5, "assistant", "x", None), ("a", 2, "user", None, None), ("a", 9, "tool", "中", "c1")], "conv_id string, pos long, role string, content string, tool_call_id string")
    saved = state.checkpoint_rows(m)
    assert saved.first().step_count == 1
    assert [(r.role, r.content, r.tool_call_id) for r in state.restored(saved).orderBy("pos").collect()] == [("user", None, None), ("assistant", "x", None), ("tool", "中", "c1")]
    odd = spark.createDataFrame([("a", ['{"type":"odd"}'])], "conv_id string, envelopes array<string>")
    with pytest.raises(Exception, match="unknown message type"):
        state.restored(odd).collect()
    d = spark.createDataFrame(
        [("s", 2, "b", None, None, None, None, None), ("s", 1, "a", None, None, None, None, ""), ("s", 3, None, 2, "id", "n", '{"x"', None), ("s", 4, "", 2, "", None, ":1}", "stop"), ("s", 5, None, 0, None, "m", None, None)],
        "stream_id string, seq int, content string, call_index int, call_id string, call_name string, arguments string, finish string",
    )
    r = state.accumulated(d).first()
    assert (r.content, r.finish) == ("ab", "stop") and [(c.call_index, c.id, c.name, c.arguments) for c in r.calls] == [(0, None, "m", ""), (2, "id", "n", '{"x":1}')]


def test_streaming_latest_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    t = D(2024, 1, 1)
    schema = "k string, value string, at timestamp"
    spark.createDataFrame([("a", "1", t), ("a", "2", t + timedelta(minutes=1)), ("b", "x", t)], schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src)).withWatermark("at", "1 hour").select("k", "value", "at")
    q = state.stream_latest(stream, "k").writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.value) for r in spark.sql("SELECT k, value FROM latest").collect()} == {("a", "2"), ("b", "x")}


def test_sources(spark, tmp_path):
    (tmp_path / "w" / "a").mkdir(parents=True)
    (tmp_path / "w" / ".git").mkdir()
    (tmp_path / "w" / "a" / "x.go").write_text("func X() {}\n")
    (tmp_path / "w" / ".git" / "y.go").write_text("hidden")
    assert [(r.path, r.content) for r in workspace.files(spark, str(tmp_path / "w")).collect()] == [("a/x.go", "func X() {}\n")]
    for n in ("1.diff", "2.diff"):
        (tmp_path / n).write_text(n)
    assert workspace.diff_files(spark, [str(tmp_path / "2.diff"), str(tmp_path / "1.diff")]).first().diff == "2.diff\n1.diff\n"
    snap = spark.createDataFrame([("r", "old", D(2024, 1, 1)), ("r", "new", D(2024, 1, 2)), ("q", " ", D(2024, 1, 1))], "repo_name string, commit_hash string, created_at timestamp")
    repos = spark.createDataFrame([("r",), ("q",)], "repo_name string")
    assert {r.repo_name: (r.commit_hash, r.error) for r in workspace.heads(snap, repos).collect()} == {"r": ("new", None), "q": (None, "no snapshot")}


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"api_key": "k", "cache_hours": 5, "other": 1}')
    c = config.load(str(f), {"TRACEWAKE_DSN": "d", "TRACEWAKE_CACHE_HOURS": "7"})
    assert (c.api_key, c.dsn, c.cache_hours, c.checkpoint_hours) == ("k", "d", 7, 24)
    with pytest.raises(ValueError, match="dsn"):
        config.load(str(f), {})


def test_insert_stream_keeps_first_writes(spark, tmp_path):
    from tracewake.operators import store

    spark.sql("DROP TABLE IF EXISTS first_writes")
    spark.sql("CREATE TABLE first_writes (k string, v string, seq int) USING parquet")
    spark.sql("INSERT INTO first_writes VALUES ('a', 'old', 0)")
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "new", 1), ("b", "late", 3), ("b", "early", 2), (None, "n", 1)], "k string, v string, seq int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v string, seq int").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        store.insert_stream(stream, "first_writes", ["k"], ["seq"], str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((str(r.k), r.v) for r in spark.table("first_writes").collect()) == [("None", "n"), ("a", "old"), ("b", "early")]
    spark.sql("DROP TABLE first_writes")


def test_reports_take_wrapped_results(spark, tmp_path):
    import json

    from tracewake.plans import flow_queries

    whole = lambda t: {"task_id": t, "downward_chain": {"nodes": [{"func_name": "f", "repo": "r", "line": 1}]}}
    rows = [("1", json.dumps(whole("t1"))), ("2", json.dumps(json.dumps(whole("t2")))), ("3", json.dumps({"result": whole("t3"), "version": 2})), ("4", "[]"), ("5", "{")]
    spark.createDataFrame(rows, "id string, call_chain string").selectExpr("*", "timestamp'2025-01-01' AS loaded_at").write.parquet(f"{tmp_path}/analysis_results.parquet")
    assert {r.task_id for r in flow_queries._all_results(spark, str(tmp_path)).select("r.*").collect()} == {"t1", "t2", "t3"}
    assert flow_queries.report_markdown(spark, str(tmp_path)).count() == 3


def test_chains_deeper_than_a_hundred_hops(spark):
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(103)], "src string, dst string")
    got = graph.reachable(e, spark.createDataFrame([("0",)], "node string"))
    assert got.count() == 104 and got.agg({"depth": "max"}).first()[0] == 103


def test_hubs_are_spread_and_stops_are_kept(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", 4)
    e = spark.createDataFrame([("hub", f"n{k}") for k in range(3000)] + [("a", "hub"), ("n7", "far"), ("far", "hub"), ("n8", "end"), ("end", "beyond")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.depth for r in graph.reachable(e, roots).collect()}
    assert len(got) == 3005 and got["far"] == 3 and got["beyond"] == 4
    stop = spark.createDataFrame([("end",), ("n7",), (None,)], "node string")
    held = {r.node for r in graph.reachable(e, roots, stop=stop).collect()}
    assert set(got) - held == {"far", "beyond"}


def test_a_walk_says_whether_it_was_cut_short(spark):
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "src string, dst string")
    roots = spark.createDataFrame([("0",)], "node string")
    assert [(n.count(), cut) for n, cut in (graph.walked(e, roots, 3), graph.walked(e, roots, 6), graph.walked(e, roots))] == [(4, True), (7, False), (7, False)]


def test_call_hierarchy_gives_places(spark):
    sites = spark.createDataFrame([("f", "g", 12), ("f", "g", 9), ("h", "g", None), ("g", "k", 3)], "src string, dst string, line int")
    defs = spark.createDataFrame([(n, n.upper(), f"{n}.go", i, "r") for i, n in enumerate("fghk", 1)], "node string, func_name string, file_path string, line int, repo string")
    at = spark.createDataFrame([("g",)], "node string")
    assert {(r.func_name, r.file_path, r.line) for r in graph.call_hierarchy(sites, defs, at).collect()} == {("F", "f.go", 9), ("H", "h.go", 1)}
    assert {(r.func_name, r.file_path, r.line) for r in graph.call_hierarchy(sites, defs, at, False).collect()} == {("K", "k.go", 4)}


def test_hot_cache_key_in_slices(spark):
    import random

    r = random.Random(1)
    t = D(2024, 1, 1)
    w = [("hot", t + timedelta(minutes=r.randint(0, 20_000))) for _ in range(40)] + [("b", t)]
    p = [("hot", t + timedelta(minutes=r.choice((r.randint(0, 20_000), 5000))), i) for i in range(2000)] + [("b", t, 5000)]
    got = {x.probe_id: x.hit for x in state.cache_hits(spark.createDataFrame(w, "k string, at timestamp"), spark.createDataFrame(p, "k string, at timestamp, probe_id long"), "k", 10, min_hot=100).collect()}
    assert got == {i: any(k == kw and at - timedelta(hours=10) < aw <= at for kw, aw in w) for k, at, i in p}


def test_corrupt_states_start_fresh(spark):
    ok, bad = '{"type":"user","payload":{"content":"c"}}', '{"type":"alien","payload":{"content":"c"}}'
    states = spark.createDataFrame([(1, [ok, ok]), (2, [ok, bad]), (3, ["{broken"]), (4, [None]), (5, [])], "conv_id int, envelopes array<string>")
    seeds = spark.createDataFrame([(k, f"task {k}") for k in range(1, 7)], "conv_id int, content string")
    got = sorted((r.conv_id, r.pos, r.content, r.fresh) for r in state.resumed(states, seeds).collect())
    assert got == [(1, 0, "c", False), (1, 1, "c", False), *[(k, 0, f"task {k}", True) for k in (2, 3, 4, 6)]]


def test_streamed_deltas_equal_the_batch_form(spark, tmp_path):
    import json

    t = D(2024, 1, 1)
    rows = [("s", 0, "he", None, None, None, None, None), ("s", 1, "llo", 1, "id", "read", '{"a"', None), ("u", 0, None, 0, None, "glob", "x", None), ("s", 2, None, 1, None, None, ":1}", "stop"), ("u", 1, "end", 0, "late", None, "y", "")]
    schema = "stream_id string, seq long, content string, call_index int, call_id string, call_name string, arguments string, finish string, at timestamp"
    src = str(tmp_path / "in")
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame([(*x, t + timedelta(seconds=x[1])) for x in part], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("at", "1 hour")
    q = state.stream_accumulated(stream).writeStream.outputMode("update").format("memory").queryName("accumulated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    last = {}
    for r in spark.table("accumulated").collect():
        last[r.stream_id] = r if r.stream_id not in last or len(r.content) + len(r.calls) >= len(last[r.stream_id].content) + len(last[r.stream_id].calls) else last[r.stream_id]
    batch = {r.stream_id: r for r in state.accumulated(spark.createDataFrame([(*x, t) for x in rows], schema)).collect()}
    for k, r in batch.items():
        assert last[k].content == r.content and last[k].finish == r.finish and json.loads(last[k].calls) == [c.asDict() for c in r.calls]


def test_prompt_and_outcomes(spark):
    repos = spark.createDataFrame([(2, "b", "/b", "entry", None), (1, "a", "/a", "library", "u")], "ord int, repo_name string, repo_path string, repo_role string, url string")
    text = context.system_prompt(repos, "/w", "goal", ["t1"], "role", "steps").first().prompt
    assert text.startswith("role\n\n## Workspace\nDirectory: /w\n") and text.index("- Name: a") < text.index("- Name: b") and text.count("URL:") == 1 and text.endswith("- t1\n\n## Analysis Strategy\nsteps\n")
    assert "## Repositories\n\n## Analysis Goal" in context.system_prompt(repos.limit(0), "/w", "g", [], "r", "s").first().prompt
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "q")], "conv_id int, pos int, role string, content string")
    assert {(r.conv_id, r.steps, r.truncated, r.content) for r in context.run_outcomes(m, 2).collect()} == {(1, 2, True, "b"), (2, 0, False, "")}


def test_report_json_tells_null_from_empty(spark, tmp_path):
    import json

    from tests.compare import connect
    from tracewake.plans import catalogue

    node = {"func_name": "f", "repo": "r", "line": 1}
    rows = [
        {"task_id": "bare"},
        {"task_id": "nulls", "downward_chain": None, "upward_chains": None, "entry_points": None, "impact_summary": None},
        {"task_id": "empty", "downward_chain": {"nodes": []}, "upward_chains": [], "entry_points": [], "impact_summary": {"direct_count": 0, "cross_repo_impact": []}},
        {"task_id": "chains", "upward_chains": [{"nodes": [node]}, {"nodes": []}, {"direction": "up"}, None], "entry_points": [{"protocol": "HTTP"}, {}], "impact_summary": {"cross_repo_impact": ["a", "b"]}},
    ]
    texts = [json.dumps(x) for x in rows] + [json.dumps(json.dumps({"task_id": "inner", "entry_points": None}))]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, call_chain string").selectExpr("*", "timestamp'2025-01-01' AS loaded_at").coalesce(1).write.parquet(f"{tmp_path}/written")
    (part,) = (tmp_path / "written").glob("*.parquet")
    folder = tmp_path / "tables"
    folder.mkdir()
    part.rename(folder / "analysis_results.parquet")
    df, rel = catalogue.queries()["report_json"](spark, str(folder)), connect(folder).sql(catalogue.oracle_sql()["report_json"])
    assert df.columns == rel.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rel.fetchall()))
