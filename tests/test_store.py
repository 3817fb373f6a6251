from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tracewake import schemas
from tracewake.operators import metrics, registry, store

T1, T2, T3 = D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)


def test_new_tasks(spark):
    df = spark.createDataFrame([("d", "x", 1), ("d", None, 2), ("", "x", 3), (None, None, 4)], "input_diff string, input_desc string, id int")
    rows = store.new_tasks(df).collect()
    assert [r.input_type for r in rows] == ["combined", "diff", "description", "description"]
    assert {r.status for r in rows} == {"pending"} and len({r.id for r in rows}) == 4 and len({r.cache_key for r in rows}) == 4


def test_status_fold_keeps_completion(spark):
    ev = spark.createDataFrame([("a", 1, "running", T1), ("a", 2, "completed", T2), ("a", 3, "running", T3), ("b", 1, None, T1)], "id string, seq int, status string, at timestamp")
    assert {r.id: (r.status, r.completed_at) for r in store.fold_status(ev, "id", ["seq"]).collect()} == {"a": ("running", T2), "b": (None, None)}


def test_insert_if_absent_first_write_wins(spark):
    old = spark.createDataFrame([("r", "s", None, "x")], "repo string, symbol string, c string, summary string")
    new = spark.createDataFrame([("r", "s", None, "y", 1), ("r", "t", "c", "late", 2), ("r", "t", "c", "early", 1), (None, None, None, "n", 1)], "repo string, symbol string, c string, summary string, seq int")
    got = store.insert_if_absent(old, new, ["repo", "symbol", "c"], ["seq"])
    assert sorted((str(r.symbol), r.summary) for r in got.collect()) == [("None", "n"), ("t", "early")]
    assert store.insert_if_absent(old, new.limit(0), ["repo", "symbol", "c"], ["seq"]).count() == 0


def test_search(spark):
    kb = spark.createDataFrame([("1", "PayService.Run", "handles retry", "abc", T1, T1), ("2", "Order", None, "abc", T2, T1), ("3", "payOld", "x%y", "old", T2, T1)], "id string, symbol string, summary string, commit_hash string, created_at timestamp, loaded_at timestamp")
    ids = lambda *a, **k: [r.id for r in store.search(kb, *a, **k).collect()]
    assert ids(["pay"]) == ["3", "1"] and ids(["RETRY", " "]) == ["1"] and ids(["pay"], "abc") == ["1"] and ids(["pay"], None, 1) == ["3"]
    assert ids([" ", ""]) == [] and ids(["pay"], None, 0) == [] and ids(["Service"]) == []


def test_mark_unreliable(spark):
    kb = spark.createDataFrame([("1", "r", "f", None), ("2", "q", "f", False), ("3", "r", "g", True)], "id string, repo_name string, symbol string, unreliable boolean")
    fb = spark.createDataFrame([("t", "false_positive"), ("t", "false_positive"), ("u", "correct")], "task_id string, type string")
    res = spark.createDataFrame([("t", '[{"Repo":"r","Function":"f"},null,{"repo":"r","func_name":"f"}]'), ("t", '[{"repo":"q"'), ("u", '[{"repo":"q","symbol":"f"}]'), (None, None)], "task_id string, call_chain string")
    assert {r.id: r.unreliable for r in store.mark_unreliable(kb, fb, res).collect()} == {"1": True, "2": False, "3": True}


def test_mark_unreliable_reads_every_form_of_a_chain(spark):
    import json

    node = lambda f: {"Repo": "r", "Function": f}
    whole = {"task_id": "t", "downward_chain": {"nodes": [node("b"), None]}, "upward_chains": [{"nodes": [node("up")]}]}
    chains = [[node("a")], whole, json.dumps([node("c")]), {"result": {"task_id": "t", "downward_chain": {"nodes": [node("d")]}}, "version": 2}, {"nodes": [node("e")]}]
    res = spark.createDataFrame([("t", json.dumps(c)) for c in chains] + [("t", '[{"Repo":"r","Function":"broken"}')], "task_id string, call_chain string")
    kb = spark.createDataFrame([(x, "r", x, False) for x in ("a", "b", "c", "d", "e", "up", "broken")], "id string, repo_name string, symbol string, unreliable boolean")
    fb = spark.createDataFrame([("t", "false_positive")], "task_id string, type string")
    assert {r.id for r in store.mark_unreliable(kb, fb, res).collect() if r.unreliable} == {"a", "b", "c", "d", "e"}


def test_results_feedback_cascade(spark):
    tasks = spark.createDataFrame([("a", "completed", T1, T1), ("b", "running", T2, T1)], "id string, status string, created_at timestamp, loaded_at timestamp")
    res = spark.createDataFrame([("1", "a", 1, 1, T1), ("2", "a", 2, 2, T2), ("3", "b", 3, 3, T1)], "id string, task_id string, token_usage int, step_count int, created_at timestamp")
    assert {r.id: r.result_id for r in store.with_latest_result(tasks, res).collect()} == {"a": "2", "b": None}
    assert [r.id for r in store.recent(tasks, 0).collect()] == ["b", "a"]
    fb = spark.createDataFrame([("a", "correct"), ("z", "correct"), ("a", "odd"), (None, None)], "task_id string, type string")
    ok, bad = store.accept_feedback(fb, tasks)
    assert ok.count() == 1 and sorted((str(r.task_id), r.reason) for r in bad.collect()) == [("None", "type"), ("a", "type"), ("z", "task")]
    assert store.cascade(res, tasks.where("id = 'a'").selectExpr("id AS task_id")).count() == 1
    with pytest.raises(LookupError):
        store.require(store.point_lookup(tasks, "none"), "task")


def test_schemas(spark):
    schemas.create_tables(spark)
    assert all(schemas.table_exists(spark, t) for t in schemas.TABLES)
    schemas.drop_tables(spark)
    assert not any(schemas.table_exists(spark, t) for t in schemas.TABLES)
    df = spark.createDataFrame([("1", "diff", "x" * 70), ("2", None, None), (None, "combined", None)], "id string, input_type string, cache_key string")
    assert {str(r.id): r.violations for r in schemas.violations(df, {"input_type": schemas.INPUT_TYPES}, ("id",)).collect()} == {"1": ["cache_key"], "2": ["input_type"], "None": ["id"]}


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(100,), (101,), (10**9,), (None,)], "v long")
    got = {r.le: (r.n, r.total) for r in metrics.histogram(df, "v", metrics.TOKEN_BOUNDS).collect()}
    assert got["100"] == (1, 3) and got["200"] == (2, 3) and got["204800"] == (2, 3) and got["+Inf"] == (3, 3)
    assert {r.n for r in metrics.histogram(df.limit(0), "v", metrics.STEP_BOUNDS).collect()} == {0}
    assert metrics.STEP_BOUNDS[0] == 1 and metrics.STEP_BOUNDS[-1] == 96 and len(metrics.STEP_BOUNDS) == 20
    assert metrics.share(df, F.col("v") == 100).first().n == 4


def test_registry(spark):
    r = registry.standard()
    assert len(r.definitions()) == 6
    with pytest.raises(ValueError, match="already"):
        r.register(r.tools["glob"])
    with pytest.raises(KeyError):
        r.execute("nothing")
    assert r.execute("glob", spark.createDataFrame([("a.go",), (".git/x.go",)], "p string"), "p", "**/*.go").count() == 1
