import json

from tracewake.operators import shred

SCHEMA = "id string, call_chain string, entry_points string, loaded_at timestamp, label string, row_id string"


def items(spark, rows):
    df = spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in shred.labelled_items(df).collect())


def test_tables_follow_the_schema_graph():
    assert shred.own_tables(shred.GRAPH, "analysis_result") == {"analysis_result", "call_chain", "call_node", "call_edge", "entry_point", "scenario", "tag", "function_ref"}
    recursive = {"a": (shred.Edge("b", "b"),), "b": (shred.Edge("a", "a"), shred.Edge("c", "c")), "c": ()}
    assert shred.own_tables(recursive, "a") == {"a", "b"}


def test_writers_wrappers_nulls_and_positions(spark):
    chain = [{"Function": "f0"}, None, {"func_name": "f2"}, {"symbol": ""}, {"func_name": None}]
    result = {"downward_chain": {"nodes": [{"func_name": "d"}], "edges": [{"from": {"func_name": "x"}, "to": {"func_name": "y"}}]}, "upward_chains": [{"nodes": [{"func_name": "u"}]}, None, {"nodes": [None, {"func_name": "v"}]}], "entry_points": [{"node": {"func_name": "e"}, "test_scenarios": ["s1", None, "s2"]}]}
    rows = [
        ("bare", json.dumps(chain), json.dumps([{"Function": "b0"}, None, {"node": None, "test_scenarios": ["only"]}])),
        ("result", json.dumps(result), "null"),
        ("wrapped", json.dumps({"version": 2, "result": json.dumps(result)}), json.dumps(json.dumps({"node": {"symbol": "w"}, "protocol": "CLI"}))),
        ("broken", json.dumps(chain)[:-2], "[" ),
        ("none", None, None),
        ("blank", "", " "),
        ("scalar", "3", "true"),
        ("empty", "{}", "[]"),
        ("deep", "[" * 200_000 + "]" * 200_000, '{"a":' * 100_000 + "1" + "}" * 100_000),
        (None, json.dumps(chain), None),
    ]
    got = items(spark, rows)
    assert [g[1:] for g in got if g[0] == "bare"] == [("call_chain", 0, 0, "f0"), ("call_chain", 0, 2, "f2"), ("entry_points", 0, 0, "b0"), ("entry_scenarios", 2, 0, "only")]
    whole = [("call_chain", 0, 0, "d"), ("entry_points", 0, 0, "e"), ("entry_scenarios", 0, 0, "s1"), ("entry_scenarios", 0, 2, "s2"), ("upward_chains", 0, 0, "u"), ("upward_chains", 2, 1, "v")]
    assert [g[1:] for g in got if g[0] == "result"] == whole
    assert [g[1:] for g in got if g[0] == "wrapped"] == [("call_chain", 0, 0, "d"), ("entry_points", 0, 0, "w"), *whole[4:]]
    assert {g[0] for g in got} == {"bare", "result", "wrapped"}


def test_foreign_keys_join(spark):
    result = {"downward_chain": {"nodes": [{"func_name": "d", "note": {"by": "me", "tags": ["t1", "t2"]}}], "edges": [{"from": {"func_name": "x"}, "to": {"func_name": "y"}}], "direction": "downward"}, "impact_summary": {"direct_count": 3, "direct_functions": ["d"]}}
    df = spark.createDataFrame([("a", json.dumps(result), None, None, None, None)], SCHEMA)
    rows, graph = shred.flat_tables(df)
    assert shred.own_tables(graph, "analysis_result") == shred.own_tables(shred.GRAPH, "analysis_result")
    nodes, edges, roots = (shred.flat_table(rows, t) for t in ("call_node", "call_edge", "analysis_result"))
    assert nodes.join(edges.selectExpr("row_id AS parent_id"), "parent_id").count() == 2
    assert {(r.role, r.func_name) for r in nodes.collect()} == {("nodes", "d"), ("from", "x"), ("to", "y")}
    assert [r.note_by for r in nodes.collect() if r.func_name == "d"] == ["me"]
    assert [r.impact_summary_direct_count for r in roots.collect()] == ["3"]
    tags = shred.flat_table(rows, "tag")
    assert tags.join(nodes.selectExpr("row_id AS parent_id"), "parent_id").count() == 2
    assert {c for t in shred.GRAPH if t in shred.own_tables(graph, "analysis_result") for c in shred.flat_table(rows, t).columns} >= {"task_id", "direction", "note_by", "protocol", "description", "tag", "other"}
    assert rows.where("parent_id IS NOT NULL").join(rows.selectExpr("row_id AS parent_id"), "parent_id", "left_anti").count() == 0


def test_repeats_long_and_empty(spark):
    long = json.dumps([{"func_name": f"f{i}"} for i in range(20000)])
    assert len(items(spark, [("a", long, None), ("a", long, None)])) == 20000
    assert items(spark, []) == []


def test_wrappers_of_any_depth_and_several_containers(spark):
    node = [{"func_name": "x"}]
    deep = node
    for k in range(40):
        deep = {"a": deep} if k % 2 else json.dumps({"b": deep})
    rows = [("deep", json.dumps(deep), None), ("two", json.dumps({"extra": [1], "data": node, "more": {}}), None), ("seven", json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": node}}}}}}}), None)]
    rows.append(("far", '{"a":' * 5000 + json.dumps(node) + "}" * 5000, None))
    assert items(spark, rows) == sorted((i, "call_chain", 0, 0, "x") for i, *_ in rows)


def test_unknown_fields_are_kept_and_the_graph_follows_the_data(spark):
    """Unknown scalars stay as attributes; unknown objects become elements, inlined or with tables as the data show."""
    node = {"func_name": "f", "weight": 3, "owner_team": "own", "owner": {"team": "a", "lead": {"mail": "m"}}, "calls": [{"at": 1}, {"at": 2}], "self": {"self": {"deep": True}}, "words": ["p", None, "q"]}
    df = spark.createDataFrame([("a", json.dumps([node, {"func_name": "g", "note": [{"by": "x"}, {"by": "y"}]}]), None, None, None, None)], SCHEMA)
    rows, graph = shred.flat_tables(df)
    got = rows.collect()
    f = next(r for r in got if r.label == "f")
    assert f.attributes == {"func_name": "f", "weight": "3", "ownerteam": "own", "owner_team": "a", "owner_lead_mail": "m"}
    assert [r.attributes for r in got if r.table_name == "calls"] == [{"at": "1"}, {"at": "2"}] and {r.attributes["value"] for r in got if r.table_name == "words"} == {"p", "q"}
    assert {(r.row_id, r.parent_id) for r in got if r.table_name == "self"} == {(f.row_id + ".self", f.row_id), (f.row_id + ".self.self", f.row_id + ".self")}
    assert "note" in shred.own_tables(graph, "analysis_result") and sorted(r.attributes["by"] for r in got if r.table_name == "note") == ["x", "y"]
    assert {r.table_name for r in shred.other_tables(rows).collect()} == {"calls", "self", "words"}
    assert json.loads(next(r.other for r in shred.flat_table(rows, "call_node").collect() if r.func_name == "f")) == {"weight": "3", "ownerteam": "own", "owner_team": "a", "owner_lead_mail": "m"}


def test_deep_json_equals_the_standard_reader():
    import random

    import pytest

    from tracewake.functions import deepjson

    r = random.Random(1)

    def value(d):
        k = r.randint(0, 8 if d else 5)
        return [None, True, False, r.randint(-99, 99), r.random() * 1e9, 'é"\\n', *([[value(d - 1) for _ in range(r.randint(0, 4))], {f"k{i}": value(d - 1) for i in range(r.randint(0, 4))}, []] if d else [])][k]

    for _ in range(300):
        v = value(5)
        assert deepjson._read(json.dumps(v, indent=r.choice((None, 1)))) == v
    for bad in ("", "[", "[1,]", '{"a"}', '{"a":}', "[1 2]", "{1:2}", "[1]]", "x", '{"a":1,}', '["a]'):
        with pytest.raises(ValueError):
            deepjson._read(bad)
    x = deepjson.loads("[" * 300_000 + "]" * 300_000)
    n = 0
    while x:
        x, n = x[0], n + 1
    assert n == 299_999
