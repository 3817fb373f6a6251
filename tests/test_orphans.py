from datetime import datetime as D

from tracewake.operators import orphans

A, B, C = "11111111-2222-3333-4444-555555555555", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", "99999999-2222-3333-4444-555555555555"
TASK = "id string, loaded_at timestamp, key string, n int"
CHILD = "id string, task_id string, created_at timestamp, loaded_at timestamp, row_id string, salt int"
GONE = "task_id string, deleted_at timestamp, restored_at timestamp"


def sides(spark, tasks, gone, children):
    return orphans.parents_of(spark.createDataFrame(tasks, TASK), spark.createDataFrame(gone, GONE)), orphans.children_of({"feedback": spark.createDataFrame(children, CHILD)})


def rows(spark, tasks, gone, children):
    return sorted((r.row_id, r.reason) for r in orphans.orphan_rows(*sides(spark, tasks, gone, children)).collect())


def test_reasons_spellings_and_nulls(spark):
    t, late = D(2024, 1, 2), D(2024, 3, 1)
    tasks = [(A, t, "x", 1), (A, late, "x", 1), (B, late, None, None), (C, t, "y", 2), (None, None, None, None)]
    gone = [(C.upper(), t, None), (A, t, late), (None, t, None)]
    children = [
        ("ok", A, t, t, "z", 0),
        ("spelled", "{" + A.upper() + "} ", t, t, "z", 0),
        ("bare", A.replace("-", ""), t, t, None, None),
        ("late", B, t, t, None, None),
        ("late-twice", B, t, D(2024, 4, 1), None, None),
        ("late-twice", B, t, t, None, None),
        ("deleted", C, t, t, None, None),
        ("missing", A[:-1] + "0", None, t, None, None),
        ("text", "unknown", t, t, None, None),
        ("text2", A[:18], t, t, None, None),
        ("null", None, t, t, None, None),
        ("blank", " \t　", t, t, None, None),
        (None, "unknown", t, t, None, None),
        ("no time", B, t, None, None, None),
    ]
    assert rows(spark, tasks, gone, children) == [("deleted", "deleted"), ("late", "late"), ("late-twice", "late"), ("missing", "missing"), ("text", "missing"), ("text2", "missing")]


def test_empty_tables(spark):
    assert rows(spark, [], [], []) == []
    assert rows(spark, [], [], [("a", A, None, None, None, None)]) == [("a", "missing")]


def test_hot_key_is_salted_and_counted_whole(spark):
    children = [(f"r{i}", B, D(2024, 1 + i % 3, 1), D(2024, 1, 1), None, None) for i in range(3000)] + [("x", C, None, D(2024, 1, 1), None, None)]
    both = sides(spark, [], [], children)
    assert orphans.orphan_rows(*both).count() == 3001
    counts = {(r.period, r.orphans) for r in orphans.orphan_counts(*both).collect()}
    assert counts == {("2024-01", 1000), ("2024-02", 1000), ("2024-03", 1000), (None, 1)}


def test_counts_equal_the_rows(spark):
    """Parents loaded before, among and after their children, of several child tables and periods."""
    import random
    from collections import Counter

    r = random.Random(5)
    keys = [f"{i:08x}-2222-3333-4444-555555555555" for i in range(12)]
    day = lambda: D(2024, r.randint(1, 3), r.randint(1, 28))
    tasks = [(k, r.choice((day(), day(), None)), None, None) for k in keys[:9] for _ in range(r.randint(1, 2))]
    gone = [(keys[3], day(), None), (keys[4], day(), day())]
    children = [(f"c{i}", r.choice(keys), r.choice((day(), None)), r.choice((day(), day(), None)), None, None) for i in range(400)]
    parents, one = sides(spark, tasks, gone, children)
    two = orphans.children_of({"other": spark.createDataFrame(children[:150], CHILD)}, parent="tasks")
    elsewhere = orphans.children_of({"third": spark.createDataFrame(children[:50], CHILD)}, parent="no such table")
    kids = one.unionByName(two).unionByName(elsewhere)
    want = Counter((x.source_table, x.period, x.reason) for x in orphans.orphan_rows(parents, kids).collect())
    got = {(x.source_table, x.period, x.reason): x.orphans for x in orphans.orphan_counts(parents, kids).collect()}
    assert got == want and sum(n for (t, _, reason), n in got.items() if t == "third" and reason == "missing") == 50
    assert {reason for _, _, reason in got} == {"missing", "deleted", "late"}


def test_the_first_delivery_decides(spark):
    t, u = D(2024, 1, 2), D(2024, 2, 2)
    children = [("a", A, u, u, None, None), ("a", C, t, t, None, None), ("b", C, u, u, None, None), ("b", A, t, t, None, None), ("tie", C, u, t, None, None), ("tie", A, t, t, None, None)]
    both = sides(spark, [(A, t, None, None)], [], children)
    assert sorted((x.row_id, x.period) for x in orphans.orphan_rows(*both).collect()) == [("a", "2024-01")]
