import random
from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from tracewake.operators import history, slices

SCHEMA = "id string, repo_name string, symbol string, summary string, file_path string, commit_hash string, created_at timestamp, loaded_at timestamp, slice int, at string, value string"


def run(spark, rows, attributes=("summary",), min_hot=history.MIN_HOT):
    df = spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], SCHEMA)
    out = history.history(df, ["repo_name", "symbol"], {a: history.normal_text(F.col(a)) for a in attributes}, min_hot=min_hot)
    return sorted(([r[c] for c in out.columns] for r in out.collect()), key=str)


def test_first_of_commit_case_and_nulls(spark):
    t = D(2024, 1, 1)
    rows = [
        ("1", "r", "s", "One  thing", "f", "AB", t, t),
        ("2", "r", "s", "other", "f", " ab ", t + timedelta(seconds=9), t + timedelta(days=1)),  # second write of the commit
        ("3", "r", "s", "one THING", "f", "cd", t + timedelta(days=1), t),  # same text
        ("4", "r", "s", None, "f", "ef", t + timedelta(days=2), t),
        ("5", "r", "s", " ", "f", "gh", t + timedelta(days=2), t),
        ("6", "r", "s", "two", "f", None, t + timedelta(days=3), t),
        ("7", "r", "s", "one thing", "f", "", t + timedelta(days=4), t),
        ("8", None, None, "x", "f", "zz", t, None),
        ("9", "r", "s", "never", "f", "yy", None, t),
    ]
    got = run(spark, rows)
    assert ["r", "s", "One  thing", t, t + timedelta(days=3)] in got
    assert ["r", "s", "two", t + timedelta(days=3), t + timedelta(days=4)] in got
    assert ["r", "s", "one thing", t + timedelta(days=4), None] in got
    assert [None, None, "x", t, None] in got
    assert len(got) == 4


def test_empty(spark):
    assert run(spark, []) == []


def brute(rows, attributes):
    """Versions by replaying the observations of each entity in order."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        first.setdefault((r[1], r[2], r[5]), r)
    out = {}
    for r in sorted(first.values(), key=lambda r: (r[6], r[7], r[0])):
        versions = out.setdefault((r[1], r[2]), [])
        now = dict(versions[-1][1]) if versions else dict.fromkeys(attributes)
        for a in attributes:
            v = r[{"summary": 3, "file_path": 4}[a]]
            now[a] = v if v is not None else now[a]
        if any(v is not None for v in now.values()) and (not versions or versions[-1][1] != now):
            if versions and versions[-1][0] == r[6]:
                versions.pop()
                if versions and versions[-1][1] == now:
                    continue
            versions.append((r[6], now))
    return sorted([[*k, *[n[a] for a in attributes], at, vs[i + 1][0] if i + 1 < len(vs) else None] for k, vs in out.items() for i, (at, n) in enumerate(vs)], key=str)


def random_rows(n, keys, seed):
    r = random.Random(seed)
    t = D(2024, 1, 1)
    return [
        (f"{i:05}", "r", r.choice(keys), r.choice(["a", "b", "c", None]), r.choice(["f", "g", None]), f"c{i}", t + timedelta(minutes=i * 3 + r.randint(0, 2)), t + timedelta(days=r.randint(0, 9)))
        for i in range(n)
    ]


def test_attributes_split_and_coalesce_like_replay(spark):
    rows = random_rows(300, ["s", "t", "u"], 3)
    assert run(spark, rows, ("summary", "file_path")) == brute(rows, ("summary", "file_path"))


def test_hot_entity_in_slices_equals_replay(spark):
    rows = random_rows(900, ["hot", "hot", "hot", "t"], 5)
    assert run(spark, rows, ("summary",), min_hot=100) == brute(rows, ("summary",))
    assert run(spark, rows, ("summary", "file_path"), min_hot=100) == brute(rows, ("summary", "file_path"))


def test_hot_entity_at_one_instant_is_split(spark):
    t = D(2024, 1, 1)
    r = random.Random(2)
    rows = [(f"{i:05}", "r", "hot", r.choice("ab"), "f", f"c{i}", t, t + timedelta(seconds=r.randint(0, 3))) for i in range(900)]
    df = spark.createDataFrame([(*x, 7, "clash", "clash") for x in rows], SCHEMA)
    obs = history.first_of_commit(df, ["repo_name", "symbol"], ["summary"], "commit_hash", "created_at", "loaded_at", "id")
    sliced, hot = slices.sliced(obs, ["repo_name", "symbol"], ["at", "loaded", "row_id"], 100)
    sizes = [x["count"] for x in sliced.groupBy("slice").count().collect()]
    assert hot and len(sizes) > 30 and max(sizes) < 100
    plain, split = (run(spark, rows, ("summary",), min_hot=n) for n in (10_000, 100))
    assert plain == split and len(run(spark, rows, ("summary", "file_path"), min_hot=100)) == 1
