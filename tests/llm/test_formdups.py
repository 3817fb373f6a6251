import datetime
import itertools
import json
import random
import re

from tracewake.llm import formdups

SCHEMA = "id string, input_diff string, input_desc string, loaded_at timestamp, key string, hot boolean, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *([None] if len(r) == 3 else []), "clash", True, 3) for r in rows], SCHEMA)


def pairs(spark, rows):
    return sorted(tuple(r) for r in formdups.same_pairs(frame(spark, rows)).collect())


D1 = "diff --git a/x b/x\n+Straße = 1\n"
D2 = "diff --git a/y b/y\n+其他 line\n"


def test_forms_of_one_record(spark):
    rows = [
        ("1", D1 + D2, "Team: a; Ticket: B-1"),
        ("2", D2 + D1, "ticket:b1\nTEAM : A."),
        ("3", (D2 + D1).upper().replace("\n", "  \r\n"), '{"ticket": "B-1", "team": "A"}'),
        ("4", D1 + D2, "Team a Ticket B-1"),
        ("5", D1, "Team: a; Ticket: B-1"),
        ("6", D1 + D2, "Team: a; Ticket: B-2"),
        ("7", None, " "),
        ("8", "", None),
        ("9", D1, '{"broken": '),
        ("a", D1, "broken"),
        (None, D1, "broken"),
        ("1", D1 + D2, "Team: a; Ticket: B-1"),
    ]
    got = pairs(spark, rows)
    assert {("1", "2"), ("1", "3"), ("2", "3"), ("7", "8"), ("9", "a")} <= set(got)
    assert not {x for p in got for x in p} & {"5", "6"}


def test_records_and_copies(spark):
    rows = [(f"{i:04}", D1 if i % 3 == 0 else f"only {i}", None) for i in range(90)] + [("0000", D1, None)]
    got = {r.record_id: r.copies for r in formdups.distinct_records(frame(spark, rows)).collect()}
    assert got["0000"] == 30 and len(got) == 61 and sum(got.values()) == 90
    assert formdups.distinct_records(frame(spark, [])).count() == 0 and pairs(spark, []) == []


def test_the_first_delivery_of_an_id_counts(spark):
    t = [datetime.datetime(2024, 1, k) for k in (1, 2)]
    rows = [("a", "one", None, t[0]), ("a", "two", None, t[1]), ("b", "one", None, t[1]), ("c", "two", None, t[0])]
    assert pairs(spark, rows) == [("a", "b")]
    assert {r.id: r.record_id for r in formdups.membership(frame(spark, rows)).collect()} == {"a": "a", "b": "a"}


def test_hot_key_in_two_levels_equals_one(spark, monkeypatch):
    monkeypatch.setattr(formdups, "MIN_HOT", 5)
    monkeypatch.setattr(formdups, "HOT_KEYS", 10)
    rows = [(f"{i:04}", D1 if i % 2 else f"t {i}", None) for i in range(80)]
    got = pairs(spark, rows)
    hot = [f"{i:04}" for i in range(80) if i % 2]
    assert got == sorted(itertools.combinations(hot, 2))
    assert {r.record_id: r.copies for r in formdups.distinct_records(frame(spark, rows)).collect()}["0001"] == 40


def brute_key(diff, desc):
    an = lambda s: "".join(c for c in (s or "").casefold() if c.isalnum())
    parts = re.split(r"(?mi)^(?=diff --git)", diff or "")
    head = an(parts[0]) + "".join(sorted(map(an, parts[1:])))
    try:
        o = json.loads(desc or "")
        fields = [k + v for k, v in o.items()] if isinstance(o, dict) else []
    except ValueError:
        fields = [f for f in re.split("[;|\r\n]+", desc or "") if f.strip()]
        fields = fields if len(fields) > 1 and all(re.match(r"\s*[A-Za-z]+\s*:", f) for f in fields) else []
    return head, "".join(sorted(map(an, fields))) if fields else an(desc)


def test_random_forms_equal_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(200):
        files = r.sample([D1, D2, "diff --git a/z b/z\n-gone\n"], r.randint(0, 3))
        text = "".join(files)
        text = r.choice([str.upper, str.lower, lambda s: s.replace(" ", "  "), lambda s: s])(text)
        fields = r.sample([("Team", "a b"), ("Ticket", "B-1"), ("Risk", "low")], r.randint(0, 3))
        sep = r.choice(["; ", "\n", " | "])
        desc = json.dumps(dict(fields)) if r.random() < 0.3 else sep.join(f"{k}{r.choice([':', ' : '])} {v}" for k, v in fields)
        rows.append((f"{i:04}", text or None, desc))
    keys = {}
    for i, a, b in rows:
        keys.setdefault(brute_key(a, b), []).append(i)
    want = sorted(p for v in keys.values() for p in itertools.combinations(sorted(v), 2))
    assert pairs(spark, rows) == want
