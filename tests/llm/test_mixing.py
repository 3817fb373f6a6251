import itertools
from pathlib import Path

import pytest

from tracewake.llm import mixing

pytestmark = pytest.mark.skipif(not Path(mixing.VOCABULARY).exists(), reason="needs the vocabulary file")
DOC = "doc_id long, text string, source string, tokens long, pattern string, members string"
TARGET = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets):
    d = spark.createDataFrame([(*r, 1, "c", "c") for r in docs], DOC)
    t = spark.createDataFrame(targets, TARGET)
    chosen = mixing.mixture(d, t)
    return {(r.doc_id, r.source): r for r in chosen.collect()}, {r.source: r for r in mixing.shares(chosen, t).collect()}


def text(i, n=40):
    return " ".join(f"w{(i * 37 + k) % 997}" for k in range(n))


def test_shares_caps_and_names(spark):
    docs = [(i, text(i), "Big") for i in range(300)] + [(1000 + i, text(1000 + i), ["small src", "SMALL-SRC", "small_src"][i % 3]) for i in range(20)] + [(2000, text(5000), "unlisted"), (2001, None, "big"), (2002, "", "big"), (2003, text(1), None), (None, text(2), "big")]
    chosen, shares = mix(spark, docs, [("big", 0.6, 1), ("small-src", 0.3, 4), ("absent", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1), ("null", None, None)])
    assert abs(shares["small-src"].actual_share - 1 / 3) < 0.02 and abs(shares["big"].actual_share - 2 / 3) < 0.02 and shares["absent"].tokens == 0
    assert {r.repeats for (_, s), r in chosen.items() if s == "small-src"} == {4} and {r.repeats for (_, s), r in chosen.items() if s == "big"} == {1}
    assert sum(s == "small-src" for _, s in chosen) == 20 and not {2000, 2001, 2002, 2003} & {d for d, _ in chosen}


def test_copies_and_overlap_count_once(spark):
    docs = [(i, text(i % 10), "a") for i in range(30)] + [(100 + i, text(i), "b") for i in range(10)] + [(200 + i, text(200 + i), "b") for i in range(10)]
    chosen, shares = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    uses = {}
    for (d, _), r in chosen.items():
        t = text(d % 10) if d < 30 else text(d - 100) if d < 200 else text(d)
        uses[t] = uses.get(t, 0) + r.repeats
    assert max(uses.values()) == 1 and shares["a"].docs == 10 and shares["b"].docs == 10


def test_empty(spark):
    assert mix(spark, [], [("a", 1.0, 1)]) [0] == {}
    assert mix(spark, [(1, text(1), "a")], [])[0] == {}


def test_seeded_and_repeatable(spark):
    docs = [(i, text(i), "a" if i < 100 else "b") for i in range(130)]
    one, two = (mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)])[0] for _ in range(2))
    assert {k: r.repeats for k, r in one.items()} == {k: r.repeats for k, r in two.items()}


def brute(patterns, share, repeats):
    """Largest total by trying every split of small integer capacities."""
    names = sorted(share)
    best = 0
    options = [[x for x in itertools.product(*[range(size * repeats[s] + 1) for s in sources])] for sources, size in patterns]
    for pick in itertools.product(*options):
        got = dict.fromkeys(names, 0)
        for (sources, _), x in zip(patterns, pick, strict=True):
            for s, n in zip(sources, x, strict=True):
                got[s] += n
        best = max(best, min(int((got[s] + 1) / share[s] - 1e-9) for s in names))
    return best


def test_flow_is_the_largest_exact_mixture():
    patterns = [(("a",), 3), (("a", "b"), 2), (("b",), 1)]
    share, repeats = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    total, flow = mixing.plan_flow(patterns, share, repeats)
    got = {s: sum(n for (_, x), n in flow.items() if x == s) for s in share}
    assert got == {s: int(total * share[s]) for s in share}
    assert total == brute(patterns, share, repeats)
    assert all(n <= patterns[i][1] * repeats[s] for (i, s), n in flow.items())


def least_cost(patterns, quota, repeats):
    """Cost of every way to meet the quotas, one token at a time; the least."""
    names = sorted(quota)
    best = None
    options = [[x for x in itertools.product(*[range(size * repeats[s] + 1) for s in sources])] for sources, size in patterns]
    for pick in itertools.product(*options):
        got = dict.fromkeys(names, 0)
        for (sources, _), x in zip(patterns, pick, strict=True):
            for s, n in zip(sources, x, strict=True):
                got[s] += n
        if got == quota:
            cost = sum(sum(t // size for t in range(sum(x))) for (_, size), x in zip(patterns, pick, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_flow_has_the_least_cost():
    import random

    r = random.Random(3)
    for _ in range(40):
        names = ["a", "b", "c"]
        patterns = [(tuple(sorted(r.sample(names, r.randint(1, 2)))), r.randint(1, 2)) for _ in range(3)]
        share = dict(zip(names, (0.5, 0.25, 0.25), strict=True))
        repeats = {s: r.randint(1, 2) for s in names}
        total, flow = mixing.plan_flow(patterns, share, repeats)
        got = {s: sum(n for (_, x), n in flow.items() if x == s) for s in {s for sources, _ in patterns for s in sources}}
        cost = sum(sum(t // size for t in range(sum(n for (i, _), n in flow.items() if i == k))) for k, (_, size) in enumerate(patterns))
        assert cost == least_cost(patterns, got, repeats)


def test_many_patterns_are_planned_in_seconds():
    import random
    import time

    r = random.Random(1)
    names = [f"s{k:02}" for k in range(16)]
    patterns = {}
    while len(patterns) < 60_000:
        patterns[tuple(sorted(r.sample(names, min(16, 1 + int(r.expovariate(0.25))))))] = int(r.paretovariate(1.1) * 1000)
    share = {s: 1 / 16 for s in names}
    t = time.time()
    for n in (1000, 60_000):
        some = list(patterns.items())[:n]
        total, flow = mixing.plan_flow(some, share, {s: k % 5 + 1 for k, s in enumerate(names)})
        for s in names:
            assert sum(n for (_, x), n in flow.items() if x == s) == int(total / 16)
    assert time.time() - t < 30


def test_patterns_beyond_the_bound_keep_shares_and_caps(spark, monkeypatch):
    docs = [(10 * i + k, text(i), s) for i in range(120) for k, s in enumerate(("a", "b", "c")) if (i % 7 + 1) >> k & 1]
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3)]
    _, whole = mix(spark, docs, targets)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    chosen, part = mix(spark, docs, targets)
    assert all(abs(part[s].tokens - whole[s].tokens) < 150 and r.most_repeats <= {"a": 2, "b": 1, "c": 3}[s] for s, r in part.items() for r in [part[s]])
    t = spark.createDataFrame(targets, TARGET)
    d = spark.createDataFrame([(*r, 1, "c", "c") for r in docs], DOC)
    assert {tuple(r) for r in mixing.kept(mixing.mixture(d, t), t).collect()} == {(s, True, True, True) for s in "abc"}


def test_repeats_are_used_last():
    total, flow = mixing.plan_flow([(("a",), 100), (("a", "b"), 100), (("b",), 100)], {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})
    assert total == 400 and flow[1, "a"] == flow[1, "b"] == 100  # the shared text serves each source once
    total, flow = mixing.plan_flow([(("a",), 100), (("a", "b"), 100), (("b",), 100)], {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 300)
    assert total == 300 and flow.get((1, "a"), 0) + flow.get((1, "b"), 0) == 100  # within the budget nothing is used twice
