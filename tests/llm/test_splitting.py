import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewake.llm import splitting

SCHEMA = "id string, input_diff string, loaded_at timestamp, t string, piece string"


def check(text, limit, overlap=3):
    parts = splitting.split_text(text, limit, overlap)
    assert "".join(p.encode()[o:].decode() for o, _, _, p in parts) == text
    assert all(len(p.encode()) <= limit for *_, p in parts)
    for (_, _, _, a), (o, _, _, b) in zip(parts, parts[1:], strict=False):
        assert a.encode().endswith(b.encode()[:o])
    return parts


def test_natural_boundaries_win():
    body = "".join(f"+line {i} of the change\n" for i in range(40))
    text = "".join(f"diff --git a/f{k} b/f{k}\n@@ -1 +1 @@\n{body}" for k in range(4))
    parts = check(text, 1300)
    assert [p.encode()[o:].decode()[:10] for o, _, _, p in parts] == ["diff --git"] * 4
    assert all(p[:o].count("\n") == 3 for o, _, _, p in parts[1:])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\r中é\t+@"), max_size=900), st.integers(40, 200), st.integers(0, 4))
def test_round_trip_and_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_three_lines_are_shared_when_lines_are_short():
    r = random.Random(1)
    text = "".join("x" * r.randint(0, 60) + "\r\n" for _ in range(900))
    parts = check(text, splitting.LIMIT)
    assert len(parts) > 3 and all(p[:o].count("\n") == 3 for o, _, _, p in parts[1:])


def test_long_line_and_very_long_text():
    check("中" * 9000, 6000)
    check("word " * 5000 + "\n" + "y" * 20000, 6000)
    assert len(check("+some line of code here\n" * 100_000, 6000)) > 400


def brute(text, limit, overlap):
    """Least cost over all cut sets, by recursion."""
    import functools

    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    size = [0]
    for u in units:
        size.append(size[-1] + len(u))
    even = size[-1] / -(-size[-1] // limit)

    def shared(i):
        s = max(0, i - overlap)
        while s < i and size[i] - size[s] > limit // 2:
            s += 1
        return s

    def penalty(i):
        return splitting.PENALTY_FILE if units[i].startswith("diff --git") else splitting.PENALTY_HUNK if units[i].startswith("@@") else splitting.PENALTY_LINE

    @functools.cache
    def best(i):
        if i == len(units):
            return 0.0
        out = float("inf")
        for j in range(i + 1, len(units) + 1):
            if size[j] - size[shared(i)] > limit:
                break
            out = min(out, splitting.IMBALANCE * ((size[j] - size[i]) / even - 1) ** 2 + (penalty(j) if j < len(units) else 0) + best(j))
        return out

    return best(0), size, even, penalty


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["diff --git a b\n", "@@ -1 +1 @@\n", "+" + "x" * r.randint(0, 9) + "\n"]) for _ in range(30))
    limit = 90
    least, size, even, penalty = brute(text, limit, 3)
    parts = splitting.split_text(text, limit, 3)
    cost, at = 0.0, 0
    for k, (o, _, _, p) in enumerate(parts):
        own = len(p) - o
        at += own
        cost += splitting.IMBALANCE * (own / even - 1) ** 2 + (penalty(size.index(at)) if k < len(parts) - 1 else 0)
    assert cost == pytest.approx(least)


def test_table(spark):
    big = "+l\n" * 4000
    rows = [("a", big, None, "clash", "clash"), ("a", big, None, "", ""), ("b", "small\ntext", None, None, None), ("e", "", None, None, None), ("n", None, None, None, None), (None, big, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = splitting.pieces(df).orderBy("id", "piece_no").collect()
    a = [r for r in got if r.id == "a"]
    assert [r.piece_no for r in a] == list(range(a[0].n_pieces)) and a[0].n_pieces == 3 and a[-1].last_line == 4000
    assert [(r.id, r.n_pieces, r.last_line, r.piece) for r in got if r.id != "a"] == [("b", 1, 2, "small\ntext"), ("e", 1, 1, "")]
    assert {r.id for r in splitting.pieces(df, keep_small=False).collect()} == {"a"}
    assert splitting.pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(df, limit=2)


def test_three_lines_are_shared_when_lines_are_long():
    r = random.Random(2)
    for low, high, least in ((1000, 1490, 3), (1600, 1800, 2)):  # three lines of 1,600 bytes and a fourth don't fit
        text = "".join("x" * r.randint(low, high) + "\n" for _ in range(60))
        parts = check(text, splitting.LIMIT)
        for o, n, _, p in parts[1:]:
            assert p[:o].endswith("\n") and text.split("\n")[n - 1] == p.split("\n")[0] and p[:o].count("\n") == least


def test_line_is_broken_only_if_it_does_not_fit_with_its_overlap():
    text = "".join("+a\n+b\n+c\n" + "w" * 4000 + "\n" + "+z\n" * 300 for _ in range(4))
    for o, n, last, p in check(text, splitting.LIMIT)[1:]:
        assert p[:o].count("\n") == 3 and text.split("\n")[n - 1] == p.split("\n")[0] and (p.endswith("\n") or last == text.count("\n"))


@pytest.mark.parametrize("limit", [4, 5, 7, 20])
def test_tiny_limits(limit):
    check("ab\n中é\n" * 9 + "x" * 50, limit)


def test_one_delivery_of_an_id_is_cut(spark):
    import datetime

    t = [datetime.datetime(2024, 1, k) for k in (1, 2)]
    big = "some words on a line\n" * 650
    rows = [("a", "short text", t[0]), ("a", big, t[1]), ("b", big, t[0]), ("b", "short text", t[1]), ("c", big, t[0]), ("c", big, t[0]), ("n", None, t[0])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    parts = splitting.pieces(df).collect()
    assert {(r.id, r.n_pieces) for r in parts} == {("a", 1), ("b", 3), ("c", 3)} and len(parts) == 7
    assert {(r.id, r.n_pieces) for r in splitting.pieces(df, keep_small=False).collect()} == {("b", 3), ("c", 3)}
    import hashlib

    whole = {r.id: r.digest for r in splitting.joined(splitting.pieces(df)).collect()}
    assert whole == {"a": hashlib.sha256(b"short text").hexdigest(), **dict.fromkeys("bc", hashlib.sha256(big.encode()).hexdigest())}


def test_cuts_go_where_the_whole_overlap_fits():
    """Three long lines leave no room for the next one, so the cuts avoid the places behind them."""
    r = random.Random(7)
    for _ in range(20):
        lines = [("x" * r.randint(10, 60)) + "\n" for _ in range(300)]
        for k in range(20, 280, 37):
            lines[k : k + 3] = ["y" * 1900 + "\n"] * 3
        parts = check("".join(lines), splitting.LIMIT)
        assert sum(p[:o].count("\n") == 3 for o, _, _, p in parts[1:]) >= 0.9 * (len(parts) - 1)
