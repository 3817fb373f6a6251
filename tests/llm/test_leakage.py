import random

import numpy as np
import pytest

from tracewake.llm import leakage

DOC = "doc_id long, text string, item_id long, tokens string"
ITEM = "item_id long, text string, lang string"


def found(spark, docs, items, **k):
    return {(r.doc_id, r.item_id): r for r in leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **k).collect()}


def runs(got):
    return {k for k, r in got.items() if r.run_tokens >= leakage.MIN_RUN}


def brute(docs, items, n=leakage.MIN_RUN):
    grams = lambda t: {tuple(k[i : i + n]) for k in [leakage.TOKEN.findall((t or "").lower())] for i in range(len(k) - n + 1)}
    g = [(i, grams(t)) for i, t, *_ in items if i is not None]
    return {(d, i) for d, t, *_ in docs if d is not None for i, s in g if grams(t) & s}


def sample():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(60)), "en") for i in range(20)]
    items += [(100, "判断助手断言函数为叶子节点是否成立并列出调用参数的个数和名称", "zh"), (101, "too short to match", "en"), (102, None, None), (None, "x " * 30, None), (103, "a b " * 40, "en"), (0, items[0][1], "again")]
    docs = []
    for d in range(200):
        words = [word() for _ in range(r.randint(0, 120))]
        item = r.choice(items[:20])[1].split()
        n = r.choice([0, 5, 19, 20, 21, 40, 60])
        a = r.randint(0, 60 - n)
        at = r.randint(0, len(words))
        docs.append((d, " ".join(words[:at]) + ", " + "-".join(item[a : a + n]).upper() + ".\n" + " ".join(words[at:]), 1, "x"))
    docs += [(900, "前文：判断助手断言，函数为叶子节点是否成立；并列出调用参数。后文", 1, ""), (901, None, None, None), (None, "x", None, None), (902, "", None, None), (903, "a b " * 15, None, None), (904, items[0][1] + " " + items[1][1], None, None)]
    return docs, items


def test_partial_and_whole_leaks(spark):
    docs, items = sample()
    got = found(spark, docs, items)
    assert runs(got) == brute(docs, items)
    assert {(904, 0), (904, 1), (900, 100), (903, 103)} <= set(got)
    assert got[904, 0].run_tokens == 60 and abs(got[904, 0].similarity - 1) < 1e-9
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


def test_joined_blocks_give_the_same(spark):
    docs, items = sample()
    near = [(1000 + i, changed(t, 30, i), None, None) for i, t, _ in items[:20]]
    sent, joined = (found(spark, docs + near, items, similarity=0.5, index_bytes=n) for n in (leakage.INDEX_BYTES, 0))
    assert {k: (r.run_tokens, round(r.similarity, 9)) for k, r in sent.items()} == {k: (r.run_tokens, round(r.similarity, 9)) for k, r in joined.items()}


def changed(text, every, seed=0):
    """The text with one token in every `every` replaced."""
    w = text.split()
    for k in range(seed % every, len(w), every):
        w[k] = f"new{k}x{seed}"
    return " ".join(w)


@pytest.mark.parametrize(("every", "similarity"), [(45, leakage.SIMILARITY), (30, 0.65), (15, 0.35)])
def test_near_copies_at_their_similarity(spark, every, similarity):
    """Recall of copies with a changed token in every 45, 30 or 15, which leaves 0.8, 0.7 or 0.5 of the shingles."""
    r = random.Random(every)
    vocabulary = ["w" + "".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(4000)] + ["the", "of", "a", "and"] * 300
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 135))), "en") for i in range(240)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) + " " + changed(t, every, i) + " " + " ".join(r.choice(vocabulary) for _ in range(40)), None, None) for i, t, _ in items]
    got = found(spark, docs, items, similarity=similarity)
    exact = found(spark, docs, items, similarity=similarity, radius=0, near_radius=0)
    assert sum((i, i) in got for i in range(240)) / 240 >= 0.9
    assert all(d == i for d, i in got) and set(exact) <= set(got)
    if every == 15:  # no run of 20 is left: the radius finds them
        assert not runs(got) and len(exact) < 24


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(1)
    for near, radius, flips in ((False, leakage.RADIUS, 5), (True, leakage.NEAR_RADIUS, 16)):
        base = r.integers(0, 2**63, 60).astype(np.uint64)
        index = leakage.WindowIndex(base, np.zeros(60, int), np.zeros(60, int), radius, near)
        prints = base[r.integers(0, 60, 600)]
        for _ in range(flips):
            prints = np.where(r.random(600) < 0.7, prints ^ (np.uint64(1) << r.integers(0, 64, 600).astype(np.uint64)), prints)
        d, i = index.candidates(prints)
        want = np.nonzero(np.bitwise_count(prints[:, None] ^ base[None, :]) <= radius)
        assert len(d) and set(zip(d.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in want), strict=True))


def test_document_windows_equal_item_windows():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 2**63, n).astype(np.uint64) for n in (0, 14, 15, 64, 131, 260)]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    got = [(size, int(a), int(p)) for size, at, prints in leakage.document_prints(np.concatenate(docs), first, [15, 60, 240]) for a, p in zip(at, prints, strict=True)]
    want = []
    for size in (15, 60, 240):
        for f, d in zip(first, docs, strict=False):
            starts = np.arange(0, len(d) // 5 * 5 - size + 1, 5)
            want += [(size, int(f + s), int(p)) for s, p in zip(starts, leakage.item_prints(d, size, starts), strict=True)] if len(starts) else []
    assert sorted(got) == sorted(want)


def test_very_long_document(spark):
    item = " ".join(f"k{i}" for i in range(40))
    docs = [(1, "filler words here " * 100_000 + item, None, None)]
    assert set(found(spark, docs, [(5, item, "en")])) == {(1, 5)}
