"""Mixing sources to target weights (problem 8).

Copies of one text are one text, which may belong to several sources: its
membership pattern. The token capacity of each pattern is routed to the quotas
of its sources by a minimum-cost flow in which every further use of a pattern's
text costs more than the one before, so repeats are used last and evenly; it is
solved level by level of use, each a maximum flow by augmenting paths over arrays. The
total is the largest that gives every source its share exactly within the caps.

Documents are then selected on each pattern's line of tokens in seeded hash
order: a source owns an interval of the line (wrapping round for repeats), and a
document is used once for each time its place falls into the interval. Places are
exact prefix sums, made in two levels so that no task orders a whole pattern.

max_repeats is the number of times a source's text may be used in all (1: once).

Nulls and edge cases: source names are compared without case and with spaces and
underscores as hyphens; null or unlisted sources take no part; a null or blank
text has no tokens and is never chosen; listed sources without text get nothing
and the others share in proportion; a null or non-positive share counts as 0, null
max_repeats as 1; without any text the result is empty; ties in the hash fall to
the smaller document id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewake.session import broadcast_if_small, cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the public pre-tokenizer pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 11
#: Membership patterns planned together on the driver: all there can be of 16 sources. Of the texts in
#: smaller patterns beyond these each source plans its own share, which keeps shares and caps exact.
MAX_PATTERNS = 1 << 16
PER_BUCKET = 50_000


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s_]+", "-")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, digest, tokens; the texts go no further than this."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b["text"]]
            yield b[["doc_id", "source", "digest"]].assign(tokens=n)

    return spread(df.select("doc_id", "source", F.sha2("text", 256).alias("digest"), "text")).mapInPandas(run, "doc_id long, source string, digest string, tokens long")


class _Router:
    """Routes pattern tokens to source quotas level by level; arcs are arrays, sorted by pattern.

    Each level lets every pattern be used once more. Within a level tokens are first
    handed out greedily and then moved along augmenting paths over the sources, until
    no source that lacks tokens can be reached. Paths never lower a pattern's use, so
    the levels before stay full and the sum of the convex costs is least.
    """

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], repeats: list[int], quota: list[int]):
        self.size = np.array([n for _, n in patterns], np.int64)
        self.pattern = np.repeat(np.arange(len(patterns)), [len(s) for s, _ in patterns])
        self.source = np.fromiter((x for s, _ in patterns for x in s), np.int64, len(self.pattern))
        self.room = self.size[self.pattern] * np.array(repeats, np.int64)[self.source]
        self.flow = np.zeros(len(self.pattern), np.int64)
        self.used = np.zeros(len(patterns), np.int64)
        self.lack = np.array(quota, np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.pattern, minlength=len(patterns)))))
        order = np.argsort(self.source, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(self.source, minlength=len(quota)))))
        self.of_source = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.by_width = np.argsort(np.diff(self.first), kind="stable")

    def run(self) -> np.ndarray:
        level = 0
        while self.lack.any():
            level += 1
            self.free = np.minimum(self.size * level, np.bincount(self.pattern, self.room, len(self.size)).astype(np.int64)) - self.used
            self._hand_out()
            while self._augment():
                pass
        return self.flow

    def _hand_out(self) -> None:
        """Free tokens of each pattern, those with few sources first, to its sources in the ratio of what they lack."""
        lack, flow, room, first, source = self.lack.tolist(), self.flow.tolist(), self.room.tolist(), self.first.tolist(), self.source.tolist()
        free, used = self.free.tolist(), self.used.tolist()
        for i in self.by_width.tolist():
            arcs = range(first[i], first[i + 1])
            for _ in range(2):
                want = [min(lack[source[k]], room[k] - flow[k]) for k in arcs]
                total = sum(want)
                if not total or not free[i]:
                    break
                give = min(free[i], total)
                for k, n in zip(arcs, want, strict=True):
                    x = min(n, -(-n * give // total), free[i])
                    flow[k] += x
                    lack[source[k]] -= x
                    free[i] -= x
                    used[i] += x
        self.lack, self.flow, self.free, self.used = (np.array(v, np.int64) for v in (lack, flow, free, used))

    def _augment(self) -> bool:
        """Moves tokens along one shortest path from free patterns to a source that lacks some."""
        sources = len(self.lack)
        left = self.room - self.flow
        came = np.full(sources, -2)
        can = self.free[self.pattern] > 0
        came[np.unique(self.source[can & (left > 0)])] = -1
        queue = np.flatnonzero(came == -1).tolist()
        goal = next((s for s in queue if self.lack[s]), None)
        holds = self.flow > 0
        while queue and goal is None:
            s = queue.pop(0)
            # patterns from which s can hand tokens on, and the sources that can take them
            lend = np.zeros(len(self.size), bool)
            lend[self.pattern[self.of_source[s][holds[self.of_source[s]]]]] = True
            for t in np.unique(self.source[lend[self.pattern] & (left > 0)]).tolist():
                if came[t] == -2:
                    came[t] = s
                    queue.append(t)
                    if self.lack[t]:
                        goal = t
                        break
        if goal is None:
            return False
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(int(came[path[-1]]))
        amount = int(self.lack[goal])
        for t, s in zip(path, path[1:], strict=False):  # from the goal back: s hands on to t and lacks it itself
            amount = self._shift(s, t, amount)
        self._draw(path[-1], amount)
        return True

    def _shift(self, s: int, t: int, amount: int) -> int:
        """Up to amount tokens of patterns that serve s go to t instead."""
        a = self.of_source[s][self.flow[self.of_source[s]] > 0]
        at = np.full(len(self.size), -1)
        at[self.pattern[a]] = a
        b = self.of_source[t]
        b = b[(at[self.pattern[b]] >= 0) & (self.room[b] > self.flow[b])]
        a = at[self.pattern[b]]
        n = _upto(np.minimum(self.flow[a], self.room[b] - self.flow[b]), amount)
        self.flow[a] -= n
        self.flow[b] += n
        self.lack[s] += n.sum()
        self.lack[t] -= n.sum()
        return int(n.sum())

    def _draw(self, s: int, amount: int) -> None:
        """Up to amount free tokens of patterns go to s."""
        a = self.of_source[s]
        n = _upto(np.minimum(self.free[self.pattern[a]], self.room[a] - self.flow[a]), amount)
        self.flow[a] += n
        self.free[self.pattern[a]] -= n
        self.used[self.pattern[a]] += n
        self.lack[s] -= n.sum()


def _upto(n: np.ndarray, amount: int) -> np.ndarray:
    """The first of n, cut so that they sum up to amount at most."""
    return np.clip(amount - (np.cumsum(n) - n), 0, n)


def plan_flow(patterns: list[tuple[tuple[str, ...], int]], share: dict[str, float], repeats: dict[str, int], most: int | None = None) -> tuple[int, dict[tuple[int, str], int]]:
    """(total, tokens from pattern number to source) of the largest exact mixture of at most `most` tokens.

    A source can take each of its texts as often as its cap says, whatever others
    take, so the scarcest source alone sets the total.
    """
    names = sorted({s for sources, size in patterns for s in sources if size > 0 and share.get(s, 0) > 0})
    if not names:
        return 0, {}
    number = {s: k for k, s in enumerate(names)}
    kept = [(i, tuple(number[s] for s in sources if s in number), size) for i, (sources, size) in enumerate(patterns) if size > 0]
    kept = [x for x in kept if x[1]]
    whole = sum(share[s] for s in names)
    most_of = [0] * len(names)
    for _, sources, size in kept:
        for s in sources:
            most_of[s] += size * repeats[names[s]]

    def quotas(total: int) -> list[int]:
        return [int(total * share[s] / whole) for s in names]

    low, high = 0, sum(most_of) if most is None else min(sum(most_of), most)
    while low < high:
        mid = (low + high + 1) // 2
        if all(q <= n for q, n in zip(quotas(mid), most_of, strict=True)):
            low = mid
        else:
            high = mid - 1
    router = _Router([(s, n) for _, s, n in kept], [repeats[s] for s in names], quotas(low))
    flow = router.run()
    return low, {(kept[p][0], names[s]): n for p, s, n in zip(router.pattern.tolist(), router.source.tolist(), flow.tolist(), strict=True) if n}


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, most: int | None = None) -> DataFrame:
    """doc_id, source, repeats, tokens of every chosen document; at most `most` tokens in all if given."""
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("n"))
        .where("source IS NOT NULL AND share > 0 AND n > 0")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.max("n").alias("n"))
        .collect()  # the table of targets: one row a source
    )
    share, repeats = {r[0]: r[1] for r in wanted}, {r[0]: r[2] for r in wanted}
    listed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").where(
        F.col("doc_id").isNotNull() & F.col("source").isin(sorted(share)) & F.col("text").isNotNull()
    )
    of_text = count_tokens(listed, vocabulary).where("tokens > 0").groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = cut(
        of_text.groupBy("digest").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"))
        .withColumn("pattern", F.array_join(F.col("members.source"), "|"))
        .withColumn("h", F.xxhash64("digest", F.lit(seed)))
    )
    sums = cut(texts.groupBy("pattern").agg(F.sum("tokens").alias("size"))).orderBy(F.col("size").desc(), "pattern")
    sizes = sorted(tuple(r) for r in sums.limit(MAX_PATTERNS + 1).collect())
    if len(sizes) > MAX_PATTERNS:
        top = sums.limit(MAX_PATTERNS).select("pattern", F.lit(True).alias("top"))
        marked = texts.join(top, "pattern", "left")
        alone = F.transform("members", lambda m: F.concat(F.lit("="), m["source"]))
        texts = cut(marked.withColumn("pattern", F.explode(F.when(F.col("top"), F.array("pattern")).otherwise(F.array_distinct(alone)))).drop("top"))
        sizes = sorted(tuple(r) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("size")).collect())
    patterns = [(tuple(r[0].removeprefix("=").split("|")), int(r[1])) for r in sizes]
    _, flow = plan_flow(patterns, share, repeats, most)
    rows, at = [], {}
    for (i, s), tokens in sorted(flow.items()):
        begin = at.get(i, 0)
        at[i] = begin + tokens
        rows.append((sizes[i][0], s, begin, begin + tokens, patterns[i][1]))
    spark = documents.sparkSession
    spans = spark.createDataFrame(rows or [("", "", 0, 0, 1)], "pattern string, source string, begin long, stop long, size long")
    buckets = max(16, min(1 << 20, texts.count() // PER_BUCKET))
    placed = texts.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    of_bucket = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    before = of_bucket.select("pattern", "bucket", (F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "digest").rowsBetween(Window.unboundedPreceding, -1)
    line = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["pattern", "bucket"]).withColumn("place", F.col("base") + F.col("inner"))
    # uses of place p in [begin, stop): integers k with begin <= p + k * size < stop
    upto = lambda edge: F.ceil((F.col(edge) - F.col("place")) / F.col("size"))
    chosen = line.join(broadcast_if_small(spans), "pattern").withColumn("repeats", (upto("stop") - upto("begin")).cast("int")).where("repeats > 0")
    own = F.filter("members", lambda m: m["source"] == F.col("source"))
    return chosen.select(own[0]["doc_id"].alias("doc_id"), "source", "repeats", "tokens")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, docs, tokens, actual_share, most_repeats for every listed source."""
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row per listed source
    return (
        want.join(got, "source", "left")
        .select("source", "target_share", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
        .withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    )


def kept(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, share_kept, cap_kept for every listed source, recomputed from the chosen documents.

    A share is kept when the source's tokens differ from its part of the total, taken over the
    sources with any, by no more than the longest chosen document at either end of its intervals.
    """
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.max("tokens").alias("longest"))
    every = Window.partitionBy()  # one row per listed source
    both = want.join(got, "source", "left").withColumn("part", F.when(F.col("tokens") > 0, F.col("share")))
    both = both.withColumn("due", F.sum("tokens").over(every) * F.col("part") / F.sum("part").over(every)).withColumn("slack", 2 * F.max("longest").over(every))
    return both.select("source", F.coalesce(F.abs(F.col("tokens") - F.col("due")) <= F.col("slack"), F.lit(True)).alias("share_kept"), F.coalesce(F.col("most") <= F.col("cap"), F.lit(True)).alias("cap_kept"), F.col("tokens").isNotNull().alias("used"))
