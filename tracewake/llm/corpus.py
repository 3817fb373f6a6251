"""The records a model is fitted on, in a list or spread over the cluster, read through sums, counts and sets.

A function of a record gets a state (such as the model so far) and the record.
Nothing is sampled: what is collected are keys that several records share, sums,
and, up to LOCAL_BYTES, the numbered rows of a fit; larger ones stay where they
are and only the sums of each round travel.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.llm import sparse
from tracewake.session import cut

LOCAL_BYTES = 128 << 20
#: rows that a block is made of
BLOCK_ROWS = 50_000

Record = tuple[str, ...]
#: (state, record) to keys
Keys = Callable[[Any, Record], Iterable[tuple[str, ...]]]
#: (state, record) to rows of feature numbers, label, whether held out
Rows = Callable[[Any, Record], Iterable[tuple[tuple[int, ...], int, bool]]]


class Listed:
    """Records in a list; equal ones count once."""

    def __init__(self, records: Iterable[Record]):
        self.records = sorted(set(records))

    def count(self, f: Keys, state: Any, least: int = 1) -> dict[tuple[str, ...], int]:
        """Keys that so many records give."""
        n = Counter(k for r in self.records for k in f(state, r))
        return {k: c for k, c in n.items() if c >= least}

    def shared(self, f: Keys, state: Any, least: int) -> set[tuple[str, str]]:
        """Of the keys (group, part, partner) each (group, part) with so many different partners."""
        n = Counter((g, p) for g, p, _ in {k for r in self.records for k in f(state, r)})
        return {k for k, c in n.items() if c >= least}

    def blocks(self, f: Rows, state: Any) -> sparse.Total:
        local = sparse.blocks(x for r in self.records for x in f(state, r))
        return lambda g: g(local)


class Spread:
    """Records in a column r of arrays; distinct ones."""

    def __init__(self, records: DataFrame):
        self.records = records

    def _keys(self, f: Keys, state: Any) -> DataFrame:
        """key, n: keys with their counts in each batch."""
        shared = self.records.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                n = Counter(k for r in b["r"] for k in f(shared.value, tuple(r)))
                if n:
                    yield pd.DataFrame({"key": [list(k) for k in n], "n": list(n.values())})

        return self.records.mapInPandas(run, "key array<string>, n long")

    def count(self, f: Keys, state: Any, least: int = 1) -> dict[tuple[str, ...], int]:
        rows = self._keys(f, state).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("key").collect()
        return {tuple(r.key): r.n for r in rows}

    def shared(self, f: Keys, state: Any, least: int) -> set[tuple[str, str]]:
        keys = self._keys(f, state).select("key").distinct().groupBy(F.slice("key", 1, 2).alias("k"))
        return {tuple(r.k) for r in keys.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}

    def blocks(self, f: Rows, state: Any) -> sparse.Total:
        shared = self.records.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (x for b in batches for r in b["r"] for x in f(shared.value, tuple(r)))
            while some := list(islice(rows, BLOCK_ROWS)):
                yield pd.DataFrame({"data": [pickle.dumps(sparse.blocks(some))]})

        data = cut(self.records.mapInPandas(run, "data binary"))
        if (data.agg(F.sum(F.length("data"))).first()[0] or 0) <= LOCAL_BYTES:
            local = [pickle.loads(r.data) for r in data.collect()]
            return lambda g: sum((g(b) for b in local[1:]), g(local[0])) if local else 0.0
        parts = data.rdd.map(lambda r: pickle.loads(r.data))
        return lambda g: parts.map(g).treeReduce(np.add)
