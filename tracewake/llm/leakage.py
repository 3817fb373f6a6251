"""Evaluation texts leaking into training text (problem 7).

Windows of tokens get a 64-bit SimHash. There are two kinds. Windows of item size:
each item is represented by its largest window of MIN_WINDOW * 2^k tokens, at
STRIDE neighbouring starts in every tile, and documents have windows of these sizes
at every STRIDE-th token, so a copy of the item lines up with one of them exactly;
fingerprints within NEAR_RADIUS count. Windows of MIN_WINDOW tokens, at every start in
the items: any run of MIN_RUN shared tokens holds such a document window whole,
since MIN_WINDOW + STRIDE - 1 < MIN_RUN; fingerprints within RADIUS count. The
fingerprints are cut into blocks; by the pigeonhole principle two of them within the
radius have a block in which they differ by at most radius // blocks bits, and the
items' entries hold all these neighbours, so looking up each block misses none.

Candidates are verified on the tokens: the similarity of the item's weighted
five-word shingles with those of the passage of item size at that place must reach
SIMILARITY, or the longest common run must reach MIN_RUN. Weights fall with the
number of items that hold a shingle. Five-word shingles lose five members with
each changed token, so 0.8 means about one change in 45 tokens; a lower
similarity finds passages with more changes.

The index of the items is sent to the workers if their texts take at most
INDEX_BYTES, and documents are read once, in place. Above that the block values of
both sides are joined, in one scan as well, and only candidate texts travel.

Nulls and edge cases: null texts and ids give nothing; items under MIN_RUN
tokens can't match; repeated documents are each listed; a pair is listed once,
with its longest run and best similarity; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut, spread

MIN_RUN = 20
STRIDE = 5
MIN_WINDOW = 15
RADIUS = 3
BLOCKS = 4
NEAR_RADIUS = 11
NEAR_BLOCKS = 6
SHINGLE = 5
SIMILARITY = 0.8
#: Item texts up to this size are indexed on every worker.
INDEX_BYTES = 8 << 20
TOKENS_AT_ONCE = 150_000
PAIRS_AT_ONCE = 2_000_000
SIEVE_BITS = 22
TOKEN = re.compile("[a-z0-9ß-öø-ɏ]+|[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
PAIRS = "doc_id long, item_id long, run_tokens int, similarity double"
_U = np.uint64


class TokenHashes(dict):
    """Token to 64-bit hash, kept for the tokens seen last."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[token] = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        return h


def tokens(text: str, hashes: TokenHashes) -> np.ndarray:
    found = TOKEN.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, found), _U, len(found))


def _signs(counts: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(counts > size // 2, axis=1).view(_U).reshape(-1)


def item_prints(h: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the size tokens from each start."""
    total = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32, out=total[1:])
    return _signs(total[starts + size] - total[starts], size)


def item_windows(n: int) -> list[tuple[int, np.ndarray, bool]]:
    """(size, starts, near) of an item of n tokens: all short windows, and the item-sized ones per tile."""
    out = [(MIN_WINDOW, np.arange(n - MIN_WINDOW + 1), False)]
    size = MIN_WINDOW
    while size * 2 <= n:
        size *= 2
    if size > MIN_WINDOW:
        starts = (np.arange(0, n - size + 1, size)[:, None] + np.arange(STRIDE)).ravel()
        out.append((size, starts[starts + size <= n], True))
    return out


def document_prints(flat: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts in flat, fingerprints) of the windows at every STRIDE-th token of each document.

    Bits are summed in groups of STRIDE tokens, and windows of double size are sums of two.
    """
    lengths = np.diff(first) // STRIDE
    begin = np.repeat(first[:-1], lengths)
    inner = np.arange(len(begin)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = begin + inner * STRIDE
    left = np.repeat(lengths, lengths) - inner  # whole groups from here to the document's end
    if not len(at):
        return
    bits = np.unpackbits(flat[(at[:, None] + np.arange(STRIDE)).ravel()].view(np.uint8).reshape(-1, 8), axis=1)
    groups = bits.reshape(len(at), STRIDE, 64).sum(axis=1, dtype=np.uint16)
    n = MIN_WINDOW // STRIDE
    sums = sum(np.concatenate((groups[k:], np.zeros((k, 64), np.uint16))) for k in range(n))
    size = MIN_WINDOW
    while True:
        if size in sizes:
            good = np.flatnonzero(left >= n)
            yield size, at[good], _signs(sums[good], size)
        if size >= max(sizes) or n >= len(at):
            return
        sums = sums + np.concatenate((sums[n:], np.zeros((n, 64), sums.dtype))) if size < 30_000 else sums.astype(np.int64) + np.concatenate((sums[n:], np.zeros((n, 64), np.int64)))
        size, n = size * 2, n * 2


def block_edges(near: bool) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    blocks = NEAR_BLOCKS if near else BLOCKS
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def neighbours(values: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry number, value) of each value and all within radius bits of it."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(bits)} | set(masks))
    m = np.array(masks, _U)
    return np.repeat(np.arange(len(values)), len(m)), (values[:, None] ^ m).ravel()


class WindowIndex:
    """Fingerprints of one window size, found by their blocks."""

    def __init__(self, prints: np.ndarray, item: np.ndarray, start: np.ndarray, radius: int, near: bool):
        self.prints, self.item, self.start, self.radius = prints, item, start, radius
        self.tables = []
        edges = block_edges(near)
        for lo, bits in edges:
            entry, value = neighbours((prints >> _U(lo)) & _U((1 << bits) - 1), bits, radius // len(edges))
            order = np.argsort(value, kind="stable")
            offsets = np.searchsorted(value[order], np.arange((1 << bits) + 1, dtype=_U))
            self.tables.append((_U(lo), _U((1 << bits) - 1), offsets, entry[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (document window, item window) within the radius."""
        out = []
        for shift, mask, offsets, entry in self.tables:
            value = ((prints >> shift) & mask).astype(np.int64)
            lo = offsets[value]
            n = offsets[value + 1] - lo
            ends = np.cumsum(n)
            a = 0
            while a < len(prints):  # bounded numbers of pairs at a time
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
                k = n[a:b]
                d = np.repeat(np.arange(a, b), k)
                if len(d):
                    i = entry[np.repeat(lo[a:b] - (np.cumsum(k) - k), k) + np.arange(len(d))]
                    close = np.bitwise_count(prints[d] ^ self.prints[i]) <= self.radius
                    out.append(d[close] * len(self.prints) + i[close])
                a = b
        both = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return both // max(len(self.prints), 1), both % max(len(self.prints), 1)


@dataclass
class Item:
    item_id: int
    tok: np.ndarray
    shingles: np.ndarray  # sorted
    weights: np.ndarray


class ItemIndex:
    """All items' windows by size; rows are (item_id, text, shingles, weights)."""

    def __init__(self, rows: list[tuple[int, str, list[int], list[float]]], items: int, radius: int = RADIUS, near_radius: int = NEAR_RADIUS):
        hashes = TokenHashes()
        self.items: list[Item] = []
        self.top = float(np.log1p(items))  # weight of a shingle that no item holds
        parts: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item_id, text, shingles, weights in rows:
            h = tokens(text, hashes)
            if len(h) < MIN_RUN:
                continue
            s, w = np.array(shingles, np.int64).view(_U), np.array(weights, float)
            order = np.argsort(s)
            for size, starts, near in item_windows(len(h)):
                parts.setdefault((size, near), []).append((item_prints(h, size, starts), np.full(len(starts), len(self.items)), starts))
            self.items.append(Item(item_id, h, s[order], w[order]))
        self.windows = {}
        for (size, near), some in sorted(parts.items()):
            prints, item, start = (np.concatenate([p[k] for p in some]) for k in range(3))
            self.windows[size, near] = WindowIndex(prints, item, start, near_radius if near else radius, near)
        self.flat = np.concatenate([x.tok for x in self.items]) if self.items else np.empty(0, _U)
        self.offset = np.concatenate(([0], np.cumsum([len(x.tok) for x in self.items]))).astype(np.int64)
        self.sizes = sorted({size for size, _ in self.windows})
        self.all_shingles = np.unique(np.concatenate([x.shingles for x in self.items])) if self.items else np.empty(0, _U)
        self.mass = np.array([x.weights.sum() for x in self.items])
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)  # low bits of the shingles of all items
        self.sieve[self.all_shingles & _U((1 << SIEVE_BITS) - 1)] = True

    def held(self, shingles: np.ndarray) -> np.ndarray:
        """Whether some item holds each shingle."""
        out = self.sieve[shingles & _U((1 << SIEVE_BITS) - 1)]
        at = np.flatnonzero(out)
        out[at] = np.isin(shingles[at], self.all_shingles)
        return out

    def similarity(self, x: Item, passage: np.ndarray) -> float:
        """Weighted shingles of both over those of either, from the passage's shingles."""
        mine = np.unique(passage)
        both = np.isin(x.shingles, mine, assume_unique=True)
        common = float(x.weights[both].sum())
        return common / (float(x.weights.sum()) + self.top * (len(mine) - int(both.sum())))


def _shingles(h: np.ndarray) -> np.ndarray:
    if len(h) < SHINGLE:
        return np.empty(0, _U)
    out = np.zeros(len(h) - SHINGLE + 1, _U)
    for k in range(SHINGLE):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        out ^= out >> _U(29)
    return out


def leaks_of(docs: list[np.ndarray], index: ItemIndex, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """(document number, item number, longest run, best similarity) of verified candidates."""
    if not index.items:
        return []
    flat = np.concatenate(docs)
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    # a passage that shares no shingle with any item has no similarity and no run: its windows aren't looked up
    shingles = _shingles(flat)
    known = np.concatenate(([0], np.cumsum(index.held(shingles)), [0] * SHINGLE))
    known[len(shingles) + 1 :] = known[len(shingles)]
    if not known[-1]:
        return []
    found = []
    for size, at, prints in document_prints(flat, first, index.sizes):
        # passages of the size's items, which are less than two windows long, lie within a window before and two behind
        some = known[np.minimum(at + 2 * size, len(known) - 1)] > known[np.maximum(at - size, 0)]
        at, prints = at[some], prints[some]
        for near in (False, True):
            if w := index.windows.get((size, near)):
                d, i = w.candidates(prints)
                found.append(np.stack([at[d], w.item[i], w.start[i]], axis=1))
    if not found or not sum(map(len, found)):
        return []
    p, x, q = np.unique(np.concatenate(found), axis=0).T
    doc = np.searchsorted(first, p, "right") - 1
    # runs: start where the windows' tokens agree, one extension per diagonal
    same = np.ones(len(p), bool)
    for k in range(MIN_WINDOW):
        same &= flat[p + k] == index.flat[index.offset[x] + q + k]
    run: dict[tuple[int, int], int] = {}
    seen_to: dict[tuple[int, int, int], int] = {}
    for n, k, a, b in sorted(zip(doc[same].tolist(), x[same].tolist(), p[same].tolist(), (index.offset[x] + q)[same].tolist(), strict=True)):
        if seen_to.get((n, k, a - b), -1) >= a:
            continue  # inside a run already extended
        back = _agree(flat[first[n] : a][::-1], index.flat[index.offset[k] : b][::-1])
        ahead = _agree(flat[a : first[n + 1]], index.flat[b : index.offset[k + 1]])
        seen_to[n, k, a - b] = a + ahead - MIN_WINDOW
        run[n, k] = max(run.get((n, k), 0), back + ahead)
    # similarity of the passage of item size at each place; passages without a shingle of any item have none
    doc, x, begin = np.unique(np.stack([doc, x, p - q], axis=1), axis=0).T
    lo = np.maximum(begin, first[doc])
    hi = np.maximum(np.minimum(begin + np.diff(index.offset)[x], first[doc + 1]) - SHINGLE + 1, lo)
    # the common weight is at most that of the passage's held shingles; where it can't reach the similarity only runs matter
    leaked = {pair for pair, n in run.items() if n >= MIN_RUN}
    some = (known[hi] - known[lo]) * index.top >= similarity * index.mass[x] - 1e-9
    some |= np.fromiter((pair in leaked for pair in zip(doc.tolist(), x.tolist(), strict=True)), bool, len(doc)) if leaked else False
    best: dict[tuple[int, int], float] = {}
    for n, k, a, b in zip(*(v[some].tolist() for v in (doc, x, lo, hi)), strict=True):
        best[n, k] = max(best.get((n, k), 0.0), index.similarity(index.items[k], shingles[a:b]))
    return [(n, k, run.get((n, k), 0), s) for (n, k), s in sorted(best.items()) if run.get((n, k), 0) >= MIN_RUN or s >= similarity]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    step, at = 64, 0
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def weighted_items(items: DataFrame) -> tuple[DataFrame, int]:
    """item_id, text, shingles, weights of every item, and their number. A shingle's weight is log(1 + items / items that hold it)."""
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for b in batches:
            yield b.assign(shingles=[np.unique(_shingles(tokens(t, hashes))).view(np.int64) for t in b["text"]])

    known = cut(known.mapInPandas(run, "item_id long, text string, shingles array<long>"))
    n = known.count()
    each = known.select("item_id", F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    lists = each.join(df, "s").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("s", F.log1p(F.lit(n) / F.col("n")).alias("w")))).alias("l"))
    return cut(known.select("item_id", "text").join(lists, "item_id").select("item_id", "text", F.col("l.s").alias("shingles"), F.col("l.w").alias("weights"))), n


def leaks(documents: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, near_radius: int = NEAR_RADIUS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, run_tokens, similarity of every leak."""
    known, n = weighted_items(items)
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > index_bytes:
        return _joined_leaks(texts, known, n, similarity, radius, near_radius)
    shared = documents.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in known.collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, hashes = ItemIndex(shared.value, n, radius, near_radius), TokenHashes()
        for batch in batches:
            rows, ids, docs, size = [], [], [], 0
            todo = list(zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True))
            for k, (doc_id, text) in enumerate(todo):
                h = tokens(text, hashes)
                if len(h) >= MIN_WINDOW:
                    ids.append(doc_id)
                    docs.append(h)
                    size += len(h)
                if docs and (size > TOKENS_AT_ONCE or k == len(todo) - 1):
                    rows += [(ids[a], index.items[b].item_id, r, s) for a, b, r, s in leaks_of(docs, index, similarity)]
                    ids, docs, size = [], [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_tokens", "similarity"])

    return spread(texts).mapInPandas(run, PAIRS)


def _frame(parts: list[tuple[np.ndarray, ...]], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) if parts else [] for k, c in enumerate(columns)})


def _block_values(print_: Column, near: bool) -> Column:
    return F.array(*[F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << bits) - 1)) for lo, bits in block_edges(near)])


def _joined_leaks(texts: DataFrame, known: DataFrame, n: int, similarity: float, radius: int, near_radius: int) -> DataFrame:
    """The same by a join of block values, for items too many to be sent to every worker."""

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for item_id, text in zip(b["item_id"], b["text"], strict=True):
                h = tokens(text, hashes)
                for size, starts, near in item_windows(len(h)) if len(h) >= MIN_RUN else ():
                    prints = np.unique(item_prints(h, size, starts))
                    edges = block_edges(near)
                    for no, (lo, bits) in enumerate(edges):
                        entry, value = neighbours((prints >> _U(lo)) & _U((1 << bits) - 1), bits, (near_radius if near else radius) // len(edges))
                        n = len(value)
                        parts.append((np.full(n, size), np.full(n, near), np.full(n, no), value.view(np.int64), prints[entry].view(np.int64), np.full(n, item_id)))
            yield _frame(parts, ["size", "near", "block", "value", "i_print", "item_id"])

    left = cut(known.select("item_id", "text").mapInPandas(of_items, "size int, near boolean, block int, value long, i_print long, item_id long"))
    sizes = sorted(r[0] for r in left.select("size").distinct().collect())  # a doubling row, so a few dozen at most

    def of_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                h = tokens(text, hashes)
                for size, _, prints in document_prints(h, np.array([0, len(h)]), sizes) if len(h) >= MIN_WINDOW and sizes else ():
                    some = np.unique(prints)
                    parts.append((np.full(len(some), doc_id), np.full(len(some), size), some.view(np.int64)))
            yield _frame(parts, ["doc_id", "size", "print"])

    windows = spread(texts).mapInPandas(of_documents, "doc_id long, size int, print long")
    sides = []
    for near in (False, True):
        have = windows.where(F.col("size") == MIN_WINDOW) if not near else windows.where(F.col("size") > MIN_WINDOW)
        sides.append(have.select("doc_id", "size", F.lit(near).alias("near"), "print", F.posexplode(_block_values(F.col("print"), near)).alias("block", "value")))
    right = sides[0].unionByName(sides[1])
    limit = F.when(F.col("near"), near_radius).otherwise(radius)
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("i_print"))) <= limit
    pairs = cut(right.join(left, ["size", "near", "block", "value"]).where(close).select("doc_id", "item_id").distinct())

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        index_of = lru_cache(maxsize=1000)(lambda key: ItemIndex([key], n, radius, near_radius))
        for b in batches:
            rows = []
            for doc_id, text, item_id, item, shingles, weights in zip(*(b[c] for c in ("doc_id", "text", "item_id", "item", "shingles", "weights")), strict=True):
                index = index_of((item_id, item, tuple(shingles), tuple(weights)))
                rows += [(doc_id, item_id, r, s) for _, _, r, s in leaks_of([tokens(text, hashes)], index, similarity)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_tokens", "similarity"])

    some = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    full = pairs.join(some, "doc_id").join(known.withColumnRenamed("text", "item"), "item_id")
    return full.select("doc_id", "text", "item_id", "item", "shingles", "weights").mapInPandas(verify, PAIRS)
