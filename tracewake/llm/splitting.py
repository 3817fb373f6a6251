"""Splitting oversized items at natural boundaries (problem 2).

A text above the limit is seen as units: its lines, and for lines that don't fit
with their overlap, runs of words. Dynamic programming over the unit ends picks the cuts
that minimise the sum of cut penalties (file start 0, hunk start 1, line end 4,
inside a line 20, and 15 more at a line end where the overlap doesn't fit) and of squared deviation from the even size, such that no
piece, its overlap included, exceeds the limit. Each piece after the first
begins with the last OVERLAP lines of the one before.

Nulls and edge cases: a null text or id gives no piece, an empty text one empty
piece; a cut inside an over-long line overlaps by units of that line instead of
lines, up to half the limit; if three lines don't fit with the next unit, as many
whole ones as do are shared, and if none does, units of the last; of a redelivered id the delivery loaded first
counts, ties by a hash of the text. Pieces without their
overlap add up to the text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut
from tracewake.sources.tables import first_per_id

LIMIT = 6000
OVERLAP = 3
PENALTY_FILE, PENALTY_HUNK, PENALTY_LINE, PENALTY_INSIDE = 0.0, 1.0, 4.0, 20.0
#: More for a cut at a line end where the specified overlap doesn't fit.
PENALTY_SHORT = 15.0
IMBALANCE = 30.0
PIECES = "id string, piece_no int, n_pieces int, overlap_bytes int, first_line int, last_line int, piece string"


def _inside(line: bytes, room: int) -> list[bytes]:
    """An over-long line as units of at most room bytes, cut behind white space or between characters."""
    out, at = [], 0
    while len(line) - at > room:
        end = at + room
        gap = max(line.rfind(b" ", at + room // 2, end), line.rfind(b"\t", at + room // 2, end))
        if gap > 0:
            end = gap + 1
        else:
            while end > at + 1 and (line[end] & 0xC0) == 0x80:
                end -= 1
        out.append(line[at:end])
        at = end
    return [*out, line[at:]]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces as (bytes of overlap, first line, last line, text); lines count from 1."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return [(0, 1, text.count("\n") + (not text.endswith("\n") or not text), text)]
    units: list[bytes] = []
    line_of: list[int] = []
    penalty: list[float] = []  # of a cut before the unit
    room = max(4, limit // 4)
    lines = re.findall(rb"[^\n]*\n|[^\n]+\Z", data)
    first: list[int] = []  # first unit of each line
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).tolist()
    for no, line in enumerate(lines, 1):
        before_it = sizes[no - 1] - sizes[max(0, no - 1 - overlap)]
        fits = len(line) + (before_it if before_it <= limit - room else limit // 2) <= limit
        first.append(len(units))
        before = PENALTY_FILE if line[:10].lower() == b"diff --git" else PENALTY_HUNK if line.startswith(b"@@") else PENALTY_LINE
        for k, part in enumerate([line] if fits else _inside(line, room)):
            units.append(part)
            line_of.append(no)
            penalty.append(PENALTY_INSIDE if k else before)
    n = len(units)
    end = np.concatenate(([0], np.cumsum([len(u) for u in units]))).astype(np.int64)
    shared = np.zeros(n, dtype=np.int64)  # first unit of the piece that begins its own part at unit i
    ends = end.tolist()
    for i in range(n):
        line = line_of[i] - 1
        whole = [first[max(0, line - k)] for k in range(overlap, 0, -1)] if first[line] == i else []
        s = next((s for s in whole if ends[i + 1] - ends[s] <= limit), None)
        if whole and s != whole[0]:
            penalty[i] += PENALTY_SHORT
        if s is None:
            s = max(0, i - overlap)
            while s < i and (ends[i] - ends[s] > limit // 2 or ends[i + 1] - ends[s] > limit):
                s += 1
        shared[i] = s
    start = end[shared]  # byte at which the piece from i begins
    even = len(data) / -(-len(data) // limit)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    back = np.zeros(n + 1, dtype=np.int64)
    for j in range(1, n + 1):
        lo = int(end.searchsorted(end[j] - limit))
        own = end[j] - end[lo:j]
        total = np.where(end[j] - start[lo:j] <= limit, cost[lo:j] + IMBALANCE * ((own / even - 1.0) ** 2), np.inf)
        k = int(total.argmin())
        back[j], cost[j] = lo + k, total[k] + (penalty[j] if j < n else 0.0)
    cuts = [n]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    cuts.reverse()
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s = int(shared[a])
        out.append((int(end[a] - end[s]), line_of[s], line_of[b - 1], data[end[s] : end[b]].decode("utf-8", "surrogatepass")))
    return out


def pieces(df: DataFrame, text: str = "input_diff", id_col: str = "id", limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = True) -> DataFrame:
    """One row per piece; items within the limit stay in the JVM as single pieces."""
    if not 4 <= limit or not 0 <= overlap:
        raise ValueError("limit must be at least 4 bytes and overlap not negative")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, t in zip(batch["id"], batch["t"], strict=True):
                parts = split_text(t, limit, overlap)
                rows += [(rid, k, len(parts), *p) for k, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in PIECES.split(", ")])

    # one delivery an id decides, whatever its size; texts that give no row needn't travel
    sized = df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), "loaded_at").where(F.col("t").isNotNull()).withColumn("n", F.octet_length("t"))
    kept = F.col("t") if keep_small else F.when(F.col("n") > limit, F.col("t"))
    base = first_per_id(sized.select("id", "loaded_at", F.xxhash64("t").alias("h"), "n", kept.alias("t")), "h", "n", "t").where("t IS NOT NULL")
    if keep_small:
        base = cut(base)  # read by both branches
    large = base.where(F.octet_length("t") > limit).mapInPandas(run, PIECES)
    if not keep_small:
        return large
    lines = F.length("t") - F.length(F.replace("t", F.lit("\n"))) + F.when(F.col("t").endswith("\n"), 0).otherwise(1)
    small = base.where(F.octet_length("t") <= limit).select(
        "id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("overlap_bytes"), F.lit(1).alias("first_line"), lines.cast("int").alias("last_line"), F.col("t").alias("piece")
    )
    return large.unionByName(small)


def joined(parts: DataFrame) -> DataFrame:
    """id, n_pieces, longest (bytes), digest of the pieces put together without their overlaps; an item's pieces are one text by definition."""
    own = F.substring(F.col("piece").cast("binary"), F.col("overlap_bytes") + 1, F.octet_length("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.hex(own).alias("h")))), lambda x: x["h"]), "")
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(F.octet_length("piece")).alias("longest"), F.sha2(F.unhex(whole), 256).alias("digest"))
