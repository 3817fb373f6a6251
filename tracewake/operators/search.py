"""Search, glob, slices and checks over a text corpus of (path, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.functions import text as T
from tracewake.session import cut

# fixed values: default caps
MATCH_CAP, SLICE_CAP, LEVEL2_LINES = 100, 200, 30


def lines_of(df: DataFrame, path: str, content: str) -> DataFrame:
    """path, line_no from 1, text; narrow, so pruning and path filters stay below it."""
    return df.select(F.col(path).alias("path"), F.posexplode(T.scanned_lines(F.col(content))).alias("p", "text")).select("path", (F.col("p") + 1).alias("line_no"), "text")


def matching_lines(lines: DataFrame, pattern: str | None = None, fixed: str | None = None, glob: str | None = None) -> DataFrame:
    """Lines that match a regex or hold a fixed text, in paths that match the glob."""
    if glob is not None:
        lines = lines.where(F.col("path").cast("string").rlike(T.glob_to_regex(glob)))
    test: Column = F.col("text").contains(fixed) if fixed is not None else F.col("text").rlike(pattern)
    return lines.where(test)


def capped(matches: DataFrame, cap: int = MATCH_CAP) -> DataFrame:
    """The first matches in path and line order; the cap is the feature."""
    return matches.orderBy("path", "line_no").limit(cap)


def line_range(lines: DataFrame, offset: int = 1, limit: int = SLICE_CAP) -> DataFrame:
    """Lines offset..offset+limit-1 of every path; offset and limit below 1 mean the defaults."""
    first, n = offset if offset >= 1 else 1, limit if limit >= 1 else SLICE_CAP
    return lines.where(F.col("line_no").between(first, first + n - 1))


def slices(df: DataFrame, path: str, content: str, offset: int = 1, limit: int = SLICE_CAP) -> DataFrame:
    """path, slice: numbered lines, or a note when the text is shorter; no shuffle."""
    first, n = offset if offset >= 1 else 1, limit if limit >= 1 else SLICE_CAP
    part = F.slice(T.scanned_lines(F.col(content)), first, n)
    numbered = F.transform(part, lambda x, i: T.numbered_line(i + first, x))
    return df.select(
        F.col(path).alias("path"), F.when(F.size(part) == 0, F.lit(f"(file has fewer than {first} lines)")).otherwise(F.concat(F.array_join(numbered, "\n"), F.lit("\n"))).alias("slice")
    )


def layered(df: DataFrame, path: str, content: str, line: str, level: int, max_level: int = 3) -> DataFrame:
    """Reading in layers: 1 the place, 2 the lines around it, 3 the first SLICE_CAP lines."""
    level, max_level = min(max(level, 1), 3), min(max(max_level, 1), 3)
    if level > max_level:
        raise ValueError(f"level {level} is above the allowed level {max_level}")
    if level == 1:
        return df.select(F.col(path).alias("path"), F.concat_ws(":", F.col(path).cast("string"), F.col(line).cast("string")).alias("slice"))
    first = F.greatest(F.lit(1), F.col(line) - 5) if level == 2 else F.lit(1)
    part = F.slice(T.scanned_lines(F.col(content)), first.cast("int"), LEVEL2_LINES if level == 2 else SLICE_CAP)
    numbered = F.transform(part, lambda x, i: T.numbered_line(i + first.cast("int"), x))
    return df.select(F.col(path).alias("path"), F.when(F.size(part) == 0, F.concat(F.lit("(file has fewer than "), first.cast("string"), F.lit(" lines)"))).otherwise(F.concat(F.array_join(numbered, "\n"), F.lit("\n"))).alias("slice"))


def glob_paths(df: DataFrame, path: str, pattern: str, hidden: bool = False) -> DataFrame:
    """Distinct paths that match; hidden directories are skipped as a tree walk does."""
    out = df.select(F.col(path).alias("path")).where(F.col("path").rlike(T.glob_to_regex(pattern)))
    if not hidden:
        out = out.where(~F.col("path").rlike(r"(?:^|/)\.[^/]+/"))
    return out.distinct()


#: Names up to this many bytes are sent to every worker; each file is read once.
NAME_BYTES = 32 << 20
GRAM = 5


def _found_names(names: DataFrame, files: DataFrame, name_bytes: int) -> DataFrame:
    """func_name of those names that some file holds."""
    size = names.agg(F.sum(F.octet_length("func_name"))).first()[0] or 0
    contents = files.where(F.col("content").isNotNull()).select("content")
    return _scanned_names(names, contents) if size <= name_bytes else _joined_names(names, contents)


def _scanned_names(names: DataFrame, contents: DataFrame) -> DataFrame:
    import ahocorasick
    import pandas as pd

    shared = contents.sparkSession.sparkContext.broadcast(sorted(r[0] for r in names.collect()))

    def scan(batches):
        a = ahocorasick.Automaton()
        for name in shared.value:
            a.add_word(name, name)
        found: set[str] = set()
        if shared.value:
            a.make_automaton()
            for b in batches:
                for c in b["content"]:
                    found.update(n for _, n in a.iter(c))
        yield pd.DataFrame({"func_name": sorted(found)}, dtype=object)

    return contents.mapInPandas(scan, "func_name string").distinct()


def _grams(c: Column) -> Column:
    """All runs of GRAM characters; a shorter text is one itself, and texts hold their shorter runs too."""
    return F.when(F.length(c) >= GRAM, _runs_of(c, GRAM)).otherwise(F.array(c))


def _runs_of(c: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))


def _joined_names(names: DataFrame, contents: DataFrame) -> DataFrame:
    """The same by a join, for names too many to be sent: each is looked up by its rarest run of characters in the distinct lines."""
    lines = cut(contents.select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''").distinct())
    runs = names.select("func_name", F.explode(F.array_distinct(_grams(F.col("func_name")))).alias("g"))
    of_line = lines.select("line", F.explode(F.array_distinct(F.concat(*[_runs_of(F.col("line"), k) for k in range(1, GRAM + 1)]))).alias("g"))
    kept = cut(of_line.join(runs.select("g").distinct(), "g", "left_semi"))
    rarest = runs.join(kept.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g", "left").groupBy("func_name").agg(F.min_by("g", F.coalesce("n", F.lit(0))).alias("g"))
    return kept.join(rarest, "g").where(F.col("line").contains(F.col("func_name"))).select("func_name").distinct()


def verified(nodes: DataFrame, files: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """Adds verified: whether the named file (or, without one, any file of the workspace) holds the name.

    nodes: repo, file_path, func_name; files: repo, path, content. Nodes with a file join
    it by equality; the names without one are looked for in all files, each of which is
    read once. A blank name is never verified, nor is a name with a line feed.
    """
    cols = nodes.columns
    no_file = F.coalesce(F.col("file_path"), F.lit("")) == ""
    f = files.select(F.col("repo").alias("f_repo"), F.col("path").alias("f_path"), F.col("content").alias("f_content"))
    ok = (F.col("func_name") != "") & ~F.col("func_name").contains("\n")
    holds = F.coalesce(ok & F.col("f_content").contains(F.col("func_name")), F.lit(False))
    named = nodes.where(~no_file).join(f, (F.col("repo") == F.col("f_repo")) & (F.col("file_path") == F.col("f_path")), "left").groupBy(*cols).agg(F.max(holds).alias("verified"))
    unnamed = nodes.where(no_file).distinct()
    hit = _found_names(unnamed.where(ok).select("func_name").distinct(), files, name_bytes).withColumn("_hit", F.lit(True))
    return named.unionByName(unnamed.join(hit, "func_name", "left").select(*cols, F.coalesce("_hit", F.lit(False)).alias("verified")))
