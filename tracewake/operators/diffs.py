"""Changed functions in unified diffs, all in narrow column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import broadcast_if_small

# fixed values: declaration patterns on added lines, tried in this order
FUNCTION_PATTERNS = (
    r"^[+](?:func\s+(?:\([^)]+\)\s+)?(\w+)\s*\()",
    r"^[+]def\s+(\w+)\s*\(",
    r"^[+](?:async\s+)?function\s+(\w+)\s*\(",
    r"^[+](?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(",
    r"^[+]\s*(?:public|private|protected|static|virtual|override|inline)?\s*\w[\w<>*&\[\]]*\s+(\w+)\s*\(",
)
#: A hunk header that sets the line counter (a start above 0).
HUNK = r"(?m)^(?=@@[^+\n]*\+0*[1-9])"


def hunk_start(line: Column) -> Column:
    """Digits behind the first plus of a hunk header; 0 if there are none."""
    return F.coalesce(F.regexp_extract(line, r"^@@[^+\n]*\+(\d+)", 1).try_cast("int"), F.lit(0))


def function_name(line: Column) -> Column:
    """Name declared on an added line by the first pattern that matches; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in FUNCTION_PATTERNS])


def _advances(line: Column) -> Column:
    return ~(line.startswith("-") | line.startswith("@@") | line.startswith("diff ") | line.startswith("index ") | line.startswith("new file") | line.startswith("deleted file"))


def changed_functions(df: DataFrame, id_col: str = "id", diff: str = "input_diff") -> DataFrame:
    """id, file, line, func_name, change_type for declarations on added lines.

    The diff is split into file sections and hunks, so a line's number follows
    from its own hunk and no row leaves its partition.
    """
    text = F.regexp_replace(F.col(diff), "\r(?=\n|\\z)", "")
    files = df.select(F.col(id_col).alias("id"), F.explode(F.split(text, r"(?m)^(?=\+\+\+ )")).alias("s")).where(F.col("s").startswith("+++ "))
    path = F.regexp_replace(F.regexp_extract("s", r"^\+\+\+ ([^\n]*)", 1), "^b/", "")
    body = F.regexp_replace("s", r"^[^\n]*\n?", "")
    parts = files.select("id", path.alias("file"), F.explode(F.split(body, HUNK)).alias("h")).where((F.col("file") != "/dev/null") & (F.col("file") != ""))
    base = F.greatest(hunk_start(F.regexp_extract("h", r"^[^\n]*", 0)) - 1, F.lit(0))
    # only the lines that advance the counter are kept, so a line's place among them is its number
    rows = parts.select("id", "file", base.alias("base"), F.posexplode(F.filter(F.split("h", "\n"), _advances)).alias("at", "text")).where(F.col("text").startswith("+"))
    named = rows.withColumn("func_name", function_name(F.col("text"))).where(F.col("func_name").isNotNull())
    return named.select("id", "file", (F.col("base") + F.col("at") + 1).alias("line"), "func_name", F.lit("added").alias("change_type"))


def infer_repo(functions: DataFrame, repos: DataFrame, name: str = "func_name") -> DataFrame:
    """Adds repo: the first repo whose name and a slash or dot begin the function; else the first repo; else unknown.

    repos: ord, repo_name. The function's prefixes before each slash or dot are joined
    with the names by equality.
    """
    first = repos.agg(F.min_by("repo_name", "ord")).first()[0]
    keys = functions.columns
    distinct = functions.distinct()
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(1)).isin("/", "."))
    prefixes = distinct.where(F.col(name).isNotNull()).select(*keys, F.explode(F.transform(cuts, lambda i: F.substring(F.col(name), F.lit(1), i - 1))).alias("repo_name"))
    own = prefixes.join(broadcast_if_small(repos.select("ord", "repo_name")), "repo_name").groupBy(*keys).agg(F.min_by("repo_name", "ord").alias("own"))
    return distinct.join(own, keys, "left").select(*keys, F.coalesce("own", F.lit(first), F.lit("unknown")).alias("repo"))


def group_by_repo(functions: DataFrame) -> DataFrame:
    """repo, functions (sorted, distinct) and their number; partial sets per partition."""
    return functions.groupBy("repo").agg(F.array_sort(F.collect_set("func_name")).alias("functions"))
