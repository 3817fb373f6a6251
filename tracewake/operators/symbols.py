"""Symbols of source text, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.functions.text import EDGE_L, EDGE_R
from tracewake.session import spread

# fixed values: declaration patterns per language, tried in this order
SYMBOLS: dict[str, tuple[tuple[str, str], ...]] = {
    "go": (
        (r"^(?:\s*)func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "function"),
        (rf"^(?:\s*)type\s+(\w+)\s+struct{EDGE_R}", "class"),
        (rf"^(?:\s*)type\s+(\w+)\s+interface{EDGE_R}", "interface"),
        (r"^(?:\s*)type\s+(\w+)\s+", "type"),
    ),
    "python": ((r"^(?:\s*)def\s+(\w+)\s*\(", "function"), (r"^(?:\s*)class\s+(\w+)\s*[:(]", "class")),
    "js": (
        (r"^(?:\s*)(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "function"),
        (rf"^(?:\s*)(?:export\s+)?class\s+(\w+){EDGE_R}", "class"),
        (r"^(?:\s*)(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", "function"),
        (rf"^(?:\s*)(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?function{EDGE_R}", "function"),
    ),
    "java": (
        # white space is written once where the documented pattern allows it twice in a row: it matches the same lines, without backtracking
        (r"^(?:public|private|protected|static|final|\s)*\s\w[\w<>\[\],\s]*\s(\w+)\s*\(", "function"),
        (rf"^(?:\s*)(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+){EDGE_R}", "class"),
        (rf"^(?:\s*)(?:public|private|protected)?\s*interface\s+(\w+){EDGE_R}", "interface"),
    ),
}
#: Every pattern needs one of these; the rest of the lines are left out early.
MAYBE = r"\(|type\s|class\s|interface\s|function"
# fixed values: other names of the languages
ALIASES = {"golang": "go", "typescript": "js", "tsx": "js", "jsx": "js", "javascript": "js", "ts": "js", "py": "python", "kotlin": "java"}


def alias(language: Column) -> Column:
    low = F.lower(F.coalesce(language, F.lit("")))
    out = low
    for name, to in ALIASES.items():
        out = F.when(low == name, to).otherwise(out)
    return out


def detect(code: Column) -> Column:
    """A best guess from keywords; Go where nothing tells."""
    return (
        F.when(code.rlike(rf"{EDGE_L}package\s+\w+"), "go")
        .when(code.rlike(rf"{EDGE_L}def\s+\w+\s*\("), "python")
        .when(code.rlike(rf"{EDGE_L}public\s+(static\s+)?(?:void|class|interface){EDGE_R}"), "java")
        .when(code.rlike(r"(?:import|export|const|let|var|=>)"), "js")
        .otherwise("go")
    )


def without_number(line: Column) -> Column:
    """Without the number and tab of a numbered line."""
    return F.regexp_replace(line, r"^\s*\d+\t", "")


def symbols(df: DataFrame, id_col: str, code: str, language: str | None = None) -> DataFrame:
    """id, language, name, kind, line; one symbol a line, the first pattern that matches."""
    lang = alias(F.col(language)) if language else F.lit("")
    src = df.select(F.col(id_col).alias("id"), F.col(code).alias("code"), lang.alias("given")).where(F.coalesce(F.col("code"), F.lit("")) != "")
    src = spread(src)
    # the language is found before the lines are taken apart, once a text
    src = src.select("id", F.when(F.col("given") == "", detect(F.col("code"))).otherwise(F.col("given")).alias("language"), "code")
    src = src.select("id", "language", F.posexplode(F.split("code", "\n")).alias("at", "raw"))
    src = src.withColumn("text", without_number(F.col("raw"))).where(F.col("raw").rlike(MAYBE))
    text = F.col("text")

    def first(patterns: tuple[tuple[str, str], ...]) -> Column:
        tried = [F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("name"), F.lit(kind).alias("kind"))) for p, kind in patterns]
        return F.coalesce(*tried)

    hit = F.lit(None).cast("struct<name:string,kind:string>")
    for name, patterns in SYMBOLS.items():
        hit = F.when(F.col("language") == name, first(patterns)).otherwise(hit)
    known = F.col("language").isin(*SYMBOLS)
    hit = F.when(known, hit).otherwise(first(SYMBOLS["go"] + SYMBOLS["js"]))
    return src.withColumn("s", hit).where(F.col("s").isNotNull()).select("id", "language", "s.name", "s.kind", (F.col("at") + 1).alias("line"))
