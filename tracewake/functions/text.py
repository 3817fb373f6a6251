"""Text functions on columns: lines, list items, globs, paths, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word edges in ASCII, whatever the letters beside them.
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def scanned_lines(c: Column) -> Column:
    """Lines as a scanner gives them: no last empty line, no carriage return at the end."""
    flat = F.regexp_replace(c, "\r(?=\n|\\z)", "")
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(flat, r"\n\z", ""), "\n"))


def list_items(c: Column) -> Column:
    """Lines without one leading dash, then one leading star, trimmed; blanks dropped."""
    ws = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    item = lambda x: ws(F.regexp_replace(ws(F.regexp_replace(ws(x), "^-", "")), r"^\*", ""))
    return F.filter(F.transform(F.split(c, "\n"), item), lambda x: x != "")


def clean_keywords(words: list[str]) -> list[str]:
    return [w.strip() for w in words if w and w.strip()]


def glob_to_regex(pattern: str) -> str:
    """Anchored regex: * and ? within a segment, classes, ** for any number of whole segments."""

    def segment(p: str) -> str:
        out, i = "", 0
        while i < len(p):
            c = p[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (end := p.find("]", i + 2)) > 0:
                out += "[" + p[i + 1 : end].replace("[", r"\[") + "]"
                i = end
            elif c == "\\" and i + 1 < len(p):
                i += 1
                out += re.escape(p[i])
            else:
                out += re.escape(c)
            i += 1
        return out

    parts = pattern.split("/")
    out = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += segment(p) + ("" if last else "/")
    return f"^{out}$"


def relative_path(c: Column, root: str) -> Column:
    """Path below the root; other paths stay."""
    base = root.rstrip("/") + "/"
    return F.when(c.startswith(base), F.substring(c, len(base) + 1, 2**31 - 1)).otherwise(c)


def path_to_uri(c: Column) -> Column:
    return F.when(c.startswith("file://"), c).otherwise(F.concat(F.lit("file://"), c))


def uri_to_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file://", "")


def match_line(path: Column, line: Column, text: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), text)


def numbered_line(line: Column, text: Column) -> Column:
    return F.format_string("%6d\t%s", line, text)
