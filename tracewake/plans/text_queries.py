"""Queries over texts: search, glob, slices, diffs and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewake.functions import text as T
from tracewake.operators import context, diffs, search, symbols
from tracewake.sources.tables import first_per_id, table


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.lines_of(table(spark, d, "documents"), "doc_id", "text")


def search_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(_doc_lines(spark, d), r"retr(y|ies) (storm|after)|[Tt]imeout")


def search_fixed(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(_doc_lines(spark, d), fixed="ledger-core")


def search_capped(spark: SparkSession, d: str) -> DataFrame:
    return search.capped(search_regex(spark, d))


def search_in_glob(spark: SparkSession, d: str) -> DataFrame:
    kb = search.lines_of(table(spark, d, "knowledge_base"), "file_path", "summary")
    return search.matching_lines(kb, "wraps", glob="internal/**/*.go").groupBy("path", "text").agg(F.count(F.lit(1)).alias("n"))


def match_format(spark: SparkSession, d: str) -> DataFrame:
    return search_fixed(spark, d).select(T.match_line(F.concat(F.lit("docs/"), F.col("path").cast("string")), F.col("line_no"), F.col("text")).alias("match"))


def slice_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.slices(table(spark, d, "documents"), "doc_id", "text", 3, 5)


def layered_read(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("at", (F.col("doc_id") % 40 + 1).cast("int"))
    return search.layered(docs, "doc_id", "text", "at", 2)


def layered_place(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("at", (F.col("doc_id") % 40 + 1).cast("int"))
    return search.layered(docs, "doc_id", "text", "at", 1)


def layered_top(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("at", F.lit(1))
    return search.layered(docs, "doc_id", "text", "at", 3)


def large_code(spark: SparkSession, d: str) -> DataFrame:
    diffs_ = _tasks(spark, d)
    return diffs_.select("id", context.is_large_code(F.col("input_diff")).alias("large"))


def symbols_given(spark: SparkSession, d: str) -> DataFrame:
    """Languages under other names, in any case, and an unknown one."""
    n = F.col("doc_id") % 6
    given = F.when(n == 0, "Golang").when(n == 1, "py").when(n == 2, "TSX").when(n == 3, "kotlin").when(n == 4, "cobol").otherwise("js")
    return symbols.symbols(table(spark, d, "documents").withColumn("given", given), "doc_id", "text", "given").withColumnRenamed("id", "doc_id")


def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.glob_paths(table(spark, d, "knowledge_base"), "file_path", "**/[i-p]*/*_audit.?[oy]")


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    rel = T.relative_path(F.col("repo_path"), "/srv/workspace")
    return table(spark, d, "repos").select("repo_name", rel.alias("rel"), T.path_to_uri(F.col("repo_path")).alias("uri"), T.uri_to_path(T.path_to_uri(F.col("repo_path"))).alias("back"))


def list_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.list_items(F.col("text")).alias("i")).select("doc_id", F.size("i").alias("items"), F.array_join("i", "|").alias("joined"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return first_per_id(table(spark, d, "analysis_tasks").where("input_diff IS NOT NULL"), "input_diff")


def diff_functions(spark: SparkSession, d: str) -> DataFrame:
    return diffs.changed_functions(_tasks(spark, d))


def functions_by_repo(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repos").withColumn("ord", F.row_number().over(Window.partitionBy().orderBy("repo_name")))  # 48 rows, fixed
    found = diffs.changed_functions(_tasks(spark, d)).select(F.concat(F.regexp_extract("file", "^([^/]+)", 1), F.lit("/"), F.col("func_name")).alias("func_name"))
    return diffs.group_by_repo(diffs.infer_repo(found, repos)).select("repo", F.size("functions").alias("functions"), F.sha2(F.array_join("functions", ","), 256).alias("digest"))


def symbols_of_docs(spark: SparkSession, d: str) -> DataFrame:
    return symbols.symbols(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def verify_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The file sections of all diffs as the workspace's files; every third node comes without its file."""
    section = F.explode(F.split("input_diff", r"(?m)^(?=\+\+\+ )")).alias("content")
    files = _tasks(spark, d).select(F.lit("any").alias("repo"), section).where(F.col("content").startswith("+++ "))
    files = files.select("repo", F.regexp_replace(F.regexp_extract("content", r"^\+\+\+ ([^\r\n]*)", 1), "^b/", "").alias("path"), "content")
    name = F.regexp_extract("symbol", r"(\w+)$", 1)
    nodes = table(spark, d, "knowledge_base").select(F.lit("any").alias("repo"), F.when(F.length(name) % 3 > 0, F.col("file_path")).alias("file_path"), name.alias("func_name")).distinct()
    return search.verified(nodes, files).select("file_path", "func_name", "verified")


QUERIES = {
    f.__name__: f
    for f in (search_regex, search_fixed, search_capped, search_in_glob, match_format, slice_lines, layered_place, layered_read, layered_top, glob_paths, relative_paths, list_items, diff_functions, functions_by_repo, symbols_of_docs, symbols_given, large_code, verify_nodes)
}


def _lines(t: str, path: str, c: str) -> str:
    flat = f"regexp_replace(regexp_replace({c}, '\\r(\\n|\\z)', '\\1', 'g'), '\\n\\z', '')"
    return f"(SELECT path, cast(i AS INT) AS line_no, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {path} AS path, CASE WHEN {c} = '' THEN [] ELSE string_split({flat}, chr(10)) END AS l FROM {t} WHERE {c} IS NOT NULL)))"


_DOCS = _lines("documents", "doc_id", "text")
_TASKS = "(SELECT id, input_diff FROM (SELECT id, input_diff, row_number() OVER (PARTITION BY id ORDER BY loaded_at, input_diff) AS r FROM analysis_tasks WHERE input_diff IS NOT NULL AND id IS NOT NULL) WHERE r = 1)"
_NAMES = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in diffs.FUNCTION_PATTERNS) + ")"
_FUNCTIONS = f"""
  l AS (SELECT path AS id, line_no, text FROM {_lines(_TASKS, 'id', 'input_diff')}),
  h AS (SELECT *, CASE WHEN text LIKE '+++ %' THEN regexp_replace(substr(text, 5), '^b/', '') END AS f,
          CASE WHEN text LIKE '@@%' THEN coalesce(try_cast(regexp_extract(text, '^@@[^+]*\\+(\\d+)', 1) AS INT), 0) END AS hs,
          CASE WHEN text LIKE '+++ %' OR text LIKE '@@%' OR text LIKE '-%' OR text LIKE 'diff %' OR text LIKE 'index %' OR text LIKE 'new file%' OR text LIKE 'deleted file%' THEN 0 ELSE 1 END AS adv FROM l),
  g AS (SELECT *, sum(CASE WHEN f IS NOT NULL OR hs > 0 THEN 1 ELSE 0 END) OVER w AS grp, last_value(f IGNORE NULLS) OVER w AS file FROM h
        WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  n AS (SELECT *, sum(adv) OVER (PARTITION BY id, grp ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          + coalesce(first_value(CASE WHEN hs > 0 THEN hs - 1 END) OVER (PARTITION BY id, grp ORDER BY line_no), 0) AS no FROM g),
  fn AS (SELECT id, file, cast(no AS INT) AS line, {_NAMES} AS func_name FROM n WHERE text LIKE '+%' AND text NOT LIKE '+++ %' AND file IS NOT NULL AND file NOT IN ('', '/dev/null'))
"""


def _symbol_case(language: str, part: int) -> str:
    out = "CASE"
    for p, kind in symbols.SYMBOLS[language]:
        re2 = p.replace(T.EDGE_R, r"\b").replace(T.EDGE_L, r"\b")
        out += f" WHEN regexp_matches(text, '{re2}') THEN " + (f"regexp_extract(text, '{re2}', 1)" if part == 0 else f"'{kind}'")
    return out + " END"


_BY_LANGUAGE = ["CASE language" + "".join(f" WHEN '{g}' THEN {_symbol_case(g, k)}" for g in symbols.SYMBOLS) + " END" for k in (0, 1)]
_ANY_LANGUAGE = ["CASE WHEN language = 'cobol' THEN coalesce({go}, {js}) ELSE {known} END".format(go=_symbol_case("go", k), js=_symbol_case("js", k), known=_BY_LANGUAGE[k]) for k in (0, 1)]

SQL = {
    "search_regex": f"SELECT * FROM {_DOCS} WHERE regexp_matches(text, 'retr(y|ies) (storm|after)|[Tt]imeout')",
    "search_fixed": f"SELECT * FROM {_DOCS} WHERE contains(text, 'ledger-core')",
    "search_capped": f"SELECT * FROM {_DOCS} WHERE regexp_matches(text, 'retr(y|ies) (storm|after)|[Tt]imeout') ORDER BY path, line_no LIMIT 100",
    "search_in_glob": f"SELECT path, text, count(*) AS n FROM {_lines('knowledge_base', 'file_path', 'summary')} WHERE regexp_matches(path, '^internal/(?:[^/]+/)*[^/]*\\.go$') AND regexp_matches(text, 'wraps') GROUP BY ALL",
    "match_format": f"SELECT 'docs/' || path || ':' || line_no || ':' || text AS match FROM {_DOCS} WHERE contains(text, 'ledger-core')",
    "slice_lines": f"WITH l AS (SELECT path, string_agg(format('{{:6d}}', line_no) || chr(9) || text, chr(10) ORDER BY line_no) AS s FROM {_DOCS} WHERE line_no BETWEEN 3 AND 7 GROUP BY path) SELECT doc_id AS path, CASE WHEN s IS NULL THEN CASE WHEN text IS NOT NULL THEN '(file has fewer than 3 lines)' END ELSE s || chr(10) END AS slice FROM documents LEFT JOIN l ON doc_id = path",
    "layered_read": f"WITH l AS (SELECT path, string_agg(format('{{:6d}}', line_no) || chr(9) || text, chr(10) ORDER BY line_no) AS s FROM {_DOCS} WHERE line_no BETWEEN greatest(1, path % 40 - 4) AND greatest(1, path % 40 - 4) + 29 GROUP BY path) SELECT doc_id AS path, CASE WHEN s IS NULL THEN CASE WHEN text IS NOT NULL THEN '(file has fewer than ' || greatest(1, doc_id % 40 - 4) || ' lines)' END ELSE s || chr(10) END AS slice FROM documents LEFT JOIN l ON doc_id = path",
    "glob_paths": "SELECT DISTINCT file_path AS path FROM knowledge_base WHERE regexp_matches(file_path, '^(?:[^/]+/)*[i-p][^/]*/[^/]*_audit\\.[^/][oy]$') AND NOT regexp_matches(file_path, '(?:^|/)\\.[^/]+/')",
    "relative_paths": "SELECT repo_name, CASE WHEN starts_with(repo_path, '/srv/workspace/') THEN substr(repo_path, 16) ELSE repo_path END AS rel, 'file://' || repo_path AS uri, repo_path AS back FROM repos",
    "list_items": "WITH i AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^-', ''), '^\\s+|\\s+$', '', 'g'), '^\\*', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS i FROM documents) SELECT doc_id, cast(len(i) AS INT) AS items, array_to_string(i, '|') AS joined FROM i",
    "diff_functions": f"WITH {_FUNCTIONS} SELECT id, file, line, func_name, 'added' AS change_type FROM fn WHERE func_name IS NOT NULL",
    "functions_by_repo": f"WITH {_FUNCTIONS}, r AS (SELECT repo_name, row_number() OVER (ORDER BY repo_name) AS ord FROM repos), u AS (SELECT DISTINCT regexp_extract(file, '^([^/]+)', 1) || '/' || func_name AS f FROM fn WHERE func_name IS NOT NULL), o AS (SELECT f, coalesce((SELECT arg_min(repo_name, ord) FROM r WHERE starts_with(f, repo_name || '/') OR starts_with(f, repo_name || '.')), (SELECT arg_min(repo_name, ord) FROM r), 'unknown') AS repo FROM u) SELECT repo, cast(count(*) AS INT) AS functions, sha256(string_agg(f, ',' ORDER BY f)) AS digest FROM o GROUP BY repo",
    "symbols_of_docs": f"WITH d AS (SELECT doc_id, text AS code, CASE WHEN regexp_matches(text, '\\bpackage\\s+\\w+') THEN 'go' WHEN regexp_matches(text, '\\bdef\\s+\\w+\\s*\\(') THEN 'python' WHEN regexp_matches(text, '\\bpublic\\s+(static\\s+)?(?:void|class|interface)\\b') THEN 'java' WHEN regexp_matches(text, '(?:import|export|const|let|var|=>)') THEN 'js' ELSE 'go' END AS language FROM documents WHERE text <> ''), l AS (SELECT doc_id, language, cast(i AS INT) AS line, regexp_replace(s[i], '^\\s*\\d+\\t', '') AS text FROM (SELECT doc_id, language, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, language, string_split(code, chr(10)) AS s FROM d))) SELECT doc_id, language, {_BY_LANGUAGE[0]} AS name, {_BY_LANGUAGE[1]} AS kind, line FROM l WHERE {_BY_LANGUAGE[1]} IS NOT NULL",
    "verify_nodes": f"WITH c AS (SELECT unnest(string_split(chr(10) || input_diff, chr(10) || '+++ ')[2:]) AS t FROM {_TASKS}), f AS (SELECT regexp_replace(regexp_extract(t, '^[^\\r\\n]*'), '^b/', '') AS path, '+++ ' || t AS content FROM c), n AS (SELECT DISTINCT CASE WHEN length(s) % 3 > 0 THEN file_path END AS file_path, s AS func_name FROM (SELECT file_path, regexp_extract(symbol, '(\\w+)$', 1) AS s FROM knowledge_base)), w AS (SELECT string_agg(content, chr(10)) AS all_text FROM f), v AS (SELECT n.file_path, func_name, coalesce(bool_or(contains(content, func_name)), false) AS verified FROM n LEFT JOIN f ON path = file_path WHERE coalesce(n.file_path, '') <> '' GROUP BY ALL) SELECT file_path, func_name, verified AND func_name <> '' AS verified FROM v UNION ALL SELECT file_path, func_name, func_name <> '' AND contains((SELECT all_text FROM w), func_name) FROM n WHERE coalesce(file_path, '') = ''",
    "layered_place": "SELECT doc_id AS path, doc_id || ':' || (doc_id % 40 + 1) AS slice FROM documents",
    "layered_top": f"WITH l AS (SELECT path, string_agg(format('{{:6d}}', line_no) || chr(9) || text, chr(10) ORDER BY line_no) AS s FROM {_DOCS} WHERE line_no <= 200 GROUP BY path) SELECT doc_id AS path, CASE WHEN s IS NULL THEN CASE WHEN text IS NOT NULL THEN '(file has fewer than 1 lines)' END ELSE s || chr(10) END AS slice FROM documents LEFT JOIN l ON doc_id = path",
    "large_code": "SELECT id, strlen(input_diff) >= 2000 AND contains(input_diff, chr(10)) AND (" + " OR ".join(f"contains(input_diff, '{m}')" for m in context.CODE_MARKS) + f") AS large FROM {_TASKS}",
    "symbols_given": f"WITH d AS (SELECT doc_id, text AS code, ['go', 'python', 'js', 'java', 'cobol', 'js'][doc_id % 6 + 1] AS language FROM documents WHERE text <> ''), l AS (SELECT doc_id, language, cast(i AS INT) AS line, regexp_replace(s[i], '^\\s*\\d+\\t', '') AS text FROM (SELECT doc_id, language, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, language, string_split(code, chr(10)) AS s FROM d))) SELECT doc_id, language, {_ANY_LANGUAGE[0]} AS name, {_ANY_LANGUAGE[1]} AS kind, line FROM l WHERE {_ANY_LANGUAGE[1]} IS NOT NULL",
}
