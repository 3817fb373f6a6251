"""Queries of the general training-data problems 1, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewake.operators import history, orphans, shred
from tracewake.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parents = orphans.parents_of(table(spark, d, "analysis_tasks"), table(spark, d, "task_deletions"))
    return parents, orphans.children_of({t: table(spark, d, t) for t in ("feedback", "analysis_results")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*_orphans(spark, d)).select("source_table", "row_id")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_orphans(spark, d))


def _versions(spark: SparkSession, d: str, attributes: list[str]) -> DataFrame:
    forms = {a: history.normal_text(F.col(a)) for a in attributes}
    return history.history(table(spark, d, "knowledge_base"), ["repo_name", "symbol"], forms)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d, ["summary"])
    return v.select("repo_name", "symbol", F.unix_seconds("valid_from").alias("valid_from_s"), F.coalesce(F.unix_seconds("valid_to"), F.lit(-1)).alias("valid_to_s"))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d, ["summary", "file_path", "line_number"])
    return v.select("repo_name", "symbol", "summary", "file_path", "line_number", F.unix_seconds("valid_from").alias("valid_from_s"), F.coalesce(F.unix_seconds("valid_to"), F.lit(-1)).alias("valid_to_s"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.labelled_items(table(spark, d, "analysis_results"))


def _flat(spark: SparkSession, d: str, element: str) -> DataFrame:
    return shred.flat_table(shred.flat_tables(table(spark, d, "analysis_results"))[0], element)


def p5_results(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "analysis_result")


def p5_chains(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "call_chain")


def p5_call_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "call_node")


def p5_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "call_edge")


def p5_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "entry_point")


def p5_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "scenario")


def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "tag")


def p5_function_refs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "function_ref")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_orphan_counts, p4_found, p4_history, p5_found, p5_results, p5_chains, p5_call_nodes, p5_call_edges, p5_entry_points, p5_scenarios, p5_tags, p5_function_refs)
}

_KEY = "lower(regexp_replace(trim({c}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12288)||chr(160)), '[-{{}}]', '', 'g'))"
_REF = """
  p AS (SELECT {pk} AS k, min(loaded_at) AS at FROM analysis_tasks WHERE id IS NOT NULL GROUP BY 1),
  d AS (SELECT DISTINCT {dk} AS k FROM task_deletions WHERE restored_at IS NULL),
  c AS (SELECT t, id, loaded_at AS at, k, created_at AS created FROM (
          SELECT *, row_number() OVER (PARTITION BY t, id ORDER BY loaded_at NULLS LAST, k NULLS FIRST, created_at NULLS FIRST) AS r FROM (
            SELECT *, {ck} AS k FROM (SELECT 'feedback' AS t, id, task_id, loaded_at, created_at FROM feedback
              UNION ALL SELECT 'analysis_results', id, task_id, loaded_at, created_at FROM analysis_results) WHERE id IS NOT NULL)) WHERE r = 1),
  o AS (SELECT c.t, c.id, c.created, CASE WHEN p.k IS NULL THEN 'missing' WHEN d.k IS NOT NULL THEN 'deleted' WHEN p.at > c.at THEN 'late' END AS reason
        FROM c LEFT JOIN p ON c.k = p.k LEFT JOIN d ON c.k = d.k WHERE c.k <> '')
""".format(pk=_KEY.format(c="id"), dk=_KEY.format(c="task_id"), ck=_KEY.format(c="task_id"))

_VERSIONS = """
WITH k AS (SELECT *, coalesce(nullif(lower(trim(commit_hash)), ''), 'id:' || id) AS c FROM knowledge_base),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, symbol, c ORDER BY loaded_at, id) AS r FROM k) WHERE r = 1),
  n AS (SELECT *, trim(regexp_replace(lower(summary), '\\s+', ' ', 'g')) AS s FROM f),
  g AS (SELECT *, lag(s) OVER (PARTITION BY repo_name, symbol ORDER BY created_at, loaded_at, id) AS p FROM n WHERE s <> ''),
  v AS (SELECT * FROM g WHERE s IS DISTINCT FROM p)
SELECT repo_name, symbol, cast(floor(epoch(created_at)) AS BIGINT) AS valid_from_s,
  coalesce(cast(floor(epoch(lead(created_at) OVER (PARTITION BY repo_name, symbol ORDER BY created_at, loaded_at, id))) AS BIGINT), -1) AS valid_to_s
FROM v
"""

_ATTRIBUTES = ("summary", "file_path", "line_number")
_BY = "PARTITION BY repo_name, symbol ORDER BY created_at, loaded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND"
_HISTORY = f"""
WITH k AS (SELECT *, coalesce(nullif(lower(trim(commit_hash)), ''), 'id:' || id) AS c FROM knowledge_base),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, symbol, c ORDER BY loaded_at, id) AS r FROM k) WHERE r = 1),
  n AS (SELECT repo_name, symbol, created_at, loaded_at, id, {", ".join(f"cast({a} AS VARCHAR) AS {a}, nullif(trim(regexp_replace(lower(cast({a} AS VARCHAR)), '\\s+', ' ', 'g')), '') AS n_{a}" for a in _ATTRIBUTES)} FROM f),
  p AS (SELECT *, {", ".join(f"last_value(n_{a} IGNORE NULLS) OVER ({_BY} 1 PRECEDING) AS p_{a}" for a in _ATTRIBUTES)} FROM n),
  v AS (SELECT *, {", ".join(f"last_value(CASE WHEN n_{a} IS DISTINCT FROM p_{a} AND n_{a} IS NOT NULL THEN {a} END IGNORE NULLS) OVER ({_BY} CURRENT ROW) AS v_{a}, last_value(n_{a} IGNORE NULLS) OVER ({_BY} CURRENT ROW) AS m_{a}" for a in _ATTRIBUTES)} FROM p),
  e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, symbol, created_at ORDER BY loaded_at DESC, id DESC) AS q FROM v WHERE {" OR ".join(f"(n_{a} IS NOT NULL AND n_{a} IS DISTINCT FROM p_{a})" for a in _ATTRIBUTES)}) WHERE q = 1),
  g AS (SELECT *, {", ".join(f"lag(m_{a}) OVER (PARTITION BY repo_name, symbol ORDER BY created_at) AS l_{a}" for a in _ATTRIBUTES)}, row_number() OVER (PARTITION BY repo_name, symbol ORDER BY created_at) AS o FROM e),
  w AS (SELECT * FROM g WHERE o = 1 OR {" OR ".join(f"m_{a} IS DISTINCT FROM l_{a}" for a in _ATTRIBUTES)})
SELECT repo_name, symbol, {", ".join(f"v_{a} AS {a}" for a in _ATTRIBUTES)}, cast(floor(epoch(created_at)) AS BIGINT) AS valid_from_s,
  coalesce(cast(floor(epoch(lead(created_at) OVER (PARTITION BY repo_name, symbol ORDER BY created_at))) AS BIGINT), -1) AS valid_to_s FROM w
"""
STEP = "CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END WHEN json_type({x}) = 'OBJECT' AND json_exists({x}, '$.result') THEN {x} -> '$.result' ELSE {x} END"
_NAME = "coalesce(nullif({x} ->> '$.func_name', ''), nullif({x} ->> '$.Function', ''), nullif({x} ->> '$.symbol', ''))"
_ITEMS = f"""
WITH r AS (SELECT id, CASE WHEN json_valid(call_chain) THEN call_chain::JSON END AS c, CASE WHEN json_valid(entry_points) THEN entry_points::JSON END AS e
           FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS k FROM analysis_results WHERE id IS NOT NULL) WHERE k = 1),
  r1 AS (SELECT id, {STEP.format(x="c")} AS c, {STEP.format(x="e")} AS e FROM r),
  r2 AS (SELECT id, {STEP.format(x="c")} AS c, {STEP.format(x="e")} AS e FROM r1),
  r3 AS (SELECT id, {STEP.format(x="c")} AS c, {STEP.format(x="e")} AS e FROM r2),
  l AS (SELECT id, CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN json_extract(c, '$.downward_chain.nodes[*]') END AS n,
          CASE json_type(c) WHEN 'OBJECT' THEN json_extract(c, '$.upward_chains[*]') END AS u,
          CASE WHEN json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0 THEN [e] WHEN json_type(e) = 'ARRAY' THEN json_extract(e, '$[*]') END AS e,
          CASE json_type(c) WHEN 'OBJECT' THEN json_extract(c, '$.entry_points[*]') END AS ce FROM r3),
  m AS (SELECT id, n, u, CASE WHEN len(list_filter(coalesce(e, []), lambda x: json_type(x) <> 'NULL')) > 0 THEN e ELSE ce END AS e FROM l),
  nn AS (SELECT id, 'call_chain' AS list_name, 0 AS parent_no, i - 1 AS item_no, n[i] AS x FROM (SELECT id, n, unnest(range(1, len(n) + 1)) AS i FROM m)
    UNION ALL SELECT id, 'upward_chains', a - 1, i - 1, w[i] FROM (SELECT id, a, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, a, json_extract(u[a], '$.nodes[*]') AS w FROM (SELECT id, u, unnest(range(1, len(u) + 1)) AS a FROM m)))
    UNION ALL SELECT id, 'entry_points', 0, i - 1, CASE WHEN json_exists(e[i], '$.node') THEN e[i] -> '$.node' ELSE e[i] END FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS i FROM m)),
  ss AS (SELECT id, a, json_extract_string(e[a], '$.test_scenarios[*]') AS s FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS a FROM m))
SELECT id AS result_id, list_name, cast(parent_no AS INT) AS parent_no, cast(item_no AS INT) AS item_no, {_NAME.format(x="x")} AS label FROM nn WHERE {_NAME.format(x="x")} IS NOT NULL
UNION ALL SELECT id, 'entry_scenarios', cast(a - 1 AS INT), cast(i - 1 AS INT), s[i] FROM (SELECT id, a, s, unnest(range(1, len(s) + 1)) AS i FROM ss) WHERE s[i] <> ''
"""

_ROOTS = _ITEMS[: _ITEMS.index("  l AS (")] + """
  m AS (SELECT id, json_type(c) AS k, CASE json_type(c) WHEN 'OBJECT' THEN c END AS c, CASE json_type(c) WHEN 'ARRAY' THEN json_object('nodes', c) WHEN 'OBJECT' THEN c -> '$.downward_chain' END AS w,
          CASE WHEN json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0 THEN [e] WHEN json_type(e) = 'ARRAY' THEN json_extract(e, '$[*]') END AS e FROM r3),
  t AS (SELECT id, k, c, w, CASE WHEN len(list_filter(coalesce(e, []), lambda x: json_type(x) <> 'NULL')) > 0 THEN e WHEN k = 'OBJECT' THEN json_extract(c, '$.entry_points[*]') END AS e,
          len(list_filter(coalesce(e, []), lambda x: json_type(x) <> 'NULL')) > 0 OR k IN ('ARRAY', 'OBJECT') AS has FROM m),
  ch AS (SELECT id, 'downward_chain' AS role, 0 AS i, '$.downward_chain' AS p, w AS x FROM t WHERE json_type(w) = 'OBJECT'
    UNION ALL SELECT id, 'upward_chains', i - 1, '$.upward_chains[' || (i - 1) || ']', u[i] FROM (SELECT id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT id, json_extract(c, '$.upward_chains[*]') AS u FROM t)) WHERE json_type(u[i]) = 'OBJECT'),
  ed AS (SELECT id, p AS up, CASE role WHEN 'upward_chains' THEN i ELSE 0 END AS a, j - 1 AS j, p || '.edges[' || (j - 1) || ']' AS p, v[j] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM (SELECT *, json_extract(x, '$.edges[*]') AS v FROM ch)) WHERE json_type(v[j]) = 'OBJECT'),
  en AS (SELECT id, j - 1 AS j, '$.entry_points[' || (j - 1) || ']' AS p, e[j] AS x FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS j FROM t) WHERE json_type(e[j]) = 'OBJECT'),
  no AS (SELECT id, 'call_chain' AS ut, p AS up, 'nodes' AS role, CASE role WHEN 'upward_chains' THEN i ELSE 0 END AS a, j - 1 AS j, p || '.nodes[' || (j - 1) || ']' AS p, v[j] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM (SELECT *, json_extract(x, '$.nodes[*]') AS v FROM ch)) WHERE json_type(v[j]) = 'OBJECT'
    UNION ALL SELECT id, 'call_edge', p, 'from', a, j, p || '.from', x -> '$.from' FROM ed WHERE json_type(x -> '$.from') = 'OBJECT'
    UNION ALL SELECT id, 'call_edge', p, 'to', a, j, p || '.to', x -> '$.to' FROM ed WHERE json_type(x -> '$.to') = 'OBJECT'
    UNION ALL SELECT id, 'entry_point', p, 'node', 0, j, p || '.node', y FROM (SELECT *, CASE WHEN json_exists(x, '$.node') THEN x -> '$.node' ELSE x END AS y FROM en) WHERE json_type(y) = 'OBJECT')
"""


def _flat_sql(rows: str, keys: str, *attributes: str) -> str:
    return f"{_ROOTS} SELECT id AS result_id, {keys}, {', '.join(attributes)}, '{{}}' AS other FROM {rows}".replace(", , ", ", ")


def _keys(p: str, table: str, up: str, role: str, a: str, j: str) -> str:
    return f"{p} AS row_id, {table} AS parent_table, {up} AS parent_id, {role} AS role, cast({a} AS INT) AS parent_no, cast({j} AS INT) AS item_no"


def _of(*names: str) -> str:
    return "coalesce(" + ", ".join(f"x ->> '$.{n}'" for n in names) + ")"


_FLAT = {
    "p5_results": _flat_sql("t WHERE has", _keys("'$'", "NULL", "NULL", "''", "0", "0"), *[f"c ->> '$.{n}' AS {n}" for n in ("task_id", "input_type", "self_check_report")], *[f"c ->> '$.impact_summary.{n}' AS impact_summary_{n}" for n in ("direct_count", "cross_repo_count")]),
    "p5_chains": _flat_sql("ch", _keys("p", "'analysis_result'", "'$'", "role", "0", "i"), "x ->> '$.direction' AS direction"),
    "p5_call_nodes": _flat_sql(
        "no", _keys("p", "ut", "up", "role", "a", "j"), f"{_of('func_name', 'Function', 'symbol')} AS func_name", f"{_of('file_path', 'File', 'file')} AS file_path", f"{_of('line', 'Line')} AS line",
        f"{_of('repo', 'Repo')} AS repo", f"{_of('package', 'Package')} AS package", "x ->> '$.node_type' AS node_type", "x ->> '$.note.by' AS note_by",
    ),
    "p5_call_edges": _flat_sql("ed", _keys("p", "'call_chain'", "up", "'edges'", "a", "j")),
    "p5_entry_points": _flat_sql("en", _keys("p", "'analysis_result'", "'$'", "'entry_points'", "0", "j"), "x ->> '$.protocol' AS protocol", "x ->> '$.path' AS path"),
    "p5_scenarios": _flat_sql("(SELECT *, unnest(range(1, len(v) + 1)) AS k FROM (SELECT *, json_extract_string(x, '$.test_scenarios[*]') AS v FROM en)) WHERE v[k] IS NOT NULL", _keys("p || '.test_scenarios[' || (k - 1) || ']'", "'entry_point'", "p", "'test_scenarios'", "j", "k - 1"), "v[k] AS description"),
    "p5_tags": _flat_sql("(SELECT *, unnest(range(1, len(v) + 1)) AS k FROM (SELECT *, json_extract_string(x, '$.note.tags[*]') AS v FROM no)) WHERE v[k] IS NOT NULL", _keys("p || '.note.tags[' || (k - 1) || ']'", "'call_node'", "p", "'tags'", "j", "k - 1"), "v[k] AS tag"),
    "p5_function_refs": _flat_sql(
        "(SELECT *, unnest(range(1, len(v) + 1)) AS k FROM (SELECT id, 'direct_functions' AS role, json_extract_string(c, '$.impact_summary.direct_functions[*]') AS v FROM t UNION ALL SELECT id, 'cross_repo_impact', json_extract_string(c, '$.impact_summary.cross_repo_impact[*]') FROM t)) WHERE v[k] IS NOT NULL",
        _keys("'$.impact_summary.' || role || '[' || (k - 1) || ']'", "'analysis_result'", "'$'", "role", "0", "k - 1"), "v[k] AS func_name",
    ),
}

SQL = _FLAT | {
    "p4_history": _HISTORY,
    "p5_found": _ITEMS,
    "p1_found": f"WITH {_REF} SELECT t AS source_table, id AS row_id FROM o WHERE reason IS NOT NULL",
    "p1_orphan_counts": f"WITH {_REF} SELECT t AS source_table, strftime(created, '%Y-%m') AS period, reason, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_found": _VERSIONS,
}
