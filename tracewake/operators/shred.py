"""Deeply nested semi-structured records to related flat tables by shared inlining (problem 5).

Each record is parsed once into rows of its elements: objects, and the members of
lists. Every row carries the record's id, its own path, the path of its parent, its
positions in the lists above it and its scalar fields. The schema graph (which
element holds which, once or many times) is then read off these rows, joined with
the declared one. Elements that are repeated, shared by several parents or
recursive keep a table; a singleton with one parent is inlined into the nearest
ancestor that has one, and the rows below it are linked to that ancestor.

Fields may be spelled in several ways; those of no declared element are kept too:
scalars as attributes under their own name, objects and lists as elements named
after their field. Python parses the JSON because its shape isn't known before.

Nulls and edge cases: null, blank, incomplete or non-container JSON gives no rows;
wrappers (JSON strings and outer objects) and nesting may have any depth, and of several
containers in a wrapper the first with a known element counts; null list elements
count as positions and give no row; an element without any known field gives a row
with the fields it has (nodes without a name give none in the list form); a null
record id is no record; of a redelivered id the delivery loaded first counts.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.functions.deepjson import loads
from tracewake.session import cut
from tracewake.sources.tables import first_per_id


@dataclass(frozen=True)
class Edge:
    field: str
    element: str
    many: bool = False


#: element: the elements it holds
GRAPH: dict[str, tuple[Edge, ...]] = {
    "analysis_result": (
        Edge("downward_chain", "call_chain"),
        Edge("upward_chains", "call_chain", True),
        Edge("entry_points", "entry_point", True),
        Edge("impact_summary", "impact_summary"),
    ),
    "call_chain": (Edge("nodes", "call_node", True), Edge("edges", "call_edge", True)),
    "call_edge": (Edge("from", "call_node"), Edge("to", "call_node")),
    "entry_point": (Edge("node", "call_node"), Edge("test_scenarios", "scenario", True)),
    "call_node": (Edge("note", "note"),),
    "note": (Edge("tags", "tag", True),),
    "impact_summary": (Edge("direct_functions", "function_ref", True), Edge("cross_repo_impact", "function_ref", True)),
    "scenario": (),
    "tag": (),
    "function_ref": (),
}

#: element: attribute and the spellings of its field, lower case without underscores
FIELDS: dict[str, dict[str, tuple[str, ...]]] = {
    "analysis_result": {"task_id": ("taskid",), "input_type": ("inputtype",), "self_check_report": ("selfcheckreport",)},
    "call_chain": {"direction": ("direction",)},
    "call_node": {
        "func_name": ("funcname", "function", "symbol", "func", "functionname", "name"),
        "file_path": ("filepath", "file"),
        "line": ("line", "linenumber"),
        "repo": ("repo", "reponame"),
        "package": ("package",),
        "node_type": ("nodetype",),
    },
    "note": {"by": ("by",)},
    "entry_point": {"protocol": ("protocol",), "path": ("path",)},
    "impact_summary": {"direct_count": ("directcount",), "cross_repo_count": ("crossrepocount",)},
    "call_edge": {},
    "scenario": {"description": ("description", "scenario", "text")},
    "tag": {"tag": ("tag",)},
    "function_ref": {"func_name": ("funcname", "function", "symbol", "name")},
}

ROWS = "result_id string, table_name string, row_id string, parent_table string, parent_id string, role string, many boolean, parent_no int, item_no int, label string, attributes map<string,string>"
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
ROOT = "analysis_result"
#: Longer paths are shortened, so that deep nesting doesn't cost the square of its depth.
PATH_LENGTH = 1000
#: Edges of the observed schema that are analysed; elements of rarer ones keep tables of their own.
MAX_EDGES = 10_000


def own_tables(graph: dict[str, tuple[Edge, ...]], root: str) -> set[str]:
    """Elements with a table: the root, repeated ones, shared ones, recursive ones."""
    parents: dict[str, int] = {}
    out = {root}
    for edges in graph.values():
        for e in edges:
            parents[e.element] = parents.get(e.element, 0) + 1
            if e.many:
                out.add(e.element)
    out |= {x for x, n in parents.items() if n > 1}

    def recursive(x: str) -> bool:
        seen, todo = set(), [e.element for e in graph.get(x, ())]
        while todo:
            y = todo.pop()
            if y == x:
                return True
            if y not in seen:
                seen.add(y)
                todo += [e.element for e in graph.get(y, ())]
        return False

    return out | {x for x in graph if x not in out and recursive(x)}


_PLAIN: dict[str, str] = {}


def _plain(key: str) -> str:
    """A field's name without case and separators; those seen last are kept."""
    p = _PLAIN.get(key)
    if p is None:
        if len(_PLAIN) > 100_000:
            _PLAIN.clear()
        p = _PLAIN[key] = key.lower().replace("_", "").replace("-", "")
    return p


def _known(d: dict, element: str) -> bool:
    have = {_plain(k) for k in d}
    names = {n for spellings in FIELDS[element].values() for n in spellings} | {_plain(e.field) for e in GRAPH[element]}
    return bool(have & names)


def _container(text: str) -> object:
    try:
        return loads(text)
    except ValueError:
        return None


def _holds_known(x: object, elements: tuple[str, ...]) -> bool:
    some = x if isinstance(x, list) else [x]
    return any(isinstance(v, dict) and any(_known(v, e) for e in elements) for v in some)


def unwrap(text: object, elements: tuple[str, ...]) -> object:
    """The list or object inside JSON strings and outer objects; None if there is none."""
    todo, spare = [text], None
    while todo:  # depth first, so that the first container with a known element wins
        x = todo.pop()
        if isinstance(x, str):
            todo.append(_container(x) if x.lstrip()[:1] in ("[", "{", '"') else None)
        elif isinstance(x, list | dict):
            if _holds_known(x, elements) or (isinstance(x, list) and x and all(isinstance(v, str) for v in x if v is not None) and any(_holds_known(_container(v), elements) for v in x if v and v.lstrip()[:1] == "{")):
                return x
            spare = x if spare is None or isinstance(spare, dict) else spare
            if isinstance(x, dict):
                todo += [v for v in reversed(x.values()) if isinstance(v, dict | list) or (isinstance(v, str) and v.lstrip()[:1] in ("[", "{", '"'))]
    return spare


def result_of(call_chain: object, entry_points: object) -> dict | None:
    """Both columns as one analysis result; a bare list is the downward chain's nodes."""
    x = unwrap(call_chain, ("analysis_result", "call_chain", "call_node"))
    if isinstance(x, list):
        x = {"downward_chain": {"nodes": x}}
    elif isinstance(x, dict) and not ({_plain(k) for k in x} & {"downwardchain", "upwardchains", "entrypoints", "taskid"}):
        x = {"downward_chain": x if any(_plain(k) == "nodes" for k in x) else {"nodes": [x]}} if x else {}
    e = unwrap(entry_points, ("entry_point", "call_node"))
    if isinstance(e, dict) and any(_plain(k) == "entrypoints" for k in e):
        e = next(v for k, v in e.items() if _plain(k) == "entrypoints")
    if isinstance(e, dict):
        e = [e] if e else []
    if isinstance(e, list) and any(v is not None for v in e):
        x = {k: v for k, v in (x or {}).items() if _plain(k) != "entrypoints"} | {"entry_points": e}
    return x


class Shredder:
    """Walks one record and collects the rows of all its elements."""

    def __init__(self, skip: tuple[str, ...] = ()):
        self.skip = set(skip)
        self.edges = {e: {_plain(x.field): x for x in edges} for e, edges in GRAPH.items()}
        self.spelled = {e: {s: (a, rank) for a, spellings in fields.items() for rank, s in enumerate(spellings)} for e, fields in FIELDS.items()}
        self.rows: list[tuple] = []

    def record(self, rid: str, result: dict) -> None:
        self._element(rid, ROOT, result, "$", None, None, "", False, (0, 0))

    def _element(self, rid: str, element: str, x: object, path: str, up: str | None, up_path: str | None, role: str, many: bool, pos: tuple[int, int]) -> None:
        if len(path) > PATH_LENGTH:  # deep paths go on behind their digest
            path = "$~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        if isinstance(x, str) and element not in ("scenario", "tag", "function_ref") and x.lstrip()[:1] in ("[", "{", '"'):
            inner = _container(x)
            x = x if inner is None else inner
        if x is None:
            return
        if element == "entry_point" and isinstance(x, dict) and not any(_plain(k) == "node" for k in x):
            x = {"node": x} | {k: v for k, v in x.items() if _plain(k) in ("protocol", "path", "testscenarios")}  # a bare node
        if isinstance(x, list):
            if element == "call_chain":
                x = {"nodes": x}
            else:  # a list in a list
                for i, y in enumerate(x):
                    self._element(rid, element, y, f"{path}[{i}]", up, up_path, role, True, (pos[1], i))
                return
        own: dict[str, str] = {}
        inner: list[tuple[str, object]] = []
        if isinstance(x, dict):
            spelled, edges = self.spelled.get(element, {}), self.edges.get(element, {})
            best: dict[str, tuple[int, str]] = {}  # attribute: rank and name of the spelling that gives it
            seen = set()
            for key, v in x.items():
                k = _plain(key)
                if v is None or k in seen:
                    continue
                seen.add(k)
                if isinstance(v, dict | list) or k in edges:
                    inner.append((k, v))
                    continue
                a, rank = spelled.get(k, (k, 0))
                text = v if isinstance(v, str) else _text(v)
                if a in best:  # the first spelling with a value gives the attribute, others keep their own name
                    if rank < best[a][0]:
                        own[best[a][1]] = own[a]
                    else:
                        own[k] = text
                        continue
                best[a] = (rank, k)
                own[a] = text
        else:
            own[next(iter(FIELDS.get(element, {})), "value")] = _text(x)
        label = next((own[a] for a in ("func_name", "description", "tag") if own.get(a, "").strip()), None)
        self.rows.append((rid, element, path, up, up_path, role, many, *pos, label, list(own.items())))
        for k, v in inner:
            e = self.edges.get(element, {}).get(k) or Edge(k, k, isinstance(v, list))
            if v is None or e.field in self.skip:
                continue
            where = f"{path}.{e.field}"
            if isinstance(v, str) and e.many:
                v = w if isinstance(w := _container(v), list) else v
            if isinstance(v, list) and e.element != "call_chain" or e.many:
                for i, y in enumerate(v if isinstance(v, list) else [v]):
                    self._element(rid, e.element, y, f"{where}[{i}]", element, path, e.field, True, (pos[1], i))
            else:
                self._element(rid, e.element, v, where, element, path, e.field, False, pos)


def _text(v: object) -> str:
    if isinstance(v, str):
        return v
    return str(v) if type(v) is int else json.dumps(v, ensure_ascii=False)


def shred(results: DataFrame, tables: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all elements, or of the named ones, in long form; one delivery per result id."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # frames of Python functions take no C stack
        types = pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ") for c in ROWS.split(", "))])
        for batch in batches:
            s = Shredder()
            for rid, chain, entries in zip(*(batch.column(c).to_pylist() for c in ("id", "call_chain", "entry_points")), strict=True):
                if (result := result_of(chain, entries)) is not None:
                    s.record(rid, result)
            kept = [r for r in s.rows if not tables or r[1] in tables]
            columns = list(zip(*kept, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return first_per_id(results, "call_chain", "entry_points").mapInArrow(rows, ROWS)


def schema_graph(rows: DataFrame) -> dict[str, tuple[Edge, ...]]:
    """The declared graph with the edges that the data show, and with their multiplicity."""
    seen = rows.where("parent_table IS NOT NULL").groupBy("parent_table", "role", "table_name").agg(F.max("many").alias("many"), F.count(F.lit(1)).alias("n"))
    graph = {e: {(x.field, x.element): x for x in edges} for e, edges in GRAPH.items()}
    for r in seen.orderBy(F.col("n").desc(), "parent_table", "role", "table_name").limit(MAX_EDGES).collect():
        known = graph.setdefault(r["parent_table"], {})
        graph.setdefault(r["table_name"], {})
        old = known.get((r["role"], r["table_name"]))
        known[r["role"], r["table_name"]] = Edge(r["role"], r["table_name"], r["many"] or bool(old and old.many))
    return {e: tuple(edges.values()) for e, edges in graph.items()}


def inlined_elements(graph: dict[str, tuple[Edge, ...]]) -> list[tuple[str, str, str]]:
    """(element, parent, field) of the elements without a table, parents before children."""
    tables = own_tables(graph, ROOT)
    parent = {e.element: (p, e.field) for p, edges in graph.items() for e in edges if e.element not in tables}

    def depth(x: str) -> int:
        return 1 + depth(parent[x][0]) if x in parent else 0

    return [(e, *parent[e]) for e in sorted(parent, key=lambda e: (depth(e), e))]


def inlined(rows: DataFrame, graph: dict[str, tuple[Edge, ...]]) -> DataFrame:
    """The rows of the elements with tables; singletons are merged into the attributes of their nearest ancestor with one."""
    chain = inlined_elements(graph)
    gone = [e for e, _, _ in chain]
    kept = rows.where(~F.col("table_name").isin(gone)) if gone else rows
    key = ["result_id", "up"]
    link = None  # row of an inlined element to its nearest ancestor with a table
    merged = None
    prefix: dict[str, str] = {}
    for e, p, field in chain:
        prefix[e] = prefix.get(p, "") + field + "_"
        mine = rows.where(F.col("table_name") == e)
        if p in prefix:
            above = link.select("result_id", F.col("row_id").alias("parent_id"), "up_table", "up")
            mine = mine.join(above, ["result_id", "parent_id"])
        else:
            mine = mine.withColumn("up_table", F.col("parent_table")).withColumn("up", F.col("parent_id"))
        mine = mine.select("result_id", "row_id", "up_table", "up", F.transform_keys("attributes", lambda k, _: F.concat(F.lit(prefix[e]), k)).alias("attributes"))
        link = mine.select("result_id", "row_id", "up_table", "up") if link is None else link.unionByName(mine.select("result_id", "row_id", "up_table", "up"))
        merged = mine if merged is None else merged.unionByName(mine)
    if merged is None:
        return kept
    extra = merged.groupBy(*key).agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("attributes")))).alias("more"))
    below = kept.where(F.col("parent_table").isin(gone)).join(link.select("result_id", F.col("row_id").alias("parent_id"), "up_table", "up"), ["result_id", "parent_id"])
    below = below.select(*[F.col("up_table").alias(c) if c == "parent_table" else F.col("up").alias(c) if c == "parent_id" else F.col(c) for c in rows.columns])
    linked = kept.where(F.coalesce(~F.col("parent_table").isin(gone), F.lit(True))).unionByName(below)
    # an attribute of the ancestor's own may have the name of an inlined one
    free = F.transform_keys("more", lambda k, _: F.when(F.array_contains(F.map_keys("attributes"), k), F.concat(k, F.lit("_inlined"))).otherwise(k))
    full = linked.join(extra.withColumnRenamed("up", "row_id"), ["result_id", "row_id"], "left")
    return full.select(*[F.when(F.col("more").isNull(), F.col("attributes")).otherwise(F.map_concat("attributes", free)).alias(c) if c == "attributes" else F.col(c) for c in rows.columns])


def flat_tables(results: DataFrame) -> tuple[DataFrame, dict[str, tuple[Edge, ...]]]:
    """All rows of all tables in long form, from one parse, and the schema graph."""
    rows = cut(shred(results))
    graph = schema_graph(rows)
    return inlined(rows, graph), graph


def chain_nodes(results: DataFrame) -> DataFrame:
    """task_id, repo, symbol of the nodes of call chains (not of upward chains), however the chain is written."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for task, chain in zip(batch["task_id"], batch["call_chain"], strict=True):
                s = Shredder(skip=("upward_chains", "entry_points", "impact_summary", "edges", "note", "test_scenarios"))
                if (result := result_of(chain, None)) is not None:
                    s.record("", result)
                out += [(task, dict(r[10]).get("repo"), r[9]) for r in s.rows if r[1] == "call_node"]
            yield pd.DataFrame(out, columns=["task_id", "repo", "symbol"])

    nodes = results.select("task_id", "call_chain").where("call_chain IS NOT NULL").mapInPandas(rows, "task_id string, repo string, symbol string")
    return nodes.where("symbol IS NOT NULL AND repo IS NOT NULL")


def result_texts(call_chain: Column) -> Column:
    """The JSON object inside JSON strings and outer objects, as text; null for lists and what is no JSON."""

    @F.pandas_udf("string")
    def inner(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(x) if isinstance(x := unwrap(t, ("analysis_result", "call_chain", "call_node")), dict) else None)

    return inner(call_chain)


def columns_of(element: str) -> list[str]:
    """Declared attributes of an element's table, those of its declared inlined elements included."""
    tables = own_tables(GRAPH, ROOT)
    inner = [f"{e.field}_{a}" for e in GRAPH[element] if e.element not in tables for a in FIELDS[e.element]]
    return [*FIELDS[element], *inner]


def flat_table(rows: DataFrame, element: str) -> DataFrame:
    """One element's table: keys, declared attributes as columns, the others in a map."""
    names = columns_of(element)
    other = F.map_filter("attributes", lambda k, _: ~k.isin(names))
    return rows.where(F.col("table_name") == element).select(
        "result_id", "row_id", "parent_table", "parent_id", "role", "parent_no", "item_no", *[F.col("attributes")[n].alias(n) for n in names], F.to_json(other).alias("other")
    )


def other_tables(rows: DataFrame) -> DataFrame:
    """The rows of elements that aren't declared, in long form."""
    return rows.where(~F.col("table_name").isin(*GRAPH))


def labelled_items(results: DataFrame) -> DataFrame:
    """result_id, list_name, parent_no, item_no, label of chains, entries and scenarios."""
    rows = shred(results)
    place = F.col("row_id")
    name = (
        F.when(F.col("table_name") == "scenario", F.when(place.rlike(r"^\$\.entry_points\["), "entry_scenarios"))
        .when(F.col("table_name") != "call_node", None)
        .when(place.rlike(r"^\$\.downward_chain\.nodes\[\d+\]$"), "call_chain")
        .when(place.rlike(r"^\$\.upward_chains\[\d+\]\.nodes\[\d+\]$"), "upward_chains")
        .when(place.rlike(r"^\$\.entry_points\[\d+\]\.node$"), "entry_points")
    )
    return rows.select("result_id", name.alias("list_name"), "parent_no", "item_no", "label").where("label IS NOT NULL AND list_name IS NOT NULL")
