"""Call graphs: expansion, the cross-repository fix-point, entry points, impact."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut


#: Sources with more than 1/HUBS of all edges are hubs, at most HUBS of them; their edges lie in SALTS partitions.
HUBS, SALTS = 512, 32


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into the nodes. edges: src, dst; nodes: node."""
    return edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def call_hierarchy(sites: DataFrame, definitions: DataFrame, nodes: DataFrame, incoming: bool = True) -> DataFrame:
    """node, func_name, file_path, line, repo: who calls each node and from where, or whom it calls and where that is defined.

    sites: src, dst, line of each call; definitions: node, func_name, file_path, line, repo.
    Of several calls between two functions the first line counts; without one it is 1.
    """
    one, other = ("dst", "src") if incoming else ("src", "dst")
    calls = sites.join(nodes.select(F.col("node").alias(one)).distinct(), one, "left_semi").groupBy("src", "dst").agg(F.min("line").alias("call_line"))
    d = definitions.select(F.col("node").alias(other), "func_name", "file_path", F.col("line").alias("def_line"), "repo")
    line = F.coalesce("call_line" if incoming else "def_line", F.lit(1))
    return calls.join(d, other).select(F.col(one).alias("node"), "func_name", "file_path", line.alias("line"), "repo")


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None, every: int = 4, stop: DataFrame | None = None) -> DataFrame:
    """node, depth: breadth-first from the roots, each node once at its least depth.

    Every round joins the frontier with the edges, drops what was seen and cuts the
    lineage by a checkpoint, so a round's plan never grows. Cycles and self-loops end
    because roots count as seen. Edges of hubs are spread over partitions, and the
    frontier's hubs go to each of them. All that can be reached is, unless max_rounds
    asks for the nodes within so many hops. Nodes of stop are reached but not left.
    Null ends of edges are no nodes.
    """
    return walked(edges, roots, max_rounds, every, stop)[0]


def walked(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None, every: int = 4, stop: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(as reachable, whether max_rounds ended the walk before all was reached)."""
    plain = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    e = cut(plain)
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total = degree.agg(F.sum("n")).first()[0] or 0
    hubs = cut(degree.where(F.col("n") > max(total // HUBS, 1000)).select("src", F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(0)
    # written once, partitioned by the join key, so no round shuffles the edges again
    e = cut(e.join(F.broadcast(hubs), "src", "left").select("src", salt.alias("salt"), "dst").repartition("src", "salt"))
    salts = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ends = stop.select("node").distinct() if stop is not None else None
    frontier = cut(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in count(1):
        open_ = frontier if ends is None else frontier.join(ends, "node", "left_anti")
        spread = open_.select(F.col("node").alias("src")).join(F.broadcast(hubs), "src", "left").select("src", salts.alias("salt"))
        step = e.join(spread, ["src", "salt"]).select(F.col("dst").alias("node")).distinct()
        nxt = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if nxt.isEmpty():
            return seen, False
        if max_rounds is not None and depth > max_rounds:
            return seen, True
        seen = seen.unionByName(nxt)
        if depth % every == 0:
            seen = cut(seen)
        frontier = nxt
    raise AssertionError("unreachable")


def reached_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The call graph's edges between reached nodes, each once."""
    n = nodes.select("node")
    return edges.select("src", "dst").distinct().join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def entry_points(nodes: DataFrame, owners: DataFrame, repos: DataFrame) -> DataFrame:
    """Reached nodes in repositories of role entry. owners: node, repo; repos: repo_name, repo_role."""
    entry = repos.where(F.col("repo_role") == "entry").select(F.col("repo_name").alias("repo"))
    return nodes.join(owners, "node").join(entry, "repo", "left_semi").select("node", "depth", "repo")


def impact(nodes: DataFrame, owners: DataFrame, root_repo: DataFrame) -> DataFrame:
    """repo, functions, is_direct: how many reached functions lie in the root's repository and elsewhere."""
    per = nodes.join(owners, "node", "left").withColumn("repo", F.coalesce("repo", F.lit("unknown"))).groupBy("repo").agg(F.count(F.lit(1)).alias("functions"), F.min("depth").alias("nearest"))
    roots = root_repo.select("repo").distinct().withColumn("is_direct", F.lit(True))
    return per.join(roots, "repo", "left").withColumn("is_direct", F.coalesce("is_direct", F.lit(False)))


def result_structs(nodes: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """task_id and one result struct per task: nodes, edges, entry points and impact.

    nodes: task_id, ord, func_name, file_path, line, repo, is_root; entries: task_id, ord and the
    fields of a node, protocol, path; edges: task_id, src, dst (function names). Lists keep
    their order, edges are sorted and each once. A task's lists are one result by definition.
    """
    node = F.struct("func_name", "file_path", "line", "repo", F.when(F.col("is_root"), "entry").otherwise("middle").alias("node_type"))
    root = F.max(F.when(F.col("is_root"), F.col("repo")))
    per = nodes.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", node.alias("n")))), lambda x: x["n"]).alias("nodes"), root.alias("root_repo"))
    ent = F.struct(F.struct("func_name", "file_path", "line", "repo").alias("node"), F.coalesce("protocol", F.lit("HTTP")).alias("protocol"), "path")
    per_e = entries.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", ent.alias("e")))), lambda x: x["e"]).alias("entry_points"))
    per_x = edges.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    out = per.join(per_e, "task_id", "left").join(per_x, "task_id", "left")
    direct = F.filter("nodes", lambda n: n["repo"].eqNullSafe(F.col("root_repo")))
    cross = F.array_sort(F.array_distinct(F.transform(F.filter("nodes", lambda n: ~n["repo"].eqNullSafe(F.col("root_repo"))), lambda n: F.concat(F.coalesce(n["repo"], F.lit("unknown")), F.lit("."), n["func_name"]))))
    return out.select(
        "task_id", "nodes", "edges", "entry_points",
        F.struct(F.transform(direct, lambda n: n["func_name"]).alias("direct_functions"), cross.alias("cross_repo_impact"), F.size(direct).alias("direct_count"), F.size(cross).alias("cross_repo_count")).alias("impact_summary"),
    )
