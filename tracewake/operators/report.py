"""Reports of analysis results as JSON, terminal text or Markdown, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "terminal", "markdown")
_S = F.lit


def _z(c: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(c, _S(""))


def _line(n: Column) -> Column:
    return F.coalesce(n.cast("string"), _S("0"))


def chain_path(nodes: Column) -> Column:
    """f (Ln) → g (Ln) → [变更点]; empty without nodes."""
    parts = F.transform(nodes, lambda n: F.concat(F.coalesce(_z(n["func_name"]), _S("")), _S(" (L"), _line(n["line"]), _S(")")))
    return F.when(F.size(nodes) > 0, F.concat(F.array_join(parts, " → "), _S(" → [变更点]"))).otherwise("")


def tree(nodes: Column, indent: bool, leaf: tuple[str, str] = ("", "")) -> Column:
    """One line a node; leaves show their repository, between the texts of leaf. indent: by position, else branches at one depth."""
    text = lambda n: F.when(n["node_type"] == "leaf", F.concat(_S(leaf[0]), _z(n["func_name"]), _S(" (底层: "), _z(n["repo"]), _S(f"){leaf[1]}"))).otherwise(
        F.concat(_z(n["func_name"]), _S(" ("), _z(n["file_path"]), _S(":"), _line(n["line"]), _S(")"))
    )
    if indent:
        return F.array_join(F.transform(nodes, lambda n, i: F.concat(_S("  "), F.repeat(_S("     "), i), _S("└─ "), text(n), _S("\n"))), "")
    size = F.size(nodes)
    return F.array_join(F.transform(nodes, lambda n, i: F.concat(_S("  "), F.when(i == size - 1, "└─").otherwise("├─"), _S(" "), text(n), _S("\n"))), "")


def numbered_nodes(nodes: Column) -> Column:
    """i. [repo] f (file:line); file and line where they are known."""
    place = lambda n: F.when(F.coalesce(_z(n["file_path"]), _S("")) == "", "").otherwise(
        F.concat(_S(" ("), _z(n["file_path"]), F.when(F.coalesce(n["line"], _S(0)) > 0, F.concat(_S(":"), _line(n["line"]))).otherwise(""), _S(")"))
    )
    return F.array_join(F.transform(nodes, lambda n, i: F.concat((i + 1).cast("string"), _S(". ["), _z(n["repo"]), _S("] "), _z(n["func_name"]), place(n))), "\n")


def direct_repo(nodes: Column) -> Column:
    return F.coalesce(F.get(nodes, 0)["repo"], _S("unknown"))


def _marked(label: Column, i: Column, entries: Column, wrap: str) -> Column:
    e = F.get(entries, i)
    no = (i + 1).cast("string")
    named = F.concat(_S("入口"), no, _S(f" {wrap}["), _z(e["protocol"]), _S("] "), _z(e["path"]), _S(wrap))
    return F.when(e.isNotNull(), named).otherwise(F.concat(_S("路径"), no))


def markdown(r: dict[str, Column], title: str = "分析报告") -> Column:
    """The Markdown report. r: downward, upward, entries, scenarios, impact, self_check columns."""
    nodes = r["downward"]["nodes"]
    first = F.get(nodes, 0)
    head = F.when(F.size(nodes) > 0, F.concat(_S("**变更函数:** `["), _z(first["repo"]), _S("] "), _z(first["func_name"]), _S("` (`"), _z(first["file_path"]), _S(":"), _line(first["line"]), _S("`)\n\n"))).otherwise("")
    down = F.when(F.size(nodes) > 1, F.concat(_S("## 向下追踪（实现路径）\n\n```\n"), tree(F.slice(nodes, 2, 1_000_000), True), _S("```\n\n"))).otherwise("")
    chain = lambda c, i: F.concat(_S("### "), _marked(_S(""), i, r["entries"], "`"), _S("\n\n```\n"), F.when(F.size(c["nodes"]) > 0, F.concat(_S("  └─ "), chain_path(c["nodes"]), _S("\n"))).otherwise(""), _S("```\n\n"))
    up = F.when(F.size(r["upward"]) > 0, F.concat(_S("## 向上追踪 → 集成测试入口\n\n"), F.array_join(F.transform(r["upward"], chain), ""))).otherwise("")
    case = lambda e: F.when(F.size(e["test_scenarios"]) > 0, F.concat(_S("- **测试场景:**\n"), F.array_join(F.transform(e["test_scenarios"], lambda s: F.concat(_S("  - "), s, _S("\n"))), ""))).otherwise("")
    entry = lambda e, i: F.concat(_S("### 入口"), (i + 1).cast("string"), _S("\n\n- **协议:** "), _z(e["protocol"]), _S("\n- **路径:** `"), _z(e["path"]), _S("`\n- **函数:** `"), _z(e["node"]["func_name"]), _S("` (`"), _z(e["node"]["file_path"]), _S(":"), _line(e["node"]["line"]), _S("`)\n"), case(e), _S("\n"))
    entries = F.when(F.size(r["entries"]) > 0, F.concat(_S("## 集成测试入口\n\n"), F.array_join(F.transform(r["entries"], entry), ""))).otherwise("")
    cases = F.when(F.size(r["scenarios"]) > 0, F.concat(_S("## 集成测试场景\n\n"), F.array_join(F.transform(r["scenarios"], lambda s: F.concat(_S("- **["), _z(s["entry_protocol"]), _S(" "), _z(s["entry_path"]), _S("]** "), _z(s["description"]), _S("\n"))), ""), _S("\n"))).otherwise("")
    im = r["impact"]
    items = lambda a: F.coalesce(F.array_join(F.transform(a, lambda f: F.concat(_S("  - `"), f, _S("`\n"))), ""), _S(""))
    direct = F.concat(_S("## 影响范围\n\n- **直接影响:** "), direct_repo(nodes), _S(" 内 "), _line(im["direct_count"]), _S(" 个函数\n"), items(im["direct_functions"]))
    cross = F.when(im["cross_repo_count"] > 0, F.concat(_S("- **跨仓影响:** "), _line(im["cross_repo_count"]), _S(" 处\n"), items(im["cross_repo_impact"]))).otherwise("")
    check = F.when(F.coalesce(r["self_check"], _S("")) != "", F.concat(_S("## 自检报告\n\n```\n"), r["self_check"], _S("\n```\n\n"))).otherwise("")
    return F.concat(_S(f"# {title}\n\n"), *[F.coalesce(p, _S("")) for p in (head, down, up, entries, cases, direct, cross, _S("\n"), check)])


def terminal(r: dict[str, Column], colours: bool = False) -> Column:
    """The terminal report; colours adds the escape codes."""
    c = {k: v if colours else "" for k, v in {"bold": "\033[1m", "cyan": "\033[36m", "yellow": "\033[33m", "green": "\033[32m", "blue": "\033[34m", "red": "\033[31m", "gray": "\033[90m", "off": "\033[0m"}.items()}
    nodes = r["downward"]["nodes"]
    first = F.get(nodes, 0)
    head = F.when(F.size(nodes) > 0, F.concat(_S(f"{c['bold']}{c['cyan']}变更函数:{c['off']} {c['yellow']}["), _z(first["repo"]), _S("] "), _z(first["func_name"]), _S(" ("), _z(first["file_path"]), _S(":"), _line(first["line"]), _S(f"){c['off']}\n"))).otherwise("")
    down = F.when(F.size(nodes) > 1, F.concat(_S(f"\n{c['bold']}向下追踪（实现路径）:{c['off']}\n"), tree(F.slice(nodes, 2, 1_000_000), False, (c["gray"], c["off"])))).otherwise("")
    chain = lambda x, i: F.concat(_S(f"  {c['green']}"), _marked(_S(""), i, r["entries"], ""), _S(f"{c['off']}\n"), F.when(F.size(x["nodes"]) > 0, F.concat(_S(f"    └─ {c['gray']}"), chain_path(x["nodes"]), _S(f"{c['off']}\n"))).otherwise(""))
    up = F.when(F.size(r["upward"]) > 0, F.concat(_S(f"\n{c['bold']}向上追踪 → 集成测试入口:{c['off']}\n"), F.array_join(F.transform(r["upward"], chain), ""))).otherwise("")
    cases = F.when(F.size(r["scenarios"]) > 0, F.concat(_S(f"\n{c['bold']}集成测试场景:{c['off']}\n"), F.array_join(F.transform(r["scenarios"], lambda s: F.concat(_S(f"  {c['blue']}["), _z(s["entry_protocol"]), _S(" "), _z(s["entry_path"]), _S(f"]{c['off']} "), _z(s["description"]), _S("\n"))), ""))).otherwise("")
    im = r["impact"]
    direct = F.concat(_S(f"\n{c['bold']}影响范围:{c['off']}\n  直接影响: {c['yellow']}"), direct_repo(nodes), _S(" 内 "), _line(im["direct_count"]), _S(f" 个函数{c['off']}\n"))
    cross = F.when(im["cross_repo_count"] > 0, F.concat(_S(f"  跨仓影响: {c['red']}"), F.array_join(im["cross_repo_impact"], "、"), _S(f"{c['off']}\n"))).otherwise("")
    check = F.when(F.coalesce(r["self_check"], _S("")) != "", F.concat(_S(f"\n{c['bold']}自检报告:{c['off']}\n{c['gray']}"), r["self_check"], _S(f"{c['off']}\n"))).otherwise("")
    return F.concat(*[F.coalesce(p, _S("")) for p in (head, down, up, cases, direct, cross, check)])


def reports(results: DataFrame, style: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """task_id, report and the columns to keep. results: rows of the schema schemas.ANALYSIS_RESULT, and those columns."""
    if style not in FORMATS:
        raise ValueError(f"unknown report format {style!r}")
    r = {
        "downward": F.col("downward_chain"),
        "upward": F.coalesce("upward_chains", F.array().cast(results.schema["upward_chains"].dataType)),
        "entries": F.coalesce("entry_points", F.array().cast(results.schema["entry_points"].dataType)),
        "scenarios": F.coalesce("test_scenarios", F.array().cast(results.schema["test_scenarios"].dataType)),
        "impact": F.col("impact_summary"),
        "self_check": F.col("self_check_report"),
    }
    text = F.to_json(F.struct(*[c for c in results.columns if c not in keep])) if style == "json" else terminal(r) if style == "terminal" else markdown(r)
    return results.select("task_id", text.alias("report"), *keep)
