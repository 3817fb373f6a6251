"""Named table-valued operators with a check for duplicate names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    inputs: dict[str, str]
    run: Callable[..., DataFrame]


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"tool {tool.name!r} is registered already")
        self.tools[tool.name] = tool

    def definitions(self) -> list[dict[str, object]]:
        return [{"name": t.name, "description": t.description, "inputs": t.inputs} for t in self.tools.values()]

    def execute(self, name: str, *args: object, **kwargs: object) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"unknown tool {name!r}")
        return self.tools[name].run(*args, **kwargs)


def standard() -> Registry:
    """The six operators a caller looks up by name."""
    from tracewake.operators import diffs, graph, search, symbols

    r = Registry()
    r.register(Tool("search", "lines that match a pattern", {"pattern": "regex", "glob": "optional path pattern"}, search.matching_lines))
    r.register(Tool("glob", "paths that match a pattern", {"pattern": "path pattern"}, search.glob_paths))
    r.register(Tool("read", "numbered lines of files", {"offset": "first line", "limit": "number of lines"}, search.slices))
    r.register(Tool("calls", "calls into or out of nodes, with their places", {"nodes": "table of nodes", "incoming": "or outgoing"}, graph.call_hierarchy))
    r.register(Tool("changed_functions", "declarations on added lines of diffs", {"diff": "text column"}, diffs.changed_functions))
    r.register(Tool("symbols", "declared symbols of source text", {"code": "text column", "language": "optional"}, symbols.symbols))
    return r
