"""Settings from defaults, a file and the environment, in this order."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "TRACEWAKE_"


@dataclass(frozen=True)
class Config:
    workspace_dir: str = "."
    api_key: str = ""
    dsn: str = ""
    context_tokens: int = 128_000
    cache_hours: int = 72
    checkpoint_hours: int = 24
    shuffle_partitions: int = 0


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Later sources win; api_key and dsn are required."""
    known = {f.name: type(f.default) for f in fields(Config)}
    values: dict[str, object] = {}
    if path:
        values |= {k: v for k, v in json.loads(Path(path).read_text()).items() if k in known}
    for k, kind in known.items():
        raw = (env if env is not None else os.environ).get(PREFIX + k.upper())
        if raw is not None:
            values[k] = kind(raw)
    out = replace(Config(), **values)
    missing = [k for k in ("api_key", "dsn") if not getattr(out, k)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out
