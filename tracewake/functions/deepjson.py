"""A JSON reader for documents of any depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def loads(text: str) -> object:
    """As json.loads; what is nested too deeply for it is read with a stack of open containers."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read(text)


def _read(s: str) -> object:
    root: list[object] = []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]  # container and the key that waits for its value
    at = 0

    def space(i: int) -> int:
        return _SPACE.match(s, i).end()

    def put(value: object) -> None:
        holder, key = stack[-1]
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value

    def key_of(i: int) -> int:
        """Reads a key and its colon into the open object."""
        if s[i : i + 1] != '"':
            raise ValueError(f"key expected at {i}")
        key, i = scanstring(s, i + 1, True)
        i = space(i)
        if s[i : i + 1] != ":":
            raise ValueError(f"colon expected at {i}")
        stack[-1] = (stack[-1][0], key)
        return space(i + 1)

    at = space(0)
    while True:
        # a value
        c = s[at : at + 1]
        if c in ("[", "{") and c:
            new: list | dict = [] if c == "[" else {}
            put(new)
            stack.append((new, None))
            at = space(at + 1)
            if s[at : at + 1] != ("]" if c == "[" else "}"):
                at = key_of(at) if c == "{" else at
                continue
        elif c == '"':
            value, at = scanstring(s, at + 1, True)
            put(value)
        elif m := _SCALAR.match(s, at):
            put(json.loads(m.group()))
            at = m.end()
        else:
            raise ValueError(f"value expected at {at}")
        # what closes behind it, up to the next value
        while True:
            at = space(at)
            holder = stack[-1][0]
            if holder is root:
                if at != len(s):
                    raise ValueError(f"text behind the value at {at}")
                return root[0]
            c = s[at : at + 1]
            if c == ("]" if isinstance(holder, list) else "}"):
                stack.pop()
                at += 1
            elif c == ",":
                at = space(at + 1)
                at = key_of(at) if isinstance(holder, dict) else at
                break
            else:
                raise ValueError(f"comma expected at {at}")
