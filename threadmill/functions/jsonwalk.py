"""JSON values of any depth without recursion: strict parsing, canonical scalars, walks."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(word: str) -> None:
    raise ValueError(word)


def parse_object(text: str | None) -> dict | None:
    """The JSON object that text is; None if it is null, blank, cut off, other JSON or no JSON. Of equal keys the last counts."""
    if text is None or not text.lstrip(" \t\n\r").startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        try:
            value = _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _parse_deep(text: str) -> object:
    """json.loads for nesting beyond the interpreter's stack."""
    skip = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []  # open containers and the key under which the next value goes
    i, root = skip(0), []
    holder, key = root, None

    def put(v: object) -> None:
        if isinstance(holder, dict):
            holder[key] = v
        else:
            holder.append(v)

    def read_key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return k, skip(i + 1)

    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            new: object = {} if c == "{" else []
            put(new)
            stack.append((holder, key))
            holder, i = new, skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, i = read_key(i)
                continue
        elif c == '"':
            s, i = scanstring(text, i + 1, True)
            put(s)
            i = skip(i)
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word:
                put(_WORDS[word])
                i = skip(i + len(word))
            else:
                m = _NUMBER.match(text, i)
                if not m or m.end() == i:
                    raise ValueError(i)
                put(float(m[0]) if m[1] or m[2] else int(m[0]))
                i = skip(m.end())
        while True:  # after a value
            if holder is root:
                if i != len(text):
                    raise ValueError(i)
                return root[0]
            c = text[i : i + 1]
            if c == ("}" if isinstance(holder, dict) else "]"):
                holder, key = stack.pop()
                i = skip(i + 1)
                continue
            if c != ",":
                raise ValueError(i)
            i = skip(i + 1)
            if isinstance(holder, dict):
                key, i = read_key(i)
            break


def type_name(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "object" if isinstance(v, dict) else "array"


def clean(s: str) -> str:
    """s as it can be stored: lone surrogates become U+FFFD."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def scalar(v: object) -> str:
    return json.dumps(v, ensure_ascii=False)
