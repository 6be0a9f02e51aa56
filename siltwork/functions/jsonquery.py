"""Paths into JSON that have wildcards, queries or modifiers.

Parts are separated by points; ``\\`` takes the meaning from the next sign. A part is

* a key, in which ``*`` stands for any signs and ``?`` for one: the first key that fits counts;
* a number, the place in an array;
* ``#``: at the end the length of an array, before other parts the array of what they give;
* ``#(key op value)``: the first item that the condition holds for, ``#(...)#`` all of them. op is
  ``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``%`` (fits a pattern) or ``!%``; without op the key has to be
  there, and without key the item itself is compared;
* ``@this``, ``@reverse``, ``@keys``, ``@values``, ``@flatten``, ``@join``, ``@tostr`` or ``@fromstr``.

What isn't there, and invalid JSON, gives nothing.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = object()
_CONDITION = re.compile(r"(.*?)\s*(==|!=|<=|>=|!%|<|>|%)\s*(.*)", re.S)


@lru_cache(1000)
def parts(path: str) -> tuple[str, ...]:
    """The parts of a path, with their escapes; points within queries and quotes don't count."""
    out, now, depth, quoted, i = [], "", 0, False, 0
    while i < len(path):
        ch = path[i]
        if ch == "\\" and i + 1 < len(path):
            now, i = now + path[i : i + 2], i + 2
            continue
        quoted ^= ch == '"' and depth > 0
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "." and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
        i += 1
    return (*out, now)


def needs_query(path: str) -> bool:
    """Whether a path holds more than keys and numbers."""
    return any(p.startswith(("#", "@")) or re.search(r"(?<!\\)[*?]", p) for p in parts(path.strip()))


@lru_cache(1000)
def _pattern(text: str) -> re.Pattern:
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += {"*": ".*", "?": "."}.get(text[i], re.escape(text[i]))
        i += 1
    return re.compile(out, re.S)


def _holds(item, condition: str) -> bool:
    found = _CONDITION.fullmatch(condition.strip())
    if not found:
        return get(item, condition.strip()) is not MISSING
    key, op, wanted = found.groups()
    value = get(item, key) if key else item
    if value is MISSING:
        return False
    try:
        want = json.loads(wanted)
    except ValueError:
        want = wanted
    if op in ("%", "!%"):
        fits = isinstance(value, str) and _pattern(str(want)).fullmatch(value) is not None
        return fits == (op == "%")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    same = type(value) is type(want) or (number(value) and number(want))
    if op == "==":
        return same and value == want
    if op == "!=":
        return not (same and value == want)
    if not same or isinstance(value, (dict, list, bool)) or value is None:
        return False
    return {"<": value < want, "<=": value <= want, ">": value > want, ">=": value >= want}[op]


def _flat(value: list) -> list:
    return [x for v in value for x in (v if isinstance(v, list) else [v])]


def _changed(value, name: str):
    if name == "this":
        return value
    if name == "reverse":
        return value[::-1] if isinstance(value, list) else dict(reversed(value.items())) if isinstance(value, dict) else value
    if name in ("keys", "values"):
        return list(getattr(value, name)()) if isinstance(value, dict) else list(range(len(value))) if name == "keys" and isinstance(value, list) else value
    if name == "flatten":
        return _flat(value) if isinstance(value, list) else value
    if name == "join":
        return {k: v for d in value if isinstance(d, dict) for k, v in d.items()} if isinstance(value, list) else value
    if name == "tostr":
        return dumps(value)
    if name == "fromstr":
        try:
            return json.loads(value) if isinstance(value, str) else MISSING
        except ValueError:
            return MISSING
    return MISSING


def get(value, path: str | tuple[str, ...]):
    """What a path leads to, MISSING if nothing."""
    steps = parts(path) if isinstance(path, str) else path
    for i, step in enumerate(steps):
        rest = steps[i + 1 :]
        if step.startswith("@"):
            value = _changed(value, step[1:])
        elif isinstance(value, list):
            if step == "#":
                if not rest:
                    return len(value)
                return [x for v in value if (x := get(v, rest)) is not MISSING]
            if step.startswith("#("):
                every = step.endswith(")#")
                held = (v for v in value if _holds(v, step[2 : -2 if every else -1]))
                if every:
                    all_ = list(held)
                    return get(all_, ("#", *rest)) if rest and rest[0] != "#" and not rest[0].startswith("@") else get(all_, rest) if rest else all_
                value = next(held, MISSING)
            else:
                value = value[int(step)] if step.isdigit() and int(step) < len(value) else MISSING
        elif isinstance(value, dict):
            if re.search(r"(?<!\\)[*?]", step):
                value = next((v for k, v in value.items() if _pattern(step).fullmatch(k)), MISSING)
            else:
                value = value.get(re.sub(r"\\(.)", r"\1", step), MISSING)
        else:
            value = MISSING
        if value is MISSING:
            return MISSING
    return value


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def text_at(document: str | None, path: str) -> str | None:
    """The text of a path's value: nothing for null, raw JSON for objects and arrays."""
    try:
        value = get(json.loads(document), path.strip()) if document is not None else None
    except ValueError:
        return None
    if value is MISSING or value is None:
        return None
    return value if isinstance(value, str) else dumps(value)


def query_column(document: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return pd.Series([text_at(d, path) for d in documents], dtype=object)

    return run(document)
