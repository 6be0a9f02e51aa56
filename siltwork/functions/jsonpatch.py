"""JSON merge patch on text.

A patch that is an object changes an object key by key, null deletes, and nested objects
are changed in turn; any other patch replaces. Where the target isn't an object and the
patch is one, the patch is taken as it stands unless ``strict`` (the published rule)
says to drop its nulls.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def loads(text: str):
    def refuse(constant: str):
        raise ValueError(f"{constant} is no JSON")

    return json.loads(text, parse_constant=refuse)


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def strip_nulls(value):
    """An object without its null members, at every depth."""
    return {k: strip_nulls(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value


def patch(target, change, strict: bool = False):
    """target changed by change."""
    if not isinstance(change, dict):
        return change
    if not isinstance(target, dict):
        return strip_nulls(change) if strict else change
    out = dict(target)
    for k, v in change.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = patch(out[k], v, True) if isinstance(out.get(k), dict) else strip_nulls(v)
        else:
            out[k] = v
    return out


class Replace:
    """In a composed patch: the value stands for whatever was there, where a patch alone would merge into it."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __eq__(self, other) -> bool:
        return isinstance(other, Replace) and self.value == other.value

    __hash__ = None


def compose(first, second, top: bool = True):
    """What first and then second do to an object, as one change. Nulls stay, as they delete later."""
    if isinstance(first, Replace):
        inner = first.value
        if not isinstance(second, dict):
            return second if isinstance(second, Replace) else Replace(second)
        return Replace(patch(inner, second) if top else patch(inner, second, True))
    if not isinstance(second, dict):
        return second
    if not isinstance(first, dict):
        return Replace(second if top else strip_nulls(second))
    out = dict(first)
    for k, v in second.items():
        out[k] = compose(out[k], v, False) if k in out else v
    return out


def apply_composed(target: dict, change):
    """A composed change on an object."""
    if isinstance(change, Replace):
        return change.value
    if not isinstance(change, dict):
        return change
    out = dict(target)
    for k, v in change.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, (dict, Replace)):
            out[k] = apply_composed(out[k] if isinstance(out.get(k), dict) else {}, v)
        else:
            out[k] = v
    return out


_MARK = "\x00"


def dump_composed(change) -> str:
    """A composed change as text: a Replace is an object with the mark as its only key; keys that begin with it get another."""

    def plain(v):
        if isinstance(v, Replace):
            return {_MARK: escaped(v.value)}
        if isinstance(v, dict):
            return {_MARK + k if k.startswith(_MARK) else k: plain(x) for k, x in v.items()}
        return v

    def escaped(v):
        return {_MARK + k if k.startswith(_MARK) else k: escaped(x) for k, x in v.items()} if isinstance(v, dict) else v

    return dumps(plain(change))


def load_composed(text: str):
    def back(v):
        if not isinstance(v, dict):
            return v
        if list(v) == [_MARK]:
            return Replace(real(v[_MARK]))
        return {k.removeprefix(_MARK): back(x) for k, x in v.items()}

    def real(v):
        return {k.removeprefix(_MARK): real(x) for k, x in v.items()} if isinstance(v, dict) else v

    return back(loads(text))


def reduce_stretches(parts: list[tuple[str, str]]) -> str:
    """All patches brought to one, from stretches of them in order, each (applied, composed)."""
    if len(parts) == 1:
        return parts[0][0]
    value = loads(parts[0][0])
    for applied, composed in parts[1:]:
        # on a value that isn't an object, a stretch's first patch stands as it is and the rest follow
        value = apply_composed(value, load_composed(composed)) if isinstance(value, dict) else loads(applied)
    return dumps(value)


def reduce_patches(patches: list[str], strict: bool = False) -> str | None:
    """Patches applied one to the other in their order. A single one is returned as it stands."""
    if not patches:
        return None
    if len(patches) == 1:
        loads(patches[0])
        return patches[0]
    value = loads(patches[0])
    for p in patches[1:]:
        value = patch(value, loads(p), strict)
    return dumps(value)


def apply(target: str | None, change: str | None, strict: bool = False) -> str | None:
    """Incoming text change on existing text target; whichever isn't null if one is."""
    if target is None or change is None:
        return change if target is None else target
    return dumps(patch(loads(target), loads(change), strict))


def to_json(value) -> str:
    """A value as JSON text, keys sorted; text and bytes pass through."""
    if isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return value.decode()
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def reduce_column(patches: str | Column, strict: bool = False) -> Column:
    """reduce_patches over an array column, in the array's order."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None or len(x) == 0 else reduce_patches(list(x), strict))

    return run(patches)


def apply_column(target: str | Column, patches: str | Column, strict: bool = False) -> Column:
    """The patches brought to one among themselves, and then applied to the target.

    Doing so first is what batches mean: a key set and deleted within one batch leaves the
    target's key alone.
    """

    @F.pandas_udf("string")
    def run(targets: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series(
            [apply(t, None if p is None or len(p) == 0 else reduce_patches(list(p), strict), strict) for t, p in zip(targets, lists)], dtype=object
        )

    return run(target, patches)
