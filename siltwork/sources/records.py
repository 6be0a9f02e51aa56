"""Readers' field expressions, compiled to columns, and accessors for untyped records.

An expression names a source column, or joins several: ``a & b`` gives the list of all
values that aren't empty, ``a | b`` the first one; & binds closer, so an expression with
both is split at & only. Values are trimmed; empty ones and null-like tokens are absent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.coerce import to_int64, to_str, to_str_list


@dataclass(frozen=True)
class ReadOptions:
    """fields: target to expression. null: tokens that count as absent. split: target to separator.

    transform: target to a function of a column, applied after split. root (JSONL): the path of
    the records within a line. header (spreadsheets): the 1-based row of the headings; sheet: its name.
    """

    fields: dict[str, str] = field(default_factory=dict)
    null: tuple[str, ...] = ()
    split: dict[str, str] = field(default_factory=dict)
    transform: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    root: str = ""
    header: int = 0
    sheet: str = ""


def _value(c: Column, null: tuple[str, ...]) -> Column:
    text = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    absent = text == ""
    return F.when(~(absent | text.isin(*null) if null else absent), text)


def compile_field(expression: str, source: Callable[[str], Column], null: tuple[str, ...] = ()) -> Column:
    """The column of an expression; source gives the text column of a name."""
    parts = lambda sep: [p.strip() for p in expression.split(sep) if p.strip()]
    if "&" in expression:
        found = F.array_compact(F.array(*[_value(source(p), null) for p in parts("&")]))
        return F.when(F.size(found) > 0, found)
    if "|" in expression:
        return F.coalesce(*[_value(source(p), null) for p in parts("|")])
    return _value(source(expression.strip()), null)


def split_column(c: Column, is_list: bool, sep: str, null: tuple[str, ...] = ()) -> Column:
    """The parts of a text, or of each text of a list, without empty and null-like ones; null if none is left."""
    texts = c if is_list else F.array(c)
    parts = F.flatten(F.transform(texts, lambda t: F.split(t, re.escape(sep)))) if sep else texts
    kept = F.filter(F.transform(parts, lambda p: _value(p, null)), lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def project(df: DataFrame, options: ReadOptions, source: Callable[[str], Column]) -> DataFrame:
    """Records of the target fields. A record without any field is dropped."""
    names = list(options.fields)
    cols, lists = [], {}
    for name in names:
        expr = options.fields[name]
        cols.append(compile_field(expr, source, options.null).alias(name))
        lists[name] = "&" in expr
    out = df.select(*cols)
    for name, sep in options.split.items():
        if name in lists:
            out = out.withColumn(name, split_column(F.col(f"`{name}`"), lists[name], sep, options.null))
    for name, change in options.transform.items():
        if name in lists:
            out = out.withColumn(name, change(F.col(f"`{name}`")))
    any_field = None
    for name in names:
        has = F.col(f"`{name}`").isNotNull()
        any_field = has if any_field is None else any_field | has
    return out.where(any_field) if any_field is not None else out


class Record(dict):
    """An untyped record with coercing accessors."""

    def text(self, name: str) -> str:
        v = self.get(name)
        return (to_str(v[0]) if v else "") if isinstance(v, (list, tuple)) else to_str(v)

    def texts(self, name: str) -> list[str]:
        v = self.get(name)
        if v is None:
            return []
        return to_str_list(v) if isinstance(v, (list, tuple, str)) else [to_str(v)]

    def int64(self, name: str) -> int:
        return to_int64(self.get(name))

    def match(self, name: str, pattern: str) -> bool:
        """Whether the pattern is found in the text; a bad pattern, like an empty text, matches nothing."""
        v = self.text(name)
        try:
            return bool(v) and re.search(pattern, v) is not None
        except re.error:
            return False


def match_column(c: Column, pattern: str) -> Column:
    """Record.match for a column."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce((c != "") & c.rlike(pattern), F.lit(False))
