"""Declaring tables: record types whose fields carry a merge strategy.

    @dataclass
    class Company:
        id: str = field(metadata=merge("pk; bloom; partition:b=hash(256)"))
        name: str
        phones: list[str]
        source: dict = field(metadata=merge("json_merge"))
        first_seen: int = field(metadata=merge("min"))

Three physical types: str, int (64 bits) and list[str]; JSON is text with merge semantics.
``extended_types=True`` also takes float, bool and datetime, for every strategy but the
list and JSON ones.
"""

from __future__ import annotations

import dataclasses
import datetime
import re
import typing
from dataclasses import dataclass, field

import regex
from pyspark.sql import types as T

STRATEGIES = ("coalesce", "overwrite", "list_union", "json_merge", "max", "min", "sum")
EXTENDED = {float: T.DoubleType(), bool: T.BooleanType(), datetime.datetime: T.TimestampType()}
MAX_BUCKETS = 65_536


class SchemaError(ValueError):
    """A declaration that can't be used."""


def merge(tag: str) -> dict[str, str]:
    """Field metadata with the tag."""
    return {"merge": tag}


@dataclass(frozen=True)
class PartitionRule:
    """One level of a table's directories: the value itself, a slice of it, or a bucket of its hash."""

    key: str
    column: str
    start: int | None = None
    end: int | None = None
    buckets: int | None = None

    @property
    def kind(self) -> str:
        return "hash" if self.buckets else "slice" if self.end else "direct"


@dataclass(frozen=True)
class Field:
    attr: str
    column: str
    type: str  # string, int64, list, or a Spark type's name if extended
    strategy: str = "coalesce"
    pk: bool = False
    bloom: bool = False
    partitions: tuple[PartitionRule, ...] = ()
    merge_expr: str | None = None
    agg_expr: str | None = None
    spark: T.DataType | None = None

    @property
    def spark_type(self) -> T.DataType:
        return self.spark or {"string": T.StringType(), "int64": T.LongType(), "list": T.ArrayType(T.StringType())}[self.type]


@dataclass(frozen=True)
class TableSchema:
    name: str
    fields: tuple[Field, ...]
    pk: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]

    @property
    def rules(self) -> list[PartitionRule]:
        return [r for f in self.fields for r in f.partitions]

    @property
    def bloom_columns(self) -> list[str]:
        return [f.column for f in self.fields if f.bloom]

    def __getitem__(self, column: str) -> Field:
        return next(f for f in self.fields if f.column == column)

    def struct(self, only: typing.Collection[str] | None = None) -> T.StructType:
        """The Spark schema; every column may be null, the key too."""
        return T.StructType([T.StructField(f.column, f.spark_type, True) for f in self.fields if only is None or f.column in only])


def snake_case(name: str) -> str:
    """CompanyName to company_name, HTTPServer to http_server, ID to id."""
    return regex.sub(r"(?<=\p{Ll})\p{Lu}|(?<=.)\p{Lu}(?=\p{Ll})", r"_\g<0>", name).lower().replace("__", "_")


def _split_rules(text: str) -> list[str]:
    """Rules between commas, but for commas within brackets."""
    return [r.strip() for r in re.split(r",(?![^\[(]*[\])])", text) if r.strip()]


def parse_rule(text: str, column: str) -> PartitionRule:
    key, sep, value = text.partition("=")
    key, value = key.strip(), value.strip()
    if not sep:
        if not re.fullmatch(r"\w+", key):
            raise SchemaError(f"bad partition rule {text!r}")
        return PartitionRule(key, column)
    if not key:
        raise SchemaError(f"partition rule {text!r} has no key")
    if m := re.fullmatch(r"\[(\d+):(\d+)\]", value):
        start, end = int(m[1]), int(m[2])
        if end <= start:
            raise SchemaError(f"partition slice {value} is empty")
        return PartitionRule(key, column, start, end)
    if m := re.fullmatch(r"hash\((\d+)\)", value):
        if not 1 <= int(m[1]) <= MAX_BUCKETS:
            raise SchemaError(f"hash buckets must be between 1 and {MAX_BUCKETS}, not {m[1]}")
        return PartitionRule(key, column, buckets=int(m[1]))
    raise SchemaError(f"bad partition rule {text!r}")


def _physical(py: object, json: bool, extended: bool, attr: str) -> tuple[str, T.DataType | None]:
    if json or py is str:
        return "string", None
    if py is int:
        return "int64", None
    if typing.get_origin(py) is list or py is list:
        if typing.get_args(py) not in ((), (str,)):
            raise SchemaError(f"{attr}: only lists of strings are supported")
        return "list", None
    if extended and py in EXTENDED:
        return EXTENDED[py].simpleString(), EXTENDED[py]
    if py is dict or typing.get_origin(py) is dict or dataclasses.is_dataclass(py):
        raise SchemaError(f"{attr}: maps and records need json_merge")
    raise SchemaError(f"{attr}: unsupported type {py!r}")


def parse_field(attr: str, py: object, tag: str = "", extended_types: bool = False) -> Field | None:
    """The field that an attribute, its type and its tag declare; None if the tag is '-'."""
    if tag.strip() == "-":
        return None
    args = [a for a in typing.get_args(py) if a is not type(None)]
    if type(None) in typing.get_args(py) and len(args) == 1:
        py = args[0]
    segments = [s for s in (p.strip() for p in tag.split(";")) if s]
    kind, spark = _physical(py, "json_merge" in segments, extended_types, attr)
    made: dict = {"column": snake_case(attr)}
    rules, explicit = "", False
    for s in segments:
        name, _, value = s.partition(":")
        if s == "pk" or s == "bloom":
            made[s] = True
        elif s in STRATEGIES:
            made["strategy"], explicit = s, True
        elif name in ("expr", "agg") and value.strip():
            made["merge_expr" if name == "expr" else "agg_expr"], explicit = value, True
        elif name == "partition" and value:
            rules = value
        elif name == "column":
            if not value.strip():
                raise SchemaError(f"{attr}: empty column name")
            made["column"] = value.strip()
        else:
            raise SchemaError(f"{attr}: unknown tag {s!r}")
    if kind == "list" and not explicit:
        made["strategy"] = "list_union"
    parts = tuple(parse_rule(r, made["column"]) for r in _split_rules(rules))
    return Field(attr=attr, type=kind, spark=spark, partitions=parts, **made)


def build(name: str, fields: typing.Iterable[Field | None]) -> TableSchema:
    kept = tuple(f for f in fields if f)
    pk = tuple(f.column for f in kept if f.pk)
    if not pk:
        raise SchemaError(f"table {name} has no primary key")
    seen: set[str] = set()
    for f in kept:
        if f.column.lower() in seen:
            raise SchemaError(f"table {name} has two columns {f.column!r}")
        seen.add(f.column.lower())
    return TableSchema(name, kept, pk)


def schema_of(cls: type, extended_types: bool = False) -> TableSchema:
    """The schema of a dataclass. Attributes that begin with an underscore are left out; table_name() overrides the name."""
    if not dataclasses.is_dataclass(cls):
        raise SchemaError(f"{cls!r} is no dataclass")
    hints = typing.get_type_hints(cls)
    name = cls.table_name() if hasattr(cls, "table_name") else snake_case(cls.__name__)
    fields = [
        parse_field(f.name, hints[f.name], f.metadata.get("merge", ""), extended_types) for f in dataclasses.fields(cls) if not f.name.startswith("_")
    ]
    return build(name, fields)


def table_schema(name: str, columns: dict[str, object], extended_types: bool = False) -> TableSchema:
    """The schema from {column: type} or {column: (type, tag)}."""
    pairs = {c: d if isinstance(d, tuple) else (d, "") for c, d in columns.items()}
    return build(name, [parse_field(c, py, tag, extended_types) for c, (py, tag) in pairs.items()])
