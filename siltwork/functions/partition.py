"""Partition directories as Catalyst expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.schema import PartitionRule, TableSchema

ESCAPED = ["%", "/", "\\", *[chr(c) for c in range(0x20)], "\x7f"]


def encode(value: str) -> str:
    """A value as one path segment: percent signs, slashes and control characters as %XX."""
    return "".join(f"%{ord(ch):02X}" if ch in ESCAPED else ch for ch in value)


def encode_source(source: str) -> str:
    """A source's directory: never empty, '.' or '..'."""
    out = encode(source)
    return {"": "default", ".": "%2E", "..": "%2E%2E"}.get(out, out)


def encode_column(value: Column) -> Column:
    out = value
    for ch in ESCAPED:
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return F.when(value.rlike(r"[%/\\\x00-\x1f\x7f]"), out).otherwise(value)


def text_of(column: str, dtype: T.DataType) -> Column:
    """The value as text; absent is empty."""
    c = F.col(f"`{column}`")
    if isinstance(dtype, T.ArrayType):
        return F.when(F.size(c) > 0, F.concat(F.lit("["), F.concat_ws(" ", c), F.lit("]"))).otherwise(F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def bucket(value: str, n: int) -> str:
    """The bucket of a text: the first two bytes of its SHA-256, modulo n, in hexadecimal."""
    return f"{int.from_bytes(hashlib.sha256(value.encode()).digest()[:2], 'big') % n:02x}"


def bucket_column(value: Column, n: int) -> Column:
    head = F.conv(F.substring(F.sha2(value, 256), 1, 4), 16, 10).cast("int")
    return F.format_string("%02x", F.pmod(head, F.lit(n)))


def rule_value(rule: PartitionRule, text: Column) -> Column:
    if rule.kind == "hash":
        return bucket_column(text, rule.buckets)
    if rule.kind == "slice":
        return F.substring(text, rule.start + 1, rule.end - rule.start)
    return text


def part_dir(schema: TableSchema) -> Column:
    """k1=v1/k2=v2 in the order of fields and rules; empty for an unpartitioned table."""
    parts = [
        F.concat(F.lit(f"{r.key}="), encode_column(rule_value(r, text_of(r.column, schema[r.column].spark_type)))) for r in schema.rules
    ]
    return F.concat_ws("/", *parts) if parts else F.lit("")


def part_dir_of(schema: TableSchema, row: dict) -> str:
    """part_dir for one row in Python."""
    out = []
    for r in schema.rules:
        v = row.get(r.column)
        text = "" if v is None else f"[{' '.join(v)}]" if isinstance(v, list) else str(v)
        value = bucket(text, r.buckets) if r.kind == "hash" else text[r.start : r.end] if r.kind == "slice" else text
        out.append(f"{r.key}={encode(value)}")
    return "/".join(out)
