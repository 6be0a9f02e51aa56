"""JSON lines as records, split and projected by the executors.

Paths are dotted: ``profile.name``, ``items.0.id``, with ``\\.`` for a point within a key. Such
paths stay in the JVM; those with wildcards, queries or modifiers (``functions/jsonquery.py``)
are looked up by an Arrow function. Blank lines are skipped, invalid ones give nothing; a line
beyond MAX_LINE bytes is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.jsonquery import needs_query, query_column
from siltwork.sources.records import ReadOptions, project

MAX_LINE = 10 * 1024 * 1024


def json_path(path: str) -> str:
    """A dotted path as a JSON path."""
    out = "$"
    for part in re.split(r"(?<!\\)\.", path.strip()):
        key = part.replace("\\.", ".")
        if key.isdigit():
            out += f"[{key}]"
        else:
            out += "['" + key.replace("'", "\\'") + "']"
    return out


def value_at(json: Column, path: str) -> Column:
    """The text of a path's value: null for JSON null, raw JSON for objects and arrays."""
    if needs_query(path):
        return query_column(json, path)
    plain, steps = json_path(path), [p for p in re.split(r"(?<!\\)\.", path.strip()) if p.isdigit()]
    found = F.get_json_object(json, plain)
    # digits may be a key of an object too
    return F.coalesce(found, F.get_json_object(json, re.sub(r"\[(\d+)\]", r"['\1']", plain))) if steps else found


def records(lines: DataFrame, root: str = "") -> DataFrame:
    """(json) of each record of (value) lines: at root if given; an array there gives one record an item."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    long = F.octet_length("value") > MAX_LINE
    checked = F.when(long, F.raise_error(F.lit(f"a line is longer than {MAX_LINE} bytes"))).otherwise(line)
    plain = lines.select(checked.alias("json")).where("json <> ''")
    if not root:
        return plain.where(F.get_json_object("json", "$").isNotNull())
    inner = plain.select(value_at(F.col("json"), root).alias("json")).where("json IS NOT NULL")
    items = F.when(F.ltrim("json").startswith("["), F.from_json("json", "array<string>")).otherwise(F.array("json"))
    return inner.select(F.explode(items).alias("json")).where("json IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """The file's records, texts and lists of texts by target field."""
    return jsonl_records(spark.read.text(path), options)


def jsonl_records(lines: DataFrame, options: ReadOptions | None = None) -> DataFrame:
    options = options or ReadOptions()
    return project(records(lines, options.root), options, lambda p: value_at(F.col("json"), p))
