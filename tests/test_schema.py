from dataclasses import dataclass, field

import pytest

from siltwork.schema import SchemaError, merge, parse_field, parse_rule, schema_of, snake_case, table_schema


@dataclass
class Observation:
    phone: str = field(metadata=merge("pk"))
    source: str = field(metadata=merge("pk"))
    tags: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict, metadata=merge("json_merge"))
    first_seen: int = field(default=0, metadata=merge("min"))
    skipped: float = field(default=0.0, metadata=merge("-"))
    _hidden: object = None


@pytest.mark.parametrize(
    "name, want",
    [("ID", "id"), ("HTTPServer", "http_server"), ("CompanyName", "company_name"), ("UpdatedAt", "updated_at"), ("already_snake", "already_snake")],
)
def test_snake_case(name, want):
    assert snake_case(name) == want


def test_declared_record():
    s = schema_of(Observation)
    assert s.name == "observation" and s.pk == ("phone", "source")
    assert s.columns == ["phone", "source", "tags", "meta", "first_seen"]
    assert s["tags"].strategy == "list_union" and s["meta"].type == "string" and s["first_seen"].strategy == "min"
    assert s["tags"].spark_type.simpleString() == "array<string>"
    assert all(f.nullable for f in s.struct())


def test_table_name_override():
    @dataclass
    class Named:
        id: str = field(metadata=merge("pk"))

        @staticmethod
        def table_name():
            return "other"

    assert schema_of(Named).name == "other"


def test_partition_rules():
    s = table_schema("t", {"id": (str, "pk; bloom; partition:p=[0:2],b=hash(16)"), "area": (str, "partition:area")})
    assert [(r.key, r.column, r.kind) for r in s.rules] == [("p", "id", "slice"), ("b", "id", "hash"), ("area", "area", "direct")]
    assert s.bloom_columns == ["id"]


@pytest.mark.parametrize("rule", ["p=[4:2]", "p=[2:2]", "b=hash(0)", "b=hash(65537)", "p=[a:b]", "=x", "p=other", "p q"])
def test_bad_rules(rule):
    with pytest.raises(SchemaError):
        parse_rule(rule, "id")


def test_largest_rule():
    assert parse_rule("b=hash(65536)", "id").buckets == 65536


@pytest.mark.parametrize("tag", ["column:", "nonsense", "partition:", "expr"])
def test_bad_tags(tag):
    with pytest.raises(SchemaError):
        parse_field("ID", str, tag)


@pytest.mark.parametrize("py", [bool, float, dict, list[int], set])
def test_bad_types(py):
    with pytest.raises(SchemaError):
        parse_field("x", py)


def test_extended_types():
    assert parse_field("x", float, "max", extended_types=True).spark_type.simpleString() == "double"


def test_tag_details():
    f = parse_field("json_merge_count", int, "sum; column:json_merge_count")
    assert f.type == "int64" and f.strategy == "sum"
    assert parse_field("x", int, "max; min").strategy == "min"  # the last one wins
    assert parse_field("x", list[str], "expr:s.{}").strategy == "coalesce"  # explicit, so no list_union
    assert parse_field("CompanyName", str | None).column == "company_name"


def test_keys_and_columns():
    with pytest.raises(SchemaError):
        table_schema("t", {"a": str})
    with pytest.raises(SchemaError):
        table_schema("t", {"a": (str, "pk"), "b": (str, "column:A")})
