import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltwork.functions import partition as P
from siltwork.schema import table_schema

S = table_schema("t", {"id": (str, "pk; partition:p=[0:2],b=hash(16)"), "area": (str, "partition:area"), "n": (int, "partition:n")})


@pytest.mark.parametrize(
    "value, want",
    [("a/b", "a%2Fb"), ("a\\b", "a%5Cb"), ("100%", "100%25"), ("../../etc", "..%2F..%2Fetc"), ("a\nb", "a%0Ab"), ("华东", "华东"), ("", ""), ("a=b c", "a=b c")],
)
def test_encode(value, want):
    assert P.encode(value) == want


@pytest.mark.parametrize("source, want", [("", "default"), (".", "%2E"), ("..", "%2E%2E"), ("2026/07/02", "2026%2F07%2F02"), ("plain", "plain")])
def test_encode_source(source, want):
    assert P.encode_source(source) == want


def test_columns_agree_with_python(spark):
    rows = [("ab123", "x", 5), ("a", None, None), ("", "100%/\\\x01", 0), ("华东人", "华东", -7), (None, "=", 1), ("😀b/c", "\x7f", 2**40)]
    df = spark.createDataFrame(rows, "id string, area string, n long")
    got = df.withColumn("d", P.part_dir(S)).collect()
    assert [r.d for r in got] == [P.part_dir_of(S, {"id": r.id or "", "area": r.area, "n": r.n}) for r in got]
    assert got[0].d.startswith("p=ab/b=")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cc"], exclude_characters="\x00")), min_size=1, max_size=20), st.sampled_from([1, 16, 256, 1000, 65536]))
def test_buckets(spark, texts, n):
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", P.bucket_column(F.col("v"), n).alias("b"))
    assert [r.b for r in df.collect()] == [P.bucket(t, n) for t in texts]


def test_unpartitioned(spark):
    s = table_schema("t", {"id": (str, "pk")})
    assert spark.range(1).select(P.part_dir(s).alias("d")).first().d == "" and P.part_dir_of(s, {"id": "x"}) == ""
