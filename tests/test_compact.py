import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltwork.functions import jsonpatch
from siltwork.plans import compact
from siltwork.schema import table_schema

ROW = table_schema(
    "merge_row",
    {
        "id": (str, "pk"), "name": str, "tags": list[str], "meta": (dict, "json_merge"), "score": (int, "overwrite"),
        "max_score": (int, "max"), "min_time": (int, "min"), "total": (int, "sum"),
    },
)


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame([tuple(r.get(c) for c in schema.columns) for r in rows], schema.struct())


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_golden_strategies(spark):
    one = [
        dict(id="a", name="Alice", tags=["go", "rust"], meta='{"x":"1"}', score=10, max_score=10, min_time=100, total=2),
        dict(id="b", name="Bob", tags=["python"], meta='{"a":"old"}', score=20, max_score=20, min_time=200, total=5),
    ]
    two = [
        dict(id="a", tags=["rust", "java"], meta='{"y":"2"}', score=15, max_score=8, min_time=50, total=3),
        dict(id="b", name="Bobby", tags=["js"], meta='{"a":"new","b":"added"}', score=25, max_score=30, min_time=250, total=7),
    ]
    first = compact.plan(ROW, frame(spark, one))
    got = by_id(compact.plan(ROW, frame(spark, two), first))
    a, b = got["a"], got["b"]
    assert (a["name"], a["tags"], a["score"], a["max_score"], a["min_time"], a["total"]) == ("Alice", ["go", "java", "rust"], 15, 10, 50, 5)
    assert json.loads(a["meta"]) == {"x": "1", "y": "2"}
    assert (b["name"], b["score"], b["max_score"], b["min_time"], b["total"]) == ("Bobby", 25, 30, 200, 12)
    assert json.loads(b["meta"]) == {"a": "new", "b": "added"}


def test_conflicts_within_a_batch_go_by_text(spark):
    for rows in (['{"k":"a"}', '{"k":"b"}'], ['{"k":"b"}', '{"k":"a"}']):
        out = by_id(compact.plan(ROW, frame(spark, [dict(id="x", meta=m) for m in rows])))
        assert out["x"]["meta"] == '{"k":"b"}'


def test_first_publish_and_join_treat_nothing_apart(spark):
    alone = by_id(compact.plan(ROW, frame(spark, [dict(id="x", name="n")])))["x"]
    assert alone["total"] is None and alone["tags"] == [] and alone["meta"] is None
    joined = by_id(compact.plan(ROW, frame(spark, [dict(id="x", name="n")]), frame(spark, [dict(id="y", score=3)])))
    assert joined["x"]["total"] == 0 and joined["y"]["total"] == 0 and joined["y"]["tags"] == [] and joined["y"]["score"] == 3


def test_null_keys_empty_sides_and_foreign_columns(spark):
    incoming = frame(spark, [dict(id=None, name="lost"), dict(id="a", name="x"), dict(id="a", name="x")]).withColumn("__silt_key", F.lit(1)).withColumn("s", F.lit("clash"))
    existing = frame(spark, [dict(id=None, name="kept"), dict(id="b")]).withColumn("t", F.lit(2))
    got = compact.plan(ROW, incoming, existing).collect()
    assert sorted((r.id or "", r.name or "") for r in got) == [("", "kept"), ("a", "x"), ("b", "")]
    assert compact.plan(ROW, frame(spark, []), frame(spark, [])).count() == 0
    assert compact.plan(ROW, frame(spark, [])).columns == ROW.columns


def test_reserved_words(spark):
    s = table_schema("r", {"id": (str, "pk"), "order": (int, "max"), "from": str, "to": (str, "overwrite"), "group": list[str]})
    first = frame(spark, [dict(id="1", order=5, **{"from": "a"}, to="b", group=["g1"])], s)
    out = compact.plan(s, frame(spark, [dict(id="1", order=9, group=["g2"])], s), first)
    assert tuple(compact.plan(s, frame(spark, [dict(id="1", to="c")], s), out).first()) == ("1", 9, "a", "c", ["g1", "g2"])


def test_custom_sql(spark):
    s = table_schema("c", {"id": (str, "pk"), "v": (int, "agg:count({}); expr:coalesce(s.{}, 0) - coalesce(t.{}, 0)")})
    out = compact.plan(s, frame(spark, [dict(id="a", v=7), dict(id="a", v=8)], s), frame(spark, [dict(id="a", v=10)], s))
    assert out.first().v == -8


def model(batches):
    out = {}
    for batch in batches:
        for r in batch:
            o = out.setdefault(r["id"], {"max_score": None, "min_time": None, "total": 0, "tags": set()})
            for c, f in (("max_score", max), ("min_time", min)):
                if r.get(c) is not None:
                    o[c] = r[c] if o[c] is None else f(o[c], r[c])
            o["total"] += r.get("total") or 0
            o["tags"] |= set(r.get("tags") or [])
    return out


rows = st.fixed_dictionaries(
    {"id": st.sampled_from("abc")},
    optional={"max_score": st.integers(-9, 9), "min_time": st.integers(-9, 9), "total": st.integers(-9, 9), "tags": st.lists(st.sampled_from("xyz"), max_size=3)},
)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(rows, max_size=5), min_size=2, max_size=3), st.booleans())
def test_batching_makes_no_difference(spark, batches, skew):
    out = None
    for b in batches:
        out = compact.plan(ROW, frame(spark, b), out, skew=skew)
    got = by_id(out)
    want = model(batches)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g["max_score"], g["min_time"], g["total"] or 0, set(g["tags"])) == (w["max_score"], w["min_time"], w["total"], w["tags"])


def test_ranged_patches_equal_sorted_ones(spark):
    rng = random.Random(3)
    made = []
    for _ in range(600):
        p = {rng.choice("abcd"): rng.choice([None, 1, "x", {"q": rng.choice([None, 2])}]) for _ in range(rng.randint(0, 3))}
        made.append(dict(id=rng.choice(["hot", "hot", "hot", "cold"]), meta=json.dumps(p)))
    df = frame(spark, made)
    got = by_id(compact.preaggregate(ROW, df, skew=True).select("id", jsonpatch.reduce_column("meta").alias("meta")))
    want = by_id(compact.preaggregate(ROW, df, skew=False).select("id", jsonpatch.reduce_column("meta").alias("meta")))
    assert {k: json.loads(v["meta"]) for k, v in got.items()} == {k: json.loads(v["meta"]) for k, v in want.items()}
    target = '{"a":{"q":5},"b":7,"z":1}'
    for k in got:
        patches = compact.preaggregate(ROW, df.where(F.col("id") == k), skew=True).first().meta
        plain = sorted(r["meta"] for r in made if r["id"] == k)
        assert json.loads(jsonpatch.apply(target, jsonpatch.reduce_patches(list(patches)))) == json.loads(jsonpatch.apply(target, jsonpatch.reduce_patches(plain)))


def test_one_exchange_a_side(spark):
    old = frame(spark, [dict(id=str(i), total=i) for i in range(50)])
    new = frame(spark, [dict(id=str(i), total=i, meta="{}") for i in range(50)])
    plan = compact.plan(ROW, new, old, skew=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_bad_json_fails(spark):
    with pytest.raises(Exception, match="(?i)json|expecting|delimiter"):
        compact.plan(ROW, frame(spark, [dict(id="a", meta="{bad"), dict(id="a", meta="{}")])).collect()
