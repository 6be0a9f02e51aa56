import os
import posixpath
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltwork.operators import consolidate as C
from siltwork.operators import salted as S
from siltwork.queries import pipeline
from siltwork.session import cut
from siltwork.sources import manifest
from siltwork.sources.storage import LocalStorage


def plain(rows):
    out = {}
    for k, v in rows:
        n, m = out.get(k, (0, None))
        out[k] = (n + 1, v if m is None else m if v is None else max(m, v))
    return out


@pytest.mark.parametrize("share, salts", [(0.05, 8), (0.9, 2), (0.0001, 64)])
def test_salted_equals_plain(spark, share, salts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice([None, "", *map(str, range(30))]), rng.choice([None, *range(9)])) for _ in range(3000)]
    rows += [("same", 1)] * 500
    df = spark.createDataFrame(rows, "id string, v int").withColumn("__silt_n", F.lit(1)).withColumn("n", F.lit("clash"))
    parts = [S.count_rows("n"), S.largest("m", F.col("v")), S.total("s", F.col("v")), S.mean("a", F.col("v")), S.latest("l", F.col("v").cast("string"), F.col("v"))]
    out = {r["id"]: r for r in S.salted_aggregate(df, "id", parts, salts, share).collect()}
    want = plain(rows)
    assert {k: (r["n"], r["m"]) for k, r in out.items()} == want
    assert all(r["l"] == (None if r["m"] is None else str(r["m"])) for r in out.values())


def test_salted_empty_and_bound(spark):
    none = spark.createDataFrame([], "id string, v int")
    assert S.salted_aggregate(none, "id", [S.count_rows("n")]).collect() == []
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert len(S.heavy_hashes(df, [F.col("k")], 0.1)) == 10 and S.heavy_hashes(df, [F.col("k")], 0.11) == []
    skewed = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    heavy = S.heavy_hashes(skewed, [F.col("k")])  # among very many light keys
    assert {r[0] for r in spark.sql("SELECT xxhash64('hot') UNION SELECT xxhash64(CAST(NULL AS STRING))").collect()} <= set(heavy) and len(heavy) <= 201
    salted = S.with_salt(df.withColumn("row", F.monotonically_increasing_id()), "k", 16, 0.1)
    assert salted.groupBy("k", S.SALT).count().agg(F.max("count")).first()[0] < 30


def test_salted_join_equals_plain(spark):
    left = spark.createDataFrame([(k % 3 and "hot" or f"k{k % 7}", k) for k in range(200)] + [(None, 0)], "k string, a long")
    right = spark.createDataFrame([("hot", b) for b in range(5)] + [("k3", 9), ("k9", 1), (None, 2)], "k string, b long")
    heavy = S.heavy_hashes(left, [F.col("k")], 0.5)
    assert len(heavy) == 1
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for h in (heavy, []):
        assert sorted(map(tuple, S.salted_join(left, right, "k", F.col("a"), h, 8).collect())) == want
    assert S.salted_join(left.limit(0), right, "k", F.col("a"), heavy).count() == 0


def test_count_distinct(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), (None, "z")], "k string, v string")
    assert {r.k: r.n for r in S.salted_count_distinct(df, "k", "v", "n").collect()} == {"a": 2, "b": 0, None: 1}


MAIN, INC = "s/r1/main/t/p=a/b=0", "s/r1/inc/t/feed/p=a/b=0"


def tables(spark, stored, active, last="tx", inputs=(), commit_dir=MAIN):
    s = spark.createDataFrame([(p, n, r, None) for p, n, r in stored], "file_path string, size_bytes long, n_rows long, extra string")
    m = spark.createDataFrame([(MAIN, 1, active, last)], "part_dir string, version long, active_files array<string>, last_commit string")
    c = spark.createDataFrame([(commit_dir, "tx", list(inputs)), (MAIN, "older", [f"{INC}/b.parquet"])], "part_dir string, tx_id string, input_files array<string>")
    return s, m, c


def test_live_files(spark):
    stored = [
        (f"{MAIN}/files/a.parquet", 10, 1), (f"{MAIN}/files/b.parquet", 10, None), (f"{MAIN}/files/stale.parquet", 10, 1), (f"{MAIN}/files/.t.parquet.tmp", 1, 0),
        (f"{INC}/a.parquet", 5, 1), (f"{INC}/b.parquet", 5, 1), (f"{INC}/.h.parquet", 5, 1), (f"{INC}/x.parquet.tmp", 5, 1),
        ("s/r2/inc/t/feed/p=a/b=0/a.parquet", 5, 1), (None, 1, 1), ("elsewhere/x.parquet", 1, 1),
    ]
    active = ["files/a.parquet", "./files//b.parquet", "files/a.parquet", "files/gone.parquet", None, f"/bucket/{MAIN}/files/a.parquet"]
    live = C.live_files(*tables(spark, stored, active, inputs=[f"oss://x/{INC}/a.parquet", None, ""])).collect()
    assert sorted((r.part_dir, r.file_path, r.area) for r in live) == sorted([
        (MAIN, f"{MAIN}/files/a.parquet", "main"), (MAIN, f"{MAIN}/files/b.parquet", "main"), (MAIN, f"{INC}/b.parquet", "inc"),
        ("s/r2/main/t/p=a/b=0", "s/r2/inc/t/feed/p=a/b=0/a.parquet", "inc"),
    ])


def test_groups_follow_the_running_sum(spark):
    stored = [(f"{MAIN}/files/{i:03d}.parquet", (i * 37) % 100, 1) for i in range(60)] + [(f"{MAIN}/files/big.parquet", 10**7, 1)]
    s, m, c = tables(spark, stored, [p.removeprefix(MAIN + "/") for p, _, _ in stored])
    groups = []
    for block in (10_000, 7, 1):
        plan = C.plan_groups(C.live_files(s, m, c), target_bytes=200, small_bytes=1000, block_files=block).collect()
        assert len(plan) == 60 and len({r.file_path for r in plan}) == 60
        sums = {}
        for r in plan:
            sums[r.group_no] = sums.get(r.group_no, 0) + r.size_bytes
        assert all(v < 200 + 100 for v in sums.values()) and sum(sums.values()) == sum(n for _, n, _ in stored[:-1])
        groups.append({r.file_path: r.group_no for r in plan})
    assert groups[0] == groups[1] == groups[2]
    assert [groups[0][p] for p, _, _ in stored[:-1]] == sorted(groups[0].values())
    assert C.plan_groups(C.live_files(s.limit(0), m, c)).count() == 0


def test_rewrite_keeps_every_row_as_often_as_it_lies(spark, tmp_path):
    stored = [(f"{MAIN}/files/{i}.parquet", 50, 1) for i in range(20)]
    plan = C.plan_groups(C.live_files(*tables(spark, stored, [f"files/{i}.parquet" for i in range(20)])), target_bytes=200)
    rows = spark.createDataFrame(
        [(k, f"{MAIN}/files/{k % 20}.parquet", "clash") for k in range(500)] + [(7, f"{MAIN}/files/7.parquet", "clash")] * 3 + [(1, None, ""), (1, "dead", "")],
        "row_id long, file_path string, group string",
    )
    report = C.rewrite(rows, plan, str(tmp_path / "out"))
    assert C.reconciled(report) and report.agg(F.sum("rows_out"), F.sum("n_files")).first() == (503, 20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("row_id = 7").count() == 4 and len(back.inputFiles()) <= report.count()
    broken = report.withColumn("rows_out", F.lit(0))
    assert not C.reconciled(broken)


def test_rewrite_gives_each_group_a_file_of_its_own(spark, tmp_path):
    dirs = [MAIN, "s/r1/main/t/p=b%2F/b=0", "s/r1/main/t/p=ä b/b=1"]
    plan = spark.createDataFrame([(d, f"{d}/files/{i}", 10, 1, i // 2) for d in dirs for i in range(20)], "part_dir string, file_path string, size_bytes long, n_rows long, group_no long")
    rows = plan.select("file_path", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("row_id"))
    report = C.rewrite(rows, plan, str(tmp_path / "out"))
    assert report.count() == 30 > int(spark.conf.get("spark.sql.shuffle.partitions")) and C.reconciled(report)
    assert {(r.n_files, r.rows_in, r.rows_out) for r in report.collect()} == {(2, 10, 10)}
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.input_file_name())
    held = back.join(plan, "file_path").select("at", "part_dir", "group_no").distinct()
    assert held.count() == held.select("at").distinct().count() == held.select("part_dir", "group_no").distinct().count() == 30


def test_found_comes_from_the_grouping(spark):
    found = pipeline.p3_found(spark, "/root/testdata/sf0.001")
    assert "Window" in found._jdf.queryExecution().executedPlan().toString()


def store(spark, root):
    """A store of two partitions with many small files of rows, and its tables; (rows, stored, manifests, commits)."""
    st, rows, k = LocalStorage(), [], 0
    for part in ("p=a/b=0", "p=b%2F/b=1"):
        main, inc = f"r1/main/t/{part}", f"r1/inc/t/feed/{part}"
        active = [f"files/{i}.parquet" for i in range(5)]
        for p in [*(f"{main}/{a}" for a in active), f"{main}/files/stale.parquet", *(f"{inc}/{i}.parquet" for i in range(4))]:
            os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
            pq.write_table(pa.table({"row_id": [k, k + 1, k + 1], "id": ["x", "y", "y"]}), f"{root}/{p}")
            rows += [(k, p), (k + 1, p), (k + 1, p)]
            k += 2
        st.write_json(f"{root}/{main}/_manifest.json", {"version": 3, "active_files": active, "last_commit": ""})
    stored = [(posixpath.relpath(o.path, root), o.size, None) for o in st.list(root) if o.path.endswith(".parquet")]
    ms = [(posixpath.relpath(posixpath.dirname(o.path), root), st.read_json(o.path)) for o in st.list(root) if o.path.endswith("_manifest.json")]
    return (
        spark.createDataFrame(rows, "row_id long, file_path string"),
        spark.createDataFrame(stored, "file_path string, size_bytes long, n_rows long"),
        spark.createDataFrame([(d, 3, m["active_files"], m["last_commit"] or None) for d, m in ms], "part_dir string, version long, active_files array<string>, last_commit string"),
        spark.createDataFrame([], "part_dir string, tx_id string, input_files array<string>"),
    )


def test_publish(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    rows, stored, manifests, commits = store(spark, root)
    live = C.live_files(stored, manifests, commits)
    want = sorted(r.row_id for r in rows.join(live, "file_path").collect())
    plan = cut(C.plan_groups(live, target_bytes=3 * stored.agg(F.max("size_bytes")).first()[0]))
    report = cut(C.rewrite(rows, plan, out))
    with pytest.raises(ValueError, match="rows"):
        C.publish(LocalStorage(), root, plan, report.withColumn("rows_out", F.lit(0)), out)
    before = sorted(o.path for o in LocalStorage().list(root))
    assert C.publish(LocalStorage(), root, plan, report, out) == 2
    after = [o.path for o in LocalStorage().list(root) if o.path.endswith(".parquet")]
    assert len(after) == report.count() < len(before) and all("/files/merged_" in p for p in after)
    for part in ("r1/main/t/p=a/b=0", "r1/main/t/p=b%2F/b=1"):
        m = manifest.load(LocalStorage(), f"{root}/{part}")
        assert m.version == 4 and sorted(f"{root}/{part}/{a}" for a in m.active_files) == [p for p in after if p.startswith(f"{root}/{part}/")]
    back = spark.read.parquet(*after)
    assert sorted(r.row_id for r in back.collect()) == want
    held = back.select(F.input_file_name().alias("f"), F.regexp_extract("file_path", "p=[^/]+", 0).alias("p")).distinct()
    assert held.count() == len(after)  # no file holds two partitions


def test_compacted_raises_on_lost_rows(spark, monkeypatch):
    lossy = lambda *a, f=C.rewrite: f(*a).withColumn("rows_out", F.col("rows_out") - 1)
    monkeypatch.setattr(C, "rewrite", lossy)
    with pytest.raises(ValueError, match="rows"):
        pipeline.p3_compacted(spark, "/root/testdata/sf0.001")
