import itertools

import pytest

from siltwork.engine import Engine
from siltwork.schema import table_schema
from siltwork.streaming.imports import import_batch, stream_into

S = table_schema("t", {"id": (str, "pk; partition:b=hash(4)"), "total": (int, "sum")})


def test_stream(spark, root, tmp_path):
    t = Engine(spark, root).register(S)
    src = str(tmp_path / "src")
    for part in range(3):
        spark.createDataFrame([(f"k{i}", 1) for i in range(10)], "id string, total long").write.mode("append").parquet(src)
    stream = spark.readStream.schema("id string, total long").option("maxFilesPerTrigger", 2).parquet(src)
    q = stream_into(t, stream, "feed", str(tmp_path / "ck"), merge_every=2)
    q.awaitTermination(120)
    t.merge()
    assert {r.total for r in t.read().collect()} == {3} and t.read().count() == 10


def test_a_batch_given_twice_counts_once(spark, root):
    t = Engine(spark, root).register(S)
    df = spark.createDataFrame([("a", 1)], "id string, total long")
    assert import_batch(t, "feed", df, 0)
    assert not import_batch(t, "feed", df, 0)
    t.merge()
    assert not import_batch(t, "feed", df, 0)
    assert import_batch(t, "feed", df, 1)
    t.merge()
    assert t.read().first().total == 2


@pytest.mark.parametrize("at", range(5))
def test_replay_after_a_failure_and_a_merge_counts_once(spark, root, monkeypatch, at):
    """The attempt dies before its plan, before or between or after its moves, or before its mark; a merge runs; the batch is given again."""
    t = Engine(spark, root).register(S)
    df = spark.createDataFrame([(f"k{i}", 1) for i in range(12)], "id string, total long")
    calls = itertools.count()

    def upload(local, path, f=t.engine.fs.upload):
        if at == 1 or (at == 2 and next(calls) >= 2):
            raise OSError("lost")
        f(local, path)

    def write_json(path, value, f=t.engine.fs.write_json):
        if path.endswith("plan.json") and (at == 0 or (at == 3 and value["done"])):
            raise OSError("lost")
        f(path, value)
        if at == 4 and path.endswith("plan.json") and value["done"]:
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t.engine.fs, "upload", upload)
        m.setattr(t.engine.fs, "write_json", write_json)
        with pytest.raises(OSError, match="lost"):
            import_batch(t, "feed", df, 0)
    t.merge()
    import_batch(t, "feed", df, 0)
    t.merge()
    assert not import_batch(t, "feed", df, 0)
    assert {(r.id, r.total) for r in t.read().collect()} == {(f"k{i}", 1) for i in range(12)}
