"""Structured Streaming into a table: each micro-batch becomes pending files, exactly once.

Batch n of a source is imported in three steps:

1. Its rows are written as files of the stream's own folder, where nothing reads them.
2. A plan is written down: each of these files, and the pending file that it becomes. From
   here on the batch counts as given; its rows are never read again.
3. The files are moved into place, and the plan is marked as done.

A batch given again after a failure goes on where the last attempt stopped. Without a plan
nothing of it was pending, so it starts anew. With one, only files that are still in the
stream's folder are moved: those that were moved before may have been merged since, and
aren't pending a second time. Merging goes on apart, every ``merge_every`` batches or by hand.

Moving a file is one rename. On stores whose renames copy and then delete, a failure
between the two would leave both; such stores need a committer of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltwork.engine import Table
from siltwork.functions.partition import encode_source
from siltwork.sources.storage import NotFound


def _folder(table: Table, source: str, batch: int) -> str:
    return f"{table.engine.root}/.streams/{table.schema.name}/{encode_source(source)}/{batch}"


def import_batch(table: Table, source: str, df: DataFrame, batch: int) -> bool:
    """Imports one batch exactly once; whether anything was left to do."""
    fs, folder = table.engine.fs, _folder(table, source, batch)
    try:
        plan = fs.read_json(f"{folder}/plan.json")
    except NotFound:
        for o in fs.list(folder):  # of attempts that failed before their plan
            fs.delete(o.path)
        plan = {"done": False, "files": table.stage_import(f"{source}-{batch}", df, f"{folder}/{uuid.uuid4()}")}
        fs.write_json(f"{folder}/plan.json", plan)
    if plan["done"]:
        return False
    left = {o.path for o in fs.list(folder)}
    table.move_in({staged: to for staged, to in plan["files"].items() if staged in left})
    fs.write_json(f"{folder}/plan.json", {"done": True, "files": {}})
    for o in fs.list(folder):
        if not o.path.endswith("/plan.json"):
            fs.delete(o.path)
    return True


def stream_into(
    table: Table, stream: DataFrame, source: str, checkpoint: str, merge_every: int = 0, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the query. trigger: arguments of DataStreamWriter.trigger, by default all that is available, once."""

    def batch(df: DataFrame, n: int) -> None:
        import_batch(table, source, df, n)
        if merge_every and (n + 1) % merge_every == 0:
            table.merge()

    run: Callable = batch
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
