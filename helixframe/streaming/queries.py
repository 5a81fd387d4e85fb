"""A stream of queries against a static reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import require


def for_each_match(matches: DataFrame, callback: Callable) -> int:
    """Hand every row to the callback on the driver, a partition at a time, in no certain order; exceptions pass through."""
    require(callable(callback), "empty callback")
    n = 0
    for row in matches.toLocalIterator():
        callback(row)
        n += 1
    return n


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``search`` on each micro-batch of a query stream and write its rows to ``path``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each match is kept once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
