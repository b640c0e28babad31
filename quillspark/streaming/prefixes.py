"""Suggestions for a stream of prefixes against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.suggest import suggest_batch
from ..schema import DEFAULT_LIMIT


def suggest_stream(covering: DataFrame, prefixes: DataFrame, sink: Callable[[DataFrame, int], None], query_col: str = "prefix", limit: int = DEFAULT_LIMIT, max_edits: int = 0, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Runs :func:`suggest_batch` on each micro-batch of ``prefixes`` and hands the result with the
    batch's number to ``sink``. The index does not change; a batch that is repeated after a
    failure has the same number and result, so a sink that replaces by number is exact."""

    def each(batch: DataFrame, number: int) -> None:
        sink(suggest_batch(covering, batch, query_col, limit, max_edits), number)

    writer = prefixes.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
