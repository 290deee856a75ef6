"""Micro-batches into the idempotent store: an addition for continuous feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..series import LOAD, Series
from ..sources.store import save


def save_stream(rows: DataFrame, path: str, checkpoint: str, series: Series = LOAD, once: bool = True) -> StreamingQuery:
    """Write each micro-batch with :func:`save`; a replayed batch is skipped row by row, a conflict stops the stream."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: save(batch, path, series)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
