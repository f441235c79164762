"""Incremental ingest: a stream of cells or points staged exactly once, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracegrid.sources.session import Session


def stage(stream: DataFrame, session: Session, split: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query. ``split`` makes the session's tables of a micro-batch.

    A micro-batch is named by its number, so one that is replayed after a failure is found committed and skipped.
    A sample's rows may come in several micro-batches, in any order: none are skipped for it, and building from the
    stage finds repeats.
    """

    def add(batch: DataFrame, number: int) -> None:
        session.write(f"stream-{number:012d}", skip_completed=False, **split(batch))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
