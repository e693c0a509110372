"""Claims as a stream: the batch decision applied to micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.serving import history_rows
from ..plans.decisions import decide_claims
from ..sources.tables import write_history


def stream_score_claims(
    claims: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    history_path: str,
    checkpoint: str,
    username: str = "stream",
    available_now: bool = True,
) -> StreamingQuery:
    """Score a streaming table of claims and add each micro-batch to the history.

    A micro-batch owns the partition of its stream and its number and overwrites it, so a batch that is replayed after
    a failure leaves one copy. A stream is known by the id that its checkpoint keeps; another stream, or one with a new
    checkpoint, adds to the history. The decision keeps no state between batches.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        write_history(history_rows(decide_claims(batch, scorer), username), history_path, f"stream-{stream}", batch_id)

    writer = claims.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
