"""Scoring of streams of pairs with a trained model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import predict_labels
from ..plans.training import Trained


def score_stream(pairs: DataFrame, model: Trained, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scores each micro-batch of a stream of pairs (id, source, target, y); the sink gets id, y, yhat and the batch's number."""

    def batch(df: DataFrame, number: int) -> None:
        sink(predict_labels(model.scores(df)), number)

    writer = pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
