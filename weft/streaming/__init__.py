"""Queries that arrive as a stream, against relations that stand still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def answer_stream(engine, mode: str, inputs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start answering a stream of input symbols (column x): each micro-batch is
    asked as one batch of queries, and its answers (x, y, w) go to the sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(engine.inference(mode, batch.select("x")), epoch)

    return inputs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
