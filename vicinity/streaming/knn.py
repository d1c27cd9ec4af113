"""Streaming queries against static points: stateless, one map over each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vicinity.engine import KnnEngine


def stream_nearest_k(engine: KnnEngine, queries: DataFrame, k: int, write, id_col: str = "qid", coords=None):
    """A stream writer that joins each micro-batch of queries with the points and gives the result to write(result, batch id).

    Every query is independent, so there is no state and no watermark; write should be idempotent by batch id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(engine.query_nearest_k(batch, k, id_col, coords), batch_id)

    return queries.writeStream.foreachBatch(each)
