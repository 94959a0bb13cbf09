"""Scores viewpoints as they arrive: each micro-batch meets the static elements and its features are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scenewright.operators.visibility import sector_features


def stream_features(viewpoints: DataFrame, elements: DataFrame, table_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that writes a stream of (node_id, x, y)'s sector features as Parquet, one folder for each batch, so
    a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sector_features(batch, elements, **options).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return viewpoints.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
