"""Incremental forms: one stream into two tables, a running best per key, saturation flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dual_sink(stream: DataFrame, first: tuple[Callable[[DataFrame], DataFrame], str], second: tuple[Callable[[DataFrame], DataFrame], str], checkpoint: str) -> StreamingQuery:
    """Write two derived tables from each micro-batch; a batch that is replayed replaces its own files."""

    def both(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for derive, path in (first, second):
            derive(batch).withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best(stream: DataFrame, key: str, position: str, metric: str) -> DataFrame:
    """``key, position, metric`` each time a key's best improves; among equals the first position stays.

    Within a micro-batch rows count by position; a later batch replaces the best only by a larger metric.
    """
    kind = dict(stream.dtypes)
    schema = f"{key} {kind[key]}, {position} {kind[position]}, {metric} double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(position, kind="stable")
        improved = False
        for p, m in zip(rows[position], rows[metric]):
            if m == m and (best is None or m > best[1]):
                best, improved = (p, float(m)), True
        if improved:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], position: [best[0]], metric: [best[1]]})

    return stream.groupBy(key).applyInPandasWithState(step, schema, f"p {kind[position]}, m double", "append", GroupStateTimeout.NoTimeout)


def saturated(detections: DataFrame, most: int = 300) -> DataFrame:
    """``image, n, saturated``: images at the detector's limit."""
    return detections.groupBy("image").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= most).alias("saturated"))
