"""Heartbeats as a stream: last seen, and retirement by processing-time timeout (R-02, R-03)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from keepwell.schemas import NODE_TIMEOUT_MS


def heartbeat_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str) -> DataFrame:
    """Files of ``folder`` whose names match ``pattern``, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def last_seen(stream: DataFrame) -> DataFrame:
    """Running maximum per node; late and disordered heartbeats change nothing wrongly."""
    return stream.groupBy("node_id").agg(F.max("ts_ms").alias("last_seen_ms"))


def retirements(stream: DataFrame, timeout_ms: int = NODE_TIMEOUT_MS) -> DataFrame:
    """(node_id, last_seen_ms, retired): a row per node and batch in which it was seen, and one when nothing came for longer than the timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "last_seen_ms": [seen], "retired": [True]})
            return
        seen = max([*(int(b["ts_ms"].max()) for b in batches), *(state.get if state.exists else ())])
        state.update((seen,))
        state.setTimeoutDuration(timeout_ms + 1)
        yield pd.DataFrame({"node_id": [key[0]], "last_seen_ms": [seen], "retired": [False]})

    return stream.groupBy("node_id").applyInPandasWithState(step, "node_id bigint, last_seen_ms bigint, retired boolean", "last_seen_ms bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run ``stream`` over what is there and return its result table.

    Without batches that have no data, for with a processing-time timeout those
    would go on for ever; timeouts fire in a stream that keeps running.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, before)
    return stream.sparkSession.table(name)
