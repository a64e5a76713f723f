"""Pressure reports as a stream: the level after each batch (R-04, W-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.pressure import level
from keepwell.schemas import METRICS


def levels(stream: DataFrame) -> DataFrame:
    """(node_id, level) by each node's last report (node_id, ts_ms and the metrics)."""
    last = stream.groupBy("node_id").agg(F.max_by(F.struct(*METRICS), "ts_ms").alias("r"))
    return last.select("node_id", level(*[F.col(f"r.{m}") for m in METRICS]).alias("level"))
