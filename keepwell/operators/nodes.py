"""Nodes: registration, heartbeats and retirement, in batch (R-01..R-03, J-15, K-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.schemas import NODE_TIMEOUT_MS


def last_seen(heartbeats: DataFrame) -> DataFrame:
    """(node_id, last_seen_ms): the greatest time, in whatever order heartbeats come."""
    return heartbeats.groupBy("node_id").agg(F.max("ts_ms").alias("last_seen_ms"))


def stale(heartbeats: DataFrame, now_ms: int, timeout_ms: int = NODE_TIMEOUT_MS) -> DataFrame:
    """Nodes last seen more than the timeout ago."""
    return last_seen(heartbeats).filter(F.lit(now_ms) - F.col("last_seen_ms") > timeout_ms)


def latest(registrations: DataFrame) -> DataFrame:
    """The last registration of each node, by (ts_ms, all columns)."""
    rest = [c for c in registrations.columns if c not in ("node_id", "ts_ms")]
    return registrations.groupBy("node_id").agg(F.max(F.struct("ts_ms", *rest)).alias("r")).select("node_id", "r.*")


def name_conflicts(nodes: DataFrame) -> DataFrame:
    """Names that several live nodes have."""
    return nodes.groupBy("name").agg(F.count_distinct("node_id").alias("n")).filter("n > 1")


def backend_owners(nodes: DataFrame) -> DataFrame:
    """(backend, node_id, ambiguous) for nodes (node_id, name, backends); backends are named 'node name/backend'."""
    each = nodes.select("node_id", F.explode(F.transform("backends", lambda b: F.concat("name", F.lit("/"), b))).alias("backend"))
    return each.groupBy("backend").agg(F.min("node_id").alias("node_id"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def takeover(claims: DataFrame, now_ms: int, stale_ms: int) -> DataFrame:
    """``claims`` (epoch, last_seen_ms) with free, whether another process may claim, and the epoch it would get (R-06)."""
    free = (F.col("last_seen_ms") == 0) | (F.lit(now_ms) - F.col("last_seen_ms") > stale_ms)
    return claims.withColumns({"free": free, "next_epoch": F.when(free, F.col("epoch") + 1).otherwise(F.col("epoch"))})
