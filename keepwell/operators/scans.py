"""Scans, lookups and counts (S-01..S-13, S-17, A-01..A-09, A-12, A-13, A-17, K-02..K-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.schemas import ATTEMPT_CLOSED, JOURNAL_CLOSED, RESERVATION_CLOSED


def by_id(df: DataFrame, id_value, column: str = "id") -> DataFrame:
    """A point lookup; no rows mean not found."""
    return df.filter(F.col(column) == id_value)


def all_replicas(replicas: DataFrame) -> DataFrame:
    return replicas.orderBy("replica_id")


def all_journal(journal: DataFrame) -> DataFrame:
    """Every journal, open or not, oldest first."""
    return journal.orderBy("created_at_ms", "attempt_id")


def replicas_for(replicas: DataFrame, object_id) -> DataFrame:
    """All replicas of an object, invalid ones too."""
    return replicas.filter(F.col("object_id") == object_id).orderBy("replica_id")


def valid_archives(archives: DataFrame, object_id=None) -> DataFrame:
    found = archives.filter("valid")
    return (found if object_id is None else found.filter(F.col("object_id") == object_id)).orderBy("created_at_ms", "archive_id")


def _open(df: DataFrame, column: str, closed: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """Rows that aren't closed; a state that is neither closed nor allowed is corruption and fails the scan."""
    state = F.col(column)
    found = df.filter(~state.isin(*closed))
    return found.withColumn(column, F.when(state.isin(*allowed), state).otherwise(F.raise_error(F.concat(F.lit(f"corrupt {column}: "), state))))


def open_attempts(attempts: DataFrame) -> DataFrame:
    return _open(attempts, "status", ATTEMPT_CLOSED, ("OPEN",))


def open_reservations(reservations: DataFrame) -> DataFrame:
    return _open(reservations, "status", RESERVATION_CLOSED, ("OPEN",))


def open_journal(journal: DataFrame) -> DataFrame:
    return _open(journal, "phase", JOURNAL_CLOSED, ("RESERVED", "VALIDATED", "PHYSICAL_STARTED", "PHYSICAL_DONE"))


def valid_replica_counts(replicas: DataFrame) -> DataFrame:
    return replicas.filter("valid").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


def archive_counts(archives: DataFrame) -> DataFrame:
    return archives.filter("valid").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def replica_total_bytes(replicas: DataFrame) -> DataFrame:
    return replicas.filter("valid").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("physical_bytes"))


def bytes_by_backend(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy("backend").agg(F.sum("size").alias("total_bytes"))


def has_open_reservation(objects: DataFrame, reservations: DataFrame) -> DataFrame:
    """Objects with an open reservation."""
    held = reservations.filter(~F.col("status").isin(*RESERVATION_CLOSED)).select(F.col("object_id").alias("id"))
    return objects.join(held, "id", "left_semi")


def references_to(objects: DataFrame, replicas: DataFrame, lineage: DataFrame, archives: DataFrame) -> DataFrame:
    """(id, dependents): replicas, archives and lineage edges, at either end, that forbid deletion (A-12)."""
    ends = [replicas.select(F.col("object_id").alias("id")), archives.select(F.col("object_id").alias("id")), lineage.select(F.col("parent_id").alias("id")), lineage.select(F.col("child_id").alias("id"))]
    counts = [e.groupBy("id").agg(F.count(F.lit(1)).alias("n")) for e in ends]
    total = counts[0].union(counts[1]).union(counts[2]).union(counts[3]).groupBy("id").agg(F.sum("n").alias("dependents"))
    return objects.select("id").join(total, "id", "left").select("id", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def stats(objects: DataFrame, replicas: DataFrame, archives: DataFrame, lineage: DataFrame, dedup: DataFrame, audit: DataFrame, reservations: DataFrame, journal: DataFrame) -> DataFrame:
    """One row of counters.  Each table is aggregated to one tagged row, and the rows are summed: one task gets eight rows."""
    one = F.lit(1)
    parts = {
        "objects": objects.agg(F.count(one).alias("v")),
        "replicas": replicas.agg(F.count(one).alias("v")),
        "valid_replicas": replicas.agg(F.count_if("valid").alias("v")),
        "physical_bytes": replica_total_bytes(replicas).toDF("v"),
        "archives": archives.agg(F.count_if("valid").alias("v")),
        "lineage_edges": lineage.agg(F.count(one).alias("v")),
        "dedup_entries": dedup.agg(F.count(one).alias("v")),
        "audit_entries": audit.agg(F.count(one).alias("v")),
        "open_reservations": reservations.agg(F.count_if(~F.col("status").isin(*RESERVATION_CLOSED)).alias("v")),
        "open_journal": journal.agg(F.count_if(~F.col("phase").isin(*JOURNAL_CLOSED)).alias("v")),
    }
    rows = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("k"), "v")
        rows = df if rows is None else rows.union(df)
    return rows.agg(*[F.sum(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in parts])


def newest_archive(archives: DataFrame) -> DataFrame:
    """Per object its last valid archive by (created_at_ms, archive_id)."""
    last = F.max_by(F.struct("archive_id", "created_at_ms"), F.struct("created_at_ms", "archive_id"))
    return archives.filter("valid").groupBy("object_id").agg(last.alias("a")).select("object_id", "a.archive_id", "a.created_at_ms")


def primary_replica(replicas: DataFrame, objects: DataFrame) -> DataFrame:
    """Per object its first valid replica that isn't archived and, unless the object is compressed, has the object's hash."""
    o = objects.select(F.col("id").alias("object_id"), F.col("content_hash").alias("own_hash"), "lifecycle_state")
    matches = (F.col("lifecycle_state") == "COMPRESSED") | F.col("own_hash").isNull() | (F.col("own_hash") == F.col("content_hash"))
    return replicas.filter("valid and kind <> 'ARCHIVED'").join(o, "object_id").filter(matches).groupBy("object_id").agg(F.min("replica_id").alias("replica_id"))


def restore_target(backends: DataFrame) -> DataFrame:
    """The backend that a restore writes to: memory before file, then by id; other kinds don't serve."""
    rank = F.when(F.col("kind") == "memory", 0).when(F.col("kind") == "file", 1)
    return backends.withColumn("rank", rank).filter("rank is not null").agg(F.min(F.struct("rank", "id")).alias("t")).select("t.id", "t.rank")


def distinct_targets(targets: Column) -> Column:
    return F.array_distinct(targets)


def distinct_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct().orderBy("action")
