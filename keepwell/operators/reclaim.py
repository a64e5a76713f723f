"""Reclamation as a batch simulation, and row changes as transforms (T-01..T-11, T-15..T-18, W-01..W-11).

Every object is judged against the same snapshot: what one reclamation would
change for another shows in the next run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.economics import min_valid_copies, object_problems
from keepwell.operators import lifecycle, lineage, planning, scans
from keepwell.schemas import TABLES


def simulate(objects: DataFrame, replicas: DataFrame, archives: DataFrame, edges: DataFrame, policies: DataFrame, reservations: DataFrame, level: str = "NORMAL", now_ms: int = 0, force: bool = False) -> DataFrame:
    """(id, verdict, error, final_state) of reclaiming each object: preflight, verdict, survivability, transition, dependencies, in this order."""
    planned = planning.plan(objects, replicas, archives, edges, policies, level)
    checked = lifecycle.preflight(planned, reservations, now_ms).withColumnRenamed("error", "first_error")
    blocked = lineage.unsafe_ids(edges, objects).withColumn("_blocked", F.lit(True))
    left = lifecycle.remaining_copies(F.col("n_replicas"), F.col("n_replicas"), F.col("n_archives"))
    c = F.col
    error = (
        F.when(c("first_error").isNotNull(), c("first_error"))
        .when((c("verdict") == "RETAIN") & ~F.lit(force), None)
        .when(left < min_valid_copies(c("durability_class")), "SURVIVABILITY_VIOLATION")
        .otherwise(F.coalesce(lifecycle.physical_preflight(c("lifecycle_state"), c("recompute_cost").isNotNull(), c("durability_class")), F.when(c("_blocked"), "DEPENDENCY_VIOLATION")))
    )
    out = checked.join(blocked, "id", "left").withColumn("error", error)
    gone = c("error").isNull() & ((c("verdict") == "RECLAIM") | F.lit(force))
    return out.select("id", "verdict", "error", F.when(gone, "RECLAIMED").otherwise(c("lifecycle_state")).alias("final_state"))


def reclaimable(objects: DataFrame, replicas: DataFrame, archives: DataFrame, edges: DataFrame, policies: DataFrame, reservations: DataFrame, level: str = "NORMAL", now_ms: int = 0) -> DataFrame:
    """(id): the candidates that a reclamation would not refuse."""
    return simulate(objects, replicas, archives, edges, policies, reservations, level, now_ms).filter("error is null and verdict = 'RECLAIM'").select("id")


def insert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and ``rows``; a key that is there already, or twice in ``rows``, fails."""
    both = table.select(*key).union(rows.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    new = rows.join(both, key).withColumn(key[0], F.when(F.col("_n") == 1, F.col(key[0])).otherwise(F.raise_error(F.lit("duplicate key")).cast(rows.schema[key[0]].dataType))).drop("_n")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those with their keys."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key), key, "left_anti").select(*table.columns)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and ``rows`` of an append-only log; ids go on after the greatest, in order of the rows' ``seq`` (W-06..W-10).

    ``rows`` are one call's entries: few, so one task numbers them.
    """
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    numbered = rows.withColumn("id", (F.row_number().over(Window.orderBy("seq")) + last).cast(table.schema["id"].dataType))
    return table.unionByName(numbered.select(*table.columns))


def close_open(table: DataFrame, changes: DataFrame, key: str, now_ms: int | None = None) -> DataFrame:
    """``table`` with the status of the rows that ``changes`` (key, to_status) names; only OPEN rows change, any other fails the call (T-16)."""
    both = table.join(changes.select(key, "to_status"), key, "left")
    status = F.when(F.col("to_status").isNull(), F.col("status")).when(F.col("status") == "OPEN", F.col("to_status")).otherwise(F.raise_error(F.lit("not open")))
    out = both.withColumn("_new", status)
    if now_ms is not None and "updated_at_ms" in table.columns:
        out = out.withColumn("updated_at_ms", F.when(F.col("to_status").isNotNull(), F.lit(now_ms).cast("bigint")).otherwise(F.col("updated_at_ms")))
    return out.withColumn("status", F.col("_new")).select(*table.columns)


def deletable(objects: DataFrame, replicas: DataFrame, edges: DataFrame, archives: DataFrame) -> DataFrame:
    """(id): objects that nothing refers to (T-18)."""
    return scans.references_to(objects, replicas, edges, archives).filter("dependents = 0").select("id")


def registered(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` objects, which have ``targets`` (array of backends) and payload_size (null without payload), as accepted rows or with their error (T-01)."""
    c = F.col
    old = existing.select("id", F.lit(True).alias("_old"))
    targets = F.array_distinct("targets")
    error = (
        F.when(F.size(object_problems()) > 0, "INVALID_ARGUMENT")
        .when(c("_old"), "ALREADY_EXISTS")
        .when(c("payload_size").isNotNull() & (c("logical_size") != c("payload_size")), "INVALID_ARGUMENT")
        .when(c("payload_size").isNotNull() & (F.size(targets) < min_valid_copies(c("durability_class"))), "SURVIVABILITY_VIOLATION")
    )
    state = F.when(c("payload_size").isNotNull(), "HOT").otherwise("CREATED")
    return new.join(old, "id", "left").withColumns({"error": error, "lifecycle_state": state, "replication_count": F.when(c("payload_size").isNotNull(), F.size(targets)).otherwise(0).cast("bigint"), "targets": targets}).drop("_old")


def fold_access(objects: DataFrame, touches: DataFrame) -> DataFrame:
    """``objects`` with the touches (object_id, ts_ms) added to access_count and last_access_ms; reclaimed ones refuse (T-02)."""
    n = touches.groupBy(F.col("object_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("ts_ms").alias("_t"))
    live = F.col("lifecycle_state") != "RECLAIMED"
    return objects.join(n, "id", "left").withColumns({"access_count": F.col("access_count") + F.when(live, F.coalesce("_n", F.lit(0))).otherwise(0), "last_access_ms": F.when(live & F.col("_t").isNotNull(), F.greatest("last_access_ms", "_t")).otherwise(F.col("last_access_ms"))}).select(*objects.columns)


def fold_pins(events: DataFrame) -> DataFrame:
    """(object_id, pinned) after the last PIN or UNPIN of each object, by (ts_ms, id)."""
    last = F.max_by("action", F.struct("ts_ms", "id"))
    return events.filter("action in ('PIN', 'UNPIN')").groupBy("object_id").agg((last == "PIN").alias("pinned"))


def apply_transitions(objects: DataFrame, changes: DataFrame, actor: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(objects, audit): each object's state after its change (id, to_state), and an entry for each that is allowed and no no-op (T-03)."""
    c = F.col
    both = objects.join(changes.select("id", "to_state"), "id", "left").withColumn("_r", F.when(c("to_state").isNotNull(), lifecycle.transition(c("lifecycle_state"), c("to_state"))))
    both = both.withColumn("_r", F.when(c("_r").isin("INVALID_TRANSITION", "UNKNOWN_STATE"), F.raise_error(F.concat(c("_r"), F.lit(" of "), c("id").cast("string")))).otherwise(c("_r")))
    moved = both.withColumn("_new", F.when(c("_r") == "ALLOWED", c("to_state")).otherwise(c("lifecycle_state")))
    log = both.filter("_r = 'ALLOWED'").select(F.lit(now_ms).cast("bigint").alias("ts_ms"), F.lit(actor).alias("actor"), F.lit("TRANSITION").alias("action"), c("id").alias("object_id"), "generation", c("lifecycle_state").alias("prior_state"), c("to_state").alias("new_state"))
    return moved.withColumn("lifecycle_state", c("_new")).select(*objects.columns), log


def compressed_replicas(objects: DataFrame, replicas: DataFrame, packed: DataFrame) -> DataFrame:
    """``replicas`` with the primary one of each object in ``packed`` (object_id, size, content_hash) replaced (T-08)."""
    first = scans.primary_replica(replicas, objects).join(packed.select("object_id", F.col("size").alias("_s"), F.col("content_hash").alias("_h")), "object_id")
    return replicas.join(first.select("replica_id", "_s", "_h"), "replica_id", "left").withColumns({"size": F.coalesce("_s", "size"), "content_hash": F.coalesce("_h", "content_hash"), "key": F.when(F.col("_h").isNotNull(), F.concat(F.lit("dedup-"), "_h")).otherwise(F.col("key"))}).select(*replicas.columns)


def archived(objects: DataFrame, replicas: DataFrame, archives: DataFrame, backend: str, now_ms: int) -> DataFrame:
    """New archive rows, of each object's primary replica, for objects that aren't archived (T-09)."""
    c = F.col
    first = scans.primary_replica(replicas, objects).join(replicas.drop("object_id"), "replica_id")
    o = objects.filter("lifecycle_state <> 'ARCHIVED'").select(c("id").alias("object_id"), c("generation").alias("_g"))
    rows = first.join(o, "object_id").join(archives.filter("valid").select("object_id"), "object_id", "left_anti")
    key = F.concat(c("object_id").cast("string"), F.lit("/"), c("_g").cast("string"), F.lit("/gen"), c("generation").cast("string"))
    return rows.select(F.concat(F.lit("archive-"), c("object_id").cast("string")).alias("archive_id"), "object_id", c("_g").alias("generation"), F.lit(backend).alias("backend"), key.alias("key"), "size", "content_hash", F.lit(now_ms).cast("bigint").alias("created_at_ms"), F.lit(True).alias("valid"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Object rows with the defaults of columns that they lack (W-11)."""
    given: dict[str, Column] = {
        "generation": F.lit(1), "physical_size": F.lit(0), "access_count": F.lit(0), "reuse_probability": F.lit(0.0), "storage_cost_per_byte_sec": F.lit(0.0), "memory_cost_per_byte_sec": F.lit(0.0),
        "replication_count": F.lit(0), "durability_class": F.lit("EPHEMERAL"), "survivability_class": F.lit("EPHEMERAL"), "owner": F.lit(""), "lifecycle_state": F.lit("CREATED"), "policy_version": F.lit(""),
        "decision_epoch": F.lit(0), "pinned": F.lit(False), "protected": F.lit(False), "app_metadata": F.lit("{}"), "last_access_ms": F.col("created_at_ms"),
    }
    schema = TABLES["objects"]
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else given.get(f.name, F.lit(None))).cast(rows.schema[f.name].dataType if f.name in rows.columns else f.dataType).alias(f.name) for f in schema])


def verified(replicas: DataFrame, payloads: DataFrame) -> DataFrame:
    """``replicas`` with valid false for all owners of a payload (backend, key, payload) whose hash isn't the replica's (T-11)."""
    actual = payloads.select("backend", "key", F.sha2(F.col("payload").cast("binary"), 256).alias("_actual"))
    seen = replicas.join(actual, ["backend", "key"], "left").withColumn("_bad", F.col("valid") & (F.col("_actual").isNull() | (F.col("_actual") != F.col("content_hash"))))
    bad = seen.filter("_bad").select("backend", "key", "content_hash").distinct().withColumn("_hit", F.lit(True))
    return replicas.join(bad, ["backend", "key", "content_hash"], "left").withColumn("valid", F.col("valid") & F.col("_hit").isNull()).select(*replicas.columns)


# The journal phases from which each may follow.
PHASES = {
    "VALIDATED": ("RESERVED",),
    "PHYSICAL_STARTED": ("VALIDATED",),
    "PHYSICAL_DONE": ("PHYSICAL_STARTED",),
    "COMMITTED": ("PHYSICAL_STARTED", "PHYSICAL_DONE"),
    "ROLLED_BACK": ("RESERVED", "VALIDATED", "PHYSICAL_STARTED", "PHYSICAL_DONE"),
    "FAILED": ("RESERVED", "VALIDATED", "PHYSICAL_STARTED", "PHYSICAL_DONE"),
}


def phase_change(phase: Column, to_phase: Column) -> Column:
    """Whether a journal may go from one phase to another (T-15)."""
    return reduce(lambda w, p: w.when(to_phase == p, phase.isin(*PHASES[p])), PHASES, F).otherwise(F.lit(False))
