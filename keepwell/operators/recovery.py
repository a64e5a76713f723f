"""Classification of interrupted operations (T-12..T-14, J-09..J-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.schemas import JOURNAL_CLOSED


def facts(journal: DataFrame, present: DataFrame) -> DataFrame:
    """(attempt_id, phase, n_plan, n_archives, n_present, unavailable) of journal entries with their nested payload.

    ``present`` (backend, key, exists) says what backends hold; exists is null
    where a backend doesn't answer.  n_plan is null without a physical plan.
    """
    c = F.col
    plan, archives = c("payload.physical_replica_deletions"), c("payload.archive_deletions")
    things = F.concat(F.transform(F.coalesce(plan, F.array().cast(plan_type(journal))), lambda r: F.struct(r["backend"].alias("backend"), r["key"].alias("key"))), F.transform(archives, lambda a: F.struct(a["backend"].alias("backend"), a["key"].alias("key"))))
    open_ = journal.filter(~c("phase").isin(*JOURNAL_CLOSED))
    each = open_.select("attempt_id", F.explode(things).alias("t")).select("attempt_id", "t.*").join(present, ["backend", "key"], "left")
    truth = each.groupBy("attempt_id").agg(F.count_if(c("exists")).alias("n_present"), F.bool_or(c("exists").isNull()).alias("unavailable"))
    return open_.select("attempt_id", "phase", F.when(plan.isNotNull(), F.size(plan)).alias("n_plan"), F.size(archives).alias("n_archives")).join(truth, "attempt_id", "left").withColumns({"n_present": F.coalesce("n_present", F.lit(0)), "unavailable": F.coalesce("unavailable", F.lit(False))})


def plan_type(journal: DataFrame) -> str:
    return journal.schema["payload"].dataType["physical_replica_deletions"].dataType.simpleString()


def outcome() -> Column:
    """ROLLED_BACK, COMMITTED, CLOSED, or ERROR for what stays open."""
    c = F.col
    total = c("n_plan") + c("n_archives")
    return (
        F.when(c("phase").isin(*JOURNAL_CLOSED), "CLOSED")
        .when(c("phase").isin("RESERVED", "VALIDATED"), F.when(c("n_plan").isNull(), "ROLLED_BACK").otherwise("ERROR"))
        .when(c("n_plan").isNull(), "ERROR")
        .when(total == 0, F.when(c("phase") == "PHYSICAL_DONE", "COMMITTED").otherwise("ROLLED_BACK"))
        .when(c("unavailable"), "ERROR")
        .when(c("n_present") == total, "ROLLED_BACK")
        .when(c("n_present") == 0, "COMMITTED")
        .otherwise("ERROR")
    )


def reconcile(entries: DataFrame) -> DataFrame:
    """(attempt_id, phase, outcome) of rows as ``facts`` gives them."""
    return entries.select("attempt_id", "phase", outcome().alias("outcome"))


def expired(reservations: DataFrame, journal: DataFrame, objects: DataFrame, now_ms: int) -> DataFrame:
    """(reservation_id, attempt_id, object_id, object_state) of open reservations past their time whose journal isn't open; a pending object fails."""
    still = journal.filter(~F.col("phase").isin(*JOURNAL_CLOSED)).select("attempt_id")
    late = reservations.filter((F.col("status") == "OPEN") & (F.col("expires_at_ms") <= now_ms)).join(still, "attempt_id", "left_anti")
    state = F.when(F.col("lifecycle_state") == "RECLAIM_PENDING", "FAILED").otherwise(F.col("lifecycle_state"))
    return late.join(objects.select(F.col("id").alias("object_id"), "lifecycle_state"), "object_id", "left").select("reservation_id", "attempt_id", "object_id", state.alias("object_state"))


def rollback_conflicts(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(attempt_id, replica_id, conflict) for replicas of journals: CHANGED, KEY_REASSIGNED, or MISSING (to be restored); those that agree have no row."""
    keys = ("object_id", "generation", "backend", "key", "kind", "size", "content_hash", "valid")
    s = stored.select("replica_id", F.struct(*keys).alias("_now"))
    both = expected.select("attempt_id", "replica_id", "backend", "key", F.struct("content_hash", "size").alias("_c"), F.struct(*keys).alias("_was")).join(s, "replica_id", "left")
    at = stored.groupBy("backend", "key").agg(F.min(F.struct("content_hash", "size")).alias("_low"), F.max(F.struct("content_hash", "size")).alias("_high"))
    both = both.join(at, ["backend", "key"], "left")
    taken = F.col("_low").isNotNull() & ((F.col("_low") != F.col("_c")) | (F.col("_high") != F.col("_c")))
    conflict = F.when(F.col("_now").isNotNull(), F.when(F.col("_now") != F.col("_was"), "CHANGED")).when(taken, "KEY_REASSIGNED").otherwise("MISSING")
    return both.select("attempt_id", "replica_id", conflict.alias("conflict")).filter("conflict is not null")


def rolled_back(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """``stored`` replicas with the missing ones of the journals; conflicts fail the call."""
    found = rollback_conflicts(expected, stored)
    missing = found.withColumn("replica_id", F.when(F.col("conflict") == "MISSING", F.col("replica_id")).otherwise(F.raise_error(F.concat(F.lit("conflict: "), "conflict")).cast(stored.schema["replica_id"].dataType))).select("replica_id")
    return stored.unionByName(expected.join(missing, "replica_id", "left_semi").select(*stored.columns))


def payload_problems(journal: DataFrame) -> DataFrame:
    """(attempt_id, problem): a physical plan before its phase or none after it, or one with replicas that aren't scheduled (T-14)."""
    c = F.col
    plan, scheduled = c("payload.physical_replica_deletions"), c("payload.replica_deletions")
    early = c("phase").isin("RESERVED", "VALIDATED") & plan.isNotNull()
    late = c("phase").isin("PHYSICAL_STARTED", "PHYSICAL_DONE") & plan.isNull()
    stray = F.exists(plan, lambda x: ~F.exists(scheduled, lambda y: x == y))
    return journal.select("attempt_id", F.when(early, "PLAN_TOO_EARLY").when(late, "PLAN_MISSING").when(stray, "PLAN_NOT_SCHEDULED").alias("problem")).filter("problem is not null")
