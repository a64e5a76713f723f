"""Lifecycle transitions, survivability and reclaim preflight (E-16..E-20, K-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.economics import min_valid_copies
from keepwell.schemas import STATES, TRANSITIONS


def transition(from_state: Column, to_state: Column) -> Column:
    """NOOP, ALLOWED, INVALID_TRANSITION or UNKNOWN_STATE.  Fifty edges are a constant of the plan, not a join."""
    allowed = reduce(lambda w, s: w.when(from_state == s, to_state.isin(*TRANSITIONS[s])), TRANSITIONS, F).otherwise(F.lit(False))
    return F.when(~(from_state.isin(*STATES) & to_state.isin(*STATES)), "UNKNOWN_STATE").when(from_state == to_state, "NOOP").when(allowed, "ALLOWED").otherwise("INVALID_TRANSITION")


def parse_state(text: Column) -> Column:
    return F.when(text.isin(*STATES), text).otherwise(F.raise_error(F.concat(F.lit("unknown state "), text)))


def remaining_copies(valid_before: Column, deleted_valid: Column, archives: Column) -> Column:
    """Saturating: nothing is below zero."""
    return F.greatest(F.greatest(valid_before - deleted_valid, F.lit(0)) - archives, F.lit(0))


def survivability(objects: DataFrame) -> DataFrame:
    """(id, remaining, needed, ok) if every replica and archive of an object with n_replicas and n_archives goes."""
    left = remaining_copies(F.col("n_replicas"), F.col("n_replicas"), F.col("n_archives"))
    return objects.select("id", left.alias("remaining"), min_valid_copies(F.col("durability_class")).alias("needed")).withColumn("ok", F.col("remaining") >= F.col("needed"))


def preflight(objects: DataFrame, reservations: DataFrame, now_ms: int) -> DataFrame:
    """``objects`` with error: what a reclamation stops at first, before any plan."""
    held = reservations.filter("status = 'OPEN'").select(F.col("object_id").alias("id"), F.lit(True).alias("_held")).distinct()
    error = (
        F.when(F.col("pinned"), "PINNED_OBJECT")
        .when(F.col("protected"), "PROTECTED_OBJECT")
        .when(F.col("lifecycle_state") == "RECLAIMED", "ALREADY_RECLAIMED")
        .when(F.col("lifecycle_state") == "FAILED", "FAILED_OBJECT")
        .when(F.col("_held"), "RESERVATION_CONFLICT")
        .when(F.col("min_retention_deadline_ms") > now_ms, "BEFORE_RETENTION_DEADLINE")
    )
    return objects.join(held, "id", "left").withColumn("error", error).drop("_held")


def physical_preflight(state: Column, remade: Column, durability: Column) -> Column:
    """The error of states that can't be made reclaimable, or null (E-20)."""
    warm = state.isin("HOT", "WARM", "COLD", "COMPRESSED")
    return (
        F.when(warm & ~remade & (durability != "EPHEMERAL"), "SURVIVABILITY_VIOLATION")
        .when(warm & (transition(state, F.lit("RECOMPUTABLE")) == "INVALID_TRANSITION"), "INVALID_TRANSITION")
        .when(~warm & (transition(state, F.lit("RECLAIM_PENDING")) == "INVALID_TRANSITION"), "INVALID_TRANSITION")
    )
