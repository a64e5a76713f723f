"""Retention economics as column expressions (E-01..E-06, E-08).

Every term keeps its order of evaluation, so results are the same doubles on any
engine.  Nothing here shuffles: one projection of the object's own columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.schemas import ARCHIVE_SHARE, COMPRESSION_SHARE, DECAY_SECS, RECOVERY_SHARE, WEIGHTS

# Names of the components, in their order.
COMPONENT_NAMES = (
    "expected_reuse_value",
    "reconstruction_cost",
    "reconstruction_avoidance_value",
    "dependency_value",
    "survivability_value",
    "retain_cost",
    "storage_cost",
    "memory_cost",
    "memory_pressure_cost",
    "replication_cost",
    "transfer_cost",
    "migration_cost",
    "compression_cost",
    "archive_cost",
    "failure_recovery_value",
    "expected_keep_value",
    "expected_keep_cost",
    "reclaim_score",
    "retention_benefit",
)
INPUTS = ("storage_cost", "memory_cost", "replication_cost", "memory_pressure_cost", "reconstruction_cost", "expected_reuse_value", "retain_cost", "avoidance_share", "transfer_cost_in", "migration_cost_in", "compression_cost", "archive_cost", "failure_recovery_value")


def cost_inputs(objects: DataFrame, multiplier: Column) -> DataFrame:
    """``objects`` with the cost inputs derived from each object at a pressure multiplier."""
    c = F.col
    zero = F.lit(0.0)
    size = F.greatest("logical_size", "physical_size").cast("double")
    decay = F.when(c("reuse_horizon_secs").isNull(), 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + c("reuse_horizon_secs").cast("double") / DECAY_SECS))
    return (
        objects.withColumns({"storage_cost": size * c("storage_cost_per_byte_sec"), "memory_cost": size * c("memory_cost_per_byte_sec"), "reconstruction_cost": F.coalesce("recompute_cost", zero), "transfer_cost_in": F.coalesce("transfer_cost", zero), "migration_cost_in": F.coalesce("migration_cost", zero)})
        .withColumns({"replication_cost": c("memory_cost") * F.greatest(c("replication_count").cast("double") - 1.0, zero), "memory_pressure_cost": c("memory_cost") * F.greatest(multiplier - 1.0, zero)})
        .withColumns(
            {
                "expected_reuse_value": c("reuse_probability") * c("reconstruction_cost") * decay,
                "avoidance_share": c("reuse_probability"),
                "retain_cost": c("memory_cost") + c("storage_cost") + c("replication_cost") + c("memory_pressure_cost"),
                "compression_cost": c("reconstruction_cost") * COMPRESSION_SHARE,
                "archive_cost": c("transfer_cost_in") * ARCHIVE_SHARE,
                "failure_recovery_value": c("reconstruction_cost") * RECOVERY_SHARE,
            }
        )
    )


def evaluate(inputs: DataFrame) -> DataFrame:
    """Keep value, keep cost, score and retention benefit, from cost inputs, weights, dependency_value and survivability_value."""
    c = F.col
    value = c("w_reuse") * c("expected_reuse_value") + c("w_reconstruction") * c("reconstruction_avoidance_value") + c("w_dependency") * c("dependency_value") + c("w_survivability") * c("survivability_value")
    cost = (
        c("w_memory") * c("memory_cost")
        + c("w_storage") * c("storage_cost")
        + c("w_replication") * c("replication_cost")
        + c("w_pressure") * c("memory_pressure_cost")
        + c("w_transfer") * c("transfer_cost_in")
        + c("w_migration") * c("migration_cost_in")
    )
    return (
        inputs.withColumn("reconstruction_avoidance_value", c("reconstruction_cost") * c("avoidance_share"))
        .withColumns({"expected_keep_value": value, "expected_keep_cost": cost})
        .withColumns({"reclaim_score": c("expected_keep_cost") - c("expected_keep_value"), "retention_benefit": c("expected_keep_value") - c("retain_cost")})
    )


def components() -> Column:
    """The named components, in their fixed order."""
    own = {"transfer_cost": "transfer_cost_in", "migration_cost": "migration_cost_in"}
    return F.array(*[F.struct(F.lit(n).alias("name"), F.col(own.get(n, n)).alias("value")) for n in COMPONENT_NAMES])


def component(name: str) -> Column:
    """The first component of that name (E-03)."""
    return F.filter("components", lambda x: x["name"] == name)[0]["value"]


def explanation() -> Column:
    """A flat JSON object of a decision (E-05)."""
    c = F.col
    # The keys.
    fixed = {
        "decision": c("verdict"),
        "score": c("score"),
        "threshold": c("threshold"),
        "policy": F.concat("policy_id", F.lit("-"), "policy_version"),
        "reuse_probability": c("reuse_probability"),
        "expected_reuse_horizon_secs": c("reuse_horizon_secs"),
        "logical_size": c("logical_size"),
        "recompute_cost": c("recompute_cost"),
        "recomputation_latency_secs": c("recompute_latency_secs"),
        "pressure": c("pressure"),
        "epoch": c("epoch"),
    }
    named = {f"component_{n}": c("components")[i]["value"] for i, n in enumerate(COMPONENT_NAMES)}
    return F.to_json(F.struct(*[v.alias(k) for k, v in (fixed | named).items()]), {"ignoreNullFields": "false"})


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_cost(x: Column) -> Column:
    return finite(x) & (x >= 0.0)


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def input_problems() -> Column:
    """Cost inputs that aren't finite and non-negative (E-04)."""
    return problems({n: finite_cost(F.col(n)) for n in INPUTS})


def weight_problems() -> Column:
    return problems({w: finite_cost(F.col(w)) for w in WEIGHTS})


def object_checks() -> dict[str, Column]:
    """What must hold of an object (E-06)."""
    c = F.col
    optional = ("recompute_cost", "recompute_latency_secs", "transfer_cost", "migration_cost")
    required = ("storage_cost_per_byte_sec", "memory_cost_per_byte_sec")
    return {
        "reuse_probability": finite(c("reuse_probability")) & c("reuse_probability").between(0.0, 1.0),
        **{n: c(n).isNull() | finite_cost(c(n)) for n in optional},
        **{n: finite_cost(c(n)) for n in required},
        "class": F.trim("class") != "",
        "retention": F.coalesce(c("min_retention_deadline_ms") <= c("max_retention_deadline_ms"), F.lit(True)),
    }


def object_problems() -> Column:
    return problems(object_checks())


def require(df: DataFrame, checks: dict[str, Column], message: str) -> DataFrame:
    """``df``, failing as a whole if a check of any row fails; it rides on the first column, so it can't be pruned away from its row."""
    first = df.columns[0]
    fine = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in checks.values()])
    error = F.raise_error(F.concat(F.lit(f"{message}: "), F.array_join(problems(checks), ", "))).cast(df.schema[first].dataType)
    return df.withColumn(first, F.when(fine, F.col(first)).otherwise(error))


def min_valid_copies(durability: Column) -> Column:
    """Copies that a class needs (E-07)."""
    from keepwell.schemas import DURABILITY

    return reduce(lambda w, k: w.when(durability == k, F.lit(DURABILITY[k])), DURABILITY, F).cast("bigint")
