"""Decision context, plans and candidate selection (J-01..J-04, K-01, T-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions import economics
from keepwell.operators import policy, scans
from keepwell.schemas import DEPENDENT_VALUE, MAX_CANDIDATES, PRESSURE


def dependency_values(objects: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, dependency_value): direct dependents that are neither reclaimed nor reconstructible, an unknown child being neither (J-03, J-04)."""
    child = objects.select(F.col("id").alias("child_id"), F.col("recompute_cost").isNotNull().alias("remade"), (F.col("lifecycle_state") == "RECLAIMED").alias("dead"))
    blocking = ~F.coalesce("remade", F.lit(False)) & ~F.coalesce("dead", F.lit(False))
    return lineage.filter("kind = 'DEPENDS_ON'").join(child, "child_id", "left").filter(blocking).groupBy(F.col("parent_id").alias("id")).agg((F.count(F.lit(1)).cast("double") * DEPENDENT_VALUE).alias("dependency_value"))


def with_context(objects: DataFrame, replicas: DataFrame, archives: DataFrame, lineage: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``objects``, of the ``known`` ones, with n_replicas, n_archives, dependency_value and survivability_value.

    The counts are aggregated before they are joined; the four joins share the
    objects' partitioning by id.
    """
    valid = scans.valid_replica_counts(replicas).select(F.col("object_id").alias("id"), F.col("n").alias("n_replicas"))
    kept = scans.archive_counts(archives).select(F.col("object_id").alias("id"), F.col("n").alias("n_archives"))
    copies = F.greatest(economics.min_valid_copies(F.col("survivability_class")), F.lit(1)).cast("double")
    return (
        objects.join(valid, "id", "left")
        .join(kept, "id", "left")
        .join(dependency_values(objects if known is None else known, lineage), "id", "left")
        .withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_replicas", "n_archives")})
        .withColumns({"dependency_value": F.coalesce("dependency_value", F.lit(0.0)), "survivability_value": F.when(F.col("n_replicas") + F.col("n_archives") > 0, copies).otherwise(0.0)})
    )


def plan(objects: DataFrame, replicas: DataFrame, archives: DataFrame, lineage: DataFrame, policies: DataFrame, level: str = "NORMAL", epoch: int = 1, strict: bool = True) -> DataFrame:
    """Every object's decision.  If ``strict``, any invalid object fails the whole call; else invalid ones are left out (see ``rejected``)."""
    sound = economics.require(objects, economics.object_checks(), "invalid object") if strict else objects.filter(F.size(economics.object_problems()) == 0)
    context = with_context(sound, replicas, archives, lineage, objects)
    return policy.decide(policy.resolve(context, policies, level, strict), level, PRESSURE[level], epoch)


def rejected(objects: DataFrame) -> DataFrame:
    """(id, problems) of invalid objects."""
    return objects.select("id", economics.object_problems().alias("problems")).filter(F.size("problems") > 0)


def candidates(objects: DataFrame, replicas: DataFrame, archives: DataFrame, lineage: DataFrame, policies: DataFrame, level: str = "NORMAL", limit: int | None = 100, epoch: int = 1) -> DataFrame:
    """Objects that the plan reclaims, best first: score descending, id ascending; ``limit`` at most 10 000, or None for all in no order."""
    if limit is not None and not 0 <= limit <= MAX_CANDIDATES:
        raise ValueError(f"limit must be within 0..{MAX_CANDIDATES}")
    found = plan(objects, replicas, archives, lineage, policies, level, epoch)
    found = found.filter(~F.col("lifecycle_state").isin("RECLAIMED", "FAILED") & (F.col("verdict") == "RECLAIM"))
    return found if limit is None else found.orderBy(F.desc("score"), F.asc("id")).limit(limit)
