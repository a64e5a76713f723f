"""Content identity: groups, reference counts, repair and physical deletion (D-02..D-09, A-14, A-16, J-06..J-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_key(content_hash: Column, replica_index: Column | None = None) -> Column:
    key = F.concat(F.lit("dedup-"), content_hash)
    return key if replica_index is None else F.when(replica_index > 0, F.concat(key, F.lit("-r"), replica_index.cast("string"))).otherwise(key)


def duplicate_groups(objects: DataFrame) -> DataFrame:
    """(content_hash, n, first_id, last_id) of hashes that several objects have.

    A summary rather than member lists: a group may hold a third of all rows.
    ``duplicate_members`` gives the members, a row each.
    """
    return objects.filter("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def duplicate_members(objects: DataFrame) -> DataFrame:
    return objects.select("content_hash", "id").join(duplicate_groups(objects).select("content_hash"), "content_hash", "left_semi")


def live_identities(replicas: DataFrame, objects: DataFrame, strict: bool = True) -> DataFrame:
    """(content_hash, backend, ref_count, storage_key, payload_size) from valid replicas with a hash.

    If ``strict``, replicas of one identity that disagree about key or size, of
    unknown objects, or of reclaimed ones fail the call; else ``problem`` says so.
    """
    own = objects.select(F.col("id").alias("object_id"), "lifecycle_state", F.lit(True).alias("known"))
    live = replicas.filter("valid and content_hash <> ''").join(own, "object_id", "left")
    found = live.groupBy("content_hash", "backend").agg(
        F.count(F.lit(1)).alias("ref_count"),
        F.min("key").alias("storage_key"),
        F.min("size").alias("payload_size"),
        (F.min("key") != F.max("key")).alias("_keys"),
        (F.min("size") != F.max("size")).alias("_sizes"),
        F.count_if(F.col("known").isNull()).alias("_orphans"),
        F.count_if(F.col("lifecycle_state") == "RECLAIMED").alias("_dead"),
    )
    problem = F.when(F.col("_orphans") > 0, "ORPHAN_REPLICA").when(F.col("_dead") > 0, "RECLAIMED_OWNER").when(F.col("_keys"), "KEY_MISMATCH").when(F.col("_sizes"), "SIZE_MISMATCH")
    found = found.withColumn("problem", problem)
    if strict:
        found = found.withColumn("ref_count", F.when(F.col("problem").isNull(), F.col("ref_count")).otherwise(F.raise_error(F.col("problem"))))
        return found.select("content_hash", "backend", "ref_count", "storage_key", "payload_size")
    return found.select("content_hash", "backend", "ref_count", "storage_key", "payload_size", "problem")


def repair(dedup: DataFrame, live: DataFrame) -> DataFrame:
    """(content_hash, backend, ref_count, storage_key, payload_size, action) that makes ``dedup`` what ``live`` says; REMOVED rows go."""
    d = dedup.select("content_hash", "backend", *[F.col(c).alias(f"d_{c}") for c in ("ref_count", "storage_key", "payload_size")])
    both = d.join(live.select("content_hash", "backend", "ref_count", "storage_key", "payload_size"), ["content_hash", "backend"], "full_outer")
    same = (F.col("d_ref_count") == F.col("ref_count")) & (F.col("d_storage_key") == F.col("storage_key")) & (F.col("d_payload_size") == F.col("payload_size"))
    action = F.when(F.col("ref_count").isNull(), "REMOVED").when(F.col("d_ref_count").isNull(), "RECREATED").when(same, "KEPT").otherwise("REPAIRED")
    return both.select("content_hash", "backend", *[F.coalesce(c, f"d_{c}").alias(c) for c in ("ref_count", "storage_key", "payload_size")], action.alias("action"))


def ref_count_errors(dedup: DataFrame, live: DataFrame) -> DataFrame:
    """(content_hash, stored, live) where the references of a hash, over all backends, differ."""
    a = dedup.groupBy("content_hash").agg(F.sum("ref_count").alias("stored"))
    b = live.groupBy("content_hash").agg(F.sum("ref_count").alias("live"))
    return a.join(b, "content_hash", "full_outer").select("content_hash", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("live", F.lit(0)).alias("live")).filter("stored <> live")


def ambiguous_hashes(dedup: DataFrame) -> DataFrame:
    """Hashes on several backends: a lookup without a backend fails for them."""
    return dedup.groupBy("content_hash").agg(F.count_distinct("backend").alias("n_backends")).filter("n_backends > 1")


def canonical(dedup: DataFrame) -> DataFrame:
    """(content_hash, backend, storage_key): of each hash the least with references."""
    return dedup.filter("ref_count > 0").groupBy("content_hash").agg(F.min(F.struct("backend", "storage_key")).alias("c")).select("content_hash", "c.*")


def acquire(dedup: DataFrame, added: DataFrame) -> DataFrame:
    """``dedup`` with a reference more for each row of ``added`` (content_hash, backend, storage_key, payload_size)."""
    more = added.select("content_hash", "backend", "storage_key", F.lit(1).cast("bigint").alias("ref_count"), "payload_size")
    keys = ["content_hash", "backend"]
    return dedup.select(*more.columns).union(more).groupBy(*keys).agg(F.min("storage_key").alias("storage_key"), F.sum("ref_count").alias("ref_count"), F.min("payload_size").alias("payload_size"))


def release(dedup: DataFrame, released: DataFrame) -> DataFrame:
    """``dedup`` with a reference less for each row of ``released``; ``last`` marks rows whose payload goes; more releases than references fail."""
    gone = released.groupBy("content_hash", "backend").agg(F.count(F.lit(1)).alias("gone"))
    left = F.col("ref_count") - F.coalesce("gone", F.lit(0))
    return dedup.join(gone, ["content_hash", "backend"], "left").select("content_hash", "backend", "storage_key", F.when(left >= 0, left).otherwise(F.raise_error(F.lit("more released than referenced"))).alias("ref_count"), "payload_size", (left == 0).alias("last"))


def deletion_plan(scheduled: DataFrame, dedup: DataFrame) -> DataFrame:
    """Per (content_hash, backend, key) of scheduled replicas: n_scheduled, ref_count, deletable and problem.

    A payload goes when all references to it are scheduled; replicas without a
    hash always go.
    """
    n = scheduled.groupBy("content_hash", "backend", "key").agg(F.count(F.lit(1)).alias("n_scheduled"))
    both = n.join(dedup.select("content_hash", "backend", "storage_key", "ref_count"), ["content_hash", "backend"], "left")
    unshared = F.col("content_hash") == ""
    problem = F.when(unshared, None).when(F.col("ref_count").isNull(), "MISSING_ENTRY").when(F.col("storage_key") != F.col("key"), "KEY_MISMATCH").when(F.col("n_scheduled") > F.col("ref_count"), "OVER_RELEASE")
    return both.withColumn("problem", problem).select("content_hash", "backend", "key", "n_scheduled", "ref_count", (unshared | (F.col("problem").isNull() & (F.col("n_scheduled") == F.col("ref_count")))).alias("deletable"), "problem")


def corrupt_owners(replicas: DataFrame, corrupt: DataFrame) -> DataFrame:
    """All owners of the payloads (backend, key, content_hash) of corrupt replicas (J-14)."""
    return replicas.join(corrupt.select("backend", "key", "content_hash"), ["backend", "key", "content_hash"], "left_semi").select("object_id", "replica_id")


def aliased(replicas: DataFrame) -> DataFrame:
    """Replicas at a (backend, key) where another has a different hash or size (J-12).

    A location with more than one distinct (hash, size) makes all its replicas
    conflict, so an aggregate finds what a self join would.
    """
    clash = replicas.groupBy("backend", "key").agg((F.min(F.struct("content_hash", "size")) != F.max(F.struct("content_hash", "size"))).alias("clash")).filter("clash")
    return replicas.join(clash, ["backend", "key"], "left_semi")
