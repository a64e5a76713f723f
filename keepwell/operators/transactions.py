"""What operations change, as rows: reclaiming, aborting, compressing, restoring, registering, recovering (T-01, T-02, T-04..T-08, T-10, T-12, T-13, T-18, W-01, W-03, W-12, W-15, R-01).

Each operator takes tables and returns the tables that change, or the rows to
add to them, together with the log's entries.  All objects of a call are judged
against one snapshot.  Log entries have no id yet: ``reclaim.append`` numbers
them where they are written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions import codec
from keepwell.operators import dedup as identities
from keepwell.operators import nodes, policy, recovery, scans
from keepwell.schemas import NODE_TIMEOUT_MS, TRANSITIONS

#: Where an object's metadata keeps the length of what was compressed.
ORIGINAL_SIZE = "keepwell.original_size"
DESCRIPTOR = ("object_id", "generation", "backend", "key", "content_hash")


def entries(rows: DataFrame, action: Column | str, actor: str, now_ms: int, **given: Column) -> DataFrame:
    """Log entries of ``rows``; columns that aren't given are null, the detail an empty object."""
    action = F.lit(action) if isinstance(action, str) else action
    names = ("object_id", "generation", "prior_state", "new_state", "policy", "attempt_id", "node")
    detail = given.get("detail", F.lit("{}"))
    return rows.select(F.lit(now_ms).cast("bigint").alias("ts_ms"), F.lit(actor).alias("actor"), action.alias("action"), *[given.get(n, F.lit(None)).alias(n) for n in names], detail.alias("detail"))


# --- reclaiming (T-06, T-07) ------------------------------------------------------------------------


class Reclaimed(NamedTuple):
    objects: DataFrame
    replicas: DataFrame
    archives: DataFrame
    dedup: DataFrame
    payloads: DataFrame
    audit: DataFrame


def reclaimed(simulated: DataFrame, objects: DataFrame, replicas: DataFrame, archives: DataFrame, dedup: DataFrame, now_ms: int, actor: str = "operator") -> Reclaimed:
    """The tables after the reclamations that ``simulated`` (reclaim.simulate) lets through.

    All replicas of an object go, and its valid archives.  A payload goes with
    its last reference: ``payloads`` has each (content_hash, backend, key) of
    the dropped replicas, deletable or not, and the problem that would stop it.
    ``dedup`` is without the rows that lost their last reference.
    """
    gone = simulated.filter("error is null and final_state = 'RECLAIMED'").select("id")
    own = gone.withColumnRenamed("id", "object_id")
    dropped = replicas.join(own, "object_id", "left_semi")
    payloads = identities.deletion_plan(dropped, dedup)
    released = identities.release(dedup, dropped.filter("content_hash <> ''")).filter("not last").drop("last")
    hit = objects.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    after = hit.withColumn("lifecycle_state", F.when(F.col("_gone"), "RECLAIMED").otherwise(F.col("lifecycle_state"))).select(*objects.columns)
    log = entries(objects.join(gone, "id", "left_semi"), "RECLAIM_COMMITTED", actor, now_ms, object_id=F.col("id"), generation=F.col("generation"), prior_state=F.lit("RECLAIM_PENDING"), new_state=F.lit("RECLAIMED"))
    kept = archives.join(own.withColumn("_gone", F.lit(True)), "object_id", "left").filter("_gone is null or not valid").select(*archives.columns)
    return Reclaimed(after, replicas.join(own, "object_id", "left_anti").select(*replicas.columns), kept, released, payloads, log)


class Aborted(NamedTuple):
    objects: DataFrame
    attempts: DataFrame
    reservations: DataFrame
    journal: DataFrame
    audit: DataFrame


def aborted(aborts: DataFrame, prior: DataFrame, objects: DataFrame, attempts: DataFrame, reservations: DataFrame, journal: DataFrame, now_ms: int) -> Aborted:
    """The tables after the reclamations in ``aborts`` (attempt_id, reason) were called off (T-07).

    ``prior`` has the objects as they were, by attempt_id.  Their rows come back,
    reservations are released, attempts and open journals rolled back.
    """
    called = aborts.select("attempt_id", "reason")
    before = prior.join(called, "attempt_id")
    state = lambda df, column, to, open_: df.join(called.select("attempt_id", F.lit(True).alias("_off")), "attempt_id", "left").withColumn(column, F.when(F.col("_off") & open_, to).otherwise(F.col(column))).select(*df.columns)
    log = entries(before, "RECLAIM_ABORTED", "coordinator", now_ms, object_id=F.col("id"), generation=F.col("generation"), prior_state=F.lit("RECLAIM_PENDING"), new_state=F.col("lifecycle_state"), attempt_id=F.col("attempt_id"), detail=F.to_json(F.struct("reason")))
    back = objects.join(before.select("id"), "id", "left_anti").select(*objects.columns).unionByName(before.select(*objects.columns))
    open_phase = ~F.col("phase").isin(*recovery.JOURNAL_CLOSED)
    return Aborted(back, state(attempts, "status", "ROLLED_BACK", F.col("status") == "OPEN"), state(reservations, "status", "RELEASED", F.col("status") == "OPEN"), state(journal, "phase", "ROLLED_BACK", open_phase), log)


def indeterminate(reports: DataFrame, now_ms: int) -> DataFrame:
    """Failure rows of reclamations (attempt_id, object_id, kind, reason) that broke off after their physical part began; their journals stay open for recovery (T-07)."""
    return reports.select(F.lit(now_ms).cast("bigint").alias("ts_ms"), "object_id", "attempt_id", "kind", F.col("reason").alias("message"), F.lit(False).alias("recovered"))


# --- compressing and restoring (T-08, T-10) ---------------------------------------------------------


class Swapped(NamedTuple):
    outcome: DataFrame
    objects: DataFrame
    replicas: DataFrame
    dedup: DataFrame
    audit: DataFrame


def compressed(packed: DataFrame, objects: DataFrame, replicas: DataFrame, dedup: DataFrame, now_ms: int, actor: str = "operator") -> Swapped:
    """The tables after objects' primary replicas gave way to their compressed payloads (T-08).

    ``packed`` (object_id, codec, original_size, size, content_hash) says what
    each payload became.  ``outcome`` has (object_id, error): an object that may
    not become COMPRESSED (one that is already is left as it is), has no live
    payload, or whose source has no entry of that key in ``dedup`` stays as it
    is.  Only the primary replica is replaced; the old identity loses a
    reference and the new one gains it, with the key that it already has.
    """
    c = F.col
    from_ = ["COMPRESSED", *[s for s, to in TRANSITIONS.items() if "COMPRESSED" in to]]
    first = scans.primary_replica(replicas, objects).join(replicas.select("replica_id", c("backend").alias("_backend"), c("key").alias("_key"), c("content_hash").alias("_hash")), "replica_id")
    old = dedup.select(c("content_hash").alias("_hash"), c("backend").alias("_backend"), c("storage_key").alias("_old_key"))
    new = dedup.select(c("content_hash"), c("backend").alias("_backend"), c("storage_key").alias("_new_key"))
    plan = packed.join(objects.select(c("id").alias("object_id"), "lifecycle_state", c("generation").alias("_generation")), "object_id", "left").join(first, "object_id", "left").join(old, ["_hash", "_backend"], "left").join(new, ["content_hash", "_backend"], "left")
    error = (
        F.when(c("lifecycle_state").isNull(), "NOT_FOUND")
        .when(~c("lifecycle_state").isin(*from_), "INVALID_TRANSITION")
        .when(c("replica_id").isNull(), "NO_LIVE_PAYLOAD")
        .when((c("_hash") != "") & (c("_old_key").isNull() | (c("_old_key") != c("_key"))), "DEDUP_MISMATCH")
    )
    plan = plan.withColumns({"error": error, "_to": F.coalesce("_new_key", F.concat("_key", F.lit("-zstd")))})
    done = plan.filter("error is null")
    swap = done.select("replica_id", c("size").alias("_size"), c("content_hash").alias("_new"), "_to")
    moved = replicas.join(swap, "replica_id", "left").withColumns({"size": F.coalesce("_size", "size"), "content_hash": F.coalesce("_new", "content_hash"), "key": F.coalesce("_to", "key"), "replica_id": F.when(c("_to").isNotNull(), F.concat("replica_id", F.lit("-zstd"))).otherwise(c("replica_id"))}).select(*replicas.columns)
    change = done.select(c("object_id").alias("id"), c("size").alias("_size"), "original_size")
    hit = objects.join(change, "id", "left")
    fields = {"lifecycle_state": F.when(c("_size").isNotNull(), "COMPRESSED").otherwise(c("lifecycle_state")), "physical_size": F.coalesce("_size", "physical_size"), "compressed_size": F.coalesce("_size", "compressed_size")}
    if "app_metadata" in objects.columns:
        fields["app_metadata"] = F.when(c("_size").isNotNull(), F.to_json(F.map_concat(F.coalesce(F.from_json("app_metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit(ORIGINAL_SIZE), c("original_size").cast("string"))))).otherwise(c("app_metadata"))
    swapped = done.filter("_hash <> content_hash")
    fewer = identities.release(dedup, swapped.filter("_hash <> ''").select(c("_hash").alias("content_hash"), c("_backend").alias("backend"))).filter("not last").drop("last")
    more = identities.acquire(fewer, swapped.select("content_hash", c("_backend").alias("backend"), c("_to").alias("storage_key"), c("size").alias("payload_size")))
    log = entries(done, "OBJECT_COMPRESSED", actor, now_ms, object_id=c("object_id"), generation=c("_generation"), prior_state=c("lifecycle_state"), new_state=F.lit("COMPRESSED"), detail=F.to_json(F.struct("codec", "original_size", c("size").alias("compressed_size"), c("content_hash").alias("compressed_hash"), c("_to").alias("key"))))
    return Swapped(plan.select("object_id", "error"), hit.withColumns(fields).select(*objects.columns), moved, more, log)


def restored(objects: DataFrame, archives: DataFrame, replicas: DataFrame, dedup: DataFrame, payloads: DataFrame, target: str, now_ms: int, actor: str = "operator") -> Swapped:
    """The tables after every object in ``objects`` was restored from its newest archive (T-10).

    ``payloads`` (backend, key, payload) holds what archives store.  Bytes are
    verified against the archive's hash; those of a compressed object are
    unpacked to exactly their original length and verified against its own.  A
    valid replica that already has the content is used as it is; else one is
    added on ``target``, under the key that ``dedup`` has for the content.
    ``outcome`` has (object_id, error, reused); what fails stays as it is.
    """
    c = F.col
    last = scans.newest_archive(archives).select("archive_id").join(archives, "archive_id").select("object_id", c("backend").alias("a_backend"), c("key").alias("a_key"), c("content_hash").alias("a_hash"))
    size = F.get_json_object("app_metadata", f"$['{ORIGINAL_SIZE}']").cast("bigint") if "app_metadata" in objects.columns else F.lit(None).cast("bigint")
    own = objects.select(c("id").alias("object_id"), c("generation").alias("_generation"), "lifecycle_state", c("content_hash").alias("_own"), "compressed_size", size.alias("_original"))
    found = own.join(last, "object_id", "left").join(payloads.select(c("backend").alias("a_backend"), c("key").alias("a_key"), c("payload").cast("binary").alias("_raw")), ["a_backend", "a_key"], "left")
    is_packed = c("compressed_size").isNotNull() & c("_own").isNotNull() & (c("_own") != c("a_hash"))
    checked = found.withColumns({"_packed": is_packed, "_sound": codec.verified(c("_raw"), c("a_hash"))})
    unpackable = F.coalesce(c("_packed"), F.lit(False)) & F.coalesce(c("_sound"), F.lit(False)) & c("_original").isNotNull()
    checked = checked.withColumn("_data", F.when(unpackable, codec.unzstd(F.when(unpackable, c("_raw")), c("_original"))).when(~c("_packed"), c("_raw")))
    checked = checked.withColumn("_hash", codec.content_hash(c("_data")))
    error = (
        F.when(c("lifecycle_state") != "ARCHIVED", "NOT_ARCHIVED")
        .when(c("a_key").isNull(), "NO_ARCHIVE")
        .when(c("_raw").isNull(), "ARCHIVE_FAILURE")
        .when(~c("_sound") | c("_data").isNull() | (c("_own").isNotNull() & (c("_own") != c("_hash"))), "INTEGRITY_FAILURE")
    )
    hot = replicas.filter("valid and kind <> 'ARCHIVED'").groupBy("object_id", c("content_hash").alias("_hash")).agg(F.min(F.struct("replica_id", "size")).alias("_hot"))
    entry = dedup.filter(c("backend") == target).select(c("content_hash").alias("_hash"), c("storage_key").alias("_key"))
    plan = checked.withColumns({"error": error, "_length": F.octet_length("_data")}).drop("_raw", "_data").join(hot, ["object_id", "_hash"], "left").join(entry, "_hash", "left")
    plan = plan.withColumns({"reused": c("_hot").isNotNull(), "_to": F.coalesce("_key", F.concat(F.translate("a_key", "/\\", "--"), F.lit("-restored")))})
    done = plan.filter("error is null")
    fresh = done.filter("not reused")
    values = {"replica_id": F.concat(F.lit("restored-"), c("object_id").cast("string")), "object_id": c("object_id"), "generation": c("_generation"), "backend": F.lit(target), "key": c("_to"), "kind": F.lit("HOT"), "size": c("_length"), "content_hash": c("_hash"), "created_at_ms": F.lit(now_ms), "verified_at_ms": F.lit(now_ms), "valid": F.lit(True)}
    added = replicas.unionByName(fresh.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in replicas.schema]))
    more = identities.acquire(dedup, fresh.select(c("_hash").alias("content_hash"), F.lit(target).alias("backend"), c("_to").alias("storage_key"), c("_length").cast("bigint").alias("payload_size")))
    n = scans.valid_replica_counts(added).select(c("object_id").alias("id"), c("n").alias("_n"))
    change = done.select(c("object_id").alias("id"), F.coalesce(c("_hot.size"), c("_length")).cast("bigint").alias("_bytes"))
    hit = objects.join(change, "id", "left").join(n, "id", "left")
    now_warm = c("_bytes").isNotNull()
    fields = {"lifecycle_state": F.when(now_warm, "WARM").otherwise(c("lifecycle_state")), "physical_size": F.coalesce("_bytes", "physical_size"), "compressed_size": F.when(~now_warm, c("compressed_size")), "replication_count": F.when(now_warm, F.coalesce("_n", F.lit(0))).otherwise(c("replication_count"))}
    log = entries(done, "OBJECT_RESTORED", actor, now_ms, object_id=c("object_id"), generation=c("_generation"), prior_state=F.lit("ARCHIVED"), new_state=F.lit("WARM"), detail=F.to_json(F.struct(c("_to").alias("key"), c("reused").alias("reused_existing"))))
    return Swapped(plan.select("object_id", "error", "reused"), hit.withColumns({k: v.cast(objects.schema[k].dataType) for k, v in fields.items()}).select(*objects.columns), added, more, log)


# --- recovery (T-12, T-13) --------------------------------------------------------------------------


def scheduled_of(journal: DataFrame, field: str = "replica_deletions") -> DataFrame:
    """attempt_id and the columns of what a journal's payload schedules, a row each."""
    return journal.select("attempt_id", F.inline(F.col(f"payload.{field}")))


class Committed(NamedTuple):
    outcome: DataFrame
    objects: DataFrame
    replicas: DataFrame
    archives: DataFrame
    dedup: DataFrame
    audit: DataFrame


def committed(journal: DataFrame, replica_deletions: DataFrame, archive_deletions: DataFrame, objects: DataFrame, replicas: DataFrame, archives: DataFrame, dedup: DataFrame, now_ms: int) -> Committed:
    """The tables after operations whose payloads were found gone are committed (T-13).

    ``outcome`` has (attempt_id, error): a journal whose object is missing or of
    another generation, or whose scheduled rows differ from those stored, stays
    open and changes nothing.  Scheduled rows that are gone already are no
    error.  References that were released before aren't released twice.
    """
    c = F.col
    own = objects.select(c("id").alias("object_id"), c("generation").alias("_generation"))

    def differing(scheduled: DataFrame, stored: DataFrame, key: str) -> DataFrame:
        names = [n for n in DESCRIPTOR if n in scheduled.columns]
        now = stored.select(key, F.struct(*names).alias("_now"))
        return scheduled.join(now, key).filter(F.struct(*names) != c("_now")).select("attempt_id").distinct()

    bad_replicas = differing(replica_deletions, replicas, "replica_id").withColumn("_r", F.lit(True))
    bad_archives = differing(archive_deletions, archives, "archive_id").withColumn("_a", F.lit(True))
    error = F.when(c("_generation").isNull(), "OBJECT_MISSING").when(c("_generation") != c("generation"), "GENERATION_MISMATCH").when(c("_r"), "REPLICA_MISMATCH").when(c("_a"), "ARCHIVE_MISMATCH")
    judged = journal.join(own, "object_id", "left").join(bad_replicas, "attempt_id", "left").join(bad_archives, "attempt_id", "left").withColumn("error", error)
    done = judged.filter("error is null").select("attempt_id", "object_id", "phase")
    dropped = replica_deletions.join(done.select("attempt_id"), "attempt_id", "left_semi")
    there = replicas.join(dropped.select("replica_id"), "replica_id", "left_semi")
    held = there.join(dedup.select("content_hash", "backend"), ["content_hash", "backend"], "left_semi")
    refs = identities.release(dedup, held).filter("not last").drop("last")
    hit = objects.join(done.select(c("object_id").alias("id"), "attempt_id", "phase"), "id", "left")
    changes = c("attempt_id").isNotNull() & ((c("lifecycle_state") != "RECLAIMED") | (c("replication_count") != 0) | (c("physical_size") != 0) | c("compressed_size").isNotNull())
    zero = lambda n: F.when(c("attempt_id").isNotNull(), F.lit(0).cast(objects.schema[n].dataType)).otherwise(c(n))
    after = hit.withColumns({"lifecycle_state": F.when(c("attempt_id").isNotNull(), "RECLAIMED").otherwise(c("lifecycle_state")), "replication_count": zero("replication_count"), "physical_size": zero("physical_size"), "compressed_size": F.when(c("attempt_id").isNull(), c("compressed_size"))}).select(*objects.columns)
    log = entries(hit.filter(changes), "RECOVERY_COMMIT", "recovery", now_ms, object_id=c("id"), generation=c("generation"), prior_state=c("lifecycle_state"), new_state=F.lit("RECLAIMED"), attempt_id=c("attempt_id"), detail=F.to_json(F.struct("phase")))
    kept = archives.join(archive_deletions.join(done.select("attempt_id"), "attempt_id", "left_semi").select("archive_id"), "archive_id", "left_anti").select(*archives.columns)
    return Committed(judged.select("attempt_id", "error"), after, replicas.join(dropped.select("replica_id"), "replica_id", "left_anti").select(*replicas.columns), kept, refs, log)


def report(outcomes: DataFrame, expired: DataFrame, repairs: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(step, item, result, n) of a reconciliation, in the order of its steps (T-12).

    Journals by outcome, expired reservations by what became of their objects,
    repairs of identities by action, and whether the graph has a cycle.
    """
    count = F.count(F.lit(1)).alias("n")
    one = outcomes.filter("outcome <> 'CLOSED'").groupBy(F.col("outcome").alias("result")).agg(count).select(F.lit(1).alias("step"), F.lit("journal").alias("item"), "result", "n")
    two = expired.groupBy(F.coalesce("object_state", F.lit("MISSING")).alias("result")).agg(count).select(F.lit(2).alias("step"), F.lit("reservation").alias("item"), "result", "n")
    three = repairs.filter("action <> 'KEPT'").groupBy(F.col("action").alias("result")).agg(count).select(F.lit(3).alias("step"), F.lit("identity").alias("item"), "result", "n")
    four = cyclic.agg(count).select(F.lit(4).alias("step"), F.lit("lineage").alias("item"), F.when(F.col("n") == 0, "OK").otherwise("CYCLE").alias("result"), "n")
    return one.unionByName(two).unionByName(three).unionByName(four).orderBy("step", "result")


def settled(outcomes: DataFrame, attempts: DataFrame, reservations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, reservations) after journals (attempt_id, outcome) were committed or rolled back; others stay as they are (T-12)."""
    known = outcomes.filter("outcome in ('COMMITTED', 'ROLLED_BACK')").select("attempt_id", F.col("outcome").alias("_to"))
    open_ = F.col("_to").isNotNull() & (F.col("status") == "OPEN")
    released = F.when(F.col("_to") == "COMMITTED", "COMMITTED").otherwise("RELEASED")
    state = lambda df, to: df.join(known, "attempt_id", "left").withColumn("status", F.when(open_, to).otherwise(F.col("status"))).select(*df.columns)
    return state(attempts, F.col("_to")), state(reservations, released)


# --- registering, flags, decisions, edges (T-01, T-02, T-04, T-05, T-18) ------------------------------


def registered_rows(accepted: DataFrame, now_ms: int, actor: str = "operator") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replicas, references, audit) of the rows of ``reclaim.registered`` without an error, which have id, content_hash, payload_size and distinct targets (T-01).

    Each target gets a replica; ``references`` (content_hash, backend,
    storage_key, payload_size) go to ``dedup.acquire``.  An object with a
    payload is logged twice: created, then promoted.
    """
    c = F.col
    good = accepted.filter("error is null")
    each = good.filter("payload_size is not null").select(c("id").alias("object_id"), "content_hash", "payload_size", F.posexplode("targets").alias("i", "backend"))
    replicas = each.select(F.concat(c("object_id").cast("string"), F.lit("-r"), c("i").cast("string")).alias("replica_id"), "object_id", F.lit(1).cast("bigint").alias("generation"), "backend", identities.dedup_key(c("content_hash"), c("i")).alias("key"), F.lit("HOT").alias("kind"), c("payload_size").alias("size"), "content_hash", F.lit(now_ms).cast("bigint").alias("created_at_ms"), F.lit(True).alias("valid"))
    references = replicas.select("content_hash", "backend", c("key").alias("storage_key"), c("size").alias("payload_size"))
    made = entries(good, "OBJECT_CREATED", actor, now_ms, object_id=c("id"), generation=F.lit(1).cast("bigint"), new_state=F.lit("CREATED"))
    hot = entries(good.filter("payload_size is not null"), "OBJECT_PROMOTED_HOT", actor, now_ms, object_id=c("id"), generation=F.lit(1).cast("bigint"), prior_state=F.lit("CREATED"), new_state=F.lit("HOT"))
    return replicas, references, made.unionByName(hot)


def flagged(objects: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, refused) after PIN, UNPIN, PROTECT and UNPROTECT events (object_id, ts_ms, id, action), the last of each flag deciding (T-02).

    A reclaimed object can't be pinned: those events are refused; the other
    three are not.
    """
    dead = objects.filter("lifecycle_state = 'RECLAIMED'").select(F.col("id").alias("object_id"))
    pins = events.filter("action = 'PIN'")
    refused = pins.join(dead, "object_id", "left_semi").select(F.col("id").alias("event_id"), "object_id")
    allowed = events.filter("action in ('UNPIN', 'PROTECT', 'UNPROTECT')").unionByName(pins.join(dead, "object_id", "left_anti").select(*events.columns))
    when = F.struct("ts_ms", "id")
    last = lambda *names: F.max_by(F.when(F.col("action").isin(*names), F.col("action")), F.when(F.col("action").isin(*names), when))
    flags = allowed.groupBy(F.col("object_id").alias("id")).agg((last("PIN", "UNPIN") == "PIN").alias("_pinned"), (last("PROTECT", "UNPROTECT") == "PROTECT").alias("_protected"))
    return objects.join(flags, "id", "left").withColumns({"pinned": F.coalesce("_pinned", "pinned"), "protected": F.coalesce("_protected", "protected")}).select(*objects.columns), refused


def decided(plan: DataFrame, now_ms: int, actor: str = "operator") -> tuple[DataFrame, DataFrame]:
    """(decisions, audit) of planned objects, whatever their state (T-05)."""
    rows = plan.select(F.col("id").alias("object_id"), "generation", "verdict", "score", "threshold", "policy_id", "policy_version", "epoch", F.lit(now_ms).cast("bigint").alias("created_at_ms"), "components", "reasons")
    log = entries(plan, "DECISION", actor, now_ms, object_id=F.col("id"), generation=F.col("generation"), prior_state=F.col("lifecycle_state"), policy=F.col("policy_id"), detail=F.to_json(F.struct("verdict", "score", "threshold")))
    return rows, log


def edge_entries(edges: DataFrame, added: bool, now_ms: int, actor: str = "operator") -> DataFrame:
    """Log entries of edges that were added or removed (T-04)."""
    verb = F.concat(F.lit("LINEAGE_ADD_" if added else "LINEAGE_REMOVE_"), F.col("kind"))
    return entries(edges, verb, actor, now_ms, object_id=F.col("parent_id"), detail=F.to_json(F.struct(F.col("parent_id").cast("string").alias("parent"), F.col("child_id").cast("string").alias("child"))))


def deleted(requests: DataFrame, objects: DataFrame, replicas: DataFrame, edges: DataFrame, archives: DataFrame) -> DataFrame:
    """``requests`` (id, generation) to delete objects, with error: NOT_FOUND, GENERATION_MISMATCH, REFERENCED, or null for those that go (T-18)."""
    refs = scans.references_to(objects, replicas, edges, archives)
    own = objects.select("id", F.col("generation").alias("_generation")).join(refs, "id")
    error = F.when(F.col("_generation").isNull(), "NOT_FOUND").when(~F.col("generation").eqNullSafe(F.col("_generation")), "GENERATION_MISMATCH").when(F.col("dependents") > 0, "REFERENCED")
    return requests.join(own, "id", "left").select("id", "generation", error.alias("error"))


# --- row checks (W-01, W-03, W-12, W-15) --------------------------------------------------------------


def audit_agrees(rows: DataFrame) -> DataFrame:
    """``rows`` (id, generation, lifecycle_state and the entry's object_id, entry_generation, new_state) with ok: the entry names the object, its generation and its state (W-01)."""
    same = F.col("object_id").eqNullSafe(F.col("id")) & F.col("entry_generation").eqNullSafe(F.col("generation")) & F.col("new_state").eqNullSafe(F.col("lifecycle_state"))
    return rows.withColumn("ok", same)


def replica_updates(changes: DataFrame, replicas: DataFrame, objects: DataFrame) -> DataFrame:
    """``changes`` (rows of replicas) with error: NOT_FOUND, UNKNOWN_OBJECT, GENERATION_MISMATCH, RECLAIMED_OBJECT or null (W-03)."""
    own = objects.select(F.col("id").alias("object_id"), F.col("generation").alias("_generation"), "lifecycle_state")
    there = replicas.select("replica_id", F.lit(True).alias("_there"))
    error = (
        F.when(F.col("_there").isNull(), "NOT_FOUND")
        .when(F.col("_generation").isNull(), "UNKNOWN_OBJECT")
        .when(F.col("_generation") != F.col("generation"), "GENERATION_MISMATCH")
        .when(F.col("lifecycle_state") == "RECLAIMED", "RECLAIMED_OBJECT")
    )
    return changes.join(there, "replica_id", "left").join(own, "object_id", "left").select(*changes.columns, error.alias("error"))


def policy_conflicts(policies: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name) of what forbids adding ``new`` to ``policies``: a full id twice, a policy that isn't valid, selectors that become ambiguous (W-12, T-17)."""
    both = policies.unionByName(new)
    twice = both.groupBy(policy.full_id().alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("DUPLICATE_ID").alias("kind"), "name")
    broken = new.filter(F.size(policy.policy_problems()) > 0).select(F.lit("INVALID_POLICY").alias("kind"), policy.full_id().alias("name"))
    unclear = policy.ambiguous_selectors(both).select(F.lit("AMBIGUOUS").alias("kind"), F.coalesce("selector_key", F.lit("")).alias("name"))
    return twice.unionByName(broken).unionByName(unclear)


def unknown_reports(reports: DataFrame, known: DataFrame) -> DataFrame:
    """Reports (node_id) of nodes that aren't registered (W-15)."""
    return reports.join(known.select("node_id"), "node_id", "left_anti")


def register_nodes(requests: DataFrame, current: DataFrame, now_ms: int, timeout_ms: int = NODE_TIMEOUT_MS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, retired, outcome) after registrations (name, process_id, boot_id, addr, backends), one for each name (R-01).

    Nodes not seen for ``timeout_ms`` are retired first, so their names are free
    again.  A registration whose name or process has blanks around it or is
    empty, whose backends aren't named 'name/...', are empty or repeated, or
    whose name a live node of another identity has, is refused.  A node's id is
    name@process@boot; registering again renews it.
    """
    c = F.col
    retired = current.filter(F.lit(now_ms) - c("last_seen_ms") > timeout_ms)
    live = current.join(retired.select("node_id"), "node_id", "left_anti")
    plain = lambda n: (F.trim(n) != "") & (F.trim(n) == c(n))
    named = F.forall("backends", lambda b: b.startswith(F.concat(c("name"), F.lit("/"))) & (F.length(b) > F.length("name") + 1))
    ids = requests.withColumn("node_id", F.concat_ws("@", "name", "process_id", "boot_id"))
    taken = live.select("name", c("node_id").alias("_other"))
    error = F.when(~(plain("name") & plain("process_id") & plain("addr")), "INVALID_ARGUMENT").when(~named | (F.size(F.array_distinct("backends")) != F.size("backends")), "INVALID_BACKENDS").when(c("_other").isNotNull() & (c("_other") != c("node_id")), "NAME_IN_USE")
    judged = ids.join(taken, "name", "left").withColumn("error", error)
    fresh = judged.filter("error is null").select("node_id", "name", "process_id", "boot_id", "addr", "backends", F.lit(now_ms).cast("bigint").alias("last_seen_ms"))
    after = live.join(fresh.select("node_id"), "node_id", "left_anti").select(*fresh.columns).unionByName(fresh)
    return after, retired.select("node_id"), judged.select("node_id", "error")


def provider_ids(current: DataFrame) -> DataFrame:
    """Nodes in order of their ids (K-08)."""
    return nodes.latest(current).orderBy("node_id") if "ts_ms" in current.columns else current.orderBy("node_id")
