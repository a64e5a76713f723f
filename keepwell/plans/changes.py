"""Registered queries of what operations change, and of the operators that take rows of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import codec, pressure
from keepwell.operators import audit, dedup, lineage, nodes, policy, reclaim, recovery, scans
from keepwell.operators import transactions as tx
from keepwell.plans.queries import HEARTBEAT_NOW, NOW, _simulation_sql, plan_sql, planned, policies_of, query
from keepwell.schemas import METRICS

# --- reclaiming (T-06, T-07) ------------------------------------------------------------------------


def reclaimed(d):
    simulated = reclaim.simulate(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), d.reservations, "CRITICAL", NOW)
    return tx.reclaimed(simulated, d.objects, d.replicas, d.archives, d.replica_dedup, NOW)


_GONE = _simulation_sql("CRITICAL", False) + ", gone AS (SELECT id FROM simulated WHERE error IS NULL AND verdict = 'RECLAIM') "
_DROPPED = _GONE + ", dropped AS (SELECT content_hash, backend, key, count(*) AS n_scheduled FROM replicas WHERE object_id IN (SELECT id FROM gone) GROUP BY content_hash, backend, key) "


@query("reclaim_left_replicas", _GONE + "SELECT replica_id, object_id FROM replicas WHERE object_id NOT IN (SELECT id FROM gone)")
def reclaim_left_replicas(d):
    return reclaimed(d).replicas.select("replica_id", "object_id")


@query("reclaim_left_archives", _GONE + "SELECT archive_id FROM archives WHERE object_id NOT IN (SELECT id FROM gone) OR NOT valid")
def reclaim_left_archives(d):
    return reclaimed(d).archives.select("archive_id")


@query("reclaim_payloads", _DROPPED + "SELECT s.content_hash, s.backend, s.key, n_scheduled, n_scheduled = ref_count AS deletable FROM dropped s JOIN replica_dedup e ON e.content_hash = s.content_hash AND e.backend = s.backend")
def reclaim_payloads(d):
    return reclaimed(d).payloads.select("content_hash", "backend", "key", "n_scheduled", "deletable")


@query("reclaim_left_identities", _DROPPED + "SELECT e.content_hash, e.backend, ref_count - coalesce(n_scheduled, 0) AS ref_count FROM replica_dedup e LEFT JOIN dropped s ON e.content_hash = s.content_hash AND e.backend = s.backend WHERE ref_count > coalesce(n_scheduled, 0)")
def reclaim_left_identities(d):
    return reclaimed(d).dedup.select("content_hash", "backend", "ref_count")


@query("reclaim_audit", _GONE + "SELECT id AS object_id, generation, 'RECLAIM_COMMITTED' AS action, 'RECLAIM_PENDING' AS prior_state, 'RECLAIMED' AS new_state FROM objects WHERE id IN (SELECT id FROM gone)")
def reclaim_audit(d):
    return reclaimed(d).audit.select("object_id", "generation", "action", "prior_state", "new_state")


def called_off(d):
    pending = d.objects.filter("id % 7 = 3")
    prior = pending.withColumn("attempt_id", F.col("id"))
    now = d.objects.withColumn("lifecycle_state", F.when(F.col("id") % 7 == 3, "RECLAIM_PENDING").otherwise(F.col("lifecycle_state")))
    return tx.aborted(pending.select(F.col("id").alias("attempt_id"), F.lit("survivability").alias("reason")), prior, now, d.attempts, d.reservations, d.journal, NOW)


@query("abort_objects", "SELECT id, lifecycle_state FROM objects")
def abort_objects(d):
    return called_off(d).objects.select("id", "lifecycle_state")


@query(
    "abort_rows",
    """SELECT a.attempt_id, CASE WHEN a.attempt_id % 7 = 3 AND a.status = 'OPEN' THEN 'ROLLED_BACK' ELSE a.status END AS attempt, CASE WHEN a.attempt_id % 7 = 3 AND r.status = 'OPEN' THEN 'RELEASED' ELSE r.status END AS reservation,
      CASE WHEN a.attempt_id % 7 = 3 AND phase NOT IN ('COMMITTED', 'ROLLED_BACK', 'FAILED') THEN 'ROLLED_BACK' ELSE phase END AS phase FROM attempts a JOIN reservations r ON r.attempt_id = a.attempt_id JOIN journal j ON j.attempt_id = a.attempt_id""",
)
def abort_rows(d):
    x = called_off(d)
    return x.attempts.select("attempt_id", F.col("status").alias("attempt")).join(x.reservations.select("attempt_id", F.col("status").alias("reservation")), "attempt_id").join(x.journal.select("attempt_id", "phase"), "attempt_id")


@query("abort_audit", "SELECT id AS object_id, 'RECLAIM_ABORTED' AS action, lifecycle_state AS new_state, concat('{\"reason\":\"survivability\"}', '') AS detail FROM objects WHERE id % 7 = 3")
def abort_audit(d):
    return called_off(d).audit.select("object_id", "action", "new_state", "detail")


@query("indeterminate_failures", "SELECT attempt_id, object_id, 'RECLAIM_VERIFY_FAILED' AS kind, 'payload still exists' AS message, false AS recovered FROM journal WHERE phase = 'PHYSICAL_STARTED'")
def indeterminate_failures(d):
    reports = d.journal.filter("phase = 'PHYSICAL_STARTED'").select("attempt_id", "object_id", F.lit("RECLAIM_VERIFY_FAILED").alias("kind"), F.lit("payload still exists").alias("reason"))
    return tx.indeterminate(reports, NOW).select("attempt_id", "object_id", "kind", "message", "recovered")


# --- compressing and restoring (T-08..T-10) ---------------------------------------------------------

_PACKED = "SELECT id AS object_id, 'zstd' AS codec, logical_size AS original_size, CAST(floor(logical_size / 2e0) AS BIGINT) AS size, concat('z', CAST(id AS STRING)) AS content_hash FROM objects WHERE id % 3 = 0"
_FIRST = "SELECT object_id, min(replica_id) AS replica_id FROM replicas WHERE valid AND kind <> 'ARCHIVED' GROUP BY object_id"
_COMPRESS = f"""WITH packed AS ({_PACKED}), judged AS (SELECT p.*, f.replica_id, r.backend, r.key, r.content_hash AS old_hash,
  CASE WHEN o.lifecycle_state NOT IN ('HOT', 'WARM', 'COLD', 'COMPRESSED') THEN 'INVALID_TRANSITION' WHEN f.replica_id IS NULL THEN 'NO_LIVE_PAYLOAD' END AS error
  FROM packed p JOIN objects o ON o.id = p.object_id LEFT JOIN ({_FIRST}) f ON f.object_id = p.object_id LEFT JOIN replicas r ON r.replica_id = f.replica_id) """


def compressed(d):
    return tx.compressed(d.sql(_PACKED), d.objects, d.replicas, d.replica_dedup, NOW)


@query("compress_outcome", _COMPRESS + "SELECT object_id, error FROM judged")
def compress_outcome(d):
    return compressed(d).outcome


@query("compress_objects", _COMPRESS + "SELECT o.id, CASE WHEN j.size IS NOT NULL THEN 'COMPRESSED' ELSE lifecycle_state END AS lifecycle_state, coalesce(j.size, physical_size) AS physical_size, coalesce(j.size, compressed_size) AS compressed_size FROM objects o LEFT JOIN (SELECT * FROM judged WHERE error IS NULL) j ON j.object_id = o.id")
def compress_objects(d):
    return compressed(d).objects.select("id", "lifecycle_state", "physical_size", "compressed_size")


@query("compress_replicas", _COMPRESS + "SELECT CASE WHEN j.size IS NULL THEN r.replica_id ELSE concat(r.replica_id, '-zstd') END AS replica_id, coalesce(j.size, r.size) AS size, coalesce(j.content_hash, r.content_hash) AS content_hash, CASE WHEN j.size IS NULL THEN r.key ELSE concat(r.key, '-zstd') END AS key FROM replicas r LEFT JOIN (SELECT * FROM judged WHERE error IS NULL) j ON j.replica_id = r.replica_id")
def compress_replicas(d):
    return compressed(d).replicas.select("replica_id", "size", "content_hash", "key")


@query("compress_identities", _COMPRESS + """, lost AS (SELECT old_hash, backend, count(*) AS n FROM judged WHERE error IS NULL GROUP BY old_hash, backend)
  SELECT e.content_hash, e.backend, ref_count - coalesce(n, 0) AS ref_count FROM replica_dedup e LEFT JOIN lost ON old_hash = e.content_hash AND lost.backend = e.backend WHERE ref_count > coalesce(n, 0)
  UNION ALL SELECT content_hash, backend, 1 FROM judged WHERE error IS NULL""")
def compress_identities(d):
    return compressed(d).dedup.select("content_hash", "backend", "ref_count")


def restored(d):
    return tx.restored(d.cold_objects, d.cold_archives, d.payload_replicas, d.payload_dedup, d.cold_payloads, "memory", NOW)


_RESTORE = """WITH texts AS (SELECT doc_id, {sha}(text) AS h, octet_length(encode(text)) AS n FROM documents), judged AS (SELECT o.id AS object_id, t.h, t.n,
  CASE WHEN o.lifecycle_state <> 'ARCHIVED' THEN 'NOT_ARCHIVED' WHEN a.archive_id IS NULL THEN 'NO_ARCHIVE' WHEN p.key IS NULL THEN 'ARCHIVE_FAILURE' WHEN a.content_hash <> t.h OR o.content_hash <> t.h THEN 'INTEGRITY_FAILURE' END AS error,
  EXISTS (SELECT 1 FROM payload_replicas r WHERE r.object_id = o.id AND r.valid AND r.content_hash = t.h) AND a.archive_id IS NOT NULL AND p.key IS NOT NULL AS reused
  FROM cold_objects o LEFT JOIN cold_archives a ON a.object_id = o.id LEFT JOIN cold_payloads p ON p.key = a.key JOIN texts t ON t.doc_id = o.id) """.replace("{sha}", "sha256")


@query("restore_outcome", _RESTORE + "SELECT object_id, error, reused FROM judged")
def restore_outcome(d):
    return restored(d).outcome


@query("restore_replicas", _RESTORE + "SELECT concat('restored-', object_id) AS replica_id, h AS content_hash, concat('dedup-', h) AS key FROM judged WHERE error IS NULL AND NOT reused AND h IN (SELECT content_hash FROM payload_dedup WHERE backend = 'memory') UNION ALL SELECT concat('restored-', object_id), h, concat(object_id, '-1-gen1-restored') FROM judged WHERE error IS NULL AND NOT reused AND h NOT IN (SELECT content_hash FROM payload_dedup WHERE backend = 'memory')")
def restore_replicas(d):
    return restored(d).replicas.filter("replica_id like 'restored-%'").select("replica_id", "content_hash", "key")


@query("restore_objects", _RESTORE + "SELECT o.id, CASE WHEN j.error IS NULL THEN 'WARM' ELSE lifecycle_state END AS lifecycle_state FROM cold_objects o JOIN judged j ON j.object_id = o.id")
def restore_objects(d):
    return restored(d).objects.select("id", "lifecycle_state")


@query("archive_rows", f"""SELECT concat('archive-', f.object_id) AS archive_id, f.object_id, concat(f.object_id, '/', o.generation, '/gen', r.generation) AS key, r.content_hash FROM ({_FIRST}) f JOIN objects o ON o.id = f.object_id JOIN replicas r ON r.replica_id = f.replica_id
  WHERE o.lifecycle_state <> 'ARCHIVED' AND f.object_id NOT IN (SELECT object_id FROM archives WHERE valid)""")
def archive_rows(d):
    return reclaim.archived(d.objects, d.replicas, d.archives, "archive", NOW).select("archive_id", "object_id", "key", "content_hash")


# --- recovery (T-12..T-14) --------------------------------------------------------------------------

_CRASH = """WITH judged AS (SELECT j.attempt_id, j.object_id, CASE WHEN o.id IS NULL THEN 'OBJECT_MISSING' WHEN o.generation <> j.generation THEN 'GENERATION_MISMATCH'
  WHEN EXISTS (SELECT 1 FROM crash_scheduled s JOIN crash_replicas r ON r.replica_id = s.replica_id WHERE s.attempt_id = j.attempt_id AND r.content_hash <> s.content_hash) THEN 'REPLICA_MISMATCH' END AS error
  FROM crash_journal j LEFT JOIN crash_objects o ON o.id = j.object_id), done AS (SELECT * FROM judged WHERE error IS NULL) """


def committed(d):
    archives = d.crash_archives.filter("object_id % 5 = 0").withColumn("attempt_id", F.col("object_id"))
    return tx.committed(d.crash_journal, d.crash_scheduled, archives, d.crash_objects, d.crash_replicas, d.crash_archives, d.payload_dedup, NOW)


@query("crash_outcome", _CRASH + "SELECT attempt_id, error FROM judged")
def crash_outcome(d):
    return committed(d).outcome


@query("crash_left_replicas", _CRASH + "SELECT replica_id FROM crash_replicas WHERE replica_id NOT IN (SELECT replica_id FROM crash_scheduled WHERE attempt_id IN (SELECT attempt_id FROM done))")
def crash_left_replicas(d):
    return committed(d).replicas.select("replica_id")


@query("crash_objects", _CRASH + "SELECT id, CASE WHEN id IN (SELECT object_id FROM done) THEN 'RECLAIMED' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN id IN (SELECT object_id FROM done) THEN 0 ELSE physical_size END AS physical_size FROM crash_objects")
def crash_objects(d):
    return committed(d).objects.select("id", "lifecycle_state", "physical_size")


@query("crash_left_archives", _CRASH + "SELECT archive_id FROM crash_archives WHERE object_id NOT IN (SELECT object_id FROM done)")
def crash_left_archives(d):
    return committed(d).archives.select("archive_id")


@query("crash_left_identities", _CRASH + """, lost AS (SELECT r.content_hash, r.backend, count(*) AS n FROM crash_replicas r WHERE replica_id IN (SELECT replica_id FROM crash_scheduled WHERE attempt_id IN (SELECT attempt_id FROM done)) GROUP BY 1, 2)
  SELECT e.content_hash, e.backend, ref_count - coalesce(n, 0) AS ref_count FROM payload_dedup e LEFT JOIN lost ON lost.content_hash = e.content_hash AND lost.backend = e.backend WHERE ref_count > coalesce(n, 0)""")
def crash_left_identities(d):
    return committed(d).dedup.select("content_hash", "backend", "ref_count")


@query("crash_audit", _CRASH + "SELECT id AS object_id, 'RECOVERY_COMMIT' AS action, lifecycle_state AS prior_state FROM crash_objects WHERE id IN (SELECT object_id FROM done) AND lifecycle_state <> 'RECLAIMED'")
def crash_audit(d):
    return committed(d).audit.select("object_id", "action", "prior_state")


def nested_journal(d):
    """Journals whose payload is nested, with a physical plan of every second scheduled replica."""
    rows = d.crash_scheduled.withColumn("r", F.struct("replica_id", "object_id", "generation", "backend", "key", "content_hash"))
    lists = rows.groupBy("attempt_id").agg(F.sort_array(F.collect_list("r")).alias("all"))
    phase = F.when(F.col("attempt_id") % 3 == 0, "RESERVED").when(F.col("attempt_id") % 3 == 1, "PHYSICAL_STARTED").otherwise("PHYSICAL_DONE")
    plan = F.when(F.col("attempt_id") % 2 == 0, F.when(F.col("attempt_id") % 20 == 10, F.transform("all", lambda x: x.withField("key", F.lit("stray")))).otherwise(F.col("all")))
    archive = F.struct(F.lit("archive").alias("backend"), F.concat(F.col("attempt_id").cast("string"), F.lit("/1")).alias("key"))
    return lists.select("attempt_id", phase.alias("phase"), F.struct(F.col("all").alias("replica_deletions"), plan.alias("physical_replica_deletions"), F.when(F.col("attempt_id") % 4 == 0, F.array(archive)).otherwise(F.array().cast("array<struct<backend:string,key:string>>")).alias("archive_deletions")).alias("payload"))


_NESTED = "SELECT attempt_id, CASE attempt_id % 3 WHEN 0 THEN 'RESERVED' WHEN 1 THEN 'PHYSICAL_STARTED' ELSE 'PHYSICAL_DONE' END AS phase, attempt_id % 2 = 0 AS planned, attempt_id % 20 = 10 AS stray, attempt_id % 4 = 0 AS archived, backend, CASE WHEN attempt_id % 20 = 10 THEN 'stray' ELSE key END AS key FROM crash_scheduled"


@query("journal_payload_problems", f"SELECT attempt_id, problem FROM (SELECT attempt_id, CASE WHEN phase = 'RESERVED' AND planned THEN 'PLAN_TOO_EARLY' WHEN phase <> 'RESERVED' AND NOT planned THEN 'PLAN_MISSING' WHEN planned AND stray THEN 'PLAN_NOT_SCHEDULED' END AS problem FROM ({_NESTED})) WHERE problem IS NOT NULL")
def journal_payload_problems(d):
    return recovery.payload_problems(nested_journal(d))


@query("journal_scheduled", "SELECT attempt_id, replica_id, key FROM crash_scheduled")
def journal_scheduled(d):
    return tx.scheduled_of(nested_journal(d)).select("attempt_id", "replica_id", "key")


@query(
    "journal_facts",
    f"""WITH j AS ({_NESTED}), held AS (SELECT DISTINCT backend, key, object_id % 3 <> 0 AS there FROM crash_replicas WHERE object_id % 10 = 0) SELECT attempt_id, phase, CASE WHEN planned THEN 1 END AS n_plan, CASE WHEN archived THEN 1 ELSE 0 END AS n_archives,
      CASE WHEN phase = 'RESERVED' THEN CASE WHEN planned THEN 'ERROR' ELSE 'ROLLED_BACK' END WHEN NOT planned THEN 'ERROR' WHEN archived THEN 'ERROR' WHEN stray THEN 'ERROR' ELSE 'COMMITTED' END AS outcome FROM j""",
)
def journal_facts(d):
    """What is known of plain keys is that they are gone; archives and stray keys don't answer."""
    nested = nested_journal(d)
    present = d.crash_scheduled.select("backend", "key").distinct().withColumn("exists", F.lit(False))
    found = recovery.facts(nested, present)
    return found.select("attempt_id", "phase", F.col("n_plan").cast("int").alias("n_plan"), F.col("n_archives").cast("int").alias("n_archives"), recovery.outcome().alias("outcome"))


@query(
    "recovery_report",
    """WITH outcomes AS (SELECT CASE WHEN phase IN ('COMMITTED', 'ROLLED_BACK', 'FAILED') THEN 'CLOSED' WHEN phase IN ('RESERVED', 'VALIDATED') THEN CASE WHEN n_plan IS NULL THEN 'ROLLED_BACK' ELSE 'ERROR' END WHEN n_plan IS NULL THEN 'ERROR'
      WHEN n_plan + n_archives = 0 THEN CASE phase WHEN 'PHYSICAL_DONE' THEN 'COMMITTED' ELSE 'ROLLED_BACK' END WHEN unavailable THEN 'ERROR' WHEN n_present = n_plan + n_archives THEN 'ROLLED_BACK' WHEN n_present = 0 THEN 'COMMITTED' ELSE 'ERROR' END AS outcome FROM journal)
    SELECT 1 AS step, 'journal' AS item, outcome AS result, count(*) AS n FROM outcomes WHERE outcome <> 'CLOSED' GROUP BY outcome
    UNION ALL SELECT 2, 'reservation', CASE WHEN lifecycle_state = 'RECLAIM_PENDING' THEN 'FAILED' ELSE coalesce(lifecycle_state, 'MISSING') END, count(*) FROM reservations r LEFT JOIN objects o ON o.id = r.object_id
      WHERE status = 'OPEN' AND expires_at_ms <= 1200000 AND r.attempt_id NOT IN (SELECT attempt_id FROM journal WHERE phase NOT IN ('COMMITTED', 'ROLLED_BACK', 'FAILED')) GROUP BY 3
    UNION ALL SELECT 3, 'identity', action, count(*) FROM (SELECT CASE WHEN l.ref_count IS NULL THEN 'REMOVED' WHEN d.ref_count IS NULL THEN 'RECREATED' WHEN l.ref_count <> d.ref_count OR l.storage_key <> d.storage_key OR l.payload_size <> d.payload_size THEN 'REPAIRED' END AS action
      FROM dedup d FULL JOIN (SELECT content_hash, backend, count(*) AS ref_count, min(key) AS storage_key, min(size) AS payload_size FROM payload_replicas WHERE valid GROUP BY content_hash, backend) l ON d.content_hash = l.content_hash AND d.backend = l.backend) WHERE action IS NOT NULL GROUP BY action
    UNION ALL SELECT 4, 'lineage', 'OK', 0""",
)
def recovery_report(d):
    repairs = dedup.repair(d.dedup, dedup.live_identities(d.payload_replicas, d.payload_objects))
    cyclic = lineage.layers(d.lineage.filter("kind = 'SUPERSEDES'")).filter("layer is null").select("id")
    return tx.report(recovery.reconcile(d.journal), recovery.expired(d.reservations, d.journal, d.objects, NOW), repairs, cyclic)


_OUTCOME = "CASE attempt_id % 3 WHEN 0 THEN 'COMMITTED' WHEN 1 THEN 'ROLLED_BACK' ELSE 'ERROR' END"


@query("recovery_settles", f"SELECT r.attempt_id, CASE WHEN a.status = 'OPEN' AND o <> 'ERROR' THEN o ELSE a.status END AS attempt, CASE WHEN r.status = 'OPEN' THEN CASE o WHEN 'COMMITTED' THEN 'COMMITTED' WHEN 'ROLLED_BACK' THEN 'RELEASED' ELSE 'OPEN' END ELSE r.status END AS reservation FROM (SELECT *, {_OUTCOME} AS o FROM attempts) a JOIN reservations r ON r.attempt_id = a.attempt_id")
def recovery_settles(d):
    attempts, reservations = tx.settled(d.attempts.select("attempt_id", F.expr(_OUTCOME).alias("outcome")), d.attempts, d.reservations)
    return attempts.select("attempt_id", F.col("status").alias("attempt")).join(reservations.select("attempt_id", F.col("status").alias("reservation")), "attempt_id")


# --- registering, flags, decisions, edges -----------------------------------------------------------


def accepted(d):
    hashed = d.payload_objects.withColumns({"payload_size": F.when(F.col("id") % 4 != 0, F.lit(100).cast("bigint")), "targets": F.array(F.lit("memory"), F.lit("file")), "error": F.when(F.col("id") % 5 == 0, "ALREADY_EXISTS")})
    return tx.registered_rows(hashed, NOW)


@query("register_replicas", "SELECT concat(id, '-r0') AS replica_id, 'memory' AS backend, concat('dedup-', content_hash) AS key FROM payload_objects WHERE id % 4 <> 0 AND id % 5 <> 0 UNION ALL SELECT concat(id, '-r1'), 'file', concat('dedup-', content_hash, '-r1') FROM payload_objects WHERE id % 4 <> 0 AND id % 5 <> 0")
def register_replicas(d):
    return accepted(d)[0].select("replica_id", "backend", "key")


@query("register_audit", "SELECT id AS object_id, 'OBJECT_CREATED' AS action, 'CREATED' AS new_state FROM payload_objects WHERE id % 5 <> 0 UNION ALL SELECT id, 'OBJECT_PROMOTED_HOT', 'HOT' FROM payload_objects WHERE id % 5 <> 0 AND id % 4 <> 0")
def register_audit(d):
    return accepted(d)[2].select("object_id", "action", "new_state")


_FLAG = "CASE action WHEN 'CLICK' THEN 'PIN' WHEN 'VIEW' THEN 'UNPIN' WHEN 'PURCHASE' THEN 'PROTECT' WHEN 'ERROR' THEN 'UNPROTECT' END"
_FLAGS = f"WITH e AS (SELECT a.object_id, a.id, a.ts_ms, {_FLAG} AS action FROM audit a JOIN objects o ON o.id = a.object_id WHERE {_FLAG} IS NOT NULL AND NOT (lifecycle_state = 'RECLAIMED' AND action = 'CLICK')), p AS (SELECT *, row_number() OVER (PARTITION BY object_id, action IN ('PIN', 'UNPIN') ORDER BY ts_ms DESC, id DESC) AS rn FROM e) "


@query("flags", _FLAGS + "SELECT o.id, coalesce(a.action = 'PIN', pinned) AS pinned, coalesce(b.action = 'PROTECT', protected) AS protected FROM objects o LEFT JOIN (SELECT * FROM p WHERE rn = 1 AND action IN ('PIN', 'UNPIN')) a ON a.object_id = o.id LEFT JOIN (SELECT * FROM p WHERE rn = 1 AND action IN ('PROTECT', 'UNPROTECT')) b ON b.object_id = o.id")
def flags(d):
    return tx.flagged(d.objects, d.sql(f"SELECT object_id, id, ts_ms, {_FLAG} AS action FROM audit"))[0].select("id", "pinned", "protected")


@query("flags_refused", "SELECT a.id AS event_id, object_id FROM audit a WHERE action = 'CLICK' AND object_id IN (SELECT id FROM objects WHERE lifecycle_state = 'RECLAIMED')")
def flags_refused(d):
    return tx.flagged(d.objects, d.sql(f"SELECT object_id, id, ts_ms, {_FLAG} AS action FROM audit"))[1]


@query("decision_rows", plan_sql("HIGH") + "SELECT id AS object_id, generation, verdict, score, threshold, policy_id FROM planned")
def decision_rows(d):
    return tx.decided(planned(d, "HIGH"), NOW)[0].select("object_id", "generation", "verdict", "score", "threshold", "policy_id")


@query("decision_audit", plan_sql("HIGH") + "SELECT id AS object_id, 'DECISION' AS action, lifecycle_state AS prior_state, policy_id AS policy FROM planned")
def decision_audit(d):
    return tx.decided(planned(d, "HIGH"), NOW)[1].select("object_id", "action", "prior_state", "policy")


@query("lineage_audit", "SELECT concat('LINEAGE_ADD_', kind) AS action, parent_id AS object_id, concat('{\"parent\":\"', parent_id, '\",\"child\":\"', child_id, '\"}') AS detail FROM lineage UNION ALL SELECT concat('LINEAGE_REMOVE_', kind), parent_id, concat('{\"parent\":\"', parent_id, '\",\"child\":\"', child_id, '\"}') FROM lineage WHERE kind = 'SUPERSEDES'")
def lineage_audit(d):
    both = tx.edge_entries(d.lineage, True, NOW).unionByName(tx.edge_entries(d.lineage.filter("kind = 'SUPERSEDES'"), False, NOW))
    return both.select("action", "object_id", "detail")


@query("delete_requests", """SELECT id, CASE WHEN id < 0 THEN 'NOT_FOUND' WHEN id % 4 = 0 THEN 'GENERATION_MISMATCH' WHEN id IN (SELECT object_id FROM replicas) OR id IN (SELECT object_id FROM archives) OR id IN (SELECT parent_id FROM lineage WHERE kind = 'SUPERSEDES') OR id IN (SELECT child_id FROM lineage WHERE kind = 'SUPERSEDES') THEN 'REFERENCED' END AS error
  FROM (SELECT CASE WHEN id % 9 = 0 THEN -id - 1 ELSE id END AS id FROM objects)""")
def delete_requests(d):
    requests = d.objects.select(F.when(F.col("id") % 9 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), (F.col("generation") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("generation"))
    return tx.deleted(requests, d.objects, d.replicas, d.lineage.filter("kind = 'SUPERSEDES'"), d.archives).select("id", "error")


# --- rows and checks --------------------------------------------------------------------------------


@query("audit_agreement", "SELECT id, id % 3 <> 0 AND id % 5 <> 0 AS ok FROM objects")
def audit_agreement(d):
    c = F.col
    rows = d.objects.select("id", "generation", "lifecycle_state", c("id").alias("object_id"), (c("generation") + F.when(c("id") % 3 == 0, 1).otherwise(0)).alias("entry_generation"), F.when(c("id") % 5 != 0, c("lifecycle_state")).alias("new_state"))
    return tx.audit_agrees(rows).select("id", "ok")


@query("replica_updates", "SELECT r.replica_id, CASE WHEN l_no THEN 'NOT_FOUND' WHEN o.generation <> 1 THEN 'GENERATION_MISMATCH' WHEN o.lifecycle_state = 'RECLAIMED' THEN 'RECLAIMED_OBJECT' END AS error FROM (SELECT DISTINCT CASE WHEN size % 10 = 0 THEN concat(replica_id, '-x') ELSE replica_id END AS replica_id, object_id, size % 10 = 0 AS l_no FROM replicas) r JOIN objects o ON o.id = r.object_id")
def replica_updates(d):
    changes = d.replicas.withColumn("replica_id", F.when(F.col("size") % 10 == 0, F.concat("replica_id", F.lit("-x"))).otherwise(F.col("replica_id")))
    return tx.replica_updates(changes, d.replicas, d.objects).select("replica_id", "error").distinct()


@query("policy_conflicts", "SELECT 'DUPLICATE_ID' AS kind, 'default-1' AS name UNION ALL SELECT 'AMBIGUOUS', 'DEFAULT' UNION ALL SELECT 'INVALID_POLICY', concat(id, '-', version) FROM more_policies WHERE id IN ('bad', 'odd') UNION ALL SELECT 'AMBIGUOUS', concat('OBJECT_CLASS:', match_class) FROM more_policies WHERE id = 'urgent' GROUP BY match_class HAVING count(*) > 1")
def policy_conflicts(d):
    new = policies_of(d, "more_policies").filter("id in ('default', 'bad', 'odd') or (id = 'urgent' and version = '2')")
    return tx.policy_conflicts(policies_of(d), new).filter("name <> ''")


@query("unknown_node_reports", "SELECT node_id FROM pressure_reports WHERE node_id NOT IN (SELECT node_id FROM heartbeats WHERE node_id % 2 = 0)")
def unknown_node_reports(d):
    return tx.unknown_reports(d.pressure_reports, d.heartbeats.filter("node_id % 2 = 0").select("node_id").distinct()).select("node_id")


def registration(d):
    current = d.node_rows.withColumns({"addr": F.lit("10.0.0.1:80"), "backends": F.array(F.concat("name", F.lit("/mem")))}).select("node_id", "name", "process_id", "boot_id", "addr", "backends", "last_seen_ms")
    one = current.filter("process_id = concat('p', substring(name, 2))")  # one node for each name
    return tx.register_nodes(d.node_requests.withColumn("backends", F.array("one")).drop("one"), one, HEARTBEAT_NOW, 7_200_000)


_NODES = f"WITH now AS (SELECT * FROM node_rows WHERE process_id = concat('p', substr(name, 2))), live AS (SELECT * FROM now WHERE {HEARTBEAT_NOW} - last_seen_ms <= 7200000), asked AS (SELECT concat(name, '@', process_id, '@', boot_id) AS node_id, name, one FROM node_requests) "


@query("node_register", _NODES + "SELECT a.node_id, CASE WHEN trim(a.name) <> a.name THEN 'INVALID_ARGUMENT' WHEN one = 'other/x' THEN 'INVALID_BACKENDS' WHEN l.node_id <> a.node_id THEN 'NAME_IN_USE' END AS error FROM asked a LEFT JOIN live l ON l.name = a.name")
def node_register(d):
    return registration(d)[2]


@query("node_retired", _NODES + "SELECT node_id FROM now WHERE node_id NOT IN (SELECT node_id FROM live)")
def node_retired(d):
    return registration(d)[1]


@query("nodes_list", "SELECT node_id, name FROM node_rows ORDER BY node_id")
def nodes_list(d):
    return tx.provider_ids(d.node_rows).select("node_id", "name")


@query("backend_owners", "SELECT concat(name, '/', b) AS backend, min(node_id) AS node_id, count(*) > 1 AS ambiguous FROM node_rows, (VALUES ('mem'), ('disk')) AS t(b) GROUP BY 1")
def backend_owners(d):
    return nodes.backend_owners(d.node_rows.withColumn("backends", F.array(F.lit("mem"), F.lit("disk"))))


@query("node_name_conflicts", "SELECT name, count(DISTINCT node_id) AS n FROM node_rows GROUP BY name HAVING count(DISTINCT node_id) > 1")
def node_name_conflicts(d):
    return nodes.name_conflicts(d.node_rows)


@query("pressure_aggregate_compat", "SELECT " + ", ".join(f"max(CASE WHEN metadata * 10e0 > 1e0 THEN 1e0 ELSE {m if m != 'metadata' else 'metadata * 10e0'} END) AS {m}" for m in METRICS) + " FROM pressure_reports")
def pressure_aggregate_compat(d):
    return pressure.aggregate(d.pressure_reports.withColumn("metadata", F.col("metadata") * 10.0), strict=False)


@query("set_pressure", "SELECT level, CASE level WHEN 'CRITICAL' THEN 0.95e0 WHEN 'HIGH' THEN 0.75e0 WHEN 'ELEVATED' THEN 0.5e0 ELSE 0e0 END AS host_memory, level AS back FROM (VALUES ('NORMAL'), ('ELEVATED'), ('HIGH'), ('CRITICAL')) AS t(level)")
def set_pressure(d):
    names = ("NORMAL", "ELEVATED", "HIGH", "CRITICAL")
    rows = d.spark.createDataFrame([(n, *[pressure.synthetic(n)[m] for m in METRICS]) for n in names], "level string, " + ", ".join(f"{m} double" for m in METRICS))
    return rows.select("level", "host_memory", pressure.level(*map(F.col, METRICS)).alias("back"))


@query("all_replicas", "SELECT replica_id, object_id, valid FROM replicas ORDER BY replica_id")
def all_replicas(d):
    return scans.all_replicas(d.replicas).select("replica_id", "object_id", "valid")


@query("all_journal", "SELECT attempt_id, phase, attempt_id % 9 AS created_at_ms FROM journal ORDER BY created_at_ms, attempt_id")
def all_journal(d):
    return scans.all_journal(d.journal.withColumn("created_at_ms", F.col("attempt_id") % 9)).select("attempt_id", "phase", "created_at_ms")


@query("journal_get", "SELECT attempt_id, phase FROM journal WHERE attempt_id = 11")
def journal_get(d):
    return scans.by_id(d.journal, 11, "attempt_id").select("attempt_id", "phase")


@query("coordinator_get", "SELECT 1 AS id, max(o_orderkey) AS epoch FROM orders")
def coordinator_get(d):
    return scans.by_id(d.sql("SELECT 1 AS id, max(o_orderkey) AS epoch FROM orders UNION ALL SELECT 2, 0"), 1)


@query("policies_parsed", "SELECT id, version, kind, reclaim_threshold, min_reuse_probability, match_class, emergency, 0.5e0 AS w_memory FROM policies")
def policies_parsed(d):
    return policy.parsed(d.policy_texts).select("id", "version", "kind", "reclaim_threshold", "min_reuse_probability", "match_class", "emergency", "w_memory")


@query("aliased_archives", "SELECT DISTINCT archive_id FROM archives a WHERE EXISTS (SELECT 1 FROM archives x WHERE x.backend = a.backend AND x.key = a.key AND (x.content_hash <> a.content_hash OR x.size <> a.size))")
def aliased_archives(d):
    return dedup.aliased(d.archives).select("archive_id").distinct()


@query("aliased_payloads", "SELECT replica_id FROM odd_sizes o WHERE EXISTS (SELECT 1 FROM odd_sizes x WHERE x.backend = o.backend AND x.key = o.key AND x.size <> o.size)")
def aliased_payloads(d):
    return dedup.aliased(d.odd_sizes).select("replica_id")


@query("dedup_keys", "SELECT object_id, concat('dedup-', content_hash, CASE WHEN object_id % 3 > 0 THEN concat('-r', object_id % 3) ELSE '' END) AS key FROM payload_replicas")
def dedup_keys(d):
    return d.payload_replicas.select("object_id", dedup.dedup_key(F.col("content_hash"), F.col("object_id") % 3).alias("key"))


@query("dedup_problems", "SELECT content_hash, backend, CASE WHEN min(size) <> max(size) THEN 'SIZE_MISMATCH' END AS problem FROM odd_sizes WHERE valid GROUP BY content_hash, backend")
def dedup_problems(d):
    return dedup.live_identities(d.odd_sizes, d.payload_objects, strict=False).select("content_hash", "backend", "problem")


@query("lineage_removed", "SELECT parent_id, child_id, kind FROM lineage WHERE NOT (kind = 'DEPENDS_ON' AND parent_id % 6 = 0)")
def lineage_removed(d):
    return lineage.without(d.lineage, d.lineage.filter("kind = 'DEPENDS_ON' and parent_id % 6 = 0"))


@query("depends_on_neighbours", "SELECT parent_id AS id, child_id AS neighbour, 'out' AS direction FROM lineage WHERE kind = 'DEPENDS_ON' UNION ALL SELECT child_id, parent_id, 'in' FROM lineage WHERE kind = 'DEPENDS_ON'")
def depends_on_neighbours(d):
    return lineage.neighbours(d.lineage, "DEPENDS_ON").select("id", "neighbour", "direction")


_ROTTEN = "substr(key, 7, 1) IN ('0', '7')"


@query("verify_replicas", f"SELECT replica_id, valid AND NOT {_ROTTEN} AS valid FROM payload_replicas")
def verify_replicas(d):
    stored = d.sql("SELECT DISTINCT p.backend, p.key, t.text FROM payload_replicas p JOIN documents t ON t.doc_id = p.object_id").select("backend", "key", F.when(F.expr(_ROTTEN), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("payload"))
    return reclaim.verified(d.payload_replicas, stored).select("replica_id", "valid")


@query("compress_hashes", "SELECT doc_id, sha256(text) AS original_hash, octet_length(encode(text)) AS original_size, true AS verified FROM documents")
def compress_hashes(d):
    raw = d.sql("SELECT doc_id, text FROM documents").withColumn("raw", F.col("text").cast("binary"))
    return raw.select("doc_id", codec.compress_verified("raw").alias("c")).select("doc_id", "c.original_hash", "c.original_size", "c.verified")


@query("payload_total_bytes", "SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents")
def payload_total_bytes(d):
    from keepwell.sources.tables import total_bytes

    return total_bytes(d.sql("SELECT doc_id, text FROM documents").select(F.octet_length("text").alias("size")))


@query("dedup_delete", "SELECT content_hash, backend FROM dedup WHERE ref_count > 1")
def dedup_delete(d):
    return reclaim.delete(d.dedup, d.dedup.filter("ref_count = 1"), ["content_hash", "backend"]).select("content_hash", "backend")


@query("archives_changed", "SELECT archive_id FROM crash_archives WHERE object_id % 8 <> 0 UNION ALL SELECT concat(archive_id, '-new') FROM crash_archives WHERE object_id % 12 = 0")
def archives_changed(d):
    left = reclaim.delete(d.crash_archives, d.crash_archives.filter("object_id % 8 = 0"), ["archive_id"])
    return reclaim.insert(left, d.crash_archives.filter("object_id % 12 = 0").withColumn("archive_id", F.concat("archive_id", F.lit("-new"))), ["archive_id"]).select("archive_id")


@query("journal_insert", "SELECT attempt_id, phase FROM crash_journal UNION ALL SELECT -attempt_id - 1, 'RESERVED' FROM crash_journal")
def journal_insert(d):
    new = d.crash_journal.withColumns({"attempt_id": -F.col("attempt_id") - 1, "phase": F.lit("RESERVED")})
    return reclaim.insert(d.crash_journal, new, ["attempt_id"]).select("attempt_id", "phase")


@query("audit_append", "SELECT id, action FROM audit UNION ALL SELECT (SELECT max(id) FROM audit) + n, 'NEW' FROM (VALUES (1), (2), (3)) AS t(n)")
def audit_append(d):
    return reclaim.append(d.audit.select("id", "action"), d.sql("SELECT * FROM (VALUES (30, 'NEW'), (10, 'NEW'), (20, 'NEW')) AS t(seq, action)"))


@query("object_defaults", "SELECT id, 'CREATED' AS lifecycle_state, 'EPHEMERAL' AS durability_class, 1 AS generation, 0e0 AS storage_cost_per_byte_sec, false AS pinned, created_at_ms AS last_access_ms, '{}' AS app_metadata FROM objects")
def object_defaults(d):
    return reclaim.with_defaults(d.objects.select("id", "class", "logical_size", "created_at_ms")).select("id", "lifecycle_state", "durability_class", F.col("generation").cast("int").alias("generation"), "storage_cost_per_byte_sec", "pinned", "last_access_ms", "app_metadata")


@query("audit_order_swapped", "SELECT max(id) < 0 OR bool_and(before IS NULL OR seen < before) AS ok FROM (SELECT seen, id, lag(seen) OVER (ORDER BY id DESC) AS before FROM (SELECT id, CASE WHEN id % 100 = 7 THEN id + 5 ELSE id END AS seen FROM audit))")
def audit_order_swapped(d):
    """A log in which some entries are out of order."""
    return audit.descending(d.audit.select((-F.col("id")).alias("position"), F.when(F.col("id") % 100 == 7, F.col("id") + 5).otherwise(F.col("id")).alias("id")))
