"""The registered queries over the domain tables, each with its independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions import codec, economics, pressure
from keepwell.operators import audit, dedup, lifecycle, lineage, nodes, planning, policy, reclaim, recovery, scans
from keepwell.schemas import METRICS, PRESSURE, TRANSITIONS, WEIGHTS
from keepwell.sources.domain import Domain, in_duckdb

NOW = 1_200_000
HEARTBEAT_NOW = 1_706_572_800_000  # 2024-01-30

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def policies_of(d: Domain, table: str = "policies") -> DataFrame:
    return getattr(d, table).withColumns({w: F.lit(1.0) for w in WEIGHTS})


def planned(d: Domain, level: str) -> DataFrame:
    return planning.plan(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), level)


# --- the economics in SQL: one statement for each pressure level ----------------------------------------

# Threshold, least reuse probability, id and version of the policies above.
_SPECIFIC = "WHEN class = '1-URGENT' THEN {0} WHEN owner = 'owner-3' THEN {1} WHEN durability_class = 'DURABLE' THEN {2} WHEN survivability_class = 'CRITICAL' THEN {3} ELSE {4}"


def plan_sql(level: str) -> str:
    def by_tier(urgent: str, scratch: str, durable: str, surviving: str, default: str, emergency: str, high: str) -> str:
        if level == "CRITICAL":
            return emergency
        return high if level == "HIGH" else f"CASE {_SPECIFIC.format(urgent, scratch, durable, surviving, default)} END"

    m = f"{PRESSURE[level]}e0"
    return f"""
    WITH context AS (
      SELECT o.*, coalesce(r.n, 0) AS n_replicas, coalesce(a.n, 0) AS n_archives, coalesce(d.v, 0e0) AS dependency_value,
        CASE WHEN coalesce(r.n, 0) + coalesce(a.n, 0) > 0 THEN CASE WHEN o.survivability_class = 'CRITICAL' THEN 2e0 ELSE 1e0 END ELSE 0e0 END AS survivability_value,
        CAST(greatest(logical_size, physical_size) AS DOUBLE) AS size
      FROM objects o LEFT JOIN (SELECT object_id, count(*) AS n FROM replicas WHERE valid GROUP BY object_id) r ON o.id = r.object_id
      LEFT JOIN (SELECT object_id, count(*) AS n FROM archives WHERE valid GROUP BY object_id) a ON o.id = a.object_id
      LEFT JOIN (SELECT e.parent_id, count(*) * 10000e0 AS v FROM lineage e LEFT JOIN objects c ON e.child_id = c.id
                 WHERE e.kind = 'DEPENDS_ON' AND (c.id IS NULL OR (c.recompute_cost IS NULL AND c.lifecycle_state <> 'RECLAIMED')) GROUP BY e.parent_id) d ON o.id = d.parent_id
    ), first AS (
      SELECT *, size * storage_cost_per_byte_sec AS storage_cost, size * memory_cost_per_byte_sec AS memory_cost, coalesce(recompute_cost, 0e0) AS reconstruction_cost,
        CASE WHEN reuse_horizon_secs IS NULL THEN 1e0 ELSE 1e0 / (1e0 + CAST(reuse_horizon_secs AS DOUBLE) / 86400e0) END AS decay,
        {by_tier("10e0", "0e0", "1000e0", "500e0", "0e0", "0e0", "0e0")} AS threshold, {by_tier("0.8e0", "1e0", "0.02e0", "0.04e0", "0.05e0", "0.5e0", "0.3e0")} AS min_reuse_probability,
        {by_tier("'urgent'", "'scratch'", "'durable'", "'surviving'", "'default'", "'emergency'", "'under-pressure'")} AS policy_id,
        {by_tier("'OBJECT_CLASS'", "'OWNER'", "'DURABILITY'", "'SURVIVABILITY'", "'DEFAULT'", "'EMERGENCY'", "'PRESSURE'")} AS tier
      FROM context
    ), second AS (
      SELECT *, memory_cost * greatest(CAST(replication_count AS DOUBLE) - 1e0, 0e0) AS replication_cost, memory_cost * greatest({m} - 1e0, 0e0) AS memory_pressure_cost,
        reuse_probability * reconstruction_cost * decay AS expected_reuse_value, reconstruction_cost * reuse_probability AS reconstruction_avoidance_value FROM first
    ), third AS (
      SELECT *, memory_cost + storage_cost + replication_cost + memory_pressure_cost AS retain_cost,
        expected_reuse_value + reconstruction_avoidance_value + dependency_value + survivability_value AS expected_keep_value,
        memory_cost + storage_cost + replication_cost + memory_pressure_cost + coalesce(transfer_cost, 0e0) + coalesce(migration_cost, 0e0) AS expected_keep_cost FROM second
    ), planned AS (
      SELECT *, expected_keep_cost - expected_keep_value AS score, expected_keep_value - retain_cost AS retention_benefit,
        CASE WHEN pinned OR protected THEN 'RETAIN' WHEN expected_keep_cost - expected_keep_value >= threshold AND reuse_probability <= min_reuse_probability THEN 'RECLAIM' ELSE 'RETAIN' END AS verdict FROM third
    ) """


_CANDIDATE = "SELECT id, score, threshold, policy_id FROM planned WHERE verdict = 'RECLAIM' AND lifecycle_state NOT IN ('RECLAIMED', 'FAILED')"


def _candidates(level: str, limit: int | None):
    return lambda d: planning.candidates(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), level, limit).select("id", "score", "threshold", "policy_id")


for _level in PRESSURE:
    query(f"candidates_top100_{_level.lower()}", plan_sql(_level) + _CANDIDATE + " ORDER BY score DESC, id ASC LIMIT 100")(_candidates(_level, 100))
query("candidates_all_critical", plan_sql("CRITICAL") + _CANDIDATE)(_candidates("CRITICAL", None))


@query("plan_all", plan_sql("NORMAL") + "SELECT id, verdict, score, threshold, policy_id, tier, retention_benefit, dependency_value, survivability_value FROM planned")
def plan_all(d):
    return planned(d, "NORMAL").select("id", "verdict", "score", "threshold", "policy_id", "tier", "retention_benefit", "dependency_value", "survivability_value")


@query("plan_one", plan_sql("NORMAL") + "SELECT id, verdict, score FROM planned WHERE id = 100")
def plan_one(d):
    return scans.by_id(planned(d, "NORMAL"), 100).select("id", "verdict", "score")


_VALUES = {"compression_cost": "reconstruction_cost * 0.01e0", "archive_cost": "coalesce(transfer_cost, 0e0) * 0.5e0", "failure_recovery_value": "reconstruction_cost * 0.5e0", "transfer_cost": "coalesce(transfer_cost, 0e0)", "migration_cost": "coalesce(migration_cost, 0e0)", "reclaim_score": "score"}


@query("decision_components", plan_sql("HIGH") + " UNION ALL ".join(f"SELECT id, '{n}' AS name, {_VALUES.get(n, n)} AS value FROM planned" for n in economics.COMPONENT_NAMES))
def decision_components(d):
    return planned(d, "HIGH").select("id", F.inline("components"))


@query("component_lookup", plan_sql("HIGH") + "SELECT id, score AS value FROM planned")
def component_lookup(d):
    return planned(d, "HIGH").select("id", economics.component("reclaim_score").alias("value"))


@query("decision_reasons", plan_sql("NORMAL") + "SELECT id, CASE WHEN pinned AND protected THEN 3 WHEN pinned OR protected THEN 2 WHEN reuse_horizon_secs IS NULL THEN 7 ELSE 8 END AS n_reasons, CASE WHEN pinned THEN 'object_is_pinned' WHEN protected THEN 'object_is_protected' ELSE printf('reuse_probability=%.6f', reuse_probability) END AS first_reason FROM planned")
def decision_reasons(d):
    return planned(d, "NORMAL").select("id", F.size("reasons").cast("int").alias("n_reasons"), F.col("reasons")[0].alias("first_reason"))


@query("decision_explanation")
def decision_explanation(d):
    return planned(d, "NORMAL").select("id", economics.explanation().alias("explanation"))


@query("cost_inputs", plan_sql("ELEVATED") + "SELECT id, storage_cost, memory_cost, replication_cost, memory_pressure_cost, reconstruction_cost, expected_reuse_value, retain_cost FROM planned")
def cost_inputs(d):
    return economics.cost_inputs(d.objects, F.lit(2.0)).select("id", "storage_cost", "memory_cost", "replication_cost", "memory_pressure_cost", "reconstruction_cost", "expected_reuse_value", "retain_cost")


@query("cost_validation_rejects", "SELECT id FROM raw_objects WHERE reuse_probability < 0 OR recompute_cost < 0 OR (memory_cost_per_byte_sec < 0 AND greatest(logical_size, physical_size) > 0)")
def cost_validation_rejects(d):
    return economics.cost_inputs(d.raw_objects, F.lit(1.0)).filter(F.size(economics.input_problems()) > 0).select("id")


@query(
    "object_validation_rejects",
    """SELECT id, n FROM (SELECT id, CASE WHEN reuse_probability < 0 OR reuse_probability > 1 THEN 1 ELSE 0 END + CASE WHEN recompute_cost < 0 THEN 1 ELSE 0 END + CASE WHEN memory_cost_per_byte_sec < 0 THEN 1 ELSE 0 END
       + CASE WHEN trim(class) = '' THEN 1 ELSE 0 END + CASE WHEN min_retention_deadline_ms > max_retention_deadline_ms THEN 1 ELSE 0 END AS n FROM raw_objects) WHERE n > 0""",
)
def object_validation_rejects(d):
    return planning.rejected(d.raw_objects).select("id", F.size("problems").cast("int").alias("n"))


@query("policy_resolution", plan_sql("NORMAL") + "SELECT tier, policy_id, count(*) AS n FROM planned GROUP BY tier, policy_id")
def policy_resolution(d):
    return policy.resolve(d.objects, policies_of(d), "NORMAL").groupBy("tier", "policy_id").agg(F.count(F.lit(1)).alias("n"))


@query("policy_ambiguity", "SELECT CAST(count(*) AS BIGINT) AS n FROM objects WHERE class = '1-URGENT'")
def policy_ambiguity(d):
    return policy.resolve(d.objects, policies_of(d, "more_policies"), "NORMAL", strict=False).agg(F.count_if("ambiguous").alias("n"))


@query("policy_selector_ambiguity", "SELECT 'OBJECT_CLASS:1-URGENT' AS selector_key, CAST(2 AS BIGINT) AS n")
def policy_selector_ambiguity(d):
    return policy.ambiguous_selectors(d.more_policies).filter("selector_key is not null")


@query("policy_validation", "SELECT id, version, CASE id WHEN 'bad' THEN 2 WHEN 'odd' THEN 1 ELSE 0 END AS n FROM more_policies")
def policy_validation(d):
    return policies_of(d, "more_policies").select("id", "version", F.size(policy.policy_problems()).cast("int").alias("n"))


@query("policy_list", "SELECT id, version, kind FROM policies ORDER BY concat(id, '-', version)")
def policy_list(d):
    return policy.listed(d.policies).select("id", "version", "kind")


# --- pressure and nodes ----------------------------------------------------------------------------

_LEVEL = "CASE WHEN m >= 0.9e0 THEN 'CRITICAL' WHEN m >= 0.7e0 THEN 'HIGH' WHEN m >= 0.45e0 THEN 'ELEVATED' ELSE 'NORMAL' END"
_LAST = f"WITH latest AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts_ms DESC, {', '.join(f'{m} DESC' for m in METRICS)}) AS rn FROM pressure_reports) "


@query("pressure_level_by_node", _LAST + f"SELECT node_id, {_LEVEL} AS level FROM (SELECT node_id, greatest({', '.join(METRICS)}) AS m FROM latest WHERE rn = 1)")
def pressure_level_by_node(d):
    return pressure.latest_reports(d.pressure_reports).select("node_id", pressure.level(*map(F.col, METRICS)).alias("level"))


@query("pressure_aggregate", "SELECT " + ", ".join(f"max({m}) AS {m}" for m in METRICS) + " FROM pressure_reports")
def pressure_aggregate(d):
    return pressure.aggregate(d.pressure_reports)


@query("pressure_multiplier", f"SELECT level, CASE level WHEN 'CRITICAL' THEN 8e0 WHEN 'HIGH' THEN 4e0 WHEN 'ELEVATED' THEN 2e0 ELSE 1e0 END AS multiplier, count(*) AS n FROM (SELECT {_LEVEL} AS level FROM (SELECT greatest({', '.join(METRICS)}) AS m FROM pressure_reports)) GROUP BY level")
def pressure_multiplier(d):
    level = d.pressure_reports.select(pressure.level(*map(F.col, METRICS)).alias("level"))
    return level.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("multiplier", pressure.multiplier(F.col("level")))


@query("pressure_invalid", "SELECT CAST(count(*) AS BIGINT) AS n FROM pressure_reports WHERE metadata * 10e0 > 1e0")
def pressure_invalid(d):
    worse = d.pressure_reports.withColumn("metadata", F.col("metadata") * 10.0)
    return worse.agg(F.count_if(~pressure.is_valid(*map(F.col, METRICS))).alias("n"))


@query("node_last_seen", "SELECT node_id, max(ts_ms) AS last_seen_ms FROM heartbeats GROUP BY node_id")
def node_last_seen(d):
    return nodes.last_seen(d.heartbeats)


@query("stale_nodes", f"SELECT node_id, max(ts_ms) AS last_seen_ms FROM heartbeats GROUP BY node_id HAVING {HEARTBEAT_NOW} - max(ts_ms) > 7200000")
def stale_nodes(d):
    return nodes.stale(d.heartbeats, HEARTBEAT_NOW, 7_200_000)


# --- scans and counts -------------------------------------------------------------------------------


@query("objects_list", "SELECT id, class, lifecycle_state FROM objects ORDER BY id")
def objects_list(d):
    return d.objects.select("id", "class", "lifecycle_state").orderBy("id")


@query("object_get", "SELECT * FROM objects WHERE id = 17")
def object_get(d):
    return scans.by_id(d.objects, 17)


@query("replicas_for", "SELECT replica_id, valid FROM replicas WHERE object_id = 17 ORDER BY replica_id")
def replicas_for(d):
    return scans.replicas_for(d.replicas, 17).select("replica_id", "valid")


@query("archives_list", "SELECT archive_id, object_id FROM archives WHERE valid ORDER BY created_at_ms, archive_id")
def archives_list(d):
    return scans.valid_archives(d.archives).select("archive_id", "object_id")


@query("dedup_list", "SELECT content_hash, backend, ref_count FROM dedup ORDER BY content_hash, backend")
def dedup_list(d):
    return d.dedup.select("content_hash", "backend", "ref_count").orderBy("content_hash", "backend")


@query("valid_replica_counts", "SELECT object_id, count(*) AS n FROM replicas WHERE valid GROUP BY object_id")
def valid_replica_counts(d):
    return scans.valid_replica_counts(d.replicas)


@query("archive_counts", "SELECT object_id, count(*) AS n FROM archives WHERE valid GROUP BY object_id")
def archive_counts(d):
    return scans.archive_counts(d.archives)


@query("replica_count_by_hash", "SELECT content_hash, count(*) AS n FROM replicas GROUP BY content_hash")
def replica_count_by_hash(d):
    return scans.count_by(d.replicas, "content_hash")


@query("replica_total_bytes", "SELECT CAST(sum(size) AS BIGINT) AS physical_bytes FROM replicas WHERE valid")
def replica_total_bytes(d):
    return scans.replica_total_bytes(d.replicas)


@query("bytes_by_backend", "SELECT backend, CAST(sum(size) AS BIGINT) AS total_bytes FROM replicas GROUP BY backend")
def bytes_by_backend(d):
    return scans.bytes_by_backend(d.replicas)


@query("objects_by_state", "SELECT lifecycle_state, count(*) AS n FROM objects GROUP BY lifecycle_state")
def objects_by_state(d):
    return scans.count_by(d.objects, "lifecycle_state")


_STATS = {
    "objects": "SELECT count(*) FROM objects", "replicas": "SELECT count(*) FROM replicas", "valid_replicas": "SELECT count(*) FROM replicas WHERE valid", "physical_bytes": "SELECT CAST(sum(size) AS BIGINT) FROM replicas WHERE valid",
    "archives": "SELECT count(*) FROM archives WHERE valid", "lineage_edges": "SELECT count(*) FROM lineage", "dedup_entries": "SELECT count(*) FROM dedup", "audit_entries": "SELECT count(*) FROM audit",
    "open_reservations": "SELECT count(*) FROM reservations WHERE status = 'OPEN'", "open_journal": "SELECT count(*) FROM journal WHERE phase NOT IN ('COMMITTED', 'ROLLED_BACK', 'FAILED')",
}


@query("stats", "SELECT " + ", ".join(f"({s}) AS {k}" for k, s in _STATS.items()))
def stats(d):
    return scans.stats(d.objects, d.replicas, d.archives, d.lineage, d.dedup, d.audit, d.reservations, d.journal)


@query("open_attempts", "SELECT attempt_id FROM attempts WHERE status = 'OPEN'")
def open_attempts(d):
    return scans.open_attempts(d.attempts).select("attempt_id")


@query("open_reservations", "SELECT reservation_id FROM reservations WHERE status = 'OPEN'")
def open_reservations(d):
    return scans.open_reservations(d.reservations).select("reservation_id")


@query("open_journal", "SELECT attempt_id, phase FROM journal WHERE phase NOT IN ('COMMITTED', 'ROLLED_BACK', 'FAILED')")
def open_journal(d):
    return scans.open_journal(d.journal).select("attempt_id", "phase")


@query("reserved_objects", "SELECT id FROM objects WHERE id IN (SELECT object_id FROM reservations WHERE status = 'OPEN')")
def reserved_objects(d):
    return scans.has_open_reservation(d.objects, d.reservations).select("id")


_REFS = "SELECT id, (SELECT count(*) FROM replicas WHERE object_id = o.id) + (SELECT count(*) FROM archives WHERE object_id = o.id) + (SELECT count(*) FROM lineage WHERE parent_id = o.id) + (SELECT count(*) FROM lineage WHERE child_id = o.id) AS dependents FROM objects o"


@query("object_dependents", _REFS)
def object_dependents(d):
    return scans.references_to(d.objects, d.replicas, d.lineage, d.archives)


@query("newest_archive", "SELECT object_id, archive_id, created_at_ms FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY created_at_ms DESC, archive_id DESC) AS rn FROM archives WHERE valid) WHERE rn = 1")
def newest_archive(d):
    return scans.newest_archive(d.archives)


@query("primary_replica", "SELECT object_id, min(replica_id) AS replica_id FROM replicas WHERE valid AND kind <> 'ARCHIVED' AND object_id IN (SELECT id FROM objects) GROUP BY object_id")
def primary_replica(d):
    return scans.primary_replica(d.replicas, d.objects)


@query("restore_target", "SELECT 'm1' AS id, 0 AS rank")
def restore_target(d):
    return scans.restore_target(d.sql("SELECT * FROM (VALUES ('f1', 'file'), ('m2', 'memory'), ('m1', 'memory'), ('a0', 'archive')) AS t(id, kind)"))


# --- content identity -------------------------------------------------------------------------------


@query("duplicate_groups", "SELECT content_hash, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM payload_objects GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(d):
    return dedup.duplicate_groups(d.payload_objects)


@query("duplicate_members", "SELECT content_hash, id FROM payload_objects WHERE content_hash IN (SELECT content_hash FROM payload_objects GROUP BY content_hash HAVING count(*) > 1)")
def duplicate_members(d):
    return dedup.duplicate_members(d.payload_objects)


_LIVE = "SELECT content_hash, backend, count(*) AS ref_count, min(key) AS storage_key, min(size) AS payload_size FROM payload_replicas WHERE valid GROUP BY content_hash, backend"


def live(d: Domain) -> DataFrame:
    return dedup.live_identities(d.payload_replicas, d.payload_objects)


@query("dedup_identities", _LIVE)
def dedup_identities(d):
    return live(d)


@query(
    "dedup_repair",
    f"""WITH live AS ({_LIVE}) SELECT coalesce(l.content_hash, d.content_hash) AS content_hash, coalesce(l.backend, d.backend) AS backend, coalesce(l.ref_count, d.ref_count) AS ref_count, coalesce(l.storage_key, d.storage_key) AS storage_key,
      coalesce(l.payload_size, d.payload_size) AS payload_size, CASE WHEN l.ref_count IS NULL THEN 'REMOVED' WHEN d.ref_count IS NULL THEN 'RECREATED'
      WHEN l.ref_count = d.ref_count AND l.storage_key = d.storage_key AND l.payload_size = d.payload_size THEN 'KEPT' ELSE 'REPAIRED' END AS action
      FROM dedup d FULL JOIN live l ON d.content_hash = l.content_hash AND d.backend = l.backend""",
)
def dedup_repair(d):
    return dedup.repair(d.dedup, live(d))


@query(
    "dedup_ref_validation",
    f"""WITH live AS ({_LIVE}), a AS (SELECT content_hash, sum(ref_count) AS n FROM dedup GROUP BY 1), b AS (SELECT content_hash, sum(ref_count) AS n FROM live GROUP BY 1)
      SELECT coalesce(a.content_hash, b.content_hash) AS content_hash, CAST(coalesce(a.n, 0) AS BIGINT) AS stored, CAST(coalesce(b.n, 0) AS BIGINT) AS live FROM a FULL JOIN b ON a.content_hash = b.content_hash WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def dedup_ref_validation(d):
    return dedup.ref_count_errors(d.dedup, live(d))


@query("dedup_ambiguous_hashes", "SELECT content_hash, count(DISTINCT backend) AS n_backends FROM dedup GROUP BY content_hash HAVING count(DISTINCT backend) > 1")
def dedup_ambiguous_hashes(d):
    return dedup.ambiguous_hashes(d.dedup)


@query("canonical_payload", "SELECT content_hash, backend, storage_key FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY backend, storage_key) AS rn FROM dedup WHERE ref_count > 0) WHERE rn = 1")
def canonical_payload(d):
    return dedup.canonical(d.dedup)


@query("dedup_release", "SELECT content_hash, backend, storage_key, ref_count - 1 AS ref_count, payload_size, ref_count = 1 AS last FROM dedup")
def dedup_release(d):
    return dedup.release(d.dedup, d.dedup.select("content_hash", "backend"))


@query("dedup_acquire", "SELECT content_hash, backend, storage_key, ref_count + 1 AS ref_count, payload_size FROM dedup")
def dedup_acquire(d):
    return dedup.acquire(d.dedup, d.dedup)


@query(
    "physical_delete_plan",
    """WITH s AS (SELECT content_hash, backend, key, count(*) AS n_scheduled FROM scheduled GROUP BY content_hash, backend, key)
      SELECT s.content_hash, s.backend, s.key, n_scheduled, ref_count, ref_count IS NOT NULL AND storage_key = s.key AND n_scheduled = ref_count AS deletable,
      CASE WHEN ref_count IS NULL THEN 'MISSING_ENTRY' WHEN storage_key <> s.key THEN 'KEY_MISMATCH' WHEN n_scheduled > ref_count THEN 'OVER_RELEASE' END AS problem
      FROM s LEFT JOIN dedup d ON s.content_hash = d.content_hash AND s.backend = d.backend""",
)
def physical_delete_plan(d):
    return dedup.deletion_plan(d.scheduled, d.dedup)


@query("corrupt_owners", "SELECT object_id, replica_id FROM payload_replicas WHERE (backend, key, content_hash) IN (SELECT (backend, key, content_hash) FROM payload_replicas WHERE NOT valid)")
def corrupt_owners(d):
    return dedup.corrupt_owners(d.payload_replicas, d.payload_replicas.filter("not valid"))


@query("aliased_replicas", "SELECT DISTINCT replica_id FROM replicas r WHERE EXISTS (SELECT 1 FROM replicas x WHERE x.backend = r.backend AND x.key = r.key AND (x.content_hash <> r.content_hash OR x.size <> r.size))")
def aliased_replicas(d):
    return dedup.aliased(d.replicas).select("replica_id").distinct()


@query("content_verify", "SELECT doc_id, doc_id % 4 <> 0 AS ok FROM documents")
def content_verify(d):
    stored = F.when(F.col("doc_id") % 4 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    return d.sql("SELECT doc_id, text FROM documents").select("doc_id", codec.verified(F.col("text"), stored).alias("ok"))


@query("hash_parse", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text) END AS parsed FROM documents")
def hash_parse(d):
    h = F.sha2("text", 256)
    given = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, h).otherwise(F.concat(h, F.lit("0")))
    return d.sql("SELECT doc_id, text FROM documents").select("doc_id", codec.parsed_hash(given).alias("parsed"))


@query("archive_blob_name", "SELECT archive_id, concat('blob-', sha256(key)) AS name FROM archives")
def archive_blob_name(d):
    return d.archives.select("archive_id", codec.archive_blob_name(F.col("key")).alias("name"))


@query("key_validation", "SELECT id, key IN ('dedup-abc', 'ok name.txt') AS file_ok, key IN ('dedup-abc', 'a/b/c', 'ok name.txt', '.tmp-x') AS archive_ok FROM keys")
def key_validation(d):
    return d.keys.select("id", codec.valid_file_key(F.col("key")).alias("file_ok"), codec.valid_archive_key(F.col("key")).alias("archive_ok"))


@query("zstd_roundtrip")
def zstd_roundtrip(d):
    raw = d.sql("SELECT doc_id, text FROM documents").withColumn("raw", F.coalesce("text", F.lit("")).cast("binary"))
    return raw.withColumn("c", codec.compress_verified("raw")).select("doc_id", "c.original_size", "c.verified", (F.col("c.compressed_size") > 0).alias("stored"))


@query("crc32c")
def crc32c(d):
    return d.sql("SELECT doc_id, text FROM documents").select("doc_id", codec.crc32c(F.col("text").cast("binary")).alias("crc32c"))


@query("compression_benefit")
def compression_benefit(d):
    return d.sql("SELECT doc_id, text FROM documents").select("doc_id", codec.benefit_estimate(F.col("text").cast("binary"))["worthwhile"].alias("worthwhile"))


# --- the graph --------------------------------------------------------------------------------------

_CLOSURE = "WITH RECURSIVE reach(start, node) AS (SELECT {0}, {1} FROM {2} UNION SELECT r.start, e.{1} FROM reach r JOIN {2} e ON e.{0} = r.node) "


@query("lineage_orphans", "SELECT DISTINCT id FROM (SELECT parent_id AS id FROM lineage UNION ALL SELECT child_id FROM lineage) WHERE id NOT IN (SELECT id FROM objects)")
def lineage_orphans(d):
    return lineage.orphans(d.lineage, d.objects)


@query("lineage_descendants", _CLOSURE.format("parent_id", "child_id", "lineage_deep") + "SELECT start, node FROM reach")
def lineage_descendants(d):
    return lineage.descendants(d.lineage_deep)


@query("lineage_ancestors", _CLOSURE.format("child_id", "parent_id", "lineage_deep") + "SELECT start, node FROM reach")
def lineage_ancestors(d):
    return lineage.ancestors(d.lineage_deep)


@query("lineage_reaches", "SELECT id AS start, id + 7 AS target, id % 20 <= 12 AND id + 7 <= (SELECT max(child_id) FROM lineage_deep) AS reached FROM objects")
def lineage_reaches(d):
    return lineage.reaches(d.lineage_deep, d.objects.select(F.col("id").alias("start"), (F.col("id") + 7).alias("target")))


def _unsafe_sql(table: str) -> str:
    return (
        f"WITH RECURSIVE depends AS (SELECT * FROM {table} WHERE kind = 'DEPENDS_ON'), reach(start, node) AS (SELECT parent_id, child_id FROM depends UNION SELECT r.start, e.child_id FROM reach r JOIN depends e ON e.parent_id = r.node) "
        "SELECT start AS id, count(*) AS n_blockers FROM reach LEFT JOIN objects o ON o.id = node WHERE o.id IS NULL OR (o.recompute_cost IS NULL AND o.lifecycle_state <> 'RECLAIMED') GROUP BY start"
    )


@query("dependency_unsafe", _unsafe_sql("lineage"))
def dependency_unsafe(d):
    return lineage.unsafe(d.lineage, d.objects)


@query("lineage_descendants_of_pinned", _CLOSURE.format("parent_id", "child_id", "lineage_deep") + "SELECT start, node FROM reach WHERE start IN (SELECT id FROM objects WHERE pinned)")
def lineage_descendants_of_pinned(d):
    return lineage.descendants(d.lineage_deep, d.objects.filter("pinned").select(F.col("id").alias("start")))


@query("dependency_unsafe_deep", _unsafe_sql("lineage_deep"))
def dependency_unsafe_deep(d):
    return lineage.unsafe(d.lineage_deep, d.objects)


@query("dependent_count", "SELECT parent_id AS id, count(*) AS n FROM lineage WHERE kind = 'DEPENDS_ON' GROUP BY parent_id")
def dependent_count(d):
    return lineage.dependent_counts(d.lineage)


@query("superseded", "SELECT DISTINCT parent_id AS id FROM lineage WHERE kind = 'SUPERSEDES' AND parent_id IN (SELECT id FROM objects WHERE lifecycle_state = 'HOT') AND child_id IN (SELECT id FROM objects WHERE lifecycle_state = 'HOT')")
def superseded(d):
    return lineage.superseded(d.lineage, d.objects.filter("lifecycle_state = 'HOT'").select("id"))


@query("lineage_neighbors", "SELECT parent_id AS id, child_id AS neighbour, kind, 'out' AS direction FROM lineage UNION ALL SELECT child_id, parent_id, kind, 'in' FROM lineage")
def lineage_neighbors(d):
    return lineage.neighbours(d.lineage)


@query("lineage_edges", "SELECT parent_id, child_id, kind FROM lineage ORDER BY parent_id, child_id, kind")
def lineage_edges(d):
    return lineage.all_edges(d.lineage)


@query("lineage_topo_layers", "SELECT DISTINCT id, CAST(id % 20 AS INTEGER) AS layer FROM (SELECT parent_id AS id FROM lineage_deep UNION ALL SELECT child_id FROM lineage_deep)")
def lineage_topo_layers(d):
    return lineage.layers(d.lineage_deep)


@query(
    "lineage_add_edges",
    """SELECT parent_id, child_id, kind, CASE WHEN parent_id % 30 = 5 THEN 'SELF_EDGE' WHEN parent_id % 30 = 6 THEN 'UNKNOWN_ENDPOINT' WHEN parent_id % 30 = 7 THEN 'CYCLE' WHEN parent_id % 30 = 8 THEN 'DUPLICATE' END AS problem FROM (
      SELECT parent_id, CASE WHEN parent_id % 30 = 5 THEN parent_id WHEN parent_id % 30 = 6 THEN -1 WHEN parent_id % 30 = 7 THEN parent_id - 2 WHEN parent_id % 30 = 8 THEN child_id ELSE child_id + 0 END AS child_id,
      CASE WHEN parent_id % 30 BETWEEN 5 AND 8 THEN 'DEPENDS_ON' ELSE 'DERIVES_FROM' END AS kind FROM lineage_deep WHERE child_id IN (SELECT id FROM objects))""",
)
def lineage_add_edges(d):
    new = d.sql(
        """SELECT parent_id, CASE WHEN parent_id % 30 = 5 THEN parent_id WHEN parent_id % 30 = 6 THEN -1 WHEN parent_id % 30 = 7 THEN parent_id - 2 ELSE child_id END AS child_id,
        CASE WHEN parent_id % 30 BETWEEN 5 AND 8 THEN 'DEPENDS_ON' ELSE 'DERIVES_FROM' END AS kind FROM lineage_deep WHERE child_id IN (SELECT id FROM objects)"""
    )
    return lineage.edge_problems(new, d.lineage_deep, d.objects)


# --- lifecycle, reclamation, recovery ---------------------------------------------------------------

_EDGES = ", ".join(f"('{a}', '{b}')" for a, to in TRANSITIONS.items() for b in to)
_STATES = "SELECT state FROM (VALUES ('CREATED'), ('HOT'), ('WARM'), ('COLD'), ('COMPRESSED'), ('DEDUPED'), ('ARCHIVED'), ('RECOMPUTABLE'), ('RECLAIM_PENDING'), ('RECLAIMED'), ('FAILED'), ('LOST')) AS t(state)"
_WANTED = "CASE id % 12 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'HOT' WHEN 2 THEN 'WARM' WHEN 3 THEN 'COLD' WHEN 4 THEN 'COMPRESSED' WHEN 5 THEN 'DEDUPED' WHEN 6 THEN 'ARCHIVED' WHEN 7 THEN 'RECOMPUTABLE' WHEN 8 THEN 'RECLAIM_PENDING' WHEN 9 THEN 'RECLAIMED' WHEN 10 THEN 'FAILED' ELSE 'LOST' END"


@query(
    "transition_check",
    f"""WITH w AS (SELECT id, lifecycle_state AS f, {_WANTED} AS t FROM objects) SELECT id, CASE WHEN t = 'LOST' THEN 'UNKNOWN_STATE' WHEN f = t THEN 'NOOP' WHEN (f, t) IN (SELECT (a, b) FROM (VALUES {_EDGES}) AS e(a, b)) THEN 'ALLOWED' ELSE 'INVALID_TRANSITION' END AS result FROM w""",
)
def transition_check(d):
    return d.objects.select("id", lifecycle.transition(F.col("lifecycle_state"), F.expr(_WANTED)).alias("result"))


@query("apply_transitions", "SELECT id, CASE WHEN lifecycle_state = 'HOT' THEN 'WARM' ELSE lifecycle_state END AS lifecycle_state FROM objects")
def apply_transitions(d):
    changes = d.objects.filter("lifecycle_state = 'HOT'").select("id", F.lit("WARM").alias("to_state"))
    return reclaim.apply_transitions(d.objects, changes, "operator", NOW)[0].select("id", "lifecycle_state")


@query("transition_audit", "SELECT id AS object_id, 'HOT' AS prior_state, 'WARM' AS new_state FROM objects WHERE lifecycle_state = 'HOT'")
def transition_audit(d):
    changes = d.objects.filter("lifecycle_state in ('HOT', 'WARM')").select("id", F.lit("WARM").alias("to_state"))
    return reclaim.apply_transitions(d.objects, changes, "operator", NOW)[1].select("object_id", "prior_state", "new_state")


_NEEDED = "CASE durability_class WHEN 'CRITICAL' THEN 2 WHEN 'DURABLE' THEN 1 ELSE 0 END"


@query("survivability_check", plan_sql("NORMAL") + f"SELECT id, CAST(0 AS BIGINT) AS remaining, CAST({_NEEDED} AS BIGINT) AS needed, {_NEEDED} = 0 AS ok FROM planned")
def survivability_check(d):
    return lifecycle.survivability(planning.with_context(d.objects, d.replicas, d.archives, d.lineage)).withColumn("remaining", F.col("remaining").cast("bigint"))


_PREFLIGHT = f"""CASE WHEN pinned THEN 'PINNED_OBJECT' WHEN protected THEN 'PROTECTED_OBJECT' WHEN lifecycle_state = 'RECLAIMED' THEN 'ALREADY_RECLAIMED' WHEN lifecycle_state = 'FAILED' THEN 'FAILED_OBJECT'
  WHEN id IN (SELECT object_id FROM reservations WHERE status = 'OPEN') THEN 'RESERVATION_CONFLICT' WHEN min_retention_deadline_ms > {NOW} THEN 'BEFORE_RETENTION_DEADLINE' END"""


@query("reclaim_preflight", f"SELECT id, {_PREFLIGHT} AS error FROM objects")
def reclaim_preflight(d):
    return lifecycle.preflight(d.objects, d.reservations, NOW).select("id", "error")


def _simulation_sql(level: str, force: bool) -> str:
    blocked = "SELECT parent_id FROM reach LEFT JOIN objects x ON x.id = child_id WHERE x.id IS NULL OR (x.recompute_cost IS NULL AND x.lifecycle_state <> 'RECLAIMED')"
    body = plan_sql(level).replace("WITH context", "WITH RECURSIVE depends AS (SELECT parent_id, child_id FROM lineage WHERE kind = 'DEPENDS_ON'), reach(parent_id, child_id) AS (SELECT parent_id, child_id FROM depends UNION SELECT r.parent_id, e.child_id FROM reach r JOIN depends e ON e.parent_id = r.child_id), context").rstrip()
    plan = "" if force else "WHEN verdict = 'RETAIN' THEN NULL "
    error = f"""coalesce({_PREFLIGHT}, CASE {plan}WHEN {_NEEDED} > 0 THEN 'SURVIVABILITY_VIOLATION'
      WHEN lifecycle_state IN ('HOT', 'WARM', 'COLD', 'COMPRESSED') AND recompute_cost IS NULL AND durability_class <> 'EPHEMERAL' THEN 'SURVIVABILITY_VIOLATION'
      WHEN lifecycle_state = 'CREATED' THEN 'INVALID_TRANSITION' WHEN id IN ({blocked}) THEN 'DEPENDENCY_VIOLATION' END)"""
    return body + f", simulated AS (SELECT id, verdict, lifecycle_state, {error} AS error FROM planned) "


@query("reclaim_simulation", _simulation_sql("CRITICAL", False) + "SELECT id, verdict, error, CASE WHEN error IS NULL AND verdict = 'RECLAIM' THEN 'RECLAIMED' ELSE lifecycle_state END AS final_state FROM simulated")
def reclaim_simulation(d):
    return reclaim.simulate(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), d.reservations, "CRITICAL", NOW)


@query("reclaim_simulation_forced", _simulation_sql("NORMAL", True) + "SELECT id, verdict, error, CASE WHEN error IS NULL THEN 'RECLAIMED' ELSE lifecycle_state END AS final_state FROM simulated")
def reclaim_simulation_forced(d):
    return reclaim.simulate(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), d.reservations, "NORMAL", NOW, force=True)


@query("reclaimable", _simulation_sql("CRITICAL", False) + "SELECT id FROM simulated WHERE error IS NULL AND verdict = 'RECLAIM'")
def reclaimable(d):
    return reclaim.reclaimable(d.objects, d.replicas, d.archives, d.lineage, policies_of(d), d.reservations, "CRITICAL", NOW)


@query("deletable_objects", f"SELECT id FROM ({_REFS}) WHERE dependents = 0")
def deletable_objects(d):
    return reclaim.deletable(d.objects, d.replicas, d.lineage.filter("kind = 'SUPERSEDES'"), d.archives)


SQL["deletable_objects"] = "SELECT id FROM objects WHERE id NOT IN (SELECT object_id FROM replicas) AND id NOT IN (SELECT object_id FROM archives) AND id NOT IN (SELECT parent_id FROM lineage WHERE kind = 'SUPERSEDES') AND id NOT IN (SELECT child_id FROM lineage WHERE kind = 'SUPERSEDES')"


@query(
    "touch_fold",
    "SELECT o.id, CASE WHEN lifecycle_state = 'RECLAIMED' OR t.n IS NULL THEN access_count ELSE access_count + t.n END AS access_count, CASE WHEN lifecycle_state = 'RECLAIMED' OR t.n IS NULL THEN last_access_ms ELSE greatest(last_access_ms, t.m) END AS last_access_ms FROM objects o LEFT JOIN (SELECT object_id, count(*) AS n, max(ts_ms) AS m FROM audit WHERE action = 'VIEW' GROUP BY object_id) t ON o.id = t.object_id",
)
def touch_fold(d):
    return reclaim.fold_access(d.objects, d.audit.filter("action = 'VIEW'")).select("id", "access_count", "last_access_ms")


@query("pin_state", "SELECT object_id, action = 'CLICK' AS pinned FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ts_ms DESC, id DESC) AS rn FROM audit WHERE action IN ('CLICK', 'VIEW')) WHERE rn = 1")
def pin_state(d):
    events = d.audit.filter("action in ('CLICK', 'VIEW')").withColumn("action", F.when(F.col("action") == "CLICK", "PIN").otherwise("UNPIN"))
    return reclaim.fold_pins(events)


@query("object_upsert", "SELECT id, CASE WHEN durability_class = 'DURABLE' THEN 'changed' ELSE owner END AS owner FROM objects UNION ALL SELECT -id - 1, 'new' FROM objects WHERE pinned")
def object_upsert(d):
    changed = d.objects.filter("durability_class = 'DURABLE'").withColumn("owner", F.lit("changed"))
    new = d.objects.filter("pinned").withColumns({"id": -F.col("id") - 1, "owner": F.lit("new")})
    return reclaim.insert(reclaim.upsert(d.objects, changed, ["id"]), new, ["id"]).select("id", "owner")


@query("register_objects", "SELECT id, CASE WHEN reuse_probability < 0 OR reuse_probability > 1 OR recompute_cost < 0 OR memory_cost_per_byte_sec < 0 OR trim(class) = '' OR min_retention_deadline_ms > max_retention_deadline_ms THEN 'INVALID_ARGUMENT' WHEN id % 2 = 0 THEN 'ALREADY_EXISTS' WHEN id % 7 = 1 THEN 'INVALID_ARGUMENT' WHEN id % 4 = 3 THEN 'SURVIVABILITY_VIOLATION' END AS error FROM raw_objects")
def register_objects(d):
    c = F.col("id")
    durability = F.when(c % 4 == 3, "CRITICAL").otherwise("DURABLE")
    new = d.raw_objects.withColumns({"durability_class": durability, "payload_size": F.when(c % 7 == 1, F.col("logical_size") + 1).otherwise(F.col("logical_size")), "targets": F.array(F.lit("memory"), F.lit("memory"))})
    return reclaim.registered(new, d.objects.filter("durability_class in ('EPHEMERAL', 'DURABLE')")).select("id", "error")


@query("attempt_get", "SELECT attempt_id, status FROM attempts WHERE attempt_id = 5")
def attempt_get(d):
    return scans.by_id(d.attempts, 5, "attempt_id").select("attempt_id", "status")


@query("attempts_close", "SELECT attempt_id, CASE WHEN status = 'OPEN' THEN 'COMMITTED' ELSE status END AS status FROM attempts")
def attempts_close(d):
    changes = d.attempts.filter("status = 'OPEN'").select("attempt_id", F.lit("COMMITTED").alias("to_status"))
    return reclaim.close_open(d.attempts.select("attempt_id", "status"), changes, "attempt_id")


@query("failures_append", "SELECT id, kind FROM failures UNION ALL SELECT (SELECT max(id) FROM failures) + n, 'NEW' FROM (VALUES (1), (2)) AS t(n)")
def failures_append(d):
    new = d.sql("SELECT * FROM (VALUES (10, 'NEW'), (20, 'NEW')) AS t(seq, kind)")
    return reclaim.append(d.failures.select("id", "kind"), new)


@query("coordinator_takeover", "SELECT node_id, last_seen_ms = 0 OR 1706572800000 - last_seen_ms > 3600000 AS free, CASE WHEN last_seen_ms = 0 OR 1706572800000 - last_seen_ms > 3600000 THEN 2 ELSE 1 END AS next_epoch FROM (SELECT node_id, max(ts_ms) AS last_seen_ms FROM heartbeats GROUP BY node_id)")
def coordinator_takeover(d):
    return nodes.takeover(nodes.last_seen(d.heartbeats).withColumn("epoch", F.lit(1)), HEARTBEAT_NOW, 3_600_000).select("node_id", "free", "next_epoch")


@query("edges_without_object", "SELECT parent_id, child_id, kind FROM lineage WHERE parent_id NOT IN (SELECT id FROM objects WHERE lifecycle_state = 'RECLAIMED') AND child_id NOT IN (SELECT id FROM objects WHERE lifecycle_state = 'RECLAIMED')")
def edges_without_object(d):
    return lineage.without_object(d.lineage, d.objects.filter("lifecycle_state = 'RECLAIMED'").select("id"))


@query("phase_changes", "SELECT attempt_id, CASE WHEN attempt_id % 2 = 0 THEN phase = 'RESERVED' ELSE phase IN ('PHYSICAL_STARTED', 'PHYSICAL_DONE') END AS ok FROM journal")
def phase_changes(d):
    to = F.when(F.col("attempt_id") % 2 == 0, "VALIDATED").otherwise("COMMITTED")
    return d.journal.select("attempt_id", reclaim.phase_change(F.col("phase"), to).alias("ok"))


@query(
    "journal_recovery_outcome",
    """SELECT attempt_id, phase, CASE WHEN phase IN ('COMMITTED', 'ROLLED_BACK', 'FAILED') THEN 'CLOSED' WHEN phase IN ('RESERVED', 'VALIDATED') THEN CASE WHEN n_plan IS NULL THEN 'ROLLED_BACK' ELSE 'ERROR' END WHEN n_plan IS NULL THEN 'ERROR'
      WHEN n_plan + n_archives = 0 THEN CASE phase WHEN 'PHYSICAL_DONE' THEN 'COMMITTED' ELSE 'ROLLED_BACK' END WHEN unavailable THEN 'ERROR' WHEN n_present = n_plan + n_archives THEN 'ROLLED_BACK' WHEN n_present = 0 THEN 'COMMITTED' ELSE 'ERROR' END AS outcome FROM journal""",
)
def journal_recovery_outcome(d):
    return recovery.reconcile(d.journal)


@query(
    "reservation_expiry",
    f"""SELECT reservation_id, r.attempt_id, r.object_id, CASE WHEN lifecycle_state = 'RECLAIM_PENDING' THEN 'FAILED' ELSE lifecycle_state END AS object_state FROM reservations r LEFT JOIN objects o ON o.id = r.object_id
      WHERE status = 'OPEN' AND expires_at_ms <= {NOW} AND r.attempt_id NOT IN (SELECT attempt_id FROM journal WHERE phase NOT IN ('COMMITTED', 'ROLLED_BACK', 'FAILED'))""",
)
def reservation_expiry(d):
    return recovery.expired(d.reservations, d.journal, d.objects, NOW)


@query(
    "rollback_conflicts",
    """SELECT attempt_id, e.replica_id, CASE WHEN s.replica_id IS NOT NULL THEN 'CHANGED' WHEN EXISTS (SELECT 1 FROM payload_replicas x WHERE x.backend = e.backend AND x.key = e.key AND (x.content_hash <> e.content_hash OR x.size <> e.size)) THEN 'KEY_REASSIGNED' ELSE 'MISSING' END AS conflict
      FROM journal_replicas e LEFT JOIN payload_replicas s ON s.replica_id = e.replica_id WHERE s.replica_id IS NULL OR s.size <> e.size OR s.content_hash <> e.content_hash""",
)
def rollback_conflicts(d):
    return recovery.rollback_conflicts(d.journal_replicas, d.payload_replicas)


# --- the log ----------------------------------------------------------------------------------------


@query("audit_replay", "SELECT id, ts_ms, action, object_id FROM audit WHERE action = 'CLICK' ORDER BY id DESC LIMIT 50")
def audit_replay(d):
    return audit.replay(d.audit, action="CLICK").select("id", "ts_ms", "action", "object_id")


@query("audit_replay_object", "SELECT id, ts_ms, action, object_id FROM audit WHERE object_id = 8 AND action = 'VIEW' ORDER BY id DESC LIMIT 50")
def audit_replay_object(d):
    return audit.replay(d.audit, 8, "VIEW").select("id", "ts_ms", "action", "object_id")


@query("audit_distinct_actions", "SELECT DISTINCT action FROM audit ORDER BY action")
def audit_distinct_actions(d):
    return scans.distinct_actions(d.audit)


@query("audit_order_check", "SELECT true AS ok")
def audit_order_check(d):
    return audit.descending(d.audit.withColumn("position", -F.col("id")))


@query("audit_lines", """SELECT id, concat('#', id, ' ', ts_ms, ' actor="', actor, '" action="', action, '" object=', object_id, ' gen=1 state=-->', CASE WHEN new_state IS NULL THEN '-' ELSE '"HOT"' END, ' policy="default-1" attempt=- node=- detail=', detail) AS line FROM audit""")
def audit_lines(d):
    return d.audit.select("id", audit.entry_line().alias("line"))


@query("failures_list", "SELECT id, object_id, message, recovered FROM failures ORDER BY id DESC LIMIT 50")
def failures_list(d):
    return audit.failures(d.failures).select("id", "object_id", "message", "recovered")


@query("decisions_for", plan_sql("NORMAL") + "SELECT id AS object_id, score FROM planned WHERE id = 17")
def decisions_for(d):
    made = planned(d, "NORMAL").select(F.col("id").alias("object_id"), "id", "score", F.to_json("components").alias("components"), F.to_json("reasons").alias("reasons"), F.lit(NOW).alias("created_at_ms"))
    return audit.decisions_for(made, 17).select("object_id", "score")


import keepwell.plans.changes  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Domain(spark, folder))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: in_duckdb(sql) for name, sql in SQL.items()}
