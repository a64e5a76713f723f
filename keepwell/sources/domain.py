"""The domain tables, derived from star-schema and event tables by SQL that both Spark and DuckDB run."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from keepwell.sources.scenarios import SCENARIOS

STAR = ("orders", "lineitem", "events", "documents")

# `{sha}` and `{ms}` are the two functions whose names differ between engines.
DOMAIN: dict[str, str] = {
    "objects": """
        SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS generation, o_orderpriority AS class,
          CAST(floor(o_totalprice) AS BIGINT) AS logical_size, CAST(floor(o_totalprice / 2e0) AS BIGINT) AS physical_size,
          CASE WHEN o_orderkey % 6 = 0 THEN CAST(floor(o_totalprice / 4e0) AS BIGINT) END AS compressed_size,
          1000000 + o_orderkey * 10 AS created_at_ms, 1000000 + o_orderkey * 10 + (o_orderkey % 97) * 60000 AS last_access_ms, o_orderkey % 97 AS access_count,
          CAST(o_orderkey % 100 AS DOUBLE) / 100e0 AS reuse_probability,
          CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 30) * 86400 END AS reuse_horizon_secs,
          CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 100e0 END AS recompute_cost,
          CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS recompute_latency_secs,
          CASE WHEN o_orderkey % 7 = 0 THEN 10e0 END AS transfer_cost, CASE WHEN o_orderkey % 11 = 0 THEN 20e0 END AS migration_cost,
          1e-4 AS storage_cost_per_byte_sec, 1e-3 * CAST(1 + o_orderkey % 7 AS DOUBLE) AS memory_cost_per_byte_sec, 1 + o_orderkey % 4 AS replication_count,
          CASE o_orderkey % 4 WHEN 0 THEN 'EPHEMERAL' WHEN 1 THEN 'RECOMPUTABLE' WHEN 2 THEN 'DURABLE' ELSE 'CRITICAL' END AS durability_class,
          CASE o_orderkey % 9 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'DURABLE' WHEN 2 THEN 'RECOMPUTABLE' ELSE 'EPHEMERAL' END AS survivability_class,
          concat('owner-', CAST(o_custkey % 10 AS STRING)) AS owner, CAST(NULL AS STRING) AS content_hash,
          CASE WHEN o_orderkey % 50 = 0 THEN 'RECLAIMED' WHEN o_orderkey % 53 = 0 THEN 'FAILED' WHEN o_orderkey % 59 = 0 THEN 'WARM' WHEN o_orderkey % 61 = 0 THEN 'COLD'
            WHEN o_orderkey % 67 = 0 THEN 'COMPRESSED' WHEN o_orderkey % 71 = 0 THEN 'ARCHIVED' WHEN o_orderkey % 73 = 0 THEN 'CREATED' WHEN o_orderkey % 79 = 0 THEN 'RECLAIM_PENDING'
            WHEN o_orderkey % 83 = 0 THEN 'DEDUPED' WHEN o_orderkey % 89 = 0 THEN 'RECOMPUTABLE' ELSE 'HOT' END AS lifecycle_state,
          'default-1' AS policy_version, 1 AS decision_epoch, o_orderkey % 41 = 0 AS pinned, o_orderkey % 43 = 0 AS protected,
          CASE WHEN o_orderkey % 13 = 0 THEN 1000000 + (o_orderkey % 400) * 1000 END AS min_retention_deadline_ms, CAST(NULL AS BIGINT) AS max_retention_deadline_ms, '{}' AS app_metadata
        FROM orders""",
    "raw_objects": """
        SELECT id, CASE WHEN id % 31 = 0 THEN -0.5e0 WHEN id % 37 = 0 THEN 1.5e0 ELSE reuse_probability END AS reuse_probability,
          CASE WHEN id % 29 = 0 THEN -1e0 ELSE recompute_cost END AS recompute_cost, recompute_latency_secs, transfer_cost, migration_cost, storage_cost_per_byte_sec,
          CASE WHEN id % 23 = 0 THEN -1e-3 ELSE memory_cost_per_byte_sec END AS memory_cost_per_byte_sec, CASE WHEN id % 19 = 0 THEN ' ' ELSE class END AS class,
          min_retention_deadline_ms, CASE WHEN id % 26 = 0 THEN 1 END AS max_retention_deadline_ms, logical_size, physical_size, reuse_horizon_secs, replication_count
        FROM objects""",
    "replicas": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS replica_id, l_orderkey AS object_id, 1 AS generation,
          CASE WHEN l_linestatus = 'F' THEN 'memory' ELSE 'file' END AS backend, concat('part-', CAST(l_partkey % 700 AS STRING)) AS key,
          CASE WHEN l_linenumber = 7 THEN 'ARCHIVED' WHEN l_linenumber = 6 THEN 'DURABLE' ELSE 'HOT' END AS kind, CAST(floor(l_extendedprice) AS BIGINT) AS size,
          concat('h', CAST(l_partkey AS STRING)) AS content_hash, 1000000 + l_orderkey AS created_at_ms, l_returnflag <> 'R' AS valid
        FROM lineitem""",
    "archives": """
        SELECT concat('a-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS archive_id, l_orderkey AS object_id, 1 AS generation, 'archive' AS backend,
          concat(CAST(l_orderkey AS STRING), '/1/gen1') AS key, CAST(floor(l_extendedprice) AS BIGINT) AS size, concat('h', CAST(l_partkey AS STRING)) AS content_hash,
          1000000 + (l_suppkey % 5) * 1000 AS created_at_ms, l_linestatus = 'F' AS valid
        FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    "lineage": """
        SELECT o_orderkey AS parent_id, o_orderkey + 1 + o_orderkey % 3 AS child_id,
          CASE o_orderkey % 4 WHEN 1 THEN 'DERIVES_FROM' WHEN 3 THEN 'SUPERSEDES' ELSE 'DEPENDS_ON' END AS kind FROM orders""",
    "lineage_deep": """SELECT o_orderkey AS parent_id, o_orderkey + 1 AS child_id, 'DEPENDS_ON' AS kind FROM orders WHERE o_orderkey % 20 <> 19""",
    "payload_objects": """SELECT doc_id AS id, {sha}(text) AS content_hash, CASE WHEN doc_id % 500 = 499 THEN 'RECLAIMED' ELSE 'HOT' END AS lifecycle_state FROM documents""",
    "payload_replicas": """
        SELECT concat('r-', CAST(doc_id AS STRING)) AS replica_id, doc_id AS object_id, 1 AS generation, CASE WHEN doc_id % 2 = 0 THEN 'memory' ELSE 'file' END AS backend, concat('dedup-', {sha}(text)) AS key,
          'HOT' AS kind, n_chars AS size, {sha}(text) AS content_hash, doc_id % 9 <> 0 AS valid FROM documents WHERE doc_id % 500 <> 499""",
    "dedup": """
        SELECT content_hash, backend, min(key) AS storage_key, count(*) AS ref_count, min(size) + CASE WHEN count(*) > 3 THEN 1 ELSE 0 END AS payload_size
        FROM payload_replicas WHERE object_id % 10 <> 3 GROUP BY content_hash, backend""",
    "scheduled": """SELECT content_hash, backend, CASE WHEN object_id % 77 = 0 THEN concat(key, '-r1') ELSE key END AS key FROM payload_replicas WHERE object_id % 3 <> 0""",
    "journal_replicas": """
        SELECT object_id AS attempt_id, CASE WHEN object_id % 21 = 0 THEN concat(replica_id, '-gone') ELSE replica_id END AS replica_id, object_id, generation, backend, key, kind,
          CASE WHEN object_id % 20 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN object_id % 63 = 0 THEN 'other' ELSE content_hash END AS content_hash, valid
        FROM payload_replicas WHERE object_id % 2 = 0""",
    "audit": """
        SELECT event_id AS id, {ms} AS ts_ms, concat('actor-', CAST(user_id % 7 AS STRING)) AS actor, upper(event_type) AS action, user_id AS object_id, 1 AS generation,
          CAST(NULL AS STRING) AS prior_state, CASE WHEN event_id % 3 = 0 THEN 'HOT' END AS new_state, 'default-1' AS policy, CAST(NULL AS STRING) AS attempt_id, CAST(NULL AS STRING) AS node, props AS detail FROM events""",
    "failures": """SELECT event_id AS id, {ms} AS ts_ms, user_id AS object_id, 'INTEGRITY_FAILURE' AS kind, props AS message, event_id % 2 = 0 AS recovered FROM events WHERE event_type = 'error'""",
    "heartbeats": """SELECT user_id AS node_id, {ms} AS ts_ms FROM events""",
    "pressure_reports": """
        SELECT user_id AS node_id, {ms} AS ts_ms, CASE WHEN event_type = 'purchase' THEN least(value / 500e0, 1e0) ELSE 0e0 END AS accelerator_memory, CASE WHEN event_type = 'view' THEN least(value / 100e0, 1e0) ELSE 0e0 END AS host_memory,
          CASE WHEN event_type = 'click' THEN least(value / 50e0, 1e0) ELSE 0e0 END AS local_storage, 0e0 AS remote_storage, CASE WHEN event_type = 'error' THEN least(value / 200e0, 1e0) ELSE 0e0 END AS metadata, 0e0 AS queue,
          CASE WHEN event_type = 'signup' THEN least(value / 300e0, 1e0) ELSE 0e0 END AS network FROM events""",
    "attempts": """
        SELECT o_orderkey AS attempt_id, o_orderkey AS object_id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'COMMITTED' ELSE 'ROLLED_BACK' END AS status FROM orders""",
    "reservations": """
        SELECT o_orderkey AS reservation_id, o_orderkey AS attempt_id, o_orderkey AS object_id, 1000000 + (o_orderkey % 120) * 1000 AS expires_at_ms,
          CASE o_orderkey % 4 WHEN 1 THEN 'OPEN' WHEN 2 THEN 'COMMITTED' WHEN 3 THEN 'RELEASED' ELSE 'EXPIRED' END AS status FROM orders""",
    "journal": """
        SELECT o_orderkey AS attempt_id, o_orderkey AS object_id,
          CASE o_orderkey % 7 WHEN 0 THEN 'RESERVED' WHEN 1 THEN 'VALIDATED' WHEN 2 THEN 'PHYSICAL_STARTED' WHEN 3 THEN 'PHYSICAL_DONE' WHEN 4 THEN 'COMMITTED' WHEN 5 THEN 'ROLLED_BACK' ELSE 'FAILED' END AS phase,
          CASE WHEN o_orderkey % 7 < 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 END WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 END AS n_plan,
          CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_archives, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE o_orderkey % 3 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END END AS n_present,
          o_orderkey % 37 = 0 AS unavailable FROM orders""",
    "policies": """
        SELECT * FROM (VALUES
          ('default', '1', 'DEFAULT', 0e0, 0.05e0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), false),
          ('emergency', '1', 'EMERGENCY', 0e0, 0.5e0, NULL, NULL, 'CRITICAL', NULL, NULL, true),
          ('under-pressure', '1', 'PRESSURE', 0e0, 0.3e0, NULL, NULL, 'HIGH', NULL, NULL, false),
          ('urgent', '1', 'OBJECT_CLASS', 10e0, 0.8e0, '1-URGENT', NULL, NULL, NULL, NULL, false),
          ('scratch', '2', 'OWNER', 0e0, 1e0, NULL, 'owner-3', NULL, NULL, NULL, false),
          ('durable', '1', 'DURABILITY', 1000e0, 0.02e0, NULL, NULL, NULL, 'DURABLE', NULL, false),
          ('surviving', '1', 'SURVIVABILITY', 500e0, 0.04e0, NULL, NULL, NULL, NULL, 'CRITICAL', false)
        ) AS t(id, version, kind, reclaim_threshold, min_reuse_probability, match_class, match_owner, match_pressure, match_durability, match_survivability, emergency)""",
    "more_policies": """
        SELECT * FROM policies UNION ALL SELECT 'urgent', '2', 'OBJECT_CLASS', 10e0, 0.8e0, '1-URGENT', NULL, NULL, NULL, NULL, false
        UNION ALL SELECT 'bad', '1', 'OWNER', 0e0, 1.5e0, NULL, ' ', NULL, NULL, NULL, false UNION ALL SELECT 'odd', '1', 'AGE', 0e0, 0.5e0, NULL, NULL, NULL, NULL, NULL, false""",
    "keys": """
        SELECT CASE o_orderkey % 12 WHEN 0 THEN 'dedup-abc' WHEN 1 THEN 'UPPER' WHEN 2 THEN 'a/b/c' WHEN 3 THEN 'con' WHEN 4 THEN 'com1.txt' WHEN 5 THEN 'x.' WHEN 6 THEN '.tmp-x' WHEN 7 THEN 'a//b'
          WHEN 8 THEN 'a:b' WHEN 9 THEN 'ok name.txt' WHEN 10 THEN '..' ELSE '/abs' END AS key, o_orderkey AS id FROM orders""",
} | SCENARIOS


def needed(sql: str) -> list[str]:
    """Domain tables that a statement names, those they build on first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in DOMAIN and name not in out:
                visit(DOMAIN[name])
                out.append(name)

    visit(sql)
    return out


def in_duckdb(sql: str) -> str:
    """A whole DuckDB statement: ``sql`` over the domain tables; it may begin with its own WITH list."""
    tables = [f"{n} AS ({DOMAIN[n].replace('{sha}', 'sha256').replace('{ms}', '(epoch_us(ts) // 1000)')})" for n in needed(sql)]
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    rest = sql[own.end() :] if own else sql
    if not tables:
        return sql
    head = "WITH RECURSIVE " if own and own[1] else "WITH "
    return head + ", ".join(tables) + (", " if own else " ") + rest


class Domain:
    """The domain tables of a folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._views: dict[str, str] = {}

    def _view(self, table: str) -> str:
        """A temporary view of a table file, so that its schema is read once for all domain tables."""
        if table not in self._views:
            name = f"keepwell_{table}_{zlib.crc32(self.folder.encode()):08x}"
            self.spark.read.parquet(f"{self.folder}/{table}.parquet").createOrReplaceTempView(name)
            self._views[table] = name
        return self._views[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DOMAIN:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        tables = needed(text)
        body = [(n, DOMAIN[n].replace("{sha}(text)", "sha2(text, 256)").replace("{ms}", "unix_millis(CAST(ts AS TIMESTAMP))")) for n in tables]
        out = ("WITH " + ", ".join(f"{n} AS ({s})" for n, s in body) + " " if body else "") + text
        for t in STAR:
            if re.search(rf"\b(FROM|JOIN)\s+{t}\b", out):
                out = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {self._view(t)}", out)
        return self.spark.sql(out)
