"""Domain tables of operations under way: crashes, restorations, registrations, nodes."""

from __future__ import annotations

SCENARIOS: dict[str, str] = {
    "replica_dedup": "SELECT content_hash, backend, min(key) AS storage_key, count(*) AS ref_count, min(size) AS payload_size FROM replicas GROUP BY content_hash, backend",
    "payload_dedup": "SELECT content_hash, backend, min(key) AS storage_key, count(*) AS ref_count, min(size) AS payload_size FROM payload_replicas GROUP BY content_hash, backend",
    "odd_sizes": """
        SELECT replica_id, object_id, generation, backend, key, kind, CASE WHEN object_id % 50 < 3 THEN size + 1 ELSE size END AS size, content_hash, valid FROM payload_replicas""",
    "crash_objects": """
        SELECT doc_id AS id, 1 + doc_id % 2 AS generation, CASE WHEN doc_id % 15 = 10 THEN 'RECLAIMED' ELSE 'RECLAIM_PENDING' END AS lifecycle_state,
          CASE WHEN doc_id % 15 = 10 THEN 0 ELSE 1 END AS replication_count, CASE WHEN doc_id % 15 = 10 THEN 0 ELSE n_chars END AS physical_size, CAST(NULL AS BIGINT) AS compressed_size
        FROM documents WHERE doc_id % 5 = 0 AND doc_id % 35 <> 0""",
    "crash_journal": """
        SELECT doc_id AS attempt_id, doc_id AS object_id, CASE WHEN doc_id % 25 = 0 THEN 9 ELSE 1 + doc_id % 2 END AS generation, 'PHYSICAL_DONE' AS phase FROM documents WHERE doc_id % 5 = 0""",
    "crash_scheduled": """
        SELECT object_id AS attempt_id, replica_id, object_id, 1 + object_id % 2 AS generation, backend, key, CASE WHEN object_id % 40 = 5 THEN 'other' ELSE content_hash END AS content_hash
        FROM payload_replicas WHERE object_id % 5 = 0""",
    "crash_replicas": """
        SELECT replica_id, object_id, 1 + object_id % 2 AS generation, backend, key, kind, size, content_hash, valid FROM payload_replicas WHERE object_id % 20 <> 15""",
    "crash_archives": """
        SELECT concat('a-', CAST(doc_id AS STRING)) AS archive_id, doc_id AS object_id, 1 + doc_id % 2 AS generation, 'archive' AS backend, concat(CAST(doc_id AS STRING), '/1') AS key, {sha}(text) AS content_hash, true AS valid
        FROM documents WHERE doc_id % 4 = 0""",
    "cold_objects": """
        SELECT doc_id AS id, 1 AS generation, CASE WHEN doc_id % 6 = 0 THEN 'HOT' ELSE 'ARCHIVED' END AS lifecycle_state, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 22 = 3 THEN 'wrong' ELSE {sha}(text) END AS content_hash,
          0 AS physical_size, CAST(NULL AS BIGINT) AS compressed_size, 0 AS replication_count FROM documents WHERE doc_id % 3 <> 1""",
    "cold_archives": """
        SELECT concat('a-', CAST(doc_id AS STRING)) AS archive_id, doc_id AS object_id, 1 AS generation, 'archive' AS backend, concat(CAST(doc_id AS STRING), '/1/gen1') AS key, n_chars AS size,
          CASE WHEN doc_id % 14 = 5 THEN 'broken' ELSE {sha}(text) END AS content_hash, 1000 AS created_at_ms, true AS valid FROM documents WHERE doc_id % 11 <> 2""",
    "cold_payloads": """SELECT 'archive' AS backend, concat(CAST(doc_id AS STRING), '/1/gen1') AS key, text AS payload FROM documents WHERE doc_id % 13 <> 8""",
    "node_rows": """
        SELECT concat('n', CAST(node_id % 40 AS STRING), '@p', CAST(node_id AS STRING), '@b') AS node_id, concat('n', CAST(node_id % 40 AS STRING)) AS name, concat('p', CAST(node_id AS STRING)) AS process_id, 'b' AS boot_id,
          last_seen_ms FROM (SELECT user_id AS node_id, max({ms}) AS last_seen_ms FROM events GROUP BY user_id) AS t""",
    "node_requests": """
        SELECT CASE WHEN i % 10 = 7 THEN ' pad' ELSE concat('n', CAST(i AS STRING)) END AS name, concat('p', CAST(i % 45 AS STRING)) AS process_id, CASE WHEN i % 4 = 0 THEN 'b' ELSE 'c' END AS boot_id, '10.0.0.1:80' AS addr,
          CASE WHEN i % 9 = 4 THEN 'other/x' ELSE concat('n', CAST(i AS STRING), '/mem') END AS one FROM (SELECT DISTINCT user_id % 60 AS i FROM events) AS t""",
    "policy_texts": """
        SELECT id, version, concat('{"id":"', id, '","version":"', version, '","kind":"', kind, '","reclaim_threshold":', CAST(reclaim_threshold AS STRING), ',"min_reuse_probability":', CAST(min_reuse_probability AS STRING),
          CASE WHEN match_class IS NULL THEN '' ELSE concat(',"match_class":"', match_class, '"') END, ',"emergency":', CAST(emergency AS STRING), ',"weights":{"w_reuse":1.0,"w_memory":0.5}}') AS policy_json FROM policies""",
}
