"""Row types, enumerations and constants of the state-retention data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations.
DURABILITY = {"EPHEMERAL": 0, "RECOMPUTABLE": 0, "DURABLE": 1, "CRITICAL": 2}  # with the copies each needs
STATES = ("CREATED", "HOT", "WARM", "COLD", "COMPRESSED", "DEDUPED", "ARCHIVED", "RECOMPUTABLE", "RECLAIM_PENDING", "RECLAIMED", "FAILED")
EDGE_KINDS = ("DERIVES_FROM", "DEPENDS_ON", "SUPERSEDES", "DUPLICATES")
PRESSURE = {"NORMAL": 1, "ELEVATED": 2, "HIGH": 4, "CRITICAL": 8}  # with their multipliers
PRESSURE_FROM = {"CRITICAL": 0.90, "HIGH": 0.70, "ELEVATED": 0.45}
SYNTHETIC_MEMORY = {"NORMAL": 0.0, "ELEVATED": 0.5, "HIGH": 0.75, "CRITICAL": 0.95}
METRICS = ("accelerator_memory", "host_memory", "local_storage", "remote_storage", "metadata", "queue", "network")
JOURNAL_CLOSED = ("COMMITTED", "ROLLED_BACK", "FAILED")
ATTEMPT_CLOSED = ("COMMITTED", "FAILED", "ROLLED_BACK")
RESERVATION_CLOSED = ("COMMITTED", "RELEASED", "EXPIRED")

# The allowed lifecycle transitions.
TRANSITIONS = {
    "CREATED": ("HOT", "WARM", "COLD", "FAILED"),
    "HOT": ("WARM", "COLD", "COMPRESSED", "ARCHIVED", "RECOMPUTABLE", "DEDUPED", "FAILED"),
    "WARM": ("HOT", "COLD", "COMPRESSED", "ARCHIVED", "RECOMPUTABLE", "FAILED"),
    "COLD": ("HOT", "WARM", "COMPRESSED", "ARCHIVED", "RECOMPUTABLE", "DEDUPED", "FAILED"),
    "COMPRESSED": ("HOT", "WARM", "COLD", "ARCHIVED", "RECOMPUTABLE", "FAILED"),
    "DEDUPED": ("HOT", "WARM", "COLD", "ARCHIVED", "RECOMPUTABLE", "RECLAIM_PENDING", "FAILED"),
    "ARCHIVED": ("HOT", "WARM", "RECOMPUTABLE", "RECLAIM_PENDING", "FAILED"),
    "RECOMPUTABLE": ("HOT", "WARM", "RECLAIM_PENDING", "FAILED"),
    "RECLAIM_PENDING": ("RECLAIMED", "HOT", "WARM", "FAILED"),
}

# Constants of the economics and of the limits.
DECAY_SECS = 86_400.0
COMPRESSION_SHARE, ARCHIVE_SHARE, RECOVERY_SHARE = 0.01, 0.5, 0.5
DEPENDENT_VALUE = 10_000.0
MAX_CANDIDATES = 10_000
NODE_TIMEOUT_MS = 30_000
RESERVATION_TTL_MS = 60_000
ZSTD_LEVEL = 3
SAMPLE_BYTES, SAMPLE_FLOOR, USEFUL_RATIO = 4096, 64, 0.95

WEIGHTS = ("w_reuse", "w_reconstruction", "w_dependency", "w_survivability", "w_memory", "w_storage", "w_replication", "w_pressure", "w_transfer", "w_migration")


def _struct(text: str) -> T.StructType:
    """'name type!' with ! for not null."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}

TABLES: dict[str, T.StructType] = {
    "objects": _struct(
        "id string!, generation bigint!, class string!, logical_size bigint!, physical_size bigint!, compressed_size bigint, created_at_ms bigint!, last_access_ms bigint!, access_count bigint!, "
        "reuse_probability double!, reuse_horizon_secs bigint, recompute_cost double, recompute_latency_secs double, transfer_cost double, migration_cost double, storage_cost_per_byte_sec double!, "
        "memory_cost_per_byte_sec double!, replication_count bigint!, durability_class string!, survivability_class string!, owner string!, content_hash string, lifecycle_state string!, "
        "policy_version string!, decision_epoch bigint!, pinned boolean!, protected boolean!, min_retention_deadline_ms bigint, max_retention_deadline_ms bigint, app_metadata string!"
    ),
    "replicas": _struct("replica_id string!, object_id string!, generation bigint!, backend string!, key string!, kind string!, size bigint!, content_hash string!, created_at_ms bigint!, verified_at_ms bigint, valid boolean!, owner_node string"),
    "lineage": _struct("parent_id string!, child_id string!, kind string!"),
    "dedup": _struct("content_hash string!, backend string!, storage_key string!, ref_count bigint!, payload_size bigint!"),
    "attempts": _struct("attempt_id string!, object_id string!, generation bigint!, node string!, created_at_ms bigint!, updated_at_ms bigint!, status string!"),
    "reservations": _struct("reservation_id string!, attempt_id string!, object_id string!, generation bigint!, node string!, created_at_ms bigint!, expires_at_ms bigint!, status string!"),
    "coordinator": _struct("id bigint!, epoch bigint!, process_id string!, boot_id string!, last_seen_ms bigint!"),
    "archives": _struct("archive_id string!, object_id string!, generation bigint!, backend string!, key string!, size bigint!, content_hash string!, created_at_ms bigint!, valid boolean!"),
    "failures": _struct("id bigint!, ts_ms bigint!, object_id string, attempt_id string, kind string!, message string!, recovered boolean!"),
    "audit": _struct("id bigint!, ts_ms bigint!, actor string!, action string!, object_id string, generation bigint, prior_state string, new_state string, policy string, attempt_id string, node string, detail string!"),
    "policies": _struct("id string!, version string!, policy_json string!"),
}
COMPONENTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]))
TABLES["decisions"] = T.StructType(_struct("id bigint!, object_id string!, generation bigint!, verdict string!, score double!, threshold double!, policy_id string!, policy_version string!, epoch bigint!, created_at_ms bigint!").fields + [T.StructField("components", COMPONENTS), T.StructField("reasons", T.ArrayType(T.StringType()))])
TABLES["journal"] = T.StructType(
    _struct("attempt_id string!, object_id string!, generation bigint!, phase string!, created_at_ms bigint!, updated_at_ms bigint!").fields
    + [
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("prior_object", T.StringType()),
                    T.StructField("replica_deletions", T.ArrayType(TABLES["replicas"])),
                    T.StructField("physical_replica_deletions", T.ArrayType(TABLES["replicas"])),
                    T.StructField("archive_deletions", T.ArrayType(TABLES["archives"])),
                ]
            ),
        )
    ]
)
POLICY_JSON = T.StructType(
    _struct("id string, version string, kind string, reclaim_threshold double, min_reuse_probability double, match_class string, match_owner string, match_pressure string, match_durability string, match_survivability string, emergency boolean, description string").fields
    + [T.StructField("weights", T.StructType([T.StructField(w, T.DoubleType()) for w in WEIGHTS]))]
)
