"""Derived golden values, behavioural fixtures and invariants."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keepwell.functions import codec, economics, pressure
from keepwell.operators import audit, dedup, lifecycle, lineage, nodes, planning, policy, reclaim, recovery
from keepwell.schemas import METRICS, PRESSURE, STATES, TABLES, TRANSITIONS, WEIGHTS
from keepwell.sources import tables


def objects(spark, *rows):
    base = dict(
        id=1, generation=1, logical_size=1000, physical_size=0, created_at_ms=1_000_000, last_access_ms=1_000_000, access_count=0, reuse_probability=0.01, recompute_cost=1.0, storage_cost_per_byte_sec=0.0,
        memory_cost_per_byte_sec=1.0, replication_count=1, durability_class="EPHEMERAL", survivability_class="EPHEMERAL", owner="", lifecycle_state="HOT", policy_version="", decision_epoch=0, pinned=False, protected=False, app_metadata="{}", reuse_horizon_secs=None,
    )
    base["class"] = "checkpoint"
    schema = TABLES["objects"]
    data = [[str(v) if n == "id" else v for n, v in ((f.name, (base | r).get(f.name)) for f in schema)] for r in rows]
    return spark.createDataFrame(data, schema)


def policies(spark, *rows):
    cols = "id string, version string, kind string, reclaim_threshold double, min_reuse_probability double, match_class string, match_owner string, match_pressure string, match_durability string, match_survivability string, emergency boolean"
    names = [c.split()[0] for c in cols.split(", ")]
    base = dict(version="1", reclaim_threshold=0.0, min_reuse_probability=0.05, emergency=False)
    rows = [{"id": "default", "kind": "DEFAULT"}, {"id": "emergency", "kind": "EMERGENCY", "min_reuse_probability": 0.5, "match_pressure": "CRITICAL", "emergency": True}, *rows]
    return spark.createDataFrame([[(base | r).get(n) for n in names] for r in rows], cols).withColumns({w: F.lit(1.0) for w in WEIGHTS})


def replicas(spark, ids):
    return spark.createDataFrame([(f"r{i}", str(i), True, "HOT", 10, "memory", "k", "h") for i in ids], "replica_id string, object_id string, valid boolean, kind string, size long, backend string, key string, content_hash string")


NO_ARCHIVES = "archive_id string, object_id string, valid boolean, created_at_ms long, backend string, key string"
EDGES = "parent_id string, child_id string, kind string"


def decided(spark, rows, level="NORMAL", extra=(), edges=(), copies=True):
    o = objects(spark, *rows)
    plan = planning.plan(o, replicas(spark, [r.get("id", 1) for r in rows] if copies else []), spark.createDataFrame([], NO_ARCHIVES), spark.createDataFrame(list(edges), EDGES), policies(spark, *extra), level)
    return {r["id"]: r for r in plan.select("id", "expected_keep_cost", "expected_keep_value", "score", "verdict", "policy_id", "policy_version", "components", "reasons").collect()}


F3 = dict(logical_size=4096, recompute_cost=100.0, memory_cost_per_byte_sec=0.5, storage_cost_per_byte_sec=0.01)


@pytest.mark.parametrize(
    "row, level, extra, cost, value, verdict",
    [
        ({}, "NORMAL", (), 1000.0, 1.02, "RECLAIM"),
        (dict(reuse_probability=0.9, recompute_cost=1e9), "NORMAL", (), 1000.0, 1800000001.0, "RETAIN"),
        (F3, "NORMAL", (), 2088.96, 3.0, "RECLAIM"),
        (F3 | dict(recompute_cost=1.0), "NORMAL", (dict(id="reclaim-checkpoints", kind="OBJECT_CLASS", match_class="checkpoint", reclaim_threshold=10_000.0, min_reuse_probability=0.8),), 2088.96, 1.02, "RETAIN"),
        (F3 | dict(reuse_probability=0.2, recompute_cost=50.0, memory_cost_per_byte_sec=0.8), "NORMAL", (), 3317.76, 21.0, "RETAIN"),
        (F3 | dict(reuse_probability=0.2, recompute_cost=50.0, memory_cost_per_byte_sec=0.8), "CRITICAL", (), 26255.36, 21.0, "RECLAIM"),
        (dict(memory_cost_per_byte_sec=0.5, recompute_cost=100.0), "CRITICAL", (), 4000.0, 3.0, "RECLAIM"),
    ],
)
def test_golden_scores(spark, row, level, extra, cost, value, verdict):
    d = decided(spark, [row], level, extra)["1"]
    assert math.isclose(d["expected_keep_cost"], cost, rel_tol=1e-9) and math.isclose(d["expected_keep_value"], value, rel_tol=1e-9) and math.isclose(d["score"], cost - value, rel_tol=1e-9)
    assert d["verdict"] == verdict and [c["name"] for c in d["components"]] == list(economics.COMPONENT_NAMES)


def test_without_copies_there_is_no_survivability(spark):
    d = decided(spark, [dict(logical_size=4096, replication_count=0)], copies=False)["1"]
    assert math.isclose(d["score"], 4095.98, rel_tol=1e-9)


def test_blocking_dependent_keeps_its_parent(spark):
    d = decided(spark, [dict(id=1), dict(id=2, recompute_cost=None)], edges=[("1", "2", "DEPENDS_ON")])
    assert math.isclose(d["1"]["score"], -9001.02, rel_tol=1e-9) and d["1"]["verdict"] == "RETAIN"


def test_owner_policy(spark):
    d = decided(spark, [F3 | dict(owner="scratch", reuse_probability=0.5, recompute_cost=1.0)], extra=(dict(id="reclaim-scratch", version="2", kind="OWNER", match_owner="scratch", min_reuse_probability=1.0),))["1"]
    assert (d["policy_id"], d["policy_version"], d["verdict"]) == ("reclaim-scratch", "2", "RECLAIM") and math.isclose(d["score"], 2086.96, rel_tol=1e-9)


def test_pins_are_hard(spark):
    d = decided(spark, [dict(id=1, pinned=True), dict(id=2, protected=True)], "CRITICAL")
    assert d["1"]["reasons"] == ["object_is_pinned", "hard_invariant_policy_cannot_recommend_reclaim"] and {x["verdict"] for x in d.values()} == {"RETAIN"}


def test_an_invalid_object_fails_the_whole_call(spark):
    with pytest.raises(PySparkException, match="invalid object"):
        decided(spark, [dict(id=1), dict(id=2, reuse_probability=1.5)])
    bad = objects(spark, dict(id=1), dict(id=2, reuse_probability=float("nan")), {"id": 3, "class": " "})
    assert {r["id"]: r["problems"] for r in planning.rejected(bad).collect()} == {"2": ["reuse_probability"], "3": ["class"]}


def test_ambiguity_counts_only_where_it_is_reached(spark):
    two = (dict(id="a", kind="OWNER", match_owner="x"), dict(id="b", kind="OWNER", match_owner="x"))
    assert decided(spark, [dict(owner="y")], extra=two)["1"]["policy_id"] == "default"
    assert decided(spark, [dict(owner="x")], "CRITICAL", extra=two)["1"]["policy_id"] == "emergency"
    with pytest.raises(PySparkException, match="ambiguous"):
        decided(spark, [dict(owner="x")], extra=two)
    assert [r.selector_key for r in policy.ambiguous_selectors(policies(spark, *two)).collect()] == ["OWNER:x"]


def test_many_policies_are_joined_with_the_same_result(spark, monkeypatch):
    extra = (dict(id="a", kind="OWNER", match_owner="x"), dict(id="c", kind="OBJECT_CLASS", match_class="k"), dict(id="d", kind="DURABILITY", match_durability="DURABLE"), dict(id="e", kind="OWNER", match_owner="x"), dict(id="p", kind="PRESSURE", match_pressure="HIGH"))
    rows = [{"id": i, "owner": o, "class": c, "durability_class": u} for i, (o, c, u) in enumerate((o, c, u) for o in ("x", "y") for c in ("k", "l") for u in ("DURABLE", "CRITICAL"))]
    o, got = objects(spark, *rows), []
    for limit in (200, 0):
        monkeypatch.setattr(policy, "LITERAL", limit)
        for level in PRESSURE:
            got.append(sorted(map(str, policy.resolve(o, policies(spark, *extra), level, strict=False).select("id", "tier", "ambiguous", "policy_id", "threshold").collect())))
    assert got[:4] == got[4:] and len({str(g) for g in got[:4]}) == 3


def test_candidate_limit(spark):
    with pytest.raises(ValueError):
        planning.candidates(*[None] * 5, limit=10_001)


def test_pressure(spark):
    zero = {m: 0.0 for m in METRICS}
    for name in PRESSURE:
        row = spark.createDataFrame([pressure.synthetic(name)])
        assert row.select(pressure.level(*map(F.col, METRICS)).alias("l")).first().l == name
    bad = spark.createDataFrame([zero, zero | {"queue": 2.0}])
    assert pressure.aggregate(bad, strict=False).first().host_memory == 1.0
    with pytest.raises(PySparkException):
        pressure.aggregate(bad).collect()
    assert pressure.aggregate(bad.limit(0)).first().queue == 0.0


def test_transitions(spark):
    df = spark.createDataFrame([(a, b) for a in STATES for b in STATES], "a string, b string")
    rows = df.select("a", "b", lifecycle.transition(F.col("a"), F.col("b")).alias("r")).collect()
    assert sum(r.r == "ALLOWED" for r in rows) == 50 and {(r.a, r.b) for r in rows if r.r == "ALLOWED"} == {(a, b) for a, to in TRANSITIONS.items() for b in to}


def graph(spark, edges, kind="DEPENDS_ON"):
    return spark.createDataFrame([(str(a), str(b), k if len(e) > 2 else kind) for e in edges for a, b, *r in [e] for k in [r[0] if r else kind]], EDGES)


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    edges, n = [], 40
    for _ in range(70):
        a, b = sorted(rng.sample(range(n), 2))
        edges.append((a, b, rng.choice(["DEPENDS_ON", "DEPENDS_ON", "DERIVES_FROM"])))
    state = {i: (rng.random() < 0.5, rng.random() < 0.2) for i in range(n - 5)}
    o = objects(spark, *[dict(id=i, recompute_cost=1.0 if remade else None, lifecycle_state="RECLAIMED" if dead else "HOT") for i, (remade, dead) in state.items()])
    reach = {i: set() for i in range(n)}
    for i in range(n):
        todo = [i]
        while todo:
            for a, b, k in edges:
                if a == todo[-1] and k == "DEPENDS_ON" and b not in reach[i]:
                    reach[i].add(b)
                    todo.insert(0, b)
            todo.pop()
    blocks = lambda x: x not in state or not (state[x][0] or state[x][1])
    want = {str(i): sum(map(blocks, reach[i])) for i in range(n) if any(map(blocks, reach[i]))}
    assert {r.id: r.n_blockers for r in lineage.unsafe(graph(spark, edges), o).collect()} == want
    assert sorted(r.id for r in lineage.unsafe_ids(graph(spark, edges), o).collect()) == sorted(want)


def test_cycles_are_left_over(spark):
    layer = {r.id: r.layer for r in lineage.layers(graph(spark, [(1, 2), (2, 3), (3, 2), (3, 4)])).collect()}
    assert layer == {"1": 0, "2": None, "3": None, "4": None}
    o = objects(spark, *[dict(id=i) for i in range(5)])
    found = lineage.edge_problems(graph(spark, [(2, 1), (1, 1), (1, 9), (1, 2), (3, 4)]), graph(spark, [(1, 2)]), o)
    assert {(r.parent_id, r.child_id): r.problem for r in found.collect()} == {("2", "1"): "CYCLE", ("1", "1"): "SELF_EDGE", ("1", "9"): "UNKNOWN_ENDPOINT", ("1", "2"): "DUPLICATE", ("3", "4"): None}
    assert lineage.layers(graph(spark, [(1, 2)]).limit(0)).count() == 0


def test_shared_payloads_go_with_their_last_owner(spark):
    one = spark.createDataFrame([("h", "memory", "k", 3, 10)], "content_hash string, backend string, storage_key string, ref_count long, payload_size long")
    gone = lambda n: spark.createDataFrame([("h", "memory", "k")] * n, "content_hash string, backend string, key string")
    for n, last in ((2, False), (3, True)):
        assert dedup.deletion_plan(gone(n), one).first().deletable is last
        assert dedup.release(one, gone(n)).first()["last"] is last
    assert dedup.deletion_plan(gone(4), one).first().problem == "OVER_RELEASE"
    with pytest.raises(PySparkException):
        dedup.release(one, gone(4)).collect()


def test_invariants_of_the_simulation(spark):
    rng = random.Random(1)
    rows = [dict(id=i, durability_class=rng.choice(["EPHEMERAL", "RECOMPUTABLE", "DURABLE", "CRITICAL"]), recompute_cost=rng.choice([None, 1.0]), pinned=rng.random() < 0.1, protected=rng.random() < 0.1, lifecycle_state=rng.choice(STATES)) for i in range(150)]
    o = objects(spark, *rows)
    e = graph(spark, [(i, i + 1) for i in range(0, 148, 3)])
    held = spark.createDataFrame([("5", "OPEN")], "object_id string, status string")
    sim = reclaim.simulate(o, replicas(spark, range(150)), spark.createDataFrame([], NO_ARCHIVES), e, policies(spark), held, force=True)
    for r in sim.collect():
        x = rows[int(r["id"])]
        if r["error"] is None:
            assert r["final_state"] == "RECLAIMED" and not x["pinned"] and not x["protected"] and x["durability_class"] not in ("DURABLE", "CRITICAL") and x["lifecycle_state"] not in ("CREATED", "RECLAIMED", "FAILED") and r["id"] != "5"
        else:
            assert r["final_state"] == x["lifecycle_state"]


def test_retention_deadline(spark):
    o = objects(spark, dict(min_retention_deadline_ms=1_010_000))
    none = spark.createDataFrame([], "object_id string, status string")
    assert lifecycle.preflight(o, none, 1_000_000).first().error == "BEFORE_RETENTION_DEADLINE" and lifecycle.preflight(o, none, 1_011_000).first().error is None


def test_recovery_of_nested_journals(spark):
    rep = {f.name: (True if f.name == "valid" else 1 if f.dataType.typeName() == "long" else "m" if f.name == "backend" else "x") for f in TABLES["replicas"]}
    arc = {f.name: (True if f.name == "valid" else 1 if f.dataType.typeName() == "long" else "m" if f.name == "backend" else "y") for f in TABLES["archives"]}
    j = lambda i, phase, plan, archives=(): (str(i), "o", 1, phase, 1, 1, ("{}", [rep], plan, list(archives)))
    journal = spark.createDataFrame([j(1, "RESERVED", None), j(2, "VALIDATED", [rep]), j(3, "PHYSICAL_STARTED", []), j(4, "PHYSICAL_DONE", []), j(5, "PHYSICAL_STARTED", [rep]), j(6, "PHYSICAL_DONE", [rep], [arc]), j(7, "PHYSICAL_DONE", None), j(8, "COMMITTED", [])], TABLES["journal"])

    def outcomes(*held):
        present = spark.createDataFrame(list(held), "backend string, key string, exists boolean")
        return {r.attempt_id: r.outcome for r in recovery.reconcile(recovery.facts(journal, present)).collect()}

    assert outcomes(("m", "x", True), ("m", "y", False)) == {"1": "ROLLED_BACK", "2": "ERROR", "3": "ROLLED_BACK", "4": "COMMITTED", "5": "ROLLED_BACK", "6": "ERROR", "7": "ERROR"}
    assert outcomes(("m", "x", False), ("m", "y", False))["6"] == "COMMITTED" and outcomes(("m", "y", True))["5"] == "ERROR"
    assert {r.attempt_id: r.problem for r in recovery.payload_problems(journal).collect()} == {"2": "PLAN_TOO_EARLY", "7": "PLAN_MISSING"}


def test_crc32c_and_zstd(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(b"row-1;" * 10_000),)], "p binary")
    rows = df.select(codec.crc32c("p").alias("c"), codec.compress_verified("p").alias("v"), codec.benefit_estimate("p").alias("b")).collect()
    assert rows[0].c == 0xE3069283 and rows[1].c == 0 and rows[2].c is None and rows[3].v.verified and rows[3].v.ratio < 0.1 and rows[3].b.worthwhile and not rows[0].b.worthwhile
    back = df.filter("length(p) > 0").withColumn("z", codec.zstd("p")).select("p", codec.unzstd("z", F.length("p").cast("bigint")).alias("q")).collect()
    assert all(r.p == r.q for r in back)


def test_audit_order(spark):
    log = lambda ids: spark.createDataFrame(list(enumerate(ids)), "position long, id long")
    assert audit.descending(log(range(30_000, 0, -1))).first().ok and audit.descending(log([])).first().ok
    assert not audit.descending(log([1, 2])).first().ok and not audit.descending(log([2, 2])).first().ok


def test_backend_owners(spark):
    n = spark.createDataFrame([(1, "a", ["m", "f"]), (2, "a", ["m"])], "node_id long, name string, backends array<string>")
    assert {r.backend: r.ambiguous for r in nodes.backend_owners(n).collect()} == {"a/m": True, "a/f": False} and nodes.name_conflicts(n).count() == 1


def test_row_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(3, "c")], "id long, v string")
    assert reclaim.insert(t, new, ["id"]).count() == 3 and reclaim.delete(t, new, ["id"]).count() == 2
    assert {tuple(r) for r in reclaim.upsert(t, spark.createDataFrame([(2, "z")], "id long, v string"), ["id"]).collect()} == {(1, "a"), (2, "z")}
    with pytest.raises(PySparkException):
        reclaim.insert(t, t, ["id"]).collect()


def test_corruption_invalidates_all_owners(spark):
    r = spark.createDataFrame([("r1", "1", True, "m", "k", "h"), ("r2", "2", True, "m", "k", "h"), ("r3", "3", True, "m", "ok", "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae")], "replica_id string, object_id string, valid boolean, backend string, key string, content_hash string")
    p = spark.createDataFrame([("m", "k", "bad"), ("m", "ok", "foo")], "backend string, key string, payload string")
    assert {x.replica_id: x.valid for x in reclaim.verified(r, p).collect()} == {"r1": False, "r2": False, "r3": True}


def test_files_and_schema_probe(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a").write_bytes(b"abc")
    (tmp_path / "p" / ".tmp-x").write_bytes(b"zz")
    files = tables.payload_files(spark, str(tmp_path / "p"))
    assert [(r.name, r.size) for r in files.collect()] == [("a", 3)] and tables.total_bytes(files).first().total_bytes == 3
    assert tables.probe(objects(spark, {}), "objects") == [] and "missing id" in tables.probe(objects(spark, {}).drop("id"), "objects")
    tables.write(objects(spark, {}), str(tmp_path), "objects")
    assert tables.checked(tables.load(spark, str(tmp_path), "objects"), "objects").count() == 1


def test_defaults_and_folds(spark):
    o = reclaim.with_defaults(spark.createDataFrame([("1", "c", 5, 7)], "id string, class string, logical_size long, created_at_ms long"))
    r = o.first()
    assert (r.lifecycle_state, r.durability_class, r.last_access_ms, r.pinned) == ("CREATED", "EPHEMERAL", 7, False)
    touches = spark.createDataFrame([("1", 9), ("1", 8)], "object_id string, ts_ms long")
    r = reclaim.fold_access(o, touches).first()
    assert (r.access_count, r.last_access_ms) == (2, 9)


def test_compressed_objects_come_back_whole(spark):
    """Compressed, archived, restored: the bytes and sizes are the original ones, and a broken blob isn't taken."""
    import hashlib

    from keepwell.functions import codec
    from keepwell.operators import transactions as tx

    raw = b"row-000001;" * 500
    packed = codec.compressed(raw)
    h, z = hashlib.sha256(raw).hexdigest(), hashlib.sha256(packed).hexdigest()
    objects = spark.createDataFrame([(i, 1, "HOT", h, 100, None, 1, "{}") for i in (1, 2)], "id long, generation long, lifecycle_state string, content_hash string, physical_size long, compressed_size long, replication_count long, app_metadata string")
    replicas = spark.createDataFrame([(f"r{i}", i, 1, "memory", f"dedup-{h}", "HOT", len(raw), h, 1, True) for i in (1, 2)], "replica_id string, object_id long, generation long, backend string, key string, kind string, size long, content_hash string, created_at_ms long, valid boolean")
    dedup = spark.createDataFrame([(h, "memory", f"dedup-{h}", 2, len(raw))], "content_hash string, backend string, storage_key string, ref_count long, payload_size long")
    what = spark.createDataFrame([(1, "zstd", len(raw), len(packed), z)], "object_id long, codec string, original_size long, size long, content_hash string")
    done = tx.compressed(what, objects, replicas, dedup, 5)
    assert {(r.id, r.lifecycle_state, r.physical_size) for r in done.objects.collect()} == {(1, "COMPRESSED", len(packed)), (2, "HOT", 100)}
    assert {(r.content_hash, r.ref_count) for r in done.dedup.collect()} == {(h, 1), (z, 1)}

    cold = done.objects.withColumn("lifecycle_state", F.lit("ARCHIVED"))
    archives = spark.createDataFrame([("a1", 1, 1, "archive", "1/1", len(packed), z, 1, True), ("a2", 2, 1, "archive", "2/1", 9, h, 1, True)], "archive_id string, object_id long, generation long, backend string, key string, size long, content_hash string, created_at_ms long, valid boolean")
    payloads = spark.createDataFrame([("archive", "1/1", bytearray(packed)), ("archive", "2/1", bytearray(b"not it"))], "backend string, key string, payload binary")
    back = tx.restored(cold, archives, done.replicas.filter("object_id = 0"), done.dedup, payloads, "memory", 9)
    assert {(r.object_id, r.error) for r in back.outcome.collect()} == {(1, None), (2, "INTEGRITY_FAILURE")}
    one = {r.id: r for r in back.objects.collect()}[1]
    assert (one.lifecycle_state, one.physical_size, one.compressed_size, one.replication_count) == ("WARM", len(raw), None, 1)
    assert [(r.content_hash, r.key) for r in back.replicas.collect()] == [(h, f"dedup-{h}")] and {r.ref_count for r in back.dedup.filter(F.col("content_hash") == h).collect()} == {2}


def test_a_shared_payload_goes_with_its_last_owner(spark):
    from keepwell.operators import transactions as tx

    objects = spark.createDataFrame([(i, 1, "HOT") for i in range(10)], "id long, generation long, lifecycle_state string")
    replicas = spark.createDataFrame([(f"r{i}", i, "memory", "k", "h") for i in range(10)], "replica_id string, object_id long, backend string, key string, content_hash string")
    archives = spark.createDataFrame([(f"a{i}", i, i % 2 == 0) for i in range(10)], "archive_id string, object_id long, valid boolean")
    dedup = spark.createDataFrame([("h", "memory", "k", 10, 5)], "content_hash string, backend string, storage_key string, ref_count long, payload_size long")
    for n in (9, 10):
        simulated = spark.createDataFrame([(i, None, "RECLAIMED") for i in range(n)], "id long, error string, final_state string")
        x = tx.reclaimed(simulated, objects, replicas, archives, dedup, 1)
        assert [r.deletable for r in x.payloads.collect()] == [n == 10] and [r.ref_count for r in x.dedup.collect()] == [1] * (n == 9)
        assert x.replicas.count() == 10 - n and x.archives.count() == 10 - (n + 1) // 2 and x.audit.count() == n
