"""The streaming operators, drained over files."""

import pandas as pd

from keepwell.streaming import heartbeats as hb
from keepwell.streaming import pressure as sp
from keepwell.schemas import METRICS


def files(tmp_path, parts, name="beats"):
    folder = tmp_path / name
    folder.mkdir()
    for i, p in enumerate(parts):
        pd.DataFrame(p).to_parquet(folder / f"part{i}.parquet", index=False)
    return str(folder)


def test_last_seen_ignores_order(spark, tmp_path):
    folder = files(tmp_path, [{"node_id": [1, 1, 2], "ts_ms": [5, 3, 4]}, {"node_id": [1, 2], "ts_ms": [4, 9]}])
    schema = spark.read.parquet(folder).schema
    stream = hb.heartbeat_stream(spark, folder, schema, "*.parquet")
    assert {tuple(r) for r in hb.drained(hb.last_seen(stream), "seen", str(tmp_path / "c")).collect()} == {(1, 5), (2, 9)}


def test_stateful_retirement_reports_each_node(spark, tmp_path):
    folder = files(tmp_path, [{"node_id": [1, 1, 2], "ts_ms": [5, 3, 4]}])
    stream = hb.heartbeat_stream(spark, folder, spark.read.parquet(folder).schema, "*.parquet")
    rows = hb.drained(hb.retirements(stream), "retired", str(tmp_path / "c"), "append").filter("not retired").collect()
    assert {(r.node_id, r.last_seen_ms) for r in rows} == {(1, 5), (2, 4)}


def test_pressure_levels_follow_the_last_report(spark, tmp_path):
    row = lambda n, t, m: {"node_id": n, "ts_ms": t, **{k: 0.0 for k in METRICS}, "host_memory": m}
    folder = files(tmp_path, [[row(1, 1, 0.95), row(1, 2, 0.5), row(2, 1, 0.95)]])
    stream = hb.heartbeat_stream(spark, folder, spark.read.parquet(folder).schema, "*.parquet")
    assert {tuple(r) for r in hb.drained(sp.levels(stream), "levels", str(tmp_path / "c")).collect()} == {(1, "ELEVATED"), (2, "CRITICAL")}
