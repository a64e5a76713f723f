"""Batches, folds and tables that all operators share."""

import pyarrow as pa
from pyspark.sql import functions as F

from keepwell.llm import common, queries

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(spark, df, rows, size=1 << 23):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    return common.map_batches(df, run, "n bigint, bytes bigint", rows=rows, size=size)


def test_plans_do_not_change_each_others_batches(spark):
    df = spark.range(5000).repartition(2)
    before = spark.conf.get(SETTING)
    few, many = sizes(spark, df, 7), sizes(spark, df, 900)
    assert max(r.n for r in few.collect()) == 7 and max(r.n for r in many.collect()) == 900
    assert sum(r.n for r in few.collect()) == sum(r.n for r in many.collect()) == 5000 and spark.conf.get(SETTING) == before


def test_slices_are_bounded_by_bytes(spark):
    df = spark.range(40).select(F.repeat(F.lit("x"), 100_000).alias("t")).union(spark.range(1).select(F.repeat(F.lit("y"), 3_000_000).alias("t"))).coalesce(1)
    got = sizes(spark, df, 1000, 1 << 20).collect()
    assert sum(r.n for r in got) == 41 and all(r.bytes <= 1 << 20 or r.n == 1 for r in got) and len(got) < 12


def test_no_query_changes_the_session(spark, sf):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get(SETTING)
    for f in queries.queries().values():
        f(spark, sf)
        assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get(SETTING)) == before


def test_a_fold_of_any_id_type(spark):
    for kind in ("bigint", "string", "decimal(10,2)", "double", "date", "boolean"):
        given = {"date": "DATE'2024-01-30'", "boolean": "true"}.get(kind, f"CAST(7 AS {kind})")
        df = spark.sql(f"SELECT {given} AS doc_id UNION ALL SELECT NULL")
        want = sorted(r[0] for r in df.select(common.fold(F.col("doc_id"), 5)).collect())
        assert want == sorted(common.fold_of(r[0], 5) for r in df.select(F.col("doc_id").cast("string")).collect())
