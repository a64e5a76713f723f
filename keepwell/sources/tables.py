"""Reading and checking tables (S-01, S-14..S-16, schema probe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions.codec import archive_blob_name
from keepwell.schemas import TABLES


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def probe(df: DataFrame, table: str) -> list[str]:
    """How columns differ from the table's schema: names and types; nullability isn't kept by files."""
    want, have = {f.name: f.dataType for f in TABLES[table]}, {f.name: f.dataType for f in df.schema}
    return [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want] + [f"{c} is {have[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def checked(df: DataFrame, table: str) -> DataFrame:
    if found := probe(df, table):
        raise ValueError(f"{table}: {', '.join(found)}")
    return df.select(*TABLES[table].fieldNames())


def payload_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, payload) of a folder of payload files; temporary ones are left out."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.col("length").alias("size"), F.col("content").alias("payload")).filter(~F.col("name").startswith(".tmp-"))


def archive_files(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``keys`` (key) with the payload of its write-once file, null where there is none."""
    return keys.withColumn("name", archive_blob_name(F.col("key"))).join(payload_files(spark, folder), "name", "left")


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def write(df: DataFrame, folder: str, table: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(f"{folder}/{table}.parquet")
