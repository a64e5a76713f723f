"""Shared helpers of the llm operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only on a single machine where none is configured."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keepwell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts the lineage without depending on any one executor.  The schema is kept,
    so that no file is opened for inference (and empty tables work).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keepwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: a worker that is kept for later tasks shouldn't hold this one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and ``size`` bytes; a row that is longer stands alone."""

    def halved(b):
        if len(b) > 1 and b.nbytes > size:
            yield from halved(b.slice(0, len(b) // 2))
            yield from halved(b.slice(len(b) // 2))
        else:
            yield b

    for b in batches:
        for at in range(0, len(b), rows):
            yield from halved(b.slice(at, rows))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000, size: int = 1 << 23) -> DataFrame:
    """``mapInArrow`` whose function sees at most ``rows`` rows and about ``size`` bytes at once, so that long texts fit a worker.

    Batches are cut up in the worker: the session's own batch size holds for every
    plan of the session, and is read when a plan is made, not when it is written down.
    """

    def run(batches):
        yield from fn(sliced(batches, rows, size))
        give_back()

    return df.mapInArrow(run, schema)


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def fold_of(doc_id: int | None, k: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k
