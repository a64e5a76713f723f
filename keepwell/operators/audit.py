"""The audit log, failures and decisions (K-02, K-03, S-12, R-07, W-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.schemas import COMPONENTS

LIMIT = 100_000


def replay(audit: DataFrame, object_id=None, action: str | None = None, limit: int = 50) -> DataFrame:
    """The latest entries, newest first; both filters hold where given."""
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"limit must be within 0..{LIMIT}")
    if object_id is not None:
        audit = audit.filter(F.col("object_id") == object_id)
    if action is not None:
        audit = audit.filter(F.col("action") == action)
    return audit.orderBy(F.desc("id")).limit(limit)


def failures(table: DataFrame, limit: int = 50) -> DataFrame:
    return replay(table, limit=limit)


def descending(log: DataFrame, position: str = "position") -> DataFrame:
    """One row, ok: whether ids strictly descend in order of position.

    Positions are compared within ranges of them and the ranges at their ends,
    so no task sorts the whole log.
    """
    ranged = log.select(position, "id").withColumn("range", F.floor(F.col(position) / 10_000))
    inside = Window.partitionBy("range").orderBy(position)
    pairs = ranged.withColumn("before", F.lag("id").over(inside))
    per = pairs.groupBy("range").agg(F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("id") < F.col("before"))), F.lit(True)).alias("ok"), F.max_by("id", position).alias("last"), F.min_by("id", position).alias("first"))
    across = per.withColumn("before", F.lag("last").over(Window.orderBy("range")))
    return across.agg(F.coalesce(F.bool_and(F.col("ok") & (F.col("before").isNull() | (F.col("first") < F.col("before")))), F.lit(True)).alias("ok"))


def entry_line() -> Column:
    """An entry as one line, texts quoted as JSON, what is missing as '-'."""
    quoted = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', "$1"), F.lit("-"))
    some = lambda c: F.when(F.col(c).isNull(), "-").otherwise(quoted(c))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat(
        F.lit("#"), plain("id"), F.lit(" "), plain("ts_ms"), F.lit(" actor="), some("actor"), F.lit(" action="), some("action"), F.lit(" object="), plain("object_id"), F.lit(" gen="), plain("generation"),
        F.lit(" state="), some("prior_state"), F.lit("->"), some("new_state"), F.lit(" policy="), some("policy"), F.lit(" attempt="), plain("attempt_id"), F.lit(" node="), some("node"), F.lit(" detail="), plain("detail"),
    )


def decisions_for(decisions: DataFrame, object_id) -> DataFrame:
    """An object's decisions, oldest first, with components and reasons parsed where they are JSON text."""
    found = decisions.filter(F.col("object_id") == object_id)
    if dict(found.dtypes)["components"] == "string":
        found = found.withColumns({"components": F.from_json("components", COMPONENTS), "reasons": F.from_json("reasons", "array<string>")})
    return found.orderBy("created_at_ms", "id")
