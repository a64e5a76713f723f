"""Resource pressure: levels, multipliers and aggregation over providers (E-09..E-11, A-10, A-11, R-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.schemas import METRICS, PRESSURE, PRESSURE_FROM, SYNTHETIC_MEMORY


def level(*metrics: Column) -> Column:
    """The level of the largest metric."""
    top = F.greatest(*metrics, F.lit(0.0))
    return reduce(lambda c, k: c.when(top >= PRESSURE_FROM[k], k), PRESSURE_FROM, F).otherwise("NORMAL")


def multiplier(name: Column) -> Column:
    return reduce(lambda c, k: c.when(name == k, float(PRESSURE[k])), PRESSURE, F)


def parse_level(text: Column) -> Column:
    """A level's exact name, or an error (E-17)."""
    return F.when(text.isin(*PRESSURE), text).otherwise(F.raise_error(F.concat(F.lit("unknown pressure level "), text)))


def is_valid(*metrics: Column) -> Column:
    """Each within [0, 1] and a number."""
    return reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(m) & m.between(0.0, 1.0), F.lit(False)) for m in metrics])


def aggregate(reports: DataFrame, strict: bool = True) -> DataFrame:
    """One row: the largest of each metric over all reports, zeros without any.

    An invalid report is an error if ``strict``, else it counts as 1.0 throughout.
    """
    ok = is_valid(*map(F.col, METRICS))
    bad = F.raise_error(F.lit("invalid pressure report")).cast("double") if strict else F.lit(1.0)
    return reports.agg(*[F.coalesce(F.max(F.when(ok, F.col(m)).otherwise(bad)), F.lit(0.0)).alias(m) for m in METRICS])


def latest_reports(reports: DataFrame) -> DataFrame:
    """The last report of each node (R-04); reports of one time are ordered by their values."""
    return reports.groupBy("node_id").agg(F.max(F.struct("ts_ms", *METRICS)).alias("r")).select("node_id", "r.*")


def synthetic(name: str) -> dict[str, float]:
    """Metrics that stand for a level: host memory alone."""
    return dict.fromkeys(METRICS, 0.0) | {"host_memory": SYNTHETIC_MEMORY[name]}
