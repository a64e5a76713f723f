"""Operator 9: mixing sources to target weights by weighted fair queueing.

Only DataFrame functions run here.  Each document of a source, in the order of
a hash of its id, has the virtual finish time *cumulative words of its source /
weight of its source*; a source may be passed ``cap`` times, so a document has
one finish time per pass.  The mix is the longest prefix of all finish times,
in ascending order, whose words fit the total budget.

The total order is never formed.  With targets ``min(cap * size, weight * V)``,
everything that finishes by the water level ``V`` fits the budget, so only the
few finish times just above ``V`` that may still fit are sorted globally: within
ranges of them, each with the sum of those before it.
Cumulative sums run over (source, hash bucket) groups: a source that holds a
third of all rows is spread over 4096 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import WORD, stored

# Weights of the sources in code point order, and passes over a source at most.
WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET_DIGITS = 3
#: Ranges of finish times in which the margin above the level is sorted.
RANGES = 1024
#: Sources whose cutoffs are broadcast (100 bytes each); with more the join shuffles.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))


def tie() -> Column:
    """Orders rows of one id and size by their texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


#: The order of a source's documents.
ORDER = ("key", "doc_id", "size", "tie")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, budget, level, target) from rows of (source, size).

    Sources are few compared with rows: they are ranked in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_exhaustion = Window.orderBy(F.col("size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_exhaustion.rowsBetween(Window.unboundedPreceding, -1)
    after = by_exhaustion.rowsBetween(0, Window.unboundedFollowing)
    everything = by_exhaustion.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = sized.groupBy("source").agg(F.sum("size").alias("size"))
    return (
        names.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("budget", F.sum("size").over(everything))
        .withColumn("at", (F.col("budget") - F.coalesce(F.sum(F.col("size") * cap).over(before), F.lit(0))) / F.sum("weight").over(after))
        # Filling up the sources in the order in which they run out, the level rises until the first that doesn't.
        .withColumn("level", F.max("at").over(everything))
        .select("source", F.col("size").alias("source_size"), "weight", "budget", "level", F.least(F.col("size") * cap * F.lit(1e0), F.col("weight") * F.col("level")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and key (the order within a source) for each row of ``docs``.

    ``docs`` has doc_id, text and source; other columns are ignored.  A null or
    empty text has size 0 and takes nothing; null sources form one source, the
    last; a null doc_id is ordered as the text 'null'.  Equal rows are distinct
    rows next to each other in the order, so which of them takes a last copy is
    immaterial.  An empty table gives an empty result.
    """
    base = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key().alias("key"), tie().alias("tie")))
    base = base.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))

    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets, weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "weight", "budget", "level", "target")
    known = b.join(t, F.col("b_source").eqNullSafe(F.col("t_source")))
    inside = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    passes = F.array(*[F.lit(e) for e in range(cap)])
    rows = (
        base.join(known, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("cum", F.col("before") + F.sum("size").over(inside))
        .withColumn("n", F.when(F.col("size") > 0, F.size(F.filter(passes, lambda e: (e * F.col("source_size") + F.col("cum")) / F.col("weight") <= F.col("level")))).otherwise(0))
        .select("doc_id", "source", "size", "key", "tie", "cum", "source_size", "weight", "budget", "level", "target", "n")
    )
    rows = stored(rows)

    left = rows.agg(F.max("budget").alias("budget"), F.max("level").alias("level"), F.sum(F.col("size") * F.col("n")).alias("used")).first()
    rest = (left["budget"] or 0) - (left["used"] or 0)
    finish = F.col("pass") * F.col("source_size") + F.col("cum")
    # What is taken finishes within the rest above what its own source could have by the level.
    above = (
        rows.filter(F.col("size") > 0)
        .withColumn("pass", F.explode(passes))
        .filter(F.col("pass") >= F.col("n"))
        .withColumn("finish", finish)
        .filter(F.col("finish") <= F.col("weight") * F.col("level") + F.lit(rest + 1))
        .withColumn("vft", F.col("finish") / F.col("weight"))
        .withColumn("range", F.floor((F.col("vft") - F.lit(left["level"] or 0.0)) * F.lit(min(weights) * RANGES / (rest + 1))).cast("int"))
    )
    ranges = above.groupBy("range").agg(F.sum("size").alias("size"))
    ahead = ranges.select(F.col("range").alias("r"), F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    in_order = Window.partitionBy("range").orderBy("vft", F.col("source").asc_nulls_last(), "finish").rowsBetween(Window.unboundedPreceding, 0)
    margin = (
        above.join(F.broadcast(ahead), F.col("range") == F.col("r"))  # at most RANGES + 1 rows
        .filter(F.col("ahead") <= rest)
        .withColumn("total", F.col("ahead") + F.sum("size").over(in_order))
        .filter(F.col("total") <= rest)
        .groupBy(F.col("source").alias("m_source"), F.col("cum").alias("m_cum"))
        .agg(F.count(F.lit(1)).alias("more"))
    )
    return (
        rows.join(margin, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("cum") == F.col("m_cum")) & (F.col("size") > 0), "left")
        .withColumn("copies", (F.col("n") + F.coalesce(F.col("more"), F.lit(0))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "key", "tie")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars), each as often as the mix takes it; without words, none.

    In its order, a source's documents are all taken some number of times, and
    up to a cutoff once more.  So a row per source says what to do with a text,
    and texts aren't shuffled.  Only the repeats of the document at a cutoff are
    counted: as many of them are taken once more as the mix says.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    alike = mix(docs).filter("size > 0").groupBy("source", "copies", *ORDER).agg(F.count(F.lit(1)).alias("n"))
    cuts = alike.groupBy("source").agg(F.min("copies").alias("low"), F.max(F.struct("copies", *ORDER, "n")).alias("last"))
    cuts = stored(cuts.select(F.col("source").alias("cut_source"), "low", F.col("last.copies").alias("high"), F.struct(*[F.col(f"last.{c}") for c in ORDER]).alias("cutoff"), F.col("last.n").alias("at_cutoff")))
    few = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    sized = docs.select(*names, n_words(F.col("text")).alias("size"), shuffle_key().alias("key"), tie().alias("tie")).filter("size > 0")
    given = sized.join(few, F.col("source").eqNullSafe(F.col("cut_source")))
    place = F.struct(*ORDER)
    last = (F.col("high") > F.col("low")) & (place == F.col("cutoff"))
    times = lambda df, n: df.filter(n > 0).select(*names, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("copy")).select(*names)
    plain = times(given.filter(~last), F.when(place <= F.col("cutoff"), F.col("high")).otherwise(F.col("low")))
    # Equal rows of the last document are counted, whatever their number; variants of it take their turns.
    repeats = given.filter(last).groupBy(*names, "low", "high", "at_cutoff").agg(F.count(F.lit(1)).alias("m"))
    turn = Window.partitionBy("source").orderBy("text", "lang", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    more = F.least(F.col("m"), F.greatest(F.lit(0), F.col("at_cutoff") - F.coalesce(F.sum("m").over(turn), F.lit(0))))
    repeats = repeats.withColumn("total", F.col("low") * F.col("m") + (F.col("high") - F.col("low")) * more)
    return plain.unionByName(times(repeats, F.col("total")))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM base GROUP BY source
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
         CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM named
), targets AS (
  SELECT source, source_size, weight, budget, least(CAST(source_size * 3 AS DOUBLE), weight * max(lvl) OVER ()) AS target FROM filled
), cumulated AS (
  SELECT b.*, t.source_size, t.weight, t.budget, t.target,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT c.source, c.cum, c.size, c.budget, CAST(e.pass * c.source_size + c.cum AS DOUBLE) / c.weight AS vft, e.pass * c.source_size + c.cum AS finish
  FROM cumulated c, (VALUES (0), (1), (2)) e(pass) WHERE c.size > 0
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY vft, source ASC NULLS LAST, finish ROWS UNBOUNDED PRECEDING) AS total FROM entries
), taken AS (
  SELECT source, cum, count(*) AS copies FROM ordered WHERE total <= budget GROUP BY source, cum
)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM cumulated c LEFT JOIN taken t ON c.source IS NOT DISTINCT FROM t.source AND c.cum = t.cum AND c.size > 0
"""


def op9(docs: DataFrame) -> DataFrame:
    """``mix`` with the contract's columns; nulls, ties, repeated rows and empty tables as stated there."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
