"""Operator 3: quality rules with robust multivariate outliers.

Counts over the words of a text give two fixed rules and a vector of
variance-stabilised statistics.  Per language and source, the estimate of the
vectors' centre and scatter is that of the ``SHARE`` of them whose covariance
has the least determinant.  It is sought from several starts at once (medians
and median deviations, all vectors, single vectors drawn by hash) by
concentration steps: each takes the nearest share by Mahalanobis distance and
computes its mean and covariance.  A start takes steps until its determinant
doesn't fall any more, and of a group's starts the one with the least is taken.
Texts whose squared distance exceeds ``CUTOFF`` are rejected.

A step is one pass over the stored vectors: counts, sums and products are
aggregated by group, start and bin of the distance, and the share is cut from
the bins, the last one in part.  Bins, not sketches: a group's rows are summed
in every task before anything meets, and what meets is bounded by the number of
bins, so a group that holds a third of the rows costs no more than others.

A group needs more than ``OWN`` rows for an estimate of its own, which then
depends on its rows alone.  A smaller one is judged by that of all rows of its
language, if those are enough, else by that of all rows.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import map_batches, stored

# Symbols that are counted, and the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("v_symbols", "v_dup_lines", "v_repeats", "v_length", "v_upper", "v_punct")
D = len(VECTOR)
SHARE = 0.75
#: Rows beyond which a group has its own estimate; a covariance of D statistics has D (D + 1) / 2 entries.
OWN = 5 * D
#: Starts that are single vectors; steps at most, and the fall of a log-determinant from which on they stop.
DRAWN, STEPS, SETTLED = 3, 20, 1e-2
#: Bins for each unit of a statistic, and for each doubling of a distance from NEAREST on.
FINE, OCTAVE, NEAREST = 256, 16, 2.0**-10
#: Rows of a group for ``pooled``, which estimates don't use unless they are given its groups.
LEAST = 200
#: Deviations are at least these: statistics that most texts have at 0 still vary by one symbol or one passage.
FLOOR = (0.03, 0.1, 0.1, 0.03, 0.03, 0.03)
#: Lines and words of the middle that shares of repetition are drawn towards: one line or passage that a short text repeats says little.
FEW_LINES, FEW_WORDS = 20, 200
#: Median of the chi-square distribution with D degrees of freedom, and the distance beyond which a text is rejected: its 0.999 quantile.
MEDIAN, CUTOFF = 5.348, 22.46
#: Groups for each task that makes estimates of sums; a Python worker costs more than the few rows do.
TOGETHER = 1_000
#: Groups whose estimates are broadcast (300 bytes for each start); with more the join shuffles.
BROADCAST_GROUPS = 10_000

_UPPER = string.ascii_uppercase.encode()
_PUNCT = bytes(c for c in string.punctuation.encode() if chr(c) not in SYMBOLS)


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; all 0 for null and empty texts."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def vector(text: str | None, c: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    """Shares under a square root, drawn towards the middle for short texts, and the log of the mean word length."""
    raw = (text or "").encode()
    n, chars, symbols, dup, repeated = c
    upper, punct = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _PUNCT))
    lines = (text or "").count("\n") + 1
    root = lambda k, of, more: (k / (of + more)) ** 0.5
    return root(symbols, n, 20), root(dup, lines, FEW_LINES), root(repeated, n, FEW_WORDS), float(np.log((chars + 100) / (n + 20))), root(upper, len(raw), 100), root(punct, len(raw), 100)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, grp (language and source), the five counts and the vector, one row for each of ``docs``."""
    names = dict.fromkeys([*keep, "text", "lang", "source"])
    kept = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            cs = [counts(t) for t in texts]
            vs = np.array([vector(t, c) for t, c in zip(texts, cs, strict=True)], np.float64).reshape(-1, D)
            ns = np.array(cs, np.int64).reshape(-1, len(COUNTS))
            grp = ["\x1f".join("\x00" if x is None else x for x in g) for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)]
            cols = [*[b.column(c) for c in keep], pa.array(grp, pa.string()), *[pa.array(ns[:, i]) for i in range(len(COUNTS))], *[pa.array(vs[:, i]) for i in range(D)]]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "grp", *COUNTS, *VECTOR])

    schema = ", ".join([*kept, "grp string", *[f"{c} bigint" for c in COUNTS], *[f"{c} double" for c in VECTOR]])
    return map_batches(docs.select(*names), run, schema, rows=500)


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
ESTIMATE = ", ".join([f"c{i} double" for i in range(D)] + [f"p{i}_{j} double" for i, j in PAIRS])


# Long expressions are spelled as SQL: one call to the JVM instead of one for each operation.
_DIFF = [f"({v} - c{i})" for i, v in enumerate(VECTOR)]
#: Squared Mahalanobis distance of the vector columns from c*, with the precision p*.
DISTANCE = " + ".join(f"{_DIFF[i]} * {_DIFF[j]} * p{i}_{j}" + ("" if i == j else " * 2D") for i, j in PAIRS)
DISTANCE_BIN = f"cast(floor(log2({DISTANCE} + {NEAREST!r}D) * {OCTAVE}) as int)"
SUM_NAMES = [*[f"m{i}" for i in range(D)], *[f"s{i}_{j}" for i, j in PAIRS]]
SUMS = [*VECTOR, *[f"{VECTOR[i]} * {VECTOR[j]}" for i, j in PAIRS]]


def distance() -> Column:
    return F.expr(DISTANCE)


def sums_of() -> list[Column]:
    return [F.expr(f"sum({x}) as {n}") for x, n in zip(SUMS, SUM_NAMES, strict=True)]


FIT = f"grp string, start int, {ESTIMATE}, logdet double, before double"


def fit(batches):
    """Rows (grp, start, n, m0.., s0_0.., before) of sums become centres, precisions and log-determinants."""
    for b in batches:
        get = lambda name: np.array(b.column(name).to_pylist(), np.float64)  # noqa: B023, E731
        n = get("n")
        mean = np.stack([get(f"m{i}") for i in range(D)], axis=1) / n[:, None]
        cov = np.zeros((len(n), D, D))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = get(f"s{i}_{j}") / n - mean[:, i] * mean[:, j]
        cov += np.diag(np.square(FLOOR))
        precision = np.linalg.inv(cov) if len(n) else cov
        cols = [b.column("grp"), b.column("start"), *[pa.array(mean[:, i]) for i in range(D)], *[pa.array(precision[:, i, j]) for i, j in PAIRS], pa.array(np.linalg.slogdet(cov)[1].reshape(-1)), b.column("before")]
        yield pa.RecordBatch.from_arrays(cols, ["grp", "start", *[f"c{i}" for i in range(D)], *[f"p{i}_{j}" for i, j in PAIRS], "logdet", "before"])


def beside(rows: DataFrame, estimates: DataFrame, n_groups: int) -> DataFrame:
    """Join by group: a broadcast for as many groups as are known to be small, else a shuffle that AQE splits where it is skewed."""
    return rows.join(F.broadcast(estimates) if n_groups <= BROADCAST_GROUPS else estimates, "grp")


def language(grp: Column) -> Column:
    """The group of all rows of a language."""
    return F.concat(F.substring_index(grp, "\x1f", 1), F.lit("\x1f\x01"))


EVERYTHING = "\x01"


def pooled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(raw, grp): coarser groups for ``estimates``, of at least LEAST rows: what is smaller is put together by language, and what is still smaller in one; and the number of groups."""
    sizes = vectors.groupBy(F.col("grp").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("grp", F.when(F.col("n") >= LEAST, F.col("raw")).otherwise(language(F.col("raw"))))
    size = first.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = stored(first.join(size, "grp").select("raw", F.when(F.col("total") >= LEAST, F.col("grp")).otherwise(F.lit(EVERYTHING)).alias("grp")))
    return groups, groups.count()


def judges(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(raw, grp) with the group by which each language and source is judged, the same with every group that its rows take part in, and the number of languages and sources."""
    sizes = vectors.groupBy(F.col("grp").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("lang", language(F.col("raw")))
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    both = stored(sizes.join(totals, "lang").select("raw", "lang", F.when(F.col("n") > OWN, F.col("raw")).when(F.col("total") > OWN, F.col("lang")).otherwise(F.lit(EVERYTHING)).alias("grp"), ((F.col("least") <= OWN) & (F.col("total") > OWN)).alias("shared")))
    counted = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grp") == EVERYTHING).alias("rest")).first()
    parts = F.array_distinct(F.array_compact(F.array(F.col("grp"), F.when(F.col("shared"), F.col("lang")), F.when(F.lit(counted["rest"] > 0), F.lit(EVERYTHING)))))
    return both.select("raw", "grp"), both.select("raw", F.explode(parts).alias("grp")), counted["n"]


def middle(binned: DataFrame, by: list[str], bin_: str) -> DataFrame:
    """(by, bin, before, n, total): the bin that holds the middle row of rows (by, bin, n)."""
    up_to, all_ = Window.partitionBy(*by).orderBy(bin_), Window.partitionBy(*by)
    cum = binned.withColumns({"cum": F.sum("n").over(up_to), "total": F.sum("n").over(all_)})
    return cum.filter("2 * cum >= total and 2 * (cum - n) < total").select(*by, bin_, (F.col("cum") - F.col("n")).alias("before"), "n", "total")


def starts(rows: DataFrame, n: int) -> DataFrame:
    """Estimates (as ``fit`` gives them) that the steps begin with."""
    binned = stored(rows.select("grp", F.expr(f"posexplode(array({', '.join(VECTOR)})) as (i, v)")).groupBy("grp", "i", F.expr(f"floor(v * {FINE}) as bin")).agg(F.expr("count(1) as n")))
    medians = middle(binned, ["grp", "i"], "bin").selectExpr("grp", "i", "bin as median")
    apart = binned.join(medians, ["grp", "i"]).groupBy("grp", "i", F.expr("abs(bin - median) as apart")).agg(F.expr("sum(n) as n"))
    floors = ", ".join(f"{f * f!r}D" for f in FLOOR)
    spread = middle(apart, ["grp", "i"], "apart").selectExpr("grp", "i", f"1 / (pow((apart + 0.5D) / {FINE} * 1.4826D, 2) + element_at(array({floors}), i + 1)) as p")
    one = lambda i, c: f"max(case when i = {i} then {c} end)"
    centres, precisions = [f"c{i}" for i in range(D)], [f"p{i}_{j}" for i, j in PAIRS]
    wide = medians.join(spread, ["grp", "i"]).groupBy("grp").agg(*[F.expr(f"({one(i, 'median')} + 0.5D) / {FINE} as c{i}") for i in range(D)], *[F.expr(f"{one(i, 'p') if i == j else '0D'} as p{i}_{j}") for i, j in PAIRS])
    columns = ", ".join(VECTOR)
    sums = stored(rows.groupBy("grp").agg(F.expr("cast(count(1) as double) as n"), *sums_of(), F.expr(f"array({', '.join(f'min_by(struct({columns}), xxhash64({k}, {columns}))' for k in range(DRAWN))}) as drawn")))
    first = wide.selectExpr("grp", "0 as start", *centres, *precisions)
    drawn = sums.join(wide.select("grp", *precisions), "grp").selectExpr("grp", "posexplode(drawn) as (k, v)", *precisions).selectExpr("grp", "k + 2 as start", *[f"v.{v} as c{i}" for i, v in enumerate(VECTOR)], *precisions)
    never = "double('infinity')"
    given = first.unionByName(drawn).selectExpr("*", f"{never} as logdet", f"{never} as before")
    mean = map_batches(sums.selectExpr("grp", "1 as start", "n", *SUM_NAMES, f"{never} as before"), fit, FIT).selectExpr("grp", "start", *centres, *precisions, f"{never} as logdet", "before")
    return stored(given.unionByName(mean))


def concentrated(rows: DataFrame, now: DataFrame, n: int) -> DataFrame:
    """The estimates that the nearest share of each group by ``now`` gives."""
    sums = beside(rows, now, n).groupBy("grp", "start", F.expr(f"{DISTANCE_BIN} as bin")).agg(F.expr("count(1) as n"), F.expr("first(logdet) as before"), *sums_of())
    left = f"ceil(sum(n) over (partition by grp, start) * {SHARE}D) - (sum(n) over (partition by grp, start order by bin) - n)"
    taken = sums.selectExpr("*", f"least(1D, ({left}) / n) as part").filter("part > 0")
    share = taken.groupBy("grp", "start").agg(F.expr("sum(part * n) as n"), F.expr("first(before) as before"), *[F.expr(f"sum(part * {c}) as {c}") for c in SUM_NAMES])
    return stored(map_batches(share.repartition(1 + n // TOGETHER), fit, FIT))


def estimates(vectors: DataFrame, pools: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, int]:
    """(raw, c*, p*, scale) for each language and source in ``vectors`` (grp and the vector columns); and their number.  ``pools`` are other groups, as ``pooled`` gives them."""
    groups, parts, n = judges(vectors) if pools is None else (pools[0], *pools)
    rows = beside(vectors.select(F.col("grp").alias("raw"), *VECTOR).withColumn("grp", F.col("raw")), parts.select(F.col("raw").alias("grp"), F.col("grp").alias("part")), n)
    rows = stored(rows.select(F.col("part").alias("grp"), *VECTOR))
    now, ended, falls = starts(rows, n), None, F.col("before") - F.col("logdet") >= SETTLED
    for _ in range(STEPS):
        now = concentrated(rows, now, n)
        still = now.filter(falls)
        if still.isEmpty():
            break
        stay = now.filter(~falls)
        now, ended = still, ended.unionByName(stay) if ended else stay
    least = (ended.unionByName(now) if ended else now).groupBy("grp").agg(F.min_by(F.struct("start", *[f.name for f in now.schema if f.name[0] in "cp"]), F.struct("logdet", "start")).alias("e"))
    best = stored(least.select("grp", "e.*"))
    # Half of the vectors are nearer than the median of the chi-square distribution.
    half = middle(beside(rows, best, n).groupBy("grp", F.expr(f"{DISTANCE_BIN} as bin")).agg(F.expr("count(1) as n")), ["grp"], "bin")
    at = F.pow(F.lit(2.0), (F.col("bin") + (F.col("total") / 2 - F.col("before")) / F.col("n")) / OCTAVE) - NEAREST
    return stored(groups.join(best.join(half.select("grp", F.greatest(F.lit(1.0), at / MEDIAN).alias("scale")), "grp"), "grp").drop("grp", "start")), n


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), cutoff: float = CUTOFF) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, distance and kept for each row of ``docs`` (doc_id, text, lang, source).

    Null and empty texts have no words, which fails the base rules.  A null
    language or source is a value of its own.  Equal texts of one language and
    source are judged alike.  An empty table gives an empty result.  Texts are
    read once; what is kept of a row is stored beside its statistics.
    """
    stats = stored(statistics(docs, keep))
    found, n = estimates(stats.select("grp", *VECTOR))
    return _judged(stats, found, n, keep, cutoff)


def _judged(stats: DataFrame, found: DataFrame, n: int, keep: tuple[str, ...], cutoff: float) -> DataFrame:
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (
        beside(stats, found.withColumnRenamed("raw", "grp"), n)
        .withColumn("base_failed", failed)
        .withColumn("distance", distance() / F.col("scale"))
        .select(*keep, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
    )


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) that the rules keep."""
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return judged(docs.select(*names), names).filter("kept").select(*names)


def op3(docs: DataFrame) -> DataFrame:
    """``judged`` for each row: doc_id, counts, base_failed, distance, kept; nulls, ties and empty tables as stated there."""
    return judged(docs)
