"""Policies: selector tiers, validation and decisions (E-12..E-15, J-05, S-10, K-07, W-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions import economics
from keepwell.operators.sizes import small
from keepwell.schemas import POLICY_JSON, WEIGHTS

# The tiers in order of precedence, with the object's column that each matches (pressure is the call's level).
TIERS = {
    "EMERGENCY": ("match_pressure", None),
    "PRESSURE": ("match_pressure", None),
    "OBJECT_CLASS": ("match_class", "class"),
    "OWNER": ("match_owner", "owner"),
    "DURABILITY": ("match_durability", "durability_class"),
    "SURVIVABILITY": ("match_survivability", "survivability_class"),
    "DEFAULT": (None, None),
}
SELECTORS = ("match_class", "match_owner", "match_pressure", "match_durability", "match_survivability")
FIELDS = ("id", "version", "reclaim_threshold", "min_reuse_probability", *WEIGHTS)
COLUMNS = {"policy_id": "id", "policy_version": "version", "threshold": "reclaim_threshold", "min_reuse_probability": "min_reuse_probability"} | {w: w for w in WEIGHTS}
#: Policies up to which they are constants of the plan; more are joined.
LITERAL = 200


def full_id() -> Column:
    return F.concat("id", F.lit("-"), "version")


def parsed(policies: DataFrame) -> DataFrame:
    """Rows (id, version, policy_json) as policy columns."""
    return policies.select(F.from_json("policy_json", POLICY_JSON).alias("p")).select("p.*", *[F.col(f"p.weights.{w}").alias(w) for w in WEIGHTS]).drop("weights")


def listed(policies: DataFrame) -> DataFrame:
    return policies.orderBy(full_id())


def policy_problems() -> Column:
    """What makes a policy invalid, the kind's exclusive selector included."""
    c = F.col
    given = {s: c(s).isNotNull() for s in SELECTORS}
    only = lambda s: reduce(lambda a, b: a & b, [g if k == s else ~g for k, g in given.items()])
    none = reduce(lambda a, b: a & b, [~g for g in given.values()])
    text = lambda s: only(s) & (F.trim(F.coalesce(c(s), F.lit(""))) != "")
    plain = ~c("emergency")
    rule = (
        F.when(c("kind") == "DEFAULT", none & plain)
        .when(c("kind") == "OBJECT_CLASS", text("match_class") & plain)
        .when(c("kind") == "OWNER", text("match_owner") & plain)
        .when(c("kind") == "PRESSURE", only("match_pressure") & plain)
        .when(c("kind") == "DURABILITY", only("match_durability") & plain)
        .when(c("kind") == "SURVIVABILITY", only("match_survivability") & plain)
        .when(c("kind") == "EMERGENCY", only("match_pressure") & c("emergency") & (c("match_pressure") == "CRITICAL"))
        .otherwise(F.lit(False))
    )
    return economics.problems(
        {
            "id": (F.trim("id") != "") & (F.trim("version") != ""),
            "reclaim_threshold": economics.finite(c("reclaim_threshold")),
            "min_reuse_probability": c("min_reuse_probability").between(0.0, 1.0) & ~F.isnan("min_reuse_probability"),
            **{w: economics.finite_cost(c(w)) for w in WEIGHTS},
            "selectors": rule,
        }
    )


def selector_key() -> Column:
    value = reduce(lambda w, t: w.when(F.col("kind") == t, F.coalesce(F.col(TIERS[t][0]), F.lit(""))), [t for t in TIERS if TIERS[t][0]], F)
    return F.when(F.col("kind") == "DEFAULT", "DEFAULT").otherwise(F.concat("kind", F.lit(":"), value))


def ambiguous_selectors(policies: DataFrame) -> DataFrame:
    """Selector keys with more than one policy, and 'DEFAULT' if there isn't exactly one (E-14)."""
    found = policies.groupBy(selector_key().alias("selector_key")).agg(F.count(F.lit(1)).alias("n"))
    missing = policies.agg(F.count_if(F.col("kind") == "DEFAULT").alias("n")).filter("n = 0").select(F.lit("DEFAULT").alias("selector_key"), "n")
    return found.filter("n > 1").unionByName(missing)


def resolve(objects: DataFrame, policies: DataFrame, level: str, strict: bool = True) -> DataFrame:
    """``objects`` with the columns of the policy that applies, tier and ambiguous.

    Tiers that depend on the pressure alone match every object or none.  More
    than one policy in the first tier that matches is an error if ``strict``.  An
    object without any policy has null columns.  policy_version becomes that of
    the policy.
    """
    given = policies.select("kind", *SELECTORS, *FIELDS).limit(LITERAL + 1).collect()
    few = len(given) <= LITERAL
    out, found = _by_literals(objects, given, level) if few else _by_joins(objects, policies, level)
    pick = lambda i: F.coalesce(*[F.when(f[1] > 0, f[i]) for f in found]) if found else F.lit(None)
    tier = F.coalesce(*[F.when(n > 0, F.lit(t)) for t, n, _ in found]) if found else F.lit(None).cast("string")
    out = out.withColumns({"tier": tier, "ambiguous": pick(1) > 1, "_p": pick(2)})
    if strict:
        out = out.withColumn("_p", F.when(F.col("ambiguous"), F.raise_error(F.concat(F.lit("ambiguous policies: "), "tier"))).otherwise(F.col("_p")))
    if few:  # a policy's number becomes its columns by a join: as expressions they would be repeated in all that is computed from them
        rows = [(i, *[p[f] for f in FIELDS]) for i, p in enumerate(given)]
        types = ", ".join(f"{n} {'string' if f in ('id', 'version') else 'double'}" for n, f in COLUMNS.items())
        table = objects.sparkSession.createDataFrame(rows, f"_p int, {types}")
        return out.drop(*COLUMNS).withColumn("_p", F.col("_p").cast("int")).join(F.broadcast(table), "_p", "left").drop("_p")
    return out.withColumns({n: F.col(f"_p.{f}") for n, f in COLUMNS.items()}).drop("_p", *[f"_{x}_{t}" for t in TIERS for x in "np"])


def _by_literals(objects: DataFrame, given: list, level: str) -> tuple[DataFrame, list]:
    """Few policies become constants of the plan: a map from what each tier matches to (n, number of the policy)."""
    found = []
    for tier, (selector, column) in TIERS.items():
        groups: dict = {}
        for i, p in enumerate(given):
            if p["kind"] == tier and (selector is None or p[selector] is not None) and (column is not None or selector is None or p[selector] == level):
                groups.setdefault(p[selector] if column else None, []).append(i)
        least = {k: (F.lit(len(v)), F.lit(min(v, key=lambda i: tuple(given[i][f] for f in FIELDS)))) for k, v in groups.items()}
        if column is None:
            found += [(tier, n, p) for n, p in least.values()]
        elif least:
            table = F.create_map(*[x for k, (n, p) in least.items() for x in (F.lit(k), F.struct(n.alias("n"), p.alias("p")))])
            hit = F.try_element_at(table, F.col(column))
            found.append((tier, hit["n"], hit["p"]))
    return objects, found


def _by_joins(objects: DataFrame, policies: DataFrame, level: str) -> tuple[DataFrame, list]:
    """Many policies: in each tier one row for each value that it matches joins the objects, so no tier multiplies rows."""
    own, out, found = F.struct(*FIELDS), objects, []
    for tier, (selector, column) in TIERS.items():
        p = policies.filter(F.col("kind") == tier)
        if column is None:
            p = p.filter(F.col(selector) == level) if selector else p
            hit = p.agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("p")).first()
            if hit["n"]:
                found.append((tier, F.lit(hit["n"]), _literal(hit["p"])))
        else:
            one = p.groupBy(F.col(selector).alias(column)).agg(F.count(F.lit(1)).alias(f"_n_{tier}"), F.min(own).alias(f"_p_{tier}"))
            out = out.join(small(one), column, "left")
            found.append((tier, F.col(f"_n_{tier}"), F.col(f"_p_{tier}")))
    return out, found


def _literal(row) -> Column:
    return F.struct(*[F.lit(row[f]).alias(f) for f in FIELDS])


def decide(resolved: DataFrame, level: str, multiplier: float, epoch: int = 1) -> DataFrame:
    """Verdict, score, components and reasons of objects with their policy, dependency_value and survivability_value."""
    c = F.col
    df = economics.evaluate(economics.cost_inputs(resolved, F.lit(float(multiplier))))
    hard = c("pinned") | c("protected")
    reclaim = (c("reclaim_score") >= c("threshold")) & (c("reuse_probability") <= c("min_reuse_probability"))
    # The texts of the reasons.
    fixed = F.array(F.when(c("pinned"), "object_is_pinned"), F.when(c("protected"), "object_is_protected"), F.lit("hard_invariant_policy_cannot_recommend_reclaim"))
    free = F.array(
        F.format_string("reuse_probability=%.6f", c("reuse_probability")),
        F.when(c("reuse_horizon_secs").isNotNull(), F.format_string("expected_reuse_horizon=%ds", c("reuse_horizon_secs"))),
        F.format_string("logical_size=%d", c("logical_size")),
        F.concat(F.lit("recompute_cost="), F.coalesce(c("recompute_cost"), F.lit(0.0)).cast("string")),
        F.format_string("score=%.4f", c("reclaim_score")),
        F.format_string("threshold=%.4f", c("threshold")),
        F.lit(f"pressure={level}"),
        F.concat(F.lit("policy="), c("policy_id"), F.lit("-"), c("policy_version")),
    )
    return df.withColumns(
        {
            "verdict": F.when(~hard & reclaim, "RECLAIM").otherwise("RETAIN"),
            "score": c("reclaim_score"),
            "pressure": F.lit(level),
            "epoch": F.lit(epoch).cast("bigint"),
            "components": economics.components(),
            "reasons": F.array_compact(F.when(hard, fixed).otherwise(free)),
        }
    )
