"""The typed dependency graph (G-01..G-11, J-16, J-17, A-15).

Closures grow by frontiers: each round joins the last round's new pairs with the
edges and drops what is known.  Rounds are stored where a shared folder is set,
persisted otherwise, so plans don't grow with the depth of the graph.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from keepwell.schemas import EDGE_KINDS


def _held(df: DataFrame) -> DataFrame:
    """A table in the shared folder; on a single machine without one, a persisted copy that can be recomputed."""
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, starts: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """(start, node): what each start reaches over edges (parent_id, child_id), itself excluded unless on a cycle; all nodes start if none are given.

    Self edges and repeated edges are harmless; null ends reach nothing.
    """
    source, target = ("child_id", "parent_id") if reverse else ("parent_id", "child_id")
    e = _held(edges.select(F.col(source).alias("via"), F.col(target).alias("node")).dropna().distinct())
    first = e.select(F.col("via").alias("start"), "node")
    if starts is None:
        return _doubled(first)
    frontier = _held(first.join(starts.select("start").distinct(), "start", "left_semi"))
    rounds = [frontier]
    while not frontier.isEmpty():
        known = reduce(DataFrame.union, rounds)
        step = frontier.withColumnRenamed("node", "via").join(e, "via").select("start", "node").distinct()
        frontier = _held(step.join(known, ["start", "node"], "left_anti"))
        rounds.append(frontier)
    return reduce(DataFrame.union, rounds)


def _doubled(pairs: DataFrame) -> DataFrame:
    """The closure of all pairs: each round joins what is new with all that is known, so rounds go with the logarithm of the depth."""
    known = fresh = _held(pairs)
    while not fresh.isEmpty():
        on = known.select(F.col("start").alias("via"), F.col("node").alias("to"))
        back = known.select(F.col("start").alias("from"), F.col("node").alias("via"))
        step = fresh.withColumnRenamed("node", "via").join(on, "via").select("start", F.col("to").alias("node"))
        behind = back.join(fresh.select(F.col("start").alias("via"), "node"), "via").select(F.col("from").alias("start"), "node")
        fresh = _held(step.union(behind).distinct().join(known, ["start", "node"], "left_anti"))
        known = _held(known.union(fresh))
    return known


def descendants(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return closure(edges, starts).filter("start <> node")


def ancestors(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return closure(edges, starts, reverse=True).filter("start <> node")


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (start, target) with reached; a start reaches itself."""
    found = closure(edges, pairs.select("start")).withColumn("hit", F.lit(True))
    return pairs.join(found, (pairs["start"] == found["start"]) & (pairs["target"] == found["node"]), "left").select(pairs["start"], pairs["target"], (F.coalesce("hit", F.lit(False)) | (pairs["start"] == pairs["target"])).alias("reached"))


def orphans(edges: DataFrame, objects: DataFrame) -> DataFrame:
    ends = edges.select(F.col("parent_id").alias("id")).union(edges.select(F.col("child_id").alias("id"))).distinct()
    return ends.join(objects.select("id"), "id", "left_anti")


def _dependencies(edges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEPENDS_ON edges, and the blockers (start) among their children: live nodes that can't be reconstructed, or no objects."""
    depends = edges.filter("kind = 'DEPENDS_ON'").select("parent_id", "child_id")
    child = objects.select(F.col("id").alias("start"), F.col("recompute_cost").isNotNull().alias("remade"), (F.col("lifecycle_state") == "RECLAIMED").alias("dead"))
    nodes = depends.select(F.col("child_id").alias("start")).distinct()
    return depends, nodes.join(child, "start", "left").filter(~F.coalesce("remade", F.lit(False)) & ~F.coalesce("dead", F.lit(False))).select("start")


def unsafe_ids(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(id): what ``unsafe`` finds, as a set: each round adds the parents of the last one's nodes."""
    depends, blockers = _dependencies(edges, objects)
    depends = _held(depends.dropna().distinct())
    frontier = _held(depends.join(blockers.withColumnRenamed("start", "child_id"), "child_id", "left_semi").select(F.col("parent_id").alias("id")).distinct())
    rounds = [frontier]
    while not frontier.isEmpty():
        parents = depends.join(frontier.withColumnRenamed("id", "child_id"), "child_id", "left_semi").select(F.col("parent_id").alias("id")).distinct()
        frontier = _held(parents.join(reduce(DataFrame.union, rounds), "id", "left_anti"))
        rounds.append(frontier)
    return reduce(DataFrame.union, rounds)


def unsafe(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, n_blockers): objects from which a live node that can't be reconstructed is reachable over DEPENDS_ON.

    Runs backwards from those blockers, through nodes of any state; a node that
    is no object can't be reconstructed.
    """
    depends, blockers = _dependencies(edges, objects)
    return closure(depends, blockers, reverse=True).filter("start <> node").groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n_blockers"))


def superseded(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): parents that a child supersedes, both in ``ids``."""
    s = edges.filter("kind = 'SUPERSEDES'")
    return s.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(ids.select(F.col("id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("id")).distinct()


def neighbours(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, neighbour, kind, direction) of both ends of each edge."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    out = e.select(F.col("parent_id").alias("id"), F.col("child_id").alias("neighbour"), "kind", F.lit("out").alias("direction"))
    return out.union(e.select(F.col("child_id").alias("id"), F.col("parent_id").alias("neighbour"), "kind", F.lit("in").alias("direction")))


def all_edges(edges: DataFrame) -> DataFrame:
    rank = reduce(lambda w, k: w.when(F.col("kind") == k, EDGE_KINDS.index(k)), EDGE_KINDS, F)
    return edges.orderBy("parent_id", "child_id", rank)


def dependent_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'DEPENDS_ON'").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer): rounds in which nodes lose their last incoming edge (Kahn); nodes on or behind a cycle have a null layer."""
    rest = _held(edges.select("parent_id", "child_id").distinct())
    nodes = _held(rest.select(F.col("parent_id").alias("id")).union(rest.select(F.col("child_id").alias("id"))).distinct())
    done, layer = [], 0
    while not nodes.isEmpty():
        free = _held(nodes.join(rest.select(F.col("child_id").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            done.append(nodes.withColumn("layer", F.lit(None).cast("int")))
            break
        done.append(free.withColumn("layer", F.lit(layer)))
        nodes = _held(nodes.join(free, "id", "left_anti"))
        rest = _held(rest.join(free.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti"))
        layer += 1
    return reduce(DataFrame.union, done) if done else nodes.withColumn("layer", F.lit(None).cast("int"))


def edge_problems(new: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """``new`` edges with problem: SELF_EDGE, UNKNOWN_ENDPOINT, CYCLE (by the batch together with ``edges``), DUPLICATE (no error) or null (G-01)."""
    c = F.col
    keys = ["parent_id", "child_id", "kind"]
    ids = objects.select("id").withColumn("known", F.lit(True))
    checked = (
        new.select(*keys)
        .join(ids.select(c("id").alias("parent_id"), c("known").alias("k1")), "parent_id", "left")
        .join(ids.select(c("id").alias("child_id"), c("known").alias("k2")), "child_id", "left")
        .join(edges.select(*keys).distinct().withColumn("old", F.lit(True)), keys, "left")
    )
    good = new.filter("parent_id <> child_id").select(*keys)
    both = edges.select(*keys).union(good).distinct()
    cyclic = layers(both).filter("layer is null").select("id")
    loops = good.join(cyclic.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").join(cyclic.withColumnRenamed("id", "child_id"), "child_id", "left_semi")
    back = reaches(both, loops.select(c("child_id").alias("start"), c("parent_id").alias("target")).distinct()).filter("reached").select(c("start").alias("child_id"), c("target").alias("parent_id"), F.lit(True).alias("loop"))
    problem = F.when(c("parent_id") == c("child_id"), "SELF_EDGE").when(c("k1").isNull() | c("k2").isNull(), "UNKNOWN_ENDPOINT").when(c("old"), "DUPLICATE").when(c("loop"), "CYCLE")
    return checked.join(back, ["parent_id", "child_id"], "left").select(*keys, problem.alias("problem"))


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges`` without those in ``gone`` (G-02)."""
    return edges.join(gone, ["parent_id", "child_id", "kind"], "left_anti")


def without_object(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``edges`` without those that touch any of ``ids`` (W-04)."""
    return edges.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").join(ids.select(F.col("id").alias("child_id")), "child_id", "left_anti").select(*edges.columns)
