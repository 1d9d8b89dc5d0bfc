"""Seeded closure of a labelled relation: one semi-naive loop with a pluggable label algebra.

A relation is (src, dst, label); a result is (seed, node, label). Seeds are a column,
so any number of them share the loop. Each round joins only the labels that improved
in the round before, combines them per (seed, node) with a map-side aggregate and keeps
the improvements; the rounds are written to the shared checkpoint folder, with the
count of improvements taken in the same job. Hot nodes are left to adaptive skew joins,
hot aggregates to partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, cut_counting

#: Rounds after which what was found is written as one frame, so that a loop of any length reads few.
TOGETHER = 8


@dataclass(frozen=True)
class Algebra:
    """How labels go along an edge and meet at a node.

    one: the label of a seed; extend(label, edge label): along an edge; combine: the
    aggregate of labels that meet; better(new, old): whether new improves on old.
    """

    one: Column
    extend: Callable[[Column, Column], Column]
    combine: Callable[[Column], Column]
    better: Callable[[Column, Column], Column]


def boolean() -> Algebra:
    """Reachability."""
    return Algebra(F.lit(True), lambda a, _: F.lit(True), lambda x: F.bool_or(x), lambda new, old: ~old & new)


def hops() -> Algebra:
    """The least number of edges."""
    return Algebra(F.lit(0), lambda a, _: a + 1, F.min, lambda new, old: new < old)


def min_plus() -> Algebra:
    """The least sum of edge weights (doubles, not negative)."""
    return Algebra(F.lit(0.0), lambda a, w: a + w, F.min, lambda new, old: new < old)


def set_union() -> Algebra:
    """Sets of tags, all of those on any way; an edge's label is a sorted array."""
    union = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x))))
    return Algebra(F.array().cast("array<string>"), lambda a, e: F.array_sort(F.array_union(a, e)), union, lambda new, old: F.size(F.array_except(new, old)) > 0)


def from_edges(edges: DataFrame, algebra: Algebra) -> DataFrame:
    """(src, dst, label) with parallel edges combined; without a label column each edge has the algebra's step from ``one``."""
    if "label" not in edges.columns:
        edges = edges.withColumn("label", F.lit(1.0))
        return edges.groupBy("src", "dst").agg(F.first("label").alias("label"))
    return edges.groupBy("src", "dst").agg(algebra.combine(F.col("label")).alias("label"))


def rel_union(a: DataFrame, b: DataFrame, algebra: Algebra) -> DataFrame:
    """The union of two relations, labels that meet being combined."""
    return a.unionByName(b).groupBy("src", "dst").agg(algebra.combine(F.col("label")).alias("label"))


def rel_product(a: DataFrame, b: DataFrame, algebra: Algebra) -> DataFrame:
    """The product of two relations: labels along each pair of edges, combined per end points."""
    right = b.select(F.col("src").alias("dst"), F.col("dst").alias("_end"), F.col("label").alias("_label"))
    both = a.join(right, "dst").select("src", F.col("_end").alias("dst"), algebra.extend(F.col("label"), F.col("_label")).alias("label"))
    return both.groupBy("src", "dst").agg(algebra.combine(F.col("label")).alias("label"))


def closure(edges: DataFrame, seeds: DataFrame, algebra: Algebra | None = None, zero_hops: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(seed, node, label) of all nodes that seeds reach.

    edges: (src, dst[, label]); seeds: (seed). With zero_hops a seed reaches itself
    with the label ``one``; without it, only over a real cycle. max_rounds bounds the
    number of edges on a way. Edges or seeds that are NULL, repeated edges and loops
    are harmless; empty inputs give an empty result (or just the seeds).
    """
    algebra = algebra or boolean()
    relation = cut(from_edges(edges.where("src is not null and dst is not null"), algebra))
    start = seeds.where("seed is not null").select("seed").distinct()
    delta, n = cut_counting(start.select("seed", F.col("seed").alias("node"), algebra.one.alias("label")))
    known = delta if zero_hops else None
    rounds = 0
    while n and (max_rounds is None or rounds < max_rounds):
        step = delta.join(relation.withColumnRenamed("label", "_edge"), F.col("node") == F.col("src"))
        step = step.select("seed", F.col("dst").alias("node"), algebra.extend(F.col("label"), F.col("_edge")).alias("label"))
        step = step.groupBy("seed", "node").agg(algebra.combine(F.col("label")).alias("label"))
        if known is not None:
            old = known.select("seed", "node", F.col("label").alias("_old"))
            step = step.join(old, ["seed", "node"], "left")
            step = step.where(F.col("_old").isNull() | algebra.better(F.col("label"), F.col("_old"))).drop("_old")
        delta, n = cut_counting(step)
        known = delta if known is None else _merge(known, delta, algebra)
        rounds += 1
        if rounds % TOGETHER == 0:
            known, _ = cut_counting(known)
    return known if known is not None else delta.limit(0)


def _merge(known: DataFrame, delta: DataFrame, algebra: Algebra) -> DataFrame:
    return known.unionByName(delta).groupBy("seed", "node").agg(algebra.combine(F.col("label")).alias("label"))


def reach(edges: DataFrame, seeds: DataFrame, zero_hops: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(seed, node, hops) breadth first: a label once found is the least, so rounds only add rows."""
    arcs = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    start = seeds.where("seed is not null").select("seed").distinct()
    delta, n = cut_counting(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    found: list[DataFrame] = [delta] if zero_hops else []
    rounds = 0
    while n and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        step = delta.join(arcs, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        if found:
            step = step.join(reduce(DataFrame.unionByName, found).select("seed", "node"), ["seed", "node"], "left_anti")
        delta, n = cut_counting(step.withColumn("hops", F.lit(rounds)))
        if n:
            found = _together(found, delta)
    return reduce(DataFrame.unionByName, found) if found else delta


def _together(found: list[DataFrame], delta: DataFrame) -> list[DataFrame]:
    """The frames with one more; TOGETHER of them become one."""
    found = [*found, delta]
    return found if len(found) <= TOGETHER else [cut(reduce(DataFrame.unionByName, found).coalesce(delta.sparkSession.sparkContext.defaultParallelism))]


def all_pairs(edges: DataFrame) -> DataFrame:
    """(seed, node, hops) from every node that has an edge, by squaring: as many rounds as the longest shortest way has binary digits.

    A node reaches itself only over a cycle. For all seeds at once; for a few, ``reach``
    does less work.
    """
    one = edges.where("src is not null and dst is not null").select(F.col("src").alias("seed"), F.col("dst").alias("node")).distinct()
    known, n = cut_counting(one.withColumn("hops", F.lit(1)))
    grown = n > 0
    while grown:
        right = known.select(F.col("seed").alias("node"), F.col("node").alias("_end"), F.col("hops").alias("_hops"))
        longer = known.join(right, "node").select("seed", F.col("_end").alias("node"), (F.col("hops") + F.col("_hops")).alias("hops"), F.lit(0).alias("_old"))
        both = longer.union(known.select("seed", "node", "hops", F.lit(1).alias("_old"))).groupBy("seed", "node")
        merged = both.agg(F.min("hops").alias("hops"), F.min(F.when(F.col("_old") == 1, F.col("hops"))).alias("_had"))
        known, better = cut_counting(merged, F.col("_had").isNull() | (F.col("hops") < F.col("_had")))
        known, grown = known.select("seed", "node", "hops"), better > 0
    return known


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) that any seed reaches, seeds included: no seed column, so the state is at most one row per node."""
    together = seeds.select(F.lit(0).alias("seed"), F.col("seed").alias("node")).where("node is not null").distinct()
    arcs = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    delta, n = cut_counting(together.select("node"))
    found = [delta]
    while n:
        step = delta.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        delta, n = cut_counting(step.join(reduce(DataFrame.unionByName, found), "node", "left_anti"))
        if n:
            found = _together(found, delta)
    return reduce(DataFrame.unionByName, found)


def witness_legs(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(seed, target, leg_ord, leg_from, leg_to, kind): one leg per ordinal of a shortest way from each seed to each target.

    edges: (src, dst, kind); dist: the result of ``reach``. The leg of an ordinal is the
    least (from, to) among those on any shortest way; kind the least of parallel edges.
    Found by walking back from all targets at once, one round per hop.
    """
    arcs = edges.groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    near = dist.select("seed", F.col("node").alias("src"), F.col("hops").alias("_h"))
    tight = arcs.join(near, "src").join(dist.select("seed", F.col("node").alias("dst"), "hops"), ["seed", "dst"])
    tight, n = cut_counting(tight.where("hops = _h + 1").select("seed", "src", "dst", "kind", "hops"))
    ends = dist.where("hops > 0").select("seed", F.col("node").alias("target"), F.col("node").alias("at"), F.col("hops").alias("left"))
    legs: list[DataFrame] = []
    while n:
        step = ends.join(tight.select("seed", F.col("dst").alias("at"), "src", "kind"), ["seed", "at"])
        step, n = cut_counting(step.select("seed", "target", (F.col("left") - 1).alias("leg_ord"), F.col("src").alias("leg_from"), F.col("at").alias("leg_to"), "kind"))
        legs.append(step.groupBy("seed", "target", "leg_ord").agg(F.min(F.struct("leg_from", "leg_to", "kind")).alias("x")).select("seed", "target", "leg_ord", "x.*"))
        ends = step.where("leg_ord > 0").select("seed", "target", F.col("leg_from").alias("at"), F.col("leg_ord").alias("left")).distinct()
        if n:
            ends, n = cut_counting(ends)
    return reduce(DataFrame.unionByName, legs) if legs else tight.select("seed", F.col("dst").alias("target"), F.col("hops").alias("leg_ord"), F.col("src").alias("leg_from"), F.col("dst").alias("leg_to"), "kind").limit(0)
