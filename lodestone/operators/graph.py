"""Graph operators over edge tables: inheritance walks, metrics, dead procedures, risk and implied keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import fixpoint
from lodestone.operators import parts as connected
from lodestone.session import cut, cut_counting

#: Exact betweenness up to so many nodes, as many pivots beyond.
PIVOTS = 500
#: Edges and nodes up to which exact betweenness holds the graph in each task, and cells and edges that a task works on at once.
COMPACT, TOUCHED = 8_000_000, 8_000_000


def _edges(links: DataFrame, src: str, dst: str) -> DataFrame:
    return links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def _name(links: DataFrame, name: str) -> DataFrame:
    return links.sparkSession.createDataFrame([(name,)], "seed string")


def ancestors(links: DataFrame, name: str) -> DataFrame:
    """(depth, parent) of one name, nearest first; a cycle ends where it closes. links: (child, parent)."""
    return fixpoint.reach(_edges(links, "child", "parent"), _name(links, name), zero_hops=False).select(F.col("hops").alias("depth"), F.col("node").alias("parent"))


def descendants(links: DataFrame, name: str) -> DataFrame:
    """(descendant) of one name, distinct."""
    return fixpoint.reach(_edges(links, "parent", "child"), _name(links, name), zero_hops=False).select(F.col("node").alias("descendant"))


def impact(links: DataFrame, direct: DataFrame, depth: int = 15) -> DataFrame:
    """(descendant, via, depth): what inherits from each of ``direct`` (via) within ``depth`` steps, with the least depth.

    By squaring: in a hierarchy all pairs are the names times their depth, and the rounds
    are the logarithm of the depth; from the seeds it would be a round per level.
    """
    found = fixpoint.all_pairs(_edges(links, "parent", "child")).where(F.col("hops") <= depth)
    found = found.join(direct.select(F.col("via").alias("seed")).distinct(), "seed", "left_semi")
    return found.select(F.col("node").alias("descendant"), F.col("seed").alias("via"), F.col("hops").alias("depth"))


def subtree_edges(links: DataFrame, root: str) -> DataFrame:
    """(child, parent) edges of the tree below a root."""
    inside = descendants(links, root).union(links.sparkSession.createDataFrame([(root,)], "descendant string")).distinct()
    edges = links.where("child is not null and parent is not null").select("child", "parent").distinct()
    return edges.join(inside.withColumnRenamed("descendant", "parent"), "parent", "left_semi").select("child", "parent")


def ego(edges: DataFrame, focal: str, radius: int) -> DataFrame:
    """(src, dst) edges among the nodes within ``radius`` undirected steps of a node."""
    arcs = _edges(edges, "src", "dst")
    around = fixpoint.reach(arcs.union(arcs.select("dst", "src")), _name(edges, focal), max_rounds=radius).select("node")
    return arcs.join(around.withColumnRenamed("node", "src"), "src", "left_semi").join(around.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of the simple digraph: parallel edges count once."""
    arcs = _edges(edges, "src", "dst")
    ends = arcs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tolerance: float = 0.0) -> DataFrame:
    """(node, pagerank) after ``rounds`` power iterations, or when ranks changed by less than ``tolerance`` in sum since four rounds ago; ranks sum to 1, dangling mass is spread evenly.

    A rank moves along distinct edges weighted by 1 / out-degree; sums are aggregated
    map-side, so a node that everything points at is no hot task.
    """
    arcs = _edges(edges, "src", "dst")
    out = arcs.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = cut(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct().join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    arcs = cut(arcs)
    ranks = last = nodes.withColumn("pagerank", F.lit(1.0 / n))
    for k in range(rounds):
        loose = ranks.where("deg is null").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("loose"))
        sent = arcs.join(ranks.select(F.col("node").alias("src"), (F.col("pagerank") / F.col("deg")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        got = nodes.join(sent, "node", "left").join(F.broadcast(loose), F.lit(True))  # one row
        ranks = got.select("node", "deg", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("pagerank"))
        if k % 4 == 3:
            ranks = cut(ranks)
            if tolerance:
                moved = ranks.join(last.select("node", F.col("pagerank").alias("_old")), "node").agg(F.sum(F.abs(F.col("pagerank") - F.col("_old")))).first()[0]
                if moved < tolerance:
                    break
            last = ranks
    return ranks.select("node", "pagerank")


def betweenness(edges: DataFrame, pivots: int | None = PIVOTS, seed: int = 1) -> DataFrame:
    """(node, betweenness), normalised for a directed graph; exact up to ``pivots`` nodes, from pivots chosen by hash beyond.

    pivots None takes every node as one and is exact for any size: pivots are shared out
    among tasks that hold the graph as arrays, or beyond COMPACT PIVOTS go at a time.
    """
    arcs, m = cut_counting(_edges(edges, "src", "dst"))
    nodes = cut(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct())
    n = nodes.count()
    if pivots is None and 0 < max(n, m) <= COMPACT:
        total, used = _all_dependencies(arcs, nodes, n, seed), n
    elif pivots is None:
        lots = max(-(-n // PIVOTS), 1)
        placed = cut(nodes.withColumn("_lot", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(lots))))
        parts = [p for k in range(lots) if (p := _dependencies(arcs, placed.where(F.col("_lot") == k).select("node"))) is not None]
        total, used = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("part").alias("part")) if parts else None, n
    else:
        total, used = _dependencies(arcs, nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(pivots)), min(n, pivots)
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def _dependencies(arcs: DataFrame, chosen: DataFrame) -> DataFrame | None:
    """(node, part): what the shortest ways from the chosen nodes (node) put on each other node; None if there are none.

    Counts of shortest ways go outward from all pivots together, a level per round, and
    each node's share of them back again; a level's sums are aggregated map-side.
    """
    level, open_ = cut_counting(chosen.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("ways")))
    levels = []
    while open_:
        levels.append(level)
        step = level.join(arcs, F.col("node") == F.col("src")).groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        seen = reduce(DataFrame.unionByName, levels).select("pivot", "node")
        level, open_ = cut_counting(step.join(seen, ["pivot", "node"], "left_anti"))
    share, shares = None, []
    for near, far in zip(levels[-2::-1], levels[:0:-1], strict=True):
        far = far.withColumn("share", F.lit(0.0)) if share is None else far.join(share, ["pivot", "node"], "left").na.fill(0.0, ["share"])
        part = far.select("pivot", F.col("node").alias("dst"), ((1 + F.col("share")) / F.col("ways")).alias("part"))
        back = near.join(arcs, F.col("node") == F.col("src")).join(part, ["pivot", "dst"])
        share = cut(back.groupBy("pivot", "node").agg(F.sum(F.col("ways") * F.col("part")).alias("share")))
        shares.append(share.where("pivot <> node"))
    if not shares:
        return None
    return cut(reduce(DataFrame.unionByName, shares).groupBy("node").agg(F.sum("share").alias("part")))


def _all_dependencies(arcs: DataFrame, nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, part) as of ``_dependencies`` with all nodes chosen, which are numbered by hash, so that tasks are alike."""
    spark = arcs.sparkSession
    numbered = cut(nodes.select("node", (F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), "node"), "node")) - 1).alias("id")))
    ends = numbered.select(F.col("node").alias("src"), F.col("id").alias("a")), numbered.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    pairs = arcs.join(ends[0], "src").join(ends[1], "dst").select("a", "b").toArrow()
    graph_ = spark.sparkContext.broadcast((pairs["a"].to_numpy(), pairs["b"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = graph_.value
        walker = connected.Walker(n, src, dst, max(TOUCHED // (n + len(src)), 1) * n)
        ways, share, total = np.zeros(walker.lot * n), np.zeros(walker.lot * n), np.zeros(n)
        for batch in batches:
            for lot in walker.lots(batch["id"].to_numpy()):
                levels, legs = walker.walk(lot)
                ways[levels[0]] = 1
                for out, to in legs:
                    np.add.at(ways, to, ways[out])
                for out, to in reversed(legs):
                    np.add.at(share, out, ways[out] * (1 + share[to]) / ways[to])
                share[levels[0]] = 0
                cells = np.concatenate(levels)
                np.add.at(total, cells % n, share[cells])
                ways[cells] = share[cells] = 0
                walker.forget(levels)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int32()), "part": pa.array(total[some])})

    pivots = spark.range(0, n, 1, min(n, 8 * spark.sparkContext.defaultParallelism))
    return pivots.mapInArrow(run, "id int, part double").groupBy("id").agg(F.sum("part").alias("part")).join(numbered, "id").select("node", "part")


def dit(links: DataFrame) -> DataFrame:
    """(name, dit): the greatest over all roots of the least number of steps from the root. links: (child, parent)."""
    edges = _edges(links, "parent", "child")
    roots = edges.select(F.col("src").alias("seed")).distinct().join(edges.select(F.col("dst").alias("seed")), "seed", "left_anti")
    # By squaring, as in ``impact``.
    below = fixpoint.all_pairs(edges).join(roots, "seed", "left_semi").select(F.col("node").alias("name"), "hops")
    return below.union(roots.select("seed", F.lit(0))).groupBy("name").agg(F.max("hops").alias("dit"))


def last_segment(name: Column) -> Column:
    """The text after the last dot, lower case."""
    return F.lower(F.element_at(F.split(name, "[.]"), -1))


def _node(object_: str, proc: str) -> Column:
    return F.struct(F.col(object_).alias("object"), F.col(proc).alias("proc"))


def call_edges(procs: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst) of procedures, as structs (object, proc): same-object name matches and resolved calls, distinct."""
    refs = calls.select("object", "proc_name", last_segment(F.col("to_name")).alias("callee")).distinct()
    known = procs.select("object", F.lower("proc_name").alias("callee"), F.col("proc_name").alias("callee_proc")).distinct()
    named = refs.join(known, ["object", "callee"]).select(_node("object", "proc_name").alias("src"), _node("object", "callee_proc").alias("dst"))
    resolved = calls.where("target_object is not null and target_proc is not null").select(_node("object", "proc_name").alias("src"), _node("target_object", "target_proc").alias("dst"))
    return named.union(resolved).distinct()


def override_edges(procs: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): a parent's method to the same method of each of its descendants."""
    up = fixpoint.all_pairs(_edges(links, "child", "parent")).select(F.col("seed").alias("child"), F.col("node").alias("parent"))
    methods = procs.select("object", "proc_name").distinct()
    both = up.join(methods.withColumnRenamed("object", "parent"), "parent").join(methods.withColumnRenamed("object", "child"), ["child", "proc_name"])
    return both.select(_node("parent", "proc_name").alias("src"), _node("child", "proc_name").alias("dst"))


def dead_procs(procs: DataFrame, calls: DataFrame, links: DataFrame, reports: DataFrame) -> DataFrame:
    """(object, proc_name) of procedures that no entry reaches over calls and overrides.

    Entries are events, on-blocks and whatever a report's expressions call from;
    speculative procedures take no part. reports: (object).
    """
    procs = procs.where("confidence <> 'speculative'")
    entry = procs.where(F.col("proc_type").isin("event", "on")).select(_node("object", "proc_name").alias("seed"))
    entry = entry.union(calls.join(reports.select("object").distinct(), "object", "left_semi").select(_node("object", "proc_name").alias("seed")))
    live = fixpoint.reached(call_edges(procs, calls).union(override_edges(procs, links)), entry)
    live = live.select(F.col("node.object").alias("object"), F.col("node.proc").alias("proc_name"))
    return procs.select("object", "proc_name").distinct().join(live, ["object", "proc_name"], "left_anti")


def dead_code(procs: DataFrame, calls: DataFrame, dead: DataFrame) -> DataFrame:
    """The report on dead procedures: callers by name only and by resolved target, confidence, the most complex overload.

    No caller by name anywhere is ``high``, one by name but none resolved ``medium``, else ``low``.
    """
    naive = calls.select("object", "proc_name", last_segment(F.col("to_name")).alias("callee")).distinct().groupBy("callee").agg(F.count("*").alias("caller_count_naive"))
    scoped = calls.where("target_object is not null and target_proc is not null").groupBy(F.col("target_object").alias("object"), F.col("target_proc").alias("proc_name")).agg(F.count("*").alias("caller_count_scoped"))
    meta = procs.where("confidence <> 'speculative'").select("object", "proc_name", "proc_type", "cyclomatic")
    best = W.partitionBy("object", "proc_name").orderBy(F.col("cyclomatic").desc_nulls_last(), F.col("proc_type").asc_nulls_last())
    meta = meta.join(dead, ["object", "proc_name"]).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("callee", F.lower("proc_name"))
    out = meta.join(naive, "callee", "left").join(scoped, ["object", "proc_name"], "left")
    level = F.when(F.col("caller_count_naive").isNull(), "high").when(F.col("caller_count_scoped").isNull(), "medium").otherwise("low")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("object", "proc_name", "proc_type", "cyclomatic", level.alias("confidence"), zero("caller_count_naive"), zero("caller_count_scoped"))


def live_procs(statements: DataFrame, dead: DataFrame) -> DataFrame:
    """(object, proc_name) per statement whose procedure is not dead; duplicates stay."""
    return statements.select("object", "proc_name").join(dead, ["object", "proc_name"], "left_anti")


def reaches(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(x, y, hops): y is downstream of x; a node reaches itself only over a cycle."""
    arcs = _edges(edges, "src", "dst")
    found = fixpoint.all_pairs(arcs) if seeds is None else fixpoint.reach(arcs, seeds, zero_hops=False)
    return found.select(F.col("seed").alias("x"), F.col("node").alias("y"), "hops")


def risk_count(closure: DataFrame) -> DataFrame:
    """(x, n): how many nodes are downstream of x."""
    return closure.groupBy("x").agg(F.count("*").alias("n"))


def implied_keys(joined: DataFrame, declared: DataFrame) -> DataFrame:
    """Join edges (x, y) that no declared key has in either direction; duplicates stay."""
    keys = declared.select("x", "y")
    return joined.join(keys, ["x", "y"], "left_anti").join(keys.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_anti")


def leg_priority(legs: DataFrame) -> DataFrame:
    """One leg per (src, dst): writes before retrieve before others, then by kind and source."""
    rank = F.when(F.col("kind") == "writes", 0).when(F.col("kind") == "retrieve", 1).otherwise(2)
    first = W.partitionBy("src", "dst").orderBy(rank, "kind", F.col("source").asc_nulls_last())
    return legs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def coslice(legs: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """Shortest ways from each seed column to each statement, forward and backward, a leg per row.

    legs: (src, dst, kind, source); seeds: (seed); targets: (node). Result: seed_key,
    target_key, direction, leg_ordinal, leg_from, leg_to, leg_kind, leg_source. Backward
    ways are numbered from the target.
    """
    legs = cut(leg_priority(legs))
    goal = targets.select(F.col("node").alias("target")).distinct()
    parts = []
    for direction, arcs in (("forward", legs.select("src", "dst", "kind")), ("backward", legs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))):
        dist = fixpoint.reach(arcs, seeds)
        dist = cut(dist)
        legs_of = fixpoint.witness_legs(arcs, dist).join(goal, "target", "left_semi")
        if direction == "backward":
            last = dist.select("seed", F.col("node").alias("target"), (F.col("hops") - 1).alias("_last"))
            legs_of = legs_of.join(last, ["seed", "target"]).select("seed", "target", (F.col("_last") - F.col("leg_ord")).alias("leg_ord"), F.col("leg_to").alias("leg_from"), F.col("leg_from").alias("leg_to"), "kind")
        parts.append(legs_of.withColumn("direction", F.lit(direction)))
    both = parts[0].unionByName(parts[1])
    source = legs.select(F.col("src").alias("leg_from"), F.col("dst").alias("leg_to"), F.col("kind"), F.col("source").alias("leg_source"))
    out = both.join(source, ["leg_from", "leg_to", "kind"], "left")
    return out.select(F.col("seed").alias("seed_key"), F.col("target").alias("target_key"), "direction", F.col("leg_ord").alias("leg_ordinal"), "leg_from", "leg_to", F.col("kind").alias("leg_kind"), F.coalesce("leg_source", F.lit("")).alias("leg_source"))


def _ends(legs: DataFrame, seed: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, targets): the nodes of legs that meet the conditions on ``node``."""
    ends = legs.select(F.col("src").alias("node")).union(legs.select("dst")).where("node is not null").distinct()
    return ends.where(seed).select(F.col("node").alias("seed")), ends.where(target)


def _way_lengths(ways: DataFrame) -> DataFrame:
    return ways.groupBy("seed_key", "target_key", "direction").agg(F.count("*").alias("n_legs"), F.min("leg_ordinal").alias("first"), F.max("leg_ordinal").alias("last"))


def coslice_lengths(legs: DataFrame, seed: str, target: str) -> DataFrame:
    """(seed_key, target_key, direction, n_legs, first, last) of the ways of ``coslice``: their number of legs, the least and the greatest ordinal.

    legs: (src, dst), repeated ones are harmless; seed, target: conditions on ``node``.
    A way's legs are its distance, so they are not walked back.
    """
    legs = legs.select("src", "dst")
    rows, large = connected.gather(legs)
    rows = rows.select("*", F.expr(seed).alias("seed"), F.expr(target).alias("target"))

    def run(table: pa.Table) -> Iterator[dict[str, list]]:
        part = connected.Part(table)
        names, goal, starts = np.array(part.names, dtype=object), part.marked(table["target"]), np.flatnonzero(part.marked(table["seed"]))
        for direction, src, dst in (("forward", part.src, part.dst), ("backward", part.dst, part.src)):
            walker = connected.Walker(part.n, src, dst)
            for lot in walker.lots(starts):
                levels, _ = walker.walk(lot)
                cells = np.concatenate(levels[1:] or [levels[0][:0]])
                cells = cells[goal[cells % part.n]]
                for k in range(0, len(cells), connected.BATCH):
                    some = cells[k : k + connected.BATCH]
                    n = walker.hops[some].astype(np.int64)
                    yield {"seed_key": names[lot[some // part.n]], "target_key": names[some % part.n], "direction": [direction] * len(some), "n_legs": n, "first": np.zeros(len(some), np.int32), "last": (n - 1).astype(np.int32)}
                walker.forget(levels)

    out = connected.per_bundle(rows, run, "seed_key string, target_key string, direction string, n_legs bigint, first int, last int")
    if large is None:
        return out
    legs = connected.within(legs, large).select("*", F.lit("").alias("kind"), F.lit("").alias("source"))
    return out.unionByName(_way_lengths(coslice(legs, *_ends(legs, seed, target))))


def chosen_ways(legs: DataFrame, seed: str, target: str) -> DataFrame:
    """What ``path_choice`` takes of ``coslice``; no target may be a seed.

    A target's way comes from its nearest seed, the least of those as near; so does the
    way to each node on it. So the walk keeps a row per node, and none per seed.
    """
    legs = legs.select("src", "dst", "kind", "source")
    rows, large = connected.gather(legs)
    rows = rows.select("*", F.expr(seed).alias("seed"), F.expr(target).alias("target"))
    schema = "seed_key string, target_key string, direction string, leg_ordinal int, leg_from string, leg_to string, leg_kind string, leg_source string"

    def run(table: pa.Table) -> Iterator[dict[str, list]]:
        part = connected.Part(table, lambda x: ({"writes": 0, "retrieve": 1}.get(x[0], 2), x[0] is not None, x[0] or "", x[1] is None, x[1] or ""))
        n, goal, starts = part.n, np.flatnonzero(part.marked(table["target"])), np.flatnonzero(part.marked(table["seed"]))
        near = [_nearest(n, *ends, starts) for ends in ((part.src, part.dst), (part.dst, part.src))]
        none = np.iinfo(np.int64).max
        rank = [np.where(hops[goal] > 0, hops[goal] * n + best[goal], none) for hops, best, _, _ in near]
        for k, direction in enumerate(("forward", "backward")):
            hops, best, out, to = near[k]
            mine = goal[(rank[0] < rank[1]) if k == 0 else (rank[1] <= rank[0]) & (rank[1] < none)]
            for pair, ordinal, a, b in connected.witnesses(n, mine, hops[mine], out, to):
                at = mine[pair]
                a, b, ordinal = (a, b, ordinal) if k == 0 else (b, a, hops[at] - 1 - ordinal)
                kinds = part.kind(a, b)
                name = lambda v: [part.names[i] for i in v]
                yield {"seed_key": name(best[at]), "target_key": name(at), "direction": [direction] * len(at), "leg_ordinal": ordinal.astype(np.int32), "leg_from": name(a), "leg_to": name(b), "leg_kind": [x[0] for x in kinds], "leg_source": [x[1] or "" for x in kinds]}

    out = connected.per_bundle(rows, run, schema)
    if large is None:
        return out
    legs = connected.within(legs, large)
    return out.unionByName(path_choice(coslice(legs, *_ends(legs, seed, target))))


def _nearest(n: int, src: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hops, best, from, to): each node's distance from the starts, the least start that is as near, and the steps of the shortest ways from it."""
    walker = connected.Walker(n, src, dst, n)
    hops, best = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    hops[starts], best[starts] = 0, starts
    front, legs = starts, []
    while len(front):
        out, to = walker.steps(front)
        new = hops[to] < 0
        out, to = out[new], to[new]
        np.minimum.at(best, to, best[out])
        hops[to] = hops[front[0]] + 1
        same = best[out] == best[to]
        legs.append((out[same], to[same]))
        front = np.unique(to)
    return hops, best, *(np.concatenate([x[k] for x in legs] or [starts[:0]]) for k in (0, 1))


def path_choice(legs: DataFrame) -> DataFrame:
    """Of the ways from several seeds to a target: the shorter of forward and backward (backward on ties), then the shortest seed's, the least seed on ties."""
    ways = legs.groupBy("seed_key", "target_key", "direction").agg(F.count("*").alias("n"))
    per_seed = W.partitionBy("seed_key", "target_key").orderBy("n", F.when(F.col("direction") == "backward", 0).otherwise(1))
    ways = ways.withColumn("_k", F.row_number().over(per_seed)).where("_k = 1")
    best = W.partitionBy("target_key").orderBy("n", "seed_key")
    ways = ways.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return legs.join(ways.select("seed_key", "target_key", "direction"), ["seed_key", "target_key", "direction"])


def object_metrics(calls: DataFrame, procs: DataFrame, links: DataFrame, rounds: int = 20) -> DataFrame:
    """(object, in_degree, out_degree, pagerank, betweenness, max_cyclomatic, avg_cyclomatic, dit, cbo) of each object.

    The call graph goes from the calling object to the name called; cbo stays NULL.
    calls: (object, to_name); procs: (object, cyclomatic); links: (child, parent).
    """
    edges = cut(calls.select(F.col("object").alias("src"), F.col("to_name").alias("dst")).where("src <> dst").distinct())
    by_proc = procs.groupBy("object").agg(F.max("cyclomatic").alias("max_cyclomatic"), F.avg("cyclomatic").alias("avg_cyclomatic"))
    depth = dit(links).withColumnRenamed("name", "object")
    on = lambda df: df.withColumnRenamed("node", "object")
    out = on(degrees(edges)).join(on(pagerank(edges, rounds=rounds)), "object").join(on(betweenness(edges)), "object")
    out = out.join(by_proc, "object", "left").join(depth, "object", "left")
    return out.withColumn("cbo", F.lit(None).cast("int"))
