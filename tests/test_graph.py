import itertools
import random

import pytest

from lodestone.operators import graph


def frame(spark, edges, a="src", b="dst"):
    return spark.createDataFrame(edges, f"{a} string, {b} string")


def brandes(edges):
    nodes = {n for e in edges for n in e}
    after = {n: {b for a, b in edges if a == n} for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, ways, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in after[v]:
                if w not in dist:
                    dist[w], ways[w], before[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
        for w in order:
            if w != s:
                score[w] += share[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


@pytest.fixture(scope="module")
def edges():
    rnd = random.Random(7)
    return sorted({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(30)} - {(f"n{i}", f"n{i}") for i in range(14)})


def test_betweenness(spark, edges):
    got = {r.node: r.betweenness for r in graph.betweenness(frame(spark, edges)).collect()}
    want = brandes(edges)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 and 0 <= got[k] <= 1 for k in got)


def test_exact_betweenness_in_lots(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "PIVOTS", 3)
    got = {r.node: r.betweenness for r in graph.betweenness(frame(spark, edges), None).collect()}
    want = brandes(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("compact", [100, 0])
def test_exact_betweenness_on_arrays_and_beyond(spark, edges, monkeypatch, compact):
    monkeypatch.setattr(graph, "COMPACT", compact)
    monkeypatch.setattr(graph, "TOUCHED", 150)
    if compact:  # rounds of joins over pivots times nodes took too long
        monkeypatch.setattr(graph, "_dependencies", None)
    got = {r.node: r.betweenness for r in graph.betweenness(frame(spark, edges), None).collect()}
    want = brandes(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_pagerank_stops_when_ranks_settle(spark, edges):
    few = {r.node: r.pagerank for r in graph.pagerank(frame(spark, edges), rounds=60, tolerance=1e-3).collect()}
    many = {r.node: r.pagerank for r in graph.pagerank(frame(spark, edges), rounds=60).collect()}
    assert few.keys() == many.keys() and 0 < sum(abs(few[k] - many[k]) for k in few) < 1e-2


def test_pagerank_sums_to_one(spark, edges):
    ranks = {r.node: r.pagerank for r in graph.pagerank(frame(spark, [*edges, ("n1", "sink"), ("n2", "sink")]), rounds=12).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9


def test_degrees_ego_dit(spark, rows):
    e = frame(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), (None, "x")])
    assert rows(graph.degrees(e)) == [("a", 0, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 0)]
    assert rows(graph.ego(e, "b", 1)) == [("a", "b"), ("b", "c")]
    links = frame(spark, [("b", "a"), ("c", "b"), ("c", "z")], "child", "parent")
    assert rows(graph.dit(links)) == [("a", 0), ("b", 1), ("c", 2), ("z", 0)]
    assert rows(graph.impact(links, spark.createDataFrame([("a",)], "via string"))) == [("b", "a", 1), ("c", "a", 2)]
    assert rows(graph.subtree_edges(links, "a")) == [("b", "a"), ("c", "b")]


def test_dead_code(spark, rows):
    procs = spark.createDataFrame(
        [("w", "open", "event", 1, "confirmed"), ("w", "of_a", "function", 2, "confirmed"), ("w", "of_a", "function", None, "confirmed"), ("w", "of_dead", "function", 3, "confirmed"), ("p", "m", "function", 1, "confirmed"), ("c", "m", "function", 1, "confirmed"), ("g", "ghost", "function", 1, "speculative"), ("w", "of_chain", "function", 4, "confirmed"), ("w", "of_chain", "function", 9, "confirmed")],
        "object string, proc_name string, proc_type string, cyclomatic int, confidence string",
    )
    calls = spark.createDataFrame([("w", "open", "OF_A", None, None), ("w", "of_a", "x.m", "p", "m"), ("w", "of_dead", "of_chain", "w", "of_chain")], "object string, proc_name string, to_name string, target_object string, target_proc string")
    links = frame(spark, [("c", "p")], "child", "parent")
    dead = graph.dead_procs(procs, calls, links, spark.createDataFrame([], "object string"))
    assert rows(dead) == [("w", "of_chain"), ("w", "of_dead")]
    assert rows(graph.dead_code(procs, calls, dead)) == [("w", "of_chain", "function", 9, "low", 1, 1), ("w", "of_dead", "function", 3, "high", 0, 0)]
    statements = spark.createDataFrame([("w", "of_dead"), ("w", "of_a"), ("w", "of_a")], "object string, proc_name string")
    assert rows(graph.live_procs(statements, dead)) == [("w", "of_a"), ("w", "of_a")]


def test_implied_keys_both_directions(spark, rows):
    joined = frame(spark, [("a", "b"), ("c", "d"), ("e", "f")], "x", "y")
    declared = frame(spark, [("a", "b"), ("d", "c"), ("q", "r")], "x", "y")
    assert rows(graph.implied_keys(joined, declared)) == [("e", "f")]


def test_coslice_and_choice(spark, rows):
    legs = spark.createDataFrame([("c1", "s1", "reads", "sql"), ("s1", "c2", "writes", "sql"), ("c2", "s2", "reads", "sql"), ("s2", "c1", "writes", "sql"), ("c1", "s1", "fk", "ddl")], "src string, dst string, kind string, source string")
    seeds = spark.createDataFrame([("c1",)], "seed string")
    targets = spark.createDataFrame([("s1",), ("s2",)], "node string")
    out = graph.coslice(legs, seeds, targets)
    ways = {(t, d): [x[1:] for x in sorted(g)] for (t, d), g in itertools.groupby(sorted((r.target_key, r.direction, r.leg_ordinal, r.leg_from, r.leg_to) for r in out.collect()), key=lambda x: x[:2])}
    assert [x[1:] for x in ways[("s2", "forward")]] == [(0, "c1", "s1"), (1, "s1", "c2"), (2, "c2", "s2")]
    assert [x[1:] for x in ways[("s2", "backward")]] == [(0, "s2", "c1")]
    assert [x[1:] for x in ways[("s1", "backward")]] == [(0, "s1", "c2"), (1, "c2", "s2"), (2, "s2", "c1")]
    assert rows(graph.path_choice(out), "target_key", "direction", "leg_from") == [("s1", "forward", "c1"), ("s2", "backward", "s2")]
