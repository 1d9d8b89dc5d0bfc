import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, parts, taint
from lodestone.session import cut

LEGS = "src string, dst string, kind string, source string"
ENDS = ("node like 'c%'", "node like 's%'")


@pytest.fixture(scope="module")
def legs(spark):
    rnd = random.Random(5)
    out = []
    for group, many in enumerate((4, 7, 9, 2)):
        for _ in range(many * 3):
            column, statement = f"c{group}{rnd.randrange(many)}", f"s{group}{rnd.randrange(many)}"
            out.append((column, statement, "reads", "sql") if rnd.random() < 0.5 else (statement, column, "writes", "sql"))
            if rnd.random() < 0.2:
                out.append((*out[-1][:2], "fk", None))
    return spark.createDataFrame([*out, *out[:9], (None, "s1", "reads", "sql")], LEGS)


@pytest.fixture(scope="module")
def ways(legs):
    return cut(graph.coslice(legs, *graph._ends(legs, *ENDS)))


def no_pairs(monkeypatch):
    """All pairs on the disk are what broke: neither the loop over pairs nor the walk back of all of them may run."""
    monkeypatch.setattr(graph.fixpoint, "reach", None)
    monkeypatch.setattr(graph.fixpoint, "witness_legs", None)


def test_labels(spark, rows):
    arcs = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10)]
    got = dict(rows(parts.labels(spark.createDataFrame(arcs, "src long, dst long"))))
    groups = {frozenset(n for n, p in got.items() if p == part) for part in got.values()}
    assert groups == {frozenset({3, 4, 5, 9}), frozenset({7, 8}), frozenset({10, 11, 12, 13, 14})}


@pytest.mark.parametrize("large", [100, 6])
def test_coslice_lengths_are_those_of_the_ways(spark, rows, legs, ways, monkeypatch, large):
    want = rows(graph._way_lengths(ways))
    monkeypatch.setattr(parts, "LARGE", large)
    if large == 100:
        no_pairs(monkeypatch)
    got = graph.coslice_lengths(legs, *ENDS)
    assert rows(got) == want and [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "int", "int"]


@pytest.mark.parametrize("large", [100, 6])
def test_chosen_ways_are_those_of_all_ways(spark, rows, legs, ways, monkeypatch, large):
    columns = ["seed_key", "target_key", "direction", "leg_ordinal", "leg_from", "leg_to", "leg_kind", "leg_source"]
    # Only some columns are seeds, so that ways are long and ties happen.
    ends = ("node rlike '^c.[02]'", ENDS[1])
    want = rows(graph.path_choice(ways.where("seed_key rlike '^c.[02]'")), *columns)
    monkeypatch.setattr(parts, "LARGE", large)
    if large == 100:
        no_pairs(monkeypatch)
    assert rows(graph.chosen_ways(legs, *ends), *columns) == want and any(x[3] > 1 for x in want)


def test_gather_marks_nodes_without_edges(spark):
    node = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
    edges = spark.createDataFrame([("x", None, "y", "z")], "a string, b string, c string, d string").select(node.alias("src"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("dst"))
    lone = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string").select(node.alias("node"))
    out, large = parts.gather(edges, {"m": lone})
    assert large is None
    assert {((r.node.a, r.node.b), r.m, len(r.after)) for r in out.collect()} == {((None, "x"), True, 0), (("x", None), True, 1), (("y", "z"), False, 0)}


@pytest.mark.parametrize("large", [100, 6])
def test_taint_steps_are_those_of_the_rounds(spark, rows, monkeypatch, large):
    rnd = random.Random(2)
    node = lambda c: F.struct(F.substring(c, 1, 1).alias("object"), F.when(F.col(c) != "a0", "p").alias("proc"), F.col(c).alias("var"))
    names = lambda group, many: [f"{group}{rnd.randrange(many)}" for _ in range(2)]
    pairs = [(*names(g, many), rnd.choice(["def", "arg"])) for g, many in (("a", 9), ("b", 5)) for _ in range(2 * many)]
    edges = cut(spark.createDataFrame(pairs, "s string, d string, kind string").select(node("s").alias("src"), node("d").alias("dst"), "kind"))
    of = lambda *n: spark.createDataFrame([(x,) for x in n], "x string").select(node("x").alias("node"))
    sources, sinks = of("a0", "a1", "b1", "z", "z"), of("a4", "a5", "a1", "b3", "z")
    want = rows(taint.steps(edges, taint.confirmed(edges, sources, sinks)))
    assert max(r[2] for r in want) > 2
    monkeypatch.setattr(parts, "LARGE", large)
    if large == 100:
        no_pairs(monkeypatch)
    assert rows(taint.confirmed_steps(edges, sources, sinks)) == want
