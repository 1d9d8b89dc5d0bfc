import random

from pyspark.sql import functions as F

from lodestone.operators import fixpoint


def bfs(edges, seed):
    dist, todo = {seed: 0}, [seed]
    for v in todo:
        for a, b in edges:
            if a == v and b not in dist:
                dist[b] = dist[v] + 1
                todo.append(b)
    return dist


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_reach_against_bfs_and_laws(spark, rows):
    rnd = random.Random(2)
    edges = list({(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(45)})
    seeds = spark.createDataFrame([("n0",), ("n1",), ("lonely",), (None,)], "seed string")
    got = {(r.seed, r.node): r.hops for r in fixpoint.reach(frame(spark, edges), seeds).collect()}
    want = {(s, n): h for s in ("n0", "n1", "lonely") for n, h in bfs(edges, s).items()}
    assert got == want
    bool_ = {(r.seed, r.node) for r in fixpoint.closure(frame(spark, edges), seeds).collect()}
    assert bool_ == set(want)
    assert {(r.seed, r.node): r.label for r in fixpoint.closure(frame(spark, edges), seeds, fixpoint.hops()).collect()} == want
    again = fixpoint.closure(frame(spark, sorted(set(edges) | {("n0", n) for s, n in want if s == "n0" and n != "n0"})), seeds)
    assert {(r.seed, r.node) for r in again.collect()} == bool_


def test_all_pairs_and_self_only_over_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "b"), ("e", "e")]
    got = {(r.seed, r.node): r.hops for r in fixpoint.all_pairs(frame(spark, edges)).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "b"): 2, ("b", "d"): 2, ("c", "b"): 1, ("c", "c"): 2, ("c", "d"): 1, ("e", "e"): 1}
    seeds = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "seed string")
    assert {(r.seed, r.node): r.hops for r in fixpoint.reach(frame(spark, edges), seeds, zero_hops=False).collect()} == got


def test_weights_and_sets(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 1.0), ("c", "b", 1.0), ("a", "b", 4.0)], "src string, dst string, label double")
    seed = spark.createDataFrame([("a",)], "seed string")
    assert {r.node: r.label for r in fixpoint.closure(edges, seed, fixpoint.min_plus()).collect()} == {"a": 0.0, "b": 2.0, "c": 1.0}
    tags = edges.select("src", "dst", F.array(F.col("label").cast("string")).alias("label"))
    assert {r.node: r.label for r in fixpoint.closure(tags, seed, fixpoint.set_union()).collect()} == {"a": [], "b": ["1.0", "4.0", "5.0"], "c": ["1.0"]}


def test_product_and_union(spark, rows):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 1.0), ("b", "d", 2.0)], "src string, dst string, label double")
    algebra = fixpoint.min_plus()
    assert rows(fixpoint.rel_product(edges, edges, algebra)) == [("a", "c", 6.0), ("a", "d", 7.0)]
    assert fixpoint.rel_union(edges, edges, algebra).count() == 3


def test_witness_legs_are_least(spark, rows):
    edges = spark.createDataFrame([("s", "a", "k"), ("s", "b", "k"), ("a", "t", "x"), ("b", "t", "k"), ("a", "t", "k")], "src string, dst string, kind string")
    dist = fixpoint.reach(edges, spark.createDataFrame([("s",)], "seed string"))
    legs = fixpoint.witness_legs(edges, dist).where("target = 't'")
    assert rows(legs, "leg_ord", "leg_from", "leg_to", "kind") == [(0, "s", "a", "k"), (1, "a", "t", "k")]


def test_empty(spark):
    none = frame(spark, [])
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert fixpoint.reach(none, seeds).count() == 1
    assert fixpoint.reach(none, seeds, zero_hops=False).count() == 0
    assert fixpoint.all_pairs(none).count() == 0
    assert fixpoint.closure(none, seeds.limit(0)).count() == 0


def test_long_ways_are_kept_whole(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "TOGETHER", 2)
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(9)] + [("n09", "n05")], "src string, dst string")
    seeds = spark.createDataFrame([("n00",), ("n07",)], "seed string")
    got = {(r.seed, r.node): r.hops for r in fixpoint.reach(edges, seeds).collect()}
    assert got == {("n00", f"n{i:02}"): i for i in range(10)} | {("n07", "n07"): 0, ("n07", "n08"): 1, ("n07", "n09"): 2, ("n07", "n05"): 3, ("n07", "n06"): 4}
    assert {r.node for r in fixpoint.reached(edges, seeds).collect()} == {f"n{i:02}" for i in range(10)}
