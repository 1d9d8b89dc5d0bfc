import itertools
import random

import numpy as np

from lodestone.llm import pairs as P


def brute(rows):
    baskets = {}
    for b, s, i in rows:
        if i is not None:
            baskets.setdefault((b, s), set()).add(i)
    n, alone, both = {}, {}, {}
    for (_, s), items in baskets.items():
        n[s] = n.get(s, 0) + 1
        for i in items:
            alone[(s, i)] = alone.get((s, i), 0) + 1
        for a, b in itertools.combinations(sorted(items), 2):
            both[(s, a, b)] = both.get((s, a, b), 0) + 1
    return {(s, a, b): (c, alone[(s, a)], alone[(s, b)], n[s]) for (s, a, b), c in both.items()}


def test_counts_and_pruning_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(f"b{rnd.randrange(60)}", rnd.choice(["s", "s", "t", None]), f"i{rnd.randrange(9)}") for _ in range(700)]
    rows += rows[:50] + [("b1", "s", None)]
    df = spark.createDataFrame(rows, "basket string, scope string, item string")
    want = brute(rows)
    got = {(r.scope, r.item_a, r.item_b): (r.support, r.support_a, r.support_b, r.n) for r in P.co_occurrence(df, ["basket"], ["scope"], "item").collect()}
    assert got == want
    pruned = {(r.scope, r.item_a, r.item_b) for r in P.co_occurrence(df, ["basket"], ["scope"], "item", 3, 1.1).collect()}
    assert pruned == {k for k, (s, a, b, n) in want.items() if s >= 3 and s * n >= 1.1 * a * b}


def test_empty(spark):
    df = spark.createDataFrame([], "basket string, scope string, item string")
    assert P.co_occurrence(df, ["basket"], ["scope"], "item").count() == 0


def test_fit_gives_back_frequencies_and_sizes():
    rnd = np.random.default_rng(3)
    m = rnd.random((30, 200)) < np.outer(rnd.random(30), rnd.random(200))
    m[:, m.sum(0) == 0] = False
    freq, nf = np.unique(m.sum(1)[m.sum(1) > 0].astype(float), return_counts=True)
    size, ns = np.unique(m.sum(0)[m.sum(0) > 0].astype(float), return_counts=True)
    x, y = P.fit(freq, nf.astype(float), size, ns.astype(float))
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * ns).sum(1), freq, rtol=1e-3) and np.allclose((p * nf[:, None]).sum(0), size, rtol=1e-3)


def exact_tail(s, q, m):
    dist = np.array([1.0])
    for chance, times in zip(q, m, strict=True):
        for _ in range(int(times)):
            dist = np.convolve(dist, [1 - chance, chance])
    return dist[int(s) :].sum()


def test_tails_against_exact_convolution():
    q, m = np.array([0.02, 0.1, 0.4]), np.array([40.0, 25.0, 6.0])
    s = np.arange(0, 22, dtype=float)
    got = P.surprise(s, np.tile(q, (len(s), 1)), m)
    want = np.array([-np.log10(exact_tail(v, q, m)) for v in s])
    assert np.all(np.abs(got - np.maximum(want, 0)) < 0.05 + 0.02 * want)
    assert np.all(np.diff(got) >= -1e-6)


def test_planted_pair_stands_out(spark):
    rnd = random.Random(2)
    rows = []
    for b in range(400):
        items = {f"i{rnd.randrange(25)}" for _ in range(3)}
        if b % 10 == 0:
            items |= {"p", "q"}
        rows += [(f"b{b}", "s", i) for i in items]
    found = P.co_occurrence(spark.createDataFrame(rows, "basket string, scope string, item string"), ["basket"], ["scope"], "item").orderBy("q_value").collect()
    assert (found[0].item_a, found[0].item_b) == ("p", "q") and found[0].q_value < 1e-6
    assert sum(r.q_value < 0.05 for r in found) <= 3


def test_columns_are_named_and_normalised(spark):
    rows = [("f", " O ", "P", i, ns, "T ", c, True) for i in range(6) for ns in (None, "S") for c in ("A", " b")] + [("f", "o", "p", 100 + i, None, "t", "z", True) for i in range(20)] + [("f", "o", "p", 100 + i, "s", "t", "z", True) for i in range(20)]
    rows += [("f", "o", "p", 500, None, "t", "a", None), ("f", "o", "p", 501, None, None, "a", True)]
    df = spark.createDataFrame(rows, "file string, object string, proc_name string, line int, namespace string, table_name string, column_name string, is_write boolean")
    got = {(r.column_a, r.column_b, r.co_write_support) for r in P.co_updates(df).collect()}
    assert got == {("t.a", "t.b", 6), ("s.t.a", "s.t.b", 6)}


def test_one_event_has_an_exact_tail():
    for n, q in ((5, 0.001), (100, 1e-4), (3, 0.9)):
        want = -np.log10(1 - (1 - q) ** n)
        assert abs(P.surprise(np.array([1.0]), np.array([[q]]), np.array([float(n)]))[0] - want) < 1e-6


def test_blocks_slices_and_lots_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(f"b{rnd.randrange(40)}", rnd.choice("st"), f"i{rnd.randrange(30)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "basket string, scope string, item string")
    look = lambda: {(r.scope, r.item_a, r.item_b): (r.support, round(r.expected, 6), round(r.surprise, 6), round(r.q_value, 6)) for r in P.co_occurrence(df, ["basket"], ["scope"], "item").collect()}
    want = look()
    assert set(want) == set(brute(rows))
    monkeypatch.setattr(P, "SLICE", 3)
    monkeypatch.setattr(P, "CASES", 7)
    monkeypatch.setattr(P, "BLOCK", 10)
    assert look() == want


def test_q_values_do_not_depend_on_the_bounds(spark):
    rnd = random.Random(9)
    rows = [(f"b{b}", "s", f"i{i}") for b in range(120) for i in rnd.sample(range(12), 4)]
    df = spark.createDataFrame(rows, "basket string, scope string, item string")
    every = {(r.item_a, r.item_b): r.q_value for r in P.co_occurrence(df, ["basket"], ["scope"], "item").collect()}
    some = {(r.item_a, r.item_b): r.q_value for r in P.co_occurrence(df, ["basket"], ["scope"], "item", 14, 1.1).collect()}
    assert some and len(some) < len(every) and all(every[k] == v for k, v in some.items())
    assert "q_value" not in P.co_occurrence(df, ["basket"], ["scope"], "item", 14, 1.1, q_values=False).columns


def test_fit_reports_its_error():
    freq, nf, size, ns = np.array([2.0, 5.0]), np.array([3.0, 2.0]), np.array([1.0, 2.0]), np.array([4.0, 6.0])
    x, y = P.fit(freq, nf, size, ns)
    assert P.fit_error(freq, x, y, ns) < 1e-4
