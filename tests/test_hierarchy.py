import random

from lodestone.operators.hierarchy import below_cycles, cyclic_pairs, descendant_pairs, hierarchy


def brute(parent):
    """name -> (root, depth, path)"""
    names = set(parent) | {p for p in parent.values() if p}
    out = {}
    for n in names:
        path, seen, at = [n], {n}, n
        while (at := parent.get(at)) is not None:
            if at in seen:
                break
            seen.add(at)
            path.append(at)
        if at is None:
            out[n] = (path[-1], len(path) - 1, "/".join(path[::-1]))
        else:
            cyclic, step = False, parent.get(n)
            for _ in range(len(names) + 1):
                cyclic, step = cyclic or step == n, parent.get(step)
            out[n] = ("#cycle" if cyclic else "#below", -1, "")
    return out


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def check(spark, parent, extra=()):
    tree = hierarchy(links_of(spark, [*parent.items(), *extra])).cache()
    rows = tree.collect()
    want = brute({c: p for c, p in parent.items()})
    assert {r.object: (r.root, r.depth, "/".join(r.path)) for r in rows} == want
    assert len(rows) == len(want)
    pairs = {(r.object, r.descendant, r.distance) for r in descendant_pairs(tree).collect()}
    expected = {(a, n, d - i) for n, (_, d, path) in want.items() if d > 0 for i, a in enumerate(path.split("/")[:-1])}
    assert pairs == expected
    for r in rows:
        if r.depth >= 0:
            inside = {x.object for x in rows if x.root == r.root and x.depth >= 0 and r.first < x.first <= r.last}
            assert inside == {n for a, n, _ in expected if a == r.object}
            assert r.n_descendants == len(inside)


def test_random_forests_with_cycles(spark):
    rnd = random.Random(11)
    parent = {}
    for i in range(1, 120):
        parent[f"n{i}"] = f"n{rnd.randrange(0, i)}" if rnd.random() < 0.9 else None
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "b1": "c2", "b2": "b1", "b3": "b2", "self": "self"}
    check(spark, parent)


def test_long_chain_below_a_cycle_and_a_hot_parent(spark):
    parent = {f"d{i}": f"d{i - 1}" if i else "x" for i in range(20)} | {"x": "y", "y": "x"}
    parent |= {f"h{i}": "hot" for i in range(60)} | {f"e{i}": f"e{i - 1}" for i in range(1, 17)}
    check(spark, parent)


def test_names_in_any_form(spark, rows):
    tree = hierarchy(links_of(spark, [(" A ", "B"), ("a", "b "), (None, "z"), ("q", ""), ("", "w"), ("r", None), ("A", None)]))
    assert rows(tree, "object", "root", "depth") == [("a", "b", 1), ("b", "b", 0), ("q", "q", 0), ("r", "r", 0), ("w", "w", 0), ("z", "z", 0)]


def test_empty_table(spark):
    assert hierarchy(links_of(spark, [])).count() == 0


def test_descendants_on_and_below_cycles(spark, rows):
    links = links_of(spark, [("x", "y"), ("y", "x"), ("a", "x"), ("b", "a"), ("t", "r"), ("self", "self")])
    below = {("a", "b", 1), ("x", "a", 1), ("x", "b", 2), ("y", "a", 2), ("y", "b", 3)}
    assert set(rows(cyclic_pairs(links))) == below | {("x", "y", 1), ("y", "x", 1), ("x", "x", 2), ("y", "y", 2), ("self", "self", 1)}
    trees, _ = below_cycles(links)
    assert rows(trees.where("root = 'x'"), "object", "depth", "n_descendants") == [("a", 1, 1), ("b", 2, 0), ("x", 0, 2)]
