import itertools
import random

from lodestone.operators import lattice, schema


def writes_of(spark, rows):
    return spark.createDataFrame(rows, "stmt string, col string")


def test_rituals_and_violations_against_sets(spark, rows):
    rnd = random.Random(1)
    data = [(f"s{rnd.randrange(30)}", f"c{rnd.randrange(8)}") for _ in range(140)] + [("s1", None), (None, "c1")]
    sets = {}
    for s, c in data:
        if s and c:
            sets.setdefault(c, set()).add(s)
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] ^ sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2}
    df = writes_of(spark, data)
    pairs = schema.rituals(df)
    assert {(r.column_a, r.column_b): (r.co_write_support, r.n_violations) for r in pairs.collect()} == want
    got = {(r.column_a, r.column_b, r.stmt, r.written_column) for r in schema.ritual_violations(df, pairs).collect()}
    assert got == {(a, b, s, c) for a, b in want for c, o in ((a, b), (b, a)) for s in sets[c] - sets[o]}


def test_mixed_namespaces(spark):
    data = [("s1", "t1.c1"), ("s1", "clims.t2.c2"), ("s2", "t1.c1"), ("s2", "clims.t2.c2")]
    assert [(r.column_a, r.column_b, r.co_write_support, r.n_violations) for r in schema.rituals(writes_of(spark, data)).collect()] == [("clims.t2.c2", "t1.c1", 2, 0)]


def test_fk_graph(spark, rows):
    f = lambda e: spark.createDataFrame(e, "x string, y string")
    assert rows(schema.fk_graph(f([("a", "b"), ("q", "r")]), f([("b", "a"), ("a", "b"), ("m", "n"), (None, "z")]))) == [("a", "b", "corroborated"), ("b", "a", "corroborated"), ("m", "n", "unenforced"), ("q", "r", "unused")]


def test_column_usage_with_null_namespace(spark, rows):
    f = lambda e: spark.createDataFrame(e, "namespace string, table_name string, column_name string")
    catalog = f([(None, "t", "a"), ("s", "t", "a"), ("s", "t", "b"), ("s", "t", "b"), ("s", "t", "c")])
    got = rows(schema.column_usage(catalog, f([(None, "t", "a"), ("s", "t", "b")]), f([("s", "t", "b"), ("s", "t", "a")])), "namespace", "column_name", "usage")
    assert got == [("s", "a", "read_only"), ("s", "b", "read_write"), ("s", "c", "dead"), (None, "a", "write_only")] or sorted(map(str, got)) == sorted(map(str, [(None, "a", "write_only"), ("s", "a", "read_only"), ("s", "b", "read_write"), ("s", "c", "dead")]))


def naive_merges(stmts):
    jac = lambda a, b: len(stmts[a] & stmts[b]) / len(stmts[a] | stmts[b])
    members, active, out = {c: [c] for c in stmts}, sorted(stmts), []
    while len(active) > 1:
        sim, a, b = max((sum(jac(x, y) for x in members[a] for y in members[b]) / (len(members[a]) * len(members[b])), a, b) for a, b in itertools.combinations(active, 2))
        new = f"__cluster{len(out)}__"
        members[new] = members[a] + members[b]
        active = [c for c in active if c not in (a, b)] + [new]
        out.append((round(sim, 9), sorted(members[new])))
    return out


def test_clusters_against_naive_average_linkage(spark):
    rnd = random.Random(4)
    stmts = {f"c{i}": {rnd.randrange(12) for _ in range(rnd.randint(1, 6))} for i in range(7)}
    rows = [("t", c, str(s)) for c, ss in stmts.items() for s in ss] + [("u", "only", "1")]
    got = schema.clusters(spark.createDataFrame(rows, "scope string, col string, stmt string")).orderBy("step").collect()
    assert [(round(r.similarity, 9), r.members) for r in got] == naive_merges(stmts)


def test_candidates_score(spark):
    touches = spark.createDataFrame([("t", c, s) for c in ("a", "b") for s in ("1", "2", "3")] + [("t", "z", "9")], "scope string, col string, stmt string")
    none = spark.createDataFrame([], "scope string, col string, edge string")
    out = schema.candidates(touches, touches.select("scope", "stmt", "col"), none, touches).collect()
    assert [(r.members, r.ritual_support, r.coslice_size, r.score) for r in out] == [(["a", "b"], 3, 3, 1.0)]


def test_names_resolve_only_if_certain(spark, rows):
    catalog = spark.createDataFrame([("s", "t"), ("s", "u"), ("r", "u"), (None, "v")], "namespace string, table_name string")
    refs = spark.createDataFrame([(None, "t"), (None, "w"), ("q", "t")], "namespace string, table_name string")
    assert {(r.table_name, r.namespace) for r in schema.resolve_namespace(refs, catalog, "s").collect()} == {("t", "s"), ("w", None), ("t", "q")}
    assert {(r.table_name, r.namespace, r.n_namespaces) for r in schema.bare_name(catalog).collect()} == {("t", "s", 1), ("u", None, 2), ("v", None, 1)}


def test_footprint_at_either_end(spark, rows):
    legs = spark.createDataFrame([("c1", "s1", "reads"), ("s1", "c2", "writes"), ("s1", "s1", "self")], "src string, dst string, kind string")
    assert rows(schema.footprint(legs, spark.createDataFrame([("s1",)], "stmt string"))) == [("s1", "c1", "reads"), ("s1", "c2", "writes"), ("s1", "s1", "self")]


def test_concepts_rebuild_the_incidence(spark):
    rnd = random.Random(9)
    incidence = {f"g{i}": frozenset(a for a in "abcdef" if rnd.random() < 0.5) or frozenset("a") for i in range(8)}
    attributes = sorted({a for r in incidence.values() for a in r})
    found = lattice.concepts(incidence, attributes)
    assert {(g, a) for e, t in found for g in e for a in t} == {(g, a) for g, r in incidence.items() for a in r}
    for extent, intent in found:
        closed = frozenset(attributes) if not extent else frozenset.intersection(*(incidence[g] for g in extent))
        assert closed == intent
    assert len({e for e, _ in found}) == len(found)
    naive = {(u, w) for u, (eu, _) in enumerate(found) for w, (ew, _) in enumerate(found) if ew < eu and not any(ew < em < eu for em, _ in found)}
    assert set(lattice.covers(found)) == naive
    df = spark.createDataFrame([("s", g, a) for g, r in incidence.items() for a in r] + [("s", None, "a")], "scope string, object string, attribute string")
    assert lattice.lattice(df).count() == len(found)
