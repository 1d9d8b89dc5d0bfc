import random

from lodestone.operators import compile as C
from lodestone.sources.script import facts


def test_loops_and_merges():
    edges = [(0, 1), (1, 2), (1, 5), (2, 3), (2, 4), (3, 4), (4, 1)]
    assert C.loops(edges) == {1: {1, 2, 3, 4}}
    assert C.merge_points(edges) == {4}
    assert C.loops([]) == {} and C.merge_points([]) == set()


def test_ssa_names_the_value_that_each_walk_sees():
    """On random graphs: along random walks each use has the version that was last defined, phis taken by the way in."""
    rnd = random.Random(11)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        edges = list({(a, rnd.randrange(n)) for a in range(n) for _ in range(rnd.randrange(3))})
        steps = {b: [(rnd.choice(["def", "use", "use"]), rnd.choice("xy")) for _ in range(rnd.randrange(4))] for b in range(n)}
        uses, phis = C.ssa(edges, steps)
        for _ in range(25):
            at, came, value = 0, -1, {"x": 0, "y": 0}
            for _ in range(20):
                for v, (version, operands) in phis.get(at, {}).items():
                    assert operands[came] == value[v]
                    value[v] = version
                for kind, v, version in uses[at]:
                    if kind == "def":
                        value[v] = version
                    assert version == value[v]
                nexts = [b for a, b in edges if a == at]
                if not nexts:
                    break
                came, at = at, rnd.choice(nexts)


def _proc(body):
    rows = [r for r in facts(f"global type a from b\nend type\nfunction long f (long al_x);\n{body}\nend function\n") if r[2] == "f"]
    return rows, C.compiled([(t, n, k, v, b, line) for t, _, _, line, n, k, v, b in rows])


def complexity(body):
    return next(int(r[6]) for r in _proc(body)[0] if r[0] == "end")


def test_complexity_of_one_line_and_block_forms():
    assert complexity("return 1") == 1
    assert complexity("if al_x > 1 then al_x = 2\nreturn al_x") == 2 == complexity("if al_x > 1 then\nal_x = 2\nend if\nreturn al_x")
    assert complexity("if al_x > 1 then al_x = 2 else al_x = 'else'\nreturn al_x") == 2
    assert complexity("for al_x = 1 to 3\nif al_x = 2 then exit\nnext") == 3


def test_constant_conditions_rule_out_branches():
    rows, _ = _proc("if true then\nal_x = 1\nelse\nal_x = 2\nend if\nif false then al_x = 3\nreturn al_x")
    ruled = {int(r[4]) for r in rows if r[0] == "block" and r[5] == "const_unreachable"}
    defs = {r[3]: r[7] for r in rows if r[0] == "def" and r[5] == "assign"}
    assert ruled == {defs[7], defs[9]}


def test_statements_in_loops_and_behind_returns():
    rows, _ = _proc("do\nselect a into :al_x from t where b = 1;\nloop until al_x > 3\ndelete from t;\nreturn 1\nal_x = 5")
    assert [(r[3], r[4]) for r in rows if r[0] == "loop_sql"] == [(5, "SELECT")]
    states = {int(r[4]): r[5] for r in rows if r[0] == "block"}
    assert states[next(r[7] for r in rows if r[0] == "def" and r[3] == 9)] == "unreachable"


def test_shapes_do_not_depend_on_names(spark):
    a = "global type a from b\nend type\nfunction long f (long al_x);\nal_x = al_x + 1\nreturn al_x\nend function\n"
    df = spark.createDataFrame([("1", a), ("2", a.replace("al_x", "al_other")), ("3", a.replace("+ 1", "+ g(1)")), ("4", None), ("5", "")], "file string, lines string")
    shapes = {r.file: r.name for r in C.compile_scripts(df).where("tag = 'shape'").collect()}
    assert set(shapes) == {"1", "2", "3"} and shapes["1"] == shapes["2"] != shapes["3"]
