from pyspark.sql import functions as F

from lodestone.operators import dataflow, typing, slicing, taint
from lodestone.sources.script import script_facts

SOURCE = """forward
global type n_a from nonvisualobject
end type
end forward
public function string of_get (string as_in);
string ls_v, ls_w
SELECT a INTO :ls_v FROM t WHERE k = :as_in;
ls_w = ls_v + "x"
of_put(ls_w, as_in)
return ls_w
end function
public subroutine of_put (string as_p);
string ls_q
ls_q = as_p
UPDATE t SET a = :ls_q;
end subroutine
"""


def parts(spark):
    facts = script_facts(spark.createDataFrame([("f", SOURCE)], "file string, lines string")).cache()
    base = lambda tag: facts.where(F.col("tag") == tag).select("file", "object", F.col("proc_name").alias("proc"), "line", F.col("name").alias("var"), "kind", "value", "block")
    calls = spark.createDataFrame([("n_a", "of_get", 9, "of_put", "n_a")], "object string, proc string, line int, name string, callee_object string")
    args = spark.createDataFrame([("n_a", "of_get", 9, "of_put", 0, "ls_w"), ("n_a", "of_get", 9, "of_put", 1, "as_in")], "object string, proc string, line int, name string, ordinal int, var string")
    params = spark.createDataFrame([("n_a", "of_put", 0, "as_p"), ("n_a", "of_get", 0, "as_in")], "object string, proc string, ordinal int, var string")
    return facts, base("def"), base("use"), base("proc"), calls, args, params


def test_taint_from_source_to_sink(spark, rows):
    facts, defs, uses, procs, calls, args, params = parts(spark)
    inter = taint.argument_edges(calls, args, params)
    assert rows(inter, "caller_var", "callee_var") == [("as_in", "*extra"), ("ls_w", "as_p")]
    edges = taint.successors(taint.intra_edges(defs, uses), uses.where("kind = 'return'").select("object", "proc", "var"), inter)
    sources = taint.sources(defs, procs)
    assert rows(sources.select("node.var", "source_type")) == [("ls_v", "sql_into")]
    statements = uses.where("kind = 'sql_host_var'").select("object", "proc", F.col("value").alias("operation"), F.array("var").alias("vars"))
    sinks = taint.sinks(statements)
    assert rows(sinks.select("node.var", "severity", "category")) == [("ls_q", "high", "sql_write")]
    pairs = taint.confirmed(edges, sources, sinks)
    assert [(r.source["var"], r.sink["var"], r.hops) for r in pairs.collect()] == [("ls_v", "ls_q", 3)]
    steps = taint.steps(edges, pairs)
    assert [r.step_kind for r in steps.orderBy("ordinal").collect()] == ["source", "def", "arg", "def", "sink"]
    path = taint.paths(steps).first()
    assert path.n_steps == 5 and path.source_key == "n_a::of_get::ls_v"
    reached = taint.reaches(edges, sources)
    assert {r.node["var"] for r in reached.collect()} == {"ls_w", "as_p", "ls_q"}
    notes = taint.annotations(reached, uses)
    assert {(r.proc, tuple(r.tainted_vars)) for r in notes.collect()} == {("of_get", ("ls_w",)), ("of_put", ("as_p", "ls_q"))}


def test_zero_hops_and_exec(spark):
    node = taint.node(F.lit("o"), F.lit("p"), F.lit("v"))
    one = spark.range(1).select(node.alias("node"))
    edges = spark.range(0).select(node.alias("src"), node.alias("dst"), F.lit("k").alias("kind"))
    pairs = taint.confirmed(edges, one, one)
    assert [r.hops for r in pairs.collect()] == [0]
    assert [r.step_kind for r in taint.steps(edges, pairs).collect()] == ["source-sink"]
    statements = spark.createDataFrame([("o", "p", "EXECUTE", [])], "object string, proc string, operation string, vars array<string>")
    assert [(r.node["var"], r.severity) for r in taint.sinks(statements).collect()] == [("*exec", "critical")]


def test_globals_go_through_a_hub(spark):
    g = spark.createDataFrame([("a", "w", "gv", True), ("b", "r", "gv", False), ("c", "r", "gv", False)], "object string, proc string, var string, writes boolean")
    none = g.limit(0)
    intra = none.select("object", "proc", F.col("var").alias("use_var"), F.col("var").alias("def_var"))
    inter = none.select(*[F.lit("").alias(c) for c in ("caller_object", "caller_proc", "caller_line", "callee_object", "callee_proc", "edge_kind", "caller_var", "callee_var")])
    assert taint.successors(intra, none.select("object", "proc", "var"), inter, g).count() == 3


def test_slices(spark):
    facts, defs, uses, procs, calls, args, params = parts(spark)
    inter = taint.argument_edges(calls, args, params)
    edges = slicing.backward_edges(defs, uses, inter)
    origin = uses.where("value = 'UPDATE'").select(F.struct("object", "proc", "line", "var").alias("point"))
    points = {(r.point["proc"], r.point["var"]) for r in slicing.slice_sets(edges, origin).collect()}
    assert points == {("of_put", "ls_q"), ("of_put", "as_p"), ("of_get", "ls_w"), ("of_get", "ls_v"), ("of_get", "as_in")}
    walk = slicing.slice_walks(edges, origin, 3).collect()
    assert len(walk) == 3 and max(walk, key=lambda r: r.step).var == "ls_q"
    near = slicing.neighbourhood(inter, procs.select("object", "proc"))
    assert near.where("proc = 'of_put'").count() == 2


def test_latest_def_is_the_last_at_or_before(spark, rows):
    d = spark.createDataFrame([("o", "p", "v", 1), ("o", "p", "v", 5), ("o", "p", "v", 9)], "object string, proc string, var string, line int")
    u = spark.createDataFrame([("o", "p", "v", 5), ("o", "p", "v", 8), ("o", "p", "v", 0)], "object string, proc string, var string, line int")
    assert {(r.line, r.def_line) for r in slicing.latest_def(d, u).collect()} == {(5, 5), (8, 5), (0, None)}


def test_reaching_and_live():
    edges, blocks = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 1)], [0, 1, 2, 3]
    into = dataflow.reaching(edges, blocks, {0: {"x": 1, "y": 1}, 1: {"x": 2}})
    assert into[3] == {("x", 1), ("x", 2), ("y", 1)} and into[2] == {("x", 1), ("y", 1)}
    end = dataflow.live(edges, blocks, {3: {"x"}, 2: {"y"}}, {0: {"x", "y"}, 1: {"x"}})
    assert end[0] == {"x", "y"} and end[1] == {"x"} and end[3] == set()


def test_dead_variables(spark, rows):
    facts, *_ = parts(spark)
    assert rows(dataflow.dead_variables(facts), "proc", "var", "kind") == []
    more = script_facts(spark.createDataFrame([("f", SOURCE.replace("of_put(ls_w, as_in)", "long ll_z = 1"))], "file string, lines string"))
    assert rows(dataflow.dead_variables(more), "proc", "var", "kind") == [("of_get", "ll_z", "never_read")]


def test_dataflow_frame(spark, rows):
    text = "public function long of_a (long al_x);\nlong ll_y\nll_y = 1\nll_y = 2\nif al_x > 0 then\nll_y = al_x\nend if\nreturn ll_y\nend function\n"
    found = dataflow.dataflow(spark.createDataFrame([("f", text), ("g", None)], "file string, lines string"))
    assert rows(found.where("fact = 'overwritten'"), "var", "line") == [("ll_y", 2), ("ll_y", 3)]
    assert rows(found.where("fact = 'reaching' and block = 2 and var = 'll_y'"), "line") == [(4,), (6,)]
    assert ("ll_y",) in rows(found.where("fact = 'live' and block = 0"), "var")
    assert found.where("fact = 'unreachable'").count() == 0  # nothing stands behind the return


def test_callees_globals_and_statements(spark, rows):
    calls = spark.createDataFrame([("f", "b", "p", n, name, via) for n, name, via in ((1, "own", None), (2, "up", None), (3, "far", "io_x"), (4, "own", "super"), (5, "twice", "io_x"), (6, "own", "io_x"))], "file string, object string, proc string, line int, name string, receiver string")
    declared = spark.createDataFrame([("b", "own"), ("a", "own"), ("a", "up"), ("z", "far"), ("y", "twice"), ("z", "twice")], "object string, proc string")
    ancestors = spark.createDataFrame([("b", 1, "a")], "child string, depth int, parent string")
    targets = spark.createDataFrame([("f", "b", "p", 6, "own", "q")], "file string, object string, proc string, line int, name string, callee_object string")
    assert rows(taint.callees(calls, declared, ancestors, targets), "line", "callee_object") == [(1, "b"), (2, "a"), (3, "z"), (4, "a"), (6, "q")]
    columns = "object string, proc string, var string, kind string"
    defs = spark.createDataFrame([("b", "w", "is_a", "assign"), ("c", "w", "is_a", "assign"), ("b", "h", "is_a", "local_var"), ("c", "w", "gs_a", "assign"), ("b", "w", "ls_a", "assign")], columns)
    uses = spark.createDataFrame([("a", "r", "is_a", "rhs"), ("b", "h", "is_a", "rhs"), ("a", "r", "gs_a", "rhs")], columns)
    got = rows(taint.global_uses(defs, uses, ancestors), "object", "var", "writes", "hub")
    assert got == sorted([("a", "is_a", False, "a"), ("b", "is_a", True, "a"), ("c", "gs_a", True, ""), ("a", "gs_a", False, "")], key=str)
    facts = script_facts(spark.createDataFrame([("f", SOURCE.replace("UPDATE t SET a = :ls_q;", "DELETE FROM t;"))], "file string, lines string"))
    sql = facts.where("tag = 'sql'").select("file", "object", F.col("proc_name").alias("proc"), "line", F.col("name").alias("operation"))
    uses = facts.where("tag = 'use'").select("file", "object", F.col("proc_name").alias("proc"), "line", F.col("name").alias("var"), "kind", "value")
    assert rows(taint.sinks(taint.statements(sql, uses)).select("node.var", "sink_type")) == [("*exec", "DELETE")]


def test_returned_dates_are_judged(spark, rows):
    text = "global type n_a from nonvisualobject\nend type\npublic function long of_a (date ad_x);\nreturn ad_x\nend function\n"
    facts = script_facts(spark.createDataFrame([("f", text)], "file string, lines string"))
    types = typing.variable_types(facts, spark.createDataFrame([], "name string"))
    assert rows(typing.type_mismatches(facts, types), "check", "target", "source") == [("return", "numeric", typing_family(spark, "date"))]


def typing_family(spark, name):
    from lodestone.functions import scalar

    return spark.createDataFrame([(name,)], "t string").select(scalar.type_family(F.col("t")).alias("f")).first().f
