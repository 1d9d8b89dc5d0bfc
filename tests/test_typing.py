from pyspark.sql import functions as F

from lodestone.operators import typing as T
from lodestone.sources.script import script_facts

TEXT = """global type n_a from nonvisualobject
end type
type variables
string is_text
u_own iu_own
end variables
public function string of_name (long al_n, string as_s);
boolean lb_x
datastore lds_d
lb_x = 5
al_n = is_text
al_n = 7
as_s = of_name(al_n, lb_x)
lb_x = of_name("a", "b")
lds_d.retrieve(al_n)
iu_own.of_go()
return al_n
end function
type u_own from userobject
end type
"""


def _facts(spark):
    return script_facts(spark.createDataFrame([("f", TEXT), ("g", None), ("h", "")], "file string, lines string"))


def test_types_of_variables(spark, rows):
    classes = spark.createDataFrame([("DataStore ",), (None,), ("datastore",)], "name string")
    got = rows(T.variable_types(_facts(spark), classes), "name", "scope", "raw_type", "kind")
    assert got == [("al_n", "param", "long", "builtin"), ("as_s", "param", "string", "builtin"), ("is_text", "instance", "string", "builtin"), ("iu_own", "instance", "u_own", "user_type"), ("lb_x", "local", "boolean", "builtin"), ("lds_d", "local", "datastore", "object")]


def test_mismatches(spark, rows):
    facts = _facts(spark)
    types = T.variable_types(facts, spark.createDataFrame([("datastore",)], "name string"))
    got = rows(T.type_mismatches(facts, types), "line", "check", "name", "target", "source")
    assert got == [(10, "assign", "lb_x", "boolean", "numeric"), (11, "assign", "al_n", "numeric", "string"), (13, "argument", "of_name:1", "string", "boolean"), (14, "argument", "of_name:0", "numeric", "string"), (14, "assign", "lb_x", "boolean", "string"), (17, "return", None, "string", "numeric")]


def test_receivers(spark, rows):
    facts = _facts(spark)
    calls = facts.where("tag = 'call'").select("file", "object", "proc_name", "line", "name", F.col("kind").alias("receiver"))
    got = rows(T.receiver_types(calls, T.variable_types(facts, spark.createDataFrame([("datastore",)], "name string"))), "line", "name", "receiver_object")
    assert got == [(13, "of_name", "n_a"), (14, "of_name", "n_a"), (15, "retrieve", "datastore"), (16, "of_go", "u_own")]


def test_resolution(spark, rows):
    calls = [("a", "f", "ExCall", None), ("a", "open", "ExCall", None), ("b", "f", "ExCall", None), ("a", "only", "ExCall", None), ("a", "both", "ExCall", None), ("a", "retrieve", "ExMethodCall", None), ("a", "f", "ExMethodCall", "b"), ("a", "x", "ExMethodCall", None), ("a", "f", "ExDispatch", None), ("b", "ev", "ExCallArg", None), (None, None, "ExCall", None)]
    df = spark.createDataFrame(calls, "object string, name string, call_type string, receiver_object string")
    declared = spark.createDataFrame([("a", "f", "function"), ("a", "f", "function"), ("a", "open", "event"), ("z", "only", "subroutine"), ("y", "both", "function"), ("z", "both", "function"), ("a", "ev", "event"), (None, "q", "function")], "owner string, name string, proc_type string")
    ancestors = spark.createDataFrame([("b", 1, "a"), ("b", 2, "b")], "child string, depth int, parent string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = rows(T.resolve_calls(df, declared, ancestors, names("open"), names("retrieve")), "object", "name", "call_type", "target_object", "resolved_kind")
    want = [("a", "f", "ExCall", "a", "virtual"), ("a", "open", "ExCall", None, "builtin"), ("b", "f", "ExCall", "a", "inherited"), ("a", "only", "ExCall", "z", "virtual"), ("a", "both", "ExCall", None, "unresolved"), ("a", "retrieve", "ExMethodCall", None, "builtin"), ("a", "f", "ExMethodCall", "a", "inherited"), ("a", "x", "ExMethodCall", None, "unresolved"), ("a", "f", "ExDispatch", None, "unresolved"), ("b", "ev", "ExCallArg", "a", "inherited"), (None, None, "ExCall", None, "unresolved")]
    assert got == sorted(want, key=str)
