"""Types of variables, calls resolved over receivers, and assignments, returns and arguments held against declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalar

_KEY = ["file", "object", "proc_name"]


def variable_types(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, object, proc_name, name, scope, raw_type, family, kind) of each declared variable.

    facts: of script sources; classes: (name), all objects and built-in classes. scope:
    param, local, instance, shared or global; proc_name is NULL for the last three. kind:
    ``builtin`` for a type of the language, ``object`` for a class that is known,
    ``user_type`` for a type that the same file declares, else ``unknown``. A variable
    declared twice in a scope keeps its last declaration by line.
    """
    scoped = F.when(F.col("tag") == "var", F.col("kind")).when(F.col("kind") == "param", "param").otherwise("local")
    rows = facts.where("tag = 'var' or (tag = 'def' and kind in ('param', 'local_var'))").where("name is not null")
    rows = rows.select(*_KEY, "name", scoped.alias("scope"), F.when(F.col("tag") == "var", F.col("value")).otherwise(F.col("value")).alias("raw_type"), "line")
    last = rows.groupBy(*_KEY, "name", "scope").agg(F.max(F.struct("line", "raw_type")).alias("x")).select(*_KEY, "name", "scope", F.lower("x.raw_type").alias("raw_type"))
    family = scalar.type_family(F.col("raw_type"))
    own = facts.where("tag = 'type'").select("file", F.col("name").alias("raw_type")).distinct().withColumn("_own", F.lit(True))
    known = classes.select(F.lower(F.trim("name")).alias("raw_type")).where("raw_type <> ''").distinct().withColumn("_known", F.lit(True))
    out = last.join(own, ["file", "raw_type"], "left").join(known, "raw_type", "left").withColumn("family", family)
    kind = F.when(~F.col("family").startswith("user_type:"), "builtin").when(F.col("_known"), "object").when(F.col("_own"), "user_type").otherwise("unknown")
    return out.select(*_KEY, "name", "scope", "raw_type", "family", kind.alias("kind"))


def _typed(rows: DataFrame, types: DataFrame, name: str, out: str, column: str = "family") -> DataFrame:
    """``rows`` with the type of the variable ``name``: that of the procedure, else of the object; NULL if it is not declared."""
    own = types.where("proc_name is not null").groupBy(*_KEY, F.col("name").alias(name)).agg(F.max(column).alias("_own"))
    shared = types.where("proc_name is null").groupBy("file", "object", F.col("name").alias(name)).agg(F.max(column).alias("_shared"))
    joined = rows.join(own, [*_KEY, name], "left").join(shared, ["file", "object", name], "left")
    return joined.withColumn(out, F.coalesce("_own", "_shared")).drop("_own", "_shared")


def type_mismatches(facts: DataFrame, types: DataFrame) -> DataFrame:
    """(file, object, proc, line, check, name, target, source): what is assigned, returned or passed against its declared type.

    check: ``assign``, ``return`` or ``argument`` (name: callee:ordinal). Only values of
    one variable, call or literal are judged, and only where both types are known; a
    call has the return type of the procedure of its name in the same object.
    """
    value = lambda tag: facts.where(F.col("tag") == tag).select(*_KEY, "line", "name", F.col("kind").alias("form"), F.col("value").alias("text"))
    returns = facts.where("tag = 'proc'").select("file", "object", "proc_name", F.col("kind").alias("_kind"), scalar.type_family(F.nullif("value", F.lit(""))).alias("declared"))
    functions = returns.where("_kind = 'function'").groupBy(*_KEY).agg(F.max("declared").alias("declared"))
    literal = F.when(F.col("form").isin("string", "numeric", "boolean"), F.col("form"))

    def sourced(rows: DataFrame) -> DataFrame:
        rows = _typed(rows.withColumn("_var", F.when(F.col("form") == "var", F.col("text"))), types, "_var", "_of_var")
        called = functions.select("file", "object", F.col("proc_name").alias("_call"), F.col("declared").alias("_of_call"))
        rows = rows.withColumn("_call", F.when(F.col("form") == "call", F.col("text"))).join(called, ["file", "object", "_call"], "left")
        return rows.withColumn("source", F.coalesce(literal, "_of_var", "_of_call"))

    assigned = _typed(sourced(value("assign")), types, "name", "target").withColumn("check", F.lit("assign"))
    returned = sourced(value("returns")).join(functions.withColumnRenamed("declared", "target"), _KEY).withColumn("check", F.lit("return"))
    params = facts.where("tag = 'param'").select("file", "object", F.col("proc_name").alias("_callee"), F.col("value").cast("int").alias("_at"), F.col("name").alias("_param"))
    param_types = types.where("scope = 'param'").select("file", "object", F.col("proc_name").alias("_callee"), F.col("name").alias("_param"), F.col("family").alias("target"))
    places = params.join(param_types, ["file", "object", "_callee", "_param"]).groupBy("file", "object", "_callee", "_at").agg(F.max("target").alias("target"), F.count_distinct("target").alias("_n")).where("_n = 1")
    passed = sourced(value("argument")).withColumn("_callee", F.split_part("name", F.lit(":"), F.lit(1))).withColumn("_at", F.split_part("name", F.lit(":"), F.lit(2)).cast("int"))
    passed = passed.join(places, ["file", "object", "_callee", "_at"]).withColumn("check", F.lit("argument"))
    keep = ["file", "object", F.col("proc_name").alias("proc"), "line", "check", "name", "target", "source"]
    every = assigned.select(*keep).union(returned.select(*keep)).union(passed.select(*keep))
    return every.where("target is not null and source is not null").where(~scalar.compatible(F.col("target"), F.col("source"))).distinct()


def receiver_types(calls: DataFrame, types: DataFrame) -> DataFrame:
    """calls with ``receiver_object``: the class of the receiver. calls: (file, object, proc_name, line, name, receiver); this and none are the own object, NULL if unknown."""
    rows = calls.withColumn("_var", F.split_part(F.coalesce("receiver", F.lit("")), F.lit("."), F.lit(1)))
    rows = _typed(rows, types.where("kind <> 'builtin'"), "_var", "_class", "raw_type")
    own = F.col("receiver").isNull() | F.col("receiver").isin("", "this", "super")
    return rows.withColumn("receiver_object", F.when(own, F.col("object")).otherwise(F.col("_class"))).drop("_var", "_class")


def resolve_calls(calls: DataFrame, declared: DataFrame, ancestors: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """calls with target_object, target_proc, resolved_kind, resolved_confidence.

    calls: (object, name, call_type, receiver_object); declared: (owner, name,
    proc_type); ancestors: (child, depth, parent); functions, methods: (name) built in.
    A bare call looks for a function or subroutine on the own chain, then for a built-in
    function, then for any procedure on the chain, then for one that a single other
    object declares. A method starts from the receiver's class, built-in methods
    standing between its chain and the rest; without a known receiver only a built-in
    one is found. Nearer ancestors win; all joins are equi joins on distinct keys.
    """
    start = F.when(F.col("call_type") == "ExMethodCall", F.col("receiver_object")).when(F.col("call_type").isin("ExCall", "ExCallArg"), F.col("object"))
    calls = calls.withColumn("_from", start)
    keys = calls.select("_from", "name").where("_from is not null and name is not null").distinct()
    every = declared.where("owner is not null and name is not null").select("owner", "name", F.col("proc_type").isin("function", "subroutine").alias("callable")).groupBy("owner", "name").agg(F.bool_or("callable").alias("callable"))
    chain = ancestors.select(F.col("child").alias("_from"), F.col("parent").alias("owner"), F.col("depth").cast("int").alias("hops")).where("_from <> owner")
    steps = keys.select("_from", "name", F.col("_from").alias("owner"), F.lit(0).alias("hops")).union(keys.join(chain, "_from").select("_from", "name", "owner", "hops"))
    hits = steps.join(every, ["owner", "name"])
    near = hits.groupBy("_from", "name").agg(F.min(F.struct("hops", "owner")).alias("any"), F.min(F.when(F.col("callable"), F.struct("hops", "owner"))).alias("callable"))
    unique = every.groupBy("name").agg(F.count("*").alias("_n"), F.min("owner").alias("unique")).where("_n = 1").drop("_n")
    mark = lambda t, c: t.select("name").distinct().withColumn(c, F.lit(True))
    out = calls.join(near, ["_from", "name"], "left").join(unique, "name", "left").join(mark(functions, "_function"), "name", "left").join(mark(methods, "_method"), "name", "left")
    bare, argument, method = (F.col("call_type") == t for t in ("ExCall", "ExCallArg", "ExMethodCall"))
    builtin = (bare & F.col("callable").isNull() & F.col("_function")) | (method & F.col("any").isNull() & F.col("_method"))
    builtin = F.coalesce(builtin, F.lit(False))
    target: Column = F.when(bare, F.coalesce("callable", "any")).when(argument | method, F.col("any"))
    found = F.when(~builtin, F.coalesce(target["owner"], F.when(F.col("_from").isNotNull(), F.col("unique"))))
    kind = F.when(builtin, "builtin").when(target.isNotNull() & (target["hops"] > 0), "inherited").when(found.isNotNull(), "virtual").otherwise("unresolved")
    out = out.withColumn("target_object", found).withColumn("resolved_kind", kind)
    out = out.withColumn("target_proc", F.when(F.col("target_object").isNotNull(), F.col("name"))).withColumn("resolved_confidence", F.when(F.col("resolved_kind") == "unresolved", "low").otherwise("high"))
    return out.drop("_from", "any", "callable", "unique", "_function", "_method")
