"""Queries over the facts of script sources: procedures, flow, taint, slices, dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import compile as compiling
from lodestone.operators import dataflow, fixpoint, slicing, taint, typing
from lodestone.plans import graphs
from lodestone.session import cut, load, norm
from lodestone.sources.script import script_facts


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return cut(script_facts(load(spark, d, "source_files")))


def script_procs(spark: SparkSession, d: str) -> DataFrame:
    """The procedures of all scripts with their kind and cyclomatic complexity."""
    facts = _facts(spark, d)
    ends = facts.where("tag = 'end'").select("file", "proc_name", F.col("line").alias("end_line"), F.col("value").cast("int").alias("cyclomatic"))
    begins = facts.where("tag = 'proc'").select("file", "object", "proc_name", "kind", F.col("line").alias("start_line"))
    both = begins.join(ends, ["file", "proc_name"]).where("end_line > start_line")
    least = W.partitionBy("file", "proc_name", "start_line").orderBy("end_line")
    return both.withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_n")


def script_headers(spark: SparkSession, d: str) -> DataFrame:
    """How many functions and subroutines the scripts open, by kind."""
    return script_facts(load(spark, d, "source_files")).where("tag = 'proc'").groupBy("kind").agg(F.count("*").alias("n"))


def script_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls by name and receiver."""
    return script_facts(load(spark, d, "source_files")).where("tag = 'call'").groupBy("name", F.coalesce("kind", F.lit("")).alias("receiver")).agg(F.count("*").alias("n"))


def script_sql(spark: SparkSession, d: str) -> DataFrame:
    """Embedded statements by operation."""
    return script_facts(load(spark, d, "source_files")).where("tag = 'sql'").groupBy(F.col("name").alias("operation")).agg(F.count("*").alias("n"))


def def_use(spark: SparkSession, d: str) -> DataFrame:
    """Definitions and uses of variables by kind."""
    facts = script_facts(load(spark, d, "source_files")).where("tag in ('def', 'use')")
    return facts.groupBy("tag", "kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


def cfg_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, edges and unreachable blocks per file."""
    facts = script_facts(load(spark, d, "source_files")).where("tag in ('block', 'edge')").groupBy("file")
    return facts.agg(F.count_if(F.col("tag") == "block").alias("n_blocks"), F.count_if(F.col("tag") == "edge").alias("n_edges"), F.count_if(F.col("kind") == "unreachable").alias("n_unreachable"), F.count_if(F.col("kind") == "const_unreachable").alias("n_ruled_out"))


def dataflow_facts(spark: SparkSession, d: str) -> DataFrame:
    """Reaching definitions, live and exposed variables, overwritten definitions by fact."""
    return dataflow.dataflow(load(spark, d, "source_files")).groupBy("fact").agg(F.count("*").alias("n"))


def dead_variables(spark: SparkSession, d: str) -> DataFrame:
    """Locals never read and parameters not used."""
    return dataflow.dead_variables(_facts(spark, d))


def type_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Assignments, returns and arguments of another family than the declared type."""
    facts = _facts(spark, d)
    return typing.type_mismatches(facts, _types(spark, d, facts))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "objects").select(norm("object").alias("name")).union(load(spark, d, "stdlib_members").select(norm("object"))).distinct()


def _types(spark: SparkSession, d: str, facts: DataFrame) -> DataFrame:
    return cut(typing.variable_types(facts, _classes(spark, d)))


def variable_types(spark: SparkSession, d: str) -> DataFrame:
    """Declared variables by scope, type and what the type is."""
    facts = _facts(spark, d)
    return _types(spark, d, facts).groupBy("scope", "raw_type", "family", "kind").agg(F.count("*").alias("n"))


def declared_and_used(spark: SparkSession, d: str) -> DataFrame:
    """How many uses and definitions of variables per repository have a declared type, and how many none."""
    facts = _facts(spark, d)
    rows = facts.where("tag in ('def', 'use')").select("file", "object", "proc_name", "name", "tag")
    typed = typing._typed(rows, _types(spark, d, facts), "name", "family")
    return typed.groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("repository"), "tag").agg(F.count("*").alias("n"), F.count("family").alias("n_typed"))


def script_call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The calls of the sources resolved over their receivers' declared types, by form and kind."""
    facts = _facts(spark, d)
    calls = facts.where("tag = 'call'").select("file", "object", "proc_name", "line", "name", F.col("kind").alias("receiver"))
    calls = typing.receiver_types(calls, _types(spark, d, facts)).withColumn("call_type", F.when(F.col("receiver").isNull(), "ExCall").otherwise("ExMethodCall"))
    declared = load(spark, d, "procs").select(norm("object").alias("owner"), norm("proc_name").alias("name"), "proc_type").union(facts.where("tag = 'proc'").select("object", "proc_name", "kind")).distinct()
    functions, methods = builtins(spark, d)
    found = typing.resolve_calls(calls, declared, graphs.ancestor_chain(spark, d), functions, methods)
    return found.groupBy("call_type", F.col("resolved_kind").alias("kind")).agg(F.count("*").alias("n"))


def builtins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(functions, methods) that are built in: the members of function_object, and those of all other classes."""
    members = load(spark, d, "stdlib_members").select(norm("object").alias("object"), norm("proc_name").alias("name")).where("name <> ''")
    return members.where("object = 'function_object'").select("name").distinct(), members.where("object <> 'function_object'").select("name").distinct()


def loop_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each loop of each procedure: its header block and the blocks of its body."""
    rows = compiling.compile_scripts(load(spark, d, "source_files")).where("tag = 'loop'")
    return rows.select("file", "object", "proc", F.col("block").alias("header"), F.col("args").alias("body"))


def ssa_values(spark: SparkSession, d: str) -> DataFrame:
    """Per file, how many versions, uses, merges and phis its procedures have in SSA form."""
    rows = compiling.compile_scripts(load(spark, d, "source_files")).groupBy("file")
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return rows.agg(count("def").alias("n_defs"), count("use").alias("n_uses"), count("merge").alias("n_merges"), count("phi").alias("n_phis"), F.max("version").alias("max_version"))


def instruction_graph(spark: SparkSession, d: str) -> DataFrame:
    """Instructions of all procedures by operation, with the number of procedures that have them."""
    rows = compiling.compile_scripts(load(spark, d, "source_files")).where("tag = 'instr'")
    return rows.groupBy(F.col("name").alias("operation")).agg(F.count("*").alias("n"), F.count_distinct("file", "object", "proc").alias("n_procs"))


def proc_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Families of procedures whose instruction graphs are alike but for their names."""
    rows = compiling.compile_scripts(load(spark, d, "source_files")).where("tag = 'shape'")
    return rows.groupBy(F.col("name").alias("shape")).agg(F.count("*").alias("n"), F.min(F.concat_ws("::", "object", "proc")).alias("first")).where("n > 1")


#: Operations that the compiled form keeps as instructions of their own; others need a runtime.
_COVERED = ("def:", "use:", "call/", "sql:SELECT", "sql:UPDATE", "sql:INSERT", "sql:DELETE", "exit", "jump", "branch")


def interpreter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per repository, how many instructions and whole procedures have only operations that can be interpreted from the compiled form."""
    rows = compiling.compile_scripts(load(spark, d, "source_files")).where("tag = 'instr'")
    covered = F.lit(False)
    for prefix in _COVERED:
        covered = covered | F.col("name").startswith(prefix)
    procs = rows.groupBy("file", "object", "proc").agg(F.count("*").alias("n"), F.count_if(covered).alias("n_covered"))
    out = procs.groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("repository"))
    return out.agg(F.sum("n").alias("n_instructions"), F.sum("n_covered").alias("n_covered"), F.count("*").alias("n_procs"), F.count_if(F.col("n") == F.col("n_covered")).alias("n_whole"))


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    facts = _facts(spark, d)
    base = lambda tag: facts.where(F.col("tag") == tag).select("file", "object", F.col("proc_name").alias("proc"), "line", F.col("name").alias("var"), "kind", "value", "block")
    defs, uses, procs, calls = base("def"), base("use"), base("proc"), base("call")
    declared = procs.select("object", "proc").union(load(spark, d, "procs").select(norm("object"), norm("proc_name"))).distinct()
    ancestors = cut(graphs.ancestor_chain(spark, d))
    known = load(spark, d, "resolved_calls").select("file", norm("object").alias("object"), norm("proc_name").alias("proc"), "line", scalar.last_dot_segment(F.trim("to_name")).alias("name"), norm("target_object").alias("callee_object"), norm("target_proc").alias("_proc"))
    targets = known.where("callee_object <> '' and _proc = name").drop("_proc")
    calls = cut(taint.callees(calls.select("file", "object", "proc", "line", F.col("var").alias("name"), F.col("kind").alias("receiver")), declared, ancestors, targets))
    args = uses.where("kind = 'call_arg'").select("object", "proc", "line", F.split_part("value", F.lit(":"), F.lit(1)).alias("name"), F.split_part("value", F.lit(":"), F.lit(2)).cast("int").alias("ordinal"), "var")
    params = base("param").select("object", "proc", F.col("value").cast("int").alias("ordinal"), "var").distinct()
    inter = taint.argument_edges(calls, args, params).union(taint.return_edges(calls, defs))
    return {"facts": facts, "defs": defs, "uses": uses, "procs": procs, "inter": cut(inter), "globals": cut(taint.global_uses(defs, uses, ancestors))}


def interproc_edges(spark: SparkSession, d: str) -> DataFrame:
    """Argument and return edges between procedures, and edges to and from the hubs of globals, by kind."""
    p = _parts(spark, d)
    hubs = p["globals"].select(F.when(F.col("writes"), "global_write").otherwise("global_read").alias("edge_kind"))
    return p["inter"].select("edge_kind").union(hubs).groupBy("edge_kind").agg(F.count("*").alias("n"))


def _taint(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    p = _parts(spark, d)
    edges = cut(taint.successors(taint.intra_edges(p["defs"], p["uses"]), p["uses"].where("kind = 'return'").select("object", "proc", "var"), p["inter"], p["globals"]))
    sql = p["facts"].where("tag = 'sql'").select("file", "object", F.col("proc_name").alias("proc"), "line", F.col("name").alias("operation"))
    statements = taint.statements(sql, p["uses"])
    return edges, cut(taint.sources(p["defs"], p["procs"])), cut(taint.sinks(statements)), p


def taint_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Sources that reach sinks, with the least number of hops."""
    edges, sources, sinks, _ = _taint(spark, d)
    found = taint.confirmed(edges, sources, sinks)
    return found.select(taint.key("source").alias("source_key"), taint.key("sink").alias("sink_key"), "hops")


def taint_reach_vars(spark: SparkSession, d: str) -> DataFrame:
    """How many variables each source reaches."""
    edges, sources, _, _ = _taint(spark, d)
    return taint.reaches(edges, sources).where("node.object <> '*global'").groupBy(taint.key("source").alias("source_key")).agg(F.count("*").alias("n"), F.max("hops").alias("max_hops"))


def taint_paths(spark: SparkSession, d: str) -> DataFrame:
    """One path per confirmed pair, as JSON."""
    edges, sources, sinks, _ = _taint(spark, d)
    return taint.paths(taint.confirmed_steps(edges, sources, sinks))


def taint_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The tainted variables of each block."""
    edges, sources, _, p = _taint(spark, d)
    tainted = fixpoint.reached(edges, sources.select(F.col("node").alias("seed")))
    return taint.annotations(tainted, p["uses"]).select("file", "object", "proc", "block", F.array_join("tainted_vars", ",").alias("tainted_vars"))


def proc_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each procedure reads and writes of instance variables, and what it returns."""
    p = _parts(spark, d)
    names = p["uses"].where("var like 'i%\\_%'").select("var").distinct()
    found = taint.summaries(p["defs"], p["uses"], names)
    return found.select("object", "proc", *[F.array_join(c, ",").alias(c) for c in ("globals_written", "globals_read", "returned")])


def slice_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The size of the backward slice of each host variable of a writing statement, whole."""
    p = _parts(spark, d)
    edges = cut(slicing.backward_edges(p["defs"], p["uses"], p["inter"]))
    point = F.struct("object", "proc", "line", "var")
    origins = p["uses"].where("kind = 'sql_host_var' and value = 'UPDATE'").select(point.alias("point")).distinct()
    sets = slicing.slice_sets(edges, origins)
    return sets.groupBy(F.to_json("origin").alias("origin")).agg(F.count("*").alias("n_points"), F.max("hops").alias("depth"))


def slice_walks(spark: SparkSession, d: str) -> DataFrame:
    """Forward walks from the parameters of functions, ended after 50 steps as in the reference."""
    p = _parts(spark, d)
    back = slicing.backward_edges(p["defs"], p["uses"], p["inter"])
    edges = cut(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    origins = p["defs"].where("kind = 'param'").select(F.struct("object", "proc", "line", "var").alias("point")).distinct()
    return slicing.slice_walks(edges, origins)


def slice_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How many procedures lie within one call of each."""
    p = _parts(spark, d)
    return slicing.neighbourhood(p["inter"], p["procs"]).groupBy("object", "proc").agg(F.count("*").alias("n"))


def event_flow(spark: SparkSession, d: str) -> DataFrame:
    """Taint over events: within each user, the types that follow a signup in any number of steps."""
    events = load(spark, d, "events")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    name = lambda c: F.concat_ws(":", F.col("user_id").cast("string"), c)
    edges = events.withColumn("n", nxt).where("n is not null").select(name("event_type").alias("src"), name("n").alias("dst")).distinct()
    starts = edges.where("src like '%:signup'").select(F.col("src").alias("seed"))
    return fixpoint.reach(edges, starts, zero_hops=False).where("node like '%:purchase'").select(F.col("seed").alias("source"), F.col("node").alias("sink"), "hops")


_ALL = (
    script_procs, script_headers, script_calls, script_sql, def_use, cfg_blocks, dataflow_facts, dead_variables, type_mismatches, variable_types, declared_and_used, script_call_resolution, loop_blocks, ssa_values, instruction_graph, proc_shapes, interpreter_coverage, interproc_edges, taint_confirmed, taint_reach_vars, taint_paths, taint_annotations, proc_summaries,
    slice_sizes, slice_walks, slice_neighbours, event_flow,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "event_flow": """with recursive n as (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) nx from events), e as (select distinct user_id || ':' || event_type src, user_id || ':' || nx dst from n where nx is not null),
      w as (select distinct src s, dst t, 1 as h from e where src like '%:signup' union select s, dst, h + 1 from w join e on src = t where h < 8) select s as source, t as sink, min(h)::int as hops from w where t like '%:purchase' group by 1, 2""",
}
