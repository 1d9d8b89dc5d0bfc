"""Inter-procedural taint: successor edges, closure, confirmed pairs, witness steps and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import fixpoint
from lodestone.operators import parts as connected
from lodestone.session import cut

NODE = "object string, proc string, var string"
# Severities and categories of sinks.
SEVERITY = {"INSERT": "high", "UPDATE": "high", "DELETE": "high", "EXECUTE": "critical", "CALL": "medium"}
CATEGORY = {"INSERT": "sql_write", "UPDATE": "sql_write", "DELETE": "sql_write", "EXECUTE": "dynamic_sql", "CALL": "dispatch"}


def node(object_: Column | str, proc: Column | str, var: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(object_).alias("object"), col(proc).alias("proc"), col(var).alias("var"))


def key(n: str) -> Column:
    """``object::proc::var`` of a node column."""
    return F.concat_ws("::", f"{n}.object", f"{n}.proc", f"{n}.var")


def intra_edges(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(object, proc, use_var, def_var): a variable used in the expression that defines another, on one line."""
    u = uses.where(F.col("kind").isin("rhs", "call_arg")).select("file", "object", "proc", "line", F.col("var").alias("use_var")).distinct()
    d = defs.where(F.col("kind").isin("assign", "augassign", "local_var")).select("file", "object", "proc", "line", F.col("var").alias("def_var")).distinct()
    return u.join(d, ["file", "object", "proc", "line"]).where("use_var <> def_var").select("object", "proc", "use_var", "def_var").distinct()


def argument_edges(calls: DataFrame, arguments: DataFrame, params: DataFrame) -> DataFrame:
    """(caller_object, caller_proc, caller_line, callee_object, callee_proc, edge_kind, caller_var, callee_var).

    A use at an argument's place is matched with the parameter of that ordinal; a
    surplus argument goes to ``*extra``. calls: (object, proc, line, name, callee_object);
    arguments: (object, proc, line, name, ordinal, var); params: (object, proc, ordinal, var).
    """
    a = arguments.join(calls.select("object", "proc", "line", "name", "callee_object").distinct(), ["object", "proc", "line", "name"])
    p = params.select(F.col("object").alias("callee_object"), F.col("proc").alias("name"), "ordinal", F.col("var").alias("callee_var"))
    known = params.select(F.col("object").alias("callee_object"), F.col("proc").alias("name")).distinct()
    matched = a.join(known, ["callee_object", "name"], "left_semi").join(p, ["callee_object", "name", "ordinal"], "left")
    return matched.select(
        F.col("object").alias("caller_object"), F.col("proc").alias("caller_proc"), F.col("line").alias("caller_line"), "callee_object", F.col("name").alias("callee_proc"), F.lit("arg").alias("edge_kind"),
        F.col("var").alias("caller_var"), F.coalesce("callee_var", F.lit("*extra")).alias("callee_var"),
    ).distinct()


def return_edges(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Edges from a called procedure to the variable that its caller assigns on the line of the call."""
    d = defs.where(F.col("kind").isin("assign", "local_var", "augassign")).select("object", "proc", "line", F.col("var").alias("caller_var"))
    joined = calls.join(d, ["object", "proc", "line"])
    return joined.select(
        F.col("object").alias("caller_object"), F.col("proc").alias("caller_proc"), F.col("line").alias("caller_line"), "callee_object", F.col("name").alias("callee_proc"), F.lit("return").alias("edge_kind"), "caller_var", F.lit(None).cast("string").alias("callee_var"),
    ).distinct()


def successors(intra: DataFrame, returned: DataFrame, inter: DataFrame, globals_: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, description) of taint between nodes (object, proc, var): the union of four joins.

    returned: (object, proc, var), the variables that a procedure returns. globals_:
    (object, proc, var, writes): a global goes through a hub node of its own, so writers
    and readers are not multiplied. A column ``hub``, if there, tells hubs of one name apart.
    """
    edges = [intra.select(node("object", "proc", "use_var").alias("src"), node("object", "proc", "def_var").alias("dst"), F.lit("def").alias("kind"), F.concat("use_var", F.lit(" used in expression that defines "), "def_var").alias("description"))]
    arg = inter.where("edge_kind = 'arg'")
    edges.append(arg.select(node("caller_object", "caller_proc", "caller_var").alias("src"), node("callee_object", "callee_proc", "callee_var").alias("dst"), F.lit("arg").alias("kind"), F.concat(F.lit("passed as argument from "), "caller_object", F.lit("."), "caller_proc").alias("description")))
    back = inter.where("edge_kind = 'return'").join(returned.select(F.col("object").alias("callee_object"), F.col("proc").alias("callee_proc"), "var").distinct(), ["callee_object", "callee_proc"])
    edges.append(back.select(node("callee_object", "callee_proc", "var").alias("src"), node("caller_object", "caller_proc", "caller_var").alias("dst"), F.lit("return").alias("kind"), F.concat(F.lit("return value of "), "callee_object", F.lit("."), "callee_proc", F.lit(" received by caller")).alias("description")))
    if globals_ is not None:
        hub = node(F.lit("*global"), F.col("hub") if "hub" in globals_.columns else F.lit(""), F.col("var"))
        own = node("object", "proc", "var")
        edges.append(globals_.where("writes").select(own.alias("src"), hub.alias("dst"), F.lit("global").alias("kind"), F.concat(F.lit("global variable "), "var", F.lit(" written in "), "object", F.lit("."), "proc").alias("description")))
        edges.append(globals_.where("not writes").select(hub.alias("src"), own.alias("dst"), F.lit("global").alias("kind"), F.concat(F.lit("global variable "), "var", F.lit(" read in "), "object", F.lit("."), "proc").alias("description")))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out.distinct()


def callees(calls: DataFrame, declared: DataFrame, ancestors: DataFrame, targets: DataFrame) -> DataFrame:
    """(object, proc, line, name, callee_object) of the calls that can be resolved.

    A call site's known target comes first; else own object, nearest ancestor that
    declares the name, a unique declaration anywhere. ``super`` leaves out the own
    object, any receiver but ``this`` and ``super`` all but the unique one. calls:
    (file, object, proc, line, name, receiver); declared: (object, proc); ancestors:
    (child, depth, parent); targets: (file, object, proc, line, name, callee_object).
    """
    site = ["file", "object", "proc", "line", "name"]
    given = calls.join(targets, site).select(*site, "callee_object").distinct()
    keys = calls.join(given.select(*site).distinct(), site, "left_anti").select(*site, F.coalesce("receiver", F.lit("this")).alias("receiver")).distinct()
    names = keys.select("object", "name").distinct()
    owners = declared.select(F.col("object").alias("callee_object"), F.col("proc").alias("name")).distinct()
    own = names.join(owners, (names["object"] == owners["callee_object"]) & (names["name"] == owners["name"])).select("object", names["name"], "callee_object", F.lit(0).alias("rank"))
    up = names.join(ancestors.select(F.col("child").alias("object"), F.col("parent").alias("callee_object"), F.col("depth").alias("rank")), "object").join(owners, ["callee_object", "name"])
    unique = owners.groupBy("name").agg(F.count("*").alias("n"), F.min("callee_object").alias("callee_object")).where("n = 1")
    anywhere = names.join(unique, "name").select("object", "name", "callee_object", F.lit(1_000_000).alias("rank"))
    ranked = own.union(up.select("object", "name", "callee_object", "rank")).union(anywhere)
    allowed = F.when(F.col("receiver") == "this", True).when(F.col("receiver") == "super", F.col("rank") > 0).otherwise(F.col("rank") == 1_000_000)
    best = keys.join(ranked, ["object", "name"]).where(allowed).groupBy(*site, "receiver").agg(F.min(F.struct("rank", "callee_object")).alias("x"))
    found = best.select(*site, F.col("x.callee_object").alias("callee_object"))
    return given.union(found).select("object", "proc", "line", "name", "callee_object").distinct()


def global_uses(defs: DataFrame, uses: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(object, proc, var, writes, hub) of instance and global variables, known by their prefixes ``i`` and ``g``.

    A global has one hub. An instance variable is shared by an object with its ancestors
    and descendants, not with others that use the name: its hub is the reading object,
    and a writer leads to the hubs of all that it shares it with. A parameter or local
    of the name hides it.
    """
    own = defs.where("kind in ('param', 'local_var')").select("object", "proc", "var").distinct()
    both = defs.select("object", "proc", "var", F.lit(True).alias("writes")).union(uses.select("object", "proc", "var", F.lit(False).alias("writes")))
    both = both.where(r"var rlike '^[ig][a-z]*_'").distinct().join(own, ["object", "proc", "var"], "left_anti")
    once = both.where("var like 'g%'").withColumn("hub", F.lit(""))
    inst = both.where("var like 'i%'")
    reads = inst.where("not writes").withColumn("hub", F.col("object"))
    hubs = reads.select("hub", "var").distinct()
    line = ancestors.select(F.col("child").alias("object"), F.col("parent").alias("hub"))
    shared = line.union(line.select("hub", "object")).distinct()
    writes = inst.where("writes")
    near = writes.withColumn("hub", F.col("object")).unionByName(writes.join(shared, "object")).join(hubs, ["hub", "var"], "left_semi").select("object", "proc", "var", "writes", "hub")
    return once.unionByName(reads).unionByName(near).distinct()


def statements(sql: DataFrame, uses: DataFrame) -> DataFrame:
    """(object, proc, operation, vars): every statement of sql (file, object, proc, line, operation) with its host variables, none being an empty array."""
    at = ["file", "object", "proc", "line", "operation"]
    hosts = uses.where("kind = 'sql_host_var'").select("file", "object", "proc", "line", F.col("value").alias("operation"), "var")
    return sql.select(*at).distinct().join(hosts, at, "left").groupBy(*at).agg(F.collect_set("var").alias("vars")).select("object", "proc", "operation", "vars")


def sources(defs: DataFrame, procs: DataFrame) -> DataFrame:
    """(node, source_type): variables that SELECT INTO fills, and parameters of events."""
    into = defs.where("kind = 'sql_into'").select(node("object", "proc", "var").alias("node"), F.lit("sql_into").alias("source_type"))
    events = procs.where("kind = 'event'").select("object", "proc").distinct()
    params = defs.where("kind = 'param'").join(events, ["object", "proc"], "left_semi").select(node("object", "proc", "var").alias("node"), F.lit("event_param").alias("source_type"))
    return into.union(params).distinct()


def sinks(statements: DataFrame) -> DataFrame:
    """(node, sink_type, severity, category) of writing and executing statements by host variable; ``*exec`` where there is none.

    statements: (object, proc, operation, vars array).
    """
    rows = statements.where(F.col("operation").isin(*SEVERITY)).select("object", "proc", "operation", F.explode_outer("vars").alias("var"))
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("operation")]
    return rows.select(node("object", "proc", F.coalesce("var", F.lit("*exec"))).alias("node"), F.col("operation").alias("sink_type"), lookup(SEVERITY).alias("severity"), lookup(CATEGORY).alias("category")).distinct()


def reaches(edges: DataFrame, source_nodes: DataFrame) -> DataFrame:
    """(source, node, hops) of what sources reach; a source itself only over a cycle."""
    return fixpoint.reach(edges, source_nodes.select(F.col("node").alias("seed")), zero_hops=False).select(F.col("seed").alias("source"), "node", "hops")


def confirmed(edges: DataFrame, source_nodes: DataFrame, sink_nodes: DataFrame) -> DataFrame:
    """(source, sink, hops) of sources that reach sinks, 0 hops included, one row per pair."""
    found = fixpoint.reach(edges, source_nodes.select(F.col("node").alias("seed")))
    ends = sink_nodes.select("node").distinct()
    return found.join(ends, "node", "left_semi").select(F.col("seed").alias("source"), F.col("node").alias("sink"), "hops")


def steps(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, sink, ordinal, at, step_kind): ordinal 0 is ``source``, then the kind of each edge, then ``sink``; 0 hops give ``source-sink``."""
    pairs = cut(pairs)
    far = pairs.where("hops > 0")
    dist = fixpoint.reach(edges, far.select(F.col("source").alias("seed")))
    legs = fixpoint.witness_legs(edges.select("src", "dst", "kind"), cut(dist)).join(far.select(F.col("source").alias("seed"), F.col("sink").alias("target")), ["seed", "target"], "left_semi")
    walked = legs.select(F.col("seed").alias("source"), F.col("target").alias("sink"), (F.col("leg_ord") + 1).alias("ordinal"), F.col("leg_to").alias("at"), F.col("kind").alias("step_kind"))
    first = far.select("source", "sink", F.lit(0).alias("ordinal"), F.col("source").alias("at"), F.lit("source").alias("step_kind"))
    last = far.select("source", "sink", (F.col("hops") + 1).alias("ordinal"), F.col("sink").alias("at"), F.lit("sink").alias("step_kind"))
    none = pairs.where("hops = 0").select("source", "sink", F.lit(0).alias("ordinal"), F.col("source").alias("at"), F.lit("source-sink").alias("step_kind"))
    return first.union(walked).union(last).union(none)


def confirmed_steps(edges: DataFrame, source_nodes: DataFrame, sink_nodes: DataFrame) -> DataFrame:
    """What ``steps`` gives of ``confirmed``: walked forth and back within whole connected parts, without a round per hop."""
    edges = edges.select("src", "dst", "kind")
    starts, ends = source_nodes.select("node").distinct(), sink_nodes.select("node").distinct()
    rows, large = connected.gather(edges, {"source": starts, "sink": ends})
    of = f"struct<{NODE.replace(' string', ':string')}>"

    def run(table: pa.Table) -> Iterator[dict[str, list]]:
        part = connected.Part(table)
        n, goal = part.n, part.marked(table["sink"])
        walker = connected.Walker(n, part.src, part.dst)
        name = lambda v: [part.names[i] for i in v]
        for lot in walker.lots(np.flatnonzero(part.marked(table["source"]))):
            row = lambda cells, ordinal, at, kind, lot=lot: {"source": name(lot[cells // n]), "sink": name(cells % n), "ordinal": ordinal.astype(np.int32), "at": name(at), "step_kind": kind}
            levels, legs = walker.walk(lot)
            found = np.concatenate(levels)
            found = found[goal[found % n]]
            hops = walker.hops[found].astype(np.int64)
            walker.forget(levels)
            same, far, hops = found[hops == 0], found[hops > 0], hops[hops > 0]
            yield row(same, np.zeros(len(same)), lot[same // n], ["source-sink"] * len(same))
            yield row(far, np.zeros(len(far)), lot[far // n], ["source"] * len(far))
            yield row(far, hops + 1, far % n, ["sink"] * len(far))
            if len(far):
                for pair, ordinal, a, b in connected.witnesses(n, far, hops, *(np.concatenate(x) for x in zip(*legs, strict=True))):
                    yield row(far[pair], ordinal + 1, b, [k for (k,) in part.kind(a, b)])

    out = connected.per_bundle(rows, run, f"source {of}, sink {of}, ordinal int, at {of}, step_kind string")
    if large is None:
        return out
    edges, starts, ends = connected.within(edges, large), starts.join(large, "node", "left_semi"), ends.join(large, "node", "left_semi")
    return out.union(steps(edges, confirmed(edges, starts, ends)))


def paths(step_rows: DataFrame) -> DataFrame:
    """(source_key, sink_key, n_steps, steps_json): one row per confirmed pair; quotes in names are escaped."""
    each = F.struct("ordinal", F.col("at.object").alias("object"), F.col("at.proc").alias("proc_name"), F.col("at.var").alias("var_name"), "step_kind")
    grouped = step_rows.groupBy(key("source").alias("source_key"), key("sink").alias("sink_key")).agg(F.array_sort(F.collect_list(each)).alias("steps"))
    plain = F.transform("steps", lambda s: F.struct(s["object"].alias("object"), s["proc_name"].alias("proc_name"), s["var_name"].alias("var_name"), s["step_kind"].alias("step_kind")))
    return grouped.select("source_key", "sink_key", F.size("steps").alias("n_steps"), F.to_json(plain).alias("steps_json"))


def annotations(tainted: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, object, proc, block, tainted_vars): the tainted variables that each block uses, sorted."""
    names = tainted.select(F.col("node.object").alias("object"), F.col("node.proc").alias("proc"), F.col("node.var").alias("var")).distinct()
    joined = uses.join(names, ["object", "proc", "var"], "left_semi")
    return joined.groupBy("file", "object", "proc", "block").agg(F.array_sort(F.collect_set("var")).alias("tainted_vars"))


def summaries(defs: DataFrame, uses: DataFrame, global_names: DataFrame) -> DataFrame:
    """(object, proc, globals_written, globals_read, returned): what each procedure does to globals and what it returns."""
    w = defs.join(global_names, "var", "left_semi").select("object", "proc", F.col("var").alias("w"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("ret"))
    r = uses.join(global_names, "var", "left_semi").select("object", "proc", F.lit(None).cast("string"), "var", F.lit(None).cast("string"))
    ret = uses.where("kind = 'return'").select("object", "proc", F.lit(None).cast("string"), F.lit(None).cast("string"), "var")
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    return w.union(r).union(ret).groupBy("object", "proc").agg(sorted_set("w").alias("globals_written"), sorted_set("r").alias("globals_read"), sorted_set("ret").alias("returned"))
