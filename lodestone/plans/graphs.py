"""Queries of the graph operators over the domain tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fixpoint, graph, hierarchy
from lodestone.plans.relational import IS_REPORT
from lodestone.session import cut, filled, load, norm, reports


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.forest(hierarchy.parent_links(spark, d)).where("parent is not null").select(F.col("name").alias("child"), "parent")


def _procs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), "proc_type", "cyclomatic", "confidence")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    names = ["object", "proc_name", "to_name"]
    return load(spark, d, "resolved_calls").select(*[norm(c).alias(c) for c in names], filled("target_object").alias("target_object"), filled("target_proc").alias("target_proc"), "call_type", "line")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return reports(load(spark, d, "objects")).select(norm("object").alias("object")).distinct()



def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every name's ancestors with their depth, nearest first."""
    links = _links(spark, d)
    found = graph.reaches(links.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    return found.select(F.col("x").alias("child"), F.col("hops").alias("depth"), F.col("y").alias("parent"))


def ancestors_of(spark: SparkSession, d: str) -> DataFrame:
    """The ancestors of the built-in class datawindow."""
    return graph.ancestors(_links(spark, d), "datawindow")


def descendants_of(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of the built-in class userobject."""
    return graph.descendants(_links(spark, d), "userobject")


def impact_inherited(spark: SparkSession, d: str) -> DataFrame:
    """What inherits from objects that write a table, with the least depth."""
    writers = load(spark, d, "sql_statement_columns").where("is_write").select(norm("object").alias("via")).distinct()
    return graph.impact(_links(spark, d), writers)


def inheritance_tree(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the tree below userobject."""
    return graph.subtree_edges(_links(spark, d), "userobject")


def dit(spark: SparkSession, d: str) -> DataFrame:
    """Depth of inheritance of every name that a root reaches."""
    return graph.dit(_links(spark, d))


def ego_edges(spark: SparkSession, d: str) -> DataFrame:
    """The inheritance edges within two steps of dragobject."""
    return graph.ego(_links(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")), "dragobject", 2)


def _object_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d).where("target_object is not null and object <> target_object")
    return calls.select(F.col("object").alias("src"), F.col("target_object").alias("dst"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    """In- and out-degree of objects in the simple call graph."""
    return graph.degrees(_object_calls(spark, d))


def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of objects in the call graph after 20 rounds."""
    return graph.pagerank(_object_calls(spark, d)).select("node", F.round("pagerank", 6).alias("pagerank"))


def betweenness_pivots(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of objects in the call graph, exact up to 500 objects, from 500 pivots beyond."""
    return graph.betweenness(_object_calls(spark, d))


def betweenness_exact(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of objects in the call graph from all objects as pivots, in lots."""
    return graph.betweenness(_object_calls(spark, d), None).select("node", F.round("betweenness", 9).alias("betweenness"))


def pagerank_settled(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of objects in the call graph until the ranks change by less than a millionth in sum."""
    return graph.pagerank(_object_calls(spark, d), rounds=200, tolerance=1e-6).select("node", F.round("pagerank", 6).alias("pagerank"))


def dead_procs(spark: SparkSession, d: str) -> DataFrame:
    """Procedures that no entry reaches."""
    return graph.dead_procs(_procs(spark, d), _calls(spark, d), _links(spark, d), _reports(spark, d))


def dead_code(spark: SparkSession, d: str) -> DataFrame:
    """The report on dead procedures with confidence and numbers of callers."""
    procs, calls = _procs(spark, d), _calls(spark, d)
    dead = graph.dead_procs(procs, calls, _links(spark, d), _reports(spark, d))
    return graph.dead_code(procs, calls, dead).select("object", "proc_name", "cyclomatic", "confidence", "caller_count_naive", "caller_count_scoped")


def live_procs(spark: SparkSession, d: str) -> DataFrame:
    """The procedures of statements that are not dead."""
    dead = graph.dead_procs(_procs(spark, d), _calls(spark, d), _links(spark, d), _reports(spark, d))
    statements = load(spark, d, "sql_statement_columns").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "line").distinct()
    return graph.live_procs(statements, dead).groupBy("object", "proc_name").agg(F.count("*").alias("n"))


def override_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Methods of a class that its descendants declare again."""
    edges = graph.override_edges(_procs(spark, d).where("confidence <> 'speculative'"), _links(spark, d))
    return edges.select(F.col("src.object").alias("parent"), F.col("dst.object").alias("child"), F.col("src.proc").alias("proc_name"))


def _legs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, source): a statement writes a column, a column is read by a statement; keys are encoded as in the schema graph."""
    return _leg_rows(spark, d).distinct()


def _leg_rows(spark: SparkSession, d: str) -> DataFrame:
    """The legs as often as they are written."""
    rows = load(spark, d, "sql_statement_columns").where("is_write is not null")
    clean = lambda c: F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ")
    stmt = F.concat_ws(":", F.lit("stmt:sql"), clean("file"), norm("object"), norm("proc_name"), clean("line"))
    column = F.concat(F.lit("col:"), F.concat_ws(".", norm("namespace"), norm("table_name"), norm("column_name")))
    legs = rows.select(stmt.alias("s"), column.alias("c"), "is_write")
    ends = [F.when(F.col("is_write"), F.col(a)).otherwise(F.col(b)) for a, b in (("s", "c"), ("c", "s"))]
    return legs.select(ends[0].alias("src"), ends[1].alias("dst"), F.when(F.col("is_write"), "writes").otherwise("reads").alias("kind"), F.lit("sql").alias("source"))


def schema_legs(spark: SparkSession, d: str) -> DataFrame:
    """The legs of the schema graph."""
    return _legs(spark, d)


def reach_closure(spark: SparkSession, d: str) -> DataFrame:
    """What is downstream of each column that a statement reads: all pairs, with the least number of legs."""
    legs = _legs(spark, d)
    columns = legs.where("src like 'col:%'").select(F.col("src").alias("seed"))
    return fixpoint.reach(legs, columns, zero_hops=False).select(F.col("seed").alias("x"), F.col("node").alias("y"), "hops")


def risk_count(spark: SparkSession, d: str) -> DataFrame:
    """How many names inherit from each class: its downstream count."""
    links = _links(spark, d)
    return graph.risk_count(graph.reaches(links.select(F.col("parent").alias("src"), F.col("child").alias("dst"))))


#: Conditions on the schema graph's nodes.
_COLUMN, _STATEMENT = "node like 'col:%'", "node like 'stmt:%'"


def coslice_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Per column, statement and direction, the number of legs of the shortest way in the schema graph."""
    return graph.coslice_lengths(_leg_rows(spark, d), _COLUMN, _STATEMENT)


def coslice_paths(spark: SparkSession, d: str) -> DataFrame:
    """The legs of the way chosen to each statement over all columns."""
    return graph.chosen_ways(_leg_rows(spark, d), _COLUMN, _STATEMENT)


def implied_keys(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customer and supplier joined over orders that no region declares in either direction."""
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = lines.select(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y")).distinct()
    nation = load(spark, d, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("x"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("y"), "n_regionkey")
    return graph.implied_keys(joined, a.join(b, "n_regionkey").where("x < y").select("x", "y"))


def weighted_hops(spark: SparkSession, d: str) -> DataFrame:
    """The least sum of weights from each column to what is downstream of it, a leg weighing the length of its end's key."""
    edges = _legs(spark, d).select("src", "dst", F.length("dst").cast("double").alias("label"))
    columns = edges.where("src like 'col:%'").select(F.col("src").alias("seed"))
    return fixpoint.closure(edges, columns, fixpoint.min_plus()).select("seed", "node", F.col("label").cast("long").alias("cost"))


def effect_closure(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of call that each class or one of its descendants makes: direct effects propagated over inheritance."""
    links = _links(spark, d)
    direct = _calls(spark, d).select("object", "call_type").distinct()
    up = graph.reaches(links.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    inherited = up.select(F.col("x").alias("object"), F.col("y")).join(direct.withColumnRenamed("object", "y"), "y").select("object", "call_type")
    return direct.union(inherited).groupBy("object").agg(F.array_join(F.array_sort(F.collect_set("call_type")), ",").alias("effects"))


def object_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Degrees, PageRank, betweenness, complexity and depth of inheritance of each object."""
    calls = _calls(spark, d).select("object", F.col("target_object").alias("to_name")).where("to_name is not null")
    return graph.object_metrics(calls, _procs(spark, d), _links(spark, d))


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct keys and the largest group of call targets, and how many exceed 500 rows."""
    groups = _calls(spark, d).groupBy("target_object", "target_proc").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total_rows"), F.count("*").alias("n_keys"), F.max("n").alias("max_group"), F.count_if(F.col("n") > 500).alias("n_hot"))


_ALL = (
    ancestor_chain, ancestors_of, descendants_of, impact_inherited, inheritance_tree, dit, ego_edges, degrees, pagerank_20, betweenness_pivots, betweenness_exact, pagerank_settled, dead_procs, dead_code, live_procs, override_pairs,
    schema_legs, reach_closure, risk_count, coslice_lengths, coslice_paths, implied_keys, weighted_hops, effect_closure, object_metrics, fan_in,
)
QUERIES = {f.__name__: f for f in _ALL}

_LINKS = """
links0 as (select lower(trim(object)) c, nullif(lower(trim(ancestor)), '') p from objects union all select lower(trim(child)), nullif(lower(trim(parent)), '') from type_ancestors union all select lower(trim(object)), lower(trim(ancestor)) from stdlib_members),
links as (select c as child, min(p) as parent from links0 where c <> '' and p is not null group by 1)
"""
_UP = _LINKS + ", up as (select child, parent, 1 as depth from links union select up.child, l.parent, depth + 1 from up join links l on l.child = up.parent where depth < 1000)"
_UPMIN = _UP + ", anc as (select child, parent, min(depth) depth from up group by 1, 2)"
_PROCS = """
procs1 as (select lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, proc_type, cyclomatic, confidence from procs where confidence <> 'speculative'),
calls1 as (select lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, lower(trim(to_name)) as to_name, nullif(lower(trim(target_object)), '') as target_object, nullif(lower(trim(target_proc)), '') as target_proc, call_type from resolved_calls)
"""
_DEAD = (
    _UPMIN
    + ","
    + _PROCS
    + """,
callref as (select distinct object, proc_name, string_split(to_name, '.')[-1] as callee from calls1),
e as (select r.object so, r.proc_name sp, r.object do_, p.proc_name dp from callref r join (select distinct object, proc_name from procs1) p on p.object = r.object and p.proc_name = r.callee
  union select object, proc_name, target_object, target_proc from calls1 where target_object is not null and target_proc is not null
  union select a.parent, m.proc_name, a.child, m.proc_name from anc a join (select distinct object, proc_name from procs1) m on m.object = a.parent join (select distinct object, proc_name from procs1) n on n.object = a.child and n.proc_name = m.proc_name),
live as (select object, proc_name from procs1 where proc_type in ('event', 'on') union select object, proc_name from calls1 where object in (select lower(trim(object)) from objects where IS_REPORT)
  union select do_, dp from live join e on e.so = live.object and e.sp = live.proc_name),
dead as (select distinct object, proc_name from procs1 where (object, proc_name) not in (select object, proc_name from live))
""".replace("IS_REPORT", IS_REPORT)
)
_LEGS = """
legs0 as (select distinct concat_ws(':', 'stmt:sql', translate(coalesce(file, ''), chr(9) || chr(13) || chr(10), '   '), lower(trim(object)), lower(trim(proc_name)), coalesce(line::varchar, '')) s,
  'col:' || concat_ws('.', lower(trim(namespace)), lower(trim(table_name)), lower(trim(column_name))) c, is_write from sql_statement_columns where is_write is not null),
legs as (select case when is_write then s else c end src, case when is_write then c else s end dst, case when is_write then 'writes' else 'reads' end kind, 'sql' source from legs0)
"""
ORACLE = {
    "ancestor_chain": f"with recursive {_UPMIN} select child, depth::int as depth, parent from anc",
    "ancestors_of": f"with recursive {_UPMIN} select depth::int as depth, parent from anc where child = 'datawindow'",
    "descendants_of": f"with recursive {_UPMIN} select child as descendant from anc where parent = 'userobject'",
    "impact_inherited": f"with recursive {_UPMIN} select child as descendant, parent as via, depth::int as depth from anc where parent in (select lower(trim(object)) from sql_statement_columns where is_write) and depth <= 15",
    "inheritance_tree": f"with recursive {_UPMIN} select child, parent from links where parent = 'userobject' or parent in (select child from anc where parent = 'userobject')",
    "dit": f"with recursive {_LINKS}, roots as (select distinct parent as r from links where parent not in (select child from links)), down as (select r as name, 0 as h from roots union all select l.child, h + 1 from down join links l on l.parent = down.name) select name, max(h)::int as dit from down group by 1",
    "ego_edges": f"""with recursive {_LINKS}, e as (select child as src, parent as dst from links), u as (select src, dst from e union select dst, src from e),
      near as (select 'dragobject' as n union select dst from u where src = 'dragobject'), near2 as (select n from near union select dst from u join near on src = n) select distinct src, dst from e where src in (select n from near2) and dst in (select n from near2)""",
    "degrees": f"with {_PROCS}, e as (select distinct object as src, target_object as dst from calls1 where object <> target_object) select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1",
    "pagerank_20": f"""with recursive {_PROCS}, e as materialized (select distinct object as src, target_object as dst from calls1 where object <> target_object), nodes as materialized (select src as node from e union select dst from e), n as (select count(*)::double as n from nodes), deg as (select src, count(*)::double as deg from e group by 1),
      r as (select 0 as k, node, 1 / n as pr from nodes, n union all
        select k + 1, node, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) from (select (select max(k) from r) as k, x.node, (select n from n) as n,
          (select sum(r.pr / deg.deg) from r join e on e.src = r.node join deg on deg.src = r.node where e.dst = x.node) as got, (select coalesce(sum(r.pr), 0) from r where r.node not in (select src from deg)) as loose from nodes x) where k < 20)
      select node, round(pr, 6) as pagerank from r where k = 20""",
    "dead_procs": f"with recursive {_DEAD} select object, proc_name from dead",
    "dead_code": f"""with recursive {_DEAD}, naive as (select callee, count(*) n from callref group by 1), scoped as (select target_object o, target_proc p, count(*) n from calls1 where target_object is not null and target_proc is not null group by 1, 2),
      m as (select object, proc_name, max(cyclomatic) as cyclomatic from procs1 where (object, proc_name) in (select object, proc_name from dead) group by 1, 2)
      select object, proc_name, cyclomatic, case when naive.n is null then 'high' when scoped.n is null then 'medium' else 'low' end as confidence, coalesce(naive.n, 0) as caller_count_naive, coalesce(scoped.n, 0) as caller_count_scoped
      from m left join naive on callee = proc_name left join scoped on o = object and p = proc_name""",
    "live_procs": f"with recursive {_DEAD}, st as (select distinct file, lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, line from sql_statement_columns) select object, proc_name, count(*) as n from st where not exists (select 1 from dead where dead.object = st.object and dead.proc_name = st.proc_name) group by 1, 2",
    "override_pairs": f"with recursive {_UPMIN}, {_PROCS}, m as (select distinct object, proc_name from procs1) select a.parent, a.child, p.proc_name from anc a join m p on p.object = a.parent join m c on c.object = a.child and c.proc_name = p.proc_name",
    "schema_legs": f"with {_LEGS} select src, dst, kind, source from legs",
    "reach_closure": f"with recursive {_LEGS}, w as (select src as x, dst as y, 1 as h from legs where src like 'col:%' union select x, dst, h + 1 from w join legs on src = y where h < 40) select x, y, min(h)::int as hops from w group by 1, 2",
    "risk_count": f"with recursive {_UPMIN} select parent as x, count(*) as n from anc group by 1",
    "coslice_lengths": f"""with recursive {_LEGS}, fw as (select src as x, dst as y, 1 as h from legs where src like 'col:%' union select x, dst, h + 1 from fw join legs on src = y where h < 40), bw as (select dst as x, src as y, 1 as h from legs where dst like 'col:%' union select x, src, h + 1 from bw join legs on dst = y where h < 40),
      w as (select 'forward' d, x, y, min(h) h from fw where y like 'stmt:%' group by all union all select 'backward', x, y, min(h) from bw where y like 'stmt:%' group by all) select x as seed_key, y as target_key, d as direction, h::bigint as n_legs, 0 as first, (h - 1)::int as last from w""",
    "implied_keys": """with j as (select distinct c_nationkey x, s_nationkey y from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey),
      f as (select a.n_nationkey x, b.n_nationkey y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey)
      select x, y from j where not exists (select 1 from f where f.x = j.x and f.y = j.y) and not exists (select 1 from f where f.x = j.y and f.y = j.x)""",
    "weighted_hops": f"""with recursive {_LEGS}, w as (select src as seed, src as node, 0::bigint as cost from legs where src like 'col:%' union select seed, dst, cost + length(dst) from w join legs on src = node where cost < 900) select seed, node, min(cost)::bigint as cost from w group by 1, 2""",
    "effect_closure": f"with recursive {_UPMIN}, {_PROCS}, direct as (select distinct object, call_type from calls1), a as (select object, call_type from direct union select parent, call_type from anc join direct on object = child) select object, string_agg(call_type, ',' order by call_type) as effects from a group by 1",
    "fan_in": f"with {_PROCS}, g as (select count(*) n from calls1 group by target_object, target_proc) select sum(n)::bigint as total_rows, count(*) as n_keys, max(n) as max_group, count(*) filter (n > 500) as n_hot from g",
}
