"""The services behind the reference's pages, each as a function that gives a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import bad_records, typing
from lodestone.plans import catalog, graphs, programs, relational, reports, schemas
from lodestone.session import load, norm
from lodestone.sources.script import script_facts


def paged(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one page in a total order, the total as one row)."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def filtered(df: DataFrame, **conditions: object) -> DataFrame:
    """Rows that meet the conditions given; None means no condition, text is compared in any case."""
    tests = [norm(k) == str(v).strip().lower() if isinstance(v, str) else F.col(k) == v for k, v in conditions.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search(spark: SparkSession, d: str, text: str) -> DataFrame:
    """(kind, name, detail) of objects, procedures, tables and columns whose name holds a text, in any case."""
    like = f"%{text}%"
    objects = load(spark, d, "objects").where(F.col("object").ilike(like)).select(F.lit("object").alias("kind"), norm("object").alias("name"), F.col("file").alias("detail"))
    procs = load(spark, d, "procs").where(F.col("proc_name").ilike(like)).select(F.lit("procedure"), norm("proc_name"), norm("object"))
    columns = load(spark, d, "catalog_columns")
    tables = columns.where(F.col("table_name").ilike(like)).select(F.lit("table"), norm("table_name"), norm("namespace"))
    fields = columns.where(F.col("column_name").ilike(like)).select(F.lit("column"), norm("column_name"), norm("table_name"))
    return objects.union(procs).union(tables).union(fields).distinct()


def object_detail(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(section, name, detail) of one object: itself, ancestors, procedures, controls, tables."""
    own = filtered(load(spark, d, "objects"), object=name).select(F.lit("object").alias("section"), norm("object").alias("name"), F.col("file").alias("detail"))
    links = graphs._links(spark, d)
    from lodestone.operators import graph

    ancestors = graph.ancestors(links, name.lower()).select(F.lit("ancestor"), "parent", F.col("depth").cast("string"))
    procs = filtered(load(spark, d, "procs"), object=name).select(F.lit("procedure"), norm("proc_name"), F.col("proc_type"))
    controls = load(spark, d, "type_ancestors").where(norm("child").startswith(name.lower() + ".")).select(F.lit("control"), norm("child"), norm("parent"))
    tables = filtered(load(spark, d, "sql_statement_columns"), object=name).select(F.lit("table"), norm("table_name"), F.when(F.col("is_write"), "write").otherwise("read"))
    return own.union(ancestors).union(procs).union(controls).union(tables).distinct()


def uses_of(spark: SparkSession, d: str) -> DataFrame:
    """(object, how, used_by) of every object: called, inherited, placed as a control, its table read or written."""
    calls = load(spark, d, "resolved_calls").select(norm("target_object").alias("object"), F.lit("call").alias("how"), norm("object").alias("used_by"))
    heirs = load(spark, d, "objects").select(norm("ancestor"), F.lit("inherits"), norm("object"))
    controls = load(spark, d, "type_ancestors").select(norm("parent"), F.lit("control"), F.split_part(norm("child"), F.lit("."), F.lit(1)))
    rows = load(spark, d, "sql_statement_columns").select(norm("table_name"), F.when(F.col("is_write"), "writes").otherwise("reads"), norm("object"))
    return calls.union(heirs).union(controls).union(rows).where("object <> ''").distinct()


def uses_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many users each object has, by the way of use."""
    return uses_of(spark, d).groupBy("object", "how").agg(F.count("*").alias("n"))


def procedure_list(spark: SparkSession, d: str) -> DataFrame:
    """Procedures with the number of distinct callers."""
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), "proc_type").distinct()
    calls = load(spark, d, "resolved_calls").select(norm("target_object").alias("object"), norm("target_proc").alias("proc_name"), F.concat(norm("object"), F.lit("."), norm("proc_name")).alias("caller"))
    return procs.join(calls, ["object", "proc_name"], "left").groupBy("object", "proc_name", "proc_type").agg(F.count_distinct("caller").alias("n_callers"))


def procedure_detail(spark: SparkSession, d: str, object_: str, proc: str) -> DataFrame:
    """(section, name, detail) of one procedure: callers, callees, statements, lint."""
    calls = load(spark, d, "resolved_calls")
    callers = filtered(calls, target_object=object_, target_proc=proc).select(F.lit("caller").alias("section"), norm("object").alias("name"), norm("proc_name").alias("detail"))
    callees = filtered(calls, object=object_, proc_name=proc).select(F.lit("callee"), norm("to_name"), norm("target_object"))
    rows = filtered(load(spark, d, "sql_statement_columns"), object=object_, proc_name=proc).select(F.lit("sql"), norm("table_name"), norm("column_name"))
    return callers.union(callees).union(rows).distinct()


def library_detail(spark: SparkSession, d: str) -> DataFrame:
    """Per library: objects, procedures, and objects that nothing outside calls."""
    lib = scalar.library(F.col("file")).alias("library")
    objects = load(spark, d, "objects").select(lib, norm("object").alias("object")).distinct()
    called = load(spark, d, "resolved_calls").select(norm("target_object").alias("object"), scalar.library(F.col("file")).alias("from_library")).distinct()
    outside = objects.join(called, "object").where("library <> from_library").select("library", "object").distinct().withColumn("used", F.lit(1))
    joined = objects.join(outside, ["library", "object"], "left")
    return joined.groupBy("library").agg(F.count("*").alias("n_objects"), F.count_if(F.col("used").isNull()).alias("n_internal"))


def report_detail(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Controls of one report by band, place; columns; arguments; what it reads."""
    facts = reports.facts(spark, d).where(F.col("object") == name.lower())
    return facts.select("tag", "name", "value", F.col("op").alias("band"), F.expr("try_cast(other as int)").alias("x"), F.expr("try_cast(logic as int)").alias("y"), "ordinal").orderBy("tag", "band", "y", "x", "ordinal")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """(severity, code, n) over lint findings, unread statements and unresolved calls."""
    lint = catalog._lint(spark, d).groupBy("severity", F.col("issue_code").alias("code")).agg(F.count("*").alias("n"))
    calls = load(spark, d, "resolved_calls").where("kind = 'unresolved'").agg(F.count("*").alias("n")).select(F.lit("info").alias("severity"), F.lit("unresolved_call").alias("code"), "n")
    return lint.union(calls)


def code_quality(spark: SparkSession, d: str) -> DataFrame:
    """(measure, bucket, n): complexity, parameters and kinds of procedures and calls."""
    procs = load(spark, d, "procs")
    band = F.when(F.col("cyclomatic").isNull(), "unknown").when(F.col("cyclomatic") > 10, "high").when(F.col("cyclomatic") > 4, "medium").otherwise("low")
    n_params = F.when(F.coalesce("param_names", F.lit("")) == "", 0).otherwise(F.size(F.split("param_names", "[|]"))).cast("string")
    parts = [procs.groupBy(F.lit("complexity").alias("measure"), band.alias("bucket")).agg(F.count("*").alias("n")), procs.groupBy(F.lit("parameters"), n_params).agg(F.count("*"))]
    parts.append(load(spark, d, "resolved_calls").groupBy(F.lit("calls"), F.col("kind")).agg(F.count("*")))
    return reduce(DataFrame.union, parts)


def explain_source(spark: SparkSession, d: str) -> DataFrame:
    """(object, proc_name, first_line, n_lines) of procedures with their slice of the source."""
    procs = load(spark, d, "procs").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "start_line", "end_line").distinct()
    files = load(spark, d, "source_files").select("file", F.split(F.regexp_replace("lines", "\r\n", "\n"), "\n").alias("lines"))
    body = F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    sliced = procs.join(files.where("lines is not null"), "file").where("start_line is not null and end_line is not null").withColumn("body", body)
    return sliced.select("object", "proc_name", "start_line", F.get("body", F.lit(0)).alias("first_line"), F.size("body").alias("n_lines"))


def impact_of_column(spark: SparkSession, d: str, table: str, column: str | None = None) -> DataFrame:
    """(object, proc_name, how) of what touches a table's column directly, and (descendants) by inheritance."""
    rows = filtered(load(spark, d, "sql_statement_columns"), table_name=table, column_name=column)
    direct = rows.select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), F.lit("DIRECT").alias("how")).distinct()
    from lodestone.operators import graph

    heirs = graph.impact(graphs._links(spark, d), direct.select(F.col("object").alias("via")).distinct())
    return direct.union(heirs.select(F.col("descendant"), F.lit(None).cast("string"), F.lit("INHERITED"))).distinct()


def diagram_edges(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(src, dst, weight) edges of a diagram: inheritance, calls, tables, heatmap, sql-lineage, table-lineage, proc-tables, fk-graph, lattice."""
    if kind == "inheritance":
        return graphs._links(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1).cast("long").alias("weight"))
    if kind == "calls":
        return graphs._object_calls(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if kind == "fk-graph":
        return schemas.fk_edges(spark, d).groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.count("*").alias("weight"))
    if kind == "lattice":
        covers = schemas.window_tables(spark, d)
        return covers.select(F.explode("upper").alias("dst"), "scope", "concept").select(F.concat_ws(":", "scope", F.col("concept").cast("string")).alias("src"), F.concat_ws(":", "scope", F.col("dst").cast("string")).alias("dst"), F.lit(1).cast("long").alias("weight"))
    rows = relational.all_sql_tables(spark, d)
    if kind == "sql-lineage":
        return rows.where("source = 'powerscript'").groupBy(F.col("object").alias("src"), F.concat_ws(":", "table_name", "operation").alias("dst")).agg(F.count("*").alias("weight"))
    if kind == "table-lineage":
        return rows.groupBy(F.col("table_name").alias("src"), F.concat_ws(":", "source", "object", "operation").alias("dst")).agg(F.count("*").alias("weight"))
    if kind == "proc-tables":
        return rows.groupBy(F.concat_ws(".", "object", "proc_name").alias("src"), F.concat_ws(":", "table_name", "operation", "source").alias("dst")).agg(F.count("*").alias("weight"))
    if kind == "tables":
        return rows.groupBy(F.col("object").alias("src"), F.col("table_name").alias("dst")).agg(F.count("*").alias("weight"))
    if kind == "heatmap":
        repository = load(spark, d, "objects").select(norm("object").alias("object"), scalar.library(F.col("file")).alias("library")).distinct()
        return rows.join(repository, "object").groupBy(F.col("library").alias("src"), F.col("table_name").alias("dst")).agg(F.count("*").alias("weight"))
    raise ValueError(f"unknown diagram {kind}")


def taint_listing(spark: SparkSession, d: str, object_: str | None = None, sink_object: str | None = None) -> DataFrame:
    """Confirmed pairs, by object of the source or sink; both filters are real ones."""
    pairs = programs.taint_confirmed(spark, d)
    part = lambda c: F.split_part(c, F.lit("::"), F.lit(1))
    return filtered(pairs.select("*", part("source_key").alias("object"), part("sink_key").alias("sink_object")), object=object_, sink_object=sink_object)


def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved anew: the own chain, built-in functions and methods, a single other declaration; by form and kind."""
    calls = load(spark, d, "resolved_calls").select("row_id", norm("object").alias("object"), scalar.last_dot_segment(F.trim("to_name")).alias("name"), "call_type", F.lit(None).cast("string").alias("receiver_object"))
    declared = load(spark, d, "procs").select(norm("object").alias("owner"), norm("proc_name").alias("name"), "proc_type")
    functions, methods = programs.builtins(spark, d)
    found = typing.resolve_calls(calls, declared, graphs.ancestor_chain(spark, d), functions, methods)
    return found.groupBy("call_type", F.col("resolved_kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("target_object").alias("n_targets"))


def control_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Each control with the nearest ancestor of its owner that has a control of the same name, cycles passed over."""
    from pyspark.sql import Window as W

    controls = load(spark, d, "type_ancestors").select(F.split_part(norm("child"), F.lit("."), F.lit(1)).alias("owner"), F.split_part(norm("child"), F.lit("."), F.lit(2)).alias("control"), norm("parent").alias("type")).where("control <> ''").distinct()
    chain = graphs.ancestor_chain(spark, d).select(F.col("child").alias("owner"), F.col("parent").alias("base"), "depth").where("owner <> base")
    found = controls.join(chain, "owner").join(controls.select(F.col("owner").alias("base"), "control", F.col("type").alias("base_type")), ["base", "control"])
    nearest = W.partitionBy("owner", "control").orderBy("depth", "base")
    return found.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").select("owner", "control", "base", "depth")


# Effects of calls of these names.
EFFECTS = {
    "retrieve": "db.read", "reselectrow": "db.read", "dbcancel": "db.read", "update": "db.write", "setitem": "buffer.write", "deleterow": "buffer.write", "insertrow": "buffer.write", "rowscopy": "buffer.write", "rowsmove": "buffer.write", "rowsdiscard": "buffer.write",
    "setfilter": "buffer.write", "setsort": "buffer.write", "importfile": "buffer.write", "importstring": "buffer.write", "sharedata": "buffer.write", "modify": "buffer.write", "getitemnumber": "buffer.read", "getitemstring": "buffer.read", "getitemdecimal": "buffer.read", "getitemdate": "buffer.read",
    "getitemdatetime": "buffer.read", "rowcount": "buffer.read", "describe": "buffer.read", "find": "buffer.read", "messagebox": "ui", "open": "ui", "opensheet": "ui", "openwithparm": "ui", "opensheetwithparm": "ui", "opentab": "ui", "openuserobject": "ui", "close": "ui", "closeuserobject": "ui", "closewithreturn": "ui",
    "setfocus": "ui", "setmicrohelp": "ui", "show": "ui", "hide": "ui", "popmenu": "ui", "settransobject": "db.connect", "settrans": "db.connect", "dbhandle": "db.connect", "connectdb": "db.connect", "disconnectdb": "db.connect", "run": "process", "execute": "process", "dynamiccall": "dispatch", "triggerevent": "dispatch",
    "postevent": "dispatch", "fileopen": "file", "fileread": "file", "filewrite": "file", "fileclose": "file", "saveas": "file", "print": "file", "maillogon": "mail", "maillogoff": "mail", "mailsend": "mail",
}


def proc_effects(spark: SparkSession, d: str) -> DataFrame:
    """(object, proc_name, effects) of each procedure: of its own calls and of all that it calls; the seeds are the effects, so the state is one row per procedure and effect."""
    from lodestone.operators import fixpoint, graph

    calls = graphs._calls(spark, d)
    node = lambda o, p: F.concat_ws("::", o, p)
    tag = F.create_map(*[F.lit(x) for kv in EFFECTS.items() for x in kv])[graph.last_segment(F.col("to_name"))]
    direct = calls.select(F.concat(F.lit("effect "), tag).alias("src"), node("object", "proc_name").alias("dst")).where("src is not null")
    edges = graph.call_edges(graphs._procs(spark, d).where("confidence <> 'speculative'"), calls)
    back = edges.select(node("dst.object", "dst.proc").alias("src"), node("src.object", "src.proc").alias("dst"))
    found = fixpoint.reach(direct.union(back), direct.select(F.col("src").alias("seed")), zero_hops=False)
    effects = found.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set(F.substring("seed", 8, 100))), ",").alias("effects"))
    return effects.select(F.split_part("node", F.lit("::"), F.lit(1)).alias("object"), F.split_part("node", F.lit("::"), F.lit(2)).alias("proc_name"), "effects")


def capability_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Per effect, how many procedures have it, of their own or by what they call."""
    each = proc_effects(spark, d).select(F.explode(F.split("effects", ",")).alias("capability"), "object", "proc_name")
    return each.groupBy("capability").agg(F.count_distinct("object", "proc_name").alias("proc_count"))


def capability_procedures(spark: SparkSession, d: str, capability: str) -> DataFrame:
    """(object, proc_name) of the procedures with one effect."""
    return proc_effects(spark, d).where(F.array_contains(F.split("effects", ","), capability)).select("object", "proc_name").distinct()


def skipped_statements(spark: SparkSession, d: str) -> DataFrame:
    """What DDL files' readers left out, per dialect and the kind of statement, the most frequent first: the coverage of their grammar."""
    valid = bad_records.split_valid(load(spark, d, "ddl_stats_raw"))[0]
    each = valid.select("dialect", F.explode(F.split("skipped_previews", "[|]")).alias("preview")).where(F.trim("preview") != "")
    tag, words = F.regexp_extract("preview", r"^\s*\[([^\]]*)\]", 1), F.upper(F.regexp_extract("preview", r"^\s*(?:\[[^\]]*\])?\s*([A-Za-z]+(?:\s+[A-Za-z]+)?)", 1))
    return each.groupBy("dialect", tag.alias("reason"), F.regexp_replace(words, r"\s+", " ").alias("statement")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dialect", "reason", "statement").limit(40)


def footprint_of_reports(spark: SparkSession, d: str) -> DataFrame:
    """How many columns reports retrieve, write, judge by and join, per table."""
    return reports.footprint_arms(spark, d).groupBy("arm", "table_name").agg(F.count_distinct("object").alias("n_reports"), F.count_distinct("column_name").alias("n_columns"))


def report_footprint(spark: SparkSession, d: str) -> DataFrame:
    """How many columns each report retrieves per table, and how many of them the catalog knows."""
    known = load(spark, d, "catalog_columns").select(norm("table_name").alias("table_name"), norm("column_name").alias("column_name")).distinct().withColumn("known", F.lit(1))
    columns = reports.retrieved_columns(spark, d).select("object", "table_name", "column_name").distinct().join(known, ["table_name", "column_name"], "left")
    return columns.groupBy("object", "table_name").agg(F.count("*").alias("n_columns"), F.count("known").alias("n_known"))


def search_all(spark: SparkSession, d: str) -> DataFrame:
    """Everything whose name holds ``ledger``."""
    return search(spark, d, "ledger")


def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per repository, how many called names of the sources are declared somewhere."""
    calls = script_facts(load(spark, d, "source_files")).where("tag = 'call'").select(F.split_part("file", F.lit("/"), F.lit(1)).alias("repository"), "name")
    known = load(spark, d, "procs").select(norm("proc_name").alias("name")).union(load(spark, d, "stdlib_members").select(norm("proc_name"))).distinct().withColumn("known", F.lit(1))
    counts = calls.join(known, "name", "left").groupBy("repository").agg(F.count("*").alias("n"), F.count("known").alias("matched"))
    return counts.withColumn("pct", F.when(F.col("n") == 0, 0.0).otherwise(F.bround(100 * F.col("matched") / F.col("n"), 2)))


_ALL = (uses_counts, procedure_list, library_detail, diagnostics, code_quality, explain_source, call_resolution, control_overrides, proc_effects, capability_catalog, skipped_statements, footprint_of_reports, report_footprint, search_all, token_coverage)
QUERIES = {f.__name__: f for f in _ALL} | {f"diagram_{k}".replace("-", "_"): (lambda s, d, k=k: diagram_edges(s, d, k)) for k in ("inheritance", "calls", "tables", "heatmap", "sql-lineage", "table-lineage", "proc-tables", "fk-graph", "lattice")}
QUERIES |= {"object_page": lambda s, d: object_detail(s, d, "userobject"), "column_impact": lambda s, d: impact_of_column(s, d, "tariff_hist_kideb0")}
_LIB = "list_filter(string_split(file, '/'), lambda x: lower(x) like '%.pbl')[1]"
ORACLE = {
    "uses_counts": """with u as (select lower(trim(target_object)) as object, 'call' how, lower(trim(object)) b from resolved_calls union select lower(trim(ancestor)), 'inherits', lower(trim(object)) from objects union select lower(trim(parent)), 'control', split_part(lower(trim(child)), '.', 1) from type_ancestors
      union select lower(trim(table_name)), case when is_write then 'writes' else 'reads' end, lower(trim(object)) from sql_statement_columns) select object, how, count(*) as n from u where object <> '' group by 1, 2""",
    "procedure_list": "with p as (select distinct lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, proc_type from procs) select p.*, count(distinct lower(trim(c.object)) || '.' || lower(trim(c.proc_name))) as n_callers from p left join resolved_calls c on lower(trim(c.target_object)) = p.object and lower(trim(c.target_proc)) = p.proc_name group by all",
    "library_detail": f"""with o as (select distinct {_LIB} as library, lower(trim(object)) as object from objects), c as (select distinct lower(trim(target_object)) as object, {_LIB} as l from resolved_calls)
      select library, count(*) as n_objects, count(*) filter (not exists (select 1 from c where c.object = o.object and c.l <> o.library)) as n_internal from o group by 1""",
    "code_quality": """select 'complexity' as measure, case when cyclomatic is null then 'unknown' when cyclomatic > 10 then 'high' when cyclomatic > 4 then 'medium' else 'low' end as bucket, count(*) as n from procs group by all
      union all select 'parameters', (case when coalesce(param_names, '') = '' then 0 else len(string_split(param_names, '|')) end)::varchar, count(*) from procs group by all union all select 'calls', kind, count(*) from resolved_calls group by all""",
    "explain_source": """with p as (select distinct file, lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, start_line, end_line from procs where start_line is not null and end_line is not null), f as (select file, string_split(replace(lines, chr(13) || chr(10), chr(10)), chr(10)) l from source_files where lines is not null)
      select object, proc_name, start_line, l[start_line] as first_line, greatest(least(end_line, len(l)) - start_line + 1, 0)::int as n_lines from p join f using (file)""",
    "call_resolution": f"""with recursive {graphs._UPMIN}, c as (select row_id, lower(trim(object)) o, lower(string_split(trim(to_name), '.')[-1]) n, call_type from resolved_calls), d as (select lower(trim(object)) o, lower(trim(proc_name)) n, bool_or(proc_type in ('function', 'subroutine')) callable from procs group by 1, 2),
      u as (select n, min(o) o from d group by 1 having count(*) = 1), b as (select distinct lower(trim(proc_name)) n, lower(trim(object)) = 'function_object' f from stdlib_members), ch as (select distinct o child, o parent, 0 depth from c union all select child, parent, depth from anc where child <> parent),
      h as (select ch.child, d.n, d.o, depth, callable from ch join d on d.o = ch.parent), a as (select child, n, min((depth, o)) x from h group by 1, 2), k as (select child, n, min((depth, o)) x from h where callable group by 1, 2),
      r as (select call_type, case when call_type = 'ExCall' then case when k.x is not null then k.x when c.n in (select n from b where f) then null else a.x end when call_type = 'ExCallArg' then a.x end x,
          case when call_type = 'ExCall' then k.x is null and c.n in (select n from b where f) when call_type = 'ExMethodCall' then c.n in (select n from b where not f) else false end built, case when call_type in ('ExCall', 'ExCallArg') then u.o end uo
        from c left join a on a.child = c.o and a.n = c.n left join k on k.child = c.o and k.n = c.n left join u on u.n = c.n)
      select call_type, case when built then 'builtin' when x[1] > 0 then 'inherited' when x is not null or uo is not null then 'virtual' else 'unresolved' end as kind, count(*) as n, count(distinct case when not built then coalesce(x[2], uo) end) as n_targets from r group by 1, 2""",
    "control_overrides": f"""with recursive {graphs._UPMIN}, c as (select distinct split_part(lower(trim(child)), '.', 1) o, split_part(lower(trim(child)), '.', 2) n from type_ancestors where split_part(trim(child), '.', 2) <> ''),
      x as (select c.o, c.n, b.o base, depth, row_number() over (partition by c.o, c.n order by depth, b.o) k from c join anc on anc.child = c.o and anc.child <> anc.parent join c b on b.o = anc.parent and b.n = c.n) select o as owner, n as control, base, depth::int as depth from x where k = 1""",
    "proc_effects": f"""with recursive {graphs._DEAD.split(", up as")[0]}, {graphs._PROCS}, callref as (select distinct object, proc_name, string_split(to_name, '.')[-1] as callee from calls1), m as (select * from (values {', '.join(f"('{k}', '{v}')" for k, v in EFFECTS.items())}) t(n, e)),
      e as (select r.object so, r.proc_name sp, r.object do_, p.proc_name dp from callref r join (select distinct object, proc_name from procs1) p on p.object = r.object and p.proc_name = r.callee union select object, proc_name, target_object, target_proc from calls1 where target_object is not null and target_proc is not null),
      w as (select object, proc_name, e from callref join m on n = callee union select so, sp, w.e from w join e on e.do_ = w.object and e.dp = w.proc_name) select object, proc_name, string_agg(distinct e, ',' order by e) as effects from w group by 1, 2""",
    "report_footprint": f"""with {reports.SQL} select object, table_name, count(*) as n_columns, count(*) filter (exists (select 1 from catalog_columns k where lower(trim(k.table_name)) = s.table_name and lower(trim(k.column_name)) = s.column_name)) as n_known
      from (select distinct object, table_name, column_name from rc) s group by 1, 2""",
    "search_all": """select distinct * from (select 'object' as kind, lower(trim(object)) as name, file as detail from objects where object ilike '%ledger%' union all select 'procedure', lower(trim(proc_name)), lower(trim(object)) from procs where proc_name ilike '%ledger%'
      union all select 'table', lower(trim(table_name)), lower(trim(namespace)) from catalog_columns where table_name ilike '%ledger%' union all select 'column', lower(trim(column_name)), lower(trim(table_name)) from catalog_columns where column_name ilike '%ledger%')""",
    "diagram_inheritance": f"with {graphs._LINKS} select child as src, parent as dst, 1::bigint as weight from links",
    "diagram_calls": f"with {graphs._PROCS} select object as src, target_object as dst, count(*) as weight from calls1 where object <> target_object group by 1, 2",
    "diagram_tables": f"with {relational._AST} select object as src, table_name as dst, count(*) as weight from ast group by 1, 2",
    "diagram_heatmap": f"with {relational._AST}, o as (select distinct lower(trim(object)) as object, {_LIB} as library from objects) select library as src, table_name as dst, count(*) as weight from ast join o using (object) group by 1, 2",
}
ORACLE |= {
    "capability_catalog": "select capability, count(distinct object || '.' || proc_name) as proc_count from (select unnest(string_split(effects, ',')) as capability, object, proc_name from (" + ORACLE["proc_effects"] + ")) group by 1",
    "diagram_sql_lineage": f"with {relational._AST} select object as src, concat_ws(':', table_name, operation) as dst, count(*) as weight from ast where source = 'powerscript' group by 1, 2",
    "diagram_table_lineage": f"with {relational._AST} select table_name as src, concat_ws(':', source, object, operation) as dst, count(*) as weight from ast group by 1, 2",
    "diagram_proc_tables": f"with {relational._AST} select concat_ws('.', object, proc_name) as src, concat_ws(':', table_name, operation, source) as dst, count(*) as weight from ast group by 1, 2",
    "diagram_fk_graph": f"with {schemas._FK} select x as src, y as dst, count(*) as weight from g group by 1, 2",
    "object_page": f"""with recursive {graphs._UPMIN} select 'object' as section, lower(trim(object)) as name, file as detail from objects where lower(trim(object)) = 'userobject' union select 'ancestor', parent, depth::varchar from anc where child = 'userobject' union select 'procedure', lower(trim(proc_name)), proc_type from procs where lower(trim(object)) = 'userobject'
      union select 'control', lower(trim(child)), lower(trim(parent)) from type_ancestors where lower(trim(child)) like 'userobject.%' union select 'table', lower(trim(table_name)), case when is_write then 'write' else 'read' end from sql_statement_columns where lower(trim(object)) = 'userobject'""",
    "column_impact": f"""with recursive {graphs._UPMIN}, t as (select distinct lower(trim(object)) as object, lower(trim(proc_name)) as proc_name from sql_statement_columns where lower(trim(table_name)) = 'tariff_hist_kideb0')
      select object, proc_name, 'DIRECT' as how from t union select child, null, 'INHERITED' from anc where parent in (select object from t) and depth <= 15""",
}
