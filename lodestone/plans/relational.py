"""Queries of the relational shapes: filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.plans import reports as report_plans
from lodestone.plans.reports import retrieved_columns
from lodestone.session import load, norm, reports, small


def all_sql_tables(spark: SparkSession, d: str) -> DataFrame:
    """(object, proc_name, table_name, operation, source, line): embedded statements and report retrievals as one relation."""
    rows = load(spark, d, "sql_statement_columns")
    operation = F.when(F.col("is_write"), "UPDATE").otherwise("SELECT")
    sql = rows.select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), norm("table_name").alias("table_name"), operation.alias("operation"), F.lit("powerscript").alias("source"), "line").distinct()
    retrieve = retrieved_columns(spark, d).select("object", "table_name").distinct().select("object", F.lit(None).cast("string").alias("proc_name"), "table_name", F.lit("retrieve").alias("operation"), F.lit("datawindow").alias("source"), F.lit(None).cast("int").alias("line"))
    return sql.unionByName(retrieve)


def project_relation(spark: SparkSession, d: str) -> DataFrame:
    """PF1: procedures renamed to the shape of a relation, all as text."""
    procs = load(spark, d, "procs").where("confidence <> 'speculative'")
    return procs.select(F.col("object"), F.col("proc_name").alias("proc"), "proc_type", F.coalesce(F.col("cyclomatic").cast("string"), F.lit("")).alias("cyclomatic"), F.lower("proc_name").alias("proc_lower"))


def readers(spark: SparkSession, d: str) -> DataFrame:
    """PF2, AG10: who reads each table."""
    return all_sql_tables(spark, d).where(F.col("operation").isin("SELECT", "retrieve")).select("table_name", "object", "source").distinct()


def writers(spark: SparkSession, d: str) -> DataFrame:
    """PF2, AG10: who writes each table."""
    return all_sql_tables(spark, d).where(F.col("operation").isin("INSERT", "UPDATE", "DELETE")).select("table_name", "object", "proc_name", "operation", "source").distinct()


def call_coupling(spark: SparkSession, d: str) -> DataFrame:
    """AG1, AG6, PF3, ST3: the pairs of objects with the most calls, more than three; a top-k report."""
    pairs = load(spark, d, "resolved_calls").select(norm("object").alias("caller"), norm("target_object").alias("callee")).where("caller <> callee and callee <> ''")
    counts = pairs.groupBy("caller", "callee").agg(F.count("*").alias("edge_count")).where("edge_count > 3")
    return counts.orderBy(F.desc("edge_count"), "caller", "callee").limit(20)


def null_filters(spark: SparkSession, d: str) -> DataFrame:
    """PF4: objects with and without an ancestor."""
    objects = load(spark, d, "objects")
    return objects.select(F.when(F.col("ancestor").isNull(), "none").when(F.col("ancestor").isNotNull(), "some").alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("n"))


def stdlib_excluded(spark: SparkSession, d: str) -> DataFrame:
    """PF6: files by LIKE patterns; the underscores match any character, as in the reference."""
    files = load(spark, d, "objects").select("file").distinct()
    return files.where(~F.col("file").like("__stdlib__/%")).groupBy(F.col("file").like("%.pbl/w\\_%").alias("is_window")).agg(F.count("*").alias("n"))


def search_ilike(spark: SparkSession, d: str) -> DataFrame:
    """PF7: case-insensitive search of names."""
    return load(spark, d, "part").where(F.col("p_name").ilike("%WIDGET%") | F.col("p_type").ilike("%small%")).select("p_partkey", "p_name", "p_type")


def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF8: lines that match a pattern in any case, partially."""
    files = load(spark, d, "source_files").where(F.regexp_like("lines", F.lit(r"(?i)update\s+\w+_hdr\s+set")))
    return files.select("file", F.length("lines").cast("long").alias("n_chars"))


def boolean_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF9: rows whose flag is false; NULL drops."""
    return load(spark, d, "sql_statement_columns").where(~F.col("is_write")).groupBy(norm("table_name").alias("table_name")).agg(F.count("*").alias("n"))


def csv_membership(spark: SparkSession, d: str) -> DataFrame:
    """PF10, PF11: procedures whose list of parameter names holds a value."""
    names = F.split("param_names", "[|]")
    return load(spark, d, "procs").where(F.array_contains(names, "al_row")).select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), F.size(names).alias("n_params")).distinct()


def filtered_events(spark: SparkSession, d: str, event_type: str | None = None, minimum: float | None = 50.0) -> DataFrame:
    """PF12, PF13: optional parameters; only those given become conditions."""
    conditions = [c for c in (F.col("event_type") == event_type if event_type is not None else None, F.col("value") >= minimum if minimum is not None else None) if c is not None]
    return load(spark, d, "events").where(reduce(lambda a, b: a & b, conditions, F.lit(True))).groupBy("event_type").agg(F.count("*").alias("n"))


def case_projection(spark: SparkSession, d: str) -> DataFrame:
    """PF14, PF15: a class per order, with literal and NULL columns."""
    grade = F.when(F.col("o_totalprice") >= 300000, "high").when(F.col("o_totalprice") >= 100000, "medium").otherwise("low")
    return load(spark, d, "orders").select("o_orderkey", grade.alias("grade"), F.lit("orders").alias("source"), F.lit(None).cast("int").alias("line"))


def inner_join_keys(spark: SparkSession, d: str) -> DataFrame:
    """JN1: calls joined with their procedures on three keys."""
    calls = load(spark, d, "resolved_calls").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "call_type")
    procs = load(spark, d, "procs").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "proc_type").distinct()
    return calls.join(procs, ["file", "object", "proc_name"]).groupBy("call_type", "proc_type").agg(F.count("*").alias("n"))


def left_join_zero(spark: SparkSession, d: str) -> DataFrame:
    """JN2, AG4: every catalog table with its numbers of columns and writing objects, 0 for none."""
    tables = load(spark, d, "catalog_columns").select(norm("namespace").alias("namespace"), norm("table_name").alias("table_name"), norm("column_name").alias("c")).distinct()
    tables = tables.groupBy("namespace", "table_name").agg(F.count("*").alias("n_columns"))
    touched = load(spark, d, "sql_statement_columns").select(norm("namespace").alias("ns"), norm("table_name").alias("t"), norm("object").alias("object"), "is_write")
    joined = tables.join(touched, F.col("namespace").eqNullSafe(F.col("ns")) & (F.col("table_name") == F.col("t")), "left")
    return joined.groupBy("namespace", "table_name", "n_columns").agg(F.count_distinct("object").alias("n_objects"), F.count_if("is_write").alias("n_writes"))


def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    """PF5, JN7: columns of the catalog that statements touch, NULL namespaces being equal."""
    catalog = load(spark, d, "catalog_columns").select(*[norm(c).alias(c) for c in ("namespace", "table_name", "column_name")]).distinct()
    used = load(spark, d, "sql_statement_columns").select(*[norm(c).alias(f"u_{c}") for c in ("namespace", "table_name", "column_name")]).distinct()
    same = F.col("namespace").eqNullSafe(F.col("u_namespace")) & (F.col("table_name") == F.col("u_table_name")) & (F.col("column_name") == F.col("u_column_name"))
    return catalog.join(used, same, "left").groupBy("namespace").agg(F.count("*").alias("n_columns"), F.count("u_column_name").alias("n_used"))


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """JN3, JN4, JN9: reports that no call names and no statement reads a table of."""
    found = reports(load(spark, d, "objects")).select(norm("object").alias("object"), "file").distinct()
    called = load(spark, d, "resolved_calls").select(norm("target_object").alias("object"))
    tables = all_sql_tables(spark, d).select(F.col("table_name").alias("object"))
    return found.join(called, "object", "left_anti").join(tables, "object", "left_anti").select(F.col("object").alias("datawindow"), "file")


def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """JN5, JN6: the procedures that write some table, by kind."""
    writing = load(spark, d, "sql_statement_columns").where("is_write").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"))
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), "proc_type").distinct()
    return procs.join(writing, ["object", "proc_name"], "left_semi").groupBy("proc_type").agg(F.count("*").alias("n"))


def either_end(spark: SparkSession, d: str) -> DataFrame:
    """JN8: inheritance edges at either end of each object; the OR is two equi joins, self-edges once."""
    edges = load(spark, d, "type_ancestors").select(norm("child").alias("a"), norm("parent").alias("b")).distinct()
    names = load(spark, d, "objects").select(norm("object").alias("object")).distinct()
    first = names.join(edges, F.col("object") == F.col("a")).select("object", F.col("b").alias("other"))
    second = names.join(edges.where("a <> b"), F.col("object") == F.col("b")).select("object", F.col("a").alias("other"))
    return first.union(second).groupBy("object").agg(F.count("*").alias("n_edges"))


def self_join_decode(spark: SparkSession, d: str) -> DataFrame:
    """JN10: trade between regions, nations decoded twice."""
    nation = load(spark, d, "nation")
    customer = load(spark, d, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")), "c_nationkey")
    supplier = load(spark, d, "supplier").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation")), "s_nationkey")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = lines.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"))


def first_overload(spark: SparkSession, d: str) -> DataFrame:
    """JN11: each call with the type of the first overload it resolves to."""
    first = W.partitionBy("o", "p").orderBy(F.col("start_line").asc_nulls_last(), "proc_type", F.col("file"))
    procs = load(spark, d, "procs").withColumn("o", norm("object")).withColumn("p", norm("proc_name")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("o", "p", F.col("proc_type").alias("target_type"))
    calls = load(spark, d, "resolved_calls").select(norm("target_object").alias("o"), norm("target_proc").alias("p"))
    return calls.join(procs, ["o", "p"], "left").groupBy("target_type").agg(F.count("*").alias("n"))


def name_match_calls(spark: SparkSession, d: str) -> DataFrame:
    """JN12: same-object calls by name, in any case."""
    calls = load(spark, d, "resolved_calls").select(norm("object").alias("object"), norm("proc_name").alias("caller"), F.lower(F.element_at(F.split(F.trim("to_name"), "[.]"), -1)).alias("callee")).distinct()
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("callee")).distinct()
    return calls.join(procs, ["object", "callee"]).select("object", "caller", "callee")


def argument_positions(spark: SparkSession, d: str) -> DataFrame:
    """JN14: parameters by position, zipped with their types; surplus ones have none."""
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), "params", "param_names").where("param_names <> ''").distinct()
    zipped = F.arrays_zip(F.split("param_names", "[|]").alias("name"), F.split("params", ", ").alias("declared"))
    each = procs.select("object", "proc_name", F.posexplode(zipped).alias("position", "x"))
    return each.groupBy("position", F.col("x.name").alias("name"), F.split_part("x.declared", F.lit(" "), F.lit(1)).alias("type")).agg(F.count("*").alias("n"))


def last_def_before(spark: SparkSession, d: str) -> DataFrame:
    """JN15: per event, the latest earlier event of the same user and type; an as-of join by a running maximum, not by a range join."""
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    before = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return events.select("event_id", F.last("event_id").over(before).alias("previous_id"))


def pairs_within(spark: SparkSession, d: str) -> DataFrame:
    """JN16: pairs of parts within an order, by ordinal; orders are small and repeated lines count once."""
    parts = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts")).where(F.size("parts") > 1)
    first = parts.select("parts", F.posexplode("parts").alias("at", "part_a"))
    pairs = first.select("part_a", F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("part_b"))
    return pairs.groupBy("part_a", "part_b").agg(F.count("*").alias("n")).where("n >= 2")


def json_controls(spark: SparkSession, d: str) -> DataFrame:
    """JN18: the geometry in layout documents of objects, parsed and joined with their kinds."""
    layout = F.from_json("layout_json", "x int, y int, width int, height int")
    objects = load(spark, d, "objects").where("layout_json is not null").select(norm("object").alias("object"), layout.alias("l")).distinct()
    kinds = load(spark, d, "objects").select(norm("object").alias("object"), "category").distinct()
    return objects.join(kinds, "object").groupBy("category").agg(F.count("*").alias("n"), F.max("l.width").alias("max_width"), F.min("l.height").alias("min_height"))


def db_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AG2, AG7: per table, how many and which objects touch it, as an ordered list."""
    rows = load(spark, d, "sql_statement_columns").select(norm("table_name").alias("table_name"), norm("object").alias("object"))
    return rows.groupBy("table_name").agg(F.count_distinct("object").alias("object_count"), F.array_join(F.array_sort(F.collect_set("object")), ", ").alias("objects"))


def stmt_complexity(spark: SparkSession, d: str) -> DataFrame:
    """AG3, AG8: per order, lines, returned lines and the distinct flags."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey")
    return lines.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


def simple_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """AG5: sums, averages and extremes of line items by flag and status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return lines.agg(F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.max("l_quantity").alias("max_qty"), F.min("l_discount").alias("min_disc"), F.count("*").alias("n"))


def lists_without_null(spark: SparkSession, d: str) -> DataFrame:
    """AG9: per object, the number of its procedures that return something, an empty list for none."""
    procs = load(spark, d, "procs").groupBy(norm("object").alias("object"))
    return procs.agg(F.size(F.collect_list("return_type")).cast("long").alias("n_returning"), F.count("*").alias("n"))


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """AG11, AN32: counts of all relations in one row."""
    parts = [load(spark, d, t).agg(F.count("*").alias(f"n_{t}")) for t in ("objects", "procs", "resolved_calls", "sql_statement_columns", "catalog_columns", "source_files")]
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)  # one row each


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG13: how many documents have so many words."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long")
    return load(spark, d, "documents").groupBy(words.alias("n_words")).agg(F.count("*").alias("n"))


def least_priority_leg(spark: SparkSession, d: str) -> DataFrame:
    """AG14: per order, the first line by priority of its flag, with a total order."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    row = F.struct(rank.alias("rank"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(row).alias("x")).select("l_orderkey", "x.rank", "x.l_linenumber", "x.l_partkey")


def exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """AG15: orders that exactly one supplier delivers, with that supplier."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("l_suppkey"))
    return lines.where("n = 1").select("l_orderkey", "l_suppkey")


def clone_families(spark: SparkSession, d: str) -> DataFrame:
    """AG16: procedures of equal shape, families of two and more."""
    shapes = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), F.coalesce("params", F.lit("")).alias("params"), F.coalesce("return_type", F.lit("")).alias("return_type"), "cyclomatic").distinct()
    return shapes.groupBy("params", "return_type", "cyclomatic").agg(F.count("*").alias("n")).where("n > 1")


def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    """AG18, AN18: the percentage of calls resolved to a target per repository, half-even."""
    calls = load(spark, d, "resolved_calls").groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("repository"))
    counts = calls.agg(F.count("*").alias("n"), F.count_if(F.trim("target_object") != "").alias("matched"))
    return counts.select("repository", "n", "matched", F.when(F.col("n") == 0, 0.0).otherwise(F.bround(100 * F.col("matched") / F.col("n"), 2)).alias("pct"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """AG19: per user, gaps of more than a day between the running ends of their events."""
    events = load(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("began"))
    ended = F.col("began") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30), F.lit(0))
    run = W.partitionBy("user_id").orderBy("began", "event_id").rowsBetween(W.unboundedPreceding, -1)
    spans = events.withColumn("covered", F.max(ended).over(run))
    return spans.where(F.col("began") > F.col("covered") + F.expr("interval 1 day")).select("user_id", "event_id", F.col("covered").alias("gap_from"), F.col("began").alias("gap_to"))


def best_overload(spark: SparkSession, d: str) -> DataFrame:
    """WN1: the most complex overload of each procedure, unknown complexity last."""
    best = W.partitionBy("object", "proc_name").orderBy(F.col("cyclomatic").desc_nulls_last())
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), F.expr("try_cast(cyclomatic as int)").alias("cyclomatic"))
    return procs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def ranked_legs(spark: SparkSession, d: str) -> DataFrame:
    """WN2, WN3: per customer and order month, the first order by price and key, with the largest month of the customer."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.month("o_orderdate").alias("m"))
    first = W.partitionBy("o_custkey", "m").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = orders.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return ranked.select("o_custkey", "m", "o_orderkey", F.max("m").over(W.partitionBy("o_custkey")).alias("max_m"))


def top_procs(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST3, ST8: the most complex procedures, NULL last; a top-k report."""
    procs = load(spark, d, "procs").select(norm("object").alias("object"), norm("proc_name").alias("name"), "cyclomatic").distinct()
    return procs.orderBy(F.col("cyclomatic").desc_nulls_last(), "object", "name").limit(15)


def page(spark: SparkSession, d: str) -> DataFrame:
    """ST4, ST5: one page of a listing with its total; a paging operator."""
    parts = load(spark, d, "part").select("p_partkey", "p_name")
    total = parts.agg(F.count("*").alias("total"))
    return parts.orderBy("p_name", "p_partkey").offset(20).limit(10).join(F.broadcast(total), F.lit(True))


def god_objects(spark: SparkSession, d: str) -> DataFrame:
    """AG6, ST2: objects with many callers and complex procedures, by the product."""
    calls = load(spark, d, "resolved_calls").select(norm("object").alias("caller"), norm("target_object").alias("object")).where("object <> '' and caller <> object").distinct()
    fan_in = calls.groupBy("object").agg(F.count("*").alias("in_degree"))
    procs = load(spark, d, "procs").groupBy(norm("object").alias("object")).agg(F.max("cyclomatic").alias("max_cyclomatic"), F.count("*").alias("proc_count"))
    return fan_in.join(procs, "object").where("in_degree >= 5 and max_cyclomatic >= 3").orderBy((F.col("in_degree") * F.col("max_cyclomatic")).desc(), "object")


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """ST7: a stable id per table, in place of a row id: the hash of its key."""
    tables = load(spark, d, "catalog_columns").select(norm("namespace").alias("namespace"), norm("table_name").alias("table_name")).distinct()
    return tables.withColumn("id", F.md5(F.concat_ws("|", F.coalesce("namespace", F.lit("-")), "table_name")))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """SO1 to SO4: columns that statements write, read, both, and neither, per table."""
    c = ["namespace", "table_name", "column_name"]
    rows = load(spark, d, "sql_statement_columns").select(*[norm(x).alias(x) for x in c], "is_write")
    catalog = load(spark, d, "catalog_columns").select(*[norm(x).alias(x) for x in c]).distinct()
    written, read = rows.where("is_write").select(*c).distinct(), rows.where("not is_write").select(*c).distinct()
    sets = [("both", written.intersect(read)), ("written only", written.subtract(read)), ("read only", read.subtract(written)), ("neither", catalog.subtract(written.union(read)))]
    return reduce(DataFrame.union, [s.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("set"), "n") for n, s in sets])


def symmetric_edges(spark: SparkSession, d: str) -> DataFrame:
    """SO5: the symmetric closure of the inheritance edges."""
    edges = load(spark, d, "type_ancestors").select(norm("child").alias("a"), norm("parent").alias("b"))
    return edges.union(edges.select("b", "a")).distinct()


def subset_flags(spark: SparkSession, d: str) -> DataFrame:
    """SO6: nations whose customers' segments are a subset of those of nation 0."""
    sets = load(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    first = sets.where("c_nationkey = 0").select(F.col("segments").alias("base"))
    return sets.join(F.broadcast(first), F.lit(True)).select("c_nationkey", (F.size(F.array_except("segments", "base")) == 0).alias("is_subset"))


def scalar_strings(spark: SparkSession, d: str) -> DataFrame:
    """The interpreter's string builtins over names of parts."""
    n = F.col("p_name")
    return load(spark, d, "part").select(
        "p_partkey", scalar.mid(n, F.lit(3), F.lit(4)).alias("mid"), scalar.left(n, F.lit(5)).alias("left5"), scalar.right(n, F.lit(3)).alias("right3"), scalar.right(n, F.lit(0)).alias("right0"), scalar.pos(n, F.lit("e")).alias("pos_e"),
        scalar.fill(F.lit(3), F.lit("x")).alias("fill3"), scalar.replace(n, F.lit("a"), F.lit("*")).alias("replaced"), F.reverse(n).alias("reversed"), F.upper(n).alias("up"), scalar.length(n).alias("n"),
    )


def scalar_math(spark: SparkSession, d: str) -> DataFrame:
    """The interpreter's numeric builtins over line items."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.round_half_up(p, F.lit(1)).alias("round1"), F.ceil(p).cast("long").alias("ceiling"), F.floor(p).cast("long").alias("floor"), scalar.modulo(q, F.lit(7.0)).alias("mod7"),
        scalar.greatest(q, F.lit(None).cast("double")).alias("max0"), scalar.least(q, F.lit(30.0)).alias("min30"), scalar.rgb(F.lit(1), F.lit(2), F.col("l_linenumber")).alias("rgb"), scalar.integer(F.col("l_returnflag")).alias("int0"),
    )


def sql_operations(spark: SparkSession, d: str) -> DataFrame:
    """The operation words that lines of the source begin with."""
    lines = load(spark, d, "source_files").select("file", F.explode(F.split("lines", "\r?\n")).alias("line"))
    return lines.select(scalar.sql_operation(F.col("line")).alias("operation")).where("operation is not null").groupBy("operation").agg(F.count("*").alias("n"))


def host_variables(spark: SparkSession, d: str) -> DataFrame:
    """The host variables of each source file's embedded SQL."""
    files = load(spark, d, "source_files").select("file", F.explode(scalar.host_variables(F.col("lines"))).alias("variable"))
    return files.groupBy("variable").agg(F.count_distinct("file").alias("n_files"))


def control_types(spark: SparkSession, d: str) -> DataFrame:
    """The control types that names of controls suggest by their prefix."""
    controls = load(spark, d, "type_ancestors").select(F.lower(F.split_part(F.trim("child"), F.lit("."), F.lit(2))).alias("name"))
    return controls.groupBy(scalar.control_type(F.col("name")).alias("control_type")).agg(F.count("*").alias("n"))


def libraries(spark: SparkSession, d: str) -> DataFrame:
    """Objects and kinds per library of the path."""
    objects = load(spark, d, "objects").select(scalar.library(F.col("file")).alias("library"), norm("object").alias("object"), "kind", "file")
    return objects.groupBy("library").agg(F.count_distinct("object").alias("n_objects"), F.count_if(scalar.language(F.col("kind"), F.col("file")) == "datawindow").alias("n_reports"))


def lint(spark: SparkSession, d: str) -> DataFrame:
    """Lint over the statements of the source by operation: how many there are, SELECT *, writes without WHERE."""
    text = F.regexp_replace("lines", r"(?s)/\*.*?\*/|//[^\n]*", "")
    statements = load(spark, d, "source_files").select(F.explode(F.regexp_extract_all(text, F.lit(r"(?is)(?:^|\n)\s*((?:select|update|delete)\b[^;]*;)"), F.lit(1))).alias("raw_sql"))
    codes = scalar.lint_codes(F.col("raw_sql"))
    has = lambda c: F.count_if(F.array_contains(codes, c))
    return statements.groupBy(scalar.sql_operation(F.col("raw_sql")).alias("operation")).agg(F.count("*").alias("n"), has("select_star").alias("n_star"), has("write_no_where").alias("n_no_where"))


def type_families(spark: SparkSession, d: str) -> DataFrame:
    """The families of the declared types of return values."""
    procs = load(spark, d, "procs").select(scalar.type_family(F.col("return_type")).alias("family"))
    return procs.groupBy("family").agg(F.count("*").alias("n"))


def broadcast_checked(spark: SparkSession, d: str) -> DataFrame:
    """Revenue per region: dimensions are broadcast only below a checked size."""
    nation = small(load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


_ALL = (
    all_sql_tables, project_relation, readers, writers, call_coupling, null_filters, stdlib_excluded, search_ilike, regex_filter, boolean_filter, csv_membership, filtered_events, case_projection, inner_join_keys, left_join_zero,
    null_safe_join, anti_join, semi_join, either_end, self_join_decode, first_overload, name_match_calls, argument_positions, last_def_before, pairs_within, json_controls, db_coverage, stmt_complexity, simple_aggregates,
    lists_without_null, dashboard, length_histogram, least_priority_leg, exactly_one, clone_families, coverage_pct, gaps, best_overload, ranked_legs, top_procs, page, god_objects, stable_ids, set_operations, symmetric_edges,
    subset_flags, scalar_strings, scalar_math, sql_operations, host_variables, control_types, libraries, lint, type_families, broadcast_checked,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Whether a row o of objects is a report.
IS_REPORT = r"coalesce(nullif(lower(trim(kind)), ''), case lower(regexp_extract(file, '\.(\w+)\s*$', 1)) when 'srd' then 'datawindow' else '' end) = 'datawindow'"
_AST = """ast as (select distinct lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, lower(trim(table_name)) as table_name, case when is_write then 'UPDATE' else 'SELECT' end as operation, 'powerscript' as source, line from sql_statement_columns
  union all select distinct object, null, table_name, 'retrieve', 'datawindow', null::int from rc)"""
_AST = report_plans.SQL.strip() + ",\n" + _AST
ORACLE = {
    "all_sql_tables": f"with {_AST} select * from ast",
    "project_relation": "select object, proc_name as proc, proc_type, coalesce(cyclomatic::varchar, '') as cyclomatic, lower(proc_name) as proc_lower from procs where confidence <> 'speculative'",
    "readers": f"with {_AST} select distinct table_name, object, source from ast where operation in ('SELECT', 'retrieve')",
    "writers": f"with {_AST} select distinct table_name, object, proc_name, operation, source from ast where operation in ('INSERT', 'UPDATE', 'DELETE')",
    "call_coupling": "select lower(trim(object)) as caller, lower(trim(target_object)) as callee, count(*) as edge_count from resolved_calls where lower(trim(object)) <> lower(trim(target_object)) and trim(target_object) <> '' group by 1, 2 having count(*) > 3 order by 3 desc, 1, 2 limit 20",
    "null_filters": "select case when ancestor is null then 'none' else 'some' end as ancestor, count(*) as n from objects group by 1",
    "stdlib_excluded": r"select file like '%.pbl/w\_%' escape '\' as is_window, count(*) as n from (select distinct file from objects) where file not like '__stdlib__/%' group by 1",
    "search_ilike": "select p_partkey, p_name, p_type from part where p_name ilike '%WIDGET%' or p_type ilike '%small%'",
    "regex_filter": r"select file, length(lines) as n_chars from source_files where regexp_matches(lines, 'update\s+\w+_hdr\s+set', 'i')",
    "boolean_filter": "select lower(trim(table_name)) as table_name, count(*) as n from sql_statement_columns where not is_write group by 1",
    "csv_membership": "select distinct lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, len(string_split(param_names, '|'))::int as n_params from procs where list_contains(string_split(param_names, '|'), 'al_row')",
    "filtered_events": "select event_type, count(*) as n from events where value >= 50 group by 1",
    "case_projection": "select o_orderkey, case when o_totalprice >= 300000 then 'high' when o_totalprice >= 100000 then 'medium' else 'low' end as grade, 'orders' as source, null::int as line from orders",
    "inner_join_keys": "with p as (select distinct file, lower(trim(object)) o, lower(trim(proc_name)) p, proc_type from procs) select call_type, proc_type, count(*) as n from resolved_calls c join p on c.file = p.file and lower(trim(c.object)) = o and lower(trim(c.proc_name)) = p group by 1, 2",
    "left_join_zero": """with t as (select namespace, table_name, count(*) n_columns from (select distinct lower(trim(namespace)) as namespace, lower(trim(table_name)) as table_name, lower(trim(column_name)) c from catalog_columns) group by 1, 2)
      select t.namespace, t.table_name, n_columns, count(distinct lower(trim(s.object))) as n_objects, count(*) filter (s.is_write) as n_writes from t left join sql_statement_columns s on lower(trim(s.namespace)) is not distinct from t.namespace and lower(trim(s.table_name)) = t.table_name group by 1, 2, 3""",
    "null_safe_join": """with c as (select distinct lower(trim(namespace)) n, lower(trim(table_name)) t, lower(trim(column_name)) c from catalog_columns), u as (select distinct lower(trim(namespace)) n, lower(trim(table_name)) t, lower(trim(column_name)) c from sql_statement_columns)
      select c.n as namespace, count(*) as n_columns, count(u.c) as n_used from c left join u on c.n is not distinct from u.n and c.t = u.t and c.c = u.c group by 1""",
    "anti_join": f"with {_AST} select distinct lower(trim(o.object)) as datawindow, o.file from objects o where {IS_REPORT} and not exists (select 1 from resolved_calls c where lower(trim(c.target_object)) = lower(trim(o.object))) and not exists (select 1 from ast a where a.table_name = lower(trim(o.object)))",
    "semi_join": "with p as (select distinct lower(trim(object)) o, lower(trim(proc_name)) p, proc_type from procs) select proc_type, count(*) as n from p where exists (select 1 from sql_statement_columns s where is_write and lower(trim(s.object)) = o and lower(trim(s.proc_name)) = p) group by 1",
    "either_end": "with e as (select distinct lower(trim(child)) a, lower(trim(parent)) b from type_ancestors), n as (select distinct lower(trim(object)) o from objects) select o as object, count(*) as n_edges from n join e on o = a or o = b group by 1",
    "self_join_decode": "select a.n_name as customer_nation, b.n_name as supplier_nation, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey group by 1, 2",
    "first_overload": "with p as (select lower(trim(object)) o, lower(trim(proc_name)) p, proc_type t, row_number() over (partition by lower(trim(object)), lower(trim(proc_name)) order by start_line nulls last, proc_type, file) k from procs) select t as target_type, count(*) as n from resolved_calls left join p on k = 1 and o = lower(trim(target_object)) and p = lower(trim(target_proc)) group by 1",
    "name_match_calls": "with p as (select distinct lower(trim(object)) o, lower(trim(proc_name)) p from procs) select distinct lower(trim(object)) as object, lower(trim(proc_name)) as caller, p as callee from resolved_calls join p on o = lower(trim(object)) and p = lower(string_split(trim(to_name), '.')[-1])",
    "argument_positions": """with d as (select distinct lower(trim(object)) o, lower(trim(proc_name)) p, params, param_names from procs where param_names <> ''), z as (select unnest(list_zip(string_split(param_names, '|'), string_split(params, ', '))) x, unnest(range(greatest(len(string_split(param_names, '|')), len(string_split(params, ', '))))) i from d)
      select i::int as position, x[1] as name, split_part(x[2], ' ', 1) as type, count(*) as n from z group by 1, 2, 3""",
    "last_def_before": "select event_id, last_value(event_id) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as previous_id from events",
    "pairs_within": "with l as (select distinct l_orderkey o, l_partkey p from lineitem) select a.p as part_a, b.p as part_b, count(*) as n from l a join l b on a.o = b.o and a.p < b.p group by 1, 2 having count(*) >= 2",
    "json_controls": """with o as (select distinct lower(trim(object)) o, json_extract(layout_json, '$.x')::int x, json_extract(layout_json, '$.y')::int y, json_extract(layout_json, '$.width')::int w, json_extract(layout_json, '$.height')::int h from objects where layout_json is not null), k as (select distinct lower(trim(object)) o, category from objects)
      select category, count(*) as n, max(w) as max_width, min(h) as min_height from o join k using (o) group by 1""",
    "db_coverage": "select lower(trim(table_name)) as table_name, count(distinct lower(trim(object))) as object_count, string_agg(distinct lower(trim(object)), ', ' order by lower(trim(object))) as objects from sql_statement_columns group by 1",
    "stmt_complexity": "select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as returned, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by 1",
    "simple_aggregates": "select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 4) as avg_qty, max(l_quantity) as max_qty, min(l_discount) as min_disc, count(*) as n from lineitem group by 1, 2",
    "lists_without_null": "select lower(trim(object)) as object, count(return_type) as n_returning, count(*) as n from procs group by 1",
    "dashboard": "select " + ", ".join(f"(select count(*) from {t}) as n_{t}" for t in ("objects", "procs", "resolved_calls", "sql_statement_columns", "catalog_columns", "source_files")),
    "length_histogram": "select len(string_split(coalesce(text, ''), ' ')) as n_words, count(*) as n from documents group by 1",
    "least_priority_leg": "select l_orderkey, rank, l_linenumber, l_partkey from (select *, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end rank, row_number() over (partition by l_orderkey order by rank, l_linenumber, l_partkey, l_suppkey, l_quantity) k from lineitem) where k = 1",
    "exactly_one": "select l_orderkey, min(l_suppkey) as l_suppkey from lineitem group by 1 having count(distinct l_suppkey) = 1",
    "clone_families": "with s as (select distinct lower(trim(object)) o, lower(trim(proc_name)) p, coalesce(params, '') as params, coalesce(return_type, '') as return_type, cyclomatic from procs) select params, return_type, cyclomatic, count(*) as n from s group by 1, 2, 3 having count(*) > 1",
    "coverage_pct": "select split_part(file, '/', 1) as repository, count(*) as n, count(*) filter (trim(target_object) <> '') as matched, round_even(100 * (count(*) filter (trim(target_object) <> '')) / count(*), 2) as pct from resolved_calls group by 1",
    "gaps": "select user_id, event_id, covered as gap_from, ts as gap_to from (select user_id, event_id, ts, max(ts + interval 30 minute) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) covered from events) where ts > covered + interval 1 day",
    "best_overload": "select lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, max(cyclomatic) as cyclomatic from procs group by 1, 2",
    "ranked_legs": "select o_custkey, m::int as m, o_orderkey, (max(m) over (partition by o_custkey))::int as max_m from (select o_custkey, o_orderkey, month(o_orderdate) m, row_number() over (partition by o_custkey, month(o_orderdate) order by o_totalprice desc, o_orderkey) k from orders) where k = 1",
    "top_procs": "select distinct lower(trim(object)) as object, lower(trim(proc_name)) as name, cyclomatic from procs order by cyclomatic desc nulls last, 1, 2 limit 15",
    "page": "select p_partkey, p_name, (select count(*) from part) as total from part order by p_name, p_partkey limit 10 offset 20",
    "god_objects": """with c as (select distinct lower(trim(object)) a, lower(trim(target_object)) b from resolved_calls where trim(target_object) <> ''), f as (select b as object, count(*) as in_degree from c where a <> b group by 1), p as (select lower(trim(object)) as object, max(cyclomatic) as max_cyclomatic, count(*) as proc_count from procs group by 1)
      select f.object, in_degree, max_cyclomatic, proc_count from f join p using (object) where in_degree >= 5 and max_cyclomatic >= 3""",
    "stable_ids": "select distinct lower(trim(namespace)) as namespace, lower(trim(table_name)) as table_name, md5(concat_ws('|', coalesce(lower(trim(namespace)), '-'), lower(trim(table_name)))) as id from catalog_columns",
    "set_operations": """with r as (select lower(trim(namespace)) n, lower(trim(table_name)) t, lower(trim(column_name)) c, is_write from sql_statement_columns), w as (select distinct n, t, c from r where is_write), d as (select distinct n, t, c from r where not is_write), k as (select distinct lower(trim(namespace)), lower(trim(table_name)), lower(trim(column_name)) from catalog_columns)
      select 'both' as set, count(*) as n from (select * from w intersect select * from d) union all select 'written only', count(*) from (select * from w except select * from d) union all select 'read only', count(*) from (select * from d except select * from w) union all select 'neither', count(*) from (select * from k except (select * from w union select * from d))""",
    "symmetric_edges": "with e as (select lower(trim(child)) a, lower(trim(parent)) b from type_ancestors) select a, b from e union select b, a from e",
    "subset_flags": "with s as (select distinct c_nationkey k, c_mktsegment s from customer), b as (select s from s where k = 0) select k as c_nationkey, bool_and(s in (select s from b)) as is_subset from s group by 1",
    "scalar_strings": "select p_partkey, substring(p_name, 3, 4) as mid, left(p_name, 5) as left5, right(p_name, 3) as right3, p_name as right0, strpos(p_name, 'e')::int as pos_e, 'xxx' as fill3, replace(p_name, 'a', '*') as replaced, reverse(p_name) as reversed, upper(p_name) as up, length(p_name)::int as n from part",
    "scalar_math": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 10 + 0.5) / 10 as round1, ceil(l_extendedprice)::bigint as ceiling, floor(l_extendedprice)::bigint as floor, l_quantity % 7 as mod7, greatest(l_quantity, 0) as max0, least(l_quantity, 30.0) as min30, ((1 << 16) | (2 << 8) | l_linenumber)::int as rgb, 0::bigint as int0 from lineitem",
    "sql_operations": r"with l as (select unnest(regexp_split_to_array(lines, '\r?\n')) line from source_files), w as (select upper(regexp_extract(trim(line), '^(\S+?);*(\s|$)', 1)) o from l) select o as operation, count(*) as n from w where o in ('SELECT','INSERT','UPDATE','DELETE','EXECUTE','DECLARE','OPEN','FETCH','CLOSE','COMMIT','ROLLBACK','CONNECT','DISCONNECT') group by 1",
    "host_variables": r"with v as (select distinct file, unnest(regexp_extract_all(lines, ':([\p{L}_0-9]+)', 1)) v from source_files) select v as variable, count(*) as n_files from v group by 1",
    "libraries": f"select list_filter(string_split(file, '/'), lambda x: lower(x) like '%.pbl')[1] as library, count(distinct lower(trim(object))) as n_objects, count(*) filter ({IS_REPORT}) as n_reports from objects group by 1",
    "lint": r"""with t as (select regexp_replace(lines, '(?s)/\*.*?\*/|//[^\n]*', '', 'g') x from source_files), s as (select unnest(regexp_extract_all(x, '(?is)(?:^|\n)\s*((?:select|update|delete)\b[^;]*;)', 1)) q from t)
      select upper(regexp_extract(q, '^(\w+)', 1)) as operation, count(*) as n, count(*) filter (regexp_matches(upper(q), '^\s*SELECT\s+\*')) as n_star, count(*) filter (regexp_matches(upper(q), '^\s*(UPDATE|DELETE)\b') and not contains(upper(q), 'WHERE')) as n_no_where from s group by 1""",
    "control_types": "with n as (select lower(split_part(trim(child), '.', 2)) n from type_ancestors) select case " + " ".join(f"when starts_with(n, '{p}') then '{k}'" for p, k in scalar.CONTROL_PREFIXES) + " end as control_type, count(*) as n from n group by 1",
    "type_families": "with t as (select return_type r, regexp_replace(lower(trim(return_type)), '\\s*\\{.*\\}$', '') n from procs) select case when r is null then null " + " ".join(f"when n in ({', '.join(repr(x) for x in names)}) then '{f}'" for f, names in scalar.FAMILIES.items()) + " else 'user_type:' || n end as family, count(*) as n from t group by 1",
    "broadcast_checked": "select r_name, round(sum(o_totalprice), 2) as total, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
}
