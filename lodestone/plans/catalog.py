"""The catalogue of canned queries and the gate for ad-hoc SQL, over relations as temporary views."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalar, sqltext
from lodestone.operators import graph
from lodestone.plans import graphs, relational, reports
from lodestone.session import load, norm
from lodestone.session import reports as are_reports
from lodestone.sources.files import CannedQuery, canned_queries
from lodestone.sources.script import script_facts

FOLDER = Path(__file__).parent / "canned"


@cache
def catalogue() -> dict[str, CannedQuery]:
    """The canned queries by name; a file dropped into the folder is one more."""
    return canned_queries(str(FOLDER))


def bind(query: CannedQuery, given: dict[str, object]) -> dict[str, object]:
    """The parameters of a query: given ones cast, defaults else; a missing or unknown one is an error."""
    unknown = set(given) - {n for n, _, _ in query.params}
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    out: dict[str, object] = {}
    for name, kind, default in query.params:
        value = given.get(name, default)
        if value is None:
            raise ValueError(f"parameter {name} is missing")
        out[name] = int(value) if kind == "INT" else str(value)
    return out


def run_canned(spark: SparkSession, name: str, /, **given: object) -> DataFrame:
    """A canned query over the views of ``register``."""
    query = catalogue()[name]
    return spark.sql(query.sql, args=bind(query, given))


def run_adhoc(spark: SparkSession, sql: str) -> DataFrame:
    """A single SELECT or WITH; anything else is refused before it reaches Spark."""
    if not re.match(r"\s*(?:select|with)\b", sql, re.I) or ";" in sql.strip().rstrip(";"):
        raise ValueError("only a single SELECT or WITH may run")
    return spark.sql(sql.strip().rstrip(";"))


def _statements(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "sql_statement_columns").groupBy("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "line")
    lists = rows.agg(F.array_join(F.array_sort(F.collect_set(norm("table_name"))), ",").alias("tables"), F.array_join(F.array_sort(F.collect_set(norm("column_name"))), ",").alias("columns"), F.coalesce(F.bool_or("is_write"), F.lit(False)).alias("w"))
    read = lists.select("file", "object", "proc_name", "line", F.when(F.col("w"), "UPDATE").otherwise("SELECT").alias("operation"), "tables", "columns", F.lit(None).cast("string").alias("raw_sql"), F.lit(True).alias("parse_ok"), F.lit(None).cast("string").alias("error"))
    # A statement with columns could be read; those that could not stand in the sources.
    sql = script_facts(load(spark, d, "source_files")).where("tag = 'sql'").select("file", "object", "proc_name", "line", F.col("name").alias("operation"), F.col("value").alias("raw_sql"), F.col("value").alias("_sql"))
    failed = sqltext.statement_lineage(sql, "_sql").where("tag = 'error'")
    none = F.lit(None).cast("string")
    return read.unionByName(failed.select("file", "object", "proc_name", "line", "operation", none.alias("tables"), none.alias("columns"), "raw_sql", F.lit(False).alias("parse_ok"), F.col("value").alias("error")))


def _lint(spark: SparkSession, d: str) -> DataFrame:
    facts = script_facts(load(spark, d, "source_files"))
    sql = facts.where("tag = 'sql'").select("file", "object", "proc_name", "line", F.col("value").alias("raw_sql"))
    codes = sql.select("file", "object", "proc_name", "line", "raw_sql", F.explode(scalar.lint_codes(F.col("raw_sql"))).alias("issue_code"))
    loops = facts.where("tag = 'loop_sql'").select("file", "object", "proc_name", "line", F.col("value").alias("raw_sql"), F.lit("sql_in_loop").alias("issue_code"))
    return codes.unionByName(loops).withColumn("severity", F.when(F.col("issue_code") == "select_star", "info").otherwise("warning"))


def _procedures(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "procs").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "proc_type", "start_line", "end_line", "params", "return_type", "cyclomatic", "confidence").distinct()


def _call_sites(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "resolved_calls").select("file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), norm("to_name").alias("to_name"), "call_type", "line")


RELATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "call_sites": _call_sites,
    "procedures": _procedures,
    "ancestor_chain": graphs.ancestor_chain,
    "all_sql_tables": relational.all_sql_tables,
    "sql_statements": _statements,
    "sql_lint_issues": _lint,
    "dw_objects": lambda s, d: are_reports(load(s, d, "objects")).select("file", norm("object").alias("object")).distinct(),
    "dw_retrieve_tables": lambda s, d: reports.retrieved_columns(s, d).select("file", "object", "table_name").distinct(),
    "dw_retrieve_columns": reports.retrieved_columns,
    "call_degrees": lambda s, d: graph.degrees(_call_sites(s, d).select(F.col("object").alias("src"), F.col("to_name").alias("dst")).where("src <> dst")).withColumnRenamed("node", "object"),
    "object_metrics": lambda s, d: graph.object_metrics(_call_sites(s, d).select("object", "to_name"), _procedures(s, d), graphs._links(s, d)),
}


def register(spark: SparkSession, d: str, names: tuple[str, ...] | None = None) -> None:
    """The relations as temporary views; only those named, if names are given."""
    for name in names or tuple(RELATIONS):
        RELATIONS[name](spark, d).createOrReplaceTempView(name)


def needs(name: str) -> tuple[str, ...]:
    """The relations that a canned query reads."""
    return tuple(r for r in RELATIONS if re.search(rf"\b{r}\b", catalogue()[name].sql))


def canned(name: str, /, **given: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d, needs(name))
        return run_canned(spark, name, **given)

    return run


def lineage_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """The tables and columns that the statements of the sources read and write, by the own reader of SQL."""
    sql = script_facts(load(spark, d, "source_files")).where("tag = 'sql'").select("file", "proc_name", "line", F.col("value").alias("raw_sql"))
    found = sqltext.statement_lineage(sql).where("tag in ('column', 'error', 'skipped')")
    return found.groupBy("tag", "table_name", "column_name", "is_write").agg(F.count("*").alias("n"))


def report_controls(spark: SparkSession, d: str) -> DataFrame:
    """Controls of reports by band and kind."""
    return reports.facts(spark, d).where("tag = 'control'").groupBy(F.col("op").alias("band"), F.col("value").alias("kind")).agg(F.count("*").alias("n"))


def report_retrievals(spark: SparkSession, d: str) -> DataFrame:
    """The statement that each report retrieves with, PBSELECT being written as SQL."""
    return reports.facts(spark, d).where("tag = 'retrieve'").select("object", F.col("op").alias("form"), F.col("value").alias("sql"))


_RUNS: dict[str, dict[str, object]] = {
    "callers": {"name": "setitem"}, "coupling": {}, "db_coverage": {}, "dead_dw": {}, "descendants": {"name": "userobject"}, "ancestors": {"name": "datawindow"}, "god_objects": {"min_degree": 0}, "pagerank": {}, "sql_complex": {}, "sql_issues": {},
    "sql_lineage": {"table_name": "tariff_hist_kideb0"}, "sql_parse_failures": {}, "top": {}, "dw": {"name": "d_licence_kideb12"}, "sql_readers": {"table_name": "tariff_hist_kideb0"}, "sql_writers": {"table_name": "tariff_hist_kideb0"},
    "sql_tables": {"object": "w_bonus_calc_kideb168"}, "sql_lineage_column": {"table_name": "tariff_hist_kideb0", "column_name": "amount"},
}
QUERIES = {f"canned_{n}": canned(n, **p) for n, p in _RUNS.items()} | {f.__name__: f for f in (lineage_of_sources, report_controls, report_retrievals)}
_CS = "cs as (select file, lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, lower(trim(to_name)) as to_name, call_type, line from resolved_calls)"
ORACLE = {
    "canned_db_coverage": f"with {reports.SQL} select table_name, count(distinct object) as datawindow_count, string_agg(distinct object, ', ' order by object) as datawindows from rc group by 1",
    "report_controls": rf"with {reports.SQL}, c as (select unnest(regexp_extract_all(lines, '(?m)^\w+\(band=\w+[^\n]* name=')) x from rf) select regexp_extract(x, 'band=(\w+)', 1) as band, regexp_extract(x, '^(\w+)', 1) as kind, count(*) as n from c group by 1, 2",
    "canned_dw": f"with {reports.SQL} select table_name, string_agg(column_name, ', ' order by column_name) as columns from (select distinct object, table_name, column_name from rc) where object = 'd_licence_kideb12' group by 1",
    "canned_sql_readers": f"with {relational._AST} select distinct object, source from ast where table_name = 'tariff_hist_kideb0' and operation in ('SELECT', 'retrieve')",
    "canned_sql_writers": f"with {relational._AST} select distinct object, proc_name, operation, source from ast where table_name = 'tariff_hist_kideb0' and operation = 'UPDATE'",
    "canned_sql_tables": f"with {relational._AST} select table_name, source, operation, proc_name, object, line from ast where object = 'w_bonus_calc_kideb168'",
    "canned_sql_lineage_column": """with s as (select file, lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, line, case when coalesce(bool_or(is_write), false) then 'UPDATE' else 'SELECT' end as operation, list(distinct lower(trim(table_name))) t, list(distinct lower(trim(column_name))) c from sql_statement_columns group by all)
      select 'powerscript' as source, object, proc_name, operation from s where list_contains(t, 'tariff_hist_kideb0') and list_contains(c, 'amount')""",
    "canned_god_objects": f"""with {_CS}, p as (select distinct file, lower(trim(object)) as object, lower(trim(proc_name)) as name, proc_type, start_line, end_line, params, return_type, cyclomatic, confidence from procs), e as (select distinct object s, to_name t from cs where object <> to_name), n as (select s as o from e union select t from e),
      g as (select object, max(cyclomatic) as max_cyclomatic, avg(cyclomatic) as avg_cyclomatic, count(name) as proc_count from p group by 1) select n.o as object, (select count(*) from e where t = n.o) as in_degree, max_cyclomatic, avg_cyclomatic, proc_count from n join g on g.object = n.o where max_cyclomatic >= 3""",
    "canned_sql_lineage": f"with {relational._AST} select object, proc_name, operation, source from ast where table_name = 'tariff_hist_kideb0'",
    "canned_top": "with p as (select distinct file, lower(trim(object)) as object, lower(trim(proc_name)) as name, proc_type, start_line, end_line, params, return_type, cyclomatic, confidence from procs) select object, name, proc_type, cyclomatic from p order by cyclomatic desc nulls last, 1, 2, 3 limit 15",
    "canned_callers": f"with {_CS} select distinct object as caller, proc_name, call_type from cs where to_name = 'setitem'",
    "canned_coupling": f"with {_CS} select object as caller, to_name as callee, count(*) as edge_count from cs where object <> to_name group by 1, 2 having count(*) > 3 order by 3 desc, 1, 2 limit 20",
    "canned_descendants": graphs.ORACLE["descendants_of"],
    "canned_ancestors": graphs.ORACLE["ancestors_of"],
    "canned_dead_dw": f"with {_CS}, {relational._AST} select distinct lower(trim(o.object)) as datawindow, o.file from objects o where {relational.IS_REPORT} and lower(trim(o.object)) not in (select to_name from cs where to_name is not null) and lower(trim(o.object)) not in (select table_name from ast)",
    "canned_sql_complex": """with s as (select file, lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, line, case when coalesce(bool_or(is_write), false) then 'UPDATE' else 'SELECT' end as op from sql_statement_columns group by all)
      select object, proc_name, count(*) as sql_count, count(*) as parsed_count, list_sort(list(distinct op)) as operations from s group by 1, 2 order by 3 desc, 1, 2 limit 10""",
}
