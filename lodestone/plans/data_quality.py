"""Queries of problems 1 to 3 and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import bad_records, hierarchy, orphans
from lodestone.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each record that breaks the format, with the reason."""
    return bad_records.split_valid(load(spark, d, "ddl_stats_raw"))[1].select("raw_id", "reason")


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    """Each valid record, typed as DdlStats."""
    return bad_records.split_valid(load(spark, d, "ddl_stats_raw"))[0].drop("raw_line", "arrived_at")


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each batch fail each rule."""
    bad = bad_records.split_valid(load(spark, d, "ddl_stats_raw"))[1]
    return bad.select("batch_file", "reason", F.explode("errors").alias("error")).groupBy("batch_file", "reason", "error").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each row with a reference that doesn't hold at its time."""
    return orphans.orphans(*orphans.code_references(spark, d)).drop("at")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per referring table, month of indexed_at, field and reason."""
    found = orphans.orphans(*orphans.code_references(spark, d))
    return found.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month"), "field", "reason").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each name with root, depth and path."""
    tree = hierarchy.hierarchy(hierarchy.parent_links(spark, d))
    return tree.select("object", "root", "depth", F.array_join("path", "/").alias("path"))


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each name with the number of its descendants and their interval within its root's tree."""
    tree = hierarchy.hierarchy(hierarchy.parent_links(spark, d))
    return tree.select("object", "root", "depth", "n_descendants", "first", "last", "chain")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each name with each of its descendants."""
    return hierarchy.descendant_pairs(hierarchy.hierarchy(hierarchy.parent_links(spark, d)))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of descendants of each name that ends in a root, read from the intervals."""
    tree = hierarchy.hierarchy(hierarchy.parent_links(spark, d))
    return tree.where("depth >= 0").select("object", (F.col("last") - F.col("first")).alias("n_descendants"))


def p3_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """Each name on or below a cycle with its place in the tree of the nearest name on the cycle, and the number of its descendants, its cycle's included."""
    trees, around = hierarchy.below_cycles(hierarchy.parent_links(spark, d))
    sizes = trees.where("depth = 0").select(F.col("object").alias("member"), "n_descendants")
    total = around.join(sizes, "member").groupBy("object").agg((F.sum("n_descendants") + F.count("*")).alias("_n"))
    out = trees.join(total, "object", "left").withColumn("n_descendants", F.coalesce("_n", "n_descendants"))
    return out.select("object", "root", "depth", "path", "n_descendants", "first", "last", "chain")


def p3_cyclic_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each name on or below a cycle with each of its descendants; p3_descendants has those of all others."""
    return hierarchy.cyclic_pairs(hierarchy.parent_links(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_valid, p1_errors, p2_found, p2_report, p3_found, p3_intervals, p3_descendants, p3_counts, p3_cyclic, p3_cyclic_descendants)}

_FIELD = """("([^"]|"")*"|[^",]*)"""
_P1 = f"""
with r as (select *, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') s from ddl_stats_raw),
q as (select *, regexp_full_match(s, '(?s){_FIELD}(,{_FIELD})*') ok from r),
-- outside quotes a comma becomes chr(1): pieces between quotes alternate
p as (select *, case when ok then string_split(array_to_string(list_transform(string_split(s, '"'), lambda x, i: case when i % 2 = 1 then replace(x, ',', chr(1)) else x end), '"'), chr(1)) end raw from q),
f as (select *, list_transform(raw, lambda x: trim(case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end, ' ')) v from p),
j as (select *, case when not ok then 'quoting' when len(v) <> 9 then 'columns'
  when coalesce(regexp_full_match(v[1], '[0-9]+') and try_cast(v[1] as hugeint) <= 2147483647 and v[2] <> '' and v[3] in ('mysql','oracle','postgres','tsql','sqlite')
    and regexp_full_match(v[4], '[0-9]+') and try_cast(v[4] as hugeint) <= 2147483647
    and (v[5] = '' or regexp_full_match(v[5], '[0-9]+') and try_cast(v[5] as hugeint) <= 2147483647)
    and regexp_full_match(v[6], '[0-9]+') and try_cast(v[6] as hugeint) <= 2147483647
    and lower(v[8]) in ('true', 'false') and regexp_full_match(v[9], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') and v[9][12:13] < '24' and v[9][1:4] <> '0000' and try_cast(v[9] as timestamp) is not null, false) then null else 'value' end reason from f)
"""

_P2 = """
with o as (select lower(trim(object)) o, indexed_at b, dropped_at g from objects union all select lower(trim(object)), timestamp '0001-01-01', null from stdlib_members),
p as (select lower(trim(object)) o, lower(trim(proc_name)) p, indexed_at b, dropped_at g from procs union all select lower(trim(object)), lower(trim(proc_name)), timestamp '0001-01-01', null from stdlib_members),
t as (select coalesce('=' || lower(trim(namespace)), '-') ns, lower(trim(table_name)) t, indexed_at b, dropped_at g from catalog_columns),
c as (select row_id, lower(trim(target_object)) o, nullif(lower(trim(target_proc)), '') p, indexed_at seen from resolved_calls where trim(target_object) <> ''),
s as (select row_id, coalesce('=' || lower(trim(namespace)), '-') ns, lower(trim(table_name)) t, indexed_at seen from sql_statement_columns where trim(table_name) <> ''),
c1 as (select *, not exists (select 1 from o where o.o = c.o and b <= seen and (g is null or g > seen)) no_o, p is not null and not exists (select 1 from p where p.o = c.o and p.p = c.p and b <= seen and (g is null or g > seen)) no_p from c),
s1 as (select * from s where not exists (select 1 from t where t.ns = s.ns and t.t = s.t and b <= seen and (g is null or g > seen))),
ko as (select o, min(g) g from o group by 1), kp as (select o, p, min(g) g from p group by 1, 2), kt as (select ns, t, min(g) g from t group by 1, 2),
found as (
select 'resolved_calls' src_table, row_id, 'target_object' field, case when ko.o is null then 'missing' when ko.g <= seen then 'deleted' else 'late' end reason, seen from c1 left join ko on ko.o = c1.o where no_o
union all select 'resolved_calls', row_id, 'target_proc', case when kp.o is null then 'missing' when kp.g <= seen then 'deleted' else 'late' end, seen from c1 left join kp on kp.o = c1.o and kp.p = c1.p where no_p and not no_o
union all select 'sql_statement_columns', row_id, 'table_name', case when kt.t is null then 'missing' when kt.g <= seen then 'deleted' else 'late' end, seen from s1 left join kt on kt.ns = s1.ns and kt.t = s1.t)
"""

_P3 = """
with recursive links as (select lower(trim(object)) c, nullif(lower(trim(ancestor)), '') p from objects union all select lower(trim(child)), nullif(lower(trim(parent)), '') from type_ancestors union all select lower(trim(object)), lower(trim(ancestor)) from stdlib_members),
n as (select name, min(p) p from (select c as name, p from links union all select p, null from links) where name <> '' group by 1),
down as (select name, name root, 0 depth, [name] path from n where p is null union all select n.name, root, depth + 1, list_append(path, n.name) from down join n on n.p = down.name),
-- from an open name, walk up as far as there are open names; one that comes back to itself is on a cycle
opened as (select name, p from n where name not in (select name from down)),
up as (select name, p seen, 1 k from opened union all select up.name, o.p, k + 1 from up join opened o on o.name = up.seen where k < (select count(*) from opened) and up.seen <> up.name),
cyc as (select distinct name from up where seen = name),
tree as (select name as object, root, depth, array_to_string(path, '/') path from down union all select name, case when name in (select name from cyc) then '#cycle' else '#below' end, -1, '' from opened)
"""

ORACLE = {
    "p1_found": _P1 + "select raw_id, reason from j where reason is not null",
    "p1_valid": _P1
    + """select raw_id, batch_file, v[1]::int run_id, v[2] ddl_file, v[3] dialect, v[4]::int statements_total, nullif(v[5], '')::int statements_parsed, v[6]::int statements_skipped,
      v[7] skipped_previews, lower(v[8]) = 'true' dewrapped, v[9]::timestamp finished_at from j where reason is null""",
    "p2_found": _P2 + "select src_table, row_id, field, reason from found",
    "p2_report": _P2 + "select src_table, strftime(seen, '%Y-%m') as month, field, reason, count(*) n from found group by all",
    "p3_found": _P3 + "select object, root, depth, path from tree",
    "p3_descendants": _P3 + "select a.x as object, d.name descendant, (d.depth - a.i + 1)::int distance from down d, lateral (select unnest(path) x, generate_subscripts(path, 1) i) a where a.i <= d.depth",
    "p3_counts": _P3 + "select x as object, count(*) - 1 as n_descendants from (select unnest(path) x from down) group by 1",
}

