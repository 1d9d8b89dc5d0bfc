"""Queries of the schema analytics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import fixpoint, graph, lattice, schema
from lodestone.plans import graphs, reports
from lodestone.session import cut, load, norm


def _rows(spark: SparkSession, d: str) -> DataFrame:
    names = ["namespace", "table_name", "column_name"]
    rows = load(spark, d, "sql_statement_columns").select(norm("object").alias("object"), norm("proc_name").alias("proc_name"), "file", "line", *[norm(c).alias(c) for c in names], "is_write").where("is_write is not null")
    stmt = F.concat_ws(":", "file", "object", "proc_name", F.col("line").cast("string"))
    return rows.withColumn("stmt", stmt).withColumn("scope", F.concat_ws(".", "namespace", "table_name")).withColumn("col", F.concat_ws(".", "namespace", "table_name", "column_name"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "catalog_columns").select(*[norm(c).alias(c) for c in ("namespace", "table_name", "column_name")], "ordinal").distinct()


def co_update(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of columns that at least two statements write together, over all tables."""
    return schema.rituals(_rows(spark, d).where("is_write").select("stmt", "col"))


def ritual_violations(spark: SparkSession, d: str) -> DataFrame:
    """Statements that write one column of a ritual of support 10 alone."""
    writes = _rows(spark, d).where("is_write").select("stmt", "col")
    return schema.ritual_violations(writes, schema.rituals(writes, 10))


def _join_legs(spark: SparkSession, d: str) -> DataFrame:
    """(x, y): columns of one name in two tables that a procedure reads."""
    reads = _rows(spark, d).where("not is_write").select("object", "proc_name", "column_name", "col").distinct()
    sets = reads.groupBy("object", "proc_name", "column_name").agg(F.array_sort(F.collect_set("col")).alias("cols")).where(F.size("cols") > 1)
    first = sets.select("cols", F.posexplode("cols").alias("at", "x"))
    return first.select("x", F.explode(F.slice("cols", F.col("at") + 2, F.size("cols"))).alias("y")).distinct()


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """(x, y): a column of an unqualified table declared to refer to its namesake at the same place of a qualified one."""
    c = _catalog(spark, d).where("ordinal = 1").select("namespace", "table_name", "column_name", F.concat_ws(".", "namespace", "table_name", "column_name").alias("key"))
    bare = c.where("namespace is null").select("column_name", F.col("key").alias("y"))
    return c.where("namespace is not null").select("column_name", F.col("key").alias("x")).join(bare, "column_name").select("x", "y").distinct()


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, status) of join edges and declared keys."""
    return schema.fk_graph(_declared(spark, d), _join_legs(spark, d))


def schema_implied_keys(spark: SparkSession, d: str) -> DataFrame:
    """Join edges of the schema that no declared key has in either direction."""
    return graph.implied_keys(_join_legs(spark, d), _declared(spark, d))


def graph_legs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, source) of the whole schema graph: statements, what reports retrieve, write, judge by and join, and declared keys."""
    arms = cut(reports.footprint_arms(spark, d))
    stmt, column = F.concat_ws(":", F.lit("stmt:dw"), "file", "object"), F.concat(F.lit("col:"), F.concat_ws(".", "table_name", "column_name"))
    right = F.concat(F.lit("col:"), F.concat_ws(".", "right_table", "right_column"))
    ends = {"retrieve": (stmt, column, "retrieve", "dw_retrieve"), "write": (stmt, column, "writes", "dw_retrieve"), "where": (column, stmt, "reads", "dw_where"), "join": (column, right, "fk", "dw_join")}
    out = graphs.schema_legs(spark, d).select("src", "dst", "kind", "source")
    for arm, (src, dst, kind, source) in ends.items():
        out = out.union(arms.where(F.col("arm") == arm).select(src, dst, F.lit(kind), F.lit(source)))
    declared = _declared(spark, d).select(F.concat(F.lit("col:"), "x"), F.concat(F.lit("col:"), "y"), F.lit("fk"), F.lit("ddl_fk"))
    return out.union(declared).distinct()


def schema_graph(spark: SparkSession, d: str) -> DataFrame:
    """The legs of the whole schema graph by kind and source, with their ends."""
    return graph_legs(spark, d).groupBy("kind", "source").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def schema_risk(spark: SparkSession, d: str) -> DataFrame:
    """How many columns and statements are downstream of each column in the schema graph."""
    return graph.risk_count(graphs.reach_closure(spark, d))


def window_tables(spark: SparkSession, d: str) -> DataFrame:
    """The formal concepts of windows and the tables that they use, per library."""
    windows = load(spark, d, "objects").where(F.lower(F.trim("file")).endswith(".srw")).select(norm("object").alias("object"), scalar.library(F.col("file")).alias("scope")).distinct()
    used = _rows(spark, d).select("object", F.concat_ws(".", "namespace", "table_name").alias("attribute")).distinct()
    return lattice.lattice(windows.join(used, "object").select("scope", "object", "attribute"))


def fk_graph(spark: SparkSession, d: str) -> DataFrame:
    """Join edges against declared keys: corroborated, unenforced, unused."""
    return fk_edges(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def column_usage(spark: SparkSession, d: str) -> DataFrame:
    """How each catalog column is used."""
    rows = _rows(spark, d)
    return schema.column_usage(_catalog(spark, d), rows.where("is_write"), rows.where("not is_write"))


def footprint(spark: SparkSession, d: str) -> DataFrame:
    """The columns that each procedure reads and writes."""
    rows = _rows(spark, d)
    legs = rows.select(F.when(F.col("is_write"), F.col("stmt")).otherwise(F.col("col")).alias("src"), F.when(F.col("is_write"), F.col("col")).otherwise(F.col("stmt")).alias("dst"), F.when(F.col("is_write"), "writes").otherwise("reads").alias("kind")).distinct()
    found = schema.footprint(legs, rows.select("stmt")).join(rows.select("stmt", "object", "proc_name").distinct(), "stmt")
    return found.groupBy("object", "proc_name", "kind").agg(F.count_distinct("column").alias("n_columns"), F.count_distinct("stmt").alias("n_statements"))


def affinity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Co-access and Jaccard similarity of the columns of each table."""
    return schema.affinity_pairs(_rows(spark, d).select("scope", "col", "stmt")).select("scope", "col_a", "col_b", "both", F.round("jaccard", 6).alias("jaccard"))


def affinity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The merges of each table's columns by average linkage."""
    return schema.clusters(_rows(spark, d).select("scope", "col", "stmt"))


def decomposition_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of columns that might be split off their table, with their evidence and cost."""
    rows = _rows(spark, d)
    edges = schema.fk_graph(_declared(spark, d), _join_legs(spark, d)).where("status = 'unenforced'").withColumn("edge", F.concat_ws("|", "x", "y"))
    ends = edges.select(F.col("x").alias("col"), "edge").union(edges.select("y", "edge"))
    scope_of = rows.select("scope", "col").distinct()
    touches = rows.select("scope", "col", "stmt")
    # The statements in the coslice of each column of a block, forward and backward.
    blocks = cut(schema.blocks_of(touches))
    seeds = blocks.select(F.explode("members").alias("seed")).distinct()
    legs = cut(rows.select(F.when(F.col("is_write"), F.col("stmt")).otherwise(F.col("col")).alias("src"), F.when(F.col("is_write"), F.col("col")).otherwise(F.col("stmt")).alias("dst")).distinct())
    ways = [fixpoint.reach(arcs, seeds, zero_hops=False).select("seed", "node") for arcs in (legs, legs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))]
    stmts = rows.select(F.col("stmt").alias("node")).distinct()
    reached = ways[0].union(ways[1]).join(stmts, "node", "left_semi").distinct().select(F.col("seed").alias("col"), F.col("node").alias("stmt"))
    return schema.candidates(touches, rows.where("is_write").select("scope", "stmt", "col"), ends.join(scope_of, "col").select("scope", "col", "edge"), reached.join(scope_of, "col").select("scope", "col", "stmt"), blocks=blocks)


def column_managers(spark: SparkSession, d: str) -> DataFrame:
    """Who reads and writes each column, by statement."""
    return _rows(spark, d).select("col", F.lit("sql").alias("kind"), "file", "object", "proc_name", "line", "is_write").distinct()


def column_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Readers and writers of each column with their lists."""
    rows = _rows(spark, d).groupBy("col")
    reads, writes = F.when(~F.col("is_write"), F.col("object")), F.when(F.col("is_write"), F.col("object"))
    return rows.agg(F.count_distinct(reads).alias("n_readers"), F.count_distinct(writes).alias("n_writers"), F.array_join(F.array_sort(F.collect_set(writes)), ",").alias("writers"))


def table_listing(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the catalog per schema with their use, and the namespace that a bare name has."""
    tables = _catalog(spark, d).groupBy("namespace", "table_name").agg(F.count_distinct("column_name").alias("n_columns"))
    used = _rows(spark, d).groupBy(F.col("namespace").alias("ns"), F.col("table_name").alias("t")).agg(F.count_distinct("stmt").alias("n_statements"))
    bare = schema.bare_name(tables).select(F.col("table_name").alias("b"), "n_namespaces")
    joined = tables.join(used, F.col("namespace").eqNullSafe(F.col("ns")) & (F.col("table_name") == F.col("t")), "left").join(bare, F.col("table_name") == F.col("b"))
    return joined.select("namespace", "table_name", "n_columns", F.coalesce("n_statements", F.lit(0)).alias("n_statements"), "n_namespaces")


def namespace_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Statements' unqualified tables resolved in a default namespace where the catalog has them."""
    refs = _rows(spark, d).select("namespace", "table_name").distinct()
    return schema.resolve_namespace(refs, _catalog(spark, d), "kideb").groupBy("namespace").agg(F.count("*").alias("n_tables"))


def schema_objects(spark: SparkSession, d: str) -> DataFrame:
    """The objects of the schema graph by kind."""
    rows = _rows(spark, d).select(F.concat(F.lit("stmt:sql:"), "stmt").alias("src"), F.concat(F.lit("col:"), "col").alias("dst")).distinct()
    catalog = _catalog(spark, d).select(F.concat(F.lit("col:"), F.concat_ws(".", "namespace", "table_name", "column_name")).alias("object_key"))
    return schema.schema_objects(rows, catalog).groupBy("kind").agg(F.count("*").alias("n"))


def lattice_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The formal concepts of market segments and regions of customers, and of nations within each segment."""
    customer = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lattice.lattice(customer.select(F.col("r_name").alias("scope"), F.col("n_name").alias("object"), F.col("c_mktsegment").alias("attribute")))


_ALL = (
    co_update, ritual_violations, fk_graph, column_usage, footprint, affinity_matrix, affinity_clusters, decomposition_candidates, column_managers, column_lineage, table_listing, namespace_resolution, schema_objects, lattice_concepts, window_tables, schema_graph, schema_implied_keys, schema_risk,
)
QUERIES = {f.__name__: f for f in _ALL}

_R = """
r as (select lower(trim(object)) as object, lower(trim(proc_name)) as proc_name, file, line, lower(trim(namespace)) ns, lower(trim(table_name)) t, lower(trim(column_name)) c, is_write, concat_ws(':', file, lower(trim(object)), lower(trim(proc_name)), line::varchar) stmt,
  concat_ws('.', lower(trim(namespace)), lower(trim(table_name))) scope, concat_ws('.', lower(trim(namespace)), lower(trim(table_name)), lower(trim(column_name))) col from sql_statement_columns where is_write is not null),
k as (select distinct lower(trim(namespace)) ns, lower(trim(table_name)) t, lower(trim(column_name)) c, ordinal from catalog_columns)
"""
_RITUALS = _R + ", w as (select distinct stmt, col from r where is_write), n as (select col, count(*) k from w group by 1), p as (select a.col column_a, b.col column_b, count(*) s from w a join w b on a.stmt = b.stmt and a.col < b.col group by 1, 2)"
_FK = (
    _R
    + """, rd as (select distinct object, proc_name, c, col from r where not is_write), j as (select distinct a.col x, b.col y from rd a join rd b on a.object = b.object and a.proc_name = b.proc_name and a.c = b.c and a.col < b.col),
dk as (select c, concat_ws('.', ns, t, c) key, ns from k where ordinal = 1), dd as (select distinct a.key x, b.key y from dk a join dk b on a.c = b.c and a.ns is not null and b.ns is null),
g as (select x, y, case when exists (select 1 from dd where dd.x = j.x and dd.y = j.y or dd.x = j.y and dd.y = j.x) then 'corroborated' else 'unenforced' end as status from j
  union all select x, y, 'unused' from dd where not exists (select 1 from j where dd.x = j.x and dd.y = j.y or dd.x = j.y and dd.y = j.x))"""
)
ORACLE = {
    "co_update": f"with {_RITUALS} select column_a, column_b, s as co_write_support, a.k + b.k - 2 * s as n_violations from p join n a on a.col = column_a join n b on b.col = column_b where s >= 2",
    "ritual_violations": f"with {_RITUALS} select column_a, column_b, w.stmt, w.col as written_column from p join w on w.col = column_a or w.col = column_b where s >= 10 and not exists (select 1 from w o where o.stmt = w.stmt and o.col = case when w.col = column_a then column_b else column_a end)",
    "schema_graph": f"""with {_FK}, {reports.SQL}, {graphs._LEGS}, every as (select src, dst, kind, source from legs union select concat_ws(':', 'stmt:dw', file, object), 'col:' || table_name || '.' || column_name, 'retrieve', 'dw_retrieve' from rc union select 'col:' || x, 'col:' || y, 'fk', 'ddl_fk' from dd)
      select kind, source, count(*) as n, count(distinct src) as n_src, count(distinct dst) as n_dst from every group by 1, 2""",
    "schema_implied_keys": f"with {_FK} select x, y from g where status = 'unenforced'",
    "schema_risk": "select x, count(*) as n from (" + graphs.ORACLE["reach_closure"] + ") group by 1",
    "fk_graph": f"with {_FK} select status, count(*) as n from g group by 1",
    "column_usage": f"""with {_R}, c as (select distinct ns, t, c from k) select ns as namespace, t as table_name, c as column_name, case when w and rd then 'read_write' when w then 'write_only' when rd then 'read_only' else 'dead' end as usage
      from (select *, exists (select 1 from r where is_write and r.ns is not distinct from c.ns and r.t = c.t and r.c = c.c) w, exists (select 1 from r where not is_write and r.ns is not distinct from c.ns and r.t = c.t and r.c = c.c) rd from c)""",
    "footprint": f"with {_R} select object, proc_name, case when is_write then 'writes' else 'reads' end as kind, count(distinct col) as n_columns, count(distinct stmt) as n_statements from r group by all",
    "affinity_matrix": f"""with {_R}, x as (select distinct scope, col, stmt from r), n as (select scope, col, count(*) k from x group by 1, 2), p as (select a.scope, a.col col_a, b.col col_b, count(*) m from x a join x b on a.scope = b.scope and a.stmt = b.stmt and a.col < b.col group by 1, 2, 3)
      select p.scope, col_a, col_b, m as "both", round(m / (a.k + b.k - m), 6) as jaccard from p join n a on a.scope = p.scope and a.col = col_a join n b on b.scope = p.scope and b.col = col_b""",
    "column_managers": f"with {_R} select distinct col, 'sql' as kind, file, object, proc_name, line, is_write from r",
    "column_lineage": f"with {_R} select col, count(distinct object) filter (not is_write) as n_readers, count(distinct object) filter (is_write) as n_writers, coalesce(string_agg(distinct object, ',' order by object) filter (is_write), '') as writers from r group by 1",
    "table_listing": f"""with {_R}, a as (select ns, t, count(distinct c) n from k group by 1, 2), u as (select ns, t, count(distinct stmt) n from r group by 1, 2), b as (select t, count(*) n from a group by 1)
      select a.ns as namespace, a.t as table_name, a.n as n_columns, coalesce(u.n, 0) as n_statements, b.n as n_namespaces from a left join u on a.ns is not distinct from u.ns and a.t = u.t join b on b.t = a.t""",
    "namespace_resolution": f"with {_R}, x as (select distinct ns, t from r) select case when ns is null and t in (select t from k where ns = 'kideb') then 'kideb' else ns end as namespace, count(*) as n_tables from x group by 1",
    "schema_objects": f"with {_R}, o as (select distinct 'stmt:sql:' || stmt as key from r union select 'col:' || col from r union select 'col:' || concat_ws('.', ns, t, c) from k) select case when key like 'col:%' then 'column' else 'stmt' end as kind, count(*) as n from o group by 1",
}
