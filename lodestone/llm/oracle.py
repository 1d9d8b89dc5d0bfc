"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_P4 = """
with w as (select distinct file, lower(trim(object)) o, lower(trim(proc_name)) p, line, lower(trim(namespace)) ns, lower(trim(table_name)) t, lower(trim(column_name)) c
  from sql_statement_columns where is_write and trim(table_name) <> '' and trim(column_name) <> ''),
n as (select ns, t, count(distinct (file, o, p, line)) n from w group by all),
k as (select ns, t, c, count(*) k from w group by all),
s as (select a.ns, a.t, a.c ca, b.c cb, count(*) s from w a join w b on a.file is not distinct from b.file and a.o is not distinct from b.o and a.p is not distinct from b.p and a.line is not distinct from b.line
  and a.ns is not distinct from b.ns and a.t = b.t and a.c < b.c group by all),
r as (select concat_ws('.', s.ns, s.t, ca) column_a, concat_ws('.', s.ns, s.t, cb) column_b, s::int co_write_support, ka.k support_a, kb.k support_b, n from s
  join n on n.ns is not distinct from s.ns and n.t = s.t join k ka on ka.ns is not distinct from s.ns and ka.t = s.t and ka.c = ca join k kb on kb.ns is not distinct from s.ns and kb.t = s.t and kb.c = cb)
"""

ORACLE: dict[str, str] = {
    "p4_found": _P4 + "select column_a, column_b, co_write_support from r where co_write_support >= 5 and co_write_support * n >= 2 * support_a * support_b",
    "p4_support": _P4 + "select column_a, column_b, co_write_support, support_a, support_b, n from r",
}
