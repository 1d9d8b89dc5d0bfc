import struct

import pytest

from lodestone.functions import sqltext
from lodestone.sources import ddl, files, library, report, script, sinks

SOURCE = """HA$PBExportHeader$w_a.srw
/* head
 comment */
forward
global type w_a from window
end type
end forward

forward prototypes
public function long of_sum (long al_x, string as_y)
end prototypes

public function long of_sum (long al_x, string as_y);
long ll_n = 1, ll_m
string ls_t
SELECT a, b INTO :ll_n, :ls_t FROM t
 WHERE c = :al_x;
if ll_n > 0 and &
   al_x < 3 then
\tll_m = of_other(ll_n, ls_t) // "not a string
\tll_m += 2
elseif al_x = 5 then
\treturn 0
end if
for ll_n = 1 to al_x
\tif ll_n = 2 then exit
\tll_m++
next
UPDATE t SET a = :ll_m WHERE c = :as_y;
return ll_m
end function

event open;
choose case is_mode
case "a"
\tthis.of_sum(1, "x;y")
case else
\tdo while true
\t\tll_q = 1
\tloop
end choose
end event
"""


def of(tag, *parts):
    return [tuple(r[i] for i in parts) for r in script.facts(SOURCE) if r[0] == tag]


def test_script_facts():
    assert of("proc", 2, 5, 6) == [("of_sum", "function", "long"), ("open", "event", "")]
    assert of("type", 4, 6) == [("w_a", "window")]
    assert ("al_x", "param", "long") in of("def", 4, 5, 6)
    kinds = {(v, k) for v, k in of("def", 4, 5)}
    assert {("ll_n", "local_var"), ("ls_t", "local_var"), ("ll_n", "sql_into"), ("ls_t", "sql_into"), ("ll_m", "assign"), ("ll_m", "augassign"), ("ll_n", "for_var"), ("ll_m", "inc")} <= kinds
    uses = set(of("use", 4, 5, 6))
    assert {("al_x", "sql_host_var", "SELECT"), ("ll_m", "sql_host_var", "UPDATE"), ("al_x", "condition", None), ("ll_n", "call_arg", "of_other:0"), ("ls_t", "call_arg", "of_other:1"), ("ll_m", "return", None), ("al_x", "loop_range", None), ("is_mode", "condition", None)} <= uses
    assert of("call", 4, 5, 6) == [("of_other", None, "2"), ("of_sum", "this", "2")]
    assert [o for (o,) in of("sql", 4)] == ["SELECT", "UPDATE"]


def test_logical_lines_keep_numbers_and_join():
    lines = script.logical_lines(SOURCE)
    assert (18, "if ll_n > 0 and \n   al_x < 3 then".replace("\n", " ")) in [(n, " ".join(t.split()) if "and" in t else t) for n, t in lines] or any(n == 18 and t.endswith("then") for n, t in lines)
    assert any(t.startswith("SELECT") and t.endswith(";") for _, t in lines)


def test_broken_scripts_give_what_can_be_read():
    body = "for i = 1 to 2\nend if\nelse\nif a then\nnext\nloop\ncase 1\nend choose\nx = (1\ny = 'open\nexit\n"
    text = f"public function long of_a ();\n{body}end function\npublic function long of_b ();\n/* open"
    assert [r[2] for r in script.facts(text) if r[0] == "proc"] == ["of_a", "of_b"]
    for i in range(len(SOURCE)):
        list(script.facts(SOURCE[:i]))


def test_script_frame_with_nulls(spark):
    df = spark.createDataFrame([("f", SOURCE), ("g", None), ("h", "")], "file string, lines string")
    facts = script.script_facts(df)
    assert {r.file for r in facts.collect()} == {"f"}


LINEAGE = [
    ("SELECT a FROM t UNION SELECT b FROM u", {("t", "a", False), ("u", "b", False)}),
    ("select x.a, y.a from t x, t y where x.k = y.k", {("t", "a", False), ("t", "k", False)}),
    ("select a from t, u", {(None, "a", False)}),
    ("INSERT INTO t (a, b) VALUES (:x, 5)", {("t", "a", True), ("t", "b", True)}),
    ("UPDATE t SET a = b + 1 WHERE c IN (1, 2)", {("t", "a", True), ("t", "b", False), ("t", "c", False)}),
    ("SELECT o.a FROM t o WHERE EXISTS (SELECT 1 FROM u WHERE u.k = o.k)", {("t", "a", False), ("u", "k", False), ("o", "k", False)}),
    ("DECLARE c CURSOR FOR SELECT a FROM t USING sqlca;", {("t", "a", False)}),
    ("SELECT a FROM t START WITH b = 1", {("t", "a", False), ("t", "b", False)}),
]


@pytest.mark.parametrize(("sql", "want"), LINEAGE)
def test_lineage(sql, want):
    assert {(t, c, w) for _, t, c, w in sqltext.lineage(sql).columns} == want


def test_lineage_catalog_filters_and_errors():
    assert sqltext.lineage("select a, b from t, u", {"t": ["a"], "u": ["b", "q"]}).columns == [(None, "t", "a", False), (None, "u", "b", False)]
    assert sqltext.lineage("select 1 from s.t where a = 'it''s' and b in (1,2) and c = d").filters == [(None, "a", "=", ("it's",)), (None, "b", "in", ("1", "2"))]
    assert sqltext.lineage("FETCH c INTO :x") is None
    assert sqltext.rows("select (a from t")[0][0] == "error"
    assert sqltext.rows("")[0][0] == "error"
    assert sqltext.lineage("SELECT count(*) FROM s.t").tables == {("s", "t"): None}


def test_lineage_frame(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t"), (2, None)], "id int, raw_sql string")
    assert {(r.id, r.tag, r.table_name, r.column_name) for r in sqltext.statement_lineage(df).collect()} == {(1, "table", "t", None), (1, "column", "t", "a")}


DUMP = """-- dump
CREATE TABLE `main`.`a` (`id` bigint NOT NULL, `n` varchar(10) DEFAULT 'x,y)', PRIMARY KEY (`id`), CONSTRAINT `f` FOREIGN KEY (`n`,`id`) REFERENCES `b` (`m`,`k`), CHECK (`id` > 0));
create or replace view v2 as select * from v1;
create view v1 (p, q) as select id, n from a;
create view v3 as select * from nowhere;
alter table a add constraint fk2 foreign key (id) references c;
GRANT ALL ON a TO b;
"""


def test_ddl():
    rows, stats = ddl.parse(DUMP, "main")
    assert [(r[2], r[3], r[4]) for r in rows if r[0] == "column"] == [("a", "id", 0), ("a", "n", 1), ("v1", "p", 0), ("v1", "q", 1), ("v2", "p", 0), ("v2", "q", 1)]
    assert [(r[3], r[7], r[8]) for r in rows if r[0] == "fk"] == [("n", "b", "m"), ("id", "b", "k"), ("id", "c", None)]
    assert [r[3] for r in rows if r[0] == "pk"] == ["id"]
    assert [r[9] for r in rows if r[0] == "check"] == ["`id` > 0"]
    assert (stats.total, stats.parsed, stats.skipped) == (6, 4, 2)
    assert stats.previews == ["[unparsed] GRANT ALL ON a TO b", "[unresolved view] v3"]


def test_dewrap_and_tags():
    wide = "CREATE TABLE t (" + ", ".join(f"column_number_{i} varchar(100)" for i in range(40)) + ");"
    wrapped = "\n".join(wide[i : i + 80] for i in range(0, len(wide), 80))
    rows, stats = ddl.parse(wrapped)
    assert stats.dewrapped and [r[3] for r in rows if r[0] == "column"] == [f"column_number_{i}" for i in range(40)]
    assert ddl.schema_tag("Arc=/x/y.sql") == ("arc", "/x/y.sql") and ddl.schema_tag("/x/y.sql") == (None, "/x/y.sql")
    with pytest.raises(ValueError):
        ddl.check_namespaces(["a=x.sql"], None)


def test_ddl_frame(spark):
    df = spark.createDataFrame([("f", DUMP), ("g", None)], "file string, lines string")
    got = ddl.ddl_catalog(df, "main").where("tag = 'stats'").collect()
    assert [(r.file, r.ordinal, r.value) for r in got] == [("f", 6, "4,2,false")]


REPORT = """release 9;
datawindow(units=0 color=1 )
table(column=(type=char(5) name=a dbname="t.a" ) column=(type=long name=b dbname="t.b" update=yes)
 retrieve="PBSELECT( VERSION(400) TABLE(NAME=~"t~") COLUMN(NAME=~"t.a~") COLUMN(NAME=~"t.b~") JOIN(LEFT=~"t.a~" OP=~"=~" RIGHT=~"u.a~") WHERE(EXP1=~"t.a~" OP=~"=~" EXP2=~":x~" LOGIC=~"or~") WHERE(EXP1=~"t.b~" OP=~">~" EXP2=~"5~")) ARG(NAME=~"x~" TYPE=string)" )
text(band=header text="a (" x="10" y="8" name=a_t )
"""


def test_report(spark):
    facts = report.facts(REPORT)
    assert [f[2] for f in facts if f[0] == "retrieve"] == ["SELECT a, b FROM t WHERE a = ? OR b > 5"]
    assert [(f[1], f[2], f[3]) for f in facts if f[0] == "column"] == [("a", "t.a", "char(5)"), ("b", "t.b", "long")]
    assert [(f[1], f[2], f[3], f[4]) for f in facts if f[0] == "control"] == [("a_t", "text", "header", "10")]
    assert [(f[1], f[4]) for f in facts if f[0] == "join"] == [("t.a", "u.a")]
    assert [(f[1], f[2]) for f in facts if f[0] == "argument"] == [("x", "string")]
    assert report.retrieve("SELECT 1 FROM t").raw == "SELECT 1 FROM t"
    assert report.report_facts(spark.createDataFrame([("f", REPORT), ("g", None)], "file string, lines string")).count() == len(facts)
    assert report.pipeline_facts('PIPELINE(type=replace)SOURCE(name="a",COLUMN(x=y))RETRIEVE(statement="SELECT 1")DESTINATION(name="b")') == [("option", "type", "replace"), ("source", "a", None), ("statement", None, "SELECT 1"), ("destination", "b", None)]
    assert report.project_facts("EXE:a.exe,,1,0,1\r\n\r\nPBD:x.pbl,,1") == [("EXE", ["a.exe", "", "1", "0", "1"]), ("PBD", ["x.pbl", "", "1"])]


def pbl(entries, unicode=False):
    """The bytes of a library with one node."""
    encode = (lambda s: s.encode("utf-16-le")) if unicode else (lambda s: s.encode("cp1253"))
    first = library.FIRST_NODE_UNICODE if unicode else library.FIRST_NODE_ANSI
    data = bytearray(b"HDR*" + (b"P\0" if unicode else b"Po")).ljust(first, b"\0")
    node = bytearray(b"NOD*").ljust(library.ENTRIES_AT, b"\0")
    struct.pack_into("<H", node, library.COUNT_AT, len(entries))
    blocks, at = bytearray(), first + library.NODE
    for name, text, comment in entries:
        raw = encode(comment + text)
        chunks = [raw[i : i + 500] for i in range(0, len(raw), 500)] or [b""]
        node += b"ENT*" + (b"\0" * 8 if unicode else b"0600") + struct.pack("<III", at + len(blocks), len(raw), 0) + struct.pack("<HH", len(comment), len(encode(name)) + (2 if unicode else 1)) + encode(name) + (b"\0\0" if unicode else b"\0")
        for i, c in enumerate(chunks):
            nxt = 0 if i == len(chunks) - 1 else at + len(blocks) + 512
            blocks += (b"DAT*" + struct.pack("<IH", nxt, len(c)) + c).ljust(512, b"\0")
    return bytes(data + node.ljust(library.NODE, b"\0") + blocks)


@pytest.mark.parametrize("unicode", [False, True])
def test_library(spark, tmp_path, unicode):
    entries = [("w_a.srw", "forward\n" * 200, "note"), ("d_b.srd", "release 9;", ""), ("x.bmp", "no source", "")]
    data = pbl(entries, unicode)
    assert library.sources(data) == [(n, t) for n, t, _ in entries[:2]]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pbl").write_bytes(data)
    (tmp_path / "bad.pbl").write_bytes(b"nothing")
    got = library.read_libraries(spark, str(tmp_path)).collect()
    assert {(r.name, r.error is None) for r in got} == {("w_a.srw", True), ("d_b.srd", True), (None, False)}


def test_files(spark, tmp_path, rows):
    (tmp_path / "w.srw").write_text("forward\nend forward\n")
    (tmp_path / "n.txt").write_text("x")
    listed = files.walk(spark, str(tmp_path))
    assert [r.file.rsplit("/", 1)[1] for r in listed.collect()] == ["w.srw"]
    assert [r.lines for r in script.read_sources(spark, str(tmp_path)).collect()] == ["forward\nend forward\n"]
    state = lambda e: spark.createDataFrame(e, "file string, sha string")
    assert rows(files.diff_state(state([("a", "1"), ("b", "2"), ("c", "3")]), state([("b", "2"), ("c", "9"), ("d", "4")]))) == [("a", "new"), ("b", "unchanged"), ("c", "changed"), ("d", "deleted")]
    q = files.canned_query("q", "-- What it\n-- does.\n-- :n INT 5\n-- :name TEXT\n-- @entity a object\nSELECT a FROM t WHERE b = $name LIMIT $n;")
    assert (q.description, q.params, q.entities, q.sql) == ("What it does.", [("n", "INT", "5"), ("name", "TEXT", None)], {"a": "object"}, "SELECT a FROM t WHERE b = :name LIMIT :n")
    table = spark.createDataFrame([("f", "a\r\nb\nc")], "file string, lines string")
    assert rows(files.source_lines(table, "f")) == [(1, "a"), (2, "b"), (3, "c")]
    stubs = spark.createDataFrame([("datastore", "// @effects db.read, ui\npublic function long retrieve()\nsubroutine other()")], "object string, lines string")
    assert rows(files.effect_annotations(stubs)) == [("datastore", "retrieve", "db.read"), ("datastore", "retrieve", "ui")]
    assert files.mock_sql({"orders": table}, "select * from ORDERS") is table


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    target = str(tmp_path / "db")
    sinks.publish(spark, {"t": df}, target)
    sinks.publish(spark, {"t": df.limit(1)}, target)
    assert spark.read.parquet(f"{target}/t.parquet").count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["db"]
    assert rows(sinks.upsert(df, spark.createDataFrame([("b", 9)], "key string, value int"))) == [("a", 1), ("b", 9)]
    assert [r.json for r in sinks.as_json(df.limit(1)).collect()] == ['{"key":"a","value":1}']
    assert "key" in sinks.as_table(df) and "<table" in sinks.as_html(df, "t")
