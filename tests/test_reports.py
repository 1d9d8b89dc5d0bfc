from lodestone.plans import reports, schemas

REPORT = """release 10;
datawindow(units=0 )
table(column=(type=long update=yes name=a dbname="t_x.a" )
 column=(type=long update=no name=b dbname="t_y.b" )
 retrieve="PBSELECT( VERSION(400) TABLE(NAME=~"t_x~" ) TABLE(NAME=~"t_y~" ) COLUMN(NAME=~"t_x.a~") JOIN (LEFT=~"t_x.a~" OP =~"=~" RIGHT=~"t_y.b~" ) WHERE( EXP1 =~"t_x.a~" OP =~"=~" EXP2 =~":n~" LOGIC =~"and~" ) WHERE( EXP1 =~"t_y.unknown~" OP =~"=~" EXP2 =~"1~" ) )" )
text(band=header text="a" x="0" y="8" name=a_t )
"""


def _tables(spark, folder):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    # Known by kind in spite of its extension, by extension where the kind is NULL, and not a report in spite of its extension.
    put("objects", [("r/l.pbl/d_one.xyz", "DataWindow ", "d_one"), ("r/l.pbl/D_Two.SRD", None, "d_two"), ("r/l.pbl/w.srd", "powerscript", "w")], "file string, kind string, object string")
    put("source_files", [("r/l.pbl/d_one.xyz", REPORT), ("r/l.pbl/D_Two.SRD", REPORT), ("r/l.pbl/w.srd", REPORT), ("r/l.pbl/d_none.srd", None)], "file string, lines string")
    put("catalog_columns", [(None, "T_X", " a", 1), (None, "t_y", "b", 2)], "namespace string, table_name string, column_name string, ordinal int")
    put("sql_statement_columns", [], "file string, object string, proc_name string, line int, namespace string, table_name string, column_name string, is_write boolean")
    return str(folder)


def test_footprint_and_legs(spark, rows, tmp_path):
    d = _tables(spark, tmp_path / "t")
    got = rows(reports.footprint_arms(spark, d), "object", "arm", "table_name", "column_name", "right_table", "right_column")
    one = [("join", "t_x", "a", "t_y", "b"), ("retrieve", "t_x", "a", None, None), ("retrieve", "t_y", "b", None, None), ("where", "t_x", "a", None, None), ("write", "t_x", "a", None, None)]
    assert got == sorted([(o, *r) for o in ("d_one", "d_two") for r in one], key=str)
    assert rows(schemas.schema_graph(spark, d), "kind", "source", "n") == [("fk", "dw_join", 1), ("reads", "dw_where", 2), ("retrieve", "dw_retrieve", 4), ("writes", "dw_retrieve", 2)]
