import json
import time

import pytest

import __spark_entry__ as entry
from lodestone.functions import scalar
from lodestone.plans import catalog, registry
from lodestone.streaming import progress
from pyspark.sql import functions as F


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 100


def test_canned_parameters():
    q = catalog.catalogue()["coupling"]
    assert catalog.bind(q, {}) == {"n": 20} and catalog.bind(q, {"n": "3"}) == {"n": 3}
    with pytest.raises(ValueError, match="missing"):
        catalog.bind(catalog.catalogue()["callers"], {})
    with pytest.raises(ValueError, match="unknown"):
        catalog.bind(q, {"m": 1})


def test_gate(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert catalog.run_adhoc(spark, " select count(*) AS n from three;").first().n == 3
    for bad in ("drop table three", "select 1; drop table three", "insert into three values (1)", ""):
        with pytest.raises(ValueError):
            catalog.run_adhoc(spark, bad)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = F.lit("Hello")
    assert one(scalar.mid(s, F.lit(2), F.lit(3))) == "ell" and one(scalar.mid(s, F.lit(0))) == "Hello"
    assert one(scalar.right(s, F.lit(0))) == "Hello" and one(scalar.right(s, F.lit(2))) == "lo"
    assert one(scalar.length(F.lit("a🙂"))) == 3 and one(scalar.pos(s, F.lit("l"))) == 3 and one(scalar.pos(s, F.lit("z"))) == 0
    assert one(scalar.integer(F.lit(" -12x"))) == -12 and one(scalar.integer(F.lit("x"))) == 0
    assert one(scalar.real(F.lit("1.5e1z"))) == 15.0 and one(scalar.is_number(F.lit(""))) and not one(scalar.is_number(F.lit("1x")))
    assert one(scalar.round_half_up(F.lit(-2.5), F.lit(0))) == -2.0 and one(scalar.round_half_up(F.lit(2.45), F.lit(1))) == 2.5
    assert one(scalar.greatest(F.lit(-1), F.lit(None).cast("int"))) == 0 and one(scalar.rgb(F.lit(1), F.lit(2), F.lit(3))) == 66051
    assert one(scalar.trim(F.lit("\t a \n"))) == "a" and one(scalar.unescape(F.lit('~"a~~'))) == '"a~'
    assert one(scalar.sql_operation(F.lit("  commit;"))) == "COMMIT" and one(scalar.sql_operation(F.lit("selection"))) is None
    assert one(scalar.into_variables(F.lit("select a into :x, :y from t where b = :z"))) == ["x", "y"] and one(scalar.into_variables(F.lit("insert into t values (:a)"))) == []
    assert one(scalar.lint_codes(F.lit("select * from t"))) == ["select_star"] and one(scalar.lint_codes(F.lit("delete from nowhere_t"))) == []
    assert one(scalar.lint_codes(F.lit("delete from nowhere_t"), True)) == ["write_no_where"]
    assert one(scalar.control_type(F.lit("cbx_a"))) == "checkbox" and one(scalar.control_type(F.lit("cb_a"))) == "commandbutton" and one(scalar.control_type(F.lit("q"))) is None
    assert one(scalar.type_family(F.lit("decimal{2}"))) == "numeric" and one(scalar.type_family(F.lit("w_x"))) == "user_type:w_x"
    assert one(scalar.library(F.lit("a/b.PBL/c.sru"))) == "b.PBL" and one(scalar.category(F.lit("x.SRW"))) == "window"
    assert one(scalar.split_reference(F.lit("a.b.c"))) == ("a.b", "c") and one(scalar.split_reference(F.lit("abc"))) is None


def test_progress_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [{"tag": "phase", "name": "a"}, {"tag": "step", "label": "parse", "elapsed_ms": 5.0, "since_start_ms": 10.0, "residency_mb": 3.0}, {"tag": "step", "label": "parse", "elapsed_ms": 9.0, "since_start_ms": 20.0, "residency_mb": 2.0}]
    (source / "1.json").write_text("\n".join(map(json.dumps, events)))
    seen = []
    query = progress.snapshots(progress.step_state(progress.read_events(spark, str(source))), lambda df, i: seen.append(df.collect()), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        (source / "2.json").write_text(json.dumps({"tag": "step", "label": "link", "since_start_ms": 30.0}))
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.label, r.elapsed_ms, r.residency_mb, r.n_events) for r in seen[-1]} == {("parse", 9.0, 3.0, 2), ("link", None, None, 1)}


def test_gaps(spark, rows):
    df = spark.createDataFrame([("w", 500.0, 900.0), ("w", 600.0, 700.0), ("w", 850.0, 1000.0), ("w", 1100.0, 1200.0)], "k string, began double, ended double")
    assert rows(progress.gaps(df, "k", 2000.0)) == [("w", 0.0, 500.0), ("w", 1200.0, 2000.0)]


def test_jobs():
    jobs = progress.Jobs(kept=2)
    a = jobs.start("k", lambda: time.sleep(0.2) or 7)
    assert jobs.start("k", lambda: 8) == a and jobs.state(a) == "running"
    assert jobs.result(a) == 7 and jobs.state(a) == "done"
    b = jobs.start("k", lambda: 1 / 0)
    time.sleep(0.1)
    assert b != a and jobs.state(b) == "failed" and jobs.state("none") == "unknown"


def test_metrics_of_canned_queries_take_all_rounds(spark, monkeypatch):
    from lodestone.plans import catalog

    monkeypatch.setattr(catalog.graph, "object_metrics", lambda *parts, **options: options)
    assert catalog.RELATIONS["object_metrics"](spark, "/root/testdata/sf0.001") == {}


def test_concepts_come_from_all_customers(spark, monkeypatch):
    from lodestone.plans import schemas

    monkeypatch.setattr(schemas.lattice, "lattice", lambda incidence: incidence)
    assert schemas.lattice_concepts(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
