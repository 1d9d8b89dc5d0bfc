from pyspark.sql import functions as F

from lodestone.session import cut, cut_counting, filled, norm, small


def test_cut_keeps_rows_and_forgets_estimates(spark, rows):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    for _ in range(6):
        df = cut(df.alias("a").join(df.alias("b"), F.col("a.id") == F.col("b.id")).select("a.id", "b.x"))
    assert rows(df) == [(i, 2 * i) for i in range(5)]
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert len(size) <= 20


def test_counting(spark):
    kept, n = cut_counting(spark.range(10), F.col("id") > 6)
    assert (kept.count(), n) == (10, 3)
    assert cut_counting(spark.range(0))[1] == 0


def test_small_is_checked(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(small(spark.range(6), 5)).lower()


def test_names(spark):
    df = spark.createDataFrame([(" A b ",), ("",), ("  ",), (None,)], "n string")
    assert [r.x for r in df.select(norm("n").alias("x")).collect()] == ["a b", "", "", None]
    assert [r.x for r in df.select(filled("n").alias("x")).collect()] == ["a b", None, None, None]


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 20, "a string")
    assert "broadcast" in small(wide)._jdf.queryExecution().toString().lower() and "broadcast" not in small(wide, size=5000)._jdf.queryExecution().toString().lower()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as N

    import pytest

    from lodestone.session import ensure_checkpoint_dir

    set_to = []
    conf = N(get=lambda k, *d: d[0] if d else None)
    session = lambda master, named: N(sparkContext=N(getCheckpointDir=lambda: None, master=master, getConf=lambda: conf, setCheckpointDir=set_to.append), conf=N(get=lambda k, d=None: named))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077", None))
    ensure_checkpoint_dir(session("spark://host:7077", "/shared"))
    ensure_checkpoint_dir(session("local[2]", None))
    assert set_to[0] == "/shared" and len(set_to) == 2
