import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import orphans as module
from lodestone.operators.orphans import orphans

REFS = "src_table string, row_id long, field string, rank int, key string, at timestamp_ntz"
LIVES = "key string, born timestamp_ntz, gone timestamp_ntz"


def brute(refs, lives):
    out = {}
    for src, row, field, rank, key, at in refs:
        if key is None:
            continue
        own = [(b, g) for k, b, g in lives if k == key]
        if at is not None and any(b <= at and (g is None or g > at) for b, g in own):
            continue
        reason = "missing" if not own else "deleted" if at is not None and any(g is not None and g <= at for _, g in own) else "late"
        best = out.get((src, row))
        if best is None or rank < best[0]:
            out[(src, row)] = (rank, field, reason)
    return {k: v[1:] for k, v in out.items()}


def when(rnd):
    day = datetime(2023, 1, 1) + timedelta(days=rnd.randrange(120))
    return day.replace(day=1) if rnd.random() < 0.3 else day + timedelta(seconds=rnd.randrange(86400))


def test_random_lives_against_brute_force(spark):
    rnd = random.Random(3)
    keys = [f"k{i}" for i in range(150)]
    lives = []
    for k in keys[:110]:
        for _ in range(rnd.choice([1, 1, 1, 2, 3])):
            born = when(rnd)
            lives.append((k, born, born + timedelta(seconds=rnd.randrange(1, 86400 * 70)) if rnd.random() < 0.6 else None))
    lives += lives[:20]
    hot = keys[0]
    refs = []
    for i in range(1500):
        key = hot if rnd.random() < 0.33 else rnd.choice(keys)
        at = None if rnd.random() < 0.02 else rnd.choice([b for _, b, _ in lives]) if rnd.random() < 0.2 else when(rnd)
        refs.append(("t", i, "a", 1, None if rnd.random() < 0.05 else key, at))
        if rnd.random() < 0.5:
            refs.append(("t", i, "b", 2, rnd.choice(keys), at))
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES)).collect()
    assert {(r.src_table, r.row_id): (r.field, r.reason) for r in got} == brute(refs, lives)
    assert len(got) == len(brute(refs, lives))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], LIVES)
    refs = spark.createDataFrame([("t", 1, "a", 1, "k", datetime(2023, 1, 1))], REFS)
    assert [r.reason for r in orphans(refs, none).collect()] == ["missing"]
    assert orphans(refs.where(F.lit(False)), none).count() == 0


def test_many_years_and_lives_of_all_kinds(spark):
    rnd = random.Random(5)
    far = lambda: datetime(rnd.choice([1, 1969, 1970, 2015, 2019, 2023, 2030, 9999]), rnd.randrange(1, 13), rnd.randrange(1, 28), rnd.randrange(24))
    lives = [(f"k{rnd.randrange(80)}", *sorted([far(), far()])) for _ in range(150)]
    lives = [(k, b, rnd.choice([g, None])) for k, b, g in lives] + [(None, far(), None)]
    refs = [("t", i, "a", 1, f"k{rnd.randrange(100)}", None if i % 50 == 0 else far()) for i in range(1200)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES)).collect()
    assert {(r.src_table, r.row_id): (r.field, r.reason) for r in got} == brute(refs, lives)
    assert len(got) == len(brute(refs, lives))


def test_lives_are_read_once_and_references_twice(spark, tmp_path, monkeypatch):
    """Each reading adds the plan of the tables, its stages and their tasks to what the driver holds."""
    spark.createDataFrame([("t", 1, "a", 1, "k", datetime(2023, 1, 1))], REFS).write.parquet(f"{tmp_path}/refs")
    spark.createDataFrame([("k", datetime(2023, 1, 5), None)], LIVES).write.parquet(f"{tmp_path}/lives")
    plans, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: plans.append(df) or cut(df))
    out = orphans(spark.read.parquet(f"{tmp_path}/refs"), spark.read.parquet(f"{tmp_path}/lives"))
    read = [df.inputFiles() for df in [*plans, out]]
    assert [r.reason for r in out.collect()] == ["late"]
    assert sum(any("/refs/" in f for f in files) for files in read) == 2
    assert sum(any("/lives/" in f for f in files) for files in read) == 1
