"""References to records that do not exist, at the time of the reference.

1. Keys are dictionary-encoded as integers: ``bucket << 40 | ordinal in the bucket``,
   so numbering needs no global order. Beside the id stand the months in which the
   key is referred to, as bits, and its lives, so nothing is joined to the ids.
2. References and parents become compressed bitmaps: a word of 64 neighbouring ids
   per key range and period (month), only words with a set bit being kept. A
   parent's bit is set in the periods that it spans as a whole.
3. reference AND NOT parent; surviving bits are decoded to (key, period).
4. Only rows of surviving (key, period) are held against the lives that begin or end
   inside the period, which makes the answer exact to the microsecond.

Bitmaps and the months of a key are pre-aggregated map-side, so a key with a third of
all rows costs a row per task and 64 months; the join back to the rows is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.session import cut, filled, load, norm

#: Buckets of the dictionary and copies of the small side in the join back to the rows.
BUCKETS, SALT = 256, 8
_BEGIN, _NEVER = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"
_SEP = "\x1f"


def _ts(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def key_of(kind: str, *parts: Column) -> Column:
    """A composite key; NULL if any part is NULL."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(_SEP), p)])


def _null_safe(c: Column) -> Column:
    """A name in which NULL is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("-"))


def lives_of(df: DataFrame, key: Column) -> DataFrame:
    """(key, born, gone). A row without indexed_at never begins, but its name is known."""
    return df.select(
        key.alias("key"), F.coalesce(_ts("indexed_at"), F.lit(_NEVER).cast("timestamp_ntz")).alias("born"), _ts("dropped_at").alias("gone")
    ).where("key is not null")


def always(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("key"), F.lit(_BEGIN).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("gone")).where("key is not null")


def dictionary(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """(id, key, era, months, born, gone): all that is said of each key beside its id, which is dense within each of BUCKETS hash buckets.

    A row per key and 64 months (era) of references, with the months as bits, and a row
    per distinct life, with era NULL. refs: (key, period). lives: (key, born, gone).
    """
    seen = refs.groupBy("key", F.shiftright("period", 6).alias("era")).agg(F.expr("bit_or(shiftleft(1L, period & 63))").alias("months"))
    said = seen.unionByName(lives.select("key", "born", "gone").where("key is not null").distinct(), allowMissingColumns=True)
    said = said.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    ordinal = F.dense_rank().over(W.partitionBy("_b").orderBy("key")) - 1
    return said.select((F.shiftleft(F.col("_b").cast("long"), 40) + ordinal).alias("id"), "key", "era", "months", "born", "gone")


def _word() -> Column:
    return F.shiftright("id", 6).alias("word")


def _bit() -> Column:
    return F.expr("bit_or(shiftleft(1L, cast(id & 63 as int)))")


def _ones(bits: str) -> Column:
    """A row for each set bit: its place."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col(bits), i) == 1))


def surviving(ids: DataFrame) -> DataFrame:
    """(key, period, known, first_gone) of references to a key that doesn't span the whole period.

    ids: as ``dictionary`` gives it. known: some life has the key; first_gone: the
    earliest end of its lives.
    """
    months = ids.where("era is not null").select("id", "era", _ones("months").alias("_p"))
    wanted = months.groupBy(_word(), (F.shiftleft("era", 6) + F.col("_p")).alias("period")).agg(_bit().alias("bits"))
    first = F.when(F.col("born") == F.date_trunc("month", "born").cast("timestamp_ntz"), _month(F.col("born"))).otherwise(_month(F.col("born")) + 1)
    until = F.coalesce(_month(F.col("gone")) - 1, F.lit(10_000 * 12))
    spans = ids.where("era is null").select("id", first.alias("p0"), until.alias("p1")).where("p0 <= p1")
    spans = spans.groupBy(_word().alias("w"), "p0", "p1").agg(_bit().alias("parents"))
    there = (F.col("word") == F.col("w")) & F.col("period").between(F.col("p0"), F.col("p1"))
    absent = wanted.join(spans, there, "left").groupBy("word", "period", "bits").agg(F.expr("bit_or(coalesce(parents, 0L))").alias("parents"))
    absent = absent.select("word", "period", F.expr("bits & ~parents").alias("bits")).where("bits <> 0")
    decoded = absent.select("period", _ones("bits").alias("_p"), "word").select("period", (F.shiftleft("word", 6) + F.col("_p")).alias("id"))
    names = ids.groupBy("id").agg(F.min("key").alias("key"), F.max(F.col("era").isNull()).alias("known"), F.min("gone").alias("first_gone"))
    return decoded.join(names, "id").drop("id")


def orphans(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The references that hold nothing at their time, with the reason.

    refs: (src_table, row_id, field, rank, key, at), a row per reference; lives:
    (key, born, gone). A thing exists at t if a row of it has born <= t and gone NULL
    or > t. reason is ``missing`` if no row has the key, else ``deleted`` if some row
    has gone <= t, else ``late``. A row with several dangling fields comes out once,
    with the field of the least rank; row_id is unique within src_table. A NULL key is
    no reference; at a NULL time nothing exists. Repeated rows count each; empty
    inputs give an empty result (no lives: every reference is missing).

    lives are read once and refs twice: what else is asked of them is in the
    dictionary, which keeps the plans, and the driver's memory, small.
    """
    refs = refs.where("key is not null").withColumn("at", _ts("at"))
    period = F.coalesce(_month(F.col("at")), F.lit(-1))
    refs = refs.withColumn("period", period)
    ids = cut(dictionary(refs, lives))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    left = cut(surviving(ids).withColumn("salt", salts))
    rows = refs.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int")).join(left, ["key", "period", "salt"])
    edges = ids.where("era is null").select("key", "born", "gone", F.explode(F.array_distinct(F.array_compact(F.array(_month(F.col("born")), _month(F.col("gone")))))).alias("period"))
    edges = edges.withColumn("salt", salts)
    r, e = rows.alias("r"), edges.alias("e")
    same = [F.col(f"r.{c}") == F.col(f"e.{c}") for c in ("key", "period", "salt")]
    alive = (F.col("e.born") <= F.col("r.at")) & (F.col("e.gone").isNull() | (F.col("e.gone") > F.col("r.at")))
    dangling = r.join(e, [*same, alive], "left_anti")
    reason = F.when(~F.col("known"), "missing").when(F.col("first_gone") <= F.col("at"), "deleted").otherwise("late")
    least = dangling.groupBy("src_table", "row_id").agg(F.min(F.struct("rank", "field", reason.alias("reason"), F.col("at"))).alias("x"))
    return least.select("src_table", "row_id", "x.field", "x.reason", "x.at")


def code_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, lives) of the tables of calls, statements, objects, procedures and the catalog."""
    calls = load(spark, sf_dir, "resolved_calls").select("row_id", filled("target_object").alias("o"), filled("target_proc").alias("p"), "indexed_at")
    both = F.array(
        F.struct(F.lit("target_object").alias("field"), F.lit(1).alias("rank"), key_of("o", F.col("o")).alias("key")),
        F.struct(F.lit("target_proc").alias("field"), F.lit(2).alias("rank"), key_of("p", F.col("o"), F.col("p")).alias("key")),
    )
    call_refs = calls.select(F.lit("resolved_calls").alias("src_table"), "row_id", F.explode(both).alias("x"), F.col("indexed_at").alias("at"))
    call_refs = call_refs.select("src_table", "row_id", "x.field", "x.rank", "x.key", "at")
    table = lambda: key_of("t", _null_safe(norm("namespace")), filled("table_name"))
    columns = load(spark, sf_dir, "sql_statement_columns")
    column_refs = columns.select(
        F.lit("sql_statement_columns").alias("src_table"), "row_id", F.lit("table_name").alias("field"), F.lit(1).alias("rank"), table().alias("key"), F.col("indexed_at").alias("at")
    )
    std = load(spark, sf_dir, "stdlib_members")
    lives = (
        lives_of(load(spark, sf_dir, "objects"), key_of("o", filled("object")))
        .union(lives_of(load(spark, sf_dir, "procs"), key_of("p", filled("object"), filled("proc_name"))))
        .union(lives_of(load(spark, sf_dir, "catalog_columns"), table()))
        .union(always(std, key_of("o", filled("object"))))
        .union(always(std, key_of("p", filled("object"), filled("proc_name"))))
    )
    return call_refs.union(column_refs), lives
