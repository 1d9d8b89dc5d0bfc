"""Sinks: relations to parquet, atomic publication, metadata, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """Each relation as parquet below a path, replacing what is there."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, relations: dict[str, DataFrame], path: str) -> None:
    """All relations at once: written beside the target and renamed over it, so readers see the old or the new set whole.

    Between the two renames there is no target for a moment; if the second fails, the old
    set is put back and what was staged is removed.
    """
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_relations(relations, staged)
    target, fs = _hadoop(spark, path)
    source, _ = _hadoop(spark, staged)
    aside, _ = _hadoop(spark, old)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        fs.delete(source, True)
        raise OSError(f"could not set aside {path}")
    done = False
    try:
        done = fs.rename(source, target)
    finally:
        if not done:
            if had:
                fs.rename(aside, target)
            fs.delete(source, True)
    if not done:
        raise OSError(f"could not publish {path}")
    fs.delete(aside, True)


def upsert(current: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of the same key."""
    return current.join(changes, key, "left_anti").unionByName(changes)


def insert_rows(df: DataFrame, path: str) -> None:
    """Rows added to a relation in bulk."""
    df.write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json) one document per row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def as_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows as text, for a console; a display, not a result."""
    head = df.limit(rows).toPandas()
    return head.to_string(index=False)


def as_html(df: DataFrame, title: str, rows: int = 500) -> str:
    """The first rows as a page; a display, not a result."""
    return f"<!doctype html><title>{title}</title>{df.limit(rows).toPandas().to_html(index=False)}"
