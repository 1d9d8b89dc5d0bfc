"""What reports retrieve and write, from their sources, and the SQL that finds the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalar import language
from lodestone.session import load
from lodestone.sources.report import report_facts


def report_sources(spark: SparkSession, d: str) -> DataFrame:
    """(file, lines) of the sources that are reports by the kind of their object, or by extension where it has none."""
    kinds = load(spark, d, "objects").groupBy("file").agg(F.min(F.lower(F.trim("kind"))).alias("kind"))
    files = load(spark, d, "source_files").join(kinds, "file", "left")
    return files.where(language(F.col("kind"), F.col("file")) == "datawindow").select("file", "lines")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of all reports, with the object's name."""
    return report_facts(report_sources(spark, d)).withColumn("object", F.lower(F.regexp_extract("file", r"([^/]+)\.\w+$", 1)))


def _split(name: str) -> list:
    return [F.lower(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).alias("table_name"), F.lower(F.regexp_extract(name, r"([^.]+)$", 1)).alias("column_name")]


def retrieved_columns(spark: SparkSession, d: str) -> DataFrame:
    """(file, object, table_name, column_name) that reports retrieve, by the database names of their columns."""
    return facts(spark, d).where("tag = 'column' and value like '%.%'").select("file", "object", *_split("value")).distinct()


def footprint_arms(spark: SparkSession, d: str) -> DataFrame:
    """(file, object, arm, table_name, column_name, right_table, right_column): every column that a report touches, with how.

    arm: ``retrieve``; ``write`` for a column that its update sets; ``where`` for an
    operand of a condition, if the catalog has the column; ``join`` with both ends.
    """
    from lodestone.session import cut, norm

    rows = cut(facts(spark, d))
    none = [F.lit(None).cast("string").alias(c) for c in ("right_table", "right_column")]
    columns = rows.where("tag = 'column' and value like '%.%'")
    parts = [columns.select("file", "object", F.lit("retrieve").alias("arm"), *_split("value"), *none), columns.where("lower(other) = 'yes'").select("file", "object", F.lit("write"), *_split("value"), *none)]
    known = load(spark, d, "catalog_columns").select(norm("table_name").alias("table_name"), norm("column_name").alias("column_name")).distinct()
    operands = rows.where("tag = 'where'").select("file", "object", F.explode(F.array("name", "other")).alias("operand")).where(r"operand rlike '^[A-Za-z_][\\w.]*\\.\\w+$'")
    parts.append(operands.select("file", "object", F.lit("where"), *_split("operand"), *none).join(known, ["table_name", "column_name"], "left_semi").select("file", "object", F.lit("where"), "table_name", "column_name", *none))
    joins = rows.where("tag = 'join' and name like '%.%' and other like '%.%'")
    parts.append(joins.select("file", "object", F.lit("join"), *_split("name"), *[c.alias(n) for c, n in zip(_split("other"), ("right_table", "right_column"), strict=True)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


#: The reports' sources, and the columns that they retrieve: (file, object, table_name, column_name).
SQL = r"""
rf as (select s.file, s.lines from source_files s left join (select file, min(lower(trim(kind))) k from objects group by 1) o on o.file = s.file where s.lines is not null
  and coalesce(nullif(o.k, ''), case lower(regexp_extract(s.file, '\.(\w+)\s*$', 1)) when 'srd' then 'datawindow' else '' end) = 'datawindow'),
rc as (select distinct file, lower(regexp_extract(file, '([^/]+)\.\w+$', 1)) as object, lower(regexp_extract(r, '^(.+)\.[^.]+$', 1)) as table_name, lower(regexp_extract(r, '([^.]+)$', 1)) as column_name
  from (select file, unnest(regexp_extract_all(lines, 'dbname="([^"]+\.[^".]+)"', 1)) r from rf))
"""
