"""Files beside sources: listings, change detection, canned SQL, builtin stubs, JSON catalogs, JDBC, text lookup."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of script and of report sources.
SCRIPT_GLOB, REPORT_GLOB, ALL_GLOB = "*.sr[uwmfsa]", "*.srd", "*.sr*"


def walk(spark: SparkSession, path: str, glob: str = ALL_GLOB) -> DataFrame:
    """(file, size, modified, sha) of all files below a directory whose name fits; contents are hashed where they lie."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"))


def diff_state(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, status): new, changed, deleted or unchanged by hash. Both: (file, sha); an outer join, no driver state."""
    c, s = current.select("file", F.col("sha").alias("_c")), stored.select("file", F.col("sha").alias("_s"))
    status = F.when(F.col("_s").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(F.col("_c") == F.col("_s"), "unchanged").otherwise("changed")
    return c.join(s, "file", "full").select("file", status.alias("status"))


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of text files: the fallback for sources that no table holds."""
    return spark.read.text(path)


def source_lines(files: DataFrame, file: str) -> DataFrame:
    """(line, text) of one file of the table of sources."""
    lines = F.split(F.regexp_replace("lines", "\r\n", "\n"), "\n")
    return files.where(F.col("file") == file).select(F.posexplode(lines).alias("line", "text")).select((F.col("line") + 1).alias("line"), "text")


@dataclass
class CannedQuery:
    name: str
    sql: str
    description: str = ""
    params: list[tuple[str, str, str | None]] = field(default_factory=list)
    entities: dict[str, str] = field(default_factory=dict)


def canned_query(name: str, text: str) -> CannedQuery:
    """A query file: description lines, ``-- :name TYPE [default]`` parameters, ``-- @entity column kind`` tags, then SQL with $name marks."""
    out, words, body = CannedQuery(name, ""), [], []
    for line in text.splitlines():
        if m := re.match(r"--\s*:(\w+)\s+(\w+)(?:\s+(.+?))?\s*$", line):
            out.params.append((m[1], m[2].upper(), m[3]))
        elif m := re.match(r"--\s*@entity\s+(\w+)\s+(\w+)", line):
            out.entities[m[1]] = m[2]
        elif line.startswith("--") and not body:
            words.append(line.lstrip("- ").strip())
        else:
            body.append(line)
    out.description, out.sql = " ".join(words).strip(), re.sub(r"\$(\w+)", r":\1", "\n".join(body)).strip().rstrip(";")
    return out


def canned_queries(folder: str) -> dict[str, CannedQuery]:
    """All query files of a folder by name."""
    return {p.stem: canned_query(p.stem, p.read_text()) for p in sorted(Path(folder).glob("*.sql"))}


def effect_annotations(stubs: DataFrame) -> DataFrame:
    """(object, proc_name, effect) of ``// @effects a, b`` lines in stub sources (object, lines): each belongs to the next declaration."""
    lines = stubs.select("object", F.posexplode(F.split("lines", "\r?\n")).alias("n", "line"))
    from pyspark.sql import Window as W

    declared = F.nullif(F.lower(F.regexp_extract("line", r"(?i)^\s*(?:(?:public|private|protected)\s+)?(?:function\s+\S+|subroutine|event)\s+(\w+)", 1)), F.lit(""))
    later = W.partitionBy("object").orderBy("n").rowsBetween(0, W.unboundedFollowing)
    tagged = lines.withColumn("proc_name", F.first(declared, ignorenulls=True).over(later)).withColumn("tags", F.nullif(F.regexp_extract("line", r"//\s*@effects\s+(.+)$", 1), F.lit("")))
    each = tagged.where("tags is not null and proc_name is not null").select("object", "proc_name", F.explode(F.split("tags", r"\s*,\s*")).alias("effect"))
    return each.select("object", "proc_name", F.trim("effect").alias("effect")).distinct()


def json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog of builtin functions, methods or properties from JSON."""
    return spark.read.option("multiLine", True).json(path)


def run_sql(spark: SparkSession, url: str, sql: str, params: list[str], properties: dict[str, str] | None = None) -> DataFrame:
    """A statement run by another database over JDBC: each ``?`` takes the next parameter as a quoted literal, surplus ones are dropped."""
    rest = iter(params)
    bound = re.sub(r"\?", lambda m: "'" + next(rest, "").replace("'", "''") + "'", sql)
    reader = spark.read.format("jdbc").option("url", url).option("query", bound)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()


def mock_sql(tables: dict[str, DataFrame], sql: str) -> DataFrame | None:
    """The first table whose name the statement contains: a stand-in for a database in tests."""
    return next((df for name, df in tables.items() if name.lower() in sql.lower()), None)


def text_view(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a relation of any arity, all as text."""
    return df.select([F.col(c).cast("string").alias(c) for c in columns])
