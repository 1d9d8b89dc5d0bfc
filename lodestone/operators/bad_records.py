"""Rows that fail to parse: delimited records loaded as text, typed, or set aside with the reason.

Every field is first loaded as nullable text, then cast and constraint rules give
an array of errors per row; rows with an empty array are the valid ones. All of it
is column expressions, so the scan stays in the JVM and nothing is shuffled.

Telling fields apart uses no backtracking expression: the text is cut at its quote
characters, so odd pieces lie inside quotes and even ones outside. The outside
pieces alone decide whether the quoting holds, in time linear in the text, however
long it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX = 2147483647


@dataclass(frozen=True)
class FieldRule:
    """A field of the record: its name, its kind and the rule it must meet.

    kind: ``int`` (ASCII digits, 0 to 2147483647), ``text``, ``bool``, ``time``
    (``YYYY-MM-DD HH:MM:SS``) or ``enum`` with ``values``.
    """

    name: str
    kind: str
    required: bool = True
    values: tuple[str, ...] = ()


#: The record DdlStats: fixed names and values of the format.
DDL_STATS: tuple[FieldRule, ...] = (
    FieldRule("run_id", "int"),
    FieldRule("ddl_file", "text"),
    FieldRule("dialect", "enum", values=("mysql", "oracle", "postgres", "tsql", "sqlite")),
    FieldRule("statements_total", "int"),
    FieldRule("statements_parsed", "int", required=False),
    FieldRule("statements_skipped", "int"),
    FieldRule("skipped_previews", "text", required=False),
    FieldRule("dewrapped", "bool"),
    FieldRule("finished_at", "time"),
)


def with_fields(df: DataFrame, line: str) -> DataFrame:
    """``df`` with ``_quoted_ok`` (the quoting holds) and ``_fields`` (array of raw fields).

    A NULL line counts as an empty one: a single empty field.
    """
    raw = F.coalesce(F.col(line), F.lit(""))
    raw = F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    # A backslash escape keeps the text's own commas and quotes apart from the separators.
    pieces = F.split(F.replace(raw, F.lit("\\"), F.lit("\\0")), F.lit('"'), -1)
    df = df.withColumn("_pieces", pieces)
    last = F.size("_pieces") - 1

    def outside_fails(x: Column, i: Column) -> Column:
        return (i % 2 == 0) & (x != "") & (((i > 0) & ~x.startswith(",")) | ((i < last) & ~x.endswith(",")))

    fails = F.exists(F.zip_with("_pieces", F.sequence(F.lit(0), last), lambda x, i: outside_fails(x, i)), lambda b: b)
    joined = F.array_join(
        F.transform(
            "_pieces",
            lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit("\\1")))
            .when((i > 0) & (i < last) & (x == ""), F.lit("\\2"))
            .otherwise(x),
        ),
        "",
    )
    fields = F.transform(
        F.split(joined, F.lit(","), -1),
        lambda x: F.replace(F.replace(F.replace(x, F.lit("\\1"), F.lit(",")), F.lit("\\2"), F.lit('"')), F.lit("\\0"), F.lit("\\")),
    )
    # The generator is a barrier: the checks below read the fields and don't compute them again each.
    parsed = F.inline(F.array(F.struct(((last % 2 == 0) & ~fails).alias("_quoted_ok"), fields.alias("_fields"))))
    return df.select("*", parsed).drop("_pieces")


def _valid(rule: FieldRule, value: Column) -> Column:
    if rule.kind == "int":
        digits = F.regexp_replace(value, "^0+(?=[0-9])", "")
        ok = value.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 10) & (F.substring(digits, 1, 10).try_cast("long") <= INT_MAX)
    elif rule.kind == "enum":
        ok = value.isin(*rule.values)
    elif rule.kind == "bool":
        ok = F.lower(value).isin("true", "false")
    elif rule.kind == "time":
        ok = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z") & value.try_cast("timestamp_ntz").isNotNull() & ~value.startswith("0000")
    else:
        ok = F.lit(True)
    ok = F.coalesce(ok, F.lit(False))
    return (ok & (value != "")) if rule.required else (ok | (value == ""))


def _typed(rule: FieldRule, value: Column) -> Column:
    if rule.kind == "int":
        return value.try_cast("int")
    if rule.kind == "bool":
        return F.lower(value) == "true"
    if rule.kind == "time":
        return value.try_cast("timestamp_ntz")
    return value


def parse_records(df: DataFrame, line: str = "raw_line", rules: Sequence[FieldRule] = DDL_STATS) -> DataFrame:
    """Each row of ``df`` with its record typed in the column ``record`` and ``errors``, ``reason``.

    reason is NULL for a valid record, else ``quoting`` if the fields can't be told
    apart, ``columns`` if they aren't as many as the rules, ``value`` if a rule fails;
    ``errors`` names each failed rule. ``record`` is NULL unless the row is valid.
    A NULL or empty line is one empty field, hence ``columns``. Repeated lines are
    judged one by one; an empty table gives an empty result. The result columns
    replace columns of ``df`` of the same names.
    """
    df = df.drop("record", "errors", "reason")
    df = with_fields(df, line)
    values = [F.trim(F.get("_fields", F.lit(i))) for i in range(len(rules))]
    checks = [F.when(~_valid(r, v), F.lit(f"{r.name}: not a valid {r.kind}")) for r, v in zip(rules, values, strict=True)]
    value_errors = F.array_compact(F.array(*checks))
    n = F.size("_fields")
    errors = (
        F.when(~F.col("_quoted_ok"), F.array(F.lit("quoting: fields can't be told apart")))
        .when(n != len(rules), F.array(F.concat(F.lit("columns: "), n.cast("string"))))
        .otherwise(value_errors)
    )
    df = df.withColumn("errors", errors)
    reason = F.when(~F.col("_quoted_ok"), "quoting").when(n != len(rules), "columns").when(F.size("errors") > 0, "value")
    record = F.when(F.size("errors") == 0, F.struct(*[_typed(r, v).alias(r.name) for r, v in zip(rules, values, strict=True)]))
    return df.withColumn("reason", reason).withColumn("record", record).drop("_fields", "_quoted_ok")


def split_valid(df: DataFrame, line: str = "raw_line", rules: Sequence[FieldRule] = DDL_STATS) -> tuple[DataFrame, DataFrame]:
    """(valid rows with typed fields as columns, set-aside rows with ``errors`` and ``reason``).

    A typed field whose name ``df`` already has takes that column's place.
    """
    parsed = parse_records(df, line, rules)
    names = {r.name for r in rules}
    keep = [c for c in df.columns if c not in names | {"record", "errors", "reason"}]
    valid = parsed.where(F.size("errors") == 0).select(*keep, *[F.col(f"record.{r.name}").alias(r.name) for r in rules])
    return valid, parsed.where(F.size("errors") > 0).drop("record")
