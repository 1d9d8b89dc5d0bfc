"""Queries of problems 4 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.oracle import ORACLE
from lodestone.session import load

# The operators are imported where they run: a driver that runs other queries is spared numpy, pandas and pyarrow.


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of columns that statements write together at least 5 times and twice as often as chance."""
    from lodestone.llm import pairs

    return pairs.co_updates(load(spark, d, "sql_statement_columns"), q_values=False).select("column_a", "column_b", "co_write_support")


def p4_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its support, lift, expectation under the null, surprise and q-value."""
    from lodestone.llm import pairs

    return pairs.co_updates(load(spark, d, "sql_statement_columns"), 1, 0.0)


def p4_support(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its supports."""
    from lodestone.llm import pairs

    every = pairs.co_updates(load(spark, d, "sql_statement_columns"), 1, 0.0, q_values=False)
    return every.select("column_a", "column_b", "co_write_support", "support_a", "support_b", "n")


def p4_significant(spark: SparkSession, d: str) -> DataFrame:
    """The pairs whose support is beyond the null at a false-discovery rate of 1 in 20, with what the null expects."""
    from lodestone.llm import pairs

    every = pairs.co_updates(load(spark, d, "sql_statement_columns"), 1, 0.0)
    return every.where("q_value <= 0.05").select("column_a", "column_b", "co_write_support", "expected", "surprise", "q_value")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm import syntax

    return syntax.check_files(syntax.with_language(load(spark, d, "source_files"), load(spark, d, "objects").select("file", "kind")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that are not valid in their language."""
    return _checked(spark, d).where("not valid").select("file")


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """The files that are not valid, with the first error of each."""
    return _checked(spark, d).where("not valid").drop("valid")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of files that are not valid per repository and kind."""
    from lodestone.llm import syntax

    return syntax.rates(_checked(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's ids of byte_bpe_50k."""
    from lodestone.llm import tokenize

    return tokenize.encode_texts(load(spark, d, "documents").select("doc_id", "text"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents the encoding keeps exactly, with their tokens and bytes."""
    from lodestone.llm import tokenize

    checked = tokenize.roundtrip(load(spark, d, "documents").select("doc_id", "text"))
    return checked.groupBy("exact").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lodestone.llm import mixing, tokenize

    targets = load(spark, d, "mix_targets")
    sized = tokenize.encode_texts(load(spark, d, "documents").select("doc_id", "source", "text"), ids="n_tokens", count_only=True)
    return mixing.mix(sized, targets), targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Each document of a listed source with how often it is taken."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each listed source reaches."""
    from lodestone.llm import mixing

    return mixing.shares(*_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with residue where their own content should stand."""
    from lodestone.llm import residue

    return residue.residue(load(spark, d, "documents").select("doc_id", "text")).select("doc_id").distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue."""
    from lodestone.llm import residue

    documents = load(spark, d, "documents")
    found = residue.residue(documents.select("doc_id", "text")).select("doc_id").distinct()
    return documents.select("doc_id", "source", "lang", "n_chars").join(found, "doc_id", "left_anti")


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates of the residue with their numbers of documents."""
    from lodestone.llm import residue

    return residue.templates(residue.residue(load(spark, d, "documents").select("doc_id", "text")))


_ALL = (p4_found, p4_surprise, p4_support, p4_significant, p5_found, p5_errors, p5_rates, p6_ids, p6_roundtrip, p7_mix, p7_shares, p8_found, p8_kept, p8_templates)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLE", "QUERIES"]
