"""Things that every operator needs from the session: tables, names, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory, a parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(objects: DataFrame) -> DataFrame:
    """The objects that are reports: of the kind, or by their file's extension where the kind is NULL."""
    from lodestone.functions.scalar import language

    return objects.where(language(F.col("kind"), F.col("file")) == "datawindow")


def norm(c: Column | str) -> Column:
    """A name as it is compared: lower case, without blanks at either end. NULL stays NULL."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def filled(c: Column | str) -> Column:
    """``norm``, with an empty name as NULL."""
    return F.nullif(norm(c), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder if the session names one; a folder of our own only where none is set and all runs in one process.

    On a cluster without the setting there is no folder that all executors share, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in reliable storage, with its lineage cut.

    The copy lives in the checkpoint folder that all executors share, so a lost
    executor costs a re-read and not a recomputation of the loop so far.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept, session = df.checkpoint(eager=True), df.sparkSession
    # A checkpoint keeps its plan's estimate of size. Estimates multiply at joins, so in a loop their digits
    # would double with each round; the rows alone start without one, and adaptive execution sees real sizes.
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), session)


def cut_counting(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` with the number of rows (that meet the condition), counted in the same job."""
    seen = Observation()
    condition = F.lit(True) if condition is None else condition
    kept = cut(df.observe(seen, F.coalesce(F.count_if(condition), F.lit(0)).alias("n")))
    return kept, seen.get["n"]


def small(df: DataFrame, rows: int = 10_000, size: int = 8 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes as text, else as it is, so that the join shuffles."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
