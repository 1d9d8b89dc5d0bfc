"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is taken r = target / size of the source times, but at most
max_repeats times: floor(r) times for certain and once more with the rest as its
chance. Chances are settled in pairs: mass moves from one document to the other,
weighted by size so that the total of tokens stays as it is, until one chance is 0 or
1; which way is drawn such that each document's expectation stays as it is, so every
document is taken with just its chance. At the leaves the documents of a source have
one chance in common, and the longest is paired with all shorter ones together, which
share what moves: it is settled as long as they can make up for it, and what is left
of a part is one document, as a rule the shortest. (Paired one by one, a document of
half its source would stay open to the end and leave the source off by its length.)
What is left goes up a reduction tree, part by part, is paired one by one there, the
longest first, and the one left of a source is drawn by its chance. A source is off by
less than that document.

Draws come from a hash of seed, level and key: each level draws afresh, independently
of the order of ties, and a lost task gives the same answer when it runs again. A
source with a third of all rows is settled in as many parts as it needs, in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, filled, small

#: Documents per part at the leaves, and parts that one step of the tree combines; neither changes a document's chance.
PART, FAN_IN = 20_000, 32


def settle(chance: np.ndarray, weight: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """(chances after pairing all, place of the one that is still open or -1), largest documents first, ties as they stand.

    The sum of chance * weight stays, and each chance in expectation over luck. A
    document without weight is settled by its luck alone.
    """
    p = chance.astype(float).copy()
    free = (weight <= 0) & (p > 0) & (p < 1)
    p[free] = (luck[free] < p[free]).astype(float)
    open_ = -1
    for j in sorted(np.flatnonzero((p > 0) & (p < 1)), key=lambda j: -weight[j]):
        if open_ < 0:
            open_ = j
            continue
        i, wi, wj = open_, weight[open_], weight[j]
        up = min((1 - p[i]) * wi, p[j] * wj)  # tokens that i may gain from j
        down = min(p[i] * wi, (1 - p[j]) * wj)
        move = up if luck[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / wi, p[j] - move / wj
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        open_ = j if 0 < p[j] < 1 else i if 0 < p[i] < 1 else -1
    return p, open_


def settle_together(chance: float, weight: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """``settle`` for documents of one chance: each, the longest first, is paired with all shorter ones together.

    Those keep a chance in common, so a step is one number. A step that they can't make
    up for takes as much as they can, which settles them all and leaves the longer one
    open.
    """
    p = np.where(luck < chance, 1.0, 0.0)
    if chance in (0.0, 1.0):
        return np.full(len(weight), chance), -1
    order = np.flatnonzero(weight > 0)
    order = order[np.argsort(-weight[order], kind="stable")]
    shorter = np.cumsum(weight[order][::-1])[::-1]
    for k, j in enumerate(order):
        w, pool = weight[j], shorter[k + 1] if k + 1 < len(order) else 0.0
        up, down = min((1 - chance) * w, chance * pool), min(chance * w, (1 - chance) * pool)
        if up <= 1e-9 * w or down <= 1e-9 * w:
            p[order[k + 1 :]] = np.round(chance)
            p[j] = chance
            return p, int(j)
        move = up if luck[j] * (up + down) < down else -down
        own, chance = chance + move / w, chance - move / pool
        if 1e-9 < own < 1 - 1e-9:
            p[order[k + 1 :]] = np.round(chance)
            p[j] = own
            return p, int(j)
        p[j] = np.round(own)
        if chance < 1e-12 or chance > 1 - 1e-12:
            p[order[k + 1 :]] = np.round(chance)
            return p, -1
    return p, -1


def _settle_parts(df: DataFrame, key: str, key_type: str) -> DataFrame:
    """df with each (source, part) paired through; ``final`` is false for what goes up the tree. The only part of a source is its root."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key]).reset_index(drop=True)
        chance, weight, luck = (pdf[c].to_numpy() for c in ("chance", "weight", "luck"))
        p, open_ = settle_together(chance[0], weight, luck) if (chance == chance[0]).all() else settle(chance, weight, luck)
        final = np.ones(len(pdf), bool)
        if open_ >= 0 and pdf.parts.iloc[0] > 1:
            final[open_] = False
        elif open_ >= 0:
            p[open_] = float(pdf.last_luck.iloc[open_] < p[open_])
        return pdf.drop(columns=["luck", "last_luck"]).assign(chance=p, final=final)

    schema = f"source string, part long, parts long, `{key}` {key_type}, weight double, chance double, final boolean"
    return df.select("source", "part", "parts", key, "weight", "chance", "luck", "last_luck").groupBy("source", "part").applyInPandas(run, schema)


def _draw(seed: int, key: str) -> Column:
    """A number of [0, 1) per key and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", seed: int = 1) -> DataFrame:
    """(key, source, n_tokens, copies, target_share) of each document of a listed source.

    sized: (key, source, size); targets: (source, target_share, max_repeats), sources
    being compared in lower case and trimmed; a source listed twice keeps its first
    row by share. The total is the size of all documents of listed sources taken once.
    Documents of unlisted or NULL sources are left out; a NULL size counts as 0; a NULL
    share as 0 and NULL max_repeats as 1. Keys are unique.
    """
    key_type = dict(sized.dtypes)[key]
    listed = targets.select(filled("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
    listed = listed.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    docs = sized.select(key, filled("source").alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size)).join(listed, "source", "left_semi")
    docs = cut(docs)
    totals = docs.groupBy("source").agg(F.sum(size).alias("source_size"), F.count("*").alias("n_docs"))
    whole = totals.agg(F.sum("source_size").alias("total"))
    # One row per listed source.
    plan = listed.join(totals, "source").join(F.broadcast(whole), F.lit(True))
    ratio = F.when(F.col("source_size") > 0, F.col("target_share") * F.col("total") / F.col("source_size")).otherwise(F.lit(1.0))
    plan = plan.withColumn("ratio", F.least(F.greatest(ratio, F.lit(0.0)), F.col("max_repeats").cast("double"))).withColumn("parts", F.ceil(F.col("n_docs") / PART))
    part = F.pmod(F.xxhash64(F.lit(-seed), F.col(key)), F.col("parts"))
    rows = docs.join(small(plan), "source").select(
        key, "source", size, "target_share", F.floor("ratio").cast("long").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("chance"), F.col(size).cast("double").alias("weight"), part.alias("part"), "parts"
    )
    rows = cut(rows)
    rest, extra, level = rows, None, 0
    # As many steps as the largest source needs; one number comes to the driver.
    parts = rows.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    while True:
        drawn = rest.withColumn("luck", _draw(1000 * seed + level, key)).withColumn("last_luck", _draw(1000 * seed + 999, key))
        settled = _settle_parts(drawn, key, key_type)
        settled = cut(settled) if parts > 1 else settled
        extra = settled.where("final") if extra is None else extra.unionByName(settled.where("final"))
        if parts <= 1:
            break
        rest = settled.where("not final").withColumn("part", F.floor(F.col("part") / FAN_IN)).withColumn("parts", F.ceil(F.col("parts") / FAN_IN))
        parts, level = -(-parts // FAN_IN), level + 1
    extra = extra.select(key, F.col("chance").cast("long").alias("extra"))
    return rows.join(extra, key).select(key, "source", size, (F.col("base") + F.col("extra")).cast("int").alias("copies"), "target_share")


def shares(mixed: DataFrame, targets: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, taken_tokens, target_tokens, total, reached_share, max_copies) per listed source, absent ones with 0."""
    by = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(size).alias(size), F.sum(F.col(size) * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("max_copies"))
    total = by.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    listed = targets.select(filled("source").alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    out = listed.join(by, "source", "left").na.fill(0, ["n_docs", size, "taken_tokens", "max_copies"]).join(F.broadcast(total), F.lit(True))
    reached = F.when(F.col("total") > 0, F.col("taken_tokens") / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("target_tokens", F.col("target_share") * F.col("total")).withColumn("reached_share", reached)
