"""Items that appear together: exact pair counts against a fitted null.

1. Baskets become patterns (the sorted set of items) with a multiplicity, so repeated
   baskets are counted and not expanded again.
2. Items that no reportable pair can contain are dropped before pairs are made: a pair
   of support s has s <= min(a, b), so s * n >= lift * a * b needs both a and b to be
   at most n / lift, and s >= support needs both to reach it. No pair is lost.
3. Per scope (one table here) a bipartite configuration model is fitted: item i is in
   basket j with x_i y_j / (1 + x_i y_j), such that expected frequencies of items and
   sizes of baskets are the observed ones. Items of one frequency and baskets of one
   size share a factor, so the fit runs on classes, of which there are at most the
   square root of the rows.
4. A pair's count is then Poisson-binomial; its upper tail is taken by the saddlepoint
   formula with continuity correction, which behaves alike for every number of baskets,
   and exactly for one basket or more. Pairs of equal supports are judged once.
5. Benjamini-Hochberg control over all possible pairs, on the tail's logarithm in fine
   steps, whose counts are few and give each step its q-value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.session import cut, filled, norm

#: Steps of log(1 + surprise) in which q-values are held, and rounds of the fit.
STEPS, ROUNDS = 1000, 400
#: Elements of a block of the fit, items of a slice of a basket, cases that one task judges at a time; results don't depend on them.
BLOCK, SLICE, CASES = 1_000_000, 256, 4096
_LN10 = np.log(10.0)


def _sums(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per row class r: the sum over column classes c of weight * c / (1 + r c), in blocks of bounded size."""
    step = max(BLOCK // max(len(columns), 1), 1)
    return np.concatenate([(weight * columns / (1 + np.outer(rows[i : i + step], columns))).sum(1) for i in range(0, len(rows), step)] or [np.zeros(0)])


def fit(freq: np.ndarray, n_freq: np.ndarray, sizes: np.ndarray, n_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the classes of items and baskets, to a relative change of 1e-6 or after ROUNDS; see ``fit_error``."""
    baskets, items = n_sizes.sum(), n_freq.sum()
    total = float((freq * n_freq).sum()) or 1.0
    x, y = freq / np.sqrt(total), sizes / np.sqrt(total)
    for _ in range(ROUNDS):
        old = x
        x = freq / np.maximum(_sums(x, y, n_sizes), 1e-12)
        x = np.where(freq >= baskets, 1e9, np.minimum(x, 1e9))
        y = sizes / np.maximum(_sums(y, x, n_freq), 1e-12)
        y = np.where(sizes >= items, 1e9, np.minimum(y, 1e9))
        if np.all(np.abs(x - old) <= 1e-6 * x):
            break
    return x, y


def fit_error(freq: np.ndarray, x: np.ndarray, y: np.ndarray, n_sizes: np.ndarray) -> float:
    """How far the expected frequencies of a fit are from the observed, relatively and at most."""
    return float(np.max(np.abs(x * _sums(x, y, n_sizes) / freq - 1), initial=0.0))


def _log_upper_normal(w: np.ndarray) -> np.ndarray:
    """log of the normal upper tail, by a continued fraction far out."""
    from math import erfc

    near = np.log(np.maximum([0.5 * erfc(v / np.sqrt(2)) for v in np.clip(w, -8, 8)], 1e-300))
    far = np.maximum(w, 8.0)
    tail = -0.5 * far**2 - np.log(far * np.sqrt(2 * np.pi)) + np.log1p(-1 / far**2 + 3 / far**4)
    return np.where(w > 8, tail, near)


def surprise(s: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """-log10 P(S >= s), S being a sum of m[d] trials of chance q[r, d]; one row per pair."""
    q = np.clip(q, 1e-15, 1 - 1e-12)
    at = s - 0.5
    low, high = np.full(len(s), -40.0), np.full(len(s), 40.0)
    for _ in range(60):
        t = (low + high) / 2
        e = np.exp(t)[:, None]
        over = (m * q * e / (1 - q + q * e)).sum(1) > at
        high, low = np.where(over, t, high), np.where(over, low, t)
    t = (low + high) / 2
    e = np.exp(t)[:, None]
    tilted = q * e / (1 - q + q * e)
    k = (m * np.log1p(q * np.expm1(t)[:, None])).sum(1)
    k2 = np.maximum((m * tilted * (1 - tilted)).sum(1), 1e-300)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * at - k), 0))
    u = 2 * np.sinh(t / 2) * np.sqrt(k2)
    mean, sd = (m * q).sum(1), np.sqrt(np.maximum((m * q * (1 - q)).sum(1), 1e-300))
    log_tail = _log_upper_normal(w)
    with np.errstate(all="ignore"):
        density = -0.5 * w**2 - 0.5 * np.log(2 * np.pi)
        correction = (1 / u - 1 / w) * np.exp(density - log_tail)
        log_p = log_tail + np.log1p(np.maximum(correction, -1 + 1e-12))
    central = (np.abs(w) < 1e-3) | ~np.isfinite(log_p)
    log_p = np.where(central, _log_upper_normal((at - mean) / sd), log_p)
    # One event or more has an exact tail.
    none = (m * np.log1p(-q)).sum(1)
    log_p = np.where(s <= 1, np.where(s < 1, 0.0, np.log(np.maximum(-np.expm1(none), 1e-300))), log_p)
    return np.maximum(-log_p / _LN10, 0.0)


def _fits(patterns: DataFrame, items: DataFrame) -> DataFrame:
    """Per scope: x of each frequency class; number and y of each class of baskets."""
    sizes = patterns.groupBy("_scope", F.size("items").cast("double").alias("value")).agg(F.sum("n").cast("double").alias("count")).withColumn("side", F.lit("basket"))
    freq = items.groupBy("_scope", F.col("support").cast("double").alias("value")).agg(F.count("*").cast("double").alias("count")).withColumn("side", F.lit("item"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "value"])
        b, i = pdf[pdf.side == "basket"], pdf[pdf.side == "item"]
        x, y = fit(i.value.to_numpy(), i["count"].to_numpy(), b.value.to_numpy(), b["count"].to_numpy())
        return pd.DataFrame({"_scope": [pdf["_scope"].iloc[0]], "freq": [i.value.to_numpy()], "x": [x], "m": [b["count"].to_numpy()], "y": [y], "fit_error": [fit_error(i.value.to_numpy(), x, y, b["count"].to_numpy())]})

    return sizes.unionByName(freq).groupBy("_scope").applyInPandas(run, "_scope string, freq array<double>, x array<double>, m array<double>, y array<double>, fit_error double")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per case of (scope, support_a, support_b, support): what the model expects, and the surprise. A row holds the cases of one scope with its model once."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            freq, x, y, m = (np.asarray(v, float) for v in (row.freq, row.x, row.y, row.m))
            a, b, s = (np.array([c[k] for c in row.cases], "int64") for k in ("support_a", "support_b", "support"))
            step = max(BLOCK // max(len(y), 1), 1)
            for i in range(0, len(s), step):
                xa, xb = (x[np.searchsorted(freq, v[i : i + step])] for v in (a, b))
                q = np.multiply(*(np.outer(v, y) / (1 + np.outer(v, y)) for v in (xa, xb)))
                part = {"_scope": row.scope, "support_a": a[i : i + step], "support_b": b[i : i + step], "support": s[i : i + step]}
                yield pd.DataFrame(part | {"expected": (q * m).sum(1), "surprise": surprise(s[i : i + step].astype(float), q, m), "fit_error": row.fit_error})


def co_occurrence(df: DataFrame, basket: Sequence[str], scope: Sequence[str], item: str, min_support: int = 1, min_lift: float = 0.0, q_values: bool = True) -> DataFrame:
    """Pairs of items that stand together in at least ``min_support`` baskets and ``min_lift`` times as often as chance.

    A basket is a value of (basket, scope); NULLs in these columns are values of their
    own. Rows with a NULL item are left out, repeated rows count once. Result per pair:
    scope, item_a < item_b, support, support_a, support_b, n (baskets of the scope),
    lift (support * n / (support_a * support_b)), expected (under the null), surprise
    (-log10 of the tail), fit_error (of the scope's null, relative), q_value. An empty
    table gives an empty result.
    A q-value is that of a pair among all pairs, so with it the bounds hold the result
    only; without it they drop items and pairs as early as they can.
    """
    if q_values:
        every = _co_occurrence(df, basket, scope, item, 1, 0.0, True)
        return every.where((F.col("support") >= min_support) & (F.col("support") * F.col("n") >= min_lift * F.col("support_a") * F.col("support_b")))
    return _co_occurrence(df, basket, scope, item, min_support, min_lift, False)


def _co_occurrence(df: DataFrame, basket: Sequence[str], scope: Sequence[str], item: str, min_support: int, min_lift: float, q_values: bool) -> DataFrame:
    # One key without NULLs for joins; the scope's own columns go along on the left side.
    code = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in scope])
    keys, bare = ["_scope", *scope], lambda t: t.drop(*scope)
    rows = df.where(F.col(item).isNotNull()).withColumn("_scope", code)
    baskets = rows.groupBy(*basket, *keys).agg(F.sort_array(F.collect_set(item)).alias("items"))
    patterns = cut(baskets.groupBy(*keys, "items").agg(F.count("*").alias("n")))
    items = cut(patterns.select(*keys, F.explode("items").alias("item"), "n").groupBy(*keys, "item").agg(F.sum("n").alias("support")))
    total = patterns.groupBy("_scope").agg(F.sum("n").alias("n_scope"))
    kept = bare(items).join(total, "_scope").where((F.col("support") >= min_support) & (F.col("support") * min_lift <= F.col("n_scope"))).drop("n_scope")
    long = patterns.withColumn("_pattern", F.monotonically_increasing_id()).select("_pattern", *keys, "n", F.explode("items").alias("item")).join(kept, ["_scope", "item"])
    smaller = long.groupBy("_pattern", *keys, "n").agg(F.sort_array(F.collect_list(F.struct("item", "support"))).alias("items")).where(F.size("items") > 1)
    smaller = smaller.groupBy(*keys, "items").agg(F.sum("n").alias("n"))
    # Slices of a basket against each other: a row makes at most SLICE * SLICE pairs, so the longest basket is spread over tasks.
    slices = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / SLICE).cast("int"))
    part = lambda c: F.slice("items", F.col(c) * SLICE + 1, F.lit(SLICE))
    first = smaller.withColumn("_i", F.explode(slices)).withColumn("_j", F.explode(F.sequence("_i", F.floor((F.size("items") - 1) / SLICE).cast("int"))))
    first = first.select(*keys, "n", part("_i").alias("left"), part("_j").alias("right")).repartition(*keys, F.xxhash64("left", "right"))
    pairs = first.select(*keys, "n", "right", F.explode("left").alias("a")).select(*keys, "n", "a", F.explode("right").alias("b")).where("a.item < b.item")
    pairs = pairs.groupBy(*keys, "a", "b").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
    pairs = pairs.select(*keys, F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), "support", F.col("a.support").alias("support_a"), F.col("b.support").alias("support_b"))
    pairs = pairs.join(total.withColumnRenamed("n_scope", "n"), "_scope").where(F.col("support") * F.col("n") >= min_lift * F.col("support_a") * F.col("support_b"))
    pairs = cut(pairs)
    present = pairs.select("_scope").distinct()
    model = cut(_fits(bare(patterns).join(present, "_scope", "left_semi"), bare(items).join(present, "_scope", "left_semi")))
    # Pairs of the same supports are one case; a model goes to the cases, some at a time, not to the pairs.
    case = ["support_a", "support_b", "support"]
    cases = pairs.select("_scope", *case).distinct()
    lots = cases.groupBy("_scope").agg(F.ceil(F.count("*") / CASES).alias("_lots"))
    cases = cases.join(lots, "_scope").groupBy("_scope", F.pmod(F.xxhash64(*case), F.col("_lots")).alias("_lot")).agg(F.collect_list(F.struct(*case)).alias("cases"))
    cases = cases.join(model, "_scope").select(F.col("_scope").alias("scope"), "cases", "freq", "x", "m", "y", "fit_error")
    kinds = "_scope string, support_a long, support_b long, support long, expected double, surprise double, fit_error double"
    judged = pairs.join(cases.mapInPandas(_judge, kinds), ["_scope", *case])
    lift = F.col("support") * F.col("n") / (F.col("support_a") * F.col("support_b"))
    if not q_values:
        return judged.drop("_scope").withColumn("lift", lift)
    judged = cut(judged)
    judged = judged.withColumn("_step", F.floor(F.lit(STEPS) * F.log1p("surprise")))
    possible = items.groupBy("_scope").agg((F.count("*") * (F.count("*") - 1) / 2).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("tests"))
    counts = judged.groupBy("_step").agg(F.count("*").alias("c"))
    # Few rows: one per step of the logarithm, whatever the number of pairs.
    upward, downward = W.orderBy(F.desc("_step")), W.orderBy("_step").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("c").over(upward)).join(F.broadcast(possible), F.lit(True))
    level = F.pow(F.lit(10.0), -F.expm1(F.col("_step") / STEPS)) * F.col("tests") / F.col("rank")
    steps = ranked.withColumn("q", level).select(F.col("_step").alias("_s"), F.least(F.lit(1.0), F.min("q").over(downward)).alias("q_value"))
    return judged.join(steps, F.col("_step") == F.col("_s")).drop("_step", "_s", "_scope").withColumn("lift", lift)


def co_updates(columns: DataFrame, min_support: int = 5, min_lift: float = 2.0, q_values: bool = True) -> DataFrame:
    """The pairs of columns of one table that statements write together, as CoUpdateRitual with its surprise.

    columns: rows of sql_statement_columns. Rows with is_write true count; a statement
    is (file, object, proc_name, line), names being compared in lower case and trimmed.
    """
    writes = columns.where("is_write").select(
        "file", norm("object").alias("object"), norm("proc_name").alias("proc_name"), "line", norm("namespace").alias("namespace"), filled("table_name").alias("table_name"), filled("column_name").alias("column_name")
    )
    found = co_occurrence(writes.where("table_name is not null"), ["file", "object", "proc_name", "line"], ["namespace", "table_name"], "column_name", min_support, min_lift, q_values)
    name = lambda c: F.concat_ws(".", "namespace", "table_name", c)
    kept = ["support_a", "support_b", "n", "lift", "expected", "surprise", "fit_error", *(["q_value"] if q_values else [])]
    return found.select(name("item_a").alias("column_a"), name("item_b").alias("column_b"), F.col("support").cast("int").alias("co_write_support"), *kept)
