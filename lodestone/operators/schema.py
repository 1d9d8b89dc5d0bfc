"""Schema analytics: co-update rituals, foreign keys, column usage, footprints, affinity and decomposition."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd


def rituals(writes: DataFrame, min_support: int = 2) -> DataFrame:
    """(column_a, column_b, co_write_support, n_violations) of columns that at least so many statements write together.

    writes: (stmt, col). A violation is a statement that writes one column of the pair
    alone. Statements with the same columns are counted once with their number, so only
    distinct sets are expanded. NULLs are left out; repeated rows count once.
    """
    rows = writes.where("stmt is not null and col is not null")
    sets = rows.groupBy("stmt").agg(F.array_sort(F.collect_set("col")).alias("cols")).groupBy("cols").agg(F.count("*").alias("n"))
    alone = sets.select(F.explode("cols").alias("col"), "n").groupBy("col").agg(F.sum("n").alias("k"))
    first = sets.where(F.size("cols") > 1).select("n", "cols", F.posexplode("cols").alias("at", "column_a"))
    pairs = first.select("n", "column_a", F.explode(F.slice("cols", F.col("at") + 2, F.size("cols"))).alias("column_b"))
    pairs = pairs.groupBy("column_a", "column_b").agg(F.sum("n").alias("co_write_support")).where(F.col("co_write_support") >= min_support)
    pairs = pairs.join(alone.select(F.col("col").alias("column_a"), F.col("k").alias("ka")), "column_a").join(alone.select(F.col("col").alias("column_b"), F.col("k").alias("kb")), "column_b")
    return pairs.select("column_a", "column_b", "co_write_support", (F.col("ka") + F.col("kb") - 2 * F.col("co_write_support")).alias("n_violations"))


def ritual_violations(writes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(column_a, column_b, stmt, written_column): each statement that writes one column of a ritual alone."""
    rows = writes.where("stmt is not null and col is not null").select("stmt", "col").distinct()
    sides = []
    for own, other in (("column_a", "column_b"), ("column_b", "column_a")):
        one = pairs.select("column_a", "column_b").join(rows.withColumnRenamed("col", own), own)
        alone = one.join(rows.withColumnRenamed("col", other), ["stmt", other], "left_anti")
        sides.append(alone.select("column_a", "column_b", "stmt", F.col(own).alias("written_column")))
    return sides[0].union(sides[1])


def fk_graph(declared: DataFrame, joined: DataFrame) -> DataFrame:
    """(x, y, status): directed join edges ``corroborated`` by a declared key in either direction or ``unenforced``, declared ones ``unused`` by any join."""
    d, j = (t.where("x is not null and y is not null").select("x", "y").distinct() for t in (declared, joined))
    either = lambda t: t.union(t.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    known = either(d).withColumn("_known", F.lit(True))
    joins = j.join(known, ["x", "y"], "left").select("x", "y", F.when(F.col("_known"), "corroborated").otherwise("unenforced").alias("status"))
    return joins.union(d.join(either(j), ["x", "y"], "left_anti").withColumn("status", F.lit("unused")))


def column_usage(catalog: DataFrame, written: DataFrame, read: DataFrame) -> DataFrame:
    """(namespace, table_name, column_name, usage) of each catalog column: dead, write_only, read_only or read_write; NULL namespaces are equal."""
    key = ["namespace", "table_name", "column_name"]
    out = catalog.select(*key).distinct()
    for name, touched in (("w", written), ("r", read)):
        t = touched.select(*[F.col(c).alias(f"{name}_{c}") for c in key]).distinct()
        same = F.col("namespace").eqNullSafe(F.col(f"{name}_namespace")) & (F.col("table_name") == F.col(f"{name}_table_name")) & (F.col("column_name") == F.col(f"{name}_column_name"))
        out = out.join(t, same, "left")
    w, r = F.col("w_table_name").isNotNull(), F.col("r_table_name").isNotNull()
    usage = F.when(w & r, "read_write").when(w, "write_only").when(r, "read_only").otherwise("dead")
    return out.select(*key, usage.alias("usage"))


def footprint(legs: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt, column, kind) legs of the given statements at either end; the OR of ends is two equi joins.

    legs: (src, dst, kind); statements: (stmt).
    """
    stmts = statements.select("stmt").distinct()
    out = legs.join(stmts, F.col("src") == F.col("stmt")).select("stmt", F.col("dst").alias("column"), "kind")
    into = legs.where("src <> dst").join(stmts, F.col("dst") == F.col("stmt")).select("stmt", F.col("src").alias("column"), "kind")
    return out.union(into)


def affinity_pairs(touches: DataFrame) -> DataFrame:
    """(scope, col_a, col_b, both, jaccard): how many statements touch both columns of a pair, with their Jaccard similarity.

    touches: (scope, col, stmt); col_a < col_b; pairs that never meet are left out.
    """
    sets = touches.where("col is not null").groupBy("scope", "stmt").agg(F.array_sort(F.collect_set("col")).alias("cols")).groupBy("scope", "cols").agg(F.count("*").alias("n"))
    alone = sets.select("scope", F.explode("cols").alias("col"), "n").groupBy("scope", "col").agg(F.sum("n").alias("k"))
    first = sets.where(F.size("cols") > 1).select("scope", "n", "cols", F.posexplode("cols").alias("at", "col_a"))
    pairs = first.select("scope", "n", "col_a", F.explode(F.slice("cols", F.col("at") + 2, F.size("cols"))).alias("col_b")).groupBy("scope", "col_a", "col_b").agg(F.sum("n").alias("both"))
    a = alone.select("scope", F.col("col").alias("col_a"), F.col("k").alias("ka"))
    b = alone.select("scope", F.col("col").alias("col_b"), F.col("k").alias("kb"))
    joined = pairs.join(a, ["scope", "col_a"]).join(b, ["scope", "col_b"])
    return joined.select("scope", "col_a", "col_b", "both", (F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))).alias("jaccard"))


def merges(columns: list[str], similarity: dict[tuple[str, str], float]) -> list[tuple[float, list[str]]]:
    """The merges of average-linkage clustering in order: (similarity, members). Ties go to the greater pair of names."""
    total = {(a, b): similarity.get((min(a, b), max(a, b)), 0.0) for a in columns for b in columns if a != b}
    members, active, out = {c: [c] for c in columns}, sorted(columns), []
    while len(active) > 1:
        best = max((total[(a, b)] / (len(members[a]) * len(members[b])), a, b) for i, a in enumerate(active) for b in active[i + 1 :])
        sim, a, b = best
        new = f"__cluster{len(out)}__"
        members[new] = members[a] + members[b]
        active = [c for c in active if c not in (a, b)]
        for c in active:
            total[(c, new)] = total[(new, c)] = total[(c, a)] + total[(c, b)]
        active.append(new)
        out.append((sim, members[new]))
    return out


def clusters(touches: DataFrame) -> DataFrame:
    """(scope, step, similarity, members): the merges of each scope's columns, in order.

    Pair similarities come from ``affinity_pairs``; one task clusters the columns of one
    table, of which there are as many as the table has, whatever the statements.
    """
    pairs = affinity_pairs(touches)
    single = touches.where("col is not null").select("scope", F.col("col").alias("col_a"), F.lit(None).cast("string").alias("col_b"), F.lit(0.0).alias("jaccard")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        known = pdf[pdf.col_b.notna()]
        similarity = {(a, b): s for a, b, s in zip(known.col_a, known.col_b, known.jaccard, strict=True)}
        steps = merges(sorted(pdf.col_a[pdf.col_b.isna()]), similarity)
        rows = [(pdf["scope"].iloc[0], i, s, sorted(m)) for i, (s, m) in enumerate(steps)]
        return pd.DataFrame(rows, columns=["scope", "step", "similarity", "members"])

    rows = pairs.select("scope", "col_a", "col_b", "jaccard").unionByName(single)
    return rows.groupBy("scope").applyInPandas(run, "scope string, step int, similarity double, members array<string>")


def blocks_of(touches: DataFrame, min_similarity: float = 0.7) -> DataFrame:
    """The clusters of two columns and more that are at least so similar."""
    return clusters(touches).where((F.col("similarity") >= min_similarity) & (F.size("members") >= 2))


def candidates(touches: DataFrame, writes: DataFrame, unenforced: DataFrame, reached: DataFrame, min_similarity: float = 0.7, blocks: DataFrame | None = None) -> DataFrame:
    """(scope, members, similarity, ritual_support, unenforced_fk, coslice_size, score): blocks of columns that might be split off a table.

    writes: (scope, stmt, col); unenforced: (scope, col, edge); reached: (scope, col,
    stmt), the statements that a column's coslice reaches. score is (support + keys) /
    size, NULL if nothing is reached. blocks: the result of ``blocks``, if it is at hand.
    """
    blocks = blocks_of(touches, min_similarity) if blocks is None else blocks
    each = blocks.select("scope", "step", F.explode("members").alias("col"))
    pairs = affinity_pairs(writes)
    inside = each.withColumnRenamed("col", "col_a").join(each.withColumnRenamed("col", "col_b"), ["scope", "step"]).where("col_a < col_b").join(pairs, ["scope", "col_a", "col_b"])
    support = inside.groupBy("scope", "step").agg(F.sum("both").alias("ritual_support"))
    keys = each.join(unenforced, ["scope", "col"]).groupBy("scope", "step").agg(F.count_distinct("edge").alias("unenforced_fk"))
    sizes = each.join(reached, ["scope", "col"]).groupBy("scope", "step").agg(F.count_distinct("stmt").alias("coslice_size"))
    out = blocks
    for part in (support, keys, sizes):
        out = out.join(part, ["scope", "step"], "left")
    out = out.na.fill(0, ["ritual_support", "unenforced_fk", "coslice_size"])
    score = F.when(F.col("coslice_size") > 0, (F.col("ritual_support") + F.col("unenforced_fk")) / F.col("coslice_size"))
    return out.select("scope", "members", "similarity", "ritual_support", "unenforced_fk", "coslice_size", score.alias("score"))


def resolve_namespace(refs: DataFrame, catalog: DataFrame, default: str | None) -> DataFrame:
    """refs with unqualified tables in the default namespace if the catalog has them there; never guessed otherwise."""
    known = catalog.where(F.col("namespace") == default).select(F.col("table_name")).distinct().withColumn("_known", F.lit(True))
    joined = refs.join(known, "table_name", "left")
    return joined.withColumn("namespace", F.when(F.col("namespace").isNull() & F.col("_known"), F.lit(default)).otherwise(F.col("namespace"))).drop("_known")


def bare_name(catalog: DataFrame) -> DataFrame:
    """(table_name, namespace, n_namespaces): a bare table name's namespace if exactly one schema has it, else NULL."""
    spaces = catalog.select("table_name", F.coalesce("namespace", F.lit("")).alias("ns")).distinct().groupBy("table_name")
    return spaces.agg(F.count("*").alias("n_namespaces"), F.min("ns").alias("_ns")).select("table_name", F.when(F.col("n_namespaces") == 1, F.nullif("_ns", F.lit(""))).alias("namespace"), "n_namespaces")


def schema_objects(legs: DataFrame, catalog_columns: DataFrame) -> DataFrame:
    """(object_key, kind): every end of a leg and every catalog column, once."""
    kind = lambda c: F.when(c.startswith("col:"), "column").when(c.startswith("stmt:dw"), "dw_retrieve").otherwise("stmt")
    ends = legs.select(F.col("src").alias("object_key")).union(legs.select("dst")).union(catalog_columns.select("object_key"))
    return ends.where("object_key is not null").distinct().withColumn("kind", kind(F.col("object_key")))


def scope_key(*parts: Column) -> Column:
    """One text for a scope of several columns, NULL being a value of its own."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])


def newest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key that is last by an order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(order.desc_nulls_last()))).where("_k = 1").drop("_k")
