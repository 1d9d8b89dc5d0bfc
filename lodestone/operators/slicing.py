"""Program slices: as sets by the fixpoint, and as capped walks in depth-first order."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import fixpoint

if TYPE_CHECKING:
    import pandas as pd

#: Steps after which a walk ends, as in the reference; sets have no such end.
MAX_STEPS = 50
_POINT = ("object", "proc", "line", "var")


def latest_def(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Each use with the line of the latest definition of its variable at or before it.

    An as-of join without a range join: definitions and uses of a (procedure, variable)
    are merged in the order of their lines and the last definition is carried forward.
    """
    d = defs.select("object", "proc", "var", "line", F.lit(0).alias("_side"))
    u = uses.select("object", "proc", "var", "line", F.lit(1).alias("_side"))
    so_far = W.partitionBy("object", "proc", "var").orderBy("line", "_side").rowsBetween(W.unboundedPreceding, 0)
    merged = d.union(u).where("line is not null").withColumn("def_line", F.last(F.when(F.col("_side") == 0, F.col("line")), ignorenulls=True).over(so_far))
    return merged.where("_side = 1").drop("_side").distinct()


def _point(object_: str, proc: str, line, var: str):
    return F.struct(F.col(object_).alias("object"), F.col(proc).alias("proc"), (F.col(line) if isinstance(line, str) else line).alias("line"), F.col(var).alias("var"))


def backward_edges(defs: DataFrame, uses: DataFrame, inter: DataFrame) -> DataFrame:
    """(src, dst) between points (object, proc, line, var), against the flow: use -> its latest definition -> what that line uses; parameter -> caller's argument."""
    found = latest_def(defs, uses).where("def_line is not null")
    to_def = found.select(_point("object", "proc", "line", "var").alias("src"), _point("object", "proc", "def_line", "var").alias("dst"))
    line = defs.select("object", "proc", "line", "var").join(uses.select("object", "proc", "line", F.col("var").alias("used")), ["object", "proc", "line"]).where("var <> used")
    to_used = line.select(_point("object", "proc", "line", "var").alias("src"), _point("object", "proc", "line", "used").alias("dst"))
    params = defs.where("kind = 'param'").select(F.col("object").alias("callee_object"), F.col("proc").alias("callee_proc"), F.col("var").alias("callee_var"), "line")
    passed = inter.where("edge_kind = 'arg'").join(params, ["callee_object", "callee_proc", "callee_var"])
    to_caller = passed.select(_point("callee_object", "callee_proc", "line", "callee_var").alias("src"), _point("caller_object", "caller_proc", "caller_line", "caller_var").alias("dst"))
    return to_def.union(to_used).union(to_caller).where("src <> dst").distinct()


def slice_sets(edges: DataFrame, origins: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(origin, point, hops): the slice of each origin point, whole. For a forward slice swap the edges' ends."""
    return fixpoint.reach(edges, origins.select(F.col("point").alias("seed")), max_rounds=max_rounds).select(F.col("seed").alias("origin"), F.col("node").alias("point"), "hops")


def walk(origin: tuple, after: dict[tuple, list[tuple]], max_steps: int = MAX_STEPS) -> list[tuple]:
    """The points in the order of a depth-first walk, ended after so many."""
    out, seen, stack = [], set(), [origin]
    while stack and len(out) < max_steps:
        at = stack.pop()
        if at in seen:
            continue
        seen.add(at)
        out.append(at)
        stack.extend(reversed(after.get(at, [])))
    return out


def slice_walks(edges: DataFrame, origins: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """(origin, step, object, proc, line, var): capped walks, ``step`` counting from the far end as the reference does.

    Each origin's neighbourhood is cut out by the fixpoint first (no further than
    max_steps edges), so a task holds the edges of one slice only.
    """
    near = slice_sets(edges, origins, max_steps)
    inside = near.join(edges, F.col("point") == F.col("src")).select(F.to_json("origin").alias("origin"), "src", "dst")
    alone = near.where("hops = 0").select(F.to_json("origin").alias("origin"), F.col("point").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        point = lambda p: None if p is None else (p["object"], p["proc"], p["line"], p["var"])
        after: dict[tuple, list[tuple]] = {}
        start = None
        for s, t in zip(map(point, pdf.src), map(point, pdf.dst), strict=True):
            if t is None:
                start = s
            else:
                after.setdefault(s, []).append(t)
        for targets in after.values():
            targets.sort(key=str)
        rows = walk(start, after, max_steps)[::-1]
        return pd.DataFrame([(pdf.origin.iloc[0], i, *r) for i, r in enumerate(rows)], columns=["origin", "step", *_POINT])

    return inside.union(alone).groupBy("origin").applyInPandas(run, "origin string, step int, object string, proc string, line int, var string")


def neighbourhood(inter: DataFrame, procs: DataFrame) -> DataFrame:
    """(object, proc, near_object, near_proc): each procedure with those one call edge away and itself."""
    there = inter.select(F.col("caller_object").alias("object"), F.col("caller_proc").alias("proc"), F.col("callee_object").alias("near_object"), F.col("callee_proc").alias("near_proc"))
    back = there.select(F.col("near_object").alias("object"), F.col("near_proc").alias("proc"), F.col("object").alias("near_object"), F.col("proc").alias("near_proc"))
    own = procs.select("object", "proc", F.col("object").alias("near_object"), F.col("proc").alias("near_proc"))
    return there.union(back).union(own).distinct().join(procs.select("object", "proc").distinct(), ["object", "proc"], "left_semi")
