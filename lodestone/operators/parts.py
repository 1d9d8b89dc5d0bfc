"""Weakly connected parts of a graph, and walks within them.

Ways never leave a part, so a closure over many small parts needs no rounds over all
pairs: parts are found by contraction (a round halves what is left, and holds a row per
node), whole parts are gathered into bundles, a task per bundle, and walks run there over
arrays. A part of more than LARGE nodes is left to the rounds of ``fixpoint``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, cut_counting

#: Nodes of a bundle, of the largest part that a task takes, and cells (starts times nodes) that a walk holds at once.
BUNDLE, LARGE, CELLS = 10_000, 100_000, 1_000_000
#: Rows of a batch that a task gives back.
BATCH = 50_000


def _id(node: Column, kind: str) -> Column:
    # The hash of a struct passes over NULLs, its JSON doesn't.
    return F.xxhash64(F.to_json(node) if kind.startswith("struct") else node)


def labels(arcs: DataFrame) -> DataFrame:
    """(node, part) of the nodes of arcs (src, dst; longs) that have a neighbour: nodes have one part if a way of any direction joins them.

    Each node hooks to its least neighbour, twice, and arcs move to where their ends
    hook, until none is left.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = arcs.select(*ordered(F.col("src"), F.col("dst"))).where("a < b").distinct()
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("part", F.col("node"))
    n = 1
    while n:
        least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        further = least.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        hooks = cut(least.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("to")))
        moved = edges
        for c in ("a", "b"):
            moved = moved.join(hooks.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges, n = cut_counting(moved.select(*ordered(F.col("a"), F.col("b"))).where("a < b").distinct())
        label = label.join(hooks.select(F.col("node").alias("part"), "to"), "part", "left").select("node", F.coalesce("to", "part").alias("part"))
    return label


def gather(edges: DataFrame, marks: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (bundle, id, node, after, and a boolean for each mark) of all nodes, and the nodes (node) of parts that are too large for a task; None if there are none.

    edges: (src, dst, and what goes with an edge); marks: by name, the nodes (node) that
    have it. ``after`` is the set of structs (dst, ...) of a node's edges, dst being an
    id. Ids are hashes; two nodes of one hash are an error.
    """
    marks = marks or {}
    edges = edges.where("src is not null and dst is not null")
    kind = edges.schema["src"].dataType.simpleString()
    more = [c for c in edges.columns if c not in ("src", "dst")]
    src, dst = (_id(F.col(c), kind) for c in ("src", "dst"))
    step = F.struct(dst.alias("dst"), *more)
    row = lambda i, n, e: F.struct(i.alias("id"), n.alias("node"), e.alias("step"))
    flags = lambda own: [F.lit(m == own).alias(m) for m in marks]
    ends = F.array(row(src, F.col("src"), step), row(dst, F.col("dst"), F.when(src.isNull(), step)))
    rows = edges.select(F.explode(ends).alias("x")).select("x.*", *flags(None))
    for m, nodes in marks.items():
        none = F.lit(None).cast(rows.schema["step"].dataType).alias("step")
        rows = rows.union(nodes.where("node is not null").select(_id(F.col("node"), kind).alias("id"), "node", none, *flags(m)))
    node = F.when(F.min("node") != F.max("node"), F.raise_error(F.lit("two nodes have one hash"))).otherwise(F.min("node")).alias("node")
    nodes = rows.groupBy("id").agg(node, F.collect_set("step").alias("after"), *[F.bool_or(m).alias(m) for m in marks])
    label, n = cut_counting(labels(edges.select(src.alias("src"), dst.alias("dst"))).withColumnRenamed("node", "id"))
    large = label.groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select("part", F.lit(True).alias("_large"))
    found = nodes.join(label, "id", "left").withColumn("part", F.coalesce("part", "id"))
    bundle = F.pmod(F.xxhash64("part"), F.lit(max(-(-n // BUNDLE), edges.sparkSession.sparkContext.defaultParallelism)))
    if large.isEmpty():
        return found.select(bundle.alias("bundle"), "id", "node", "after", *marks), None
    found = found.join(large, "part", "left")
    return found.where("_large is null").select(bundle.alias("bundle"), "id", "node", "after", *marks), found.where("_large").select("node")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that begin at one of the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


class Part:
    """A bundle as arrays: nodes in their order, NULLs first, edges (src, dst) by index, one of each pair, what goes with it being the least by ``priority``."""

    def __init__(self, table: pa.Table, priority: Callable[[tuple], tuple] | None = None) -> None:
        ids, names = table["id"].to_numpy(), table["node"].to_pylist()
        place = lambda v: tuple((x is not None, x or "") for x in v.values()) if isinstance(v, dict) else v
        order = np.array(sorted(range(len(names)), key=lambda i: place(names[i])), dtype=np.int64)
        self.n, self.rows = len(names), order
        self.names = [names[i] for i in order]
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        after = table["after"].combine_chunks()
        sizes = np.diff(after.offsets.to_numpy())
        inner = after.flatten()
        src = np.repeat(rank, sizes)
        dst = rank[by_id[np.searchsorted(ids[by_id], inner.field("dst").to_numpy(zero_copy_only=False))]]
        more = list(zip(*[inner.field(k).to_pylist() for k in range(1, inner.type.num_fields)], strict=True)) or [()] * len(src)
        self.kinds = sorted(set(more), key=priority or (lambda x: x))
        code = np.array([{k: i for i, k in enumerate(self.kinds)}[x] for x in more], dtype=np.int64) if len(self.kinds) > 1 else np.zeros(len(src), np.int64)
        by = np.lexsort((code, dst, src))
        src, dst, code = src[by], dst[by], code[by]
        first = np.ones(len(src), bool)
        first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        self.src, self.dst, self.code = src[first], dst[first], code[first]

    def marked(self, flags: pa.ChunkedArray) -> np.ndarray:
        return np.array(flags.to_pylist(), dtype=bool)[self.rows]

    def kind(self, src: np.ndarray, dst: np.ndarray) -> list[tuple]:
        """What goes with each of these edges."""
        at = np.searchsorted(self.src * self.n + self.dst, src * self.n + dst)
        return [self.kinds[i] for i in self.code[at]]


class Walker:
    """Breadth-first walks from many starts at once. A cell is start times nodes plus node."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, cells: int | None = None) -> None:
        order = np.argsort(src, kind="stable")
        self.n, self.dst = n, dst[order]
        self.first = np.searchsorted(src[order], np.arange(n + 1))
        self.lot = max(1, (cells or CELLS) // max(n, 1))
        self.hops = np.full(self.lot * n, -1, np.int32)
        self._place = np.zeros(self.lot * n, np.int64)

    def steps(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps (from, to) out of these cells."""
        at = cells % self.n
        first = self.first[at]
        many = self.first[at + 1] - first
        out = np.repeat(cells, many)
        return out, out - out % self.n + self.dst[np.arange(len(out)) + np.repeat(first - (np.cumsum(many) - many), many)]

    def walk(self, starts: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """The cells of each level, and the steps (from, to) that lead to each level but the first; ``hops`` holds the levels until ``forget``."""
        front = np.arange(len(starts)) * self.n + starts
        self.hops[front] = 0
        levels, legs = [front], []
        while True:
            out, to = self.steps(front)
            new = self.hops[to] < 0
            out, to = out[new], to[new]
            if not len(to):
                return levels, legs
            self.hops[to] = len(levels)
            self._place[to] = np.arange(len(to))
            front = to[self._place[to] == np.arange(len(to))]
            levels.append(front)
            legs.append((out, to))

    def forget(self, levels: list[np.ndarray]) -> None:
        for cells in levels:
            self.hops[cells] = -1

    def lots(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(starts), self.lot):
            yield starts[k : k + self.lot]


def witnesses(n: int, ends: np.ndarray, hops: np.ndarray, out: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, ordinal, from, to), arrays: of each pair, given by its end cell and hops, one leg per ordinal, the least (from, to) among those on any shortest way.

    out, to: the steps between cells that shortest ways are made of.
    """
    order = np.argsort(to, kind="stable")
    out, to = out[order], to[order]
    pair, at = np.arange(len(ends)), ends
    left = hops.copy()
    while len(pair):
        a, b = np.searchsorted(to, at), np.searchsorted(to, at, side="right")
        many = b - a
        legs = np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)
        pair = np.repeat(pair, many)
        code = (out[legs] % n) * n + to[legs] % n
        least = np.full(len(ends), n * n, np.int64)
        np.minimum.at(least, pair, code)
        own = np.unique(pair)
        left[own] -= 1
        yield own, left[own], least[own] // n, least[own] % n
        on = left[pair] > 0
        cells, place = np.unique(out[legs][on], return_inverse=True)
        both = np.unique(pair[on] * max(len(cells), 1) + place)
        pair, at = both // max(len(cells), 1), cells[both % max(len(cells), 1)] if len(cells) else both


def per_bundle(rows: DataFrame, run: Callable[[pa.Table], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """What ``run`` gives of each bundle, as batches of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(pa.Table.from_batches(batches)):
            yield from pa.Table.from_pydict(columns, schema=arrow).to_batches(max_chunksize=BATCH)

    return rows.groupBy("bundle").applyInArrow(apply, schema)
