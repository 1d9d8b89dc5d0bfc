"""Parent-child links to full hierarchies by heavy-path decomposition.

1. Pointer doubling gives depth, root and subtree size of every name in as many
   rounds as the depth has binary digits; what no round resolves lies on a cycle or
   below one and is separated.
2. Each name's heaviest child continues its chain; a name reaches its root over at
   most log2(n) chains.
3. Chains are laid out level by level: a chain's path is its parent's path followed
   by its own segment, its interval of descendants follows from subtree sizes.

A parent with a third of all children is aggregated map-side; the sums over siblings
run per (parent, salt) with an offset per salt. A chain is as long as the path of its
last name, so no array outgrows one result value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators import fixpoint
from lodestone.session import cut, cut_counting, filled, load

#: Parts in which the children of one parent are numbered.
SIBLING_SALT = 64


def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) of classes and controls, from all rows whatever their times."""
    pairs = [("objects", "object", "ancestor"), ("type_ancestors", "child", "parent"), ("stdlib_members", "object", "ancestor")]
    parts = [load(spark, sf_dir, t).select(F.col(c).alias("child"), F.col(p).alias("parent")) for t, c, p in pairs]
    return reduce(DataFrame.union, parts)


def forest(links: DataFrame) -> DataFrame:
    """(name, parent) of each distinct name, lower-cased and trimmed.

    links: (child, parent). NULL and blank names are no names; a NULL or blank parent
    is no parent. A child written with several parents keeps the least of them.
    """
    links = links.select(filled("child").alias("child"), filled("parent").alias("parent"))
    rows = links.where("child is not null").select(F.col("child").alias("name"), "parent")
    rows = rows.union(links.where("parent is not null").select(F.col("parent").alias("name"), F.lit(None).cast("string").alias("parent")))
    return rows.groupBy("name").agg(F.min("parent").alias("parent"))


def _double(state: DataFrame) -> DataFrame:
    """One round: pointers twice as far; depth and root of the names that reach a root.

    state: (name, parent, ptr, far, depth, root, size). ptr is the ancestor ``far`` up,
    NULL once the root is known; size counts the descendants less than ``far`` below,
    and the name itself. ``far`` is a column, so all rounds share their compiled code.
    """
    up = state.select(F.col("name").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
    open_ = state.where("ptr is not null")
    gain = open_.groupBy(F.col("ptr").alias("name")).agg(F.sum("size").alias("_gain"))
    # Only open names are looked up: a NULL pointer would be one hot key of all the others.
    moved = open_.join(up, "ptr").select("name", "parent", F.col("_ptr").alias("ptr"), "far", (F.col("_depth") + F.col("far")).alias("depth"), F.col("_root").alias("root"), "size")
    both = moved.unionByName(state.where("ptr is null")).join(gain, "name", "left")
    return both.select("name", "parent", "ptr", (F.col("far") * 2).alias("far"), "depth", "root", (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size"))


def _resolve(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, parent, depth, root, size) of names with a root, (name, ptr) of the others)."""
    top = F.col("parent").isNull()
    state = nodes.select(
        "name", "parent", F.col("parent").alias("ptr"), F.lit(1).alias("far"), F.when(top, F.lit(0)).alias("depth"), F.when(top, F.col("name")).alias("root"), F.lit(1).cast("long").alias("size")
    )
    far = F.col("ptr").isNotNull()
    (state, open_), before = cut_counting(state, far), -1
    # A name as deep as the pointers reach has an ancestor that the round before resolved, so a round without gain is the last.
    while open_ not in (0, before):
        (state, open_), before = cut_counting(_double(state), far), open_
    return state.where("root is not null").drop("ptr", "far"), state.where("root is null").select("name", "ptr")


def on_cycle(open_: DataFrame) -> DataFrame:
    """(name) on a cycle. open_: (name, ptr), ptr being an ancestor of the same distance for all.

    The images of the pointer shrink from round to round to the cycles, on which it is one to one.
    """
    state, n = cut_counting(open_)
    before = -1
    while n not in (0, before):
        image = state.select(F.col("ptr").alias("name")).distinct()
        up = state.select(F.col("name").alias("ptr"), F.col("ptr").alias("_ptr"))
        twice = state.join(image, "name", "left_semi").join(up, "ptr").select("name", F.col("_ptr").alias("ptr"))
        (state, n), before = cut_counting(twice), n
    return state.select("name")


def _chains(tree: DataFrame) -> DataFrame:
    """tree with ``head`` (first name of its chain), ``heavy`` (size of its heaviest child, 0 if none)."""
    best = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "name")).alias("x"))
    best = best.select(F.col("parent").alias("_p"), F.col("x.name").alias("_n"), F.col("x.size").alias("heavy"))
    tree = tree.join(best.select(F.col("_n").alias("name"), F.lit(True).alias("_goes_on")), "name", "left")
    tree = tree.join(best.select(F.col("_p").alias("name"), "heavy"), "name", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))
    goes_on = F.col("_goes_on").isNotNull()
    far = F.col("ptr").isNotNull()
    state, open_ = cut_counting(tree.select("name", F.when(goes_on, F.col("parent")).alias("ptr"), F.when(~goes_on, F.col("name")).alias("head")), far)
    while open_:
        up = state.select(F.col("name").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("head").alias("_head"))
        moved = state.where(far).join(up, "ptr").select("name", F.col("_ptr").alias("ptr"), F.col("_head").alias("head"))
        state, open_ = cut_counting(moved.unionByName(state.where(~far)), far)
    return tree.drop("_goes_on").join(state.select("name", "head"), "name")


def _light_offsets(tree: DataFrame) -> DataFrame:
    """(head, before): sizes of the light siblings numbered before this chain head."""
    light = tree.where((F.col("head") == F.col("name")) & F.col("parent").isNotNull()).select("parent", "name", "size")
    light = light.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SIBLING_SALT)))
    sums = light.groupBy("parent", "salt").agg(F.sum("size").alias("s"))
    sums = sums.select("parent", "salt", F.coalesce(F.sum("s").over(W.partitionBy("parent").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = W.partitionBy("parent", "salt").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    light = light.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return light.join(sums, ["parent", "salt"]).select(F.col("name").alias("head"), (F.col("own") + F.col("base")).alias("before"))


def hierarchy(links: DataFrame) -> DataFrame:
    """Each name with its place in the hierarchy.

    links: (child, parent), see ``forest``. Result: object, root, depth (int), path
    (names from the root), n_descendants, first and last (a name's descendants are the
    names of its root with first above its own and not above its last), chain.
    A name that is its own ancestor has root ``#cycle``, one below such names
    ``#below``; both have depth -1, an empty path and no interval. Repeated links
    count once; an empty table gives an empty result.
    """
    tree, open_ = _resolve(cut(forest(links)))
    tree = cut(_chains(tree))
    offsets = _light_offsets(tree)
    chains = tree.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("depth", "name", "size", "heavy"))).alias("names"), F.first("root").alias("root"))
    heads = tree.where(F.col("head") == F.col("name")).select("head", "parent")
    chains = cut(chains.join(heads, "head").join(offsets, "head", "left"))
    now = chains.where("parent is null").select("head", "root", "names", F.array().cast("array<string>").alias("above"), F.lit(0).cast("long").alias("start"))
    done, rest, n = [], chains.where("parent is not null"), 1
    while n:
        segment = F.transform("names", lambda x: x["name"])
        laid = now.select("head", "root", "above", "start", segment.alias("_segment"), F.posexplode("names").alias("pos", "x"))
        laid = laid.select(
            F.col("x.name").alias("object"), "root", F.col("x.depth").alias("depth"), F.concat("above", F.slice("_segment", F.lit(1), F.col("pos") + 1)).alias("path"),
            (F.col("x.size") - 1).alias("n_descendants"), (F.col("start") + F.col("pos")).alias("first"), (F.col("start") + F.col("pos") + F.col("x.size") - 1).alias("last"), F.col("head").alias("chain"), F.col("x.heavy").alias("_heavy"),
        )
        done.append(laid.drop("_heavy"))
        hook = laid.select(F.col("object").alias("parent"), F.col("path").alias("above"), (F.col("first") + 1 + F.col("_heavy")).alias("_from"))
        now, n = cut_counting(rest.join(hook, "parent").select("head", "root", "names", "above", (F.col("_from") + F.col("before")).alias("start")))
    cycle = on_cycle(open_).withColumn("_cyclic", F.lit(True))
    none = lambda t: F.lit(None).cast(t)
    apart = open_.join(cycle, "name", "left").select(
        F.col("name").alias("object"), F.when(F.col("_cyclic"), "#cycle").otherwise("#below").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"),
        none("long").alias("n_descendants"), none("long").alias("first"), none("long").alias("last"), none("string").alias("chain"),
    )
    return reduce(DataFrame.unionByName, done, apart)


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(object, descendant, distance) of the result of ``hierarchy``, from the intervals of the chains.

    An interval is the disjoint union of at most two dyadic blocks per size (a block of
    size 2^k begins at a multiple of 2^k), and a place lies in one block of each size; so
    equal (root, size, block) finds each pair once, without comparing any other.
    """
    placed = tree.where("depth >= 0").select("object", "root", "depth", "first", "last")
    spans = placed.where("last > first").select("object", "root", F.col("depth").alias("_depth"), F.explode(_dyadic(F.col("first") + 1, F.col("last"))).alias("b"))
    sizes = spans.select("b.k").distinct()
    # At most 63 sizes: the places take the blocks of those that some interval has.
    within = placed.where("depth > 0").join(F.broadcast(sizes), F.lit(True)).select(F.col("object").alias("descendant"), "root", "depth", "k", F.expr("shiftright(first, k)").alias("at"))
    found = spans.select("object", "root", "_depth", "b.k", "b.at").join(within, ["root", "k", "at"])
    return found.select("object", "descendant", (F.col("depth") - F.col("_depth")).alias("distance"))


def _dyadic(first: Column, last: Column) -> Column:
    """The dyadic blocks (k, at) that make up first .. last."""
    none = F.array().cast("array<struct<k:int,at:bigint>>")
    start = F.struct(first.alias("lo"), (last + 1).alias("hi"), none.alias("out"))

    def step(state: Column, k: Column) -> Column:
        # Sizes from the smallest up: an odd end gives a block of its size, the rest is halved.
        lo, hi = state["lo"], state["hi"]
        left = (lo < hi) & (lo % 2 == 1)
        lo2 = F.when(left, lo + 1).otherwise(lo)
        right = (lo2 < hi) & (hi % 2 == 1)
        hi2 = F.when(right, hi - 1).otherwise(hi)
        block = lambda at: F.array(F.struct(k.cast("int").alias("k"), at.alias("at")))
        out = F.concat(state["out"], F.when(left, block(lo)).otherwise(none), F.when(right, block(hi2)).otherwise(none))
        return F.struct(F.when(lo2 < hi2, F.floor(lo2 / 2)).otherwise(F.lit(0)).cast("bigint").alias("lo"), F.when(lo2 < hi2, F.floor(hi2 / 2)).otherwise(F.lit(0)).cast("bigint").alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda s: s["out"])


def below_cycles(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees that hang from names on cycles, as ``hierarchy`` gives trees, and (object, member, distance) of the cycles.

    Each name on a cycle is the root of a tree of its own here (depth 0), so root,
    path and interval of a name below a cycle are those from the nearest cycle name on.
    The members of a cycle are each other's descendants, and their own.
    """
    nodes = cut(forest(links))
    open_ = _resolve(nodes)[1]
    cycle = cut(on_cycle(open_))
    apart = nodes.join(open_.select("name"), "name", "left_semi")
    own = apart.join(cycle, "name", "left_semi")
    hung = apart.join(cycle, "name", "left_anti").select(F.col("name").alias("child"), "parent")
    trees = hierarchy(hung.union(cycle.select(F.col("name").alias("child"), F.lit(None).cast("string").alias("parent"))))
    around = fixpoint.all_pairs(own.select(F.col("parent").alias("src"), F.col("name").alias("dst")))
    return trees, around.select(F.col("seed").alias("object"), F.col("node").alias("member"), F.col("hops").alias("distance"))


def cyclic_pairs(links: DataFrame) -> DataFrame:
    """(object, descendant, distance) of the names on and below cycles, which ``descendant_pairs`` has not."""
    trees, around = below_cycles(links)
    trees = cut(trees)
    under = trees.where("depth > 0").select(F.col("root").alias("member"), F.col("object").alias("descendant"), "depth")
    through = around.where("object <> member").join(under, "member").select("object", "descendant", (F.col("distance") + F.col("depth")).alias("distance"))
    return descendant_pairs(trees).union(around).union(through)
