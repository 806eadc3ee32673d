"""Labels of rooted forests by pointer doubling: a number of rounds that grows with the logarithm of the depth.

After k rounds a vertex knows its ancestor 2**k steps up and what it has gathered within that distance: from
below (``fold_subtrees``) or along its path to the root (``fold_paths``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sum_within
from ..plans.storage import FEW, Table, materialise, tidy
from .graph import Graph
from .traverse import tree_edges

#: How two values combine, and how many do.
OPS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[str], Column]]] = {
    "sum": (lambda a, b: a + F.coalesce(b, F.lit(0)), F.sum),
    "min": (lambda a, b: F.least(a, b), F.min),
    "max": (lambda a, b: F.greatest(a, b), F.max),
}


def depth_of(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def fold_subtrees(tree: DataFrame, values: DataFrame, ops: dict[str, str]) -> DataFrame:
    """(v, ...): each value column of ``values`` (v, ...) folded over the subtree of v; ``ops`` names sum, min or max."""
    rounds = depth_of(tree).bit_length()
    state = Table(tree.select("v", F.col("parent").alias("up")).join(values, "v"), "fold", few=FEW)
    for _ in range(rounds):
        own = state.df
        sent = own.where("up is not null").groupBy("up").agg(*[OPS[op][1](c).alias(f"{c}_in") for c, op in ops.items()]).withColumnRenamed("up", "v")
        above = own.select(F.col("v").alias("up"), F.col("up").alias("up2"))
        joined = own.join(sent, "v", "left").join(above, "up", "left")
        after = Table(joined.select("v", F.col("up2").alias("up"), *[OPS[op][0](F.col(c), F.col(f"{c}_in")).alias(c) for c, op in ops.items()]), "fold", few=FEW)
        state.drop()
        state = after
    return state.df.select("v", *ops)


def fold_paths(tree: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(v, column): the sum of a column of ``values`` (v, column) over v and all its ancestors."""
    rounds = depth_of(tree).bit_length()
    state = Table(tree.select("v", F.col("parent").alias("up")).join(values.select("v", column), "v"), "paths", few=FEW)
    for _ in range(rounds):
        own = state.df
        above = own.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col(column).alias("more"))
        after = Table(own.join(above, "up", "left").select("v", F.col("up2").alias("up"), (F.col(column) + F.coalesce("more", F.lit(0))).alias(column)), "paths", few=FEW)
        state.drop()
        state = after
    return state.df.select("v", column)


def descendants(tree: DataFrame) -> DataFrame:
    """(v, n_desc): the size of each subtree, its root included."""
    return fold_subtrees(tree, tree.select("v", F.lit(1).cast("long").alias("n_desc")), {"n_desc": "sum"})


def preorder(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(v, pre): preorder numbers from 1 in each tree, children by id."""
    kids = running_sum_within(tree.where("parent is not null").select("v", "parent").join(sizes, "v"), "parent", "v", "n_desc")
    step = kids.select("v", (F.col("before") + 1).alias("pre")).union(tree.where("parent is null").select("v", F.lit(1).cast("long")))
    return fold_paths(tree, step, "pre")


def non_tree(graph: Graph, tree: DataFrame) -> DataFrame:
    """(src, dst) of the edges that are not in the tree."""
    return graph.without(tree_edges(tree)).edges


def low_high(graph: Graph, tree: DataFrame, pre: DataFrame) -> DataFrame:
    """(v, low, high): smallest and largest preorder number in v's subtree and across non-tree edges from it."""
    rest = Graph(non_tree(graph, tree)).sym
    across = rest.join(pre.select(F.col("v").alias("b"), "pre"), "b").groupBy(F.col("a").alias("v")).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    own = pre.join(across, "v", "left").select("v", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    return fold_subtrees(tree, own, {"low": "min", "high": "max"})


def across(graph: Graph, own: DataFrame) -> DataFrame:
    """(src, dst, ps, pd, cross) of the edges of ``graph`` that aren't in the tree ``own`` (v, parent, pre, n_desc): the ends' preorder numbers, and whether neither end lies below the other."""
    x, y = (own.select(F.col("v").alias(v), F.col("parent").alias(f"u{k}"), F.col("pre").alias(f"p{k}"), F.col("n_desc").alias(f"n{k}")) for v, k in (("src", "s"), ("dst", "d")))
    met = graph.edges.join(x, "src").join(y, "dst").where(~F.col("us").eqNullSafe(F.col("dst")) & ~F.col("ud").eqNullSafe(F.col("src")))
    return met.select("src", "dst", "ps", "pd", (~related(F.col("ps"), F.col("ns"), F.col("pd"), F.col("nd"))).alias("cross"))


def labelled(graph: Graph, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tree (v, parent, pre, n_desc, ...) with ``low`` and ``high``, and the edges ``across`` it, both written out."""
    rest = materialise(across(graph, own), "across")
    end = lambda v, p: F.struct(F.col(v).alias("v"), F.col(p).alias("p"))
    reach = rest.select(F.inline(F.array(end("src", "pd"), end("dst", "ps")))).groupBy("v").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    start = own.select("v", "pre").join(reach, "v", "left").select("v", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    return materialise(own.join(fold_subtrees(own, start, {"low": "min", "high": "max"}), "v"), "labels", FEW), rest


def numbered(tree: DataFrame) -> DataFrame:
    """(v, parent, level, root, n_desc, pre), written out."""
    sizes = descendants(tree)
    return materialise(tree.join(sizes, "v").join(preorder(tree, sizes), "v"), "numbers", FEW)


@tidy("labels", FEW)
def labels(graph: Graph, tree: DataFrame) -> DataFrame:
    """(v, parent, level, root, n_desc, pre, low, high), written out."""
    return labelled(graph, numbered(tree))[0]


def _jumps(tree: DataFrame) -> list[Table]:
    """(v, up) of the ancestors 1, 2, 4, ... steps up, or the root."""
    jumps = [Table(tree.select("v", F.coalesce("parent", "v").alias("up")), "jump", few=FEW)]
    for _ in range(max(0, depth_of(tree).bit_length() - 1)):
        own = jumps[-1].df
        jumps.append(Table(own.join(own.toDF("up", "up2"), "up").select("v", F.col("up2").alias("up")), "jump", few=FEW))
    return jumps


def _levelled(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, us, ud, x, y, gap) of ``pairs`` (src, dst): their parents (of a root, itself), the end that is deeper, lifted once if the levels differ by an odd number, the other one, and how much deeper x still is."""
    row = lambda v, k: tree.select(F.col("v").alias(v), F.coalesce("parent", "v").alias(f"u{k}"), F.col("level").alias(f"l{k}"))
    met = pairs.select("src", "dst").join(row("src", "s"), "src").join(row("dst", "d"), "dst")
    gap, down = F.abs(F.col("ls") - F.col("ld")), F.col("ls") >= F.col("ld")
    x = F.when(down, F.when(gap % 2 == 1, F.col("us")).otherwise(F.col("src"))).otherwise(F.when(gap % 2 == 1, F.col("ud")).otherwise(F.col("dst")))
    return met.select("src", "dst", "us", "ud", x.alias("x"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("y"), (gap - gap % 2).alias("gap"))


def _ancestors(lifted: Table, jumps: list[Table], kept: list[str], merged: bool = False) -> DataFrame:
    """``kept`` columns and ``lca`` of the pairs ``lifted`` (x, y, gap, measured with its largest gap as ``most``).

    The deeper end is lifted to the level of the other, then both by the largest jumps that keep them apart. ``merged``
    pairs are one row each, with their number ``n``.
    """
    now, most = lifted.df, lifted.found["most"] or 0
    if most:
        for k in reversed(range(1, most.bit_length())):
            far = F.col("gap") >= 1 << k
            now = now.join(jumps[k].df.toDF("x", "up_x"), "x").select(*kept, F.when(far, F.col("up_x")).otherwise(F.col("x")).alias("x"), "y", F.when(far, F.col("gap") - (1 << k)).otherwise(F.col("gap")).alias("gap"))
        now = Table(now.select(*kept, "x", "y"), "lifted").df
    for k in reversed(range(1, len(jumps))):
        apart = F.col("ux") != F.col("uy")
        met = now.join(jumps[k].df.toDF("x", "ux"), "x").join(jumps[k].df.toDF("y", "uy"), "y")
        now = met.select(*kept, F.when(apart, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("uy")).otherwise(F.col("y")).alias("y"))
        if merged:
            now = now.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("n").alias("n"))
    one = jumps[0].df
    near = Table(one.join(one.toDF("up", "above"), "up").select("v", "up", "above"), "near", few=FEW).df
    met = now.join(near.toDF("x", "ux", "ax"), "x").join(near.select(F.col("v").alias("y"), F.col("up").alias("uy")), "y")
    return met.select(*kept, F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("ux") == F.col("uy"), F.col("ux")).otherwise(F.col("ax")).alias("lca"))


@tidy("lca")
def lca(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) of one tree each, with ``lca``: their lowest common ancestor."""
    lifted = Table(_levelled(tree, pairs).select("src", "dst", "x", "y", "gap"), "lifted", most=F.max("gap"))
    return _ancestors(lifted, _jumps(tree), ["src", "dst"])


@tidy("tops", FEW)
def tops(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, n): the lowest common ancestors of the ``edges`` (src, dst) that aren't in the tree, and of how many each is one.

    Edges that have come to the same pair of ancestors go on as one row, which makes few of many, as those next to the ends are shared.
    """
    met = _levelled(tree, edges).where("us <> dst and ud <> src")
    swap = (F.col("gap") == 0) & (F.col("x") > F.col("y"))
    x, y = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    lifted = Table(met.groupBy(x.alias("x"), y.alias("y"), "gap").agg(F.count(F.lit(1)).alias("n")), "lifted", most=F.max("gap"))
    return _ancestors(lifted, _jumps(tree), ["n"], merged=True).groupBy(F.col("lca").alias("v")).agg(F.sum("n").alias("n"))


def over(graph: Graph, tree: DataFrame, met: DataFrame) -> DataFrame:
    """What ``covered`` gives for all edges that aren't in the tree, from the ``tops`` of the graph's edges."""
    ends = lambda rows, *c: rows.select(F.explode(F.array(*c)).alias("v"))
    own = ends(graph.edges, "src", "dst").withColumn("n", F.lit(1).cast("long"))
    taken = ends(tree.where("parent is not null"), "v", "parent").withColumn("n", F.lit(-1).cast("long"))
    return _folded(tree, own.union(taken).union(met.select("v", -2 * F.col("n"))))


@tidy("marks", FEW)
def marks(graph: Graph, tree: DataFrame) -> DataFrame:
    """(v, parent, over): each tree edge, and over how many of the other edges' paths through the tree it lies."""
    return over(graph, tree, tops(tree, graph.edges))


def _folded(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """(v, parent, over): the sums of ``counts`` (v, n) over the subtrees below the tree edges."""
    own = tree.select("v").join(counts.groupBy("v").agg(F.sum("n").alias("over")), "v", "left").select("v", F.coalesce("over", F.lit(0)).alias("over"))
    return tree.where("parent is not null").select("v", "parent").join(fold_subtrees(tree, own, {"over": "sum"}), "v")


@tidy("covered", FEW)
def covered(tree: DataFrame, met: DataFrame) -> DataFrame:
    """(v, parent, over): each tree edge, and how many of the edges ``met`` (src, dst, lca) have their path through the tree go over it.

    An edge counts once at each end and is taken back twice at their common ancestor, so the sum over the subtree of v is what leaves it.
    """
    ends = met.select(F.inline(F.array(*[F.struct(F.col(c).alias("v"), F.lit(n).cast("long").alias("n")) for c, n in (("src", 1), ("dst", 1), ("lca", -2))])))
    return _folded(tree, ends)


@tidy("euler", FEW)
def euler_preorder(tree: DataFrame) -> DataFrame:
    """(v, pre): preorder numbers from 1 in each tree by ranking its Euler tour.

    The tour goes down and up each tree edge. Each step's successor follows from the order of siblings; doubling counts the
    down steps from each step to the end of its tour.
    """
    kids = tree.where("parent is not null").select("v", "parent", F.lit(1).cast("long").alias("one"))
    ranks = materialise(running_sum_within(kids, "parent", "v", "one", "rank").select("v", "parent", "rank"), "ranks", FEW)
    later = ranks.where("rank > 0").select("parent", (F.col("rank") - 1).alias("rank"), F.col("v").alias("sibling"))
    order = ranks.join(later, ["parent", "rank"], "left").select("v", "parent", "sibling")
    first = kids.groupBy("parent").agg(F.min("v").alias("child")).withColumnRenamed("parent", "v")
    met = order.join(first, "v", "left")
    up_of = lambda v: F.struct(v.alias("v"), F.lit(1).alias("up"))
    down_of = lambda v: F.struct(v.alias("v"), F.lit(0).alias("up"))
    is_root = tree.where("parent is null").select(F.col("v").alias("parent"), F.lit(True).alias("top"))
    down = met.select(down_of(F.col("v")).alias("step"), F.when(F.col("child").isNotNull(), down_of(F.col("child"))).otherwise(up_of(F.col("v"))).alias("next"), F.lit(1).cast("long").alias("n"))
    up = order.join(is_root, "parent", "left").select(up_of(F.col("v")).alias("step"), F.when(F.col("sibling").isNotNull(), down_of(F.col("sibling"))).when(F.col("top").isNull(), up_of(F.col("parent"))).alias("next"), F.lit(0).cast("long").alias("n"))
    code = lambda c: F.col(f"{c}.v") * 2 + F.col(f"{c}.up")
    open_ends = F.count("t")
    state = Table(down.union(up).select(code("step").alias("s"), code("next").alias("t"), "n"), "tour", few=FEW, open=open_ends)
    while state.found["open"]:
        own = state.df
        ahead = own.select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("n").alias("n2"))
        after = Table(own.join(ahead, "t", "left").select("s", F.col("t2").alias("t"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "tour", few=FEW, open=open_ends)
        state.drop()
        state = after
    left = state.df.where("s % 2 = 0").select((F.col("s") / 2).cast("long").alias("v"), F.col("n").alias("left"))
    whole = tree.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return tree.join(whole, "root").join(left, "v", "left").select("v", (F.col("size") - F.coalesce("left", "size") + 1).alias("pre"))


def related(pre_v: Column, n_v: Column, pre_w: Column, n_w: Column) -> Column:
    """Whether one of two vertices of a tree lies in the subtree of the other."""
    return ~((pre_v + n_v <= pre_w) | (pre_w + n_w <= pre_v))
