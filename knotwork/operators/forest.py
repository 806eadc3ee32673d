"""Spanning forests and their labels in a number of rounds that grows with the logarithm of the number of vertices, whatever the depth.

The forest comes from repeated hooking: each component picks the edge to its smallest neighbouring component, and what is hooked
together becomes one component. Hooking to the smallest neighbour closes no cycle but between two components that pick each other, by the same edge.
The forest is rooted at the smallest vertex of each tree and labelled by ranking its Euler tour: each tree edge is a step down and a step
up, a step's successor follows from the order of a vertex's neighbours, and pointer doubling counts the steps that come after each.
Its trees are deep, unlike those of a breadth-first search, and are no substitute for them where distances count (levels, sparse certificates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sum_within
from ..plans.storage import Table, materialise, tidy
from .components import stars
from .graph import Graph


@tidy("forest-edges")
def forest_edges(graph: Graph) -> DataFrame:
    """(src, dst) of a spanning forest."""
    now = Table(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst"), "hooking", n=F.count(F.lit(1)))
    found = []
    while now.found["n"]:
        both = now.df.union(now.df.select("b", "a", "src", "dst"))
        picked = materialise(both.groupBy("a").agg(F.min(F.struct("b", "src", "dst")).alias("to")).select("a", "to.b", "to.src", "to.dst"), "picked")
        found.append(picked.select("src", "dst"))
        name = materialise(stars(picked.select("a", "b")), "names")
        x, y = name.toDF("a", "ca"), name.toDF("b", "cb")
        merged = now.df.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "src", "dst").where("a <> b")
        after = Table(merged, "hooking", n=F.count(F.lit(1)))
        now.drop()
        now = after
    out = graph.edges.select("src", "dst").limit(0)
    for own in found:
        out = out.union(own)
    return out.distinct()


@tidy("rooted")
def rooted(edges: DataFrame) -> DataFrame:
    """(v, parent, level, root, n_desc, pre) of the vertices of a forest (src, dst): level 0 and preorder number 1 at the smallest vertex of each tree.

    Children are visited in a circle by id from the parent on, so preorder numbers differ from those of ``trees.preorder``.
    """
    trees = materialise(stars(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "trees")
    arcs = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
    ranks = materialise(running_sum_within(arcs.withColumn("one", F.lit(1).cast("long")), "x", "y", "one", "rank").select("x", "y", "rank"), "ranks")
    later = ranks.where("rank > 0").select("x", (F.col("rank") - 1).alias("rank"), F.col("y").alias("after"))
    # after coming to y from x, the tour goes on from y to the neighbour after x, in a circle
    turn = ranks.join(later, ["x", "rank"], "left").join(ranks.where("rank = 0").select("x", F.col("y").alias("first")), "x")
    succ = turn.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("x").alias("tx"), F.coalesce("after", "first").alias("ty"), F.col("after").isNull().alias("wraps"))
    root = trees.select(F.col("component").alias("y"), F.lit(True).alias("top")).distinct()
    # a tour starts at its root's smallest neighbour, so it ends with the step that would go on to that again
    steps = succ.join(root, "y", "left").select("x", "y", F.when(F.col("top") & F.col("wraps"), F.lit(None).cast("long")).otherwise(F.col("tx")).alias("tx"), "ty", F.lit(1).cast("long").alias("left"))
    state = Table(steps, "tour", open=F.count("tx"))
    while state.found["open"]:
        ahead = state.df.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tx").alias("tx2"), F.col("ty").alias("ty2"), F.col("left").alias("more"))
        met = state.df.join(ahead, ["tx", "ty"], "left")
        after = Table(met.select("x", "y", F.col("tx2").alias("tx"), F.col("ty2").alias("ty"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour", open=F.count("tx"))
        state.drop()
        state = after
    back = state.df.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("left").alias("left_up"))
    down = state.df.select("x", "y", "left").join(back, ["x", "y"]).where("left > left_up")  # the step that comes first goes down
    size = trees.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("size"))
    own = down.select(F.col("y").alias("v"), F.col("x").alias("parent"), "left", ((F.col("left") - F.col("left_up") + 1) / 2).cast("long").alias("n_desc"))
    own = own.join(trees, "v").join(size, "component")
    # before the step down at place p there were d steps down and u up, with d + u = p and d - u = level - 1
    steps = own.select("v", "parent", F.col("component").alias("root"), "n_desc", (2 * (F.col("size") - 1) - F.col("left")).alias("p"), "left")
    numbered = _down_before(materialise(steps, "down"))
    tops = size.select(F.col("component").alias("v"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("level"), F.col("component").alias("root"), F.col("size").alias("n_desc"), F.lit(1).cast("long").alias("pre"))
    return numbered.unionByName(tops)


def _down_before(steps: DataFrame) -> DataFrame:
    """(v, parent, level, root, n_desc, pre): preorder numbers from the places p of the steps down, ranked by ranges of (root, p)."""
    from ..functions.prefix import running_sum

    ranked = running_sum(steps.withColumn("order", F.struct("root", "p")).withColumn("one", F.lit(1).cast("long")), "order", "one", "rank")
    first = ranked.groupBy("root").agg(F.min("rank").alias("base"))
    pre = ranked.join(first, "root").withColumn("d", F.col("rank") - F.col("base"))
    return pre.select("v", "parent", (2 * F.col("d") - F.col("p") + 1).alias("level"), "root", "n_desc", (F.col("d") + 2).alias("pre"))


def forest_labels(graph: Graph) -> DataFrame:
    """(v, parent, level, root, n_desc, pre, low, high) of a spanning forest of any depth."""
    from .trees import labelled

    @tidy("labels")
    def made() -> DataFrame:
        return labelled(graph, rooted(forest_edges(graph)))[0]

    return made()
