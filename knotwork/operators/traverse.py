"""Breadth-first trees from one or many roots.

A round joins the last level with the edges and keeps, of the vertices met, those that are in neither of the last two
levels; no other level can be met in an undirected graph, so a round's cost follows its frontier, not what has been visited. Each level is a
table of its own. The parent of a vertex is its smallest neighbour on the level before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sum_within
from ..plans.storage import FEW, Table, materialise, tidy
from .components import components, tied
from .graph import Graph


#: Rows of levels, of one search, that Spark may broadcast to find the next one, besides levels of few rows: with a broadcast the edges needn't be shuffled.
FRONTIERS = 1 << 20


@tidy("tree", FEW)
def bfs(graph: Graph, roots: DataFrame, max_level: int | None = None, total: int | None = None) -> DataFrame:
    """(v, parent, level, root) of all vertices reached from ``roots`` (v); parents of roots are null.

    ``total`` is the number of vertices that can be reached, where it is known: the search ends with the last of them.
    """
    sym = graph.stored().sym
    first = roots.select("v", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("level"), F.col("v").alias("root")).distinct()
    levels, room = [Table(first, "level", few=FEW)], FRONTIERS
    while levels[-1].found["rows"] and sum(x.found["rows"] for x in levels) != total and (max_level is None or len(levels) <= max_level):
        n = levels[-1].found["rows"]
        frontier = levels[-1].plain if n <= room else levels[-1].df
        room -= n if FEW < n <= room else 0
        met = frontier.select(F.col("v").alias("a"), "root").join(sym, "a").select(F.col("b").alias("v"), "a", "root", F.lit(False).alias("old"))
        # one aggregation; anti-joins would be pushed below it, to every edge met
        for old in levels[-2:]:
            met = met.union(old.plain.select("v", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True)))
        new = met.groupBy("v").agg(F.min("a").alias("parent"), F.min_by("root", "a").alias("root"), F.max("old").alias("old")).where("not old")
        levels.append(Table(new.select("v", "parent", F.lit(len(levels)).cast("long").alias("level"), "root"), "level", few=FEW))
    out = levels[0].df.sparkSession.read.schema(levels[0].df.schema).parquet(*[x.path for x in levels])
    return out


def component_roots(graph: Graph) -> DataFrame:
    """(v) of one root per component: the vertex of largest degree, smallest id first."""
    return _roots(graph)[0]


def _roots(graph: Graph) -> tuple[DataFrame, int | None]:
    """``component_roots``, and the number of vertices if it is found on the way."""
    total = None
    if graph.extra is None:
        found, around = tied(graph.edges.toDF("a", "b"))
        total = around.found["vertices"]
        ranked = around.df.join(found, "v", "left").select("v", F.col("n").alias("degree"), F.coalesce("component", "v").alias("component"))
    else:
        ranked = components(graph).join(graph.degrees(), "v")
    best = ranked.groupBy("component").agg(F.max(F.struct("degree", -F.col("v"))).alias("top"))
    return best.select((-F.col("top.col2")).alias("v")), total


@tidy("forest", FEW)
def spanning_forest(graph: Graph) -> DataFrame:
    """The breadth-first tree of each component from its root of largest degree."""
    graph = graph.stored()
    roots, total = _roots(graph)
    return bfs(graph, materialise(roots, "roots", FEW), total=total)


@tidy("label-forest", FEW)
def label_forest(graph: Graph) -> DataFrame:
    """The breadth-first tree of each component from its smallest vertex."""
    graph = graph.stored()
    found, around = tied(graph.edges.toDF("a", "b"))
    own, total = (around.df.select("v"), around.found["vertices"]) if graph.extra is None else (graph.vertices, None)
    return bfs(graph, materialise(own.join(found, "v", "left_anti"), "roots", FEW), total=total)


def tree_edges(tree: DataFrame) -> DataFrame:
    """(src, dst) of a tree, canonical."""
    return tree.where("parent is not null").select(F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst"))


def bottom_up_step(graph: Graph, tree: DataFrame, level: int) -> DataFrame:
    """(v, parent) of the next level, found from the unvisited side: its vertices look for a neighbour on ``level``."""
    unseen = graph.vertices.join(tree.where(F.col("level") <= level).select("v"), "v", "left_anti")
    looked = graph.sym.join(unseen.withColumnRenamed("v", "a"), "a", "left_semi")
    on_level = tree.where(F.col("level") == level).select(F.col("v").alias("b"))
    return looked.join(on_level, "b", "left_semi").groupBy(F.col("a").alias("v")).agg(F.min("b").alias("parent"))


def level_lists(tree: DataFrame) -> DataFrame:
    """(level, n, first, last) of each level."""
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))


def bad_tree_rows(graph: Graph, tree: DataFrame) -> DataFrame:
    """Rows of a tree that break it: a parent that is no neighbour, or not on the level before."""
    up = tree.select(F.col("v").alias("parent"), F.col("level").alias("above"))
    sym = graph.sym.select(F.col("a").alias("v"), F.col("b").alias("parent"), F.lit(True).alias("is_edge"))
    met = tree.where("parent is not null").join(up, "parent", "left").join(sym, ["v", "parent"], "left")
    return met.where("is_edge is null or above is null or above <> level - 1").select("v", "parent", "level")


def child_ranks(tree: DataFrame) -> DataFrame:
    """(v, parent, rank, children): place among siblings from 0 by id, and the number of own children."""
    kids = tree.where("parent is not null").select("v", "parent", F.lit(1).cast("long").alias("one"))
    ranks = running_sum_within(kids, "parent", "v", "one", "rank").select("v", "parent", "rank")
    ranks = ranks.union(tree.where("parent is null").select("v", "parent", F.lit(None).cast("long")))
    counts = tree.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children")).withColumnRenamed("parent", "v")
    return ranks.join(counts, "v", "left").select("v", "parent", "rank", F.coalesce("children", F.lit(0)).alias("children"))
