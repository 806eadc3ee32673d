"""Sparse certificates: few edges that keep cut vertices, bridges and the vertices of every block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import FEW, materialise, tidy
from .components import tied
from .graph import Graph
from .traverse import label_forest, spanning_forest, tree_edges


@tidy("non-tree-components", FEW)
def non_tree_components(graph: Graph, tree: DataFrame) -> DataFrame:
    """(v, component) of the graph without its tree, for vertices that keep an edge."""
    rest = Graph(graph.without(tree_edges(tree)).edges, graph.extra).stored()
    found, around = tied(rest.edges.toDF("a", "b"))
    own = around.df.select("v") if rest.extra is None else rest.vertices
    return own.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


@tidy("non-tree-forest", FEW)
def non_tree_forest(graph: Graph, tree: DataFrame) -> DataFrame:
    """The breadth-first forest of the graph without its tree, from the smallest vertex of each component."""
    return label_forest(graph.without(tree_edges(tree)).stored())


@tidy("certificate")
def certificate(graph: Graph) -> DataFrame:
    """(src, dst, forest): the edges of a breadth-first forest (0) and of a forest of what it leaves (1)."""
    graph = graph.stored()
    tree = spanning_forest(graph)
    second = non_tree_forest(graph, tree)
    return tree_edges(tree).withColumn("forest", F.lit(0).cast("long")).union(tree_edges(second).withColumn("forest", F.lit(1).cast("long")))


@tidy("forests")
def forests(graph: Graph, k: int) -> DataFrame:
    """(src, dst, forest): a breadth-first forest (0), and k more, each of what those before leave."""
    rest = graph.stored()
    found = []
    for i in range(k + 1):
        own = tree_edges(spanning_forest(rest) if i == 0 else label_forest(rest))
        found.append(own.withColumn("forest", F.lit(i).cast("long")))
        rest = Graph(materialise(rest.without(own).edges, "rest"))
    out = found[0]
    for own in found[1:]:
        out = out.union(own)
    return out
