"""Biconnected components by the auxiliary graph of Tarjan and Vishkin, and what follows from them.

A tree edge is named by its lower end. Two tree edges share a block if a non-tree edge joins their lower ends, or if the lower
one's subtree reaches out of the upper one's; blocks of tree edges are the components of these links. A non-tree edge
has the block of the tree edge above either end. Any number of components is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import FEW, materialise, tidy
from .components import tied
from .forest import forest_edges, rooted
from .graph import Graph
from .traverse import spanning_forest, tree_edges
from .trees import across, labelled, numbered, over, tops


def auxiliary_links(own: DataFrame, rest: DataFrame) -> DataFrame:
    """(a, b) between tree edges of one block; ``own`` holds the labels of any spanning forest, ``rest`` the edges across it."""
    cross = rest.where("cross").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    upper = own.where("parent is not null").select(F.col("v").alias("parent"), F.col("pre").alias("pre_up"), F.col("n_desc").alias("n_up"))
    met = own.where("parent is not null").select("v", "parent", "low", "high").join(upper, "parent")
    inner = met.where("low < pre_up or high >= pre_up + n_up").select(F.col("parent").alias("a"), F.col("v").alias("b"))
    return cross.union(materialise(inner, "inner", FEW))


def _tree_blocks(own: DataFrame, rest: DataFrame) -> DataFrame:
    """(v, parent, label) of the tree edges, written out: equal labels in one block."""
    found = tied(auxiliary_links(own, rest))[0]
    return materialise(own.where("parent is not null").join(found, "v", "left").select("v", "parent", F.coalesce("component", "v").alias("label")), "edge-labels", FEW)


def _named(block: DataFrame, rest: DataFrame) -> DataFrame:
    """(src, dst, block_src, block_dst) of the tree edges ``block`` and the other edges ``rest``.

    An edge that isn't in the tree has the block of its end that comes later in preorder, which isn't above the other.
    """
    later = F.when(F.col("ps") > F.col("pd"), F.col("src")).otherwise(F.col("dst"))
    at = rest.select(later.alias("v"), "src", "dst").groupBy("v").agg(F.min(F.when(F.col("v") == F.col("src"), F.col("dst"))).alias("d"), F.min(F.when(F.col("v") == F.col("dst"), F.col("src"))).alias("s"))
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    v, s, d = F.col("v"), F.col("s"), F.col("d")
    first = F.least(edge(F.least("v", "parent"), F.greatest("v", "parent")), F.when(d.isNotNull(), edge(v, d)), F.when(s.isNotNull(), edge(s, v)))
    names = block.join(at, "v", "left").groupBy("label").agg(F.min(first).alias("first"))
    named = materialise(block.join(names, "label").select("v", "parent", F.col("first.src").alias("block_src"), F.col("first.dst").alias("block_dst")), "named", FEW)
    tree = named.select(F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst"), "block_src", "block_dst")
    return tree.union(rest.select("src", "dst", later.alias("v")).join(named.select("v", "block_src", "block_dst"), "v").select("src", "dst", "block_src", "block_dst"))


@tidy("blocks")
def edge_blocks(graph: Graph, certificate_first: bool = False, deep: bool = False, tree: DataFrame | None = None) -> DataFrame:
    """(src, dst, block_src, block_dst): each edge and the smallest edge of its block.

    ``certificate_first`` finds the blocks on a sparse certificate, which has at most two edges a vertex, and gives each
    edge left out the block that holds both its ends. ``deep`` is for graphs of large diameter, such as meshes: the tree isn't breadth-first, which
    takes a round a level, but any spanning forest, whose rounds are logarithmic. ``tree`` is the breadth-first forest, if it is known.
    """
    graph = graph.stored()
    if certificate_first:
        return _on_certificate(graph)
    own, rest = labelled(graph, rooted(forest_edges(graph)) if deep else numbered(spanning_forest(graph) if tree is None else tree))
    return _named(_tree_blocks(own, rest), rest)


def _on_certificate(graph: Graph) -> DataFrame:
    """The certificate's first forest spans the graph, and its blocks have the same vertices; so it serves for the edges left out, too."""
    from .certificate import non_tree_forest

    tree = spanning_forest(graph)
    kept = Graph(tree_edges(tree).union(tree_edges(non_tree_forest(graph, tree)))).stored()
    numbers = numbered(tree)
    block = _tree_blocks(*labelled(kept, numbers))
    return _named(block, materialise(across(graph, numbers), "across"))


def articulation_points(blocks: DataFrame) -> DataFrame:
    """(v): vertices whose edges lie in two blocks or more."""
    ends = blocks.select(F.explode(F.array("src", "dst")).alias("v"), "block_src", "block_dst")
    # plain numbers are aggregated by hash, structs would be sorted
    lows, highs = [F.min(c).alias(f"low_{c}") for c in ("block_src", "block_dst")], [F.max(c).alias(f"high_{c}") for c in ("block_src", "block_dst")]
    return ends.groupBy("v").agg(*lows, *highs).where("low_block_src <> high_block_src or low_block_dst <> high_block_dst").select("v")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(block_src, block_dst, edges)."""
    return blocks.groupBy("block_src", "block_dst").agg(F.count(F.lit(1)).alias("edges"))


def bridges(blocks: DataFrame) -> DataFrame:
    """(src, dst) of the blocks of one edge."""
    return block_sizes(blocks).where("edges = 1").select(F.col("block_src").alias("src"), F.col("block_dst").alias("dst"))


def bridges_by_labels(own: DataFrame) -> DataFrame:
    """(src, dst) of the tree edges that no non-tree edge spans: those whose lower subtree reaches nothing outside."""
    return tree_edges(own.where("parent is not null and low >= pre and high < pre + n_desc"))


def counts(blocks: DataFrame) -> DataFrame:
    """One row: numbers of articulation points, blocks and bridges."""
    sizes = block_sizes(blocks).agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("edges") == 1, 1)).alias("bridges"), F.coalesce(F.max("edges"), F.lit(0)).alias("largest_block"))
    points = articulation_points(blocks).agg(F.count(F.lit(1)).alias("articulation_points"))
    return points.withColumn("row", F.lit(1)).join(sizes.withColumn("row", F.lit(1)), "row").drop("row")


def largest_block(blocks: DataFrame) -> DataFrame:
    """The edges (src, dst) of the largest block; of equal ones, that with the smallest name."""
    top = block_sizes(blocks).orderBy(F.desc("edges"), "block_src", "block_dst").limit(1)
    return blocks.join(top, ["block_src", "block_dst"], "left_semi").select("src", "dst")


def block_of_first_edge(blocks: DataFrame, root: int) -> DataFrame:
    """The edges (src, dst) of the block of the edge from ``root`` to its smallest neighbour."""
    own = blocks.where((F.col("src") == root) | (F.col("dst") == root))
    top = own.orderBy(F.when(F.col("src") == root, F.col("dst")).otherwise(F.col("src"))).limit(1)
    return blocks.join(top, ["block_src", "block_dst"], "left_semi").select("src", "dst")


@tidy("vertex-labels", FEW)
def vertex_labels(graph: Graph) -> DataFrame:
    """(v, high, low): of the block of the tree edge above v, its head and its smallest other vertex; roots have none."""
    graph = graph.stored()
    own, rest = labelled(graph, numbered(spanning_forest(graph)))
    found = tied(auxiliary_links(own, rest))[0]
    met = materialise(own.where("parent is not null").join(found, "v", "left").select("v", "parent", "level", F.coalesce("component", "v").alias("label")), "met", FEW)
    head = met.groupBy("label").agg(F.min_by("parent", "level").alias("high"), F.min("v").alias("low"))
    return met.join(head, "label").select("v", "high", "low")


def labels_from_vertices(graph: Graph, marks: DataFrame) -> DataFrame:
    """(src, dst, head, low) of each edge from its ends' (high, low): the block of the end whose head is the other, or which both share."""
    u, w = marks.toDF("src", "hu", "lu"), marks.toDF("dst", "hw", "lw")
    met = graph.edges.join(u, "src", "left").join(w, "dst", "left")
    from_w, from_u = F.col("hw") == F.col("src"), F.col("hu") == F.col("dst")
    head = F.when(from_w, F.col("hw")).when(from_u, F.col("hu")).otherwise(F.col("hu"))
    low = F.when(from_w, F.col("lw")).when(from_u, F.col("lu")).otherwise(F.col("lu"))
    return met.select("src", "dst", head.alias("head"), low.alias("low"))


def unlabelled(graph: Graph, marks: DataFrame) -> DataFrame:
    """Vertices with an edge that have neither labels nor a child that has them; none, if labelling is complete."""
    done = marks.select("v").union(marks.select("high"))
    return graph.edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().join(done, "v", "left_anti")


@tidy("candidates", FEW)
def candidates(graph: Graph, tree: DataFrame | None = None) -> DataFrame:
    """(v): lowest common ancestors of non-tree edges and ends of bridges; all articulation points are among them.

    Bridges are the tree edges that no other edge's path goes over. ``tree`` is the breadth-first forest, if it is known.
    """
    graph = graph.stored()
    tree = spanning_forest(graph) if tree is None else tree
    found = materialise(tops(tree, graph.edges), "tops", FEW)
    free = tree_edges(over(graph, tree, found).where("over = 0"))
    return found.select("v").union(free.select(F.explode(F.array("src", "dst")))).distinct()


@tidy("points")
def points_on_forest(graph: Graph) -> DataFrame:
    """(v): articulation points straight from the labels, without naming blocks.

    A vertex with a parent cuts off a child whose subtree reaches nothing outside its own; a root cuts if its child edges lie in
    several blocks.
    """
    graph = graph.stored()
    own, rest = labelled(graph, numbered(spanning_forest(graph)))
    up = own.select(F.col("v").alias("parent"), F.col("pre").alias("pre_up"), F.col("n_desc").alias("n_up"), F.col("parent").isNull().alias("top"))
    met = own.where("parent is not null").join(up, "parent")
    inner = met.where("not top and low >= pre_up and high < pre_up + n_up").select(F.col("parent").alias("v"))
    found = tied(auxiliary_links(own, rest))[0]
    tops = met.where("top").join(found, "v", "left").groupBy("parent").agg(F.countDistinct(F.coalesce("component", "v")).alias("n")).where("n > 1").select(F.col("parent").alias("v"))
    return inner.union(tops).distinct()
