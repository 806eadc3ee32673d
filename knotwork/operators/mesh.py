"""Quad meshes: edges, boundaries, grounded nodes, and parts that float or hang by one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import edge_blocks
from .components import components, keep_largest
from .graph import Graph, canonical


def quad_edges(quads: DataFrame) -> DataFrame:
    """(src, dst) of the four sides of each quad (q, n1, n2, n3, n4)."""
    sides = F.array(*[F.struct(F.col(f"n{i}").alias("src"), F.col(f"n{i % 4 + 1}").alias("dst")) for i in range(1, 5)])
    return canonical(quads.select(F.explode(sides).alias("e")).select("e.src", "e.dst"))


def boundary_nodes(border: DataFrame) -> DataFrame:
    """(v): nodes on more than two border edges (a, b)."""
    return border.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count().where("count > 2").select("v")


def sensitive_ground(quads: DataFrame, grounded: DataFrame, least: int) -> DataFrame:
    """(v): grounded nodes that have a quad with at least ``least`` grounded corners; all of them if ``least`` is below 2."""
    if least < 2:
        return grounded.select("v").distinct()
    corners = quads.select("q", F.explode(F.array("n1", "n2", "n3", "n4")).alias("v"))
    on = corners.join(grounded.select("v").distinct(), "v", "left_semi")
    enough = on.groupBy("q").count().where(F.col("count") >= least).select("q")
    return on.join(enough, "q", "left_semi").select("v").distinct()


def ice_status(graph: Graph, grounded: DataFrame) -> DataFrame:
    """(v, status, hinge) of each node: kept, hinged or floating.

    With a ground vertex tied to all grounded nodes, a node is kept if it shares a block of several edges with the ground, hinged
    if it is connected to the ground otherwise, and floating if it isn't. A hinged node's hinge is the last kept node on its way to
    the ground, or the one grounded node of its part.
    """
    graph = graph.stored()
    ground = -1
    ties = grounded.select("v").distinct().join(graph.vertices, "v", "left_semi")
    tied = Graph(graph.edges.union(ties.select(F.lit(ground).cast("long").alias("src"), F.col("v").alias("dst"))), graph.extra).stored()
    blocks = edge_blocks(tied, deep=True)
    sizes = blocks.groupBy("block_src", "block_dst").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("src") == ground).cast("int")).alias("grounded"))
    solid = sizes.where("n > 1 and grounded = 1").select("block_src", "block_dst")
    kept = blocks.join(solid, ["block_src", "block_dst"], "left_semi").select(F.explode(F.array("src", "dst")).alias("v")).where(F.col("v") != ground).distinct()
    loose = Graph(graph.induced(graph.vertices.join(kept, "v", "left_anti")).edges, graph.vertices.join(kept, "v", "left_anti"))
    parts = components(loose.stored())
    to_kept = graph.sym.join(parts.withColumnRenamed("v", "a"), "a").join(kept.withColumnRenamed("v", "b"), "b", "left_semi").select("component", F.col("b").alias("hinge"))
    own_ground = parts.join(ties, "v", "left_semi").select("component", F.col("v").alias("hinge"))
    hinge = to_kept.union(own_ground).groupBy("component").agg(F.min("hinge").alias("hinge"))
    hung = parts.join(hinge, "component", "left").select("v", F.when(F.col("hinge").isNull(), F.lit("floating")).otherwise(F.lit("hinged")).alias("status"), "hinge")
    return kept.select("v", F.lit("kept").alias("status"), F.lit(None).cast("long").alias("hinge")).union(hung)


def removed_nodes(status: DataFrame) -> DataFrame:
    """(node): nodes that are not kept, counted from 1."""
    return status.where("status <> 'kept'").select((F.col("v") + 1).alias("node"))


def without_islands(graph: Graph) -> Graph:
    """The largest connected part of a mesh."""
    return keep_largest(graph)
