"""Pairs of vertices whose removal disconnects a graph without cut vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import dense_ids, running_sum_within
from ..plans.storage import materialise, tidy
from .blocks import articulation_points, edge_blocks
from .graph import Graph


def degree_two_pairs(graph: Graph) -> DataFrame:
    """(v, a, b): the two neighbours of each vertex of degree 2; they separate it from the rest."""
    around = graph.sym.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("a"), F.max("b").alias("b"))
    return around.where("n = 2").select("v", "a", "b")


@tidy("twins")
def twins(graph: Graph) -> DataFrame:
    """(v, twin): the smallest vertex that has the same neighbours as v, by their number and a checksum; where a comparison of all neighbours denies it, v itself."""
    around = graph.sym
    mark = materialise(around.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("mark")), "marks")
    named = mark.join(mark.groupBy("n", "mark").agg(F.min("v").alias("twin")), ["n", "mark"]).select("v", "twin", "n")
    asked = named.where("v <> twin").join(around.withColumnRenamed("a", "v"), "v")
    same = asked.join(around.toDF("twin", "b"), ["twin", "b"]).groupBy("v", "n").count().where("count = n").select("v", F.lit(True).alias("same"))
    return named.join(same, "v", "left").select("v", F.when(F.col("same"), F.col("twin")).otherwise(F.col("v")).alias("twin"))


@tidy("separation-pairs")
def separation_pairs(graph: Graph) -> DataFrame:
    """(a, b) with a < b: b cuts the graph without a.

    Vertices with the same neighbours can be exchanged, so one of them stands for all. Three are kept: of more, at least one is left when two
    vertices go, and ties together what the others did; so the rest changes no answer. All graphs without one of the vertices that stand
    for others are searched at once, as components of one graph whose vertices are pairs; what holds of two such classes holds of all pairs of their members. The
    work is the number of classes times that of edges kept, and the search is meant for graphs without cut vertices.
    """
    graph = graph.stored()
    kin = materialise(twins(graph), "twins")
    ranked = running_sum_within(kin.withColumn("one", F.lit(1).cast("long")), "twin", "v", "one", "rank")
    kept = materialise(ranked.where("rank < 3").select("v", "twin"), "kept")
    small = graph.induced(kept).edges
    # vertices that stand for their class have the first ids
    first = materialise(dense_ids(kept.where("v = twin"), "v"), "ids")
    classes = first.count()
    ids = materialise(first.union(dense_ids(kept.where("v <> twin"), "v").select("v", F.col("id") + classes)).join(kept, "v"), "ids")
    n = max(1, ids.count())
    ends = small.join(ids.select(F.col("v").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("v").alias("dst"), F.col("id").alias("d")), "dst").select("s", "d")
    copies = ends.select("s", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(classes, 1) - 1).cast("long"))).alias("x")).where("x <> s and x <> d")
    many = Graph(copies.select((F.col("x") * n + F.least("s", "d")).alias("src"), (F.col("x") * n + F.greatest("s", "d")).alias("dst")))
    cut = articulation_points(edge_blocks(many)).select(F.floor(F.col("v") / n).cast("long").alias("i"), (F.col("v") % n).alias("j"))
    named = cut.join(ids.select(F.col("id").alias("i"), F.col("twin").alias("x")), "i").join(ids.select(F.col("id").alias("j"), F.col("twin").alias("y")), "j").select("x", "y").distinct()
    return named.join(kin.toDF("a", "x"), "x").join(kin.toDF("b", "y"), "y").where("a < b").select("a", "b")
