"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour seen from a vertex and keeps components as
they are; the edge table turns into stars around the smallest vertex of each component after a number of
rounds that grows with the logarithm of its diameter (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Both steps are a grouped minimum, which is combined before the shuffle, and an
equi-join back to the edges, whose frequent keys adaptive execution splits. Lineage is cut once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import FEW, Table
from .graph import Graph


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the smallest of the vertex and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    lower = edges.join(least, "b")
    moved = lower.where("a > m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct().toDF("a", "b")


def _links(edges: DataFrame, few: int | None) -> Table:
    """The edges written out, with their count and an order-free checksum."""
    return Table(edges, "links", few=few, n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def _ascending(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _contract(slim: DataFrame, max_rounds: int, few: int | None = None) -> DataFrame:
    """(v, component) of every vertex of ``slim`` (a < b, distinct) that isn't the smallest of its component."""
    now = _links(slim, few)
    for _ in range(max_rounds):
        if not now.found["n"]:
            break
        before = now
        now = _links(small_star(large_star(before.df)), few)
        before.drop()
        if now.found == before.found:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.df.select(F.col("b").alias("v"), F.col("a").alias("component"))


def _hooked(around: Table) -> Table:
    """(v, root, chance, low, high) of the vertices of ``around``: where the way from each to its smallest smaller neighbour, and so on, ends.

    Only vertices that such a way leads through take part in the rounds of pointer doubling; ids fall along it, so it is no circle.
    """
    up = F.least("v", "least").alias("up")
    ways = around.df.select("v", up).join(around.df.select(up).distinct().toDF("v"), "v", "left_semi")
    now = Table(ways.withColumn("moved", F.col("up") != F.col("v")), "hooks", few=FEW, moved=F.count_if("moved"))
    while now.found["moved"]:
        before = now
        own = before.df.select("v", "up")
        moved = own.join(own.toDF("up", "up2"), "up").select("v", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved"))
        now = Table(moved, "hooks", few=FEW, moved=F.count_if("moved"))
        before.drop()
    ends = around.plain.select("v", up, "chance", "low", "high").join(now.df.select(F.col("v").alias("up"), F.col("up").alias("root")), "up")
    return Table(ends.select("v", "root", "chance", "low", "high"), "hooked", few=FEW)


def tied(edges: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, Table]:
    """What ``stars`` gives, for many edges a vertex, and the table (v, n, ...) of all vertices with their numbers of edge ends; its ``found`` counts them.

    One pass over the edges picks two neighbours of each vertex, the smallest and one by chance. The first lead each vertex to a root, and only links between roots by the others are contracted. The same pass
    sums 64-bit hashes of each vertex's edges, with opposite signs at the two ends: over a whole component they cancel. Where
    they don't, edges lead on, and those between the parts found are contracted in turn; so all edges count, but few are shuffled.
    """
    slim, chance = _ascending(edges), F.xxhash64("v")
    mark = F.xxhash64("a", "b")
    low, high = mark.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mark, 32)
    end = lambda v, u, sign: F.struct(F.col(v).alias("v"), F.col(u).alias("u"), (low * sign).alias("low"), (high * sign).alias("high"))
    ends = slim.select(F.inline(F.array(end("a", "b", 1), end("b", "a", -1))))
    picks = (F.min("u").alias("least"), F.min(F.col("u").bitwiseXOR(chance)).alias("chance"))
    summed = ends.groupBy("v").agg(*picks, F.sum("low").alias("low"), F.sum("high").alias("high"), F.count(F.lit(1)).alias("n"))
    around = Table(summed.withColumn("chance", F.col("chance").bitwiseXOR(chance)), "ends", few=FEW, vertices=F.count(F.lit(1)))
    hooked = _hooked(around)
    links = hooked.df.select(F.col("root").alias("a"), F.col("chance").alias("v")).join(hooked.df.select("v", F.col("root").alias("b")), "v").select("a", "b")
    tops = _contract(_ascending(links).distinct(), max_rounds, FEW).toDF("root", "top")
    parts = Table(hooked.plain.join(tops, "root", "left").select("v", F.coalesce("top", "root").alias("component"), "low", "high"), "parts", few=FEW).df
    names = parts.where("v <> component").select("v", "component")
    unsettled = Table(parts.groupBy("component").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).where("low <> 0 or high <> 0").select("component"), "unsettled", few=FEW, n=F.count(F.lit(1)))
    if unsettled.found["n"]:
        own = Table(parts.join(unsettled.df, "component", "left_semi").select("v", "component"), "parts", few=FEW).df
        between = slim.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        more = _contract(_ascending(between).distinct(), max_rounds, FEW).toDF("component", "top")
        names = Table(parts.join(more, "component", "left").select("v", F.coalesce("top", "component").alias("component")).where("v <> component"), "names", few=FEW).df
    return names, around


def stars(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (columns a, b) that isn't the smallest of its component."""
    return _contract(_ascending(edges).distinct(), max_rounds)


def components(graph: Graph) -> DataFrame:
    """(v, component): the smallest id of each vertex's component."""
    if graph.extra is None:
        found, around = tied(graph.edges.toDF("a", "b"))
        return around.df.select("v").join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
    found = stars(graph.edges.toDF("a", "b"))
    return graph.vertices.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def max_label_components(graph: Graph) -> DataFrame:
    """(v, component) with the largest id of each component as its label."""
    own = components(graph)
    largest = own.groupBy("component").agg(F.max("v").alias("label"))
    return own.join(largest, "component").select("v", F.col("label").alias("component"))


def component_stats(labels: DataFrame) -> DataFrame:
    """One row: number of components, size of the largest, and how many have more than one vertex."""
    sizes = labels.groupBy("component").count()
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("count").alias("largest"), F.count(F.when(F.col("count") > 1, 1)).alias("nontrivial"))


def largest_component(labels: DataFrame) -> DataFrame:
    """(component, size) of the largest component; of equal ones, that with the largest label."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), F.desc("component")).limit(1)


def keep_largest(graph: Graph) -> Graph:
    """The subgraph on the largest component."""
    labels = max_label_components(graph)
    return graph.induced(labels.join(largest_component(labels), "component", "left_semi"))


def component_of(graph: Graph, v: int) -> DataFrame:
    """(v) of all vertices that can be reached from one vertex."""
    labels = components(graph)
    return labels.join(labels.where(F.col("v") == v).select("component"), "component", "left_semi").select("v")


def wrong_labels(graph: Graph, labels: DataFrame) -> DataFrame:
    """Edges whose ends have different labels; none, if the labels are right."""
    ends = graph.edges.join(labels.toDF("src", "c1"), "src").join(labels.toDF("dst", "c2"), "dst")
    return ends.where("c1 <> c2").select("src", "dst")
