"""The graph value: canonical undirected edges, optional isolated vertices, and what follows from them directly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import dense_ids, range_of, running_sum
from ..plans.storage import materialise


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst) with src < dst, each edge once; self loops and edges with a null end are dropped."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), a.isNotNull().alias("x"), b.isNotNull().alias("y")).where("x and y and src < dst").select("src", "dst").distinct()


@dataclass(frozen=True)
class Graph:
    """An undirected simple graph. ``edges`` has src < dst; ``extra`` may name vertices without edges."""

    edges: DataFrame
    extra: DataFrame | None = None
    #: Whether ``edges`` just reads a table.
    written: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst") -> Graph:
        """A graph from any edge table: both directions, repetitions and self loops are allowed."""
        own = None if vertices is None else vertices.select(F.col(vertices.columns[0]).cast("long").alias("v")).where("v is not null").distinct()
        return Graph(canonical(edges, src, dst), own)

    @staticmethod
    def from_csr(offsets: list[int], neighbours: list[int], spark: object) -> Graph:
        """A graph from compressed rows: the neighbours of v are neighbours[offsets[v]:offsets[v + 1]]."""
        rows = [(v, int(u)) for v in range(len(offsets) - 1) for u in neighbours[offsets[v] : offsets[v + 1]]]
        vertices = spark.range(len(offsets) - 1).select(F.col("id").alias("v"))
        return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"), vertices)

    def stored(self) -> Graph:
        """The same graph with its edges written out, so that iterations don't derive them again."""
        return self if self.written else Graph(materialise(self.edges, "edges"), self.extra, True)

    @property
    def sym(self) -> DataFrame:
        """(a, b) in both directions."""
        return self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(self.edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))

    @property
    def vertices(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v"))
        return (ends if self.extra is None else ends.union(self.extra)).distinct()

    def degrees(self) -> DataFrame:
        """(v, degree); vertices without edges have degree 0."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v"), F.lit(1).alias("one"))
        if self.extra is not None:
            ends = ends.union(self.extra.select("v", F.lit(0)))
        return ends.groupBy("v").agg(F.sum("one").alias("degree"))

    def degree_stats(self) -> DataFrame:
        """One row: number of vertices and edges, largest and average degree."""
        return self.degrees().agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))

    def root(self) -> DataFrame:
        """(v, degree) of the vertex of largest degree, smallest id first."""
        return self.degrees().orderBy(F.desc("degree"), "v").limit(1)

    def neighbour_degrees(self) -> DataFrame:
        """(v, neighbour, degree): the degree of each vertex's neighbours, one row each."""
        return self.sym.join(self.degrees().withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), F.col("b").alias("neighbour"), "degree")

    def adjacency(self) -> DataFrame:
        """(v, neighbours): compressed rows as sorted arrays."""
        return self.sym.groupBy(F.col("a").alias("v")).agg(F.sort_array(F.collect_list("b")).alias("neighbours"))

    def without(self, edges: DataFrame) -> Graph:
        """The graph without some canonical edges."""
        return Graph(self.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"), self.extra)

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph on the vertices ``keep`` (v)."""
        own = keep.select("v")
        inside = self.edges.join(own.withColumnRenamed("v", "src"), "src", "left_semi").join(own.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
        return Graph(inside, own)

    def relabelled(self) -> tuple[Graph, DataFrame]:
        """The graph with dense ids from 0 in the order of the old ones, and the map (v, id)."""
        ids = materialise(dense_ids(self.vertices, "v"), "ids")
        ends = self.edges.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst")
        return Graph(canonical(ends, "a", "b"), ids.select(F.col("id").alias("v"))), ids


def edge_balanced(degrees: DataFrame, parts: int) -> DataFrame:
    """(v, part): contiguous id ranges of about equal numbers of edge ends.

    A vertex belongs to the part in which the edge ends of all smaller vertices end; parts are as even as vertices allow.
    """
    total = degrees.agg(F.sum("degree")).first()[0] or 1
    share = F.floor(F.col("before") * parts / total)
    return running_sum(degrees, "v", "degree").select("v", F.least(share, F.lit(parts - 1)).cast("long").alias("part"))


def by_starts(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """(v, part) of ``vertices`` by the first vertices of contiguous ``parts`` (v, part), one a part, instead of by a join."""
    starts = sorted(tuple(r) for r in parts.groupBy("part").agg(F.min("v")).select("min(v)", "part").collect())
    if not starts:
        return parts
    numbers = F.array(*[F.lit(p) for _, p in starts])
    return vertices.select("v", F.get(numbers, range_of(F.col("v"), [v for v, _ in starts]).cast("int")).cast("long").alias("part"))


def spread_ids(v: object, n: int, tasks: int, clamp: bool = True) -> object:
    """A column that permutes ids so that neighbours in id order fall into different blocks of n / tasks.

    Results end at n - 1, unless ``clamp`` is off; ids below n stay apart either way but for the last few, larger ones may meet (see ``room``).
    """
    v = F.col(v) if isinstance(v, str) else v
    spread = ((v % tasks) * (n // tasks + 1) + F.floor(v / tasks)).cast("long")
    return F.least(spread, F.lit(n - 1)).cast("long") if clamp else spread


def room(largest: int, tasks: int, n: int = 1 << 20) -> int:
    """``n``, doubled until ``spread_ids`` keeps ids up to ``largest`` apart."""
    while (tasks - 1) * (n // tasks + 1) + largest // tasks > n - 1:
        n *= 2
    return n


def by_part(graph: Graph, parts: DataFrame, n: int) -> DataFrame:
    """The directed edges, dealt to ``n`` partitions by the part (v, part) of their first end."""
    return graph.sym.join(parts.withColumnRenamed("v", "a"), "a").repartitionById(n, F.col("part").cast("int"))


def compare_sets(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many ids (v) are in both, only found, or only known."""
    both = found.select("v", F.lit(1).alias("f")).join(known.select("v", F.lit(1).alias("k")), "v", "full_outer")
    said = lambda c: F.count(F.when(c, 1))
    return both.agg(said(F.col("f").isNotNull() & F.col("k").isNotNull()).alias("correct"), said(F.col("k").isNull()).alias("false_positive"), said(F.col("f").isNull()).alias("false_negative"))
