"""Graph generators. All randomness is md5 of keys, so any engine gives the same graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .graph import canonical

#: Quadrant shares of the recursive matrix (fixed values): a, b, c; the rest is d. Each level varies them by 5 %.
QUADRANTS = (0.45, 0.15, 0.15)


def uniform(spark: SparkSession, n: int, edges: int, seed: str = "u") -> DataFrame:
    """About ``edges`` edges between uniformly drawn vertices of n; loops and repetitions fall away."""
    i = spark.range(edges)
    return canonical(i.select((hash32(seed, "s", F.col("id")) % n).alias("src"), (hash32(seed, "d", F.col("id")) % n).alias("dst")))


def recursive_matrix(spark: SparkSession, scale: int, edges: int, seed: str = "r") -> DataFrame:
    """Edges between 2**scale vertices; each of ``scale`` levels picks a quadrant of the adjacency matrix."""
    a, b, c = QUADRANTS
    level = F.explode(F.sequence(F.lit(0), F.lit(scale - 1))).alias("level")
    drawn = spark.range(edges).select("id", level)
    drawn = drawn.select("id", "level", (hash32(seed, F.col("level"), F.col("id")) / float(1 << 32)).alias("u"), ((hash32(seed, "n", F.col("level"), F.col("id")) % 1001 - 500) / 10000.0).alias("shift"))
    pa, pb, pc = F.lit(a) * (1 + F.col("shift")), F.lit(b) * (1 - F.col("shift")), F.lit(c) * (1 - F.col("shift"))
    u = F.col("u")
    right = (u >= pa) & (u < pa + pb) | (u >= pa + pb + pc)
    bits = drawn.select("id", F.expr(f"shiftleft(1L, {scale - 1} - level)").alias("bit"), (u >= pa + pb).cast("long").alias("down"), right.cast("long").alias("right"))
    return canonical(bits.groupBy("id").agg(F.sum(F.col("bit") * F.col("down")).alias("src"), F.sum(F.col("bit") * F.col("right")).alias("dst")))


def high_diameter(spark: SparkSession, n: int, degree: int, reach: int, seed: str = "h") -> DataFrame:
    """A path 0, 1, ..., n - 1 with ``degree`` more edges a vertex to one of the ``reach`` vertices before it."""
    i = spark.range(1, n)
    path = i.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    more = i.select("id", F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("k")).select("id", (F.col("id") - 1 - hash32(seed, F.col("id"), F.col("k")) % reach).alias("to"))
    return canonical(path.union(more.where("to >= 0").select("to", "id")))


def ring_with_chords(spark: SparkSession, n: int, every: int, seed: str = "c") -> DataFrame:
    """A cycle of n vertices and, from about one in ``every``, a chord to a drawn vertex."""
    i = spark.range(n)
    ring = i.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    chords = i.where(hash32(seed, "p", F.col("id")) % every == 0).select(F.col("id").alias("src"), (hash32(seed, "q", F.col("id")) % n).alias("dst"))
    return canonical(ring.union(chords))


def block_model(spark: SparkSession, n: int, block: int, inside: float, between: int, seed: str = "b") -> tuple[DataFrame, DataFrame]:
    """(edges, communities): blocks of ``block`` vertices, dense inside, and ``between`` edges drawn by degree across them.

    Inside a block each pair is joined with chance ``inside``; ends of the other edges are drawn in proportion to 1 / (1 + place in the block).
    """
    own = spark.range(n).select(F.col("id").alias("v"), F.floor(F.col("id") / block).cast("long").alias("community"))
    other = F.explode(F.sequence(F.col("v") + 1, F.least((F.col("community") + 1) * block - 1, F.lit(n - 1)))).alias("w")
    pairs = own.where((F.col("v") + 1) <= F.least((F.col("community") + 1) * block - 1, F.lit(n - 1))).select("v", other)
    dense = pairs.where(hash32(seed, F.col("v"), F.col("w")) < int(inside * (1 << 32))).toDF("src", "dst")

    def end(side: str) -> object:
        u = hash32(seed, side, F.col("id")) / float(1 << 32)
        place = F.floor(F.pow(F.lit(float(block + 1)), u) - 1)
        return F.least(F.floor(hash32(seed, side, "c", F.col("id")) % (-(-n // block))) * block + place, F.lit(n - 1)).cast("long")

    across = spark.range(between).select(end("s").alias("src"), end("d").alias("dst"))
    return canonical(dense.union(across)), own


def clustered(spark: SparkSession, distribution: DataFrame, seed: str = "w") -> tuple[DataFrame, DataFrame]:
    """(edges, communities) that follow a distribution (d, nd, cd): nd vertices of degree d with clustering cd.

    Vertices are listed by degree; each run of d + 1 vertices of degree d becomes a block whose pairs are joined with chance cbrt(cd). What is
    left of each degree is as many stubs, one at least; every second stub of a vertex is joined with one drawn from all, so both ends of edges across blocks follow
    what is left.
    """
    from ..functions.prefix import running_sum

    starts = running_sum(distribution.where("nd > 0"), "d", "nd", "first")
    vertex = starts.select("d", "cd", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nd") - 1)).alias("i")).select((F.col("first") + F.col("i")).alias("v"), "d", "cd", (F.col("first") * 2 + 1 + F.floor(F.col("i") / (F.col("d") + 1)) * 2 * (F.col("d") + 1)).cast("long").alias("community"), (F.col("i") % (F.col("d") + 1)).alias("place"), (F.col("first") + F.col("i") - F.col("i") % (F.col("d") + 1)).alias("head"))
    pairs = vertex.where("d > 1 and place > 0").select("v", "cd", F.explode(F.sequence("head", F.col("v") - 1)).alias("w"))
    dense = pairs.where(hash32(seed, F.col("v"), F.col("w")) < F.cbrt("cd") * (1 << 32)).select(F.col("w").alias("src"), F.col("v").alias("dst"))
    stubs = vertex.select("v", F.greatest(F.lit(1), F.round(F.col("d") * (1 - F.cbrt("cd")))).cast("int").alias("k"))
    every = running_sum(stubs, "v", "k").select("v", "before", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j")).select("v", "j", (F.col("before") + F.col("j") - 1).alias("stub"))
    total = stubs.agg(F.sum("k")).first()[0] or 1
    drawn = every.where(F.col("j") % 2 == 1).select(F.col("v").alias("src"), (hash32(seed, "x", F.col("v"), F.col("j")) % total).alias("stub"))
    across = drawn.join(every.select("stub", F.col("v").alias("dst")), "stub").select("src", "dst")
    return canonical(dense.union(across)), vertex.select("v", "community")


def ice_mesh(spark: SparkSession, size: int, chains: int, chain_length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quads, grounded, answer): a grid of size x size quads on the ground with ``chains`` chains of quads that hang by a corner.

    Chain c starts at the node (c * size div chains, 0) of the lower side; its quads hang from one another by opposite corners. Every second
    chain has one grounded node at its end. All nodes of chains but the first are the answer: they are to be removed.
    """
    w = size + 1
    grid = spark.range(size * size).select(F.col("id").alias("q"), (F.floor(F.col("id") / size) * w + F.col("id") % size).cast("long").alias("n1"))
    quads = grid.select("q", "n1", (F.col("n1") + 1).alias("n2"), (F.col("n1") + w + 1).alias("n3"), (F.col("n1") + w).alias("n4"))
    base = w * w
    c, k = F.floor(F.col("id") / chain_length), F.col("id") % chain_length
    first = F.when(k == 0, F.floor(c * size / chains)).otherwise(base + F.col("id") * 3 - 2)
    hung = spark.range(chains * chain_length).select((F.col("id") + size * size).alias("q"), first.cast("long").alias("n1"), (F.col("id") * 3 + base).alias("n2"), (F.col("id") * 3 + base + 1).alias("n3"), (F.col("id") * 3 + base + 2).alias("n4"))
    ends = spark.range(chains).where("id % 2 = 0").select(((F.col("id") * chain_length + chain_length - 1) * 3 + base + 1).alias("v"))
    grounded = spark.range(w * w).select(F.col("id").alias("v")).union(ends)
    answer = spark.range(chains * chain_length * 3).select((F.col("id") + base).alias("v"))
    return quads.union(hung), grounded, answer
