"""Files of quad meshes, their borders and their grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import head, number, numbered, words


def quad_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(quads (q, n1..n4), border (a, b)) of a file with a title, counts, node lines, quad lines and border lines; ids from 0."""
    x, y, z = (int(w) for w in head(spark, path, 2)[1][:3])
    rows = numbered(spark, path).select("line", words().alias("w"))
    corners = [(number(F.col("w"), i) - 1).alias(f"n{i + 1}") for i in range(4)]
    quads = rows.where(F.col("line").between(2 + x, 1 + x + y)).select((F.col("line") - 2 - x).alias("q"), *corners)
    border = rows.where(F.col("line").between(2 + x + y, 1 + x + y + z)).select((number(F.col("w"), 0) - 1).alias("a"), (number(F.col("w"), 1) - 1).alias("b"))
    return quads, border


def border_edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of a border file: two words, three counts (nodes, lines to skip, edges), so many lines, then ``a b flag``; ids from 0."""
    first = [w for line in head(spark, path, 2) for w in line]
    nodes, skip = int(first[2]), int(first[3])
    rows = numbered(spark, path).where(F.col("line") >= 2 + nodes + skip).where("trim(value) <> ''").select(words().alias("w"))
    return rows.select((number(F.col("w"), 0) - 1).alias("a"), (number(F.col("w"), 1) - 1).alias("b"))


def grounded_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(v) with a positive number in a file of the number of nodes and a number for each."""
    rows = numbered(spark, path).where("trim(value) <> ''")
    return rows.where("line > 0 and cast(trim(value) as double) > 0").select((F.col("line") - 1).alias("v"))


def write_quad_mesh(quads: DataFrame, border: DataFrame, nodes: int, path: str) -> None:
    """A mesh file of ``nodes`` nodes (q, n1..n4 and a, b count from 0; places of nodes are written as 0 0 0)."""
    spark = quads.sparkSession
    counts = f"{nodes} {quads.count()} {border.count()}"
    first = spark.createDataFrame([("mesh",), (counts,)], "value string").coalesce(1)
    points = spark.range(nodes).select(F.lit("0 0 0").alias("value"))
    corners = quads.repartitionByRange("q").sortWithinPartitions("q").select(F.concat_ws(" ", *[F.col(f"n{i}") + 1 for i in range(1, 5)]))
    first.union(points).union(corners).union(border.select(F.concat_ws(" ", F.col("a") + 1, F.col("b") + 1))).write.text(path)


def write_grounded(grounded: DataFrame, nodes: int, path: str) -> None:
    """A file of the number of nodes, and 1.0 or 0.0 for each."""
    spark = grounded.sparkSession
    own = spark.range(nodes).join(grounded.select(F.col("v").alias("id"), F.lit("1.0").alias("x")).distinct(), "id", "left")
    rows = own.repartitionByRange("id").sortWithinPartitions("id").select(F.coalesce("x", F.lit("0.0")).alias("value"))
    spark.range(1, numPartitions=1).select(F.lit(str(nodes)).alias("value")).union(rows).write.text(path)


def write_border(border: DataFrame, nodes: int, path: str) -> None:
    """A border file without lines to skip but those of the nodes: two words, three counts, the nodes, then ``a b 1``."""
    spark = border.sparkSession
    first = spark.createDataFrame([("border edges",), (f"{nodes} 0 {border.count()}",)], "value string").coalesce(1)
    points = spark.range(nodes).select(F.lit("0 0 0").alias("value"))
    first.union(points).union(border.select(F.concat_ws(" ", F.col("a") + 1, F.col("b") + 1, F.lit(1)))).write.text(path)
