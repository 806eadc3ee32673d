"""Text files by line, with line numbers where a format needs them; nothing here passes through Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line."""
    return spark.read.text(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with lines counted from 0 over all files of ``path`` by name.

    A first job counts the lines of each split of a file; what comes before a split, one row each, is added up on the driver.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = lines(spark, path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("row"))
    found = rows.groupBy("at").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    bases, before = [], 0
    for r in sorted(found, key=lambda r: (r["at"]["file"], r["at"]["start"])):
        bases.append((r["at"]["file"], r["at"]["start"], before - r["first"]))
        before += r["n"]
    base = spark.createDataFrame(bases, "file string, start long, base long").select(F.struct("file", "start").alias("at"), "base")
    return rows.join(F.broadcast(base), "at").select((F.col("row") + F.col("base")).alias("line"), "value")


def words(value: str | Column = "value") -> Column:
    """The words of a line as an array."""
    return F.split(F.trim(F.col(value) if isinstance(value, str) else value), r"\s+")


def number(array: Column, i: int) -> Column:
    return F.get(array, F.lit(i)).cast("long")


def head(spark: SparkSession, path: str, n: int) -> list[list[str]]:
    """The words of the first n lines."""
    rows = numbered(spark, path).where(F.col("line") < n).orderBy("line").collect()
    return [r["value"].split() for r in rows]


def files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or pattern names, or that the folders hold which it names, by name."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(pattern) or []:
        found += [s.getPath() for s in fs.listStatus(status.getPath())] if status.isDirectory() else [status.getPath()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))
