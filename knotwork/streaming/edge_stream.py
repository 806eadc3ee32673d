"""Components of a growing graph: a stream of edge files, folded batch by batch into a table of stars.

The state is a table of (component, v) links, one version a batch, in a folder of the caller. A batch's new edges and the links so
far are contracted together, so a batch costs as much as the links it touches plus one pass over the state; a batch that is
run again after a failure starts from the version before it and gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.components import stars
from ..operators.graph import canonical


def edge_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(src, dst) of text edge files, as they appear in a folder; lines that start with % or # are skipped."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    words = rows.where(~F.col("value").rlike(r"^\s*([%#]|$)")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    return words.select(F.get("w", F.lit(0)).cast("long").alias("src"), F.get("w", F.lit(1)).cast("long").alias("dst"))


def version(state: str, batch: int) -> str:
    return f"{state}/version-{batch:010d}"


def latest(spark: SparkSession, state: str) -> DataFrame | None:
    """The newest complete version (v, component); None before the first batch."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(state)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(str(s.getPath().getParent()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{state}/version-*/_SUCCESS")) or [])
    return spark.read.parquet(done[-1]) if done else None


def fold(state: str) -> object:
    """The function of (edges, batch) that writes version ``batch``."""

    def run(edges: DataFrame, batch: int) -> None:
        spark = edges.sparkSession
        links = canonical(edges).toDF("a", "b")
        if batch > 0:
            links = links.union(spark.read.parquet(version(state, batch - 1)).select(F.col("component").alias("a"), F.col("v").alias("b")))
        stars(links).write.mode("overwrite").parquet(version(state, batch))

    return run


def stream_components(edges: DataFrame, state: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the components of all edges so far in ``state``; call ``start`` on it."""
    return edges.writeStream.foreachBatch(fold(state)).option("checkpointLocation", checkpoint)
