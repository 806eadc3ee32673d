"""Edge and vertex files: text, packed binary, adjacency; each reader gives a DataFrame of edges as they are listed.

Binary files are read as records of fixed length, which Spark splits at record borders, and decoded by column functions. They are
written through Spark's text writer, whose commit keeps half-written files away: the last byte of each chunk serves as the separator that the writer ends
rows with, so that the files hold nothing but the format's words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import running_sum
from ..operators.graph import Graph
from ..plans.storage import Table
from .lines import files, head, lines, number, numbered, words


def text_with_header(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file whose first line has the numbers of vertices and edges; ids from 0."""
    n, m = (int(x) for x in head(spark, path, 1)[0][:2])
    rows = numbered(spark, path).where("line > 0 and trim(value) <> ''").select(words().alias("w"))
    found = Table(rows.select(number(F.col("w"), 0).alias("src"), number(F.col("w"), 1).alias("dst")), "edges", n=F.count(F.lit(1)))
    if found.found["n"] != m:
        raise ValueError(f"{path} announces {m} edges of {n} vertices and lists another number")
    return found.df


def text_edges(spark: SparkSession, path: str, comments: str = "%#") -> DataFrame:
    """(src, dst) of a file without header; lines that start with one of ``comments`` are skipped."""
    rows = lines(spark, path).where(~F.col("value").rlike(rf"^\s*([{comments}]|$)")).select(words().alias("w"))
    return rows.select(number(F.col("w"), 0).alias("src"), number(F.col("w"), 1).alias("dst"))


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(value) of the records of ``size`` bytes of all files of ``path``, in order of the files' names."""
    sc, session = spark.sparkContext, spark._jsparkSession
    named = files(spark, path)
    if not named:
        raise FileNotFoundError(path)
    rows = sc._jsc.sc().binaryRecords(",".join(named), size, sc._jsc.hadoopConfiguration())
    return DataFrame(session.createDataset(rows, sc._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)


def word(value: str, at: int, size: int) -> Column:
    """The little-endian unsigned integer of ``size`` bytes at byte ``at`` of a binary column; an error from 2**63 on."""
    code = F.hex(F.substring(value, at + 1, size))
    digits = F.concat(*[F.substring(code, 2 * k + 1, 2) for k in reversed(range(size))])
    if size < 8:
        return F.conv(digits, 16, 10).cast("long")
    return F.when(F.substring(digits, 1, 1) < "8", F.conv(digits, 16, 10).cast("long")).otherwise(F.raise_error(F.concat(F.lit("the id "), F.conv(digits, 16, 10), F.lit(" doesn't fit a signed 64-bit integer"))).cast("long"))


def packed_edges(spark: SparkSession, path: str, id_bytes: int = 4) -> DataFrame:
    """(src, dst) of little-endian unsigned pairs of 4 or 8 bytes; ``path`` may name many files, as by rank."""
    return records(spark, path, 2 * id_bytes).select(word("value", 0, id_bytes).alias("src"), word("value", id_bytes, id_bytes).alias("dst"))


def text_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file with a header line and a line of neighbours, counted from 1, for each vertex; ids from 0."""
    rows = numbered(spark, path).where("line > 0 and trim(value) <> ''").select((F.col("line") - 1).alias("src"), F.explode(words()).alias("w"))
    return rows.select("src", (F.col("w").cast("long") - 1).alias("dst"))


def binary_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of 64-bit words: n, 0, and the neighbours of each vertex plus 1, ended by 0; neighbours from 1, ids from 0.

    A word's vertex is the number of zeros before it less one, a prefix sum over the whole file.
    """
    rows = records(spark, path, 8).select(F.monotonically_increasing_id().alias("place"), word("value", 0, 8).alias("word"))
    words = rows.where("place > 0").withColumn("zero", (F.col("word") == 0).cast("long"))
    return running_sum(words, "place", "zero", "zeros").where("word > 0").select((F.col("zeros") - 1).alias("src"), (F.col("word") - 1).alias("dst"))


def vertex_ids(spark: SparkSession, path: str) -> DataFrame:
    """(v) of a file with one id a line."""
    return lines(spark, path).where("trim(value) <> ''").select(F.trim("value").cast("long").alias("v"))


def vertex_parts(spark: SparkSession, path: str) -> DataFrame:
    """(v, part) of a file whose line i has the part of vertex i."""
    return numbered(spark, path).where("trim(value) <> ''").select(F.col("line").alias("v"), F.trim("value").cast("long").alias("part"))


def degree_distribution(spark: SparkSession, degrees: str, clustering: str) -> DataFrame:
    """(d, nd, cd) of two files whose line d has the number of vertices of degree d and their clustering coefficient."""
    nd = numbered(spark, degrees).select(F.col("line").alias("d"), F.trim("value").cast("long").alias("nd"))
    cd = numbered(spark, clustering).select(F.col("line").alias("d"), F.trim("value").cast("double").alias("cd"))
    return nd.join(cd, "d", "left").select("d", "nd", F.coalesce("cd", F.lit(0.0)).alias("cd"))


def write_text_edges(edges: DataFrame, path: str) -> None:
    """A text file of ``src dst`` lines."""
    edges.select("src", "dst").write.option("sep", " ").csv(path)


def write_text_with_header(graph: Graph, path: str) -> None:
    """A text file with the numbers of vertices and edges in the first line, and ``src dst`` lines after it."""
    edges = Table(graph.edges.select("src", "dst"), "edges", m=F.count(F.lit(1)))
    first = edges.df.sparkSession.range(1, numPartitions=1).select(F.lit(f"{graph.vertices.count()} {edges.found['m']}").alias("value"))
    first.union(edges.df.select(F.concat_ws(" ", "src", "dst"))).write.text(path)


def _ordered(graph: Graph) -> tuple[int, DataFrame]:
    """The number of vertices 0, 1, ..., and (v, near) of each in ascending order, near being the sorted neighbours."""
    n = (graph.vertices.agg(F.max("v")).first()[0] or -1) + 1
    every = graph.edges.sparkSession.range(n).select(F.col("id").alias("v"))
    rows = every.join(graph.adjacency(), "v", "left").select("v", F.coalesce("neighbours", F.array().cast("array<long>")).alias("near"))
    return n, rows.repartitionByRange("v").sortWithinPartitions("v")


def write_text_adjacency(graph: Graph, path: str) -> None:
    """A text file with a header line and a line of neighbours, counted from 1, for each vertex 0, 1, ... ; gaps are vertices without neighbours."""
    n, rows = _ordered(graph)
    first = rows.sparkSession.range(1, numPartitions=1).select(F.lit(f"{n} {graph.edges.count()}").alias("value"))
    first.union(rows.select(F.array_join(F.transform("near", lambda x: (x + 1).cast("string")), " "))).write.text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The bytes of the column ``chunk`` of each row, in order, as part files of nothing else; empty chunks fall away.

    There is one write for each last byte that a chunk has: one in all if ids are far from their largest values.
    """
    rows = chunks.where("length(chunk) > 0").select(F.expr("substring(chunk, 1, length(chunk) - 1)").alias("most"), F.hex(F.expr("substring(chunk, length(chunk), 1)")).alias("last"))
    stored = Table(rows, "chunks")
    lasts = [r["last"] for r in stored.df.select("last").distinct().orderBy("last").collect()]
    if len(lasts) < 2:  # straight from the rows, in their order
        separator = chr(int(lasts[0], 16)) if lasts else "\0"
        rows.select(F.col("most").cast("string")).write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    else:
        for last in lasts:
            own = stored.df.where(F.col("last") == last).select(F.col("most").cast("string"))
            own.write.mode("append").option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", chr(int(last, 16))).text(path)
    stored.drop()


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """(chunk) of all integers of the rows, as words of a numpy type; a last column of type array is flattened and ended by 0."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = batch.columns
            if pa.types.is_list(columns[-1].type):
                offsets = columns[-1].offsets.to_numpy()
                flat = columns[-1].flatten().to_numpy()
                words = np.insert(flat, offsets[1:] - offsets[0], 0)
            else:
                words = np.stack([c.to_numpy() for c in columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([words.astype(kind).tobytes()], pa.binary())], names=["chunk"])

    return rows.mapInArrow(run, "chunk binary")


def write_packed_edges(edges: DataFrame, path: str, id_bytes: int = 4) -> None:
    """Part files of little-endian unsigned pairs, each canonical edge once and nothing else."""
    own = edges.where("src < dst").select("src", "dst").distinct()
    write_chunks(_packed(own, {4: "<u4", 8: "<u8"}[id_bytes]), path)


def write_binary_adjacency(graph: Graph, path: str) -> None:
    """Part files, in order, of 64-bit words: n, 0, and the neighbours of each vertex plus 1, ended by 0."""
    n, rows = _ordered(graph)
    first = rows.sparkSession.range(1, numPartitions=1).select(F.array(F.lit(n).cast("long")).alias("near"))
    write_chunks(_packed(first.union(rows.select(F.transform("near", lambda x: x + 1))), "<u8"), path)


def write_vertex_ids(vertices: DataFrame, path: str) -> None:
    """A text file of one id a line."""
    vertices.select(F.col("v").cast("string")).write.text(path)


def write_vertex_parts(parts: DataFrame, path: str) -> None:
    """A text file whose line i has the part of vertex i, from (v, part) of the vertices 0, 1, ..."""
    parts.repartitionByRange("v").sortWithinPartitions("v").select(F.col("part").cast("string")).write.text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels of edges or vertices as a Parquet table."""
    labels.write.parquet(path)


def convert(spark: SparkSession, source: str, kind: str, path: str) -> None:
    """An edge list (``edges``) or text adjacency (``adjacency``) as packed pairs."""
    read = {"edges": text_edges, "adjacency": text_adjacency}[kind]
    found = read(spark, source)
    write_packed_edges(found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), path)
