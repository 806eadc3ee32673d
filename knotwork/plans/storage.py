"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again: the
files outlive any executor, are compressed, and are pruned by column when they are read. A ``scratch`` block deletes the
tables that are written inside it when it ends, but for those it keeps; operators use one, and so can callers, around an
operator and the action that uses up its result.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_open = threading.local()

#: Most rows of a table of vertices that Spark may broadcast. What it broadcasts passes through the driver, and its own limit, by bytes
#: on disk, lets through some megabytes of every table that a query writes.
FEW = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="knotwork-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/knotwork-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


class Table:
    """A materialised DataFrame: ``df`` reads it, ``drop`` deletes its files.

    ``measures`` are aggregates, by name, that are taken of the rows while they are written; ``found`` has their values. ``codec`` is for
    wide tables, whose size matters more than the time to compress them. With more than ``few`` rows ``df`` asks for merge joins, so that it isn't
    broadcast, nor what it is joined with; ``plain`` doesn't ask.
    """

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy", few: int | None = None, **measures: Column):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.found: dict = {}
        if few is not None:
            measures["rows"] = F.count(F.lit(1))
        if measures:
            seen = Observation()
            df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(self.path, compression=codec)
            self.found = seen.get
        else:
            df.write.parquet(self.path, compression=codec)
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        self.plain = self.spark.read.schema(nullable).parquet(self.path)
        self.df = self.plain.hint("merge") if few is not None and self.found["rows"] > few else self.plain
        self.dropped = False
        blocks = getattr(_open, "blocks", [])
        if blocks:
            blocks[-1].tables.append(self)

    def drop(self) -> None:
        if not self.dropped:
            delete(self.spark, self.path)
            self.dropped = True


class scratch:  # noqa: N801
    """Tables that are written inside the block are deleted when it ends, but for those that are kept."""

    def __init__(self) -> None:
        self.tables: list[Table] = []
        self.kept: list[Table] = []

    def __enter__(self) -> scratch:
        if not hasattr(_open, "blocks"):
            _open.blocks = []
        _open.blocks.append(self)
        return self

    def keep(self, table: Table) -> Table:
        """``table`` goes to the block around this one, if there is one."""
        self.kept.append(table)
        return table

    def result(self, df: DataFrame, name: str, few: int | None = None) -> DataFrame:
        """``df`` written out, unless it just reads a table of the block, and kept; nothing else of the block is needed to read it."""
        own = next((t for t in self.tables if t.df is df), None)
        return self.keep(own or Table(df, name, few=few)).df

    def __exit__(self, *_: object) -> None:
        _open.blocks.pop()
        for t in self.tables:
            if not any(t is k for k in self.kept):
                t.drop()
        if _open.blocks:
            _open.blocks[-1].tables += [t for t in self.kept if not t.dropped]


def tidy(name: str, few: int | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions of DataFrames: the result is written out, and what was written on the way is deleted."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*a: object, **b: object) -> DataFrame:
            with scratch() as own:
                return own.result(f(*a, **b), name, few)

        return run

    return wrap


def materialise(df: DataFrame, name: str = "table", few: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Table(df, name, few=few).df
