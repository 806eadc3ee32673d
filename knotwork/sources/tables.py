"""Graphs derived from the tables of a data folder; ids of different tables are kept apart by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import dense_ids
from ..operators.graph import Graph, canonical


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (2 k) and suppliers (2 k + 1) that meet in a line item."""
    items = read(spark, sf_dir, "lineitem")
    return Graph(canonical(items.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))))


def places(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (4 k), suppliers (4 k + 1), nations (4 k + 2) and regions (4 k + 3)."""
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 4).alias("src"), (F.col("c_nationkey") * 4 + 2).alias("dst"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 4 + 1).alias("src"), (F.col("s_nationkey") * 4 + 2).alias("dst"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4 + 2).alias("src"), (F.col("n_regionkey") * 4 + 3).alias("dst"))
    return Graph(canonical(c.union(s).union(n)))


def accounts(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of ``places`` with ids of 8 k, 8 k + 1, 8 k + 2 and 8 k + 3, and the kinds of events (8 times their place by name, + 4) that customers caused."""
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 8).alias("src"), (F.col("c_nationkey") * 8 + 2).alias("dst"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 8 + 1).alias("src"), (F.col("s_nationkey") * 8 + 2).alias("dst"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 8 + 2).alias("src"), (F.col("n_regionkey") * 8 + 3).alias("dst"))
    seen = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    kinds = dense_ids(seen.select("event_type").distinct(), "event_type")
    e = seen.join(kinds, "event_type").select((F.col("user_id") * 8).alias("src"), (F.col("id") * 8 + 4).alias("dst"))
    return Graph(canonical(c.union(s).union(n).union(e)))


def customer_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (2 k) and parts (2 k + 1) that meet in an order line."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return Graph(canonical(items.join(orders, "l_orderkey").select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))))


def turns(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of a conversation (width * conversation + turn, where width is 1000 or more than any turn), each tied to the one before."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"))
    low, high = rows.agg(F.min("turn"), F.max("turn")).first()
    low, width = min(low or 0, 0), max(1000, (high or 0) - min(low or 0, 0) + 1)
    t = rows.select("conv", "turn", (F.col("conv") * width + F.col("turn") - low).alias("dst"))
    before = t.select("conv", (F.col("turn") + 1).alias("turn"), F.col("dst").alias("src"))
    return Graph(canonical(t.join(before, ["conv", "turn"]).select("src", "dst")), t.select(F.col("dst").alias("v")).distinct())
