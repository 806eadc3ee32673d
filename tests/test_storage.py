"""Intermediate tables: where they may go, and when they are deleted."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from knotwork.operators import blocks, traverse, trees
from knotwork.operators import components as comp
from knotwork.operators.graph import Graph
from knotwork.plans import storage


def there(table):
    return Path(table.path.removeprefix("file://")).exists()


def test_scratch(spark):
    with storage.scratch() as outer:
        with storage.scratch() as inner:
            gone = storage.Table(spark.range(3), "gone")
            kept = inner.keep(storage.Table(spark.range(4), "kept"))
            out = inner.result(gone.df, "out")  # reads a table of the block: kept, not written again
            made = inner.result(gone.df.where("id > 0"), "made")
        assert there(gone) and there(kept) and out.count() == 3 and made.count() == 2
        loose = storage.Table(spark.range(2), "loose")
        assert len(outer.tables) == 4
    assert not any(there(t) for t in (gone, kept, loose))


def test_operators_leave_their_result_only(spark):
    graph = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long"))
    folder = Path(storage.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = blocks.edge_blocks(graph)
    assert len(set(folder.iterdir()) - before) == 1 and found.count() == 4
    with storage.scratch():
        assert blocks.articulation_points(blocks.edge_blocks(graph)).count() == 1
    assert len(set(folder.iterdir()) - before) == 1


@pytest.mark.parametrize(("master", "allowed"), [("local[2]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_shared_folder_is_required_on_a_cluster(master, allowed):
    set_to = []
    sc = SimpleNamespace(master=master, applicationId="app", getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    spark = SimpleNamespace(sparkContext=sc, conf={})
    if allowed:
        assert storage.shared_dir(spark).startswith("file://") and set_to
    else:
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            storage.shared_dir(spark)


@pytest.mark.parametrize(("few", "sent"), [(None, True), (200, True), (50, False)])
def test_large_tables_are_not_broadcast(spark, few, sent):
    """Tables of vertices with more rows than ``few`` don't pass through the driver for a join, nor do what is derived from them."""
    rows = storage.Table(spark.range(100).withColumnRenamed("id", "v"), "rows", few=few)
    other = storage.Table(spark.range(100).selectExpr("id AS v", "id AS w"), "other").df
    for joined in (other.join(rows.df, "v"), rows.df.groupBy("v").count().join(other, "v"), other.join(rows.df.where("v > 3").select("v"), "v", "left_anti")):
        assert joined.count() > 0 and ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) == sent
    assert other.join(rows.plain, "v").count() == 100


def test_wide_forests_are_not_broadcast(spark, monkeypatch):
    """The tree of many vertices joins without the driver, and searches give the same whatever levels may be broadcast."""
    graph = Graph.from_edges(spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 299)], "src long, dst long"))
    want = {tuple(r) for r in blocks.spanning_forest(graph).collect()}
    for module in (storage, traverse, trees, comp):
        monkeypatch.setattr(module, "FEW", 20)
    monkeypatch.setattr(traverse, "FRONTIERS", 100)
    assert {tuple(r) for r in blocks.spanning_forest(graph).collect()} == want
    assert {r["over"] for r in trees.marks(graph, blocks.spanning_forest(graph)).collect()} == {1, 2}
