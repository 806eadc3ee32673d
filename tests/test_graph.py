"""Components, trees, blocks and certificates on hand-made and random graphs, compared with plain searches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from knotwork.functions.prefix import range_of, running_sum_within
from knotwork.operators import blocks, certificate, forest, separation, traverse, trees
from knotwork.operators import components as comp
from knotwork.operators.graph import Graph, by_starts, compare_sets, edge_balanced, room, spread_ids
from knotwork.sources import tables

#: Two small graphs without cut vertices.
TEST = [(1, 2), (1, 3), (1, 7), (2, 4), (2, 8), (3, 4), (3, 5), (4, 6), (5, 6), (5, 7), (6, 8), (7, 12), (8, 9), (8, 10), (9, 10), (9, 14), (10, 11), (11, 13), (11, 14), (12, 13), (12, 15), (12, 0), (13, 14), (13, 15), (13, 0), (15, 0)]
GRID = [(6 * r + c, 6 * r + c + 1) for r in range(6) for c in range(5)] + [(6 * r + c, 6 * r + c + 6) for r in range(5) for c in range(6)]
CLIQUE = [(a, b) for a in range(5) for b in range(a)]
SHAPES = {
    "empty": [],
    "edge": [(3, 7)],
    "loop": [(4, 4)],
    "repeated": [(1, 2), (2, 1), (1, 2), (2, 3)],
    "path": [(i, i + 1) for i in range(20)],
    "cycle": [(i, (i + 1) % 9) for i in range(9)],
    "star": [(0, i) for i in range(1, 12)],
    "clique": CLIQUE,
    "two cliques at a vertex": CLIQUE + [(a + 4, b + 4) for a, b in CLIQUE],
    "two cliques and a bridge": CLIQUE + [(a + 10, b + 10) for a, b in CLIQUE] + [(0, 10)],
    "two components": [(0, 1), (1, 2), (2, 0), (10, 11), (11, 12)],
    "large ids": [(2**31 + 5, 2**40), (2**40, 2**33), (2**33, 2**31 + 5), (1, 2**40)],
    "grid": GRID,
}


def frame(spark, edges):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long")


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def shapes(spark):
    """All shapes as one graph: shape i has its ids at i * 2**42. One run of the engine covers them."""
    parts = {name: [(a + (i << 42), b + (i << 42)) for a, b in edges] for i, (name, edges) in enumerate(SHAPES.items())}
    rng = random.Random(5)
    for k in range(30):
        n = rng.randint(2, 14)
        i = len(SHAPES) + k
        parts[f"random {k}"] = [(rng.randrange(n) + (i << 42), rng.randrange(n) + (i << 42)) for _ in range(rng.randint(1, 2 * n))]
    edges = [e for own in parts.values() for e in own]
    rng.shuffle(edges)
    return [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], Graph.from_edges(frame(spark, edges)).stored()


def test_components(spark, shapes):
    edges, graph = shapes
    want = brute.components([e for e in edges if e[0] != e[1]])
    assert found(comp.components(graph)) == set(want.items())
    assert comp.wrong_labels(graph, comp.components(graph)).isEmpty()


def test_blocks(spark, shapes):
    edges, graph = shapes
    got = blocks.edge_blocks(graph)
    assert {((r[0], r[1]), (r[2], r[3])) for r in got.collect()} == set(brute.blocks(edges).items())
    assert found(blocks.articulation_points(got)) == {(v,) for v in brute.articulation(edges)}
    assert found(blocks.bridges(got)) == brute.bridges(edges)
    assert found(blocks.points_on_forest(graph)) == {(v,) for v in brute.articulation(edges)}


def test_blocks_of_deep_graphs(spark, shapes):
    """Blocks by a forest of any depth, and that forest's own labels."""
    edges, graph = shapes
    got = blocks.edge_blocks(graph, deep=True)
    assert {((r[0], r[1]), (r[2], r[3])) for r in got.collect()} == set(brute.blocks(edges).items())
    tree = {r["v"]: r for r in forest.rooted(forest.forest_edges(graph)).collect()}
    known = brute.components([e for e in edges if e[0] != e[1]])
    assert {v: r["root"] for v, r in tree.items()} == known
    inside = {(a, b) for a in tree for b in tree if tree[a]["root"] == tree[b]["root"] and tree[a]["pre"] <= tree[b]["pre"] < tree[a]["pre"] + tree[a]["n_desc"]}
    for v, r in tree.items():
        above, up = [], v
        while up is not None:
            above.append(up)
            up = tree[up]["parent"]
        assert len(above) == r["level"] + 1 and {a for a in above} == {a for a, b in inside if b == v}
    adj = brute.neighbours(edges)
    assert all(r["parent"] is None or r["parent"] in adj[v] for v, r in tree.items())


def test_blocks_on_certificate(spark, shapes):
    edges, graph = shapes
    got = blocks.edge_blocks(graph, certificate_first=True)
    assert {((r[0], r[1]), (r[2], r[3])) for r in got.collect()} == set(brute.blocks(edges).items())
    kept = certificate.certificate(graph)
    n = graph.vertices.count()
    assert kept.count() <= 2 * (n - 1)


def test_candidates_and_labels(spark, shapes):
    edges, graph = shapes
    points = spark.createDataFrame([(v,) for v in brute.articulation(edges)], "v long")
    row = compare_sets(blocks.candidates(graph), points).first()
    assert row["false_negative"] == 0
    marks = blocks.vertex_labels(graph)
    assert blocks.unlabelled(graph, marks).isEmpty()
    own = trees.labels(graph, traverse.spanning_forest(graph))
    assert found(blocks.bridges_by_labels(own)) == brute.bridges(edges)


def test_trees(spark, shapes):
    edges, graph = shapes
    tree = traverse.spanning_forest(graph)
    assert traverse.bad_tree_rows(graph, tree).isEmpty()
    assert tree.count() == graph.vertices.count()
    rows = {r["v"]: r for r in tree.collect()}
    kids = {}
    for v, r in rows.items():
        kids.setdefault(r["parent"], []).append(v)
    size, pre = {}, {}
    for root in kids.get(None, []):
        order, todo = [], [root]
        while todo:
            v = todo.pop()
            order.append(v)
            todo += sorted(kids.get(v, []), reverse=True)
        for k, v in enumerate(order):
            pre[v] = k + 1
        for v in reversed(order):
            size[v] = 1 + sum(size[w] for w in kids.get(v, []))
    assert dict(found(trees.descendants(tree))) == size
    assert dict(found(trees.preorder(tree, trees.descendants(tree)))) == pre
    assert dict(found(trees.euler_preorder(tree))) == pre
    adj = brute.neighbours(edges)
    for r in traverse.bottom_up_step(graph, tree, 1).collect():
        assert rows[r["v"]]["level"] == 2 and r["parent"] == min(w for w in adj[r["v"]] if rows[w]["level"] == 1)


def test_lca(spark, shapes):
    _, graph = shapes
    tree = traverse.spanning_forest(graph)
    up = {r["v"]: r["parent"] for r in tree.collect()}

    def path(v):
        return [v, *path(up[v])] if up[v] is not None else [v]

    pairs = [(a, b) for a in list(up)[::3] for b in (path(a)[-1], a)] + [tuple(r) for r in trees.non_tree(graph, tree).collect()]
    got = found(trees.lca(tree, frame(spark, set(pairs))))
    assert got == {(a, b, next(x for x in path(a) if x in path(b))) for a, b in set(pairs)}


def test_marks_of_tree_edges(spark, shapes):
    """How many other edges go over each tree edge; bridges are those without any."""
    edges, graph = shapes
    tree = traverse.spanning_forest(graph)
    up = {r["v"]: r["parent"] for r in tree.collect()}

    def above(v):
        return {v} | (above(up[v]) if up[v] is not None else set())

    rest = trees.non_tree(graph, tree)
    over = dict.fromkeys((v for v in up if up[v] is not None), 0)
    for a, b in found(rest):
        for v in above(a) ^ above(b):
            over[v] += 1
    got = trees.covered(tree, trees.lca(tree, rest))
    assert found(got) == {(v, up[v], n) for v, n in over.items()}
    assert found(traverse.tree_edges(got.where("over = 0"))) == brute.bridges(edges)


def test_neighbours_and_ranges(spark, shapes):
    edges, graph = shapes
    adj = brute.neighbours(edges)
    assert found(graph.neighbour_degrees()) == {(v, w, len(adj[w])) for v in adj for w in adj[v]}
    parts = edge_balanced(graph.degrees(), 7)
    assert found(by_starts(graph.vertices, parts)) == found(parts)
    cases = spark.createDataFrame([(x,) for x in (-1, 0, 4, 5, 9, 10, 11, None)], "x long")
    got = [r[0] for r in cases.select(range_of(F.col("x"), [0, 5, 10])).collect()]
    assert got == [None, 0, 0, 1, 1, 2, 2, None]
    assert cases.select(range_of(F.col("x"), [])).distinct().collect() == [(None,)]


def test_children_of_a_hub(spark):
    """A vertex with most children: its children's places come from several ranges."""
    rows = spark.range(1, 20_001).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-5).alias("g"), F.col("id").alias("x"), (F.col("id") % 3).alias("n"))
    want, sums = set(), {}
    for g, x, n in sorted(map(tuple, rows.collect())):
        want.add((g, x, n, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = running_sum_within(rows, "g", "x", "n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert set(map(tuple, got.select("g", "x", "n", "before").collect())) == want
    star = Graph.from_edges(frame(spark, [(0, i) for i in range(1, 300)] + [(5, 1000), (7, 1001)])).stored()
    tree = traverse.spanning_forest(star)
    assert {(r["v"], r["rank"]) for r in traverse.child_ranks(tree).collect()} == {(0, None), (1000, 0), (1001, 0)} | {(i, i - 1) for i in range(1, 300)}
    pre = dict(found(trees.preorder(tree, trees.descendants(tree))))
    assert pre == dict(found(trees.euler_preorder(tree))) and pre[1000] == pre[5] + 1 and pre[300 - 1] == 302


def test_isolated_vertices(spark):
    graph = Graph.from_edges(frame(spark, [(0, 1)]), spark.createDataFrame([(5,), (None,), (0,)], "v long")).stored()
    assert found(comp.components(graph)) == {(0, 0), (1, 0), (5, 5)}
    assert found(graph.degrees()) == {(0, 1), (1, 1), (5, 0)}
    assert found(blocks.articulation_points(blocks.edge_blocks(graph))) == set()
    stats = comp.component_stats(comp.components(graph)).first()
    assert tuple(stats) == (2, 2, 1)


def test_empty_graph(spark):
    graph = Graph.from_edges(frame(spark, []))
    assert comp.components(graph).isEmpty() and blocks.edge_blocks(graph).isEmpty() and certificate.certificate(graph).isEmpty()


def test_nulls_and_partitions(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, blocks.edge_blocks(Graph.from_edges(edges.repartition(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] == [(1, 2, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2), (3, 4, 3, 4)]


def test_separation_pairs(spark):
    graph = Graph.from_edges(frame(spark, TEST))
    assert found(separation.separation_pairs(graph)) == {(7, 8), (7, 13), (8, 12), (8, 13), (12, 13)}
    assert found(separation.degree_two_pairs(graph)) == set()


def test_separation_pairs_of_twins(spark, monkeypatch):
    """Vertices with the same neighbours stand for each other, so hundreds of them add nothing to what is searched."""
    hubs = [0, 1, 2]
    edges = [(h, v) for v in range(10, 250) for h in hubs] + [(0, 400), (1, 400), (0, 1)] + [(h, v) for v in range(500, 505) for h in (1, 2)]
    searched = []
    whole = separation.edge_blocks
    monkeypatch.setattr(separation, "edge_blocks", lambda g: searched.append(g.edges.count()) or whole(g))
    assert found(separation.separation_pairs(Graph.from_edges(frame(spark, edges)))) == {(0, 1), (1, 2)}
    assert searched[0] < 200
    rng = random.Random(9)
    own = [(h, v) for v in range(4, 14) for h in rng.sample(range(4), 2)] + [(0, 1), (1, 2), (2, 3), (3, 0)]
    verts = sorted({v for e in own for v in e})
    want = {(a, b) for a in verts for b in verts if a < b and b in brute.articulation([e for e in own if a not in e])}
    assert found(separation.separation_pairs(Graph.from_edges(frame(spark, own)))) == want


def test_forests(spark):
    graph = Graph.from_edges(frame(spark, CLIQUE))
    rows = certificate.forests(graph, 2).collect()
    per = {}
    for r in rows:
        per.setdefault(r["forest"], []).append((r["src"], r["dst"]))
    assert [len(per[k]) for k in (0, 1)] == [4, 3] and len({(r["src"], r["dst"]) for r in rows}) == len(rows)


def test_extraction(spark):
    two = [(0, 1), (1, 2), (2, 0), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10)]
    graph = Graph.from_edges(frame(spark, two))
    assert found(comp.keep_largest(graph).edges) == {(10, 11), (11, 12), (12, 13), (10, 13)}
    dense, ids = comp.keep_largest(graph).relabelled()
    assert found(dense.edges) == {(0, 1), (1, 2), (2, 3), (0, 3)} and found(ids) == {(10, 0), (11, 1), (12, 2), (13, 3)}
    assert found(comp.component_of(graph, 3)) == {(0,), (1,), (2,), (3,)}
    assert found(blocks.largest_block(blocks.edge_blocks(graph))) == {(10, 11), (11, 12), (12, 13), (10, 13)}
    parts = dict(found(edge_balanced(graph.degrees(), 2)))
    assert [v for v in sorted(parts) if parts[v] == 0] == [0, 1, 2, 3]


def test_csr(spark):
    graph = Graph.from_csr([0, 2, 3, 4, 4], [1, 2, 0, 0], spark)
    assert found(graph.edges) == {(0, 1), (0, 2)} and found(graph.vertices) == {(0,), (1,), (2,), (3,)}


def test_room_of_spread_ids(spark):
    assert room(1_048_335, 16) == 1 << 20
    for largest in (1_048_336, 3_000_000):
        ids = spark.range(largest - 40_000, largest + 1).select(spread_ids("id", room(largest, 16), 16).alias("x"))
        assert ids.distinct().count() == 40_001


def test_long_conversations(spark, tmp_path):
    """A conversation of more than 1,000 turns doesn't run into the next one."""
    spark.createDataFrame([(1, k) for k in range(1003)] + [(2, k) for k in range(5)], "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    assert tuple(comp.component_stats(comp.components(tables.turns(spark, str(tmp_path)).stored())).first()) == (2, 1003, 2)


def test_spread_ids_of_large_ids(spark):
    from knotwork.queries import OF_ACCOUNTS

    edges = [(3, 1_048_340), (1_048_575, 5_000_000_017)]
    got = {tuple(r) for r in OF_ACCOUNTS["spread_ids"](Graph.from_edges(frame(spark, edges))).collect()}
    assert got == {(v, v % 16 * 65537 + v // 16) for e in edges for v in e}


def test_points_are_aggregated_by_hash(spark):
    """Blocks are compared as plain numbers: a task keeps the vertices, and doesn't sort all ends of edges."""
    rows = spark.createDataFrame([(0, 1, 0, 1), (1, 2, 1, 2), (2, 3, 1, 2), (1, 3, 1, 2)], "src long, dst long, block_src long, block_dst long")
    points = blocks.articulation_points(rows)
    assert "SortAggregate" not in points._jdf.queryExecution().toString()
    assert found(points) == {(1,)}


def test_paths_by_common_ancestor(spark, shapes):
    """Edges that share a pair of ancestors go on as one row, with the same counts as one by one."""
    _, graph = shapes
    tree = traverse.spanning_forest(graph)
    one_by_one = trees.lca(tree, trees.non_tree(graph, tree))
    assert found(trees.tops(tree, graph.edges)) == found(one_by_one.groupBy("lca").count())
    assert found(trees.marks(graph, tree)) == found(trees.covered(tree, one_by_one))


@pytest.mark.parametrize("shuffled", [False, True])
def test_tops_of_a_deep_tree(spark, shuffled):
    """Ends of an edge may be many levels apart where the tree isn't breadth-first."""
    rng = random.Random(3)
    parent = {v: v - 1 if v < 40 else rng.randrange(v) for v in range(1, 60)}
    level, name = {0: 0}, list(range(60))
    for v in range(1, 60):
        level[v] = level[parent[v]] + 1
    if shuffled:
        rng.shuffle(name)
    tree = spark.createDataFrame([(name[v], name[parent[v]] if v else None, level[v], name[0]) for v in range(60)], "v long, parent long, level long, root long")
    edges = {(min(name[a], name[b]), max(name[a], name[b])) for a, b in (rng.sample(range(60), 2) for _ in range(150)) if a != parent.get(b) and b != parent.get(a)}
    above = lambda v: [v, *(above(parent[v]) if v else [])]
    at = {name[v]: v for v in range(60)}
    want = {e: name[next(u for u in above(at[e[0]]) if u in set(above(at[e[1]])))] for e in edges}
    assert {(r["src"], r["dst"]): r["lca"] for r in trees.lca(tree, frame(spark, edges)).collect()} == want
    counted = {v: list(want.values()).count(v) for v in want.values()}
    assert dict(found(trees.tops(tree, frame(spark, edges)))) == counted


def test_few_links_are_contracted(spark, monkeypatch):
    """Most vertices find a root by their smallest neighbours; only links between roots are contracted."""
    seen, contract = [], comp._contract
    monkeypatch.setattr(comp, "_contract", lambda slim, *a: seen.append(slim.count()) or contract(slim, *a))
    rng = random.Random(11)
    edges = {(2 * a, 2 * b + 1) for a in range(200) for b in rng.sample(range(40), 8)} | {(1000 + i, 1001 + i) for i in range(50)}
    names, _ = comp.tied(frame(spark, edges).toDF("a", "b"))
    want = brute.components(list(edges))
    assert found(names) == {(v, c) for v, c in want.items() if v != c}
    assert sum(seen) < len(want) / 4
