"""Readers and writers of edge, vertex and mesh files."""

from __future__ import annotations

import random
import struct

import pytest

from knotwork.functions.prefix import arg_max, dense_ids, running_sum
from knotwork.operators import generate, mesh
from knotwork.operators.graph import Graph, canonical
from knotwork.sources import edge_files, mesh_files
from knotwork.sources.lines import head, numbered


def found(df):
    return {tuple(r) for r in df.collect()}


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_text_edges(spark, tmp_path):
    assert found(edge_files.text_with_header(spark, put(tmp_path, "h.txt", "4 3\n0 1\n1 2\n2 3\n"))) == {(0, 1), (1, 2), (2, 3)}
    with pytest.raises(ValueError):
        edge_files.text_with_header(spark, put(tmp_path, "bad.txt", "4 3\n0 1\n"))
    assert found(edge_files.text_edges(spark, put(tmp_path, "c.txt", "% a\n# b\n\n0 1\n 1\t2 \n"))) == {(0, 1), (1, 2)}


def test_packed_edges(spark, tmp_path):
    assert found(edge_files.packed_edges(spark, put(tmp_path, "e.ebin", struct.pack("<4I", 0, 1, 2**32 - 1, 5)))) == {(0, 1), (2**32 - 1, 5)}
    for rank in (0, 1):
        put(tmp_path, f"wide.{rank}", struct.pack("<2Q", rank, 2**40))
    assert found(edge_files.packed_edges(spark, f"{tmp_path}/wide.*", 8)) == {(0, 2**40), (1, 2**40)}
    with pytest.raises(Exception, match="doesn't fit"):
        edge_files.packed_edges(spark, put(tmp_path, "big.ebin", struct.pack("<2Q", 2**63, 1)), 8).collect()


@pytest.mark.parametrize("id_bytes", [4, 8])
def test_packed_round_trip(spark, tmp_path, id_bytes):
    edges = spark.createDataFrame([(1, 2), (2, 3), (0, 9), (2, 3)], "src long, dst long")
    edge_files.write_packed_edges(edges, f"{tmp_path}/out{id_bytes}", id_bytes)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / f"out{id_bytes}").glob("part-*")))
    pairs = list(struct.iter_unpack({4: "<II", 8: "<QQ"}[id_bytes], raw))
    assert sorted(pairs) == [(0, 9), (1, 2), (2, 3)]
    assert found(edge_files.packed_edges(spark, f"{tmp_path}/out{id_bytes}", id_bytes)) == {*pairs}
    far = spark.createDataFrame([(1, 2**32 - 1), (2, 2**31), (3, 2**24 + 1), (5, 6)], "src long, dst long")
    edge_files.write_packed_edges(far.repartition(4), f"{tmp_path}/far{id_bytes}", id_bytes)
    raw = b"".join(p.read_bytes() for p in (tmp_path / f"far{id_bytes}").glob("part-*"))
    assert sorted(struct.iter_unpack({4: "<II", 8: "<QQ"}[id_bytes], raw)) == [(1, 2**32 - 1), (2, 2**31), (3, 2**24 + 1), (5, 6)]
    edge_files.write_packed_edges(far.where("false"), f"{tmp_path}/none{id_bytes}", id_bytes)


def test_order_of_files_and_splits(spark, tmp_path):
    """Lines are counted over files by name, whatever their sizes and splits."""
    (tmp_path / "many").mkdir()
    want, rng = [], random.Random(4)
    for k in range(5):
        own = [f"{k} {i}" + "x" * rng.randrange(60) for i in range(rng.randrange(1, 400))]
        put(tmp_path, f"many/part-{k}", "\n".join(own) + "\n")
        want += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert [r["value"] for r in numbered(spark, f"{tmp_path}/many").orderBy("line").collect()] == want
        assert [r["line"] for r in numbered(spark, f"{tmp_path}/many").orderBy("line").collect()] == list(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert head(spark, f"{tmp_path}/many", 2) == [x.split() for x in want[:2]]


def test_written_graphs(spark, tmp_path):
    graph = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 4), (4, 0), (6, 4)], "src long, dst long")).stored()
    edge_files.write_text_with_header(graph, f"{tmp_path}/h")
    assert head(spark, f"{tmp_path}/h", 1) == [["4", "4"]] and found(edge_files.text_with_header(spark, f"{tmp_path}/h")) == found(graph.edges)
    edge_files.write_text_adjacency(graph, f"{tmp_path}/a")
    both = found(graph.sym)
    assert found(edge_files.text_adjacency(spark, f"{tmp_path}/a")) == both
    edge_files.write_binary_adjacency(graph, f"{tmp_path}/b")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("part-*")))
    assert list(struct.unpack(f"<{len(raw) // 8}Q", raw)) == [7, 0, 2, 5, 0, 1, 5, 0, 0, 0, 1, 2, 7, 0, 0, 5, 0]
    assert found(edge_files.binary_adjacency(spark, f"{tmp_path}/b")) == both


def test_adjacency(spark, tmp_path):
    text = put(tmp_path, "adj.txt", "3 2\n2 3\n1\n1\n")
    assert found(edge_files.text_adjacency(spark, text)) == {(0, 1), (0, 2), (1, 0), (2, 0)}
    edge_files.convert(spark, text, "adjacency", f"{tmp_path}/conv")
    assert found(canonical(edge_files.packed_edges(spark, f"{tmp_path}/conv/part-*"))) == {(0, 1), (0, 2)}
    words = [3, 0, 2, 3, 0, 1, 0, 1, 0]
    assert found(edge_files.binary_adjacency(spark, put(tmp_path, "adj.bin", struct.pack(f"<{len(words)}Q", *words)))) == {(0, 1), (0, 2), (1, 0), (2, 0)}


def test_vertex_files(spark, tmp_path):
    assert found(edge_files.vertex_ids(spark, put(tmp_path, "arts", "3\n5\n\n8\n"))) == {(3,), (5,), (8,)}
    assert found(edge_files.vertex_parts(spark, put(tmp_path, "parts", "0\n1\n1\n"))) == {(0, 0), (1, 1), (2, 1)}
    got = edge_files.degree_distribution(spark, put(tmp_path, "nd", "0\n4\n2\n"), put(tmp_path, "cd", "0\n0\n0.5\n"))
    assert found(got) == {(0, 0, 0.0), (1, 4, 0.0), (2, 2, 0.5)}
    ids = spark.createDataFrame([(7,), (9,)], "v long")
    edge_files.write_vertex_ids(ids, f"{tmp_path}/ids")
    assert found(edge_files.vertex_ids(spark, f"{tmp_path}/ids")) == {(7,), (9,)}
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    edge_files.write_text_edges(edges, f"{tmp_path}/edges")
    assert found(edge_files.text_edges(spark, f"{tmp_path}/edges")) == {(1, 2)}
    edge_files.write_labels(edges, f"{tmp_path}/labels")
    assert found(spark.read.parquet(f"{tmp_path}/labels")) == {(1, 2)}


def test_mesh_files(spark, tmp_path):
    quads, border = mesh_files.quad_mesh(spark, put(tmp_path, "m.msh", "title\n6 2 2\n" + "0 0 0\n" * 6 + "1 2 5 4\n2 3 6 5\n1 2\n2 3\n"))
    assert found(quads) == {(0, 0, 1, 4, 3), (1, 1, 2, 5, 4)} and found(border) == {(0, 1), (1, 2)}
    assert found(mesh.quad_edges(quads)) == {(0, 1), (1, 4), (3, 4), (0, 3), (1, 2), (2, 5), (4, 5)}
    got = mesh_files.border_edges(spark, put(tmp_path, "b.txt", "a b\n2 1 3\nx\nx\nskip\n1 2 f\n1 3 f\n1 4 f\n"))
    assert found(got) == {(0, 1), (0, 2), (0, 3)} and found(mesh.boundary_nodes(got)) == {(0,)}
    assert found(mesh_files.grounded_nodes(spark, put(tmp_path, "g.txt", "4\n0.0\n1.5\n-2\n3e-2\n"))) == {(1,), (3,)}


def status(spark, quads, grounded):
    graph = Graph(mesh.quad_edges(quads)).stored()
    return {r["v"]: (r["status"], r["hinge"]) for r in mesh.ice_status(graph, spark.createDataFrame([(v,) for v in grounded], "v long")).collect()}


def test_ice(spark):
    # two squares that share node 2, and a third apart
    quads = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 2, 4, 5, 6), (2, 10, 11, 12, 13)], "q long, n1 long, n2 long, n3 long, n4 long")
    none = status(spark, quads, [])
    assert {s for s, _ in none.values()} == {"floating"}
    one = status(spark, quads, [0])
    assert all(one[v] == ("hinged", 0) for v in (0, 1, 2, 3, 4, 5, 6)) and one[10] == ("floating", None)
    two = status(spark, quads, [0, 2])
    assert all(two[v][0] == "kept" for v in (0, 1, 2, 3)) and all(two[v] == ("hinged", 2) for v in (4, 5, 6))


def test_ice_mesh_answer(spark):
    quads, grounded, answer = generate.ice_mesh(spark, 3, 2, 2)
    graph = Graph(mesh.quad_edges(quads)).stored()
    gone = {r["v"] for r in mesh.ice_status(graph, grounded).where("status <> 'kept'").collect()}
    ends = {r["v"] for r in grounded.collect()}
    chains = [set(range(16 + 6 * c, 22 + 6 * c)) for c in range(2)]
    assert {r["v"] for r in answer.collect()} == chains[0] | chains[1]
    assert all((not gone & c) if ends & c else c <= gone for c in chains)


def test_prefix(spark):
    rows = spark.createDataFrame([(k * 3, k) for k in range(50)], "key long, n long").repartition(5)
    got = dict((r["key"], r["before"]) for r in running_sum(rows, "key", "n").collect())
    assert got == {k * 3: sum(range(k)) for k in range(50)}
    assert found(dense_ids(rows, "key")) == {(k * 3, k) for k in range(50)}
    assert found(arg_max(spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "k long, v long"), "k", "v")) == {(2, 7)}


def test_generators(spark):
    uniform = generate.uniform(spark, 50, 200)
    assert found(uniform) == found(generate.uniform(spark, 50, 200)) and all(a < b < 50 for a, b in found(uniform))
    assert all(a < b < 64 for a, b in found(generate.recursive_matrix(spark, 6, 300)))
    long = found(generate.high_diameter(spark, 30, 2, 4))
    assert all((i, i + 1) in long for i in range(29)) and all(b - a <= 4 for a, b in long)
    dist = spark.createDataFrame([(1, 4, 0.0), (3, 8, 1.0)], "d long, nd long, cd double")
    edges, own = generate.clustered(spark, dist)
    inside = {(a, b) for a, b in found(edges) if dict(found(own))[a] == dict(found(own))[b]}
    assert own.count() == 12 and len([e for e in inside if e[0] >= 4]) == 12
    edges, own = generate.block_model(spark, 40, 10, 1.0, 10)
    assert len([1 for a, b in found(edges) if a // 10 == b // 10]) == 4 * 45 and own.count() == 40
