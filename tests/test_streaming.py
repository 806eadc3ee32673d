"""Components of edges that arrive in batches."""

from __future__ import annotations

import brute
from knotwork.streaming import edge_stream


def test_components_follow_batches(spark, tmp_path):
    folder, state = tmp_path / "in", f"file://{tmp_path}/state"
    folder.mkdir()
    writer = lambda: edge_stream.stream_components(edge_stream.edge_stream(spark, f"file://{folder}"), state, f"file://{tmp_path}/check").trigger(availableNow=True).start()
    assert edge_stream.latest(spark, state) is None
    seen = []
    for k, edges in enumerate([[(1, 2), (3, 4)], [(2, 3), (9, 8)], [(5, 5), (4, 9)]]):
        (folder / f"{k}.txt").write_text("% edges\n" + "".join(f"{a} {b}\n" for a, b in edges))
        seen += edges
        run = writer()
        run.awaitTermination(120)
        want = {v: c for v, c in brute.components(seen).items() if v != c}
        assert {r["v"]: r["component"] for r in edge_stream.latest(spark, state).collect()} == want
