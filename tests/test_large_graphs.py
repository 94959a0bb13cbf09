"""Simplification without a task for each connected component."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scenewright.operators import graph


def one_by_one(edges):
    """edges: {(u, v): length or None}; triangle by triangle."""
    length = {e: float("inf") if d is None else d for e, d in edges.items()}
    original, live = {}, {}
    for u, v in length:
        for g in (original, live):
            g.setdefault(u, set()).add(v)
            g.setdefault(v, set()).add(u)
    for a in sorted(original):
        for b in sorted(x for x in original[a] if x > a):
            for c in sorted(x for x in original[a] & original[b] if x > b):
                u, v = max([(a, b), (b, c), (a, c)], key=lambda e: length[e])
                if v in live[u] and graph.reaches(live, u, v, (u, v)):
                    live[u].remove(v)
                    live[v].remove(u)
    return {(u, v) for u, v in edges if v in live[u]}


@pytest.mark.parametrize("of_forest", [graph.OF_FOREST, 3])
def test_f6_simplify_as_one_by_one(spark, monkeypatch, of_forest):
    monkeypatch.setattr(graph, "OF_FOREST", of_forest)
    rng, rows, want = random.Random(4), [], set()
    for g in range(12):
        n = rng.randint(5, 14)
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(n, 4 * n))})
        edges = {e: rng.choice([1.0, 2.0, 3.0, rng.uniform(0, 5), None]) for e in pairs}
        rows += [(f"g{g}", *(e if k % 2 else e[::-1]), k, d) for k, (e, d) in enumerate(edges.items())]
        kept = one_by_one(edges)
        want |= {(f"g{g}", *e, edges[e]) for e in kept}
    out = graph.simplify(spark.createDataFrame(rows, "garden_id string, src long, dst long, edge_ord long, length double"))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == want and len(want) < len(rows)


def test_f6_forest_keeps_the_last():
    t = pa.table({"cu": [1, 2, 1, 1], "cv": [2, 3, 3, 2], "t": [{"a": k, "b": 9, "c": 10} for k in (0, 2, 3, 1)]})
    assert np.sort([r["a"] for r in graph.forest(t)["t"].to_pylist()]).tolist() == [2, 3]
