import itertools
import math
import random

import numpy as np
import pytest

from scenewright.operators import cluster, graph, openness, polygons, routes
from scenewright.streaming import viewpoints as streaming


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def test_hull():
    rng = random.Random(1)
    pts = [(rng.random(), rng.random()) for _ in range(60)]
    ring = polygons.hull(pts)
    assert area(ring) > 0 and all(min((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) > -1e-12 for p in pts)
    assert polygons.hull([(1, 2)]) == [(1, 2)] and polygons.hull([(2, 0), (0, 0), (1, 0)]) == [(0, 0), (1, 0), (2, 0)]


def test_triangles_are_delaunay():
    rng = np.random.default_rng(2)
    p = rng.random((40, 2))
    t = polygons.triangulate(p)
    total = sum(abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])) / 2 for a, b, c in t)
    assert total == pytest.approx(area(polygons.hull([tuple(x) for x in p])), rel=1e-3)
    for a, b, c in t:
        (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = math.dist((ux, uy), p[a])
        assert all(math.dist((ux, uy), q) > r - 1e-7 for q in p)


def test_alpha_shape():
    grid = [(float(x), float(y)) for x in range(6) for y in range(6) if not (x >= 3 and y >= 3)]
    assert area(polygons.alpha_shape(grid, 1.0)) == pytest.approx(25 - 9, abs=1.01)  # an L, its inner corner cut or not
    assert area(polygons.alpha_shape(grid, 100.0)) == pytest.approx(25 - 4.5, abs=0.01)
    assert polygons.alpha_shape(grid[:3], 1.0) == grid[:3]
    two = grid + [(x + 50, y) for x, y in grid[:4]] + [(51.0, 0.0)]
    assert max(p[0] for p in polygons.alpha_shape(two, 1.0)) == 5.0


def test_thicken():
    assert area(polygons.thicken([(0, 0), (10, 0), (10, 10)], 0.2)) == pytest.approx(2 * 10 * 0.4, abs=1e-9)
    loop = polygons.thicken([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], 0.2)
    assert area(loop) == pytest.approx(10.4**2) and len(loop) == 4
    assert area(polygons.thicken([(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], 0.2)) == pytest.approx(10.4**2)
    with pytest.raises(ValueError):
        polygons.thicken([(0, 0), (0, 0)], 0.2)


def test_optics():
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in (0, 10, 20)] + [[[100.0, 100.0]]])
    labels = cluster.optics_labels(xy, 5.0)
    assert labels[-1] == -1 and all(len(set(labels[k : k + 15][labels[k : k + 15] >= 0]) & set(labels[:k][labels[:k] >= 0])) == 0 for k in (15, 30))
    assert (cluster.optics_labels(xy[:1], 5.0) == -1).all()


def ring_graph(n=9):
    rng = random.Random(4)
    rows = [(i, (i + 1) % n, 1 + rng.random()) for i in range(n)] + [(0, 4, 2.5), (2, 6, 1.2), (1, 7, 0.7)]
    return graph.adjacency(rows)


def simple_paths(g, a, b):
    out, todo = [], [[a]]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            out.append(p)
            continue
        todo += [[*p, x] for x in g[p[-1]] if x not in p]
    return sorted(out, key=lambda p: (graph.path_length(g, p), p))


def test_shortest_paths(spark):
    g = ring_graph()
    for a, b in itertools.permutations(range(9), 2):
        every = simple_paths(g, a, b)
        assert graph.dijkstra(g, a, b) == every[0]
        assert graph.k_shortest(g, a, b, 6) == every[:6]
        assert len(graph.dijkstra(g, a, b, weighted=False)) == min(map(len, every))
    assert graph.dijkstra(g, 3, 3) == [3] and graph.dijkstra(g | {99: {}}, 0, 99) is None
    links = spark.createDataFrame([(u, v, d) for u in g for v, d in g[u].items() if u < v], "u long, v long, length double")
    got = {r.node_id: r.dist for r in graph.shortest_paths(links, 0).collect()}
    assert got == {b: pytest.approx(graph.path_length(g, graph.dijkstra(g, 0, b))) for b in range(9)}


def test_simplify(spark):
    rows = [("g", 1, 2, 0, 3.0), ("g", 3, 2, 1, 4.0), ("g", 1, 3, 2, 6.0), ("g", 3, 4, 3, 1.0), ("h", 1, 2, 0, 1.0), ("h", 2, 1, 1, 9.0)]
    out = graph.simplify(spark.createDataFrame(rows, "garden_id string, src long, dst long, edge_ord long, length double"))
    assert sorted(map(tuple, out.collect())) == [("g", 1, 2, 3.0), ("g", 2, 3, 4.0), ("g", 3, 4, 1.0), ("h", 1, 2, 9.0)]


def park():
    rng = random.Random(9)
    xy = {i: (rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(30)}
    rows = [(a, b, math.dist(xy[a], xy[b])) for a, b in itertools.combinations(xy, 2) if math.dist(xy[a], xy[b]) < 22]
    g = graph.adjacency(rows)
    return routes.Park(g, xy, {(a, b): rng.uniform(0, 10) for a, b, _ in rows}, {i: tuple(rng.random() for _ in range(4)) for i in xy}, {i: i % 6 for i in xy})


@pytest.mark.parametrize("ends", [(0, 0), (0, 5)])
def test_genetic_search(spark, ends):
    p = park()
    path, value = routes.search(spark, p, *ends, population=8, generations=3, seed=2)
    assert (path[0], path[-1]) == ends and all(b in p.graph[a] for a, b in zip(path, path[1:], strict=False))
    assert value == pytest.approx(routes.fitness(p, path, routes.Weights()))
    assert routes.search(spark, park(), *ends, population=8, generations=3, seed=2) == (path, value)


def test_fitness_parts():
    p = park()
    assert math.isnan(p.fun([0])) and 0.5 - 1e-9 <= p.fun([0, next(iter(p.graph[0]))]) <= 1
    a, b = 0, next(iter(p.graph[0]))
    w = routes.Weights(0, 1, 0, 1)
    flat = routes.Park(p.graph, p.xy, p.scores, p.types)
    costs = lambda path: routes.fitness(flat, path, w)
    assert costs([a, b]) == 1e-6  # costs alone are negative: the floor


def test_candidates():
    p = park()
    found = graph.candidate_paths(p.graph, p.scores, 0, 5, k_paths=4)
    assert found and all((f[0], f[-1]) == (0, 5) for f in found) and graph.candidate_paths(p.graph, {}, 0, 5) == []


def test_openness_fallbacks(spark):
    rows = [("g", k, 0.0, 0.0, [float(k), 0.1 * k]) for k in range(4)]
    df = spark.createDataFrame(rows, "garden_id string, block_id long, cx double, cy double, features array<double>")
    assert {r.block_id: r.label for r in openness.label(df, 6).collect()} == {0: "boundary", 1: "enclosed", 2: "enclosed", 3: "enclosed"}
    assert {r.label for r in openness.label(df, 2).collect()} == {"boundary", "enclosed", "open"}


def test_stream(spark, tmp_path):
    from test_visibility import element, square

    spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.5)], "node_id long, x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("node_id long, x double, y double").parquet(str(tmp_path / "in"))
    e = element(spark, ("rock", 0.0, 1.5, [square(2, -1, 4, 1)]))
    streaming.stream_features(stream, e, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.node_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}
