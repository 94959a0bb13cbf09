"""Boundaries, curves, crossing walls, single points of sight, bridges, nearest nodes and children of routes."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_algorithms import area, park, ring_graph
from test_drawings import dxf, line, poly
from test_visibility import element, square, view

from scenewright.operators import elements, graph, openness, polygons, routes, visibility
from scenewright.sources import drawings, workbooks


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (x1 > x) != (x2 > x) and y < y1 + (y2 - y1) * (x - x1) / (x2 - x1):
            odd = not odd
    return odd


def test_a_wall_that_crosses_itself():
    ring = polygons.thicken([(0, 0), (10, 10), (10, 0), (0, 10)], 0.2)
    n = 150
    cells = [(-1 + 12 * (i + 0.5) / n, -1 + 12 * (j + 0.5) / n) for i in range(n) for j in range(n)]
    assert inside(ring, 8, 5) and inside(ring, 2, 2) and inside(ring, 2, 8) and not inside(ring, 5, 8) and not inside(ring, 2, 5)
    assert area(ring) == pytest.approx(sum(inside(ring, *c) for c in cells) * 144 / n / n, abs=0.3) and area(ring) > 25
    assert polygons.outer_face([(0, 0), (2, 0), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    bow = polygons.outer_face([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert area(bow) == pytest.approx(8) and (2.0, 2.0) in bow
    assert area(polygons.thicken([(0, 0), (10, 0), (0, 0)], 0.2)) == pytest.approx(4.0)


def test_curves():
    p = [(0.0, 0.0), (1.0, 2.0), (3.0, 3.0), (4.0, 0.0)]
    got = drawings.curve(p, 3, [0, 0, 0, 0, 1, 1, 1, 1], [], 50)
    for k, (x, y) in enumerate(got):
        t = k / 50
        b = [(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3]
        assert (x, y) == (pytest.approx(sum(w * q[0] for w, q in zip(b, p, strict=True))), pytest.approx(sum(w * q[1] for w, q in zip(b, p, strict=True))))
    assert len(got) == 51 and drawings.curve(p, 3, [], [], 4)[::4] == [p[0], p[-1]]
    arc = drawings.curve([(1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], 2, [0, 0, 0, 1, 1, 1], [1, math.sqrt(0.5), 1], 20)
    assert all(math.hypot(x, y) == pytest.approx(1) for x, y in arc)
    many = drawings.curve([(float(k), float(k % 3)) for k in range(9)], 3, [], [], 50)
    assert all(math.dist(a, b) < 1 for a, b in zip(many, many[1:], strict=False))


def test_missing_drawings_and_boundaries(spark, tmp_path):
    good, none, bow = tmp_path / "a.dxf", tmp_path / "b.dxf", tmp_path / "c.dxf"
    good.write_text(dxf(poly("x", [(0, 0), (9000, 0), (9000, 9000)], 1)))
    none.write_text(dxf(line("x", 0, 0, 1000, 0)))
    bow.write_text(dxf(poly("x", [(0, 0), (4000, 4000), (4000, 0), (0, 4000)], 1)))
    paths = [str(good), str(tmp_path / "lost.dxf"), str(none)]
    rows = drawings.read(spark, paths).collect()
    assert [(r.file, r.problem) for r in rows if r.problem] == [(paths[1], "missing")] and len(rows) == 3
    assert [r.problem for r in drawings.read(spark, paths[1]).collect()] == ["missing"]
    with pytest.raises(Exception, match="lost"):
        drawings.read(spark, paths, mode="FAILFAST").collect()
    assert [len(r.points) for r in drawings.boundary(drawings.read(spark, [str(good)]), required=True).collect()] == [3]
    assert drawings.boundary(drawings.read(spark, [str(none)])).count() == 0
    for path, what in ((none, "no closed polyline"), (bow, "crosses itself")):
        with pytest.raises(Exception, match=what):
            drawings.boundary(drawings.read(spark, [str(path)]), required=True).collect()


def test_visible_part_inside_a_boundary_against_sampling(spark):
    rng = random.Random(5)
    rows = [("plant", rng.choice([0.4, 1.0]), 1.0, [[*r, r[0]]]) for r in ([(cx + rng.uniform(2, 9) * math.cos(2 * math.pi * k / n), cy + rng.uniform(2, 9) * math.sin(2 * math.pi * k / n)) for k in range(n)] for cx, cy, n in ((rng.uniform(0, 30), rng.uniform(0, 30), rng.randrange(3, 8)) for _ in range(10)))]
    hole = [(12, 3), (12, 8), (17, 8), (17, 3), (12, 3)]
    shape = [(-5, 2), (14, -3), (28, 4), (24, 13), (31, 29), (16, 20), (3, 33), (8, 14), (-5, 2)]
    blocks = spark.createDataFrame([(k, 10.0 * (k % 3), 10.0 * (k // 3), 10.0 * (k % 3) + 10, 10.0 * (k // 3) + 10) for k in range(9)], "block_id long, x0 double, y0 double, x1 double, y1 double")
    bound = element(spark, ("rock", 0.0, 1.0, [shape, hole]))
    got = {r.block_id: r.visibility for r in polygons.visible_part(blocks, element(spark, *rows), bound).collect()}
    m = 80
    for b in range(9):
        cells = [(10 * (b % 3) + (i + 0.5) * 10 / m, 10 * (b // 3) + (j + 0.5) * 10 / m) for i in range(m) for j in range(m)]
        own = [c for c in cells if inside(shape[:-1], *c) and not inside(hole[:-1], *c)]
        total = sum(t * inside(r[0][:-1], *c) for _, t, _, r in rows for c in own)
        assert got[b] == pytest.approx(min(1, total / len(own)) if own else 0, abs=0.02)


def test_blocks_outside_the_boundary_are_zero(spark):
    e = element(spark, ("water", 1.0, 1.0, [square(2, 2, 28, 28)]), ("rock", 0.0, 1.0, [square(40, 40, 50, 50)]))
    bound = element(spark, ("rock", 0.0, 1.0, [[(0, 0), (60, 0), (60, 20), (20, 20), (20, 60), (0, 60), (0, 0)]])).withColumn("elem_ord", F.lit(-1).cast("bigint"))
    got = {(r.cx, r.cy): r.features for r in openness.features(e, bound, max_distance=100 / 3, ratio=0.3).collect()}
    assert len(got) == 36 and not any(got[45.0, 45.0]) and got[5.0, 5.0][0] == 1
    # a square of 30 around (5, 5): 20 by 20 inside, of which the water covers 18 by 18
    assert got[5.0, 5.0][-1] == pytest.approx((18 * 18) / 400)


def test_single_points(spark):
    sees = lambda *rows: {(r.type, r.sector): r.value for r in visibility.opacity_features(view(spark, (0, 0)), element(spark, *rows), n_sectors=4, rays_per_sector=1).collect()}
    tip = [(5, 0), (6, 2), (4, 2), (5, 0)]
    assert sees(("rock", 0.0, 2.0, [tip])) == {("rock", 0): pytest.approx(2 * math.exp(-0.1))}
    assert sees(("rock", 0.0, 2.0, [square(2, -1, 4, 1)]), ("plant", 0.4, 1.0, (10.0, 0.3, 2.0))) == {}
    hedge = element(spark, ("plant", 0.4, 1.0, [[(3, -1), (3, 1), (8, 1), (8, -1)]]), ("rock", 0.0, 2.0, [tip])).withColumn("gtype", F.when(F.col("type") == "plant", "Polyline").otherwise(F.col("gtype")))
    got = {r.type: r.value for r in visibility.opacity_features(view(spark, (0, 0)), hedge, n_sectors=4, rays_per_sector=1).collect() if r.sector == 0}
    assert got == {"plant": pytest.approx(math.exp(-0.06)), "rock": pytest.approx(0.4 * 2 * math.exp(-0.1))}  # the rock hides the second crossing


def test_bridges_and_walks(spark):
    rng = random.Random(2)
    links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(42)})
    df = spark.createDataFrame(links, "u long, v long")
    near = {i: set() for i in range(40)}
    for u, v in links:
        near[u].add(v)
        near[v].add(u)
    got = {(r.u, r.v): r.bridge for r in graph.bridges(df).collect()}
    assert got == {e: not graph.reaches(near, *e, without=e) for e in links} and 0 < sum(got.values()) < len(links)
    start = spark.createDataFrame([(w, w % 40) for w in range(400)], "walker long, node_id long")
    walks = {}
    for r in graph.random_walks(df, start, 6, seed=1).orderBy("walker", "pos").collect():
        walks.setdefault(r.walker, []).append(r.node_id)
    assert all(len(w) == (7 if near[w[0]] else 1) and all(b in near[a] for a, b in zip(w, w[1:], strict=False)) for w in walks.values()) and len(walks) == 400
    fresh = {}
    for r in graph.random_walks(df, start.limit(40), 6, seed=1, fresh=True).orderBy("walker", "pos").collect():
        fresh.setdefault(r.walker, []).append(r.node_id)
    assert all(w[k] not in w[:k] or not near[w[k - 1]] - set(w[:k]) for w in fresh.values() for k in range(1, len(w)))


def test_nearest_node(spark):
    rng = random.Random(3)
    nodes = [(k, k, rng.uniform(0, 100), rng.uniform(0, 30)) for k in range(60)] + [(60, 60, 500.0, 500.0), (61, 61, 500.0, 500.0)]
    points = [(k, rng.uniform(-300, 600), rng.uniform(-300, 600)) for k in range(40)]
    got = {r.point_id: r.node_id for r in graph.nearest_node(spark.createDataFrame(nodes, "node_id long, node_ord long, x double, y double"), spark.createDataFrame(points, "point_id long, px double, py double")).collect()}
    assert got == {p: min(nodes, key=lambda n: (math.dist(n[2:], (x, y)), n[1]))[0] for p, x, y in points}


def test_children_and_first_routes():
    p, rng = park(), random.Random(1)
    legal = lambda path: all(b in p.graph[a] for a, b in zip(path, path[1:], strict=False))
    for ends in ((0, 0), (0, 5)):
        made = [routes.initial_route(p, *ends, rng) for _ in range(6)]
        assert all((m[0], m[-1]) == ends and legal(m) for m in made)
        for a, b in zip(made, made[1:], strict=False):
            one, two = routes.crossover(p, a, b, ends[1], rng)
            assert all((c[0], c[-1]) == ends and legal(c) for c in (one, two))
            assert legal(routes.mutate(p, one, rng))
    assert graph.dijkstra(ring_graph(), 0, 4, weighted=False) == [0, 4]


def test_walls_there_and_back(spark):
    wall = [(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)]
    rows = [("g", 1, "solid wall", False, [{"x": x, "y": y} for x, y in wall])]
    made = elements.building(spark.createDataFrame(rows, "garden_id string, entity_ord long, category string, visibility boolean, points array<struct<x: double, y: double>>")).collect()
    assert len(made) == 1 and area([(q.x, q.y) for q in made[0].rings[0]]) == pytest.approx(1.6)


def test_workbook_cells():
    rows = [["a<b&c", None, "1,2"], [None, "é", None]]
    assert workbooks.sheet(workbooks.book(rows)) == rows
