import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_large_joins import element, square

from scenewright import schema as S
from scenewright.operators import elements, polygons


def corners(ring):
    k = ring.index(min(ring))
    return ring[k:] + ring[:k]


def test_triangles_of_a_large_cluster():
    """Points on a grid, many on one circle: in seconds, not with the square of their number."""
    points = np.unique(np.random.default_rng(3).integers(0, 140, (9000, 2)), axis=0) / 10.0
    began = time.time()
    t = polygons.triangulate(points)
    assert time.time() - began < 20
    whole = np.round(points * 10).astype(int)
    twice = sum(int((whole[b, 0] - whole[a, 0]) * (whole[c, 1] - whole[a, 1]) - (whole[b, 1] - whole[a, 1]) * (whole[c, 0] - whole[a, 0])) for a, b, c in t)
    hull = polygons.hull([tuple(p) for p in whole.tolist()])
    assert twice == sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(hull, hull[1:] + hull[:1], strict=True))


def test_triangles_follow_from_the_points_alone():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        points = np.unique(rng.integers(0, 6, (25, 2)), axis=0).astype(float)
        other = rng.permutation(len(points))
        made = [{frozenset(map(tuple, p[list(t)].tolist())) for t in polygons.triangulate(p)} for p in (points, points[other])]
        assert made[0] == made[1] and made[0]
    assert polygons.triangulate(np.array([[0.0, 0.0], [1.0, 1.0], [3.0, 3.0], [2.0, 2.0]])) == []


def test_tiles_give_the_whole_shape(spark, monkeypatch):
    """Clusters dealt over tiles: with holes, with corners on tile borders, apart, on a line, too sparse for a triangle."""
    rng = random.Random(5)
    grid = [(float(x), float(y)) for x in range(-20, 40, 2) for y in range(-20, 40, 2) if not (0 < x < 20 and 0 < y < 20)]
    loose = [(round(rng.random() * 50, 1), round(rng.random() * 50, 1)) for _ in range(300)]
    of = {1: grid, 2: loose, 3: [(float(x), 5.0) for x in range(30)], 4: [(x * 30.0, y * 31.0 + x) for x in range(4) for y in range(4)], 5: loose[:40] + [(x + 70, y) for x, y in loose[40:200]]}
    monkeypatch.setattr(elements, "OF_CLUSTER", 10)
    monkeypatch.setattr(elements, "TILE", 4)
    rows = [("g", k, x, y) for k, points in of.items() for x, y in sorted(set(points))]
    for alpha in (2.0, 3.0):
        made = elements._alpha_shapes(spark.createDataFrame(rows, "garden_id string, cluster_id bigint, x double, y double"), alpha).collect()
        got = {r.cluster_id: corners([(p["x"], p["y"]) for p in r.made[0][:-1]]) for r in made}
        expected = {k: corners(polygons.alpha_shape(points, alpha)) for k, points in of.items()}
        assert got == expected


def test_long_outlines_hold_what_others_do(spark):
    shapes = [("rock", 0.0, 1.0, [[(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)]]), ("rock", 0.0, 1.0, [square(-5, 0, -1, 4)])]
    inner = [("building", 0.0, 1.0, [square(x, y, x + w, y + w)]) for x, y, w in itertools.product((-5, 0, 1, 6, 9, 12, 21), (0, 2, 8, 11), (1, 4, 9))]
    a, b = element(spark, *inner).withColumn("elem_ord", F.col("elem_ord") + 100), element(spark, *shapes)
    expected = sorted(map(tuple, polygons.contained(a, b).collect()))
    assert expected and len(expected) < 2 * len(inner)
    assert sorted(map(tuple, polygons.contained_in_long(a, b).collect())) == expected


def test_large_rocks_hold_buildings(spark, monkeypatch):
    monkeypatch.setattr(elements, "OF_CLUSTER", 10)
    monkeypatch.setattr(elements, "LONG", 10)
    line = lambda k, x, y: ("g", k, "rockery", [(x + i * 0.5, y + j * 0.5) for i in range(20) for j in range(20)])
    lines = spark.createDataFrame([line(1, 0, 0), line(2, 100, 0)], f"garden_id string, entity_ord bigint, category string, points {S.RINGS[6:-1]}")
    inside = element(spark, ("building", 0.0, 2.0, [square(2, 2, 4, 4)]), ("building", 0.0, 2.0, [square(108, 2, 112, 4)])).withColumn("id", F.col("elem_ord"))
    assert {(r.cluster_id, r.transparent) for r in elements.rock(lines, inside).collect()} == {(1, 1.0), (2, 0.0)}
