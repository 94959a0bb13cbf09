import math
import random

import pytest

from scenewright import schema as S
from scenewright.operators import polygons, scores, visibility


def element(spark, *rows):
    """(type, transparent, weight, rings) or (type, transparent, weight, (cx, cy, r))."""
    data = []
    for k, (t, transparent, weight, shape) in enumerate(rows):
        circle = isinstance(shape, tuple)
        rings = None if circle else [[{"x": float(x), "y": float(y)} for x, y in r] for r in shape]
        cx, cy, r = map(float, shape) if circle else (None, None, None)
        data.append(("g", k, k, t, "Circle" if circle else "Polygon", rings, cx, cy, r, transparent, weight, None, None))
    return spark.createDataFrame(data, S.ELEMENTS)


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def view(spark, *points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "node_id long, x double, y double")


def east(spark, elements, x=0.0, y=0.0, **options):
    rows = visibility.sector_features(view(spark, (x, y)), elements, n_sectors=64, rays_per_sector=1, **options).collect()
    return sum(r.value for r in rows if r.sector == 0)


def test_hand_computed_rays(spark):
    near = [square(2, -1, 4, 1)]
    assert east(spark, element(spark, ("rock", 0.0, 1.5, near))) == pytest.approx(1.330381, abs=1e-6)
    assert east(spark, element(spark, ("water", 1.0, 1.5, near))) == pytest.approx(2.510323, abs=1e-6)
    assert east(spark, element(spark, ("plant", 0.4, 0.65, [square(-1, -1, 1, 1)]))) == pytest.approx(0.883263, abs=1e-6)
    decayed = lambda d: math.exp(-3 * d / 50)
    assert east(spark, element(spark, ("water", 1.0, 1.5, [square(20, -1, 40, 1)]))) == pytest.approx(1.5 * (decayed(20) + decayed(30)), abs=1e-6)
    behind = element(spark, ("rock", 0.0, 1.5, near), ("water", 1.0, 1.5, [square(6, -1, 8, 1)]))
    assert east(spark, behind) == pytest.approx(1.330381, abs=1e-6)
    hole = element(spark, ("water", 1.0, 1.0, [square(2, -3, 10, 3), square(4, -1, 6, 1)]))
    assert east(spark, hole) == pytest.approx(sum(map(decayed, (2, 4, 6, 10))), abs=1e-6)
    # the polygon's outline meets the east ray at its vertex and, opposite, at another
    assert east(spark, element(spark, ("plant", 0.4, 1.0, (5.0, 0.0, 2.0)))) == pytest.approx(decayed(3) + 0.4 * decayed(7), abs=1e-6)


def brute(elements, px, py, n, length, weight=lambda d: math.exp(-3 * d / 50)):
    """Ray by ray, edge by edge."""
    out = {}
    for ray in range(n):
        dx, dy = math.cos(2 * math.pi * ray / n), math.sin(2 * math.pi * ray / n)
        hits = []
        for k, (t, transparent, w, rings) in enumerate(elements):
            ts = []
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                    ax, ay, bx, by = x1 - px, y1 - py, x2 - px, y2 - py
                    if (dx * ay - dy * ax >= 0) != (dx * by - dy * bx >= 0):
                        ts.append((ax * (by - ay) - ay * (bx - ax)) / (dx * (by - ay) - dy * (bx - ax)))
            hits += [(d, 1, k) for d in set(ts) if 1e-6 < d <= length]
            if sum(d > length for d in ts) % 2:
                hits.append((length, 1, k))
            if sum(d > 0 for d in ts) % 2:
                hits.append((0.3, 0, k))
        through = 1.0
        for d, _, k in sorted(hits):
            if through < 1e-5:
                break
            t, transparent, w, _ = elements[k]
            out[t, ray] = out.get((t, ray), 0) + weight(d) * w * through
            through *= transparent
    return out


def test_random_scenes_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(40):
        cx, cy, n = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.randrange(3, 9)
        ring = [(cx + rng.uniform(2, 12) * math.cos(2 * math.pi * k / n), cy + rng.uniform(2, 12) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        rows.append((rng.choice(S.SECTOR_TYPES), rng.choice([0.0, 0.4, 1.0]), 1.5, [[*ring, ring[0]]]))
    points = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(8)]
    got = {(r.node_id, r.type, r.sector): r.value for r in visibility.sector_features(view(spark, *points), element(spark, *rows), n_sectors=32, rays_per_sector=1).collect()}
    want = {(i, t, ray): v for i, (x, y) in enumerate(points) for (t, ray), v in brute(rows, x, y, 32, 30.0).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and len(want) > 100


def test_turning_the_scene_turns_the_sectors(spark):
    turn = lambda x, y: (-y, x)
    a = [square(5, 1, 9, 4), square(-8, 3, -6, 6)]
    one = [("rock", 0.0, 1.0, [r]) for r in a]
    two = [("rock", 0.0, 1.0, [[turn(*p) for p in r]]) for r in a]
    f = [{r.sector: r.value for r in visibility.sector_features(view(spark, (0.1, 0.2)), element(spark, *one)).collect()}, {r.sector: r.value for r in visibility.sector_features(view(spark, turn(0.1, 0.2)), element(spark, *two)).collect()}]
    assert {(s + 4) % 16: v for s, v in f[0].items()} == {s: pytest.approx(v, abs=1e-9) for s, v in f[1].items()}


def test_vectors_and_gardens_apart(spark):
    e = element(spark, ("rock", 0.0, 1.5, [square(2, -1, 4, 1)]))
    v = visibility.vectors(visibility.sector_features(view(spark, (0, 0)), e)).collect()[0].v
    assert len(v) == 64 and sum(x > 0 for x in v) >= 1 and all(v[k] == 0 for k in range(16))
    other = view(spark, (0, 0)).selectExpr("'other' AS garden_id", "*")
    assert visibility.sector_features(other, e).count() == 0


def test_visible_part_against_sampling(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        cx, cy, n = rng.uniform(0, 30), rng.uniform(0, 30), rng.randrange(3, 8)
        ring = [(cx + rng.uniform(2, 9) * math.cos(-2 * math.pi * k / n), cy + rng.uniform(2, 9) * math.sin(-2 * math.pi * k / n)) for k in range(n)]
        rows.append(("plant", rng.choice([0.4, 1.0]), 1.0, [[*ring, ring[0]]]))
    rows.append(("water", 1.0, 1.0, [square(3, 3, 27, 27), square(10, 10, 20, 20)[::-1], square(4, 4, 6, 6)]))
    blocks = spark.createDataFrame([(k, 10.0 * (k % 3), 10.0 * (k // 3), 10.0 * (k % 3) + 10, 10.0 * (k // 3) + 10) for k in range(9)], "block_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.block_id, r.elem_ord): r.area for r in polygons.clipped_area(blocks, element(spark, *rows)).collect()}

    def inside(rings, x, y):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                if (x1 > x) != (x2 > x) and y < y1 + (y2 - y1) * (x - x1) / (x2 - x1):
                    odd = not odd
        return odd

    m = 100
    for b in range(9):
        for k, (_, _, _, rings) in enumerate(rows):
            hits = sum(inside(rings, 10 * (b % 3) + (i + 0.5) * 10 / m, 10 * (b // 3) + (j + 0.5) * 10 / m) for i in range(m) for j in range(m))
            assert got.get((b, k), 0.0) == pytest.approx(hits * 100 / m / m, abs=1.5)
    part = {r.block_id: r.visibility for r in polygons.visible_part(blocks, element(spark, *rows)).collect()}
    assert len(part) == 9 and all(0 <= v <= 1 for v in part.values())


def test_feature_difference_is_symmetric_with_a_floor(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "node_id long, v array<double>")
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 9)], "src long, dst long")
    got = {(r.src, r.dst): r.score for r in scores.edge_scores(edges, vectors).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 1e-5}
    assert {(r.src, r.dst): r.score for r in scores.hybrid_scores(edges, vectors).collect()}[1, 9] == 0.0
