"""What meets by grid cell is never broadcast, and pairs of elements are summed by parts."""

import math
import statistics

import pytest
from test_visibility import element, square, view

from scenewright.operators import polygons, scores, visibility


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark):
    return element(spark, *[("plant", 0.4, 1.0, [square(k, k, k + 9, k + 9)]) for k in range(20)], ("rock", 0.0, 1.5, [[(0, 20), (20, 0), (40, 20), (20, 40), (0, 20)]]))


def test_points(spark):
    held = visibility.points_in_elements(view(spark, (10.5, 10.25), (0.0, 4.0)), some(spark))
    assert "BroadcastHashJoin" not in plan(held)
    assert sorted((r.node_id, r.elem_ord) for r in held.collect() if r.elem_ord < 20 and r.node_id == 0) == [(0, k) for k in range(2, 11)]


def test_contained(spark):
    e = some(spark)
    found = polygons.contained(e, e)
    assert "BroadcastHashJoin" not in plan(found)
    want = {k for k in range(20) if all(abs(x - 20) + abs(y - 20) <= 20 for x in (k, k + 9) for y in (k, k + 9))}
    assert {(r.inner_ord, r.outer_ord) for r in found.collect()} == {(k, 20) for k in want} and want


def test_pair_distances_by_parts(spark, monkeypatch):
    monkeypatch.setattr(scores, "PART", 8)
    monkeypatch.setattr(scores, "BLOCK", (3, 4))
    at = [("g", k, ("rock", "plant")[k % 2], float(k * 7 % 31), float(k * 5 % 29)) for k in range(60)]
    r = scores.pair_distances(spark.createDataFrame(at, "garden_id string, elem_ord long, type string, x double, y double")).collect()
    d = [math.dist(a[3:], b[3:]) for a in at for b in at if a[2] == "rock" and b[2] == "plant"]
    assert [(x.type_a, x.type_b) for x in r] == [("rock", "plant")]
    assert r[0].mean_dist == pytest.approx(statistics.fmean(d)) and r[0].std_dist == pytest.approx(statistics.pstdev(d))
