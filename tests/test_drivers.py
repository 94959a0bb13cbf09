"""One small garden from its files to scores, a route and open space."""

import json

import pytest
from test_drawings import dxf, poly, square

from scenewright.plans import drivers
from scenewright.sources import gardens, workbooks


@pytest.fixture(scope="module")
def garden(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gardens")
    (folder / "plan.dxf").write_text(dxf(poly("water", square(2000, 2000, 8000)), poly("archi-w", square(20000, 4000, 4000)), poly("stone", [(12000, 15000), (16000, 15500), (15000, 19000), (12000, 18000)]),
                                         *[[(0, "CIRCLE"), (8, "plant"), (10, x), (20, 25000), (40, 900)] for x in range(2000, 30000, 4000)]))
    (folder / "edge.dxf").write_text(dxf(poly("x", [(0, 0), (30000, 0), (30000, 30000), (0, 30000)], 1)))
    spots = {k: (5.0 + 5 * (k % 5), 3.0 + 5 * (k // 5)) for k in range(25)}
    edges = [(k, k + 1) for k in spots if k % 5 < 4] + [(k, k + 5) for k in spots if k < 20] + [(0, 6), (6, 12)]
    rows = [[str(k), f"{x - 1},{y}", *(["{},{}".format(*edges[k]), "5"] if k < len(edges) else [None, None])] for k, (x, y) in spots.items()]
    rows += [[None, None, "{},{}".format(*e), "5"] for e in edges[25:]]
    (folder / "paths.xlsx").write_bytes(workbooks.book(rows))
    (folder / "route.xlsx").write_bytes(workbooks.book([["node_id", "x", "y"], *[[str(k), *map(str, spots[k])] for k in (0, 1, 2, 7, 2)]]))
    lines = [{"name": "one", "dxf_file": f"{folder}/plan.dxf", "path_file": f"{folder}/paths.xlsx", "offset": {"x": 1.0, "y": 0.0}, "start": {"x": 5.2, "y": 3.1}, "end": {"x": 24.0, "y": 23.5}, "result": f"{folder}/route.xlsx", "area": 0.8, "boundary": f"{folder}/edge.dxf"},
             {"name": "two", "dxf_file": "nowhere", "enabled": False}]
    (folder / "gardens.json").write_text("\n".join(map(json.dumps, lines)))
    assert gardens.read(spark, f"{folder}/gardens.json", every=True).count() == 2
    return gardens.read(spark, f"{folder}/gardens.json").collect()[0]


def test_route_scores(spark, garden):
    got = {(r.src, r.dst): r.score for r in drivers.score_route(spark, garden).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 7)} and all(v >= 1e-5 for v in got.values())


def test_route_planning(spark, garden):
    route, value = drivers.plan_route(spark, garden, population=6, generations=2)
    rows = route.orderBy("pos").collect()
    assert (rows[0].node_id, rows[-1].node_id) == (0, 24) and (rows[0].x, rows[0].y) == (5.0, 3.0) and value > 0


def test_openness(spark, garden):
    structure, blocks, score = drivers.score_openness(spark, garden)
    row = structure.collect()[0]
    assert (row.water_count, row.plant_count, row.building_count, row.rock_count) == (1, 7, 1, 1)
    assert blocks.count() == 4 and {r.label for r in blocks.collect()} <= {"open", "enclosed", "boundary"}
    assert 0 <= score.collect()[0].score <= 100
