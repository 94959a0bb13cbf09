import zipfile

import pytest

from scenewright.operators import elements, graph
from scenewright.sources import drawings, workbooks


def dxf(*entities):
    lines = ["0", "SECTION", "2", "HEADER", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    for e in entities:
        lines += [str(x) for pair in e for x in pair]
    return "\n".join([*lines, "0", "ENDSEC", "0", "EOF", ""])


def line(layer, *p):
    return [(0, "LINE"), (8, layer), (10, p[0]), (20, p[1]), (11, p[2]), (21, p[3])]


def poly(layer, points, flag=0):
    return [(0, "LWPOLYLINE"), (8, layer), (90, len(points)), (70, flag), *[x for px, py in points for x in ((10, px), (20, py))]]


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans") / "1. park"
    folder.mkdir()
    old = [(0, "POLYLINE"), (8, "water"), (70, 1), (10, 0), (20, 0), (0, "VERTEX"), (8, "water"), (10, 0), (20, 0), (0, "VERTEX"), (10, 9000), (20, 0), (0, "VERTEX"), (10, 9000), (20, 9000), (0, "SEQEND")]
    (folder / "plan.dxf").write_text(dxf(
        line("archi-w", 0, 0, 1000, 0), [(0, "CIRCLE"), (8, "plant"), (62, 3), (10, 4000), (20, 5000), (40, 500)], old,
        poly("water", square(20000, 20000, 20000)), poly("water", square(25000, 25000, 5000)),
        poly("archi", [(50000, 50000), (60000, 50000), (60000, 60000)]), poly("archi-w", square(70000, 70000, 4000)),
        poly("stone", [(70000, 69000), (79000, 69000), (75000, 79500), (69000, 78000)]), poly("stone", [(69500, 78200), (69000, 70000), (70000, 69000)]),
        [(0, "SPLINE"), (8, "path"), (70, 8), (10, 0), (20, 0), (10, 1000), (20, 1000), (10, 2000), (20, 0)], [(0, "ARC"), (8, "x"), (10, 1), (20, 2), (40, 3), (50, 0), (51, 90)], [(0, "TEXT"), (8, "x"), (1, "no")],
        [(0, "LINE"), (8, "ARCHI"), (10, 1), (20, 1), (11, 2), (21, 2), (420, 255)],
        poly("Path", [(0, 0), (1000, 0), (1000, 1000)], 1), line("PATH", 1000, 1000, 0, 0)))
    (folder / "bad.dxf").write_text("0\nSECTION\nx\ny\n")
    return drawings.read(spark, str(folder))


def test_reads_entities(parsed):
    rows = parsed.filter("problem IS NULL").orderBy("entity_no").collect()
    assert [r.kind for r in rows] == ["LINE", "CIRCLE", "POLYLINE", *["LWPOLYLINE"] * 6, "SPLINE", "ARC", "LINE", "LWPOLYLINE", "LINE"]
    assert (rows[1].cx, rows[1].cy, rows[1].radius, rows[1].color_index) == (4.0, 5.0, 0.5, 3)
    assert [(p.x, p.y) for p in rows[2].points] == [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)] and rows[2].closed
    assert rows[11].true_color == 255
    assert parsed.filter("problem IS NOT NULL").count() == 1
    assert [len(r.points) for r in drawings.boundary(parsed).collect()] == [3]


def test_failfast(spark, parsed):
    with pytest.raises(Exception, match="invalid literal"):
        drawings.read(spark, parsed.filter("problem IS NOT NULL").collect()[0].file, mode="FAILFAST").collect()


def test_entities_and_elements(parsed):
    e = drawings.entities(parsed)
    rows = e.orderBy("entity_ord").collect()
    assert [r.entity_ord for r in rows] == list(range(13)) and rows[0].kind == "CIRCLE" and {r.garden_id for r in rows} == {"park"}
    classified = elements.classify(e)
    got = {(r.layer, r.category, r.visibility) for r in classified.collect()}
    assert {("archi", "hollow wall", True), ("archi-w", "solid wall", False), ("ARCHI", "unknown", False), ("plant", "vegetation", False), ("stone", "rockery", False)} <= got
    assert drawings.segments(e).count() == 1 + 2 + 4 + 4 + 2 + 4 + 3 + 2 + 2 + 1 + 2 + 1
    built = elements.build(classified).orderBy("elem_ord").collect()
    assert [r.type for r in built] == ["water", "water", "building", "building", "rock", "plant"] and [r.elem_ord for r in built] == list(range(6))
    assert sorted(len(r.rings) for r in built if r.type == "water") == [1, 2]
    assert [(r.transparent, len(r.rings[0])) for r in built if r.type == "building"] == [(0.0, 4), (0.6, 6)]
    assert [r.transparent for r in built if r.type == "rock"] == [1.0]
    assert [(r.cx, r.radius, r.transparent) for r in built if r.type == "plant"] == [(4.0, 0.5, 0.4)]


def test_graph_of_layer(parsed):
    nodes, edges = graph.graph_of_layer(drawings.entities(parsed))
    at = {r.node_id: (round(r.x, 3), round(r.y, 3)) for r in nodes.collect()}
    assert len(at) == 4 and at[0] == (0.0, 0.0)
    assert sorted(tuple(sorted((at[r.src], at[r.dst]))) for r in edges.collect()) == sorted([((0.0, 0.0), (1.0, 1.0))] * 3 + [((1.0, 1.0), (2.0, 0.0)), ((0.0, 0.0), (1.0, 0.0)), ((1.0, 0.0), (1.0, 1.0))])


def test_workbook(spark, tmp_path):
    cells = [["1", "0,0", "1,2", "5", None], ["2", "3,4", "2,3", "1", "3,4;9,9"], ["3", "9,9", None, None, None], ["1", "1,1", "1,2", "7", None]]
    names = "ABCDE"
    body = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{names[k]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if "," in v else f'<c r="{names[k]}{i + 1}"><v>{v}</v></c>' for k, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(cells))
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    nodes, edges = workbooks.graph(workbooks.read_cells(spark, str(tmp_path / "g.xlsx")), "g", (10.0, 20.0))
    assert sorted((r.node_id, r.x, r.y) for r in nodes.collect()) == [(1, 11.0, 21.0), (2, 13.0, 24.0), (3, 19.0, 29.0)]
    rows = {(r.src, r.dst): r for r in edges.collect()}
    assert rows[1, 2].length == 7.0 and rows[1, 2].waypoints is None and [(p.x, p.y) for p in rows[2, 3].waypoints] == [(13.0, 24.0), (19.0, 29.0)]
    back = workbooks.waypoints(edges, spark.createDataFrame([(3, 2)], "src long, dst long")).collect()[0]
    assert [(p.x, p.y) for p in back.waypoints] == [(19.0, 29.0), (13.0, 24.0)]
    route = spark.createDataFrame([(0, 1, 1.0, 2.0), (1, 2, 3.0, 4.0), (2, 1, 1.0, 2.0)], "pos int, node_id long, x double, y double")
    workbooks.save_route(route, str(tmp_path / "route"))
    assert spark.read.parquet(str(tmp_path / "route")).count() == 3
