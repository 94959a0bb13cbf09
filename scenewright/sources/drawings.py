"""Drawings in the ASCII exchange format: entities, boundaries, profiles.

Files are read whole by Spark (any store, any number of files) and parsed in Arrow batches; a drawing is a few megabytes.
Lengths are divided by UNIT.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import schema as S

KINDS = ("LINE", "LWPOLYLINE", "POLYLINE", "SPLINE", "CIRCLE", "ARC")
SAMPLES = 50
PARSED = f"file string, entity_no int, kind string, layer string, color_index int, true_color int, linetype string, closed boolean, cx double, cy double, radius double, start_angle double, end_angle double, points array<{S.POINT}>, problem string"

NAMES = ["file", "entity_no", "kind", "layer", "color_index", "true_color", "linetype", "closed", "cx", "cy", "radius", "start_angle", "end_angle", "points", "problem"]


def decode(data: bytes) -> str:
    for encoding in ("utf-8", "gb18030"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def parse(text: str) -> list[dict]:
    """The entities of the model space, in the order of the file; vertices of a POLYLINE belong to it."""
    lines = text.splitlines()
    pairs = [(int(lines[i].strip()), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    out: list[dict] = []
    section, entity, polyline = None, None, None
    for at, (code, value) in enumerate(pairs):
        if code == 0:
            if value == "SECTION":
                section = pairs[at + 1][1] if at + 1 < len(pairs) else None
            elif value == "ENDSEC":
                section, polyline = None, None
            entity = None
            if section != "ENTITIES":
                continue
            if value == "VERTEX" and polyline is not None:
                entity = {"kind": "VERTEX", "of": polyline}
            elif value == "SEQEND":
                polyline = None
            elif value in KINDS:
                entity = {"kind": value, "layer": "0", "color_index": 256, "true_color": None, "linetype": "BYLAYER", "flags": 0, "xs": [], "ys": [], "end": [None, None], "radius": None, "angles": [None, None], "paper": 0, "degree": 3, "knots": [], "weights": []}
                polyline = entity if value == "POLYLINE" else None
                out.append(entity)
            continue
        if entity is None:
            continue
        if entity["kind"] == "VERTEX":
            if code in (10, 20):
                entity["of"]["xs" if code == 10 else "ys"].append(float(value))
            continue
        if code == 8:
            entity["layer"] = value
        elif code == 62:
            entity["color_index"] = int(value)
        elif code == 420:
            entity["true_color"] = int(value)
        elif code == 6:
            entity["linetype"] = value
        elif code == 67:
            entity["paper"] = int(value)
        elif code == 70 and entity["kind"] in ("LWPOLYLINE", "POLYLINE", "SPLINE"):
            entity["flags"] = int(value)
        elif code in (10, 20) and entity["kind"] != "POLYLINE":
            entity["xs" if code == 10 else "ys"].append(float(value))
        elif code in (11, 21) and entity["kind"] == "LINE":
            entity["end"][code == 21] = float(value)
        elif entity["kind"] == "SPLINE" and code == 71:
            entity["degree"] = int(value)
        elif entity["kind"] == "SPLINE" and code in (40, 41):
            entity["knots" if code == 40 else "weights"].append(float(value))
        elif code == 40 and entity["kind"] in ("CIRCLE", "ARC"):
            entity["radius"] = float(value)
        elif code in (50, 51) and entity["kind"] == "ARC":
            entity["angles"][code == 51] = float(value)
    return [e for e in out if not e["paper"]]


def curve(points: list[tuple[float, float]], degree: int, knots: list[float], weights: list[float], segments: int) -> list[tuple[float, float]]:
    """segments + 1 points of a B-spline at equal steps of its parameter; without knots of its own it is clamped and uniform."""
    n = len(points)
    degree = max(1, min(degree, n - 1))
    if len(knots) != n + degree + 1:
        knots = [0.0] * degree + [float(k) for k in range(n - degree + 1)] + [float(n - degree)] * degree
    weights = weights if len(weights) == n else [1.0] * n
    low, high, out = knots[degree], knots[n], []
    for k in range(segments + 1):
        u = low + (high - low) * k / segments
        span = max((i for i in range(degree, n) if knots[i] <= u and knots[i] < knots[i + 1]), default=degree)
        d = [(points[i][0] * weights[i], points[i][1] * weights[i], weights[i]) for i in range(span - degree, span + 1)]
        for level in range(1, degree + 1):  # corners are cut level by level
            for j in range(degree, level - 1, -1):
                i = span - degree + j
                width = knots[i + degree - level + 1] - knots[i]
                t = (u - knots[i]) / width if width else 0.0
                d[j] = tuple((1 - t) * a + t * b for a, b in zip(d[j - 1], d[j], strict=True))
        out.append((d[degree][0] / d[degree][2], d[degree][1] / d[degree][2]))
    return out


def _row(file: str, number: int, e: dict, samples: int = 0) -> tuple:
    points = list(zip(e["xs"], e["ys"], strict=False))
    if samples and e["kind"] == "SPLINE" and len(points) > 1:
        points = curve(points, e["degree"], e["knots"], e["weights"], samples)
    if e["kind"] == "LINE":
        points = points[:1] + ([tuple(e["end"])] if None not in e["end"] else [])
    round_ = e["kind"] in ("CIRCLE", "ARC")
    centre = points[0] if round_ and points else (None, None)
    scale = lambda v: None if v is None else v / S.UNIT
    return (file, number, e["kind"], e["layer"], e["color_index"], e["true_color"], e["linetype"], bool(e["flags"] & 1), scale(centre[0]), scale(centre[1]), scale(e["radius"]), *e["angles"], None if round_ else [{"x": x / S.UNIT, "y": y / S.UNIT} for x, y in points], None)


def _there(spark: SparkSession, paths: list[str]) -> list[bool]:
    """Which paths (or patterns) have a file, as the store itself says."""
    context = spark.sparkContext
    out = []
    for p in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at)
        out.append(found is not None and len(found) > 0)
    return out


def read(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", samples: int = 0) -> DataFrame:
    """All entities of the drawings.  A missing or unreadable file gives one row with its problem; with mode FAILFAST it fails.

    A spline's points are its control points, or with `samples` so many segments of its curve."""
    paths = [path] if isinstance(path, str) else list(path)
    lost = []
    if mode != "FAILFAST":
        there = _there(spark, paths)
        lost, paths = [p for p, ok in zip(paths, there, strict=True) if not ok], [p for p, ok in zip(paths, there, strict=True) if ok]
    missing = spark.createDataFrame([(p, -1, *[None] * 12, "missing") for p in lost], PARSED)
    if not paths:
        return missing
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for file, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows += [_row(file, k, e, samples) for k, e in enumerate(parse(decode(bytes(data))))]
                except (ValueError, IndexError) as problem:
                    if mode == "FAILFAST":
                        raise
                    rows.append((file, -1, *[None] * 12, str(problem)))
            yield pd.DataFrame(rows, columns=NAMES)

    found = files.mapInPandas(run, PARSED)
    return found.unionByName(missing) if lost else found


def write(entities_: DataFrame, path: str) -> None:
    """Writes drawings: file, entity_no, kind, layer, color_index, true_color, closed, cx, cy, radius, points (in metres).

    Each file becomes a folder file=... with one text of its entities in order; a drawing is one row."""
    pair = lambda code, value: F.concat(F.lit(f"{code}\n"), value.cast("string"), F.lit("\n"))
    mm = lambda v: v * S.UNIT
    at = lambda p, a=10, b=20: F.concat(pair(a, mm(p["x"])), pair(b, mm(p["y"])))
    each = lambda of: F.array_join(F.transform("points", of), "")
    flag = pair(70, F.coalesce(F.col("closed"), F.lit(False)).cast("int"))
    centre = F.concat(pair(10, mm(F.col("cx"))), pair(20, mm(F.col("cy"))), pair(40, mm(F.col("radius"))))
    layer = pair(8, F.col("layer"))
    body = (
        F.when(F.col("kind").isin("CIRCLE", "ARC"), centre)
        .when(F.col("kind") == "LINE", F.concat(at(F.col("points")[0]), at(F.element_at("points", -1), 11, 21)))
        .when(F.col("kind") == "POLYLINE", F.concat(flag, each(lambda p: F.concat(F.lit("0\nVERTEX\n"), layer, at(p))), F.lit("0\nSEQEND\n")))
        .when(F.col("kind") == "SPLINE", F.concat(flag, pair(71, F.lit(3)), each(lambda p: at(p))))
        .otherwise(F.concat(pair(90, F.size("points")), flag, each(lambda p: at(p))))
    )
    color = F.concat(F.coalesce(pair(62, F.col("color_index")), F.lit("")), F.coalesce(pair(420, F.col("true_color")), F.lit("")))
    text = F.concat(pair(0, F.col("kind")), layer, color, body)
    whole = F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_no", "t"))), lambda e: e["t"]), ""), F.lit("0\nENDSEC\n0\nEOF"))
    entities_.withColumn("t", text).groupBy("file").agg(whole.alias("value")).write.partitionBy("file").text(path)


def entities(parsed: DataFrame, garden_id=None) -> DataFrame:
    """Circles, then paths, in the order of the files, with entity_ord; other kinds go.

    garden_id: a column over `file`; by default the parent folder's name."""
    from scenewright.functions.expressions import garden_name
    from scenewright.operators.graph import numbered

    kept = parsed.filter("problem IS NULL AND kind <> 'ARC'").withColumn("garden_id", garden_name("file") if garden_id is None else garden_id)
    kept = kept.withColumn("__at", F.struct("garden_id", "file", (F.col("kind") != "CIRCLE").alias("path"), "entity_no"))
    return numbered(kept, "__at", "entity_ord").select("garden_id", "entity_ord", "kind", "layer", "color_index", "true_color", "linetype", "closed", "cx", "cy", "radius", "points")


def segments(entities_: DataFrame) -> DataFrame:
    """entity_ord, pos, x0, y0, x1, y1: consecutive points of each path; the closing side isn't added."""
    pairs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    return entities_.filter("size(points) >= 2").select("entity_ord", F.posexplode(pairs).alias("pos", "s")).select("entity_ord", "pos", "s.*")


def boundary(parsed: DataFrame, required: bool = False) -> DataFrame:
    """file, points: the first closed polyline of each file; with `required`, a file without one, or with one that crosses
    itself, fails when it is read."""
    if required:
        found = parsed.select("file").distinct().join(boundary(parsed), "file", "left")
        ring = F.concat("points", F.slice("points", 1, 1))
        edges = F.zip_with(F.slice(ring, 1, F.size("points")), F.slice(ring, 2, F.size("points")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        side = lambda e, p: (e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"])
        crosses = F.exists(edges, lambda e: F.exists(edges, lambda f: (side(e, f["p"]) * side(e, f["q"]) < 0) & (side(f, e["p"]) * side(f, e["q"]) < 0)))
        checked = F.when(F.col("points").isNull(), F.raise_error(F.concat(F.lit("no closed polyline in "), "file")).cast(f"array<{S.POINT}>"))
        return found.select("file", checked.when(crosses, F.raise_error(F.concat(F.lit("the boundary crosses itself in "), "file")).cast(f"array<{S.POINT}>")).otherwise(F.col("points")).alias("points"))
    closed = parsed.filter("closed AND kind IN ('LWPOLYLINE', 'POLYLINE') AND size(points) >= 3")
    return closed.groupBy("file").agg(F.min_by("points", "entity_no").alias("points"))


def profile(entities_: DataFrame) -> DataFrame:
    """file, kind, n, n_layers, n_colors, n_closed; a colour is the true colour, or the index if that is missing or 0."""
    color = F.coalesce(F.nullif("true_color", F.lit(0)), F.col("color_index"))
    return entities_.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("layer").alias("n_layers"), F.countDistinct(color).alias("n_colors"), F.count_if("closed").alias("n_closed"))
