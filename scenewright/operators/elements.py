"""From classified drawing entities to landscape elements: water, buildings, rockeries, plants.

entities: garden_id, entity_ord, category, visibility, cx, cy, radius, points (the vertices of a path; null for a circle).
entity_ord is unique over all gardens; elements of different gardens never meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright import schema as S
from scenewright.functions import expressions as E
from scenewright.functions.store import saved
from scenewright.operators import polygons
from scenewright.operators.cluster import link_paths
from scenewright.operators.graph import numbered


def classify(entities: DataFrame) -> DataFrame:
    """Adds category and visibility by the layer's exact name."""
    def lookup(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    out = entities.withColumn("category", F.coalesce(F.try_element_at(lookup(S.LAYER_CATEGORY), F.col("layer")), F.lit(S.UNKNOWN_CATEGORY)))
    return out.withColumn("visibility", F.coalesce(F.try_element_at(lookup(S.CATEGORY_VISIBILITY), F.col("category")), F.lit(False)))


def _element(df: DataFrame, type_: str, gtype: str, ord_: str, **columns) -> DataFrame:
    """Rows in the element layout but for elem_ord; id counts from 0 within garden and type."""
    none = {"rings": F.lit(None).cast(S.RINGS), "cx": F.lit(None).cast("double"), "cy": F.lit(None).cast("double"), "radius": F.lit(None).cast("double"), "name": F.lit(None).cast("string"), "cluster_id": F.lit(None).cast("bigint")}
    values = none | {"type": F.lit(type_), "gtype": F.lit(gtype), "weight": F.lit(S.TYPE_WEIGHT[type_])} | columns
    return numbered(df.withColumns(values), ["garden_id", ord_], "id", within="garden_id").select("garden_id", "id", "type", "gtype", "rings", "cx", "cy", "radius", "transparent", "weight", "name", "cluster_id")


def water(entities: DataFrame) -> DataFrame:
    """Shore lines as polygons; one that lies in another becomes a hole of the first (lowest) that holds it."""
    paths = entities.filter("category = 'water' AND size(points) >= 2")
    doubled = F.flatten(F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda k: F.array(F.element_at("points", k), F.element_at("points", k + 1))))
    rings = paths.filter("size(points) >= 2").withColumn("ring", E.closed_ring(doubled)).filter(F.size(doubled) >= 3).select("garden_id", F.col("entity_ord").alias("elem_ord"), "ring")
    rings = saved(rings, "shores")  # built once, not at each use
    shapes = rings.select("garden_id", "elem_ord", F.lit("Polygon").alias("gtype"), F.array("ring").alias("rings"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")])
    inside = polygons.contained(shapes, shapes)
    first = saved(inside.groupBy("inner_ord").agg(F.min("outer_ord").alias("outer_ord")), "first")
    holes = first.join(rings.select(F.col("elem_ord").alias("inner_ord"), "ring"), "inner_ord").groupBy("outer_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("inner_ord", "ring"))), lambda x: x["ring"]).alias("holes"))
    outer = rings.join(first, rings.elem_ord == first.inner_ord, "left_anti").join(holes, F.col("elem_ord") == F.col("outer_ord"), "left")
    clusters = link_paths(paths.select("garden_id", F.col("entity_ord").alias("id"), "points"), S.WATER_LINK, "garden_id").withColumnRenamed("id", "elem_ord")
    ready = outer.join(clusters, "elem_ord", "left").withColumn("transparent", F.lit(1.0))
    return _element(ready, "water", "Polygon", "elem_ord", rings=F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(S.RINGS))), cluster_id=F.col("cluster_id"))


def building(entities: DataFrame) -> DataFrame:
    """Walls made 2 * WALL_HALF_WIDTH wide; a line of fewer than three points gives none, a loop gives a filled outline.

    The shell is stored without its closing vertex.  Solid walls come before hollow ones."""
    walls = entities.filter("category IN ('solid wall', 'hollow wall') AND size(points) >= 3")
    walls = walls.withColumn("place", (F.col("category") == "hollow wall").cast("int"))

    def widen(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                line = [(p["x"], p["y"]) for p in r.points]
                line = [p for k, p in enumerate(line) if k == 0 or p != line[k - 1]]
                if len(line) < 3:
                    continue
                ring = polygons.thicken(line, S.WALL_HALF_WIDTH)
                out.append((r.garden_id, r.place, r.entity_ord, 0.6 if r.visibility else 0.0, [[{"x": x, "y": y} for x, y in ring]]))
            yield pd.DataFrame(out, columns=["garden_id", "place", "entity_ord", "transparent", "made"])

    made = walls.select("garden_id", "place", "entity_ord", "visibility", "points").mapInPandas(widen, f"garden_id string, place int, entity_ord bigint, transparent double, made {S.RINGS}")
    return _element(made.withColumn("ord", F.struct("place", "entity_ord")), "building", "Polygon", "ord", rings=F.col("made"))


#: Clusters of more points than this are dealt over tiles, so many alphas wide.
OF_CLUSTER, TILE = 4096, 12
#: Outlines of more edges than this are dealt over strips.
LONG = 64


def _alpha_shapes(points: DataFrame, alpha: float) -> DataFrame:
    """garden_id, cluster_id, made: the alpha shape of the points (garden_id, cluster_id, x, y, all different) of each cluster; those
    of fewer than three corners have no row.

    A triangle that counts depends on what lies within 2 * alpha of its first corner, so tiles make those of their own points, and
    one task of a large cluster only meets the sides that tiles leave open."""
    cluster, made = ["garden_id", "cluster_id"], f"garden_id string, cluster_id bigint, made {S.RINGS}"
    large = saved(points.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OF_CLUSTER), "large")

    def row(pdf: pd.DataFrame, ring) -> pd.DataFrame:
        if len(ring) < 3:
            return pd.DataFrame({"garden_id": [], "cluster_id": [], "made": []})
        return pd.DataFrame({"garden_id": [pdf.garden_id.iloc[0]], "cluster_id": [pdf.cluster_id.iloc[0]], "made": [[[{"x": x, "y": y} for x, y in [*ring, ring[0]]]]]})

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        return row(pdf, polygons.alpha_shape(sorted(zip(pdf.x.tolist(), pdf.y.tolist(), strict=True)), alpha))

    def sides(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sides of a tile's parts, and the corners of the hull of its points."""
        pdf = pdf.sort_values(["x", "y"])
        own = pdf.own.to_numpy()
        out = [(k, s, *p, *q) for k, s, p, q in polygons.alpha_sides(pdf[["x", "y"]].to_numpy(), alpha, own)]
        out += [(-1, 0.0, *p, *p) for p in polygons.hull(list(zip(pdf.x[own].tolist(), pdf.y[own].tolist(), strict=True)))]
        out = pd.DataFrame(out, columns=["part", "area", "x1", "y1", "x2", "y2"])
        return out.assign(**{c: pdf[c].iloc[0] for c in (*cluster, "tx", "ty")})

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf[pdf.part >= 0]
        if not len(found):
            return row(pdf, polygons.hull(sorted(set(zip(pdf.x1.tolist(), pdf.y1.tolist(), strict=True)))))
        parts = zip(found.tx.tolist(), found.ty.tolist(), found.part.tolist(), strict=True)
        return row(pdf, polygons.outer_ring([(k, s, (x1, y1), (x2, y2)) for k, s, x1, y1, x2, y2 in zip(parts, *[found[c].tolist() for c in ("area", "x1", "y1", "x2", "y2")], strict=True)]))

    size, far = alpha * TILE, alpha * 2 * (1 + 1e-9)
    tiles = points.join(large, cluster, "left_semi")
    for t, c in (("tx", "x"), ("ty", "y")):
        tiles = tiles.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - far) / size), F.floor((F.col(c) + far) / size))))
    tiles = tiles.withColumn("own", (F.col("tx") == F.floor(F.col("x") / size)) & (F.col("ty") == F.floor(F.col("y") / size)))
    open_ = tiles.groupBy(*cluster, "tx", "ty").applyInPandas(sides, "garden_id string, cluster_id bigint, tx bigint, ty bigint, part bigint, area double, x1 double, y1 double, x2 double, y2 double")
    small = points.join(large, cluster, "left_anti").groupBy(*cluster).applyInPandas(shape, made)
    return small.unionByName(open_.groupBy(*cluster).applyInPandas(ring, made))


def _holding(inner: DataFrame, shapes: DataFrame) -> DataFrame:
    """cluster_id of the shapes that hold one of the inner elements."""
    long = F.size(F.element_at("rings", 1)) > LONG
    held = polygons.contained(inner, shapes.filter(~long)).unionByName(polygons.contained_in_long(inner, shapes.filter(long)))
    return held.select(F.col("outer_ord").alias("cluster_id")).distinct()


def rock(entities: DataFrame, buildings: DataFrame, alpha: float = S.ROCK_ALPHA) -> DataFrame:
    """Rockery lines linked within ROCK_LINK, each cluster as its alpha shape; transparent if it encloses a building."""
    paths = entities.filter("category = 'rockery' AND size(points) > 0")
    clusters = link_paths(paths.select("garden_id", F.col("entity_ord").alias("id"), "points"), S.ROCK_LINK, "garden_id")
    points = paths.join(clusters.withColumnRenamed("id", "entity_ord"), "entity_ord").select("garden_id", "cluster_id", F.explode("points").alias("p")).select("garden_id", "cluster_id", "p.x", "p.y").distinct()
    made = saved(_alpha_shapes(saved(points, "rocks"), alpha), "shapes")
    as_elements = made.select("garden_id", F.col("cluster_id").alias("elem_ord"), F.lit("Polygon").alias("gtype"), F.col("made").alias("rings"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")])
    inner = buildings.select("garden_id", F.xxhash64("garden_id", "id").alias("elem_ord"), "gtype", "rings", "cx", "cy", "radius")
    # most large shapes hold one of a few buildings; only those that don't meet all of them
    first = saved(_holding(inner.filter(F.pmod("elem_ord", F.lit(1024)) == 0), as_elements), "holding")
    rest = saved(as_elements.join(first, F.col("elem_ord") == F.col("cluster_id"), "left_anti"), "rest")
    box = {f"{end}_{k}": getattr(F, f"array_{end}")(E.coordinates(F.element_at("rings", 1), k)) for end in ("min", "max") for k in ("x", "y")}
    cells = lambda k: F.explode(F.sequence(F.floor((F.col(f"min_{k}") - 1e-9) / 16), F.floor(F.col(f"max_{k}") / 16))).alias(f"c{k}")
    around = saved(rest.withColumns(box).select("garden_id", cells("x"), "min_y", "max_y").select("garden_id", "cx", cells("y")).distinct().toDF("garden_id", "__cx", "__cy"), "around")
    corner = inner.withColumns({f"__c{k}": F.floor(F.array_min(E.coordinates(F.element_at("rings", 1), k)) / 16) for k in ("x", "y")})
    near = corner.join(around, ["garden_id", "__cx", "__cy"], "left_semi").drop("__cx", "__cy")
    holds = first.unionByName(_holding(near, rest)).withColumn("holds", F.lit(1.0))
    ready = made.join(holds, "cluster_id", "left").withColumn("transparent", F.coalesce("holds", F.lit(0.0)))
    return _element(ready, "rock", "Polygon", "cluster_id", rings=F.col("made"), cluster_id=F.col("cluster_id"))


def plant(entities: DataFrame) -> DataFrame:
    """A circle for each vegetation circle."""
    circles = entities.filter("category = 'vegetation' AND radius IS NOT NULL").withColumn("transparent", F.lit(0.4))
    return _element(circles, "plant", "Circle", "entity_ord", cx=F.col("cx"), cy=F.col("cy"), radius=F.col("radius"))


def build(entities: DataFrame) -> DataFrame:
    """All elements; elem_ord runs over water, buildings, rockeries and plants in that order within each garden."""
    b = building(entities)
    parts = [water(entities), b, rock(entities, b), plant(entities)]
    out = parts[0].withColumn("place", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("place", F.lit(k)))
    return numbered(out, ["garden_id", "place", "id"], "elem_ord", within="garden_id").select("garden_id", "elem_ord", *[c for c in out.columns if c not in ("garden_id", "place")])
