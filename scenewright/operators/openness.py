"""Open and enclosed space: a grid over a garden, features of each block, k-means, labels by visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenewright import schema as S
from scenewright.functions import expressions as E
from scenewright.functions.store import saved
from scenewright.operators import polygons, scores
from scenewright.operators.visibility import outlines


def block_grid(boxes: DataFrame, block: float) -> DataFrame:
    """garden_id, block_id, bx, by, cx, cy, x0, y0, x1, y1: square blocks over each box (garden_id, min_x, ...), row by row.

    The first and last centres lie half a block inside the box, the others evenly between, so blocks overlap where the
    box isn't a whole number of blocks; a single column lies at the low end."""
    b = boxes
    for axis in ("x", "y"):
        b = b.withColumn(f"n{axis}", F.greatest(F.lit(1), F.ceil((F.col(f"max_{axis}") - F.col(f"min_{axis}")) / block).cast("int")))
    b = b.withColumn("by", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    for axis in ("x", "y"):
        low, span = F.col(f"min_{axis}") + block / 2, F.col(f"max_{axis}") - F.col(f"min_{axis}") - block
        b = b.withColumn(f"c{axis}", low + F.when(F.col(f"n{axis}") > 1, F.col(f"b{axis}") * span / (F.col(f"n{axis}") - 1)).otherwise(0.0))
    return b.select("garden_id", (F.col("by") * F.col("nx") + F.col("bx")).cast("bigint").alias("block_id"), "bx", "by", "cx", "cy", *[(F.col(f"c{axis}") + sign * block / 2).alias(f"{axis}{k}") for k, sign in ((0, -1), (1, 1)) for axis in ("x", "y")])


def members(blocks: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that meet each block, whole: block columns as garden_id (garden/block) with the element's own columns."""
    area = polygons.clipped_area(blocks, elements).select("block_id", "elem_ord")
    return area.join(elements.hint("merge"), "elem_ord")


def block_features(blocks: DataFrame, elements: DataFrame, block: float, boundary: DataFrame | None = None) -> DataFrame:
    """block_id, features (39 numbers): structural features of the elements that meet the block, and the visibility of a
    square three times as wide inside the boundary, of those elements only; blocks without elements get zeros."""
    met = saved(members(blocks, elements), "members")
    keyed = met.withColumn("garden_id", F.col("block_id").cast("string"))
    structure = scores.structural_features(keyed)
    names = [c for c in structure.columns if c != "garden_id"]
    wide = blocks.select("block_id", *[(F.col(f"c{axis}") + sign * 1.5 * block).alias(f"{axis}{k}") for k, sign in ((0, -1), (1, 1)) for axis in ("x", "y")])
    inside = polygons.clipped_area(wide, elements.drop("garden_id"), boundary).join(met.select("block_id", "elem_ord", "transparent").hint("merge"), ["block_id", "elem_ord"])
    weighted = inside.groupBy("block_id").agg(F.sum(F.col("area") * F.col("transparent")).alias("s")).join(polygons.inside_area(wide, boundary), "block_id")
    seen = weighted.select("block_id", F.least(F.lit(1.0), F.col("s") / F.col("a")).alias("visibility"))
    out = blocks.join(structure.select(F.col("garden_id").cast("bigint").alias("block_id"), *names), "block_id", "left").join(seen, "block_id", "left")
    return out.select("garden_id", "block_id", "cx", "cy", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in [*names, "visibility"]]).alias("features"))


def label(features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds cluster and label: blocks with visibility are clustered; the half of the clusters with the lowest mean
    visibility is enclosed, the others open; blocks without visibility are boundary.

    With fewer such blocks than clusters all of them are enclosed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    seen = features.filter(F.element_at("features", -1) > 0)
    edge = features.filter(F.element_at("features", -1) <= 0).withColumn("cluster", F.lit(None).cast("int")).withColumn("label", F.lit("boundary"))
    if seen.count() < k:
        return seen.withColumn("cluster", F.lit(0)).withColumn("label", F.lit("enclosed")).unionByName(edge)
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(seen.withColumn("__v", array_to_vector("features")))
    centres = features.sparkSession.createDataFrame([("", c, float(v[-1])) for c, v in enumerate(model.clusterCenters())], "garden_id string, cluster int, visibility double")
    out = model.transform(seen.withColumn("__v", array_to_vector("features"))).drop("__v")
    return out.join(F.broadcast(rank_labels(centres, k).select("cluster", "label")), "cluster").select(*features.columns, "cluster", "label").unionByName(edge)


def rank_labels(clusters: DataFrame, k: int) -> DataFrame:
    """garden_id, cluster, label: of each garden's clusters the k // 2 of least visibility are enclosed, the others open.

    clusters: garden_id, cluster, visibility (k rows for each garden at most)."""
    rank = F.row_number().over(Window.partitionBy("garden_id").orderBy("visibility", "cluster"))
    return clusters.select("garden_id", "cluster", F.when(rank <= k // 2, "enclosed").otherwise("open").alias("label"))


def features(elements: DataFrame, boundary: DataFrame, *, max_distance: float = S.OPENNESS_DISTANCE, ratio: float = S.BLOCK_RATIO) -> DataFrame:
    """garden_id, block_id, cx, cy, features of the blocks of one garden.  boundary: one element; blocks outside it are zero."""
    block = max_distance * ratio
    box = outlines(boundary).groupBy("garden_id").agg(*[getattr(F, c[:3])(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    blocks = block_grid(box, block)
    inner = polygons.clipped_area(blocks, boundary).select("block_id").distinct()
    made = block_features(blocks.join(inner, "block_id", "left_semi"), elements, block, boundary.drop("garden_id"))
    zero = blocks.join(inner, "block_id", "left_anti").select("garden_id", "block_id", "cx", "cy", F.array_repeat(F.lit(0.0), 39).alias("features"))
    return saved(made.unionByName(zero), "features")


def analyze(elements: DataFrame, boundary: DataFrame, area: float | None = None, *, max_distance: float = S.OPENNESS_DISTANCE, ratio: float = S.BLOCK_RATIO, seed: int = 42) -> DataFrame:
    """Blocks of one garden with features, cluster and label."""
    k = elements.sparkSession.range(1).select(E.adaptive_k(F.lit(area).cast("double"))).collect()[0][0]
    return label(features(elements, boundary, max_distance=max_distance, ratio=ratio), k, seed)
