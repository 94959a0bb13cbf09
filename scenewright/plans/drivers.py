"""What is done for one garden of the table of gardens, from its files to the answer, in one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scenewright.functions.store import saved
from scenewright.operators import cluster, elements, graph, openness, routes, scores, visibility
from scenewright.sources import drawings, workbooks


def landscape(spark: SparkSession, garden: Row) -> DataFrame:
    """The elements of the garden's drawing."""
    parsed = drawings.read(spark, garden.dxf_file, mode="FAILFAST")
    return saved(elements.build(elements.classify(drawings.entities(parsed, F.lit(garden.name)))), "landscape")


def footpaths(spark: SparkSession, garden: Row) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the garden's workbook, moved by its offset."""
    return workbooks.graph(workbooks.read_cells(spark, garden.path_file), garden.name, (garden.offset.x, garden.offset.y))


def _vectors(nodes: DataFrame, landscape_: DataFrame) -> DataFrame:
    """A vector for every node; zeros where nothing is seen."""
    seen = visibility.vectors(visibility.sector_features(nodes, landscape_))
    nothing = F.array_repeat(F.lit(0.0), 64)
    return nodes.select("node_id").join(seen, "node_id", "left").select("node_id", F.coalesce("v", nothing).alias("v"))


def score_route(spark: SparkSession, garden: Row) -> DataFrame:
    """src, dst, score: how much the view changes along each edge of the saved route."""
    route = saved(workbooks.route_of_cells(workbooks.read_cells(spark, garden.result, 3)), "route")
    nodes = route.select("node_id", "x", "y").dropDuplicates(["node_id"])
    links = workbooks.route_links(route).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return scores.edge_scores(links, saved(_vectors(nodes, landscape(spark, garden)), "vectors"))


def plan_route(spark: SparkSession, garden: Row, *, population: int = 100, generations: int = 100, weights: routes.Weights = routes.Weights(4, 3, 6.5, 0.03), eps: float = 5.0, seed: int = 0) -> tuple[DataFrame, float]:
    """(pos, node_id, x, y) of the best route found from the garden's start to its end, and its fitness."""
    nodes, edges = (saved(t, name) for t, name in zip(footpaths(spark, garden), ("nodes", "edges"), strict=True))
    links = saved(graph.simplify(edges), "links")
    ends = spark.createDataFrame([(0, garden.start.x, garden.start.y), (1, garden.end.x, garden.end.y)], "point_id long, px double, py double")
    start, end = (r.node_id for r in graph.nearest_node(nodes, ends).orderBy("point_id").collect())  # two rows
    vectors = saved(_vectors(nodes, landscape(spark, garden)), "vectors")
    of = scores.edge_scores(links.select(F.col("u").alias("src"), F.col("v").alias("dst")), vectors)
    park = routes.park_of(nodes, links, of, vectors, cluster.node_clusters(nodes, eps))
    path, value = routes.search(spark, park, start, end, population=population, generations=generations, weights=weights, seed=seed)
    return routes.route_table(spark, park, path), value


def score_openness(spark: SparkSession, garden: Row, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The garden's structural features, its blocks with features and labels, and its score."""
    built = landscape(spark, garden)
    ring = drawings.boundary(drawings.read(spark, garden.boundary, mode="FAILFAST"), required=True)
    none = [F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")]
    boundary = ring.select(F.lit(garden.name).alias("garden_id"), F.lit(-1).cast("bigint").alias("elem_ord"), F.lit("Polygon").alias("gtype"), F.array("points").alias("rings"), *none)
    blocks = saved(openness.analyze(built, boundary, garden.area, **options), "blocks")
    return scores.structural_features(built), blocks, scores.garden_score(blocks)
