"""Registered queries over the star-schema tables: each applies one operator to its whole derived input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright import schema as S
from scenewright.functions import expressions as E
from scenewright.functions import store
from scenewright.operators import cluster, elements, graph, openness, polygons, routes, scores, visibility
from scenewright.plans.scene import Scene
from scenewright.sources import drawings, workbooks

QUERIES = {}


def query(f):
    """Registers a function of a Scene under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Scene(spark, sf_dir))
    return f


def r6(x: str | Column) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(x, 6) + 0.0


# visibility and scores


def _view_vectors(s: Scene) -> DataFrame:
    return visibility.vectors(visibility.sector_features(s.viewpoints(), s.elements()))


@query
def sector_features(s):
    return visibility.sector_features(s.viewpoints(), s.elements()).select("node_id", "type", "sector", r6("value").alias("value"))


@query
def edge_scores(s):
    edges = s.viewpoints().select(F.col("node_id").alias("src"), (F.col("node_id") + 10).alias("dst"))
    return scores.edge_scores(edges, _view_vectors(s)).select("src", "dst", r6("score").alias("score"))


@query
def sampled_features(s):
    return visibility.sampled_features(s.viewpoints(), s.elements()).select("node_id", "type", "sector", r6("value").alias("value"))


def _hedges(s: Scene) -> DataFrame:
    """Elements of which every second is a polyline of its first three corners."""
    line = F.array(F.slice(F.element_at("rings", 1), 1, 3))
    odd = F.col("elem_ord") % 2 == 1
    return s.elements().withColumn("rings", F.when(odd, line).otherwise(F.col("rings"))).withColumn("gtype", F.when(odd, "Polyline").otherwise(F.col("gtype")))


@query
def opacity_features(s):
    return visibility.opacity_features(s.viewpoints(), _hedges(s)).select("node_id", "type", "sector", r6("value").alias("value"))


def _round_elements(s: Scene) -> DataFrame:
    """The circles as plants."""
    c = s.circles().select(F.lit("g").alias("garden_id"), F.col("id").alias("elem_ord"), "id", F.lit("plant").alias("type"), F.lit("Circle").alias("gtype"), F.lit(None).cast(S.RINGS).alias("rings"), F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
    return c.withColumns({"transparent": F.lit(0.4), "weight": F.lit(0.65)})


@query
def circle_features(s):
    """What viewpoints see of circles, each a polygon of 128 vertices."""
    return visibility.sector_features(s.viewpoints(), _round_elements(s)).select("node_id", "type", "sector", r6("value").alias("value"))


@query
def points_in_circles(s):
    return visibility.points_in_elements(s.viewpoints(), _round_elements(s)).select("node_id", "elem_ord")


@query
def flat_features(s):
    """The vectors as long features and flat again, the types in alphabetical order."""
    long = s.feat().select("node_id", F.posexplode("v").alias("k", "value")).select("node_id", F.element_at(F.array(*map(F.lit, S.SECTOR_TYPES)), F.floor(F.col("k") / 16).cast("int") + 1).alias("type"), (F.col("k") % 16).alias("sector"), "value")
    return visibility.flattened(long).select("node_id", F.posexplode("v").alias("k", "value")).select("node_id", "k", r6("value").alias("value"))


@query
def points_in_elements(s):
    return visibility.points_in_elements(s.viewpoints(), s.elements()).select("node_id", "elem_ord", "type")


@query
def elem_edges(s):
    return visibility.elem_edges(s.elements()).select("elem_ord", "seq", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def edge_scores_embeddings(s):
    return scores.edge_scores(s.feat_edges(), s.feat()).select("src", "dst", r6("score").alias("score"))


@query
def hybrid_scores_l2(s):
    return scores.hybrid_scores(s.feat_edges(), s.feat()).select("src", "dst", r6("score").alias("score"))


@query
def hybrid_scores_beta(s):
    return scores.hybrid_scores(s.feat_edges(), s.feat(), metric="l1", beta=0.6).select("src", "dst", r6("score").alias("score"))


@query
def feature_totals(s):
    return scores.totals(s.feat()).select("node_id", r6("total").alias("total"))


@query
def pattern_normalize(s):
    return s.feat().select("node_id", F.posexplode(E.normalized("v")).alias("k", "p")).select("node_id", "k", r6("p").alias("p"))


@query
def quantile_clip(s):
    return scores.clipped(scores.totals(s.feat())).select("node_id", r6("magnitude").alias("magnitude"))


@query
def decay_table(s):
    d = s.table("lineitem").select(F.col("l_quantity").cast("double").alias("d")).distinct()
    return d.select("d", r6(E.exponential_decay("d", 30.0)).alias("exponential"), r6(E.linear_decay("d", 30.0)).alias("linear"), r6(E.plain_decay("d")).alias("plain"), r6(E.range_decay("d")).alias("of_range"))


@query
def direction_labels(s):
    n = s.table("nation").select(F.col("n_nationkey").alias("k"))
    return n.select("k", *[E.direction_label(F.col("k") % m, m).alias(f"of_{m}") for m in (8, 12, 16)])


def _gardens(s: Scene) -> DataFrame:
    return s.elements().withColumn("garden_id", F.concat(F.lit("g"), F.col("elem_ord") % 8))


@query
def structural_features(s):
    out = scores.structural_features(_gardens(s))
    return out.select("garden_id", *[(F.col(c) if c.endswith("_count") else r6(c)).alias(c) for c in out.columns if c != "garden_id"])


@query
def pair_distances(s):
    return scores.pair_distances(scores.centres(_gardens(s))).select("garden_id", "type_a", "type_b", r6("mean_dist").alias("mean_dist"), r6("std_dist").alias("std_dist"))


@query
def nearest_neighbor(s):
    return scores.nearest_distance(scores.centres(_gardens(s)), "garden_id", "type").select("garden_id", "type", "elem_ord", r6("nn").alias("nn"))


@query
def element_centres(s):
    return scores.centres(s.elements()).select("elem_ord", *[r6(c).alias(c) for c in ("area", "x", "y")])


@query
def garden_score(s):
    b = s.feat().select(F.concat(F.lit("g"), F.col("node_id") % 4).alias("garden_id"), F.col("node_id").alias("block_id"), F.col("v").alias("features"), F.element_at(F.array(*map(F.lit, ("open", "enclosed", "boundary"))), (F.col("node_id") * 7 % 11 % 3 + 1).cast("int")).alias("label"))
    return scores.garden_score(b).select("garden_id", *[r6(c).alias(c) for c in ("feature_richness", "openness_entropy", "score")])


# routes


def _link_scores(s: Scene) -> DataFrame:
    return s.links().select("src", "dst", ((F.col("src") * 31 + F.col("dst") * 17) % 100 / 10.0).alias("score"))


def _part_vectors(s: Scene) -> DataFrame:
    n = s.nodes().select("node_id", (F.col("node_id") % 500).alias("k"))
    return n.join(s.feat().select(F.col("node_id").alias("k"), "v"), "k").select("node_id", "v")


@query
def route_edges(s):
    return scores.route_edges(s.paths()).select("path_id", "pos", "src", "dst")


@query
def route_edge_set(s):
    return scores.route_edges(s.paths()).filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


@query
def route_fun_score(s):
    return scores.route_fun(s.paths(), _link_scores(s), s.links(), _part_vectors(s)).select("path_id", *[r6(c).alias(c) for c in ("edge_mean", "edge_std", "node_div", "fun_score")])


@query
def route_fitness(s):
    """The fitness of every route, all its parts."""
    clusters = s.nodes().select("node_id", (F.col("node_id") % 25).alias("cluster_id"))
    of = s.spark.range(25).select(F.col("id").alias("cluster_id"), (F.col("id") * 13 % 17 / 10).alias("score"))
    near = s.nodes().select("node_id", (F.col("x") / 20).alias("x"), (F.col("y") / 20).alias("y"))
    out = scores.fitness(s.paths(), near, _link_scores(s), s.links(), _part_vectors(s), clusters, of, alpha=4, beta=0.05, gamma=6.5, delta=0.03)
    return out.select("path_id", r6("fitness").alias("fitness"))


def _folded(s: Scene) -> DataFrame:
    """Routes over 40 nodes, so that nodes and edges repeat."""
    return s.paths().withColumn("node_id", F.col("node_id") % 40)


@query
def route_edge_repeats(s):
    return scores.edge_repeats(_folded(s)).select("path_id", r6("penalty").alias("penalty"))


@query
def route_node_repeats(s):
    return scores.node_repeats(_folded(s)).select("path_id", r6("penalty").alias("penalty"))


@query
def route_loop_penalty(s):
    near = s.nodes().select("node_id", (F.col("x") / 20).alias("x"), (F.col("y") / 20).alias("y"))
    return scores.loop_penalty(s.paths(), near).select("path_id", r6("penalty").alias("penalty"))


@query
def route_coverage(s):
    return scores.coverage(s.paths(), s.nodes()).select("path_id", r6("coverage").alias("coverage"))


@query
def missing_clusters(s):
    clusters = s.nodes().select("node_id", (F.col("node_id") % 25).alias("cluster_id"))
    of = s.spark.range(25).select(F.col("id").alias("cluster_id"), (F.col("id") * 13 % 17 / 10).alias("score"))
    return scores.missing_clusters(s.paths(), clusters, of).select("path_id", r6("penalty").alias("penalty"))


def _route_sets(s: Scene) -> DataFrame:
    return s.paths().groupBy("path_id").agg(F.collect_set("node_id").alias("nodes"))


@query
def jaccard_pairs(s):
    a = _route_sets(s)
    b = a.select((F.col("path_id") - 1).alias("path_id"), F.col("nodes").alias("others"))
    return a.join(b, "path_id").select("path_id", r6(E.jaccard("nodes", "others")).alias("jaccard"))


@query
def min_overlap_pair(s):
    o = s.table("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("path_id")).join(_route_sets(s), "path_id")
    a, b = (o.select("owner", F.col("path_id").alias(x), F.col("nodes").alias(f"n{x}")) for x in ("a", "b"))
    pairs = a.join(b, "owner").filter("a < b").select("owner", "a", "b", F.size(F.array_intersect("na", "nb")).alias("shared"), E.jaccard("na", "nb").alias("jaccard"))
    best = pairs.groupBy("owner").agg(F.min(F.struct("shared", r6("jaccard").alias("jaccard"), "a", "b")).alias("m"))
    return best.select("owner", "m.a", "m.b", "m.shared", "m.jaccard")


# clusters


def _lines(s: Scene) -> DataFrame:
    p = lambda dx: F.struct((F.col("x") + dx).alias("x"), F.col("y").alias("y"))
    return s.elements().select(F.col("elem_ord").alias("id"), F.array(p(F.lit(0.0)), p(F.col("h"))).alias("points"))


@query
def cluster_linkage(s):
    return cluster.link_paths(_lines(s), 8.0)


@query
def cluster_circles(s):
    return cluster.link_circles(s.circles(), 12.0)


@query
def cluster_hierarchical(s):
    return cluster.single_linkage(s.circles(), 12.0)


@query
def cluster_density(s):
    return cluster.density(s.circles(), 14.0)


@query
def cluster_density_core(s):
    return cluster.density(s.circles(), 30.0, 5)


@query
def cluster_nodes(s):
    return cluster.node_clusters(s.nodes().select("node_id", "x", "y"), 12.0)


@query
def cluster_optics(s):
    lines = _lines(s).withColumn("garden_id", F.concat(F.lit("g"), F.col("id") % 8))
    return cluster.cluster_boundaries(lines, 40.0)


@query
def circle_overlap(s):
    a = s.circles()
    b = a.select((F.col("id") - 2).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("radius").alias("r2"))
    return a.join(b, "id").select("id", r6(E.circle_overlap("x", "y", F.col("radius") * 100, "x2", "y2", F.col("r2") * 100)).alias("overlap"))


# geometry


@query
def contained_elements(s):
    return polygons.contained(s.elements(True), s.elements(True))


@query
def water_nesting(s):
    pools = s.elements(True).filter("type <> 'rock'")
    inside = polygons.contained(pools, pools)
    return inside.groupBy("inner_ord").agg(F.min("outer_ord").alias("first_outer"), F.count(F.lit(1)).alias("n_outer"))


@query
def rocks_with_buildings(s):
    e = s.elements(True)
    held = polygons.contained(e.filter("type = 'building'"), e.filter("type <> 'building'")).select(F.col("outer_ord").alias("elem_ord")).distinct()
    return e.filter("type <> 'building'").select("elem_ord").join(held.withColumn("t", F.lit(1.0)), "elem_ord", "left").select("elem_ord", F.coalesce("t", F.lit(0.0)).alias("transparent"))


@query
def bounds(s):
    return polygons.bounds(_gardens(s)).select("garden_id", *[r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query
def grid_centers(s):
    return polygons.grid_centres(polygons.bounds(_gardens(s))).select("garden_id", "i", "j", r6("x").alias("x"), r6("y").alias("y"))


@query
def block_grid(s):
    return openness.block_grid(polygons.bounds(_gardens(s)), 15.0).select("garden_id", "block_id", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query
def block_visibility(s):
    blocks = openness.block_grid(polygons.bounds(s.elements()), 15.0)
    return polygons.visible_part(blocks, s.elements()).select("block_id", r6("visibility").alias("visibility"))


#: A boundary with a corner that points inwards: its vertices, and the two boxes that make it up.
PARK = [(0, 0), (600, 0), (600, 400), (300, 400), (300, 900), (0, 900), (0, 0)]
PARK_BOXES = [(0, 0, 300, 900), (300, 0, 600, 400)]


def _park_boundary(s: Scene) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in PARK])
    return s.spark.range(1).select(F.lit("g").alias("garden_id"), F.lit(-1).cast("bigint").alias("elem_ord"), F.lit("Polygon").alias("gtype"), F.array(ring).alias("rings"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")])


@query
def block_visibility_clipped(s):
    """Like block_visibility, inside a boundary that isn't convex."""
    blocks = openness.block_grid(polygons.bounds(s.elements()), 15.0)
    return polygons.visible_part(blocks, s.elements(), _park_boundary(s)).select("block_id", r6("visibility").alias("visibility"))


@query
def openness_features(s):
    """The 39 features of each block of the park, before clustering."""
    made = openness.features(s.elements().drop("x", "y", "h"), _park_boundary(s), max_distance=100.0)
    return made.select("block_id", F.posexplode("features").alias("k", "value")).select("block_id", "k", r6("value").alias("value"))


@query
def openness_ranks(s):
    """Labels of clusters by their visibility: four clusters a garden from the vectors."""
    c = s.feat().select(F.floor(F.col("node_id") / 4).cast("string").alias("garden_id"), (F.col("node_id") % 4).cast("int").alias("cluster"), E.array_sum("v").alias("visibility"))
    return openness.rank_labels(c, 4).select("garden_id", "cluster", "label")


@query
def adaptive_k(s):
    return s.table("part").select("p_partkey", E.adaptive_k(F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") / 8)).alias("k"))


@query
def shoelace_open(s):
    ring = F.slice(F.element_at("rings", 1), 1, 4)
    return s.elements().select("elem_ord", r6(E.shoelace(ring)).alias("open_area"), r6(E.shoelace(ring, True)).alias("true_area"))


@query
def circumradius(s):
    ring = F.element_at("rings", 1)
    p = lambda k: (ring[k]["x"] / (k + 1), ring[k]["y"])
    return s.elements().select("elem_ord", F.round(F.least(F.lit(1e4), E.circumradius(*p(0), *p(1), *p(2))), 2).alias("radius"))


@query
def convex_hulls(s):
    """The sides of each garden's hull, counter-clockwise."""
    ring = polygons.convex_hulls(_gardens(s), "garden_id").groupBy("garden_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("r"))
    side = F.zip_with("r", F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)), lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("to_x"), q["y"].alias("to_y")))
    return ring.select("garden_id", F.inline(side))


@query
def rock_shapes(s):
    """Alpha shapes of the clusters of rock lines."""
    e = s.elements().filter("type = 'rock'")
    p = lambda dx, dy: F.struct((F.col("x") + dx * F.col("h")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
    lines = e.select("garden_id", F.col("elem_ord").alias("entity_ord"), F.lit("rockery").alias("category"), F.array(p(-1, -1), p(1, 0), p(0, 1), p(1, 1)).alias("points"))
    made = elements.rock(lines, s.elements().filter("type = 'building'"))
    return made.select("id", "transparent", "cluster_id", F.size(F.element_at("rings", 1)).alias("n"), r6(E.shoelace(F.element_at("rings", 1))).alias("area"))


@query
def wall_polygons(s):
    p = lambda dx, dy: F.struct((F.col("x") + dx * F.col("h")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
    walls = s.elements().filter("type = 'building'").select("garden_id", F.col("elem_ord").alias("entity_ord"), F.when(F.col("elem_ord") % 2 == 0, "solid wall").otherwise("hollow wall").alias("category"), (F.col("elem_ord") % 2 == 1).alias("visibility"), F.array(p(-1, -1), p(1, -1), p(1, 1)).alias("points"))
    made = elements.building(walls)
    return made.select("id", "transparent", r6(E.shoelace(F.element_at("rings", 1), True)).alias("area"))


# graph


@query
def nearest_node(s):
    points = s.table("nation").select(F.col("n_nationkey").alias("point_id"), (F.col("n_nationkey") * 31 % 97 * 10 + 0.37).alias("px"), (F.col("n_nationkey") * 57 % 89 * 10 + 0.11).alias("py"))
    return graph.nearest_node(s.nodes(), points)


@query
def triangles(s):
    return graph.triangles(graph.undirected(s.links()))


@query
def longest_sides(s):
    return graph.longest_sides(graph.undirected(s.links()))


@query
def simplify_graph(s):
    return graph.simplify(s.links())


@query
def shortest_paths(s):
    links = graph.undirected(s.links())
    start = links.agg(F.min("u")).collect()[0][0]
    return graph.shortest_paths(links, start).select("node_id", r6("dist").alias("dist"))


@query
def critical_edges(s):
    e = _link_scores(s)
    limit = e.agg(F.percentile("score", F.lit(0.9)).alias("q"))
    return e.crossJoin(F.broadcast(limit)).filter("score >= q").select("src", "dst", r6("score").alias("score"))


@query
def bridge_edges(s):
    return graph.bridges(s.sparse_links())


@query
def random_walks(s):
    """Ten steps from every node of the graph."""
    links = graph.undirected(s.links())
    start = links.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().select(F.col("node_id").alias("walker"), "node_id")
    return graph.random_walks(links, start, 10, seed=3)


@query
def fresh_walks(s):
    """Eight steps from every node of the sparse graph, to nodes that the walk hasn't met where there are any."""
    links = s.sparse_links()
    start = links.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().select(F.col("node_id").alias("walker"), "node_id")
    return graph.random_walks(links, start, 8, seed=5, fresh=True)


@query
def snap_points(s):
    placed = s.elements().select(F.col("elem_ord").alias("point_ord"), (F.col("x") + 0.3).alias("x"), F.col("y"))
    return graph.snap_points(placed, 8.0).select("point_ord", "node_id", r6("x").alias("x"), r6("y").alias("y"))


def _park(s: Scene) -> routes.Park:
    keep = s.nodes().filter("node_id < 150")
    near = cluster.near_pairs(keep.select(F.col("node_id").alias("id"), "x", "y"), 160.0).select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = near.join(keep.select(F.col("node_id").alias("u"), F.col("x").alias("xa"), F.col("y").alias("ya")), "u").join(keep.select(F.col("node_id").alias("v"), "x", "y"), "v").select("u", "v", E.distance("xa", "ya", "x", "y").alias("length"))
    of = links.select(F.col("u").alias("src"), F.col("v").alias("dst"), ((F.col("u") * 31 + F.col("v") * 17) % 100 / 10.0).alias("score"))
    clusters = cluster.node_clusters(keep.select("node_id", "x", "y"), 60.0)
    return routes.park_of(keep, links, of, _part_vectors(s), clusters)


@query
def genetic_route(s):
    """One garden of 150 footpath nodes (its size is part of the query), the closed route from its first node."""
    park = _park(s)
    start = min(park.graph)
    path, _ = routes.search(s.spark, park, start, start, population=16, generations=4, weights=routes.Weights(4, 3, 6.5, 0.03))
    return routes.route_table(s.spark, park, path)


@query
def candidate_paths(s):
    park = _park(s)
    start, end = min(park.graph), max(park.graph)
    found = graph.candidate_paths(park.graph, park.scores, start, end, k_paths=5)
    return s.spark.createDataFrame([(k, p) for k, p in enumerate(found)], "path_id long, nodes array<long>")


# drawings and openness


@query
def entity_profile(s):
    return drawings.profile(s.entities())


def _point(p: Column, name: str) -> list[Column]:
    return [r6(p["x"]).alias(f"{name}_x"), r6(p["y"]).alias(f"{name}_y")]


@query
def drawing_entities(s):
    """The plan written as drawings, read, ordered and classified."""
    e = elements.classify(drawings.entities(drawings.read(s.spark, f"{s.drawn()}/*/*")))
    return e.select(
        F.regexp_replace("garden_id", "^file=", "").alias("file"), "entity_ord", "kind", "layer", "category", "visibility", "color_index", "true_color", "closed",
        F.coalesce(F.size("points"), F.lit(0)).cast("int").alias("n_points"), *_point(F.when(F.size("points") > 0, F.element_at("points", -1)), "last"), r6("cx").alias("cx"), r6("cy").alias("cy"), r6("radius").alias("radius"))


@query
def drawing_segments(s):
    e = drawings.entities(drawings.read(s.spark, f"{s.drawn()}/*/*"))
    return drawings.segments(e).select("entity_ord", "pos", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query
def drawing_profile(s):
    """Profiles of the drawings, among them one that isn't there."""
    at = s.drawn()
    parsed = drawings.read(s.spark, [f"{at}/*/*", f"{at}/lost/plan.dxf"]).filter("problem IS NULL")
    return drawings.profile(parsed.withColumn("file", F.regexp_replace(E.garden_name("file"), "^file=", "")))


@query
def path_graph(s):
    """The graph of the plan's lines and curves, all of them on the path layer."""
    at = store.place(s.spark, "drawings")
    drawings.write(s.plan().withColumn("layer", F.when(F.col("entity_no") % 2 == 0, "path").otherwise("Path")), at)
    nodes, edges = graph.graph_of_layer(drawings.entities(drawings.read(s.spark, f"{at}/*/*", samples=drawings.SAMPLES)), tolerance=0.0137)
    return edges.join(nodes.withColumnRenamed("node_id", "src"), "src").select("entity_ord", "pos", "src", "dst", r6("x").alias("x"), r6("y").alias("y"))


@query
def workbook_graph(s):
    """Nodes and edges written as a workbook and read again, moved by an offset."""
    node = s.nodes().select(F.col("node_id").alias("row_ord"), F.col("node_id").cast("string").alias("c0"), F.concat_ws(",", "x", "y").alias("c1"))
    way = F.when(F.col("v") % 2 == 0, F.concat_ws(";", F.concat_ws(",", F.col("u") / 2, F.col("v")), F.concat_ws(",", F.col("v"), F.col("u"))))
    edge = s.sparse_links().select((F.col("u") * 4 + F.col("v") % 4).alias("row_ord"), F.concat_ws(",", "u", "v").alias("c2"), (F.col("u") / 4 + 1).cast("string").alias("c3"), way.alias("c4"))
    cells = node.join(edge, "row_ord", "full").select(F.lit("graph").alias("file"), "row_ord", "c0", "c1", "c2", "c3", "c4")
    at = store.place(s.spark, "workbooks")
    workbooks.save_cells(cells, at)
    nodes, edges = workbooks.graph(workbooks.read_cells(s.spark, f"{at}/*.xlsx"), "g", (10.5, -3.25))
    first = F.when(F.col("waypoints").isNotNull(), F.col("waypoints")[0])
    none = F.lit(None).cast("bigint")
    return nodes.select(F.col("node_id").alias("a"), none.alias("b"), r6("x").alias("p"), r6("y").alias("q"), F.lit(None).cast("double").alias("length")).unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), r6(first["x"]).alias("p"), r6(first["y"]).alias("q"), r6("length").alias("length")))


@query
def saved_route(s):
    """Routes of each garden through all its nodes, saved as workbooks, read, and their edges."""
    route = s.nodes().select(F.concat(F.lit("g"), F.col("node_id") % 8).alias("file"), "node_id", "x", "y").withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("x", "y", "node_id")))
    at = store.place(s.spark, "routes")
    workbooks.save_cells(workbooks.route_cells(route), at)
    return workbooks.route_links(workbooks.route_of_cells(workbooks.read_cells(s.spark, f"{at}/*.xlsx", 3)))


@query
def saved_route_table(s):
    """A route through all nodes, saved as a table and read."""
    at = store.place(s.spark, "route")
    workbooks.save_route(s.nodes().select((F.col("node_id") + 1).alias("pos"), "node_id", "x", "y"), at)
    return s.spark.read.parquet(at).select("pos", "node_id", "x", "y")


def _shore(s: Scene) -> DataFrame:
    e = s.elements(True).filter("type <> 'rock'")
    return e.select("garden_id", F.col("elem_ord").alias("entity_ord"), F.lit("water").alias("category"), F.element_at("rings", 1).alias("points"))


@query
def water_elements(s):
    """Shore lines of the whole scene but its rocks as water: outer shapes with the number of their holes."""
    made = elements.water(_shore(s))
    first = F.element_at(F.element_at("rings", 1), 1)
    return made.select("id", (F.size("rings") - 1).cast("int").alias("n_holes"), "transparent", "weight", r6(first["x"]).alias("x"), r6(first["y"]).alias("y"), r6(E.shoelace(F.element_at("rings", 1))).alias("area"))


@query
def plant_elements(s):
    c = s.circles().select(F.lit("g").alias("garden_id"), F.col("id").alias("entity_ord"), F.when(F.col("id") % 3 == 0, "water").otherwise("vegetation").alias("category"), F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
    return elements.plant(c).select("id", "type", "gtype", "cx", "cy", "radius", "transparent", "weight")


@query
def layer_classify(s):
    names = F.array(*map(F.lit, [*S.LAYER_CATEGORY, "ARCHI", "0"]))
    e = s.table("events").select("event_id", F.element_at(names, (F.col("event_id") % F.size(names) + 1).cast("int")).alias("layer"))
    return elements.classify(e)


@query
def boundary_first(s):
    """The first closed polyline of each drawing."""
    found = drawings.boundary(drawings.read(s.spark, f"{s.drawn()}/*/*"), required=True)
    return found.select(F.regexp_replace(E.garden_name("file"), "^file=", "").alias("file"), F.size("points").alias("n"), *_point(F.col("points")[0], "first"), *_point(F.element_at("points", -1), "last"))


@query
def garden_names(s):
    p = s.table("part").select("p_partkey", F.concat(F.lit("data/"), F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_partkey") % 12).cast("string"), F.lit(". "))).otherwise(""), F.col("p_type"), F.lit("/plan.dxf")).alias("path"))
    return p.select("p_partkey", E.garden_name("path").alias("name"))


@query
def openness_labels(s):
    """Blocks of the scene with k-means clusters and labels."""
    box = polygons.bounds(s.elements())
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))])
    boundary = box.select("garden_id", F.lit(-1).cast("bigint").alias("elem_ord"), F.lit("Polygon").alias("gtype"), F.array(ring).alias("rings"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")])
    out = openness.analyze(s.elements().drop("x", "y", "h"), boundary, 2.3, max_distance=200.0)
    return out.select("block_id", "cluster", "label", r6(F.element_at("features", -1)).alias("visibility"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["edge_scores"](spark, sf_dir)
