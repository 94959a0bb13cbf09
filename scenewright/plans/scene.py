"""Scenes derived from the star-schema tables by integer arithmetic, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright import schema as S
from scenewright.functions import store
from scenewright.sources import drawings

class Scene:
    """Named inputs of the queries, each read lazily from one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def feat(self) -> DataFrame:
        """node_id, v: 64 numbers, four types of 16 sectors."""
        return self.table("embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))

    def feat_edges(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))

    def elements(self, grown: bool = False) -> DataFrame:
        """Squares and diamonds; grown: every fifth is nine times as large, so that some hold others."""
        key = F.col("p_partkey")
        type_ = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "building").when(F.col("p_type") == "PROMO", "rock").when(F.col("p_type") == "MEDIUM", "water").otherwise("plant")
        p = self.table("part").select(
            F.lit("g").alias("garden_id"), key.alias("elem_ord"), key.alias("id"), type_.alias("type"), F.lit("Polygon").alias("gtype"),
            (key * 37 % 997).cast("double").alias("x"), (key * 53 % 991).cast("double").alias("y"), ((1 + F.col("p_size") / 10) * F.when((key % 5 == 0) & F.lit(grown), 9).otherwise(1)).alias("h"), (key % 2 == 0).alias("square"),
            F.when(type_ == "building", F.when(key % 3 == 0, 0.6).otherwise(0.0)).when(type_ == "rock", 0.0).when(type_ == "plant", 0.4).otherwise(1.0).alias("transparent"),
            F.when(type_ == "building", 2.0).when(type_ == "plant", 0.65).otherwise(1.5).alias("weight"),
        )
        at = lambda dx, dy: F.struct((F.col("x") + dx * F.col("h")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
        square = F.array(*[at(dx, dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
        diamond = F.array(*[at(dx, dy) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1), (-1, 0))])
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cx", "double"), ("cy", "double"), ("radius", "double"), ("name", "string"), ("cluster_id", "bigint"))]
        return p.select("garden_id", "elem_ord", "id", "type", "gtype", F.array(F.when(F.col("square"), square).otherwise(diamond)).alias("rings"), "transparent", "weight", *none, "x", "y", "h")

    def viewpoints(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(c.alias("node_id"), (c * 71 % 997 + 0.137).alias("x"), (c * 89 % 991 + 0.291).alias("y"))

    def circles(self) -> DataFrame:
        """id, x, y, radius."""
        keys = self.table("supplier").select((F.col("s_suppkey") * 2).alias("id")).unionByName(self.table("customer").select((F.col("c_custkey") * 2 + 1).alias("id")))
        return keys.select("id", (F.col("id") * 7919 % 997).cast("double").alias("x"), (F.col("id") * 104729 % 991).cast("double").alias("y"), (1 + F.col("id") % 7 * 0.5).alias("radius"))

    def paths(self) -> DataFrame:
        """path_id, pos, node_id: the parts of an order, one after the other."""
        l = self.table("lineitem")  # noqa: E741
        order = ["l_linenumber", "l_partkey", "l_suppkey", *[c for c in l.columns if c not in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
        w = Window.partitionBy("l_orderkey").orderBy(*order)
        return l.select(F.col("l_orderkey").alias("path_id"), F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("node_id"))

    def nodes(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(F.lit("g").alias("garden_id"), key.alias("node_id"), key.alias("node_ord"), (key * 37 % 997).cast("double").alias("x"), (key * 53 % 991).cast("double").alias("y"))

    def hops(self) -> DataFrame:
        """path_id, pos, a, b of consecutive nodes."""
        w = Window.partitionBy("path_id").orderBy("pos")
        return self.paths().withColumn("b", F.lead("node_id").over(w)).filter("b IS NOT NULL").select("path_id", "pos", F.col("node_id").alias("a"), "b")

    def links(self) -> DataFrame:
        """garden_id, src < dst, edge_ord, length: the footpath graph."""
        e = self.hops().filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        at = self.nodes()
        e = e.join(at.select(F.col("node_id").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb")), "dst")
        return e.select(F.lit("g").alias("garden_id"), "src", "dst", (F.col("src") * 100000 + F.col("dst")).alias("edge_ord"), F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2).alias("length"))

    def plan(self) -> DataFrame:
        """Entities of eight drawings, of every kind and layer, as a drawing's rows."""
        key, x, y, h = F.col("elem_ord"), F.col("x"), F.col("y"), F.col("h")
        names = F.array(*map(F.lit, [*S.LAYER_CATEGORY, "ARCHI", "0"]))
        at = lambda *d: F.array(*[F.struct((x + h * dx).alias("x"), (y + h * dy).alias("y")) for dx, dy in d])
        kind = F.element_at(F.array(*map(F.lit, ("LINE", "LWPOLYLINE", "POLYLINE", "SPLINE", "CIRCLE"))), (key % 5 + 1).cast("int"))
        points = F.when(key % 5 == 0, at((0, 0), (1, 0))).when(key % 5 == 3, at((0, 0), (1, 1), (2, 0), (3, 1))).when(key % 5 != 4, at((0, 0), (1, 0), (1, 1)))
        circle = lambda v: F.when(key % 5 == 4, v)
        rows = self.elements().withColumn("kind", kind)
        closed = F.col("kind").isin("LWPOLYLINE", "POLYLINE", "SPLINE") & (F.floor(key / 5) % 2 == 0)
        return rows.select(
            F.concat(F.lit("plan"), key % 8).alias("file"), key.cast("int").alias("entity_no"), "kind", F.element_at(names, (key % F.size(names) + 1).cast("int")).alias("layer"),
            (key % 7).cast("int").alias("color_index"), F.when(key % 3 == 0, key % 4).cast("int").alias("true_color"), closed.alias("closed"),
            circle(x).alias("cx"), circle(y).alias("cy"), circle(h).alias("radius"), points.alias("points"))

    def drawn(self) -> str:
        """The address of the plan as drawings; written for each use."""
        at = store.place(self.spark, "drawings")
        drawings.write(self.plan(), at)
        return at

    def sparse_links(self) -> DataFrame:
        """u < v: a chain of the vectors, with chords to the first of every four."""
        n = F.col("vec_id")
        chain = self.table("embeddings").filter("vec_id > 0").select((n - 1).alias("u"), n.alias("v"))
        chords = self.table("embeddings").select((n - n % 4).alias("u"), n.alias("v")).filter("u <> v")
        return chain.unionByName(chords).distinct()

    def entities(self) -> DataFrame:
        """file, kind, layer, color_index, true_color, closed from the events."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(F.col("user_id").alias("file"), F.col("event_type").alias("kind"), F.concat(F.lit("layer"), k % 10).alias("layer"), (k % 16).cast("int").alias("color_index"), F.when(k % 3 == 0, k % 5).cast("int").alias("true_color"), (k % 4 == 0).alias("closed"))


#: The same inputs as SQL, for the oracles.
SQL = {
    "feat": "SELECT vec_id AS node_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings",
    "feat_edges": "SELECT vec_id AS src, vec_id + 1 AS dst FROM embeddings",
    "elements": """
        SELECT p_partkey AS elem_ord, CAST(p_partkey * 37 % 997 AS DOUBLE) AS x, CAST(p_partkey * 53 % 991 AS DOUBLE) AS y, 1 + p_size / 10e0 AS h, p_partkey % 2 = 0 AS square,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'building' WHEN p_type = 'PROMO' THEN 'rock' WHEN p_type = 'MEDIUM' THEN 'water' ELSE 'plant' END AS type,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN CASE WHEN p_partkey % 3 = 0 THEN 0.6e0 ELSE 0e0 END WHEN p_type = 'PROMO' THEN 0e0 WHEN p_type = 'MEDIUM' THEN 1e0 ELSE 0.4e0 END AS transparent,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 2e0 WHEN p_type IN ('PROMO', 'MEDIUM') THEN 1.5e0 ELSE 0.65e0 END AS weight
        FROM part""",
    "grown": "SELECT * REPLACE (h * CASE WHEN elem_ord % 5 = 0 THEN 9 ELSE 1 END AS h) FROM elements",
    "corners": """
        SELECT 0 AS i, -1 AS sx, -1 AS sy, -1 AS dx, 0 AS dy UNION ALL SELECT 1, 1, -1, 0, -1 UNION ALL SELECT 2, 1, 1, 1, 0 UNION ALL SELECT 3, -1, 1, 0, 1""",
    "vertices": """
        SELECT elem_ord, i, x + CASE WHEN square THEN sx ELSE dx END * h AS vx, y + CASE WHEN square THEN sy ELSE dy END * h AS vy FROM elements, corners""",
    "edges": """
        SELECT a.elem_ord, a.i, a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2 FROM vertices a JOIN vertices b ON a.elem_ord = b.elem_ord AND b.i = (a.i + 1) % 4""",
    "viewpoints": "SELECT c_custkey AS node_id, c_custkey * 71 % 997 + 0.137e0 AS vx, c_custkey * 89 % 991 + 0.291e0 AS vy FROM customer",
    "circles": """
        SELECT id, CAST(id * 7919 % 997 AS DOUBLE) AS x, CAST(id * 104729 % 991 AS DOUBLE) AS y, 1 + id % 7 * 0.5e0 AS radius
        FROM (SELECT s_suppkey * 2 AS id FROM supplier UNION ALL SELECT c_custkey * 2 + 1 FROM customer)""",
    "paths": """
        SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos, l_partkey AS node_id FROM lineitem""",
    "nodes": "SELECT p_partkey AS node_id, CAST(p_partkey * 37 % 997 AS DOUBLE) AS x, CAST(p_partkey * 53 % 991 AS DOUBLE) AS y FROM part",
    "hops": "SELECT * FROM (SELECT path_id, pos, node_id AS a, lead(node_id) OVER (PARTITION BY path_id ORDER BY pos) AS b FROM paths) WHERE b IS NOT NULL",
    "links": """
        SELECT src, dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS length
        FROM (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM hops WHERE a <> b) JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst""",
    "plan": """
        SELECT 'plan' || (elem_ord % 8) AS file, elem_ord, ['LINE', 'LWPOLYLINE', 'POLYLINE', 'SPLINE', 'CIRCLE'][elem_ord % 5 + 1] AS kind, elem_ord % 7 AS color_index, CASE WHEN elem_ord % 3 = 0 THEN elem_ord % 4 END AS true_color,
               elem_ord % 5 IN (1, 2, 3) AND elem_ord // 5 % 2 = 0 AS closed, [2, 3, 3, 4, 0][elem_ord % 5 + 1] AS n_points, x, y, h FROM elements""",
    "sparse": """
        SELECT vec_id - 1 AS u, vec_id AS v FROM embeddings WHERE vec_id > 0 UNION SELECT vec_id - vec_id % 4, vec_id FROM embeddings WHERE vec_id % 4 <> 0""",
    "entities": """
        SELECT user_id AS file, event_type AS kind, 'layer' || (k % 10) AS layer, k % 16 AS color_index, CASE WHEN k % 3 = 0 THEN k % 5 END AS true_color, k % 4 = 0 AS closed
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
}
_NEEDS = {"grown": ["elements"], "vertices": ["elements", "corners"], "edges": ["vertices"], "hops": ["paths"], "links": ["hops", "nodes"], "plan": ["elements"]}


def with_sql(body: str, *names: str) -> str:
    """The query after the definitions that it and they need; body may begin with further ones ("WITH ...")."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = body[len("WITH RECURSIVE") if recursive else 4 :] if body.upper().startswith("WITH") else None
    return f"WITH {'RECURSIVE ' * recursive}{head}, {rest}" if rest else f"WITH {head} {body}"
