"""Footpath graphs: nearest nodes, simplification, shortest and K shortest paths, random walks."""

from __future__ import annotations

import functools
import heapq
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenewright.functions import expressions as E
from scenewright.functions.store import drop, saved
from scenewright.operators.components import components

Adjacency = dict[int, dict[int, float]]


def nearest_node(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, node_id: the nearest node, the first in node_ord of equally near ones.  points: point_id, px, py.

    Rings of grid cells are searched outward, four times as far each time, for those points only whose nearest isn't proven."""
    target = saved(nodes.select("node_id", "node_ord", "x", "y"), "targets")
    open_ = saved(points.select("point_id", "px", "py"), "points")
    box = target.select("x", "y").unionByName(open_.select(F.col("px").alias("x"), F.col("py").alias("y"))).agg(*[getattr(F, f)(c).alias(f + c) for f in ("min", "max") for c in "xy"]).collect()[0]
    n = target.count()
    if not n:
        return open_.limit(0).select("point_id", F.lit(None).cast("bigint").alias("node_id"))
    extent = max(box.maxx - box.minx, box.maxy - box.miny)
    size, found = max(extent / max(n, 1) ** 0.5, 1e-9), None
    while True:
        last = size > extent
        cell = lambda v: F.floor(F.col(v) / size)
        around = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
        met = open_.withColumn("gx", around("px")).withColumn("gy", around("py")).join(target.withColumn("gx", cell("x")).withColumn("gy", cell("y")), ["gx", "gy"])
        best = saved(met.groupBy("point_id").agg(F.min(F.struct(E.distance("x", "y", "px", "py").alias("d"), "node_ord", "node_id")).alias("m")), "nearest")
        sure = (best if last else best.filter(F.col("m.d") <= size)).select("point_id", "m.node_id")
        found = sure if found is None else found.unionByName(sure)
        open_ = open_.join(sure, "point_id", "left_anti")
        if last or open_.isEmpty():
            return found
        size *= 4


def undirected(edges: DataFrame) -> DataFrame:
    """u < v, length: each edge once; of repeated ones the last edge_ord counts; loops go."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max_by("length", "edge_ord").alias("length"))


def triangles(links: DataFrame) -> DataFrame:
    """a < b < c with all three edges.  links: u < v."""
    ab = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    ac = links.select(F.col("u").alias("a"), F.col("v").alias("c"))
    bc = links.select(F.col("u").alias("b"), F.col("v").alias("c"))
    return ab.join(ac, "a").filter("b < c").join(bc, ["b", "c"], "left_semi").select("a", "b", "c")


def longest_sides(links: DataFrame) -> DataFrame:
    """a, b, c, u, v: the longest edge of each triangle, the first of (ab, bc, ac) among equals; no length is longest."""
    long = links.select("u", "v", F.coalesce("length", F.lit(float("inf"))).alias("d"))
    side = lambda p, q, name: long.select(F.col("u").alias(p), F.col("v").alias(q), F.col("d").alias(name))
    t = triangles(links).join(side("a", "b", "ab"), ["a", "b"]).join(side("b", "c", "bc"), ["b", "c"]).join(side("a", "c", "ac"), ["a", "c"])
    first = F.when((F.col("ab") >= F.col("bc")) & (F.col("ab") >= F.col("ac")), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).when(F.col("bc") >= F.col("ac"), F.struct(F.col("b").alias("u"), F.col("c").alias("v"))).otherwise(F.struct(F.col("a").alias("u"), F.col("c").alias("v")))
    return t.withColumn("e", first).select("a", "b", "c", "e.u", "e.v")


def reaches(adjacency: dict[int, set[int]], start: int, end: int, without: tuple[int, int] | None = None) -> bool:
    """Whether end is reached from start, not using the edge `without`; searched from both ends, the smaller front first."""
    if start == end:
        return True
    seen, fronts = ({start}, {end}), [[start], [end]]
    while fronts[0] and fronts[1]:
        k = int(len(fronts[0]) > len(fronts[1]))
        new = []
        for at in fronts[k]:
            for to in adjacency[at]:
                if to not in seen[k] and without not in ((at, to), (to, at)):
                    if to in seen[1 - k]:
                        return True
                    seen[k].add(to)
                    new.append(to)
        fronts[k] = new
    return False


def _by_component(edges: DataFrame) -> DataFrame:
    """Adds part, the connected component of an edge (garden_id, u, v) in its garden."""
    end = lambda x: F.struct(F.col("garden_id").alias("g"), F.col(x).alias("n"))
    label = components(edges.select(end("u").alias("a"), end("v").alias("b"))).select(F.col("node").alias("end"), F.col("component").alias("part"))
    label = label.unionByName(label.select(F.col("part").alias("end"), "part").distinct())
    return edges.withColumn("end", end("u")).join(label, "end").drop("end")


def simplify(edges: DataFrame) -> DataFrame:
    """garden_id, u, v, length: the graph without the longest edge of each triangle, unless that would part its ends.

    Triangles of the original graph are taken in the order of their nodes.  A longest edge is decided on at its first triangle:
    if its ends can't be parted then, it goes, and a bridge stays one.  So edges that are nowhere the longest stay, those within
    a component of these go, and of the rest, taken from the last triangle to the first, those stay that link what isn't linked
    yet: `forest`, which halves of the edges reduce before they meet."""
    links = edges.filter("src <> dst").groupBy("garden_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max_by("length", "edge_ord").alias("length"))
    links = saved(links, "links")
    of = ["garden_id", "u", "v"]
    first = saved(_first_triangles(links), "longest")
    steady = links.join(first.hint("merge"), of, "left_anti")
    node = lambda c: F.struct(F.col("garden_id").alias("g"), F.col(c).alias("n"))
    label = components(steady.select(node("u").alias("a"), node("v").alias("b"))).select(F.col("node.g").alias("garden_id"), F.col("node.n").alias("n"), F.col("component.n").alias("c"))
    open_ = first
    for end in "uv":
        open_ = open_.join(label.select("garden_id", F.col("n").alias(end), F.col("c").alias(f"c{end}")).hint("merge"), ["garden_id", end], "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    open_ = saved(open_.filter("cu <> cv"), "open")
    end = lambda c: F.struct(F.col("garden_id").alias("g"), F.col(c).alias("n"))
    part = components(open_.select(end("cu").alias("a"), end("cv").alias("b")))
    part = part.unionByName(part.select(F.col("component").alias("node"), "component").distinct())
    open_ = open_.withColumn("node", end("cu")).join(part.hint("merge"), "node").select(F.col("component").alias("part"), *of, "cu", "cv", F.struct("a", "b", "c").alias("t"))
    sizes = open_.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / OF_FOREST).cast("int").alias("parts"))
    dealt = open_.join(sizes, "part").withColumn("deal", F.pmod(F.xxhash64("u", "v"), F.col("parts")))
    schema = open_.schema
    some = dealt.select("deal", *open_.columns).groupBy("part", "deal").applyInArrow(lambda t: forest(t.drop_columns("deal")), schema)
    kept = some.groupBy("part").applyInArrow(forest, schema).select(*of)
    gone = first.join(kept.hint("merge"), of, "left_anti").select(*of)
    return links.join(gone.hint("merge"), of, "left_anti").select("garden_id", "u", "v", "length")


#: Edges of a component that `forest` takes at once.
OF_FOREST = 1 << 18


def _first_triangles(links: DataFrame) -> DataFrame:
    """garden_id, u, v, a, b, c: the edges that are the longest of a triangle (ab before bc before ac among equals, and one without
    a length before all), and the first such triangle.  links: garden_id, u, v, length, each edge once."""
    long = links.select("garden_id", "u", "v", F.nanvl(F.coalesce("length", F.lit(float("inf"))), F.lit(float("inf"))).alias("d"))
    side = lambda p, q, name: long.select("garden_id", F.col("u").alias(p), F.col("v").alias(q), F.col("d").alias(name))
    # pairs of edges meet the third one without their lengths
    t = side("a", "b", "ab").drop("ab").join(side("a", "c", "ac").drop("ac").hint("merge"), ["garden_id", "a"]).filter("b < c").join(side("b", "c", "bc").hint("merge"), ["garden_id", "b", "c"])
    t = t.join(side("a", "b", "ab").hint("merge"), ["garden_id", "a", "b"]).join(side("a", "c", "ac").hint("merge"), ["garden_id", "a", "c"])
    ends = lambda p, q: F.struct(F.col(p).alias("u"), F.col(q).alias("v"))
    e = F.when((F.col("ab") >= F.col("bc")) & (F.col("ab") >= F.col("ac")), ends("a", "b")).when(F.col("bc") >= F.col("ac"), ends("b", "c")).otherwise(ends("a", "c"))
    t = t.withColumn("e", e).groupBy("garden_id", "e.u", "e.v").agg(F.min(F.struct("a", "b", "c")).alias("t"))
    return t.select("garden_id", "u", "v", "t.a", "t.b", "t.c")


def forest(edges: pa.Table) -> pa.Table:
    """The edges (cu, cv) that link what those of later triangles t (a, b, c) haven't linked."""
    t = edges["t"].combine_chunks()
    t = t.chunk(0) if isinstance(t, pa.ChunkedArray) else t
    order = np.lexsort([t.field(c).to_numpy() for c in "cba"])[::-1]
    names, ends = np.unique(np.stack([edges["cu"].to_numpy(), edges["cv"].to_numpy()]), return_inverse=True)
    ends = ends.reshape(2, -1)[:, order].tolist()
    root, kept = list(range(len(names))), []
    for k, (p, q) in enumerate(zip(*ends, strict=True)):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[p] = q
            kept.append(k)
    return edges.take(pa.array(order[kept]))


def bridges(links: DataFrame) -> DataFrame:
    """u, v, bridge: whether an edge's ends are parted without it.  links: u < v, each once.

    A connected component is one task, in which one walk finds for each node the earliest node that a way around reaches."""

    def of_part(pdf: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for u, v in zip(pdf.u.tolist(), pdf.v.tolist(), strict=True):
            near[u].append(v)
            near[v].append(u)
        met, low, found = {}, {}, set()
        root = min(near)
        met[root] = low[root] = 0
        stack = [(root, None, iter(near[root]))]
        while stack:
            at, parent, rest = stack[-1]
            to = next(rest, None)
            if to is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[at])
                    if low[at] > met[parent]:
                        found.add((min(at, parent), max(at, parent)))
            elif to not in met:
                met[to] = low[to] = len(met)
                stack.append((to, at, iter(near[to])))
            elif to != parent:
                low[at] = min(low[at], met[to])
        return pd.DataFrame({"u": pdf.u, "v": pdf.v, "bridge": [(u, v) in found for u, v in zip(pdf.u.tolist(), pdf.v.tolist(), strict=True)]})

    one = links.select(F.lit("").alias("garden_id"), "u", "v")
    return _by_component(one).groupBy("part").applyInPandas(of_part, "u long, v long, bridge boolean")


def adjacency(rows) -> Adjacency:
    """From rows (u, v, length); both directions; a missing length is 1."""
    out: Adjacency = defaultdict(dict)
    for u, v, d in rows:
        d = 1.0 if d is None or d != d else float(d)
        out[int(u)][int(v)] = out[int(v)][int(u)] = d
    return out


def dijkstra(graph: Adjacency, start: int, end: int, weighted: bool = True, banned_nodes=frozenset(), banned_edges=frozenset()) -> list[int] | None:
    """The shortest path, by length or by the number of edges; of equally short ones the least in order of nodes.

    Distances to the end are settled outward from it; the path then takes the first neighbour that keeps to them."""
    left, settled, todo = {end: 0.0}, set(), [(0.0, end)]
    while todo and start not in settled:
        d, at = heapq.heappop(todo)
        if at in settled:
            continue
        settled.add(at)
        for before, w in graph.get(at, {}).items():
            new = (w if weighted else 1.0) + d
            if before not in banned_nodes and (before, at) not in banned_edges and new < left.get(before, float("inf")):
                left[before] = new
                heapq.heappush(todo, (new, before))
    if start not in settled:
        return None
    path = [start]
    while path[-1] != end:
        at = path[-1]
        path.append(min(to for to, w in graph[at].items() if to in settled and (at, to) not in banned_edges and (w if weighted else 1.0) + left[to] == left[at]))
    return path


def path_length(graph: Adjacency, path: list[int]) -> float:
    return sum(graph[a][b] for a, b in zip(path, path[1:], strict=False))


def k_shortest(graph: Adjacency, start: int, end: int, k: int) -> list[list[int]]:
    """The k shortest paths without repeated nodes (Yen), by length and then by their nodes."""
    first = dijkstra(graph, start, end)
    if first is None:
        return []
    found, waiting, known = [first], [], {tuple(first)}
    while len(found) < k:
        last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = {(p[i], p[i + 1]) for p in found if p[: i + 1] == root and len(p) > i + 1}
            spur = dijkstra(graph, last[i], end, banned_nodes=frozenset(root[:-1]), banned_edges=banned | {(b, a) for a, b in banned})
            if spur:
                path = root[:-1] + spur
                if tuple(path) not in known:
                    known.add(tuple(path))
                    heapq.heappush(waiting, (path_length(graph, path), path))
        if not waiting:
            break
        found.append(heapq.heappop(waiting)[1])
    return found


def shortest_paths(links: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """node_id, dist: the length of the shortest path from one node to every reachable one, by rounds of relaxation.

    Only nodes whose distance fell in a round are joined to the edges in the next, and only they are written.  links: u,
    v, length."""
    spark = links.sparkSession
    arcs = links.select(F.col("u").alias("a"), F.col("v").alias("b"), F.coalesce("length", F.lit(1.0)).alias("w"))
    arcs = saved(arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "arcs")
    front = spark.createDataFrame([(source, 0.0)], "node_id long, dist double")
    fallen = [front]
    for _ in range(max_rounds):
        best = functools.reduce(DataFrame.unionByName, fallen).groupBy("node_id").agg(F.min("dist").alias("dist"))
        offered = front.join(arcs, front.node_id == arcs.a).groupBy(F.col("b").alias("node_id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        front = saved(offered.join(best, "node_id", "left").filter("dist IS NULL OR offer < dist").select("node_id", F.col("offer").alias("dist")), "front")
        if front.isEmpty():
            return best
        fallen.append(front)
        if len(fallen) == 16:  # so that the plan doesn't grow with the rounds
            whole = saved(functools.reduce(DataFrame.unionByName, fallen).groupBy("node_id").agg(F.min("dist").alias("dist")), "best")
            drop(*fallen[1:-1])
            fallen = [whole]
    raise RuntimeError(f"distances still fall after {max_rounds} rounds")


def random_walks(links: DataFrame, walkers: DataFrame, steps: int, *, seed: int = 0, fresh: bool = False) -> DataFrame:
    """walker, pos, node_id: a walk of so many steps for each walker (walker, node_id), uniform over neighbours, or over those
    that it hasn't met where there are any (fresh); it ends early where there are none.  links: u, v, each once.

    A step takes the neighbour, in order, that a digest of seed, walker and step picks, so a lost task walks the same way."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = saved(both.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("near")), "near")
    now = walkers.select("walker", F.array("node_id").alias("path"))
    for step in range(steps):
        at = now.withColumn("u", F.element_at("path", -1)).join(near, "u", "left")
        unmet = F.array_except("near", "path")
        options = F.when(F.size(unmet) > 0, unmet).otherwise(F.col("near")) if fresh else F.col("near")
        pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("walker"), F.lit(step)).cast("binary")), 1, 8), 16, 10).cast("bigint")
        ended = F.col("near").isNull() | (F.size("path") < step + 1)
        now = at.withColumn("near", options).select("walker", F.when(ended, F.col("path")).otherwise(F.concat("path", F.array(F.element_at("near", (pick % F.size("near") + 1).cast("int"))))).alias("path"))
        if step % 4 == 3:
            now = saved(now, "walks")
    return now.select("walker", F.posexplode("path").alias("pos", "node_id"))


def random_walk(graph: Adjacency, start: int, steps: int, rng: random.Random) -> list[int]:
    """A walk of so many steps, uniform over neighbours; ends early where there are none."""
    path = [start]
    for _ in range(steps):
        options = sorted(graph.get(path[-1], ()))
        if not options:
            break
        path.append(rng.choice(options))
    return path


def candidate_paths(graph: Adjacency, scores: dict[tuple[int, int], float], start: int, end: int, percentile: float = 0.9, k_paths: int = 10, max_length: int | None = None, seed: int = 0) -> list[list[int]]:
    """Paths from start to end: K shortest ones between the ends of high-scored edges and random walks, those kept that run
    from start to end; else the shortest path; nothing where there are no scores."""
    if not scores:
        return []
    ranked = sorted(scores.values())
    at = percentile * (len(ranked) - 1)
    low = ranked[int(at)] + (ranked[min(int(at) + 1, len(ranked) - 1)] - ranked[int(at)]) * (at - int(at))
    ends = {n for e, s in scores.items() if s >= low for n in e} | {start, end}
    found = [p for p in k_shortest(graph, start, end, k_paths) if max_length is None or len(p) <= max_length] if {start, end} <= ends and start != end else []
    rng = random.Random(seed)
    walks = (random_walk(graph, start, rng.randint(5, 15), rng) for _ in range(k_paths))
    found += [w for w in walks if w[-1] == end]
    if not found:
        only = dijkstra(graph, start, end)
        found = [only] if only else []
    return found


def snap_points(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """point_ord, node_id, x, y: points on the tolerance's grid; equal ones are one node, numbered as they come first.

    points: point_ord, x, y."""
    snapped = points.select("point_ord", (F.bround(F.col("x") / tolerance) * tolerance).alias("x"), (F.bround(F.col("y") / tolerance) * tolerance).alias("y"))
    first = snapped.groupBy("x", "y").agg(F.min("point_ord").alias("first"))
    return snapped.join(numbered(first, "first", "node_id"), ["x", "y"]).select("point_ord", "node_id", "x", "y")


def numbered(df: DataFrame, by: str | list[str], name: str, within: str | None = None) -> DataFrame:
    """`df` with `name` counting from 0 in the order of the distinct values of `by`, without one task for all rows; within: from
    0 for each value of this column, the first of `by`.

    Rows are range-partitioned and sorted; each partition counts on from the sum of those before it."""
    by = [by] if isinstance(by, str) else by
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}  # one number for each partition
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    number = inner.cast("long") + (base[F.col("__part")] if base is not None else F.lit(0))
    out = ranged.withColumn(name, number.cast("long")).drop("__part")
    if within is None:
        return out
    first = out.groupBy(within).agg(F.min(name).alias("__first"))
    return out.join(first, within).withColumn(name, F.col(name) - F.col("__first")).select(*out.columns)


def graph_of_layer(entities: DataFrame, layer: str = "path", tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a drawing's layer, its name in any case: each segment is an edge, closed lines are closed.

    Repeated edges and loops stay."""
    paths = entities.filter((F.lower("layer") == layer.lower()) & (F.size("points") >= 2))
    line = F.when(F.coalesce("closed", F.lit(False)), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    placed = paths.select("entity_ord", F.posexplode(line).alias("pos", "p")).select(F.struct("entity_ord", "pos").alias("point_ord"), "entity_ord", "pos", "p.x", "p.y")
    nodes = snap_points(placed.select("point_ord", "x", "y"), tolerance)
    a = nodes.select("point_ord.entity_ord", "point_ord.pos", F.col("node_id").alias("src"))
    b = nodes.select("point_ord.entity_ord", (F.col("point_ord.pos") - 1).alias("pos"), F.col("node_id").alias("dst"))
    edges = a.join(b, ["entity_ord", "pos"]).select("entity_ord", "pos", "src", "dst")
    return nodes.select("node_id", "x", "y").distinct(), edges
