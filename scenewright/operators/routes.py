"""Walking routes: initial routes, fitness, and a seeded genetic search.

A generation is a table of routes.  Fitness is computed for the whole generation at once, in parallel over its routes;
the graph, edge scores and cluster scores of one garden are broadcast behind a check of their size (a park's footpaths;
larger graphs are refused, not cut).  Selection, crossover and mutation draw from generators seeded by generation and
place, so a lost task gives the same routes again.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import schema as S
from scenewright.operators.graph import Adjacency, dijkstra

#: Nodes and edges of a graph that is broadcast.
MOST_NODES = 200_000


@dataclass
class Park:
    """What a route's fitness needs to know of one garden."""

    graph: Adjacency
    xy: dict[int, tuple[float, float]]
    scores: dict[tuple[int, int], float]
    types: dict[int, tuple[float, float, float, float]]
    cluster: dict[int, int] = field(default_factory=dict)
    cluster_score: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.xy) > MOST_NODES:
            raise ValueError(f"a graph of {len(self.xy)} nodes is too large to broadcast")

    def score(self, a: int, b: int) -> float:
        return self.scores.get((a, b), self.scores.get((b, a), 0.0))

    def fun(self, path: list[int]) -> float:
        """How much and how evenly the view changes along a path, and how varied it is: 0.5 to 1."""
        hops = list(zip(path, path[1:], strict=False))
        if not hops:
            return math.nan
        values = [self.score(a, b) for a, b in hops]
        weights = [1 / (self.graph.get(a, {}).get(b, 1.0) + 1e-6) for a, b in hops]
        total = sum(weights)
        mean = sum(v * w for v, w in zip(values, weights, strict=True)) / total
        spread = math.sqrt(sum(w * (v - mean) ** 2 for v, w in zip(values, weights, strict=True)) / total)
        seen = [sum(self.types.get(n, (0.0,) * 4)[k] for n in path) for k in range(4)]
        parts = [x / (sum(seen) + 1e-8) for x in seen]
        varied = -sum(p * math.log(p + 1e-8) for p in parts)
        return (math.tanh((0.7 * mean + 0.15 * spread + 0.15 * varied) / 80) + 1) / 2


def score_clusters(spark: SparkSession, park: Park) -> None:
    """Each cluster's score: the mean fun of the shortest paths between its nodes, 0 for a single node; in parallel over the
    nodes that paths begin at."""
    members: dict[int, list[int]] = {}
    for n, c in park.cluster.items():
        members.setdefault(c, []).append(n)
    for nodes in members.values():
        nodes.sort()
    shipped = spark.sparkContext.broadcast((park, members))

    def run(batches):
        p, of = shipped.value
        for pdf in batches:
            funs = [[p.fun(path) for b in of[c][i + 1 :] if (path := dijkstra(p.graph, of[c][i], b)) and len(path) > 1] for c, i in zip(pdf.c, pdf.i, strict=True)]
            yield pd.DataFrame({"c": pdf.c, "s": [float(sum(f)) for f in funs], "n": [len(f) for f in funs]})

    tasks = spark.createDataFrame([(c, i) for c, nodes in members.items() for i in range(len(nodes))], "c long, i int")
    summed = tasks.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "c long, s double, n long").groupBy("c").agg({"s": "sum", "n": "sum"})
    park.cluster_score |= {r.c: r["sum(s)"] / r["sum(n)"] if r["sum(n)"] else 0.0 for r in summed.collect()}  # as many rows as clusters


@dataclass(frozen=True)
class Weights:
    alpha: float = 0.6
    beta: float = 1.0
    gamma: float = 0.4
    delta: float = 0.02


def fitness(park: Park, path: list[int], w: Weights) -> float:
    """Fun and coverage less the costs of repeated edges, nodes and clusters, missing clusters, loops and short routes."""
    repeats = lambda items: w.delta * sum(c * (c - 1) / 2 for c in Counter(items).values())
    n = len(path)
    hops = [tuple(sorted(e)) for e in zip(path, path[1:], strict=False)]
    edge = repeats(hops) / len(hops) if hops else 0.0
    node = repeats(path) / n
    visits = [park.cluster[x] for x in path if x in park.cluster]
    cluster = repeats(visits)
    left = [s for c, s in park.cluster_score.items() if c not in set(visits)]
    missing = sum(left) / len(left) if left else 0.0
    loop = 0.0
    for a, b, c in zip(path, path[1:], path[2:], strict=False):
        out = math.dist(park.xy[a], park.xy[b])
        if math.dist(park.xy[a], park.xy[c]) < 8 and out > 15:
            loop += w.delta * (out - 14)
    loop /= max(n - 2, 1)
    distinct, least = len(set(path)), int(0.3 * len(park.xy))
    short = w.delta * (least - distinct) if distinct < least else 0.0
    fun = park.fun(path)
    value = w.alpha * (0.0 if math.isnan(fun) else fun) - w.beta * (edge + node + 0.8 * cluster + 2 * missing + 0.4 * loop + 0.4 * short) + w.gamma * distinct / max(len(park.xy), 1)
    return value if value > 0 else 1e-6


def _walk(park: Park, start: int, stop: int | None, rng: random.Random, limit: int, weighted: bool) -> list[int]:
    """A walk that prefers unvisited nodes; weighted: by the scores of the edges."""
    path, seen = [start], {start}
    while len(path) < limit and path[-1] != stop:
        near = sorted(park.graph.get(path[-1], ()))
        options = [x for x in near if x not in seen or x == stop] or near
        if not options:
            break
        weights = [max(park.scores.get((path[-1], x), park.scores.get((x, path[-1]), 0.1)), 1e-9) for x in options] if weighted else None
        path.append(rng.choices(options, weights)[0])
        seen.add(path[-1])
    return path


def complete(park: Park, path: list[int], end: int) -> list[int] | None:
    """The path led on to the end by the shortest way, nothing if there is none."""
    if path[-1] == end:
        return path
    rest = dijkstra(park.graph, path[-1], end)
    return path + rest[1:] if rest else None


def initial_route(park: Park, start: int, end: int, rng: random.Random) -> list[int]:
    """A route out by one walk and back by the walk that shares least with it, by legal edges only.

    A round trip takes up to 50 different walks to the farthest node, of 1,000 tries, by the edges' scores and with 40 nodes at
    most; other routes up to 20, of 400 tries, to the farthest node and on to the end, uniform and with 100 steps at most each way.
    Where fewer than two arrive, the shortest way stands in."""
    if start == end and not park.graph.get(start):
        return [start]
    home = complete(park, [start], end)
    if home is None:
        raise ValueError("the end can't be reached")
    reach, todo = {start}, [start]
    while todo:
        new = set(park.graph.get(todo.pop(), ())) - reach
        reach |= new
        todo += new
    reach -= {start, end}
    if not reach:
        return home
    far = max(reach, key=lambda n: (math.dist(park.xy[start], park.xy[n]), -n))
    loop, found = start == end, []
    walks, tries = (50, 1000) if loop else (20, 400)
    for _ in range(tries):
        if len(found) == walks:
            break
        if loop:
            path = _walk(park, start, far, rng, 40, True)
            path = None if path[-1] != far or start in path[1:] else path
        else:
            path = complete(park, _walk(park, start, far, rng, 101, False), far)
            path = path and path + _walk(park, far, end, rng, 101, False)[1:]
        if path and path not in found:
            found.append(path)
    direct = dijkstra(park.graph, start, far)
    found += [direct] * (2 - len(found))
    pairs = [(len(set(a) & set(b)), len(set(a) & set(b)) / len(set(a) | set(b)), i, j) for i, a in enumerate(found) for j, b in enumerate(found[:i])]
    out, back = (found[k] for k in min(pairs)[2:])
    if loop:
        return out + back[::-1][1:]
    return complete(park, complete(park, out, far) + back[back.index(far) + 1 :] if far in back else out, end) or home


def crossover(park: Park, a: list[int], b: list[int], end: int, rng: random.Random) -> tuple[list[int], list[int]]:
    """Two children: either parent up to the first place of a node both have, then the other one from there as far as its
    edges are legal, and led on to the end.  Parents without such a node give themselves."""
    shared = sorted(set(a) & set(b))
    if not shared:
        return complete(park, list(a), end) or list(a), complete(park, list(b), end) or list(b)
    at = rng.choice(shared)

    def child(p: list[int], q: list[int]) -> list[int]:
        out = p[: p.index(at) + 1]
        for node in q[q.index(at) + 1 :]:
            if node not in park.graph.get(out[-1], ()):
                break
            out.append(node)
        return complete(park, out, end) or list(p)

    return child(a, b), child(b, a)


def mutate(park: Park, path: list[int], rng: random.Random) -> list[int]:
    """One inner node gives way to a neighbour of both its neighbours, which may be itself, if there is one."""
    if len(path) < 3:
        return path
    k = rng.randrange(1, len(path) - 1)
    options = sorted((set(park.graph[path[k - 1]]) & set(park.graph[path[k + 1]])) - {path[k + 1]})
    return [*path[:k], rng.choice(options), *path[k + 1 :]] if options else path


def search(spark: SparkSession, park: Park, start: int, end: int, *, population: int = 50, generations: int = 200, mutation: float = 0.2, weights: Weights = Weights(), seed: int = 0, keep_best: bool = True) -> tuple[list[int], float]:
    """The best route from start to end and its fitness.

    Without keep_best, a plateau returns the last generation's best even if an earlier one was better."""
    if not park.cluster_score and park.cluster:
        score_clusters(spark, park)
    shipped = spark.sparkContext.broadcast(park)
    slots = min(population, spark.sparkContext.defaultParallelism)

    def evaluate(batches):
        p = shipped.value
        for pdf in batches:
            slots_, paths = [], []
            for r in pdf.itertuples():
                rng = random.Random(f"{seed}/{r.gen}/{r.slot}")
                if r.a is None or not len(r.a):
                    made = [initial_route(p, start, end, rng)]
                else:
                    made = [mutate(p, x, rng) if rng.random() < mutation else x for x in crossover(p, list(r.a), list(r.b), end, rng)]
                slots_ += [r.slot * 2 + k for k in range(len(made))]
                paths += [[int(x) for x in path] for path in made]
            yield pd.DataFrame({"slot": slots_, "path": paths, "fitness": [fitness(p, x, weights) for x in paths]})

    def generation(number: int, parents: list[tuple]) -> list[tuple[list[int], float]]:
        df: DataFrame = spark.createDataFrame([(number, k, a, b) for k, (a, b) in enumerate(parents)], "gen int, slot int, a array<long>, b array<long>")
        rows = df.repartition(slots).mapInPandas(evaluate, "slot int, path array<long>, fitness double").collect()  # `population` routes
        return [(list(r.path), r.fitness) for r in sorted(rows, key=lambda r: r.slot)][:population]

    rng = random.Random(seed)
    now = generation(0, [(None, None)] * population)
    best = max(now, key=lambda x: x[1])
    last = best[1]
    for g in range(1, generations + 1):
        paths, fits = zip(*now, strict=True)
        now = generation(g, [tuple(rng.choices(paths, fits, k=2)) for _ in range((population + 1) // 2)])
        top = max(now, key=lambda x: x[1])
        plateau = abs(top[1] - last) < 1e-8 and abs(best[1]) > 0.1
        if top[1] > best[1] or plateau and not keep_best:
            best = top
        if plateau:
            break
        last = top[1]
    return best


def route_table(spark: SparkSession, park: Park, path: list[int]) -> DataFrame:
    """pos, node_id, x, y of a route."""
    return spark.createDataFrame([(k, n, *map(float, park.xy[n])) for k, n in enumerate(path)], "pos int, node_id long, x double, y double")


def park_of(nodes: DataFrame, links: DataFrame, scores: DataFrame, vectors: DataFrame, clusters: DataFrame | None = None, n_sectors: int = S.N_SECTORS) -> Park:
    """One garden's tables on the driver, refused if they are large: nodes, links u v length, scores src dst score,
    vectors node_id v, clusters node_id cluster_id."""
    from scenewright.functions import expressions as E
    from scenewright.operators.graph import adjacency

    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES or links.limit(10 * MOST_NODES + 1).count() > 10 * MOST_NODES:
        raise ValueError("the graph is too large to broadcast")
    of = nodes.select("node_id").distinct()  # as many rows as nodes, at most
    ends = [of.withColumnRenamed("node_id", x) for x in ("src", "dst")]
    scores = scores.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").groupBy("src", "dst").agg(F.max("score").alias("score"))
    if scores.limit(20 * MOST_NODES + 1).count() > 20 * MOST_NODES:
        raise ValueError("the scores are too large to broadcast")
    vectors = vectors.join(of, "node_id", "left_semi").dropDuplicates(["node_id"])
    types = vectors.select("node_id", *[E.array_sum(_slice(k, n_sectors)).alias(f"t{k}") for k in range(4)])
    return Park(
        adjacency((r.u, r.v, r.length) for r in links.select("u", "v", "length").collect()),
        {r.node_id: (r.x, r.y) for r in nodes.select("node_id", "x", "y").collect()},
        {(r.src, r.dst): r.score for r in scores.select("src", "dst", "score").collect()},
        {r.node_id: (r.t0, r.t1, r.t2, r.t3) for r in types.collect()},
        {r.node_id: r.cluster_id for r in clusters.select("node_id", "cluster_id").collect()} if clusters is not None else {},
    )


def _slice(k: int, n: int):
    return F.slice("v", k * n + 1, n)
