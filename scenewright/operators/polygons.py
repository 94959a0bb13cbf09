"""Planar algorithms on small point sets, and areas of intersections as relational algebra over outline edges."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import expressions as E
from scenewright.operators.visibility import SIDES, eight_sides, outlines

Point = tuple[float, float]


def hull(points: list[Point]) -> list[Point]:
    """The convex hull counter-clockwise from the lowest leftmost point; up to two points are returned as they are, points
    on a line (a range below 1e-5) in lexical order."""
    if len(points) < 3:
        return list(points)
    xs, ys = zip(*points, strict=True)
    ordered = sorted(set(points))
    if max(xs) - min(xs) < 1e-5 or max(ys) - min(ys) < 1e-5 or len(ordered) < 3:
        return sorted(points)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for run in (ordered, ordered[::-1]):
        chain: list[Point] = []
        for p in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    whole = chains[0] + chains[1]
    return whole if len(whole) > 2 else ordered


def _order(points: np.ndarray) -> np.ndarray:
    """An order of the points for insertion: random rounds, each twice as long as the one before, each row by row through a grid."""
    n = len(points)
    low, wide = points.min(0), np.maximum(np.ptp(points, axis=0), 1e-300)
    round_ = np.minimum(np.floor(-np.log2(np.maximum(np.random.default_rng(0).random(n), 1e-300))), 40).astype(np.int64)
    across = np.maximum((n / 4 / 2.0**round_) ** 0.5, 1).astype(np.int64)
    gx, gy = (np.minimum((points[:, k] - low[k]) / wide[k] * across, across - 1).astype(np.int64) for k in (0, 1))
    return np.lexsort((np.where(gx % 2 == 0, gy, -gy), gx, -round_))


def _whole(v: np.ndarray) -> list[int]:
    """Numbers as whole ones, exactly, all by the same power of two."""
    m, e = np.frexp(v)
    m, e = (m * 2.0**53).astype(np.int64).tolist(), np.where(m == 0, 0, e - 53)
    low = int(e.min(initial=0))
    return [k << int(x) - low for k, x in zip(m, e, strict=True)]


def triangulate(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of different points, counter-clockwise; none if all lie on a line.

    Signs are exact, and of points on one circle the lexically lower ones count as a little further out of it, so the
    triangles follow from the points alone.  Points go in one after the other, near the last one; outside the hull triangles
    have the corner -1."""
    n = len(points)
    if n < 3:
        return []
    xs, ys = points[:, 0].tolist(), points[:, 1].tolist()
    whole = _whole(points.reshape(-1).astype(float))
    wx, wy = whole[0::2], whole[1::2]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((points[:, 1], points[:, 0]))] = np.arange(n)
    rank = rank.tolist()

    def side(a, b, c):
        """Above 0 if a, b, c turn to the left."""
        p, q = (xs[b] - xs[a]) * (ys[c] - ys[a]), (ys[b] - ys[a]) * (xs[c] - xs[a])
        if abs(p - q) > 1e-15 * (abs(p) + abs(q)) + 1e-290:
            return p - q
        return (wx[b] - wx[a]) * (wy[c] - wy[a]) - (wy[b] - wy[a]) * (wx[c] - wx[a])

    def within(a, b, c, d):
        """Whether d lies within the circle of a, b, c; with the corner -1, beyond their side or on it."""
        if a < 0 or b < 0 or c < 0:
            a, b = (b, c) if a < 0 else (c, a) if b < 0 else (a, b)
            turn = side(a, b, d)
            return turn > 0 or (turn == 0 and (wx[a] - wx[d]) * (wx[b] - wx[d]) + (wy[a] - wy[d]) * (wy[b] - wy[d]) < 0)
        x, y = xs[d], ys[d]
        ax, ay, bx, by, cx, cy = xs[a] - x, ys[a] - y, xs[b] - x, ys[b] - y, xs[c] - x, ys[c] - y
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        u, v, w, r, s, t = bx * cy, by * cx, cx * ay, cy * ax, ax * by, ay * bx
        det = a2 * (u - v) + b2 * (w - r) + c2 * (s - t)
        if abs(det) > 2e-15 * (a2 * (abs(u) + abs(v)) + b2 * (abs(w) + abs(r)) + c2 * (abs(s) + abs(t))) + 1e-280:
            return det > 0
        x, y = wx[d], wy[d]
        ax, ay, bx, by, cx, cy = wx[a] - x, wy[a] - y, wx[b] - x, wy[b] - y, wx[c] - x, wy[c] - y
        det = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if det:
            return det > 0
        # the lowest of the four is lifted: itself it lies out of the circle, as a corner it lets those in that lie on its side
        first = min((a, b, c, d), key=rank.__getitem__)
        if first == d:
            return False
        p, q = (b, c) if first == a else (c, a) if first == b else (a, b)
        return side(p, q, d) > 0

    order = _order(points).tolist()
    i, j = order[0], order[1]
    k = next((m for m in range(2, n) if side(i, j, order[m])), None)
    if k is None:
        return []
    k = order.pop(k)
    if side(i, j, k) < 0:
        i, j = j, i
    third = {(i, j): k, (j, k): i, (k, i): j, (j, i): -1, (i, -1): j, (-1, j): i, (k, j): -1, (j, -1): k, (-1, k): j, (i, k): -1, (k, -1): i, (-1, i): k}
    at = (i, j)
    for m in order[2:]:
        a, b = at
        c = third[a, b]
        while c >= 0:  # walk to the triangle that holds the point, or out over a side of the hull
            if side(b, c, m) < 0:
                a, b = c, b
            elif side(c, a, m) < 0:
                a, b = a, c
            elif side(a, b, m) < 0:
                a, b = b, a
            else:
                break
            c = third[a, b]
        stack = [(a, b), (b, c), (c, a)]
        del third[a, b], third[b, c], third[c, a]
        while stack:
            u, v = stack.pop()
            w = third[v, u]
            if within(v, u, w, m):
                del third[v, u], third[u, w], third[w, v]
                stack += (u, w), (w, v)
            else:
                third[u, v], third[v, m], third[m, u] = m, u, v
                if u >= 0 and v >= 0:
                    at = u, v
    return [(a, b, c) for (a, b), c in third.items() if 0 <= a < b and a < c]


#: A side of a part of an alpha shape: part, the part's area, from, to; the inside lies on the left.
Side = tuple[object, float, Point, Point]


def alpha_sides(points: np.ndarray, alpha: float, own: np.ndarray | None = None) -> list[Side]:
    """The sides of the parts that Delaunay triangles of a circumradius of at most alpha make where they share edges.

    points are different and in lexical order; own: only triangles whose first corner is one of these.  Such triangles are the same
    whatever lies further than 2 * alpha from that corner."""
    t = np.array(triangulate(points), dtype=np.int64).reshape(-1, 3)
    if own is not None:
        t = t[own[t[:, 0]]]
    x, y = points[:, 0][t], points[:, 1][t]
    a, b, c = (np.hypot(x[:, i] - x[:, j], y[:, i] - y[:, j]) for i, j in ((0, 1), (1, 2), (2, 0)))
    twice = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (y[:, 1] - y[:, 0]) * (x[:, 2] - x[:, 0])
    kept = (twice > 0) & (a * b * c <= 2 * twice * alpha * (1 + 1e-12))  # triangles of one circle are all kept or none
    t, area_of = t[kept], twice[kept] / 2
    n, m = len(points), len(t)
    of, u, v = np.tile(np.arange(m), 3), t.T.reshape(-1), t[:, [1, 2, 0]].T.reshape(-1)
    order = np.argsort(u * n + v)
    key, back = (u * n + v)[order], v * n + u
    place = np.minimum(np.searchsorted(key, back), max(len(key) - 1, 0))
    shared = key[place] == back
    part = list(range(m))
    for i, j in zip(of[shared].tolist(), of[order[place[shared]]].tolist(), strict=True):
        i, j = _root(part, i), _root(part, j)
        if i != j:
            part[i] = j
    area, root = [0.0] * m, [_root(part, i) for i in range(m)]
    for i, s in zip(root, area_of.tolist(), strict=True):
        area[i] += s
    xs, ys = points[:, 0].tolist(), points[:, 1].tolist()
    return [(root[k], area[root[k]], (xs[i], ys[i]), (xs[j], ys[j])) for k, i, j in zip(of[~shared].tolist(), u[~shared].tolist(), v[~shared].tolist(), strict=True)]


def _root(part, k):
    while part[k] != k:
        part[k] = part[part[k]]
        k = part[k]
    return k


def outer_ring(sides: list[Side]) -> list[Point]:
    """The outer ring (not closed) of the largest part, of equal ones that with the lowest corner; parts that share a side are one."""
    at = {(p, q): k for k, _, p, q in sides}
    area = {k: s for k, s, _, _ in sides}
    part = {k: k for k in area}
    for (p, q), k in at.items():
        if (q, p) in at:
            part[_root(part, k)] = _root(part, at[q, p])
    total = Counter()
    for k, s in area.items():
        total[_root(part, k)] += s
    open_ = [(p, q, _root(part, k)) for (p, q), k in at.items() if (q, p) not in at]
    least = max(total.values()) * (1 - 1e-9)
    best = min((p, k) for p, _, k in open_ if total[k] >= least)[1]
    nexts = defaultdict(list)
    for p, q, k in open_:
        if k == best:
            nexts[p].append(q)
    rings = []
    for start in sorted(nexts):
        while start in nexts:
            ring, at, came = [start], start, None
            while True:
                options = nexts[at]
                if came is None or len(options) == 1:
                    to = options[0]
                else:  # where parts touch in a vertex: the sharpest turn to the right keeps to one part
                    back = math.atan2(came[1] - at[1], came[0] - at[0])
                    to = min(options, key=lambda v: (math.atan2(v[1] - at[1], v[0] - at[0]) - back) % (2 * math.pi))
                options.remove(to)
                if not options:
                    del nexts[at]
                if to == start:
                    break
                ring.append(to)
                at, came = to, at
            rings.append(ring)
    return max(rings, key=lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, [*r[1:], r[0]], strict=True)))


def alpha_shape(points: list[Point], alpha: float) -> list[Point]:
    """The outer ring (not closed) of the largest part of the union of Delaunay triangles whose circumradius is at most
    alpha; fewer than four points are returned as they are, and without such a triangle the hull."""
    if len(points) < 4:
        return list(points)
    unique = sorted(set(points))
    if len(unique) < 3:
        return unique
    sides = alpha_sides(np.array(unique, dtype=float), alpha)
    return [(float(x), float(y)) for x, y in outer_ring(sides)] if sides else hull(unique)


def thicken(points: list[Point], half: float, mitre: float = 5.0) -> list[Point]:
    """The outer ring (not closed) of a line of walls made 2 * half wide, with flat ends and mitred corners.

    A closed line gives its outer side only, so a loop of walls is filled.  Corners sharper than the mitre limit are
    cut.  Where the sides cross, as those of a line that crosses itself do, the outer boundary of what they enclose counts."""
    closed = points[0] == points[-1]
    line = points[:-1] if closed else points
    n = len(line)
    closed = closed and n != 2  # there and back is one wall
    if n < 2:
        raise ValueError("a wall needs two different points")

    def normal(a, b):
        d = math.dist(a, b)
        return (b[1] - a[1]) / d, (a[0] - b[0]) / d

    def corner(p, u, v):
        """Where the sides with normals u and v meet."""
        c = u[0] * v[0] + u[1] * v[1]
        if 1 + c < 2 / (mitre * mitre):
            return [(p[0] + half * u[0], p[1] + half * u[1]), (p[0] + half * v[0], p[1] + half * v[1])]
        k = half / (1 + c)
        return [(p[0] + k * (u[0] + v[0]), p[1] + k * (u[1] + v[1]))]

    def side(pts, loop):
        m = len(pts)
        normals = [normal(pts[k], pts[(k + 1) % m]) for k in range(m if loop else m - 1)]
        out = [] if loop else [(pts[0][0] + half * normals[0][0], pts[0][1] + half * normals[0][1])]
        for k in range(m) if loop else range(1, m - 1):
            out += corner(pts[k], normals[k - 1], normals[k])
        return out if loop else [*out, (pts[-1][0] + half * normals[-1][0], pts[-1][1] + half * normals[-1][1])]

    if closed:
        area = sum(line[k][0] * line[(k + 1) % n][1] - line[(k + 1) % n][0] * line[k][1] for k in range(n))
        return outer_face(side(line if area > 0 else line[::-1], True))
    return outer_face(side(line, False) + side(line[::-1], False))


def outer_face(ring: list[Point]) -> list[Point]:
    """The ring, or if it crosses itself the outer boundary of all it encloses, counter-clockwise.

    The edges are cut where they cross; from the leftmost corner the walk always takes the edge furthest to the right."""
    n = len(ring)
    cuts: list[list[tuple[float, Point]]] = [[] for _ in range(n)]
    for i in range(n):
        (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
        for j in range(i + 1, n):
            (cx, cy), (dx, dy) = ring[j], ring[(j + 1) % n]
            d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if not d:
                continue
            t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / d
            if 1e-12 < t < 1 - 1e-12 and 1e-12 < u < 1 - 1e-12:
                p = (ax + t * (bx - ax), ay + t * (by - ay))
                cuts[i].append((t, p))
                cuts[j].append((u, p))
    if not any(cuts):
        return ring
    to = defaultdict(set)
    for i in range(n):
        chain = [ring[i], *[p for _, p in sorted(cuts[i])], ring[(i + 1) % n]]
        for p, q in zip(chain, chain[1:], strict=False):
            if p != q:
                to[p].add(q)
                to[q].add(p)
    start = min(to)
    out, at, back = [start], start, -math.pi / 2
    while True:
        angle = {q: (math.atan2(q[1] - at[1], q[0] - at[0]) - back) % (2 * math.pi) or 2 * math.pi for q in to[at]}
        nxt = min(to[at], key=angle.get)
        if nxt == start:
            return out
        if len(out) > 4 * sum(map(len, to.values())):
            raise ValueError("the outline can't be followed")
        out.append(nxt)
        back, at = math.atan2(at[1] - nxt[1], at[0] - nxt[0]), nxt


def bounds(elements: DataFrame) -> DataFrame:
    """garden_id, min_x, min_y, max_x, max_y over shells and circles."""
    shell, circle = F.element_at("rings", 1), F.col("gtype") == "Circle"
    box = {f"{end}_{axis}": F.when(circle, F.col(f"c{axis}") + (F.col("radius") if end == "max" else -F.col("radius"))).otherwise(getattr(F, f"array_{end}")(E.coordinates(shell, axis))) for end in ("min", "max") for axis in ("x", "y")}
    return elements.withColumns(box).groupBy("garden_id").agg(*[getattr(F, k[:3])(k).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])


def grid_centres(bounds_: DataFrame, nx: int = 10, ny: int = 10) -> DataFrame:
    """garden_id, i, j, x, y: the middles of nx * ny cells, in order of x."""
    return (
        bounds_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
        .select("garden_id", "i", "j", (F.col("min_x") + (F.col("i") + 0.5) * (F.col("max_x") - F.col("min_x")) / nx).alias("x"), (F.col("min_y") + (F.col("j") + 0.5) * (F.col("max_y") - F.col("min_y")) / ny).alias("y"))
    )


def _edges(rings) -> Column:
    """The edges of all rings as one array of x1, y1, x2, y2."""
    return F.flatten(F.transform(rings, lambda q: F.zip_with(F.slice(q, 1, F.size(q) - 1), F.slice(q, 2, F.size(q) - 1), lambda s, e: F.struct(s["x"].alias("x1"), s["y"].alias("y1"), e["x"].alias("x2"), e["y"].alias("y2")))))


#: Distances, times an edge's length, below which a point lies on the edge.
TINY = 1e-9


def _side(e, x, y) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _crosses() -> Column:
    """Whether an edge of `ea` crosses one of `eb`."""
    opposite = lambda u, v: ((u > TINY) & (v < -TINY)) | ((u < -TINY) & (v > TINY))
    return F.exists("ea", lambda e: F.exists("eb", lambda f: opposite(_side(e, f["x1"], f["y1"]), _side(e, f["x2"], f["y2"])) & opposite(_side(f, e["x1"], e["y1"]), _side(f, e["x2"], e["y2"]))))


def _inside(p) -> Column:
    """Whether p lies within the outline of the edges `eb`, or on it."""
    on = lambda e: (F.abs(_side(e, p["x"], p["y"])) <= TINY) & ((e["x1"] - p["x"]) * (e["x2"] - p["x"]) + (e["y1"] - p["y"]) * (e["y2"] - p["y"]) <= TINY)
    above = lambda e: ((e["x1"] > p["x"]) != (e["x2"] > p["x"])) & (p["y"] < e["y1"] + (e["y2"] - e["y1"]) * (p["x"] - e["x1"]) / (e["x2"] - e["x1"]))
    return (F.aggregate("eb", F.lit(0), lambda acc, e: acc + F.when(above(e), 1).otherwise(0)) % 2 == 1) | F.exists("eb", on)


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner_ord, outer_ord) of elements, the first inside the second: their outlines don't cross and no vertex of
    the first lies outside; outlines may touch.  Eight sides prune through grid cells; in a convex shape with no others they
    decide, in other shapes one vertex prunes and then the outlines do."""
    cell = 16.0
    keys = ["garden_id"] if "garden_id" in inner.columns and "garden_id" in outer.columns else []
    sides = [f"{end}_{k}" for k in SIDES for end in ("low", "high")]
    a = eight_sides(outlines(inner)).select(*keys, F.col("elem_ord").alias("inner_ord"), *[F.col(c).alias(f"a_{c}") for c in sides], F.array_distinct(F.element_at("rings", 1)).alias("shell"), _edges("rings").alias("ea"), F.floor(F.col("min_x") / cell).alias("gx"), F.floor(F.col("min_y") / cell).alias("gy"))
    b = eight_sides(outlines(outer)).select(*keys, F.col("elem_ord").alias("outer_ord"), "plain", *[F.col(c).alias(f"b_{c}") for c in sides], _edges("rings").alias("eb"))
    within = " AND ".join(["inner_ord <> outer_ord", *[f"a_low_{k} >= b_low_{k} - 1e-9 AND a_high_{k} <= b_high_{k} + 1e-9" for k in SIDES]])

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumn("gx", F.explode(F.sequence(F.floor(F.col("b_low_x") / cell), F.floor(F.col("b_high_x") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("b_low_y") / cell), F.floor(F.col("b_high_y") / cell))))
        return a.join(b.hint("merge"), [*keys, "gx", "gy"]).filter(within)

    plain = near(a.drop("shell", "ea"), b.filter("plain").drop("eb")).select("inner_ord", "outer_ord")
    first = near(a, b.filter("NOT plain")).filter(_inside(F.element_at("shell", 1)))
    return plain.unionByName(first.filter(F.forall("shell", _inside) & ~_crosses()).select("inner_ord", "outer_ord"))


def contained_in_long(inner: DataFrame, outer: DataFrame, strip: float = 4.0) -> DataFrame:
    """`contained` for outer shapes whose outlines have many edges: these are dealt over strips of x, in each of which a corner only
    meets the edges above or below it; the strips of an inner shape all have to find it inside."""
    keys = ["garden_id"] if "garden_id" in inner.columns and "garden_id" in outer.columns else []
    a = outlines(inner).select(*keys, F.col("elem_ord").alias("inner_ord"), F.array_distinct(F.element_at("rings", 1)).alias("shell"), _edges("rings").alias("ea"), "min_x", "max_x", "min_y", "max_y")
    a = a.withColumn("strips", F.sequence(F.floor(F.col("min_x") / strip), F.floor(F.col("max_x") / strip))).withColumn("n_strips", F.size("strips")).withColumn("strip", F.explode("strips")).drop("strips")
    b = outlines(outer).select(*keys, F.col("elem_ord").alias("outer_ord"), *[F.col(f"{end}_{k}").alias(f"b_{end}_{k}") for end in ("min", "max") for k in ("x", "y")], F.explode(_edges("rings")).alias("e"))
    low, high = F.least("e.x1", "e.x2") - 1e-6, F.greatest("e.x1", "e.x2") + 1e-6
    b = b.withColumn("strip", F.explode(F.sequence(F.floor(low / strip), F.floor(high / strip))))
    b = b.groupBy(*[c for c in b.columns if c != "e"]).agg(F.collect_list("e").alias("eb"))
    met = a.join(b, [*keys, "strip"]).filter("inner_ord <> outer_ord AND min_x >= b_min_x - 1e-9 AND max_x <= b_max_x + 1e-9 AND min_y >= b_min_y - 1e-9 AND max_y <= b_max_y + 1e-9")
    here = F.filter("shell", lambda p: F.floor(p["x"] / strip) == F.col("strip"))
    good = met.filter(F.forall(here, _inside) & ~_crosses())
    return good.groupBy("inner_ord", "outer_ord", "n_strips").agg(F.count(F.lit(1)).alias("n")).filter("n = n_strips").select("inner_ord", "outer_ord")


def _signed_edges() -> Column:
    """The edges of all rings with s, the sign that makes the shell run counter-clockwise and holes against it."""
    signed = lambda q: F.aggregate(F.zip_with(F.slice(q, 1, F.size(q) - 1), F.slice(q, 2, F.size(q) - 1), lambda s, e: s["x"] * e["y"] - e["x"] * s["y"]), F.lit(0.0), lambda acc, v: acc + v)
    rings = F.transform("rings", lambda q, i: F.struct(q.alias("q"), (F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(signed(q))).alias("s")))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(F.slice(r["q"], 1, F.size(r["q"]) - 1), F.slice(r["q"], 2, F.size(r["q"]) - 1), lambda s, e: F.struct(s["x"].alias("x1"), s["y"].alias("y1"), e["x"].alias("x2"), e["y"].alias("y2"), r["s"].alias("s")))))


def _on_blocks(blocks: DataFrame, elements: DataFrame, cell: float) -> DataFrame:
    """block_id, elem_ord, bx0, by0, bx1, by1, x1, y1, x2, y2, s, u0, u1: the outline edges of the elements that meet each
    block, with their range of x inside it."""
    keys = ["garden_id"] if "garden_id" in blocks.columns and "garden_id" in elements.columns else []
    b = blocks.select(*keys, "block_id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    b = b.withColumn("gx", F.explode(F.sequence(F.floor(F.col("bx0") / cell), F.floor(F.col("bx1") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("by0") / cell), F.floor(F.col("by1") / cell))))
    o = outlines(elements).select(*keys, "elem_ord", _signed_edges().alias("edges"), "min_x", "max_x", "min_y", "max_y", F.floor(F.col("min_x") / cell).alias("lx"), F.floor(F.col("min_y") / cell).alias("ly"))
    o = o.withColumn("gx", F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("min_y") / cell), F.floor(F.col("max_y") / cell))))
    met = b.join(o.hint("merge"), [*keys, "gx", "gy"]).filter("min_x <= bx1 AND max_x >= bx0 AND min_y <= by1 AND max_y >= by0")
    # a pair meets in several cells; the one with the greater corner of the two boxes' lower corners counts
    met = met.filter((F.col("gx") == F.greatest(F.col("lx"), F.floor(F.col("bx0") / cell))) & (F.col("gy") == F.greatest(F.col("ly"), F.floor(F.col("by0") / cell))))
    of = ["block_id", "elem_ord", "bx0", "by0", "bx1", "by1"]
    cut = met.select(*of, F.explode("edges").alias("e")).select(*of, "e.*").filter("x1 <> x2 AND greatest(y1, y2) > by0")
    return cut.withColumn("u0", F.greatest(F.least("x1", "x2"), "bx0")).withColumn("u1", F.least(F.greatest("x1", "x2"), "bx1")).filter("u1 > u0")


def _height(edge: str, u: str) -> str:
    """The height above the block's floor of an edge's line at u; `edge` stands before its columns' names."""
    return f"({edge}y1 + ({edge}y2 - {edge}y1) * ({u} - {edge}x1) / ({edge}x2 - {edge}x1) - by0)"


def _under(h0: str, h1: str) -> str:
    """The mean over a linear run from h0 to h1 of its height, cut to 0 .. top."""
    to = lambda h: f"(CASE WHEN {h} <= 0 THEN 0e0 WHEN {h} <= top THEN {h} * {h} / 2 ELSE top * {h} - top * top / 2 END)"
    return f"CASE WHEN abs({h1} - {h0}) < 1e-12 THEN greatest(0e0, least(top, {h0})) ELSE ({to(h1)} - {to(h0)}) / ({h1} - {h0}) END"


def clipped_area(blocks: DataFrame, elements: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """block_id, elem_ord, area of each element inside each block (block_id, x0, y0, x1, y1) that it meets, and inside the
    boundary (elements that don't overlap each other, of any shape).

    An outline is the signed sum of the trapezoids between its edges and the block's floor, shells and holes alike, and so
    is the boundary; the area is the sum over the trapezoids, or over the pairs of them, of what they share."""
    cell = blocks.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).collect()[0][0] or 1.0
    cut = _on_blocks(blocks, elements, cell).withColumn("top", F.expr("by1 - by0")).withColumn("turn", F.expr("-s * signum(x2 - x1)"))
    if boundary is None:
        runs = cut.withColumn("h0", F.expr(_height("", "u0"))).withColumn("h1", F.expr(_height("", "u1"))).withColumn("w", F.expr("u1 - u0"))
    else:
        other = _on_blocks(blocks, boundary, cell).select("block_id", *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2", "s", "u0", "u1")])
        both = cut.join(other, "block_id").filter("u0 < o_u1 AND o_u0 < u1").withColumns({"u0": F.greatest("u0", "o_u0"), "u1": F.least("u1", "o_u1"), "turn": F.expr("-turn * o_s * signum(o_x2 - o_x1)")})
        both = both.withColumns({"a0": F.expr(_height("", "u0")), "a1": F.expr(_height("", "u1")), "b0": F.expr(_height("o_", "u0")), "b1": F.expr(_height("o_", "u1"))})
        # the lower of two lines is one line, or two where they cross
        t = F.expr("(a0 - b0) / ((a0 - b0) - (a1 - b1))")
        at = F.col("a0") + t * (F.col("a1") - F.col("a0"))
        w, run = F.col("u1") - F.col("u0"), lambda w, p, q: F.struct(w.alias("w"), p.alias("h0"), q.alias("h1"))
        low0, low1 = F.least("a0", "b0"), F.least("a1", "b1")
        pieces = F.when(F.expr("(a0 - b0) * (a1 - b1) < 0"), F.array(run(w * t, low0, at), run(w * (1 - t), at, low1))).otherwise(F.array(run(w, low0, low1)))
        runs = both.select("block_id", "elem_ord", "turn", "top", F.inline(pieces))
    return runs.groupBy("block_id", "elem_ord").agg(F.sum(F.col("turn") * F.col("w") * F.expr(_under("h0", "h1"))).alias("area")).filter("area > 1e-9")


def visible_part(blocks: DataFrame, elements: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """block_id, visibility: the area of the elements inside each block and the boundary, weighted by transparency, as a part
    of the block's area inside the boundary (without one the whole block), cut to 0..1; overlapping elements count twice."""
    of = clipped_area(blocks, elements, boundary).join(elements.select("elem_ord", "transparent"), "elem_ord").groupBy("block_id").agg(F.sum(F.col("area") * F.col("transparent")).alias("s"))
    out = blocks.select("block_id").join(inside_area(blocks, boundary), "block_id", "left").join(of, "block_id", "left")
    part = F.when(F.col("a") > 0, F.coalesce("s", F.lit(0.0)) / F.col("a")).otherwise(0.0)
    return out.select("block_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)).alias("visibility"))


def inside_area(blocks: DataFrame, boundary: DataFrame | None) -> DataFrame:
    """block_id, a: each block's area inside the boundary; blocks outside it have no row."""
    if boundary is None:
        return blocks.select("block_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a"))
    return clipped_area(blocks, boundary).groupBy("block_id").agg(F.sum("area").alias("a"))


def convex_hulls(points: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, x, y: the convex hull of the points (keys, x, y) of each group, by `hull`.

    Parts of a group are reduced to their hulls first, so the last task of a group only meets the corners of its parts."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(sorted(zip(pdf.x.tolist(), pdf.y.tolist(), strict=True)))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "pos": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, pos int, x double, y double"
    parts = points.select(*keys, "x", "y").distinct().groupBy(*keys, F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("part")).applyInPandas(reduce, schema)
    return parts.groupBy(*keys).applyInPandas(reduce, schema)
