"""Column builders: decays, geometry in closed form, labels, array arithmetic.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright import schema as S


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# decays: float -> float, given as column builders so that a plan stays inside generated code


def exponential_decay(d, max_distance: float = S.DECAY_DISTANCE, lam: float = S.DECAY_RATE) -> Column:
    """1 up to distance 0, 0 from max_distance on, exp(-lam d / max_distance) between."""
    d = _c(d)
    return F.when(d <= 0, 1.0).when(d >= max_distance, 0.0).otherwise(F.exp(d * (-lam / max_distance)))


def linear_decay(d, max_distance: float = S.DECAY_DISTANCE) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - _c(d) / max_distance)


def plain_decay(d, alpha: float = 0.1) -> Column:
    return F.exp(_c(d) * -alpha)


def range_decay(d, max_distance: float = S.DECAY_DISTANCE) -> Column:
    return F.exp(-_c(d) / max_distance)


# geometry


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((_c(x1) - _c(x2)) ** 2 + (_c(y1) - _c(y2)) ** 2)


def circumradius(ax, ay, bx, by, cx, cy) -> Column:
    """The radius of the circle through three points by Heron's formula; infinite if they lie on a line."""
    a, b, c = distance(bx, by, cx, cy), distance(cx, cy, ax, ay), distance(ax, ay, bx, by)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    return F.when(area == 0, F.lit(float("inf"))).otherwise(a * b * c / (4 * area))


def circle_overlap(x1, y1, r1, x2, y2, r2) -> Column:
    """The area two circles share, as a part of the smaller one: 0 apart, 1 nested, the lens between."""
    r1, r2 = _c(r1), _c(r2)
    d = distance(x1, y1, x2, y2)
    a1 = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d * d + r1 * r1 - r2 * r2) / (2 * d * r1))))
    a2 = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d * d + r2 * r2 - r1 * r1) / (2 * d * r2))))
    lens = r1 * r1 * (a1 - F.sin(2 * a1) / 2) + r2 * r2 * (a2 - F.sin(2 * a2) / 2)
    small = F.least(r1, r2)
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), 1.0).otherwise(lens / (F.pi() * small * small))


def shoelace(ring, closed: bool = False) -> Column:
    """Half the absolute sum of the cross products of consecutive vertices.

    With closed=False the last vertex isn't joined to the first, so a ring stored without its closing vertex has an area
    that depends on where it lies; closed=True gives the true area of either kind of ring."""
    ring = _c(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)) if closed else F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    cross = F.zip_with(F.slice(ring, 1, F.size(after)), after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def coordinates(ring, axis: str) -> Column:
    return F.transform(_c(ring), lambda p: p[axis])


def vertex_mean(ring, axis: str) -> Column:
    ring = _c(ring)
    return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ring)


def circle_ring(cx, cy, radius, vertices: int = S.CIRCLE_VERTICES) -> Column:
    """A circle as a closed ring, clockwise from the east."""
    step = 2.0 / vertices
    return F.transform(
        F.sequence(F.lit(0), F.lit(vertices)),
        lambda k: F.struct((_c(cx) + _c(radius) * F.cos(F.pi() * (k % vertices) * -step)).alias("x"), (_c(cy) + _c(radius) * F.sin(F.pi() * (k % vertices) * -step)).alias("y")),
    )


def closed_ring(ring) -> Column:
    ring = _c(ring)
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


# labels

_EIGHT = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]


def direction_label(sector, n_sectors: int) -> Column:
    """The compass label of a sector; with 16 sectors the odd ones join two neighbours' labels."""
    if n_sectors == 8:
        labels = _EIGHT
    elif n_sectors == 16:
        labels = [x for i in range(8) for x in (_EIGHT[i], _EIGHT[i] + _EIGHT[(i + 1) % 8])]
    else:
        labels = [_EIGHT[int((360.0 * k / n_sectors + 22.5) // 45) % 8] for k in range(n_sectors)]
    return F.element_at(F.array(*map(F.lit, labels)), _c(sector).cast("int") + 1)


def adaptive_k(area) -> Column:
    """The number of openness clusters for a garden's area: 6 if unknown, else 5 to 8."""
    k = F.least(F.lit(8.0), F.greatest(F.lit(5.0), 5 + (_c(area) - 0.5) / 4.5 * 3))
    return F.when(_c(area).isNull(), 6).otherwise(k.cast("int"))


def garden_name(path) -> Column:
    """The name of the parent folder after its first full stop."""
    parent = F.element_at(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), -2)
    return F.trim(F.regexp_replace(parent, r"^[^.]*\.", ""))


# arrays


def array_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def l1(a, b) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def l2(a, b) -> Column:
    return F.sqrt(array_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def feature_difference(a, b, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """alpha * L1 distance + beta * difference of the sums; an exact 0 becomes 1e-5."""
    d = alpha * l1(a, b) + beta * F.abs(array_sum(a) - array_sum(b))
    return F.when(d == 0, F.lit(1e-5)).otherwise(d)


def normalized(v, eps: float = 1e-12) -> Column:
    total = array_sum(v)
    return F.transform(_c(v), lambda x: x / (total + eps))


def jaccard(a, b) -> Column:
    """The shared part of two sets given as arrays; 1 for two empty ones."""
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

