"""For each query, SQL over the same tables that must give the same rows.  Written from the definitions, by brute force."""

from __future__ import annotations

from scenewright import schema as S
from scenewright.plans.queries import PARK_BOXES
from scenewright.plans.scene import with_sql


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0e0 AS {name}"


def _hits(n: int, length: float, r_safe: float | None = None) -> str:
    """rays, crossings and hits of viewpoints against all elements in reach."""
    virtual = "" if r_safe is not None else f" UNION ALL SELECT node_id, ray, elem_ord, {S.VIRTUAL_HIT}e0, 0 FROM met WHERE crossings % 2 = 1"
    near = "" if r_safe is None else f" WHERE d > {r_safe}"
    return f"""
    rays AS (SELECT i AS ray, cos(2 * pi() * i / {n}) AS dx, sin(2 * pi() * i / {n}) AS dy FROM range({n}) t(i)),
    near AS (SELECT node_id, vx, vy, elem_ord FROM viewpoints, elements WHERE abs(vx - x) <= {length} + h AND abs(vy - y) <= {length} + h),
    rel AS (SELECT node_id, elem_ord, x1 - vx AS ax, y1 - vy AS ay, x2 - vx AS bx, y2 - vy AS bq FROM near JOIN edges USING (elem_ord)),
    crossing AS (SELECT node_id, ray, elem_ord, (ax * (bq - ay) - ay * (bx - ax)) / (dx * (bq - ay) - dy * (bx - ax)) AS t FROM rel, rays WHERE (dx * ay - dy * ax >= 0) <> (dx * bq - dy * bx >= 0)),
    met AS (SELECT node_id, ray, elem_ord, count(*) AS crossings, count(*) FILTER (t > {length}) AS beyond FROM crossing WHERE t > 0 GROUP BY ALL),
    hit AS (SELECT * FROM (SELECT DISTINCT node_id, ray, elem_ord, t AS d, 1 AS o FROM crossing WHERE t > 1e-6 AND t <= {length}
            UNION ALL SELECT node_id, ray, elem_ord, {length}e0, 1 FROM met WHERE beyond % 2 = 1{virtual}){near}),
    seen AS (SELECT hit.*, type, weight, coalesce(product(transparent) OVER (PARTITION BY node_id, ray ORDER BY d, o, elem_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS through FROM hit JOIN elements USING (elem_ord))"""


def _exp(d: str, m: float, lam: float = S.DECAY_RATE) -> str:
    return f"CASE WHEN {d} <= 0 THEN 1e0 WHEN {d} >= {m} THEN 0e0 ELSE exp({d} * {-lam / m}e0) END"


_FEATURES = f"WITH {_hits(64, 30)}, feature AS (SELECT node_id, type, CAST(floor(ray / 4) AS INTEGER) AS sector, sum({_exp('d', 50.0)} * weight * through) AS value FROM seen WHERE through >= 1e-5 GROUP BY ALL)"
_VIEW = ("viewpoints", "elements", "edges")
_TYPES = ["water", "rock", "plant", "building"]
_CENTRE = "c AS (SELECT 'g' || (elem_ord % 8) AS garden_id, elem_ord, type, x, y, h, square FROM elements)"
_AREA = "abs(CASE WHEN square THEN 4e0 ELSE 2e0 END) * h * h"
# centres are means of the stored ring, whose first vertex comes twice
_MEAN_X = "x + CASE WHEN square THEN -h ELSE -h END / 5"
_MEAN_Y = "y + CASE WHEN square THEN -h ELSE 0 END / 5"
_MEANS = f"c AS (SELECT 'g' || (elem_ord % 8) AS garden_id, elem_ord, type, {_MEAN_X} AS x, {_MEAN_Y} AS y, {_AREA} AS area FROM elements)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _structure() -> str:
    parts = []
    for t in _TYPES:
        parts.append(f"""SELECT garden_id, count(*) FILTER (type = '{t}') AS {t}_count, {_r(f"ln(1 + coalesce(sum(area) FILTER (type = '{t}'), 0))", f"{t}_total_area")},
            {_r(f"ln(1 + coalesce(avg(area) FILTER (type = '{t}'), 0))", f"{t}_avg_area")}, {_r(f"coalesce(sum(area) FILTER (type = '{t}'), 0) / sum(area)", f"{t}_area_ratio")} FROM c GROUP BY 1""")
    nn = ", ".join(f"{_r(f'''coalesce(avg(nn) FILTER (type = '{t}'), 0)''', f'{t}_mean_nn_dist')}, {_r(f'''coalesce(stddev_pop(nn) FILTER (type = '{t}'), 0)''', f'{t}_std_nn_dist')}" for t in _TYPES)
    pairs = [(a, b) for i, a in enumerate(_TYPES) for b in _TYPES[i + 1 :]]
    wide = ", ".join(f"{_r(f'''coalesce(avg(d) FILTER (ta = '{a}' AND tb = '{b}'), 0)''', f'{a}_to_{b}_mean_dist')}, {_r(f'''coalesce(stddev_pop(d) FILTER (ta = '{a}' AND tb = '{b}'), 0)''', f'{a}_to_{b}_std_dist')}" for a, b in pairs)
    return f"""WITH {_MEANS}, {', '.join(f'p{k} AS ({p})' for k, p in enumerate(parts))},
    own AS (SELECT a.garden_id, a.type, a.elem_ord, min({_DIST}) AS nn FROM c a JOIN c b ON a.garden_id = b.garden_id AND a.type = b.type AND a.elem_ord <> b.elem_ord GROUP BY ALL),
    every AS (SELECT a.garden_id, a.elem_ord, min({_DIST}) AS nn FROM c a JOIN c b ON a.garden_id = b.garden_id AND a.elem_ord <> b.elem_ord GROUP BY ALL),
    pair AS (SELECT a.garden_id, a.type AS ta, b.type AS tb, {_DIST} AS d FROM c a JOIN c b ON a.garden_id = b.garden_id AND a.type <> b.type),
    x AS (SELECT garden_id, {nn} FROM own GROUP BY 1), y AS (SELECT garden_id, {_r('avg(nn)', 'all_elements_mean_nn_dist')}, {_r('stddev_pop(nn)', 'all_elements_std_nn_dist')} FROM every GROUP BY 1),
    z AS (SELECT garden_id, {wide} FROM pair GROUP BY 1)
    SELECT * FROM p0 JOIN p1 USING (garden_id) JOIN p2 USING (garden_id) JOIN p3 USING (garden_id) JOIN x USING (garden_id) JOIN y USING (garden_id) JOIN z USING (garden_id)"""


def _connected(ids: str, links: str, key: str = "id") -> str:
    """Components by the smallest id reachable; links: rows (a, b)."""
    return f"""WITH RECURSIVE ids AS ({ids}), pair AS ({links}), arc AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
    reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, arc.b FROM reach JOIN arc ON reach.b = arc.a)
    SELECT a AS {key}, min(b) AS cluster_id FROM reach GROUP BY a"""


def _density(eps: float, least: int) -> str:
    near = f"near AS (SELECT p.id AS a, q.id AS b FROM circles p JOIN circles q ON sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.radius - q.radius) * (p.radius - q.radius)) <= {eps})"
    return f"""WITH RECURSIVE {near}, core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {least}),
    arc AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, arc.b FROM reach JOIN arc ON reach.b = arc.a),
    inner_ AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a)
    SELECT * FROM inner_ UNION ALL SELECT near.a, min(cluster_id) FROM near JOIN inner_ ON near.b = inner_.id WHERE near.a NOT IN (SELECT id FROM core) GROUP BY 1"""


# squares and diamonds: the inner one's corners all lie in the outer one, none of their sides cross
_INSIDE = """inside AS (SELECT a.elem_ord AS inner_ord, b.elem_ord AS outer_ord FROM grown a JOIN grown b ON a.elem_ord <> b.elem_ord
    AND abs(a.x - b.x) <= b.h AND abs(a.y - b.y) <= b.h
    WHERE CASE WHEN b.square THEN abs(a.x - b.x) + a.h <= b.h + 1e-9 AND abs(a.y - b.y) + a.h <= b.h + 1e-9
               WHEN a.square THEN abs(a.x - b.x) + a.h + abs(a.y - b.y) + a.h <= b.h + 1e-9
               ELSE abs(a.x - b.x) + abs(a.y - b.y) + a.h <= b.h + 1e-9 END)"""

_HYBRID = """WITH t AS (SELECT node_id, v, list_sum(v) AS total FROM feat), q AS (SELECT quantile_cont(total, 0.95e0) AS q, max(total) AS top FROM t),
    m AS (SELECT node_id, list_transform(v, lambda x: x / (total + 1e-12)) AS p, greatest(0, least(1, total / (CASE WHEN q <= 0 THEN top + 1e-12 ELSE q END + 1e-12))) AS m FROM t, q),
    e AS (SELECT src, dst, 0.5e0 * (a.m + b.m) AS m, a.p AS pa, b.p AS pb FROM feat_edges LEFT JOIN m a ON a.node_id = src LEFT JOIN m b ON b.node_id = dst)"""

_FUN = """WITH sc AS (SELECT src, dst, (src * 31 + dst * 17) % 100 / 10e0 AS score, length FROM links),
    e AS (SELECT path_id, coalesce(score, 0) AS v, 1 / (coalesce(length, 1) + 1e-6) AS w FROM hops LEFT JOIN sc ON src = least(a, b) AND dst = greatest(a, b)),
    em AS (SELECT path_id, sum(w * v) / sum(w) AS edge_mean FROM e GROUP BY 1),
    es AS (SELECT path_id, any_value(edge_mean) AS edge_mean, sqrt(sum(w * (v - edge_mean) * (v - edge_mean)) / sum(w)) AS edge_std FROM e JOIN em USING (path_id) GROUP BY 1),
    nv AS (SELECT path_id, list_sum(v[1:16]) AS t1, list_sum(v[17:32]) AS t2, list_sum(v[33:48]) AS t3, list_sum(v[49:64]) AS t4 FROM paths JOIN feat f ON f.node_id = paths.node_id % 500),
    tv AS (SELECT path_id, sum(t1) AS t1, sum(t2) AS t2, sum(t3) AS t3, sum(t4) AS t4 FROM nv GROUP BY 1),
    pv AS (SELECT path_id, unnest([t1, t2, t3, t4]) / (t1 + t2 + t3 + t4 + 1e-8) AS p FROM tv),
    nd AS (SELECT path_id, -sum(p * ln(p + 1e-8)) AS node_div FROM pv GROUP BY 1)"""

_FOLDED = "f AS (SELECT path_id, pos, node_id % 40 AS node_id FROM paths), fh AS (SELECT * FROM (SELECT path_id, node_id AS a, lead(node_id) OVER (PARTITION BY path_id ORDER BY pos) AS b FROM f) WHERE b IS NOT NULL)"

# a block's area inside a square or diamond, by its width over each line of the block at which the outline bends
_GRID = """g AS (SELECT min(x - h) AS x0, max(x + h) AS x1, min(y - h) AS y0, max(y + h) AS y1 FROM elements),
    n AS (SELECT *, greatest(1, CAST(ceil((x1 - x0) / 15e0) AS INTEGER)) AS nx, greatest(1, CAST(ceil((y1 - y0) / 15e0) AS INTEGER)) AS ny FROM g),
    block AS (SELECT bj * nx + bx AS block_id, x0 + 7.5e0 + CASE WHEN nx > 1 THEN bx * (x1 - x0 - 15e0) / (nx - 1) ELSE 0 END - 7.5e0 AS bx0, y0 + 7.5e0 + CASE WHEN ny > 1 THEN bj * (y1 - y0 - 15e0) / (ny - 1) ELSE 0 END - 7.5e0 AS by0
              FROM n, unnest(range(nx)) t(bx), unnest(range(ny)) u(bj))"""
# the part of a diamond |X| + |Y| <= h left of a and below b is a sum of squared hinges
_VISIBLE = f"""WITH {_GRID}, met AS (SELECT block_id, transparent, square, h, bx0 - x AS l, bx0 + 15e0 - x AS r, by0 - y AS d, by0 + 15e0 - y AS u FROM block JOIN elements ON x - h <= bx0 + 15e0 AND x + h >= bx0 AND y - h <= by0 + 15e0 AND y + h >= by0),
    cut AS (SELECT *, row_number() OVER () AS k FROM met),
    knots AS (SELECT k, unnest([greatest(-h, l), least(h, r), 0e0, h - u, u - h, h + d, -h - d, h - d, d - h, h + u, -h - u]) AS t FROM cut),
    good AS (SELECT DISTINCT k, t FROM knots JOIN cut USING (k) WHERE t >= greatest(-h, l) AND t <= least(h, r)),
    run AS (SELECT k, t AS s, lead(t) OVER (PARTITION BY k ORDER BY t) AS e FROM good),
    piece AS (SELECT k, s, e, (s + e) / 2 AS m FROM run WHERE e > s),
    area AS (SELECT k, sum((e - s) * greatest(0, least(u, CASE WHEN square THEN h ELSE h - abs(m) END) - greatest(d, CASE WHEN square THEN -h ELSE abs(m) - h END))) AS area FROM piece JOIN cut USING (k) GROUP BY k),
    total AS (SELECT block_id, sum(area * transparent) AS s FROM area JOIN cut USING (k) GROUP BY 1)
    SELECT block_id, {_r("greatest(0, least(1, coalesce(s, 0) / 225e0))", "visibility")} FROM block LEFT JOIN total USING (block_id)"""

_OVERLAP = """CASE WHEN d >= r1 + r2 THEN 0e0 WHEN d <= abs(r1 - r2) THEN 1e0 ELSE
    (r1 * r1 * acos((d * d + r1 * r1 - r2 * r2) / (2 * d * r1)) + r2 * r2 * acos((d * d + r2 * r2 - r1 * r1) / (2 * d * r2)) - 0.5e0 * sqrt((-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))) / (pi() * least(r1, r2) * least(r1, r2)) END"""

_TRIANGLE = "t AS (SELECT p.src AS a, p.dst AS b, q.dst AS c, p.length AS ab, q.length AS ac, r.length AS bc FROM links p JOIN links q ON p.src = q.src AND p.dst < q.dst JOIN links r ON r.src = p.dst AND r.dst = q.dst)"


def _layer_case(of: str) -> str:
    return "CASE " + " ".join(f"WHEN layer = '{k}' THEN '{v}'" for k, v in S.LAYER_CATEGORY.items()) + f" ELSE '{S.UNKNOWN_CATEGORY}' END AS {of}"


_LAYERS = "[" + ", ".join(f"'{k}'" for k in [*S.LAYER_CATEGORY, "ARCHI", "0"]) + "]"
_CHORD = "SELECT elem_ord AS id, x AS px, y AS py FROM elements UNION ALL SELECT elem_ord, x + h, y FROM elements"

_ROUND = "SELECT id AS elem_ord, x, y, radius AS h, 'plant' AS type, 0.4e0 AS transparent, 0.65e0 AS weight FROM circles"
_PARK = " UNION ALL ".join(f"SELECT {a}e0 AS px0, {b}e0 AS py0, {c}e0 AS px1, {d}e0 AS py1" for a, b, c, d in PARK_BOXES)
# the area of each element inside each part (cx0, cy0, cx1, cy1) of a block, summed by block
_CLIPPED = """met AS (SELECT block_id, elem_ord, square, h, cx0 - x AS l, cx1 - x AS r, cy0 - y AS d, cy1 - y AS u FROM part JOIN elements ON cx1 > cx0 AND cy1 > cy0 AND x - h <= cx1 AND x + h >= cx0 AND y - h <= cy1 AND y + h >= cy0),
    cut AS (SELECT *, row_number() OVER () AS k FROM met),
    knots AS (SELECT k, unnest([greatest(-h, l), least(h, r), 0e0, h - u, u - h, h + d, -h - d, h - d, d - h, h + u, -h - u]) AS t FROM cut),
    good AS (SELECT DISTINCT k, t FROM knots JOIN cut USING (k) WHERE t >= greatest(-h, l) AND t <= least(h, r)),
    run AS (SELECT k, t AS s, lead(t) OVER (PARTITION BY k ORDER BY t) AS e FROM good),
    piece AS (SELECT k, s, e, (s + e) / 2 AS m FROM run WHERE e > s),
    area AS (SELECT block_id, elem_ord, sum((e - s) * greatest(0, least(u, CASE WHEN square THEN h ELSE h - abs(m) END) - greatest(d, CASE WHEN square THEN -h ELSE abs(m) - h END))) AS area FROM piece JOIN cut USING (k) GROUP BY 1, 2)"""


def _fitness() -> str:
    """The parts of a route's fitness, one after the other."""
    repeats = lambda key, rows: f"SELECT path_id, sum(0.03e0 * c * (c - 1) / 2) AS p, sum(c) AS n FROM (SELECT path_id, count(*) AS c FROM {rows} GROUP BY path_id, {key}) GROUP BY 1"
    return f"""{_FUN}, fun AS (SELECT path_id, (tanh((0.7e0 * edge_mean + 0.15e0 * edge_std + 0.15e0 * node_div) / 80) + 1) / 2 AS fun FROM es JOIN nd USING (path_id)),
    re AS ({repeats('least(a, b), greatest(a, b)', 'hops')}), rn AS ({repeats('node_id', 'paths')}), rc AS ({repeats('node_id % 25', 'paths')}),
    cl AS (SELECT i AS c, i * 13 % 17 / 10e0 AS score FROM range(25) t(i)), met AS (SELECT DISTINCT path_id, node_id % 25 AS c FROM paths),
    seen AS (SELECT path_id, sum(score) AS s, count(*) AS n FROM met JOIN cl USING (c) GROUP BY 1), mi AS (SELECT path_id, CASE WHEN n < 25 THEN ((SELECT sum(score) FROM cl) - s) / (25 - n) ELSE 0 END AS p FROM seen),
    w AS (SELECT path_id, x, y, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2 FROM (SELECT path_id, pos, x / 20 AS x, y / 20 AS y FROM paths JOIN nodes USING (node_id)) WINDOW o AS (PARTITION BY path_id ORDER BY pos)),
    d AS (SELECT path_id, sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) AS out_, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) AS back FROM w),
    lo AS (SELECT path_id, sum(CASE WHEN back < 8 AND out_ > 15 THEN 0.03e0 * (out_ - 14) ELSE 0 END) / greatest(count(*) - 2, 1) AS p FROM d GROUP BY 1),
    k AS (SELECT path_id, count(DISTINCT node_id) AS k FROM paths GROUP BY 1), a AS (SELECT count(*) AS n FROM nodes),
    f AS (SELECT path_id, 4 * coalesce(fun, 0) - 0.05e0 * (coalesce(re.p / re.n, 0) + rn.p / rn.n + 0.8e0 * rc.p + 2 * mi.p + 0.4e0 * lo.p + 0.4e0 * CASE WHEN k < floor(0.3e0 * a.n) THEN 0.03e0 * (floor(0.3e0 * a.n) - k) ELSE 0 END) + 6.5e0 * k / a.n AS f
          FROM k JOIN rn USING (path_id) JOIN rc USING (path_id) JOIN mi USING (path_id) JOIN lo USING (path_id) LEFT JOIN fun USING (path_id) LEFT JOIN re USING (path_id), a)
    SELECT path_id, {_r('CASE WHEN f > 0 THEN f ELSE 1e-6 END', 'fitness')} FROM f"""


def _openness() -> str:
    """The structure of the elements that meet each block of 30, and the visibility of one three times as wide, in the park."""
    grid = _GRID.replace("15e0", "30e0").replace("7.5e0", "15e0").replace("FROM elements", "FROM bound")
    structure = _structure().removeprefix("WITH ").split(", p0 AS", 1)[1].replace("SELECT * FROM p0 JOIN p1 USING (garden_id) JOIN p2 USING (garden_id) JOIN p3 USING (garden_id) JOIN x USING (garden_id) JOIN y USING (garden_id) JOIN z USING (garden_id)", "")
    pairs = [(a, b) for i, a in enumerate(_TYPES) for b in _TYPES[i + 1 :]]
    names = [f"{t}_{k}" for t in _TYPES for k in ("count", "total_area", "avg_area", "area_ratio", "mean_nn_dist", "std_nn_dist")] + [f"{a}_to_{b}_{k}" for a, b in pairs for k in ("mean_dist", "std_dist")] + ["all_elements_mean_nn_dist", "all_elements_std_nn_dist", "visibility"]
    wide = _CLIPPED
    for n in ("met", "cut", "knots", "good", "run", "piece", "area"):
        wide = wide.replace(f"{n} AS (", f"wide_{n} AS (").replace(f"FROM {n} ", f"FROM wide_{n} ").replace(f"FROM {n})", f"FROM wide_{n})").replace(f"JOIN {n} ", f"JOIN wide_{n} ")
    wide = wide.replace("FROM part ", "FROM wide_part ")
    return f"""WITH bound AS (SELECT 300e0 AS x, 450e0 AS y, 300e0 AS h UNION ALL SELECT 450, 450, 150 UNION ALL SELECT 300, 450, 300), {grid.replace('min(y - h) AS y0, max(y + h) AS y1', '0e0 AS y0, 900e0 AS y1')}, box AS ({_PARK}),
    part AS (SELECT block_id, bx0 AS cx0, by0 AS cy0, bx0 + 30e0 AS cx1, by0 + 30e0 AS cy1 FROM block WHERE EXISTS (SELECT 1 FROM box WHERE bx0 < px1 AND bx0 + 30e0 > px0 AND by0 < py1 AND by0 + 30e0 > py0)), {_CLIPPED},
    wide_part AS (SELECT block_id, greatest(bx0 - 30e0, px0) AS cx0, greatest(by0 - 30e0, py0) AS cy0, least(bx0 + 60e0, px1) AS cx1, least(by0 + 60e0, py1) AS cy1 FROM block, box), {wide},
    whole AS (SELECT block_id, sum((cx1 - cx0) * (cy1 - cy0)) AS a FROM wide_part WHERE cx1 > cx0 AND cy1 > cy0 GROUP BY 1), held AS (SELECT block_id, elem_ord FROM area WHERE area > 1e-9),
    seen AS (SELECT block_id, sum(wide_area.area * transparent) AS s FROM held JOIN wide_area USING (block_id, elem_ord) JOIN elements USING (elem_ord) GROUP BY 1),
    vis AS (SELECT CAST(block_id AS VARCHAR) AS garden_id, least(1, s / a) AS visibility FROM seen JOIN whole USING (block_id)),
    c AS (SELECT CAST(block_id AS VARCHAR) AS garden_id, elem_ord, type, {_MEAN_X} AS x, {_MEAN_Y} AS y, {_AREA} AS area FROM held JOIN elements USING (elem_ord)), p0 AS{structure}
    SELECT block_id, CAST(k AS INTEGER) AS k, round(coalesce([{', '.join(f'CAST(coalesce({n}, 0) AS DOUBLE)' for n in names)}][k + 1], 0), 6) + 0e0 AS value
    FROM (SELECT CAST(block_id AS VARCHAR) AS garden_id, block_id FROM block) LEFT JOIN p0 USING (garden_id) LEFT JOIN p1 USING (garden_id) LEFT JOIN p2 USING (garden_id) LEFT JOIN p3 USING (garden_id) LEFT JOIN x USING (garden_id) LEFT JOIN y USING (garden_id) LEFT JOIN z USING (garden_id) LEFT JOIN vis USING (garden_id), range(39) t(k)"""


def _distances(rounds: int) -> str:
    """So many rounds of relaxation, one after the other."""
    steps = ", ".join(f"r{k} AS (SELECT id, min(d) AS d FROM (SELECT id, d FROM r{k - 1} UNION ALL SELECT b, d + w FROM r{k - 1} JOIN arc ON a = id) GROUP BY 1)" for k in range(1, rounds + 1))
    return f"WITH arc AS (SELECT src AS a, dst AS b, length AS w FROM links UNION ALL SELECT dst, src, length FROM links), r0 AS (SELECT min(src) AS id, 0e0 AS d FROM links), {steps} SELECT id AS node_id, {_r('d', 'dist')} FROM r{rounds}"


def _walks(links: str, steps: int, seed: int, fresh: bool) -> str:
    pick = f"CAST(('0x' || substr(md5('{seed}/' || walker || '/' || pos), 1, 8)) AS BIGINT)"
    options = "CASE WHEN len(list_filter(near, lambda n: NOT list_contains(path, n))) > 0 THEN list_filter(near, lambda n: NOT list_contains(path, n)) ELSE near END" if fresh else "near"
    return f"""WITH RECURSIVE pair AS ({links}), arc AS (SELECT u AS a, v AS b FROM pair UNION SELECT v, u FROM pair), near AS (SELECT a, list(b ORDER BY b) AS near FROM arc GROUP BY 1),
    walk AS (SELECT a AS walker, 0 AS pos, [a] AS path FROM near UNION ALL SELECT walker, pos + 1, list_append(path, options[{pick} % len(options) + 1]) FROM (SELECT walker, pos, path, {options} AS options FROM walk JOIN near ON a = path[-1] WHERE pos < {steps}))
    SELECT walker, pos, path[-1] AS node_id FROM walk"""


ORACLES = {
    "sector_features": with_sql(f"{_FEATURES} SELECT node_id, type, sector, {_r('value', 'value')} FROM feature", *_VIEW),
    "edge_scores": with_sql(f"""{_FEATURES}, seeing AS (SELECT DISTINCT node_id FROM feature), pair AS (SELECT a.node_id AS src, b.node_id AS dst FROM seeing a JOIN seeing b ON b.node_id = a.node_id + 10),
        both_ AS (SELECT src, dst, type, sector, value AS va, 0e0 AS vb FROM pair JOIN feature ON node_id = src UNION ALL SELECT src, dst, type, sector, 0e0, value FROM pair JOIN feature ON node_id = dst),
        cell AS (SELECT src, dst, type, sector, sum(va) AS va, sum(vb) AS vb FROM both_ GROUP BY ALL), s AS (SELECT src, dst, 0.5e0 * sum(abs(va - vb)) + 0.5e0 * abs(sum(va) - sum(vb)) AS d FROM cell GROUP BY 1, 2)
        SELECT src, dst, {_r('CASE WHEN d = 0 THEN 1e-5 ELSE d END', 'score')} FROM s""", *_VIEW),
    "opacity_features": with_sql(f"""WITH hedge AS (SELECT * FROM edges WHERE elem_ord % 2 = 1 AND i < 2), rays AS (SELECT i AS ray, cos(2 * pi() * i / 40) AS dx, sin(2 * pi() * i / 40) AS dy FROM range(40) t(i)),
        rel AS (SELECT node_id, elem_ord, type, weight, transparent, x1 - vx AS ax, y1 - vy AS ay, x2 - vx AS bx, y2 - vy AS bq FROM viewpoints JOIN elements ON abs(vx - x) <= 50 + h AND abs(vy - y) <= 50 + h JOIN hedge USING (elem_ord)),
        hit AS (SELECT DISTINCT node_id, ray, elem_ord, type, weight, transparent, (ax * (bq - ay) - ay * (bx - ax)) / (dx * (bq - ay) - dy * (bx - ax)) AS d FROM rel, rays WHERE (dx * ay - dy * ax >= 0) <> (dx * bq - dy * bx >= 0)),
        seen AS (SELECT *, coalesce(product(transparent) OVER w, 1) AS through, coalesce(max(CASE WHEN transparent < 1e-5 THEN 1 ELSE 0 END) OVER w, 0) AS blocked FROM hit WHERE d > 0.5e0 AND d <= 50 WINDOW w AS (PARTITION BY node_id, ray ORDER BY d, elem_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT node_id, type, CAST(floor(ray / 5) AS INTEGER) AS sector, {_r('sum(exp(-d / 50e0) * weight * through)', 'value')} FROM seen WHERE blocked = 0 GROUP BY ALL""", *_VIEW),
    "circle_features": with_sql(f"""WITH elements AS ({_ROUND}), edges AS (SELECT elem_ord, x + h * cos(pi() * i / -64) AS x1, y + h * sin(pi() * i / -64) AS y1, x + h * cos(pi() * ((i + 1) % 128) / -64) AS x2, y + h * sin(pi() * ((i + 1) % 128) / -64) AS y2 FROM elements, range(128) t(i)), {_hits(64, 30)}
        SELECT node_id, type, CAST(floor(ray / 4) AS INTEGER) AS sector, {_r(f"sum({_exp('d', 50.0)} * weight * through)", 'value')} FROM seen WHERE through >= 1e-5 GROUP BY ALL""", "viewpoints", "circles"),
    "points_in_circles": with_sql("SELECT node_id, id AS elem_ord FROM viewpoints JOIN circles ON abs(vx - x) <= radius AND (vx - x) * (vx - x) + (vy - y) * (vy - y) <= radius * radius", "viewpoints", "circles"),
    "flat_features": with_sql(f"SELECT node_id, CAST(k AS INTEGER) AS k, {_r('list_concat(v[1:16], v[33:48], v[17:32], v[49:64])[k + 1]', 'value')} FROM feat, range(64) t(k)", "feat"),
    "route_fitness": with_sql(_fitness(), "paths", "hops", "links", "nodes", "feat"),
    "block_visibility_clipped": with_sql(f"""WITH {_GRID}, box AS ({_PARK}), part AS (SELECT block_id, greatest(bx0, px0) AS cx0, greatest(by0, py0) AS cy0, least(bx0 + 15e0, px1) AS cx1, least(by0 + 15e0, py1) AS cy1 FROM block, box),
        {_CLIPPED}, whole AS (SELECT block_id, sum((cx1 - cx0) * (cy1 - cy0)) AS a FROM part WHERE cx1 > cx0 AND cy1 > cy0 GROUP BY 1), total AS (SELECT block_id, sum(area * transparent) AS s FROM area JOIN elements USING (elem_ord) GROUP BY 1)
        SELECT block_id, {_r("greatest(0, least(1, coalesce(s / a, 0)))", "visibility")} FROM block LEFT JOIN whole USING (block_id) LEFT JOIN total USING (block_id)""", "elements"),
    "openness_features": with_sql(_openness(), "elements"),
    "openness_ranks": with_sql("""WITH c AS (SELECT CAST(node_id // 4 AS VARCHAR) AS garden_id, CAST(node_id % 4 AS INTEGER) AS cluster, list_sum(v) AS visibility FROM feat)
        SELECT garden_id, cluster, CASE WHEN row_number() OVER (PARTITION BY garden_id ORDER BY visibility, cluster) <= 2 THEN 'enclosed' ELSE 'open' END AS label FROM c""", "feat"),
    "convex_hulls": with_sql(f"""WITH {_CENTRE}, p AS (SELECT DISTINCT garden_id, x, y FROM c), side AS (SELECT a.garden_id, a.x, a.y, b.x AS to_x, b.y AS to_y FROM p a JOIN p b ON a.garden_id = b.garden_id AND (a.x <> b.x OR a.y <> b.y))
        SELECT * FROM side s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.garden_id = s.garden_id AND ((s.to_x - s.x) * (p.y - s.y) - (s.to_y - s.y) * (p.x - s.x) < 0
            OR (s.to_x - s.x) * (p.y - s.y) - (s.to_y - s.y) * (p.x - s.x) = 0 AND ((p.x - s.x) * (s.to_x - s.x) + (p.y - s.y) * (s.to_y - s.y) < 0 OR (p.x - s.to_x) * (s.x - s.to_x) + (p.y - s.to_y) * (s.y - s.to_y) < 0)))""", "elements"),
    "wall_polygons": with_sql(f"SELECT row_number() OVER (ORDER BY elem_ord % 2, elem_ord) - 1 AS id, CASE WHEN elem_ord % 2 = 1 THEN 0.6e0 ELSE 0e0 END AS transparent, {_r('1.6e0 * h', 'area')} FROM elements WHERE type = 'building'", "elements"),
    "shortest_paths": with_sql(_distances(24), "links"),
    "bridge_edges": with_sql("""WITH RECURSIVE arc AS (SELECT u AS a, v AS b FROM sparse UNION ALL SELECT v, u FROM sparse),
        reach AS (SELECT u, v, u AS n FROM sparse UNION SELECT reach.u, reach.v, arc.b FROM reach JOIN arc ON arc.a = n WHERE NOT (least(arc.a, arc.b) = reach.u AND greatest(arc.a, arc.b) = reach.v) AND abs(arc.b - reach.u) <= 8)
        SELECT u, v, count(*) FILTER (n = v) = 0 AS bridge FROM reach GROUP BY 1, 2""", "sparse"),
    "random_walks": with_sql(_walks("SELECT src AS u, dst AS v FROM links", 10, 3, False), "links"),
    "fresh_walks": with_sql(_walks("SELECT u, v FROM sparse", 8, 5, True), "sparse"),
    "drawing_entities": with_sql(f"""WITH e AS (SELECT *, {_LAYERS}[elem_ord % {len(S.LAYER_CATEGORY) + 2} + 1] AS layer FROM plan), c AS (SELECT *, {_layer_case('category')} FROM e)
        SELECT file, row_number() OVER (ORDER BY file, kind <> 'CIRCLE', elem_ord) - 1 AS entity_ord, kind, layer, category, category IN ('water', 'hollow wall') AS visibility, color_index, true_color, closed, n_points,
            {_r("CASE n_points WHEN 2 THEN x + h WHEN 3 THEN x + h WHEN 4 THEN x + 3 * h END", 'last_x')}, {_r("CASE n_points WHEN 2 THEN y WHEN 3 THEN y + h WHEN 4 THEN y + h END", 'last_y')},
            {_r("CASE WHEN n_points = 0 THEN x END", 'cx')}, {_r("CASE WHEN n_points = 0 THEN y END", 'cy')}, {_r("CASE WHEN n_points = 0 THEN h END", 'radius')} FROM c""", "plan"),
    "drawing_segments": with_sql(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY file, kind <> 'CIRCLE', elem_ord) - 1 AS entity_ord FROM plan), px AS (SELECT entity_ord, x, y, h, n_points, CAST(pos AS INTEGER) AS pos, CASE WHEN n_points = 4 THEN [0, 1, 2, 3] ELSE [0, 1, 1] END AS dx, CASE WHEN n_points = 4 THEN [0, 1, 0, 1] ELSE [0, 0, 1] END AS dy FROM o, range(3) t(pos) WHERE pos < n_points - 1)
        SELECT entity_ord, pos, {_r('x + h * dx[pos + 1]', 'x0')}, {_r('y + h * dy[pos + 1]', 'y0')}, {_r('x + h * dx[pos + 2]', 'x1')}, {_r('y + h * dy[pos + 2]', 'y1')} FROM px""", "plan"),
    "drawing_profile": with_sql(f"SELECT file, kind, count(*) AS n, count(DISTINCT {_LAYERS}[elem_ord % {len(S.LAYER_CATEGORY) + 2} + 1]) AS n_layers, count(DISTINCT coalesce(nullif(true_color, 0), color_index)) AS n_colors, count(*) FILTER (closed) AS n_closed FROM plan GROUP BY 1, 2", "plan"),
    "path_graph": with_sql(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY file, kind <> 'CIRCLE', elem_ord) - 1 AS entity_ord FROM plan),
        pt AS (SELECT entity_ord, pos, x + h * CASE WHEN n_points < 4 THEN [0, 1, 1, 0][pos + 1] ELSE 3 * t END AS px, y + h * CASE WHEN n_points < 4 THEN [0, 0, 1, 0][pos + 1] ELSE 3 * (1 - t) * (1 - t) * t + t * t * t END AS py
               FROM (SELECT *, pos / 50e0 AS t FROM o, range(52) r(pos) WHERE pos < CASE WHEN n_points = 4 THEN 51 ELSE n_points END + CASE WHEN closed THEN 1 ELSE 0 END)),
        wrap AS (SELECT entity_ord, pos, CASE WHEN closed AND pos = 51 THEN x ELSE px END AS px, CASE WHEN closed AND pos = 51 THEN y ELSE py END AS py FROM pt JOIN (SELECT entity_ord, closed AND n_points = 4 AS closed, x, y FROM o) USING (entity_ord)),
        snap AS (SELECT entity_ord, CAST(pos AS INTEGER) AS pos, round_even(px / 0.0137e0, 0) * 0.0137e0 AS sx, round_even(py / 0.0137e0, 0) * 0.0137e0 AS sy FROM wrap),
        first AS (SELECT sx, sy, min(entity_ord * 100 + pos) AS f FROM snap GROUP BY 1, 2), node AS (SELECT sx, sy, row_number() OVER (ORDER BY f) - 1 AS id FROM first), n AS (SELECT * FROM snap JOIN node USING (sx, sy))
        SELECT a.entity_ord, a.pos, a.id AS src, b.id AS dst, {_r('a.sx', 'x')}, {_r('a.sy', 'y')} FROM n a JOIN n b ON a.entity_ord = b.entity_ord AND b.pos = a.pos + 1""", "plan"),
    "workbook_graph": with_sql(f"""SELECT node_id AS a, CAST(NULL AS BIGINT) AS b, {_r('x + 10.5e0', 'p')}, {_r('y - 3.25e0', 'q')}, CAST(NULL AS DOUBLE) AS length FROM nodes
        UNION ALL SELECT u, v, {_r("CASE WHEN v % 2 = 0 THEN u / 2e0 + 10.5e0 END", 'p')}, {_r("CASE WHEN v % 2 = 0 THEN v - 3.25e0 END", 'q')}, {_r('u / 4e0 + 1', 'length')} FROM sparse""", "nodes", "sparse"),
    "saved_route": with_sql("SELECT DISTINCT least(node_id, n) AS u, greatest(node_id, n) AS v FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY node_id % 8 ORDER BY x, y, node_id) AS n FROM nodes) WHERE n IS NOT NULL", "nodes"),
    "saved_route_table": with_sql("SELECT node_id + 1 AS pos, node_id, x, y FROM nodes", "nodes"),
    "water_elements": with_sql(f"""WITH {_INSIDE}, pool AS (SELECT * FROM grown WHERE type <> 'rock'), held AS (SELECT inner_ord, min(outer_ord) AS outer_ord FROM inside WHERE inner_ord IN (SELECT elem_ord FROM pool) AND outer_ord IN (SELECT elem_ord FROM pool) GROUP BY 1),
        holes AS (SELECT outer_ord, count(*) AS n FROM held GROUP BY 1)
        SELECT row_number() OVER (ORDER BY elem_ord) - 1 AS id, CAST(coalesce(n, 0) AS INTEGER) AS n_holes, 1e0 AS transparent, 1.5e0 AS weight, {_r('x - h', 'x')}, {_r('CASE WHEN square THEN y - h ELSE y END', 'y')}, {_r('CASE WHEN square THEN 4 ELSE 2 END * h * h', 'area')}
        FROM pool LEFT JOIN holes ON outer_ord = elem_ord WHERE elem_ord NOT IN (SELECT inner_ord FROM held)""", "grown"),
    "plant_elements": with_sql("SELECT row_number() OVER (ORDER BY id) - 1 AS id, 'plant' AS type, 'Circle' AS gtype, x AS cx, y AS cy, radius, 0.4e0 AS transparent, 0.65e0 AS weight FROM circles WHERE id % 3 <> 0", "circles"),
    "sampled_features": with_sql(f"""WITH rays AS (SELECT i AS ray, cos(2 * pi() * i / 40) AS dx, sin(2 * pi() * i / 40) AS dy FROM range(40) t(i)), steps AS (SELECT i AS step, i * 2e0 AS d FROM range(1, 26) t(i)),
        near AS (SELECT node_id, vx, vy, elem_ord, type, transparent, weight, x, y, h, square FROM viewpoints, elements WHERE abs(vx - x) <= 50 + h AND abs(vy - y) <= 50 + h),
        held AS (SELECT node_id, ray, step, d, elem_ord, type, transparent, weight FROM near, rays, steps WHERE CASE WHEN square THEN greatest(abs(vx + d * dx - x), abs(vy + d * dy - y)) < h ELSE abs(vx + d * dx - x) + abs(vy + d * dy - y) < h END),
        seen AS (SELECT *, coalesce(product(transparent) OVER (PARTITION BY node_id, ray ORDER BY step, elem_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS through,
            coalesce(max(CASE WHEN transparent < 1e-5 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id, ray ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blocked FROM held)
        SELECT node_id, type, CAST(floor(ray / 5) AS INTEGER) AS sector, {_r('sum(greatest(0, 1 - d / 50e0) * weight * through)', 'value')} FROM seen WHERE blocked = 0 GROUP BY ALL""", *_VIEW),
    "points_in_elements": with_sql("SELECT node_id, elem_ord, type FROM viewpoints, elements WHERE CASE WHEN square THEN greatest(abs(vx - x), abs(vy - y)) < h ELSE abs(vx - x) + abs(vy - y) < h END", *_VIEW),
    "elem_edges": with_sql("SELECT elem_ord, i AS seq, round(x1, 6) + 0e0 AS x1, round(y1, 6) + 0e0 AS y1, round(x2, 6) + 0e0 AS x2, round(y2, 6) + 0e0 AS y2 FROM edges", "edges"),
    "edge_scores_embeddings": with_sql(f"""WITH d AS (SELECT src, dst, 0.5e0 * list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) + 0.5e0 * abs(list_sum(a.v) - list_sum(b.v)) AS d FROM feat_edges JOIN feat a ON a.node_id = src JOIN feat b ON b.node_id = dst)
        SELECT src, dst, {_r('CASE WHEN d = 0 THEN 1e-5 ELSE d END', 'score')} FROM d""", "feat", "feat_edges"),
    "hybrid_scores_l2": with_sql(f"{_HYBRID} SELECT src, dst, {_r('coalesce(sqrt(list_sum(list_transform(list_zip(pa, pb), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) * (1 + m), 0)', 'score')} FROM e", "feat", "feat_edges"),
    "hybrid_scores_beta": with_sql(f"{_HYBRID} SELECT src, dst, {_r('coalesce(0.6e0 * list_sum(list_transform(list_zip(pa, pb), lambda p: abs(p[1] - p[2]))) + 0.4e0 * m, 0)', 'score')} FROM e", "feat", "feat_edges"),
    "feature_totals": with_sql(f"SELECT node_id, {_r('list_sum(v)', 'total')} FROM feat", "feat"),
    "pattern_normalize": with_sql(f"SELECT node_id, k, {_r('v[k + 1] / (list_sum(v) + 1e-12)', 'p')} FROM feat, unnest(range(64)) t(k)", "feat"),
    "quantile_clip": with_sql(f"WITH t AS (SELECT node_id, list_sum(v) AS total FROM feat), q AS (SELECT quantile_cont(total, 0.95e0) AS q FROM t) SELECT node_id, {_r('greatest(0, least(1, total / (q + 1e-12)))', 'magnitude')} FROM t, q", "feat"),
    "decay_table": f"SELECT d, {_r(_exp('d', 30.0), 'exponential')}, {_r('greatest(0, 1 - d / 30e0)', 'linear')}, {_r('exp(-0.1e0 * d)', 'plain')}, {_r('exp(-d / 50e0)', 'of_range')} FROM (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS d FROM lineitem)",
    "direction_labels": """WITH d AS (SELECT ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'] AS l)
        SELECT n_nationkey AS k, l[n_nationkey % 8 + 1] AS of_8, l[CAST(floor((n_nationkey % 12 * 30 + 22.5e0) / 45) AS INTEGER) % 8 + 1] AS of_12,
               CASE WHEN n_nationkey % 2 = 0 THEN l[n_nationkey % 16 // 2 + 1] ELSE l[n_nationkey % 16 // 2 + 1] || l[(n_nationkey % 16 // 2 + 1) % 8 + 1] END AS of_16 FROM nation, d""",
    "structural_features": with_sql(_structure(), "elements"),
    "pair_distances": with_sql(f"WITH {_MEANS}, o AS (SELECT *, list_position(['water', 'rock', 'plant', 'building'], type) AS p FROM c) SELECT a.garden_id, a.type AS type_a, b.type AS type_b, {_r(f'avg({_DIST})', 'mean_dist')}, {_r(f'stddev_pop({_DIST})', 'std_dist')} FROM o a JOIN o b ON a.garden_id = b.garden_id AND a.p < b.p GROUP BY 1, 2, 3", "elements"),
    "nearest_neighbor": with_sql(f"WITH {_MEANS} SELECT a.garden_id, a.type, a.elem_ord, {_r(f'min({_DIST})', 'nn')} FROM c a JOIN c b ON a.garden_id = b.garden_id AND a.type = b.type AND a.elem_ord <> b.elem_ord GROUP BY 1, 2, 3", "elements"),
    "element_centres": with_sql(f"WITH {_MEANS} SELECT elem_ord, {_r('area', 'area')}, {_r('x', 'x')}, {_r('y', 'y')} FROM c", "elements"),
    "garden_score": with_sql(f"""WITH b AS (SELECT 'g' || (node_id % 4) AS garden_id, node_id, v, node_id * 7 % 11 % 3 AS label FROM feat), l AS (SELECT garden_id, node_id, k, v[k + 1] AS x FROM b, unnest(range(64)) t(k)),
        u AS (SELECT garden_id, node_id, (x - min(x) OVER w) / CASE WHEN max(x) OVER w = min(x) OVER w THEN 1 ELSE max(x) OVER w - min(x) OVER w END AS u FROM l WINDOW w AS (PARTITION BY garden_id, k)),
        r AS (SELECT garden_id, avg(v) AS rich FROM (SELECT garden_id, node_id, var_pop(u) AS v FROM u GROUP BY 1, 2) GROUP BY 1),
        c AS (SELECT garden_id, count(*) FILTER (label = 0) AS o, count(*) FILTER (label = 1) AS e FROM b GROUP BY 1),
        h AS (SELECT garden_id, CASE WHEN o + e < 2 THEN 0e0 ELSE CASE WHEN o > 0 THEN -(o / (o + e)) * ln(o / (o + e)) ELSE 0 END + CASE WHEN e > 0 THEN -(e / (o + e)) * ln(e / (o + e)) ELSE 0 END END AS h FROM c)
        SELECT garden_id, {_r('rich', 'feature_richness')}, {_r('h', 'openness_entropy')}, {_r('100 * (0.5e0 * rich + 0.5e0 * h / ln(2e0))', 'score')} FROM r JOIN h USING (garden_id)""", "feat"),
    "route_edges": with_sql("SELECT path_id, pos, a AS src, b AS dst FROM hops", "hops"),
    "route_edge_set": with_sql("SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM hops WHERE a <> b", "hops"),
    "route_fun_score": with_sql(f"{_FUN}, whole AS (SELECT path_id, coalesce(edge_mean, 'NaN'::DOUBLE) AS edge_mean, coalesce(edge_std, 'NaN'::DOUBLE) AS edge_std, node_div FROM nd LEFT JOIN es USING (path_id)) SELECT path_id, {_r('edge_mean', 'edge_mean')}, {_r('edge_std', 'edge_std')}, {_r('node_div', 'node_div')}, {_r('(tanh((0.7e0 * edge_mean + 0.15e0 * edge_std + 0.15e0 * node_div) / 80) + 1) / 2', 'fun_score')} FROM whole", "paths", "hops", "links", "feat"),
    "route_edge_repeats": with_sql(f"WITH {_FOLDED}, k AS (SELECT path_id, count(*) AS c FROM fh GROUP BY path_id, least(a, b), greatest(a, b)) SELECT path_id, {_r('sum(0.02e0 * c * (c - 1) / 2) / sum(c)', 'penalty')} FROM k GROUP BY 1", "paths"),
    "route_node_repeats": with_sql(f"WITH {_FOLDED}, k AS (SELECT path_id, count(*) AS c FROM f GROUP BY path_id, node_id) SELECT path_id, {_r('sum(0.02e0 * c * (c - 1) / 2) / sum(c)', 'penalty')} FROM k GROUP BY 1", "paths"),
    "route_loop_penalty": with_sql(f"""WITH p AS (SELECT path_id, pos, x / 20 AS x, y / 20 AS y FROM paths JOIN nodes USING (node_id)),
        w AS (SELECT path_id, x, y, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2 FROM p WINDOW o AS (PARTITION BY path_id ORDER BY pos)),
        d AS (SELECT path_id, sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) AS out_, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) AS back FROM w)
        SELECT path_id, {_r('sum(CASE WHEN back < 8 AND out_ > 15 THEN 0.02e0 * (out_ - 14) ELSE 0 END) / greatest(count(*) - 2, 1)', 'penalty')} FROM d GROUP BY 1""", "paths", "nodes"),
    "route_coverage": with_sql(f"SELECT path_id, {_r('count(DISTINCT node_id) / (SELECT count(*) FROM nodes)', 'coverage')} FROM paths GROUP BY 1", "paths", "nodes"),
    "missing_clusters": with_sql(f"""WITH s AS (SELECT i AS c, i * 13 % 17 / 10e0 AS score FROM range(25) t(i)), r AS (SELECT DISTINCT path_id FROM paths), seen AS (SELECT DISTINCT path_id, node_id % 25 AS c FROM paths)
        SELECT r.path_id, {_r('coalesce(avg(score) FILTER (seen.c IS NULL), 0)', 'penalty')} FROM r CROSS JOIN s LEFT JOIN seen ON seen.path_id = r.path_id AND seen.c = s.c GROUP BY 1""", "paths"),
    "jaccard_pairs": with_sql(f"WITH s AS (SELECT path_id, list(DISTINCT node_id) AS n FROM paths GROUP BY 1) SELECT a.path_id, {_r('len(list_intersect(a.n, b.n)) / len(list_distinct(list_concat(a.n, b.n)))', 'jaccard')} FROM s a JOIN s b ON b.path_id = a.path_id + 1", "paths"),
    "min_overlap_pair": with_sql("""WITH s AS (SELECT path_id, list(DISTINCT node_id) AS n FROM paths GROUP BY 1), o AS (SELECT o_custkey AS owner, path_id, n FROM orders JOIN s ON path_id = o_orderkey),
        p AS (SELECT a.owner, a.path_id AS a, b.path_id AS b, len(list_intersect(a.n, b.n)) AS shared, round(len(list_intersect(a.n, b.n)) / len(list_distinct(list_concat(a.n, b.n))), 6) + 0e0 AS jaccard FROM o a JOIN o b ON a.owner = b.owner AND a.path_id < b.path_id)
        SELECT owner, a, b, CAST(shared AS INTEGER) AS shared, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY shared, jaccard, a, b) AS k FROM p) WHERE k = 1""", "paths"),
    "cluster_linkage": with_sql(_connected("SELECT elem_ord AS id FROM elements", f"SELECT p.id AS a, q.id AS b FROM ({_CHORD}) p JOIN ({_CHORD}) q ON p.id < q.id AND sqrt((p.px - q.px) * (p.px - q.px) + (p.py - q.py) * (p.py - q.py)) <= 8"), "elements"),
    "cluster_circles": with_sql(_connected("SELECT id FROM circles", f"SELECT a, b FROM (SELECT p.id AS a, q.id AS b, p.radius AS r1, q.radius AS r2, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM circles p JOIN circles q ON p.id < q.id AND abs(p.x - q.x) <= 12 AND abs(p.y - q.y) <= 12) WHERE d <= 12 OR {_OVERLAP} >= 0.5e0"), "circles"),
    "cluster_hierarchical": with_sql(_connected("SELECT id FROM circles", "SELECT p.id AS a, q.id AS b FROM circles p JOIN circles q ON p.id < q.id AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.radius - q.radius) * (p.radius - q.radius)) <= 12"), "circles"),
    "cluster_density": with_sql(_density(14, 2), "circles"),
    "cluster_density_core": with_sql(_density(30, 5), "circles"),
    "cluster_nodes": with_sql(_connected("SELECT node_id AS id FROM nodes", "SELECT p.node_id AS a, q.node_id AS b FROM nodes p JOIN nodes q ON p.node_id < q.node_id AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 12", "node_id"), "nodes"),
    "circle_overlap": with_sql(f"SELECT id, {_r(_OVERLAP, 'overlap')} FROM (SELECT p.id, p.radius * 100 AS r1, q.radius * 100 AS r2, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM circles p JOIN circles q ON q.id = p.id + 2)", "circles"),
    "contained_elements": with_sql(f"WITH {_INSIDE} SELECT * FROM inside", "grown"),
    "water_nesting": with_sql(f"WITH {_INSIDE}, pool AS (SELECT elem_ord FROM grown WHERE type <> 'rock') SELECT inner_ord, min(outer_ord) AS first_outer, count(*) AS n_outer FROM inside WHERE inner_ord IN (SELECT * FROM pool) AND outer_ord IN (SELECT * FROM pool) GROUP BY 1", "grown"),
    "rocks_with_buildings": with_sql(f"WITH {_INSIDE} SELECT elem_ord, CASE WHEN EXISTS (SELECT 1 FROM inside JOIN grown i ON i.elem_ord = inner_ord WHERE outer_ord = e.elem_ord AND i.type = 'building') THEN 1e0 ELSE 0e0 END AS transparent FROM grown e WHERE type <> 'building'", "grown"),
    "bounds": with_sql(f"WITH {_CENTRE} SELECT garden_id, {_r('min(x - h)', 'min_x')}, {_r('min(y - h)', 'min_y')}, {_r('max(x + h)', 'max_x')}, {_r('max(y + h)', 'max_y')} FROM c GROUP BY 1", "elements"),
    "grid_centers": with_sql(f"WITH {_CENTRE}, b AS (SELECT garden_id, min(x - h) AS x0, max(x + h) AS x1, min(y - h) AS y0, max(y + h) AS y1 FROM c GROUP BY 1) SELECT garden_id, i, j, {_r('x0 + (i + 0.5e0) * (x1 - x0) / 10', 'x')}, {_r('y0 + (j + 0.5e0) * (y1 - y0) / 10', 'y')} FROM b, unnest(range(10)) t(i), unnest(range(10)) u(j)", "elements"),
    "block_grid": with_sql(f"""WITH {_CENTRE}, b AS (SELECT garden_id, min(x - h) AS x0, max(x + h) AS x1, min(y - h) AS y0, max(y + h) AS y1 FROM c GROUP BY 1), n AS (SELECT *, CAST(ceil((x1 - x0) / 15e0) AS INTEGER) AS nx, CAST(ceil((y1 - y0) / 15e0) AS INTEGER) AS ny FROM b)
        SELECT garden_id, bj * nx + bx AS block_id, round(x0 + 7.5e0 + bx * (x1 - x0 - 15e0) / (nx - 1), 9) AS cx, round(y0 + 7.5e0 + bj * (y1 - y0 - 15e0) / (ny - 1), 9) AS cy FROM n, unnest(range(nx)) t(bx), unnest(range(ny)) u(bj)""", "elements"),
    "block_visibility": with_sql(_VISIBLE, "elements"),
    "adaptive_k": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 6 ELSE CAST(floor(least(8e0, greatest(5e0, 5 + (p_size / 8e0 - 0.5e0) / 4.5e0 * 3))) AS INTEGER) END AS k FROM part",
    "shoelace_open": with_sql(f"""WITH n AS (SELECT v.elem_ord, sum(CASE WHEN v.i < 3 THEN v.vx * w.vy - w.vx * v.vy END) AS o, sum(v.vx * w.vy - w.vx * v.vy) AS t FROM vertices v JOIN vertices w ON v.elem_ord = w.elem_ord AND w.i = (v.i + 1) % 4 GROUP BY 1)
        SELECT elem_ord, {_r('abs(o) / 2', 'open_area')}, {_r('abs(t) / 2', 'true_area')} FROM n""", "vertices"),
    "circumradius": with_sql(f"""WITH p AS (SELECT elem_ord, max(vx) FILTER (i = 0) AS ax, max(vy) FILTER (i = 0) AS ay, max(vx) FILTER (i = 1) / 2 AS bx, max(vy) FILTER (i = 1) AS bq, max(vx) FILTER (i = 2) / 3 AS cx, max(vy) FILTER (i = 2) AS cy FROM vertices GROUP BY 1),
        s AS (SELECT elem_ord, sqrt((bx - cx) * (bx - cx) + (bq - cy) * (bq - cy)) AS a, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS b, sqrt((ax - bx) * (ax - bx) + (ay - bq) * (ay - bq)) AS c, abs((bx - ax) * (cy - ay) - (bq - ay) * (cx - ax)) / 2 AS area FROM p)
        SELECT elem_ord, round(CASE WHEN 1e4 * 4 * area <= a * b * c THEN 1e4 ELSE a * b * c / (4 * area) END, 2) AS radius FROM s""", "vertices"),
    "nearest_node": with_sql("""WITH p AS (SELECT n_nationkey AS point_id, n_nationkey * 31 % 97 * 10 + 0.37e0 AS px, n_nationkey * 57 % 89 * 10 + 0.11e0 AS py FROM nation)
        SELECT point_id, node_id FROM (SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), node_id) AS k FROM p, nodes) WHERE k = 1""", "nodes"),
    "triangles": with_sql(f"WITH {_TRIANGLE} SELECT a, b, c FROM t", "links"),
    "longest_sides": with_sql(f"WITH {_TRIANGLE} SELECT a, b, c, CASE WHEN ab >= bc AND ab >= ac THEN a WHEN bc >= ac THEN b ELSE a END AS u, CASE WHEN ab >= bc AND ab >= ac THEN b ELSE c END AS v FROM t", "links"),
    "critical_edges": with_sql(f"WITH s AS (SELECT src, dst, (src * 31 + dst * 17) % 100 / 10e0 AS score FROM links), q AS (SELECT quantile_cont(score, 0.9e0) AS q FROM s) SELECT src, dst, {_r('score', 'score')} FROM s, q WHERE score >= q", "links"),
    "snap_points": with_sql(f"""WITH s AS (SELECT elem_ord AS point_ord, round_even((x + 0.3e0) / 8, 0) * 8 AS x, round_even(y / 8, 0) * 8 AS y FROM elements), f AS (SELECT x, y, min(point_ord) AS first FROM s GROUP BY 1, 2), n AS (SELECT x, y, row_number() OVER (ORDER BY first) - 1 AS node_id FROM f)
        SELECT point_ord, node_id, {_r('x', 'x')}, {_r('y', 'y')} FROM s JOIN n USING (x, y)""", "elements"),
    "entity_profile": with_sql("SELECT file, kind, count(*) AS n, count(DISTINCT layer) AS n_layers, count(DISTINCT coalesce(nullif(true_color, 0), color_index)) AS n_colors, count(*) FILTER (closed) AS n_closed FROM entities GROUP BY 1, 2", "entities"),
    "layer_classify": f"""WITH e AS (SELECT event_id, {_LAYERS}[event_id % {len(S.LAYER_CATEGORY) + 2} + 1] AS layer FROM events), c AS (SELECT event_id, layer, {_layer_case('category')} FROM e)
        SELECT *, category IN ('water', 'hollow wall') AS visibility FROM c""",
    "boundary_first": with_sql(f"""SELECT file, n_points AS n, {_r('x', 'first_x')}, {_r('y', 'first_y')}, {_r('x + h', 'last_x')}, {_r('y + h', 'last_y')} FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY elem_ord) AS k FROM plan WHERE closed AND kind IN ('LWPOLYLINE', 'POLYLINE')) WHERE k = 1""", "plan"),
    "garden_names": "SELECT p_partkey, p_type AS name FROM part",
}
