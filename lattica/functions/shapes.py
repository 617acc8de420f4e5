"""Relations of lines and rings and the shapes made of them, as Column expressions over arrays of (x, y).

A ring is a closed line without self-crossings. Where a line or a ring runs in
relation to a ring is told by its pieces: each step is cut where it meets the
ring, and the middle of a piece is inside, on the edge or outside. A point
within ``NEAR`` of an edge, as a share of the step's size, is on it. A null
shape gives nulls. The work is the product of both shapes' points, in one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import distance, is_closed, line_length, n_points, point, point_segment_distance, ring_contains

#: Share of a step's size within which a point lies on it.
NEAR = 1e-12


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def steps(points: Column) -> Column:
    """Structs (a, b) of following points; none for fewer than two."""
    def zipped(p):
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return _let(points, zipped)


def _named(**parts: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def _last(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def turn(a: Column, b: Column, c: Column) -> Column:
    """Positive for a left turn at b, negative for a right one, 0 for points in line."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


# ---- constructors and accessors ----------------------------------------------------

def make_polygon(shell: Column, *holes: Column) -> Column:
    """Array of rings, the shell first."""
    return F.array(shell, *holes)


def n_rings(polygon: Column) -> Column:
    return F.size(polygon).cast("long")


def is_empty(points: Column) -> Column:
    return F.size(points) == 0


def dimension(kind: Column) -> Column:
    """Dimension of a geometry type's name, null for a collection."""
    return F.when(kind.endswith("POINT"), 0).when(kind.endswith("LINESTRING"), 1).when(kind.endswith("POLYGON"), 2)


def _steps_meet(s: Column, t: Column) -> Column:
    """Two steps share a point."""
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    within = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    on = lambda p, q, r: (turn(p, q, r) == 0) & within(p, q, r)
    apart = (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) < 0) & (F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) < 0)
    return apart | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def lines_intersect(a: Column, b: Column) -> Column:
    return F.exists(steps(a), lambda s: F.exists(steps(b), lambda t: _steps_meet(s, t)))


def is_simple(points: Column) -> Column:
    """No two steps share a point but neighbours their common one, and a closed line its ends."""
    s = steps(points)
    last = F.size(s) - 1
    numbered = F.transform(s, lambda v, i: F.struct(v.alias("s"), i.alias("i")))

    def clash(u, v):
        beside = v["i"] == u["i"] + 1
        # neighbours may only fold back; the first and last step of a closed line are neighbours too
        fold = lambda p, q, r: (turn(p, q, r) == 0) & ((p["x"] - q["x"]) * (r["x"] - q["x"]) + (p["y"] - q["y"]) * (r["y"] - q["y"]) > 0)
        ends = is_closed(points) & (u["i"] == 0) & (v["i"] == last) & (last > 1)
        return F.when(beside, fold(u["s"]["a"], u["s"]["b"], v["s"]["b"])).when(ends, fold(v["s"]["a"], v["s"]["b"], u["s"]["b"])).otherwise(_steps_meet(u["s"], v["s"]))

    return ~F.exists(numbered, lambda u: F.exists(numbered, lambda v: (v["i"] > u["i"]) & clash(u, v)))


def is_ring(points: Column) -> Column:
    return is_closed(points) & is_simple(points)


def is_valid_ring(points: Column) -> Column:
    """A ring of four points or more, the first repeated as the last."""
    return (n_points(points) >= 4) & is_ring(points)


# ---- relations to a ring -------------------------------------------------------------

def place(ring: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on the edge, -1 outside."""
    def on(s):
        size = F.abs(s["a"]["x"]) + F.abs(s["a"]["y"]) + F.abs(s["b"]["x"]) + F.abs(s["b"]["y"])
        return point_segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) <= size * NEAR

    return F.when(F.exists(steps(ring), on), 0).when(ring_contains(ring, x, y), 1).otherwise(-1)


def _cuts(s: Column, ring: Column) -> Column:
    """Shares of a step at which it meets the ring's steps, with 0 and 1, sorted."""
    a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]

    def meets(t):
        c, ex, ey = t["a"], t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
        cross = dx * ey - dy * ex
        u = ((c["x"] - a["x"]) * ey - (c["y"] - a["y"]) * ex) / F.nullif(cross, F.lit(0.0))
        along = lambda p: ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        return F.when(cross != 0, F.array(u)).otherwise(F.array(along(t["a"]), along(t["b"])))

    found = F.filter(F.flatten(F.transform(steps(ring), meets)), lambda u: (u > 0) & (u < 1))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found)))


def pieces(points: Column, ring: Column) -> Column:
    """Structs (place, length) of the pieces into which the ring cuts the line."""
    def cut(s):
        at = lambda u: point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * u, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * u)
        return steps(F.transform(_cuts(s, ring), at))

    middle = lambda p, k: (p["a"][k] + p["b"][k]) / 2
    one = lambda p: F.struct(place(ring, middle(p, "x"), middle(p, "y")).alias("place"), distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]).alias("length"))
    return F.filter(F.transform(F.flatten(F.transform(steps(points), cut)), one), lambda p: p["length"] > 0)


def _any(found: Column, where: int) -> Column:
    return F.exists(found, lambda p: p["place"] == where)


def _touching(points: Column, ring: Column) -> Column:
    """The line and the ring's edge share a point."""
    return lines_intersect(points, ring) | F.exists(points, lambda p: place(ring, p["x"], p["y"]) == 0)


def line_in_ring(points: Column, ring: Column) -> Column:
    """How a line lies to a ring's area, as a struct: disjoint, intersects, crosses, touches, within (some of it inside), covered."""
    def cut(s):
        a, b = s["a"], s["b"]
        outside = F.exists(a, lambda p: place(b, p["x"], p["y"]) == -1)
        return _let(pieces(a, b), lambda f: F.struct(_any(f, 1).alias("inside"), (outside | _any(f, -1)).alias("outside"), (_any(f, 1) | _any(f, 0) | _touching(a, b)).alias("meets")))

    def told(t):
        inside, outside, meets = t["inside"], t["outside"], t["meets"]
        return _named(disjoint=~meets, intersects=meets, crosses=inside & outside, touches=meets & ~inside, within=inside & ~outside, covered=~outside)

    return _let(_let(_named(a=points, b=ring), cut), told)


def ring_in_ring(a: Column, b: Column) -> Column:
    """How the areas of two rings lie, as a struct: disjoint, intersects, touches, overlaps, equals, covers (a covers b), within (a in b)."""
    def cut(s):
        meets = lambda f: _any(f, 0) | _touching(s["a"], s["b"])
        of_a = _let(pieces(s["a"], s["b"]), lambda f: _named(inside=_any(f, 1), out=_any(f, -1), edge=meets(f)))
        return _named(a=of_a, b=_let(pieces(s["b"], s["a"]), lambda f: _named(inside=_any(f, 1), out=_any(f, -1))))

    def told(t):
        a_out, b_out, inside = t["a"]["out"], t["b"]["out"], t["a"]["inside"] | t["b"]["inside"]
        equal = ~inside & ~a_out & ~b_out
        interior = equal | inside
        meets = interior | t["a"]["edge"]
        return _named(disjoint=~meets, intersects=meets, touches=meets & ~interior, overlaps=interior & a_out & b_out, equals=equal, covers=interior & ~b_out, within=interior & ~a_out)

    return _let(_let(_named(a=a, b=b), cut), told)


def relate_line_ring(points: Column, ring: Column) -> Column:
    """The nine-intersection matrix of a simple line and a ring's area, as a text of nine characters."""
    found = pieces(points, ring)
    part = lambda test, mark: F.when(test, mark).otherwise("F")
    ends = F.when(is_closed(points), F.slice(points, 1, 0)).otherwise(F.array(F.get(points, F.lit(0)), _last(points)))
    at = lambda where: F.exists(ends, lambda p: place(ring, p["x"], p["y"]) == where)
    first, last = F.get(points, F.lit(0)), _last(points)
    # inner points on the edge: where places change along the line, or a vertex that is no end
    inner = F.exists(steps(points), lambda s: F.exists(F.transform(_cuts(s, ring), lambda u: point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * u, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * u)),
                                                        lambda p: (place(ring, p["x"], p["y"]) == 0) & (is_closed(points) | ((p != first) & (p != last)))))
    edge = F.aggregate(F.filter(found, lambda p: p["place"] == 0), F.lit(0.0), lambda t, p: t + p["length"])
    return F.concat(part(_any(found, 1), "1"), F.when(_any(found, 0), "1").when(inner, "0").otherwise("F"), part(_any(found, -1), "1"), part(at(1), "0"), part(at(0), "0"), part(at(-1), "0"),
                    F.lit("2"), part(edge < line_length(ring) * (1 - 1e-9), "1"), F.lit("2"))


# ---- measures ------------------------------------------------------------------------

def closest_point(points: Column, x: Column, y: Column, digits: int | None = None) -> Column:
    """The line's point that is nearest to (x, y); of equally near ones the first along the line. With ``digits`` distances are equal that agree to so many decimals."""
    near = lambda px, py: distance(px, py, x, y) if digits is None else F.round(distance(px, py, x, y), digits)

    def foot(s, i):
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        u = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        px, py = a["x"] + u * dx, a["y"] + u * dy
        return F.struct(near(px, py).alias("d"), i.alias("at"), px.alias("x"), py.alias("y"))

    # vertices after all feet: they count for a line of one point, or where a foot at a step's end is off by its rounding
    lone = F.transform(points, lambda p, i: F.struct(near(p["x"], p["y"]).alias("d"), (F.size(points) + i).alias("at"), p["x"].alias("x"), p["y"].alias("y")))
    best = F.array_min(F.concat(lone, F.transform(steps(points), foot)))
    return F.when(best.isNotNull(), point(best["x"], best["y"]))


def shortest_line(points: Column, x: Column, y: Column, digits: int | None = None) -> Column:
    """The line from the nearest point to (x, y)."""
    return F.array(closest_point(points, x, y, digits), point(x, y))


# ---- processing ----------------------------------------------------------------------

def convex_hull(points: Column) -> Column:
    """Closed ring of the hull, counter-clockwise from its lowest-x point; fewer than three points not in line give those."""
    def chain(sorted_points):
        def drop(hull, p):  # the last points that make no left turn to p
            bad = lambda h: (F.size(h) >= 2) & (turn(F.element_at(h, -2), F.element_at(h, -1), p) <= 0)
            return F.aggregate(hull, hull, lambda h, _: F.when(F.size(h) < 2, h).when(bad(h), F.slice(h, 1, F.size(h) - 1)).otherwise(h))

        return F.aggregate(sorted_points, F.slice(sorted_points, 1, 0), lambda hull, p: F.concat(drop(hull, p), F.array(p)))

    def whole(ordered):
        return _let(chain(F.reverse(ordered)), lambda upper: F.when(F.size(ordered) < 3, ordered).otherwise(F.concat(chain(ordered), F.slice(upper, 2, F.size(upper) - 1))))

    return _let(F.array_sort(F.array_distinct(points)), whole)


def snap(points: Column, cell: float) -> Column:
    """Points on a lattice, with runs of the same one made one."""
    near = F.transform(points, lambda p: point(F.floor(p["x"] / cell + 0.5) * cell, F.floor(p["y"] / cell + 0.5) * cell))
    return F.filter(near, lambda p, i: (i == 0) | (p != F.get(near, i - 1)))


def buffer_point(x: Column, y: Column, radius: float, quarter: int = 8) -> Column:
    """Ring around a point, with ``quarter`` steps to a quarter of the circle."""
    n = 4 * quarter
    angle = lambda i: (i % n) * (2 * np.pi / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(x + radius * F.cos(angle(i)), y - radius * F.sin(angle(i))))


def clip(ring: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Intersection of a ring with a convex area of counter-clockwise corners, as a closed ring; empty without one.

    The ring is cut by one side after the other. One that is not convex may
    come back with coinciding edges between its parts, which add no area.
    """
    def by(ring, a, b):
        def keep(s):
            was, now = turn(a, b, s["a"]), turn(a, b, s["b"])
            u = was / F.nullif(was - now, F.lit(0.0))
            cut = point(s["a"]["x"] + u * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + u * (s["b"]["y"] - s["a"]["y"]))
            own = point(s["b"]["x"], s["b"]["y"])
            return F.when(now >= 0, F.when((was < 0) & (now > 0), F.array(cut, own)).otherwise(F.array(own))).otherwise(F.when(was > 0, F.array(cut)).otherwise(F.slice(F.array(own), 1, 0)))

        return _let(F.flatten(F.transform(steps(ring), keep)), closed)

    def closed(corners):  # what is left of a ring, its last point before its first
        return F.concat(F.slice(corners, F.greatest(F.size(corners), F.lit(1)), 1), corners)

    ends = [point(x, y) for x, y in corners]
    cut = reduce(lambda r, s: _let(r, lambda bound: by(bound, *s)), zip(ends, ends[1:] + ends[:1]), ring)
    return _let(cut, lambda c: F.when(F.size(c) > 3, c).otherwise(F.slice(c, 1, 0)))


def simplify(points: Column, tolerance: float) -> Column:
    """The line without points that lie within ``tolerance`` of the line kept (Douglas and Peucker).

    The points to keep are found by a stack, which no expression has: an Arrow UDF.
    """
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ps: None if ps is None else [ps[i] for i in kept([(p["x"], p["y"]) for p in ps], tolerance)])

    return run(points)


def kept(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    xy = np.array(points, float).reshape(-1, 2)
    keep, stack = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[:1] = keep[-1:] = True
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, rel = xy[j] - xy[i], xy[i + 1:j] - xy[i]
        u = np.clip(rel @ d / max(d @ d, np.finfo(float).tiny), 0, 1)
        away = np.hypot(*(rel - u[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep).tolist()
