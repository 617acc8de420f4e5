"""Shapes: relations to rings, validity, hulls, clipping and simplification on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import geometry as geo, shapes

BOX = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
LINES = {
    "through": [(-5, 5), (15, 5)], "inside": [(2, 2), (8, 8)], "edge": [(0, 2), (0, 8)], "corner": [(-1, 11), (1, 9)], "graze": [(-5, 5), (5, 15)], "apart": [(20, 20), (30, 30)],
    "enters": [(-5, 5), (5, 5)], "chord": [(0, 0), (10, 10)], "loop": [(2, 2), (8, 2), (8, 8), (2, 2)], "empty": [], "none": None}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, None if v is None else [(float(x), float(y)) for x, y in v]) for k, v in LINES.items()]
    return spark.createDataFrame(rows, "name string, points array<struct<x:double,y:double>>")


def ring(points):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_line_relations(lines):
    got = {r["name"]: r for r in lines.select("name", shapes.line_in_ring(F.col("points"), ring(BOX)).alias("t"), shapes.relate_line_ring(F.col("points"), ring(BOX)).alias("m")).collect()}
    kind = lambda n: {k for k, v in got[n]["t"].asDict().items() if v}
    assert kind("through") == kind("enters") == kind("corner") == {"intersects", "crosses"}
    assert kind("inside") == kind("chord") == kind("loop") == {"intersects", "within", "covered"}
    assert kind("edge") == {"intersects", "touches", "covered"} and kind("graze") == {"intersects", "touches"} and kind("apart") == {"disjoint"}
    assert kind("empty") == {"disjoint", "covered"} and all(v is None for v in got["none"]["t"])
    assert {n: got[n]["m"] for n in ("through", "inside", "edge", "graze", "apart", "enters", "chord", "loop")} == {
        "through": "101FF0212", "inside": "1FF0FF212", "edge": "F1FF0F212", "graze": "F01FF0212", "apart": "FF1FF0212", "enters": "1010F0212", "chord": "1FFF0F212", "loop": "1FFFFF212"}


def test_ring_validity(spark):
    shapes_ = {"box": BOX, "bow": [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], "open": BOX[:-1], "spike": [(0, 0), (10, 0), (5, 0), (5, 5), (0, 0)], "flat": [(0, 0), (5, 0), (0, 0)], "empty": []}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in shapes_.items()], "name string, points array<struct<x:double,y:double>>")
    p = F.col("points")
    got = {r[0]: r[1:] for r in df.select("name", F.coalesce(shapes.is_valid_ring(p), F.lit(False)), shapes.is_empty(p), shapes.is_simple(p)).collect()}
    assert [k for k, v in got.items() if v[0]] == ["box"] and [k for k, v in got.items() if v[1]] == ["empty"]
    assert got["open"][2] and not got["bow"][2] and not got["spike"][2]


def _hull(points):
    """Corners by brute force: ends of the pairs with all other points on their left."""
    ps, out = sorted(set(points)), set()
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for a in ps:
        for b in ps:
            rest = [(turn(a, b, c), (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1])) for c in ps if c not in (a, b)]
            if a != b and all(t > 0 or (t == 0 and d < 0) for t, d in rest):
                out |= {a, b}
    return out


def test_hull_and_clip(spark):
    rng = random.Random(5)
    rows = [(i, [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randrange(3, 15))]) for i in range(40)] + [(98, [(1.0, 1.0)]), (99, [])]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    hulls = {r[0]: [tuple(p) for p in r[1]] for r in df.select("id", shapes.convex_hull(F.col("points"))).collect()}
    for i, points in rows:
        if len(points) > 2 and len(hulls[i]) > 3:
            assert hulls[i][0] == hulls[i][-1] and set(hulls[i]) == _hull(points)
    assert hulls[98] == [(1.0, 1.0)] and hulls[99] == []
    corners = [tuple(map(F.lit, map(float, c))) for c in ((2, 2), (8, 2), (8, 8), (2, 8))]
    cut = df.sparkSession.range(1).select(shapes.clip(ring([(0, 0), (10, 0), (0, 10), (0, 0)]), corners).alias("a"), shapes.clip(ring([(20, 20), (30, 20), (20, 30), (20, 20)]), corners).alias("b"))
    a, b, area, none = cut.select("a", "b", geo.ring_area(F.col("a")), geo.ring_area(F.col("b"))).first()
    assert {tuple(p) for p in a} == {(2, 2), (8, 2), (2, 8)} and area == 18 and b == [] and none == 0


def test_simplify_and_nearest(spark):
    rng = random.Random(8)
    line = [(float(i), rng.random() * 2) for i in range(300)]
    df = spark.createDataFrame([(1, line), (2, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (3, [(4.0, 4.0)]), (4, []), (5, None)], "id int, points array<struct<x:double,y:double>>")
    p = F.col("points")
    rows = {r[0]: r[1:] for r in df.select("id", shapes.simplify(p, 0.5), shapes.closest_point(p, F.lit(1.0), F.lit(3.0))).collect()}
    kept = [tuple(q) for q in rows[1][0]]
    assert set(kept) < set(line) and kept[0] == line[0] and kept[-1] == line[-1]
    for a, b in zip(kept, kept[1:]):  # what lies between is near the step
        for q in line[line.index(a):line.index(b) + 1]:
            u = min(1, max(0, ((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
            assert ((a[0] + u * (b[0] - a[0]) - q[0]) ** 2 + (a[1] + u * (b[1] - a[1]) - q[1]) ** 2) ** 0.5 <= 0.5 + 1e-9
    assert [tuple(q) for q in rows[2][0]] == [(0, 0), (2, 0)] and tuple(rows[2][1]) == (1, 0) and tuple(rows[3][1]) == (4, 4)
    assert rows[4] == ([], None) and rows[5] == (None, None)


def test_equally_near_points_go_by_their_place_on_the_line(spark, tmp_path):
    from lattica import queries

    rows = [(1, [(3.0, 0.0), (1.5, -9.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (1.5, -9.0), (3.0, 0.0)]), (3, [(3.0, 0.0), (1.5, -9.0), (0.0, 1e-12)]), (4, [(3.0, 0.0), (3.0, 0.0)])]
    df, p = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>"), F.col("points")
    near = lambda *digits: {r[0]: tuple(round(v, 6) for v in r[1]) for r in df.select("id", shapes.closest_point(p, F.lit(1.5), F.lit(5.0), *digits)).collect()}
    assert near() == {1: (3, 0), 2: (0, 0), 3: (0, 0), 4: (3, 0)}
    assert near(9) == near() | {3: (3, 0)}
    spark.createDataFrame([(2045,), (7803,), (14243,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.id: (r.x, r.y) for r in queries.QUERIES["closest_points"](spark, str(tmp_path)).collect()} == {2045: (35, 36), 7803: (21, 30), 14243: (21, 15)}
