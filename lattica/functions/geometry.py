"""Geometry functions and text codecs as Column expressions: points are (x, y), lines arrays of structs (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def distance_sphere(ax: Column, ay: Column, bx: Column, by: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance of lon/lat points."""
    h = F.pow(F.sin(F.radians(by - ay) / 2), 2) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.pow(F.sin(F.radians(bx - ax) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def azimuth(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clockwise angle from north, in radians; null for equal points."""
    a = F.atan2(bx - ax, by - ay)
    return F.when((ax == bx) & (ay == by), None).otherwise(F.when(a < 0, a + 2 * F.pi()).otherwise(a))


def line_length(points: Column) -> Column:
    n = F.size(points)
    step = lambda i: distance(points[i]["x"], points[i]["y"], points[i + 1]["x"], points[i + 1]["y"])
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0.0), lambda s, i: s + step(i)))


def ring_area(points: Column) -> Column:
    """Unsigned area of a closed ring (shoelace)."""
    at = lambda i: F.get(points, i)
    term = lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), F.lit(0.0), lambda s, i: s + F.coalesce(term(i), F.lit(0.0)))) / 2


def envelope(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def overlaps(axmin, aymin, axmax, aymax, bxmin, bymin, bxmax, bymax) -> Column:
    """Envelopes share a point."""
    return (axmin <= bxmax) & (axmax >= bxmin) & (aymin <= bymax) & (aymax >= bymin)


def box_contains(axmin, aymin, axmax, aymax, bxmin, bymin, bxmax, bymax) -> Column:
    return (axmin <= bxmin) & (axmax >= bxmax) & (aymin <= bymin) & (aymax >= bymax)


def ring_contains(points: Column, x: Column, y: Column) -> Column:
    """A closed ring holds the point, by the parity of crossings."""
    def cross(i):
        a, b = points[i], points[i + 1]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), F.size(points) - 2), cross)) % 2 == 1


def number(v: Column) -> Column:
    """Shortest decimal of a double, without a trailing ``.0``."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def as_geojson(x: Column, y: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), number(x), F.lit(","), number(y), F.lit("]}"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), number(x), F.lit(" "), number(y), F.lit(")"))


def line_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit(")"))


def ewkt(srid: Column, wkt: Column) -> Column:
    return F.concat(F.lit("SRID="), srid.cast("string"), F.lit(";"), wkt)


def ewkt_srid(text: Column) -> Column:
    """SRID of a prefix ``SRID=n;``, null without one."""
    return F.nullif(F.regexp_extract(text, r"^SRID=(\d+);", 1), F.lit("")).cast("int")


def ewkt_body(text: Column) -> Column:
    return F.regexp_replace(text, r"^SRID=\d+;", "")


def parse_point(text: Column) -> tuple[Column, Column]:
    """x and y of a WKT or EWKT point, null for other text."""
    pattern = r"(?i)^\s*POINT\s*\(\s*([-+.\deE]+)\s+([-+.\deE]+)\s*\)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(ewkt_body(text), pattern, i), F.lit("")).cast("double")
    return part(1), part(2)


def sniff(text: Column) -> Column:
    """Whether a literal is hexadecimal WKB (with or without ``\\x``) or WKT."""
    body = ewkt_body(text)
    return F.when(body.startswith("\\x"), "hex_escaped").when(body.startswith("00") | body.startswith("01"), "hex").otherwise("wkt")


def geom_type(text: Column) -> Column:
    return F.upper(F.regexp_extract(ewkt_body(text), r"^\s*([A-Za-z]+)", 1))


# ---- constructors, box relations, accessors and simple processing ---------------------

def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make_line(*points: Column) -> Column:
    return F.array(*points)


def make_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The closed ring of a box."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def box_left(axmax: Column, bxmin: Column) -> Column:
    """A is strictly left of B; with y instead of x, strictly below."""
    return axmax < bxmin


def box_overlaps_or_left(axmax: Column, bxmax: Column) -> Column:
    """A doesn't reach to the right of B; with y instead of x, not above it."""
    return axmax <= bxmax


def box_distance(axmin, aymin, axmax, aymax, bxmin, bymin, bxmax, bymax) -> Column:
    """Distance between envelopes; 0 if they share a point."""
    dx = F.greatest(bxmin - axmax, axmin - bxmax, F.lit(0.0))
    dy = F.greatest(bymin - aymax, aymin - bymax, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def n_points(points: Column) -> Column:
    return F.size(points).cast("long")


def is_closed(points: Column) -> Column:
    return (F.get(points, F.lit(0)) == F.element_at(points, -1)) & (F.size(points) > 1)


def perimeter(ring: Column) -> Column:
    return line_length(ring)


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(points: Column, fx: Column, fy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] * fx, p["y"] * fy))


def reverse(points: Column) -> Column:
    return F.reverse(points)


def boundary(points: Column) -> Column:
    """End points of a line; none of a closed one."""
    return F.when(is_closed(points), F.slice(points, 1, 0)).otherwise(F.array(F.get(points, F.lit(0)), F.element_at(points, -1)))


def segmentize(points: Column, longest: float) -> Column:
    """The line with further points so that no step is longer."""
    def step(i):
        a, b = points[i], points[i + 1]
        n = F.greatest(F.ceil(distance(a["x"], a["y"], b["x"], b["y"]) / longest), F.lit(1).cast("long"))
        return F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: point(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n))

    return F.concat(F.slice(points, 1, 1), F.flatten(F.transform(F.sequence(F.lit(0), F.size(points) - 2), step)))


def point_segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square)))
    return distance(x, y, ax + t * dx, ay + t * dy)


def point_line_distance(points: Column, x: Column, y: Column) -> Column:
    steps = F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0)))
    return F.array_min(F.transform(steps, lambda i: point_segment_distance(x, y, points[i]["x"], points[i]["y"], F.coalesce(F.get(points, i + 1)["x"], points[i]["x"]), F.coalesce(F.get(points, i + 1)["y"], points[i]["y"]))))


def max_distance(a: Column, b: Column) -> Column:
    """Greatest distance between points of two point arrays."""
    return F.array_max(F.transform(a, lambda p: F.array_max(F.transform(b, lambda q: distance(p["x"], p["y"], q["x"], q["y"])))))


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete Hausdorff distance of two point arrays."""
    one = lambda s, t: F.array_max(F.transform(s, lambda p: F.array_min(F.transform(t, lambda q: distance(p["x"], p["y"], q["x"], q["y"])))))
    return F.greatest(one(a, b), one(b, a))


def dwithin(ax: Column, ay: Column, bx: Column, by: Column, d: float) -> Column:
    return distance(ax, ay, bx, by) <= d


def as_svg(x: Column, y: Column) -> Column:
    return F.concat(F.lit('cx="'), number(x), F.lit('" cy="'), number(-y), F.lit('"'))


def as_kml(x: Column, y: Column) -> Column:
    return F.concat(F.lit("<Point><coordinates>"), number(x), F.lit(","), number(y), F.lit("</coordinates></Point>"))


def as_gml(srid: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit('<gml:Point srsName="EPSG:'), srid.cast("string"), F.lit('"><gml:coordinates>'), number(x), F.lit(","), number(y), F.lit("</gml:coordinates></gml:Point>"))


#: Fixed value: digits of geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: Column, lat: Column, length: int = 8) -> Column:
    """Bits of longitude and latitude in turn, five to a digit."""
    bits = 5 * length
    at = lambda v, low, size, n: F.least(F.floor((v - low) / size * float(1 << n)), F.lit((1 << n) - 1).cast("long"))
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = at(lon, -180.0, 360.0, nx), at(lat, -90.0, 180.0, ny)
    bit = lambda v, n, k: F.pmod(F.floor(v / F.lit(float(1 << (n - 1 - k)))), F.lit(2))
    digits = []
    for d in range(length):
        value = F.lit(0).cast("long")
        for k in range(5 * d, 5 * d + 5):
            value = value * 2 + (bit(y, ny, k // 2) if k % 2 else bit(x, nx, k // 2))
        digits.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)
