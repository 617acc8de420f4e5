"""Resampling and reprojection of long-form cells.

On one coordinate system every source cell knows which target cells it
feeds, so nearest-neighbour is a map without a join or shuffle, and the
weighted methods are one aggregation. Between coordinate systems target
cells look up their source cell (or the four around their centre) by an
equi-join on its key; the methods that sum up source cells move these forward
instead, which again is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, grid as g
from ..types import Bounds, Extent, Grid

METHODS = ("nearest", "bilinear", "average", "sum", "min", "max", "mode", "median")


def _feeds(offset: float, source: float, target: float, n: int, index: Column, before: float, after: float) -> Column:
    """Target indexes whose centres lie within ``before`` and ``after`` cells of a source cell's own range, one more on each side (an exact test follows)."""
    low = F.floor(((index - before) * source - offset) / target - 0.5) - 1
    high = F.ceil(((index + 1 + after) * source - offset) / target - 0.5) + 1
    low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(n - 1).cast("long"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _targets(cells: DataFrame, source: Grid, target: Grid, reach: float) -> DataFrame:
    dx, dy = target.extent.xmin - source.extent.xmin, source.extent.ymax - target.extent.ymax
    out = cells.withColumn("c", F.explode(_feeds(dx, source.cw, target.cw, target.cols, F.col("col_idx"), reach, reach)))
    return out.withColumn("r", F.explode(_feeds(dy, source.ch, target.ch, target.rows, F.col("row_idx"), reach, reach)))


def nearest(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """The source cell whose half-open box holds the target's centre."""
    out = _targets(cells, source, target, 0.0)
    out = out.where((g.col_at(source, g.centre_x(target, F.col("c"))) == F.col("col_idx")) & (g.row_at(source, g.centre_y(target, F.col("r"))) == F.col("row_idx")))
    return out.select("band", F.col("c").alias("col_idx"), F.col("r").alias("row_idx"), "value")


def bilinear(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Weights of the four cells around a centre; NoData has none, the others' are brought to one again."""
    out = _targets(cells.where("value is not null"), source, target, 1.0)
    u = (g.centre_x(target, F.col("c")) - source.extent.xmin) / source.cw - 0.5 - F.col("col_idx")
    v = (source.extent.ymax - g.centre_y(target, F.col("r"))) / source.ch - 0.5 - F.col("row_idx")
    out = out.withColumn("w", (1 - F.abs(u)) * (1 - F.abs(v))).where((F.abs(u) < 1) & (F.abs(v) < 1) & (F.col("w") > 0))
    return out.groupBy("band", F.col("c").alias("col_idx"), F.col("r").alias("row_idx")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def aggregate(cells: DataFrame, source: Grid, target: Grid, method: str, srids: tuple[int, int] | None = None) -> DataFrame:
    """Over the source cells whose centres lie in the target cell; of the most frequent values the least. With ``srids`` centres are moved from the first to the second."""
    x, y = g.centre_x(source, F.col("col_idx")), g.centre_y(source, F.col("row_idx"))
    if srids:
        x, y = crs.transform(x, y, *srids)
    c, r = g.col_at(target, x), g.row_at(target, y)
    keyed = cells.where("value is not null").select("band", c.alias("col_idx"), r.alias("row_idx"), "value")
    keyed = keyed.where(F.col("col_idx").between(0, target.cols - 1) & F.col("row_idx").between(0, target.rows - 1))
    by = ["band", "col_idx", "row_idx"]
    if method == "mode":
        counts = keyed.groupBy(*by, "value").agg(F.count("*").alias("n"))
        return counts.groupBy(*by).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    function = {"average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}[method]
    return keyed.groupBy(*by).agg(function("value").alias("value"))


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "nearest") -> DataFrame:
    if method == "nearest":
        return nearest(cells, source, target)
    return bilinear(cells, source, target) if method == "bilinear" else aggregate(cells, source, target, method)


def grid_cells(df: DataFrame, grid: Grid, bounds: Bounds | None = None) -> DataFrame:
    """(col_idx, row_idx) of a grid's window, made by the executors."""
    b = grid.bounds if bounds is None else grid.bounds.intersection(bounds)
    if b is None:
        return df.sparkSession.range(0).select(F.col("id").alias("col_idx"), F.col("id").alias("row_idx"))
    w = b.col_max - b.col_min + 1
    return df.sparkSession.range(w * (b.row_max - b.row_min + 1)).select((F.col("id") % w + b.col_min).alias("col_idx"), (F.floor(F.col("id") / w) + b.row_min).alias("row_idx"))


def fill_region(cells: DataFrame, region: Grid, bands: tuple[int, ...], bounds: Bounds | None = None) -> DataFrame:
    """Every cell of the region, or of a window of it, null where there was none."""
    every = grid_cells(cells, region, bounds).withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    return every.join(cells, ["band", "col_idx", "row_idx"], "left").select("band", "col_idx", "row_idx", "value")


def edge_points(e: Extent, steps: int = 32) -> list[tuple[float, float]]:
    t = [i / steps for i in range(steps + 1)]
    return [p for s in t for p in ((e.xmin + s * e.width, e.ymin), (e.xmin + s * e.width, e.ymax), (e.xmin, e.ymin + s * e.height), (e.xmax, e.ymin + s * e.height))]


def reprojected_extent(e: Extent, source: int, target: int) -> Extent:
    """Envelope of the densified edge."""
    moved = [crs.transform_point(x, y, source, target) for x, y in edge_points(e)]
    return Extent(min(x for x, _ in moved), min(y for _, y in moved), max(x for x, _ in moved), max(y for _, y in moved))


def reprojected_grid(grid: Grid, source: int, target: int) -> Grid:
    """The reprojected extent with square cells such that its diagonal has as many cells as before."""
    e = reprojected_extent(grid.extent, source, target)
    size = (e.width**2 + e.height**2) ** 0.5 / (grid.cols**2 + grid.rows**2) ** 0.5
    cols, rows = max(1, round(e.width / size)), max(1, round(e.height / size))
    return Grid(e, cols, rows)


def reproject(cells: DataFrame, source: Grid, source_srid: int, target: Grid, target_srid: int, bounds: Bounds | None = None, method: str = "nearest", targets: DataFrame | None = None) -> DataFrame:
    """``targets``, if given, are the (col_idx, row_idx) that are asked for. Each target centre is mapped back exactly and looks up its source cell, or the weighted four around it; other methods sum up the cells whose centres are moved into a target cell."""
    if method not in ("nearest", "bilinear"):
        return aggregate(cells, source, target, method, (source_srid, target_srid))
    t = grid_cells(cells, target, bounds) if targets is None else targets
    x, y = crs.transform(g.centre_x(target, F.col("col_idx")), g.centre_y(target, F.col("row_idx")), target_srid, source_srid)
    key = [F.col("col_idx").alias("c"), F.col("row_idx").alias("r")]
    if method == "nearest":
        t = t.select(*key, g.col_at(source, x).alias("col_idx"), g.row_at(source, y).alias("row_idx"))
        return t.join(cells, ["col_idx", "row_idx"]).select("band", F.col("c").alias("col_idx"), F.col("r").alias("row_idx"), "value")
    t = t.select(*key, ((x - source.extent.xmin) / source.cw - 0.5).alias("u"), ((source.extent.ymax - y) / source.ch - 0.5).alias("v"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = t.withColumn("n", near).select("c", "r", "u", "v", (F.floor("u") + F.col("n.i")).alias("col_idx"), (F.floor("v") + F.col("n.j")).alias("row_idx"))
    t = t.withColumn("w", (1 - F.abs(F.col("u") - F.col("col_idx"))) * (1 - F.abs(F.col("v") - F.col("row_idx")))).where("w > 0")
    met = t.join(cells.where("value is not null"), ["col_idx", "row_idx"])
    return met.groupBy("band", F.col("c").alias("col_idx"), F.col("r").alias("row_idx")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
