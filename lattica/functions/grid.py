"""Grid arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import EDGE, Grid


def low(v: Column) -> Column:
    return F.floor(v + EDGE)


def high(v: Column) -> Column:
    """Last cell before an edge: an edge on a border doesn't pull in the next cell."""
    return F.ceil(v - EDGE) - 1


def extent_to_bounds(grid: Grid, xmin: Column, ymin: Column, xmax: Column, ymax: Column, clamp: bool = False, shrink: bool = False) -> dict[str, Column]:
    """Bounds columns of an extent. ``shrink`` takes half a cell off each side first."""
    e, dx, dy = grid.extent, grid.cw / 2 * shrink, grid.ch / 2 * shrink
    out = {
        "col_min": low((xmin + dx - e.xmin) / grid.cw), "row_min": low((e.ymax - ymax + dy) / grid.ch),
        "col_max": high((xmax - dx - e.xmin) / grid.cw), "row_max": high((e.ymax - ymin - dy) / grid.ch),
    }
    return intersect(grid, out) if clamp else out


def intersect(grid: Grid, b: dict[str, Column]) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {
        "col_min": F.greatest(b["col_min"], zero), "row_min": F.greatest(b["row_min"], zero),
        "col_max": F.least(b["col_max"], F.lit(grid.cols - 1).cast("long")), "row_max": F.least(b["row_max"], F.lit(grid.rows - 1).cast("long")),
    }


def bounds_to_extent(grid: Grid, col_min: Column, row_min: Column, col_max: Column, row_max: Column) -> dict[str, Column]:
    e = grid.extent
    return {"xmin": e.xmin + col_min * grid.cw, "ymin": e.ymax - (row_max + 1) * grid.ch, "xmax": e.xmin + (col_max + 1) * grid.cw, "ymax": e.ymax - row_min * grid.ch}


def split(grids: DataFrame, width: int, height: int, cols: str = "cols", rows: str = "rows") -> DataFrame:
    """Tiles of each grid row, edge tiles smaller: tile_col, tile_row and bounds."""
    out = grids.withColumn("tile_col", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(cols) - 1) / width))))
    out = out.withColumn("tile_row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(rows) - 1) / height))))
    return out.withColumns({
        "col_min": F.col("tile_col") * width, "row_min": F.col("tile_row") * height,
        "col_max": F.least((F.col("tile_col") + 1) * width, F.col(cols)) - 1, "row_max": F.least((F.col("tile_row") + 1) * height, F.col(rows)) - 1})


def centre_x(grid: Grid, col: Column) -> Column:
    return grid.extent.xmin + (col + 0.5) * grid.cw


def centre_y(grid: Grid, row: Column) -> Column:
    return grid.extent.ymax - (row + 0.5) * grid.ch


def col_at(grid: Grid, x: Column) -> Column:
    return F.floor((x - grid.extent.xmin) / grid.cw)


def row_at(grid: Grid, y: Column) -> Column:
    return F.floor((grid.extent.ymax - y) / grid.ch)
