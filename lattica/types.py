"""Value types of grids and cells, and the Spark schemas of tables that hold them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

EXTENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
BOUNDS = T.StructType([T.StructField(n, T.LongType()) for n in ("col_min", "row_min", "col_max", "row_max")])
TILES = T.StructType([
    T.StructField("tcol", T.LongType()), T.StructField("trow", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])
GEOMETRY = T.StructType([T.StructField("srid", T.IntegerType()), T.StructField("wkb", T.BinaryType())])

#: Tolerance, in cells, with which an edge counts as lying on a cell border.
EDGE = 1e-7
#: Cell types from narrow to wide: the union of several is the widest.
CELL_TYPES = ("bit", "uint8", "int8", "uint16", "int16", "int32", "float32", "float64")
#: Least and greatest value of the integer cell types.
CELL_RANGE = {"bit": (0, 1), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1)}


@dataclass(frozen=True)
class Extent:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def width(self) -> float:
        return self.xmax - self.xmin

    @property
    def height(self) -> float:
        return self.ymax - self.ymin

    def combine(self, other: Extent) -> Extent:
        return Extent(min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax))


@dataclass(frozen=True)
class Bounds:
    """A window of cells; maxima are inclusive."""

    col_min: int
    row_min: int
    col_max: int
    row_max: int

    def intersection(self, other: Bounds) -> Bounds | None:
        b = Bounds(max(self.col_min, other.col_min), max(self.row_min, other.row_min), min(self.col_max, other.col_max), min(self.row_max, other.row_max))
        return b if b.col_min <= b.col_max and b.row_min <= b.row_max else None


class GridError(ValueError):
    """Grids that cannot be combined, or a window that a strict read doesn't find."""


@dataclass(frozen=True)
class Grid:
    """A regular grid: x grows to the right, y grows up, row 0 is the top."""

    extent: Extent
    cols: int
    rows: int

    @property
    def cw(self) -> float:
        return self.extent.width / self.cols

    @property
    def ch(self) -> float:
        return self.extent.height / self.rows

    @property
    def bounds(self) -> Bounds:
        return Bounds(0, 0, self.cols - 1, self.rows - 1)

    @classmethod
    def of_cells(cls, extent: Extent, cw: float, ch: float) -> Grid:
        return cls(extent, round(extent.width / cw), round(extent.height / ch))

    def bounds_for(self, extent: Extent, clamp: bool = False) -> Bounds:
        def low(v):
            return math.floor(v + EDGE)

        def high(v):
            return math.ceil(v - EDGE) - 1

        e = self.extent
        b = Bounds(low((extent.xmin - e.xmin) / self.cw), low((e.ymax - extent.ymax) / self.ch), high((extent.xmax - e.xmin) / self.cw), high((e.ymax - extent.ymin) / self.ch))
        if not clamp:
            return b
        return Bounds(max(0, b.col_min), max(0, b.row_min), min(self.cols - 1, b.col_max), min(self.rows - 1, b.row_max))

    def extent_for(self, b: Bounds) -> Extent:
        e = self.extent
        return Extent(e.xmin + b.col_min * self.cw, e.ymax - (b.row_max + 1) * self.ch, e.xmin + (b.col_max + 1) * self.cw, e.ymax - b.row_min * self.ch)

    def snapped(self, extent: Extent) -> Grid:
        """This grid's cells over the least region that covers ``extent``."""
        b = self.bounds_for(extent)
        return Grid(self.extent_for(b), b.col_max - b.col_min + 1, b.row_max - b.row_min + 1)

    def combine(self, other: Grid) -> Grid:
        """The grid over both; equal cell sizes are required."""
        if abs(self.cw - other.cw) > 1e-9 or abs(self.ch - other.ch) > 1e-9:
            raise GridError("grids of different cell sizes")
        return Grid.of_cells(self.extent.combine(other.extent), self.cw, self.ch)
