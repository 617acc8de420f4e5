"""Raster views: small immutable logical plans over tile tables, compiled to DataFrames.

A view holds what a raster is (grid, SRID, bands, cell type, tags) and how its
cells come about. Transforms give new views; the rewrites are:

- a read's window becomes a predicate on tile keys before tiles are exploded,
- bands become a predicate on the band,
- a transform of a transformed view starts again from the original cells (so
  that errors don't compound), a transform to the same grid and SRID is none,
- the overview that a resampled read needs is chosen from the grids alone,
- transforms of a mosaic go below its union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, grid as g
from ..operators import convert, mosaic, resample
from ..types import CELL_TYPES, Bounds, Extent, Grid, GridError
from .errors import guarded

#: Tile side of the physical tables.
SIDE = 8


@dataclass(frozen=True)
class RasterView:
    """A lazy raster. ``tiles(bands, keys)`` gives its tile table, bands and tile keys (bounds, or None for all) already pruned where the source can."""

    name: str
    tiles: Callable[[tuple[int, ...], Bounds | None], DataFrame]
    grid: Grid
    srid: int = 3857
    bands: int = 1
    cell_type: str = "float64"
    nodata: float | None = None
    tags: dict = field(default_factory=dict)
    band_tags: tuple = ()
    domains: dict = field(default_factory=dict)
    overviews: tuple[Grid, ...] = ()
    overview_tiles: tuple[Callable, ...] = ()
    target: Grid | None = None
    target_srid: int | None = None
    target_type: str | None = None
    method: str = "nearest"
    exact_region: bool = False
    #: What a cell without a value is read as; None leaves it null.
    missing: float | None = None

    # -- metadata, without a look at any cell ----------------------------------

    @property
    def grid_extent(self) -> Grid:
        return self.target or self.grid

    @property
    def crs(self) -> int:
        return self.srid if self.target_srid is None else self.target_srid

    def metadata(self) -> dict:
        grid = self.grid_extent
        return {"name": self.name, "srid": self.crs, "method": self.method, "band_count": self.bands, "cell_type": self.target_type or self.cell_type, "nodata": self.nodata,
                "cols": grid.cols, "rows": grid.rows, "size": grid.cols * grid.rows, "bounds": grid.bounds, "cw": grid.cw, "ch": grid.ch, "extent": grid.extent, "dataset": "source" if self.target is None else "warped"}

    def resolutions(self) -> list[Grid]:
        """The base grid, then the overviews', all in the view's own SRID and scaled with it."""
        ratio_x, ratio_y = self.grid_extent.cw / self.grid.cw, self.grid_extent.ch / self.grid.ch
        extent = self.grid_extent.extent
        return [self.grid_extent, *(Grid.of_cells(extent, o.cw * ratio_x, o.ch * ratio_y) for o in self.overviews)]

    def attributes(self, band: int | None = None) -> dict:
        """Tags of the source, or of a band; none for a band that isn't there."""
        return self.tags if band is None else (self.band_tags[band] if 0 <= band < len(self.band_tags) else {})

    def domain_metadata(self, *domains: str) -> dict[str, dict[str, str]]:
        """Entries of the named metadata domains ("" is the default one); of all that there are if none is named. Absent ones are left out."""
        return {d: self.domains[d] for d in (domains or self.domains) if d in self.domains}

    # -- transforms ------------------------------------------------------------

    def convert(self, cell_type: str) -> RasterView:
        if cell_type not in CELL_TYPES:
            raise ValueError(f"cell type {cell_type}")
        return replace(self, target_type=cell_type)

    def interpret_as(self, cell_type: str) -> RasterView:
        """Another label on the same values."""
        return replace(self, cell_type=cell_type, target_type=None)

    def _onto(self, grid: Grid, srid: int, method: str, exact: bool) -> RasterView:
        if method not in resample.METHODS:
            raise ValueError(f"method {method}")
        if grid == self.grid and srid == self.srid:
            return replace(self, target=None, target_srid=None, exact_region=False)
        return replace(self, target=grid, target_srid=srid, method=method, exact_region=exact)

    def resample(self, cols: int, rows: int, method: str = "nearest") -> RasterView:
        return self._onto(Grid(self.grid_extent.extent, cols, rows), self.crs, method, False)

    def resample_to_cell_size(self, cw: float, ch: float, method: str = "nearest") -> RasterView:
        return self._onto(Grid.of_cells(self.grid_extent.extent, cw, ch), self.crs, method, False)

    def resample_to_grid(self, grid: Grid, method: str = "nearest") -> RasterView:
        return self._onto(grid.snapped(self.grid_extent.extent), self.crs, method, False)

    def resample_to_region(self, region: Grid, method: str = "nearest") -> RasterView:
        return self._onto(region, self.crs, method, True)

    def reproject(self, srid: int, method: str = "nearest") -> RasterView:
        if srid == self.crs:
            return self
        return self._onto(resample.reprojected_grid(self.grid, self.srid, srid), srid, method, False)

    def reproject_to_grid(self, srid: int, grid: Grid, method: str = "nearest") -> RasterView:
        if srid == self.crs:
            return self if grid == self.grid_extent else self.resample_to_grid(grid, method)
        return self._onto(grid.snapped(resample.reprojected_extent(self.grid.extent, self.srid, srid)), srid, method, False)

    def reproject_to_region(self, srid: int, region: Grid, method: str = "nearest") -> RasterView:
        return self._onto(region, srid, method, True)

    # -- reads -------------------------------------------------------------------

    def _source_cells(self, bounds: Bounds | None, bands: tuple[int, ...], tiles: Callable, grid: Grid) -> DataFrame:
        """Cells of the original raster: tile keys are pruned before tiles are exploded."""
        b = grid.bounds if bounds is None else grid.bounds.intersection(bounds)
        if b is None:
            return explode_tiles(tiles(bands, None)).where("false")
        whole = b == grid.bounds
        keys = None if whole else Bounds(b.col_min // SIDE, b.row_min // SIDE, b.col_max // SIDE, b.row_max // SIDE)
        df = tiles(bands, keys)
        if keys is not None:
            df = df.where(F.col("tcol").between(keys.col_min, keys.col_max) & F.col("trow").between(keys.row_min, keys.row_max))
        # tiles at the right and lower edge hold cells beyond the grid
        return explode_tiles(df) if whole and not (grid.cols % SIDE or grid.rows % SIDE) else in_bounds(explode_tiles(df), b)

    def cells(self, bounds: Bounds | None = None, bands: tuple[int, ...] | None = None) -> DataFrame:
        """(band, col_idx, row_idx, value) of a window of the view's own grid; null is NoData."""
        bands = tuple(range(self.bands)) if bands is None else tuple(bands)
        if self.target is None:
            out = self._source_cells(bounds, bands, self.tiles, self.grid)
            if self.nodata is not None:
                out = convert.nodata(out, self.nodata)
        else:
            grid, tiles = self._level()
            source = self._source_cells(self._source_bounds(bounds, grid), bands, tiles, grid)
            out = self._moved(source, grid, bounds)
            if self.exact_region:
                out = resample.fill_region(out, self.target, bands, bounds)
        return self._typed(out)

    def _typed(self, cells: DataFrame) -> DataFrame:
        out = convert.convert(cells, self.target_type) if self.target_type else cells
        return out if self.missing is None else out.withColumn("value", F.coalesce("value", F.lit(self.missing)))

    def _level(self) -> tuple[Grid, Callable]:
        """Grid and tiles of the overview that the target's cells call for, brought back to the source's SRID first."""
        if self.overviews:
            cw = self.target.cw if self.srid == self.crs else resample.reprojected_grid(self.target, self.crs, self.srid).cw
            if level := overview_level([self.grid, *self.overviews], cw):
                return self.overviews[level - 1], self.overview_tiles[level - 1]
        return self.grid, self.tiles

    def _moved(self, source: DataFrame, grid: Grid, bounds: Bounds | None, targets: DataFrame | None = None) -> DataFrame:
        """Source cells on the target grid, by the view's method."""
        if self.nodata is not None:
            source = convert.nodata(source, self.nodata)
        if self.srid == self.crs:
            out = resample.resample(source, grid, self.target, self.method)
        else:
            out = resample.reproject(source, grid, self.srid, self.target, self.crs, bounds, self.method, targets)
        return out if bounds is None else in_bounds(out, bounds)

    def _source_bounds(self, bounds: Bounds | None, grid: Grid) -> Bounds | None:
        """Source window of a target window, one cell wider on every side."""
        if bounds is None:
            return None
        extent = self.target.extent_for(bounds)
        if self.srid != self.crs:
            extent = resample.reprojected_extent(extent, self.crs, self.srid)
        b = grid.bounds_for(extent)
        return Bounds(b.col_min - 1, b.row_min - 1, b.col_max + 1, b.row_max + 1)

    def _source_keys(self, windows: DataFrame, grid: Grid) -> DataFrame:
        """(tcol, trow): the source tiles that any of a table of target windows reaches, one cell wider on every side."""
        e = g.bounds_to_extent(self.target, *(F.col(c) for c in ("col_min", "row_min", "col_max", "row_max")))
        steps = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: i / 16)
        edge = windows.select(*[c.alias(k) for k, c in e.items()], F.explode(steps).alias("t"))
        x, y = (F.col(f"{a}min") + F.col("t") * (F.col(f"{a}max") - F.col(f"{a}min")) for a in "xy")
        sides = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, F.col("ymin")), (x, F.col("ymax")), (F.col("xmin"), y), (F.col("xmax"), y))])
        moved = F.transform(sides, lambda s: F.struct(*[c.alias(k) for c, k in zip(crs.transform(s["x"], s["y"], self.crs, self.srid), "xy")]))
        edge = edge.withColumn("p", F.explode(moved)).groupBy("xmin", "ymin", "xmax", "ymax").agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
        ends = {"c": (g.col_at(grid, F.col("x0")) - 1, g.col_at(grid, F.col("x1")) + 1, grid.cols), "r": (g.row_at(grid, F.col("y1")) - 1, g.row_at(grid, F.col("y0")) + 1, grid.rows)}
        key = lambda c, n: F.floor(F.greatest(F.lit(0), F.least(c, F.lit(n - 1))) / SIDE)
        spans = edge.select(*[key(c, n).alias(k + end) for k, (low, high, n) in ends.items() for c, end in ((low, "0"), (high, "1"))])
        return spans.select(F.explode(F.sequence("c0", "c1")).alias("tcol"), "r0", "r1").select("tcol", F.explode(F.sequence("r0", "r1")).alias("trow")).distinct()

    def read(self, extent: Extent | None = None, bounds: Bounds | None = None, bands: tuple[int, ...] | None = None, on_error: str = "null") -> DataFrame:
        """Cells of a window. A window that misses the grid gives no row; with ``on_error="strict"`` it raises, with "capture" it is a row with ``_error``."""

        def run() -> DataFrame:
            window = bounds if extent is None else self.grid_extent.bounds_for(extent)
            if window is not None and self.grid_extent.bounds.intersection(window) is None:
                if on_error == "null":
                    return self.cells(window, bands).where("false")
                raise GridError("the window misses the raster")
            return self.cells(window if window is None else self.grid_extent.bounds.intersection(window), bands)

        return guarded(run, on_error, lambda: self.cells(None, bands).where("false"))

    def read_many(self, windows: DataFrame, bands: tuple[int, ...] | None = None) -> DataFrame:
        """(window_id, band, col_idx, row_idx, value) for a table of windows; windows that miss the grid are dropped.

        Windows are joined to tiles on tile keys, an equi-join of any size; each window keeps its rows even where two are equal.
        """
        grid = self.grid_extent
        b = g.intersect(grid, {c: F.col(c) for c in ("col_min", "row_min", "col_max", "row_max")})
        w = windows.select("window_id", *[v.alias(k) for k, v in b.items()]).where("col_min <= col_max and row_min <= row_max")
        bands = tuple(range(self.bands)) if bands is None else tuple(bands)
        span = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{axis}_min") / SIDE), F.floor(F.col(f"{axis}_max") / SIDE)))
        keyed = w.withColumn("tcol", span("col")).withColumn("trow", span("row"))
        own = ("window_id", "col_min", "row_min", "col_max", "row_max")
        if self.target is None:
            cells = explode_tiles(self.tiles(bands, None).join(keyed, ["tcol", "trow"]), *own)
            cells = cells if self.nodata is None else convert.nodata(cells, self.nodata)
        else:  # tiles that no window reaches are left out below the transform
            source, tiles = self._level()
            reached = tiles(bands, None).join(self._source_keys(w, source), ["tcol", "trow"], "left_semi")
            inside = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("at")
            asked = keyed.select("tcol", "trow").distinct().select("tcol", "trow", inside).select((F.col("tcol") * SIDE + F.col("at") % SIDE).alias("col_idx"), (F.col("trow") * SIDE + F.floor(F.col("at") / SIDE)).alias("row_idx"))
            cells = self._moved(in_bounds(explode_tiles(reached), source.bounds), source, None, asked)
            cells = cells.withColumns({"tcol": F.floor(F.col("col_idx") / SIDE), "trow": F.floor(F.col("row_idx") / SIDE)}).join(keyed, ["tcol", "trow"])
            if self.exact_region:
                every = w.select("*", F.explode(F.array(*map(F.lit, bands))).alias("band"), F.explode(F.sequence("col_min", "col_max")).alias("col_idx")).withColumn("row_idx", F.explode(F.sequence("row_min", "row_max")))
                cells = every.join(cells.select("window_id", "band", "col_idx", "row_idx", "value"), ["window_id", "band", "col_idx", "row_idx"], "left")
        cells = cells.where("col_idx between col_min and col_max and row_idx between row_min and row_max").select("window_id", "band", "col_idx", "row_idx", "value")
        return self._typed(cells)


@dataclass(frozen=True)
class MosaicView:
    """Views in the order of their priority: the first value that is not NoData counts."""

    views: tuple[RasterView, ...]
    srid: int
    grid: Grid
    name: str = ""

    @classmethod
    def of(cls, views: list[RasterView], srid: int, grid: Grid | None = None, name: str = "") -> MosaicView:
        """Sources are brought to the target's SRID and grid (by default the finest cell size over all of them), each by its own method."""
        if not views:
            raise GridError("a mosaic of nothing")
        if grid is None:
            grids = [v.grid_extent if v.crs == srid else resample.reprojected_grid(v.grid_extent, v.crs, srid) for v in views]
            grid = mosaic.combined_grid(grids)
        return cls(tuple(v.reproject_to_grid(srid, grid, v.method) if (v.crs != srid or not aligned(v.grid_extent, grid)) else v for v in views), srid, grid, name)

    @classmethod
    def unsafe(cls, views: list[RasterView], srid: int = 3857, grid: Grid | None = None) -> MosaicView:
        """No alignment: the caller vouches for it."""
        return cls(tuple(views), srid, grid or views[0].grid_extent)

    @property
    def bands(self) -> int:
        return self.views[0].bands

    @property
    def cell_type(self) -> str:
        return max((v.target_type or v.cell_type for v in self.views), key=CELL_TYPES.index)

    def resolutions(self) -> list[Grid]:
        return [r for v in self.views for r in v.resolutions()]

    def metadata(self) -> dict:
        return {"name": self.name, "srid": self.srid, "band_count": self.bands, "cell_type": self.cell_type, "cols": self.grid.cols, "rows": self.grid.rows, "sources": [v.metadata() for v in self.views]}

    def convert(self, cell_type: str) -> MosaicView:
        return replace(self, views=tuple(v.convert(cell_type) for v in self.views))

    def resample_to_grid(self, grid: Grid, method: str = "nearest") -> MosaicView:
        return replace(self, views=tuple(v.resample_to_grid(grid, method) for v in self.views), grid=grid.snapped(self.grid.extent))

    def reproject(self, srid: int, method: str = "nearest") -> MosaicView:
        grid = resample.reprojected_grid(self.grid, self.srid, srid)
        return replace(self, views=tuple(v.reproject_to_grid(srid, grid, method) for v in self.views), srid=srid, grid=grid)

    def read(self, extent: Extent | None = None, bounds: Bounds | None = None, bands: tuple[int, ...] | None = None) -> DataFrame:
        """Cells on the mosaic's grid; sources that the window misses are left out of the plan."""
        if bounds is not None:
            extent = self.grid.extent_for(bounds)
        parts = []
        for priority, v in enumerate(self.views):
            window = None if extent is None else v.grid_extent.bounds_for(extent)
            if window is not None:
                window = v.grid_extent.bounds.intersection(window)
                if window is None:
                    continue
            own, e = v.grid_extent, self.grid.extent
            dx, dy = round((own.extent.xmin - e.xmin) / self.grid.cw), round((e.ymax - own.extent.ymax) / self.grid.ch)
            parts.append(mosaic.shifted(v.cells(window, bands), dx, dy).withColumn("priority", F.lit(priority)))
        if not parts:
            return self.views[0].cells(None, bands).where("false")
        return mosaic.merge(parts)


def aligned(a: Grid, b: Grid) -> bool:
    """Same cell size, and borders that fall on borders."""
    off = ((a.extent.xmin - b.extent.xmin) / b.cw, (b.extent.ymax - a.extent.ymax) / b.ch)
    return abs(a.cw - b.cw) < 1e-9 and abs(a.ch - b.ch) < 1e-9 and all(abs(v - round(v)) < 1e-6 for v in off)


def overview_level(grids: list[Grid], cw: float, strategy: str = "auto_higher") -> int:
    """Level of the pyramid for a target cell width: the coarsest that is at least as fine ("auto_higher"), the finest that is
    coarser ("auto_lower"), or the base."""
    finer = [i for i, x in enumerate(grids) if x.cw <= cw + 1e-12]
    if strategy == "base":
        return 0
    if strategy == "auto_lower":
        coarser = [i for i, x in enumerate(grids) if x.cw >= cw - 1e-12]
        return min(coarser, key=lambda i: grids[i].cw, default=len(grids) - 1)
    return max(finer, key=lambda i: grids[i].cw, default=0)


def explode_tiles(tiles: DataFrame, *keep: str) -> DataFrame:
    """Long form of a tile table."""
    out = tiles.select(*keep, "tcol", "trow", "band", F.posexplode("cells").alias("at", "value"))
    return out.select(*keep, "band", (F.col("tcol") * SIDE + F.col("at") % SIDE).alias("col_idx"), (F.col("trow") * SIDE + F.floor(F.col("at") / SIDE)).alias("row_idx"), "value")


def in_bounds(cells: DataFrame, b: Bounds) -> DataFrame:
    return cells.where(F.col("col_idx").between(b.col_min, b.col_max) & F.col("row_idx").between(b.row_min, b.row_max))


def map_cells(tiles: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """A function of each cell, inside the tiles."""
    return tiles.withColumn("cells", F.transform("cells", f))


def transform_point(x: float, y: float, source: int, target: int) -> tuple[float, float]:
    return crs.transform_point(x, y, source, target)
