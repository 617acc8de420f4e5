"""Sources with warp options: what is read, onto which grid, by which method, as which cell type.

A source without options is the file as it is ("source"); with options it is a
warped data set, which here is a plan over the view: no pixel is moved before a
read. Options that are set later win over earlier ones, as when option lists
are joined. A conversion fixes the grid that the data set has by then. Integer
cells have no value for what is missing: without a NoData value it is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ..operators import resample
from ..plans.view import RasterView
from ..types import CELL_RANGE, CELL_TYPES, Extent, Grid, GridError

#: Names by which methods are known to warp tools.
METHODS = {"near": "nearest", "nearest": "nearest", "bilinear": "bilinear", "average": "average", "sum": "sum", "min": "min", "max": "max", "mode": "mode", "med": "median", "median": "median"}


@dataclass(frozen=True)
class WarpOptions:
    """Target SRID, extent, cell size or dimensions, method, cell type and NoData; None leaves a thing as it is."""

    srid: int | None = None
    extent: Extent | None = None
    cell_size: tuple[float, float] | None = None
    dimensions: tuple[int, int] | None = None
    method: str | None = None
    cell_type: str | None = None
    nodata: float | None = None
    aligned: bool = False

    def combine(self, later: WarpOptions) -> WarpOptions:
        """These options with those of ``later`` that are set; cell size and dimensions exclude each other."""
        own = {f.name: getattr(later, f.name) if getattr(later, f.name) not in (None, False) else getattr(self, f.name) for f in fields(self)}
        if later.cell_size is not None:
            own["dimensions"] = None
        if later.dimensions is not None:
            own["cell_size"] = None
        return WarpOptions(**own)


@dataclass(frozen=True)
class WarpSource:
    """A view and the options over it."""

    base: RasterView
    options: WarpOptions = WarpOptions()

    @property
    def dataset_type(self) -> str:
        return "source" if self.options == WarpOptions() else "warped"

    def grid(self) -> Grid:
        o, view = self.options, self.base
        srid = o.srid or view.crs
        grid = view.grid_extent if srid == view.crs else resample.reprojected_grid(view.grid_extent, view.crs, srid)
        if o.dimensions:
            return Grid(o.extent or grid.extent, *o.dimensions)
        if not (o.extent or o.cell_size):
            return grid
        cw, ch = o.cell_size or (grid.cw, grid.ch)
        extent = o.extent or grid.extent
        if o.aligned:  # borders are multiples of the cell size
            return Grid.of_cells(Extent(0.0, 0.0, cw, ch), cw, ch).snapped(extent)
        made = Grid.of_cells(extent, cw, ch)
        if made.cols < 1 or made.rows < 1:
            raise GridError("an extent smaller than a cell")
        return made

    def view(self) -> RasterView:
        o = self.options
        method = METHODS[o.method or "near"]
        view, grid, srid = self.base, self.grid(), o.srid or self.base.crs
        if o.nodata is not None:
            view = replace(view, nodata=o.nodata)
        if srid != view.crs:
            view = view.reproject_to_region(srid, grid, method)
        elif grid != view.grid_extent:
            view = view.resample_to_region(grid, method)
        if o.cell_type:
            view = view.convert("uint8" if o.cell_type == "int8" else o.cell_type)  # a byte has no sign there
            if o.cell_type in CELL_RANGE and view.nodata is None:
                view = replace(view, missing=0.0)
        return view

    # -- transforms: new options, nothing read ---------------------------------------

    def warp(self, later: WarpOptions) -> WarpSource:
        return replace(self, options=self.options.combine(later))

    def reproject(self, srid: int, method: str = "near") -> WarpSource:
        own, extent = self.options.srid or self.base.crs, self.options.extent
        if srid == own:
            return self
        return self.warp(WarpOptions(srid=srid, extent=extent and resample.reprojected_extent(extent, own, srid), method=method))

    def resample(self, cols: int, rows: int, method: str = "near") -> WarpSource:
        return self.warp(WarpOptions(dimensions=(cols, rows), method=method))

    def resample_to_grid(self, cw: float, ch: float, method: str = "near") -> WarpSource:
        return self.warp(WarpOptions(cell_size=(cw, ch), aligned=True, method=method))

    def resample_to_region(self, region: Grid, method: str = "near") -> WarpSource:
        return self.warp(WarpOptions(extent=region.extent, dimensions=(region.cols, region.rows), method=method))

    def convert(self, cell_type: str) -> WarpSource:
        if cell_type == "bit" or cell_type not in CELL_TYPES:
            raise ValueError(f"{cell_type} cells are not supported")
        grid = self.grid()
        extent = grid.extent if self.options.aligned else None  # dimensions alone would stretch aligned cells over the extent before
        return self.warp(WarpOptions(cell_type=cell_type, extent=extent, dimensions=(grid.cols, grid.rows)))

    def metadata(self) -> dict:
        return self.view().metadata() | {"dataset": self.dataset_type}

    def read(self, *args, **kw):
        return self.view().read(*args, **kw)
