"""Mosaics: ordered merges of cells, and combined grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import CELL_TYPES, Grid, GridError


def shifted(cells: DataFrame, cols: int, rows: int) -> DataFrame:
    return cells.withColumns({"col_idx": F.col("col_idx") + cols, "row_idx": F.col("row_idx") + rows}) if cols or rows else cells


def merge(parts: list[DataFrame]) -> DataFrame:
    """Of cells with a priority: the value of the first source that has one there. Partial aggregation precedes the one shuffle."""
    every = reduce(DataFrame.unionByName, parts)
    # numbers only, so that the aggregation hashes: the value of the least priority that is not null
    return every.groupBy("band", "col_idx", "row_idx").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("priority"))).alias("value"))


def combined_grid(grids: list[Grid]) -> Grid:
    """The extents' envelope at the finest cell size."""
    finest = min(grids, key=lambda x: (max(x.cw, x.ch), x.cw, x.ch))
    extent = reduce(lambda a, b: a.combine(b), (x.extent for x in grids))
    return Grid.of_cells(extent, finest.cw, finest.ch)


def combine_catalog(catalog: DataFrame, *by: str) -> DataFrame:
    """The grid over all of a catalog's sources; equal cell sizes are required."""
    out = catalog.groupBy(*by).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("cw").alias("cw"), F.min("ch").alias("ch"),
                                   F.max("cw").alias("cw_hi"), F.max("ch").alias("ch_hi"))
    same = (F.col("cw") == F.col("cw_hi")) & (F.col("ch") == F.col("ch_hi"))
    checked = F.when(same, F.round((F.col("xmax") - F.col("xmin")) / F.col("cw")).cast("long")).otherwise(F.raise_error(F.lit("grids of different cell sizes")).cast("long"))
    return out.select(*by, "xmin", "ymin", "xmax", "ymax", checked.alias("cols"), F.round((F.col("ymax") - F.col("ymin")) / F.col("ch")).cast("long").alias("rows"))


def finest_grid(catalog: DataFrame) -> DataFrame:
    """The mosaic's grid: the envelope at the finest cell size of the catalog."""
    out = catalog.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("cw").alias("cw"), F.min("ch").alias("ch"))
    return out.select("xmin", "ymin", "xmax", "ymax", F.round((F.col("xmax") - F.col("xmin")) / F.col("cw")).cast("long").alias("cols"), F.round((F.col("ymax") - F.col("ymin")) / F.col("ch")).cast("long").alias("rows"))


def type_union(catalog: DataFrame) -> DataFrame:
    """The widest cell type of the catalog."""
    names = F.array(*map(F.lit, CELL_TYPES))
    return catalog.agg(F.max("type_rank").alias("r")).select(F.element_at(names, F.col("r") + 1).alias("cell_type"))


__all__ = ["GridError", "combine_catalog", "combined_grid", "finest_grid", "merge", "shifted", "type_union"]
