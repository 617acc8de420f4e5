"""Rasters and vectors derived from the supplied tables, and tile tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Bounds, Extent, Grid

#: Cells along a side of a tile, and tiles in a row of the embeddings raster.
SIDE, ACROSS = 8, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Grid of the embeddings raster; only the greatest id is read, which Parquet keeps in its footers."""
    top = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    rows = 0 if top is None else (top // ACROSS + 1) * SIDE
    return Grid(Extent(0.0, 0.0, float(ACROSS * SIDE), float(rows)), ACROSS * SIDE, rows)


def embedding_tiles(spark: SparkSession, sf_dir: str, bands: tuple[int, ...] = (0, 1), keys: Bounds | None = None) -> DataFrame:
    """Tiles of 8x8 cells: band 0 the embedding, band 1 its label in every cell.

    A range of tile rows is a range of ids, so it is pushed down to the scan.
    """
    df = table(spark, sf_dir, "embeddings")
    if keys is not None:
        df = df.where(F.col("vec_id").between(keys.row_min * ACROSS, keys.row_max * ACROSS + ACROSS - 1))
    key = [(F.col("vec_id") % ACROSS).alias("tcol"), F.floor(F.col("vec_id") / ACROSS).alias("trow")]
    parts = []
    if 0 in bands:
        parts.append(df.select(*key, F.lit(0).alias("band"), F.col("embedding").cast("array<double>").alias("cells")))
    if 1 in bands:
        parts.append(df.select(*key, F.lit(1).alias("band"), F.array_repeat(F.col("label").cast("double"), SIDE * SIDE).alias("cells")))
    if not parts:
        return df.select(*key, F.lit(0).alias("band"), F.lit(None).cast("array<double>").alias("cells")).where("false")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x64 cells: the greatest quantity (band 0) and the least (band 1) by part and supplier modulo 64."""
    base = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("col_idx"), (F.col("l_suppkey") % 64).alias("row_idx")).agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"))
    return base.select(F.inline(F.array(F.struct(F.lit(0).alias("band"), "col_idx", "row_idx", F.col("hi").alias("value")), F.struct(F.lit(1).alias("band"), "col_idx", "row_idx", F.col("lo").alias("value")))))


def holes(cells: DataFrame) -> DataFrame:
    """NoData (null) by a fixed rule of position."""
    return cells.withColumn("value", F.when((F.col("col_idx") * 7 + F.col("row_idx") * 13) % 5 != 0, F.col("value")))


def points(spark: SparkSession, sf_dir: str, nulls: bool = True) -> DataFrame:
    """(id, name, x, y): a point for each customer; every seventh is null if asked for."""
    k = F.col("c_custkey")
    here = (k % 7 != 0) if nulls else F.lit(True)
    x, y = (k * 37 % 3600) / 10 - 180, (k * k * 53 % 1700) / 10 - 85
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(here, x).alias("x"), F.when(here, y).alias("y"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, col_min, row_min, col_max, row_max): a 16x16 window for each customer, some beyond the grid."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer")
    c, r = (k * 7) % 210 - 10, (k * 11) % 170 - 10
    return df.select(k.alias("window_id"), c.alias("col_min"), r.alias("row_min"), (c + 15).alias("col_max"), (r + 15).alias("row_max"))


def nation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of sources from the nations: grid, srid, cell type, tags of the source, of its two bands and by domain."""
    k = F.col("n_nationkey")
    size = F.when(k % 3 == 0, 2.0).otherwise(1.0)
    cols, rows = (10 + k % 7).cast("long"), (20 + k % 5).cast("long")
    x0, y0 = (k * 3).cast("double"), (k % 4 * 5).cast("double")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), k.cast("int").alias("priority"), F.when(F.col("n_regionkey") % 2 == 0, 4326).otherwise(3857).alias("srid"), (1 + k % 3).cast("int").alias("band_count"),
        (k % 8).cast("int").alias("type_rank"), x0.alias("xmin"), y0.alias("ymin"), (x0 + cols * size).alias("xmax"), (y0 + rows * size).alias("ymax"), cols.alias("cols"), rows.alias("rows"), size.alias("cw"), size.alias("ch"),
        F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("key"), k.cast("string")).alias("tags"),
        F.array(F.create_map(F.lit("band"), F.lit("first")), F.create_map(F.lit("band"), F.lit("second"), F.lit("of"), F.col("n_name"))).alias("band_tags"),
        F.create_map(F.lit(""), F.create_map(F.lit("AREA"), F.lit("Area")), F.lit("TIFF"), F.create_map(F.lit("KEY"), k.cast("string"))).alias("domains"))
