"""Registered queries over the supplied tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import crs, geometry as geo, grid as g, shapes, wkb
from .operators import convert, mosaic, resample, vector
from .plans.view import SIDE, MosaicView, RasterView, explode_tiles, map_cells
from .sources import cities, geotiff, tables
from .sources.warp import WarpOptions, WarpSource
from .types import Bounds, Extent, Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- relations of the SQL side -------------------------------------------------

BASE = """
dims AS (SELECT 200::BIGINT AS cols, (max(vec_id) // 25 + 1) * 8 AS rows FROM embeddings),
band0 AS (SELECT 0 AS band, (vec_id % 25) * 8 + (i - 1) % 8 AS col_idx, (vec_id // 25) * 8 + (i - 1) // 8 AS row_idx, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)),
band1 AS (SELECT 1 AS band, (vec_id % 25) * 8 + (i - 1) % 8 AS col_idx, (vec_id // 25) * 8 + (i - 1) // 8 AS row_idx, label::DOUBLE AS value FROM embeddings, range(1, 65) t(i)),
both_bands AS (SELECT * FROM band0 UNION ALL SELECT * FROM band1),
gaps AS (SELECT band, col_idx, row_idx, CASE WHEN (col_idx * 7 + row_idx * 13) % 5 <> 0 THEN value END AS value FROM band0)"""
POINTS = """
pts AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 37 % 3600) / 10e0 - 180 END AS x,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * c_custkey * 53 % 1700) / 10e0 - 85 END AS y FROM customer)"""
WINDOWS = """
w AS (SELECT c_custkey AS window_id, (c_custkey * 7) % 210 - 10 AS col_min, (c_custkey * 11) % 170 - 10 AS row_min, (c_custkey * 7) % 210 + 5 AS col_max, (c_custkey * 11) % 170 + 5 AS row_max
  FROM customer)"""
CATALOG = """
cat AS (SELECT n_name AS name, n_nationkey AS priority, CASE WHEN n_regionkey % 2 = 0 THEN 4326 ELSE 3857 END AS srid, 1 + n_nationkey % 3 AS band_count, n_nationkey % 8 AS type_rank,
  (n_nationkey * 3)::DOUBLE AS xmin, (n_nationkey % 4 * 5)::DOUBLE AS ymin, (10 + n_nationkey % 7)::BIGINT AS cols, (20 + n_nationkey % 5)::BIGINT AS rows,
  CASE WHEN n_nationkey % 3 = 0 THEN 2e0 ELSE 1e0 END AS cw, n_nationkey, n_regionkey FROM nation),
cat2 AS (SELECT *, xmin + cols * cw AS xmax, ymin + rows * cw AS ymax FROM cat)"""


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def raster(spark: SparkSession, sf_dir: str, bands: int = 1) -> RasterView:
    return RasterView("embeddings", lambda b, rows: tables.embedding_tiles(spark, sf_dir, b, rows), tables.embeddings_grid(spark, sf_dir), bands=bands)


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.holes(raster(spark, sf_dir).cells())


# ---- reads -----------------------------------------------------------------------

#: A window with edges off the cell borders, and one with edges on them.
EXTENT = Extent(30.5, 40.25, 62.5, 75.75)


@query(f"""WITH {BASE} SELECT band, col_idx, row_idx, value FROM band0, dims
WHERE col_idx BETWEEN 30 AND 62 AND row_idx BETWEEN floor(rows - 75.75)::BIGINT AND ceil(rows - 40.25)::BIGINT - 1""")
def window_read_extent(spark, sf_dir):
    return raster(spark, sf_dir).read(EXTENT)


@query("SELECT vec_id % 25 AS tcol, vec_id // 25 AS trow, len(embedding)::BIGINT AS n_cells, len(list_filter(embedding, lambda x: x IS NULL))::BIGINT AS n_null FROM embeddings")
def scan_tiles(spark, sf_dir):
    return tables.embedding_tiles(spark, sf_dir, (0,)).select("tcol", "trow", F.size("cells").cast("long").alias("n_cells"), F.size(F.filter("cells", lambda x: x.isNull())).cast("long").alias("n_null"))


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM both_bands WHERE col_idx BETWEEN 16 AND 47 AND row_idx BETWEEN 24 AND 39")
def window_read_bounds(spark, sf_dir):
    return raster(spark, sf_dir, 2).read(bounds=Bounds(16, 24, 47, 39))


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM band0 WHERE col_idx BETWEEN 3 AND 34 AND row_idx BETWEEN 5 AND 36")
def window_read_unaligned(spark, sf_dir):
    return raster(spark, sf_dir).read(bounds=Bounds(3, 5, 34, 36))


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM band0, dims WHERE col_idx BETWEEN 10 AND 19 AND row_idx BETWEEN rows - 30 AND rows - 21")
def window_read_shrunk(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    e = Extent(9.75, 19.75, 20.25, 30.25)  # a quarter of a cell too wide on every side
    inner = Extent(e.xmin + grid.cw / 2, e.ymin + grid.ch / 2, e.xmax - grid.cw / 2, e.ymax - grid.ch / 2)
    return raster(spark, sf_dir).read(inner)


@query(f"""WITH {BASE} SELECT band, col_idx, row_idx, value FROM band0, dims WHERE col_idx BETWEEN 100 AND 119
AND row_idx BETWEEN floor(rows / 2e0 - rows / 10e0 + 1e-7)::BIGINT AND ceil(rows / 2e0 - 1e-7)::BIGINT - 1""")
def window_read_subextent(spark, sf_dir):
    view = raster(spark, sf_dir)
    e = view.grid.extent
    x, y = (e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2
    return view.read(Extent(x, y, x + e.width / 10, y + e.height / 10))


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM band1 WHERE col_idx < 40 AND row_idx < 40")
def band_select(spark, sf_dir):
    return raster(spark, sf_dir, 2).read(bounds=Bounds(0, 0, 39, 39), bands=(1,))


@query(f"WITH {BASE} SELECT band, count(*) AS n, round(sum(value), 6) + 0e0 AS total FROM both_bands GROUP BY band")
def read_full(spark, sf_dir):
    return raster(spark, sf_dir, 2).read().groupBy("band").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("total"))


def _per_window(cells: DataFrame) -> DataFrame:
    return cells.groupBy("window_id").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("sum_value"))


_MANY = f"""WITH {BASE}, {WINDOWS} SELECT window_id, count(*) AS n, round(sum(value), 6) + 0e0 AS sum_value FROM w JOIN band0 b
ON b.col_idx BETWEEN w.col_min AND w.col_max AND b.row_idx BETWEEN w.row_min AND w.row_max GROUP BY window_id"""


@query(_MANY)
def multi_window_bounds(spark, sf_dir):
    return _per_window(raster(spark, sf_dir).read_many(tables.windows(spark, sf_dir)))


@query(_MANY)
def multi_window_extents(spark, sf_dir):
    view = raster(spark, sf_dir)
    w = tables.windows(spark, sf_dir)
    e = w.select("window_id", *[c.alias(k) for k, c in g.bounds_to_extent(view.grid, *(F.col(c) for c in ("col_min", "row_min", "col_max", "row_max"))).items()])
    back = e.select("window_id", *[c.alias(k) for k, c in g.extent_to_bounds(view.grid, *(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).items()])
    return _per_window(view.read_many(back))


@query(f"WITH {BASE} SELECT band, count(value) AS n_cells, round(sum(value), 6) + 0e0 AS total FROM gaps GROUP BY band")
def sum_cells(spark, sf_dir):
    return gapped(spark, sf_dir).groupBy("band").agg(F.count("value").alias("n_cells"), (F.round(F.sum("value"), 6) + F.lit(0.0)).alias("total"))


@query(f"WITH {BASE} SELECT col_idx, row_idx, value * 2 + 1 AS value FROM band0")
def map_cells_twice(spark, sf_dir):
    return explode_tiles(map_cells(tables.embedding_tiles(spark, sf_dir, (0,)), lambda c: c * 2 + 1)).select("col_idx", "row_idx", "value")


QUERIES["map_cells"], SQL["map_cells"] = QUERIES.pop("map_cells_twice"), SQL.pop("map_cells_twice")


# ---- metadata and grids ------------------------------------------------------------

@query(f"""WITH {BASE} SELECT 'embeddings' AS name, 3857 AS srid, 2 AS bands, cols, rows, cols * rows AS size, 0e0 AS xmin, 0e0 AS ymin, cols::DOUBLE AS xmax, rows::DOUBLE AS ymax, 1e0 AS cw, 1e0 AS ch,
0::BIGINT AS col_min, 0::BIGINT AS row_min, cols - 1 AS col_max, rows - 1 AS row_max, 'float64' AS cell_type FROM dims
UNION ALL SELECT 'lineitem', 3857, 2, 64, 64, 4096, 0e0, 0e0, 64e0, 64e0, 1e0, 1e0, 0, 0, 63, 63, 'float64'""")
def meta_summary(spark, sf_dir):
    views = [raster(spark, sf_dir, 2), RasterView("lineitem", lambda b, r: None, Grid(Extent(0.0, 0.0, 64.0, 64.0), 64, 64), bands=2)]
    rows = []
    for m in (v.metadata() for v in views):
        e, b = m["extent"], m["bounds"]
        rows.append((m["name"], m["srid"], m["band_count"], m["cols"], m["rows"], m["size"], e.xmin, e.ymin, e.xmax, e.ymax, m["cw"], m["ch"], b.col_min, b.row_min, b.col_max, b.row_max, m["cell_type"]))
    return spark.createDataFrame(rows, "name string, srid int, bands int, cols long, rows long, size long, xmin double, ymin double, xmax double, ymax double, cw double, ch double, "
                                       "col_min long, row_min long, col_max long, row_max long, cell_type string")


def _pyramid(spark, sf_dir) -> list[Grid]:
    base = tables.embeddings_grid(spark, sf_dir)
    return [Grid(base.extent, -(-base.cols // 2**k), -(-base.rows // 2**k)) for k in range(3)]


@query(f"""WITH {BASE} SELECT 'embeddings' AS name, k::INT AS level, cols // (1 << k) AS cols, rows // (1 << k) AS rows, (1 << k)::DOUBLE AS cw, (1 << k)::DOUBLE AS ch FROM dims, range(3) t(k)""")
def meta_resolutions(spark, sf_dir):
    grids = _pyramid(spark, sf_dir)
    view = RasterView("embeddings", lambda b, r: None, grids[0], overviews=tuple(grids[1:]))
    rows = [("embeddings", k, x.cols, x.rows, x.cw, x.ch) for k, x in enumerate(view.resolutions())]
    return spark.createDataFrame(rows, "name string, level int, cols long, rows long, cw double, ch double")


@query("""SELECT n_name AS name, -1 AS band, unnest(['region', 'key']) AS key, unnest([n_regionkey::VARCHAR, n_nationkey::VARCHAR]) AS value FROM nation
UNION ALL SELECT n_name, 0, 'band', 'first' FROM nation
UNION ALL SELECT n_name, 1, unnest(['band', 'of']), unnest(['second', n_name]) FROM nation""")
def meta_attributes(spark, sf_dir):
    cat = tables.nation_catalog(spark, sf_dir)
    none = F.create_map().cast("map<string,string>")
    band = F.explode(F.array(*[F.lit(b) for b in (-1, 0, 1, 2)]))  # -1 names the source; there is no band 2
    tags = F.when(F.col("band") < 0, F.col("tags")).otherwise(F.coalesce(F.get("band_tags", F.col("band")), none))
    return cat.select("name", "tags", "band_tags", band.alias("band")).select("name", "band", F.explode(tags).alias("key", "value"))


@query("SELECT n_name AS name, 'TIFF' AS domain, 'KEY' AS key, n_nationkey::VARCHAR AS value FROM nation")
def meta_domain(spark, sf_dir):
    cat = tables.nation_catalog(spark, sf_dir)
    chosen = F.map_filter("domains", lambda k, _: k.isin("TIFF", "XMP"))
    return cat.select("name", F.explode(chosen).alias("domain", "entries")).select("name", "domain", F.explode("entries").alias("key", "value"))


@query(f"""WITH {BASE}, {WINDOWS} SELECT window_id, floor(col_min + 0.5 + 1e-7)::BIGINT AS col_min, floor(row_min + 0.25 + 1e-7)::BIGINT AS row_min, ceil(col_max + 1 - 1e-7)::BIGINT - 1 AS col_max, ceil(row_max + 0.75 - 1e-7)::BIGINT - 1 AS row_max FROM w""")
def extent_to_bounds(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    e = grid.extent
    w = tables.windows(spark, sf_dir).select("window_id", (F.col("col_min") + 0.5).alias("xmin"), (e.ymax - F.col("row_max") - 0.75).alias("ymin"), (F.col("col_max") + 1.0).alias("xmax"), (e.ymax - F.col("row_min") - 0.25).alias("ymax"))
    return w.select("window_id", *[c.alias(k) for k, c in g.extent_to_bounds(grid, *(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).items()])


@query(f"WITH {BASE}, {WINDOWS} SELECT window_id, col_min::DOUBLE AS xmin, (rows - row_max - 1)::DOUBLE AS ymin, (col_max + 1)::DOUBLE AS xmax, (rows - row_min)::DOUBLE AS ymax FROM w, dims")
def bounds_to_extent(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    return tables.windows(spark, sf_dir).select("window_id", *[c.alias(k) for k, c in g.bounds_to_extent(grid, *(F.col(c) for c in ("col_min", "row_min", "col_max", "row_max"))).items()])


@query(f"""WITH {BASE}, {WINDOWS} SELECT window_id, greatest(col_min, 0) AS col_min, greatest(row_min, 0) AS row_min, least(col_max, cols - 1) AS col_max, least(row_max, rows - 1) AS row_max FROM w, dims
WHERE col_max >= 0 AND row_max >= 0 AND col_min < cols AND row_min < rows""")
def bounds_intersection(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    cut = g.intersect(grid, {c: F.col(c) for c in ("col_min", "row_min", "col_max", "row_max")})
    return tables.windows(spark, sf_dir).select("window_id", *[c.alias(k) for k, c in cut.items()]).where("col_min <= col_max and row_min <= row_max")


@query(f"""WITH {BASE} SELECT c AS tile_col, r AS tile_row, c * 48 AS col_min, r * 48 AS row_min, least((c + 1) * 48, cols) - 1 AS col_max, least((r + 1) * 48, rows) - 1 AS row_max
FROM dims, range(0, 1000) a(c), range(0, 1000) b(r) WHERE c * 48 < cols AND r * 48 < rows""")
def grid_split(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    one = spark.range(1).select(F.lit(grid.cols).cast("long").alias("cols"), F.lit(grid.rows).cast("long").alias("rows"))
    return g.split(one, 48, 48).select("tile_col", "tile_row", "col_min", "row_min", "col_max", "row_max")


#: Layout of 32-cell tiles; the extent whose keys are asked for.
LAYOUT, ASKED = 32, (20.0, 15.0, 120.0, 100.0)


def _layout(spark, sf_dir) -> DataFrame:
    grid = tables.embeddings_grid(spark, sf_dir)
    x0, y0, x1, y1 = ASKED
    top = grid.extent.ymax
    one = spark.range(1).select(F.explode(F.sequence(F.lit(int(x0 // LAYOUT)).cast("long"), F.lit(int(x1 // LAYOUT)).cast("long"))).alias("key_col"))
    rows = F.sequence(F.lit(int((top - y1) // LAYOUT)).cast("long"), F.lit(int((top - y0) // LAYOUT)).cast("long"))
    keys = one.withColumn("key_row", F.explode(rows))
    return keys.select("key_col", "key_row", (F.col("key_col") * float(LAYOUT)).alias("xmin"), (top - (F.col("key_row") + 1) * float(LAYOUT)).alias("ymin"),
                       ((F.col("key_col") + 1) * float(LAYOUT)).alias("xmax"), (top - F.col("key_row") * float(LAYOUT)).alias("ymax"))


_KEYS = f"""{BASE}, keys AS (SELECT c AS key_col, r AS key_row, c * 32e0 AS xmin, rows - (r + 1) * 32e0 AS ymin, (c + 1) * 32e0 AS xmax, rows - r * 32e0 AS ymax
FROM dims, range(0, 4) a(c), range(0, 1000) b(r) WHERE r BETWEEN floor((rows - 100) / 32e0)::BIGINT AND floor((rows - 15) / 32e0)::BIGINT)"""


@query(f"WITH {_KEYS} SELECT key_col, key_row, xmin, ymin, xmax, ymax FROM keys")
def layout_keys(spark, sf_dir):
    return _layout(spark, sf_dir)


@query(f"""WITH {_KEYS}, numbered AS (SELECT *, row_number() OVER (ORDER BY key_row, key_col) AS n FROM keys),
chosen AS (SELECT * FROM numbered WHERE n % 5 = 1 ORDER BY n LIMIT 100)
SELECT c.n AS rank, key_col, key_row, count(b.value) AS n FROM chosen c, dims, band0 b WHERE b.col_idx >= xmin AND b.col_idx < xmax AND b.row_idx >= rows - ymax AND b.row_idx < rows - ymin GROUP BY ALL""")
def every_kth_window(spark, sf_dir):
    view = raster(spark, sf_dir)
    numbered = _layout(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy("key_row", "key_col")).cast("long"))
    chosen = numbered.where("rank % 5 = 1").orderBy("rank").limit(100)
    b = g.extent_to_bounds(view.grid, *(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    read = view.read_many(chosen.select(F.col("rank").alias("window_id"), *[c.alias(k) for k, c in b.items()]))
    counts = read.groupBy(F.col("window_id").alias("rank")).agg(F.count("value").alias("n"))
    return chosen.join(counts, "rank").select("rank", "key_col", "key_row", "n")


# ---- conversion --------------------------------------------------------------------

@query(f"WITH {BASE} SELECT band, col_idx, row_idx, (CASE WHEN value < 0 THEN -floor(-value * 10 + 0.5) ELSE floor(value * 10 + 0.5) END) + 0e0 AS value FROM both_bands")
def convert_int(spark, sf_dir):
    return convert.convert(raster(spark, sf_dir, 2).read().withColumn("value", F.col("value") * 10), "int32")


@query("""WITH c AS (SELECT 0 AS band, l_partkey % 64 AS col_idx, l_suppkey % 64 AS row_idx, max(l_quantity) * 7.3e0 - 60 AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT 9, unnest([0, 1, 2, 3]), 0, unnest([-1e0, 275e0, 122.492e0, 64.1e0]))
SELECT band, col_idx, row_idx, least(255e0, greatest(0e0, CASE WHEN value < 0 THEN -floor(-value + 0.5) ELSE floor(value + 0.5) END)) + 0e0 AS value FROM c""")
def convert_u8_clamp(spark, sf_dir):
    cells = tables.lineitem_cells(spark, sf_dir).where("band = 0").withColumn("value", F.col("value") * 7.3 - 60)
    more = spark.range(4).select(F.lit(9).alias("band"), F.col("id").alias("col_idx"), F.lit(0).cast("long").alias("row_idx"), F.get(F.array(*map(F.lit, (-1.0, 275.0, 122.492, 64.1))), F.col("id").cast("int")).alias("value"))
    return convert.convert_byte_only(cells.unionByName(more), "int8")


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, nullif(value, 3e0) AS value FROM band1")
def convert_nodata(spark, sf_dir):
    return convert.nodata(raster(spark, sf_dir, 2).read(bands=(1,)), 3.0)


# ---- resampling ----------------------------------------------------------------------

def _nearest_sql(target: str, source: str = "band0") -> str:
    """Inverse mapping: ``target`` gives tcols, trows, tx, ty (upper left), tcw, tch; the source is the unit grid."""
    return f"""t AS ({target}),
tc AS (SELECT c, r, floor(tx + (c + 0.5) * tcw)::BIGINT AS col_idx, floor(rows - (ty - (r + 0.5) * tch))::BIGINT AS row_idx FROM t, dims, range(0, 4000) a(c), range(0, 4000) b(r) WHERE c < tcols AND r < trows),
out_cells AS (SELECT band, c AS col_idx, r AS row_idx, value FROM tc JOIN {source} s USING (col_idx, row_idx))"""


@query(f"WITH {BASE}, {_nearest_sql('SELECT 75 AS tcols, 50 AS trows, 0e0 AS tx, rows::DOUBLE AS ty, 200 / 75e0 AS tcw, rows / 50e0 AS tch FROM dims')} SELECT * FROM out_cells")
def resample_dims(spark, sf_dir):
    return raster(spark, sf_dir).resample(75, 50).read()


@query(f"WITH {BASE}, {_nearest_sql('SELECT 81 AS tcols, ceil((rows + 1.3e0) / 2.5e0)::BIGINT AS trows, -1.2e0 AS tx, rows + 1.3e0 AS ty, 2.5e0 AS tcw, 2.5e0 AS tch FROM dims')} SELECT * FROM out_cells")
def resample_to_grid(spark, sf_dir):
    top = tables.embeddings_grid(spark, sf_dir).rows + 1.3
    grid = Grid.of_cells(Extent(-1.2, top - 1000 * 2.5, -1.2 + 81 * 2.5, top), 2.5, 2.5)
    return raster(spark, sf_dir).resample_to_grid(grid).read()


@query(f"""WITH {BASE}, {_nearest_sql('SELECT 30 AS tcols, 20 AS trows, -20.3e0 AS tx, rows + 11.7e0 AS ty, 3e0 AS tcw, 3e0 AS tch FROM dims')}
SELECT 0 AS band, tc.c AS col_idx, tc.r AS row_idx, value FROM tc LEFT JOIN band0 USING (col_idx, row_idx)""")
def resample_to_region(spark, sf_dir):
    top = tables.embeddings_grid(spark, sf_dir).rows + 11.7
    return raster(spark, sf_dir).resample_to_region(Grid(Extent(-20.3, top - 60, 69.7, top), 30, 20)).read()


@query(f"WITH {BASE}, {_nearest_sql('SELECT 250 AS tcols, (rows / 0.8e0)::BIGINT AS trows, 0e0 AS tx, rows::DOUBLE AS ty, 0.8e0 AS tcw, 0.8e0 AS tch FROM dims')} SELECT * FROM out_cells")
def resample_cellsize(spark, sf_dir):
    return raster(spark, sf_dir).resample_to_cell_size(0.8, 0.8).read()


@query(f"WITH {BASE} SELECT band, col_idx // 4 AS col_idx, row_idx // 4 AS row_idx, round(avg(value), 9) + 0e0 AS value FROM gaps GROUP BY ALL HAVING count(value) > 0")
def resample_average(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    out = resample.resample(gapped(spark, sf_dir), grid, Grid(grid.extent, grid.cols // 4, grid.rows // 4), "average")
    return out.withColumn("value", F.round("value", 9) + F.lit(0.0))


@query(f"WITH {BASE} SELECT band, col_idx // 4 AS col_idx, row_idx // 4 AS row_idx, max(value) AS value FROM band0 GROUP BY ALL")
def resample_max(spark, sf_dir):
    view = raster(spark, sf_dir)
    return view.resample(view.grid.cols // 4, view.grid.rows // 4, "max").read()


@query(f"""WITH {BASE}, n AS (SELECT band, col_idx // 5 AS col_idx, row_idx // 5 AS row_idx, value, count(*) AS n FROM band1 GROUP BY ALL)
SELECT band, col_idx, row_idx, value FROM n QUALIFY row_number() OVER (PARTITION BY band, col_idx, row_idx ORDER BY n DESC, value) = 1""")
def resample_mode(spark, sf_dir):
    view = raster(spark, sf_dir, 2)
    top = view.grid.extent.ymax  # blocks of 5x5 from the top, the last row of them lower where rows are left over
    return view.resample_to_grid(Grid(Extent(0.0, top - 5.0, 5.0, top), 1, 1), "mode").read(bands=(1,))


@query(f"""WITH {BASE}, tc AS (SELECT c, r, (c + 0.5) * 2.5e0 - 0.5 AS u, (r + 0.5) * (rows / 60e0) - 0.5 AS v FROM dims, range(0, 80) a(c), range(0, 60) b(r)),
near AS (SELECT c, r, i + floor(u)::BIGINT AS col_idx, j + floor(v)::BIGINT AS row_idx, (1 - abs(u - i - floor(u))) * (1 - abs(v - j - floor(v))) AS w FROM tc, range(0, 2) a(i), range(0, 2) b(j))
SELECT band, c AS col_idx, r AS row_idx, round(sum(w * value) / sum(w), 9) + 0e0 AS value FROM near JOIN gaps USING (col_idx, row_idx) WHERE value IS NOT NULL AND w > 0 GROUP BY band, c, r""")
def resample_bilinear(spark, sf_dir):
    grid = tables.embeddings_grid(spark, sf_dir)
    out = resample.resample(gapped(spark, sf_dir), grid, Grid(grid.extent, 80, 60), "bilinear")
    return out.withColumn("value", F.round("value", 9) + F.lit(0.0))


@query("""WITH levels AS (SELECT k AS level, (1 << k)::DOUBLE AS cw FROM range(3) t(k)), targets AS (SELECT unnest([0.5e0, 1e0, 1.9e0, 2e0, 3.5e0, 9e0]) AS target)
SELECT target, coalesce(max(level) FILTER (cw <= target), 0)::INT AS level FROM targets, levels GROUP BY target""")
def overview_select(spark, sf_dir):
    grids = _pyramid(spark, sf_dir)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x.cw).alias("cw")) for k, x in enumerate(grids)])
    targets = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.9, 2.0, 3.5, 9.0)))).alias("target"))
    return targets.select("target", F.coalesce(F.array_max(F.transform(F.filter(levels, lambda s: s["cw"] <= F.col("target")), lambda s: s["level"])), F.lit(0)).alias("level"))


# ---- mosaics ---------------------------------------------------------------------------

@query(f"WITH {CATALOG} SELECT cw, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, round((max(xmax) - min(xmin)) / cw)::BIGINT AS cols, round((max(ymax) - min(ymin)) / cw)::BIGINT AS rows FROM cat2 GROUP BY cw")
def grid_extent_combine(spark, sf_dir):
    return mosaic.combine_catalog(tables.nation_catalog(spark, sf_dir).withColumn("size", F.col("cw")), "size").withColumnRenamed("size", "cw")


@query(f"WITH {CATALOG} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, round((max(xmax) - min(xmin)) / min(cw))::BIGINT AS cols, round((max(ymax) - min(ymin)) / min(cw))::BIGINT AS rows FROM cat2")
def mosaic_grid_extent(spark, sf_dir):
    return mosaic.finest_grid(tables.nation_catalog(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT (['bit', 'uint8', 'int8', 'uint16', 'int16', 'int32', 'float32', 'float64'])[max(type_rank) + 1] AS cell_type FROM cat2")
def mosaic_celltype_union(spark, sf_dir):
    return mosaic.type_union(tables.nation_catalog(spark, sf_dir))


@query(f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY priority, k) - 1 AS ord, priority, (cols // (1 << k)) AS cols, (rows // (1 << k)) AS rows FROM cat2, range(2) t(k)""")
def mosaic_resolutions(spark, sf_dir):
    cat = tables.nation_catalog(spark, sf_dir)
    each = F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.struct(F.col("priority").alias("priority"), F.floor(F.col("cols") / k).alias("cols"), F.floor(F.col("rows") / k).alias("rows")))
    # a catalog row for each source: the list of all of them is as long as the mosaic has sources
    every = cat.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("priority", each.alias("each")))), lambda s: s["each"])).alias("list"))
    return every.select(F.posexplode("list").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), "r.priority", "r.cols", "r.rows")


@query(f"WITH {CATALOG} SELECT arg_min(band_count, priority) AS band_count, count(*) AS n_sources, arg_min(name, priority) AS first_source, count(*) FILTER (srid = 4326) AS n_4326 FROM cat2")
def mosaic_metadata(spark, sf_dir):
    return tables.nation_catalog(spark, sf_dir).agg(F.min_by("band_count", "priority").alias("band_count"), F.count("*").alias("n_sources"), F.min_by("name", "priority").alias("first_source"), F.count_if(F.col("srid") == 4326).alias("n_4326"))


#: Second and third source of the mosaics: the same raster moved by whole cells, and one of other values.
MOVE = ((30, 20), (-12, 45))
_MERGE = f"""{BASE}, srcs AS (SELECT 0 AS p, * FROM gaps
UNION ALL SELECT 1, band, col_idx + 30, row_idx + 20, CASE WHEN (col_idx * 7 + row_idx * 13) % 5 <> 0 THEN value * 2 END FROM band0
UNION ALL SELECT 2, band, col_idx - 12, row_idx + 45, value * 3 FROM band0),
merged AS (SELECT band, col_idx, row_idx, arg_min(value, p) FILTER (value IS NOT NULL) AS value FROM srcs GROUP BY ALL)"""


def _variant(spark, sf_dir, factor: float, gaps: bool, move: tuple[int, int] = (0, 0)) -> RasterView:
    """The raster with its values multiplied, with gaps if asked for, moved by whole cells to the right and down."""
    view = raster(spark, sf_dir)

    def tiles(bands, keys):
        col, row = (lambda i: F.col("tcol") * SIDE + i % SIDE), (lambda i: F.col("trow") * SIDE + F.floor(i / SIDE))
        there = lambda i: (col(i) * 7 + row(i) * 13) % 5 != 0 if gaps else F.lit(True)
        return view.tiles(bands, keys).withColumn("cells", F.transform("cells", lambda v, i: F.when(there(i), v * factor)))

    e, (dx, dy) = view.grid.extent, move
    return replace(view, tiles=tiles, grid=Grid(Extent(e.xmin + dx, e.ymin - dy, e.xmax + dx, e.ymax - dy), view.grid.cols, view.grid.rows))


def _mosaic(spark, sf_dir, factor: float = 1.0) -> MosaicView:
    """Three sources on the grid of the first."""
    views = [_variant(spark, sf_dir, factor * (p + 1), p < 2, move) for p, move in enumerate(((0, 0), *MOVE))]
    return MosaicView.of(views, 3857, views[0].grid, "three")


@query(f"WITH {_MERGE} SELECT * FROM merged")
def mosaic_merge(spark, sf_dir):
    return _mosaic(spark, sf_dir).read()


@query(f"WITH {_MERGE} SELECT * FROM merged WHERE col_idx BETWEEN 20 AND 60 AND row_idx BETWEEN 10 AND 70")
def mosaic_read_extent(spark, sf_dir):
    view = _mosaic(spark, sf_dir)
    return view.read(Extent(20.0, view.grid.rows - 71.0, 61.0, view.grid.rows - 10.0))


@query(f"WITH {_MERGE} SELECT * FROM merged WHERE col_idx BETWEEN 5 AND 36 AND row_idx BETWEEN 40 AND 59")
def mosaic_read_bounds(spark, sf_dir):
    return _mosaic(spark, sf_dir).read(bounds=Bounds(5, 40, 36, 59))


@query(f"""WITH {BASE}, srcs AS (SELECT 0 AS p, * FROM gaps UNION ALL SELECT 1, band, col_idx, row_idx, value * 2 FROM band0),
small AS (SELECT p, band, c AS col_idx, r AS row_idx, value FROM (SELECT c, r, floor((c + 0.5) * 2.5e0)::BIGINT AS col_idx, floor((r + 0.5) * (rows / 64e0))::BIGINT AS row_idx FROM dims, range(0, 80) a(c), range(0, 64) b(r)) JOIN srcs USING (col_idx, row_idx))
SELECT band, col_idx, row_idx, arg_min(value, p) FILTER (value IS NOT NULL) AS value FROM small GROUP BY ALL""")
def mosaic_resample(spark, sf_dir):
    view = MosaicView.of([_variant(spark, sf_dir, 1.0, True), _variant(spark, sf_dir, 2.0, False)], 3857)
    return view.resample_to_grid(Grid(view.grid.extent, 80, 64)).read()


@query(f"""WITH {_MERGE}, cast_srcs AS (SELECT p, band, col_idx, row_idx, CASE WHEN value IS NOT NULL THEN least(255e0, greatest(0e0, CASE WHEN value * 100 < 0 THEN -floor(-value * 100 + 0.5) ELSE floor(value * 100 + 0.5) END)) + 0e0 END AS value FROM srcs)
SELECT band, col_idx, row_idx, arg_min(value, p) FILTER (value IS NOT NULL) AS value FROM cast_srcs GROUP BY ALL""")
def mosaic_convert(spark, sf_dir):
    return _mosaic(spark, sf_dir, 100.0).convert("uint8").read()


@query(f"""WITH {BASE} SELECT t.ord, 2 AS bands, 'float64' AS cell_type, 3857 AS srid, 2::BIGINT AS n_sources, cols // t.k AS cols, rows // t.k AS rows FROM dims, (VALUES (0::BIGINT, 1), (1, 2), (2, 1)) t(ord, k)""")
def mosaic_view_metadata(spark, sf_dir):
    base = raster(spark, sf_dir, 2)
    half = Grid(base.grid.extent, base.grid.cols // 2, base.grid.rows // 2)
    view = MosaicView.of([replace(base, cell_type="int16", overviews=(half,)), replace(base, name="second")], 3857, name="two")
    m = view.metadata()
    rows = [(i, m["band_count"], m["cell_type"], m["srid"], len(m["sources"]), r.cols, r.rows) for i, r in enumerate(view.resolutions())]
    return spark.createDataFrame(rows, "ord long, bands int, cell_type string, srid int, n_sources long, cols long, rows long")


# ---- reprojection ------------------------------------------------------------------------

_R = "6378137e0"


@query(f"WITH {POINTS} SELECT id, round({_R} * radians(x), 6) + 0e0 AS mx, round({_R} * ln(tan(pi() / 4 + radians(y) / 2)), 6) + 0e0 AS my FROM pts WHERE x IS NOT NULL")
def transform_4326_3857(spark, sf_dir):
    p = tables.points(spark, sf_dir).where("x is not null")
    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    return p.select("id", (F.round(x, 6) + F.lit(0.0)).alias("mx"), (F.round(y, 6) + F.lit(0.0)).alias("my"))


@query(f"""WITH {WINDOWS}, box AS (SELECT window_id, col_min / 4e0 AS x0, row_min / 4e0 AS y0, (col_max + 1) / 4e0 AS x1, (row_max + 1) / 4e0 AS y1 FROM w)
SELECT window_id, round({_R} * radians(x0), 4) + 0e0 AS xmin, round({_R} * ln(tan(pi() / 4 + radians(y0) / 2)), 4) + 0e0 AS ymin,
round({_R} * radians(x1), 4) + 0e0 AS xmax, round({_R} * ln(tan(pi() / 4 + radians(y1) / 2)), 4) + 0e0 AS ymax FROM box""")
def reproject_window_bbox(spark, sf_dir):
    w = tables.windows(spark, sf_dir).select("window_id", (F.col("col_min") / 4).alias("x0"), (F.col("row_min") / 4).alias("y0"), ((F.col("col_max") + 1) / 4).alias("x1"), ((F.col("row_max") + 1) / 4).alias("y1"))
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: i / 16)).alias("t")
    edge = w.select("*", t)
    x, y = F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0")), F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))
    sides = F.inline(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, F.col("y0")), (x, F.col("y1")), (F.col("x0"), y), (F.col("x1"), y))]))
    edge = edge.select("window_id", sides)
    mx, my = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    r = lambda c: F.round(c, 4) + F.lit(0.0)
    return edge.groupBy("window_id").agg(r(F.min(mx)).alias("xmin"), r(F.min(my)).alias("ymin"), r(F.max(mx)).alias("xmax"), r(F.max(my)).alias("ymax"))


#: The raster placed in degrees, from 50 north and 20 west on: cells of a quarter degree, or smaller ones so that it ends at 50 south.
DEGREES, SPAN = 0.25, 100.0
_PLACE = f"""{BASE}, geo AS (SELECT -20e0 AS x0, 50e0 AS y1, least(0.25e0, 100e0 / rows) AS s FROM dims)"""


def _placed(spark, sf_dir) -> RasterView:
    view = raster(spark, sf_dir)
    g0 = view.grid
    s = min(DEGREES, SPAN / max(g0.rows, 1))
    return RasterView("degrees", view.tiles, Grid(Extent(-20.0, 50.0 - s * g0.rows, -20.0 + s * g0.cols, 50.0), g0.cols, g0.rows), srid=4326)


_MERC_Y = "{R} * ln(tan(pi() / 4 + radians({y}) / 2))".replace("{R}", _R)
_GRID = f"""gx AS (SELECT {_R} * radians(x0) AS ex0, {_R} * radians(x0 + s * cols) AS ex1, {_MERC_Y.format(y='y1 - s * rows')} AS ey0, {_MERC_Y.format(y='y1')} AS ey1, cols, rows FROM geo, dims),
gs AS (SELECT *, sqrt((ex1 - ex0) * (ex1 - ex0) + (ey1 - ey0) * (ey1 - ey0)) / sqrt(cols * cols + rows * rows) AS size FROM gx),
gt AS (SELECT ex0, ey0, ex1, ey1, round((ex1 - ex0) / size)::BIGINT AS tcols, round((ey1 - ey0) / size)::BIGINT AS trows FROM gs)"""


@query(f"WITH {_PLACE}, {_GRID} SELECT round(ex0, 4) + 0e0 AS xmin, round(ey0, 4) + 0e0 AS ymin, round(ex1, 4) + 0e0 AS xmax, round(ey1, 4) + 0e0 AS ymax, tcols AS cols, trows AS rows FROM gt")
def reproject_grid_extent(spark, sf_dir):
    grid = _placed(spark, sf_dir).reproject(3857).grid_extent
    e = grid.extent
    return spark.createDataFrame([(round(e.xmin, 4) + 0.0, round(e.ymin, 4) + 0.0, round(e.xmax, 4) + 0.0, round(e.ymax, 4) + 0.0, grid.cols, grid.rows)], "xmin double, ymin double, xmax double, ymax double, cols long, rows long")


def _inverse(grid: str) -> str:
    """Target cells of ``grid`` (tx, ty upper left, tcw, tch, tcols, trows) with the source cell of their centre."""
    return f"""t AS ({grid}), tc AS (SELECT c, r, floor((degrees((tx + (c + 0.5) * tcw) / {_R}) - x0) / s)::BIGINT AS col_idx,
floor((y1 - degrees(2 * atan(exp((ty - (r + 0.5) * tch) / {_R})) - pi() / 2)) / s)::BIGINT AS row_idx FROM t, geo, range(0, 3000) a(c), range(0, 3000) b(r) WHERE c < tcols AND r < trows)"""


@query(f"WITH {_PLACE}, {_GRID}, {_inverse('SELECT ex0 AS tx, ey1 AS ty, (ex1 - ex0) / tcols AS tcw, (ey1 - ey0) / trows AS tch, tcols, trows FROM gt')} SELECT band, c AS col_idx, r AS row_idx, value FROM tc JOIN band0 USING (col_idx, row_idx)")
def reproject_nearest(spark, sf_dir):
    return _placed(spark, sf_dir).reproject(3857).read()


@query(f"""WITH {_PLACE}, {_GRID}, {_inverse('''SELECT floor(ex0 / 40000e0) * 40000e0 AS tx, ceil(ey1 / 40000e0) * 40000e0 AS ty, 40000e0 AS tcw, 40000e0 AS tch, (ceil(ex1 / 40000e0) - floor(ex0 / 40000e0))::BIGINT AS tcols,
(ceil(ey1 / 40000e0) - floor(ey0 / 40000e0))::BIGINT AS trows FROM gt''')} SELECT band, c AS col_idx, r AS row_idx, value FROM tc JOIN band0 USING (col_idx, row_idx)""")
def reproject_to_grid(spark, sf_dir):
    return _placed(spark, sf_dir).reproject_to_grid(3857, Grid.of_cells(Extent(0.0, 0.0, 400_000.0, 400_000.0), 40_000.0, 40_000.0)).read()


@query(f"""WITH {_PLACE}, {_inverse('SELECT -2500000e0 AS tx, 6700000e0 AS ty, 33000e0 AS tcw, 33000e0 AS tch, 60 AS tcols, 50 AS trows')}
SELECT 0 AS band, tc.c AS col_idx, tc.r AS row_idx, value FROM tc LEFT JOIN band0 USING (col_idx, row_idx)""")
def reproject_to_region(spark, sf_dir):
    return _placed(spark, sf_dir).reproject_to_region(3857, Grid(Extent(-2_500_000.0, 6_700_000.0 - 50 * 33_000.0, -2_500_000.0 + 60 * 33_000.0, 6_700_000.0), 60, 50)).read()


@query(f"""WITH {_PLACE}, {_inverse('SELECT -2000000e0 AS tx, 6400000e0 AS ty, 30000e0 AS tcw, 30000e0 AS tch, 80 AS tcols, 60 AS trows')},
srcs AS (SELECT 0 AS p, * FROM gaps UNION ALL SELECT 1, band, col_idx, row_idx, value * 2 FROM band0)
SELECT band, c AS col_idx, r AS row_idx, arg_min(value, p) FILTER (value IS NOT NULL) AS value FROM tc JOIN srcs USING (col_idx, row_idx) GROUP BY band, c, r""")
def mosaic_reproject(spark, sf_dir):
    target = Grid(Extent(-2_000_000.0, 6_400_000.0 - 60 * 30_000.0, -2_000_000.0 + 80 * 30_000.0, 6_400_000.0), 80, 60)
    views = [replace(_placed(spark, sf_dir), tiles=_variant(spark, sf_dir, p + 1.0, p == 0).tiles) for p in range(2)]
    return MosaicView.of(views, 3857, target).read(bounds=target.bounds)


_WARPED = "SELECT -2200000e0 AS tx, 6400000e0 AS ty, 45000e0 AS tcw, 45000e0 AS tch, 70 AS tcols, 60 AS trows"


def _warped() -> Grid:
    return Grid(Extent(-2_200_000.0, 6_400_000.0 - 60 * 45_000.0, -2_200_000.0 + 70 * 45_000.0, 6_400_000.0), 70, 60)


@query(f"""WITH {_PLACE}, t AS ({_WARPED}), tc AS (SELECT c, r, (degrees((tx + (c + 0.5) * tcw) / {_R}) - x0) / s - 0.5 AS u,
(y1 - degrees(2 * atan(exp((ty - (r + 0.5) * tch) / {_R})) - pi() / 2)) / s - 0.5 AS v FROM t, geo, range(0, 70) a(c), range(0, 60) b(r)),
near AS (SELECT c, r, i + floor(u)::BIGINT AS col_idx, j + floor(v)::BIGINT AS row_idx, (1 - abs(u - i - floor(u))) * (1 - abs(v - j - floor(v))) AS w FROM tc, range(0, 2) a(i), range(0, 2) b(j)),
made AS (SELECT c, r, sum(w * value) / sum(w) AS value FROM near JOIN gaps USING (col_idx, row_idx) WHERE value IS NOT NULL AND w > 0 GROUP BY c, r)
SELECT 0 AS band, a.c AS col_idx, b.r AS row_idx, round(value, 8) + 0e0 AS value FROM range(0, 70) a(c) CROSS JOIN range(0, 60) b(r) LEFT JOIN made ON made.c = a.c AND made.r = b.r""")
def reproject_bilinear(spark, sf_dir):
    view = replace(_placed(spark, sf_dir), tiles=_variant(spark, sf_dir, 1.0, True).tiles)
    return view.reproject_to_region(3857, _warped(), "bilinear").read().withColumn("value", F.round("value", 8) + F.lit(0.0))


_AVERAGED = f"""WITH {_PLACE}, t AS ({_WARPED}), moved AS (SELECT floor(({_R} * radians(x0 + (col_idx + 0.5) * s) - tx) / tcw)::BIGINT AS c,
floor((ty - {_MERC_Y.format(y='y1 - (row_idx + 0.5) * s')}) / tch)::BIGINT AS r, value FROM gaps, geo, t WHERE value IS NOT NULL),
made AS (SELECT c, r, avg(value) AS value FROM moved GROUP BY c, r)
SELECT 0 AS band, a.c AS col_idx, b.r AS row_idx, round(value, 8) + 0e0 AS value FROM range(0, 70) a(c) CROSS JOIN range(0, 60) b(r) LEFT JOIN made ON made.c = a.c AND made.r = b.r"""


@query(_AVERAGED)
def reproject_average(spark, sf_dir):
    view = replace(_placed(spark, sf_dir), tiles=_variant(spark, sf_dir, 1.0, True).tiles)
    return view.reproject_to_region(3857, _warped(), "average").read().withColumn("value", F.round("value", 8) + F.lit(0.0))


@query(f"SELECT * FROM ({_AVERAGED}) WHERE col_idx BETWEEN 3 AND 40 AND row_idx BETWEEN 7 AND 59")
def region_read_bounds(spark, sf_dir):
    view = replace(_placed(spark, sf_dir), tiles=_variant(spark, sf_dir, 1.0, True).tiles)
    out = view.reproject_to_region(3857, _warped(), "average").read(bounds=Bounds(3, 7, 40, 59))
    return out.withColumn("value", F.round("value", 8) + F.lit(0.0))


@query(f"""WITH {BASE}, {WINDOWS}, {_nearest_sql('SELECT 80 AS tcols, 64 AS trows, 0e0 AS tx, rows::DOUBLE AS ty, 2.5e0 AS tcw, rows / 64e0 AS tch FROM dims')}
SELECT window_id, count(*) AS n, round(sum(round(value * 100)), 6) + 0e0 AS sum_value FROM w JOIN out_cells o ON o.col_idx BETWEEN w.col_min AND w.col_max AND o.row_idx BETWEEN w.row_min AND w.row_max GROUP BY window_id""")
def multi_window_resampled(spark, sf_dir):
    view = raster(spark, sf_dir).resample(80, 64)
    cells = view.read_many(tables.windows(spark, sf_dir))
    return _per_window(cells.withColumn("value", F.signum("value") * F.floor(F.abs(F.col("value") * 100) + 0.5)))


# ---- files -----------------------------------------------------------------------------------

#: Sides of the image written to a file: no multiples of a tile's.
FILE_COLS, FILE_ROWS = 61, 43


def _file(spark, sf_dir, **layout) -> RasterView:
    """A view of a GeoTIFF of the raster's upper left corner (two bands, one overview), a bounded image that is written first."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="lattica-")
    cells = raster(spark, sf_dir, 2).read(bounds=Bounds(0, 0, FILE_COLS - 1, FILE_ROWS - 1)).toPandas()
    image = np.zeros((2, FILE_ROWS, FILE_COLS), np.float64)
    image[cells["band"], cells["row_idx"], cells["col_idx"]] = cells["value"]
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    path = f"{folder.rstrip('/')}/corner-{uuid.uuid4().hex}.tif"
    text = '<GDALMetadata><Item name="AREA">Area</Item><Item name="KEY" domain="TIFF">7</Item><Item name="B" sample="0">x</Item></GDALMetadata>'
    geotiff.write(path, [image, image[:, ::2, ::2].copy()], Extent(0.0, 0.0, float(FILE_COLS), float(FILE_ROWS)), 3857, metadata=text, **layout)
    return geotiff.view(spark, path, "corner")


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM both_bands WHERE col_idx < {FILE_COLS} AND row_idx < {FILE_ROWS}")
def geotiff_read_full(spark, sf_dir):
    return _file(spark, sf_dir, tile=16, deflate=True).read()


@query(f"WITH {BASE} SELECT band, col_idx, row_idx, value FROM both_bands WHERE col_idx BETWEEN 5 AND {FILE_COLS - 1} AND row_idx BETWEEN 20 AND {FILE_ROWS - 1} AND band = 0")
def geotiff_window(spark, sf_dir):
    return _file(spark, sf_dir, strip_rows=7).read(bounds=Bounds(5, 20, 500, 500), bands=(0,))


@query(f"""SELECT 'corner' AS name, 3857 AS srid, 2 AS bands, {FILE_COLS}::BIGINT AS cols, {FILE_ROWS}::BIGINT AS rows, 'float64' AS cell_type, d.domain, d.key, d.value
FROM (VALUES ('', 'AREA', 'Area'), ('TIFF', 'KEY', '7')) d(domain, key, value)""")
def geotiff_metadata(spark, sf_dir):
    view = _file(spark, sf_dir)
    m = view.metadata()
    rows = [(m["name"], m["srid"], m["band_count"], m["cols"], m["rows"], m["cell_type"], d, k, v) for d, e in view.domain_metadata().items() for k, v in e.items()]
    return spark.createDataFrame(rows, "name string, srid int, bands int, cols long, rows long, cell_type string, domain string, key string, value string")


# ---- vectors -------------------------------------------------------------------------------

@query(f"WITH {POINTS} SELECT id, name, x, y FROM pts")
def vec_scan(spark, sf_dir):
    return tables.points(spark, sf_dir)


@query("SELECT c_name AS name FROM customer")
def vec_project(spark, sf_dir):
    return tables.points(spark, sf_dir).select("name")


@query(f"WITH {POINTS} SELECT id, name FROM pts WHERE id > 100 AND id <> 400")
def vec_filter(spark, sf_dir):
    return tables.points(spark, sf_dir).where((F.col("id") > 100) & (F.col("id") != 400)).select("id", "name")


@query(f"""{cities.SQL} SELECT id, name, x, y FROM c UNION ALL SELECT 27, 'AAtown,PA', 75.1e0, 40.1e0 UNION ALL SELECT 28, 'BBtown,PA', 75.2e0, 40.2e0 UNION ALL SELECT 4000, 'ATown', -55.1e0, 23.3e0""")
def vec_insert(spark, sf_dir):
    new = spark.createDataFrame([(None, "BBtown,PA", 75.2, 40.2), (None, "AAtown,PA", 75.1, 40.1), (4000, "ATown", -55.1, 23.3)], "id int, name string, x double, y double")
    return vector.insert(cities.table(spark), new, order=["name"])


@query(f"{cities.SQL} SELECT name FROM c WHERE NOT (x BETWEEN 78.31 AND 78.33 AND y BETWEEN 40.29 AND 40.31)")
def vec_delete_where(spark, sf_dir):
    hit = geo.overlaps(F.col("x"), F.col("y"), F.col("x"), F.col("y"), F.lit(78.31), F.lit(40.29), F.lit(78.33), F.lit(40.31))
    return vector.delete_where(cities.table(spark), hit).select("name")


@query(f"WITH {POINTS} SELECT id, x IS NULL AS is_null, x BETWEEN -10 AND 10 AND y BETWEEN -10 AND 10 AS inside FROM pts")
def vec_null_geom(spark, sf_dir):
    inside = geo.overlaps(F.col("x"), F.col("y"), F.col("x"), F.col("y"), F.lit(-10.0), F.lit(-10.0), F.lit(10.0), F.lit(10.0))
    return tables.points(spark, sf_dir).select("id", F.col("x").isNull().alias("is_null"), inside.alias("inside"))


_BOXES = "boxes AS (SELECT s_suppkey AS box_id, (s_suppkey * 29 % 3300) / 10e0 - 170 AS xmin, (s_suppkey * 17 % 1500) / 10e0 - 80 AS ymin, (s_suppkey * 29 % 3300) / 10e0 - 158 AS xmax, (s_suppkey * 17 % 1500) / 10e0 - 71 AS ymax FROM supplier)"


@query(f"WITH {POINTS}, {_BOXES} SELECT box_id, id FROM pts, boxes WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
def bbox_overlap(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 29 % 3300) / 10, (k * 17 % 1500) / 10
    boxes = tables.table(spark, sf_dir, "supplier").select(k.alias("box_id"), (x - 170).alias("xmin"), (y - 80).alias("ymin"), (x - 158).alias("xmax"), (y - 71).alias("ymax"))
    return vector.points_in_boxes(tables.points(spark, sf_dir), boxes, 5.0)


@query(f"WITH {POINTS} SELECT a.id AS aid, b.id AS bid, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d FROM pts a JOIN pts b ON a.name <> b.name AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1.5")
def distance_join(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    out = vector.distance_join(p, p, 1.5).where("aid <> bid")
    return out.select("aid", "bid", F.round("d", 9).alias("d"))


@query(f"{cities.SQL} SELECT a.name AS a, b.name AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d FROM c a, c b WHERE a.name <> b.name AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.5")
def distance_join_cities(spark, sf_dir):
    c = cities.table(spark)
    pairs = vector.distance_join(c, c, 0.5)
    named = pairs.join(c.select(F.col("id").alias("aid"), F.col("name").alias("a")), "aid").join(c.select(F.col("id").alias("bid"), F.col("name").alias("b")), "bid")
    return named.where("a <> b").select("a", "b", F.round("d", 9).alias("d"))


_LINES = """pts AS (SELECT user_id AS id, event_id, (event_id * 37 % 1000) / 10e0 AS x, (event_id * event_id * 13 % 1000) / 10e0 AS y FROM events)"""


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of the users' events in the order of their ids: a user's line is one row."""
    e = F.col("event_id")
    point = F.struct((e * 37 % 1000 / 10).alias("x"), (e * e * 13 % 1000 / 10).alias("y"))
    lists = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(e.alias("e"), point.alias("p")))).alias("l"))
    return lists.select("id", F.transform("l", lambda s: s["p"]).alias("points"))


@query(f"WITH {_LINES}, steps AS (SELECT id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM pts WINDOW w AS (PARTITION BY id ORDER BY event_id)) SELECT id, round(coalesce(sum(d), 0e0), 6) AS length FROM steps GROUP BY id")
def line_length(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.round(geo.line_length(F.col("points")), 6).alias("length"))


@query(f"WITH {_LINES} SELECT id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM pts GROUP BY id")
def multipoint_centroid(spark, sf_dir):
    e = F.col("event_id")
    return tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg(e * 37 % 1000 / 10), 9).alias("cx"), F.round(F.avg(e * e * 13 % 1000 / 10), 9).alias("cy"))


@query(f"""{cities.SQL} SELECT name, '{{"type":"Point","coordinates":[' || regexp_replace(x::VARCHAR, '\\.0$', '') || ',' || regexp_replace(y::VARCHAR, '\\.0$', '') || ']}}' AS geojson FROM c WHERE name = 'Reading,PA'""")
def vec_geojson(spark, sf_dir):
    return cities.table(spark).where(F.col("name") == "Reading,PA").select("name", geo.as_geojson(F.col("x"), F.col("y")).alias("geojson"))


_X, _Y = "regexp_replace(x::VARCHAR, '\\.0$', '')", "regexp_replace(y::VARCHAR, '\\.0$', '')"


@query(f"WITH {POINTS} SELECT id, 'POINT (' || {_X} || ' ' || {_Y} || ')' AS wkt FROM pts")
def wkt_write(spark, sf_dir):
    return tables.points(spark, sf_dir).select("id", geo.point_wkt(F.col("x"), F.col("y")).alias("wkt"))


def _ewkt(spark, sf_dir) -> DataFrame:
    srid = (F.col("id") % 4 * 1000 + 3131).cast("int")
    return tables.points(spark, sf_dir).select("id", geo.ewkt(srid, geo.point_wkt(F.col("x"), F.col("y"))).alias("text"))


@query(f"WITH {POINTS} SELECT id, 'SRID=' || (id % 4 * 1000 + 3131)::VARCHAR || ';POINT (' || {_X} || ' ' || {_Y} || ')' AS ewkt FROM pts")
def ewkt_write(spark, sf_dir):
    return _ewkt(spark, sf_dir).withColumnRenamed("text", "ewkt")


@query(f"WITH {POINTS} SELECT id, x, y FROM pts")
def wkt_parse(spark, sf_dir):
    x, y = geo.parse_point(F.col("wkt"))
    return wkt_write(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))


@query(f"WITH {POINTS} SELECT id, CASE WHEN x IS NOT NULL THEN (id % 4 * 1000 + 3131)::INT END AS srid, x, y FROM pts")
def ewkt_parse(spark, sf_dir):
    x, y = geo.parse_point(F.col("text"))
    return _ewkt(spark, sf_dir).select("id", geo.ewkt_srid(F.col("text")).alias("srid"), x.alias("x"), y.alias("y"))


@query(f"WITH {POINTS} SELECT id, (['hex_escaped', 'hex', 'wkt', 'hex'])[id % 4 + 1] AS kind FROM pts WHERE x IS NOT NULL")
def geom_sniff(spark, sf_dir):
    p = tables.points(spark, sf_dir).where("x is not null")
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.lit("\\x0101000000")).when(kind == 1, F.lit("0001000000")).when(kind == 2, geo.point_wkt(F.col("x"), F.col("y"))).otherwise(F.lit("SRID=4326;0101000000"))
    return p.select("id", geo.sniff(text).alias("kind"))


@query()
def wkb_roundtrip(spark, sf_dir):
    out = _ewkt(spark, sf_dir).withColumn("hex", wkb.wkb_of(F.col("text")))
    return out.select("id", "hex", wkb.wkt_of(F.col("hex")).alias("wkt"))


@query("""SELECT id, (['POINT', 'LINESTRING', 'MULTIPOINT'])[id % 3 + 1] AS kind FROM (SELECT c_custkey AS id FROM customer)""")
def geom_type(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.lit("SRID=3131;POINT (1 1)")).when(k % 3 == 1, F.lit("linestring (1 1, 1 3)")).otherwise(F.lit("MULTIPOINT ((1 1), (2 2))"))
    return tables.table(spark, sf_dir, "customer").select(k.alias("id"), geo.geom_type(text).alias("kind"))


@query("WITH " + POINTS + """ SELECT id, round(2 * 6371008.8e0 * asin(sqrt(power(sin(radians(y - 40) / 2), 2) + cos(radians(40e0)) * cos(radians(y)) * power(sin(radians(x - 75) / 2), 2))), 3) AS metres FROM pts WHERE x IS NOT NULL""")
def distance_sphere(spark, sf_dir):
    p = tables.points(spark, sf_dir).where("x is not null")
    return p.select("id", F.round(geo.distance_sphere(F.lit(75.0), F.lit(40.0), F.col("x"), F.col("y")), 3).alias("metres"))


@query(f"WITH {_LINES} SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*) AS n_points FROM pts GROUP BY id")
def line_envelope(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", *[c.alias(k) for k, c in geo.envelope(F.col("points")).items()], F.size("points").cast("long").alias("n_points"))


_BX = """bx AS (SELECT s_suppkey AS id, (s_suppkey * 29 % 3300) / 10e0 - 170 AS xmin, (s_suppkey * 17 % 1500) / 10e0 - 80 AS ymin FROM supplier)"""


@query(f"""WITH {_BX} SELECT id, xmin + 12 < 0 AS is_left, ymin > 9 AS is_above, xmin + 12 <= 20 AS not_right, xmin <= 20 AND xmin + 12 >= 0 AND ymin <= 9 AND ymin + 9 >= 0 AS meets, xmin >= -30 AND xmin + 12 <= 90 AND ymin >= -40 AND ymin + 9 <= 80 AS inside,
round(sqrt(power(greatest(0 - (xmin + 12), xmin - 20, 0e0), 2) + power(greatest(0 - (ymin + 9), ymin - 9, 0e0), 2)), 9) AS away, round(sqrt(power(xmin + 6 - 10, 2) + power(ymin + 4.5 - 4.5, 2)), 9) AS centres FROM bx""")
def box_relations(spark, sf_dir):
    k = F.col("s_suppkey")
    b = tables.table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 29 % 3300) / 10 - 170).alias("xmin"), ((k * 17 % 1500) / 10 - 80).alias("ymin"))
    own = (F.col("xmin"), F.col("ymin"), F.col("xmin") + 12, F.col("ymin") + 9)
    other = tuple(map(F.lit, (0.0, 0.0, 20.0, 9.0)))
    wide = tuple(map(F.lit, (-30.0, -40.0, 90.0, 80.0)))
    centres = geo.distance(own[0] + 6, own[1] + 4.5, F.lit(10.0), F.lit(4.5))
    return b.select("id", geo.box_left(own[2], other[0]).alias("is_left"), geo.box_left(other[3], own[1]).alias("is_above"), geo.box_overlaps_or_left(own[2], other[2]).alias("not_right"), geo.overlaps(*own, *other).alias("meets"),
                    geo.box_contains(*wide, *own).alias("inside"), F.round(geo.box_distance(*own, *other), 9).alias("away"), F.round(centres, 9).alias("centres"))


@query(f"""WITH {_LINES}, ends AS (SELECT id, arg_min(x, event_id) AS x0, arg_min(y, event_id) AS y0, arg_max(x, event_id) AS x1, arg_max(y, event_id) AS y1, count(*) AS n, min(sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50))) AS near, max(sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50))) AS far FROM pts GROUP BY id)
SELECT id, n AS n_points, x1 + 1 AS first_x, y1 - 2 AS first_y, x0 = x1 AND y0 = y1 AND n > 1 AS closed, round(far, 9) AS far, round(near, 9) AS near FROM ends""")
def line_accessors(spark, sf_dir):
    p = F.col("points")
    centre = F.array(geo.point(F.lit(50.0), F.lit(50.0)))
    moved = geo.translate(geo.reverse(p), F.lit(1.0), F.lit(-2.0))
    near = F.array_min(F.transform(p, lambda q: geo.distance(q["x"], q["y"], F.lit(50.0), F.lit(50.0))))
    return _lines(spark, sf_dir).select("id", geo.n_points(p).alias("n_points"), moved[0]["x"].alias("first_x"), moved[0]["y"].alias("first_y"), geo.is_closed(p).alias("closed"), F.round(geo.max_distance(p, centre), 9).alias("far"), F.round(near, 9).alias("near"))


@query(f"""WITH {POINTS} SELECT id, 'cx="' || {_X} || '" cy="' || regexp_replace((-y)::VARCHAR, '\\.0$', '') || '"' AS svg, '<Point><coordinates>' || {_X} || ',' || {_Y} || '</coordinates></Point>' AS kml FROM pts WHERE x IS NOT NULL AND y <> 0""")
def point_markup(spark, sf_dir):
    p = tables.points(spark, sf_dir).where("x is not null and y <> 0")
    return p.select("id", geo.as_svg(F.col("x"), F.col("y")).alias("svg"), geo.as_kml(F.col("x"), F.col("y")).alias("kml"))


# ---- shapes: relations, measures and processing ------------------------------------------------

#: Lines of three points for each customer on a lattice, and the box they are held against.
_PATHS = """k AS (SELECT c_custkey AS id FROM customer),
corners AS (SELECT id, 1 AS i, id * 7 % 40 + 0e0 AS x, id * 11 % 37 + 0e0 AS y FROM k UNION ALL SELECT id, 2, id * 13 % 41 + 0e0, id * 17 % 40 + 0e0 FROM k UNION ALL SELECT id, 3, id * 19 % 23 + 0e0, id * 23 % 43 + 0e0 FROM k),
steps AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, b.x - a.x AS dx, b.y - a.y AS dy FROM corners a JOIN corners b ON a.id = b.id AND b.i = a.i + 1)"""


def _paths(spark, sf_dir, closed: bool = False) -> DataFrame:
    k = F.col("c_custkey")
    at = [geo.point(k * a % m, k * b % n) for a, m, b, n in ((7, 40, 11, 37), (13, 41, 17, 40), (19, 23, 23, 43))]
    fourth = [geo.point(k * 29 % 31, k * 31 % 29), at[0]] if closed else []
    return tables.table(spark, sf_dir, "customer").select(k.alias("id"), geo.make_line(*at, *fourth).alias("points"))


def _box(x0: float, y0: float, x1: float, y1: float):
    return geo.make_box(*map(F.lit, (x0, y0, x1, y1)))


@query(f"""WITH {_PATHS}, clipped AS (SELECT *, dx <> 0 OR dy <> 0 AS moves, ax < 10 OR ax > 30 OR ay < 10 OR ay > 30 OR bx < 10 OR bx > 30 OR b_y < 10 OR b_y > 30 AS outside,
CASE WHEN dx <> 0 THEN least((10 - ax) / dx, (30 - ax) / dx) WHEN ax BETWEEN 10 AND 30 THEN -1e9 ELSE 1e9 END AS x0, CASE WHEN dx <> 0 THEN greatest((10 - ax) / dx, (30 - ax) / dx) WHEN ax BETWEEN 10 AND 30 THEN 1e9 ELSE -1e9 END AS x1,
CASE WHEN dy <> 0 THEN least((10 - ay) / dy, (30 - ay) / dy) WHEN ay BETWEEN 10 AND 30 THEN -1e9 ELSE 1e9 END AS y0, CASE WHEN dy <> 0 THEN greatest((10 - ay) / dy, (30 - ay) / dy) WHEN ay BETWEEN 10 AND 30 THEN 1e9 ELSE -1e9 END AS y1 FROM steps),
ranged AS (SELECT id, outside, greatest(x0, y0, 0) AS t0, least(x1, y1, 1) AS t1, moves AND (dx <> 0 OR (ax > 10 AND ax < 30)) AND (dy <> 0 OR (ay > 10 AND ay < 30)) AS through FROM clipped),
told AS (SELECT id, bool_or(through AND t0 < t1 - 1e-11) AS inside, bool_or(outside) AS outside, bool_or(t0 <= t1 + 1e-11) AS meets FROM ranged GROUP BY id)
SELECT id, NOT meets AS disjoint, meets AS intersects, inside AND outside AS crosses, meets AND NOT inside AS touches, inside AND NOT outside AS within, NOT outside AS covered FROM told""")
def line_box_relations(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", shapes.line_in_ring(F.col("points"), _box(10.0, 10.0, 30.0, 30.0)).alias("told")).select("id", "told.*")


_RECTS = """b AS (SELECT s_suppkey AS id, s_suppkey * 7 % 30 + 0e0 AS x0, s_suppkey * 11 % 30 + 0e0 AS y0, s_suppkey * 7 % 30 + 1 + s_suppkey * 5 % 21 + 0e0 AS x1, s_suppkey * 11 % 30 + 1 + s_suppkey * 3 % 19 + 0e0 AS y1 FROM supplier
UNION ALL SELECT * FROM (VALUES (-1, 10e0, 10e0, 20e0, 20e0), (-2, 12e0, 12e0, 15e0, 20e0), (-3, 20e0, 20e0, 25e0, 25e0), (-4, 5e0, 5e0, 30e0, 20e0)))"""


def _rects(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 7 % 30, k * 11 % 30
    own = tables.table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), *[c.cast("double").alias(n) for n, c in (("x0", x), ("y0", y), ("x1", x + 1 + k * 5 % 21), ("y1", y + 1 + k * 3 % 19))])
    more = spark.createDataFrame([(-1, 10.0, 10.0, 20.0, 20.0), (-2, 12.0, 12.0, 15.0, 20.0), (-3, 20.0, 20.0, 25.0, 25.0), (-4, 5.0, 5.0, 30.0, 20.0)], own.schema)
    return own.unionByName(more).select("id", geo.make_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


@query(f"""WITH {_RECTS}, told AS (SELECT id, x0 <= 20 AND x1 >= 10 AND y0 <= 20 AND y1 >= 10 AS meets, x0 < 20 AND x1 > 10 AND y0 < 20 AND y1 > 10 AS interior, x0 <= 10 AND y0 <= 10 AND x1 >= 20 AND y1 >= 20 AS covers, x0 >= 10 AND y0 >= 10 AND x1 <= 20 AND y1 <= 20 AS within FROM b)
SELECT id, NOT meets AS disjoint, meets AS intersects, meets AND NOT interior AS touches, interior AND NOT covers AND NOT within AS overlaps, covers AND within AS equals, covers, within FROM told""")
def ring_relations(spark, sf_dir):
    return _rects(spark, sf_dir).select("id", shapes.ring_in_ring(F.col("ring"), _box(10.0, 10.0, 20.0, 20.0)).alias("told")).select("id", "told.*")


@query(f"""WITH {_RECTS}, a AS (SELECT id, (x1 - x0) * (y1 - y0) AS own, greatest(least(x1, 20) - greatest(x0, 10), 0e0) * greatest(least(y1, 20) - greatest(y0, 10), 0e0) AS shared FROM b)
SELECT id, own AS area, shared AS shared_area, own + 100 - shared AS union_area, own - shared AS left_area FROM a""")
def ring_overlay_areas(spark, sf_dir):
    corners = [tuple(map(F.lit, c)) for c in ((10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0))]
    areas = _rects(spark, sf_dir).select("id", geo.ring_area(F.col("ring")).alias("area"), geo.ring_area(shapes.clip(F.col("ring"), corners)).alias("shared_area"))
    return areas.select("id", "area", "shared_area", (F.col("area") + 100 - F.col("shared_area")).alias("union_area"), (F.col("area") - F.col("shared_area")).alias("left_area"))


@query(f"""WITH {_LINES}, whole AS (SELECT DISTINCT id, round(x * 10) AS x, round(y * 10) AS y FROM pts),
edges AS (SELECT p.id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM whole p JOIN whole q ON p.id = q.id AND (p.x <> q.x OR p.y <> q.y)),
judged AS (SELECT e.* FROM edges e JOIN whole r USING (id) GROUP BY ALL HAVING min((bx - ax) * (r.y - ay) - (b_y - ay) * (r.x - ax)) >= 0 AND max((bx - ax) * (r.y - ay) - (b_y - ay) * (r.x - ax)) > 0
AND count(*) FILTER ((bx - ax) * (r.y - ay) = (b_y - ay) * (r.x - ax) AND ((r.x - ax) * (bx - ax) + (r.y - ay) * (b_y - ay) < 0 OR (r.x - bx) * (ax - bx) + (r.y - b_y) * (ay - b_y) < 0)) = 0)
SELECT id, count(*) AS corners, round(sum(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))), 6) AS perimeter, abs(sum(ax * b_y - bx * ay)) / 2 AS area FROM judged GROUP BY id""")
def line_hull(spark, sf_dir):
    lattice = F.transform("points", lambda p: geo.point(F.round(p["x"] * 10), F.round(p["y"] * 10)))
    hull = _lines(spark, sf_dir).select("id", shapes.convex_hull(lattice).alias("hull")).where(F.size("hull") > 3)
    h = F.col("hull")
    return hull.select("id", (geo.n_points(h) - 1).alias("corners"), F.round(geo.perimeter(h), 6).alias("perimeter"), geo.ring_area(h).alias("area"))


@query(f"""WITH {_PATHS}, feet AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((21.5 - ax) * dx + (50.25 - ay) * dy) / nullif(dx * dx + dy * dy, 0))) END AS u FROM steps),
away AS (SELECT id, round(ax + u * dx, 9) + 0e0 AS x, round(ay + u * dy, 9) + 0e0 AS y, round(sqrt(power(ax + u * dx - 21.5, 2) + power(ay + u * dy - 50.25, 2)), 9) AS d FROM feet)
SELECT id, arg_min(x, d) AS x, arg_min(y, d) AS y, min(d) AS d FROM away GROUP BY id""")
def closest_points(spark, sf_dir):
    best = _paths(spark, sf_dir).select("id", shapes.shortest_line(F.col("points"), F.lit(21.5), F.lit(50.25), 9).alias("line"))
    first = F.get("line", F.lit(0))
    return best.select("id", (F.round(first["x"], 9) + F.lit(0.0)).alias("x"), (F.round(first["y"], 9) + F.lit(0.0)).alias("y"), F.round(geo.line_length(F.col("line")), 9).alias("d"))


@query(f"""WITH {_PATHS}, four AS (SELECT * FROM corners UNION ALL SELECT id, 4, id * 29 % 31 + 0e0, id * 31 % 29 + 0e0 FROM k),
s AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM four a JOIN four b ON a.id = b.id AND b.i = a.i % 4 + 1),
turns AS (SELECT p.id, q.i - p.i = 2 AS opposite, p.i + 1 = q.i AS ahead, (p.bx - p.ax) * (q.ay - p.ay) - (p.b_y - p.ay) * (q.ax - p.ax) AS t1, (p.bx - p.ax) * (q.b_y - p.ay) - (p.b_y - p.ay) * (q.bx - p.ax) AS t2,
(q.bx - q.ax) * (p.ay - q.ay) - (q.b_y - q.ay) * (p.ax - q.ax) AS t3, (q.bx - q.ax) * (p.b_y - q.ay) - (q.b_y - q.ay) * (p.bx - q.ax) AS t4,
q.ax BETWEEN least(p.ax, p.bx) AND greatest(p.ax, p.bx) AND q.ay BETWEEN least(p.ay, p.b_y) AND greatest(p.ay, p.b_y) AS w1, q.bx BETWEEN least(p.ax, p.bx) AND greatest(p.ax, p.bx) AND q.b_y BETWEEN least(p.ay, p.b_y) AND greatest(p.ay, p.b_y) AS w2,
p.ax BETWEEN least(q.ax, q.bx) AND greatest(q.ax, q.bx) AND p.ay BETWEEN least(q.ay, q.b_y) AND greatest(q.ay, q.b_y) AS w3, p.bx BETWEEN least(q.ax, q.bx) AND greatest(q.ax, q.bx) AND p.b_y BETWEEN least(q.ay, q.b_y) AND greatest(q.ay, q.b_y) AS w4,
(p.ax - p.bx) * (q.bx - q.ax) + (p.ay - p.b_y) * (q.b_y - q.ay) AS fold_ahead, (q.ax - q.bx) * (p.bx - p.ax) + (q.ay - q.b_y) * (p.b_y - p.ay) AS fold_back FROM s p JOIN s q ON p.id = q.id AND p.i < q.i)
SELECT id, NOT bool_or(CASE WHEN opposite THEN sign(t1) * sign(t2) < 0 AND sign(t3) * sign(t4) < 0 OR (t1 = 0 AND w1) OR (t2 = 0 AND w2) OR (t3 = 0 AND w3) OR (t4 = 0 AND w4)
WHEN ahead THEN t2 = 0 AND fold_ahead > 0 ELSE t1 = 0 AND fold_back > 0 END) AS valid, 1 AS rings, 2 AS dim FROM turns GROUP BY id""")
def ring_validity(spark, sf_dir):
    paths = _paths(spark, sf_dir, closed=True)
    p = F.col("points")
    return paths.select("id", shapes.is_valid_ring(p).alias("valid"), shapes.n_rings(shapes.make_polygon(p)).cast("int").alias("rings"), shapes.dimension(F.lit("POLYGON")).alias("dim"))


@query(f"""WITH {_LINES}, near AS (SELECT id, event_id, floor(x / 25 + 0.5) * 25 AS x, floor(y / 25 + 0.5) * 25 AS y FROM pts),
runs AS (SELECT *, lag(x) OVER w IS DISTINCT FROM x OR lag(y) OVER w IS DISTINCT FROM y AS new FROM near WINDOW w AS (PARTITION BY id ORDER BY event_id))
SELECT id, count(*) AS n_points, sum(x) AS sx, sum(y) AS sy FROM runs WHERE new GROUP BY id""")
def line_snap(spark, sf_dir):
    total = lambda k: F.aggregate("points", F.lit(0.0), lambda t, p: t + p[k])
    return _lines(spark, sf_dir).select("id", shapes.snap(F.col("points"), 25.0).alias("points")).select("id", geo.n_points(F.col("points")).alias("n_points"), total("x").alias("sx"), total("y").alias("sy"))


@query(f"""WITH {POINTS} SELECT id, 33 AS n_points, round(16 * 9 * sin(2 * pi() / 32), 6) AS area, round(x - 3, 6) + 0e0 AS xmin, round(y + 3, 6) + 0e0 AS ymax FROM pts WHERE x IS NOT NULL""")
def point_buffer(spark, sf_dir):
    rings = tables.points(spark, sf_dir).where("x is not null").select("id", shapes.buffer_point(F.col("x"), F.col("y"), 3.0).alias("ring"))
    box = geo.envelope(F.col("ring"))
    return rings.select("id", F.size("ring").alias("n_points"), F.round(geo.ring_area(F.col("ring")), 6).alias("area"), (F.round(box["xmin"], 6) + F.lit(0.0)).alias("xmin"), (F.round(box["ymax"], 6) + F.lit(0.0)).alias("ymax"))


@query(f"""WITH {BASE}, {_nearest_sql('SELECT 80 AS tcols, ceil(rows / 2.5e0)::BIGINT AS trows, 0e0 AS tx, ceil(rows / 2.5e0) * 2.5e0 AS ty, 2.5e0 AS tcw, 2.5e0 AS tch FROM dims', 'band1')}
SELECT 1 AS band, tc.c AS col_idx, tc.r AS row_idx, least(255e0, greatest(0e0, floor(value + 0.5))) AS value FROM tc LEFT JOIN band1 USING (col_idx, row_idx)""")
def warp_read(spark, sf_dir):
    """A source with warp options in two steps: cell size, aligned, then bytes without sign on the same grid."""
    source = WarpSource(raster(spark, sf_dir, 2)).warp(WarpOptions(cell_size=(2.5, 2.5), aligned=True))
    return source.convert("int8").read(bands=(1,))
