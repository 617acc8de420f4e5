"""Grids, views, sources, vectors: golden values and properties."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import crs, geometry as geo, grid as g, wkb
from lattica.operators import convert, mosaic, resample, vector
from lattica.plans.errors import guarded
from lattica.plans.view import MosaicView, RasterView, aligned, overview_level
from lattica.sources import cities, geotiff
from lattica.types import Bounds, Extent, Grid, GridError


def array_view(spark, cells, grid=None, **kw):
    """A view of an array (bands, rows, cols); nan is NoData."""
    bands, rows, cols = cells.shape
    out = []
    for b in range(bands):
        for tr in range(-(-rows // 8)):
            for tc in range(-(-cols // 8)):
                t = np.full((8, 8), np.nan)
                part = cells[b, tr * 8 : tr * 8 + 8, tc * 8 : tc * 8 + 8]
                t[: part.shape[0], : part.shape[1]] = part
                out.append((tc, tr, b, [None if np.isnan(v) else float(v) for v in t.ravel()]))
    df = spark.createDataFrame(out, "tcol long, trow long, band int, cells array<double>")
    return RasterView("a", lambda bs, _: df.where(F.col("band").isin(*bs)), grid or Grid(Extent(0.0, 0.0, float(cols), float(rows)), cols, rows), bands=bands, **kw)


def cells_of(df):
    return {(r.band, r.col_idx, r.row_idx): r.value for r in df.select("band", "col_idx", "row_idx", "value").collect()}


@pytest.fixture(scope="module")
def cells():
    return np.random.default_rng(1).integers(-50, 300, (2, 24, 40)).astype(float)


def brute_nearest(cells, source, target):
    out = {}
    for b in range(len(cells)):
        for r in range(target.rows):
            for c in range(target.cols):
                x, y = target.extent.xmin + (c + 0.5) * target.cw, target.extent.ymax - (r + 0.5) * target.ch
                i, j = int(np.floor((x - source.extent.xmin) / source.cw)), int(np.floor((source.extent.ymax - y) / source.ch))
                if 0 <= i < source.cols and 0 <= j < source.rows:
                    out[b, c, r] = cells[b, j, i]
    return out


def test_bounds_and_extents_are_inverse():
    grid, rnd = Grid(Extent(-3.0, 2.0, 7.0, 12.0), 40, 25), random.Random(1)
    for _ in range(200):
        c, r = sorted(rnd.sample(range(-5, 45), 2)), sorted(rnd.sample(range(-5, 30), 2))
        b = Bounds(c[0], r[0], c[1], r[1])
        assert grid.bounds_for(grid.extent_for(b)) == b
    assert grid.bounds_for(grid.extent) == grid.bounds and grid.bounds.intersection(Bounds(50, 0, 60, 1)) is None
    assert grid.bounds_for(Extent(-9, -9, 99, 99), clamp=True) == grid.bounds


def test_column_bounds_match(spark):
    grid = Grid(Extent(-3.0, 2.0, 7.0, 12.0), 40, 25)
    rows = [(-3.0, 2.0, 7.0, 12.0), (0.1, 3.3, 0.4, 3.9), (-10.0, -10.0, 20.0, 20.0)]
    df = spark.createDataFrame(rows, "xmin double, ymin double, xmax double, ymax double")
    for clamp in (False, True):
        got = df.select(*[c.alias(k) for k, c in g.extent_to_bounds(grid, *(F.col(c) for c in df.columns), clamp=clamp).items()]).collect()
        assert [tuple(r) for r in got] == [(b.col_min, b.row_min, b.col_max, b.row_max) for b in (grid.bounds_for(Extent(*r), clamp) for r in rows)]


def test_window_is_a_crop_of_the_whole(spark, cells):
    view = array_view(spark, cells)
    whole = cells_of(view.read(bounds=view.grid.bounds))
    part = cells_of(view.read(bounds=Bounds(5, 3, 21, 17), bands=(1,)))
    assert part == {k: v for k, v in whole.items() if k[0] == 1 and 5 <= k[1] <= 21 and 3 <= k[2] <= 17}
    assert whole[0, 3, 2] == cells[0, 2, 3]
    assert cells_of(view.read(extent=view.grid.extent_for(Bounds(5, 3, 21, 17)), bands=(1,))) == part


def test_error_policies(spark, cells):
    view, out = array_view(spark, cells), Extent(1000.0, 1000.0, 1001.0, 1001.0)
    assert view.read(out).count() == 0
    with pytest.raises(GridError):
        view.read(out, on_error="strict")
    row = view.read(out, on_error="capture").first()
    assert row._error and row.value is None
    assert view.read(bounds=Bounds(0, 0, 1, 1), on_error="capture").where("_error is null").count() == 8
    with pytest.raises(ValueError):
        guarded(lambda: None, "other", lambda: None)


def test_many_windows_keep_each_window(spark, cells):
    view = array_view(spark, cells)
    w = spark.createDataFrame([(1, 0, 0, 9, 9), (2, 0, 0, 9, 9), (3, 35, 20, 60, 60), (4, -9, -9, -1, -1)], "window_id long, col_min long, row_min long, col_max long, row_max long")
    got = {r.window_id: (r.n, r.s) for r in view.read_many(w, (0,)).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == {1: (100, cells[0, :10, :10].sum()), 2: (100, cells[0, :10, :10].sum()), 3: (20, cells[0, 20:, 35:].sum())}
    small = view.resample(20, 12)
    got = {r.window_id: r.n for r in small.read_many(w, (0,)).groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 100, 2: 100}


@pytest.mark.parametrize("cols,rows", [(20, 12), (38, 23), (81, 50), (40, 24)])
def test_resample_nearest(spark, cells, cols, rows):
    view = array_view(spark, cells).resample(cols, rows)
    assert cells_of(view.read()) == brute_nearest(cells, array_view(spark, cells).grid, view.grid_extent)


def test_transforms_start_from_the_original(spark, cells):
    view = array_view(spark, cells)
    assert view.resample(7, 5).resample(20, 12).grid_extent == view.resample(20, 12).grid_extent
    assert cells_of(view.resample(7, 5).resample(20, 12).read()) == cells_of(view.resample(20, 12).read())
    assert view.resample(7, 5).resample(40, 24).target is None
    assert view.reproject(3857) is view
    assert view.convert("uint8").convert("int32").target_type == "int32"
    assert view.interpret_as("int16").metadata()["cell_type"] == "int16"


def test_region_and_cell_size(spark, cells):
    view = array_view(spark, cells)
    region = Grid(Extent(-3.0, -3.0, 9.0, 9.0), 6, 6)
    got = cells_of(view.resample_to_region(region).read())
    want = brute_nearest(cells, view.grid, region)
    assert len(got) == 72 and {k: v for k, v in got.items() if v is not None} == want
    assert view.resample_to_cell_size(2.0, 2.0).grid_extent.cols == 20


def test_aggregates_and_bilinear(spark, cells):
    view = array_view(spark, cells)
    block = cells.reshape(2, 6, 4, 10, 4)
    for method, f in (("average", np.mean), ("max", np.max), ("min", np.min), ("sum", np.sum), ("median", np.median)):
        got = cells_of(view.resample(10, 6, method).read())
        want = f(block, axis=(2, 4))
        assert all(abs(got[b, c, r] - want[b, r, c]) < 1e-9 for b in range(2) for c in range(10) for r in range(6))
    same = cells_of(resample.bilinear(view.read(), view.grid, view.grid))
    assert all(abs(v - cells[b, r, c]) < 1e-9 for (b, c, r), v in same.items()) and len(same) == cells.size


def test_conversion(spark):
    df = spark.createDataFrame([(0, 0, 0, v) for v in (-1.0, 275.0, 122.492, 64.1, 2.5, -2.5, None)], "band int, col_idx long, row_idx long, value double")
    got = lambda d: [r.value for r in d.collect()]
    assert got(convert.convert(df, "uint8")) == [0.0, 255.0, 122.0, 64.0, 3.0, 0.0, None]
    assert got(convert.convert(convert.convert(df, "int16"), "int16")) == got(convert.convert(df, "int16")) == [-1.0, 275.0, 122.0, 64.0, 3.0, -3.0, None]
    assert got(convert.convert(df, "bit"))[1] == 1.0 and got(convert.convert(df, "float64")) == got(df)
    with pytest.raises(ValueError):
        convert.convert_byte_only(df, "bit")


def test_mosaic_is_left_biased_and_associative(spark):
    rng = np.random.default_rng(4)
    parts = []
    for p in range(3):
        a = rng.integers(0, 9, (1, 8, 8)).astype(float)
        a[0][rng.random((8, 8)) < 0.4] = np.nan
        parts.append(a)
    dfs = [array_view(spark, a).read().withColumn("priority", F.lit(p)) for p, a in enumerate(parts)]
    want = {(0, c, r): next((float(a[0, r, c]) for a in parts if not np.isnan(a[0, r, c])), None) for c in range(8) for r in range(8)}
    assert cells_of(mosaic.merge(dfs)) == want
    left = mosaic.merge(dfs[:2]).withColumn("priority", F.lit(0))
    right = mosaic.merge(dfs[1:]).withColumn("priority", F.lit(1))
    assert cells_of(mosaic.merge([left, dfs[2]])) == cells_of(mosaic.merge([dfs[0], right])) == want


def test_mosaic_views(spark, cells):
    a = array_view(spark, cells[:1])
    b = array_view(spark, cells[1:], Grid(Extent(30.0, 10.0, 70.0, 34.0), 40, 24))
    m = MosaicView.of([a, b], 3857, name="m")
    assert m.grid == Grid(Extent(0.0, 0.0, 70.0, 34.0), 70, 34) and m.bands == 1 and len(m.resolutions()) == 2 and m.metadata()["name"] == "m"
    got = cells_of(m.read())
    assert got[0, 5, 15] == cells[0, 5, 5] and got[0, 60, 3] == cells[1, 3, 30] and len(got) == 40 * 24 * 2 - 10 * 14
    window = Bounds(35, 8, 50, 20)
    assert cells_of(m.read(bounds=window)) == {k: v for k, v in got.items() if 35 <= k[1] <= 50 and 8 <= k[2] <= 20}
    assert m.read(Extent(500.0, 500.0, 501.0, 501.0)).count() == 0
    assert m.convert("uint8").cell_type == "uint8"
    with pytest.raises(GridError):
        a.grid.combine(Grid(Extent(0.0, 0.0, 10.0, 10.0), 20, 20))
    three = MosaicView.of([a, a, a], 3857)
    assert cells_of(three.read()) == cells_of(a.read())
    assert not aligned(a.grid, Grid(Extent(0.5, 0.0, 40.5, 24.0), 40, 24))


def test_overviews():
    grids = [Grid(Extent(0.0, 0.0, 64.0, 64.0), 64 >> k, 64 >> k) for k in range(3)]
    assert [overview_level(grids, w) for w in (0.5, 1.0, 1.9, 2.0, 9.0)] == [0, 0, 0, 1, 2]
    assert overview_level(grids, 1.5, "auto_lower") == 1 and overview_level(grids, 9.0, "base") == 0


@pytest.mark.parametrize("srid", [3857, 32618, 32719])
def test_projections_round_trip(spark, srid):
    rnd = random.Random(2)
    lon0, lat0 = (-75.0, 40.0) if srid != 32719 else (-69.0, -30.0)
    points = [(lon0 + rnd.uniform(-3, 3), lat0 + rnd.uniform(-20, 20)) for _ in range(40)]
    df = spark.createDataFrame(points, "x double, y double")
    mx, my = crs.transform(F.col("x"), F.col("y"), 4326, srid)
    bx, by = crs.transform(F.col("mx"), F.col("my"), srid, 4326)
    for r in df.withColumns({"mx": mx, "my": my}).withColumns({"bx": bx, "by": by}).collect():
        assert abs(r.bx - r.x) < 1e-7 and abs(r.by - r.y) < 1e-7
        sx, sy = crs.transform_point(r.x, r.y, 4326, srid)
        assert abs(sx - r.mx) < 1e-6 and abs(sy - r.my) < 1e-6
    with pytest.raises(ValueError):
        crs.transform_point(0, 0, 4326, 43211)


def test_utm_golden():
    # the central meridian has the false easting; the equator the false northing
    x, y = crs.transform_point(-75.0, 0.0, 4326, 32618)
    assert abs(x - 500000) < 1e-6 and abs(y) < 1e-6
    x, y = crs.transform_point(-73.985, 40.748, 4326, 32618)
    assert abs(x - 585_700) < 100 and abs(y - 4_511_300) < 150


def test_reprojection(spark, cells):
    grid = Grid(Extent(-5.0, 40.0, 5.0, 46.0), 40, 24)
    view = array_view(spark, cells, grid, srid=4326).reproject(3857)
    whole = cells_of(view.read())
    target = view.grid_extent
    for (b, c, r), v in list(whole.items())[::37]:
        lon, lat = crs.transform_point(target.extent.xmin + (c + 0.5) * target.cw, target.extent.ymax - (r + 0.5) * target.ch, 3857, 4326)
        assert v == cells[b, int((46.0 - lat) / grid.ch), int((lon + 5.0) / grid.cw)]
    window = Bounds(3, 4, 17, 15)
    assert cells_of(view.read(bounds=window)) == {k: v for k, v in whole.items() if 3 <= k[1] <= 17 and 4 <= k[2] <= 15}


def test_reprojection_keeps_its_method_and_ends_at_the_poles(spark, cells):
    grid = Grid(Extent(-5.0, 40.0, 5.0, 46.0), 40, 24)
    view = array_view(spark, cells, grid, srid=4326)
    made = {m: cells_of(view.reproject_to_region(3857, Grid(Extent(-600_000.0, 4_800_000.0, 600_000.0, 5_800_000.0), 12, 10), m).read()) for m in ("nearest", "bilinear", "average", "max")}
    assert made["nearest"] != made["bilinear"] != made["average"] != made["max"]
    by = {}
    for (b, r, c), v in np.ndenumerate(cells):
        x, y = crs.transform_point(-5.0 + (c + 0.5) * grid.cw, 46.0 - (r + 0.5) * grid.ch, 4326, 3857)
        by.setdefault((b, int((x + 600_000) // 100_000), int((5_800_000 - y) // 100_000)), []).append(v)
    for k, v in made["average"].items():
        assert v is None if k not in by else abs(v - sum(by[k]) / len(by[k])) < 1e-9
    assert {k for k, v in made["max"].items() if v is not None} == set(by)
    polar = array_view(spark, cells, Grid(Extent(-180.0, -90.0, 180.0, 90.0), 40, 24), srid=4326).reproject(3857, "bilinear")
    assert abs(polar.grid_extent.extent.ymax) < 2.1e7 and polar.read().count() > 0
    x, y = crs.transform(F.lit(0.0), F.col("lat"), 4326, 3857)
    got = [r[0] for r in spark.createDataFrame([(-90.0,), (90.0,), (None,)], "lat double").select(y).collect()]
    assert abs(got[0] + got[1]) < 1e-6 and got[0] < -2e7 and got[2] is None


def test_region_windows_are_filled(spark, cells):
    whole = array_view(spark, cells, Grid(Extent(0.0, 0.0, 40.0, 24.0), 40, 24)).resample_to_region(Grid(Extent(-6.0, 12.0, 6.0, 24.0), 12, 12))
    every = cells_of(whole.read())
    assert len(every) == 144 * len(cells) and cells_of(whole.read(bounds=Bounds(0, 0, 11, 11))) == every
    small = cells_of(whole.read(bounds=Bounds(2, 3, 7, 8)))
    assert small == {k: v for k, v in every.items() if 2 <= k[1] <= 7 and 3 <= k[2] <= 8}
    many = whole.read_many(spark.createDataFrame([(1, 2, 3, 7, 8), (2, 2, 3, 7, 8)], "window_id long, col_min long, row_min long, col_max long, row_max long")).collect()
    for w in (1, 2):
        assert {(r.band, r.col_idx, r.row_idx): r.value for r in many if r.window_id == w} == small


@pytest.mark.parametrize("kw", [{}, {"endian": ">"}, {"tile": 16}, {"deflate": True, "predictor": 2}, {"tile": 16, "planar": True, "deflate": True}, {"nodata": 7.0}])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_geotiff(spark, tmp_path, kw, dtype):
    if kw.get("predictor") == 2 and dtype == "f4":
        pytest.skip("integers only")
    base = np.random.default_rng(3).integers(0, 100, (2, 29, 43)).astype(dtype)
    path = str(tmp_path / "a.tif")
    extent = Extent(630000.0, 215000.0, 634300.0, 217900.0)
    geotiff.write(path, [base, base[:, ::2, ::2]], extent, 32119, **kw)
    view = geotiff.view(spark, path)
    assert view.crs == 32119 and view.grid.cols == 43 and view.grid.rows == 29 and view.bands == 2 and len(view.overviews) == 1
    assert abs(view.grid.extent.ymin - extent.ymin) < 1e-6
    want = {(b, c, r): float(base[b, r, c]) if base[b, r, c] != kw.get("nodata") else None for b in range(2) for r in range(9, 21) for c in range(5, 31)}
    assert cells_of(view.read(bounds=Bounds(5, 9, 30, 20))) == want
    whole = {(b, c, r): float(base[b, r, c]) if base[b, r, c] != kw.get("nodata") else None for b in range(2) for r in range(29) for c in range(43)}
    assert cells_of(view.read()) == whole  # no cell of a tile's padding


def test_geotiff_segments_are_decoded_once(tmp_path, monkeypatch):
    base = np.arange(2 * 70 * 90, dtype=np.int32).reshape(2, 70, 90)
    path, reads = str(tmp_path / "a.tif"), []
    geotiff.write(path, [base], Extent(0.0, 0.0, 90.0, 70.0), tile=32, deflate=True)
    inner = geotiff.segment
    monkeypatch.setattr(geotiff, "segment", lambda read, im, index: reads.append(index) or inner(read, im, index))
    reader = geotiff._Reader({"path": path, "tcol_min": 4, "tcol_max": 7, "trow_min": 3, "trow_max": 8})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted(reads) == [1, 4, 7]  # the second of three columns of segments, each once for both bands
    assert {tuple(x) for b in got for x in zip(b["tcol"].to_pylist(), b["trow"].to_pylist(), b["band"].to_pylist())} == {(c, r, b) for c in range(4, 8) for r in range(3, 9) for b in range(2)}


def test_unpacking():
    """Against an encoder that keeps the same table."""
    raw = bytes(np.random.default_rng(1).integers(0, 4, 20_000).astype("u1"))

    def lzw(data):
        table, width, codes, word = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
        for i in range(len(data)):
            if word + data[i : i + 1] in table:
                word += data[i : i + 1]
                continue
            codes.append((table[word], width))
            table[word + data[i : i + 1]] = len(table) + 2
            word = data[i : i + 1]
            width = max(9, (len(table) + 2).bit_length()) if len(table) + 2 < 4094 else width
            if len(table) + 2 == 4094:
                codes.append((256, 12))
                table, width = {bytes([i]): i for i in range(256)}, 9
        codes += [(table[word], width), (257, width)]
        bits = "".join(f"{c:0{w}b}" for c, w in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    assert geotiff.unpack_lzw(lzw(raw)) == raw
    assert geotiff.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == b"\1\2\3\x09\x09\x09\x07"


def test_geotiff_errors(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        geotiff.info(str(tmp_path / "x.tif"))


def test_cities(spark):
    c = cities.table(spark)
    assert c.count() == 26 and c.select("name").distinct().count() == 24
    pairs = vector.distance_join(c, c, 0.5).alias("p").join(c.alias("a"), F.col("p.aid") == F.col("a.id")).join(c.alias("b"), F.col("p.bid") == F.col("b.id")).where("a.name <> b.name")
    n, total, low, high = pairs.agg(F.count("*"), F.sum("d"), F.min("d"), F.max("d")).first()
    assert n == 24 and round(total, 4) == 7.3902 and round(low, 4) == 0.0825 and round(high, 4) == 0.4752
    hit = geo.overlaps(F.col("x"), F.col("y"), F.col("x"), F.col("y"), F.lit(78.31), F.lit(40.29), F.lit(78.33), F.lit(40.31))
    assert [r.name for r in c.where(hit).collect()] == ["Altoona,PA"]
    assert vector.delete_where(c, F.col("id") != 26).count() == 1
    nulls = spark.createDataFrame([("washington", -77.02), ("london", None), ("paris", 2.347)], "name string, x double")
    assert {r.name for r in vector.delete_where(nulls, F.col("x") < 0).collect()} == {"london", "paris"}
    assert c.where("name = 'Reading,PA'").select(geo.as_geojson(F.col("x"), F.col("y"))).first()[0] == '{"type":"Point","coordinates":[75.97,40.38]}'


HEX = "002000000300000f110000000100000005c170b8793ccc8e80415ca9f4683a18dcc170b8793ccc8e8041631bf8457c1091c16ca9f4683a18dc41631bf8457c1091c16ca9f4683a18dc415ca9f4683a18dcc170b8793ccc8e80415ca9f4683a18dc"


@pytest.mark.parametrize("text", [HEX, "\\x" + HEX])
def test_hexadecimal_polygon(text):
    got = wkb.read_literal(text)
    assert got.kind == "POLYGON" and got.srid == 3857 and len(got.coords[0]) == 5 and got.coords[0][0] == got.coords[0][-1]
    assert got.coords[0][0] == (-17532819.799940586, 7514065.628545966)
    assert wkb.encode(got, big=True).hex() == HEX


@pytest.mark.parametrize("text", ["POINT (1 1)", "LINESTRING (1 1, 1 3)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 1), (2 2))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
                                  "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"])
@pytest.mark.parametrize("big", [False, True])
def test_wkb_round_trip(text, big):
    one = wkb.read_literal(f"SRID=43211;{text}")
    assert one.srid == 43211 and wkb.to_wkt(one) == text
    assert wkb.decode(wkb.encode(one, big=big)) == one
    assert wkb.decode(wkb.encode(one, srid=False, big=big)).srid is None
    assert wkb.read_literal("SRID=7;" + wkb.encode(one).hex()).srid == 7
    with pytest.raises((ValueError, struct.error, KeyError)):
        wkb.decode(wkb.encode(one)[:-1] + b"xx")


def test_geometry_columns(spark):
    line = F.from_json(F.lit('[{"x":1,"y":1},{"x":1,"y":3}]'), "array<struct<x:double,y:double>>")
    ring = F.from_json(F.lit('[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":3},{"x":0,"y":3},{"x":0,"y":0}]'), "array<struct<x:double,y:double>>")
    r = spark.range(1).select(
        geo.line_length(line).alias("length"), geo.ring_area(ring).alias("area"), geo.line_wkt(line).alias("wkt"), geo.ring_contains(ring, F.lit(1.0), F.lit(1.0)).alias("inside"), geo.ring_contains(ring, F.lit(5.0), F.lit(1.0)).alias("outside"),
        geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("east"), geo.sniff(F.lit("SRID=1;0101")).alias("hex"), geo.ewkt_srid(F.lit("POINT (1 1)")).alias("none"), geo.geom_type(F.lit("SRID=1;point (1 1)")).alias("kind"), *[c.alias(k) for k, c in geo.envelope(ring).items()]).first()
    assert r.length == 2.0 and r.area == 12.0 and r.wkt == "LINESTRING (1 1, 1 3)" and r.inside and not r.outside and abs(r.east - np.pi / 2) < 1e-12
    assert r.hex == "hex" and r.none is None and r.kind == "POINT" and (r.xmin, r.ymin, r.xmax, r.ymax) == (0.0, 0.0, 4.0, 3.0)


def test_insert(spark):
    base = spark.createDataFrame([(1, "a"), (5, "b")], "id int, name string")
    new = spark.createDataFrame([(None, "d"), (None, "c"), (4000, "z")], "id int, name string")
    assert sorted(tuple(r) for r in vector.insert(base, new, order=["name"]).collect()) == [(1, "a"), (5, "b"), (6, "c"), (7, "d"), (4000, "z")]


def test_attributes():
    view = RasterView("n", lambda b, r: None, Grid(Extent(0.0, 0.0, 1.0, 1.0), 1, 1), tags={"a": "b"}, band_tags=({"c": "d"},))
    assert view.attributes() == {"a": "b"} and view.attributes(0) == {"c": "d"} and view.attributes(9) == {}


def test_stream(spark, tmp_path):
    from lattica.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, 0, 0, [1.0, -9.0]), (1, 0, 1, [2.0, 3.0])], "tcol long, trow long, band int, cells array<double>").write.parquet(src)
    stream = spark.readStream.schema("tcol long, trow long, band int, cells array<double>").parquet(src)
    ingest.ingest_tiles(stream, out, str(tmp_path / "c"), nodata=-9.0).awaitTermination(120)
    assert sorted((r.band, r.cells) for r in spark.read.parquet(out).collect()) == [(0, [1.0, None]), (1, [2.0, 3.0])]
    events = spark.createDataFrame([("2024-01-01 00:10:00", 3, 1.0), ("2024-01-01 00:50:00", 19, 3.0), ("2024-01-01 02:00:00", 3, 5.0)], "t string, user_id long, value double").selectExpr("cast(t as timestamp_ntz) ts", "user_id", "value")
    events.write.parquet(str(tmp_path / "ev"))
    q = ingest.event_cells(spark.readStream.schema("ts timestamp_ntz, user_id long, value double").parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("cells_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.col_idx, r.n, r.value) for r in spark.table("cells_out").collect()) == [(3, 1, 5.0), (3, 2, 2.0)]


def test_registered_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "window_read_extent" in entry.queries()


def test_geohash_and_processing(spark):
    # published examples of the code
    got = spark.createDataFrame([(-5.6, 42.6), (10.40744, 57.64911)], "x double, y double").select(geo.geohash(F.col("x"), F.col("y"), 5).alias("h")).collect()
    assert [r.h for r in got] == ["ezs42", "u4pru"]
    line = geo.make_line(geo.point(F.lit(0), F.lit(0)), geo.point(F.lit(10), F.lit(0)))
    r = spark.range(1).select(
        F.size(geo.segmentize(line, 3.0)).alias("n"), geo.line_length(geo.segmentize(line, 3.0)).alias("same"), geo.point_line_distance(line, F.lit(5.0), F.lit(2.0)).alias("d"), geo.hausdorff(line, F.array(geo.point(F.lit(0), F.lit(1)))).alias("h"),
        F.size(geo.boundary(line)).alias("two"), F.size(geo.boundary(geo.make_box(*map(F.lit, (0, 0, 1, 1))))).alias("none"), geo.perimeter(geo.make_box(*map(F.lit, (0, 0, 2, 3)))).alias("p"), geo.dwithin(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), 5.0).alias("w")).first()
    assert (r.n, r.same, r.d, round(r.h, 6), r.two, r.none, r.p, r.w) == (5, 10.0, 2.0, round(101**0.5, 6), 2, 0, 10.0, True)


def test_jdbc(spark):
    from lattica.sources import jdbc

    url, kind = "jdbc:derby:memory:cities;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.create_table(spark, url, "places", {"id": "INT GENERATED BY DEFAULT AS IDENTITY", "name": "VARCHAR(40)", "geom": "BLOB"}, kind)
    c = cities.table(spark).selectExpr("name as NAME", "encode(name, 'UTF-8') as GEOM").coalesce(1)
    jdbc.insert(c, url, "places", kind)
    got = jdbc.table(spark, url, "places", kind, split=("ID", 1, 30, 3))
    assert got.count() == 26 and {r.ID for r in got.collect()} == set(range(1, 27))
    some = got.where("ID > 3 and NAME is not null").select("NAME")
    assert some.count() == 23 and "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,3)" in some._jdf.queryExecution().toString()
    assert jdbc.execute(spark, url, "DELETE FROM places WHERE id > 20", properties=kind) == [6]
    assert jdbc.table(spark, url, "places", kind).count() == 20
    jdbc.drop_table(spark, url, "places", kind)
    with pytest.raises(Exception):
        jdbc.table(spark, url, "places", kind).count()


def test_warp_options(spark, cells):
    from lattica.sources.warp import WarpOptions, WarpSource

    view = array_view(spark, cells, Grid(Extent(0.0, 0.0, 40.0, 24.0), 40, 24))
    source = WarpSource(view)
    assert source.dataset_type == "source" and source.reproject(3857) is source and cells_of(source.read()) == cells_of(view.read())
    small = source.resample(10, 6, "average")
    assert small.dataset_type == "warped" and small.metadata()["cols"] == 10 and cells_of(small.read()) == cells_of(view.resample(10, 6, "average").read())
    assert small.resample_to_grid(3.0, 3.0).options.dimensions is None
    assert small.resample_to_grid(3.0, 3.0).grid() == Grid(Extent(0.0, 0.0, 42.0, 24.0), 14, 8)
    bytes_ = source.warp(WarpOptions(cell_size=(2.0, 2.0))).convert("int8")
    assert bytes_.options.dimensions == (20, 12) and bytes_.view().target_type == "uint8" and bytes_.grid().cw == 2.0
    with pytest.raises(ValueError):
        source.convert("bit")
    geo = WarpSource(array_view(spark, cells, Grid(Extent(-5.0, 40.0, 5.0, 46.0), 40, 24), srid=4326)).reproject(3857, "bilinear")
    assert geo.metadata()["srid"] == 3857 and geo.metadata()["dataset"] == "warped" and geo.read().count() > 0
    noted = WarpSource(view).warp(WarpOptions(nodata=float(cells[0, 0, 0])))
    assert noted.view().nodata == cells[0, 0, 0] and noted.dataset_type == "warped"


def test_converted_warp_keeps_its_aligned_grid(spark, cells):
    from lattica.sources.warp import WarpOptions, WarpSource

    grid = Grid(Extent(0.0, 0.0, 40.0, 24.0), 40, 24)
    source = WarpSource(array_view(spark, cells, grid)).warp(WarpOptions(cell_size=(5.0, 7.0), aligned=True))
    bytes_, region = source.convert("int8"), Grid(Extent(0.0, 0.0, 40.0, 28.0), 8, 4)
    assert source.grid() == bytes_.grid() == region  # 24 is no multiple of 7: the region ends above the raster
    want = {k: min(255.0, max(0.0, v)) for k, v in brute_nearest(cells, grid, region).items()}
    assert len(want) == 2 * 8 * 3
    want |= {(b, c, 0): 0.0 for b in range(2) for c in range(8)}  # bytes without a NoData value are 0 where nothing is
    assert cells_of(bytes_.read()) == want
    assert cells_of(bytes_.read(bounds=Bounds(2, 0, 3, 1), bands=(1,))) == {k: v for k, v in want.items() if k[0] == 1 and k[1] in (2, 3) and k[2] < 2}
    windows = spark.createDataFrame([(1, 0, 0, 1, 1)], "window_id long, col_min long, row_min long, col_max long, row_max long")
    assert cells_of(bytes_.view().read_many(windows, (0,))) == {k: v for k, v in want.items() if k[0] == 0 and k[1] < 2 and k[2] < 2}
    assert cells_of(source.read())[0, 0, 0] is None and cells_of(bytes_.warp(WarpOptions(nodata=-999.0)).read())[0, 0, 0] is None
    moved = WarpSource(array_view(spark, cells, Grid(Extent(-5.0, 40.0, 5.0, 46.0), 40, 24), srid=4326)).warp(WarpOptions(cell_size=(3.0, 4.0), aligned=True)).convert("int16").reproject(3857)
    assert moved.grid() == Grid(resample.reprojected_extent(Extent(-6.0, 40.0, 6.0, 48.0), 4326, 3857), 4, 2)


def test_mode_of_blocks_with_rows_left_over(spark, tmp_path):
    from collections import Counter

    from lattica import queries

    labels = [random.Random(i).randrange(4) for i in range(50)]  # 16 rows of cells: three blocks of 5 and one row
    spark.createDataFrame([(i, [0.0] * 64, v) for i, v in enumerate(labels)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    blocks = {}
    for r in range(16):
        for c in range(200):
            blocks.setdefault((1, c // 5, r // 5), []).append(labels[r // 8 * 25 + c // 8])
    want = {k: float(min(Counter(v).items(), key=lambda e: (-e[1], e[0]))[0]) for k, v in blocks.items()}
    assert len(want) == 160 and cells_of(queries.QUERIES["resample_mode"](spark, str(tmp_path))) == want
