"""GeoTIFF as a Spark data source.

``spark.read.format("geotiff").load(path)`` gives 8x8 tiles: tcol, trow, band,
cells (null is NoData). On the driver only headers are read; each partition is
a range of tile rows, as many as whole segments (strips or TIFF tiles) have,
and reads just the segments that it meets, by byte ranges, each of them once
for all bands and rows. Options: ``level`` (0 is the base image, then the
overviews), ``bands`` ("0,2"), ``trow_min``, ``trow_max``, ``tcol_min`` and
``tcol_max``.

Supported: little and big endian, classic and 64-bit files, strips and tiles,
chunky and planar bands, integers and floats of 8 to 64 bits and single bits,
no compression, deflate, LZW and PackBits, the horizontal predictor.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ElementTree
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.view import SIDE, RasterView
from ..types import Extent, Grid

#: Tile rows in a partition.
ROWS = 64
#: Fixed values of the format: bytes of the field types, and the tags that are read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SUBFILE = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 254
SCALE, TIEPOINT, GEOKEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113


@dataclass
class Image:
    """One directory of a file: layout and position, no pixels."""

    endian: str
    cols: int
    rows: int
    bands: int
    dtype: np.dtype
    seg_w: int
    seg_h: int
    planar: bool
    compression: int
    predictor: int
    offsets: tuple
    counts: tuple
    scale: tuple = (1.0, 1.0)
    origin: tuple = (0.0, 0.0)
    srid: int | None = None
    nodata: float | None = None
    metadata: str = ""
    tags: dict = field(default_factory=dict)
    bits: int = 8

    @property
    def across(self) -> int:
        return -(-self.cols // self.seg_w)

    @property
    def grid(self) -> Grid:
        x, y = self.origin
        return Grid(Extent(x, y - self.rows * self.scale[1], x + self.cols * self.scale[0], y), self.cols, self.rows)


def headers(read) -> list[Image]:
    """All directories of a file. ``read(offset, length)`` reads a range."""
    start = read(0, 16)
    e = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack_from(f"{e}H", start, 2)[0] if e else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{e}Q", start, 8)[0] if big else struct.unpack_from(f"{e}I", start, 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(f"{e}Q", read(at, 8))[0] if big else struct.unpack(f"{e}H", read(at, 2))[0]
        size, first = (20, at + 8) if big else (12, at + 2)
        raw = read(first, n * size + (8 if big else 4))
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(f"{e}HH", raw, i * size)
            count, = struct.unpack_from(f"{e}Q" if big else f"{e}I", raw, i * size + 4)
            length, room = SIZES.get(kind, 1) * count, 8 if big else 4
            place = i * size + (12 if big else 8)
            if length <= room:
                data = raw[place : place + length]
            else:
                data = read(struct.unpack_from(f"{e}Q" if big else f"{e}I", raw, place)[0], length)
            code = CODES.get(kind)
            if code == "s":
                tags[tag] = data.rstrip(b"\0").decode("latin-1")
            elif code:
                tags[tag] = struct.unpack(f"{e}{count}{code}", data)
        out.append(_image(e, tags))
        at, = struct.unpack_from(f"{e}Q" if big else f"{e}I", raw, n * size)
    return out


def _image(e: str, tags: dict) -> Image:
    one = lambda t, d=None: tags.get(t, (d,))[0]
    bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    if bits not in (1, 8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    if one(COMPRESSION, 1) not in UNPACK:
        raise ValueError(f"compression {one(COMPRESSION)} is not supported")
    cols, rows, tiled = one(WIDTH), one(HEIGHT), TILES in tags
    scale, tie = tags.get(SCALE, (1.0, 1.0)), tags.get(TIEPOINT, (0, 0, 0, 0.0, 0.0, 0))
    keys = tags.get(GEOKEYS, ())
    srid = next((keys[i + 3] for k in (3072, 2048) for i in range(4, len(keys), 4) if keys[i] == k and keys[i + 1] == 0), None)
    nodata = tags.get(NODATA)
    return Image(
        e, cols, rows, one(SAMPLES, 1), np.dtype(f"{e}{kind}{max(bits // 8, 1)}"), one(TILE_W) if tiled else cols, one(TILE_H) if tiled else min(one(STRIP_ROWS, rows), rows), one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1),
        tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], (scale[0], scale[1]), (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), srid, float(nodata) if nodata else None, tags.get(METADATA, ""), bits=bits)


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: a count and a byte to repeat, or a count and as many bytes."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """LZW with the most significant bit first; 256 clears the table, 257 ends, codes widen one entry early."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out += entry
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


def segment(read, im: Image, index: int) -> np.ndarray:
    """A strip or tile as (rows, cols, samples)."""
    raw = UNPACK[im.compression](read(im.offsets[index], im.counts[index]))
    samples = 1 if im.planar else im.bands
    if im.bits == 1:  # rows begin at whole bytes
        line = -(-im.seg_w * samples // 8)
        rows = len(raw) // line
        return np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : im.seg_w * samples].reshape(rows, im.seg_w, samples)
    rows = len(raw) // (im.seg_w * samples * im.dtype.itemsize)
    out = np.frombuffer(raw, im.dtype, rows * im.seg_w * samples).reshape(rows, im.seg_w, samples)
    if im.predictor == 2:
        out = np.cumsum(out, 1, dtype=im.dtype.newbyteorder("="))
    elif im.predictor != 1:
        raise ValueError(f"predictor {im.predictor} is not supported")
    return out


class Segments:
    """Decoded segments of one image; those above the rows that are asked for are forgotten."""

    def __init__(self, read, im: Image):
        self.read, self.im, self.held = read, im, {}

    def rows(self, row0: int, row1: int, col0: int, col1: int, band: int) -> np.ndarray:
        """Cells of rows row0 .. row1-1 and columns col0 .. col1-1 of a band."""
        im, out = self.im, np.full((row1 - row0, col1 - col0), np.nan)
        down = -(-im.rows // im.seg_h)
        self.held = {k: v for k, v in self.held.items() if (k[0] + 1) * im.seg_h > row0}
        for r in range(row0 // im.seg_h, -(-row1 // im.seg_h)):
            for c in range(col0 // im.seg_w, -(-col1 // im.seg_w)):
                plane = band if im.planar else 0
                if (r, c, plane) not in self.held:
                    self.held[r, c, plane] = segment(self.read, im, (plane * down + r) * im.across + c)
                cells = self.held[r, c, plane][:, :, 0 if im.planar else band]
                top, left = r * im.seg_h, c * im.seg_w
                a, b = max(row0, top), min(row1, top + len(cells))
                x, y = max(col0, left), min(col1, left + im.seg_w)
                out[a - row0 : b - row0, x - col0 : y - col0] = cells[a - top : b - top, x - left : y - left]
        return out


def open_ranges(path: str):
    """(read, close) of a file in any file system that pyarrow reaches; a bare path is local."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    f = fs.open_input_file(name)
    return (lambda offset, length: f.read_at(length, offset)), f.close


def info(path: str) -> list[Image]:
    read, close = open_ranges(path)
    try:
        return headers(read)
    finally:
        close()


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.bands = [int(b) for b in options["bands"].split(",") if b] if "bands" in options else None
        self.window = {k: int(options[k]) for k in ("trow_min", "trow_max", "tcol_min", "tcol_max") if k in options}

    def partitions(self):
        im = info(self.path)[self.level]
        low, high = max(self.window.get("trow_min", 0), 0), min(-(-im.rows // SIDE) - 1, self.window.get("trow_max", 2**62))
        # a partition ends where segments end, so that no two partitions read one, unless strips are no multiple of tiles
        step = im.seg_h // SIDE if im.seg_h % SIDE == 0 else 1
        size = -(-ROWS // step) * step
        return [_Rows(self.path, max(r, low), min(r + size - 1, high)) for r in range(low // size * size, high + 1, size)]

    def read(self, part):
        read, close = open_ranges(part.path)
        try:
            im = headers(read)[self.level]
            source, right = Segments(read, im), -(-im.cols // SIDE) - 1
            first, last = max(self.window.get("tcol_min", 0), 0), min(right, self.window.get("tcol_max", right))
            across = last - first + 1
            if across <= 0:
                return
            for trow in range(part.first, part.last + 1):
                for band in range(im.bands) if self.bands is None else self.bands:
                    cells = source.rows(trow * SIDE, min((trow + 1) * SIDE, im.rows), first * SIDE, min((last + 1) * SIDE, im.cols), band)
                    full = np.full((SIDE, across * SIDE), np.nan)
                    full[: len(cells), : cells.shape[1]] = cells
                    if im.nodata is not None:
                        full[full == im.nodata] = np.nan
                    flat = full.reshape(SIDE, across, SIDE).transpose(1, 0, 2).reshape(-1)
                    values = pa.array(flat, pa.float64(), mask=np.isnan(flat))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(across + 1, dtype=np.int32) * SIDE * SIDE), values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last + 1)), pa.array(np.full(across, trow)), pa.array(np.full(across, band, np.int32)), lists], ["tcol", "trow", "band", "cells"])
        finally:
            close()


class GeoTiff(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "tcol long, trow long, band int, cells array<double>"

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def metadata_domains(text: str) -> dict[str, dict[str, str]]:
    """Entries by domain of the metadata element of a file ("" is the default domain); those of single bands are left out."""
    out: dict[str, dict[str, str]] = {}
    if text.strip():
        for item in ElementTree.fromstring(text.strip("\0 \n")).iter("Item"):
            if "sample" not in item.attrib:
                out.setdefault(item.get("domain", ""), {})[item.get("name", "")] = item.text or ""
    return out


def view(spark: SparkSession, path: str, name: str | None = None) -> RasterView:
    """A lazy view of a file: its headers are read now, its tiles when a read is run."""
    register(spark)
    images = info(path)
    base = images[0]

    def tiles(level):
        def load(bands, keys):
            r = spark.read.format("geotiff").option("path", path).option("level", level).option("bands", ",".join(map(str, bands)))
            if keys is not None:
                r = r.options(trow_min=keys.row_min, trow_max=keys.row_max, tcol_min=keys.col_min, tcol_max=keys.col_max)
            # the view drops the cells of edge tiles beyond the image
            return r.load()

        return load

    kind = "bit" if base.bits == 1 else {"u": "uint", "i": "int", "f": "float"}[base.dtype.kind] + str(base.dtype.itemsize * 8)
    domains = metadata_domains(base.metadata)
    return RasterView(name or path, tiles(0), base.grid, base.srid or 3857, base.bands, kind, tags=domains.get("", {}), domains=domains, overviews=tuple(i.grid for i in images[1:]), overview_tiles=tuple(tiles(i) for i in range(1, len(images))))


def write(path: str, levels: list[np.ndarray], extent: Extent, srid: int = 3857, endian: str = "<", tile: int | None = None, deflate: bool = False, planar: bool = False, predictor: int = 1, nodata: float | None = None, strip_rows: int = 16, metadata: str = "") -> None:
    """Write arrays (bands, rows, cols), base first, as one file; ``path`` as in ``open_ranges``."""
    body, pointer = bytearray(struct.pack(f"{endian}2sHI", b"II" if endian == "<" else b"MM", 42, 0)), 4
    for cells in levels:
        bands, rows, cols = cells.shape
        dtype = cells.dtype.newbyteorder(endian)
        w, h = (tile, tile) if tile else (cols, strip_rows)
        offsets, counts = [], []
        for plane in range(bands) if planar else [slice(None)]:
            part = cells[plane : plane + 1] if planar else cells
            for r in range(0, rows, h):
                for c in range(0, cols, w):
                    cut = part[:, r : r + h, c : c + w]
                    if tile:
                        cut = np.pad(cut, ((0, 0), (0, h - cut.shape[1]), (0, w - cut.shape[2])))
                    data = cut.transpose(1, 2, 0)
                    if predictor == 2:
                        data = np.concatenate((data[:, :1], np.diff(data, axis=1)), 1)
                    raw = data.astype(dtype).tobytes()
                    raw = zlib.compress(raw) if deflate else raw
                    offsets.append(len(body))
                    counts.append(len(raw))
                    body += raw
        kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
        fields = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [cells.dtype.itemsize * 8] * bands), (COMPRESSION, "H", [8 if deflate else 1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [2 if planar else 1]), (PREDICTOR, "H", [predictor]), (FORMAT, "H", [kind] * bands),
                  (SCALE, "d", [extent.width / cols, extent.height / rows, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, extent.xmin, extent.ymax, 0.0]), (GEOKEYS, "H", [1, 1, 0, 1, 3072, 0, 1, srid])]
        fields += [(TILE_W, "I", [w]), (TILE_H, "I", [h]), (TILES, "I", offsets), (TILE_BYTES, "I", counts)] if tile else [(STRIPS, "I", offsets), (STRIP_ROWS, "I", [h]), (STRIP_BYTES, "I", counts)]
        if metadata and cells is levels[0]:
            fields.append((METADATA, "s", [metadata.encode() + b"\0"]))
        if nodata is not None:
            fields.append((NODATA, "s", [f"{nodata:g}".encode() + b"\0"]))
        entries = []
        for tag, code, values in sorted(fields):
            raw = values[0] if code == "s" else struct.pack(f"{endian}{len(values)}{code}", *values)
            count, number = len(raw) if code == "s" else len(values), {"s": 2, "H": 3, "I": 4, "d": 12}[code]
            if len(raw) > 4:
                place = struct.pack(f"{endian}I", len(body))
                body += raw
            else:
                place = raw.ljust(4, b"\0")
            entries.append(struct.pack(f"{endian}HHI", tag, number, count) + place)
        struct.pack_into(f"{endian}I", body, pointer, len(body))
        body += struct.pack(f"{endian}H", len(entries)) + b"".join(entries)
        pointer = len(body)
        body += b"\0\0\0\0"
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(name) as f:
        f.write(bytes(body))
