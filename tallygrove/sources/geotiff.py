"""GeoTIFF as a Spark data source: rows (row, col, value) of a raster, read by strips or tiles, and written as a folder of tiles.

A partition is a run of strips or tiles of one file; a window (by options in degrees, or by filters on row and col where the session
has ``spark.sql.python.filterPushdown.enabled``) plans only those that it meets. A folder of files on one lattice is one raster. Single-band rasters in WGS84 degrees, north up; of a
point-registered one the outer edge lies half a cell out. Uncompressed, deflated or packed bits, with horizontal predictor or without.
Cells without data are null. Files are opened by ``pyarrow.fs``, so paths are local or of a store that it knows.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tallygrove.operators.raster import Grid
from tallygrove.report import Refusal

SCHEMA = "row long, col long, value double"
PARTITION_BYTES = 8 << 20  # of decoded cells in a partition
#: Fixed values of the format: sizes of field types, numbers of tags, kinds of compression, and keys of the coordinate system.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND, SCALE, TIE, TRANSFORM, GEOKEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
NONE, DEFLATE, OLD_DEFLATE, PACKED = 1, 8, 32946, 32773
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, GEOGRAPHIC, AREA, POINT, WGS84 = 1024, 1025, 2048, 2, 1, 2, 4326


@dataclass
class Header:
    """What the tags of a file say."""

    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    def check(self) -> Header:
        keys = self.tags.get(GEOKEYS, ())
        geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        if self.one(SAMPLES, 1) != 1:
            raise Refusal("a raster of one band is read; choose one")
        if geo.get(MODEL_KEY) != GEOGRAPHIC or geo.get(GEOGRAPHIC_KEY) != WGS84:
            raise Refusal("the raster is not in WGS84 degrees")
        if TRANSFORM in self.tags or SCALE not in self.tags or TIE not in self.tags:
            raise Refusal("the raster is not north up")
        if self.one(COMPRESSION, NONE) not in (NONE, DEFLATE, OLD_DEFLATE, PACKED) or self.one(PREDICTOR, 1) not in (1, 2):
            raise Refusal("this compression is not read")
        self.point = geo.get(RASTER_KEY) == POINT
        return self

    @property
    def grid(self) -> Grid:
        dx, dy = self.tags[SCALE][:2]
        i, j, _, x, y, _ = self.tags[TIE][:6]
        half = 0.5 if self.point else 0.0
        return Grid(x - (i + half) * dx, y + (j + half) * dy, dx, dy, int(self.one(HEIGHT)), int(self.one(WIDTH)))

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a strip or tile."""
        if TILES in self.tags:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(ROWS, self.one(HEIGHT)), self.one(HEIGHT)), self.one(WIDTH)

    @property
    def kind(self) -> np.dtype:
        letter = {1: "u", 2: "i", 3: "f"}.get(self.one(KIND, 1))
        bits = self.one(BITS, 1)
        if letter is None or bits not in (8, 16, 32, 64):
            raise Refusal("this type of cell is not read")
        return np.dtype(f"{'<' if self.order == '<' else '>'}{letter}{bits // 8}")

    @property
    def no_data(self) -> float | None:
        text = bytes(self.tags.get(NO_DATA, (b"",))[0]).split(b"\0")[0].strip()
        return float(text) if text else None

    def cells(self, data: bytes) -> np.ndarray:
        """The cells of one strip or tile, no data as NaN."""
        how = self.one(COMPRESSION, NONE)
        data = zlib.decompress(data) if how in (DEFLATE, OLD_DEFLATE) else _unpacked(data) if how == PACKED else data
        rows, cols = self.block
        x = np.frombuffer(data, self.kind, len(data) // self.kind.itemsize)
        x = x[: len(x) // cols * cols].reshape(-1, cols)
        if self.one(PREDICTOR, 1) == 2:
            x = np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("="))
        out = x.astype(np.float64)
        if self.no_data is not None:
            out[out == self.no_data] = np.nan
        out[~np.isfinite(out)] = np.nan
        return out


def _unpacked(data: bytes) -> bytes:
    """Packed bits: a count from 0 to 127 and so many bytes and one more, or a negative count and a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = struct.unpack_from("b", data, at)[0]
        if n >= 0:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n != -128:
                out += data[at + 1 : at + 2] * (1 - n)
            at += 2 if n != -128 else 1
    return bytes(out)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(path: str) -> Header:
    """The tags of a file, of the plain or the large form."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        start = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or (magic := struct.unpack(order + "H", start[2:4])[0]) not in (42, 43):
            raise Refusal(f"{path} is no GeoTIFF")
        large = magic == 43
        place = struct.unpack(order + ("Q" if large else "I"), start[8:16] if large else start[4:8])[0]
        n = struct.unpack(order + ("Q" if large else "H"), f.read_at(8 if large else 2, place))[0]
        entry, out = (20 if large else 12), Header(order)
        table = f.read_at(n * entry, place + (8 if large else 2))
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if large else "HHI"), table, k * entry)
            inline = table[k * entry + (12 if large else 8) : (k + 1) * entry]
            size = SIZES.get(kind, 1) * count
            data = inline[:size] if size <= len(inline) else f.read_at(size, struct.unpack(order + ("Q" if large else "I"), inline)[0])
            out.tags[tag] = (data,) if kind not in FORMATS else struct.unpack(f"{order}{count}{FORMATS[kind]}", data)
    return out.check()


def files_of(path: str) -> list[str]:
    """The file, or the GeoTIFF files of a folder."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/"))]
    return sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(at)) if i.path.lower().endswith((".tif", ".tiff")) and not i.base_name.startswith((".", "_")))


def grid_of(path: str) -> Grid:
    """The lattice of a file or of all files of a folder."""
    grids = [header(f).grid for f in files_of(path)]
    if not grids:
        raise Refusal(f"{path} holds no GeoTIFF")
    west, north, size, size_y = min(g.west for g in grids), max(g.north for g in grids), grids[0].size, grids[0].dy
    for g in grids:
        if abs(g.size - size) > 1e-9 * size or abs(g.dy - size_y) > 1e-9 * size_y or any(abs(x - round(x)) > 1e-3 for x in ((g.west - west) / size, (north - g.north) / size_y)):
            raise Refusal("the files are not on one lattice")
    rows, cols = max(round((north - g.north) / size_y) + g.rows for g in grids), max(round((g.west - west) / size) + g.cols for g in grids)
    return Grid(west, north, size, size_y, rows, cols)


@dataclass
class Blocks(InputPartition):
    path: str
    blocks: tuple[int, ...]
    row: int
    col: int
    window: tuple[int, int, int, int]  # first and last row, first and last column of the whole raster

    def __init__(self, path: str, blocks: tuple[int, ...], row: int, col: int, window: tuple[int, int, int, int]) -> None:
        super().__init__(None)
        self.path, self.blocks, self.row, self.col, self.window = path, blocks, row, col, window


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.box = [float(options[k]) if options.get(k) not in (None, "") else None for k in ("west", "south", "east", "north")]
        self.bounds = {"row": [0, 1 << 60], "col": [0, 1 << 60]}

    def partitions(self) -> list[Blocks]:
        whole = grid_of(self.path)
        (r0, r1), (c0, c1) = self.bounds["row"], self.bounds["col"]
        west, south, east, north = self.box
        if west is not None:
            c0 = max(c0, int(np.floor((west - whole.west) / whole.size)))
        if east is not None:
            c1 = min(c1, int(np.ceil((east - whole.west) / whole.size)) - 1)
        if north is not None:
            r0 = max(r0, int(np.floor((whole.north - north) / whole.dy)))
        if south is not None:
            r1 = min(r1, int(np.ceil((whole.north - south) / whole.dy)) - 1)
        out = []
        for path in files_of(self.path):
            h = header(path)
            g, (rows, cols) = h.grid, h.block
            top, left = round((whole.north - g.north) / whole.dy), round((g.west - whole.west) / whole.size)
            across = -(-g.cols // cols)
            first, last = max(0, (r0 - top) // rows), min(-(-g.rows // rows) - 1, (r1 - top) // rows)
            begin, end = max(0, (c0 - left) // cols), min(across - 1, (c1 - left) // cols)
            met = [i * across + j for i in range(first, last + 1) for j in range(begin, end + 1)]
            some = max(1, PARTITION_BYTES // (rows * cols * 8))
            out += [Blocks(path, tuple(met[k : k + some]), top, left, (r0, r1, c0, c1)) for k in range(0, len(met), some)]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        h = header(partition.path)
        g, (rows, cols) = h.grid, h.block
        across = -(-g.cols // cols)
        offsets, sizes = (h.tags[TILES], h.tags[TILE_BYTES]) if TILES in h.tags else (h.tags[STRIPS], h.tags[STRIP_BYTES])
        r0, r1, c0, c1 = partition.window
        store, at = _open(partition.path)
        with store.open_input_file(at) as f:
            for block in partition.blocks:
                top, left = block // across * rows, block % across * cols
                cells = h.cells(f.read_at(sizes[block], offsets[block])) if sizes[block] else np.full((rows, cols), np.nan)
                cells = cells[: g.rows - top, : g.cols - left]
                row, col = np.arange(cells.shape[0]) + top + partition.row, np.arange(cells.shape[1]) + left + partition.col
                in_row, in_col = (row >= r0) & (row <= r1), (col >= c0) & (col <= c1)
                cells, row, col = cells[in_row][:, in_col], row[in_row], col[in_col]
                step = max(1, (1 << 18) // max(1, len(col)))
                for k in range(0, len(row), step):
                    v = cells[k : k + step].ravel()
                    yield pa.record_batch([pa.array(np.repeat(row[k : k + step], len(col)), pa.int64()), pa.array(np.tile(col, len(row[k : k + step])), pa.int64()), pa.array(v, pa.float64(), mask=np.isnan(v))], names=["row", "col", "value"])


class FilteredReader(GeoTiffReader):
    """The reader of sessions that push filters into Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            bound = self.bounds.get(".".join(f.attribute)) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else None
            if bound is None or not isinstance(f.value, int):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                bound[0] = max(bound[0], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                bound[1] = min(bound[1], f.value - isinstance(f, LessThan))


def encode(cells: np.ndarray, west: float, north: float, dx: float, dy: float, strip: int = 64) -> bytes:
    """A GeoTIFF file of doubles in deflated strips; NaN is no data."""
    rows, cols = cells.shape
    strips = [zlib.compress(np.ascontiguousarray(cells[k : k + strip], "<f8").tobytes(), 6) for k in range(0, rows, strip)]
    keys = (1, 1, 0, 3, MODEL_KEY, 0, 1, GEOGRAPHIC, RASTER_KEY, 0, 1, AREA, GEOGRAPHIC_KEY, 0, 1, WGS84)
    offsets = tuple(8 + sum(map(len, strips[:k])) for k in range(len(strips)))
    tags = [
        (WIDTH, 4, (cols,)), (HEIGHT, 4, (rows,)), (BITS, 3, (64,)), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, offsets), (SAMPLES, 3, (1,)), (ROWS, 4, (strip,)),
        (STRIP_BYTES, 4, tuple(map(len, strips))), (KIND, 3, (3,)), (SCALE, 12, (dx, dy, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, west, north, 0.0)), (GEOKEYS, 3, keys), (NO_DATA, 2, b"nan\0"),
    ]
    place = 8 + sum(map(len, strips))
    place += place % 2
    more, entries = b"", b""
    after = place + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        data = values if kind == 2 else struct.pack(f"<{len(values)}{FORMATS[kind]}", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), after + len(more))
            more += data + b"\0" * (len(data) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    body = b"".join(strips)
    return struct.pack("<2sHI", b"II", 42, place) + body + b"\0" * ((8 + len(body)) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class GeoTiffWriter(DataSourceArrowWriter):
    """Writes each tile whose rows arrive together; a tile is moved to its name once it is complete, so a task may be tried again."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.block = options["path"], overwrite, int(options["block"])
        self.grid = [float(options[k]) for k in ("west", "north", "size", "size_y")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        names, current, cells = [], None, None

        def flush() -> None:
            if current is not None:
                name, (west, north, dx, dy) = f"tile_{current[0]}_{current[1]}.tif", self.grid
                data = encode(cells, west + current[1] * self.block * dx, north - current[0] * self.block * dy, dx, dy)
                part = f"{at}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{at}/{name}")
                names.append(name)

        for batch in iterator:
            row, col, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("row", "col", "value"))
            i, j = (row // self.block).astype(np.int64), (col // self.block).astype(np.int64)
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(i)], strict=True):
                if hi > lo:
                    if current != (i[lo], j[lo]):
                        flush()
                        current, cells = (int(i[lo]), int(j[lo])), np.full((self.block, self.block), np.nan)
                    cells[(row[lo:hi] % self.block).astype(int), (col[lo:hi] % self.block).astype(int)] = value[lo:hi]
        flush()
        return Written(tuple(names))

    def commit(self, messages) -> None:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        kept = {n for m in messages if m for n in m.names}
        for info in store.get_file_info(fs.FileSelector(at)):
            if info.base_name.startswith("_") or (self.overwrite and info.base_name.endswith(".tif") and info.base_name not in kept):
                with contextlib.suppress(OSError):
                    store.delete_file(info.path)

    def abort(self, messages) -> None:
        """Tiles of a failed job stay; they are written anew by the next one."""


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallygrove_geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return (FilteredReader if self.options.get("filters") == "true" else GeoTiffReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options), overwrite)


def read_geotiff(spark: SparkSession, path: str, west: float | None = None, south: float | None = None, east: float | None = None, north: float | None = None) -> DataFrame:
    """row, col, value of a file or folder; with a box, only of the cells that it touches. Rows and columns count from the raster's corner (``grid_of``)."""
    spark.dataSource.register(GeoTiff)
    r = spark.read.format(GeoTiff.name()).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for k, v in (("west", west), ("south", south), ("east", east), ("north", north)):
        r = r.option(k, v) if v is not None else r
    return r.load(path)


def write_geotiff(raster: DataFrame, grid: Grid, path: str, block: int = 512, overwrite: bool = True) -> None:
    """The raster as a folder of GeoTIFF tiles of ``block`` by ``block`` cells; cells that are absent or null have no data there.

    A tile is made in one task, which its size bounds; of a cell given twice either counts."""
    raster.sparkSession.dataSource.register(GeoTiff)
    cells = raster.where("row >= 0 AND col >= 0").select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    tile = [F.floor(F.col("row") / block), F.floor(F.col("col") / block)]
    dealt = cells.repartition(*tile).sortWithinPartitions(*tile)
    w = dealt.write.format(GeoTiff.name()).mode("overwrite" if overwrite else "append").option("block", block)
    for k, v in (("west", grid.west), ("north", grid.north), ("size", grid.size), ("size_y", grid.dy)):
        w = w.option(k, repr(float(v)))
    w.save(path)
