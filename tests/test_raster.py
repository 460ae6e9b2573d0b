"""Rasters: scanline runs against every cell, zonal figures by hand, medians, GeoTIFF there and back."""

import os
import statistics
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallygrove.operators import geo, overlay, raster
from tallygrove.report import Refusal
from tallygrove.sources import geotiff

SHAPE = f"name string, geometry {overlay.RINGS}"


def box(w, s, e, n):
    return [(float(w), float(s)), (float(e), float(s)), (float(e), float(n)), (float(w), float(n)), (float(w), float(s))]


@pytest.fixture(scope="module")
def small(spark):
    values = [1, 2, 3, 4, 5, None, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]
    cells = spark.createDataFrame([(i // 4, i % 4, None if v is None else float(v)) for i, v in enumerate(values)], "row long, col long, value double")
    return cells, raster.Grid(0.0, 4.0, 1.0)


def test_zonal_goldens(spark, small):
    cells, grid = small
    zones = spark.createDataFrame([("a", [box(0, 2, 2, 4)]), ("whole", [box(0, 0, 4, 4)]), ("half", [box(3, 2, 5, 4)]), ("beyond", [box(10, 10, 11, 11)]), ("hole", [box(0, 0, 4, 4), box(1, 1, 3, 3)])], SHAPE)
    got = {r["name"]: r for r in raster.zonal(cells, zones, grid).collect()}
    figures = {k: (r["total"], r["cells"], r["no_data"], r["outside"], r["low"], r["high"]) for k, r in got.items()}
    assert figures == {"a": (8, 3, 1, 0, 1, 5), "whole": (130, 15, 1, 0, 1, 16), "half": (12, 2, 0, 2, 4, 8), "beyond": (None, 0, 0, 1, None, None), "hole": (102, 12, 0, 0, 1, 16)}
    a = got["a"]
    assert (a["median"], a["mean"], a["populated"], a["share"]) == (2, pytest.approx(8 / 3), 3, 1) and a["deviation"] == pytest.approx((10 - (8 / 3) ** 2) ** 0.5)
    km2 = zones.where("name = 'a'").select(geo.area_m2(F.col("geometry")) / 1e6).first()[0]
    assert a["density"] == pytest.approx(8 / km2) and got["beyond"]["share"] is None and got["beyond"]["median"] is None
    assert raster.zonal(cells, zones.limit(0), grid).count() == 0 and raster.zonal(cells.limit(0), zones, grid).where("cells > 0").count() == 0


def cells_of(runs):
    return {(r["name"], r["row"], c) for r in runs.collect() for c in range(r["first"], r["last"] + 1)}


def test_runs_equal_a_test_of_every_cell(spark):
    rng = np.random.default_rng(5)
    grid = raster.Grid(-3.0, 17.0, 0.5, 0.25)
    shapes = {}
    for k in range(12):
        centre, angle = rng.uniform(2, 12, 2), np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 15)))
        ring = np.stack([centre[0] + rng.uniform(1, 6, len(angle)) * np.cos(angle), centre[1] + rng.uniform(1, 6, len(angle)) * np.sin(angle)], axis=1)
        shapes[f"p{k}"] = [ring] + ([centre + 0.2 * (ring - centre)] if k % 3 == 0 else [])
    table = spark.createDataFrame([(n, [[tuple(map(float, p)) for p in [*ring, ring[0]]] for ring in rings]) for n, rings in shapes.items()], SHAPE)
    got = cells_of(raster.runs(table, grid))
    want = {(n, r, c) for n, rings in shapes.items() for r in range(-40, 110) for c in range(-10, 60) if sum(overlay._holds(ring, np.array(grid.centre(c, r))) for ring in rings) % 2}
    assert got == want and len(want) > 300
    touched = cells_of(raster.runs(table, grid, touched=True))
    assert got <= touched
    for n, rings in shapes.items():  # a cell that is touched shares ground with the polygon, and no other does
        for r in range(-20, 90, 3):
            for c in range(-8, 50):
                x, y = grid.west + c * grid.size, grid.north - (r + 1) * grid.dy
                shared = overlay._size(overlay.overlay([rings, [np.array(box(x, y, x + grid.size, y + grid.dy)[:-1])]], lambda i: i.all(axis=1), 1e-9))
                assert ((n, r, c) in touched) == (shared > 1e-12) or shared < 1e-6


def test_runs_of_touching_edges_and_corners(spark, small):
    zones = spark.createDataFrame([("on", [box(0.5, 0.5, 2.5, 2.5)]), ("line", [box(0.5, 1, 2.5, 1)]), ("none", None), ("two", [box(0, 0, 1, 1), box(2, 0, 3, 1)])], SHAPE)
    got = cells_of(raster.runs(zones, small[1]))
    assert {x[1:] for x in got if x[0] == "on"} == {(r, c) for r in (1, 2) for c in (0, 1, 2)} or {x[1:] for x in got if x[0] == "on"} == {(r, c) for r in (2, 3) for c in (0, 1, 2)}
    assert {x[1:] for x in got if x[0] == "two"} == {(3, 0), (3, 2)} and not [x for x in got if x[0] in ("line", "none")]


def test_medians_in_passes(spark, monkeypatch):
    monkeypatch.setattr(raster, "BINS", 4)
    rng = np.random.default_rng(2)
    values = {"odd": rng.normal(size=41).tolist(), "even": rng.lognormal(3, 2, 60).tolist(), "ties": [7.0] * 30 + [1.0], "wide": [-1.7e308, 1.7e308, 3.0, 4.0], "one": [5.0], "none": [None, None]}
    df = spark.createDataFrame([(k, v) for k, some in values.items() for v in some] + [(None, 2.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in raster.exact_median(df, "k", "v").collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in values.items() if k != "none"} | {None: 3.0})


def test_geotiff_there_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    grid = raster.Grid(10.0, 50.0, 0.5, 0.25)
    rows = [(int(r), int(c), None if rng.random() < 0.1 else float(v)) for (r, c), v in np.ndenumerate(rng.normal(size=(70, 45)))]
    cells = spark.createDataFrame(rows, "row long, col long, value double")
    path = str(tmp_path / "tiles")
    geotiff.write_geotiff(cells, grid, path, block=32)
    assert sorted(os.listdir(path)) == [f"tile_{i}_{j}.tif" for i in range(3) for j in range(2)]
    whole = geotiff.grid_of(path)
    assert (whole.west, whole.north, whole.size, whole.dy, whole.rows, whole.cols) == (10, 50, 0.5, 0.25, 96, 64)
    back = {(r["row"], r["col"]): r["value"] for r in geotiff.read_geotiff(spark, path).collect()}
    assert len(back) == 96 * 64 and {k: v for k, v in back.items() if v is not None} == {(r, c): v for r, c, v in rows if v is not None}
    part = geotiff.read_geotiff(spark, path, west=11.0, south=45.0, east=13.0, north=47.0)
    assert {(r["row"], r["col"]) for r in part.collect()} == {(r, c) for r in range(12, 20) for c in range(2, 6)} and part.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = geotiff.read_geotiff(spark, path).where("row < 10 AND col = 3")
    assert few.count() == 10 and few.rdd.getNumPartitions() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    geotiff.write_geotiff(cells.where("row < 32"), grid, path, block=32)  # overwritten, not mixed
    assert sorted(os.listdir(path)) == ["tile_0_0.tif", "tile_0_1.tif"]


def tiff(cells, kind, bits, block=None, compression=1, predictor=1, point=False, order="<", no_data=None, projected=False, bands=1, rows=4):
    """A GeoTIFF of other makers' layouts."""
    h, w = cells.shape
    raw = cells.astype(np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}"))
    shown = lambda x: (np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1) if predictor == 2 else x).astype(raw.dtype).tobytes()
    if block:
        padded = np.zeros((-(-h // block) * block, -(-w // block) * block), raw.dtype)
        padded[:h, :w] = raw
        parts = [shown(padded[i : i + block, j : j + block]) for i in range(0, h, block) for j in range(0, w, block)]
    else:
        parts = [shown(raw[i : i + rows]) for i in range(0, h, rows)]
    pack = lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))
    parts = [zlib.compress(p) if compression == 8 else pack(p) if compression == 32773 else p for p in parts]
    offsets = [8 + sum(map(len, parts[:k])) for k in range(len(parts))]
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 2 if point else 1, 2048, 0, 1, 4326)
    tags = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (bits,)), (259, 3, (compression,)), (277, 3, (bands,)), (317, 3, (predictor,)), (339, 3, (kind,)), (33550, 12, (0.5, 0.5, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 10.0, 50.0, 0.0)), (34735, 3, keys)]
    tags += [(322, 3, (block,)), (323, 3, (block,)), (324, 4, offsets), (325, 4, [len(p) for p in parts])] if block else [(273, 4, offsets), (278, 3, (rows,)), (279, 4, [len(p) for p in parts])]
    tags += [(42113, 2, str(no_data).encode() + b"\0")] if no_data is not None else []
    at = 8 + sum(map(len, parts))
    entries, more = b"", b""
    for tag, k, v in sorted(tags):
        data = v if k == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[k] }", *v)
        if len(data) > 4:
            entries += struct.pack(order + "HHII", tag, k, len(v), at + 2 + 12 * len(tags) + 4 + len(more))
            more += data
        else:
            entries += struct.pack(order + "HHI", tag, k, len(v)) + data.ljust(4, b"\0")
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + more


@pytest.mark.parametrize("how", [{"kind": 3, "bits": 32}, {"kind": 2, "bits": 16, "compression": 8, "predictor": 2, "no_data": -9}, {"kind": 1, "bits": 8, "block": 8, "compression": 32773}, {"kind": 3, "bits": 64, "order": ">", "rows": 3}, {"kind": 1, "bits": 32, "block": 16, "compression": 8, "predictor": 2, "point": True}])
def test_geotiffs_of_other_layouts(spark, tmp_path, how):
    cells = np.arange(11 * 19).reshape(11, 19) % 120
    if how.get("no_data"):
        cells[3, 4] = how["no_data"]
    path = tmp_path / "one.tif"
    path.write_bytes(tiff(cells, **how))
    back = {(r["row"], r["col"]): r["value"] for r in geotiff.read_geotiff(spark, str(path)).collect()}
    assert back == {(r, c): (None if how.get("no_data") is not None and v == how["no_data"] else float(v)) for (r, c), v in np.ndenumerate(cells)}
    g = geotiff.grid_of(str(path))
    assert (g.west, g.north) == ((9.75, 50.25) if how.get("point") else (10, 50))


def test_a_window_plans_only_its_strips(tmp_path, monkeypatch):
    monkeypatch.setattr(geotiff, "PARTITION_BYTES", 1)
    path = tmp_path / "one.tif"
    path.write_bytes(tiff(np.arange(400).reshape(40, 10), 2, 16))
    plan = lambda **o: [p.blocks for p in geotiff.GeoTiffReader({"path": str(path), **o}).partitions()]
    assert len(plan()) == 10 and plan(north="46", south="44") == [(2,)] and plan(west="90", east="91") == []
    reader = geotiff.FilteredReader({"path": str(path)})
    left = list(reader.pushFilters([geotiff.GreaterThanOrEqual(("row",), 7), geotiff.LessThan(("row",), 12), geotiff.EqualTo(("value",), 3)]))
    assert [f.attribute for f in left] == [("value",)] and [p.blocks for p in reader.partitions()] == [(1,), (2,)]
    assert sorted({r for b in reader.partitions() for batch in reader.read(b) for r in batch.column(0).to_pylist()}) == [7, 8, 9, 10, 11]


@pytest.mark.parametrize("how", [{"projected": True}, {"bands": 3}, {"compression": 7}])
def test_rasters_that_are_refused(spark, tmp_path, how):
    path = tmp_path / "one.tif"
    path.write_bytes(tiff(np.ones((4, 4)), 1, 8, **how))
    with pytest.raises(Refusal):
        geotiff.grid_of(str(path))
    with pytest.raises(PySparkException):
        geotiff.read_geotiff(spark, str(path)).count()
