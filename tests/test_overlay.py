"""Polygons over each other: closed forms, inclusion and exclusion, hot cells, defined cases."""

import math

import numpy as np
import pytest

from tallygrove.operators import overlay
from tallygrove.report import Refusal

SHAPE = f"g string, geometry {overlay.RINGS}, name string"


def box(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h)), (float(x), float(y))]


def table(spark, rows, ids=("g",)):
    return spark.createDataFrame([(g, rings, "clash") for g, rings in rows], SHAPE)


def star(rng, span=100.0):
    c, n = rng.uniform(0, span, 2), int(rng.integers(3, 25))
    angle, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(5, 40, n)
    return np.stack([c[0] + far * np.cos(angle), c[1] + far * np.sin(angle)], axis=1)


def combined(spark, rows, **more):
    out = overlay.combined_area(table(spark, rows), "g", **more)
    areas = {r["g"]: r for r in out.report["areas"].collect()}
    return {r["g"]: r for r in out.df.collect()}, areas


def test_overlapping_touching_and_separate_areas(spark):
    rows = [("over", [box(0, 0, 100, 100)]), ("over", [box(50, 0, 100, 100)]), ("apart", [box(0, 0, 100, 100)]), ("apart", [box(5000, 0, 100, 100)])]
    rows += [("touch", [box(-100, 0, 100, 100)]), ("touch", [box(0, 0, 100, 100)]), ("hole", [box(0, 0, 200, 200), box(50, 50, 50, 50)])]
    rows += [("ring", [box(0, 0, 90, 30)]), ("ring", [box(0, 60, 90, 30)]), ("ring", [box(0, 0, 30, 90)]), ("ring", [box(60, 0, 30, 90)]), (None, [box(0, 0, 1, 1)]), ("none", None), ("flat", [box(0, 0, 5, 0)])]
    shapes, areas = combined(spark, rows)
    figures = {g: (r["parts"], round(r["parts_area"], 6), round(r["combined_area"], 6), round(r["overlap"], 6)) for g, r in areas.items()}
    assert figures == {"over": (2, 20000, 15000, 5000), "apart": (2, 20000, 20000, 0), "touch": (2, 20000, 20000, 0), "hole": (1, 37500, 37500, 0), "ring": (4, 10800, 7200, 3600), None: (1, 1, 1, 0), "flat": (1, 0, 0, 0)}
    assert {g: r["pieces"] for g, r in shapes.items()} == {"over": 1, "apart": 2, "touch": 1, "hole": 1, "ring": 1, None: 1}
    assert len(shapes["hole"]["geometry"][0]) == 2 and len(shapes["ring"]["geometry"][0]) == 2
    corners = [(p["x"], p["y"]) for p in shapes["touch"]["geometry"][0][0]]
    assert sorted(set(corners)) == [(-100, 0), (-100, 100), (100, 0), (100, 100)] and corners[0] == corners[-1]


@pytest.mark.parametrize("cell", [7.0, 32.0, 1000.0])
def test_unions_in_cells_and_blocks_equal_one_union(spark, monkeypatch, cell):
    monkeypatch.setattr(overlay, "BLOCK_POLYGONS", 5)
    rng = np.random.default_rng(11)
    shapes = [star(rng) - 60 for _ in range(60)]
    rows = [("a", [[tuple(map(float, p)) for p in s]]) for s in shapes] + [("a", [[tuple(map(float, p)) for p in shapes[0]]])] * 40
    whole = overlay.overlay([[s] for s in shapes], lambda x: x.any(axis=1), 1e-6)
    out, areas = combined(spark, rows, cell=cell, grid=1e-6)
    assert out["a"]["area"] == pytest.approx(overlay._size(whole), abs=1e-2) and areas["a"]["combined_area"] == pytest.approx(out["a"]["area"], abs=1e-3)
    assert out["a"]["pieces"] == len(whole) and sum(map(len, out["a"]["geometry"])) == sum(map(len, whole))
    assert areas["a"]["parts"] == 100


def test_clip_against_inclusion_and_exclusion(spark):
    rng = np.random.default_rng(3)
    a, b = [star(rng) for _ in range(12)], [star(rng) for _ in range(9)]
    make = lambda shapes, name: spark.createDataFrame([(i, [[tuple(map(float, p)) for p in s]]) for i, s in enumerate(shapes)], f"{name} long, geometry {overlay.RINGS}")
    got = {(r["id"], r["name"]): r["area"] for r in overlay.clip_polygons(make(a, "id"), make(b, "name"), cell=13.0, grid=1e-6).collect()}
    for i, s in enumerate(a):
        for j, q in enumerate(b):
            own = [overlay._size(overlay.overlay([[x]], lambda x: x[:, 0], 1e-6)) for x in (s, q)]
            both = overlay._size(overlay.overlay([[s], [q]], lambda x: x.any(axis=1), 1e-6))
            assert got.get((i, j), 0.0) == pytest.approx(sum(own) - both, abs=1e-2)


def test_clip_keeps_holes_and_leaves_out_empty_parts(spark):
    p = spark.createDataFrame([(1, [box(0, 0, 10, 10), box(4, 4, 2, 2)]), (2, [box(20, 0, 5, 5)]), (3, None), (4, [])], f"id long, geometry {overlay.RINGS}")
    a = spark.createDataFrame([("left", [box(-5, -5, 10, 30)]), ("edge", [box(25, 0, 5, 5)]), ("gone", None)], f"name string, geometry {overlay.RINGS}")
    rows = overlay.clip_polygons(p, a).collect()
    assert [(r["id"], r["name"], r["area"]) for r in rows] == [(1, "left", 48.0)]
    assert overlay.clip_polygons(p.limit(0), a, cell=10.0).count() == 0 and overlay.combined_area(table(spark, []), "g").df.count() == 0


def test_bands_around_areas(spark):
    ring = 16 * math.sin(math.pi / 16)  # area of the 32 corners on a circle of radius 1
    rows = [("box", [box(0, 0, 100, 60)]), ("closing", [box(0, 0, 100, 100), box(45, 45, 10, 10)]), ("open", [box(0, 0, 100, 100), box(20, 20, 60, 60)]), ("none", None)]
    got = {r["g"]: r for r in overlay.buffer_area(table(spark, rows), 10.0, id_="g", grid=1e-6).collect()}
    assert got["box"]["area"] == pytest.approx(6000 + 320 * 10 + 100 * ring, abs=0.01) and len(got["box"]["geometry"][0][0]) == 37
    assert got["closing"]["area"] == pytest.approx(10000 + 4000 + 100 * ring, abs=0.01) and len(got["closing"]["geometry"][0]) == 1
    assert got["open"]["area"] == pytest.approx(10000 + 4000 + 100 * ring - 1600, abs=0.01) and set(got) == {"box", "closing", "open"}
    same = {r["g"]: r["area"] for r in overlay.buffer_area(table(spark, rows), 0, id_="g").collect()}
    assert same == {"box": 6000, "closing": 9900, "open": 6400}
    with pytest.raises(Refusal):
        overlay.buffer_area(table(spark, rows), 60_000)


def test_metres_and_degrees(spark):
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(1, [[(-0.14, 51.51), (-0.13, 51.51), (-0.13, 51.52)]])], f"id long, geometry {overlay.RINGS}")
    m = p.withColumn("geometry", overlay.to_metres(F.col("geometry"), F.lit(30)))
    back = m.select(overlay.to_degrees(F.col("geometry"), F.lit(30), F.lit(False)).alias("g")).first()["g"]
    assert [round(v, 7) for q in back[0] for v in (q["x"], q["y"])] == [-0.14, 51.51, -0.13, 51.51, -0.13, 51.52]
    assert m.select(overlay.plane_area(F.col("geometry"))).first()[0] == pytest.approx(385_800, rel=0.01)


def test_cells_must_fit_the_grid(spark):
    with pytest.raises(Refusal):
        overlay.union_cells(table(spark, []), "g", 1.0005, 1e-3)


def test_boxes_meet_as_any_polygons():
    rng = np.random.default_rng(9)
    a, b = [np.stack([*(c := rng.integers(0, 12, 2)), *(c + rng.integers(1, 9, 2))]).astype(float) for _ in range(300)], [np.stack([*(c := rng.integers(0, 12, 2)), *(c + rng.integers(1, 9, 2))]).astype(float) for _ in range(300)]
    corners = lambda q: [np.array([[q[0], q[1]], [q[2], q[1]], [q[2], q[3]], [q[0], q[3]]])]
    some, rings = overlay._meet(np.array(a), np.array(b), 1e-3)
    got = dict(zip(some.tolist(), rings, strict=True))
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        want = overlay.overlay([corners(p), corners(q)], lambda inside: inside[:, 0] & inside[:, 1], 1e-3)
        assert (k in got) == bool(want) and (not want or np.array_equal(want[0][0], got[k]))


def test_equal_polygons_share_their_part(spark):
    p = spark.createDataFrame([(1, [box(0, 0, 10, 10)]), (2, [box(0, 0, 10, 10)]), (None, [box(0, 0, 10, 10)]), (3, [[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]])], f"id long, geometry {overlay.RINGS}")
    a = spark.createDataFrame([("x", [box(5, 5, 10, 10)]), ("y", [box(5, 5, 10, 10)]), ("z", [box(2, 2, 1, 1)])], f"name string, geometry {overlay.RINGS}")
    got = {(r["id"], r["name"]): r["area"] for r in overlay.clip_polygons(p, a).collect()}
    assert got == {(i, n): v for i in (1, 2, None) for n, v in (("x", 25), ("y", 25), ("z", 1))} | {(3, "z"): 1}


def test_rows_of_equal_polygons_are_written_out_last(spark, monkeypatch):
    """A pair of different polygons is laid over each other and rounded once, however many rows have them, in lists of bounded length."""
    monkeypatch.setattr(overlay, "LISTED", 64)
    p = spark.createDataFrame([(None if k < 5 else k, [box(k % 2, 0, 10, 10.123)]) for k in range(700)], f"id long, geometry {overlay.RINGS}")
    a = spark.createDataFrame([(f"{k:03d}", [box(5, 5, 10, 10)] if k % 3 else [[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]]) for k in range(300)], f"name string, geometry {overlay.RINGS}")
    out = overlay.clip_polygons(p, a, digits=1).select("id", "name", "area")
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = lambda word: next(i for i, line in enumerate(plan) if word in line)
    assert first("explode(ids") < first("explode(names") < first("Join") < first("round(")
    got = sorted((-1 if r["id"] is None else r["id"], r["name"], r["area"]) for r in out.collect())
    size = {(0, True): 25.6, (1, True): 30.7, (0, False): 50.0, (1, False): 40.5}
    assert got == sorted((-1 if k < 5 else k, f"{n:03d}", size[k % 2, n % 3 > 0]) for k in range(700) for n in range(300))


def test_boxes_are_clipped_as_in_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = (np.concatenate([low := rng.uniform(-9, 9, (60, 2)), low + rng.uniform(0.5, 8, (60, 2))], axis=1) for _ in range(2))
    make = lambda boxes, name: spark.createDataFrame([(k, [box(w, s, e - w, n - s)]) for k, (w, s, e, n) in enumerate(boxes.tolist())], f"{name} long, geometry {overlay.RINGS}")
    got = {(r["id"], r["name"]): ([(p["x"], p["y"]) for p in r["geometry"][0][0]], r["area"]) for r in overlay.clip_polygons(make(a, "id"), make(b, "name"), cell=4.0, grid=0.5).collect()}
    i, j = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    some, rings = overlay._meet(a[i], b[j], 0.5)
    assert set(got) == {(int(i[k]), int(j[k])) for k in some} and len(got) > 500
    for k, ring in zip(some, rings, strict=True):
        assert got[int(i[k]), int(j[k])] == ([tuple(q) for q in ring.tolist()], (ring[2, 0] - ring[0, 0]) * (ring[0, 1] - ring[1, 1]))


def test_equal_areas_have_one_band(spark):
    rows = [(k, [box(k % 2, 0, 10, 10)]) for k in range(400)]
    shapes, ids = overlay.shapes_of(spark.createDataFrame(rows, f"id long, geometry {overlay.RINGS}"), "id", "geometry")
    assert shapes.count() == 2 and ids.count() == 400
    got = overlay.buffer_area(spark.createDataFrame(rows, f"id long, geometry {overlay.RINGS}"), 1.0, grid=1e-6).collect()
    assert sorted(r["id"] for r in got) == list(range(400)) and {round(r["area"], 3) for r in got} == {round(140 + 16 * math.sin(math.pi / 16), 3)}


def test_boxes_are_united_as_other_polygons():
    """Boxes that overlap, touch along sides and at corners, lie in each other, leave holes, or vanish on the grid."""
    rng = np.random.default_rng(5)
    for n, side in ((1, 4), (6, 8), (40, 30), (300, 60), (300, 200)):
        low = rng.integers(-side, side, (n, 2))
        boxes = np.concatenate([low, low + rng.integers(1, 12, (n, 2))], axis=1).astype(float)
        ring = lambda w, s, e, t: np.array([[w, s], [e, s], [e, t], [w, t]])
        want = overlay.overlay([[ring(*b)] for b in boxes], lambda inside: inside.any(axis=1), 1e-3)
        got = overlay._united(boxes, 1e-3)
        shapes = lambda polygons: sorted(sorted(tuple(sorted(map(tuple, r[:-1].round(3).tolist()))) for r in p) for p in polygons)
        assert overlay._size(got) == pytest.approx(overlay._size(want)) and shapes(got) == shapes(want)
        i, at, corners = overlay._cut_boxes(boxes, 5.0)
        assert np.ptp(corners, axis=1).prod(axis=1).sum() == (boxes[:, 2:] - boxes[:, :2]).prod(axis=1).sum() and (np.ptp(corners, axis=1) > 0).all()
        assert (corners >= at[:, None] * 5.0).all() and (corners <= at[:, None] * 5.0 + 5.0).all() and set(i.tolist()) == set(range(n))
    assert overlay._united(np.array([[0.1, 0.0, 0.2, 5.0]]), 1.0) == []


def test_boxes_of_a_full_cell_meet_in_few_blocks(spark, monkeypatch):
    """Boxes and other polygons of one cell, more than a block of each: the same area as in one block."""
    rows = [("a", k % 31 * 1.0, k % 23 * 1.0, 3.0, 2.0, k % 10 == 0) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double, h double, cut boolean")
    corner = "struct(x + {} AS x, y + {} AS y)"
    ring = lambda *at: "array(" + ", ".join(corner.format(*p) for p in at) + ")"
    df = df.selectExpr("g", f"array(if(cut, {ring((0, 0), ('w', 0), (0, 'h'))}, {ring((0, 0), ('w', 0), ('w', 'h'), (0, 'h'))})) AS geometry")
    one = overlay.combined_area(df, "g", cell=100.0).report["areas"].first()
    monkeypatch.setattr(overlay, "BLOCK_BOXES", 100)
    some = overlay.combined_area(df, "g", cell=100.0).report["areas"].first()
    assert one["parts"] == some["parts"] == 700 and one["combined_area"] == pytest.approx(some["combined_area"], abs=1e-6) and one["overlap"] > 0
