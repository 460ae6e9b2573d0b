"""Polygons laid over each other: intersections, unions by group, and bands around areas.

A polygon is an array of rings (arrays of points x, y; the first ring outside, the others holes); several polygons of one row
are an array of those. Coordinates are metres or degrees of one plane; corners and crossings are set to a common ``grid``,
so that pieces made in different tasks fit without gaps.

Spark deals the work: polygons meet in cells of a grid, a cell with many polygons is dealt in blocks, and a small numpy helper
(``overlay``) arranges the edges of one pair or one block. Unions are partial in each cell, and merged, where one outline
is asked for, over neighbouring cells, four at a time.

Defined cases: null polygons, rings of fewer than three corners and parts without area are left out (an area that is wholly left out
gives no row); repeated polygons count once in a union, but each in the area of the parts; a boundary that two areas share is no overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.values import from_utm, to_utm
from tallygrove.report import OpResult, Refusal, stored

RINGS = "array<array<struct<x: double, y: double>>>"
MULTI = f"array<{RINGS}>"
BLOCK_POLYGONS, BLOCK_CORNERS = 64, 4000  # of one cell that meet in one task
LISTED = 1024  # ids of equal polygons in a list
BLOCK_BOXES = 2048  # upright boxes of one cell that meet in one task
MERGED = 16  # cells of a group that are merged at once; of more, four neighbours at a time
TURN = 0.7372773  # radians by which edges are turned while sides are told, so that none is upright
STABS = 1 << 22


# --- the helper: edges of one block ------------------------------------------------------------------------------------


def _pairs(low: np.ndarray, high: np.ndarray, keys: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each interval, in turn, the places of the sorted keys in it: (interval, place), some millions at a time."""
    first, last = np.searchsorted(keys, low), np.searchsorted(keys, high)
    count = np.maximum(last - first, 0)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STABS, side="right")))
        c = count[lo:hi]
        at = np.repeat(first[lo:hi] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        yield np.repeat(np.arange(lo, hi), c), order[at]
        lo = hi


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _split(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges cut wherever another one crosses, touches or ends on them: starts, ends, and the edge that each comes from."""
    left, right = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(left[:, 0], kind="stable")
    cut_of, cut_at = [np.arange(len(a)), np.arange(len(a))], [a, b]
    for i, j in _pairs(left[:, 0], right[:, 0] + 2, left[order, 0], order):
        some = (i != j) & (left[i, 1] <= right[j, 1] + 1) & (left[j, 1] <= right[i, 1] + 1)
        i, j = i[some], j[some]
        r, s = b[i] - a[i], b[j] - a[j]
        off = {}
        for key, line, base, run, point in (("js", i, a[i], r, a[j]), ("je", i, a[i], r, b[j]), ("is", j, a[j], s, a[i]), ("ie", j, a[j], s, b[i])):
            d, length = point - base, np.hypot(run[:, 0], run[:, 1])
            off[key] = _cross(run, d) / length
            along = (d * run).sum(axis=1) / length
            on = (np.abs(off[key]) <= 1) & (along > 0) & (along < length) & (point != base).any(axis=1) & (point != base + run).any(axis=1)
            cut_of.append(line[on])
            cut_at.append(point[on])
        proper = (off["js"] * off["je"] < 0) & (off["is"] * off["ie"] < 0) & (np.minimum.reduce([np.abs(v) for v in off.values()]) > 1)
        i, j, t = i[proper], j[proper], off["js"][proper] / (off["js"][proper] - off["je"][proper])
        # where j crosses the line of i: seen from j's start
        point = np.round(a[j] + (b[j] - a[j]) * t[:, None])
        cut_of += [i, j]
        cut_at += [point, point]
    of, at = np.concatenate(cut_of), np.concatenate(cut_at)
    along = ((at - a[of]) * (b[of] - a[of])).sum(axis=1)
    order = np.lexsort((along, of))
    of, at = of[order], at[order]
    step = (of[1:] == of[:-1]) & (at[1:] != at[:-1]).any(axis=1)
    return at[:-1][step], at[1:][step], of[:-1][step]


def overlay(polygons: list[list[np.ndarray]], keep: Callable[[np.ndarray], np.ndarray], grid: float) -> list[list[np.ndarray]]:
    """The area where ``keep`` holds, as polygons with closed rings.

    ``keep`` takes a matrix that tells for each place (row) which polygons (columns; even-odd over their rings) hold it. Edges are cut
    at all crossings; an edge bounds the result if ``keep`` differs between its sides; those edges are joined to rings.
    """
    rings = [(np.round(np.asarray(ring, float) / grid), k) for k, rings in enumerate(polygons) for ring in rings if len(ring) > 2]
    if not rings:
        return []
    shift = np.min([ring.min(axis=0) for ring, _ in rings], axis=0)
    a = np.concatenate([ring for ring, _ in rings]) - shift
    b = np.concatenate([np.roll(ring, -1, axis=0) for ring, _ in rings]) - shift
    owner = np.concatenate([np.full(len(ring), k) for ring, k in rings])
    some = (a != b).any(axis=1)
    a, b, owner = a[some], b[some], owner[some]
    for _ in range(4):  # points set to the grid may lie on other edges
        before = len(a)
        a, b, of = _split(a, b)
        owner = owner[of]
        if len(a) == before:
            break
    if not len(a):
        return []
    _, ids = np.unique(np.concatenate([a, b]) @ np.array([1, 1j]), return_inverse=True)
    u, v = ids[: len(a)], ids[len(a) :]
    points = np.zeros((int(ids.max()) + 1, 2))
    points[u], points[v] = a, b
    edge, of = np.unique(np.minimum(u, v).astype(np.int64) * len(points) + np.maximum(u, v), return_inverse=True)
    u, v = edge // len(points), edge % len(points)
    m = len(polygons)
    odd = (np.bincount(of * m + owner, minlength=len(edge) * m).reshape(len(edge), m) & 1).astype(bool)  # which polygons an edge bounds
    # which polygons lie above each edge, by the parity of the edges above its middle
    turned = points @ np.array([[np.cos(TURN), np.sin(TURN)], [-np.sin(TURN), np.cos(TURN)]])
    swap = turned[u, 0] > turned[v, 0]
    u, v = np.where(swap, v, u), np.where(swap, u, v)
    middle = (turned[u] + turned[v]) / 2
    order = np.argsort(middle[:, 0], kind="stable")
    bound, whose = np.nonzero(odd)
    above = np.zeros((len(edge), m), np.int32)
    run = turned[v] - turned[u]
    for k, e in _pairs(turned[u[bound], 0], turned[v[bound], 0], middle[order, 0], order):
        f = bound[k]
        higher = (f != e) & (_cross(run[f], middle[e] - turned[u[f]]) < 0)
        np.add.at(above, (e[higher], whose[k[higher]]), 1)
    above = (above & 1).astype(bool)
    over, under = keep(above), keep(above ^ odd)
    bounds = np.flatnonzero(over != under)
    start, end = np.where(over, u, v)[bounds], np.where(over, v, u)[bounds]  # the area is on the left
    return _joined(points, start, end, shift, grid)


def _joined(points: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray, grid: float) -> list[list[np.ndarray]]:
    """Polygons of directed edges that have the area on their left: at each corner the next edge is the first one clockwise."""
    out: dict[int, list[int]] = {}
    for k, s in enumerate(start.tolist()):
        out.setdefault(s, []).append(k)
    heading = np.arctan2(*(points[end] - points[start]).T[::-1])
    onward = np.full(len(start), -1)
    for k, e in enumerate(end.tolist()):
        choice = out.get(e, [])
        if len(choice) == 1:
            onward[k] = choice[0]
        elif choice:
            back = heading[k] + np.pi
            onward[k] = min(choice, key=lambda c: (back - heading[c]) % (2 * np.pi) or 2 * np.pi)
    seen, outer, holes = np.zeros(len(start), bool), [], []
    for k in range(len(start)):
        trail, at = [], k
        while at >= 0 and not seen[at]:
            seen[at] = True
            trail.append(at)
            at = int(onward[at])
        if at != k or len(trail) < 3:
            continue
        ring = points[start[trail]]
        ahead, behind = np.roll(ring, -1, axis=0) - ring, ring - np.roll(ring, 1, axis=0)
        ring = ring[np.abs(_cross(behind, ahead)) > 0]
        if len(ring) > 2 and (size := _area(ring)):
            (outer if size > 0 else holes).append((abs(size), ring, (points[start[trail[0]]] + points[end[trail[0]]]) / 2))
    outer.sort(key=lambda x: x[0])
    polygons = [[ring] for _, ring, _ in outer]
    for _, hole, inside in holes:
        home = next((p for p, (_, ring, _) in zip(polygons, outer, strict=True) if _holds(ring, inside)), None)
        if home is not None:
            home.append(hole)
    return [[(np.concatenate([ring, ring[:1]]) + shift) * grid for ring in p] for p in polygons]


def _area(ring: np.ndarray) -> float:
    """Signed area; counter-clockwise is positive."""
    p = ring - ring[0]
    return float(_cross(p, np.roll(p, -1, axis=0)).sum()) / 2


def _holds(ring: np.ndarray, at: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    crosses = (a[:, 1] > at[1]) != (b[:, 1] > at[1])
    a, b = a[crosses], b[crosses]
    return bool(((b[:, 0] - a[:, 0]) * (at[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > at[0]).sum() % 2)


def _size(polygons: list[list[np.ndarray]]) -> float:
    return sum(abs(_area(p[0])) - sum(abs(_area(h)) for h in p[1:]) for p in polygons)


def _side(ring: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """The part of a ring where sign * (coordinate - at) is not above 0; parts may hang together along the line."""
    if not len(ring):
        return ring
    d = sign * (ring[:, axis] - at)
    ahead, d_ahead = np.roll(ring, -1, axis=0), np.roll(d, -1)
    crosses = np.flatnonzero((d <= 0) != (d_ahead <= 0))
    met = ring[crosses] + (ahead[crosses] - ring[crosses]) * (d[crosses] / (d[crosses] - d_ahead[crosses]))[:, None]
    met[:, axis] = at
    stay = np.flatnonzero(d <= 0)
    return np.concatenate([ring[stay], met])[np.argsort(np.concatenate([2 * stay, 2 * crosses + 1]), kind="stable")]


def _cut(rings: list[np.ndarray], axis: int, cell: float) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts of a polygon in each strip of the grid."""
    lo, hi = min(r[:, axis].min() for r in rings), max(r[:, axis].max() for r in rings)
    first, last = int(np.floor(lo / cell)), max(int(np.floor(lo / cell)), int(np.ceil(hi / cell)) - 1)
    for k in range(first, last + 1):
        part = rings if first == last else [_side(_side(r, axis, k * cell, -1), axis, (k + 1) * cell, 1) for r in rings]
        part = [r for r in part if len(r) > 2]
        if part:
            yield k, part


def _cut_boxes(boxes: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of upright boxes in the cells of the grid: the box each comes from, the cell (cx, cy) and four corners."""
    first = np.floor(boxes[:, :2] / cell).astype(np.int64)
    size = np.maximum(first, np.ceil(boxes[:, 2:] / cell).astype(np.int64) - 1) - first + 1
    count = size.prod(axis=1)
    i = np.repeat(np.arange(len(boxes)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = first[i] + np.stack([k // size[i, 1], k % size[i, 1]], axis=1)
    low, high = np.maximum(boxes[i, :2], at * cell), np.minimum(boxes[i, 2:], (at + 1) * cell)
    return i, at, np.stack([low, np.stack([high[:, 0], low[:, 1]], axis=1), high, np.stack([low[:, 0], high[:, 1]], axis=1)], axis=1)


# --- Arrow columns -----------------------------------------------------------------------------------------------------


def _one(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def read_rings(column) -> list[list[np.ndarray]]:
    """A column of polygons as lists of arrays of corners, without closing points; points that aren't finite are left out."""
    column = _one(column)
    rings = column.flatten()
    n_rings = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    n_points = np.cumsum(pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False))
    xy = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten()], axis=1) if len(rings) else np.zeros((0, 2))
    cut = []
    for lo, hi in zip(np.concatenate([[0], n_points[:-1]]) if len(n_points) else [], n_points, strict=True):
        ring = xy[int(lo) : int(hi)]
        ring = ring[np.isfinite(ring).all(axis=1)]
        cut.append(ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring)
    return [[r for r in cut[int(lo) : int(hi)] if len(r) > 2] for lo, hi in zip(np.concatenate([[0], n_rings[:-1]]) if len(n_rings) else [], n_rings, strict=True)]


def write_rings(rows: list[list[np.ndarray]]) -> pa.Array:
    rings = [r for row in rows for r in row]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0], pa.float64()), pa.array(xy[:, 1], pa.float64())], names=["x", "y"])
    offsets = lambda lengths: pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) if len(lengths) else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets([len(row) for row in rows]), pa.ListArray.from_arrays(offsets([len(r) for r in rings]), points))


def write_multi(rows: list[list[list[np.ndarray]]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32) if rows else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), write_rings([p for row in rows for p in row]))


# --- operators -----------------------------------------------------------------------------------------------------------


def to_metres(polygon: Column, zone: Column) -> Column:
    """A polygon of degrees in the UTM metres of a zone."""
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(to_utm(p.x, p.y, zone)[0].alias("x"), to_utm(p.x, p.y, zone)[1].alias("y"))))


def to_degrees(polygon: Column, zone: Column, south: Column) -> Column:
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(from_utm(p.x, p.y, zone, south)[0].alias("x"), from_utm(p.x, p.y, zone, south)[1].alias("y"))))


def _typed(polygon: Column) -> Column:
    return polygon.cast(RINGS)


def plane_area(polygon: Column) -> Column:
    """Area of a polygon in square units: the outer ring less its holes."""

    def ring_area(ring: Column) -> Column:
        turn = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: (p.x - ring[0].x) * (q.y - ring[0].y) - (q.x - ring[0].x) * (p.y - ring[0].y))
        return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, x: s + x)) / 2

    areas = F.transform(polygon, ring_area)
    return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)


def multi_area(geometry: Column) -> Column:
    return F.aggregate(F.transform(geometry, plane_area), F.lit(0.0), lambda s, x: s + x)


def _coordinates(rings: Column, axis: str) -> Column:
    return F.flatten(F.transform(rings, lambda ring: F.transform(ring, lambda p: p[axis])))


def _boxed(df: DataFrame, prefix: str, cell: float) -> DataFrame:
    """df (id, rings) and its box; a row for each cell that the box touches."""
    d = df.withColumns({f"{prefix}{n}": f(_coordinates(F.col("rings"), axis)) for n, f, axis in (("w", F.array_min, "x"), ("e", F.array_max, "x"), ("s", F.array_min, "y"), ("n", F.array_max, "y"))})
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(prefix + lo) / cell), F.floor(F.col(prefix + hi) / cell)))
    return d.withColumn("cx", span("w", "e")).withColumn("cy", span("s", "n"))


def tasks(df: DataFrame) -> int:
    """As many tasks as the session's shuffles, whatever the bytes: laying polygons over each other takes time, not room."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def side_of(df: DataFrame, polygon: str, grid: float, times: float = 4) -> float:
    """A cell for such polygons: four (``times``) times the mean longer side of their boxes, as a multiple of the grid."""
    xs, ys = _coordinates(F.col(polygon), "x"), _coordinates(F.col(polygon), "y")
    side = df.agg(F.avg(F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)))).first()[0]
    return max(1, round(times * (side or 1.0) / grid)) * grid


def shapes_of(df: DataFrame, id_: str, polygon: str) -> tuple[DataFrame, DataFrame]:
    """shape, rings of the different polygons, and shape, id of each row: equal polygons are laid over others once."""
    rows = df.select(F.col(id_).alias("id"), _typed(F.col(polygon)).alias("rings")).where("rings is not null").withColumn("code", F.xxhash64("rings"))
    shapes = stored(rows.select("code", "rings").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return shapes.select("shape", "rings"), rows.join(shapes, ["code", "rings"]).select("shape", "id")


def _boxes(column) -> np.ndarray:
    """West, south, east and north of the rows that are one upright box, of others NaN."""
    column = _one(column)
    rings = column.flatten()
    n_rings = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_points = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(column), 4), np.nan)
    row = np.flatnonzero(n_rings == 1)
    ring = (np.cumsum(n_rings) - n_rings)[row]
    four = (n_points[ring] == 4) | (n_points[ring] == 5)
    row, ring = row[four], ring[four]
    if not len(row):
        return out
    xy = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten()], axis=1)
    first = (np.cumsum(n_points) - n_points)[ring]
    p = xy[first[:, None] + np.arange(4)]
    closed = (n_points[ring] == 4) | (xy[first + n_points[ring] - 1] == xy[first]).all(axis=1)
    x, y = p[:, :, 0], p[:, :, 1]
    level = (x[:, 0] == x[:, 3]) & (x[:, 1] == x[:, 2]) & (y[:, 0] == y[:, 1]) & (y[:, 2] == y[:, 3])
    steep = (x[:, 0] == x[:, 1]) & (x[:, 2] == x[:, 3]) & (y[:, 0] == y[:, 3]) & (y[:, 1] == y[:, 2])
    good = closed & (level | steep) & (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2]) & np.isfinite(p).all(axis=(1, 2))
    out[row[good]] = np.concatenate([p[good].min(axis=1), p[good].max(axis=1)], axis=1)
    return out


def _meet(a: np.ndarray, b: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of boxes: the places of those that overlap, and the closed ring of what they share, as ``overlay`` gives it and
    ``clip_polygons`` by expressions."""
    a, b = np.round(a / grid), np.round(b / grid)
    (w, s), (e, n) = np.maximum(a[:, :2], b[:, :2]).T, np.minimum(a[:, 2:], b[:, 2:]).T
    some = np.flatnonzero((w < e) & (s < n))
    w, s, e, n = w[some], s[some], e[some], n[some]
    return some, np.stack([np.stack([x, y], axis=1) for x, y in ((w, n), (w, s), (e, s), (e, n), (w, n))], axis=1) * grid


def _marked(shapes: DataFrame) -> DataFrame:
    """shapes (shape, rings), dealt to tasks, and whether each is one upright box."""

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.isfinite(_boxes(batch.column(1))[:, 0]))], names=["shape", "rings", "upright"])

    return shapes.repartition(tasks(shapes)).mapInArrow(mark, f"shape long, rings {RINGS}, upright boolean")


def _listed(ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """shape and the number of its lists, and shape, list and ids of the rows with that polygon: some ``LISTED`` in a list, however many a shape has."""
    lists = ids.groupBy("shape").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    of = ids.join(lists, "shape").groupBy("shape", F.pmod(F.xxhash64("id"), F.col("lists")).alias("list"))
    return lists, stored(of.agg(F.collect_list(F.struct("id")).alias(name)), "lists")


def clip_polygons(
    polygons: DataFrame, areas: DataFrame, cell: float | None = None, grid: float = 1e-3, id_: str = "id", area: str = "name", polygon: str = "geometry", digits: int | None = None
) -> DataFrame:
    """id, name, geometry (one or more polygons), area (rounded to ``digits``) of the part of each polygon within each area; empty parts give no row.

    Different polygons meet in the cells that both boxes touch, and are laid over each other in the first such cell only. Upright boxes are compared as
    such, in expressions. Rows with equal polygons share the part: their ids are kept in lists, which are written out last, so that no step but
    the reader of the result sees a row for each.
    """
    cell = cell or side_of(areas, polygon, grid, 1)
    shapes, ids = shapes_of(polygons, id_, polygon)
    holders, names = shapes_of(areas, area, polygon)
    (lists_a, ids), (lists_b, names) = _listed(ids, "ids"), _listed(names, "names")
    left = _boxed(_marked(shapes).join(lists_a, "shape"), "l", cell).withColumnsRenamed({"rings": "a", "shape": "shape_a", "upright": "upright_a", "lists": "lists_a"})
    right = _boxed(_marked(holders).join(lists_b, "shape"), "r", cell).withColumnsRenamed({"rings": "b", "shape": "shape_b", "upright": "upright_b", "lists": "lists_b"})

    def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.join(right, ["cx", "cy"]).where("lw < re AND rw < le AND ls < rn AND rs < ln")
        return met.where((F.floor(F.greatest("lw", "rw") / cell) == F.col("cx")) & (F.floor(F.greatest("ls", "rs") / cell) == F.col("cy")))

    on = lambda c: F.rint(F.col(c) / grid)
    boxes = meeting(left.where("upright_a").drop("a"), right.where("upright_b").drop("b"))
    for side, of, between in (("w", F.greatest, ("lw", "rw")), ("s", F.greatest, ("ls", "rs")), ("e", F.least, ("le", "re")), ("n", F.least, ("ln", "rn"))):
        boxes = boxes.withColumn(side, of(*map(on, between)))
    corner = lambda x, y: F.struct((F.col(x) * grid).alias("x"), (F.col(y) * grid).alias("y"))
    ring = F.array(*[corner(x, y) for x, y in ("wn", "ws", "es", "en", "wn")])
    kept = ["shape_a", "shape_b", "lists_a", "lists_b"]
    boxes = boxes.where("w < e AND s < n").select(*kept, F.array(F.array(ring)).alias("geometry"), ((F.col("e") * grid - F.col("w") * grid) * (F.col("n") * grid - F.col("s") * grid)).alias("area"))
    both = lambda inside: inside[:, 0] & inside[:, 1]

    def clip(batches):
        for batch in batches:
            parts = [overlay([a, b], both, grid) for a, b in zip(read_rings(batch.column(4)), read_rings(batch.column(5)), strict=True)]
            full = [i for i, p in enumerate(parts) if p]
            if full:
                shown, rest = [parts[i] for i in full], batch.take(pa.array(full))
                yield pa.RecordBatch.from_arrays([*rest.columns[:4], write_multi(shown), pa.array([_size(p) for p in shown], pa.float64())], names=[*kept, "geometry", "area"])

    # pairs that are not of two boxes
    met = meeting(left.where("NOT upright_a"), right).unionByName(meeting(left.where("upright_a"), right.where("NOT upright_b"))).select(*kept, "a", "b")
    others = met.repartition(tasks(met)).mapInArrow(clip, f"shape_a long, shape_b long, lists_a long, lists_b long, geometry {MULTI}, area double")
    out = boxes.unionByName(others).withColumn("area", F.col("area") if digits is None else F.round("area", digits))
    for of in ("a", "b"):
        out = out.withColumn(f"list_{of}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"lists_{of}") - 1)))
    out = out.repartition(tasks(out), "shape_a", "list_a").join(ids.withColumnsRenamed({"shape": "shape_a", "list": "list_a"}), ["shape_a", "list_a"])
    out = out.join(names.withColumnsRenamed({"shape": "shape_b", "list": "list_b"}), ["shape_b", "list_b"])
    out = out.select("ids", F.explode("names").alias("name"), "geometry", "area").select(F.explode("ids").alias("id"), "name", "geometry", "area")
    return out.select(F.col("id.id").alias(id_), F.col("name.id").alias(area), "geometry", "area")


def _united(boxes: np.ndarray, grid: float) -> list[list[np.ndarray]]:
    """The union of upright boxes, as ``overlay`` gives it: their sides cut the ground into fields, which are counted, not crossed."""
    w, s, e, n = np.round(boxes / grid).T
    some = (w < e) & (s < n)
    w, s, e, n = w[some], s[some], e[some], n[some]
    if not len(w):
        return []
    xs, ys = np.unique(np.concatenate([w, e])), np.unique(np.concatenate([s, n]))
    count = np.zeros((len(xs), len(ys)), np.int32)
    for x, y, sign in ((w, s, 1), (e, s, -1), (w, n, -1), (e, n, 1)):
        np.add.at(count, (np.searchsorted(xs, x), np.searchsorted(ys, y)), sign)
    held = np.cumsum(np.cumsum(count, axis=0), axis=1) > 0  # the field east of xs[i] and north of ys[j]
    start, end = [], []

    def sides(on: np.ndarray, along: int, ahead: bool) -> None:
        """Runs of sides, each one edge from corner to corner (i, j)."""
        on = np.pad(on.T if along == 0 else on, ((0, 0), (1, 1)))
        first, last = np.argwhere(on[:, 1:] & ~on[:, :-1]), np.argwhere(~on[:, 1:] & on[:, :-1])
        first, last = (first[:, ::-1], last[:, ::-1]) if along == 0 else (first, last)
        start.append(first if ahead else last)
        end.append(last if ahead else first)

    south, west = np.pad(held, ((0, 0), (1, 0)))[:, :-1], np.pad(held, ((1, 0), (0, 0)))[:-1]
    sides(held & ~south, 0, True)  # the area is on the left
    sides(south & ~held, 0, False)
    sides(held & ~west, 1, False)
    sides(west & ~held, 1, True)
    corners, ids = np.unique(np.concatenate(start + end) @ np.array([len(ys), 1]), return_inverse=True)
    shift = np.array([xs[0], ys[0]])
    points = np.stack([xs[corners // len(ys)], ys[corners % len(ys)]], axis=1) - shift
    return _joined(points, ids[: len(ids) // 2], ids[len(ids) // 2 :], shift, grid)


def _union(grid: float):
    """The union of the polygons of a group, as one even-odd set of rings."""

    def run(key, table):
        boxes = _boxes(table["rings"])
        if np.isfinite(boxes).all():
            polygons = _united(boxes, grid)
        else:
            polygons = overlay(read_rings(table["rings"]), lambda inside: inside.any(axis=1), grid)
        rows = [[ring for p in polygons for ring in p]] if polygons else []
        names = [n for n in table.column_names if n not in ("rings", "block")]
        return pa.table({**{n: table[n].slice(0, len(rows)) for n in names}, "rings": write_rings(rows)})

    return run


def union_cells(polygons: DataFrame, by: str, cell: float, grid: float = 1e-3, polygon: str = "geometry") -> DataFrame:
    """by, cx, cy, rings: the union of each group's polygons, cut at the cells of a grid (even-odd rings).

    Polygons are cut at the cells where they are read. A cell's pieces are united in blocks of bounded size, their unions again,
    until one is left, so neither a group nor a full cell meets in one task. Upright boxes are united many at once.
    """
    if round(cell / grid) * grid != cell and abs(round(cell / grid) * grid - cell) > grid * 1e-6:
        raise Refusal("a cell is a multiple of the grid")
    kind = dict(polygons.dtypes)[by]

    def cut(batches):
        fields = ["by", "cx", "cy", "rings", "box"]
        for batch in batches:
            boxes = _boxes(batch.column(1))
            at = np.flatnonzero(np.isfinite(boxes[:, 0]))
            if len(at):
                i, cells, corners = _cut_boxes(boxes[at], cell)
                off = lambda n, step: pa.array(np.arange(n + 1, dtype=np.int32) * step)
                points = pa.StructArray.from_arrays([pa.array(corners[:, :, 0].ravel()), pa.array(corners[:, :, 1].ravel())], names=["x", "y"])
                rings = pa.ListArray.from_arrays(off(len(i), 1), pa.ListArray.from_arrays(off(len(i), 4), points))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i])), pa.array(cells[:, 0]), pa.array(cells[:, 1]), rings, pa.array(np.ones(len(i), bool))], names=fields)
            batch = batch.take(pa.array(np.flatnonzero(~np.isfinite(boxes[:, 0]))))
            rows, keys, cells = [], [], []
            for i, rings in enumerate(read_rings(batch.column(1)) if len(batch) else []):
                for cx, strip in _cut(rings, 0, cell) if rings else ():
                    for cy, part in _cut(strip, 1, cell):
                        rows.append(part)
                        keys.append(i)
                        cells.append((cx, cy))
            if rows:
                at = np.array(cells, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(at[:, 0]), pa.array(at[:, 1]), write_rings(rows), pa.array(np.zeros(len(rows), bool))], names=fields)

    schema = f"by {kind}, cx long, cy long, rings {RINGS}"
    some = polygons.select(F.col(by).alias("by"), _typed(F.col(polygon)).alias("rings")).where("rings is not null").distinct()
    pieces = some.mapInArrow(cut, f"{schema}, box boolean").dropDuplicates()
    place = ["by", "cx", "cy"]
    blocks = lambda n, corners: F.greatest(F.ceil(n / BLOCK_POLYGONS), F.least(F.ceil(corners / BLOCK_CORNERS), F.ceil(n / 2)))
    while True:
        pieces = stored(pieces, "pieces")
        corners = F.aggregate("rings", F.lit(0), lambda s, ring: s + F.size(ring))
        load = pieces.groupBy(*[F.col(c).alias(f"_{c}") for c in place]).agg(F.count(F.lit(1)).alias("n"), F.sum(corners).alias("corners"), F.count_if("box").alias("n_box"), F.sum(F.when(F.col("box"), 0).otherwise(corners)).alias("other_corners"))
        load = load.withColumns({"boxed": F.ceil(F.col("n_box") / BLOCK_BOXES), "others": blocks(F.col("n") - F.col("n_box"), F.col("other_corners"))})
        load = stored(load.withColumn("one", (blocks(F.col("n"), F.col("corners")) <= 1) | (F.col("boxed") + F.col("others") <= 1)), "load")
        last = load.where("not one").isEmpty()
        same = F.lit(True)
        for c in place:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        block = F.when(F.col("one"), 0).when(F.col("box"), F.pmod(F.xxhash64("rings"), F.greatest("boxed", F.lit(1)))).otherwise(-1 - F.pmod(F.xxhash64("rings"), F.greatest("others", F.lit(1))))
        dealt = pieces.join(load, same).select(*place, "rings", block.alias("block"))
        pieces = dealt.repartition(tasks(dealt), *place, "block").groupBy(*place, "block").applyInArrow(_union(grid), schema)
        if last:
            return stored(pieces, "cells").withColumnRenamed("by", by)
        pieces = pieces.withColumn("box", F.lit(False))


def dissolve(cells: DataFrame, by: str, grid: float = 1e-3) -> DataFrame:
    """by, geometry, pieces, area: one outline a group, made of its cells, four neighbours at a time.

    Only outlines travel upwards; the last merge of a group holds no more than its outline, which is one value of the result.
    """
    low = cells.groupBy(F.col(by).alias("_by")).agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"))
    level = cells.join(low, F.col(by).eqNullSafe(F.col("_by"))).select(F.col(by).alias("by"), (F.col("cx") - F.col("x0")).alias("cx"), (F.col("cy") - F.col("y0")).alias("cy"), "rings")
    level = stored(level, "level")
    schema = f"by {dict(level.dtypes)['by']}, cx long, cy long, rings {RINGS}"
    while True:
        many = stored(level.groupBy(F.col("by").alias("_by")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many")
        if many.isEmpty():
            break
        parts = level.join(many, F.col("by").eqNullSafe(F.col("_by")), "left")
        up = lambda c: F.when(F.col("n") <= MERGED, F.lit(0).cast("long")).otherwise(F.shiftright(c, 1)).alias(c)
        merged = parts.where("n is not null").select("by", up("cx"), up("cy"), "rings")
        merged = merged.repartition(tasks(merged), "by", "cx", "cy").groupBy("by", "cx", "cy").applyInArrow(_union(grid), schema)
        level = stored(merged.unionByName(parts.where("n is null").select("by", "cx", "cy", "rings")), "level")

    def outline(batches):
        for batch in batches:
            shapes = [overlay([rings], lambda inside: inside[:, 0], grid) for rings in read_rings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), write_multi(shapes), pa.array([len(s) for s in shapes], pa.int64()), pa.array([_size(s) for s in shapes], pa.float64())], names=["by", "geometry", "pieces", "area"])

    kind = dict(level.dtypes)["by"]
    return level.select("by", "rings").mapInArrow(outline, f"by {kind}, geometry {MULTI}, pieces long, area double").withColumnRenamed("by", by)


def combined_area(polygons: DataFrame, by: str, cell: float | None = None, grid: float = 1e-3, polygon: str = "geometry", outline: bool = True) -> OpResult:
    """by, geometry, pieces, area: overlapping and touching areas of a group become one, separate ones stay separate.

    Report ``areas``: by, parts, parts_area, combined_area, overlap (what was covered more than once). Without ``outline`` the rows
    are those of ``union_cells``, for groups whose outline is too long for one row.
    """
    known = polygons.where(F.col(polygon).isNotNull())
    cell = cell or side_of(known, polygon, grid)
    cells = union_cells(known, by, cell, grid, polygon)
    parts = known.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.sum(plane_area(F.col(polygon))).alias("parts_area"))
    whole = cells.select(F.col(by).alias("_by"), _even_odd_area(F.col("rings")).alias("a")).groupBy("_by").agg(F.sum("a").alias("combined_area"))
    areas = parts.join(whole, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "parts", "parts_area", F.coalesce("combined_area", F.lit(0.0)).alias("combined_area"))
    areas = areas.withColumn("overlap", F.col("parts_area") - F.col("combined_area"))
    return OpResult(dissolve(cells, by, grid) if outline else cells, {"areas": areas})


def _even_odd_area(rings: Column) -> Column:
    """Area of rings of which outer ones run counter-clockwise and holes clockwise, as ``overlay`` makes them."""
    signed = lambda ring: F.aggregate(
        F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.when(q.isNotNull(), (p.x - ring[0].x) * (q.y - ring[0].y) - (q.x - ring[0].x) * (p.y - ring[0].y)).otherwise(0.0)),
        F.lit(0.0), lambda s, x: s + x,
    )
    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda s, x: s + x) / 2


def capsule(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column, segments: int = 8) -> Column:
    """The polygon within a radius of a stretch from one point to the other; ``segments`` corners a quarter turn."""
    along = F.atan2(y2 - y1, x2 - x1)

    def cap(x: Column, y: Column, begin: float) -> Column:
        angle = lambda i: along + begin + i * (np.pi / 2 / segments)
        return F.transform(F.sequence(F.lit(0), F.lit(2 * segments)), lambda i: F.struct((x + radius * F.cos(angle(i))).alias("x"), (y + radius * F.sin(angle(i))).alias("y")))

    return F.array(F.concat(cap(x2, y2, -np.pi / 2), cap(x1, y1, np.pi / 2)))


def _band(rings: list[np.ndarray], distance: float, segments: int) -> list[list[np.ndarray]]:
    """A polygon and the strips within the distance of its edges (see ``capsule``)."""
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    some = (a != b).any(axis=1)
    a, b = a[some], b[some]
    turn = np.arctan2(*(b - a).T[::-1])[:, None] + np.arange(2 * segments + 1) * (np.pi / 2 / segments) - np.pi / 2
    cap = lambda at, angle: at[:, None] + distance * np.stack([np.cos(angle), np.sin(angle)], axis=2)
    return [rings, *([strip] for strip in np.concatenate([cap(b, turn), cap(a, turn + np.pi)], axis=1))]


def buffer_area(areas: DataFrame, distance: float, segments: int = 8, cell: float | None = None, grid: float = 1e-3, id_: str = "id", polygon: str = "geometry") -> DataFrame:
    """id, geometry, pieces, area: the ground within ``distance`` metres of each area (metres; see ``to_metres``).

    Each edge becomes the strip within the distance of it; area and strips are united like any areas of one group, so a long
    boundary is dealt over cells; an area of few edges is one small block and is done where it lies. A distance of 0 gives the area
    itself; holes shrink and may close. Equal areas are done once.
    """
    if not 0 <= distance <= 50_000:
        raise Refusal("a band is 0 to 50,000 metres wide")
    shapes, ids = shapes_of(areas, id_, polygon)
    a = shapes.select(F.col("shape").alias("id"), F.col("rings").alias("geometry")).repartition(tasks(shapes))
    corners = F.coalesce(F.aggregate("geometry", F.lit(0), lambda n, ring: n + F.coalesce(F.size(ring), F.lit(0))), F.lit(0))
    few, a = a.where(corners < BLOCK_POLYGONS), a.where(corners >= BLOCK_POLYGONS)

    def whole(batches):
        for batch in batches:
            parts = read_rings(batch.column(1))
            done = [overlay(_band(rings, distance, segments) if distance else [rings], lambda inside: inside.any(axis=1), grid) if rings else [] for rings in parts]
            full = [i for i, out in enumerate(done) if out]
            some = [done[i] for i in full]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full, pa.int64())), write_multi(some), pa.array([len(p) for p in some], pa.int64()), pa.array([_size(p) for p in some], pa.float64())], names=["shape", "geometry", "pieces", "area"])

    out = few.mapInArrow(whole, f"shape long, geometry {MULTI}, pieces long, area double")
    if not a.isEmpty():
        strips = a
        if distance:
            edge = F.expr("flatten(transform(geometry, r -> zip_with(r, concat(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1)), (p, q) -> struct(p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2))))")
            edges = a.select("id", F.explode(edge).alias("e")).where("e.x1 <> e.x2 OR e.y1 <> e.y2")
            strips = a.unionByName(edges.select("id", capsule(F.col("e.x1"), F.col("e.y1"), F.col("e.x2"), F.col("e.y2"), F.lit(float(distance)), segments).alias("geometry")))
        cell = cell or side_of(a, "geometry", grid)
        out = out.unionByName(dissolve(union_cells(strips, "id", cell, grid), "id", grid).withColumnRenamed("id", "shape"))
    return out.join(ids, "shape").select(F.col("id").alias(id_), "geometry", "pieces", "area")
