"""Points and polygons: nearest neighbours, centres, masks, grids, areas, containment, hulls. Degrees are WGS84.

A polygon is an array of rings, a ring an array of structs (x, y), the first ring outside and the others holes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.values import EARTH_AREA_M, EARTH_KM, from_utm, haversine_km, to_utm, utm_zone
from tallygrove.operators.overlay import tasks
from tallygrove.report import OpResult, Refusal, refuse_when, stored


def nearest(points: DataFrame, candidates: DataFrame, id_: str = "id", lat: str = "lat", lon: str = "lon", first_km: float = 50.0) -> DataFrame:
    """id, nearest_id, distance_km, reason: the nearest candidate of each point (ties: the smaller id); without location null.

    Places are unit vectors in cubes. A place is compared with the candidates of its own and the 26 cubes around; it is settled
    if the nearest lies within one edge, and the rest try again with edges four times as long. Points at one place are looked up once, and
    of candidates at one place only the smallest id is compared. Where candidates are dense, the first edge is shorter than ``first_km``.
    No side is sent whole.
    """
    given = points.select(F.col(id_).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    missing = given.where("lat is null or lon is null").select("id", F.lit("location missing").alias("reason"))
    located = given.where("lat is not null and lon is not null")
    vector = (("x", lambda p, q: F.cos(p) * F.cos(q)), ("y", lambda p, q: F.cos(p) * F.sin(q)), ("z", lambda p, q: F.sin(p)))
    with_vector = lambda df: df.withColumns({n: f(F.radians("lat"), F.radians("lon")) for n, f in vector})
    open_ = stored(with_vector(located.select("lat", "lon").distinct()), "places")
    known = candidates.select(F.col(id_).alias("c_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("lat is not null and lon is not null")
    known = stored(with_vector(known.groupBy("lat", "lon").agg(F.min("c_id").alias("c_id"))).withColumnsRenamed({"lat": "c_lat", "lon": "c_lon"}), "candidates")
    edge, out = _first_edge(known, first_km / EARTH_KM), None
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while True:
        last = edge >= 2
        cell = lambda n: F.floor(F.col(n) / edge).cast("long")  # noqa: B023, E731
        right = known.select("c_id", "c_lat", "c_lon", *[cell(n).alias(f"c{n}") for n in "xyz"])
        left = open_.withColumn("_s", F.explode(shifts)).select("lat", "lon", *[(cell(n) + F.col(f"_s.{s}")).alias(f"c{n}") for n, s in zip("xyz", "ijk", strict=True)])
        near = left.join(right, ["cx", "cy", "cz"]).select("lat", "lon", "c_id", haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")).alias("km"))
        best = near.groupBy("lat", "lon").agg(F.min(F.struct("km", "c_id")).alias("b")).select("lat", "lon", F.col("b.c_id").alias("nearest_id"), F.col("b.km").alias("distance_km"))
        chord = 2 * F.sin(F.col("distance_km") / (2 * EARTH_KM))
        settled = stored(best if last else best.where(chord <= edge), "nearest")
        out = settled if out is None else out.unionByName(settled)
        if last:
            break
        open_ = stored(open_.join(settled.select("lat", "lon"), ["lat", "lon"], "left_anti"), "open")
        if not open_.limit(1).count():
            break
        edge *= 4
    done = located.join(out, ["lat", "lon"], "left").groupBy("id").agg(F.min(F.struct("distance_km", "nearest_id")).alias("b")).select("id", "b.nearest_id", "b.distance_km")
    return done.withColumn("reason", F.when(F.col("nearest_id").isNull(), "no candidate")).unionByName(missing, allowMissingColumns=True)


CROWD = 64  # candidates in the cube of the average candidate beyond which a shorter edge is tried first


def _first_edge(known: DataFrame, edge: float) -> float:
    """The edge, or the longest of its quarters, sixteenths and so on at which cubes aren't crowded."""
    edges = [edge / 4**i for i in range(8)]
    cubes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.floor(F.col(n) / e).cast("long").alias(n) for n in "xyz"]) for i, e in enumerate(edges)])).alias("c")
    load = known.select(cubes).groupBy("c").agg(F.count(F.lit(1)).alias("n")).groupBy("c.i").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"))
    fit = load.where(F.col("crowd") <= CROWD).agg(F.min("i")).first()[0]
    return edges[-1 if fit is None and known.limit(1).count() else fit or 0]


def project(points: DataFrame, lon: str = "lon", lat: str = "lat", zone: Column | None = None) -> DataFrame:
    """points and utm_zone, east, north."""
    z = utm_zone(F.col(lon)) if zone is None else zone
    east, north = to_utm(F.col(lon), F.col(lat), F.col("utm_zone"))
    return points.withColumn("utm_zone", z).withColumns({"east": east, "north": north})


def mean_center(points: DataFrame, weight: Column | None = None, lon: str = "lon", lat: str = "lat", by: Sequence[str] = ()) -> DataFrame:
    """by, lon, lat, n: the weighted mean place of each group, in the UTM zone of its plain mean longitude. Places without coordinates
    and those of no positive weight are left out."""
    located = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_w", (F.lit(1.0) if weight is None else weight).cast("double")).where("_w > 0")
    keys = [f"_k{i}" for i in range(len(by))]
    zone = located.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(utm_zone(F.avg(lon)).alias("z"))
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    p = located.join(zone, same) if by else located.crossJoin(F.broadcast(zone))  # one row is sent
    east, north = to_utm(F.col(lon), F.col(lat), F.col("z"))
    m = p.withColumns({"_e": east, "_n": north}).groupBy(*by).agg(F.first("z").alias("z"), F.expr("sum(_e*_w)/sum(_w)").alias("e"), F.expr("sum(_n*_w)/sum(_w)").alias("n_"), F.count(F.lit(1)).alias("n"), F.avg(lat).alias("mean_lat"))
    x, y = from_utm(F.col("e"), F.col("n_"), F.col("z"), F.col("mean_lat") < 0)
    return m.select(*by, x.alias("lon"), y.alias("lat"), "n")


def compare_points(original: DataFrame, moved: DataFrame, id_: str = "id") -> DataFrame:
    """n, mean_m, max_m: how far points of the same id moved."""
    m = moved.select(F.col(id_).alias("_i"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    d = original.join(m, F.col(id_) == F.col("_i")).select((haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) * 1000).alias("m"))
    return d.agg(F.count("m").alias("n"), F.avg("m").alias("mean_m"), F.max("m").alias("max_m"))


def _unit_draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def donut_mask(points: DataFrame, least_m: float, most_m: float, seed: int, id_: str = "id") -> DataFrame:
    """Points moved in a random direction by a distance between the two (uniform in the distance); the same seed moves alike."""
    if not 0 < least_m < most_m <= 5000:
        raise Refusal("the ring needs 0 < least < most <= 5000 metres")
    r = (least_m + _unit_draw(F.col(id_), F.lit(seed)) * (most_m - least_m)) / (EARTH_KM * 1000)
    b = _unit_draw(F.col(id_), F.lit(seed + 1)) * 2 * np.pi
    p = F.radians("lat")
    lat = F.asin(F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(b))
    lon = F.col("lon") + F.degrees(F.atan2(F.sin(b) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * F.sin(lat)))
    return points.withColumns({"lat": F.degrees(lat), "lon": F.pmod(lon + 180, F.lit(360.0)) - 180})


def hexagons(points: DataFrame, edge_m: float, least: int = 2, lon: str = "lon", lat: str = "lat") -> OpResult:
    """utm_zone, q, r, n: points in hexagons (axial coordinates on UTM metres; not the ids of any public grid). Cells with fewer
    than ``least`` are withheld; the report counts them."""
    if least < 2:
        raise Refusal("a cell of one person discloses it: the least occupancy is 2")
    p = project(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()), lon, lat)
    q, r = F.expr(f"(sqrt(3)/3 * east - north/3) / {edge_m}D"), F.expr(f"(2D/3 * north) / {edge_m}D")
    rounded = [F.round(x) for x in (q, r, -q - r)]
    off = [F.abs(a - b) for a, b in zip(rounded, (q, r, -q - r), strict=True)]
    qq = F.when((off[0] > off[1]) & (off[0] > off[2]), -rounded[1] - rounded[2]).otherwise(rounded[0])
    rr = F.when((off[0] > off[1]) & (off[0] > off[2]), rounded[1]).when(off[1] > off[2], -rounded[0] - rounded[2]).otherwise(rounded[1])
    cells = p.select("utm_zone", qq.cast("long").alias("q"), rr.cast("long").alias("r")).groupBy("utm_zone", "q", "r").agg(F.count(F.lit(1)).alias("n"))
    return OpResult(cells.where(F.col("n") >= least), {"withheld": cells.where(F.col("n") < least).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"))})


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))


def within(polygon: Column, x: Column, y: Column) -> Column:
    """Inside, Boundary or Outside, by the even-odd rule over all rings."""
    return _relation(F.flatten(F.transform(polygon, _edges)), x, y)


def _relation(edges: Column, x: Column, y: Column) -> Column:
    on = F.exists(edges, lambda e: (F.abs((e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)) <= 1e-12) & (x >= F.least(e.x1, e.x2)) & (x <= F.greatest(e.x1, e.x2)) & (y >= F.least(e.y1, e.y2)) & (y <= F.greatest(e.y1, e.y2)))
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * F.try_divide(y - e.y1, e.y2 - e.y1) + e.x1), 1).otherwise(0))
    return F.when(on, "Boundary").when(crossings % 2 == 1, "Inside").otherwise("Outside")


def _met(points: DataFrame, polygons: DataFrame, cell: float, name: str, polygon: str) -> DataFrame:
    """points (lon, lat and more) with the name and relation of each polygon that holds them."""
    xs, ys = F.flatten(F.transform(polygon, lambda r: F.transform(r, lambda p: p.x))), F.flatten(F.transform(polygon, lambda r: F.transform(r, lambda p: p.y)))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    box = {"_w": F.array_min(xs), "_e": F.array_max(xs), "_s": F.array_min(ys), "_n": F.array_max(ys)}
    areas = polygons.select(F.col(name).alias("name"), F.flatten(F.transform(polygon, _edges)).alias("_edges"), *[v.alias(k) for k, v in box.items()])
    areas = areas.repartition(tasks(areas)).withColumn("_cx", span("_w", "_e")).withColumn("_cy", span("_s", "_n"))
    p = points.where("lon is not null and lat is not null").withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    met = p.join(areas, ["_cx", "_cy"]).where("lon between _w and _e and lat between _s and _n").withColumn("relation", _relation(F.col("_edges"), F.col("lon"), F.col("lat")))
    return met.where("relation <> 'Outside'").select(*points.columns, "name", "relation")


def locate(points: DataFrame, polygons: DataFrame, cell: float = 1.0, id_: str = "id", name: str = "name", polygon: str = "geometry") -> DataFrame:
    """id, name, relation for each point and each polygon that holds it (Inside or Boundary). Both sides meet in grid cells of the
    polygon's box, so a point is only tested against polygons nearby."""
    return _met(points.select(F.col(id_).alias("id"), "lon", "lat"), polygons, cell, name, polygon).select("id", "name", "relation")


def clip_points(points: DataFrame, polygons: DataFrame, boundary: bool = True, cell: float = 1.0, id_: str = "id", name: str = "name", polygon: str = "geometry") -> DataFrame:
    """points that a polygon holds. Points at one place are tested once."""
    spots = stored(points.select("lon", "lat").distinct(), "places")
    held = _met(spots, polygons, cell, name, polygon).where(F.lit(boundary) | (F.col("relation") == "Inside")).select("lon", "lat").distinct()
    return points.join(held, ["lon", "lat"], "left_semi").select(*points.columns)


def summarize_points(points: DataFrame, polygons: DataFrame, value: Column | None = None, boundary: bool = True, cell: float = 1.0, id_: str = "id", name: str = "name", polygon: str = "geometry") -> DataFrame:
    """name, n, total: points in each polygon and the sum of a value (unknown if one is); polygons without a point have 0. Points at one
    place are counted and added up before they are tested, so a point is no row for each polygon that holds it."""
    v = points.where("lon is not null and lat is not null").select("lon", "lat", (F.lit(1.0) if value is None else value).alias("_v"))
    spots = stored(v.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("_v").isNull()).alias("_unknown"), F.sum("_v").alias("_v")), "places")
    held = _met(spots, polygons, cell, name, polygon).where(F.lit(boundary) | (F.col("relation") == "Inside"))
    sums = held.groupBy("name").agg(F.sum("_k").alias("n"), F.when(F.sum("_unknown") == 0, F.sum("_v")).alias("total"), F.lit(1).alias("_some"))
    return polygons.select(F.col(name).alias("name")).join(sums, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("_some").isNull(), 0.0).otherwise(F.col("total")).alias("total"))


def area_m2(polygon: Column) -> Column:
    """Area on the sphere: the outer ring less the holes."""
    ring = lambda r: F.abs(F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + F.radians(e.x2 - e.x1) * (2 + F.sin(F.radians(e.y1)) + F.sin(F.radians(e.y2))))) * (EARTH_AREA_M**2 / 2)
    return ring(polygon[0]) - F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring(r))


def fill_gaps(polygon: Column) -> Column:
    return F.slice(polygon, 1, 1)


def circle(lon: Column, lat: Column, radius_m: float, corners: int = 64) -> Column:
    """A polygon of so many corners at a distance from a point."""
    d, p = radius_m / (EARTH_KM * 1000), F.radians(lat)

    def corner(i: Column) -> Column:
        b = i * (2 * np.pi / corners)
        y = F.asin(F.sin(p) * np.cos(d) + F.cos(p) * np.sin(d) * F.cos(b))
        return F.struct((lon + F.degrees(F.atan2(F.sin(b) * np.sin(d) * F.cos(p), np.cos(d) - F.sin(p) * F.sin(y)))).alias("x"), F.degrees(y).alias("y"))

    return F.array(F.transform(F.sequence(F.lit(0), F.lit(corners)), corner))


def point_grid(polygons: DataFrame, step: float, polygon: str = "geometry", name: str = "name") -> DataFrame:
    """name, lon, lat: points of a regular grid (multiples of ``step`` degrees) in each polygon."""
    xs, ys = F.flatten(F.transform(polygon, lambda r: F.transform(r, lambda p: p.x))), F.flatten(F.transform(polygon, lambda r: F.transform(r, lambda p: p.y)))
    span = lambda v: F.sequence(F.ceil(F.array_min(v) / step), F.floor(F.array_max(v) / step))
    g = polygons.select(F.col(name).alias("name"), F.flatten(F.transform(polygon, _edges)).alias("_edges"), span(ys).alias("_ys"), span(xs).alias("_xs"))
    # a small file of many polygons is one task, so they are dealt before points are made of them
    g = g.repartition(tasks(g)).withColumn("_i", F.explode("_xs")).withColumn("_j", F.explode("_ys"))
    g = g.select("name", "_edges", (F.col("_i") * step).alias("lon"), (F.col("_j") * step).alias("lat"))
    return g.where(_relation(F.col("_edges"), F.col("lon"), F.col("lat")) != "Outside").select("name", "lon", "lat")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def convex_hull(points: DataFrame, by: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """by, corner (from 0), lon, lat. Every batch leaves only its own corners; those are few and meet in one hull a group."""
    kind = dict(points.dtypes)[by]
    schema = f"g {kind}, lon double, lat double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, some in pdf.groupby("g", dropna=False, sort=False):
                h = _hull(some[["lon", "lat"]].to_numpy())
                yield pd.DataFrame({"g": [g] * len(h), "lon": h[:, 0], "lat": h[:, 1]})

    def final(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["lon", "lat"]].to_numpy())
        return pd.DataFrame({"g": [key[0]] * len(h), "corner": range(len(h)), "lon": h[:, 0], "lat": h[:, 1]})

    located = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(by).alias("g"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    corners = located.mapInPandas(partial, schema)
    return corners.groupBy("g").applyInPandas(final, f"g {kind}, corner long, lon double, lat double").withColumnRenamed("g", by)


def snap(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node, distance_km: the network node nearest to each point (nodes: id, lon, lat)."""
    return nearest(points, nodes).select("id", F.col("nearest_id").alias("node"), "distance_km", "reason")


MOST_SITES = 100  # of one group of Voronoi cells, the declared limit of the operator
#: Metres a degree of latitude, and of longitude on the equator.
LAT_M, LON_M = 110_570.0, 111_320.0


def _nearer(ring: np.ndarray, site: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The part of a convex ring (without closing point) that is no farther from site than from other."""
    side = (ring - (site + other) / 2) @ (other - site)
    out = []
    for i, (p, d) in enumerate(zip(ring, side, strict=True)):
        j = (i + 1) % len(ring)
        if d <= 0:
            out.append(p)
        if d * side[j] < 0:
            out.append(p + (ring[j] - p) * d / (d - side[j]))
    return np.array(out).reshape(-1, 2)


def voronoi(sites: DataFrame, bounds: DataFrame, group: str, id_: str = "id", x: str = "east", y: str = "north", around: float = 100.0) -> DataFrame:
    """group, id, geometry: the cell of each site of a group, in metres, within the group's bounds and ``around`` metres more.

    ``bounds`` has the group, left, bottom, right and top. Sites without place are left out; more than ``MOST_SITES`` sites of one
    group, or two within a millimetre, end the job. The sites of a group meet in one task, which that limit bounds.
    """

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_SITES:
            raise ValueError(f"{len(pdf)} sites in one group; {MOST_SITES} at most")
        xy = pdf[["x", "y"]].to_numpy()
        left, bottom, right, top = pdf[["left", "bottom", "right", "top"]].iloc[0] + [-around, -around, around, around]
        ids, rings = [], []
        for i, site in enumerate(xy):
            far = np.hypot(*(xy - site).T)
            if (np.delete(far, i) < 0.001).any():
                raise ValueError("two sites at one place: merge them first")
            ring = np.array([[left, bottom], [right, bottom], [right, top], [left, top]])
            for j in np.argsort(far, kind="stable"):
                if j != i and len(ring):
                    ring = _nearer(ring, site, xy[j])
            if len(ring) >= 3:
                ids.append(i)
                rings.append([[{"x": float(a), "y": float(b)} for a, b in [*ring, ring[0]]]])
        return pd.DataFrame({"grp": pdf["grp"].iloc[ids].to_numpy(), "id": pdf["id"].iloc[ids].to_numpy(), "geometry": rings})

    placed = sites.select(F.col(group).alias("grp"), F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    both = placed.join(bounds.select(F.col(group).alias("grp"), *[F.col(c).cast("double").alias(c) for c in ("left", "bottom", "right", "top")]), "grp")
    kinds = dict(both.dtypes)
    out = both.groupBy("grp").applyInPandas(cells, f"grp {kinds['grp']}, id {kinds['id']}, geometry array<array<struct<x: double, y: double>>>")
    return out.withColumnRenamed("grp", group)


def assign_sites(points: DataFrame, sites: DataFrame, extract: DataFrame, id_: str = "id", lat: str = "lat", lon: str = "lon", site: str = "site_id", first_km: float = 50.0) -> DataFrame:
    """id, site_id, distance_m, reason: the nearest site, of those that the extract has values for, to each point."""
    usable = sites.join(extract.select(F.col(site)).distinct(), site, "left_semi").select(F.col(site).alias(id_), F.col(lat), F.col(lon))
    near = nearest(points.select(id_, lat, lon), usable, id_, lat, lon, first_km)
    return near.select("id", F.col("nearest_id").alias("site_id"), F.floor(F.col("distance_km") * 1000 + 0.5).alias("distance_m"), "reason")


def compare_elevation(assigned: DataFrame, points: DataFrame, extract: DataFrame, elevation: Column, value: str, datum: str, reference: str, id_: str = "id", site: str = "site_id", scale: float = 1.0) -> DataFrame:
    """id, site_id, distance_m, level, elevation, status: Review where the site's level (``value`` times ``scale``) reaches the elevation,
    NoFlag below it, Unknown where either is unknown. The extract is to hold one row a site: its full key is chosen before; two end the job.

    Elevations must be declared as measured from the surface that the levels are changes of (``baseline-sea-surface``).
    """
    if not datum.strip():
        raise Refusal("the vertical datum of the elevations is to be stated")
    if reference != "baseline-sea-surface":
        raise Refusal("a change from a baseline sea surface can't be compared with a height above another surface")
    one = extract.groupBy(F.col(site).alias("site_id")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(value).cast("double") * scale).alias("level"))
    one = one.select("site_id", refuse_when(F.col("_n") > 1, "several values for one site: choose the full key", F.col("level")).alias("level"))
    height = points.select(F.col(id_).alias("id"), elevation.cast("double").alias("elevation"))
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    status = F.when(~known("level") | ~known("elevation"), "Unknown").when(F.col("level") >= F.col("elevation"), "Review").otherwise("NoFlag")
    return assigned.join(one, "site_id", "left").join(height, "id", "left").select("id", "site_id", "distance_m", "level", "elevation", status.alias("status"))


def fit_placement(points: DataFrame, model: str = "affine", base: tuple[float, float, float, float] | None = None) -> OpResult:
    """Places a picture by control points (id, x, y, lon, lat): lon = a x + b y + c, lat = d x + e y + f by least squares.

    ``north-up`` (b = d = 0, two points), ``affine`` (three) or ``shift`` (one; a, b, d, e are given by ``base``). Rows: id, east_m,
    north_m and metres of each residual; report ``fit``: the coefficients, points, and the root mean square and largest residual.
    Points with an unknown number are left out. One aggregation; the driver solves at most three unknowns.
    """
    least = {"north-up": 2, "affine": 3, "shift": 1}
    if model not in least or (model == "shift") != (base is not None):
        raise Refusal("the model is north-up, affine, or a shift of a given placement")
    p = points.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "lon", "lat")]).dropna()
    mean = p.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "lon", "lat")]).first()
    if mean["n"] < least[model]:
        raise Refusal(f"{mean['n']} points; {least[model]} at least")
    c = {k: F.col(k) - F.lit(mean[k]) for k in ("x", "y", "lon", "lat")}
    s = p.agg(*[F.sum(c[i] * c[j]).alias(f"{i}_{j}") for i, j in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "lon"), ("y", "lon"), ("x", "lat"), ("y", "lat"))]).first()
    if model == "shift":
        a, b, d, e = base
    elif model == "north-up":
        if min(s["x_x"], s["y_y"]) <= 0:
            raise Refusal("the points lie on one line, or two are one")
        a, b, d, e = s["x_lon"] / s["x_x"], 0.0, 0.0, s["y_lat"] / s["y_y"]
    else:
        m = np.array([[s["x_x"], s["x_y"]], [s["x_y"], s["y_y"]]])
        if np.linalg.matrix_rank(m) < 2:
            raise Refusal("the points lie on one line, or two are one")
        (a, b), (d, e) = np.linalg.solve(m, [s["x_lon"], s["y_lon"]]).tolist(), np.linalg.solve(m, [s["x_lat"], s["y_lat"]]).tolist()
    cc, f = mean["lon"] - a * mean["x"] - b * mean["y"], mean["lat"] - d * mean["x"] - e * mean["y"]
    east = (F.col("x") * a + F.col("y") * b + cc - F.col("lon")) * LON_M * F.cos(F.radians("lat"))
    north = (F.col("x") * d + F.col("y") * e + f - F.col("lat")) * LAT_M
    rows = p.select("id", east.alias("east_m"), north.alias("north_m")).withColumn("metres", F.hypot("east_m", "north_m"))
    fit = rows.agg(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", (a, b, cc, d, e, f), strict=True)], F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("metres") * F.col("metres"))).alias("rms_m"), F.max("metres").alias("max_m"))
    return OpResult(rows, {"fit": fit})
