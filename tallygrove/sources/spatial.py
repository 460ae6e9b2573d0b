"""Spatial files: GeoJSON, well-known binary, GeoPackage, road ways, places in Parquet."""

from __future__ import annotations

import os
import re
import sqlite3
import struct
import tempfile
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallygrove.functions.values import coordinate
from tallygrove.report import OpResult, Refusal

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
RINGS = ArrayType(ArrayType(POINT))


def points_from_table(df: DataFrame, id_: str, lon: str, lat: str) -> OpResult:
    """Points of a table's coordinate columns (decimal or degrees, minutes, seconds). Report: ``unlocated`` rows by reason."""
    x, y = coordinate(F.col(lon)), coordinate(F.col(lat))
    ok = (F.abs(x) <= 180) & (F.abs(y) <= 90)
    out = df.withColumns({"id": F.col(id_).cast("string"), "_x": F.when(ok, x), "_y": F.when(ok, y)})
    why = F.when(F.col(lon).isNull() | F.col(lat).isNull(), "missing").when(x.isNull() | y.isNull(), "unreadable").otherwise("out of range")
    out = out.drop(*[c for c in ("lon", "lat") if c in df.columns]).withColumnsRenamed({"_x": "lon", "_y": "lat"})
    return OpResult(out, {"unlocated": df.where(~F.coalesce(ok, F.lit(False))).groupBy(why.alias("reason")).count()})


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, type, coordinates (JSON text), properties (map): the features of GeoJSON files, one file a task."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<features: array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>>"
    f = raw.select(F.explode(F.from_json("value", kind).features).alias("f"))
    return f.select(F.coalesce(F.col("f.id"), F.col("f.properties")["id"]).alias("id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_points(features: DataFrame) -> DataFrame:
    at = F.from_json("coordinates", "array<double>")
    return features.where("type = 'Point' or type is null").select("id", at[0].alias("lon"), at[1].alias("lat"), "properties")


def _rings(c: Column) -> Column:
    return F.transform(c, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def geojson_polygons(features: DataFrame) -> DataFrame:
    """id, part, geometry (rings), properties: a row for each polygon, or part of a multipolygon; rings that aren't closed are dropped with their part."""
    one = features.where("type = 'Polygon'").select("id", F.lit(0).alias("part"), _rings(F.from_json("coordinates", "array<array<array<double>>>")).alias("geometry"), "properties")
    many = features.where("type = 'MultiPolygon'").select("id", F.posexplode(F.from_json("coordinates", "array<array<array<array<double>>>>")).alias("part", "g"), "properties").select("id", "part", _rings(F.col("g")).alias("geometry"), "properties")
    closed = F.forall("geometry", lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)))
    return one.unionByName(many).where(closed)


def _wkb_point(b: bytes | None) -> tuple[float, float] | None:
    if not b or len(b) < 21:
        return None
    end = "<" if b[0] == 1 else ">"
    if struct.unpack_from(end + "I", b, 1)[0] % 1000 != 1:
        return None
    x, y = struct.unpack_from(end + "dd", b, 5)
    return None if x != x else (x, y)


@F.pandas_udf(POINT)
def wkb_point(column: pd.Series) -> pd.DataFrame:
    """Longitude and latitude of a point in well-known binary; null for an empty point or another kind."""
    return pd.DataFrame([_wkb_point(b) or (None, None) for b in column], columns=["x", "y"])


@F.pandas_udf(RINGS)
def wkb_rings(column: pd.Series) -> pd.Series:
    """The rings of a polygon in well-known binary; null for another kind."""

    def one(b: bytes | None):
        if not b:
            return None
        end = "<" if b[0] == 1 else ">"
        if struct.unpack_from(end + "I", b, 1)[0] != 3:
            return None
        at, out = 9, []
        for _ in range(struct.unpack_from(end + "I", b, 5)[0]):
            n = struct.unpack_from(end + "I", b, at)[0]
            v = struct.unpack_from(f"{end}{2 * n}d", b, at + 4)
            out.append([{"x": v[2 * i], "y": v[2 * i + 1]} for i in range(n)])
            at += 4 + 16 * n
        return out

    return column.map(one)


def read_geopackage(spark: SparkSession, path: str, layer: str, id_column: str = "fid", geometry: str = "geom") -> DataFrame:
    """id, lon, lat, attributes (map) of a point layer in WGS84; the task that reads a file holds it in its own scratch folder."""
    if not all(re.fullmatch(r"\w+", n) for n in (layer, id_column, geometry)):
        raise Refusal("layer and column names are letters, digits and underscores")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                fd, name = tempfile.mkstemp()
                with os.fdopen(fd, "wb") as f:
                    f.write(content)
                try:
                    con = sqlite3.connect(name)
                    cur = con.execute(f'SELECT * FROM "{layer}"')  # noqa: S608
                    names = [c[0] for c in cur.description]
                    while some := cur.fetchmany(10_000):
                        out = []
                        for row in some:
                            r = dict(zip(names, row, strict=True))
                            blob = r.pop(geometry)
                            skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
                            x, y = (_wkb_point(blob[skip:]) if blob else None) or (None, None)
                            out.append((str(r.pop(id_column)), x, y, {k: None if v is None else str(v) for k, v in r.items()}))
                        yield pd.DataFrame(out, columns=["id", "lon", "lat", "attributes"])
                    con.close()
                finally:
                    os.unlink(name)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "id string, lon double, lat double, attributes map<string, string>")


def places_in_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, kinds: Mapping[str, str], confidence: float) -> OpResult:
    """Places (id, name, category, confidence, lon, lat) inside a box, of mapped categories and sure enough. The box reaches the
    Parquet reader, which skips row groups by their statistics. Report: rows left out, by reason."""
    p = spark.read.parquet(path).where((F.col("lon") >= west) & (F.col("lon") <= east) & (F.col("lat") >= south) & (F.col("lat") <= north))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("category")]
    why = F.when(kind.isNull(), "category").when(~F.coalesce(F.col("confidence") >= confidence, F.lit(False)), "confidence")
    marked = p.withColumns({"kind": kind, "_why": why})
    return OpResult(marked.where("_why is null").drop("_why"), {"left_out": marked.where("_why is not null").groupBy("_why").count()})


def osm_ways(spark: SparkSession, path: str, classes: tuple[str, ...]) -> DataFrame:
    """way_id, nodes, oneway of the ways of an Overpass JSON answer whose class is listed."""
    kind = "struct<elements: array<struct<type: string, id: long, nodes: array<long>, tags: map<string, string>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind).elements).alias("e")).where("e.type = 'way'")
    tag = F.col("e.tags")
    circle = tag["junction"].isin("roundabout", "circular")
    return e.where(tag["highway"].isin(*classes) & ~F.coalesce(tag["access"].isin("no", "private"), F.lit(False))).select(F.col("e.id").alias("way_id"), F.col("e.nodes").alias("nodes"), F.when(circle, "yes").otherwise(F.when(tag["oneway"].isin("yes", "-1"), tag["oneway"]).otherwise("no")).alias("oneway"))
