"""Files, workflows and streams."""

import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import graph
from tallygrove.plans.workflow import Workflow
from tallygrove.report import Refusal
from tallygrove.sources import spatial
from tallygrove.sources import tables as files
from tallygrove.streaming import surveillance


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,"v, w"\n x ,1\n"q""r\ns",2x\n')
    df = files.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["k", "v, w"] and df.count() == 2
    long = files.long_table(df, ["k"], "v, w", ["k"])
    assert {r["k"]: r["v, w"] for r in long.df.collect()} == {"x": 1.0, 'q"r\ns': None}
    assert [r["text"] for r in long.report["unread"].collect()] == ["2x"] and long.report["repeated"].count() == 0
    (tmp_path / "b.csv").write_text("k,k\n1,2\n")
    with pytest.raises(Refusal):
        files.read_csv(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "c.csv").write_text("k,v\n1,2,3\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        files.read_csv(spark, f"file://{tmp_path}/c.csv").collect()


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>key</t></si><si><t>va</t><t>lue</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c></row></sheetData></worksheet>')
    rows = files.read_xlsx(spark, f"file://{tmp_path}/a.xlsx").orderBy("row").collect()
    assert [(r["sheet"], r["cells"]) for r in rows] == [("One", ["key", None, "value"]), ("One", ["1.5"])]


def test_stata(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"id": [1, 2], "sex": pd.Categorical(["f", "m"]), "x": [0.5, None]}).to_stata(tmp_path / "a.dta", write_index=False)
    rows = files.read_stata(spark, f"file://{tmp_path}/a.dta", "id long, sex string, x double").collect()
    assert [(r["id"], r["sex"]) for r in rows] == [(1, "f"), (2, "m")]


def test_geojson_and_wkb(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    features = [
        {"id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 3}}, {"id": "q", "geometry": None, "properties": {}},
        {"id": "r", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {}}, {"id": "m", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:3]]]}, "properties": {}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    f = spatial.geojson(spark, f"file://{tmp_path}/a.json")
    assert {r["id"]: (r["lon"], r["lat"]) for r in spatial.geojson_points(f).collect()} == {"p": (1.0, 2.0), "q": (None, None)}
    assert sorted((r["id"], len(r["geometry"][0])) for r in spatial.geojson_polygons(f).collect()) == [("m", 4), ("r", 4)]
    b = spark.createDataFrame([(bytearray(struct.pack("<BIdd", 1, 1, 5, 6)),), (bytearray(struct.pack(">BIIIdddddddd", 0, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)),), (None,)], "b binary")
    got = b.select(spatial.wkb_point("b").alias("p"), spatial.wkb_rings("b").alias("r")).collect()
    assert got[0]["p"]["x"] == 5 and got[1]["p"]["x"] is None and len(got[1]["r"][0]) == 4 and got[2]["r"] is None


def test_geopackage(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("CREATE TABLE sites (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
    con.execute("INSERT INTO sites VALUES (1, ?, 'one'), (2, NULL, NULL)", (b"GP\x00\x01" + struct.pack("<I", 4326) + struct.pack("<BIdd", 1, 1, 7, 8),))
    con.commit()
    con.close()
    rows = spatial.read_geopackage(spark, f"file://{tmp_path}/a.gpkg", "sites").orderBy("id").collect()
    assert (rows[0]["lon"], rows[0]["attributes"]) == (7.0, {"name": "one"}) and rows[1]["lon"] is None


def test_roads_and_places(spark, tmp_path):
    ways = [{"type": "way", "id": 1, "nodes": [1, 2, 3], "tags": {"highway": "primary"}}, {"type": "way", "id": 2, "nodes": [3, 4], "tags": {"highway": "primary", "oneway": "yes"}}, {"type": "way", "id": 3, "nodes": [4, 5], "tags": {"highway": "steps"}}]
    (tmp_path / "w.json").write_text(json.dumps({"elements": ways}))
    e = graph.directed_edges(spatial.osm_ways(spark, f"file://{tmp_path}/w.json", ("primary",)))
    assert {(r["from"], r["to"]) for r in e.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 4)}
    spark.createDataFrame([("a", "N", "hospital", 0.9, 1.0, 1.0), ("b", "N", "hospital", 0.1, 1.0, 1.0), ("c", "N", "bar", 0.9, 1.0, 1.0), ("d", "N", "hospital", 0.9, 9.0, 1.0)], "id string, name string, category string, confidence double, lon double, lat double").write.parquet(f"file://{tmp_path}/places")
    p = spatial.places_in_box(spark, f"file://{tmp_path}/places", 0, 0, 2, 2, {"hospital": "hospital"}, 0.5)
    assert [r["id"] for r in p.df.collect()] == ["a"] and {r[0]: r[1] for r in p.report["left_out"].collect()} == {"category": 1, "confidence": 1}
    t = spark.createDataFrame([(1, "10 30 0 E", "50.5"), (2, "x", "1"), (3, None, "1"), (4, "200", "1")], "i int, x string, y string")
    located = spatial.points_from_table(t, "i", "x", "y")
    assert located.df.orderBy("i").first()["lon"] == 10.5 and {r[0]: r[1] for r in located.report["unlocated"].collect()} == {"unreadable": 1, "missing": 1, "out of range": 1}


def flow(nodes, edges):
    return Workflow.from_json(json.dumps({"nodes": [{"id": i, "type": t, "params": p} for i, t, p in nodes], "edges": [{"from": a, "to": b, "port": p} for a, b, p in edges]}))


def test_workflow_runs_what_its_results_need(spark):
    cases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, place string")
    places = spark.createDataFrame([("x", "north"), ("y", "south")], "place string, region string")
    w = flow(
        [("c", "table_input", {"table": "cases"}), ("p", "table_input", {"table": "places"}), ("r", "relate_table", {"on": [["place", "place"]], "bring": "region"}), ("g", "group_table", {"by": ["region"], "value": "id", "how": "count"}), ("unused", "no_such_operator", {})],
        [("c", "r", "records"), ("p", "r", "related"), ("r", "g", "table")],
    )
    assert {r["region"]: r["value"] for r in w.run({"cases": cases, "places": places}, ["g"])["g"].collect()} == {"north": 2, "south": 1}
    assert w.order(["g"]) == ["c", "p", "r", "g"]
    for bad, wanted in ((w, "unused"), (flow([("g", "group_table", {})], []), "g"), (flow([("a", "sort", {}), ("b", "sort", {})], [("a", "b", "table"), ("b", "a", "table")]), "a")):
        with pytest.raises(Refusal):
            bad.order([wanted])


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01T00:10:00", 3.0), ("a", "2024-01-01T00:20:00", 2.0), ("b", "2024-01-02T05:00:00", 1.0), ("a", "2024-01-03T00:00:00", 5.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"k": k, "t": t, "v": v}) for k, t, v in rows))
    stream = spark.readStream.schema("k string, t timestamp, v double").json(f"file://{tmp_path}/in")

    def finished(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["cases"] for r in finished(surveillance.windowed_cases(stream, "t"), "complete", "windows")) == [1, 1, 2]
    assert sorted(r["n"] for r in finished(surveillance.sessions(stream, "t", "k"), "complete", "runs")) == [1, 1, 2]
    fell = finished(surveillance.fell_since_previous(stream, "k", "t", "v"), "append", "fell")
    assert sorted((r["key"], r["value"], r["previous"], r["fell"]) for r in fell if r["key"] == "a") == [("a", 2.0, 3.0, True), ("a", 3.0, None, False), ("a", 5.0, 2.0, False)]
    dated, without = surveillance.undated(spark.createDataFrame([(None,), ("x",)], "t string"), "t")
    assert dated.count() == without.count() == 1 and F.lit(1) is not None
