"""Names alike, tables under each other, records of several sources, tables on areas."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import values
from tallygrove.operators import dedup, relate, tables
from tallygrove.report import Refusal


@pytest.mark.parametrize("least", [0.8, 0.88, 0.95])
def test_all_names_alike_are_found(spark, least):
    rng = np.random.default_rng(7)
    base = ["".join(rng.choice(list("abcdefé "), rng.integers(1, 12))).strip() for _ in range(120)]
    other = []
    for name in base:
        x = list(name)
        for _ in range(rng.integers(0, 4)):
            if len(x) > 1:
                i = int(rng.integers(0, len(x) - 1))
                kind = rng.integers(0, 3)
                if kind == 0:
                    x[i], x[i + 1] = x[i + 1], x[i]
                elif kind == 1:
                    x[i] = str(rng.choice(list("abcdef")))
                else:
                    x.insert(i, str(rng.choice(list("abc"))))
        other.append("".join(x))
    base += ["abcdef", "acbdfe", "aaaa", "b", "", "aaaaaaaaaaaa"]
    other += ["acbedf", "fedcba", "aaa", "b", "", "aaaaaa"]
    left = spark.createDataFrame([(x,) for x in base] + [(None,)], "l string")
    right = spark.createDataFrame([(x,) for x in other], "r string")
    got = {(r["l"], r["r"]): r["similarity"] for r in relate.alike(left, right, "l", "r", least).collect()}
    want = {(a, b): s for a, b in itertools.product(set(base) - {""}, set(other) - {""}) if (s := values.jaro_winkler(a, b)) >= least}
    assert got == pytest.approx(want) and len(want) > 40
    assert ("abcdef", "acbedf") in got or least > 0.9
    with pytest.raises(Refusal):
        relate.alike(left, right, "l", "r", 0.5)


def test_spelling_without_common_neighbours(spark):
    records = spark.createDataFrame([("abcdef",), ("ZURICH",), ("nowhere",), (None,)], "place string")
    known = spark.createDataFrame([("acbedf", 1.0), ("Zurich", 2.0)], "name string, v double")
    got = {r["name"]: (r["how"], r["value"]) for r in relate.relate_spelling(records, known, "place", "name", "v").collect()}
    assert got["abcdef"] == ("spelling", 1.0) and got["zurich"] == ("exact", 2.0) and got["nowhere"] == ("none", None)


def table(spark, rows, keys, unit="", primary=(), value="people"):
    return tables.KeyedTable(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + f", {value} double"), keys, value, unit, primary)


def test_tables_are_lined_up_and_checked(spark):
    census = table(spark, [("North", "2020", 10.0), ("South", "2020", 20.0)], ["province", "year"], "persons")
    model = table(spark, [("North", "a", 11.0), ("South", "a", 21.0), ("East", "a", 5.0)], ["name", "model"], "people")
    other = table(spark, [("North", "b", 12.0), ("South", "b", None)], ["name", "model"], "People")
    out = tables.append_tables({"census": census, "one": model, "two": other}, source="from", new_key="row")
    rows = [tuple(r[c] for c in ("row", "name", "year", "model", "from", "people")) for r in out.df.orderBy("row").collect()]
    assert out.df.columns == ["row", "name", "year", "model", "from", "people"]
    assert [r[1:] for r in rows if r[4] == "census"] == [("North", "2020", None, "census", 10.0), ("South", "2020", None, "census", 20.0)]
    assert [r[0] for r in rows] == list(range(1, 8)) and [r[4] for r in rows] == ["census"] * 2 + ["one"] * 3 + ["two"] * 2
    assert [tuple(r) for r in out.report["lined_up"].collect()] == [("census", "province", "name")]
    assert {tuple(r) for r in out.report["missing"].collect()} == {("census", "model", 2), ("one", "year", 3), ("two", "year", 2)}


def test_appends_that_are_refused(spark):
    one = table(spark, [("a", 1.0), ("b", 2.0)], ["place"], "people", ["place"])
    assert tables.append_tables({"x": one, "y": one}, source="s").report["repeated"].count() == 0
    assert tables.append_tables({"x": one, "y": one}).report["repeated"].count() == 2
    labelled = tables.append_tables({"2020": one, "later": one}, source="s", numeric_labels=True).report["no_numbers"].collect()
    assert [tuple(r) for r in labelled] == [("later", 2)]
    half = table(spark, [("a", 1.0), ("zz", 2.0)], ["name"], "people")
    with pytest.raises(Refusal, match="1 of the 2"):
        tables.append_tables({"x": one, "y": half})
    under = tables.append_tables({"x": one, "y": half}, under={"y": {"name": "place"}})
    assert sorted(r["place"] for r in under.df.collect()) == ["a", "a", "b", "zz"]
    apart = table(spark, [("q", 1.0)], ["name"], "people")
    assert tables.append_tables({"x": one, "y": apart}).df.columns == ["place", "name", "people"]
    for wrong, more in ((table(spark, [("a", 1.0)], ["place"], "people", value="deaths"), {}), (table(spark, [("a", 1.0)], ["place"], "doses"), {}), (one, {"source": "place"}), (one, {"new_key": "people"}), (one, {"under": {"y": {"absent": "place"}}})):
        with pytest.raises(Refusal):
            tables.append_tables({"x": one, "y": wrong}, **more)
    with pytest.raises(Refusal):
        tables.append_tables({"x": one})


def in_order(records, pairs):
    """One record a source, pair after pair."""
    of, sources = {i: i for i, _ in records}, {i: {s} for i, s in records}
    for _, a, b in sorted(pairs):
        x, y = of[a], of[b]
        if x != y and not sources[x] & sources[y]:
            sources[x] |= sources.pop(y)
            of = {i: (x if c == y else c) for i, c in of.items()}
    groups = {}
    for i, c in of.items():
        groups.setdefault(c, []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_record_of_a_source_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    records = [(i, f"s{rng.integers(0, 4)}") for i in range(60)]
    pairs = {(int(rng.integers(0, 6)), *sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(110)}
    pairs = list({(a, b): (k, a, b) for k, a, b in pairs}.values())
    out = dedup.one_per_source(spark.createDataFrame(records, "id long, source string"), spark.createDataFrame(pairs, "rank long, a long, b long"))
    assert {r["id"]: r["class_id"] for r in out.df.collect()} == in_order(records, pairs)


def test_points_of_several_sources(spark):
    rows = [(1, "Hill Clinic", 10.0, 50.0, "a"), (2, "Hill clinic", 10.0001, 50.0, "b"), (3, "Other Name", 10.00012, 50.0, "c"), (4, "Hill Clinic", 10.0, 50.0, "a"), (5, "Lost", None, None, "b"), (6, "Hill Clinic", 12.0, 50.0, "c")]
    points = spark.createDataFrame(rows, "id long, name string, lon double, lat double, source string")
    out = dedup.dedup_sources(points, 300.0, 50.0)
    assert {r["id"]: r["class_id"] for r in out.df.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {(r["a"], r["b"]) for r in out.report["rejected"].collect()} == {(2, 4)}
    got = {(r["a"], r["b"]): (r["score"], r["class"]) for r in out.report["candidates"].collect()}
    assert got == {(1, 2): (2, "match"), (2, 4): (2, "match"), (1, 3): (1, "review"), (2, 3): (1, "review"), (3, 4): (1, "review")}
    said = spark.createDataFrame([(3, 2, "match", "Other Name", "Hill clinic"), (1, 3, "match", "An old name", "Other Name")], "a long, b long, decision string, name_a string, name_b string")
    decided = dedup.dedup_sources(points, 300.0, 50.0, decisions=said)
    assert {r["id"]: r["class_id"] for r in decided.df.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert dedup.dedup_sources(points.limit(0), 300.0, 50.0).df.count() == 0
    with pytest.raises(Refusal):
        dedup.dedup_sources(points, 10.0, 50.0)


def test_crowded_places_of_several_sources(spark):
    """Six thousand records of two sources at one place: nine million pairs of names, were they compared."""
    p = spark.range(6000).selectExpr("id", "concat('Clinic ', id % 3000) name", "10D lon", "50D lat", "if(id < 3000, 'a', 'b') source")
    out = dedup.dedup_sources(p, 100.0, 50.0, fuzzy=0.999)
    assert out.df.where("class_id <> id % 3000").count() == 0 and out.df.count() == 6000
    few = p.where("id % 3000 < 20")
    assert few.count() == 40 and dedup.dedup_sources(few, 100.0, 50.0, fuzzy=0.999).report["candidates"].count() == 400


def test_alike_pairs_are_those_of_all_pairs(spark):
    """Short and long names, equal, swapped, longer by a letter, over cells and the date line, sources known or not."""
    base = "".join(chr(97 + i * 7 % 26) for i in range(260))
    names = ["Hill", "Hlil", "Hill.", "Hills", base, base[:100] + base[101] + base[100] + base[102:], base + "q", base[:-1], "", None]
    rows = [(i * 100 + j * 10 + k, n, 179.9999 + j * 0.00015 - (360 if j > 0 else 0), 12.0 + k * 0.00021, [None, "a", "b"][(i + j + k) % 3]) for i, n in enumerate(names) for j in range(3) for k in range(3)]
    p = spark.createDataFrame(rows, "id long, name string, lon double, lat double, source string")
    got = lambda df: sorted((r["a"], r["b"], round(r["distance_m"], 6), round(r["similarity"], 9)) for r in df.collect())
    for least in (0.88, 0.995, 0.999, 1.0):
        every = got(dedup.nearby_pairs(p, 30.0, source="source").where(F.col("similarity") >= least))
        assert got(dedup.alike_pairs(p, 30.0, least, source="source")) == every and every
    assert 0 < dedup.alike_pairs(p, 30.0, 0.999, source="source").where("similarity < 1").count()


def test_tables_on_areas_say_what_fails(spark):
    areas = spark.createDataFrame([("North", "u1"), ("South", "u2"), ("south", "u3"), ("Isles", "u4"), ("Isles", "u4"), ("Empty", "u5")], "area string, unit string")
    rows = spark.createDataFrame([("north", 1.0, "red"), ("South ", 2.0, "blue"), ("SOUTH", 3.0, "blue"), ("Isles", 4.0, None), ("Isles", 5.0, None), (None, 6.0, None), ("Nowhere", 7.0, "red")], "place string, v double, company string")
    out = relate.join_to_areas(areas, rows, "area", "place", "v", category="company", unit="unit")
    assert sorted(((r["area"], r["v"], r["company"]) for r in out.df.collect()), key=str) == sorted([("North", 1.0, "red"), ("South", None, "blue"), ("south", None, "blue"), ("Isles", None, None), ("Isles", None, None), ("Empty", None, None)], key=str)
    found = {(r["code"], r["subject"]): r["n"] for r in out.report["diagnostics"].collect()}
    assert found == {("missing-data-key", None): 1, ("unmatched-data-key", "Nowhere"): 1, ("unmatched-boundary", "Empty"): 1, ("duplicate-boundary-key", "south"): 2, ("ambiguous-data-key", "SOUTH"): 2, ("multiple-data-rows", "Isles"): 2}
    framed = spark.createDataFrame([("North", "2005", 1.0), ("North", "2010", 2.0), ("South", "2005", 3.0), ("South", "2005", 4.0), ("North", None, 9.0)], "place string, year string, v double")
    got = {r["area"]: (r["v"], r["frames"]) for r in relate.join_to_areas(areas, framed, "area", "place", "v", frame="year").df.collect()}
    assert got["North"] == (2.0, {"2005": 1.0, "2010": 2.0}) and got["South"] == (None, {"2005": None}) and got["Empty"] == (None, None)
    with pytest.raises(Refusal):
        relate.join_to_areas(areas, rows, "area", "place", "v", frame="place")


def test_times_of_day(spark):
    df = spark.createDataFrame([("3:05 pm",), ("12:00 A.M.",), ("12:30p.m.",), ("13:00 pm",), ("3:5 pm",), ("03:05",), ("23:59",), ("24:00",)], "t string")
    twelve = df.select(values.written_datetime(F.lit("2024-02-03"), "year-month-day", time=F.col("t"), clock="12-hour").cast("string")).collect()
    assert [r[0] and r[0][11:16] for r in twelve] == ["15:05", "00:00", "12:30", None, None, None, None, None]
