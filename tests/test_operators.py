"""Published figures, refusals, and the rules of unknown values."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallygrove.functions import values
from tallygrove.operators import dedup, geo, graph, measures, raster, register, regression, relate, rules, scan, series, tables
from tallygrove.report import Refusal


def one(df):
    return df.collect()[0]


def test_numbers_and_dates(spark):
    texts = ["1", " -2.5 ", "1e3", "1d", "0x10", "NaN", "Infinity", "1e999", "", None, ".5", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(values.number(F.col("t"))).collect()] == [1, -2.5, 1000, None, None, None, None, None, None, None, 0.5, 5.0]
    days = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-1-1",), (None,)], "t string")
    assert [str(r[0]) for r in days.select(values.day(F.col("t"))).collect()] == ["2024-02-29", "None", "None", "None"]
    assert one(spark.range(1).select(values.half_up(F.lit(-2.5)), values.half_up(F.lit(2.5)))) == (-2.0, 3.0)
    dms = spark.createDataFrame([("51°30'36\"N",), ("0 7 39 W",), ("-12.5",), ("x",)], "t string").select(values.coordinate(F.col("t"))).collect()
    assert dms[0][0] == pytest.approx(51.51) and dms[1][0] == pytest.approx(-0.1275) and dms[2][0] == -12.5 and dms[3][0] is None


@given(st.text(max_size=12), st.text(max_size=12))
def test_name_similarity_is_symmetric_enough_and_bounded(a, b):
    s = values.jaro_winkler(a, b)
    assert 0 <= s <= 1 and (s == 1.0) >= (a == b != "")


def test_name_similarity_goldens():
    assert values.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert values.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)


def test_utm_there_and_back(spark):
    p = spark.createDataFrame([(2.2945, 48.8582), (-70.5, -33.4), (179.9, 10.0)], "lon double, lat double")
    q = geo.project(p)
    x, y = values.from_utm(F.col("east"), F.col("north"), F.col("utm_zone"), F.col("lat") < 0)
    for r in q.select("*", x.alias("x"), y.alias("y")).collect():
        assert r["x"] == pytest.approx(r["lon"], abs=1e-7) and r["y"] == pytest.approx(r["lat"], abs=1e-7)
    tower = one(q.where("lon between 2 and 3"))
    assert tower["utm_zone"] == 31 and tower["east"] == pytest.approx(448252, abs=2) and tower["north"] == pytest.approx(5411954, abs=25)


def test_groups_with_unknown_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double")
    got = {how: {r["k"]: r["value"] for r in tables.group(df, ["k"], "v", how).collect()} for how in tables.STATISTICS}
    assert got["sum"] == {"a": None, "b": 6.0, "c": None} and got["count"] == {"a": 2, "b": 2, "c": 1} and got["median"] == {"a": None, "b": 3.0, "c": None}
    kept = {how: {r["k"]: r["value"] for r in tables.group(df, ["k"], "v", how, exclude_missing=True).collect()} for how in ("sum", "mean")}
    assert kept == {"sum": {"a": 1.0, "b": 6.0, "c": 0.0}, "mean": {"a": 1.0, "b": 3.0, "c": None}}
    with pytest.raises(Refusal):
        tables.group(df, ["k"], "v", "mode")


def test_ambiguous_keys_are_refused_or_each_kept(spark):
    left = spark.createDataFrame([(1, " A b"), (2, "c"), (3, ""), (4, None)], "id int, k string")
    right = spark.createDataFrame([("a-B", "x"), ("c", "y"), ("c", "z"), ("", "w")], "k string, v string")
    with pytest.raises(PySparkException):
        relate.relate(left, right, [("k", "k")], "v", compare="folded").df.collect()
    each = relate.relate(left, right, [("k", "k")], "v", several="each", compare="folded").df.collect()
    assert sorted((r["id"], r["v"]) for r in each) == [(1, "x"), (2, "y"), (2, "z")]
    kept = relate.relate(left, right.where("v <> 'z'"), [("k", "k")], "v", "keep", "none").df.collect()
    assert sorted((r["id"], r["v"]) for r in kept) == [(1, "none"), (2, "y"), (3, "none"), (4, "none")]
    with pytest.raises(Refusal):
        relate.relate(left, right, [("k", "k")], "v", gaps="maybe")


def test_overlapping_periods_are_refused(spark):
    r = spark.createDataFrame([("2024-01-05",)], "d string")
    p = spark.createDataFrame([("2024-01-01", "2024-01-05", "x"), ("2024-01-05", "2024-03-09", "y")], "s string, e string, v string")
    with pytest.raises(PySparkException):
        relate.relate_period(r, p, "d", "s", "e", "v").collect()
    assert one(relate.relate_period(r, p, "d", "s", "e", "v", shift=60))["v"] == "y"
    assert one(relate.relate_period(r, p, "d", "s", "e", "v", shift=600, keep=True))["v"] is None


def test_spelling(spark):
    names = spark.createDataFrame([("Saint Mary Hospital",), ("St Johns",), ("Nowhere",), ("Northgate",)], "n string")
    known = spark.createDataFrame([("Saint Marys Hospital", 1), ("Northgate", 2), ("St Johnx", 3), ("St Johnz", 4)], "n string, v int")
    got = {r["name"]: (r["how"], r["value"]) for r in relate.relate_spelling(names, known, "n", "n", "v").collect()}
    assert got == {"saint mary hospital": ("spelling", 1), "northgate": ("exact", 2), "nowhere": ("none", None), "st johns": ("ambiguous", None)}


def test_two_by_two_published_figures(spark):
    """Deaths by water supplier, 1854: rates per house, and a zero cell."""
    table = spark.createDataFrame([(30, 70, 10, 90), (0, 10, 5, 5)], "a int, b int, c int, d int")
    m = measures.risk_measures(*[F.col(c) for c in "abcd"])
    first, zero = table.select(*[v.alias(k) for k, v in m.items()]).collect()
    assert first["risk_ratio"] == pytest.approx(3.0) and first["odds_ratio"] == pytest.approx(27 / 7) and first["risk_difference"] == pytest.approx(0.2)
    se = math.sqrt(70 / 3000 + 90 / 1000)
    assert first["rr_lower"] == pytest.approx(3 * math.exp(-1.959963984540054 * se))
    assert zero["risk_ratio"] is None and zero["odds_ratio"] is None and zero["risk_difference"] == pytest.approx(-0.5)
    with pytest.raises(Refusal):
        measures.two_by_two_totals(1, None, 2, 3)
    p = one(spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int").select(measures.fisher_exact_p("a", "b", "c", "d"), measures.chi_square_p(F.lit(3.841458820694124))))
    assert p[0] == pytest.approx(0.4857142857) and p[1] == pytest.approx(0.05)


def test_rates_refuse_what_is_no_count(spark):
    df = spark.createDataFrame([("a", "1", "10"), ("b", "x", "10")], "k string, n string, d string")
    with pytest.raises(PySparkException):
        measures.rate(df, F.col("n"), F.col("d"), ["k"]).collect()
    fine = one(measures.rate(df.where("k = 'a'"), F.col("n"), F.col("d"), ["k"], 100, least=20))
    assert fine["rate"] is None and fine["reason"] == "too few at risk"


def test_designs_withhold_measures(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "e boolean, k boolean")
    t = measures.under_design(measures.two_by_two(df, F.col("e"), F.col("k")), "case-control")
    assert "risk_ratio" not in t.df.columns and "odds_ratio" in t.df.columns
    assert {r[0] for r in t.report["withheld"].collect()} == {"risk_ratio", "risk_difference"}


def test_series_fills_gaps_and_counts_the_undated(spark):
    df = spark.createDataFrame([("2024-01-30",), ("2024-02-02",), (None,)], "d string")
    s = series.case_series(df, values.day(F.col("d")), "day")
    assert [r["cases"] for r in s.df.orderBy("period").collect()] == [1, 0, 0, 1] and one(s.report["undated"])[0] == 1
    assert series.case_series(df.where("d is null"), values.day(F.col("d")), "day").df.count() == 0
    with pytest.raises(Refusal):
        series.case_series(df, F.col("d"), "fortnight")


def test_rules_conflict_wait_and_refuse_circles(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 50.0, 2.0), (3, None, 1.0)], "id int, x double, y double")
    c = rules.Condition
    given_ = [*rules.bands("x", "band", [10], ["low", "high"]), rules.Rule("next", "go", [[c("band", "=", "high")]]), rules.Rule("next", "stop", [[c("y", ">", 1)]]), rules.Rule("ratio", rules.Compute("x", "divided by", "y"))]
    got = {r["id"]: (r["band"], r["next"], r["conflicts"], r["ratio"]) for r in rules.apply_rules(df, given_, {"next": "wait"}).collect()}
    assert got == {1: ("low", "wait", [], None), 2: ("high", None, ["next"], 25.0), 3: (None, "wait", [], None)}
    with pytest.raises(Refusal):
        rules.apply_rules(df, [rules.Rule("p", "1", [[c("q", "=", "1")]]), rules.Rule("q", "1", [[c("p", "=", "1")]])])


def test_previous_row_reasons(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 2, 30), (4, 3, 40), (5, None, 50)], "id int, t int, v int").withColumn("g", F.lit(1))
    got = {r["id"]: (r["no_previous"], r["before"]) for r in rules.previous_row(df, ["g"], "t", {"before": "v"}, "id").collect()}
    assert got == {1: ("first", None), 2: ("repeated", None), 3: ("repeated", None), 4: ("after-repeated", None), 5: ("unordered", None)}


@given(st.lists(st.sampled_from([-3.0, -1.0, 2.0, 4.0]), min_size=1, max_size=12))
def test_carried_value_has_the_closed_form(steps):
    value, total, low = 3.0, 0.0, math.inf
    for s in steps:
        value = max(0.0, value + s)
        total += s
        low = min(low, total)
        assert value == total + max(3.0, 0.0 - low)


def test_chains_with_loops_and_missing_sources(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("m", "gone"), ("n", "m"), ("d", "a"), ("d", "b")], "c string, s string")
    r = graph.chains(df, "c", "s")
    got = {x["case"]: (x["root"], x["generation"], x["status"]) for x in r.df.collect()}
    assert got["c"] == ("a", 2, "linked") and got["a"] == ("a", 0, "index") and got["x"][2] == got["y"][2] == "loop" and got["m"][2] == "source missing" and got["n"] == ("m", 1, "linked")
    assert one(r.report["several"])["case"] == "d"


def test_regression_equals_the_closed_form_and_refuses_collinear_columns(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 70 + [(0, 1)] * 10 + [(0, 0)] * 90
    df = spark.createDataFrame(rows, "e int, k int")
    m = {r["term"]: r for r in regression.regress(df, F.col("k"), {"e": F.col("e")}).df.collect()}
    assert m["e"]["ratio"] == pytest.approx(27 / 7, rel=1e-6) and m["e"]["error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90), rel=1e-5)
    with pytest.raises(Refusal):
        regression.regress(df, F.col("k"), {"e": F.col("e"), "twice": F.col("e") * 2})
    total = spark.createDataFrame([(x / 4,) for x in range(9)], "x double").select(sum(regression.spline_basis(F.col("x"), [0.0, 1.0, 2.0]), F.lit(0.0)).alias("s"), "x").collect()
    assert all(r["s"] == pytest.approx(1 - max(0.0, 1 - r["x"]) ** 3) for r in total)


def newton(x, y, beta, poisson=True):
    import numpy as np

    for _ in range(60):
        mu = np.exp(x @ beta) if poisson else 1 / (1 + np.exp(-x @ beta))
        w = mu if poisson else mu * (1 - mu)
        info = x.T @ (x * w[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - mu))
    return beta, np.linalg.inv(info), mu


def test_absorbed_strata_equal_a_model_with_a_constant_for_each_and_sequence_errors_too(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i // 3 % 2], str(i % 4), float(rng.normal()), int(rng.poisson(3 + i % 5))) for i in range(120)]
    extra = [(500 + i, "c", "0", float(i), 0) for i in range(3)] + [(600, " ", "0", 1.0, 2), (601, "a", "0", None, 2), (602, "a", "0", 1.0, -1)]
    df = spark.createDataFrame(rows + extra, "t int, place string, month string, x double, y int")
    got = {e: regression.regress(df, F.col("y"), {"x": F.col("x")}, family="poisson", strata=["place", "month"], errors=e, order=["t"], lag=5) for e in ("model", "overdispersed", "hac")}
    keys = sorted({(r[1], r[2]) for r in rows})
    x = np.array([[r[3], *[float((r[1], r[2]) == k) for k in keys]] for r in rows])
    y = np.array([r[4] for r in rows], float)
    beta, inverse, mu = newton(x, y, np.array([0.0, *[1.0] * len(keys)]))
    m = {e: g.df.first() for e, g in got.items()}
    assert m["model"]["estimate"] == pytest.approx(beta[0], abs=1e-8) and m["model"]["error"] == pytest.approx(math.sqrt(inverse[0, 0]), rel=1e-7)
    dispersion = ((y - mu) ** 2 / mu).sum() / (len(rows) - x.shape[1])
    fit = got["model"].report["fit"].first()
    assert fit["dispersion"] == pytest.approx(dispersion, rel=1e-7) and (fit["n"], fit["left_out"], fit["strata_used"], fit["strata_dropped"]) == (120, 6, len(keys), 1)
    assert m["overdispersed"]["error"] == pytest.approx(math.sqrt(inverse[0, 0] * max(1, dispersion)), rel=1e-7)
    g = (x * (y - mu)[:, None]) @ inverse[:, 0]
    v = (g * g).sum() + 2 * sum((1 - lag / 6) * (g[lag:] * g[:-lag]).sum() for lag in range(1, 6))
    assert m["hac"]["error"] == pytest.approx(math.sqrt(v), rel=1e-7)
    assert {r["unknown"]: r["n"] for r in got["model"].report["left_out"].collect()} == {"stratum place": 1, "x": 1, "outcome": 1}
    for wrong in ({"strata": ["place"], "family": "logistic"}, {"strata": ["place", "place"], "family": "poisson"}, {"errors": "hac"}, {"errors": "none"}):
        with pytest.raises(Refusal):
            regression.regress(df, F.col("y"), {"x": F.col("x")}, **wrong)


def test_sequence_errors_across_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(regression, "BLOCK", 7)
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=50)) > 0
    x = np.stack([np.ones(50), rng.normal(size=50)], axis=1)
    df = spark.createDataFrame([(i, float(x[i, 1]), int(y[i])) for i in rng.permutation(50).tolist()], "t int, x double, y int")
    for lag in (0, 1, 3):
        got = regression.regress(df, F.col("y"), {"x": F.col("x")}, errors="hac", order=["t"], lag=lag).df.where("term = 'x'").first()
        beta, inverse, mu = newton(x, y.astype(float), np.zeros(2), poisson=False)
        g = (x * (y - mu)[:, None]) @ inverse[:, 1]
        v = (g * g).sum() + 2 * sum((1 - b / (lag + 1)) * (g[b:] * g[:-b]).sum() for b in range(1, lag + 1))
        assert got["estimate"] == pytest.approx(beta[1], abs=1e-8) and got["error"] == pytest.approx(math.sqrt(v), rel=1e-7)


def test_likelihood_ratio_limits(spark):
    import numpy as np

    cells = {(1, 1): 6, (1, 0): 2, (0, 1): 5, (0, 0): 20}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "e int, k int")
    got = regression.regress(df, F.col("k"), {"e": F.col("e")}, errors="profile").df.where("term = 'e'").first()
    assert got["ratio"] == pytest.approx(12.0, rel=1e-6)

    def deviance(b):  # the best constant for a held coefficient
        a = np.linspace(-6, 3, 90001)
        p1, p0 = 1 / (1 + np.exp(-a - b)), 1 / (1 + np.exp(-a))
        return -2 * (6 * np.log(p1) + 2 * np.log(1 - p1) + 5 * np.log(p0) + 20 * np.log(1 - p0)).max()

    for limit in (got["lower"], got["upper"]):
        assert deviance(math.log(limit)) - deviance(math.log(12.0)) == pytest.approx(1.959963984540054**2, abs=1e-4)


def test_scan_finds_a_planted_cluster(spark):
    rows = [(i, (i * 7 % 30) / 10, (i * 11 % 30) / 10, f"2024-01-{1 + i * 13 % 28:02d}") for i in range(200)] + [(1000 + i, 1.5, 1.5, f"2024-01-{14 + i % 2}") for i in range(15)]
    df = spark.createDataFrame(rows + [(5000, None, 1.0, "2024-01-01")], "id int, lat double, lon double, date string")
    s = scan.space_time_scan(df, 12.0, 3, replications=19)
    top = s.df.orderBy(F.desc("llr")).first()
    assert top["lat"] == 1.5 and top["lon"] == 1.5 and top["cases"] >= 15 and top["p"] <= 0.1 and str(top["start"]) >= "2024-01-13"
    assert one(s.report["undated"])[0] == 1


def test_geometry(spark):
    square = "array(array(struct(0D AS x, 0D AS y), struct(10D AS x, 0D AS y), struct(10D AS x, 10D AS y), struct(0D AS x, 10D AS y), struct(0D AS x, 0D AS y)))"
    df = spark.sql(f"SELECT {square} AS geometry, 'q' AS name")
    at = lambda x, y: one(df.select(geo.within(F.col("geometry"), F.lit(x), F.lit(y))))[0]
    assert (at(5.0, 5.0), at(10.0, 5.0), at(11.0, 5.0), at(0.0, 0.0)) == ("Inside", "Boundary", "Outside", "Boundary")
    disc = one(df.select(geo.area_m2(geo.circle(F.lit(8.0), F.lit(47.0), 1000.0, 256))))[0]
    assert disc == pytest.approx(math.pi * 1e6, rel=0.01)
    p = spark.createDataFrame([(1, 10.0, 50.0), (2, None, 1.0), (3, 179.95, 0.0)], "id int, lon double, lat double")
    c = spark.createDataFrame([(7, 10.1, 50.0), (8, -179.95, 0.0)], "id int, lon double, lat double")
    got = {r["id"]: (r["nearest_id"], r["reason"]) for r in geo.nearest(p, c, first_km=1).collect()}
    assert got == {1: (7, None), 2: (None, "location missing"), 3: (8, None)}
    moved = geo.donut_mask(p.where("id <> 2"), 100, 500, 3)
    away = one(geo.compare_points(p.where("id <> 2"), moved))
    assert away["n"] == 2 and 100 <= away["mean_m"] <= away["max_m"] <= 500.5
    with pytest.raises(Refusal):
        geo.hexagons(p, 100, 1)


def test_points_that_are_one(spark):
    p = spark.createDataFrame([(1, "North Clinic", 10.0, 50.0), (2, "north clinic.", 10.0001, 50.0), (3, "Quay Pharmacy", 10.0, 50.0), (4, "North Clinic", 11.0, 50.0), (5, "x", None, None)], "id int, name string, lon double, lat double")
    assert {r["id"]: r["class_id"] for r in dedup.dedup_points(p, 50.0).df.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_bilinear_and_clip(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row long, col long, value double")
    grid = raster.Grid(0.0, 4.0, 1.0)
    p = spark.createDataFrame([(1, 1.0, 3.0), (2, 0.5, 3.5), (3, 9.0, 9.0)], "id int, lon double, lat double")
    assert {r["id"]: r["value"] for r in raster.sample_bilinear(p, cells, grid).collect()} == {1: 5.5, 2: 0.0, 3: None}
    box = spark.sql("SELECT array(array(struct(0D AS x, 2D AS y), struct(2D AS x, 2D AS y), struct(2D AS x, 4D AS y), struct(0D AS x, 4D AS y), struct(0D AS x, 2D AS y))) AS geometry")
    assert raster.clip(cells, box, grid).count() == 4


def test_scan_picks_as_the_reference(spark):
    """Against a greedy pick over all circles in plain Python: clusters behind a dropped one and small circles of a centre step in."""
    import datetime
    import math
    import random

    rnd = random.Random(4)
    lons = [i * 0.05 for i in range(30)]  # 5.6 km apart, circles of up to 12 km
    cases = [(lons[rnd.randrange(30)], rnd.randrange(12)) for _ in range(220)]
    cases += [(lons[p], d) for p, d, n in ((3, 2, 9), (5, 2, 6), (7, 3, 5), (16, 5, 8), (18, 6, 6), (25, 9, 7)) for _ in range(n)]
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(i, lon, 0.0, day + datetime.timedelta(d)) for i, (lon, d) in enumerate(cases)], "id long, lon double, lat double, date date")
    got = [r["llr"] for r in scan.space_time_scan(df, 12.0, 3, replications=3).df.collect()]
    n, windows = len(cases), []
    for c in lons:
        for reach in (0, 1, 2):
            members = frozenset(x for x in lons if abs(x - c) <= reach * 0.05 + 1e-9)
            people = sum(lon in members for lon, _ in cases)
            best = 0.0
            for end in range(12):
                for run in range(1, 4):
                    k = sum(lon in members and end - run < d <= end for lon, d in cases)
                    e = people * sum(end - run < d <= end for _, d in cases) / n
                    if k > max(e, 1):
                        best = max(best, k * math.log(k / e) + (n - k) * math.log((n - k) / (n - e)))
            windows.append((best, members))
    want, used = [], set()
    for llr, members in sorted(windows, key=lambda w: -w[0]):
        if len(want) < 10 and llr > 0 and not members & used:
            want.append(llr)
            used |= members
    assert sorted(got, reverse=True) == pytest.approx(want)


def test_compatible_characters_fold_to_plain_ones_and_empty_names_are_unlike(spark):
    rows = spark.createDataFrame([("Ｈｏｓｐｉｔａｌ　Ⅴ",), ("plain",), (None,)], "n string")
    assert [r[0] for r in rows.select(values.folded(F.col("n"))).collect()] == ["hospital v", "plain", None]
    assert values.jaro_winkler("", "") == 0.0


def test_spelling_candidates_need_no_common_first_letter(spark):
    names = spark.createDataFrame([("Kanada",), ("Xyz",)], "n string")
    known = spark.createDataFrame([("Canada", 7), ("Norway", 8)], "n string, v int")
    got = {r["name"]: (r["how"], r["value"]) for r in relate.relate_spelling(names, known, "n", "n", "v").collect()}
    assert got == {"kanada": ("spelling", 7), "xyz": ("none", None)}


def test_edits_apply_in_order_and_stale_ones_are_told(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, v string")
    log = spark.createDataFrame([("1", "b", "c", 2), ("1", "a", "b", 1), ("2", "x", "y", 1), ("3", None, "z", 1)], "record string, old string, new string, at int")
    out = tables.edit_cells(df, "id", log, "v", "at")
    assert {r["id"]: r["v"] for r in out.df.collect()} == {1: "c", 2: "a", 3: "z"}
    assert [tuple(r) for r in out.report["stale"].collect()] == [("2", "x", "y")]


def test_written_datetimes_are_read_only_as_declared(spark):
    rows = [("4/19", "12:30 AM", "1940-04-19 00:30:00"), ("13/1", "1:00 PM", None), ("4/19", "13:00 PM", None), ("2/30", "1:00 PM", None), ("4/19/40", "1:00 PM", None), (None, "1:00 PM", None)]
    df = spark.createDataFrame(rows, "d string, t string, want string")
    got = df.select("want", values.written_datetime(F.col("d"), "month/day", 1940, F.col("t"), "12-hour").cast("string").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    one = df.limit(1)
    assert one.select(values.written_datetime(F.lit("19/4/1940"), "day/month/year").cast("string")).first()[0] == "1940-04-19 00:00:00"
    assert one.select(values.written_datetime(F.lit("1940-4-9"), "year-month-day", time=F.lit("23:05")).cast("string")).first()[0] == "1940-04-09 23:05:00"


def test_row_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = tables.numbered(df, ["x"]).collect()
    assert all(r["row_number"] == r["x"] + 1 for r in got) and len(got) == 1000
    assert tables.numbered(df.where("x < 0"), ["x"]).count() == 0


def test_names_are_matched_with_registers(spark):
    types = spark.createDataFrame([("dispensaire",), ("hopital",)], "word string")
    names = spark.createDataFrame([("Bela (Nord) Dispensaire",), ("Bela Clinic",), ("Dispensaire",), (None,)], "name string")
    parts = [(r["bare"], r["type"], r["qualifier"]) for r in register.name_parts(names, "name", types).orderBy(F.col("name").desc_nulls_last()).collect()]
    assert parts == [("dispensaire", "", ""), ("bela clinic", "", ""), ("bela", "dispensaire", "nord"), ("", "", "")]
    first = spark.createDataFrame(
        [("A1", "Bela Dispensaire", "Dispensaire", "Nord District", None), ("A2", "Bela Dispensaire", "Dispensaire", "Sud", None), ("B1", "Kanto Dispensaire", "Dispensaire", "Nord", None), ("C1", "Moraga H\u00f4pital", "H\u00f4pital", "Sud", "Old Moraga"), ("D1", "Tillanni Dispensaire", "Dispensaire", "Sud", None)],
        "facility string, name string, type string, area string, alternate string",
    )
    second = spark.createDataFrame([("11", "Zinder dispensaire"), ("12", "Wenduuma Dispensaire"), ("13", "Makump Bana")], "facility string, name string")
    rows = [("Moraga Hopital", None), ("Moraga Hopital", None), ("Old Moraga", None), ("Tilanni Dispensaire", None), ("Kanto H\u00f4pital", None), ("Bela Dispensaire", None), ("Nord Communaut\u00e9s", None), ("Zinder Dispensaire", None), ("Wenduma Dispensaire", None), ("Makump", None), ("nowhere", None), ("Bela (Sud)", ""), (None, "x")]
    listed = spark.createDataFrame(rows, "name string, area string")
    match = lambda names, **more: {r["name"]: r for r in register.match_register(names, {"first": first, "second": second}, area_markers=["Communaut\u00e9s"], name_only=["second"], **more).df.collect()}
    got = match(listed)
    assert {k: (r["outcome"], r["facility"]) for k, r in got.items()} == {
        "Moraga Hopital": ("exact", "C1"), "Old Moraga": ("exact", "C1"), "Tilanni Dispensaire": ("spelling", "D1"), "Kanto H\u00f4pital": ("type-differs", None), "Bela Dispensaire": ("ambiguous", None),
        "Nord Communaut\u00e9s": ("area", None), "Zinder Dispensaire": ("exact", "11"), "Wenduma Dispensaire": ("spelling", None), "Makump": ("not-found", None), "nowhere": ("not-found", None), "Bela (Sud)": ("exact", "A2"),
    }
    assert got["Wenduma Dispensaire"]["held"] and not got["Zinder Dispensaire"]["held"]
    assert match(spark.createDataFrame([("Bela Dispensaire", "Sud region")], "name string, area string"))["Bela Dispensaire"]["facility"] == "A2"
    chosen = spark.createDataFrame([("Bela Dispensaire", "A1"), ("Kanto H\u00f4pital", "none"), ("Wenduma Dispensaire", "12"), ("Zinder Dispensaire", "A1"), ("Tilanni Dispensaire", "gone")], "name string, facility string")
    decided = match(listed, decisions=chosen)
    assert {k: (r["outcome"], r["facility"]) for k, r in decided.items() if r["decided"]} == {"Bela Dispensaire": ("ambiguous", "A1"), "Kanto H\u00f4pital": ("type-differs", None), "Wenduma Dispensaire": ("spelling", "12")}
    assert decided["Zinder Dispensaire"]["facility"] == "11"
    weighed = register.match_register(listed, {"first": first}).report["candidates"].where("name = 'Bela Dispensaire'").collect()
    assert sorted(r["facility"] for r in weighed) == ["A1", "A2"]


def test_voronoi_cells_hold_what_is_nearest(spark):
    import random

    rnd = random.Random(8)
    sites = [(i, i % 2, rnd.uniform(0, 1000), rnd.uniform(0, 600)) for i in range(24)]
    df = spark.createDataFrame([*sites, (99, 1, None, 3.0)], "id int, part int, east double, north double")
    bounds = spark.createDataFrame([(0, 0, 0, 1000, 600), (1, 0, 0, 1000, 600)], "part int, left int, bottom int, right int, top int")
    cells = {(r["part"], r["id"]): [(p["x"], p["y"]) for p in r["geometry"][0]] for r in geo.voronoi(df, bounds, "part").collect()}
    assert set(cells) == {(g, i) for i, g, _, _ in sites}
    for _ in range(200):
        g, x, y = rnd.randrange(2), rnd.uniform(-100, 1100), rnd.uniform(-100, 700)
        near = min((s for s in sites if s[1] == g), key=lambda s: math.dist(s[2:], (x, y)))[0]
        turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(cells[g, near], cells[g, near][1:], strict=False)]
        assert min(turns) > -1e-6 or max(turns) < 1e-6
    with pytest.raises(PySparkException):
        geo.voronoi(spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 1.0, 1.0)], "id int, part int, east double, north double"), bounds, "part").collect()


def test_a_placement_by_control_points(spark):
    schema = "id int, x double, y double, lon double, lat double"
    exact = [(i, x, y, 0.002 * x + 0.0005 * y + 10, 0.0004 * x - 0.002 * y + 50) for i, (x, y) in enumerate([(0.0, 0.0), (100.0, 0.0), (0.0, 80.0), (60.0, 50.0)])]
    df = spark.createDataFrame([*exact, (9, None, 1.0, 1.0, 1.0)], schema)
    fit = one(geo.fit_placement(df).report["fit"])
    assert [fit[k] for k in "abcdef"] == pytest.approx([0.002, 0.0005, 10, 0.0004, -0.002, 50]) and fit["rms_m"] < 1e-4 and fit["n"] == 4
    shift = geo.fit_placement(df, "shift", (0.002, 0.0005, 0.0004, -0.002))
    assert one(shift.report["fit"])["max_m"] < 1e-4 and shift.df.count() == 4
    for wrong in (spark.createDataFrame(exact[:2], schema), spark.createDataFrame([(i, i * 1.0, i * 2.0, 1.0, 1.0) for i in range(4)], schema)):
        with pytest.raises(Refusal):
            geo.fit_placement(wrong)
    with pytest.raises(Refusal):
        geo.fit_placement(df, "shift")


def test_levels_against_elevations(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.1, 0.5), (3, None, 0.0, 1.0), (4, 0.0, 0.2, None)], "id int, lat double, lon double, z double")
    sites = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.1)], "site_id int, lat double, lon double")
    extract = spark.createDataFrame([(8, 1000.0)], "site_id int, mm double")
    near = geo.assign_sites(points, sites, extract)
    compare = lambda e, datum="d", ref="baseline-sea-surface": geo.compare_elevation(near, points, e, F.col("z"), "mm", datum, ref, scale=0.001)
    assert {r["id"]: (r["site_id"], r["status"]) for r in compare(extract).collect()} == {1: (8, "Review"), 2: (8, "Review"), 3: (None, "Unknown"), 4: (8, "Unknown")}
    with pytest.raises(PySparkException):
        compare(extract.union(extract)).collect()
    for wrong in (("", "baseline-sea-surface"), ("d", "other-datum")):
        with pytest.raises(Refusal):
            compare(extract, *wrong)


def test_totals_of_a_text_column_and_classes_by_appearance(spark):
    df = spark.createDataFrame([("a", "1", 3), ("a", " 2.5", 2), ("b", "", 1), ("b", "4", 4), (" a ", None, 5)], "k string, v string, i int")
    assert {r["k"]: r["v"] for r in tables.total_column(df, ["k"], "v").collect()} == {"a": 3.5, "b": None, " a ": None}
    with pytest.raises(PySparkException):
        tables.total_column(df.withColumn("v", F.lit("x")), ["k"], "v").collect()
    assert {r["category"]: (r["class"], r["n"]) for r in tables.category_classes(df, "k", ["i"]).collect()} == {"b": (0, 2), "a": (1, 3)}


def test_conditional_odds_of_one_table_and_of_strata(spark):
    tea = measures.conditional_odds([(3, 1, 1, 3, 1)])
    weights = lambda t: [1, 16 * t, 36 * t**2, 16 * t**3, t**4]
    assert tea["odds_ratio"] == pytest.approx(6.4083, abs=1e-4)
    assert sum(weights(tea["upper"])[:4]) / sum(weights(tea["upper"])) == pytest.approx(0.025) and sum(weights(tea["lower"])[3:]) / sum(weights(tea["lower"])) == pytest.approx(0.025)
    strata = [(2, 5, 1, 7, 1), (3, 2, 4, 9, 2), (0, 3, 2, 4, 1), (1, 1, 1, 1, 3), (0, 0, 4, 5, 1)]

    def sums(theta):  # every combination of tables with these margins
        out = {0: 1.0}
        for a, b, c, d, alike in strata:
            for _ in range(alike):
                r, k, n = a + b, a + c, a + b + c + d
                w = {x: math.comb(r, x) * math.comb(n - r, k - x) * theta**x for x in range(max(0, r + k - n), min(r, k) + 1)}
                out2 = {}
                for s, p in out.items():
                    for x, q in w.items():
                        out2[s + x] = out2.get(s + x, 0.0) + p * q
                out = out2
        total = sum(out.values())
        return {s: p / total for s, p in out.items()}

    seen, got = sum(t[0] * t[4] for t in strata), measures.conditional_odds(strata)
    at = sums(got["odds_ratio"])
    assert sum(s * p for s, p in at.items()) == pytest.approx(seen)
    assert sum(p for s, p in sums(got["lower"]).items() if s >= seen) == pytest.approx(0.025) and sum(p for s, p in sums(got["upper"]).items() if s <= seen) == pytest.approx(0.025)
    mid = lambda theta, larger: sum(p * (0.5 if s == seen else 1) for s, p in sums(theta).items() if s == seen or (s > seen) == larger)
    assert mid(got["mid_lower"], True) == pytest.approx(0.025) and mid(got["mid_upper"], False) == pytest.approx(0.025)
    assert got["p_exact"] == pytest.approx(min(1, 2 * min(sum(p for s, p in sums(1).items() if s <= seen), sum(p for s, p in sums(1).items() if s >= seen))))
    large = measures.conditional_odds([(40_000_000, 60_000_000, 30_000_000, 70_000_000, 1)])
    assert large["odds_ratio"] == pytest.approx(4 / 6 * 7 / 3, rel=1e-6) and large["lower"] < large["mid_lower"] < large["odds_ratio"] < large["mid_upper"] < large["upper"]
    ends = measures.conditional_odds([(0, 4, 3, 2, 1)])
    assert ends["odds_ratio"] == 0 and ends["lower"] == 0 and 0 < ends["upper"] < 3 and measures.conditional_odds([(0, 0, 4, 5, 1)])["odds_ratio"] is None
    rows = [(g, s, e, c) for g in "xy" for s, (a, b, c_, d) in enumerate([(2, 5, 1, 7), (3, 2, 4, 9)]) for e, c, n in ((True, True, a), (True, False, b), (False, True, c_), (False, False, d)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, s int, e boolean, c boolean")
    by = {r["g"]: r for r in measures.exact_odds_ratio(df, F.col("e"), F.col("c"), ["s"], ["g"]).collect()}
    want = measures.conditional_odds([(2, 5, 1, 7, 1), (3, 2, 4, 9, 1)])
    assert by["x"]["n_strata"] == 2 and by["x"]["odds_ratio"] == pytest.approx(want["odds_ratio"]) == by["y"]["odds_ratio"] and by["y"]["upper"] == pytest.approx(want["upper"])
    assert measures.exact_odds_ratio(df.limit(0), F.col("e"), F.col("c"), ["s"]).count() == 0


def test_rules_that_read_their_own_last_conclusion(spark):
    import random

    rng = random.Random(5)
    rows = [(i, None if g == "none" else g, None if rng.random() < 0.05 else rng.randrange(60), rng.choice([None, *range(10)])) for i, g in enumerate(["long"] * 400 + ["b"] * 9 + ["none"] * 5 + ["c"])]
    df = spark.createDataFrame(rows, "id long, g string, t int, v int").repartition(7)
    conclude = lambda before: F.when(F.col("v").isNull(), None).when((F.col("v") > 6) | ((before == "on") & (F.col("v") > 2)), "on").when(before.isNull() & (F.col("v") < 1), None).otherwise("off")

    def plain(v, before):
        return None if v is None else "on" if v > 6 or (before == "on" and v > 2) else None if before is None and v < 1 else "off"

    want, last = {}, {}
    for i, g, _, v in sorted(rows, key=lambda r: (r[1] or "", (r[2] is not None, r[2]), r[0])):
        want[i] = last[g] = plain(v, last.get(g, "off"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["conclusion"] for r in rules.recursive(df, ["g"], "t", ["on", "off"], conclude, "id", "off").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rules.recursive(df.limit(0), ["g"], "t", ["on", "off"], conclude, "id").count() == 0
    with pytest.raises(PySparkException, match="none of the states"):
        rules.recursive(df, ["g"], "t", ["on"], conclude, "id").collect()
    with pytest.raises(Refusal):
        rules.recursive(df, ["g"], "t", ["on", "on"], conclude, "id")


def test_mean_centres_hulls_hexagons_and_masks(spark):
    square = [(i, 3.0 + x, 50.0 + y, w, "s") for i, (x, y, w) in enumerate([(-0.01, -0.01, 1.0), (0.01, -0.01, 1.0), (0.01, 0.01, 1.0), (-0.01, 0.01, 1.0), (0.0, 0.0, 4.0)])]
    far = [(10, 9.0, 10.0, 1.0, "t"), (11, 9.2, 10.0, 3.0, "t"), (12, None, 10.0, 9.0, "t"), (13, 9.1, 10.0, 0.0, "t"), (14, 9.1, 10.0, None, "t")]
    p = spark.createDataFrame(square + far, "id long, lon double, lat double, weight double, g string")
    got = {r["g"]: r for r in geo.mean_center(p, F.col("weight"), by=["g"]).collect()}
    assert (got["s"]["lon"], got["s"]["lat"], got["s"]["n"]) == (pytest.approx(3.0, abs=1e-5), pytest.approx(50.0, abs=1e-5), 5)
    assert got["t"]["lon"] == pytest.approx(9.15, abs=1e-5) and got["t"]["n"] == 2
    assert one(geo.mean_center(p.where("g = 's'")))["lon"] == pytest.approx(3.0, abs=1e-6)
    hull = geo.convex_hull(p, "g").where("g = 's'").orderBy("corner").collect()
    assert [(round(r["lon"], 6), round(r["lat"], 6)) for r in hull] == [(2.99, 49.99), (3.01, 49.99), (3.01, 50.01), (2.99, 50.01)]
    grid = geo.hexagons(p.where("g = 's'").unionByName(p.where("id in (0, 1)")), 500.0)
    cells = grid.df.collect()
    assert sorted(r["n"] for r in cells) == [2, 2] and one(grid.report["withheld"]) == (3, 3)
    moved = geo.compare_points(p.where("id < 5"), geo.donut_mask(p.where("id < 5"), 100, 1000, 7))
    assert one(moved)["n"] == 5 and 100 <= one(moved)["mean_m"] and one(moved)["max_m"] <= 1000.001


def test_nearest_looks_up_a_place_once(spark):
    """Copies at one place are one search, dense candidates shorten the first edge, and the ties stay with the smaller id."""
    at = lambda k: (float(k * 37 % 360 - 180), float(k * 53 % 120 - 60))
    p = spark.createDataFrame([(k, *at(k)) for k in range(900)], "id int, lon double, lat double")
    c = spark.createDataFrame([(k + 5000, *at(7 * k)) for k in range(4000)], "id int, lon double, lat double")
    places = {}
    for k in range(4000):
        places.setdefault(at(7 * k), k + 5000)
    near = {}
    for x, y in {at(k) for k in range(900)}:
        far = lambda q: math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(*[(math.cos(math.radians(v)) * math.cos(math.radians(u)), math.cos(math.radians(v)) * math.sin(math.radians(u)), math.sin(math.radians(v))) for u, v in ((x, y), q)], strict=True)))))  # noqa: B023, E731
        near[x, y] = min(round(far(q) * 6371.0088, 3) for q in places)
    got = geo.nearest(p, c, first_km=4000).collect()
    assert len(got) == 900 and all(round(r["distance_km"], 3) == pytest.approx(near[at(r["id"])], abs=0.01) for r in got)
    assert all(r["nearest_id"] == places[at(r["id"])] for r in got if r["distance_km"] == 0)
    known = spark.range(4096).selectExpr("id % 64 / 1000D x", "floor(id / 64) / 1000D y", "0D z")
    assert geo._first_edge(known, 1.0) == 1 / 4**4 and geo._first_edge(known.limit(50), 1.0) == 1.0 and geo._first_edge(known.limit(0), 1.0) == 1.0


def test_sites_of_points_that_share_a_place(spark):
    p = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.0, 50.0), (3, 30.0, 0.0), (4, None, 0.0)], "id int, lon double, lat double")
    sites = spark.createDataFrame([(9, 10.0, 50.1), (8, 10.0, 50.1), (7, 10.0, 50.0), (6, 30.0, 1.0)], "site_id int, lon double, lat double")
    got = {r["id"]: (r["site_id"], r["reason"]) for r in geo.assign_sites(p, sites, spark.createDataFrame([(9,), (8,), (6,)], "site_id int")).collect()}
    assert got == {1: (8, None), 2: (8, None), 3: (6, None), 4: (None, "location missing")}
    assert [r["reason"] for r in geo.assign_sites(p.limit(2), sites, spark.createDataFrame([], "site_id int")).collect()] == ["no candidate"] * 2


def test_snapped_copies(spark):
    """Twenty thousand points and as many nodes at two places: 400 million pairs, were copies compared."""
    p = spark.range(20_000).selectExpr("id", "id % 2 * 90D lon", "0D lat")
    n = spark.range(20_000).selectExpr("id + 100 id", "id % 2 * 90D + 0.1D lon", "0D lat")
    got = geo.snap(p, n).groupBy(F.col("id") % 2, "node").count().collect()
    assert sorted(map(tuple, got)) == [(0, 100, 10_000), (1, 101, 10_000)]


SQUARES = "SELECT name, array(array(struct(a AS x, a AS y), struct(a + 10D AS x, a AS y), struct(a + 10D AS x, a + 10D AS y), struct(a AS x, a + 10D AS y), struct(a AS x, a AS y))) AS geometry FROM VALUES ('q', 0D), ('r', 5D), ('none', 50D) AS t(name, a)"


def test_points_at_one_place_are_summed_first(spark):
    """A point counts once though its id repeats, and where it has none."""
    rows = [(1, 6.0, 6.0, 2.0), (1, 2.0, 2.0, 1.0), (2, 6.0, 6.0, 3.0), (None, 6.0, 6.0, 4.0), (3, 12.0, 12.0, None), (4, 40.0, 0.0, 9.0), (5, None, 1.0, 9.0)]
    p = spark.createDataFrame(rows, "id int, lon double, lat double, v double")
    got = {r["name"]: (r["n"], r["total"]) for r in geo.summarize_points(p, spark.sql(SQUARES), F.col("v")).collect()}
    assert got == {"q": (4, 10.0), "r": (4, None), "none": (0, 0.0)}


def test_clipped_points_by_place(spark):
    p = spark.createDataFrame([(1, 6.0, 6.0), (1, 40.0, 0.0), (None, 2.0, 2.0), (2, 0.0, 5.0), (3, None, None)], "id int, lon double, lat double")
    inside = geo.clip_points(p, spark.sql(SQUARES), boundary=False)
    assert inside.columns == ["id", "lon", "lat"] and {tuple(r) for r in inside.collect()} == {(1, 6.0, 6.0), (None, 2.0, 2.0)}
    assert geo.clip_points(p, spark.sql(SQUARES)).count() == 3


def test_grid_points_are_made_in_many_tasks(spark):
    one_task = spark.sql(SQUARES).coalesce(1)
    grid = geo.point_grid(one_task, 2.5)
    assert grid.rdd.getNumPartitions() > 1 and {r["name"]: r["count"] for r in grid.groupBy("name").count().collect()} == {"q": 25, "r": 25, "none": 25}


def test_copies_of_a_point_are_one_record(spark):
    """Six thousand copies at one place: 18 million pairs, were they compared; a pair for review is still given for all copies."""
    p = spark.range(1, 6001).selectExpr("id", "'North Clinic' name", "10D lon", "50D lat").unionByName(spark.createDataFrame([(9001, "north clinic.", 10.0001, 50.0), (9002, "North Clonix", 10.0, 50.0)], "id long, name string, lon double, lat double"))
    out = dedup.dedup_points(p, 50.0, accept=0.99)
    assert {(r["class_id"], r["count"]) for r in out.df.groupBy("class_id").count().collect()} == {(1, 6001), (9002, 1)}
    assert out.report["review"].count() == 6001


def test_days_are_dealt_by_counts(spark, monkeypatch):
    """Each shuffle keeps the cases of places and of days, over several chunks as in one, and cells differ about what is expected."""
    import numpy as np

    cells = spark.range(60).selectExpr("id % 12 * 7 - 20 place", "date_add(DATE'2024-01-01', cast(id / 12 as int)) day", "id % 7 * 50 + id % 12 + 1 cases")
    sums = lambda df, key: {(r["rep"], r[key]): r["n"] for r in df.groupBy("rep", key).agg(F.sum("cases").alias("n")).collect()}
    real = cells.withColumn("rep", F.lit(0))
    for chunk in (1024, 5):
        monkeypatch.setattr(scan, "CHUNK", chunk)
        drawn = scan._redealt(cells, 40, 3).cache()
        for key in ("place", "day"):
            want, got = sums(real, key), sums(drawn, key)
            assert len(got) == 40 * len(want) and all(n == want[0, k] for (_, k), n in got.items())
        n = sum(sums(real, "day").values())
        mean = drawn.groupBy("place", "day").agg((F.sum("cases") / 40).alias("m")).collect()
        for r in mean:
            e = sums(real, "place")[0, r["place"]] * sums(real, "day")[0, r["day"]] / n
            assert abs(r["m"] - e) < 5 * (e / 40) ** 0.5
        assert drawn.groupBy("place", "day").agg(F.count_distinct("cases").alias("k")).agg(F.min("k")).first()[0] > 5
    few = scan._margins(np.random.default_rng(1), np.array([1, 2, 0]), np.array([2, 0, 1, 0]))
    assert few.sum(axis=1).tolist() == [1, 2, 0] and few.sum(axis=0).tolist() == [2, 0, 1, 0]


def test_many_cases_of_few_places_are_scanned(spark):
    """Four hundred thousand cases: 40 million rows to sort, were cases shuffled one by one."""
    df = spark.range(400_000).selectExpr("id", "id % 5 * 0.2D lat", "0D lon", "date_add(DATE'2024-01-01', cast(id % 11 as int)) date").unionByName(spark.range(3000).selectExpr("id + 1000000 id", "0.2D lat", "0D lon", "DATE'2024-01-04' date"))
    top = scan.space_time_scan(df, 5.0, 2, replications=99).df.orderBy(F.desc("llr")).first()
    assert top["lat"] == pytest.approx(0.2) and str(top["start"]) == str(top["end"]) == "2024-01-04" and top["p"] == pytest.approx(0.01)
