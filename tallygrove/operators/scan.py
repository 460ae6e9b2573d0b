"""Space-time permutation scan: cylinders (a circle of places, a run of days) with more cases than chance explains.

Cases are first counted by place and day. Circles grow around every place over its neighbours within ``radius_km`` by a grid
join; inside a circle, cases are cumulated over distance and time by windows, so every cylinder is one row of an aggregation.
Chance is measured by shuffling the days among the cases; replications are rows of one job, each with its own seed. Cases of one place
and day are alike, so only counts are drawn: places keep their cases and days theirs, and the work doesn't grow with the cases of a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.values import EARTH_KM, haversine_km
from tallygrove.operators.overlay import tasks
from tallygrove.report import OpResult, Refusal, stored


def llr(c: Column, e: Column, n: Column) -> Column:
    """Log likelihood ratio of c cases where e are expected, of n in all; 0 unless there are more than expected."""
    return F.when((c > e) & (e > 0) & (e < n), c * F.log(c / e) + F.when(n > c, (n - c) * F.log((n - c) / (n - e))).otherwise(0.0)).otherwise(0.0)


def _circles(places: DataFrame, radius_km: float) -> DataFrame:
    """centre, place, km: places within the radius, met in cells of a grid of unit vectors."""
    s = radius_km / EARTH_KM * 1.0000001
    rad = lambda c: F.radians(F.col(c))
    p = places.select("place", "lat", "lon", *[F.floor(v / s).cast("long").alias(n) for n, v in (("x", F.cos(rad("lat")) * F.cos(rad("lon"))), ("y", F.cos(rad("lat")) * F.sin(rad("lon"))), ("z", F.sin(rad("lat"))))])
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    c = p.withColumn("_s", F.explode(shifts)).select(F.col("place").alias("centre"), F.col("lat").alias("lat_c"), F.col("lon").alias("lon_c"), *[(F.col(n) + F.col(f"_s.{m}")).alias(n) for n, m in zip("xyz", "ijk", strict=True)])
    near = c.join(p, ["x", "y", "z"]).withColumn("km", F.round(haversine_km(F.col("lat_c"), F.col("lon_c"), F.col("lat"), F.col("lon")), 4))  # ties within 10 cm
    return near.where(F.col("km") <= radius_km).select("centre", "place", "km")


def _cylinders(cells: DataFrame, circles: DataFrame, by: list[str], days: int, share: float) -> DataFrame:
    """by, centre, km, day, run, cases, expected, n: cylinders that end on a day with a case, for runs of 1 to ``days`` days."""
    total = cells.groupBy(*by).agg(F.sum("cases").alias("n"))
    of_place = cells.groupBy(*by, "place").agg(F.sum("cases").alias("in_place"))
    of_day = cells.groupBy(*by, "day").agg(F.sum("cases").alias("in_day"))
    # population of each circle by its radius
    rings = circles.join(of_place, "place").groupBy(*by, "centre", "km").agg(F.sum("in_place").alias("ring"))
    size = F.sum("ring").over(Window.partitionBy(*by, "centre").orderBy("km"))
    rings = rings.withColumn("people", size).join(total, by).where(F.col("people") <= share * F.col("n"))
    # cases of each circle by radius, end day and length of the run
    runs = cells.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).select(*by, "place", F.date_add("day", F.col("back")).alias("end"), F.col("back"), "cases")
    per = circles.join(runs, "place").groupBy(*by, "centre", "km", "end", "back").agg(F.sum("cases").alias("cases"))
    # cumulate over the length of the run, then over the radius: a row for each radius at which the circle grows
    per = per.groupBy(*by, "centre", "km", "end").agg(F.collect_list(F.struct("back", "cases")).alias("x"))
    per = per.select(*by, "centre", "km", "end", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda r: F.struct(r.alias("run"), F.aggregate(F.filter("x", lambda y: y.back < r), F.lit(0).cast("long"), lambda s, y: s + y.cases).alias("cases")))).alias("y"))
    grown = per.select(*by, "centre", "km", "end", F.col("y.run").alias("run"), F.sum("y.cases").over(Window.partitionBy(*by, "centre", "end", "y.run").orderBy("km")).alias("cases"))
    ends = of_day.select(*by, F.col("day").alias("end"))
    window = of_day.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("end", F.date_add("day", F.col("back"))).groupBy(*by, "end", "back").agg(F.sum("in_day").alias("c"))
    lengths = window.select(*by, "end", F.explode(F.sequence(F.col("back") + 1, F.lit(days))).alias("run"), "c").groupBy(*by, "end", "run").agg(F.sum("c").alias("in_run"))
    joined = grown.where("cases > 1").join(ends, [*by, "end"]).join(rings.select(*by, "centre", "km", "people", "n"), [*by, "centre", "km"]).join(lengths, [*by, "end", "run"])
    return joined.withColumn("expected", F.col("people") * F.col("in_run") / F.col("n"))


def _nth(rows: DataFrame, key: Column) -> DataFrame:
    """rows and nth: their place by key within each rep, counted in range partitions with the rows of those before added."""
    dealt = rows.withColumn("key", key).repartitionByRange("rep", "key", "id").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "shuffle")
    before = dealt.groupBy("rep", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("rep", "part", (F.sum("n").over(Window.partitionBy("rep").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("rep", "part").orderBy("key", "id"))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), ["rep", "part"]).withColumn("nth", F.col("inside") + F.col("before")).drop("key", "part", "inside", "before")


CHUNK = 1024  # places that are dealt their days in one task
MOST_COUNTED = 10**9  # cases that numpy draws among; more are shuffled one by one


def _margins(rng: np.random.Generator, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A table with such sums of rows and columns, drawn as if single cases were shuffled."""
    if sizes.sum() <= len(sizes) * len(counts):
        who, what = np.repeat(np.arange(len(sizes)), sizes), rng.permutation(np.repeat(np.arange(len(counts)), counts))
        return np.bincount(who * len(counts) + what, minlength=len(sizes) * len(counts)).reshape(len(sizes), len(counts))
    out, left = np.zeros((len(sizes), len(counts)), np.int64), counts.copy()
    for row, size in zip(out, sizes, strict=True):
        row[:] = rng.multivariate_hypergeometric(left, size, method="marginals")
        left -= row
    return out


def _redealt(cells: DataFrame, replications: int, seed: int) -> DataFrame:
    """place, day, cases, rep: the days of all cases dealt anew to the places, first to chunks of places, then within each chunk."""
    spark = cells.sparkSession
    of_place = stored(cells.groupBy("place").agg(F.sum("cases").alias("n")), "places")
    chunks = max(1, -(-of_place.count() // CHUNK))
    parts = of_place.groupBy(F.pmod("place", F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("x"))
    parts = stored(parts.select("chunk", F.col("x.place").alias("places"), F.col("x.n").alias("sizes")), "chunks")
    of_day = cells.groupBy(F.unix_date("day").alias("day")).agg(F.sum("cases").alias("n")).agg(F.sort_array(F.collect_list(F.struct("day", "n"))).alias("d")).select(F.col("d.day").alias("days"), F.col("d.n").alias("of_days"))
    of_chunk = parts.select("chunk", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).agg(F.sort_array(F.collect_list(F.struct("chunk", "n"))).alias("c")).select(F.col("c.chunk").alias("chunks"), F.col("c.n").alias("of_chunks"))
    reps = spark.range(1, replications + 1, 1, min(replications, tasks(cells))).withColumnRenamed("id", "rep")

    def to_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                table = _margins(np.random.default_rng([seed, x.rep]), np.array(x.of_chunks), np.array(x.of_days))
                yield pd.DataFrame({"rep": x.rep, "chunk": x.chunks, "days": [x.days] * len(table), "counts": list(table)})

    def to_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                table = _margins(np.random.default_rng([seed, x.rep, x.chunk + 1]), np.array(x.sizes), np.array(x.counts))
                i, j = np.nonzero(table)
                yield pd.DataFrame({"place": np.array(x.places)[i], "day": np.array(x.days)[j], "cases": table[i, j], "rep": x.rep})

    both = reps.crossJoin(F.broadcast(of_chunk)).crossJoin(F.broadcast(of_day))  # one row of sums, a number for a day and for a chunk
    dealt = both.mapInPandas(to_chunks, "rep long, chunk long, days array<int>, counts array<long>").join(parts, "chunk")
    drawn = dealt.repartition(tasks(cells), "rep", "chunk").mapInPandas(to_places, "place long, day int, cases long, rep int")
    return drawn.withColumn("day", F.date_from_unix_date("day"))


def _picked(real: DataFrame, circles: DataFrame, most: int) -> DataFrame:
    """The strongest cylinder, then the strongest that shares no place with a picked one, until there are ``most``."""
    spark, picks = real.sparkSession, []
    live = real
    while len(picks) < most:
        best = live.orderBy(F.desc("llr"), F.desc("cases"), F.date_sub("end", F.col("run") - 1), "centre", "km").limit(1).collect()
        if not best:
            break
        picks += best  # one row a cluster
        chosen = F.broadcast(spark.createDataFrame([(b["centre"], b["km"]) for b in picks], "centre long, most_km double"))
        used = circles.join(chosen, "centre").where("km <= most_km").select("place").distinct()
        bounds = circles.join(used, "place").groupBy("centre").agg(F.min("km").alias("bound"))  # a circle that reaches so far overlaps
        live = real.join(bounds, "centre", "left").where("bound is null or km < bound").select(real.columns)
    return spark.createDataFrame(picks, real.schema)


def space_time_scan(cases: DataFrame, radius_km: float, days: int, replications: int = 99, share: float = 0.5, seed: int = 1, id_: str = "id", date: str = "date", most: int = 10) -> OpResult:
    """Cylinders by llr with centre, km, start, end, cases, expected, llr, p. Reports: ``undated`` records.

    At most ``most`` clusters: of all circles, each with its best run of days, those that share no place with a stronger one reported.
    """
    if not 0 < share <= 0.5:
        raise Refusal("a circle holds half of the cases at most")
    rows = cases.select(F.col(id_).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(date).cast("date").alias("day"))
    known = rows.where("lat is not null and lon is not null and day is not null")
    known = stored(known.withColumn("place", F.xxhash64("lat", "lon")), "cases")
    circles = stored(_circles(known.select("place", "lat", "lon").distinct(), radius_km), "circles")
    cells = stored(known.groupBy("place", "day").agg(F.count(F.lit(1)).alias("cases")), "cells")
    if (cells.agg(F.sum("cases")).first()[0] or 0) < MOST_COUNTED:
        shuffled = _redealt(cells, replications, seed)
    else:
        spread = known.select("id", "place", "day", F.explode(F.sequence(F.lit(1), F.lit(replications))).alias("rep"))
        places = _nth(spread.select("rep", "id", "place"), F.xxhash64("id", "rep", F.lit(seed))).drop("id")
        drawn = _nth(spread.select("rep", "id", "day"), F.xxhash64("id", "rep", F.lit(seed + 1))).drop("id")
        shuffled = places.join(drawn, ["rep", "nth"]).groupBy("place", "day", "rep").agg(F.count(F.lit(1)).alias("cases"))
    cells = stored(cells.withColumn("rep", F.lit(0)).unionByName(shuffled), "cells")
    found = _cylinders(cells, circles, ["rep"], days, share).withColumn("llr", llr(F.col("cases"), F.col("expected"), F.col("n")))
    circle = F.when(F.col("rep") == 0, F.col("km")).alias("circle")  # of a shuffle only the top counts
    found = stored(found.groupBy("rep", "centre", circle).agg(F.max(F.struct("llr", -F.col("km"), -F.col("run"), "end", "cases", "expected", "km", "run")).alias("b")).select("rep", "centre", "b.llr", "b.end", "b.cases", "b.expected", "b.km", "b.run"), "cylinders")
    tops = found.where("rep > 0").groupBy("rep").agg(F.max("llr").alias("top"))
    ranked = _picked(found.where("rep = 0 and llr > 0").drop("rep"), circles, most)
    p = ranked.crossJoin(F.broadcast(tops.agg(F.sort_array(F.collect_list("top")).alias("tops"))))  # one number a replication
    p_value = (1 + F.size(F.filter("tops", lambda t: t >= F.col("llr")))) / (1 + F.lit(replications))
    known_places = known.select(F.col("place").alias("centre"), "lat", "lon").distinct()
    out = p.join(known_places, "centre").select("lat", "lon", "km", F.date_sub("end", F.col("run") - 1).alias("start"), "end", "cases", "expected", "llr", p_value.alias("p"))
    return OpResult(out, {"undated": rows.where("lat is null or lon is null or day is null").agg(F.count(F.lit(1)).alias("left_out"))})
