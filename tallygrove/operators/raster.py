"""Rasters as rows (row, col, value), a null value where there is no data; the grid by its origin and cell size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.geo import _edges, area_m2
from tallygrove.report import Refusal, stored


@dataclass(frozen=True)
class Grid:
    """West and north edge, the size of a cell (its height too, unless ``size_y`` says otherwise), and how many rows and columns are known of."""

    west: float
    north: float
    size: float
    size_y: float | None = None
    rows: int | None = None
    cols: int | None = None

    @property
    def dy(self) -> float:
        return self.size if self.size_y is None else self.size_y

    def centre(self, col, row):
        return self.west + (col + 0.5) * self.size, self.north - (row + 0.5) * self.dy


def sample(points: DataFrame, raster: DataFrame, grid: Grid, id_: str = "id") -> DataFrame:
    """id, value, reason: the cell that holds each point, by a computed key."""
    p = points.select(F.col(id_).alias("id"), F.floor((F.col("lon") - grid.west) / grid.size).alias("col"), F.floor((grid.north - F.col("lat")) / grid.dy).alias("row"))
    r = raster.select("row", "col", "value", F.lit(True).alias("_hit"))
    joined = p.join(r, ["row", "col"], "left")
    return joined.select("id", "value", F.when(F.col("col").isNull() | F.col("row").isNull(), "location missing").when(F.col("_hit").isNull(), "outside").when(F.col("value").isNull(), "no data").alias("reason"))


def sample_bilinear(points: DataFrame, raster: DataFrame, grid: Grid, id_: str = "id") -> DataFrame:
    """id, value: weighted by the four nearest cell centres; null if one has no value."""
    p = points.where("lon is not null and lat is not null").select(F.col(id_).alias("id"), ((F.col("lon") - grid.west) / grid.size - 0.5).alias("fx"), ((grid.north - F.col("lat")) / grid.dy - 0.5).alias("fy"))
    four = p.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    weight = lambda f, s: F.when(s == 1, f - F.floor(f)).otherwise(1 - (f - F.floor(f)))
    four = four.select("id", (F.floor("fx") + F.col("s.i")).alias("col"), (F.floor("fy") + F.col("s.j")).alias("row"), (weight(F.col("fx"), F.col("s.i")) * weight(F.col("fy"), F.col("s.j"))).alias("w")).where("w > 0")
    joined = four.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return joined.groupBy("id").agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("value") * F.col("w"))).alias("value"))


def runs(polygons: DataFrame, grid: Grid, name: str = "name", polygon: str = "geometry", touched: bool = False) -> DataFrame:
    """name, row, first, last: runs of the cells whose centre is in or on a polygon, or, with ``touched``, that it touches at all.

    An edge crosses the centre lines of some rows; the crossings of a row, in order, are where runs begin and end (even-odd over
    all rings of a name). Only numbers go on from here, no geometry.
    """
    rings = F.transform(F.col(polygon), lambda ring: F.transform(ring, lambda p: F.struct(((p.x - grid.west) / grid.size).alias("x"), ((grid.north - p.y) / grid.dy).alias("y"))))
    edges = polygons.select(F.col(name).alias("name"), F.explode(F.flatten(F.transform(rings, _edges))).alias("e")).select("name", "e.*")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    crossed = edges.where(F.ceil(high - 0.5) > F.ceil(low - 0.5)).select("name", "x1", "y1", slope.alias("slope"), F.explode(F.sequence(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1)).alias("row"))
    at = crossed.select("name", "row", (F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * F.col("slope")).alias("x")).groupBy("name", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.col("xs")[2 * i] - 0.5).alias("first"), F.floor(F.col("xs")[2 * i + 1] - 0.5).alias("last")))
    inner = at.where(F.size("xs") > 1).select("name", "row", F.explode(pair).alias("run")).select("name", "row", "run.first", "run.last").where("last >= first")
    if touched:
        band = edges.select("name", "x1", "y1", "x2", "y2", slope.alias("slope"), F.explode(F.sequence(F.floor(low), F.greatest(F.floor(low), F.ceil(high) - 1))).alias("row"))
        reach = lambda y: F.col("x1") + (F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")) * F.col("slope")
        a, b = F.coalesce(reach(F.col("row").cast("double")), F.col("x1")), F.coalesce(reach(F.col("row") + 1.0), F.col("x2"))
        inner = inner.unionByName(band.select("name", "row", F.floor(F.least(a, b)).alias("first"), F.floor(F.greatest(a, b)).alias("last")))
    # runs that overlap or follow each other become one
    row = Window.partitionBy("name", "row").orderBy("first", "last")
    new = F.col("first") > F.coalesce(F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.col("first") - 2) + 1
    nth = inner.withColumn("new", new.cast("int")).withColumn("nth", F.sum("new").over(row))
    return nth.groupBy("name", "row", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("nth")


STRETCH = 256  # columns of a row that a run and its cells meet in


def _met(raster: DataFrame, inside: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Cells in the runs, by row and stretch of columns."""
    blocks = inside.withColumn("_s", F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH)))).withColumnRenamed("row", "_row")
    cells = raster.select(*columns, F.floor(F.col("col") / STRETCH).alias("_c"))
    return cells.join(blocks, (F.col("row") == F.col("_row")) & (F.col("_c") == F.col("_s")) & (F.col("col") >= F.col("first")) & (F.col("col") <= F.col("last")), how)


BINS = 1024  # of one pass of a median


def exact_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, median of the known values of each group, without holding a group's values: passes count bins around the middle ranks.

    Every pass sends at most ``BINS`` counts a group and rank, and leaves the bin that holds the rank, until it holds one value."""
    v = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = v.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
    wanted = stored(sizes.select("by", "low", "high", rank.alias("rank")).withColumn("left", F.col("rank")), "ranks")
    found = None
    while True:
        done = wanted.where("low = high").select("by", F.col("low").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_ = wanted.where("low < high")
        if open_.isEmpty():
            break
        held = v.join(open_.withColumnRenamed("by", "_by"), F.col("by").eqNullSafe(F.col("_by")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        bins = held.groupBy("by", "rank", "left", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("by", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = stored(bins.withColumn("before", before).where("before <= left AND left < before + n").select("by", "low", "high", "rank", (F.col("left") - F.col("before")).alias("left")), "ranks")
    return found.groupBy("by").agg(F.avg("v").alias("median")).withColumnRenamed("by", by)


def zonal(raster: DataFrame, polygons: DataFrame, grid: Grid, name: str = "name", polygon: str = "geometry", touched: bool = False) -> DataFrame:
    """name, cells, no_data, outside, total, mean, median, low, high, deviation, populated, share, density of the cells in each polygon.

    ``cells`` have a value and make the figures; cells without data, and cells of the polygon that the raster has not, are counted
    apart and add nothing; a polygon without a value has nulls. ``density`` is the total by square kilometre on the sphere.
    """
    inside = stored(runs(polygons, grid, name, polygon, touched), "runs")
    met = stored(_met(raster, inside, ["row", "col", "value"]).select("name", F.when(~F.isnan("value"), F.col("value")).alias("v")), "met")
    v = F.col("v")
    sums = met.groupBy("name").agg(F.count(v).alias("cells"), F.count_if(v.isNull()).alias("no_data"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("deviation"), F.count_if(v > 0).alias("populated"))
    planned = inside.groupBy("name").agg(F.sum(F.col("last") - F.col("first") + 1).alias("planned"))
    size = polygons.groupBy(F.col(name).alias("name")).agg((F.sum(area_m2(F.col(polygon))) / 1e6).alias("km2"))
    out = size.join(planned, "name", "left").join(sums, "name", "left").join(exact_median(met, "name", "v"), "name", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("cells", "no_data", "planned", "populated")}
    return out.select(
        "name", n["cells"].alias("cells"), n["no_data"].alias("no_data"), (n["planned"] - n["cells"] - n["no_data"]).alias("outside"), "total", "mean", "median", "low", "high", "deviation",
        n["populated"].alias("populated"), F.when(F.col("cells") > 0, F.col("populated") / F.col("cells")).alias("share"), F.when((F.col("cells") > 0) & (F.col("km2") > 0), F.col("total") / F.col("km2")).alias("density"),
    )


def reduce_blocks(raster: DataFrame, k: int, how: str = "mean") -> DataFrame:
    """Blocks of k by k cells as one: the sum or mean of the cells that have a value; none, if no cell has."""
    if k < 2 or how not in ("sum", "mean"):
        raise Refusal("blocks are 2 cells wide at least, and summed or averaged")
    f = F.sum if how == "sum" else F.avg
    return raster.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(f("value").alias("value"))


def clip(raster: DataFrame, polygons: DataFrame, grid: Grid, polygon: str = "geometry", touched: bool = False) -> DataFrame:
    """The cells whose centre lies in a polygon (``touched``: that a polygon touches)."""
    named = polygons.select(F.monotonically_increasing_id().alias("name"), F.col(polygon).alias("geometry"))
    inside = runs(named, grid, touched=touched)
    return _met(raster, inside, ["row", "col", "value"], "left_semi").select("row", "col", "value")


def good_quality(cells: DataFrame, quality: str, bits: dict[int, int], value: str = "value") -> DataFrame:
    """cells whose value is unknown where a bit of the quality number isn't as asked (bit: 0 or 1) or the number is missing."""
    fits = F.col(quality).isNotNull()
    for bit, wanted in bits.items():
        fits &= F.getbit(F.col(quality).cast("long"), F.lit(bit)) == wanted
    return cells.withColumn(value, F.when(F.coalesce(fits, F.lit(False)), F.col(value)))


def pooled_classes(rasters: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """raster, row, col, value, class: classes by the quantiles of all rasters together, so that equal colours mean equal values."""
    from tallygrove.operators.tables import value_classes

    every = None
    for name, cells in rasters.items():
        some = cells.select(F.lit(name).alias("raster"), "row", "col", "value")
        every = some if every is None else every.unionByName(some)
    return value_classes(every, "value", k)
