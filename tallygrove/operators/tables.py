"""Rows and columns of one table: selecting, grouping with unknown values, shares, shapes, profiles, classes, edits.

An empty cell is unknown. A group that holds one totals to null unless ``exclude_missing`` says to leave such rows out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.values import NUMBER, blank, day, folded, half_up, number
from tallygrove.report import OpResult, Refusal, stored, refuse_when

STATISTICS = ("sum", "min", "max", "count", "mean", "median")


def select_values(df: DataFrame, column: str, values: Sequence[str], ordered: bool = False) -> OpResult:
    """Rows whose key is one of the values; with ``ordered`` in the order that the values are named. Report: values absent."""
    if not values:
        raise Refusal("no value is named")
    kept = df.where(F.col(column).isin(*values))
    if ordered:
        kept = kept.orderBy(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)))
    named = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    present = kept.select(F.col(column).cast("string").alias("value")).distinct()
    return OpResult(kept, {"absent": named.join(present, "value", "left_anti")})


def leave_out(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose key is none of the values; an empty key stays."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def select_range(df: DataFrame, column: str, low: str | float | None = None, high: str | float | None = None, kind: str = "number") -> DataFrame:
    """Rows within both bounds, which are included; a missing bound is open; a blank or unreadable cell is outside."""
    if low is None and high is None:
        raise Refusal("a range needs a bound")
    if low is not None and high is not None and low > high:  # type: ignore[operator]
        raise Refusal("the range runs backwards")
    typed = dict(df.dtypes)[column]
    x = F.col(column) if typed not in ("string",) else (number(F.col(column)) if kind == "number" else day(F.col(column)))
    bound = lambda v: F.lit(v).cast("date") if kind == "date" else F.lit(v)
    condition = F.lit(True)
    if low is not None:
        condition &= x >= bound(low)
    if high is not None:
        condition &= x <= bound(high)
    return df.where(condition)


def statistic(value: Column, how: str, exclude_missing: bool = False) -> Column:
    """An aggregate under the rule of unknowns. ``count`` counts rows; the sum of no values is 0 once missing ones are excluded."""
    if how not in STATISTICS:
        raise Refusal(f"no such statistic: {how}")
    if how == "count":
        return F.count(F.lit(1))
    total = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[how](value)
    if exclude_missing:
        return F.coalesce(total, F.lit(0)) if how == "sum" else total
    return F.when(F.count_if(value.isNull()) == 0, total)


def group(df: DataFrame, by: Sequence[str], value: str | Column, how: str = "sum", name: str = "value", exclude_missing: bool = False) -> DataFrame:
    """One row a group: the named keys and the statistic."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*by).agg(statistic(v, how, exclude_missing).alias(name))


def shares(df: DataFrame, by: Sequence[str], within: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    """Groups with their total and its percentage of the stratum, to one decimal; unknown if anything in the stratum is, or if it totals 0."""
    totals = df.groupBy(*by).agg(statistic(value, "sum").alias(name))
    stratum = Window.partitionBy(*(within or [F.lit(0)]))
    whole = F.when(F.count_if(F.col(name).isNull()).over(stratum) == 0, F.sum(name).over(stratum))
    return totals.withColumn("share", F.when(whole != 0, half_up(F.col(name) / whole * 100, 1)))


def crosstab(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """row_key, column_key, total: cells and all totals (a null key: over all). A total over a missing or unknown cell is unknown."""
    cells = df.groupBy(F.col(row).alias("row_key"), F.col(column).alias("column_key")).agg(statistic(value, "sum").alias("cell"))
    size = cells.agg(F.count_distinct("row_key").alias("n_rows"), F.count_distinct("column_key").alias("n_columns"))
    cube = cells.cube("row_key", "column_key").agg(F.sum("cell").alias("total"), F.count("cell").alias("known"), F.grouping("row_key").alias("over_rows"), F.grouping("column_key").alias("over_columns"))
    wanted = F.when(F.col("over_rows") == 1, F.col("n_rows")).otherwise(1) * F.when(F.col("over_columns") == 1, F.col("n_columns")).otherwise(1)
    return cube.crossJoin(F.broadcast(size)).select("row_key", "column_key", F.when(F.col("known") == wanted, F.col("total")).alias("total"))  # one row is sent


def melt(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], measure: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long: the named columns become rows under their new names."""
    named = df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in columns.items()])
    return named.unpivot(list(keys), list(columns.values()), measure, value)


def pivot_long(df: DataFrame, keys: Sequence[str], measure: str, value: str, measures: Sequence[str]) -> DataFrame:
    """Long to wide for named measures; a second value of one cell is refused."""
    cell = lambda m: F.when(F.col(measure) == m, F.col(value))
    one = lambda m: refuse_when(F.count_if(F.col(measure) == m) > 1, f"{m} has several values for one record", F.max(cell(m)))
    return df.groupBy(*keys).agg(*[one(m).alias(m) for m in measures])


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value: the distinct nonblank values of each column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.where(~blank(F.col("value"))).distinct()


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def append(tables: Mapping[str, DataFrame], source: str | None = None, line_up: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Rows of all tables under each other by column name; ``line_up`` renames a table's columns first, ``source`` labels the rows."""
    if len(tables) < 2:
        raise Refusal("two tables at least are appended")
    out = None
    for label, df in tables.items():
        for old, new in (line_up or {}).get(label, {}).items():
            df = df.withColumnRenamed(old, new)
        df = df.withColumn(source, F.lit(label)) if source else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class KeyedTable:
    """A table as a workflow holds it: its key columns, the column of its value, the value's unit, and the keys that identify a row."""

    df: DataFrame
    keys: Sequence[str]
    value: str
    unit: str = ""
    primary: Sequence[str] = ()


#: Units that all count heads.
HEADS = ("individuals", "inhabitants", "people", "person", "persons")


def _unit(unit: str) -> str:
    u = unit.strip().lower()
    return "people" if u in HEADS else u


def line_up(tables: Mapping[str, KeyedTable]) -> list[tuple[str, str, str, int, int]]:
    """label, column, as, matched, of: a table's own name for a key column that more of the others hold, where at least half of its
    distinct values are values of that column there. Of two tables, or where as many hold it, the first table's name counts."""
    labels = list(tables)
    holders = lambda c: sum(c in t.keys for t in tables.values())
    options = []
    for i, label in enumerate(labels):
        own = list(tables[label].keys)
        for new in dict.fromkeys(c for t in tables.values() for c in t.keys if c not in own):
            fewer = [c for c in own if holders(c) < holders(new) or (holders(c) == holders(new) and i > 0 and new in tables[labels[0]].keys and c not in tables[labels[0]].keys)]
            options += [(label, c, new) for c in fewer]
    if not options:
        return []
    values = None
    for label, c in {(label, c) for label, c, _ in options} | {(other, new) for label, _, new in options for other in labels if new in tables[other].keys}:
        one = tables[label].df.select(F.lit(label).alias("label"), F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("v")).where("v <> ''").distinct()
        values = one if values is None else values.unionByName(one)
    values = stored(values, "values")
    asked = values.sparkSession.createDataFrame(options, "label string, column string, new string")
    theirs = values.select(F.col("column").alias("new"), "v", F.lit(1).alias("hit")).distinct()
    counts = values.join(F.broadcast(asked), ["label", "column"]).join(theirs, ["new", "v"], "left").groupBy("label", "column", "new").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("of"))
    told = {(r["label"], r["column"], r["new"]): (r["matched"], r["of"]) for r in counts.collect()}  # a row for each two columns
    out: list[tuple[str, str, str, int, int]] = []
    for label, new in dict.fromkeys((label, new) for label, _, new in options):
        fits = [(told[o][0], o[1], told[o][1]) for o in options if (o[0], o[2]) == (label, new) and o in told and told[o][0] * 2 >= told[o][1] > 0]
        if fits:
            matched, c, of = max(fits, key=lambda f: f[0])
            if not any(x[:2] == (label, c) for x in out):
                out.append((label, c, new, matched, of))
    return out


def append_tables(tables: Mapping[str, KeyedTable], source: str | None = None, new_key: str | None = None, under: Mapping[str, Mapping[str, str]] | None = None, numeric_labels: bool = False) -> OpResult:
    """Rows of all tables under each other: the new key, all key columns, the source and the value, unknown where a table has no such column.

    Values are to be of one name and one unit. ``under`` says which column of a table goes under which name; without it columns all of
    whose values are known under the others' name are lined up, and a column of which only half or more are is refused, as is any that
    ``under`` leaves. Reports: ``lined_up``, ``missing`` (label, column, rows), ``repeated`` (keys that no longer identify a row, where every table
    declares the same), ``no_numbers`` (labels that aren't numbers, if they are said to be).
    """
    if len(tables) < 2:
        raise Refusal("two tables at least are appended")
    spark = next(iter(tables.values())).df.sparkSession
    automatic = [x for x in line_up(tables) if x[3] == x[4]] if under is None else []
    moves = {label: dict(m) for label, m in (under or {}).items()}
    for label, c, new, _, _ in automatic:
        moves.setdefault(label, {})[c] = new
    laid = {}
    for label, t in tables.items():
        df, names = t.df, moves.get(label, {})
        for old, new in names.items():
            if old not in t.keys or new in t.keys:
                raise Refusal(f"{label!r} has no column {old!r} to lay under {new!r}, or has one of that name already")
            df = df.withColumnRenamed(old, new)
        laid[label] = KeyedTable(df, [names.get(k, k) for k in t.keys], t.value, t.unit, [names.get(k, k) for k in t.primary])
    left = line_up(laid)
    if left:
        label, c, new, matched, of = left[0]
        raise Refusal(f"{label!r} has no column {new!r}, but {matched} of the {of} values of its {c!r} are values of it: lay one under the other")
    first = next(iter(laid.values()))
    if len({t.value for t in laid.values()}) > 1:
        raise Refusal("the value columns have different names: " + ", ".join(f"{x}: {t.value}" for x, t in laid.items()))
    if len({_unit(t.unit) for t in laid.values()}) > 1:
        raise Refusal("the tables count in different units: " + ", ".join(f"{x}: {t.unit or 'none'}" for x, t in laid.items()))
    keys = list(dict.fromkeys(k for t in laid.values() for k in t.keys))
    for name in filter(None, (source, new_key)):
        if name in [*keys, first.value] or source == new_key:
            raise Refusal(f"{name!r} is a column already")
    out = None
    for i, (label, t) in enumerate(laid.items()):
        columns = [(F.col(f"`{k}`") if k in t.keys else F.lit(None)).cast("string").alias(k) for k in keys]
        df = t.df.select(F.lit(i).alias("_table"), *columns, *([F.lit(label).alias(source)] if source else []), F.col(f"`{t.value}`").cast("double").alias(t.value))
        out = df if out is None else out.unionByName(df)
    missing = out.groupBy("_table").count().join(F.broadcast(spark.createDataFrame([(i, x, k) for i, (x, t) in enumerate(laid.items()) for k in keys if k not in t.keys], "_table int, label string, column string")), "_table").select("label", "column", F.col("count").alias("rows"))
    primary = list(first.primary) if first.primary and all(list(t.primary) == list(first.primary) for t in laid.values()) else []
    reports = {"lined_up": spark.createDataFrame([x[:3] for x in automatic], "label string, column string, under string"), "missing": missing}
    if primary:
        reports["repeated"] = repeated_keys(out, [*([source] if source else []), *primary])
    if source and numeric_labels:
        reports["no_numbers"] = out.where(number(F.col(source)).isNull()).groupBy(source).agg(F.count(F.lit(1)).alias("rows"))
    if new_key:
        out = numbered(out, ["_table", *keys, first.value], new_key)
    return OpResult(out.select(*([new_key] if new_key else []), *keys, *([source] if source else []), first.value), reports)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: rows, absent (null), empty (blank), numbers, quartiles, extremes, and values beyond 1.5 times the
    quartile range. Figures are given where four numbers at least are read."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), number(F.col(c)).alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    first = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").isNull()).alias("n_absent"), F.count_if(F.trim("text") == "").alias("n_empty"),
        F.count("x").alias("n_numbers"), F.min("x").alias("low"), F.percentile("x", 0.25).alias("p25"), F.percentile("x", 0.5).alias("p50"), F.percentile("x", 0.75).alias("p75"), F.max("x").alias("high"),
        F.count_distinct("text").alias("n_distinct"),
    )
    first = first.select("column", "n_rows", "n_absent", "n_empty", "n_numbers", "n_distinct", *[F.when(F.col("n_numbers") >= 4, c).alias(n) for n, c in (("low", F.col("low")), ("q1", F.col("p25")), ("median", F.col("p50")), ("q3", F.col("p75")), ("high", F.col("high")))])
    fences = F.broadcast(first.select(F.col("column").alias("c"), (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper")))  # one row a column
    beyond = long.join(fences, F.col("column") == F.col("c")).groupBy("column").agg(F.count_if((F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))).alias("n_beyond"))
    return first.join(beyond, "column")


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values (ties: the smaller first)."""
    counts = df.where(~blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def histogram(df: DataFrame, value: Column, bins: int = 12) -> DataFrame:
    """bin (0-based), low, high, n: bins of equal width, the largest value in the last."""
    x = df.select(value.alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n"))  # one row is sent
    return binned.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def nullity(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Pairs of columns and the correlation of their being missing."""
    marks = df.select(*[c.isNull().cast("double").alias(n) for n, c in columns.items()])
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = marks.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("phi")) for a, b in pairs])).alias("x")).select("x.*")


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """df and the number of each row (from 1) in the order of the columns, without gathering the rows in one task.

    The rows are dealt by ranges of the order; each range counts its own, and the offset of a range is the sum of the counts
    before it (one number a range).
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a number a partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    sent = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before long"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(sent, "_range").withColumn(name, F.col("_before") + nth).drop("_range", "_before")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th row of one table beside the n-th of the other; rows without a counterpart keep nulls there."""
    return numbered(left, left_order, "position").join(numbered(right, right_order, "position"), "position", "full_outer")


def category_counts(df: DataFrame, column: str, categories: Sequence[str], other: str = "(other)", unknown: str = "(unknown)") -> DataFrame:
    """category, n: one row for each declared category, also where it never occurs, and rows for other values and for blanks."""
    named = F.when(blank(F.col(column)), unknown).when(F.col(column).cast("string").isin(*categories), F.col(column).cast("string")).otherwise(other)
    counts = df.groupBy(named.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    declared = df.sparkSession.createDataFrame([(c,) for c in (*categories, other, unknown)], "category string")
    return declared.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def search(df: DataFrame, text: str, columns: Sequence[str], key: Sequence[str], page: int = 1, size: int = 50) -> DataFrame:
    """A page of the rows in which some of the columns holds the folded text, in the order of the key."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(folded(F.col(c)).contains(folded(F.lit(text))), F.lit(False))
    return df.where(found).orderBy(*key).offset((page - 1) * size).limit(size)


def edit_features(df: DataFrame, column: str, rename: Mapping[str, str] | None = None, merge: Mapping[str, Sequence[str]] | None = None, hide: Sequence[str] = ()) -> DataFrame:
    """df with the names of a column's features edited: hidden ones go, then groups of names become one, then names are changed."""
    named = F.col(column)
    for to, some in (merge or {}).items():
        named = F.when(F.col(column).isin(*some), F.lit(to)).otherwise(named)
    changed = named
    for old, new in (rename or {}).items():
        changed = F.when(named == old, F.lit(new)).otherwise(changed)
    kept = df.where(F.col(column).isNull() | ~F.col(column).isin(*hide)) if hide else df
    return kept.withColumn(column, changed)


def bar_order(df: DataFrame, category: str, value: Column, how: str = "descending") -> DataFrame:
    """category, total, place (from 1): bars by their totals, or by name; unknown totals last, ties by name."""
    totals = df.groupBy(F.col(category).alias("category")).agg(F.sum(value).alias("total"))
    order = {"descending": [F.col("total").desc_nulls_last(), F.col("category")], "ascending": [F.col("total").asc_nulls_last(), F.col("category")], "name": [F.col("category")]}[how]
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # a row a bar


def stacked(df: DataFrame, at: Column, series: str, value: Column, order: Sequence[str]) -> DataFrame:
    """at, series, value, lower, upper: the series of each place stacked in the declared order; a series that is missing there has no row."""
    sums = df.groupBy(at.alias("at"), F.col(series).alias("series")).agg(F.sum(value).alias("value")).where(F.col("series").isin(*order))
    w = Window.partitionBy("at").orderBy(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("series"))).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("upper", F.sum("value").over(w)).withColumn("lower", F.col("upper") - F.col("value"))


def value_classes(df: DataFrame, value: str, k: int = 5, how: str = "quantile") -> DataFrame:
    """df and class (0-based): breaks at the values of rank ceil((i+1) n / k), or equal intervals; equal breaks are one."""
    x = df.where(F.col(value).isNotNull())
    if how == "quantile":
        n = x.count()
        ranks = sorted({-(-i * n // min(k, n)) for i in range(1, min(k, n) + 1)}) if n else []
        breaks = numbered(x.select(F.col(value).alias("v")), ["v"], "rank").where(F.col("rank").isin(*ranks)).select("v") if n else x.select(F.col(value).alias("v"))
    else:
        ends = x.agg(F.min(value).alias("a"), F.max(value).alias("b"))
        breaks = ends.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / k)).alias("v"))
    listed = F.broadcast(breaks.agg(F.sort_array(F.collect_set("v")).alias("breaks")))  # k numbers
    at = F.least(F.size(F.filter("breaks", lambda b: b < F.col(value))), F.size("breaks") - 1)
    return x.crossJoin(listed).withColumn("class", at).drop("breaks")


def sort_blanks_last(df: DataFrame, column: str, descending: bool = False, numeric: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """Sorted by one column, blanks last in either direction; ties by the columns ``then``."""
    x = number(F.col(column)) if numeric else F.when(~blank(F.col(column)), F.col(column))
    return df.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), *then)


def edit_cells(df: DataFrame, record: str, edits: DataFrame, column: str, order: str | None = None) -> OpResult:
    """Apply a log of edits (record, old, new, and a column that orders the edits of one record) to a column, one after the other;
    an edit whose old value isn't there at its turn does nothing. Report ``stale``: those edits, as (record, old, new)."""
    step = F.struct((F.col(order) if order else F.lit(0)).alias("at"), F.col("old").alias("old"), F.col("new").alias("new"))
    e = edits.groupBy(F.col("record").cast("string").alias("_r")).agg(F.sort_array(F.collect_list(step)).alias("_edits"))  # of one record
    kind = "struct<value:string,stale:array<struct<old:string,new:string>>>"
    start = F.struct(F.col(column).cast("string").alias("value"), F.array().cast("array<struct<old:string,new:string>>").alias("stale")).cast(kind)

    def apply(state: Column, x: Column) -> Column:
        fits = state["value"].eqNullSafe(x["old"].cast("string"))
        lost = F.struct(x["old"].cast("string").alias("old"), x["new"].cast("string").alias("new"))
        return F.struct(F.when(fits, x["new"].cast("string")).otherwise(state["value"]).alias("value"), F.when(fits, state["stale"]).otherwise(F.concat(state["stale"], F.array(lost))).alias("stale")).cast(kind)

    joined = df.join(e, F.col(record).cast("string") == F.col("_r"), "left").withColumn("_done", F.when(F.col("_r").isNotNull(), F.aggregate("_edits", start, apply)))
    out = joined.withColumn(column, F.when(F.col("_r").isNotNull(), F.col("_done.value")).otherwise(F.col(column).cast("string")))
    return OpResult(out.drop("_r", "_edits", "_done"), {"stale": joined.select(F.col("_r").alias("record"), F.explode("_done.stale").alias("x")).select("record", "x.old", "x.new")})


def repair(df: DataFrame, column: str) -> OpResult:
    """A text column read as numbers. Report: the nonblank texts that are none, and how often."""
    unread = df.where(~blank(F.col(column)) & ~F.trim(column).rlike(NUMBER)).groupBy(F.col(column).alias("text")).count()
    return OpResult(df.withColumn(column, number(F.col(column))), {"unread": unread})


def dictionary_check(df: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared columns (column, n_missing) against the file: columns on one side only and counts of missing cells that differ."""
    there = df.agg(*[F.count_if(blank(F.col(c))).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "found_missing")
    both = there.join(declared, "column", "full_outer")
    finding = F.when(F.col("found_missing").isNull(), "not in file").when(F.col("n_missing").isNull(), "not in dictionary").when(F.col("n_missing") != F.col("found_missing"), "missing differs")
    return both.withColumn("finding", finding).where("finding is not null")


def total_column(df: DataFrame, by: Sequence[str], column: str, how: str = "sum") -> DataFrame:
    """Groups with a statistic of another column than the table's value; a nonblank cell that is no number ends the job."""
    v = number(F.col(column).cast("string"))
    value = refuse_when(~blank(F.col(column)) & v.isNull(), F.concat(F.lit(f"{column} holds a text that is no number: "), F.col(column).cast("string")), v)
    return group(df, by, value, how, column)


def category_classes(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """category, class (from 0, by first appearance in the order), n: the trimmed nonblank texts of a column."""
    text = F.trim(F.col(column).cast("string"))
    first = df.where(~blank(F.col(column))).groupBy(text.alias("category")).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("n"))
    return numbered(first, ["_first", "category"], "class").select("category", (F.col("class") - 1).cast("long").alias("class"), "n")
