"""Bringing values from one table to another: diagnosed lookups, every match, periods, shifts, spelling and areas.

A key with an empty part never matches. Unless every match is asked for, a key with several values is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.values import blank, folded, name_similarity
from tallygrove.report import OpResult, Refusal, refuse_when

CLOSE, MARGIN = 0.88, 0.02  # fixed values: least similarity of a spelling, and the distance from the best that leaves a doubt
BUCKET_DAYS = 32


def _keys(columns: Sequence[str], compare: str) -> list[Column]:
    if compare not in ("exact", "folded"):
        raise Refusal(f"no such comparison: {compare}")
    made = [folded(F.col(c)) if compare == "folded" else F.trim(F.col(c).cast("string")) for c in columns]
    return [F.when(k != "", k) for k in made]


def relate(records: DataFrame, related: DataFrame, on: Sequence[tuple[str, str]], bring: str, gaps: str = "drop", label: str | None = None, several: str = "refuse", compare: str = "exact", name: str | None = None) -> OpResult:
    """records with one more column: what ``related`` holds under ``bring`` for the same keys.

    gaps: ``drop`` leaves out records without a match, ``keep`` keeps them with ``label``. several: ``refuse``, or ``each``
    for one row a distinct value. Reports: ``overlap`` (distinct keys on the left only, on both sides, on the right only)
    and ``unmatched`` (records by key).
    """
    if gaps not in ("drop", "keep") or several not in ("refuse", "each"):
        raise Refusal("gaps are dropped or kept; several values are refused or each kept")
    name = name or bring
    left_keys, right_keys = _keys([a for a, _ in on], compare), _keys([b for _, b in on], compare)
    if compare == "exact":  # of one type that is no text: compared as it is
        of, by = dict(records.dtypes), dict(related.dtypes)
        alike_types = [of.get(a) == by.get(b) != "string" for a, b in on]
        left_keys = [F.col(a) if plain else k for (a, _), k, plain in zip(on, left_keys, alike_types, strict=True)]
        right_keys = [F.col(b) if plain else k for (_, b), k, plain in zip(on, right_keys, alike_types, strict=True)]
    keys = [f"_k{i}" for i in range(len(on))]
    right = related.select(*[k.alias(n) for k, n in zip(right_keys, keys, strict=True)], F.col(bring).alias("_bring")).dropna(subset=keys)
    if several == "each":
        right = right.distinct()
    else:
        right = right.groupBy(*keys).agg(refuse_when(F.min("_bring") != F.max("_bring"), "a key has several values to bring", F.min("_bring")).alias("_bring"))
    left = records.withColumns(dict(zip(keys, left_keys, strict=True)))
    joined = left.join(right.withColumn("_hit", F.lit(True)), keys, "inner" if gaps == "drop" else "left")
    value = F.col("_bring") if gaps == "drop" or label is None else F.when(F.col("_hit"), F.col("_bring").cast("string")).otherwise(F.lit(label))
    out = joined.select(*[F.col(f"`{c}`") for c in records.columns if c != name], value.alias(name))
    sides = left.select(*keys).dropna().distinct().withColumn("l", F.lit(1)).join(right.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full_outer")
    overlap = sides.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("l").isNull()).alias("right_only"))
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).count()
    return OpResult(out, {"overlap": overlap, "unmatched": unmatched})


def relate_period(records: DataFrame, periods: DataFrame, date: str, start: str, end: str, bring: str, on: Sequence[tuple[str, str]] = (), shift: int = 0, keep: bool = False, unique: bool = True) -> DataFrame:
    """records and the value of the period (both ends included) that holds their date plus ``shift`` days; two periods are refused.

    Periods are dealt to buckets of ``BUCKET_DAYS`` days, so the join is an equality join that Spark can shuffle.
    """
    d = F.date_add(F.col(date).cast("date"), shift)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    keys = [f"_k{i}" for i in range(len(on))]
    right = periods.select(
        *[F.col(b).alias(k) for (_, b), k in zip(on, keys, strict=True)], F.col(start).cast("date").alias("_s"), F.col(end).cast("date").alias("_e"), F.col(bring).alias("_bring"),
    ).where("_s <= _e").withColumn("_b", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    days = records.withColumns({"_d": d, "_b": bucket(d)} | {k: F.col(a) for (a, _), k in zip(on, keys, strict=True)})
    met = (F.col("_b") == F.col("_rb")) & (F.col("_d") >= F.col("_s")) & (F.col("_d") <= F.col("_e"))
    for k in keys:
        met &= F.col(k) == F.col(f"_r{k}")
    right = right.where("_bring is not null")
    named = right.withColumnsRenamed({"_b": "_rb"} | {k: f"_r{k}" for k in keys})
    names = records.columns
    # periods that never overlap give each record one row at most; only others need records to be told apart
    turn = Window.partitionBy(*keys, "_b").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    if right.withColumn("_till", F.max("_e").over(turn)).where("_s <= _till").isEmpty():
        out = days.join(named, met, "left" if keep else "inner")
        out = out.select(*[F.col(f"`{c}`") for c in names], F.col("_bring").alias("_v"))
    else:
        joined = days.withColumn("_row", F.monotonically_increasing_id()).join(named, met, "left")
        first = F.max("_bring")
        value = refuse_when(F.count("_bring") > 1, "a date lies in several periods", first) if unique else first
        out = joined.groupBy("_row", *[F.col(f"`{c}`") for c in names]).agg(value.alias("_v"))
    out = out if keep else out.where("_v is not null")
    return out.select(*[F.col(f"`{c}`") for c in names if c != bring], F.col("_v").alias(bring))


def relate_shifts(records: DataFrame, periods: DataFrame, key: str, date: str, start: str, end: str, bring: str, shifts: Sequence[int]) -> DataFrame:
    """records (with a unique ``key``) and one column a shift, named like ``bring_+7d``; null where no period holds the shifted date."""
    spread = records.select(F.col(key).alias("_key"), F.col(date).cast("date").alias("_date"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("_shift"))
    spread = spread.withColumn("_day", F.date_add("_date", F.col("_shift")))
    found = relate_period(spread, periods, "_day", start, end, bring)
    wide = found.groupBy("_key").agg(*[F.max(F.when(F.col("_shift") == s, F.col(bring))).alias(f"{bring}_{s:+d}d") for s in shifts])
    return records.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")


def overlap_share(records: DataFrame, related: DataFrame, on: Sequence[tuple[str, str]], measure: Column) -> DataFrame:
    """The share of a measure that records with a match hold."""
    keys = [f"_k{i}" for i in range(len(on))]
    right = related.select(*[F.col(b).alias(k) for (_, b), k in zip(on, keys, strict=True)]).dropna().distinct().withColumn("_hit", F.lit(True))
    joined = records.withColumns({k: F.col(a) for (a, _), k in zip(on, keys, strict=True)}).withColumn("_m", measure).join(right, keys, "left")
    return joined.agg(F.sum(F.when(F.col("_hit"), F.col("_m"))).alias("retained"), F.sum("_m").alias("total")).withColumn("share", F.try_divide("retained", "total"))


def _letters(name: Column) -> Column:
    """The letters of a name, each with how often it came before, so that a repeated letter counts as often as it is there."""
    chars = F.split(name, "")
    nth = lambda i: F.size(F.filter(F.slice(chars, 1, i), lambda x: x == F.element_at(chars, i)))
    return F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.concat(F.element_at(chars, i), nth(i).cast("string")))


def alike(left: DataFrame, right: DataFrame, a: str, b: str, least: float = CLOSE) -> DataFrame:
    """a, b, similarity of all distinct nonblank names of the two tables whose Jaro-Winkler similarity is ``least`` (0.8 or more) at least.

    Complete: the similarity is j + p (1 - j) / 10 with p equal first letters, four at most, and j is no more than a third of
    m / len(a) + m / len(b) + 1, where m letters are shared. So two such names have their first four letters in common, or share
    m >= need * len(a) * len(b) / (len(a) + len(b)) letters, where need is what j asks for at p = 3. Of two names that share m letters, the
    first len - m + 1 letters in one order, rare ones first, have one in common: names meet by these letters and both lengths, by equality.
    """
    if not 0.8 <= least <= 1:
        raise Refusal("names are alike from a similarity of 0.8 on")
    need = 3 * (least - 0.3) / 0.7 - 1
    one = lambda df, c: df.select(F.col(c).alias("name")).where("name <> ''").distinct()
    sides = one(left, a).withColumn("side", F.lit("a")).unionByName(one(right, b).withColumn("side", F.lit("b")))
    spread = sides.withColumn("letter", F.explode(_letters(F.col("name"))))
    rare = spread.groupBy(F.col("letter").alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    ordered = spread.join(rare, F.col("letter") == F.col("_l")).groupBy("side", "name").agg(F.array_sort(F.collect_list(F.struct("n", "letter"))).alias("letters"))
    size = F.size("letters")
    low, high = F.ceil(size * (need - 1)).cast("int"), F.floor(size / (need - 1)).cast("int")  # m is no more than either length
    lengths = ordered.select("side", "name", "letters", size.alias("size"), F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, low, F.lit(1)))).alias("other"))
    shared = F.ceil(F.lit(need) * F.col("size") * F.col("other") / (F.col("size") + F.col("other")) - 1e-9).cast("int")
    lengths = lengths.withColumn("prefix", F.col("size") - F.greatest(shared, F.lit(1)) + 1).where("prefix >= 1")
    keys = F.transform(F.slice("letters", 1, F.col("prefix")), lambda x: x["letter"])
    by_letter = lengths.select("side", "name", F.explode(keys).alias("_key"), F.when(F.col("side") == "a", F.col("size")).otherwise(F.col("other")).alias("la"), F.when(F.col("side") == "a", F.col("other")).otherwise(F.col("size")).alias("lb"))
    by_start = sides.where(F.length("name") >= 4).select("side", "name", F.substring("name", 1, 4).alias("_key"), F.lit(0).alias("la"), F.lit(0).alias("lb"))
    met = by_letter.unionByName(by_start)
    x = met.where("side = 'a'").select(F.col("name").alias(a), "_key", "la", "lb")
    y = met.where("side = 'b'").select(F.col("name").alias(b), "_key", "la", "lb")
    pairs = x.join(y, ["_key", "la", "lb"]).select(a, b).distinct()
    return pairs.withColumn("similarity", name_similarity(F.col(a), F.col(b))).where(F.col("similarity") >= least)


def relate_spelling(records: DataFrame, related: DataFrame, left: str, right: str, bring: str, decisions: DataFrame | None = None) -> DataFrame:
    """records' distinct names, the name each is taken for, how (exact, decided, spelling, ambiguous, none), and its value.

    Names are compared once each, with all that are alike (see ``alike``); the best counts if it reaches ``CLOSE`` and no other is within ``MARGIN``.
    """
    names = records.select(folded(F.col(left)).alias("name")).where("name <> ''").distinct()
    known = related.select(folded(F.col(right)).alias("known"), F.col(bring).alias("value")).where("known <> ''").groupBy("known").agg(F.min("value").alias("value"))
    exact = names.join(known, names.name == known.known).select("name", "known", F.lit(1.0).alias("similarity"), F.lit("exact").alias("how"), "value")
    rest = names.join(known.select(F.col("known").alias("name")), "name", "left_anti")
    decided = None
    if decisions is not None:
        chosen = decisions.select(folded(F.col("name")).alias("name"), folded(F.col("known")).alias("known"))
        decided = rest.join(chosen, "name").join(known, "known").select("name", "known", F.lit(1.0).alias("similarity"), F.lit("decided").alias("how"), "value")
        rest = rest.join(chosen.select("name"), "name", "left_anti")
    scored = alike(rest, known, "name", "known").join(known, "known").select("name", "known", "value", "similarity")
    best = Window.partitionBy("name").orderBy(F.desc("similarity"), "known")
    ranked = scored.withColumn("nth", F.row_number().over(best)).withColumn("second", F.lead("similarity").over(best)).where("nth = 1")
    clear = F.col("second").isNull() | (F.col("similarity") - F.col("second") > MARGIN)
    close = ranked.select("name", F.when(clear, F.col("known")).alias("known"), "similarity", F.when(clear, "spelling").otherwise("ambiguous").alias("how"), F.when(clear, F.col("value")).alias("value"))
    found = exact.unionByName(close) if decided is None else exact.unionByName(decided).unionByName(close)
    none = names.join(found.select("name"), "name", "left_anti")
    return found.unionByName(none.withColumn("how", F.lit("none")), allowMissingColumns=True)


def join_to_areas(areas: DataFrame, table: DataFrame, area_name: str, table_name: str, value: str, category: str | None = None, frame: str | None = None, unit: str | None = None) -> OpResult:
    """Every area with the value of the row of its folded name; a name that several rows have (in one frame) brings none.

    ``category`` brings a second column; with ``frame`` a row counts for one frame, ``frames`` is a map from frame to value, and the
    value is that of the last frame by its text. ``unit`` names the column that the parts of one unit share (else each area is one).
    Reports: areas without a row, rows without an area, names met twice, and ``diagnostics``: code, subject, n.
    """
    if frame in (table_name,) or category in (table_name,):
        raise Refusal("the column that areas are matched by can't also be the frame or the category")
    a = areas.withColumn("_k", folded(F.col(area_name)))
    raw, none = F.col(table_name).cast("string"), F.lit(None).cast("string")
    told = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c else none
    rows = table.select(folded(F.col(table_name)).alias("_k"), raw.alias("_raw"), F.col(value).alias("_v"), told(category).alias("_c"), told(frame).alias("_f"))
    t = rows.where("_k <> ''" + (" AND _f IS NOT NULL" if frame else ""))
    cells = t.groupBy("_k", "_f").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"), F.min("_c").alias("_c"), F.min("_raw").alias("_raw"), F.count_distinct("_raw").alias("_spelt"))
    held = F.when(F.col("_n") == 1, F.col("_v"))
    one = cells.groupBy("_k").agg(
        F.max("_n").alias("_n"), F.max(F.struct("_f", held.alias("v"))).alias("_last"), F.min("_c").alias("_c"), F.min("_raw").alias("_raw"), F.max("_spelt").alias("_spelt"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_f", held.alias("v")))))).alias("_frames"),
    )
    joined = a.join(one, "_k", "left")
    part = F.col(unit) if unit else F.monotonically_increasing_id()
    shared = a.where("_k <> ''").withColumn("_u", part).groupBy("_k").agg(F.count_distinct("_u").alias("n")).where("n > 1")
    spelt = t.groupBy("_k").agg(F.count_distinct("_raw").alias("n"), F.min("_raw").alias("_raw"))
    code = lambda df, name, subject, n="n": df.select(F.lit(name).alias("code"), F.col(subject).cast("string").alias("subject"), F.col(n).cast("long").alias("n"))
    named = F.concat_ws(" / ", "_raw", "_f")
    found = code(rows.where("_k is null or _k = ''").groupBy("_raw").count(), "missing-data-key", "_raw", "count")
    for part_of in (
        code(one.join(a.select("_k"), "_k", "left_anti").withColumn("n", F.lit(1)), "unmatched-data-key", "_raw"),
        code(joined.where("_n is null").groupBy(area_name).count(), "unmatched-boundary", area_name, "count"),
        code(shared, "duplicate-boundary-key", "_k"),
        code(spelt.where("n > 1"), "ambiguous-data-key", "_raw"),
        code(cells.where("_n > 1 AND _n > _spelt").withColumn("_raw", named), "multiple-data-rows", "_raw", "_n"),
    ):
        found = found.unionByName(part_of)
    reports = {"areas_without": joined.where("_n is null").select(area_name), "rows_without": one.join(a.select("_k"), "_k", "left_anti").select("_k"), "repeated": one.where("_n > 1").select("_k", "_n"), "diagnostics": found}
    out = joined.withColumn(value, F.col("_last.v"))
    out = out.withColumn(category, F.col("_c")) if category else out
    out = out.withColumn("frames", F.col("_frames")) if frame else out
    return OpResult(out.drop("_k", "_n", "_last", "_c", "_raw", "_spelt", "_frames"), reports)


def unmatched_keys(records: DataFrame, related: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct nonblank keys of records that related lacks."""
    keys = records.where(~blank(F.col(left))).select(F.col(left).alias("key")).distinct()
    return keys.join(related.select(F.col(right).alias("key")), "key", "left_anti")
