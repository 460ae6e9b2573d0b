"""Counts over time: periods without a case are listed as zero, undated records are counted apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.values import CYCLIC, LINEAR, period
from tallygrove.operators.tables import statistic
from tallygrove.report import OpResult, Refusal

_STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "week_sunday": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def case_series(df: DataFrame, date: Column, unit: str, weight: Column | None = None, split: Sequence[str] = ()) -> OpResult:
    """period, (split columns,) cases: the count, or the sum of weights (unknown if one is missing). Periods in between, and
    all of a cycle, are there with 0; with ``split`` each of its groups has every period. Report: undated records."""
    if unit not in LINEAR and unit not in CYCLIC:
        raise Refusal(f"no such period: {unit}")
    dated = df.withColumn("period", period(date, unit))
    known = dated.where("period is not null")
    counts = known.groupBy("period", *split).agg((F.count(F.lit(1)) if weight is None else statistic(weight, "sum")).alias("cases"), F.lit(True).alias("_some"))
    if unit in CYCLIC:
        domain = df.sparkSession.range(1, CYCLIC[unit] + 1).select(F.col("id").cast("int").alias("period"))
        domain = domain.crossJoin(known.select(*split).distinct()) if split else domain  # at most twelve periods a group
    else:
        ends = counts.agg(F.min("period").alias("a"), F.max("period").alias("b"))
        domain = ends.where("a is not null").select(F.explode(F.expr(f"sequence(a, b, {_STEP[unit]})")).alias("period"))
        if split:
            domain = F.broadcast(domain).crossJoin(known.select(*split).distinct())  # periods between two dates
    join = F.col("d.period") == F.col("c.period")
    for s in split:
        join &= F.col(f"d.{s}").eqNullSafe(F.col(f"c.{s}"))
    out = domain.alias("d").join(counts.alias("c"), join, "left").select("d.period", *[f"d.{s}" for s in split], F.when(F.col("c._some"), F.col("c.cases")).otherwise(F.lit(0)).alias("cases"))
    return OpResult(out, {"undated": dated.where("period is null").agg(F.count(F.lit(1)).alias("undated"))})


def replay(df: DataFrame, date: Column, by: Sequence[str] = ()) -> DataFrame:
    """day, (by,) cases, cases_so_far: what a daily surveillance would have seen on each day."""
    from pyspark.sql import Window

    daily = case_series(df, date, "day", split=by).df
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cases_so_far", F.sum("cases").over(upto))
