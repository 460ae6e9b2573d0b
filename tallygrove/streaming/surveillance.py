"""The counting operators over unbounded input: windows with a watermark, sessions, and the previous value of each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_cases(stream: DataFrame, time: str, length: str = "1 day", slide: str | None = None, late: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """start, end, (by,) cases: tumbling or sliding windows; records later than ``late`` are dropped by the watermark."""
    w = F.window(F.col(time), length, slide) if slide else F.window(F.col(time), length)
    counts = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("cases"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cases")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, start, end, n: runs of a key's records without a longer gap."""
    s = stream.withWatermark(time, late).groupBy(F.col(key), F.session_window(F.col(time), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fell_since_previous(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, time, value, previous, fell: each record with the value of the key's record before it, kept as state; records of one
    batch are taken in order of time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("time", kind="stable")
        values = pdf["value"].tolist()
        before = [last, *values[:-1]]
        state.update((values[-1],))
        yield pd.DataFrame({"key": [k[0]] * len(values), "time": pdf["time"], "value": values, "previous": pd.Series(before, dtype="float64", index=pdf.index), "fell": [b is not None and v < b for v, b in zip(values, before, strict=True)]})

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, time timestamp, value double, previous double, fell boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def undated(stream: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """The dated records, and those without a date, which go to a place of their own."""
    return stream.where(F.col(time).isNotNull()), stream.where(F.col(time).isNull())
