"""Declared rules over records: conditions conclude a term or a computed value for a column.

Rules are compiled to column expressions, level by level: a rule that reads a concluded column waits for all rules of that
column. A column for which two rules conclude different values gets none, and the record is marked; where no rule fires the
``otherwise`` value stands. Comparisons with a missing operand do not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallygrove.functions.values import number
from tallygrove.report import Refusal, refuse_when, stored


@dataclass(frozen=True)
class Condition:
    """column, one of = != > >= < <= blank filled, and a value or (``other``) another column."""

    column: str
    test: str
    value: object = None
    other: str | None = None

    def reads(self) -> set[str]:
        return {self.column} | ({self.other} if self.other else set())

    def compiled(self) -> Column:
        c = F.col(self.column)
        if self.test in ("blank", "filled"):
            is_blank = c.isNull() | (F.trim(c.cast("string")) == "")
            return is_blank if self.test == "blank" else ~is_blank
        if self.test in ("=", "!="):
            right = F.col(self.other).cast("string") if self.other else F.lit(str(self.value))
            same = c.cast("string") == right
            return F.coalesce(same if self.test == "=" else ~same, F.lit(False))
        left, right = number(c), number(F.col(self.other)) if self.other else F.lit(float(self.value))  # type: ignore[arg-type]
        made = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}.get(self.test)
        if made is None:
            raise Refusal(f"no such comparison: {self.test}")
        return F.coalesce(made, F.lit(False))


@dataclass(frozen=True)
class Compute:
    """left plus, minus, times or divided by right (columns or numbers), a double; division by 0 gives nothing."""

    left: str | float
    how: str
    right: str | float

    def reads(self) -> set[str]:
        return {x for x in (self.left, self.right) if isinstance(x, str)}

    def compiled(self) -> Column:
        a, b = (number(F.col(x)) if isinstance(x, str) else F.lit(float(x)) for x in (self.left, self.right))
        return {"plus": a + b, "minus": a - b, "times": a * b, "divided by": F.try_divide(a, b)}[self.how]


@dataclass(frozen=True)
class Rule:
    """If any of the lists of conditions holds in full, ``column`` is ``value`` (a term, or a Compute)."""

    column: str
    value: str | Compute
    when: Sequence[Sequence[Condition]] = field(default_factory=lambda: [[]])

    def reads(self) -> set[str]:
        out = {c for some in self.when for x in some for c in x.reads()}
        return out | (self.value.reads() if isinstance(self.value, Compute) else set())

    def compiled(self, as_number: bool) -> Column:
        holds = F.lit(False)
        for some in self.when:
            every = F.lit(True)
            for c in some:
                every &= c.compiled()
            holds |= every
        value = self.value.compiled() if isinstance(self.value, Compute) else F.lit(self.value)
        return F.when(holds, value if as_number else value.cast("string"))


def apply_rules(df: DataFrame, rules: Sequence[Rule], otherwise: Mapping[str, str] | None = None) -> DataFrame:
    """df, one column for each that the rules conclude, and ``conflicts``: the columns with contradictory conclusions.

    A column that is only computed holds doubles, others text.
    """
    concluded = list(dict.fromkeys(r.column for r in rules))
    pending, out, conflicts = list(concluded), df, []
    while pending:
        ready = [c for c in pending if not any(r.reads() & set(pending) for r in rules if r.column == c)]
        if not ready:
            raise Refusal(f"these columns are concluded from each other: {', '.join(pending)}")
        for c in ready:
            own = [r for r in rules if r.column == c]
            as_number = all(isinstance(r.value, Compute) for r in own) and c not in (otherwise or {})
            values = F.array_distinct(F.array_compact(F.array(*[r.compiled(as_number) for r in own])))
            out = out.withColumn(f"_{c}", values)
        for c in ready:
            held = F.col(f"_{c}")
            default = F.lit((otherwise or {}).get(c))
            out = out.withColumn(c, F.when(F.size(held) == 1, held[0]).when(F.size(held) == 0, default))
            conflicts.append(F.when(F.size(held) > 1, F.lit(c)))
            pending.remove(c)
    out = out.withColumn("conflicts", F.array_compact(F.array(*conflicts)))
    return out.drop(*[f"_{c}" for c in concluded])


def bands(column: str, to: str, cuts: Sequence[float], names: Sequence[str]) -> list[Rule]:
    """Rules that name the band of a number: below the first cut, between two cuts (the lower included), from the last on."""
    if len(names) != len(cuts) + 1 or sorted(cuts) != list(cuts):
        raise Refusal("bands need one name more than cuts, and cuts in ascending order")
    edges = [None, *cuts, None]
    return [Rule(to, n, [[*([Condition(column, ">=", lo)] if lo is not None else []), *([Condition(column, "<", hi)] if hi is not None else []), Condition(column, "filled")]]) for n, lo, hi in zip(names, edges[:-1], edges[1:], strict=True)]


def targets(column: str, to: str, least: float, met: str = "met", missed: str = "missed") -> list[Rule]:
    return [Rule(to, met, [[Condition(column, ">=", least)]]), Rule(to, missed, [[Condition(column, "<", least)]])]


def previous_row(df: DataFrame, within: Sequence[str], order: str, columns: Mapping[str, str], key: str) -> DataFrame:
    """df with values of the row before (new name: column), and ``no_previous``: first, repeated, after-repeated or unordered.

    From the first repeated order value of a group on, no row has a previous one. ``key`` breaks ties of position only.
    """
    w = Window.partitionBy(*within).orderBy(F.col(order).asc_nulls_last(), key)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_same", F.coalesce((F.lag(order).over(w) == F.col(order)) | (F.lead(order).over(w) == F.col(order)), F.lit(False)))
    out = out.withColumns({"_twice": F.max(F.col("_same").cast("int")).over(upto), "_nth": F.row_number().over(w)})
    reason = F.when(F.col(order).isNull(), "unordered").when(F.col("_same"), "repeated").when(F.col("_twice") == 1, "after-repeated").when(F.col("_nth") == 1, "first")
    out = out.withColumn("no_previous", reason)
    return out.withColumns({n: F.when(F.col("no_previous").isNull(), F.lag(c).over(w)) for n, c in columns.items()}).drop("_same", "_twice", "_nth")


def previous_period(df: DataFrame, within: Sequence[str], date: str, unit: str, columns: Mapping[str, str]) -> DataFrame:
    """df with values of the row dated exactly one day, week or month before (a month clamps to its end); several such rows give none."""
    step = {"day": lambda d: F.date_sub(d, 1), "week": lambda d: F.date_sub(d, 7), "month": lambda d: F.add_months(d, -1)}[unit]
    keys = [f"_k{i}" for i in range(len(within))]
    before = df.groupBy(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{n}") for n, c in columns.items()])
    on = (step(F.col(date)) == F.col("_d")) & F.lit(True)
    for c, k in zip(within, keys, strict=True):
        on &= F.col(c).eqNullSafe(F.col(k))
    out = df.join(before, on, "left")
    return out.select(*df.columns, *[F.when(F.col("_n") == 1, F.col(f"_{n}")).alias(n) for n in columns])


def carried(df: DataFrame, within: Sequence[str], order: str, start: float, step: Column, name: str = "carried", least: float = 0.0) -> DataFrame:
    """A value that each row concludes from the one before: max(least, previous + step), from ``start``; rows ordered within groups.

    With P the running sum of steps, the recursion has the closed form P + max(start, least - min over earlier P), so two
    windows suffice and no group is gathered.
    """
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_p", F.sum(step).over(w))
    return summed.withColumn(name, F.col("_p") + F.greatest(F.lit(float(start)), least - F.min("_p").over(w))).drop("_p")


def recursive(df: DataFrame, within: Sequence[str], order: str, states: Sequence[str], conclude: Callable[[Column], Column], key: str, start: str | None = None, name: str = "conclusion") -> DataFrame:
    """df with what ``conclude`` makes of each row and of the conclusion of the row before it in its group (``start`` for the first).

    Conclusions are among ``states``, or null; one that is not ends the job. So a row is a table from the state before it to the state after
    it, which Spark computes for all states at once, and tables can be chained: rows are dealt by ranges of group and order, every range
    gives one table for all of it, those are chained (one row a range), and each range then runs from its own first state. One long group
    is many ranges. ``key`` orders rows of one place. Groups and orders may be null (nulls come first); an empty table gives no rows.
    """
    if not states or len(set(states)) != len(states) or start not in (None, *states):
        raise Refusal("the states are to be named, each once, and the start is one of them")
    every = [*states, None]
    place = lambda c: F.when(c.isNull(), len(states)).otherwise(F.array_position(F.array(*[F.lit(x) for x in states]), c).cast("int") - 1)
    table = F.array(*[place(conclude(F.lit(x).cast("string"))) for x in every])
    known = refuse_when(F.exists(table, lambda x: x < 0), "a conclusion is none of the states", table)
    by = [*within, order, key]
    dealt = stored(df.withColumn("_to", known).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_range").orderBy(*by)
    same = F.lit(True)
    for c in within:
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w)
    # the first row of a range begins a group unless the last of the range before is of the same one
    dealt = stored(dealt.withColumns({"_nth": first, "_new": F.when(first > 1, ~same)}), "ranges")
    ends = dealt.groupBy("_range").agg(F.min_by(F.struct(*within, F.lit(0).alias("_")), "_nth").alias("head"), F.max_by(F.struct(*within, F.lit(0).alias("_")), "_nth").alias("tail"))
    before = Window.orderBy("_range")
    heads = ends.select("_range", F.coalesce(~F.col("head").eqNullSafe(F.lag("tail").over(before)), F.lit(True)).alias("fresh"))  # a row a range
    begin = every.index(start)
    n = len(every)

    def tables_of(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.argsort(batch["_nth"].to_numpy())
        to = batch["_to"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[at]
        return at, to, batch["_new"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)[at]

    def whole(batch):
        _, to, new = tables_of(batch)
        state = np.arange(n)
        for t, fresh in zip(to, new.tolist(), strict=True):
            state = t[np.full(n, begin)] if fresh else t[state]
        return pa.table({"_range": pa.array([batch["_range"][0].as_py()], pa.int32()), "chain": pa.array([state.tolist()], pa.list_(pa.int32()))})

    chains = dealt.select("_range", "_nth", "_new", "_to").groupBy("_range").applyInArrow(whole, "_range int, chain array<int>")
    entry, state = {}, begin
    for r in sorted(chains.join(heads, "_range").collect(), key=lambda r: r["_range"]):  # a row a range
        entry[r["_range"]] = state = begin if r["fresh"] else state
        state = r["chain"][state]

    def run(batch):
        at, to, new = tables_of(batch)
        state, out = entry[batch["_range"][0].as_py()], np.empty(len(at), np.int64)
        for i, (t, fresh) in enumerate(zip(to.tolist(), new.tolist(), strict=True)):
            state = t[begin if fresh else state]
            out[at[i]] = state
        return batch.drop_columns(["_range", "_nth", "_new", "_to"]).append_column(name, pa.array([every[i] for i in out.tolist()], pa.string()))

    kept = [c for c in df.columns if c != name]
    schema = StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, StringType())])
    return dealt.select(*kept, "_range", "_nth", "_new", "_to").groupBy("_range").applyInArrow(run, schema)
