"""Epidemiological measures on aggregated counts: rates, two-by-two tables, exposures, strata, pairs, trend, sample sizes.

Rows with an unknown exposure or outcome are left out of a two-by-two table and counted. A measure whose formula has a
zero where it must not is null, with the reason beside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallygrove.functions.values import number
from tallygrove.report import OpResult, Refusal, refuse_when

#: Normal quantiles of two-sided 90, 95 and 99 percent limits.
Z = {90: 1.6448536269514722, 95: 1.959963984540054, 99: 2.5758293035489004}
#: Normal quantiles of a power of 80 and 90 percent.
POWER_Z = {80: 0.8416212335729143, 90: 1.2815515655446004}
SMALL_CELL = 5


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v is not None and v >= 0 else None)


def rate(df: DataFrame, numerator: Column, denominator: Column, by: Sequence[str] = (), multiplier: float = 1.0, band: tuple[str, float] | None = None, least: float = 0.0, proportion: bool = False) -> DataFrame:
    """Groups (by, and ``band`` for bands of a width) with cases, at_risk, rate and reason. A cell that is no number of 0 or
    more is refused; a rate over 0 or less than ``least`` at risk is null with the reason."""
    n, d = number(numerator), number(denominator)
    bad = n.isNull() | d.isNull() | (n < 0) | (d < 0)
    rows = df.withColumns({"_n": refuse_when(bad, "a count is missing, negative or no number", n), "_d": d})
    keys = [*by]
    if band:
        rows = rows.withColumn("band", F.floor(number(F.col(band[0])) / band[1]) * band[1])
        keys.append("band")
    out = rows.groupBy(*keys).agg(F.sum("_n").alias("cases"), F.sum("_d").alias("at_risk"))
    over = F.lit(proportion) & (F.col("cases") > F.col("at_risk"))
    reason = F.when(F.col("at_risk") == 0, "nobody at risk").when(F.col("at_risk") < least, "too few at risk")
    value = refuse_when(over, "a proportion is above 1", F.when(reason.isNull(), F.col("cases") * multiplier / F.col("at_risk")))
    return out.select(*keys, "cases", "at_risk", value.alias("rate"), reason.alias("reason"))


def risk_measures(a: Column, b: Column, c: Column, d: Column, level: int = 95) -> dict[str, Column]:
    """Risk ratio (Katz log limits), odds ratio (Wald), risk difference (Wald unpooled), and the three chi-squares of a table."""
    z = Z[level]
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    e1, e0, n = a + b, c + d, a + b + c + d
    p1, p0 = F.try_divide(a, e1), F.try_divide(c, e0)
    rr = F.when((a > 0) & (c > 0), p1 / p0)
    se_rr = F.sqrt(F.try_divide(b, a * e1) + F.try_divide(d, c * e0))
    orr = F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), a * d / F.nullif(b * c, F.lit(0.0)))
    se_or = F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + F.try_divide(F.lit(1.0), c) + F.try_divide(F.lit(1.0), d))
    se_rd = F.sqrt(F.try_divide(p1 * (1 - p1), e1) + F.try_divide(p0 * (1 - p0), e0))
    det, margins = a * d - b * c, e1 * e0 * (a + c) * (b + d)
    return {
        "risk_exposed": p1, "risk_unexposed": p0,
        "risk_ratio": rr, "rr_lower": F.exp(F.log(rr) - z * se_rr), "rr_upper": F.exp(F.log(rr) + z * se_rr),
        "odds_ratio": orr, "or_lower": F.exp(F.log(orr) - z * se_or), "or_upper": F.exp(F.log(orr) + z * se_or),
        "risk_difference": p1 - p0, "rd_lower": p1 - p0 - z * se_rd, "rd_upper": p1 - p0 + z * se_rd,
        "chi2_pearson": F.try_divide(n * det * det, margins), "chi2_mh": F.try_divide((n - 1) * det * det, margins),
        "chi2_yates": F.try_divide(n * F.pow(F.greatest(F.abs(det) - n / 2, F.lit(0.0)), 2), margins),
    }


def _cells(exposed: Column, case: Column) -> list[Column]:
    count = lambda e, k: F.count_if((exposed == e) & (case == k))
    return [count(True, True).alias("a"), count(True, False).alias("b"), count(False, True).alias("c"), count(False, False).alias("d"), F.count_if(exposed.isNull() | case.isNull()).alias("left_out")]


def two_by_two(df: DataFrame, exposed: Column, case: Column, by: Sequence[str] = (), level: int = 95) -> DataFrame:
    """a, b, c, d, left_out, the measures, and warnings (zero cell, small cell)."""
    table = df.groupBy(*by).agg(*_cells(exposed, case))
    low = F.least("a", "b", "c", "d")
    note = F.when(low == 0, "a cell is zero").when(low < SMALL_CELL, "a cell is small")
    return table.select("*", *[v.alias(k) for k, v in risk_measures(F.col("a"), F.col("b"), F.col("c"), F.col("d"), level).items()], note.alias("note"))


def two_by_two_totals(a: float | None, b: float | None, c: float | None, d: float | None) -> None:
    """Refuse a table of totals with a missing or negative cell: missing isn't zero."""
    if any(x is None or x < 0 for x in (a, b, c, d)):
        raise Refusal("each cell of a two-by-two table needs a count of 0 or more")


def exposure_table(df: DataFrame, exposures: Mapping[str, Column], case: Column, level: int = 95) -> DataFrame:
    """One row an exposure: its table, attack rates and risk ratio, in one pass over the records."""
    long = df.select(case.alias("_case"), F.explode(F.create_map(*[x for n, e in exposures.items() for x in (F.lit(n), e.cast("boolean"))])).alias("exposure", "_exposed"))
    return two_by_two(long, F.col("_exposed"), F.col("_case"), ["exposure"], level)


def rate_ratio(df: DataFrame, exposed: Column, cases: Column, time: Column, by: Sequence[str] = (), level: int = 95) -> DataFrame:
    """Two rates by person-time and their ratio with log-normal limits; null where a count is 0."""
    z = Z[level]
    pick = lambda e, v: F.sum(F.when(exposed == e, v))
    t = df.groupBy(*by).agg(pick(True, cases).cast("double").alias("a"), pick(True, time).cast("double").alias("ua"), pick(False, cases).cast("double").alias("b"), pick(False, time).cast("double").alias("ub"))
    ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), F.try_divide(F.try_divide("a", "ua"), F.try_divide("b", "ub")))
    se = F.sqrt(F.try_divide(F.lit(1.0), F.col("a")) + F.try_divide(F.lit(1.0), F.col("b")))
    return t.select("*", ratio.alias("rate_ratio"), F.exp(F.log(ratio) - z * se).alias("lower"), F.exp(F.log(ratio) + z * se).alias("upper"))


def mantel_haenszel(df: DataFrame, exposed: Column, case: Column, strata: Sequence[str], level: int = 95) -> DataFrame:
    """Odds ratio and risk ratio over strata, limits of the risk ratio, and the Mantel-Haenszel chi-square."""
    z = Z[level]
    s = df.groupBy(*strata).agg(*_cells(exposed, case)).select(*[F.col(x).cast("double").alias(x) for x in "abcd"]).withColumn("n", F.expr("a+b+c+d")).where("n > 0")
    t = s.agg(
        F.sum(F.expr("a*d/n")).alias("or_num"), F.sum(F.expr("b*c/n")).alias("or_den"), F.sum(F.expr("a*(c+d)/n")).alias("rr_num"), F.sum(F.expr("c*(a+b)/n")).alias("rr_den"),
        F.sum(F.expr("((a+c)*(a+b)*(c+d) - a*c*n)/(n*n)")).alias("rr_var"), F.sum(F.expr("a - (a+b)*(a+c)/n")).alias("excess"),
        F.sum(F.expr("try_divide((a+b)*(c+d)*(a+c)*(b+d), n*n*(n-1))")).alias("variance"), F.count(F.lit(1)).alias("n_strata"),
    )
    rr, se = F.try_divide("rr_num", "rr_den"), F.sqrt(F.try_divide(F.col("rr_var"), F.col("rr_num") * F.col("rr_den")))
    return t.select("n_strata", F.try_divide("or_num", "or_den").alias("mh_odds_ratio"), rr.alias("mh_risk_ratio"), F.exp(F.log(rr) - z * se).alias("rr_lower"), F.exp(F.log(rr) + z * se).alias("rr_upper"), F.try_divide(F.col("excess") * F.col("excess"), F.col("variance")).alias("mh_chi2"))


def homogeneity(df: DataFrame, exposed: Column, case: Column, strata: Sequence[str]) -> DataFrame:
    """Whether the odds ratios of the strata agree: Breslow and Day's chi-square at the Mantel-Haenszel odds ratio, the same with
    Tarone's correction, and Woolf's (over strata without a zero cell), with the degrees of freedom."""
    s = df.groupBy(*strata).agg(*_cells(exposed, case)).select(*[F.col(x).cast("double").alias(x) for x in "abcd"]).withColumn("n", F.expr("a+b+c+d"))
    s = s.where("a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0")
    common = s.agg(F.expr("sum(a*d/n) / sum(b*c/n)").alias("r"))
    s = s.crossJoin(F.broadcast(common))  # one row
    # the first cell expected at the common odds ratio, from the margins: a root of a quadratic
    s = s.withColumns({"m1": F.expr("a+c"), "e1": F.expr("a+b")}).withColumn("q", F.expr("r * (m1 + e1) + (n - m1 - e1)"))
    root = F.expr("CASE WHEN abs(1 - r) < 1e-12 THEN m1 * e1 / n ELSE (q - sqrt(q*q - 4 * r * (r - 1) * m1 * e1)) / (2 * (r - 1)) END")
    s = s.withColumn("x", root).withColumn("v", F.expr("1 / (1/x + 1/(e1-x) + 1/(m1-x) + 1/(n-m1-e1+x))"))
    whole = F.expr("a > 0 AND b > 0 AND c > 0 AND d > 0")
    s = s.withColumns({"lor": F.when(whole, F.expr("ln(a*d/(b*c))")), "w": F.when(whole, F.expr("1/(1/a+1/b+1/c+1/d)"))})
    t = s.agg(F.count(F.lit(1)).alias("k"), F.first("r").alias("mh_odds_ratio"), F.sum(F.expr("pow(a-x, 2)/v")).alias("bd"), F.sum(F.expr("a-x")).alias("gap"), F.sum("v").alias("vv"), F.sum(F.expr("w*lor*lor")).alias("wll"), F.sum(F.expr("w*lor")).alias("wl"), F.sum("w").alias("ww"), F.count("w").alias("kw"))
    return t.select("mh_odds_ratio", F.col("bd").alias("breslow_day"), F.expr("bd - gap*gap/vv").alias("tarone"), (F.col("k") - 1).alias("df"), F.expr("wll - wl*wl/ww").alias("woolf"), (F.col("kw") - 1).alias("woolf_df"))


@F.pandas_udf(DoubleType())
def binomial_p(x: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of x of n at even chances: twice the smaller tail, at most 1."""

    def one(x: float, n: float) -> float | None:
        if n <= 0:
            return None
        k = int(min(x, n - x))
        return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))

    return pd.Series([one(a, b) for a, b in zip(x, n, strict=True)], dtype="float64")


def matched_pairs_exact(df: DataFrame, exposed_case: Column, exposed_control: Column) -> DataFrame:
    """McNemar's test by the binomial distribution of the discordant pairs: b, c, the exact two-sided p and the mid-p."""
    t = matched_pairs(df, exposed_case, exposed_control).select("b", "c")
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    point = F.exp(_log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) - n * math.log(2))
    return t.select("b", "c", binomial_p(F.col("b"), n).alias("p_exact"), F.when(n > 0, F.least(F.lit(1.0), binomial_p(F.col("b"), n) - F.when(F.col("b") == F.col("c"), 0.0).otherwise(point))).alias("p_mid"))


@F.pandas_udf(DoubleType())
def _log_factorial(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v + 1))


def matched_pairs(df: DataFrame, exposed_case: Column, exposed_control: Column) -> DataFrame:
    """McNemar's test: discordant pairs b and c, odds ratio b / c, chi-square with and without correction."""
    t = df.agg(F.count_if(exposed_case & ~exposed_control).cast("double").alias("b"), F.count_if(~exposed_case & exposed_control).cast("double").alias("c"))
    return t.select("b", "c", F.try_divide("b", "c").alias("odds_ratio"), F.try_divide(F.expr("(b-c)*(b-c)"), F.expr("b+c")).alias("chi2"), F.try_divide(F.expr("pow(greatest(abs(b-c)-1, 0), 2)"), F.expr("b+c")).alias("chi2_corrected"))


def trend(df: DataFrame, score: Column, case: Column) -> DataFrame:
    """Chi-square for a trend of cases over exposure scores (extended Mantel-Haenszel)."""
    t = df.where(score.isNotNull() & case.isNotNull()).groupBy(score.cast("double").alias("x")).agg(F.count_if(case).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("m"))
    s = t.agg(F.sum("k").alias("kk"), F.sum("m").alias("n"), F.sum(F.expr("k*x")).alias("t1"), F.sum(F.expr("m*x")).alias("t2"), F.sum(F.expr("m*x*x")).alias("t3"))
    chi = F.try_divide(F.expr("pow(t1 - kk*t2/n, 2)"), F.expr("kk*(n-kk)*(n*t3 - t2*t2)/(n*n*(n-1))"))
    return s.select("kk", "n", chi.alias("chi2_trend"))


def means(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, total, mean, variance, deviation, quartiles and extremes of the known values."""
    v = value.cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("deviation"), F.min(v).alias("low"), F.percentile(v, 0.25).alias("q1"), F.median(v).alias("median"), F.percentile(v, 0.75).alias("q3"), F.max(v).alias("high"))


def frequencies(df: DataFrame, column: str, level: int = 95) -> DataFrame:
    """Counts of a column's values, their share and its Wilson limits."""
    from pyspark.sql import Window

    z = Z[level]
    t = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double"))
    p, n = F.col("n") / F.col("total"), F.col("total")
    half, mid = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), p + z * z / (2 * n)
    return t.select("value", "n", p.alias("share"), ((mid - half) / (1 + z * z / n)).alias("lower"), ((mid + half) / (1 + z * z / n)).alias("upper"))


def comparison_size(p1: float, p0: float, ratio: float = 1.0, power: float = 0.8, level: int = 95) -> tuple[int, int]:
    """Records in the first and second group that show a difference of two shares (Kelsey's formula)."""
    beta = POWER_Z[round(power * 100)]
    mean = (p1 + ratio * p0) / (1 + ratio)
    n = (Z[level] + beta) ** 2 * mean * (1 - mean) * (ratio + 1) / (ratio * (p1 - p0) ** 2)
    return math.ceil(n), math.ceil(ratio * n)


def survey_size(population: float, expected: float, margin: float, level: int = 95) -> int:
    """Records to draw for a share within a margin, with the finite population correction."""
    n = Z[level] ** 2 * expected * (1 - expected) / margin**2
    return math.ceil(n / (1 + (n - 1) / population)) if population else math.ceil(n)


@F.pandas_udf(DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p of two-by-two tables: all tables as likely as the given one, or less."""

    def one(a: int, b: int, c: int, d: int) -> float | None:
        r, k, n = a + b, a + c, a + b + c + d
        if min(a, b, c, d) < 0 or not n:
            return None
        lf = math.lgamma
        fixed = lf(r + 1) + lf(n - r + 1) + lf(k + 1) + lf(n - k + 1) - lf(n + 1)
        chance = lambda x: fixed - lf(x + 1) - lf(r - x + 1) - lf(k - x + 1) - lf(n - r - k + x + 1)
        own = chance(a)
        return min(1.0, sum(math.exp(p) for x in range(max(0, r + k - n), min(r, k) + 1) if (p := chance(x)) <= own + 1e-9))

    return pd.Series([one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype="float64")


#: Which measures a design licences.
DESIGNS = {"cohort": ("risk_ratio", "odds_ratio", "risk_difference"), "case-control": ("odds_ratio",), "cross-sectional": ("risk_ratio", "odds_ratio", "risk_difference"), "trial": ("risk_ratio", "odds_ratio", "risk_difference")}


def under_design(table: DataFrame, design: str) -> OpResult:
    """A two-by-two result without the measures that the study's design does not licence. Report: the measures withheld."""
    if design not in DESIGNS:
        raise Refusal(f"no such design: {design}")
    prefix = {"risk_ratio": ("risk_ratio", "rr_lower", "rr_upper", "risk_exposed", "risk_unexposed"), "odds_ratio": ("odds_ratio", "or_lower", "or_upper"), "risk_difference": ("risk_difference", "rd_lower", "rd_upper")}
    withheld = [m for m in prefix if m not in DESIGNS[design]]
    out = table.drop(*[c for m in withheld for c in prefix[m]])
    if design == "cross-sectional":
        out = out.withColumnsRenamed({"risk_ratio": "prevalence_ratio", "risk_difference": "prevalence_difference"})
    return OpResult(out, {"withheld": table.sparkSession.createDataFrame([(m,) for m in withheld], "measure string")})


FAR_OUT = 12.0  # standard deviations around the mode beyond which a cell's chance is below rounding


def _cell_chances(a: float, b: float, c: float, d: float, log_odds: float) -> tuple[int, np.ndarray]:
    """The first value and the chances of the first cell, its margins given, at an odds ratio; only around the mode."""
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, int(r + k - n)), int(min(r, k))
    odds = math.exp(min(max(log_odds, -600), 600))
    # the mode, from the quadratic whose root is the value expected at this odds ratio
    q = n - r - k + odds * (r + k)
    mode = r * k / n if abs(odds - 1) < 1e-9 else (q - math.sqrt(max(0.0, q * q - 4 * odds * (odds - 1) * r * k))) / (2 * (odds - 1))
    mode = min(max(mode, low), high)
    spread = math.sqrt(1 / (1 / (mode + 0.5) + 1 / (r - mode + 0.5) + 1 / (k - mode + 0.5) + 1 / (n - r - k + mode + 0.5)))
    first, last = max(low, int(mode - FAR_OUT * spread - 3)), min(high, int(mode + FAR_OUT * spread + 4))
    x = np.arange(first, last + 1, dtype=float)
    steps = np.log((r - x[:-1]) * (k - x[:-1])) - np.log((x[1:]) * (n - r - k + x[1:])) + log_odds
    log = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log - log.max())
    return first, p / p.sum()


def _summed(tables: list[tuple[float, float, float, float, int]], log_odds: float) -> tuple[int, np.ndarray]:
    """The first value and the chances of the sum of first cells over strata (a, b, c, d, and how many strata are alike)."""
    start, out = 0, np.ones(1)

    def times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if min(len(p), len(q)) < 256:
            return np.convolve(p, q)
        size = 1 << (len(p) + len(q) - 2).bit_length()
        return np.maximum(np.fft.irfft(np.fft.rfft(p, size) * np.fft.rfft(q, size), size)[: len(p) + len(q) - 1], 0.0)

    def trimmed(at: int, p: np.ndarray) -> tuple[int, np.ndarray]:
        some = np.flatnonzero(p > 1e-25)
        return at + int(some[0]), p[some[0] : some[-1] + 1]

    for a, b, c, d, alike in tables:
        at, p = _cell_chances(a, b, c, d, log_odds)
        while alike:
            if alike & 1:
                start, out = trimmed(start + at, times(out, p))
            alike >>= 1
            if alike:
                at, p = trimmed(2 * at, times(p, p))
    return start, out / out.sum()


def _root(f: Callable[[float], float]) -> float:
    """Where a rising function of the log odds ratio crosses 0, by halving."""
    low, high = -1.0, 1.0
    while f(low) > 0 and low > -400:
        low *= 2
    while f(high) < 0 and high < 400:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return math.exp((low + high) / 2)


def conditional_odds(tables: list[tuple[float, float, float, float, int]], level: float = 0.95) -> dict[str, float | None]:
    """Conditional maximum-likelihood odds ratio over strata, its exact and mid-p limits, and the exact and mid-p tests of 1 (twice the smaller tail)."""
    tables = [t for t in tables if min(t[0] + t[1], t[2] + t[3], t[0] + t[2], t[1] + t[3]) > 0]
    names = ("odds_ratio", "lower", "upper", "mid_lower", "mid_upper", "p_exact", "p_mid")
    if not tables:
        return dict.fromkeys(names)
    seen = sum(t[0] * t[4] for t in tables)
    least = sum(max(0, t[0] + t[1] + t[0] + t[2] - sum(t[:4])) * t[4] for t in tables)
    most = sum(min(t[0] + t[1], t[0] + t[2]) * t[4] for t in tables)

    def mean(log_odds: float) -> float:
        total = 0.0
        for *cells, alike in tables:
            at, p = _cell_chances(*cells, log_odds)
            total += alike * float((p * (at + np.arange(len(p)))).sum())
        return total

    def tails(log_odds: float) -> tuple[float, float, float]:
        """Chances of a smaller, the same, and a larger sum."""
        at, p = _summed(tables, log_odds)
        i = int(seen - at)
        below, own = float(p[: max(0, i)].sum()), float(p[i]) if 0 <= i < len(p) else 0.0
        return below, own, float(p[max(0, i + 1) :].sum())

    half = (1 - level) / 2
    below, own, above = tails(0.0)
    out: dict[str, float | None] = {"p_exact": min(1.0, 2 * (own + min(below, above))), "p_mid": min(1.0, 2 * (own / 2 + min(below, above)))}
    inner = least < seen < most
    out["odds_ratio"] = _root(lambda t: mean(t) - seen) if inner else 0.0 if seen == least < most else float("inf") if seen == most > least else None
    for name, share in (("lower", 1.0), ("mid_lower", 0.5)):
        out[name] = _root(lambda t, s=share: (x := tails(t))[2] + s * x[1] - half) if seen > least else 0.0
    for name, share in (("upper", 1.0), ("mid_upper", 0.5)):
        out[name] = _root(lambda t, s=share: half - (x := tails(t))[0] - s * x[1]) if seen < most else float("inf")
    return out if least < most else dict.fromkeys(names)


def exact_odds_ratio(df: DataFrame, exposed: Column, case: Column, strata: Sequence[str], by: Sequence[str] = (), level: int = 95) -> DataFrame:
    """by, n_strata, odds_ratio (conditional), exact and mid-p limits and p over strata; null where no stratum can vary.

    Spark counts the strata and then how many have the same four cells, so a task holds one row for each different table of its group;
    a table's work is bounded by ``FAR_OUT`` standard deviations, not by its counts."""
    s = df.groupBy(*by, *strata).agg(*_cells(exposed, case))
    alike = s.groupBy(*by, *[F.col(x).cast("double").alias(x) for x in "abcd"]).agg(F.count(F.lit(1)).alias("alike"))
    names = ("odds_ratio", "lower", "upper", "mid_lower", "mid_upper", "p_exact", "p_mid")
    kinds = dict(alike.dtypes)

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = conditional_odds([(*map(float, r[:4]), int(r[4])) for r in pdf[["a", "b", "c", "d", "alike"]].itertuples(index=False, name=None)], level / 100)
        return pd.DataFrame([[*key[: len(by)], int(pdf["alike"].sum()), *[found[n] for n in names]]], columns=[*by, "n_strata", *names])

    solve.__annotations__ = {}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n_strata long", *[f"{n} double" for n in names]])
    group = [F.col(c) for c in by] or [F.lit(1).alias("_all")]
    return alike.groupBy(*group).applyInPandas(solve, schema)
