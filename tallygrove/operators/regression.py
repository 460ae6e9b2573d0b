"""Logistic and Poisson regression on whole tables: one aggregation an iteration.

Newton's method (IRLS) needs the weighted cross products of the columns, which are sums: each iteration is one job whose
partial sums Spark combines before its only shuffle, and the driver solves a system of at most ``MOST_COLUMNS`` unknowns.
The design is stored once, so no iteration reads the source again. Strata of a Poisson model are absorbed: given the total
of a stratum its constant drops out, and each iteration sums by stratum before it sums over strata.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.measures import Z
from tallygrove.operators.tables import numbered
from tallygrove.report import OpResult, Refusal, stored

MOST_COLUMNS = 32
ERRORS = ("model", "overdispersed", "hac", "profile")
BLOCK = 4096  # records of a block of the ordered sequence
FAR = 600.0  # exponents are held within this


@dataclass
class Fit:
    """beta, inverse information, records used, deviance, Pearson's chi-square, iterations, strata used and without any count."""

    beta: np.ndarray
    inverse: np.ndarray
    n: int
    deviance: float
    pearson: float
    steps: int
    strata: int = 0
    dropped: int = 0


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _columns(numeric: Mapping[str, Column], categories: Mapping[str, tuple[Column, Sequence[str]]], constant: bool) -> dict[str, Column]:
    """The constant (without strata), the numbers, and one indicator for each category but the first (the reference)."""
    columns = ({"(constant)": F.lit(1.0)} if constant else {}) | {n: _finite(c) for n, c in numeric.items()}
    for n, (c, levels) in categories.items():
        for level in levels[1:]:
            columns[f"{n}={level}"] = F.when(c.isin(*levels), (c == level).cast("double"))
    if not columns or len(columns) > MOST_COLUMNS:
        raise Refusal(f"{len(columns)} columns; 1 to {MOST_COLUMNS}")
    return columns


def _eta(xs: Sequence[str], beta: np.ndarray) -> Column:
    eta = F.col("_o") + sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    return F.greatest(F.least(eta, F.lit(FAR)), F.lit(-FAR))


def _triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


def _first(df: DataFrame, sums: Sequence[Column]) -> list[float]:
    return [float(v or 0.0) for v in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]


def _pass(d: DataFrame, xs: Sequence[str], beta: np.ndarray, family: str) -> tuple[list[float], list[float], list[float]]:
    """Information, score, and (deviance, n, Pearson, 0, 0) at beta, in one job."""
    eta, y, n = _eta(xs, beta), F.col("_y"), F.col("_n")
    if family == "logistic":
        mu = 1 / (1 + F.exp(-eta))
        weight = mu * (1 - mu)
        deviance = -2 * F.when(y > 0, F.log(mu)).otherwise(F.log(1 - mu))
    else:
        mu = weight = F.exp(eta)
        deviance = 2 * (F.when(y > 0, y * F.log(F.when(y > 0, y) / mu)).otherwise(0.0) - (y - mu))
    t = d.select("_y", "_n", *xs, mu.alias("_m"), (n * weight).alias("_w"), (n * deviance).alias("_d"))
    w, r = F.col("_w"), F.col("_y") - F.col("_m")
    sums = [F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in _triangle(len(xs))] + [F.sum(n * r * F.col(x)) for x in xs]
    got = _first(t, sums + [F.sum("_d"), F.sum("_n"), F.sum(F.when(w > 0, n * n * r * r / F.when(w > 0, w)))])
    cut = len(_triangle(len(xs)))
    return got[:cut], got[cut:-3], [*got[-3:], 0.0, 0.0]


def _strata_sums(d: DataFrame, xs: Sequence[str], ss: Sequence[str], beta: np.ndarray) -> DataFrame:
    """A row for each stratum: total count, and the sums of exp(eta) and its products with the columns."""
    t = d.withColumn("_e", F.exp(_eta(xs, beta)))
    e, y, n = F.col("_e"), F.col("_y"), F.col("_n")
    products = [F.sum(n * e * F.col(xs[i]) * F.col(xs[j])).alias(f"_p{i}_{j}") for i, j in _triangle(len(xs))]
    means = [F.sum(n * e * F.col(x)).alias(f"_ex{i}") for i, x in enumerate(xs)]
    scores = [F.sum(n * y * F.col(x)).alias(f"_yx{i}") for i, x in enumerate(xs)]
    rest = [F.sum(n * e).alias("_all"), F.sum(n * y).alias("_count"), F.sum("_n").alias("_rows"), F.sum(n * y * y / e).alias("_yye")]
    logs = F.sum(n * F.when(y > 0, y * (F.log(F.when(y > 0, y)) - F.log(e))).otherwise(0.0)).alias("_l")
    return t.groupBy(*ss).agg(*products, *means, *scores, *rest, logs)


def _strata_pass(d: DataFrame, xs: Sequence[str], ss: Sequence[str], beta: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    s, total, e = _strata_sums(d, xs, ss, beta), F.col("_count"), F.col("_all")
    some = total > 0
    sums = [F.sum(F.when(some, total * (F.col(f"_p{i}_{j}") / e - F.col(f"_ex{i}") * F.col(f"_ex{j}") / e / e))) for i, j in _triangle(len(xs))]
    sums += [F.sum(F.when(some, F.col(f"_yx{i}") - total * F.col(f"_ex{i}") / e)) for i in range(len(xs))]
    sums += [F.sum(F.when(some, 2 * (F.col("_l") - total * F.log(F.when(some, total) / e)))), F.sum(F.when(some, F.col("_rows")))]
    sums += [F.sum(F.when(some, F.col("_yye") * e / F.when(some, total) - total)), F.count_if(some), F.count_if(~some)]
    got = _first(s, sums)
    cut = len(_triangle(len(xs)))
    return got[:cut], got[cut:-5], got[-5:]


def _fit(d: DataFrame, xs: Sequence[str], ss: Sequence[str], family: str, beta: np.ndarray, rounds: int, tolerance: float) -> Fit:
    k, last = len(xs), np.inf
    for steps in range(1, rounds + 1):
        information, score, (now, n, pearson, used, dropped) = _strata_pass(d, xs, ss, beta) if ss else _pass(d, xs, beta, family)
        info = _square(information, k)
        if ss and not used:
            raise Refusal("no stratum has any count")
        if n <= k or not np.isfinite(info).all() or np.linalg.matrix_rank(info) < k:
            raise Refusal("the columns don't tell the coefficients apart (too few records, or one column follows from others)")
        step = np.linalg.solve(info, np.array(score))
        if abs(last - now) <= tolerance * (abs(now) + tolerance) and np.abs(step).max() < 1e-6:
            return Fit(beta, np.linalg.inv(info), int(n), now, pearson, steps, int(used), int(dropped))
        beta, last = beta + step, now
    raise Refusal("the estimates did not settle: a column may separate the outcomes")


def _hac(d: DataFrame, xs: Sequence[str], ss: Sequence[str], ts: Sequence[str], family: str, fit: Fit, lag: int) -> np.ndarray:
    """Newey and West's covariance with Bartlett weights over the records in their order.

    The weights 1 - l / (lag + 1) come about by themselves as the mean of squared sums over all windows of lag + 1 records,
    those that reach over the ends included. Windows are taken within blocks of the sequence; the first ``lag`` records of a
    block are copied to the block before it, so no task holds more than a block.
    """
    k = len(xs)
    eta = _eta(xs, fit.beta)
    if ss:
        sums = _strata_sums(d, xs, ss, fit.beta).select(*ss, "_all", "_count", *[f"_ex{i}" for i in range(k)])
        rows = d.join(sums, list(ss))
        residual = F.col("_y") - F.col("_count") * F.exp(eta) / F.col("_all")
        centred = [F.col(x) - F.col(f"_ex{i}") / F.col("_all") for i, x in enumerate(xs)]
    else:
        rows, residual, centred = d, F.col("_y") - (1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta)), [F.col(x) for x in xs]
    us = [f"_u{i}" for i in range(k)]
    placed = numbered(rows.select(*ts, *[(c * residual).alias(u) for u, c in zip(us, centred, strict=True)]), ts, "_p").withColumn("_p", F.col("_p") - 1)
    size = max(BLOCK, 4 * (lag + 1))
    block = F.floor(F.col("_p") / size)
    homes = F.when((F.col("_p") % size < lag) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = placed.select("_p", *us, block.alias("_own"), F.explode(homes).alias("_block"))
    before = d.sparkSession.range(lag).select((F.col("id") - lag).alias("_p"), *[F.lit(0.0).alias(u) for u in us], F.lit(0).cast("long").alias("_own"), F.lit(0).cast("long").alias("_block"))
    window = Window.partitionBy("_block").orderBy("_p").rowsBetween(0, lag)
    summed = rows.unionByName(before).select("_own", "_block", *[F.sum(u).over(window).alias(u) for u in us]).where("_own = _block")
    got = _first(summed, [F.sum(F.col(us[i]) * F.col(us[j])) / (lag + 1) for i, j in _triangle(k)])
    return fit.inverse @ _square(got, k) @ fit.inverse


def _limit(d: DataFrame, xs: Sequence[str], ss: Sequence[str], family: str, fit: Fit, j: int, way: int, z: float, rounds: int, tolerance: float) -> float:
    """Where the deviance, refitted with coefficient j held there, has risen by z squared; infinite where it never does."""
    others = [x for i, x in enumerate(xs) if i != j]
    start = {"beta": np.delete(fit.beta, j)}

    def beyond(at: float) -> float:
        held = d.withColumn("_o", F.col("_o") + F.col(xs[j]) * at)
        try:
            got = _fit(held, others, ss, family, start["beta"], rounds, tolerance)
        except Refusal:
            return math.inf
        start["beta"] = got.beta
        return math.sqrt(max(0.0, got.deviance - fit.deviance)) - z

    near, f_near, far = float(fit.beta[j]), -z, float(fit.beta[j])
    step = z * max(math.sqrt(fit.inverse[j, j]), 1e-3)
    for _ in range(20):
        far += way * step
        f_far = beyond(far)
        if f_far >= 0:
            break
        near, f_near, step = far, f_far, step / 2 if f_far > -z / 4 else step * 2
    else:
        return way * math.inf
    for _ in range(80):
        if abs(far - near) < 1e-8 or abs(f_far) < 1e-9:
            break
        mid = (near + far) / 2 if math.isinf(f_far) else near - f_near * (far - near) / (f_far - f_near)
        f = beyond(mid)
        if f >= 0:
            far, f_far, f_near = mid, f, f_near / 2
        else:
            near, f_near = mid, f
            if not math.isinf(f_far):
                f_far /= 2
        if abs(f) < 1e-7:
            return mid
    return far


def regress(
    df: DataFrame, outcome: Column, numeric: Mapping[str, Column], categories: Mapping[str, tuple[Column, Sequence[str]]] | None = None, family: str = "logistic", offset: Column | None = None, level: int = 95,
    rounds: int = 30, tolerance: float = 1e-9, strata: Sequence[str] = (), errors: str = "model", order: Sequence[str] = (), lag: int = 0, profiled: Sequence[str] | None = None,
) -> OpResult:
    """term, estimate, error, ratio (exponential of the estimate), lower, upper, p.

    ``strata``: columns whose combinations each have a constant of their own (Poisson only); a stratum without any count tells
    nothing and is left out. ``errors``: ``model``; ``overdispersed``, scaled by Pearson's chi-square over its degrees of
    freedom, at least 1; ``hac``, over the records in ``order`` (columns without ties; a tie takes any order) up to ``lag``
    records apart; ``profile``, likelihood-ratio limits of the terms ``profiled`` (all but the constant).

    Records with an unknown value, a blank stratum or a negative count are left out. Reports: ``fit``, and ``left_out`` with
    the first reason of each.
    """
    if family not in ("logistic", "poisson"):
        raise Refusal(f"no such family: {family}")
    if errors not in ERRORS or level not in Z:
        raise Refusal(f"no such errors or level: {errors}, {level}")
    if family == "logistic" and (strata or offset is not None):
        raise Refusal("strata and an offset are for Poisson models")
    if errors == "hac" and (not order or lag < 0):
        raise Refusal("errors over a sequence need its order and a lag")
    if len(set(strata)) != len(strata) or set(strata) & (set(numeric) | set(categories or {})):
        raise Refusal("a column is named twice")
    columns = _columns(numeric, categories or {}, not strata)
    names, k = list(columns), len(columns)
    xs, ss, ts = [f"_x{i}" for i in range(k)], [f"_s{i}" for i in range(len(strata))], [f"_t{i}" for i in range(len(order) if errors == "hac" else 0)]
    y = _finite(outcome)
    y = F.when(y.isin(0.0, 1.0), y) if family == "logistic" else F.when(y >= 0, y)
    labels = [F.trim(F.col(c).cast("string")) for c in strata]
    known = {"outcome": y, "offset": F.lit(0.0) if offset is None else _finite(offset)} | columns | {f"stratum {c}": F.when(v != "", v) for c, v in zip(strata, labels, strict=True)}
    d = df.select(*[v.alias(a) for a, v in zip(["_y", "_o", *xs, *ss], known.values(), strict=True)], *[F.col(c).alias(a) for c, a in zip(order, ts)])
    why = F.coalesce(*[F.when(F.col(a).isNull(), F.lit(n)) for a, n in zip(["_y", "_o", *xs, *ss], known, strict=True)])
    every = stored(d.withColumn("_why", why), "design")
    d = every.where("_why is null").drop("_why")
    total, n, some, expected, *means = _first(every, [F.count(F.lit(1)), F.count_if(F.col("_why").isNull()), *[F.sum(F.when(F.col("_why").isNull(), c)) for c in (F.col("_y"), F.exp(F.least(F.col("_o"), F.lit(FAR))))], *[F.avg(F.when(F.col("_why").isNull(), F.col(x))) for x in xs]])
    if n <= k:
        raise Refusal("too few records have every value")
    beta = np.zeros(k)
    if strata:  # constants of the strata take up any shift of a column
        d = d.withColumns({x: F.col(x) - m for x, m in zip(xs, means, strict=True)})
    elif family == "logistic":
        share = min(max(some / n, 1e-6), 1 - 1e-6)
        beta[0] = math.log(share / (1 - share))
    elif some > 0 and expected > 0:
        beta[0] = math.log(some / expected)
    if errors == "profile" or not numeric and offset is None and not ts:  # equal records count as one with a weight
        d = stored(d.groupBy("_y", "_o", *xs, *ss).agg(F.count(F.lit(1)).cast("double").alias("_n")), "patterns")
    else:
        d = d.withColumn("_n", F.lit(1.0))
    fit = _fit(d, xs, ss, family, beta, rounds, tolerance)
    freedom = fit.n - k - fit.strata
    dispersion = fit.pearson / freedom if freedom > 0 else math.nan
    covariance = _hac(d, xs, ss, ts, family, fit, lag) if errors == "hac" else fit.inverse * (max(1.0, dispersion) if errors == "overdispersed" else 1.0)
    z = Z[level]
    rows = []
    for j, (name, b, e) in enumerate(zip(names, fit.beta, np.sqrt(np.diag(covariance)), strict=True)):
        low, high = b - z * e, b + z * e
        if errors == "profile" and (name in profiled if profiled is not None else name != "(constant)"):
            if k < 2:
                raise Refusal("a likelihood-ratio limit needs at least one other column to refit")
            low, high = (_limit(d, xs, ss, family, fit, j, way, z, rounds, tolerance) for way in (-1, 1))
        with np.errstate(over="ignore"):
            rows.append((name, float(b), float(e), float(np.exp(b)), float(np.exp(low)), float(np.exp(high)), math.erfc(abs(b / e) / math.sqrt(2))))
    spark = df.sparkSession
    about = [(fit.n, int(total - fit.n), fit.steps, fit.deviance, dispersion, freedom, fit.strata, fit.dropped)]
    return OpResult(
        spark.createDataFrame(rows, "term string, estimate double, error double, ratio double, lower double, upper double, p double"),
        {
            "fit": spark.createDataFrame(about, "n long, left_out long, iterations int, deviance double, dispersion double, freedom long, strata_used long, strata_dropped long"),
            "left_out": every.where("_why is not null").groupBy(F.col("_why").alias("unknown")).agg(F.count(F.lit(1)).alias("n")),
        },
    )


def spline_basis(x: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """B-spline columns over clamped knots (both ends included), without the first, which the constant stands for."""
    t = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    n = len(t) - 1
    last = max(i for i in range(n) if t[i] < t[i + 1])
    basis = [F.when((x >= t[i]) & ((x < t[i + 1]) | (F.lit(i == last) & (x == t[i + 1]))), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(n)]
    for d in range(1, degree + 1):
        nxt = []
        for i in range(n - d):
            term = F.lit(0.0)
            if t[i + d] > t[i]:
                term = term + (x - t[i]) / (t[i + d] - t[i]) * basis[i]
            if t[i + d + 1] > t[i + 1]:
                term = term + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1]
            nxt.append(term)
        basis = nxt
    return basis[1:]
