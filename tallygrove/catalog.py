"""The registered queries of the engine's own operators over the driver's tables, and their DuckDB counterparts.

The driver's tables hold no unknown values, no unmatched keys and no places. Where an operator is about those, the query
and its SQL make them in the same way: a value is unknown on some line numbers, a table lacks some keys, a place follows
from a key by fixed arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.functions import values
from tallygrove.operators import dedup, geo, graph, measures, network, overlay, raster, register, regression, relate, rules, scan, series, tables
from tallygrove.report import shared_path
from tallygrove.sources import geotiff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


def gappy(c: str) -> Column:
    """Unknown on every third line number."""
    return F.when(F.col("l_linenumber") % 3 != 0, F.col(c))


GAPPY = "CASE WHEN l_linenumber % 3 <> 0 THEN {} END"
LON, LAT = "((c_custkey * 37) % 3600) / 10.0 - 180", "((c_custkey * 53) % 1200) / 10.0 - 60"
S_LON, S_LAT = "((s_suppkey * 71) % 3600) / 10.0 - 180", "((s_suppkey * 29) % 1200) / 10.0 - 60"


def places(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(LON).cast("double").alias("lon"), F.expr(LAT).cast("double").alias("lat"), F.col("c_acctbal").alias("weight"), F.col("c_mktsegment").alias("segment"))


# --- the flagship: relate, group, compare ---------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT c_mktsegment AS segment, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT segment, CAST(count(*) FILTER (WHERE urgent) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1),
    ref AS (SELECT a AS ra, n AS rn FROM g WHERE segment = 'MACHINERY')
    SELECT segment, CAST(a AS BIGINT) AS cases, CAST(n AS BIGINT) AS at_risk, round(1000 * a / n, 4) AS rate, round((a / n) / (ra / rn), 4) AS risk_ratio,
      round(exp(ln((a / n) / (ra / rn)) - 1.959963984540054 * sqrt((n - a) / (a * n) + (rn - ra) / (ra * rn))), 4) AS rr_lower,
      round(exp(ln((a / n) / (ra / rn)) + 1.959963984540054 * sqrt((n - a) / (a * n) + (rn - ra) / (ra * rn))), 4) AS rr_upper
    FROM g, ref"""
)
def flagship_relate_group_compare(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    related = relate.relate(orders, t(spark, d, "customer"), [("o_custkey", "c_custkey")], "c_mktsegment", name="segment").df
    counts = related.groupBy("segment").agg(F.count_if("urgent").alias("cases"), F.count(F.lit(1)).alias("at_risk"))
    reference = F.broadcast(counts.where("segment = 'MACHINERY'").select(F.col("cases").alias("ra"), F.col("at_risk").alias("rn")))  # one row
    both = counts.crossJoin(reference)
    m = measures.risk_measures(F.col("cases"), F.col("at_risk") - F.col("cases"), F.col("ra"), F.col("rn") - F.col("ra"))
    return both.select("segment", "cases", "at_risk", r(F.col("cases") * 1000 / F.col("at_risk")).alias("rate"), *[r(m[k]).alias(k) for k in ("risk_ratio", "rr_lower", "rr_upper")])


# --- selecting ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')")
def select_values(spark: SparkSession, d: str) -> DataFrame:
    return tables.select_values(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "1-URGENT"]).df


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT')")
def leave_out(spark: SparkSession, d: str) -> DataFrame:
    return tables.leave_out(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "1-URGENT"])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'")
def select_range_date(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.lit("1995-03-01").cast("timestamp_ntz"), F.lit("1995-10-01").cast("timestamp_ntz")
    pruned = t(spark, d, "orders").where((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))  # reaches the reader's statistics
    return tables.select_range(pruned.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")), "o_orderdate", "1995-03-01", "1995-09-30", "date")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def select_range_number(spark: SparkSession, d: str) -> DataFrame:
    return tables.select_range(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10.0, 12.0)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 50")
def top_k_blanks_last(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").withColumn("known", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return tables.sort_blanks_last(c, "known", True, True, ["c_custkey"]).limit(50).drop("known")


# --- grouping -------------------------------------------------------------------------------------------------------

_AGG = {"sum": "sum", "min": "min", "max": "max", "mean": "avg", "median": "median"}


def _group(how: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = tables.group(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity" if how != "count" else F.lit(1), how)
        return g.withColumn("value", r("value") if how != "count" else F.col("value"))

    run.__name__ = f"group_{how}"
    sql = "count(*)" if how == "count" else f"round({_AGG[how]}(l_quantity), 4)"
    query(f"SELECT l_returnflag, l_linestatus, {sql} AS value FROM lineitem GROUP BY 1, 2")(run)


for _how in tables.STATISTICS:
    _group(_how)

_G = GAPPY.format("l_quantity")


@query(f"SELECT l_suppkey, l_returnflag, CASE WHEN count(*) FILTER (WHERE ({_G}) IS NULL) = 0 THEN round(sum({_G}), 4) END AS value FROM lineitem GROUP BY 1, 2")
def group_null_unknown(spark: SparkSession, d: str) -> DataFrame:
    g = tables.group(t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], gappy("l_quantity"))
    return g.withColumn("value", r("value"))


@query(f"SELECT l_linenumber, round(coalesce(sum({_G}), 0), 4) AS total, round(avg({_G}), 4) AS mean, median({_G}) AS median FROM lineitem GROUP BY 1")
def group_exclude_missing(spark: SparkSession, d: str) -> DataFrame:
    v = gappy("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_linenumber").agg(r(tables.statistic(v, "sum", True)).alias("total"), r(tables.statistic(v, "mean", True)).alias("mean"), tables.statistic(v, "median", True).alias("median"))


@query("""WITH g AS (SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
    SELECT *, floor(value / sum(value) OVER (PARTITION BY o_orderstatus) * 1000 + 0.5) / 10 AS share FROM g""")
def shares_within(spark: SparkSession, d: str) -> DataFrame:
    return tables.shares(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], F.lit(1.0))


@query("""WITH g AS (SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
    SELECT *, floor(value / sum(value) OVER () * 1000 + 0.5) / 10 AS share FROM g""")
def shares_all(spark: SparkSession, d: str) -> DataFrame:
    return tables.shares(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [], F.lit(1.0))


@query("""WITH cells AS (SELECT l_returnflag AS rk, l_linenumber AS ck, CASE WHEN l_linenumber <> 3 OR l_returnflag <> 'A' THEN sum(l_quantity) END AS cell FROM lineitem GROUP BY 1, 2),
    c AS (SELECT rk, ck, sum(cell) AS total, count(cell) AS known, grouping(rk) AS gr, grouping(ck) AS gc FROM cells GROUP BY CUBE (rk, ck)),
    n AS (SELECT count(DISTINCT rk) AS nr, count(DISTINCT ck) AS nc FROM cells)
    SELECT rk AS row_key, ck AS column_key, CASE WHEN known = (CASE gr WHEN 1 THEN nr ELSE 1 END) * (CASE gc WHEN 1 THEN nc ELSE 1 END) THEN round(total, 4) END AS total FROM c, n""")
def crosstab_totals(spark: SparkSession, d: str) -> DataFrame:
    value = F.when((F.col("l_linenumber") != 3) | (F.col("l_returnflag") != "A"), F.col("l_quantity"))
    return tables.crosstab(t(spark, d, "lineitem"), "l_returnflag", "l_linenumber", value).withColumn("total", r("total"))


# --- shapes ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def melt_wide(spark: SparkSession, d: str) -> DataFrame:
    return tables.melt(t(spark, d, "part"), ["p_partkey"], {"p_size": "size", "p_retailprice": "price"})


@query("""SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O" FROM orders GROUP BY 1""")
def pivot_long(spark: SparkSession, d: str) -> DataFrame:
    long = tables.group(t(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice")
    return tables.pivot_long(long, ["o_custkey"], "o_orderstatus", "value", ["F", "O"]).withColumns({"F": r("F"), "O": r("O")})


@query("SELECT 'l_returnflag' AS \"column\", l_returnflag AS value FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem GROUP BY ALL")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return tables.distinct_values(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.repeated_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS origin FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier")
def append_source_label(spark: SparkSession, d: str) -> DataFrame:
    c, s = t(spark, d, "customer").drop("c_custkey"), t(spark, d, "supplier").drop("s_suppkey")
    up = {"customer": {"c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}, "supplier": {"s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}}
    return tables.append({"customer": c, "supplier": s}, "origin", up)


# --- relating -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 10")
def relate_drop(spark: SparkSession, d: str) -> DataFrame:
    return relate.relate(t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").where("n_nationkey < 10"), [("c_nationkey", "n_nationkey")], "n_name", name="nation").df.drop("c_nationkey")


@query("SELECT c_custkey, coalesce(n_name, '(unmatched)') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey")
def relate_keep_label(spark: SparkSession, d: str) -> DataFrame:
    return relate.relate(t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").where("n_nationkey < 10"), [("c_nationkey", "n_nationkey")], "n_name", "keep", "(unmatched)", name="nation").df.drop("c_nationkey")


@query("SELECT c_custkey, o_orderpriority AS priority FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) ON c_custkey = o_custkey")
def relate_each(spark: SparkSession, d: str) -> DataFrame:
    return relate.relate(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), [("c_custkey", "o_custkey")], "o_orderpriority", several="each", name="priority").df


@query("""SELECT l_orderkey, l_linenumber, l_partkey, f.flag FROM lineitem l JOIN (SELECT l_suppkey AS s, l_partkey AS p, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) f ON l.l_suppkey = f.s AND l.l_partkey = f.p""")
def relate_composite_key(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    flags = lines.groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    return relate.relate(lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), flags, [("l_suppkey", "l_suppkey"), ("l_partkey", "l_partkey")], "flag").df.drop("l_suppkey")


@query("""WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), rr AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey < 10)
    SELECT count(*) FILTER (WHERE rr.k IS NULL) AS left_only, count(*) FILTER (WHERE rr.k IS NOT NULL AND l.k IS NOT NULL) AS matched, count(*) FILTER (WHERE l.k IS NULL) AS right_only FROM l FULL JOIN rr ON l.k = rr.k""")
def relate_overlap(spark: SparkSession, d: str) -> DataFrame:
    return relate.relate(t(spark, d, "orders").where("o_orderstatus = 'F'"), t(spark, d, "customer").where("c_nationkey < 10"), [("o_custkey", "c_custkey")], "c_name").report["overlap"]


@query("""WITH j AS (SELECT o_totalprice, c_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) ON o_custkey = c_custkey)
    SELECT round(sum(o_totalprice) FILTER (WHERE c_custkey IS NOT NULL), 2) AS retained, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) FILTER (WHERE c_custkey IS NOT NULL) / sum(o_totalprice), 6) AS share FROM j""")
def relate_retained_share(spark: SparkSession, d: str) -> DataFrame:
    s = relate.overlap_share(t(spark, d, "orders"), t(spark, d, "customer").where("c_nationkey < 10"), [("o_custkey", "c_custkey")], F.col("o_totalprice"))
    return s.select(r("retained", 2).alias("retained"), r("total", 2).alias("total"), r("share", 6).alias("share"))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    """Runs of days from two days before the start of a month's third on, by user."""
    u = t(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("user_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") * 10).alias("start"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") * 10 + 5 + (F.col("user_id") % 3).cast("int")).alias("end"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("wave"))


_PERIODS = "(SELECT user_id AS u, DATE '2024-01-01' + CAST(k * 10 AS INT) AS s, DATE '2024-01-01' + CAST(k * 10 + 5 + user_id % 3 AS INT) AS e, 'p' || k AS wave FROM (SELECT DISTINCT user_id FROM events), range(0, 3) q(k))"


@query(f"SELECT event_id, wave FROM events JOIN {_PERIODS} ON user_id = u AND CAST(ts AS DATE) BETWEEN s AND e")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    return relate.relate_period(e, _periods(spark, d), "day", "start", "end", "wave", [("user_id", "user_id")]).select("event_id", "wave")


_WAVES = "(SELECT DATE '2024-01-01' + CAST(k * 10 AS INT) AS s, DATE '2024-01-06' + CAST(k * 10 AS INT) AS e, 'w' || k AS wave FROM range(0, 3) q(k))"


@query(f"""SELECT event_id, max(a.wave) AS "wave_-3d", max(b.wave) AS "wave_+7d" FROM events LEFT JOIN {_WAVES} a ON CAST(ts AS DATE) - 3 BETWEEN a.s AND a.e LEFT JOIN {_WAVES} b ON CAST(ts AS DATE) + 7 BETWEEN b.s AND b.e GROUP BY 1""")
def multi_shift_join(spark: SparkSession, d: str) -> DataFrame:
    waves = spark.range(3).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 10).cast("int")).alias("start"), F.date_add(F.lit("2024-01-06").cast("date"), (F.col("id") * 10).cast("int")).alias("end"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("wave"))
    e = t(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return relate.relate_shifts(e, waves, "event_id", "day", "start", "end", "wave", [-3, 7]).drop("day")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def anti_gaps(spark: SparkSession, d: str) -> DataFrame:
    return relate.unmatched_keys(t(spark, d, "customer"), t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@query("SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def folded_name_join(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    written = t(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("  "), F.lower("n_name"), F.lit("--")).alias("name"))  # nations: 25 rows
    return relate.relate(written, n, [("name", "n_name")], "n_name", compare="folded", name="nation").df.drop("name")


@query()
def spelling_join(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    misspelt = n.select(F.concat(F.substring("n_name", 1, 4), F.lit("e"), F.col("n_name").substr(5, 40)).alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    return relate.relate_spelling(misspelt, n, "name", "n_name", "n_nationkey")


@query("SELECT n_name, balance FROM nation LEFT JOIN (SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_nationkey < 12 GROUP BY 1) ON n_nationkey = s_nationkey")
def areas_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    sums = t(spark, d, "supplier").where("s_nationkey < 12").groupBy("s_nationkey").agg(r(F.sum("s_acctbal"), 2).alias("balance"))
    named = sums.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("written"), "balance")
    return relate.join_to_areas(n.select("n_name"), named, "n_name", "written", "balance").df


# --- series ---------------------------------------------------------------------------------------------------------


def _series(unit: str, key: str, domain: str, table: str = "events", date: str = "ts") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return series.case_series(t(spark, d, table), F.col(date), unit).df

    run.__name__ = f"case_series_{unit}"
    query(f"WITH c AS (SELECT {key} AS period, count(*) AS cases FROM {table} GROUP BY 1), dom AS ({domain}) SELECT dom.period, coalesce(cases, 0) AS cases FROM dom LEFT JOIN c USING (period)")(run)


_RANGE = "SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL {})) AS DATE) AS period FROM c"
_series("day", "CAST(o_orderdate AS DATE)", _RANGE.format("1 DAY"), "orders", "o_orderdate")
_series("week", "CAST(date_trunc('week', o_orderdate) AS DATE)", _RANGE.format("7 DAY"), "orders", "o_orderdate")
_series("week_sunday", "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT)", _RANGE.format("7 DAY"), "orders", "o_orderdate")
_series("month", "CAST(date_trunc('month', o_orderdate) AS DATE)", _RANGE.format("1 MONTH"), "orders", "o_orderdate")
_series("weekday", "CAST(isodow(ts) AS INT)", "SELECT CAST(range AS INT) AS period FROM range(1, 8)")
_series("month_of_year", "CAST(month(ts) AS INT)", "SELECT CAST(range AS INT) AS period FROM range(1, 13)")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS period, event_type, round(sum(value), 2) AS cases FROM events GROUP BY 1, 2),
    dom AS (SELECT * FROM (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period FROM c), (SELECT DISTINCT event_type FROM events))
    SELECT dom.period, dom.event_type, coalesce(cases, 0) AS cases FROM dom LEFT JOIN c USING (period, event_type)""")
def case_series_split_weighted(spark: SparkSession, d: str) -> DataFrame:
    s = series.case_series(t(spark, d, "events"), F.col("ts"), "day", F.col("value"), ["event_type"]).df
    return s.withColumn("cases", r("cases", 2))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS period, count(*) AS cases FROM events GROUP BY 1), dom AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period FROM c)
    SELECT period, coalesce(cases, 0) AS cases, CAST(sum(coalesce(cases, 0)) OVER (ORDER BY period) AS BIGINT) AS cases_so_far FROM dom LEFT JOIN c USING (period)""")
def surveillance_replay(spark: SparkSession, d: str) -> DataFrame:
    return series.replay(t(spark, d, "events"), F.col("ts"))


# --- measures -------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, sum(l_linenumber * 1.0) AS cases, sum(l_quantity) AS at_risk, round(1000 * sum(l_linenumber) / sum(l_quantity), 4) AS rate, CAST(NULL AS VARCHAR) AS reason FROM lineitem GROUP BY 1")
def rate_group(spark: SparkSession, d: str) -> DataFrame:
    return measures.rate(t(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_quantity"), ["l_returnflag"], 1000).withColumn("rate", r("rate"))


@query("""SELECT floor(p_size / 10.0) * 10.0 AS band, CAST(count(*) FILTER (WHERE p_brand = 'Brand#1') AS DOUBLE) AS cases, CAST(count(*) AS DOUBLE) AS at_risk,
    CASE WHEN count(*) >= 20 THEN round(100.0 * count(*) FILTER (WHERE p_brand = 'Brand#1') / count(*), 4) END AS rate, CASE WHEN count(*) < 20 THEN 'too few at risk' END AS reason FROM part GROUP BY 1""")
def rate_banded_suppressed(spark: SparkSession, d: str) -> DataFrame:
    m = measures.rate(t(spark, d, "part"), (F.col("p_brand") == "Brand#1").cast("int"), F.lit(1), [], 100, ("p_size", 10.0), 20, proportion=True)
    return m.withColumn("rate", r("rate"))


_CELLS = "CAST(count(*) FILTER (WHERE e AND k) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE e AND NOT k) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE NOT e AND k) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT e AND NOT k) AS DOUBLE) AS d"
_MEASURES = """round(a / (a + b) / (c / (c + d)), 4) AS risk_ratio, round(exp(ln(a / (a + b) / (c / (c + d))) - 1.959963984540054 * sqrt(b / (a * (a + b)) + d / (c * (c + d)))), 4) AS rr_lower,
    round(exp(ln(a / (a + b) / (c / (c + d))) + 1.959963984540054 * sqrt(b / (a * (a + b)) + d / (c * (c + d)))), 4) AS rr_upper, round(a * d / (b * c), 4) AS odds_ratio,
    round(exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 4) AS or_lower, round(exp(ln(a * d / (b * c)) + 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 4) AS or_upper,
    round(a / (a + b) - c / (c + d), 6) AS risk_difference, round((a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 4) AS chi2_pearson,
    round((a + b + c + d - 1) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 4) AS chi2_mh, round((a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 4) AS chi2_yates"""
_SHOWN = ("risk_ratio", "rr_lower", "rr_upper", "odds_ratio", "or_lower", "or_upper", "risk_difference", "chi2_pearson", "chi2_mh", "chi2_yates")


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in "abcd"], *[r(c, 6 if c == "risk_difference" else 4).alias(c) for c in _SHOWN])


@query(f"WITH x AS (SELECT quality = 1 AS e, toxic = 1 AS k FROM labels), g AS (SELECT {_CELLS} FROM x) SELECT a, b, c, d, {_MEASURES} FROM g")
def two_by_two(spark: SparkSession, d: str) -> DataFrame:
    return _shown(measures.two_by_two(t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


@query(f"""WITH x AS (SELECT 'open' AS exposure, o_orderstatus = 'O' AS e, o_orderpriority = '1-URGENT' AS k FROM orders UNION ALL SELECT 'dear', o_totalprice > 100000, o_orderpriority = '1-URGENT' FROM orders
    UNION ALL SELECT 'late', o_orderdate >= TIMESTAMP '1995-01-01', o_orderpriority = '1-URGENT' FROM orders), g AS (SELECT exposure, {_CELLS} FROM x GROUP BY 1) SELECT exposure, a, b, c, d, {_MEASURES} FROM g""")
def exposure_table(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    exposures = {"open": F.col("o_orderstatus") == "O", "dear": F.col("o_totalprice") > 100000, "late": F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")}
    return _shown(measures.exposure_table(o, exposures, F.col("o_orderpriority") == "1-URGENT"), "exposure")


@query("""WITH g AS (SELECT event_type, CAST(count(*) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) AS a, sum(value) FILTER (WHERE user_id % 2 = 0) AS ua, CAST(count(*) FILTER (WHERE user_id % 2 = 1) AS DOUBLE) AS b, sum(value) FILTER (WHERE user_id % 2 = 1) AS ub FROM events GROUP BY 1)
    SELECT event_type, a, b, round((a / ua) / (b / ub), 4) AS rate_ratio, round(exp(ln((a / ua) / (b / ub)) - 1.959963984540054 * sqrt(1 / a + 1 / b)), 4) AS lower, round(exp(ln((a / ua) / (b / ub)) + 1.959963984540054 * sqrt(1 / a + 1 / b)), 4) AS upper FROM g""")
def rate_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = measures.rate_ratio(t(spark, d, "events"), F.col("user_id") % 2 == 0, F.lit(1), F.col("value"), ["event_type"])
    return m.select("event_type", "a", "b", *[r(c).alias(c) for c in ("rate_ratio", "lower", "upper")])


@query(f"""WITH x AS (SELECT l_linenumber AS s, l_returnflag = 'R' AS e, l_linestatus = 'O' AS k FROM lineitem), g AS (SELECT s, {_CELLS} FROM x GROUP BY 1), n AS (SELECT *, a + b + c + d AS n FROM g)
    SELECT count(*) AS n_strata, round(sum(a * d / n) / sum(b * c / n), 4) AS mh_odds_ratio, round(sum(a * (c + d) / n) / sum(c * (a + b) / n), 4) AS mh_risk_ratio,
      round(pow(sum(a - (a + b) * (a + c) / n), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 4) AS mh_chi2 FROM n""")
def mantel_haenszel(spark: SparkSession, d: str) -> DataFrame:
    m = measures.mantel_haenszel(t(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", ["l_linenumber"])
    return m.select("n_strata", *[r(c).alias(c) for c in ("mh_odds_ratio", "mh_risk_ratio", "mh_chi2")])


@query("""WITH g AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS m FROM lineitem GROUP BY 1),
    s AS (SELECT sum(k) AS kk, sum(m) AS n, sum(k * x) AS t1, sum(m * x) AS t2, sum(m * x * x) AS t3 FROM g) SELECT kk, n, round(pow(t1 - kk * t2 / n, 2) / (kk * (n - kk) * (n * t3 - t2 * t2) / (n * n * (n - 1))), 4) AS chi2_trend FROM s""")
def trend_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return measures.trend(t(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_returnflag") == "R").withColumn("chi2_trend", r("chi2_trend"))


@query("""WITH p AS (SELECT user_id, bool_or(event_type = 'error') FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS x, bool_or(event_type = 'error') FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS y FROM events GROUP BY 1),
    g AS (SELECT CAST(count(*) FILTER (WHERE x AND NOT y) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE NOT x AND y) AS DOUBLE) AS c FROM p)
    SELECT b, c, round(b / nullif(c, 0), 4) AS odds_ratio, round(pow(b - c, 2) / nullif(b + c, 0), 4) AS chi2, round(pow(greatest(abs(b - c) - 1, 0), 2) / nullif(b + c, 0), 4) AS chi2_corrected FROM g""")
def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    e = t(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.when(F.col("ts") < half, F.col("event_type") == "error")).alias("x"), F.bool_or(F.when(F.col("ts") >= half, F.col("event_type") == "error")).alias("y"))
    return measures.matched_pairs(e, F.col("x"), F.col("y")).select("b", "c", *[r(c).alias(c) for c in ("odds_ratio", "chi2", "chi2_corrected")])


@query("SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS variance, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1")
def means_table(spark: SparkSession, d: str) -> DataFrame:
    m = measures.means(t(spark, d, "lineitem"), F.col("l_quantity"), ["l_returnflag"])
    return m.select("l_returnflag", "n", r("total", 2).alias("total"), r("mean").alias("mean"), r("variance").alias("variance"), "q1", "median", "q3")


@query("""WITH g AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT *, n / sum(n) OVER () AS share, sum(n) OVER () AS total, 1.959963984540054 AS z FROM g)
    SELECT value, n, round(share, 6) AS share, round((share + z * z / (2 * total) - z * sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total), 6) AS lower,
      round((share + z * z / (2 * total) + z * sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total), 6) AS upper FROM p""")
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return measures.frequencies(t(spark, d, "customer"), "c_mktsegment").select("value", "n", *[r(c, 6).alias(c) for c in ("share", "lower", "upper")])


@query(f"WITH x AS (SELECT quality = 1 AS e, toxic = 1 AS k FROM labels), g AS (SELECT {_CELLS} FROM x) SELECT 'quality' AS term, round(ln(a * d / (b * c)), 4) AS estimate, round(a * d / (b * c), 4) AS ratio, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 4) AS error FROM g")
def glm_logistic_2x2(spark: SparkSession, d: str) -> DataFrame:
    m = regression.regress(t(spark, d, "labels"), F.col("toxic"), {"quality": F.col("quality")}).df
    return m.where("term = 'quality'").select("term", r("estimate").alias("estimate"), r("ratio").alias("ratio"), r("error").alias("error"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1), ref AS (SELECT n AS rn, v AS rv FROM g WHERE event_type = 'click')
    SELECT 'type=' || event_type AS term, round((n / v) / (rn / rv), 4) AS ratio FROM g, ref WHERE event_type <> 'click'""")
def glm_poisson_rates(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    levels = ["click", "error", "purchase", "signup", "view"]
    m = regression.regress(e, F.col("n"), {}, {"type": (F.col("event_type"), levels)}, "poisson", F.log("v")).df
    return m.where("term <> '(constant)'").select("term", r("ratio").alias("ratio"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS y1, count(*) FILTER (WHERE event_type = 'view') AS y0 FROM events GROUP BY 1),
    g AS (SELECT CAST(sum(y1) AS DOUBLE) AS a, CAST(sum(y0) AS DOUBLE) AS b, count(*) FILTER (WHERE y1 + y0 > 0) AS strata FROM u)
    SELECT 'purchase' AS term, round(ln(a / b), 6) AS estimate, round(sqrt((a + b) / (a * b)), 6) AS error, strata FROM g""")
def glm_poisson_strata(spark: SparkSession, d: str) -> DataFrame:
    """Purchases against views, each user a stratum of two records; then the estimate has a closed form."""
    u = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchase"), F.count_if(F.col("event_type") == "view").alias("view"))
    two = u.select("user_id", F.explode(F.array(F.struct(F.lit(1.0).alias("x"), F.col("purchase").alias("y")), F.struct(F.lit(0.0).alias("x"), F.col("view").alias("y")))).alias("r"))
    m = regression.regress(two.select("user_id", "r.*"), F.col("y"), {"purchase": F.col("x")}, family="poisson", strata=["user_id"])
    one = F.broadcast(m.report["fit"].select(F.col("strata_used").alias("strata")))  # one row
    return m.df.crossJoin(one).select("term", r("estimate", 6).alias("estimate"), r("error", 6).alias("error"), "strata")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1),
    x AS (SELECT y, dayofweek(day) IN (0, 6) AS w, row_number() OVER (ORDER BY day) AS p FROM d), m AS (SELECT w, avg(y) AS mu, sum(y) AS total FROM x GROUP BY 1),
    g AS (SELECT p, (y - mu) / total * CASE WHEN w THEN 1 ELSE -1 END AS g FROM x JOIN m USING (w)),
    v AS (SELECT sum(a.g * b.g * CASE WHEN a.p = b.p THEN 1 ELSE 2 * (1 - (b.p - a.p) / 8.0) END) AS v FROM g a JOIN g b ON b.p BETWEEN a.p AND a.p + 7)
    SELECT 'weekend' AS term, round(ln((SELECT mu FROM m WHERE w) / (SELECT mu FROM m WHERE NOT w)), 6) AS estimate, round(sqrt(v), 6) AS error FROM v""")
def glm_sequence_errors(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts on weekends, with errors that allow for days up to a week apart to go together."""
    days = t(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("y"))
    m = regression.regress(days, F.col("y"), {"weekend": F.dayofweek("day").isin(1, 7).cast("int")}, family="poisson", errors="hac", order=["day"], lag=7).df
    return m.where("term = 'weekend'").select("term", r("estimate", 6).alias("estimate"), r("error", 6).alias("error"))


# --- rules ----------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middling' ELSE 'large' END AS band, o_orderpriority, o_orderstatus, o_totalprice FROM orders)
    SELECT o_orderkey, band, CASE WHEN band = 'large' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'watch' END WHEN o_orderstatus = 'P' THEN 'wait' ELSE 'none' END AS action,
      CASE WHEN band = 'large' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS n_conflicts FROM x""")
def rules_classify(spark: SparkSession, d: str) -> DataFrame:
    c = rules.Condition
    given = rules.bands("o_totalprice", "band", [50000, 150000], ["small", "middling", "large"])
    given.append(rules.Rule("action", "watch", [[c("band", "=", "large"), c("o_orderpriority", "=", "1-URGENT")], [c("band", "=", "large"), c("o_orderpriority", "=", "2-HIGH")]]))
    given.append(rules.Rule("action", "wait", [[c("o_orderstatus", "=", "P")]]))
    return rules.apply_rules(t(spark, d, "orders"), given, {"action": "none"}).select("o_orderkey", "band", "action", F.size("conflicts").alias("n_conflicts"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice / nullif(l_quantity - 10, 0) * 10000 + 0.5) / 10000 AS unit_price FROM lineitem")
def rules_compute(spark: SparkSession, d: str) -> DataFrame:
    given = [rules.Rule("less", rules.Compute("l_quantity", "minus", 10)), rules.Rule("unit_price", rules.Compute("l_extendedprice", "divided by", "less"))]
    out = rules.apply_rules(t(spark, d, "lineitem"), given)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.half_up(F.col("unit_price"), 4).alias("unit_price"))


@query("SELECT event_id, lag(value) OVER w AS before, coalesce(value < lag(value) OVER w, false) AS fell FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rules_previous_row(spark: SparkSession, d: str) -> DataFrame:
    e = rules.previous_row(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", {"before": "value"}, "event_id")
    return e.select("event_id", "before", F.coalesce(F.col("value") < F.col("before"), F.lit(False)).alias("fell"))


@query("""WITH g AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.p, a.m, a.n, b.n AS before FROM g a LEFT JOIN g b ON a.p = b.p AND b.m = CAST(a.m - INTERVAL 1 MONTH AS DATE)""")
def rules_previous_month(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return rules.previous_period(g, ["p"], "m", "month", {"before": "n"})


@query("""WITH s AS (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'purchase' THEN 2.0 ELSE -1.0 END) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, p + greatest(3.0, 0 - min(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS stock FROM s""")
def rules_carried_value(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("order", F.struct("ts", "event_id"))
    step = F.when(F.col("event_type") == "purchase", 2.0).otherwise(-1.0)
    return rules.carried(e, ["user_id"], "order", 3.0, step, "stock").select("event_id", "stock")


# --- profiles -------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
    g AS (SELECT "column", count(*) AS n_rows, count(DISTINCT x) AS n_distinct, min(x) AS low, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS high FROM l GROUP BY 1)
    SELECT g.*, (SELECT count(*) FROM l WHERE l."column" = g."column" AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS n_beyond FROM g""")
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    p = tables.profile(t(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return p.select("column", "n_rows", "n_distinct", "low", "q1", "median", "q3", "high", "n_beyond")


@query("""WITH e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT CAST(least(floor((p_retailprice - a) / ((b - a) / 12)), 11) AS INT) AS bin, count(*) AS n FROM part, e GROUP BY 1""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return tables.histogram(t(spark, d, "part"), F.col("p_retailprice")).select("bin", "n")


@query(f"""WITH m AS (SELECT CASE WHEN ({_G}) IS NULL THEN 1.0 ELSE 0.0 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END AS c FROM lineitem)
    SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 4) AS phi FROM m UNION ALL SELECT 'a', 'c', round(corr(a, c), 4) FROM m UNION ALL SELECT 'b', 'c', round(corr(b, c), 4) FROM m""")
def nullity_phi(spark: SparkSession, d: str) -> DataFrame:
    cols = {"a": gappy("l_quantity"), "b": F.when(F.col("l_linenumber") % 2 != 0, 1), "c": F.when(F.col("l_quantity") <= 40, 1)}
    return tables.nullity(t(spark, d, "lineitem"), cols).withColumn("phi", r("phi"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_values(t(spark, d, "part"), "p_type")


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS v FROM part), n AS (SELECT count(*) AS n FROM x), s AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM x),
    b AS (SELECT DISTINCT v AS b FROM s, n, range(1, 6) q(k) WHERE i = CAST(ceil(k * n / 5.0) AS BIGINT)) SELECT p_partkey, least((SELECT count(*) FROM b WHERE b < v), (SELECT count(*) FROM b) - 1) AS class FROM x""")
def quantile_classes(spark: SparkSession, d: str) -> DataFrame:
    return tables.value_classes(t(spark, d, "part"), "p_retailprice").select("p_partkey", F.col("class").cast("long").alias("class"))


@query("SELECT p_partkey, least(greatest(CAST(ceil((p_size - a) / ((b - a) / 5.0)) AS BIGINT) - 1, 0), 4) AS class FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)")
def equal_classes(spark: SparkSession, d: str) -> DataFrame:
    return tables.value_classes(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", 5, "equal").select("p_partkey", F.col("class").cast("long").alias("class"))


# --- records, chains ------------------------------------------------------------------------------------------------


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 2, 3")
def dedup_table_exact(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return dedup.dedup_table(o, ["o_custkey", "day"], "o_orderkey").df


@query()
def dedup_nearby_points(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).select("id", "lon", "lat", F.concat(F.lit("Clinic "), (F.col("id") % 40).cast("string")).alias("name"))
    again = p.select((F.col("id") + 10_000_000).alias("id"), (F.col("lon") + 0.0003).alias("lon"), "lat", F.concat(F.col("name"), F.lit("  ")).alias("name"))
    return dedup.dedup_points(p.unionByName(again), 100.0).df


@query("""WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 2 END AS src FROM orders),
    walk AS (SELECT id, id AS root, 0 AS generation FROM c WHERE src IS NULL OR src NOT IN (SELECT id FROM c) UNION ALL SELECT c.id, walk.root, walk.generation + 1 FROM c JOIN walk ON c.src = walk.id AND c.src <> c.id)
    SELECT id AS "case", root, CAST(generation AS BIGINT) AS generation FROM walk""")
def transmission_chains(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_orderkey") / 2)).alias("src"))
    return graph.chains(o, "id", "src").df.where("status <> 'loop'").select("case", "root", "generation")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS f, s_nationkey + 1000000 AS g, 1 + s_suppkey % 3 AS c FROM supplier), b AS (SELECT f, g, c FROM e UNION ALL SELECT g, f, c FROM e),
    walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS cost FROM supplier UNION SELECT origin, b.g, cost + c FROM walk JOIN b ON node = b.f WHERE cost + c <= 4)
    SELECT origin, node, CAST(min(cost) AS DOUBLE) AS cost FROM walk GROUP BY 1, 2""")
def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("from"), (F.col("s_nationkey") + 1000000).cast("long").alias("to"), (1 + F.col("s_suppkey") % 3).alias("cost"))
    return graph.reachable(edges, s.select(F.col("s_suppkey").alias("node")), 4.0, True)


# --- places ---------------------------------------------------------------------------------------------------------

_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
_SITES = f"(SELECT s_suppkey, {S_LON} AS slon, {S_LAT} AS slat FROM supplier)"


@query(f"""WITH p AS (SELECT c_custkey AS id, {LON} AS lon, {LAT} AS lat FROM customer), k AS (SELECT id, s_suppkey, {_KM.format("lat", "lon", "slat", "slon")} AS km FROM p, {_SITES})
    SELECT id, arg_min(s_suppkey, km) AS nearest_id, round(min(km), 4) AS distance_km FROM k GROUP BY 1""")
def haversine_nearest(spark: SparkSession, d: str) -> DataFrame:
    sites = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(S_LON).cast("double").alias("lon"), F.expr(S_LAT).cast("double").alias("lat"))
    return geo.nearest(places(spark, d), sites, first_km=2000).select("id", "nearest_id", r("distance_km").alias("distance_km"))


@query()
def mean_center(spark: SparkSession, d: str) -> DataFrame:
    """Of all places, the weighted mean place of each UTM zone's."""
    return geo.mean_center(places(spark, d).withColumn("zone", values.utm_zone(F.col("lon"))), F.greatest(F.col("weight"), F.lit(0.0)), by=["zone"])


@query()
def donut_mask(spark: SparkSession, d: str) -> DataFrame:
    return geo.donut_mask(places(spark, d), 100, 1000, 7)


@query()
def hexagon_counts(spark: SparkSession, d: str) -> DataFrame:
    return geo.hexagons(places(spark, d), 250_000, 2).df


#: West and south edge of a supplier's box of 20 by 30 degrees, which has a hole of 3 by 4.
BOX_X, BOX_Y = "CAST(s_suppkey * 71 % 1690 AS DOUBLE) / 5 - 180 + 0.05", "CAST(s_suppkey * 29 % 440 AS DOUBLE) / 5 - 60 + 0.05"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    ring = lambda a, b, c, e: "array(" + ", ".join(f"struct(x + {i} AS x, y + {j} AS y)" for i, j in ((a, b), (c, b), (c, e), (a, e), (a, b))) + ")"
    placed = t(spark, d, "supplier").select(F.concat(F.lit("box"), F.col("s_suppkey")).alias("name"), F.expr(BOX_X).alias("x"), F.expr(BOX_Y).alias("y"))
    return placed.select("name", F.expr(f"array({ring(0, 0, 20, 30)}, {ring(5, 5, 8, 9)})").alias("geometry"))


_BOX = f"(SELECT 'box' || s_suppkey AS name, {BOX_X} AS x, {BOX_Y} AS y FROM supplier)"


@query(f"""WITH p AS (SELECT {LON} AS lon, {LAT} AS lat, c_acctbal AS w FROM customer), h AS (SELECT name, w FROM {_BOX}, p WHERE lon > x AND lon < x + 20 AND lat > y AND lat < y + 30 AND NOT (lon > x + 5 AND lon < x + 8 AND lat > y + 5 AND lat < y + 9))
    SELECT name, count(w) AS n, round(coalesce(sum(w), 0), 2) AS total FROM {_BOX} LEFT JOIN h USING (name) GROUP BY 1""")
def points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return geo.summarize_points(places(spark, d), boxes(spark, d), F.col("weight"), cell=10.0).withColumn("total", r("total", 2))


@query(f"""WITH b AS (SELECT * FROM {_BOX}) SELECT name, round(pow(6371008.8, 2) * (radians(20) * (sin(radians(y + 30)) - sin(radians(y))) - radians(3) * (sin(radians(y + 9)) - sin(radians(y + 5)))) / 1e6, 1) AS km2 FROM b""")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("name", r(geo.area_m2(F.col("geometry")) / 1e6, 1).alias("km2"))


@query(f"""WITH b AS (SELECT * FROM {_BOX}), g AS (SELECT a * 2.0 AS lon, c * 2.0 AS lat FROM range(-100, 100) p(a), range(-40, 40) o(c))
    SELECT name, count(*) AS n FROM b, g WHERE lon > x AND lon < x + 20 AND lat > y AND lat < y + 30 AND NOT (lon > x + 5 AND lon < x + 8 AND lat > y + 5 AND lat < y + 9) GROUP BY 1""")
def point_grid(spark: SparkSession, d: str) -> DataFrame:
    return geo.point_grid(boxes(spark, d), 2.0).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query()
def convex_hulls(spark: SparkSession, d: str) -> DataFrame:
    return geo.convex_hull(places(spark, d), "segment")


@query("SELECT CAST(floor(l_tax * 100) AS BIGINT) // 3 AS \"row\", CAST(floor(l_discount * 100) AS BIGINT) // 3 AS col, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2")
def raster_blocks(spark: SparkSession, d: str) -> DataFrame:
    cells = t(spark, d, "lineitem").groupBy(F.floor(F.col("l_tax") * 100).alias("row"), F.floor(F.col("l_discount") * 100).alias("col")).agg(F.sum("l_quantity").alias("value"))
    return raster.reduce_blocks(cells, 3, "sum").withColumn("value", r("value", 2))


def quantity_raster(spark: SparkSession, d: str) -> tuple[DataFrame, raster.Grid]:
    """Cells of a degree with the quantities of the lines that fall in them, without data on every eleventh diagonal; some cells are absent."""
    place = t(spark, d, "lineitem").groupBy((F.col("l_partkey") * 7 % 120).alias("row"), (F.col("l_orderkey") * 13 % 360).alias("col")).agg(F.sum("l_quantity").alias("value"))
    return place.withColumn("value", F.when((F.col("row") + F.col("col")) % 11 != 0, F.col("value"))), raster.Grid(-180.0, 60.0, 1.0)


_CELL = "(SELECT l_partkey * 7 % 120 AS \"row\", l_orderkey * 13 % 360 AS col, CASE WHEN (l_partkey * 7 % 120 + l_orderkey * 13 % 360) % 11 <> 0 THEN sum(l_quantity) END AS value FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT c_custkey AS id, value FROM (SELECT c_custkey, CAST(floor({LON} + 180) AS BIGINT) AS col, CAST(floor(60 - ({LAT})) AS BIGINT) AS \"row\" FROM customer) LEFT JOIN {_CELL} USING (\"row\", col)")
def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    cells, grid = quantity_raster(spark, d)
    return raster.sample(places(spark, d), cells, grid).select("id", "value")


@query(f"""WITH g AS (SELECT rr AS "row", cc AS col, -180 + cc + 0.5 AS lon, 60 - rr - 0.5 AS lat FROM range(0, 120) a(rr), range(0, 360) b(cc)), c AS (SELECT "row", col, value, 1 AS there FROM {_CELL}), z AS (SELECT * FROM g LEFT JOIN c USING ("row", col))
    SELECT name, count(value) AS cells, count(*) FILTER (WHERE there = 1 AND value IS NULL) AS no_data, count(*) FILTER (WHERE there IS NULL) AS outside, sum(value) AS total, median(value) AS median, round(stddev_pop(value), 4) AS deviation, count(*) FILTER (WHERE value > 0) AS populated
    FROM {_BOX}, z WHERE lon > x AND lon < x + 20 AND lat > y AND lat < y + 30 AND NOT (lon > x + 5 AND lon < x + 8 AND lat > y + 5 AND lat < y + 9) GROUP BY 1""")
def raster_zonal(spark: SparkSession, d: str) -> DataFrame:
    cells, grid = quantity_raster(spark, d)
    return raster.zonal(cells, boxes(spark, d), grid).select("name", "cells", "no_data", "outside", "total", "median", r("deviation").alias("deviation"), "populated")


@query(f"""SELECT DISTINCT "row", col, value FROM {_BOX}, {_CELL} WHERE -180 + col + 0.5 > x AND -180 + col + 0.5 < x + 20 AND 60 - "row" - 0.5 > y AND 60 - "row" - 0.5 < y + 30
    AND NOT (-180 + col + 0.5 > x + 5 AND -180 + col + 0.5 < x + 8 AND 60 - "row" - 0.5 > y + 5 AND 60 - "row" - 0.5 < y + 9)""")
def clipped_raster(spark: SparkSession, d: str) -> DataFrame:
    cells, grid = quantity_raster(spark, d)
    return raster.clip(cells, boxes(spark, d), grid)


@query(f"""SELECT "row", col, value FROM {_CELL} WHERE "row" BETWEEN 20 AND 79 AND col BETWEEN 100 AND 219""")
def geotiff_window(spark: SparkSession, d: str) -> DataFrame:
    """The raster written as tiles of GeoTIFF in the shared folder, and a window of it read back; cells that the raster has not come as no data."""
    cells, grid = quantity_raster(spark, d)
    path = shared_path(spark, "geotiff")
    geotiff.write_geotiff(cells, grid, path, block=64)
    corner = geotiff.grid_of(path)
    back = geotiff.read_geotiff(spark, path, west=-80.0, south=-20.0, east=40.0, north=40.0)
    moved = back.select((F.col("row") + round((grid.north - corner.north) / grid.dy)).alias("row"), (F.col("col") + round((corner.west - grid.west) / grid.size)).alias("col"), "value")
    return moved.join(cells.select("row", "col"), ["row", "col"], "left_semi")


@query()
def scan_space_time(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), ((F.col("user_id") * 37) % 100 / 100.0).alias("lon"), ((F.col("user_id") * 53) % 100 / 100.0).alias("lat"), F.col("ts").cast("date").alias("date"))
    return scan.space_time_scan(e, 15.0, 4, replications=99).df


@query("SELECT c_custkey AS id, CASE WHEN lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))) = '' THEN NULL ELSE lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))) END AS folded FROM customer")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.nullif(values.folded(F.col("c_name")), F.lit("")).alias("folded"))


@query("SELECT user_id, count(*) AS n, max(running) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS running FROM events) GROUP BY 1")
def rolling_counts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return t(spark, d, "events").withColumn("running", F.count(F.lit(1)).over(w)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("running").alias("most"))


# --- numbering, display and edits -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return tables.numbered(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_number")


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS position FROM part)
    SELECT position, c_custkey, p_partkey FROM a FULL JOIN b USING (position)""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    return tables.positional_join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "part").select("p_partkey"), ["c_custkey"], ["p_partkey"])


@query("""WITH n AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN '(unknown)' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '(other)' END AS category, count(*) AS n FROM customer GROUP BY 1)
    SELECT category, coalesce(n, 0) AS n FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SHIPS'), ('(other)'), ('(unknown)')) v(category) LEFT JOIN n USING (category)""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))
    return tables.category_counts(c, "segment", ["BUILDING", "MACHINERY", "SHIPS"])


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '11') OR contains(lower(c_mktsegment), '11') ORDER BY c_custkey LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.search(t(spark, d, "customer"), " 11 ", ["c_name", "c_mktsegment"], ["c_custkey"], 2, 20).select("c_custkey", "c_name")


@query("""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def edit_features(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"))
    return tables.edit_features(o, "priority", {"3-MEDIUM": "medium"}, {"soon": ["1-URGENT", "2-HIGH"]}, ["5-LOW"]).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT c_mktsegment AS category, sum(c_acctbal) AS total FROM customer GROUP BY 1) SELECT category, round(total, 2) AS total, row_number() OVER (ORDER BY total DESC, category) AS place FROM s")
def bar_order(spark: SparkSession, d: str) -> DataFrame:
    return tables.bar_order(t(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal")).withColumn("total", r("total", 2))


@query("""WITH s AS (SELECT year(o_orderdate) AS "at", o_orderstatus AS series, count(*) AS value, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS k FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') GROUP BY 1, 2, 4)
    SELECT "at", series, value, CAST(sum(value) OVER w AS BIGINT) AS upper, CAST(sum(value) OVER w - value AS BIGINT) AS lower FROM s WINDOW w AS (PARTITION BY "at" ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def stacked_series(spark: SparkSession, d: str) -> DataFrame:
    return tables.stacked(t(spark, d, "orders"), F.year("o_orderdate"), "o_orderstatus", F.lit(1), ["O", "F", "P"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 AND c_mktsegment = 'BUILDING' THEN CASE WHEN c_custkey % 2 = 0 THEN 'HOUSES' ELSE 'BUILT' END ELSE c_mktsegment END AS segment FROM customer""")
def cell_edits(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    ninth = c.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("record"))
    log = ninth.select("record", F.lit("BUILDING").alias("old"), F.lit("BUILT").alias("new"), F.lit(1).alias("nth")).unionByName(ninth.where("record % 2 = 0").select("record", F.lit("BUILT").alias("old"), F.lit("HOUSES").alias("new"), F.lit(2).alias("nth")))
    return tables.edit_cells(c, "c_custkey", log, "segment", "nth").df


_TYPED = "CASE l_linenumber % 4 WHEN 0 THEN 'about ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5 ' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END"


@query(f"SELECT l_linenumber, count(x) AS n, count(*) - count(x) AS unread, sum(x) AS total FROM (SELECT l_linenumber, TRY_CAST(trim({_TYPED}) AS DOUBLE) AS x FROM lineitem) GROUP BY 1")
def repaired_numbers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("about "), q)).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit(" "), q, F.lit(".5 "))).otherwise(q)
    x = tables.repair(t(spark, d, "lineitem").select("l_linenumber", text.alias("x")), "x").df
    return x.groupBy("l_linenumber").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("unread"), F.sum("x").alias("total"))


@query("""WITH f AS (SELECT count(*) FILTER (WHERE l_linenumber % 3 = 0) AS m FROM lineitem) SELECT 'l_quantity' AS "column", m AS found_missing, CAST(1 AS BIGINT) AS n_missing, 'missing differs' AS finding FROM f
    UNION ALL SELECT 'l_tax', 0, NULL, 'not in dictionary' UNION ALL SELECT 'l_gone', NULL, 2, 'not in file'""")
def dictionary_check(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([("l_quantity", 1), ("l_gone", 2), ("l_linenumber", 0)], "column string, n_missing long")
    return tables.dictionary_check(t(spark, d, "lineitem").select("l_linenumber", gappy("l_quantity").alias("l_quantity"), "l_tax"), declared)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_minutes(CAST(o_orderkey % 60 AS BIGINT)) END AS at FROM orders""")
def written_datetimes(spark: SparkSession, d: str) -> DataFrame:
    day, h = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 24).cast("int")
    date = F.concat_ws("/", F.month(day).cast("string"), F.dayofmonth(day).cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.year(day).cast("string")).otherwise(F.date_format(day, "yy")))
    time = F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.when(h < 12, " a.m.").otherwise("PM"))
    return t(spark, d, "orders").select("o_orderkey", values.written_datetime(date, "month/day/year", time=time, clock="12-hour").alias("at"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'missed' ELSE 'met' END AS aim FROM part")
def rules_targets(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply_rules(t(spark, d, "part"), rules.targets("p_size", "aim", 20)).select("p_partkey", "aim")


# --- more measures --------------------------------------------------------------------------------------------------

_CELLS4 = "CAST(count(*) FILTER (WHERE e AND k) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE e AND NOT k) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE NOT e AND k) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT e AND NOT k) AS DOUBLE) AS d"


@query(f"""WITH o AS (SELECT c_mktsegment AS s, o_orderpriority = '1-URGENT' AS e, o_orderstatus = 'F' AS k FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT s, {_CELLS4} FROM o GROUP BY 1),
    h AS (SELECT *, a + b + c + d AS n, a + b AS e1, a + c AS m1 FROM g), p AS (SELECT sum(a * d / n) / sum(b * c / n) AS r FROM h),
    x AS (SELECT *, (r * (m1 + e1) + (n - m1 - e1) - sqrt(pow(r * (m1 + e1) + (n - m1 - e1), 2) - 4 * r * (r - 1) * m1 * e1)) / (2 * (r - 1)) AS x FROM h, p),
    v AS (SELECT *, 1 / (1 / x + 1 / (e1 - x) + 1 / (m1 - x) + 1 / (n - m1 - e1 + x)) AS v, ln(a * d / (b * c)) AS l, 1 / (1 / a + 1 / b + 1 / c + 1 / d) AS w FROM x)
    SELECT round(max(r), 4) AS mh_odds_ratio, round(sum(pow(a - x, 2) / v), 3) AS breslow_day, round(sum(pow(a - x, 2) / v) - pow(sum(a - x), 2) / sum(v), 3) AS tarone, count(*) - 1 AS df, round(sum(w * l * l) - pow(sum(w * l), 2) / sum(w), 3) AS woolf, count(*) - 1 AS woolf_df FROM v""")
def homogeneity_tests(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    h = measures.homogeneity(o, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", ["c_mktsegment"])
    return h.select(r("mh_odds_ratio").alias("mh_odds_ratio"), *[r(c, 3).alias(c) for c in ("breslow_day", "tarone", "woolf")], "df", "woolf_df")


@query("""WITH g AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) AS c FROM labels),
    p AS (SELECT b, c, b + c AS n, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS tail, max(exp(lgamma(b + c + 1) - lgamma(least(b, c) + 1) - lgamma(greatest(b, c) + 1) - (b + c) * ln(2))) AS point FROM g, range(0, 100000) q(i) WHERE i <= least(b, c) GROUP BY 1, 2)
    SELECT b, c, round(least(1.0, 2 * tail), 6) AS p_exact, round(CASE WHEN b = c THEN 1.0 ELSE least(1.0, least(1.0, 2 * tail) - point) END, 6) AS p_mid FROM p""")
def matched_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    return measures.matched_pairs_exact(t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1).select("b", "c", r("p_exact", 6).alias("p_exact"), r("p_mid", 6).alias("p_mid"))


@query("""WITH x AS (SELECT o_orderpriority = '1-URGENT' AS e, o_orderstatus = 'P' AS k, o_custkey % 50 AS s FROM orders), g AS (SELECT s, count(*) FILTER (WHERE e AND k) AS a, count(*) FILTER (WHERE e AND NOT k) AS b, count(*) FILTER (WHERE NOT e AND k) AS c, count(*) FILTER (WHERE NOT e AND NOT k) AS d FROM x GROUP BY 1),
    m AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM g),
    f AS (SELECT s, a, i, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(r - i + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) AS l FROM m, range(0, 100000) q(i) WHERE i BETWEEN greatest(0, r + k - n) AND least(r, k))
    SELECT s, round(least(1.0, sum(exp(l)) FILTER (WHERE l <= own + 1e-9)), 5) AS p FROM f JOIN (SELECT s, l AS own FROM f WHERE i = a) USING (s) GROUP BY 1""")
def fisher_exact(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumn("s", F.col("o_custkey") % 50)
    g = measures.two_by_two(o, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P", ["s"])
    return g.select("s", r(measures.fisher_exact_p(*[F.col(c) for c in "abcd"]), 5).alias("p"))


@query(f"WITH x AS (SELECT quality = 1 AS e, toxic = 1 AS k FROM labels), g AS (SELECT {_CELLS4} FROM x) SELECT round(a * d / (b * c), 4) AS odds_ratio, 'risk_difference,risk_ratio' AS withheld FROM g")
def design_withholds(spark: SparkSession, d: str) -> DataFrame:
    out = measures.under_design(measures.two_by_two(t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1), "case-control")
    withheld = out.report["withheld"].agg(F.array_join(F.sort_array(F.collect_list("measure")), ",").alias("withheld"))
    return out.df.select(r("odds_ratio").alias("odds_ratio")).crossJoin(withheld)  # one row each


@query("""WITH s AS (SELECT count(*) AS big, 1.959963984540054 AS z FROM customer), n AS (SELECT big, z * z * 0.3 * 0.7 / 0.0025 AS n FROM s)
    SELECT CAST(ceil(n / (1 + (n - 1) / big)) AS INT) AS survey, CAST(ceil(pow(1.959963984540054 + 0.8416212335729143, 2) * 0.2 * 0.8 * 3 / (2 * 0.15 * 0.15)) AS INT) AS exposed, CAST(ceil(2 * pow(1.959963984540054 + 0.8416212335729143, 2) * 0.2 * 0.8 * 3 / (2 * 0.15 * 0.15)) AS INT) AS unexposed FROM n""")
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    survey = measures.survey_size(t(spark, d, "customer").count(), 0.3, 0.05)
    return spark.createDataFrame([(survey, *measures.comparison_size(0.3, 0.15, 2.0))], "survey int, exposed int, unexposed int")


# --- more places ----------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT c_custkey AS id FROM {_BOX}, (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer) WHERE lon > x AND lon < x + 20 AND lat > y AND lat < y + 30 AND NOT (lon > x + 5 AND lon < x + 8 AND lat > y + 5 AND lat < y + 9)")
def clipped_points(spark: SparkSession, d: str) -> DataFrame:
    return geo.clip_points(places(spark, d), boxes(spark, d), cell=10.0).select("id")


@query(f"""WITH b AS (SELECT * FROM {_BOX}) SELECT name, round(pow(6371008.8, 2) * radians(20) * (sin(radians(y + 30)) - sin(radians(y))) / 1e6, 1) AS km2 FROM b""")
def filled_area(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("name", r(geo.area_m2(geo.fill_gaps(F.col("geometry"))) / 1e6, 1).alias("km2"))


_TURN = "degrees(atan2(sin(radians(30 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(30 - lon))))"


@query(f"SELECT c_custkey AS id, round({_TURN} - 360 * floor({_TURN} / 360), 3) AS bearing FROM (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer)")
def bearings(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("id", r(values.bearing(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(30.0)), 3).alias("bearing"))


@query(f"SELECT c_custkey AS id, s_suppkey AS node, round(km, 4) AS distance_km FROM (SELECT c_custkey, s_suppkey, km, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS i FROM (SELECT c_custkey, s_suppkey, {_KM.format('lat', 'lon', 'slat', 'slon')} AS km FROM (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer), {_SITES})) WHERE i = 1")
def snapped(spark: SparkSession, d: str) -> DataFrame:
    nodes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(S_LON).cast("double").alias("lon"), F.expr(S_LAT).cast("double").alias("lat"))
    return geo.snap(places(spark, d), nodes).select("id", "node", r("distance_km").alias("distance_km"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS f, s_nationkey + 1000000 AS g, 1 + s_suppkey % 3 AS c FROM supplier), b AS (SELECT f, g, c FROM e UNION ALL SELECT g, f, c FROM e),
    walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS cost FROM supplier UNION SELECT origin, b.g, cost + c FROM walk JOIN b ON node = b.f WHERE cost + c <= 4), k AS (SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM walk GROUP BY 1)
    SELECT node, cost, CASE WHEN cost <= 1 THEN 1.0 WHEN cost <= 2 THEN 2.0 ELSE 4.0 END AS band FROM k""")
def travel_bands(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("from"), (F.col("s_nationkey") + 1000000).cast("long").alias("to"), (1 + F.col("s_suppkey") % 3).alias("cost"))
    reached = graph.nearest_origin(edges, s.select(F.col("s_suppkey").alias("node")), 4.0, True)
    return graph.travel_bands(reached, [1, 2, 4]).select("node", "cost", "band")


@query(f"""SELECT "row", col, CASE WHEN (quality & 1) = 0 AND ((quality >> 2) & 1) = 1 THEN value END AS value FROM (SELECT *, ("row" * 5 + col) % 8 AS quality FROM {_CELL})""")
def raster_quality(spark: SparkSession, d: str) -> DataFrame:
    cells, _ = quantity_raster(spark, d)
    return raster.good_quality(cells.withColumn("quality", (F.col("row") * 5 + F.col("col")) % 8), "quality", {0: 0, 2: 1}).select("row", "col", "value")


@query(f"""WITH x AS (SELECT 'a' AS raster, "row", col, value AS v FROM {_CELL} WHERE value IS NOT NULL UNION ALL SELECT 'b', "row", col, value * 2 FROM {_CELL} WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM x), s AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM x),
    b AS (SELECT DISTINCT v AS b FROM s, n, range(1, 6) q(k) WHERE i = CAST(ceil(k * n / 5.0) AS BIGINT)), c AS (SELECT raster, least((SELECT count(*) FROM b WHERE b < v), (SELECT count(*) FROM b) - 1) AS class FROM x) SELECT raster, class, count(*) AS n FROM c GROUP BY 1, 2""")
def pooled_classes(spark: SparkSession, d: str) -> DataFrame:
    cells, _ = quantity_raster(spark, d)
    both = raster.pooled_classes({"a": cells, "b": cells.withColumn("value", F.col("value") * 2)})
    return both.groupBy("raster", F.col("class").cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT c_custkey AS id, {LON} AS lon, {LAT} AS lat, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS elevation FROM customer), e AS (SELECT s_suppkey AS site_id, s_acctbal * 0.001 AS level FROM supplier WHERE s_suppkey % 2 = 0),
    k AS (SELECT id, elevation, s_suppkey, {_KM.format("lat", "lon", "slat", "slon")} AS km FROM p, {_SITES} WHERE s_suppkey IN (SELECT site_id FROM e)), b AS (SELECT id, any_value(elevation) AS elevation, arg_min(s_suppkey, km) AS site_id, min(km) AS km FROM k GROUP BY 1)
    SELECT id, site_id, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS distance_m, CASE WHEN elevation IS NULL THEN 'Unknown' WHEN level >= elevation / 1000 THEN 'Review' ELSE 'NoFlag' END AS status FROM b JOIN e USING (site_id)""")
def sea_level_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Levels of every second supplier, as sites, against the elevation of customers, as places."""
    s, p = t(spark, d, "supplier"), places(spark, d)
    sites = s.select(F.col("s_suppkey").alias("site_id"), F.expr(S_LON).cast("double").alias("lon"), F.expr(S_LAT).cast("double").alias("lat"))
    extract = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("site_id"), F.col("s_acctbal").alias("mm"))
    near = geo.assign_sites(p, sites, extract, first_km=2000)
    elevation = F.when(F.col("id") % 7 != 0, F.col("weight")) / 1000
    out = geo.compare_elevation(near, p, extract, elevation, "mm", "a stated datum", "baseline-sea-surface", scale=0.001)
    return out.select("id", "site_id", "distance_m", "status")


@query("""WITH p AS (SELECT s_suppkey % 40 AS x, s_suppkey % 37 AS y, 10 + (s_suppkey % 40) * 0.001 + (s_suppkey % 7) * 0.00001 AS lon, 50 - (s_suppkey % 37) * 0.001 + (s_suppkey % 5) * 0.00001 AS lat FROM supplier),
    f AS (SELECT regr_slope(lon, x) AS a, regr_intercept(lon, x) AS c, regr_slope(lat, y) AS e, regr_intercept(lat, y) AS f FROM p),
    q AS (SELECT *, sqrt(pow((a * x + c - lon) * 111320 * cos(radians(lat)), 2) + pow((e * y + f - lat) * 110570, 2)) AS m FROM p, f)
    SELECT count(*) AS n, round(any_value(a), 8) AS a, round(any_value(c), 6) AS c, round(any_value(e), 8) AS e, round(any_value(f), 6) AS f, round(sqrt(avg(m * m)), 4) AS rms_m, round(max(m), 4) AS max_m FROM q""")
def placement_fit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = t(spark, d, "supplier").select(k.alias("id"), (k % 40).alias("x"), (k % 37).alias("y"), (10 + (k % 40) * 0.001 + (k % 7) * 0.00001).alias("lon"), (50 - (k % 37) * 0.001 + (k % 5) * 0.00001).alias("lat"))
    fit = geo.fit_placement(p, "north-up").report["fit"]
    return fit.select("n", r("a", 8).alias("a"), r("c", 6).alias("c"), r("e", 8).alias("e"), r("f", 6).alias("f"), r("rms_m").alias("rms_m"), r("max_m").alias("max_m"))


@query("""WITH s AS (SELECT s_suppkey // 50 AS part, ((s_suppkey * 71) % 3600) * 10.0 AS x, ((s_suppkey * 29) % 1200) * 10.0 AS y FROM supplier)
    SELECT part, count(*) AS cells, round((max(x) - min(x) + 200) * (max(y) - min(y) + 200), 0) AS area FROM s GROUP BY 1""")
def voronoi_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a group fill its bounds without gap or overlap, so their areas add up to it."""
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(k.alias("id"), F.floor(k / 50).alias("part"), (k * 71 % 3600 * 10.0).alias("east"), (k * 29 % 1200 * 10.0).alias("north"))
    bounds = s.groupBy("part").agg(F.min("east").alias("left"), F.min("north").alias("bottom"), F.max("east").alias("right"), F.max("north").alias("top"))
    ring = F.col("geometry")[0]
    turn = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"])
    cells = geo.voronoi(s, bounds, "part").withColumn("area", F.abs(F.aggregate(turn, F.lit(0.0), lambda a, v: a + v)) / 2)
    return cells.groupBy("part").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("area"), 0).alias("area"))


@query("""WITH l AS (SELECT DISTINCT n_nationkey, n_name, ['clinic', 'hospital', 'communities'][1 + c_custkey % 3] AS word, CASE WHEN n_nationkey % 5 = 0 THEN 'hospital' ELSE 'clinic' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name || ' ' || word AS name, CASE WHEN word = 'communities' THEN 'area' WHEN word = kind THEN 'exact' ELSE 'type-differs' END AS outcome, CASE WHEN word = kind THEN CAST(n_nationkey AS VARCHAR) END AS facility FROM l""")
def register_match(spark: SparkSession, d: str) -> DataFrame:
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    word = F.array(*[F.lit(w) for w in ("clinic", "hospital", "communities")])[(F.col("c_custkey") % 3).cast("int")]
    listed = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws(" ", "n_name", word).alias("name"))
    kind = F.when(F.col("n_nationkey") % 5 == 0, "hospital").otherwise("clinic")
    facilities = n.select(F.col("n_nationkey").cast("string").alias("facility"), F.col("n_name").alias("name"), kind.alias("type"))
    return register.match_register(listed, {"nations": facilities}, area_markers=["Communities"]).df.select("name", "outcome", "facility")


@query("SELECT p_brand, CAST(sum(p_size) AS DOUBLE) AS size FROM part GROUP BY 1")
def total_column(spark: SparkSession, d: str) -> DataFrame:
    """A column that came as text, totalled in place of the table's value."""
    return tables.total_column(t(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("size")), ["p_brand"], "size")


@query("SELECT category, row_number() OVER (ORDER BY first) - 1 AS class, n FROM (SELECT p_type AS category, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1)")
def category_classes(spark: SparkSession, d: str) -> DataFrame:
    return tables.category_classes(t(spark, d, "part"), "p_type", ["p_partkey"])


# --- polygons over each other -------------------------------------------------------------------------------------------


def _box(k: str, x: str, y: str, w: str, h: str) -> str:
    """A box in metres as a polygon, by SQL expressions over a key."""
    x, y, w, h = (f"CAST({e.format(k)} AS DOUBLE)" for e in (x, y, w, h))
    corner = lambda a, b: f"named_struct('x', {a}, 'y', {b})"
    return f"array(array({corner(x, y)}, {corner(f'{x} + {w}', y)}, {corner(f'{x} + {w}', f'{y} + {h}')}, {corner(x, f'{y} + {h}')}, {corner(x, y)}))"


#: West, south, width and height of a customer's plot and of a supplier's district, in metres.
PLOT = ("{0} * 37 % 1800 * 10 - 4000", "{0} * 53 % 1200 * 10 - 3000", "150 + {0} % 7 * 120", "200 + {0} % 5 * 170")
DISTRICT = ("{0} * 71 % 1700 * 10 - 4000", "{0} * 29 % 1100 * 10 - 3000", "900 + {0} % 3 * 700", "700 + {0} % 4 * 500")
_PLOTS = "SELECT c_custkey AS id, c_nationkey AS nation, " + ", ".join(f"{e.format('c_custkey')} AS {n}" for e, n in zip(PLOT, "xywh", strict=True)) + " FROM customer"
_DISTRICTS = "SELECT s_suppkey AS name, " + ", ".join(f"{e.format('s_suppkey')} AS {n}2" for e, n in zip(DISTRICT, "xywh", strict=True)) + " FROM supplier"


def plots(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.expr(_box("c_custkey", *PLOT)).alias("geometry"))


def districts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.expr(_box("s_suppkey", *DISTRICT)).alias("geometry"))


@query(f"""WITH p AS ({_PLOTS}), q AS ({_DISTRICTS}) SELECT id, name, CAST((least(x + w, x2 + w2) - greatest(x, x2)) * (least(y + h, y2 + h2) - greatest(y, y2)) AS DOUBLE) AS area
    FROM p JOIN q ON x < x2 + w2 AND x2 < x + w AND y < y2 + h2 AND y2 < y + h""")
def clipped_polygons(spark: SparkSession, d: str) -> DataFrame:
    return overlay.clip_polygons(plots(spark, d), districts(spark, d), digits=3).select("id", "name", "area")


@query(f"""WITH p AS ({_PLOTS}), xs AS (SELECT nation, v, lead(v) OVER (PARTITION BY nation ORDER BY v) AS v2 FROM (SELECT nation, x AS v FROM p UNION SELECT nation, x + w FROM p)),
    ys AS (SELECT nation, v AS u, lead(v) OVER (PARTITION BY nation ORDER BY v) AS u2 FROM (SELECT nation, y AS v FROM p UNION SELECT nation, y + h FROM p)),
    strips AS (SELECT DISTINCT xs.nation, v, v2, u, u2 FROM p JOIN xs ON xs.nation = p.nation AND v >= x AND v2 <= x + w JOIN ys ON ys.nation = p.nation AND u >= y AND u2 <= y + h),
    whole AS (SELECT nation, sum((v2 - v) * (u2 - u)) AS combined FROM strips GROUP BY 1)
    SELECT nation, count(*) AS parts, CAST(sum(w * h) AS DOUBLE) AS parts_area, CAST(any_value(combined) AS DOUBLE) AS combined_area, CAST(sum(w * h) - any_value(combined) AS DOUBLE) AS overlap FROM p JOIN whole USING (nation) GROUP BY 1""")
def combined_areas(spark: SparkSession, d: str) -> DataFrame:
    areas = overlay.combined_area(plots(spark, d), "nation").report["areas"]
    return areas.select("nation", "parts", *[r(c, 3).alias(c) for c in ("parts_area", "combined_area", "overlap")])


@query(f"SELECT id, CAST(1 AS BIGINT) AS pieces, round(w * h + 2 * (w + h) * 50 + 16 * 2500 * sin(pi() / 16), 1) AS area FROM ({_PLOTS})")
def buffered_areas(spark: SparkSession, d: str) -> DataFrame:
    return overlay.buffer_area(plots(spark, d), 50.0, grid=1e-5).select("id", "pieces", r("area", 1).alias("area"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS f, s_nationkey + 1000000 AS g, 1 + s_suppkey % 3 AS c FROM supplier), b AS (SELECT f, g, c FROM e UNION ALL SELECT g, f, c FROM e),
    walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS cost FROM supplier UNION SELECT origin, b.g, cost + c FROM walk JOIN b ON node = b.f WHERE cost + c <= 4),
    k AS (SELECT origin, node, min(cost) AS cost FROM walk GROUP BY 1, 2), l AS (SELECT unnest([2, 4]) AS "limit"), o AS (SELECT DISTINCT origin FROM k),
    s AS (SELECT o.origin, "limit", c, greatest(0, "limit" - coalesce(a.cost, 99)) AS x, greatest(0, "limit" - coalesce(b.cost, 99)) AS y FROM o, l, e LEFT JOIN k a ON a.origin = o.origin AND a.node = f LEFT JOIN k b ON b.origin = o.origin AND b.node = g)
    SELECT origin, CAST("limit" AS DOUBLE) AS "limit", count(*) AS streets, CAST(sum(least(c, least(x, c) + least(y, c))) AS DOUBLE) AS covered FROM s WHERE x + y > 0 GROUP BY 1, 2""")
def streets_covered(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    one = s.select(F.col("s_suppkey").alias("from"), (F.col("s_nationkey") + 1000000).cast("long").alias("to"), (1 + F.col("s_suppkey") % 3).alias("length"))
    both = one.unionByName(one.select(F.col("to").alias("from"), F.col("from").alias("to"), "length"))
    return network.covered_totals(both, s.select(F.col("s_suppkey").alias("node")), [2.0, 4.0])


@query()
def isochrones(spark: SparkSession, d: str) -> DataFrame:
    """The ground within 10 and 20 minutes of every customer, on streets that join each supplier with the next."""
    place = lambda k, box: (F.expr(box[0].format(k)).cast("double").alias("x"), F.expr(box[1].format(k)).cast("double").alias("y"))
    nodes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), *place("s_suppkey", DISTRICT))
    after = nodes.select((F.col("node") - 1).alias("from"), F.col("node").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = after.join(nodes, F.col("from") == F.col("node")).select("from", "to", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("length"))
    edges = edges.unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to"), "length"))
    sites = t(spark, d, "customer").select(F.col("c_custkey").alias("site"), *place("c_custkey", PLOT))
    return network.isochrones(sites, nodes, edges, [10, 20], 75.0).df.select("site", "minutes", "pieces", r("area", 2).alias("area"))


_ORDER_STRATA = """(SELECT month(o_orderdate) AS m, count(*) FILTER (WHERE o_orderpriority < '3' AND o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderpriority < '3' AND o_orderstatus <> 'F') AS b,
    count(*) FILTER (WHERE o_orderpriority >= '3' AND o_orderstatus = 'F') AS c, count(*) FILTER (WHERE o_orderpriority >= '3' AND o_orderstatus <> 'F') AS d FROM orders GROUP BY 1)"""


@query(f"""WITH RECURSIVE s AS MATERIALIZED {_ORDER_STRATA}, w AS MATERIALIZED (SELECT m, x, -lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lw FROM s, LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x)),
    seen AS (SELECT sum(a) AS seen, count(*) AS k FROM s),
    halving AS (SELECT 0 AS i, -3.0::DOUBLE AS low, 3.0::DOUBLE AS high UNION ALL
      SELECT i + 1, CASE WHEN mean < seen THEN (low + high) / 2 ELSE low END, CASE WHEN mean < seen THEN high ELSE (low + high) / 2 END FROM (
        SELECT i, low, high, sum(e) AS mean FROM (SELECT i, low, high, w.m, sum(x * exp(lw + x * (low + high) / 2 - peak)) / sum(exp(lw + x * (low + high) / 2 - peak)) AS e
          FROM (SELECT h.i, h.low, h.high, w.*, max(lw + x * (low + high) / 2) OVER (PARTITION BY w.m) AS peak FROM halving h, w) w GROUP BY ALL) GROUP BY ALL), seen WHERE i < 45)
    SELECT k AS n_strata, round(exp((low + high) / 2), 6) AS odds_ratio FROM halving, seen WHERE i = 45""")
def exact_stratified_odds(spark: SparkSession, d: str) -> DataFrame:
    """Urgent and high priority against the rest, finished against other orders, over months: the conditional odds ratio."""
    o = t(spark, d, "orders").withColumn("m", F.month("o_orderdate"))
    out = measures.exact_odds_ratio(o, F.col("o_orderpriority") < "3", F.col("o_orderstatus") == "F", ["m"])
    return out.select("n_strata", r("odds_ratio", 6).alias("odds_ratio"))


@query("SELECT n_name AS name, CAST('all' AS VARCHAR) AS \"from\", CAST(count(*) AS DOUBLE) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'rich', CAST(count(*) AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1")
def appended_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two counts of heads whose name columns differ and are lined up, under a column that says which is which."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    count = lambda df, key: df.groupBy(F.col("n_name").alias(key)).agg(F.count(F.lit(1)).cast("double").alias("people"))
    first = tables.KeyedTable(count(c, "name"), ["name"], "people", "people")
    return tables.append_tables({"all": first, "rich": tables.KeyedTable(count(c.where("c_acctbal > 5000"), "nation"), ["nation"], "people", "Persons")}, source="from").df


@query("""WITH p AS (SELECT c_custkey AS id, 'a' AS source FROM customer UNION ALL SELECT c_custkey + 10000000, 'b' FROM customer UNION ALL SELECT c_custkey + 20000000, 'b' FROM customer WHERE c_custkey % 5 = 0)
    SELECT id, source, CASE WHEN source = 'b' AND id < 20000000 THEN id - 10000000 ELSE id END AS class_id FROM p""")
def dedup_points_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every place again in a second source some metres off, and every fifth once more farther off: one record of a source joins, the nearer one."""
    p = places(spark, d).select("id", "lon", "lat", F.concat(F.lit("Clinic "), F.col("id").cast("string")).alias("name"), F.lit("a").alias("source"))
    again = lambda shift, east: p.select((F.col("id") + shift).alias("id"), (F.col("lon") + east).alias("lon"), "lat", "name", F.lit("b").alias("source"))
    every = p.unionByName(again(10_000_000, 0.0001)).unionByName(again(20_000_000, 0.0003).where("id % 5 = 0"))
    return dedup.dedup_sources(every, 100.0, 50.0, fuzzy=0.999).df


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT event_id, user_id, i, CASE WHEN value > 80 THEN 'alert' WHEN value > 50 THEN 'watch' ELSE 'none' END AS level FROM e WHERE i = 1
      UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN value > 80 OR (level = 'alert' AND value > 40) THEN 'alert' WHEN value > 50 OR (level <> 'none' AND value > 20) THEN 'watch' ELSE 'none' END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT event_id, level FROM w""")
def rules_recursive(spark: SparkSession, d: str) -> DataFrame:
    """A level that falls more slowly than it rises: it depends on the level concluded for the event before."""
    v = F.col("value")
    level = lambda before: F.when((v > 80) | ((before == "alert") & (v > 40)), "alert").when((v > 50) | ((before != "none") & (v > 20)), "watch").otherwise("none")
    return rules.recursive(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", ["none", "watch", "alert"], level, "event_id", "none", "level").select("event_id", "level")
