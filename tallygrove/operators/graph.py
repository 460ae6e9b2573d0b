"""Transmission chains and travel along networks, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.report import OpResult, stored


def chains(cases: DataFrame, case: str, source: str, rounds: int = 40) -> OpResult:
    """case, source, root, generation (0: no known source), status: index, linked, source missing, loop.

    Pointer jumping: every round doubles the distance looked back, so a chain of n cases takes log2 n joins. Several sources
    of one case: the smallest counts, and the case is reported. Reports: ``several``.
    """
    raw = cases.select(F.col(case).alias("case"), F.col(source).alias("source")).where("case is not null")
    one = raw.groupBy("case").agg(F.min("source").alias("source"), F.count_distinct("source").alias("n_sources"))
    known = one.select(F.col("case").alias("known"))
    base = one.join(known, F.col("source") == F.col("known"), "left").select("case", "source", F.col("known").alias("up"), F.lit(1).alias("steps"))
    base = base.withColumn("steps", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"))
    state = stored(base.select("case", "source", F.coalesce("up", "case").alias("up"), "steps"), "chains")
    size = state.count()
    for _ in range(rounds):
        above = state.select(F.col("case").alias("c2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        nxt = stored(state.join(above, F.col("up") == F.col("c2")).select("case", "source", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("steps2") > 0).alias("moved")), "chains")
        state = nxt.drop("moved")
        if not nxt.where("moved and steps <= " + str(size)).limit(1).count():
            break
    loop = F.col("steps") > size
    roots = one.select(F.col("case").alias("r"), F.col("source").isNotNull().alias("root_has_source"))
    out = state.join(roots, F.col("up") == F.col("r"), "left").select(
        "case", "source", F.when(~loop, F.col("up")).alias("root"), F.when(~loop, F.col("steps")).alias("generation"),
        F.when(loop, "loop").when((F.col("steps") == 0) & F.col("source").isNotNull(), "source missing").when(F.col("steps") == 0, "index").otherwise("linked").alias("status"),
    )
    return OpResult(out, {"several": one.where("n_sources > 1").select("case", "n_sources")})


FEW = 64  # streets of a node beyond which it is not compared with others
BLOCK = 1000  # nodes that share their edges, in one row


def twins(edges: DataFrame) -> DataFrame:
    """node, like, other: nodes that have the very same edges (f, t, c) as others, the smallest of them and the next one.

    Costs to and from such nodes agree, so two of them stand for all. Nodes with an edge to themselves or more than ``FEW`` edges are
    left out, so no list of edges is long.
    """
    ends = edges.select(F.col("f").alias("node"), F.lit("out").alias("way"), F.col("t").alias("end"), "c").unionByName(edges.select(F.col("t").alias("node"), F.lit("in").alias("way"), F.col("f").alias("end"), "c"))
    few = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == F.col("end")).alias("loop")).where((F.col("n") <= FEW) & ~F.col("loop")).select("node")
    of = stored(ends.join(few, "node").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("way", "end", "c"))).alias("own")), "own")
    first = of.groupBy("own").agg(F.min("node").alias("like"), F.count(F.lit(1)).alias("n")).where("n > 1").select("own", "like")
    alike = stored(of.join(first, "own").select("node", "like"), "twins")
    other = alike.where("node <> like").groupBy("like").agg(F.min("node").alias("other"))
    return alike.join(other, "like").select("node", "like", "other")


def _without(edges: DataFrame, alike: DataFrame) -> DataFrame:
    """edges (f, t, c) without the nodes that two others stand for."""
    gone = alike.where("node <> like and node <> other").select("node")
    return edges.join(gone.withColumnRenamed("node", "f"), "f", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("f", "t", "c")


def _in_blocks(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, and the values of each key in arrays of about ``BLOCK``."""
    n = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_b"))
    return df.join(n, key).groupBy(key, F.pmod(F.xxhash64(value), F.col("_b")).alias("_k")).agg(F.collect_list(value).alias(f"{value}s")).drop("_k")


def reachable(edges: DataFrame, origins: DataFrame, limit: float, both_ways: bool = False, rounds: int = 500) -> DataFrame:
    """origin, node, cost: every node within ``limit`` of an origin (edges: from, to, cost of 0 or more).

    Rounds of relaxation: only nodes whose cost fell in the last round are expanded, and costs above the limit never leave the
    join, so a round handles the frontier of all origins at once. Nodes with the very same edges are searched and found once, as two of
    them; the rows of all of them are written out at the end, block by block, without a shuffle of such rows.
    """
    e = edges.select(F.col("from").alias("f"), F.col("to").alias("t"), F.col("cost").cast("double").alias("c")).where("c >= 0")
    if both_ways:
        e = e.unionByName(e.select(F.col("t").alias("f"), F.col("f").alias("t"), "c"))
    e = stored(e.groupBy("f", "t").agg(F.min("c").alias("c")), "edges")
    starts = origins.select(F.col("node").alias("origin")).distinct()
    alike = stored(twins(e), "twins")
    if alike.isEmpty():
        return _settled(e, starts, limit, rounds)
    starts = stored(starts.join(alike.select(F.col("node").alias("origin"), "like"), "origin", "left").select("origin", F.coalesce("like", "origin").alias("start")), "starts")
    found = _settled(stored(_without(e, alike), "edges"), starts.select(F.col("start").alias("origin")).distinct(), limit, rounds).where("origin <> node").withColumnRenamed("origin", "start")
    # a start that others are like stands for itself; the other one of its kind stands for the rest of them
    kinds = alike.where("node = like or node = other").select("node", "like")
    found = found.join(kinds, "node", "left").where("like is null or node = like or start = like").select("start", F.coalesce("like", "node").alias("like"), "node", "cost")
    nodes = _in_blocks(alike.select("like", "node"), "like", "node")
    rows = found.join(nodes, "like", "left").select("start", "cost", F.coalesce("nodes", F.array("node")).alias("nodes")).join(_in_blocks(starts, "start", "origin"), "start")
    rows = rows.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(F.explode("origins").alias("origin"), "nodes", "cost").select("origin", F.explode("nodes").alias("node"), "cost").where("origin <> node")
    return rows.unionByName(starts.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost")))


def _settled(e: DataFrame, starts: DataFrame, limit: float, rounds: int) -> DataFrame:
    best = stored(starts.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost")), "reached")
    front = best
    for _ in range(rounds):
        steps = front.join(e, front.node == e.f).select("origin", F.col("t").alias("node"), (F.col("cost") + F.col("c")).alias("cost")).where(F.col("cost") <= limit)
        steps = steps.groupBy("origin", "node").agg(F.min("cost").alias("new"))
        merged = stored(best.join(steps, ["origin", "node"], "full_outer").select("origin", "node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("fell")), "reached")
        best, front = merged.drop("fell"), merged.where("fell").drop("fell")
        if not front.limit(1).count():
            return best
    raise RuntimeError("the costs did not settle")


def nearest_origin(edges: DataFrame, origins: DataFrame, limit: float, both_ways: bool = False, rounds: int = 500) -> DataFrame:
    """origin, node, cost: every node within ``limit`` of an origin, with the nearest one (ties: the smaller). Rounds as in
    ``reachable``, but a node has one row, however many origins reach it."""
    e = edges.select(F.col("from").alias("f"), F.col("to").alias("t"), F.col("cost").cast("double").alias("c")).where("c >= 0")
    if both_ways:
        e = e.unionByName(e.select(F.col("t").alias("f"), F.col("f").alias("t"), "c"))
    e = stored(e.groupBy("f", "t").agg(F.min("c").alias("c")), "edges")
    best = stored(origins.select("node", F.struct(F.lit(0.0).alias("cost"), F.col("node").alias("origin")).alias("by")).distinct(), "nearest")
    front = best
    for _ in range(rounds):
        steps = front.join(e, front.node == e.f).select(F.col("t").alias("node"), F.struct((F.col("by.cost") + F.col("c")).alias("cost"), F.col("by.origin").alias("origin")).alias("by")).where(F.col("by.cost") <= limit)
        steps = steps.groupBy("node").agg(F.min("by").alias("new"))
        merged = stored(best.join(steps, "node", "full_outer").select("node", F.least("by", "new").alias("by"), (F.col("by").isNull() | (F.col("new") < F.col("by"))).alias("fell")), "nearest")
        best, front = merged.drop("fell"), merged.where("fell").drop("fell")
        if front.isEmpty():
            return best.select("by.origin", "node", "by.cost")
    raise RuntimeError("the costs did not settle")


def travel_bands(reached: DataFrame, cuts: list[float]) -> DataFrame:
    """Nodes with the cost of the nearest origin and the smallest cut that holds it; nodes beyond the last cut go."""
    near = reached.groupBy("node").agg(F.min(F.struct("cost", "origin")).alias("x")).select("node", "x.origin", "x.cost")
    return near.withColumn("band", F.array_min(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda b: b >= F.col("cost")))).where("band is not null")


def directed_edges(ways: DataFrame) -> DataFrame:
    """way_id, from, to, position: consecutive nodes of each way, both ways unless ``oneway`` (yes, -1 or no)."""
    n = ways.select("way_id", F.coalesce("oneway", F.lit("no")).alias("oneway"), F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] AS a, nodes[i] AS b))")).alias("position", "x")).where("x.a <> x.b")
    ahead = n.where("oneway <> '-1'").select("way_id", F.col("x.a").alias("from"), F.col("x.b").alias("to"), "position")
    back = n.where("oneway <> 'yes'").select("way_id", F.col("x.b").alias("from"), F.col("x.a").alias("to"), "position")
    return ahead.unionByName(back)
