"""Nearest neighbours by largest inner product, with collision-counting hashing.

One hash function is one random projection, and its table is the array of the projected values in order. A query's bucket
is a window of that array centred on the query's own value. Virtual rehashing widens all windows together, by the factor
``GROW`` a round; a vector collides in an array if its place there lies between the ends of the window, which are found by search. (Walking the
arrays from the old ends to the new ones and adding to counters was measured at 2.6 ms a query and block, comparing the places with the
ends at 0.4 ms.) A vector that has collided in at least ``COLLIDE`` of the arrays is a candidate (in more, where
the last step brought more than are wanted). There are ``PER_DIMENSION`` arrays for each
dimension, orthogonal directions in runs, since fewer lose neighbours in high dimensions.
Rounds end once a block has ``SHARE`` of its vectors, ``FEWEST`` at least, and ``k`` more as candidates or the windows hold everything. Every
candidate is verified by its inner product on the original vectors in double precision.

Inner products are made distances first: a vector gets one more coordinate that brings it to the length of the longest,
a query is scaled to that length and gets 0. So that long vectors don't flatten these distances, the table is first split
into classes of length at the shares ``CUTS``, each with its own longest.

A class is dealt by the hash of the id into blocks of about ``BLOCK`` vectors and the query set into blocks of about
``QUERIES``; one task holds one block of each and returns each query's best ``k``, so its memory does not grow with the
table, and copies of one vector spread over all blocks.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor as
candidates; a query is compared with the vectors of as many components; of rows with one id the smallest usable vector counts; ties go to
the smaller id; fewer candidates than ``k`` give them all; an empty table or query set gives no row; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import forget, stored
from tallygrove.llm.vectors import by_length, matrix, one_per_id

PER_DIMENSION, FEWEST_ARRAYS, COLLIDE, SHARE, FEWEST = 1.25, 64, 0.85, 0.2, 256
FIRST, GROW = 1.3, 1.15  # half the first window in standard deviations of the projected values, and its factor a round
BLOCK, QUERIES = 4096, 2048
CUTS, UNLIKE = (0.25, 0.5, 0.75, 0.9, 0.97), 1.02  # squares of lengths that differ by a smaller factor are one class


def projections(m: int, d: int, seed: int = 1) -> np.ndarray:
    """m directions in d dimensions, orthogonal in runs of d."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(-(-m // d))]
    return np.concatenate(runs)[:m]


def arrays_for(d: int) -> int:
    return max(FEWEST_ARRAYS, int(PER_DIMENSION * (d + 1)))


class Tables:
    """The sorted arrays of one block."""

    def __init__(self, vectors: np.ndarray, longest: float, m: int) -> None:
        n, d = vectors.shape
        rest = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        self.directions = projections(m, d + 1)
        values = (np.concatenate([vectors, rest[:, None]], axis=1) @ self.directions.T).T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, 1)
        self.place = np.empty((m, n), np.uint16 if n < 1 << 16 else np.uint32)  # of each vector in each array
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None, :], 1)
        self.longest, self.n, self.m = longest, n, m
        self.spread = float(values.std(axis=1).mean()) or 1.0
        self.reach = float(np.abs(values).max()) + longest

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query, in turn, the places of the vectors that collide often enough."""
        scale = self.longest / np.sqrt(np.einsum("ij,ij->i", queries, queries))
        centres = (queries * scale[:, None]) @ self.directions[:, :-1].T
        least = int(np.ceil(COLLIDE * self.m))
        out: list[np.ndarray | None] = [None] * len(queries)
        open_, width = np.arange(len(queries)), FIRST * self.spread
        beyond, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        counter = np.uint8 if self.m < 256 else np.uint16
        while len(open_):
            low = np.stack([np.searchsorted(v, c - width) for v, c in zip(self.sorted, centres[open_].T, strict=True)])
            high = np.stack([np.searchsorted(v, c + width, side="right") for v, c in zip(self.sorted, centres[open_].T, strict=True)])
            low, size = low.astype(self.place.dtype), (high - low).astype(self.place.dtype)
            still = []
            for at, q in enumerate(open_):
                np.subtract(self.place, low[:, at, None], out=beyond)  # unsigned: a place below the window wraps around
                np.less(beyond, size[:, at, None], out=inside)
                hits = np.add.reduce(inside.view(np.uint8), axis=0, dtype=counter)
                found = np.flatnonzero(hits >= least)
                if len(found) >= wanted or width > 2 * self.reach:
                    if len(found) > wanted:  # the last step was too long: the collision threshold rises
                        found = found[hits[found] >= np.partition(hits[found], -wanted)[-wanted]]
                    out[q] = found
                else:
                    still.append(q)
            open_, width = np.array(still, np.int64), width * GROW
        return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, longest: float, k: int, m: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate, score: each query's best k of one block."""
    tables = Tables(vectors, longest, m or arrays_for(vectors.shape[1]))
    wanted = min(len(ids), max(FEWEST, int(SHARE * len(ids))) + k + 1)
    out_q, out_v, out_s = [], [], []
    for q, query, found in zip(query_ids, queries, tables.candidates(queries, wanted), strict=True):
        found = found[ids[found] != q]
        score = np.einsum("ij,j->i", vectors[found], query)
        best = np.lexsort((ids[found], -score))[:k]
        out_q.append(np.full(len(best), q))
        out_v.append(ids[found[best]])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", m: int | None = None, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that meets ``is_query`` (a condition on vec_id)."""
    every = stored(one_per_id(vectors, vec_id, embedding).where("vec is not null"), "vectors")
    every = every.withColumns({"squares": F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), "size": F.size("vec")})
    sizes = {r["size"]: r["count"] for r in every.groupBy("size").count().collect()}  # a number for each length of vectors
    groups, blocks = [], 0  # classes: size, squares above, up to, first block, blocks, longest, chunks
    for size, n in sorted(sizes.items()):
        own = every.where(F.col("size") == size)
        chunks = -(-own.where(is_query).count() // query_block)
        if not chunks:
            continue
        cuts: list[float] = []
        for x in own.approxQuantile("squares", list(CUTS), 0.005) if n > block else ():
            if not cuts or x > UNLIKE * cuts[-1]:
                cuts.append(x)
        nth = F.lit(0)
        for x in cuts:
            nth = nth + (F.col("squares") > x).cast("int")
        for r in own.groupBy(nth.alias("nth")).agg(F.count(F.lit(1)).alias("n"), F.max("squares").alias("most")).collect():  # a row a class
            count = -(-r["n"] // block)
            above, upto = cuts[r["nth"] - 1] if r["nth"] else -1.0, cuts[r["nth"]] if r["nth"] < len(cuts) else float("inf")
            groups.append((size, above, upto, blocks, count, float(r["most"]) ** 0.5, chunks))
            blocks += count
    longest_of = {first + i: longest for _, _, _, first, count, longest, _ in groups for i in range(count)}  # a number a block

    def search(group, table, asked):
        q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if table.num_rows and asked.num_rows:
            longest = longest_of[group[0].as_py()]
            q, v, s = search_block(table["vec_id"].to_numpy(), matrix(table["vec"]), asked["vec_id"].to_numpy(), matrix(asked["vec"]), longest, k, m)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    classes = F.broadcast(vectors.sparkSession.createDataFrame(groups, "c_size int, above double, upto double, first long, count int, longest double, chunks int"))  # a row a class
    dealt = every.join(classes, (F.col("size") == F.col("c_size")) & (F.col("squares") > F.col("above")) & (F.col("squares") <= F.col("upto")))
    dealt = dealt.select("vec_id", "vec", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("count"))).alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    asked = every.where(is_query).join(classes, F.col("size") == F.col("c_size"))
    asked = asked.select("vec_id", "vec", F.explode(F.expr("sequence(first, first + count - 1)")).alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"))
    asked = asked.toDF(*asked.columns)  # columns of its own, as both sides come from one table
    found = dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = stored(found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    forget(every)
    return out


def audit(vectors: DataFrame, result: DataFrame, k: int = 20, sample: int = 200, vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """Share of the true k nearest that ``result`` holds, by brute force for at most ``sample`` of its queries."""
    every = one_per_id(vectors, vec_id, embedding).where("vec is not null")
    asked = result.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(sample).join(every, F.col("query_id") == F.col("vec_id")).select("query_id", "vec").collect()
    if not asked:
        return 1.0
    queries: dict[int, list] = {}
    for r in asked:
        queries.setdefault(len(r[1]), []).append(r)

    def brute(batches):
        for batch in batches:
            for length, at, x in by_length(batch.column(1)):
                v = batch.column(0).to_numpy()[at]
                for query, vec in queries.get(length, ()):
                    scores = np.where(v == query, -np.inf, x @ np.array(vec))
                    best = np.lexsort((v, -scores))[:k]
                    best = best[scores[best] > -np.inf]
                    yield pa.record_batch([pa.array(np.full(len(best), query)), pa.array(v[best]), pa.array(scores[best])], names=["query_id", "vec_id", "score"])

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = every.select("vec_id", "vec").mapInArrow(brute, "query_id long, vec_id long, score double").withColumn("rank", nth).where(F.col("rank") <= k)
    hit = true.join(result.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hit[0] / hit[1] if hit[1] else 1.0
