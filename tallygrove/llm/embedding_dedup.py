"""Near-duplicate embeddings through robust-pruned graphs of the vectors that have a near one.

Shards. A bounded sample of the vectors (``SAMPLE``) gives cluster centres; every vector joins the shards of all centres that are
not much farther than its nearest one, so shards overlap.

No pair is lost between shards: let unit vectors u and v have the nearest centres a and b. If u is not in the shard of b and v not in
that of a, then u.(a - b) and v.(b - a) are both above reach * |a - b|, so (u - v).(a - b) is above 2 * reach * |a - b|; but
|u - v| is at most the chord of ``least``, which with reach = chord / 2 is a contradiction. On clustered vectors a vector has few
such shards, on isotropic ones many; so the number of centres is the one for which, by the sample, comparing and moving cost least.

Sieve. The vectors whose nearest centre is that of a shard meet its members, in parts of bounded size, by matrix products in single precision; what
is nearer to ``least`` than their rounding is decided in double precision. A part returns the smallest vector that each is connected with, never
pairs; connected components are then joined over the parts. Vectors are moved as they came (four bytes a component, where those hold it), and parts are dealt
in rounds, each of which moves about ``MOVED`` bytes or once the vectors, so disk does not grow with the square of the table.

Build. Links lie within components, so a component is a shard of the graph; small ones share a bundle, one above ``BLOCK`` members is dealt into blocks
by the hash of the id. In each block every vector takes its nearest members and some distant ones as candidates, robust pruning (``ALPHA``)
keeps at most ``DEGREE`` of them in spread directions, and each edge is also laid the other way.

Search. Every vector is a query in the blocks of its component: a greedy search starts from the
block's medoids and the query's own node and follows the best ``BEAM`` nodes (more in high dimensions); after that its range expands, as long as
nodes within ``least - SLACK`` that have not been followed are left. What lies within ``least`` by cosine in double
precision is a link. A block returns the number of links of each query. Blocks too are searched in rounds.

Copies of one vector (equal components) are one node with a weight, so no block gathers them. Blocks of a shard that was
dealt are all searched, by blocks of its queries, so a hot shard becomes many tasks of bounded size.

The audit takes a uniform sample of ``AUDITED`` nodes and counts all their links by brute force over all nodes. What was found is verified,
so a node's number of links is right if and only if none is missing. ``audited_recall`` is the share of the sample's links that was found
(null if it has none), ``audited_links`` their number.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and are classes of their
own; vectors of different lengths are never compared; rows without id are left out; of rows with one id the smallest usable
vector counts; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import components, forget, grouped_chars, mixed, release_shuffles, stored
from tallygrove.llm.vectors import by_length, matrix, one_per_id, packed, unit_rows, unpacked

LEAST, SLACK = 0.95, 0.05
SAMPLE, MOST_CENTRES, BLOCK, APART = 16384, 512, 2048, 0.85
PART, ASKED, STRIP = 16, 8, 256  # blocks of members and of queries that meet in one task of the sieve, at 64 dimensions; queries at once
ROW = 3000  # pairs of vectors that are compared in the time in which one is moved
MOVED = 1 << 27  # bytes of vectors that a round moves, or as many as all vectors have
NEAR, FAR, DEGREE, ALPHA = 40, 8, 16, 1.2
BEAM, BEAM_SHARE, MEDOIDS, BATCH = 24, 0.375, 8, 256  # nodes that a search follows, for each dimension above 64
AUDITED = 2048
SHARDS = 1 << 16  # numbers of shards for each length


def reach_of(least: float) -> float:
    """How much nearer, by the distance of two centres, the nearest may be before a vector leaves the other one's shard: half the chord of ``least``."""
    return float(np.sqrt(max(0.0, 2 - 2 * least))) / 2 + 1e-9


def homes_of(unit: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and a matrix of the shards that it joins."""
    near = unit @ centres.T
    top = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
    joins = near[np.arange(len(unit)), top][:, None] - near <= reach * apart[top]
    joins[np.arange(len(unit)), top] = True
    return top, joins


def centres_of(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most k unit centres of unit vectors (spherical k-means; an empty cluster takes a new member). Of centres within
    ``APART`` one stays, so that a dense group is one shard, dealt into blocks, and not many shards that miss each other."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    out = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        own = np.argmax(sample @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.abs(sums).sum(axis=1) == 0)
        sums[empty] = sample[rng.integers(0, len(sample), len(empty))]
        out = unit_rows(sums)
    apart: list[int] = []
    for i in range(len(out)):
        if not apart or (out[apart] @ out[i]).max() < APART:
            apart.append(i)
    return out[apart]


def parts_of(length: int, block: int) -> tuple[int, int]:
    """Members and queries that meet in one task of the sieve: fewer of long vectors."""
    share = min(1.0, 64 / length)
    return max(block, int(PART * block * share)), max(block, int(ASKED * block * share))


def fewest_moved(sample: np.ndarray, n: int, block: int, reach: float) -> np.ndarray:
    """Centres for n vectors: of several numbers of them, the one for which comparing and moving cost least, judged by the half of the
    sample that gave no centre (one's own centres lie too near)."""
    members, queries = parts_of(sample.shape[1], block)
    most = max(1, min(MOST_CENTRES, 2 * n // block, len(sample) // 16)) if n > block // 2 else 1
    options = []
    while True:
        centres = centres_of(sample[::2], most)
        homes, k = float(homes_of(sample[len(sample) > 1 :: 2], centres, reach)[1].sum(axis=1).mean()), len(centres)
        moved = homes * np.ceil(n / k / queries) + np.ceil(homes * n / k / members)
        options.append((n * (homes * n / k + ROW * moved), len(options), centres))
        if most == 1:
            return min(options, key=lambda o: o[:2])[2]
        most //= 2


def rounds_of(moved: int, whole: int) -> int:
    """Rounds in which so many bytes are moved; ``whole`` is the bytes of all vectors."""
    return max(1, -(-moved // max(MOVED, whole)))


def united(low: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """low (for each number the smallest one known to be connected with it) with what a matrix links: rows are the numbers a, columns b."""
    none = len(low)
    while True:
        of_a, of_b = low[a], low[b]
        to_a = np.minimum(of_a, np.where(linked, of_b[None, :], none).min(axis=1, initial=none))
        to_b = np.minimum(of_b, np.where(linked, to_a[:, None], none).min(axis=0, initial=none))
        if (to_a == of_a).all() and (to_b == of_b).all():
            return low
        low = low.copy()
        np.minimum.at(low, of_a, to_a)
        np.minimum.at(low, of_b, to_b)
        while not np.array_equal(low, below := low[low]):
            low = below


def sieved(nodes: np.ndarray, unit: np.ndarray, q_nodes: np.ndarray, q_unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of members and queries of one part: each node that is linked with a smaller one, over others or not, and the smallest such node."""
    everyone = np.unique(np.concatenate([nodes, q_nodes]))
    at, q_at, low = np.searchsorted(everyone, nodes), np.searchsorted(everyone, q_nodes), np.arange(len(everyone))
    place = np.full(len(everyone), -1)
    place[at] = np.arange(len(nodes))
    single, rounding = unit.astype(np.float32).T, (unit.shape[1] + 8) * 6e-8
    for lo in range(0, len(q_nodes), STRIP):
        score = q_unit[lo : lo + STRIP].astype(np.float32) @ single
        own = place[q_at[lo : lo + STRIP]]
        there = np.flatnonzero(own >= 0)
        score[there, own[there]] = -2.0
        linked = score >= least - rounding
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            continue
        columns = np.flatnonzero(linked[rows].any(axis=0))
        linked, score = linked[np.ix_(rows, columns)], score[np.ix_(rows, columns)]
        i, j = np.nonzero(linked & (score < least + rounding))
        for some in range(0, len(i), 1 << 16):
            r, c = i[some : some + (1 << 16)], j[some : some + (1 << 16)]
            linked[r, c] = np.einsum("ij,ij->i", q_unit[lo + rows[r]], unit[columns[c]]) >= least
        low = united(low, q_at[lo + rows], at[columns], linked)
    some = np.flatnonzero(low < np.arange(len(low)))
    return everyone[some], everyone[low[some]]


def robust_pruned(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of one block: robust pruning of near and some distant members, and the reverse of each edge."""
    n = len(unit)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = unit.astype(np.float32)  # edges only guide the search; links are verified in doubles
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2.0)
    near = min(NEAR, n - 1)
    found = np.concatenate([np.argpartition(cosine[lo : lo + 256], n - near, axis=1)[:, n - near :] for lo in range(0, n, 256)])
    far = np.random.default_rng(seed).integers(0, n, (n, min(FAR, n - 1)))
    found = np.concatenate([found, far], axis=1)
    sims = np.take_along_axis(cosine, found, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
    alive = found != np.arange(n)[:, None]
    rows, to, every = [], [], np.arange(n)
    for _ in range(DEGREE):
        first = np.argmax(alive, axis=1)
        live = alive[every, first]
        if not live.any():
            break
        chosen = found[every, first]
        rows.append(every[live])
        to.append(chosen[live])
        between = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[chosen[:, None], found]))
        between[found == chosen[:, None]] = 0.0
        alive &= ALPHA * between > distance
    a, b = np.concatenate(rows), np.concatenate(to)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return both // n, both % n


def medoids_of(unit: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The member nearest to the mean, then those farthest from the chosen ones."""
    chosen = [int(np.argmax(unit @ unit.mean(axis=0)))]
    nearest = unit @ unit[chosen[0]]
    while len(chosen) < min(k, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return np.array(chosen)


def range_search(unit: np.ndarray, starts: np.ndarray, heads: np.ndarray, entries: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within ``least`` met by greedy search and range expansion. starts, heads: the adjacency lists end
    to end; entries: where searches begin; own: the query's node, or -1."""
    n, b = len(unit), len(queries)
    score = np.full(b * n, -np.inf)
    front = np.full(b * n, -np.inf)  # scores of nodes that are met and not yet followed

    def visit(flat: np.ndarray) -> None:
        flat = flat[score[flat] == -np.inf]
        if len(flat):
            score[flat] = front[flat] = np.einsum("ij,ij->i", queries[flat // n], unit[flat % n])

    def follow(flat: np.ndarray) -> None:
        front[flat] = -np.inf
        node = flat % n
        count = starts[node + 1] - starts[node]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[node], count)
        visit(np.repeat(flat - node, count) + heads[place])

    visit((np.arange(b)[:, None] * n + entries[None, :]).ravel())
    with_own = np.flatnonzero(own >= 0)
    visit(with_own * n + own[with_own])
    row, by_query = np.arange(b), front.reshape(b, n)
    for _ in range(min(n, max(BEAM, int(BEAM_SHARE * unit.shape[1])))):
        flat = row * n + np.argmax(by_query, axis=1)
        flat = flat[front[flat] > -np.inf]
        if not len(flat):
            break
        follow(flat)
    while True:
        flat = np.flatnonzero(front >= least - SLACK)
        if not len(flat):
            break
        for lo in range(0, len(flat), 1 << 16):
            follow(flat[lo : lo + (1 << 16)])
    hits = np.flatnonzero(score >= least)
    q, v = hits // n, hits % n
    keep = v != own[q]
    return q[keep], v[keep]


def search_block(nodes: np.ndarray, unit: np.ndarray, copies: np.ndarray, q_nodes: np.ndarray, q_unit: np.ndarray, seed: int, least: float) -> np.ndarray:
    """The links of each query with the members of one block, found over the block's graph."""
    order = np.argsort(nodes)
    nodes, unit, copies = nodes[order], unit[order], copies[order]
    source, heads = robust_pruned(unit, seed)
    starts = np.searchsorted(source, np.arange(len(nodes) + 1))
    own = np.minimum(np.searchsorted(nodes, q_nodes), len(nodes) - 1)
    own = np.where(nodes[own] == q_nodes, own, -1)
    qs, vs, entries = [], [], medoids_of(unit)
    for lo in range(0, len(q_nodes), BATCH):
        q, v = range_search(unit, starts, heads, entries, q_unit[lo : lo + BATCH], own[lo : lo + BATCH], least)
        qs.append(q + lo)
        vs.append(v)
    q, v = np.concatenate(qs), np.concatenate(vs)
    if len(q):  # what one of two queries of this task found counts for both, where both are in the index
        n = len(nodes)
        as_query = np.full(n, -1)
        as_query[own[own >= 0]] = np.flatnonzero(own >= 0)
        back = (as_query[v] >= 0) & (own[q] >= 0)
        pairs = np.unique(np.concatenate([q * n + v, as_query[v[back]] * n + own[q[back]]]))
        q, v = pairs // n, pairs % n
    return np.bincount(q, copies[v], minlength=len(q_nodes)).astype(np.int64)


def _homed(column, centres: dict[int, np.ndarray], reach: float):
    """Runs of rows of an Arrow column of vectors: length, places, vectors, nearest centre, and a matrix of the shards that they join."""
    for length, at, x in by_length(column):
        known, step = centres.get(length, np.zeros((1, length))), max(64, (1 << 18) // length)
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            yield length, at[lo : lo + step], some, *homes_of(unit_rows(some), known, reach)


def _sieved_links(nodes: DataFrame, centres: dict[int, np.ndarray], reach: float, block: int, width: int, least: float) -> list[DataFrame]:
    """Stored tables of node and low, a smaller node that it is connected with, whose components are those of all links."""
    spark = nodes.sparkSession
    known = spark.sparkContext.broadcast(centres)  # MOST_CENTRES vectors a length at most

    def counted(batches):
        for batch in batches:
            for length, _, _, top, joins in _homed(batch.column(0), known.value, reach):
                n, asked = joins.sum(axis=0), np.bincount(top, minlength=joins.shape[1])
                yield pa.record_batch([pa.array(length * SHARDS + np.arange(len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(asked, pa.int64())], names=["shard", "n", "asked"])

    shards = nodes.select("vec").mapInArrow(counted, "shard long, n long, asked long").groupBy("shard").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect()  # a row a centre and length
    parts, moved, whole = {}, 0, 0
    for shard, n, asked in sorted(map(tuple, shards)):
        length = shard // SHARDS
        members, queries = parts_of(length, block)
        cuts = -(-n // members), -(-asked // queries)
        parts.setdefault(length, {})[shard % SHARDS] = cuts
        moved, whole = moved + (n * cuts[1] + asked * cuts[0]) * length * width, whole + asked * length * width
    rounds = rounds_of(moved, whole)
    cuts = spark.sparkContext.broadcast({length: np.array([of[s] for s in range(len(of))]) for length, of in parts.items()})

    def dealt(now: int):
        def deal(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for length, at, x, top, joins in _homed(batch.column(1), known.value, reach):
                    members, queries = cuts.value[length].T
                    node, whole = ids[at], packed(x)
                    i, j = (mixed(node.view(np.uint64) + np.uint64(k)).astype(np.uint32) for k in (0, 1))
                    turn = lambda shard, i: mixed((shard * SHARDS + i).astype(np.uint64)) % np.uint64(rounds) == now
                    row, shard = np.nonzero(joins)
                    part = i[row] % members[shard]
                    some = turn(shard, part)
                    row, shard, part = row[some], shard[some], part[some]
                    again = queries[shard]
                    row, shard, part, other = np.repeat(row, again), np.repeat(shard, again), np.repeat(part, again), grouped_chars(again)
                    again = members[top]
                    q_row, q_part = np.repeat(np.arange(len(x)), again), grouped_chars(again)
                    some = turn(top[q_row], q_part)
                    q_row, q_part = q_row[some], q_part[some]
                    rows = np.concatenate([row, q_row])
                    columns = [length * SHARDS + np.concatenate([shard, top[q_row]]), np.concatenate([part, q_part]), np.concatenate([other, j[q_row] % queries[top[q_row]]])]
                    yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.arange(len(rows)) >= len(row)), pa.array(node[rows]), whole.take(pa.array(rows))], names=["shard", "i", "j", "asked", "node", "vec"])

        return nodes.select("node", "vec").mapInArrow(deal, "shard long, i long, j long, asked boolean, node long, vec binary")

    def sieve(key, table):
        x, node, asked = unpacked(table["vec"], key[0].as_py() // SHARDS), table["node"].to_numpy(), table["asked"].to_numpy().astype(bool)
        unit = unit_rows(x)
        found, low = sieved(node[~asked], unit[~asked], node[asked], unit[asked], least)
        return pa.table({"node": pa.array(found, pa.int64()), "low": pa.array(low, pa.int64())})

    out = []
    for now in range(rounds):
        out.append(stored(dealt(now).groupBy("shard", "i", "j").applyInArrow(sieve, "node long, low long"), "sieved"))
        release_shuffles(spark)
    return out


def _found_links(members: DataFrame, block: int, width: int, least: float) -> list[DataFrame]:
    """Stored tables of node and links, to be added up. members: node, vec, copies, component."""
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    bundles = max(1, -(-members.count() // max(1, block // 2)))  # of small components
    large = F.col("n") > block // 2
    part = lambda salt, count: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))
    d = members.join(sizes, "component").select(
        "node", "vec", "copies", F.size("vec").alias("length"), large.alias("large"), F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("shard"),
        F.when(large, F.ceil(F.col("n") / block)).otherwise(1).alias("splits"), F.when(large, F.ceil(F.col("n") / block)).otherwise(1).alias("queries"),
    )
    moved, whole = d.agg(F.sum((F.col("splits") + F.col("queries")) * F.col("length")), F.sum("length")).first()
    rounds = rounds_of((moved or 0) * width, (whole or 0) * width)
    keys = ["length", "large", "shard", "i", "j"]
    as_row = lambda i, j, asked: d.withColumn("i", i).withColumn("j", j).select(*keys, F.lit(asked).alias("asked"), "node", "vec", "copies")
    indexed = as_row(part(17, "splits"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1)), False)
    asked = as_row(F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)), part(19, "queries"), True)

    def thin(batches):
        for batch in batches:
            for _, at, x in by_length(batch.column(7)):
                row = batch.take(pa.array(at))
                yield pa.record_batch([*row.columns[:7], packed(x), row.column(8)], names=[*keys, "asked", "node", "vec", "copies"])

    def search(key, table):
        x, node, copies, of = unpacked(table["vec"], key[0].as_py()), table["node"].to_numpy(), table["copies"].to_numpy(), table["asked"].to_numpy().astype(bool)
        unit, links = unit_rows(x), np.zeros(int(of.sum()), np.int64)
        if of.any() and not of.all():
            links = search_block(node[~of], unit[~of], copies[~of], node[of], unit[of], int(key[2].as_py()) % SHARDS, least)
        return pa.table({"node": pa.array(node[of]), "links": pa.array(links, pa.int64())})

    out = []
    for now in range(rounds):
        turn = F.pmod(F.xxhash64("length", "large", "shard", "i"), F.lit(rounds)) == now
        both = indexed.where(turn).unionByName(asked.where(turn)).mapInArrow(thin, "length int, large boolean, shard long, i long, j long, asked boolean, node long, vec binary, copies long")
        out.append(stored(both.groupBy(*keys).applyInArrow(search, "node long, links long"), "found"))
        release_shuffles(spark)
    return out


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST, block: int = BLOCK, reach: float | None = None) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept, and audited_recall and audited_links (the same numbers in each row)."""
    spark = vectors.sparkSession
    reach = reach_of(least) if reach is None else reach
    width = 4 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else 8  # bytes of a component
    every = one_per_id(vectors, vec_id, embedding)
    digest = F.when(F.col("vec").isNotNull(), F.md5(F.concat_ws(",", F.col("vec").cast("array<string>"))))
    whole = stored(every.select("vec_id", "vec", digest.alias("digest")), "vectors")
    release_shuffles(spark)
    repeated = whole.where("vec is not null").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = stored(repeated, "repeated")  # its size is known from here on: where it is small, vectors stay where they are
    nodes = whole.where("vec is not null").join(repeated, "digest", "left").where("node is null or node = vec_id")
    nodes = stored(nodes.select("digest", F.col("vec_id").alias("node"), "vec", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "nodes")
    every = stored(whole.select("vec_id", "digest"), "keys")
    forget(whole, repeated)
    release_shuffles(spark)
    lengths = {r["size"]: r["count"] for r in nodes.groupBy(F.size("vec").alias("size")).count().collect()}  # a number a length
    if not lengths:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audited_recall"), F.lit(0).cast("long").alias("audited_links"))
    centres = {}
    for length, n in lengths.items():
        if n > block // 2:  # fewer are one shard
            own = nodes.where(F.size("vec") == length)
            drawn = own.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // SAMPLE))) == 0).limit(SAMPLE).select("vec").collect()
            centres[length] = fewest_moved(unit_rows(np.array([r[0] for r in drawn or own.limit(SAMPLE).select("vec").collect()])), n, block, reach)
    sieved_links = _sieved_links(nodes, centres, reach, block, width, least)
    joined = stored(components(_all(sieved_links), "node", "low"), "joined")
    members = stored(nodes.select("node", "vec", "copies").join(joined, "node"), "members")
    found = _found_links(members, block, width, least)
    links = _all(found).groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.select("digest", "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    classes = stored(classes.select("digest", "node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "classes")
    recall, links_there = audit(nodes, classes, least)
    out = every.select("vec_id", "digest").join(classes.drop("copies"), "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    told = [F.lit(recall).cast("double").alias("audited_recall"), F.lit(links_there).cast("long").alias("audited_links")]
    out = stored(out.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"), *told), "embedding-classes")
    forget(every, nodes, joined, members, classes, *sieved_links, *found)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def audit(nodes: DataFrame, classes: DataFrame, least: float = LEAST, sample: int = AUDITED) -> tuple[float | None, int]:
    """Of the links that a uniform sample of nodes has by brute force over all nodes: the share that was found, and their number."""
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(3))).limit(sample).select("node", "vec", "copies").collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(len(r["vec"]), []).append(r)
    asked = {length: (np.array([r["node"] for r in some]), unit_rows(np.array([r["vec"] for r in some]))) for length, some in by.items()}

    def brute(batches):
        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for length, at, x in by_length(batch.column(1)):
                if length in asked:
                    ids, unit = asked[length]
                    hits = (unit @ unit_rows(x).T >= least) & (ids[:, None] != node[at][None, :])
                    yield pa.record_batch([pa.array(ids), pa.array(hits @ copies[at])], names=["node", "exact"])

    exact = nodes.select("node", "vec", "copies").mapInArrow(brute, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    own = {r["node"]: r["copies"] - 1 for r in drawn}
    rows = exact.join(classes, "node").select("node", "exact", "n_links").collect()  # at most ``sample`` rows
    there = sum(r["exact"] for r in rows)
    found = sum(min(r["exact"], r["n_links"] - own[r["node"]]) for r in rows)
    return (found / there if there else None), there
