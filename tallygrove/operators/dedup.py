"""Records that describe the same thing: by equal keys in a table, by place and name among points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.values import folded, haversine_km, name_similarity
from tallygrove.report import OpResult, Refusal, stored


def dedup_table(df: DataFrame, key: Sequence[str], order: str) -> OpResult:
    """The first row (by ``order``) of each folded key; a key with an empty part is never a repeat. Report: rows by group size."""
    keys = [f"_k{i}" for i in range(len(key))]
    d = df.withColumns({k: F.nullif(folded(F.col(c)), F.lit("")) for k, c in zip(keys, key, strict=True)})
    open_ = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    first = d.where(~open_).groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n_rows"))
    kept = d.join(first, keys, "left").where(F.col("_first").isNull() | (F.col(order) == F.col("_first")))
    return OpResult(kept.select(*df.columns), {"groups": first.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_groups"))})


APART = "source_a <> source OR source_a IS NULL OR source IS NULL"  # an unknown source is no source that two points share
WIDE = 8  # a cell where only points of one name meet, in distances


def nearby_pairs(points: DataFrame, within_m: float, id_: str = "id", name: str = "name", lat: str = "lat", lon: str = "lon", source: str | None = None) -> DataFrame:
    """a, b, distance_m, similarity of points within a distance, of different sources if a source column is named.

    Points meet in cells of a grid on the sphere (unit vectors cut into cubes), each cube compared with the 13 that follow it
    and itself, so every pair meets once and no wrap-around or pole is special.
    """
    s = max(within_m / 6371008.8, 1e-9) * 1.0000001
    rad = lambda c: F.radians(F.col(c))
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(id_).alias("id"), folded(F.col(name)).alias("name"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), (F.col(source) if source else F.monotonically_increasing_id().cast("string")).alias("source"),
        *[F.floor(v / s).alias(n) for n, v in (("x", F.cos(rad(lat)) * F.cos(rad(lon))), ("y", F.cos(rad(lat)) * F.sin(rad(lon))), ("z", F.sin(rad(lat))))],
    )
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    moved = p.withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, "ijk", strict=True)]) for t in steps])))
    left = moved.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "name", "lat", "lon", "source")], (F.col("x") + F.col("_s.i")).alias("x"), (F.col("y") + F.col("_s.j")).alias("y"), (F.col("z") + F.col("_s.k")).alias("z"), F.expr("_s.i = 0 AND _s.j = 0 AND _s.k = 0").alias("own"))
    pairs = left.join(p, ["x", "y", "z"]).where(F.expr("NOT own OR id_a < id")).where(APART)
    metres = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) * 1000
    near = pairs.withColumn("distance_m", metres).where(F.col("distance_m") <= within_m)
    out = near.select(F.least("id_a", "id").alias("a"), F.greatest("id_a", "id").alias("b"), "distance_m", F.col("name_a"), "name")
    return out.withColumn("similarity", name_similarity(F.col("name_a"), F.col("name"))).drop("name_a", "name")


def named_pairs(points: DataFrame, within_m: float, id_: str = "id", name: str = "name", lat: str = "lat", lon: str = "lon", source: str = "source") -> DataFrame:
    """a, b, distance_m, similarity (1) of those pairs of ``nearby_pairs`` that have one folded name.

    Points meet by cell and name, so a crowded place costs no more than its points; one of a pair stands in every cell that the distance reaches.
    """
    s = max(within_m / 6371008.8, 1e-9) * 1.0000001
    rad = lambda c: F.radians(F.col(c))
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(id_).alias("id"), folded(F.col(name)).alias("name"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(source).alias("source"),
        *[v.alias(n) for n, v in (("x", F.cos(rad(lat)) * F.cos(rad(lon))), ("y", F.cos(rad(lat)) * F.sin(rad(lon))), ("z", F.sin(rad(lat))))],
    ).where("name <> ''")
    cell = lambda v: F.floor(v / (WIDE * s))
    left = p.withColumnsRenamed({c: f"{c}_a" for c in ("id", "lat", "lon", "source")})
    for n in "xyz":
        left = left.withColumn(n, F.explode(F.sequence(cell(F.col(n) - s), cell(F.col(n) + s))))
    pairs = left.join(p.withColumns({n: cell(F.col(n)) for n in "xyz"}), ["x", "y", "z", "name"]).where("id_a < id").where(APART)
    metres = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) * 1000
    return pairs.select(F.col("id_a").alias("a"), F.col("id").alias("b"), metres.alias("distance_m"), F.lit(1.0).alias("similarity")).where(F.col("distance_m") <= within_m)


def alike_pairs(points: DataFrame, within_m: float, least: float, **columns: str) -> DataFrame:
    """Those pairs of ``nearby_pairs`` whose similarity is ``least`` (above 0) at least.

    Names of which the longer one has n letters and that differ at all are no more alike than 1 - 0.2 / n: Jaro's measure loses 1 / 3n for a letter
    unmatched or a pair swapped, and the bonus gives back two fifths. So names differ only where the longer one has 0.2 / (1 - least) letters;
    the shorter one then has 3j - 2 times as many, where j is what Jaro's measure has to reach. Equal names meet by name.
    """
    same = named_pairs(points, within_m, **columns).where(F.col("similarity") >= least)
    if least >= 1:
        return same
    j = 1 - (1 - least) / 0.6
    letters = max(3 * j - 2, 0) * 0.2 / (1 - least) * 0.999
    long_ = points.where(F.length(folded(F.col(columns.get("name", "name")))) >= letters)
    return same.unionByName(nearby_pairs(long_, within_m, **columns).where((F.col("similarity") >= least) & (F.col("similarity") < 1)))


def dedup_points(points: DataFrame, within_m: float, accept: float = 0.92, review: float = 0.8, **columns: str) -> OpResult:
    """id, class_id (the smallest id that accepted pairs connect it with). Reports: ``review`` pairs, which wait for a person.

    Points at one place with one folded name are one record of many copies: only different records are compared, and a pair for review
    is written out for all copies only when the report is asked for.
    """
    source = columns.get("source")
    c = {k: columns.get(f"{k}_" if k == "id" else k, k) for k in ("id", "name", "lat", "lon")} | ({"source": source} if source else {})
    given = points.select(*[F.col(v).alias(k) for k, v in c.items()]).where("id is not null")
    placed = given.where("lat is not null and lon is not null").withColumn("key", folded(F.col("name"))).where("key <> ''")
    if source:  # only points of different sources are compared, so copies stay apart
        records = stored(placed.withColumn("first", F.col("id")), "records")
        of = records.select("id", "first").distinct()
    else:
        records = stored(placed.groupBy("lat", "lon", "key").agg(F.min("id").alias("first")), "records")
        of = stored(placed.join(records, ["lat", "lon", "key"]).select("id", "first").distinct(), "copies")
    compared = records.select(F.col("first").alias("id"), F.col("key").alias("name"), "lat", "lon", *(["source"] if source else []))
    pairs = stored(nearby_pairs(compared, within_m, source="source" if source else None).where(F.col("similarity") >= review), "pairs")
    links = pairs.where(F.col("similarity") >= accept).select("a", "b")
    least = of.groupBy("id").agg(F.min("first").alias("low"))  # an id at several places links them
    links = links.unionByName(of.join(least, "id").where("first <> low").select(F.col("first").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
    state = stored(records.select(F.col("first").alias("id")).distinct().withColumn("class_id", F.col("id")), "classes")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    while True:
        offers = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("offer"))
        lower = state.join(offers, "id", "left").select("id", F.least("class_id", "offer").alias("low"), "class_id")
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        nxt = stored(lower.join(jump, "low", "left").select("id", F.least("low", "lower").alias("class_id"), (F.least("low", "lower") < F.col("class_id")).alias("fell")), "classes")
        state = nxt.drop("fell")
        if not nxt.where("fell").limit(1).count():
            break
    joined = least.join(state.withColumnRenamed("id", "low"), "low").select("id", "class_id")
    out = given.select("id").distinct().join(joined, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    copies = lambda end, other: of.select(F.col("first").alias(end), F.col("id").alias(other))
    waiting = pairs.where(F.col("similarity") < accept).join(copies("a", "_a"), "a").join(copies("b", "_b"), "b").where("_a <> _b")
    return OpResult(out, {"review": waiting.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance_m", "similarity")})


def one_per_source(records: DataFrame, accepted: DataFrame, source: str = "source", id_: str = "id") -> OpResult:
    """id, source, class_id (the smallest id of the class): accepted pairs join classes in the order of their ``rank``, as long as a class
    keeps one record of each source. ``accepted`` has a, b and rank (smaller is better; any type that orders).

    That order is kept without a queue: a pair that is the best of both its classes can't be forestalled by any other, so all
    such pairs join in one round; pairs within a class or of classes that share a source go. Report ``rejected``: pairs that a source forbids.
    """
    members = stored(records.select(F.col(id_).alias("id"), F.col(source).alias("source"), F.col(id_).alias("class_id")).where("id is not null").distinct(), "members")
    pairs = stored(accepted.select("a", "b", F.struct("rank", "a", "b").alias("rank")), "pairs")
    rejected = None
    while True:
        sources = members.groupBy("class_id").agg(F.collect_set("source").alias("sources"))  # one record a source
        side = lambda end: members.select(F.col("id").alias(end), F.col("class_id").alias(f"c{end}"))
        of = lambda end: sources.select(F.col("class_id").alias(f"c{end}"), F.col("sources").alias(f"s{end}"))  # noqa: B023, E731
        live = pairs.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").join(of("a"), "ca").join(of("b"), "cb").withColumn("shared", F.arrays_overlap("sa", "sb")).select("a", "b", "rank", "ca", "cb", "shared")
        live = stored(live, "live")
        gone = live.where("shared").select("a", "b")
        rejected = gone if rejected is None else rejected.unionByName(gone)
        live = live.where("not shared")
        if live.isEmpty():
            return OpResult(members, {"rejected": rejected.distinct()})
        ends = live.select(F.col("ca").alias("c"), "rank").unionByName(live.select(F.col("cb").alias("c"), "rank"))
        best = ends.groupBy("c").agg(F.min("rank").alias("best"))
        both = live.join(best.select(F.col("c").alias("ca"), F.col("best").alias("ba")), "ca").join(best.select(F.col("c").alias("cb"), F.col("best").alias("bb")), "cb").where("rank = ba AND rank = bb")
        moves = stored(both.select(F.greatest("ca", "cb").alias("class_id"), F.least("ca", "cb").alias("to")), "moves")
        members = stored(members.join(moves, "class_id", "left").select("id", "source", F.coalesce("to", "class_id").alias("class_id")), "members")
        pairs = stored(live.select("a", "b", "rank"), "pairs")


def dedup_sources(points: DataFrame, within_m: float, near_m: float, fuzzy: float = 0.88, match: int = 2, review: int = 1, decisions: DataFrame | None = None, source: str = "source", **columns: str) -> OpResult:
    """id, source, class_id of points from several sources that describe one place.

    Pairs of different sources within ``within_m`` score a point for names alike (``fuzzy``) and one for lying within ``near_m``: a match from
    ``match`` on, for review from ``review`` on. ``decisions`` (a, b, decision, and optionally name_a, name_b) settle pairs for review; one whose
    names are no longer those decided on counts no more. Matches and pairs decided as such join by score, then distance.
    Records without a place are classes of their own. Reports: ``candidates`` (a, b, distance_m, similarity, score, class, decided), ``rejected``.

    Candidates are all pairs at a place, so they are only made when that report is asked for. Where a match needs both points, matches are
    sought by name (``alike_pairs``), and decided pairs are looked up.
    """
    if not review <= match or not 0 <= near_m <= within_m:
        raise Refusal("review needs less than a match, and near is within the distance that is looked at")
    columns = {k: columns.get(k, k.rstrip("_")) for k in ("id_", "name", "lat", "lon")} | {"source": source}
    id_, name = columns["id_"], columns["name"]
    score = F.when(F.coalesce(F.col("similarity") >= fuzzy, F.lit(False)), 1).otherwise(0) + F.when(F.col("distance_m") <= near_m, 1).otherwise(0)
    kind = F.when(F.col("score") >= match, "match").when(F.col("score") >= review, "review").otherwise("non-match")
    scored = lambda pairs: pairs.withColumn("score", score).withColumn("class", kind)
    c, d = scored(nearby_pairs(points, within_m, **columns)), None
    if decisions is None:
        c = c.withColumn("decided", F.lit(None).cast("string"))
    else:
        names = points.select(F.col(id_).alias("_i"), F.col(name).alias("_n"))
        d = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("decision").alias("decided"), *[(F.when(F.col("a") < F.col("b"), F.col(f"name_{x}")).otherwise(F.col(f"name_{y}")) if f"name_{x}" in decisions.columns else F.lit(None).cast("string")).alias(f"_{x}") for x, y in ("ab", "ba")])
        for end in "ab":
            d = d.join(names.withColumnsRenamed({"_i": end, "_n": f"_now_{end}"}), end).where(f"_{end} is null or _{end} <=> _now_{end}")
        d = stored(d.select("a", "b", "decided").distinct(), "decisions")
        c = c.join(d, ["a", "b"], "left").withColumn("decided", F.when(F.col("class") == "review", F.col("decided")))
    if match < 2 or fuzzy <= 0:  # lying near is a match by itself, so all pairs at a place are matches
        c = stored(c, "candidates")
        accepted = c.where("class = 'match' OR decided = 'match'")
    else:
        accepted = scored(alike_pairs(points, near_m, fuzzy, **columns)).where("class = 'match'")
        if d is not None:
            accepted = accepted.unionByName(scored(_looked_up(points, d.where("decided = 'match'"), within_m, **columns)).where("class = 'review'"))
    accepted = accepted.select("a", "b", F.struct((-F.col("score")).alias("s"), "distance_m").alias("rank"))
    out = one_per_source(points, accepted, source, id_)
    return OpResult(out.df, out.report | {"candidates": c})


def _looked_up(points: DataFrame, pairs: DataFrame, within_m: float, id_: str, name: str, lat: str, lon: str, source: str) -> DataFrame:
    """Of given pairs (a, b) those that ``nearby_pairs`` has, as it gives them."""
    p = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(id_).alias("id"), folded(F.col(name)).alias("name"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(source).alias("source"))
    left = p.withColumnsRenamed({"id": "a"} | {c: f"{c}_a" for c in ("name", "lat", "lon", "source")})
    both = pairs.where("a < b").join(left, "a").join(p.withColumnRenamed("id", "b"), "b").where(APART)
    metres = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) * 1000
    near = both.withColumn("distance_m", metres).where(F.col("distance_m") <= within_m)
    return near.select("a", "b", "distance_m", name_similarity(F.col("name_a"), F.col("name")).alias("similarity"))
