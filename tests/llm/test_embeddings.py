"""Embedding near-duplicates and nearest neighbours, against brute force."""

import numpy as np
import pytest

from tallygrove.llm import ann, embedding_dedup
from tallygrove.llm.common import components


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")


def planted(n=600, d=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:200] = x[0] + 0.12 * rng.normal(size=(200, d))  # a hot group of near copies
    x[200:230] = x[200]  # exact copies
    for i in range(230, 260, 2):
        x[i + 1] = 3 * x[i] + 0.1 * rng.normal(size=d)
    order = rng.permutation(n)
    return [(int(i) * 5, x[j]) for i, j in enumerate(order)]


def brute(rows, least=0.95):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= least) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(link, low[None, :], len(x)).min(axis=1, initial=len(x))
        new = np.minimum(new, low)
        if (new == low).all():
            break
        low = new
    return {int(i): (int(c), int(ids[low[k]])) for k, (i, c) in enumerate(zip(ids, link.sum(axis=1), strict=True))}


@pytest.mark.parametrize("block", [64, 2048])
def test_links_and_components_are_those_of_brute_force(spark, block):
    rows = planted()
    got = embedding_dedup.near_duplicates(table(spark, rows), block=block).collect()
    want = brute(rows)
    assert {r["vec_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}
    found, true = sum(r["n_links"] for r in got), sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got) and found >= 0.98 * true
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert got[0]["audited_recall"] >= 0.95


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, None), (4, [0, 0, 0]), (5, [1, None, 0]), (6, [float("nan"), 1, 0]), (7, [float("inf"), 0, 0]), (8, [1, 0]), (2, [2, 0, 0]), (None, [1, 0, 0]), (9, [0, 1, 0]), (10, [0, 3])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(table(spark, [(1, None)])).collect()[0]["kept"]


def test_nearest_is_exact_on_a_small_table_and_breaks_ties_by_id(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8) * rng.uniform(0.5, 3)) for i in range(60)] + [(i, np.ones(8)) for i in range(60, 70)]
    rows += [(70, None), (80, [0] * 8), (81, [float("nan")] * 8), (82, [1.0, None] + [0.0] * 6)]
    got = ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    good = rows[:70]
    for q in (0, 20, 40, 60):
        want = sorted(((-float(np.dot(good[q][1], v)), i) for i, v in good if i != q))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert len({m[1] for m in mine} & {i for _, i in want}) >= 19
        assert all(abs(m[2] - float(np.dot(good[q][1], good[m[1]][1]))) < 1e-12 for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
    assert {r["query_id"] for r in got} == {0, 20, 40, 60}
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(table(spark, rows[:3]), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_recall_over_several_blocks(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    vectors = table(spark, [(i, v) for i, v in enumerate(rng.normal(size=(1500, 32)))])
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, block=400, query_block=30)
    assert ann.audit(vectors, got) >= 0.9


def test_recall_on_unequal_lengths(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 64)) * rng.lognormal(0, 0.5, (8000, 1))
    vectors = table(spark, list(enumerate(x)))
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0)
    assert ann.audit(vectors, got) >= 0.9


@pytest.mark.parametrize("d", [64, 128, 384])
def test_recall_and_candidates_by_dimension(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(4000, d))
    tables = ann.Tables(x, float(np.sqrt((x**2).sum(axis=1).max())), ann.arrays_for(d))
    hit = verified = 0
    for q, found in enumerate(tables.candidates(x[:40], int(ann.SHARE * 4000) + 21)):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(found))
        verified += len(found)
    assert hit >= 0.9 * 40 * 20 and verified < 40 * 4000 * 0.3


def test_recall_in_384_dimensions(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    vectors = table(spark, list(enumerate(rng.normal(size=(3000, 384)))))
    assert ann.audit(vectors, ann.nearest(vectors, F.col("vec_id") % 100 == 0)) >= 0.9


def test_queries_meet_vectors_of_their_length(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1, 0]), (1, [2, 0]), (2, [0, 3]), (20, [1, 1, 1]), (21, [1, 2, 3]), (22, [5, 0, 0]), (23, [9, 9, 9, 9])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 0.0), (20, 1, 21, 6.0), (20, 2, 22, 5.0)]


def isotropic(n, pairs, d, seed=8):
    """n isotropic vectors, and a partner of the first ones at a cosine of 0.951 to 0.97."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    q = x[:pairs] / np.linalg.norm(x[:pairs], axis=1)[:, None]
    o = rng.normal(size=q.shape)
    o -= (o * q).sum(axis=1)[:, None] * q
    c = rng.uniform(0.951, 0.97, pairs)[:, None]
    return np.concatenate([x, c * q + np.sqrt(1 - c**2) * o / np.linalg.norm(o, axis=1)[:, None]])


@pytest.mark.parametrize("d", [32, 64])
def test_no_pair_is_lost_on_isotropic_vectors(spark, d):
    x = isotropic(6000, 1500, d)
    rows = list(enumerate(x))
    want = brute(rows)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table(spark, rows), block=256).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert got[0]["audited_recall"] == 1.0 and got[0]["audited_links"] > 500


def test_pairs_meet_in_rounds_of_bounded_bytes(spark, monkeypatch):
    """What a round moves stays on disk until it ends: more pairs make more rounds, not larger ones."""
    x = np.concatenate([isotropic(3000, 700, 64), 1 + 0.02 * np.random.default_rng(1).normal(size=(300, 64))])
    rounds, store = {"sieved": 0, "found": 0}, embedding_dedup.stored

    def noted(df, label, *more):
        if label in rounds:
            rounds[label] += 1
        return store(df, label, *more)

    monkeypatch.setattr(embedding_dedup, "stored", noted)
    monkeypatch.setattr(embedding_dedup, "MOVED", 1 << 20)
    rows = list(enumerate(x))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table(spark, rows), block=64).collect()}
    assert got == brute(rows)
    assert rounds["sieved"] > 4 and rounds["found"] > 1
    assert embedding_dedup.rounds_of(10**12, 10**10) == 100 and embedding_dedup.rounds_of(10**6, 10**6) == 1


def test_moved_vectors_come_back_as_they_were():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 5)) * 10.0 ** rng.integers(-300, 300, (7, 1))
    for some, size in ((x, 40), (np.float32([[1.1, 2], [3, 4e-44]]).astype(float), 8), (np.zeros((0, 3)), None)):
        bytes_ = embedding_dedup.packed(some)
        assert np.array_equal(embedding_dedup.unpacked(bytes_, some.shape[1]), some) and all(len(b.as_py()) == size for b in bytes_)


def test_parts_are_joined_whatever_the_order_of_their_links():
    rng = np.random.default_rng(7)
    for _ in range(100):
        low, n = np.arange(40), 40
        links = []
        for _ in range(3):
            a, b, linked = rng.permutation(n)[:12], rng.permutation(n)[:15], rng.random((12, 15)) < 0.04
            low = embedding_dedup.united(low, a, b, linked)
            links += [(int(a[i]), int(b[j])) for i, j in np.argwhere(linked)]
        want = list(range(n))
        for _ in range(n):
            for i, j in links:
                want[i] = want[j] = min(want[i], want[j])
        assert low.tolist() == want


def test_the_audit_drops_when_shards_do_not_overlap(spark, monkeypatch):
    x = isotropic(4000, 1500, 64)
    centres = embedding_dedup.unit_rows(x[:40])
    monkeypatch.setattr(embedding_dedup, "fewest_moved", lambda *a: centres)
    table_ = table(spark, list(enumerate(x)))
    whole = embedding_dedup.near_duplicates(table_, block=512).first()
    alone = embedding_dedup.near_duplicates(table_, block=512, reach=0.0).first()
    assert whole["audited_recall"] == 1.0 and alone["audited_recall"] < 0.9


def test_shards_hold_every_pair_by_construction():
    rng = np.random.default_rng(4)
    centres = embedding_dedup.unit_rows(rng.normal(size=(50, 8)))
    x = isotropic(5000, 5000, 8)
    u, v = embedding_dedup.unit_rows(x[:5000]), embedding_dedup.unit_rows(x[5000:])
    reach = embedding_dedup.reach_of(0.95)
    (a, in_u), (b, in_v) = embedding_dedup.homes_of(u, centres, reach), embedding_dedup.homes_of(v, centres, reach)
    assert (in_u[np.arange(5000), b] | in_v[np.arange(5000), a]).all() and in_u.sum(axis=1).mean() < 12


def test_vectors_are_compared_within_their_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6)) for i in range(40)] + [(100, [1, 0, 0]), (101, [1, 0.1, 0]), (102, [1, 0]), (103, [2, 0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got[100] == (1, 100) and got[101] == (1, 100) and got[102] == (1, 102) and got[103] == (1, 102)


def test_the_audit_is_null_without_links(spark):
    rng = np.random.default_rng(8)
    got = embedding_dedup.near_duplicates(table(spark, list(enumerate(rng.normal(size=(50, 32)))))).collect()
    assert all(r["audited_recall"] is None and r["audited_links"] == 0 and r["kept"] and not r["n_links"] for r in got)


def test_components_of_random_links(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    low = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
