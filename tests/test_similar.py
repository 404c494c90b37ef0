"""Exact k-NN against brute force, including a hot duplicate group."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from actuaria.operators import similar as K


def _brute(q, b, k):
    out = {}
    for qi, qs, qv in q:
        cand = [(round(math.sqrt(sum((x - y) ** 2 for x, y in zip(qv, bv))), 9), bi, bi_d)
                for bi, bs, bv in b if bs == qs for bi_d in [math.sqrt(sum((x - y) ** 2 for x, y in zip(qv, bv)))]]
        cand.sort(key=lambda t: (t[0], t[1]))
        out[qi] = [(c[1]) for c in cand[:k]]
    return out


def _frames(spark, q, b, dims):
    qs = spark.createDataFrame([(i, s, *v) for i, s, v in q],
                               ["query_id", "stratum"] + [f"w_{j}" for j in range(dims)])
    bs = spark.createDataFrame([(i, s, *v) for i, s, v in b],
                               ["neighbor_id", "stratum"] + [f"w_{j}" for j in range(dims)])
    return qs, bs


@pytest.mark.parametrize("hot", [False, True])
def test_knn_matches_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    dims = 4
    base = [(i, "a" if i % 3 else "b", tuple(float(x) for x in rng.normal(scale=1.5, size=dims))) for i in range(400)]
    if hot:  # a third of the rows share one profile
        base += [(1000 + i, "a", (0.1, 0.2, 0.3, 0.4)) for i in range(200)]
    queries = [(i, "a" if i % 2 else "b", tuple(float(x) for x in rng.normal(scale=1.5, size=dims)))
               for i in range(60)]
    queries.append((999, "a", (0.1, 0.2, 0.3, 0.4)))
    qs, bs = _frames(spark, queries, base, dims)
    got = K.knn(qs, bs, k=5, n_dims=dims).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert res == _brute(queries, base, 5)


def test_small_stratum_returns_fewer(spark):
    qs, bs = _frames(spark, [(1, "x", (0.0, 0.0))], [(1, "x", (1.0, 1.0)), (2, "x", (2.0, 2.0))], 2)
    out = K.knn(qs, bs, k=5, n_dims=2).collect()
    assert sorted(r["neighbor_id"] for r in out) == [1, 2]


def test_policy_neighbours_share_stratum_and_are_sorted(spark):
    from actuaria.plans.q_similar import knn_inputs
    base, q, _ = knn_inputs(spark, "/root/testdata/sf0.001")
    nn = K.knn(q, base).join(q.select("query_id", F.col("stratum").alias("qs")), "query_id") \
        .join(base.select("neighbor_id", F.col("stratum").alias("bs")), "neighbor_id")
    rows = nn.collect()
    assert all(r["qs"] == r["bs"] for r in rows)
    by_q = {}
    for r in rows:
        by_q.setdefault(r["query_id"], []).append((r["rank"], r["distance"]))
    for lst in by_q.values():
        d = [x[1] for x in sorted(lst)]
        assert d == sorted(d) and len(d) == 5


def test_similarity_clamped(spark):
    df = spark.createDataFrame([(0.0, 1.0), (100.0, 1.0), (0.5, 0.0)], "distance double, scale double")
    vals = [r[0] for r in df.select(K.similarity()).collect()]
    assert vals[0] == 100.0 and vals[1] == 5.0 and 5.0 <= vals[2] <= 100.0


def test_isolated_query_is_exact(spark):
    # one query far from a dense cluster plus a far-away sparse point: exact answer, no whole-stratum scan needed
    rng = np.random.default_rng(11)
    base = [(i, "a", tuple(float(x) for x in rng.normal(scale=0.3, size=2))) for i in range(300)]
    base.append((999, "a", (40.0, 40.0)))
    queries = [(1, "a", (20.0, 20.0)), (2, "a", (39.0, 41.0)), (3, "a", (0.0, 0.0))]
    qs, bs = _frames(spark, queries, base, 2)
    got = K.knn(qs, bs, k=5, n_dims=2, leaf=8).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert res == _brute(queries, base, 5)


def test_knn_empty_inputs(spark):
    qs, bs = _frames(spark, [(1, "x", (0.0, 0.0))], [(1, "y", (1.0, 1.0))], 2)
    assert K.knn(qs, bs, k=5, n_dims=2).count() == 0          # query stratum has no base rows
    empty_q = qs.where("query_id < 0")
    assert K.knn(empty_q, bs, k=5, n_dims=2).count() == 0     # no queries


@pytest.mark.parametrize("shape", ["outlier", "cluster", "sparse stratum"])
def test_leaves_stay_small_under_skew(spark, shape):
    rng = np.random.default_rng(7)
    pts = rng.uniform(size=(20_000, 2))
    strata = ["a"] * len(pts)
    if shape == "outlier":
        pts[0] = (1000.0, 1000.0)
    elif shape == "cluster":
        pts[:15_000] *= 1e-4
    else:
        pts = np.concatenate([pts, [(5.0, 5.0), (-5.0, 9.0), (20.0, 0.0)]])
        strata += ["b"] * 3
    base = [(i, s, tuple(map(float, p))) for i, (s, p) in enumerate(zip(strata, pts))]
    queries = [(i, s, tuple(map(float, p))) for i, (s, p) in enumerate(zip(strata, pts)) if i % 400 == 0]
    queries += [(10**6, strata[-1], (3.0, 3.0)), (10**6 + 1, "a", (900.0, -50.0))]
    qs, bs = _frames(spark, queries, base, 2)
    tree = K.build_tree(bs, 5, 2, "neighbor_id", "stratum")
    nn = K.knn(qs, bs, k=5, n_dims=2, tree=tree)
    sizes = tree.rows.groupBy("node").count()
    assert sizes.agg(F.max("count")).first()[0] <= K.LEAF and tree.rows.count() == len(base)
    assert sizes.count() <= 4 * len(base) / K.LEAF + 4  # and few are nearly empty
    res = {}
    for r in sorted(nn.collect(), key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert res == _brute(queries, base, 5)


def test_rows_that_agree_in_some_dimensions_are_cut_in_the_others(spark):
    """20,000 different vectors with the same first two coordinates: no join key holds more than a leaf."""
    rng = np.random.default_rng(2)
    base = [(i, "a", (1.0, 2.0, *(float(x) for x in rng.normal(size=3)))) for i in range(20_000)]
    queries = [(i, "a", (1.0, 2.0 + i % 3, *(float(x) for x in rng.normal(size=3)))) for i in range(40)]
    qs, bs = _frames(spark, queries, base, 5)
    tree = K.build_tree(bs, 5, 5, "neighbor_id", "stratum")
    assert tree.rows.groupBy("node").count().agg(F.max("count")).first()[0] <= K.LEAF
    got = K.knn(qs, bs, k=5, n_dims=5, tree=tree)
    res = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert res == _brute(queries, base, 5)


@pytest.mark.parametrize("shape", ["plain", "copies", "far apart", "tiny"])
def test_kth_distances_and_scale_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(700, 3)).round(1)
    if shape == "copies":
        pts[:500] = pts[0]
    if shape == "far apart":
        pts[:300] += 1000
        pts[300:303] = [[5000, 0, 0], [0, 5000, 0], [0, 0, 5000]]
    if shape == "tiny":
        pts = pts[:3]
    strata = ["a" if i % 4 else "b" for i in range(len(pts))]
    base = spark.createDataFrame([(i, s, *map(float, p)) for i, (s, p) in enumerate(zip(strata, pts))],
                                 "k bigint, stratum string, w_0 double, w_1 double, w_2 double")
    expected = {}
    for s in set(strata):
        own = pts[[x == s for x in strata]]
        d = np.sort(np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2)), axis=1)
        kth = d[:, min(5, len(own)) - 1]
        q = np.percentile(kth, 95)
        expected[s] = (len(own), 10.0 if len(own) < 2 else q if q else 1.0)
    got = {r["stratum"]: (r["n"], r["scale"]) for r in K.distance_scale(base, "k", n_dims=3).collect()}
    assert got == {s: (n, pytest.approx(v)) for s, (n, v) in expected.items()}


def test_rows_compared_for_the_scale_grow_with_the_base(spark):
    def compared(n):
        pts = np.random.default_rng(1).uniform(size=(n, 3))
        base = spark.createDataFrame([(i, "a", *map(float, p)) for i, p in enumerate(pts)],
                                     "k bigint, stratum string, w_0 double, w_1 double, w_2 double")
        tree = K.build_tree(base, 5, 3, "k", "stratum")
        reach = tree.rows.select("node").distinct().withColumn("reach", F.lit(2.5 * (5 / n) ** (1 / 3) / 1.6))
        size = tree.rows.groupBy("node").count()
        pairs = K.leaf_pairs(tree, reach)
        return pairs.join(size.select(F.col("node").alias("left"), F.col("count").alias("x")), "left").join(
            size.select(F.col("node").alias("right"), F.col("count").alias("y")), "right").agg(F.sum(F.col("x") * F.col("y"))).first()[0]

    small, large = compared(6000), compared(24000)
    assert large < 6 * small  # all pairs would be sixteen times as many
