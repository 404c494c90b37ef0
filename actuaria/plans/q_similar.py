"""Registered queries: similarity search (K1–K7) and match tiers.

Base = the processed training split (fitted scaler), queries = the test
split profiles with the serving-time features, as the reference serves
them.  The DuckDB twins are brute force over all pairs of a stratum, which
is fine for the small check and is exactly what the Spark plan avoids.
"""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.functions.columns import match_tier
from actuaria.operators import similar as K
from actuaria.operators.preprocess import decode_features
from actuaria.operators.score import with_features
from actuaria.plans.preprocess_all import preprocess
from actuaria.plans.q_profile import policy
from actuaria.plans.registry import PROCESSED_SQL, SPLIT_SQL, feature_sql, register, with_ctes


def _w_sql(cols):
    return ", ".join(f"CAST({c} AS DOUBLE) * {math.sqrt(w)!r} AS w_{i}"
                     for i, (c, w) in enumerate(zip(cols, C.KNN_WEIGHTS)))


_D = " + ".join(f"(q.w_{i} - b.w_{i}) * (q.w_{i} - b.w_{i})" for i in range(len(C.KNN_FEATURES)))

KQ_SQL = "WHERE split = 'test'),"
KNN_SQL = f"""
kb AS (SELECT policy_id AS neighbor_id, CASE WHEN smoker = 1 THEN 'yes' ELSE 'no' END AS stratum,
  {_w_sql(C.KNN_FEATURES)}, charges FROM processed WHERE split = 'train'),
kq AS (SELECT policy_id AS query_id, CASE WHEN smoker = 'yes' THEN 'yes' ELSE 'no' END AS stratum,
  {_w_sql(['f_' + c for c in C.KNN_FEATURES])}
  FROM (SELECT *, {feature_sql('f_')} FROM policy) JOIN split USING (policy_id) {KQ_SQL}
kp AS (SELECT q.query_id, b.neighbor_id, q.stratum, sqrt({_D}) AS distance FROM kq q JOIN kb b USING (stratum)),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id)
  AS INTEGER) AS rank FROM kp) WHERE rank <= 5),
ks_n AS (SELECT stratum, count(*) AS n FROM kb GROUP BY stratum),
ks_p AS (SELECT q.neighbor_id AS query_id, q.stratum, sqrt({_D}) AS distance FROM kb q JOIN kb b USING (stratum)),
ks_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9)) AS rk
  FROM ks_p) WHERE rk <= 5),
ks AS (SELECT n.stratum, n.n, CASE WHEN n.n < 2 THEN 10.0 WHEN p.p = 0 THEN 1.0 ELSE p.p END AS scale
  FROM ks_n n LEFT JOIN (SELECT stratum, quantile_cont(kth, 0.95) AS p FROM
    (SELECT stratum, query_id, max(distance) AS kth FROM ks_r GROUP BY ALL) GROUP BY stratum) p USING (stratum)),
ksim AS (SELECT k.*, greatest(5.0, least(100.0, 100.0 * exp(-k.distance / greatest(s.scale, 0.1)))) AS similarity
  FROM knn k JOIN ks s USING (stratum))
"""


#: The same with every policy as a query.
KNN_ALL_SQL = KNN_SQL.replace(KQ_SQL, "),")


def knn_inputs(spark, sf, queries: str = "test"):
    """(base, queries) in the weighted space, plus the processed base frame; ``queries``: test or all."""
    prep = preprocess(policy(spark, sf))
    pre = prep.frame
    base = K.weighted(pre.where(F.col("split") == "train")).select(
        F.col(C.KEY).alias("neighbor_id"),
        F.when(F.col("smoker") == 1, "yes").otherwise("no").alias("stratum"),
        *[f"w_{i}" for i in range(len(C.KNN_FEATURES))])
    asked = prep.source.where(F.col("split") == "test") if queries == "test" else prep.source
    q = K.weighted(with_features(asked), ["f_" + c for c in C.KNN_FEATURES]).select(
        F.col(C.KEY).alias("query_id"),
        F.when(F.col("smoker") == "yes", "yes").otherwise("no").alias("stratum"),
        *[f"w_{i}" for i in range(len(C.KNN_FEATURES))])
    return base, q, pre


def neighbours(spark, sf, queries: str = "test"):
    """Neighbours with their similarity; the search and the distance scale share one tree."""
    base, q, pre = knn_inputs(spark, sf, queries)
    tree = K.build_tree(base, C.KNN_K, len(C.KNN_FEATURES), "neighbor_id", "stratum")
    nn = K.knn(q, base, tree=tree)
    nn = nn.join(q.select("query_id", "stratum"), "query_id")
    scale = K.distance_scale(base.withColumnRenamed("neighbor_id", C.KEY), C.KEY, tree=tree)
    scales = {r["stratum"]: r["scale"] for r in scales_of(scale)}
    of = F.create_map(*[F.lit(v) for pair in scales.items() for v in pair]) if scales else F.create_map()
    sim = nn.withColumn("scale", of[F.col("stratum")]).withColumn("similarity", K.similarity())
    return sim, pre


def scales_of(scale):
    """One row per stratum (two for this table)."""
    return scale.select("stratum", "scale").collect()


@register("k1_strata_sizes", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT CASE WHEN smoker = 1 THEN 'yes' ELSE 'no' END AS stratum, count(*) AS n FROM processed
WHERE split = 'train' GROUP BY ALL
"""))
def k1_strata_sizes(spark, sf):
    base, _, _ = knn_inputs(spark, sf)
    return base.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@register("k2_weighted_vectors", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, select=
    "SELECT neighbor_id, stratum, " + ", ".join(f"round(w_{i}, 6) AS w_{i}" for i in range(7)) + " FROM kb"))
def k2_weighted_vectors(spark, sf):
    base, _, _ = knn_inputs(spark, sf)
    return base.select("neighbor_id", "stratum", *[F.round(f"w_{i}", 6).alias(f"w_{i}") for i in range(7)])


@register("k3_knn_policy", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, select="""
SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance FROM knn
"""))
def k3_knn_policy(spark, sf):
    base, q, _ = knn_inputs(spark, sf)
    nn = K.knn(q, base)
    return nn.select("query_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


@register("k4_distance_scale", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL,
                                         select="SELECT stratum, n, round(scale, 6) AS scale FROM ks"))
def k4_distance_scale(spark, sf):
    base, _, _ = knn_inputs(spark, sf)
    out = K.distance_scale(base.withColumnRenamed("neighbor_id", C.KEY), C.KEY)
    return out.select("stratum", "n", F.round("scale", 6).alias("scale"))


@register("k5_similarity", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, select="""
SELECT query_id, rank, neighbor_id, round(distance, 3) AS distance, round(similarity, 1) AS similarity FROM ksim
"""))
def k5_similarity(spark, sf):
    sim, _ = neighbours(spark, sf)
    return sim.select("query_id", "rank", "neighbor_id", F.round("distance", 3).alias("distance"),
                      F.round("similarity", 1).alias("similarity"))


RECORDS_SQL = """
rec AS (
 SELECT k.query_id, k.rank, CAST(round(p.age * 14.04 + 39.21) AS INTEGER) AS age,
  CASE WHEN p.sex = 1 THEN 'male' ELSE 'female' END AS sex, round(p.bmi * 6.05 + 30.65, 1) AS bmi,
  CAST(round(p.children * 1.21 + 1.09) AS INTEGER) AS children,
  CASE WHEN p.smoker = 1 THEN 'yes' ELSE 'no' END AS smoker,
  CASE WHEN p.region_northwest = 1 THEN 'northwest' WHEN p.region_southeast = 1 THEN 'southeast'
       WHEN p.region_southwest = 1 THEN 'southwest' ELSE 'northeast' END AS region,
  CAST(round(p.charges) AS INTEGER) AS actual_charge, round(k.similarity, 1) AS similarity,
  round(k.distance, 3) AS distance
 FROM ksim k JOIN processed p ON p.policy_id = k.neighbor_id)
"""


def neighbour_records(spark, sf, queries: str = "test"):
    sim, pre = neighbours(spark, sf, queries)
    dec = decode_features(pre.withColumnRenamed(C.KEY, "neighbor_id").drop("split"))
    rec = sim.join(dec, "neighbor_id")
    return rec.select("query_id", "rank", "age", "sex", "bmi", "children", "smoker", "region",
                      F.round("charges").cast("int").alias("actual_charge"),
                      F.round("similarity", 1).alias("similarity"), F.round("distance", 3).alias("distance"))


@register("k6_neighbour_records", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, RECORDS_SQL,
                                            select="SELECT * FROM rec"))
def k6_neighbour_records(spark, sf):
    return neighbour_records(spark, sf)


@register("k7_neighbour_summary", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, RECORDS_SQL, select="""
SELECT query_id, count(*) AS "count", min(actual_charge) AS "min", max(actual_charge) AS "max",
  CAST(round(avg(actual_charge)) AS INTEGER) AS mean,
  CAST(round(quantile_cont(actual_charge, 0.5)) AS INTEGER) AS median
FROM rec GROUP BY query_id
"""))
def k7_neighbour_summary(spark, sf):
    return K.neighbour_summary(neighbour_records(spark, sf))


@register("f11_match_tier", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_SQL, select="""
SELECT query_id, rank, CASE WHEN round(similarity, 1) > 90 THEN 'high' WHEN round(similarity, 1) > 70 THEN 'mid'
  ELSE 'low' END AS tier, least(100.0, round(similarity, 1)) AS width FROM ksim
"""))
def f11_match_tier(spark, sf):
    sim, _ = neighbours(spark, sf)
    s = F.round("similarity", 1)
    return sim.select("query_id", "rank", match_tier(s).alias("tier"), F.least(F.lit(100.0), s).alias("width"))
