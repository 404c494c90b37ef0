"""Registered queries: streaming scoring (T-stream), result sinks (S6, S7),
the nested per-profile result (I11) and approximate neighbours (K3b)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators import score as S
from actuaria.operators import similar as K
from actuaria.operators.report import advice_text
from actuaria.plans.q_profile import UPLOAD_SQL, policy
from actuaria.plans.q_scoring import BATCH_SQL, BG_SQL, FF_SQL, PRIMARY, batch_results, scored_profiles
from actuaria.plans.q_similar import KNN_ALL_SQL, RECORDS_SQL, neighbour_records
from actuaria.plans.registry import PROCESSED_SQL, SPLIT_SQL, register, with_ctes
from actuaria.session import scratch_path
from actuaria.sources import batch as B
from actuaria.streaming.profiles import start_scoring

BATCH_ORACLE = with_ctes(FF_SQL, BG_SQL, UPLOAD_SQL, BATCH_SQL, select="SELECT * FROM batch")


@register("t_stream_batch_predict", BATCH_ORACLE)
def t_stream_batch_predict(spark, sf):
    """The upload lands as JSON files; a file stream (availableNow) scores it
    into a parquet sink, which must equal the batch result."""
    src = scratch_path(spark, "stream-src")
    B.policy_as_upload(policy(spark, sf)).write.json(src)
    bg = S.feature_means(S.with_features(policy(spark, sf))).first().asDict()  # one-row model input
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = start_scoring(spark, src, sink, ckpt, PRIMARY, lambda d: S.linear_shap(d, PRIMARY, bg))
    q.awaitTermination()
    return spark.read.parquet(sink)


def stream_with_fitted_model(spark, sf):
    """T-stream with a fitted boosted model and tree attributions: (stream
    result, the same model's batch result)."""
    from actuaria.operators import explain as X
    from actuaria.operators import models as Mo
    from actuaria.plans.q_models import PUBLISHED, training_frames
    from actuaria.plans.q_profile import parsed_upload
    train, _, scaler = training_frames(spark, sf, with_scaler=True)
    fitted = Mo.fit_gbt(train, "xgboost", PUBLISHED)
    src = scratch_path(spark, "stream-src")
    B.policy_as_upload(policy(spark, sf)).write.json(src)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = start_scoring(spark, src, sink, ckpt, fitted, lambda d: X.tree_shap(d, fitted), scaler=scaler)
    q.awaitTermination()
    batch = S.batch_predict(parsed_upload(spark, sf), fitted, lambda d: X.tree_shap(d, fitted), scaler=scaler)
    return spark.read.parquet(sink), batch


@register("t_stream_batch_predict_gbt")
def t_stream_batch_predict_gbt(spark, sf):
    return stream_with_fitted_model(spark, sf)[0]


@register("s6_batch_results_json", BATCH_ORACLE)
def s6_batch_results_json(spark, sf):
    """Batch results written as JSON lines and read back with their schema."""
    res = batch_results(spark, sf)
    path = B.write_results(res, scratch_path(spark, "batch-json"), "json")
    return spark.read.schema(res.schema).json(path)


def fitted_profiles(spark, sf):
    """All profiles scored like the reference's request path with
    fitted models: the xgboost-style GBT gives cost, scenarios and tree
    attributions; the three boosted families give the band."""
    from actuaria.operators import explain as X
    from actuaria.operators import models as Mo
    from actuaria.plans.q_models import FAMILIES, PUBLISHED, training_setup
    train, _, scaler, source = training_setup(spark, sf)
    members = Mo.fit_boosted(train, [(s, PUBLISHED) for s in FAMILIES])
    primary = members[0]
    prof = S.score_cost(S.with_features(source.drop("split"), scaler=scaler), primary, "cost")
    prof = S.what_if(prof, primary, scaler=scaler)
    prof = X.tree_shap(prof, primary)
    prof = prof.withColumn("shap_bars", S.shap_bars("shap")).withColumn("shap_top", S.top_drivers("shap_bars"))
    return S.confidence_band(prof, members)


def profile_results(spark, sf, fitted: bool = False):
    """One nested record per profile: cost, confidence band, scenarios,
    bars, top drivers, advice text and similar profiles (of the train rows)."""
    if fitted:
        prof = fitted_profiles(spark, sf)
    else:
        prof = S.confidence_band(scored_profiles(spark, sf), C.ENSEMBLE)
    prof = prof.withColumn("advice", advice_text())
    rec = neighbour_records(spark, sf, "all")
    patients = rec.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "age", "sex", "bmi", "children", "smoker", "region",
                                             "actual_charge", "similarity", "distance"))).alias("_p"),
        F.count(F.lit(1)).alias("count"),
        F.min("actual_charge").alias("min"), F.max("actual_charge").alias("max"),
        F.round(F.avg("actual_charge")).cast("int").alias("mean"),
        F.round(F.percentile("actual_charge", 0.5)).cast("int").alias("median"))  # ≤ k rows per query
    similar = patients.select(
        F.col("query_id").alias(C.KEY),
        F.struct(F.transform("_p", lambda p: p.dropFields("rank")).alias("patients"),
                 F.struct(F.col("count").cast("int").alias("count"), "min", "max", "mean", "median")
                 .alias("summary")).alias("similar"))
    return prof.join(similar, C.KEY, "left").select(
        F.col(C.KEY).alias("profile_id"), F.round("cost", 2).alias("cost"), "confidence", "scenarios",
        "shap_bars", "shap_top", "advice", "similar")


@register("i11_profile_result")
def i11_profile_result(spark, sf):
    return profile_results(spark, sf)


@register("i11_profile_facts", with_ctes(SPLIT_SQL, PROCESSED_SQL, KNN_ALL_SQL, RECORDS_SQL, select="""
SELECT p.policy_id AS profile_id, s."count" AS neighbours, s."min" AS nearest_min, s."max" AS nearest_max, s.mean AS nearest_mean
FROM policy p LEFT JOIN (SELECT query_id, count(*) AS "count", min(actual_charge) AS "min", max(actual_charge) AS "max",
  CAST(round(avg(actual_charge)) AS INTEGER) AS mean FROM rec GROUP BY query_id) s ON s.query_id = p.policy_id
"""))
def i11_profile_facts(spark, sf):
    """I11/K7 for every profile: the neighbour summary inside its record."""
    s = F.col("similar.summary")
    return profile_results(spark, sf).select(
        "profile_id", s["count"].cast("long").alias("neighbours"), s["min"].alias("nearest_min"),
        s["max"].alias("nearest_max"), s["mean"].alias("nearest_mean"))


@register("t_stream_gbt_differences", with_ctes(UPLOAD_SQL, select="SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM parsed"))
def t_stream_gbt_differences(spark, sf):
    """T-stream with a fitted model: rows in which the stream's result differs from the batch result."""
    stream, batch = stream_with_fitted_model(spark, sf)
    a = stream.select("row_id", F.to_json(F.struct(*sorted(stream.columns))).alias("s"))
    b = batch.select("row_id", F.to_json(F.struct(*sorted(stream.columns))).alias("b"))
    return a.join(b, "row_id", "full").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("s").eqNullSafe(F.col("b"))).cast("long")).alias("differing"))


@register("i11_profile_result_fitted")
def i11_profile_result_fitted(spark, sf):
    return profile_results(spark, sf, fitted=True)


@register("s7_profile_record_json")
def s7_profile_record_json(spark, sf):
    return B.to_json_records(profile_results(spark, sf), "profile_id")


@register("k3b_lsh_embeddings")
def k3b_lsh_embeddings(spark, sf):
    """Approximate neighbours of every embedding among the embeddings
    with the same label, by a forest of random-projection trees, ranked exactly."""
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vec")
    # identical (label, vector) groups: only the k + 1 lowest ids can be returned (k neighbours plus the query itself)
    dup = Window.partitionBy("label", "vec").orderBy("vec_id")
    base = raw.withColumn("_d", F.row_number().over(dup)).where(F.col("_d") <= C.KNN_K + 1)
    return K.forest_neighbours(raw.withColumnRenamed("vec_id", "id"), base.withColumnRenamed("vec_id", "id").drop("_d"),
                               C.KNN_K, "label")


@register("s6_batch_results_csv", BATCH_ORACLE)
def s6_batch_results_csv(spark, sf):
    """Batch results written as CSV with a header (empty cell = null) and
    read back with their schema."""
    res = batch_results(spark, sf)
    path = B.write_results(res, scratch_path(spark, "batch-csv"), "csv")
    return spark.read.schema(res.schema).option("header", True).csv(path)
