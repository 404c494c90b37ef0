"""Model sanity (reference model tests) plus exactness of attributions and the ridge mapping."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators import explain as X
from actuaria.operators import models as Mo
from actuaria.plans.preprocess_all import preprocess, with_interactions


@pytest.fixture(scope="module")
def prep(spark):
    # the reference's model checks run on ~1.3k rows; sf0.01 gives 1.2k training rows
    from actuaria.sources.tables import policy_table
    return preprocess(policy_table(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def train(prep):
    df = with_interactions(prep.frame)
    return df.where(F.col("split") == "train").cache()


@pytest.fixture(scope="module")
def gbt(train):
    return Mo.fit_gbt(train, "xgboost", {"n_estimators": 40, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.9})


def _mean_profile(spark, smoker=0):
    row = {f: 0.0 for f in C.FEATURES}
    row["sex"] = 1.0
    row["smoker"] = float(smoker)
    return spark.createDataFrame([tuple(row[f] for f in C.FEATURES)], ", ".join(f"{f} double" for f in C.FEATURES))


def test_feature_list_has_interactions():
    assert len(C.FEATURES) == 10 and "smoker_bmi" in C.FEATURES and "smoker_age" in C.FEATURES


def test_prediction_reasonable_and_deterministic(spark, gbt):
    df = _mean_profile(spark)
    a = Mo.predict(df, gbt, "p", prefix="").first()["p"]
    b = Mo.predict(df, gbt, "p", prefix="").first()["p"]
    assert 0 < a < 100000 and a == b


def test_smoker_costs_more_than_twice_at_mean_profile(spark, gbt):
    ns = Mo.predict(_mean_profile(spark, 0), gbt, "p", prefix="").first()["p"]
    sm = Mo.predict(_mean_profile(spark, 1), gbt, "p", prefix="").first()["p"]
    assert sm > 2 * ns


def test_grid_sizes_and_draws():
    assert [Mo.grid_size(Mo.grid_for(s)) for s in ("xgboost", "lightgbm", "gradient_boosting")] == [32000, 40000, 1500]
    draws = Mo.sample_params(Mo.grid_for("xgboost"), 40)
    assert len({tuple(sorted(d.items())) for d in draws}) == 40
    grid = Mo.grid_for("xgboost")
    assert all(d[k] in grid[k] for d in draws for k in grid)


def test_ridge_matches_closed_form(train):
    fitted = Mo.fit_ridge(train, alpha=1.0)
    pdf = train.select(*C.FEATURES, "charges").toPandas()
    Xm = pdf[C.FEATURES].to_numpy(float)
    y = np.log1p(pdf["charges"].to_numpy(float))
    Xc, yc = Xm - Xm.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + np.eye(Xm.shape[1]), Xc.T @ yc)
    assert np.allclose(np.array(fitted.model.coefficients), w, atol=1e-6)


def test_ols_one_feature_matches_numpy(train):
    fitted = Mo.fit_ols(train, features=["age"])
    pdf = train.select("age", "charges").toPandas()
    slope, icpt = np.polyfit(pdf["age"], np.log1p(pdf["charges"]), 1)
    assert fitted.model.coefficients[0] == pytest.approx(slope, rel=1e-9)
    assert fitted.model.intercept == pytest.approx(icpt, rel=1e-9)


def _cond_exp(model, root, x, subset):
    """Path-dependent E[f | x_S] of one tree by direct recursion."""
    def go(at):
        if model.left[at] == at:
            return model.value[at]
        left, right = model.left[at], model.right[at]
        if model.feature[at] in subset:
            return go(left if x[model.feature[at]] <= model.threshold[at] else right)
        return (model.cover[left] * go(left) + model.cover[right] * go(right)) / model.cover[at]
    return go(root)


@pytest.mark.parametrize("cells", [None, 4])
def test_tree_attributions_equal_brute_force_shapley(spark, gbt, train, cells):
    model = gbt.model
    flat = X.flatten_trees(model)
    rows = train.select(*C.FEATURES).limit(3).toPandas().to_numpy(float)
    phi = X.shap_matrix(rows, *X.lookup_tables(flat, 10, cells))
    n = 10
    for row_i, xrow in enumerate(rows):
        used = sorted(set(model.feature.tolist()))
        value = {}

        def v(s):
            s = tuple(sorted(s))
            if s not in value:
                value[s] = sum(_cond_exp(model, r, xrow, s) for r in model.root)
            return value[s]
        for i in range(n):
            others = [j for j in range(n) if j != i]
            tot = 0.0
            for size in range(n):
                for subset in combinations(others, size):
                    wgt = factorial(size) * factorial(n - size - 1) / factorial(n)
                    tot += wgt * (v(set(subset) | {i}) - v(set(subset))) if i in used else 0.0
            assert phi[row_i, i] == pytest.approx(tot, abs=1e-6)
        pred = Mo.predict(spark.createDataFrame([tuple(float(a) for a in xrow)],
                                                ", ".join(f"{f} double" for f in C.FEATURES)), gbt, "p", prefix="")
        assert phi[row_i].sum() + flat["expected"] == pytest.approx(pred.first()["p"], abs=1e-6)


def test_tables_of_a_deep_model_add_up(train):
    [deep] = Mo.fit_boosted(train, [("lightgbm", {"n_estimators": 25, "max_depth": 7, "num_leaves": 31})])
    rows = train.select(*C.FEATURES).limit(200).toPandas().to_numpy(float)
    flat = X.flatten_trees(deep.model)
    for cells in (64, 1 << 13):
        phi = X.shap_matrix(rows, *X.lookup_tables(flat, 10, cells))
        assert np.allclose(phi.sum(axis=1) + flat["expected"], deep.model.predict(rows))


def test_model_store_roundtrip(spark, gbt, train):
    from actuaria.session import scratch_path
    path = Mo.save_model(gbt, scratch_path(spark, "store"))
    loaded = Mo.load_model(path)
    a = [r["p"] for r in Mo.predict(train, gbt, "p", prefix="").orderBy(C.KEY).collect()]
    b = [r["p"] for r in Mo.predict(train, loaded, "p", prefix="").orderBy(C.KEY).collect()]
    assert a == b


def test_model_store_keeps_features_and_target_scale(spark, train, gbt):
    from actuaria.session import scratch_path
    path = scratch_path(spark, "store")
    one = Mo.fit_ols(train, features=["age"])
    loaded = Mo.load_model(Mo.save_model(one, path))
    assert (loaded.features, loaded.log_target, loaded.name) == (["age"], True, "linear_regression")
    a, b = (Mo.predict(train, m, "p", prefix="").agg(F.sum("p")).first()[0] for m in (one, loaded))
    assert a == b
    again = Mo.load_model(Mo.save_model(gbt, path))  # saving to the same path drops the kept handle
    assert again.features == list(C.FEATURES) and not again.log_target


def test_tree_batch_predict_top_driver_is_largest_attribution(spark, gbt):
    from actuaria.operators import score as S
    from actuaria.sources import batch as B
    from actuaria.sources.tables import policy_table
    parsed = B.parse_profiles(B.policy_as_upload(policy_table(spark, "/root/testdata/sf0.001")))
    res = S.batch_predict(parsed, gbt, lambda d: X.tree_shap(d, gbt))
    shap = X.tree_shap(S.with_features(parsed), gbt).select("row_id", "shap")
    rows = {r["row_id"]: r for r in res.join(shap, "row_id").collect()}
    names = {C.DISPLAY_NAMES[f]: i for i, f in enumerate(C.FEATURES)}
    checked = 0
    for r in rows.values():
        if r["error"] is not None:
            assert r["predicted_cost"] is None
            continue
        mags = [abs(v) for v in r["shap"]]
        assert mags[names[r["top_shap_feature"]]] == pytest.approx(max(mags))
        assert r["predicted_cost"] >= 0
        checked += 1
    assert checked > 100


def test_leaderboard_boosted_beats_linear(spark):
    import __spark_entry__ as E
    rows = {r["model"]: r for r in E.queries()["m11_leaderboard_fitted"](spark, "/root/testdata/sf0.01").collect()}
    assert min(rows[m]["r2"] for m in ("xgboost", "lightgbm", "gradient_boosting")) > \
        max(rows[m]["r2"] for m in ("linear_regression", "ridge_regression"))
    assert sorted(r["rank"] for r in rows.values()) == [1, 2, 3, 4, 5]
    assert sum(r["is_best"] for r in rows.values()) == 1


def test_interactions_raise_linear_r2(spark, train):
    from actuaria.plans.q_models import training_frames
    _, test = training_frames(spark, "/root/testdata/sf0.01")
    base8 = C.FEATURES[:8]
    scores = []
    for feats in (base8, C.FEATURES):
        m = Mo.fit_ols(train, features=feats)
        p = Mo.predict(test, m, "p", prefix="").withColumn("p", F.greatest("p", F.lit(0.0)))
        from actuaria.operators.evaluate import regression_metrics
        scores.append(regression_metrics(p, "charges", "p").first()["r2"])
    assert scores[1] > scores[0]


def test_search_reports_what_it_fits(train):
    grid = {"n_estimators": [2, 3], "max_depth": [2], "learning_rate": [0.3]}
    fitted, best, score, results = Mo.random_search(train, "xgboost", 2, 2, grid=grid)
    assert sorted(p["n_estimators"] for p, _, _ in results) == [2, 3] and sum(b for _, _, b in results) == 1
    assert len(fitted.model.root) == best["n_estimators"] and score == max(m for _, m, _ in results)


def test_a_second_query_starts_no_fit(spark, train, monkeypatch):
    """The store answers by the rows' content, whatever their order and partitions, and by every parameter."""
    from actuaria.operators import boosting
    wanted = [("xgboost", {"n_estimators": 4, "max_depth": 2, "reg_alpha": 0.5}), ("gradient_boosting", {"n_estimators": 3})]
    first = Mo.fit_boosted(train, wanted)
    search = Mo.random_searches(train, ["xgboost"], 2, 2, grid={"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.3]})
    Mo._MODEL_CACHE.clear()

    def no_fit(*a, **k):
        raise AssertionError("fitted again")

    monkeypatch.setattr(boosting, "grow", no_fit)
    again = Mo.fit_boosted(train.repartition(5).orderBy("charges"), wanted)
    assert [m.model.rows() for m in again] == [m.model.rows() for m in first] and again[0].name == "xgboost"
    more = Mo.random_searches(train, ["xgboost"], 2, 2, grid={"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.3]})
    assert more["xgboost"].draws == search["xgboost"].draws
    for other in (("xgboost", {"n_estimators": 4, "max_depth": 2}), ("xgboost", {**wanted[0][1], "reg_alpha": 0.1})):
        with pytest.raises(AssertionError):
            Mo.fit_boosted(train, [other])
    with pytest.raises(AssertionError):
        Mo.fit_boosted(train.limit(100), wanted[:1])


def test_of_two_writers_of_a_key_one_entry_stays(spark):
    from actuaria.operators import model_store
    key = model_store.key_of("two writers", __import__("uuid").uuid4().hex)
    assert model_store.find(spark, key) is None

    def second(path):
        spark.range(2).write.parquet(f"{path}/scores")

    def first(path):
        model_store.publish(spark, key, second)  # the other writer is faster
        spark.range(7).write.parquet(f"{path}/scores")

    path = model_store.publish(spark, key, first)
    assert model_store.find(spark, key) == path and spark.read.parquet(f"{path}/scores").count() == 2


def test_fitted_smoker_profile_costs_more_than_twice(spark, gbt, prep):
    from actuaria.operators import score as S
    rows = [(1, 45, "female", 30.0, 2, "no", "northwest"), (2, 45, "female", 30.0, 2, "yes", "northwest")]
    df = spark.createDataFrame(rows, "profile_id long, age int, sex string, bmi double, children int, "
                                     "smoker string, region string")
    feats = S.with_features(df, scaler=prep.scaler_dict())  # served with its own training scaler
    out = {r["profile_id"]: r["cost"] for r in S.score_cost(feats, gbt, "cost").collect()}
    assert out[2] > 2 * out[1] > 0
