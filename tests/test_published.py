"""The registered fits and searches do the published work."""
import json

import pytest

import __spark_entry__ as E
from actuaria import config as C
from actuaria.operators import boosting
from actuaria.operators import models as Mo

SF = "/root/testdata/sf0.001"
FAMILIES = ("xgboost", "lightgbm", "gradient_boosting")
FITS = ["m3_gbt_xgboost_style", "m4_gbt_lightgbm_style", "m5_gbt_gradient_boosting_style", "m11_leaderboard_fitted",
        "m12_gain_importance", "m12_importance_facts", "m13_m14_fitted_winner", "s8_model_roundtrip",
        "i5_tree_shap_policy", "i5_tree_shap_facts", "i9_batch_predict_gbt", "t_stream_batch_predict_gbt",
        "t_stream_gbt_differences", "i11_profile_result_fitted"]


class Stop(Exception):
    pass


def test_search_is_the_published_one(spark, monkeypatch):
    """40 draws of each family from its whole published grid, on 5 folds of the training rows, in one call."""
    seen = []

    def grow(table, specs, keep=True, whole_bytes=0):
        seen.append((table, specs, keep))
        raise Stop

    monkeypatch.setattr(boosting, "grow", grow)
    monkeypatch.setattr(Mo.model_store, "find", lambda spark, key: None)
    with pytest.raises(Stop):
        E.queries()["m7_m9_random_search"](spark, SF).collect()
    [(table, specs, keep)] = seen
    draws = {s: Mo.sample_params(Mo.grid_for(s), 40) for s in FAMILIES}
    assert specs == [boosting.spec_for(s, p, 42, fold) for s in FAMILIES for p in draws[s] for fold in range(5)]
    assert len(specs) == 3 * C.SEARCH_ITERATIONS * C.CV_FOLDS == 600 and not keep and table.n == 120
    assert {s.alpha for s in specs} == {0, 0.1, 0.5, 1.0} and {s.leaves for s in specs} >= {15, 31, 50, 70, 100}
    assert {s.min_split for s in specs} == {2, 5, 10} and {s.lam for s in specs} == {0, 1, 1.5, 2, 3}


def test_leaderboard_ranks_the_winners_of_the_search(spark):
    found = E.queries()["m7_m9_random_search"](spark, SF).collect()
    for style in FAMILIES:
        rows = [r for r in found if r["model"] == style]
        assert [json.loads(r["params"]) for r in rows] == Mo.sample_params(Mo.grid_for(style), 40)
        assert [r["is_best"] for r in rows].index(True) == max(range(40), key=lambda i: rows[i]["cv_r2"])
    board = E.queries()["m11_leaderboard_searched"](spark, SF).collect()
    assert {r["model"] for r in board} == {*FAMILIES, "ridge_regression", "linear_regression"}


@pytest.mark.parametrize("name", FITS)
def test_fit_has_the_published_settings(spark, monkeypatch, name):
    seen = []

    def fit(train, wanted, *more, **named):
        seen.extend(p for _, p in wanted)
        raise Stop

    monkeypatch.setattr(Mo, "fit_boosted", fit)
    with pytest.raises(Stop):
        E.queries()[name](spark, SF).collect()
    assert (seen[0]["n_estimators"], seen[0]["learning_rate"], seen[0]["max_depth"]) == (500, 0.01, 3)
    assert (seen[0]["subsample"], seen[0]["colsample_bytree"]) == (0.8, 0.9)
    assert (seen[0]["reg_alpha"], seen[0]["reg_lambda"], seen[0]["num_leaves"], seen[0]["min_samples_split"]) == (0.1, 1.5, 31, 5)
