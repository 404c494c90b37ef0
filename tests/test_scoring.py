"""Scoring and batch checks restated from the reference's endpoint tests."""
import os

import pytest
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators import score as S
from actuaria.sources import batch as B

PRIMARY = C.ENSEMBLE[0]
COLS = "age,sex,bmi,children,smoker,region"


def _profiles(spark, rows):
    return spark.createDataFrame(rows, "profile_id long, age int, sex string, bmi double, children int, "
                                       "smoker string, region string")


def _score(spark, rows):
    df = S.score_cost(S.with_features(_profiles(spark, rows)), PRIMARY, "cost")
    return {r["profile_id"]: r for r in S.what_if(df, PRIMARY).collect()}


def test_predict_valid_input(spark):
    out = _score(spark, [(1, 35, "male", 27.5, 1, "no", "southeast")])
    assert out[1]["cost"] > 0


def test_smoker_costs_more_than_twice(spark):
    out = _score(spark, [(1, 45, "female", 30.0, 2, "no", "northwest"), (2, 45, "female", 30.0, 2, "yes", "northwest")])
    assert out[2]["cost"] > 2 * out[1]["cost"]


def test_scenarios_only_positive_savings_and_bmi_guard(spark):
    out = _score(spark, [(1, 30, "male", 25.0, 1, "no", "northwest"), (2, 50, "male", 35.0, 1, "yes", "southeast")])
    assert out[1]["scenarios"]["healthy_bmi"] is None       # 25 is not > 25
    assert out[1]["scenarios"]["quit_smoking"] is None
    s = out[2]["scenarios"]
    assert s["quit_smoking"]["savings"] > 0 and s["healthy_bmi"]["savings"] > 0


def test_confidence_band_ordered(spark, policy_small):
    band = S.confidence_band(S.with_features(policy_small), C.ENSEMBLE).select("confidence.*").collect()
    assert all(r["low"] <= r["mid"] <= r["high"] for r in band)


def test_linear_attributions_sum_to_prediction_minus_base(spark, policy_small):
    feats = S.with_features(policy_small)
    bg = S.feature_means(feats)
    base = S.base_value(PRIMARY, bg).first()[0]
    df = S.linear_shap(S.score_cost(feats, PRIMARY, "cost"), PRIMARY, bg)
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    worst = df.select(F.max(F.abs(total + F.lit(base) - F.col("cost")))).first()[0]
    assert worst < 1e-6   # the primary scorer never floors on this table


def test_bars_sorted_by_magnitude(spark, policy_small):
    feats = S.with_features(policy_small)
    df = S.linear_shap(feats, PRIMARY, S.feature_means(feats)).select(S.shap_bars("shap").alias("b"))
    for r in df.collect():
        mags = [abs(x["value"]) for x in r["b"]]
        assert all(mags[i] >= mags[i + 1] - 0.01 for i in range(len(mags) - 1))
        assert len(r["b"]) == 10


def _write_csv(tmp_path, text):
    p = os.path.join(tmp_path, "upload.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def _batch(spark, path):
    df = B.read_batch_csv(spark, path)
    parsed = B.parse_profiles(df)
    feats = S.with_features(parsed)
    bg = S.feature_means(feats)
    res = S.batch_predict(parsed, PRIMARY, lambda d: S.linear_shap(d, PRIMARY, bg))
    return res, S.batch_summary(res).first()


def test_batch_two_valid_rows(spark, tmp_path):
    p = _write_csv(str(tmp_path), f"{COLS}\n30,male,26.5,0,no,southeast\n45,female,32.1,2,yes,northwest\n")
    _, summary = _batch(spark, p)
    assert summary["successful"] == 2 and summary["failed"] == 0


def test_batch_missing_columns(spark, tmp_path):
    p = _write_csv(str(tmp_path), "age,bmi\n30,26.5\n")
    with pytest.raises(B.MissingColumnsError) as e:
        B.read_batch_csv(spark, p)
    assert "Missing columns: ['sex', 'children', 'smoker', 'region']" in str(e.value)


def test_batch_no_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        B.read_batch_csv(spark, os.path.join(str(tmp_path), "nope.csv"))


def test_batch_bad_cell_is_row_local(spark, tmp_path):
    p = _write_csv(str(tmp_path), f"{COLS}\nabc,male,26.5,0,no,southeast\n40,female,,1,no,northeast\n"
                                  "30,male,26.5,0,no,southeast\n")
    res, summary = _batch(spark, p)
    assert summary["total"] == 3 and summary["successful"] == 1 and summary["failed"] == 2
    errors = sorted(r["error"] for r in res.collect() if r["error"])
    assert errors == ["invalid age: abc", "missing bmi"]


def test_batch_is_case_insensitive(spark, tmp_path):
    p1 = _write_csv(str(tmp_path), f"{COLS}\n30,Male,26.5,0,YES,SouthEast\n")
    a = _batch(spark, p1)[0].first()["predicted_cost"]
    p2 = _write_csv(str(tmp_path), f"{COLS}\n30,male,26.5,0,yes,southeast\n")
    b = _batch(spark, p2)[0].first()["predicted_cost"]
    assert a == b


def test_batch_header_only(spark, tmp_path):
    p = _write_csv(str(tmp_path), f"{COLS}\n")
    _, s = _batch(spark, p)
    assert (s["total"], s["mean_prediction"], s["min_prediction"], s["max_prediction"]) == (0, 0.0, 0.0, 0.0)


def test_profile_words_are_case_insensitive(spark):
    out = _score(spark, [(1, 45, "female", 30.0, 2, "yes", "northwest"), (2, 45, "FEMALE", 30.0, 2, "Yes", "NorthWest")])
    assert out[1]["cost"] == out[2]["cost"]
    assert out[1]["scenarios"] == out[2]["scenarios"]
