"""Schemas and fixed constants shared by every operator.

Values under "Fixed values" must equal the reference application's for
results to agree; they are stated plainly and in their natural order.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

POLICY_SCHEMA = T.StructType([
    T.StructField("policy_id", T.LongType(), False),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("bmi", T.DoubleType(), True),
    T.StructField("children", T.IntegerType(), True),
    T.StructField("smoker", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("charges", T.DoubleType(), True),
])

RAW_COLUMNS = ["age", "sex", "bmi", "children", "smoker", "region", "charges"]
PROFILE_COLUMNS = ["age", "sex", "bmi", "children", "smoker", "region"]
TARGET = "charges"
KEY = "policy_id"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference application's)
# ---------------------------------------------------------------------------

# Required upload columns, in the order a "Missing columns" error lists them.
REQUIRED_COLUMNS = ["age", "sex", "bmi", "children", "smoker", "region"]

# Serving-time scaler constants (2-decimal mean / std of the training fit).
SCALER = {
    "age": {"mean": 39.21, "std": 14.04},
    "bmi": {"mean": 30.65, "std": 6.05},
    "children": {"mean": 1.09, "std": 1.21},
}

# Ordered model feature list.
FEATURES = [
    "age", "sex", "bmi", "children", "smoker",
    "region_northwest", "region_southeast", "region_southwest",
    "smoker_bmi", "smoker_age",
]

# Feature display names.
DISPLAY_NAMES = {
    "age": "Age", "sex": "Sex", "bmi": "BMI", "children": "Children",
    "smoker": "Smoker", "region_northwest": "Region: NW",
    "region_southeast": "Region: SE", "region_southwest": "Region: SW",
    "smoker_bmi": "Smoker x BMI", "smoker_age": "Smoker x Age",
}

# Regions in alphabetical order; the first one is the all-zero baseline.
REGIONS = ["northeast", "northwest", "southeast", "southwest"]

# Similarity search: feature order and weights of the weighted Euclidean metric.
KNN_FEATURES = [
    "age", "bmi", "children", "sex",
    "region_northwest", "region_southeast", "region_southwest",
]
KNN_WEIGHTS = [2.0, 2.5, 0.8, 0.5, 0.4, 0.4, 0.4]
KNN_K = 5
KNN_SCALE_PERCENTILE = 0.95
KNN_SCALE_FALLBACK_SMALL = 10.0   # stratum with fewer than 2 rows
KNN_SCALE_FALLBACK_ZERO = 1.0     # percentile came out as 0
KNN_SCALE_FLOOR = 0.1
SIMILARITY_MIN, SIMILARITY_MAX = 5.0, 100.0

# What-if scenarios.
HEALTHY_BMI = 25.0

# Histogram bin counts used by the reference plots.
BINS_TARGET, BINS_FEATURE, BINS_RESIDUAL = 40, 30, 40
RESIDUAL_BAND = 5000.0

# IQR whisker multiplier.
IQR_K = 1.5

# Split.
TEST_FRACTION = 0.20
SPLIT_SEED = 42

# Front-end rules (BMI from height/weight, BMI class, validation, bars, tiers).
BMI_DEFAULT = 25.0
BMI_CLASSES = [(18.5, "Underweight"), (25.0, "Normal"), (30.0, "Overweight")]
BMI_CLASS_TOP = "Obese"
HEIGHT_RANGE = (100.0, 220.0)
WEIGHT_RANGE = (30.0, 200.0)
BMI_WARN_RANGE = (16.0, 53.0)
AGE_WARN_RANGE = (18, 64)
BMI_INFO_FROM = 35.0
BAR_SCALE_PAGE, BAR_SCALE_PRINT = 48.0, 100.0
MATCH_TIERS = [(90.0, "high"), (70.0, "mid")]
MATCH_TIER_LOW = "low"

# Hyper-parameter grids of the three boosted models.
COMMON_PARAM_GRID = {
    "n_estimators": [200, 300, 500, 800, 1000],
    "max_depth": [3, 4, 5, 6, 7],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
}
XGB_EXTRA_GRID = {
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
    "reg_alpha": [0, 0.1, 0.5, 1.0],
    "reg_lambda": [1, 1.5, 2, 3],
}
LGBM_EXTRA_GRID = {
    "num_leaves": [15, 31, 50, 70, 100],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "reg_alpha": [0, 0.1, 0.5, 1.0],
    "reg_lambda": [1, 1.5, 2, 3],
}
GB_EXTRA_GRID = {
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "min_samples_split": [2, 5, 10],
}
SEARCH_ITERATIONS = 40
CV_FOLDS = 5
RIDGE_ALPHA = 1.0

# Report wording.
NO_RISK_LINE = "- No major risk factors detected. The client is in good shape."
NO_REPORT = "No report available."
REPORT_TITLE = "# Personal Cost Report"

# ---------------------------------------------------------------------------
# Stand-in ensemble (fixed-coefficient linear scorers)
# ---------------------------------------------------------------------------
# Boosted models cannot be re-derived in SQL, so the oracle-checked scoring
# queries use three fixed linear scorers over the ten features.  They are a
# model *specification*, not data: every query still scores the derived
# policy table.  Fitted MLlib models go through the same operators.


@dataclass(frozen=True)
class FixedLinear:
    """A linear scorer `intercept + sum(coef * feature)`; `log_target`
    means the score is on log1p scale and is mapped back with expm1."""
    name: str
    intercept: float
    coefficients: dict = field(default_factory=dict)
    log_target: bool = False


ENSEMBLE = [
    FixedLinear("primary", 12000.0, {
        "age": 3650.0, "sex": -120.0, "bmi": 360.0, "children": 540.0, "smoker": 23000.0,
        "region_northwest": -250.0, "region_southeast": -600.0, "region_southwest": -450.0,
        "smoker_bmi": 2400.0, "smoker_age": 300.0}),
    FixedLinear("second", 11800.0, {
        "age": 3500.0, "sex": 0.0, "bmi": 400.0, "children": 500.0, "smoker": 22500.0,
        "region_northwest": -200.0, "region_southeast": -500.0, "region_southwest": -400.0,
        "smoker_bmi": 2600.0, "smoker_age": 250.0}),
    FixedLinear("third", 9.1, {
        "age": 0.48, "sex": -0.02, "bmi": 0.05, "children": 0.09, "smoker": 1.5,
        "region_northwest": -0.03, "region_southeast": -0.08, "region_southwest": -0.06,
        "smoker_bmi": 0.11, "smoker_age": -0.25}, log_target=True),
]
