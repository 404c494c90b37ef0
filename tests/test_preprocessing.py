"""Preprocessing: the reference's outlier/clip checks plus split and scaler properties."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators import preprocess as P
from actuaria.operators.quantiles import quantile_table
from actuaria.plans.preprocess_all import preprocess

ROWS = [(25, 22.5, 0, 5000), (30, 28.0, 1, 8000), (45, 31.5, 2, 15000),
        (60, 35.0, 3, 25000), (18, 45.0, 0, 12000), (100, 75.0, 1, 60000)]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(ROWS, "age int, bmi double, children int, charges int")


def _bounds(df, col):
    r = P.outlier_bounds(df, [col]).first()
    return r["lower"], r["upper"], r["n_outliers"]


def test_detect_outliers_finds_extreme_values(sample):
    assert _bounds(sample, "bmi")[2] >= 1


def test_detect_outliers_uniform_data(spark):
    df = spark.createDataFrame([(10,)] * 6, "val int")
    assert _bounds(df, "val")[2] == 0


def test_clip_preserves_row_count(sample):
    assert P.clip_outliers(sample, ["bmi"]).count() == 6


def test_clip_constrains_values(sample):
    lower, upper, _ = _bounds(sample, "bmi")
    got = P.clip_outliers(sample, ["bmi"]).agg(F.max("bmi"), F.min("bmi")).first()
    assert got[0] <= upper + 1e-3 and got[1] >= lower - 1e-3


def test_clip_leaves_other_columns_alone(sample):
    out = P.clip_outliers(sample, ["bmi"]).orderBy("charges").select("age").collect()
    exp = sample.orderBy("charges").select("age").collect()
    assert out == exp


def test_clip_empty_column_list_is_identity(sample):
    assert P.clip_outliers(sample, []) is sample


def test_clip_is_idempotent(sample):
    once = P.clip_outliers(sample, ["bmi"])
    twice = P.clip_outliers(once, ["bmi"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_policy_table_structure(policy_small):
    df = policy_small
    assert df.columns == [C.KEY] + C.RAW_COLUMNS
    assert df.count() == 150
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("int")) for c in df.columns]).first()
    assert all(v == 0 for v in nulls)
    assert {r[0] for r in df.select("smoker").distinct().collect()} <= {"yes", "no"}
    assert {r[0] for r in df.select("sex").distinct().collect()} <= {"male", "female"}


def test_quantiles_match_numpy_linear_with_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=2000), np.full(1000, 0.25)])  # a third of rows share one value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantile_table(df, ["x"], probs, [f"q{i}" for i in range(len(probs))]).first()
    for i, p in enumerate(probs):
        assert got[f"q{i}"] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_split_exact_size_disjoint_complete(policy_small):
    out = P.assign_split(policy_small).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in out}
    assert sizes["test"] == math.ceil(0.2 * 150)
    assert sizes["test"] + sizes["train"] == 150


def test_split_is_deterministic(policy_small):
    a = sorted(P.assign_split(policy_small).collect())
    b = sorted(P.assign_split(policy_small).collect())
    assert a == b


def test_label_mapping_alphabetical(policy_small):
    m = {(r["column"], r["class"]): r["code"] for r in P.label_mapping(policy_small, ["sex", "smoker"]).collect()}
    assert m == {("sex", "female"): 0, ("sex", "male"): 1, ("smoker", "no"): 0, ("smoker", "yes"): 1}


def test_one_hot_drops_first_and_appends(policy_small):
    out = P.one_hot(policy_small, "region", C.REGIONS)
    assert out.columns[-3:] == ["region_northwest", "region_southeast", "region_southwest"]
    assert "region" not in out.columns


def test_scaler_uses_population_std(policy_small):
    pre = preprocess(policy_small)
    z = pre.frame.agg(F.avg("age"), F.stddev_pop("age")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-9) and z[1] == pytest.approx(1.0, abs=1e-9)


def test_decode_inverts_constant_scaling(policy_small):
    scaled = P.scale_constants(policy_small)
    enc = scaled.select(C.KEY, "age", "bmi", "children",
                        (F.col("sex") == "male").cast("int").alias("sex"),
                        (F.col("smoker") == "yes").cast("int").alias("smoker"),
                        *[(F.col("region") == r).cast("int").alias(f"region_{r}") for r in C.REGIONS[1:]])
    back = P.decode_features(enc).orderBy(C.KEY).collect()
    orig = policy_small.orderBy(C.KEY).collect()
    for a, b in zip(back, orig):
        assert (a["age"], a["sex"], a["children"], a["smoker"], a["region"]) == \
               (b["age"], b["sex"], b["children"], b["smoker"], b["region"])
        assert a["bmi"] == pytest.approx(b["bmi"], abs=0.05)


def test_one_hot_fits_its_categories(spark):
    df = spark.createDataFrame([(i, f"c{i:04d}") for i in range(1200)], "k int, c string")
    assert P.fit_categories(df, "c") == [f"c{i:04d}" for i in range(1200)]
    assert P.one_hot(df.limit(1), "c", ["b", "a", "c0000"]).columns == ["k", "c_b", "c_c0000"]


def test_columns_without_values_keep_their_row(spark):
    from actuaria.operators import profile as E
    df = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, float("nan"))], "a double, b double")
    assert {r["column"]: r["count"] for r in E.describe_numeric(df, ["a", "b"]).collect()} == {"a": 3, "b": 0}
    assert {r["column"]: r["q1"] for r in P.quartiles(df, ["a", "b"]).collect()} == {"a": 1.5, "b": None}
    assert {r["column"]: r["n_outliers"] for r in P.outlier_bounds(df, ["a", "b"]).collect()} == {"a": 0, "b": 0}
    assert {r["column"]: r["n"] for r in E.boxplot_stats(df, ["a", "b"]).collect()} == {"a": 3, "b": 0}
    bins = E.histograms(df, ["a", "b"], 4).collect()
    assert sum(r["count"] for r in bins if r["column"] == "a") == 3
    assert [r["count"] for r in bins if r["column"] == "b"] == [0] * 4


def test_contiguous_folds_cut_the_key_order(spark):
    df = spark.createDataFrame([(i * 7 % 1003,) for i in range(1003)], f"{C.KEY} bigint")
    got = P.contiguous_fold(df, C.KEY, 5).orderBy(C.KEY).collect()
    folds = [r["fold"] for r in got]
    assert folds == sorted(folds) and [folds.count(i) for i in range(5)] == [201, 201, 201, 200, 200]
    assert P.contiguous_fold(df.limit(0), C.KEY, 5).count() == 0


def test_known_columns_shuffle_no_rows_by_name(spark):
    """With a small broadcast limit, only aggregated rows are hashed by column, group or category."""
    from actuaria.operators import profile as E
    n = 20_000
    df = spark.range(n).selectExpr("cast(id as double) a", "cast(id % 17 as double) b", "cast(id % 3 as string) c")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(256 << 10))
    try:
        for out in (E.histograms(df, ["a", "b"], 10), P.label_encode(df, ["c"]), E.value_share(df, ["c"])):
            out.collect()
            lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
            for above, below in zip(lines, lines[1:]):
                if "Exchange hashpartitioning" in above:  # what it moves is aggregated or made of the column list
                    assert "partial_" in below or "functions=[]" in below or "Generate explode" in below, below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("literal, range_classes", [(512, 200_000), (3, 7), (0, 1)])
def test_label_encode_of_many_classes_with_a_frequent_one(spark, literal, range_classes):
    """Frequent, rare and missing classes; codes joined, literal, and ranked over several ranges alike."""
    from actuaria.operators import preprocess as P
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"c{i % 401}", "yn"[i % 2], "" if i == 5 else "z") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a string, b string, _class0 string").repartition(6)
    out = P.label_encode(df, ["a", "b", "_class0"][:2], literal, range_classes)
    assert out.columns == df.columns and out.count() == len(rows)
    codes = [{v: k for k, v in enumerate(sorted({r[c] for r in rows if r[c] is not None}))} for c in (1, 2)]
    assert {r["id"]: (r["a"], r["b"], r["_class0"]) for r in out.collect()} == {
        r[0]: (codes[0].get(r[1]), codes[1][r[2]], r[3]) for r in rows}
    ranked = P.ranked_classes(P.class_counts(df, ["a", "b"]), range_classes).collect()
    assert {(r["column"], r["class"]): r["code"] for r in ranked} == {
        (c, v): k for c, m in zip("ab", codes) for v, k in m.items()}


def test_categories_that_become_columns_are_bounded(spark):
    from actuaria.operators import preprocess as P
    df = spark.range(30).selectExpr("cast(id % 11 as string) c")
    assert P.fit_categories(df, "c", 11) == sorted({str(i) for i in range(11)})
    with pytest.raises(ValueError):
        P.fit_categories(df, "c", 10)
