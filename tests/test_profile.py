"""Profiling statistics against pandas definitions."""
import pytest

from actuaria.operators import profile as E


def test_describe_matches_pandas(policy_small):
    pdf = policy_small.toPandas()
    got = {r["column"]: r for r in E.describe_numeric(policy_small, ["age", "bmi", "charges"]).collect()}
    for c in ["age", "bmi", "charges"]:
        d = pdf[c].describe()
        r = got[c]
        assert r["count"] == d["count"]
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert r[ours] == pytest.approx(d[theirs], abs=1e-5)


def test_skew_kurtosis_match_pandas(policy_small):
    pdf = policy_small.toPandas()
    got = {r["column"]: r for r in E.shape_stats(policy_small, ["bmi", "charges"]).collect()}
    for c in ["bmi", "charges"]:
        assert got[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=1e-5)
        assert got[c]["kurtosis"] == pytest.approx(pdf[c].kurtosis(), abs=1e-5)


def test_histogram_counts_sum_to_rows(policy_small):
    h = E.histogram(policy_small, "charges", 40)
    rows = h.collect()
    assert len(rows) == 40 and sum(r["count"] for r in rows) == policy_small.count()


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    rows = E.histogram(df, "x", 3).collect()
    assert sum(r["count"] for r in rows) == 4


def test_value_counts_and_top(policy_small):
    pdf = policy_small.toPandas()
    got = {r["column"]: r for r in E.describe_categorical(policy_small, ["region"]).collect()}
    vc = pdf["region"].value_counts()
    assert got["region"]["freq"] == vc.max() and got["region"]["unique"] == pdf["region"].nunique()


def test_correlation_lower_triangle(policy_small):
    enc = E.encode_for_correlation(policy_small)
    cols = ["age", "bmi", "charges"]
    rows = E.correlation_matrix(enc, cols, lower_only=True).collect()
    assert {(r["var_a"], r["var_b"]) for r in rows} == {("bmi", "age"), ("charges", "age"), ("charges", "bmi")}
    pdf = enc.select(*cols).toPandas()
    for r in rows:
        assert r["corr"] == pytest.approx(pdf[r["var_a"]].corr(pdf[r["var_b"]]), abs=1e-5)


def test_quality_checks_clean_table(policy_small):
    rows = {r["rule"]: r["violations"] for r in E.quality_checks(policy_small).collect()}
    assert rows["not_null:age"] == 0 and rows["domain:sex"] == 0 and rows["required:charges"] == 0


def test_boxplot_whiskers_inside_fences(policy_small):
    r = E.boxplot_stats(policy_small, ["charges"]).first()
    assert r["whisker_lo"] >= r["q1"] - 1.5 * r["iqr"] - 1e-6
    assert r["whisker_hi"] <= r["q3"] + 1.5 * r["iqr"] + 1e-6
    pdf = policy_small.toPandas()["charges"]
    lo, hi = r["q1"] - 1.5 * r["iqr"], r["q3"] + 1.5 * r["iqr"]
    assert r["n_outliers"] == int(((pdf < lo) | (pdf > hi)).sum())


def test_column_selection_by_type(policy_small):
    assert E.numeric_columns(policy_small) == ["policy_id", "age", "bmi", "children", "charges"]
    assert E.string_columns(policy_small) == ["sex", "smoker", "region"]


def test_empty_and_null_inputs(spark):
    from actuaria.operators.quantiles import quantile_table
    empty = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in quantile_table(empty, ["x"], [0.5], ["q50"]).collect()] == [("x", None)]
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    rows = E.histogram(nulls, "x", 4).collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == 0


def test_approx_method_is_close(spark):
    from actuaria.sources.tables import table
    li = table(spark, "/root/testdata/sf0.01", "lineitem")
    exact = {r["column"]: r for r in E.describe_numeric(li, ["l_extendedprice"]).collect()}
    approx = {r["column"]: r for r in E.describe_numeric(li, ["l_extendedprice"], method="approx").collect()}
    for k in ("p25", "p50", "p75"):
        assert approx["l_extendedprice"][k] == pytest.approx(exact["l_extendedprice"][k], rel=1e-3)


def test_wide_correlations_equal_those_of_pairs_with_missing_values(spark):
    """Every pair over the rows where both are there, whatever the blocks; far from zero; a constant column."""
    import numpy as np
    from actuaria.operators import profile as P
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + [0, 1e6, -5, 3, 0]
    x[:, 4] = 2.0
    rows = [tuple(None if (i * 7 + j) % 11 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(5))).repartition(7)
    cols = df.columns
    for lower in (False, True):
        pairs = {(r.var_a, r.var_b): r.corr for r in P.correlation_matrix(df, cols[:4], 6, lower).collect()}
        wide = {(r.var_a, r.var_b): r.corr for r in P.wide_correlation_matrix(df, cols, 6, lower).collect()}
        assert len(wide) == (10 if lower else 25)
        assert all(wide[p] == pytest.approx(v, abs=2e-6) for p, v in pairs.items())
        assert all(v is None for (a, b), v in wide.items() if "c4" in (a, b))
    many = spark.range(50).selectExpr(*[f"cast(sin(id * {j + 1}) as double) as v{j}" for j in range(40)])
    assert len(P.correlation_matrix(many, many.columns)._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert P.wide_correlation_matrix(many.limit(0), many.columns).count() == 0
