"""Property tests: exactness of distributed quantiles and of the split size."""
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actuaria.operators.preprocess import assign_split
from actuaria.operators.quantiles import percentiles_long, to_long

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=200)


@SETTINGS
@given(vals=values, level=st.sampled_from([(50_000, 64), (8, 4), (8, 64), (1, 3)]))
def test_quantiles_equal_numpy_linear(spark, vals, level):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in percentiles_long(to_long(df, ["x"]), probs, ["column"],
                                                         ranked=level[0], cuts=level[1]).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(np.array(vals), p * 100)), rel=1e-12, abs=1e-9)


@SETTINGS
@given(n=st.integers(1, 400), frac=st.sampled_from([0.1, 0.2, 0.33, 0.5]))
def test_split_has_exact_test_size(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "policy_id")
    out = assign_split(df, test_fraction=frac)
    assert out.where(F.col("split") == "test").count() == math.ceil(frac * n)
    assert out.count() == n


def test_the_descent_has_a_plan_of_constant_size(spark):
    """Ten times the distinct values: more levels, but no longer literals, and the same quantiles as numpy."""
    sizes = []
    for n in (400, 4000):
        df = spark.range(n).selectExpr("cast((id * 7919) % 10007 as double) x")
        out = percentiles_long(to_long(df, ["x"]), [0.01, 0.5, 0.999], ["column"], ranked=8, cuts=8)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        every = [(i * 7919) % 10007 for i in range(n)]
        assert sorted((r["p"], r["value"]) for r in out.collect()) == [
            (q, pytest.approx(np.percentile(every, 100 * q))) for q in (0.01, 0.5, 0.999)]
    assert sizes[1] < 1.2 * sizes[0]
