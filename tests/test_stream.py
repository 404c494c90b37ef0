"""File stream scoring equals batch scoring, also with a fitted model."""
from collections import Counter


def test_stream_equals_batch_with_fitted_model(spark):
    from actuaria.plans.q_stream import stream_with_fitted_model
    stream, batch = stream_with_fitted_model(spark, "/root/testdata/sf0.001")
    cols = sorted(batch.columns)
    a = Counter(tuple(r) for r in stream.select(*cols).collect())
    b = Counter(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and sum(a.values()) == 150
