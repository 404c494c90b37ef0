"""Op 5's grid: its copies are never broadcast, its cells choose block by block, and blocks are narrow but exact."""
import numpy as np
import pytest

from actuaria.llm import topk


def vectors(spark, n, at=0):
    return spark.range(at, at + n).selectExpr("id", "array(id % 7, id % 5 - 2, id % 3) AS v")


def test_the_grid_is_never_broadcast(spark):
    # the estimate of a side's size does not know of its copies for all rows or columns of the grid
    found = topk.top_k(vectors(spark, 40), vectors(spark, 300), 5)
    assert found.count() == 200
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_many_rows_of_cells_merge_in_two_steps(spark, monkeypatch):
    knobs = {"SHARD": 8, "TILE": 4, "SHARDS_PER_CELL": 2, "TILES_PER_CELL": 2}
    want = sorted(map(tuple, topk.top_k(vectors(spark, 30), vectors(spark, 300), 5).collect()))
    for merge in (2, 1000):
        for k, v in (knobs | {"MERGE": merge}).items():
            monkeypatch.setattr(topk, k, v)
        assert sorted(map(tuple, topk.top_k(vectors(spark, 30), vectors(spark, 300), 5).collect())) == want


@pytest.mark.parametrize("most", [3, 1 << 10, 1 << 20, 1 << 29])
@pytest.mark.parametrize("order", ["any", "rising", "falling"])
def test_blocks_in_turn_equal_a_full_sort(monkeypatch, most, order):
    monkeypatch.setattr(topk, "SHARD", 16)
    rng = np.random.default_rng(most % 1000)
    matrix, queries = (rng.integers(-most, most + 1, (n, 3)) for n in (300, 9))
    if order != "any":
        matrix = np.sort(matrix[:, :1], axis=0) * np.ones((1, 3), np.int64) * (1 if order == "rising" else -1)
        queries = np.abs(queries)
    matrix[40:80] = matrix[0]
    ids = np.sort(rng.integers(0, 200, 300))  # some come twice
    q_ids = np.concatenate([ids[:8], [1000]])
    for k in (1, 20, 299, 400):
        q, i, s = topk.best_of_all(topk.narrow(queries), q_ids, topk.narrow(matrix), ids, k)
        for row in range(9):
            score = [sum(int(a) * int(b) for a, b in zip(queries[row], m)) for m in matrix]
            want = sorted((-x, int(c)) for x, c in zip(score, ids) if c != q_ids[row])[:k]
            assert list(zip((-s[q == row]).tolist(), i[q == row].tolist())) == want


def test_blocks_are_narrow_and_hold_every_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 2 * 50)
    rows = [(i, [i, -1]) for i in range(120)] + [(i, [1 << 40]) for i in range(500, 503)] + [(7, []), (8, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<bigint>").coalesce(1)
    blocks = topk.pack(df, 64).toArrow()
    assert sorted((r["dim"], len(r["ids"]) // 8, len(r["matrix"])) for r in blocks.to_pylist()) == [
        (0, 2, 0), (1, 3, 24), (2, 20, 40), (2, 50, 100), (2, 50, 100)]
    got = []
    for r in blocks.to_pylist():
        one = blocks.filter([x == r["block"] for x in blocks["block"].to_pylist()])
        ids, matrix = topk._loaded(one)
        got += [(int(i), m.tolist()) for i, m in zip(ids, matrix)]
    assert sorted(got) == sorted(rows)
