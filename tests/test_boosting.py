"""Boosted trees equal a plain version; both ways of growing and any dealing of rows give the same trees."""
import numpy as np
import pytest

from actuaria.operators import boosting as B

NAMES = ["a", "b", "c", "d"]


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(18, 65, n)])
    y = 3000 * x[:, 0] + 100 * x[:, 3] + 900 * np.sin(3 * x[:, 2]) * x[:, 1] + rng.normal(size=n).round(3) * 50
    return x.astype(float), y


@pytest.fixture(scope="module")
def small(spark):
    x, y = table(200)
    rows = [(i, *map(float, r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, c double, d double, y double, fold int")
    return df, x, y, B.bin_rows(df, NAMES, "y", "k", "fold")


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def plain_tree(x, r, spec, columns=range(4)):
    """{path: (feature, threshold)} and {path: leaf weight}, leaves split best gain first."""
    def score(v):
        return soft(v.sum(), spec.alpha) ** 2 / (len(v) + spec.lam)

    def best(rows, depth):
        top = (B.LEAST_GAIN, None, None)
        if depth < spec.depth and len(rows) >= spec.min_split:
            for f in columns:
                values = np.unique(x[:, f])
                for t in (values[:-1] + values[1:]) / 2:
                    left = rows[x[rows, f] <= t]
                    right = rows[x[rows, f] > t]
                    if min(len(left), len(right)) >= max(spec.min_leaf, 1):
                        gain = score(r[left]) + score(r[right]) - score(r[rows])
                        if gain > top[0] * (1 + 1e-12):
                            top = (gain, f, t)
        return top

    leaves = {"": np.arange(len(x))}
    found = {"": best(leaves[""], 0)}
    splits, order = {}, []
    while not spec.leaves or len(leaves) < spec.leaves:
        path = max((p for p in leaves if found[p][1] is not None), key=lambda p: found[p][0], default=None)
        if path is None:
            break
        _, f, t = found[path]
        rows = leaves.pop(path)
        splits[path] = (f, t)
        order.append(path)
        for side, part in (("L", rows[x[rows, f] <= t]), ("R", rows[x[rows, f] > t])):
            leaves[path + side] = part
            found[path + side] = best(part, len(path) + 1)
    weights = {p: spec.rate * soft(r[rows].sum(), spec.alpha) / (len(rows) + spec.lam) for p, rows in leaves.items()}
    return splits, weights, order


def paths_of(row):
    splits, weights, stack = {}, {}, [(0, "")]
    while stack:
        at, path = stack.pop()
        if row["left"][at] < 0:
            weights[path] = row["value"][at]
        else:
            splits[path] = (row["feature"][at], row["threshold"][at])
            stack += [(row["left"][at], path + "L"), (row["right"][at], path + "R")]
    return splits, weights


SPECS = [B.Spec(1, 3, 0.3, lam=1.0), B.Spec(1, 4, 0.1, alpha=500.0, lam=3.0), B.Spec(1, 6, 0.1, leaves=7, min_leaf=5),
         B.Spec(1, 6, 0.2, leaves=15, alpha=50.0, lam=1.5, min_leaf=3), B.Spec(1, 5, 0.1, min_split=10), B.Spec(1, 7, 0.1, min_split=2),
         B.Spec(1, 1, 1.0, alpha=1e9)]


@pytest.mark.parametrize("k", range(len(SPECS)))
def test_a_tree_equals_the_plain_one(small, k):
    _, x, y, binned = small
    spec = SPECS[k]
    [model] = B.fit(binned, [spec])
    splits, weights, _ = plain_tree(x, y - y.mean(), spec)
    got_splits, got_weights = paths_of(model.rows()[0])
    assert {p: (f, pytest.approx(t)) for p, (f, t) in splits.items()} == got_splits
    assert got_weights == {p: pytest.approx(w, abs=1e-3) for p, w in weights.items()}
    if spec.leaves:
        assert len(got_weights) <= spec.leaves


def test_min_samples_split_is_the_nodes_own_count(small):
    """A node of 10 rows may be split 9 to 1; halving the count for each child would forbid it."""
    x = np.zeros((12, 4))
    x[0, 0], x[1, 1] = 1, 1
    y = np.array([100.0, 40.0] + [0.0] * 10)
    rows = B.Rows(np.stack([B.code_of(x[:, f], np.array([0.5])) for f in range(4)], axis=1), y,
                  np.arange(12, dtype=np.uint64), np.full(12, B.NO_FOLD, np.uint8))
    cuts = [np.array([0.5])] * 4
    for least, leaves in ((2, 3), (11, 3), (12, 2), (13, 1)):
        found, _ = B.grow_batch(rows, [B.Spec(1, 3, 1.0, min_split=least)], {B.NO_FOLD: y.mean()}, 2.0 ** 20, cuts, True)
        assert sum(f < 0 for f in found[0]["left"]) == leaves


def test_leaf_budget_takes_the_best_splits_first(small):
    _, x, y, binned = small
    _, _, order = plain_tree(x, y - y.mean(), B.Spec(1, 7, 0.1, leaves=12, min_leaf=2))
    for leaves in (2, 3, 5, 9, 12):
        [model] = B.fit(binned, [B.Spec(1, 7, 0.1, leaves=leaves, min_leaf=2)])
        assert set(paths_of(model.rows()[0])[0]) == set(order[:leaves - 1])


MANY = [B.Spec(5, 3, 0.3, 0.8, 0.5, alpha=1.0, lam=1.0, fold=1), B.Spec(7, 4, 0.1, leaves=5, min_leaf=4, fold=2),
        B.Spec(3, 2, 0.5, 0.7, min_split=10), B.Spec(6, 5, 0.1, lam=2.0, fold=0), B.Spec(7, 4, 0.1, leaves=5, min_leaf=4, fold=2)]


def test_distributed_levels_give_the_same_trees_and_scores(spark, small, monkeypatch):
    df, _, _, binned = small
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)  # the driver's sums; blocks are as the tasks cut them
    spread = B.bin_rows(df.repartition(7), NAMES, "y", "k", "fold")
    spread.scale = binned.scale
    assert spread.blocks.count() > 1
    whole = sorted(map(repr, B.grow(binned, MANY).collect()))
    assert sorted(map(repr, B.grow(spread, MANY, whole_bytes=0).collect())) == whole
    assert sorted(map(repr, B.grow(spread, MANY).collect())) == whole
    one = {r["model"]: r for r in B.grow(binned, MANY, False).collect()}
    for r in B.grow(spread, MANY, False, whole_bytes=0).collect():
        assert r["n"] == one[r["model"]]["n"] and r["sse"] == pytest.approx(one[r["model"]]["sse"])
    assert one[2]["n"] == 0 and one[0]["n"] == 40


def test_models_grown_together_equal_models_grown_alone(small):
    binned = small[3]
    together = B.fit(binned, MANY)
    for spec, model in zip(MANY, together):
        [alone] = B.fit(binned, [spec])
        assert model.rows() == alone.rows() and model.start == alone.start


def test_predictions_boosting_and_folds(spark, small):
    df, x, y, binned = small
    [model] = B.fit(binned, [B.Spec(60, 3, 0.2, lam=1.0)])
    got = model.predict(x)
    plain = np.full(len(x), y.mean())
    for _ in range(60):
        splits, weights, _ = plain_tree(x, y - plain, B.Spec(1, 3, 0.2, lam=1.0))
        for i in range(len(x)):
            path = ""
            while path in splits:
                f, t = splits[path]
                path += "L" if x[i, f] <= t else "R"
            plain[i] += weights[path]
        if _ == 4:
            [five] = B.fit(binned, [B.Spec(5, 3, 0.2, lam=1.0)])
            assert np.allclose(five.predict(x), plain, atol=1e-2)
            break
    assert ((got - y) ** 2).mean() < 0.05 * y.var()
    scored = df.select("k", model.column(*[df[c] for c in NAMES]).alias("p")).collect()
    assert np.allclose([r.p for r in sorted(scored)], got)
    r2 = B.cross_validated(binned, [B.Spec(60, 3, 0.2, lam=1.0), B.Spec(1, 1, 0.01)], 5)
    assert r2.shape == (2, 5) and (r2[0] > 0.6).all() and (r2[1] < 0.1).all()
    held = np.arange(200) % 5 == 3
    [fold] = B.fit(binned, [B.Spec(60, 3, 0.2, lam=1.0, fold=3)])
    assert r2[0, 3] == pytest.approx(1 - ((fold.predict(x[held]) - y[held]) ** 2).sum() / (y[held].var() * held.sum()))


def test_many_values_empty_and_null_rows(spark):
    rows = [(i, float(i) if i % 7 else None, float(i % 3), float(i)) for i in range(2000)] + [(None, 1.0, 1.0, 5.0), (9999, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, y double")
    binned = B.bin_rows(df, ["a", "b"], "y", "k")
    assert binned.n == 2000 and len(binned.cuts[0]) == 255 and len(binned.cuts[1]) == 2
    [model] = B.fit(binned, [B.Spec(20, 4, 0.3)])
    assert 0 < model.predict(np.array([[1000.0, 1.0]]))[0] < 2000 and np.isfinite(model.predict(np.array([[np.nan, 1.0]]))[0])
    [none] = B.fit(B.bin_rows(df.limit(0), ["a", "b"], "y", "k"), [B.Spec(3, 2, 0.1)])
    assert none.predict(np.array([[1.0, 1.0]]))[0] == 0.0


def test_sums_over_joint_codes_and_parts_equal_those_of_each_feature(small, monkeypatch):
    """Features that take few combinations together share one pass over the rows; parts of the rows add up."""
    rng = np.random.default_rng(4)
    n, widths = 5000, [2, 40, 40, 2, 7]
    codes = rng.integers(0, 2, (n, 5)).astype(np.uint8)
    codes[:, 1], codes[:, 4] = rng.integers(0, 39, n), rng.integers(0, 7, n)  # the last bin stays empty
    codes[:, 2] = codes[:, 1] * codes[:, 0]
    rows = B.Rows(codes, rng.normal(size=n), np.arange(n, dtype=np.uint64), np.full(n, B.NO_FOLD, np.uint8))
    cells = B.Cells(rows, widths)
    assert len(cells.groups) < 5
    g = {3: rng.integers(-1000, 1000, n).astype(float)}
    lists = [np.arange(n), np.flatnonzero(codes[:, 4] == 3), np.zeros(0, np.int64)]
    sums, counts = cells.sums(g, np.array([3, 3, 3]), lists)
    for k, here in enumerate(lists):
        for f, width in enumerate(widths):
            at = slice(sum(widths[:f]), sum(widths[:f + 1]))
            assert sums[k, at].tolist() == np.bincount(codes[here, f], g[3][here], width).tolist()
            assert counts[k, at].tolist() == np.bincount(codes[here, f], None, width).tolist()
    one = B.grow_batch(rows, MANY, dict.fromkeys((0, 1, 2, B.NO_FOLD), 0.0), 2.0 ** 20, [np.arange(w - 1.0) for w in widths], True)
    monkeypatch.setattr(B, "PART_ROWS", 700)
    assert B.grow_batch(rows, MANY, dict.fromkeys((0, 1, 2, B.NO_FOLD), 0.0), 2.0 ** 20, [np.arange(w - 1.0) for w in widths], True) == one


def test_distributed_growing_takes_one_job_a_level(spark, small, monkeypatch):
    """Three levels of six trees: a job each, and what dealing, the lineage and the result take; nothing written per level."""
    monkeypatch.setattr(B, "LINEAGE", 3)
    spec = [B.Spec(6, 3, 0.3, 0.8, lam=1.0)]
    whole = sorted(map(repr, B.grow(small[3], spec).collect()))
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        got = B.grow_levels(small[3], spec, True)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    assert sorted(map(repr, got.collect())) == whole
    assert 18 <= jobs <= 18 + 6


def test_prediction_holds_few_cells_at_once(small):
    """Rows are walked down in blocks that stay small, whatever the number of trees; the sums are those of all rows at once."""
    import tracemalloc
    model = B.fit(small[3], [B.Spec(40, 3, 0.1)])[0]
    model = B.BoostedTrees.of(model.features, model.start, [{**r, "tree": 40 * k + r["tree"]} for k in range(10) for r in model.rows()])
    x = table(4096, 7)[0]
    tracemalloc.start()
    got = model.predict(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20
    assert np.array_equal(got, model.predict(x, most=1 << 22)) and np.array_equal(got[:1], model.predict(x, most=2)[:1])
    assert model.predict(x[:0]).shape == (0,)


def wide_rows(n=3000):
    rng = np.random.default_rng(9)
    codes = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 2, n), rng.integers(0, 12, n), rng.integers(0, 5, n)]).astype(np.uint8)
    y = (codes @ np.array([3.0, 400.0, -20.0, 9.0])) + rng.normal(size=n).round(3) * 30
    return (B.Rows(codes, y, np.arange(n, dtype=np.uint64), (np.arange(n) % 3).astype(np.uint8)),
            dict.fromkeys((0, 1, 2, B.NO_FOLD), float(y.mean().round(2))), [np.arange(w - 1.0) for w in (30, 2, 12, 5)])


def test_models_in_step_share_the_operations_of_a_level(monkeypatch):
    """Six models of four levels and five trees: histograms are asked for once a level and tree, not once a model."""
    rows, means, cuts = wide_rows()
    specs = [B.Spec(5, 4, 0.1, 0.8, 0.7, lam=1.0, fold=k % 3, seed=k // 3) for k in range(6)]
    calls, run = [], B.Part.sums
    monkeypatch.setattr(B.Part, "sums", lambda part, m, at: calls.append(len(m)) or run(part, m, at))
    B.grow_batch(rows, specs, means, 2.0 ** 20, cuts, False)
    assert len(calls) == 5 * 4


@pytest.mark.parametrize("change", [{"PAIRS": 1}, {"PAIRS": 7000}, {"SLIM": 0}, {"SLIM": 1 << 20}, {"SOUGHT": 1}, {"PART_ROWS": 500}])
def test_trees_do_not_depend_on_what_is_worked_on_at_once(monkeypatch, change):
    rows, means, cuts = wide_rows()
    specs = [*MANY, B.Spec(4, 6, 0.2, 0.9, min_split=5, fold=1), B.Spec(4, 3, 0.2, alpha=40.0, lam=1.5, fold=2)]
    found, scores = B.grow_batch(rows, specs, means, 2.0 ** 20, cuts, True)
    for name, value in change.items():
        monkeypatch.setattr(B, name, value)
    other, again = B.grow_batch(rows, specs, means, 2.0 ** 20, cuts, True)
    assert other == found
    assert sorted(again) == sorted(scores)


def test_small_and_joint_sums_agree(monkeypatch):
    rows, _, cuts = wide_rows()
    cells = B.Cells(rows, [len(c) + 1 for c in cuts])
    slot = np.arange(len(rows)) % 50
    w = np.random.default_rng(2).integers(-999, 999, len(rows)).astype(float)
    got = []
    for slim in (0, 1 << 20):
        monkeypatch.setattr(B, "SLIM", slim)
        got.append(cells.at(np.arange(len(rows)), w, slot, 51))
    assert all(np.array_equal(a, b) for a, b in zip(*got)) and not got[0][1][50].any()
