"""SimHash classes equal a plain version over all pairs; thresholds, partitions and dense neighbourhoods."""
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from actuaria.llm import common, simhash

from .brute import words
from .conftest import EDGES


def plain_print(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows):
    """Rows (id, fingerprint, component) by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [(i, p) for (i, _), p in zip(rows, prints) if i is not None]
    for (a, p), (b, q) in itertools.combinations(ids, 2):
        if (p ^ q).bit_count() <= 2:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted(((i, f"{p:016x}", None if i is None else root(i)) for (i, _), p in zip(rows, prints)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, texts):
    df = simhash.simhash_documents(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert found(df) == plain(list(texts.items()))


def test_edges_and_edited_copies(spark, make_docs):
    rng = random.Random(3)
    rows = list(EDGES)
    for k in range(8):
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(90)) for _ in range(400)]
        for j in range(12):
            edited = list(base)
            edited[rng.randrange(400)] = "EDIT" + str(j)
            rows.append((100 + 20 * k + j, " ".join(edited)))
    docs = make_docs(rows).repartition(5)
    assert found(simhash.near_components(docs)) == plain(rows)


def test_empty_table(spark, make_docs):
    assert simhash.near_components(make_docs([(1, "a")]).limit(0)).count() == 0


def test_slices_do_not_change_the_fingerprint():
    raw = " \n".join(f"w{i}\tÀ{i % 7}" for i in range(500)).encode()
    assert {simhash.fingerprint(raw, size) for size in (1, 7, 64, 1 << 20)} == {plain_print(raw.decode())}


@pytest.mark.parametrize("m", [2, 3, 4])
def test_allocation_is_the_cheapest(m):
    rng = np.random.default_rng(m)
    cost = np.cumsum(rng.random((m, 3, 50)), axis=1)
    chosen, total = simhash.allocate(cost, 3 - m)
    for i in range(50):
        best = min(sum(cost[k, t, i] for k, t in enumerate(ts) if t >= 0)
                   for ts in itertools.product((-1, 0, 1, 2), repeat=m) if sum(ts) == 3 - m)
        assert chosen[i].sum() == 3 - m and abs(total[i] - best) < 1e-9
        assert abs(sum(cost[k, t, i] for k, t in enumerate(chosen[i]) if t >= 0) - best) < 1e-9


def test_groups_hold_correlated_bits():
    c = np.eye(64)
    c[np.ix_(range(0, 64, 2), range(0, 64, 2))] = 0.9
    even, odd = simhash.correlated_groups(c, 2)
    assert even == list(range(0, 64, 2)) and odd == list(range(1, 64, 2))


@pytest.mark.parametrize("m", [2, 3, 4])
@pytest.mark.parametrize("cells", [16, 1 << 16])
def test_links_with_few_cells_and_a_dense_neighbourhood(spark, m, cells):
    """All links, whatever the partitions and however coarse the estimates; dense classes probe the whole."""
    rng = random.Random(m)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(14), rng.randrange(6))) for _ in range(1500)}
    prints |= {rng.getrandbits(64) for _ in range(500)}
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))],
                                    "print bigint, node bigint")
    groups = simhash.correlated_groups(simhash.bit_correlations(classes)[1], m)
    plan = simhash.Plan(groups, simhash.cell_counts(classes, groups, cells), cells, dense=400.0)
    every = np.array(sorted(prints), dtype=np.uint64)
    assert 0 < plan.thresholds(every)[2].sum() < len(every)
    got = {(r.a, r.b) for r in simhash.links(classes, plan).collect()}
    near = np.bitwise_count(every[:, None] ^ every[None, :]) <= 2
    assert got == {(a, b) for a, b in zip(*np.nonzero(near)) if a > b}


def test_hash_is_that_of_the_jvm(spark):
    text = "One two  THREE\tfour ñandú"
    [[h]] = [list(s) for s in simhash.shingle_hashes(b"one two three")]
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % (1 << 64) == h
    assert common.SEED == 42 and simhash.fingerprint(text.encode()) == plain_print(text)
