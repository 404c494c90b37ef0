"""Runs equal those of a plain search over all periods; scales, highly periodic stretches and the query's digests."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from actuaria.llm import periodic

from .conftest import EDGES


def split(text):
    return (text or "").encode().split()


def plain_runs(w, least=12):
    """(start, length, period) of all runs, by comparing with every lag."""
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in w], dtype=np.int32)
    found = {}
    for p in range(1, len(w) // 2 + 1):
        stop = np.append(np.flatnonzero(w[:-p] != w[p:]), len(w) - p)
        start = np.append(0, stop[:-1] + 1)
        for k in np.flatnonzero(stop - start >= p):
            found.setdefault((int(start[k]), int(stop[k]) + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, 2 * p))


def plain(doc_id, text):
    w = split(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(texts, first=1, least=4):
    got = periodic.find_runs(list(range(len(texts))), [" ".join(t).encode() for t in texts], least, None, first)
    return [runs for runs, _ in got]


def test_whole_table(spark, texts):
    df = periodic.runs_documents(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                          "collapsed_sha256"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(plain(i, t) for i, t in texts.items())
    assert sum(r[1] > 0 for r in rows) >= len(rows) // 20


def test_edges(spark, make_docs):
    rows = EDGES + [(20, " ".join(["a b c d e f g h i j k l m"] * 4)), (30, "x " * 500), (41, "p q " * 40 + "q p " * 40)]
    df = periodic.run_digests(periodic.periodic_runs(make_docs(rows), rearrange=periodic.planted))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((plain(i, t) for i, t in rows), key=repr)
    assert periodic.periodic_runs(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("first", [1, 2, 4])
def test_random_words_over_few_letters(first):
    rng = random.Random(first)
    texts = [[rng.choice("abc"[:1 + k % 3]) for _ in range(rng.randrange(160))] for k in range(200)]
    assert found(texts, first) == [plain_runs(t, 4) for t in texts]


@pytest.mark.parametrize("first", [1, 4])
def test_squares_of_every_period(first):
    rng = random.Random(7)
    texts = []
    for q in range(1, 90):
        u = [rng.choice("abcdef") for _ in range(q)]
        cut = rng.randrange(q + 1)
        texts.append([rng.choice("xyz") for _ in range(rng.randrange(9))] + u * rng.randrange(2, 4) + u[:cut] + list("zyx"))
    assert found(texts, first) == [plain_runs(t, 4) for t in texts]


@pytest.mark.parametrize("first", [1, 2, 4])
def test_highly_periodic_halves(first):
    """Squares whose first period is itself periodic hold no synchronising pair; touching runs supply them."""
    texts = []
    for root in ("a", "ab", "aab", "abcb"):
        for k in (7, 12, 25, 40):
            for extra in ("", root[:1], root[:-1], "c", root[::-1]):
                texts.append(list(root * k + extra + root * k))
                texts.append(list((root * k + extra) * 3))
                texts.append(list((root * k + extra) * 2 + root * (k // 2) + "c" + root * k))
    assert found(texts, first) == [plain_runs(t, 4) for t in texts]


def test_fibonacci_and_thue_morse_words():
    fib, tm = ["b", "a"], "a"
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    while len(tm) < 512:
        tm += tm.translate(str.maketrans("ab", "ba"))
    texts = [list(fib[-1]), list(tm), list(fib[-2] + tm + fib[-2])]
    assert found(texts) == [plain_runs(t, 4) for t in texts]


def test_synchronising_positions_depend_on_the_context_alone():
    rng = np.random.default_rng(5)
    names = rng.integers(1, 1 << 62, 4000, dtype=np.uint64)
    names[3000:3300] = names[100:400]
    for tau in (4, 16):
        at = set(periodic.synchronising(names, tau).tolist())
        assert all((i in at) == (i + 2900 in at) for i in range(100, 400 - 2 * tau))
        assert all(any(j in at for j in range(i, i + tau)) for i in range(0, 3900, 50))
        assert len(at) < 3 * 4000 / tau


def test_one_long_text_of_many_scales():
    rng = random.Random(9)
    block = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    text = block[:50] + block * 3 + block[:1234] + ["end"] + ["lap", "dap"] * 3000 + block[:100] * 20
    runs, collapsed = periodic.find_runs([1], [" ".join(text).encode()])[0]
    assert (50, 3 * 4000 + 1234, 4000) in runs and (50 + 13234 + 1, 6000, 2) in runs
    assert any(p == 100 and n >= 2000 for _, n, p in runs) and len(collapsed.split()) < 4500
