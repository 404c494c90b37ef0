"""Repeated plays of a document lie apart in the pipeline's mixture."""
import hashlib
import random
from collections import defaultdict

from actuaria.llm import mixing


def test_plays_lie_apart(make_docs):
    docs = [(i, " ".join(["w"] * 20), "en", "big") for i in range(400)]
    docs += [(1000 + i, " ".join(["v"] * 20), "en", "small") for i in range(20)]
    at = defaultdict(list)
    for k, r in enumerate(mixing.mixed(make_docs(docs)).collect()):
        at[r.doc_id].append(k)
    assert set(at) == {i for i, *_ in docs} and max(map(len, at.values())) > 1
    gaps = [b - a for places in at.values() for a, b in zip(places, places[1:])]
    assert min(gaps) > 1 and sum(gaps) / len(gaps) > 10


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def plain_schedule(rows, weights):
    """{(id, play): place} of (id, source, tokens), played pass by pass, block by block, until each source's budget is reached."""
    out = {}
    for source, w in weights.items():
        own = [(i, n) for i, s, n in rows if s == source]
        budget, spent, play = w["budget"], 0, 0
        while spent < budget:
            before = play * w["tokens"]
            for key in sorted({md5(mixing.SEED, source, play, md5(mixing.SEED, i)[:2]) for i, _ in own}):
                block = [(i, n) for i, n in own if md5(mixing.SEED, source, play, md5(mixing.SEED, i)[:2]) == key]
                size = sum(n for _, n in block)
                for k, i, n in sorted((md5(mixing.SEED, play, i), i, n) for i, n in block):
                    if spent < budget:
                        out[i, play] = before / budget + size / budget * (int(k[:8], 16) / 2 ** 32)
                        spent += n
                before += size
            play += 1
    return out


def test_schedule_equals_a_plain_one(spark, make_docs):
    rng = random.Random(1)
    docs = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", "big") for i in range(700)]
    docs += [(1000 + i, " ".join(["v"] * rng.randrange(1, 40)), "en", "small") for i in range(60)]
    docs += [(2000 + i, "u " * 9, "en", None) for i in range(5)]
    rows = mixing.counted(make_docs(docs))
    for targets in ({}, {"max_repeat": 2.5}, {"budget": 9000}):
        made = mixing.plan(rows, **targets)
        weights = {r.source: r.asDict() for r in mixing.weights(rows, **targets).collect()}
        got = {(r.id, r.play): r.place for r in mixing.realised(rows, made, mixing.block_places(rows, made)).collect()}
        plain = plain_schedule([(r.id, r.source, r.n_tokens) for r in rows.collect()], weights)
        assert set(got) == set(plain) and all(abs(got[k] - v) < 1e-12 for k, v in plain.items())


def test_every_tenth_holds_the_sources_in_proportion(spark, make_docs):
    docs = [(i, " ".join(["w"] * 20), "en", "big") for i in range(8000)]
    docs += [(10_000 + i, " ".join(["v"] * 20), "en", "small") for i in range(800)]
    out = mixing.mixed(make_docs(docs)).collect()
    whole = sum(r.source == "small" for r in out) / len(out)
    assert whole > 0.15
    for k in range(10):
        part = out[len(out) * k // 10:len(out) * (k + 1) // 10]
        assert abs(sum(r.source == "small" for r in part) / len(part) - whole) < 0.05 * 1.5
