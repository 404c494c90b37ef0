"""Repeat groups hold every occurrence: copied passages, equal texts, split anchors."""
import random
from collections import defaultdict

import pytest

from actuaria.llm import repeats


def passages(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def grouped(df):
    out = defaultdict(set)
    for r in df.collect():
        out[(bytes(r.repeat), r.length)].add((r.doc_id, r.start))
    return out


@pytest.mark.parametrize("knobs", [{}, {"HOT": 4, "ENTRIES": 64}])
def test_inner_part_of_a_copied_passage_is_grouped(make_docs, monkeypatch, knobs):
    for k, v in knobs.items():
        monkeypatch.setattr(repeats, k, v)
    passage = passages(0, 2000)
    docs = [(i, passages(i + 1, 300) + passage + passages(i + 100, 300)) for i in range(9)]
    docs.append((3, docs[3][1]))  # an equal text in another row
    docs.append((50, docs[4][1]))
    texts = dict(docs)
    groups = grouped(repeats.repeat_groups(make_docs(docs).repartition(3)))
    everywhere = set(range(9)) | {50}
    covered = set()
    for (name, length), at in groups.items():
        parts = {texts[i].encode()[s:s + length] for i, s in at}
        assert len(parts) == 1 and repeats.digest(parts.pop()) == name
        if {i for i, _ in at} == everywhere:
            first = min(s for i, s in at if i == 0) - 300
            covered |= set(range(first, first + length))
    assert set(range(2000)) <= covered
    twice = {i for i, _ in groups[max(groups, key=lambda g: len(groups[g]))]}
    assert {4, 50} <= twice


def test_split_anchors_give_the_same_groups(make_docs, monkeypatch):
    phrase = passages(7, 240)
    docs = [(i, passages(i + 1, 150) + phrase[:210 + i % 3 * 15] + passages(i + 100, 150)) for i in range(60)]
    whole = grouped(repeats.repeat_groups(make_docs(docs).coalesce(1)))
    monkeypatch.setattr(repeats, "HOT", 8)
    split = grouped(repeats.repeat_groups(make_docs(docs).coalesce(1)))
    assert whole and split == whole
