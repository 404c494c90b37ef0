"""Every window has the corpus mixture, wherever the sources' documents are stored."""
from collections import Counter, defaultdict

from actuaria.llm import packing


def test_source_sorted_partitions_are_dealt(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 10_000)
    words = {"a": 900, "b": 300, "c": 60}
    docs = [(k * 1000 + i, " ".join(f"w{(i * 7 + j) % 89}" for j in range(40 + i % 30)), "en", s)
            for k, (s, n) in enumerate(words.items()) for i in range(n)]
    docs.append((5000, " ".join(f"x{j % 53}" for j in range(20_000)), "en", "a"))  # longer than a run
    made = make_docs(docs).repartitionByRange(5, "doc_id")
    pieces = packing.packed(made).collect()
    total, windows = Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.source] += p.length
        windows[p.sequence_id][p.source] += p.length
    whole = sum(total.values())
    assert len(windows) == packing.sequences_of(whole)  # one tail in all
    full = [w for w in windows.values() if sum(w.values()) == packing.WINDOW]
    assert len(full) == whole // packing.WINDOW > 20
    for w in full:
        assert all(abs(w[s] - packing.WINDOW * n / whole) <= 3 for s, n in total.items())
    have = defaultdict(list)
    for p in pieces:
        have[p.doc_id].append((p.start, p.length, p.doc_tokens))
    for parts in have.values():
        at = 0
        for start, n, _ in sorted(parts):
            assert start == at
            at += n
        assert at == parts[0][2]


def test_dealt_only_grows():
    totals = {"=a": 5, "=b": 77, "=c": 1, "=d": 40, "null": 1}
    last = dict.fromkeys(totals, 0)
    for p in range(sum(totals.values()) + 1):
        now = packing.dealt(totals, p)
        assert sum(now.values()) == p and all(now[s] >= last[s] for s in totals)
        last = now
    assert last == totals
