"""Alignments equal a plain version that encodes whole texts; the monoid is associative; chunks do not change the result."""
import functools
import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from actuaria.llm import alignment

from .conftest import EDGES


@functools.cache
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(
        x for x in range(256) if x not in printable)}
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: (bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                         else b.id_to_piece(i).replace("▁", " ").encode())
    return a, b, bytes_a, bytes_b


def plain_groups(text):
    a, b, bytes_a, bytes_b = encoders()
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(bytes_a, ids_a)) != raw or b"".join(map(bytes_b, ids_b)) != raw:
        return []
    ends, at = {}, 0
    for i in ids_a:
        at += len(bytes_a(i))
        ends.setdefault(at, [[], []])
    for k, (ids, size) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
        at = 0
        for i in ids:
            at += len(size(i))
            ends.setdefault(at, [[], []])[k].append(i)
    groups, now = [], [[], []]
    own = set(itertools.accumulate(len(bytes_a(i)) for i in ids_a))
    both = set(itertools.accumulate(len(bytes_b(i)) for i in ids_b))
    for e in sorted(ends):
        now = [now[0] + ends[e][0], now[1] + ends[e][1]]
        if e in own and e in both:
            groups.append(now)
            now = [[], []]
    return groups


def plain(rows):
    every = [(i, plain_groups(t)) for i, t in rows]
    links = [Counter((a, b) for g in groups for a in g[0] for b in g[1]) for _, groups in every]
    docs = Counter(pair for c in links for pair in c)
    top = {}
    for (a, _), n in docs.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, groups), c in zip(every, links):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
                    sum(n for p, n in c.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = ["a  b   c\n\n  d\te", "x y z w", "▁ x", "don't we'll I'm", "ﬁ ＡＢ １２ ㎏", "日本語のテキスト 中文 字" * 9, "emoji 😀😀 👩‍👩‍👧 é ́x",
       "<s> </s> <unk> <0x41> <|endoftext|>", " lead", "trail ", "   ", "\x00 \x7f \x1c \x85 x", "-- -- __ ==>>", "3.14 1,000,000 2e10",
       "naïve café ÀÉ", "a" * 3000, " ".join("ab" * 40 for _ in range(20)), "ß ſ ŉ ǆ İ", "x ​ y‍ z", "\r\n \r\n"]


def test_whole_table(spark, texts):
    df = alignment.align_documents(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(df) == plain(list(texts.items()))


@pytest.mark.parametrize("chunk, margin", [(8192, 512), (40, 8), (7, 2)])
def test_edges_in_chunks_of_any_size(spark, make_docs, chunk, margin):
    rows = [(i, t if t is None or len(t) < 10_000 or chunk > 40 else t[:3000]) for i, t in EDGES] + list(enumerate(ODD, 50))
    rows += [(80, ODD[0]), (81, ODD[5]), (81, ODD[5])]
    assert found(alignment.alignments(make_docs(rows).repartition(3), chunk=chunk, margin=margin)) == plain(rows)


def test_groups_are_kept_on_demand_and_an_empty_table_is_empty(spark, make_docs):
    docs = make_docs([(1, "one two"), (2, None)])
    rows = {r.doc_id: r.groups for r in alignment.alignments(docs, keep=True).collect()}
    assert rows == {1: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups("one two")), 2: ""}
    assert alignment.alignments(docs.limit(0)).count() == 0


def test_composition_is_associative():
    paths = tuple(alignment.vocabulary_path(x) for x in (alignment.VOCABULARY_A, alignment.RANKS_A, alignment.VOCABULARY_B))
    voc, rng = alignment.vocabularies(paths), random.Random(4)
    for text in ODD + ["one two three four", "日本語 xyz " * 30]:
        tokens = voc.tokens(text)
        if tokens is None:
            continue
        n = tokens[1][-1]
        whole = alignment.fragment(tokens, -1, n)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(7))})
        parts = [alignment.fragment(tokens, x, y) for x, y in zip(cuts[:-1], cuts[1:])]
        for _ in range(4):  # any order of composition
            left = list(parts)
            while len(left) > 1:
                k = rng.randrange(len(left) - 1)
                left[k:k + 2] = [alignment.compose(*left[k:k + 2])]
            done = left[0]
            assert alignment.finished(done) == alignment.finished(whole)
            assert (list(done.tail_a), list(done.tail_b)) == ([], [])


def test_wide_groups_are_counted_before_they_are_written_out():
    body = b"7|8;" + b",".join([b"5"] * 300) + b"|" + b",".join([b"6"] * 299 + [b"4"]) + b";1,2|3"
    n_a, n_b, group, codes, times = alignment.parsed(body)
    assert (n_a.tolist(), n_b.tolist()) == ([1, 300, 2], [1, 300, 1])
    assert sorted(zip(group.tolist(), codes.tolist(), times.tolist())) == sorted(
        [(0, 7 << 15 | 8, 1), (1, 5 << 15 | 6, 300 * 299), (1, 5 << 15 | 4, 300), (2, 1 << 15 | 3, 1), (2, 2 << 15 | 3, 1)])


@pytest.mark.parametrize("limit, shared", [((1 << 23, 7), 1 << 21), ((9000, 4096), 0), ((1 << 23, 7), 0)])
def test_few_documents_per_block_and_both_ways_of_counting(spark, texts, limit, shared):
    rows = dict(list(texts.items())[:40])
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert found(alignment.alignments(docs, limit=limit, shared=shared)) == plain(list(rows.items()))
    assert alignment.aligned_blocks(docs, limit=limit)[0].count() > 5


def test_a_full_dictionary_starts_anew(texts, monkeypatch):
    paths = tuple(alignment.vocabulary_path(x) for x in (alignment.VOCABULARY_A, alignment.RANKS_A, alignment.VOCABULARY_B))
    monkeypatch.setattr(alignment, "KEPT", 50)
    voc = alignment.Vocabularies(*paths)
    for t in list(texts.values())[:20]:
        pieces = alignment.STABLE.split(t)
        voc.learn(set(pieces[:60]))
        assert len(voc) <= 120 and len(voc.older) <= 120
        assert voc.aligned(pieces).decode() == ";".join(
            ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(t))
