"""The training-data operators against plain versions, on small and awkward tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from actuaria.llm import (common, components, fingerprint, fixity, jaccard, language, mixing, packing, repeats, secrets,
                          tokens, topk)
from actuaria.session import scratch_path

from . import brute
from .conftest import EDGES, LONG

EMPTY = hashlib.sha256(b"").hexdigest()


def rows_by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ---- 1 fingerprints

def edited(docs):
    ids = sorted(docs, reverse=True)
    out = {}
    for k, i in enumerate(ids):
        t, nxt = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        out[i] = (t[:len(t) - half] + nxt[:half], nxt)
    return out


def test_fingerprints_estimate_resemblance(spark, texts, make_docs):
    got = {r.doc_id: r for r in fingerprint.fingerprints(make_docs(list(texts.items()))).collect()}
    err = []
    for i, (e, nxt) in edited(texts).items():
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = brute.shingles(texts[i]), brute.shingles(e), brute.shingles(nxt)
        err += [abs(brute.jaccard(a, b) - r.near_edited), abs(brute.jaccard(a, c) - r.near_next)]
        if len(a) < fingerprint.K:
            assert r.shingles_est == len(a)
            if len(b) < fingerprint.K:
                assert r.near_edited == pytest.approx(brute.jaccard(a, b))
    assert max(err) < 0.2 and sum(err) / len(err) < 0.03
    prints = defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in prints.values())


def test_fingerprints_of_edge_rows(make_docs):
    got = fingerprint.fingerprints(make_docs(EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == "" and by[1].n_chars == 0 and by[1].near_edited == 1.0
    assert by[5].fingerprint and by[6].fingerprint == by[7].fingerprint
    one = fingerprint.fingerprints(make_docs([(5, "a b c d e f g h")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c d a b c d").hexdigest() and one.near_next == 1.0
    assert fingerprint.fingerprints(make_docs([])).count() == 0


def test_sketches_merge(spark):
    whole = " ".join(f"v{i}" for i in range(900))
    w = whole.split()
    parts = [(0, " ".join(w[a:a + 104])) for a in range(0, 900, 100)]  # overlapping by four words: all shingles
    df = spark.createDataFrame(parts + [(1, whole)], "k int, text string").select(
        "k", fingerprint.sketch(F.col("text")).alias("s"))
    got = {r.k: r.sketch for r in fingerprint.merge_sketches(df, "k", "s").collect()}
    assert got[0] == got[1] and len(got[0]) == fingerprint.K


# ---- 2 secret scans

def test_secrets_equal_plain_scan(spark, texts, make_docs):
    tricky = [(100001, "secret=token:abcdefgh token = 'abc-123456' API_KEY:\"zzzzzz\""), (100002, "AKIAAKIA" + "A" * 17),
              (100003, "0" * 23 + "g" + "a1" * 12), (100004, "paſſword=abcdefg \U0001F600 passwd=1234567")]
    docs = {**texts, **dict(tricky)}
    out = secrets.scan_versions(make_docs(list(docs.items())), scratch_path(spark, "t"))
    got = {r.path.doc_id: r for r in out.collect()}
    for i, t in docs.items():
        want = brute.secret_spans(t)
        assert got[i].spans == want
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [
            sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")]


def test_ledger_scans_only_unseen_pairs(spark, make_docs):
    path = scratch_path(spark, "t")
    first = make_docs([(1, "secret: abcdef1"), (2, "clean"), (3, "clean")])
    secrets.scan_versions(first, path)
    assert secrets.read_ledger(spark, path).count() == 2 * len(secrets.BASE_RULES)
    grown = make_docs([(1, "secret: abcdef1"), (1, "secret: other99"), (2, "clean")])
    found = secrets.scan_versions(grown, path).collect()
    assert secrets.read_ledger(spark, path).count() == 3 * len(secrets.BASE_RULES)
    assert Counter(r.spans for r in found) == {"assign:0:15": 2, "": 1}
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{30,}"))
    secrets.update_ledger(secrets.content_address(grown), path, newer)
    assert secrets.read_ledger(spark, path).filter("kind = 'hex' AND rule_version = 2").count() == 3


def test_secrets_of_edge_rows(spark, make_docs):
    out = secrets.scan_versions(make_docs(EDGES), scratch_path(spark, "t"))
    assert out.count() == len(EDGES) and out.filter("spans <> ''").count() == 0
    assert secrets.scan_versions(make_docs([]), scratch_path(spark, "t")).count() == 0


# ---- 3 mixing

def mixture(rows, **targets):
    return {r.source: r for r in mixing.weights(rows, **targets).collect()}


def test_mixture_meets_entropy_and_repetition(spark):
    rows = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n_tokens bigint")
    got = mixture(rows, entropy_share=0.8, max_repeat=100.0)
    h = -sum(r.weight * np.log(r.weight) for r in got.values())
    assert h / np.log(3) == pytest.approx(0.8, abs=1e-3) and sum(r.weight for r in got.values()) == pytest.approx(1, abs=1e-6)
    limited = mixture(rows, entropy_share=1.0, max_repeat=2.0)
    assert limited["c"].budget / 10 == pytest.approx(2.0, rel=0.05) and limited["a"].passes == 1
    assert limited["a"].budget == 1000


def test_schedule_fills_the_budget(spark, make_docs):
    docs = make_docs([(i, "w " * (i % 7 + 1), "en", "big" if i % 10 else f"s{i % 30}") for i in range(600)])
    rows = mixing.counted(docs)
    planned = mixing.plan(rows, max_repeat=3.0)
    made = {r.source: r for r in planned.collect()}
    out = mixing.realised(rows, planned, mixing.block_places(rows, planned)).collect()
    played = defaultdict(int)
    for r in out:
        played[r.source] += r.n_tokens
    for s, r in made.items():
        assert r.budget <= played[s] < r.budget + 7 + 1  # the row that reaches the budget is played whole
    assert {r.id for r in out} == set(range(600))
    assert mixing.mixed(docs, max_repeat=3.0).count() == len(out)
    planned = mixing.plan(rows, budget=500)
    small = mixing.realised(rows, planned, mixing.block_places(rows, planned)).agg(F.sum("n_tokens")).first()[0]
    assert 500 <= small <= 500 + 8 * len(made)


def test_mixing_edge_rows(make_docs):
    docs = make_docs([*EDGES, (13, "a b c", "en", None), (14, None, "en", None)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mixed(make_docs([])).count() == 0
    assert mixing.mixed(make_docs([(1, None), (2, "")])).count() == 2


# ---- 4 repeats

def removed(docs):
    raw, runs = brute.repeated_runs([t for _, t in docs])
    out = Counter()
    for (i, _), b, own in zip(docs, raw, runs):
        kept, last = b"", 0
        for x, y in own:
            kept, last = kept + b[last:x], y
        out[i, len(b), sum(y - x for x, y in own), len(own), hashlib.sha256(kept + b[last:]).hexdigest()] += 1
    return out


def passage_docs():
    """Shared passages at different depths, periodic texts, edits, and non-ASCII text."""
    rng = np.random.default_rng(5)
    fresh = lambda n: "".join(rng.choice(list("abcdefgh ijkl é"), n))
    p, q = fresh(260), fresh(500)
    docs = [(i, fresh(rng.integers(0, 300)) + p + fresh(50)) for i in range(12)]
    docs += [(20 + i, q[:i * 30] + "#" + q[i * 30:]) for i in range(12)]
    docs += [(40, "ab" * 400), (41, "x" * 250), (42, fresh(100) + "x" * 230), (43, fresh(199)), (44, p[:199] + "!"),
             (45, fresh(5000)), (46, "line of text\n" * 60), (47, q + p + q)]
    return docs


@pytest.mark.parametrize("knobs", [{}, {"HOT": 12, "ENTRIES": 64, "CONTEXTS": 16, "BITS": 10}])
def test_repeats_equal_plain_removal(monkeypatch, make_docs, knobs):
    for k, v in knobs.items():
        monkeypatch.setattr(repeats, k, v)
    docs = passage_docs() + [(i, t) for i, t in EDGES if i is not None and t != LONG and t != LONG + " end"]
    got = Counter(tuple(r) for r in repeats.remove_repeats(make_docs(docs)).collect())
    assert got == removed(docs)


def test_repeats_edge_tables(make_docs):
    assert repeats.remove_repeats(make_docs([])).count() == 0
    out = repeats.remove_repeats(make_docs(EDGES)).collect()
    by = {r.doc_id: r for r in out if r.doc_id}
    assert len(out) == len(EDGES) and by[1].kept_sha256 == EMPTY and by[8].n_removed == len(LONG)


def test_interval_tree_reports_all_maximal_repeats():
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 100, n))
    core = word(230)
    contexts = [word(4) + core[:200 + int(k)] + word(6) for k in rng.integers(0, 30, 9)]
    got = set()
    for depth, members in repeats.maximal_repeats(contexts):
        text = contexts[members[0][0]][members[0][1]:members[0][1] + depth]
        assert {(c, s) for c, s in members.tolist()} == {
            (c, m.start()) for c, raw in enumerate(contexts) for m in re.finditer(b"(?=" + re.escape(text) + b")", raw)}
        got.add(text)
    every = Counter(raw[i:j] for raw in contexts for i in range(len(raw)) for j in range(i + 200, len(raw) + 1))
    for text, n in every.items():
        if n > 1:
            assert any(text in g for g in got)


def test_repeat_groups_list_all_occurrences(make_docs):
    docs = dict(passage_docs()[:12])
    keys = {repeats.keyed(make_docs([(i, t)])).first().key: i for i, t in docs.items()}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(make_docs(list(docs.items()))).collect():
        i = keys[bytes(r.key)]
        groups[docs[i].encode()[r.start:r.start + r.length]].add(i)
    assert groups and any(len(v) == 12 for v in groups.values())


# ---- 5 top-k

@pytest.mark.parametrize("knobs", [{}, {"SHARD": 7, "TILE": 2, "SHARDS_PER_CELL": 2, "TILES_PER_CELL": 2}])
def test_topk_equals_full_sort(spark, monkeypatch, knobs):
    for k, v in knobs.items():
        monkeypatch.setattr(topk, k, v)
    rng = np.random.default_rng(1)
    data = {i: [float(x) for x in rng.integers(-3, 3, 4) / 8] for i in range(90)}
    rows = [(i, v) for i, v in data.items()] + [(200, None), (220, [1.0, float("nan"), 0.0, 0.0]), (240, [1.0, None, 0.0, 0.0]),
                                                 (None, [1.0] * 4), (260, [1.0, 2.0]), (261, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(0))
    v = topk.usable(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in topk.top_k(v.filter("id % 20 = 0"), v, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    whole = {i: np.floor(64 * np.array(x)).astype(int) for i, x in data.items()}
    for q in range(0, 90, 20):
        want = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5]
        assert got[q] == [(-s, c) for s, c in want]
    assert got[260] == [(64 * 64 * 3 + 2 * 64 * 64, 261)] and set(got) == {0, 20, 40, 60, 80, 260}
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_topk_large_components_stay_exact():
    q, m = np.array([[2 ** 40, 3]], dtype=np.int64), np.array([[2 ** 20, 1], [2 ** 20, 2], [2 ** 20, 2]], dtype=np.int64)
    _, c, s = topk.best(q, np.array([0]), m, np.array([1, 2, 3]), 2)
    assert sorted(zip((-s).tolist(), c.tolist())) == [(-(2 ** 60 + 6), 1), (-(2 ** 60 + 6), 2)]


# ---- 6 Jaccard join

def near_docs():
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(80)]
    docs = {}
    for i in range(30):  # a group of near copies
        w = list(base)
        for j in rng.integers(0, 80, i % 4):
            w[j] = f"e{i}_{j}"
        docs[i] = " ".join(w)
    for i in range(30, 60):  # texts that share a passage but differ
        docs[i] = " ".join(base[:30] + [f"d{i}_{k}" for k in range(40)])
    for i in range(60, 75):  # a chain: neighbours link, the ends do not
        docs[i] = " ".join(f"c{k}" for k in range((i - 60) * 6, (i - 60) * 6 + 60))
    docs |= {80: "one two", 81: "One  TWO", 82: "", 83: None, 84: "a b c d e", 85: "a b c d e f", 86: "a b c d"}
    return docs


@pytest.mark.parametrize("knobs", [{}, {"GROUP": 4, "LEADERS": 2, "FREQUENT": 20, "QUERIES": 2, "ENTRIES": 16},
                                   {"FREQUENT": 0, "BLOOM_BITS": 64}])
def test_jaccard_components_equal_all_pairs(monkeypatch, make_docs, knobs):
    for k, v in knobs.items():
        monkeypatch.setattr(jaccard, k, v)
    docs = near_docs()
    got = rows_by_id(jaccard.jaccard_components(make_docs(list(docs.items()))), "n_shingles", "component_id")
    assert got == brute.components(docs)


def test_jaccard_edge_rows(make_docs):
    out = jaccard.jaccard_components(make_docs(EDGES)).collect()
    assert len(out) == len(EDGES)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[7].component_id == 6 and by[9].component_id == 8 and by[1].component_id == 1 and by[1].n_shingles == 0
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard.jaccard_components(make_docs([])).count() == 0


def test_group_union_turns_queries_away():
    group = jaccard.TokenGroup([np.array([1, 2, 3, 4], np.uint64), np.array([3, 4, 5], np.uint64)])
    assert group.overlaps(np.array([1, 7, 8, 9], np.uint64)) is None
    assert group.overlaps(np.array([1, 3, 4, 9], np.uint64)).tolist() == [3, 2]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 50)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(7, 30)} == {7}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 7 packing

def check_packing(docs, pieces):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[i] += len(ids)
    have, lengths = Counter(), defaultdict(list)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in docs if i is not None}
    for p in pieces:
        have[p.doc_id] += p.length
        lengths[p.sequence_id].append((p.offset, p.length))
        if p.doc_id is not None:
            own = ids[p.doc_id]
            assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
    assert have == want
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert sorted(lengths) == list(range(len(lengths)))


def test_packing_round_trip(spark, make_docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 5000)
    docs = list(texts.items())[:60]
    made = make_docs([(i, t, "en", f"s{i % 3}") for i, t in docs]).repartition(3)
    check_packing(docs, packing.packed(made).collect())


def test_packing_edge_rows(make_docs):
    check_packing(EDGES, packing.packed(make_docs(EDGES)).collect())
    spaces = [(1, "a  b\n\nc \n d e\tf"), (2, " lead"), (3, "trail "), (4, "\n"), (5, "it's  x.\n\"Q\", z.,. y,."),
              (6, "a<|endoftext|>b x. y"), (7, "x 　y")]
    check_packing(spaces, packing.packed(make_docs(spaces)).collect())
    assert packing.packed(make_docs([])).count() == 0


def test_round_robin_keeps_proportions_and_carries_deficits():
    lengths = [700] * 30 + [300] * 30
    sources = ["a"] * 30 + ["b"] * 30
    share = {"a": 0.7, "b": 0.3}
    got = defaultdict(Counter)
    for doc, _, n, sequence, _ in packing.pack_run(sources, lengths, share, {}, 100):
        got[sequence][sources[doc]] += n
    full = [c for c in got.values() if sum(c.values()) == 100]
    assert len(full) == 300 and all(abs(c["a"] - 70) <= 1 for c in full)
    first = next(packing.pack_run(["a", "b"], [500, 500], {"a": 0.5, "b": 0.5}, {"a": 20.0, "b": -20.0}, 100))
    assert first[2] == 70


# ---- 8 fixity

def pages(spark, n=3000):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i * 7}</p>" * (i % 5)) for i in range(n)],
                                 "page_id bigint, url string, html string")


def test_audit_descends_to_the_damage(spark):
    a = fixity.records(pages(spark))
    b = fixity.records(pages(spark).withColumn("html", F.when(F.col("page_id").isin(5, 2047, 2999), F.lit("!"))
                                               .otherwise(F.col("html"))))
    bad, opened = fixity.audit(common.staged(a, "a"), common.staged(b, "b"))
    status = {(r.file, r.pos) for r in bad.collect()}
    assert {(0, 5), (1, 1023), (2, 951)} <= status
    assert opened[0] == 1
    same, opened = fixity.audit(a, a)
    assert same.count() == 0 and opened == [0]


def test_audit_reports_missing_and_additional(spark):
    whole, part = pages(spark, 40), pages(spark, 40).filter("page_id < 30")
    got = Counter(r.status for r in fixity.audit_report(fixity.records(whole), fixity.records(part)).collect())
    assert got == {"intact": 30, "missing": 10}
    got = Counter(r.status for r in fixity.audit_report(fixity.records(part), fixity.records(whole)).collect())
    assert got == {"intact": 30, "additional": 10}
    none = fixity.records(whole.limit(0))
    assert Counter(r.status for r in fixity.audit_report(fixity.records(whole), none).collect()) == {"missing": 40}
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "x"), (None, "u", "x")],
                                "page_id bigint, url string, html string").withColumn("file", F.lit(3))
    assert fixity.audit_report(fixity.records(odd), fixity.records(odd)).filter("status = 'intact'").count() == 4
    assert fixity.audit_report(none, none).count() == 0


# ---- 9 language ID

SEEDS = {"en": "the and of that with this from have which been", "de": "und der die das nicht mit auch sich eine werden",
         "fr": "les des est dans pour que une sur avec elle", "es": "los las por para con una que del como pero",
         "it": "gli della che non sono una per anche questo nella", "nl": "het een van dat niet zijn voor met aan ook"}


def language_docs():
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(SEEDS[lang].split(), 12)), lang)
            for i, lang in enumerate(list(SEEDS) * 40)]


def test_language_held_out_accuracy(make_docs):
    rows = language_docs()
    got = {r.id: r for r in language.identify(make_docs(rows)).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == ((i, lang) in held) for i, _, lang in rows)
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_learns_nothing_from_held_out_rows(make_docs):
    rows = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang)) for i, t, lang in language_docs()]
    assert "xx" not in {r.lang_pred for r in language.identify(make_docs(rows)).collect()}


def test_language_edge_rows(make_docs):
    rows = [*language_docs(), (1001, None), (1002, ""), (1003, "123 !!"), (1004, "und", None), (None, "the and of"),
            (1005, "the\0and of that")]
    got = {r.id: r for r in language.identify(make_docs(rows)).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1001, 1002, 1003))
    assert got[1004].lang_pred in SEEDS and got[None].held_out is False and got[1005].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}
    single = language.identify(make_docs([(i, "abc def", "en") for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("en", 1.0)}
    assert language.identify(make_docs([])).count() == 0


def test_prediction_does_not_depend_on_the_batch():
    model = language.LanguageModel(["a", "b"], language.codewords(2), np.random.default_rng(0).normal(
        size=(language.WIDTH, 1)).astype(np.float32), np.ones(1))
    texts = ["De.", "x", "", "une phrase  assez longue", "!!", "Re."]
    assert np.allclose(model.margins(texts), np.concatenate([model.margins([t]) for t in texts]), atol=1e-5)


# ---- 10 token counts

def test_token_counts_equal_the_library(make_docs, texts):
    tok, _ = tokens.tokenizer(tokens.vocabulary_path(tokens.WORD_VOCABULARY))
    docs = list(texts.items())[:80] + [(i, t) for i, t in EDGES if i and t != LONG] + [
        (500, "x" * 3000 + " tail " + "y" * 900), (501, "nospace" * 700), (502, "a b\tc\x1cd <|startoftext|>e " * 300)]
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in docs}
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (600, 8)):
        out = tokens.token_counts(make_docs(docs), chunk=chunk, overlap=overlap).collect()
        assert len(out) == len(docs)
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert tokens.token_counts(make_docs([])).count() == 0


def test_chunks_splice_huge_texts(make_docs):
    tok, _ = tokens.tokenizer(tokens.vocabulary_path(tokens.WORD_VOCABULARY))
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(make_docs([(8, LONG), (9, LONG + " end"), (8, LONG)])).collect()}
    assert got[8] == len(tok.encode(LONG, add_special_tokens=False).ids) == got[9] - 1
