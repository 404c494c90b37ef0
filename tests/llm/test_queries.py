"""Every registered training-data query runs on the small tables, equals its DuckDB twin where it has one, and
has the columns of its contract; the pipeline equals a plain run of its stages' rules."""
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from actuaria.llm import catalog, common, jaccard, repeats

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5": ["query_id", "rank", "vec_id", "score"],
    "op6": ["doc_id", "n_shingles", "component_id"],
    "op7": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9": ["doc_id", "held_out", "lang_pred", "score"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    fixed = COLUMNS.get(name.split("_")[0], [])
    assert df.columns[:len(fixed)] == fixed
    if name in catalog.ORACLE:
        cur = con.execute(catalog.ORACLE[name])
        cols = [d[0] for d in cur.description]
        order = lambda names, found: Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in found)
        assert sorted(df.columns) == sorted(cols)
        assert order(df.columns, rows) == order(cols, cur.fetchall())


def test_pipeline_stages(spark):
    docs = common.read(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.staged(stage(spark, docs, SF), "test-stage")
        kept.append(name)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "n-gram Jaccard join":
            found = brute.components({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in found.items() if c == i}
        elif name == "secret scans":
            for i, r in before.items():
                spans = brute.secret_spans(r.text)
                text = r.text
                for s in filter(None, spans.split(",")):
                    _, a, b = s.split(":")
                    text = text[:int(a)] + "*" * (int(b) - int(a)) + text[int(b):]
                assert after[i].text == text
        elif name == "mixing":
            assert set(after) == set(before)
        else:
            assert all(any(map(str.isalpha, r.text)) for r in after.values())
    assert kept == ["language ID", "n-gram Jaccard join", "secret scans", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_an_empty_table(spark):
    docs = common.read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0


def test_stages_on_null_ids_repeated_rows_and_clashing_names(spark, make_docs):
    """Extra columns that are named like inner ones keep their values through every filtering stage."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:59] + ["other"])
    rows = [(1, " ".join(words)), (2, near), (2, near), (3, "plain text with a few words of its own here"),
            (3, "plain text with a few words of its own here"), (4, None), (4, None), (5, ""), (None, "no id, password: abcdefgh12"),
            (None, "no id, password: abcdefgh12"), (None, "no id, another text"), (6, "token=abcdef123456 and the rest of it"),
            (7, "123 456 !!")]
    docs = make_docs(rows)
    inner = ("id", "key", "blob", "spans", "range", "node", "component")
    _, identify = corpus_pipeline.STAGES[0]
    kept = identify(spark, docs, SF)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert not {4, 5, 7} & {i for i, _ in found} and found[2, near] == 2 and found[None, "no id, another text"] == 1
    _, dedup = corpus_pipeline.STAGES[1]
    kept = dedup(spark, docs, SF)
    assert kept.columns == docs.columns and all(r[c] == "x" for r in kept.collect() for c in inner)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        {(1, rows[0][1]), (3, rows[3][1]), (4, None), (5, ""), (None, rows[8][1]), (None, rows[10][1]), (6, rows[11][1]),
         (7, "123 456 !!")})
    _, mask = corpus_pipeline.STAGES[2]
    kept = mask(spark, docs, SF)
    assert kept.columns == docs.columns and all(r[c] == "x" for r in kept.collect() for c in inner)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        (i, t if t is None else t.replace("password: abcdefgh12", "*" * 20).replace("token=abcdef123456", "*" * 18))
        for i, t in rows)


@pytest.mark.parametrize("module", [jaccard, repeats])
def test_ranges_are_even_where_the_least_hashes_are_chosen(module):
    import numpy as np
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.uint64))[:20_000]  # the low end only
    n = np.bincount(module.rolling.spread(h, 64), minlength=64)
    assert len(n) == 64 and n.max() < 1.5 * n.mean() and n.min() > 0
