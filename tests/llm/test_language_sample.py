"""The sample keeps rows of every language; a corpus without labels passes the pipeline."""
import corpus_pipeline
from actuaria.llm import language

SEEDS = {"en": "the and of that with this from have", "de": "und der die das nicht mit auch sich",
         "xx": "qoz vuk wix jaz pum zog hek lorv"}


def test_rare_language_is_learned(spark):
    rows = [(i, " ".join(SEEDS["en" if i % 2 else "de"].split() * 2), "en" if i % 2 else "de") for i in range(4000)]
    rows += [(10_000 + i, " ".join(SEEDS["xx"].split() * 2), "xx") for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "id bigint, text string, lang string"), sample_rows=100)
    assert sorted(model.languages) == ["de", "en", "xx"]
    assert model.predict([SEEDS["xx"]])[0][0] == "xx"
    assert language.equal_part({"a": 100, "b": 10 ** 6}, 20_000) == 19_900


def test_no_labels_keep_the_corpus(spark, make_docs):
    docs = make_docs([(1, "some words", None), (2, "123 !!", None), (3, "other words", None)])
    assert {r.doc_id for r in corpus_pipeline.identify(spark, docs, "").collect()} == {1, 3}


def test_decoding_equals_a_plain_decoder():
    """The nearest codeword under the weighted logistic loss, one bit at a time; ties go to the first language."""
    import math

    import numpy as np
    rng = np.random.default_rng(3)
    code = language.codewords(6)
    model = language.LanguageModel([f"l{i}" for i in range(6)], code, np.zeros((1, code.shape[1]), np.float32),
                                   rng.random(code.shape[1]))
    margins = np.concatenate([rng.normal(0, 3, (200, code.shape[1])), np.zeros((1, code.shape[1]))])
    best, share = model.decode(margins)
    for i, row in enumerate(margins):
        loss = [sum(w * math.log1p(math.exp(-c * m)) for c, m, w in zip(word, row, model.reliability)) for word in code]
        odds = [math.exp(min(loss) - x) for x in loss]
        assert abs(share[i] - max(odds) / sum(odds)) < 1e-9
        assert loss[best[i]] <= min(loss) + 1e-9
    assert best[-1] == 0 or code.shape[1] == 0
