"""Language identification by error-correcting output codes (operator 9).

Every language gets a codeword of bits; each bit is a binary naive-Bayes
classifier over hashed byte n-grams (2 to 4) that tells the languages whose bit
is set from the others.  A text's margins, weighted by how reliable each bit is
on the training rows, are decoded to the nearest codeword under the logistic
loss; the score is that codeword's share, and a text whose two nearest
codewords are about as near is flagged.

Fitting: ``sample_rows`` (a documented bound) labelled rows, drawn by a hash of
the id, are counted in tasks; only (language, bucket) totals, bounded by the
number of languages and buckets, reach the driver.  Prediction is one narrow
pass over all texts; the model is a few MB, whatever the corpus.

Defined cases: null text or a text without a letter: ``und``, score 0; rows
with a null id or null label are not learned from; no labelled row at all:
every row ``und``; a single language: that language, score 1; repeated rows each
get a row; extra columns are ignored.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm.common import in_parts, read, release_memory

BUCKET_BITS = 15
ORDERS = (2, 3, 4)
WIDTH = len(ORDERS) << BUCKET_BITS
UNKNOWN = "und"
#: n-grams at which a text's evidence has reached half its weight.
HALF = 60.0
#: A decoded text whose nearest codeword has less than this share is ambiguous.
CLEAR = 0.6


def _letters() -> np.ndarray:
    """Byte table: ASCII other than letters becomes a space (0 stays, it ends texts)."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(1, 128):
        if not chr(b).isalpha():
            table[b] = 32
    return table


LETTERS = _letters()


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (n-grams x orders) of all texts, each text's first row
    and its number of rows."""
    # three zero bytes end each text, so that no n-gram reaches into its neighbour
    parts = [f" {t.lower()} ".replace("\0", " ").encode() + b"\0\0\0" for t in texts]
    raw = LETTERS[np.frombuffer(b"".join(parts) + b"\0\0\0", dtype=np.uint8)].astype(np.uint32)
    used = np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])  # one space for a run of them
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    kept = (np.add.reduceat((used & (raw != 0))[:at[-1]].astype(np.int64), at[:-1]) if parts
            else np.zeros(0, np.int64))
    raw = raw[used]
    four = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:])[raw[:-3] != 0]
    out = np.empty((len(four), len(ORDERS)), dtype=np.int32)
    for k, n in enumerate(ORDERS):
        gram = four >> np.uint32(8 * (4 - n))
        out[:, k] = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (k << BUCKET_BITS)
    return out, np.concatenate([[0], np.cumsum(kept)])[:-1], kept


def codewords(n: int) -> np.ndarray:
    """Codewords (n x bits) in {-1, 1}: all splits of the languages for up to
    five, else rows of a fixed random dense code of 10 log2 n bits."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.float32).T.reshape(n, -1)
    rng, bits = np.random.default_rng(7), max(10, math.ceil(10 * math.log2(n)))
    best = None
    for _ in range(50):
        code = rng.choice(np.array([1, -1], dtype=np.float32), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit must split the languages
        apart = min((int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)), default=0)
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class LanguageModel:
    """Languages, codewords, bit weights by bucket and reliability of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray = field(default=None)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Evidence of each bit: mean log-odds times a weight that grows with the text and levels off."""
        grams, first, kept = buckets(texts)
        out = np.zeros((len(texts), self.weights.shape[1]), dtype=np.float64)
        if len(grams) and out.shape[1]:
            total = self.weights[grams[:, 0]]
            for k in range(1, len(ORDERS)):
                total = total + self.weights[grams[:, k]]
            some = kept > 0
            out[some] = np.add.reduceat(total, first[some], axis=0, dtype=np.float64)
        return out / np.maximum(kept, 1)[:, None] * (HALF * kept / (kept + HALF))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword and its share, by loss-weighted decoding."""
        loss = np.zeros((len(margins), len(self.languages)))
        for c in range(len(self.languages)):
            loss[:, c] = (np.logaddexp(0, -self.code[c] * margins) * self.reliability).sum(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), share.max(axis=1) / share.sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if not self.languages or not known:
            return lang, score
        for part in _runs(known, texts):
            best, share = self.decode(self.margins([texts[i] for i in part]))
            for i, b, s in zip(part, best, share):
                lang[i], score[i] = self.languages[b], float(s)
        return lang, score


def _runs(index: list[int], texts: list[str], size: int = 1 << 18) -> Iterator[list[int]]:
    """Runs of row numbers of about ``size`` characters."""
    run, n = [], 0
    for i in index:
        run.append(i)
        n += len(texts[i])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in in_parts(batches, 1024):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [i for i, x in enumerate(langs) if x == lang]
            for run in _runs(own, texts):
                grams, _, _ = buckets([texts[i] for i in run])
                totals[lang] = totals.get(lang, 0) + np.bincount(grams.ravel(), minlength=WIDTH)
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()),
                                          pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])


def equal_part(there: dict[str, int], sample_rows: int, least: int = 32) -> float:
    """Rows of each language in a sample, where it has as many; what small languages leave free goes to the others."""
    left, part = sample_rows, 0.0
    for k, n in enumerate(sorted(there.values())):
        part = left / (len(there) - k)
        if n > part:
            break
        left -= n
    return max(part, least)


def fit(labelled: DataFrame, sample_rows: int = 20_000) -> LanguageModel:
    """Fit on about ``sample_rows`` rows of (id, text, lang), chosen by a hash of the id, as many of each language
    as it has, up to an equal part of the sample."""
    rows = labelled.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(there.values()) > sample_rows:
        limits = F.create_map(*(F.lit(x) for lang, n in there.items()
                                for x in (lang, int((1 << 30) * min(1.0, equal_part(there, sample_rows) / n)))))
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limits[F.col("lang")])
    total = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint")
    found = total.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (np.array(found.column(c).to_pylist()) for c in ("lang", "bucket", "n"))
    languages = sorted(set(lang.tolist()))
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((WIDTH, 0), np.float32), np.zeros(0))
    counts = np.zeros((len(languages), WIDTH))
    counts[[languages.index(x) for x in lang.tolist()], bucket.astype(int)] = n
    share = np.empty_like(counts)
    for k in range(len(ORDERS)):
        part = slice(k << BUCKET_BITS, (k + 1) << BUCKET_BITS)
        smooth = counts[:, part] + 0.5
        share[:, part] = smooth / smooth.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((WIDTH, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        yes = code[:, b] > 0
        weights[:, b] = np.log(share[yes].mean(axis=0)) - np.log(share[~yes].mean(axis=0))
    model = LanguageModel(languages, code, weights / len(ORDERS), np.ones(code.shape[1]))
    if code.shape[1]:
        model.reliability = reliability(rows, model)
    return model


def reliability(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """Share of the sampled rows whose bit comes out right, scaled to 0..1 with mean 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(model.code.shape[1]), 0
        for batch in in_parts(batches, 1024):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for part in _runs(list(range(len(texts))), texts):
                truth = model.code[[model.languages.index(langs[i]) for i in part]]
                right += (model.margins([texts[i] for i in part]) * truth > 0).sum(axis=0)
                seen += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(right)), pa.int32()), pa.array(right, pa.float64()),
                                          pa.array([seen] * len(right), pa.int64())], names=["bit", "right", "seen"])

    sums = {r["bit"]: (r["right"], r["seen"]) for r in
            rows.select("lang", "text").mapInArrow(run, "bit int, right double, seen bigint")
            .groupBy("bit").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen")).collect()}
    accuracy = np.array([sums[b][0] / max(1, sums[b][1]) for b in range(model.code.shape[1])])
    weight = np.maximum(2 * accuracy - 1, 1e-3)
    return weight / weight.mean()


def classify(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (with a ``text`` column) plus lang_pred, score and ambiguous, without the text."""
    keep = [c for c in rows.columns if c != "text"]
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1024):
            lang, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array([s < CLEAR for s in score], pa.bool_())],
                names=[*keep, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


def recognised(model: LanguageModel, least: float):
    """A column function: whether a text's language is one of the model's, with a score of at least ``least``.

    Only the texts go through Python, once; the other columns of the rows stay where they are."""
    @F.arrow_udf("boolean")
    def clear(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[bool] = []
            for at in range(0, len(texts), 1024):
                lang, score = model.predict(texts.slice(at, 1024).to_pylist())
                out += [x != UNKNOWN and s >= least for x, s in zip(lang, score)]
            release_memory()
            yield pa.array(out, pa.bool_())

    return clear


def held_out(id: Column) -> Column:
    """Whether the id belongs to the fold that is never learned from (a null id is in no fold)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, and predict every row:
    id, held_out, lang_pred, score, ambiguous."""
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    model = fit(rows.filter(~held_out(F.col("id"))), sample_rows)
    return classify(rows.select("id", held_out(F.col("id")).alias("held_out"), "text"), model)


def identify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")
