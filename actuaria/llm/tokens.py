"""Token counts by overlap resynchronisation (operator 10).

Counts the tokens that a vocabulary file gives a whole text.  A text of up to
``chunk`` code points is encoded as it is.  A longer one is cut into overlapping
chunks that are rows of their own and are dealt over all tasks by (text, chunk);
each chunk is encoded with offsets, once, its joints are written, and neighbours
are spliced at a common token start inside their overlap.  Such a start is proven stable if the character
before it is ASCII white space: the vocabulary drops white space before it
splits words, so nothing left of that point can change what follows and the
reverse.  Where an overlap holds no such point, the overlaps of that text are
widened fourfold and it is encoded again, up to the whole text in one piece.

Within an Arrow batch, the words between spaces are counted once and kept in a
bounded dictionary per worker, which is sound for the same reason: tokens never
cross white space, and special strings hold none.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
each get their count (equal huge texts are encoded once); an empty table gives
an empty result; only the id and text columns are read.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm.common import in_parts, read, staged

#: Code points per chunk, first overlap on each side of a joint, and words kept per worker.
CHUNK, OVERLAP, KEPT_WORDS = 16_384, 256, 500_000
#: Chunks that a task holds as Python strings at a time.
CHUNKS_AT_ONCE = 64
WORD_VOCABULARY = "word_bpe_49k.json"

_tokenizers: dict = {}


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (installed beside Python on every node)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, one per worker."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _tokenizers[path] = (found, {"": 0})
    return _tokenizers[path]


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Token counts of short texts, word by word."""
    tok, known = tokenizer(path)
    split = [t.replace("\n", " ").split(" ") for t in texts]
    new = list(set().union(*split).difference(known)) if split else []
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        known[""] = 0
        new = list(set().union(*split).difference(known))
    known.update(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False))))
    return [sum(map(known.__getitem__, words)) for words in split]


def _batched(values: list, size: int = 1 << 20) -> Iterator[list]:
    """Runs of values of about ``size`` characters."""
    run, n = [], 0
    for v in values:
        run.append(v)
        n += len(v)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def _count_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = batch.column("text").to_pylist()
            small = [t for t in texts if t is not None]
            counts = iter([n for part in _batched(small) for n in count_texts(path, part)])
            tokens = [None if t is None else next(counts) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n_bytes", "key")), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "key", "n_tokens"])
    return run


def stable_starts(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """(offset, tokens before it) of the token starts right after ASCII white space."""
    out, last = [], -1
    for rank, s in enumerate(starts):
        if s != last and s > 0 and text[s - 1] in " \t\n\r":
            out.append((s, rank))
        last = s
    return out


CHUNK_SCHEMA = ("key string, idx int, n bigint, head_at array<bigint>, head_rank array<bigint>, "
                "tail_at array<bigint>, tail_rank array<bigint>")


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = tokenizer(path)
        for batch in in_parts(batches, CHUNKS_AT_ONCE):
            rows = []
            for r in batch.to_pylist():
                enc = tok.encode(r["slice"], add_special_tokens=False)
                starts = [(p + r["lo"], k) for p, k in stable_starts(r["slice"], [o[0] for o in enc.offsets])]
                head = [x for x in starts if x[0] < r["head_end"]]
                tail = [x for x in starts if x[0] >= r["tail_start"]]
                rows.append({"key": r["key"], "idx": r["idx"], "n": len(enc.ids),
                             "head_at": [x[0] for x in head], "head_rank": [x[1] for x in head],
                             "tail_at": [x[0] for x in tail], "tail_rank": [x[1] for x in tail]})
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("key", pa.string()), ("idx", pa.int32()), ("n", pa.int64()), ("head_at", longs),
                 ("head_rank", longs), ("tail_at", longs), ("tail_rank", longs)]))
    return run


def chunks(texts: DataFrame, chunk: int) -> DataFrame:
    """Overlapping slices of (key, text, w); one slice once the overlap reaches the text's length."""
    n = F.length("text")
    count = F.when(F.col("w") >= n, F.lit(1)).otherwise(F.ceil(n / chunk).cast("int"))
    rows = texts.withColumn("m", count).select("key", "text", "w", "m", F.explode(F.sequence(
        F.lit(0), F.col("m") - 1)).alias("idx"))
    at = F.col("idx") * chunk
    last = F.col("idx") == F.col("m") - 1
    lo = F.greatest(at - F.col("w"), F.lit(0))
    hi = F.when(last, F.length("text")).otherwise(F.least(at + chunk + F.col("w"), F.length("text")))
    return rows.select(
        "key", "idx", lo.alias("lo"), F.substring("text", lo + 1, hi - lo).alias("slice"),
        F.when(F.col("idx") == 0, F.lit(0)).otherwise(at + F.col("w")).cast("long").alias("head_end"),
        F.when(last, F.length("text") + 1).otherwise(at + chunk - F.col("w")).cast("long").alias("tail_start"))


def splice(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): the chunks' tokens between their splices; null where an overlap has no common start."""
    right = encoded.select("key", (F.col("idx") - 1).alias("idx"), F.col("head_at").alias("r_at"),
                           F.col("head_rank").alias("r_rank"), F.lit(True).alias("joined"))
    common = F.array_intersect("tail_at", "r_at")
    joints = encoded.join(right, ["key", "idx"], "left").withColumn(
        "p", F.get(common, F.floor(F.size(common) / 2).cast("int")))
    rank = lambda at, ranks: F.get(F.col(ranks), (F.array_position(at, F.col("p")) - 1).cast("int"))
    # tokens kept left of the joint, minus the tokens that the right chunk has before it
    part = (F.when(F.col("joined").isNull(), F.col("n"))
            .otherwise(rank("tail_at", "tail_rank") - rank("r_at", "r_rank")))
    return joints.groupBy("key").agg(
        F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias("n_tokens"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of the huge texts (key, text), widening overlaps until every joint is proven."""
    open_, done = texts.withColumn("w", F.lit(overlap)), None
    while True:
        dealt = chunks(open_, chunk).repartition("key", "idx")  # a text's chunks start out in one task
        encoded = staged(dealt.mapInArrow(_encode_chunks(path), CHUNK_SCHEMA), "token-chunks")
        counted = staged(splice(encoded), "token-splice")
        ready = counted.filter(F.col("n_tokens").isNotNull())
        done = ready if done is None else done.unionByName(ready)
        if counted.filter(F.col("n_tokens").isNull()).isEmpty():
            return done
        open_ = open_.join(counted.filter(F.col("n_tokens").isNull()).select("key"), "key", "left_semi").withColumn(
            "w", F.col("w") * 4)


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = WORD_VOCABULARY,
                 limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row."""
    path = vocabulary_path(vocabulary)
    rows = docs.select(docs[id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    huge = F.length("text") > chunk
    rows = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text",
                       F.when(huge, F.sha2("text", 256)).alias("key"))
    one = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first("text").alias("text"))
    huge_n = huge_counts(staged(one, "huge-texts"), path, chunk, overlap).withColumnRenamed("n_tokens", "n_huge")
    counted = (rows.withColumn("text", F.when(F.col("key").isNull(), F.col("text")))
               .mapInArrow(_count_rows(path), f"id {docs.schema[id].dataType.simpleString()}, n_bytes bigint, "
                                              "key string, n_tokens bigint"))
    # a null key joins nothing; salting it spreads the small texts over the join's partitions
    counted = counted.withColumn("at", F.coalesce("key", F.concat(F.lit("-"), F.hash("id"))))
    n = F.coalesce("n_tokens", "n_huge")
    return counted.join(huge_n.withColumnRenamed("key", "at"), "at", "left").select(
        F.col("id").alias(id), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))
