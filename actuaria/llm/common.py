"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.session import scratch_path

#: ASCII white space that separates words, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seed of the 64-bit hashes, so that they agree between runs and parts.
SEED = 42


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """Scan one table with only the named columns (pruned in the reader)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it
    back: cuts the lineage, is computed once, and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give free memory back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds few texts at a time.

    What a batch, or an earlier task, has left free is released: workers outlive their tasks and share an
    executor's memory."""
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        release_memory()


def release_after(*groups: pa.Table, least: int = 1 << 20) -> None:
    """Release what the work on a group of at least ``least`` bytes has left free; small groups leave little."""
    if sum(g.nbytes for g in groups) >= least:
        release_memory()


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word of ``text`` in order (A-Z lower-cased)."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), SPACE + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of ``text``.

    Fewer than ``n`` words: the whole sequence is one shingle; no word: empty.
    The word hashes are bound once (a one-element array) so that the lambda
    over positions reads them as a variable instead of evaluating them anew.
    """
    def shingles(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(SEED).cast("long"), lambda a, x: F.xxhash64(a, x)))
        sliding = F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, n))))
        return F.when(F.size(h) >= n, sliding).when(F.size(h) > 0, whole).otherwise(
            F.array().cast("array<bigint>"))

    bound = F.transform(F.array(word_hashes(text)), lambda h: F.sort_array(F.array_distinct(shingles(h))))
    return F.get(bound, F.lit(0))
