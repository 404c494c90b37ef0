"""Content-addressed store of fitted models and search results (S8) in the cluster's shared folder.

An entry's key is a digest of what it was made from: the training rows (whatever their order and partitions), the
family, its parameters and the seed.  An entry is written aside and published by one rename, so
a reader sees a whole entry or none, and of two writers of the same key either result serves (fits are
deterministic).  Each model is thus fitted once and shared by all queries and jobs that name the same folder.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.session import ensure_checkpoint_dir

FOLDER = "model-store"


def digest(rows: DataFrame) -> str:
    """Digest of a table's rows as a multiset: count, sums and exclusive-or of two row hashes, one aggregate."""
    first = F.xxhash64(*rows.columns)
    second = F.xxhash64(F.lit(1), *rows.columns)
    total = [F.sum(h.cast("decimal(20,0)")) for h in (first, second)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[t.alias(f"s{k}") for k, t in enumerate(total)],
                 F.bit_xor(first).alias("x")).first()
    return hashlib.sha256(json.dumps([rows.columns, r["n"], str(r["s0"]), str(r["s1"]), r["x"]]).encode()).hexdigest()


def key_of(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entry(spark: SparkSession, key: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{FOLDER}/{key}"


def find(spark: SparkSession, key: str) -> str | None:
    """Path of a published entry."""
    path = entry(spark, key)
    where, files = _files(spark, path)
    return path if files.exists(where) else None


def publish(spark: SparkSession, key: str, write: Callable[[str], object]) -> str:
    """Write an entry aside and move it to its place; an entry published meanwhile by another writer stays."""
    path = entry(spark, key)
    aside = f"{path}.{uuid.uuid4().hex}"
    write(aside)
    where, files = _files(spark, path)
    if not files.exists(where):
        files.rename(_files(spark, aside)[0], where)
    else:
        files.delete(_files(spark, aside)[0], True)
    return path
