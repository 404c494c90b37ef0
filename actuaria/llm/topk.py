"""Exact top-k search by tiled matrix products (operator 5).

Candidates are packed into shards of at most ``SHARD`` vectors and queries into
tiles of at most ``TILE``, which are dealt over the rows and columns of a grid;
each cell of the grid meets its shards with its tiles, block by block, as matrix
products, and keeps the k best candidates of each query: of the first block by a
partial selection, of the others by a threshold, the k-th best score so far.
The lists of the cells are merged as a tree: from more than ``MERGE`` rows of
cells on, first within groups of rows (a ranked window keeps k rows per query and
group), then across the groups, so that the last merge of a query sees ``MERGE``
lists whatever the number of shards.  A stated query set in blocks against all
rows is the feature here: the work is queries x rows, spread over the cells.

Both sides go to the cells by a shuffle.  They are copied for every column or row
of the grid, which no estimate of their size knows of, so they are never broadcast.

Exactness: components are floor(64 x) as integers; products run in float32 when
every partial sum is below 2^24, in float64 when it is below 2^53, and in 64-bit
integers otherwise; blocks hold the narrowest integers that fit.  Equal scores
go to the smaller id, in the partial selection and in the merges.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, on either side; a null id takes no part; vectors of different length are
not compared; rows that share a query's id are not its candidates, and repeated
ids are listed as often as they occur; fewer than k candidates: all of them; an
empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actuaria.llm.common import read, staged

SHARD, TILE, MERGE = 4096, 512, 64
#: Blocks per cell of the grid, on average; fewer shards where the grid would have fewer cells than ``CELLS`` for each core.
SHARDS_PER_CELL, TILES_PER_CELL, CELLS = 32, 64, 4
#: Bytes of a block's 64-bit components.
BLOCK_BYTES = 1 << 24
PACKED = "dim int, block string, ids binary, matrix binary"
FOUND = "query_id bigint, at int, vec_id bigint, score bigint"


def usable(rows: DataFrame, id: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component as 64-bit integers; unusable vectors dropped."""
    x = F.col("x")
    broken = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.select(rows[id].cast("long").alias("id"), rows[vector].cast("array<double>").alias("x"))
            .filter(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(broken, F.lit(True)))
            .select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")))


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them all."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def pack(vectors: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` vectors of one length: ids and matrix as bytes.

    Blocks are packed where the rows lie, a task's batches at a time; a block is
    named by its smallest id and a digest, so that its name does not depend on the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}  # by length: parts of (ids, matrix), and their rows

        def block(dim: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            name = f"{ids[0]}-{ids[-1]}-{zlib.crc32(matrix.tobytes() + ids.tobytes()):08x}"
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([name]), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([narrow(matrix).tobytes()], pa.binary())], names=["dim", "block", "ids", "matrix"])

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            limit = max(1, min(most, BLOCK_BYTES // max(8 * dim, 1)))
            if sum(len(i) for i, _ in open_[dim]) >= min(limit, least):
                ids, matrix = (np.concatenate(x) for x in zip(*open_[dim]))
                whole = len(ids) if least == 1 else len(ids) // limit * limit
                for at in range(0, whole, limit):
                    yield block(dim, ids[at:min(at + limit, whole)], matrix[at:min(at + limit, whole)])
                open_[dim] = [(ids[whole:], matrix[whole:])] if whole < len(ids) else []

        for batch in batches:
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            size = v.value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                own = v.filter(pa.array(size == dim))
                open_.setdefault(dim, []).append((ids[size == dim], own.flatten().to_numpy().reshape(len(own), dim)))
                yield from blocks(dim, most)
        for dim in open_:
            yield from blocks(dim, 1)

    return vectors.mapInArrow(run, PACKED)


def products(queries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """All scores, in a type that holds them exactly, and what none of them exceeds."""
    most = lambda x: float(max(-int(x.min(initial=0)), int(x.max(initial=0))))
    peak = most(queries) * most(matrix) * matrix.shape[1]
    kind = np.float32 if peak < 2.0 ** 24 else np.float64 if peak < 2.0 ** 53 else np.int64
    return queries.astype(kind) @ matrix.astype(kind).T, peak


def best(queries: np.ndarray, q_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's k best candidates; ``ids`` ascend."""
    return _best(*products(queries, matrix), q_ids, ids, k)


def _best(score: np.ndarray, peak: float, q_ids: np.ndarray, ids: np.ndarray, k: int):
    own = ids[None, :] == q_ids[:, None]
    m = score.shape[1]
    take = min(k, m)
    if peak * m < 2.0 ** 62:
        # an earlier row has the smaller id: it wins ties; the query's own rows go last
        kind = np.int32 if (peak + 1) * m < 2.0 ** 31 - 1 else np.int64
        key = score.astype(kind)
        key *= kind(m)
        key += np.arange(m - 1, -1, -1, dtype=kind)
        key[own] = np.iinfo(kind).min
        key.partition(m - take, axis=1)
        top = key[:, m - take:].ravel().astype(np.int64)
        real = top > np.iinfo(kind).min
        top = top[real]
        return np.repeat(np.arange(len(score)), take)[real], m - 1 - top % m, top // m
    # scores too large to carry the tie in one integer
    score = score.astype(np.int64)
    part = np.argsort(-score, axis=1, kind="stable")
    order = np.take_along_axis(own, part, axis=1)
    part = np.take_along_axis(part, np.argsort(order, axis=1, kind="stable"), axis=1)[:, :take]
    q, c = np.repeat(np.arange(len(score)), take), part.ravel()
    real = ~own[q, c]
    return q[real], c[real], score[q, c][real]


def _first(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query, in order, and their rank from 0."""
    order = np.lexsort((ids, ~score, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    kept = rank < k
    return q[kept], ids[order][kept], score[order][kept], rank[kept]


def best_of_all(queries: np.ndarray, q_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate id, score) of each query's k best candidates, ``SHARD`` candidates at a time; ``ids`` ascend.

    After the first block only scores above the k-th best so far count: an equal one has no smaller id."""
    found: list[tuple] = []
    least, n_blocks = None, 0
    for at in range(0, len(ids), SHARD):
        own_ids = ids[at:at + SHARD]
        score, peak = products(queries, matrix[at:at + SHARD])
        hit = None
        if least is not None:
            over = score > np.where(least[1], least[0].astype(score.dtype), score.dtype.type(-np.inf) if score.dtype.kind == "f"
                                    else np.iinfo(score.dtype).min)[:, None]
            if np.count_nonzero(over) <= max(4 * k * len(queries), over.size >> 6):
                q, c = np.nonzero(over)
                real = own_ids[c] != q_ids[q]
                q, c = q[real], c[real]
                hit = q, c, score[q, c].astype(np.int64)
        q, c, s = hit or _best(score, peak, q_ids, own_ids, k)
        found.append((q, own_ids[c], s))
        n_blocks += 1
        if n_blocks & n_blocks - 1 == 0:  # the threshold rises after 1, 2, 4, ... blocks
            q, i, s, rank = _first(*(np.concatenate(x) for x in zip(*found)), k)
            found, last = [(q, i, s)], rank == k - 1
            least = np.zeros(len(queries), np.int64), np.zeros(len(queries), bool)
            least[0][q[last]], least[1][q[last]] = s[last], True
    return _first(*(np.concatenate(x) for x in zip(*found)), k)[:3]


def _loaded(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of all blocks, by ascending id."""
    parts = []
    for r in blocks.to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        size = len(r["matrix"]) // max(len(ids) * r["dim"], 1) or 8
        parts.append((ids, np.frombuffer(r["matrix"], f"i{size}").reshape(len(ids), r["dim"])))
    ids, matrix = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def _search(k: int):
    names = ["query_id", "at", "vec_id", "score"]

    def run(shards: pa.Table, tiles: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=names)]
        if shards.num_rows and tiles.num_rows:
            at = shards.column("row")[0].as_py()
            (ids, matrix), (q_ids, queries) = _loaded(shards), _loaded(tiles)
            for a in range(0, len(q_ids), TILE):
                own = q_ids[a:a + TILE]
                q, c, s = best_of_all(queries[a:a + TILE], own, matrix, ids, k)
                out.append(pa.table([pa.array(own[q]), pa.array(np.full(len(q), at, np.int32)), pa.array(c), pa.array(s)], names=names))
        return pa.concat_tables(out)
    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all candidates; both sides (id, v)."""
    shards = staged(pack(candidates, SHARD), "shards")
    tiles = staged(pack(queries, TILE), "tiles")
    # a grid of cells: a shard lies in one row of cells and a tile in one column, so a cell
    # holds a bounded number of each, and every tile meets every shard of its length once
    n_shards = shards.count()
    n_cols = -(-tiles.count() // TILES_PER_CELL) or 1
    least = -(-CELLS * shards.sparkSession.sparkContext.defaultParallelism // n_cols)
    n_rows = max(-(-n_shards // SHARDS_PER_CELL), min(n_shards, least)) or 1

    def dealt(blocks: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return blocks.select("dim", "ids", "matrix", F.pmod(F.xxhash64("block"), F.lit(n_own)).cast("int").alias(own),
                             F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    cell = ["dim", "row", "col"]
    found = (dealt(shards, "row", n_rows, "col", n_cols).groupBy(*cell)
             .cogroup(dealt(tiles, "col", n_cols, "row", n_rows).groupBy(*cell)).applyInArrow(_search(k), FOUND))
    order = [F.col("score").desc(), F.col("vec_id")]
    if n_rows > MERGE:
        found = (found.withColumn("part", F.pmod("at", F.lit(MERGE)))
                 .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
                 .filter(F.col("rank") <= k).drop("rank"))
    return (found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: ids divisible by 20 of ``embeddings`` against the whole table."""
    vectors = usable(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return top_k(vectors.filter(F.col("id") % 20 == 0), vectors)


NEAREST_SQL = """
WITH t AS (
 SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM t),
s AS (
 SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
 FROM c a JOIN c b ON a.d = b.d AND a.vec_id <> b.vec_id
 WHERE a.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
