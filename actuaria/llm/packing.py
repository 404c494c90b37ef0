"""Mixture-controlled packing by deficit round-robin (operator 7).

Documents become token ids once; blocks of about ``BLOCK`` tokens are stored as one
row (ids of the block, and where each document lies).  From the totals per source a
run of ``CHUNK`` tokens is known to take one interval of every source's running token
order: the tokens of all sources are thought in one order, spaced evenly in each source,
and a run is a stretch of that order (so it holds each source within about a token of
its share, wherever the source's documents are stored).  The pieces are shuffled to
their runs once, and each run is packed by itself: every window of ``WINDOW``
tokens gives each source its share of the corpus as credit, serves the sources'
queues in turn, and carries what a source is owed (or was served too much) to the
next window; what the runs before it owe follows from the order.  A run is a whole
number of windows; the corpus's last, partial window is cut into sequences whose
lengths are powers of two, so nothing is padded.

A run is bounded by its tokens; a document of any length is cut where a run ends.

Texts are encoded whole, by the rank table of the vocabulary; only texts with a special
string or unusual white space take the slower tokenizer.

Defined cases: a null text is empty and gives the end id alone; a null source is a
source of its own; repeated rows are packed as often as they occur; an empty table
gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actuaria.llm.common import in_parts, read, staged

WINDOW, CHUNK, BLOCK, END = 2048, 1 << 22, 1 << 20, 1
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: White space other than blank and line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Runs of white space, in texts without :data:`OTHER_SPACE`.
RUNS = ("  ", "\n\n", " \n", "\n ")
#: What the vocabulary's pattern says of the end of such a run, and of nothing else.
RUN_END = r"|\s+(?!\S)"

_encoders: dict = {}


class Encoder:
    """Ids of whole texts as bytes of 32-bit ids.

    Texts go through the rank table of the same vocabulary.  The look-ahead in its pattern only matters where white space
    characters stand side by side, and costs half the time; texts without such a place are cut by the pattern without it.
    Texts that hold a special string or unusual white space go to the tokenizer."""

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

        def by(pattern: str):
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

        self.plain, self.apart = by(public_tokenizers.PATTERN), by(public_tokenizers.PATTERN.replace(RUN_END, ""))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian 32-bit numbers."""
        if any(s in text for s in self.special) or OTHER_SPACE.search(text):
            found = self.whole(text)
        else:
            found = (self.plain if any(s in text for s in RUNS) else self.apart)(text)
        return struct.pack(f"<{len(found)}I", *found)


def encoder(vocabulary: str, ranks: str) -> Encoder:
    key = (vocabulary, ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, ranks)
    return _encoders[key]


BLOCKS = ("part int, number int, doc_id array<{id}>, source array<string>, length array<bigint>, ids binary, "
          "total bigint, before_source array<string>, before_tokens array<bigint>")


def sequences_of(total: int) -> int:
    """Full windows, and one sequence for each power of two in the rest."""
    return total // WINDOW + (total % WINDOW).bit_count()


def _tokenise(vocabulary: str, ranks: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, ranks), TaskContext.get().partitionId()
        end, number = np.array([END], dtype="<u4").tobytes(), 0
        served: dict[str, int] = {}
        docs: list = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, size, number
            row = {"part": part, "number": number, "doc_id": [d[0] for d in docs], "source": [d[1] for d in docs],
                   "length": [len(d[2]) // 4 for d in docs], "ids": b"".join(d[2] for d in docs), "total": size,
                   "before_source": list(served), "before_tokens": list(served.values())}
            for d in docs:
                served[d[1]] = served.get(d[1], 0) + len(d[2]) // 4
            number += 1
            if np.frombuffer(row["ids"], "<u4").max() < 1 << 16:
                row["ids"] = np.frombuffer(row["ids"], "<u4").astype("<u2").tobytes()
            docs, size = [], 0
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("number", pa.int32()), ("doc_id", pa.list_(id_type)),
                ("source", pa.list_(pa.string())), ("length", longs), ("ids", pa.binary()), ("total", pa.int64()),
                ("before_source", pa.list_(pa.string())), ("before_tokens", longs)]))

        for batch in in_parts(batches):
            for i, s, t in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(),
                               batch.column("text")):
                ids = enc.ids(t.as_py()) + end
                if docs and size + len(ids) // 4 > BLOCK:
                    yield close()
                docs.append((i, s, ids))
                size += len(ids) // 4
        if docs:
            yield close()
    return run


class Queue:
    """Documents of one source in a run: (number, first token, length) in order."""

    def __init__(self):
        self.docs, self.left = deque(), 0

    def put(self, number: int, length: int) -> None:
        self.docs.append([number, 0, length])
        self.left += length

    def take(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Pieces (document, start, length) of the next ``n`` tokens."""
        self.left -= n
        while n:
            head = self.docs[0]
            got = min(n, head[2] - head[1])
            yield head[0], head[1], got
            head[1] += got
            n -= got
            if head[1] == head[2]:
                self.docs.popleft()


def round_robin(queues: dict[str, Queue], share: dict[str, float], owed: dict[str, float], room: int) -> dict[str, int]:
    """Tokens that each source gives to a window of ``room`` (which the queues can fill).

    Each source is credited its share; whole credits are served in turn.  What is then left (credits
    below one token, queues that ran dry) goes to the sources in the order of what they are owed."""
    for s in queues:
        owed[s] += share[s] * room
    quota = dict.fromkeys(queues, 0)
    left = room
    for s in queues:
        n = min(max(int(owed[s]), 0), queues[s].left, left)
        quota[s], left = n, left - n
    while left:
        ready = sorted((s for s in queues if queues[s].left > quota[s]), key=lambda s: quota[s] - owed[s])
        unit = sum(share[s] for s in ready) or 1.0
        part = left
        for s in ready:
            n = min(max(1, int(part * share[s] / unit)), queues[s].left - quota[s], left)
            quota[s], left = quota[s] + n, left - n
    for s in queues:
        owed[s] -= quota[s]
    return quota


def pack_run(sources: list[str], lengths: list[int], share: dict[str, float], owed: dict[str, float],
             window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one run."""
    queues: dict[str, Queue] = {s: Queue() for s in sorted(set(sources))}
    for i, (s, n) in enumerate(zip(sources, lengths)):
        queues[s].put(i, n)
    left, sequence = sum(lengths), 0
    owed = {s: owed.get(s, 0.0) for s in queues}
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        offset = 0
        for s, n in round_robin(queues, share, owed, room).items():
            for doc, start, got in queues[s].take(n):
                yield doc, start, got, sequence, offset
                offset += got
        queues = {s: q for s, q in queues.items() if q.left}
        left, sequence = left - room, sequence + 1


PIECES = ("doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, source string")


def dealt(totals: dict[str, int], first: int) -> dict[str, int]:
    """How many of the ``first`` tokens of the corpus in its dealt order are of each source.

    The k-th of a source's n tokens stands at (2 k + 1) / 2 n, ties in the order of the sources: what is
    dealt only grows with ``first``, and is each source's share to within rounding."""
    whole = sum(totals.values())
    n = {s: (2 * t * first + whole) // (2 * whole) for s, t in totals.items()}
    short = first - sum(n.values())
    if short > 0:
        heap = [(Fraction(2 * n[s] + 1, 2 * totals[s]), s) for s in totals]
        heapq.heapify(heap)
        for _ in range(short):
            s = heap[0][1]
            n[s] += 1
            heapq.heapreplace(heap, (Fraction(2 * n[s] + 1, 2 * totals[s]), s))
    elif short < 0:
        for _ in range(-short):
            n[max((Fraction(2 * n[s] - 1, 2 * totals[s]), s) for s in totals if n[s])[1]] -= 1
    return n


class Runs:
    """Which run of ``size`` tokens a token of a source is dealt to."""

    def __init__(self, totals: dict[str, int], size: int):
        self.totals, self.size, self.whole, self.known = totals, size, sum(totals.values()), {}

    def before(self, run: int) -> dict[str, int]:
        """Tokens of each source in the runs before this one."""
        if run not in self.known:
            if len(self.known) >= 1 << 12:
                self.known.clear()
            self.known[run] = dealt(self.totals, min(run * self.size, self.whole))
        return self.known[run]

    def pieces(self, source: str, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(run, start, length) of a document that begins at token ``at`` of its source."""
        run = at * self.whole // (self.totals[source] * self.size)
        start = 0
        while start < length:
            while run and self.before(run)[source] > at + start:
                run -= 1
            while self.before(run + 1)[source] <= at + start:
                run += 1
            n = min(length - start, self.before(run + 1)[source] - at - start)
            yield run, start, n
            start += n


DEALT = ("run bigint, doc_id array<{id}>, source array<string>, at array<bigint>, start array<bigint>, "
         "length array<bigint>, doc_tokens array<bigint>, ids binary")


def _deal(totals: dict[str, int], size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, longs = Runs(totals, size), pa.list_(pa.int64())
        names = ["run", "doc_id", "source", "at", "start", "length", "doc_tokens", "ids"]
        types = [pa.int64(), pa.list_(id_type), pa.list_(pa.string()), longs, longs, longs, longs, pa.binary()]
        for batch in in_parts(batches, 1):
            for row in batch.to_pylist():
                served = dict(zip(row["part_source"], row["part_tokens"]))
                for s, n in zip(row["before_source"], row["before_tokens"]):
                    served[s] += n
                ids = memoryview(row["ids"])
                width = len(ids) // row["total"]
                out: dict[int, list[list]] = {}
                first = 0
                for doc, s, length in zip(row["doc_id"], row["source"], row["length"]):
                    for number, start, n in runs.pieces(s, served[s], length):
                        piece = ids[width * (first + start):width * (first + start + n)]
                        for column, value in zip(out.setdefault(number, [[] for _ in range(7)]),
                                                 (doc, s, served[s] + start, start, n, length, piece)):
                            column.append(value)
                    served[s] += length
                    first += length
                for number, columns in out.items():
                    values = [number, *columns[:6], b"".join(columns[6])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)
    return run


def _pack(totals: dict[str, int], size: int, id_type: pa.DataType):
    whole = sum(totals.values()) or 1
    share = {s: n / whole for s, n in totals.items()}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        docs, ids = [], []
        for k, row in enumerate(table.to_pylist()):
            wide = len(row["ids"]) == 4 * sum(row["length"])
            ids.append(memoryview(np.frombuffer(row["ids"], "<u4" if wide else "<u2").astype("<u4").tobytes()))
            first = 0
            for doc, s, at, start, n, tokens in zip(*(row[c] for c in (
                    "doc_id", "source", "at", "start", "length", "doc_tokens"))):
                docs.append((s, at, n, doc, start, tokens, k, first))
                first += n
        docs.sort(key=lambda d: d[:2])
        done = number * size
        before = Runs(totals, size).before(number)
        owed = {s: n * done / whole - before[s] for s, n in totals.items()}
        out: list[list] = [[] for _ in range(8)]
        for i, start, n, sequence, offset in pack_run([d[0] for d in docs], [d[2] for d in docs], share, owed):
            s, _, _, doc, skipped, tokens, k, first = docs[i]
            at = 4 * (first + start)
            for column, value in zip(out, (doc, skipped + start, n, zlib.crc32(ids[k][at:at + 4 * n]), tokens,
                                           number * (size // WINDOW) + sequence, offset, s)):
                column.append(value)
        longs = [pa.int64()] * 6
        return pa.Table.from_arrays(
            [pa.array(v, t) for v, t in zip(out, [id_type, *longs, pa.string()])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str) -> DataFrame:
    """Pieces of all documents (doc_id, source, text) in sequences of at most ``WINDOW`` tokens."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    size = max(1, CHUNK // WINDOW) * WINDOW
    rows = docs.select(docs["doc_id"].alias("doc_id"),
                       F.when(docs["source"].isNull(), "null").otherwise(
                           F.concat(F.lit("="), docs["source"].cast("string"))).alias("source"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))
    blocks = staged(rows.mapInArrow(_tokenise(vocabulary, ranks, arrow), BLOCKS.format(id=name)), "pack-blocks")
    # totals per partition and source, and what lies before each partition
    each = blocks.select("part", F.explode(F.arrays_zip("source", "length")).alias("d")).groupBy(
        "part", F.col("d.source").alias("source")).agg(F.sum("d.length").alias("n"))
    each = staged(each, "pack-totals")
    totals = {r["source"]: r["n"] for r in each.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (each.withColumn("earlier", F.coalesce(F.sum("n").over(upto), F.lit(0)))
             .groupBy("part").agg(F.collect_list(F.struct("source", "earlier")).alias("e"))
             .select("part", F.col("e.source").alias("part_source"), F.col("e.earlier").alias("part_tokens")))
    parts = staged(parts, "pack-parts")  # small: one row per partition
    joined = blocks.join(parts, "part").select(
        "doc_id", "source", "length", "ids", "total", "before_source", "before_tokens", "part_source", "part_tokens")
    return (joined.mapInArrow(_deal(totals, size, arrow), DEALT.format(id=name)).groupBy("run")
            .applyInArrow(_pack(totals, size, arrow), PIECES.format(id=name)))


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return packed(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """:func:`pack` with the public vocabulary; ``source`` as in the documents."""
    import public_tokenizers
    pieces = pack(docs, public_tokenizers.path(vocabulary), public_tokenizers.path(ranks))
    return pieces.withColumn("source", F.when(F.col("source") != "null", F.substring("source", 2, 1 << 30)))
