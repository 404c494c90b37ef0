"""Cross-tokenizer alignment by an associative fragment monoid (operator 12).

Two vocabularies cut " " + text into tokens A and B; where a token of each ends at the same byte, a
group ends.  All token pairs of a group are linked; a pair's count is the number of documents that hold it linked.

Fragments.  A byte range of a text gives the tokens that end in it: an open prefix (up to the first
common end), closed groups, and an open suffix.  Joining the fragments of two neighbouring ranges closes at
most one group (left suffix and right prefix), and joining is associative, so the ranges of a very long
text are worked on by separate tasks and composed as a tree, ``FAN`` at a time.

Both vocabularies cut before a blank that stands between two other characters, whatever is around
it (for B: no piece holds a blank after another character, which is checked when it is loaded).  So a
range is encoded from the last such place before it to the first one after it; where the margin of a chunk
holds none, chunks and margins of that text are widened fourfold, up to the whole text.  The fragments between such
places (mostly words) are kept in a bounded dictionary per worker.

Counts.  Documents are written as blocks: the block's distinct pairs once, and per document the places and
multiplicities of its pairs.  Only the blocks' distinct pairs are shuffled to be counted.  Up to ``SHARED`` different pairs
(checked) the counts are broadcast to the blocks; beyond that each block's pairs are joined to them.  The best count per A id
is a table no larger than vocabulary A, and is broadcast.

Defined cases: texts that are null, empty, or whose joined tokens of A or B differ from " " + text have no tokens
(zeros, empty digest); special strings in texts are plain text; equal long texts are encoded once and counted as
often as they occur; null ids and repeated rows each get their result; an empty table gives an empty result; extra columns
are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from actuaria.llm.common import in_parts, read, staged
from actuaria.llm.tokens import vocabulary_path

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Code points of a chunk and of its margins, fragments composed at once, pieces kept per worker and their length,
#: pieces encoded at once, bytes of groups and documents per block, different pairs whose counts may be broadcast.
CHUNK, MARGIN, FAN, KEPT, SHORT, TOGETHER, BYTES, DOCS, SHARED = 8192, 512, 16, 200_000, 64, 512, 1 << 23, 4096, 1 << 21
#: Bits of a B id in a pair's code.
B_BITS = 15

#: A blank between two characters that are not white space: tokens of both vocabularies start there.
STABLE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that both encoders of vocabulary A split alike.
PLAIN = re.compile(r"[\x21-\x7eÀ-ɏ]+").fullmatch

_loaded: dict = {}


# ---- tokens

class Vocabularies(dict):
    """Both encoders, and the groups of pieces met lately; None where a piece's bytes differ.

    When the dictionary is full it becomes the older one, from which pieces that are met again move back."""

    def __init__(self, path_a: str, ranks_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.older: dict[str, bytes | None] = {}
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(ranks_a, "rb") as f:
            table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.plain_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                         special_tokens={}).encode_ordinary
        size = max(max(table.values()) + 1, self.a.get_vocab_size(with_added_tokens=True))
        self.bytes_a = [b""] * size
        for k, v in table.items():
            self.bytes_a[v] = k
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or len(pieces) > 1 << B_BITS:
            raise ValueError("vocabulary B holds a blank after another character, or has too many pieces")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b])

    def ids_a(self, piece: str) -> list[int]:
        return self.plain_a(" " + piece) if PLAIN(piece) else self.a.encode(" " + piece, add_special_tokens=False).ids

    def tokens(self, piece: str, b: list[int] | None = None) -> tuple[list, list, list, list] | None:
        """(A ids, their ends in bytes, B ids, their ends) of " " + piece; None where the bytes differ."""
        raw = (" " + piece).encode()
        a = self.ids_a(piece)
        b = self.b.encode(piece, num_threads=1) if b is None else b
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        parts_a, parts_b = [bytes_a[i] for i in a], [bytes_b[i] for i in b]
        if b"".join(parts_b) != raw or b"".join(parts_a) != raw:
            return None
        return a, list(accumulate(map(len, parts_a))), b, list(accumulate(map(len, parts_b)))

    def learn(self, pieces: set[str]) -> None:
        """Adds the short ones of the pieces of a part."""
        if len(self) > KEPT:
            self.older = dict(self)
            self.clear()
        missing = [p for p in pieces if p not in self and len(p) <= SHORT]
        new = []
        for p in missing:
            if p in self.older:
                self[p] = self.older[p]
            else:
                new.append(p)
        plain = [p for p in new if PLAIN(p)]
        for at in range(0, len(plain), TOGETHER):
            self._learn_together(plain[at:at + TOGETHER])
        for p in new:
            if p not in self:
                self[p] = piece_groups(self.tokens(p))

    def _learn_together(self, pieces: list[str]) -> None:
        """Pieces without white space, encoded as one text with blanks between them (stable places).

        Where B's bytes are not those of the text, nothing is added, and the pieces are looked at one by one."""
        text = " ".join(pieces)
        a, b = self.plain_a(" " + text), self.b.encode(text, num_threads=1)
        if b"".join([self.bytes_b[i] for i in b]) != b" " + text.encode():
            return
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, common, "right").tolist(), np.searchsorted(ends_b, common, "right").tolist()
        a, b = [str(i) for i in a], [str(i) for i in b]
        groups, i, j = [], 0, 0
        for x, y in zip(to_a, to_b):
            groups.append(a[i] + "|" + b[j] if x - i == y - j == 1 else ",".join(a[i:x]) + "|" + ",".join(b[j:y]))
            i, j = x, y
        size = np.cumsum([len(p.encode()) + 1 for p in pieces])
        first = 0
        for p, last in zip(pieces, np.searchsorted(common, size, "right").tolist()):
            self[p] = ";".join(groups[first:last]).encode()
            first = last

    def aligned(self, pieces: list[str]) -> bytes | None:
        """Groups of the pieces one after the other; None if one of them is not aligned."""
        got = [self[p] if p in self else piece_groups(self.tokens(p)) for p in pieces]
        return None if None in got else b";".join(got)


def vocabularies(paths: tuple[str, str, str]) -> Vocabularies:
    if paths not in _loaded:
        _loaded[paths] = Vocabularies(*paths)
    return _loaded[paths]


def group_text(a: list[int], b: list[int]) -> bytes:
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode()


_BLANKS = bytes(c if 48 <= c <= 57 else 32 for c in range(256))
#: Links of a group up to which it is written out; of larger groups equal links are counted first.
WIDE = 4096


def parsed(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups as text to (A ids per group, B ids per group, and for all links: group, pair code, how often)."""
    if not body:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    raw = np.frombuffer(body + b";", dtype=np.uint8)
    mark = raw[(raw < 48) | (raw > 57)]  # what follows each number
    value = np.fromstring(body.translate(_BLANKS).decode(), dtype=np.int64, sep=" ")
    ends = np.cumsum(mark == 59)
    group = ends - (mark == 59)  # group of each number
    in_b = (np.cumsum(mark == 124) - (mark == 124) - group).astype(bool)  # bars before it, less the groups before
    n = int(ends[-1])
    n_b = np.bincount(group[in_b], minlength=n)
    n_a = np.bincount(group, minlength=n) - n_b
    first_a = np.cumsum(n_a + n_b) - n_a - n_b
    links = n_a * n_b
    at = np.flatnonzero(links <= WIDE)
    owner = np.repeat(at, links[at])
    local = np.arange(len(owner)) - np.repeat(np.cumsum(links[at]) - links[at], links[at])
    codes = value[first_a[owner] + local // n_b[owner]] << B_BITS | value[first_a[owner] + n_a[owner] + local % n_b[owner]]
    parts = [(owner, codes, np.ones(len(owner), dtype=np.int64))]
    for g in np.flatnonzero(links > WIDE).tolist():
        x, k = np.unique(value[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        y, m = np.unique(value[first_a[g] + n_a[g]:first_a[g] + n_a[g] + n_b[g]], return_counts=True)
        parts.append((np.full(len(x) * len(y), g), (x[:, None] << B_BITS | y).ravel(), np.outer(k, m).ravel()))
    owner, codes, times = (np.concatenate(p) for p in zip(*parts))
    return n_a, n_b, owner, codes, times


# ---- the monoid

@dataclass
class Fragment:
    """Tokens that end in a byte range.  Without a common end (``closed`` false) all are in ``a`` and ``b``; else these
    hold the tokens up to the first common end, ``tail_a`` and ``tail_b`` those after the last one, ``body`` the groups between."""
    a: list[int]
    b: list[int]
    closed: bool = False
    tail_a: list[int] = ()
    tail_b: list[int] = ()
    body: bytes = b""


def _joined(*bodies: bytes) -> bytes:
    return b";".join([x for x in bodies if x])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.closed:
        return Fragment([*x.a, *y.a], [*x.b, *y.b], y.closed, y.tail_a, y.tail_b, y.body)
    a, b = [*x.tail_a, *y.a], [*x.tail_b, *y.b]
    if not y.closed:
        return Fragment(x.a, x.b, True, a, b, x.body)
    return Fragment(x.a, x.b, True, y.tail_a, y.tail_b, _joined(x.body, group_text(a, b), y.body))


def fragment(tokens: tuple[list, list, list, list], lo: int, hi: int) -> Fragment:
    """The fragment of the tokens whose ends lie in (lo, hi]."""
    a, ends_a, b, ends_b = tokens
    i, i_end = bisect_right(ends_a, lo), bisect_right(ends_a, hi)
    j, j_end = bisect_right(ends_b, lo), bisect_right(ends_b, hi)
    part = a[i:i_end], ends_a[i:i_end], b[j:j_end], ends_b[j:j_end]
    groups = list(closed_groups(part))
    if not groups:
        return Fragment(part[0], part[2])
    n_a, n_b = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
    return Fragment(*groups[0], True, part[0][n_a:], part[2][n_b:], b";".join([group_text(*g) for g in groups[1:]]))


def closed_groups(tokens: tuple[list, list, list, list]) -> Iterator[tuple[list, list]]:
    """(A ids, B ids) of the groups between common ends."""
    a, ends_a, b, ends_b = tokens
    i = j = first_a = first_b = 0
    while i < len(a) and j < len(b):
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
            yield a[first_a:i], b[first_b:j]
            first_a, first_b = i, j
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1


def piece_groups(tokens: tuple[list, list, list, list] | None) -> bytes | None:
    """The groups of a piece between stable places as text."""
    if tokens is None:
        return None
    return ";".join([f"{a[0]}|{b[0]}" if len(a) == len(b) == 1 else ",".join(map(str, a)) + "|" + ",".join(map(str, b))
                     for a, b in closed_groups(tokens)]).encode()


def finished(whole: Fragment) -> bytes:
    """The groups of a whole text."""
    return _joined(group_text(whole.a, whole.b), whole.body) if whole.a or whole.b else b""


# ---- blocks of documents

BLOCK = ("block bigint, id array<{id}>, key array<string>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
         "n_links array<bigint>, digest array<string>, groups array<string>, first binary, place binary, times binary, "
         "codes binary, held binary")


def _squeezed(a: np.ndarray) -> bytes:
    """Small numbers as compressed bytes, plane by plane."""
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _spread(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


class Blocks:
    """Packs documents, as (id, key, copies, groups as text), into blocks of a bounded size."""

    def __init__(self, id_type: pa.DataType, source: int, keep: bool, limit: tuple[int, int]):
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        self.schema = pa.schema([("block", pa.int64()), ("id", pa.list_(id_type)), ("key", strings), ("n_a", longs),
                                 ("n_b", longs), ("n_groups", longs), ("n_links", longs), ("digest", strings),
                                 ("groups", strings), *((c, pa.binary()) for c in ("first", "place", "times", "codes", "held"))])
        self.number, self.keep = TaskContext.get().partitionId() << 33 | source, keep
        self.docs, self.bytes, self.limit = [], 0, limit

    def put(self, id, key, copies: int, body: bytes) -> Iterator[pa.RecordBatch]:
        self.docs.append((id, key, copies, body))
        self.bytes += len(body)
        if self.bytes >= self.limit[0] or len(self.docs) >= self.limit[1]:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        id, key, copies, bodies = zip(*self.docs)
        n_groups = np.array([b.count(b";") + 1 if b else 0 for b in bodies])
        n_a, n_b, owner, codes, times = parsed(_joined(*bodies))
        doc = np.repeat(np.arange(len(bodies)), n_groups)  # of each group
        sums = lambda per_group: np.diff(np.append(0, np.cumsum(per_group))[np.append(0, np.cumsum(n_groups))])
        total = sums(np.bincount(owner, times, len(n_a)).astype(np.int64)) if len(owner) else np.zeros(len(bodies), np.int64)
        pair = doc[owner] << 32 | codes if len(owner) else codes
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else order
        times = np.add.reduceat(times[order], first) if len(first) else times
        holder = pair[first] >> 32
        codes, place = np.unique(pair[first] & 0xFFFFFFFF, return_inverse=True)
        held = np.bincount(place, np.array(copies, dtype=np.float64)[holder], len(codes)).astype(np.int64)
        step = np.diff(place, prepend=0)  # within a document places ascend
        bounds = np.searchsorted(holder, np.arange(len(bodies) + 1))
        row = {"block": self.number, "id": id, "key": key, "n_a": sums(n_a).tolist(), "n_b": sums(n_b).tolist(),
               "n_groups": n_groups.tolist(), "n_links": total.tolist(),
               "digest": [hashlib.sha256(b).hexdigest() if b else "" for b in bodies],
               "groups": [b.decode() for b in bodies] if self.keep else [None] * len(bodies), "first": _squeezed(bounds),
               "place": _squeezed(np.where(step < 0, -2 * step - 1, 2 * step)), "times": _squeezed(times),
               "codes": _squeezed(np.diff(codes, prepend=0)), "held": _squeezed(held)}
        yield pa.RecordBatch.from_pylist([row], schema=self.schema)
        self.number += 2
        self.docs, self.bytes = [], 0


def block_codes(row: dict) -> np.ndarray:
    return np.cumsum(_spread(row["codes"]))


def _align_short(paths, id_type: pa.DataType, keep: bool, limit: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, blocks = vocabularies(paths), Blocks(id_type, 0, keep, limit)
        for batch in in_parts(batches, 256):
            texts = [STABLE.split(t) if t else [] for t in batch.column("text").to_pylist()]
            voc.learn(set().union(*texts))
            for id, pieces in zip(batch.column("id").to_pylist(), texts):
                yield from blocks.put(id, None, 1, voc.aligned(pieces) or b"")
        yield from blocks.close()
    return run


# ---- chunks of long texts

SLICES = "key string, wide int, idx int, of int, lo int, hi int, whole_left boolean, whole_right boolean, slice string"


def _slices(chunk: int, margin: int):
    """Overlapping slices of " " + text; ``lo`` and ``hi`` bound the chunk within its slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SLICES.split(", ")]
        for batch in in_parts(batches, 16):
            for key, wide, text in zip(*(batch.column(c).to_pylist() for c in ("key", "wide", "text"))):
                text, size, edge = " " + text, chunk << 2 * wide, margin << 2 * wide
                of = -(-len(text) // size) if edge < len(text) else 1
                size = size if of > 1 else len(text)
                for at in range(0, of, 64):
                    rows = []
                    for k in range(at, min(of, at + 64)):
                        lo, hi = k * size, min((k + 1) * size, len(text))
                        a, b = max(lo - edge, 0), min(hi + edge, len(text))
                        rows.append((key, wide, k, of, lo - a, hi - a, a == 0, b == len(text), text[a:b]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int32()] * 5, *[pa.bool_()] * 2,
                                                                      pa.string()))], names=names)
    return run


FRAGMENTS = ("key string, copies bigint, wide int, idx int, of int, ok boolean, found boolean, closed boolean, a binary, b binary, tail_a binary, "
             "tail_b binary, body binary")
_FRAGMENT = pa.schema([("key", pa.string()), ("copies", pa.int64()), *((c, pa.int32()) for c in ("wide", "idx", "of")),
                       *((c, pa.bool_()) for c in ("ok", "found", "closed")),
                       *((c, pa.binary()) for c in ("a", "b", "tail_a", "tail_b", "body"))])
_IDS = ("a", "b", "tail_a", "tail_b")


def _row(key: str, copies: int, wide: int, idx: int, of: int, part: Fragment | None, found: bool = True) -> pa.RecordBatch:
    f = part or Fragment([], [])
    row = {"key": key, "copies": copies, "wide": wide, "idx": idx, "of": of, "ok": part is not None, "found": found, "closed": f.closed,
           "body": f.body, **{c: np.array(getattr(f, c), dtype="<u4").tobytes() for c in _IDS}}
    return pa.RecordBatch.from_pylist([row], schema=_FRAGMENT)


def chunk_fragment(voc: Vocabularies, text: str, lo: int, hi: int, starts: bool, ends: bool) -> tuple[Fragment | None, bool]:
    """(fragment of text[lo:hi], whether the stable places around it lie in the text).

    ``text`` is a slice of " " + a text; ``starts`` and ``ends`` tell that it reaches the text's ends."""
    cuts = ([0] if starts else []) + [m.start() for m in STABLE.finditer(text) if m.start()] + ([len(text)] if ends else [])
    left, right = int(np.searchsorted(cuts, lo, "right")) - 1, int(np.searchsorted(cuts, hi, "left"))
    if left < 0 or right == len(cuts):
        return None, False
    out = None
    last = right - 1
    for k in range(left, right):
        begin, end = cuts[k], cuts[k + 1]
        if out is not None and end <= hi and k < last:  # whole pieces in between come from the dictionary
            continue
        if out is not None and last > left + 1 and k == last:
            pieces = [text[x + 1:y] for x, y in zip(cuts[left + 1:last], cuts[left + 2:last + 1])]
            voc.learn(set(pieces))
            between = voc.aligned(pieces)
            if between is None:
                return None, True
            out.body = _joined(out.body, between)
        tokens = voc.tokens(text[begin + 1:end])
        if tokens is None:
            return None, True
        size = lambda x: len(text[begin:x].encode())
        part = fragment(tokens, size(lo) if lo > begin else -1, size(min(hi, end)))
        out = part if out is None else compose(out, part)
    return out or Fragment([], []), True


def _fragment_of(r: dict) -> Fragment | None:
    a, b, tail_a, tail_b = (np.frombuffer(r[c], "<u4").tolist() for c in _IDS)
    return Fragment(a, b, r["closed"], tail_a, tail_b, r["body"]) if r["ok"] else None


def _chunk_fragments(paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(paths)
        for batch in in_parts(batches, 64):
            for r in batch.to_pylist():
                part, found = chunk_fragment(voc, r["slice"], r["lo"], r["hi"], r["whole_left"], r["whole_right"])
                yield _row(r["key"], r["copies"], r["wide"], r["idx"], r["of"], part, found)
    return run


def _compose_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes the rows of one parent, which come one after the other in the order of their chunks."""
    open_: tuple | None = None
    for batch in in_parts(batches, 64):
        for r in batch.to_pylist():
            at = (r["key"], r["copies"], r["wide"], r["idx"] // FAN, -(-r["of"] // FAN))
            part = _fragment_of(r)
            if open_ and open_[0] == at:
                open_[1].append(part)
            else:
                if open_:
                    yield _row(*open_[0], _composed(open_[1]))
                open_ = (at, [part])
    if open_:
        yield _row(*open_[0], _composed(open_[1]))


def _composed(parts: list[Fragment | None]) -> Fragment | None:
    """Fragments joined two by two, as a tree."""
    if None in parts:
        return None
    while len(parts) > 1:
        parts = [compose(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def long_fragments(texts: DataFrame, paths, chunk: int, margin: int) -> DataFrame:
    """(key, copies, ... one whole fragment) of the long texts (key, text): chunks, then rounds of ``FAN`` fragments into one."""
    open_, parts = texts.select("key", F.lit(0).alias("wide"), "text"), None
    while True:
        slices = open_.mapInArrow(_slices(chunk, margin), SLICES)
        one = slices.groupBy("key", "wide", "idx", "of").agg(F.first(F.struct(  # equal texts once; spreads the chunks of a text
            "lo", "hi", "whole_left", "whole_right", "slice")).alias("s"), F.count(F.lit(1)).alias("copies")).select(
                "key", "copies", "wide", "idx", "of", "s.*")
        got = staged(one.mapInArrow(_chunk_fragments(paths), FRAGMENTS), "align-fragments")
        again = got.filter("NOT found").select("key").distinct()
        last = again.isEmpty()
        ready = got if last else got.join(again, "key", "left_anti")
        parts = ready if parts is None else parts.unionByName(ready)
        if last:
            break
        open_ = open_.join(again, "key", "left_semi").withColumn("wide", F.col("wide") + 1)
    left = parts.agg(F.max("of")).first()[0] or 1
    parts = parts.select(*_FRAGMENT.names)
    while left > 1:
        parent = F.floor(F.col("idx") / FAN)
        parts = staged(parts.repartition("key", parent).sortWithinPartitions("key", "idx")
                       .mapInArrow(_compose_rows, FRAGMENTS), "align-fragments")
        left = -(-left // FAN)
    return parts


def _long_blocks(id_type: pa.DataType, keep: bool, limit: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(id_type, 1, keep, limit)
        for batch in in_parts(batches, 64):
            for r in batch.to_pylist():
                whole = _fragment_of(r)
                yield from blocks.put(None, r["key"], r["copies"], finished(whole) if whole else b"")
        yield from blocks.close()
    return run


# ---- counts

PAIRS = "block bigint, place int, code bigint, held bigint"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, 1):
        for r in batch.to_pylist():
            codes = block_codes(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), r["block"], dtype=np.int64)), pa.array(np.arange(len(codes), dtype=np.int32)),
                 pa.array(codes), pa.array(_spread(r["held"]))], names=["block", "place", "code", "held"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, held) of the pairs of a task's blocks, added up over a few blocks at a time."""
    codes, held, size = [], [], 0

    def added() -> pa.RecordBatch:
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(place, np.concatenate(held).astype(np.float64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "held"])

    for batch in in_parts(batches, 1):
        for r in batch.to_pylist():
            codes.append(block_codes(r))
            held.append(_spread(r["held"]))
            size += len(codes[-1])
        if size >= 1 << 21:
            yield added()
            codes, held, size = [], [], 0
    if size:
        yield added()


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, a_id, b_id, n_docs, best) of every linked pair: in how many documents, and whether no pair of its A id has more."""
    counts = (blocks.select("codes", "held").mapInArrow(_held, "code bigint, held bigint").groupBy("code")
              .agg(F.sum("held").alias("n_docs"))
              .select("code", F.shiftright("code", B_BITS).cast("int").alias("a_id"),
                      (F.col("code") % (1 << B_BITS)).cast("int").alias("b_id"), "n_docs"))
    counts = staged(counts, "align-counts")
    top = counts.groupBy("a_id").agg(F.max("n_docs").alias("top"))  # at most one row per id of vocabulary A
    return counts.join(F.broadcast(top), "a_id").select("code", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top"))
                                                        .alias("best"))


RESULT = ("id {id}, key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
          "groups_sha256 string, groups string")


def block_sums(r: dict, count: np.ndarray, best: np.ndarray, id_type: pa.DataType) -> pa.Table:
    """Result rows of a block whose pairs have these counts."""
    step = _spread(r["place"])
    place = np.cumsum(np.where(step & 1, -(step + 1) // 2, step // 2))
    first, times = _spread(r["first"]), _spread(r["times"])
    within = lambda x: np.diff(np.append(0, np.cumsum(x))[first])
    longs = {"n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"], "n_links": r["n_links"],
             "n_best": within(times * best[place]), "count_sum": within(times * count[place])}
    return pa.table({"id": pa.array(r["id"], id_type), "key": pa.array(r["key"], pa.string()),
                     **{k: pa.array(v, pa.int64()) for k, v in longs.items()},
                     "groups_sha256": pa.array(r["digest"], pa.string()), "groups": pa.array(r["groups"], pa.string())})


def _joined_sums(id_type: pa.DataType):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        [r] = blocks.to_pylist()
        n = len(_spread(r["codes"]))
        count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if len(found):
            at = found.column("f_place").to_numpy()
            count[at], best[at] = found.column("n_docs").to_numpy(), found.column("best").to_numpy()
        return block_sums(r, count, best, id_type)
    return run


def _shared_sums(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in in_parts(batches, 1):
            for r in batch.to_pylist():
                at = np.searchsorted(code, block_codes(r))
                yield from block_sums(r, count[at], best[at], id_type).combine_chunks().to_batches()
    return run


def row_sums(blocks: DataFrame, kind, shared: int = SHARED) -> DataFrame:
    """Result rows of all blocks."""
    counts = pair_counts(blocks).select("code", "n_docs", "best")
    schema, arrow = RESULT.format(id=kind.simpleString()), to_arrow_type(kind)
    if counts.count() <= shared:  # a few bytes a pair
        t = counts.orderBy("code").toArrow()
        arrays = tuple(t.column(c).to_numpy() for c in ("code", "n_docs", "best"))
        return blocks.mapInArrow(_shared_sums(blocks.sparkSession.sparkContext.broadcast(arrays), arrow), schema)
    pairs = blocks.select("block", "codes", "held").mapInArrow(_pairs, PAIRS)
    found = pairs.join(counts, "code").select(F.col("block").alias("f_block"), F.col("place").alias("f_place"), "n_docs", "best")
    return blocks.groupBy("block").cogroup(found.groupBy("f_block")).applyInArrow(_joined_sums(arrow), schema)


def aligned_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", a: str = VOCABULARY_A, ranks: str = RANKS_A,
                   b: str = VOCABULARY_B, chunk: int = CHUNK, margin: int = MARGIN, keep: bool = False,
                   limit: tuple[int, int] = (BYTES, DOCS)) -> tuple[DataFrame, DataFrame]:
    """(blocks of all documents, (id, key) of the long ones, which the blocks hold once under their key)."""
    paths = tuple(vocabulary_path(x) for x in (a, ranks, b))
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    keyed = rows.filter(long).select("id", F.sha2("text", 256).alias("key"), "text")
    names = staged(keyed.select("id", "key"), "align-long")
    whole = long_fragments(keyed.select("key", "text"), paths, chunk, margin)
    arrow, schema = to_arrow_type(docs.schema[id].dataType), BLOCK.format(id=docs.schema[id].dataType.simpleString())
    short = rows.filter(~long).mapInArrow(_align_short(paths, arrow, keep, limit), schema)
    return staged(short.unionByName(whole.mapInArrow(_long_blocks(arrow, keep, limit), schema)), "align-blocks"), names


def alignments(docs: DataFrame, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, margin: int = MARGIN,
               keep: bool = False, shared: int = SHARED, **more) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; with ``keep`` also the groups
    (`a1,a2|b1;a3|b2`).  ``more``: vocabularies and block limits of `aligned_blocks`."""
    blocks, names = aligned_blocks(docs, id, text, chunk=chunk, margin=margin, keep=keep, **more)
    rows = staged(row_sums(blocks, docs.schema[id].dataType, shared), "align-rows")
    of_long = names.join(rows.filter("key IS NOT NULL").drop("id"), "key").select(*rows.columns)
    every = rows.filter("key IS NULL").unionByName(of_long)
    return every.select(F.col("id").alias(id), *[c for c in rows.columns if c not in ("id", "key", "groups")],
                        *(["groups"] if keep else []))


def align_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return alignments(read(spark, sf_dir, "documents", "doc_id", "text"))
