"""Suffix-array dedup by the common-prefix interval tree (operator 4).

Removes every byte that lies in a ``LEAST``-byte string which starts at two or more
places of the corpus.  That is the union of all occurrences of all maximal repeats
of at least that length, and those are read off an enhanced suffix array: suffixes
in order, their common-prefix lengths, a stack scan that yields the intervals of
suffixes sharing a prefix, and for each interval the test whether the bytes left
of its suffixes differ (otherwise the repeat extends to the left and another
interval reports it).

How it is spread over tasks.  Every window of LEAST bytes has an anchor: the
``GRAM``-byte piece with the least hash (ties: the last).  Equal windows have equal
anchors at equal offsets, so all suffixes that share LEAST bytes meet under their
anchor, whatever the partitioning, and no interval of that depth crosses a task.

1. Anchors.  Each text gives about one anchor per 70 bytes, with a hash of its
   context (all windows that have it as their anchor).  Contexts that occur twice in an Arrow
   batch, or twice under an anchor, are repeated in full; most anchors are alone and go.
2. Contexts.  Where an anchor has several different contexts, their bytes are
   fetched, one copy of each.
3. Suffix arrays.  Tasks take groups of anchors, bucket the suffixes by their first
   LEAST bytes, drop buckets that do not differ to the left, order the others,
   scan their intervals and report the maximal repeats' occurrences.
4. Spans are merged per text, and joined to all rows that hold that text.

Equal texts are one (they repeat in full); texts move by a digest of 128 bits.
An anchor with very many different contexts (known from a count over all data) is
never gathered: its entries are salted, and its windows are compared by a grouped
count of their 128-bit hashes instead.  ``repeat_groups`` lists the groups with
all occurrences in all rows, also of contexts that are copied whole and of split
anchors (whose groups come from counted hashes of their substrings); a repeat longer
than a context appears as a chain of groups, each as long as the context shows it.

Defined cases: null text: empty; texts shorter than LEAST: never touched; rows with
equal ids are separate rows; matches never cross texts; an empty table gives an
empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm import rolling
from actuaria.llm.common import in_parts, read, staged

#: Least repeat, anchor length.
LEAST, GRAM = 200, 32
#: Anchor entries per range, contexts per suffix array, contexts from which an anchor is split, salts.
ENTRIES, CONTEXTS, HOT, SALTS = 1 << 19, 1 << 13, 1 << 15, 64
#: Bits of a position inside a slice of a text; bytes hashed at a time.
BITS = 20
SLICE = 1 << 20


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _least_of(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first run, last run): where the least hash (the last, if tied) of the runs of ``width`` lies,
    and which runs, numbered by their start, have it there."""
    n = len(h)
    low = np.uint64((1 << BITS) - 1)
    rank = (h >> np.uint64(BITS) << np.uint64(BITS)) | (low - np.arange(n, dtype=np.uint64))
    grid = np.concatenate([rank, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    at = (low - (best & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], len(at)) - 1


def anchors(ranges: rolling.Prefixes, first: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, stop) of the text at ``first`` of the hashed buffer, relative to it: the windows
    of bytes start to stop have their anchor there.  Every window is in exactly one such context."""
    if size < LEAST:
        return (np.zeros(0, np.int64),) * 3
    found = []
    step = (1 << BITS) - LEAST
    for a in range(0, size - LEAST + 1, step):  # a very long text in slices
        b = min(size, a + step + LEAST - 1)
        gram = np.arange(first + a, first + b - GRAM + 1)
        at, start, last = _least_of(ranges(gram, gram + GRAM), LEAST - GRAM + 1)
        found.append((at + a, start + a, last + a + LEAST))
    return tuple(np.concatenate(x) for x in zip(*found))


def place(at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A context's start, the anchor's place in it and its size in one number."""
    return (start << 20) | ((at - start) << 10) | (stop - start)


def _slices(texts: dict[bytes, bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    keys, parts, size = [], [], 0
    for k, t in texts.items():
        keys.append(k)
        parts.append(t)
        size += len(t)
        if size >= SLICE:
            yield keys, parts
            keys, parts, size = [], [], 0
    if parts:
        yield keys, parts


def batch_anchors(texts: dict[bytes, bytes]):
    """(keys, hash, context hash, text number, place) of the anchors of a batch's distinct texts."""
    every, cols = [], []
    for keys, parts in _slices(texts):
        ranges = rolling.Prefixes(np.frombuffer(b"".join(parts), dtype=np.uint8), least=SLICE)
        first = 0
        for i, t in enumerate(parts):
            at, lo, hi = anchors(ranges, first, len(t))
            if len(at):
                spot = place(at, lo, hi)
                cols.append((ranges(at + first, at + first + GRAM),
                             rolling.mix(ranges(lo + first, hi + first) + (spot & ((1 << 20) - 1)).astype(np.uint64)),
                             np.full(len(at), len(every) + i), spot))
            first += len(t)
        every += keys
    if not cols:
        empty = np.zeros(0, np.uint64)
        return every, empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return every, *(np.concatenate(c) for c in zip(*cols))


def _texts(batch: pa.RecordBatch) -> dict[bytes, bytes]:
    """Distinct texts of a batch that are long enough, by digest."""
    out = {}
    for key, t in zip(batch.column("key").to_pylist(), batch.column("text")):
        if key not in out and t.is_valid:
            raw = t.as_buffer().to_pybytes()
            if len(raw) >= LEAST:
                out[key] = raw
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal rows."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


# ---- 1: anchors

def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with several contexts in a batch, with how many."""
    for batch in in_parts(batches):
        _, h, c, _, _ = batch_anchors(_texts(batch))
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        h = h[_runs(h, c)]
        first = np.flatnonzero(_runs(h))
        n = np.diff(np.append(first, len(h)))
        many = n >= 4
        yield pa.RecordBatch.from_arrays([_long(h[first[many]]), pa.array(n[many], pa.int64())], names=["hash", "n"])


PACKED = "range bigint, hash binary, context binary, who binary, at binary, keys binary"
SPANS = "key binary, start bigint, stop bigint"


def _pack_anchors(hot: np.ndarray, ranges: int, every: bool = False):
    """Anchors by hash range, one entry per context of a batch; contexts that a batch holds twice
    are marked, and the spans of their other occurrences come as rows with range null.

    ``every``: these rows keep their hashes, and contexts of texts marked ``again`` count as held twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keys, h, c, who, at = batch_anchors(_texts(batch))
            if not len(h):
                continue
            order = np.lexsort((at, who, c, h))
            h, c, who, at = h[order], c[order], who[order], at[order]
            new = _runs(h, c)
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(h))) > 1
            key = np.frombuffer(b"".join(keys), dtype="S16") if keys else np.zeros(0, "S16")
            if every:
                again = {k for k, a in zip(batch.column("key").to_pylist(), batch.column("again").to_pylist()) if a}
                twice |= np.array([k in again for k in keys])[who[first]]
            rest = ~new
            for a in range(0, int(rest.sum()), 1 << 16):  # known to be repeated: spans only
                some = np.flatnonzero(rest)[a:a + (1 << 16)]
                yield _packed_row(None, h[some], c[some], who[some] * 2 + 1, at[some], key, every)
            h, c, who, at = h[first], c[first], who[first], at[first]
            where = rolling.spread(h, ranges)
            salted = np.isin(h, hot)
            where[salted] = -1 - (c[salted] % np.uint64(SALTS)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.flatnonzero(np.diff(where[order])) + 1
            for part in np.split(order, cut):
                yield _packed_row(int(where[part[0]]), h[part], c[part], who[part] * 2 + twice[part], at[part], key)
    return run


def _packed_row(where, h, c, who, at, key, every: bool = False) -> pa.RecordBatch:
    used, local = np.unique(who >> 1, return_inverse=True)
    blobs = [h, c, (local * 2 + (who & 1)).astype(np.uint32), at.astype(np.int64)]
    if where is None and not every:
        blobs[0] = blobs[1] = np.zeros(0, np.uint64)
    keys = b"".join(bytes(k).ljust(16, b"\0") for k in key[used])
    return pa.RecordBatch.from_arrays(
        [pa.array([where], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs),
         pa.array([keys], pa.binary())], names=["range", "hash", "context", "who", "at", "keys"])


def _unpack(rows: list[dict]) -> dict[str, np.ndarray]:
    cols = {k: [] for k in ("hash", "context", "twice", "at", "key")}
    for r in rows:
        who = np.frombuffer(r["who"], np.uint32)
        cols["hash"].append(np.frombuffer(r["hash"], np.uint64))
        cols["context"].append(np.frombuffer(r["context"], np.uint64))
        cols["twice"].append((who & 1).astype(bool))
        cols["at"].append(np.frombuffer(r["at"], np.int64))
        cols["key"].append(np.frombuffer(r["keys"], np.uint64).reshape(-1, 2)[who >> 1])
    return {k: np.concatenate(v) for k, v in cols.items()}


FOUND = "key binary, at bigint, hash bigint, whole boolean, asked boolean"
#: With the context's hash, which together with the anchor's names the context.
FOUND_EVERY = FOUND + ", context bigint"


def _found(key: np.ndarray, at, h, whole, asked, context=None) -> pa.Table:
    raw = np.ascontiguousarray(key).tobytes()
    named = {} if context is None else {"context": _long(np.ascontiguousarray(context))}
    return pa.table({"key": pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary()),
                     "at": pa.array(at, pa.int64()), "hash": _long(np.ascontiguousarray(h)),
                     "whole": pa.array(whole, pa.bool_()), "asked": pa.array(asked, pa.bool_())} | named)


def _anchor_groups(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return _of_anchors(key, table, False)


def _anchor_groups_every(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return _of_anchors(key, table, True)


def _of_anchors(key: tuple[pa.Scalar, ...], table: pa.Table, every: bool) -> pa.Table:
    """Of the anchors of one range: occurrences whose whole context is repeated (``whole``), and one
    occurrence of each context where an anchor has several (``asked``), with ``every`` of each repeated one too."""
    c = _unpack(table.to_pylist())
    order = np.lexsort((c["at"], c["key"][:, 1], c["key"][:, 0], c["context"], c["hash"]))
    c = {k: v[order] for k, v in c.items()}
    # copies of one text in several batches are one occurrence; it keeps any mark
    new = _runs(c["hash"], c["context"], c["key"][:, 0], c["key"][:, 1], c["at"])
    twice = np.logical_or.reduceat(c["twice"], np.flatnonzero(new)) if len(new) else c["twice"]
    c = {k: v[new] for k, v in c.items()} | {"twice": twice}
    new = _runs(c["hash"], c["context"])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(new)))
    run = np.cumsum(new) - 1
    whole = ((n > 1) | np.logical_or.reduceat(c["twice"], first))[run] if len(first) else new
    group = np.cumsum(_runs(c["hash"])) - 1
    several = np.bincount(group[first], minlength=group[-1] + 1 if len(group) else 0)[group] > 1
    asked = new & (several | (key[0].as_py() < 0) | (whole & every))
    keep = whole | asked
    return _found(c["key"][keep], c["at"][keep], c["hash"][keep], whole[keep], asked[keep],
                  c["context"][keep] if every else None)


def _marked_every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_marked``, with the anchor and the context of each occurrence."""
    for batch in in_parts(batches, 1):
        for r in batch.to_pylist():
            c = _unpack([r])
            n = len(c["at"])
            yield from _found(c["key"], c["at"], c["hash"], np.ones(n, bool), np.zeros(n, bool),
                              c["context"]).to_batches()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences that their batch already knew to be repeated in full."""
    for batch in in_parts(batches, 1):
        for r in batch.to_pylist():
            c = _unpack([r | {"hash": b"", "context": b""}])
            n = len(c["at"])
            yield from _found(c["key"], c["at"], np.zeros(n, np.uint64), np.ones(n, bool),
                              np.zeros(n, bool)).to_batches()


# ---- 2: contexts

CONTEXT = "hash bigint, key binary, at bigint, whole boolean, bytes binary"
CONTEXT_EVERY = "hash bigint, context bigint, whole boolean, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each asked context of a text (rows key, text, asked); ``at`` is where it starts."""
    for batch in in_parts(batches, 512):
        rows = {k: [] for k in ("hash", "key", "at", "whole", "bytes")}
        for key, text, asked in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("asked").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            for a in asked:
                lo, size = a["at"] >> 20, a["at"] & 1023
                for k, v in zip(rows, (a["hash"], key, lo, a["whole"], raw[lo:lo + size])):
                    rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
            ("hash", pa.int64()), ("key", pa.binary()), ("at", pa.int64()),
            ("whole", pa.bool_()), ("bytes", pa.binary())]))


def _contexts_every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each asked context, named by anchor and context hash."""
    for batch in in_parts(batches, 512):
        rows = {k: [] for k in ("hash", "context", "whole", "bytes")}
        for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            for a in asked:
                lo, size = a["at"] >> 20, a["at"] & 1023
                for k, v in zip(rows, (a["hash"], a["context"], a["whole"], raw[lo:lo + size])):
                    rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
            ("hash", pa.int64()), ("context", pa.int64()), ("whole", pa.bool_()), ("bytes", pa.binary())]))


# ---- 3: suffix arrays

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, by halving."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = known
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo:hi] != b[lo:hi] else hi


def intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(depth, first, last, diverse) of the common-prefix intervals of ordered suffixes, inner ones first.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i; ``left`` has a bit per byte that stands left
    of a suffix (two bits where that is unknown or the text begins, which differs from everything)."""
    stack: list[list[int]] = []  # depth, first, bits
    n = len(left)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first, bits = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            d, f, b = stack.pop()
            bits |= b
            yield d, f, i - 1, bits & (bits - 1) != 0
            first = f
        if depth >= least:
            if stack and stack[-1][0] == depth:
                stack[-1][2] |= bits
            else:
                stack.append([depth, first, bits])


def suffix_buckets(contexts: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of (context, start) whose suffixes share their first LEAST bytes and differ to the left.

    Every window of a context has the context's anchor, so no place of a text is seen twice."""
    size = np.array([len(c) for c in contexts])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    n = size - LEAST + 1
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = first[owner] + start
    h = rolling.Prefixes(raw, least=SLICE)(at, at + LEAST)
    order = np.argsort(h, kind="stable")
    h = h[order]
    run = np.flatnonzero(_runs(h))
    count = np.diff(np.append(run, len(h)))
    left = np.where(start[order] > 0, raw[np.maximum(at[order] - 1, 0)].astype(np.int64), -1)
    low, high = np.minimum.reduceat(left, run), np.maximum.reduceat(left, run)
    for r in np.flatnonzero((count > 1) & ((low != high) | (low < 0))):
        some = order[run[r]:run[r] + count[r]]
        yield np.stack([owner[some], start[some]], axis=1)


def maximal_repeats(contexts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, members) of the maximal repeats: members are rows (context, start)."""
    for bucket in suffix_buckets(contexts):
        members = sorted(((contexts[c][s:], c, s) for c, s in bucket.tolist()))
        left = [1 << contexts[c][s - 1] if s else 3 << 256 for _, c, s in members]
        lcp = [0] + [common_prefix(members[i - 1][0], members[i][0]) for i in range(1, len(members))]
        where = np.array([(c, s) for _, c, s in members])
        for depth, first, last, diverse in intervals(lcp, left, LEAST):
            if diverse:
                yield depth, where[first:last + 1]


def longest_cover(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, length): for each suffix in a maximal repeat, the longest one."""
    owner, start, length = [], [], []
    for bucket in suffix_buckets(contexts):
        members = sorted(((contexts[c][s:], c, s) for c, s in bucket.tolist()))
        left = [1 << contexts[c][s - 1] if s else 3 << 256 for _, c, s in members]
        lcp = [0] + [common_prefix(members[i - 1][0], members[i][0]) for i in range(1, len(members))]
        upto = list(range(len(members) + 1))  # next member without a length, as a forest

        def free(i: int) -> int:
            while upto[i] != i:
                upto[i] = upto[upto[i]]
                i = upto[i]
            return i

        for depth, first, last, diverse in intervals(lcp, left, LEAST):  # inner, longer ones come first
            i = free(first) if diverse else last + 1
            while i <= last:
                owner.append(members[i][1])
                start.append(members[i][2])
                length.append(depth)
                upto[i] = i + 1
                i = free(i)
    return np.array(owner, np.int64), np.array(start, np.int64), np.array(length, np.int64)


def _suffix_arrays(table: pa.Table) -> pa.Table:
    """Spans of the maximal repeats among the contexts of one group of anchors."""
    contexts = [b.as_py() for b in table.column("bytes")]
    owner, start, length = longest_cover(contexts)
    at = table.column("at").to_numpy()
    whole = table.column("whole").to_numpy(zero_copy_only=False)
    need = ~whole[owner] if len(owner) else np.zeros(0, bool)
    owner, start, length = owner[need], start[need], length[need]
    keys = table.column("key").to_pylist()
    first = at[owner] + start if len(owner) else owner
    return pa.table({"key": pa.array([keys[o] for o in owner], pa.binary()), "start": pa.array(first, pa.int64()),
                     "stop": pa.array(first + length, pa.int64())})


GROUPED = "repeat binary, length bigint, hash bigint, context bigint, start bigint"


def _grouped_table(rows: dict[str, list]) -> pa.Table:
    return pa.table(rows, schema=pa.schema([("repeat", pa.binary()), ("length", pa.int64()), ("hash", pa.int64()),
                                            ("context", pa.int64()), ("start", pa.int64())]))


def _groups(table: pa.Table) -> pa.Table:
    """All maximal repeats of one group of anchors: where they start in which contexts.

    A context that is repeated whole is a repeat by itself, also where it is the only one of its anchor."""
    contexts = [b.as_py() for b in table.column("bytes")]
    h, of = table.column("hash").to_pylist(), table.column("context").to_pylist()
    rows = {k: [] for k in ("repeat", "length", "hash", "context", "start")}

    def put(length: int, members: list) -> None:
        name = digest(contexts[members[0][0]][members[0][1]:members[0][1] + length])
        for c, s in members:
            for k, v in zip(rows, (name, length, h[c], of[c], s)):
                rows[k].append(v)

    for depth, members in maximal_repeats(contexts):
        put(depth, members.tolist())
    for c, whole in enumerate(table.column("whole").to_pylist()):
        if whole:
            put(len(contexts[c]), [(c, 0)])
    return _grouped_table(rows)


SUBSTRINGS = "repeat binary, length bigint, hash bigint, context bigint, start bigint, whole boolean, left int, right int"


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings of a split anchor's contexts (rows hash, context, whole, bytes, starts), with the bytes
    beside them (-1 at the context's ends): from each start, of LEAST bytes or, where ``longer``, of all lengths."""
    for batch in in_parts(batches, 64):
        rows = {k: [] for k in ("repeat", "length", "hash", "context", "start", "whole", "left", "right")}
        starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else None
        for i, (h, c, whole, raw) in enumerate(zip(*(batch.column(k).to_pylist()
                                                     for k in ("hash", "context", "whole", "bytes")))):
            n = len(raw)
            for s in range(n - LEAST + 1) if starts is None else starts[i]:
                for stop in (s + LEAST,) if starts is None else range(s + LEAST, n + 1):
                    for k, v in zip(rows, (digest(raw[s:stop]), stop - s, h, c, s, whole and s == 0 and stop == n,
                                           raw[s - 1] if s else -1, raw[stop] if stop < n else -1)):
                        rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
            [("repeat", pa.binary()), *((k, pa.int64()) for k in ("length", "hash", "context", "start")),
             ("whole", pa.bool_()), ("left", pa.int32()), ("right", pa.int32())]))


def _diverse(side: str):
    return (F.min(side) != F.max(side)) | (F.min(side) < 0)


def _split_groups(contexts: DataFrame) -> DataFrame:
    """What ``_groups`` gives, for split anchors: no anchor's contexts are ever gathered.

    A repeat whose first LEAST bytes are not repeated, or have one and the same byte to their left, is not
    maximal; from the other starts all lengths are counted."""
    w = contexts.mapInArrow(_substrings, SUBSTRINGS)
    some = w.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), _diverse("left").alias("ok"))
    at = w.join(some.filter("n > 1 AND ok").select("repeat"), "repeat").groupBy("hash", "context").agg(
        F.collect_list("start").alias("starts"))
    u = staged(contexts.join(at, ["hash", "context"]).mapInArrow(_substrings, SUBSTRINGS), "repeat-substrings")
    kept = u.groupBy("repeat", "length").agg(
        F.count(F.lit(1)).alias("n"), _diverse("left").alias("l"), _diverse("right").alias("r"))
    names = ["repeat", "length", "hash", "context", "start"]
    several = u.join(kept.filter("n > 1 AND l AND r").select("repeat", "length"), ["repeat", "length"]).select(names)
    alone = contexts.filter("whole").mapInArrow(_whole_contexts, GROUPED)
    return several.unionByName(alone)


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        raw = batch.column("bytes").to_pylist()
        yield from _grouped_table({
            "repeat": [digest(b) for b in raw], "length": [len(b) for b in raw], "hash": batch.column("hash").to_pylist(),
            "context": batch.column("context").to_pylist(), "start": [0] * len(raw)}).to_batches()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all windows of a split anchor's contexts."""
    for batch in batches:
        rows = {k: [] for k in ("w", "key", "start")}
        for key, at, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "bytes"))):
            for s in range(len(raw) - LEAST + 1):
                for k, v in zip(rows, (digest(raw[s:s + LEAST]), key, at + s)):
                    rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
            [("w", pa.binary()), ("key", pa.binary()), ("start", pa.int64())]))


# ---- 4: the operator

def _asked_contexts(rows: DataFrame, found: DataFrame) -> DataFrame:
    asked = found.filter("asked").groupBy("key").agg(F.collect_list(F.struct("at", "hash", "whole")).alias("asked"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))  # one copy of equal texts
    return texts.join(asked, "key").select("key", "text", "asked").mapInArrow(_contexts, CONTEXT)


def _asked_every(rows: DataFrame, found: DataFrame) -> DataFrame:
    asked = found.filter("asked").groupBy("key").agg(
        F.collect_list(F.struct("at", "hash", "context", "whole")).alias("asked"))
    return rows.join(asked, "key").select("text", "asked").mapInArrow(_contexts_every, CONTEXT_EVERY)


def repeated_contexts(rows: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame, list[int]]:
    """Anchor occurrences (key, at, hash, whole, asked), the asked contexts, and the split anchors.

    ``every``, for rows (key, text, again) with distinct keys: all occurrences of repeated contexts with
    the context's hash, and each of these contexts is asked for."""
    counts = rows.mapInArrow(_survey, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    hot = sorted(r["hash"] for r in counts.filter(F.col("n") >= HOT).collect())  # each stands for HOT contexts
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, -(-total // (64 * ENTRIES)))
    packed = staged(rows.mapInArrow(_pack_anchors(np.array(hot, np.int64).view(np.uint64), ranges, every), PACKED),
                    "anchors")
    groups, marked, kind = ((_anchor_groups_every, _marked_every, FOUND_EVERY) if every
                            else (_anchor_groups, _marked, FOUND))
    found = (packed.filter(F.col("range").isNotNull()).groupBy("range").applyInArrow(groups, kind)
             .unionByName(packed.filter(F.col("range").isNull()).mapInArrow(marked, kind)))
    found = staged(found, "anchors-found")
    return found, staged((_asked_every if every else _asked_contexts)(rows, found), "contexts"), hot


def _by_group(contexts: DataFrame, hot: list[int]) -> DataFrame:
    cold = contexts.filter(~F.col("hash").isin(hot)) if hot else contexts
    tasks = max(1, -(-contexts.count() // CONTEXTS))
    return cold.groupBy(F.pmod(F.xxhash64("hash"), F.lit(tasks)).alias("group"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(key, start, stop): spans whose union is every repeated byte; rows (key, text)."""
    found, contexts, hot = repeated_contexts(rows)
    lo = F.shiftright("at", 20)
    spans = found.filter("whole").select("key", lo.alias("start"), (lo + F.col("at").bitwiseAND(1023)).alias("stop"))
    spans = spans.unionByName(_by_group(contexts, hot).applyInArrow(_suffix_arrays, SPANS))
    if hot:
        w = contexts.filter(F.col("hash").isin(hot)).mapInArrow(_windows, "w binary, key binary, start bigint")
        again = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        spans = spans.unionByName(w.join(again, "w").select("key", "start", (F.col("start") + LEAST).alias("stop")))
    return spans


def _union(starts: list[int], stops: list[int], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops)):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


CUT = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text (rows key, text, starts, stops)."""
    for batch in in_parts(batches, 512):
        rows = []
        for key, text, a, b in zip(batch.column("key").to_pylist(), batch.column("text"),
                                   batch.column("starts").to_pylist(), batch.column("stops").to_pylist()):
            raw = text.as_buffer().to_pybytes()
            spans = _union(a, b, len(raw))
            h, last = hashlib.sha256(), 0
            for x, y in spans:
                h.update(raw[last:x])
                last = y
            h.update(raw[last:])
            rows.append((key, len(raw), sum(y - x for x, y in spans), len(spans), h.hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(cols, (pa.binary(), *[pa.int64()] * 3, pa.string()))],
            names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, text): texts with a digest of 128 bits."""
    raw = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id].alias("id"), F.substring(F.unhex(F.sha2(raw, 256)), 1, 16).alias("key"), raw.alias("text"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = keyed(docs, id, text)
    long_rows = rows.filter(F.octet_length("text") >= LEAST).select("key", "text")
    # texts that occur twice are removed whole; the others lose their repeated spans
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    spans = repeated_spans(long_rows).groupBy("key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    single = staged(spans.join(copies.filter("copies = 1").select("key"), "key"), "repeat-spans")
    cut = (long_rows.join(single, "key").select("key", "text", "starts", "stops").mapInArrow(_cut, CUT)
           .select("key", "n_removed", "n_spans", "kept_sha256"))
    several = staged(copies.filter("copies > 1").select("key", F.lit(True).alias("again")), "repeat-copies")
    plain = rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("sha"))
    out = plain.join(several, "key", "left").join(staged(cut, "repeat-cut"), "key", "left")
    gone = F.coalesce(F.col("again") & (F.col("n_bytes") >= LEAST), F.lit(False))
    return out.select(
        F.col("id").alias(id), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def repeat_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(repeat, length, key, start, id): the maximal repeats with all occurrences in all rows."""
    rows = keyed(docs, id, text).filter(F.octet_length("text") >= LEAST)
    texts = staged(rows.groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("again")),
                   "repeat-texts")
    found, contexts, hot = repeated_contexts(texts, every=True)
    groups = _by_group(contexts, hot).applyInArrow(_groups, GROUPED)
    if hot:
        groups = groups.unionByName(_split_groups(contexts.filter(F.col("hash").isin(hot))))
    occurrences = found.select("hash", "context", "key", F.shiftright("at", 20).alias("lo")).distinct()
    at = (groups.distinct().join(occurrences, ["hash", "context"])
          .select("repeat", "length", "key", (F.col("lo") + F.col("start")).alias("start")).distinct())
    return at.join(rows.select("key", F.col("id").alias(id)), "key").select("repeat", "length", "key", "start", id)


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
