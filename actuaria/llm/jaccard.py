"""N-gram Jaccard join with a token-group matrix (operator 6).

Two documents link when the Jaccard likeness of their sets of five-word shingles
is at least 0.75; the result gives each document its component.  Exact (up to
collisions of 64-bit shingle hashes), without forming all pairs:

1. Classes.  Documents with equal sets are one class, named by its least id.
2. Live classes.  In a fixed order of all shingles (frequent ones last), two sets
   that link share at least ``m`` shingles among the first ``n - ceil(0.75 n) + m``
   of each (prefix filter).  Those prefixes are packed by shingle range; a shingle
   that only one class has in its prefix is dropped.  What is left, the postings, is
   a few per cent of the shingles; a class with too few of them cannot link to
   anything.
3. Groups.  A live class joins the group of the most frequent shingle in its
   postings, so copies of one text fall together; a large group is split into
   parts of about ``GROUP`` classes.
4. Inside groups.  Each part, with a few leaders of its whole group, is compared
   as one token-member matrix; components are formed.
5. Token-group matrix.  A class that a posting still shows in another component
   than most of that posting's classes is a query to the other groups of the
   posting.  Each group holds the union of its members' shingles; a query whose
   overlap with the union is below 0.75 of its size is turned away, the others
   open the group and are compared with its members.  Pairs inside one component
   are never looked at again, which is what keeps hot groups linear.

The order of shingles only steers the cost, never the result: the ``FREQUENT`` most
frequent shingles (counted over all data) come last.

Defined cases: null text or no words: empty set, linked with nothing, component is
the own id; null ids: component null; rows with equal ids are one vertex; an empty
table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm import rolling
from actuaria.llm.common import in_parts, read, release_after, staged
from actuaria.llm.components import components

#: Shingle length; size of a group part; frequent shingles that are told to every task.
WORDS, GROUP, LEADERS, FREQUENT = 5, 512, 32, 1 << 15
#: Prefix entries per shingle range, salts of the frequent shingles, bits of the live-class filter,
#: queries that share one copy of a group.
ENTRIES, SALTS, BLOOM_BITS, QUERIES = 1 << 20, 64, 1 << 26, 1024
#: Bytes that are hashed at a time.
SLICE = 1 << 20

_FACTOR = np.random.default_rng(21).integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = rolling.VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text."""
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= SLICE:
            out += _sets(part)
            part, size = [], 0
    return out + (_sets(part) if part else [])


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ranges = rolling.Prefixes(raw, _VALUE, SLICE)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # word starts and ends in turn
    start, end = edge[::2], edge[1::2]
    words = ranges(start, end)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bound = np.searchsorted(start, first)
    n = max(len(words) - WORDS + 1, 0)
    sliding = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        sliding += words[j:j + n] * _FACTOR[j]
    sliding = rolling.mix(sliding)
    sets = []
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= WORDS:
            sets.append(np.unique(sliding[a:b - WORDS + 1]))
        elif b > a:
            whole = (words[a:b] * _FACTOR[:b - a]).sum(dtype=np.uint64) ^ _FACTOR[WORDS] >> np.uint64(b - a)
            sets.append(rolling.mix(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def _distinct(ids: list, sets: list[np.ndarray]) -> dict[bytes, int]:
    """First row of each distinct non-empty set of a batch."""
    first: dict[bytes, int] = {}
    for i, s in enumerate(sets):
        if len(s) and ids[i] is not None:
            first.setdefault(signature(s), i)
    return first


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _batch_sets(batch: pa.RecordBatch) -> tuple[list, list[np.ndarray]]:
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
    return batch.column("id").to_pylist(), shingle_sets(texts)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


# ---- pass 1: sizes and signatures of all documents, counts of repeated shingles

def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        ids, sets = _batch_sets(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(ids), pa.int64())],
            names=["id", "n", "sig", "shingle"])
        own = [sets[i] for i in _distinct(ids, sets).values()]
        if not own:
            continue
        shingles = np.sort(np.concatenate(own))
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        count = np.diff(np.append(first, len(shingles)))
        often = count > 1  # repeated within this batch: the frequent ones are
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(int(often.sum()), pa.int64()), pa.array(count[often], pa.int64()),
             pa.nulls(int(often.sum()), pa.binary()), _long(shingles[first[often]])],
            names=["id", "n", "sig", "shingle"])


# ---- pass 2: prefixes, packed by shingle range

def in_order(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the common order, and each shingle's rank among the frequent ones (0: not frequent)."""
    at = np.searchsorted(frequent, s)
    at[at == len(frequent)] = 0
    r = np.where(frequent[at] == s, rank[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
    order = np.lexsort((s, r))
    return s[order], r[order]


def shared_least(n):
    """How many shingles of their prefixes two linked sets share at least, if the smaller has ``n``.

    One is enough for a right result; asking for a twelfth with a prefix longer by as much turns away
    texts that only share a passage."""
    return 1 + n // 12


def prefix_length(n: int) -> int:
    return min(n, n - -(-75 * n // 100) + shared_least(n))


def early_length(n: int) -> int:
    """The part of the prefix that matters if the set is the smaller one: 6 / 7 of it must be shared."""
    return min(n, n - -(-6 * n // 7) + shared_least(n))


def _prefixes(frequent: np.ndarray, rank: np.ndarray, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, sets = _batch_sets(batch)
            rows = sorted(_distinct(ids, sets).values(), key=lambda i: ids[i])
            if not rows:
                continue
            parts = []
            for k, i in enumerate(rows):
                s, r = in_order(sets[i], frequent, rank)
                p = prefix_length(len(s))
                parts.append((s[:p], r[:p], np.full(p, k), np.arange(p) < early_length(len(s))))
            shingle, often, who, early = (np.concatenate(x) for x in zip(*parts))
            node = np.array([ids[i] for i in rows], dtype=np.int64)
            size = np.array([len(sets[i]) for i in rows], dtype=np.int32)
            where = rolling.spread(shingle, ranges)
            where[often > 0] = -1 - node[who[often > 0]] % SALTS
            order = np.argsort(where, kind="stable")  # within a range: by class, then in the common order
            for at in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                used, first, count = np.unique(who[at], return_index=True, return_counts=True)
                soon = np.add.reduceat(early[at].astype(np.int32), first).astype(np.int32)
                rare = where[at[0]] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where[at[0]]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        shingle[at], often[at[:0] if rare else at].astype(np.uint16), node[used], size[used],
                        count.astype(np.int32), soon))],
                    names=["range", "shingle", "often", "node", "size", "count", "early"])
    return run


PACKED = "range bigint, shingle binary, often binary, node binary, size binary, count binary, early binary"
POSTINGS = "shingle bigint, often int, node bigint, size int"


def _postings(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    out = _range_postings(key, table)
    release_after(table)
    return out


def _range_postings(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Postings of one range: entries whose shingle another class of a fitting size has in its prefix.

    Ranges below 0 hold salted frequent shingles, which are all kept."""
    cols = {c: [] for c in ("shingle", "often", "node", "size", "early")}
    for r in table.to_pylist():
        n = np.frombuffer(r["count"], np.int32)
        cols["shingle"].append(np.frombuffer(r["shingle"], np.uint64))
        cols["often"].append(np.frombuffer(r["often"], np.uint16) if r["often"] else np.zeros(n.sum(), np.uint16))
        cols["node"].append(np.repeat(np.frombuffer(r["node"], np.int64), n))
        cols["size"].append(np.repeat(np.frombuffer(r["size"], np.int32), n))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cols["early"].append(place < np.repeat(np.frombuffer(r["early"], np.int32), n))
    c = {k: np.concatenate(v) for k, v in cols.items()}
    if key[0].as_py() >= 0:
        order = np.lexsort((c["size"], c["shingle"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.concatenate([[True], c["shingle"][1:] != c["shingle"][:-1]])
        # the neighbour in size must fit, and a list must hold the shingle early somewhere
        fits = ~new[1:] & (4 * c["size"][:-1].astype(np.int64) >= 3 * c["size"][1:].astype(np.int64))
        keep = np.zeros(len(new), dtype=bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        run = np.cumsum(new) - 1
        keep &= (np.bincount(run, weights=c["early"]) > 0)[run]
        c = {k: v[keep] for k, v in c.items()}
    return pa.table({"shingle": _long(c["shingle"]), "often": pa.array(c["often"].astype(np.int32)),
                     "node": pa.array(c["node"]), "size": pa.array(c["size"])})


def need(size: str = "size"):
    """Least number of postings that a class linked with another one shares with it."""
    return 1 + F.floor(F.ceil(F.col(size) * 75 / 100) / 12)


# ---- comparing

class Forest:
    """Union-find over the members of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.Table:
        linked = [(x, self.root(x)) for x in self.up if self.root(x) != x]
        return pa.table({"a": pa.array([x for x, _ in linked], pa.int64()),
                         "b": pa.array([r for _, r in linked], pa.int64())})


def linked(common: np.ndarray, n_a, n_b) -> np.ndarray:
    return 100 * common >= 75 * (n_a + n_b - common)


class TokenGroup:
    """A group's token union, and for each token of it the members that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.union, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))

    def overlaps(self, query: np.ndarray, opens=None) -> np.ndarray | None:
        """Common shingles with each member; None if the overlap with the union is too small."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if 4 * len(at) < 3 * len(query):
            return None
        n = self.first[at + 1] - self.first[at]
        index = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[index], minlength=len(self.size))


def _inside(table: pa.Table) -> pa.Table:
    out = _group_links(table)
    release_after(table)
    return out


def _group_links(table: pa.Table) -> pa.Table:
    """Edges of a spanning forest of the links between the members of one group part."""
    node = table.column("node").to_pylist()
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("shingles")]
    forest, group = Forest(), TokenGroup(sets)
    for i, s in enumerate(sets):
        common = group.overlaps(s)
        for j in np.flatnonzero(linked(common, len(s), group.size)):
            if j < i:
                forest.join(node[i], node[j])
    return forest.edges()


def _across(queries: pa.Table, members: pa.Table) -> pa.Table:
    out = _query_links(queries, members)
    release_after(queries, members)
    return out


def _query_links(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Edges between queries and the members of the group that they open."""
    forest = Forest()
    if len(queries) and len(members):
        node = members.column("node").to_pylist()
        group = TokenGroup([np.frombuffer(b.as_py(), np.uint64) for b in members.column("shingles")])
        for q, b in zip(queries.column("q_node").to_pylist(), queries.column("q_shingles")):
            s = np.frombuffer(b.as_py(), np.uint64)
            common = group.overlaps(s)
            if common is not None:
                for j in np.flatnonzero(linked(common, len(s), group.size)):
                    forest.join(q, node[j])
    return forest.edges()


# ---- the join

def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of (node): a fixed number of bits, whatever the corpus."""
    h = ids.select(F.explode(F.array(F.xxhash64("node"), F.xxhash64("node", F.lit(1)))).alias("h"))
    h = h.select(F.pmod("h", F.lit(BLOOM_BITS)).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BLOOM_BITS >> 6, dtype=np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _maybe(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose id (hashed in h0, h1) may be in the filter; a later join decides."""
    def hit(name: str) -> np.ndarray:
        h = np.mod(batch.column(name).to_numpy(), len(bits) << 6)
        return (bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
    return batch.filter(pa.array(hit("h0") & hit("h1")))


def _live_sets(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            batch = _maybe(bits, batch)
            if batch.num_rows:
                ids, sets = _batch_sets(batch)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                    [s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])
    return run


def _chosen_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` of roughly the given nodes, so that the later joins need not move the others."""
    bits = _id_filter(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield _maybe(bits, batch).select(["node", "shingles"])

    return (sets.select("node", "shingles", F.xxhash64("node").alias("h0"), F.xxhash64("node", F.lit(1)).alias("h1"))
            .mapInArrow(run, "node bigint, shingles binary"))


def _grouped(postings: DataFrame) -> DataFrame:
    """(node, size, group, alone, parts, token, leads): the group part of every live class."""
    own = postings.groupBy("node", "size").agg(F.max(F.struct("often", "shingle")).alias("t")).select(
        "node", "size", F.col("t.shingle").alias("token"))
    parts = (own.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
             .select("token", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"),
                     F.ceil(F.col("n") / LEADERS).alias("of"), (F.col("n") == 1).alias("alone")))
    joined = own.join(parts, "token")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    leads = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("of")) == 0, F.lit(False))
    return joined.select("node", "size", "token", "parts", "alone", F.xxhash64("token", part).alias("group"),
                         leads.alias("leads"))


def _first_links(sets: DataFrame) -> DataFrame:
    """Links inside group parts, with the leaders of a split group in all of its parts."""
    all_parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                            lambda p: F.xxhash64(F.col("token"), p.cast("bigint")))
    at = F.when(F.col("leads"), F.array_union(F.array("group"), all_parts)).otherwise(F.array("group"))
    return (sets.filter(~F.col("alone")).select(F.explode(at).alias("group"), "node", "shingles").groupBy("group")
            .applyInArrow(_inside, "a bigint, b bigint"))


def _queries(postings: DataFrame, info: DataFrame) -> DataFrame:
    """(node, group): classes to compare with other groups, because postings hold several components.

    Two linked classes share at least ``need`` postings; in at least half of these the same one of them
    is not in the posting's main component, so asking for half as many common postings loses no link."""
    p = postings.select("shingle", "node").join(info, "node")
    sizes = p.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component")).alias("top"))
    mixed = mixed.filter("k > 1").select("shingle", F.col("top.component").alias("main"))
    p = staged(p.join(mixed, "shingle"), "jaccard-mixed")
    targets = p.groupBy("shingle", "group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    asks = p.filter("component <> main").select("shingle", "node", "size", F.col("group").alias("home"), "component")
    return (asks.join(targets, "shingle")
            .filter("home <> group AND NOT (low = component AND high = component)")
            .groupBy("node", "size", "group").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= F.ceil(need() / 2)).select("node", "group"))


def _second_links(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the queries and the groups they open; a group asked by many is copied per chunk of queries."""
    queries = staged(queries, "jaccard-queries")
    asked = queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    asked = staged(asked, "jaccard-asked")
    home = sets.select("node", "group").join(asked, "group")
    sets = _chosen_sets(sets, queries.select("node").unionByName(home.select("node")))
    left = (queries.join(sets.select("node", "shingles"), "node").join(asked, "group")
            .select(F.col("group").alias("at"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("part"),
                    F.col("node").alias("q_node"), F.col("shingles").alias("q_shingles")))
    right = (sets.join(home, "node")
             .select(F.col("group").alias("group"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                     F.col("node").alias("node"), F.col("shingles").alias("shingles")))
    return left.groupBy("at", "part").cogroup(right.groupBy("group", "chunk")).applyInArrow(
        _across, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row."""
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
    survey = staged(rows.mapInArrow(_survey, "id bigint, n bigint, sig binary, shingle bigint"), "jaccard-survey")
    members = survey.filter(F.col("shingle").isNull()).select("id", "n", "sig")
    counts = survey.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toArrow()
    frequent = top.column("shingle").to_numpy().view(np.uint64)
    rank = len(frequent) - np.arange(len(frequent))  # the most frequent shingle is last in the order
    by_value = np.argsort(frequent)
    frequent, rank = frequent[by_value], rank[by_value]
    # equal sets are one class
    classes = staged(members.filter(F.col("sig").isNotNull() & F.col("id").isNotNull())
                     .groupBy("sig").agg(F.min("id").alias("class")), "jaccard-classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    ranges = max(64, -(-total // (4 * ENTRIES)))
    packed = rows.mapInArrow(_prefixes(frequent, rank, ranges), PACKED)
    found = packed.groupBy("range").applyInArrow(_postings, POSTINGS)
    named = members.join(classes, "sig").select(F.col("id").alias("node"), "class").distinct()
    postings = staged(found.join(named, "node").select("shingle", "often", "size", F.col("class").alias("node"))
                      .distinct(), "jaccard-found")
    enough = postings.groupBy("node", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need())
    postings = staged(postings.join(enough.select("node", "size"), ["node", "size"]), "jaccard-postings")
    groups = staged(_grouped(postings), "jaccard-groups")
    bits = _id_filter(groups)
    sets = (rows.select("id", "text", F.xxhash64("id").alias("h0"), F.xxhash64("id", F.lit(1)).alias("h1"))
            .filter(F.col("id").isNotNull()).mapInArrow(_live_sets(bits), "id bigint, shingles binary"))
    sets = staged(sets.withColumnRenamed("id", "node").join(groups, "node"), "jaccard-sets")
    first = staged(_first_links(sets), "jaccard-links")
    half = components(first).withColumnRenamed("id", "node")
    info = groups.select("node", "size", "group").join(half, "node", "left").select(
        "node", "size", "group", F.coalesce("component", "node").alias("component"))
    second = _second_links(_queries(postings, staged(info, "jaccard-info")), sets)
    whole = components(staged(first.unionByName(second), "jaccard-links"))
    of = named_components(classes, whole)
    return (members.join(of, "sig", "left")
            .select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id")))


def named_components(classes: DataFrame, whole: DataFrame) -> DataFrame:
    """(sig, component): the component of every class."""
    return classes.join(whole.withColumnRenamed("id", "class"), "class", "left").select(
        "sig", F.coalesce("component", "class").alias("component"))


def join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))
