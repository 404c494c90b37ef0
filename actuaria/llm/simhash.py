"""SimHash near-duplicates by the generalised pigeonhole principle (operator 13).

A text's fingerprint has a bit set where more than half of its three-word shingles (repeats
included) have that bit set in their 64-bit hash; fingerprints link at ``RADIUS`` or fewer
differing bits, and every document gets the smallest id it reaches through links.

1. Fingerprints of whole texts, one task per part of the table; equal fingerprints are one
   class, named by its least id, so copies cost nothing further.
2. Bits that are correlated over all classes are grouped: ``m`` partitions of 64 / m bits each.
   If the thresholds of the partitions add up to RADIUS - m + 1 (a threshold of -1 leaves a
   partition out), two linked fingerprints are within the threshold in one of them.
3. Every class gets thresholds of its own: dynamic programming over the partitions takes the
   allocation with the fewest estimated candidates, from counts of all classes' values folded
   to ``CELLS`` cells per partition.  A class in a dense neighbourhood (values that many
   classes share in every partition) takes the whole fingerprint as its one partition instead,
   with 2,081 exact values to probe; so no class costs more than about that many probes,
   however many near copies it has.
4. Probe (partition, value) against the classes' values, verify the distance, join the links
   to components.

``m`` is chosen among 2, 3 and 4 by the estimate for the whole table, so partitions grow
wider with the number of classes.

Defined cases: null text or no words: fingerprint zero, linked like any other; a null id
keeps its fingerprint, links with nothing and has a null component; rows with equal ids are one
vertex; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm.common import SEED, in_parts, read, staged
from actuaria.llm.components import components

#: Words per shingle, differing bits of a link, bits of a fingerprint, cells that a partition's values are folded to.
WORDS, RADIUS, BITS, CELLS = 3, 2, 64, 1 << 16
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Weight of a probe against a candidate (a probe is shuffled, a candidate only compared).
PROBE = 4.0
WHOLE = -1


# ---- fingerprints

def _pieces(raw: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time; no word is cut."""
    left = b""
    for at in range(0, len(raw), size):
        part = left + raw[at:at + size]
        if at + size < len(raw):
            cut = max(part.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                left = part
                continue
            part, left = part[:cut], part[cut:]
        yield part.split()


def shingle_hashes(raw: bytes, size: int = SLICE) -> Iterator[list[int]]:
    """XXH64 of the shingles of a text in order, a slice at a time."""
    from xxhash import xxh64_intdigest as digest
    carry: list[bytes] = []
    any_shingle = False
    for words in _pieces(raw.lower(), size):
        words = carry + words
        if len(words) >= WORDS:
            any_shingle = True
            yield [digest(b" ".join(w), SEED) for w in zip(words, words[1:], words[2:])]
            carry = words[-(WORDS - 1):]
        else:
            carry = words
    if carry and not any_shingle:
        yield [digest(b" ".join(carry), SEED)]


def fingerprint(raw: bytes, size: int = SLICE) -> int:
    """Bits that are set in more than half of the shingle hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(raw, size):
        h = np.array(hashes, dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        prints = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["id", "print"])


# ---- partitions of correlated bits

def bits_of(prints: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones, least bit first."""
    return np.unpackbits(prints.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of all pairs of bits of a part (one row)."""
    total, n = np.zeros((BITS, BITS)), 0
    for batch in in_parts(batches, 1 << 15):
        b = bits_of(batch.column("print").to_numpy().view(np.uint64)).astype(np.float32)
        total += b.T @ b
        n += len(b)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([total.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], names=["n", "gram"])


def bit_correlations(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes, and the correlation of every pair of bits over all of them (64 x 64, any table size)."""
    parts = classes.select("print").mapInArrow(_gram, "n bigint, gram array<bigint>")
    n = parts.agg(F.sum("n")).first()[0] or 0
    cells = parts.select(F.posexplode("gram").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros(BITS * BITS)
    gram[cells.column("at").to_numpy()] = cells.column("v").to_numpy()
    gram = gram.reshape(BITS, BITS) / max(n, 1)
    p = np.diag(gram)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, np.abs((gram - np.outer(p, p)) / np.outer(sd, sd))


def correlated_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of nearly equal size; each grows by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        rest = sorted(left)
        sub = correlation[np.ix_(rest, rest)] - np.eye(len(rest))
        group = [rest[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < size:
            others = sorted(left - set(group))
            group.append(others[int(np.argmax(correlation[np.ix_(others, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def values_of(prints: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(partitions, n) values of the fingerprints in each partition."""
    b = bits_of(prints)
    return np.stack([b[:, g].astype(np.uint64) @ (np.uint64(1) << np.arange(len(g), dtype=np.uint64)) for g in groups])


def fold(values: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Cells of values: flipping one bit of a value flips one bit of its cell."""
    width = cells.bit_length() - 1
    out = values & np.uint64(cells - 1)
    for shift in range(width, BITS, width):
        out = out ^ (values >> np.uint64(shift) & np.uint64(cells - 1))
    return out.astype(np.int64)


def cell_counts(classes: DataFrame, groups: list[list[int]], cells: int = CELLS) -> np.ndarray:
    """(partitions, cells) how many classes fold to each cell; a fixed size, whatever the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), cells), dtype=np.int64)
        for batch in in_parts(batches, 1 << 15):
            for k, v in enumerate(values_of(batch.column("print").to_numpy().view(np.uint64), groups)):
                total[k] += np.bincount(fold(v, cells), minlength=cells)
        part, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cell), pa.array(total[part, cell])],
                                         names=["part", "cell", "n"])
    found = (classes.select("print").mapInArrow(run, "part bigint, cell bigint, n bigint")
             .groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros((len(groups), cells), dtype=np.int64)
    out[found.column("part").to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


# ---- thresholds

def estimates(counts: np.ndarray, widths: list[int], cells: int = CELLS) -> np.ndarray:
    """(partition, threshold 0..RADIUS, cell): probes and estimated candidates of a value of that cell.

    What a cell holds beyond the mean is taken to share one value; the mean is spread over the values that fold to it."""
    out = []
    at = np.arange(cells)
    for row, width in zip(counts, widths):
        mean, spread = row.sum() / cells, 2.0 ** max(0, width - cells.bit_length() + 1)
        here = np.maximum(row - mean, 0) + np.minimum(row, mean) / spread
        folded = min(width, cells.bit_length() - 1)
        times = width / folded  # bits of the value for each bit of the cell
        one = sum(here[at ^ (1 << b)] for b in range(folded)) * times
        two = sum(here[at ^ (1 << a) ^ (1 << b)] for a, b in combinations(range(folded), 2)) * times ** 2
        probes = np.cumsum([1.0, width, width * (width - 1) / 2]) * PROBE
        out.append(np.stack([here, here + one, here + one + two])[:RADIUS + 1] + probes[:RADIUS + 1, None])
    return np.stack(out)


def allocate(cost: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (n, partitions) of least total cost that add up to ``target``, and their cost.

    ``cost`` is (partitions, thresholds 0.., n); a threshold of -1 costs nothing.  ``best[s]`` is the least cost
    of the partitions so far with thresholds that add up to s."""
    m, top, n = cost.shape
    best = {0: np.zeros(n)}
    steps = []
    for k in range(m):
        new: dict[int, np.ndarray] = {}
        took: dict[int, np.ndarray] = {}
        for s, c in best.items():
            for t in range(-1, top):
                total = c + (cost[k, t] if t >= 0 else 0.0)
                to = s + t
                if to not in new:
                    new[to], took[to] = total, np.full(n, t)
                else:
                    less = total < new[to]
                    new[to] = np.where(less, total, new[to])
                    took[to] = np.where(less, t, took[to])
        best = new
        steps.append(took)
    out = np.zeros((n, m), dtype=np.int64)
    s = np.full(n, target)
    for k in range(m - 1, -1, -1):
        for value, took in steps[k].items():
            at = s == value
            out[at, k] = took[at]
        s -= out[:, k]
    return out, best[target]


def flips(width: int, threshold: int) -> np.ndarray:
    """All masks of up to ``threshold`` bits out of ``width``."""
    return np.array([sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(range(width), t)],
                    dtype=np.uint64)


DENSE = PROBE * len(flips(BITS, RADIUS))


class Plan:
    """Partitions of one table and the estimates its classes take their thresholds from (a fixed size)."""

    def __init__(self, groups: list[list[int]], counts: np.ndarray, cells: int = CELLS, dense: float = DENSE):
        self.groups, self.cells, self.dense = groups, cells, dense
        self.cost = estimates(counts, [len(g) for g in groups], cells).astype(np.float32)

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, thresholds, dense): of each fingerprint; dense ones take the whole fingerprint instead."""
        values = values_of(prints, self.groups)
        cost = np.stack([c[:, fold(v, self.cells)] for c, v in zip(self.cost, values)]).astype(np.float64)
        chosen, total = allocate(cost, RADIUS - len(self.groups) + 1)
        return values, chosen, total > self.dense

    def expected(self, counts: np.ndarray) -> float:
        """Estimated cost of the whole table, from the cells of each partition alone."""
        m = len(self.groups)
        mean = np.stack([(c * n).sum(axis=1) / max(n.sum(), 1) for c, n in zip(self.cost, counts)])
        return float(min(allocate(mean[:, :, None], RADIUS - m + 1)[1][0], self.dense))


def plan_for(classes: DataFrame, sizes: tuple = (2, 3, 4)) -> Plan:
    """The plan with the least estimated cost among the numbers of partitions."""
    _, correlation = bit_correlations(classes)
    best = None
    for m in sizes:
        groups = correlated_groups(correlation, m)
        counts = cell_counts(classes, groups)
        plan = Plan(groups, counts)
        cost = plan.expected(counts)
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


# ---- probe and verify

ENTRY = "part int, value bigint, print bigint, node bigint"


def _rows(part: int, value: np.ndarray, batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
    take = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(value.view(np.int64)),
         batch.column("print").take(take), batch.column("node").take(take)], names=["part", "value", "print", "node"])


def _index(plan: Plan):
    """Every class under its value in each partition, and under its whole fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1 << 15):
            prints = batch.column("print").to_numpy().view(np.uint64)
            everyone = np.arange(len(prints))
            for k, v in enumerate(values_of(prints, plan.groups)):
                yield _rows(k, v, batch, everyone)
            yield _rows(WHOLE, prints, batch, everyone)
    return run


def _probes(plan: Plan, rows: int = 1 << 13):
    """Every class under the values within its threshold of its own, in each partition that it uses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, rows):
            prints = batch.column("print").to_numpy().view(np.uint64)
            values, chosen, dense = plan.thresholds(prints)
            for k, group in enumerate(plan.groups):
                for t in range(RADIUS + 1):
                    at = np.flatnonzero((chosen[:, k] == t) & ~dense)
                    masks = flips(len(group), t)
                    for some in np.array_split(at, max(1, len(at) * len(masks) >> 20)):
                        if len(some):
                            yield _rows(k, (values[k, some][:, None] ^ masks).ravel(), batch, np.repeat(some, len(masks)))
            at, masks = np.flatnonzero(dense), flips(BITS, RADIUS)
            for some in np.array_split(at, max(1, len(at) * len(masks) >> 20)):
                if len(some):
                    yield _rows(WHOLE, (prints[some][:, None] ^ masks).ravel(), batch, np.repeat(some, len(masks)))
    return run


def links(classes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): the linked pairs of different classes."""
    index = classes.mapInArrow(_index(plan), ENTRY)
    probes = classes.mapInArrow(_probes(plan), ENTRY).withColumnsRenamed({"print": "p_print", "node": "p_node"})
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("p_print"))) <= RADIUS
    return (probes.join(index, ["part", "value"]).filter((F.col("node") != F.col("p_node")) & near)
            .select(F.greatest("node", "p_node").alias("a"), F.least("node", "p_node").alias("b")))


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint and component_id of every row."""
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"))
    prints = staged(rows.mapInArrow(_fingerprint_rows, "id bigint, print bigint"), "simhash-prints")
    named = prints.filter(F.col("id").isNotNull())
    classes = staged(named.groupBy("print").agg(F.min("id").alias("node")), "simhash-classes")
    # rows that share an id are one vertex, whatever their fingerprints
    same = (named.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
            .join(named.distinct(), "id").join(classes, "print").select(F.col("id").alias("a"), F.col("node").alias("b")))
    edges = staged(links(classes, plan_for(classes)).unionByName(same), "simhash-links")
    of = (classes.join(components(edges).withColumnRenamed("id", "node"), "node", "left")
          .select("print", F.coalesce("component", "node").alias("component")))
    return prints.join(of, "print", "left").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return near_components(read(spark, sf_dir, "documents", "doc_id", "text"))
