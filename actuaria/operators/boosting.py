"""Boosted regression trees on binned rows, many models grown together (M3–M5, M7, M9).

Rows are binned once (at most 256 bins a feature) and packed into blocks.  All models of a call
(draws, folds, families) grow level by level in step: one aggregate per tree level sums the
histograms (gradient sum and count by model, node, feature, bin) of all of them.  Only
the smaller child of a split is summed; its sibling is the parent's histogram less that.  Per model: L1 and L2
penalties on leaf weights (soft-thresholded), rows and columns drawn per tree, a leaf
budget filled best split first, and a least row count that a node must have to be split.

Sums are exact.  Residuals are rounded to multiples of a power of two that lets no sum of a
block leave the exact range of a double, nor a total that of a 64-bit integer; so a tree does not depend
on how rows are dealt over tasks, nor on which of the two ways of growing it comes from:

* ``grow_levels``: rows stay distributed; per level one job, whose tasks sum the histograms of their rows; the driver
  adds these up and takes the splits.
* ``grow_whole``: where the packed table is below ``WHOLE_BYTES`` (checked), it is broadcast and
  the models are dealt over tasks, which saves a job per level: thousands for a search.  A task works on
  ``PART_ROWS`` rows and ``PAIRS`` rows x models at a time, so that what it reads and writes stays in the processor's
  cache; all nodes of a level, of all models in step, take the same few array operations.

Rows without a label or key take no part in fitting; a null or NaN feature value lies right of every split.
"""
from __future__ import annotations

import ctypes
import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.operators.quantiles import percentiles_long, to_long
from actuaria.session import ensure_checkpoint_dir, scratch_path

#: Bins of a feature, rows of a block, size up to which the packed table is broadcast, least gain of a split.
MAX_BINS, BLOCK_ROWS, WHOLE_BYTES, LEAST_GAIN = 256, 1 << 18, 64 << 20, 1e-6
#: Nodes of a level (over all models) and rows x models that are worked on at once in a task.
NODES, CELLS = 2048, 1 << 20
#: Combinations that features share one joint code for; rows, and rows x models, that a task works on at once.
JOINT, PART_ROWS, PART_CELLS = 2048, 1 << 17, 1 << 20
#: Rows x models that a task with the whole table grows in step, nodes whose splits are sought at once.
PAIRS, SOUGHT = 1 << 17, 32
#: Rows a node, on the average, up to which they are summed feature by feature.
SLIM = 400
#: Trees after which distributed predictions are written to the shared folder.
LINEAGE = 25
NO_FOLD = 255


@dataclass(frozen=True)
class Spec:
    """One model: what is grown and on which rows (those of ``fold`` are held out)."""
    rounds: int
    depth: int
    rate: float
    subsample: float = 1.0
    columns: float = 1.0
    alpha: float = 0.0
    lam: float = 0.0
    leaves: int = 0
    min_split: int = 2
    min_leaf: int = 1
    seed: int = 42
    fold: int = NO_FOLD


def spec_for(style: str, params: dict, seed: int = 42, fold: int = NO_FOLD) -> Spec:
    """The spec of a family's parameters; what is not given has the family's default.

    ``subsample`` of the leaf-wise family is honoured as drawn rows per tree."""
    get = params.get
    common = {"subsample": float(get("subsample", 1.0)), "seed": seed, "fold": fold}
    if style == "xgboost":
        return Spec(int(get("n_estimators", 100)), int(get("max_depth", 6)), float(get("learning_rate", 0.3)),
                    columns=float(get("colsample_bytree", 1.0)), alpha=float(get("reg_alpha", 0)),
                    lam=float(get("reg_lambda", 1)), **common)
    if style == "lightgbm":
        return Spec(int(get("n_estimators", 100)), int(get("max_depth", 7)), float(get("learning_rate", 0.1)),
                    alpha=float(get("reg_alpha", 0)), lam=float(get("reg_lambda", 0)),
                    leaves=int(get("num_leaves", 31)), min_leaf=int(get("min_child_samples", 20)), **common)
    if style == "gradient_boosting":
        return Spec(int(get("n_estimators", 100)), int(get("max_depth", 3)), float(get("learning_rate", 0.1)),
                    min_split=int(get("min_samples_split", 2)), **common)
    raise ValueError(f"unknown family {style!r}")


# ---- binned rows

@dataclass
class Rows:
    """Packed rows: bin codes (n, features), labels, a hash of the key, fold."""
    codes: np.ndarray
    y: np.ndarray
    mark: np.ndarray
    fold: np.ndarray

    def __len__(self) -> int:
        return len(self.y)


@dataclass
class Binned:
    """A binned table: blocks in the shared folder, cuts of each feature, and what all models need to know of the labels."""
    blocks: DataFrame
    features: list[str]
    cuts: list[np.ndarray]
    n: int
    scale: float
    means: dict[int, float] = field(default_factory=dict)  # fold held out -> mean label of the others

    @property
    def widths(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    @property
    def n_bytes(self) -> int:
        return self.n * (len(self.features) + 17)


def fit_cuts(rows: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cuts of each feature: halfway between neighbouring values, or quantiles where there are more than ``bins`` values."""
    values = to_long(rows.select(*features), features).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    count = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f in features if count.get(f, 0) <= bins]
    seen: dict[str, list[float]] = {f: [] for f in features}
    if few:
        for r in values.where(F.col("column").isin(few)).select("column", "value").collect():  # at most ``bins`` a feature
            seen[r["column"]].append(r["value"])
    many = [f for f in features if f not in few]
    if many:
        at = [k / bins for k in range(1, bins)]
        for r in percentiles_long(to_long(rows.select(*many), many), at, ["column"]).collect():
            seen[r["column"]].append(r["value"])
    out = []
    for f in features:
        v = np.unique(np.array(seen[f], dtype=np.float64))
        out.append(v if f in many else (v[:-1] + v[1:]) / 2)
    return out


def code_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin of each value: how many cuts lie below it (NaN: all)."""
    return np.searchsorted(cuts, values, side="left").astype(np.uint8)


BLOCK = "n int, codes binary, y binary, mark binary, fold binary"


def _pack(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            codes = np.stack([code_of(t.column(f"f{k}").to_numpy(), c) for k, c in enumerate(cuts)], axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(codes)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                    codes, t.column("y").to_numpy(), t.column("mark").to_numpy(),
                    t.column("fold").to_numpy().astype(np.uint8)))], names=["n", "codes", "y", "mark", "fold"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(held)
    return run


def bin_rows(train: DataFrame, features: list[str], target: str, key: str, fold: str | None = None,
             bins: int = MAX_BINS) -> Binned:
    """Bin and pack the rows; two passes over them (values, then codes), the blocks are written once."""
    features = list(features)
    y, held = F.col(target).cast("double"), F.col(fold).cast("int") if fold else F.lit(NO_FOLD)
    rows = train.where(y.isNotNull() & ~F.isnan(y) & F.col(key).isNotNull()).select(
        *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"f{k}") for k, f in enumerate(features)],
        y.alias("y"), F.xxhash64(F.col(key)).alias("mark"), held.alias("fold"))
    rows = rows.checkpoint(eager=True)
    names = [f"f{k}" for k in range(len(features))]
    cuts = fit_cuts(rows, names, bins)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    n, reach = found["n"], 4 * max((found["hi"] or 0.0) - (found["lo"] or 0.0), 1e-9)
    bits = min(61 - np.log2(reach * max(n, 1)), 52 - np.log2(reach * min(max(n, 1), BLOCK_ROWS * 16)))
    scale = float(2.0 ** np.floor(bits))
    path = scratch_path(train.sparkSession, "boost-blocks")
    rows.mapInArrow(_pack(cuts), BLOCK).write.parquet(path)
    blocks = train.sparkSession.read.schema(BLOCK).parquet(path)
    lo = found["lo"] or 0.0
    sums = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round((F.col("y") - lo) * scale).cast("decimal(38,0)")).alias("s")).collect()}
    total, all_s = sum(c for c, _ in sums.values()), sum(int(s) for _, s in sums.values())
    means = {NO_FOLD: lo + all_s / scale / max(total, 1)}
    for f, (c, s) in sums.items():
        means[f] = means[NO_FOLD] if f == NO_FOLD else lo + (all_s - int(s)) / scale / max(total - c, 1)
    return Binned(blocks, features, cuts, n, scale, means)


def unpack(batch_rows: list[dict], n_features: int) -> Rows:
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in batch_rows] or [np.zeros(0, t)])
    return Rows(join("codes", np.uint8).reshape(-1, n_features), join("y", np.float64),
                join("mark", np.int64).view(np.uint64), join("fold", np.uint8))


# ---- growing

def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(by)
        x ^= x >> np.uint64(33)
    return x


def in_bag(rows: Rows, specs: list[Spec], tree: int) -> np.ndarray:
    """(models, rows): rows that a model's tree is grown on; drawn by a hash of key, seed and tree."""
    out = np.empty((len(specs), len(rows)), dtype=bool)
    drawn: dict[int, np.ndarray] = {}
    for m, s in enumerate(specs):
        out[m] = (rows.fold != s.fold) | (s.fold == NO_FOLD)
        if s.subsample < 1:
            if s.seed not in drawn:
                salt = _mix(np.array([s.seed * 1_000_003 + tree], dtype=np.uint64))
                drawn[s.seed] = _mix(rows.mark ^ salt) >> np.uint64(11)
            out[m] &= drawn[s.seed] < np.uint64(int(s.subsample * (1 << 53)))
    return out


def drawn_columns(specs: list[Spec], n_features: int, tree: int) -> np.ndarray:
    """(models, features): columns that a model's tree may split on."""
    out = np.ones((len(specs), n_features), dtype=bool)
    order: dict[int, np.ndarray] = {}
    for m, s in enumerate(specs):
        if s.columns < 1:
            if s.seed not in order:
                order[s.seed] = np.random.default_rng([s.seed, tree]).permutation(n_features)
            out[m, order[s.seed][max(1, int(s.columns * n_features)):]] = False
    return out


class Limits:
    """What the models' parameters say of splits, as arrays by model."""

    def __init__(self, specs: list[Spec]):
        of = lambda c, t: np.array([getattr(s, c) for s in specs], dtype=t)
        self.alpha, self.lam, self.rate = (of(c, np.float64) for c in ("alpha", "lam", "rate"))
        self.depth, self.min_leaf = of("depth", np.int64), of("min_leaf", np.int64)
        self.least = np.maximum(of("min_split", np.int64), 2 * self.min_leaf)


class Trees:
    """One tree of each model, as arrays by heap position (children of i: 2 i + 1 and 2 i + 2)."""

    def __init__(self, models: int, depth: int):
        self.size = (2 << depth) - 1
        shape = (models, self.size)
        self.feature, self.bin = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.gain, self.g, self.n = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)

    def set_children(self, m, at, g_left, n_left) -> None:
        for child, g, n in ((2 * at + 1, g_left, n_left), (2 * at + 2, self.g[m, at] - g_left, self.n[m, at] - n_left)):
            self.g[m, child], self.n[m, child] = g, n

    def keep_best(self, specs: list[Spec]) -> None:
        """Leaf budgets: splits are taken best gain first among the leaves that there are, until the budget is used.

        What a split gains does not depend on the order of the others, so the whole tree is known before."""
        for m, s in enumerate(specs):
            if s.leaves and (self.feature[m] >= 0).sum() + 1 > s.leaves:
                kept, left = [], s.leaves - 1
                gain, feature = self.gain[m].tolist(), self.feature[m].tolist()
                frontier = [(-gain[0], 0)]
                while frontier and left:
                    _, at = heapq.heappop(frontier)
                    kept.append(at)
                    left -= 1
                    for child in (2 * at + 1, 2 * at + 2):
                        if child < self.size and feature[child] >= 0:
                            heapq.heappush(frontier, (-gain[child], child))
                gone = np.ones(self.size, dtype=bool)
                gone[kept] = False
                self.feature[m, gone] = -1

    def weights(self, limits: Limits, scale: float) -> np.ndarray:
        """(models, positions) what a row that ends at a position adds to its prediction; positions below a leaf take its weight."""
        alpha, lam, rate = limits.alpha[:, None], limits.lam[:, None], limits.rate[:, None]
        w = rate * soft(self.g / scale, alpha) / np.maximum(self.n + lam, 1e-300)
        w[self.n == 0] = 0.0
        a, b = 0, 1
        while b < self.size:  # the positions of a level, then their children
            leaf = np.repeat(self.feature[:, a:b] < 0, 2, axis=1)
            np.copyto(w[:, b:2 * b + 1], np.repeat(w[:, a:b], 2, axis=1), where=leaf)
            np.copyto(self.feature[:, b:2 * b + 1], -1, where=leaf)
            a, b = b, 2 * b + 1
        return w


def soft(g: np.ndarray, alpha) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


class Cells:
    """Codes as growing reads them: by feature, and features that take few combinations together as one joint code.

    A sum over rows is taken once per joint code and then over the combinations of each bin; sums are exact, so they are the same."""

    def __init__(self, rows: Rows, widths: list[int]):
        most = min(JOINT, max(256, len(rows) // 32))
        self.codes = np.ascontiguousarray(rows.codes.T)
        self.starts = np.cumsum([0, *widths])
        self.each = (rows.codes + self.starts[:-1]).astype(np.uint16 if self.starts[-1] <= 1 << 16 else np.int64)
        joint: list[list] = []  # code of each row, number of combinations, features
        for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
            best = None
            for k, (code, size, _) in enumerate(joint):
                if not len(rows) or size * widths[f] > most << 8:
                    continue
                both = code * widths[f] + self.codes[f]
                there = np.bincount(both, minlength=size * widths[f]) > 0
                found = int(there.sum())
                if found <= most and (best is None or found / size < best[0]):
                    best = (found / size, k, both, there, found)
            if best is None:
                joint.append([self.codes[f].astype(np.int64), widths[f], [f]])
            else:
                _, k, both, there, found = best
                joint[k] = [(np.cumsum(there) - 1)[both], found, [*joint[k][2], f]]
        self.size = max((size for _, size, _ in joint), default=1)
        self.groups = []
        for code, size, features in joint:
            bins, orders, firsts, n = [], [], [], 0
            for f in features:
                bin_of = np.zeros(size, dtype=np.int64)
                bin_of[code] = self.codes[f]
                order = np.argsort(bin_of, kind="stable")
                there, first = np.unique(bin_of[order], return_index=True)
                bins.append(self.starts[f] + there)
                orders.append(order)
                firsts.append(n + first)
                n += size
            self.groups.append((code, *(np.concatenate(x) for x in (bins, orders, firsts))))

    def at(self, rows: np.ndarray, w: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(``n`` slots, bins of all features) sums of ``w`` and counts of the rows; ``slot`` says where each row belongs.

        Slots of few rows are summed feature by feature, which is then less work than the joint codes' combinations."""
        if len(rows) <= min(SLIM * n, PART_ROWS):
            at = self.each.take(rows, axis=0) + (slot * self.starts[-1])[:, None]
            w, at = np.repeat(w, at.shape[1]), at.ravel()
            g, found = (np.bincount(at, x, n * self.starts[-1]).reshape(n, -1) for x in (w, None))
            return g.astype(np.float64, copy=False), found  # without rows numpy counts in integers, whatever the weights
        out = np.zeros((n, self.starts[-1])), np.zeros((n, self.starts[-1]), np.int64)
        shift = slot * self.size
        for code, bins, order, first in self.groups:
            at = code.take(rows)
            at += shift
            for total, found in zip(out, (np.bincount(at, w, n * self.size), np.bincount(at, None, n * self.size))):
                total[:, bins] = np.add.reduceat(found.reshape(n, self.size).take(order, axis=1), first, axis=1)
        return out

    def sums(self, g: dict[int, np.ndarray], m: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, bins of all features) sums of ``g[m]`` and counts over the rows of each node."""
        return self.at(np.concatenate(lists), np.concatenate([g[x].take(here) for x, here in zip(m.tolist(), lists)]),
                       np.repeat(np.arange(len(lists)), [len(here) for here in lists]), len(lists))


def best_splits(hg: np.ndarray, hn: np.ndarray, slots: np.ndarray, limits: Limits, m: np.ndarray, columns: np.ndarray, scale: float,
                widths: list[int]):
    """(feature, bin, gain, left sum, left count) of the best split of the wanted slots; gain 0 where there is none.

    ``m``: the model of each wanted slot, ``columns`` by model.  Ties go to the first feature, then to the lowest bin."""
    starts = np.cumsum([0, *widths])
    feature_of = np.repeat(np.arange(len(widths)), widths)
    barred = ~columns[:, feature_of]
    barred[:, starts[1:] - 1] = True  # all rows on the left
    out = [np.zeros(len(m), t) for t in (np.int16, np.int16, np.float64, np.float64, np.int64)]
    for a in range(0, len(m), SOUGHT):
        b = min(a + SOUGHT, len(m))
        found = _best(*(h.take(slots[a:b], axis=0) for h in (hg, hn)), *(x[m[a:b]][:, None] for x in (limits.alpha, limits.lam, limits.min_leaf)),
                      barred[m[a:b]], scale, starts)
        for whole, part in zip(out, found):
            whole[a:b] = part
    top = out[0].astype(np.int64)
    out[1] -= np.where(top >= 0, starts[feature_of[top]], 0).astype(np.int16)
    out[0] = np.where(top >= 0, feature_of[top], -1).astype(np.int16)
    return out


def _best(hg: np.ndarray, hn: np.ndarray, alpha: np.ndarray, lam: np.ndarray, least: np.ndarray, barred: np.ndarray, scale: float,
          starts: np.ndarray):
    """(place or -1, place, gain, left sum, left count) of the best split of a few slots, whose histograms are written over.

    Sums stay multiples of ``1 / scale``, a power of two, which scales every step exactly."""
    g, n = (h[:, :starts[1]].sum(axis=1, dtype=np.float64)[:, None] for h in (hg, hn))
    alpha = alpha * scale

    def left(h, whole):  # running sums of each feature: the total is taken off where the next one starts
        out = h.astype(np.float64, copy=False)
        out[:, starts[1:-1]] -= whole
        return np.cumsum(out, axis=1, out=out)

    def score(x, b):
        if alpha.any():
            x = np.abs(x)
            x -= alpha
            np.maximum(x, 0.0, out=x)
            x *= x
        else:
            x = x * x
        x /= b + lam
        return x

    lg, ln = left(hg, g), left(hn, n)
    rn = n - ln
    with np.errstate(divide="ignore", invalid="ignore"):  # no rows on a side: barred below
        got = score(lg, ln)
        got += score(g - lg, rn)
        got -= score(g, n)
    np.minimum(ln, rn, out=rn)
    barred |= rn < np.maximum(least, 1)
    np.copyto(got, 0.0, where=barred)
    top = np.argmax(got, axis=1)
    every = np.arange(len(got))
    gain = got[every, top] / scale / scale
    found = gain > LEAST_GAIN
    take = lambda x: np.where(found, x, 0)
    return np.where(found, top, -1), take(top), take(gain), take(lg[every, top]), take(ln[every, top])


def residuals(rows: Rows, pred: np.ndarray, scale: float) -> np.ndarray:
    out = rows.y - pred
    out *= scale
    return np.rint(out, out=out)


def may_split(trees: Trees, limits: Limits, depth: int, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether nodes are looked at: depth, and the node's own row count."""
    return (trees.n[m, at] >= limits.least[m]) & (limits.depth[m] > depth)


@dataclass
class Part:
    """Some rows, how they are read, and the predictions (models, rows) so far.

    While a tree of each of some models grows, the place of every row in every one of them is one number: (the model, whether
    the row was drawn, heap position).  What holds for a node is looked up in a table of places."""
    rows: Rows
    cells: Cells
    pred: np.ndarray

    def start(self, specs: list[Spec], tree: int, models: np.ndarray, scale: float | None = None) -> None:
        """All rows stand at the root of ``models``; with ``scale``, rows are drawn for the tree and residuals taken."""
        own, n = [specs[x] for x in models], len(self.rows)
        self.models, self.size = models, (2 << max((s.depth for s in own), default=0)) - 1
        self.local = np.zeros(len(specs), np.int64)
        self.local[models] = np.arange(len(models))
        self.place = np.repeat(np.arange(len(models)) * (2 * self.size), n)
        self.row = np.tile(np.arange(n), len(models))
        if scale is not None:
            self.place += in_bag(self.rows, own, tree).ravel() * np.int64(self.size)
            self.g = residuals(self.rows, self.pred[models], scale).ravel()

    def places(self, m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of nodes: of rows that were not drawn, of drawn rows."""
        out = 2 * self.size * self.local[m] + at
        return out, out + self.size

    def sums(self, m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Histograms of the nodes (m, at)."""
        slot = np.full(2 * self.size * len(self.models), -1)
        slot[self.places(m, at)[1]] = np.arange(len(m))
        slot = slot.take(self.place)
        here = np.flatnonzero(slot >= 0)
        return self.cells.at(self.row.take(here), self.g.take(here), slot.take(here), len(m))

    def split(self, m: np.ndarray, at: np.ndarray, feature: np.ndarray, most: np.ndarray) -> None:
        size = 2 * self.size * len(self.models)
        first, last, child = np.zeros(size, np.int64), np.full(size, 255, np.uint8), np.arange(size)
        for place in self.places(m, at):
            first[place], last[place], child[place] = feature.astype(np.int64) * len(self.rows), most, place + at + 1
        right = self.cells.codes.ravel().take(first.take(self.place) + self.row) > last.take(self.place)
        self.place = child.take(self.place)
        self.place += right

    def take(self, splits: list[tuple]) -> None:
        """Go down all splits of the models at work, level by level."""
        for m, *more in splits:
            own = np.isin(m, self.models)
            self.split(m[own], *(c[own] for c in more))

    def end(self, weights: np.ndarray) -> None:
        """Add to the predictions what each row's last position weighs; nothing of the tree is kept."""
        both = np.repeat(weights[self.models, :self.size], 2, axis=0)
        self.pred[self.models] += both.take(self.place).reshape(len(self.models), len(self.rows))
        self.place = self.row = self.g = self.local = None


def parts_of(rows: Rows, starts: np.ndarray, widths: list[int]) -> list[Part]:
    out = []
    for a in range(0, max(len(rows), 1), PART_ROWS):
        some = Rows(*(x[a:a + PART_ROWS] for x in (rows.codes, rows.y, rows.mark, rows.fold)))
        cells = Cells(some, widths)
        out.append(Part(replace(some, codes=some.codes[:0]), cells, np.repeat(starts[:, None], len(some), axis=1)))
    return out


def sums_of(parts: list[Part], m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hg, hn = parts[0].sums(m, at)
    for part in parts[1:]:
        g, n = part.sums(m, at)
        hg += g
        hn += n
    return hg, hn


def grow_trees(parts: list[Part], limits: Limits, columns: np.ndarray, scale: float, widths: list[int], trees: Trees) -> None:
    """One tree of each model on rows that are all here, written to ``trees``; the rows are left at their last positions."""
    m = np.arange(len(columns))
    at = np.zeros(len(m), dtype=np.int64)
    hg, hn = sums_of(parts, m, at)
    trees.g[:, 0], trees.n[:, 0] = hg[:, :widths[0]].sum(axis=1), hn[:, :widths[0]].sum(axis=1)
    for d in range(int(limits.depth.max(initial=0))):
        go = np.flatnonzero(may_split(trees, limits, d, m, at))
        if not len(go):
            break
        m, at = m[go], at[go]
        f, b, gain, gl, nl = best_splits(hg, hn, go, limits, m, columns, scale, widths)
        found = np.flatnonzero(f >= 0)
        if not len(found):
            break
        go, m, at, f, b, gain, gl, nl = (x[found] for x in (go, m, at, f, b, gain, gl, nl))
        trees.feature[m, at], trees.bin[m, at], trees.gain[m, at] = f, b, gain
        trees.set_children(m, at, gl, nl)
        for part in parts:
            part.split(m, at, f, b)
        left, right = 2 * at + 1, 2 * at + 2
        least = may_split(trees, limits, d + 1, m, left) | may_split(trees, limits, d + 1, m, right)
        go, m, left, right = go[least], m[least], left[least], right[least]
        if not len(m):
            break
        small = np.where(trees.n[m, left] <= trees.n[m, right], left, right)
        hg, hn = (_with_siblings(h, go, part) for h, part in zip((hg, hn), sums_of(parts, m, small)))
        m, at = np.concatenate([m, m]), np.concatenate([small, left + right - small])


def _with_siblings(parents: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Histograms of the nodes summed, then of their siblings: the parent's less that."""
    out = np.empty((2 * len(part), part.shape[1]), part.dtype)
    out[:len(part)] = part
    np.subtract(parents.take(at, axis=0, out=out[len(part):], mode="clip"), part, out=out[len(part):])
    return out


def tree_row(trees: Trees, weights: np.ndarray, m: int, cuts: list[np.ndarray]) -> dict:
    """One model's tree as arrays of nodes in the order of their heap positions."""
    split = np.flatnonzero(trees.feature[m] >= 0)
    nodes = np.unique(np.concatenate([[0], split, 2 * split + 1, 2 * split + 2]))
    place = {int(x): i for i, x in enumerate(nodes)}
    inner = trees.feature[m, nodes] >= 0
    return {"feature": trees.feature[m, nodes].astype(int).tolist(),
            "threshold": [float(cuts[f][b]) if i else 0.0 for f, b, i in zip(trees.feature[m, nodes], trees.bin[m, nodes], inner)],
            "left": [place[2 * int(x) + 1] if i else -1 for x, i in zip(nodes, inner)],
            "right": [place[2 * int(x) + 2] if i else -1 for x, i in zip(nodes, inner)],
            "value": weights[m, nodes].tolist(), "cover": trees.n[m, nodes].tolist(),
            "gain": np.where(inner, trees.gain[m, nodes], 0.0).tolist()}


TREE = ("model int, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
        "value array<double>, cover array<bigint>, gain array<double>")
_TREE = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("feature", pa.list_(pa.int32())),
                   ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
                   ("value", pa.list_(pa.float64())), ("cover", pa.list_(pa.int64())), ("gain", pa.list_(pa.float64()))])
SCORE = "model int, n bigint, sse double, sum_y double, sum_yy double"


def held_out_scores(rows: Rows, specs: list[Spec], pred: np.ndarray) -> list[tuple]:
    """(n, squared error, sum and sum of squares of the labels) of each model's held-out rows."""
    out = []
    for m, s in enumerate(specs):
        at = rows.fold == s.fold if s.fold != NO_FOLD else np.zeros(len(rows), bool)
        y = rows.y[at]
        out.append((int(at.sum()), float(((y - pred[m, at]) ** 2).sum()), float(y.sum()), float((y * y).sum())))
    return out


# ---- whole table in each task, models dealt over tasks

def batches_of(specs: list[Spec], rows: int, tasks: int) -> list[list[int]]:
    """Models in batches that are grown in step by one task: of one depth, similar length, bounded in rows and nodes."""
    order = sorted(range(len(specs)), key=lambda m: (specs[m].depth, specs[m].rounds))
    most = max(1, -(-len(specs) // max(tasks, 1)))
    out: list[list[int]] = []
    for m in order:
        limit = max(1, min(most, NODES >> specs[m].depth, CELLS // max(rows, 1)))
        if out and specs[out[-1][0]].depth == specs[m].depth and len(out[-1]) < limit:
            out[-1].append(m)
        else:
            out.append([m])
    cost = lambda b: len(b) * specs[b[-1]].rounds * (4 + (1 << specs[b[0]].depth) / 8)
    return sorted(out, key=cost, reverse=True)


def grow_batch(rows: Rows, specs: list[Spec], means: dict[int, float], scale: float, cuts: list[np.ndarray], keep: bool):
    """All trees of some models; (trees as rows with the model's place in the batch, held-out scores)."""
    widths = [len(c) + 1 for c in cuts]
    order = sorted(range(len(specs)), key=lambda m: -specs[m].rounds)
    specs = [specs[m] for m in order]
    starts = np.array([means[s.fold] for s in specs], dtype=np.float64)
    parts = parts_of(rows, starts[:0], widths)
    step = max(1, min(PAIRS // max(1, len(parts[0].rows)), NODES >> max((s.depth for s in specs), default=0)))
    found: list[list[dict]] = [[] for _ in range(specs[0].rounds if specs else 0)]
    scores = []
    for a in range(0, len(specs), step):  # some models at a time, in step
        some, live = specs[a:a + step], 0
        for part in parts:
            part.pred = np.repeat(starts[a:a + step, None], len(part.rows), axis=1)
        for t in range(some[0].rounds):
            if live != sum(s.rounds > t for s in some):
                live = sum(s.rounds > t for s in some)
                now, limits = some[:live], Limits(some[:live])
            trees, columns = Trees(live, max(s.depth for s in now)), drawn_columns(now, len(widths), t)
            for part in parts:
                part.start(now, t, np.arange(live), scale)
            grow_trees(parts, limits, columns, scale, widths, trees)
            trees.keep_best(now)
            w = trees.weights(limits, scale)
            for part in parts:
                part.end(w)
            if keep:
                found[t] += [{"model": order[a + m], "tree": t, **tree_row(trees, w, m, cuts)} for m in range(live)]
        pred = np.concatenate([part.pred for part in parts], axis=1)
        scores += [(order[a + m], *x) for m, x in enumerate(held_out_scores(rows, some, pred))]
    return [r for trees in found for r in trees], scores


def keep_freed(most: int = 32 << 20) -> None:
    """Let the worker keep up to ``most`` bytes of freed memory (where the C library can): otherwise arrays of this size
    are given back and faulted in again some hundred times a tree, a quarter of the time."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        set_option(-3, most >> 2)  # M_MMAP_THRESHOLD: larger arrays are given back at once
        set_option(-1, most)  # M_TRIM_THRESHOLD


def grow_whole(table: Binned, specs: list[Spec], keep: bool) -> DataFrame:
    """Trees (``keep``) or held-out scores of all models; the packed table, whose size was checked, goes to every task."""
    spark = table.blocks.sparkSession
    shared = spark.sparkContext.broadcast([r.asDict() for r in table.blocks.collect()])
    tasks = batches_of(specs, table.n, 8 * spark.sparkContext.defaultParallelism)
    features, means, scale, cuts = len(table.features), table.means, table.scale, table.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        rows = unpack(shared.value, features)
        for batch in batches:
            for text in batch.column("work").to_pylist():
                work = [(m, Spec(**s)) for m, s in json.loads(text)]
                found, scores = grow_batch(rows, [s for _, s in work], means, scale, cuts, keep)
                if keep:
                    for r in found:
                        r["model"] = work[r["model"]][0]
                    for at in range(0, len(found), 256):
                        yield pa.RecordBatch.from_pylist(found[at:at + 256], schema=_TREE)
                else:
                    yield pa.RecordBatch.from_pylist([
                        dict(zip(("model", "n", "sse", "sum_y", "sum_yy"), (work[s[0]][0], *s[1:]))) for s in scores],
                        schema=pa.schema([("model", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in (
                            "sse", "sum_y", "sum_yy"))]))

    work = [(k, json.dumps([(m, asdict(specs[m])) for m in batch])) for k, batch in enumerate(tasks)]
    dealt = spark.createDataFrame(work, "k int, work string").repartitionByRange(max(1, len(tasks)), "k").select("work")
    return dealt.mapInArrow(run, TREE if keep else SCORE)


# ---- distributed parts, one job per level

def _pieces(rows: int, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for a in range(0, r["n"], rows):
                    n = min(rows, r["n"] - a)
                    cut = lambda c, width: pa.array([r[c][a * width:(a + n) * width]], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int32()), cut("codes", features), cut("y", 8), cut("mark", 8), cut("fold", 1)],
                        names=["n", "codes", "y", "mark", "fold"])
    return run


def _parts_of_pieces(features: int, starts: np.ndarray, widths: list[int]):
    def run(records: Iterator) -> Iterator[Part]:
        for r in records:
            yield from parts_of(unpack([r], features), starts, widths)
    return run


def _splits_of(trees: Trees) -> list[list[tuple]]:
    """The splits of all models, level by level: (models, positions, features, bins)."""
    out, m, at = [], *np.nonzero(trees.feature >= 0)
    level = np.floor(np.log2(at + 1)).astype(int)
    for d in range(int(level.max(initial=-1)) + 1):
        x, node = m[level == d], at[level == d]
        out.append((x, node, trees.feature[x, node], trees.bin[x, node]))
    return out


def _level_sums(specs: list[Spec], tree: int, scale: float, splits: list[tuple], m: np.ndarray, at: np.ndarray):
    """Histograms of the nodes (m, at), summed over the parts of a task."""
    def run(parts: Iterator[Part]) -> Iterator[np.ndarray]:
        total = None
        for part in parts:
            part.start(specs, tree, np.unique(m), scale)
            part.take(splits)
            hg, hn = part.sums(m, at)
            found = np.stack([hg.astype(np.int64), hn])
            total = found if total is None else total + found
        if total is not None:
            yield total
    return run


def _add_tree(specs: list[Spec], splits: list[tuple], weights: np.ndarray):
    def run(parts: Iterator[Part]) -> Iterator[Part]:
        for part in parts:
            part.pred = part.pred.copy()
            part.start(specs, 0, np.arange(len(specs)))
            part.take(splits)
            part.end(weights)
            yield part
    return run


def _added(found: RDD, tasks: int) -> np.ndarray:
    """The sum of what the tasks found: nodes of a level by bins, the size of the models."""
    return sum(found.collect()) if tasks <= 64 else found.treeReduce(lambda a, b: a + b)


def grow_levels(table: Binned, specs: list[Spec], keep: bool) -> DataFrame:
    """As ``grow_whole``, with the rows dealt over tasks: a job per level, whose tasks sum histograms of their rows.

    Rows and predictions are kept by the executors (memory, then disk); every ``LINEAGE`` trees they are also written to the
    shared folder, from which a lost part is made again."""
    spark = table.blocks.sparkSession
    order = sorted(range(len(specs)), key=lambda m: -specs[m].rounds)
    specs = [specs[m] for m in order]
    features, scale, widths = len(table.features), table.scale, table.widths
    most = max(1, min(PART_ROWS, PART_CELLS // max(len(specs), 1)))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-table.n // 4096)), -(-table.n // (PART_ROWS * 16)))
    size = max(1, min(most, -(-table.n // tasks)))
    dealt = table.blocks.mapInArrow(_pieces(size, features), BLOCK)
    starts = np.array([table.means[s.fold] for s in specs], dtype=np.float64)
    state = dealt.repartition(tasks).rdd.mapPartitions(_parts_of_pieces(features, starts, widths)).persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(spark)
    rows, made = [], [state]
    for t in range(specs[0].rounds if specs else 0):
        live = sum(s.rounds > t for s in specs)
        now, limits, depth = specs[:live], Limits(specs[:live]), max(s.depth for s in specs[:live])
        trees, columns = Trees(live, depth), drawn_columns(now, features, t)
        m, at = np.arange(live), np.zeros(live, dtype=np.int64)
        small, hg, hn, d = at, None, None, 0
        while len(m):
            part = _added(state.mapPartitions(_level_sums(now, t, scale, _splits_of(trees), m, small)), tasks)
            if d == 0:
                hg, hn = part
                trees.g[m, 0], trees.n[m, 0] = hg[:, :widths[0]].sum(axis=1), hn[:, :widths[0]].sum(axis=1)
            else:
                hg, hn = np.concatenate([part[0], hg - part[0]]), np.concatenate([part[1], hn - part[1]])
                m, at = np.concatenate([m, m]), np.concatenate([small, at])
            go = may_split(trees, limits, d, m, at)
            m, at, hg, hn = m[go], at[go], hg[go], hn[go]
            f, b, gain, gl, nl = best_splits(hg, hn, np.arange(len(m)), limits, m, columns, scale, widths)
            go = f >= 0
            m, at, hg, hn = m[go], at[go], hg[go], hn[go]
            trees.feature[m, at], trees.bin[m, at], trees.gain[m, at] = f[go], b[go], gain[go]
            trees.set_children(m, at, gl[go], nl[go])
            d += 1
            left, right = 2 * at + 1, 2 * at + 2
            again = (may_split(trees, limits, d, m, left) | may_split(trees, limits, d, m, right)) if len(m) and d < depth else go[:0]
            m, left, right, hg, hn = m[again], left[again], right[again], hg[again], hn[again]
            small = np.where(trees.n[m, left] <= trees.n[m, right], left, right)
            at = left + right - small
        splits = _splits_of(trees)
        trees.keep_best(now)
        weights = trees.weights(limits, scale)
        if keep:
            rows += [{"model": order[k], "tree": t, **tree_row(trees, weights, k, table.cuts)} for k in range(live)]
        if keep and t + 1 == specs[0].rounds:
            break
        state = state.mapPartitions(_add_tree(now, splits, weights)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % LINEAGE == 0:
            state.checkpoint()
        made.append(state)
        if len(made) > 2:  # the last but one was made by the jobs of this tree
            made.pop(0).unpersist()
    if keep:
        for old in made:
            old.unpersist()
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_TREE))

    def score(parts: Iterator[Part]) -> Iterator[tuple]:
        for part in parts:
            for k, found in enumerate(held_out_scores(part.rows, specs, part.pred)):
                yield (order[k], *found)
    return spark.createDataFrame(state.mapPartitions(score), SCORE).groupBy("model").agg(
        *(F.sum(c).alias(c) for c in ("n", "sse", "sum_y", "sum_yy")))


def grow(table: Binned, specs: list[Spec], keep: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """All models: their trees, or with ``keep`` false the scores of their held-out rows."""
    return (grow_whole if table.n_bytes <= whole_bytes else grow_levels)(table, specs, keep)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- fitted models

@dataclass
class BoostedTrees:
    """A fitted model: the start value and the trees' nodes, all trees one after the other (children by absolute place)."""
    features: list[str]
    start: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    depth: int

    @classmethod
    def of(cls, features: list[str], start: float, rows: list) -> BoostedTrees:
        rows = sorted(rows, key=lambda r: r["tree"])
        size = np.array([len(r["feature"]) for r in rows], dtype=np.int64)
        root = np.cumsum(size) - size
        flat = lambda c, t: np.concatenate([np.asarray(r[c], dtype=t) for r in rows] or [np.zeros(0, t)])
        shift = np.repeat(root, size)
        left, right = flat("left", np.int64), flat("right", np.int64)
        leaf = left < 0
        own = np.arange(len(left))
        model = cls(list(features), float(start), root, np.where(leaf, 0, flat("feature", np.int64)), flat("threshold", np.float64),
                    np.where(leaf, own, left + shift), np.where(leaf, own, right + shift), flat("value", np.float64),
                    flat("cover", np.int64), flat("gain", np.float64), 0)
        node, depth = root, 0
        while len(node):
            node = node[model.left[node] != node]
            node = np.unique(np.concatenate([model.left[node], model.right[node]]))
            depth += len(node) > 0
        return replace(model, depth=depth)

    def rows(self) -> list[dict]:
        """The trees as rows of ``TREE`` without the model."""
        out = []
        for t, (a, b) in enumerate(zip(self.root, [*self.root[1:], len(self.left)])):
            leaf = self.left[a:b] == np.arange(a, b)
            near = lambda c: np.where(leaf, -1, c[a:b] - a).tolist()  # noqa: B023, E731
            out.append({"tree": t, "feature": np.where(leaf, -1, self.feature[a:b]).tolist(), "left": near(self.left),
                        "right": near(self.right), **{c: getattr(self, c)[a:b].tolist() for c in ("threshold", "value", "cover", "gain")}})
        return out

    def predict(self, x: np.ndarray, cells: int = 1 << 20, most: int = 1 << 15) -> np.ndarray:
        """Predictions of rows (n, features): all trees of a part are walked down in step, for ``most`` rows x trees at a time.

        A prediction adds up its trees in parts whose size goes by ``cells``."""
        out = np.full(len(x), self.start)
        step = max(1, min(len(x), 4096))
        trees = max(1, cells // step)
        child = np.stack([self.left, self.right], axis=1).ravel()
        values = np.ascontiguousarray(x).ravel()
        for t in range(0, len(self.root), trees):
            root = self.root[t:t + trees][:, None]
            block = max(2, most // len(root))
            for r in range(0, len(x), block):
                rows = np.arange(min(r, max(len(x) - 2, 0)), min(r + block, len(x)))  # one row alone would be added up pairwise
                at = rows * x.shape[1]
                node = np.repeat(root, len(rows), axis=1)
                for _ in range(self.depth):
                    beyond = ~(values.take(self.feature.take(node) + at) <= self.threshold.take(node))
                    node = child.take(2 * node + beyond)
                out[r:r + block] += self.value.take(node).sum(axis=0)[r - rows[0]:]
        return out

    def importance(self) -> np.ndarray:
        """Total gain of each feature's splits."""
        inner = self.left != np.arange(len(self.left))
        return np.bincount(self.feature[inner], self.gain[inner], len(self.features))

    def column(self, *features: Column) -> Column:
        """The prediction as a column of the feature columns; only these go through Python."""
        model = self

        @F.arrow_udf("double")
        def boosted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for arrays in batches:
                x = np.stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays], axis=1)
                yield pa.array(model.predict(x), pa.float64())

        return boosted(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in features])


def fit(table: Binned, specs: list[Spec], whole_bytes: int = WHOLE_BYTES) -> list[BoostedTrees]:
    """All models, fitted together."""
    found = _written(grow(table, specs, True, whole_bytes), "boost-trees").toArrow().to_pylist()  # the size of the models
    per: dict[int, list] = {m: [] for m in range(len(specs))}
    for r in found:
        per[r["model"]].append(r)
    return [BoostedTrees.of(table.features, table.means[s.fold], per[m]) for m, s in enumerate(specs)]


def cross_validated(table: Binned, specs: list[Spec], folds: int, whole_bytes: int = WHOLE_BYTES) -> np.ndarray:
    """(specs, folds) R² of each spec on each fold, fitted on the other folds; all models in one call."""
    every = [replace(s, fold=k) for s in specs for k in range(folds)]
    out = np.full(len(every), np.nan)
    for r in grow(table, every, False, whole_bytes).collect():  # one row per model
        var = r["sum_yy"] - r["sum_y"] ** 2 / r["n"] if r["n"] else 0.0
        out[r["model"]] = 1 - r["sse"] / var if var > 0 else np.nan
    return out.reshape(len(specs), folds)


def spark_of(table: Binned) -> SparkSession:
    return table.blocks.sparkSession
