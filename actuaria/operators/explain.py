"""Tree attributions (I5) for boosted trees.

Path-dependent Shapley values: for every leaf of every tree let F be the
distinct features on its path, z_j the product of cover ratios of the
splits on feature j along the path and o_j(x) ∈ {0, 1} whether x satisfies
all of them.  With leaf value v the leaf contributes

    φ_i += v · (o_i − z_i) · Σ_{S ⊆ F∖{i}} |S|!(|F|−|S|−1)!/|F|! · Π_{j∈S} o_j · Π_{j∈F∖S∖{i}} z_j

The subset sum is the coefficient vector of Π_{j≠i}(z_j + o_j·t) dotted with
the Shapley weights; it has one value for each pattern of o.  So a leaf's contributions depend on a row only through the
intervals, between the leaf's cuts, that its features lie in.  Leaves with the same features, from all
trees, are added up into one table (cell of the grid of their cuts → contribution of each feature): a row
becomes bin codes once, and each table costs it one lookup.  A table holds at most ``CELLS`` cells;
where the leaves of a feature set have more, they are dealt over several tables.

The tables are the model's size, not the data's; they are broadcast, and rows go
through a column function over the model's features in Arrow batches; the other
columns never leave the JVM and no Python runs per row.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuaria.operators.boosting import BoostedTrees

#: Cells of a table; of a model with more than MANY leaves, whose tables would take long to fill.
CELLS, MANY, CELLS_OF_MANY = 1 << 13, 20_000, 1 << 9


def flatten_trees(model: BoostedTrees) -> dict:
    """Per-leaf path summaries of a model, and its expected value."""
    leaves = []
    expected = model.start
    for root in model.root:
        root_cover = float(model.cover[root]) or 1.0
        # depth-first walk carrying the per-feature (lo, hi, z) of the path
        stack = [(int(root), {})]
        while stack:
            at, conds = stack.pop()
            if model.left[at] == at:
                value = float(model.value[at])
                expected += value * float(model.cover[at]) / root_cover
                feats = sorted(conds)
                leaves.append({
                    "v": value,
                    "features": np.array(feats, dtype=np.int64),
                    "lo": np.array([conds[f][0] for f in feats], dtype=float),
                    "hi": np.array([conds[f][1] for f in feats], dtype=float),
                    "z": np.array([conds[f][2] for f in feats], dtype=float),
                })
                continue
            threshold, feat, cover = float(model.threshold[at]), int(model.feature[at]), float(model.cover[at]) or 1.0
            for child, is_left in ((int(model.left[at]), True), (int(model.right[at]), False)):
                ratio = float(model.cover[child]) / cover
                lo, hi, z = conds.get(feat, (-np.inf, np.inf, 1.0))
                new = dict(conds)
                new[feat] = (lo, min(hi, threshold), z * ratio) if is_left else (max(lo, threshold), hi, z * ratio)
                stack.append((child, new))
    return {"leaves": leaves, "expected": expected}


def _shapley_weights(m: int) -> np.ndarray:
    return np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])


def _poly_contrib(o: np.ndarray, z: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Contributions (…, L, m) of leaves with inclusion flags o (…, L, m)."""
    m = z.shape[-1]
    out = np.zeros(o.shape)
    for a in range(m):
        poly = np.ones(o.shape[:-1] + (1,))          # coefficients of Π_{b≠a}(z_b + o_b·t)
        for b in range(m):
            if b == a:
                continue
            grown = np.zeros(poly.shape[:-1] + (poly.shape[-1] + 1,))
            grown[..., :-1] += poly * z[..., b:b + 1]
            grown[..., 1:] += poly * o[..., b:b + 1]
            poly = grown
        out[..., a] = v * (o[..., a] - z[..., a]) * (poly @ w)
    return out


@dataclass
class Lookup:
    """Contributions of some leaves with the same features: for each feature the local interval of every bin
    code of the model, and the contributions by cell."""
    features: list[int]
    intervals: list[np.ndarray]
    strides: list[int]
    table: np.ndarray


def model_cuts(flat: dict, n_features: int) -> list[np.ndarray]:
    """All thresholds of each feature."""
    seen: list[set] = [set() for _ in range(n_features)]
    for leaf in flat["leaves"]:
        for f, lo, hi in zip(leaf["features"], leaf["lo"], leaf["hi"]):
            seen[f].update(x for x in (lo, hi) if np.isfinite(x))
    return [np.array(sorted(s)) for s in seen]


def lookup_tables(flat: dict, n_features: int, cells: int | None = None) -> tuple[list[np.ndarray], list[Lookup]]:
    """(cuts of each feature, lookup tables) of a model, once per model."""
    leaves = [leaf for leaf in flat["leaves"] if len(leaf["features"])]
    cells = cells or (CELLS if len(leaves) <= MANY else CELLS_OF_MANY)
    cuts = model_cuts(flat, n_features)
    groups: dict[tuple, list] = {}
    for leaf in leaves:
        groups.setdefault(tuple(leaf["features"]), []).append(leaf)
    out = []
    for features, group in sorted(groups.items()):
        some, own = [], [set() for _ in features]
        for leaf in sorted(group, key=lambda x: (tuple(x["hi"]), tuple(x["lo"]))):  # neighbours share cuts
            new = [o | {x for x in (lo, hi) if np.isfinite(x)} for o, lo, hi in zip(own, leaf["lo"], leaf["hi"])]
            if some and np.prod([len(o) + 1 for o in new]) > cells:
                out.append(_lookup(features, some, own, cuts))
                some, new = [], [{x for x in (lo, hi) if np.isfinite(x)} for lo, hi in zip(leaf["lo"], leaf["hi"])]
            some.append(leaf)
            own = new
        out.append(_lookup(features, some, own, cuts))
    return cuts, out


def _lookup(features: tuple, leaves: list[dict], own: list[set], cuts: list[np.ndarray]) -> Lookup:
    m = len(features)
    local = [np.array(sorted(o)) for o in own]
    widths = [len(c) + 1 for c in local]
    strides = [int(np.prod(widths[j + 1:])) for j in range(m)]
    pattern = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    table = np.zeros((int(np.prod(widths)), m))
    for leaf in leaves:
        by_pattern = _poly_contrib(pattern, np.broadcast_to(leaf["z"], pattern.shape), leaf["v"], _shapley_weights(m))
        at = np.zeros(widths, dtype=np.int64)
        for j, c in enumerate(local):
            i = np.arange(widths[j])
            first = np.searchsorted(c, leaf["lo"][j], "right") if np.isfinite(leaf["lo"][j]) else 0
            last = np.searchsorted(c, leaf["hi"][j], "left") if np.isfinite(leaf["hi"][j]) else len(c)
            inside = (i >= first) & (i <= last)
            at |= inside.astype(np.int64).reshape([-1 if k == j else 1 for k in range(m)]) << j
        table += by_pattern[at.ravel()]
    intervals = []
    for f, c in zip(features, local):  # interval of a model-wide code: how many of the local cuts lie below it
        intervals.append(np.searchsorted(c, np.append(cuts[f], np.inf), "left"))
    return Lookup(list(features), intervals, strides, table)


def shap_matrix(x: np.ndarray, cuts: list[np.ndarray], tables: list[Lookup]) -> np.ndarray:
    """Attributions of rows (n, features) of raw model inputs."""
    codes = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    phi = np.zeros((len(cuts), len(x)))
    for t in tables:
        cell = sum(i[codes[f]] * s for f, i, s in zip(t.features, t.intervals, t.strides))
        found = t.table[cell]
        for j, f in enumerate(t.features):
            phi[f] += found[:, j]
    return phi.T


def tree_shap(df: DataFrame, fitted, prefix: str = "f_", out_col: str = "shap", rows: int = 4096) -> DataFrame:
    """Append ``array<double>`` attributions (feature order) and the model's expected value ``base_value``.

    Only the model's features go through Python, in Arrow batches of which ``rows`` are worked on at a time;
    the other columns stay in the JVM and the operator stays narrow."""
    flat = flatten_trees(fitted.model)
    cols = [f"{prefix}{f}" for f in fitted.features]
    shared = df.sparkSession.sparkContext.broadcast(lookup_tables(flat, len(cols)))

    @F.arrow_udf("array<double>")
    def attributions(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cuts, tables = shared.value
        for arrays in batches:
            x = np.stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays], axis=1)
            phi = np.concatenate([shap_matrix(x[i:i + rows], cuts, tables) for i in range(0, len(x), rows)] or [x])
            yield pa.ListArray.from_arrays(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32), phi.ravel())

    phi = attributions(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    return df.withColumn(out_col, phi).withColumn("base_value", F.lit(float(flat["expected"])))


__all__ = ["flatten_trees", "lookup_tables", "shap_matrix", "tree_shap"]
