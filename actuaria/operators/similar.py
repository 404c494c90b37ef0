"""Stratified, weighted k-nearest-neighbour search.

Exact search without all pairs
------------------------------
Base and query points live in the weighted space (feature × √weight).  The base
rows of each stratum form a tree of boxes: a node with more than ``LEAF`` rows is cut, along the two dimensions in
which its box is widest, at up to ``FAN`` - 1 quantiles of each, until every leaf is small.  Cuts follow the
data in all dimensions, so neither outliers, nor dense clusters, nor many rows that agree in some dimensions
make a leaf large: rows of equal vectors are reduced to their k lowest keys first, and different ones can be cut.

A query first goes down to the nearest leaf; the k-th distance there (or that to the far corner of a box
on the way that holds k rows) bounds the true one.  It then goes down again into every box within the
bound, and meets the rows of the leaves it reaches.  Rows and queries only join on a leaf.

The distance scale (K4) needs the k-th neighbour of every base row, and asks for all at once: leaves
whose boxes are within the bound of one of the two are paired, each pair is compared once, for both its sides.

Distances are compared at 1e-9 resolution with ties going to the lower
base key.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators.quantiles import percentiles_long
from actuaria.session import scratch_path

TIE_DIGITS = 9
#: Rows of a leaf, and parts of a dimension that a node is cut into, at most.
LEAF, FAN = 64, 4
#: Slack of a bound, for the rounding of distances.
SLACK = 2e-9


def weighted(df: DataFrame, cols: Sequence[str] = C.KNN_FEATURES,
             weights: Sequence[float] = C.KNN_WEIGHTS, prefix: str = "w_") -> DataFrame:
    """K2: add ``w_<i>`` = col_i × √weight_i (the weighted Euclidean space)."""
    return df.select("*", *[(F.col(c).cast("double") * F.lit(math.sqrt(w))).alias(f"{prefix}{i}")
                            for i, (c, w) in enumerate(zip(cols, weights))])


def _dist(n_dims: int, q: str = "q_", b: str = "w_"):
    terms = [(F.col(f"{q}{i}") - F.col(f"{b}{i}")) * (F.col(f"{q}{i}") - F.col(f"{b}{i}")) for i in range(n_dims)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sqrt(total)


@dataclass
class BoxTree:
    """Base rows with their leaf, and the boxes of all nodes, a table per level."""
    rows: DataFrame            # bid, node, w_0..
    levels: list[DataFrame]    # node, parent, n, far, lo_0.., hi_0..
    dims: int
    bid: str


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, with its size known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def root_of(stratum: str):
    return F.concat(F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.lit("/"))


def _norm(terms):
    total = F.lit(0.0)
    for t in terms:
        total = total + t * t
    return F.sqrt(total)


def build_tree(base: DataFrame, k: int, n_dims: int, bid: str, stratum: str, leaf: int = LEAF) -> BoxTree:
    """The box tree of the base rows of every stratum; one aggregate and one join per level."""
    leaf = max(leaf, k)
    wcols = [f"w_{i}" for i in range(n_dims)]
    dup = Window.partitionBy(stratum, *wcols).orderBy(bid)  # identical vectors: the k lowest keys
    now = _kept(base.select(bid, stratum, *wcols).withColumn("_dup", F.row_number().over(dup)).where(F.col("_dup") <= k)
                .select(bid, root_of(stratum).alias("node"), *wcols), "knn-rows")
    fractions = F.array(*[F.lit(j / FAN) for j in range(1, FAN)])
    done, levels = [], []
    while True:
        box = now.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), *[F.min(w).alias(f"lo_{i}") for i, w in enumerate(wcols)],
            *[F.max(w).alias(f"hi_{i}") for i, w in enumerate(wcols)],
            *[F.percentile_approx(w, fractions, 1000).alias(f"p_{i}") for i, w in enumerate(wcols)])
        wide = F.sort_array(F.array(*[F.struct((F.col(f"hi_{i}") - F.col(f"lo_{i}")).alias("s"), F.lit(i).alias("i"))
                                      for i in range(n_dims)]), asc=False)  # the two widest dimensions are cut
        box = box.withColumn("_wide", wide).withColumn("open", (F.col("n") > leaf) & (F.col("_wide")[0]["s"] > 0))
        parts = F.ceil(F.col("n") / leaf).cast("int")
        other = F.least(F.lit(FAN), F.ceil(parts / FAN).cast("int"))

        def cuts_of(which: int, wanted):
            i = F.get("_wide", F.lit(which))["i"]
            at, high = (F.array(*[F.col(f"{c}_{j}") for j in range(n_dims)])[i] for c in ("p", "hi"))
            some = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))),
                               lambda j: F.get(at, F.floor(j * FAN / wanted).cast("int") - 1))
            return F.when(wanted > 1, F.array_sort(F.array_distinct(F.filter(some, lambda c: c < high))))

        lowest = F.array(*[F.col(f"lo_{j}") for j in range(n_dims)])[F.col("_wide")[0]["i"]]
        first = cuts_of(0, F.least(F.lit(FAN), parts))
        first = F.when(F.size(first) > 0, first).otherwise(F.array(lowest))  # always two children at least
        box = box.withColumn("cuts", F.when(F.col("open"), first)).withColumn("more", F.when(
            F.col("open"), F.coalesce(cuts_of(1, other), F.array().cast("array<double>"))))
        box = box.withColumn("dim", F.when(F.col("open"), F.col("_wide")[0]["i"])).withColumn("next", F.get("_wide", F.lit(1))["i"])
        diagonal = _norm([F.col(f"hi_{i}") - F.col(f"lo_{i}") for i in range(n_dims)])
        box = box.select("node", F.expr("left(node, length(node) - 1)").alias("parent"), "n", "dim", "next", "cuts", "more",
                         F.when(F.col("n") >= k, diagonal).otherwise(float("inf")).alias("far"),
                         *[f"{c}_{i}" for c in ("lo", "hi") for i in range(n_dims)])
        if levels:  # a box that holds k rows bounds the k-th distance of all rows inside
            above = levels[-1].select(F.col("node").alias("parent"), F.col("far").alias("_far"))
            box = box.join(above, "parent").withColumn("far", F.least("far", "_far")).drop("_far")
        box = _kept(box, "knn-boxes")
        levels.append(box.drop("dim", "next", "cuts", "more"))
        cut = box.where("dim IS NOT NULL").select("node", "dim", "next", "cuts", "more")
        if cut.isEmpty():
            rows = now
            for d in done:
                rows = rows.unionByName(d)
            return BoxTree(rows, levels, n_dims, bid)
        value, second = F.array(*wcols)[F.col("dim")], F.get(F.array(*wcols), F.coalesce("next", F.lit(0)))
        child = FAN * F.size(F.filter("cuts", lambda c: c < value)) + F.size(F.filter("more", lambda c: c < second))
        moved = _kept(now.join(cut, "node", "left").withColumn("node", F.when(
            F.col("dim").isNotNull(), F.concat("node", F.substring(F.lit("0123456789abcdef"), child + 1, F.lit(1))))
            .otherwise(F.col("node"))).withColumn("open", F.col("dim").isNotNull()).drop("dim", "next", "cuts", "more"), "knn-rows")
        done.append(moved.where("NOT open").drop("open"))
        now = moved.where("open").drop("open")


def _gap(n_dims: int, lo: str, hi: str, box_lo: str = "lo_", box_hi: str = "hi_"):
    """Distance between two boxes (or of a point, where lo and hi are the same columns)."""
    return _norm([F.greatest(F.col(f"{box_lo}{i}") - F.col(f"{hi}{i}"), F.col(f"{lo}{i}") - F.col(f"{box_hi}{i}"), F.lit(0.0))
                  for i in range(n_dims)])


def _within(tree: BoxTree, asking: DataFrame, lo: str, hi: str, bound: str) -> DataFrame:
    """``asking`` (with ``node``, a root) once for every leaf whose box is within its ``bound``."""
    near = _gap(tree.dims, lo, hi) <= F.col(bound)
    columns = asking.columns
    at = asking.join(tree.levels[0].drop("parent", "n", "far"), "node").where(near).select(*columns)
    for level in tree.levels[1:]:  # a leaf has no children and stays
        boxes = level.drop("n", "far").withColumnRenamed("node", "_child").withColumnRenamed("parent", "node")
        at = (at.join(boxes, "node", "left").where(F.col("_child").isNull() | near)
              .withColumn("node", F.coalesce("_child", "node")).select(*columns))
    return at


def knn(queries: DataFrame, base: DataFrame, k: int = C.KNN_K, n_dims: int = len(C.KNN_FEATURES),
        qid: str = "query_id", bid: str = "neighbor_id", stratum: str = "stratum",
        leaf: int = LEAF, tree: BoxTree | None = None) -> DataFrame:
    """Exact k nearest base points per query within the query's stratum.

    ``queries``: (qid, stratum, w_0..w_{d-1}); ``base``: (bid, stratum, w_0..), or its ``tree``.
    Returns (qid, rank INT, bid, distance DOUBLE).
    """
    t = tree or build_tree(base, k, n_dims, bid, stratum, leaf)
    qcols = [f"q_{i}" for i in range(n_dims)]
    q = _kept(queries.select(qid, root_of(stratum).alias("node"), *[F.col(f"w_{i}").alias(c) for i, c in enumerate(qcols)]),
              "knn-queries")
    gap = _gap(n_dims, "q_", "q_")
    corner = _norm([F.greatest(F.abs(F.col(f"q_{i}") - F.col(f"lo_{i}")), F.abs(F.col(f"q_{i}") - F.col(f"hi_{i}")))
                    for i in range(n_dims)])
    far = F.when(F.col("n") >= k, corner).otherwise(float("inf"))
    at = q.join(t.levels[0], "node").select(qid, "node", *qcols, far.alias("_far"))
    for level in t.levels[1:]:  # down to the nearest leaf
        boxes = level.drop("far").withColumnRenamed("node", "_child").withColumnRenamed("parent", "node")
        step = F.struct(F.coalesce(gap, F.lit(0.0)).alias("gap"), F.coalesce("_child", "node").alias("node"),
                        F.least("_far", F.coalesce(far, F.lit(float("inf")))).alias("far"))
        at = (at.join(boxes, "node", "left").groupBy(qid, *qcols).agg(F.min(step).alias("_s"))
              .select(qid, F.col("_s.node").alias("node"), *qcols, F.col("_s.far").alias("_far")))
    points = t.rows.withColumnRenamed(t.bid, bid)
    seen = at.join(points, "node").groupBy(qid, "_far", *qcols).agg(
        F.get(F.sort_array(F.collect_list(_dist(n_dims))), F.lit(k - 1)).alias("_k"))  # at most a leaf's rows
    bound = _kept(seen.select(qid, (F.least(F.coalesce("_k", F.lit(float("inf"))), "_far") + SLACK).alias("_d")), "knn-bound")
    probes = _within(t, q.join(bound, qid), "q_", "q_", "_d")
    cand = probes.join(points, "node").select(qid, bid, _dist(n_dims).alias("distance"))
    w = Window.partitionBy(qid).orderBy(F.round("distance", TIE_DIGITS), bid)
    best = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(qid, F.col("rank").cast("int").alias("rank"), bid, "distance")


def leaf_pairs(tree: BoxTree, bounds: DataFrame) -> DataFrame:
    """(left, right): pairs of different leaves of a stratum that may hold rows within the bound of one of the two; each once.

    ``bounds``: (node, reach) of every leaf."""
    d = tree.dims
    boxes = tree.levels[0]
    for level in tree.levels[1:]:
        boxes = boxes.unionByName(level)
    asking = bounds.join(boxes, "node").select(
        F.col("node").alias("_own"), (F.col("reach") + SLACK).alias("reach"),
        F.regexp_extract("node", "^(.*/)", 1).alias("node"),
        *[F.col(f"{c}_{i}").alias(f"own_{c}_{i}") for c in ("lo", "hi") for i in range(d)])
    found = _within(tree, asking, "own_lo_", "own_hi_", "reach").where(F.col("node") != F.col("_own"))
    return found.select(F.least("node", "_own").alias("left"), F.greatest("node", "_own").alias("right")).distinct()


def kth_distances(tree: BoxTree, k: int) -> DataFrame:
    """(bid, value): distance of every row of the tree to its k-th nearest row, itself included (the last one if fewer)."""
    d, bid = tree.dims, tree.bid
    wcols = [f"w_{i}" for i in range(d)]
    left = tree.rows.select(F.col(bid).alias("a"), "node", *[F.col(w).alias(f"q_{i}") for i, w in enumerate(wcols)])
    right = tree.rows.select(F.col(bid).alias("b"), "node", *wcols)
    own = left.join(right, "node").groupBy("a", "node", *[f"q_{i}" for i in range(d)]).agg(
        F.slice(F.sort_array(F.collect_list(_dist(d))), 1, k).alias("near"))  # at most a leaf's rows
    boxes = tree.levels[0]
    for level in tree.levels[1:]:
        boxes = boxes.unionByName(level)
    own = _kept(own.join(boxes.select("node", "far"), "node").withColumn(
        "bound", F.least(F.coalesce(F.get("near", F.lit(k - 1)), F.lit(float("inf"))), "far") + SLACK).drop("far"), "knn-own")
    pairs = _kept(leaf_pairs(tree, own.groupBy("node").agg(F.max("bound").alias("reach"))), "knn-pairs")
    one = own.select(F.col("node").alias("left"), "a", F.col("bound").alias("bound_a"), *[f"q_{i}" for i in range(d)])
    two = own.select(F.col("node").alias("right"), F.col("a").alias("b"), F.col("bound").alias("bound_b"),
                     *[F.col(f"q_{i}").alias(f"w_{i}") for i in range(d)])
    met = pairs.join(one, "left").join(two, "right").select("a", "b", "bound_a", "bound_b", _dist(d).alias("d"))
    met = met.where(F.col("d") <= F.greatest("bound_a", "bound_b"))
    sides = F.array(F.when(F.col("d") <= F.col("bound_a"), F.struct(F.col("a").alias("a"), F.col("d").alias("d"))),
                    F.when(F.col("d") <= F.col("bound_b"), F.struct(F.col("b").alias("a"), F.col("d").alias("d"))))
    near = met.select(F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("s.*")
    every = own.select("a", F.explode("near").alias("d")).unionByName(near)
    w = Window.partitionBy("a").orderBy("d")
    best = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.groupBy("a").agg(F.max("d").alias("value")).withColumnRenamed("a", bid)


def distance_scale(base: DataFrame, key: str, stratum: str = "stratum", k: int = C.KNN_K,
                   n_dims: int = len(C.KNN_FEATURES), tree: BoxTree | None = None) -> DataFrame:
    """K4: per stratum, the 95th percentile of the k-th neighbour distance
    (self included) over all of its rows; 1.0 when that is 0, 10.0 when the
    stratum has fewer than 2 rows.  → (stratum, n, scale)."""
    t = tree or build_tree(base, k, n_dims, key, stratum)
    sizes = _kept(base.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), "knn-sizes")
    root = F.regexp_extract("node", "^(.*/)", 1)
    named = sizes.select(stratum, root_of(stratum).alias("_root"), "n")
    kth = _kept(kth_distances(t, k).join(t.rows.select(t.bid, root.alias("_root")), t.bid).select("_root", "value"), "knn-kth")
    # rows beyond the k lowest keys of their vector have k rows at distance 0; written out a thousand at a time
    spare = named.join(kth.groupBy("_root").agg(F.count(F.lit(1)).alias("m")), "_root").select(
        "_root", (F.col("n") - F.col("m")).alias("n")).where("n > 0")
    runs = spare.select("_root", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))).alias("r"))
    zeros = runs.repartition("_root", "r").select("_root", F.explode(F.sequence(F.lit(1).cast("long"), F.least(
        F.lit(1000), F.col("n") - F.col("r") * 1000))).alias("_z")).select("_root", F.lit(0.0).alias("value"))
    per = percentiles_long(kth.unionByName(zeros), [C.KNN_SCALE_PERCENTILE], ["_root"])
    out = named.join(per.select("_root", F.col("value").alias("q")), "_root", "left")
    scale = (F.when(F.col("n") < 2, F.lit(C.KNN_SCALE_FALLBACK_SMALL))
             .when(F.col("q") == 0, F.lit(C.KNN_SCALE_FALLBACK_ZERO)).otherwise(F.col("q")))
    return out.select(stratum, "n", scale.alias("scale"))


def similarity(distance_col: str = "distance", scale_col: str = "scale"):
    """K5: clamp(100·exp(−d / max(scale, 0.1)), 5, 100)."""
    s = F.greatest(F.col(scale_col), F.lit(C.KNN_SCALE_FLOOR))
    return F.greatest(F.lit(C.SIMILARITY_MIN),
                      F.least(F.lit(C.SIMILARITY_MAX), F.lit(100.0) * F.exp(-F.col(distance_col) / s)))


def neighbour_summary(records: DataFrame, qid: str = "query_id", charge: str = "actual_charge") -> DataFrame:
    """K7: count, min, max, mean and median of the neighbours' rounded charges
    per query (each group holds at most k rows)."""
    return records.groupBy(qid).agg(
        F.count(F.lit(1)).alias("count"), F.min(charge).alias("min"), F.max(charge).alias("max"),
        F.round(F.avg(charge)).cast("int").alias("mean"),
        F.round(F.percentile(charge, 0.5)).cast("int").alias("median"))


#: Random-projection trees, projections of each (a level takes the next one), rows of a bucket.
TREES, PROJECTIONS, BUCKET = 6, 16, 96


def _projections(dims: int, trees: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed).normal(size=(trees, PROJECTIONS, dims))
    return r / np.linalg.norm(r, axis=2, keepdims=True)


def _projected(df: DataFrame, group: str, trees: int, seed: int, name: str) -> DataFrame:
    """(name, vec, node, proj): every row once per tree, at the root of its group, with its projections."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vec = part.column("vec")
                x = np.asarray(vec.flatten().to_numpy(), dtype=float).reshape(part.num_rows, -1)
                for t, r in enumerate(_projections(x.shape[1], trees, seed)):
                    p = x @ r.T
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), vec, pa.array([f"{t}/{g}/" for g in part.column("g").to_pylist()], pa.string()),
                         pa.ListArray.from_arrays(np.arange(0, p.size + 1, PROJECTIONS, dtype=np.int32), p.ravel())],
                        names=[name, "vec", "node", "proj"])

    kind = df.schema["id"].dataType.simpleString()
    rows = df.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"), F.col(group).cast("string").alias("g"))
    return rows.mapInArrow(run, f"{name} {kind}, vec array<double>, node string, proj array<double>")


def _best_in_bucket(k: int):
    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        matrix = lambda t: np.asarray(t.column("vec").combine_chunks().flatten().to_numpy(), dtype=float).reshape(len(t), -1)
        out: list[tuple] = [(queries.column("query_id").slice(0, 0).combine_chunks(),) * 2 + (np.zeros(0),)]
        if len(queries) and len(base):
            q, b, ids, own = matrix(queries), matrix(base), base.column("neighbor_id").combine_chunks(), queries.column("query_id").combine_chunks()
            order = np.argsort(ids.to_numpy(), kind="stable")  # ties go to the lower id
            b, ids = b[order], ids.take(pa.array(order))
            for at in range(0, len(q), 256):
                d = np.sqrt(((q[at:at + 256, None] - b[None]) ** 2).sum(axis=2))
                d[own.slice(at, 256).to_numpy()[:, None] == ids.to_numpy()[None]] = np.inf
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                i, j = np.nonzero(np.isfinite(np.take_along_axis(d, top, axis=1)))
                out.append((own.take(pa.array(at + i)), ids.take(pa.array(top[i, j])), d[i, top[i, j]]))
        return pa.table({"query_id": pa.chunked_array([o[0] for o in out]), "neighbor_id": pa.chunked_array([o[1] for o in out]),
                         "distance": np.concatenate([o[2] for o in out])})
    return run


def forest_neighbours(queries: DataFrame, base: DataFrame, k: int, group: str, trees: int = TREES, bucket: int = BUCKET,
                      seed: int = C.SPLIT_SEED) -> DataFrame:
    """Approximate k nearest neighbours of the same ``group`` by a forest of random-projection trees.

    Both sides: (id, group, vec).  In each tree a bucket with more than ``bucket`` rows, and only such a one, is refined: cut
    at quantiles of one more random projection, so that even near copies part, and no bucket stays larger
    (rows with equal vectors cannot be parted; reduce them to k + 1 before).  A query goes down to its bucket,
    and at each level also into the buckets beside its own; all rows met are ranked by exact distance inside the
    buckets.  So a query meets at most trees x (1 + 2 x levels) buckets.  The result is (query_id, rank,
    neighbor_id, distance, found): ``found`` says how many neighbours the buckets gave the query."""
    now = _kept(_projected(base, group, trees, seed, "neighbor_id"), "forest-rows")
    at = _kept(_projected(queries, group, trees, seed, "query_id").withColumn("main", F.lit(True)), "forest-queries")
    fractions = F.array(*[F.lit(j / FAN) for j in range(1, FAN)])
    done, level = [], 0
    digit = lambda child: F.substring(F.lit("0123456789abcdef"), child + 1, F.lit(1))
    while True:
        value = F.col("proj")[F.lit(level % PROJECTIONS)]
        cuts = _kept(now.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo"),
                                             F.percentile_approx(value, fractions, 1000).alias("p"))
                     .where((F.col("n") > bucket) & (F.col("lo") < F.col("hi")))
                     .withColumn("p", F.array_distinct(F.filter("p", lambda c: c < F.col("hi"))))
                     .select("node", F.when(F.size("p") > 0, F.col("p")).otherwise(F.array("lo")).alias("cuts")), "forest-cuts")
        n_open = cuts.count()
        if not n_open:
            break
        child = F.size(F.filter("cuts", lambda c: c < value))
        moved = _kept(now.join(cuts, "node", "left").select(
            "neighbor_id", "vec", "proj", F.col("cuts").isNotNull().alias("open"),
            F.when(F.col("cuts").isNotNull(), F.concat("node", digit(child))).otherwise(F.col("node")).alias("node")), "forest-rows")
        done.append(moved.where("NOT open").drop("open"))
        now = moved.where("open").drop("open")
        beside = F.filter(F.array(child - 1, child, child + 1), lambda c: (c == child) | (
            F.col("main") & (c >= 0) & (c <= F.size("cuts"))))
        steps = F.when(F.col("cuts").isNotNull(), F.transform(beside, lambda c: F.struct(
            F.concat("node", digit(c)).alias("node"), (F.col("main") & (c == child)).alias("main")))).otherwise(
            F.array(F.struct(F.col("node").alias("node"), F.col("main").alias("main"))))
        at = _kept(at.join(cuts, "node", "left").select("query_id", "vec", "proj", F.explode(steps).alias("s"))
                   .select("query_id", "vec", "proj", "s.*"), "forest-queries")
        level += 1
    for d in done:
        now = now.unionByName(d)
    kind, other = (f.dataType.simpleString() for f in (at.schema["query_id"], now.schema["neighbor_id"]))
    asked = at.select("node", "query_id", "vec").groupBy("node")
    best = asked.cogroup(now.select("node", "neighbor_id", "vec").groupBy("node")).applyInArrow(
        _best_in_bucket(k), f"query_id {kind}, neighbor_id {other}, distance double").distinct()
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance",
                      F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("int").alias("found"))
