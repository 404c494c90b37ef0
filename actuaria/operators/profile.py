"""Profiling and exploratory aggregations.

Every function is DataFrame → DataFrame.  Wide per-column statistics are
computed in one pass by unpivoting to (column, value) and aggregating by
column, so the number of jobs does not grow with the number of columns.
One-row statistics (min/max for bins) are fitted once — one aggregate,
one row to the driver — and enter expressions as literals: no join, and
no repeated subquery per reference.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actuaria import config as C
from actuaria.functions.columns import kurtosis_unbiased, skewness_unbiased, value_map
from actuaria.operators.quantiles import SALTS, percentiles_long, quantile_table, to_long  # noqa: F401


# ---------------------------------------------------------------- E15 helpers

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _column_list(cols: Sequence[str]):
    return F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column"))
                     for i, c in enumerate(cols)])


# ---------------------------------------------------------------- E1–E5

def shape(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, total rows and column count."""
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.inline(_column_list(df.columns)), "n_rows",
                    F.lit(len(df.columns)).alias("n_columns")))


def head(df: DataFrame, n: int = 10, key: str = C.KEY) -> DataFrame:
    """First ``n`` rows by key (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(key).limit(n)


def info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column, one aggregate."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column"),
                              F.lit(t).alias("dtype"), F.col(c).alias("non_null"))
                     for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(rows))


def missing_report(df: DataFrame) -> DataFrame:
    """Null count and percentage per column plus the frame total."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"))
                     for c in df.columns])
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    out = sums.select("_n", total.alias("total_missing"), F.inline(rows))
    return out.select(
        "column", "n_missing",
        F.round(F.when(F.col("_n") > 0, F.col("n_missing") * 100.0 / F.col("_n")).otherwise(0.0), 4)
        .alias("pct_missing"),
        "total_missing")


def missing_patterns(df: DataFrame) -> DataFrame:
    """E5: the per-cell null map, re-aimed as counts of each null pattern."""
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_null") for c in df.columns]
    return df.select(*flags).groupBy(*[f"{c}_null" for c in df.columns]).agg(
        F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- E6–E9

def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6,
                     method: str = "exact") -> DataFrame:
    """Count, mean, std (ddof=1), min, 25/50/75 % (exact, linear — or
    ``method="approx"`` for a bounded sketch), max."""
    cols = list(cols or numeric_columns(df))
    long = to_long(df, cols)
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = percentiles_long(long, [0.25, 0.5, 0.75], ["column"], method=method)
    qs = qs.groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
        for p, n in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]])
    # from the column list, so that a column without any value keeps its row (count 0)
    out = column_rows(df, cols).join(moments, "column", "left").join(qs, "column", "left")
    r = lambda c: F.round(c, digits).alias(c)
    return out.select("column", F.coalesce("count", F.lit(0).cast("long")).alias("count"), r("mean"), r("std"), r("min"), r("p25"),
                      r("p50"), r("p75"), r("max"))


def column_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column): one row per name."""
    return df.sparkSession.createDataFrame([(c,) for c in cols], "column string")


def by_column(values: dict):
    """A per-column constant, looked up by ``column``: fitted values of a known column list need no join."""
    if not values:
        return F.lit(None).cast("double")
    pairs = [x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast("double"))]
    return F.create_map(*pairs)[F.col("column")]


def _value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top, freq per string column.

    ``top`` is the most frequent value, ties to the smallest value; picked
    with a min over (−count, value) structs, i.e. a plain aggregate.
    """
    cols = list(cols or string_columns(df))
    vc = _value_counts_long(df, cols)
    best = F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value")))
    return vc.groupBy("column").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("_b")
    ).select("column", "count", "unique", F.col("_b.value").alias("top"),
             (-F.col("_b.neg")).alias("freq"))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count), frequency descending then value."""
    cols = list(cols or string_columns(df))
    return _value_counts_long(df, cols).orderBy("column", F.desc("count"), "value")


def value_share(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Count and percentage of the column's non-null total."""
    cols = list(cols or string_columns(df))
    vc = _value_counts_long(df, cols)
    totals = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()  # one row: non-null totals
    return vc.select("column", "value", "count",
                     F.round(F.col("count") * 100.0 / by_column(totals), digits).alias("pct"))


# ---------------------------------------------------------------- E10–E12

def _bin_index(x, lo, hi, bins: int):
    width = (hi - lo) / F.lit(float(bins))
    idx = F.least(F.lit(bins - 1), F.floor((x - lo) / width).cast("int"))
    return F.when(hi == lo, F.lit(0)).otherwise(idx)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed on the right,
    empty bins reported with count 0.  Edges are lo + i·(hi − lo)/bins,
    unrounded."""
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    r = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()  # fitted range: one row
    lo, hi = F.lit(r["lo"]).cast("double"), F.lit(r["hi"]).cast("double")
    counts = (data.select(_bin_index(F.col("x"), lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (all_bins.join(counts, "bin", "left")
            .select("bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histograms(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """E10 for several columns: (column, bin, bin_lo, bin_hi, count).

    The ranges of the known columns are one fitted row; bins are computed row by row against
    literals, so only (column, bin) counts are shuffled.  A column without values has null edges."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = df.agg(*[f(real(c)).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = ({c: r[f"{n}_{c}"] for c in cols} for n in ("lo", "hi"))
    bin_of = lambda c: _bin_index(real(c), F.lit(lo[c]).cast("double"), F.lit(hi[c]).cast("double"), bins)
    counts = (df.select(*[F.when(real(c).isNotNull(), bin_of(c)).alias(c) for c in cols])
              .unpivot([], list(cols), "column", "bin").where(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    ranges = column_rows(df, cols).select("column", by_column(lo).alias("lo"), by_column(hi).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    all_bins = ranges.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (all_bins.join(counts, ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def boxplot_long(long: DataFrame, by: Sequence[str], digits: int = 6, method: str = "exact") -> DataFrame:
    """E11/E12 core: quartiles, whiskers (furthest points inside 1.5·IQR) and
    outlier count for every ``by`` group of a (by..., value) frame."""
    by = list(by)
    q = percentiles_long(long, [0.25, 0.5, 0.75], by, method=method)
    q = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                             for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("fence_lo", F.col("q1") - C.IQR_K * F.col("iqr"))
         .withColumn("fence_hi", F.col("q3") + C.IQR_K * F.col("iqr")))
    v = F.col("value")
    if by == ["column"]:  # known columns: the fences are a few fitted numbers
        fences = {r["column"]: (r["fence_lo"], r["fence_hi"]) for r in q.collect()}
        fenced = long.withColumns({n: by_column({c: f[i] for c, f in fences.items()})
                                   for i, n in enumerate(("fence_lo", "fence_hi"))})
    else:  # data-dependent groups: fences copied per salt, so a large group is spread
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        fenced = (long.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
                  .join(q.select(*by, "fence_lo", "fence_hi", salts), [*by, "_salt"]))
    stats = fenced.groupBy(*by).agg(
        F.min(F.when(v >= F.col("fence_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("fence_hi"), v)).alias("whisker_hi"),
        F.sum(((v < F.col("fence_lo")) | (v > F.col("fence_hi"))).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    out = q.join(stats, by)
    r = lambda c: F.round(c, digits).alias(c)
    return out.select(*by, "n", r("q1"), r("median"), r("q3"), r("iqr"),
                      r("whisker_lo"), r("whisker_hi"), "n_outliers")


def boxplot_stats(df: DataFrame, cols: Sequence[str], digits: int = 6, method: str = "exact") -> DataFrame:
    """Box-plot statistics per numeric column."""
    found = boxplot_long(to_long(df, cols), ["column"], digits, method)
    return column_rows(df, cols).join(found, "column", "left").fillna(0, ["n", "n_outliers"])


def grouped_boxplot(df: DataFrame, value: str, keys: Sequence[str], digits: int = 6,
                    method: str = "exact") -> DataFrame:
    """Box-plot statistics of ``value`` by each key, all keys in one job
    (keys are unpivoted to (grouping, group_value))."""
    keyed = df.select(F.col(value).cast("double").alias("value"),
                      *[F.col(k).cast("string").alias(k) for k in keys])
    long = keyed.unpivot(["value"], list(keys), "grouping", "group_value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return boxplot_long(long, ["grouping", "group_value"], digits, method)


# ---------------------------------------------------------------- E13–E14

def shape_stats(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    long = to_long(df, cols)
    return long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.round(skewness_unbiased("value"), digits).alias("skewness"),
        F.round(kurtosis_unbiased("value"), digits).alias("kurtosis"))


# ---------------------------------------------------------------- E16–E19

BINARY_MAPS = {"sex": {"male": 1, "female": 0}, "smoker": {"yes": 1, "no": 0}}


def encode_for_correlation(df: DataFrame) -> DataFrame:
    """E16 + drop-first one-hot of region: the encoded frame used for
    correlations (unmapped values become null)."""
    out = df
    for c, m in BINARY_MAPS.items():
        out = out.withColumn(c, value_map(c, m))
    for r in C.REGIONS[1:]:
        out = out.withColumn(f"region_{r}", (F.col("region") == r).cast("int"))
    return out.drop("region")


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6,
                       lower_only: bool = False) -> DataFrame:
    """Pearson correlation for every pair in **one** aggregate,
    unpivoted to (var_a, var_b, corr).  ``lower_only`` keeps pairs below the
    diagonal (index of var_a > index of var_b).  From ``WIDE`` columns on the sums are taken as matrices."""
    cols = list(cols)
    if len(cols) >= WIDE:
        return wide_correlation_matrix(df, cols, digits, lower_only)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if (i > j if lower_only else True)]
    unique = sorted({(min(i, j), max(i, j)) for i, j in pairs})
    agg = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"c_{i}_{j}")
                   for i, j in unique])
    rows = F.array(*[F.struct(F.lit(cols[i]).alias("var_a"), F.lit(cols[j]).alias("var_b"),
                              F.round(F.col(f"c_{min(i, j)}_{max(i, j)}"), digits).alias("corr"))
                     for i, j in pairs])
    return agg.select(F.inline(rows))


#: Columns from which a correlation matrix is summed as matrices instead of one expression per pair.
WIDE = 24


@dataclass
class Gram:
    """Sums over the rows where both columns of a pair hold a value, about ``centre``: counts, x, x squared, x times y."""
    centre: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Gram:
        there = ~np.isnan(rows)
        count = np.maximum(there.sum(axis=0), 1)
        centre = np.where(there, rows, 0.0).sum(axis=0) / count
        x, w = np.where(there, rows - centre, 0.0), there.astype(float)
        return cls(centre, w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x)

    def about(self, centre: np.ndarray) -> Gram:
        d = (self.centre - centre)[:, None]
        return Gram(centre, self.n, self.x + self.n * d, self.xx + 2 * d * self.x + self.n * d * d,
                    self.xy + d * self.x.T + self.x * d.T + self.n * d * d.T)

    def __add__(self, other: Gram) -> Gram:
        mine, theirs = np.diag(self.n), np.diag(other.n)
        centre = (self.centre * mine + other.centre * theirs) / np.maximum(mine + theirs, 1)
        a, b = self.about(centre), other.about(centre)
        return Gram(centre, a.n + b.n, a.x + b.x, a.xx + b.xx, a.xy + b.xy)

    def correlations(self) -> np.ndarray:
        n = np.maximum(self.n, 1)
        cov = self.xy - self.x * self.x.T / n
        var = self.xx - self.x * self.x / n
        both = var * var.T
        return np.where(both > 0, cov / np.sqrt(np.where(both > 0, both, 1.0)), np.nan)

    def pack(self) -> bytes:
        return np.concatenate([self.centre, *(m.ravel() for m in (self.n, self.x, self.xx, self.xy))]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, d: int) -> Gram:
        a = np.frombuffer(raw)
        return cls(a[:d], *(m.reshape(d, d) for m in np.split(a[d:], 4)))


def wide_correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6, lower_only: bool = False) -> DataFrame:
    """E17/E18 for many columns: as ``correlation_matrix``, from one pass over blocks of rows.

    A task turns its rows into sums of products, matrix by matrix; these are added up as a tree.  The plan does not
    grow with the number of pairs."""
    cols, d = list(cols), len(cols)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
                part = Gram.of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["gram"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("gram"):
                part = Gram.unpack(raw.as_py(), d)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["gram"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in added(batches):
            r = Gram.unpack(batch.column("gram")[0].as_py(), d).correlations()
            for i in range(d):
                at = [j for j in range(d) if i > j or not lower_only]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cols[i]] * len(at), pa.string()), pa.array([cols[j] for j in at], pa.string()),
                     pa.array([None if np.isnan(r[i, j]) else r[i, j] for j in at], pa.float64())], names=["var_a", "var_b", "corr"])

    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{k}") for k, c in enumerate(cols)])
    parts = rows.mapInArrow(block, "gram binary")
    some = parts.repartition(16).mapInArrow(added, "gram binary")
    return some.coalesce(1).mapInArrow(matrix, "var_a string, var_b string, corr double").select(
        "var_a", "var_b", F.round("corr", digits).alias("corr"))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """Correlation of each column with the target, ranked descending."""
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), digits).alias("corr"))
                     for c in cols])
    out = agg.select(F.inline(rows))
    w = Window.orderBy(F.desc("corr"), "feature")  # one row per feature: bounded
    return out.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- E20–E25

def group_summary(df: DataFrame, group: str, value: str, digits: int = 4, method: str = "exact") -> DataFrame:
    """Mean, median (exact), std (ddof=1), count of ``value`` by ``group``."""
    v = F.col(value).cast("double")
    base = df.select(F.col(group), v.alias("value"))
    agg = base.groupBy(group).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                  F.count("value").alias("count"))
    med = percentiles_long(base.where(F.col("value").isNotNull()), [0.5], [group], method=method).select(
        group, F.col("value").alias("median"))
    out = agg.join(med, group, "left")
    return out.select(group, F.round("mean", digits).alias("mean"), F.round("median", digits).alias("median"),
                      F.round("std", digits).alias("std"), "count")


def mean_ratio(df: DataFrame, group: str, value: str, num: str, den: str, digits: int = 4) -> DataFrame:
    """Ratio of group means, one row (conditional averages, one pass)."""
    g, v = F.col(group), F.col(value)
    return df.agg(F.round(F.avg(F.when(g == num, v)) / F.avg(F.when(g == den, v)), digits)
                  .alias("mean_ratio"))


def quality_checks(df: DataFrame, key: str = C.KEY) -> DataFrame:
    """(rule, violations) for required columns, row count, nulls,
    value domains and duplicate rows (ignoring the key)."""
    present = set(df.columns)
    rules = [F.struct(F.lit(f"required:{c}").alias("rule"),
                      F.lit(0 if c in present else 1).cast("long").alias("violations"))
             for c in C.RAW_COLUMNS]
    checks = {}
    checks["row_count:nonzero"] = F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)
    for c in C.RAW_COLUMNS:
        if c in present:
            checks[f"not_null:{c}"] = F.sum(F.col(c).isNull().cast("long"))
    domains = {"sex": F.col("sex").isin("male", "female"), "smoker": F.col("smoker").isin("yes", "no"),
               "region": F.col("region").isin(*C.REGIONS),
               "age": F.col("age").between(18, 64), "children": F.col("children").between(0, 5),
               "bmi": F.col("bmi") > 0, "charges": F.col("charges") > 0}
    for c, ok in domains.items():
        if c in present:
            checks[f"domain:{c}"] = F.sum((F.col(c).isNotNull() & ~ok).cast("long"))
    agg = df.agg(*[v.cast("long").alias(k.replace(":", "__")) for k, v in checks.items()])
    rows = F.array(*rules, *[F.struct(F.lit(k).alias("rule"), F.col(k.replace(":", "__")).alias("violations"))
                             for k in checks])
    one = agg.select(F.inline(rows))
    value_cols = [c for c in df.columns if c != key]
    dups = (df.groupBy(*value_cols).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("violations"))
            .select(F.lit("duplicates").alias("rule"), "violations"))
    return one.unionByName(dups)


def _bin_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """min / max of each column, fitted once (one aggregate, one row) as literals."""
    r = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"{c}__lo"),
                                           F.max(F.col(c).cast("double")).alias(f"{c}__hi"))]).first()
    return {k: F.lit(v).cast("double") for k, v in r.asDict().items()}


def scatter_bins(df: DataFrame, x: str, y: str, hue: str, bins: int = 20, digits: int = 4) -> DataFrame:
    """2-D binned counts and mean y per hue (bounded output, all rows)."""
    s = _bin_stats(df, [x, y])
    data = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                     F.col(hue).alias("hue"))
    binned = data.select(
        "hue", "_y",
        _bin_index(F.col("_x"), s[f"{x}__lo"], s[f"{x}__hi"], bins).alias("bin_x"),
        _bin_index(F.col("_y"), s[f"{y}__lo"], s[f"{y}__hi"], bins).alias("bin_y"))
    return binned.groupBy("hue", "bin_x", "bin_y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("_y"), digits).alias("mean_y")
    ).select(F.lit(x).alias("x_var"), F.lit(y).alias("y_var"), "hue", "bin_x", "bin_y", "n", "mean_y")


def pair_bins(df: DataFrame, cols: Sequence[str], hue: str, bins: int = 10) -> DataFrame:
    """Pair plot re-aimed as binned counts for every column pair (and
    the diagonal histograms) by hue, in one exploded aggregate."""
    cols = list(cols)
    s = _bin_stats(df, cols)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(hue).alias("hue"))
    binned = data.select("hue", *[
        _bin_index(F.col(c), s[f"{c}__lo"], s[f"{c}__hi"], bins).alias(f"{c}__b") for c in cols])
    pairs = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                               F.col(f"{a}__b").alias("bin_x"), F.col(f"{b}__b").alias("bin_y"))
                      for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])
    return (binned.select("hue", F.inline(pairs))
            .groupBy("var_x", "var_y", "hue", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))


def stats_card(df: DataFrame) -> DataFrame:
    """The dataset card: rows, average age / BMI (1 dp), average,
    max, min cost (whole), smoker and male share (%, 1 dp), mean cost by smoker."""
    ch = F.col("charges")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.round(F.avg("age"), 1).alias("avg_age"),
        F.round(F.avg("bmi"), 1).alias("avg_bmi"),
        F.round(F.avg(ch)).cast("long").alias("avg_cost"),
        F.round(F.max(ch)).cast("long").alias("max_cost"),
        F.round(F.min(ch)).cast("long").alias("min_cost"),
        F.round(F.avg((F.col("smoker") == "yes").cast("double")) * 100, 1).alias("smoker_pct"),
        F.round(F.avg((F.col("sex") == "male").cast("double")) * 100, 1).alias("male_pct"),
        F.round(F.avg(F.when(F.col("smoker") == "yes", ch))).cast("long").alias("smoker_avg"),
        F.round(F.avg(F.when(F.col("smoker") == "no", ch))).cast("long").alias("nonsmoker_avg"),
    )


def cost_band(smoker, bmi):
    return (F.when(F.col(smoker) != "yes", "non_smoker")
            .when(F.col(bmi) < 30, "smoker_bmi_lt_30").otherwise("smoker_bmi_ge_30"))


def cost_bands(df: DataFrame, digits: int = 4) -> DataFrame:
    """Three cost bands, each profiled, with the age slope of charges."""
    banded = df.withColumn("band", cost_band("smoker", "bmi"))
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("charges"), digits).alias("mean_charges"),
        F.round(F.min("charges"), digits).alias("min_charges"),
        F.round(F.max("charges"), digits).alias("max_charges"),
        F.round(F.regr_slope("charges", "age"), digits).alias("age_slope"),
        F.round(F.regr_intercept("charges", "age"), digits).alias("age_intercept"))

