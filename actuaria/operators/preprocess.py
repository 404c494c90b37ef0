"""Preprocessing (P1–P12): quantiles, IQR bounds and clipping, label and
one-hot encoding, scaling, inverse decoding and the deterministic split.

Fitted statistics (bounds, scaler moments) are fitted like MLlib models:
one distributed aggregate, one row back to the driver, then applied as
literals (constant-folded, no join).  Label maps are bounded by the number
of categories and joined back, AQE choosing the strategy at run time.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.functions.columns import is_value, unscale_const
from actuaria.operators.profile import by_column, column_rows
from actuaria.operators.quantiles import count_below, percentiles_long, quantile_table, to_long


# ---------------------------------------------------------------- P1–P3

def quartiles(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Linear-interpolated 25 % and 75 % quantiles per column."""
    return quantile_table(df, cols, [0.25, 0.75], ["q1", "q3"], method=method)


def _iqr_bounds(long: DataFrame, k: float, method: str) -> DataFrame:
    q = percentiles_long(long, [0.25, 0.75], ["column"], method=method)
    q = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
                                F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    return (q.withColumn("lower", F.col("q1") - k * (F.col("q3") - F.col("q1")))
            .withColumn("upper", F.col("q3") + k * (F.col("q3") - F.col("q1"))))


def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = C.IQR_K,
                   method: str = "exact") -> DataFrame:
    """(column, q1, q3, lower, upper, n_outliers) with strict < / > counts."""
    long = to_long(df, cols)
    q = _iqr_bounds(long, k, method)
    fitted = {r["column"]: (r["lower"], r["upper"]) for r in q.collect()}  # one row per known column
    lower, upper = (by_column({c: f[i] for c, f in fitted.items()}) for i in (0, 1))
    counts = long.groupBy("column").agg(
        F.sum(((F.col("value") < lower) | (F.col("value") > upper)).cast("long")).alias("n_outliers"))
    q = column_rows(df, cols).join(q, "column", "left")  # a column without values keeps its row
    return q.join(counts, "column", "left").select(
        "column", "q1", "q3", "lower", "upper", F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


def clip_outliers(df: DataFrame, cols: Sequence[str], k: float = C.IQR_K,
                  method: str = "exact") -> DataFrame:
    """Pull values outside [Q1−k·IQR, Q3+k·IQR] to the bound; never drops
    rows, nulls stay null, an empty column list is the identity."""
    cols = list(cols)
    if not cols:
        return df
    b = _iqr_bounds(to_long(df, cols), k, method)  # bounds only: no outlier counting pass
    one_row = b.agg(*[x for c in cols for x in (
        F.max(F.when(F.col("column") == c, F.col("lower"))).alias(f"_lo_{c}"),
        F.max(F.when(F.col("column") == c, F.col("upper"))).alias(f"_hi_{c}"))])
    s = one_row.first().asDict()  # fitted bounds: one row
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNull(), F.lit(None).cast("double"))
                             .otherwise(F.greatest(F.lit(s[f"_lo_{c}"]), F.least(F.lit(s[f"_hi_{c}"]), x))))
    return out


# ---------------------------------------------------------------- P4–P6

#: Classes of a column up to which its codes are literals; share of the rows from which a class counts as frequent;
#: classes of a range that is ranked at once; categories that may become columns.
LITERAL_CLASSES, FREQUENT, RANGE_CLASSES, MOST_CATEGORIES = 512, 1000, 200_000, 10_000


def class_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, class, n) of every class, counted where the rows are before anything moves; written once."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "class")
    return long.where(F.col("class").isNotNull()).groupBy("column", "class").agg(
        F.count(F.lit(1)).alias("n")).checkpoint(eager=True)


def ranked_classes(counts: DataFrame, range_classes: int = RANGE_CLASSES) -> DataFrame:
    """(column, class, n, code): a dense rank without a column's classes in one task.

    The classes are cut into ranges in their order, ranked inside their range, and moved by the classes of the
    ranges before."""
    parts = max(1, -(-counts.count() // range_classes))
    # which range a class lies in depends on a sample: written once, so that every later step sees the same
    ranged = counts.repartitionByRange(parts, "column", "class").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = ranged.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("column", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("column", "_part").orderBy("class")
    return (ranged.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["column", "_part"])
            .select("column", "class", "n", (F.col("_off") + F.col("_rank") - 1).cast("int").alias("code")))


def label_mapping(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: (column, class, code) with classes sorted ascending, codes from 0."""
    return ranked_classes(class_counts(df, cols)).select("column", "class", "code")


def label_encode(df: DataFrame, cols: Sequence[str], literal: int = LITERAL_CLASSES,
                 range_classes: int = RANGE_CLASSES) -> DataFrame:
    """Replace each column by its alphabetical class code.

    The classes are a fitted state, like a scaler's moments.  A column with up to ``literal`` of them gets its codes as
    one constant map, and its rows are not joined.  A column with more is joined to its classes; those that hold more than a
    thousandth of the rows (so at most a thousand) are literals all the same, so no join key is frequent."""
    ranked = ranked_classes(class_counts(df, cols), range_classes).checkpoint(eager=True)
    sizes = {r["column"]: (r["m"], r["rows"]) for r in ranked.groupBy("column").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("rows")).collect()}
    many = [c for c in cols if sizes.get(c, (0, 0))[0] > literal]
    often = F.lit(False)
    for c in many:
        often = often | ((F.col("column") == c) & (F.col("n") * FREQUENT > sizes[c][1]))
    codes: dict[str, dict] = {c: {} for c in cols}
    for r in ranked.where(~F.col("column").isin(many) | often).collect():  # at most ``literal`` or FREQUENT a column
        codes[r["column"]][r["class"]] = r["code"]

    def known(c: str):
        pairs = [x for k, v in codes[c].items() for x in (F.lit(k), F.lit(v))]
        return F.create_map(*pairs)[F.col(c).cast("string")] if pairs else F.lit(None).cast("int")

    out, own = df, "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    for k, c in enumerate(many):
        dictionary = ranked.where((F.col("column") == c) & (F.col("n") * FREQUENT <= sizes[c][1])).select(
            F.col("class").alias(f"{own}class{k}"), F.lit(0).alias(f"{own}salt{k}"), F.col("code").alias(f"{own}code{k}"))
        alone = known(c).isNotNull() | F.col(c).isNull()  # frequent and missing classes find nothing, spread over the join
        out = out.withColumns({f"{own}class{k}": F.when(alone, F.lit("")).otherwise(F.col(c).cast("string")),
                               f"{own}salt{k}": F.when(alone, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(1024)).cast("int"))
                               .otherwise(F.lit(0))}).join(dictionary, [f"{own}class{k}", f"{own}salt{k}"], "left")
    made = {c: F.coalesce(known(c), F.col(f"{own}code{many.index(c)}")) if c in many else known(c) for c in cols}
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def fit_categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    """The distinct non-null values of a column, ascending; they become columns, so there may be ``most`` of them."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(found)


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None,
            drop_first: bool = True, prefix: str | None = None) -> DataFrame:
    """0/1 INT columns appended after the others, categories sorted,
    the first dropped.  ``categories`` is a fitted input (it defines the
    schema); left out, it is fitted on the data (:func:`fit_categories`)."""
    if categories is None:
        categories = fit_categories(df, column)
    cats = sorted(categories)
    if drop_first:
        cats = cats[1:]
    prefix = prefix or column
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[is_value(column, v).alias(f"{prefix}_{v}") for v in cats])


# ---------------------------------------------------------------- P7–P10

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean and population std."""
    long = to_long(df, cols)
    return long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def scaler_row(stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    return stats.agg(*[x for c in cols for x in (
        F.max(F.when(F.col("column") == c, F.col("mean"))).alias(f"_mu_{c}"),
        F.max(F.when(F.col("column") == c, F.col("std"))).alias(f"_sd_{c}"))])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z = (x − μ)/σ with fitted stats; σ = 0 divides by 1."""
    one = scaler_row(stats, cols)
    s = one.first().asDict()  # fitted moments: one row
    out = df
    for c in cols:
        sd = s[f"_sd_{c}"]
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(s[f"_mu_{c}"]))
                             / F.lit(1.0 if sd == 0 else sd))
    return out


def scale_constants(df: DataFrame, cols: Sequence[str] = ("age", "bmi", "children")) -> DataFrame:
    """Z-scores with the fixed serving constants."""
    out = df
    for c in cols:
        s = C.SCALER[c]
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(s["mean"])) / F.lit(s["std"]))
    return out


def decode_features(df: DataFrame) -> DataFrame:
    """P10: scaled/encoded features back to readable values: age and
    children to the nearest integer, BMI to 1 dp, codes and dummies to words."""
    region = (F.when(F.col("region_northwest") == 1, "northwest")
              .when(F.col("region_southeast") == 1, "southeast")
              .when(F.col("region_southwest") == 1, "southwest").otherwise("northeast"))
    return df.select(
        *[c for c in df.columns if c not in C.FEATURES],
        F.round(unscale_const("age", "age")).cast("int").alias("age"),
        F.when(F.col("sex") == 1, "male").otherwise("female").alias("sex"),
        F.round(unscale_const("bmi", "bmi"), 1).alias("bmi"),
        F.round(unscale_const("children", "children")).cast("int").alias("children"),
        F.when(F.col("smoker") == 1, "yes").otherwise("no").alias("smoker"),
        region.alias("region"))


# ---------------------------------------------------------------- P11–P12

def _hash_order(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def assign_split(df: DataFrame, key: str = C.KEY, test_fraction: float = C.TEST_FRACTION,
                 seed: int = C.SPLIT_SEED, split_col: str = "split") -> DataFrame:
    """Exact, deterministic train/test split.

    The test set is the k = ceil(f·n) rows that come first in the order
    (md5(key:seed), key).  Rows are bucketed by the first 20 bits of the hash;
    the bucket totals (≤ 2²⁰ rows) locate the bucket holding the k-th row and
    its rank r inside that bucket.  Only that bucket's rows (≈ n/2²⁰) are
    ranked, giving the k-th pair (u*, key*); a row is in the test set iff
    (md5, key) ≤ (u*, key*).  The final assignment is a narrow comparison
    against that pair (two small fitted values): the table itself is never
    shuffled or sorted.
    """
    h = _hash_order(key, seed)
    hashed = df.withColumn("_u", h).withColumn(
        "_b", F.conv(F.substring("_u", 1, 5), 16, 10).cast("int"))
    totals = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    w_all = Window.partitionBy()  # over bucket totals only (bounded by 2^20 rows)
    w_cum = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = (totals.withColumn("_n", F.sum("_c").over(w_all))
           .withColumn("_k", F.ceil(F.lit(float(test_fraction)) * F.col("_n")))
           .withColumn("_after", F.sum("_c").over(w_cum))
           .withColumn("_before", F.col("_after") - F.col("_c")))
    boundary = cum.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_after"))).select(
        "_b", (F.col("_k") - F.col("_before")).alias("_r")).first()  # at most one row
    if boundary is None:  # k = 0: every row is train
        is_test = F.lit(False)
    else:
        edge = hashed.select("_u", "_b", key).where(F.col("_b") == F.lit(boundary["_b"]))
        w_edge = Window.orderBy("_u", key)  # rows of one hash bucket only
        thr = (edge.withColumn("_rn", F.row_number().over(w_edge)).where(F.col("_rn") == F.lit(boundary["_r"]))
               .select("_u", key).first())  # the k-th (hash, key) pair
        is_test = (F.col("_u") < F.lit(thr["_u"])) | (
            (F.col("_u") == F.lit(thr["_u"])) & (F.col(key) <= F.lit(thr[key])))
    return hashed.withColumn(split_col, F.when(is_test, "test").otherwise("train")).select(
        *df.columns, split_col)


def hash_fold(key: str = C.KEY, folds: int = C.CV_FOLDS, seed: int = C.SPLIT_SEED):
    """M8 fold id in [0, folds): md5(key:seed) prefix modulo folds (no global sort)."""
    return F.pmod(F.conv(F.substring(_hash_order(key, seed + 1), 1, 8), 16, 10).cast("long"),
                  F.lit(folds)).cast("int")


def contiguous_fold(df: DataFrame, key: str = C.KEY, folds: int = C.CV_FOLDS, fold_col: str = "fold") -> DataFrame:
    """M8 as the search uses it: rows in key order cut into ``folds`` runs, the first n mod k one row longer.

    The run boundaries are found without sorting the table: approximate cuts give ranges of about equal size,
    their counts say in which range a boundary lies, and only those ranges are ranked."""
    n = df.count()
    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    starts = [sum(sizes[:i]) for i in range(1, folds)]
    cuts = sorted(set(df.approxQuantile(key, [i / 1000 for i in range(1, 1000)], 1e-4))) if n else []
    if not cuts:
        return df.withColumn(fold_col, F.lit(0))
    at = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    ranged = df.select(F.col(key).alias("_k")).withColumn("_p", count_below(at, F.col("_k").cast("double")))
    counts = sorted((r["_p"], r["c"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect())
    wanted, before = [], 0
    for p, c in counts:
        wanted += [(p, s - before) for s in starts if before <= s < before + c]
        before += c
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    pairs = df.sparkSession.createDataFrame(wanted or [(-1, 0)], "_p int, _r int")
    edge = ranged.where(F.col("_p").isin([p for p, _ in wanted])).withColumn("_r", rank)
    firsts = [r["_k"] for r in edge.join(pairs, ["_p", "_r"]).select("_k").collect()]  # folds - 1 keys
    fold = sum((F.when(F.col(key) >= F.lit(k), 1).otherwise(0) for k in firsts), F.lit(0))
    return df.withColumn(fold_col, fold.cast("int"))


def xy_split(df: DataFrame, target: str = C.TARGET, key: str = C.KEY):
    """Features (key kept, target dropped) and the target with its key."""
    y_cols = [key, target] + (["split"] if "split" in df.columns else [])
    return df.drop(target), df.select(*y_cols)
