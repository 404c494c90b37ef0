"""Models (M1–M9, M12, S8): linear fits on MLlib, boosted trees (``boosting``), and the uniform scoring protocol.

``predict(df, model, out_col)`` accepts either a ``FixedLinear`` (scored as
a pure column expression, so it can be checked against SQL) or a
``FittedModel`` wrapping boosted trees or any MLlib regression model.  All read the ten
feature columns by name (optionally with a prefix, which is how what-if
variants are scored side by side without a shuffle).
"""
from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.config import FixedLinear
from actuaria.operators import boosting, model_store
from actuaria.operators.boosting import BoostedTrees


@dataclass
class FittedModel:
    name: str
    model: Any
    log_target: bool = False
    features: list = field(default_factory=lambda: list(C.FEATURES))


# ---------------------------------------------------------------- scoring

def linear_expression(m: FixedLinear, prefix: str = "") -> Column:
    terms = [F.lit(float(m.intercept))]
    terms += [F.col(f"{prefix}{f}").cast("double") * F.lit(float(m.coefficients.get(f, 0.0)))
              for f in C.FEATURES]
    raw = reduce(lambda a, b: a + b, terms)
    return F.expm1(raw) if m.log_target else raw


def predict(df: DataFrame, model, out_col: str = "prediction", prefix: str = "") -> DataFrame:
    """Append the raw (unfloored) prediction of ``model`` as ``out_col``."""
    if isinstance(model, FixedLinear):
        return df.withColumn(out_col, linear_expression(model, prefix))
    if isinstance(model.model, BoostedTrees):
        raw = model.model.column(*[F.col(f"{prefix}{f}") for f in model.features])
        return df.withColumn(out_col, F.expm1(raw) if model.log_target else raw)
    vec = f"_vec_{out_col}"
    assembled = VectorAssembler(inputCols=[f"{prefix}{f}" for f in model.features],
                                outputCol=vec, handleInvalid="keep").transform(df)
    m = model.model.copy()
    m.setFeaturesCol(vec)
    m.setPredictionCol(out_col)
    out = m.transform(assembled).drop(vec)
    if model.log_target:
        out = out.withColumn(out_col, F.expm1(F.col(out_col)))
    return out


# ---------------------------------------------------------------- training

def assemble(df: DataFrame, features=C.FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def _label(df: DataFrame, target: str, log_target: bool) -> DataFrame:
    y = F.col(target).cast("double")
    return df.withColumn("label", F.log1p(y) if log_target else y)


def training_rows(train: DataFrame, target: str, log_target: bool, features=C.FEATURES,
                  extra: tuple = ()) -> DataFrame:
    """(label, features vector[, extra]) written once to the shared checkpoint
    folder: the estimators make several passes, which then read these rows
    instead of re-deriving the preprocessing chain, and a lost executor
    recomputes from the files."""
    data = assemble(_label(train, target, log_target), features).select("label", "features", *extra)
    return data.checkpoint(eager=True)


def fit_ols(train: DataFrame, target: str = C.TARGET, log_target: bool = True,
            features=C.FEATURES) -> FittedModel:
    """M1: ordinary least squares (normal equations, no penalty)."""
    data = training_rows(train, target, log_target, features)
    lr = LinearRegression(featuresCol="features", labelCol="label", solver="normal",
                          regParam=0.0, elasticNetParam=0.0, standardization=False)
    return FittedModel("linear_regression", lr.fit(data), log_target, list(features))


def fit_ridge(train: DataFrame, alpha: float = C.RIDGE_ALPHA, target: str = C.TARGET,
              log_target: bool = True, features=C.FEATURES) -> FittedModel:
    """M2: ridge with the penalty of ``||y − Xw||² + α||w||²``.

    MLlib minimises 1/(2n)·Σr² + λ/2·||w||² on an internally scaled label,
    so λ = α·σ_pop(y)/n reproduces the closed form.
    """
    data = training_rows(train, target, log_target, features)
    stats = data.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    lam = alpha * float(stats["sd"]) / float(stats["n"])
    lr = LinearRegression(featuresCol="features", labelCol="label", solver="normal",
                          regParam=lam, elasticNetParam=0.0, standardization=False)
    model = lr.fit(data)
    return FittedModel("ridge_regression", model, log_target, list(features))


def grid_for(style: str) -> dict:
    """The published grid of a family."""
    extra = {"xgboost": C.XGB_EXTRA_GRID, "lightgbm": C.LGBM_EXTRA_GRID,
             "gradient_boosting": C.GB_EXTRA_GRID}[style]
    return {**C.COMMON_PARAM_GRID, **extra}


def grid_size(grid: dict) -> int:
    return reduce(lambda a, b: a * b, (len(v) for v in grid.values()), 1)


def sample_params(grid: dict, n_iter: int, seed: int = C.SPLIT_SEED) -> list[dict]:
    """M7: ``n_iter`` distinct combinations, drawn without replacement by
    index and decoded in mixed radix (last key varies fastest)."""
    keys = list(grid)
    size = grid_size(grid)
    picks = random.Random(seed).sample(range(size), min(n_iter, size))
    out = []
    for idx in picks:
        combo = {}
        for k in reversed(keys):
            vals = grid[k]
            combo[k] = vals[idx % len(vals)]
            idx //= len(vals)
        out.append({k: combo[k] for k in keys})
    return out


@dataclass
class Search:
    """Result of a random search of one family."""
    fitted: FittedModel
    best: dict
    score: float
    draws: list  # (params, CV R², is best)


def with_folds(train: DataFrame, folds: int = C.CV_FOLDS, fold_col: str = "fold", contiguous: bool = True) -> DataFrame:
    """Rows with their fold: runs of the key order, or hash folds; rows that bring folds keep them."""
    from actuaria.operators.preprocess import contiguous_fold, hash_fold
    if fold_col in train.columns:
        return train
    return (contiguous_fold(train, C.KEY, folds, fold_col) if contiguous
            else train.withColumn(fold_col, hash_fold(C.KEY, folds)))


def random_searches(train: DataFrame, styles, n_iter: int = C.SEARCH_ITERATIONS, folds: int = C.CV_FOLDS, fold_col: str = "fold",
                    grid: dict | None = None, contiguous: bool = True, target: str = C.TARGET,
                    seed: int = C.SPLIT_SEED) -> dict[str, Search]:
    """M7–M9: random search with k-fold CV on R² for each family, the winners refitted on all training rows.

    ``grid`` is the space drawn from (the published one of the family by default).  The rows are binned once; the models of
    all draws, folds and families are grown together, then the winners.  The result is kept in the model store, so
    that the same search on the same rows is not run again."""
    styles = tuple(styles)
    draws = {s: sample_params(grid or grid_for(s), n_iter, seed) for s in styles}
    data = with_folds(train, folds, fold_col, contiguous).select(C.KEY, *C.FEATURES, target, fold_col).checkpoint(eager=True)
    digest = model_store.digest(data)
    key = model_store.key_of(digest, "search", draws, folds, seed, target)
    path = model_store.find(train.sparkSession, key)
    if path is None:
        table = boosting.bin_rows(data, C.FEATURES, target, C.KEY, fold_col)
        specs = [boosting.spec_for(s, p, seed) for s in styles for p in draws[s]]
        r2 = boosting.cross_validated(table, specs, folds).mean(axis=1)
        at = np.cumsum([0] + [len(draws[s]) for s in styles])
        rows = [(s, i, json.dumps(draws[s][i]), float(r2[at[k] + i])) for k, s in enumerate(styles) for i in range(len(draws[s]))]
        scores = train.sparkSession.createDataFrame(rows, "model string, draw int, params string, cv_r2 double")
        path = model_store.publish(train.sparkSession, key, lambda p: scores.coalesce(1).write.parquet(f"{p}/scores"))
    found = train.sparkSession.read.parquet(f"{path}/scores").orderBy("model", "draw").collect()
    scores = {s: [r["cv_r2"] for r in found if r["model"] == s] for s in styles}
    best = {s: max(range(len(draws[s])), key=lambda i: scores[s][i]) for s in styles}
    fitted = fit_boosted(data, [(s, draws[s][best[s]]) for s in styles], target, seed, digest=digest)
    return {s: Search(f, draws[s][best[s]], scores[s][best[s]],
                      [(p, r, i == best[s]) for i, (p, r) in enumerate(zip(draws[s], scores[s]))])
            for s, f in zip(styles, fitted)}


def random_search(train: DataFrame, style: str, n_iter: int = C.SEARCH_ITERATIONS, folds: int = C.CV_FOLDS, **more):
    """One family's search: (FittedModel, best params, best CV R², [(params, CV R², is best)])."""
    s = random_searches(train, [style], n_iter, folds, **more)[style]
    return s.fitted, s.best, s.score, s.draws


def fit_boosted(train: DataFrame, wanted: list[tuple[str, dict]], target: str = C.TARGET, seed: int = C.SPLIT_SEED,
                digest: str | None = None) -> list[FittedModel]:
    """M3–M5: the models (family, params), from the model store where the same rows, parameters and seed were fitted before;
    the others are grown together in one pass over the binned rows, and stored."""
    spark = train.sparkSession
    digest = digest or model_store.digest(train.select(C.KEY, *C.FEATURES, target))
    keys = [model_store.key_of(digest, "boosted", style, params, target, seed) for style, params in wanted]
    missing = [k for k in dict.fromkeys(keys) if model_store.find(spark, k) is None]
    if missing:
        table = boosting.bin_rows(train, C.FEATURES, target, C.KEY)
        new = [wanted[keys.index(k)] for k in missing]
        models = boosting.fit(table, [boosting.spec_for(style, params, seed) for style, params in new])
        for k, (style, _), model in zip(missing, new, models):
            fitted = FittedModel(style, model, False, list(C.FEATURES))
            model_store.publish(spark, k, lambda path, fitted=fitted: save_model(fitted, path))
    return [load_model(model_store.find(spark, k)) for k in keys]


def fit_gbt(train: DataFrame, style: str, params: dict, target: str = C.TARGET, seed: int = C.SPLIT_SEED) -> FittedModel:
    """One boosted model, fitted once per rows, parameters and seed."""
    return fit_boosted(train, [(style, params)], target, seed)[0]


def gain_importance(spark, fitted: FittedModel, digits: int = 4) -> DataFrame:
    """Normalised split-gain importance (%) per feature, ranked."""
    imp = fitted.model.importance()
    total = float(sum(imp)) or 1.0
    rows = [(f, float(v) * 100.0 / total) for f, v in zip(fitted.features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance_pct double")
    from pyspark.sql import Window
    return df.select("feature", F.round("importance_pct", digits).alias("importance_pct"),
                     F.row_number().over(Window.orderBy(F.desc("importance_pct"), "feature")).alias("rank"))


# ---------------------------------------------------------------- S8 model store

_MODEL_CACHE: dict[str, FittedModel] = {}


def save_model(fitted: FittedModel, path: str) -> str:
    """Save a model with a one-row table of what serving needs (name, kind, features, target scale, start value)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    boosted = isinstance(fitted.model, BoostedTrees)
    if boosted:
        trees = [(r["tree"], r["feature"], r["threshold"], r["left"], r["right"], r["value"], r["cover"], r["gain"])
                 for r in fitted.model.rows()]
        spark.createDataFrame(trees, TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    meta = [(fitted.name, "boosted" if boosted else "linear", list(fitted.features), bool(fitted.log_target),
             fitted.model.start if boosted else 0.0)]
    (spark.createDataFrame(meta, "name string, kind string, features array<string>, log_target boolean, start double")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/meta"))
    _MODEL_CACHE.pop(path, None)
    return path


TREES = boosting.TREE.removeprefix("model int, ")


def load_model(path: str) -> FittedModel:
    """Load a saved model by its path alone; the handle is kept until the path is saved to again."""
    if path not in _MODEL_CACHE:
        from pyspark.ml.regression import LinearRegressionModel
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["kind"] == "boosted":
            trees = spark.read.schema(TREES).parquet(f"{path}/model").toArrow().to_pylist()  # the size of the model
            model = BoostedTrees.of(list(meta["features"]), meta["start"], trees)
        else:
            model = LinearRegressionModel.load(f"{path}/model")
        _MODEL_CACHE[path] = FittedModel(meta["name"], model, meta["log_target"], list(meta["features"]))
    return _MODEL_CACHE[path]
