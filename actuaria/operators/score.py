"""Scoring, ensemble band, counterfactuals and attributions.

All per-profile work is narrow: features, every model score, both what-if
variants and the attribution arrays are columns of the same row, so a
table of profiles is scored in a single stage with no shuffle.  The only
wide step is the one-row background mean used by linear attributions,
fitted once and applied as literals.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.config import FixedLinear
from actuaria.functions.columns import display_name, feature_columns, floor_zero
from actuaria.operators.models import predict


# ---------------------------------------------------------------- F2 / I1

FP = "f_"  # feature-column prefix: raw profile columns keep their names


def with_features(df: DataFrame, prefix: str = FP, overrides: dict | None = None,
                  scaler: dict | None = None) -> DataFrame:
    """add the ten model features (optionally prefixed) from the raw
    profile columns; ``overrides`` replaces raw inputs with expressions.
    ``scaler`` ({feature: {mean, std}}) defaults to the fixed serving
    constants; models fitted here are served with the scaler of their own
    training run (``Preprocessed.scaler_dict()``)."""
    raw = {c: F.col(c) for c in C.PROFILE_COLUMNS}
    raw.update(overrides or {})
    feats = feature_columns(raw["age"], raw["sex"], raw["bmi"], raw["children"],
                            raw["smoker"], raw["region"], scaler)
    return df.select("*", *[feats[f].alias(f"{prefix}{f}") for f in C.FEATURES])


def score_cost(df: DataFrame, model, out_col: str = "cost", prefix: str = FP) -> DataFrame:
    """Primary-model prediction floored at zero."""
    raw = f"_raw_{out_col}"
    return predict(df, model, raw, prefix).withColumn(out_col, floor_zero(raw)).drop(raw)


def drop_features(df: DataFrame, prefix: str = FP) -> DataFrame:
    return df.drop(*[f"{prefix}{f}" for f in C.FEATURES])


# ---------------------------------------------------------------- I2

def confidence_band(df: DataFrame, models: Sequence, out_col: str = "confidence") -> DataFrame:
    """struct<low, mid, high INT> = min / mean / max of the floored
    member predictions; null when fewer than two members produce a value."""
    out = df
    names = []
    for i, m in enumerate(models):
        name = f"_member_{i}"
        out = score_cost(out, m, name)
        names.append(name)
    preds = F.filter(F.array(*[F.col(n) for n in names]), lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(preds)
    mean = F.aggregate(preds, F.lit(0.0), lambda acc, x: acc + x) / n
    band = F.when(n >= 2, F.struct(
        F.round(F.array_min(preds)).cast("int").alias("low"),
        F.round(mean).cast("int").alias("mid"),
        F.round(F.array_max(preds)).cast("int").alias("high")))
    return out.withColumn(out_col, band).drop(*names)


# ---------------------------------------------------------------- I3 / I4

def _scenario(current: Column, new: Column) -> Column:
    savings = current - new
    return F.when(savings > 0, F.struct(
        F.round(current).cast("int").alias("current"),
        F.round(new).cast("int").alias("new"),
        F.round(savings).cast("int").alias("savings")))


def what_if(df: DataFrame, model, cost_col: str = "cost", bmi_target: float = C.HEALTHY_BMI,
            scaler: dict | None = None) -> DataFrame:
    """Re-score smokers as non-smokers and BMI > 25 as BMI 25, keep a
    scenario only when it saves money.  Both variants are scored as extra
    columns of the same row (no fan-out, no shuffle).  Adds
    ``scenarios struct<quit_smoking, healthy_bmi>``."""
    out = with_features(df, "q__", {"smoker": F.lit("no")}, scaler)
    out = with_features(out, "b__", {"bmi": F.lit(float(bmi_target))}, scaler)
    out = score_cost(out, model, "_cost_quit", "q__")
    out = score_cost(out, model, "_cost_bmi", "b__")
    out = drop_features(drop_features(out, "q__"), "b__")
    quit = F.when(F.lower("smoker") == "yes", _scenario(F.col(cost_col), F.col("_cost_quit")))
    bmi = F.when(F.col("bmi") > bmi_target, _scenario(F.col(cost_col), F.col("_cost_bmi")))
    return out.withColumn("scenarios", F.struct(quit.alias("quit_smoking"), bmi.alias("healthy_bmi"))) \
              .drop("_cost_quit", "_cost_bmi")


def scenario_rows(df: DataFrame, key: str) -> DataFrame:
    """Flatten the scenarios struct to (key, scenario, current, new, savings)."""
    arr = F.array_compact(F.array(
        *[F.when(F.col(f"scenarios.{s}").isNotNull(),
                 F.struct(F.lit(s).alias("scenario"), F.col(f"scenarios.{s}.current").alias("current"),
                          F.col(f"scenarios.{s}.new").alias("new"),
                          F.col(f"scenarios.{s}.savings").alias("savings")))
          for s in ("quit_smoking", "healthy_bmi")]))
    return df.select(key, F.inline(arr))


# ---------------------------------------------------------------- I6 (linear)

def feature_means(features_df: DataFrame, prefix: str = FP) -> DataFrame:
    """One-row background: mean of every model feature."""
    return features_df.agg(*[F.avg(F.col(f"{prefix}{f}").cast("double")).alias(f"_mu_{f}") for f in C.FEATURES])


def linear_shap(df: DataFrame, model: FixedLinear, background: DataFrame, out_col: str = "shap",
                prefix: str = FP) -> DataFrame:
    """Exact attributions of a raw-scale linear scorer: β_i·(x_i − E[x_i]),
    as ``array<double>`` in feature order."""
    if model.log_target:
        raise ValueError("linear attributions are defined on the raw scale only")
    if not isinstance(background, dict):
        background = background.first().asDict()  # fitted means: one row
    joined = df
    mu = {f: F.lit(None if background[f"_mu_{f}"] is None else float(background[f"_mu_{f}"])).cast("double")
          for f in C.FEATURES}  # empty background: null means
    vals = [F.lit(float(model.coefficients.get(f, 0.0))) * (F.col(f"{prefix}{f}").cast("double") - mu[f])
            for f in C.FEATURES]
    return joined.withColumn(out_col, F.array(*vals))


def base_value(model: FixedLinear, background: DataFrame) -> DataFrame:
    """E[f(x)] of a linear scorer: f evaluated at the background means."""
    expr = F.lit(float(model.intercept))
    for f in C.FEATURES:
        expr = expr + F.lit(float(model.coefficients.get(f, 0.0))) * F.col(f"_mu_{f}")
    return background.select(expr.alias("base_value"))


def shap_bars(shap_col: str = "shap", digits: int = 2) -> Column:
    """array<struct<name, value>> ordered by |value| desc, then feature
    index asc (one tie rule for bars and batch), values rounded."""
    names = F.array(*[F.lit(f) for f in C.FEATURES])
    items = F.transform(F.col(shap_col), lambda v, i: F.struct(
        i.alias("idx"), v.alias("raw"), F.element_at(names, i + 1).alias("feature")))

    def cmp(a, b):
        aa, bb = F.abs(a["raw"]), F.abs(b["raw"])
        return (F.when(aa > bb, -1).when(aa < bb, 1)
                .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))

    ordered = F.array_sort(items, cmp)
    return F.transform(ordered, lambda s: F.struct(
        display_name(s["feature"]).alias("name"), F.round(s["raw"], digits).alias("value")))


def top_drivers(bars_col: str = "shap_bars", n: int = 2) -> Column:
    """The first ``n`` bars as (name, increases|decreases, |value|)."""
    return F.transform(F.slice(F.col(bars_col), 1, n), lambda b: F.struct(
        b["name"].alias("name"),
        F.when(b["value"] > 0, "increases").otherwise("decreases").alias("direction"),
        F.abs(b["value"]).alias("impact")))


def mean_abs_attribution(df: DataFrame, shap_col: str = "shap", digits: int = 6) -> DataFrame:
    """I6 (global): mean |attribution| per feature, ranked."""
    from pyspark.sql import Window
    names = F.array(*[F.lit(f) for f in C.FEATURES])
    long = df.select(F.posexplode(shap_col).alias("i", "v")).select(
        F.element_at(names, F.col("i") + 1).alias("feature"), F.abs("v").alias("a"))
    agg = long.groupBy("feature").agg(F.round(F.avg("a"), digits).alias("mean_abs_shap"))
    return agg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))


# ---------------------------------------------------------------- I9 / I10

def batch_predict(parsed: DataFrame, model, explain, row_id: str = "row_id",
                  scaler: dict | None = None) -> DataFrame:
    """Parsed upload → cost (2 dp), top attribution name and signed
    impact (2 dp), or the row's error.  ``explain(df) → df + shap array``."""
    ok = F.col("error").isNull()
    feats = with_features(parsed, scaler=scaler)
    scored = score_cost(feats, model, "_cost")
    explained = explain(scored)
    top = F.element_at(shap_bars("shap"), 1)
    out = explained.select(
        row_id, *C.PROFILE_COLUMNS,
        F.when(ok, F.round("_cost", 2)).alias("predicted_cost"),
        F.when(ok, top["name"]).alias("top_shap_feature"),
        F.when(ok, top["value"]).alias("top_shap_impact"),
        "error")
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """Total, successful, failed and mean/min/max of the rounded
    costs (0 when no row succeeded)."""
    p = F.col("predicted_cost")
    ok = F.col("error").isNull()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(ok.cast("long")).alias("successful"),
        F.sum((~ok).cast("long")).alias("failed"),
        F.coalesce(F.round(F.avg(F.when(ok, p)), 2), F.lit(0.0)).alias("mean_prediction"),
        F.coalesce(F.round(F.min(F.when(ok, p)), 2), F.lit(0.0)).alias("min_prediction"),
        F.coalesce(F.round(F.max(F.when(ok, p)), 2), F.lit(0.0)).alias("max_prediction"),
    ).select("total", F.coalesce("successful", F.lit(0)).alias("successful"),
             F.coalesce("failed", F.lit(0)).alias("failed"),
             "mean_prediction", "min_prediction", "max_prediction")
