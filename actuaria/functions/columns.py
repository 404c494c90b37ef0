"""Column-level functions (no jobs, no Python per row).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage code generation.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from actuaria import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- statistics

def skewness_unbiased(c) -> Column:
    """Bias-corrected sample skewness (pandas / DuckDB ``skewness``).

    Spark's ``skewness`` is the population g1; G1 = g1·√(n(n−1))/(n−2).
    """
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c) -> Column:
    """Bias-corrected excess kurtosis (pandas / DuckDB ``kurtosis``).

    G2 = (n−1)/((n−2)(n−3)) · ((n+1)·g2 + 6) with Spark's population g2.
    """
    n = F.count(col(c)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)) + 6))


# ---------------------------------------------------------------- encoders

def value_map(c, mapping: Mapping[str, int]) -> Column:
    """CASE lookup without ELSE: unmapped values (and nulls) become null."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(col(c) == F.lit(k), F.lit(v)) if expr is None else expr.when(col(c) == F.lit(k), F.lit(v))
    return expr


def is_value(c, value: str) -> Column:
    """0/1 INT flag; null and anything else → 0 (the serving-time rule)."""
    return F.when(col(c) == F.lit(value), 1).otherwise(0)


def scale_const(c, feature: str, scaler: dict | None = None) -> Column:
    """(x − mean) / std with the fixed serving constants (or a fitted scaler)."""
    s = (scaler or C.SCALER)[feature]
    return (col(c) - F.lit(s["mean"])) / F.lit(s["std"])


def unscale_const(c, feature: str) -> Column:
    s = C.SCALER[feature]
    return col(c) * F.lit(s["std"]) + F.lit(s["mean"])


def interaction(a, b) -> Column:
    return col(a) * col(b)


def feature_columns(age, sex, bmi, children, smoker, region, scaler: dict | None = None) -> dict[str, Column]:
    """The ten ordered model features from raw profile columns.

    Words are compared lower-cased; unknown ``sex`` → 0 (female), unknown
    ``smoker`` → 0, unknown region → the all-zero northeast baseline.
    Interactions use the *scaled* values.
    """
    sex, smoker, region = F.lower(col(sex)), F.lower(col(smoker)), F.lower(col(region))
    age_s = scale_const(age, "age", scaler)
    bmi_s = scale_const(bmi, "bmi", scaler)
    smoker_enc = is_value(smoker, "yes")
    return {
        "age": age_s,
        "sex": is_value(sex, "male"),
        "bmi": bmi_s,
        "children": scale_const(children, "children", scaler),
        "smoker": smoker_enc,
        "region_northwest": is_value(region, "northwest"),
        "region_southeast": is_value(region, "southeast"),
        "region_southwest": is_value(region, "southwest"),
        "smoker_bmi": smoker_enc * bmi_s,
        "smoker_age": smoker_enc * age_s,
    }


# ---------------------------------------------------------------- front-end rules

def bmi_raw(height_cm, weight_kg) -> Column:
    """weight / (height/100)², 25 when either input is not positive."""
    h = col(height_cm) / 100
    return F.when((h > 0) & (col(weight_kg) > 0), col(weight_kg) / (h * h)).otherwise(F.lit(C.BMI_DEFAULT))


def bmi_from_height_weight(height_cm, weight_kg) -> Column:
    """BMI from the form inputs, shown with 1 dp."""
    return F.round(bmi_raw(height_cm, weight_kg), 1)


def bmi_class(bmi) -> Column:
    expr = None
    for bound, name in C.BMI_CLASSES:
        expr = F.when(col(bmi) < bound, name) if expr is None else expr.when(col(bmi) < bound, name)
    return expr.otherwise(C.BMI_CLASS_TOP)


def validation_messages(height_cm, weight_kg, bmi, age) -> Column:
    """array<struct<level, rule>>: errors on height/weight; warnings and the
    info note only when there is no error."""
    h, w, b, a = col(height_cm), col(weight_kg), col(bmi), col(age)
    h_bad = h.isNull() | (h < C.HEIGHT_RANGE[0]) | (h > C.HEIGHT_RANGE[1])
    w_bad = w.isNull() | (w < C.WEIGHT_RANGE[0]) | (w > C.WEIGHT_RANGE[1])
    ok = ~(h_bad | w_bad)

    def msg(cond, level, rule):
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))

    return F.array_compact(F.array(
        msg(h_bad, "error", "height_range"),
        msg(w_bad, "error", "weight_range"),
        msg(ok & (b < C.BMI_WARN_RANGE[0]), "warn", "bmi_low"),
        msg(ok & (b >= C.BMI_WARN_RANGE[0]) & (b > C.BMI_WARN_RANGE[1]), "warn", "bmi_high"),
        msg(ok & (a < C.AGE_WARN_RANGE[0]), "warn", "age_low"),
        msg(ok & (a >= C.AGE_WARN_RANGE[0]) & (a > C.AGE_WARN_RANGE[1]), "warn", "age_high"),
        msg(ok & (b >= C.BMI_INFO_FROM), "info", "bmi_smoking_note"),
    ))


def capitalize(c) -> Column:
    """First letter upper-cased, rest unchanged."""
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 1 << 30))


def display_name(c) -> Column:
    """Feature → display name, falling back to the feature name itself."""
    m = F.create_map(*[x for k, v in C.DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col(c)), col(c))


def money(c) -> Column:
    """'$1,234' — rounded half-up to whole units first, then grouped."""
    return F.concat(F.lit("$"), F.format_number(F.round(col(c), 0), 0))


def one_decimal(c) -> Column:
    """Like '{:.1f}': round half-up to one decimal and always print it."""
    return F.format_string("%.1f", F.round(col(c), 1))


def match_tier(similarity) -> Column:
    expr = None
    for bound, name in C.MATCH_TIERS:
        expr = F.when(col(similarity) > bound, name) if expr is None else expr.when(col(similarity) > bound, name)
    return expr.otherwise(C.MATCH_TIER_LOW)


def floor_zero(c) -> Column:
    return F.greatest(col(c), F.lit(0.0))
