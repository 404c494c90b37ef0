"""Registered queries: features (F*), scoring and attributions (I*),
evaluation (M10–M15) and report columns (R*).

Scoring queries use the fixed-coefficient stand-in ensemble so that every
number has a DuckDB twin; the same operators accept fitted MLlib models.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.functions import columns as FC
from actuaria.operators import evaluate as M
from actuaria.operators import report as R
from actuaria.operators import score as S
from actuaria.operators.preprocess import assign_split
from actuaria.plans import sqlgen as G
from actuaria.plans.preprocess_all import preprocess, with_interactions
from actuaria.plans.q_profile import UPLOAD_SQL, parsed_upload, policy
from actuaria.plans.registry import (
    PROCESSED_SQL, SPLIT_SQL, feature_sql, linear_sql, register, with_ctes,
)

PRIMARY, SECOND, THIRD = C.ENSEMBLE

# ------------------------------------------------------------------ shared SQL

FF_SQL = f"ff AS (SELECT *,\n  {feature_sql('f_')} FROM policy)"
BG_SQL = "bg AS (SELECT " + ", ".join(f"avg(CAST(f_{f} AS DOUBLE)) AS mu_{f}" for f in C.FEATURES) + " FROM ff)"
DISPLAY_CASE = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DISPLAY_NAMES.items()) + \
    " ELSE feature END"


def _shap_long_sql(src: str, key: str) -> str:
    parts = [f"SELECT {key}, {i} AS idx, '{f}' AS feature, "
             f"{float(PRIMARY.coefficients[f])!r} * (CAST(f_{f} AS DOUBLE) - mu_{f}) AS raw FROM {src}, bg"
             for i, f in enumerate(C.FEATURES)]
    return G.union(parts)


def _bars_sql(src: str, key: str) -> str:
    return (f"bars AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY abs(raw) DESC, idx) "
            f"AS INTEGER) AS pos, {DISPLAY_CASE} AS name, round(raw, 2) AS value, raw FROM ("
            f"{_shap_long_sql(src, key)}))")


def _lin(prefix: str, model=PRIMARY) -> str:
    return linear_sql(model, prefix)


def _floor(x: str) -> str:
    return f"greatest({x}, CAST(0.0 AS DOUBLE))"


SCEN_SQL = f"""
sc AS (
 SELECT policy_id, age, sex, bmi, children, smoker, region,
  {_floor(_lin('f_'))} AS cost, {_floor(_lin('q_'))} AS cost_quit, {_floor(_lin('b_'))} AS cost_bmi
 FROM (SELECT *,
  {feature_sql('f_')},
  {feature_sql('q_', smoker="'no'")},
  {feature_sql('b_', bmi='CAST(25.0 AS DOUBLE)')}
 FROM policy)),
scen AS (
 SELECT policy_id, 'quit_smoking' AS scenario, CAST(round(cost) AS INTEGER) AS current,
   CAST(round(cost_quit) AS INTEGER) AS new, CAST(round(cost - cost_quit) AS INTEGER) AS savings
 FROM sc WHERE smoker = 'yes' AND cost - cost_quit > 0
 UNION ALL
 SELECT policy_id, 'healthy_bmi', CAST(round(cost) AS INTEGER), CAST(round(cost_bmi) AS INTEGER),
   CAST(round(cost - cost_bmi) AS INTEGER)
 FROM sc WHERE bmi > 25.0 AND cost - cost_bmi > 0)
"""


def scored_profiles(spark, sf, with_bars: bool = True):
    """Policy profiles with features, primary cost, scenarios, bars and top drivers."""
    pol = policy(spark, sf)
    feats = S.with_features(pol)
    bg = S.feature_means(feats)
    out = S.score_cost(feats, PRIMARY, "cost")
    out = S.what_if(out, PRIMARY)
    if with_bars:
        out = S.linear_shap(out, PRIMARY, bg)
        out = out.withColumn("shap_bars", S.shap_bars("shap")).withColumn("shap_top", S.top_drivers("shap_bars"))
    return out


# ------------------------------------------------------------------ F

@register("f1_interactions", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT policy_id, round(smoker * bmi, 6) + 0.0 AS smoker_bmi, round(smoker * age, 6) + 0.0 AS smoker_age
FROM processed
"""))
def f1_interactions(spark, sf):
    df = with_interactions(preprocess(policy(spark, sf)).frame)
    return df.select(C.KEY, F.round("smoker_bmi", 6).alias("smoker_bmi"), F.round("smoker_age", 6).alias("smoker_age"))


@register("f2_build_features", with_ctes(FF_SQL, select="SELECT policy_id, " + ", ".join(
    f"round(f_{f}, 6) + 0.0 AS {f}" if f in ("age", "bmi", "children", "smoker_bmi", "smoker_age") else f"f_{f} AS {f}"
    for f in C.FEATURES) + " FROM ff"))
def f2_build_features(spark, sf):
    feats = S.with_features(policy(spark, sf))
    return feats.select(C.KEY, *[F.round(f"f_{f}", 6).alias(f) if f in ("age", "bmi", "children", "smoker_bmi",
                                                                        "smoker_age")
                                 else F.col(f"f_{f}").alias(f) for f in C.FEATURES])


@register("f3_log_target", with_ctes(select="""
SELECT policy_id, round(ln(1 + charges), 6) AS log_charges, round(exp(ln(1 + charges)) - 1, 2) AS charges_back
FROM policy
"""))
def f3_log_target(spark, sf):
    pol = policy(spark, sf)
    return pol.select(C.KEY, F.round(F.log1p("charges"), 6).alias("log_charges"),
                      F.round(F.expm1(F.log1p("charges")), 2).alias("charges_back"))


@register("f4_floor_zero", with_ctes(FF_SQL, select=f"""
SELECT policy_id, round({_lin('f_', THIRD)} - 20000.0, 2) AS raw_score,
  round({_floor(_lin('f_', THIRD) + ' - 20000.0')}, 2) AS floored
FROM ff
"""))
def f4_floor_zero(spark, sf):
    """F4 on a shifted member score (the shift makes the floor bind for part of the table)."""
    df = S.with_features(policy(spark, sf))
    from actuaria.operators.models import linear_expression
    raw = linear_expression(THIRD, "f_") - F.lit(20000.0)
    return df.select(C.KEY, F.round(raw, 2).alias("raw_score"), F.round(FC.floor_zero(raw), 2).alias("floored"))


FORM_SQL = """
form AS (
 SELECT policy_id, age, CAST(95 + (policy_id * 17) % 130 AS DOUBLE) AS height,
   CAST(25 + (policy_id * 29) % 180 AS DOUBLE) AS weight FROM policy),
formb AS (
 SELECT *, CASE WHEN height / 100 > 0 AND weight > 0 THEN weight / ((height / 100) * (height / 100)) ELSE 25.0 END
   AS bmi_raw FROM form)
"""


def form_inputs(spark, sf):
    """Form inputs derived from the policy table (height 95–224 cm, weight
    25–204 kg, so some fall outside the accepted ranges)."""
    pol = policy(spark, sf)
    return pol.select(C.KEY, "age",
                      (F.lit(95) + (F.col(C.KEY) * 17) % 130).cast("double").alias("height"),
                      (F.lit(25) + (F.col(C.KEY) * 29) % 180).cast("double").alias("weight"))


@register("f5_f6_bmi_from_form", with_ctes(FORM_SQL, select="""
SELECT policy_id, height, weight, round(bmi_raw, 1) AS bmi,
  CASE WHEN bmi_raw < 18.5 THEN 'Underweight' WHEN bmi_raw < 25.0 THEN 'Normal'
       WHEN bmi_raw < 30.0 THEN 'Overweight' ELSE 'Obese' END AS bmi_class
FROM formb
"""))
def f5_f6_bmi_from_form(spark, sf):
    f = form_inputs(spark, sf)
    raw = FC.bmi_raw("height", "weight")
    return f.select(C.KEY, "height", "weight", FC.bmi_from_height_weight("height", "weight").alias("bmi"),
                    FC.bmi_class(raw).alias("bmi_class"))


@register("f7_validation_messages", with_ctes(FORM_SQL, select="""
WITH v AS (SELECT *, (height < 100 OR height > 220) AS h_bad, (weight < 30 OR weight > 200) AS w_bad FROM formb),
m AS (
 SELECT policy_id, 1 AS o, 'error' AS level, 'height_range' AS rule FROM v WHERE h_bad
 UNION ALL SELECT policy_id, 2, 'error', 'weight_range' FROM v WHERE w_bad
 UNION ALL SELECT policy_id, 3, 'warn', 'bmi_low' FROM v WHERE NOT (h_bad OR w_bad) AND bmi_raw < 16
 UNION ALL SELECT policy_id, 4, 'warn', 'bmi_high' FROM v WHERE NOT (h_bad OR w_bad) AND bmi_raw >= 16 AND bmi_raw > 53
 UNION ALL SELECT policy_id, 5, 'warn', 'age_low' FROM v WHERE NOT (h_bad OR w_bad) AND age < 18
 UNION ALL SELECT policy_id, 6, 'warn', 'age_high' FROM v WHERE NOT (h_bad OR w_bad) AND age >= 18 AND age > 64
 UNION ALL SELECT policy_id, 7, 'info', 'bmi_smoking_note' FROM v WHERE NOT (h_bad OR w_bad) AND bmi_raw >= 35)
SELECT policy_id, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY o) AS INTEGER) AS pos, level, rule FROM m
"""))
def f7_validation_messages(spark, sf):
    f = form_inputs(spark, sf)
    msgs = FC.validation_messages("height", "weight", FC.bmi_raw("height", "weight"), "age")
    return f.select(C.KEY, F.posexplode(msgs).alias("pos", "m")).select(
        C.KEY, (F.col("pos") + 1).alias("pos"), "m.level", "m.rule")


def _cap_sql(c):
    return f"upper(substr({c}, 1, 1)) || substr({c}, 2)"


@register("f8_display_names", with_ctes(select=f"""
SELECT policy_id, {_cap_sql('sex')} AS sex_display, {_cap_sql('region')} AS region_display,
  CASE WHEN smoker = 'yes' THEN 'Yes' ELSE 'No' END AS smoker_display FROM policy
"""))
def f8_display_names(spark, sf):
    pol = policy(spark, sf)
    return pol.select(C.KEY, FC.capitalize("sex").alias("sex_display"), FC.capitalize("region").alias("region_display"),
                      F.when(F.col("smoker") == "yes", "Yes").otherwise("No").alias("smoker_display"))


@register("f9_formatting", with_ctes(FF_SQL, select=f"""
SELECT policy_id, '$' || format('{{:,.0f}}', round({_floor(_lin('f_'))}, 0)) AS cost_text,
  format('{{:.1f}}', round(bmi, 1)) AS bmi_text, round({_floor(_lin('f_'))}, 2) AS cost
FROM ff
"""))
def f9_formatting(spark, sf):
    df = S.score_cost(S.with_features(policy(spark, sf)), PRIMARY, "cost")
    return df.select(C.KEY, FC.money("cost").alias("cost_text"), FC.one_decimal("bmi").alias("bmi_text"),
                     F.round("cost", 2).alias("cost"))


@register("f10_bar_lengths", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"), select="""
SELECT policy_id, pos, name,
  round(CASE WHEN mx > 0 THEN abs(value) / mx * 48.0 ELSE 0.0 END, 4) AS pct_page,
  round(CASE WHEN mx > 0 THEN abs(value) / mx * 100.0 ELSE 0.0 END, 4) AS pct_print,
  CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS sign_class
FROM (SELECT *, max(abs(value)) OVER (PARTITION BY policy_id) AS mx FROM bars)
"""))
def f10_bar_lengths(spark, sf):
    df = scored_profiles(spark, sf)
    mx = F.array_max(F.transform("shap_bars", lambda b: F.abs(b["value"])))
    bars = df.select(C.KEY, mx.alias("mx"), F.posexplode("shap_bars").alias("p", "b"))

    def pct(scale):
        return F.round(F.when(F.col("mx") > 0, F.abs("b.value") / F.col("mx") * scale).otherwise(0.0), 4)
    return bars.select(C.KEY, (F.col("p") + 1).alias("pos"), F.col("b.name").alias("name"),
                       pct(C.BAR_SCALE_PAGE).alias("pct_page"), pct(C.BAR_SCALE_PRINT).alias("pct_print"),
                       F.when(F.col("b.value") >= 0, "positive").otherwise("negative").alias("sign_class"))


# ------------------------------------------------------------------ I

@register("i1_predict_cost", with_ctes(FF_SQL, select=f"SELECT policy_id, round({_floor(_lin('f_'))}, 2) AS cost FROM ff"))
def i1_predict_cost(spark, sf):
    df = S.score_cost(S.with_features(policy(spark, sf)), PRIMARY, "cost")
    return df.select(C.KEY, F.round("cost", 2).alias("cost"))


@register("i2_confidence_band", with_ctes(FF_SQL, select=f"""
SELECT policy_id, CAST(round(least(m0, m1, m2)) AS INTEGER) AS low,
  CAST(round((((CAST(0.0 AS DOUBLE) + m0) + m1) + m2) / 3) AS INTEGER) AS mid,
  CAST(round(greatest(m0, m1, m2)) AS INTEGER) AS high
FROM (SELECT policy_id, {_floor(_lin('f_', PRIMARY))} AS m0, {_floor(_lin('f_', SECOND))} AS m1,
             {_floor(_lin('f_', THIRD))} AS m2 FROM ff)
"""))
def i2_confidence_band(spark, sf):
    df = S.confidence_band(S.with_features(policy(spark, sf)), C.ENSEMBLE)
    return df.select(C.KEY, "confidence.low", "confidence.high", "confidence.mid")


@register("i3_whatif_quit", with_ctes(SCEN_SQL, select="SELECT * FROM scen WHERE scenario = 'quit_smoking'"))
def i3_whatif_quit(spark, sf):
    return S.scenario_rows(scored_profiles(spark, sf, False), C.KEY).where(F.col("scenario") == "quit_smoking")


@register("i4_whatif_bmi25", with_ctes(SCEN_SQL, select="SELECT * FROM scen WHERE scenario = 'healthy_bmi'"))
def i4_whatif_bmi25(spark, sf):
    return S.scenario_rows(scored_profiles(spark, sf, False), C.KEY).where(F.col("scenario") == "healthy_bmi")


@register("i6_shap_bars_linear", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"),
                                           select="SELECT policy_id, pos, name, value FROM bars"))
def i6_shap_bars_linear(spark, sf):
    df = scored_profiles(spark, sf)
    return df.select(C.KEY, F.posexplode("shap_bars").alias("p", "b")).select(
        C.KEY, (F.col("p") + 1).alias("pos"), F.col("b.name").alias("name"), F.col("b.value").alias("value"))


@register("i6_mean_abs_shap", with_ctes(FF_SQL, BG_SQL, select=f"""
SELECT feature, mean_abs_shap, CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, round(avg(abs(raw)), 6) AS mean_abs_shap FROM ({_shap_long_sql('ff', 'policy_id')})
      GROUP BY feature)
"""))
def i6_mean_abs_shap(spark, sf):
    return S.mean_abs_attribution(scored_profiles(spark, sf))


@register("i7_top_drivers", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"), select="""
SELECT policy_id, pos, name, CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  abs(value) AS impact FROM bars WHERE pos <= 2
"""))
def i7_top_drivers(spark, sf):
    df = scored_profiles(spark, sf)
    return df.select(C.KEY, F.posexplode("shap_top").alias("p", "t")).select(
        C.KEY, (F.col("p") + 1).alias("pos"), "t.name", "t.direction", "t.impact")


@register("i8_top_driver", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"),
                                     select="SELECT policy_id, name, value FROM bars WHERE pos = 1"))
def i8_top_driver(spark, sf):
    df = scored_profiles(spark, sf)
    top = F.element_at("shap_bars", 1)
    return df.select(C.KEY, top["name"].alias("name"), top["value"].alias("value"))


BATCH_SQL = f"""
bf AS (SELECT *,
  {feature_sql('f_')} FROM parsed),
bbars AS (SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(raw) DESC, idx) AS INTEGER) AS pos,
  {DISPLAY_CASE} AS name, round(raw, 2) AS value FROM ({_shap_long_sql('bf', 'row_id')})),
batch AS (
 SELECT b.row_id, b.age, b.sex, b.bmi, b.children, b.smoker, b.region,
  CASE WHEN b.error IS NULL THEN round({_floor(_lin('f_'))}, 2) END AS predicted_cost,
  CASE WHEN b.error IS NULL THEN t.name END AS top_shap_feature,
  CASE WHEN b.error IS NULL THEN t.value END AS top_shap_impact, b.error
 FROM bf b LEFT JOIN (SELECT * FROM bbars WHERE pos = 1) t USING (row_id))
"""


def batch_results(spark, sf):
    pol = policy(spark, sf)
    bg = S.feature_means(S.with_features(pol))
    return S.batch_predict(parsed_upload(spark, sf), PRIMARY, lambda d: S.linear_shap(d, PRIMARY, bg))


@register("i9_batch_predict", with_ctes(FF_SQL, BG_SQL, UPLOAD_SQL, BATCH_SQL, select="SELECT * FROM batch"))
def i9_batch_predict(spark, sf):
    return batch_results(spark, sf)


@register("i10_batch_summary", with_ctes(FF_SQL, BG_SQL, UPLOAD_SQL, BATCH_SQL, select="""
SELECT count(*) AS total, CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS successful,
  CAST(sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS failed,
  coalesce(round(avg(CASE WHEN error IS NULL THEN predicted_cost END), 2), 0.0) AS mean_prediction,
  coalesce(round(min(CASE WHEN error IS NULL THEN predicted_cost END), 2), 0.0) AS min_prediction,
  coalesce(round(max(CASE WHEN error IS NULL THEN predicted_cost END), 2), 0.0) AS max_prediction
FROM batch
"""))
def i10_batch_summary(spark, sf):
    return S.batch_summary(batch_results(spark, sf))


# ------------------------------------------------------------------ M10–M15

TEST_PRED_SQL = f"""
tp AS (
 SELECT f.policy_id, f.charges AS actual, {_floor(_lin('f_', PRIMARY))} AS p_primary,
   {_floor(_lin('f_', SECOND))} AS p_second, {_floor(_lin('f_', THIRD))} AS p_third
 FROM ff f JOIN split s USING (policy_id) WHERE s.split = 'test')
"""


def test_predictions(spark, sf):
    """Test-split profiles with the floored prediction of each member."""
    pol = assign_split(policy(spark, sf)).where(F.col("split") == "test")
    df = S.with_features(pol)
    for m in C.ENSEMBLE:
        df = S.score_cost(df, m, f"p_{m.name}")
    return df.select(C.KEY, F.col("charges").alias("actual"), *[f"p_{m.name}" for m in C.ENSEMBLE])


def _metrics_sql(pred: str) -> str:
    return (f"count(*) AS n, round(avg(abs(actual - {pred})), 4) AS mae, "
            f"round(sqrt(avg((actual - {pred}) * (actual - {pred}))), 4) AS rmse, "
            f"round(1 - sum((actual - {pred}) * (actual - {pred})) / (count(*) * var_pop(actual)), 4) AS r2")


@register("m10_evaluate_primary", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL,
                                            select=f"SELECT 'primary' AS model, {_metrics_sql('p_primary')} FROM tp"))
def m10_evaluate_primary(spark, sf):
    tp = test_predictions(spark, sf)
    return M.regression_metrics(tp, "actual", "p_primary").select(F.lit("primary").alias("model"), "*")


@register("m11_leaderboard", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL, select=f"""
WITH lb AS ({G.union([f"SELECT '{m.name}' AS model, {_metrics_sql('p_' + m.name)} FROM tp" for m in C.ENSEMBLE])})
SELECT model, r2, CAST(round(mae) AS BIGINT) AS mae, CAST(round(rmse) AS BIGINT) AS rmse,
  CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INTEGER) AS rank,
  row_number() OVER (ORDER BY r2 DESC, model) = 1 AS is_best
FROM lb
"""))
def m11_leaderboard(spark, sf):
    tp = test_predictions(spark, sf)
    return M.leaderboard(tp, "actual", {m.name: f"p_{m.name}" for m in C.ENSEMBLE})


@register("m13_residual_hist", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL, select="SELECT * FROM (" + G.histogram(
    "SELECT actual - p_primary AS x FROM tp", C.BINS_RESIDUAL) + ")"))
def m13_residual_hist(spark, sf):
    tp = test_predictions(spark, sf).withColumn("residual", F.col("actual") - F.col("p_primary"))
    from actuaria.operators.profile import histogram
    return histogram(tp, "residual", C.BINS_RESIDUAL)


@register("m13_residual_summary", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL, select="""
SELECT count(*) AS n, round(avg(actual - p_primary), 4) AS mean_residual,
  round(avg(CASE WHEN abs(actual - p_primary) <= 5000.0 THEN 1.0 ELSE 0.0 END), 4) AS share_within_band
FROM tp
"""))
def m13_residual_summary(spark, sf):
    return M.residual_summary(test_predictions(spark, sf), "actual", "p_primary")


@register("m14_decile_errors", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL, select=f"""
WITH b AS (SELECT {", ".join(f"quantile_cont(actual, {k / 10!r}) AS b{k}" for k in range(1, 10))} FROM tp),
d AS (SELECT tp.*, 1 + {" + ".join(f"CAST(actual > b{k} AS INTEGER)" for k in range(1, 10))} AS decile FROM tp, b)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(avg(actual), 4) AS mean_actual,
  round(avg(p_primary), 4) AS mean_predicted, round(avg(actual - p_primary), 4) AS mean_error
FROM d GROUP BY decile
"""))
def m14_decile_errors(spark, sf):
    return M.decile_errors(test_predictions(spark, sf), "actual", "p_primary")


@register("m14_actual_vs_predicted_bins", with_ctes(FF_SQL, SPLIT_SQL, TEST_PRED_SQL, select="""
WITH r AS (SELECT CAST(least(min(actual), min(p_primary)) AS DOUBLE) AS lo,
                  CAST(greatest(max(actual), max(p_primary)) AS DOUBLE) AS hi FROM tp)
SELECT CASE WHEN hi = lo THEN 0 ELSE least(19, CAST(floor((actual - lo) / ((hi - lo) / 20.0)) AS INTEGER)) END
         AS bin_actual,
       CASE WHEN hi = lo THEN 0 ELSE least(19, CAST(floor((p_primary - lo) / ((hi - lo) / 20.0)) AS INTEGER)) END
         AS bin_predicted,
       count(*) AS n, round(avg(actual - p_primary), 4) AS mean_error
FROM tp, r GROUP BY ALL
"""))
def m14_actual_vs_predicted_bins(spark, sf):
    return M.joint_bins(test_predictions(spark, sf), "actual", "p_primary", 20)


@register("m15_target_skew", with_ctes(SPLIT_SQL, select="""
SELECT 'charges' AS target, count(*) AS n, round(skewness(charges), 6) AS skewness
FROM policy JOIN split USING (policy_id) WHERE split = 'train'
UNION ALL
SELECT 'log1p_charges', count(*), round(skewness(ln(1 + charges)), 6)
FROM policy JOIN split USING (policy_id) WHERE split = 'train'
"""))
def m15_target_skew(spark, sf):
    train = assign_split(policy(spark, sf)).where(F.col("split") == "train")
    return M.target_skew(train, "charges")


# ------------------------------------------------------------------ R

def _money_sql(x: str) -> str:
    return f"('$' || format('{{:,.0f}}', round(CAST({x} AS DOUBLE), 0)))"


def _sql_text(s: str) -> str:
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n")) + ")"


LINES_SQL = f"""
drv AS (SELECT policy_id, pos, '- ''' || name || ''' ' ||
  CASE WHEN value > 0 THEN 'increases' ELSE 'decreases' END || ' their cost significantly.' AS line
  FROM bars WHERE pos <= 2),
sav AS (
 SELECT policy_id, CASE scenario WHEN 'quit_smoking' THEN 1 ELSE 2 END AS o,
  CASE scenario WHEN 'quit_smoking' THEN '- Quitting smoking: ' ELSE '- Reaching BMI 25: ' END ||
  'cost drops from ' || {_money_sql('current')} || ' to ' || {_money_sql('new')} || ', saving ' ||
  {_money_sql('savings')} || '/year.' AS line
 FROM scen),
sav2 AS (
 SELECT p.policy_id, coalesce(s.o, 1) AS o, coalesce(s.line, {_sql_text(C.NO_RISK_LINE)}) AS line
 FROM policy p LEFT JOIN sav s USING (policy_id)),
lines AS (
 SELECT policy_id, pos, line FROM drv
 UNION ALL
 SELECT policy_id, CAST(2 + row_number() OVER (PARTITION BY policy_id ORDER BY o) AS INTEGER), line FROM sav2)
"""


def _lines_df(spark, sf):
    df = scored_profiles(spark, sf)
    lines = F.concat(R.driver_lines("shap_top"), R.savings_or_fallback())
    return df, df.select(C.KEY, F.posexplode(lines).alias("p", "line")).select(
        C.KEY, (F.col("p") + 1).alias("pos"), "line")


@register("r1_advice_lines", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"), SCEN_SQL, LINES_SQL,
                                       select="SELECT * FROM lines"))
def r1_advice_lines(spark, sf):
    return _lines_df(spark, sf)[1]


@register("r2_report_text", with_ctes(FF_SQL, BG_SQL, _bars_sql("ff", "policy_id"), SCEN_SQL, LINES_SQL, select=f"""
WITH adv AS (
 SELECT policy_id,
  'Top factors:' || chr(10) || string_agg(CASE WHEN pos <= 2 THEN line END, chr(10) ORDER BY pos) || chr(10) || chr(10)
  || 'Savings scenarios:' || chr(10) || string_agg(CASE WHEN pos > 2 THEN line END, chr(10) ORDER BY pos) AS advice
 FROM lines GROUP BY policy_id)
SELECT sc.policy_id,
 {_sql_text(C.REPORT_TITLE + chr(10) + chr(10) + '**Estimated Annual Cost:** ')} || {_money_sql('sc.cost')} ||
 {_sql_text(chr(10) + chr(10) + '---' + chr(10) + chr(10) + '## Advisor Analysis' + chr(10) + chr(10))} ||
 coalesce(adv.advice, {_sql_text(C.NO_REPORT)}) ||
 {_sql_text(chr(10) + chr(10) + '---' + chr(10) + chr(10) + '## Profile Summary' + chr(10) + '- Age: ')} ||
 CAST(sc.age AS VARCHAR) || {_sql_text(chr(10) + '- BMI: ')} || format('{{:.1f}}', round(sc.bmi, 1)) ||
 {_sql_text(chr(10) + '- Smoker: ')} || sc.smoker || {_sql_text(chr(10) + '- Region: ')} || sc.region || chr(10)
 AS report
FROM sc JOIN adv USING (policy_id)
"""))
def r2_report_text(spark, sf):
    df = R.with_report(scored_profiles(spark, sf))
    return df.select(C.KEY, "report")


@register("r3_no_risk_line", with_ctes(SCEN_SQL, select=f"""
SELECT policy_id, {_sql_text(C.NO_RISK_LINE)} AS line FROM policy WHERE policy_id NOT IN (SELECT policy_id FROM scen)
"""))
def r3_no_risk_line(spark, sf):
    df = scored_profiles(spark, sf, False)
    lines = R.savings_or_fallback()
    return df.where(F.size(R.saving_lines()) == 0).select(C.KEY, F.element_at(lines, 1).alias("line"))

