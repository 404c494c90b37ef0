"""Registered queries: sources, profiling (E*) and preprocessing (P*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators import preprocess as P
from actuaria.operators import profile as E
from actuaria.plans import sqlgen as G
from actuaria.plans.preprocess_all import preprocess, with_interactions
from actuaria.plans.registry import PROCESSED_SQL, SPLIT_SQL, register, with_ctes
from actuaria.session import scratch_path
from actuaria.sources import batch as B
from actuaria.sources.tables import policy_table, table

NUM = ["age", "bmi", "children", "charges"]
CAT = ["sex", "smoker", "region"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
POLICY_DTYPES = [("policy_id", "bigint"), ("age", "int"), ("sex", "string"), ("bmi", "double"),
                 ("children", "int"), ("smoker", "string"), ("region", "string"), ("charges", "double")]
POLICY_COLS = [c for c, _ in POLICY_DTYPES]
ENC_COLS = ["age", "sex", "bmi", "children", "smoker",
            "region_northwest", "region_southeast", "region_southwest", "charges"]

ENC_SQL = """
enc AS (
 SELECT policy_id, age, CASE sex WHEN 'male' THEN 1 WHEN 'female' THEN 0 END AS sex, bmi, children,
  CASE smoker WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS smoker,
  CAST(region = 'northwest' AS INTEGER) AS region_northwest,
  CAST(region = 'southeast' AS INTEGER) AS region_southeast,
  CAST(region = 'southwest' AS INTEGER) AS region_southwest, charges
 FROM policy)
"""

UPLOAD_SQL = """
upload AS (
 SELECT policy_id AS row_id,
  CASE WHEN policy_id % 50 = 7 THEN 'abc' ELSE CAST(age AS VARCHAR) END AS age,
  CASE WHEN policy_id % 50 = 21 THEN upper(sex) ELSE sex END AS sex,
  CASE WHEN policy_id % 50 = 13 THEN NULL ELSE CAST(bmi AS VARCHAR) END AS bmi,
  CASE WHEN policy_id % 50 = 41 THEN CAST(children AS VARCHAR) || '.7' ELSE CAST(children AS VARCHAR) END AS children,
  CASE WHEN policy_id % 50 = 45 THEN 'unknown' ELSE smoker END AS smoker,
  CASE WHEN policy_id % 50 = 33 THEN upper(region) ELSE region END AS region
 FROM policy),
upload_d AS (
 SELECT *,
  CASE WHEN isnan(TRY_CAST(trim(age) AS DOUBLE)) OR isinf(TRY_CAST(trim(age) AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(trim(age) AS DOUBLE) END AS d_age,
  CASE WHEN isnan(TRY_CAST(trim(bmi) AS DOUBLE)) OR isinf(TRY_CAST(trim(bmi) AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(trim(bmi) AS DOUBLE) END AS d_bmi,
  CASE WHEN isnan(TRY_CAST(trim(children) AS DOUBLE)) OR isinf(TRY_CAST(trim(children) AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(trim(children) AS DOUBLE) END AS d_children
 FROM upload),
parsed AS (
 SELECT row_id,
  CASE WHEN abs(d_age) < 2147483648.0 THEN CAST(trunc(d_age) AS INTEGER) END AS age,
  lower(sex) AS sex, d_bmi AS bmi,
  CASE WHEN abs(d_children) < 2147483648.0 THEN CAST(trunc(d_children) AS INTEGER) END AS children,
  lower(smoker) AS smoker, lower(region) AS region,
  CASE
   WHEN age IS NULL OR trim(age) = '' THEN 'missing age'
   WHEN d_age IS NULL OR NOT abs(d_age) < 2147483648.0 THEN 'invalid age: ' || age
   WHEN sex IS NULL OR trim(sex) = '' THEN 'missing sex'
   WHEN bmi IS NULL OR trim(bmi) = '' THEN 'missing bmi'
   WHEN d_bmi IS NULL THEN 'invalid bmi: ' || bmi
   WHEN children IS NULL OR trim(children) = '' THEN 'missing children'
   WHEN d_children IS NULL OR NOT abs(d_children) < 2147483648.0 THEN 'invalid children: ' || children
   WHEN smoker IS NULL OR trim(smoker) = '' THEN 'missing smoker'
   WHEN region IS NULL OR trim(region) = '' THEN 'missing region'
  END AS error
 FROM upload_d)
"""


def policy(spark, sf):
    return policy_table(spark, sf)


def parsed_upload(spark, sf):
    return B.parse_profiles(B.policy_as_upload(policy(spark, sf)))


# ------------------------------------------------------------------ sources

@register("s1_policy_scan", with_ctes(select="SELECT * FROM policy"))
def s1_policy_scan(spark, sf):
    return policy(spark, sf)


@register("s1_load_csv", with_ctes(select="SELECT * FROM policy"))
def s1_load_csv(spark, sf):
    """The policy table written as CSV with a header and read back with
    the explicit schema (no inference)."""
    path = scratch_path(spark, "policy-csv")
    policy(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(C.POLICY_SCHEMA).option("header", True).csv(path)


@register("s3_s2_split_roundtrip_test", with_ctes(
    SPLIT_SQL, PROCESSED_SQL,
    select="SELECT policy_id, round(age, 6) AS age, sex, round(bmi, 6) AS bmi, round(children, 6) AS children, "
           "smoker, charges, region_northwest, region_southeast, region_southwest, split FROM processed"))
def s3_s2_split_roundtrip_test(spark, sf):
    """S3 sink partitioned by split, then S2 scans of both partitions."""
    path = scratch_path(spark, "processed")
    B.write_split(preprocess(policy(spark, sf)).frame, path)
    df = B.read_split(spark, path, "test").unionByName(B.read_split(spark, path, "train"))
    return df.select(C.KEY, *[F.round(c, 6).alias(c) if c in ("age", "bmi", "children") else F.col(c)
                              for c in ["age", "sex", "bmi", "children", "smoker", "charges", "region_northwest",
                                        "region_southeast", "region_southwest", "split"]])


@register("s3_s2_split_roundtrip_csv", with_ctes(
    SPLIT_SQL, PROCESSED_SQL,
    select="SELECT policy_id, round(age, 6) AS age, sex, round(bmi, 6) AS bmi, round(children, 6) AS children, "
           "smoker, charges, region_northwest, region_southeast, region_southwest, split FROM processed"))
def s3_s2_split_roundtrip_csv(spark, sf):
    """S3 as CSV (header, partitioned by split), S2 scans of both splits with
    the explicit schema."""
    path = scratch_path(spark, "processed-csv")
    frame = preprocess(policy(spark, sf)).frame
    B.write_split(frame, path, fmt="csv")
    test, train = (B.read_split(spark, path, s, schema=frame.schema, fmt="csv") for s in ("test", "train"))
    df = test.unionByName(train)
    return df.select(C.KEY, *[F.round(c, 6).alias(c) if c in ("age", "bmi", "children") else F.col(c)
                              for c in ["age", "sex", "bmi", "children", "smoker", "charges", "region_northwest",
                                        "region_southeast", "region_southwest", "split"]])


@register("s4_batch_scan_csv", with_ctes(
    UPLOAD_SQL, select="SELECT age, sex, bmi, children, smoker, region, true AS ids_unique FROM upload"))
def s4_batch_scan_csv(spark, sf):
    """Upload written as CSV, scanned as strings with the column check."""
    path = scratch_path(spark, "upload-csv")
    B.policy_as_upload(policy(spark, sf)).write.mode("overwrite").option("header", True).csv(path)
    df = B.read_batch_csv(spark, path, "id")
    ids = df.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).first()
    return df.select(*C.REQUIRED_COLUMNS, F.lit(ids["n"] == ids["d"]).alias("ids_unique"))


@register("s5_parse_upload", with_ctes(UPLOAD_SQL, select="SELECT * FROM parsed"))
def s5_parse_upload(spark, sf):
    return parsed_upload(spark, sf)


@register("s9_feature_matrix", with_ctes(
    SPLIT_SQL, PROCESSED_SQL,
    select="SELECT policy_id, round(age, 6) AS age, sex, round(bmi, 6) AS bmi, round(children, 6) AS children, "
           "smoker, region_northwest, region_southeast, region_southwest, round(smoker * bmi, 6) + 0.0 AS smoker_bmi, "
           "round(smoker * age, 6) + 0.0 AS smoker_age FROM processed"))
def s9_feature_matrix(spark, sf):
    """The ordered ten-feature matrix (key kept)."""
    df = with_interactions(preprocess(policy(spark, sf)).frame)
    return df.select(C.KEY, *[F.round(c, 6).alias(c) if c in ("age", "bmi", "children", "smoker_bmi", "smoker_age")
                              else F.col(c) for c in C.FEATURES])


# ------------------------------------------------------------------ E

@register("e1_shape_policy", with_ctes(select=G.union(
    [f"SELECT {i + 1} AS ordinal, '{c}' AS \"column\", (SELECT count(*) FROM policy) AS n_rows, 8 AS n_columns"
     for i, c in enumerate(POLICY_COLS)])))
def e1_shape_policy(spark, sf):
    return E.shape(policy(spark, sf))


@register("e2_head_policy", with_ctes(select="SELECT * FROM policy ORDER BY policy_id LIMIT 10"))
def e2_head_policy(spark, sf):
    return E.head(policy(spark, sf), 10)


@register("e3_info_policy", with_ctes(select=G.union(
    [f"SELECT {i + 1} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM policy"
     for i, (c, t) in enumerate(POLICY_DTYPES)])))
def e3_info_policy(spark, sf):
    return E.info(policy(spark, sf))


_UP_COLS = ["row_id", "age", "sex", "bmi", "children", "smoker", "region", "error"]


@register("e4_missing_upload", with_ctes(UPLOAD_SQL, select=f"""
SELECT "column", n_missing, round(CASE WHEN n > 0 THEN n_missing * 100.0 / n ELSE 0.0 END, 4) AS pct_missing,
  CAST(sum(n_missing) OVER () AS BIGINT) AS total_missing
FROM ({G.union([f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, count(*) AS n FROM parsed" for c in _UP_COLS])})
"""))
def e4_missing_upload(spark, sf):
    return E.missing_report(parsed_upload(spark, sf))


@register("e5_missing_patterns_upload", with_ctes(UPLOAD_SQL, select=f"""
SELECT {", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_null" for c in _UP_COLS)}, count(*) AS n_rows
FROM parsed GROUP BY ALL
"""))
def e5_missing_patterns_upload(spark, sf):
    return E.missing_patterns(parsed_upload(spark, sf))


@register("e6_describe_policy", with_ctes(select="SELECT * FROM (" + G.describe_numeric("policy", NUM) + ")"))
def e6_describe_policy(spark, sf):
    return E.describe_numeric(policy(spark, sf), NUM)


@register("e6_describe_lineitem", "SELECT * FROM (" + G.describe_numeric("lineitem", LI_NUM) + ")")
def e6_describe_lineitem(spark, sf):
    return E.describe_numeric(table(spark, sf, "lineitem"), LI_NUM)


def _describe_cat_sql(src, cols):
    return f"""
WITH vc AS (SELECT "column", value, count(*) AS c FROM ({G.value_counts_long(src, cols)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY c DESC, value) AS rn FROM vc)
SELECT "column", CAST(sum(c) AS BIGINT) AS "count", count(*) AS "unique", max(CASE WHEN rn = 1 THEN value END) AS top,
  max(CASE WHEN rn = 1 THEN c END) AS freq
FROM r GROUP BY "column"
"""


@register("e7_describe_categorical_policy",
          with_ctes(select="SELECT * FROM (" + _describe_cat_sql("policy", CAT) + ")"))
def e7_describe_categorical_policy(spark, sf):
    return E.describe_categorical(policy(spark, sf), CAT)


@register("e7_describe_categorical_lineitem",
          "SELECT * FROM (" + _describe_cat_sql("lineitem", ["l_returnflag", "l_linestatus"]) + ")")
def e7_describe_categorical_lineitem(spark, sf):
    return E.describe_categorical(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def _vc_sql(src, cols):
    return f'SELECT "column", value, count(*) AS "count" FROM ({G.value_counts_long(src, cols)}) GROUP BY ALL'


@register("e8_value_counts_policy", with_ctes(select=_vc_sql("policy", CAT)))
def e8_value_counts_policy(spark, sf):
    return E.value_counts(policy(spark, sf), CAT)


@register("e8_value_counts_orders", _vc_sql("orders", ["o_orderpriority", "o_orderstatus"]))
def e8_value_counts_orders(spark, sf):
    return E.value_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@register("e9_value_share_policy", with_ctes(select=f"""
SELECT "column", value, "count", round("count" * 100.0 / sum("count") OVER (PARTITION BY "column"), 2) AS pct
FROM ({_vc_sql("policy", CAT)})
"""))
def e9_value_share_policy(spark, sf):
    return E.value_share(policy(spark, sf), CAT)


@register("e10_hist_charges", with_ctes(select="SELECT * FROM (" + G.histogram(
    "SELECT CAST(charges AS DOUBLE) AS x FROM policy", C.BINS_TARGET) + ")"))
def e10_hist_charges(spark, sf):
    return E.histogram(policy(spark, sf), "charges", C.BINS_TARGET)


@register("e10_hist_lineitem_price", "SELECT * FROM (" + G.histogram(
    "SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem", C.BINS_FEATURE) + ")")
def e10_hist_lineitem_price(spark, sf):
    return E.histogram(table(spark, sf, "lineitem"), "l_extendedprice", C.BINS_FEATURE)


@register("e10_hist_policy_columns", with_ctes(select=G.union([
    f"SELECT * FROM (SELECT '{c}' AS \"column\", * FROM (" + G.histogram(f"SELECT CAST({c} AS DOUBLE) AS x FROM policy",
                                                                       C.BINS_FEATURE) + "))" for c in NUM])))
def e10_hist_policy_columns(spark, sf):
    return E.histograms(policy(spark, sf), NUM, C.BINS_FEATURE)


@register("e11_boxplot_policy", with_ctes(select="SELECT * FROM (" + G.boxplot(
    G.long_values("policy", NUM), ["column"]) + ")"))
def e11_boxplot_policy(spark, sf):
    return E.boxplot_stats(policy(spark, sf), NUM)


@register("e11_boxplot_lineitem", "SELECT * FROM (" + G.boxplot(
    G.long_values("lineitem", ["l_extendedprice", "l_quantity"]), ["column"]) + ")")
def e11_boxplot_lineitem(spark, sf):
    return E.boxplot_stats(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


def _grouped_long(src, value, keys):
    return G.union([f"SELECT '{k}' AS grouping, CAST({k} AS VARCHAR) AS group_value, CAST({value} AS DOUBLE) AS value "
                    f"FROM {src} WHERE {value} IS NOT NULL" for k in keys])


@register("e12_grouped_boxplot_policy", with_ctes(select="SELECT * FROM (" + G.boxplot(
    _grouped_long("policy", "charges", ["sex", "smoker", "region", "children"]), ["grouping", "group_value"]) + ")"))
def e12_grouped_boxplot_policy(spark, sf):
    return E.grouped_boxplot(policy(spark, sf), "charges", ["sex", "smoker", "region", "children"])


@register("e12_grouped_boxplot_orders", "SELECT * FROM (" + G.boxplot(
    _grouped_long("orders", "o_totalprice", ["o_orderpriority", "o_orderstatus"]),
    ["grouping", "group_value"]) + ")")
def e12_grouped_boxplot_orders(spark, sf):
    return E.grouped_boxplot(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority", "o_orderstatus"])


def _shape_sql(src, cols):
    return (f'SELECT "column", count(value) AS n, round(skewness(value), 6) AS skewness, '
            f'round(kurtosis(value), 6) AS kurtosis FROM ({G.long_values(src, cols)}) GROUP BY "column"')


@register("e13_skewness_policy", with_ctes(select=_shape_sql("policy", NUM)))
def e13_skewness_policy(spark, sf):
    return E.shape_stats(policy(spark, sf), NUM)


@register("e14_kurtosis_lineitem", _shape_sql("lineitem", LI_NUM))
def e14_kurtosis_lineitem(spark, sf):
    return E.shape_stats(table(spark, sf, "lineitem"), LI_NUM)


@register("e16_value_map_policy", with_ctes(ENC_SQL, select="SELECT policy_id, sex, smoker FROM enc"))
def e16_value_map_policy(spark, sf):
    return E.encode_for_correlation(policy(spark, sf)).select(C.KEY, "sex", "smoker")


def _corr_sql(src, cols, lower_only):
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if (i > j if lower_only else True)]
    return G.union([f"SELECT '{cols[i]}' AS var_a, '{cols[j]}' AS var_b, "
                    f"round(corr(CAST({cols[min(i, j)]} AS DOUBLE), CAST({cols[max(i, j)]} AS DOUBLE)), 6) AS corr "
                    f"FROM {src}" for i, j in pairs])


@register("e17_corr_matrix_policy", with_ctes(ENC_SQL, select=_corr_sql("enc", ENC_COLS, False)))
def e17_corr_matrix_policy(spark, sf):
    return E.correlation_matrix(E.encode_for_correlation(policy(spark, sf)), ENC_COLS)


@register("e17_corr_matrix_lineitem", _corr_sql("lineitem", LI_NUM, False))
def e17_corr_matrix_lineitem(spark, sf):
    return E.correlation_matrix(table(spark, sf, "lineitem"), LI_NUM)


@register("e18_corr_lower_policy", with_ctes(ENC_SQL, select=_corr_sql("enc", ENC_COLS, True)))
def e18_corr_lower_policy(spark, sf):
    return E.correlation_matrix(E.encode_for_correlation(policy(spark, sf)), ENC_COLS, lower_only=True)


EMBEDDING_DIMS = 64


@register("e17_corr_wide_embeddings", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT 'e_' || CAST(a.i AS VARCHAR) AS var_a, 'e_' || CAST(b.i AS VARCHAR) AS var_b, round(corr(a.v, b.v), 6) AS corr
FROM e a JOIN e b USING (vec_id) WHERE a.i < 64 AND b.i < 64 GROUP BY a.i, b.i
""")
def e17_corr_wide_embeddings(spark, sf):
    """E17 on a wide frame: every pair of the 64 embedding components, from matrices of sums."""
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    names = [f"e_{i}" for i in range(EMBEDDING_DIMS)]
    wide = emb.select(*[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return E.correlation_matrix(wide, names)


@register("e19_corr_target_policy", with_ctes(ENC_SQL, select=f"""
SELECT feature, corr, CAST(row_number() OVER (ORDER BY corr DESC, feature) AS INTEGER) AS rank FROM (
{G.union([f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(charges AS DOUBLE)), 6) AS corr FROM enc"
          for c in ENC_COLS[:-1]])})
"""))
def e19_corr_target_policy(spark, sf):
    return E.target_correlations(E.encode_for_correlation(policy(spark, sf)), ENC_COLS[:-1], "charges")


@register("e20_smoker_summary_policy", with_ctes(select="""
SELECT smoker, round(avg(charges), 4) AS mean, round(quantile_cont(charges, 0.5), 4) AS median,
  round(stddev_samp(charges), 4) AS std, count(charges) AS "count",
  (SELECT round(avg(CASE WHEN smoker = 'yes' THEN charges END) / avg(CASE WHEN smoker = 'no' THEN charges END), 4)
   FROM policy) AS mean_ratio
FROM policy GROUP BY smoker
"""))
def e20_smoker_summary_policy(spark, sf):
    pol = policy(spark, sf)
    ratio = E.mean_ratio(pol, "smoker", "charges", "yes", "no").scalar()  # one-row ratio
    return E.group_summary(pol, "smoker", "charges").withColumn("mean_ratio", ratio)


@register("e20_priority_summary_orders", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(stddev_samp(o_totalprice), 4) AS std, count(o_totalprice) AS "count"
FROM orders GROUP BY o_orderpriority
""")
def e20_priority_summary_orders(spark, sf):
    return E.group_summary(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@register("e21_quality_policy", with_ctes(select=G.union(
    [f"SELECT 'required:{c}' AS rule, CAST(0 AS BIGINT) AS violations" for c in C.RAW_COLUMNS]
    + ["SELECT 'row_count:nonzero' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM policy"]
    + [f"SELECT 'not_null:{c}', CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM policy"
       for c in C.RAW_COLUMNS]
    + [f"SELECT 'domain:{c}', CAST(sum(CASE WHEN {c} IS NOT NULL AND NOT ({cond}) THEN 1 ELSE 0 END) AS BIGINT) "
       f"FROM policy" for c, cond in [
           ("sex", "sex IN ('male', 'female')"), ("smoker", "smoker IN ('yes', 'no')"),
           ("region", "region IN ('northeast', 'northwest', 'southeast', 'southwest')"),
           ("age", "age BETWEEN 18 AND 64"), ("children", "children BETWEEN 0 AND 5"),
           ("bmi", "bmi > 0"), ("charges", "charges > 0")]]
    + ["SELECT 'duplicates', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM "
       "(SELECT count(*) AS c FROM policy GROUP BY age, sex, bmi, children, smoker, region, charges)"])))
def e21_quality_policy(spark, sf):
    return E.quality_checks(policy(spark, sf))


def _scatter_sql(x, y, bins=20):
    def b(c):
        w = f"(({c}_hi - {c}_lo) / {float(bins)!r})"
        return (f"CASE WHEN {c}_hi = {c}_lo THEN 0 ELSE least({bins - 1}, "
                f"CAST(floor((CAST({c} AS DOUBLE) - {c}_lo) / {w}) AS INTEGER)) END")
    return f"""
SELECT '{x}' AS x_var, '{y}' AS y_var, smoker AS hue, {b(x)} AS bin_x, {b(y)} AS bin_y, count(*) AS n,
  round(avg(CAST({y} AS DOUBLE)), 4) AS mean_y
FROM policy, (SELECT min(CAST({x} AS DOUBLE)) AS {x}_lo, max(CAST({x} AS DOUBLE)) AS {x}_hi,
                     min(CAST({y} AS DOUBLE)) AS {y}_lo, max(CAST({y} AS DOUBLE)) AS {y}_hi FROM policy)
GROUP BY ALL
"""


@register("e22_scatter_age_charges", with_ctes(select=_scatter_sql("age", "charges")))
def e22_scatter_age_charges(spark, sf):
    return E.scatter_bins(policy(spark, sf), "age", "charges", "smoker", 20)


@register("e22_scatter_bmi_charges", with_ctes(select=_scatter_sql("bmi", "charges")))
def e22_scatter_bmi_charges(spark, sf):
    return E.scatter_bins(policy(spark, sf), "bmi", "charges", "smoker", 20)


def _pair_sql(cols, bins=10):
    def b(c):
        w = f"((hi_{c} - lo_{c}) / {float(bins)!r})"
        return (f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE least({bins - 1}, "
                f"CAST(floor((CAST({c} AS DOUBLE) - lo_{c}) / {w}) AS INTEGER)) END")
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in cols)
    binned = f"SELECT smoker AS hue, {', '.join(f'{b(c)} AS b_{c}' for c in cols)} FROM policy, (SELECT {stats} FROM policy)"
    parts = [f"SELECT '{a}' AS var_x, '{c}' AS var_y, hue, b_{a} AS bin_x, b_{c} AS bin_y FROM bn"
             for i, a in enumerate(cols) for j, c in enumerate(cols) if i <= j]
    return f"SELECT var_x, var_y, hue, bin_x, bin_y, count(*) AS n FROM (WITH bn AS ({binned}) {G.union(parts)}) GROUP BY ALL"


@register("e23_pair_bins_policy", with_ctes(select=_pair_sql(NUM)))
def e23_pair_bins_policy(spark, sf):
    return E.pair_bins(policy(spark, sf), NUM, "smoker", 10)


STATS_CARD_SQL = """
SELECT count(*) AS total_rows, round(avg(age), 1) AS avg_age, round(avg(bmi), 1) AS avg_bmi,
  CAST(round(avg(charges)) AS BIGINT) AS avg_cost, CAST(round(max(charges)) AS BIGINT) AS max_cost,
  CAST(round(min(charges)) AS BIGINT) AS min_cost,
  round(avg(CAST(smoker = 'yes' AS DOUBLE)) * 100, 1) AS smoker_pct,
  round(avg(CAST(sex = 'male' AS DOUBLE)) * 100, 1) AS male_pct,
  CAST(round(avg(CASE WHEN smoker = 'yes' THEN charges END)) AS BIGINT) AS smoker_avg,
  CAST(round(avg(CASE WHEN smoker = 'no' THEN charges END)) AS BIGINT) AS nonsmoker_avg
FROM policy
"""


@register("e24_stats_card", with_ctes(select=STATS_CARD_SQL))
def e24_stats_card(spark, sf):
    return E.stats_card(policy(spark, sf))


@register("e25_cost_bands", with_ctes(select="""
SELECT band, count(*) AS n, round(avg(charges), 4) AS mean_charges, round(min(charges), 4) AS min_charges,
  round(max(charges), 4) AS max_charges, round(regr_slope(charges, age), 4) AS age_slope,
  round(regr_intercept(charges, age), 4) AS age_intercept
FROM (SELECT *, CASE WHEN smoker <> 'yes' THEN 'non_smoker' WHEN bmi < 30 THEN 'smoker_bmi_lt_30'
                     ELSE 'smoker_bmi_ge_30' END AS band FROM policy)
GROUP BY band
"""))
def e25_cost_bands(spark, sf):
    return E.cost_bands(policy(spark, sf))


# ------------------------------------------------------------------ P

def _quartile_sql(src, cols):
    return G.union([f"SELECT '{c}' AS \"column\", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src}" for c in cols])


def _round_cols(df, cols, d=6):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("p1_quartiles_policy", with_ctes(
    select=f"SELECT \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3 FROM ({_quartile_sql('policy', NUM)})"))
def p1_quartiles_policy(spark, sf):
    return _round_cols(P.quartiles(policy(spark, sf), NUM), ["q1", "q3"])


@register("p1_quartiles_lineitem",
          f"SELECT \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3 FROM ({_quartile_sql('lineitem', LI_NUM)})")
def p1_quartiles_lineitem(spark, sf):
    return _round_cols(P.quartiles(table(spark, sf, "lineitem"), LI_NUM), ["q1", "q3"])


def _bounds_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper,
  (SELECT CAST(count(*) AS BIGINT) FROM {src} WHERE CAST({c} AS DOUBLE) < q1 - 1.5 * (q3 - q1)
      OR CAST({c} AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src})""")
    return G.union(parts)


@register("p2_outlier_bounds_policy", with_ctes(select=_bounds_sql("policy", ["age", "bmi", "children"])))
def p2_outlier_bounds_policy(spark, sf):
    return _round_cols(P.outlier_bounds(policy(spark, sf), ["age", "bmi", "children"]),
                       ["q1", "q3", "lower", "upper"])


@register("p2_outlier_bounds_lineitem", _bounds_sql("lineitem", ["l_extendedprice", "l_quantity"]))
def p2_outlier_bounds_lineitem(spark, sf):
    return _round_cols(P.outlier_bounds(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]),
                       ["q1", "q3", "lower", "upper"])


@register("p3_clip_policy", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT p.policy_id, round(c.age, 6) AS age, p.sex, round(c.bmi, 6) AS bmi, round(c.children, 6) AS children,
  p.smoker, p.region, p.charges
FROM policy p JOIN clipped c USING (policy_id)
"""))
def p3_clip_policy(spark, sf):
    return _round_cols(P.clip_outliers(policy(spark, sf), ["age", "bmi", "children"]), ["age", "bmi", "children"])


@register("p3_clip_lineitem", """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), l_extendedprice)), 6) AS l_extendedprice
FROM lineitem, b
""")
def p3_clip_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _round_cols(P.clip_outliers(li, ["l_extendedprice"]), ["l_extendedprice"])


@register("p4_label_encode_policy", with_ctes(select="""
SELECT policy_id, CAST(dense_rank() OVER (ORDER BY sex) - 1 AS INTEGER) AS sex,
  CAST(dense_rank() OVER (ORDER BY smoker) - 1 AS INTEGER) AS smoker FROM policy
"""))
def p4_label_encode_policy(spark, sf):
    return P.label_encode(policy(spark, sf), ["sex", "smoker"]).select(C.KEY, "sex", "smoker")


@register("p4_label_encode_lineitem", """
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag,
  CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS l_linestatus FROM lineitem
""")
def p4_label_encode_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return P.label_encode(li, ["l_returnflag", "l_linestatus"])


@register("p5_label_mapping_policy", with_ctes(select="""
SELECT "column", class, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY class) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT 'sex' AS "column", sex AS class FROM policy UNION SELECT DISTINCT 'smoker', smoker FROM policy)
"""))
def p5_label_mapping_policy(spark, sf):
    return P.label_mapping(policy(spark, sf), ["sex", "smoker"])


@register("p4_label_encode_orders", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS code,
  CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS o_custkey,
  CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus FROM orders
""")
def p4_label_encode_orders(spark, sf):
    """P4 on columns with as many classes as rows, with very many, and with few."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"),
                                          F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus")
    return P.label_encode(o, ["code", "o_custkey", "o_orderstatus"])


@register("p5_label_mapping_orders", """
SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS class,
  CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderkey FROM orders)
""")
def p5_label_mapping_orders(spark, sf):
    """P5 of a column with as many classes as rows."""
    return P.label_mapping(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@register("p6_one_hot_region", with_ctes(select="""
SELECT policy_id, age, sex, bmi, children, smoker, charges,
  CASE WHEN region = 'northwest' THEN 1 ELSE 0 END AS region_northwest,
  CASE WHEN region = 'southeast' THEN 1 ELSE 0 END AS region_southeast,
  CASE WHEN region = 'southwest' THEN 1 ELSE 0 END AS region_southwest FROM policy
"""))
def p6_one_hot_region(spark, sf):
    return P.one_hot(policy(spark, sf), "region", C.REGIONS)


@register("p6_one_hot_orders", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS "prio_2-HIGH",
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS "prio_3-MEDIUM",
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "prio_4-NOT SPECIFIED",
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS "prio_5-LOW" FROM orders
""")
def p6_one_hot_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.one_hot(o, "o_orderpriority", prefix="prio")


@register("p7_scaler_fit_policy", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT 'age' AS "column", round(mu_a, 6) AS mean, round(sd_a, 6) AS std FROM scaler
UNION ALL SELECT 'bmi', round(mu_b, 6), round(sd_b, 6) FROM scaler
UNION ALL SELECT 'children', round(mu_c, 6), round(sd_c, 6) FROM scaler
"""))
def p7_scaler_fit_policy(spark, sf):
    return _round_cols(preprocess(policy(spark, sf)).scaler, ["mean", "std"])


@register("p8_scale_fitted_policy", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT policy_id, round(age, 6) AS age, round(bmi, 6) AS bmi, round(children, 6) AS children FROM processed
"""))
def p8_scale_fitted_policy(spark, sf):
    return _round_cols(preprocess(policy(spark, sf)).frame.select(C.KEY, "age", "bmi", "children"),
                       ["age", "bmi", "children"])


@register("p9_scale_constants_policy", with_ctes(select="""
SELECT policy_id, round((CAST(age AS DOUBLE) - 39.21) / 14.04, 6) AS age,
  round((CAST(bmi AS DOUBLE) - 30.65) / 6.05, 6) AS bmi,
  round((CAST(children AS DOUBLE) - 1.09) / 1.21, 6) AS children FROM policy
"""))
def p9_scale_constants_policy(spark, sf):
    df = P.scale_constants(policy(spark, sf)).select(C.KEY, "age", "bmi", "children")
    return _round_cols(df, ["age", "bmi", "children"])


DECODE_SQL = """
SELECT policy_id,
  CAST(round(age * 14.04 + 39.21) AS INTEGER) AS age, CASE WHEN sex = 1 THEN 'male' ELSE 'female' END AS sex,
  round(bmi * 6.05 + 30.65, 1) AS bmi, CAST(round(children * 1.21 + 1.09) AS INTEGER) AS children,
  CASE WHEN smoker = 1 THEN 'yes' ELSE 'no' END AS smoker,
  CASE WHEN region_northwest = 1 THEN 'northwest' WHEN region_southeast = 1 THEN 'southeast'
       WHEN region_southwest = 1 THEN 'southwest' ELSE 'northeast' END AS region
FROM processed
"""


@register("p10_decode_policy", with_ctes(SPLIT_SQL, PROCESSED_SQL, select=DECODE_SQL))
def p10_decode_policy(spark, sf):
    return P.decode_features(preprocess(policy(spark, sf)).frame.drop("charges", "split"))


@register("p11_split_policy", with_ctes(SPLIT_SQL, select="SELECT policy_id, split FROM split"))
def p11_split_policy(spark, sf):
    return P.assign_split(policy(spark, sf)).select(C.KEY, "split")


@register("p11_split_orders", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey)
  <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders
""")
def p11_split_orders(spark, sf):
    return P.assign_split(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


@register("p12_target_frame", with_ctes(SPLIT_SQL, select="""
SELECT p.policy_id, p.charges, s.split FROM policy p JOIN split s USING (policy_id)
"""))
def p12_target_frame(spark, sf):
    return P.xy_split(P.assign_split(policy(spark, sf)))[1]


@register("p13_preprocess_all", with_ctes(SPLIT_SQL, PROCESSED_SQL, select="""
SELECT policy_id, round(age, 6) AS age, sex, round(bmi, 6) AS bmi, round(children, 6) AS children, smoker, charges,
  region_northwest, region_southeast, region_southwest, split FROM processed
"""))
def p13_preprocess_all(spark, sf):
    return _round_cols(preprocess(policy(spark, sf)).frame, ["age", "bmi", "children"])


def events_as_text(spark, sf):
    """Event values and users as text with bad cells placed by a fixed rule
    on the key (every row kept): id % 97 = 3 → 'n/a', 5 → empty value,
    11 → padded text; id % 89 = 7 → user '1e2'."""
    ev = table(spark, sf, "events")
    k97, k89 = F.col("event_id") % 97, F.col("event_id") % 89
    return ev.select(
        "event_id",
        F.when(k97 == 3, F.lit("n/a")).when(k97 == 5, F.lit(None).cast("string"))
        .when(k97 == 11, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .otherwise(F.col("value").cast("string")).alias("value"),
        F.when(k89 == 7, F.lit("1e2")).otherwise(F.col("user_id").cast("string")).alias("user_id"))


@register("s5_parse_events", """
WITH t AS (
 SELECT event_id,
  CASE WHEN event_id % 97 = 3 THEN 'n/a' WHEN event_id % 97 = 5 THEN NULL
       WHEN event_id % 97 = 11 THEN ' ' || CAST(value AS VARCHAR) || ' ' ELSE CAST(value AS VARCHAR) END AS value,
  CASE WHEN event_id % 89 = 7 THEN '1e2' ELSE CAST(user_id AS VARCHAR) END AS user_id
 FROM events),
d AS (
 SELECT *,
  CASE WHEN isnan(TRY_CAST(trim(value) AS DOUBLE)) OR isinf(TRY_CAST(trim(value) AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(trim(value) AS DOUBLE) END AS d_value,
  CASE WHEN isnan(TRY_CAST(trim(user_id) AS DOUBLE)) OR isinf(TRY_CAST(trim(user_id) AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(trim(user_id) AS DOUBLE) END AS d_user
 FROM t)
SELECT event_id, d_value AS value,
  CASE WHEN abs(d_user) < 2147483648.0 THEN CAST(trunc(d_user) AS INTEGER) END AS user_id,
  CASE WHEN value IS NULL OR trim(value) = '' THEN 'missing value'
       WHEN d_value IS NULL THEN 'invalid value: ' || value
       WHEN user_id IS NULL OR trim(user_id) = '' THEN 'missing user_id'
       WHEN d_user IS NULL OR NOT abs(d_user) < 2147483648.0 THEN 'invalid user_id: ' || user_id END AS error
FROM d
""")
def s5_parse_events(spark, sf):
    return B.parse_columns(events_as_text(spark, sf), {"value": "double", "user_id": "int"}, "event_id")
