"""Query registry: every named query has a Spark builder ``(spark, sf_dir) →
DataFrame`` and, when the result is SQL-expressible, the equivalent DuckDB
SQL over the same parquet tables (views named after the tables).
"""
from __future__ import annotations

from collections.abc import Callable

from actuaria.sources.tables import POLICY_SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_ctes(*ctes: str, select: str) -> str:
    """``WITH <policy ctes>, <ctes> <select>``."""
    parts = [POLICY_SQL.strip()] + [c.strip() for c in ctes]
    select = select.strip()
    if select.upper().startswith("WITH"):
        select = f"SELECT * FROM (\n{select}\n)"
    return "WITH " + ",\n".join(parts) + "\n" + select


# ---------------------------------------------------------------- shared SQL fragments

# Deterministic split: the ceil(0.2·n) first rows by (md5(key:42), key).
SPLIT_SQL = """
split AS (
 SELECT policy_id,
  CASE WHEN row_number() OVER (ORDER BY md5(CAST(policy_id AS VARCHAR) || ':42'), policy_id)
            <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
 FROM policy)
"""

# Clip (IQR) → encode → scale (fit on all rows) → split.
PROCESSED_SQL = """
clip_b AS (
 SELECT quantile_cont(age, 0.25) AS a1, quantile_cont(age, 0.75) AS a3,
        quantile_cont(bmi, 0.25) AS b1, quantile_cont(bmi, 0.75) AS b3,
        quantile_cont(children, 0.25) AS c1, quantile_cont(children, 0.75) AS c3
 FROM policy),
clipped AS (
 SELECT p.policy_id,
  greatest(a1 - 1.5 * (a3 - a1), least(a3 + 1.5 * (a3 - a1), CAST(p.age AS DOUBLE))) AS age,
  CASE WHEN p.sex = 'male' THEN 1 ELSE 0 END AS sex,
  greatest(b1 - 1.5 * (b3 - b1), least(b3 + 1.5 * (b3 - b1), CAST(p.bmi AS DOUBLE))) AS bmi,
  greatest(c1 - 1.5 * (c3 - c1), least(c3 + 1.5 * (c3 - c1), CAST(p.children AS DOUBLE))) AS children,
  CASE WHEN p.smoker = 'yes' THEN 1 ELSE 0 END AS smoker,
  p.charges,
  CASE WHEN p.region = 'northwest' THEN 1 ELSE 0 END AS region_northwest,
  CASE WHEN p.region = 'southeast' THEN 1 ELSE 0 END AS region_southeast,
  CASE WHEN p.region = 'southwest' THEN 1 ELSE 0 END AS region_southwest
 FROM policy p, clip_b),
scaler AS (
 SELECT avg(age) AS mu_a, stddev_pop(age) AS sd_a, avg(bmi) AS mu_b, stddev_pop(bmi) AS sd_b,
        avg(children) AS mu_c, stddev_pop(children) AS sd_c FROM clipped),
processed AS (
 SELECT c.policy_id,
  (c.age - mu_a) / CASE WHEN sd_a = 0 THEN 1.0 ELSE sd_a END AS age,
  c.sex,
  (c.bmi - mu_b) / CASE WHEN sd_b = 0 THEN 1.0 ELSE sd_b END AS bmi,
  (c.children - mu_c) / CASE WHEN sd_c = 0 THEN 1.0 ELSE sd_c END AS children,
  c.smoker, c.charges, c.region_northwest, c.region_southeast, c.region_southwest, s.split
 FROM clipped c JOIN split s USING (policy_id), scaler)
"""


def linear_sql(model, prefix: str = "f_") -> str:
    """SQL text of a FixedLinear score over prefixed feature columns, with
    the same left-to-right evaluation order as the Spark expression."""
    from actuaria import config as C
    expr = f"CAST({float(model.intercept)!r} AS DOUBLE)"
    for f in C.FEATURES:
        expr = f"({expr} + CAST({prefix}{f} AS DOUBLE) * {float(model.coefficients.get(f, 0.0))!r})"
    return f"(exp({expr}) - 1)" if model.log_target else expr


def feature_sql(prefix: str = "f_", age: str = "age", sex: str = "sex", bmi: str = "bmi",
                children: str = "children", smoker: str = "smoker", region: str = "region") -> str:
    """The ten F2 feature expressions (comma separated) over raw SQL expressions."""
    a = f"((CAST({age} AS DOUBLE) - 39.21) / 14.04)"
    b = f"((CAST({bmi} AS DOUBLE) - 30.65) / 6.05)"
    s = f"(CASE WHEN lower({smoker}) = 'yes' THEN 1 ELSE 0 END)"
    cols = {
        "age": a,
        "sex": f"CASE WHEN lower({sex}) = 'male' THEN 1 ELSE 0 END",
        "bmi": b,
        "children": f"((CAST({children} AS DOUBLE) - 1.09) / 1.21)",
        "smoker": s,
        "region_northwest": f"CASE WHEN lower({region}) = 'northwest' THEN 1 ELSE 0 END",
        "region_southeast": f"CASE WHEN lower({region}) = 'southeast' THEN 1 ELSE 0 END",
        "region_southwest": f"CASE WHEN lower({region}) = 'southwest' THEN 1 ELSE 0 END",
        "smoker_bmi": f"{s} * {b}",
        "smoker_age": f"{s} * {a}",
    }
    return ",\n  ".join(f"{v} AS {prefix}{k}" for k, v in cols.items())
