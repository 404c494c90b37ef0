"""Small generators for the DuckDB oracle texts (per-column unions and the
shared statistics shapes).  They only build SQL strings; Spark never runs them."""
from __future__ import annotations

from collections.abc import Sequence


def q(c: str) -> str:
    return '"' + c + '"'


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_values(src: str, cols: Sequence[str], extra: str = "") -> str:
    """(column, value DOUBLE) rows for each column, nulls dropped."""
    return union([f"SELECT '{c}' AS \"column\"{extra}, CAST({c} AS DOUBLE) AS value FROM {src} "
                  f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in cols])


def describe_numeric(src: str, cols: Sequence[str], d: int = 6) -> str:
    return f"""
SELECT "column", count(value) AS "count", round(avg(value), {d}) AS mean,
  round(stddev_samp(value), {d}) AS std, round(min(value), {d}) AS "min",
  round(quantile_cont(value, 0.25), {d}) AS p25, round(quantile_cont(value, 0.5), {d}) AS p50,
  round(quantile_cont(value, 0.75), {d}) AS p75, round(max(value), {d}) AS "max"
FROM ({long_values(src, cols)}) GROUP BY "column"
"""


def boxplot(long_sql: str, by: Sequence[str], d: int = 6) -> str:
    keys = ", ".join(q(b) for b in by)
    on = " AND ".join(f"l.{q(b)} = f.{q(b)}" for b in by)
    return f"""
WITH l AS ({long_sql}),
s AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY {keys}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM s)
SELECT {", ".join("f." + q(b) for b in by)}, count(*) AS n, round(any_value(f.q1), {d}) AS q1,
  round(any_value(f.median), {d}) AS median, round(any_value(f.q3), {d}) AS q3,
  round(any_value(f.iqr), {d}) AS iqr,
  round(min(CASE WHEN l.value >= f.fence_lo THEN l.value END), {d}) AS whisker_lo,
  round(max(CASE WHEN l.value <= f.fence_hi THEN l.value END), {d}) AS whisker_hi,
  CAST(sum(CASE WHEN l.value < f.fence_lo OR l.value > f.fence_hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM l JOIN f ON {on}
GROUP BY {", ".join("f." + q(b) for b in by)}
"""


def histogram(src_values: str, bins: int, d: int = 4) -> str:
    """src_values: a SELECT producing one DOUBLE column x."""
    w = f"((hi - lo) / {float(bins)!r})"
    return f"""
WITH hv AS (SELECT x FROM ({src_values}) WHERE x IS NOT NULL AND NOT isnan(x)),
hs AS (SELECT min(x) AS lo, max(x) AS hi FROM hv),
hb AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least({bins - 1}, CAST(floor((x - lo) / {w}) AS INTEGER)) END AS bin
       FROM hv, hs),
hc AS (SELECT bin, count(*) AS c FROM hb GROUP BY bin)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * {w} AS bin_lo,
  lo + (b.bin + 1) * {w} AS bin_hi, CAST(coalesce(hc.c, 0) AS BIGINT) AS "count"
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) b CROSS JOIN hs
LEFT JOIN hc ON hc.bin = b.bin
"""


def value_counts_long(src: str, cols: Sequence[str]) -> str:
    return union([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {src} WHERE {c} IS NOT NULL"
                  for c in cols])
