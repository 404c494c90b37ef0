"""Batch upload scan (S4), per-row parsing with error capture (S5) and sinks
(S3, S6, S7).

Uploads are read with every column as STRING; parsing is row-local and
JVM-side (``try_cast``), so one bad cell turns its own row into an error row
and the rest of the batch still scores.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria import config as C


class MissingColumnsError(ValueError):
    pass


class UnreadableUploadError(ValueError):
    pass


def check_required(df: DataFrame, required=C.REQUIRED_COLUMNS) -> DataFrame:
    """Schema-only check (no job); lists missing columns in required order."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing columns: {missing}")
    return df


def read_batch_csv(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """Read an uploaded CSV (header, all STRING), check columns, add a row id.

    Raises ``FileNotFoundError`` for a missing path, ``UnreadableUploadError`` for
    one that is no CSV, and ``MissingColumnsError`` for absent columns.  Extra
    columns are ignored.
    """
    try:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(exc)) from exc
        raise UnreadableUploadError(str(exc)) from exc
    if not df.columns:
        raise UnreadableUploadError(f"no header: {path}")
    check_required(df)
    return df.select(F.monotonically_increasing_id().alias(row_id),
                     *[F.col(c).cast("string") for c in C.REQUIRED_COLUMNS])


def _finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def parse_double(raw: Column) -> Column:
    """try_cast to DOUBLE; NaN / ±inf count as not a number."""
    return _finite(F.trim(raw).try_cast("double"))


def parse_int(raw: Column) -> Column:
    """Numeric text → INT, truncating toward zero (30.9 → 30); out of range → null."""
    d = parse_double(raw)
    return F.when(d.isNotNull() & (F.abs(d) < F.lit(2147483648.0)), d.cast("int"))


#: Cells that may be blank under the lenient rule: a blank number scores as NaN, a blank word as ``nan``.
MAY_BE_BLANK = ("bmi", "sex", "smoker", "region")


def parse_profiles(df: DataFrame, row_id: str = "row_id", blanks: str = "error") -> DataFrame:
    """Typed, lower-cased profile columns plus a nullable ``error``.

    ``blanks="score"`` accepts blank bmi, sex, smoker and region cells, whose rows then
    score (NaN cost for a blank bmi, the baseline category for a blank word); the
    stricter default makes them error rows.

    The first failing field (in required-column order) names the error:
    ``missing <col>`` for an absent cell, ``invalid <col>: <text>`` for an
    unparsable one.  Strings are lower-cased; unknown words are not errors
    (they score as the baseline category, as at serving time).
    """
    raw = {c: F.col(c).cast("string") for c in C.REQUIRED_COLUMNS}
    parsed = {
        "age": parse_int(raw["age"]),
        "sex": F.lower(raw["sex"]),
        "bmi": parse_double(raw["bmi"]),
        "children": parse_int(raw["children"]),
        "smoker": F.lower(raw["smoker"]),
        "region": F.lower(raw["region"]),
    }
    error = None
    for c in C.REQUIRED_COLUMNS:
        missing = raw[c].isNull() | (F.trim(raw[c]) == "")
        if blanks == "score" and c in MAY_BE_BLANK:
            blank = F.lit(float("nan")) if c == "bmi" else F.lit("nan")
            parsed[c] = F.when(missing, blank).otherwise(parsed[c])
            missing = F.lit(False)
        cond_missing, msg_missing = missing, F.lit(f"missing {c}")
        cond_bad = parsed[c].isNull()
        msg_bad = F.concat(F.lit(f"invalid {c}: "), raw[c])
        if error is None:
            error = F.when(cond_missing, msg_missing).when(cond_bad, msg_bad)
        else:
            error = error.when(cond_missing, msg_missing).when(cond_bad, msg_bad)
    return df.select(F.col(row_id), *[parsed[c].alias(c) for c in C.REQUIRED_COLUMNS],
                     error.alias("error"))


def policy_as_upload(policy: DataFrame) -> DataFrame:
    """A string-typed upload built from the policy table, with bad cells
    placed by a fixed rule on the key (every row is kept):
    key % 50 = 7 → age 'abc'; 13 → bmi empty; 21 → sex upper-case;
    33 → region upper-case; 41 → children '<n>.7'; 45 → smoker 'unknown'."""
    k = F.col(C.KEY) % 50
    return policy.select(
        F.col(C.KEY).alias("row_id"),
        F.when(k == 7, F.lit("abc")).otherwise(F.col("age").cast("string")).alias("age"),
        F.when(k == 21, F.upper("sex")).otherwise(F.col("sex")).alias("sex"),
        F.when(k == 13, F.lit(None).cast("string")).otherwise(F.col("bmi").cast("string")).alias("bmi"),
        F.when(k == 41, F.concat(F.col("children").cast("string"), F.lit(".7")))
        .otherwise(F.col("children").cast("string")).alias("children"),
        F.when(k == 45, F.lit("unknown")).otherwise(F.col("smoker")).alias("smoker"),
        F.when(k == 33, F.upper("region")).otherwise(F.col("region")).alias("region"),
    )


# ---------------------------------------------------------------- sinks

def write_split(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> str:
    """S3: one table partitioned by split (train/test); readers prune by partition."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str, schema=None, fmt: str = "parquet",
               split_col: str = "split") -> DataFrame:
    """Scan one split; the filter prunes partitions before any file is opened."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.option("header", True).csv(path) if fmt == "csv" else r.parquet(path)
    return df.where(F.col(split_col) == split)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Batch results as CSV (header) or JSON lines; one schema with a
    nullable ``error`` column covers good and bad rows."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)
    return path


def to_json_records(df: DataFrame, key: str, out_col: str = "record") -> DataFrame:
    """Nested result rows as JSON text (key kept for joins)."""
    others = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*others)).alias(out_col))


def parse_columns(df: DataFrame, types: dict, key: str) -> DataFrame:
    """S5, generic: parse text columns to ``int`` / ``double`` row by row;
    ``error`` names the first missing or unparsable cell (in ``types`` order)."""
    parsers = {"int": parse_int, "double": parse_double}
    error = None
    out = []
    for c, t in types.items():
        raw = F.col(c).cast("string")
        val = parsers[t](raw)
        out.append(val.alias(c))
        missing, bad = raw.isNull() | (F.trim(raw) == ""), val.isNull()
        m_txt, b_txt = F.lit(f"missing {c}"), F.concat(F.lit(f"invalid {c}: "), raw)
        error = (F.when(missing, m_txt).when(bad, b_txt) if error is None
                 else error.when(missing, m_txt).when(bad, b_txt))
    return df.select(key, *out, error.alias("error"))
