"""Report columns (R1–R3): fixed-wording sentences and a Markdown report per
profile, built with string functions on columns (no Python per row).

The reference hands these sentences to a hosted language model; that call
is out of scope, so the advice text here is the deterministic summary the
model would have been given.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.functions.columns import money, one_decimal


def _saving_line(label: str, s: str) -> Column:
    return F.when(F.col(f"scenarios.{s}").isNotNull(), F.concat(
        F.lit(f"- {label}: cost drops from "), money(F.col(f"scenarios.{s}.current")),
        F.lit(" to "), money(F.col(f"scenarios.{s}.new")),
        F.lit(", saving "), money(F.col(f"scenarios.{s}.savings")), F.lit("/year.")))


def saving_lines() -> Column:
    """One line per scenario with a positive saving, in fixed order."""
    return F.array_compact(F.array(
        _saving_line("Quitting smoking", "quit_smoking"),
        _saving_line("Reaching BMI 25", "healthy_bmi")))


def driver_lines(top_col: str = "shap_top") -> Column:
    """One line per top driver."""
    return F.transform(F.col(top_col), lambda t: F.concat(
        F.lit("- '"), t["name"], F.lit("' "), t["direction"], F.lit(" their cost significantly.")))


def savings_or_fallback() -> Column:
    """The saving lines, or the fixed no-risk line when there is none."""
    lines = saving_lines()
    return F.when(F.size(lines) == 0, F.array(F.lit(C.NO_RISK_LINE))).otherwise(lines)


def advice_text(top_col: str = "shap_top") -> Column:
    return F.concat(
        F.lit("Top factors:\n"), F.concat_ws("\n", driver_lines(top_col)),
        F.lit("\n\nSavings scenarios:\n"), F.concat_ws("\n", savings_or_fallback()))


def report_text(cost_col: str = "cost", advice_col: str = "advice") -> Column:
    """R2: Markdown report with cost, advice (or the fixed fallback) and profile."""
    return F.concat(
        F.lit(C.REPORT_TITLE + "\n\n**Estimated Annual Cost:** "), money(F.col(cost_col)),
        F.lit("\n\n---\n\n## Advisor Analysis\n\n"), F.coalesce(F.col(advice_col), F.lit(C.NO_REPORT)),
        F.lit("\n\n---\n\n## Profile Summary\n- Age: "), F.col("age").cast("string"),
        F.lit("\n- BMI: "), one_decimal("bmi"),
        F.lit("\n- Smoker: "), F.col("smoker"),
        F.lit("\n- Region: "), F.col("region"), F.lit("\n"))


def with_report(df: DataFrame, top_col: str = "shap_top") -> DataFrame:
    return df.withColumn("advice", advice_text(top_col)).withColumn("report", report_text())
