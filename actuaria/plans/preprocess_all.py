"""Load → clip → encode → scale → split, as one lazy DataFrame chain.

The scaler is fitted on all rows by default, as the reference does before
splitting (``fit_on="train"`` fits on the training split only).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuaria import config as C
from actuaria.operators.preprocess import (
    apply_scaler, assign_split, clip_outliers, fit_scaler, label_encode, label_mapping, one_hot,
)

CONTINUOUS = ["age", "bmi", "children"]
PROCESSED_COLUMNS = [C.KEY, "age", "sex", "bmi", "children", "smoker", C.TARGET,
                     "region_northwest", "region_southeast", "region_southwest", "split"]


@dataclass
class Preprocessed:
    frame: DataFrame          # processed rows with a split column
    scaler: DataFrame         # (column, mean, std)
    mappings: DataFrame       # (column, class, code)
    source: DataFrame | None = None   # raw rows with their split (checkpointed)

    def scaler_dict(self) -> dict:
        """The fitted scaler as {feature: {mean, std}} (three rows) for serving."""
        return {r["column"]: {"mean": r["mean"], "std": r["std"] or 1.0} for r in self.scaler.collect()}


def preprocess(policy: DataFrame, fit_on: str = "all", clip_cols=CONTINUOUS,
               materialize: bool = True) -> Preprocessed:
    """Each fitted step reads its input twice (fit, then apply); the input
    and the encoded, split frame are checkpointed to the shared folder so
    the source is scanned once per pass instead of once per dependent step,
    and a lost executor recomputes from the checkpoint, not from the scan."""
    if materialize:
        policy = policy.checkpoint(eager=True)
    # the split depends on keys only, so it is assigned first and written once;
    # clip, encode and scale are then narrow steps over that table
    split = assign_split(policy)
    if materialize:
        split = split.checkpoint(eager=True)
    clipped = clip_outliers(split, list(clip_cols))
    mappings = label_mapping(split, ["sex", "smoker"])
    encoded = label_encode(clipped, ["sex", "smoker"])
    encoded = one_hot(encoded, "region", C.REGIONS)
    fit_rows = encoded if fit_on == "all" else encoded.where(F.col("split") == "train")
    stats = fit_scaler(fit_rows, CONTINUOUS)
    scaled = apply_scaler(encoded, stats, CONTINUOUS)
    return Preprocessed(scaled.select(*PROCESSED_COLUMNS), stats, mappings, split)


def with_interactions(processed: DataFrame) -> DataFrame:
    """smoker × scaled BMI and smoker × scaled age."""
    return processed.withColumn("smoker_bmi", F.col("smoker") * F.col("bmi")) \
                    .withColumn("smoker_age", F.col("smoker") * F.col("age"))
