"""T-stream: profiles landing as files are scored by the same DataFrame
functions as the batch path (parse → features → score → top attribution)
and appended to a file sink.  Stateless: no watermark, no windows; the
checkpoint folder makes the query restartable after a failure."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from actuaria import config as C
from actuaria.operators import score as S
from actuaria.sources.batch import parse_profiles

UPLOAD_SCHEMA = T.StructType([T.StructField("row_id", T.LongType())] +
                             [T.StructField(c, T.StringType()) for c in C.REQUIRED_COLUMNS])


def profile_stream(spark: SparkSession, source_dir: str, fmt: str = "json",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(UPLOAD_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def scored_stream(stream: DataFrame, model, explain, scaler: dict | None = None) -> DataFrame:
    """The batch scoring function applied to a streaming frame.  ``explain``
    adds the attribution array: ``linear_shap`` with a fixed background (a
    static model input) or ``tree_shap`` for a fitted boosted model."""
    return S.batch_predict(parse_profiles(stream), model, explain, scaler=scaler)


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, model,
                  explain, fmt: str = "json", available_now: bool = True,
                  scaler: dict | None = None) -> StreamingQuery:
    out = scored_stream(profile_stream(spark, source_dir, fmt), model, explain, scaler)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)
