"""Labelled files to a trained, stored flow classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml.tabular import Training, TrainingSize, train_table
from ..sources.archives import read_labelled_csv


def train_from_files(spark: SparkSession, paths: str | Sequence[str], target: str | None = None,
                     model_type: str | None = "auto", max_rows_per_class: int = 100_000,
                     save_to: str | None = None, size: TrainingSize = TrainingSize()) -> Training:
    """Read, sample, profile, train and (optionally) store the best model."""
    rows = read_labelled_csv(spark, paths).drop("source")
    # A row's identity is its content, so a re-read or a lost task draws the same sample.
    keyed = rows.withColumn("row_id", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    result = train_table(keyed, "row_id", target, model_type, max_rows_per_class, size)
    if save_to and result.model is not None:
        result.model.write().overwrite().save(save_to)
    return result


def classify(model: PipelineModel | str, table: DataFrame) -> DataFrame:
    """Predicted label per row of a typed table."""
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    return fitted.transform(table).drop("features", "rawPrediction", "probability", "prediction")
