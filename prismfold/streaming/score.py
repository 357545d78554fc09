"""Spectra as a stream: row-local steps and fitted models apply to streaming frames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spectra import Spectra


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score(stream: DataFrame, axis, steps, stage: str = "raw_data", model=None) -> DataFrame:
    """Apply row-local steps (functions of Spectra), then a model's prediction."""
    s = Spectra.of(stream, axis, stage)
    for step in steps:
        s = step(s)
    return model.predict(s.df, s.stage) if model is not None else s.df


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", key: str = "group") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
