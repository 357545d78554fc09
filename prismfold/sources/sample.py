"""A made-up collection for trials: a fermentation followed over time points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..spectra import Spectra, literal

#: Centre, width and height of the bands, and how much a time point adds to the height.
BANDS = [(750.0, 12.0, 0.5, 0.10), (1003.0, 8.0, 0.8, 0.0), (1130.0, 15.0, 0.4, 0.08), (1450.0, 20.0, 1.0, -0.05), (1585.0, 14.0, 0.6, 0.12), (1660.0, 22.0, 0.9, 0.0), (2935.0, 45.0, 3.0, -0.10)]


def sample(spark: SparkSession, spectra: int = 500, times: int = 5, points: int = 800, noise: float = 0.02, seed: int = 42) -> Spectra:
    """Equal numbers of spectra at each time point, every value a function of id, axis point and seed alone."""
    axis = np.linspace(400, 3300, points)
    shape = lambda k: sum(b[k] * np.exp(-((axis - b[0]) ** 2) / (2 * b[1] ** 2)) for b in BANDS)
    base, trend = literal(shape(2) + 1 + axis * 1e-4), literal(shape(3))
    time = F.col("spectrum_id") % times
    uniform = lambda i: F.pmod(F.xxhash64("spectrum_id", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5
    value = F.transform(F.zip_with(base, trend, lambda b, t: b + t * time), lambda v, i: v + uniform(i) * (noise * 12**0.5))
    df = spark.range(spectra).withColumnRenamed("id", "spectrum_id").withColumn("group", F.concat(F.lit("T"), time.cast("string"))).withColumn("filename", F.concat(F.col("group"), F.lit("_c"), F.col("spectrum_id").cast("string")))
    return Spectra.of(df.withColumn("raw_data", value), axis)
