"""Grouped statistics, contingency tables and the data behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spectra import Spectra, nearest, positions, take, total


def mean_spectrum(s: Spectra, gap: float = 0.3) -> DataFrame:
    """Mean, sample deviation and the display offset of each group and axis point."""
    g = s.long().groupBy("group", "pos", "wavenumber").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    levels = s.df.select("group").distinct().withColumn("rank", F.row_number().over(Window.orderBy("group"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return g.join(F.broadcast(levels), "group").select("group", "pos", "wavenumber", "mean", "sd", (F.col("mean") + F.lit(gap) * (F.col("n") - F.col("rank"))).alias("shown"))


def group_means(s: Spectra, keys: list[str]) -> DataFrame:
    return s.long(tuple(keys)).groupBy(*keys, "pos").agg(F.avg("value").alias("mean"))


def contingency(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts and shares of the true label's rows, empty cells included."""
    counts = df.groupBy(true, predicted).agg(F.count("*").alias("n"))
    cells = counts.select(true).distinct().crossJoin(F.broadcast(counts.select(predicted).distinct()))  # levels, not rows
    full = cells.join(counts, [true, predicted], "left").fillna(0, ["n"])
    return full.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(true)))).withColumn("percent", F.round("share", 2) * 100)


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def class_errors(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(true).agg((1 - F.avg((F.col(true) == F.col(predicted)).cast("double"))).alias("error"), F.count("*").alias("n"))


def select_value(s: Spectra, wave: float) -> Column:
    return F.element_at(s.y, nearest(s.axis, wave) + 1)


def select_band(s: Spectra, low: float, high: float) -> Column:
    return total(take(s.y, positions(s.axis, low, high)))


def band_name(band) -> str:
    if isinstance(band, (int, float)):
        return f"{band:g}"
    if len(band) > 2:
        raise ValueError("a band is one wavenumber or two bounds")
    return "~".join(f"{b:g}" for b in band)


def intensities(s: Spectra, bands) -> Spectra:
    """A column for each band; existing ones are written anew."""
    from dataclasses import replace

    columns = {band_name(b): select_value(s, b) if isinstance(b, (int, float)) else select_value(s, b[0]) if len(b) == 1 else select_band(s, *b) for b in bands}
    return replace(s, df=s.df.withColumns(columns), bands=tuple(dict.fromkeys([*s.bands, *columns])))


def stratified_partition(df: DataFrame, share: float = 0.7, seed: int = 42, label: str = "group") -> DataFrame:
    """Exactly the rounded share of each label's rows is for training."""
    from .markers import fold_key

    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(fold_key(seed), "spectrum_id"))
    return df.select("spectrum_id", label, (rank <= F.bround(F.count("*").over(w) * share)).alias("training"))


# --- data behind plots -----------------------------------------------------------------------


def merge_waves(df: DataFrame, wave: str = "wavenumber", gap: float = 20) -> DataFrame:
    """Neighbouring wavenumbers within the gap as one group, named min~max."""
    order = Window.orderBy(wave)  # axis points, not rows
    start = F.coalesce((F.col(wave) - F.lag(wave).over(order) > gap).cast("int"), F.lit(1))
    g = df.select(wave).distinct().withColumn("start", start).withColumn("band", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("band")
    return g.select(wave, "band", F.concat(F.min(wave).over(whole).cast("int"), F.lit("~"), F.max(wave).over(whole).cast("int")).alias("label"))


def heatmap(s: Spectra, waves: list[float], gap: float = 20) -> DataFrame:
    """Mean value of each marker by group, with the markers' merged bands."""
    at = sorted({nearest(s.axis, w) for w in waves})
    long = s.long().where(F.col("pos").isin(at)).groupBy("group", "pos", "wavenumber").agg(F.avg("value").alias("mean"))
    spark = s.df.sparkSession
    bands = merge_waves(spark.createDataFrame([(float(s.axis[i]),) for i in at], "wavenumber double"), gap=gap)
    return long.join(F.broadcast(bands), "wavenumber")


def markers_on_spectrum(s: Spectra, markers: DataFrame) -> DataFrame:
    """Mean spectrum of each group with a flag at the markers."""
    mean = s.long().groupBy("group", "wavenumber").agg(F.avg("value").alias("mean"))
    flag = markers.select("wavenumber").distinct().withColumn("marker", F.lit(True))
    return mean.join(F.broadcast(flag), "wavenumber", "left").fillna(False, ["marker"])


def violin(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("spectrum_id", "group", *[f"`{c}`" for c in columns]).unpivot(["spectrum_id", "group"], [F.col(f"`{c}`") for c in columns], "variable", "value")


def clamp(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """A numeric colour limited to its central range if it has more than ten values."""
    q = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q"), F.countDistinct(column).alias("k"))
    c = F.col(column)
    return df.crossJoin(F.broadcast(q)).withColumn(column, F.when(F.col("k") > 10, F.greatest(F.least(c, F.col("q")[1]), F.col("q")[0])).otherwise(c)).drop("q", "k")


def palette(n: int) -> list[str]:
    """n evenly spaced hues."""
    import colorsys

    return ["#%02X%02X%02X" % tuple(round(255 * v) for v in colorsys.hls_to_rgb(i / max(1, n), 0.55, 0.6)) for i in range(n)]
