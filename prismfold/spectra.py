"""The spectra collection: one row per spectrum, one array column per processing stage, an axis per stage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="prismfold-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again, so that what follows neither repeats nor loses it."""
    path = f"{shared_folder(df.sparkSession)}/spectra-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """The rows with numbers from 0 in this order, without gaps: ranges are numbered each for itself, behind the counts of those before."""
    spread = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = spread.groupBy("__p").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return spread.withColumn("__i", place).join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


@dataclass(frozen=True)
class Spectra:
    """A DataFrame with spectrum_id, group and stage columns. The current stage is the one last written."""

    df: DataFrame
    axes: dict[str, tuple[float, ...]]
    stages: tuple[str, ...]
    bands: tuple[str, ...] = ()
    reductions: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, axis, stage: str = "raw_data") -> Spectra:
        return cls(df, {stage: tuple(float(w) for w in axis)}, (stage,))

    @property
    def stage(self) -> str:
        return self.stages[-1]

    @property
    def axis(self) -> np.ndarray:
        return np.array(self.axes[self.stage])

    @property
    def y(self) -> Column:
        return F.col(self.stage)

    def write(self, stage: str, value: Column | DataFrame, axis=None) -> Spectra:
        df = value if isinstance(value, DataFrame) else self.df.withColumn(stage, value)
        axis = self.axis if axis is None else axis
        return replace(self, df=df, axes=self.axes | {stage: tuple(float(w) for w in axis)}, stages=tuple(s for s in self.stages if s != stage) + (stage,))

    def __getitem__(self, key) -> Spectra | Column:
        """s["name"]: a stage, metadata column, reduction or band; s[rows, (low, high)]: matching rows and axis points."""
        if isinstance(key, str):
            if key not in self.df.columns:
                raise KeyError(key)
            return F.col(f"`{key}`")
        rows, span = key if isinstance(key, tuple) else (key, None)
        df = self.df if rows is None else self.df.where(rows)
        if span is None:
            return replace(self, df=df)
        axes = {}
        for s in self.stages:
            at = positions(self.axes[s], *span)
            df = df.withColumn(s, take(F.col(s), at))
            axes[s] = tuple(np.array(self.axes[s])[at])
        return replace(self, df=df, axes=axes)

    def names(self) -> list[str]:
        return self.df.columns

    def __len__(self) -> int:
        return self.df.count()

    def summary(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n_spectra"), F.countDistinct("group").alias("n_groups")).withColumn("n_features", F.lit(len(self.axis)))

    def bind(self, other: Spectra) -> Spectra:
        """Rows of both; axes must agree, and the common stages stay."""
        both = tuple(s for s in self.stages if s in other.stages and self.axes[s] == other.axes[s])
        if not both:
            raise ValueError("the spectra have no stage with a common axis")
        keep = [c for c in self.df.columns if c in other.df.columns and (c in both or c not in self.axes)]
        return Spectra(self.df.select(keep).unionByName(other.df.select(keep)), {s: self.axes[s] for s in both}, both)

    def long(self, extra: tuple[str, ...] = ("group",)) -> DataFrame:
        """(spectrum_id, extra..., pos, wavenumber, value) of the current stage."""
        axis = F.array(*[F.lit(w) for w in self.axis.tolist()])
        return self.df.select("spectrum_id", *extra, F.posexplode(self.y).alias("pos", "value")).withColumn("wavenumber", F.element_at(axis, F.col("pos") + 1))


def positions(axis, low: float, high: float, closed: bool = True) -> np.ndarray:
    a = np.asarray(axis)
    return np.flatnonzero((a >= low) & (a <= high) if closed else (a > low) & (a < high))


def nearest(axis, wave: float) -> int:
    """Position of the closest axis point, the first on ties."""
    return int(np.argmin(np.abs(np.asarray(axis) - wave)))


def take(y: Column, at) -> Column:
    at = [int(i) for i in at]
    if at and at == list(range(at[0], at[0] + len(at))):
        return F.slice(y, at[0] + 1, len(at))
    return F.array(*[F.element_at(y, i + 1) for i in at])


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, not once for each element of an inner array function."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def mean(y: Column) -> Column:
    return F.try_divide(total(y), F.size(y))


def sd(y: Column) -> Column:
    return let(mean(y), lambda m: F.sqrt(F.try_divide(F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(y) - 1)))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
