"""Spectral text files: discovery, layouts, trimming, resampling, and writing."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spectra import Spectra, numbered, stored

SCHEMA = "filename string, spectrum string, orient string, axis array<double>, y array<double>, skipped long"


def is_wavenumber(values) -> bool:
    """Monotone, mostly numeric, at least five points, inside (50, 6000)."""
    v = np.asarray(values, float)
    v, n = v[np.isfinite(v)], len(v)
    if len(v) < 5 or len(v) < 0.9 * n or v.min() <= 50 or v.max() >= 6000:
        return False
    step = np.sign(np.diff(v))
    return max((step > 0).mean(), (step < 0).mean()) > 0.95


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with zero second derivatives at the ends, straight beyond them. Its second derivatives solve a tridiagonal system."""
    n = len(x)
    if n < 2:
        return np.full(len(at), y[0] if n else np.nan)
    h = np.diff(x)
    slope = np.diff(y) / h
    m = np.zeros(n)
    # Elimination from the left, then substitution from the right.
    upper, value = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * upper[i - 1]
        upper[i] = h[i] / pivot
        value[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * value[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = value[i] - upper[i] * m[i + 1]
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    p, q = x[i + 1] - at, at - x[i]
    inside = (m[i] * p**3 + m[i + 1] * q**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * p + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * q
    left = y[0] + (at - x[0]) * (slope[0] - h[0] * m[1] / 6)
    right = y[-1] + (at - x[-1]) * (slope[-1] + h[-1] * m[-2] / 6)
    return np.where(at < x[0], left, np.where(at > x[-1], right, inside))


def fields(line: str, sep: str | None = None) -> list[str]:
    """The fields of a line; without a given separator, between tabs, else commas or semicolons, else white space. Empty fields stay between marks."""
    for mark in (sep,) if sep else ("\t", ",", ";"):
        if mark in line:
            return [f.strip() for f in line.rstrip("\r\n").split(mark)]
    return line.split()


def lines_of(text: str | memoryview, size: int = 1 << 20) -> Iterator[str]:
    """The lines of a text or of UTF-8 bytes, some of them at a time."""
    a, n, more = 0, len(text), size
    while a < n:
        piece = text[a : a + more] if isinstance(text, str) else bytes(text[a : a + more])
        if a + more < n:
            cut = piece.rfind("\n" if isinstance(text, str) else b"\n") + 1
            if not cut:  # a longer line
                more *= 2
                continue
            piece = piece[:cut]
        a, more = a + len(piece), size
        yield from (piece if isinstance(piece, str) else piece.decode("utf-8", "replace")).splitlines()


def parse(text: str | memoryview, sep: str | None = None) -> tuple[str, list[tuple[str, np.ndarray, np.ndarray]], int]:
    """Orientation, (name, axis, values) of the spectra in a file of any layout, and the number of lines after the first that are not numbers."""
    flat, sizes, skipped = array("d"), array("q"), 0  # numbers of eight bytes, no objects for each
    for k, line in enumerate(lines_of(text)):
        if not line.strip():
            continue
        try:
            row = [float(f) if f not in ("", "NA") else np.nan for f in fields(line, sep)]
        except ValueError:
            skipped += k > 0
            continue
        flat.extend(row)
        sizes.append(len(row))
    size, width = np.array(sizes), max(sizes, default=0)
    if len(size) and size.min() == width:
        m = np.frombuffer(flat).reshape(len(size), width)
    else:
        m = np.full((len(size), width), np.nan)
        m[np.arange(width) < size[:, None]] = np.array(flat)
    if not m.size:
        return "empty", [], skipped
    orient = "column"
    if m.shape[1] > 5 and is_wavenumber(m[0]) and not is_wavenumber(m[:, 0]):
        m, orient = m.T, "row"
    if is_wavenumber(m[:, 0]):
        if m.shape[1] == 2:
            return orient, [("", m[:, 0], m[:, 1])], skipped
        return orient, [(str(k), m[:, 0], m[:, k]) for k in range(1, m.shape[1]) if np.isfinite(m[:, k]).any()], skipped
    if m.shape[1] < 3:
        return "unknown", [], skipped
    keys, wave, value = m[:, :-2], m[:, -2], m[:, -1]
    axis = np.unique(wave[np.isfinite(wave)])
    out: dict[str, np.ndarray] = {}
    at = np.searchsorted(axis, wave)
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):  # lines of one spectrum, as a rule
        name = "_".join(f"{x:g}" for x in keys[a])
        if name not in out:
            out[name] = np.full(len(axis), np.nan)
        out[name][at[a:b]] = value[a:b]
    return "coordinates", [(k, axis, v) for k, v in out.items()], skipped


def read_spectra(spark: SparkSession, path: str, file_type: str = "txt", sep: str | None = None, cutoff: tuple[float, float] = (500, 3150), interpolation: bool = False) -> DataFrame:
    """All spectra below a folder, a row each; files named like metadata are left out. Files are parsed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{file_type}").load(path)
    files = files.where(~F.col("path").rlike("(?i)metadata[^/]*$")).select("path", "content")

    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["filename", "spectrum", "orient", "axis", "y", "skipped"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, points = [], 0
            for at in range(b.num_rows):  # one file at a time
                name = b.column(0)[at].as_py()
                orient, found, skipped = parse(memoryview(b.column(1)[at].as_buffer()) if b.column(1)[at].is_valid else "", sep)
                if not found:  # the file is named, with what is known of it
                    rows.append((name, None, orient, None, None, skipped))
                for key, x, y in found:
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], y[order]
                    keep = (x >= cutoff[0]) & (x <= cutoff[1])
                    if interpolation:
                        ok = np.isfinite(y)
                        at_ = np.arange(np.ceil(cutoff[0]), np.floor(cutoff[1]) + 1)
                        x, y = at_, natural_spline(x[ok], y[ok], at_)
                    else:
                        x, y = x[keep], y[keep]
                    rows.append((name, key, orient, x.tolist(), [None if np.isnan(v) else v for v in y.tolist()], skipped))
                    points += len(x)
                    if points > 200_000:
                        yield batch(rows)
                        rows, points = [], 0
            yield batch(rows)

    return files.mapInArrow(run, SCHEMA)


def orientations(read: DataFrame) -> DataFrame:
    return read.select("filename", "orient").distinct().groupBy("orient").agg(F.count("*").alias("n"))


def batches(df: DataFrame, axis: str = "axis") -> DataFrame:
    """A batch name by rounded axis: the most common axis is Batch_1."""
    key = F.md5(F.concat_ws(",", F.transform(axis, lambda w: F.round(w, 1).cast("string"))))
    keyed = df.withColumn("__axis", key)
    order = keyed.groupBy("__axis").agg(F.count("*").alias("n")).withColumn("batch", F.concat(F.lit("Batch_"), F.row_number().over(Window.orderBy(F.desc("n"), "__axis"))))  # axes, not rows
    return keyed.join(F.broadcast(order.select("__axis", "batch")), "__axis").drop("__axis")


def strip_common(df: DataFrame, name: str = "filename") -> DataFrame:
    """Names without their common beginning and end; repeats get a running number."""
    from os.path import commonprefix

    ends = df.agg(F.min(name).alias("a"), F.max(name).alias("b"), F.min(F.reverse(name)).alias("c"), F.max(F.reverse(name)).alias("d")).first()
    head, tail = len(commonprefix([ends["a"] or "", ends["b"] or ""])), len(commonprefix([ends["c"] or "", ends["d"] or ""]))
    short = F.substring(F.col(name), head + 1, 100_000)
    short = F.when(F.length(name) - head - tail > 0, F.expr(f"substring({name}, {head + 1}, length({name}) - {head + tail})")).otherwise(short)
    out = df.withColumn("short", short)
    n = F.row_number().over(Window.partitionBy("short").orderBy(name))
    return out.withColumn("short", F.when(n > 1, F.concat_ws("_", "short", (n - 1).cast("string"))).otherwise(F.col("short")))


def groups_of(df: DataFrame, columns: tuple[int, ...] = (1,), splits: str = "/|_", names: tuple[str, ...] = ("Group",)) -> DataFrame:
    """Group columns from parts of the file name (from 1), and `group`, their values joined."""
    parts = F.split("filename", splits)
    out = df.withColumns({n: F.try_element_at(parts, F.lit(i)) for n, i in zip(names, columns, strict=True)})
    return out.withColumn("group", F.concat_ws("_", *names))


def complete(long: DataFrame, keys: list[str], pos: str, value: str, fill: float | None = None) -> DataFrame:
    """Coordinate form to one array for each key over the distinct axis; what is missing is null or `fill`."""
    axis = long.agg(F.array_sort(F.collect_set(pos)).alias("axis"))  # axis points, not rows
    maps = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(pos, value))).alias("m"))
    default = F.lit(fill).cast("double")
    return maps.crossJoin(F.broadcast(axis)).select(*keys, "axis", F.transform("axis", lambda p: F.coalesce(F.element_at("m", p), default)).alias("y"))


def build(df: DataFrame, axis_column: str = "axis") -> dict[int, Spectra]:
    """A collection for each axis length, ids numbered from 0 within it by file and spectrum name, on the most common axis."""
    out = {}
    for (n,) in df.where(F.col(axis_column).isNotNull()).select(F.size(axis_column)).distinct().orderBy(F.size(axis_column)).collect():
        part = df.where(F.size(axis_column) == n)
        axis = part.groupBy(axis_column).count().orderBy(F.desc("count"), axis_column).first()[0]
        # Names that are numbers are ordered as such.
        keyed = part.withColumn("__number", F.try_to_number("spectrum", F.lit("999999999999")).cast("double"))
        out[n] = Spectra.of(numbered(keyed, ["filename", "__number", "spectrum"], "spectrum_id").drop("__number").withColumnRenamed("y", "raw_data"), axis)
    return out


def read_collection(
    spark: SparkSession, path: str, file_type: str = "txt", sep: str | None = None, group_index: tuple[int, ...] = (1,), group_names: tuple[str, ...] = ("Group",),
    group_levels: tuple[str, ...] | None = None, group_splits: str = "/|_", cutoff: tuple[float, float] = (500, 3150), interpolation: bool = False,
) -> Spectra | dict[int, Spectra]:
    """A folder of text files as a collection, or one for each axis length where lengths differ.

    File names are relative to the folder; their parts give the group columns. Spectra of one length on different
    axes are put together and told apart by the column `batch`. With `group_levels`, other groups become null.
    Files without spectra are left out; an empty folder is an error.
    """
    read = stored(read_spectra(spark, path, file_type, sep, cutoff, interpolation))
    if read.isEmpty():
        raise FileNotFoundError(f"no {file_type} files below {path}")
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z0-9]+:(//[^/]*)?", "")
    base = re.sub("^[A-Za-z0-9]+:(//[^/]*)?", "", path).rstrip("/") if ":" in path else os.path.abspath(path)
    name = F.when(plain("filename").startswith(base + "/"), F.expr(f"substring(regexp_replace(filename, '^[A-Za-z0-9]+:(//[^/]*)?', ''), {len(base) + 2})")).otherwise(F.col("filename"))
    found = groups_of(read.where("axis IS NOT NULL").withColumn("filename", name), group_index, group_splits, group_names)
    if group_levels is not None:
        found = found.withColumn("group", F.when(F.col("group").isin(list(group_levels)), F.col("group")))
    out = {}
    for n, s in build(found).items():
        several = s.df.select("axis").distinct().limit(2).count() > 1
        out[n] = Spectra.of((batches(s.df) if several else s.df).drop("axis"), s.axis)
    if not out:
        raise ValueError(f"no file below {path} holds spectra")
    return out if len(out) > 1 else next(iter(out.values()))


def write_tsv(df: DataFrame, path: str, partition: list[str] | None = None, order: list[str] | None = None) -> None:
    """One folder for each key; rows sorted within it. Inputs stay."""
    out = df.repartition(*partition) if partition else df
    out = out.sortWithinPartitions(*(partition or []), *order) if order else out
    w = out.write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy(*partition) if partition else w).csv(path)


def point(df: DataFrame, key: str, columns=("V1", "V2")) -> DataFrame:
    """Rows of one mapping position, named as in "x y"."""
    return df.where(F.concat_ws(" ", *columns) == key)
