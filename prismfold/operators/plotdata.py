"""Data behind chord diagrams, time series by cluster, scatter plots, and merged marker groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spectra import Spectra, nearest, take
from .correlation import correlation_pairs, pair_outliers

#: Colours of links at r = -1, -threshold, threshold and 1 (fixed values).
COLD, COOL, WARM, HOT = "#0033FF", "#66CCFF", "#FF6666", "#FF3300"
SIGNS = ("negative", "positive", "both")


def merge_groups(groups: list[list[float]], gap: float = 20) -> list[list[float]]:
    """Neighbouring groups of axis points become one as long as some points of theirs lie within the gap.

    Groups keep their order; the result has no two neighbours within the gap. Empty groups vanish.
    """
    out: list[np.ndarray] = []
    for g in groups:
        if not len(g):
            continue
        out.append(np.array(g, float))
        while len(out) > 1:
            held = np.sort(out[-2])
            at = np.searchsorted(held, out[-1])
            near = np.minimum(np.abs(held[np.minimum(at, len(held) - 1)] - out[-1]), np.abs(held[np.maximum(at - 1, 0)] - out[-1]))
            if near.min() > gap:
                break
            last = out.pop()
            out[-1] = np.concatenate([out[-1], last])
    return [g.tolist() for g in out]


def _channel(low: str, high: str, at: int, share):
    a, b = (int(c[at : at + 2], 16) for c in (low, high))
    return F.lpad(F.hex(F.round(F.lit(float(a)) + share * float(b - a)).cast("int")), 2, "0")


def link_colour(r, threshold: float):
    """The colour of a link: from cool to cold below -threshold, from warm to hot above it, between them none."""
    share = (F.abs(r) - F.lit(threshold)) / F.lit(max(1 - threshold, 1e-12))
    shade = lambda low, high: F.concat(F.lit("#"), *[_channel(low, high, i, share) for i in (1, 3, 5)])
    return F.when(r <= -threshold, shade(COOL, COLD)).when(r >= threshold, shade(WARM, HOT))


def chord_links(s: Spectra, threshold: float = 0.6, sign: str = "negative", p: float = 0.05, drop_outliers: bool = True) -> DataFrame:
    """(group, wave_1, wave_2, r, colour) of the links of each group's chord diagram: r beyond the threshold on the
    asked side or sides, with a p value of at most p; waves rounded, wave_1 below wave_2."""
    if sign not in SIGNS:
        raise ValueError(f"sign is one of {', '.join(SIGNS)}")
    if drop_outliers:
        good = pair_outliers(s).where("NOT outlier").select("spectrum_id")
        s = s.write(s.stage, s.df.join(good, "spectrum_id", "left_semi"))
    r = F.col("r")
    side = {"negative": (r > -1) & (r < -threshold), "positive": (r < 1) & (r > threshold), "both": F.abs(r) > threshold}[sign]
    axis = F.array(*[F.lit(float(round(w))) for w in s.axis.tolist()])
    links = correlation_pairs(s).where(side & (F.col("p") <= p))
    return links.select("group", F.element_at(axis, F.col("i") + 1).alias("wave_1"), F.element_at(axis, F.col("j") + 1).alias("wave_2"), "r", link_colour(r, threshold).alias("colour"))


def chord_nodes(links: DataFrame) -> DataFrame:
    """(group, wave, degree, sum_r, mean_r): the tracks around a chord diagram."""
    ends = links.select("group", F.explode(F.array("wave_1", "wave_2")).alias("wave"), "r")
    return ends.groupBy("group", "wave").agg(F.count("*").alias("degree"), F.sum("r").alias("sum_r"), F.avg("r").alias("mean_r"))


def local_chord(s: Spectra, annotations: list[tuple[float, str]], threshold: float = 0.6, sign: str = "negative") -> DataFrame:
    """The links among the axis points nearest to annotated bands, outlying spectra left out, with the bands' classes.

    Outliers are judged on all axis points. Of two bands at one axis point, the last gives the class.
    """
    good = pair_outliers(s).where("NOT outlier").select("spectrum_id")
    s = s.write(s.stage, s.df.join(good, "spectrum_id", "left_semi"))
    at = {nearest(s.axis, w): g for w, g in annotations}
    keep = sorted(at)
    links = chord_links(s.write(s.stage, take(s.y, keep), s.axis[keep]), threshold, sign, drop_outliers=False)
    names = s.df.sparkSession.createDataFrame([(float(round(s.axis[i])), at[i]) for i in keep], "wave double, band_group string")  # bands, not rows
    for end in ("1", "2"):
        links = links.join(F.broadcast(names.toDF(f"wave_{end}", f"band_group_{end}")), f"wave_{end}")
    return links


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """(spectrum_id, x, y, colour) of two numeric columns; rows without either are left out."""
    tone = F.col(f"`{colour}`") if colour else F.lit(None)
    return df.select("spectrum_id", F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"), tone.cast("string").alias("colour")).where("x IS NOT NULL AND y IS NOT NULL")


def time_series(df: DataFrame, reduction: str, cluster: str = "cluster", group: str = "group") -> DataFrame:
    """(panel, spectrum_id, x, y, cluster): each group's panel of a reduction, its own points by cluster.

    The grey background of a panel, the points of other groups, is this table without the panel's rows: it is not
    copied for each panel.
    """
    at = lambda i: F.element_at(reduction, i)
    return df.select(F.col(group).alias("panel"), "spectrum_id", at(1).alias("x"), at(2).alias("y"), F.concat(F.lit("Cluster_"), F.col(cluster).cast("string")).alias("cluster"))


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counterclockwise from the leftmost lowest."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(q):
        out: list[np.ndarray] = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hulls(df: DataFrame, keys: tuple[str, str] = ("panel", "cluster")) -> DataFrame:
    """(panel, cluster, corner, x, y): hulls of each batch first, so that only their corners meet in a task."""
    a, b = keys

    def partial(batches):
        held: dict = {}
        for batch in batches:
            t = batch.to_pandas()
            for k, g in t.groupby([a, b], dropna=False, sort=False):
                xy = g[["x", "y"]].to_numpy(float)
                xy = xy[np.isfinite(xy).all(axis=1)]
                held[k] = hull(np.concatenate([held[k], xy]) if k in held else xy)
        for (p, c), xy in held.items():
            p, c = (None if v != v else v for v in (p, c))
            yield pa.record_batch([pa.array([p] * len(xy), pa.string()), pa.array([c] * len(xy), pa.string()), pa.array(xy[:, 0], pa.float64()), pa.array(xy[:, 1], pa.float64())], names=["panel", "cluster", "x", "y"])

    def whole(t: pa.Table) -> pa.Table:
        xy = hull(np.column_stack([t["x"].to_numpy(), t["y"].to_numpy()]))
        n = len(xy)
        return pa.table({"panel": pa.array([t["panel"][0].as_py()] * n, pa.string()), "cluster": pa.array([t["cluster"][0].as_py()] * n, pa.string()), "corner": pa.array(range(n), pa.int32()), "x": xy[:, 0], "y": xy[:, 1]})

    points = df.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return points.mapInArrow(partial, "panel string, cluster string, x double, y double").groupBy("panel", "cluster").applyInArrow(whole, "panel string, cluster string, corner int, x double, y double")
