"""Correlation within groups: outliers, correlation networks and two-dimensional correlation."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided
from ..spectra import Spectra, nearest, stored, take
from .reduction import gram

#: Half of exp(-d/2), the density of two degrees of freedom, is under 0.1 beyond this distance.
PAIR_LIMIT = 2 * log(5)
#: Ranks of the smallest block and Chebyshev moments of a block in two_dimensional.
LEAF, FAR = 512, 20


def pair_outliers(s: Spectra, p: float = 0.1) -> DataFrame:
    """Spectra that lie far out, within their group, in some pair of neighbouring axis points."""
    n = len(s.axis)
    at = [(i, i + 1) for i in range(0, n - 1, 2)] + ([(n - 2, n - 1)] if n % 2 else [])
    y = s.y
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.element_at(y, i + 1).alias("a"), F.element_at(y, j + 1).alias("b")) for k, (i, j) in enumerate(at)])
    long = s.df.select("spectrum_id", "group", F.inline(pairs))
    m = long.groupBy("group", "k").agg(F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("c"))
    det = F.col("va") * F.col("vb") - F.col("c") * F.col("c")
    d2 = F.try_divide(F.col("vb") * F.col("a") * F.col("a") - 2 * F.col("c") * F.col("a") * F.col("b") + F.col("va") * F.col("b") * F.col("b"), det)
    # Distances from the group's mean in the pair: values are centred first.
    mean = long.groupBy("group", "k").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    centred = long.join(m.join(mean, ["group", "k"]), ["group", "k"]).withColumn("a", F.col("a") - F.col("ma")).withColumn("b", F.col("b") - F.col("mb"))
    return centred.groupBy("spectrum_id").agg((F.max(F.sqrt(d2)) > 2 * log(0.5 / p)).alias("outlier"))


def correlation_pairs(s: Spectra) -> DataFrame:
    """(group, i, j, r, n, p) for i < j: correlations of axis points within each group, from partial cross products."""
    n = len(s.axis)

    def run(batches):
        sums: dict = {}
        for b in batches:
            if b.num_rows:
                groups = np.array(b.column(0).to_pylist(), object)
                x = np.array(b.column(1).to_pylist(), float)
                for g in dict.fromkeys(groups.tolist()):
                    part = np.hstack([np.ones((int((groups == g).sum()), 1)), x[groups == g]])
                    sums[g] = sums.get(g, 0) + part.T @ part
        for g, m in sums.items():
            yield pa.record_batch([pa.array([g] * (n + 1), pa.string()), pa.array(np.arange(n + 1), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["group", "i", "row"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = s.df.select("group", s.y).mapInArrow(run, "group string, i int, row array<double>").groupBy("group", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    first = rows.where("i = 0").select("group", F.col("row").alias("s"))
    diag = rows.where("i > 0").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.element_at("row", F.col("i") + 1).alias("d")))), lambda x: x["d"]).alias("d"))
    full = rows.where("i > 0").join(first, "group").join(diag, "group").select("group", (F.col("i") - 1).alias("i"), "s", "d", F.posexplode(F.slice("row", 2, n)).alias("j", "xy")).where("i < j")
    N, si, sj = F.element_at("s", 1), F.element_at("s", F.col("i") + 2), F.element_at("s", F.col("j") + 2)
    r = F.try_divide(F.col("xy") - si * sj / N, F.sqrt((F.element_at("d", F.col("i") + 1) - si * si / N) * (F.element_at("d", F.col("j") + 1) - sj * sj / N)))
    out = full.select("group", "i", "j", r.alias("r"), N.cast("long").alias("n"))
    p = F.pandas_udf(lambda r, n: r.combine(n, lambda a, m: 0.0 if m <= 2 or abs(a) >= 1 else t_two_sided(a * ((m - 2) / (1 - a * a)) ** 0.5, m - 2)).astype(float), "double")
    return out.withColumn("p", p("r", "n"))


def network(s: Spectra, threshold: float = 0.6, drop_outliers: bool = True) -> DataFrame:
    """Negative edges of each group: r below -threshold with p at most 0.05, waves rounded."""
    if drop_outliers:
        good = pair_outliers(s).where("NOT outlier").select("spectrum_id")
        s = s.write(s.stage, s.df.join(good, "spectrum_id", "left_semi"))
    axis = F.array(*[F.lit(float(round(w))) for w in s.axis.tolist()])
    e = correlation_pairs(s).where((F.col("p") <= 0.05) & (F.col("r") < -threshold))
    return e.select("group", F.element_at(axis, F.col("i") + 1).alias("wave_1"), F.element_at(axis, F.col("j") + 1).alias("wave_2"), "r")


def local_network(s: Spectra, annotations: list[tuple[float, str]], threshold: float = 0.6) -> DataFrame:
    """The network among the axis points nearest to annotated bands, with the bands' classes."""
    at = {nearest(s.axis, w): (w, g) for w, g in annotations}
    keep = sorted(at)
    small = s.write(s.stage, take(s.y, keep), s.axis[keep])
    names = s.df.sparkSession.createDataFrame([(float(round(s.axis[i])), g) for i, (_, g) in at.items()], "wave double, band_group string")
    e = network(small, threshold)
    one, two = names.toDF("wave_1", "band_group_1"), names.toDF("wave_2", "band_group_2")
    return e.join(F.broadcast(one), "wave_1").join(F.broadcast(two), "wave_2")


def _blocks(s: Spectra, blocks: int) -> tuple[int, int, DataFrame]:
    """Rows, block size and (g, k, v): each spectrum with its rank k along spectrum_id, in its block g and in the one before."""
    y = s.y.cast("array<double>")
    sorted_ = s.df.where(s.y.isNotNull()).select("spectrum_id", y.alias("v")).orderBy("spectrum_id", "v")
    # Written, so that places within sorted partitions and the partitions' sizes belong to one and the same run.
    placed = stored(sorted_.select(F.monotonically_increasing_id().alias("at"), "v"))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    m = sum(r["count"] for r in sizes)
    size = max(LEAF, -(-m // blocks))
    first, seen = [], 0
    for r in sizes:
        first.append((r["part"], seen))
        seen += r["count"]
    starts = s.df.sparkSession.createDataFrame(first, "part long, first long")
    rank = (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("k")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(rank, "v")
    g = F.floor(F.col("k") / size)
    return m, size, ranked.select(F.explode(F.when(g > 0, F.array(g, g - 1)).otherwise(F.array(g))).alias("g"), "k", "v")


def _nodes(n: int) -> np.ndarray:
    return np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))


def _interpolate(at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Values at `at` of the Lagrange polynomials of Chebyshev nodes: sum of T_i(at) T_i(node) times 2/n, 1/n for i = 0."""
    n = len(nodes)
    t = lambda x: np.cos(np.outer(np.arccos(np.clip(x, -1, 1)), np.arange(n)))
    w = np.full(n, 2 / n)
    w[0] = 1 / n
    return (t(at) * w) @ t(nodes).T


def _later(z: np.ndarray) -> np.ndarray:
    """Sum over later rows k of z_k / (pi (k - j)) for each row j, by FFT."""
    n = len(z)
    size = 1 << (2 * n - 1).bit_length()
    c = np.zeros(n)
    c[1:] = 1 / (np.pi * np.arange(1, n))
    kernel = np.conj(np.fft.rfft(c, size))[:, None]
    return np.hstack([np.fft.irfft(np.fft.rfft(z[:, a : a + 16], size, axis=0) * kernel, size, axis=0)[:n] for a in range(0, z.shape[1], 16)])


def two_dimensional(s: Spectra, blocks: int = 512) -> DataFrame:
    """(i, j, synchronous, asynchronous): the perturbation runs along spectrum_id, by rank.

    The synchronous part is the covariance. The asynchronous part takes all pairs of spectra, weighted by
    1/(pi (k - j)) for ranks j and k. Ranks are cut into blocks. Pairs in a block or in neighbouring blocks are
    summed by FFT in one task a block. Blocks further apart see each other through `FAR` Chebyshev moments a
    block: their weight is smooth there, and the error, below 1e-14 of the weight, is that of rounding.
    """
    n, sums, cross = gram(s.df, s.stage)
    sync = (cross - np.outer(sums, sums) / n) / (n - 1)
    m, size, rows = _blocks(s, blocks)
    mean, p, nodes = sums / n, len(s.axis), _nodes(FAR)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        g = table.column("g")[0].as_py()
        k = table.column("k").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(k), p) - mean
        own = int(np.searchsorted(k, (g + 1) * size))
        near = x[:own].T @ _later(x)[:own]
        moments = _interpolate((k[:own] - g * size + 0.5) / size * 2 - 1, nodes).T @ x[:own]
        return pa.table({"g": pa.array([-1] * p + [g] * FAR, pa.int64()), "i": pa.array([*range(p), *range(FAR)], pa.int32()), "row": pa.array([*near.tolist(), *moments.tolist()], pa.list_(pa.float64()))})

    parts = rows.groupBy("g").applyInArrow(run, "g long, i int, row array<double>")
    got = parts.groupBy("g", "i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).orderBy("g", "i").collect()
    got = np.array([r["row"].toArray() for r in got])
    half, moments = got[:p], got[p:].reshape(-1, FAR, p)
    # A distance of d blocks between the nodes of two blocks, in rows.
    apart = lambda d: 1 / (np.pi * size * (d + (nodes[None, :] - nodes[:, None]) / 2))
    for d in range(2, len(moments)):
        half = half + np.tensordot(moments[:-d], apart(d) @ moments[d:], ([0, 1], [0, 1]))
    asynchronous = (half - half.T) / (m - 1)
    out = [(i, j, float(sync[i, j]), float(asynchronous[i, j])) for i in range(p) for j in range(p)]
    return s.df.sparkSession.createDataFrame(out, "i int, j int, synchronous double, asynchronous double")


def pair_table(df: DataFrame, value: str = "value", duplicate: bool = False) -> DataFrame:
    """A matrix in (row, row_group, col, col_group, value) form, with the pair of groups labelled: its upper triangle, or all cells."""
    same = F.col("row_group") == F.col("col_group")
    cells = df if duplicate else df.where(F.col("row") < F.col("col"))
    return cells.select("row", "col", F.col(value).alias("value"), F.concat_ws("_VS._", "row_group", "col_group").alias("pair"), F.when(same, "AllWithin").otherwise("AllBetween").alias("kind"))


def pair_table_with_p(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Correlations (group, i, j, r, p) of axis points with their bands' groups (pos, band_group): r and p side by side."""
    one, two = groups.toDF("i", "row_group"), groups.toDF("j", "col_group")
    both = pairs.join(F.broadcast(one), "i").join(F.broadcast(two), "j")  # axis points, not rows
    same = F.col("row_group") == F.col("col_group")
    return both.select("group", "i", "j", F.concat_ws("_VS._", "row_group", "col_group").alias("pair"), F.when(same, "AllWithin").otherwise("AllBetween").alias("kind"), "r", "p")
