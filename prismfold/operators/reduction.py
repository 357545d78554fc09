"""Moments of a collection, principal components, principal coordinates, t-SNE and UMAP."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spectra import Spectra
from .preprocess import map_rows, rectangle


def gram(df: DataFrame, y: str, extra: tuple[str, ...] = ()) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and cross products of an array column and further numeric columns, in one pass.

    Tasks multiply their batches; the partial products are summed by matrix row, so the driver gets one p x p matrix.
    """
    full = df.select(F.concat(y, F.array(*[F.col(c).cast("double") for c in extra])).alias("v") if extra else F.col(y).alias("v")).where("v IS NOT NULL")

    def run(batches):
        out = None
        for b in batches:
            if b.num_rows:
                x = rectangle(b.column(0))
                x = np.hstack([np.ones((len(x), 1)), x])
                out = x.T @ x if out is None else out + x.T @ x
        if out is not None:
            yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    rows = full.mapInArrow(run, "i int, row array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).orderBy("i").collect()
    m = np.array([r["row"].toArray() for r in rows])
    return int(round(m[0, 0])), m[0, 1:], m[1:, 1:]


def moments(df: DataFrame, y: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample covariance."""
    n, s, c = gram(df, y)
    m = s / n
    return n, m, (c - n * np.outer(m, m)) / (n - 1)


def project(df: DataFrame, y: str, target: str, centre: np.ndarray, matrix: np.ndarray) -> DataFrame:
    return map_rows(df, y, target, lambda x: (x - centre) @ matrix)


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors; the largest loading of each vector is positive."""
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    return w, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def pca_model(df: DataFrame, y: str, k: int, scale: bool = True) -> dict:
    n, m, c = moments(df, y)
    d = np.sqrt(np.diag(c)) if scale else np.ones(len(m))
    d[d == 0] = 1
    w, v = components(c / np.outer(d, d), k)
    return {"n": n, "mean": m, "scale": d, "values": w, "vectors": v}


def pca(s: Spectra, n_pc: int = 2) -> Spectra:
    model = pca_model(s.df, s.stage, n_pc)
    df = project(s.df, s.stage, "PCA", model["mean"], model["vectors"] / model["scale"][:, None])
    return replace(s, df=df, reductions=s.reductions | {"PCA": n_pc})


#: Distances that principal coordinates take.
METRICS = ("euclidean", "maximum", "manhattan", "canberra", "binary", "minkowski")
#: Rows whose matrix of other than Euclidean distances the driver holds; for more rows tasks compute it anew where it is multiplied.
MAX_MATRIX = 2_000


def metric_block(x: np.ndarray, y: np.ndarray, metric: str, power: float = 2) -> np.ndarray:
    """Distances of rows to rows, added up along the columns. Canberra: terms 0/0 are left out and the rest scaled up;
    binary: the share of columns in which one is zero, of those in which not both are."""
    shape, yt = (len(x), len(y)), np.ascontiguousarray(y.T)
    out, used, d = np.zeros(shape), np.zeros(shape) if metric in ("canberra", "binary") else None, np.empty(shape)
    for k in range(x.shape[1]):
        np.subtract(x[:, k, None], yt[k], out=d)
        np.abs(d, out=d)
        if metric == "maximum":
            np.maximum(out, d, out=out)
        elif metric == "manhattan":
            out += d
        elif metric == "canberra":
            size = np.abs(x[:, k, None]) + np.abs(yt[k])
            used += size > 0
            out += d / np.where(size > 0, size, 1)
        elif metric == "binary":
            a, b = x[:, k, None] != 0, yt[k] != 0
            used += a | b
            out += a ^ b
        else:
            out += d ** (2 if metric == "euclidean" else power)
    if metric == "canberra":
        return out * x.shape[1] / np.maximum(used, 1)
    if metric == "binary":
        return out / np.maximum(used, 1)
    return out if metric in ("maximum", "manhattan") else out ** (1 / (2 if metric == "euclidean" else power))


def metric_distances(x: np.ndarray, metric: str, power: float = 2) -> np.ndarray:
    """Distances of all pairs of rows."""
    return metric_block(x, x, metric, power)


def distributed_scaling(spark, x: np.ndarray, k: int, metric: str, power: float = 2, most: int = 40, tolerance: float = 1e-9, part: int = 64, chunk: int = 1024) -> np.ndarray:
    """classical_scaling of the distances of all rows without their matrix, by block Lanczos from the rows' own columns.

    A pass multiplies the centred squared distances by some vectors: tasks take some rows each and go through all others
    block by block. It ends when no wanted axis has an error over `tolerance` of the largest eigenvalue.
    """
    n, width = len(x), max(2 * k, min(x.shape[1], 24))
    share = spark.sparkContext.broadcast(x)
    step = max(part, min(32 * part, n // (4 * spark.sparkContext.defaultParallelism)))

    def product(v: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(v)

        def run(first: int):
            rows = []
            for a in range(first, min(first + step, n), part):
                own, total = share.value[a : min(a + part, first + step)], 0
                for b in range(0, n, chunk):
                    total = total + metric_block(own, share.value[b : b + chunk], metric, power) ** 2 @ held.value[b : b + chunk]
                rows.append(total)
            return np.concatenate(rows)

        firsts = range(0, n, step)
        w = -0.5 * np.concatenate(spark.sparkContext.parallelize(firsts, len(firsts)).map(run).collect())
        held.destroy()
        return w - w.mean(axis=0)

    start = np.hstack([x, np.random.default_rng(42).normal(0, np.abs(x).mean() + 1e-300, (n, width))])[:, :width]
    start = start / np.maximum(np.linalg.norm(start, axis=0), 1e-300) + np.random.default_rng(43).normal(0, 1e-6 / np.sqrt(n), start.shape)
    basis = [np.linalg.qr(start - start.mean(axis=0))[0]]
    small = np.zeros((0, 0))
    for turn in range(most):
        w = product(basis[-1])
        column = np.vstack([q.T @ w for q in basis])
        old, small = small, np.zeros((len(column), len(column)))
        small[: len(old), : len(old)] = old
        small[:, len(old) :] = column
        small[len(old) :] = column.T
        values, vectors = components((small + small.T) / 2, k)
        for _ in range(2):
            for q in basis:
                w -= q @ (q.T @ w)
        q, rest = np.linalg.qr(w)
        error = np.linalg.norm(rest @ vectors[-width:], axis=0).max()
        if error <= tolerance * max(abs(values[0]), 1e-300):
            break
        basis.append(q)
    else:
        raise ValueError(f"{most} passes leave an error of {error / abs(values[0]):.1e} of the largest axis")
    share.destroy()
    places = sum(q @ vectors[i * width : (i + 1) * width] for i, q in enumerate(basis))
    return places * np.sign(places[np.abs(places).argmax(axis=0), np.arange(k)]) * np.sqrt(np.maximum(values, 0))


def classical_scaling(d: np.ndarray, k: int) -> np.ndarray:
    """Coordinates whose Euclidean distances come closest to d, the largest axis first; axes without variance are zero."""
    b = -0.5 * d**2
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    w, v = components(b, min(k, len(b)))
    out = np.zeros((len(b), k))
    out[:, : len(w)] = v * np.sqrt(np.maximum(w, 0))
    return out


def pcoa(s: Spectra, n_pc: int = 2, pca_pc: int | None = 20, distance: str = "euclidean", power: float = 2) -> Spectra:
    """Classical scaling of distances between scores, or between spectra without `pca_pc`.

    Euclidean: the centred principal axes of the scores, in one pass. Other distances: passes over all pairs of rows,
    computed in tasks; the driver holds the scores and the vectors of the passes.
    """
    if distance not in METRICS:
        raise ValueError(f"distance is one of {', '.join(METRICS)}")
    scored, column = (pca(s, min(pca_pc, len(s.axis))), "PCA") if pca_pc else (s, s.stage)
    if distance == "euclidean":
        model = pca_model(scored.df, column, n_pc, scale=False)
        df = project(scored.df, column, "PCoA", model["mean"], model["vectors"])
    else:
        held = scored.df.where(F.col(column).isNotNull()).select("spectrum_id", column).orderBy("spectrum_id").toArrow()
        x = rectangle(pa.concat_arrays(held.column(1).chunks)) if held.num_rows else np.zeros((0, 1))
        places = classical_scaling(metric_distances(x, distance, power), n_pc) if len(x) <= MAX_MATRIX else distributed_scaling(s.df.sparkSession, x, n_pc, distance, power)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_pc, pa.int32()), pa.array(places.reshape(-1)))
        placed = s.df.sparkSession.createDataFrame(pa.table({"spectrum_id": held.column(0), "PCoA": lists}))
        df = scored.df.drop("PCoA").join(placed, "spectrum_id", "left")
    return replace(scored, df=df, reductions=scored.reductions | {"PCoA": n_pc})


def _landmarks(df: DataFrame, y: str, most: int) -> np.ndarray:
    rows = df.select(y, "spectrum_id").orderBy(F.xxhash64("spectrum_id"), "spectrum_id").limit(most).collect()
    return np.array([r[0] for r in rows])


def _place(df: DataFrame, y: str, target: str, landmarks: np.ndarray, layout: np.ndarray, k: int = 5) -> DataFrame:
    """Landmarks get their own places, other rows the weighted mean of their nearest landmarks."""

    def fn(x):
        d = np.maximum((x**2).sum(1)[:, None] + (landmarks**2).sum(1) - 2 * x @ landmarks.T, 0)
        near = np.argsort(d, axis=1)[:, :k]
        w = 1 / (np.take_along_axis(d, near, 1) + 1e-9)
        return (layout[near] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1)

    return map_rows(df, y, target, fn)


def tsne_layout(x: np.ndarray, perplexity: float, iterations: int, seed: int) -> np.ndarray:
    n = len(x)
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    beta, low, high = np.ones(n), np.zeros(n), np.full(n, np.inf)
    for _ in range(50):
        p = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        over = h > np.log(perplexity)
        low, high = np.where(over, beta, low), np.where(over, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = (p + p.T) / (2 * n)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    step, gains = np.zeros_like(y), np.ones_like(y)
    for t in range(iterations):
        q = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1) - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = (p * (12 if t < 250 else 1) - q / q.sum()) * q
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gains = np.maximum(np.where(np.sign(g) == np.sign(step), gains * 0.8, gains + 0.2), 0.01)
        step = (0.5 if t < 250 else 0.8) * step - max(n / 12, 50) * gains * g
        y = y + step
        y -= y.mean(0)
    return y


def tsne(s: Spectra, pca_pc: int = 20, perplexity: float = 5, iterations: int = 1000, seed: int = 42, landmarks: int = 1000) -> Spectra:
    """Laid out exactly for at most `landmarks` rows on the driver; other rows are placed by their nearest landmarks."""
    scored = pca(s, min(pca_pc, len(s.axis)))
    x = _landmarks(scored.df, "PCA", landmarks)
    layout = tsne_layout(x, min(perplexity, max(1, (len(x) - 1) / 3)), iterations, seed)
    return replace(scored, df=_place(scored.df, "PCA", "tSNE", x, layout), reductions=scored.reductions | {"tSNE": 2})


def nearest_neighbours(x: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    if cosine:
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, 1)


def umap_curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a and b of 1/(1 + a d^2b) nearest to 1 up to min_dist and exp(-(d - min_dist)/spread) beyond, by damped least squares."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    at, damp = np.zeros(2), 1e-2  # logarithms of a and b
    model = lambda q: 1 / (1 + np.exp(q[0]) * d ** (2 * np.exp(q[1])))
    error = ((model(at) - want) ** 2).sum()
    for _ in range(200):
        f = model(at)
        slope = -f * (1 - f)
        j = np.column_stack([slope, slope * 2 * np.exp(at[1]) * np.log(d)])
        move = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (want - f))
        new = ((model(at + move) - want) ** 2).sum()
        if new < error:
            at, error, damp = at + move, new, damp / 3
        else:
            damp *= 4
        if np.abs(move).max() < 1e-10:
            break
    return float(np.exp(at[0])), float(np.exp(at[1]))


def umap_layout(x: np.ndarray, neighbours: int, seed: int, epochs: int = 200, a: float = 0.9922, b: float = 1.112) -> np.ndarray:
    n = len(x)
    near, d = nearest_neighbours(x, min(neighbours, n - 1), cosine=True)
    rho, sigma = d[:, :1], np.ones((n, 1))
    low, high = np.zeros((n, 1)), np.full((n, 1), np.inf)
    for _ in range(50):
        over = np.exp(-np.maximum(d - rho, 0) / sigma).sum(1, keepdims=True) > np.log2(near.shape[1])
        low, high = np.where(over, low, sigma), np.where(over, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.maximum(d - rho, 0) / sigma), 1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(w > 0)
    rng = np.random.default_rng(seed)
    y = components(np.cov((x - x.mean(0)).T), 2)[1]
    y = (x - x.mean(0)) @ y
    y = y / max(np.abs(y).max(), 1e-12) * 10 + rng.normal(0, 1e-3, (n, 2))
    for t in range(epochs):
        rate = 1 - t / epochs
        go = rng.random(len(i)) < w[i, j] / w.max()
        p, q = i[go], j[go]
        diff = y[p] - y[q]
        r = (diff**2).sum(1)
        pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * r**b), 0)
        np.add.at(y, p, rate * np.clip(pull[:, None] * diff, -4, 4))
        for _ in range(5):
            q = rng.integers(n, size=len(p))
            diff = y[p] - y[q]
            r = (diff**2).sum(1)
            push = 2 * b / ((0.001 + r) * (1 + a * r**b))
            np.add.at(y, p, rate * np.clip(push[:, None] * diff, -4, 4))
    return y


def umap(s: Spectra, pca_pc: int = 20, neighbours: int = 30, seed: int = 42, landmarks: int = 1000, min_dist: float | None = None, spread: float = 1.0) -> Spectra:
    """Curve constants are fixed (a 0.9922, b 1.112) unless a minimal distance is given, from which and the spread they follow."""
    curve = {} if min_dist is None else dict(zip("ab", umap_curve(min_dist, spread), strict=True))
    scored = pca(s, min(pca_pc, len(s.axis)))
    x = _landmarks(scored.df, "PCA", landmarks)
    return replace(scored, df=_place(scored.df, "PCA", "UMAP", x, umap_layout(x, neighbours, seed, **curve)), reductions=scored.reductions | {"UMAP": 2})
