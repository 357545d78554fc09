"""Decompositions: spectra as sums of few components. Scores are row-local; only small cross products meet on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spectra import Spectra, stored
from .preprocess import map_rows, rectangle
from .reduction import components, gram, moments


def _sums(df: DataFrame, y: str, scores: str | None, fn) -> dict[int, np.ndarray]:
    """Sum over batches of the rows of fn(x, scores), by row number."""

    def run(batches):
        out = None
        for b in batches:
            if b.num_rows:
                x = rectangle(b.column(0))
                w = rectangle(b.column(1)) if scores else None
                m = fn(x, w)
                out = m if out is None else out + m
        if out is not None:
            yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    rows = df.select(y, *([scores] if scores else [])).mapInArrow(run, "i int, row array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).orderBy("i").collect()
    return np.array([r["row"].toArray() for r in rows])


def nmf(s: Spectra, n_comp: int = 2, max_iter: int = 100, tol: float = 1e-4, seed: int = 42, keep: int = 10) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Multiplicative updates, H before W. W is stored every `keep` rounds; between them a row's W is derived from
    the stored one by the updates since, which need only the small matrices of those rounds.

    Returns (spectrum_id, W), H and the error before each round; ends where the error falls by less than `tol` of itself.
    """
    p = len(s.axis)
    rng = np.random.default_rng(seed)
    h = rng.random((n_comp, p)) + 0.1
    start = rng.random((p, n_comp)) / p + 1e-3
    df = map_rows(s.df.select("spectrum_id", F.transform(s.y, lambda v: F.greatest(v, F.lit(0.0))).alias("x")), "x", "W", lambda x: x @ start + 1e-3)
    steps: list[np.ndarray] = []

    def update(x: np.ndarray, w: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
        for m in by:
            w = w * (x @ m.T) / (w @ (m @ m.T) + 1e-9)
        return w

    def advance(df: DataFrame, by: list[np.ndarray]) -> DataFrame:
        both = df.select("spectrum_id", "x", F.concat("x", "W").alias("__xw"))
        return map_rows(both, "__xw", "W", lambda xw: update(xw[:, :p], xw[:, p:], by)).select("spectrum_id", "x", "W")

    errors: list[float] = []
    for _ in range(max_iter):
        if len(steps) == keep:
            df, steps = stored(advance(df, steps)), []
        now = list(steps)

        def parts(x, w, now=now):
            w = update(x, w, now)
            return np.hstack([w.T @ x, w.T @ w, np.full((n_comp, 1), (x * x).sum())])

        m = _sums(df, "x", "W", parts)
        wx, ww, xx = m[:, :p], m[:, p : p + n_comp], m[0, -1]
        errors.append(float(np.sqrt(max(xx - 2 * (wx * h).sum() + (h * (ww @ h)).sum(), 0))))
        if errors[-1] < tol or len(errors) > 2 and 0 <= errors[-2] - errors[-1] < tol * errors[-1]:
            break
        h = h * wx / (ww @ h + 1e-9)
        steps.append(h.copy())
    return advance(df, steps).select("spectrum_id", "W"), h, errors


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Rows c >= 0 that minimise |c a - b| by coordinate descent."""
    g, t = a @ a.T, b @ a.T
    c = np.maximum(t / np.maximum(np.diag(g), 1e-12), 0)
    for _ in range(rounds):
        old = c.copy()
        for k in range(len(a)):
            c[:, k] = np.maximum(c[:, k] + (t[:, k] - c @ g[:, k]) / max(g[k, k], 1e-12), 0)
        if np.abs(c - old).max() < 1e-10:
            break
    return c


def mcr_als(s: Spectra, n_comp: int = 2, rounds: int = 50, seed: int = 42, angle: float = 0.05) -> tuple[DataFrame, np.ndarray]:
    """Concentrations (rows sum to 1) and unit-length component spectra, both non-negative."""
    p = len(s.axis)
    n, total, cross = gram(s.df, s.stage)
    _, v = components(cross / n, n_comp)
    spectra = np.abs(v.T) + np.random.default_rng(seed).random((n_comp, p)) * 1e-3
    spectra /= np.linalg.norm(spectra, axis=1, keepdims=True)
    mean = total / n
    for _ in range(rounds):

        def parts(x, _, spectra=spectra):
            c = nnls(spectra, x)
            c = c / np.maximum(c.sum(1, keepdims=True), 1e-12)
            return np.hstack([c.T @ x, c.T @ c])

        m = _sums(s.df, s.stage, None, parts)
        new = np.maximum(np.linalg.pinv(m[:, p:]) @ m[:, :p], 0)
        new = (1 - angle) * new + angle * mean
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        moved = np.abs(new - spectra).max()
        spectra = new
        if moved < 1e-6:
            break

    def final(x):
        c = nnls(spectra, x)
        return c / np.maximum(c.sum(1, keepdims=True), 1e-12)

    return map_rows(s.df, s.stage, "concentration", final).select("spectrum_id", "concentration"), spectra


def ica(s: Spectra, n_comp: int = 2, rounds: int = 100, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """FastICA with tanh: (spectrum_id, sources) and the mixing matrix, a row for each axis point."""
    n, mean, cov = moments(s.df, s.stage)
    w, v = components(cov, n_comp)
    white, colour = v / np.sqrt(w), v * np.sqrt(w)
    u = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_comp, n_comp)))[0]
    for _ in range(rounds):

        def parts(x, _, u=u):
            z = (x - mean) @ white
            g = np.tanh(z @ u.T)
            return np.hstack([g.T @ z, (1 - g**2).sum(0)[:, None]])

        m = _sums(s.df, s.stage, None, parts)
        new = m[:, :n_comp] / n - (m[:, n_comp] / n)[:, None] * u
        a, _, b = np.linalg.svd(new)
        new = a @ b
        moved = np.abs(np.abs((new * u).sum(1)) - 1).max()
        u = new
        if moved < 1e-8:
            break
    return map_rows(s.df, s.stage, "sources", lambda x: (x - mean) @ white @ u.T).select("spectrum_id", "sources"), colour @ u.T
