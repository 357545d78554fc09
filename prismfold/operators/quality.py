"""Quality control. Each function returns (spectrum_id, quality, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_quantile, f_cdf
from ..spectra import Spectra, literal, mean, positions, sd, stored, take, total
from .preprocess import bubble_peaks
from .reduction import pca
from .tiles import matrix

LEVELS = {"hard": (0.05, 0.03, 10.0), "medium": (0.03, 0.03, 5.0), "easy": (0.3, 0.3, 3.0)}


def row_ok(y):
    return F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v))


def by_position(df: DataFrame, y: str, *aggs) -> list:
    return df.select(F.posexplode(y).alias("pos", "v")).groupBy("pos").agg(*aggs).orderBy("pos").collect()  # one row for each axis point


def snr(s: Spectra, level: str = "medium") -> DataFrame:
    noise, signal = take(s.y, positions(s.axis, 1800, 1900, closed=False)), take(s.y, positions(s.axis, 600, 3050, closed=False))
    qc1, qc2, qc3 = LEVELS[level]
    size = F.transform(noise, lambda v: F.abs(v))
    first = F.row_number().over(Window.partitionBy(s.stage).orderBy("spectrum_id")) == 1
    value = F.try_divide(F.array_max(signal) - mean(noise), sd(signal))
    facts = s.df.select("spectrum_id", value.alias("snr"), sd(size).alias("a"), mean(size).alias("b"), first.alias("first"))
    good = (F.col("a") < qc2) & (F.col("b") < qc1) & (F.col("snr") > qc3) & F.col("first")
    return facts.select("spectrum_id", "snr", F.coalesce(good, F.lit(False)).alias("quality"))


def first_copies(s: Spectra) -> DataFrame:
    return s.df.select("spectrum_id", (F.row_number().over(Window.partitionBy(s.stage).orderBy("spectrum_id")) == 1).alias("quality"))


def t2_statistic(y, centre, n: int):
    """Two-sample statistic of a spectrum's points against the reference's points, by pooled variance."""
    c = literal(centre)
    mc = float(np.mean(centre))
    vc = float(np.var(centre, ddof=1))
    v = F.pow(sd(y), 2)
    return F.try_divide(F.lit(n / 2.0) * F.pow(mean(y) - mc, 2), (v + vc) / 2), c


def t2(s: Spectra, signif: float = 0.05, most: int = 31) -> DataFrame:
    """Outliers against the median spectrum of the rest, until their number stays."""
    n = len(s.axis)
    data = s.df.select("spectrum_id", s.y.alias("y"), row_ok(s.y).alias("ok"))
    from ..functions.distributions import f_quantile

    limit, keep, last = f_quantile(1 - signif, 1, 2 * n - 2), F.col("ok"), -1
    stat = F.lit(0.0)
    for _ in range(most):
        centre = [r["m"] for r in by_position(data.where(keep), "y", F.expr("median(v)").alias("m"))]
        if not centre:
            break
        stat, _ = t2_statistic(F.col("y"), centre, n)
        keep = F.col("ok") & (F.coalesce(stat, F.lit(0.0)) <= limit)
        count = data.where(keep).count()
        if count == last:
            break
        last = count
    return data.select("spectrum_id", stat.alias("f_value"), F.coalesce(keep, F.lit(False)).alias("quality"))


def distance(s: Spectra, most: float = 1.0, rounds: int = 200) -> DataFrame:
    """Distance to the mean of the survivors; the farthest tenth goes until all are near.

    What has been cut is a short list of centres and limits; each pass judges its rows by the list and adds up the
    next mean, so no flags are stored between rounds.
    """
    data = stored(s.df.select("spectrum_id", s.y.cast("array<double>").alias("y"), row_ok(s.y).alias("ok")).where(F.col("y").isNotNull()))
    cuts: list[tuple[np.ndarray, float]] = []

    width = len(s.axis)

    def judged(x: np.ndarray, ok: np.ndarray, upto: list) -> np.ndarray:
        at = np.flatnonzero(ok)
        for centre, limit in upto:  # a row that is cut is not looked at again
            at = at[~(np.sqrt(((x[at] - centre) ** 2).sum(1)) > limit)]
        out = np.zeros(len(ok), bool)
        out[at] = True
        return out

    def passes(fn, schema: str, upto: list) -> DataFrame:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    ok = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
                    x = matrix(b.column(1), width)[0]
                    yield fn(b.column(0), x, judged(x, ok, upto))

        return data.mapInArrow(run, schema)

    def sums(ids, x, ok):
        t = np.append(x[ok].sum(axis=0), ok.sum())
        return pa.record_batch([pa.array(np.arange(len(t)), pa.int32()), pa.array(t)], names=["pos", "v"])

    centre, shrink = None, 1.0
    for _ in range(rounds):
        t = np.array([r["v"] for r in passes(sums, "pos int, v double", list(cuts)).groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()])
        if not len(t) or not t[-1]:
            break
        centre = t[:-1] / t[-1]

        def far(ids, x, ok, centre=centre):
            return pa.record_batch([pa.array(np.sqrt(((x - centre) ** 2).sum(1))[ok])], names=["d"])

        q = passes(far, "d double", list(cuts)).agg(F.percentile("d", F.lit(0.9)).alias("q"), F.max("d").alias("m")).first()
        if q["m"] <= most:
            break
        limit = max(q["q"], most) * shrink
        if q["m"] <= limit:
            shrink *= 0.95
        else:
            shrink = 1.0
            cuts.append((centre, max(limit, most)))

    def result(ids, x, ok, centre=centre):
        d = np.sqrt(((x - centre) ** 2).sum(1)) if centre is not None else np.full(len(x), np.nan)
        return pa.record_batch([ids, pa.array(d), pa.array(ok)], names=["spectrum_id", "distance", "quality"])

    return passes(result, "spectrum_id long, distance double, quality boolean", cuts)


def distance_once(s: Spectra) -> DataFrame:
    long = s.long()
    centre = long.groupBy("pos").agg(F.avg("value").alias("m"))
    return long.join(F.broadcast(centre), "pos").groupBy("spectrum_id").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("m"), 2))).alias("distance"))


def fences(s: Spectra) -> DataFrame:
    q = s.long().groupBy("pos").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select("pos", (F.col("q")[0] - 1.5 * iqr).alias("low"), (F.col("q")[1] + 1.5 * iqr).alias("high"))


def icod(s: Spectra, var_tol: float = 1.0, rounds: int = 100, run: int = 3) -> DataFrame:
    """Spectra whose peaks leave the interquartile fences at neighbouring peaks."""
    data = s.df.select("spectrum_id", s.y.alias("y"), row_ok(s.y).alias("good"))
    axis = s.axis
    width = np.floor(100 / (np.ptp(axis) / len(axis)))
    last = -1
    for _ in range(rounds):
        rows = by_position(data.where("good"), "y", F.avg("v").alias("m"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        if not rows:
            break
        peaks = bubble_peaks(np.array([r["m"] for r in rows]), max(width, 4))
        if len(peaks) < run:
            break
        q = np.array([r["q"] for r in rows])
        gap = 1.5 * (q[:, 1] - q[:, 0])
        out = F.array(*[((F.element_at("y", p + 1) < float(q[p, 0] - gap[p])) | (F.element_at("y", p + 1) > float(q[p, 1] + gap[p]))).cast("int") for p in peaks])
        runs = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(len(peaks) - run + 1)), lambda i: (F.aggregate(F.slice(out, i, run), F.lit(0), lambda a, v: a + v) > 1).cast("int")), F.lit(0), lambda a, v: a + v)
        worst = data.where("good").agg(F.max(runs).alias("m")).first()["m"]
        if worst is None or worst < np.ceil(len(peaks) * var_tol) * 0.2:
            break
        data = data.withColumn("good", F.col("good") & (runs < float(max(1, worst / 2))))
        left = data.where("good").count()
        if left == last:
            break
        last = left
    return data.select("spectrum_id", F.col("good").alias("quality"))


def _squared(x: np.ndarray, m: np.ndarray, inv: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,jk,ik->i", x - m, inv, x - m), 0) + 0.0


def _sums(x: np.ndarray) -> np.ndarray:
    """Rows, sums and cross products as one flat row."""
    x = np.hstack([np.ones((len(x), 1)), x])
    return (x.T @ x).reshape(-1)


def _mean_cov(flat: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    g = flat.reshape(p + 1, p + 1)
    m = g[0, 1:] / g[0, 0]
    return m, (g[1:, 1:] - g[0, 0] * np.outer(m, m)) / (g[0, 0] - 1)


def _scan(scores: DataFrame, fn, schema: str) -> DataFrame:
    """fn(x) -> columns, for the batches of scores."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in fn(x)], names=[f.split()[0] for f in schema.split(", ")])

    return scores.select("x").mapInArrow(run, schema)


def nearest_share(scores: DataFrame, centres: list[tuple[np.ndarray, np.ndarray, int]], most: int = 20_000) -> list[tuple[float, np.ndarray]]:
    """For each (mean, inverse, h): the h-th smallest distance over all rows, and the sums of the h nearest rows.

    Distances are found by the bits of their doubles, sixteen a pass, until the rows of the last bin are few enough to
    be fetched or are equal. Of rows at equal distance each counts in part.
    """
    low, shift = [0] * len(centres), [64] * len(centres)
    before, held = [0] * len(centres), [most + 1] * len(centres)
    while todo := [i for i in range(len(centres)) if held[i] > most and shift[i] > 0]:
        ask = [(i, *centres[i][:2], low[i], shift[i]) for i in todo]

        def count(x, ask=ask):
            who, bins, n = [], [], []
            for i, m, inv, lo, sh in ask:
                u = _squared(x, m, inv).view(np.uint64)
                if sh < 64:
                    u = u[u >> np.uint64(sh) == np.uint64(lo >> sh)]
                c = np.bincount((u >> np.uint64(sh - 16) & np.uint64(0xFFFF)).astype(np.int64), minlength=1)
                at = np.flatnonzero(c)
                who.append(np.full(len(at), i, np.int32)), bins.append(at), n.append(c[at])
            return np.concatenate(who), np.concatenate(bins), np.concatenate(n)

        found: dict[int, list] = {i: [] for i in todo}
        for r in _scan(scores, count, "i int, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n")).collect():
            found[r["i"]].append((r["bin"], r["n"]))
        for i in todo:
            for at, n in sorted(found[i]):
                if before[i] + n >= centres[i][2]:
                    shift[i] -= 16
                    low[i] |= at << shift[i]
                    held[i] = n
                    break
                before[i] += n
    ask = [(i, *centres[i][:2], low[i], shift[i], held[i] <= most) for i in range(len(centres))]

    def fetch(x):
        who, kind, rows = [], [], []
        for i, m, inv, lo, sh, few in ask:
            d = _squared(x, m, inv)
            u = d.view(np.uint64)
            at = u >> np.uint64(sh) == np.uint64(lo >> sh)
            rows.append(_sums(x[u < np.uint64(lo)])), kind.append(0)
            if few:
                rows += list(np.hstack([d[at][:, None], x[at]]))
                kind += [1] * int(at.sum())
            else:
                rows.append(_sums(x[at])), kind.append(2)
            who += [i] * (len(rows) - len(who))
        return np.array(who, np.int32), np.array(kind, np.int32), [r.tolist() for r in rows]

    got = _scan(scores, fetch, "i int, kind int, row array<double>").collect()
    out = []
    for i, (_, _, h) in enumerate(centres):
        rows = [[np.array(r["row"]) for r in got if r["i"] == i and r["kind"] == k] for k in range(3)]
        total_, need = np.sum(rows[0], axis=0), h - before[i]
        if rows[2]:
            equal = np.sum(rows[2], axis=0)
            out.append((float(np.uint64(low[i]).view(np.float64)), total_ + equal * (need / equal[0])))
        else:
            last = np.array(rows[1])
            d = np.sort(last[:, 0])[need - 1]
            inside, ties = last[last[:, 0] < d], last[last[:, 0] == d]
            out.append((float(d), total_ + _sums(inside[:, 1:]) + _sums(ties[:, 1:]) * ((need - len(inside)) / len(ties))))
    return out


def fast_mcd(scores: DataFrame, p: int, alpha: float = 0.6, starts: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the most concentrated share of all rows, reweighted once.

    Only the first centres come from few rows; each concentration step runs over all rows, for all starts at once.
    """
    n = scores.count()
    h = int(np.ceil(alpha * n))
    first = np.array([r["x"] for r in scores.orderBy(F.xxhash64("spectrum_id"), "spectrum_id").limit(starts * (p + 1)).collect()])
    state = {k: _mean_cov(_sums(part), p) for k in range(starts) if len(part := first[k * (p + 1) : (k + 1) * (p + 1)]) > 1}
    last, best = dict.fromkeys(state, np.inf), (np.inf, None)
    for _ in range(30):
        near = nearest_share(scores, [(m, np.linalg.inv(c + 1e-9 * np.eye(p)), h) for m, c in state.values()])
        state = {k: _mean_cov(sums, p) for k, (_, sums) in zip(state, near, strict=True)}
        det = {k: np.linalg.det(c) for k, (_, c) in state.items()}
        best = min([best, *((det[k], state[k]) for k in state)], key=lambda b: b[0])
        state = {k: v for k, v in state.items() if det[k] < last[k] * (1 - 1e-12)}
        last = det
        if not state:
            break
    m, c = best[1]
    inv = np.linalg.inv(c)
    middle = np.mean([d for d, _ in nearest_share(scores, [(m, inv, (n + 1) // 2), (m, inv, n // 2 + 1)])])
    inv = inv / (middle / chi2_quantile(0.5, p))
    limit = chi2_quantile(0.95, p)
    inside = _scan(scores, lambda x: ([_sums(x[_squared(x, m, inv) <= limit]).tolist()],), "row array<double>").collect()
    return _mean_cov(np.sum([r["row"] for r in inside], axis=0), p)


def mcd(s: Spectra, alpha: float = 0.01) -> DataFrame:
    """Robust distances on five scores; the estimate takes all rows."""
    p = min(5, len(s.axis))
    scored = pca(s, min(20, len(s.axis))).df.select("spectrum_id", F.slice("PCA", 1, 5).alias("x"))
    scores = stored(scored)
    m, c = fast_mcd(scores.where("x IS NOT NULL"), p)
    inv = np.linalg.inv(c)
    diff = F.zip_with("x", literal(m), lambda a, b: a - b)
    rows = F.array(*[literal(r) for r in inv])
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    d = dot(F.transform(rows, lambda r: dot(r, diff)), diff)
    return scores.select("spectrum_id", d.alias("distance"), (d <= chi2_quantile(1 - alpha, p)).alias("quality"))


def t2_p_value(f: float, n: int) -> float:
    return 1 - f_cdf(f, 1, 2 * n - 2)
