"""Marker discovery: rank statistics, correlations, importances and tests by axis point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import adjust, chi2_cdf, f_cdf, normal_cdf, t_two_sided
from ..spectra import Spectra, numbered, stored
from .forest import Trees, permuted_hits
from .preprocess import bubble_baseline, iterative_polyfit
from .reduction import components, moments


def auc_by_rank(long: DataFrame, keys: list[str], direction: str = "lower") -> DataFrame:
    """One-vs-rest AUC of `value` for each key and group, from descending mid-ranks; "higher" gives the complement.

    Equal values are counted before ranks are taken, so a window holds a key's distinct values only.
    """
    counts = long.groupBy(*keys, "value", "group").agg(F.count("*").alias("n"))
    values = counts.groupBy(*keys, "value").agg(F.sum("n").alias("m"))
    above = Window.partitionBy(*keys).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("rank", F.coalesce(F.sum("m").over(above), F.lit(0)) + (F.col("m") + 1) / 2)
    sums = counts.join(ranks, [*keys, "value"]).groupBy(*keys, "group").agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("p"))
    sized = sums.withColumn("total", F.sum("p").over(Window.partitionBy(*keys)))
    auc = F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("total") - F.col("p"))), F.lit(0.0))
    return sized.select(*keys, "group", (auc if direction == "lower" else 1 - auc).alias("auc"))


def roc(s: Spectra, threshold: float = 0.75, direction: str = "lower") -> DataFrame:
    out = auc_by_rank(s.long().where("value IS NOT NULL"), ["pos", "wavenumber"], direction)
    return out.where(F.col("auc") > threshold)


def ratios(s: Spectra, both: bool = False, extra: tuple[str, ...] = ("group",)) -> DataFrame:
    """value = y_i / y_j for i < j, or for all i <> j."""
    n = len(s.axis)
    y, axis = s.y, F.array(*[F.lit(w) for w in s.axis.tolist()])
    at = [(i, j) for i in range(n) for j in (range(n) if both else range(i + 1, n)) if i != j]
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda j: (j != i) if both else (j > i)), lambda j: F.struct((i - 1).alias("i"), (j - 1).alias("j"), F.try_divide(F.element_at(y, i), F.element_at(y, j)).alias("value")))))
    if not at:
        pairs = F.filter(pairs, lambda p: F.lit(False))
    return s.df.select("spectrum_id", *extra, F.inline(pairs)).withColumn("wave_i", F.element_at(axis, F.col("i") + 1)).withColumn("wave_j", F.element_at(axis, F.col("j") + 1))


def group_aucs(value: np.ndarray, code: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and one-vs-rest AUC of each group, from descending mid-ranks; NaN are equal and the largest."""
    order = np.argsort(value)
    v = value[order]
    starts = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))
    ends = np.append(starts[1:], len(v))
    rank = np.repeat(len(v) + 1 - (starts + 1 + ends) / 2, ends - starts)
    p = np.bincount(code, minlength=groups).astype(float)
    r, rest = np.bincount(code[order], weights=rank, minlength=groups), p * (len(v) - p)
    return p, np.where(rest > 0, (r - p * (p + 1) / 2) / np.where(rest > 0, rest, 1), 0.0)


def pair_aucs(s: Spectra, direction: str = "lower") -> DataFrame:
    """(i, j, group, auc) of the ratios y_i / y_j for i < j.

    Rows are turned into strips of columns, and a task takes two strips: a ratio is never a row of a table, and each
    column is sent once for each strip.
    """
    n = len(s.axis)
    strip = max(8, n // 64)
    strips = -(-n // strip)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            groups, flat = b.column(0).dictionary_encode(null_encoding="encode"), b.column(1).flatten()
            code = groups.indices.to_numpy().astype(np.int32)
            y = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, n).T
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(b.num_rows, n).T
            key = (TaskContext.get().partitionId() << 32) + k
            for t in range(strips):
                at = slice(t * strip, (t + 1) * strip)
                row = [[t], [key], [groups.dictionary.to_pylist()], [code.tobytes()], [y[at].tobytes()], [there[at].tobytes()]]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["strip", "key", "groups", "code", "y", "there"])

    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    parts = s.df.select(F.col("group").cast("string"), s.y.cast("array<double>").alias("y")).mapInArrow(cut, "strip int, key long, groups array<string>, code binary, y binary, there binary")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        names: dict[str | None, int] = {}
        for b in batches:
            for r in b.to_pylist():
                code = np.frombuffer(r["code"], np.int32)
                own = np.array([names.setdefault(g, len(names)) for g in r["groups"]])
                shape = (-1, len(code))
                held.setdefault(r["strip"], []).append((r["key"], own[code], np.frombuffer(r["y"]).reshape(shape), np.frombuffer(r["there"], bool).reshape(shape)))
        joined = {}
        for t, v in sorted(held.items()):
            v.sort(key=lambda x: x[0])
            joined[t] = (np.concatenate([x[1] for x in v]), np.hstack([x[2] for x in v]), np.hstack([x[3] for x in v]))
            held[t] = []
        (first, (code, a, has)), (last, (_, b, also)) = list(joined.items())[0], list(joined.items())[-1]
        label = pa.array(list(names), pa.string())
        for i in range(len(a)):
            for j in range(i + 1 if first == last else 0, len(b)):
                known = has[i] & also[j] & (b[j] != 0)
                if not known.any():
                    continue
                with np.errstate(all="ignore"):
                    p, auc = group_aucs(a[i][known] / b[j][known], code[known], len(names))
                at = np.flatnonzero(p)
                pair = [pa.array(np.full(len(at), x), pa.int32()) for x in (first * strip + i, last * strip + j)]
                yield pa.record_batch([*pair, label.take(pa.array(at)), pa.array((auc if direction == "lower" else 1 - auc)[at])], names=["i", "j", "group", "auc"])

    other = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))
    many = parts.withColumn("__other", other).withColumn("__tile", F.least("strip", "__other") * strips + F.greatest("strip", "__other")).drop("__other")
    count = strips * (strips + 1) // 2
    return many.repartition(min(4 * count, max(count, 1000)), "__tile").groupBy("__tile").applyInArrow(ranked, "i int, j int, group string, auc double")


def roc_pairs(s: Spectra, threshold: float = 0.75, direction: str = "lower") -> DataFrame:
    return pair_aucs(s, direction).where(F.col("auc") > threshold)


def numeric_label(group: Column) -> Column:
    return F.regexp_replace(group, "[^0-9]", "").cast("double")


def average_spectra(s: Spectra, min_range: float = 30) -> tuple[list[str], np.ndarray]:
    """Groups and their mean spectra, each cut at the bubble bands of the group that has most, less a parabola in each part."""
    rows = s.long().groupBy("group", "pos").agg(F.avg("value").alias("m")).orderBy("group", "pos").collect()  # groups x axis points
    groups = sorted({r["group"] for r in rows if r["group"] is not None})
    means = np.array([[r["m"] for r in rows if r["group"] == g] for g in groups], float)
    bands = [sorted(x for x in bubble_baseline(y, min_range)[1] if 3 < x[1] - x[0] < min_range) for y in means]
    cuts = sorted({a for a, _ in max(bands, key=len, default=[])} - {0})
    edges = [0, *cuts, means.shape[1]] if len(means) else []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 2:
            means[:, a:b] -= iterative_polyfit(means[:, a:b], 2)
    return groups, means


def correlations(s: Spectra, least: float = 0.8, by_average: bool = False, min_range: float = 30) -> DataFrame:
    """Pearson correlation of each axis point with the group's number, over spectra or over the groups' average spectra."""
    if by_average:
        groups, means = average_spectra(s, min_range)
        rows = [(g, p, float(s.axis[p]), float(v)) for g, y in zip(groups, means, strict=True) for p, v in enumerate(y)]
        long = s.df.sparkSession.createDataFrame(rows, "group string, pos int, wavenumber double, value double").withColumn("label", numeric_label(F.col("group")))
    else:
        long = s.long().withColumn("label", numeric_label(F.col("group")))
    return long.groupBy("pos", "wavenumber").agg(F.corr("value", "label").alias("r")).where(F.abs("r") > least)


def correlations_pairs(s: Spectra, least: float = 0.8) -> DataFrame:
    long = ratios(s, both=True).withColumn("label", numeric_label(F.col("group")))
    return long.groupBy("i", "j").agg(F.corr("value", "label").alias("r")).where(F.abs("r") > least)


def fold_key(seed: int, column: str = "spectrum_id") -> Column:
    """A shuffle order that any engine with MD5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


def balanced_folds(df: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    w = Window.partitionBy("group").orderBy(fold_key(seed), "spectrum_id")
    return df.select("spectrum_id", "group", ((F.row_number().over(w) - 1) % folds + 1).alias("fold"))


def mislabel_scores(df: DataFrame, probabilities: str = "probability", label: str = "label") -> DataFrame:
    """P(given label), the best other probability, and their difference; labels count from 0."""
    own = F.element_at(probabilities, F.col(label).cast("int") + 1)
    other = F.array_max(F.filter(probabilities, lambda p, i: i != F.col(label)))
    return df.select("spectrum_id", own.alias("p_alleged"), other.alias("p_others"), (own - other).alias("difference"))


def anova(s: Spectra) -> DataFrame:
    """One-way F statistic and p value (Bonferroni-adjusted too) of each axis point between groups."""
    g = s.long().groupBy("pos", "group").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    whole = Window.partitionBy("pos")
    g = g.withColumn("k", F.count("*").over(whole)).withColumn("all", F.sum("n").over(whole)).withColumn("grand", F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole))
    f = g.groupBy("pos", "k", "all").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    f = f.select("pos", "k", "all", F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("all") - F.col("k"))).alias("f_value"))
    p = F.pandas_udf(lambda v, k, n: v.combine(k, lambda a, b: (a, b)).combine(n, lambda ab, c: 1 - f_cdf(ab[0], ab[1] - 1, c - ab[1])).astype(float), "double")
    return f.select("pos", "f_value", p("f_value", "k", "all").alias("p_value")).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * len(s.axis)))


def kruskal(s: Spectra) -> DataFrame:
    """Kruskal-Wallis statistic with tie correction of each axis point."""
    long = s.long()
    counts = long.groupBy("pos", "value", "group").agg(F.count("*").alias("n"))
    values = counts.groupBy("pos", "value").agg(F.sum("n").alias("m"))
    below = Window.partitionBy("pos").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("rank", F.coalesce(F.sum("m").over(below), F.lit(0)) + (F.col("m") + 1) / 2)
    ties = values.groupBy("pos").agg(F.sum(F.pow("m", F.lit(3)) - F.col("m")).alias("t"), F.sum("m").alias("N"))
    g = counts.join(ranks, ["pos", "value"]).groupBy("pos", "group").agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n"))
    h = g.groupBy("pos").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.count("*").alias("k")).join(ties, "pos")
    stat = (12 / (F.col("N") * (F.col("N") + 1)) * F.col("q") - 3 * (F.col("N") + 1)) / (1 - F.col("t") / (F.pow("N", F.lit(3)) - F.col("N")))
    p = F.pandas_udf(lambda v, k: v.combine(k, lambda a, b: 1 - chi2_cdf(a, b - 1)).astype(float), "double")
    return h.select("pos", stat.alias("h_value"), p(stat, F.col("k")).alias("p_value"))


def rank_sums(s: Spectra) -> DataFrame:
    """(pos, group, r, n, t): sum of ascending mid-ranks, rows, and the sum of m^3 - m over the ties of the point."""
    counts = s.long().where("value IS NOT NULL").groupBy("pos", "value", "group").agg(F.count("*").alias("n"))
    values = counts.groupBy("pos", "value").agg(F.sum("n").alias("m"))
    below = Window.partitionBy("pos").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("rank", F.coalesce(F.sum("m").over(below), F.lit(0)) + (F.col("m") + 1) / 2)
    ties = values.groupBy("pos").agg(F.sum(F.pow("m", F.lit(3)) - F.col("m")).alias("t"))
    return counts.join(ranks, ["pos", "value"]).groupBy("pos", "group").agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n")).join(ties, "pos")


def _two_groups(n, m, v, rank, total, tie) -> tuple[float, float, float]:
    low = f_cdf(v[0] / v[1], n[0] - 1, n[1] - 1)
    variances = 2 * min(low, 1 - low)
    share = v / n
    if variances < 0.01:
        t, df = (m[0] - m[1]) / np.sqrt(share.sum()), share.sum() ** 2 / (share**2 / (n - 1)).sum()
    else:
        df = total - 2
        t = (m[0] - m[1]) / np.sqrt(((n - 1) * v).sum() / df * (1 / n).sum())
    w = rank[0] - n[0] * (n[0] + 1) / 2
    z = (w - n[0] * n[1] / 2) / np.sqrt(max(n[0] * n[1] * (total + 1) / 12 * tie, 1e-300))
    return variances, t_two_sided(float(t), float(df)), 2 * normal_cdf(-abs(float(z)))


def _many_groups(n, m, v, rank, total, tie) -> tuple[float, float, float]:
    k = len(n)
    pooled = ((n - 1) * v).sum() / (total - k)
    bartlett = ((total - k) * np.log(pooled) - ((n - 1) * np.log(v)).sum()) / (1 + ((1 / (n - 1)).sum() - 1 / (total - k)) / (3 * (k - 1)))
    variances = 1 - chi2_cdf(float(bartlett), k - 1)
    if variances < 0.01:
        w = n / v
        grand = (w * m).sum() / w.sum()
        excess = ((1 - w / w.sum()) ** 2 / (n - 1)).sum() / (k * k - 1)
        f, df = (w * (m - grand) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) * excess), 1 / (3 * excess)
    else:
        f, df = (n * (m - (n * m).sum() / total) ** 2).sum() / (k - 1) / pooled, total - k
    h = (12 / (total * (total + 1)) * (rank**2 / n).sum() - 3 * (total + 1)) / max(tie, 1e-300)
    return variances, 1 - f_cdf(float(f), k - 1, float(df)), 1 - chi2_cdf(float(h), k - 1)


def between_groups(s: Spectra, method: str = "bonferroni") -> DataFrame:
    """Tests of each axis point between groups, with p values adjusted over the points.

    Two groups: means, deviations, F test of variances, t test (Welch's where variances differ at 0.01) and Wilcoxon
    rank sums by the normal approximation. More: means, Bartlett's test, one-way test (Welch's likewise) and
    Kruskal-Wallis. Spark makes a row for each point and group; the tests themselves are few numbers on the driver.
    """
    g = s.long().where("value IS NOT NULL").groupBy("pos", "group").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    rows: dict[int, list] = {}
    for r in g.join(rank_sums(s), ["pos", "group"]).orderBy("pos", "group").collect():
        rows.setdefault(r["pos"], []).append(r)
    groups = sorted({r["group"] for x in rows.values() for r in x})
    if len(groups) < 2:
        raise ValueError("at least two groups are needed")
    names = ("var_test", "t_test", "wilcoxon_test") if len(groups) == 2 else ("var_test", "oneway_test", "kruskal_test")
    out = []
    for pos, x in sorted(rows.items()):
        n, m, v, rank = (np.array([float(r[c]) for r in x]) for c in ("n", "m", "v", "r"))
        total, tie = n.sum(), 1 - float(x[0]["t"]) / max(n.sum() ** 3 - n.sum(), 1.0)
        tests = (_two_groups if len(groups) == 2 else _many_groups)(n, m, v, rank, total, tie) if len(x) == len(groups) and n.min() > 1 and v.min() > 0 else (float("nan"),) * 3
        by = {r["group"]: r for r in x}
        spread = [float(by[k]["v"]) ** 0.5 if k in by and by[k]["v"] is not None else None for k in groups] if len(groups) == 2 else []
        out.append([pos, float(s.axis[pos]), *[float(by[k]["m"]) if k in by else None for k in groups], *spread, *map(float, tests)])
    for _ in range(2):  # the last two tests: each turn adds a column, so that -2 is the other one then
        p = [r[-2] for r in out]
        known = [k for k, value in enumerate(p) if value == value]
        fixed = dict(zip(known, adjust([p[k] for k in known], method), strict=True))
        for k, r in enumerate(out):
            r.append(fixed.get(k, float("nan")))
    columns = ["pos int", "wavenumber double", *[f"`mean_{k}` double" for k in groups], *([f"`sd_{k}` double" for k in groups] if len(groups) == 2 else []), *[f"{k} double" for k in names], *[f"{k}_adjusted double" for k in names[1:]]]
    return s.df.sparkSession.createDataFrame(out, ", ".join(columns))


def permutation_importance(s: Spectra, trees: int = 100, threshold: float = 0.002, seed: int = 42) -> DataFrame:
    """Loss of held-out accuracy when a column is shuffled, of a random forest over five folds' training part."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    folds = balanced_folds(s.df, 5, seed)
    data = s.df.select("spectrum_id", "group", F.col(s.stage).alias("y")).join(folds.select("spectrum_id", "fold"), "spectrum_id")
    data = StringIndexer(inputCol="group", outputCol="label", stringOrderType="alphabetAsc").fit(data).transform(data)
    model = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=5, cacheNodeIds=True).fit(data.where("fold > 1").withColumn("features", array_to_vector("y")))
    held = data.where("fold = 1").select("label", "y")
    n = len(s.axis)
    # A column is shuffled by giving each held-out row the value of the next in hash order, the last that of the first.
    placed = numbered(held.withColumn("__hash", F.md5(F.col("y").cast("string"))), ["__hash"], "__at")
    last = placed.agg(F.max("__at")).first()[0] or 0
    other = placed.select(F.pmod(F.col("__at") - 1, F.lit(last + 1)).alias("__at"), F.col("y").alias("__other"))
    placed = placed.join(other, "__at").drop("__at", "__hash")
    # Rows are dealt out evenly: the work is in the trees, and few rows would end up in one task.
    whole = lambda c: vector_to_array(array_to_vector(c)).alias(c)
    spark = s.df.sparkSession
    dealt = placed.select("label", whole("y"), whole("__other")).repartition(max(2, spark.sparkContext.defaultParallelism))
    scored = stored(permuted_hits(dealt, Trees.of(spark, model, model.numClasses), n))  # a row for each column
    base = scored.where("pos = -1").select(F.col("accuracy").alias("base"))
    axis = F.array(*[F.lit(w) for w in s.axis.tolist()])
    return scored.where("pos >= 0").crossJoin(F.broadcast(base)).select("pos", F.element_at(axis, F.col("pos") + 1).alias("wavenumber"), (F.col("base") - F.col("accuracy")).alias("importance")).where(F.col("importance") > threshold)


def rbcs(s: Spectra, trees: int = 1000, threshold: float = 0.002, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Importances above the threshold from the largest on, and (group, pos, wavenumber, mean) of these axis points."""
    found = stored(permutation_importance(s, trees, threshold, seed))
    means = s.long().join(F.broadcast(found.select("pos")), "pos", "left_semi").groupBy("group", "pos", "wavenumber").agg(F.avg("value").alias("mean"))
    return found.orderBy(F.desc("importance"), "pos"), means


def dapc(s: Spectra, n_pc: int = 20, top: int = 100) -> DataFrame:
    """Axis points that weigh most in each group's one-vs-rest discriminant, back-projected from components."""
    n, m, c = moments(s.df, s.stage)
    d = np.sqrt(np.diag(c))
    w, v = components(c / np.outer(d, d), min(n_pc, len(d)))
    groups = s.long().groupBy("group", "pos").agg(F.avg("value").alias("m"), F.count("*").alias("n")).orderBy("group", "pos").collect()
    rows = []
    for g in sorted({r["group"] for r in groups}):
        own = np.array([r["m"] for r in groups if r["group"] == g])
        share = next(r["n"] for r in groups if r["group"] == g) / n
        diff = ((own - m) / d @ v) / max(1 - share, 1e-12)  # own mean minus the others' mean
        within = np.diag(w) - np.outer(diff, diff) * share * (1 - share)
        weight = v @ np.linalg.solve(within + 1e-9 * np.eye(len(w)), diff)
        for p in np.argsort(-np.abs(weight), kind="stable")[:top]:
            rows.append((g, int(p), float(s.axis[p]), float(weight[p])))
    return s.df.sparkSession.createDataFrame(rows, "group string, pos int, wavenumber double, importance double")
