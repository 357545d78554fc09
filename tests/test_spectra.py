import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.functions import distributions as dist
from prismfold.operators import cluster, correlation, decompose, markers, models, preprocess, quality, reduction, stats
from prismfold.sources import files
from prismfold.spectra import Spectra

AXIS = np.arange(500, 3150, 30.0)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(40):
        g = i % 2
        y = 2 + 1e-4 * AXIS + np.exp(-((AXIS - 1450) ** 2) / 5000) * (1 + g) + np.exp(-((AXIS - 2900) ** 2) / 8000) + rng.normal(0, 0.01, len(AXIS))
        rows.append((i, f"G{g}", f"run_c{i}", y.tolist()))
    return Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, filename string, raw_data array<double>").repartition(3), AXIS)


def matrix(df, c):
    return np.array([r[c] for r in df.orderBy("spectrum_id").collect()])


def test_smoothing_keeps_polynomials_and_ends(spark):
    y = (AXIS / 1000) ** 3
    s = preprocess.smooth(Spectra.of(spark.createDataFrame([(0, "G", y.tolist())], "spectrum_id long, group string, raw_data array<double>"), AXIS))
    assert np.allclose(matrix(s.df, "smooth_data")[0], y)


def test_snv_and_normalisation(made):
    x = matrix(made.df, "raw_data")
    z = matrix(preprocess.snv(made).df, "smooth_data")
    assert np.allclose(z, (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))
    assert np.allclose(matrix(preprocess.normalize(made, "area").df, "normalized_data").sum(1), 1)
    with pytest.raises(ValueError):
        preprocess.normalize(made, "other")


def test_baseline_lies_near_zero_between_peaks(made):
    s = preprocess.baseline_polyfit(made)
    flat = matrix(s.df, s.stage)[:, (s.axis > 1900) & (s.axis < 2500)]
    assert np.abs(flat).max() < 0.1
    assert preprocess.bubble_baseline(np.arange(50.0), 10)[0].max() <= 49


def test_stage_rules(made):
    s = preprocess.cutoff(preprocess.snv(made), 1000, 2000)
    assert s.stage == "smooth_data" and len(s.axes["raw_data"]) == len(AXIS) and s.axis.min() > 1000
    assert len(made[F.col("group") == "G1", (600, 900)].axis) == 10
    with pytest.raises(KeyError):
        made["nothing"]


def test_background_and_spikes(spark, made):
    named = made.write(made.stage, made.df.withColumn("filename", F.when(F.col("spectrum_id") < 4, "run_BG").otherwise(F.col("filename"))))
    out = preprocess.remove_background(named, 2)
    x = matrix(made.df, "raw_data")
    assert np.allclose(matrix(out.df, "background_data"), x[4:] - x[:4].mean(0))
    bumped = x.copy()
    bumped[20, 40] += 100
    rows = [(i, "G", r.tolist()) for i, r in enumerate(bumped)]
    s = preprocess.remove_spikes(Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>"), AXIS), block=8)
    fixed = matrix(s.df, "spike_data")
    n, p = bumped.shape
    pad = np.pad(bumped, ((1, 1), (5, 5)), mode="edge")
    want, hits = bumped.copy(), 0
    for i in range(n):
        near = [i + 1, i + 2, i + 3] if i < 3 else [i - 3, i - 2, i - 1] if i >= n - 3 else [i - 3, i - 2, i - 1, i + 1, i + 2, i + 3]
        for j in range(p):
            if 34 * bumped[i, j] - pad[i : i + 3, j : j + 11].sum() > 10 * bumped[i].max():
                first, hits = min(max(j - 1, 0), p - 3), hits + 1
                want[i, first : first + 3] = bumped[near][:, first : first + 3].mean(0)
    assert hits and not np.allclose(want[20, 40], bumped[20, 40]) and np.allclose(fixed, want)


def test_auc_and_folds(made):
    auc = {(r["pos"], r["group"]): r["auc"] for r in markers.roc(made, threshold=-1).collect()}
    p = int(np.argmin(np.abs(AXIS - 1450)))
    assert auc[p, "G0"] == 1.0 and auc[p, "G1"] == 0.0  # above a half: the group is lower
    folds = markers.balanced_folds(made.df, 5).groupBy("group", "fold").count().collect()
    assert {r["count"] for r in folds} == {4}


def test_components_and_models(made):
    x = matrix(made.df, "raw_data")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    scores = matrix(reduction.pca(made, 3).df, "PCA")
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    train, test = models.split(made)
    out = models.predict(models.lda(train, 3), test)
    assert out.where("group <> prediction").count() == 0
    out = models.predict(models.pls(train, 2), test).select("group", "prediction").collect()
    assert all(abs(r["prediction"] - int(r["group"][1])) < 0.3 for r in out)
    assert len({models.mlr(train, 3).kind, models.glm(train, 3).kind}) == 2


def test_quality(made):
    assert quality.first_copies(made).where("quality").count() == 40
    far = made.write(made.stage, made.df.withColumn("raw_data", F.when(F.col("spectrum_id") == 3, F.transform("raw_data", lambda v: v * 5)).otherwise(F.col("raw_data"))))
    out = {r["spectrum_id"]: r["quality"] for r in quality.distance(far, most=5).collect()}
    assert not out[3] and sum(out.values()) == 39
    assert not {r["spectrum_id"]: r["quality"] for r in quality.t2(far).collect()}[3]
    assert quality.icod(made).count() == 40


def test_decompositions(made):
    w, h, errors = decompose.nmf(made, 2, max_iter=15)
    assert errors[-1] < errors[0] and h.min() >= 0
    c, spectra = decompose.mcr_als(made, 2, rounds=5)
    assert np.allclose(matrix(c, "concentration").sum(1), 1) and np.allclose(np.linalg.norm(spectra, axis=1), 1)


def test_clusters(made):
    tree = cluster.hca(made).orderBy("step").collect()
    assert len(tree) == 39 and tree[-1]["size"] == 40
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 0.1)]
    of = cluster.louvain(edges, [*range(5), *range(10, 15)])
    assert len(set(of.values())) == 2 and of[0] == of[4] != of[10]


def test_files(spark, tmp_path):
    x = np.arange(500, 560, 5.0)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("\n".join(f"{w}\t{w * 2}" for w in x))
    (tmp_path / "many.txt").write_text("\n".join(f"{w}\t{w}\t{w + 1}\t{w + 2}" for w in x))
    (tmp_path / "map.txt").write_text("\n".join(f"{k}\t0\t{w}\t{w + k}" for k in (1, 2) for w in x[::-1]))
    (tmp_path / "row.txt").write_text("\t".join(map(str, x)) + "\n" + "\t".join(map(str, x * 3)))
    (tmp_path / "metadata.txt").write_text("no\tdata")
    got = files.read_spectra(spark, str(tmp_path), cutoff=(500, 550))
    rows = {(r["filename"].rsplit("/", 1)[1], r["spectrum"]): r for r in got.collect()}
    assert len(rows) == 1 + 3 + 2 + 1
    assert rows["one.txt", ""]["y"][0] == 1000 and rows["map.txt", "2_0"]["y"][0] == 502 and rows["row.txt", ""]["y"][1] == 1515
    assert max(rows["one.txt", ""]["axis"]) == 550
    assert np.allclose(files.natural_spline(x, 3 * x, x[:-1] + 1), 3 * (x[:-1] + 1))
    names = files.strip_common(spark.createDataFrame([("run_a.txt",), ("run_b.txt",)], "filename string"))
    assert {r["short"] for r in names.collect()} == {"a", "b"}


def test_distributions():
    assert abs(dist.f_quantile(0.95, 1, 126) - 3.9163) < 1e-4
    assert abs(dist.chi2_quantile(0.95, 5) - 11.0705) < 1e-4
    assert abs(dist.t_two_sided(2.228139, 10) - 0.05) < 1e-6


def test_stream(spark, tmp_path, made):
    from prismfold.streaming import score

    made.df.write.parquet(str(tmp_path / "in"))
    out = score.score(score.read_stream(spark, str(tmp_path / "in"), made.df.schema), AXIS, [preprocess.snv])
    q = out.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM scored").count() == 40


@pytest.mark.parametrize(("rows", "gap"), [(300, 1), (1700, 1), (4500, 10**6)])
def test_two_dimensional_takes_all_pairs(spark, rows, gap):
    rng = np.random.default_rng(8)
    ids = np.cumsum(rng.integers(1, gap + 1, rows)).tolist()
    x = rng.normal(size=(rows, 4)).cumsum(axis=0) * 0.1 + rng.normal(size=(rows, 4))
    frame = spark.createDataFrame([(i, "a", v.tolist()) for i, v in zip(ids, x, strict=True)], "spectrum_id long, group string, raw_data array<double>").repartition(5)
    apart = np.arange(rows)[None, :] - np.arange(rows)[:, None]
    noda = np.where(apart == 0, 0.0, 1 / (np.pi * np.where(apart == 0, 1, apart)))
    want = (x - x.mean(0)).T @ noda @ (x - x.mean(0)) / (rows - 1)
    got = correlation.two_dimensional(Spectra.of(frame, range(4))).collect()
    assert len(got) == 16 and all(abs(r["asynchronous"] - want[r["i"], r["j"]]) < 1e-11 for r in got)


@pytest.mark.parametrize("rows", [900, 21_000])
def test_mcd_takes_all_rows(spark, rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, 6)) * [5, 4, 3, 2, 1, 0.5] + (rng.random(rows) < 0.2)[:, None] * 6
    frame = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "spectrum_id long, group string, raw_data array<double>").repartition(3)
    s = Spectra.of(frame, range(6))
    scored = reduction.pca(s, 6).df.select("spectrum_id", F.slice("PCA", 1, 5).alias("x"))
    first = [r["spectrum_id"] for r in scored.orderBy(F.xxhash64("spectrum_id")).limit(60).collect()]
    z = matrix(scored, "x")
    far = lambda m, c: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
    best = (np.inf,)
    for k in range(10):
        use = first[6 * k : 6 * k + 6]
        for _ in range(30):
            use = np.argsort(far(z[use].mean(0), np.cov(z[use].T) + 1e-9 * np.eye(5)), kind="stable")[: int(np.ceil(0.6 * rows))]
            best = min(best, (np.linalg.det(np.cov(z[use].T)), z[use].mean(0), np.cov(z[use].T)), key=lambda b: b[0])
    d = far(*best[1:])
    inside = z[d / np.median(d) * dist.chi2_quantile(0.5, 5) <= dist.chi2_quantile(0.95, 5)]
    assert np.allclose(matrix(quality.mcd(s), "distance"), far(inside.mean(0), np.cov(inside.T)), rtol=1e-6)


def test_natural_spline_solves_its_system():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.5, 2, 30))
    y = np.sin(x)
    assert np.allclose(files.natural_spline(x, y, x), y)
    h = np.diff(x)
    a = np.eye(30)
    b = np.zeros(30)
    for i in range(1, 29):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    at = (x[1:] + x[:-1]) / 2
    want = (y[1:] + y[:-1]) / 2 - h**2 * (m[1:] + m[:-1]) / 16
    assert np.allclose(files.natural_spline(x, y, at), want)
    assert np.allclose(files.natural_spline(x[:2], y[:2], np.array([x[0] - 1])), y[0] - (y[1] - y[0]) / h[0])


def test_fields_keep_empty_places():
    assert files.fields("1,,2") == ["1", "", "2"] and files.fields("1 \t 2") == ["1", "2"] and files.fields(" 1   2 ") == ["1", "2"]
    orient, found, skipped = files.parse("wave,a,b\n" + "\n".join(f"{500 + 10 * i},{i},{i * i}" for i in range(8)) + "\nbroken,line,\n")
    assert orient == "column" and skipped == 1 and [k for k, _, _ in found] == ["1", "2"] and found[1][2][3] == 9


def test_read_collection(spark, tmp_path):
    axis, shifted = np.arange(600, 700, 10.0), np.arange(602, 702, 10.0)
    for name, x, k in (("a_1", axis, 1), ("a_2", axis, 2), ("b_1", shifted, 3)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{w}\t{k * 100 + i}" for i, w in enumerate(x)))
    (tmp_path / "notes.txt").write_text("nothing here\n")
    s = files.read_collection(spark, str(tmp_path), group_splits="/|_|[.]")
    rows = s.df.orderBy("spectrum_id").collect()
    assert [r["spectrum_id"] for r in rows] == [0, 1, 2] and [r["filename"] for r in rows] == ["a_1.txt", "a_2.txt", "b_1.txt"]
    assert [r["group"] for r in rows] == ["a", "a", "b"] and [r["batch"] for r in rows] == ["Batch_1", "Batch_1", "Batch_2"]
    assert s.axis.tolist() == axis.tolist() and rows[1]["raw_data"] == [200.0 + i for i in range(10)]
    (tmp_path / "c_1.txt").write_text("\n".join(f"{w}\t1" for w in axis[:-2]))
    two = files.read_collection(spark, str(tmp_path), group_splits="/|_|[.]", group_levels=("a",))
    assert {n: len(x) for n, x in two.items()} == {8: 1, 10: 3} and two[8].df.first()["group"] is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_collection(spark, str(tmp_path / "empty"))


def test_spikes_by_order_whatever_the_ids(spark):
    rng = np.random.default_rng(3)
    x = 2 + rng.normal(0, 0.01, (30, 40))
    x[7, 20] += 100
    schema = "spectrum_id long, group string, raw_data array<double>"
    dense, sparse = ([(i * i * k + 5 * k, "G", r.tolist()) if k > 1 else (i, "G", r.tolist()) for i, r in enumerate(x)] for k in (1, 1009))
    a, b = (matrix(preprocess.remove_spikes(Spectra.of(spark.createDataFrame(r, schema).repartition(4), np.arange(40) * 10 + 500.0), block=8).df, "spike_data") for r in (dense, sparse))
    assert np.allclose(a, b) and a.max() < 3


def test_arcs_lie_under_the_curve():
    y = np.sin(np.arange(80) / 9) * 5 + np.arange(80) / 20
    for where in ("inside", "start", "end"):
        arc, touch = preprocess.arc_under(y, where)
        assert (arc <= y + 1e-9).all() and np.isclose(arc[touch], y[touch])
    base, ranges = preprocess.bubble_baseline(y, 20)
    assert (base <= y).all() and all(b - a >= 1 for a, b in ranges)
    falling = preprocess.bubble_baseline(-np.arange(60.0) ** 2, 10)  # touches at an end, and goes on one point shorter
    assert (0, 59) in falling[1] or (1, 60) in falling[1]


def test_fit_below_equals_rows_alone():
    rng = np.random.default_rng(5)
    x = np.linspace(500, 1790, 60)
    y = rng.normal(0, 1, (25, 60)) + np.where(np.abs(x - 1000) < 60, 8, 0) + x / 300
    y[3, :5] = np.nan
    y[4] = np.nan
    got = preprocess.fit_below(y, x, 1)
    for row, have in zip(y, got, strict=True):
        use, base = np.isfinite(row), np.full(60, np.nan)
        while use.sum() > 1:
            base = np.polyval(np.polyfit(x[use], row[use], 1), x)
            then = np.isfinite(row) & (row < base)
            if then.sum() < 6 or (then == use).all():
                break
            use = then
        assert np.allclose(have, base, equal_nan=True)


def test_group_tests(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (12, 5)), rng.normal(0.8, [1, 1, 1, 4, 6], (15, 5))
    rows = [(i, g, r.tolist()) for i, (g, r) in enumerate([("a", r) for r in x] + [("b", r) for r in y])]
    s = Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>"), np.arange(5.0))
    out = markers.between_groups(s, "BH").orderBy("pos").collect()
    for j, r in enumerate(out):
        a, b = x[:, j], y[:, j]
        assert np.allclose([r["mean_a"], r["mean_b"], r["sd_a"], r["sd_b"]], [a.mean(), b.mean(), a.std(ddof=1), b.std(ddof=1)])
        u = (a[:, None] > b[None, :]).sum()
        z = (u - 90) / np.sqrt(12 * 15 * 28 / 12)
        assert np.isclose(r["wilcoxon_test"], 2 * dist.normal_cdf(-abs(z)))
        if r["var_test"] < 0.01:
            v = a.var(ddof=1) / 12, b.var(ddof=1) / 15
            t, df = (a.mean() - b.mean()) / np.sqrt(sum(v)), sum(v) ** 2 / (v[0] ** 2 / 11 + v[1] ** 2 / 14)
        else:
            df = 25
            t = (a.mean() - b.mean()) / np.sqrt((11 * a.var(ddof=1) + 14 * b.var(ddof=1)) / 25 * (1 / 12 + 1 / 15))
        assert np.isclose(r["t_test"], dist.t_two_sided(t, df))
    assert any(r["var_test"] < 0.01 for r in out) and np.allclose([r["t_test_adjusted"] for r in out], dist.adjust([r["t_test"] for r in out], "BH"))
    three = s.write(s.stage, s.df.withColumn("group", F.when(F.col("spectrum_id") % 3 == 0, "c").otherwise(F.col("group"))))
    assert {"mean_c", "kruskal_test_adjusted"} <= set(markers.between_groups(three).columns)
    with pytest.raises(ValueError):
        markers.between_groups(s[F.col("group") == "a"])


def test_adjusted_p_values():
    p = [0.04, 0.01, 0.02, 0.9]
    assert np.allclose(dist.adjust(p, "holm"), [0.08, 0.04, 0.06, 0.9]) and np.allclose(dist.adjust(p, "BH"), [0.16 / 3, 0.04, 0.04, 0.9])
    assert np.allclose(dist.adjust(p, "hochberg"), [0.08, 0.04, 0.06, 0.9]) and np.allclose(dist.adjust(p), [0.16, 0.04, 0.08, 1])
    # Hommel by the closure of Simes tests over all sets.
    from itertools import combinations

    simes = lambda q: min(len(q) * v / (k + 1) for k, v in enumerate(sorted(q)))
    for p in ([0.04, 0.01, 0.02, 0.9], [0.03, 0.031, 0.032, 0.5, 0.011]):
        want = [max(simes([p[i] for i in c]) for m in range(1, len(p) + 1) for c in combinations(range(len(p)), m) if k in c) for k in range(len(p))]
        assert np.allclose(dist.adjust(p, "hommel"), want)


def test_mixture_of_one(spark):
    x = np.random.default_rng(2).normal(0, 1, (120, 6))
    s = Spectra.of(spark.createDataFrame([(i, "G", r.tolist()) for i, r in enumerate(x)], "spectrum_id long, group string, raw_data array<double>"), np.arange(6.0))
    assert cluster.gmm(s, [1])[1] == 1 and cluster.gmm(s, [1, 2], n_pc=4)[1] == 1


def test_nmf_stores_its_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.random((40, 2)) @ rng.random((2, 12))
    s = Spectra.of(spark.createDataFrame([(i, "G", r.tolist()) for i, r in enumerate(x)], "spectrum_id long, group string, raw_data array<double>"), np.arange(12.0))
    (a, ha, ea), (b, hb, eb) = decompose.nmf(s, max_iter=12, keep=5), decompose.nmf(s, max_iter=12, keep=100)
    assert np.allclose(ea, eb) and np.allclose(ha, hb) and np.allclose(matrix(a, "W"), matrix(b, "W"))
    assert all(p >= q - 1e-9 for p, q in zip(ea, ea[1:]))
