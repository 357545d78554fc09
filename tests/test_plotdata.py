import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.operators import markers, models, plotdata, reduction
from prismfold.sources import reports
from prismfold.sources.sample import sample
from prismfold.spectra import Spectra


@pytest.mark.parametrize("seed", range(4))
def test_merged_groups(seed):
    rng = np.random.default_rng(seed)
    groups = [rng.uniform(0, 400, rng.integers(1, 4)).tolist() for _ in range(30)]
    out = plotdata.merge_groups(groups, 20)
    assert [v for g in out for v in g] == [v for g in groups for v in g]
    near = lambda a, b: min(abs(x - y) for x in a for y in b) <= 20
    assert not any(near(a, b) for a, b in zip(out, out[1:]))
    # Neighbours that are near from the start are together.
    of = {id(g): next(k for k, o in enumerate(out) if g[0] in o) for g in groups}
    assert all(of[id(a)] == of[id(b)] for a, b in zip(groups, groups[1:]) if near(a, b))


def test_merged_groups_of_chains_and_none():
    assert plotdata.merge_groups([], 20) == [] and plotdata.merge_groups([[5.0]], 20) == [[5.0]]
    assert plotdata.merge_groups([[100.0], [300.0], [], [290.0, 110.0]], 20) == [[100.0, 300.0, 290.0, 110.0]]


def test_link_colours(spark):
    df = spark.createDataFrame([(-1.0,), (-0.6,), (0.0,), (0.6,), (1.0,)], "r double")
    got = [r[0] for r in df.select(plotdata.link_colour(F.col("r"), 0.6)).collect()]
    assert got == ["#0033FF", "#66CCFF", None, "#FF6666", "#FF3300"]
    with pytest.raises(ValueError):
        plotdata.chord_links(None, sign="sideways")


def test_hulls(spark):
    rng = np.random.default_rng(3)
    rows = [(f"G{i % 2}", f"C{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (300, 2)))]
    rows += [("G0", "C0", 0.0, 0.0)] * 3 + [("G9", "C9", 1.0, 2.0), (None, "C9", 3.0, 4.0), ("G9", "C9", None, 1.0)]
    got = plotdata.hulls(spark.createDataFrame(rows, "panel string, cluster string, x double, y double").repartition(5)).collect()
    for key in {r[:2] for r in rows}:
        pts = np.array([r[2:] for r in rows if r[:2] == key and r[2] is not None])
        corners = np.array([(r["x"], r["y"]) for r in sorted((r for r in got if (r["panel"], r["cluster"]) == key), key=lambda r: r["corner"])])
        if len(pts) > 2:
            edge = np.roll(corners, -1, axis=0) - corners
            cross = edge[:, 0, None] * (pts[:, 1] - corners[:, 1, None]) - edge[:, 1, None] * (pts[:, 0] - corners[:, 0, None])
            assert (cross >= -1e-12).all() and {tuple(c) for c in corners} <= {tuple(p) for p in pts}
        else:
            assert corners.tolist() == pts.tolist()


@pytest.mark.parametrize("metric", reduction.METRICS)
def test_distances_by_definition(metric):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (12, 6)).astype(float)
    x[3] = x[4] = 0
    d = reduction.metric_distances(x, metric, power=3)
    for a, p in enumerate(x):
        for b, q in enumerate(x):
            gap, used = np.abs(p - q), (p != 0) | (q != 0)
            terms = [abs(u - v) / (abs(u) + abs(v)) for u, v in zip(p, q) if abs(u) + abs(v)]
            want = {
                "euclidean": np.sqrt((gap**2).sum()), "maximum": gap.max(), "manhattan": gap.sum(), "minkowski": (gap**3).sum() ** (1 / 3),
                "canberra": np.mean(terms) * 6 if terms else 0, "binary": ((p != 0) != (q != 0)).sum() / max(1, used.sum()),
            }[metric]
            assert abs(d[a, b] - (want if a != b else 0)) < 1e-12


def test_principal_coordinates(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (30, 5)) * [5, 3, 1, 1, 1]
    s = Spectra.of(spark.createDataFrame([(i * 7, "G", v.tolist()) for i, v in enumerate(x)], "spectrum_id long, group string, raw_data array<double>"), range(5))
    pairs = {}
    for metric in ("euclidean", "minkowski"):  # the same with power 2, by two ways
        df = reduction.pcoa(s, 2, None, metric).df
        y = np.array([r["PCoA"] for r in df.orderBy("spectrum_id").collect()])
        pairs[metric] = np.linalg.norm(y[:, None] - y[None], axis=2)
    assert np.allclose(pairs["euclidean"], pairs["minkowski"])
    whole = reduction.classical_scaling(reduction.metric_distances(x, "euclidean"), 5)
    assert np.allclose(np.linalg.norm(whole[:, None] - whole[None], axis=2), reduction.metric_distances(x, "euclidean"))
    with pytest.raises(ValueError):
        reduction.pcoa(s, distance="other")


def test_umap_curve():
    a, b = reduction.umap_curve(0.1, 1.0)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01  # the known values for these
    assert reduction.umap_curve(0.5, 1.0)[0] < a


def test_forest_and_reports(spark, tmp_path):
    s = sample(spark, 120, 3, 40)
    assert [r[1] for r in s.df.groupBy("group").count().orderBy("group").collect()] == [40, 40, 40]
    again = sample(spark, 120, 3, 40).df.where("spectrum_id = 5").first()
    assert again["raw_data"] == s.df.repartition(3).where("spectrum_id = 5").first()["raw_data"]
    votes = models.forest_out_of_bag(s, 30, 6).cache()
    rows = votes.collect()
    assert len(rows) == 120 and all(r["probability"] is None or abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)
    # A row gets the trees of the bags that left it out, five each.
    assert all(r["votes"] is None or abs(sum(r["votes"]) % 5) < 1e-6 or abs(sum(r["votes"]) % 5 - 5) < 1e-6 for r in rows)
    known = [r for r in rows if r["prediction"] is not None]
    assert all((r["votes"] is None) == (r["prediction"] is None) for r in rows)
    assert len(known) > 100 and np.mean([r["group"] == r["prediction"] for r in known]) > 0.9
    # Labels without meaning are not learnt: the votes are not those of trees that saw the row.
    mixed = s.write(s.stage, s.df.withColumn("group", F.concat(F.lit("L"), F.pmod(F.xxhash64("spectrum_id"), F.lit(2)).cast("string"))))
    noise = models.forest_out_of_bag(mixed, 20, 5).where("prediction IS NOT NULL").agg(F.avg((F.col("group") == F.col("prediction")).cast("int"))).first()[0]
    assert noise < 0.7
    found, means = markers.rbcs(s, 20, 0.0)
    n = found.count()
    assert 0 < n == means.count() / 3
    reports.save_forest(votes, found, ["T0", "T1", "T2"], str(tmp_path), 30)
    reports.save_importances(found, str(tmp_path), 0.01)
    read = lambda name: spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/{name}")
    assert read("cv_probabilities").columns == ["SampleID", "T0", "T1", "T2"] and read("mislabeling").count() == 120
    assert {r["item"]: r["value"] for r in read("summary").collect()}["Number of trees"] == "30"
    top = [float(r[1]) for r in read("All_sorted").collect()]
    assert top == sorted(top, reverse=True) and len(top) == n and read("cutoff_sorted").count() == sum(t > 0.01 for t in top)
    cells = read("confusion_matrix").collect()
    assert sum(int(r[c]) for r in cells for c in ("T0", "T1", "T2") if c in r.asDict()) == len(known)
