"""Steps that once took a bounded number of rows, or held all rows in one place."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.operators import cluster, markers, quality, reduction
from prismfold.sources import files
from prismfold.spectra import Spectra, stored


def collection(spark, x, group=lambda i: f"G{i % 3}"):
    rows = [(i, group(i), v) for i, v in enumerate(x.tolist())]
    return Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>").repartition(3), range(x.shape[1]))


def test_distances_of_any_number(spark):
    x = np.random.default_rng(1).normal(0, 1, (5_100, 2))
    got = cluster.distances(collection(spark, x)).agg(F.count("*"), F.sum("distance"), F.min(F.col("b") - F.col("a"))).first()
    want = sum(float(np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(1)).sum()) for i in range(len(x)))
    assert got[0] == len(x) * (len(x) - 1) // 2 and got[1] == pytest.approx(want) and got[2] == 1


def test_distances_of_missing_points(spark):
    rows = [(i, "G", v) for i, v in enumerate([[1.0, 2.0], None, [1.0, None], [4.0, 6.0], [float("nan"), 1.0]])]
    s = Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>"), range(2))
    got = {(r[0], r[1]): r[2] for r in cluster.distances(s).collect()}
    assert len(got) == 10 and got[0, 3] == 5 and np.isnan(got[0, 4]) and [k for k, v in got.items() if v is None] and all((v is None) == (1 in k or 2 in k) for k, v in got.items())


def test_neighbours_without_broadcast(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all vectors in one place")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    x = np.random.default_rng(2).integers(-2, 3, (700, 3)).astype(float)  # many ties
    x[5] = 0
    got = cluster.nearest_pairs(collection(spark, x).df, "raw_data", 7).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sim, -np.inf)
    near = np.argsort(-sim, axis=1, kind="stable")[:, :7]
    assert sorted((r[0], r[3], r[1]) for r in got) == [(i, k + 1, int(near[i, k])) for i in range(700) for k in range(7)]
    assert all(abs(r[2] - sim[r[0], r[1]]) < 1e-9 for r in got)


def test_fewer_vectors_than_neighbours(spark):
    got = cluster.nearest_pairs(collection(spark, np.eye(4) + 0.5).df, "raw_data", 30).collect()
    assert len(got) == 12 and {r[3] for r in got} == {1, 2, 3}


def test_tree_of_any_number(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(9, 0.01, (60, 4)), np.ones((20, 4))])  # scattered, close together, copies
    s = collection(spark, x)
    form = lambda df: [(r["left"], r["right"], round(r["height"], 8), r["size"]) for r in df.orderBy("step").collect()]
    whole, rounds = form(cluster.hca(s)), form(cluster.hca(s, 15))
    assert len(rounds) == len(x) - 1 and sorted(rounds) == sorted(whole) and [r[2] for r in rounds] == sorted(r[2] for r in rounds)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    parts = {i: [i] for i in range(len(x))}
    for a, b, height, size in rounds:  # each merge by definition
        assert abs(d[np.ix_(parts[a], parts[b])].mean() - height) < 1e-6
        parts[a] += parts.pop(b)
        assert len(parts[a]) == size


def test_tree_beyond_the_old_bound(spark):
    x = np.random.default_rng(4).normal(0, 1, (5_200, 2))
    assert cluster.hca(collection(spark, x)).agg(F.count("*"), F.max("size")).first()[:] == (5_199, 5_200)


def test_paired_ranks_are_no_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (300, 19)).astype(float)  # ties, zeros, more than two strips
    rows = [(i, None if i % 7 == 0 else f"G{i % 3}", v) for i, v in enumerate(x.tolist())]
    rows[3][2][4] = None
    rows[4][2][5] = float("nan")
    rows.append((300, "G0", None))
    s = Spectra.of(spark.createDataFrame(rows, "spectrum_id long, group string, raw_data array<double>").repartition(3), range(19))
    want = markers.auc_by_rank(markers.ratios(s).where("value IS NOT NULL"), ["i", "j"])
    got = markers.pair_aucs(s)
    form = lambda df: sorted((r["i"], r["j"], str(r["group"]), round(r["auc"], 12)) for r in df.collect())
    assert form(got) == form(want) and len(form(got)) == 19 * 18 // 2 * 4
    assert "inline" not in markers.roc_pairs(s)._jdf.queryExecution().toString()  # one row for each spectrum and pair


@pytest.mark.parametrize("metric", ["manhattan", "canberra"])
def test_principal_coordinates_without_their_matrix(spark, metric):
    x = np.random.default_rng(6).normal(0, 1, (400, 6)) * [5, 4, 2, 1, 1, 1]
    want = reduction.classical_scaling(reduction.metric_distances(x, metric), 3)
    assert np.allclose(reduction.distributed_scaling(spark, x, 3, metric), want, atol=1e-6)


def test_principal_coordinates_beyond_the_old_bound(spark):
    x = np.random.default_rng(7).normal(0, 1, (5_100, 2)) * [3, 1]
    out = reduction.pcoa(collection(spark, x), 1, None, "manhattan").df.selectExpr("PCoA[0] AS p", "raw_data[0] AS x").agg(F.count("p"), F.corr("p", "x")).first()
    assert out[0] == 5_100 and abs(out[1]) > 0.9


def test_communities_without_broadcast(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all vectors in one place")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.3, (60, 6)) + 4 * np.eye(6)[g] for g in range(3)])
    rows = cluster.louvain_clusters(collection(spark, x), (0.5,), 6, 10).orderBy("spectrum_id").collect()
    of = [r[1] for r in rows]
    assert [r[0] for r in rows] == list(range(180)) and of[0] == 0 and len({(i // 60, c) for i, c in enumerate(of)}) == len(set(of)) >= 3


def test_graph_adds_up_equal_edges():
    starts, to, w = cluster._graph(np.array([0, 1, 2, 2]), np.array([1, 0, 2, 0]), np.array([1.0, 2.0, 5.0, 4.0]), 3)
    assert starts.tolist() == [0, 2, 3, 5] and to.tolist() == [1, 2, 0, 0, 2] and w.tolist() == [3, 4, 3, 4, 5]


def test_distance_looks_at_rows_once_cut_no_more(spark, monkeypatch):
    x = np.random.default_rng(9).normal(0, 0.4, (200, 8))
    s = collection(spark, x)
    kept, gone = np.ones(len(x), bool), 1.0
    for _ in range(200):  # by definition, on the whole matrix
        centre = x[kept].mean(0)
        d = np.linalg.norm(x - centre, axis=1)
        if d[kept].max() <= 1:
            break
        limit = max(np.percentile(d[kept], 90), 1) * gone
        gone = gone * 0.95 if d[kept].max() <= limit else 1.0
        kept &= ~(d > max(limit, 1))
    stores = []
    monkeypatch.setattr(quality, "stored", lambda df: stores.append(1) or stored(df))
    rows = quality.distance(s).orderBy("spectrum_id").collect()
    assert [r["quality"] for r in rows] == kept.tolist() and np.allclose([r["distance"] for r in rows], d) and len(stores) == 1


def test_lines_in_pieces():
    text = "äöü\r\n\nlong line " + "x" * 40 + "\n1\t2\x0b3\nlast"
    for size in (1, 3, 10, 1000):
        assert list(files.lines_of(text, size)) == list(files.lines_of(memoryview(text.encode()), size)) == text.splitlines()


def test_coordinate_files_make_no_objects_for_each_number():
    lines = "".join(f"{k}\t7\t{w}\t{k + w}\n" for k in range(2_000) for w in range(500, 564))
    tracemalloc.start()
    kind, found, skipped = files.parse("x\ty\twave\tvalue\n" + lines)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (kind, len(found), skipped) == ("coordinates", 2_000, 0) and found[5][0] == "5_7" and found[5][2].tolist() == [5 + w for w in range(500, 564)]
    assert most < 128 * len(lines.splitlines())  # 369 bytes a line before
    again = files.parse("1\t500\t1\n2\t500\t5\n1\t501\t2\n1\t500\t3\n")[1]  # a spectrum's lines apart, and one twice
    assert [(k, v.tolist()) for k, _, v in again][0] == ("1", [3, 2]) and again[1][0] == "2" and again[1][2][0] == 5
