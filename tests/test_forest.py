"""Forests as arrays hold to Spark's own model, and rows are not copied for each column."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from prismfold.operators import forest, markers, models
from prismfold.operators.forest import Trees
from prismfold.spectra import Spectra, stored


def labelled(spark, m, n, k, whole=False, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, k, m)
    x = rng.normal(0, 1, (m, n))
    x[:, 1] += label
    x = np.round(x) if whole else x
    return x, label, spark.createDataFrame([(i, f"G{c}", float(c), v) for i, (c, v) in enumerate(zip(label, x.tolist()))], "spectrum_id long, group string, label double, y array<double>")


def judged(spark, model, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, y array<double>").withColumn("features", array_to_vector("y"))
    return [(r[0], r[1].toArray().tolist()) for r in model.transform(df).orderBy("i").select("prediction", "rawPrediction").collect()]


@pytest.mark.parametrize("whole,trees,depth", [(False, 30, 5), (True, 4, 6), (True, 2, 1), (False, 150, 3)])
def test_permuted_columns_as_of_the_model(spark, whole, trees, depth, monkeypatch):
    monkeypatch.setattr(forest, "PAIRS", 700)  # several blocks of trees
    x, _, df = labelled(spark, 60, 5, 3, whole)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3).fit(df.withColumn("features", array_to_vector("y")))
    x[2, 1] = np.nan
    t, other = Trees.of(spark, model, 4), np.roll(x, 1, axis=0)
    want = judged(spark, model, x)
    assert t.summed(x)[:, :3].tolist() == [r[1] for r in want] and not t.summed(x)[:, 3].any()
    got = t.permuted(x, other)
    assert got[:, 0].tolist() == [r[0] for r in want]
    for j in range(5):  # whole numbers and few trees: many equal votes
        mixed = x.copy()
        mixed[:, j] = other[:, j]
        assert got[:, j + 1].tolist() == [r[0] for r in judged(spark, model, mixed)]


def test_importance_without_a_row_for_each_column(spark, monkeypatch):
    seen = []
    real = forest.permuted_hits
    monkeypatch.setattr(markers, "permuted_hits", lambda df, trees, n: seen.append(df) or real(df, trees, n))
    _, _, df = labelled(spark, 150, 6, 3)
    found = markers.permutation_importance(Spectra.of(df.select("spectrum_id", "group", F.col("y").alias("raw_data")), range(6)), 20, -1.0).collect()
    assert len(found) == 6 and max(found, key=lambda r: r["importance"])["pos"] == 1
    assert seen[0].count() == sum(-(-r[1] // 5) for r in df.groupBy("group").count().collect())  # the held fold, each row once


def test_left_out_votes_as_of_the_models(spark, monkeypatch):
    _, _, df = labelled(spark, 160, 5, 3, True)
    s = Spectra.of(df.select("spectrum_id", "group", F.col("y").alias("raw_data")).repartition(2), range(5))
    active, most, real = [], [], RandomForestClassifier.fit

    def fit(self, data):
        active.append(1)
        most.append(len(active))
        try:
            return real(self, data)
        finally:
            active.pop()

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    got = models.forest_out_of_bag(s, 7, 3)
    assert max(most) > 1  # one fit does not wait for another
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # not all trees over all rows, a bag after another
    data = stored(s.df.select("spectrum_id", "group", F.regexp_extract("group", "[0-9]", 0).cast("double").alias("label"), array_to_vector("raw_data").alias("features")))
    want = {r[0]: [0.0] * 3 for r in data.select("spectrum_id").collect()}
    for b, many in enumerate((3, 2, 2)):
        left = F.pmod(F.xxhash64("spectrum_id", F.lit(b), F.lit(42)), F.lit(1 << 30)) < int((1 << 30) / np.e)
        model = real(RandomForestClassifier(numTrees=many, featureSubsetStrategy="sqrt", seed=42 + b, maxDepth=10), data.where(~left))
        for r in model.transform(data.where(left)).select("spectrum_id", "rawPrediction").collect():
            want[r[0]] = [v + w for v, w in zip(want[r[0]], r[1].toArray().tolist(), strict=True)]
    assert {r["spectrum_id"]: r["votes"] or [0.0] * 3 for r in got.collect()} == want
