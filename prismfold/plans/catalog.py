"""Registered queries over spectra made from the `embeddings` table, and the SQL that checks them.

A vector is a spectrum: raw = 1 + embedding, on an axis from 500 in steps of 42; the group is G and the label.
The planted variant adds a trend with the label and a negative correlation, so that markers and edges exist.
Doubles are rounded on both sides; arrays are given point by point.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, correlation, decompose, markers, models, plotdata, preprocess, quality, reduction, stats
from ..sources import files, reports
from ..sources import sample as made
from ..spectra import Spectra, shared_folder

POINTS = 64
AXIS = tuple(float(500 + 42 * i) for i in range(POINTS))
BANDS = [1450.0, 1665.0, (2000.0, 2250.0), (2750.0, 3050.0)]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> Spectra:
    e = table(spark, sf_dir, "embeddings")
    raw = F.transform("embedding", lambda v: v.cast("double") + 1.0)
    return Spectra.of(e.select(F.col("vec_id").alias("spectrum_id"), F.concat(F.lit("G"), F.col("label")).alias("group"), raw.alias("raw_data")), AXIS)


def planted(spark: SparkSession, sf_dir: str) -> Spectra:
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: F.element_at("embedding", i + 1).cast("double")
    raw = F.transform("embedding", lambda x, i: x.cast("double") + 1.0 + F.when((i >= 8) & (i <= 10), F.col("label") * 0.1).when(i == 45, v(20) * -2.0).otherwise(0.0))
    return Spectra.of(e.select(F.col("vec_id").alias("spectrum_id"), F.concat(F.lit("G"), F.col("label")).alias("group"), raw.alias("raw_data")), AXIS)


#: Long form of both variants in SQL: l(spectrum_id, grp, pos, w, v) and p, planted.
L = """
WITH l AS (SELECT spectrum_id, grp, pos, 500 + 42 * pos AS w, 1.0::DOUBLE + x::DOUBLE AS v, label FROM
  (SELECT vec_id AS spectrum_id, 'G' || label AS grp, label, unnest(range(64))::INT AS pos, unnest(embedding) AS x FROM embeddings)),
p AS (SELECT l.spectrum_id, l.grp, l.pos, l.w, l.label, l.v + CASE WHEN l.pos BETWEEN 8 AND 10 THEN l.label * 0.1::DOUBLE WHEN l.pos = 45 THEN (e.embedding[21]::DOUBLE) * -2.0::DOUBLE ELSE 0.0::DOUBLE END AS v
  FROM l JOIN embeddings e ON e.vec_id = l.spectrum_id)
"""


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql if sql.lstrip().startswith("WITH") or " FROM l" not in sql and " FROM p" not in sql else L + sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def points(s: Spectra) -> DataFrame:
    return s.long(()).select("spectrum_id", "pos", "wavenumber", r("value").alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = preprocess.normalize(preprocess.smooth(spectra(spark, sf_dir)), "ch")
    return stats.mean_spectrum(s)


# --- projection, bands -----------------------------------------------------------------------


@query("SELECT count(*) AS n_spectra, count(DISTINCT label) AS n_groups, 64 AS n_features FROM embeddings")
def show_summary(spark, sf_dir):
    return spectra(spark, sf_dir).summary()


@query("SELECT spectrum_id, pos, round(v, 6) + 0.0 AS value, w::DOUBLE AS wavenumber FROM l")
def spectra_long(spark, sf_dir):
    return points(spectra(spark, sf_dir))


@query("SELECT spectrum_id, pos - 12 AS pos, w::DOUBLE AS wavenumber, round(v, 6) + 0.0 AS value FROM l WHERE w > 1000 AND w < 1800")
def cutoff(spark, sf_dir):
    return points(preprocess.cutoff(spectra(spark, sf_dir), 1000, 1800))


@query("SELECT spectrum_id, pos - 36 AS pos, w::DOUBLE AS wavenumber, round(v, 6) + 0.0 AS value FROM l WHERE w BETWEEN 2012 AND 2264 AND label < 3")
def subset_rows_and_points(spark, sf_dir):
    s = spectra(spark, sf_dir)
    return points(s[F.col("group").isin("G0", "G1", "G2"), (2012, 2264)])


@query("""SELECT spectrum_id, round(max(v) FILTER (WHERE pos = 23), 6) AS b1450, round(max(v) FILTER (WHERE pos = 28), 6) AS b1665,
  round(sum(v) FILTER (WHERE w BETWEEN 2000 AND 2250), 6) AS b2000_2250, round(sum(v) FILTER (WHERE w BETWEEN 2750 AND 3050), 6) AS b2750_3050 FROM l GROUP BY spectrum_id""")
def band_intensities(spark, sf_dir):
    s = stats.intensities(spectra(spark, sf_dir), BANDS)
    return s.df.select("spectrum_id", *[r(F.col(f"`{b}`")).alias("b" + b.replace("~", "_")) for b in s.bands])


@query("SELECT spectrum_id, round(a / (a + b), 6) AS cdr FROM (SELECT spectrum_id, sum(v) FILTER (WHERE w BETWEEN 2000 AND 2250) AS a, sum(v) FILTER (WHERE w BETWEEN 2750 AND 3050) AS b FROM l GROUP BY spectrum_id)")
def band_ratio(spark, sf_dir):
    s = stats.intensities(spectra(spark, sf_dir), BANDS[2:])
    a, b = F.col("`2000~2250`"), F.col("`2750~3050`")
    return s.df.select("spectrum_id", r(F.try_divide(a, a + b)).alias("cdr"))


@query("SELECT spectrum_id, grp AS \"group\", 'b' || pos AS variable, round(v, 6) + 0.0 AS value FROM l WHERE pos IN (23, 28)")
def violin_data(spark, sf_dir):
    s = spectra(spark, sf_dir)
    df = s.df.select("spectrum_id", "group", stats.select_value(s, 1450).alias("b23"), stats.select_value(s, 1665).alias("b28"))
    return stats.violin(df, ["b23", "b28"]).withColumn("value", r("value"))


@query("SELECT spectrum_id, pos, w::DOUBLE AS wavenumber, round(v, 6) + 0.0 AS value FROM l WHERE label < 2 UNION ALL SELECT spectrum_id, pos, w, round(v, 6) + 0.0 FROM l WHERE label >= 8")
def bind_rows(spark, sf_dir):
    s = spectra(spark, sf_dir)
    return points(s[F.col("group").isin("G0", "G1")].bind(s[F.col("group").isin("G8", "G9")]))


# --- preprocessing ---------------------------------------------------------------------------

_W = "[18, -45, -10, 60, 120, 143, 120, 60, -10, -45, 18]"


@query(f"""SELECT a.spectrum_id, a.pos, a.w::DOUBLE AS wavenumber, round(CASE WHEN a.pos < 5 OR a.pos > 58 THEN a.v ELSE s.t END, 6) + 0.0 AS value
  FROM l a LEFT JOIN (SELECT a.spectrum_id, a.pos, sum(b.v * ({_W}::DOUBLE[])[b.pos - a.pos + 6] / 429) AS t FROM l a JOIN l b ON a.spectrum_id = b.spectrum_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 GROUP BY 1, 2) s USING (spectrum_id, pos)""")
def smooth_sg(spark, sf_dir):
    return points(preprocess.smooth(spectra(spark, sf_dir)))


@query("SELECT spectrum_id, pos, w::DOUBLE AS wavenumber, round((v - avg(v) OVER s) / stddev_samp(v) OVER s, 6) + 0.0 AS value FROM l WINDOW s AS (PARTITION BY spectrum_id)")
def smooth_snv(spark, sf_dir):
    return points(preprocess.snv(spectra(spark, sf_dir)))


def _normal(method: str, by: str):
    sql = f"SELECT spectrum_id, pos, w::DOUBLE AS wavenumber, round(v / {by}, 6) + 0.0 AS value FROM l WINDOW s AS (PARTITION BY spectrum_id)"

    def f(spark, sf_dir):
        return points(preprocess.normalize(spectra(spark, sf_dir), method, 1450 if method == "specific" else None))

    f.__name__ = f"normalize_{method}"
    query(sql)(f)


_normal("area", "sum(v) OVER s")
_normal("specific", "max(v) FILTER (WHERE pos = 23) OVER s")
_normal("max", "max(v) OVER s")
_normal("ch", "max(v) FILTER (WHERE w > 2850 AND w < 3000) OVER s")


#: The support of the fit above 1790: 1790 to 2065, 2300 to 2633, the point nearest 2783, and the last.
_SUPPORT = "(pos BETWEEN 31 AND 37 OR pos BETWEEN 43 AND 50 OR pos IN (54, 63))"


@query(f"""SELECT spectrum_id, power, true AS orthogonal, true AS sixth_order FROM l CROSS JOIN (SELECT unnest(range(7))::INT AS power) WHERE pos = 0 AND (SELECT count(DISTINCT pos) FROM l WHERE {_SUPPORT}) = 17""")
def baseline_least_squares(spark, sf_dir):
    """Holds the fit against its definition: what is left at the support is orthogonal to all powers up to the sixth, and
    what is taken away is a polynomial of the sixth order, whose seventh differences vanish on the even axis."""
    s = preprocess.baseline_linear(spectra(spark, sf_dir))
    left = s.long(()).withColumn("x", (F.col("wavenumber") - 2468) / 678)
    at = F.expr(_SUPPORT.replace("pos", "(pos + 31)"))
    powers = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("power")
    dots = left.where(at).select("spectrum_id", "x", "value", powers).groupBy("spectrum_id", "power").agg(F.abs(F.sum(F.col("value") * F.pow("x", F.col("power")))).alias("dot"))
    base = s.df.select("spectrum_id", F.zip_with(F.slice("raw_data", 32, 33), "baseline_data", lambda a, b: a - b).alias("b"))
    weights = (1, -7, 21, -35, 35, -21, 7, -1)
    seventh = F.transform(F.sequence(F.lit(1), F.lit(26)), lambda i: F.abs(sum((F.element_at("b", i + k) * w for k, w in enumerate(weights)), F.lit(0.0))))
    return dots.join(base.select("spectrum_id", F.array_max(seventh).alias("d")), "spectrum_id").select("spectrum_id", "power", (F.col("dot") < 1e-6).alias("orthogonal"), (F.col("d") < 1e-6).alias("sixth_order"))


@query()
def baseline_polyfit(spark, sf_dir):
    return points(preprocess.baseline_polyfit(spectra(spark, sf_dir)))


@query()
def baseline_bubble(spark, sf_dir):
    return points(preprocess.baseline_bubble(spectra(spark, sf_dir), 10))


@query()
def one_step(spark, sf_dir):
    return points(preprocess.one_step(spectra(spark, sf_dir)))


@query("""SELECT a.spectrum_id, a.pos, a.w::DOUBLE AS wavenumber, round(a.v - coalesce(b.m, 0), 6) + 0.0 AS value FROM l a
  LEFT JOIN (SELECT grp, pos, avg(v) AS m FROM l WHERE spectrum_id % 10 = 0 GROUP BY grp, pos) b USING (grp, pos) WHERE a.spectrum_id % 10 <> 0""")
def background_remove(spark, sf_dir):
    s = spectra(spark, sf_dir)
    token = F.when(F.col("spectrum_id") % 10 == 0, "bg").otherwise(F.concat(F.lit("c"), F.col("spectrum_id")))
    named = s.write(s.stage, s.df.withColumn("filename", F.concat_ws("_", "group", token)))
    return points(preprocess.remove_background(named, 2))


_SPIKES = L + """,
n AS (SELECT max(spectrum_id) AS last FROM l),
near AS (SELECT l.spectrum_id, l.pos, least(greatest(l.spectrum_id + dr, 0), n.last) AS s2, least(greatest(l.pos + dc, 0), 63) AS p2 FROM l, (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-5, 6)) AS dc), n),
box AS (SELECT a.spectrum_id, a.pos, sum(b.v) AS t FROM near a JOIN l b ON b.spectrum_id = a.s2 AND b.pos = a.p2 GROUP BY 1, 2),
hit AS (SELECT l.spectrum_id, CASE WHEN l.pos < 2 THEN 0 WHEN l.pos > 61 THEN 61 ELSE l.pos - 1 END AS first FROM l JOIN box USING (spectrum_id, pos)
  JOIN (SELECT spectrum_id, max(v) AS top FROM l GROUP BY 1) m USING (spectrum_id) WHERE l.v * 34 - box.t > 10 * m.top),
cell AS (SELECT DISTINCT spectrum_id, first + d AS pos FROM hit, (SELECT unnest(range(0, 3)) AS d)),
fix AS (SELECT c.spectrum_id, c.pos, avg(b.v) AS m FROM cell c, n JOIN l b ON true WHERE b.pos = c.pos AND b.spectrum_id <> c.spectrum_id
  AND ((c.spectrum_id < 3 AND b.spectrum_id BETWEEN c.spectrum_id + 1 AND c.spectrum_id + 3) OR (c.spectrum_id > n.last - 3 AND b.spectrum_id BETWEEN c.spectrum_id - 3 AND c.spectrum_id - 1)
  OR (c.spectrum_id BETWEEN 3 AND n.last - 3 AND b.spectrum_id BETWEEN c.spectrum_id - 3 AND c.spectrum_id + 3)) GROUP BY 1, 2)
SELECT l.spectrum_id, l.pos, l.w::DOUBLE AS wavenumber, round(coalesce(fix.m, l.v), 6) + 0.0 AS value FROM l LEFT JOIN fix USING (spectrum_id, pos)
"""


@query(_SPIKES)
def spike_remove(spark, sf_dir):
    return points(preprocess.remove_spikes(spectra(spark, sf_dir)))


# --- aggregation -----------------------------------------------------------------------------


@query("""SELECT grp AS "group", pos, w::DOUBLE AS wavenumber, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
  round(avg(v) + 0.3 * (10 - 1 - max(label)), 6) AS shown FROM l GROUP BY grp, pos, w""")
def mean_spectrum(spark, sf_dir):
    return stats.mean_spectrum(spectra(spark, sf_dir)).select("group", "pos", "wavenumber", *[r(c).alias(c) for c in ("mean", "sd", "shown")])


@query("SELECT grp AS \"group\", spectrum_id % 4 AS cell, pos, round(avg(v), 6) AS mean FROM l GROUP BY ALL")
def group_cell_mean(spark, sf_dir):
    s = spectra(spark, sf_dir)
    s = s.write(s.stage, s.df.withColumn("cell", F.col("spectrum_id") % 4))
    return stats.group_means(s, ["group", "cell"]).withColumn("mean", r("mean"))


@query("SELECT pos, round(quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 6) AS low, round(quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 6) AS high FROM l GROUP BY pos")
def quartile_fences(spark, sf_dir):
    return quality.fences(spectra(spark, sf_dir)).select("pos", r("low").alias("low"), r("high").alias("high"))


@query("SELECT pos, round(median(v), 6) AS median FROM l GROUP BY pos")
def column_median(spark, sf_dir):
    return spectra(spark, sf_dir).long().groupBy("pos").agg(r(F.median("value")).alias("median"))


_CELLS = """SELECT q.quality AS truth, t.toxic AS predicted, count(x.doc_id) AS n FROM (SELECT DISTINCT quality FROM labels) q CROSS JOIN (SELECT DISTINCT toxic FROM labels) t
  LEFT JOIN labels x ON x.quality = q.quality AND x.toxic = t.toxic GROUP BY 1, 2"""


@query(f"WITH c AS ({_CELLS}) SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share, round(n / sum(n) OVER (PARTITION BY truth), 2) * 100 AS percent FROM c")
def confusion(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))
    return stats.contingency(t, "truth", "predicted").withColumn("share", r("share"))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, count(*) AS n FROM labels")
def overall_accuracy(spark, sf_dir):
    return stats.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("accuracy", r("accuracy"))


@query("SELECT quality AS truth, round(1 - avg((quality = toxic)::INT), 6) AS error, count(*) AS n FROM labels GROUP BY 1")
def class_errors(spark, sf_dir):
    t = table(spark, sf_dir, "labels").withColumnRenamed("quality", "truth")
    return stats.class_errors(t, "truth", "toxic").withColumn("error", r("error"))


# --- markers ---------------------------------------------------------------------------------

_AUC = """, k AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY v DESC) + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {key}) AS t FROM {src})
SELECT {key}, grp AS "group", round((sum(rk) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(t) - count(*))), 6) AS auc FROM k GROUP BY {key}, grp HAVING (sum(rk) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(t) - count(*))) > 0.75"""
_PAIRS = """, q AS (SELECT a.spectrum_id, a.grp, a.label, a.pos AS i, b.pos AS j, a.v / b.v AS v FROM p a JOIN p b ON a.spectrum_id = b.spectrum_id AND a.pos {op} b.pos)"""


@query(_AUC.format(key="pos", src="p"))
def markers_roc(spark, sf_dir):
    return markers.roc(planted(spark, sf_dir)).select("pos", "group", r("auc").alias("auc"))


@query(_PAIRS.format(op="<") + _AUC.format(key="i, j", src="q"))
def markers_roc_paired(spark, sf_dir):
    return markers.roc_pairs(planted(spark, sf_dir)).select("i", "j", "group", r("auc").alias("auc"))


@query("SELECT pos, w::DOUBLE AS wavenumber, round(corr(v, label), 6) AS r FROM p GROUP BY pos, w HAVING abs(corr(v, label)) > 0.8")
def markers_correlation(spark, sf_dir):
    return markers.correlations(planted(spark, sf_dir)).withColumn("r", r("r"))


@query(_PAIRS.format(op="<>") + " SELECT i, j, round(corr(v, label), 6) AS r FROM q GROUP BY i, j HAVING abs(corr(v, label)) > 0.7")
def markers_correlation_paired(spark, sf_dir):
    return markers.correlations_pairs(planted(spark, sf_dir), 0.7).withColumn("r", r("r"))


@query("""SELECT vec_id AS spectrum_id, 'G' || label AS "group", (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 10 + 1 AS fold FROM embeddings""")
def balanced_folds(spark, sf_dir):
    return markers.balanced_folds(spectra(spark, sf_dir).df)


_PROB = "SELECT vec_id AS spectrum_id, label, [abs(x::DOUBLE) FOR x IN embedding[1:10]] AS p FROM embeddings"


@query(f"WITH t AS ({_PROB.replace('[abs(x::DOUBLE) FOR x IN embedding[1:10]]', '[abs(x::DOUBLE) for x in embedding[1:10]]')}), s AS (SELECT spectrum_id, p[label + 1] AS a, list_max(p[1:label] || p[label + 2:10]) AS b FROM t) SELECT spectrum_id, round(a, 6) AS p_alleged, round(b, 6) AS p_others, round(a - b, 6) + 0.0 AS difference FROM s")
def mislabel_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), "label", F.transform(F.slice("embedding", 1, 10), lambda v: F.abs(v.cast("double"))).alias("probability"))
    return markers.mislabel_scores(e).select("spectrum_id", *[r(c).alias(c) for c in ("p_alleged", "p_others", "difference")])


@query(""", g AS (SELECT pos, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM p GROUP BY 1, 2), t AS (SELECT pos, avg(v) AS m FROM p GROUP BY 1)
SELECT pos, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / (count(*) - 1) / (sum((g.n - 1) * s) / (sum(g.n) - count(*))), 4) AS f_value FROM g JOIN t USING (pos) GROUP BY pos""")
def between_groups_anova(spark, sf_dir):
    return markers.anova(planted(spark, sf_dir)).select("pos", r("f_value", 4).alias("f_value"))


@query(""", k AS (SELECT *, rank() OVER (PARTITION BY pos ORDER BY v) + (count(*) OVER (PARTITION BY pos, v) - 1) / 2.0 AS rk FROM p),
g AS (SELECT pos, grp, sum(rk) AS s, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT pos, sum(m * m * m - m) AS t FROM (SELECT pos, v, count(*)::DOUBLE AS m FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT pos, round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n)::DOUBLE * sum(n) * sum(n) - sum(n))), 4) AS h_value FROM g JOIN t USING (pos) GROUP BY pos""")
def between_groups_kruskal(spark, sf_dir):
    return markers.kruskal(planted(spark, sf_dir)).select("pos", r("h_value", 4).alias("h_value"))


_TWO = """, t AS (SELECT pos, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM p WHERE label IN (0, 9) GROUP BY 1, 2),
k AS (SELECT pos, grp, rank() OVER (PARTITION BY pos ORDER BY v) + (count(*) OVER (PARTITION BY pos, v) - 1) / 2.0 AS rk FROM p WHERE label IN (0, 9)),
w AS (SELECT pos, sum(rk) FILTER (WHERE grp = 'G0') AS r FROM k GROUP BY 1)
SELECT a.pos, (500 + 42 * a.pos)::DOUBLE AS wavenumber, round(a.m, 6) AS "mean_G0", round(b.m, 6) AS "mean_G9", round(sqrt(a.s), 6) AS "sd_G0", round(sqrt(b.s), 6) AS "sd_G9",
  (w.r - a.n * (a.n + 1) / 2.0 - a.n * b.n / 2.0) ** 2 / (a.n * b.n * (a.n + b.n + 1) / 12.0) > 3.841458820694124 AS ranks_differ
FROM t a JOIN t b USING (pos) JOIN w USING (pos) WHERE a.grp = 'G0' AND b.grp = 'G9'"""


@query(_TWO)
def between_two_groups(spark, sf_dir):
    s = planted(spark, sf_dir)
    out = markers.between_groups(s[F.col("group").isin("G0", "G9")], "BH")
    return out.select("pos", "wavenumber", *[r(c).alias(c) for c in ("mean_G0", "mean_G9", "sd_G0", "sd_G9")], (F.col("wilcoxon_test") < 0.05).alias("ranks_differ"))


@query()
def between_groups_adjusted(spark, sf_dir):
    return markers.between_groups(planted(spark, sf_dir), "holm")


@query()
def markers_correlation_by_average(spark, sf_dir):
    return markers.correlations(planted(spark, sf_dir), 0.5, by_average=True)


@query()
def markers_importance(spark, sf_dir):
    return markers.permutation_importance(planted(spark, sf_dir), threshold=-1.0)


@query()
def markers_dapc(spark, sf_dir):
    return markers.dapc(planted(spark, sf_dir))


# --- quality ---------------------------------------------------------------------------------

_SNR = """WITH l AS (SELECT vec_id AS spectrum_id, embedding, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
n AS (SELECT spectrum_id, avg(v) AS m, stddev_samp(abs(v)) AS a, avg(abs(v)) AS b FROM l WHERE 500 + 42 * pos > 1800 AND 500 + 42 * pos < 1900 GROUP BY 1),
s AS (SELECT spectrum_id, max(v) AS t, stddev_samp(v) AS d FROM l WHERE 500 + 42 * pos > 600 AND 500 + 42 * pos < 3050 GROUP BY 1),
f AS (SELECT vec_id AS spectrum_id, row_number() OVER (PARTITION BY embedding ORDER BY vec_id) = 1 AS first FROM embeddings)
SELECT spectrum_id, round((t - m) / d, 6) AS snr, a < 0.3 AND b < 0.3 AND (t - m) / d > 3 AND first AS quality FROM n JOIN s USING (spectrum_id) JOIN f USING (spectrum_id)"""


@query(_SNR)
def quality_snr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), F.concat(F.lit("G"), F.col("label")).alias("group"), F.col("embedding").cast("array<double>").alias("raw_data"))
    return quality.snr(Spectra.of(e, AXIS), "easy").withColumn("snr", r("snr"))


@query("SELECT vec_id AS spectrum_id, row_number() OVER (PARTITION BY embedding ORDER BY vec_id) = 1 AS quality FROM embeddings")
def quality_first_copies(spark, sf_dir):
    return quality.first_copies(spectra(spark, sf_dir))


@query(""", c AS (SELECT pos, median(v) AS m FROM l GROUP BY pos), c2 AS (SELECT avg(m) AS m, var_samp(m) AS s FROM c), y AS (SELECT spectrum_id, avg(v) AS m, var_samp(v) AS s FROM l GROUP BY 1)
SELECT spectrum_id, round(32 * (y.m - c2.m) * (y.m - c2.m) / ((y.s + c2.s) / 2), 6) AS f_value, 32 * (y.m - c2.m) * (y.m - c2.m) / ((y.s + c2.s) / 2) <= 3.91632464355 AS quality FROM y, c2""")
def quality_t2_first_step(spark, sf_dir):
    return quality.t2(spectra(spark, sf_dir), most=1).withColumn("f_value", r("f_value"))


@query()
def quality_t2(spark, sf_dir):
    return quality.t2(spectra(spark, sf_dir))


@query("SELECT spectrum_id, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM l JOIN (SELECT pos, avg(v) AS m FROM l GROUP BY pos) USING (pos) GROUP BY spectrum_id")
def quality_distance_first_step(spark, sf_dir):
    return quality.distance_once(spectra(spark, sf_dir)).withColumn("distance", r("distance"))


@query()
def quality_distance(spark, sf_dir):
    return quality.distance(spectra(spark, sf_dir))


@query()
def quality_icod(spark, sf_dir):
    return quality.icod(spectra(spark, sf_dir), 0.4)


@query()
def quality_mcd(spark, sf_dir):
    return quality.mcd(spectra(spark, sf_dir))


# --- correlation -----------------------------------------------------------------------------

_OUT = """, m AS (SELECT a.grp, a.pos, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) AS va, var_samp(b.v) AS vb, covar_samp(a.v, b.v) AS c FROM p a JOIN p b ON a.spectrum_id = b.spectrum_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0 GROUP BY 1, 2),
o AS (SELECT a.spectrum_id, max(sqrt((vb * (a.v - ma) * (a.v - ma) - 2 * c * (a.v - ma) * (b.v - mb) + va * (b.v - mb) * (b.v - mb)) / (va * vb - c * c))) > 2 * ln(5) AS outlier
  FROM p a JOIN p b ON a.spectrum_id = b.spectrum_id AND b.pos = a.pos + 1 JOIN m ON m.grp = a.grp AND m.pos = a.pos WHERE a.pos % 2 = 0 GROUP BY 1)"""
_EDGES = """, g AS (SELECT p.* FROM p JOIN o USING (spectrum_id) WHERE NOT outlier {and_}), e AS (SELECT a.grp, a.pos AS i, b.pos AS j, corr(a.v, b.v) AS r FROM g a JOIN g b ON a.spectrum_id = b.spectrum_id AND a.pos < b.pos GROUP BY 1, 2, 3)
SELECT grp AS "group", (500 + 42 * i)::DOUBLE AS wave_1, (500 + 42 * j)::DOUBLE AS wave_2, round(r, 6) AS r FROM e WHERE r < -0.6"""


@query(_OUT + " SELECT spectrum_id, outlier FROM o")
def pair_outliers(spark, sf_dir):
    return correlation.pair_outliers(planted(spark, sf_dir))


@query(_OUT + _EDGES.format(and_=""))
def correlation_network(spark, sf_dir):
    return correlation.network(planted(spark, sf_dir)).select("group", "wave_1", "wave_2", r("r").alias("r"))


_ANN = [(783.0, "Nucleic acid"), (1340.0, "Nucleic acid"), (1003.0, "Protein"), (1665.0, "Protein"), (2390.0, "Lipids"), (1450.0, "Lipids")]


@query()
def correlation_network_local(spark, sf_dir):
    return correlation.local_network(planted(spark, sf_dir), _ANN, threshold=0.0).withColumn("r", r("r"))


@query("SELECT a.grp AS \"group\", a.pos AS i, b.pos AS j, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM p a JOIN p b ON a.spectrum_id = b.spectrum_id AND a.pos < b.pos GROUP BY 1, 2, 3")
def correlation_pairs(spark, sf_dir):
    return correlation.correlation_pairs(planted(spark, sf_dir)).select("group", "i", "j", r("r").alias("r"), "n")


@query("SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS synchronous FROM l a JOIN l b ON a.spectrum_id = b.spectrum_id GROUP BY 1, 2")
def synchronous_correlation(spark, sf_dir):
    return correlation.two_dimensional(spectra(spark, sf_dir)).select("i", "j", r("synchronous").alias("synchronous"))


@query()
def two_dimensional_correlation(spark, sf_dir):
    return correlation.two_dimensional(spectra(spark, sf_dir))


@query("""SELECT a.l_returnflag AS "row", b.l_returnflag AS col, round(abs(a.q - b.q), 4) AS value, a.g || '_VS._' || b.g AS pair, CASE WHEN a.g = b.g THEN 'AllWithin' ELSE 'AllBetween' END AS kind
  FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'x' ELSE 'y' END AS g, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'x' ELSE 'y' END AS g, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) b ON a.l_returnflag < b.l_returnflag""")
def matrix_pairs(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q")).withColumn("g", F.when(F.col("l_returnflag") == "N", "x").otherwise("y"))
    a, b = q.toDF("row", "qa", "row_group"), q.toDF("col", "qb", "col_group")
    m = a.crossJoin(F.broadcast(b)).withColumn("value", F.abs(F.col("qa") - F.col("qb")))  # a level by level matrix
    return correlation.pair_table(m).withColumn("value", r("value", 4))


_LEVELS = "(SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'x' ELSE 'y' END AS g, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT a.l_returnflag AS "row", b.l_returnflag AS col, round(abs(a.q - b.q), 4) AS value, a.g || '_VS._' || b.g AS pair, CASE WHEN a.g = b.g THEN 'AllWithin' ELSE 'AllBetween' END AS kind
  FROM {_LEVELS} a CROSS JOIN {_LEVELS} b""")
def matrix_cells(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q")).withColumn("g", F.when(F.col("l_returnflag") == "N", "x").otherwise("y"))
    a, b = q.toDF("row", "qa", "row_group"), q.toDF("col", "qb", "col_group")
    m = a.crossJoin(F.broadcast(b)).withColumn("value", F.abs(F.col("qa") - F.col("qb")))  # a level by level matrix
    return correlation.pair_table(m, duplicate=True).withColumn("value", r("value", 4))


@query("""SELECT a.grp AS "group", a.pos AS i, b.pos AS j, 'B' || a.pos // 16 || '_VS._B' || b.pos // 16 AS pair, CASE WHEN a.pos // 16 = b.pos // 16 THEN 'AllWithin' ELSE 'AllBetween' END AS kind, round(corr(a.v, b.v), 6) AS r
  FROM p a JOIN p b ON a.spectrum_id = b.spectrum_id AND a.pos < b.pos GROUP BY 1, 2, 3""")
def correlation_pairs_labelled(spark, sf_dir):
    bands = spark.createDataFrame([(i, f"B{i // 16}") for i in range(POINTS)], "pos int, band_group string")
    out = correlation.pair_table_with_p(correlation.correlation_pairs(planted(spark, sf_dir)), bands)
    return out.select("group", "i", "j", "pair", "kind", r("r").alias("r"))


_LINKS = """, g AS (SELECT p.* FROM p JOIN o USING (spectrum_id) WHERE NOT outlier), e AS (SELECT a.grp, a.pos AS i, b.pos AS j, corr(a.v, b.v) AS r FROM g a JOIN g b ON a.spectrum_id = b.spectrum_id AND a.pos < b.pos GROUP BY 1, 2, 3),
k AS (SELECT grp, (500 + 42 * i)::DOUBLE AS wave_1, (500 + 42 * j)::DOUBLE AS wave_2, r FROM e WHERE abs(r) > 0.6)"""


@query(_OUT + _LINKS + " SELECT grp AS \"group\", wave_1, wave_2, round(r, 6) AS r FROM k")
def chord_links(spark, sf_dir):
    return plotdata.chord_links(planted(spark, sf_dir), sign="both").select("group", "wave_1", "wave_2", r("r").alias("r"))


@query(_OUT + _LINKS + """ SELECT grp AS "group", wave, count(*) AS degree, round(sum(r), 6) AS sum_r, round(avg(r), 6) AS mean_r FROM (SELECT grp, wave_1 AS wave, r FROM k UNION ALL SELECT grp, wave_2, r FROM k) GROUP BY 1, 2""")
def chord_nodes(spark, sf_dir):
    return plotdata.chord_nodes(plotdata.chord_links(planted(spark, sf_dir), sign="both")).select("group", "wave", "degree", r("sum_r").alias("sum_r"), r("mean_r").alias("mean_r"))


@query(_OUT + _LINKS + """ SELECT grp AS "group", wave_1, wave_2, round(r, 6) AS r, a.g AS band_group_1, b.g AS band_group_2 FROM k JOIN (VALUES (794.0, 'Nucleic acid'), (1340.0, 'Nucleic acid'), (1004.0, 'Protein'), (1676.0, 'Protein'), (2390.0, 'Lipids'), (1466.0, 'Lipids')) a(w, g) ON a.w = wave_1
  JOIN (VALUES (794.0, 'Nucleic acid'), (1340.0, 'Nucleic acid'), (1004.0, 'Protein'), (1676.0, 'Protein'), (2390.0, 'Lipids'), (1466.0, 'Lipids')) b(w, g) ON b.w = wave_2 WHERE r < 0""")
def chord_links_local(spark, sf_dir):
    return plotdata.local_chord(planted(spark, sf_dir), _ANN).select("group", "wave_1", "wave_2", r("r").alias("r"), "band_group_1", "band_group_2")


# --- reduction, clustering -------------------------------------------------------------------


@query()
def reduction_pca(spark, sf_dir):
    return reduction.pca(spectra(spark, sf_dir), 4).df.select("spectrum_id", F.posexplode("PCA").alias("component", "score"))


@query(""", m AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS d FROM l GROUP BY pos), z AS (SELECT spectrum_id, sum((v - m) * (v - m) / (d * d)) AS q FROM l JOIN m USING (pos) GROUP BY 1)
SELECT spectrum_id, round(q, 5) AS squared_norm FROM z""")
def reduction_pca_whole(spark, sf_dir):
    """All components keep each scaled spectrum's distance from the mean."""
    out = reduction.pca(spectra(spark, sf_dir), 64).df
    return out.select("spectrum_id", r(F.aggregate("PCA", F.lit(0.0), lambda a, v: a + v * v), 5).alias("squared_norm"))


@query("SELECT i, j, i = j AS correlated FROM (SELECT unnest(range(4))::INT AS i) CROSS JOIN (SELECT unnest(range(4))::INT AS j) WHERE i <= j")
def reduction_pca_uncorrelated(spark, sf_dir):
    """Scores have zero means and are uncorrelated, and their variances descend: pairs that are correlated are those of a component with itself."""
    long = reduction.pca(spectra(spark, sf_dir), 4).df.select("spectrum_id", F.posexplode("PCA").alias("i", "a"))
    pairs = long.join(long.toDF("spectrum_id", "j", "b"), "spectrum_id").where("i <= j")
    return pairs.groupBy("i", "j").agg((F.abs(F.corr("a", "b")) > 1e-6).alias("correlated"))


@query()
def reduction_pcoa(spark, sf_dir):
    return reduction.pcoa(spectra(spark, sf_dir)).df.select("spectrum_id", F.posexplode("PCoA").alias("component", "score"))


@query()
def reduction_pcoa_manhattan(spark, sf_dir):
    return reduction.pcoa(spectra(spark, sf_dir), distance="manhattan").df.select("spectrum_id", F.posexplode("PCoA").alias("component", "score"))


@query()
def reduction_tsne(spark, sf_dir):
    return reduction.tsne(spectra(spark, sf_dir)).df.select("spectrum_id", F.posexplode("tSNE").alias("component", "score"))


@query()
def reduction_umap(spark, sf_dir):
    return reduction.umap(spectra(spark, sf_dir)).df.select("spectrum_id", F.posexplode("UMAP").alias("component", "score"))


_KNN = """WITH s AS (SELECT a.vec_id AS spectrum_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s) SELECT spectrum_id, neighbour, round(c, 6) AS similarity, rank::INT AS rank FROM k WHERE rank <= 10"""


@query(_KNN)
def nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), F.col("embedding").cast("array<double>").alias("x"))
    return cluster.nearest_pairs(e, "x", 10).withColumn("similarity", r("similarity"))


@query("SELECT a.spectrum_id AS a, b.spectrum_id AS b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS distance FROM l a JOIN l b ON a.pos = b.pos AND a.spectrum_id < b.spectrum_id GROUP BY 1, 2")
def pair_distances(spark, sf_dir):
    return cluster.distances(spectra(spark, sf_dir)).withColumn("distance", r("distance"))


@query()
def cluster_hca(spark, sf_dir):
    return cluster.hca(spectra(spark, sf_dir))


@query()
def cluster_kmeans(spark, sf_dir):
    return cluster.kmeans(spectra(spark, sf_dir), 5)[0]


@query()
def cluster_gmm(spark, sf_dir):
    return cluster.gmm(spectra(spark, sf_dir))[0]


@query()
def cluster_louvain(spark, sf_dir):
    return cluster.louvain_clusters(spectra(spark, sf_dir), (0.5, 1.0))


# --- models, decomposition -------------------------------------------------------------------


@query("""SELECT vec_id AS spectrum_id, 'G' || label AS "group", row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.7, 0) AS training FROM embeddings""")
def stratified_partition(spark, sf_dir):
    return stats.stratified_partition(spectra(spark, sf_dir).df)


def _model(name: str, fit):
    def f(spark, sf_dir):
        train, test = models.split(planted(spark, sf_dir))
        return models.predict(fit(train), test).select("spectrum_id", "group", "prediction")

    f.__name__ = name
    query()(f)


_model("classify_lda", models.lda)
_model("classify_svm", models.svm)
_model("classify_forest", models.random_forest)
_model("quantify_pls", models.pls)
_model("quantify_mlr", models.mlr)
_model("quantify_glm", models.glm)


@query()
def forest_out_of_fold(spark, sf_dir):
    return models.forest_votes(planted(spark, sf_dir).df).select("spectrum_id", "group", "prediction")


@query()
def forest_out_of_bag(spark, sf_dir):
    return models.forest_out_of_bag(planted(spark, sf_dir)).select("spectrum_id", "group", "prediction")


@query()
def markers_rbcs_means(spark, sf_dir):
    return markers.rbcs(planted(spark, sf_dir))[1]


_FLAGS = "SELECT l_returnflag AS t, CASE WHEN l_quantity > 25 THEN 'N' ELSE l_returnflag END AS q FROM lineitem"


def _flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.when(F.col("l_quantity") > 25, "N").otherwise(F.col("l_returnflag")).alias("prediction"))


@query(f"""WITH v AS ({_FLAGS}), s AS (SELECT avg((t <> q)::INT) AS e, stddev_samp((t <> q)::INT) AS d, (SELECT 1 - max(n) / sum(n) FROM (SELECT count(*)::DOUBLE AS n FROM v GROUP BY t)) AS b FROM v)
SELECT item, value FROM (SELECT 'Model' AS item, 'Random Forest' AS value UNION ALL SELECT 'Error type', 'oob' UNION ALL SELECT 'Number of trees', '500' UNION ALL SELECT 'Estimated error', printf('%.5f', e) FROM s UNION ALL SELECT 'Standard deviation', printf('%.5f', d) FROM s
  UNION ALL SELECT 'Baseline error (for random guessing)', printf('%.5f', b) FROM s UNION ALL SELECT 'Ratio baseline error to observed error', printf('%.5f', b / e) FROM s)""")
def forest_summary(spark, sf_dir):
    return reports.forest_summary(_flags(spark, sf_dir), 500)


@query(f"""WITH v AS ({_FLAGS}) SELECT t AS "group", sum((q = 'A')::INT)::BIGINT AS "A", sum((q = 'N')::INT)::BIGINT AS "N", sum((q = 'R')::INT)::BIGINT AS "R", round(1 - avg((t = q)::INT), 6) + 0.0 AS error FROM v GROUP BY t""")
def forest_confusion(spark, sf_dir):
    return reports.confusion_table(_flags(spark, sf_dir)).select(F.col("True\\Predicted").alias("group"), "A", "N", "R", r("Class error").alias("error"))


@query()
def decompose_nmf(spark, sf_dir):
    return decompose.nmf(spectra(spark, sf_dir))[0].select("spectrum_id", F.posexplode("W").alias("component", "weight"))


@query()
def decompose_mcr_als(spark, sf_dir):
    return decompose.mcr_als(spectra(spark, sf_dir))[0].select("spectrum_id", F.posexplode("concentration").alias("component", "share"))


@query()
def decompose_ica(spark, sf_dir):
    return decompose.ica(spectra(spark, sf_dir))[0].select("spectrum_id", F.posexplode("sources").alias("component", "value"))


# --- sources, plot data ----------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, hour(ts) AS hour, sum(value) AS v FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT hour(ts) AS hour FROM events)
SELECT u.user_id AS spectrum_id, (row_number() OVER (PARTITION BY u.user_id ORDER BY h.hour) - 1)::INT AS pos, round(coalesce(c.v, 0), 4) + 0.0 AS value FROM u CROSS JOIN h LEFT JOIN c ON c.user_id = u.user_id AND c.hour = h.hour""")
def coordinate_layout(spark, sf_dir):
    long = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.sum("value").alias("v"))
    out = files.complete(long, ["user_id"], "hour", "v", 0.0)
    return out.select(F.col("user_id").alias("spectrum_id"), F.posexplode("y").alias("pos", "value")).withColumn("value", r("value", 4))


def _text_files(lines: DataFrame, order: list[str]) -> str:
    """Text files, one for each `name`, of the column `line` in order; the folder."""
    path = f"{shared_folder(lines.sparkSession)}/text-{uuid.uuid4().hex[:12]}"
    lines.repartition("name").sortWithinPartitions("name", *order).select("name", "line").write.partitionBy("name").text(path)
    return path


def _read_back(spark: SparkSession, path: str) -> Spectra:
    return files.read_collection(spark, path, "txt", group_index=(2,), group_splits="/|_|=", cutoff=(0, 6000))


@query("SELECT grp AS \"group\", pos, w::DOUBLE AS wavenumber, round(avg(v), 6) + 0.0 AS value FROM l GROUP BY grp, pos, w")
def single_spectrum_files(spark, sf_dir):
    """The mean spectrum of each group as a file of two columns, read back."""
    means = spectra(spark, sf_dir).long().groupBy("group", "pos", "wavenumber").agg(F.avg("value").alias("v"))
    lines = means.select(F.col("group").alias("name"), "pos", F.concat_ws("\t", "wavenumber", "v").alias("line"))
    s = _read_back(spark, _text_files(lines, ["pos"]))
    return s.long().select("group", "pos", "wavenumber", r("value").alias("value"))


@query("SELECT grp AS \"group\", k, pos, w::DOUBLE AS wavenumber, round(v, 6) + 0.0 AS value FROM l JOIN (SELECT vec_id AS spectrum_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) USING (spectrum_id)")
def row_oriented_files(spark, sf_dir):
    """A file for each group: the axis in its first line, a spectrum in each other line, read back."""
    rows = spectra(spark, sf_dir).df.select(F.col("group").alias("name"), "spectrum_id", F.concat_ws(",", F.transform("raw_data", lambda v: v.cast("string"))).alias("line"))
    head = rows.select("name").distinct().select("name", F.lit(-1).cast("long").alias("spectrum_id"), F.lit(",".join(map(str, AXIS))).alias("line"))
    s = _read_back(spark, _text_files(rows.union(head), ["spectrum_id"]))
    return s.long(("group", "spectrum")).select("group", F.col("spectrum").cast("long").alias("k"), "pos", "wavenumber", r("value").alias("value"))


@query("SELECT grp AS \"group\", spectrum_id AS x, pos, w::DOUBLE AS wavenumber, round(v, 6) + 0.0 AS value FROM l")
def coordinate_files(spark, sf_dir):
    """A file for each group with lines of two coordinates, wavenumber and value, under a heading, read back."""
    long = spectra(spark, sf_dir).long()
    lines = long.select(F.col("group").alias("name"), "spectrum_id", "pos", F.concat_ws("\t", "spectrum_id", F.lit("7"), "wavenumber", "value").alias("line"))
    head = lines.select("name").distinct().select("name", F.lit(-1).cast("long").alias("spectrum_id"), F.lit(0).alias("pos"), F.lit("x\ty\twave\tvalue").alias("line"))
    s = _read_back(spark, _text_files(lines.union(head), ["spectrum_id", "pos"]))
    return s.long(("group", "spectrum")).select("group", F.split("spectrum", "_")[0].cast("long").alias("x"), "pos", "wavenumber", r("value").alias("value"))


@query("""WITH g AS (SELECT p_partkey, p_size % 3 AS k FROM part), n AS (SELECT k, count(*) AS n FROM g GROUP BY 1), o AS (SELECT k, 'Batch_' || row_number() OVER (ORDER BY n DESC, md5(CASE k WHEN 0 THEN '500.0,600.0' WHEN 1 THEN '501.0,600.0' ELSE '502.0,600.0' END)) AS batch FROM n)
SELECT p_partkey, batch FROM g JOIN o USING (k)""")
def axis_batches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") % 3 + 500 + 0.01).cast("double"), F.lit(600.0)).alias("axis"))
    return files.batches(p).select("p_partkey", "batch")


@query("SELECT c_custkey, 'Customer#' AS prefix, str_split(c_name, '#')[1] AS \"Group\", str_split(c_name, '#')[1] || '_' || str_split(c_name, '#')[2] AS \"group_name\" FROM customer")
def group_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_name", "filename")
    parts = F.split("filename", "#")
    out = files.groups_of(c, (1, 2), "#", ("Kind", "Number"))
    return out.select("c_custkey", F.lit("Customer#").alias("prefix"), parts[0].alias("Group"), F.col("group").alias("group_name"))


@query("WITH m AS (SELECT DISTINCT (500 + 42 * pos)::DOUBLE AS wavenumber FROM (SELECT unnest([1, 2, 3, 10, 11, 30]) AS pos)), s AS (SELECT wavenumber, CASE WHEN wavenumber - lag(wavenumber) OVER (ORDER BY wavenumber) <= 50 THEN 0 ELSE 1 END AS start FROM m), g AS (SELECT wavenumber, (sum(start) OVER (ORDER BY wavenumber))::BIGINT AS band FROM s) SELECT wavenumber, band, min(wavenumber) OVER (PARTITION BY band)::INT || '~' || max(wavenumber) OVER (PARTITION BY band)::INT AS label FROM g")
def merge_waves(spark, sf_dir):
    m = spark.createDataFrame([(AXIS[i],) for i in (1, 2, 3, 10, 11, 30)], "wavenumber double")
    return stats.merge_waves(m, gap=50)


@query("SELECT grp AS \"group\", w::DOUBLE AS wavenumber, round(avg(v), 6) AS mean, bool_or(pos BETWEEN 8 AND 10) AS marker FROM p GROUP BY grp, w")
def markers_on_spectrum(spark, sf_dir):
    s = planted(spark, sf_dir)
    return stats.markers_on_spectrum(s, markers.roc(s)).withColumn("mean", r("mean"))


@query("SELECT grp AS \"group\", pos, w::DOUBLE AS wavenumber, round(avg(v), 6) AS mean FROM p WHERE pos IN (8, 9, 10, 45) GROUP BY grp, pos, w")
def marker_heatmap(spark, sf_dir):
    return stats.heatmap(planted(spark, sf_dir), [AXIS[i] for i in (8, 9, 10, 45)]).select("group", "pos", "wavenumber", r("mean").alias("mean"))


@query("SELECT c_custkey, round(greatest(least(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)), (SELECT quantile_cont(c_acctbal, 0.05) FROM customer)), 4) AS c_acctbal FROM customer")
def clamp_colour(spark, sf_dir):
    return stats.clamp(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", r("c_acctbal", 4))


@query("SELECT c_custkey AS spectrum_id, c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE AS y, c_mktsegment AS colour FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
def scatter_points(spark, sf_dir):
    return plotdata.scatter(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "spectrum_id"), "c_acctbal", "c_nationkey", "c_mktsegment")


def _panels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_id"), F.concat(F.lit("G"), F.col("label")).alias("group"), (F.col("vec_id") % 3).alias("cluster"), F.col("embedding").cast("array<double>").alias("layout"))
    return plotdata.time_series(e, "layout")


@query("SELECT 'G' || label AS panel, vec_id AS spectrum_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS x, round(embedding[2]::DOUBLE, 6) + 0.0 AS y, 'Cluster_' || vec_id % 3 AS cluster FROM embeddings")
def time_series_points(spark, sf_dir):
    return _panels(spark, sf_dir).withColumn("x", r("x")).withColumn("y", r("y"))


@query()
def time_series_hulls(spark, sf_dir):
    return plotdata.hulls(_panels(spark, sf_dir))


@query("SELECT 'T' || i AS \"group\", 100::BIGINT AS n, 800 AS points FROM (SELECT unnest(range(5)) AS i)")
def sample_collection(spark, sf_dir):
    return made.sample(spark).df.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("raw_data")).alias("points"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
