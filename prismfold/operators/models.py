"""Classification and quantification models. Fits need grouped sums or Spark ML; prediction is row-local."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spectra import Spectra, stored
from .forest import Trees, left_out_votes
from .preprocess import map_rows, rectangle
from .reduction import components, gram, moments, pca_model, project
from .stats import stratified_partition

#: Forests fitted at a time; the driver holds the nodes of each while they grow.
FITS = 2


def split(s: Spectra, share: float = 0.7, seed: int = 42) -> tuple[Spectra, Spectra]:
    part = stratified_partition(s.df, share, seed)
    take = lambda flag: s.write(s.stage, s.df.join(part.where(f"training = {flag}").select("spectrum_id"), "spectrum_id", "left_semi"))
    return take("true"), take("false")


def _best(names, scores: str):
    """The name of the largest score, the first of equal ones; null without scores, where array_position alone would not be."""
    return F.when(F.col(scores).isNotNull(), F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int")))


@dataclass
class LinearDiscriminant:
    """Scaled components, then a Gaussian for each class with one covariance."""

    classes: list[str]
    centre: np.ndarray
    matrix: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, df: DataFrame, y: str) -> DataFrame:
        def fn(x):
            z = (x - self.centre) @ self.matrix @ self.weights.T + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

        out = map_rows(df, y, "probability", fn)
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("prediction", _best(names, "probability"))


def lda(train: Spectra, n_pc: int = 20) -> LinearDiscriminant:
    model = pca_model(train.df, train.stage, min(n_pc, len(train.axis)))
    matrix = model["vectors"] / model["scale"][:, None]
    scored = project(train.df, train.stage, "__z", model["mean"], matrix)
    rows = scored.select("group", F.posexplode("__z").alias("pos", "v")).groupBy("group", "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n")).orderBy("group", "pos").collect()
    classes = sorted({r["group"] for r in rows})
    means = np.array([[r["m"] for r in rows if r["group"] == c] for c in classes])
    count = np.array([next(r["n"] for r in rows if r["group"] == c) for c in classes], float)
    n, _, cross = gram(scored, "__z")
    within = (cross - (means.T * count) @ means) / max(1, n - len(classes))
    inverse = np.linalg.pinv(within)
    weights = means @ inverse
    return LinearDiscriminant(classes, model["mean"], matrix, weights, np.log(count / n) - 0.5 * np.einsum("ij,ij->i", weights, means))


@dataclass
class MlClassifier:
    pipeline: object
    probabilities: bool

    def predict(self, df: DataFrame, y: str) -> DataFrame:
        out = self.pipeline.transform(df.withColumn("features", array_to_vector(y)))
        p = vector_to_array("__p") if self.probabilities else F.lit(None).cast("array<double>")
        return out.withColumn("probability", p).withColumn("prediction", F.col("__name")).drop("features", "label", "__p", "__raw", "__index", "__name", "__scaled")


def _pipeline(train: Spectra, estimator, scale: bool, probabilities: bool) -> MlClassifier:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer

    data = train.df.withColumn("features", array_to_vector(train.stage))
    index = StringIndexer(inputCol="group", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    stages = [StandardScaler(inputCol="features", outputCol="__scaled", withMean=True)] if scale else []
    model = Pipeline(stages=[*stages, estimator]).fit(index.transform(data))
    from pyspark.ml import PipelineModel

    return MlClassifier(PipelineModel(stages=[*model.stages, IndexToString(inputCol="__index", outputCol="__name", labels=index.labels)]), probabilities)


@dataclass
class PairwiseSupport:
    """Scaled columns, a separating plane for each pair of classes, and the class that most of them choose."""

    classes: list[str]
    centre: np.ndarray
    scale: np.ndarray
    planes: np.ndarray

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]

    def predict(self, df: DataFrame, y: str) -> DataFrame:
        """Votes and prediction of each row, of equal votes the first class; there are no probabilities."""
        first, second = (np.eye(len(self.classes))[[pair[k] for pair in self.pairs()]].reshape(-1, len(self.classes)) for k in (0, 1))

        def fn(x):
            side = (x - self.centre) / self.scale @ self.planes[:, 1:].T + self.planes[:, 0] > 0
            return side @ first + ~side @ second

        names = F.array(*[F.lit(c) for c in self.classes])
        out = map_rows(df, y, "votes", fn).withColumn("probability", F.lit(None).cast("array<double>"))
        return out.withColumn("prediction", _best(names, "votes"))


def _hinge(data: DataFrame, planes: np.ndarray, first: np.ndarray, second: np.ndarray, soft: float) -> tuple[np.ndarray, np.ndarray]:
    """Hinge losses, rounded off within `soft` of the corner, of all planes over the rows of their two classes, and the gradients."""

    def run(batches):
        out = np.zeros((len(planes), planes.shape[1] + 1))
        for batch in batches:
            label, x = batch.column(0).to_numpy()[:, None], rectangle(batch.column(1))
            sign = (label == first).astype(float) - (label == second)
            short = 1 - sign * (x @ planes[:, 1:].T + planes[:, 0])
            near = np.clip((short + soft) / (2 * soft), 0, 1)
            out[:, 0] += (np.where(short > soft, short, soft * near**2) * (sign != 0)).sum(axis=0)
            slope = -sign * near
            out[:, 1] += slope.sum(axis=0)
            out[:, 2:] += slope.T @ x
        yield pa.record_batch([pa.array(np.arange(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    rows = data.mapInArrow(run, "i int, row array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).orderBy("i").collect()
    out = np.array([r["row"].toArray() for r in rows])
    return out[:, 0], out[:, 1:]


def _descent(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction by the last moves and the changes of the gradient along them."""
    q, used = gradient.copy(), []
    for s, y in reversed(moves):
        share = (s @ q) / (s @ y)
        used.append(share)
        q -= share * y
    if moves:
        s, y = moves[-1]
        q *= (s @ y) / (y @ y)
    else:
        q /= max(np.linalg.norm(q), 1.0)
    for (s, y), share in zip(moves, reversed(used), strict=True):
        q += (share - (y @ q) / (s @ y)) * s
    return -q


def svm(train: Spectra, cost: float = 1.0, passes: int = 150, tolerance: float = 1e-3, soft: float = 0.05) -> PairwiseSupport:
    """Linear C-classification on scaled columns, one plane for each pair of classes.

    Each pass over the data gives losses and gradients of all planes that still move, a row a plane for the driver;
    each plane takes its own quasi-Newton steps. The corner of the hinge is rounded off within `soft`, which raises
    the loss of a row by soft / 4 at most. Rows without group or spectrum are left out.
    """
    known = train.df.where(F.col("group").isNotNull() & train.y.isNotNull())
    classes = [r[0] for r in known.select("group").distinct().orderBy("group").collect()]  # classes, not rows
    if not classes:
        raise ValueError("no spectrum with a group")
    _, centre, cov = moments(known, train.stage)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[~(scale > 0)] = 1
    model = PairwiseSupport(classes, centre, scale, np.zeros((0, len(centre) + 1)))
    pairs = model.pairs()
    model.planes = w = np.zeros((len(pairs), len(centre) + 1))
    if not pairs:
        return model
    names = F.array(*[F.lit(c) for c in classes])
    labelled = known.select((F.array_position(names, F.col("group")) - 1).cast("int").alias("label"), train.y.alias("y"))
    data = stored(map_rows(labelled, "y", "x", lambda x: (x - centre) / scale).select("label", "x"))
    first, second = np.array(pairs).T

    def objective(planes, at):
        loss, slope = _hinge(data, planes, first[at], second[at], soft)
        flat = planes.copy()
        flat[:, 0] = 0
        return (flat**2).sum(axis=1) / 2 + cost * loss, flat + cost * slope

    value, slope = objective(w, np.arange(len(pairs)))
    stop = tolerance * np.maximum(np.abs(slope).max(axis=1), 1e-12)
    moves: list[list] = [[] for _ in pairs]
    way, step = np.array([_descent(g, []) for g in slope]), np.ones(len(pairs))
    for _ in range(passes):
        at = np.flatnonzero((np.abs(slope).max(axis=1) > stop) & (step > 1e-8))
        if not len(at):
            break
        tried = w[at] + step[at, None] * way[at]
        new, g = objective(tried, at)
        for k, i in enumerate(at):
            if new[k] > value[i] + 1e-4 * step[i] * (slope[i] @ way[i]):
                step[i] /= 2
                continue
            change = (tried[k] - w[i], g[k] - slope[i])
            if change[0] @ change[1] > 1e-12 * (change[1] @ change[1]):
                moves[i] = [*moves[i][-9:], change]
            w[i], value[i], slope[i] = tried[k], new[k], g[k]
            way[i], step[i] = _descent(slope[i], moves[i]), 1.0
    return model


def random_forest(train: Spectra, trees: int = 100, mtry: int = 2, seed: int = 42) -> MlClassifier:
    from pyspark.ml.classification import RandomForestClassifier

    return _pipeline(train, RandomForestClassifier(numTrees=trees, featureSubsetStrategy=str(mtry), seed=seed, maxDepth=10, cacheNodeIds=True, labelCol="label", predictionCol="__index", probabilityCol="__p", rawPredictionCol="__raw"), False, True)


def _together(spark, fit, of) -> list:
    """fit of each. A forest's fit is many short jobs with waits between them, so several go on at a time."""
    with ThreadPool(max(1, min(len(of), FITS))) as pool:
        return [f.get() for f in [pool.apply_async(inheritable_thread_target(spark)(partial(fit, k))) for k in of]]


def forest_votes(df: DataFrame, trees: int = 50, folds: int = 5, seed: int = 42, y: str = "raw_data") -> DataFrame:
    """Out-of-fold class probabilities: each row is judged by the forest that did not see its fold."""
    from .markers import balanced_folds

    data = df.join(balanced_folds(df, folds, seed).select("spectrum_id", "fold"), "spectrum_id")

    def judged(f: int) -> DataFrame:
        train = Spectra.of(data.where(F.col("fold") != f).withColumnRenamed(y, "raw_data"), [0.0])
        return random_forest(train, trees, seed=seed).predict(data.where(F.col("fold") == f).withColumnRenamed(y, "raw_data"), "raw_data").select("spectrum_id", "group", "fold", "prediction", "probability")

    return reduce(DataFrame.unionByName, _together(df.sparkSession, judged, range(1, folds + 1)))


def forest_out_of_bag(s: Spectra, trees: int = 500, bags: int = 10, mtry: int | None = None, seed: int = 42) -> DataFrame:
    """Out-of-bag votes: (spectrum_id, group, votes, probability, prediction), classes in alphabetical order.

    Each bag holds a row with the probability of a bootstrap, 1 - 1/e, by a hash of its id, and has an equal share of
    the trees; a row's votes are those of the bags that left it out. Rows in all bags have null votes. Trees vote by
    the shares of classes in their leaves. `mtry` columns are tried in a split, the square root of all by default.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    data = s.df.where(F.col("group").isNotNull() & s.y.isNotNull()).select("spectrum_id", "group", array_to_vector(s.stage).alias("features"))
    index = StringIndexer(inputCol="group", outputCol="label", stringOrderType="alphabetAsc").fit(data)
    data = stored(index.transform(data))
    names, spark = F.array(*[F.lit(c) for c in index.labels]), data.sparkSession
    bags = max(2, min(bags, trees))
    left = [F.pmod(F.xxhash64("spectrum_id", F.lit(b), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) / np.e) for b in range(bags)]

    def grown(b: int) -> Trees:
        many = trees // bags + (b < trees % bags)
        forest = RandomForestClassifier(numTrees=many, featureSubsetStrategy=str(mtry) if mtry else "sqrt", seed=seed + b, maxDepth=10, cacheNodeIds=True)
        return Trees.of(spark, forest.fit(data.where(~left[b])), len(index.labels))

    found = _together(spark, grown, range(bags))
    out = left_out_votes(data.select("spectrum_id", "group", F.array(*left).alias("left"), vector_to_array("features").alias("y")), found, len(index.labels))
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
    known = out.select("spectrum_id", "group", F.when(total > 0, F.col("votes")).alias("votes"))
    known = known.withColumn("probability", F.transform("votes", lambda v: v / total))
    return known.withColumn("prediction", _best(names, "probability"))


@dataclass
class LinearModel:
    """value = bias + y . weights."""

    weights: np.ndarray
    bias: float
    kind: str
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, y: str) -> DataFrame:
        from ..spectra import literal

        value = F.lit(float(self.bias)) + F.aggregate(F.zip_with(y, literal(self.weights), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return df.withColumn("prediction", value)


def group_number(group="group"):
    """The first run of digits in the group's name."""
    return F.try_to_number(F.regexp_extract(group, "[0-9]+", 0), F.lit("999999999999")).cast("double")


def _normal(train: Spectra) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray, float]:
    data = train.df.withColumn("__t", group_number())
    n, sums, cross = gram(data, train.stage, ("__t",))
    m = sums / n
    c = (cross - n * np.outer(m, m)) / (n - 1)
    return n, m[:-1], float(m[-1]), c[:-1, :-1], c[:-1, -1], float(c[-1, -1])


def pls(train: Spectra, n_comp: int = 8) -> LinearModel:
    """PLS1 on scaled columns, from one pass of cross products (SIMPLS)."""
    _, m, t, c, b, _ = _normal(train)
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    s, r = c / np.outer(d, d), b / d
    basis, weights, coef = [], [], np.zeros(len(r))
    left = r.copy()
    for _ in range(min(n_comp, len(r))):
        w = left / max(np.linalg.norm(left), 1e-300)
        size = np.sqrt(max(w @ s @ w, 0))
        if size < 1e-12 or np.linalg.norm(left) < 1e-14:
            break
        w = w / size
        p = s @ w
        v = p.copy()
        for _ in range(2):
            for q in basis:
                v = v - q * (q @ v)
        v = v / np.linalg.norm(v)
        basis.append(v)
        weights.append(w)
        coef = coef + w * (w @ r)
        left = left - v * (v @ left)
        for q in basis:
            left = left - q * (q @ left)
    coef = coef / d
    return LinearModel(coef, t - m @ coef, "pls", {"components": len(weights)})


def mlr(train: Spectra, n_pc: int = 20) -> LinearModel:
    """Least squares on scaled components, as weights of the columns."""
    n, m, t, c, b, v = _normal(train)
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    w, vec = components(c / np.outer(d, d), min(n_pc, len(d)))
    coef = vec @ ((vec.T @ (b / d)) / np.maximum(w, 1e-12)) / d
    return LinearModel(coef, t - m @ coef, "mlr", {"residual_variance": (v - coef @ b) * (n - 1) / max(1, n - len(w) - 1)})


def glm(train: Spectra, n_pc: int = 20) -> LinearModel:
    """The Gaussian model with identity link: least squares."""
    model = mlr(train, n_pc)
    return LinearModel(model.weights, model.bias, "glm", model.extra)


def predict(model, s: Spectra) -> DataFrame:
    """Predictions of any model of this module, by spectrum."""
    return model.predict(s.df, s.stage)
