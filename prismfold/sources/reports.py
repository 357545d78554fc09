"""Tab-separated reports of forests: summary, probabilities, mislabelling, importances and confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.markers import mislabel_scores
from ..operators.stats import class_errors, contingency
from .files import write_tsv


def forest_summary(votes: DataFrame, trees: int, error_type: str = "oob", label: str = "group", predicted: str = "prediction") -> DataFrame:
    """(item, value): error with its deviation, the error of guessing the largest class, their ratio, and the number of trees.

    Rows without a prediction are left out. The ratio is null where there is no error.
    """
    known = votes.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    wrong = (F.col(label) != F.col(predicted)).cast("double")
    n, largest = F.sum("n"), F.max("n")
    one = known.groupBy(label).agg(F.count("*").alias("n"), F.sum(wrong).alias("w")).agg(n.alias("n"), (F.sum("w") / n).alias("error"), (1 - largest / n).alias("base"))
    deviation = F.sqrt(F.try_divide(F.col("n") * F.col("error") * (1 - F.col("error")), F.col("n") - 1))
    text = lambda c: F.format_string("%.5f", c)
    # The items of the report.
    rows = [
        ("Model", F.lit("Random Forest")), ("Error type", F.lit(error_type)), ("Estimated error", text(F.col("error"))), ("Standard deviation", text(deviation)),
        ("Baseline error (for random guessing)", text(F.col("base"))), ("Ratio baseline error to observed error", F.when(F.col("error") > 0, text(F.col("base") / F.col("error")))), ("Number of trees", F.lit(str(trees))),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in rows])))


def probability_table(votes: DataFrame, classes: list[str], probabilities: str = "probability") -> DataFrame:
    """A row for each spectrum, a column for each class."""
    return votes.select(F.col("spectrum_id").alias("SampleID"), *[F.element_at(probabilities, i + 1).alias(c) for i, c in enumerate(classes)])


def mislabel_table(votes: DataFrame, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return mislabel_scores(votes.withColumn("label", F.array_position(names, F.col("group")).cast("int") - 1)).withColumnRenamed("spectrum_id", "SampleID")


def importance_table(importances: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Importances from the largest on, only those above the cutoff where there is one; a row for each axis point."""
    kept = importances if cutoff is None else importances.where(F.col("importance") > cutoff)
    return kept.orderBy(F.desc("importance"), "pos").select(F.col("wavenumber").alias("Feature_id"), F.col("importance").alias("Mean_decrease_in_accuracy"))


def confusion_table(votes: DataFrame, label: str = "group", predicted: str = "prediction") -> DataFrame:
    """Counts of true (rows) by predicted classes, and the class error."""
    known = votes.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    classes = sorted({r[0] for r in known.select(label).union(known.select(predicted)).distinct().collect()})  # classes, not rows
    wide = contingency(known, label, predicted).groupBy(label).pivot(predicted, classes).agg(F.first("n")).fillna(0, classes)
    return wide.join(F.broadcast(class_errors(known, label, predicted).select(label, F.col("error").alias("Class error"))), label).withColumnRenamed(label, "True\\Predicted")


def save_forest(votes: DataFrame, importances: DataFrame, classes: list[str], folder: str, trees: int, error_type: str = "oob") -> None:
    """The five reports as folders of tab-separated files below a folder; votes as of forest_out_of_bag."""
    write_tsv(forest_summary(votes, trees, error_type).coalesce(1), f"{folder}/summary")
    write_tsv(probability_table(votes, classes), f"{folder}/cv_probabilities", order=["SampleID"])
    write_tsv(mislabel_table(votes, classes), f"{folder}/mislabeling", order=["SampleID"])
    write_tsv(importance_table(importances).coalesce(1), f"{folder}/feature_importance_scores")
    write_tsv(confusion_table(votes).coalesce(1), f"{folder}/confusion_matrix")


def save_importances(importances: DataFrame, folder: str, cutoff: float = 0.002) -> None:
    """All importances and those above the cutoff, each sorted."""
    write_tsv(importance_table(importances).coalesce(1), f"{folder}/All_sorted")
    write_tsv(importance_table(importances, cutoff).coalesce(1), f"{folder}/cutoff_sorted")
