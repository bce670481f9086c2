"""How good predicted label sets and values are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.functions import scalars


def _flags(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, label, t, p) with 1 where the label is true and where it is predicted."""
    rows = truth.select("doc_id", "label", F.lit(1).alias("t"), F.lit(0).alias("p")).union(predicted.select("doc_id", "label", F.lit(0), F.lit(1)))
    return rows.groupBy("doc_id", "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))


def document_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, n_true, n_predicted, n_correct, precision, recall, f1), 0 where a denominator is."""
    n = _flags(truth, predicted).groupBy("doc_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_predicted"), F.sum(F.col("t") * F.col("p")).alias("n_correct"))
    scored = n.withColumn("precision", scalars.precision(F.col("n_correct"), F.col("n_predicted"))).withColumn("recall", scalars.precision(F.col("n_correct"), F.col("n_true")))
    return scored.withColumn("f1", scalars.f1(F.col("precision"), F.col("recall")))


def macro_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_docs"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def document_details(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, correct, missing, wrong): sorted lists joined with commas."""
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return _flags(truth, predicted).groupBy("doc_id").agg(listed(F.expr("t = 1 and p = 1")).alias("correct"), listed(F.expr("t = 1 and p = 0")).alias("missing"), listed(F.expr("t = 0 and p = 1")).alias("wrong"))


def label_report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, n_docs, correct, wrong, missing, precision, recall, f1, impact) of each label; impact = (wrong % + missing %) x documents."""
    flags = _flags(truth, predicted)
    n = flags.groupBy("label").agg(
        F.sum("t").alias("n_docs"), F.sum(F.expr("t * p")).alias("correct"), F.sum(F.expr("(1 - t) * p")).alias("wrong"), F.sum(F.expr("t * (1 - p)")).alias("missing")
    )
    p = scalars.precision(F.col("correct"), F.col("correct") + F.col("wrong"))
    r = scalars.precision(F.col("correct"), F.col("correct") + F.col("missing"))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("n_docs")), F.lit(0.0))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", scalars.f1(F.col("precision"), F.col("recall"))).withColumn("impact", (share("wrong") + share("missing")) * F.col("n_docs"))


def unseen_labels(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(label): true labels that are never a candidate."""
    return truth.select("label").distinct().join(candidates.select("label").distinct(), "label", "left_anti")


def weighted_f1(per_label: DataFrame) -> DataFrame:
    """(weighted_f1): the mean of f1 by n_docs."""
    return per_label.agg(F.try_divide(F.sum(F.col("n_docs") * F.col("f1")), F.sum("n_docs")).alias("weighted_f1"))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n)."""
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def regression_scores(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """(mse, r2): mean squared error, and the squared correlation."""
    d = F.col(y) - F.col(predicted)
    return rows.agg(F.avg(d * d).alias("mse"), F.pow(F.corr(y, predicted), 2).alias("r2"))


def laplace_scale(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """(scale): the mean absolute residual, leaving out those beyond five deviations of a first estimate."""
    r = rows.select(F.abs(F.col(y) - F.col(predicted)).alias("r"))
    first = r.agg(F.avg("r").alias("mae"))
    return r.join(F.broadcast(first)).where(F.col("r") <= 5 * F.sqrt(F.lit(2.0)) * F.col("mae")).agg(F.avg("r").alias("scale"))
