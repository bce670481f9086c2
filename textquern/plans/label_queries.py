"""Queries on label sets and on predicted labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.operators import labels, metrics
from textquern.plans.registry import query
from textquern.plans.sql import BASKETS, DOC_LABELS, PREDICTED, PROBABILITY, REPORT


def _docs(read):
    return labels.document_labels(read("documents"), read("labels"))


def _baskets(read):
    return labels.basket_labels(read("lineitem"))


def _round(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


@query(f"WITH {DOC_LABELS} SELECT doc_id, label FROM pairs")
def document_labels(read):
    return _docs(read)


@query(f"WITH {BASKETS} SELECT label, count(*) AS n_docs FROM pairs GROUP BY label")
def label_counts(read):
    return labels.label_counts(_baskets(read))


@query(f"WITH {BASKETS}, {PROBABILITY} SELECT label, round(p, 6) AS p FROM probs")
def label_probability(read):
    return _round(labels.probability(_baskets(read)), "p")


@query(f"""WITH {BASKETS}, k AS (SELECT doc_id FROM pairs GROUP BY doc_id HAVING count(*) > 1)
SELECT label, round(count(*) / (SELECT count(DISTINCT doc_id) FROM pairs), 6) AS p FROM pairs SEMI JOIN k USING (doc_id) GROUP BY label""")
def label_probability_pairs_only(read):
    """Counting only documents of several labels."""
    return _round(labels.probability(_baskets(read), compat=True), "p")


@query(f"WITH {BASKETS} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_docs FROM pairs a JOIN pairs b USING (doc_id) WHERE a.label < b.label GROUP BY ALL")
def label_pairs(read):
    return labels.pair_counts(_baskets(read))


@query(f"""WITH {DOC_LABELS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM pairs), s AS (SELECT label, count(*) AS k FROM pairs GROUP BY label),
c AS (SELECT a.label AS label_a, b.label AS label_b, count(*) AS k FROM pairs a JOIN pairs b USING (doc_id) WHERE a.label < b.label GROUP BY ALL)
SELECT label_a, label_b, round(c.k / n, 6) AS p_ab, round(c.k / sb.k, 6) AS p_a_given_b, round(c.k / sa.k, 6) AS p_b_given_a
FROM c JOIN s sa ON sa.label = label_a JOIN s sb ON sb.label = label_b, n""")
def label_conditional(read):
    return _round(labels.conditional(_docs(read)), "p_ab", "p_a_given_b", "p_b_given_a")


@query(f"WITH {BASKETS}, {PROBABILITY} SELECT round(min(p), 6) AS p_min, round(max(p), 6) AS p_max FROM probs")
def label_extremes(read):
    return _round(labels.extremes(labels.probability(_baskets(read))), "p_min", "p_max")


@query(f"""WITH {BASKETS}, {PROBABILITY}, x AS (SELECT min(p) AS lo, max(p) AS hi FROM probs)
SELECT label, round(1.5 - (0.5 + 0.5 * (p - lo) / (hi - lo)), 6) AS rarity, round(1 - (p - lo) / (hi - lo), 6) AS kmeans, round(1 - (0.01 + 0.99 * (p - lo) / (hi - lo)), 6) AS hac FROM probs, x""")
def label_rarity_weight(read):
    p = labels.probability(_baskets(read))
    one, two, three = (labels.rarity_weights(p, k).withColumnRenamed("weight", k) for k in ("rarity", "kmeans", "hac"))
    return _round(one.join(two, "label").join(three, "label"), "rarity", "kmeans", "hac")


@query("SELECT n_nationkey AS doc_id, n_name AS label FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7')")
def check_tag_exclusion(read):
    return labels.without_check_tags(read("nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("label")), ("nation_3", "nation_7"))


def _truth(read):
    return _docs(read).where(F.col("label").startswith("lang:") | F.col("label").startswith("q:"))


def _predicted(read):
    """Labels guessed from words that a language uses, and from the number of distinct words."""
    words = read("documents").select("doc_id", F.array_distinct(scalars.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    rule = lambda word, label: F.when(F.array_contains("w", word), F.lit(label))
    guesses = F.array(rule("the", "lang:en"), rule("que", "lang:es"), rule("der", "lang:de"), rule("les", "lang:fr"), F.when(F.size("w") > 60, F.lit("q:1")))
    return words.select("doc_id", F.explode(guesses).alias("label")).where("label is not null")


@query(f'WITH {PREDICTED} SELECT doc_id, n_true, n_predicted, n_correct, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf1')
def doc_prf(read):
    return _round(metrics.document_scores(_truth(read), _predicted(read)), "precision", "recall", "f1")


@query(f'WITH {PREDICTED} SELECT count(*) AS n_docs, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM prf1')
def macro_prf(read):
    return _round(metrics.macro_scores(metrics.document_scores(_truth(read), _predicted(read))), "precision", "recall", "f1")


@query(f"""WITH {PREDICTED} SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE t = 1 AND p = 1), '') AS correct,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE t = 1 AND p = 0), '') AS missing, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE t = 0 AND p = 1), '') AS wrong FROM flags GROUP BY doc_id""")
def doc_details(read):
    return metrics.document_details(_truth(read), _predicted(read))


@query(f'WITH {REPORT} SELECT label, n_docs, correct, wrong, missing, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(impact, 4) AS impact FROM rep')
def label_report(read):
    rows = metrics.label_report(_truth(read), _predicted(read))
    return _round(rows.withColumn("impact", F.round("impact", 4)), "precision", "recall", "f1")


@query(f"WITH {REPORT} SELECT round(sum(n_docs * f1) / sum(n_docs), 6) AS weighted_f1 FROM rep")
def weighted_f1(read):
    return _round(metrics.weighted_f1(metrics.label_report(_truth(read), _predicted(read))), "weighted_f1")


@query(f"WITH {PREDICTED} SELECT DISTINCT label FROM truth WHERE label NOT IN (SELECT label FROM predicted)")
def unseen_labels(read):
    return metrics.unseen_labels(_truth(read), _predicted(read))


@query("""SELECT CAST(o_totalprice > 250000 AS INTEGER) AS label, CAST(o_orderpriority < '3' AS INTEGER) AS predicted, count(*) AS n FROM orders GROUP BY ALL""")
def confusion_matrix(read):
    rows = read("orders").select((F.col("o_totalprice") > 250000).cast("int").alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("p"))
    return metrics.confusion(rows, "y", "p")


@query("""WITH r AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem), m AS (SELECT avg(abs(y - p)) AS mae FROM r)
SELECT round(avg((y - p) * (y - p)) / 1e6, 4) AS mse_millions, round(corr(y, p) ** 2, 6) AS r2, (SELECT round(avg(abs(y - p)), 3) FROM r, m WHERE abs(y - p) <= 5 * sqrt(2) * mae) AS laplace FROM r""")
def regression_metrics(read):
    rows = read("lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("predicted"))
    scale = metrics.laplace_scale(rows).select(F.round("scale", 3).alias("laplace"))
    return metrics.regression_scores(rows).select(F.round(F.col("mse") / 1e6, 4).alias("mse_millions"), F.round("r2", 6).alias("r2")).join(F.broadcast(scale))
