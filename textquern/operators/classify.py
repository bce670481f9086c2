"""Binary classifiers per label, trained by aggregation, and the training sets they need.

Training rows are (doc_id, feature, value) with targets (doc_id, y), y in 0 and 1. All classifiers
work for many labels at once if the targets have a column `label`; these take one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquern.session import cut

ALPHA = 0.15


def stratified_sample(targets: DataFrame, n: int, by: str = "y", key: str = "doc_id") -> DataFrame:
    """At most about n rows, exactly round(n x share) of each class, in the order of a hash of their ids."""
    order = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    sizes = targets.groupBy(by).agg(F.count("*").alias("_k"))
    total = targets.agg(F.count("*").alias("_n"))
    ranked = targets.withColumn("_r", F.row_number().over(order)).join(F.broadcast(sizes), by).join(F.broadcast(total))
    return ranked.where(F.col("_r") <= F.round(F.lit(float(n)) * F.col("_k") / F.col("_n"))).drop("_r", "_k", "_n")


def met(rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """A small side of a join, of a few numbers or a word a row: broadcast up to `most` rows, counted first, else the hash table of a shuffle."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows.hint("shuffle_hash")


def band_select(rows: DataFrame, targets: DataFrame, low: float = 0.3, high: float = 1.5, unique: bool = False) -> DataFrame:
    """(feature): those whose document frequency lies between low and high times the number of positives.

    `unique` rows are of the targets' documents alone and have each feature of a document once.
    """
    positives = targets.agg(F.sum("y").alias("pos"))
    if unique:
        df = rows.groupBy("feature").agg(F.count("*").alias("df"))
    else:
        df = rows.join(targets.select("doc_id"), "doc_id", "left_semi").groupBy("feature").agg(F.count_distinct("doc_id").alias("df"))
    return df.join(F.broadcast(positives)).where((F.col("df") > low * F.col("pos")) & (F.col("df") < high * F.col("pos"))).select("feature", "df")


def training_matrix(rows: DataFrame, targets: DataFrame, n: int | None = None, unique: bool = False) -> DataFrame:
    """(doc_id, y, feature, value): sampled documents with the features of the band; `unique` as in `band_select`."""
    chosen = stratified_sample(targets, n) if n else targets
    band = met(band_select(rows, targets, unique=unique).select("feature"), 1 << 17)
    return rows.join(band, "feature", "left_semi").join(met(chosen), "doc_id").select("doc_id", "y", "feature", "value")


# ---- naive Bayes
def nb_train(rows: DataFrame, targets: DataFrame, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """((y, prior), (y, feature, likelihood)): unsmoothed priors; documents of the class with the word, smoothed by alpha.

    Only positive weights count here; every feature has a likelihood in both classes.
    """
    total = targets.agg(F.count("*").alias("n"))
    priors = targets.groupBy("y").agg(F.count("*").alias("k")).join(F.broadcast(total)).select("y", (F.col("k") / F.col("n")).alias("prior"))
    hits = rows.where("value > 0").join(targets, "doc_id").groupBy("feature").agg(F.sum(F.col("y")).alias("k1"), F.sum(1 - F.col("y")).alias("k0"))
    vocabulary = rows.select("feature").distinct()
    counted = vocabulary.join(hits, "feature", "left").select("feature", F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.coalesce(f"k{y}", F.lit(0).cast("long")).alias("k")) for y in (0, 1)))).alias("s")).select("feature", "s.y", "s.k")
    sums = counted.groupBy("y").agg(F.sum("k").alias("all"), F.count("*").alias("v"))
    likelihood = (F.col("k") + alpha) / (F.col("all") + alpha * F.col("v"))
    return priors, counted.join(F.broadcast(sums), "y").select("y", "feature", likelihood.alias("likelihood"))


def nb_predict(rows: DataFrame, docs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, score0, score1, predicted): log prior plus log likelihoods over weights other than 0; 1 wins ties, a score must be below 0."""
    priors, likelihoods = model
    wide = likelihoods.groupBy("feature").agg(*(F.max(F.when(F.col("y") == y, F.log("likelihood"))).alias(f"l{y}") for y in (0, 1)))
    base = priors.agg(*(F.max(F.when(F.col("y") == y, F.log("prior"))).alias(f"p{y}") for y in (0, 1)))
    sums = rows.where("value <> 0").join(wide, "feature").groupBy("doc_id").agg(F.sum("l0").alias("s0"), F.sum("l1").alias("s1"))
    zero = F.lit(0.0)
    scored = docs.select("doc_id").join(sums, "doc_id", "left").join(F.broadcast(base)).select("doc_id", *((F.coalesce(f"s{y}", zero) + F.col(f"p{y}")).alias(f"score{y}") for y in (0, 1)))
    return scored.withColumn("predicted", F.when((F.round("score1", 9) >= F.round("score0", 9)) & (F.col("score1") < 0), 1).otherwise(0))


# ---- vector similarity
def vs_similarity(rows: DataFrame, centre: DataFrame, true_cosine: bool = False) -> DataFrame:
    """(doc_id, similarity) to the class vector (feature, value): dot / (|a|^2 |b|^2), or with square roots if `true_cosine`."""
    power = 0.5 if true_cosine else 1.0
    norm = rows.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("a"))
    total = centre.agg(F.sum(F.col("value") * F.col("value")).alias("b"))
    dots = rows.join(centre.select("feature", F.col("value").alias("c")), "feature").groupBy("doc_id").agg(F.sum(F.col("value") * F.col("c")).alias("dot"))
    both = norm.join(dots, "doc_id", "left").join(F.broadcast(total))
    return both.select("doc_id", F.coalesce(F.try_divide(F.coalesce("dot", F.lit(0.0)), F.pow("a", F.lit(power)) * F.pow("b", F.lit(power))), F.lit(0.0)).alias("similarity"))


def vs_train(rows: DataFrame, targets: DataFrame, true_cosine: bool = False) -> tuple[DataFrame, DataFrame]:
    """((feature, value), (threshold)): the sum of the positives, and the largest similarity of one to it."""
    positive = rows.join(targets.where("y = 1").select("doc_id"), "doc_id", "left_semi")
    centre = positive.groupBy("feature").agg(F.sum("value").alias("value"))
    return centre, vs_similarity(positive, centre, true_cosine).agg(F.max("similarity").alias("threshold"))


def vs_predict(rows: DataFrame, model: tuple[DataFrame, DataFrame], true_cosine: bool = False) -> DataFrame:
    """(doc_id, similarity, predicted)."""
    scored = vs_similarity(rows, model[0], true_cosine).join(F.broadcast(model[1]))
    return scored.select("doc_id", "similarity", F.when(F.round("similarity", 12) >= F.round("threshold", 12), 1).otherwise(0).alias("predicted"))


# ---- Spark ML
def linear_svc(vectors: DataFrame, c: float = 1.0, iterations: int = 100):
    """A fitted linear SVM on (features, y); refuses one-class data."""
    from pyspark.ml.classification import LinearSVC

    n, kinds = vectors.agg(F.count("*"), F.count_distinct("y")).first()
    if kinds < 2:
        raise ValueError("a support vector machine needs two classes")
    return LinearSVC(labelCol="y", regParam=1.0 / (c * n), standardization=False, maxIter=iterations, tol=1e-3).fit(vectors)


def perceptron(vectors: DataFrame, inputs: int, hidden: int = 20, iterations: int = 60):
    """A fitted network inputs-hidden-2 on (features, y)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol="y", layers=[inputs, hidden, 2], maxIter=iterations, seed=1).fit(vectors)


def one_vs_rest(vectors: DataFrame, iterations: int = 40):
    """A fitted one-vs-rest of linear SVMs on (features, label)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    return OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=1e-3), labelCol="label").fit(vectors)


def grow_until(train, sizes, accuracy: float = 0.9, tries: int = 100):
    """(model, accuracy, size): `train(size)` with growing sizes until its accuracy is high enough or sizes end."""
    best = None
    for _, size in zip(range(tries), sizes):
        model, found = train(size)
        best = (model, found, size)
        if found > accuracy:
            break
    return best


def accuracy(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """(n, correct, accuracy) of predictions (doc_id, predicted) against targets (doc_id, y)."""
    right = (F.col("predicted") == F.col("y")).cast("long")
    return predicted.join(targets, "doc_id").agg(F.count("*").alias("n"), F.sum(right).alias("correct"), F.avg(right).alias("accuracy"))


def document_features(rows: DataFrame, band: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, feature, value) of some documents (doc_id) over a label's selected features (feature)."""
    return rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").join(band.select("feature"), "feature", "left_semi").select("doc_id", "feature", "value")


def oracle_predict(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, label): candidates that are true, the best that a predictor on these candidates can do."""
    return candidates.join(truth.select("doc_id", "label"), ["doc_id", "label"], "left_semi")
