"""Queries that train, predict, scale and search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.operators import classify, scaling, svm, text
from textquern.plans.registry import query, scratch
from textquern.plans.sql import NB, TRAINING, VS
from textquern.session import cut


def _training(read):
    targets = cut(read("labels").groupBy("doc_id").agg(F.max("quality").alias("y")))
    counts = text.weighted_counts(read("documents").join(classify.met(targets.select("doc_id")), "doc_id", "left_semi"))
    return counts.select("doc_id", F.col("term").alias("feature"), F.col("tf").cast("double").alias("value")), targets


@query(f"WITH {NB} SELECT y, feature, round(likelihood, 9) AS likelihood, round(prior, 6) AS prior FROM model JOIN priors USING (y)")
def nb_train(read):
    priors, model = classify.nb_train(*_training(read))
    return model.join(F.broadcast(priors), "y").select("y", "feature", F.round("likelihood", 9).alias("likelihood"), F.round("prior", 6).alias("prior"))


@query(f"""WITH {NB}, wide AS (SELECT feature, max(CASE WHEN y = 0 THEN ln(likelihood) END) AS l0, max(CASE WHEN y = 1 THEN ln(likelihood) END) AS l1 FROM model GROUP BY feature),
s AS (SELECT doc_id, sum(l0) AS s0, sum(l1) AS s1 FROM rows JOIN wide USING (feature) WHERE value <> 0 GROUP BY doc_id),
b AS (SELECT max(CASE WHEN y = 0 THEN ln(prior) END) AS p0, max(CASE WHEN y = 1 THEN ln(prior) END) AS p1 FROM priors),
f AS (SELECT doc_id, coalesce(s0, 0) + p0 AS score0, coalesce(s1, 0) + p1 AS score1 FROM targets LEFT JOIN s USING (doc_id), b)
SELECT doc_id, round(score0, 4) AS score0, round(score1, 4) AS score1, CASE WHEN round(score1, 9) >= round(score0, 9) AND score1 < 0 THEN 1 ELSE 0 END AS predicted FROM f""")
def nb_predict(read):
    rows, targets = _training(read)
    out = classify.nb_predict(rows, targets, classify.nb_train(rows, targets))
    return out.select("doc_id", F.round("score0", 4).alias("score0"), F.round("score1", 4).alias("score1"), "predicted")


@query(f"WITH {VS} SELECT feature, value, round(threshold * 1e6, 6) AS threshold_millionths FROM centre, threshold")
def vs_train(read):
    centre, threshold = classify.vs_train(*_training(read))
    return centre.join(F.broadcast(threshold)).select("feature", "value", F.round(F.col("threshold") * 1e6, 6).alias("threshold_millionths"))


@query(f"WITH {VS} SELECT doc_id, round(similarity * 1e6, 6) AS similarity_millionths, CASE WHEN round(similarity, 12) >= round(threshold, 12) THEN 1 ELSE 0 END AS predicted FROM sims, threshold")
def vs_predict(read):
    rows, targets = _training(read)
    out = classify.vs_predict(rows, classify.vs_train(rows, targets))
    return out.select("doc_id", F.round(F.col("similarity") * 1e6, 6).alias("similarity_millionths"), "predicted")


_BAND = f"""{TRAINING}, pos AS (SELECT sum(y) AS pos FROM targets),
band AS (SELECT feature, count(DISTINCT doc_id) AS df FROM rows GROUP BY feature HAVING count(DISTINCT doc_id) > 0.3 * (SELECT pos FROM pos) AND count(DISTINCT doc_id) < 1.5 * (SELECT pos FROM pos))"""


@query(f"WITH {_BAND} SELECT feature, df FROM band")
def feature_band_select(read):
    return classify.band_select(*_training(read), unique=True)


@query(f"WITH {_BAND} SELECT doc_id, y, feature, value FROM rows SEMI JOIN band USING (feature) JOIN targets USING (doc_id)")
def training_matrix(read):
    return classify.training_matrix(*_training(read), unique=True)


@query("""WITH t AS (SELECT doc_id, max(quality) AS y FROM labels GROUP BY doc_id), k AS (SELECT y, count(*) AS k FROM t GROUP BY y), n AS (SELECT count(*) AS n FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM t) SELECT doc_id, y FROM r JOIN k USING (y), n WHERE r <= round(100.0 * k / n)""")
def stratified_sample(read):
    """The sampling operator itself: 100 labelled documents in the classes' shares."""
    return classify.stratified_sample(read("labels").groupBy("doc_id").agg(F.max("quality").alias("y")), 100).select("doc_id", "y")


def _numbers(read):
    c = read("customer")
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in ("c_acctbal", "c_nationkey"))))
    return c.select(F.col("c_custkey").alias("id"), cells.alias("s")).select("id", "s.feature", "s.value")


_CELLS = "rows AS (SELECT c_custkey AS id, 'c_acctbal' AS feature, CAST(c_acctbal AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)"


@query(f"WITH {_CELLS}, m AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM rows GROUP BY feature) SELECT id, feature, round(-1 + 2 * (value - lo) / (hi - lo), 6) AS value FROM rows JOIN m USING (feature)")
def minmax_scale(read):
    rows = _numbers(read)
    return scaling.minmax(rows, scaling.minmax_model(rows)).select("id", "feature", F.round("value", 6).alias("value"))


@query(f"WITH {_CELLS}, m AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM rows GROUP BY feature) SELECT id, feature, round((value - mean) / sd, 6) AS value FROM rows JOIN m USING (feature)")
def zscore_scale(read):
    rows = _numbers(read)
    return scaling.zscore(rows, scaling.zscore_model(rows)).select("id", "feature", F.round("value", 6).alias("value"))


@query(f"WITH {_CELLS}, s AS (SELECT id, sqrt(sum(value * value)) AS size FROM rows GROUP BY id) SELECT id, feature, round(CASE WHEN size = 0 THEN 0 ELSE value / size END, 6) AS value FROM rows JOIN s USING (id)")
def unit_scale(read):
    return scaling.unit_length(_numbers(read)).select("id", "feature", F.round("value", 6).alias("value"))


#: Most rows that the fits below look at, in the order of a hash of their ids; every fitted model decides all rows.
FIT = 400


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * (i % 5 - 2))) - 0.25, 6) AS value FROM embeddings")
def svm_linear_decision(read):
    """Decision values of a linear model with fixed weights."""
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 5 - 2).cast("double"))
    model = read("region").limit(1).select(F.lit(0).alias("label"), weights.alias("weights"), F.lit(0.25).alias("rho"))
    return svm.linear_decisions(_points(read), model).select(F.col("doc_id").alias("vec_id"), F.round("value", 6).alias("value"))


def _points(read):
    return read("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"))


def _sample(rows, n: int = FIT):
    return rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)


@query()
def svm_smo(read):
    """One C-SVC for each label against the rest, trained side by side on a bounded sample; all vectors are decided."""
    rows = _sample(_points(read))
    names = rows.select(F.col("label").alias("k")).distinct()
    tasks = rows.join(F.broadcast(names)).select(F.col("k").alias("label"), "features", (F.col("label") == F.col("k")).cast("int").alias("y"))
    return svm.decide(_points(read), svm.train_models(tasks))


@query()
def svm_grid(read):
    """Cross-validated sensitivity of kernels and costs for one label against the rest, on a bounded sample: the search itself."""
    rows = _sample(_points(read)).select(F.lit(1).alias("g"), "features", scalars.against_rest("label", 0).alias("y"))

    def work(key, x, y, p):
        found = svm.grid_search(x, y, [0.1, 1.0, 10.0], {"linear": svm.linear, "rbf": svm.rbf(0.5)}, 3)
        return pd.DataFrame(found, columns=["kernel", "c", "sensitivity"])

    return svm.per_group(rows, ["g"], work, "kernel string, c double, sensitivity double")


@query()
def svm_multiclass(read):
    """One-vs-one and one-vs-all linear models of all labels, fitted on a bounded sample; votes on all vectors as tables."""
    rows = _sample(_points(read)).select(F.lit(1).alias("g"), "features", F.col("label").alias("y"))

    def work(key, x, y, p):
        m = svm.multi(x, y)
        named = [*((a, b, k) for (a, b), k in m.pairs.items()), *((a, None, k) for a, k in m.alone.items())]
        return pd.DataFrame({"a": [n[0] for n in named], "b": pd.array([n[1] for n in named], "Int32"), "rho": [n[2].rho for n in named], "weights": [(n[2].alpha @ n[2].sv).tolist() for n in named]})

    models = cut(svm.per_group(rows, ["g"], work, "a int, b int, rho double, weights array<double>"))
    decided = lambda df: svm.linear_decisions(_points(read), df)
    pairs = decided(models.where("b is not null").select(F.struct("a", "b").alias("label"), "weights", "rho")).select("doc_id", "label.a", "label.b", "value")
    alone = decided(models.where("b is null").select(F.col("a").alias("label"), "weights", "rho"))
    return svm.vote(pairs, alone, "break_ties")


def _ml(read):
    return read("embeddings").select(F.col("vec_id").alias("doc_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), scalars.against_rest("label", 0).cast("double").alias("y"))


@query()
def linear_svc(read):
    """One label against the rest: fitted on a bounded sample, applied to all."""
    rows = _ml(read)
    return classify.linear_svc(_sample(rows, 4000)).transform(rows).select("doc_id", "y", "prediction")


@query()
def neural_network(read):
    rows = _ml(read)
    return classify.perceptron(_sample(rows, 4000), 64).transform(rows).select("doc_id", "y", "prediction")


@query()
def one_vs_rest(read):
    """All labels."""
    rows = _ml(read)
    return classify.one_vs_rest(_sample(rows, 4000), 20).transform(rows).select("doc_id", "label", "prediction")


# ---- support vector machines whose solution is known in closed form
@query("""WITH x AS (SELECT DISTINCT p_brand AS brand, p_size AS s FROM part), g AS (SELECT brand, max(s) FILTER (s <= 25) AS lo, min(s) FILTER (s > 25) AS hi FROM x GROUP BY brand)
SELECT brand, round((lo + hi) / 2, 1) AS middle, CAST(hi - lo AS BIGINT) AS gap, CAST(1.0 AS DOUBLE) AS right_share FROM g WHERE lo IS NOT NULL AND hi IS NOT NULL""")
def svm_margins(read):
    """The widest border between small and large sizes of each brand, by SMO: it lies halfway between the closest two."""
    x = read("part").select(F.col("p_brand").alias("brand"), "p_size").distinct()
    both = x.groupBy("brand").agg(F.count_distinct(F.col("p_size") > 25).alias("k")).where("k = 2").select("brand")
    rows = x.join(both, "brand").select("brand", F.array(F.col("p_size").cast("double")).alias("features"), (F.col("p_size") > 25).cast("int").alias("y"))

    def work(key, x, y, p):
        m = svm.c_svc(x, y, 1e4)
        w = float(m.alpha @ m.sv[:, 0])
        return pd.DataFrame({"brand": [key[0]], "middle": [round(m.rho / w, 1)], "gap": [round(2 / w)], "right_share": [float((m.predict(x) == y).mean())]})

    return svm.per_group(rows, ["brand"], work, "brand string, middle double, gap long, right_share double")


@query("""WITH g AS (SELECT n_regionkey, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY 1)
SELECT n_regionkey, CAST(round(2 * (hi - lo) - 0.2, 1) AS DOUBLE) AS rise, CAST(round((lo + hi) + 1.0, 1) AS DOUBLE) AS at_middle FROM g WHERE hi > lo""")
def svr_lines(read):
    """Support vector regression of 2 x + 1 by region: the flattest line inside a tube of 0.1."""
    rows = read("nation").select("n_regionkey", F.array(F.col("n_nationkey").cast("double")).alias("features"), (2.0 * F.col("n_nationkey") + 1).alias("y"))

    def work(key, x, y, p):
        m = svm.epsilon_svr(x, y, 1e3, 0.1)
        ends = m.decide(np.array([[x.min()], [x.max()]]))
        return pd.DataFrame({"n_regionkey": [key[0]], "rise": [round(ends[1] - ends[0], 1)], "at_middle": [round(ends.mean(), 1)]})

    kind = dict(rows.dtypes)["n_regionkey"]
    return svm.per_group(rows, ["n_regionkey"], work, f"n_regionkey {kind}, rise double, at_middle double")


@query("SELECT vec_id, CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM embeddings")
def cross_folds(read):
    """The folds of cross validation."""
    fold = F.pandas_udf(lambda ids: pd.Series(svm.folds(ids, 5)), "int")
    return read("embeddings").select("vec_id", fold("vec_id").alias("fold"))


_SHIFTS = {(0, 1): 0.1, (0, 2): -0.1, (0, 3): 0.0, (1, 2): 0.1, (1, 3): 0.0, (2, 3): 0.0}
_BOARD = " UNION ALL ".join(f"SELECT vec_id, CASE WHEN e[{a + 1}] - e[{b + 1}] + {s} > 0 THEN {a} ELSE {b} END AS won, e[{a + 1}] > 0.05 AND e[{b + 1}] > 0.05 AS inside FROM e" for (a, b), s in _SHIFTS.items())


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS ({_BOARD}),
k AS (SELECT vec_id, e, unnest([0, 1, 2, 3]) AS label FROM e),
v AS (SELECT k.vec_id, label, e[label + 1] AS solo, e[label + 1] > 0.05 AS yes, count(won) AS votes, count(won) FILTER (inside) AS votes_inside FROM k LEFT JOIN p ON p.vec_id = k.vec_id AND won = label GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS plain, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, round(solo, 9) DESC, label) AS ties,
  row_number() OVER (PARTITION BY vec_id ORDER BY yes DESC, votes DESC, label) AS veto, row_number() OVER (PARTITION BY vec_id ORDER BY round(solo, 9) DESC, label) AS best, row_number() OVER (PARTITION BY vec_id ORDER BY yes DESC, votes_inside DESC, label) AS filtered FROM v)
SELECT vec_id, max(label) FILTER (plain = 1) AS plain, round(max(votes) FILTER (plain = 1) / 6, 6) AS quality, max(label) FILTER (ties = 1) AS ties, max(label) FILTER (veto = 1 AND yes) AS veto, max(label) FILTER (best = 1) AS best, max(label) FILTER (filtered = 1 AND yes) AS filtered FROM r GROUP BY vec_id""")
def svm_votes(read):
    """Voting on the decisions of fixed models over four classes: plain, ties broken, veto, best alone, filtered."""
    e = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.get("e", F.lit(a)) - F.get("e", F.lit(b)) + s).alias("value")) for (a, b), s in _SHIFTS.items()))
    pairs = e.select("doc_id", F.explode(sides).alias("s")).select("doc_id", "s.*")
    alone = e.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.get("e", F.lit(k)).alias("value")) for k in range(4)))).alias("s")).select("doc_id", "s.*")
    plain = svm.vote(pairs).select("doc_id", F.col("predicted").alias("plain"), F.round("quality", 6).alias("quality"))
    modes = {"ties": ("break_ties", "all"), "veto": ("veto", "all"), "best": ("best", "all"), "filtered": ("none", "filtered_vs_filtered")}
    for name, (one, every) in modes.items():
        plain = plain.join(svm.vote(pairs, alone, one, every, 0.05).select("doc_id", F.col("predicted").alias(name)), "doc_id")
    return plain.withColumnRenamed("doc_id", "vec_id")


@query("""WITH rows AS (SELECT c_custkey AS id, 'c_nationkey' AS feature, CAST(c_nationkey AS DOUBLE) AS value FROM customer WHERE c_nationkey <> 0 UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM customer),
m AS (SELECT feature, min(CASE WHEN feature = 'c_nationkey' THEN least(value, 0) ELSE value END) AS lo, max(value) AS hi FROM rows GROUP BY feature) SELECT id, feature, round((value - lo) / (hi - lo), 6) AS value FROM rows JOIN m USING (feature)""")
def scaled_with_saved_ranges(read):
    """Ranges learned with the zeros that sparse rows leave out, written, read again and applied."""
    from textquern.sources import corpus

    rows = _numbers(read).where("feature <> 'c_nationkey' or value <> 0")
    path = scratch(read)
    corpus.write_table(scaling.minmax_model(rows, read("customer").count()), path)
    ranges = corpus.read_table(read("region").sparkSession, path)
    return scaling.minmax(rows, ranges, 0.0, 1.0).select("id", "feature", F.round("value", 6).alias("value"))
