import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquern.operators import classify, cluster, labels, metrics, scaling, svm, text, topics, vectors


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "cell\ncell tumor"), (2, "mouse\ntumor"), (3, None), (4, "")], "doc_id long, text string")


def test_term_weights(docs):
    counts = text.weighted_counts(docs)
    tf = {(r.doc_id, r.term): r.weight for r in text.weigh(counts, "tfidf").collect()}
    bm = {(r.doc_id, r.term): r.weight for r in text.weigh(counts, "bm25").collect()}
    assert tf == pytest.approx({(1, "cell"): 0.250858, (1, "tumor"): 0, (2, "mouse"): 0.240824, (2, "tumor"): 0}, abs=1e-6)
    assert bm == pytest.approx({(1, "cell"): 0, (1, "tumor"): -0.641257, (2, "mouse"): 0, (2, "tumor"): -0.698970}, abs=1e-6)
    assert text.corpus_stats(counts).first().avgdl == 5 and text.corpus_stats(counts, True).first().avgdl == 5.5
    assert text.corpus_stats(counts.limit(0)).first().avgdl is None


def test_training_rows_stay_where_they_are(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(d, f"f{f}", 1.0) for d in range(40) for f in rng.sample(range(30), rng.randint(1, 9))], "doc_id long, feature string, value double")
    targets = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, y int")
    one, two = (sorted(map(tuple, classify.training_matrix(rows, targets, unique=u).collect())) for u in (True, False))
    assert one == two and one
    assert _exchanges(classify.training_matrix(rows, targets, unique=True)) == 2  # both broadcast; rows aren't shuffled
    assert "ShuffledHashJoin" in rows.join(classify.met(targets, 1), "doc_id", "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_weights_move_once_for_their_ranks(spark):
    weights = spark.createDataFrame([(d, f"t{i}", round(i % 3 / 7, 12)) for d in range(3) for i in range(6)], "doc_id long, term string, weight double")
    ranked = text.top_terms(weights, 3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Sort ")  # nothing is sorted before it
    assert sorted((r.doc_id, r.rank, r.term) for r in ranked.collect()) == [(d, k + 1, t) for d in range(3) for k, t in enumerate(("t2", "t5", "t1"))]


def test_equal_vectors_are_assigned_once(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"f{f}", float(x)) for i in range(60) for f, x in [((0, 1), (1, 2)), ((1, 1), (2, 1)), ((2, 3), (0, 1), (3, 1)), ((4, 1),)][rng.randrange(4)]]
    v = spark.createDataFrame(rows, "vec_id long, feature string, value double")
    kinds, members = cluster.alike(v)
    assert kinds.select("vec_id").distinct().count() == 4 and kinds.select("vec_id", "n").distinct().agg(F.sum("n")).first()[0] == 60 == members.count()
    sets = lambda df: sorted(sorted(map(str, r.m)) for r in df.groupBy("cluster_id").agg(F.collect_list("vec_id").alias("m")).collect())
    values = lambda df: {(r.cluster_id, r.feature): r.value for r in df.collect()}
    found = [(cluster.kmeans(v, 3, 3, 2), cluster.leader(v, 0.5, 2))]
    monkeypatch.setattr(cluster, "KINDS", 0)
    found.append((cluster.kmeans(v, 3, 3, 2), cluster.leader(v, 0.5, 2)))
    for one, two in zip(*found):
        assert sets(one[0]) == sets(two[0]) and values(one[1]) == pytest.approx(values(two[1]))
        assert sum(map(len, sets(one[0]))) == 60


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_counts_need_no_shuffle_and_rows_of_one_document_meet(spark, monkeypatch):
    texts = ["Cats cat\nrunning RUNS, ran", None, "", "\n", "one line Ünï 12 a1-b2 İX ΑΣ", "t\nno\nnew", "a a a\na\u00a0b\u2003c_d", "!!"]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(text, "ROWS", 2)
    monkeypatch.setattr(text, "STEMS", 2)
    for given in ({}, {"with_length": True}, {"stemmed": True}, {"stemmed": True, "with_length": True}, {"title_weight": 1}):
        counts = text.weighted_counts(once, **given)
        assert _exchanges(counts) == 0
        with monkeypatch.context() as m:
            m.setattr(text, "once_each", lambda docs: False)
            meeting = text.weighted_counts(once, **given)
            assert counts.dtypes == meeting.dtypes and rows(counts) == rows(meeting)
    counts = text.weighted_counts(once, with_length=True)
    assert _exchanges(text.inverted_index(counts.select("doc_id", "term", F.lit(1.0).alias("weight")), several=False)) == 0
    twice = spark.createDataFrame([(1, "a\nb"), (1, "b\nc"), (2, "b")], "doc_id long, text string")
    assert rows(text.weighted_counts(twice).select("doc_id", "term", "tf")) == rows(spark.createDataFrame([(1, "a", 4), (1, "b", 5), (1, "c", 1), (2, "b", 4)], "doc_id long, term string, tf long"))
    assert {r.doc_id: r.dl for r in text.weighted_counts(twice, with_length=True).collect()} == {1: 10, 2: 4}
    weights = {(r.doc_id, r.term): r.weight for r in text.weigh(text.weighted_counts(twice, with_length=True), docs=twice).collect()}
    assert weights[1, "a"] == pytest.approx(0.4 * math.log10(3)) and len(weights) == 4


def test_conditionals_are_consistent(spark):
    rng = random.Random(1)
    pairs = spark.createDataFrame([(d, f"l{x}") for d in range(40) for x in rng.sample(range(6), 3)], "doc_id long, label string")
    p = {r.label: r.p for r in labels.probability(pairs).collect()}
    for r in labels.conditional(pairs).collect():
        assert r.p_a_given_b * p[r.label_b] == pytest.approx(r.p_b_given_a * p[r.label_a]) == pytest.approx(r.p_ab)


def _random_vectors(spark, n=30):
    rng = random.Random(2)
    return spark.createDataFrame([(i, f"f{f}", rng.random()) for i in range(n) for f in rng.sample(range(20), 4)], "vec_id long, feature string, value double")


def test_histogram_counts_all_pairs(spark):
    v = _random_vectors(spark)
    for kind in ("cosine", "jaccard"):
        pairs = vectors.similarity_pairs(v, kind)
        assert pairs.where("similarity < 0 or similarity > 1.0000001 or src >= dst").isEmpty()
        assert sum(r.n_pairs for r in vectors.histogram(pairs, v).collect()) == 30 * 29 // 2


def test_kmeans_and_leader_place_each_vector_once(spark):
    v = _random_vectors(spark)
    membership, centres = cluster.kmeans(v, 3, iterations=4, smallest=1)
    assert membership.count() == membership.select("vec_id").distinct().count() == 30
    again, _ = cluster.kmeans(v, 3, iterations=2, smallest=1, start=centres)
    assert again.count() == 30
    placed, _ = cluster.leader(v, 0.4, rounds=1)
    assert placed.count() == placed.select("vec_id").distinct().count() == 30
    assert cluster.keep_threshold(1000, 20) == 500
    tree = cluster.tree(centres.withColumn("cluster_id", F.col("cluster_id")), roots=1).collect()
    assert sum(r.parent is None for r in tree) == 1
    merged = cluster.merge_similar(centres, 0.0).collect()
    assert {r.merged_id for r in merged} == {min(r.cluster_id for r in merged)}
    assert cluster.content_hash(v).first() == cluster.content_hash(v.orderBy("value")).first()


def test_metrics(spark):
    truth = spark.createDataFrame([(1, x) for x in "abc"] + [(2, "a")], "doc_id long, label string")
    guess = spark.createDataFrame([(1, x) for x in "bcde"], "doc_id long, label string")
    s = {r.doc_id: r for r in metrics.document_scores(truth, guess).collect()}
    assert (s[1].precision, s[1].recall, s[1].f1) == pytest.approx((0.5, 2 / 3, 0.571429), abs=1e-6) and (s[2].precision, s[2].recall, s[2].f1) == (0, 0, 0)
    assert [tuple(r)[1:] for r in metrics.document_details(truth, guess).where("doc_id = 1").collect()] == [("b,c", "a", "d,e")]
    report = {r.label: r for r in metrics.label_report(truth, guess).collect()}
    assert (report["a"].missing, report["d"].wrong, report["b"].correct) == (2, 1, 1)
    assert [r.label for r in metrics.unseen_labels(truth, guess).collect()] == ["a"]
    assert [tuple(r) for r in classify.oracle_predict(guess, truth).orderBy("label").collect()] == [(1, "b"), (1, "c")]


@pytest.fixture(scope="module")
def tiny(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (2, "y", 1.0), (3, "y", 1.0)], "doc_id long, feature string, value double")
    return rows, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, y int")


def test_naive_bayes(tiny):
    rows, targets = tiny
    priors, model = classify.nb_train(rows, targets)
    assert {r.y: r.prior for r in priors.collect()} == pytest.approx({0: 1 / 3, 1: 2 / 3})
    assert {(r.y, r.feature): r.likelihood for r in model.collect()} == pytest.approx({(1, "x"): 0.651515, (1, "y"): 0.348485, (0, "x"): 0.115385, (0, "y"): 0.884615}, abs=1e-6)
    out = {r.doc_id: r.predicted for r in classify.nb_predict(rows, targets, (priors, model)).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_vector_similarity_keeps_the_unrooted_form(tiny):
    rows, targets = tiny
    model = classify.vs_train(rows, targets)
    out = {r.doc_id: (round(r.similarity, 6), r.predicted) for r in classify.vs_predict(rows, model).collect()}
    assert out == {1: (0.4, 1), 2: (0.3, 0), 3: (0.2, 0)}


def test_stratified_sample_keeps_shares(spark):
    t = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, y int")
    n = {r.y: r["count"] for r in classify.stratified_sample(t, 40).groupBy("y").count().collect()}
    assert n == {0: 30, 1: 10}


def test_scalers(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 5.0)], "id long, feature string, value double")
    lin = {(r.id, r.feature): r.value for r in scaling.minmax(rows, scaling.minmax_model(rows)).collect()}
    assert lin == {(1, "a"): -1.0, (2, "a"): 1.0, (1, "b"): 0.0, (2, "b"): 0.0}
    z = {(r.id, r.feature): r.value for r in scaling.zscore(rows, scaling.zscore_model(rows)).collect()}
    assert z == {(1, "a"): -1.0, (2, "a"): 1.0, (1, "b"): 0.0, (2, "b"): 0.0}
    assert {r.feature: (r.low, r.high) for r in scaling.minmax_model(rows, 3).collect()} == {"a": (0.0, 3.0), "b": (0.0, 5.0)}


def test_topic_parts():
    w = np.array([[0, 1, 0.5], [1, 0, 0], [0.5, 0, 0]])
    assert topics.rank(w) == pytest.approx([1.441651, 0.988899, 0.569450], abs=1e-6)
    assert topics.rank(np.zeros((1, 1))) == pytest.approx([0.15])
    assert topics.dice("ion exchange", "ion exchanger") == 50.0
    assert [sorted(t) for t in topics.merge_topics([("ion exchange", 0), ("cell", 3), ("ion exchanger", 5), ("ion exchange", 9)])] == [["ion exchange", "ion exchanger"], ["cell"]]
    assert topics.affinity([[0, 4], [2]])[0, 1] == 1.0


def test_noun_phrases_and_ranks(spark):
    docs = spark.createDataFrame([(1, "The protein kinase is a kinase of the cell."), (2, None)], "doc_id long, text string")
    found = topics.noun_phrases(topics.tag(docs))
    assert [(r.phrase, r.pos) for r in found.orderBy("pos").collect()] == [("protein kinase", 1), ("kinase", 5), ("cell", 8)]
    ranks = {r.phrase: r.score for r in topics.topic_rank(found).collect()}
    assert ranks["protein kinase"] == ranks["kinase"]


def test_phrases_and_terms_straight_from_texts(spark, monkeypatch):
    texts = ["The Cell grows. Big tumor cells, of the mouse!", None, "", "...", "of the", "X ΑΣ İx\n\u00e9t\u00e9 a1 don't", "tail noun"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for at_once, most in ((topics.AT_ONCE, topics.ROWS), (5, 2)):
        monkeypatch.setattr(topics, "AT_ONCE", at_once)
        monkeypatch.setattr(topics, "ROWS", most)
        tagged = topics.tag(docs)
        assert tagged.count() == len(texts)
        assert rows(topics.tagged_phrases(docs)) == rows(topics.noun_phrases(tagged))
        kept = tagged.select("doc_id", F.posexplode("tokens")).where(~F.col("col.pos").isin(*topics.scalars.DROP_TAGS))
        assert rows(topics.tagged_terms(docs)) == rows(kept.select("doc_id", "pos", F.lower("col.token")))


def test_convolution_gives_the_ranks_of_affinities(monkeypatch):
    monkeypatch.setattr(topics, "DENSE", 0)
    rng = random.Random(3)
    cases = [[[3]], [[3, 9]], [[5], [5]], [[5], [5], [5, 5]], [[7], [7, 8]], [list(range(0, 3000, 2)), [1], [2999, 3001]]]
    cases += [[sorted(rng.choices(range(n * 3), k=rng.randint(1, 5))) for _ in range(n)] for n in (2, 20, 150)]
    for places in cases:
        assert topics.rank_places(places) == pytest.approx(topics.rank(topics.affinity(places)), rel=1e-9)


def test_topics_of_a_long_document(spark):
    rng = random.Random(4)
    names = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(1, 5))) for _ in range(300)]
    known: list[tuple[str, int]] = []  # phrases with their topics, found by comparing each with all before
    for p in dict.fromkeys(names):
        near = [t for v, t in known if topics.dice(v, p) > topics.SIMILAR]
        known.append((p, min(near, default=len({t for _, t in known}))))
    found = topics.merge_topics([(p, i) for i, p in enumerate(names)])
    assert {p: i for i, t in enumerate(found) for p in t} == dict(known)
    phrases = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string")), F.concat(F.lit("c"), "id"), F.lit("x")).alias("phrase"), F.col("id").cast("int").alias("pos"))
    began = time.perf_counter()
    assert topics.topic_rank(phrases).count() == 6000
    assert time.perf_counter() - began < 30  # each pair of topics had arrays of its own before


def test_concepts_of_a_large_block(spark):
    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("abc"), F.col("id").cast("string")).alias("term"))
    entries = topics.dictionary(rows.select("term").union(rows.select(F.concat("term", F.lit("x y")))).union(rows.where("doc_id < 5").select(F.concat("term", F.lit(" "), F.lit("tail")))).union(rows.where("doc_id >= 11998").select(F.concat("term", F.lit(" tail"))))).where("term not in ('abc11998', 'abc11999')")
    began = time.perf_counter()
    got = topics.match_concepts(rows, entries).groupBy("token", "concept").count().collect()
    assert len(got) == 12000 and {r.concept for r in got if r.token in ("abc11998", "abc11999")} == {"abc11998 tail", "abc11999 tail"}
    assert time.perf_counter() - began < 40  # all pairs of a block were compared before


def test_pagerank_matches_dense_rank(spark):
    w = np.array([[0, 1, 0.5], [1, 0, 0.25], [0.5, 0.25, 0]])
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(i)], "src long, dst long, weight double")
    got = {r.node: r.rank for r in topics.weighted_pagerank(edges).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(topics.rank(w).tolist())


def test_basket_pagerank_makes_no_edges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(d, f"l{x}") for d in range(60) for x in rng.sample(range(12), rng.randint(1, 4))] + [(99, "alone"), (100, None)]
    pairs = spark.createDataFrame(rows, "doc_id long, label string")
    edges = topics.basket_pagerank(pairs.where("label is not null"), nodes=1)
    expected = {r.node: r.rank for r in edges.collect()}
    monkeypatch.setattr(labels, "pair_counts", None)
    got = {r.node: r.rank for r in topics.basket_pagerank(pairs).collect()}
    assert got == pytest.approx(expected) and "alone" not in got
    assert topics.basket_pagerank(pairs.where("label = 'alone'")).collect() == []


def test_concepts(spark):
    tokens = spark.createDataFrame([(1, 0, "ring"), (1, 1, "ringer"), (1, 2, "zzz")], "doc_id long, pos int, term string")
    entries = topics.dictionary(spark.createDataFrame([("Ring",), ("ring ringer",), (None,)], "term string"))
    assert sorted((r.token, r.concept) for r in topics.match_concepts(tokens, entries).collect()) == [("ring", "ring"), ("ringer", "ring ringer")]
    lines = spark.createDataFrame([(1, "[{u'term': u'cell', x}, {u'term': u'cell'}]"), (2, "")], "doc_id long, line string")
    assert [tuple(r) for r in topics.tool_concepts(lines).collect()] == [(1, "cell", 2)]
    left = topics.remaining(spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "doc_id long, n_lines long"), lines)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(m, 0.6, (25, 2)) for m in ((0, 0), (4, 0), (0, 4))])
    return x, np.repeat([0, 1, 2], 25)


def test_svm_family(blobs):
    x, y = blobs
    two = y < 2
    a, b = x[two], y[two]
    for fit in (svm.c_svc, lambda p, q: svm.c_svc(p, q, 1.0, svm.rbf(0.5)), lambda p, q: svm.nu_svc(p, q, 0.2), lambda p, q: svm.c_svc(p, q, weights={1: 2.0}, redistribute=True), lambda p, q: svm.c_svc(p, q, 1.0, svm.polynomial(2, 1.0, 1.0))):
        assert (fit(a, b).predict(a) == b).mean() >= 0.98
    gram = a @ a.T
    numbers = np.arange(len(a))[:, None].astype(float)
    pre = svm.c_svc(numbers, b, 1.0, svm.precomputed(gram))
    assert pre.decide(numbers) == pytest.approx(svm.c_svc(a, b).decide(a))
    with pytest.raises(ValueError):
        svm.c_svc(a, np.ones(len(a)))
    with pytest.raises(ValueError):
        svm.nu_svc(a, b, 1.5)
    inside = svm.one_class(a, 0.2, svm.rbf(0.5)).predict(a).mean()
    assert 0.65 <= inside <= 0.95


def test_svm_matches_the_known_maximum_margin():
    m = svm.c_svc(np.array([[0.0, 0], [0, 1], [2, 0], [2, 1]]), np.array([0, 0, 1, 1]), 100.0)
    assert m.decide(np.array([[0.0, 0.5], [1, 0.5], [2, 0.5]])) == pytest.approx([-1, 0, 1], abs=1e-2)


def test_regression_and_probability(blobs):
    t = np.linspace(0, 3, 40)[:, None]
    for fit in (svm.epsilon_svr(t, 2 * t[:, 0] + 1, 10.0, 0.05), svm.nu_svr(t, 2 * t[:, 0] + 1, 10.0, 0.5)):
        assert np.abs(fit.decide(t) - (2 * t[:, 0] + 1)).max() < 0.15
    f = np.linspace(-2, 2, 50)
    a, b = svm.platt_fit(f, (f > 0).astype(int))
    p = svm.platt_predict(f, a, b)
    assert (np.diff(p) > 0).all() and p[0] < 0.1 < 0.9 < p[-1]
    x, y = blobs
    grid = svm.grid_search(x[y < 2], y[y < 2], [0.1, 1.0], {"linear": svm.linear}, 3)
    assert grid[0][2] >= 0.95 and svm.confusion([1, 0, 1, 0], [1, 1, 0, 0]) == {"tp": 1, "fp": 1, "fn": 1, "tn": 1}


def test_multiclass_modes(blobs):
    x, y = blobs
    m = svm.multi(x, y, probability=True)
    for one in ("none", "best", "break_ties"):
        assert (np.array(m.predict(x, one)) == y).mean() > 0.9
    for every in ("none", "filtered_vs_all", "filtered_vs_filtered"):
        got = m.predict(x, "none", every)
        assert np.mean([g == t for g, t in zip(got, y)]) > 0.7
    far = m.predict(np.array([[1.4, 1.4], [50.0, 50.0]]), "veto")
    assert all(v is None or v in (0, 1, 2) for v in far)
    p = m.probabilities(x)
    assert p.sum(axis=1) == pytest.approx(np.ones(75)) and (p.argmax(axis=1) == y).mean() > 0.9
    assert (m.vote_quality(x) > 0.5).all()


def test_svm_on_frames(spark, blobs):
    x, y = blobs
    rows = spark.createDataFrame([(int(i), k, [float(v) for v in x[i]], int(y[i] == k)) for i in range(75) for k in range(3)], "doc_id long, label int, features array<double>, y int")
    models = svm.train_models(rows)
    out = svm.decide(rows.where("label = 0"), models)
    assert out.count() == 225 and models.count() == 3


def test_svm_tools(spark, blobs):
    from pyspark.ml.linalg import Vectors

    from textquern.operators import svm_tools

    x, y = blobs
    rows = spark.createDataFrame([(1.0 if k else -1.0, Vectors.dense(v)) for v, k in zip(x[:50].tolist(), y[:50].tolist())], ["label", "features"])
    out = svm_tools.predict(rows, svm_tools.train(rows))
    assert svm_tools.evaluate(out, False).first().accuracy > 0.97
    line = spark.createDataFrame([(2.0 * t / 10, Vectors.dense([t / 10])) for t in range(30)], ["label", "features"])
    fit = svm_tools.predict(line, svm_tools.train(line, "epsilon_svr", c=10.0, epsilon=0.05))
    assert svm_tools.evaluate(fit, True).first().r2 > 0.99
    with pytest.raises(ValueError):
        svm_tools.train(rows, "other")


def test_concept_rank(spark):
    tagged = topics.tag(spark.createDataFrame([(1, "A cell and a ring of the cell.")], "doc_id long, text string"))
    entries = topics.dictionary(spark.createDataFrame([("cell",), ("ring",), ("and",)], "term string"))
    assert sorted(r.phrase for r in topics.concept_rank(tagged, entries).collect()) == ["cell", "ring"]


def test_grow_until_stops():
    assert classify.grow_until(lambda n: (n, n / 10), range(1, 20))[2] == 10
    assert not math.isnan(classify.ALPHA)
