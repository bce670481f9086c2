"""Queries on functions and small operators, and chains of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.operators import classify, cluster, labels, metrics, text, topics, vectors
from textquern.plans.format_queries import _REGIONS, _regions
from textquern.plans.label_queries import _baskets, _predicted, _round, _truth
from textquern.plans.learning_queries import _training
from textquern.plans.registry import query
from textquern.plans.sql import BASKETS, BRANDS, DOC_LABELS, NATIONS, NB, PREDICTED, PROBABILITY, TRAINING, toks
from textquern.plans.vector_queries import _membership, brand_vectors, nation_vectors
from textquern.sources import corpus

# ---- functions
_TAGS = ("NN", "VBZ", "JJ", "DT", "NNS")


@query(f"""WITH t AS (SELECT p_partkey, w, {list(_TAGS)}[len(w) % 5 + 1] AS pos FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT pos, count(*) FILTER (pos IN ('NN', 'JJ', 'NNS')) AS kept, count(*) FILTER (pos NOT IN ('VBZ', 'DT')) AS not_dropped FROM t GROUP BY pos HAVING kept > 0""")
def tag_filters(read):
    """Words of part names, tagged by their length, through the keep list and the drop list."""
    tagged = read("part").select("p_partkey", F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("token"), F.element_at(F.array(*map(F.lit, _TAGS)), (F.length(w) % 5 + 1).cast("int")).alias("pos"))).alias("tokens"))
    one = tagged.select(F.explode(topics.keep_tags("tokens")).alias("t")).groupBy("t.pos").agg(F.count("*").alias("kept"))
    two = tagged.select(F.explode(topics.drop_tags("tokens")).alias("t")).groupBy("t.pos").agg(F.count("*").alias("not_dropped"))
    return one.join(two, "pos")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40")
def first_rows(read):
    """The operator itself: the first 40 rows by their key."""
    return text.first_n(read("customer").select("c_custkey", "c_name"), "c_custkey", 40)


@query("""WITH a AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS h FROM documents)
SELECT doc_id, CASE WHEN h < 0.1 THEN 'dev' WHEN h < 0.2 THEN 'test' ELSE 'train' END AS split FROM a""")
def corpus_split(read):
    return text.split_corpus(read("documents")).select("doc_id", "split")


@query("SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '')) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(read):
    return read("documents").select("doc_id", F.size(scalars.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n_sentences"))


@query("""SELECT p_partkey, lower(replace(p_name || ',' || p_brand, ',', ' ')) AS plain, replace(p_name || ',' || p_brand, ',', '&coma;') AS escaped, md5(p_name || chr(1) || p_brand) AS id,
  CAST(p_size AS DOUBLE) ** 5 AS fifth, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS y FROM part""")
def scalar_functions(read):
    """Label text, comma marks, content ids, whole powers and one-against-rest targets of parts."""
    both = F.concat_ws(",", "p_name", "p_brand")
    return read("part").select("p_partkey", scalars.commas_to_spaces(both).alias("plain"), scalars.escape_commas(both).alias("escaped"), scalars.content_id("p_name", "p_brand").alias("id"), scalars.power(F.col("p_size"), 5).alias("fifth"), scalars.against_rest("p_brand", "Brand#11").alias("y"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_partkey + l_suppkey AS BIGINT) AS whole, round(l_quantity + l_discount, 6) AS real FROM lineitem""")
def parsed_arrays(read):
    """Arrays of numbers from text."""
    add = lambda v, zero: F.aggregate(v, zero, lambda a, x: a + x)
    whole = scalars.int_array(F.concat_ws(", ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    real = scalars.float_array(F.concat_ws(" ", F.col("l_quantity").cast("string"), F.col("l_discount").cast("string")))
    return read("lineitem").select("l_orderkey", "l_linenumber", add(whole, F.lit(0).cast("long")).alias("whole"), F.round(add(real, F.lit(0.0)), 6).alias("real"))


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: substr(x, 1, 1)) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS firsts FROM w""")
def ordered_distinct(read):
    """First letters of a text's words, each where it first stands."""
    letters = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.substring(w, 1, 1))
    return read("documents").select("doc_id", F.array_join(scalars.distinct_in_order(letters), "|").alias("firsts"))


@query(f"""WITH {BRANDS}, one AS (SELECT feature, value AS x FROM vectors WHERE vec_id = (SELECT min(vec_id) FROM vectors))
SELECT vec_id, round(sqrt(sum((2 * coalesce(value, 0) - 0.5 * coalesce(x, 0)) ** 2)), 6) AS blended, max(CASE WHEN feature = '1' THEN coalesce(value, 0) ELSE 0 END) AS of_one, bool_or(feature = '1' AND value IS NOT NULL) AS has_one
FROM (SELECT v.vec_id, f.feature, value, x FROM (SELECT DISTINCT vec_id FROM vectors) v CROSS JOIN (SELECT DISTINCT feature FROM vectors) f LEFT JOIN vectors w ON w.vec_id = v.vec_id AND w.feature = f.feature LEFT JOIN one ON one.feature = f.feature) GROUP BY vec_id""")
def vector_functions(read):
    """Blends with one vector, single values and containment, on packed vectors."""
    maps = vectors.packed(brand_vectors(read))
    first = maps.orderBy("vec_id").limit(1).select(F.col("vector").alias("one"))
    rows = maps.join(F.broadcast(first))
    return rows.select("vec_id", F.round(scalars.map_length(scalars.map_blend("vector", "one", 2.0, -0.5)), 6).alias("blended"), scalars.map_get("vector", "1").alias("of_one"), scalars.has_feature("vector", "1").alias("has_one"))


# ---- vectors and matrices
@query(f"WITH {BRANDS} SELECT vec_id, feature, 2 * value AS value FROM vectors")
def vector_sums(read):
    v = brand_vectors(read)
    return vectors.add(v, v)


@query(f"""WITH {BRANDS} SELECT vec_id, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY feature) AS r FROM vectors WHERE NOT regexp_matches(feature, '[05]$')) WHERE r <= 7""")
def vectors_without(read):
    """Vectors less some features, seven entries of each at most."""
    v = brand_vectors(read)
    return vectors.subtract(v, v.select("feature").where(F.col("feature").rlike("[05]$")), 7)


@query(f"""WITH {BRANDS}, s AS (SELECT min(vec_id) AS seed FROM sizes), d AS (SELECT dst AS vec_id, similarity FROM cosines, s WHERE src = seed UNION ALL SELECT src, similarity FROM cosines, s WHERE dst = seed)
SELECT vec_id, round(coalesce(similarity, 0.0), 6) AS similarity FROM sizes LEFT JOIN d USING (vec_id), s WHERE vec_id <> seed""")
def similar_to_seed(read):
    v = brand_vectors(read)
    return vectors.similar_to(v, v.agg(F.min("vec_id")).first()[0]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {BRANDS} SELECT CAST(row_number() OVER (ORDER BY round(similarity, 9) DESC, src, dst) - 1 AS BIGINT) AS place, src, dst, round(similarity, 6) AS similarity FROM cosines")
def sorted_edges(read):
    """Edges from the most similar on; places come from the sorted partitions."""
    edges = vectors.sorted_edges(vectors.similarity_pairs(brand_vectors(read))).coalesce(1)
    return edges.select(F.monotonically_increasing_id().alias("place"), "src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {BRANDS} SELECT vec_id, string_agg(feature, ',' ORDER BY feature) AS features FROM vectors GROUP BY vec_id")
def sorted_features(read):
    return vectors.packed(brand_vectors(read)).select("vec_id", F.array_join(F.array_sort(F.map_keys("vector")), ",").alias("features"))


@query("""WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS v FROM orders GROUP BY ALL)
SELECT 'row' AS kind, r AS name, CAST(sum(v) AS BIGINT) AS total FROM c GROUP BY r UNION ALL SELECT 'column', c, CAST(sum(v) AS BIGINT) FROM c GROUP BY c
UNION ALL (SELECT 'largest', r || '/' || c, v FROM c ORDER BY v DESC, r, c LIMIT 1)""")
def matrix_sums(read):
    """Row sums, column sums and the largest cell of orders by priority and status."""
    cells = read("orders").groupBy(F.col("o_orderpriority").alias("r"), F.col("o_orderstatus").alias("c")).agg(F.count("*").alias("v"))
    rows, columns, best = vectors.matrix_sums(cells, "r", "c", "v")
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "total")
    return named(rows, "row", "row").union(named(columns, "column", "column")).union(best.select(F.lit("largest"), F.concat_ws("/", "row", "column"), "value"))


# ---- labels and evaluation
@query(f"""WITH {BASKETS}, {PROBABILITY}, x AS (SELECT min(p) AS lo, max(p) AS hi FROM probs)
SELECT label, CAST(row_number() OVER (ORDER BY p DESC, label) AS INTEGER) AS place, round(1 - (p - lo) / (hi - lo), 6) AS kmeans_weight, round(1 - (0.01 + 0.99 * (p - lo) / (hi - lo)), 6) AS hac_weight FROM probs, x""")
def ranked_labels(read):
    """Labels from the likeliest on, with the weights of the two other clusterers."""
    from pyspark.sql import Window

    p = labels.probability(_baskets(read))
    placed = p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), "label")))
    one, two = (labels.rarity_weights(p, k).withColumnRenamed("weight", f"{k}_weight") for k in ("kmeans", "hac"))
    return _round(placed.join(one, "label").join(two, "label").select("label", "place", "kmeans_weight", "hac_weight"), "kmeans_weight", "hac_weight")


@query(f"""WITH {DOC_LABELS}, {PROBABILITY}, x AS (SELECT min(p) AS lo, max(p) AS hi FROM probs)
SELECT doc_id AS vec_id, label AS feature, round(1.5 - (0.5 + 0.5 * (p - lo) / (hi - lo)), 6) AS value FROM pairs JOIN probs USING (label), x""")
def label_vectors(read):
    pairs = labels.document_labels(read("documents"), read("labels"))
    return _round(labels.label_vectors(pairs, labels.rarity_weights(labels.probability(pairs))), "value")


@query(f"""WITH {DOC_LABELS}, w AS (SELECT doc_id, list_distinct({toks("coalesce(text, '')")}) AS words FROM documents),
p AS (SELECT substr(label, 5) AS label, list_filter(regexp_split_to_array(lower(substr(label, 5)), '[ ,]+'), lambda x: x <> '') AS parts, words FROM pairs JOIN w USING (doc_id) WHERE label LIKE 'src:%'),
m AS (SELECT label, CAST(len(list_filter(parts, lambda x: list_contains(words, x))) + CASE WHEN len(parts) > 2 THEN 1 ELSE 0 END >= len(parts) AS BIGINT) AS m FROM p)
SELECT label, count(*) AS n_docs, CAST(sum(m) AS BIGINT) AS n_mentioned, round(sum(m) / count(*), 6) AS ratio FROM m GROUP BY label""")
def label_occurrence(read):
    """For every source, its documents and those whose text has its name."""
    pairs = labels.document_labels(read("documents"), read("labels")).where(F.col("label").startswith("src:")).select("doc_id", F.expr("substr(label, 5)").alias("label"))
    return _round(labels.occurrence(pairs, read("documents")), "ratio")


@query(f"WITH {PREDICTED} SELECT doc_id, CAST(rank() OVER (ORDER BY round(f1, 9) DESC) AS INTEGER) AS place, round(f1, 6) AS f1 FROM prf1")
def ranked_documents(read):
    """Documents from the best F1 on; equal ones share a place."""
    scores = metrics.document_scores(_truth(read), _predicted(read)).withColumn("key", F.round("f1", 9))
    by_score = scores.groupBy("key").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    # places from the few distinct scores, so that no window holds all documents
    above = by_score.withColumn("place", (F.coalesce(F.sum("n").over(Window.orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int"))
    return scores.join(above, "key").select("doc_id", "place", F.round("f1", 6).alias("f1"))


@query(f"""WITH {NATIONS}, {_REGIONS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, cluster_id) AS rank FROM sims) WHERE rank <= 2),
model AS (SELECT DISTINCT cluster_id, label FROM names JOIN membership USING (vec_id)),
cand AS (SELECT DISTINCT vec_id, label FROM near JOIN model USING (cluster_id)), pred AS (SELECT cand.* FROM cand JOIN names USING (vec_id, label)),
f AS (SELECT vec_id, label, max(t) AS t, max(p) AS p, max(c) AS c FROM (SELECT vec_id, label, 1 AS t, 0 AS p, 0 AS c FROM names UNION ALL SELECT vec_id, label, 0, 1, 0 FROM pred UNION ALL SELECT vec_id, label, 0, 0, 1 FROM cand) GROUP BY ALL),
s AS (SELECT vec_id, sum(t) AS nt, sum(p) AS np, sum(t * p) AS nc, sum(c) AS n_candidates FROM f GROUP BY vec_id)
SELECT count(*) AS n_docs, round(avg(CASE WHEN np = 0 THEN 0 ELSE nc / np END), 6) AS "precision", round(avg(nc / nt), 6) AS recall, CAST(sum(n_candidates) AS BIGINT) AS n_candidates FROM s""")
def evaluation_chain(read):
    """Nearest clusters, their labels as candidates, the predictor that knows the truth, and macro scores: in one plan."""
    v, truth = nation_vectors(read), _regions(read)
    centres, model = cluster.label_model(v, truth, _membership(v))
    candidates = cluster.candidates(cluster.nearest(v, centres, 2), model).withColumnRenamed("vec_id", "doc_id")
    scores = metrics.macro_scores(metrics.document_scores(truth, classify.oracle_predict(candidates, truth)))
    return _round(scores.join(F.broadcast(candidates.agg(F.count("*").alias("n_candidates")))).select("n_docs", "precision", "recall", "n_candidates"), "precision", "recall")


@query(f"""WITH {NB}, wide AS (SELECT feature, max(CASE WHEN y = 0 THEN ln(likelihood) END) AS l0, max(CASE WHEN y = 1 THEN ln(likelihood) END) AS l1 FROM model GROUP BY feature),
s AS (SELECT doc_id, sum(l0) AS s0, sum(l1) AS s1 FROM rows JOIN wide USING (feature) WHERE value <> 0 GROUP BY doc_id),
b AS (SELECT max(CASE WHEN y = 0 THEN ln(prior) END) AS p0, max(CASE WHEN y = 1 THEN ln(prior) END) AS p1 FROM priors),
f AS (SELECT doc_id, y, coalesce(s0, 0) + p0 AS score0, coalesce(s1, 0) + p1 AS score1 FROM targets LEFT JOIN s USING (doc_id), b)
SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS correct, round(avg(r), 6) AS accuracy FROM (SELECT CASE WHEN (round(score1, 9) >= round(score0, 9) AND score1 < 0) = (y = 1) THEN 1 ELSE 0 END AS r FROM f)""")
def training_accuracy(read):
    """How often naive Bayes is right on the documents it was trained on."""
    rows, targets = _training(read)
    return _round(classify.accuracy(classify.nb_predict(rows, targets, classify.nb_train(rows, targets)), targets), "accuracy")


@query(f"""WITH {TRAINING}, pos AS (SELECT sum(y) AS pos FROM targets),
band AS (SELECT feature, count(DISTINCT doc_id) AS df FROM rows GROUP BY feature HAVING count(DISTINCT doc_id) > 0.3 * (SELECT pos FROM pos) AND count(DISTINCT doc_id) < 1.5 * (SELECT pos FROM pos))
SELECT doc_id, feature, value FROM rows SEMI JOIN band USING (feature) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def document_features(read):
    """Vectors of the toxic documents over the selected features of quality."""
    rows, targets = _training(read)
    return classify.document_features(rows, classify.band_select(rows, targets, unique=True), read("labels").where("toxic = 1").select("doc_id"))


# ---- topics and concepts
@query(f"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id AS doc_id, unnest(w) AS topic, unnest(range(0, len(w))) AS pos FROM t)
SELECT x.doc_id, x.topic AS a, y.topic AS b, round(sum(1.0 / abs(x.pos - y.pos)), 6) AS weight FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.topic < y.topic AND x.pos <> y.pos GROUP BY ALL""")
def position_affinity(read):
    """How close the words of each benchmark item stand to each other."""
    places = text.tokenize(read("benchmark").select(F.col("item_id").alias("doc_id"), "text")).select("doc_id", F.col("term").alias("topic"), "pos")
    return _round(topics.affinity_edges(places), "weight")


@query("""WITH e AS (SELECT DISTINCT lower(trim(p_name)) AS concept, substr(lower(trim(p_name)), 1, 3) AS prefix FROM part),
t AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS term FROM part),
s AS (SELECT term, concept, 200.0 * len(list_filter(string_split(concept, ' '), lambda w: w = term)) / (1 + len(string_split(concept, ' '))) AS dice, term = concept AS exact FROM t JOIN e ON substr(term, 1, 3) = prefix),
k AS (SELECT term, bool_or(exact) AS any_exact FROM s WHERE exact OR dice > 30 GROUP BY term)
SELECT term AS token, concept FROM s JOIN k USING (term) WHERE (exact OR dice > 30) AND (NOT any_exact OR exact)""")
def concept_fuzzy(read):
    """Single words of part names against the names as entries: exact, else by common words in their block."""
    words = read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct().select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("pos"), "term")
    entries = topics.dictionary(read("part").select(F.col("p_name").alias("term")))
    return topics.match_concepts(words, entries).select("token", "concept")


_TOOL = """c AS (SELECT CAST(page_id % 20 AS BIGINT) AS doc_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS term, count(*) AS tf FROM pages GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM c GROUP BY doc_id), n AS (SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) // count(*) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM c GROUP BY term)"""


def _tool_lines(read):
    return read("pages").select((F.col("page_id") % 20).alias("doc_id"), F.concat(F.lit("[{u'term': u'"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit("', u'similarity': 1.0}]")).alias("line"))


@query(f"WITH {_TOOL} SELECT doc_id, term, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * log10((n - df + 0.5) / (df + 0.5)), 6) AS weight FROM c JOIN d USING (doc_id) JOIN f USING (term), n")
def concept_bm25(read):
    """BM25 over the concepts that an external tool found."""
    counts = topics.tool_concepts(_tool_lines(read)).select("doc_id", F.col("concept").alias("term"), F.col("n").alias("tf"))
    return _round(text.weigh(counts, "bm25"), "weight")


@query("WITH l AS (SELECT CAST(page_id % 20 AS BIGINT) AS doc_id, count(*) AS n_parsed FROM pages GROUP BY 1), i AS (SELECT doc_id, n_parsed + doc_id % 2 AS n_lines FROM l) SELECT doc_id, n_lines FROM i JOIN l USING (doc_id) WHERE n_lines <> n_parsed")
def remaining_inputs(read):
    """Inputs whose tool output isn't whole: every second one expects a line more."""
    lines = _tool_lines(read)
    inputs = lines.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", (F.col("n") + F.col("doc_id") % 2).alias("n_lines"))
    return topics.remaining(inputs, lines)


@query()
def concept_rank(read):
    """Ranks of dictionary concepts in all documents."""
    entries = topics.dictionary(read("documents").select(F.explode(F.slice(F.split(F.coalesce("text", F.lit("")), "\\s+"), 1, 3)).alias("term")).where("length(term) > 6"))
    return topics.rank_concepts(topics.tagged_terms(read("documents")), entries)


# ---- clusters, by rounds that SQL can unroll
def _rounds(n: int) -> str:
    parts = ["c0 AS MATERIALIZED (SELECT * FROM centres)"]
    for k in range(n):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT vec_id, cluster_id, sum(v.value * c.value) / (any_value(length) * any_value(size)) AS similarity
  FROM vectors v JOIN c{k} c USING (feature) JOIN vsizes USING (vec_id) JOIN (SELECT cluster_id, sqrt(sum(value * value)) AS size FROM c{k} GROUP BY cluster_id) z USING (cluster_id) GROUP BY vec_id, cluster_id)""")
        parts.append(f"m{k} AS MATERIALIZED (SELECT vec_id, arg_max(cluster_id, (round(similarity, 9), -cluster_id)) AS cluster_id FROM s{k} GROUP BY vec_id)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster_id, feature, sum(value) AS value FROM vectors JOIN m{k} USING (vec_id) GROUP BY ALL)")
    return ",\n".join(parts)


@query(f"WITH {NATIONS}, {_rounds(3)} SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id FROM m2")
def kmeans_rounds(read):
    """Three rounds from given centroids."""
    v = nation_vectors(read)
    return cluster.kmeans(v, 4, 3, 1, cluster.centroids(v, _membership(v)))[0].select("vec_id", F.col("cluster_id").cast("int").alias("cluster_id"))


@query(f"WITH {NATIONS}, {_rounds(3)} SELECT cluster_id, feature, round(value, 6) AS value FROM c3")
def kmeans_resumed(read):
    """One round, then two more from the centroids it left, written and read again."""
    from textquern.plans.registry import scratch

    v, path = nation_vectors(read), scratch(read)
    corpus.write_table(cluster.kmeans(v, 4, 1, 1, cluster.centroids(v, _membership(v)))[1], path)
    saved = corpus.read_table(read("region").sparkSession, path)
    return _round(cluster.kmeans(v, 4, 2, 1, saved)[1].select(F.col("cluster_id").cast("long").alias("cluster_id"), "feature", "value"), "value")


@query(f"""WITH RECURSIVE {BRANDS}, near AS (SELECT src AS a, dst AS b FROM cosines WHERE similarity > 0.35 UNION ALL SELECT dst, src FROM cosines WHERE similarity > 0.35 UNION ALL SELECT vec_id, vec_id FROM sizes),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS cluster_id, min(b) AS merged_id FROM reach GROUP BY a""")
def merged_clusters(read):
    """Clusters of one brand each, put together where their centroids are similar."""
    v = brand_vectors(read)
    return cluster.merge_similar(cluster.centroids(v, v.select("vec_id").distinct().withColumn("cluster_id", F.col("vec_id"))), 0.35)
