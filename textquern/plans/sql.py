"""Pieces of DuckDB SQL that several twins share."""


def toks(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


COUNTS = f"""
parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
tok AS (
  SELECT doc_id, unnest({toks("l[1]")}) AS term, 4 AS w FROM parts
  UNION ALL SELECT doc_id, unnest({toks("array_to_string(l[2:], chr(10))")}), 1 FROM parts),
counts AS (SELECT doc_id, term, CAST(sum(w) AS BIGINT) AS tf FROM tok GROUP BY ALL),
dls AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM counts GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n_docs, CAST(sum(dl) AS BIGINT) // (SELECT count(*) FROM documents) AS avgdl FROM dls),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term)"""

TFIDF = f"""{COUNTS},
weights AS (SELECT doc_id, term, tf / dl * log10(n_docs / df) AS weight FROM counts JOIN dls USING (doc_id) JOIN dfs USING (term), stats)"""

BM25 = f"""{COUNTS},
weights AS (SELECT doc_id, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * log10((n_docs - df + 0.5) / (df + 0.5)) AS weight
  FROM counts JOIN dls USING (doc_id) JOIN dfs USING (term), stats)"""

DOC_LABELS = """
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
pairs AS (SELECT DISTINCT doc_id, label FROM (
  SELECT doc_id, 'lang:' || lang AS label FROM documents UNION ALL SELECT doc_id, 'src:' || source FROM documents
  UNION ALL SELECT doc_id, 'q:' || quality FROM documents JOIN known USING (doc_id) UNION ALL SELECT doc_id, 'tox:' || toxic FROM documents JOIN known USING (doc_id)) WHERE label IS NOT NULL)"""

BASKETS = "pairs AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_suppkey AS VARCHAR) AS label FROM lineitem)"

PROBABILITY = "probs AS (SELECT label, count(*) / (SELECT count(DISTINCT doc_id) FROM pairs) AS p FROM pairs GROUP BY label)"

BRANDS = """
vectors AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS vec_id, CAST(l_suppkey AS VARCHAR) AS feature, CAST(count(*) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
sizes AS (SELECT vec_id, sqrt(sum(value * value)) AS length, count(*) AS names FROM vectors GROUP BY vec_id),
shared AS (SELECT a.vec_id AS src, b.vec_id AS dst, sum(a.value * b.value) AS dot, count(*) AS common
  FROM vectors a JOIN vectors b USING (feature) WHERE a.vec_id < b.vec_id GROUP BY ALL),
cosines AS (SELECT src, dst, dot / (x.length * y.length) AS similarity FROM shared JOIN sizes x ON src = x.vec_id JOIN sizes y ON dst = y.vec_id),
jaccards AS (SELECT src, dst, common / (x.names + y.names - common) AS similarity FROM shared JOIN sizes x ON src = x.vec_id JOIN sizes y ON dst = y.vec_id)"""

#: Vectors of customers' nations over order priorities and market segments, and four fixed clusters of them.
NATIONS = """
vectors AS (SELECT c_nationkey AS vec_id, feature, CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT c_nationkey, 'seg:' || c_mktsegment AS feature FROM customer
  UNION ALL SELECT c_nationkey, 'pri:' || o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT c_nationkey, 'sup:' || (l_suppkey % 40) FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL),
membership AS (SELECT DISTINCT vec_id, vec_id % 4 AS cluster_id FROM vectors),
centres AS (SELECT cluster_id, feature, sum(value) AS value FROM vectors JOIN membership USING (vec_id) GROUP BY ALL),
vsizes AS (SELECT vec_id, sqrt(sum(value * value)) AS length FROM vectors GROUP BY vec_id),
csizes AS (SELECT cluster_id, sqrt(sum(value * value)) AS size FROM centres GROUP BY cluster_id),
sims AS (SELECT vec_id, cluster_id, sum(v.value * c.value) / (any_value(length) * any_value(size)) AS similarity
  FROM vectors v JOIN centres c USING (feature) JOIN vsizes USING (vec_id) JOIN csizes USING (cluster_id) GROUP BY vec_id, cluster_id)"""
#: The truth and a prediction from each document's words: `the` for English, `que` for Spanish, `der` for German, `les` for French.
PREDICTED = f"""{DOC_LABELS},
truth AS (SELECT * FROM pairs WHERE label LIKE 'lang:%' OR label LIKE 'q:%'),
words AS (SELECT doc_id, list_distinct({toks("coalesce(text, '')")}) AS w FROM documents),
predicted AS (
  SELECT doc_id, 'lang:en' AS label FROM words WHERE list_contains(w, 'the') UNION ALL SELECT doc_id, 'lang:es' FROM words WHERE list_contains(w, 'que')
  UNION ALL SELECT doc_id, 'lang:de' FROM words WHERE list_contains(w, 'der') UNION ALL SELECT doc_id, 'lang:fr' FROM words WHERE list_contains(w, 'les')
  UNION ALL SELECT doc_id, 'q:1' FROM words WHERE len(w) > 60),
flags AS (SELECT doc_id, label, max(t) AS t, max(p) AS p FROM (SELECT doc_id, label, 1 AS t, 0 AS p FROM truth UNION ALL SELECT doc_id, label, 0, 1 FROM predicted) GROUP BY ALL),
scored AS (SELECT doc_id, CAST(sum(t) AS BIGINT) AS n_true, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(t * p) AS BIGINT) AS n_correct FROM flags GROUP BY doc_id),
prf AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0.0 ELSE n_correct / n_predicted END AS "precision", CASE WHEN n_true = 0 THEN 0.0 ELSE n_correct / n_true END AS recall FROM scored),
prf1 AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM prf)"""

REPORT = f"""{PREDICTED},
per AS (SELECT label, CAST(sum(t) AS BIGINT) AS n_docs, CAST(sum(t * p) AS BIGINT) AS correct, CAST(sum((1 - t) * p) AS BIGINT) AS wrong, CAST(sum(t * (1 - p)) AS BIGINT) AS missing FROM flags GROUP BY label),
pr AS (SELECT *, CASE WHEN correct + wrong = 0 THEN 0.0 ELSE correct / (correct + wrong) END AS "precision", CASE WHEN correct + missing = 0 THEN 0.0 ELSE correct / (correct + missing) END AS recall FROM per),
rep AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1,
  CASE WHEN n_docs = 0 THEN 0.0 ELSE (100.0 * wrong / n_docs + 100.0 * missing / n_docs) * n_docs END AS impact FROM pr)"""

#: Quality as the target and words that mark shape as features, for the classifiers by aggregation.
TRAINING = f"""{COUNTS},
targets AS (SELECT doc_id, max(quality) AS y FROM labels GROUP BY doc_id),
rows AS (SELECT doc_id, term AS feature, CAST(tf AS DOUBLE) AS value FROM counts SEMI JOIN targets USING (doc_id))"""

NB = f"""{TRAINING},
priors AS (SELECT y, count(*) / (SELECT count(*) FROM targets) AS prior FROM targets GROUP BY y),
hits AS (SELECT feature, sum(y) AS k1, sum(1 - y) AS k0 FROM rows JOIN targets USING (doc_id) WHERE value > 0 GROUP BY feature),
counted AS (SELECT feature, 1 AS y, k1 AS k FROM hits UNION ALL SELECT feature, 0, k0 FROM hits),
sums AS (SELECT y, sum(k) AS a, count(*) AS v FROM counted GROUP BY y),
model AS (SELECT y, feature, (k + 0.15) / (a + 0.15 * v) AS likelihood FROM counted JOIN sums USING (y))"""

VS = f"""{TRAINING},
positive AS (SELECT * FROM rows SEMI JOIN (SELECT doc_id FROM targets WHERE y = 1) USING (doc_id)),
centre AS (SELECT feature, sum(value) AS value FROM positive GROUP BY feature),
norms AS (SELECT doc_id, sum(value * value) AS a FROM rows GROUP BY doc_id),
dots AS (SELECT doc_id, sum(r.value * c.value) AS dot FROM rows r JOIN centre c USING (feature) GROUP BY doc_id),
sims AS (SELECT doc_id, coalesce(dot, 0.0) / (a * (SELECT sum(value * value) FROM centre)) AS similarity FROM norms LEFT JOIN dots USING (doc_id)),
threshold AS (SELECT max(similarity) AS threshold FROM sims SEMI JOIN (SELECT doc_id FROM targets WHERE y = 1) USING (doc_id))"""
