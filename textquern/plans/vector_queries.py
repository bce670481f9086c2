"""Queries on sparse vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.operators import cluster, labels, topics, vectors
from textquern.plans.registry import query
from textquern.plans.sql import BASKETS, BRANDS, DOC_LABELS, NATIONS


def brand_vectors(read):
    """Brands over the suppliers that sold them."""
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.substring("p_brand", 7, 9).cast("long").alias("vec_id"), F.col("l_suppkey").cast("string").alias("feature")).agg(F.count("*").cast("double").alias("value"))


def nation_vectors(read):
    """Nations over market segments, order priorities and groups of suppliers."""
    customer, orders, items = read("customer"), read("orders"), read("lineitem")
    placed = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    sold = placed.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    name = lambda df, kind, c: df.select("c_nationkey", F.concat(F.lit(f"{kind}:"), c).alias("feature"))
    rows = name(customer, "seg", F.col("c_mktsegment")).union(name(placed, "pri", F.col("o_orderpriority"))).union(name(sold, "sup", (F.col("l_suppkey") % 40).cast("string")))
    return rows.groupBy(F.col("c_nationkey").alias("vec_id"), "feature").agg(F.count("*").cast("double").alias("value"))


def _membership(v):
    return v.select("vec_id").distinct().withColumn("cluster_id", (F.col("vec_id") % 4).cast("int"))


@query(f"WITH {BRANDS} SELECT vec_id, round(length, 6) AS length FROM sizes")
def vector_length(read):
    return vectors.lengths(brand_vectors(read)).select("vec_id", F.round("length", 6).alias("length"))


@query(f"WITH {BRANDS} SELECT src, dst, round(similarity, 6) AS similarity FROM cosines")
def pairwise_cosine(read):
    return vectors.similarity_pairs(brand_vectors(read)).select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {BRANDS} SELECT src, dst, round(similarity, 6) AS similarity FROM jaccards")
def pairwise_jaccard(read):
    return vectors.similarity_pairs(brand_vectors(read), "jaccard").select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {BRANDS}, t AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM sizes),
c AS (SELECT CAST(floor(round(similarity * 100, 6)) AS BIGINT) AS bucket, count(*) AS n FROM cosines GROUP BY 1),
h AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n_pairs FROM (SELECT * FROM c UNION ALL SELECT 0, total - (SELECT sum(n) FROM c) FROM t) GROUP BY bucket)
SELECT bucket, n_pairs, round(n_pairs / total, 6) AS share, round(sum(n_pairs / total) OVER (ORDER BY bucket), 6) AS cumulative_share FROM h, t""")
def similarity_histogram(read):
    v = brand_vectors(read)
    h = vectors.histogram(vectors.similarity_pairs(v), v)
    return h.select("bucket", F.col("n_pairs").cast("long").alias("n_pairs"), F.round("share", 6).alias("share"), F.round("cumulative_share", 6).alias("cumulative_share"))


@query(f"""WITH {BRANDS} SELECT x.vec_id, round(coalesce(similarity, CASE WHEN x.vec_id = 1 THEN 1.0 ELSE 0.0 END), 6) AS cosine, round(10 * x.length / x.length, 6) AS new_length
FROM sizes x LEFT JOIN (SELECT dst AS vec_id, similarity FROM cosines WHERE src = 1 UNION ALL SELECT src, similarity FROM cosines WHERE dst = 1) USING (vec_id)""")
def map_vectors(read):
    """The scalar functions on packed vectors: cosine to one brand, and the length after rescaling."""
    maps = vectors.packed(brand_vectors(read))
    first = maps.where("vec_id = 1").select(F.col("vector").alias("one"))
    rows = maps.join(F.broadcast(first))
    return rows.select("vec_id", F.round(scalars.map_cosine("vector", "one"), 6).alias("cosine"), F.round(scalars.map_length(scalars.map_rescale("vector", 10.0)), 6).alias("new_length"))


@query(f"WITH {NATIONS} SELECT cluster_id, feature, value FROM centres")
def centroid_sum(read):
    v = nation_vectors(read)
    return cluster.centroids(v, _membership(v))


@query(f"WITH {NATIONS} SELECT feature, sum(value) AS value FROM centres GROUP BY feature")
def average_cluster(read):
    v = nation_vectors(read)
    return cluster.average_vector(cluster.centroids(v, _membership(v)))


@query(f"WITH {NATIONS} SELECT vec_id, arg_max(cluster_id, (round(similarity, 9), -cluster_id)) AS cluster_id, round(max(similarity), 6) AS similarity FROM sims GROUP BY vec_id")
def kmeans_assign_step(read):
    v = nation_vectors(read)
    return cluster.assign(v, cluster.centroids(v, _membership(v))).select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {NATIONS} SELECT vec_id, rank, cluster_id, round(similarity, 6) AS similarity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, cluster_id) AS INTEGER) AS rank FROM sims) WHERE rank <= 3""")
def nearest_clusters(read):
    v = nation_vectors(read)
    return cluster.nearest(v, cluster.centroids(v, _membership(v)), 3).select("vec_id", "rank", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {NATIONS}, sizes AS (SELECT cluster_id, count(*) AS n FROM membership GROUP BY cluster_id), a AS (SELECT feature, sum(value) AS value FROM centres GROUP BY feature),
n AS (SELECT cluster_id, sum(c.value * a.value) / (any_value(size) * (SELECT sqrt(sum(value * value)) FROM a)) AS similarity FROM centres c JOIN a USING (feature) JOIN csizes USING (cluster_id) GROUP BY cluster_id)
SELECT count(*) AS n_clusters, round(avg(n.similarity), 6) AS mean_similarity, round(stddev_samp(n.similarity), 6) AS sd_similarity, round(avg(sizes.n), 6) AS mean_size, round(stddev_samp(sizes.n), 6) AS sd_size FROM sizes JOIN n USING (cluster_id)""")
def cluster_report(read):
    v = nation_vectors(read)
    r = cluster.report(v, _membership(v))
    return r.select("n_clusters", *(F.round(c, 6).alias(c) for c in ("mean_similarity", "sd_similarity", "mean_size", "sd_size")))


@query(f"""WITH {DOC_LABELS}, m AS (SELECT DISTINCT doc_id, doc_id % 12 AS cluster_id FROM pairs)
SELECT label, round(count(DISTINCT cluster_id) / (SELECT count(DISTINCT cluster_id) FROM m), 6) AS share FROM pairs JOIN m USING (doc_id) GROUP BY label""")
def label_presence(read):
    pairs = labels.document_labels(read("documents"), read("labels"))
    membership = pairs.select(F.col("doc_id").alias("vec_id")).distinct().withColumn("cluster_id", F.col("vec_id") % 12)
    return cluster.presence(pairs, membership).select("label", F.round("share", 6).alias("share"))


@query(f"""WITH {NATIONS}, names AS (SELECT n_nationkey AS vec_id, 'region:' || n_regionkey AS label FROM nation)
SELECT cluster_id, label, CAST(count(*) AS DOUBLE) AS weight FROM names JOIN membership USING (vec_id) GROUP BY ALL""")
def term_cluster_model(read):
    v = nation_vectors(read)
    names = read("nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("label"), F.lit(1.0).alias("weight"))
    return cluster.label_model(v, names, _membership(v))[1]


@query(f"""WITH {NATIONS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, cluster_id) AS rank FROM sims) WHERE rank <= 2),
names AS (SELECT n_nationkey AS vec_id, 'region:' || n_regionkey AS label FROM nation), model AS (SELECT DISTINCT cluster_id, label FROM names JOIN membership USING (vec_id))
SELECT DISTINCT vec_id, label FROM near JOIN model USING (cluster_id)""")
def candidate_labels(read):
    v = nation_vectors(read)
    names = read("nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("label"), F.lit(1.0).alias("weight"))
    centres, model = cluster.label_model(v, names, _membership(v))
    return cluster.candidates(cluster.nearest(v, centres, 2), model)


def _label_vectors(read):
    pairs = labels.document_labels(read("documents"), read("labels"))
    return labels.label_vectors(pairs, labels.rarity_weights(labels.probability(pairs)))


@query()
def kmeans(read):
    """Documents clustered by their weighted label sets."""
    return cluster.kmeans(_label_vectors(read), 12)[0]


@query()
def leader_clustering(read):
    return cluster.leader(_label_vectors(read), 0.5)[0]


@query()
def cluster_tree(read):
    v = brand_vectors(read)
    return cluster.tree(cluster.centroids(v, v.select("vec_id").distinct().withColumn("cluster_id", F.col("vec_id"))))


def _pagerank_rounds(n: int = 20) -> str:
    parts = ["r0 AS (SELECT src AS node, 1.0::DOUBLE AS rank FROM sums)"]
    for k in range(n):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT s.src AS node, 0.15 + 0.85 * coalesce(sum(e.share * r.rank), 0) AS rank FROM sums s LEFT JOIN shares e ON e.dst = s.src LEFT JOIN r{k} r ON r.node = e.src GROUP BY s.src)")
    return ",\n".join(parts)


@query(f"""WITH {BASKETS}, edges AS (SELECT a.label AS src, b.label AS dst, CAST(count(*) AS DOUBLE) AS weight FROM pairs a JOIN pairs b USING (doc_id) WHERE a.label <> b.label GROUP BY ALL),
sums AS MATERIALIZED (SELECT src, sum(weight) AS total FROM edges GROUP BY src), shares AS MATERIALIZED (SELECT src, dst, weight / total AS share FROM edges JOIN sums USING (src)),
{_pagerank_rounds()} SELECT node, round(rank, 6) AS rank FROM r20""")
def label_pagerank(read):
    """Ranks of suppliers on the graph of orders they share."""
    ranks = topics.basket_pagerank(labels.basket_labels(read("lineitem")))
    return ranks.select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {BASKETS} SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM pairs")
def basket_size(read):
    return labels.basket_labels(read("lineitem")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {NATIONS}, h AS (SELECT md5(concat_ws(chr(1), CAST(cluster_id AS VARCHAR), feature, CAST(value AS VARCHAR))) AS h FROM centres)
SELECT md5(concat_ws(':', CAST(count(*) AS VARCHAR), {", ".join(f"CAST(CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS HUGEINT) AS VARCHAR)" for i in range(4))})) AS fingerprint FROM h""")
def model_fingerprint(read):
    v = nation_vectors(read)
    return cluster.content_hash(cluster.centroids(v, _membership(v)))
