"""Queries that write a format and read it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquern.operators import classify, cluster, labels, text, topics
from textquern.plans.label_queries import _predicted, _truth
from textquern.plans.learning_queries import _training
from textquern.plans.registry import query, scratch
from textquern.plans.sql import DOC_LABELS, NATIONS, PREDICTED, TRAINING
from textquern.plans.vector_queries import _membership, nation_vectors
from textquern.session import cut
from textquern.sources import corpus


def _session(read):
    return read("region").sparkSession


@query("SELECT CAST(right(CAST(o_orderkey AS VARCHAR), 3) AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def id_buckets(read):
    """Orders in folders by the last three digits of their key."""
    path = scratch(read)
    corpus.write_by_id(read("orders").select("o_orderkey"), path, "o_orderkey")
    return _session(read).read.parquet(path).groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("n"))


_ONE_LINE = "trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS pmid, source AS journal, CAST(len({_ONE_LINE}) AS BIGINT) AS chars, md5({_ONE_LINE}) AS digest FROM documents")
def tagged_files(read):
    """Documents as delimited tagged records in files, read again."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\t\\n\\x0b\\f\\r ]+", " "))
    papers = read("documents").select(F.col("source").alias("journal"), F.array("lang").alias("meshMajor"), F.lit(2000).alias("year"), plain.alias("abstractText"), F.col("doc_id").cast("string").alias("pmid"), F.col("lang").alias("title"))
    path = scratch(read)
    corpus.write_tagged(papers, path)
    return corpus.read_tagged(_session(read), path).select("pmid", "journal", F.length("abstractText").cast("long").alias("chars"), F.md5("abstractText").alias("digest"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(1 AS BIGINT) AS files FROM orders")
def compacted_shards(read):
    """A folder of five files made one."""
    path, spark = scratch(read), _session(read)
    read("orders").select("o_orderkey").repartition(5).write.parquet(f"{path}/shards")
    corpus.compact(spark, f"{path}/shards", f"{path}/one")
    files = corpus.list_files(spark, f"{path}/one").where("name like 'part-%'").agg(F.count("*").alias("files"))
    return spark.read.parquet(f"{path}/one").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).join(F.broadcast(files))


@query("SELECT doc_id, quality, toxic FROM labels")
def table_roundtrip(read):
    path = scratch(read)
    corpus.write_table(read("labels"), path)
    return corpus.read_table(_session(read), path, "doc_id long, quality int, toxic int")


@query("SELECT count(*) AS n FROM lineitem")
def header_count(read):
    """The number of rows of a written table, from its footers."""
    path = scratch(read)
    corpus.write_table(read("lineitem").select("l_orderkey"), path)
    return _session(read).range(1).select(F.lit(corpus.count_rows(_session(read), path)).cast("long").alias("n"))


@query("SELECT least(count(*), 25) AS n FROM customer")
def capped_scan(read):
    """The limit of the reader itself: at most 25 rows."""
    path = scratch(read)
    corpus.write_table(read("customer").select("c_custkey"), path)
    return corpus.read_table(_session(read), path, limit=25).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def merged_tables(read):
    """Three tables put into one."""
    path, spark = scratch(read), _session(read)
    for part in range(3):
        corpus.write_table(read("customer").where(F.col("c_custkey") % 3 == part), f"{path}/{part}")
    corpus.merge_tables(spark, [f"{path}/{part}" for part in range(3)], f"{path}/all")
    return spark.read.parquet(f"{path}/all").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


_REGIONS = "names AS (SELECT n_nationkey AS vec_id, 'region:' || n_regionkey AS label FROM nation)"


def _regions(read):
    return read("nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("label"), F.lit(1.0).alias("weight"))


@query(f"""WITH {NATIONS}, {_REGIONS}, l AS (SELECT cluster_id, count(DISTINCT label) AS n_labels FROM names JOIN membership USING (vec_id) GROUP BY 1)
SELECT cluster_id, count(*) AS n_features, round(sum(value), 6) AS total, any_value(n_labels) AS n_labels FROM centres JOIN l USING (cluster_id) GROUP BY cluster_id""")
def model_tables(read):
    """A label model written as its two tables and read again."""
    v, path = nation_vectors(read), scratch(read)
    corpus.write_model(*cluster.label_model(v, _regions(read), _membership(v)), path)
    centroid, names = corpus.read_model(_session(read), path)
    counted = names.groupBy("cluster_id").agg(F.count("*").alias("n_labels"))
    return centroid.groupBy("cluster_id").agg(F.count("*").alias("n_features"), F.round(F.sum("value"), 6).alias("total")).join(counted, "cluster_id")


@query(f"WITH {NATIONS} SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id, n_regionkey FROM membership JOIN nation ON vec_id = n_nationkey")
def cached_membership(read):
    """The cluster of each vector, kept under the model's fingerprint and joined when it is read again."""
    v, path, spark = nation_vectors(read), scratch(read), _session(read)
    key = cluster.content_hash(cluster.centroids(v, _membership(v))).first()[0]
    for _ in range(2):
        kept = corpus.cached(spark, path, key, lambda: _membership(v))
    return kept.join(read("nation").select(F.col("n_nationkey").alias("vec_id"), "n_regionkey"), "vec_id").select("vec_id", "cluster_id", "n_regionkey")


@query("SELECT lower(p_name) AS term, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1")
def concept_scan(read):
    """Part names as lines of a dictionary of 16 fields in two languages; the English ones are read."""
    fields = [F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "SPA").otherwise("ENG"), *(F.lit("x") for _ in range(12)), F.col("p_name"), F.lit("y")]
    path = scratch(read)
    read("part").select(F.concat_ws("|", *fields).alias("value")).write.text(path)
    return corpus.read_concepts(_session(read), path).groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lower(trim(p_name)) AS term, substr(lower(trim(p_name)), 1, 3) AS prefix FROM part")
def bucketed_dictionary(read):
    """A dictionary as blocks of tab-indented terms, read again."""
    path = scratch(read)
    corpus.write_dictionary(topics.dictionary(read("part").select(F.col("p_name").alias("term"))), path)
    return corpus.read_dictionary(_session(read), path)


@query(f"""WITH {TRAINING}, pos AS (SELECT sum(y) AS pos FROM targets),
band AS (SELECT feature, count(DISTINCT doc_id) AS df FROM rows GROUP BY feature HAVING count(DISTINCT doc_id) > 0.3 * (SELECT pos FROM pos) AND count(DISTINCT doc_id) < 1.5 * (SELECT pos FROM pos))
SELECT feature, y, count(*) AS n, round(sum(value), 6) AS total FROM rows SEMI JOIN band USING (feature) JOIN targets USING (doc_id) GROUP BY ALL""")
def training_files(read):
    """A training matrix as sparse lines with a vocabulary file, read again."""
    rows, path = cut(classify.training_matrix(*_training(read), unique=True)), scratch(read)
    corpus.write_training_file(rows, cut(corpus.vocabulary(rows)), path)
    lines, words = corpus.read_training_file(_session(read), path)
    cells = lines.select("y", F.explode("features").alias("c")).select("y", "c.index", F.col("c.weight").alias("value")).join(words, "index")
    return cells.groupBy("feature", "y").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH m AS (SELECT CAST(label AS VARCHAR) AS kind, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, vec_id FROM embeddings WHERE label < 5)
SELECT 'kind' || kind AS kind, 'linear' AS kernel, CAST(0.5 AS DOUBLE) AS rho, count(*) AS n_vectors, CAST(sum(vec_id) AS DOUBLE) AS alphas, round(sum(s), 4) AS total FROM m GROUP BY kind""")
def svm_model_text(read):
    """Models with many support vectors as text, read again by what their headers say. Labels name the models: the format is what is tested."""
    rows = read("embeddings").where("label < 5").select(F.concat(F.lit("kind"), F.col("label").cast("string")).alias("kind"), F.struct(F.col("vec_id").cast("double").alias("a"), F.col("embedding").cast("array<double>").alias("v")).alias("s"))
    models = rows.groupBy("kind").agg(F.collect_list("s").alias("s")).select("kind", F.lit("linear").alias("kernel"), F.lit(0.5).alias("rho"), F.col("s.a").alias("alpha"), F.col("s.v").alias("sv"))
    path = scratch(read)
    corpus.write_svm_model(models, path)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    back = corpus.read_svm_model(_session(read), path)
    return back.select("kind", "kernel", "rho", F.size("alpha").cast("long").alias("n_vectors"), add("alpha").alias("alphas"), F.round(add(F.transform("sv", add)), 4).alias("total"))


@query(f"""WITH {PREDICTED} SELECT 'documents' AS report, count(*) AS n FROM prf1 UNION ALL SELECT 'labels', count(DISTINCT label) FROM flags UNION ALL SELECT 'summary', 1
UNION ALL SELECT 'unseen', count(DISTINCT label) FROM truth WHERE label NOT IN (SELECT label FROM predicted) UNION ALL SELECT 'candidates', count(DISTINCT label) FROM predicted""")
def evaluation_reports(read):
    """The five reports of an evaluation as CSV; how many rows each has."""
    path, spark = scratch(read), _session(read)
    corpus.write_evaluation(_truth(read), _predicted(read), _predicted(read), path)
    counted = None
    for name in ("documents", "labels", "summary", "unseen", "candidates"):
        one = spark.read.option("header", True).csv(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n")
        counted = one if counted is None else counted.union(one)
    return counted


_ASCII = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT count(*) AS n, CAST(sum(len({_ASCII})) AS BIGINT) AS chars, CAST(sum(len({_ASCII}) + 1) AS BIGINT) AS bytes FROM documents")
def ascii_export(read):
    """All texts as plain lines of ASCII, and the bytes of the files."""
    path, spark = scratch(read), _session(read)
    corpus.export_text(read("documents"), path, ascii_only=True)
    size = corpus.list_files(spark, path).where("name like 'part-%'").agg(F.sum("length").alias("bytes"))
    return spark.read.text(path).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).join(F.broadcast(size))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def svmlight_roundtrip(read):
    """Vectors as svmlight lines, read by the library's reader."""
    cells = F.transform("embedding", lambda x, i: F.struct((i + 1).alias("index"), x.cast("double").alias("weight")))
    path = scratch(read)
    read("embeddings").select(corpus.to_svmlight_line(F.col("vec_id") * 100 + F.col("label"), cells).alias("value")).write.text(path)
    from pyspark.ml.functions import vector_to_array

    back = corpus.read_svmlight(_session(read), path, 64)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return back.select(F.floor(F.col("label") / 100).cast("long").alias("vec_id"), (F.col("label") % 100).cast("int").alias("label"), F.round(total, 4).alias("total"))


@query(f"WITH {DOC_LABELS} SELECT label, count(*) AS n FROM pairs GROUP BY label")
def label_table_roundtrip(read):
    """Label sets as a table of feature sets (arrays), read again and counted."""
    path = scratch(read)
    sets = labels.document_labels(read("documents"), read("labels")).groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    corpus.write_table(sets, path)
    return corpus.read_table(_session(read), path).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, CAST(doc_id % 4 AS INTEGER) AS part FROM documents")
def parts_roundtrip(read):
    """Documents dealt out to four parts, each a folder."""
    path = scratch(read)
    text.split_parts(read("documents").select("doc_id", "lang"), "doc_id", 4).write.partitionBy("part").parquet(path)
    return _session(read).read.parquet(path).select("doc_id", "lang", F.col("part").cast("int").alias("part"))
