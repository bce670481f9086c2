from pyspark.sql import functions as F

from textquern.sources import corpus
from textquern.streaming.scorer import score_stream, windowed_counts


def test_papers(spark):
    lines = spark.createDataFrame([('{"articles":[',), ('{"journal":"J","meshMajor":["A","B"],"year":2010,"abstractText":"x","pmid":"1","title":"T"},',), ('{"journal":null,"meshMajor":[],"year":null,"pmid":"2"}]}',), ('{"journal: broken',)], "value string")
    rows = corpus.parse_papers(lines).orderBy("pmid").collect()
    assert [(r.pmid, r.journal, r.year, r.title) for r in rows] == [("1", "J", 2010, "T"), ("2", "", 0, "")]


def test_tagged_files(spark, tmp_path):
    papers = spark.createDataFrame([("J", ["A", "B ---> C"], 2001, "text", "9", "T: x")], corpus.PAPER)
    corpus.write_tagged(papers, str(tmp_path / "t"))
    assert [r.asDict() for r in corpus.read_tagged(spark, str(tmp_path / "t")).collect()] == [r.asDict() for r in papers.collect()]
    bad = spark.createDataFrame([("journal ---> J\nyear ---> x",), ("no separator",)], "record string")
    assert corpus.from_tagged(bad).count() == 0


def test_tables_and_models(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2000, "a"), (2, 2001, "b")], "pmid long, year int, t string")
    corpus.write_by_year(rows, f"{tmp_path}/y")
    corpus.write_by_id(rows, f"{tmp_path}/b")
    assert (tmp_path / "y/year=2000").exists() and corpus.count_rows(spark, f"{tmp_path}/b") == 2
    corpus.compact(spark, f"{tmp_path}/y", f"{tmp_path}/c")
    corpus.write_table(rows, f"{tmp_path}/r")
    corpus.merge_tables(spark, [f"{tmp_path}/r", f"{tmp_path}/r"], f"{tmp_path}/m")
    assert corpus.read_table(spark, f"{tmp_path}/m").count() == 4 and corpus.read_table(spark, f"{tmp_path}/m", limit=1).count() == 1
    corpus.write_model(rows, rows, f"{tmp_path}/model")
    assert corpus.read_model(spark, f"{tmp_path}/model")[1].count() == 2
    corpus.write_report(rows, f"{tmp_path}/report")
    corpus.export_text(rows.select(F.col("t").alias("text")), f"{tmp_path}/plain", True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/plain").collect()) == ["a", "b"]


def test_training_lines(spark, tmp_path):
    rows = spark.createDataFrame([([(2, 0.5), (1, 1.5)], 1), ([], 0)], "f array<struct<index:int,weight:double>>, y int")
    back = corpus.from_sparse_line(rows.select(corpus.to_sparse_line("f", "y").alias("value"))).collect()
    assert [([tuple(c) for c in r.features], r.y) for r in back] == [([(2, 0.5), (1, 1.5)], 1), ([], 0)]
    line = rows.select(corpus.to_svmlight_line(F.col("y"), F.col("f")).alias("value"))
    line.where("value like '%:%'").coalesce(1).write.text(f"{tmp_path}/svm")
    r = corpus.read_svmlight(spark, f"{tmp_path}/svm", 3).first()
    assert r.label == 1.0 and r.features.toArray().tolist() == [1.5, 0.5, 0.0]


def test_dictionary_and_config(spark, tmp_path):
    (tmp_path / "d").write_text("|".join(["C1", "ENG", *["x"] * 12, "Cell", "y"]) + "\n" + "|".join(["C1", "SPA", *["x"] * 12, "Celula", "y"]) + "\n")
    assert [r.term for r in corpus.read_concepts(spark, str(tmp_path / "d")).collect()] == ["Cell"]
    config = corpus.ModelConfig("k-means", "2000", "BM25")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/one.txt").write_text(config.dump())
    assert corpus.read_configs(str(tmp_path / "c")) == {"one": config}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = score_stream(stream, lambda b: b.select("doc_id", F.length("text").alias("n")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    events = spark.sql("SELECT timestamp'2024-01-01 00:30:00' ts, 'a' event_type, 2.0D value UNION ALL SELECT timestamp'2024-01-01 00:40:00', 'a', 3.0D")
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 5.0)]



def test_cached(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert corpus.cached(spark, str(tmp_path), "k", compute).count() == corpus.cached(spark, str(tmp_path), "k", compute).count() == 3
    assert len(calls) == 1
