"""Readers and writers of corpora, features, models and reports."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquern.operators import metrics

PAPER = "journal STRING, meshMajor ARRAY<STRING>, year INT, abstractText STRING, pmid STRING, title STRING"


# ---- papers, one JSON object a line
def parse_papers(lines: DataFrame) -> DataFrame:
    """Papers of lines (value): those that begin with a journal, less the comma or closing brackets at their end; bad ones are left out."""
    body = F.regexp_replace("value", r"(\]\}|,)\s*$", "")
    rows = lines.where(F.col("value").startswith('{"journal')).select(F.from_json(body, PAPER, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.where("pmid is not null").select(text("journal"), "meshMajor", F.coalesce("year", F.lit(0)).alias("year"), text("abstractText"), "pmid", text("title"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return parse_papers(spark.read.text(path))


def write_by_year(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("year").parquet(path)


def write_by_id(rows: DataFrame, path: str, key: str = "pmid") -> None:
    """Buckets by the last three digits of the id."""
    rows.withColumn("bucket", F.substring(F.col(key).cast("string"), -3, 3)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def compact(spark: SparkSession, path: str, out: str, files: int = 1) -> None:
    """A folder of shards as few files; the shards stay."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(out)


# ---- tagged text: `key ---> value` lines
def to_tagged(rows: DataFrame) -> DataFrame:
    """(record) of papers."""
    line = lambda k, c: F.concat(F.lit(f"{k} ---> "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    labels = F.transform(F.coalesce("meshMajor", F.array().cast("array<string>")), lambda m: F.concat(F.lit("mesh ---> "), m))
    return rows.select(F.array_join(F.concat(F.array(*(line(k, k) for k in ("journal", "year", "title", "pmid", "abstractText"))), labels), "\n").alias("record"))


def from_tagged(records: DataFrame) -> DataFrame:
    """Papers of (record); a record without a whole-number year or with a line that isn't `key ---> value` is left out."""
    lines = F.filter(F.split("record", "\n"), lambda x: F.trim(x) != "")
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, " ---> ", 1).alias("k"), F.when(x.contains(" ---> "), F.substring(x, F.length(F.substring_index(x, " ---> ", 1)) + 7, F.length(x))).alias("v")))
    value = lambda k: F.get(F.filter("pairs", lambda p: p["k"] == k), F.lit(0))["v"]
    rows = records.select(pairs.alias("pairs")).where(~F.exists("pairs", lambda p: p["v"].isNull()))
    papers = rows.select(value("journal").alias("journal"), F.transform(F.filter("pairs", lambda p: p["k"] == "mesh"), lambda p: p["v"]).alias("meshMajor"), value("year").alias("y"), value("abstractText").alias("abstractText"), value("pmid").alias("pmid"), value("title").alias("title"))
    year = papers["y"].try_cast("int")
    return papers.where(year.isNotNull()).select("journal", "meshMajor", year.alias("year"), "abstractText", "pmid", "title")


def read_tagged(spark: SparkSession, path: str, separator: str = "-" * 40) -> DataFrame:
    return from_tagged(spark.read.option("lineSep", f"\n{separator}\n").text(path).withColumnRenamed("value", "record"))


def write_tagged(rows: DataFrame, path: str, separator: str = "-" * 40) -> None:
    to_tagged(rows).write.mode("overwrite").option("lineSep", f"\n{separator}\n").text(path)


# ---- documents, features, clusters, models: Parquet tables
def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """A table; `limit` is for looking at the first rows."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return rows.limit(limit) if limit is not None else rows


def count_rows(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def merge_tables(spark: SparkSession, paths: list[str], out: str) -> None:
    rows = spark.read.parquet(paths[0])
    for p in paths[1:]:
        rows = rows.unionByName(spark.read.parquet(p))
    rows.write.mode("overwrite").parquet(out)


def write_model(centroid: DataFrame, labels: DataFrame, path: str) -> None:
    centroid.write.mode("overwrite").parquet(f"{path}/model_centroid")
    labels.write.mode("overwrite").parquet(f"{path}/model_labels")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/model_centroid"), spark.read.parquet(f"{path}/model_labels")


def cached(spark: SparkSession, folder: str, key: str, compute) -> DataFrame:
    """`compute()`'s rows, kept under a key such as a model's fingerprint and read again the next time."""
    path = f"{folder}/key={key}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- text formats of training rows
def to_sparse_line(features: Column | str, y: Column | str) -> Column:
    """`(index,weight) ... y` of an array of (index, weight) and a target."""
    cells = F.transform(features, lambda f: F.concat(F.lit("("), f["index"].cast("string"), F.lit(","), f["weight"].cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.array_join(cells, " "), F.col(y).cast("string") if isinstance(y, str) else y.cast("string"))


def from_sparse_line(lines: DataFrame) -> DataFrame:
    """(features array of (index, weight), y) of lines (value)."""
    index, weight = (F.regexp_extract_all("value", F.lit(r"\((\d+),([-+0-9.Ee]+)\)"), F.lit(g)) for g in (1, 2))
    cells = F.zip_with(index, weight, lambda i, w: F.struct(i.cast("int").alias("index"), w.cast("double").alias("weight")))
    return lines.select(cells.alias("features"), F.regexp_extract("value", r"([01])\s*$", 1).try_cast("int").alias("y"))


def read_svmlight(spark: SparkSession, path: str, features: int) -> DataFrame:
    """(label, features) of `y index:value` lines."""
    return spark.read.format("libsvm").option("numFeatures", str(features)).load(path)


def to_svmlight_line(y: Column, features: Column) -> Column:
    cells = F.transform(F.array_sort(features), lambda f: F.concat_ws(":", f["index"].cast("string"), f["weight"].cast("string")))
    return F.concat_ws(" ", y.cast("string"), F.array_join(cells, " "))


# ---- dictionaries and configurations
def read_concepts(spark: SparkSession, path: str, language: str = "ENG") -> DataFrame:
    """(term) of a pipe-separated dictionary: language in the second field, term in the fifteenth."""
    return spark.read.csv(path, sep="|", quote="").where(F.col("_c1") == language).select(F.col("_c14").alias("term"))


@dataclass(frozen=True)
class ModelConfig:
    """How a label model was made."""

    clustering_method: str
    clustering_parameter: str
    term_extraction_method: str

    KEYS = {"clusteringMethod": "clustering_method", "clusteringParameter": "clustering_parameter", "termExtractionMethod": "term_extraction_method"}

    @classmethod
    def parse(cls, text: str) -> ModelConfig:
        found = dict(line.split(": ", 1) for line in text.splitlines() if ": " in line)
        return cls(**{field: found.get(key, "").strip() for key, field in cls.KEYS.items()})

    def dump(self) -> str:
        return "\n".join(f"{key}: {getattr(self, field)}" for key, field in self.KEYS.items())


def read_configs(folder: str) -> dict[str, ModelConfig]:
    return {p.stem: ModelConfig.parse(p.read_text()) for p in sorted(Path(folder).iterdir()) if p.is_file()}


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header; commas are quoted."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_text(docs: DataFrame, path: str, ascii_only: bool = False) -> None:
    """One text a line, line ends as spaces."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    docs.select((F.regexp_replace(text, r"[^\x00-\x7F]", "") if ascii_only else text).alias("value")).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files under a folder, whatever file system it is on."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.substring_index("path", "/", -1).alias("name"), "length")


def write_dictionary(entries: DataFrame, path: str) -> None:
    """Entries (term, prefix) as text: a block for each prefix, its terms on lines of their own behind a tab."""
    blocks = entries.groupBy("prefix").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    blocks.select(F.concat("prefix", F.lit("\n\t"), F.array_join("terms", "\n\t")).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, prefix) of such blocks."""
    lines = F.split("value", "\n\t")
    rows = spark.read.option("lineSep", "\n\n").text(path).where("value <> ''").select(lines[0].alias("prefix"), F.explode(F.slice(lines, 2, F.size(lines))).alias("term"))
    return rows.select("term", "prefix")


def vocabulary(features: DataFrame) -> DataFrame:
    """(feature, index) from 1 on, in the order of names: for a label's selected features, which are few."""
    return features.select("feature").distinct().withColumn("index", F.row_number().over(Window.orderBy("feature")))


def write_training_file(rows: DataFrame, words: DataFrame, path: str) -> None:
    """Rows (doc_id, y, feature, value) as sparse lines under `path`/rows, and the vocabulary (feature, index) under `path`/vocabulary."""
    cells = rows.join(F.broadcast(words), "feature").groupBy("doc_id", "y").agg(F.array_sort(F.collect_list(F.struct("index", F.col("value").alias("weight")))).alias("features"))
    cells.select(to_sparse_line("features", "y").alias("value")).write.mode("overwrite").text(f"{path}/rows")
    words.select(F.concat_ws("\t", "index", "feature").alias("value")).write.mode("overwrite").text(f"{path}/vocabulary")


def read_training_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((features, y), (feature, index))."""
    parts = F.split("value", "\t", 2)
    return from_sparse_line(spark.read.text(f"{path}/rows")), spark.read.text(f"{path}/vocabulary").select(parts[1].alias("feature"), parts[0].cast("int").alias("index"))


def write_svm_model(models: DataFrame, path: str) -> None:
    """Models (kind, kernel, rho, alpha, sv) as text: a header of `key value` lines, then a line for each support vector."""
    cells = lambda v: F.array_join(F.filter(F.transform(v, lambda x, i: F.when(x != 0, F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))), lambda c: c.isNotNull()), " ")
    lines = F.zip_with("alpha", "sv", lambda a, v: F.concat_ws(" ", a.cast("string"), cells(v)))
    head = [F.concat(F.lit(f"{k} "), F.col(c).cast("string")) for k, c in (("svm_type", "kind"), ("kernel_type", "kernel"), ("rho", "rho"))]
    size = F.concat(F.lit("width "), F.coalesce(F.size(F.get("sv", F.lit(0))), F.lit(0)).cast("string"))
    models.select(F.array_join(F.concat(F.array(*head, size, F.lit("SV")), lines), "\n").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_svm_model(spark: SparkSession, path: str) -> DataFrame:
    """(kind, kernel, rho, alpha, sv) of such text; the kind is what the header says."""
    lines = F.split("value", "\n")
    field = lambda k: F.substring_index(F.get(F.filter(lines, lambda x: x.startswith(f"{k} ")), F.lit(0)), " ", -1)
    body = F.slice(lines, F.array_position(lines, "SV").cast("int") + 1, F.size(lines))
    rows = spark.read.option("lineSep", "\n\n").text(path).where("value <> ''").select(field("svm_type").alias("kind"), field("kernel_type").alias("kernel"), field("rho").cast("double").alias("rho"), field("width").cast("int").alias("width"), body.alias("body"))
    parts = lambda x: F.split(x, " ")
    cells = lambda x: F.map_from_entries(F.transform(F.filter(parts(x), lambda c: c.contains(":")), lambda c: F.struct(F.substring_index(c, ":", 1).cast("int").alias("i"), F.substring_index(c, ":", -1).cast("double").alias("v"))))
    dense = lambda x: F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.try_element_at(cells(x), i), F.lit(0.0)))
    return rows.select("kind", "kernel", "rho", F.transform("body", lambda x: F.get(parts(x), F.lit(0)).cast("double")).alias("alpha"), F.transform("body", dense).alias("sv"))


def write_evaluation(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, path: str) -> None:
    """Five reports under `path`: documents, labels, summary, unseen and candidates."""
    scores = metrics.document_scores(truth, predicted)
    reports = {
        "documents": scores.join(metrics.document_details(truth, predicted), "doc_id"), "labels": metrics.label_report(truth, predicted),
        "summary": metrics.macro_scores(scores), "unseen": metrics.unseen_labels(truth, candidates), "candidates": candidates.select("label").distinct(),
    }
    for name, rows in reports.items():
        write_report(rows, f"{path}/{name}")
