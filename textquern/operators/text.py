"""Documents to weighted terms, and the term statistics of a corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textquern.functions import scalars
from textquern.functions.stemmer import stem, stem_terms
from textquern.session import small_batches

TITLE_WEIGHT = 4

#: Rows that leave a Python worker at once, and stems that it remembers.
ROWS, STEMS = 1 << 14, 1 << 17


def titled(docs: DataFrame) -> DataFrame:
    """(doc_id, title, body): the first line, and the rest."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select("doc_id", lines[0].alias("title"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n").alias("body"))


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, term) of every token."""
    return docs.select("doc_id", F.posexplode(scalars.tokens(F.coalesce(text, F.lit("")))).alias("pos", "term"))


def once_each(docs: DataFrame) -> bool:
    """Whether each doc_id has one row; looks at the ids alone."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _counted(docs: DataFrame, title_weight: int, stemmed: bool, with_length: bool) -> DataFrame:
    """`weighted_counts` of documents of one row each: texts go to Python in lower case, as words between spaces, and are counted there."""
    small_batches(docs.sparkSession)
    words = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ").alias(c)
    rows = titled(docs).select("doc_id", words("title"), words("body"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(("dl long, " if with_length else "") + "term string, tf long")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        at, lengths, terms, tfs = [], [], [], []

        def full(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())]
            out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns[0 if with_length else 1 :]], names)
            for x in (at, lengths, terms, tfs):
                x.clear()
            return out

        for batch in batches:
            texts = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for i, (title, body) in enumerate(texts):
                title, body = title.split(), body.split()
                counts = Counter(body)
                for w in title:
                    counts[w] += title_weight
                if stemmed:
                    found, counts = counts, {}
                    for w, n in found.items():
                        s = stems.get(w)
                        if s is None:
                            if len(stems) >= STEMS:
                                stems.clear()
                            s = stems[w] = stem(w)
                        counts[s] = counts.get(s, 0) + n
                at += [i] * len(counts)
                lengths += [len(body) + title_weight * len(title)] * len(counts)
                terms += counts
                tfs += counts.values()
                if len(at) >= ROWS:
                    yield full(batch)
            if at:
                yield full(batch)

    return rows.mapInArrow(run, schema)


def weighted_counts(docs: DataFrame, title_weight: int = TITLE_WEIGHT, stemmed: bool = False, with_length: bool = False) -> DataFrame:
    """(doc_id, term, tf): occurrences in the body plus `title_weight` times those in the title.

    `with_length` adds the document's length dl. Where each document has one row, which is looked up
    first, its terms are counted in it and nothing is shuffled; else rows of one document meet.
    """
    if title_weight > 0 and once_each(docs):
        return _counted(docs, title_weight, stemmed, with_length)
    parts = titled(docs).select("doc_id", scalars.tokens("title").alias("title"), scalars.tokens("body").alias("body"))
    keys = ["doc_id", "dl"] if with_length else ["doc_id"]
    rows = parts.select("doc_id", F.explode(F.concat(
        F.transform("title", lambda t: F.struct(t.alias("term"), F.lit(title_weight).alias("w"))),
        F.transform("body", lambda t: F.struct(t.alias("term"), F.lit(1).alias("w"))),
    )).alias("t")).select("doc_id", "t.term", "t.w").groupBy("doc_id", "term").agg(F.sum("w").alias("tf"))
    if with_length:
        rows = rows.select("doc_id", F.sum("tf").over(Window.partitionBy("doc_id")).alias("dl"), "term", "tf")
    if stemmed:
        rows = stem_terms(rows).groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return rows


def doc_freq(counts: DataFrame) -> DataFrame:
    """(term, df)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def doc_length(counts: DataFrame) -> DataFrame:
    """(doc_id, dl)."""
    if "dl" in counts.columns:
        return counts.select("doc_id", "dl").distinct()
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(counts: DataFrame, exact_avgdl: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """(n_docs, avgdl): one row; the average is an integer quotient unless `exact_avgdl`.

    With `docs` all documents count, also those without a term, which `counts` can't show.
    """
    average = "try_divide(total, n_docs)" if exact_avgdl else "total div nullif(n_docs, 0)"
    if docs is not None:
        sums = counts.agg(F.sum("tf").alias("total")).join(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))
    else:
        sums = doc_length(counts).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total"))
    return sums.select("n_docs", F.expr(average).alias("avgdl"))


def weigh(counts: DataFrame, weight: str = "tfidf", exact_avgdl: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight): TF-IDF or BM25; `docs` as in `corpus_stats`.

    Counts that carry the document length need no shuffle for it; for others it is a window by doc_id.
    The corpus statistics are one row and the only broadcast. Counts meet the document frequencies by
    one shuffle and a hash table of a partition's terms, without a sort.
    """
    lengths = counts if "dl" in counts.columns else counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id")))
    if weight == "tfidf" and docs is not None:  # the average length isn't used, so that counts aren't summed for it
        stats = docs.agg(F.count("*").alias("n_docs"))
    else:
        stats = corpus_stats(counts, exact_avgdl, docs)
    rows = lengths.join(doc_freq(counts).hint("shuffle_hash"), "term").join(F.broadcast(stats))
    value: Column
    if weight == "tfidf":
        value = scalars.tfidf(F.col("tf"), F.col("dl"), F.col("n_docs"), F.col("df"))
    elif weight == "bm25":
        value = scalars.bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col("df"))
    else:
        raise ValueError(f"unknown weight {weight!r}")
    return rows.select("doc_id", "term", value.alias("weight"))


def top_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, term, weight): the k heaviest terms of each document.

    Weights move to their document first: ranking before that sorts them once more and drops next to none,
    as few terms of a document are in one place.
    """
    order = Window.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
    return weights.repartition("doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "rank", "term", "weight")


def inverted_index(weights: DataFrame, several: bool = True) -> DataFrame:
    """(term, doc_id, weight) postings; names of several concepts are split at semicolons.

    Without `several`, terms are words without semicolons and each comes once for a document, as `weigh`
    gives them, so that there is nothing to split or to sum.
    """
    if not several:
        return weights.select("term", "doc_id", "weight").where("term <> ''")
    return weights.select(F.explode(F.split("term", ";")).alias("term"), "doc_id", "weight").where("term <> ''").groupBy("term", "doc_id").agg(F.sum("weight").alias("weight"))


def round_robin(rows: DataFrame, order: str, parts: int, part: int) -> DataFrame:
    """The rows whose place in the order of an integer id has remainder `part`; ids stand for places, so no global sort is needed."""
    return rows.where(F.pmod(F.col(order), F.lit(parts)) == part)


def split_parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """The rows with their part, dealt out in the order of an integer id."""
    return rows.withColumn("part", F.pmod(F.col(order), F.lit(parts)).cast("int"))


def split_corpus(docs: DataFrame, dev: float = 0.1, test: float = 0.1, key: str = "doc_id") -> DataFrame:
    """The rows with `split`: train, dev or test, by a hash of the id, so that a document never changes sides."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return docs.withColumn("split", F.when(at < dev, "dev").when(at < round(dev + test, 9), "test").otherwise("train"))


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a column."""
    return rows.orderBy(order).limit(n)
