"""Queries on texts: tokens, weights, formats and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.functions.stemmer import stem_udf
from textquern.operators import text, topics
from textquern.plans.registry import query, scratch
from textquern.plans.sql import BM25, COUNTS, TFIDF, toks
from textquern.sources import corpus
from textquern.streaming.scorer import windowed_counts


def _counts(read):
    return text.weighted_counts(read("documents"))


def _weigh(read, weight: str):
    return text.weigh(text.weighted_counts(read("documents"), with_length=True), weight, docs=read("documents"))


def _r(name: str):
    return F.round(name, 6).alias(name)


@query(f"WITH {COUNTS} SELECT doc_id, term, tf FROM counts")
def tokenize_counts(read):
    return _counts(read)


@query(f"SELECT doc_id, CAST(len({toks("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents")
def token_counts(read):
    return read("documents").select("doc_id", F.size(scalars.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query(f"WITH {COUNTS} SELECT term, df FROM dfs")
def doc_freq(read):
    return text.doc_freq(_counts(read))


@query(f"WITH {COUNTS} SELECT doc_id, dl FROM dls")
def doc_length(read):
    return text.doc_length(_counts(read))


@query(f"WITH {COUNTS} SELECT n_docs, avgdl FROM stats")
def corpus_stats(read):
    return text.corpus_stats(_counts(read), docs=read("documents"))


@query(f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf(read):
    return _weigh(read, "tfidf").select("doc_id", "term", _r("weight"))


@query(f"WITH {BM25} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def bm25(read):
    return _weigh(read, "bm25").select("doc_id", "term", _r("weight"))


@query(f"""WITH {TFIDF} SELECT doc_id, rank, term, round(weight, 6) AS weight FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM weights) WHERE rank <= 10""")
def top_terms_per_doc(read):
    return text.top_terms(_weigh(read, "tfidf")).select("doc_id", "rank", "term", _r("weight"))


@query(f"WITH {TFIDF} SELECT term, doc_id, round(weight, 6) AS weight FROM weights WHERE term <> ''")
def inverted_index(read):
    return text.inverted_index(_weigh(read, "tfidf"), several=False).select("term", "doc_id", _r("weight"))


@query("""SELECT unnest(string_split(lower(p_name) || ';' || lower(p_type), ';')) AS term, count(*) AS n FROM part GROUP BY 1""")
def concept_postings(read):
    rows = read("part").select(F.concat_ws(";", F.lower("p_name"), F.lower("p_type")).alias("term"), F.col("p_partkey").alias("doc_id"), F.lit(1.0).alias("weight"))
    return text.inverted_index(rows).groupBy("term").agg(F.sum("weight").cast("long").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS ascii_text FROM documents")
def strip_non_ascii(read):
    return read("documents").select("doc_id", scalars.strip_non_ascii("text").alias("ascii_text"))


@query(f"WITH {COUNTS} SELECT term, df FROM dfs WHERE regexp_matches(term, '[0-9]') AND regexp_matches(term, '[A-Za-z]')")
def mixed_tokens(read):
    return text.doc_freq(_counts(read)).where(scalars.mixed_token("term"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct({toks("coalesce(text, '')")}) AS words FROM documents),
l AS (SELECT * FROM (VALUES ('the entire'), ('license version'), ('public license version'), ('licencia, de la obra')) t(label)),
p AS (SELECT doc_id, label, words, list_filter(regexp_split_to_array(lower(label), '[ ,]+'), lambda x: x <> '') AS parts FROM w, l)
SELECT label, count(*) AS n_docs, CAST(sum(CASE WHEN len(list_filter(parts, lambda x: list_contains(words, x))) + CASE WHEN len(parts) > 2 THEN 1 ELSE 0 END >= len(parts) THEN 1 ELSE 0 END) AS BIGINT) AS n_found,
  CAST(sum(CASE WHEN len(list_filter(parts, lambda x: list_contains(words, x))) / len(parts) > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_covered FROM p GROUP BY label""")
def label_in_text(read):
    """How many documents mention the words of a few labels."""
    labels = F.explode(F.array(*(F.lit(x) for x in ("the entire", "license version", "public license version", "licencia, de la obra"))))
    rows = read("documents").select(F.array_distinct(scalars.tokens(F.coalesce("text", F.lit("")))).alias("words"), labels.alias("label"))
    found, covered = scalars.label_words_present(F.col("label"), F.col("words")), scalars.label_coverage(F.col("label"), F.col("words")) > 0.3
    return rows.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum(found.cast("long")).alias("n_found"), F.sum(covered.cast("long")).alias("n_covered"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT a.name AS a, b.name AS b, string_split(a.name, ' ') AS x, string_split(b.name, ' ') AS y FROM n a JOIN n b ON string_split(a.name, ' ')[1] = string_split(b.name, ' ')[1] AND a.name <= b.name)
SELECT a, b, round(200.0 * len(list_filter(y, lambda w: list_contains(x, w))) / (len(x) + len(y)), 6) AS dice FROM s""")
def phrase_dice(read):
    """Pairs of part names that begin alike."""
    names = read("part").select(F.col("p_name").alias("a")).distinct().withColumn("first", F.substring_index("a", " ", 1))
    both = names.join(names.withColumnRenamed("a", "b"), "first").where("a <= b")
    return both.select("a", "b", F.round(scalars.phrase_dice(F.col("a"), F.col("b")), 6).alias("dice"))


_PLAIN_TEXT = "trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS pmid, source AS journal, CAST(1990 + doc_id % 30 AS INTEGER) AS year, lang AS title, CAST(len(string_split({_PLAIN_TEXT}, ' ')) AS BIGINT) AS n_labels, md5({_PLAIN_TEXT}) AS digest FROM documents")
def tagged_text_roundtrip(read):
    """Documents, their whole texts on one line and each word as a label, written as tagged records and parsed again."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\t\\n\\x0b\\f\\r ]+", " "))
    labels = F.split(plain, " ")
    papers = read("documents").select(
        F.col("source").alias("journal"), F.transform(labels, lambda x: F.concat(F.lit("m"), x)).alias("meshMajor"), (1990 + F.col("doc_id") % 30).cast("int").alias("year"),
        plain.alias("abstractText"), F.col("doc_id").cast("string").alias("pmid"), F.col("lang").alias("title"),
    )
    back = corpus.from_tagged(corpus.to_tagged(papers))
    return back.select("pmid", "journal", "year", "title", F.size("meshMajor").cast("long").alias("n_labels"), F.md5("abstractText").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, lang AS journal, CAST(2000 + doc_id % 7 AS INTEGER) AS year, source AS title, md5(coalesce(text, '')) AS digest FROM documents")
def papers_roundtrip(read):
    """Documents as JSON lines with the line ends of a large array, parsed again."""
    body = F.to_json(F.struct(F.col("lang").alias("journal"), F.array("lang").alias("meshMajor"), (2000 + F.col("doc_id") % 7).alias("year"), F.coalesce("text", F.lit("")).alias("abstractText"), F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("title")))
    lines = read("documents").select(F.concat(body, F.when(F.col("doc_id") % 5 == 0, F.lit("]}")).otherwise(F.lit(","))).alias("value"))
    return corpus.parse_papers(lines).select("pmid", "journal", "year", "title", F.md5("abstractText").alias("digest"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_partition_counts(read):
    """Orders written by year and read again."""
    path = scratch(read)
    corpus.write_by_year(read("orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path)
    return read("orders").sparkSession.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey % 2 AS INTEGER) AS y, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS indexes, round(sum(l_quantity), 6) AS weights FROM lineitem GROUP BY 1")
def sparse_lines_roundtrip(read):
    """Line items as sparse training lines, parsed again."""
    rows = read("lineitem").select(F.array(F.struct(F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("weight"))).alias("f"), (F.col("l_orderkey") % 2).cast("int").alias("y"))
    back = corpus.from_sparse_line(rows.select(corpus.to_sparse_line("f", "y").alias("value")))
    return back.select("y", F.explode("features").alias("c")).groupBy("y").agg(F.count("*").alias("n"), F.sum("c.index").alias("indexes"), F.round(F.sum("c.weight"), 6).alias("weights"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 1")
def round_robin_sample(read):
    """One of four parts of the corpus: the sampling operator itself."""
    return text.round_robin(read("documents"), "doc_id", 4, 1).select("doc_id", "lang")


@query(f"""WITH e AS (SELECT DISTINCT unnest({toks("text")}) AS term FROM benchmark),
t AS (SELECT unnest({toks("coalesce(text, '')")}) AS term FROM conversations)
SELECT term AS concept, count(*) AS n FROM t JOIN e USING (term) GROUP BY term""")
def concept_exact(read):
    """Words of benchmark items in conversations, by exact match in their block."""
    words = read("benchmark").select(F.explode(scalars.tokens("text")).alias("term"))
    found = topics.match_concepts(text.tokenize(read("conversations").select(F.col("conv_id").alias("doc_id"), "text")), topics.dictionary(words), similar=1000.0)
    return found.groupBy("concept").agg(F.count("*").alias("n"))


@query("""SELECT CAST(page_id % 20 AS BIGINT) AS doc_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS concept, count(*) AS n FROM pages GROUP BY ALL""")
def tool_concepts(read):
    """Counts of concepts from the printed output of an external tool."""
    lines = read("pages").select((F.col("page_id") % 20).alias("doc_id"), F.concat(F.lit("[{u'term': u'"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit("', u'similarity': 1.0}]")).alias("line"))
    return topics.tool_concepts(lines)


@query()
def stemmed_counts(read):
    """Weighted counts of stems."""
    return text.weighted_counts(read("documents"), stemmed=True)


@query()
def stem_counts(read):
    """Distinct terms and their stems."""
    return text.doc_freq(_counts(read)).withColumn("stem", stem_udf("term"))


def _tag_sql() -> str:
    closed = " ".join(f"WHEN low IN ({', '.join(repr(w) for w, k in topics._CLOSED.items() if k == tag)}) THEN '{tag}'" for tag in dict.fromkeys(topics._CLOSED.values()))
    endings = " ".join(f"WHEN len(low) > {len(e) + 2} AND ends_with(low, '{e}') THEN '{tag}'" for e, tag in topics._ENDINGS)
    return f"""CASE {closed} WHEN regexp_full_match(t, '[0-9.,]+') THEN 'CD' WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}_]') THEN CASE WHEN t IN ('!', '?') THEN '.' ELSE ',' END {endings}
  WHEN regexp_matches(t, '^\\p{{Lu}}') AND pos > 0 AND before NOT IN ('!', '?') THEN 'NNP' WHEN ends_with(low, 's') AND NOT ends_with(low, 'ss') THEN 'NNS' ELSE 'NN' END"""


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+(?:[-''][\\p{{L}}\\p{{N}}_]+)*|[^\\p{{L}}\\p{{N}}_\\s]') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS pos, unnest(list_transform(w, lambda x: lower(x))) AS low, unnest(list_concat([''], w[1:len(w) - 1])) AS before FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, low, pos FROM (SELECT *, {_tag_sql()} AS tag FROM t) WHERE tag IN ('NNPS', 'JJ', 'FW', 'JJR', 'NNS', 'NNP', 'NN')),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k)
SELECT doc_id, string_agg(low, ' ' ORDER BY pos) AS phrase, CAST(min(pos) AS INTEGER) AS pos FROM g GROUP BY doc_id, run""")
def noun_phrases(read):
    return topics.tagged_phrases(read("documents"))


@query()
def topic_rank(read):
    """Ranks of the noun phrases of all documents."""
    return topics.topic_rank(topics.tagged_phrases(read("documents")))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(read):
    return windowed_counts(read("events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))
