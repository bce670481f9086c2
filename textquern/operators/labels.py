"""Label sets: probabilities, pairs, conditionals and rarity weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquern.functions import scalars

#: Countries, by continent.
COUNTRIES = """
algeria angola benin botswana burkina_faso burundi cameroon cape_verde central_african_republic chad comoros congo cote_d'ivoire djibouti
egypt equatorial_guinea eritrea ethiopia gabon gambia ghana guinea guinea-bissau kenya lesotho liberia libya madagascar malawi mali
mauritania mauritius morocco mozambique namibia niger nigeria rwanda senegal seychelles sierra_leone somalia south_africa sudan
swaziland tanzania togo tunisia uganda zambia zimbabwe
afghanistan armenia azerbaijan bahrain bangladesh bhutan brunei cambodia china georgia_(republic) india indonesia iran iraq israel
japan jordan kazakhstan korea kuwait kyrgyzstan laos lebanon malaysia mongolia myanmar nepal oman pakistan philippines qatar
republic_of_korea saudi_arabia singapore sri_lanka syria taiwan tajikistan thailand timor-leste turkey turkmenistan united_arab_emirates
uzbekistan vietnam yemen hong_kong macau
albania andorra austria belgium bosnia-herzegovina bulgaria belarus croatia cyprus czech_republic denmark estonia finland france germany
greece hungary iceland ireland italy kosovo latvia liechtenstein lithuania luxembourg macedonia_(republic) malta moldova monaco montenegro
netherlands norway poland portugal romania russia san_marino serbia slovakia slovenia spain sweden switzerland ukraine united_kingdom
england scotland wales great_britain northern_ireland vatican_city
bahamas barbados belize canada costa_rica cuba dominica dominican_republic el_salvador grenada guatemala haiti honduras jamaica mexico
nicaragua panama puerto_rico saint_lucia trinidad_and_tobago united_states argentina bolivia brazil chile colombia ecuador french_guiana
guyana paraguay peru suriname uruguay venezuela
australia fiji kiribati micronesia nauru new_caledonia new_zealand palau papua_new_guinea samoa solomon_islands tonga tuvalu vanuatu
"""
#: Labels that say who was studied and where rather than what.
CHECK_TAGS = (
    "humans", "animals", "swine", "male", "female", "infant", "child, preschool", "child", "adolescent", "young adult", "adult", "middle aged", "aged", "aged, 80 and over",
    *(c.replace("_", " ") for c in COUNTRIES.split()),
)


def document_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label): language, source and, where known, quality and toxicity."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    names = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source"), F.concat(F.lit("q:"), F.col("quality").cast("string")), F.concat(F.lit("tox:"), F.col("toxic").cast("string")))
    return docs.select("doc_id", "lang", "source").join(known, "doc_id", "left").select("doc_id", F.explode(names).alias("label")).where("label is not null").distinct()


def basket_labels(lineitem: DataFrame) -> DataFrame:
    """(doc_id, label): an order and its suppliers."""
    return lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("label")).distinct()


def without_check_tags(pairs: DataFrame, tags=CHECK_TAGS) -> DataFrame:
    """Pairs whose label isn't a check tag, whatever its case; an in-list of a fixed size, so nothing is joined."""
    return pairs.where(~F.lower("label").isin(*tags))


def label_counts(pairs: DataFrame) -> DataFrame:
    """(label, n_docs)."""
    return pairs.groupBy("label").agg(F.count("*").alias("n_docs"))


def probability(pairs: DataFrame, compat: bool = False) -> DataFrame:
    """(label, p): the share of documents with the label; `compat` leaves out documents of one label in the counts."""
    total = pairs.agg(F.count_distinct("doc_id").alias("n"))
    counted = pairs.withColumn("k", F.count("*").over(Window.partitionBy("doc_id"))).where("k > 1") if compat else pairs
    return label_counts(counted).join(F.broadcast(total)).select("label", F.try_divide("n_docs", "n").alias("p"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(label_a, label_b, n_docs) for unordered pairs a < b.

    The sets of a document meet by doc_id, so no pair needs a second shuffle before its partial count.
    """
    sets = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    both = sets.select(F.posexplode("labels").alias("i", "label_a"), "labels").select("label_a", F.explode(F.slice("labels", F.col("i") + 2, F.size("labels"))).alias("label_b"))
    return both.groupBy("label_a", "label_b").agg(F.count("*").alias("n_docs"))


def conditional(pairs: DataFrame) -> DataFrame:
    """(label_a, label_b, p_ab, p_a_given_b, p_b_given_a)."""
    total = pairs.agg(F.count_distinct("doc_id").alias("n"))
    single = label_counts(pairs)
    a, b = (single.select(F.col("label").alias(f"label_{x}"), F.col("n_docs").alias(f"n_{x}")) for x in "ab")
    rows = pair_counts(pairs).join(a, "label_a").join(b, "label_b").join(F.broadcast(total))
    return rows.select("label_a", "label_b", (F.col("n_docs") / F.col("n")).alias("p_ab"), (F.col("n_docs") / F.col("n_b")).alias("p_a_given_b"), (F.col("n_docs") / F.col("n_a")).alias("p_b_given_a"))


def extremes(p: DataFrame) -> DataFrame:
    """(p_min, p_max)."""
    return p.agg(F.min("p").alias("p_min"), F.max("p").alias("p_max"))


def rarity_weights(p: DataFrame, kind: str = "rarity") -> DataFrame:
    """(label, weight): `rarity`, `kmeans` or `hac`."""
    value = {
        "rarity": lambda: scalars.rarity_weight(F.col("p"), F.col("p_min"), F.col("p_max")),
        "kmeans": lambda: scalars.inverse_weight(F.col("p"), F.col("p_min"), F.col("p_max")),
        "hac": lambda: scalars.inverse_weight(F.col("p"), F.col("p_min"), F.col("p_max"), 0.01),
    }[kind]()
    return p.join(F.broadcast(extremes(p))).select("label", value.alias("weight"))


def occurrence(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(label, n_docs, n_mentioned, ratio): documents with the label, and those of them whose text has the label's words (one may miss of over two)."""
    words = docs.select("doc_id", F.array_distinct(scalars.tokens(F.coalesce("text", F.lit("")))).alias("words"))
    rows = pairs.join(words, "doc_id").select("label", scalars.label_words_present(F.col("label"), F.col("words")).cast("long").alias("m"))
    return rows.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum("m").alias("n_mentioned")).withColumn("ratio", F.col("n_mentioned") / F.col("n_docs"))


def label_vectors(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(vec_id, feature, value): each document's labels with their weights."""
    return pairs.join(weights, "label").select(F.col("doc_id").alias("vec_id"), F.col("label").alias("feature"), F.col("weight").alias("value"))
