"""Column functions: text, sparse vectors as maps, and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of nouns, adjectives and foreign words, which carry a text's terms.
KEEP_TAGS = ("NNPS", "JJ", "FW", "JJR", "NNS", "NNP", "NN")
#: Tags that concept matching leaves out.
DROP_TAGS = tuple(
    "# $ '' `` , . : -LRB- -RRB- CC CD DT EX IN MD PDT POS PRP PRP$ TO UH VB VBD VBN VBP VBZ WDT WP WP$ WRB".split()
)


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip_non_ascii(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def commas_to_spaces(text: Column | str) -> Column:
    return F.lower(F.translate(text, ",", " "))


def mixed_token(token: Column | str) -> Column:
    """Whether a token has a digit as well as a letter."""
    token = F.col(token) if isinstance(token, str) else token
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def phrase_dice(a: Column, b: Column) -> Column:
    """200 x common words / words of both; 100 for equal word lists, 0 when both are empty."""
    x, y = F.split(a, " "), F.split(b, " ")
    common = F.size(F.filter(y, lambda w: F.array_contains(x, w)))
    return F.coalesce(F.try_divide(F.lit(200.0) * common, F.size(x) + F.size(y)), F.lit(0.0))


def label_words_present(label: Column, words: Column) -> Column:
    """Whether the label's words are among `words`; one may miss if the label has over two."""
    parts = F.filter(F.split(F.lower(label), "[ ,]+"), lambda w: w != "")
    hits = F.size(F.filter(parts, lambda w: F.array_contains(words, w)))
    return hits + F.when(F.size(parts) > 2, 1).otherwise(0) >= F.size(parts)


def label_coverage(label: Column, words: Column) -> Column:
    """Share of the label's words that are among `words`."""
    parts = F.filter(F.split(F.lower(label), "[ ,]+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(parts, lambda w: F.array_contains(words, w))).cast("double"), F.size(parts)), F.lit(0.0))


def rarity_weight(p: Column, low: Column, high: Column) -> Column:
    """0.5 + 1 - (0.5 + 0.5 scaled): 1 for the rarest label, 0.5 for the commonest."""
    return F.lit(1.5) - (0.5 + 0.5 * F.coalesce(F.try_divide(p - low, high - low), F.lit(0.0)))


def inverse_weight(p: Column, low: Column, high: Column, floor: float = 0.0) -> Column:
    """1 - (floor + (1 - floor) scaled): floor 0 for k-means vectors, 0.01 for agglomerative ones."""
    return F.lit(1.0) - (floor + (1 - floor) * F.coalesce(F.try_divide(p - low, high - low), F.lit(0.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def map_length(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(v), lambda x: x * x)))


def map_dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))))


def map_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two sparse vectors (maps of doubles); 0 if one has no length."""
    return F.coalesce(F.try_divide(map_dot(a, b), map_length(a) * map_length(b)), F.lit(0.0))


def map_jaccard(a: Column | str, b: Column | str) -> Column:
    """Common feature names over all feature names; 0 if there are none."""
    x, y = F.map_keys(a), F.map_keys(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def map_rescale(v: Column | str, length: float) -> Column:
    """The vector with the given length; unchanged if it has none. Its own length is taken once, not for each value."""
    v = F.col(v) if isinstance(v, str) else v
    once = F.array(F.struct(v.alias("v"), map_length(v).alias("own")))
    return F.transform(once, lambda p: F.transform_values(p["v"], lambda k, x: F.when(p["own"] > 0, x * F.lit(length) / p["own"]).otherwise(x)))[0]


def tfidf(tf: Column, dl: Column, n: Column, df: Column) -> Column:
    return tf / dl * F.log10(n / df)


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, k: float = 1.5, b: float = 0.75) -> Column:
    """Negative for terms of over half the documents."""
    return tf * (k + 1) / (tf + k * (1 - b + b * dl / avgdl)) * F.log10((n - df + 0.5) / (df + 0.5))


def precision(correct: Column, predicted: Column) -> Column:
    return F.coalesce(F.try_divide(correct.cast("double"), predicted), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def float_array(text: Column | str) -> Column:
    """Doubles of a text of numbers between commas or spaces."""
    return F.transform(F.filter(F.split(text, "[, ]+"), lambda x: x != ""), lambda x: x.cast("double"))


def content_id(*columns: Column | str) -> Column:
    """An id from what a row holds; the same on every run."""
    return F.md5(F.concat_ws("\u0001", *columns))


def int_array(text: Column | str) -> Column:
    """Whole numbers of a text of numbers between commas or spaces."""
    return F.transform(F.filter(F.split(text, "[, ]+"), lambda x: x != ""), lambda x: x.cast("long"))


def sentences(text: Column | str) -> Column:
    """The sentences of a text: up to its stops, question and exclamation marks and line ends, without the space around them."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def map_blend(a: Column | str, b: Column | str, x: float, y: float) -> Column:
    """x times a plus y times b, over the features of both."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda k, u, v: x * F.coalesce(u, zero) + y * F.coalesce(v, zero))


def map_get(v: Column | str, feature: str) -> Column:
    """The value of a feature; 0 where the vector doesn't have it."""
    return F.coalesce(F.try_element_at(v, F.lit(feature)), F.lit(0.0))


def has_feature(v: Column | str, feature: str) -> Column:
    return F.map_contains_key(v, feature)


def power(base: Column, exponent: int) -> Column:
    """A whole power by squaring, exact as long as the products are."""
    out, square, n = F.lit(1.0), base.cast("double"), abs(exponent)
    while n:
        if n & 1:
            out = out * square
        square, n = square * square, n >> 1
    return out if exponent >= 0 else 1.0 / out


def against_rest(label: Column | str, positive) -> Column:
    """1 for one label and 0 for all others."""
    return F.when(F.col(label) == F.lit(positive) if isinstance(label, str) else label == F.lit(positive), 1).otherwise(0)


def escape_commas(text: Column | str, mark: str = "&coma;") -> Column:
    """Commas as a mark, for reports that don't quote."""
    return F.replace(F.col(text) if isinstance(text, str) else text, F.lit(","), F.lit(mark))


def distinct_in_order(values: Column | str) -> Column:
    """The values without repetitions, each where it first stands."""
    return F.array_distinct(values)
