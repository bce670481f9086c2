"""Tagging, noun phrases, topic ranking and dictionary concepts."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textquern.functions import scalars
from textquern.operators import labels
from textquern.session import cut, small_batches

SIMILAR = 33.32
DAMPING, ROUNDS = 0.85, 20

#: Characters of text that are tagged at once, and rows that leave a Python worker at once.
AT_ONCE, ROWS = 1 << 18, 1 << 14
#: Places of a document up to which all their distances are held at once; for more, a convolution gives their sums.
DENSE = 400
#: Labels whose ranks the driver and every task may hold.
NODES = 1 << 21
#: Known phrases with the words of a new one, from which on they are counted in arrays.
MANY = 64

_CLOSED = {
    **dict.fromkeys(("the", "a", "an", "this", "that", "these", "those", "la", "le", "les", "der", "die", "das", "el", "los"), "DT"),
    **dict.fromkeys(("of", "in", "on", "at", "by", "for", "with", "from", "as", "de", "von", "mit", "en", "con"), "IN"),
    **dict.fromkeys(("and", "or", "but", "nor", "et", "und", "y", "ou"), "CC"),
    **dict.fromkeys(("is", "was", "are", "were", "be", "been", "has", "have", "had", "est", "ist", "es"), "VBZ"),
    **dict.fromkeys(("it", "he", "she", "they", "we", "you", "i"), "PRP"), "to": "TO", "not": "RB",
}
_ENDINGS = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ")]


_NUMBER, _WORD, _ENDS = re.compile(r"[0-9.,]+"), re.compile(r"\w"), tuple(e for e, _ in _ENDINGS)
#: Tags of tokens by themselves, of at most 1 << 16 short ones; those marked with ? are names inside a sentence.
_KNOWN: dict[str, str] = {}


def _tag_of(t: str) -> str:
    """The tag of a token by itself, marked with ? if it is a name's inside a sentence."""
    low = t.lower()
    if low in _CLOSED:
        return _CLOSED[low]
    if _NUMBER.fullmatch(t):
        return "CD"
    if not _WORD.search(t):
        return "." if t in ".!?" else ","
    if low.endswith(_ENDS) and (tag := next((k for e, k in _ENDINGS if len(low) > len(e) + 2 and low.endswith(e)), None)):
        return tag
    return ("?" if t[0].isupper() else "") + ("NNS" if low.endswith("s") and not low.endswith("ss") else "NN")


def suffix_tagger(tokens: list[str]) -> list[str]:
    """Tags from a list of closed-class words and endings; a stand-in for a trained tagger, with the same tag set."""
    out = list(map(_KNOWN.get, tokens))
    for i, tag in enumerate(out):
        if tag is None:
            tag = out[i] = _tag_of(t := tokens[i])
            if len(t) < 40:
                if len(_KNOWN) >= 1 << 16:
                    _KNOWN.clear()
                _KNOWN[t] = tag
        if tag[0] == "?":
            out[i] = "NNP" if i and out[i - 1] != "." else tag[1:]
    return out


_SPLIT = re.compile(r"\w+(?:[-']\w+)*|[^\w\s]")


def _tagged(docs: DataFrame, tagger: Callable[[list[str]], list[str]], emit: Callable, fields: str) -> DataFrame:
    """(doc_id, fields): columns that `emit` makes of the tokens and tags of some texts, whose rows follow each other.

    `emit` gives the number of rows of each text and the columns. Texts go to Python in small batches
    and are tagged AT_ONCE characters at a time, so that a worker's memory doesn't grow with the table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= AT_ONCE):
                    size, end = size + len(texts[end]), end + 1
                words = [_SPLIT.findall(t) for t in texts[start:end]]
                counts, columns = emit(words, [tagger(w) for w in words])
                at = pa.array(np.repeat(np.arange(start, end), counts))
                out = [batch.column(0).take(at), *columns]
                for k in range(0, len(at), ROWS):
                    yield pa.RecordBatch.from_arrays([c.slice(k, ROWS) for c in out], names)
                start = end

    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(fields)])
    names = schema.names
    return rows.mapInArrow(run, schema)


def tag(docs: DataFrame, tagger: Callable[[list[str]], list[str]] = suffix_tagger) -> DataFrame:
    """(doc_id, tokens): arrays of (token, pos) of whole texts; any tagger from tokens to tags can be given."""

    def emit(words, tags):
        flat = [pa.array([x for one in part for x in one], pa.string()) for part in (words, tags)]
        ends = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
        return np.ones(len(words), int), [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["token", "pos"]))]

    return _tagged(docs, tagger, emit, "tokens array<struct<token:string,pos:string>>")


def tagged_phrases(docs: DataFrame, tagger: Callable[[list[str]], list[str]] = suffix_tagger) -> DataFrame:
    """(doc_id, phrase, pos): the rows of `noun_phrases(tag(docs))`, of which only phrases leave the Python workers."""
    keep = frozenset(scalars.KEEP_TAGS)

    def emit(words, tags):
        counts, phrases, places = [], [], []
        for w, t in zip(words, tags):
            before, first = len(phrases), -1
            for i, x in enumerate(t):
                if x in keep:
                    if first < 0:
                        first = i
                elif first >= 0:
                    phrases.append(" ".join(w[first:i]))
                    places.append(first)
                    first = -1
            if first >= 0:
                phrases.append(" ".join(w[first:]))
                places.append(first)
            counts.append(len(phrases) - before)
        return counts, [pa.array(phrases, pa.string()), pa.array(places, pa.int32())]

    return _tagged(docs, tagger, emit, "phrase string, pos int").select("doc_id", F.lower("phrase").alias("phrase"), "pos")


def tagged_terms(docs: DataFrame, tagger: Callable[[list[str]], list[str]] = suffix_tagger) -> DataFrame:
    """(doc_id, pos, term): lower-case tokens of texts that aren't in the drop list, by their place."""
    drop = frozenset(scalars.DROP_TAGS)

    def emit(words, tags):
        counts, terms, places = [], [], []
        for w, t in zip(words, tags):
            kept = [i for i, x in enumerate(t) if x not in drop]
            counts.append(len(kept))
            places += kept
            terms += [w[i] for i in kept]
        return counts, [pa.array(places, pa.int32()), pa.array(terms, pa.string())]

    return _tagged(docs, tagger, emit, "pos int, term string").select("doc_id", "pos", F.lower("term").alias("term"))


def keep_tags(tokens: Column | str, tags=scalars.KEEP_TAGS) -> Column:
    return F.filter(tokens, lambda t: t["pos"].isin(*tags))


def drop_tags(tokens: Column | str, tags=scalars.DROP_TAGS) -> Column:
    return F.filter(tokens, lambda t: ~t["pos"].isin(*tags))


def noun_phrases(tagged: DataFrame) -> DataFrame:
    """(doc_id, phrase, pos): maximal runs of kept tags, lower case, by the place of their first token.

    Inside the array: the places before a token that isn't kept bound the runs, so a text takes linear
    time and no shuffle is needed.
    """
    size = F.size("tokens")
    kept = lambda i: F.coalesce(F.get("tokens", i)["pos"].isin(*scalars.KEEP_TAGS), F.lit(False))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    bounds = tagged.select(
        "doc_id", "tokens",
        F.filter(places, lambda i: kept(i) & ~kept(i - 1)).alias("first"), F.filter(places, lambda i: kept(i) & ~kept(i + 1)).alias("last"),
    )
    word = lambda t: F.lower(t["token"])
    runs = F.zip_with("first", "last", lambda a, b: F.struct(F.array_join(F.transform(F.slice("tokens", a + 1, b - a + 1), word), " ").alias("phrase"), a.alias("pos")))
    return bounds.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.phrase", "r.pos")


def rank(w: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """Synchronous damped ranks: s_i = 0.15 + 0.85 sum of w_ij s_j / (column sum of j); an empty column gives nothing."""
    columns = w.sum(axis=0)
    share = np.divide(w, columns[None, :], out=np.zeros_like(w, float), where=columns[None, :] > 0)
    s = np.ones(len(w))
    for _ in range(rounds):
        s = (1 - damping) + damping * share @ s
    return s


def dice(a: str, b: str) -> float:
    """100 for the same words, else 200 x common / words of both."""
    x, y = a.split(" "), b.split(" ")
    return 200.0 * sum(w in x for w in y) / (len(x) + len(y))


def _inverse(at: np.ndarray) -> np.ndarray:
    """1 / distance of each two places, 0 for equal ones."""
    d = np.abs(np.subtract.outer(at, at))
    d[d == 0] = np.inf
    return 1.0 / d


def affinity(places: list[list[int]]) -> np.ndarray:
    """w_ij: the sum of 1 / distance over all places of both; distances of 0 are left out."""
    w, some = np.zeros((len(places), len(places))), [i for i, p in enumerate(places) if p]
    if some:
        inverse = _inverse(np.fromiter(chain.from_iterable(places), float))
        starts = np.cumsum([0, *(len(places[i]) for i in some)])[:-1]
        sums = np.add.reduceat(np.add.reduceat(inverse, starts, 0).T.copy(), starts, 0)
        w[np.ix_(some, some) if len(some) < len(places) else ...] = sums
        np.fill_diagonal(w, 0.0)
    return w


def _near(size: int) -> Callable[[np.ndarray], np.ndarray]:
    """The function from values at 0 .. size - 1 to the sums, at each place, of all other places' values over their distance."""
    length = 1 << (2 * size - 1).bit_length()
    inverse = np.zeros(length)
    inverse[1:size] = 1.0 / np.arange(1, size)
    inverse[length - size + 1 :] = inverse[1:size][::-1]
    spectrum = np.fft.rfft(inverse)
    return lambda values: np.fft.irfft(np.fft.rfft(values, length) * spectrum, length)[:size]


def rank_places(places: list[list[int]], damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """`rank(affinity(places))`, with memory that grows with the places and not with their square: affinities depend on
    distances alone, so a round is a convolution."""
    sizes = [len(p) for p in places]
    if sum(sizes) <= DENSE:
        return rank(affinity(places), damping, rounds)
    flat, owner = np.fromiter(chain.from_iterable(places), int), np.repeat(np.arange(len(places)), sizes)
    flat = flat - flat.min()
    size = int(flat.max()) + 1
    near = _near(size)
    spread = lambda x: near(np.bincount(flat, x[owner], size))
    gather = lambda y: np.bincount(owner, y[flat], len(places))
    own, start = np.zeros(len(places)), 0  # a topic's affinity to itself doesn't count
    for i, n in enumerate(sizes):
        at, start = flat[start : start + n], start + n
        if 1 < n <= 1000:
            own[i] = _inverse(at.astype(float)).sum()
        elif n > 1000:
            own[i] = near(np.bincount(at, minlength=size).astype(float))[at].sum()
    columns = gather(spread(np.ones(len(places)))) - own
    columns[columns < 0.5 / size] = 0.0  # the least affinity is over 1 / size, the rest is rounding
    inverse = np.divide(1.0, columns, out=np.zeros(len(places)), where=columns > 0)
    if len(places) == 1:
        inverse[:] = 0.0
    s = np.ones(len(places))
    for _ in range(rounds):
        x = s * inverse
        s = (1 - damping) + damping * (gather(spread(x)) - own * x)
    return s


def merge_topics(phrases: list[tuple[str, int]], similar: float = SIMILAR) -> list[dict[str, list[int]]]:
    """Topics in the order of the text: the first topic with a phrase over `similar` takes a phrase; a known phrase adds its place.

    The common words with all known phrases are counted through an index of words.
    """
    topics: list[dict[str, list[int]]] = []
    owner: dict[str, int] = {}
    having: dict[str, array] = {}  # by word, the known phrases that have it, in the order of the text
    alone: dict[str, int] = {}  # by word, the first topic with a phrase that is over `similar` to the word itself
    topic_of, length = array("i"), array("i")  # of known phrases
    for phrase, pos in phrases:
        topic = owner.get(phrase)
        if topic is None:
            words = phrase.split(" ")
            n, mine = len(words), dict.fromkeys(words, 1)
            if len(mine) < n:
                mine = Counter(words)
            lists = [(k, having[w]) for w, k in mine.items() if w in having] if n > 1 else []
            if n == 1:
                topic = alone.get(phrase)
            elif not lists:
                topic = None
            elif sum(len(x) for _, x in lists) < MANY:
                common: dict[int, int] = {}
                for k, known in lists:
                    for v in known:
                        common[v] = common.get(v, 0) + k
                topic = min((topic_of[v] for v, c in common.items() if 200.0 * c / (length[v] + n) > similar), default=None)
            else:
                counts = np.zeros(len(topic_of))
                for k, known in lists:
                    counts[np.frombuffer(known, np.int32)] += k
                hits = np.frombuffer(topic_of, np.int32)[(200.0 * counts / (np.frombuffer(length, np.int32) + n) > similar) & (counts > 0)]
                topic = int(hits.min()) if len(hits) else None
            if topic is None:
                topic = len(topics)
                topics.append({})
            owner[phrase] = topic
            for w in mine:
                having.setdefault(w, array("i")).append(len(topic_of))
                if 200.0 / (n + 1) > similar:
                    alone[w] = min(alone.get(w, topic), topic)
            topic_of.append(topic)
            length.append(n)
        topics[topic].setdefault(phrase, []).append(pos)
    return topics


def affinity_edges(places: DataFrame) -> DataFrame:
    """(doc_id, a, b, weight), a < b, of (doc_id, topic, pos): the same affinities by a join inside each document."""
    left = places.select("doc_id", F.col("topic").alias("a"), F.col("pos").alias("p"))
    right = places.select("doc_id", F.col("topic").alias("b"), F.col("pos").alias("q"))
    return left.join(right, "doc_id").where("a < b and p <> q").groupBy("doc_id", "a", "b").agg(F.sum(1.0 / F.abs(F.col("p") - F.col("q"))).alias("weight"))


def topic_rank(phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase, score) of (doc_id, phrase, pos): every variant of a topic has its topic's rank.

    Documents follow each other in sorted partitions; a worker holds one document and the rows of a batch.
    Phrases at one place count in the order of their names.
    """
    small_batches(phrases.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, scores = [], [], []
        key, found = None, []

        def close():
            topics = merge_topics(found)
            for t, s in zip(topics, rank_places([sum(t.values(), []) for t in topics])):
                names.extend(t)
                scores.extend([float(s)] * len(t))
            ids.extend([key] * (len(names) - len(ids)))

        def full():
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "phrase", "score"])
            for x in (ids, names, scores):
                x.clear()
            return batch

        for batch in batches:
            for doc_id, phrase, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id != key and found:
                    close()
                    found = []
                    if len(ids) >= ROWS:
                        yield full()
                key = doc_id
                found.append((phrase, pos))
        if found:
            close()
        if ids:
            yield full()

    rows = phrases.select(F.col("doc_id").cast("long").alias("doc_id"), "phrase", F.col("pos").cast("int").alias("pos"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "phrase").mapInArrow(run, "doc_id long, phrase string, score double")


def weighted_pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(node, rank) of a weighted undirected graph (src, dst, weight) of any size, by joins; each round is checkpointed."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    sums = both.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(both.join(sums, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ranks = sums.select(F.col("src").alias("node"), F.lit(1.0).alias("rank"))
    for n in range(rounds):
        inflow = share.join(ranks.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("s"))
        ranks = sums.select(F.col("src").alias("node")).join(inflow.withColumnRenamed("dst", "node"), "node", "left").select("node", (1 - damping + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if n % 5 == 4:
            ranks = cut(ranks)
    return ranks


def basket_pagerank(pairs: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, nodes: int = NODES) -> DataFrame:
    """(node, rank) on the graph of labels that share documents, of distinct (doc_id, label): the ranks of
    `weighted_pagerank` with the number of common documents as weight.

    No edge is made: what the others of a document send to one of its labels is the document's sum less
    the label's own, so a round reads each document once. Up to `nodes` labels the ranks are a vector that
    every task has and the driver adds up; with more the edges are made and joined.
    """
    names = cut(pairs.select("label").where("label is not null").distinct())
    n = names.count()
    if n > nodes:
        e = labels.pair_counts(pairs)
        return weighted_pagerank(e.select(F.col("label_a").alias("src"), F.col("label_b").alias("dst"), F.col("n_docs").cast("double").alias("weight")), rounds, damping)
    names = cut(names.withColumn("i", F.row_number().over(Window.orderBy("label")) - 1))  # at most `nodes` rows
    spark = pairs.sparkSession
    sets = cut(pairs.join(F.broadcast(names), "label").groupBy("doc_id").agg(F.collect_set("i").alias("at")).where("size(at) > 1").select("at"))
    sets = sets.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def inflow(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n)
            for batch in batches:
                column = batch.column(0)
                starts, at = column.offsets.to_numpy(), column.flatten().to_numpy()
                if len(at):
                    starts = starts - starts[0]
                    values = x[at]
                    sums = np.add.reduceat(values, starts[:-1])
                    out += np.bincount(at, np.repeat(sums, np.diff(starts)) - values, n)
            found = np.flatnonzero(out)
            for k in range(0, len(found), ROWS):
                part = found[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(out[part])], ["i", "s"])

        total = np.zeros(n)
        got = sets.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        total[got["i"].to_numpy()] = got["s"].to_numpy()
        return total

    totals = inflow(np.ones(n))
    share = np.divide(1.0, totals, out=np.zeros(n), where=totals > 0)
    ranks = np.ones(n)
    for _ in range(rounds):
        ranks = (1 - damping) + damping * inflow(ranks * share)
    some = np.flatnonzero(totals > 0)
    if not len(some):
        return names.where("false").select(F.col("label").alias("node"), F.lit(1.0).alias("rank"))
    found = spark.createDataFrame(pa.table({"i": some.astype(np.int32), "rank": ranks[some]}))
    return names.join(found, "i").select(F.col("label").alias("node"), "rank")


# ---- dictionary concepts
def dictionary(terms: DataFrame) -> DataFrame:
    """(term, prefix): distinct lower-case terms with their block key, the first three characters."""
    low = F.lower(F.trim("term"))
    return terms.select(low.alias("term")).where("term <> ''").distinct().withColumn("prefix", F.substring("term", 1, 3))


def match_concepts(tokens: DataFrame, entries: DataFrame, similar: float = 30.0) -> DataFrame:
    """(doc_id, pos, token, concept) of (doc_id, pos, term): the exact entry, else all of the block whose word overlap is over `similar`.

    Distinct tokens are matched once, with the entries of their block that have a word of theirs, then
    joined back; only a negative `similar` takes entries without a common word.
    """
    words = lambda df: df.select("term", "prefix", F.explode(F.array_distinct(F.split("term", " "))).alias("word")) if similar >= 0 else df
    distinct = tokens.select("term").distinct().withColumn("prefix", F.substring("term", 1, 3))
    known = words(entries.select("term", "prefix")).withColumnRenamed("term", "concept")
    block = words(distinct).join(known, ["prefix", "word"] if similar >= 0 else "prefix").select("term", "concept").distinct()
    scored = block.select("term", "concept", scalars.phrase_dice(F.col("term"), F.col("concept")).alias("s"), (F.col("term") == F.col("concept")).alias("exact"))
    best = scored.where(F.col("exact") | (F.col("s") > similar)).groupBy("term").agg(F.max("exact").alias("any_exact"), F.collect_set(F.struct("concept", "exact")).alias("found"))
    kept = best.select("term", F.explode(F.filter("found", lambda c: ~F.col("any_exact") | c["exact"])).alias("c")).select("term", "c.concept")
    return tokens.join(kept, "term").select("doc_id", "pos", F.col("term").alias("token"), "concept")


def concept_rank(tagged: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, phrase, score) of tagged documents: the dictionary concepts of tokens outside the drop list, ranked like topics."""
    kept = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), F.lower(t["token"]).alias("term"), t["pos"].alias("tag"))), lambda t: ~t["tag"].isin(*scalars.DROP_TAGS))
    tokens = tagged.select("doc_id", F.explode(kept).alias("t")).select("doc_id", "t.pos", "t.term")
    return rank_concepts(tokens, entries)


def rank_concepts(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, phrase, score) of tokens (doc_id, pos, term)."""
    return topic_rank(match_concepts(tokens, entries).select("doc_id", F.col("concept").alias("phrase"), "pos"))


def tool_concepts(lines: DataFrame) -> DataFrame:
    """(doc_id, concept, n) of tool output (doc_id, line): the values of u'term': u'...' entries."""
    found = F.regexp_extract_all("line", F.lit(r"u'term': u'([^']*)'"), F.lit(1))
    return lines.select("doc_id", F.explode(found).alias("concept")).groupBy("doc_id", "concept").agg(F.count("*").alias("n"))


def remaining(inputs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Inputs (doc_id, n_lines) whose parsed lines (doc_id, line) aren't all there yet."""
    done = parsed.groupBy("doc_id").agg(F.count("*").alias("n_parsed"))
    return inputs.join(done, "doc_id", "left").where(~F.coalesce(F.col("n_parsed") == F.col("n_lines"), F.lit(False))).select("doc_id", "n_lines")
