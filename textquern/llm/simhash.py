"""SimHash near-dedup with pivot distance tables.

Fingerprint: the XXH64 (seed 42) of every three-word shingle votes for each of 64 bits; a bit is set
by more than half of them.

Pairs: each distinct fingerprint gets its Hamming distances to reference fingerprints (pivots). 32
pivots with two neighbouring bits each, and the empty one, are laid out so that the distances of two
fingerprints within two bits agree on at least two of the four quarters of the pivots; the six pairs
of quarters are the keys of an equi-join, so no close pair is lost. Eight more pivots have mixed
bits; a joined pair whose largest coordinate difference exceeds two is discarded (the triangle
inequality), and what survives is verified by its own distance.

A key that more than HOT distinct fingerprints share isn't joined. Its fingerprints go another,
also exact way: each is put under the 65 fingerprints within one bit, where two within two bits
meet; a place there holds 65 fingerprints at most, however skewed the data.

Copies share a fingerprint and are one node; components come from `graph.components`, whose nodes
have at most 2080 neighbours at first.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, which is linked
like any other; one or two words are one shingle; repeated rows get the same result each; rows
without a doc_id take part but can't name a component (it is null if no row of it has an id); equal
fingerprints are one node, so ties need no rule; other columns are ignored by `near_groups` and kept,
of any type and name, by `keep_one`.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import arrow_map, cut, hot_join, texts
from textquern.llm.graph import components
from textquern.llm.nearcopies import near_copies, text_names

#: Distinct fingerprints under one key that are still compared with each other.
HOT = 64
#: Most rows of near copies that are told by broadcast (counted first).
SMALL = 1_000_000
#: Bits that a link may differ in.
REACH = 2
_BLOCK = 1 << 16
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Two neighbouring bits each; and eight of mixed bits.
BLOCK_PIVOTS = [_signed(3 << (2 * j)) for j in range(32)]
MIXED_PIVOTS = [_signed((0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD6E8FEB86659FD93 * (k + 7)) & _MASK) for k in range(8)]


def fingerprint_text(text: str) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-3]]
    n = len(starts)
    counts = np.zeros(64, np.int64)
    spans = map(joined.__getitem__, map(slice, starts, (e - 1 for e in ends[2:])))
    hashes = map(xxhash.xxh64_intdigest, spans, repeat(42))
    for i in range(0, n, _BLOCK):
        block = np.fromiter(hashes, np.uint64, min(_BLOCK, n - i)).astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint_text(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(b).cast("long") if isinstance(b, int) else b))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, keys, far): the six keys made of the block pivots' distances, and the mixed pivots' distances, seven bits each."""
    fp = F.col("fp")
    zero = _distance(fp, 0)
    quarters = []
    for q in range(4):
        number = F.lit(0)
        for j, pivot in enumerate(BLOCK_PIVOTS[8 * q : 8 * q + 8]):
            number = number + F.shiftright(zero + 2 - _distance(fp, pivot), 1) * (3**j)
        quarters.append(number.cast("long").alias(f"q{q}"))
    far = F.lit(0).cast("long")
    for k, pivot in enumerate(MIXED_PIVOTS):
        far = far.bitwiseOR(F.shiftleft(_distance(fp, pivot).cast("long"), 7 * k))
    rows = distinct.select("fp", far.alias("far"), *quarters)
    keys = F.array(*(F.lit(n * 6561 * 6561).cast("long") + F.col(f"q{a}") * 6561 + F.col(f"q{b}") for n, (a, b) in enumerate(combinations(range(4), 2))))
    return rows.select("fp", "far", keys.alias("keys"))


def close_pairs(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (fp) within REACH bits."""
    rows = cut(pivot_table(distinct).select("fp", "far", F.explode("keys").alias("key")))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, "key")
    cold = shared.where(F.col("n") <= hot).select("key", "fp", "far")
    a, b = cold.select("key", F.col("fp").alias("a"), F.col("far").alias("fa")), cold.select("key", F.col("fp").alias("b"), F.col("far").alias("fb"))
    near = F.col("a") < F.col("b")
    for k in range(len(MIXED_PIVOTS)):
        x, y = (F.shiftright(F.col(c), 7 * k).bitwiseAND(F.lit(127).cast("long")) for c in ("fa", "fb"))
        near = near & (F.abs(x - y) <= REACH)
    found = a.join(b, "key").where(near & (_distance(F.col("a"), F.col("b")) <= REACH)).select("a", "b")
    crowd = shared.where(F.col("n") > hot).select("fp").distinct()
    places = crowd.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i) if i < 64 else 0).cast("long")) for i in range(65)))).alias("place"))
    p, q = places.select("place", F.col("fp").alias("a")), places.select("place", F.col("fp").alias("b"))
    return found.union(p.join(q, "place").where("a < b").select("a", "b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    roots = components(close_pairs(distinct.select("fp")))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    named = cut(hot_join(rooted, least, ["root"]).select("fp", "component_id", F.col("copies").alias("_n")))
    return hot_join(prints, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One document of each group of near copies, with all columns: its smallest doc_id; no doc_id only if no row has one.

    The groups are those of `nearcopies` (five words, Jaccard 0.8): links of close fingerprints first,
    by the same pivot distance tables, then those that fingerprints are too far apart for. Rows are
    judged by what they hold: rows that share a doc_id but not a text are in groups of their own. Of
    repeated rows (one doc_id, one text) one stays, whatever their other columns, which may have any
    type. Rows that go are told by doc_id and a hash of the text; up to `small` of these are broadcast,
    so texts stay where they are, more meet by shuffle. Only repeated rows are ever gathered whole.
    """
    found = cut(near_copies(docs, close_pairs).select("doc_id", "h1", "h2", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    rows = found.groupBy("root", "doc_id", "h1", "h2").agg(F.count("*").alias("k"))
    heads = rows.groupBy("root").agg(F.min(rank).alias("h"), F.count("*").alias("_n"))
    judged = hot_join(rows, heads, ["root"]).select("doc_id", "h1", "h2", "k", rank.eqNullSafe(F.col("h")).alias("head"))
    # rows that go, and rows of which several are the same: all others need no second look
    odd = cut(judged.where("not head or k > 1").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "head"))
    few = odd.count() <= small
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"), *text_names(F.coalesce("text", F.lit(""))))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    marked = keyed.join(F.broadcast(odd) if few else odd, same, "left")
    repeated = marked.where("head").dropDuplicates(["_own", "h1", "h2"])
    return marked.where("head is null").select("_row.*").union(repeated.select("_row.*"))
