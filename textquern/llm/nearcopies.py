"""Near copies: texts whose sets of five-word shingles have a Jaccard index of 0.8 or more, none lost.

A text is the set of the XXH64 (seed 42) of its shingles of WIDTH words. Texts of one set are one
node, named by the hash of the set. All sets are put in one order of shingles; of two sets of that
index, the first fifth of the longer one and the first ninth of the shorter one share a shingle
(prefix filter), so a join by these shingles finds every pair. A pair must also fit by its sizes,
and is verified on the whole sets.

The order is that of the hashes, with shingles that a sample of the texts shows to be frequent at
the end. The sample changes how many pairs are verified, never which are found.

Texts amid many others (variants of one text) would all be paired with each other. A sample gives the
SimHash fingerprints that such crowds have in their middle, the pivots; a text that begins with
frequent shingles goes to its nearest pivot, and the texts of one pivot are compared in places of
their own, by exact signatures first, which give only links that span their components. Pairs of
different pivots or none meet by the prefix join. Pivots change which pairs are looked at where,
never which components are found.

SimHash fingerprints of the sets come first: equal and close ones (`simhash.close_pairs`, by pivot
distance tables) are verified, and pairs of the prefix join that these links connect are dropped.
At the bound fingerprints differ in about 10 bits of 64, up to 18, which no table of distances tells
from chance; the prefix join finds what fingerprints can't.

Candidate pairs of either kind are judged by exact signatures, and the texts of what is left
travel packed.

Edge cases: a null text counts as empty; texts without words are copies of each other; one to four
words are one shingle; a crowd of m texts costs m squared comparisons of signatures (some 16 words
each), but no more than a spanning tree in each place leaves it; a crowd that the sample misses
(under about SAMPLE * CROWD texts) is paired by the prefix join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import arrow_map, cut, hot_join, texts
from textquern.llm.graph import components

WIDTH = 5
#: The least Jaccard index of a link, as a fraction.
NUM, DEN = 4, 5
#: One text in SAMPLE is looked at for frequent shingles; COMMON texts there make one, and MOST are moved at most; it shows BEGIN times the shingles that others show.
SAMPLE, COMMON, MOST, BEGIN = 8, 4, 100_000, 1.25
#: At most PIVOTS fingerprints that have CROWD texts of the sample within RADIUS bits; texts within AROUND bits are compared in one place, CHUNK shingles with as many others.
PIVOTS, CROWD, RADIUS, AROUND, CHUNK = 256, 8, 20, 26, 2_000_000
#: Bits of the signatures that candidate pairs are judged by before their texts are sent.
BITS = 2048
_BLOCK = 1 << 16
#: Texts that are looked at and whose shingles are sent at once, and pairs that are held before they go on.
TEXTS, PAIRS = 500, 100_000
#: Pairs that are looked at together, and names of crowded texts that a task remembers as sent.
STEP, SENT = 1 << 16, 100_000
#: Most nodes that are broadcast to pick the texts that candidate pairs name (counted first).
SMALL = 2_000_000


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-width]]
    spans = map(joined.__getitem__, map(slice, starts, (e - 1 for e in ends[width - 1 :])))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(42)), np.uint64, len(starts)))


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is set by more than half of them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), _BLOCK):
        counts += np.unpackbits(found[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def _prefix(n: int) -> int:
    """How many shingles of n the longer of two linked sets shows."""
    return n - -(-NUM * n // DEN) + 1


def text_names(text: Column) -> tuple[Column, Column]:
    """h1 and h2, which tell whole texts apart."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def _parts(batches):
    """Batches of at most TEXTS rows: a worker holds few texts and sets at once."""
    for b in batches:
        yield from (b.slice(at, TEXTS) for at in range(0, b.num_rows, TEXTS))


def names(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, node, fp) of every row: hashes of the text, the name of its set of shingles and the set's fingerprint."""

    def run(batches):
        for b in _parts(batches):
            sets = [shingles(t) for t in texts(b)]
            prints = np.array([fingerprint(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array([_name(x) for x in sets], pa.int64()), pa.array(prints)], ["doc_id", "h1", "h2", "node", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_names(F.coalesce("text", F.lit(""))), "text")
    return arrow_map(rows, run, "doc_id long, h1 long, h2 long, node long, fp long")


def _begins(batches, late: np.ndarray, centres: np.ndarray, longer: float = 1.0):
    """(token, node, size, pivot, crowd), some texts at a time: the first shingles of every set, those of `late` (sorted) behind the others.

    size is twice the number of shingles, plus one where the shingle is also among those that the shorter set of a pair shows.
    pivot is the nearest of `centres` to the fingerprint of a text that begins with frequent shingles, a quarter at least; -1 if none is within AROUND;
    crowd has (pivot, node, set) of texts that have one.
    """
    for batch in _parts(batches):
        tokens, nodes, sizes, near, crowd = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int16)], []
        for t in texts(batch):
            found = whole = shingles(t)
            n = len(found)
            if not n:
                continue
            name, shown, pivot = _name(found), int(_prefix(n) * longer), -1
            if len(late):
                behind = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
                found = np.concatenate([found[~behind], found[behind]])
                begin = behind[: int(shown * BEGIN)]
                if len(centres) and 4 * np.count_nonzero(begin) >= len(begin):
                    far = np.bitwise_count(centres ^ np.uint64(fingerprint(whole)))
                    if far.min() <= AROUND:
                        pivot = int(far.argmin())
                        crowd.append((pivot, name, whole))
            tokens.append(found[:shown])
            k = len(tokens[-1])
            nodes.append(np.full(k, name))
            sizes.append((2 * n + (np.arange(k) < n - -(-2 * NUM * n // (NUM + DEN)) + 1)).astype(np.uint32))
            near.append(np.full(k, pivot, np.int16))
        yield np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes), np.concatenate(near), crowd


def _sample(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many different texts of a sample begin with."""

    def run(batches):
        for token, node, *_ in _begins(batches, np.zeros(0, np.uint64), np.zeros(0, np.uint64), BEGIN):
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node)], ["token", "node"])

    some = arrow_map(_sample(docs), run, "token long, node long").distinct()
    rows = some.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= COMMON).orderBy(F.desc("k"), "token").limit(MOST).collect()
    return np.sort(np.array([r.token for r in rows], np.int64).view(np.uint64))


def _centres(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The pivots, most crowded first, and the number of shingles around each, of fingerprints (and sizes) of a sample."""
    found = []
    for _ in range(4 * PIVOTS):
        if len(prints) < CROWD:
            break
        near = np.bitwise_count(prints ^ prints[0]) <= RADIUS
        if np.count_nonzero(near) >= CROWD:
            bits = np.unpackbits(prints[near].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0) > 0.5
            centre = np.packbits(bits).view(">u8").astype(np.uint64)[0]
            near |= np.bitwise_count(prints ^ centre) <= RADIUS
            found.append((np.count_nonzero(near), int(sizes[near].sum()), centre))
        prints, sizes = prints[~near], sizes[~near]
    found = sorted(found, key=lambda x: -x[0])[:PIVOTS]
    return np.array([c for _, _, c in found], np.uint64), [n for _, n, _ in found]


def pivots(docs: DataFrame, late: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Fingerprints amid many different texts of the sample, and into how many chunks the texts around each go."""

    def run(batches):
        for b in _parts(batches):
            rows = []
            for found in map(shingles, texts(b)):
                begin = found[: int(_prefix(len(found)) * BEGIN)]
                if len(begin) and 2 * np.count_nonzero(np.isin(begin, late, assume_unique=True)) >= len(begin):
                    rows.append((_name(found), int(np.uint64(fingerprint(found)).view(np.int64)), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "fp", "n"])

    if not len(late):
        return np.zeros(0, np.uint64), []
    rows = arrow_map(_sample(docs), run, "node long, fp long, n long").distinct().orderBy(F.xxhash64("node")).limit(MOST).collect()
    centres, around = _centres(np.array([r.fp for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64))
    return centres, [-(-SAMPLE * n // CHUNK) for n in around]


def _ranges(start: np.ndarray, end: np.ndarray):
    """(i, j) arrays: each i with all j from start[i] to before end[i], about STEP pairs at once."""
    counts = np.maximum(end - start, 0)
    rows = np.flatnonzero(counts)
    total = np.cumsum(counts[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        here, n = rows[at:to], counts[rows[at:to]]
        first = np.cumsum(n) - n
        yield np.repeat(here, n), np.arange(n.sum()) - np.repeat(first - start[here], n)
        at = to


def _meet(token: np.ndarray, node: np.ndarray, size: np.ndarray, pivot: np.ndarray):
    """(a, b) arrays of nodes that share a token and may be linked; not of those around one pivot, which `_linked` compares."""
    order = np.lexsort((~size, node, ((pivot.astype(np.int64) + 1) << 33) + (size >> 1), token))
    token, node, size, pivot = token[order], node[order], size[order], pivot[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # one row for all copies of a text
    token, node, size, pivot = token[new], node[new], size[new], pivot[new]
    n, places = (size >> 1).astype(np.int64), np.arange(len(token))
    begins = np.ones(len(token), bool)
    begins[1:] = token[1:] != token[:-1]
    run = begins.copy()
    run[1:] |= pivot[1:] != pivot[:-1]
    ends = np.append(np.flatnonzero(begins), len(token))[np.cumsum(begins)]
    run_ends = np.append(np.flatnonzero(run), len(token))[np.cumsum(run)]
    # around no pivot sizes rise, so what is too long stays so
    key = (np.cumsum(run) << 33) + n
    fitting = np.searchsorted(key, (np.cumsum(run) << 33) + DEN * n // NUM, "right")
    alone = _ranges(places + 1, np.where(pivot < 0, fitting, 0))
    for i, j in chain(alone, _ranges(run_ends, ends)):
        short, long = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
        fits = (DEN * n[short] >= NUM * n[long]) & (size[short] & 1 > 0)
        yield node[i[fits]], node[j[fits]]


def _is_link(v: np.ndarray, u: np.ndarray) -> bool:
    """Whether two different sets are linked."""
    if not len(u) or not len(v):
        return False
    common = np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u)
    return bool((NUM + DEN) * common >= NUM * (len(u) + len(v)))


def _sign(found: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the shingles in each of `bits` places: two sets differ in as many shingles at least as their signatures in bits."""
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def _may_link(signs: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of these signatures and sizes may be linked, and the bits that differ."""
    far = np.bitwise_count(signs ^ others).sum(axis=1, dtype=np.int64)
    return (NUM + DEN) * far <= (DEN - NUM) * (n + m), far


def _linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of the sets, all compared with each other, first by signatures."""
    n = np.array([len(s) for s in sets], np.int64)
    bits = min(max(1 << int(2 * np.median(n)).bit_length(), 1 << 10), 1 << 14)
    signs = np.stack([_sign(x, bits) for x in sets])
    some = signs[:: max(1, len(sets) // 32)]
    middle = int(np.argmin(sum(np.bitwise_count(signs ^ s).sum(axis=1, dtype=np.int64) for s in some)))
    order = np.argsort(np.bitwise_count(signs ^ signs[middle]).sum(axis=1, dtype=np.int64), kind="stable")  # from the middle outwards
    n, signs = n[order], signs[order]
    root, found = np.arange(len(sets)), []
    for i in range(len(sets)):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = j[(DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))]
        fits, far = _may_link(signs[j], signs[i], n[j], n[i])
        j = j[fits][np.argsort(far[fits], kind="stable")]
        for k in j:
            if root[k] != root[i] and _is_link(sets[order[i]], sets[order[k]]):
                found.append((int(order[i]), int(order[k])))
                root[root == root[k]] = root[i]
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """(a, b, sure): nodes that may be linked, all that are among them, as far as sure links don't reach from one to the other.

    Shingles go to places by their hash as packed bytes (four of the hash, which may only add candidates, eight of the node, four of the size, two of the pivot).
    Whole sets of the texts around a pivot go to the places of that pivot, one for every two chunks.
    """
    late, places = frequent(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centres, chunks = pivots(docs, late)
    rooms = {x: places + k for k, x in enumerate((p, c, d) for p, g in enumerate(chunks) for c in range(g) for d in range(c + (g > 1), g))}
    kinds = (np.uint32, np.int64, np.uint32, np.int16)
    columns = ["place", "token", "node", "size", "pivot"]

    def send(batches):
        gone = set()
        for token, node, size, pivot, crowd in _begins(batches, late, centres):
            place = (token % np.uint64(places)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(places + 1))
            token = (token // np.uint64(places)).astype(np.uint32)[order]
            parts = [x for x in range(places) if bounds[x] < bounds[x + 1]]
            packed = [[c[bounds[x] : bounds[x + 1]].tobytes() for x in parts] for c in (token, node[order], size[order], pivot[order])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], columns)
            for p, name, found in crowd:
                if name in gone:
                    continue
                if len(gone) >= SENT:
                    gone.clear()
                gone.add(name)
                g, c = chunks[p], name % chunks[p]
                to = [rooms[p, min(c, d), max(c, d)] for d in range(g) if d != c or g == 1]
                whole = [pa.array([x] * len(to), pa.binary()) for x in (found.tobytes(), np.int64(name).tobytes(), b"", b"")]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *whole], columns)

    def pairs(rows):
        held, count = [], 0
        for a, b in _meet(*(np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*rows), kinds))):
            held.append(np.stack([a, b]))
            count += len(a)
            if count > PAIRS:
                yield np.unique(np.concatenate(held, axis=1), axis=1)
                held, count = [], 0
        if held:
            yield np.unique(np.concatenate(held, axis=1), axis=1)

    def around(sets):
        nodes = np.frombuffer(b"".join(sets), np.int64)
        ends = _linked([np.frombuffer(x, np.uint64) for x in sets.values()])
        yield nodes[np.array(ends, np.int64).reshape(-1, 2).T]

    def meet(batches):
        here, rows, sets = None, [], {}
        for batch in chain(batches, [None]):
            for place, *row in zip(*(batch.column(c).to_pylist() for c in columns)) if batch else [(None, None)]:
                if place != here and here is not None:
                    for a, b in around(sets) if sets else pairs(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b)] + [pa.array(np.full(len(a), bool(sets)))], ["a", "b", "sure"])
                    rows, sets = [], {}
                here = place
                if here is not None and here >= places:
                    sets[row[1]] = row[0]  # one for all copies of a text
                else:
                    rows.append(row)

    sent = arrow_map(docs.select("text"), send, "place long, token binary, node binary, size binary, pivot binary")
    return arrow_map(sent.repartition("place").sortWithinPartitions("place"), meet, "a long, b long, sure boolean").distinct()


def close_nodes(nodes: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): each node (node, fp) with the first one of its fingerprint, and the first ones of the pairs of fingerprints that `close` finds."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("_n")))
    same = hot_join(nodes.select("node", "fp"), heads, ["fp"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = close(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b")
    return same.union(pairs.select("ha", "hb"))


def links(docs: DataFrame, nodes: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): pairs of different sets that are linked, all but some that others connect.

    Close fingerprints come first; what they and the crowds connect needs no look at further pairs.
    """
    near, found = cut(close_nodes(nodes, close)), cut(candidates(docs))
    pairs, sure = found.where("not sure").select("a", "b"), found.where("sure").select("a", "b")
    named = pairs.union(near)
    wanted = named.select(F.col("a").alias("node")).union(named.select("b")).distinct()

    def pack(batches):
        for b in _parts(batches):
            every = texts(b)
            sets = [shingles(t) for t in every]
            packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in every]
            signs = pa.array([_sign(x, BITS).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), pa.array(packed, pa.binary()), signs, pa.array([len(x) for x in sets], pa.int64())], ["node", "packed", "sign", "n"])

    def judge(batches):
        for batch in batches:
            signs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("sa", "sb")]
            fits, _ = _may_link(*signs, *(batch.column(c).to_numpy() for c in ("na", "nb")))
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    def unpack(packed):
        return shingles(zlib.decompress(packed).decode("utf-8", "surrogatepass"))

    def verify(batches):
        last, u = None, None
        for batch in _parts(batches):
            keep = []
            for fa, fb in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist()):
                if fb != last:  # rows come by b
                    last, u = fb, unpack(fb)
                keep.append(_is_link(unpack(fa), u))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = cut(wanted)
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    whole = cut(arrow_map(docs.select("text"), pack, "node long, packed binary, sign binary, n long").join(few, "node", "left_semi").dropDuplicates(["node"]))

    def linked(some):
        signed = some.join(whole.select(F.col("node").alias("a"), F.col("sign").alias("sa"), F.col("n").alias("na")), "a").join(whole.select(F.col("node").alias("b"), F.col("sign").alias("sb"), F.col("n").alias("nb")), "b")
        fit = cut(arrow_map(signed.select("a", "b", "sa", "sb", "na", "nb"), judge, "a long, b long"))
        both = fit.join(whole.select(F.col("node").alias("a"), F.col("packed").alias("fa")), "a").join(whole.select(F.col("node").alias("b"), F.col("packed").alias("fb")), "b")
        return arrow_map(both.select("a", "b", "fa", "fb"), verify, "a long, b long")

    first = cut(linked(near).union(sure))
    roots = components(first)
    ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return first.union(linked(ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")))


def near_copies(docs: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, h1, h2, root, component_id) of every row; a component is named by its smallest doc_id.

    `close` finds the pairs (a, b) of close fingerprints among distinct ones (fp).
    """
    named = cut(names(docs))
    nodes = cut(named.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("fp").alias("fp")))
    roots = components(links(docs, nodes, close))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    of_node = cut(hot_join(rooted, least, ["root"]).select("node", "root", "component_id", F.col("copies").alias("_n")))
    return hot_join(named, of_node, ["node"]).select("doc_id", "h1", "h2", "root", "component_id")
