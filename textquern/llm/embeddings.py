"""Embedding near-dedup by cross-polytope hashing.

Equal vectors are one class, known by two 64-bit hashes. A class's unit vector is padded to a power of
two and turned, for each of several tables and some places in each, by three fast Hadamard transforms
with random signs between them; the cross-polytope hash is the axis, with its sign, that lies closest.
A table's code joins the hashes of its places; there are as many places as keep chance meetings to LOAD
classes a bucket (two for up to millions of vectors), and more tables with more places. Multiprobe: a
vector goes to the bucket of its closest axes and to those where one of the least sure places takes its
next best axis; classes that share a bucket are candidates.

A sketch, BITS signs of the turned vector, goes along to the buckets in place of the vector. A class
stays in a bucket only if another's sketch there differs in few enough bits (SIGMAS deviations beyond
what the threshold's angle makes likely); buckets that a sample shows to be crowded skip this. Only
classes that stay have their vectors sent, and each candidate pair is verified by its cosine in double
precision. So no pair below the threshold is linked; recall against brute force is measured in the
tests on vectors that have such pairs.

A pair can meet in many buckets and counts in the least one that both have, which either side can
work out, so pairs are never sent anywhere: buckets yield a sum for each class and a tree of links.
A bucket of more than BLOCK classes is cut into blocks, and each pair of blocks goes to a task of its
own; no task holds more than two blocks of a bucket at once, and no member is dropped.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components are linked with
nothing; vectors of different lengths never meet; repeated rows and copies count as links of each
other; rows without a vec_id count as partners and have a null component unless a linked row has an
id; rows that share a vec_id but not a vector are
vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import arrow_map, cut, hot_join
from textquern.llm.graph import components

THRESHOLD = 0.9
#: Most chance meetings in a bucket, probes of a table with two places (one more for each further place), classes in a block.
LOAD, PROBES, BLOCK = 64, 3, 1024
#: Bits of a sketch, deviations that it may lie beyond its expectation, and the least width of vectors that it can judge.
BITS, SIGMAS, NARROW = 96, 4.5, 32
#: Most classes whose ids are broadcast to fetch their vectors (counted first).
SMALL = 1_000_000


def plan(n: int, width: int) -> tuple[int, int]:
    """(places, tables) for n vectors of a padded width: (2 width) ** places buckets of a table for n * PROBES entries."""
    places = 2
    while n * PROBES > LOAD * (2 * width) ** places:
        places += 1
    return places, 6 << (places - 2)


@lru_cache(maxsize=16)
def _signs(width: int, places: int, tables: int, seed: int = 7) -> np.ndarray:
    """Random signs: (tables, places, 3 rounds, width)."""
    return np.random.default_rng([seed, width]).integers(0, 2, (tables, places, 3, width)) * 2.0 - 1.0


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the last axis."""
    shape, h = x.shape, 1
    while h < shape[-1]:
        y = x.reshape(*shape[:-1], shape[-1] // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(shape)
        h *= 2
    return x / np.sqrt(shape[-1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(unit: np.ndarray, places: int = 2, tables: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: their buckets (n, tables, probes), least first in each table, and sketches (n, BITS / 8) as bytes."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = unit
    probes = PROBES + places - 2
    out, rows, bits = np.empty((n, tables, probes), np.int64), np.arange(n), []
    for t in range(tables):
        axes, gaps = np.empty((n, places, 2), np.uint64), np.empty((n, places))
        for p in range(places):
            y = x
            for signs in _signs(width, places, tables)[t, p]:
                y = _hadamard(y * signs)
            if sum(b.shape[1] for b in bits) < BITS:
                bits.append(y > 0)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2] if width > 2 else np.argsort(-np.abs(y), axis=1)[:, :2]
            size = np.abs(np.take_along_axis(y, top, axis=1))
            swap = size[:, 0] < size[:, 1]
            top[swap] = top[swap][:, ::-1]
            size = np.sort(size, axis=1)[:, ::-1]
            axes[:, p] = 2 * top + (np.take_along_axis(y, top, axis=1) < 0)
            gaps[:, p] = size[:, 0] - size[:, 1]
        least_sure = np.argsort(gaps, axis=1, kind="stable")
        for k in range(probes):
            pick = np.zeros((n, places), int)
            if k:
                pick[rows, least_sure[:, k - 1]] = 1
            key = np.full(n, (dim << 16) + t, np.uint64)
            for p in range(places):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + axes[rows, p, pick[:, p]] + np.uint64(1))
            out[:, t, k] = (key >> np.uint64(1)).view(np.int64)
    out.sort(axis=2)
    sketch = np.packbits(np.concatenate(bits, axis=1)[:, :BITS], axis=1)
    return out, np.pad(sketch, ((0, 0), (0, BITS // 8 - sketch.shape[1])))


def reach(dim: int, threshold: float) -> int:
    """Most bits that the sketches of a pair at the threshold differ in."""
    if dim < NARROW:
        return BITS
    share = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(BITS * share + SIGMAS * math.sqrt(BITS * share * (1 - share)))


_BROKEN = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
_USABLE = f"embedding is not null and size(embedding) > 0 and not {_BROKEN} and exists(embedding, x -> x <> 0)"


def _names(rows: DataFrame) -> DataFrame:
    """The rows with h1 and h2, which tell vectors apart."""
    return rows.select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def classes(vectors: DataFrame) -> DataFrame:
    """(embedding, least, n): the distinct usable vectors with their least vec_id and count."""
    return vectors.where(_USABLE).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))


def _bucket(key: int, block_a: np.ndarray, block_b: np.ndarray | None, cids, n, unit, code, threshold, sums, trees) -> None:
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    step = 512
    whole = block_a if block_b is None else block_b
    for s in range(0, len(block_a), step):
        left = block_a[s : s + step]
        sims = unit[left] @ unit[whole].T
        i, j = np.nonzero(sims >= threshold)
        i, j = left[i], whole[j]
        keep = (i < j) if block_b is None else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 20_000):
            a, b = i[c : c + 20_000], j[c : c + 20_000]
            # the least bucket that both have: codes are sorted by table, and inside it
            x, y = code[a], code[b]
            common = np.where((x[:, :, :, None] == y[:, :, None, :]).any(axis=3), x, np.iinfo(np.int64).max).reshape(len(a), -1).min(axis=1)
            mine = common == key
            np.add.at(sums, a[mine], n[b[mine]])
            np.add.at(sums, b[mine], n[a[mine]])
            for u, v in zip(a[mine].tolist(), b[mine].tolist()):
                ru, rv = root(u), root(v)
                if ru != rv:
                    parent[ru] = rv
                    trees.append((cids[u], cids[v]))


def _by_width(embeddings: pa.Array, most: int = 2000):
    """(row numbers, unit vectors) of a batch, vectors of one width at a time."""
    sizes = np.asarray(pc.list_value_length(embeddings))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for s in range(0, len(rows), most):
            part = rows[s : s + most]
            x = np.asarray(embeddings.take(pa.array(part)).flatten()).astype(float).reshape(len(part), size)
            yield part, x / np.linalg.norm(x, axis=1, keepdims=True)


def _close(keys: np.ndarray, sketches: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which entries, in the order of their buckets' keys, have a close one in their bucket; all of crowded buckets."""
    live = np.zeros(len(keys), bool)
    words = sketches.view(np.uint32)
    i, shift = np.arange(len(keys)), 1
    while len(i) and shift <= BLOCK:
        i = i[i + shift < len(keys)]
        i = i[keys[i] == keys[i + shift]]
        apart = np.bitwise_count(words[i] ^ words[i + shift]).sum(axis=1)
        near = apart <= limits[i]
        live[i[near]] = live[i[near] + shift] = True
        shift += 1
    if len(i):  # more than BLOCK of one key
        live |= np.isin(keys, np.unique(keys[i]))
    return live


def live_entries(distinct: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cid, key): the buckets in which a class may have a link."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entries(embeddings, cids):
        for part, unit in _by_width(embeddings):
            places, tables = plan(n, 1 << max(1, (unit.shape[1] - 1).bit_length()))
            code, sketch = codes(unit, places, tables)
            flat = code.reshape(len(part), -1)
            yield np.repeat(cids[part], flat.shape[1]), flat.ravel(), np.repeat(sketch, flat.shape[1], axis=0), reach(unit.shape[1], threshold)

    def keys_only(batches):
        for b in batches:
            for cid, key, _, _ in entries(b.column("embedding"), np.asarray(b.column("cid"))):
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    # keys with over a thousandth of a sample's entries, at most 1000 of them: their entries stay, unseen by sketches
    seen = cut(arrow_map(distinct.where("pmod(xxhash64(cid), 64) = 0"), keys_only, "key long").groupBy("key").agg(F.count("*").alias("n")))
    crowd = np.sort(np.array([r.key for r in seen.join(F.broadcast(seen.agg(F.sum("n").alias("all")))).where("n >= 32 and n > all / 1000").select("key").collect()], np.int64))

    def send(batches):
        for b in batches:
            for cid, key, sketch, limit in entries(b.column("embedding"), np.asarray(b.column("cid"))):
                hot = np.isin(key, crowd)
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([cid[hot].tobytes()], pa.binary()), pa.array([key[hot].tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([limit])], ["part", "cid", "key", "sketch", "reach"])
                    cid, key, sketch = cid[~hot], key[~hot], sketch[~hot]
                place = key % parts
                order = np.argsort(place, kind="stable")
                cid, key, sketch, place = cid[order], key[order], sketch[order], place[order]
                bounds = np.searchsorted(place, np.arange(parts + 1))
                some = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
                packed = [pa.array([c[bounds[p] : bounds[p + 1]].tobytes() for p in some], pa.binary()) for c in (cid, key, sketch)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *packed, pa.array([limit] * len(some), pa.int64())], ["part", "cid", "key", "sketch", "reach"])

    def meet(batches):
        held = [x for b in batches for x in b.to_pylist()]
        by_part: dict[int, list] = {}
        for x in held:
            by_part.setdefault(x["part"], []).append(x)
        for rows in by_part.values():
            cid, key = (np.frombuffer(b"".join(x[c] for x in rows), np.int64) for c in ("cid", "key"))
            sketch = np.frombuffer(b"".join(x["sketch"] for x in rows), np.uint8).reshape(len(cid), -1)
            limit = np.repeat([x["reach"] for x in rows], [len(x["cid"]) // 8 for x in rows])
            order = np.argsort(key, kind="stable")
            cid, key = cid[order], key[order]
            live = _close(key, np.ascontiguousarray(sketch[order]), limit[order])
            yield pa.RecordBatch.from_arrays([pa.array(cid[live]), pa.array(key[live])], ["cid", "key"])

    def unpack(batches):
        for b in batches:
            for c, k in zip(b.column("cid").to_pylist(), b.column("key").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(k, np.int64))], ["cid", "key"])

    schema = "part long, cid binary, key binary, sketch binary, reach long"
    sent = arrow_map(distinct.select("cid", "embedding"), send, schema)
    if not len(crowd):
        return cut(arrow_map(sent.repartitionById(parts, F.col("part").cast("int")), meet, "cid long, key long"))
    return cut(arrow_map(sent.where("part >= 0").repartitionById(parts, F.col("part").cast("int")), meet, "cid long, key long").union(arrow_map(sent.where("part < 0"), unpack, "cid long, key long")))


def link_counts(distinct: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((cid, links), (a, b)) of classes (cid, n, embedding): linked rows of other classes by class, and links that span the components."""
    total = distinct.count()
    shape = lambda dim: plan(total, 1 << max(1, (dim - 1).bit_length()))
    places = live_entries(distinct, total, threshold)
    sizes = places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = places.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = shared.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("cid", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = cut(shared.select("cid").distinct())
    vectors = distinct.select("cid", "n", "embedding").join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "cid", "left_semi")
    rows = tasks.join(vectors, "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "cid")

    def flush(part: list[pa.RecordBatch], threshold: float):
        t = pa.Table.from_batches(part)
        key, i, j, block = (t.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        cids, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        embeddings = t.column("embedding").combine_chunks()
        flat = np.asarray(embeddings.flatten()).astype(float)
        width = np.asarray(pc.list_value_length(embeddings))
        ends = np.cumsum(width)
        code_of, place = {}, np.zeros(len(key), np.int64)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            code_of[w] = np.concatenate([codes(unit, *shape(int(w)))[0] for _, unit in _by_width(embeddings.take(pa.array(own)))])
        edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        sums, trees = np.zeros(len(key), np.int64), []
        for a, b in zip([0, *edges], [*edges, len(key)]):
            if b - a < 2 or width[a:b].min() != width[a:b].max():  # keys of widths differ, but for collisions
                continue
            x = flat[ends[a] - width[a] : ends[b - 1]].reshape(b - a, width[a])
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            code = code_of[width[a]][place[a:b]]
            own = np.zeros(b - a, np.int64)
            if i[a] == j[a]:
                _bucket(key[a], np.arange(b - a), None, cids[a:b], n[a:b], unit, code, threshold, own, trees)
            else:
                first = np.flatnonzero(block[a:b] == i[a])
                second = np.flatnonzero(block[a:b] != i[a])
                if len(first) and len(second):
                    _bucket(key[a], first, second, cids[a:b], n[a:b], unit, code, threshold, own, trees)
            sums[a:b] = own
        some = sums > 0
        yield pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.array(sums[some]), pa.nulls(int(some.sum()), pa.int64())], ["a", "links", "b"])
        if trees:
            u, v = zip(*trees)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(u)), pa.nulls(len(u), pa.int64()), pa.array(np.array(v))], ["a", "links", "b"])

    def verify(batches):
        waiting: list[pa.RecordBatch] = []
        for b in batches:  # a bucket's task is whole before it is worked on: what follows the last change of key waits
            if not b.num_rows:
                continue
            k = [np.asarray(b.column(c)) for c in ("key", "i", "j")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            fresh = bool(waiting) and any(waiting[-1].column(c)[-1].as_py() != x[0] for c, x in zip(("key", "i", "j"), k))
            if fresh:
                yield from flush(waiting, threshold)
                waiting = []
            if len(change):
                yield from flush([*waiting, b.slice(0, int(change[-1]))], threshold)
                waiting = [b.slice(int(change[-1]))]
            else:
                waiting.append(b)
        if waiting:
            yield from flush(waiting, threshold)

    found = cut(arrow_map(rows.select("key", "i", "j", "block", "cid", "n", "embedding"), verify, "a long, links long, b long"))
    sums = found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    return sums, found.where("b is not null").select("a", "b").distinct()


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # numbers are given over a checkpoint, so a task that is run again gives the same; vec_ids needn't be unique
    distinct = cut(classes(rows)).withColumn("cid", F.monotonically_increasing_id())
    sums, links = link_counts(distinct, threshold)
    roots = components(links)
    named = _names(distinct).select("cid", "h1", "h2", "least", "n").join(sums, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "h1", "h2", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = cut(hot_join(named, least, ["root"]).select("h1", "h2", "n_links", "component_id", F.col("n").alias("_n")))
    usable = hot_join(_names(rows.where(_USABLE)).select("vec_id", "h1", "h2"), named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(f"not coalesce({_USABLE}, false)")
    every = usable.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
