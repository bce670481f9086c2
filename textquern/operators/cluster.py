"""Clusters of sparse vectors and the label models made of them.

Vectors are (vec_id, feature, value), membership is (vec_id, cluster_id), centroids are
(cluster_id, feature, value). A centroid is the sum of its members, not their mean.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquern.operators.vectors import lengths, packed
from textquern.session import cut

#: Kinds of equal vectors that are broadcast.
KINDS = 1 << 16


def centroids(vectors: DataFrame, membership: DataFrame) -> DataFrame:
    return vectors.join(membership, "vec_id").groupBy("cluster_id", "feature").agg(F.sum("value").alias("value"))


def average_vector(centres: DataFrame) -> DataFrame:
    """(feature, value): the sum of all centroids."""
    return centres.groupBy("feature").agg(F.sum("value").alias("value"))


def similarities(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(vec_id, cluster_id, similarity) by cosine, for all that share a feature."""
    c = centres.select("cluster_id", "feature", F.col("value").alias("c"))
    dots = vectors.join(c, "feature").groupBy("vec_id", "cluster_id").agg(F.sum(F.col("value") * F.col("c")).alias("dot"))
    size = centres.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    return dots.join(lengths(vectors), "vec_id").join(size, "cluster_id").select("vec_id", "cluster_id", F.coalesce(F.try_divide("dot", F.col("length") * F.col("size")), F.lit(0.0)).alias("similarity"))


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(vec_id, cluster_id, similarity): the nearest centroid; of equal ones (to nine digits) the smallest cluster_id."""
    best = F.max_by(F.struct("cluster_id", "similarity"), F.struct(F.round("similarity", 9), -F.col("cluster_id"))).alias("b")
    return similarities(vectors, centres).groupBy("vec_id").agg(best).select("vec_id", "b.cluster_id", "b.similarity")


def nearest(vectors: DataFrame, centres: DataFrame, k: int = 5, most: bool = True) -> DataFrame:
    """(vec_id, rank, cluster_id, similarity): the k most (or least) similar clusters of each vector."""
    key = F.round("similarity", 9)
    order = Window.partitionBy("vec_id").orderBy(key.desc() if most else key.asc(), "cluster_id")
    return similarities(vectors, centres).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "cluster_id", "similarity")


def seeds(vectors: DataFrame, k: int) -> DataFrame:
    """k centroids: vectors in the order of a hash of their ids; the same on every run."""
    ids = vectors.select("vec_id").distinct().orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(k)
    numbered = ids.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")).cast("long"))  # k rows
    return vectors.join(F.broadcast(numbered), "vec_id").select("cluster_id", "feature", "value")


def alike(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, feature, value, n), (vec_id, like)): one of each set of equal vectors, the one of the smallest id, with their number, and whom each is like.

    What an assignment does with a vector depends on its entries alone, so equal ones are assigned once.
    Few kinds are broadcast, counted first; where most vectors differ each stands for itself.
    """
    entries = cut(vectors.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("v")))
    kinds = cut(entries.groupBy("v").agg(F.min("vec_id").alias("like"), F.count("*").alias("n")))
    if kinds.count() > KINDS:
        kinds = entries.select("v", F.col("vec_id").alias("like"), F.lit(1).cast("long").alias("n"))
        members = entries.select("vec_id", F.col("vec_id").alias("like"))
    else:
        members = cut(entries.join(F.broadcast(kinds.drop("n")), "v").select("vec_id", "like"))
    return kinds.select(F.col("like").alias("vec_id"), "n", F.explode("v").alias("e")).select("vec_id", "e.feature", "e.value", "n"), members


def _weighted_centroids(kinds: DataFrame, membership: DataFrame) -> DataFrame:
    """`centroids` of kinds (vec_id, feature, value, n), each n times."""
    return centroids(kinds.select("vec_id", "feature", (F.col("value") * F.col("n")).alias("value")), membership)


def kmeans(vectors: DataFrame, k: int, iterations: int = 20, smallest: int = 10, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, centroids) after at most `iterations` rounds, or when nothing moves.

    Clusters with fewer than `smallest` members are dropped in every round; `start` resumes from
    centroids that were saved. Rounds run over the kinds of vectors.
    """
    kinds, members = alike(vectors)
    number = kinds.select("vec_id", "n").distinct()
    centres, before, membership = start if start is not None else seeds(vectors, k), None, None
    for _ in range(iterations):
        found = cut(assign(kinds, centres).join(number, "vec_id"))
        large = found.groupBy("cluster_id").agg(F.sum("n").alias("n")).where(F.col("n") >= smallest)
        kept = found.join(large, "cluster_id", "left_semi").select("vec_id", "cluster_id")
        centres = cut(_weighted_centroids(kinds, kept))
        mark = kept.agg(F.count("*"), F.sum(F.xxhash64("vec_id", "cluster_id").cast("decimal(38,0)"))).first()
        membership = kept
        if mark == before:
            break
        before = mark
    if membership is not None:
        membership = members.join(membership.withColumnRenamed("vec_id", "like"), "like").select("vec_id", "cluster_id")
    return membership, centres


def _leader_pass(theta: float):
    """One ordered pass over packed vectors: the best leader above theta takes a vector, else it founds a cluster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sums: list[dict] = []
        index: dict[str, dict[int, float]] = {}
        squares: list[float] = []
        out = []
        for vec_id, vector in sorted(zip(rows["vec_id"], rows["vector"]), key=lambda r: r[0]):
            vector = dict(vector)
            dots: dict[int, float] = {}
            for f, x in vector.items():
                for c, y in index.get(f, {}).items():
                    dots[c] = dots.get(c, 0.0) + x * y
            own = sum(x * x for x in vector.values())
            best, at = theta, -1
            for c in sorted(dots):
                sim = dots[c] / (own * squares[c]) ** 0.5 if own and squares[c] else 0.0
                if sim > best:
                    best, at = sim, c
            if at < 0:
                at = len(sums)
                sums.append({})
                squares.append(0.0)
            for f, x in vector.items():
                y = sums[at].get(f, 0.0)
                sums[at][f] = index.setdefault(f, {})[at] = y + x
                squares[at] += x * x + 2 * x * y
            out.append((vec_id, at))
        return pd.DataFrame(out, columns=["vec_id", "cluster_id"])

    return run


def leader(vectors: DataFrame, theta: float = 0.5, rounds: int = 5, largest: float = 10.0, shards: int = 8) -> tuple[DataFrame, DataFrame]:
    """(membership, centroids) by threshold: join the best centroid above theta, else found a cluster.

    The order decides, so a first pass runs inside `shards` shards by a hash of vec_id, each in the
    order of vec_id. Later rounds assign all vectors to all centroids by a join, drop clusters of more
    than `largest` times the mean size, and let what fits nowhere found clusters in its shard, until
    nothing is dropped.
    """
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))

    def found(rows: DataFrame, offset: DataFrame | int) -> DataFrame:
        maps = packed(rows).withColumn("shard", shard)
        local = maps.groupBy("shard").applyInPandas(lambda key, p: _leader_pass(theta)(p).assign(shard=int(key[0])), "vec_id long, cluster_id long, shard long")
        return local.select("vec_id", (F.col("cluster_id") * shards + F.col("shard") + F.lit(offset)).alias("cluster_id"))

    kinds, members = alike(vectors)
    one = kinds.drop("n")
    number = kinds.select("vec_id", "n").distinct()

    def centres_of(membership: DataFrame) -> DataFrame:
        shares = membership.join(members, "vec_id").groupBy("like", "cluster_id").agg(F.count("*").alias("n"))
        rows = one.withColumnRenamed("vec_id", "like").join(shares, "like")
        return rows.groupBy("cluster_id", "feature").agg(F.sum(F.col("value") * F.col("n")).alias("value"))

    membership = cut(found(vectors, 0))
    centres = cut(centres_of(membership))
    top = (membership.agg(F.max("cluster_id")).first()[0] or 0) + 1
    for _ in range(rounds):
        placed = cut(assign(one, centres).where(F.col("similarity") > theta).join(number, "vec_id").select("vec_id", "cluster_id", "n"))
        sizes = placed.groupBy("cluster_id").agg(F.sum("n").alias("n"))
        mean = sizes.agg(F.avg("n").alias("mean"))
        large = sizes.join(F.broadcast(mean)).where(F.col("n") <= largest * F.col("mean"))
        kept = members.join(placed.join(large, "cluster_id", "left_semi").select(F.col("vec_id").alias("like"), "cluster_id"), "like").select("vec_id", "cluster_id")
        rest = vectors.join(kept, "vec_id", "left_anti")
        membership = cut(kept.unionByName(found(rest, top)))
        centres = cut(centres_of(membership))
        new_top = (membership.agg(F.max("cluster_id")).first()[0] or 0) + 1
        if new_top <= top:
            break
        top = new_top
    return membership, centres


def keep_threshold(n: int, k: int) -> int:
    """The number of members above which an adaptive cluster is too large."""
    return int(n * 10 / k)


def merge_similar(centres: DataFrame, theta: float) -> DataFrame:
    """(cluster_id, merged_id): clusters linked by a centroid similarity over theta take the smallest id around them."""
    as_vectors = centres.select(F.col("cluster_id").alias("vec_id"), "feature", "value")
    near = similarities(as_vectors, centres).where(F.col("similarity") > theta).select(F.col("vec_id").alias("a"), F.col("cluster_id").alias("b"))
    current = cut(centres.select("cluster_id").distinct().withColumn("merged_id", F.col("cluster_id")))
    while True:
        spread = near.join(current.select(F.col("cluster_id").alias("b"), "merged_id"), "b").groupBy("a").agg(F.min("merged_id").alias("m"))
        following = cut(current.join(spread.withColumnRenamed("a", "cluster_id"), "cluster_id", "left").select("cluster_id", F.least("merged_id", "m").alias("merged_id"), (F.coalesce("m", "merged_id") < F.col("merged_id")).alias("moved")))
        current = following.select("cluster_id", "merged_id")
        if following.where("moved").isEmpty():
            return current


def report(vectors: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: number of clusters, mean and sample deviation of sizes and of similarity to the average cluster."""
    centres = centroids(vectors, membership)
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("n"))
    whole = average_vector(centres).select(F.lit(0).cast("long").alias("cluster_id"), "feature", "value")
    near = similarities(centres.select(F.col("cluster_id").alias("vec_id"), "feature", "value"), whole).select(F.col("vec_id").alias("cluster_id"), "similarity")
    return sizes.join(near, "cluster_id").agg(
        F.count("*").alias("n_clusters"), F.avg("n").alias("mean_size"), F.stddev_samp("n").alias("sd_size"),
        F.avg("similarity").alias("mean_similarity"), F.stddev_samp("similarity").alias("sd_similarity"),
    )


def presence(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """(label, share): the share of clusters with a member that has the label."""
    total = membership.agg(F.count_distinct("cluster_id").alias("k"))
    rows = labels.join(membership.withColumnRenamed("vec_id", "doc_id"), "doc_id").groupBy("label").agg(F.count_distinct("cluster_id").alias("n"))
    return rows.join(F.broadcast(total)).select("label", (F.col("n") / F.col("k")).alias("share"))


def label_model(term_vectors: DataFrame, label_weights: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model_centroid (cluster_id, feature, value), model_labels (cluster_id, label, weight)): clusters of label sets in term space."""
    labels = label_weights.withColumnRenamed("doc_id", "vec_id").join(membership, "vec_id").groupBy("cluster_id", "label").agg(F.sum("weight").alias("weight"))
    return centroids(term_vectors, membership), labels


def candidates(near: DataFrame, model_labels: DataFrame) -> DataFrame:
    """(vec_id, label): the union of the labels of each vector's neighbour clusters."""
    return near.select("vec_id", "cluster_id").join(model_labels.select("cluster_id", "label"), "cluster_id").select("vec_id", "label").distinct()


def content_hash(rows: DataFrame) -> DataFrame:
    """(fingerprint): one row that depends on the rows alone, not on their order or files."""
    text = F.md5(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in sorted(rows.columns))))
    parts = [F.sum(F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(p, F.lit("")) for p in parts))).alias("fingerprint"))


def tree(centres: DataFrame, roots: int = 8) -> DataFrame:
    """(node, parent, depth): a binary tree over centroids, the most similar two joined greedily, level by level, until `roots` are left.

    Centroids are a model, so they fit one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        level = {int(c): dict(zip(g["feature"], g["value"])) for c, g in rows.groupby("cluster_id")}
        out, following, depth = [], max(level, default=0) + 1, 0

        def cosine(a, b):
            na, nb = (sum(x * x for x in v.values()) ** 0.5 for v in (a, b))
            return sum(x * b.get(f, 0.0) for f, x in a.items()) / (na * nb) if na and nb else 0.0

        while len(level) > roots:
            ids = sorted(level)
            ranked = sorted(((-cosine(level[a], level[b]), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]))
            left, above = set(ids), {}
            for _, a, b in ranked:
                if a in left and b in left:
                    left -= {a, b}
                    joined = dict(level[a])
                    for f, x in level[b].items():
                        joined[f] = joined.get(f, 0.0) + x
                    above[following] = joined
                    out += [(a, following, depth), (b, following, depth)]
                    following += 1
            for a in sorted(left):
                above[following] = level[a]
                out.append((a, following, depth))
                following += 1
            level, depth = above, depth + 1
        out += [(n, None, depth) for n in sorted(level)]
        return pd.DataFrame({"node": [o[0] for o in out], "parent": pd.array([o[1] for o in out], "Int64"), "depth": [o[2] for o in out]})

    return centres.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "node long, parent long, depth long")
