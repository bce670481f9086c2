"""Sparse vectors in long form (vec_id, feature, value): lengths, sums and all-pairs similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lengths(vectors: DataFrame) -> DataFrame:
    """(vec_id, length)."""
    return vectors.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): maps, for the scalar functions."""
    return vectors.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("vector"))


def add(*parts: DataFrame) -> DataFrame:
    """Sums of vectors by vec_id and feature."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("vec_id", "feature").agg(F.sum("value").alias("value"))


def similarity_pairs(vectors: DataFrame, kind: str = "cosine") -> DataFrame:
    """(src, dst, similarity), src < dst, for all pairs that share a feature, through the inverted index.

    Pairs without a common feature have similarity 0 and aren't listed; `histogram` counts them.
    """
    left, right = (vectors.select("feature", F.col("vec_id").alias(i), F.col("value").alias(v)) for i, v in (("src", "x"), ("dst", "y")))
    shared = left.join(right, "feature").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count("*").alias("common"))
    if kind == "cosine":
        size, value = lengths(vectors), F.try_divide("dot", F.col("a") * F.col("b"))
    elif kind == "jaccard":
        size, value = vectors.groupBy("vec_id").agg(F.count("*").alias("length")), F.try_divide("common", F.col("a") + F.col("b") - F.col("common"))
    else:
        raise ValueError(f"unknown similarity {kind!r}")
    a, b = size.select(F.col("vec_id").alias("src"), F.col("length").alias("a")), size.select(F.col("vec_id").alias("dst"), F.col("length").alias("b"))
    return shared.join(a, "src").join(b, "dst").select("src", "dst", F.coalesce(value, F.lit(0.0)).alias("similarity"))


def histogram(pairs: DataFrame, vectors: DataFrame, buckets: int = 100) -> DataFrame:
    """(bucket, n_pairs, share, cumulative_share) of all n(n-1)/2 pairs; bucket 0 also has those that share nothing."""
    counted = pairs.groupBy(F.floor(F.round(F.col("similarity") * buckets, 6)).cast("long").alias("bucket")).agg(F.count("*").alias("n_pairs"))
    total = vectors.agg(F.count_distinct("vec_id").alias("n")).select(F.expr("n * (n - 1) div 2").alias("total"))
    rest = counted.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("listed")).join(F.broadcast(total)).select(F.lit(0).cast("long").alias("bucket"), (F.col("total") - F.col("listed")).alias("n_pairs"))
    rows = counted.union(rest).groupBy("bucket").agg(F.sum("n_pairs").alias("n_pairs")).join(F.broadcast(total))
    share = F.coalesce(F.try_divide("n_pairs", "total"), F.lit(0.0))
    running = F.sum("share").over(Window.orderBy("bucket"))  # one row for each of at most 101 buckets
    return rows.select("bucket", "n_pairs", share.alias("share")).withColumn("cumulative_share", running)


def subtract(vectors: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """Vectors without the features of `keys`; with `most`, only so many entries of each vector, in the order of their names."""
    rows = vectors.join(keys.select("feature").distinct(), "feature", "left_anti").select("vec_id", "feature", "value")
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("feature"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def similar_to(vectors: DataFrame, seed: int) -> DataFrame:
    """(vec_id, similarity) of all other vectors by cosine to one, the most similar first; those that share nothing have 0."""
    own = vectors.where(F.col("vec_id") == seed).select("feature", F.col("value").alias("x"))
    dots = vectors.where(F.col("vec_id") != seed).join(own, "feature").groupBy("vec_id").agg(F.sum(F.col("value") * F.col("x")).alias("dot"))
    size = own.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    rows = lengths(vectors.where(F.col("vec_id") != seed)).join(dots, "vec_id", "left").join(F.broadcast(size))
    return rows.select("vec_id", F.coalesce(F.try_divide("dot", F.col("length") * F.col("size")), F.lit(0.0)).alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), "vec_id")


def sorted_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, similarity) from the most similar pair on."""
    return pairs.orderBy(F.desc(F.round("similarity", 9)), "src", "dst")


def matrix_sums(cells: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, total), (column, total), and the largest cell (row, column, value; of equal ones the first by row and column) of a matrix in long form."""
    rows = cells.groupBy(F.col(row).alias("row")).agg(F.sum(value).alias("total"))
    columns = cells.groupBy(F.col(column).alias("column")).agg(F.sum(value).alias("total"))
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(row).alias("row"), F.col(column).alias("column"))).alias("m")
    return rows, columns, cells.agg(best).select("m.row", "m.column", (-F.col("m.v")).alias("value"))
