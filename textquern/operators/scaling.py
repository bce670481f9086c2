"""Scalers learned from long-form features (id, feature, value); absent features count as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax_model(rows: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(feature, low, high); with `n_rows`, features that some rows lack also have the value 0."""
    low, high = F.min("value"), F.max("value")
    if n_rows is not None:
        some = F.count("*") < n_rows
        low, high = F.when(some, F.least(low, F.lit(0.0))).otherwise(low), F.when(some, F.greatest(high, F.lit(0.0))).otherwise(high)
    return rows.groupBy("feature").agg(low.alias("low"), high.alias("high"))


def minmax(rows: DataFrame, model: DataFrame, lower: float = -1.0, upper: float = 1.0) -> DataFrame:
    """Values mapped to [lower, upper]; a feature of one value goes to the middle."""
    part = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    return rows.join(model, "feature").select("id", "feature", (lower + part * (upper - lower)).alias("value"))


def zscore_model(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def zscore(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Values less the mean, over the deviation; 0 where there is none."""
    return rows.join(model, "feature").select("id", "feature", F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.col("sd")), F.lit(0.0)).alias("value"))


def unit_length(rows: DataFrame) -> DataFrame:
    """Rows with an L2 norm of 1."""
    size = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    return rows.join(size, "id").select("id", "feature", F.coalesce(F.try_divide("value", "size"), F.lit(0.0)).alias("value"))


def none(rows: DataFrame) -> DataFrame:
    return rows
