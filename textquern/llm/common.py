"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquern.session import cut

__all__ = ["KEPT", "LETTERS", "Memo", "arrow_map", "cut", "fold", "hot_join", "slices", "table", "texts"]

#: By module, how to drop what it keeps in a Python worker from task to task.
KEPT: dict[str, Callable[[], None]] = {}

#: Letters A-Z and every byte that is no word byte: for words of letters, digits and all that is beyond ASCII.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Give free memory back to the system; allocators keep it otherwise, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _alone(function: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function's batches, in a worker that drops what other modules keep before, and free memory after."""
    for module, drop in KEPT.items():
        if module != function.__module__:
            drop()
    try:
        yield from function(batches)
    finally:
        _trim()


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow without a barrier: a lost task is run again from its own input. A worker holds what tasks of one module need, not of several."""

    def run(batches):
        return _alone(function, batches)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of at most `limit` in total, one item at least in each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Memo:
    """A dictionary of at most `limit` entries in two generations: what was used since the last turn outlives it."""

    def __init__(self, limit: int):
        self.half, self.new, self.old = max(1, limit // 2), {}, {}

    def recall(self, keys: Iterable) -> tuple[dict, list]:
        """Of keys that aren't in `new`: what the older generation knows, and the keys that nobody knows."""
        known, unknown = {}, []
        for k in keys:
            v = self.old.get(k)
            if v is None:
                unknown.append(k)
            else:
                known[k] = v
        self.keep(known)
        return known, unknown

    def keep(self, items: dict) -> None:
        if len(items) > self.half:
            return
        if len(self.new) + len(items) > self.half:
            self.old, self.new = self.new, {}
        self.new.update(items)


def hot_join(rows: DataFrame, unique: DataFrame, keys: list[str], share: float = 1e-3) -> DataFrame:
    """An inner join with `unique`, which has one row for each key and the number `_n` of its rows among `rows`.

    Keys with over `share` of all rows, at most 1 / `share` of them, are broadcast, so their rows
    stay where they are; all other keys meet by shuffle. `_n` is dropped.
    """
    least = unique.agg(F.coalesce(F.sum("_n") * F.lit(share), F.lit(0.0)).alias("_least"))
    marked = unique.join(F.broadcast(least)).withColumn("_hot", F.col("_n") > F.greatest(F.col("_least"), F.lit(1000.0))).drop("_least", "_n")
    hot, cold = marked.where("_hot").drop("_hot"), marked.where("not _hot").drop("_hot")
    here = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.unionByName(rest)


def fold(doc_id: int | None) -> int:
    """The part of four that a document belongs to; 2 is held out of all training."""
    return zlib.crc32(str(doc_id).encode()) % 4
