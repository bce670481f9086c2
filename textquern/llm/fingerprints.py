"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. A level collapses runs of one name, then
labels each name by deterministic coin tossing against its left neighbour (twice the place of the
lowest bit that differs, plus that bit; four times over, which leaves six labels, then three), and
cuts before every local maximum of the labels. A phrase of two to four names gets a new name, the
hash of what it holds. A cut depends on a few neighbours only, so equal substrings get equal names
inside, wherever they stand, level by level.

A fingerprint holds the smallest hashes of the distinct phrase names: COARSE of those of the third
level and up, a dot, FINE of those of the second, eight hexadecimal digits each. The likeness of two
fingerprints is the share of common ones among the smallest of both together, an estimate of the
Jaccard index of the sets of phrases (exact when a text has few).

Edge cases: a null text counts as empty, whose fingerprint is a dot; equal texts have equal
fingerprints; documents are put in the order of doc_id, then text, so repeated rows are neighbours;
rows without a doc_id have no place in the order, and an empty text takes the place of their next
document. Any text length works, in memory proportional to the longest text and CHUNK; rows that share
a doc_id, and a text of any length, are in one bucket whatever its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import arrow_map, cut, slices

COARSE, FINE = 48, 16
#: Bytes of text that a bucket of neighbouring documents should hold, and most buckets; with more text they grow.
BUCKET, BUCKETS = 12_000_000, 100_000
#: Code points that are parsed at once.
CHUNK = 500_000
#: Levels; a phrase of the last one spans about 2.7 ** LEVELS code points.
LEVELS = 12

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWEST = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of the next level and the documents they belong to."""
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if len(at) < n:
        runs = np.diff(np.append(at, n)).astype(np.uint64)
        names, doc = names[at], doc[at]
        many = runs > 1
        names[many] = _mix(names[many] + runs[many] * _ODD[7])
        n = len(at)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    x = np.ones(n, np.uint64)
    x[1:] = names[1:] ^ names[:-1]
    x[first | (x == 0)] = 1
    place = np.bitwise_count((x & (~x + _ONE)) - _ONE)
    label = place * np.uint8(2) + ((names >> place.astype(np.uint64)) & _ONE).astype(np.uint8)
    for _ in range(3):
        y = np.ones(n, np.uint8)
        y[1:] = label[1:] ^ label[:-1]
        y[first] = 1
        place = _LOWEST[y]
        label = place * np.uint8(2) + ((label >> place) & np.uint8(1))
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    for value in (5, 4, 3):
        i = np.flatnonzero(label == value)
        if len(i):
            left = np.where(first[i], 9, label[i - 1])
            right = np.where(last[i], 9, label[np.minimum(i + 1, n - 1)])
            label[i] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    top = first.copy()
    top[1:] |= label[1:] > label[:-1]
    high = np.zeros(n, bool)
    high[:-1] = label[:-1] > label[1:]
    start = np.flatnonzero(first | (top & high & ~last))
    size = np.diff(np.append(start, n))
    inside = np.arange(n) - np.repeat(start, size)
    mixed = _mix(names * _ODD[6]) * _ODD[np.minimum(inside, 5)]
    return _mix(np.add.reduceat(mixed, start)), doc[start]


def _smallest(doc: list[np.ndarray], value: list[np.ndarray], count: int, k: int) -> list[np.ndarray]:
    """The k smallest distinct values of each document."""
    if not doc or not sum(map(len, doc)):
        return [np.zeros(0, ">u4")] * count
    keys = np.unique((np.concatenate(doc).astype(np.uint64) << np.uint64(32)) | np.concatenate(value))
    owner = (keys >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(count + 1))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[a : min(b, a + k)] for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts, parsed side by side."""
    out: list[str] = []
    for a, b in slices([len(t) for t in texts], CHUNK):
        part = texts[a:b]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(part), dtype=np.uint32), [len(t) for t in part])
        names = _mix(codes.astype(np.uint64) + _ODD[0])
        coarse, fine = ([], []), ([], [])
        for step in range(1, LEVELS + 1):
            if not len(names):
                break
            names, doc = level(names, doc)
            if step >= 2:
                into = coarse if step > 2 else fine
                into[0].append(doc)
                into[1].append(_mix(names + np.uint64(step * int(_ODD[5]) % 2**64)) >> np.uint64(32))
            if step > 2:  # a document of one name is done
                on = np.bincount(doc, minlength=len(part))[doc] > 1
                names, doc = names[on], doc[on]
        for x, y in zip(_smallest(*coarse, len(part), COARSE), _smallest(*fine, len(part), FINE)):
            out.append(x.tobytes().hex() + "." + y.tobytes().hex())
    return out


def _jaccard(a: list[str], b: list[str], k: int) -> float:
    both = sorted({*a, *b})[:k] if min(len(a), len(b)) >= k else sorted({*a, *b})
    common = {*a} & {*b}
    return sum(x in common for x in both) / len(both) if both else 0.0


def likeness(a: str, b: str) -> float:
    """0 (nothing in common) to 1 (equal)."""
    if a == b:
        return 1.0
    (a1, a2), (b1, b2) = ([[p[i : i + 8] for i in range(0, len(p), 8)] for p in x.split(".")] for x in (a, b))
    coarse = _jaccard(a1, b1, COARSE)
    if min(len(a1), len(b1)) >= 16:
        return coarse
    return (coarse * (len(a1) + len(b1)) + _jaccard(a2, b2, FINE) * (len(a2) + len(b2))) / (len(a1) + len(a2) + len(b1) + len(b2) or 1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for b in batches:
            found = fingerprint_texts([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, doc_id, text), sorted inside their partition, in which each document's next row of a bucket is the next document.

    Buckets are ranges of doc_id of about equal bytes, a partition each, that begin at ids that exist;
    the first document of each is also the tail of the one before (and the very first of the last
    one), so one shuffle is enough. Rows without an id have buckets below 0.
    """
    lengths = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    whole = lengths.agg(F.sum(F.col("bytes") + 16).alias("bytes"), F.min("doc_id").alias("least")).first()
    size = whole.bytes or 0
    n = max(1, min(BUCKETS, -(-size // BUCKET)), min(size >> 20, docs.sparkSession.sparkContext.defaultParallelism))
    # ids repeated by their bytes (64 for each bucket in all, fractions by chance of a hash), so that quantiles of ids are quantiles of bytes
    share = (F.col("bytes") + 16) * F.lit(64.0 * n / (whole.bytes or 1)) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    spread = lengths.where("doc_id is not null").select("doc_id", F.floor(share).cast("int").alias("k")).where("k > 0").select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("k"))))
    found = spread.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 100 * max(n, 1000)).alias("p")).first().p
    starts = np.array(sorted({whole.least, *(found or [])}) if whole.least is not None else [], np.int64)

    def place(batches):
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            known = np.asarray(ids.is_valid())
            value = np.asarray(ids.fill_null(0))
            bucket = np.searchsorted(starts, value, "right") - 1
            bucket[~known] = -1 - np.arange(len(value))[~known] % n
            text = b.column("text").fill_null("")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.zeros(len(value), bool)), ids, text], ["bucket", "tail", "doc_id", "text"])
            edge = np.flatnonzero(known & np.isin(value, starts))
            if len(edge):
                take = pa.array(edge)
                before = (bucket[edge] - 1) % len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int64()), pa.array(np.ones(len(edge), bool)), ids.take(take), text.take(take)], ["bucket", "tail", "doc_id", "text"])

    rows = arrow_map(docs.select("doc_id", "text"), place, "bucket long, tail boolean, doc_id long, text string")
    return rows.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket", "tail", "doc_id", "text")


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""

    def finish(rows, prints):
        edited, kept = [], []
        for i, (bucket, tail, doc_id, text) in enumerate(rows):
            if tail:
                continue
            follows = bucket >= 0 and i + 1 < len(rows) and rows[i + 1][0] == bucket
            half = len(text) // 2
            edited.append(text[: len(text) - half] + (rows[i + 1][3][:half] if follows else ""))
            kept.append((i, prints[i + 1] if follows else "."))
        eprints = fingerprint_texts(edited)
        cols = [[], [], [], [], [], [], []]
        for (i, nprint), e, p in zip(kept, edited, eprints):
            for c, v in zip(cols, (rows[i][2], len(rows[i][3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), prints[i], p, likeness(prints[i], p), likeness(prints[i], nprint))):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        rows, prints, size = [], [], 0  # the last row waits for the one after it
        for b in batches:
            for row in zip(b.column("bucket").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                rows.append(row)
                size += len(row[3])
                if size > CHUNK and len(rows) > 1:
                    prints += fingerprint_texts([r[3] for r in rows[len(prints) :]])
                    if len(rows) > 1:
                        yield finish_but_last(rows, prints)
                    rows, prints, size = rows[-1:], prints[-1:], 0
        if rows:
            prints += fingerprint_texts([r[3] for r in rows[len(prints) :]])
            yield finish(rows, prints)

    def finish_but_last(rows, prints):
        last = (rows[-1][0], True, rows[-1][2], rows[-1][3])  # serves as a neighbour only
        return finish([*rows[:-1], last], prints)

    return arrow_map(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
