"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logarithms of counts, square roots of
shares). Each class gets a mean and a covariance that is shrunk towards the pooled one and
towards a multiple of the identity. A score is the logistic function of the difference of the two
log densities plus the log prior odds; both Mahalanobis terms come from triangular inverses of
Cholesky factors that are computed once when the model is fitted and are part of it.

Edge cases: a null text counts as empty and is scored like any other; repeated rows are scored
each; documents without a label take no part in fitting; of labels of one doc_id that contradict each
other the larger counts, and of several texts of one labelled doc_id the first in order is fitted on; with no labelled row of either class the
model scores every text at the share of label 1 (0.5 when there is none at all). Columns other than
the id and the text are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import arrow_map, fold, texts

#: Most labelled documents that a fit looks at, taken in the order of a hash of their ids.
SAMPLE = 20_000
#: From this score on a document is taken for good.
THRESHOLD = 0.7

# byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol, 8 beyond ASCII, 9 bar, 10 exclamation
_KINDS = np.zeros(256, np.uint8)
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c] = (
        8 if _c >= 128 else 1 if "a" <= _s <= "z" else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 5 if _s == "\n"
        else 4 if _s in " \t\r" else 6 if _s in ".,;:?'\"()-" else 9 if _s == "|" else 10 if _s == "!" else 7 if _c > 32 else 0
    )

NAMES = (
    "log_chars", "lower", "upper", "digit", "mark", "symbol", "bar", "exclamation", "beyond_ascii",
    "word_length", "distinct_words", "distinct_lines", "line_length", "top_word", "short_words", "sentences",
)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=11) if n else np.zeros(11)
    share = np.sqrt(counts / max(n, 1))
    words = data.lower().split()
    w = len(words)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    distinct = len(set(lines))
    short = sum(k for x, k in seen.items() if len(x) < 4)
    return [
        np.log1p(n), share[1], share[2], share[3], share[6], share[7], share[9], share[10], share[8],
        np.log1p((n - counts[4] - counts[5]) / max(w, 1)), np.log1p(len(seen)) / np.log1p(w) if w else 1.0,
        np.sqrt(distinct / max(len(lines), 1)), np.log1p(n / max(len(lines), 1)),
        np.sqrt(max(seen.values(), default=0) / max(w, 1)), np.sqrt(short / max(w, 1)), np.log1p(data.count(b". ")) - np.log1p(w / 20),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Log prior odds and, for both classes, the mean, the inverse Cholesky factor and its log determinant."""

    odds: float
    means: tuple[np.ndarray, np.ndarray] | None
    whiten: tuple[np.ndarray, np.ndarray] | None
    log_det: tuple[float, float] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """How likely label 1 is, for rows of statistics."""
        z = np.full(len(x), self.odds)
        if self.means is not None:
            for sign, mean, inverse, log_det in zip((-1, 1), self.means, self.whiten, self.log_det):
                y = (x - mean) @ inverse.T
                z = z - sign * 0.5 * ((y * y).sum(axis=1) + log_det)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_arrays(x: np.ndarray, y: np.ndarray, shrink: float = 0.15, ridge: float = 0.05) -> QualityModel:
    """`shrink`: the pooled covariance's share in each class's; `ridge`: the share of the scaled identity."""
    n1, n = int(y.sum()), len(y)
    if min(n1, n - n1) < 2:
        return QualityModel(float(np.log((n1 + 1) / (n - n1 + 1))), None, None, None)
    groups = [x[y == k] for k in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    spread = [np.cov(g, rowvar=False, bias=True) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, spread)) / n
    floor = np.diag(np.diag(pooled) + 1e-6)
    whiten, log_det = [], []
    for s in spread:
        factor = np.linalg.cholesky((1 - ridge) * ((1 - shrink) * s + shrink * pooled) + ridge * floor)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return QualityModel(float(np.log(n1 / (n - n1))), tuple(means), tuple(whiten), tuple(log_det))


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    """At most `sample` labelled documents (doc_id, text, y) outside the held-out part, by hash order; one row for each doc_id.

    The sampled labels are bounded by `sample`, so they are broadcast; only the sample's texts are shuffled.
    """
    key = F.col("doc_id").cast("string")
    picked = (
        labels.select("doc_id", F.col(target).cast("int").alias("_y"))
        .where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & (F.crc32(key) % 4 != 2))
        .groupBy("doc_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.md5(key), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> QualityModel:
    """Fit on at most `sample` rows of `labels` (doc_id, quality) that have a document and aren't held out."""

    def measure(batches):
        for b in batches:
            rows = [statistics(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    rows = arrow_map(labelled(docs, labels, "quality", sample), measure, "doc_id long, x array<double>, y int").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.x))  # sums in one order whatever the partitions
    return fit_arrays(np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.y for r in rows], int), **options)


def _scores(model: QualityModel, batch: pa.RecordBatch) -> np.ndarray:
    rows = [statistics(t) for t in texts(batch)]
    return model.scores(np.array(rows).reshape(len(rows), len(NAMES)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            s = _scores(model, b)
            held = [fold(i) == 2 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least `threshold`, with all their columns."""

    def run(batches):
        for b in batches:
            yield b.filter(pc.greater_equal(pa.array(_scores(model, b)), threshold))

    return arrow_map(docs, run, docs.schema)
