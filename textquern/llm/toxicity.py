"""Toxicity: cumulative-link ordinal regression over sparse word features.

The grade of a text is 0 (clean) to 3 (severe). The model is P(grade > k) = sigmoid(w.x - t_k): all
thresholds share the weights w and t_0 < t_1 < t_2. Its outputs are the probabilities of the grades,
the expected severity (their mean, 0 to 3), the likeliest grade (of equal ones the lower) and whether
the text is taken for toxic: P(grade > 0) of at least THRESHOLD.

Labels only say toxic or not. Grade 0 is what they call clean; the order of the toxic rows comes from
models that haven't seen them: the same regression with one threshold, fitted on FOLDS - 1 parts of
the sample, gives each toxic row of the part left out a value, and the thirds of these values are the
grades 1, 2 and 3. So severity means how far beyond the border unseen evidence puts a text, not a
count of words, and a mistaken label gets the lowest grade.

Features: words (runs of letters, digits and bytes beyond ASCII of the lowered text) and their
prefixes of 4 to 7 code points, as insults take endings; each with log(1 + occurrences), and once more
where it occurs three times and in over one word of 200. A feature is selected, for either class, by
the likelihood ratio of its document frequencies (RATIO, SURE). There is no cap: what the test selects
in at most SAMPLE texts is the vocabulary.

Edge cases: a null text counts as empty and has no features; repeated rows are scored each; of labels
of one doc_id that contradict each other the larger counts, and of several texts of one labelled
doc_id the first in order is fitted on; with no labelled row of a class the thresholds only express
the share of the grades; other columns pass or are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import LETTERS, arrow_map, texts
from textquern.llm.quality import labelled

#: Most labelled documents that a fit looks at, in the order of a hash of their ids.
SAMPLE = 8_000
THRESHOLD = 0.5
#: Most words whose features a worker remembers; then it starts anew.
MEMO = 100_000
GRADES, FOLDS = 4, 3
#: A feature is selected if it is RATIO times as common in one class and the root of its likelihood ratio statistic is at least SURE.
RATIO, SURE = 2.0, 4.5


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()


def parts(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its prefixes of 4 to 7 code points."""
    if word.isascii():
        return [word + b"$", *(word[:k] for k in range(4, min(len(word), 7) + 1))]
    whole = word.decode("utf-8", "surrogatepass")
    return [word + b"$", *(whole[:k].encode("utf-8", "surrogatepass") for k in range(4, min(len(whole), 7) + 1))]


def features(text: str) -> dict[bytes, int]:
    """Occurrences of every feature of a text."""
    found: dict[bytes, int] = {}
    ws = words(text)
    for w, n in Counter(ws).items():
        for f in parts(w):
            found[f] = found.get(f, 0) + n
    return found | _often(found, len(ws))


def _often(found: dict[bytes, int], n_words: int) -> dict[bytes, int]:
    return {f + b"#": n for f, n in found.items() if n >= 3 and 200 * n > n_words}


@dataclass(frozen=True)
class ToxicityModel:
    """The shared weight of each feature, and the ordered thresholds."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]
    memo: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, compare=False)

    def latent(self, text: str) -> float:
        known, memo, ws = self.weights, self.memo, words(text)
        found: dict[bytes, int] = {}
        for w, n in Counter(ws).items():
            fs = memo.get(w)
            if fs is None:
                if len(memo) >= MEMO:
                    memo.clear()
                fs = memo[w] = tuple(f for f in parts(w) if f in known or f + b"#" in known)
            for f in fs:
                found[f] = found.get(f, 0) + n
        found |= _often(found, len(ws))
        return sum(known[f] * np.log1p(n) for f, n in sorted(found.items()) if f in known)

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def objective(theta: np.ndarray, x, y: np.ndarray, grades: int, l2: float) -> tuple[float, np.ndarray]:
    """The penalised negative log-likelihood (a mean over rows) and its gradient.

    theta: the weights, the first threshold and the logarithms of the gaps between thresholds; x: (row
    numbers, feature numbers, values, width) of the entries that aren't 0.
    """
    rows, indices, values, width = x
    n = max(len(y), 1)
    w, t0, gaps = theta[:width], theta[width], np.exp(theta[width + 1 :])
    t = np.concatenate([[-np.inf, t0], t0 + np.cumsum(gaps), [np.inf]])
    z = np.bincount(rows, values * w[indices], minlength=len(y))
    up = 1 / (1 + np.exp(-np.clip(t[y + 1] - z, -500, 500)))
    low = 1 / (1 + np.exp(-np.clip(t[y] - z, -500, 500)))
    p = (up - low).clip(1e-12)
    du, dl = up * (1 - up) / p, low * (1 - low) / p
    dz = (du - dl) / n  # the loss's slope by z
    dt = np.zeros(grades - 1)
    np.add.at(dt, np.minimum(y, grades - 2), np.where(y < grades - 1, -du, 0) / n)
    np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, dl, 0) / n)
    slope = np.concatenate([np.bincount(indices, values * dz[rows], minlength=width) + l2 * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
    return float(-np.log(p).sum() / n + 0.5 * l2 * (w @ w)), slope


def _minimise(x, y: np.ndarray, grades: int, l2: float, rounds: int = 400) -> tuple[np.ndarray, tuple[float, ...]]:
    """Adam on the objective: weights and thresholds."""
    width = x[3]
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    first = np.maximum.accumulate(first + 1e-3 * np.arange(grades - 1))
    theta = np.concatenate([np.zeros(width), first[:1], np.log(np.diff(first).clip(1e-3))])
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, g = objective(theta, x, y, grades, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    gaps = np.exp(theta[width + 1 :])
    return theta[:width], tuple(float(t) for t in np.concatenate([[theta[width]], theta[width] + np.cumsum(gaps)]))


def severity(x, toxic: np.ndarray, l2: float, folds: int = FOLDS) -> np.ndarray:
    """Grades of training rows: 0 for clean ones, 1 to 3 for the thirds of the toxic ones by the value that models of other parts give them."""
    rows, indices, values, width = x
    part = np.zeros(len(toxic), int)
    for k in (0, 1):  # each part has its share of both classes
        own = np.flatnonzero(toxic == k)
        part[own] = np.arange(len(own)) % folds
    z = np.zeros(len(toxic))
    for f in range(folds):
        here = part != f
        if len(set(toxic[here])) < 2:
            continue
        number = np.cumsum(here) - 1
        on = here[rows]
        w, t = _minimise((number[rows[on]], indices[on], values[on], width), toxic[here], 2, l2, 150)
        z += np.where(part == f, np.bincount(rows, values * w[indices], minlength=len(toxic)) - t[0], 0.0)
    one, two = np.quantile(z[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (z > one) + (z > two), 0).astype(int)


def _root(k1: int, k0: int, n1: int, n0: int) -> float:
    """The root of the likelihood ratio statistic of a feature in k1 of n1 toxic and k0 of n0 clean texts; 0 if it isn't RATIO times as common in one of them."""
    if k1 * n0 < RATIO * k0 * n1 and k0 * n1 < RATIO * k1 * n0:
        return 0.0
    share = n1 / (n0 + n1)
    return float(np.sqrt(max(0.0, 2 * sum(k * np.log(k / (s * (k0 + k1))) for k, s in ((k1, share), (k0, 1 - share)) if k))))


def fit_counts(rows: list[dict[bytes, int]], toxic: np.ndarray, l2: float = 5e-5) -> ToxicityModel:
    """Fit on the word counts of labelled texts."""
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return ToxicityModel({}, tuple(float(np.log((1 - share) / share)) + k for k in range(GRADES - 1)))
    seen, known = [Counter(), Counter()], set()
    for r, t in zip(rows, toxic):
        key = (int(t), frozenset(r))
        if len(r) < 8 or key not in known:  # copies of a text are one witness
            seen[t].update(r.keys())
        known.add(key)
    # how sure it is that a feature goes with a class: the root of its likelihood ratio statistic
    chosen = sorted(w for w in seen[0] | seen[1] if _root(seen[1][w], seen[0][w], n1, n0) >= SURE)
    number = {w: i for i, w in enumerate(chosen)}
    row, indices, values = [], [], []
    for n, r in enumerate(rows):
        for w in sorted(r.keys() & number.keys()):
            row.append(n)
            indices.append(number[w])
            values.append(np.log1p(r[w]))
    x = (np.array(row, int), np.array(indices, int), np.array(values, float), len(chosen))
    weights, thresholds = _minimise(x, severity(x, toxic, l2), GRADES, l2)
    return ToxicityModel({w: float(weights[i]) for w, i in number.items()}, thresholds)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> ToxicityModel:
    """Fit on at most `sample` labelled rows (doc_id, toxic) outside the held-out part.

    A first pass over the sample finds the features whose document frequency differs between the
    classes; only counts of those reach the driver, never texts.
    """

    sampled = labelled(docs, labels, "toxic", sample)

    def count(batches):
        both = (Counter(), Counter())  # documents are counted under the empty feature
        for b in batches:
            for t, y in zip(texts(b), b.column("y").to_pylist()):
                both[y].update([b"", *features(t)])
                if len(both[0]) + len(both[1]) > MEMO:
                    yield _counted(both)
                    both = (Counter(), Counter())
        yield _counted(both)

    frequencies = arrow_map(sampled, count, "word binary, k0 long, k1 long").groupBy("word").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    total = arrow_map(sampled.select("doc_id", "y", F.lit("").alias("text")), count, "word binary, k0 long, k1 long").agg(F.sum("k0"), F.sum("k1")).first()
    n0, n1 = total[0] or 0, total[1] or 0
    if not n0 or not n1:
        return fit_counts([{}] * (n0 + n1), np.array([0] * n0 + [1] * n1), **options)
    share = n1 / (n0 + n1)
    k0, k1 = F.col("k0"), F.col("k1")
    part = lambda k, s: F.when(k > 0, k * F.log(k / (s * (k0 + k1)))).otherwise(0.0)
    g = 2 * (part(k1, share) + part(k0, 1 - share))
    differs = (k1 * n0 >= RATIO * k0 * n1) | (k0 * n1 >= RATIO * k1 * n0)
    kept = frequencies.where((F.length("word") > 0) & differs & (g >= SURE**2)).select("word").orderBy("word").toArrow()
    vocabulary = kept.column("word").to_pylist()
    number = {w: i for i, w in enumerate(vocabulary)}

    def thin(batches):
        for b in batches:
            pairs = [sorted((number[w], k) for w, k in features(t).items() if w in number) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([[w for w, _ in p] for p in pairs], pa.list_(pa.int32())), pa.array([[k for _, k in p] for p in pairs], pa.list_(pa.int32()))],
                ["doc_id", "y", "words", "counts"],
            )

    data = arrow_map(sampled, thin, "doc_id long, y int, words array<int>, counts array<int>").toArrow().sort_by("doc_id")
    rows = [{vocabulary[w]: k for w, k in zip(ws, ks)} for ws, ks in zip(data.column("words").to_pylist(), data.column("counts").to_pylist())]
    return fit_counts(rows, data.column("y").to_numpy().astype(int), **options)


def _counted(both: tuple[Counter, Counter]) -> pa.RecordBatch:
    words_seen = list(both[0] | both[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(words_seen, pa.binary()), pa.array([both[0][w] for w in words_seen], pa.int64()), pa.array([both[1][w] for w in words_seen], pa.int64())],
        ["word", "k0", "k1"],
    )


def _above(model: ToxicityModel, batch: pa.RecordBatch) -> np.ndarray:
    return model.above(np.array([model.latent(t) for t in texts(batch)], float).reshape(-1))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, expected_severity, grade, predicted): P(grade > 0), mean grade, likeliest grade, 1 if toxic."""

    def run(batches):
        for b in batches:
            up = _above(model, b)
            p = -np.diff(np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(up[:, 0]), pa.array(up.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array((up[:, 0] >= THRESHOLD).astype(np.int32))],
                ["doc_id", "score", "expected_severity", "grade", "predicted"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double, expected_severity double, grade int, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't taken for toxic, with all their columns."""

    def run(batches):
        for b in batches:
            yield b.filter(pc.less(pa.array(_above(model, b)[:, 0]), threshold))

    return arrow_map(docs, run, docs.schema)
