"""Support vector machines by sequential minimal optimisation, in numpy, for one problem per task.

A problem is dense: x (n, d), y. Many problems, one for each label, fold or grid point, run side by
side through `per_group`; a group must fit one task, so large linear problems go to Spark's LinearSVC
(`classify.linear_svc`) instead. The dual problem is min 0.5 a'Qa + p'a with 0 <= a <= c and y'a
fixed; each step takes the pair with the largest gain to second order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 50_000
EPS = 1e-3
#: Most rows of one problem: its matrix of n x n numbers must fit a task.
MOST_ROWS = 10_000
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


# ---- kernels
def linear(a, b):
    return a @ b.T


def polynomial(degree: int = 3, gamma: float = 1.0, coef0: float = 0.0) -> Kernel:
    return lambda a, b: (gamma * (a @ b.T) + coef0) ** degree


def rbf(gamma: float = 1.0) -> Kernel:
    return lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))


def sigmoid(gamma: float = 1.0, coef0: float = 0.0) -> Kernel:
    return lambda a, b: np.tanh(gamma * (a @ b.T) + coef0)


def composite_rbf(parts: list[tuple[slice, float]]) -> Kernel:
    """The product of Gaussian kernels over column ranges."""
    return lambda a, b: np.prod([rbf(g)(a[:, s], b[:, s]) for s, g in parts], axis=0)


def precomputed(gram: np.ndarray) -> Kernel:
    """Rows of x are row numbers of a Gram matrix."""
    return lambda a, b: gram[np.ix_(a[:, 0].astype(int), b[:, 0].astype(int))]


KERNELS = {"linear": lambda **_: linear, "polynomial": polynomial, "rbf": rbf, "sigmoid": sigmoid}


def kernel_of(name: str, **options) -> Kernel:
    return KERNELS[name](**options)


# ---- solvers
def smo(q: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray, start: np.ndarray | None = None, eps: float = EPS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(alpha, rho) of min 0.5 a'Qa + p'a with y'a kept and 0 <= a <= c."""
    a = np.zeros(len(y)) if start is None else start.astype(float).copy()
    g = q @ a + p
    diagonal = np.diag(q)
    for _ in range(steps):
        up = np.where(y > 0, a < c, a > 0)
        low = np.where(y > 0, a > 0, a < c)
        v = -y * g
        if not up.any() or not low.any():
            break
        i = int(np.where(up, v, -np.inf).argmax())
        gap = v[i] - v
        if np.where(low, gap, -np.inf).max() < eps:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * y[i] * y * q[i], 1e-12)
        gain = np.where(low & (gap > 0), gap * gap / curve, -np.inf)
        j = int(gain.argmax())
        _move(a, g, q, y, c, i, j, gap[j] / curve[j])
    return a, _rho(a, g, y, c)


def _move(a, g, q, y, c, i, j, t) -> None:
    """Shift a[i] and a[j] by t along the line that keeps y'a, inside the box."""
    room_i = c[i] - a[i] if y[i] > 0 else a[i]
    room_j = a[j] if y[j] > 0 else c[j] - a[j]
    t = min(t, room_i, room_j)
    a[i] += y[i] * t
    a[j] -= y[j] * t
    g += t * (y[i] * q[i] - y[j] * q[j])


def _rho(a, g, y, c) -> float:
    """The mean of y g over free vectors, else the middle of its bounds."""
    yg = y * g
    free = (a > 0) & (a < c)
    if free.any():
        return float(yg[free].mean())
    upper = yg[np.where(y > 0, a <= 0, a >= c)]
    lower = yg[np.where(y > 0, a >= c, a <= 0)]
    hi, lo = upper.min() if len(upper) else None, lower.max() if len(lower) else None
    return float((hi + lo) / 2 if hi is not None and lo is not None else hi if hi is not None else lo if lo is not None else 0.0)


def smo_nu(q: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray, start: np.ndarray, eps: float = EPS, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """(alpha, rho, r) with the sum of each class kept too: pairs come from one class."""
    a = start.astype(float).copy()
    g = q @ a + p
    diagonal = np.diag(q)
    for _ in range(steps):
        best, pair = eps, None
        for s in (1, -1):
            own = y == s
            up, low = own & (a < c), own & (a > 0)
            if up.any() and low.any():
                i = int(np.where(up, -g, -np.inf).argmax())
                gap = np.where(low, g - g[i], -np.inf)
                j = int(gap.argmax())
                if gap[j] > best:
                    best, pair = gap[j], (i, j)
        if pair is None:
            break
        i, j = pair
        t = min(best / max(diagonal[i] + diagonal[j] - 2 * q[i, j], 1e-12), c[i] - a[i], a[j])
        a[i] += t
        a[j] -= t
        g += t * (q[i] - q[j])
    r = []
    for s in (1, -1):
        own = y == s
        free = own & (a > 0) & (a < c)
        if free.any():
            r.append(float(g[free].mean()))
        else:
            hi, lo = g[own & (a <= 0)], g[own & (a >= c)]
            r.append(float(((hi.min() if len(hi) else lo.max()) + (lo.max() if len(lo) else hi.min())) / 2))
    return a, (r[0] - r[1]) / 2, (r[0] + r[1]) / 2


# ---- models
@dataclass
class Model:
    """f(x) = sum of alpha K(x, sv) - rho."""

    sv: np.ndarray
    alpha: np.ndarray
    rho: float
    kernel: Kernel
    platt: tuple[float, float] | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(np.atleast_2d(x), self.sv) @ self.alpha - self.rho if len(self.sv) else np.full(len(np.atleast_2d(x)), -self.rho)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.decide(x) > 0).astype(int)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Platt's sigmoid if it was fitted, else the decision value clamped to 0 to 1."""
        f = self.decide(x)
        return platt_predict(f, *self.platt) if self.platt else np.clip((f + 1) / 2, 0, 1)


def _model(x, weights, rho, kernel) -> Model:
    some = np.abs(weights) > 1e-12
    return Model(x[some], weights[some], rho, kernel)


def c_svc(x, y, c: float = 1.0, kernel: Kernel = linear, weights: dict[int, float] | None = None, redistribute: bool = False) -> Model:
    """y in 0 and 1; `weights` multiply c for a class, `redistribute` gives both classes the same total."""
    s = np.where(np.asarray(y) == 1, 1.0, -1.0)
    if len(set(s)) < 2:
        raise ValueError("a support vector machine needs two classes")
    box = np.full(len(s), float(c))
    for k, w in (weights or {}).items():
        box[np.asarray(y) == k] *= w
    if redistribute:
        for k in (1.0, -1.0):
            box[s == k] *= len(s) / (2 * (s == k).sum())
    gram = kernel(x, x)
    a, rho = smo(gram * np.outer(s, s), -np.ones(len(s)), s, box)
    return _model(x, a * s, rho, kernel)


def nu_svc(x, y, nu: float = 0.5, kernel: Kernel = linear) -> Model:
    s = np.where(np.asarray(y) == 1, 1.0, -1.0)
    n = len(s)
    if nu * n / 2 > min((s > 0).sum(), (s < 0).sum()):
        raise ValueError("nu is too large for these classes")
    start = np.zeros(n)
    for k in (1.0, -1.0):
        left = nu * n / 2
        for i in np.flatnonzero(s == k):
            start[i] = min(1.0, left)
            left -= start[i]
    gram = kernel(x, x)
    a, rho, r = smo_nu(gram * np.outer(s, s), np.zeros(n), s, np.ones(n), start)
    r = r or 1.0
    return _model(x, a * s / r, rho / r, kernel)


def one_class(x, nu: float = 0.5, kernel: Kernel = linear) -> Model:
    n = len(x)
    start, left = np.zeros(n), nu * n
    for i in range(n):
        start[i] = min(1.0, left)
        left -= start[i]
    a, rho = smo(kernel(x, x), np.zeros(n), np.ones(n), np.ones(n), start)
    return _model(x, a, rho, kernel)


def epsilon_svr(x, y, c: float = 1.0, epsilon: float = 0.1, kernel: Kernel = linear) -> Model:
    y = np.asarray(y, float)
    n, gram = len(y), kernel(x, x)
    s = np.concatenate([np.ones(n), -np.ones(n)])
    q = np.block([[gram, -gram], [-gram, gram]])
    a, rho = smo(q, np.concatenate([epsilon - y, epsilon + y]), s, np.full(2 * n, float(c)))
    return _model(x, a[:n] - a[n:], rho, kernel)


def nu_svr(x, y, c: float = 1.0, nu: float = 0.5, kernel: Kernel = linear) -> Model:
    y = np.asarray(y, float)
    n, gram = len(y), kernel(x, x)
    start, left = np.zeros(n), c * nu * n / 2
    for i in range(n):
        start[i] = min(c, left)
        left -= start[i]
    s = np.concatenate([np.ones(n), -np.ones(n)])
    a, rho, _ = smo_nu(np.block([[gram, -gram], [-gram, gram]]), np.concatenate([-y, y]), s, np.full(2 * n, float(c)), np.concatenate([start, start]))
    return _model(x, a[:n] - a[n:], rho, kernel)


# ---- probabilities
def platt_fit(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(a f + b)), by Newton's method with backtracking on smoothed targets."""
    f, y = np.asarray(f, float), np.asarray(y)
    n1, n0 = int((y == 1).sum()), int((y != 1).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])

    def loss(w):
        z = w[0] * f + w[1]
        return float((t * z + np.logaddexp(0, -z)).sum())

    now = loss(ab)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(ab[0] * f + ab[1], -500, 500)))
        d, w = t - p, p * (1 - p)
        grad = np.array([(f * d).sum(), d.sum()])
        if np.abs(grad).max() < 1e-5:
            break
        h = np.array([[(f * f * w).sum() + 1e-12, (f * w).sum()], [(f * w).sum(), w.sum() + 1e-12]])
        step, size = -np.linalg.solve(h, grad), 1.0
        while size > 1e-10 and loss(ab + size * step) > now + 1e-4 * size * grad @ step:
            size /= 2
        ab = ab + size * step
        now = loss(ab)
    return float(ab[0]), float(ab[1])


def platt_predict(f, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(a * np.asarray(f) + b, -500, 500)))


def folds(ids, k: int = 5) -> np.ndarray:
    """The fold of each row, by a hash of its id; the same on every run, and in SQL."""
    return np.array([int(md5(str(i).encode()).hexdigest()[:8], 16) % k for i in ids])


def cross_decide(x, y, fit: Callable, k: int = 5, ids=None) -> np.ndarray:
    """Decision values of each row by the model that didn't see its fold."""
    part, out = folds(range(len(y)) if ids is None else ids, k), np.zeros(len(y))
    for f in range(k):
        test = part == f
        if test.any() and len(set(np.asarray(y)[~test])) > 1:
            out[test] = fit(x[~test], np.asarray(y)[~test]).decide(x[test])
    return out


def with_probability(x, y, fit: Callable, k: int = 5) -> Model:
    model = fit(x, y)
    model.platt = platt_fit(cross_decide(x, y, fit, k), np.asarray(y))
    return model


def confusion(y, predicted) -> dict[str, int]:
    y, p = np.asarray(y), np.asarray(predicted)
    return {"tp": int(((y == 1) & (p == 1)).sum()), "fp": int(((y == 0) & (p == 1)).sum()), "fn": int(((y == 1) & (p == 0)).sum()), "tn": int(((y == 0) & (p == 0)).sum())}


def class_sensitivity(y, predicted) -> float:
    """The mean of the shares that are right in each class."""
    y, p = np.asarray(y), np.asarray(predicted)
    return float(np.mean([(p[y == k] == k).mean() for k in sorted(set(y.tolist()))]))


def grid_search(x, y, cs, kernels: dict[str, Kernel], k: int = 5) -> list[tuple[str, float, float]]:
    """(kernel, c, sensitivity), the best first."""
    found = [(name, c, class_sensitivity(y, (cross_decide(x, y, lambda a, b, c=c, kn=kn: c_svc(a, b, c, kn), k) > 0).astype(int))) for name, kn in kernels.items() for c in cs]
    return sorted(found, key=lambda r: (-r[2], r[1], r[0]))


# ---- many classes
@dataclass
class MultiModel:
    """One-vs-one and one-vs-all models and the ways to vote."""

    classes: list
    pairs: dict[tuple, Model]
    alone: dict[object, Model]
    min_margin: float = 0.0
    options: dict = field(default_factory=dict)

    def votes(self, x: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)))
        for (a, b), m in self.pairs.items():
            i, j = self.classes.index(a), self.classes.index(b)
            first = m.decide(x) > 0
            both = np.ones(len(x), bool) if allowed is None else allowed[:, i] & allowed[:, j]
            out[:, i] += first & both
            out[:, j] += ~first & both
        return out

    def solo(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.alone[k].decide(x) for k in self.classes], axis=1)

    def predict(self, x: np.ndarray, one_vs_all: str = "none", all_vs_all: str = "all") -> list:
        """`one_vs_all`: none, best, veto, break_ties, veto_and_break_ties; `all_vs_all`: none, all, filtered_vs_all, filtered_vs_filtered.

        Veto: a class whose own model says no is out, and no class is None. Filtered: only classes
        whose own model says yes can win (vs_all: yet all pairs vote). Ties go to the class with the
        higher own value (break_ties), else to the first.
        """
        solo = self.solo(x) if self.alone else np.zeros((len(x), len(self.classes)))
        yes = solo > self.min_margin
        if one_vs_all == "best" or all_vs_all == "none":
            rank = solo.copy()
        else:
            votes = self.votes(x, yes if all_vs_all == "filtered_vs_filtered" else None)
            if all_vs_all.startswith("filtered"):
                votes[~yes] = -1
            tie = solo if "break_ties" in one_vs_all else -np.arange(len(self.classes))[None, :].repeat(len(x), 0).astype(float)
            spread = np.abs(tie).max() + 1
            rank = votes + tie / (4 * spread)
        if "veto" in one_vs_all:
            rank = np.where(yes, rank, -np.inf)
        best = rank.argmax(axis=1)
        out = [self.classes[i] for i in best]
        if "veto" in one_vs_all or all_vs_all.startswith("filtered"):
            out = [k if yes[r].any() else None for r, k in enumerate(out)]
        return out

    def vote_quality(self, x: np.ndarray) -> np.ndarray:
        """The winner's share of the votes."""
        v = self.votes(x)
        return v.max(axis=1) / np.maximum(v.sum(axis=1), 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Pairwise coupling of the pair models' probabilities."""
        k = len(self.classes)
        r = np.full((len(x), k, k), 0.5)
        for (a, b), m in self.pairs.items():
            i, j = self.classes.index(a), self.classes.index(b)
            p = np.clip(m.probability(x), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
        return np.stack([couple(m) for m in r])


def couple(r: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Class probabilities p that minimise the sum of (r_ji p_i - r_ij p_j)^2 with sum 1."""
    k = len(r)
    q = -r.T * r
    np.fill_diagonal(q, 0)
    q += np.diag([(r[[j for j in range(k) if j != t], t] ** 2).sum() for t in range(k)])
    system = np.block([[q, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    p = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
    p = np.maximum(p, 0)
    return p / p.sum()


def multi(x, y, fit: Callable | None = None, probability: bool = False) -> MultiModel:
    """All pair models and all one-vs-all models."""
    y = np.asarray(y)
    fit = fit or c_svc
    train = (lambda a, b: with_probability(a, b, fit)) if probability else fit
    classes = sorted(set(y.tolist()))
    pairs = {(a, b): train(x[(y == a) | (y == b)], (y[(y == a) | (y == b)] == a).astype(int)) for a, b in combinations(classes, 2)}
    return MultiModel(classes, pairs, {k: fit(x, (y == k).astype(int)) for k in classes})


# ---- on DataFrames
def linear_decisions(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(doc_id, label, value, predicted) of rows (doc_id, features) by linear models (label, weights, rho), all in built-in functions.

    There is one row for each label, so the models are broadcast.
    """
    dot = F.aggregate(F.zip_with("features", "weights", lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    values = rows.select("doc_id", "features").join(F.broadcast(models)).select("doc_id", "label", (dot - F.col("rho")).alias("value"))
    return values.withColumn("predicted", (F.col("value") > 0).cast("int"))


def vote(pairs: DataFrame, alone: DataFrame | None = None, one_vs_all: str = "none", all_vs_all: str = "all", margin: float = 0.0) -> DataFrame:
    """(doc_id, predicted, quality) by the rules of `MultiModel.predict`, from decisions as tables, in built-in functions.

    `pairs` has (doc_id, a, b, value), positive for a; `alone` has (doc_id, label, value). The quality
    is the winner's share of the votes that counted.
    """
    sides = pairs.select("doc_id", "a", "b", F.when(F.col("value") > 0, F.col("a")).otherwise(F.col("b")).alias("won"))
    own = None if alone is None else alone.select("doc_id", "label", F.col("value").alias("solo"), (F.col("value") > margin).alias("yes"))
    counted = sides
    if all_vs_all == "filtered_vs_filtered":
        good = own.where("yes").select("doc_id", "label")
        counted = sides.join(good.withColumnRenamed("label", "a"), ["doc_id", "a"], "left_semi").join(good.withColumnRenamed("label", "b"), ["doc_id", "b"], "left_semi")
    votes = counted.groupBy("doc_id", F.col("won").alias("label")).agg(F.count("*").alias("votes"))
    every = sides.select("doc_id", F.explode(F.array("a", "b")).alias("label")).distinct()
    board = every.join(votes, ["doc_id", "label"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    board = board.join(own, ["doc_id", "label"]) if own is not None else board.withColumns({"solo": F.lit(0.0), "yes": F.lit(True)})
    strict = "veto" in one_vs_all or all_vs_all.startswith("filtered")
    first = F.lit(0).cast("long") if one_vs_all == "best" or all_vs_all == "none" else F.col("votes")
    second = F.col("solo") if one_vs_all == "best" or all_vs_all == "none" or "break_ties" in one_vs_all else F.lit(0.0)
    rank = F.struct((F.col("yes") | F.lit(not strict)).alias("in"), first.alias("votes"), F.round(second, 9).alias("solo"))
    # of equal ranks the first label wins
    top = board.groupBy("doc_id").agg(F.max(rank).alias("top"), F.sum("votes").alias("all"))
    winner = board.join(top, "doc_id").where(rank == F.col("top")).groupBy("doc_id").agg(F.min(F.struct("label", "votes")).alias("w"), F.first("top").alias("top"), F.first("all").alias("all"))
    return winner.select("doc_id", F.when(F.col("top.in"), F.col("w.label")).alias("predicted"), F.coalesce(F.try_divide(F.col("w.votes"), F.col("all")), F.lit(0.0)).alias("quality"))


def per_group(rows: DataFrame, keys: list[str], work: Callable[[tuple, np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, features: str = "features", target: str = "y") -> DataFrame:
    """`work(key, x, y, rows)` for each group of rows with an array of features; one problem a task, of MOST_ROWS rows or an error."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > MOST_ROWS:
            raise ValueError(f"{len(p)} rows in problem {key}; sample them, or take classify.linear_svc")
        return work(key, np.stack(p[features].to_numpy()).astype(float), p[target].to_numpy(), p)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def train_models(rows: DataFrame, key: str = "label", c: float = 1.0, kernel: str = "linear", **options) -> DataFrame:
    """(label, rho, alpha, sv): a C-SVC for each label as a table of its support vectors."""

    def work(k, x, y, p):
        m = c_svc(x, y, c, kernel_of(kernel, **options))
        return pd.DataFrame({key: [k[0]], "rho": [m.rho], "alpha": [m.alpha.tolist()], "sv": [m.sv.tolist()]})

    kind = dict(rows.dtypes)[key]
    return per_group(rows, [key], work, f"{key} {kind}, rho double, alpha array<double>, sv array<array<double>>")


def decide(rows: DataFrame, models: DataFrame, key: str = "label", kernel: str = "linear", **options) -> DataFrame:
    """(doc_id, label, value, predicted) of rows (doc_id, features) by every model; models are small and bounded by their labels."""
    kept = [(r[key], Model(np.array(r.sv, float).reshape(len(r.alpha), -1), np.array(r.alpha), r.rho, kernel_of(kernel, **options))) for r in models.collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.stack(p["features"].to_numpy()).astype(float)
                for name, m in kept:
                    f = m.decide(x)
                    yield pd.DataFrame({"doc_id": p["doc_id"], key: name, "value": f, "predicted": (f > 0).astype(int)})

    kind = dict(models.dtypes)[key]
    return rows.select("doc_id", "features").mapInPandas(run, f"doc_id long, {key} {kind}, value double, predicted int")
