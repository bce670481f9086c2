"""Train, predict and scale as whole steps on labelled rows (label, features), as read by `sources.corpus.read_svmlight`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquern.operators import metrics, svm

#: Problem kinds: the classifiers take labels above 0 as the positive class.
FITS: dict[str, Callable] = {
    "c_svc": lambda x, y, o: svm.c_svc(x, (y > 0).astype(int), o.get("c", 1.0), o["kernel"], o.get("weights"), o.get("redistribute", False)),
    "nu_svc": lambda x, y, o: svm.nu_svc(x, (y > 0).astype(int), o.get("nu", 0.5), o["kernel"]),
    "one_class": lambda x, y, o: svm.one_class(x, o.get("nu", 0.5), o["kernel"]),
    "epsilon_svr": lambda x, y, o: svm.epsilon_svr(x, y, o.get("c", 1.0), o.get("epsilon", 0.1), o["kernel"]),
    "nu_svr": lambda x, y, o: svm.nu_svr(x, y, o.get("c", 1.0), o.get("nu", 0.5), o["kernel"]),
}
REGRESSION = ("epsilon_svr", "nu_svr")


def train(rows: DataFrame, kind: str = "c_svc", kernel: str = "linear", kernel_options: dict | None = None, **options) -> DataFrame:
    """(kind, kernel, rho, alpha, sv): one row. A problem must fit one task: svm.MOST_ROWS rows at most."""
    if kind not in FITS:
        raise ValueError(f"unknown kind {kind!r}")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > svm.MOST_ROWS:
            raise ValueError(f"{len(p)} rows in one problem; sample them, or take classify.linear_svc")
        x, y = np.stack(p["features"].to_numpy()).astype(float), p["label"].to_numpy(float)
        m = FITS[kind](x, y, options | {"kernel": svm.kernel_of(kernel, **(kernel_options or {}))})
        return pd.DataFrame({"kind": [kind], "kernel": [kernel], "rho": [m.rho], "alpha": [m.alpha.tolist()], "sv": [m.sv.tolist()]})

    dense = rows.select("label", vector_to_array("features").alias("features"), F.lit(1).alias("_all"))
    return dense.groupBy("_all").applyInPandas(work, "kind string, kernel string, rho double, alpha array<double>, sv array<array<double>>")


def predict(rows: DataFrame, model: DataFrame, kernel_options: dict | None = None) -> DataFrame:
    """(label, value, predicted): decision values, and classes (1 or -1) or values."""
    r = model.first()
    m = svm.Model(np.array(r.sv, float).reshape(len(r.alpha), -1), np.array(r.alpha), r.rho, svm.kernel_of(r.kernel, **(kernel_options or {})))
    regression = r.kind in REGRESSION

    def run(batches):
        for p in batches:
            if len(p):
                f = m.decide(np.stack(p["features"].to_numpy()).astype(float))
                yield pd.DataFrame({"label": p["label"], "value": f, "predicted": f if regression else np.where(f > 0, 1.0, -1.0)})

    return rows.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("features")).mapInPandas(run, "label double, value double, predicted double")


def evaluate(predicted: DataFrame, regression: bool) -> DataFrame:
    """(accuracy) of classes, or (mse, r2) of values."""
    if regression:
        return metrics.regression_scores(predicted, "label", "predicted")
    return predicted.agg(F.avg(((F.col("label") > 0) == (F.col("predicted") > 0)).cast("double")).alias("accuracy"))
