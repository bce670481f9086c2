"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "tokenize_counts", "tfidf", "bm25", "top_terms_per_doc", "inverted_index", "label_conditional", "label_pairs",
    "pairwise_cosine", "similarity_histogram", "kmeans_assign_step", "nearest_clusters", "doc_prf", "label_report",
    "nb_train", "nb_predict", "vs_predict", "training_matrix", "svm_linear_decision", "minmax_scale", "event_windows",
)


def main() -> None:
    from textquern.plans.catalog import QUERIES
    from textquern.session import get_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", partitions=int(cpus), memory="8g")
    QUERIES["label_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first job starts the workers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name, "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
