"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion into Spark's ``noop`` sink (all rows
computed, nothing collected) three times, those of ``FITS`` once; the median is
reported.  No model is kept between calls.  Prints one
JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# the reference's live workflow, end to end: load -> clean -> TF-IDF ->
# similarity -> classification -> clustering -> topics -> knowledge graph
HEADLINE = [
    "read_corpus", "text_variants", "clean_doc", "sentences", "bag_of_words", "top_mean_tfidf",
    "clean_bag_of_words", "tfidf_l2", "naive_bayes", "score_sentiment", "cosine_sparse",
    "cosine_dense", "silhouette", "kmeans_assign", "roc_auc", "build_graph",
    "entity_graph", "neighborhood", "tfidf_clean", "pattern_join",
]
# iterative fits of minutes: run once
FITS = ["lda_topics", "lsa_topics", "word_vectors", "document_vectors", "linear_svm", "neural_genre_classifier"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE + FITS
    from revlens.session import build_session
    from revlens.plans import QUERIES
    spark = build_session(f"local[{cpus}]", app="revlens-bench", shuffle_partitions=int(cpus) * 2)
    results, errors = {}, {}
    for name in names:
        times = []
        try:
            for _ in range(1 if name in FITS else runs):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - t0)
            results[name] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_median_sec", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": sf, "cpus": int(cpus), "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
