"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "asof_imbalance_ratio", "asof_train_test_sets", "window_feature_stats", "window_root_cause", "window_summary_structured",
    "answer_vector", "policy_gate", "temporal_dense", "delay_trace", "classification_metrics_global", "or_fusion_grid",
    "feature_contract_stats", "nearest_rank_quantiles", "auc_windows", "windowed_accuracy", "fading_accuracy", "impute_mean",
    "drift_ddm", "drift_adwin", "distance_outliers", "dbscan_micro_clusters", "prequential_naive_bayes", "multinomial_naive_bayes",
    "recommender_baseline", "knn_recent_window",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from spindlewatch.plans import registry
    from spindlewatch.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    spark.read.parquet(f"{sf}/region.parquet").count()  # starts the executor threads
    seconds = {}
    for name in [a for a in sys.argv[1:]] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
