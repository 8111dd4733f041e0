"""Registered queries against their SQL twins. ALL_QUERIES=1 runs every one; the default takes some of each family."""
import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FAMILIES = [
    "entry", "label_interval_window", "asof_train_test_sets", "disk_metadata_upsert", "window_feature_stats", "window_targets",
    "window_summary_legacy", "summary_parse_back", "answer_normalize", "policy_gate", "cache_variant", "temporal_dense", "delay_trace",
    "delay_trace_exact_queue", "classification_metrics_local", "kappa_temporal_and_majority", "windowed_accuracy", "fading_accuracy",
    "auc_by_language", "or_fusion_grid", "model_status", "policy_suggestion", "feature_contract_choice", "nearest_rank_quantiles",
    "window_stratified_sample", "poisson_weights", "impute_mean", "drift_ddm", "distance_outliers", "dbscan_micro_clusters",
    "cluster_entropies", "prequential_delayed", "weighted_vote", "knn_recent_window", "evaluation_log_scan", "stream_drift_cusum",
    "stream_sliding_windows",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAMILIES[1:]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    ok, message = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["disk", "day", "root_cause"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
