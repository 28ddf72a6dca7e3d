"""A cross-section of the registered queries beside DuckDB on the smallest
tables; with ``--all-twins``, or by ``python -m tests.oracle_check``, all."""

import pytest

import __spark_entry__ as entry
from perfspark.plans import catalog
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = """
filter_chain filter_min_group_size rule_router tree_decode derive_op_features nested_scope_features
join_cross_device_pairs graph_edges missing_task_ids conflicting_duplicates duplicate_groups
same_x_diff_y_across_devices nearest_train_distance knn_kernels label_stats box_stats device_ratio
op_time_stats cost_cdf result_pivot flip_table metrics_regression best_worst_split cmd domain_vs_rest mmd
running_best convergence_flag ema begin_end_pairs split_every_kth select_tasks split_by_network assign_shards
grid_configs tf_boxcox tf_quantile_normal select_tasks_cmd_rm entry_sensitivity forecast_convergence
scan_trace_begin_end scan_regex_log scan_report_section scan_op_database scan_kernel_rejects task_stat_report
kmeans_clusters select_tasks_kmeans pca_2d gbt_regression per_group_models grouped_cost_fit replay_vs_profile
common_tasks upsample_minority duplicate_gap_distribution duration_seconds device_facts remap_header
""".split()


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        every = metafunc.config.getoption("--all-twins", default=False)
        metafunc.parametrize("name", sorted(catalog.ORACLES) if every else NAMES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
