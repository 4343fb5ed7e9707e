"""Driver contract: entry smoke run and oracle equality on sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

FAST_ORACLE_KEYS = [
    "orders_active_premium_3y", "orders_non_premium", "streaming_counts", "rfmt_features",
    "rfmts_features", "rfmts_features_all", "customer_tiers", "rfmts_scores",
    "relative_importance", "feature_ranges", "density_by_tier", "legacy_normalise",
    "yeo_johnson_lambda", "normalised_tiers", "cluster_box_stats", "within_sse",
]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["Customer_Key", "RecencyDays"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", FAST_ORACLE_KEYS)
def test_oracle_equal_sf0001(spark, key):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from check_oracles import compare
    res = compare(spark, SF001, [key], verbose=False)
    assert res[key].startswith("OK"), res[key]
