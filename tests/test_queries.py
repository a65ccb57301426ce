"""The registered queries against their oracles, and the driver contract.

By default one or two queries of every family run; ``TIDECAST_ALL=1`` runs all.
"""

import os

import pytest
from conftest import SF

import __spark_entry__ as entry
import check

SOME = [
    "align_to_grid", "transform_panel", "impute_block", "build_vintages", "join_asof_last_known", "leaderboard_rollup",
    "ensemble_hybrid", "metric_crps_ensemble", "moment_matrix", "kalman_collapse", "kalman_filter", "minnesota_dummies",
    "bridge_design", "bridge_forecast", "scan_html_table", "scan_release_csv_rejects", "stream_first_release", "run_daily",
    "run_daily_dashboard", "bootstrap_bands", "collinear_members", "kalman_smooth", "minnesota_posterior",
]
KEYS = list(entry.oracle_sql()) if os.environ.get("TIDECAST_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    assert check.compare(spark, con, key, SF).startswith("ok")


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).columns == ["model", "quarters_ahead", "mae", "n"]
