"""A cross-section of the registered queries against DuckDB on the smallest tables (all of them: oracle_check.py)."""

from __future__ import annotations

import os

import pytest

from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("latency_stats_by_producer", "token_totals", "sequence_gaps", "det_error_burst", "det_compaction", "topology_edges", "pipeline_requests", "metric_deltas", "src_rejected", "src_recording", "det_duplicate_worker", "metrics_at", "stream_retention", "stream_gaps")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text
