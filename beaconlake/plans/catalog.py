"""All registered queries."""

from __future__ import annotations

from beaconlake.plans import queries_compare, queries_core, queries_detectors, queries_ingest, queries_pipeline, queries_recordings, queries_series, queries_topology  # noqa: F401
from beaconlake.plans.registry import ORACLES, QUERIES  # noqa: F401
