"""Whole-session comparison: a baseline against a candidate in one call."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.operators import compare as C
from beaconlake.operators import topology as T
from beaconlake.operators.detectors import Config, run_all
from beaconlake.session import cut_lineage

REC = "recording_id"


@dataclass(frozen=True)
class Comparison:
    """Per pair of recordings: deltas of the session, the alignment of its units and their deltas, and the differences of findings and graph."""

    totals: DataFrame
    alignment: DataFrame
    rows: DataFrame
    findings: DataFrame
    nodes: DataFrame
    edges: DataFrame


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of both sides; recording ``r`` becomes ``r/a`` and ``r/b``."""
    led = lambda df, side: df.withColumn(REC, F.concat(REC, F.lit(f"/{side}")))
    return led(a, "a").unionByName(led(b, "b"), allowMissingColumns=True)


def sided(df: DataFrame) -> DataFrame:
    """``pair_id`` and ``side`` in place of the recording of :func:`both_sides`."""
    cut = F.expr(f"length({REC}) - 2")
    return df.withColumn("pair_id", F.substring(F.col(REC), F.lit(1), cut)).withColumn("side", F.right(F.col(REC), F.lit(1))).drop(REC)


def request_names(alignment: DataFrame) -> DataFrame:
    """Subject map: the request ids of B that are aligned with another id of A, as A calls them."""
    pairs = alignment.where("status = 'matched' AND a_unit <> b_unit")
    return pairs.select(F.concat("pair_id", F.lit("/b")).alias(REC), F.col("b_unit").alias("subject"), F.col("a_unit").alias("mapped"))


def compare_sessions(a: DataFrame, b: DataFrame, mode: str = "request", config: Config = Config(), kinds: Iterable[str] | None = None) -> Comparison:
    """Compare the recordings of ``b`` (candidates) with those of the same id in ``a`` (baselines), units aligned by ``mode`` (run, request or turn).

    Findings about aligned requests keep one signature even where the recordings use other request ids: B's ids are read through the request
    alignment, whatever ``mode`` is, before anything is signed. All detectors take part, or those named by ``kinds``. A recording on one side only is compared with nothing.
    """
    events = both_sides(a, b)
    facts = cut_lineage(C.request_facts(events))
    units = lambda of: sided(C.unit_stats(events, facts, of))
    # Each unit table is met by the alignment and by the deltas, so it is computed once.
    requests = cut_lineage(units("request"))
    by_request = cut_lineage(C.align_units(requests))
    chosen = requests if mode == "request" else cut_lineage(units(mode))
    alignment = by_request if mode == "request" else cut_lineage(C.align_units(chosen))
    signed = C.finding_signatures(run_all(events, config, kinds), request_names(by_request))
    stated = cut_lineage(T.mentions(events))
    edges = sided(T.topology_edges(stated).select(REC, "edge_id", "status", "count", "failures"))
    return Comparison(
        totals=C.metric_deltas(units("session")), alignment=alignment, rows=C.metric_deltas(chosen, alignment), findings=C.diff_findings(sided(signed)),
        nodes=C.diff_graph(sided(T.topology_nodes(stated)), "node_id"), edges=C.diff_graph(edges, "edge_id", ("count", "failures")),
    )
