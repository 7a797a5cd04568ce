"""Events correlated with selected events.

Per correlation value only its first rows and their number are needed, so both
are computed per value before the selection is joined: a value shared by a large
part of all events never meets the selection row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.identity import with_stream
from beaconlake.schema import ORD, ord_col

REC = "recording_id"
LIMIT = 25


def correlated(events: DataFrame) -> DataFrame:
    """Events reduced to their correlation values."""
    r = Readers(events)
    rid = R.filled("request_id")
    rows = with_stream(events)
    return rows.select(
        REC, *ORD, r.name("tool_call_id").alias("tool_call"), rid.alias("request_id"), F.when(rid.isNotNull(), F.to_json(F.array("stream", rid))).alias("request"),
        r.name("parent_request_id").alias("parent"), R.filled("run_id").alias("run"), R.filled("agent_id").alias("agent"),
    )


def _heads(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per key: number of events, and the first ``limit`` of them as rows."""
    w = Window.partitionBy(*keys).orderBy(*ORD)
    return rows.select(*keys, *ORD).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def _totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _group(selection: DataFrame, rows: DataFrame, kind: str, value: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(totals, shown candidates) of the events that share ``value`` with the selected event."""
    mine = selection.where(F.col(value).isNotNull()).select(REC, F.col("event_id").alias("selected_id"), value)
    used = rows.where(F.col(value).isNotNull()).join(mine.select(REC, value).distinct(), [REC, value], "left_semi")
    named = [F.lit(kind).alias("kind"), F.col(value).alias("value")]
    totals = mine.join(_totals(used, [REC, value]), [REC, value]).select(REC, "selected_id", *named, (F.col("n") - 1).alias("total"))
    shown = mine.join(_heads(used, [REC, value], limit + 1), [REC, value]).where("event_id <> selected_id").select(REC, "selected_id", *named, *ORD)
    return totals, shown


def lineage(rows: DataFrame) -> DataFrame:
    """The single parent and run a request's events name; null parent where they disagree."""
    folded = rows.where("request IS NOT NULL").groupBy(REC, "request").agg(
        F.min("parent").alias("p0"), F.max("parent").alias("p1"), F.min("run").alias("r0"), F.max("run").alias("r1")
    )
    one_run = F.col("r0").isNull() | (F.col("r0") == F.col("r1"))
    return folded.select(REC, "request", F.when((F.col("p0") == F.col("p1")) & one_run, F.col("p0")).alias("one_parent"), F.when(F.col("r0") == F.col("r1"), F.col("r0")).alias("one_run"))


def _children_by_run(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Events of the child requests of ``parents``, dealt to the groups a selected event may ask for.

    ``fits``: ``*`` all children, ``-`` children that name the parent without a run, ``run:x`` the others that name it from run x; an event is once in
    ``*`` and once in the rest, or once per run. ``itself`` is the request where it names its own id, else empty: only such a request can be the selected
    event's own. So a selected event meets the first rows of at most two groups, however many children its request has.
    """
    named = rows.where("request IS NOT NULL AND parent IS NOT NULL").join(parents, [REC, "parent"], "left_semi")
    names = named.select(REC, "parent", "request", "run", F.when(F.col("request_id") == F.col("parent"), F.col("request")).otherwise("").alias("itself")).distinct()
    child = [REC, "parent", "request"]
    without = names.where("run IS NULL").select(*child, "itself", F.lit("-").alias("fits"))
    within = names.where("run IS NOT NULL").join(without.select(*child), child, "left_anti").select(*child, "itself", F.concat(F.lit("run:"), "run").alias("fits"))
    all_ = names.select(*child, "itself").distinct().withColumn("fits", F.lit("*"))
    dealt = without.unionByName(within).unionByName(all_)
    return rows.select(REC, "request", *ORD).join(dealt, [REC, "request"])


def related_groups(events: DataFrame, selected: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(totals, shown): groups of the selected events (``recording_id, event_id``) with at most ``limit`` rows each."""
    rows = correlated(events)
    selection = rows.join(selected.select(REC, "event_id"), [REC, "event_id"], "left_semi")
    parts = [_group(selection, rows, k, v, limit) for k, v in (("tool_call", "tool_call"), ("request", "request"), ("run", "run"), ("agent", "agent"))]

    # Parent: events of the one parent id, in any stream, from a run that does not contradict.
    facts = lineage(rows.join(selection.where("request IS NOT NULL").select(REC, "request").distinct(), [REC, "request"], "left_semi"))
    up = selection.where("request IS NOT NULL").select(REC, F.col("event_id").alias("selected_id"), F.col("request").alias("own")).join(
        facts.withColumnRenamed("request", "own"), [REC, "own"]
    ).where("one_parent IS NOT NULL").withColumnRenamed("one_parent", "request_id")
    named = rows.where("request_id IS NOT NULL").withColumn("run_key", F.coalesce("run", F.lit(""))).join(up.select(REC, "request_id").distinct(), [REC, "request_id"], "left_semi")
    keys = [REC, "request_id", "request", "run_key"]
    agrees = (F.col("request") != F.col("own")) & (F.col("one_run").isNull() | (F.col("run_key") == "") | (F.col("run_key") == F.col("one_run")))
    label = [F.lit("parent").alias("kind"), F.col("request_id").alias("value")]
    totals = up.join(_totals(named, keys), [REC, "request_id"]).where(agrees).groupBy(REC, "selected_id", *label).agg(F.sum("n").alias("total"))
    shown = up.join(_heads(named, keys, limit), [REC, "request_id"]).where(agrees).select(REC, "selected_id", *label, *ORD)
    parts.append((totals, shown))

    # Children: requests whose events name this request as parent, from a run that does not contradict.
    down = selection.where("request_id IS NOT NULL").select(REC, F.col("event_id").alias("selected_id"), F.col("request").alias("own"), F.col("request_id").alias("parent"), F.col("run").alias("own_run"))
    grouped = _children_by_run(rows, down.select(REC, "parent").distinct())
    fits = F.when(F.col("own_run").isNull(), F.array(F.lit("*"))).otherwise(F.array(F.lit("-"), F.concat(F.lit("run:"), "own_run")))
    asked = down.select(REC, "selected_id", "own", "parent", F.explode(fits).alias("fits"))
    keys = [REC, "parent", "fits", "itself"]
    label = [F.lit("children").alias("kind"), F.col("parent").alias("value")]
    other = F.col("itself") != F.col("own")
    totals = asked.join(_totals(grouped, keys), [REC, "parent", "fits"]).where(other).groupBy(REC, "selected_id", *label).agg(F.sum("n").alias("total"))
    shown = asked.join(_heads(grouped, keys, limit), [REC, "parent", "fits"]).where(other).select(REC, "selected_id", *label, *ORD)
    parts.append((totals, shown))

    totals = reduce(DataFrame.unionByName, [t for t, _ in parts]).where("total > 0")
    w = Window.partitionBy(REC, "selected_id", "kind").orderBy(*ORD)
    shown = reduce(DataFrame.unionByName, [s for _, s in parts]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return totals, shown


def related_events(events: DataFrame, selected: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Events sharing the most specific id (tool call, request, agent) that has other events."""
    rows = correlated(events)
    selection = rows.join(selected.select(REC, "event_id"), [REC, "event_id"], "left_semi")
    order = {"tool_call_id": "tool_call", "request_id": "request_id", "agent_id": "agent"}
    parts = [_group(selection, rows, by, column, limit) for by, column in order.items()]
    level = F.lit(0)
    for i, by in enumerate(order, 1):
        level = F.when(F.col("kind") == by, i).otherwise(level)
    totals = reduce(DataFrame.unionByName, [t for t, _ in parts]).where("total > 0").withColumn("level", level)
    best = totals.groupBy(REC, "selected_id").agg(F.min_by("kind", "level").alias("kind"))
    shown = reduce(DataFrame.unionByName, [s for _, s in parts]).join(best, [REC, "selected_id", "kind"])
    w = Window.partitionBy(REC, "selected_id").orderBy(*ORD)
    return shown.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
