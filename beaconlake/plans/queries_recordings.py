"""Recording files as they come (manifests, line ends, packed and overlong ones), the gate for sensitive data, and readers of nested attributes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.operators import manifests
from beaconlake.plans import driver_tables as dt
from beaconlake.plans.queries_ingest import BASE, _by_folder, _line_rows
from beaconlake.plans.registry import ORACLES, query
from beaconlake.session import shared_folder
from beaconlake.sources import ndjson
from beaconlake.sources.report import SensitiveDataError, write_report

_MANIFEST = '{"format":"beacon.telemetry.recording/1","recording":"'


def _recordings(spark: SparkSession, d: str) -> str:
    """One file per recording: a manifest first; r3 has another one in the middle, odd ones end their lines with CR LF, and ``zip`` is a packed file."""
    rows = _line_rows(spark, d).select(F.concat(F.lit("r"), F.col("uid") % 8).alias("rec"), (F.col("uid") % 8).alias("r"), F.col("us").alias("place"), "value")
    heads = rows.select("rec", "r").distinct()
    first = heads.select("rec", "r", F.lit(-1).cast("bigint").alias("place"), F.concat(F.lit(_MANIFEST), "rec", F.lit('"}')).alias("value"))
    middle = heads.where("rec = 'r3'").select("rec", "r", F.lit(10**18).cast("bigint").alias("place"), F.concat(F.lit(_MANIFEST), F.lit('again"}')).alias("value"))
    packed = heads.where("rec = 'r1'").select(F.lit("zip").alias("rec"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("place"), F.lit("PK not text").alias("value"))
    ended = rows.unionByName(first).unionByName(middle).withColumn("value", F.concat("value", F.when(F.col("r") % 2 == 1, "\r").otherwise("")))
    path = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    ended.unionByName(packed).repartition("rec").sortWithinPartitions("rec", "place").select("rec", "value").write.partitionBy("rec").text(path)
    return path


@query(
    "src_recording",
    f"""{BASE} SELECT rec AS recording_id, 'event' AS kind, NULL AS reason, COUNT(*) AS n FROM good GROUP BY 1 UNION ALL SELECT 'r' || CAST(uid % 8 AS STRING), 'rejected', reason, COUNT(*) FROM j WHERE reason IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT DISTINCT 'r' || CAST(uid % 8 AS STRING), 'manifest', NULL, 1 FROM base UNION ALL SELECT DISTINCT 'r3', 'rejected', 'manifest record is only allowed on line 1', 1 FROM base WHERE uid % 8 = 3
 UNION ALL SELECT DISTINCT 'zip', 'rejected', 'packed recordings are not supported', 1 FROM base WHERE uid % 8 = 1""",
)
def src_recording(spark, d):
    """Whole recordings: events, the manifest on line 1, and what is refused with its reason."""
    got = ndjson.load_recording(spark, f"{_recordings(spark, d)}/*/*.txt", recording_id=_by_folder)
    none = F.lit(None).cast("string")
    parts = [got.events.select("recording_id", F.lit("event").alias("kind"), none.alias("reason")), got.manifests.select("recording_id", F.lit("manifest").alias("kind"), none.alias("reason")), got.rejected.select("recording_id", F.lit("rejected").alias("kind"), "reason")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("recording_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_limits",
    f"""{BASE}, l AS (SELECT *, CASE WHEN k % 5 = 0 AND k <> 88 THEN 'line is longer than 4000 characters' ELSE reason END AS why FROM j) SELECT 'r' || CAST(uid % 8 AS STRING) AS recording_id, why AS reason, COUNT(*) AS n FROM l GROUP BY 1, 2""",
)
def src_limits(spark, d):
    """A limit on the length of a line rejects longer lines and no others."""
    padded = F.when((F.col("k") % 5 == 0) & (F.col("k") != 99), F.concat(F.expr("left(value, length(value) - 1)"), F.lit(',"pad":"'), F.repeat(F.lit("x"), 5000), F.lit('"}'))).otherwise(F.col("value"))
    lines = _line_rows(spark, d).select(F.concat(F.lit("r"), F.col("uid") % 8).alias("recording_id"), F.lit("x").alias("path"), F.lit(2).cast("bigint").alias("line"), padded.alias("value"))
    got = ndjson.parse_lines(lines, max_chars=4000)
    rows = got.events.select("recording_id", F.lit(None).cast("string").alias("reason")).unionByName(got.rejected.select("recording_id", "reason"))
    return rows.groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("snk_gate_sensitive", f"SELECT recording_id, sensitive, bool_or(sensitive) OVER () AS refused, bool_or(sensitive) OVER () AS nothing_written FROM ({ORACLES['sensitivity']})")
def snk_gate_sensitive(spark, d):
    """A report of sensitive recordings is refused until it is acknowledged, and a refusal writes nothing."""
    events, when = dt.core_events(spark, d), {"from_ns": 300_000_000_000, "to_ns": 1_500_000_000_000}
    path, refused = f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}", False
    try:
        write_report(events, path, tables=("errors",), **when)
    except SensitiveDataError:
        refused = True
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    nothing = not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return manifests.sensitivity(events, **when).select("recording_id", "sensitive", F.lit(refused).alias("refused"), F.lit(nothing).alias("nothing_written"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Events whose attributes hold a ``sampling`` object and a ``candidates`` list."""
    base = spark.sql(dt.SPARK_BASE, events=spark.read.parquet(f"{d}/events.parquet"))
    value = F.concat(
        F.lit('{"schema":"beacon.telemetry.event/1","event_id":"e'), "id", F.lit('","sequence":'), "id", F.lit(',"event_type":"inference.sampling.candidates","wall_time":"2024-01-01T00:00:00Z","mono_ns":'), "us",
        F.lit(',"session_id":"s","producer":{"name":"p","version":"1","node_id":"n"},"attributes":{"sampling":'),
        F.when(F.col("k") % 7 == 0, F.lit('"none"')).otherwise(F.concat(
            F.lit('{"temperature":'), F.when(F.col("k") % 3 == 0, F.lit("null")).otherwise(F.col("k").cast("string")), F.lit(',"seed":'), F.when(F.col("k") % 2 == 0, F.lit("null")).otherwise(F.col("k").cast("string")),
            F.lit(',"num_ctx":'), (F.col("k") % 4).cast("string"), F.lit(',"stop":'), F.when(F.col("k") % 5 == 0, F.lit("null")).otherwise(F.lit('"end"')), F.lit(',"mirostat":true,"explicit_only":true,"nested":{"x":1}}'))),
        F.lit(',"candidates":[{"token_id":'), "k", F.lit(',"probability":0.25,"text":"a"},{"token_id":1.5,"probability":'), F.when(F.col("k") % 3 == 0, F.lit("0.5")).otherwise(F.lit("0.25")),
        F.lit('},{"token_id":"7","probability":"0.9"},7,{"token_id":9,"probability":1,"text":5}]}}'),
    )
    lines = base.select(F.lit("x").alias("recording_id"), F.lit("x").alias("path"), F.lit(2).cast("bigint").alias("line"), value.alias("value"))
    return ndjson.parse_lines(lines).events


_NESTED = f"WITH base AS ({dt.DUCK_BASE}), s AS (SELECT * FROM base WHERE k % 7 <> 0)"


@query(
    "sampler_settings",
    f"""{_NESTED} SELECT 'e' || id AS event_id, 'temperature' AS key, CASE WHEN k % 3 = 0 THEN 'model default' ELSE CAST(k AS STRING) END AS text, k % 3 = 0 AS model_default FROM s
 UNION ALL SELECT 'e' || id, 'seed', CASE WHEN k % 2 = 0 THEN 'unset (backend chooses)' ELSE CAST(k AS STRING) END, FALSE FROM s
 UNION ALL SELECT 'e' || id, 'num_ctx', CASE WHEN k % 4 = 0 THEN 'model default' ELSE CAST(k % 4 AS STRING) END, k % 4 = 0 FROM s
 UNION ALL SELECT 'e' || id, 'stop', CASE WHEN k % 5 = 0 THEN 'unset' ELSE 'end' END, FALSE FROM s UNION ALL SELECT 'e' || id, 'mirostat', 'true', FALSE FROM s""",
)
def sampler_settings(spark, d):
    ev = _nested(spark, d)
    return ev.select("event_id", F.explode(R.sampler_settings(Readers(ev))).alias("s")).select("event_id", "s.key", "s.text", "s.model_default")


@query(
    "read_alternatives",
    f"""WITH base AS ({dt.DUCK_BASE}), a AS (SELECT 'e' || id AS event_id, k, unnest([{{'i': 0, 't': CAST(k AS BIGINT), 'p': 0.25::DOUBLE, 'x': 'a'}}, {{'i': 1, 't': NULL, 'p': CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE, 'x': NULL}}, {{'i': 4, 't': 9, 'p': 1.0::DOUBLE, 'x': NULL}}]) AS c FROM base)
 SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY c.p DESC, c.i) AS BIGINT) AS rank, c.t AS token_id, c.p AS probability, CASE WHEN k % 2 = 0 THEN c.x END AS text FROM a""",
)
def read_alternatives(spark, d):
    """Candidates, most probable first; texts only where the capture allows them (here: even k)."""
    ev = _nested(spark, d)
    allowed = F.try_variant_get("attributes", "$.candidates[0].token_id", "bigint") % 2 == 0
    rows = ev.select("event_id", F.posexplode(R.read_alternatives(Readers(ev), allowed)).alias("pos", "c"))
    return rows.select("event_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "c.token_id", "c.probability", "c.text")
