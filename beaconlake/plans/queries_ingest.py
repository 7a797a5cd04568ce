"""Ingest: table rows as JSON lines (some of them faulty), parsed in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.operators import metrics, replay
from beaconlake.operators.spans import request_spans
from beaconlake.plans import driver_tables as dt
from beaconlake.plans.queries_core import _latency_sql
from beaconlake.plans.registry import query, r6
from beaconlake.session import shared_folder, stored
from beaconlake.sources import ndjson
from beaconlake.sources.table import read_events, write_events
from beaconlake.streaming import live, retention

# One JSON line per table row; k decides which fault it has. Every user is a producer instance and reuses one request id.
_LINES = """SELECT id, uid, us, k, CASE WHEN k = 88 THEN '{bad' WHEN k = 99 THEN '   ' ELSE concat(
 '{"schema":"', CASE WHEN k % 20 = 1 THEN 'other/1' ELSE 'beacon.telemetry.event/1' END, '","event_id":"u', uid, '-', id, '","sequence":', CASE WHEN k % 20 = 2 THEN -1 ELSE id END,
 ',"event_type":"', CASE WHEN k % 20 = 7 THEN '' ELSE CASE et WHEN 'signup' THEN 'request.started' WHEN 'purchase' THEN 'request.completed' WHEN 'click' THEN 'inference.token.generated' WHEN 'error' THEN 'telemetry.dropped' ELSE 'kv.reused' END END,
 '","wall_time":"', CASE WHEN k % 20 = 3 THEN 'yesterday' ELSE date_format(timestampadd(MICROSECOND, us, timestamp_ntz'2024-01-01 00:00:00'), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END,
 '","mono_ns":', CASE WHEN k % 20 = 7 THEN '"5"' ELSE CAST(us AS STRING) END, ',"session_id":"s', uid, '","request_id":', CASE WHEN k % 20 = 4 THEN '7' ELSE concat('"r', uid, '"') END,
 ',"producer":{"name":"p', uid % 4, '","version":"1"', CASE WHEN k % 20 = 5 THEN '' ELSE ',"node_id":"n"' END, '},"attributes":', CASE WHEN k % 20 = 6 THEN '[1]' ELSE concat('{"value":', v, ',"k":', k,
  CASE WHEN k % 3 = 0 THEN concat(',"count":', k % 5) WHEN k % 3 = 1 THEN concat(',"count":"', k, '"') ELSE '' END, CASE WHEN k % 4 = 0 THEN ',"unit":"chunk"' WHEN k % 4 = 1 THEN ',"unit":null' ELSE '' END,
  ',"dropped_count":', CASE WHEN k % 2 = 0 THEN concat(k, '.0') ELSE '"9"' END, '}') END, '}') END AS value FROM {base}"""
_REASON = """CASE WHEN k = 88 THEN 'invalid JSON' WHEN k % 20 = 1 THEN 'schema: must equal "beacon.telemetry.event/1"' WHEN k % 20 = 2 THEN 'sequence: must be an integer >= 0' WHEN k % 20 = 3 THEN 'wall_time: must be an RFC 3339 date-time string'
 WHEN k % 20 = 4 THEN 'request_id: must be a string or null' WHEN k % 20 = 5 THEN 'producer.node_id: is required' WHEN k % 20 = 6 THEN 'attributes: must be an object' WHEN k % 20 = 7 THEN 'event_type: must be a non-empty string; mono_ns: must be an integer >= 0' END"""
BASE = f"WITH base AS ({dt.DUCK_BASE}), j AS (SELECT *, {_REASON} AS reason FROM base WHERE k <> 99), good AS (SELECT *, 'r' || CAST(uid % 8 AS STRING) AS rec, 'u' || CAST(uid AS STRING) || '-' || CAST(id AS STRING) AS event_id FROM j WHERE reason IS NULL)"
# Token count: an integral count above 0, else 1; a chunk carries none.
_N = "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 AND k % 5 > 0 THEN k % 5 ELSE 1 END"


def _line_rows(spark: SparkSession, d: str) -> DataFrame:
    base = spark.sql(dt.SPARK_BASE, events=spark.read.parquet(f"{d}/events.parquet"))
    text = _LINES.replace("{", "{{").replace("}", "}}").replace("{{base}}", "{base}")
    return spark.sql(text, base=base)


_WRITTEN: dict[tuple[str, str], str] = {}


def line_folder(spark: SparkSession, d: str) -> str:
    """The lines as text files, one folder per recording, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        rows = _line_rows(spark, d).select(F.concat(F.lit("r"), F.col("uid") % 8).alias("rec"), "us", "value")
        rows.repartitionByRange("rec", "us").sortWithinPartitions("rec", "us").select("rec", "value").write.partitionBy("rec").text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _by_folder(path):
    return F.regexp_extract(path, "/rec=([^/]+)/", 1)


def _loaded(spark, d):
    return ndjson.load_recording(spark, f"{line_folder(spark, d)}/*/*.txt", recording_id=_by_folder)


_TABLES: dict[tuple[str, str], str] = {}


def _ingested(spark, d):
    """The parsed events as the table they are stored in, so that derivations do not parse the text again."""
    events = _loaded(spark, d).events.drop("extra", "raw")
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        path = f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
        write_events(events, path)
        _TABLES[key] = path
    return read_events(spark, _TABLES[key], events.schema)


@query("validate_envelope", f"{BASE} SELECT id, reason FROM j")
def validate_envelope(spark, d):
    lines = _line_rows(spark, d).select("id", F.lit("x").alias("recording_id"), F.lit("x").alias("path"), F.lit(2).cast("bigint").alias("line"), "value")
    return ndjson.validate(lines).select("id", "reason")


@query("src_ndjson", f"{BASE} SELECT rec AS recording_id, event_id, CAST(id AS BIGINT) AS sequence, us AS mono_ns, 's' || CAST(uid AS STRING) AS session_id, 'p' || CAST(uid % 4 AS STRING) AS producer, ROUND(v, 6) AS value FROM good")
def src_ndjson(spark, d):
    ev = _loaded(spark, d).events
    return ev.select("recording_id", "event_id", "sequence", "mono_ns", "session_id", F.col("producer.name").alias("producer"), r6(Readers(ev).num("value"), "value"))


@query("src_rejected", f"{BASE} SELECT 'r' || CAST(uid % 8 AS STRING) AS recording_id, reason, COUNT(*) AS lines FROM j WHERE reason IS NOT NULL GROUP BY 1, 2")
def src_rejected(spark, d):
    return _loaded(spark, d).rejected.groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("lines"))


@query("src_line_numbers", f"{BASE} SELECT COUNT(*) AS lines, COUNT(*) AS distinct_places FROM base")
def src_line_numbers(spark, d):
    """Every line, the blank ones too, has its own place in its file."""
    lines = ndjson.read_lines(spark, f"{line_folder(spark, d)}/*/*.txt")
    per_file = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"), F.count_distinct("line").alias("places"))
    return per_file.agg(F.sum("n").alias("lines"), F.sum(F.when((F.col("lo") == 1) & (F.col("hi") == F.col("n")), F.col("places"))).alias("distinct_places"))


@query("variant_readers", f"{BASE} SELECT event_id, CAST({_N} AS BIGINT) AS output_tokens, CASE WHEN k % 2 = 0 AND k > 0 THEN CAST(k AS DOUBLE) END AS dropped, CASE WHEN k % 3 = 0 THEN CAST(k % 5 AS DOUBLE) END AS count_number, CASE WHEN k % 3 = 1 THEN CAST(k AS STRING) END AS count_text FROM good")
def variant_readers(spark, d):
    ev = _ingested(spark, d)
    r = Readers(ev)
    return ev.select("event_id", R.output_token_count(r).alias("output_tokens"), R.dropped_count(r).alias("dropped"), r.num("count").alias("count_number"), r.text("count").alias("count_text"))


def _upper_types(lines):
    """Adapter: skip cache events and say everything else twice."""
    kept = lines.where(~F.contains("value", F.lit('"kv.reused"')))
    return kept.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")


@query("adapt_events", f"{BASE} SELECT event_id, CAST(2 AS BIGINT) AS copies FROM good WHERE et <> 'view'")
def adapt_events(spark, d):
    lines = ndjson.read_lines(spark, f"{line_folder(spark, d)}/*/*.txt", _by_folder)
    return ndjson.parse_lines(lines, adapters=(_upper_types,)).events.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


# Spans of one request id per user: the last start, and what follows it.
_SP = f"""{BASE}, n AS (SELECT *, {_N} AS n, SUM(CASE WHEN et = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY us) AS inst, SUM(CASE WHEN et = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY uid) AS top FROM good),
 spans AS (SELECT rec AS recording_id, CAST(to_json(['stream-instance', 'p' || CAST(uid % 4 AS STRING), 'n', 'u' || CAST(uid AS STRING)]) AS STRING) AS stream, 'r' || CAST(uid AS STRING) AS request_id, MIN(us) AS start_ns, MIN(us) FILTER (et = 'purchase') AS end_ns,
  CASE WHEN COUNT(*) FILTER (et = 'purchase') > 0 THEN 'completed' ELSE 'open' END AS outcome, MIN(us) FILTER (et = 'click') AS first_token_ns, CAST(COALESCE(SUM(n) FILTER (et = 'click'), 0) AS BIGINT) AS tokens, COUNT(*) FILTER (et = 'click' AND n IS NULL) AS chunks FROM n WHERE inst = top AND top > 0 GROUP BY rec, uid)"""
_SPAN_COLS = ("recording_id", "stream", "request_id", "start_ns", "end_ns", "outcome", "first_token_ns", "tokens", "chunks")


@query("recording_to_spans", f"{_SP} SELECT * FROM spans")
def recording_to_spans(spark, d):
    """Text lines to spans: parse, validate, dedupe, derive."""
    ev = _ingested(spark, d).drop("sampling", "wall_ts", "wall_time", "schema")
    return request_spans(replay.dedupe_events(ev, ("path", "line"))).select(*_SPAN_COLS)


@query("recording_to_latency", f"{_SP}{_latency_sql('spans', 'recording_id', '(end_ns - start_ns)')}")
def recording_to_latency(spark, d):
    # The ranks read the spans several times; planned with them each time, the spans would fill the driver.
    spans = stored(request_spans(_ingested(spark, d)).select("recording_id", "start_ns", "end_ns"), "spans")
    out = metrics.latency_stats(spans)
    return out.select("recording_id", "count", r6("p50_ms"), r6("p95_ms"), r6("max_ms"))


# -- sinks --------------------------------------------------------------------


@query("snk_ndjson", f"{BASE} SELECT rec AS recording_id, event_id, us AS mono_ns FROM good")
def snk_ndjson(spark, d):
    """Written lines read back."""
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    ndjson.write_ndjson(_loaded(spark, d).events, path)
    back = ndjson.load_recording(spark, f"{path}/*/*.txt", recording_id=lambda p: F.regexp_extract(p, "/recording_id=([^/]+)/", 1))
    return back.events.select("recording_id", "event_id", "mono_ns")


@query("snk_round_trip", f"{dt.duck_with('core')} SELECT recording_id, event_id, event_type, mono_ns, request_id FROM ev")
def snk_round_trip(spark, d):
    """Events that never had a line (a mapped table), written as lines and read back: all of them are events again."""
    path = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"
    ndjson.write_ndjson(dt.core_events(spark, d), path)
    back = ndjson.load_recording(spark, f"{path}/*/*.txt", recording_id=lambda p: F.regexp_extract(p, "/recording_id=([^/]+)/", 1))
    return back.events.select("recording_id", "event_id", "event_type", "mono_ns", "request_id")


@query("snk_recording",f"{BASE} SELECT rec AS recording_id, COUNT(*) AS event_count FROM good WHERE us BETWEEN 500000000000 AND 2000000000000 GROUP BY 1")
def snk_recording(spark, d):
    path = f"{shared_folder(spark)}/rec-{uuid.uuid4().hex}"
    ndjson.write_recording(_ingested(spark, d), path, from_ns=500_000_000_000, to_ns=2_000_000_000_000)
    return spark.read.json(f"{path}/manifest").select("recording_id", "event_count")


@query("snk_report_tables", f"{dt.duck_with('core')} SELECT recording_id, event_type, COUNT(*) AS errors FROM ev WHERE event_type LIKE '%.failed' OR event_type LIKE '%.error' OR event_type IN ('retry.scheduled', 'recovery.action') OR event_type LIKE 'guard.%' GROUP BY 1, 2")
def snk_report_tables(spark, d):
    from beaconlake.sources.report import write_report

    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_report(dt.core_events(spark, d), path, acknowledge_sensitive=True, tables=("errors", "timeline"))
    return spark.read.parquet(f"{path}/errors").select("recording_id", "event_type", "errors")


# -- streams ------------------------------------------------------------------


def run_stream(df: DataFrame, mode: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Run a stream over the files present and return what it wrote; with ``keep`` the latest row of each key."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if keep is None:
        return out.drop("batch")
    row = F.struct(*[c for c in df.columns])
    return out.groupBy(*keep).agg(F.max_by(row, "batch").alias("r")).select("r.*")


def _stream(spark, d, files=100, folder=None):
    raw = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files).text(f"{folder or line_folder(spark, d)}/*/*.txt")
    source = F.col("_metadata.file_path")
    lines = raw.select(_by_folder(source).alias("recording_id"), source.alias("path"), F.lit(None).cast("bigint").alias("line"), "value")
    return lines


@query("stream_ingest", f"{BASE} SELECT rec AS recording_id, event_id, us AS mono_ns FROM good")
def stream_ingest(spark, d):
    return run_stream(live.stream_ingest(_stream(spark, d, 3)).events.select("recording_id", "event_id", "mono_ns"), "append")


@query("stream_quarantine", f"{BASE} SELECT 'r' || CAST(uid % 8 AS STRING) AS recording_id, reason, COUNT(*) AS lines FROM j WHERE reason IS NOT NULL GROUP BY 1, 2")
def stream_quarantine(spark, d):
    path = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    live.write_live(_stream(spark, d, 4), path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rejected").groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("lines"))


# Deliveries of the live checks: four batches by id, and a third of the events again in the next batch.
_LATE_DAYS = 10
_DELIVERED = f"""{BASE}, dl AS (SELECT *, id % 4 AS b, FALSE AS again FROM good UNION ALL SELECT *, id % 4 + 1, TRUE FROM good WHERE id % 3 = 0 AND id % 4 < 3),
 tops AS (SELECT b, MAX(us) AS m FROM dl GROUP BY b), cut AS (SELECT x.b, MAX(y.m) AS newest FROM tops x LEFT JOIN tops y ON y.b < x.b GROUP BY x.b),
 st AS (SELECT dl.*, COALESCE(us < newest - CAST({{days}} AS BIGINT) * 86400000000, FALSE) AS late FROM dl JOIN cut USING (b)), held AS (SELECT * FROM st WHERE NOT late AND NOT again)"""
_HELD = _DELIVERED.replace("{days}", str(_LATE_DAYS))


def _land(spark: SparkSession, d: str, late_after: str, keep: str | None = None) -> str:
    """Folder of a stream that landed in four runs, each of one micro-batch."""
    path = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = _line_rows(spark, d).withColumn("rec", F.concat(F.lit("r"), F.col("uid") % 8))
    for number in range(4):
        again = (F.col("id") % 3 == 0) & (F.col("id") % 4 == number - 1)
        part = rows.where((F.col("id") % 4 == number) | again)
        part.select("rec", "value").repartition(3, F.xxhash64("value")).write.mode("append").partitionBy("rec").text(f"{path}/in")
        live.write_live(_stream(spark, d, 100_000, f"{path}/in"), path, f"{path}/checkpoint", late_after, keep=keep).awaitTermination()
    return path


_LANDED_AT: dict[tuple[str, str], str] = {}


def _landed(spark: SparkSession, d: str) -> str:
    key = (spark.sparkContext.applicationId, d)
    if key not in _LANDED_AT:
        _LANDED_AT[key] = _land(spark, d, f"{_LATE_DAYS} days")
    return _LANDED_AT[key]


def _over_batches(spark: SparkSession, d: str, operator, mode: str, keep: tuple[str, ...]) -> DataFrame:
    """Latest rows per key of a streaming operator that meets the landed batches one run after the other, with a watermark that moves in between."""
    landed, path = _landed(spark, d), f"{shared_folder(spark)}/over-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{landed}/events")
    schema = None
    for number in range(4):
        events.where(F.col("batch") == number).write.mode("append").partitionBy("day", "batch").parquet(f"{path}/events")
        out = operator(live.read_landed(spark, path))
        schema = out.schema

        def land(batch: DataFrame, step: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={step}")

        out.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.groupBy(*keep).agg(F.max_by(F.struct(*schema.names), "batch").alias("r")).select("r.*")


_DELAY = f"{_LATE_DAYS * 86_400 + 1} seconds"


@query("stream_late", f"{_HELD} SELECT rec AS recording_id, b AS batch, late, COUNT(*) AS events FROM st WHERE late OR NOT again GROUP BY 1, 2, 3")
def stream_late(spark, d):
    """Held and late rows of every batch, apart."""
    rows = [spark.read.parquet(f"{_landed(spark, d)}/{name}").select("recording_id", "batch", F.lit(name == "late").alias("late")) for name in ("events", "late")]
    return rows[0].unionByName(rows[1]).groupBy("recording_id", F.col("batch").cast("bigint").alias("batch"), "late").agg(F.count(F.lit(1)).alias("events"))


@query("src_live", f"{_HELD} SELECT b AS batch, MAX(us) AS newest_us, COUNT(*) FILTER (NOT late AND NOT again) AS held, COUNT(*) FILTER (late) AS late, COUNT(*) FILTER (NOT late AND again) AS repeated FROM st GROUP BY 1")
def src_live(spark, d):
    """What landing did with every row of a batch: held, late or a repeat of a held event."""
    since = F.unix_micros("newest") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return spark.read.parquet(f"{_landed(spark, d)}/progress").select(F.col("batch").cast("bigint").alias("batch"), since.alias("newest_us"), "held", "late", "repeated")


@query("stream_retention", f"""{_DELIVERED.replace("{days}", "12")}, c AS (SELECT MAX(us) - CAST(12 AS BIGINT) * 86400000000 AS cut FROM st)
 SELECT rec AS recording_id, COUNT(*) FILTER (us >= cut) AS kept, COUNT(*) FILTER (us < cut) AS expired, COUNT(DISTINCT CASE WHEN us >= cut THEN us // 86400000000 END) AS days FROM held, c GROUP BY 1""")
def stream_retention(spark, d):
    """Events older than twelve days leave after each batch: kept and expired ones together are all that were held."""
    path = _land(spark, d, "12 days", "12 days")
    kept = spark.read.parquet(f"{path}/events").select("recording_id", "day", F.lit(1).alias("kept"), F.lit(0).alias("expired"))
    left = retention.expired(spark, path).select("recording_id", F.lit(None).cast("date").alias("day"), F.lit(0).alias("kept"), F.col("events").alias("expired"))
    return kept.unionByName(left).groupBy("recording_id").agg(F.sum("kept").alias("kept"), F.sum("expired").alias("expired"), F.count_distinct("day").alias("days"))


@query("stream_dedupe", f"{_HELD} SELECT DISTINCT rec AS recording_id, event_id FROM st WHERE NOT late")
def stream_dedupe(spark, d):
    """Events that come again in the next batch, and rows behind the watermark: every event inside it once."""
    path = f"{shared_folder(spark)}/dedupe-{uuid.uuid4().hex}"
    rows, out = _line_rows(spark, d).withColumn("rec", F.concat(F.lit("r"), F.col("uid") % 8)), []
    for number in range(4):
        again = (F.col("id") % 3 == 0) & (F.col("id") % 4 == number - 1)
        rows.where((F.col("id") % 4 == number) | again).select("rec", "value").write.mode("append").partitionBy("rec").text(f"{path}/in")
        once = live.stream_dedupe(live.stream_ingest(_stream(spark, d, 100_000, f"{path}/in")).events, f"{_LATE_DAYS} days").select("recording_id", "event_id")

        def land(batch: DataFrame, step: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={step}")

        once.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("recording_id string, event_id string").parquet(f"{path}/rows").select("recording_id", "event_id")


@query("stream_gaps", f"""{_HELD}, g AS (SELECT rec, uid, id, LAG(id) OVER (PARTITION BY uid ORDER BY id) AS p FROM held)
 SELECT rec AS recording_id, CAST(to_json(['stream-instance', 'p' || CAST(uid % 4 AS STRING), 'n', 'u' || CAST(uid AS STRING)]) AS STRING) AS stream, p + 1 AS from_seq, id - 1 AS to_seq FROM g WHERE id > p + 1""")
def stream_gaps(spark, d):
    return live.gap_ranges(_over_batches(spark, d, live.stream_gaps, "update", ("recording_id", "stream", "page")))


@query("stream_spans", f"{_HELD}{_SP.removeprefix(BASE).replace('FROM good', 'FROM held')} SELECT * FROM spans")
def stream_spans(spark, d):
    """Starts, tokens and ends of a request in any order over four batches, folded as the watermark passes them."""
    spans = _over_batches(spark, d, lambda ev: live.stream_spans(ev, 90 * 86_400_000, _DELAY), "update", ("recording_id", "stream", "request_id"))
    return spans.where("start_ns IS NOT NULL").select(*_SPAN_COLS)


@query("stream_drops", f"""{BASE}, r AS (SELECT rec, uid, us, k FROM good WHERE et = 'error' AND k % 2 = 0 AND k > 0)
 SELECT rec AS recording_id, CAST(to_json(['stream-instance', 'p' || CAST(uid % 4 AS STRING), 'n', 'u' || CAST(uid AS STRING)]) AS STRING) AS stream, CAST(arg_max(k, us) AS DOUBLE) AS dropped FROM r GROUP BY rec, uid""")
def stream_drops(spark, d):
    return run_stream(live.stream_drops(live.stream_ingest(_stream(spark, d, 3)).events), "update", ("recording_id", "stream"))


@query("stream_timeline", f"""{_HELD} SELECT rec AS recording_id, CAST(floor(us / 86400000000.0::DOUBLE) AS BIGINT) AS day, CASE et WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'request' WHEN 'click' THEN 'inference' WHEN 'error' THEN 'telemetry' ELSE 'resource' END AS cls, COUNT(*) AS events
 FROM held GROUP BY 1, 2, 3""")
def stream_timeline(spark, d):
    out = _over_batches(spark, d, lambda ev: live.stream_timeline(ev, "1 day", _DELAY), "update", ("recording_id", "window", "cls"))
    day = F.datediff(F.col("window.start"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return out.select("recording_id", day.alias("day"), "cls", "events")


@query("stream_windows", f"""{_HELD}, t AS (SELECT rec, us, {_N} AS n FROM held WHERE et = 'click'), w AS (SELECT rec, CAST(floor(us / 43200000000.0::DOUBLE) AS BIGINT) - o AS h, n FROM t, (SELECT unnest([0, 1]) AS o) WHERE TRUE)
 SELECT rec AS recording_id, h AS half_day, CAST(SUM(n) AS BIGINT) AS tokens FROM w GROUP BY 1, 2""")
def stream_windows(spark, d):
    out = _over_batches(spark, d, lambda ev: live.stream_windows(ev, "24 hours", "12 hours", _DELAY), "update", ("recording_id", "window"))
    start = F.col("window.start").cast("timestamp")
    half = F.floor((F.unix_seconds(start) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 43_200).cast("bigint")
    return out.select("recording_id", half.alias("half_day"), "tokens")
