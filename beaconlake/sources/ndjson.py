"""NDJSON recordings: lines in, valid events, rejected lines and manifests out.

A recording is a text file with one JSON object per line; its first line may be
a manifest. No line is dropped silently: what is not an event is a row of
``rejected`` with its line number, reason and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.dialect import DEFAULT, Dialect
from beaconlake.schema import ID_FIELDS, ORD, SAMPLING_LEVELS

# Blanks at the edges of a line, the byte-order mark and Unicode spaces included.
_BLANKS = " \t\r\n\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Parsed:
    events: DataFrame
    rejected: DataFrame
    manifests: DataFrame


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_lines(spark: SparkSession, path: str | list[str], recording_id: Callable[[Column], Column] = file_stem) -> DataFrame:
    """Lines with their 1-based number in the file.

    A large file is read by many tasks. Inside a block the ids given by the task
    count up by one, so a line's number is its offset in the block plus the lines of
    the blocks before it; only the short block table is joined, no line is shuffled.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    blocks = raw.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return raw.join(offsets, ["path", "block"]).select(recording_id(F.col("path")).alias("recording_id"), "path", (F.col("id") + F.col("shift")).alias("line"), "value")


# Parts of an event that are looked at. Their JSON type (``s_``), text (``t_``), whole number
# (``n_``), and for objects presence (``p_``) and "is an object" (``o_``) are computed once as
# columns; the checks and the envelope read those.
_TEXTS = ("schema", "event_id", "event_type", "wall_time", "session_id", *ID_FIELDS, "format", "producer.name", "producer.version", "producer.node_id",
          "producer.instance_id", "producer.role", "sampling.level")
_NUMBERS = ("sequence", "mono_ns")
_FLAGS = ("producer.synthetic", "sampling.sampled")
_OBJECTS = ("producer", "sampling", "attributes")


def _name(kind: str, path: str) -> str:
    return f"{kind}_{path.replace('.', '_')}"


def _shape(path: str) -> Column:
    return F.col(_name("s", path))


def _text(path: str) -> Column:
    return F.col(_name("t", path))


def _whole(path: str) -> Column:
    return F.col(_name("n", path))


def _present(path: str) -> Column:
    return F.col(_name("p", path)) if path in _OBJECTS else _shape(path).isNotNull()


def _is_object(path: str) -> Column:
    return F.col(_name("o", path))


def _members(parent: str) -> list[str]:
    """Members of the event (``parent`` empty) or of one of its objects that are looked at."""
    paths = (*_TEXTS, *_NUMBERS, *_FLAGS, *_OBJECTS)
    return list(dict.fromkeys(p.removeprefix(f"{parent}.") if parent else p for p in paths if (p.startswith(f"{parent}.") if parent else "." not in p)))


def _with_parts(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the shapes and typed values of the parts of ``v``.

    An object is walked once, into a struct of its members as variants: an absent member is null, a JSON null is not, and what is no object gives no struct.
    """
    walked = lambda value, parent: F.try_variant_get(value, "$", f"struct<{','.join(f'{m}:variant' for m in _members(parent))}>")
    whole = parsed.select("*", walked(F.col("v"), "").alias("_e"))
    parts = whole.select("*", walked(F.col("_e.producer"), "producer").alias("_producer"), walked(F.col("_e.sampling"), "sampling").alias("_sampling"))
    at = lambda path: F.col(f"_{path}") if "." in path else F.col(f"_e.{path}")
    shapes = [F.schema_of_variant(at(p)).alias(_name("s", p)) for p in (*_TEXTS, *_NUMBERS, *_FLAGS)]
    is_object = {"producer": F.col("_producer"), "sampling": F.col("_sampling"), "attributes": F.try_variant_get(at("attributes"), "$", "struct<_:variant>")}
    objects = [c for p, struct in is_object.items() for c in (at(p).isNotNull().alias(_name("p", p)), struct.isNotNull().alias(_name("o", p)))]
    typed = parts.select("*", F.col("_e").isNotNull().alias("o_top"), *shapes, *objects)
    texts = [F.when(_shape(p) == "STRING", F.try_variant_get(at(p), "$", "string")).alias(_name("t", p)) for p in _TEXTS]
    number = lambda p, kind: F.try_variant_get(at(p), "$", kind)
    numbers = [
        F.when(_shape(p) == "BIGINT", number(p, "bigint"))
        .when((_shape(p) == "DOUBLE") | _shape(p).startswith("DECIMAL"), F.when(number(p, "double") == F.floor(number(p, "double")), number(p, "bigint"))).alias(_name("n", p))
        for p in _NUMBERS
    ]
    flags = [F.when(_shape(p) == "BOOLEAN", number(p, "boolean")).alias(_name("b", p)) for p in _FLAGS]
    return typed.select("*", *texts, *numbers, *flags, at("attributes").alias("v_attributes")).drop("_e", "_producer", "_sampling")


def wall_timestamp(text: Column) -> Column:
    """RFC 3339 text as a timestamp; null when it is none."""
    return F.when(text.rlike(_DATE_TIME), F.try_to_timestamp(F.upper(text)))


def issues(dialect: Dialect = DEFAULT) -> Column:
    """All faults against the event envelope, as ``path: message``, from the columns of :func:`_with_parts`."""

    def issue(path: str, cond: Column, message: str) -> Column:
        return F.when(cond, F.lit(f"{path}: {message}" if path else message))

    def missing(path: str) -> Column:
        return ~_present(path)

    def checked(path: str, ok: Column, message: str) -> Column:
        return F.when(missing(path), f"{path}: is required").when(~F.coalesce(ok, F.lit(False)), f"{path}: {message}")

    def optional(path: str, ok: Column, message: str) -> Column:
        return issue(path, ~missing(path) & ~F.coalesce(ok, F.lit(False)), message)

    found = [checked("schema", _text("schema") == dialect.schema_id, f'must equal "{dialect.schema_id}"')]
    found += [checked(k, _text(k) != "", "must be a non-empty string") for k in ("event_id", "event_type", "session_id")]
    found += [checked(k, _whole(k) >= 0, "must be an integer >= 0") for k in ("sequence", "mono_ns")]
    found.append(checked("wall_time", wall_timestamp(_text("wall_time")).isNotNull(), "must be an RFC 3339 date-time string"))
    found += [optional(k, _shape(k).isin("STRING", "VOID"), "must be a string or null") for k in ID_FIELDS]
    found.append(checked("producer", _is_object("producer"), "must be an object"))
    has_producer = _is_object("producer")
    for k in ("name", "version", "node_id"):
        found.append(F.when(has_producer, checked(f"producer.{k}", _shape(f"producer.{k}") == "STRING", "must be a string")))
    for k, shape, name in (("instance_id", "STRING", "string"), ("role", "STRING", "string"), ("synthetic", "BOOLEAN", "boolean")):
        fault = optional(f"producer.{k}", _shape(f"producer.{k}").isin(shape, "VOID"), f"must be a {name} or null")
        if k == "instance_id":
            fault = F.coalesce(fault, issue(f"producer.{k}", _text(f"producer.{k}") == "", "must be a non-empty string"))
        found.append(F.when(has_producer, fault))
    found.append(optional("sampling", _is_object("sampling"), "must be an object"))
    has_sampling = _is_object("sampling")
    found.append(F.when(has_sampling, optional("sampling.level", _text("sampling.level").isin(*SAMPLING_LEVELS), f"must be one of {', '.join(SAMPLING_LEVELS)}")))
    found.append(F.when(has_sampling, optional("sampling.sampled", _shape("sampling.sampled") == "BOOLEAN", "must be a boolean")))
    found.append(checked("attributes", _is_object("attributes"), "must be an object"))
    return F.when(~F.col("o_top"), F.array(F.lit("event must be a JSON object"))).otherwise(F.array_compact(F.array(*found)))


def envelope_columns() -> list[Column]:
    """Envelope columns of a valid event."""
    producer = F.struct(
        *[_text(f"producer.{k}").alias(k) for k in ("name", "version", "node_id", "instance_id", "role")],
        F.col(_name("b", "producer.synthetic")).alias("synthetic"),
    )
    sampling = F.when(
        _present("sampling"),
        F.struct(_text("sampling.level").alias("level"), F.col(_name("b", "sampling.sampled")).alias("sampled")),
    )
    return [
        *[_text(k).alias(k) for k in ("schema", "event_id", "event_type", "wall_time", "session_id", *ID_FIELDS)],
        _whole("sequence").alias("sequence"), _whole("mono_ns").alias("mono_ns"), wall_timestamp(_text("wall_time")).alias("wall_ts"),
        producer.alias("producer"), sampling.alias("sampling"), F.col("v_attributes").alias("attributes"), F.col("v").alias("extra"),
    ]


def validate(lines: DataFrame, dialect: Dialect = DEFAULT, max_chars: int | None = None) -> DataFrame:
    """Lines with the parsed value ``v``, whether they are manifests, and the reason to reject them."""
    trimmed = lines.withColumn("raw", F.btrim("value", F.lit(_BLANKS))).where(F.col("raw") != "").drop("value")
    long = F.char_length("raw") > max_chars if max_chars else F.lit(False)
    parsed = trimmed.withColumn("too_long", long).withColumn("v", F.when(~F.col("too_long"), F.try_parse_json("raw")))
    record = (_text("format") == dialect.recording_format) & F.col("o_top")
    judged = _with_parts(parsed).withColumn("is_manifest", F.coalesce(record, F.lit(False)))
    reason = (
        F.when(F.col("too_long"), f"line is longer than {max_chars} characters")
        .when(F.col("v").isNull(), "invalid JSON")
        .when(F.col("is_manifest"), F.when(F.coalesce(F.col("line") != 1, F.lit(False)), "manifest record is only allowed on line 1"))
        .otherwise(F.nullif(F.array_join(issues(dialect), "; "), F.lit("")))
    )
    # The generator keeps filters on the verdict above it: pushed below, they would repeat every check.
    verdict = F.struct(reason.alias("reason"), F.col("is_manifest").alias("is_manifest"))
    once = judged.withColumn("verdict", F.explode(F.array(verdict))).drop("is_manifest")
    return once.select("*", "verdict.reason", "verdict.is_manifest").drop("verdict")


def split(judged: DataFrame) -> Parsed:
    """Events, rejected lines and manifests of the rows of :func:`validate`."""
    events = judged.where("reason IS NULL AND NOT is_manifest").select("recording_id", *envelope_columns(), "path", "line", "raw")
    rejected = judged.where("reason IS NOT NULL").select("recording_id", "path", "line", "reason", "raw")
    manifests = judged.where("reason IS NULL AND is_manifest").select("recording_id", "path", "line", F.col("v").alias("manifest"), "raw")
    return Parsed(events, rejected, manifests)


def parse_lines(lines: DataFrame, dialect: Dialect = DEFAULT, adapters: tuple[Callable[[DataFrame], DataFrame], ...] = (), max_chars: int | None = None) -> Parsed:
    """Parse, adapt and validate lines. Adapters map ``value`` rows before validation; fan-out is an explode."""
    for adapt in adapters:
        lines = adapt(lines)
    return split(validate(lines, dialect, max_chars))


def load_recording(
    spark: SparkSession, path: str | list[str], dialect: Dialect = DEFAULT, adapters: tuple[Callable[[DataFrame], DataFrame], ...] = (),
    max_chars: int | None = None, recording_id: Callable[[Column], Column] = file_stem,
) -> Parsed:
    """Recordings at a path. A packed (zip) container is refused as one rejected line."""
    lines = read_lines(spark, path, recording_id)
    # One row per packed file.
    packed = lines.where((F.col("line") == 1) & F.col("value").startswith("PK")).select("recording_id", "path").distinct()
    parsed = parse_lines(lines.join(packed.select("path"), "path", "left_anti"), dialect, adapters, max_chars)
    refused = packed.select("recording_id", "path", F.lit(1).cast("bigint").alias("line"), F.lit("packed recordings are not supported").alias("reason"), F.lit("").alias("raw"))
    return Parsed(parsed.events, parsed.rejected.unionByName(refused), parsed.manifests)


def event_lines(events: DataFrame, dialect: Dialect = DEFAULT) -> DataFrame:
    """One JSON line per event: the original text where it was kept, else the whole parsed object, else the envelope as JSON.

    An envelope without a schema id gets the dialect's, and one without attributes an empty object, so that every line is an event again.
    """
    hidden = {"recording_id", "path", "line", "wall_ts", "extra", "stream", "raw", "schema", "attributes"}
    schema = F.coalesce("schema", F.lit(dialect.schema_id)) if "schema" in events.columns else F.lit(dialect.schema_id)
    members = [schema.alias("schema"), *[F.col(c) for c in events.columns if c not in hidden]]
    bare = F.concat(F.expr("left(to_json(_envelope), length(to_json(_envelope)) - 1)"), F.lit(',"attributes":'), F.coalesce(F.to_json("attributes"), F.lit("{}")), F.lit("}"))
    kept = [F.col("raw")] * ("raw" in events.columns) + [F.to_json("extra")] * ("extra" in events.columns)
    return events.withColumn("_envelope", F.struct(*members)).withColumn("value", F.coalesce(*kept, bare)).drop("_envelope")


def write_ndjson(events: DataFrame, path: str, mode: str = "errorifexists", dialect: Dialect = DEFAULT) -> None:
    """Events as JSON lines in replay order, one folder per recording, ranged by time."""
    lines = event_lines(events, dialect).repartitionByRange("recording_id", *ORD).sortWithinPartitions("recording_id", *ORD)
    lines.select("recording_id", "value").write.mode(mode).partitionBy("recording_id").text(path)


def write_recording(events: DataFrame, path: str, acknowledge_sensitive: bool = False, dialect: Dialect = DEFAULT, mode: str = "errorifexists", **selection) -> None:
    """Selected events unmodified under ``events`` and their manifest tables beside them."""
    from beaconlake.operators import manifests
    from beaconlake.operators.replay import filter_range
    from beaconlake.sources.report import require_acknowledged

    require_acknowledged(events, acknowledge_sensitive, dialect, **selection)
    chosen = filter_range(events, **selection)
    write_ndjson(chosen, f"{path}/events", mode, dialect)
    facts = manifests.manifest(chosen).withColumn("format", F.lit(dialect.recording_format))
    facts.write.mode(mode).partitionBy("recording_id").json(f"{path}/manifest")
    manifests.manifest_members(chosen).write.mode(mode).partitionBy("recording_id").json(f"{path}/manifest_members")
    manifests.producers(chosen).write.mode(mode).partitionBy("recording_id").json(f"{path}/manifest_producers")
