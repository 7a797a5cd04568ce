"""Readings of one event: usage, token counts, reuse reports, scopes, text flags.

Each function takes the :class:`Readers` of the events and returns a Column.
Where an event gives no evidence the reading is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.dialect import DEFAULT, Dialect
from beaconlake.functions.attrs import Readers

# Sampler fields whose null means that the model default applies.
EXPLICIT_ONLY_FIELDS = (
    "temperature", "top_p", "top_k", "min_p", "repeat_penalty", "repeat_last_n", "presence_penalty", "frequency_penalty",
)
# Attribute names that carry prompt or output text, and tool payloads.
TEXT_KEYS = ("token_text", "prompt", "response", "completion", "messages")
TOOL_PAYLOAD_KEYS = ("args", "arguments", "input", "result", "output", "payload", "content")
FULL_TEXT_POLICIES = ("full", "on")
OUTCOMES = ("request.completed", "request.failed", "request.cancelled")

_t = "event_type"


def _is(*types: str) -> Column:
    return F.col(_t).isin(*types)


def filled(name: str) -> Column:
    """Envelope text, the empty one read as absent."""
    return F.nullif(F.col(name), F.lit(""))


def memory_usage(r: Readers) -> Column:
    """struct(used, total, fraction, source), or null."""
    total, used, free, share = (r.num(k) for k in ("total_bytes", "used_bytes", "available_bytes", "used_fraction"))
    taken = total - free

    def answer(u, t, f, source):
        return F.struct(u.alias("used"), t.alias("total"), f.alias("fraction"), F.lit(source).alias("source"))

    none = F.lit(None).cast("double")
    return (
        F.when((total > 0) & used.isNotNull(), answer(used, total, F.try_divide(used, total), "used_bytes"))
        .when((total > 0) & (free >= 0) & (free <= total), answer(taken, total, F.try_divide(taken, total), "available_bytes"))
        .when(share.isNotNull(), answer(none, none, share, "used_fraction"))
    )


def dropped_count(r: Readers) -> Column:
    n = r.num("dropped_count", "dropped_events")
    return F.when(n > 0, n)


def backend_token_count(r: Readers) -> Column:
    return F.when(r.flag("token_counts_from_backend"), r.count("completion_tokens"))


def output_token_count(r: Readers) -> Column:
    """Tokens of an output event; null when its unit is not a token (a chunk)."""
    n = r.whole("count")
    is_token = ~r.has("unit") | r.is_null_value("unit") | F.coalesce(r.text("unit") == "token", F.lit(False))
    return F.when(is_token, F.when(n > 0, n).otherwise(F.lit(1).cast("bigint")))


def backend_eval_ms(r: Readers) -> Column:
    n = r.num("backend_eval_ms")
    return F.when(_is("inference.decode.completed") & (n > 0), n)


def is_request_scoped_load() -> Column:
    return _is("model.load.completed") & filled("request_id").isNotNull()


def prompt_cache_report(r: Readers) -> Column:
    """struct(prompt, cached, evaluated, source): the first consistent spelling."""

    def answer(total, cached, fresh, source):
        return F.struct(total.alias("prompt"), cached.alias("cached"), fresh.alias("evaluated"), F.lit(source).alias("source"))

    out = None
    for cached_key, total_key in (("prompt_eval_cached_count", "prompt_eval_count"), ("backend_cached_tokens", "prompt_tokens")):
        cached, total = r.count(cached_key), r.count(total_key)
        branch = answer(total, cached, total - cached, cached_key)
        out = F.when(cached <= total, branch) if out is None else out.when(cached <= total, branch)
    cached, fresh = r.count("cache_n"), r.count("prompt_n")
    return out.when(cached.isNotNull() & fresh.isNotNull(), answer(fresh + cached, cached, fresh, "cache_n"))


def speculation_report(r: Readers) -> Column:
    """struct(drafted, accepted, source)."""
    out = None
    for drafted_key, accepted_key in (("backend_draft_tokens", "backend_draft_accepted_tokens"), ("draft_n", "draft_n_accepted")):
        drafted, accepted = r.count(drafted_key), r.count(accepted_key)
        branch = F.struct(drafted.alias("drafted"), accepted.alias("accepted"), F.lit(drafted_key).alias("source"))
        out = F.when(accepted <= drafted, branch) if out is None else out.when(accepted <= drafted, branch)
    return out


def turn_id(r: Readers) -> Column:
    return F.coalesce(r.loose_id("turn_id", "envelope"), r.loose_id("turn_id"), r.loose_id("turn"), r.loose_id("turn_index"))


def _not_negative(r: Readers, *keys: str) -> Column:
    return F.coalesce(*[F.when(r.num(k) >= 0, r.num(k)) for k in keys])


def prompt_tokens(r: Readers) -> Column:
    return _not_negative(r, "prompt_tokens", "prompt_eval_count")


def reported_completion_tokens(r: Readers) -> Column:
    return F.coalesce(backend_token_count(r).cast("double"), _not_negative(r, "completion_tokens", "generated_tokens"))


def reported_decode_rate(r: Readers) -> Column:
    n = r.num("decode_tokens_per_sec", "backend_tokens_per_sec")
    return F.when(_is("inference.decode.completed") & (n > 0), n)


def cost_usd(r: Readers) -> Column:
    return _not_negative(r, "cost_usd", "total_cost_usd")


def cost_budget_usd(r: Readers) -> Column:
    n = r.num("cost_budget_usd", "budget_usd")
    return F.when(n > 0, n)


def budget_pressure_fraction(r: Readers) -> Column:
    return F.when(_is("guard.budget_pressure"), _not_negative(r, "used_fraction", "fraction"))


def cache_lookup() -> Column:
    return F.when(_is("kv.reused"), "hit").when(_is("kv.allocated"), "miss")


def scope_key(r: Readers) -> Column:
    return F.coalesce(
        F.concat(F.lit("context:"), r.name("context_id")),
        F.concat(F.lit("request:"), filled("request_id")),
        F.concat(F.lit("agent:"), filled("agent_id")),
        F.concat(F.lit("session:"), F.col("session_id")),
    )


def actor_key() -> Column:
    return F.coalesce(
        F.concat(F.lit("agent:"), filled("agent_id")),
        F.concat(F.lit("request:"), filled("request_id")),
        F.concat(F.lit("session:"), F.col("session_id")),
    )


def cache_scope() -> Column:
    return F.coalesce(
        F.concat(F.lit("model:"), filled("model_instance_id")), F.concat(F.lit("device:"), filled("device_id")), F.lit("all")
    )


def task_key(r: Readers, keys: tuple[str, ...]) -> Column:
    return F.nullif(F.coalesce(r.name(*keys), F.col("task_id")), F.lit(""))


def _tool(r: Readers) -> Column:
    return F.coalesce(r.name("tool", "tool_name"), F.lit("?"))


def call_signature(r: Readers) -> Column:
    args = r.name("args")
    shown = F.when(~args.rlike(r"(?i)^\s*(\[?redacted\]?|\*+|<redacted>)\s*$"), args)
    return F.coalesce(
        F.concat(_tool(r), F.lit("|"), r.name("args_hash", "input_hash", "content_hash")),
        F.concat(_tool(r), F.lit("|args:"), shown),
    )


def output_signature(r: Readers) -> Column:
    return F.concat(_tool(r), F.lit("|"), r.name("output_hash", "result_hash"))


def severity_for(fraction: Column, warn: float, critical: float) -> Column:
    return F.when(fraction >= critical, "critical").when(fraction >= warn, "warning")


def is_runtime(role: Column, name: Column, dialect: Dialect = DEFAULT) -> Column:
    return (F.coalesce(role, F.lit("")) == "runtime") | (name == dialect.runtime_producer)


# Pipeline stages in order.
STAGES = ("route", "queue", "prefill", "layers", "decode", "output")


def stage_of_event(r: Readers, runtime: Column) -> Column:
    """struct(stage, moves): stage activity of an event and whether it moves its request."""
    t = F.col(_t)
    at = lambda name, moves: F.struct(F.lit(name).alias("stage"), F.lit(moves).alias("moves"))
    scheduled = F.coalesce(r.flag("scheduled"), F.lit(False))
    return (
        F.when(_is(*OUTCOMES), at("output", True))
        .when(t.startswith("route."), at("route", True))
        .when(runtime, F.when(_is("request.started"), at("route", True)))
        .when(t.startswith("backend.layer.") | t.startswith("backend.operator."), at("layers", False))
        .when(_is("request.queued", "scheduler.enqueued", "scheduler.preempted"), at("queue", True))
        .when(_is("request.started"), F.when(scheduled, at("queue", True)).otherwise(at("prefill", True)))
        .when(
            _is("scheduler.admitted", "scheduler.prefill.chunk", "scheduler.prefill.completed", "inference.prefill.started", "kv.allocated", "kv.reused"),
            at("prefill", True),
        )
        .when(_is("inference.prefill.completed"), at("prefill", False))
        .when(_is("inference.decode.started", "inference.token.generated"), at("decode", True))
        .when(_is("inference.decode.completed"), at("decode", False))
    )


def gpu_memory_sample(r: Readers) -> Column:
    """struct of the usable readings of a GPU memory sample, or null for other events."""

    reading = r.count  # whole number >= 0, exact as BIGINT
    status, samples = r.name("status"), reading("samples")
    usable = F.coalesce(status == "ok", F.lit(True)) & ~F.coalesce(samples == 0, F.lit(False))
    dedicated, shared = F.when(usable, reading("dedicated_bytes")), F.when(usable, reading("shared_bytes"))
    threshold, baseline = reading("spill_threshold_bytes"), reading("shared_baseline_bytes")
    assumed = F.when(r.has("shared_baseline_bytes"), baseline).otherwise(F.lit(0).cast("bigint"))
    limit = F.try_add(threshold, assumed)
    spilled = F.when(usable, F.coalesce(r.flag("spilled"), shared > limit))
    context = reading("fitted_ctx")
    return F.when(
        _is("backend.gpu_memory.sample"),
        F.struct(
            dedicated.alias("dedicated_bytes"), shared.alias("shared_bytes"), threshold.alias("spill_threshold_bytes"),
            baseline.alias("shared_baseline_bytes"), limit.alias("spill_limit_bytes"), spilled.alias("spilled"),
            F.when(context > 0, context).alias("fitted_ctx"), samples.alias("sample_count"), status.alias("status"),
        ),
    )


def carries_text(r: Readers, dialect: Dialect = DEFAULT) -> Column:
    """Prompt or output text is there; the documented chat message count is not text."""
    message_count = (
        (F.col("producer.name") == dialect.inference_producer) & _is("request.queued")
        & F.coalesce(r.text("kind") == "chat", F.lit(False)) & r.count("messages").isNotNull()
    )
    out = _is("inference.token.generated") & r.is_set("text")
    for key in TEXT_KEYS:
        present = r.is_set(key)
        out = out | (present & ~F.coalesce(message_count, F.lit(False)) if key == "messages" else present)
    return out


def has_tool_payload(r: Readers) -> Column:
    out = F.lit(False)
    for key in TOOL_PAYLOAD_KEYS:
        out = out | r.is_set(key)
    return F.col(_t).startswith("tool.") & out


def capture_allows_text(policy: Column) -> Column:
    parts = F.transform(F.split(policy, ","), lambda p: F.lower(F.trim(p)))
    return F.coalesce(F.arrays_overlap(parts, F.array(*[F.lit(p) for p in FULL_TEXT_POLICIES])), F.lit(False))


def _haystack(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))


def table_search_text() -> Column:
    return _haystack("event_type", "event_id", "request_id", "run_id", "agent_id", "producer.name")


def export_search_text() -> Column:
    return _haystack("event_type", "event_id", "request_id", "agent_id")


def sampler_settings(r: Readers) -> Column:
    """array<struct(key, text, model_default)> of a VARIANT ``sampling`` object, or null."""
    value, kind = r._lookup("sampling")
    if kind is not None:
        return F.lit(None).cast("array<struct<key:string,text:string,model_default:boolean>>")
    shape = F.schema_of_variant(value)
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def row(e):
        v = e["value"]
        is_null = v.isNull() | F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(False))
        default = (is_null & e["key"].isin(*EXPLICIT_ONLY_FIELDS)) | (
            (e["key"] == "num_ctx") & F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))
            & ~F.coalesce(F.schema_of_variant(v).isin("STRING", "BOOLEAN"), F.lit(False))
        )
        text = (
            F.when(default, "model default")
            .when(is_null & (e["key"] == "seed"), "unset (backend chooses)")
            .when(is_null, "unset")
            .otherwise(F.try_variant_get(v, "$", "string"))
        )
        nested = F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))
        return F.struct(e["key"].alias("key"), text.alias("text"), default.alias("model_default"), nested.alias("nested"))

    rows = F.filter(F.transform(fields, row), lambda x: (x["key"] != "explicit_only") & ~x["nested"])
    plain = F.transform(rows, lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text"), x["model_default"].alias("model_default")))
    return F.when(shape.startswith("OBJECT"), plain)


def read_alternatives(r: Readers, text_allowed: Column) -> Column:
    """array<struct(token_id, probability, text)>, most probable first; null when none is readable."""
    value, kind = r._lookup("candidates")
    if kind is None:
        items = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))

        def fields(i, v):
            def typed(key, names, cast):
                part = F.try_variant_get(v, f"$.{key}", "variant")
                shape = F.schema_of_variant(part)
                ok = shape.isin(*names) | (shape.startswith("DECIMAL") if cast != "string" else F.lit(False))
                return F.when(ok, F.try_variant_get(part, "$", cast))

            token = typed("token_id", ("BIGINT", "DOUBLE"), "double")
            whole = F.when(token == F.floor(token), F.try_variant_get(v, "$.token_id", "bigint"))
            return i, whole, typed("probability", ("BIGINT", "DOUBLE"), "double"), typed("text", ("STRING",), "string")

        rows = F.transform(items, lambda v, i: _alternative(*fields(i, v), text_allowed))
    elif kind.typeName() == "array":
        rows = F.transform(value, lambda v, i: _alternative(i, v["token_id"].cast("bigint"), v["probability"].cast("double"), v["text"], text_allowed))
    else:
        return F.lit(None).cast("array<struct<token_id:bigint,probability:double,text:string>>")
    kept = F.array_sort(F.filter(rows, lambda x: x["probability"].isNotNull()), lambda a, b: _by_probability(a, b))
    plain = F.transform(kept, lambda x: F.struct(x["token_id"].alias("token_id"), x["probability"].alias("probability"), x["text"].alias("text")))
    return F.when(F.size(plain) > 0, plain)


def _alternative(i, token, probability, text, allowed):
    return F.struct(i.alias("i"), token.alias("token_id"), probability.alias("probability"), F.when(allowed, text).alias("text"))


def _by_probability(a, b):
    return (
        F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1)
        .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    )
