"""Row shaping: conversations, statuses, training columns, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_conversation(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def media_parts(content: Column, marks: list[str]) -> Column:
    """Typed parts of a text with media marks, media numbered in order."""
    pattern = "(?<=X)|(?=X)".replace("X", "(?:" + "|".join(marks) + ")")
    parts = F.filter(F.split(content, pattern), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p.isin(marks), F.regexp_replace(p, "[<>]", "")).otherwise("text").alias("type"), F.when(~p.isin(marks), p).alias("text")))


def count_media(content: Column, marks: list[str], n: Column) -> Column:
    """The number of marks; an error if it differs from the number of media."""
    found = F.size(F.regexp_extract_all(content, F.lit("(" + "|".join(marks) + ")"), F.lit(1)))
    return F.when(found == n, found).otherwise(F.raise_error(F.lit("media don't match their marks")).cast("int"))


def chat_text(messages: Column, open_turn: bool = True) -> Column:
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if open_turn else body


def status_of(finish_reason: Column) -> Column:
    return F.when(finish_reason == "length", "truncated").when(finish_reason == "abort", "aborted").when(finish_reason == "stop", "completed")


def training_columns(df: DataFrame, length: str = "response_length", removed: str = "remove_sample", status: str = "status") -> DataFrame:
    """truncated flag and loss mask: ones by default, zeros for removed samples; a mask of the wrong length is an error."""
    n = F.col(length).cast("int")
    own = F.col("loss_mask") if "loss_mask" in df.columns else F.array_repeat(F.lit(1), n)
    checked = F.when(F.size(own) == n, own).otherwise(F.raise_error(F.lit("mask and response differ in length")).cast("array<int>"))
    return df.withColumns({"truncated": (F.col(status) == "truncated").cast("int"), "loss_mask": F.when(F.col(removed), F.array_repeat(F.lit(0), n)).otherwise(checked)})


def partial_rollout_mask(old: Column, new: Column) -> Column:
    """Tokens of the earlier attempt 0, of the resumed one 1."""
    return F.concat(F.array_repeat(F.lit(0), old.cast("int")), F.array_repeat(F.lit(1), new.cast("int")))


def eval_metadata(own: Column, rm_type: Column, overrides: Column) -> Column:
    """Metadata of an evaluation sample: its own, then the reward type, then the overrides, later ones winning."""
    with_type = F.when(rm_type.isNotNull(), F.map_concat(F.map_filter(own, lambda k, v: k != "rm_type"), F.create_map(F.lit("rm_type"), rm_type))).otherwise(own)
    return F.map_concat(F.map_filter(with_type, lambda k, v: ~F.map_contains_key(overrides, k)), overrides)


def present(attrs: Column, keys: list[str]) -> Column:
    """The listed attributes that have a value."""
    return F.map_filter(attrs, lambda k, v: v.isNotNull() & k.isin(keys))


def source_of(metadata: Column, keys: list[str]) -> Column:
    """The first listed key that has a value, else any key that names a source (the least)."""
    listed = [metadata[k] for k in keys]
    other = F.array_sort(F.map_keys(F.map_filter(metadata, lambda k, v: F.lower(k).contains("source") & v.isNotNull())))
    return F.coalesce(*listed, F.element_at(metadata, F.try_element_at(other, F.lit(1))))


def rollout_step(rollout: Column, per_step: int, batch: int, global_batch: int) -> Column:
    """Training step of a rollout: samples seen so far by the global batch."""
    return F.call_function("div", rollout.cast("bigint") * F.lit(per_step * batch), F.lit(global_batch))


def periodic(rollout: Column, interval: int | None, per_epoch: int | None, total: int | None) -> Column:
    """Every ``interval`` rollouts, at the end of each epoch, and at the last rollout; never without an interval."""
    if interval is None:
        return F.lit(False)
    n = rollout + 1
    out = F.pmod(n, F.lit(interval)) == 0
    if per_epoch:
        out = out | (F.pmod(n, F.lit(per_epoch)) == 0)
    if total:
        out = out | (rollout == total - 1)
    return out


def retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def coverage(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total, 2)).otherwise(0.0)


def coverage_keep(coverage_value: Column, correct: Column, removed: Column, u: Column, threshold: float = 0.3, factor: float | None = 0.1) -> Column:
    """Whether rejection sampling keeps a row: correct ones with probability (coverage - threshold) / factor, others always."""
    if factor:
        p = F.least(F.greatest((coverage_value - threshold) / factor, F.lit(0.0)), F.lit(1.0))
    else:
        p = (coverage_value >= threshold).cast("double")
    return F.when(removed, False).when(correct, u <= p).otherwise(True)


def prefixed(metric: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), metric)


def record(df: DataFrame, keys: list[str], overflow: str = "extra") -> DataFrame:
    """Known columns as they are, all others as JSON in one overflow column."""
    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*others)).alias(overflow) if others else F.lit("{}").alias(overflow))


def normalised_payload(payload: Column, model: str | None, default_model: str, stream: str = "inherit") -> Column:
    """A request's JSON fields (a string map) before replay: a forced model, or a default where none is named; ``stream`` is inherit, true or
    false, and without streaming its options go."""
    named = F.when(F.trim(F.coalesce(payload["model"], F.lit(""))) != "", payload["model"]).otherwise(default_model)
    fields = F.map_concat(F.map_filter(payload, lambda k, v: k != "model"), F.map_from_arrays(F.array(F.lit("model")), F.array(F.lit(model) if model is not None else named)))
    if stream != "inherit":
        fields = F.map_concat(F.map_filter(fields, lambda k, v: k != "stream"), F.map_from_arrays(F.array(F.lit("stream")), F.array(F.lit(stream))))
    return F.map_filter(fields, lambda k, v: k != "stream_options") if stream == "false" else fields
