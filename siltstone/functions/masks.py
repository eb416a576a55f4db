"""Loss masks of conversations: which tokens the model is trained on. The tokenizer and the template are parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Message = dict
Tokenizer = Callable[[str], list[int]]


def characters(text: str) -> list[int]:
    """A tokenizer with one token per character."""
    return [ord(c) for c in text]


def render(messages: list[Message], tools: list | None = None, open_turn: bool = False) -> str:
    """A plain chat markup; tools stand in front, ``open_turn`` starts the assistant's part."""
    out = f"<|tools|>{tools}<|end|>\n" if tools else ""
    out += "".join(f"<|im_start|>{m['role']}\n{m.get('content') or ''}<|im_end|>\n" for m in messages)
    return out + ("<|im_start|>assistant\n" if open_turn else "")


GENERATION = "<|im_start|>assistant\n"


def by_message(messages: list[Message], tokenize: Tokenizer = characters, tools: list | None = None) -> tuple[list[int], list[int]]:
    """Tokens and mask, message by message: an assistant's tokens after its header count unless its ``step_loss_mask`` isn't 1."""
    return _joined(messages, [tokenize(render([m], tools if i == 0 else None)) for i, m in enumerate(messages)], tokenize, tools)


def _joined(messages: list[Message], parts: list[list[int]], tokenize: Tokenizer, tools: list | None) -> tuple[list[int], list[int]]:
    """The messages' tokens one after the other, and their mask."""
    head, front = len(tokenize(GENERATION)), len(tokenize(render([], tools))) if tools else 0
    mask: list[int] = []
    for i, (m, own) in enumerate(zip(messages, parts)):
        learn = m["role"] == "assistant" and m.get("step_loss_mask", 1) == 1
        skip = min(head + (front if i == 0 else 0), len(own)) if learn else len(own)
        mask += [0] * skip + [1] * (len(own) - skip)
    return [t for own in parts for t in own], mask


def by_offsets(messages: list[Message], tokenize_with_offsets: Callable[[str], list[tuple[int, int, int]]], think_prefix: str = "<think>\n\n</think>\n\n") -> tuple[list[int], list[int]]:
    """Tokens and mask from character spans: a token counts if all its characters lie in an assistant's content (an empty reasoning prefix excluded)."""
    text, spans = "", []
    for m in messages:
        start = len(text)
        text += render([m])
        if m["role"] == "assistant" and m.get("step_loss_mask", 1) == 1:
            low = start + len(GENERATION)
            if text[low:].startswith(think_prefix):
                low += len(think_prefix)
            spans.append((low, len(text)))
    covered = [0] * (len(text) + 1)
    for low, high in spans:
        for i in range(low, high):
            covered[i] = 1
    total = [0]
    for c in covered[:-1]:
        total.append(total[-1] + c)
    tokens = tokenize_with_offsets(text)
    return [t for t, _, _ in tokens], [int(b > a and total[b] - total[a] == b - a) for _, a, b in tokens]


def single_response(messages: list[Message], tokenize: Tokenizer = characters) -> tuple[list[int], list[int]]:
    """Prompt tokens 0, the one response's tokens 1."""
    prompt = tokenize(render(messages[:-1], open_turn=True))
    answer = tokenize((messages[-1].get("content") or "") + "<|im_end|>\n")
    return prompt + answer, [0] * len(prompt) + [1] * len(answer)


VARIANTS = {"by_message": by_message, "single_response": single_response}


def loss_mask(kind: str, messages: list[Message], tokenize: Tokenizer = characters) -> tuple[list[int], list[int]]:
    if kind not in VARIANTS:
        raise ValueError(f"unknown mask type {kind}")
    return VARIANTS[kind](messages, tokenize)


def runs(ids: list[int], mask: list[int], decode: Callable[[list[int]], str] = lambda x: "".join(map(chr, x))) -> list[str]:
    """The texts of the contiguous masked runs."""
    out, run = [], []
    for t, m in zip([*ids, 0], [*mask, 0]):
        if m:
            run.append(t)
        elif run:
            out.append(decode(run))
            run = []
    return out


def find_all(whole: list[int], part: list[int]) -> list[int]:
    return [i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part]


def header_length(tokenize: Tokenizer = characters, tools: list | None = None) -> int:
    """Tokens that the template puts in front of the first message."""
    probe = tokenize("PROBE TEXT")
    first = find_all(tokenize(render([{"role": "user", "content": "PROBE TEXT"}], tools)), probe)[0]
    plain = find_all(tokenize(render([{"role": "user", "content": "PROBE TEXT"}])), probe)[0]
    return first - plain


def by_prefixed_message(messages: list[Message], tokenize: Tokenizer = characters, tools: list | None = None) -> tuple[list[int], list[int]]:
    """As ``by_message`` for templates that depend on neighbours: each message is rendered behind a probe turn, whose tokens are cut off."""
    probe = {"role": "user", "content": "PROBE TEXT"}
    head = len(tokenize(render([probe])))
    parts = [tokenize(render([m, probe], tools))[:-head] if i == 0 else tokenize(render([probe, m]))[head:] for i, m in enumerate(messages)]
    return _joined(messages, parts, tokenize, tools)


def by_character_offsets(messages: list[Message], tokenize: Tokenizer = characters) -> tuple[list[int], list[int]]:
    """``by_offsets`` for a tokenizer with one token per character."""
    return by_offsets(messages, lambda text: [(t, i, i + 1) for i, t in enumerate(tokenize(text))])


VARIANTS["by_offsets"] = by_character_offsets
VARIANTS["by_prefixed_message"] = by_prefixed_message


def supervised_sample(messages: list[Message], kind: str = "by_message", tokenize: Tokenizer = characters) -> dict:
    """A training sample of a conversation: all tokens, the response from the first learned token on, its mask, reward 0."""
    ids, mask = loss_mask(kind, messages, tokenize)
    n = len(mask) - mask.index(1) if 1 in mask else 0
    return {"tokens": ids, "response_length": n, "loss_mask": mask[len(mask) - n :], "reward": 0.0}


def role_masks(messages: DataFrame, key: list[str], order: str, role: str, n_tokens: Column) -> DataFrame:
    """(key, n_tokens, n_learned, mask): per conversation, its turns' tokens in order, 1 where the assistant speaks."""
    learn = F.col(role) == "assistant"
    rows = messages.select(*key, F.col(order).alias("_at"), n_tokens.cast("bigint").alias("_n"), learn.alias("_learn"))
    part = F.struct("_at", F.expr("repeat(CASE WHEN _learn THEN '1' ELSE '0' END, CAST(_n AS INT))").alias("m"))
    packed = rows.groupBy(*key).agg(F.sum("_n").alias("n_tokens"), F.sum(F.when(F.col("_learn"), F.col("_n")).otherwise(0)).alias("n_learned"), F.array_sort(F.collect_list(part)).alias("_m"))
    return packed.select(*key, "n_tokens", "n_learned", F.array_join(F.col("_m.m"), "").alias("mask"))


def segments(messages: DataFrame, key: list[str], order: str, role: str, text: str) -> DataFrame:
    """(key, segment, learn, n_messages, text): a conversation flattened to runs of messages that are learned, or not, one after the other."""
    rows = messages.select(*key, F.col(order).alias("_at"), F.col(text).alias("_text"), (F.col(role) == "assistant").alias("learn"))
    rows = rows.withColumn("_new", (F.coalesce(F.lag("learn").over(Window.partitionBy(*key).orderBy("_at")) != F.col("learn"), F.lit(True))).cast("bigint"))
    runs = rows.withColumn("segment", F.sum("_new").over(Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    packed = runs.groupBy(*key, "segment").agg(F.min("learn").alias("learn"), F.count(F.lit(1)).alias("n_messages"), F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_m"))
    return packed.select(*key, "segment", "learn", "n_messages", F.array_join(F.col("_m._text"), "").alias("text"))
