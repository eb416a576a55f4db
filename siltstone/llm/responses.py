"""Broken prompt and response pairs.

Local checks run row by row in Arrow batches: ``empty``, ``copied_question`` (bit-parallel longest common subsequence of words),
``truncated`` (open reasoning, fences, tags, brackets and sentences) and ``wrong_language``. Refusals are found over the corpus:

1. The opening of a reply (its first sentence, in words; once more with the prompt's own words masked) is pre-aggregated with all equal
   ones. Openings near each other are linked by MinHash bands over shingles of five words, verified at a Jaccard similarity of 0.8; linked
   openings are one template.
2. A template is told by how it recurs: over at least ``RECURS`` distinct prompts (counted exactly; prompts that differ in digits only are
   one) that aren't related (by bottom sketches of the prompts, less than ``RELATED`` of them share a shingle), without the prompt's own
   words, without a number that varies, and standing alone in at least ``ALONE`` of its replies: nothing follows, or only what itself recurs
   word for word over ``RECURS`` prompts. No answer to unrelated prompts reads like that.
3. Wording is only the check that follows: a template that neither denies nor speaks of speaker or request (``DENIES``, ``SPEAKS``) is none.

A reply is a refusal if its opening is such a template and nothing else follows than what recurs or is polite (``COURTESY``), so an apology
or caveat with an answer after it is none.

At most one defect per sample, in the order empty, copied_question, refusal, truncated, wrong_language. Defined cases: null, blank and
invisible responses are ``empty``; a null or blank prompt is never copied and has no language; label, reward and status are not read;
redelivered samples give one row; an opening held by any share of the rows is pre-aggregated; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.language import FUNCTION_WORDS, language, weights
from siltstone.llm.leakage import INVISIBLE, contents
from siltstone.session import discard, materialize

ARTICLES = frozenset(("the", "a", "an"))
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 10, 4
RECURS, OWN_WORDS, RELATED, ALONE = 3, 0.5, 0.7, 0.8
LEAST_WORDS, SKETCH = 3, 8
BLOCK = 1024
APART = re.compile(r"(?<=[぀-ヿ㐀-鿿]) | (?=[぀-ヿ㐀-鿿])")
MASK = "·"
THINK = "(?:think|thinking|thought|reasoning)"
CLOSED_THINK = re.compile(rf"(?s)<{THINK}>.*?</{THINK}>")
UPTO_THINK = re.compile(rf"(?s)\A.*</{THINK}>")
OPEN_THINK = re.compile(rf"<{THINK}>")
SPECIAL = re.compile(r"<\|[^|<>\n]{1,40}\|>")
EMPTY_FENCE = re.compile(r"(?:```|~~~)[ \t]*[\w+-]*\s*(?:```|~~~)?\s*\Z")
FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
TAG = re.compile(r"</?[a-zA-Z_][\w-]*(?:\s[^<>\n]*)?/?>")
EMPTY_BOX = re.compile(r"\\(?:boxed|text|fbox)\{\s*\}")
OPENING_TAG = re.compile(r"<([a-z_][a-z_0-9-]*)>")
NUMBER = re.compile(r"\d+")
TOOL_BLOCK = re.compile(r"(?s)<(search|information|tool_call|tool_response|code)>.*?</\1>")
SYMBOLS = re.compile(r"`[^`\n]*`|\\\w+|\$[^$\n]*\$")
WORDS = re.compile(r"[^\W_]+")
DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
ASCII_UNIT = re.compile("[a-z0-9]+")
SENTENCE = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")
STOPS = ".!?。！？…\"”’'»」』)）】]}$`*>~%°"
OPEN_ENDS = ",;:，、；：([{（【「『<=+-*/\\^&|—–~_#@"
LABEL = re.compile(r"(?:answer|result|solution|答案|结果|答え|答|ответ|итог|antwort|ergebnis|réponse|résultat|respuesta|resultado)\W{0,6}[:：]\W*[^\n]{1,60}\Z", re.I)
ITEM = re.compile(r"\s*(?:[-*•·+]|\d+[.)、]|[a-z][.)])\s+\S")

# Courtesies after a refusal.
COURTESY = re.compile(
    r"(?:feel free|you may want|you might|thank(?:s| you)|i hope|let me know|please (?:consult|ask|try|contact|reach)|is there (?:something|anything)|i(?:'| a)m (?:happy|glad)|happy to|sorry|my apologies|apologies|i apologi[sz]e|i understand)\b"
)
COURTESIES = (
    "感谢您的理解", "感谢理解", "感谢您理解", "感谢的理解", "换个话题", "咨询专业", "其他需要", "请谅解", "抱歉", "对不起", "敬请谅解", "谢谢", "merci", "gracias", "danke", "спасибо", "извините", "простите", "к сожалению", "désolé", "lo siento", "consulte", "consultez",
    "wenden sie sich", "обратитесь", "ご相談", "ご了承", "ご理解", "申し訳",
)
# The words by which a recurring opening is checked: a negation or an apology, or who or what it is about.
DENIES = re.compile(
    r"\b(?:[a-z]+n t|can t)\b|\b(?:no|not|never|cannot|unable|refuse|refrain|decline|sorry|apologi[sz]e|regret|unfortunately|off[- ]limits|forbidden|prohibited)\b|n['’]t\b|"
    r"\b(?:nunca|jamás|lamento|siento|ne|pas|jamais|refuse|désolée?|regrette|nicht|keine?n?|nie|leider|não|nunca|non|mai|spiacente|purtroppo)\b|\b(?:не|нет|нельзя|никогда|увы|сожалени\w*)\b|"
    r"不|无法|未能|拒|歉|恕|ません|ない|かねま|できず|않|못|없|죄송|لا|لن|آسف"
)
SPEAKS = re.compile(
    r"\b(?:i|we|me|us|my|our|requests?|questions?|topics?|tasks?|subjects?|matters?|yo|nosotros|mi|me|nos|solicitud|pregunta|tema|tarea|je|nous|demande|question|sujet|ich|wir|mir|uns|anfrage|frage|thema|aufgabe|eu|posso|pedido|io|posso|richiesta|answer\w*|respond\w*|repl(?:y|ies)|assist\w*|contestar|responder|petición|répondre|antworten|beantworten)\b|"
    r"\b(?:я|мы|мне|нам|запрос\w*|вопрос\w*|тем[аыуе]|задач\w*|ответ\w*)\b|我|本(?:人|助手|模型)|您的|该(?:内容|请求|问题|话题)|(?:请求|问题|话题|要求)|(?:ご質問|ご要望|ご依頼|この(?:件|内容|質問|話題|依頼))|저는|요청|질문|طلب|سؤال|أستطيع|يمكنني"
)
# Names of languages in prompts that ask for one.
ASKED = {
    "en": r"english|英文|英语|inglés|anglais|englisch|английск|英語",
    "zh": r"(?:simplified )?chinese|mandarin|中文|汉语|chino|chinois|chinesisch|китайск|中国語",
    "ja": r"japanese|日文|日语|japonés|japonais|japanisch|японск|日本語",
    "ru": r"russian|俄文|俄语|ruso|russe|russisch|русск|ロシア語",
    "de": r"german|德文|德语|alemán|allemand|deutsch|немецк|ドイツ語",
    "fr": r"french|法文|法语|francés|français|französisch|французск|フランス語",
    "es": r"spanish|西班牙文|西班牙语|español|espagnol|spanisch|испанск|スペイン語",
}
ASKS = {
    k: re.compile(
        rf"(?:\b(?:in(?:to)?|to)\s+(?:{v})\b|\bthe (?:{v}) (?:version|translation)\b|\b(?:{v}) only\b|(?:用|以|译成|翻译成|译为|翻译为)(?:{v})|\b(?:en|al|au|auf|ins|на|по)[\s-]+(?:{v})|(?:{v})(?:で|に))", re.I
    )
    for k, v in ASKED.items()
}
NAMES_LANGUAGE = tuple(name for names in ASKED.values() for name in names.replace("(?:simplified )?", "").split("|"))
ASK_CUE = re.compile(r"translat|reply|respond|answer|write|version|summar|say|用|译|回答|responde|contest|traduc|tradu|répond|antwort|übersetz|schreib|ответ|перев|напиш|答え|訳", re.I)


@lru_cache(maxsize=4096)
def user_text(prompt: str) -> str:
    """The user's words: the user messages of a JSON list, else the whole prompt."""
    if prompt[:1] in "[{" and '"content"' in prompt:
        import json

        try:
            messages = json.loads(prompt)
            own = [m["content"] for m in messages if m.get("role") in ("user", "human") and isinstance(m.get("content"), str)]
            if own:
                return "\n".join(own)
        except (ValueError, AttributeError, TypeError, KeyError):
            pass
    return contents(prompt)


def reply_of(response: str) -> tuple[str, bool]:
    """The reply after the reasoning, and whether reasoning is left open."""
    if "<" not in response:
        return response, False
    text = CLOSED_THINK.sub("", response)
    text = UPTO_THINK.sub("", text)
    if m := OPEN_THINK.search(text):
        return text[m.end() :], True
    return text, False


def visible(text: str) -> str:
    """Without special tokens and invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return SPECIAL.sub("", text) if "<|" in text else text


def is_empty(reply: str) -> bool:
    text = visible(reply).strip()
    text = EMPTY_FENCE.sub("", text) if text.startswith(("```", "~~~")) else text
    text = EMPTY_BOX.sub("", TAG.sub("", text))
    return not WORDS.search(text)


def units(text: str) -> list[str]:
    """Words in lower case; of dense scripts, characters."""
    if text.isascii():
        return ASCII_UNIT.findall(text.lower())
    return UNIT.findall(INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower())


def copy_units(text: str) -> list[str]:
    """What a copy is compared by: words without tags."""
    return units(TAG.sub(" ", text) if "<" in text else text)


@lru_cache(maxsize=4096)
def asked_units(text: str) -> list[str]:
    """``copy_units`` of a prompt; the samples of one prompt lie together."""
    return copy_units(text)


@lru_cache(maxsize=4096)
def asked_kinds(text: str) -> frozenset[str]:
    return frozenset(asked_units(text)) - ARTICLES


@lru_cache(maxsize=4096)
def least_size(text: str) -> int:
    """Characters that four fifths of a prompt's words take at least (articles aside): a shorter reply in ASCII can't be a copy."""
    sizes = sorted(len(w) for w in asked_units(text) if w not in ARTICLES)
    return sum(sizes[: math.ceil(0.8 * len(sizes) - 1e-9)])


def gives_back(text: str, reply: list[str], kinds: set[str]) -> bool:
    """The reply copies ``text``. What lacks more than a fifth of its words can't be a copy in any form, so that is looked at first."""
    prompt = asked_units(text)
    return len(asked_kinds(text) - kinds) <= 0.2 * len(prompt) and is_copy(prompt, reply)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_copy(prompt: list[str], reply: list[str]) -> bool:
    """At least four fifths of the prompt and hardly anything else, with or without articles, which a change of form may drop."""
    if _is_copy(prompt, reply):
        return True
    return _is_copy([u for u in prompt if u not in ARTICLES], [u for u in reply if u not in ARTICLES])


def _is_copy(prompt: list[str], reply: list[str]) -> bool:
    n, m = len(prompt), len(reply)
    times = round(m / n) if n else 0
    if 2 <= times <= 5 and n >= 3:  # given back several times over
        return all(_is_copy(prompt, reply[i * m // times : (i + 1) * m // times]) for i in range(times))
    if n < 3 or m < 0.8 * n or m > 1.25 * n + 6:
        return False
    bag = Counter(prompt)
    if sum(min(c, bag[w]) for w, c in Counter(reply).items() if w in bag) < 0.8 * n:
        return False
    same = common(prompt, reply)
    return same >= 0.8 * n and m - same <= max(2, 0.12 * m)


def is_truncated(reply: str) -> bool:
    text = visible(reply).rstrip()
    if not text:
        return False
    prose = text
    if "```" in text or "~~~" in text:
        if len(re.findall(r"(?m)^[ \t]*(?:```|~~~)", text)) % 2:
            return True
        prose = FENCE.sub("\n", text).rstrip()
    fenced = prose != text and text.endswith(("```", "~~~"))
    for tag in set(OPENING_TAG.findall(prose)) if "<" in prose else ():
        if prose.count(f"<{tag}>") > prose.count(f"</{tag}>") and tag not in ("br", "hr", "p", "li", "img"):
            return True
    if fenced:
        return False
    if not prose:
        return False
    if ("<" in prose and re.search(r"</?[a-z_]*\Z", prose)) or prose.count("`") % 2:
        return True
    if "\\" in prose and (re.search(r"\\\w+\{[^{}]*\Z", prose) or re.search(r"\\\w*\Z", prose)):
        return True
    if (prose.count("$") - prose.count("\\$")) % 2 and not re.search(r"\$\d[^$]*\Z", prose):
        return True
    last = prose.rsplit("\n", 1)[-1].strip()
    end = prose[-1]
    if end in STOPS and end not in "*":
        if end in ")）]}" and last.count({")": "(", "）": "（", "]": "[", "}": "{"}[end]) < last.count(end):
            return False
        opened = sum(last.count(c) for c in "(（[【") - sum(last.count(c) for c in ")）]】")
        return opened > 0 and end not in STOPS[:8]
    if end == "*":
        return prose.count("**") % 2 == 1
    if end in OPEN_ENDS:
        return True
    if LABEL.search(last):
        return False
    if ITEM.match(last):
        items = [x.strip() for x in prose.split("\n") if ITEM.match(x)]
        return any(x[-1] in ".!?。！？;；" for x in items[:-1])
    bare = units(prose)
    if "\n" not in prose and not re.search(r"[.!?。！？,，;；:：]", prose):
        if DENSE.search(prose):
            return len(bare) > 8
        if len(bare) <= 1 or (len(bare) <= 5 and all(w[:1].isupper() or w[:1].isdigit() for w in prose.split())):
            return False
    if re.fullmatch(r"[-+\d.,/ \\^=()%$]+", prose):
        return False
    return True


@lru_cache(maxsize=4096)
def asked_language(prompt: str) -> str | None:
    """The language that the prompt asks for, if it asks for one: a sentence names it within 160 characters of a word that asks."""
    low = prompt.lower()
    if not any(name in low for name in NAMES_LANGUAGE):
        return None
    for line in SENTENCE.split(prompt):
        if ASK_CUE.search(line):
            for lang, pattern in ASKS.items():
                if any(ASK_CUE.search(line, max(0, m.start() - 160), m.end() + 160) for m in pattern.finditer(line)):
                    return lang
    return None


@lru_cache(maxsize=4096)
def prompt_language(prompt: str) -> str | None:
    """The prompt's language; None if it mixes languages or can't be told."""
    total: Counter = Counter()
    for line in FENCE.sub("\n", prompt).split("\n"):
        for part in re.split(r"(?<=[：:])", line) if not line.isascii() else [line]:
            total.update(weights(part))
    if not total:
        return None
    (lang, most), *rest = total.most_common(2)
    if most < 2 or (rest and rest[0][1] >= max(4, 0.05 * most)):
        return None
    return lang


def is_wrong_language(prompt: str, reply: str) -> bool:
    want = asked_language(prompt) or prompt_language(prompt)
    if want is None:
        return False
    prose = visible(reply)
    if "```" in prose or "~~~" in prose:
        prose = FENCE.sub("\n", prose)
    if "<" in prose:
        prose = TAG.sub(" ", TOOL_BLOCK.sub(" ", prose))
    if "`" in prose or "\\" in prose or "$" in prose:
        prose = SYMBOLS.sub(" ", prose)
    prose = prose.strip()
    all_said = weights(prose)
    if not all_said or max(all_said, key=lambda k: all_said[k]) == want:
        return False
    said = [s for s in SENTENCE.split(prose) if s.strip()]
    body = "\n".join(said[1:]) if len(said) > 1 and len(units(said[0])) <= 12 else prose
    got = language(body) or language(prose)
    return got is not None and got != want and all_said.get(got, 0) >= 3 and all_said.get(got, 0) > 2 * all_said.get(want, 0)


def local_defect(prompt: str | None, response: str | None) -> tuple[str | None, str]:
    """The defect that the pair shows by itself, and the reply if a refusal may be in it."""
    if response is None:
        return "empty", ""
    reply, is_open = reply_of(response)
    if is_open:
        return "truncated", ""
    if is_empty(reply):
        return "empty", ""
    asked = user_text(prompt) if prompt else ""
    if asked and not (reply.isascii() and len(reply) < min(least_size(asked), least_size(contents(prompt or "")))):
        said = copy_units(reply)
        kinds = set(said)
        if gives_back(asked, said, kinds) or (prompt is not None and asked != prompt and gives_back(contents(prompt), said, kinds)):
            return "copied_question", ""
    if is_truncated(reply):
        return "truncated", reply
    return ("wrong_language" if asked and is_wrong_language(asked, reply) else None), reply


def key_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=4096)
def prompt_key(prompt: str) -> int:
    """A prompt's key; prompts that differ in digits only share it."""
    return key_of(NUMBER.sub("0", prompt))


_SALT = np.random.RandomState(7).randint(1, 2**63 - 1, size=(2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)


def shingles(words: list[str]) -> set[int]:
    return {zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))}


@lru_cache(maxsize=4096)
def sketch(prompt: str) -> list[int]:
    """The least hashes of the prompt's shingles; prompts that share many shingles share some of these."""
    return nsmallest(SKETCH, shingles(asked_units(user_text(prompt))))


@lru_cache(maxsize=4096)
def asked_words(prompt: str) -> frozenset[str]:
    return frozenset(asked_units(user_text(prompt)))


GRAMMAR = frozenset(w for words in FUNCTION_WORDS.values() for w in words)


class Opening(NamedTuple):
    form: str  # its words, numbers as 0
    masked: str | None  # the same with the prompt's own words as one mark, if there are any
    numbers: int  # key of its numbers
    own: float  # share of its words that the prompt has


def opening_of(prompt: str, sentence: str) -> Opening | None:
    """The opening sentence as a possible template; None if it has under ``LEAST_WORDS`` words, as a bare answer."""
    text = sentence.lower()
    found = copy_units(NUMBER.sub("0", text))
    if len(found) < LEAST_WORDS:
        return None
    asked = asked_words(prompt)
    masked: list[str] = []
    for w in found:
        if len(w) > 3 and w in asked and w not in GRAMMAR:
            if not masked or masked[-1] != MASK:
                masked.append(MASK)
        else:
            masked.append(w)
    numbers = NUMBER.findall(text)
    return Opening(" ".join(found), " ".join(masked) if MASK in masked else None, key_of(" ".join(numbers)) if numbers else 0, sum(w in asked for w in found) / len(found))


def in_two(reply: str) -> tuple[str, str]:
    """The first sentence and the rest."""
    text, at = reply.strip(), 0
    for m in SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            return text[at : m.start()].strip(), text[m.end() :].strip()
        at = m.end()
    return text[at:], ""


def is_polite(rest: str) -> bool:
    """Every sentence is a courtesy, or a denial about the speaker or the request."""
    return all(COURTESY.match(s) or any(c in s for c in COURTESIES) or (DENIES.search(s) and SPEAKS.search(s)) for x in SENTENCE.split(rest.lower()) if (s := x.strip()))


SCHEMA = "sample_index bigint, prompt_key bigint, defect string, form string, masked string, numbers bigint, own double, rest bigint, rest_form bigint, polite boolean, sketch array<bigint>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]


def _row(key: int | None, prompt: str, defect: str | None, reply: str) -> tuple | None:
    """What the corpus pass needs of one reply: no rest gives 0, a rest with code or formulas null (it is content)."""
    first, rest = in_two(reply) if reply else ("", "")
    said = opening_of(prompt, first) if first else None
    if said is None:
        return (key, None, defect, *[None] * 8) if defect else None
    if not rest:
        ends: tuple = (0, 0, True)
    elif "```" in rest or "~~~" in rest or "\\boxed" in rest or "$" in rest:
        ends = (None, None, False)
    else:
        same = " ".join(rest.lower().split())
        alike = NUMBER.sub("0", same)
        ends = (key_of(same), key_of(alike), is_polite(rest))
    return (key, prompt_key(prompt), defect, *said, *ends, sketch(prompt))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, prompts, responses = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        rows = [x for k, p, r in zip(keys, prompts, responses) if (x := _row(k, p or "", *local_defect(p, r)))]
        cols = list(zip(*rows)) or [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)


def bands(form: str) -> list[int]:
    """One key per band of the MinHash signature; none if no other opening can be near enough."""
    s = shingles(form.split(" "))
    if len(s) < SIMILAR / (1 - SIMILAR) - 1e-9:  # of so few shingles, one that differs is too many
        return []
    x = np.fromiter(s, np.uint64, len(s))
    with np.errstate(over="ignore"):
        h = (x[:, None] * (_SALT[0] | np.uint64(1)) + _SALT[1]) ^ (x[:, None] >> np.uint64(7))
        low = (h * np.uint64(0x9E3779B97F4A7C15)).min(axis=0).reshape(BANDS, ROWS)
    return [zlib.crc32(low[i].tobytes()) << 5 | i for i in range(BANDS)]


SIGNED = "id bigint, text string, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bands(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "text", "bands"])


def _forms(local: DataFrame) -> DataFrame:
    """The rows once per form of their opening, with its ``id``."""
    return local.where("form IS NOT NULL").withColumn("form", F.explode(F.array_compact(F.array("form", "masked")))).withColumn("id", F.xxhash64("form"))


def near_pairs(texts: list[str], own: list[int], crossing: bool) -> list[tuple[int, int]]:
    """Pairs that join all texts of a Jaccard similarity of ``SIMILAR`` or more; ``crossing``: only texts of different blocks are compared.

    Similar sets share one of the rarest shingles that are left when ``SIMILAR`` of a set is taken away, so only such pairs are verified.
    """
    sets = [shingles(t.split(" ")) for t in texts]
    common_in = Counter(x for s in sets for x in s)
    root = list(range(len(sets)))
    index: dict[int, list[int]] = {}
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s, tried = sets[i], set()
        for x in sorted(s, key=lambda x: (common_in[x], x))[: len(s) - math.ceil(SIMILAR * len(s) - 1e-9) + 1]:
            at = index.setdefault(x, [])
            for j in at:
                if j in tried or (crossing and own[i] == own[j]):
                    continue
                tried.add(j)
                if find(i) != find(j) and len(s & sets[j]) >= SIMILAR * len(s | sets[j]):
                    root[find(i)] = find(j)
                    links.append((i, j))
            at.append(i)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (band, low, high), whose rows lie together."""

    def linked(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        return [(rows[i][1], rows[j][1]) for i, j in near_pairs([r[2] for r in rows], [r[0] for r in rows], key[1] != key[2])]

    last, held = None, []
    for b in batches:
        found = []
        for band, low, high, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (band, low, high) != last:
                found += linked(last, held) if held else []
                last, held = (band, low, high), []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    found = linked(last, held) if held else []
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def clusters(signed: DataFrame) -> DataFrame:
    """(id, cluster) of the openings that have a verified link to any other member of a shared band; the others are alone.

    A band's members are compared in pairs of blocks of about ``BLOCK``, each pair of blocks in one place.
    """
    banded = signed.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = banded.join(shared, "band").withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("id", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own").join(signed.select("id", "text"), "id")
    together = members.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").select("band", "low", "high", "own", "id", "text")
    links = materialize(together.mapInArrow(_link, "a bigint, b bigint").distinct(), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = edges.select(F.col("a").alias("id")).distinct().withColumn("cluster", F.col("id"))
    used = [links]
    while True:  # each round doubles the reach: labels go to neighbours, then to the label's own label
        spread = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        near = label.join(spread, label["id"] == spread["a"]).select("id", F.least("cluster", "near").alias("new"), "cluster")
        after = near.join(label.select(F.col("id").alias("new"), F.col("cluster").alias("far")), "new").select("id", F.least("new", "far").alias("new"), "cluster")
        after = materialize(after, "labels")
        used.append(after)
        if after.where("new <> cluster").isEmpty():
            discard(signed.sparkSession, *used[:-1])
            return after.select("id", "cluster")
        label = after.select("id", F.col("new").alias("cluster"))


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The openings that deny, or speak of speaker or request."""
    for b in batches:
        texts = [APART.sub("", t) for t in b.column(1).to_pylist()]
        keep = [c for c, t in zip(b.column(0).to_pylist(), texts) if DENIES.search(t) or SPEAKS.search(t)]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["cluster"])


def _closed(rows: DataFrame, closing: DataFrame) -> DataFrame:
    """Add ``closes``; rows with no rest, or with content, match nothing and are spread by a hash, as they may be most of all."""
    none = F.col("rest_form").isNull() | (F.col("rest_form") == 0)
    spread = F.when(none, F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1).otherwise(0)
    return rows.withColumn("_spread", spread).join(closing.select("rest_form", F.lit(0).cast("bigint").alias("_spread"), F.lit(True).alias("closes")), ["rest_form", "_spread"], "left")


def templates(local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of the opening forms that decline, and (rest_form) of the endings that recur."""
    whole = local.where("form IS NOT NULL AND NOT coalesce(defect = 'truncated', false)")
    ends = whole.where("rest_form <> 0").groupBy("rest_form", "prompt_key").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    ends = ends.groupBy("rest_form").agg(F.count(F.lit(1)).alias("prompts"), F.min("low").alias("low"), F.max("high").alias("high"))
    closing = materialize(ends.where((F.col("prompts") >= RECURS) & (F.col("low") == F.col("high"))).select("rest_form"), "closing")
    uses = _forms(whole).groupBy("id", "prompt_key", "rest_form").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("polite"), 1)).alias("polite"), F.sum("own").alias("own"), F.min("numbers").alias("low"), F.max("numbers").alias("high")
    )
    signed = materialize(_forms(whole).select("id", F.col("form").alias("text")).distinct().mapInArrow(_sign, SIGNED), "signed")
    near = clusters(signed)
    in_cluster = lambda rows: rows.join(near, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    alone = F.when(F.col("closes") | (F.col("rest_form") == 0), F.col("n")).otherwise(F.col("polite"))
    seen = _closed(in_cluster(uses), closing).groupBy("cluster", "prompt_key").agg(F.sum("n").alias("n"), F.sum(alone).alias("alone"), F.sum("own").alias("own"), F.min("low").alias("low"), F.max("high").alias("high"))
    told = seen.groupBy("cluster").agg(F.count(F.lit(1)).alias("prompts"), *[F.sum(c).alias(c) for c in ("n", "alone", "own")], F.min("low").alias("low"), F.max("high").alias("high"))
    recurs = (F.col("prompts") >= RECURS) & (F.col("own") < OWN_WORDS * F.col("n")) & (F.col("alone") >= ALONE * F.col("n")) & (F.col("low") == F.col("high"))
    recurring = told.where(recurs).select("cluster", "prompts")
    named = recurring.join(signed.select(F.col("id").alias("cluster"), "text"), "cluster")  # a cluster bears the id of one of its forms
    recurring = materialize(recurring.join(named.select("cluster", "text").mapInArrow(_reads, "cluster bigint"), "cluster", "left_semi"), "recurring")
    members = materialize(in_cluster(signed.select("id")).join(recurring, "cluster"), "members")
    asked = _forms(whole).join(members, "id").select("cluster", "prompts", "prompt_key", F.explode("sketch").alias("value")).distinct()
    shared = asked.groupBy("cluster", "prompts", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg((F.max("n") / F.max("prompts")).alias("related"))
    declining = materialize(members.join(shared.where(F.col("related") < RELATED), "cluster").select("id"), "declining")
    discard(local.sparkSession, signed, near, recurring, members)
    return declining, closing


def refusals(local: DataFrame) -> DataFrame:
    """sample_index of the replies that only decline."""
    declining, closing = templates(local)
    declined = _forms(local).select("sample_index", "rest_form", "polite", "id").join(declining, "id", "left_semi")
    return _closed(declined, closing).where("polite OR closes").select("sample_index")


def defects(samples: DataFrame) -> DataFrame:
    """(sample_index, defect), one row per defective sample."""
    local = materialize(samples.select("sample_index", "prompt", "response").mapInArrow(_local, SCHEMA), "local")
    order = F.array(*[F.lit(x) for x in ("empty", "copied_question", "refusal", "truncated", "wrong_language")])
    every = local.where("defect IS NOT NULL").select("sample_index", "defect").unionByName(refusals(local).withColumn("defect", F.lit("refusal")))
    return every.groupBy("sample_index").agg(F.min(F.array_position(order, F.col("defect"))).alias("rank")).select("sample_index", F.element_at(order, F.col("rank").cast("int")).alias("defect"))
