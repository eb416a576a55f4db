"""Evaluation texts leaking into training text, by pigeonhole edit matching.

A record leaks an item if it holds ``exact`` words in a row of the item's statement, or a stretch of at least ``stretch`` of its words of
which no more than one in ``per_edit`` is replaced, left out or has one added. (For scripts without word spaces the unit is the character,
``exact_chars`` in a row or a stretch of ``stretch_chars``.) A stretch of ``n`` units allows ``k = n // per_edit`` edits, so of its
``k + 1`` pieces one is untouched; that piece has at least
``piece_length`` units (five with the defaults), whatever the stretch and wherever it starts. The pieces of all stretches of an item are
therefore its runs of that many units. One pass of an Aho-Corasick automaton over the normalised record
finds every exact piece hit; a hit is extended to its full exact run, and where that is too short, bounded by the common words and then
decided by Myers' bit-parallel edit distance of the item's stretches against the text around the hit.

Letter case, width, punctuation, layout, markup and invisible characters are removed from both sides. Lines that at least half of a set's
items share are its instruction and not part of a statement.

Items are held by every worker, so they are taken in blocks of ``block_items``; more items mean more passes, never a larger broadcast.
Records are never shuffled. Defined cases: null and empty texts and items match nothing; an item shorter than every threshold matches
nothing; repeated rows and redelivered records give one result row; JSON message lists are read as their contents; empty tables give no rows.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
WORDS = re.compile(r"[^\W_]+")
IDEOGRAPHS = re.compile("[぀-ヿ㐀-鿿]")


def contents(text: str) -> str:
    """The text itself, or the contents of a JSON list of messages."""
    if text[:1] in "[{" and '"content"' in text:
        try:
            messages = json.loads(text)
        except ValueError:
            return text
        messages = messages if isinstance(messages, list) else [messages]
        parts = [m.get("content") for m in messages if isinstance(m, dict)]
        return "\n".join(p for p in parts if isinstance(p, str))
    return text


def words(text: str) -> list[str]:
    """The normalised words; a run of ideographs is one word here."""
    if "&" in text:
        text = html.unescape(text)
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)))
    if "<" in text:
        text = TAG.sub("", text)
    return WORDS.findall(text.lower())


def myers(pattern: list[str], text: list[str], rows: list[int]) -> dict[int, int]:
    """Least edit distance of the first ``r`` units of ``pattern`` to any stretch of ``text``, for each r in ``rows``."""
    peq: dict[str, int] = {}
    for i, p in enumerate(pattern):
        peq[p] = peq.get(p, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    pv, mv = full, 0
    at = {r: r for r in rows}
    best = dict(at)
    for t in text:
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        for r in rows:
            bit = 1 << (r - 1)
            if ph & bit:
                at[r] += 1
            elif mh & bit:
                at[r] -= 1
                if at[r] < best[r]:
                    best[r] = at[r]
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


def piece_length(stretch: int, per_edit: int, exact: int) -> int:
    """Units that the untouched piece of any stretch has at least: ``n`` units with ``n // per_edit`` edits fall into one piece more than edits.

    The least is at the first stretches: from one multiple of ``per_edit`` to the next it only grows.
    """
    return max(1, min(exact, *(n // (n // per_edit + 1) for n in range(stretch, stretch + per_edit + 1))))


class Matcher:
    """All statements of one unit (words, or characters) and the automaton of their pieces."""

    def __init__(self, statements: list[tuple[int, list[str]]], sep: str, exact: int, stretch: int, per_edit: int):
        import ahocorasick

        self.sep, self.exact, self.stretch, self.per_edit = sep, exact, stretch, per_edit
        self.piece = piece_length(stretch, per_edit, exact)
        self.units = {i: u for i, u in statements if len(u) >= min(exact, stretch)}
        self.bags = {i: Counter(u) for i, u in self.units.items()}
        self.where: list[list[tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton()
        known: dict[str, int] = {}
        for i, u in self.units.items():
            for j in range(len(u) - self.piece + 1):
                piece = sep + sep.join(u[j : j + self.piece]) + sep
                if piece not in known:
                    known[piece] = len(self.where)
                    self.where.append([])
                    self.automaton.add_word(piece, known[piece])
                self.where[known[piece]].append((i, j))
        if known:
            self.automaton.make_automaton()
        self.any = bool(known)

    def found(self, units: list[str]) -> list[int]:
        if not self.any or len(units) < min(self.exact, self.stretch):
            return []
        sep = self.sep
        line = sep + sep.join(units) + sep
        hits = [(end, ids) for end, ids in self.automaton.iter(line)]
        if not hits:
            return []
        if sep:
            # word number of a piece's end: count separators once, from left to right
            places, number, last = [], 0, 0
            for end, piece in hits:
                number += line.count(sep, last, end)
                last = end
                places.append((number - self.piece, piece))
        else:
            places = [(end - self.piece + 1, piece) for end, piece in hits]
        by: dict[int, list[tuple[int, int]]] = {}
        for q, piece in places:
            for i, j in self.where[piece]:
                by.setdefault(i, []).append((q, j))
        return [i for i, seeds in by.items() if self.leaks(i, seeds, units)]

    def leaks(self, i: int, seeds: list[tuple[int, int]], units: list[str]) -> bool:
        item = self.units[i]
        n = len(item)
        run, diag = self.piece, {}
        for q, j in seeds:  # consecutive seeds of one diagonal are one exact run
            d = q - j
            start, end = diag.get(d, (q, q))
            diag[d] = (start, q) if q <= end + 1 else (q, q)
            run = max(run, q - diag[d][0] + self.piece)
        if run >= self.exact:
            return True
        if n < self.stretch:
            return False
        need = self.stretch - self.stretch // self.per_edit
        slack = n // self.per_edit + 1
        done: set[int] = set()
        for d in sorted(diag):
            if any(abs(d - e) <= 2 for e in done):
                continue
            done.add(d)
            area = units[max(0, d - slack) : d + n + slack]
            bag = self.bags[i]
            if sum(min(c, bag[w]) for w, c in Counter(area).items() if w in bag) < need:
                continue
            starts = range(n - self.stretch + 1)
            if any(myers(item[s : s + self.stretch], area, [self.stretch])[self.stretch] * self.per_edit <= self.stretch for s in starts):
                return True
            for s in starts:
                rows = list(range(self.stretch + 1, n - s + 1))
                if rows and any(e * self.per_edit <= r for r, e in myers(item[s:], area, rows).items()):
                    return True
        return False


def statements(items: DataFrame) -> DataFrame:
    """(item_id, statement): the item's lines without those that at least half of its set shares."""
    own = items.select("item_id", F.coalesce("dataset_path", F.lit("")).alias("in_set"), "item_prompt")
    lines = own.where("item_prompt IS NOT NULL").select("item_id", "in_set", F.posexplode(F.split("item_prompt", "\n")).alias("at", "line"))
    size = own.groupBy("in_set").agg(F.countDistinct("item_id").alias("of"))
    shared = lines.groupBy("in_set", "line").agg(F.countDistinct("item_id").alias("n")).join(size, "in_set")
    kept = lines.join(shared.where("n > 1 AND 2 * n >= of").select("in_set", "line"), ["in_set", "line"], "left_anti")
    return kept.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("statement"))


def leaks(
    records: DataFrame,
    items: DataFrame,
    exact: int = 12,
    stretch: int = 28,
    exact_chars: int = 24,
    stretch_chars: int = 56,
    per_edit: int = 6,
    block_items: int = 20_000,
) -> DataFrame:
    """(origin, row_key, item_id) for records (origin, row_key, text) and items (item_id, dataset_path, item_prompt)."""
    texts = statements(items)
    blocks = -(-texts.count() // block_items)
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    schema = "origin string, row_key bigint, item_id bigint"
    out = records.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        held = [(r["item_id"], r["statement"]) for r in numbered.where(F.col("block") == b).collect()]
        out = out.unionByName(records.select("origin", "row_key", "text").mapInArrow(_scan(held, exact, stretch, exact_chars, stretch_chars, per_edit), schema))
    return out.distinct()


_BUILT: dict = {}


def _scan(held: list[tuple[int, str]], exact: int, stretch: int, exact_chars: int, stretch_chars: int, per_edit: int):
    key = (hash(tuple(held)), exact, stretch, exact_chars, stretch_chars, per_edit)

    def build() -> tuple[Matcher, Matcher]:
        if key not in _BUILT:
            plain, dense = [], []
            for i, text in held:
                w = words(text)
                if sum(len(x) for x in w if IDEOGRAPHS.match(x)) * 2 > sum(map(len, w)):
                    dense.append((i, [c for x in w for c in x]))
                else:
                    plain.append((i, w))
            _BUILT.clear()
            _BUILT[key] = (Matcher(plain, " ", exact, stretch, per_edit), Matcher(dense, "", exact_chars, stretch_chars, per_edit))
        return _BUILT[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_char = build()
        seen: dict[str, list[int]] = {}
        for batch in batches:
            origins, keys, ids = [], [], []
            for o, k, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = cell.as_py()
                if not text:
                    continue
                got = seen.get(text)
                if got is None:
                    w = words(contents(text))
                    got = by_word.found(w)
                    if by_char.any and IDEOGRAPHS.search(text):
                        got = got + by_char.found([c for x in w for c in x])
                    if len(seen) > 64:  # prompts of one group lie together
                        seen.clear()
                    seen[text] = got
                for i in got:
                    origins.append(o)
                    keys.append(k)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["origin", "row_key", "item_id"])

    return run
