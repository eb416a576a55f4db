"""Template residue and error-page text.

Two independent detectors:

* Messages. All sentences of all records go through a fixed-depth prefix tree (token count, then the first ``DEPTH`` tokens with variable
  ones masked; below a leaf, sentences alike in at least ``ALIKE`` of their tokens share a template, with wildcards where they differ).
  Each task grows its own tree over its rows; the trees' templates are merged leaf by leaf after one small shuffle.
  Every template is classified once by its wording: message, page furniture (menus, bare numbers) or open. Filler in a made-up Latin has no
  two sentences alike, so it is told by its words: those of the public passage and those that, in the mined templates, stand
  among such words.
  The open ones are told by company, from the tree's nodes: a node (a leaf, or a head with one token that may vary) held by at least ``LEAST`` sentences, of which at least ``COMPANY`` stand in records with a message, is furniture of message pages.
  A record is residue if nothing but messages and furniture is left below a possible first line, and a message is among it.
* Slots. Unfilled placeholders in prose or headings, outside code blocks, inline code and quotation marks, and not in a sentence about
  templates.

Defined cases: null and blank texts are never residue; letter case, width, tags and invisible characters don't count; repeated rows give
one result row per document; an empty table gives no rows; other columns are ignored. Sentences meet the verdicts of templates in a join by
leaf, at any size; workers hold ``MAX_HELD`` bits that tell which leaves can't have a message, so that most rows stay out of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import eq
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

DEPTH = 3
ALIKE = 0.6
LEAST, COMPANY = 3, 0.5
MAX_HELD = 1 << 24
MAX_WORDS = 1_000_000
FLUSH = 60_000
WILD = "<*>"
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
IDS = re.compile(r"(?<![a-z0-9])[0-9a-f]*\d[0-9a-f]*(?![a-z0-9])|\d[0-9a-f]*")  # also right behind an ideograph
DIGITS = re.compile(r"\d[0-9a-f]*")
BARE_ID = re.compile(r"[\W_]*[a-f]*\s*(?:0|<\*>)[\W\d_a-f]*")
TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,200}>")
INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁤﻿]")
ENDS = [(". ", ".\n"), ("! ", "!\n"), ("? ", "?\n"), ("。", "。\n"), ("！", "！\n"), ("？", "？\n")]

# Words of the public filler passage in made-up Latin and of its usual continuations.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea"
    " commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " cursus orci erat porta nullam vitae nisl massa ligula morbi donec".split()
)
FILLER = re.compile(
    r"sample text|\bblah\b|placeholder (?:paragraph|text)|replace (?:it|this) with your own|(?:content|text) goes here|click here to edit|^add an? (?:\w+ )?(?:description|title)|"
    r"^write something about|dummy (?:copy|text)|\bx{3,}(?: x+)+|\basdf\b|(?:\btest\b ?){3}|lorem ipsum|示例文字|占位文[本字]|请在此处输入|排版测试|(?:测试){2}|正式内容稍后替换"
)
NOTICE = re.compile(
    r"(?:enable|requires?|needs?|allow|activate|without|support|turn on)\b.{0,40}\b(?:javascript|js|scripts?|scripting|cookies)\b|(?:javascript|js|scripts?|scripting|cookies)\b.{0,30}\b(?:disabled|required|active|to run|switched off|enabled)\b|"
    r"checking your browser|not a robot|some features of .* will not work|verify (?:that )?you are (?:a )?human|(?:启用|开启|打开|需要)(?:javascript|脚本)|关闭脚本|脚本功能|javascriptを有効|включите javascript|activ(?:ez|e|ar) javascript|habilit\w+ javascript|javascript aktivieren"
)
ERROR = re.compile(
    r"bad gateway|gateway time-?out|not found\W*$|was not found|internal server error|(?:service|temporarily) unavailable|access denied|you don'?t have permission|session has expired|too many requests|something went wrong|"
    r"no longer available|can'?t find the page|page (?:you are looking for|does not exist)|upstream connect error|application error|server-side exception|nosuchkey|key does not exist|rate limit reached|server_error|"
    r"invalid answer from the upstream|origin did not respond|failed to render|页面不存在|已被删除|服务器开小差|没有权限|请求过于频繁|系统维护|暂时无法|错误码|页面出错|访问受限"
)
MENU = re.compile(
    r"(?:search|sign in|sign up|log ?in|register|blog|models?|next|menu|docs?|runs|english|contact(?: us)?|previous|top|about(?: us)?|home|help|faq|privacy|terms|back|support|返回|首页|下一页|上一页|文档|搜索|登录|注册|关于我们|帮助|菜单|导航|联系我们)"
)
FOOT = re.compile(r"^(?:copyright\b|©)|all rights reserved|^powered by|版权所有|^(?:request|ray|reference|incident|error|trace)(?: id| code)?\W*[a-f]*\W*0\W*$")
ABOUT = re.compile(r"which is why|\bmeans\b|\bbecause\b|\bharmless\b|\bso that\b|\bwe\b(?! will be| can'?t find|'re)|\bour\b(?! end)|in a row|曾把|不影响|只为|我们|因此")
QUOTED = re.compile("[“「『][^”」』]*[”」』]|(?<![\\w:{,])\"[^\"{}:]{3,60}\"(?![:,}])")


def is_latin(tokens: list[str], known: frozenset[str] = LATIN) -> bool:
    """Three words at least, of which three fifths are filler words."""
    if known.isdisjoint(tokens):
        return False
    words = [t for t in tokens if t[0].isalpha()]
    return len(words) >= 3 and sum(w in known for w in words) >= 0.6 * len(words)


def verdict(sentence: str) -> str | None:
    """``message``, ``furniture`` or ``filler`` by the wording of a template; None is open."""
    text = sentence.strip()
    names = re.sub(r"[\W\d_]+", " ", text).strip()
    if "```" in text or "~~~" in text:
        return None
    if not names or BARE_ID.fullmatch(text):
        return "furniture"
    if not MENU.sub("", names).strip():
        return "furniture"
    if is_latin(names.split()):
        return "filler"
    bare = QUOTED.sub(" ", text)
    if (FILLER.search(bare) or NOTICE.search(bare) or ERROR.search(bare)) and not ABOUT.search(bare):
        return "message"
    return "furniture" if FOOT.search(text) else None


def normal(text: str) -> str:
    """Lower case, without tags and invisible characters, numbers and hexadecimal ids as 0."""
    ids = DIGITS
    if not text.isascii():
        text, ids = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)), IDS
    if "<" in text:
        text = TAG.sub(" ", text)
    return ids.sub("0", text.lower())


def sentences(text: str) -> list[str]:
    for a, b in ENDS:
        if a in text:
            text = text.replace(a, b)
    return [x for s in text.split("\n") if (x := s.strip())]


def leaf_of(tokens: list[str]) -> str:
    head = [WILD if t[0] == "0" else t for t in tokens[:DEPTH]]
    return f"{len(tokens)} " + " ".join(head)


class PrefixTree:
    """Templates by leaf; a leaf is a token count and the first tokens."""

    def __init__(self) -> None:
        self.leaves: dict[str, list[list]] = {}
        self.size = 0

    def add(self, leaf: str, tokens: list[str], n: int) -> None:
        at = self.leaves.setdefault(leaf, [])
        for t in at:
            same = len(tokens) if t[0] == tokens else sum(map(eq, t[0], tokens))
            if same >= ALIKE * len(tokens):
                if same < len(tokens):
                    t[0] = [a if a == b else WILD for a, b in zip(t[0], tokens)]
                t[1] += n
                return
        at.append([tokens, n])
        self.size += 1

    def batch(self) -> pa.RecordBatch:
        rows = [(leaf, " ".join(t[0]), t[1]) for leaf, at in self.leaves.items() for t in at]
        self.leaves, self.size = {}, 0
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["leaf", "template", "n"])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, seen = PrefixTree(), Counter()

    def drain() -> None:
        for s, n in seen.items():
            if tokens := TOKEN.findall(s):
                tree.add(leaf_of(tokens), tokens, n)
        seen.clear()

    for b in batches:
        for cell in b.column(0):
            text = cell.as_py()
            if text:
                seen.update(set(sentences(normal(text))))
            if len(seen) > FLUSH:
                drain()
                if tree.size > FLUSH:
                    yield tree.batch()
    drain()
    yield tree.batch()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, last = PrefixTree(), None
    for b in batches:  # sorted by leaf
        for leaf, template, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if leaf != last and tree.size > 1000:
                yield tree.batch()
            tree.add(leaf, template.split(" "), n)
            last = leaf
    yield tree.batch()


def mine(documents: DataFrame, text: str = "text") -> DataFrame:
    """(leaf, template, n): the templates of all sentences, with how many sentences each covers."""
    grown = documents.select(text).mapInArrow(_grow, "leaf string, template string, n bigint")
    summed = grown.groupBy("leaf", "template").agg(F.sum("n").alias("n"))
    return summed.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "template").mapInArrow(_merge, "leaf string, template string, n bigint")


def _letters(template: str) -> list[str]:
    return [t for t in template.split(" ") if t[0].isalpha()]


def filler_words(templates: DataFrame) -> DataFrame:
    """(word): beside the fixed ones, the words whose company in templates is filler: on average, half of the words around them are fixed ones."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column(0).to_pylist() for w in _letters(t)} - LATIN), pa.string())], names=["word"])

    near = materialize(templates.where("verdict = 'filler'").select("template").mapInArrow(seeded, "word string").distinct(), "near")
    n = near.count()
    held = frozenset(r["word"] for r in near.toLocalIterator()) if n <= MAX_WORDS else None

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, around = Counter(), Counter()
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = t.split(" ")
                if held is not None and held.isdisjoint(words):
                    continue
                words = [w for w in words if w[0].isalpha()]
                share = sum(w in LATIN for w in words) / max(len(words) - 1, 1)
                for w in set(words) if held is None else held.intersection(words):
                    total[w] += k
                    around[w] += k * share
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([around[w] for w in total], pa.float64())], names=["word", "n", "k"])

    uses = templates.select("template", "n").mapInArrow(used, "word string, n bigint, k double")
    uses = uses if held is not None else uses.join(near, "word", "left_semi")
    return uses.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where((F.col("n") >= LEAST) & (F.col("k") >= COMPANY * F.col("n"))).select("word")


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        said = [verdict(spaced(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(said, pa.string())], names=["leaf", "template", "n", "verdict"])


def spaced(template: str) -> str:
    """A template as the rules read it: no blanks before punctuation, none inside contractions or between ideographs and numbers."""
    t = re.sub(r" (?=[^\w\s<\"“(\[{©#])|(?<=['’/_\-<(\[{“]) ", "", template)
    return re.sub(r"(?<=[一-鿿぀-ヿ]) | (?=[一-鿿぀-ヿ])", "", t)


def classified(documents: DataFrame, text: str = "text") -> DataFrame:
    """(leaf, template, n, verdict): the mined templates, each classified once by its wording."""
    return mine(documents, text).mapInArrow(_classify, "leaf string, template string, n bigint, verdict string")


# Unfilled placeholders.
_NAME = r"[^\W\d_][\w .\-]{0,38}?"
SLOT = re.compile(
    "|".join(
        [
            r"\{\{\s*" + _NAME + r"\s*\}\}",
            r"(?<![\\\w}$])\$\{" + _NAME + r"\}",
            r"\[\[\s*" + _NAME + r"\s*\]\]",
            r"<<\s*" + _NAME + r"\s*>>",
            r"@@" + _NAME + r"@@",
            r"(?<!\w)__[A-Z][A-Z_ ]*?__(?!\w)",
            r"%\(" + _NAME + r"\)[sd]",
            r"XXX-" + _NAME + r"-XXX",
            r"<%=?\s*" + _NAME + r"\s*%>",
            r"\{%\s*block\b[^%\n]*%\}",
            r"\[\s*(?:INSERT|Insert|insert|TBD|TODO)\b[^\]\n]{0,40}\]",
            r"[\[<][\w ]{1,40} (?:goes )?here\s*[\]>]",
            r"[\[<]\s*[Yy]our [\w ]{1,40}[\]>]",
            r"[【［\[（(<][^】］\]）)>\n]{0,12}(?:请填写|此处填写|待补充|待填写|请输入)[^】］\]）)>\n]{0,20}[】］\]）)>]",
            r"<[一-鿿]{1,10}>",
            r"(?<![\\A-Za-z0-9_}$/{^])\{" + _NAME + r"\}(?!\})",
        ]
    )
)
MARKS = ("{{", "${", "[[", "<<", "@@", "__", "%(", "XXX-", "<%", "{%", "[INSERT", "[Insert", "[insert", "[TBD", "[TODO", " here]", " here>", "[your ", "<your ", "[Your ", "<Your ", "填写", "待补充", "请输入", "{")
FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
INLINE = re.compile(r"`[^`\n]*`")
ABOUT_SLOTS = re.compile(r"(?i)\b(?:templates?|variables?|placeholders?|linter|replace[sd]?|substituted|syntax|macro|renders?|rendered)\b|模板|变量|占位符|替换|шаблон|plantilla|modèle de texte|vorlage|テンプレート|変数")
CUT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")
QUOTES = "\"'“”‘’«»「」『』"
CJK_SLOT = re.compile("<[一-鿿]{1,10}>")


def has_slot(text: str) -> bool:
    """An unfilled placeholder stands in the prose or a heading."""
    if not any(m in text for m in MARKS) and not CJK_SLOT.search(text):
        return False
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "`" in text:
        text = INLINE.sub(" ", text)
    if not any(m in text for m in MARKS) and not CJK_SLOT.search(text):
        return False
    for sentence in CUT.split(text):
        for m in SLOT.finditer(sentence):
            before, after = sentence[m.start() - 1 : m.start()], sentence[m.end() : m.end() + 1]
            if before and after and before in QUOTES and after in QUOTES:
                continue
            if ABOUT_SLOTS.search(sentence[: m.start()] + " " + sentence[m.end() :]):
                continue
            return True
    return False


def only_messages(lines: Iterable[list[str]]) -> bool:
    """Nothing but messages, help text and furniture stands below a possible first line, and a message is among it."""
    title, told = True, False
    for kinds in lines:
        if not kinds or set(kinds) == {"furniture"}:
            continue
        if None in kinds:
            if not title:
                return False
            if "message" in kinds:  # content and a message in one line: no title
                return False
        told = told or "message" in kinds
        title = False
    return told


ROWS = "row bigint, doc_id bigint, line int, at int, leaf string, tokens string, kind string"
ROW_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * len(ROW_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW_TYPES)], names=["row", "doc_id", "line", "at", "leaf", "tokens", "kind"])


def leaf_bit(leaf: str, bits: int) -> int:
    return crc32(leaf.encode()) % bits


def message_leaves(templates: DataFrame, bits: int) -> bytes:
    """The bits of all leaves with a message template; other leaves may share them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array({leaf_bit(x, bits) for x in b.column(0).to_pylist()}, pa.int64())], names=["bit"])

    held = bytearray(bits // 8 + 1)
    for r in templates.where("verdict = 'message'").select("leaf").mapInArrow(places, "bit bigint").distinct().toLocalIterator():
        held[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    return bytes(held)


def _tell(filler: frozenset[str], held: bytes, bits: int):
    """The sentences, with place, leaf and tokens, of each row with a leaf among those of ``held``, or with filler.

    A row with a slot gives that alone.
    """

    def judge(sentence: str) -> tuple[str | None, str | None, bool]:
        """Leaf and kind of a sentence, and whether it may be a message."""
        tokens = TOKEN.findall(sentence)
        if not tokens:
            return None, "furniture", False
        if is_latin(tokens, filler):
            return None, "message", True
        leaf = leaf_of(tokens)
        bit = leaf_bit(leaf, bits)
        return leaf, None, bool(held[bit >> 3] >> (bit & 7) & 1)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, tuple] = {}  # sentences recur
        for b in batches:
            out: list[tuple] = []
            for row, doc, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                content = cell.as_py()
                if not content or not content.strip():
                    continue
                if has_slot(content):
                    out.append((row, doc, -1, 0, None, None, "slot"))
                    continue
                said, may = [], False
                for line, text in enumerate(normal(content).split("\n")):
                    for at, s in enumerate(sentences(text)):
                        told = judged.get(s)
                        if told is None:
                            told = judged[s] = judge(s)
                        said.append((line, at, s, told))
                        may = may or told[2]
                if may:
                    out += [(row, doc, line, at, leaf, leaf and " ".join(TOKEN.findall(s)), kind) for line, at, s, (leaf, kind, _) in said]
                if len(judged) > FLUSH:
                    judged.clear()
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return tell


def told(rows: DataFrame, templates: DataFrame, filler: frozenset[str]) -> DataFrame:
    """``ROWS`` of all rows with a slot or a message; ``kind`` is the verdict of the sentence's template.

    The verdict is that of the first template, in their order, that covers the sentence.
    """
    judged = templates.where("verdict IN ('message', 'furniture')").select("leaf", "template", "verdict")
    every = materialize(rows.mapInArrow(_tell(filler, message_leaves(templates, MAX_HELD), MAX_HELD), ROWS), "told")
    one = every.where("kind IS NULL").select("leaf", "tokens").distinct()
    covers = F.forall(F.zip_with(F.split("template", " "), F.split("tokens", " "), lambda a, b: (a == b) | (a == WILD)), lambda x: x)
    said = one.join(judged, "leaf").where(covers).groupBy("leaf", "tokens").agg(F.min(F.struct("template", "verdict"))["verdict"].alias("verdict"))
    known = every.join(said, ["leaf", "tokens"], "left").withColumn("kind", F.coalesce("kind", "verdict")).select(*every.columns)
    found = F.max(F.coalesce(F.col("kind").isin("message", "slot"), F.lit(False))).over(Window.partitionBy("row"))
    return known.withColumn("found", found).where("found").drop("found")


def nodes(leaf: str = "leaf") -> Column:
    """The tree nodes that tell a sentence's company: its leaf, and the leaf's head with one token that may vary."""
    at = F.split(leaf, " ")
    two = F.array_join(F.slice(at, 1, DEPTH), " ")
    behind = F.concat_ws(" ", F.slice(at, 1, 1), F.lit(WILD), F.slice(at, 3, DEPTH))
    around = F.concat_ws(" ", F.slice(at, 1, 2), F.lit(WILD), F.slice(at, 4, DEPTH))
    return F.array_distinct(F.array(F.col(leaf), two, behind, around))


def company(sentences_: DataFrame, templates: DataFrame) -> DataFrame:
    """(leaf) of the open sentences (row, leaf, tokens) of records with a message that hardly stand anywhere else."""
    inside = sentences_.select("row", "leaf", "tokens").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    inside = materialize(inside, "inside")
    by_node = inside.select(F.explode(nodes()).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    total = templates.select(F.explode(nodes()).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("of"))
    near = by_node.join(total, "node").where((F.col("of") >= LEAST) & (F.col("n") >= COMPANY * F.col("of"))).select("node")
    return inside.select("leaf", F.explode(nodes()).alias("node")).join(near, "node").select("leaf").distinct()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, kinds = [], []
        for key, said in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            slot = said[0]["kind"] == "slot"
            if slot or only_messages([x["kind"] for x in line] for _, line in groupby(said, lambda x: x["line"])):
                ids.append(key)
                kinds.append("slot" if slot else "message")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind) of residue documents; kind is ``slot`` or ``message``."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    templates = materialize(classified(documents, text), "templates")
    words = filler_words(templates)
    if words.count() > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} filler words")
    may = materialize(told(rows, templates, LATIN.union(r["word"] for r in words.toLocalIterator())), "may")
    furniture = company(may.where("kind IS NULL"), templates).withColumn("near", F.lit("furniture"))
    known = may.join(furniture, "leaf", "left").withColumn("kind", F.coalesce("kind", "near"))
    lines = known.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("line", "at", "kind"))).alias("told"))
    return lines.mapInArrow(_decide, "doc_id bigint, kind string").groupBy("doc_id").agg(F.max("kind").alias("kind"))
