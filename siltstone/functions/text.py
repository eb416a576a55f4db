"""Text functions: actions, tool calls, truncation, passages, code checks."""

from __future__ import annotations

import ast
import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TAIL = 10_000


def compression_ratio(data: str | None) -> float:
    """Bytes by compressed bytes (zlib 9); empty data is infinite."""
    raw = (data or "").encode()
    return len(raw) / len(zlib.compress(raw, 9)) if raw else float("inf")


def has_repetition(text: str | None) -> bool:
    """More than 10,000 characters of which the last 10,000 compress more than tenfold."""
    return text is not None and len(text) > TAIL and compression_ratio(text[-TAIL:]) > 10


def after_reasoning(s: Column) -> Column:
    return F.when(s.contains("</think>"), F.element_at(F.split(s, "</think>", -1), -1)).otherwise(s)


def without_reasoning(s: Column) -> Column:
    return F.regexp_replace(s, r"(?is)<think>.*?</think>", "")


def search_action(s: Column) -> Column:
    """struct(action, content) of the first search or answer block."""
    pattern = r"(?s)<(search|answer)>(.*?)</\1>"
    kind = F.regexp_extract(s, pattern, 1)
    return F.struct(F.when(kind != "", kind).alias("action"), F.when(kind != "", F.trim(F.regexp_extract(s, pattern, 2))).otherwise("").alias("content"))


# Fixed value: a boxed answer with at most one level of inner braces.
BOXED = r"Answer:\s*\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"


def tool_action(s: Column) -> Column:
    """struct(action, content): boxed answer, then code of a tool call, a code tag, a Python block."""
    call = F.replace(F.regexp_extract(s, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1), F.lit("\n"), F.lit("\\n"))
    code = F.when(F.get_json_object(call, "$.name") == "code_interpreter", F.get_json_object(call, "$.arguments.code"))
    code = F.when(F.trim(code) != "", code)
    tag = F.when(s.rlike(r"(?s)<code>.*?</code>"), F.trim(F.regexp_extract(s, r"(?s)<code>(.*?)</code>", 1)))
    fence = F.when(s.rlike(r"(?s)```python\s*.*?\s*```"), F.trim(F.regexp_extract(s, r"(?s)```python\s*(.*?)\s*```", 1)))
    boxed = F.when(s.rlike(BOXED), F.trim(F.regexp_extract(s, BOXED, 1)))
    any_code = F.coalesce(code, tag, fence)
    return F.struct(F.when(boxed.isNotNull(), "answer").when(any_code.isNotNull(), "code").alias("action"), F.coalesce(boxed, any_code, F.lit("")).alias("content"))


def _upto_last(s: Column, pattern: str) -> Column:
    whole = F.regexp_extract(s, rf"(?s)\A(.*{pattern})", 1)
    return F.when(whole != "", whole)


def complete_tool_text(s: Column) -> Column:
    """The response up to its last complete tool call, first code tag, last Python block or last boxed answer."""
    call = F.when(s.contains("<tool_call>"), _upto_last(s, r"<tool_call>\s*\{.*?\}\s*</tool_call>"))
    code = F.when(s.contains("</code>"), F.concat(F.substring_index(s, "</code>", 1), F.lit("</code>")))
    fence = F.when(s.contains("```python"), _upto_last(s, r"```python\s*.*?```"))
    return F.coalesce(call, code, fence, F.when(s.contains("Answer:"), _upto_last(s, BOXED)), s)


def complete_search_text(s: Column) -> Column:
    """The response up to the first closed search, else the first closed answer."""
    return (
        F.when(s.contains("</search>"), F.concat(F.substring_index(s, "</search>", 1), F.lit("</search>")))
        .when(s.contains("</answer>"), F.concat(F.substring_index(s, "</answer>", 1), F.lit("</answer>")))
        .otherwise(s)
    )


def tool_call(s: Column) -> Column:
    """struct(name, arguments) of the last tool call; arguments may be an object or a string of one."""
    found = F.regexp_extract_all(s, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    body = F.try_element_at(found, F.lit(-1))
    name = F.coalesce(F.get_json_object(body, "$.name"), F.get_json_object(body, "$.function.name"))
    args = F.coalesce(F.get_json_object(body, "$.arguments"), F.get_json_object(body, "$.function.arguments"))
    return F.struct(name.alias("name"), args.alias("arguments"))


def balanced_json(text: str | None, start: int = 0) -> str | None:
    """The first balanced object from ``start``, aware of strings and escapes."""
    if not text or (at := text.find("{", start)) < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return None


def last_line(s: Column, cap: int = 512) -> Column:
    """The last non-blank line, cut to ``cap`` characters."""
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    return F.left(F.try_element_at(lines, F.lit(-1)), F.lit(cap))


def truncate_middle(s: Column, n: int) -> Column:
    head = n // 2
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(head)), F.lit("...(truncated)..."), F.right(s, F.lit(n - head))))


def compact(s: Column, n: int) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n)), F.lit("... ["), F.length(s).cast("string"), F.lit(" chars]")))


def passages(docs: Column) -> Column:
    """Numbered passages: the first line of a document is its title, the rest its text."""

    def one(d: Column, i: Column) -> Column:
        lines = F.split(d, "\n")
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), lines[0], F.lit(") "), F.array_join(F.slice(lines, 2, F.size(lines)), "\n"), F.lit("\n"))

    return F.array_join(F.transform(docs, one), "")


def snippet_segments(s: Column) -> Column:
    """Segments between dots with more than five words."""
    return F.filter(F.transform(F.split(s, r"\.\.\."), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) > 5)


def clean_query(s: Column) -> Column:
    """Only word characters and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]", " "), r"(?U)[\s]+", " "))


def html_like(url: Column, mime: Column) -> Column:
    """No declared type, and no extension or one of a page."""
    ext = F.lower(F.regexp_extract(url, r"^[a-z]+://[^?#]*/[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return mime.isNull() & ext.isin("", "html", "htm", "shtml")


# Parts of code that a sandbox refuses, in the order they are tried.
REFUSED = [
    r"import\s+os", r"import\s+sys", r"import\s+subprocess", r"import\s+shutil", r"import\s+glob", r"import\s+pathlib", r"__import__", r"eval\s*\(", r"exec\s*\(", r"open\s*\(", r"file\s*\(", r"input\s*\(", r"raw_input\s*\(", r"compile\s*\(",
    r"execfile\s*\(", r"getattr\s*\(", r"setattr\s*\(", r"delattr\s*\(", r"hasattr\s*\(", r"globals\s*\(", r"locals\s*\(", r"vars\s*\(", r"dir\s*\(", r"type\s*\(", r"isinstance\s*\(", r"issubclass\s*\(", r"super\s*\(", r"property\s*\(",
    r"staticmethod\s*\(", r"classmethod\s*\(", r"__\w+__",
]
# Modules that it admits.
ADMITTED = ["math", "random", "datetime", "collections", "itertools", "functools", "operator", "statistics", "decimal", "fractions"]


def code_refusal(code: Column) -> Column:
    """The first refused part, else the first module that isn't admitted, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(REFUSED):
        out = F.when(code.rlike(f"(?i){p}"), F.lit(p)).otherwise(out)
    modules = F.array_distinct(F.concat(F.regexp_extract_all(code, F.lit(r"import\s+(\w+)"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"from\s+(\w+)"), F.lit(1))))
    other = F.array_sort(F.filter(modules, lambda m: ~m.isin(ADMITTED)))
    return F.coalesce(out, F.try_element_at(other, F.lit(1)))


def extension_calls(code: str | None, module: str) -> list[str]:
    """Names called on ``module`` in Python code, by its syntax tree; none if it can't be parsed."""
    try:
        tree = ast.parse(code or "")
    except SyntaxError:
        return []
    calls = {n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == module}
    return sorted(calls)


def missing_semicolon(code: str | None, macro: str = "REGISTER_BINDING") -> int | None:
    """The line of a macro call that no semicolon follows."""
    for m in re.finditer(rf"\b{macro}\s*\(", code or ""):
        depth, i = 1, m.end()
        while i < len(code) and depth:
            depth += {"(": 1, ")": -1}.get(code[i], 0)
            i += 1
        if not code[i:].lstrip().startswith(";"):
            return code.count("\n", 0, m.start()) + 1
    return None


def exported_symbols(code: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"EXPORT_FUNCTION\s*\(\s*(\w+)"), F.lit(1))))


def last_sections(text: str | None, names: list[str]) -> dict[str, str]:
    """The last complete ordered run of tagged sections; if there is none, the last of each."""
    found = [(m.start(), n, m.group(1)) for n in names for m in re.finditer(rf"(?s)<{n}>(.*?)</{n}>", text or "")]
    found.sort()
    for at in range(len(found) - len(names), -1, -1):
        run = found[at : at + len(names)]
        if [n for _, n, _ in run] == names:
            return {n: c for _, n, c in run}
    return {n: c for _, n, c in found}


def precheck(code: str | None, module: str) -> str | None:
    """Why a code answer can't be run: empty, unreadable, or no call of its extension module; None if it can."""
    if not code or not code.strip():
        return "empty"
    try:
        ast.parse(code)
    except SyntaxError as e:
        return f"syntax error in line {e.lineno}"
    if not extension_calls(code, module):
        return "no extension call"
    return None


# Error classes of tool feedback, first match first.
FEEDBACK = [("timeout", ("timed out", "timeout")), ("compilation_error", ("compilation error", "nvcc", "error: expected")), ("import_error", ("no module named", "importerror")), ("syntax_error", ("syntaxerror", "invalid syntax")), ("runtime_error", ("runtimeerror", "traceback", "cuda error")), ("mismatch", ("not close", "mismatch"))]


def feedback_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(low == "", F.lit(None).cast("string")).otherwise("other")
    for name, parts in reversed(FEEDBACK):
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def parse_payload(body: str | None) -> str | None:
    """Arguments given as a string are read once more."""
    try:
        x = json.loads(body or "")
    except ValueError:
        return None
    return json.dumps(json.loads(x), sort_keys=True) if isinstance(x, str) else json.dumps(x, sort_keys=True)


def snippet_paragraph(text: Column, snippet: Column) -> Column:
    """The paragraph of a page around a snippet, in which line breaks stand as blanks; null if the page doesn't hold it."""
    at = F.call_function("locate", snippet, F.replace(text, F.lit("\n"), F.lit(" ")))
    head = F.element_at(F.split(F.substring(text, F.lit(1), at), "\n"), -1)
    middle = F.substring(text, at + 1, F.length(snippet) - 1)
    tail = F.element_at(F.split(F.substring(text, at + F.length(snippet), F.length(text)), "\n"), 1)
    return F.when((at > 0) & (F.length(snippet) > 0), F.regexp_replace(F.concat(head, middle, tail), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def call_to_action(calls: Column, said: Column) -> Column:
    """struct(name, kwargs) of the first tool call (name, parameters); without a call, or with parameters that are no JSON object, a reply."""
    first = F.get(calls, F.lit(0))
    valid = F.from_json(first["parameters"], "map<string,string>").isNotNull() & F.ltrim(first["parameters"]).startswith("{")
    reply = F.struct(F.lit("respond").alias("name"), F.to_json(F.struct(said.alias("content"))).alias("kwargs"))
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(first["name"].alias("name"), first["parameters"].alias("kwargs"))).otherwise(reply)


def step_outcome(said: Column, tool: str) -> Column:
    """What an environment's step comes to: no call, a call of another tool, a call without an answer, or an answer to score."""
    call = tool_call(said)
    answer = F.trim(F.coalesce(F.get_json_object(call["arguments"], "$.answer"), F.lit("")))
    return F.when(call["name"].isNull(), "no_call").when(call["name"] != tool, "bad_tool").when(answer == "", "missing_answer").otherwise("scored")
