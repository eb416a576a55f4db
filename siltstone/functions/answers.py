"""Rule-based graders. Column functions where built-ins express the rule, plain functions with Arrow wrappers where they don't."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation


def normalise_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks, in this order."""
    bare = F.translate(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"[\s\p{Z}]+", " "))


def exact_match(prediction: Column, golden: Column) -> Column:
    """Any of the golden answers equals the prediction after normalisation."""
    return F.exists(golden, lambda g: normalise_answer(g) == normalise_answer(prediction))


def token_f1(common: Column, n_prediction: Column, n_truth: Column, prediction: Column, truth: Column) -> Column:
    """struct(f1, precision, recall) from overlap counts; a yes / no / noanswer that differs scores 0."""
    special = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    clash = (prediction != truth) & (F.array_contains(special, prediction) | F.array_contains(special, truth))
    p, r = common / n_prediction, common / n_truth
    ok = ~clash & (common > 0)
    return F.struct(F.when(ok, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.when(ok, p).otherwise(0.0).alias("precision"), F.when(ok, r).otherwise(0.0).alias("recall"))


def last_answer_block(s: Column) -> Column:
    """The last answer block, if there are at least two."""
    found = F.regexp_extract_all(s, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) >= 2, F.trim(F.element_at(found, -1)))


def information_blocks(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<information>(.*?)</information>"), F.lit(1)), lambda x: F.trim(x))


def retrieval_hit(s: Column, golden: Column) -> Column:
    """A golden answer stands in an information block, both normalised."""
    return F.exists(information_blocks(s), lambda b: F.exists(golden, lambda g: normalise_answer(b).contains(normalise_answer(g))))


# The states of a tagged answer and the tag that leads on.
STEPS = {
    ("start", "<think>"): "in_think",
    ("information", "<think>"): "in_think",
    ("in_think", "</think>"): "after_think",
    ("after_think", "<search>"): "in_search",
    ("in_search", "</search>"): "after_search",
    ("after_search", "<information>"): "in_information",
    ("in_information", "</information>"): "information",
    ("after_think", "<answer>"): "in_answer",
    ("in_answer", "</answer>"): "end",
}
KNOWN_TAG = re.compile(r"</?(?:think|search|information|answer)>")


def tag_sequence(text: str | None) -> tuple[bool, str]:
    """Whether the assistant's part is think (search information think)* answer with nothing in between, and why not."""
    begin = re.search(r"<\|im_start\|>assistant\s*", text or "")
    if not begin:
        return False, "no assistant part"
    body = text[begin.end() :]
    for tag in ("think", "search", "information", "answer"):
        if body.count(f"<{tag}>") != body.count(f"</{tag}>"):
            return False, f"unbalanced {tag}"
    state, at = "start", 0
    for m in [*KNOWN_TAG.finditer(body), None]:
        between = body[at : m.start() if m else len(body)]
        if between.strip() and not state.startswith("in_"):
            return False, f"text in state {state}"
        if m is None:
            break
        state = STEPS.get((state, m.group()))
        if state is None:
            return False, f"unexpected {m.group()}"
        at = m.end()
    return (True, "valid") if state == "end" else (False, f"ended in state {state}")


def search_score(valid: Column, retrieved: Column, answer: Column, matched: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, score: float = 1.0) -> Column:
    """The composite exact-match score from format, retrieval and match."""
    base = F.when(valid & retrieved, structure + retrieval).when(valid, structure)
    return F.when(answer.isNull(), base.otherwise(0.0)).when(matched, F.when(valid, score).otherwise(score - structure)).otherwise(base.otherwise(final))


def last_boxed(s: str | None) -> str | None:
    """The last balanced boxed expression, with its command."""
    if not s:
        return None
    at = s.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at, len(s)):
        if s[i] == "{":
            depth += 1
        elif s[i] == "}":
            depth -= 1
            if not depth:
                return s[at : i + 1]
    return None


def boxed_content(s: str | None) -> str | None:
    """What the last box holds; a frame box, or a box command without its brace, holds no answer."""
    at = (s or "").rfind("\\boxed")
    if at < 0 or not s.startswith("\\boxed{", at):
        return None
    box = last_boxed(s[at:])
    return None if box is None else box[len("\\boxed{") : -1]


# Replacements and removals of the final-answer normal form.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
    "<|im_end|>", "<|endoftext|>",
]


def final_answer(s: Column) -> Column:
    """Normal form of a final answer, as a chain of built-in replacements."""
    x = F.element_at(F.split(s, "="), -1)
    for a, b in REPLACED:
        x = F.replace(x, F.lit(a), F.lit(b))
    for a in REMOVED:
        x = F.replace(x, F.lit(a), F.lit(""))
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for command in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"(\\{command}\{{)(.*?)(\}})", "$2")
    x = F.regexp_replace(x, r"(\\boxed\{)(.*)(\})", "$2")
    x = F.regexp_replace(x, r"(frac)([^{])(.)", r"frac{$2}{$3}")
    x = F.regexp_replace(x, r"(sqrt)([^{])", r"sqrt{$2}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    return F.trim(F.when(F.replace(x, F.lit(","), F.lit("")).rlike(r"^\d+$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))


def stated_answer(s: Column) -> Column:
    """What follows the last ``Answer:`` on its line, or the mark of an invalid answer."""
    found = F.regexp_extract_all(s, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def integer_text(s: Column) -> Column:
    return s.try_cast("double").cast("bigint").cast("string")


def stated_score(response: Column, truth: Column) -> Column:
    """struct(score, acc, pred) of the stated answer within the last 300 characters against an integer truth."""
    pred = final_answer(stated_answer(F.right(response, F.lit(300))))
    acc = F.coalesce(pred == integer_text(final_answer(truth)), F.lit(False))
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def strict_box(response: str | None, truth: str | None) -> tuple[int, str | None]:
    """1 if the last box within the last 100 characters holds exactly the truth, else -1."""
    box = last_boxed((response or "")[-100:])
    got = None if box is None else box[len("\\boxed{") : -1]
    return (1 if got is not None and got == truth else -1), got


# Spellings that the plain form unifies, in this order.
SPELLINGS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def plain_math(s: str | None) -> str | None:
    """Normal form of a short mathematical answer: one spelling of fractions, roots, units, signs and blanks."""
    if s is None:
        return None
    x = s.strip()
    if m := re.search(r"^\\text\{(.+?)\}$", x):
        x = m.group(1).strip()
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    if x.count("\\text{ ") == 1:  # a unit on the right
        x = x.split("\\text{ ")[0]
    x = x.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not x:
        return x
    if x[0] == ".":
        x = "0" + x
    if x.count("=") == 1 and len(x.split("=")[0]) <= 2:
        x = x.split("=")[1]
    x = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", x).replace(" ", "")
    x = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", x)
    x = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", x)
    if x == "0.5":
        x = "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", x):
        a, b = int(m.group(1)), int(m.group(2))
        if x == f"{a}/{b}":
            x = f"\\frac{{{a}}}{{{b}}}"
    return x


def plain_equal(a: str | None, b: str | None) -> bool:
    """Equal normal forms; texts that have none are compared as they are."""
    return a is not None and b is not None and plain_math(a) == plain_math(b)


# Units that a numeric answer may carry.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]

# Spellings that the looser form unifies, in this order.
LOOSE_SPELLINGS = [("\\%", ""), ("\\$", ""), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]


def _value(x: str) -> Fraction | None:
    try:
        if m := re.fullmatch(r"\(?\\?(?:frac)?\{?\(?(-?[\d.]+)\)?\}?[/{]+\(?([\d.]+)\)?\}?\)?", x):
            return Fraction(m.group(1)) / Fraction(m.group(2))
        return Fraction(x)
    except (ValueError, ZeroDivisionError):
        return None


def loose_math(s: str | None) -> str | None:
    """A looser normal form: no units, signs and case, whole numbers as integers, scales as powers of ten."""
    if s is None:
        return None
    x = s
    if m := re.search(r"^\\text\{(.+?)\}$", x):
        x = m.group(1)
    for a, b in LOOSE_SPELLINGS:
        x = x.replace(a, b)
    for unit in UNITS:
        x = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", x)
    x = re.sub(r"\^ *\\circ", "", x)
    if len(x) > 1 and x[0] == "{" and x[-1] == "}":
        x = x[1:-1]
    x = re.sub(r",\\! *", "", x).replace("\\tfrac", "\\frac").replace("\\dfrac", "\\frac")
    x = re.sub(r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"\1/\2", x)
    x = re.sub(r"- *", "-", x)
    x = re.sub(r"([0-9]) +([0-9])", r"\1+\2", x).replace(" ", "").replace("{", "").replace("}", "").lower()
    bare = x
    while (y := re.sub(r"(\d),(\d\d\d)($|\D)", r"\1\2\3", bare)) != bare:
        bare = y
    try:
        if abs(float(bare) - round(float(bare))) <= 1e-7:
            return str(int(float(bare)))
    except (ValueError, OverflowError):
        pass
    return x


def loose_equal(truth: str | None, given: str | None) -> bool:
    """Equal loose forms, element by element for tuples; both must be whole numbers or neither, fractions must be reduced alike.

    Symbolic simplification is used only where sympy can be imported.
    """
    a, b = loose_math(truth), loose_math(given)
    if a is None or b is None:
        return False
    if a == b:
        return True
    if not b:
        return False
    xs, ys = _elements(a), _elements(b)
    if len(xs) > 1 and (a[0] != b[0] or a[-1] != b[-1]) or len(xs) != len(ys):
        return False
    return all(_element_equal(x, y) for x, y in zip(xs, ys))


def _elements(x: str) -> list[str]:
    if len(x) > 2 and x[0] in "([" and x[-1] in ")]" and not any(c in x[1:-1] for c in "()[]"):
        return [e.strip() for e in x[1:-1].split(",")]
    return [x]


# Powers that aren't simplified, as that may not end.
COSTLY = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")


def _is_whole(x: str) -> bool:
    try:
        v = float(re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", x))
        return abs(v - round(v)) <= 1e-7
    except (ValueError, OverflowError):
        return False


def _element_equal(x: str, y: str) -> bool:
    if x == y:
        return True
    is_fraction = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?")
    if is_fraction.fullmatch(x) and is_fraction.fullmatch(y):
        return False
    if _is_whole(x) != _is_whole(y):
        return False
    u, v = _value(x), _value(y)
    if u is not None and v is not None:
        return u == v
    try:
        import sympy
        from sympy.parsing import sympy_parser
    except ImportError:
        return False
    expr = f"({x})-({y})"
    if COSTLY.search(expr):
        return False
    expr = expr.replace("^", "**")
    if len({c for c in expr.replace("sqrt", "").replace("frac", "") if c.isalpha()}) > 2:
        return False
    try:
        return sympy.simplify(sympy_parser.parse_expr(expr, global_dict={"__builtins__": {}, **{k: v for k, v in vars(sympy).items() if k[0] != "_"}})) == 0
    except Exception:  # noqa: BLE001  an expression that can't be read isn't equal
        return False


def math_grade(response: str | None, truth: str | None) -> bool:
    """The last box equals the truth in either normal form."""
    got = boxed_content(response)
    truth = boxed_content(truth) if truth and "\\boxed" in truth else truth
    return got is not None and (plain_equal(got, truth) or loose_equal(truth, got))


def reasoned_reward(response: str | None, truth: str | None) -> float:
    """1.0 if the part after the reasoning holds the right box; without a reasoning mark the reward is 0."""
    if response is None or truth is None:
        return 0.0
    if "</think>" in response:
        answer = response.split("</think>")[-1]
    elif "###Response" in response:
        answer = response.split("###Response")[1]
    else:
        return 0.0
    return 1.0 if math_grade(answer, truth) else 0.0


# How a response states its option, in the order they are tried.
STATED_OPTION = [r"(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]


def choice_letter(response: str | None, valid: list[str]) -> str | None:
    """The option letter a response settles on: stated, called correct, or the last free-standing valid capital."""
    text = (response or "").rsplit("</think>", 1)[-1]
    for pattern in STATED_OPTION:
        if (m := re.search(pattern, text, re.I)) and m.group(1).upper() in valid:
            return m.group(1).upper()
    return next((x for x in reversed(re.findall(r"\b([A-Z])\b", text)) if x in valid), None)


def _words(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def choice_score(response: str | None, label: str | None, choices: list[str] | None = None, valid: list[str] | None = None, correct: str | None = None) -> float:
    """Multiple choice: the letter if both sides have one, else the answer's text within the response."""
    if response is None:
        return 0.0
    valid = [v.upper() for v in valid] if valid else list(string.ascii_uppercase[: len(choices)]) if choices else list("ABCDEFGH")
    label = label.strip() if label else None
    correct = correct.strip().upper() if correct else None
    if not correct and label and label.upper() in valid:
        correct = label.upper()
    if not correct and choices and label:
        correct = next((v for v, c in zip(valid, choices) if _words(c) == _words(label)), None)
    got = choice_letter(response, valid)
    if got and correct:
        return float(got == correct)
    texts = [choices[valid.index(correct)]] if correct in valid and choices and valid.index(correct) < len(choices) else []
    said = _words(response.rsplit("</think>", 1)[-1])
    if any(_words(t) and _words(t) in said for t in [*texts, *([label] if label else [])]):
        return 1.0
    return 0.0


def bag_f1(prediction: str | None, truth: str | None) -> float:
    """Token F1 of two normalised texts (the row-wise form of ``token_f1``)."""

    def norm(s: str | None) -> str:
        bare = "".join(c for c in (s or "").lower() if c not in PUNCTUATION)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())

    p, t = norm(prediction), norm(truth)
    if p != t and {p, t} & {"yes", "no", "noanswer"}:
        return 0.0
    same = sum((Counter(p.split()) & Counter(t.split())).values())
    return 2 * same / (len(p.split()) + len(t.split())) if same else 0.0


def arrow(kind: str, f: Callable, *columns: Column) -> Column:
    """A plain function over Arrow batches."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if v is None or v != v else v for v in row)) for row in zip(*series)], index=series[0].index)

    return run(*columns)


def score(rm_type: Column, response: Column, label: Column) -> Column:
    """Scorer by type; ``boxed_`` in front takes the box first; an unknown type raises."""
    kind = F.regexp_replace(rm_type, "^boxed_", "")
    said = F.when(rm_type.startswith("boxed_"), F.coalesce(arrow("string", boxed_content, response), F.lit(""))).otherwise(response)
    return (
        F.when(kind == "math", arrow("boolean", math_grade, said, label).cast("double"))
        .when(kind == "dapo", stated_score(said, label)["score"])
        .when(kind == "deepscaler", arrow("double", reasoned_reward, said, label))
        .when(kind == "f1", arrow("double", bag_f1, said, label))
        .when(kind == "gpqa", arrow("double", choice_score, said, label))
        .when(kind == "random", F.pmod(F.xxhash64(response), F.lit(2)).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown reward type "), F.coalesce(rm_type, F.lit("null")))).cast("double"))
    )


def failure_reward(error: Column, message: Column, client_precheck: Column, penalty: float, precheck: float | None = None, compilation: float | None = None) -> Column:
    """Penalty of a run that didn't complete, by its error class."""
    said = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(penalty)
    if compilation is not None:
        out = F.when((error == "compilation_error") | said.contains("kernel compilation error"), compilation).otherwise(out)
    if precheck is not None:
        early = error.isin("precheck_error", "validation_error", "syntax_error", "import_error") | said.contains("pre-check error") | F.coalesce(client_precheck, F.lit(False))
        out = F.when(early, precheck).otherwise(out)
    return out


def speed_reward(status: Column, failure: Column, decoy: Column, correct: Column, compiled: Column, speedup: Column, coverage: Column, low: float, high: float, w_correct: float, w_speed: float, w_coverage: float, penalty: float) -> Column:
    """Reward of a run: failure and decoy penalties, correctness, clipped speed-up and coverage bonus."""
    gain = F.least(F.coalesce(speedup, F.lit(0.0)), F.lit(high))
    gain = F.when(gain < low, 0.0).otherwise(gain)
    base = w_correct * correct.cast("double") + w_speed * gain + F.when(correct, w_coverage * coverage).otherwise(0.0)
    return F.when(status != "completed", failure).when(F.coalesce(decoy, F.lit(False)), penalty).otherwise(base)


def tool_shaped(score: Column, turns: Column) -> Column:
    """Negative scores are eased by tool calls, at most to -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def team_reward(reward: Column, selector_correct: Column, right: float, wrong: float) -> Column:
    return reward * F.when(selector_correct, right).otherwise(wrong)


def selected_index(s: Column, n: Column) -> Column:
    """The 0-based index after ``Judgment:``, if it is in range."""
    i = F.regexp_extract(s, r"Judgment:\s*(\d+)", 1).try_cast("int") - 1
    return F.when((i >= 0) & (i < n), i)
