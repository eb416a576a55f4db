"""Graders that no SQL can follow, on cases worked out by hand: the SQL states the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import text as X
from siltstone.plans.book import Book

book = Book()
c = F.col
THINK = "<think>a</think>"
FOUND = "<search>q</search><information>Doc 1: Red fox</information>"

#: Per query: its function on (response, truth), the result's type, and cases (response, truth, result).
CASES = {
    "C05_tag_sequence_cases": (
        lambda r, t: A.arrow("boolean", lambda x: A.tag_sequence(x)[0], F.concat(F.lit("<|im_start|>assistant\n"), r)),
        "boolean",
        [
            (f"{THINK}<answer>x</answer>", None, True),
            (f"{THINK}{FOUND}{THINK}<answer>x</answer>", None, True),
            (f"{THINK} stray <answer>x</answer>", None, False),
            ("<answer>x</answer>", None, False),
            (f"{THINK}<answer>x", None, False),
            (f"{THINK}<information>x</information><answer>x</answer>", None, False),
        ],
    ),
    "C12_strict_box_cases": (
        lambda r, t: A.arrow("int", lambda x, y: A.strict_box(x, y)[0], r, t),
        "int",
        [("so \\boxed{12}", "12", 1), ("\\boxed{12} then \\boxed{13}", "12", -1), ("\\boxed{12}" + " far" * 30, "12", -1), ("\\boxed{ 12}", "12", -1), ("no box", "12", -1), (None, "12", -1)],
    ),
    "C14_plain_math_form_cases": (
        lambda r, t: A.arrow("string", A.plain_math, r),
        "string",
        [
            ("\\dfrac12", None, "\\frac{1}{2}"), ("0.5", None, "\\frac{1}{2}"), ("3/4", None, "\\frac{3}{4}"), (".7", None, "0.7"), ("x = 5", None, "5"), ("\\sqrt2", None, "\\sqrt{2}"),
            ("\\text{ yes }", None, "yes"), ("10\\%", None, "10"), ("90^\\circ", None, "90"), ("\\left(1,2\\right)", None, "(1,2)"), ("", None, ""),
        ],
    ),
    "C15_plain_equality_cases": (
        lambda r, t: A.arrow("boolean", A.plain_equal, r, t),
        "boolean",
        [("1/2", "\\tfrac{1}{2}", True), ("0.5", "1/2", True), ("2/4", "1/2", False), ("\\$5", "5", True), ("5", None, False), ("x=7", "7", True), ("long=7", "7", False)],
    ),
    "C16_loose_equality_cases": (
        lambda r, t: A.arrow("boolean", A.loose_equal, t, r),
        "boolean",
        [
            ("1,000", "1000", True), ("5 cm", "5", True), ("4/2", "2", False), ("2", "4/2", False), ("2/4", "1/2", False), ("(1, 2)", "(1,2)", True), ("[1,2]", "(1,2)", False), ("(1,2,3)", "(1,2)", False),
            ("5.5", "5", False), ("5.0", "5", True), ("0.25", "1/4", True), ("9^9^9", "x^9^9", False), ("", "1", False), (None, "1", False), ("Red", "red", True),
        ],
    ),
    "C17_math_grade_cases": (
        lambda r, t: A.arrow("boolean", A.math_grade, r, t),
        "boolean",
        [
            ("so \\boxed{42}", "42", True), ("so 42", "42", False), ("\\boxed{41} no, \\boxed{42}", "42", True), ("\\fbox{42}", "42", False), ("\\boxed{\\frac{1}{2}}", "0.5", True),
            ("\\boxed{1{,}000}", "1,000", True), ("\\boxed{4/2}", "2", False), ("\\boxed{42", "42", False), ("\\boxed{42}", "\\boxed{42}", True), (None, "42", False),
        ],
    ),
    "C18_reasoned_reward_cases": (
        lambda r, t: A.arrow("double", A.reasoned_reward, r, t),
        "double",
        [
            ("<think>\\boxed{1}</think> \\boxed{2}", "2", 1.0), ("<think>\\boxed{2}</think> 2", "2", 0.0), ("\\boxed{2}", "2", 0.0), ("x ###Response \\boxed{2}", "2", 1.0),
            ("<think>a</think> \\boxed{3} </think> \\boxed{2}", "2", 1.0), (None, "2", 0.0),
        ],
    ),
    "C26_repetition_cases": (
        lambda r, t: A.arrow("boolean", X.has_repetition, r),
        "boolean",
        [("ab" * 6000, None, True), ("ab" * 5000, None, False), ("", None, False), (None, None, False), (" ".join(str(i * i * 7919) for i in range(2000)), None, False)],
    ),
}


def _value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _register(name: str, function, kind: str, cases: list[tuple]) -> None:
    sql_type = {"boolean": "BOOLEAN", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}[kind]
    rows = ", ".join(f"({i}, {_value(want)})" for i, (_, _, want) in enumerate(cases))

    @book.add(name, f"SELECT CAST(a AS INTEGER) AS case_no, CAST(b AS {sql_type}) AS result FROM (VALUES {rows}) AS t(a, b)")
    def run(spark, d):
        df = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(cases)], "case_no int, response string, truth string")
        return df.select("case_no", function(c("response"), c("truth")).alias("result"))


for _name, (_function, _kind, _cases) in CASES.items():
    _register(_name, _function, _kind, _cases)
