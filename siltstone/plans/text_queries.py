"""Queries of graders, text functions and loss masks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import masks as K
from siltstone.functions import shaping as H
from siltstone.functions import text as X
from siltstone.operators import retrieval as R
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
c = F.col
ONE = "o AS (SELECT sample_index, max(prompt) AS prompt, max(response) AS response, max(label) AS label, max(metadata) AS metadata FROM samples GROUP BY sample_index)"


def one(spark, d):
    """Samples without redelivered rows."""
    t = table(spark, d, "samples").groupBy("sample_index")
    return t.agg(*[F.max(x).alias(x) for x in ("prompt", "response", "label", "metadata")])


def sql_norm(x):
    bare = f"translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '[\\s\\p{{Z}}]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@book.add("C02_normalised_answer", f"WITH {ONE} SELECT sample_index, {sql_norm('response')} AS norm FROM o")
def c02(spark, d):
    return one(spark, d).select("sample_index", A.normalise_answer(c("response")).alias("norm"))


@book.add("C04_exact_match", f"WITH {ONE} SELECT sample_index, {sql_norm('label')} = {sql_norm('response')} AS em FROM o WHERE label IS NOT NULL")
def c04(spark, d):
    o = one(spark, d).where("label IS NOT NULL")
    return o.select("sample_index", A.exact_match(c("response"), F.array("label")).alias("em"))


BAG = "SELECT sample_index, t, count(*) AS n FROM (SELECT sample_index, unnest(string_split({x}, ' ')) AS t FROM m) GROUP BY ALL"


@book.add(
    "C03_token_f1",
    f"WITH {ONE}, m AS (SELECT sample_index, {sql_norm('response')} AS p, {sql_norm('label')} AS g FROM o WHERE response IS NOT NULL AND label IS NOT NULL), a AS ({BAG.format(x='p')}), b AS ({BAG.format(x='g')}), k AS (SELECT sample_index, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (sample_index, t) GROUP BY 1) SELECT m.sample_index, round(coalesce(CASE WHEN p <> g AND (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) THEN 0.0 ELSE 2.0 * k / (len(string_split(p, ' ')) + len(string_split(g, ' '))) END, 0.0), 6) AS f1 FROM m LEFT JOIN k USING (sample_index)",
)
def c03(spark, d):
    o = one(spark, d).where("response IS NOT NULL AND label IS NOT NULL")
    m = o.select("sample_index", A.normalise_answer(c("response")).alias("p"), A.normalise_answer(c("label")).alias("g"))
    bags = R.token_overlap(m.select("sample_index", F.split("p", " ").alias("a"), F.split("g", " ").alias("b")), "sample_index", "a", "b")
    f1 = A.token_f1(c("common"), c("n_left"), c("n_right"), c("p"), c("g"))["f1"]
    return m.join(bags, "sample_index").select("sample_index", F.round(f1, 6).alias("f1"))


@book.add("C05_tag_sequence")
def c05(spark, d):
    text = F.concat(F.lit("<|im_start|>assistant\n"), F.coalesce("response", F.lit("")))
    return one(spark, d).select("sample_index", A.arrow("string", lambda t: A.tag_sequence(t)[1], text).alias("verdict"))


@book.add("C06_last_answer_block", f"WITH {ONE}, a AS (SELECT sample_index, regexp_extract_all(coalesce(prompt, '') || coalesce(response, ''), '(?s)<answer>(.*?)</answer>', 1) AS x FROM o) SELECT sample_index, CASE WHEN len(x) >= 2 THEN trim(x[-1]) END AS answer FROM a")
def c06(spark, d):
    whole = F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit("")))
    return one(spark, d).select("sample_index", A.last_answer_block(whole).alias("answer"))


@book.add("C07_information_blocks", f"WITH {ONE} SELECT sample_index, len(regexp_extract_all(response, '(?s)<information>(.*?)</information>', 1)) AS n, trim(regexp_extract(response, '(?s)<information>(.*?)</information>', 1)) AS first FROM o WHERE contains(response, '</information>')")
def c07(spark, d):
    blocks = A.information_blocks(c("response"))
    return one(spark, d).where(c("response").contains("</information>")).select("sample_index", F.size(blocks).cast("bigint").alias("n"), F.coalesce(F.try_element_at(blocks, F.lit(1)), F.lit("")).alias("first"))


@book.add("C08_search_score")
def c08(spark, d):
    """Composite score of search answers against their labels."""
    whole = F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit("")))
    o = one(spark, d).where("label IS NOT NULL").select("sample_index", "label", "response", whole.alias("whole"))
    text = F.concat(F.lit("<|im_start|>assistant\n"), F.coalesce("response", F.lit("")))
    o = o.withColumn("valid", A.arrow("boolean", lambda t: A.tag_sequence(t)[0], text))
    golden, answer = F.array("label"), A.last_answer_block(c("whole"))
    return o.select("sample_index", A.search_score(c("valid"), A.retrieval_hit(c("whole"), golden), answer, F.coalesce(A.exact_match(answer, golden), F.lit(False))).alias("score"))


@book.add("C09_last_boxed", f"WITH {ONE} SELECT sample_index, CASE WHEN NOT regexp_matches(response, '\\\\boxed\\{{[^{{}}]*$') THEN regexp_extract_all(response, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)[-1] END AS box FROM o")
def c09(spark, d):
    return one(spark, d).select("sample_index", A.arrow("string", A.boxed_content, c("response")).alias("box"))


def sql_final(x):
    out = f"string_split({x}, '=')[-1]"
    for a, b in [*A.REPLACED, *[(r, "") for r in A.REMOVED]]:
        q = a.replace("'", "''")
        out = f"replace({out}, '{q}', '{b}')"
    out = f"regexp_replace({out}, '(.*?)(\\$)(.*?)(\\$)(.*)', '$\\3$', 'g')"
    for command in ("text", "textbf", "overline"):
        out = f"regexp_replace({out}, '(\\\\{command}\\{{)(.*?)(\\}})', '\\2', 'g')"
    out = f"regexp_replace({out}, '(\\\\boxed\\{{)(.*)(\\}})', '\\2', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(frac)([^{{])(.)', 'frac{{\\2}}{{\\3}}', 'g'), '(sqrt)([^{{])', 'sqrt{{\\2}}', 'g')"
    out = f"replace({out}, '$', '')"
    return f"(SELECT trim(CASE WHEN regexp_full_match(replace(v, ',', ''), '[0-9]+') THEN replace(v, ',', '') ELSE v END) FROM (SELECT {out} AS v))"


@book.add("C10_final_answer_form", f"WITH l AS (SELECT DISTINCT label FROM samples WHERE label IS NOT NULL UNION SELECT item_label FROM eval_items WHERE item_label IS NOT NULL UNION SELECT '$\\frac12$ units, x = \\boxed{{3}}') SELECT label, {sql_final('label')} AS norm FROM l")
def c10(spark, d):
    labels = table(spark, d, "samples").select("label").union(table(spark, d, "eval_items").select("item_label")).where("label IS NOT NULL")
    extra = spark.createDataFrame([("$\\frac12$ units, x = \\boxed{3}",)], "label string")
    return labels.union(extra).distinct().select("label", A.final_answer(c("label")).alias("norm"))


STATED = "coalesce(regexp_extract_all(right(response, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]')"


@book.add("C11_stated_answer", f"WITH {ONE} SELECT sample_index, {STATED} AS answer FROM o WHERE response IS NOT NULL")
def c11(spark, d):
    return one(spark, d).where("response IS NOT NULL").select("sample_index", A.stated_answer(F.right("response", F.lit(300))).alias("answer"))


@book.add("C12_strict_box")
def c12(spark, d):
    return one(spark, d).select("sample_index", A.arrow("int", lambda r, t: A.strict_box(r, t)[0], c("response"), c("label")).alias("score"))


@book.add("C13_stated_score", f"WITH {ONE}, q AS (SELECT sample_index, {sql_final(STATED)} AS pred, CAST(CAST(trunc(TRY_CAST({sql_final('label')} AS DOUBLE)) AS BIGINT) AS VARCHAR) AS truth FROM o) SELECT sample_index, CASE WHEN pred = truth THEN 1.0 ELSE -1.0 END::DOUBLE AS score, coalesce(pred = truth, false) AS acc FROM q")
def c13(spark, d):
    return one(spark, d).select("sample_index", A.stated_score(c("response"), c("label")).alias("s")).select("sample_index", "s.score", "s.acc")


@book.add("C14_plain_math_form")
def c14(spark, d):
    return one(spark, d).where("label IS NOT NULL").select("sample_index", A.arrow("string", A.plain_math, c("label")).alias("norm"))


@book.add("C15_plain_equality")
def c15(spark, d):
    o = one(spark, d)
    return o.select("sample_index", A.arrow("boolean", lambda r, t: A.plain_equal(A.boxed_content(r), t), c("response"), c("label")).alias("equal"))


@book.add("C16_loose_equality")
def c16(spark, d):
    return one(spark, d).select("sample_index", A.arrow("boolean", lambda r, t: A.loose_equal(t, A.boxed_content(r)), c("response"), c("label")).alias("equal"))


@book.add("C17_math_grade")
def c17(spark, d):
    return one(spark, d).select("sample_index", A.arrow("boolean", A.math_grade, c("response"), c("label")).alias("correct"))


@book.add("C18_reasoned_reward")
def c18(spark, d):
    return one(spark, d).select("sample_index", A.arrow("double", A.reasoned_reward, c("response"), c("label")).alias("reward"))


@book.add("C19_choice_score")
def c19(spark, d):
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.pmod("sample_index", F.lit(4)) + 1).cast("int"))
    said = F.concat(F.lit("<think>B or C?</think> The answer is "), letter)
    return one(spark, d).select("sample_index", A.arrow("double", A.choice_score, said, F.lit("C")).alias("score"))


book.sql["C19_choice_score"] = f"WITH {ONE} SELECT sample_index, CASE WHEN sample_index % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM o"


@book.add("C01_scorer_dispatch")
def c01(spark, d):
    """Every sample by the scorer that its metadata names; a null label is never matched, a missing type is an error."""
    rm_type = F.trim(F.get_json_object("metadata", "$.rm_type"))
    return one(spark, d).select("sample_index", rm_type.alias("rm_type"), A.score(rm_type, c("response"), c("label")).alias("score"))


@book.add("C21_hash_reward", "SELECT count(*) AS n, true AS both_values FROM events")
def c21(spark, d):
    r = table(spark, d, "events").select(F.pmod(F.xxhash64("event_id"), F.lit(2)).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("r") == 2).alias("both_values"))


@book.add("C22_tool_shaped_reward", "WITH e AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -1.0 END::DOUBLE AS s, event_id % 9 AS t FROM events) SELECT event_id, round(CASE WHEN s < 0 THEN least(-0.6, s + (t - 2) / 2.0 * 0.1) ELSE s END, 6)::DOUBLE AS score FROM e")
def c22(spark, d):
    s = F.when(c("event_type") == "purchase", 1.0).otherwise(-1.0)
    return table(spark, d, "events").select("event_id", F.round(A.tool_shaped(s, F.pmod("event_id", F.lit(9))), 6).alias("score"))


@book.add(
    "C23_speed_reward",
    "SELECT event_id, round(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN -0.5 WHEN event_id % 3 = 0 THEN -0.7 ELSE -1.0 END WHEN event_id % 13 = 0 THEN -1.0 ELSE 0.3 * CAST(value > 50 AS INTEGER) + 0.5 * CASE WHEN least(value / 100.0, 3.0) < 1.0 THEN 0.0 ELSE least(value / 100.0, 3.0) END + CASE WHEN value > 50 THEN 0.2 * (event_id % 10) / 10.0 ELSE 0.0 END END, 6)::DOUBLE AS reward FROM events",
)
def c23(spark, d):
    e = table(spark, d, "events")
    k = c("event_id")
    error = F.when(k % 5 == 0, "syntax_error").when(k % 3 == 0, "compilation_error").otherwise("other")
    failure = A.failure_reward(error, F.lit(None).cast("string"), F.lit(False), -1.0, precheck=-0.5, compilation=-0.7)
    status = F.when(c("event_type") == "error", "failed").otherwise("completed")
    reward = A.speed_reward(status, failure, k % 13 == 0, c("value") > 50, F.lit(True), c("value") / 100.0, (k % 10) / 10.0, 1.0, 3.0, 0.3, 0.5, 0.2, -1.0)
    return e.select("event_id", F.round(reward, 6).alias("reward"))


@book.add("C24_team_reward", "SELECT event_id, value * CASE WHEN event_type = 'purchase' THEN 1.2 ELSE 0.8 END::DOUBLE AS reward FROM events")
def c24(spark, d):
    return table(spark, d, "events").select("event_id", A.team_reward(c("value"), c("event_type") == "purchase", 1.2, 0.8).alias("reward"))


@book.add("C25_selected_index", "SELECT event_id, CASE WHEN event_id % 7 BETWEEN 1 AND 4 THEN CAST(event_id % 7 - 1 AS INTEGER) END AS idx FROM events")
def c25(spark, d):
    said = F.concat(F.lit("All fine. Judgment: "), F.pmod("event_id", F.lit(7)).cast("string"))
    return table(spark, d, "events").select("event_id", A.selected_index(said, F.lit(4)).alias("idx"))


@book.add("C26_repetition")
def c26(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", A.arrow("boolean", X.has_repetition, c("text")).alias("repeats"), A.arrow("double", X.compression_ratio, c("text")).alias("ratio"))


@book.add("C27_think_split", f"WITH {ONE} SELECT sample_index, CASE WHEN contains(response, '</think>') THEN string_split(response, '</think>')[-1] ELSE response END AS answer, regexp_replace(response, '(?is)<think>.*?</think>', '', 'g') AS bare FROM o")
def c27(spark, d):
    return one(spark, d).select("sample_index", X.after_reasoning(c("response")).alias("answer"), X.without_reasoning(c("response")).alias("bare"))


@book.add("C28_last_sections")
def c28(spark, d):
    text = F.concat(F.lit("<plan>a</plan><code>old</code><plan>b</plan><code>"), c("event_type"), F.lit("</code><plan>c</plan>"))
    return table(spark, d, "events").select("event_id", A.arrow("string", lambda t: X.last_sections(t, ["plan", "code"]).get("code"), text).alias("code"))


book.sql["C28_last_sections"] = "SELECT event_id, event_type AS code FROM events"


@book.add("C29_search_action", f"WITH {ONE}, x AS (SELECT sample_index, CASE WHEN strpos(response, '<search>') > 0 AND contains(response, '</search>') AND (strpos(response, '<answer>') = 0 OR strpos(response, '<search>') < strpos(response, '<answer>')) THEN 'search' WHEN contains(response, '<answer>') AND contains(response, '</answer>') THEN 'answer' END AS a, response FROM o) SELECT sample_index, a AS action, CASE a WHEN 'search' THEN trim(regexp_extract(response, '(?s)<search>(.*?)</search>', 1)) WHEN 'answer' THEN trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)) ELSE '' END AS content FROM x")
def c29(spark, d):
    return one(spark, d).select("sample_index", X.search_action(F.coalesce("response", F.lit(""))).alias("x")).select("sample_index", "x.action", "x.content")


PY = "(?s)```python\\s*(.*?)\\s*```"


@book.add("C30_tool_action", f"WITH {ONE} SELECT sample_index, CASE WHEN regexp_matches(response, '{PY}') THEN 'code' END AS action, trim(regexp_extract(response, '{PY}', 1)) AS content FROM o WHERE response IS NOT NULL")
def c30(spark, d):
    o = one(spark, d).where("response IS NOT NULL")
    return o.select("sample_index", X.tool_action(c("response")).alias("x")).select("sample_index", "x.action", "x.content")


@book.add("C31_complete_response", f"WITH {ONE} SELECT sample_index, CASE WHEN contains(response, '</search>') THEN string_split(response, '</search>')[1] || '</search>' WHEN contains(response, '</answer>') THEN string_split(response, '</answer>')[1] || '</answer>' ELSE response END AS text FROM o")
def c31(spark, d):
    return one(spark, d).select("sample_index", X.complete_search_text(c("response")).alias("text"))


@book.add("C32_tool_call", "SELECT event_id, event_type AS name, CAST(event_id AS VARCHAR) AS k FROM events")
def c32(spark, d):
    body = F.concat(F.lit('<tool_call>{"name": "old", "arguments": {}}</tool_call> then <tool_call>{"name": "'), c("event_type"), F.lit('", "arguments": {"k": '), c("event_id").cast("string"), F.lit("}}</tool_call>"))
    return table(spark, d, "events").select("event_id", X.tool_call(body).alias("x")).select("event_id", "x.name", F.get_json_object("x.arguments", "$.k").alias("k"))


@book.add(
    "C33_call_to_action",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'view') OR event_id % 5 = 0 THEN 'respond' ELSE event_type END AS action,
CASE WHEN event_type IN ('error', 'view') OR event_id % 5 = 0 THEN '{"content":"' || event_type || '"}' ELSE '{"k": ' || event_id || '}' END AS kwargs FROM events""",
)
def c33(spark, d):
    """The first of two calls wins; cut-off parameters, a list of them and no call at all fall back to a reply."""
    good = F.concat(F.lit('{"k": '), c("event_id").cast("string"), F.lit("}"))
    parameters = F.when(c("event_type") == "error", F.substring(good, 1, 5)).when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    call = lambda name, p: F.struct(name.alias("name"), p.alias("parameters"))
    calls = F.when(c("event_type") == "view", F.array().cast("array<struct<name:string,parameters:string>>")).otherwise(F.array(call(c("event_type"), parameters), call(F.lit("second"), good)))
    return table(spark, d, "events").select("event_id", X.call_to_action(calls, c("event_type")).alias("x")).select("event_id", c("x.name").alias("action"), c("x.kwargs").alias("kwargs"))


@book.add("C34_balanced_json", "SELECT event_id, '{\"a\": \"}\", \"k\": ' || event_id || '}' AS body FROM events")
def c34(spark, d):
    said = F.concat(F.lit('text {"a": "}", "k": '), c("event_id").cast("string"), F.lit('} tail {"x": 1}'))
    return table(spark, d, "events").select("event_id", A.arrow("string", X.balanced_json, said).alias("body"))


@book.add("C35_answer_fallback", f"WITH {ONE} SELECT sample_index, left(list_filter(list_transform(string_split(response, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '')[-1], 512) AS answer FROM o WHERE response IS NOT NULL")
def c35(spark, d):
    return one(spark, d).where("response IS NOT NULL").select("sample_index", X.last_line(c("response")).alias("answer"))


@book.add("C35_boxed_or_last_line", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'last line' WHEN event_type = 'view' THEN 'x{' || event_id || '}' ELSE CAST(event_id AS VARCHAR) END AS answer FROM events")
def c35b(spark, d):
    """The last box if it holds something, else the last line."""
    inner = F.when(c("event_type") == "error", " ").when(c("event_type") == "view", F.concat(F.lit("x{"), c("event_id").cast("string"), F.lit("}"))).otherwise(c("event_id").cast("string"))
    said = F.concat(F.lit("\\boxed{old} so \\boxed{"), inner, F.lit("}\nlast line\n \n"))
    box = F.trim(A.arrow("string", A.boxed_content, said))
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(box != "", box), X.last_line(said)).alias("answer"))


@book.add("C36_tool_step_outcome", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'no_call' WHEN event_type = 'view' THEN 'bad_tool' WHEN event_id % 2 = 0 THEN 'missing_answer' ELSE 'scored' END AS outcome FROM events")
def c36t(spark, d):
    name = F.when(c("event_type") == "view", "search").otherwise("score")
    args = F.when(F.pmod("event_id", F.lit(2)) == 0, '{"answer": " "}').otherwise('{"answer": "12"}')
    call = F.concat(F.lit('<tool_call>{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}</tool_call>"))
    return table(spark, d, "events").select("event_id", X.step_outcome(F.when(c("event_type") == "error", "no call here").otherwise(call), "score").alias("outcome"))


@book.add("C36_step_outcome", f"WITH {ONE} SELECT sample_index, CASE WHEN response IS NULL OR NOT contains(response, '<answer>') THEN 'no_call' WHEN trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)) = '' THEN 'missing_answer' ELSE 'scored' END AS outcome FROM o")
def c36(spark, d):
    answer = F.trim(F.regexp_extract("response", r"(?s)<answer>(.*?)</answer>", 1))
    outcome = F.when(c("response").isNull() | ~c("response").contains("<answer>"), "no_call").when(answer == "", "missing_answer").otherwise("scored")
    return one(spark, d).select("sample_index", outcome.alias("outcome"))


@book.add("C37_passages", "SELECT doc_id, 'Doc 1(Title: ' || string_split(text, chr(10))[1] || ') ' || array_to_string(string_split(text, chr(10))[2:], chr(10)) || chr(10) AS block FROM documents WHERE text IS NOT NULL")
def c37(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.passages(F.array("text")).alias("block"))


@book.add("C38_snippet_segments", "SELECT doc_id, len(list_filter(string_split(replace(text, '. ', '...'), '...'), lambda x: len(regexp_split_to_array(trim(x, ' \t\n\r'), '[ \\t\\n\\r\\f]+')) > 5)) AS n FROM documents")
def c38(spark, d):
    docs = table(spark, d, "documents")
    dotted = F.replace(c("text"), F.lit(". "), F.lit("..."))
    segments = F.filter(F.split(dotted, r"\.\.\."), lambda x: F.size(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+")) > 5)
    return docs.select("doc_id", F.size(segments).cast("bigint").alias("n"))


@book.add("C38_clean_query", f"WITH {ONE} SELECT sample_index, trim(regexp_replace(regexp_replace(prompt, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM o")
def c38q(spark, d):
    return one(spark, d).select("sample_index", X.clean_query(c("prompt")).alias("query"))


@book.add("C39_truncate_middle", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 50) || '...(truncated)...' || right(text, 50) END AS short, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 30) || '... [' || length(text) || ' chars]' END AS compact FROM documents")
def c39(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_middle(c("text"), 100).alias("short"), X.compact(c("text"), 30).alias("compact"))


@book.add("C40_feedback_template", "SELECT event_id, 'Result: {\"ok\":' || CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END || ',\"value\":' || event_id || '} end' AS said FROM events")
def c40(spark, d):
    result = F.to_json(F.struct((c("event_type") != "error").alias("ok"), c("event_id").alias("value")))
    return table(spark, d, "events").select("event_id", F.replace(F.lit("Result: {feedback} end"), F.lit("{feedback}"), result).alias("said"))


@book.add("C41_chat_with_tools")
def c41(spark, d):
    render = A.arrow("string", lambda t: K.render([{"role": "user", "content": t}], [{"name": "code"}], True), c("event_type"))
    return table(spark, d, "events").select("event_id", render.alias("text"))


book.sql["C41_chat_with_tools"] = "SELECT event_id, '<|tools|>[{''name'': ''code''}]<|end|>' || chr(10) || '<|im_start|>user' || chr(10) || event_type || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM events"


@book.add("C43_delta_accumulation", "SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS text FROM events GROUP BY user_id")
def c43(spark, d):
    delta = F.to_json(F.struct(F.struct(c("event_type").alias("content")).alias("delta")))
    parts = table(spark, d, "events").select("user_id", "event_id", F.get_json_object(delta, "$.delta.content").alias("t"))
    return parts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]), "").alias("text"))


@book.add("C44_binding_checks", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 END AS line, 'b_' || event_type AS symbols FROM events")
def c44(spark, d):
    code = F.concat(F.lit("int x;\nREGISTER_BINDING(f, (g))"), F.when(F.pmod("event_id", F.lit(2)) == 0, "\n").otherwise(";\n"), F.lit("EXPORT_FUNCTION(b_"), c("event_type"), F.lit(", f);"))
    return table(spark, d, "events").select("event_id", A.arrow("int", X.missing_semicolon, code).alias("line"), F.array_join(X.exported_symbols(code), ",").alias("symbols"))


@book.add("C45_extension_calls", "SELECT event_id, 'run_' || event_type AS calls FROM events")
def c45(spark, d):
    code = F.concat(F.lit("import ext\nx = ext.run_"), c("event_type"), F.lit("(1)\nother.call(2)\n"))
    return table(spark, d, "events").select("event_id", A.arrow("string", lambda t: ",".join(X.extension_calls(t, "ext")), code).alias("calls"))


@book.add("F23_code_precheck", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'syntax error in line 1' WHEN 2 THEN 'no extension call' END AS problem FROM events")
def f23(spark, d):
    code = F.element_at(F.array(F.lit(" "), F.lit("def f(:"), F.lit("x = 1"), F.lit("import ext\next.run(1)")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", A.arrow("string", lambda t: X.precheck(t, "ext"), code).alias("problem"))


@book.add("C46_done_cascade", "SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN true END, CASE WHEN event_type = 'error' THEN true END, event_id % 8 >= 7) AS done FROM events")
def c46(spark, d):
    flags = [F.when(c("event_type") == "purchase", True), F.when(c("event_type") == "error", True)]
    return table(spark, d, "events").select("event_id", F.coalesce(*flags, F.pmod("event_id", F.lit(8)) >= 7).alias("done"))


@book.add("F22_code_safety", f"WITH {ONE}, k AS (SELECT sample_index, regexp_extract(response, '(?s)```python\\n(.*?)```', 1) AS code FROM o WHERE contains(response, '```python')) SELECT sample_index, CASE WHEN contains(code, '__global__') THEN '__\\w+__' WHEN regexp_matches(code, 'import\\s+numpy') THEN 'numpy' END AS refusal FROM k")
def f22(spark, d):
    code = F.regexp_extract("response", r"(?s)```python\n(.*?)```", 1)
    return one(spark, d).where(c("response").contains("```python")).select("sample_index", X.code_refusal(code).alias("refusal"))


@book.add("P21_feedback_classes", "SELECT status_code, error_text, CASE WHEN error_text IS NULL OR error_text = '' THEN NULL WHEN lower(error_text) LIKE '%timed out%' OR lower(error_text) LIKE '%timeout%' THEN 'timeout' ELSE 'other' END AS class, count(*) AS n FROM request_results GROUP BY ALL")
def p21(spark, d):
    r = table(spark, d, "request_results")
    return r.groupBy("status_code", "error_text", X.feedback_class(c("error_text")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@book.add("P22_failure_completion", "SELECT sample_index, CASE WHEN status <> 'completed' THEN 0.0 ELSE reward END AS reward, CASE WHEN status <> 'completed' THEN coalesce(status, 'unknown') END AS error FROM samples")
def p22(spark, d):
    bad = c("status") != "completed"
    return table(spark, d, "samples").select("sample_index", F.when(bad, 0.0).otherwise(c("reward")).alias("reward"), F.when(bad, F.coalesce("status", F.lit("unknown"))).alias("error"))


@book.add("P04_chat_render", f"WITH {ONE} SELECT sample_index, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM o WHERE prompt IS NOT NULL")
def p04(spark, d):
    return one(spark, d).where("prompt IS NOT NULL").select("sample_index", H.chat_text(H.as_conversation(c("prompt"))).alias("text"))


@book.add("P02_media_parts", "SELECT event_id, CAST(3 AS INTEGER) AS n, 'image' AS kind FROM events")
def p02(spark, d):
    text = F.concat(F.lit("see "), F.lit("<image>"), c("event_type"))
    parts = H.media_parts(text, ["<image>", "<video>"])
    e = table(spark, d, "events")
    checked = H.count_media(text, ["<image>", "<video>"], F.lit(1))
    return e.select("event_id", (F.size(parts) + checked - 1).alias("n"), parts[1]["type"].alias("kind"))


def _mask_stats(spark, d, kind):
    """Token counts and masked texts of two-message conversations made from samples."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p, r in zip(pairs["p"], pairs["r"]):
            ids, mask = K.loss_mask(kind, [{"role": "user", "content": p or ""}, {"role": "assistant", "content": r or ""}])
            out.append((len(ids), sum(mask)))
        return pd.DataFrame(out, columns=["n_tokens", "n_learned"])

    f = F.pandas_udf(lambda p, r: run(pd.DataFrame({"p": p, "r": r})), "n_tokens int, n_learned int")
    o = one(spark, d).select("sample_index", f(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit(""))).alias("x"))
    return o.select("sample_index", "x.n_tokens", "x.n_learned")


MASK = f"WITH {ONE} SELECT sample_index, CAST(length(coalesce(prompt, '')) + length(coalesce(response, '')) + {{n}} AS INTEGER) AS n_tokens, CAST(length(coalesce(response, '')) + 11 AS INTEGER) AS n_learned FROM o"


@book.add("M01_mask_by_message", MASK.format(n=len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")))
def m01(spark, d):
    return _mask_stats(spark, d, "by_message")


@book.add("M04_mask_single_response", MASK.format(n=len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")))
def m04(spark, d):
    return _mask_stats(spark, d, "single_response")


@book.add("M03_mask_by_offsets", MASK.format(n=len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")))
def m03(spark, d):
    def run(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(p, r):
            ids, mask = K.by_offsets([{"role": "user", "content": a}, {"role": "assistant", "content": b}], lambda t: [(ord(x), i, i + 1) for i, x in enumerate(t)], "\0")
            out.append((len(ids), sum(mask)))
        return pd.DataFrame(out, columns=["n_tokens", "n_learned"])

    f = F.pandas_udf(run, "n_tokens int, n_learned int")
    return one(spark, d).select("sample_index", f(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit(""))).alias("x")).select("sample_index", "x.n_tokens", "x.n_learned")


@book.add("M07_left_padded_mask", "SELECT event_id, CAST(5 + event_id % 3 AS INTEGER) AS size, CAST(2 AS BIGINT) AS total FROM events")
def m07(spark, d):
    mask = F.concat(F.array_repeat(F.lit(0), (F.pmod("event_id", F.lit(3)) + 3).cast("int")), F.array(F.lit(1), F.lit(1)))
    return table(spark, d, "events").select("event_id", F.size(mask).alias("size"), F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


_TURN = "'<|im_start|>' || CASE WHEN {r} THEN 'assistant' ELSE 'user' END || chr(10) || event_type || '<|im_end|>' || chr(10)"
_LEARN = "event_type IN ('purchase', 'click')"


@book.add(
    "M05_mask_positions",
    f"WITH e AS (SELECT user_id, event_id, length({_TURN.format(r=_LEARN)}) AS n, {_LEARN} AS learn FROM events), m AS (SELECT user_id, string_agg(CASE WHEN learn THEN repeat('0', 22) || repeat('1', CAST(n - 22 AS INTEGER)) ELSE repeat('0', CAST(n AS INTEGER)) END, '' ORDER BY event_id) AS mask FROM e GROUP BY user_id) SELECT user_id, mask AS by_message, mask AS by_prefixed_message, mask AS by_offsets FROM m",
)
def m05p(spark, d):
    """The masks of whole multi-turn chats, position by position, by three variants."""
    kinds = ("by_message", "by_prefixed_message", "by_offsets")

    def run(rows: pd.Series) -> pd.DataFrame:
        chats = [[{"role": "assistant" if x["learn"] else "user", "content": x["text"]} for x in chat] for chat in rows]
        return pd.DataFrame({k: ["".join(map(str, K.loss_mask(k, m)[1])) for m in chats] for k in kinds})

    masks = F.pandas_udf(run, ", ".join(f"{k} string" for k in kinds))
    turn = F.struct("event_id", c("event_type").isin("purchase", "click").alias("learn"), c("event_type").alias("text"))
    chats = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(turn)).alias("chat"))
    return chats.select("user_id", masks("chat").alias("x")).select("user_id", "x.*")


@book.add("M09_role_token_mask", f"SELECT user_id, CAST(sum(length(event_type)) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN {_LEARN} THEN length(event_type) ELSE 0 END) AS BIGINT) AS n_learned, string_agg(repeat(CASE WHEN {_LEARN} THEN '1' ELSE '0' END, CAST(length(event_type) AS INTEGER)), '' ORDER BY event_id) AS mask FROM events GROUP BY user_id")
def m09(spark, d):
    """Tokens of each turn by role: an assistant's count, all others don't; one token per character."""
    rows = table(spark, d, "events").withColumn("role", F.when(c("event_type").isin("purchase", "click"), "assistant").otherwise("user"))
    return K.role_masks(rows, ["user_id"], "event_id", "role", F.length("event_type"))
