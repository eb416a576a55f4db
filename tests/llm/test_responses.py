import random

import pytest

from siltstone.llm import responses as R

Q = "Why does the queue depth change when the reward worker recovers after a weight update?"
CASES = [
    (Q, None, "empty"),
    (Q, "", "empty"),
    (Q, " ​\n", "empty"),
    (Q, "```\n```", "empty"),
    (Q, "<answer></answer>", "empty"),
    (Q, "\\boxed{}", "empty"),
    (Q, "<think>\nA thought.\n</think>\n", "empty"),
    (Q, '""', "empty"),
    (Q, "Q: " + Q, "copied_question"),
    (Q, Q.upper() + "\n\n" + Q, "copied_question"),
    (Q, Q[: int(len(Q) * 0.87)], "copied_question"),
    (Q, Q + " It changes because the worker drains the queue and the router sends it new groups to score at once.", None),
    (Q, "The worker drains the queue, and then the rou", "truncated"),
    (Q, "<think>\nThe worker drains", "truncated"),
    (Q, "Here is one version.\n\n```python\ndef f(x):\n    return x", "truncated"),
    (Q, "Based on this, the answer is <answer>Kas", "truncated"),
    (Q, "1. The area is 4.\n2. The square", "truncated"),
    (Q, "Try this:\n\n- flush the buffer\n- split the batch", None),
    (Q, "Kinstorren", None),
    (Q, "757", None),
    (Q, "It holds.\n\n**Answer:** 28", None),
    (Q, "Hence the final answer is $\\boxed{12}$", None),
    (Q, "因为队列深度会随着奖励服务的恢复而变化，建议先清空缓冲区。", "wrong_language"),
    (Q, "Am besten verkleinert man die Stapelgröße und wiederholt die Messung mit der neuen Einstellung.", "wrong_language"),
    ("Translate the following text into German:\n\n" + Q, "Am besten verkleinert man die Stapelgröße und wiederholt die Messung.", None),
    ("Translate the following text into German:\n\n" + Q, "It is best to reduce the batch size and to repeat the measurement on the same data.", "wrong_language"),
    (Q + "\n\n参考：每人擦亮八十八件渔网后返回，途中失去一百零三件，求剩余灯笼。", "因为队列深度会随着奖励服务的恢复而变化。", None),
    (None, "It is fine.", None),
]


@pytest.mark.parametrize("prompt,response,want", CASES)
def test_local(prompt, response, want):
    assert R.local_defect(prompt, response)[0] == want


def test_common_subsequence():
    assert R.common(list("abcbdab"), list("bdcaba")) == 4


ASKED = ["Who built the bridge at Tasol?", "Sort these names by length.", "What is the sum of all odd divisors?", "Write a loop that drains a queue.", "Where does the canal end?", "Give two uses of a prefix cache.", "How tall is the lighthouse?"]


def test_defects_over_a_table(spark):
    rows = [(i, p, r, "label") for i, (p, r, _) in enumerate(CASES)]
    want = {i: d for i, (_, _, d) in enumerate(CASES) if d}
    n = 100
    for k, q in enumerate(ASKED):
        rows.append((n + k, q, f"I'm sorry, but I can't help with this {'task' if k % 2 else 'topic'}. I hope you understand.", "x"))
        want[n + k] = "refusal"
    rows.append((200, Q, "I'm sorry, but I can't help with this topic. The depth changes because the worker drains the queue of 12 groups.", "x"))
    rows += rows[:10]
    df = spark.createDataFrame(rows, "sample_index bigint, prompt string, response string, defect string").repartition(3)
    got = {r["sample_index"]: r["defect"] for r in R.defects(df).collect()}
    assert got == want
    assert R.defects(df.limit(0)).count() == 0


def test_clusters_join_near_equal_openings(spark):
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base + " more", "something else entirely that has its own words here", base.replace("word59", "other")]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["cluster"] for r in R.clusters(df.mapInArrow(R._sign, R.SIGNED)).collect()}
    assert got == {0: 0, 1: 0, 3: 0}


@pytest.mark.parametrize("n", [8, 12, 25])
def test_linking_recall_against_brute_force(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join(["so", *base]), " ".join([*base[:-1], "other"])]
    texts = sorted(set(texts))
    sets = [R.shingles(t.split(" ")) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["cluster"] for r in R.clusters(df.mapInArrow(R._sign, R.SIGNED)).collect()}
    assert pairs and sum(i in got and got[i] == got.get(j) for i, j in pairs) >= 0.95 * len(pairs)


def test_prompts_own_words_are_masked():
    a = R.opening_of("What does the reward worker do?", "You asked about the reward worker; however, I'm not in a position to share anything on it.")
    b = R.opening_of("How does the eval loop end?", "You asked about the eval loop; however, I'm not in a position to share anything on it.")
    assert a.form != b.form and a.masked == b.masked.replace("the eval ·", "the ·")
    assert R.opening_of("Say it.", "The result is 12.").numbers != R.opening_of("Say it.", "The result is 13.").numbers
    assert R.opening_of("Say it.", "Bruvakorren.") is None


def test_related_prompts_and_varying_numbers_are_no_refusals(spark):
    q = "We ask how many of the lamps that stand here are not lit when all the others are lit in the {}"
    rows = [(k, q.format(w), "I do not know of any lamps there.") for k, w in enumerate(("hall", "yard", "barn", "shop", "tower"))]
    rows += [(10 + k, a, f"We do not get more than {k + 3} of these.") for k, a in enumerate(ASKED)]
    df = spark.createDataFrame(rows, "sample_index bigint, prompt string, response string")
    assert R.defects(df).count() == 0




def test_recurring_openings_reveal_refusals(spark):
    rows = [(k, q, "Such things are off-limits for us.") for k, q in enumerate(ASKED)]
    rows += [(10 + k, q, f"Such things do not trouble us. {w} is what the record says.") for k, (q, w) in enumerate(zip(ASKED, ("Basalt", "Ochre", "Teal", "Umber", "Ivory", "Coral", "Slate")))]
    rows += [(20 + k, q, "The records of the harbour name it.") for k, q in enumerate(ASKED)]
    rows += [(30, ASKED[0], "Our own view is not as clear."), (31, ASKED[1], "Our own view is not as clear.")]  # too few prompts
    df = spark.createDataFrame(rows, "sample_index bigint, prompt string, response string").repartition(3)
    assert {r["sample_index"]: r["defect"] for r in R.defects(df).collect()} == {k: "refusal" for k in range(7)}


def test_refusals_of_any_length_and_with_numbers(spark):
    tail = " I hope you understand. Thank you for asking. Let me know what else you need. Feel free to ask again. Is there something else? I am happy to try."
    rows = [(k, q, "I can't help with that. Please call 988.") for k, q in enumerate(ASKED)]
    rows += [(20, ASKED[0], "I can't help with that." + tail), (21, ASKED[1], "I can't help with that. " + "I hope that you understand why this is so. " * 20)]
    rows += [(30, ASKED[2], "I can't help with a sketch. The sum is 403."), (31, ASKED[3], "I can't help with tests.\n```python\nwhile queue:\n    queue.pop()\n```")]
    df = spark.createDataFrame(rows, "sample_index bigint, prompt string, response string").repartition(3)
    assert {r["sample_index"]: r["defect"] for r in R.defects(df).collect()} == {k: "refusal" for k in (*range(7), 20, 21)}


def test_copies_without_articles_several_times_over():
    prompt = "What is the sum of all the divisors of a number that the worker drains?"
    assert R.local_defect(prompt, "What is sum of all divisors of number that worker drains? " * 3)[0] == "copied_question"


@pytest.mark.parametrize("block", [R.BLOCK, 2])
def test_clusters_compare_all_members_of_a_band(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    w = [f"word{i}" for i in range(60)]
    texts = [" ".join(w[:40]), " ".join(w), " ".join(w) + " more", " ".join(w[20:])]
    df = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)], "id bigint, text string, bands array<bigint>")  # all share one band, whose least member is like none
    got = {r["id"]: r["cluster"] for r in R.clusters(df).collect()}
    assert got == {1: 1, 2: 1}
    pairs = R.near_pairs(texts, [0, 1, 0, 1], True)
    assert sorted(map(sorted, pairs)) == [[1, 2]]
