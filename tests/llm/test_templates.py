from siltstone.llm import templates as T

REAL = "# Guide\n\nThe cache keeps groups in memory and passes them on. The worker waits until all of them are scored. " * 3
RESIDUE = {
    1: "This report was prepared by {{ author }} on [INSERT DATE].",
    2: "# Title\n\n404 Not Found. The requested page was not found on this server.\n\nPowered by Acme pages. Request 6ad88b.",
    3: "Home | Docs | Next\n\nPlease enable JavaScript to view this page.\n\n© 2031 Acme Labs. All rights reserved.",
    4: "Lorem ipsum dolor sit amet, nisl massa. Vitae morbi ipsum velim fermis.",
    5: "请启用JavaScript后继续访问本页面。",
    6: "本报告由【请填写作者】编写。",
    7: "Guide\nSAMPLE TEXT. Sample text.",
    8: "与{版本号}相比，组内方差提高了41%。",
}
CLEAN = {
    20: REAL,
    21: REAL + "The prompt uses a double-brace variable such as {{question}}, which the loader fills.",
    22: REAL + 'If the box answers "Internal Server Error" 8 times in a row, flush the buffer.',
    23: "```\n{{ message }} ${CKPT_DIR} {step}\n```\nThe answer is \\boxed{answer} and \\frac{a}{b}.",
    24: REAL + "Use `[INSERT NAME]` and \"{{name}}\" with care.",
    25: "2031-01-01 WARN worker w-3 returned HTTP 502, retry 1/5\n2031-01-01 INFO saved a.pt",
    26: None,
    27: "  \n\t",
    28: "Home | Docs | Next",
}


def test_found(spark):
    rows = [(i, t, "x") for i, t in {**RESIDUE, **CLEAN}.items()]
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, leaf string").repartition(3)
    got = {r["doc_id"]: r["kind"] for r in T.residue(df).collect()}
    assert set(got) == set(RESIDUE)
    assert got[1] == got[6] == "slot" and got[2] == "message"
    assert T.residue(df.limit(0)).count() == 0


FOOTERS = ("Ask the desk on floor two.", "Return to the lobby of this portal.", "Ticket {} was filed for you.", "Brought to you by {} hosting.")
NAMES = ("Tamsol", "Ulbren", "Koviston", "Deldra", "Marphon", "Zorvia")


def pages(errors, names=NAMES):
    """Error pages with footers that no rule knows."""
    return [f"{FOOTERS[0]}\n{e}\n{FOOTERS[1]}\n{FOOTERS[2].format(n)} {FOOTERS[3].format(n)}" for e, n in zip(errors, names)]


def test_the_tree_tells_footers_by_company(spark, monkeypatch):
    errors = ["502 Bad Gateway.", "404 Not Found.", "Internal server error.", "Access denied.", "Your session has expired.", "Too many requests."]
    texts = pages(errors) + [REAL, REAL + "Ask the desk about it.", "Plain words on a harbour.\n502 Bad Gateway.\nThe lamp is green."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in T.residue(df).collect()} == set(range(len(errors)))
    monkeypatch.setattr(T, "company", lambda rows, templates: rows.select("leaf").limit(0))  # without the tree's nodes
    assert T.residue(df).count() == 0


def test_filler_words_are_learnt_from_templates(spark):
    odd = ("brondel", "vastim", "quorpen")
    texts = [f"Lorem ipsum {odd[i % 3]} dolor sit {odd[(i + 1) % 3]} amet {w}." for i, w in enumerate(("nisl", "massa", "orci", "erat", "porta", "vitae"))]
    texts += ["Brondel vastim lorem quorpen brondel ipsum.", "The brand of the lamp is known to all who live in the harbour."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["word"] for r in T.filler_words(T.classified(df)).collect()} == set(odd)
    assert {r["doc_id"] for r in T.residue(df).collect()} == set(range(7))


#: Wordings that stand in no test table.
HELD_OUT = [
    "503 Service Unavailable. The service is temporarily unavailable.",
    "You need to turn on JavaScript in the settings of your browser to go on.",
    "This page requires cookies and JavaScript.",
    "Access denied: you do not belong to this space.",
    "This content is no longer available.",
    "Placeholder text. Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
]


def test_held_out_wordings(spark):
    df = spark.createDataFrame(list(enumerate(HELD_OUT)), "doc_id bigint, text string")
    assert T.residue(df).count() >= 5


def test_beyond_the_held_templates(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_HELD", 2)
    df = spark.createDataFrame(list({**RESIDUE, **CLEAN}.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in T.residue(df).collect()} == set(RESIDUE)


def test_the_same_verdicts_beyond_the_held_templates(spark, monkeypatch):
    texts = ["The page for this alpha was not found", "The page for this alpha was not stored", "404 Not Found. Please enable JavaScript to view this page."]
    texts += [f"{a} The page for this alpha was not {b}" for a in ("# Note\n\n", "") for b in ("found", "kept")]
    df = spark.createDataFrame([*enumerate(texts), *{**RESIDUE, **CLEAN}.items()][::-1] + [(100, None)], "doc_id bigint, text string")
    held = sorted(map(tuple, T.residue(df).collect()))
    monkeypatch.setattr(T, "MAX_HELD", 2)
    assert sorted(map(tuple, T.residue(df).collect())) == held


def test_company_counts_rows_with_a_message_alone_at_any_size(spark, monkeypatch):
    texts = ["Plain words on a harbour.\nThe lamp is green."] * 3 + ["Plain words on a harbour.\n502 Bad Gateway.\nThe lamp is green."]
    texts = [f"{t}\nRow {w}." for t, w in zip(texts, "abcd")] + ["404 Not Found."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for most in (T.MAX_HELD, 64, 2, 1):
        monkeypatch.setattr(T, "MAX_HELD", most)
        assert [r["doc_id"] for r in T.residue(df).collect()] == [4]


def test_tree_merges_alike_sentences():
    tree = T.PrefixTree()
    for name in ("alpha", "beta", "gamma"):
        tokens = T.TOKEN.findall(f"some features of {name} will not work.")
        tree.add(T.leaf_of(tokens), tokens, 1)
    rows = tree.batch().to_pylist()
    assert len(rows) == 1 and rows[0]["n"] == 3 and T.WILD in rows[0]["template"]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "Real words stand here. " * 40000), (2, "Lorem ipsum dolor sit amet. " * 20000)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in T.residue(df).collect()] == [2]
