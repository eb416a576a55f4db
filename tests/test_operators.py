import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import masks as K
from siltstone.functions import shaping as H
from siltstone.functions import text as X
from siltstone.functions import tokens as T
from siltstone.operators import balance as B
from siltstone.operators import groups as G
from siltstone.operators import ordering as O
from siltstone.operators import retrieval as R
from siltstone.operators import traces as S
from siltstone.operators import turns as U
from siltstone.operators.cumulative import first_at_ranks, running_total
from siltstone.operators.estimators import PromptSource
from siltstone.plans import registry, stream_queries
from siltstone.sources import records
from siltstone.streaming import buffer
from tests import compare


def test_running_total_over_blocks_of_hot_and_null_groups(spark):
    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i int, v bigint")
    got = {(x["k"], x["i"]): (x["_cum"], x["_total"]) for x in running_total(df, ["k"], ["i"], "v", blocks=7).collect()}
    for k in ("hot", "b", None):
        run, total = 0, sum(v for g, _, v in data if g == k)
        for g, i, v in sorted(data, key=lambda x: x[1]):
            if g == k:
                run += v
                assert got[k, i] == (run, total)
    assert len(got) == len(data)
    assert running_total(df.limit(0), ["k"], ["i"], "v").count() == 0


def test_first_at_ranks(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 8), ("a", 3.0, 1)], "k string, v double, n bigint")
    got = {x["basis_points"]: x["v"] for x in first_at_ranks(df, ["k"], "v", "n", [1, 1000, 1001, 9000, 10000]).collect()}
    assert got == {1: 1.0, 1000: 1.0, 1001: 2.0, 9000: 2.0, 10000: 3.0}


GROUPS = "g int, i int, r double, gone boolean"


def test_group_filters(spark):
    df = spark.createDataFrame([(1, 1, 1.0, False), (1, 2, 2.0, False), (1, 3, 4.0, False), (2, 4, 0.5, False), (2, 5, 0.5, True), (3, 6, 1.0, False)], GROUPS)
    got = {x["g"]: (x["keep"], x["reason"]) for x in G.nonzero_std(df, ["g"], "r", "i").collect()}
    assert got == {1: (True, None), 2: (False, "zero_std_0.5"), 3: (False, "zero_std_1.0")}
    got = {x["g"]: (x["keep"], x["reason"]) for x in G.valid_group(df, ["g"], "r", "gone", 3).collect()}
    assert got[1] == (True, None) and got[2][1] == "group_size_lt_min_1_2"
    with pytest.raises(ValueError):
        G.valid_group(df, ["g"], "r", "gone", 8, least=4)
    assert G.keep_groups(df, G.nonzero_std(df, ["g"], "r", "i"), ["g"]).count() == 3


def test_normalisers_on_known_groups(spark):
    df = spark.createDataFrame([(1, 1, 1.0, False), (1, 2, 2.0, False), (1, 3, 4.0, False), (2, 4, 3.0, False)], GROUPS)
    grpo = {x["i"]: x["norm_reward"] for x in G.normalise(df, ["g"], "r").collect()}
    assert abs(grpo[3] - (4 - 7 / 3) / (math.sqrt(7 / 3) + 1e-6)) < 1e-9
    rloo = {x["i"]: x["norm_reward"] for x in G.normalise(df, ["g"], "r", "rloo").collect()}
    assert rloo[4] == 0.0 and abs(rloo[1] - (1 - 3.0)) < 1e-9
    raw = {x["i"]: x["norm_reward"] for x in G.normalise(df, ["g"], "r", "trloo").collect()}
    assert raw[4] == 3.0
    base = {x["i"]: x["baseline"] for x in G.leave_one_out_baseline(df, ["g"], "r").collect()}
    assert base[1] == 3.0 and base[4] == 0.0


def test_pass_rates_against_counting(spark):
    from itertools import combinations

    rows = [(g, i, float(i < c), False) for g, c in ((1, 0), (2, 1), (3, 3), (4, 4)) for i in range(4)]
    df = spark.createDataFrame(rows, GROUPS)
    got = {x["k"]: x["pass_rate"] for x in G.pass_rates(df, ["g"], F.col("r") == 1, 4).collect()}
    for k in (1, 2, 4):
        want = sum(sum(any(i < c for i in s) for s in combinations(range(4), k)) / math.comb(4, k) for c in (0, 1, 3, 4)) / 4
        assert abs(got[k] - want) < 1e-12
    assert G.pass_rates(df, ["g"], F.col("r") == 1, 1).count() == 0


def test_cuts(spark):
    df = spark.range(103).withColumnRenamed("id", "i")
    assert G.trim_to_multiple(df, "i", 10).count() == 100
    with pytest.raises(ValueError):
        G.trim_to_multiple(df, "i", 104)
    assert sorted(x["i"] for x in G.head_and_tail(df, "i", 0.05).collect()) == [0, 1, 100, 101, 102]
    assert G.head_and_tail(df, "i", 0.001).count() == 103
    assert G.head_rows(df, "i", 0).count() == 0


def test_turns(spark):
    rows = [(1, t, r, g) for t, (r, g) in enumerate([(0.0, False), (1.0, False), (0.5, True), (0.5, False), (2.0, False)])]
    df = spark.createDataFrame(rows, "k int, t bigint, r double, gone boolean")
    fold = {x["t"]: x["multi_turn_reward"] for x in U.folded_rewards(df, ["k"], "t", "r", "gone", 0.5).collect()}
    assert abs(fold[0] - (0 + 0.5 * (1 + 0.5 * (0 + 0.5 * (0.5 + 0.5 * 2))))) < 1e-12
    improve = {x["t"]: x["final_removed"] for x in U.finalise(df, ["k"], "t", "r", "gone", "improve").collect()}
    assert improve == {0: False, 1: False, 2: True, 3: True, 4: False}
    pad = U.pad_turns(df, ["k"], "t", 7, {"r": F.lit(0.0)}).collect()
    assert len(pad) == 7 and sum(x["is_pad_turn"] for x in pad) == 2


def gae_by_hand(r, v, g, lam):
    out, acc = [0.0] * len(r), 0.0
    for t in reversed(range(len(r))):
        nv = v[t + 1] if t + 1 < len(r) else 0.0
        acc = r[t] + g * nv - v[t] + g * lam * acc
        out[t] = acc
    return out


def test_token_math(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(n)], [rnd.random() for _ in range(n)], [rnd.randint(0, 1) for _ in range(n)]) for i, n in enumerate([1, 2, 5, 17])]
    df = spark.createDataFrame(rows, "i int, r array<double>, v array<double>, m array<int>")
    adv, ret = T.gae(F.col("r"), F.col("v"), 0.99, 0.95)
    for x in df.select("i", adv.alias("a"), ret.alias("b"), T.discounted(F.col("r"), 0.9).alias("d"), T.masked_mean(F.col("r"), F.col("m")).alias("mm")).collect():
        _, r, v, m = rows[x["i"]]
        assert all(abs(a - b) < 1e-9 for a, b in zip(x["a"], gae_by_hand(r, v, 0.99, 0.95)))
        assert all(abs(a - (b + c)) < 1e-9 for a, b, c in zip(x["b"], x["a"], v))
        acc = 0.0
        for t in reversed(range(len(r))):
            acc = r[t] + 0.9 * acc
            assert abs(x["d"][t] - acc) < 1e-9
        assert abs(x["mm"] - sum(a * b for a, b in zip(r, m)) / max(1, sum(m))) < 1e-9
    full = spark.createDataFrame([([0.1], [0])], "k array<double>, m array<int>")
    with pytest.raises(Exception, match="fully masked"):
        full.select(T.reinforce_rewards(F.col("k"), F.col("m"), F.lit(1.0), 0.1)).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=4, max_size=40), st.integers(1, 4))
def test_partitions_cover_every_index_once(lengths, k):
    for f in (B.differencing, B.least_loaded):
        parts = f(lengths, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(lengths)))
    even = lengths[: len(lengths) // k * k]
    parts = B.differencing(even, k, equal=True)
    assert {len(p) for p in parts} == {len(even) // k}
    assert B.first_fit_count(lengths, 1000) <= len(lengths)


def test_balance_known():
    parts = B.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) in ([14, 16], [15, 15])
    with pytest.raises(ValueError):
        B.differencing([1, 2, 3], 2, equal=True)
    assert B.bounded_chunks([5, 5, 11, 1], 10) == [0, 0, 1, 2]


def test_ordering(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    first = [x["i"] for x in O.wrapped_slice(df, "i", 15, 10, 20, 42, 0).orderBy("pos").collect()]
    epoch = lambda e: [x["i"] for x in df.orderBy(O.mix_key(F.col("i"), 42 + e), "i").collect()]
    assert first == epoch(0)[15:] + epoch(1)[:5]
    split = O.trajectory_split(spark.createDataFrame([(s, t) for s in range(4) for t in range(3)], "s int, t int"), "s", 2)
    assert {(x["s"], x["rank"]) for x in split.collect()} == {(0, 0), (1, 0), (2, 1), (3, 1)}
    with pytest.raises(ValueError):
        O.trajectory_split(split.drop("rank"), "s", 3)


def test_prompt_source(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "i")
    a = PromptSource(spark, df, "i")
    seen = [x["i"] for x in a.get(6).collect()] + [x["i"] for x in a.get(6).collect()]
    assert sorted(seen[:10]) == list(range(10)) and a.epoch == 1 and a.offset == 2
    a.save(str(tmp_path / "s"), 3)
    b = PromptSource(spark, df, "i")
    b.load(str(tmp_path / "s"), 3)
    assert {x["i"] for x in b.get(4).collect()} == {x["i"] for x in a.get(4).collect()}
    b.add(spark.createDataFrame([(77,)], "i bigint"))
    assert 77 in {x["i"] for x in b.get(2).collect()}


def test_retrieval(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    ask = spark.createDataFrame([(9, [1.0, 0.2])], "q int, v array<float>")
    got = R.dense_top_k(base, ask, 2, "id", "q", "v").orderBy("rank").collect()
    assert [x["hit_id"] for x in got] == [1, 3]
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, None)], "id int, t string")
    hits = R.bm25_top_k(docs, spark.createDataFrame([(5, "fox blue")], "q int, t string"), 5, "id", "q", "t").orderBy("rank").collect()
    assert [x["hit_id"] for x in hits] == [2, 1]
    left = R.multiset_except(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, o int"), spark.createDataFrame([(1,)], "k int"), "k", "o")
    assert {(x["k"], x["o"]) for x in left.collect()} == {(1, 2), (2, 3)}


def test_traces(spark):
    spans = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 9), (1, 5, 6), (1, 6, 5)], "t int, s int, p int")
    assert {x["s"]: x["depth"] for x in S.depths(spans, "t", "s", "p", rounds=6).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}
    iv = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 5.0, 6.0)], "k string, s double, e double")
    merged = S.busy_intervals(iv, ["k"], "s", "e")
    assert {(x["start"], x["end"], x["n_spans"]) for x in merged.collect()} == {(0.0, 3.0, 2), (5.0, 6.0, 1)}
    assert S.gaps(merged, ["k"]).collect()[0]["gap"] == 2.0


def test_answers():
    assert A.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\boxed{\\frac{1}{2}}"
    assert A.boxed_content("\\boxed{unclosed") is None
    assert A.plain_math("\\frac12") == "\\frac{1}{2}" and A.plain_math("0.5") == "\\frac{1}{2}" and A.plain_math("3/4") == "\\frac{3}{4}"
    assert A.plain_math("x=5") == "5" and A.plain_math("\\sqrt3") == "\\sqrt{3}" and A.plain_math("10\\text{ cm}") == "10"
    assert A.loose_equal("1,000", "1000") and A.loose_equal("5 cm", "5") and not A.loose_equal("5", "5.5")
    assert not A.loose_equal("4/2", "2") and not A.loose_equal("2", "4/2") and not A.loose_equal("9^9^9", "x^9^9")
    assert A.boxed_content("\\fbox{3}") is None and A.boxed_content("\\boxed{2} and \\fbox{3}") == "2" and A.boxed_content("\\boxed{2} \\boxed 3") is None
    assert not A.loose_equal("1/2", "2/4") and A.loose_equal("(1,2)", "(1, 2)") and not A.loose_equal("(1,2)", "[1,2]")
    assert A.math_grade("so \\boxed{42}", "42") and not A.math_grade("so 42", "42")
    assert A.reasoned_reward("<think>x</think> \\boxed{3}", "3") == 1.0 and A.reasoned_reward("\\boxed{3}", "3") == 0.0
    assert A.choice_score("The answer is B", "B") == 1.0 and A.choice_score("It is blue", "blue", ["red", "blue"]) == 1.0
    assert A.bag_f1("the cat sat", "cat sat down") == pytest.approx(0.8) and A.bag_f1("yes", "no") == 0.0
    ok = "<|im_start|>assistant\n<think>a</think>\n<search>b</search><information>c</information><think>d</think><answer>e</answer>"
    assert A.tag_sequence(ok)[0] and not A.tag_sequence(ok + "x")[0] and not A.tag_sequence("none")[0]
    assert A.strict_box("\\boxed{7}", "7")[0] == 1 and A.strict_box(None, "7")[0] == -1


def test_unknown_scorer_raises(spark):
    df = spark.createDataFrame([("nope", "a", "b")], "k string, r string, l string")
    with pytest.raises(Exception, match="unknown reward type"):
        df.select(A.score(F.col("k"), F.col("r"), F.col("l"))).collect()


def test_text():
    assert X.balanced_json('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert X.balanced_json('{"a": ') is None
    assert X.has_repetition("ab" * 6000) and not X.has_repetition("ab" * 10) and not X.has_repetition(None)
    assert X.missing_semicolon("a\nREGISTER_BINDING(f)\nb") == 2 and X.missing_semicolon("REGISTER_BINDING(f);") is None
    assert X.precheck("import e\ne.run()", "e") is None and X.precheck("", "e") == "empty"


def test_masks():
    chat = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "first"}, {"role": "tool", "content": "t"}, {"role": "assistant", "content": "second", "step_loss_mask": 0}, {"role": "assistant", "content": "third"}]
    for kind in ("by_message", "by_prefixed_message"):
        ids, mask = K.loss_mask(kind, chat)
        assert K.runs(ids, mask) == ["first<|im_end|>\n", "third<|im_end|>\n"]
    ids, mask = K.by_offsets(chat, lambda t: [(ord(x), i, i + 1) for i, x in enumerate(t)])
    assert K.runs(ids, mask) == ["first<|im_end|>\n", "third<|im_end|>\n"]
    with pytest.raises(ValueError):
        K.loss_mask("none", chat)
    assert K.supervised_sample(chat)["reward"] == 0.0 and K.header_length() == 0


def test_records(spark, tmp_path):
    assert records.parse_path("a.jsonl@[2:5]") == ("a.jsonl", slice(2, 5)) and records.parse_path("a@[:5]")[1] == slice(None, 5)
    with pytest.raises(ValueError):
        records.parse_path("a@[-1:2]")
    with pytest.raises(FileNotFoundError):
        records.read(spark, str(tmp_path / "no.jsonl"))
    path = tmp_path / "x.jsonl"
    path.write_text('{"i": 1}\n\n{"i": 2\nnope\n{"i": 3}\n')
    assert {x["i"] for x in records.read(spark, str(path), "i int").collect()} == {1, 3}
    bad = spark.createDataFrame([([("alien", "x")],)], "m array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="unknown role"):
        records.role_checked(bad, "m").collect()
    with pytest.raises(ValueError):
        records.require(bad, ["z"])


def test_stream_completes_groups_across_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(g, g * 10 + k, 1.0) for g in range(3) for k in range(3 if g < 2 else 2)]
    df = spark.createDataFrame(rows, "instance_id bigint, item_id bigint, value double")
    for k in range(3):
        df.where(F.pmod("item_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = buffer.run_to_end(buffer.complete_groups(stream, 3), buffer.OUT).collect()
    assert {(x["instance_id"], x["n_items"], x["finished"]) for x in got} == {(0, 3, True), (1, 3, True)}


def test_slow_requests_run_as_sql_without_python(spark, tmp_path):
    values = [4.0, 9.5, None, 14.4, 14.6, math.nan, 30.0, 1.0, 5.0, 5.1]
    rows = [(i * 97, i % 3 or None, v) for i, v in enumerate(values * 12)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = stream_queries.book.queries["T15_slow_requests"](spark, str(tmp_path))
    assert "Pandas" not in df._jdf.queryExecution().toString()
    con = compare.connect("/nowhere")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare.rows_of(df) == compare.rows_of_sql(con, stream_queries.book.sql["T15_slow_requests"])


def test_registry():
    assert registry.load("math.sqrt")(4) == 2
    with pytest.raises(ValueError):
        registry.register("nothing", "x")
    with pytest.raises(ValueError):
        registry.dataset_list(["a", "b", "c"])
    assert registry.dataset_list(None) == []


def test_catalogue_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.queries()) > 200


def test_whole_trajectories_have_all_events(spark, tmp_path):
    from siltstone.plans import catalog

    kinds = ["view", "error", "purchase"]
    rows = [(i, 1 if i % 5 else 2, kinds[i % 3], float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", F.lit("2031-01-01").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    for name in ("A05_turn_reward_norm", "F16_finalise_positive", "O18_trajectory_split", "P35_turn_log", "W03_multi_turn_fold", "W04_finalise_improve", "W07_prefix_best"):
        assert run(name).count() == 40, name
    fold = {(x["user_id"], x["turn_idx"]): x["multi_turn_reward"] for x in run("W03_multi_turn_fold").collect()}
    reward = [0.0 if k == "error" else 1.0 if k == "purchase" else 0.5 for _, u, k, _ in rows if u == 1]
    assert len(reward) == 32 and abs(fold[1, 0] - sum(r * 0.5**t for t, r in enumerate(reward))) < 1e-6
    assert run("A15_turn_metrics").count() == 32
    assert sum(x["n"] for x in run("G01_regroup_by_turn").collect()) == 40
    spine = run("J14_turn_spine").collect()
    assert len(spine) == 64 and sum(not x["is_pad_turn"] for x in spine) == 40


def test_scorer_dispatch_reads_each_samples_type(spark, tmp_path):
    from siltstone.functions import answers as A
    from siltstone.plans import catalog

    said = ["Answer: 12", "\\boxed{12}", "<think>x</think> \\boxed{12}", "12", "The answer is C", "a red fox", None, "\\boxed{C}"]
    kinds = ["dapo", "math", "deepscaler", "f1", "gpqa", "boxed_f1", "boxed_gpqa", " math "]
    rows = [(i, k, r, t) for i, (k, r, t) in enumerate((k, r, t) for k in kinds for r in said for t in ("12", "red fox", "C", "0", None))]
    rows = rows + rows[:4]  # delivered twice
    df = spark.createDataFrame([(i, "q", r, t, f'{{"rm_type": "{k}", "rollout_step": 1}}') for i, k, r, t in rows], "sample_index bigint, prompt string, response string, label string, metadata string")
    df.write.parquet(str(tmp_path / "samples.parquet"))

    def by_hand(k, r, t):
        k = k.strip()
        if k.startswith("boxed_"):
            k, r = k[6:], A.boxed_content(r) or ""
        if k == "dapo":
            return 1.0 if (r, t) == ("Answer: 12", "12") else -1.0
        return float({"math": A.math_grade, "deepscaler": A.reasoned_reward, "f1": A.bag_f1, "gpqa": A.choice_score}[k](r, t))

    want = {i: (k.strip(), by_hand(k, r, t)) for i, k, r, t in rows}
    got = {x["sample_index"]: (x["rm_type"], x["score"]) for x in catalog.QUERIES["C01_scorer_dispatch"](spark, str(tmp_path)).collect()}
    assert got == want
    assert {s for k, s in want.values() if k == "dapo"} == {1.0, -1.0} and len({s for k, s in want.values() if k == "f1"}) > 2
    (tmp_path / "none").mkdir()
    df.limit(1).withColumn("metadata", F.lit("{}")).write.parquet(str(tmp_path / "none" / "samples.parquet"))
    with pytest.raises(Exception, match="unknown reward type"):
        catalog.QUERIES["C01_scorer_dispatch"](spark, str(tmp_path / "none")).collect()


def test_periodic_needs_an_interval(spark):
    df = spark.range(3).select(H.periodic(F.col("id"), None, 1, 3).alias("a"), H.periodic(F.col("id"), 2, None, 3).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(False, False), (False, True), (False, True)]


def test_overlapping_and_nested_items_are_all_found(spark):
    docs = spark.createDataFrame([(1, "abcdefgh tail"), (2, "cdef"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([("abcdef",), ("cdefgh",), ("cdef",), ("",), (None,), ("zz",)], "item string")
    got = {r["item"]: r["n"] for r in R.containment_counts(docs, items, "text", "item").collect()}
    assert got == {"abcdef": 1, "cdefgh": 1, "cdef": 2, "": 3}


def test_suffix_sums_grow_in_proportion(spark):
    import random
    import time

    rng = random.Random(3)
    rows = [[rng.random() for _ in range(n)] for n in (0, 1, 7, 300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(9, None)], "id int, x array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", T.decayed_suffix_sums(F.col("x"), 0.97).alias("y")).collect()}
    assert got[9] is None
    for i, r in enumerate(rows):
        want, last = [], 0.0
        for v in reversed(r):
            last = v + 0.97 * last
            want.insert(0, last)
        assert got[i] == pytest.approx(want, rel=1e-9)
    spent = []
    for n in (16_384, 131_072):
        long = spark.range(4).select(T.gae(F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(0.5), n), 0.99, 0.95)[0].alias("a"))
        began = time.perf_counter()
        long.write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - began)
    assert spent[1] < 20 * spent[0] + 5


def test_running_maximum_over_blocks_and_busy_intervals(spark):
    import random

    rng = random.Random(5)
    rows = [(k, float(a := rng.randrange(1000)), a + rng.choice((0.0, 1.0, 5.0, 90.0))) for k in ("hot",) * 300 + ("b", None) for _ in (0,)]
    df = spark.createDataFrame(rows, "k string, start double, end double").repartition(4)
    got = sorted((r["k"] or "", r["start"], r["end"], r["n_spans"]) for r in S.busy_intervals(df, ["k"], "start", "end").collect())
    want = []
    for k in ("hot", "b", None):
        merged = []
        for _, a, b in sorted(x for x in rows if x[0] == k):
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], b), merged[-1][2] + 1]
            else:
                merged.append([a, b, 1])
        want += [(k or "", *m) for m in merged]
    assert got == sorted(want)
    assert S.busy_intervals(df.limit(0), ["k"], "start", "end").count() == 0
