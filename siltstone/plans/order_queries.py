"""Queries of shuffles, slices, draws, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import balance as B
from siltstone.operators import groups as G
from siltstone.operators import ordering as O
from siltstone.operators import retrieval as R
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
S = f"WITH {V.SAMPLES}"
c = F.col


def mix(x, salt=0):
    return f"(({x} + {salt}) * 7919 + 104729) % 1000003"


@book.add("O01_epoch_shuffle", f"SELECT event_id, row_number() OVER (ORDER BY {mix('event_id', 42)}, event_id) - 1 AS pos FROM events")
def o01(spark, d):
    e = table(spark, d, "events").select("event_id").withColumn("k", O.mix_key(c("event_id"), 42))
    return O.positions(e, ["k", "event_id"]).select("event_id", "pos")


@book.add(
    "O04_curriculum_draws",
    f"WITH z AS (SELECT CASE WHEN n_chars <= 2500 THEN 'L0' WHEN n_chars <= 4000 THEN 'L1' ELSE 'L9' END AS level, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT event_id AS draw, {mix('event_id', 7)} / 1000003.0 AS u FROM events), l AS (SELECT draw, CASE WHEN u < 0.7 THEN 'L0' ELSE 'L1' END AS level FROM d) SELECT l.draw, l.level, (row_number() OVER (PARTITION BY l.level ORDER BY l.draw) - 1) % z.n AS position FROM l JOIN z ON z.level = l.level",
)
def o04(spark, d):
    docs = table(spark, d, "documents")
    sizes = {r["level"]: r["n"] for r in docs.groupBy(F.when(c("n_chars") <= 2500, "L0").when(c("n_chars") <= 4000, "L1").otherwise("L9").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return O.curriculum_draws(table(spark, d, "events").count(), {"L0": 0.7, "L1": 0.3, "L7": 0.5}, sizes, 7, spark)


@book.add("O06_order_by_first_sample", f"{S}, g AS (SELECT group_index, min(sample_index) AS first FROM s GROUP BY group_index) SELECT group_index, row_number() OVER (ORDER BY first) - 1 AS pos FROM g")
def o06(spark, d):
    g = V.samples(spark, d).groupBy("group_index").agg(F.min("sample_index").alias("first"))
    return O.positions(g, ["first"]).select("group_index", "pos")


@book.add("O07_newest_groups", "WITH g AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id ORDER BY t DESC, user_id LIMIT 10) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM g)")
def o07(spark, d):
    return O.newest(table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 10).select("event_id", "user_id")


@book.add("O08_top_by_total", "SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 30")
def o08(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "user_id").limit(30).select("user_id", (F.round("t", 6) + F.lit(0.0)).alias("total"))


@book.add("O11_accept_until_n", f"{S}, g AS (SELECT group_index, coalesce(stddev_samp(reward) > 1e-6, false) AS keep, max(sample_index) AS done FROM s GROUP BY group_index) SELECT group_index FROM g WHERE keep ORDER BY done, group_index LIMIT 128")
def o11(spark, d):
    s = V.samples(spark, d)
    done = s.groupBy("group_index").agg(F.max("sample_index").alias("done"))
    return O.accept_until(G.nonzero_std(s, ["group_index"], "reward", "sample_index").join(done, "group_index"), "group_index", "done", 128).select("group_index")


@book.add("O12_differencing_partition")
def o12(spark, d):
    return B.assign(V.samples(spark, d), "rollout_id", "sample_index", "response_length", 8)


@book.add("O12_differencing_equal_counts")
def o12e(spark, d):
    full = V.samples(spark, d).join(V.samples(spark, d).groupBy("rollout_id").count().where("count = 256"), "rollout_id", "left_semi")
    return B.assign(full, "rollout_id", "sample_index", "response_length", 8, equal=True)


FOLD = f"WITH RECURSIVE {V.SAMPLES}, n AS (SELECT rollout_id, sample_index, response_length AS n, row_number() OVER (PARTITION BY rollout_id ORDER BY sample_index) AS i FROM s)"
_STEP = "FROM f JOIN n ON n.rollout_id = f.rollout_id AND n.i = f.i + 1"


@book.add(
    "O12_partition_bounds",
    f"WITH {V.SAMPLES} SELECT rollout_id, count(*) AS n, CAST(sum(response_length) AS BIGINT) AS total, true AS within FROM s GROUP BY rollout_id",
)
def o12b(spark, d):
    """Nothing is lost, and no two of a batch's ranks differ by more than its longest item."""
    ranks = B.assign(V.samples(spark, d), "rollout_id", "sample_index", "response_length", 8)
    loads = ranks.groupBy("rollout_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum("response_length").alias("t"), F.max("response_length").alias("longest"))
    return loads.groupBy("rollout_id").agg(F.sum("n").alias("n"), F.sum("t").alias("total"), ((F.max("t") - F.when(F.count(F.lit(1)) == 8, F.min("t")).otherwise(0)) <= F.max("longest")).alias("within"))


@book.add(
    "O13_least_loaded_partition",
    f"""{FOLD}, f AS (SELECT DISTINCT rollout_id, CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS p FROM s
UNION ALL SELECT rollout_id, i, list_concat(list_concat(loads[1:p - 1], [loads[p] + n]), loads[p + 1:]), p FROM (SELECT n.rollout_id, n.i, n.n, f.loads, list_position(f.loads, list_min(f.loads)) AS p {_STEP}))
SELECT n.rollout_id, n.sample_index, n.n AS response_length, CAST(f.p - 1 AS INTEGER) AS rank FROM n JOIN f USING (rollout_id, i)""",
)
def o13(spark, d):
    return B.assign(V.samples(spark, d), "rollout_id", "sample_index", "response_length", 8, "least_loaded")


@book.add(
    "O14_first_fit_bins",
    f"""{FOLD}, f AS (SELECT DISTINCT rollout_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS loads FROM s
UNION ALL SELECT rollout_id, i, CASE WHEN coalesce(p, 0) = 0 THEN list_append(loads, n) ELSE list_concat(list_concat(loads[1:p - 1], [loads[p] + n]), loads[p + 1:]) END FROM (SELECT n.rollout_id, n.i, n.n, f.loads, list_position(list_transform(f.loads, lambda x: x + n.n <= 512), true) AS p {_STEP}))
SELECT rollout_id, CAST(len(loads) AS INTEGER) AS n_bins FROM f QUALIFY i = max(i) OVER (PARTITION BY rollout_id)""",
)
def o14(spark, d):
    return B.bin_counts(V.samples(spark, d), "rollout_id", "sample_index", "response_length", 512)


@book.add("O15_micro_batch_schedule")
def o15(spark, d):
    s = V.samples(spark, d).withColumn("rank", F.pmod("sample_index", F.lit(4)))
    return B.micro_batch_schedule(s, "rollout_id", "rank", "sample_index", "response_length", 512)


@book.add("O16_fixed_micro_batches", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 32 AS micro_batch FROM events")
def o16(spark, d):
    return O.micro_batches(table(spark, d, "events").select("event_id"), ["event_id"], 32)


@book.add("O17_round_robin_split", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS rank FROM orders")
def o17(spark, d):
    return O.round_robin(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 4)


@book.add(
    "O18_trajectory_split",
    f"{S}, {V.TURNS}, k AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM t)) SELECT user_id, turn_idx, k // (CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END) AS rank FROM t JOIN k USING (user_id)",
)
def o18(spark, d):
    """Whole trajectories on two ranks; an odd number of them doesn't divide and stays on one."""
    t = V.turns(spark, d)
    ranks = 2 if t.select("user_id").distinct().count() % 2 == 0 else 1
    return O.trajectory_split(t, "user_id", ranks).select("user_id", "turn_idx", "rank")


@book.add("O20_inverse_permutation", f"SELECT row_number() OVER (ORDER BY {mix('event_id', 5)}, event_id) - 1 AS idx, event_id AS inverse FROM events")
def o20(spark, d):
    e = table(spark, d, "events").select("event_id").withColumn("k", O.mix_key(c("event_id"), 5))
    return O.positions(e, ["k", "event_id"], "idx").select("idx", c("event_id").alias("inverse"))


@book.add(
    "O21_bounded_chunks",
    f"""{FOLD}, f AS (SELECT DISTINCT rollout_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS load, CAST(0 AS BIGINT) AS chunk FROM s
UNION ALL SELECT n.rollout_id, n.i, CASE WHEN f.load > 0 AND f.load + n.n > 1000 THEN n.n ELSE f.load + n.n END, CASE WHEN f.load > 0 AND f.load + n.n > 1000 THEN f.chunk + 1 ELSE f.chunk END {_STEP})
SELECT n.rollout_id, n.sample_index, n.n AS response_length, CAST(f.chunk AS INTEGER) AS chunk FROM n JOIN f USING (rollout_id, i)""",
)
def o21(spark, d):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_index")
        return pdf.assign(chunk=B.bounded_chunks(pdf["response_length"].tolist(), 1000))

    return V.samples(spark, d).select("rollout_id", "sample_index", "response_length").groupBy("rollout_id").applyInPandas(run, "rollout_id bigint, sample_index bigint, response_length bigint, chunk int")


@book.add("O24_restore_order", "SELECT event_id, event_id AS pos FROM events")
def o24(spark, d):
    e = table(spark, d, "events").select("event_id").withColumn("k", O.mix_key(c("event_id"), 9))
    return O.positions(e, ["event_id"]).select("event_id", "pos")


@book.add("P05_repeat_prompts", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) + 100 AS group_index, (row_number() OVER (ORDER BY p_partkey) - 1) * 4 + r + 400 AS sample_index FROM part, (SELECT unnest([0, 1, 2, 3]) AS r) WINDOW w AS (ORDER BY p_partkey)")
def p05(spark, d):
    return O.repeat(table(spark, d, "part").select("p_partkey"), 4, ["p_partkey"], base=100).select("p_partkey", "group_index", "sample_index")


book.sql["P05_repeat_prompts"] = "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS g FROM part) SELECT p_partkey, g + 100 AS group_index, g * 4 + r + 400 AS sample_index FROM p, (SELECT unnest([0, 1, 2, 3]) AS r)"


@book.add("G05_eval_expansion", "WITH p AS (SELECT item_id, dataset_path, row_number() OVER (ORDER BY item_id) - 1 AS g FROM eval_items) SELECT item_id, g * 2 + r AS sample_index, 1234 + r AS seed FROM p, (SELECT unnest([0, 1]) AS r)")
def g05(spark, d):
    out = O.repeat(table(spark, d, "eval_items").select("item_id"), 2, ["item_id"])
    return out.select("item_id", "sample_index", (c("repeat") + 1234).alias("seed"))


book.sql["G05_eval_expansion"] = "WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS g FROM eval_items) SELECT item_id, g * 2 + r AS sample_index, CAST(1234 + r AS INTEGER) AS seed FROM p, (SELECT unnest([0, 1]) AS r)"


@book.add("G03_session_ids", "SELECT count(DISTINCT event_id) AS n_sessions FROM events")
def g03(spark, d):
    return table(spark, d, "events").agg(F.count_distinct(F.sha2(F.concat_ws("-", F.lit("session"), "event_id"), 256)).alias("n_sessions"))


@book.add("W13_row_counters", "SELECT o_orderkey, 500 + row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def w13(spark, d):
    return O.positions(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", (c("pos") + 500).alias("idx"))


def _epoch(e):
    return f"SELECT p_partkey, row_number() OVER (ORDER BY {mix('p_partkey', 42 + e)}, p_partkey) - 1 AS pos FROM part"


@book.add(
    "W14_epoch_wrap_slice",
    f"WITH n AS (SELECT count(*) AS n FROM part), a AS ({_epoch(0)}), b AS ({_epoch(1)}) SELECT p_partkey, 0 AS epoch, pos - (n - 50) AS pos FROM a, n WHERE pos >= n - 50 UNION ALL SELECT p_partkey, 1 AS epoch, pos + 50 AS pos FROM b WHERE pos < 30",
)
def w14(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    n = part.count()
    return O.wrapped_slice(part, "p_partkey", n - 50, 80, n, 42, 0).select("p_partkey", "epoch", "pos")


@book.add("W16_cu_seqlens", f"{S} SELECT rollout_id, sample_index, sum(response_length) OVER w - response_length AS cu_start, sum(response_length) OVER w AS cu_end FROM s WINDOW w AS (PARTITION BY rollout_id ORDER BY sample_index)")
def w16(spark, d):
    return O.cumulative_lengths(V.samples(spark, d), ["rollout_id"], ["sample_index"], "response_length").select("rollout_id", "sample_index", "cu_start", "cu_end")


book.sql["W16_cu_seqlens"] = f"{S} SELECT rollout_id, sample_index, CAST(sum(response_length) OVER w - response_length AS BIGINT) AS cu_start, CAST(sum(response_length) OVER w AS BIGINT) AS cu_end FROM s WINDOW w AS (PARTITION BY rollout_id ORDER BY sample_index)"


@book.add("W11_chunks_of_three", "WITH x AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS chunk FROM events) SELECT user_id, event_id, chunk FROM x QUALIFY count(*) OVER (PARTITION BY user_id, chunk) = 3")
def w11(spark, d):
    return O.chunks_of(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@book.add("U01_buffer_then_source", "WITH b AS (SELECT event_id, 0 AS origin FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'click') SELECT event_id, origin FROM b ORDER BY origin, event_id LIMIT 2500")
def u01(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return O.buffer_then_source(e.where("event_type = 'error'").select("event_id"), e.where("event_type = 'click'").select("event_id"), "event_id", 2500)


@book.add("U02_flatten_groups", "SELECT event_id // 8 AS group_index, event_id FROM events")
def u02(spark, d):
    g = V.samples(spark, d).groupBy(F.floor(c("group_index") / 4).alias("b"), "group_index").agg(F.collect_list("sample_index").alias("x")).groupBy("b").agg(F.collect_list(F.struct("group_index", "x")).alias("y"))
    inner = g.select(F.explode("y").alias("y"))
    return inner.select("y.group_index", F.explode("y.x").alias("event_id"))


@book.add("U03_requeue_aborted", f"{S} SELECT sample_index, false AS aborted FROM s WHERE sample_index < 500 UNION ALL SELECT sample_index, true FROM s WHERE status = 'aborted'")
def u03(spark, d):
    s = V.samples(spark, d)
    return s.where("sample_index < 500").select("sample_index", F.lit(False).alias("aborted")).unionByName(s.where("status = 'aborted'").select("sample_index", F.lit(True).alias("aborted")))


@book.add("U04_union_of_roles", "SELECT event_type AS role, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def u04(spark, d):
    e = table(spark, d, "events")
    parts = [e.where(c("event_type") == k).select(F.lit(k).alias("role")) for k in ("click", "view", "purchase")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


@book.add(
    "U05_multiset_intersection",
    f"WITH s AS (SELECT sample_index, max(prompt) AS p, max(response) AS r FROM samples GROUP BY sample_index), a AS (SELECT sample_index, t, count(*) AS n FROM (SELECT sample_index, unnest({WORDS.format(x='p')}) AS t FROM s) GROUP BY ALL), b AS (SELECT sample_index, t, count(*) AS n FROM (SELECT sample_index, unnest({WORDS.format(x='r')}) AS t FROM s) GROUP BY ALL) SELECT coalesce(a.sample_index, b.sample_index) AS sample_index, CAST(sum(CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN least(a.n, b.n) ELSE 0 END) AS BIGINT) AS common, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_left, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS n_right FROM a FULL JOIN b ON a.sample_index = b.sample_index AND a.t = b.t GROUP BY 1",
)
def u05(spark, d):
    s = table(spark, d, "samples").groupBy("sample_index").agg(F.max("prompt").alias("p"), F.max("response").alias("r"))
    return R.token_overlap(s.select("sample_index", R.terms(c("p")).alias("a"), R.terms(c("r")).alias("b")), "sample_index", "a", "b")


@book.add("U06_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u06(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@book.add("U07_distinct", "SELECT DISTINCT model_name, status_code FROM request_results")
def u07(spark, d):
    return table(spark, d, "request_results").select("model_name", "status_code").distinct()


@book.add("U08_later_key_wins", "SELECT dataset_path, max(item_id) AS item_id FROM eval_items GROUP BY dataset_path")
def u08(spark, d):
    t = table(spark, d, "eval_items")
    both = t.where("item_id < 9500").withColumn("o", F.lit(0)).unionByName(t.where("item_id >= 9500").withColumn("o", F.lit(1)))
    return both.groupBy("dataset_path").agg(F.max_by("item_id", F.struct("o", "item_id")).alias("item_id"))


@book.add("J09_multiset_skip_list", "WITH k AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem), u AS (SELECT o_orderkey, 2 AS n FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, count(*) AS n FROM k LEFT JOIN u ON l_orderkey = o_orderkey WHERE rn > coalesce(u.n, 0) GROUP BY l_orderkey")
def j09(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return R.multiset_except(lines, orders.unionAll(orders), "l_orderkey", "o").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
