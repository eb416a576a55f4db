"""Queries of spans, timelines and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import traces as T
from siltstone.plans import views as V
from siltstone.plans.book import Book
from siltstone.session import table

book = Book()
P = f"WITH {V.SPANS}"
I = f"WITH {V.INTERVALS}"
c = F.col


def r3(x):
    return F.round(x, 3) + F.lit(0.0)


def span_events(spark, d):
    """Starts and ends as events: some ends are missing, some starts too."""
    s = V.spans(spark, d)
    starts = s.where("span % 11 <> 0").select("trace", "span", F.lit("span_start").alias("kind"), c("start").alias("at"), (c("span") * 2).alias("seq"))
    ends = s.where("end IS NOT NULL AND span % 7 <> 0").select("trace", "span", F.lit("span_end").alias("kind"), c("end").alias("at"), (c("span") * 2 + 1).alias("seq"))
    return starts.unionByName(ends)


@book.add(
    "J05_match_spans",
    f'{P} SELECT trace, span, CASE WHEN span % 11 <> 0 THEN round(start, 3) END AS start, CASE WHEN "end" IS NOT NULL AND span % 7 <> 0 THEN round("end", 3) END AS "end", CASE WHEN span % 11 = 0 THEN \'orphan\' WHEN "end" IS NULL OR span % 7 = 0 THEN \'open\' ELSE \'closed\' END AS state FROM p WHERE span % 11 <> 0 OR ("end" IS NOT NULL AND span % 7 <> 0)',
)
def j05(spark, d):
    out = T.match_spans(span_events(spark, d), ["trace"], "span", "kind", "at", "seq")
    return out.select("trace", "span", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "state")


@book.add("J06_parent_names", f"{P} SELECT a.trace, a.span, b.name AS parent_name FROM p a LEFT JOIN p b ON a.trace = b.trace AND a.parent = b.span")
def j06(spark, d):
    return T.parent_names(V.spans(spark, d), "trace", "span", "parent", "name").select("trace", "span", "parent_name")


@book.add(
    "J07_span_depths",
    f"WITH RECURSIVE {V.SPANS}, t AS (SELECT a.trace, a.span, b.span AS up FROM p a LEFT JOIN p b ON a.trace = b.trace AND a.parent = b.span), w AS (SELECT trace, span, CAST(0 AS BIGINT) AS depth FROM t WHERE up IS NULL UNION ALL SELECT t.trace, t.span, w.depth + 1 FROM t JOIN w ON t.trace = w.trace AND t.up = w.span) SELECT trace, span, depth FROM w",
)
def j07(spark, d):
    return T.depths(V.spans(spark, d), "trace", "span", "parent").select("trace", "span", "depth")


MERGED = """o AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY stream ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
l AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
m AS (SELECT stream, min(start) AS start, max("end") AS "end", count(*) AS n_spans FROM l GROUP BY stream, island)"""
G = """g AS (SELECT * FROM (SELECT stream, lag("end") OVER (PARTITION BY stream ORDER BY start) AS gap_start, start AS gap_end FROM m) WHERE gap_start < gap_end)"""


@book.add("W10_busy_intervals", f'{I}, {MERGED} SELECT stream, round(start, 3) AS start, round("end", 3) AS "end", n_spans FROM m')
def w10(spark, d):
    return T.busy_intervals(V.intervals(spark, d), ["stream"], "start", "end").select("stream", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n_spans")


@book.add("W10_utilisation", f'{I}, {MERGED} SELECT stream, round(sum("end" - start), 3) AS busy, round(max("end") - min(start), 3) AS span, count(*) AS islands, round(sum("end" - start) / (max("end") - min(start)), 6) AS utilisation FROM m GROUP BY stream')
def w10u(spark, d):
    out = T.utilisation(T.busy_intervals(V.intervals(spark, d), ["stream"], "start", "end"), ["stream"])
    return out.select("stream", r3(c("busy")).alias("busy"), r3(c("span")).alias("span"), "islands", F.round("utilisation", 6).alias("utilisation"))


@book.add("O09_largest_gaps", f"{I}, {MERGED}, {G} SELECT stream, round(gap_start, 3) AS gap_start, round(gap_end - gap_start, 3) AS gap FROM g ORDER BY gap_end - gap_start DESC, gap_start LIMIT 15")
def o09(spark, d):
    g = T.gaps(T.busy_intervals(V.intervals(spark, d), ["stream"], "start", "end"), ["stream"])
    return g.orderBy(F.desc("gap"), "gap_start").limit(15).select("stream", F.round("gap_start", 3).alias("gap_start"), r3(c("gap")).alias("gap"))


@book.add(
    "J08_gap_operation_overlap",
    f'{I}, {MERGED}, {G}, h AS (SELECT g.stream, g.gap_start, g.gap_end, arg_min(b.user_id, b.seq) AS during FROM g JOIN i b ON b.start < g.gap_end AND b."end" > g.gap_start GROUP BY ALL) SELECT g.stream, round(g.gap_start, 3) AS gap_start, CAST(h.during AS VARCHAR) AS during FROM g LEFT JOIN h ON g.stream = h.stream AND g.gap_start = h.gap_start',
)
def j08(spark, d):
    i = V.intervals(spark, d)
    g = T.gaps(T.busy_intervals(i, ["stream"], "start", "end"), ["stream"]).withColumn("all", F.lit(1))
    ops = i.select(F.lit(1).alias("all"), "start", "end", c("user_id").cast("string").alias("name"), "seq")
    out = T.first_overlap(g.drop("gap"), ops, ["all"], "start", "end", "name", "seq", 600.0)
    return out.select("stream", F.round("gap_start", 3).alias("gap_start"), "during")


@book.add("W09_next_sibling", f"{P}, n AS (SELECT trace, start, lead(start) OVER (PARTITION BY trace ORDER BY start) AS nx FROM (SELECT DISTINCT trace, start FROM p)) SELECT p.trace, p.span, round(n.nx, 3) AS next_start FROM p JOIN n ON p.trace = n.trace AND p.start = n.start")
def w09(spark, d):
    return T.next_sibling(V.spans(spark, d), ["trace"], "start").select("trace", "span", F.round("next_start", 3).alias("next_start"))


@book.add(
    "J11_open_span_clipping",
    f'{P}, e AS (SELECT trace, max(coalesce("end", start)) AS last FROM p GROUP BY trace), o AS (SELECT p.*, lead(p.start) OVER (PARTITION BY p.trace ORDER BY p.start) AS nx FROM p) SELECT o.trace, o.span, round(CASE WHEN o.span % 7 <> 0 AND o."end" IS NOT NULL THEN o."end" ELSE least(o.nx, e.last) END, 3) AS clipped_end FROM o JOIN e USING (trace)',
)
def j11(spark, d):
    s = V.spans(spark, d)
    last = s.groupBy("trace").agg(F.max(F.coalesce("end", "start")).alias("last"))
    opened = T.next_sibling(s, ["trace"], "start").join(last, "trace").withColumn("known", F.when(c("span") % 7 != 0, c("end")))
    return T.clip_open(opened, "known", c("next_start"), c("last")).select("trace", "span", F.round("clipped_end", 3).alias("clipped_end"))


@book.add(
    "W08_enclosing_span",
    f"""WITH RECURSIVE {V.SPANS}, e AS (SELECT trace, span, 'span_start' AS kind, span * 2 AS seq FROM p WHERE span % 11 <> 0 UNION ALL SELECT trace, span, 'span_end', span * 2 + 1 FROM p WHERE "end" IS NOT NULL AND span % 7 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY seq) AS i FROM e),
f AS (SELECT DISTINCT trace, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS enclosing FROM e
UNION ALL SELECT trace, i, CASE WHEN kind = 'span_start' THEN list_append(stack, span) WHEN place > 0 THEN list_concat(stack[1:place - 1], stack[place + 1:]) ELSE stack END, CASE WHEN kind = 'span_start' OR place = 0 THEN stack[len(stack)] WHEN place > 1 THEN stack[place - 1] END
FROM (SELECT n.trace, n.i, n.kind, n.span, f.stack, CASE WHEN list_contains(f.stack, n.span) THEN len(f.stack) - list_position(list_reverse(f.stack), n.span) + 1 ELSE 0 END AS place FROM f JOIN n ON n.trace = f.trace AND n.i = f.i + 1))
SELECT n.trace, n.span, n.kind, n.seq, f.enclosing FROM n JOIN f USING (trace, i)""",
)
def w08(spark, d):
    rows = span_events(spark, d).select("trace", "span", "kind", "seq")
    return T.stack_parents(rows, "trace", "trace bigint, span bigint, kind string, seq bigint, enclosing bigint")


NAMES = "CASE p_size % 6 WHEN 0 THEN 'nccl_all_reduce' WHEN 1 THEN 'flash_fwd_attn' WHEN 2 THEN 'cutlass_gemm' WHEN 3 THEN 'rmsnorm_kernel' WHEN 4 THEN 'Memcpy DtoH' ELSE p_name END"
CLASS = "CASE p_size % 6 WHEN 0 THEN 'NCCL Communication' WHEN 1 THEN 'Flash Attention' WHEN 2 THEN 'GEMM/MatMul (other)' WHEN 3 THEN 'Normalization' WHEN 4 THEN 'Memory Ops' ELSE 'Other Compute' END"


def kernels(spark, d):
    k = F.pmod("p_size", F.lit(6))
    name = F.when(k == 0, "nccl_all_reduce").when(k == 1, "flash_fwd_attn").when(k == 2, "cutlass_gemm").when(k == 3, "rmsnorm_kernel").when(k == 4, "Memcpy DtoH").otherwise(c("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), c("p_retailprice").alias("dur"), c("p_partkey").cast("double").alias("start"), F.pmod("p_partkey", F.lit(4)).alias("tid"))


@book.add("A29_kernel_time_by_category", f"SELECT {CLASS} AS category, count(*) AS n, round(sum(p_retailprice), 3) AS total FROM part GROUP BY 1")
def a29(spark, d):
    return T.by_category(kernels(spark, d), "name", "dur").withColumn("total", r3(c("total")))


@book.add("C42_kernel_classes", f"SELECT p_partkey, {CLASS} AS category FROM part")
def c42(spark, d):
    return kernels(spark, d).select("p_partkey", T.kernel_class(c("name")).alias("category"))


@book.add("A30_stream_utilisation", "SELECT p_partkey % 4 AS tid, count(*) AS n, round(sum(p_retailprice), 3) AS total, round(max(p_partkey + p_retailprice) - min(p_partkey), 3) AS span FROM part GROUP BY 1")
def a30(spark, d):
    return T.per_stream(kernels(spark, d), "tid", "start", "dur").select("tid", "n", r3(c("total")).alias("total"), r3(c("span")).alias("span"))


@book.add("A31_cross_rank_spread", "WITH r AS (SELECT event_type AS metric, event_id % 8 AS rank, sum(value) AS v FROM events GROUP BY ALL) SELECT metric, round(min(v), 3) AS min, round(max(v), 3) AS max, round((max(v) - min(v)) / min(v) * 100.0, 3) AS spread, (max(v) - min(v)) / min(v) * 100.0 > 5 AS imbalanced FROM r GROUP BY metric")
def a31(spark, d):
    per = table(spark, d, "events").groupBy(c("event_type").alias("metric"), F.pmod("event_id", F.lit(8)).alias("rank")).agg(F.sum("value").alias("v"))
    return T.spread(per, "metric", "v").select("metric", r3(c("min")).alias("min"), r3(c("max")).alias("max"), r3(c("spread")).alias("spread"), "imbalanced")


@book.add("A35_timeline_rows", f'{P} SELECT trace, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n, count(CASE WHEN "end" IS NULL THEN 1 END) AS n_open, round(sum(value), 3) AS total, max(value) AS longest FROM p GROUP BY trace')
def a35(spark, d):
    g = V.spans(spark, d).groupBy("trace")
    return g.agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("end"), 3).alias("end"), F.count(F.lit(1)).alias("n"), F.count(F.when(c("end").isNull(), 1)).alias("n_open"), r3(F.sum("value")).alias("total"), F.max("value").alias("longest"))


@book.add("A36_global_bounds", f'{P} SELECT round(min(start), 3) AS start, round(max("end"), 3) AS "end" FROM p')
def a36(spark, d):
    return V.spans(spark, d).agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("end"), 3).alias("end"))


@book.add("A39_totals_by_name", "SELECT round(sum(CASE WHEN event_type LIKE 'c%' THEN value ELSE 0 END), 3) AS c_total, round(sum(CASE WHEN event_type LIKE '%err%' THEN value ELSE 0 END), 3) AS err_total FROM events")
def a39(spark, d):
    v = c("value")
    return table(spark, d, "events").agg(r3(F.sum(F.when(c("event_type").like("c%"), v).otherwise(0))).alias("c_total"), r3(F.sum(F.when(c("event_type").like("%err%"), v).otherwise(0))).alias("err_total"))


@book.add("P31_trace_header", "SELECT dataset_name, coalesce(rm_type, 'unknown') AS device, coalesce(n_samples_per_eval_prompt, 12000) // 1000 AS major, coalesce(n_samples_per_eval_prompt, 12000) % 1000 // 10 AS minor FROM eval_datasets")
def p31(spark, d):
    version = F.coalesce(c("n_samples_per_eval_prompt"), F.lit(12000))
    major, minor = F.call_function("div", version, F.lit(1000)), F.call_function("div", F.pmod(version, F.lit(1000)), F.lit(10))
    return table(spark, d, "eval_datasets").select("dataset_name", F.coalesce("rm_type", F.lit("unknown")).alias("device"), major.cast("int").alias("major"), minor.cast("int").alias("minor"))


@book.add(
    "P32_virtual_lanes",
    "WITH x AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS prefill, CASE WHEN event_type <> 'error' THEN value / 2 END AS decode FROM events) SELECT event_id, CAST(1 AS INTEGER) AS lane_no, 'prefill' AS lane, prefill AS value FROM x WHERE prefill IS NOT NULL UNION ALL SELECT event_id, CASE WHEN prefill IS NULL THEN 1 ELSE 2 END, 'decode', decode FROM x WHERE decode IS NOT NULL",
)
def p32(spark, d):
    e = table(spark, d, "events").withColumns({"prefill": F.when(c("event_type") != "view", c("value")), "decode": F.when(c("event_type") != "error", c("value") / 2)})
    return T.lanes(e, ["event_id"], ["prefill", "decode"]).select("event_id", c("offset").alias("lane_no"), "lane", "value")


@book.add("P34_unified_items", f"{P} SELECT trace, span, 'span' AS kind, round(start, 3) AS at FROM p WHERE \"end\" IS NOT NULL UNION ALL SELECT trace, span, 'point', round(start, 3) FROM p WHERE \"end\" IS NULL")
def p34(spark, d):
    s = V.spans(spark, d)
    closed = s.where("end IS NOT NULL").select("trace", "span", F.lit("span").alias("kind"), c("start").alias("at"), "end")
    points = s.where("end IS NULL").select("trace", "span", F.lit("point").alias("kind"), c("start").alias("at"))
    return closed.unionByName(points, allowMissingColumns=True).select("trace", "span", "kind", F.round("at", 3).alias("at"))


@book.add("O10_timeline_order", f'{P} SELECT trace, span, row_number() OVER (PARTITION BY trace ORDER BY start, coalesce("end", start), name, span) - 1 AS pos FROM p')
def o10(spark, d):
    from siltstone.operators.ordering import positions

    s = V.spans(spark, d).withColumn("till", F.coalesce("end", "start"))
    return positions(s, ["start", "till", "name", "span"], "pos", ["trace"]).select("trace", "span", "pos")


@book.add("C47_safe_durations", f'{P} SELECT trace, span, round(greatest(0.0, "end" - start - 5.0), 3) AS duration FROM p')
def c47(spark, d):
    return V.spans(spark, d).select("trace", "span", (F.round(F.when(c("end").isNotNull(), F.greatest(F.lit(0.0), c("end") - c("start") - 5.0)), 3) + F.lit(0.0)).alias("duration"))


book.sql["C47_safe_durations"] = f'{P} SELECT trace, span, CASE WHEN "end" IS NOT NULL THEN round(greatest(0.0, "end" - start - 5.0), 3) END AS duration FROM p'
