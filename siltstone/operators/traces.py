"""Spans, timelines and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.cumulative import range_blocks, running_max, running_total
from siltstone.session import materialize


def match_spans(events: DataFrame, keys: list[str], span: str, kind: str, at: str, seq: str) -> DataFrame:
    """One row per span: closed (start and end), open (start only) or orphan (end only). A repeated start replaces an open one."""
    w = Window.partitionBy(*keys, span).orderBy(seq)
    ordered = events.withColumn("_next", F.lead(kind).over(w)).withColumn("_next_at", F.lead(at).over(w)).withColumn("_prev", F.lag(kind).over(w))
    starts = ordered.where(F.col(kind) == "span_start").where(F.col("_next").isNull() | (F.col("_next") == "span_end"))
    closed = starts.select(*keys, span, F.col(at).alias("start"), F.col("_next_at").alias("end"), F.when(F.col("_next").isNull(), "open").otherwise("closed").alias("state"))
    orphans = ordered.where((F.col(kind) == "span_end") & (F.col("_prev").isNull() | (F.col("_prev") == "span_end")))
    return closed.unionByName(orphans.select(*keys, span, F.lit(None).cast(closed.schema["start"].dataType).alias("start"), F.col(at).alias("end"), F.lit("orphan").alias("state")))


def parent_names(spans: DataFrame, trace: str, span: str, parent: str, name: str) -> DataFrame:
    up = spans.select(F.col(trace).alias("_t"), F.col(span).alias("_p"), F.col(name).alias("parent_name"))
    return spans.join(up, (F.col(trace) == F.col("_t")) & (F.col(parent) == F.col("_p")), "left").drop("_t", "_p")


def depths(spans: DataFrame, trace: str, span: str, parent: str, rounds: int = 24) -> DataFrame:
    """Add ``depth`` in the parent tree: a missing parent is a root (0), a cycle counts as 0.

    Pointer doubling: each round joins a span to the ancestor it points at, so ``r`` rounds reach depth 2**r.
    """
    known = spans.select(F.col(trace).alias("_t"), F.col(span).alias("_p"))
    base = spans.join(known, (F.col(trace) == F.col("_t")) & (F.col(parent) == F.col("_p")), "left")
    state = base.select(trace, span, F.col("_p").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    for _ in range(rounds):  # cycles never end, so the rounds bound them: 2 ** rounds is beyond any tree
        state = materialize(state, "depths")
        if state.where("up IS NOT NULL").isEmpty():
            break
        anc = state.select(F.col(trace).alias("_t"), F.col(span).alias("_s"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        state = state.join(anc, (F.col(trace) == F.col("_t")) & (F.col("up") == F.col("_s")), "left").select(trace, span, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
    done = state.select(trace, span, F.when(F.col("up").isNull(), F.col("depth")).otherwise(0).alias("depth"))
    return spans.join(done, [trace, span])


def busy_intervals(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals per key, and the end of the one before: a span joins while it starts at or before the running end.

    A stream may hold any share of the spans: running maxima are taken in range blocks with the maximum carried from block to block, first
    of the ends, then of the starts of new intervals, which name them.
    """
    rows = spans.select(*keys, start, end).withColumn("_tie", F.monotonically_increasing_id())
    order = [start, end, "_tie"]
    reached = running_max(range_blocks(rows, keys, order), keys, order, end, inclusive=False).withColumnRenamed("_max", "_reach")
    marked = reached.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start)))
    named = running_max(materialize(marked, "marked"), keys, order, "_new")
    return named.groupBy(*keys, F.col("_max").alias("start")).agg(F.max(end).alias("end"), F.count(F.lit(1)).alias("n_spans"), F.min(F.when(F.col("_new").isNotNull(), F.col("_reach"))).alias("previous_end"))


def utilisation(merged: DataFrame, keys: list[str]) -> DataFrame:
    whole = F.max("end") - F.min("start")
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("busy"), whole.alias("span"), F.count(F.lit(1)).alias("islands")).withColumn("utilisation", F.when(F.col("span") > 0, F.col("busy") / F.col("span")).otherwise(0.0))


def gaps(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The idle times between merged intervals."""
    return merged.where("previous_end < start").select(*keys, F.col("previous_end").alias("gap_start"), F.col("start").alias("gap_end"), (F.col("start") - F.col("previous_end")).alias("gap"))


def first_overlap(gap: DataFrame, ops: DataFrame, keys: list[str], start: str, end: str, name: str, seq: str, width: float) -> DataFrame:
    """Per gap the first operation (by ``seq``) that overlaps it: both sides are cut into buckets of ``width``, so the join is an equality."""

    def buckets(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))

    left = gap.withColumn("_b", buckets("gap_start", "gap_end"))
    right = ops.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_name"), F.col(seq).alias("_seq")).withColumn("_b", buckets("_s", "_e"))
    hit = left.join(right, [*keys, "_b"]).where((F.col("_s") < F.col("gap_end")) & (F.col("_e") > F.col("gap_start")))
    first = hit.groupBy(*keys, "gap_start", "gap_end").agg(F.min_by("_name", "_seq").alias("during"))
    return gap.join(first, [*keys, "gap_start", "gap_end"], "left")


CONTEXT_VERSION = 1
CONTEXT = "version int, trace_id bigint, sample_id bigint, group_id bigint, attempt bigint, parent_span_id bigint"


def export_context(ids: dict[str, Column]) -> Column:
    """A trace's ids as a JSON payload; what is missing stays out of it."""
    return F.to_json(F.struct(F.lit(CONTEXT_VERSION).alias("version"), *[x.alias(n) for n, x in ids.items()]))


def import_context(rows: DataFrame, payload: str) -> DataFrame:
    """Add the ids of a payload; an unreadable one gives null ids, a missing attempt is 0."""
    x = F.from_json(payload, CONTEXT)
    names = [part.split()[0] for part in CONTEXT.split(", ")]
    return rows.select("*", *[(F.coalesce(x[n], F.lit(0)) if n == "attempt" else x[n]).alias(n) for n in names])


def attempts(events: DataFrame, keys: list[str], seq: str, failed: str) -> DataFrame:
    """Add ``attempt``, the failures (0 or 1) before each event of its trace, and ``_first``; a trace may hold any share of the events."""
    run = running_total(events, keys, [seq], failed).withColumn("attempt", F.col("_cum") - F.col(failed))
    first = events.groupBy(*keys).agg(F.min(seq).alias("_from"))
    return run.join(first, keys).withColumn("_first", F.col(seq) == F.col("_from")).drop("_cum", "_total", "_from")


def next_sibling(spans: DataFrame, parent: list[str], start: str) -> DataFrame:
    """Add ``next_start``: the least start among the parent's spans that is strictly later."""
    w = Window.partitionBy(*parent).orderBy(start)
    distinct = spans.select(*parent, start).distinct().withColumn("next_start", F.lead(start).over(w))
    return spans.join(distinct, [*parent, start])


def clip_open(spans: DataFrame, end: str, *bounds: Column) -> DataFrame:
    """Ends of open spans: the least of the bounds that exist."""
    return spans.withColumn("clipped_end", F.coalesce(F.col(end), F.least(*bounds)))


def kernel_class(name: Column) -> Column:
    """Category of a kernel by parts of its name, first match first."""
    n = F.lower(name)

    def has(*parts: str) -> Column:
        out = n.contains(parts[0])
        for p in parts[1:]:
            out = out | n.contains(p)
        return out

    # Name parts and their categories, in the order they are tried.
    rules = [
        (has("nccl"), "NCCL Communication"),
        (has("deep_ep") & has("dispatch"), "DeepEP Dispatch (MoE)"),
        (has("deep_ep") & has("combine"), "DeepEP Combine (MoE)"),
        (has("deep_ep") & has("clean"), "DeepEP Buffer Clean"),
        (has("deep_ep"), "DeepEP (other)"),
        (has("flash") & has("attn"), "Flash Attention"),
        (has("sparse_attn"), "Sparse Attention (MLA)"),
        (has("paged_mqa"), "Paged MQA/MLA Logits"),
        (has("attention", "fmha"), "Attention (other)"),
        (has("deep_gemm", "sm90_fp8_gemm"), "DeepGEMM (FP8)"),
        (has("nvjet"), "NvJet GEMM"),
        (has("gemm", "cutlass", "matmul", "cublas"), "GEMM/MatMul (other)"),
        (has("topk"), "TopK / MoE Routing"),
        (has("quant"), "Quantization (FP8)"),
        (has("norm"), "Normalization"),
        (has("triton", "fused"), "Fused/Triton Kernels"),
        (has("elementwise"), "Elementwise Ops"),
        (has("reduce", "softmax"), "Reduce/Softmax"),
        (has("embedding"), "Embedding"),
        (has("memcpy", "memset"), "Memory Ops"),
        (has("index", "scatter", "gather"), "Index/Gather/Scatter"),
        (has("cat") & has("batched"), "Concat/Cat"),
    ]
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise("Other Compute")


def by_category(kernels: DataFrame, name: str, duration: str) -> DataFrame:
    return kernels.groupBy(kernel_class(F.col(name)).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(duration).alias("total"))


def per_stream(kernels: DataFrame, stream: str, start: str, duration: str) -> DataFrame:
    end = F.max(F.col(start) + F.col(duration))
    return kernels.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.sum(duration).alias("total"), (end - F.min(start)).alias("span")).withColumn("utilisation", F.when(F.col("span") > 0, F.col("total") / F.col("span")).otherwise(0.0))


def spread(values: DataFrame, metric: str, value: str, imbalance: float = 5.0) -> DataFrame:
    """(metric, min, max, spread in percent of the minimum, flagged) over ranks."""
    low, high = F.min(value), F.max(value)
    percent = F.when(low > 0, (high - low) / low * 100.0).otherwise(0.0)
    return values.groupBy(metric).agg(low.alias("min"), high.alias("max"), percent.alias("spread")).withColumn("imbalanced", F.col("spread") > imbalance)


def lanes(items: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """An extra row per attribute family that is present on an item, with its lane offset among the item's families."""
    present = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("lane"), F.col(f).cast("double").alias("value"))) for f in families]), lambda x: x.isNotNull())
    return items.select(*keys, F.posexplode(present).alias("offset", "x")).select(*keys, (F.col("offset") + 1).alias("offset"), "x.lane", "x.value")


def stack_parents(events: DataFrame, trace: str, schema: str) -> DataFrame:
    """Enclosing open span of each event in order: a stack per trace, from which an end removes only its own id (grouped in pandas)."""

    def fold(pdf):
        stack, parents = [], []
        for kind, span in zip(pdf["kind"], pdf["span"]):
            parents.append(stack[-1] if stack else None)
            if kind == "span_start":
                stack.append(span)
            elif kind == "span_end" and span in stack:
                parents[-1] = None
                at = len(stack) - 1 - stack[::-1].index(span)
                parents[-1] = stack[at - 1] if at else None
                del stack[at]
        return pdf.assign(enclosing=parents)

    def run(pdf):
        out = fold(pdf.sort_values("seq"))
        out["enclosing"] = out["enclosing"].astype("Int64")
        return out

    return events.groupBy(trace).applyInPandas(run, schema)
