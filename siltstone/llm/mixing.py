"""Mixing sources to target weights by soft membership.

1. Every document is measured in tokens. Its membership is a posterior over the domains (the sources that occur): certain where the source
   is labelled, predicted by a softmax classifier over hashed words elsewhere. The classifier is fitted on a bounded sample of labelled
   rows (``train_docs``); nothing else is sampled, and posteriors are used as they come.
2. Distributed projected gradient descent fits a rate to every document, between 0 and its repeat cap, so that the expected tokens per domain
   come closest to ``share x budget`` (least squares, each domain's miss measured against its supply). A round is one pass over document
   blocks: a block replays its documents' rates from the steps so far, which are one vector per mixture and round, and gives back its expected
   tokens per domain; only their sums reach the driver. In the metric of tokens and supplies a step of 1 never overshoots. Labelled documents
   of one domain have one rate, so they enter as one row.
3. A rate becomes whole copies: everyone gets the whole part. Then, per domain, the documents least by hash over remaining fraction get one
   more while the sum of the fractions' tokens is met, by a distributed prefix sum, so a source may hold any share of the rows. Last, the
   later document whose size is closest to what is missing is added while one brings the total nearer and more than ``NEAR`` of the target
   is missing.

Defined cases: source names are compared without case and outer blanks; null, blank and unknown sources count as unlabelled; documents
without tokens are never drawn; a domain that the mixture does not name has target 0 and cap 0, as has a document most likely of such a
domain; an unlabelled document's cap is that of its most likely domain; a wanted source with too few or no documents is used up to its cap
and reported with the share reached; duplicated target rows add up (their smallest cap holds); negative and null shares count as 0, null
caps as 1; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokens import VOCABULARY, n_tokens
from siltstone.operators.cumulative import running_total
from siltstone.session import materialize

BUCKETS = 4096
TRAIN_DOCS = 4000
MAX_DOMAINS = 4096
MAX_TARGETS = 100_000
ROUNDS, STILL, NEAR = 60, 1e-5, 1e-3
WORD = re.compile(r"[^\W\d_]+|[^\s\w]", re.UNICODE)


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def features(text: str | None) -> np.ndarray:
    """Unit-length log counts of hashed words; of scripts without spaces, of character pairs."""
    counts: dict[int, int] = {}
    for w in WORD.findall((text or "").lower()):
        parts = [w[i : i + 2] for i in range(len(w))] if w[0] > "⹿" else [w]
        for p in parts:
            b = _bucket(p)
            counts[b] = counts.get(b, 0) + 1
    x = np.zeros(BUCKETS, np.float32)
    if counts:
        x[list(counts)] = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        x /= np.linalg.norm(x)
    return x


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, classes) of multinomial logistic regression, by full-batch gradient descent with momentum."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, v = np.zeros((x.shape[1], classes), np.float32), np.zeros((x.shape[1], classes), np.float32)
    goal = np.eye(classes, dtype=np.float32)[y]
    for _ in range(steps):
        v = 0.9 * v - rate * 0.1 * (x.T @ (softmax(x @ w) - goal) / len(x) + decay * w)
        w = w + v
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(w: np.ndarray, texts: list[str | None]) -> np.ndarray:
    x = np.stack([features(t) for t in texts])
    return softmax(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ w)


def _name(column: str):
    return F.lower(F.trim(F.col(column)))


MEMBERS = "doc_id bigint, n_tokens bigint, domain int, p array<float>"


def memberships(documents: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, list[str]]:
    """``MEMBERS`` of all documents with tokens, written once, and the domains: ``domain`` is the likeliest one, ``p`` null where it is certain."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), _name("source").alias("domain"), "text", n_tokens(F.col("text"), vocabulary).cast("bigint").alias("n_tokens"))
    rows = rows.withColumn("domain", F.when(F.col("domain") != "", F.col("domain"))).withColumn("text", F.when(F.col("domain").isNull(), F.col("text")))
    rows = materialize(rows, "sizes").where("n_tokens > 0")  # filtered as it is read, or every text would be measured twice
    sizes = {r[0]: r[1] for r in rows.where("domain IS NOT NULL").groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} sources")
    domains = sorted(sizes)
    names = F.array(*[F.lit(d) for d in domains]) if domains else F.array().cast("array<string>")
    certain = rows.where("domain IS NOT NULL").select("doc_id", "n_tokens", (F.array_position(names, F.col("domain")) - 1).cast("int").alias("domain"), F.lit(None).cast("array<float>").alias("p"))
    unlabelled = rows.where("domain IS NULL")
    if not domains or unlabelled.isEmpty():
        return certain, domains
    w = _train(documents, sizes, train_docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                p = posteriors(w, part.column(2).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p.argmax(axis=1), pa.int32()), pa.array(list(p), pa.list_(pa.float32()))], names=["doc_id", "n_tokens", "domain", "p"])

    soft = materialize(unlabelled.select("doc_id", "n_tokens", "text").mapInArrow(predict, MEMBERS), "predicted")
    return certain.unionByName(soft), domains


def _train(documents: DataFrame, sizes: dict[str, int], train_docs: int) -> np.ndarray:
    """Fit on at most ``train_docs`` labelled rows, as many of each source as far as they go, chosen by a hash of the document."""
    domains = sorted(sizes)
    each = max(train_docs // len(domains), 1)
    bar = F.lit(0.0)
    for d in domains:
        bar = F.when(F.col("domain") == d, F.lit(min(1.0, 1.25 * each / sizes[d]))).otherwise(bar)
    labelled = documents.select(_name("source").alias("domain"), "text", F.xxhash64("doc_id").alias("h")).where("domain IS NOT NULL AND text IS NOT NULL")
    rows = labelled.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < bar).limit(2 * train_docs).collect()
    sample: dict[str, list] = {d: [] for d in domains}
    for r in sorted(rows, key=lambda r: r["h"]):
        if r["domain"] in sample and len(sample[r["domain"]]) < each:
            sample[r["domain"]].append(r["text"])
    x = np.stack([features(t) for d in domains for t in sample[d]])
    return fit_softmax(x, np.array([i for i, d in enumerate(domains) for _ in sample[d]]), len(domains))


def held_out_accuracy(documents: DataFrame, train_docs: int = TRAIN_DOCS, one_in: int = 5) -> float:
    """Share of the labelled documents kept from training (every fifth by hash) whose likeliest domain is their source."""
    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(one_in)) == 0
    usable = documents.withColumn("_s", _name("source")).where("_s <> '' AND trim(text) <> ''")
    sizes = {r[0]: r[1] for r in usable.where(~fold).groupBy("_s").count().collect()}
    w, domains = _train(usable.where(~fold), sizes, train_docs), sorted(sizes)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best = posteriors(w, b.column(1).to_pylist()).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([domains[i] == s for i, s in zip(best, b.column(0).to_pylist())])], names=["right"])

    return usable.where(fold).select("_s", "text").mapInArrow(right, "right boolean").agg(F.avg(F.col("right").cast("double"))).first()[0]


class Steps(NamedTuple):
    """What every block needs to know of the descent: the steps so far (round, mixture, domain) and the caps (mixture, domain)."""

    taken: np.ndarray
    cap: np.ndarray

    def rates(self, p: np.ndarray, domain: np.ndarray) -> np.ndarray:
        """(document, mixture): the rates after all steps."""
        most = self.cap[:, domain].T
        x = np.zeros_like(most)
        for step in self.taken:
            x = np.clip(x - p @ step.T, 0.0, most)
        return x


def _posteriors(domain: np.ndarray, p: pa.Array, n_domains: int) -> np.ndarray:
    out = np.zeros((len(domain), n_domains))
    out[np.arange(len(domain)), domain] = 1.0
    soft = [i for i, ok in enumerate(p.is_valid().to_pylist()) if ok]
    if soft:
        out[soft] = np.array(p.take(pa.array(soft)).to_pylist())
    return out


def _expected(steps: Steps | None, n_domains: int):
    """Per task, the expected tokens (mixture, domain); without steps, the supply (as mixture 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 if steps is None else len(steps.cap), n_domains))
        for b in batches:
            domain, tokens = b.column(1).to_numpy(), b.column(0).to_numpy().astype(float)
            p = _posteriors(domain, b.column(2), n_domains)
            x = np.ones((len(domain), 1)) if steps is None else steps.rates(p, domain)
            total += (tokens[:, None] * x).T @ p
        m, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(d, pa.int32()), pa.array(total[m, d])], names=["mix", "domain", "tokens"])

    return run


def _sums(rows: DataFrame, steps: Steps | None, mixes: int, n_domains: int) -> np.ndarray:
    out = np.zeros((mixes, n_domains))
    for r in rows.mapInArrow(_expected(steps, n_domains), "mix int, domain int, tokens double").groupBy("mix", "domain").agg(F.sum("tokens").alias("tokens")).toLocalIterator():
        out[r["mix"], r["domain"]] = r["tokens"]
    return out


def descend(rows: DataFrame, goal: np.ndarray, cap: np.ndarray, supply: np.ndarray) -> Steps:
    """Projected gradient descent for documents (n_tokens, domain, p): least squares of expected tokens against ``goal`` (mixture, domain)."""
    scale = np.divide(1.0, supply, out=np.zeros_like(supply), where=supply > 0)
    steps, reached = Steps(np.zeros((0, *goal.shape)), cap), np.zeros_like(goal)
    bar = STILL * np.maximum(goal.sum(axis=1, keepdims=True), 1.0)
    for _ in range(ROUNDS):
        steps = Steps(np.concatenate([steps.taken, ((reached - goal) * scale)[None]]), cap)
        before, reached = reached, _sums(rows, steps, *goal.shape)
        if (np.abs(reached - before) <= bar).all():
            break
    return steps


RATED = "mix int, domain int, doc_id bigint, n_tokens bigint, low int, fraction double, place double"


def _rated(steps: Steps, n_domains: int):
    """A row per document and mixture that it has a rate in; ``place`` is its place in the order of those that get one more copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            domain = b.column(2).to_numpy()
            x = steps.rates(_posteriors(domain, b.column(3), n_domains), domain)
            low = np.floor(x + 1e-9)
            fraction = np.where(x - low > 1e-9, x - low, 0.0)
            i, m = np.nonzero(x > 1e-9)
            place = b.column(4).to_numpy()[i] / np.maximum(fraction[i, m], 1e-12)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m, pa.int32()), pa.array(domain[i], pa.int32()), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(low[i, m], pa.int32()), pa.array(fraction[i, m]), pa.array(place)],
                names=["mix", "domain", "doc_id", "n_tokens", "low", "fraction", "place"],
            )

    return run


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The draw (mix_name, doc_id, copies, n_tokens) and the report per mixture and source."""
    spark = documents.sparkSession
    members, domains = memberships(documents, vocabulary, train_docs)
    wanted = targets.select("mix_name", _name("source").alias("source"), "target_share", "max_repeats", "budget_ratio").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    certain = members.where("p IS NULL").groupBy("domain").agg(F.sum("n_tokens").alias("n_tokens")).select("n_tokens", "domain", F.lit(None).cast("array<float>").alias("p"))
    rows = materialize(certain.unionByName(members.where("p IS NOT NULL").select("n_tokens", "domain", "p")), "blocks")
    supply = _sums(rows, None, 1, len(domains))[0]
    mixes = sorted({r["mix_name"] for r in wanted}, key=str)
    goal, cap = np.zeros((len(mixes), len(domains))), np.zeros((len(mixes), len(domains)))
    goals = []
    for k, name in enumerate(mixes):
        share: dict[str, float] = {}
        most: dict[str, int] = {}
        budget = 0.0
        for r in (r for r in wanted if r["mix_name"] == name):
            weight, repeats = r["target_share"], r["max_repeats"]
            share[r["source"]] = share.get(r["source"], 0.0) + (weight if weight and weight > 0 else 0.0)
            most[r["source"]] = min(most.get(r["source"], 1 << 30), 1 if repeats is None else max(repeats, 0))
            budget = max(budget, (r["budget_ratio"] or 0.0) * float(supply.sum()))
        whole = sum(share.values()) or 1.0
        goal[k] = [share.get(d, 0.0) / whole * budget for d in domains]
        cap[k] = [most.get(d, 0) for d in domains]
        goals += [(name, s, share[s] / whole, share[s] / whole * budget, most[s]) for s in sorted(share, key=str)]
    steps = descend(rows, goal, cap, supply)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    rated = members.select("doc_id", "n_tokens", "domain", "p", uniform.alias("u")).mapInArrow(_rated(steps, len(domains)), RATED)
    draw = materialize(_whole_copies(rated), "draw")
    names = spark.createDataFrame(list(enumerate(mixes)), "mix int, mix_name string")  # at most one row per target row
    sources = spark.createDataFrame(list(enumerate(domains)), "domain int, source string")
    soft = members.where("p IS NOT NULL").select("doc_id", "p")
    parts = draw.join(soft, "doc_id", "left").select("mix", "copies", "n_tokens", "domain", "p")
    certain = parts.where("p IS NULL").select("mix", "domain", (F.col("copies") * F.col("n_tokens")).cast("double").alias("t"), F.lit(1).alias("docs"), "copies")
    shared = parts.where("p IS NOT NULL").select("mix", F.posexplode("p").alias("domain", "w"), "copies", "n_tokens", F.col("domain").alias("_top"))
    shared = shared.select("mix", "domain", (F.col("w") * F.col("copies") * F.col("n_tokens")).alias("t"), (F.col("domain") == F.col("_top")).cast("int").alias("docs"), F.when(F.col("domain") == F.col("_top"), F.col("copies")).otherwise(0).alias("copies"))
    reached = certain.unionByName(shared).groupBy("mix", "domain").agg(F.sum("t").alias("reached_tokens"), F.sum("docs").alias("n_docs"), F.max("copies").alias("most_copies"))
    reached = reached.join(F.broadcast(names), "mix").join(F.broadcast(sources), "domain").drop("mix", "domain")
    goals_df = spark.createDataFrame(goals, "mix_name string, source string, target_share double, target_tokens double, max_repeats int")
    report = goals_df.join(reached, ["mix_name", "source"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reached_tokens", "n_docs", "most_copies", "target_share", "target_tokens")})
    sums = reached.groupBy("mix_name").agg(F.sum("reached_tokens").alias("_all"))
    report = report.join(sums, "mix_name", "left").withColumn("reached_share", F.coalesce(F.col("reached_tokens") / F.col("_all"), F.lit(0.0))).drop("_all")
    return draw.join(F.broadcast(names), "mix").select("mix_name", "doc_id", "copies", F.col("n_tokens").cast("int").alias("n_tokens")), report


def _whole_copies(rated: DataFrame) -> DataFrame:
    """(mix, domain, doc_id, n_tokens, copies) from rates: the whole parts, and one more where the fractions' tokens go."""
    spark = rated.sparkSession
    key = ["mix", "domain"]
    placed = materialize(running_total(rated, key, ["place", "doc_id"], "n_tokens").drop("_total"), "placed")
    upto = placed.groupBy(*key).agg(F.sum(F.col("fraction") * F.col("n_tokens")).alias("more"), F.sum(F.col("n_tokens") * (F.col("low") + F.col("fraction"))).alias("target"))
    placed = materialize(placed.join(F.broadcast(upto.select(*key, "more")), key).withColumn("first", (F.col("_cum") <= F.col("more")) & (F.col("fraction") > 0)), "first")
    met = placed.groupBy(*key).agg((F.max("more") - F.sum(F.when(F.col("first"), F.col("n_tokens")).otherwise(0))).alias("gap")).join(upto, key)
    gaps = {(r["mix"], r["domain"]): r["gap"] for r in met.toLocalIterator() if r["gap"] > NEAR * r["target"]}  # one row per mixture and domain
    bars = {(r["mix"], r["domain"]): NEAR * r["target"] for r in upto.toLocalIterator()}
    picks: list[tuple] = []
    schema = "mix int, domain int, doc_id bigint, one_more int"
    while gaps:
        wanted = spark.createDataFrame([(*k, float(g)) for k, g in gaps.items()], "mix int, domain int, gap double")
        miss = F.abs(F.col("n_tokens") - F.col("gap"))
        rest = placed.where("NOT first AND fraction > 0").join(F.broadcast(wanted), key).where(miss < F.abs("gap"))
        rest = rest.join(F.broadcast(spark.createDataFrame(picks, schema)), [*key, "doc_id"], "left_anti")
        found = rest.groupBy(*key).agg(F.min(F.struct(miss.alias("miss"), "place", "doc_id", "n_tokens")).alias("pick")).collect()
        left = {}
        for r in found:
            at = r["mix"], r["domain"]
            picks.append((*at, r["pick"]["doc_id"], 1))
            if (gap := gaps[at] - r["pick"]["n_tokens"]) > bars[at]:
                left[at] = gap
        gaps = left
    more = placed.join(F.broadcast(spark.createDataFrame(picks, schema)), [*key, "doc_id"], "left")
    more = more.withColumn("copies", F.col("low") + F.col("first").cast("int") + F.coalesce("one_more", F.lit(0)))
    return more.where("copies > 0").select(*key, "doc_id", "n_tokens", "copies")
