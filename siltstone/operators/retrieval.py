"""Retrieval and lookup joins: dense and term search, containment, multiset differences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 4096


def _units(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length one (a zero vector stays)."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    v = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str) -> DataFrame:
    """(query, corpus id, score, rank) of the k largest inner products of unit vectors (to twelve digits), ties by id.

    Queries are taken in blocks of at most ``MAX_QUERIES`` against all corpus rows, one matrix product per Arrow batch; each task keeps its
    own k best per query before the shuffle.
    """
    n = queries.count()
    blocks = max(1, -(-n // MAX_QUERIES))
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL")
    base = corpus.select(F.col(corpus_id).cast("bigint"), F.col(vector)).where(F.col(vector).isNotNull())
    out = None
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow()
        if held.num_rows:
            part = base.mapInArrow(_nearest(held.column(0).to_numpy(), _units(held.column(1)), k), "q bigint, hit_id bigint, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], "q bigint, hit_id bigint, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "hit_id")
    ranked = out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), "hit_id", "score", "rank")


def _nearest(ids: np.ndarray, asked: np.ndarray, k: int):
    """Per task, the k best corpus rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score, best_id = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            score = np.round(asked @ _units(b.column(1)).T, 12)
            score = np.concatenate([best_score, score], axis=1)
            hits = np.concatenate([best_id, np.broadcast_to(b.column(0).to_numpy(), (len(ids), b.num_rows))], axis=1)
            order = np.lexsort((hits, -score), axis=1)[:, :k]
            best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(hits, order, 1)
        wide = best_id.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, wide)), pa.array(best_id.ravel()), pa.array(best_score.ravel())], names=["q", "hit_id", "score"])

    return run


MAX_HELD_CHARS = 32 << 20


def containment_counts(records: DataFrame, items: DataFrame, text: str, item: str) -> DataFrame:
    """(item text, n): in how many records each distinct item text stands, whole and exactly; overlapping hits all count.

    One pass of an automaton over every text; items are held by the workers in blocks of at most ``MAX_HELD_CHARS`` characters, so more
    items are more passes. An empty item stands in every text; null texts and items give nothing.
    """
    out, block, held = None, [], 0

    def scan(words: list[str]):
        nonlocal out
        part = records.where(F.col(text).isNotNull()).select(F.col(text)).mapInArrow(_holding(words), "item string, n bigint")
        out = part if out is None else out.unionByName(part)

    for r in items.where(F.col(item).isNotNull()).select(item).distinct().toLocalIterator():
        if block and held + len(r[0]) > MAX_HELD_CHARS:
            scan(block)
            block, held = [], 0
        block.append(r[0])
        held += len(r[0])
    scan(block)
    return out.groupBy("item").agg(F.sum("n").alias("n"))


def _holding(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, counts = ahocorasick.Automaton(), dict.fromkeys(words, 0)
        for w in words:
            if w:
                automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            for cell in b.column(0).to_pylist():
                for w in {w for _, w in automaton.iter(cell)} if len(automaton) else ():
                    counts[w] += 1
            if "" in counts:
                counts[""] += b.num_rows
        found = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["item", "n"])

    return run


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, text: str, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query, corpus id, score, rank): BM25 over the query's distinct terms, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), ties by id.

    Only postings of asked terms are shuffled: the terms of the (counted) query block filter the corpus before anything moves.
    """
    asked = queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    docs = corpus.where(F.col(text).isNotNull()).select(F.col(corpus_id).alias("_id"), terms(F.col(text)).alias("_t"))
    shape = docs.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_t")).alias("_avg"))
    wanted = asked.select("term").distinct()
    postings = docs.select("_id", F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(wanted, "term", "left_semi").groupBy("_id", "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    scored = postings.join(df, "term").crossJoin(F.broadcast(shape)).select("term", "_id", weight.alias("w"))
    score = scored.join(asked, "term").groupBy("_q", "_id").agg(F.sum("w").alias("score"))
    top = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), "_id")
    return score.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_id").alias("hit_id"), "score", "rank")


def multiset_except(rows: DataFrame, skips: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key isn't used up by the skip list; each entry of the list removes one row, the earliest first."""
    w = Window.partitionBy(key).orderBy(order)
    used = skips.groupBy(key).agg(F.count(F.lit(1)).alias("_used"))
    return rows.withColumn("_rn", F.row_number().over(w)).join(used, key, "left").where(F.col("_rn") > F.coalesce("_used", F.lit(0))).drop("_rn", "_used")


def token_overlap(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, common, n_left, n_right): the multiset intersection of two token arrays, counted within the row; rows without tokens drop out."""

    @F.arrow_udf("bigint")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([sum((Counter(x or ()) & Counter(y or ())).values()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    n_left, n_right = (F.coalesce(F.size(c), F.lit(0)) for c in (left, right))
    sized = pairs.select(key, left, right, F.greatest(n_left, F.lit(0)).cast("bigint").alias("n_left"), F.greatest(n_right, F.lit(0)).cast("bigint").alias("n_right"))
    return sized.where("n_left + n_right > 0").select(key, common(F.col(left), F.col(right)).alias("common"), "n_left", "n_right")
