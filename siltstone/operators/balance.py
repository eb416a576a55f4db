"""Balanced partitions of sequence lengths. The lists are one batch (bounded by its size), the batches are what is distributed."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing method into k parts; with ``equal`` all parts get the same number of items (n divisible by k)."""
    n = len(lengths)
    if equal and n % k:
        raise ValueError(f"{n} items don't divide into {k} parts")
    heap: list = []
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    units = [order[i : i + k] for i in range(0, n, k)] if equal else [[i] for i in order]
    for tick, unit in enumerate(units):
        parts = [(lengths[i], [i]) for i in unit] + [(0, [])] * (k - len(unit))
        parts.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), tick, parts))
    tick = len(units)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), tick, merged))
        tick += 1
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def least_loaded(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item in turn to the part with the least load; ``equal`` adds a bias that keeps the counts level."""
    bias = sum(lengths) + 1 if equal else 0
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + n + bias, p))
    if equal and len({len(p) for p in parts}) > 1:
        raise ValueError("the items don't divide equally")
    return parts


def first_fit_count(lengths: list[int], cap: int) -> int:
    """Bins that first fit needs under a token cap; a longer item has a bin of its own."""
    bins: list[int] = []
    for n in lengths:
        for i, load in enumerate(bins):
            if load + n <= cap:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


def bounded_chunks(sizes: list[int], cap: int) -> list[int]:
    """The chunk of each item of a stream: a chunk closes before it would exceed ``cap``."""
    out, chunk, load = [], 0, 0
    for i, n in enumerate(sizes):
        if i and load + n > cap and load:
            chunk, load = chunk + 1, 0
        load += n
        out.append(chunk)
    return out


def assign(rows: DataFrame, batch: str, item: str, length: str, k: int, method: str = "differencing", equal: bool = False) -> DataFrame:
    """(batch, item, length, rank): every batch's items spread over k ranks."""
    split = {"differencing": differencing, "least_loaded": least_loaded}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        rank = [0] * len(pdf)
        for p, members in enumerate(split(pdf[length].tolist(), k, equal)):
            for i in members:
                rank[i] = p
        return pdf.assign(rank=rank)[[batch, item, length, "rank"]]

    return rows.select(batch, item, length).groupBy(batch).applyInPandas(run, f"{batch} bigint, {item} bigint, {length} bigint, rank int")


def bin_counts(rows: DataFrame, batch: str, item: str, length: str, cap: int) -> DataFrame:
    """(batch, n_bins) by first fit in item order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n_bins": [first_fit_count(pdf[length].tolist(), cap)]})

    return rows.select(batch, item, length).groupBy(batch).applyInPandas(run, f"{batch} bigint, n_bins int")


def micro_batch_schedule(rows: DataFrame, step: str, rank: str, item: str, length: str, cap: int) -> DataFrame:
    """(step, rank, item, length, micro_batch): as many micro-batches per step as the fullest rank needs, balanced within each rank."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        return pdf.assign(n_bins=first_fit_count(pdf[length].tolist(), cap))[[step, rank, item, length, "n_bins"]]

    cols = f"{step} bigint, {rank} bigint, {item} bigint, {length} bigint"
    counted = rows.select(step, rank, item, length).groupBy(step, rank).applyInPandas(count, cols + ", n_bins int")
    wide = counted.withColumn("n_bins", F.max("n_bins").over(Window.partitionBy(step)))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        at = [0] * len(pdf)
        for b, members in enumerate(differencing(pdf[length].tolist(), int(pdf["n_bins"].iloc[0]))):
            for i in members:
                at[i] = b
        return pdf.assign(micro_batch=at)[[step, rank, item, length, "micro_batch"]]

    return wide.groupBy(step, rank).applyInPandas(spread, cols + ", micro_batch int")
