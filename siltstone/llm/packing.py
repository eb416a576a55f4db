"""Filling fixed-capacity containers with documents by bin completion, over any number of documents.

Round one packs where the rows lie, without a shuffle: each partition streams its documents into blocks of ``block`` items and packs each
block for every capacity. The emptiest containers of a block are opened again and their items join the next block, so a partition ends
with at most ``block // 16`` loose items per capacity. The loose items of all partitions are packed in further, ever smaller rounds until
one partition closes the last container. Each round is a written table. Memory per task is one block, whatever the number of rows or the
share of one source; no group is ever collected.

A document larger than the capacity is cut into full containers and one rest, which is packed like any other item; no other document is
split. Defined cases: null, empty and zero-token texts need no space and come out with ``container_id`` null and ``n_tokens`` 0; repeated
rows and ties are items of their own; an empty document table or an empty spec table gives no rows; capacities must be positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.binpack import NODES, pack
from siltstone.llm.tokens import VOCABULARY, counter
from siltstone.session import materialize

SCHEMA = "spec_name string, container_id string, doc_id bigint, start_token int, n_tokens int, open boolean"
MAX_SPECS = 1000


class _Packer:
    """Blocks of one capacity within one partition."""

    def __init__(self, spec: str, capacity: int, label: str, block: int, nodes: int | None, last: bool):
        self.spec, self.capacity, self.label, self.block, self.nodes, self.last = spec, capacity, label, block, nodes, last
        self.items: list[tuple[int, int, int]] = []  # tokens, document, start
        self.made = 0
        self.rows: tuple[list, list, list, list, list] = ([], [], [], [], [])

    def _emit(self, items: list[tuple[int, int, int]], is_open: bool) -> None:
        name = f"{self.label}-{self.made}"
        self.made += 1
        for n, doc, start in items:
            for to, v in zip(self.rows, (name, doc, start, n, is_open)):
                to.append(v)

    def add(self, doc: int, n: int, start: int = 0) -> None:
        while n >= self.capacity:
            self._emit([(self.capacity, doc, start)], False)
            start, n = start + self.capacity, n - self.capacity
        if n:
            self.items.append((n, doc, start))
            if len(self.items) >= self.block:
                self.close(False)

    def close(self, end: bool) -> None:
        items, self.items = self.items, []
        bins = [[items[i] for i in b] for b in pack([i[0] for i in items], self.capacity, self.nodes)]
        bins.sort(key=lambda b: sum(i[0] for i in b))
        loose = 0
        for b in bins:
            if not (end and self.last) and sum(i[0] for i in b) < self.capacity and loose + len(b) <= self.block // 16:
                loose += len(b)
                if end:
                    self._emit(b, True)
                else:
                    self.items.extend(b)
            else:
                self._emit(b, False)

    def batch(self) -> pa.RecordBatch:
        names, docs, starts, sizes, opens = self.rows
        self.rows = ([], [], [], [], [])
        cols = [pa.array([self.spec] * len(docs), pa.string()), pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(opens, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=["spec_name", "container_id", "doc_id", "start_token", "n_tokens", "open"])


def pack_documents(
    documents: DataFrame,
    specs: DataFrame,
    doc_id: str = "doc_id",
    text: str | Column = "text",
    vocabulary: str = VOCABULARY,
    block: int = 4096,
    nodes: int | None = NODES,
) -> DataFrame:
    """(spec_name, container_id, doc_id, start_token, n_tokens): where every document goes, for each row of ``specs``."""
    wanted = [(r[0], int(r[1])) for r in specs.select("spec_name", "capacity_tokens").distinct().limit(MAX_SPECS + 1).collect()]
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    wanted = sorted((w for w in wanted), key=str)
    if any(c <= 0 for _, c in wanted):
        raise ValueError("capacities must be positive")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = counter(vocabulary), TaskContext.get().partitionId()
        packers = [_Packer(s, c, f"{i}-0-{part}", block, nodes, False) for i, (s, c) in enumerate(wanted)]
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1)):
                n = count(content.as_py())
                for p in packers:
                    if n:
                        p.add(doc, n)
                    else:
                        for to, v in zip(p.rows, (None, doc, 0, 0, False)):
                            to.append(v)
            yield from (p.batch() for p in packers)
        for p in packers:
            p.close(True)
            yield p.batch()

    def again(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            packers = {s: _Packer(s, c, f"{i}-{number}-{part}", block, nodes, last) for i, (s, c) in enumerate(wanted)}
            for b in batches:
                for spec, doc, start, n in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    packers[spec].add(doc, n, start)
                yield from (p.batch() for p in packers.values())
            for p in packers.values():
                p.close(True)
                yield p.batch()

        return run

    content = F.col(text) if isinstance(text, str) else text
    rounds = [materialize(documents.select(F.col(doc_id).cast("bigint"), content).mapInArrow(first, SCHEMA), "pack")]
    number = 0
    while n_open := rounds[-1].where("open").count():
        number += 1
        parts = -(-n_open // (block * 16))
        loose = rounds[-1].where("open").select("spec_name", "doc_id", "start_token", "n_tokens")
        spread = loose.repartition(parts, F.xxhash64("doc_id", "spec_name", "start_token", "n_tokens")) if parts > 1 else loose.coalesce(1)
        rounds.append(materialize(spread.mapInArrow(again(number, parts == 1), SCHEMA), "pack"))
    out = rounds[0].where("NOT open")
    for r in rounds[1:]:
        out = out.unionByName(r.where("NOT open"))
    return out.drop("open")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the share of space used and the fewest containers that could do."""
    held = packed.where("container_id IS NOT NULL").groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    used = held.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("n").alias("n_pieces"), F.max("t").alias("fullest"))
    return specs.join(used, "spec_name").select(
        "spec_name",
        "capacity_tokens",
        "n_containers",
        "n_pieces",
        "n_tokens",
        "fullest",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )
