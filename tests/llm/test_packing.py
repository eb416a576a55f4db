import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import binpack as B
from siltstone.llm.packing import fill_report, pack_documents
from siltstone.llm.tokens import VOCABULARY, counter


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=14))))
def test_complete_is_a_packing_between_the_bounds(case):
    capacity, sizes = case
    got = B.complete(sizes, capacity) if sizes else []
    assert sorted(x for b in got for x in b) == sorted(sizes)
    assert all(sum(b) <= capacity for b in got)
    if sizes:
        assert B.lower_bound(sizes, capacity) <= len(got) <= len(B.best_fit_decreasing(sizes, capacity))


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.randint(8, 30)
        sizes = [r.randint(1, capacity) for _ in range(8)]
        assert len(B.complete(sizes, capacity, nodes=5000)) <= optimum(sorted(sizes, reverse=True), capacity) + 0


@settings(max_examples=80, deadline=None)
@given(st.integers(6, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=10))))
def test_without_a_limit_the_result_is_the_best(case):
    capacity, sizes = case
    assert len(B.complete(sizes, capacity, nodes=None)) == optimum(sorted(sizes, reverse=True), capacity)


def test_fillings_are_the_undominated_ones():
    from itertools import combinations

    sizes = [19, 11, 9, 8, 8, 6, 5, 3, 2]
    search = B._Search(sizes, 30)
    got = [f for f in search.fillings(19, 30) if f is not None]
    gap, rest = 11, sizes[1:]
    every = {tuple(sorted(c, reverse=True)) for k in range(len(rest) + 1) for c in combinations(rest, k) if sum(c) <= gap}

    def dominated(f):
        left, unused = gap - sum(f), list(rest)
        for x in f:
            unused.remove(x)
        return any(s < x <= s + left for s in (0, *f) for x in unused)

    assert sorted(got) == sorted(f for f in every if not dominated(f))
    assert all(sum(f) >= gap - 1 for f in search.fillings(19, 1) if f is not None)


def test_a_filling_of_four_is_found():
    sizes = [60, 55, 17, 13, 7, 3, 19, 15, 8, 3]  # 60 + (17 + 13 + 7 + 3) and 55 + (19 + 15 + 8 + 3)
    assert len(B.complete(sizes, 100, nodes=None)) == 2


def test_documents(spark):
    count = counter(VOCABULARY)
    texts = [None, "", "word " * 3, "many words here " * 40, "x", "y z"] + [f"text number {i} " * (i % 17) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string").repartition(5)
    specs = spark.createDataFrame([("a", 32), ("b", 100)], "spec_name string, capacity_tokens int")
    rows = pack_documents(docs, specs, block=64).collect()
    for spec, capacity in (("a", 32), ("b", 100)):
        held, used, starts = {}, {}, {}
        for r in rows:
            if r["spec_name"] == spec:
                held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["n_tokens"]
                used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
                starts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert held == {i: count(t) for i, t in enumerate(texts)}
        assert all(n <= capacity for c, n in used.items() if c)
        for d, parts in starts.items():
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
            assert len(parts) == 1 or held[d] > capacity
    report = {r["spec_name"]: r for r in fill_report(pack_documents(docs, specs, block=64), specs).collect()}
    assert report["b"]["fill"] > 0.95


def test_empty_and_ties(spark):
    specs = spark.createDataFrame([("a", 32)], "spec_name string, capacity_tokens int")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack_documents(empty, specs).count() == 0
    same = spark.createDataFrame([(1, "same words")] * 9, "doc_id bigint, text string")
    assert pack_documents(same, specs).count() == 9
    assert pack_documents(same, specs.limit(0)).count() == 0
