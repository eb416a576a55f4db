import math
import random

from siltstone.llm import percentiles as P

SCHEMA = "k string, day int, v double"


def rows(n=3000):
    r = random.Random(1)
    out = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 3), r.choice([r.lognormvariate(3, 2), 7.0, 7.0, -r.random() * 100])) for _ in range(n)]
    return out + [("a", 0, None), ("a", 0, float("nan")), ("z", 1, None), ("b", 2, float("inf")), ("b", 2, 0.0), ("b", 2, -0.0)]


def brute(data, key, bp):
    vals = sorted(v for k, _, v in data if k == key and v is not None and not math.isnan(v))
    return vals[max(1, -(-bp * len(vals) // 10000)) - 1] if vals else None


def test_bound_and_merge(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    by_day = P.state(df, ["day", "k"], "v", bits=8)
    merged = P.merge(by_day, ["k"])
    direct = P.state(df, ["k"], "v", bits=8)
    assert sorted(map(str, merged.collect())) == sorted(map(str, direct.collect()))
    got = {(r["k"], r["basis_points"]): r for r in P.percentiles(merged, ["k"], [1, 5000, 9900, 10000], bits=8, blocks=5).collect()}
    assert {k for k, _ in got} == {"a", "b", None}
    for (k, bp), r in got.items():
        want = brute(data, k, bp)
        assert r["percentile"] == want or abs(r["percentile"] - want) <= 2**-8 * abs(want)
        assert r["max_relative_error"] == 2**-8


def test_exact_and_counts(spark):
    data = rows(500)
    df = spark.createDataFrame(data, SCHEMA)
    state = P.state(df, ["k"], "v", bits=None)
    for r in P.percentiles(state, ["k"], [5000, 9500], bits=None, blocks=3).collect():
        assert r["percentile"] == brute(data, r["k"], r["basis_points"])
    counts = {r["k"]: r for r in P.counts(state, ["k"]).collect()}
    assert (counts["z"]["n_rows"], counts["z"]["n_null"]) == (1, 1) and counts["a"]["n_nan"] == 1


def test_one_hot_group_and_empty(spark):
    df = spark.range(2000).selectExpr("'x' AS k", "0 AS day", "CAST(id AS DOUBLE) AS v")
    got = P.percentiles(P.state(df, ["k"], "v", None), ["k"], [5000], None, blocks=7).collect()
    assert got[0]["percentile"] == 999.0
    empty = spark.createDataFrame([], SCHEMA)
    assert P.percentiles(P.state(empty, ["k"], "v"), ["k"]).count() == 0


def test_redelivery_counts_once(spark):
    df = spark.createDataFrame([(1, 1, "m", 5.0, 2), (1, 1, "m", 5.0, 1), (1, 2, "m", 6.0, 1)], "r int, l int, m string, v double, at int")
    assert P.once(df, ["r", "l"], "at", ["m", "v"]).count() == 2
