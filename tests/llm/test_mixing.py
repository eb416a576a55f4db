import numpy as np

from siltstone.llm import mixing as M

VOCAB = {"a": "river stone bridge water", "b": "loop array return value", "c": "judge court verdict appeal"}


def test_descent_over_blocks(spark):
    rows = [(100, 0, None), (10, 1, None), (30, 0, [0.5, 0.5]), (20, 1, [0.25, 0.75])]
    df = spark.createDataFrame(rows, "n_tokens bigint, domain int, p array<float>").repartition(3)
    goal, cap = np.array([[60.0, 25.0], [500.0, 5.0]]), np.array([[1.0, 1.0], [2.0, 1.0]])
    steps = M.descend(df, goal, cap, M._sums(df, None, 1, 2)[0])
    p = np.array([[1, 0], [0, 1], [0.5, 0.5], [0.25, 0.75]])
    x = steps.rates(p, np.array([0, 1, 0, 1]))
    reached = (x * np.array([[100], [10], [30], [20]])).T @ p
    assert (x >= 0).all() and (x <= cap[:, [0, 1, 0, 1]].T).all()
    assert np.allclose(reached[0], goal[0], rtol=0.01)
    assert x[0, 1] == 2  # used up
    best = brute_force(goal[1], cap[1])
    supply = np.array([120.0, 40.0])
    assert (((reached[1] - goal[1]) ** 2) / supply).sum() <= 1.01 * best + 1e-6


def brute_force(goal, cap):
    """Least miss over a grid of rates of the two soft documents, the certain ones at their best."""
    best = np.inf
    for a in np.linspace(0, cap[0], 81):
        for b in np.linspace(0, cap[1], 41):
            soft = 30 * a * np.array([0.5, 0.5]) + 20 * b * np.array([0.25, 0.75])
            x, y = np.clip((goal[0] - soft[0]) / 100, 0, cap[0]), np.clip((goal[1] - soft[1]) / 10, 0, cap[1])
            miss = soft + np.array([100 * x, 10 * y]) - goal
            best = min(best, (miss**2 / np.array([120.0, 40.0])).sum())
    return best


def test_classifier_held_out():
    r = np.random.RandomState(0)
    texts, labels = [], []
    for i in range(300):
        y = i % 3
        words = list(VOCAB.values())[y].split()
        texts.append(" ".join(r.choice(words, 6)) + " the of and")
        labels.append(y)
    x = np.stack([M.features(t) for t in texts])
    w = M.fit_softmax(x[:200], np.array(labels[:200]), 3)
    got = M.posteriors(w, texts[200:]).argmax(1)
    assert (got == labels[200:]).mean() > 0.95


def docs(spark):
    r = np.random.RandomState(1)
    rows = []
    for i in range(900):
        s = "abc"[i % 3]
        text = " ".join(r.choice(VOCAB[s].split(), 5 + i % 40))
        name = None if i % 50 == 0 else (s.upper() + " " if i % 7 == 0 else s)
        rows.append((i, text, name, "clash"))
    rows += [(1000, None, "a", "x"), (1001, "", "b", "x"), (1002, "   ", None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string").repartition(4)


TARGET = "mix_name string, source string, target_share double, max_repeats int, budget_ratio double"


def test_shares(spark):
    targets = spark.createDataFrame([("m", "A", 2.0, 1, 0.5), ("m", "b", 1.0, 1, 0.5), ("m", "c", 1.0, 3, 0.5), ("short", "a", 0.9, 2, 3.0), ("short", "none", 0.1, 1, 3.0), ("zero", "a", 0.0, 1, 0.5)], TARGET)
    draw, report = M.mix(docs(spark), targets)
    rows = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert abs(rows["m", "a"]["reached_share"] - 0.5) < 0.03
    assert abs(rows["m", "b"]["reached_share"] - 0.25) < 0.03
    assert rows["short", "none"]["reached_share"] == 0 and rows["short", "a"]["most_copies"] <= 2
    copies = draw.groupBy("mix_name").agg({"copies": "max"}).collect()
    assert {r["mix_name"] for r in copies} == {"m", "short"}
    assert draw.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


def test_held_out_accuracy(spark):
    assert M.held_out_accuracy(docs(spark)) > 0.95


def test_gaps_are_filled_until_near(spark):
    rows = [(0, 0, 1, 900, 0, 0.5, 0.1)] + [(0, 0, 10 + i, 40, 0, 0.5, 0.2 + i) for i in range(30)]
    df = spark.createDataFrame(rows, M.RATED)
    got = M._whole_copies(df).agg({"n_tokens": "sum"}).first()[0]
    assert abs(got - 0.5 * (900 + 1200)) <= 40


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.5)], TARGET)
    draw, report = M.mix(docs(spark).limit(0), targets)
    assert draw.count() == 0 and report.collect()[0]["reached_tokens"] == 0
    draw, _ = M.mix(docs(spark), targets.limit(0))
    assert draw.count() == 0
