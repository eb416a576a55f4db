import random

from siltstone.llm import leakage as L

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "sha") for b in ("ren", "dol", "vak", "mund", "sol", "ket", "phon", "bel")]


def edit(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_myers_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(80):
        a = [r.choice("abcde") for _ in range(r.randint(3, 20))]
        b = [r.choice("abcde") for _ in range(r.randint(0, 25))]
        rows = list(range(1, len(a) + 1))
        assert L.myers(a, b, rows) == {k: edit(a[:k], b) for k in rows}


def brute(item, text, exact=12, stretch=28, per_edit=6):
    grams = {tuple(text[i : i + exact]) for i in range(len(text) - exact + 1)}
    if any(tuple(item[i : i + exact]) in grams for i in range(len(item) - exact + 1)):
        return True
    return any(edit(item[i:j], text) * per_edit <= j - i for i in range(len(item)) for j in range(i + stretch, len(item) + 1))


def test_matcher_equals_brute_force():
    r = random.Random(3)
    item = [r.choice(WORDS) for _ in range(44)]
    m = L.Matcher([(1, item)], " ", 12, 28, 6)
    hits = 0
    for _ in range(150):
        at = r.randint(0, 20)
        part = list(item[at : at + r.randint(8, 44)])
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(part)) if part else 0
            kind = r.random()
            if kind < 0.4 and part:
                part[k] = "other"
            elif kind < 0.7 and part:
                del part[k]
            else:
                part.insert(k, "extra")
        text = [r.choice(WORDS) for _ in range(9)] + part + [r.choice(WORDS) for _ in range(9)]
        want = brute(item, text)
        hits += want
        assert (m.found(text) == [1]) == want
    assert 20 < hits < 140


def test_records(spark):
    r = random.Random(4)
    own = [" ".join(r.choice(WORDS) for _ in range(40)) for _ in range(4)]
    rule = "Answer briefly and box the final result of your careful work in the last line please now"
    items = spark.createDataFrame([(i, "s", f"{rule}\n{t}", "en") for i, t in enumerate(own)] + [(9, "s", None, "en"), (10, None, "", "en")], "item_id bigint, dataset_path string, item_prompt string, lang string")
    w = own[1].split()
    marked = " ".join(f"<b>{x.upper()}</b>," if i % 3 else x[:2] + "­" + x[2:] for i, x in enumerate(w[5:18]))
    records = [("d", 1, "intro " + marked), ("d", 2, rule), ("d", 3, " ".join(w[:11])), ("d", 4, None), ("d", 5, ""), ("s", 6, '[{"role": "user", "content": "' + "\\n".join(own[2].split()[:14]) + '"}]'), ("s", 6, '[{"role": "user", "content": "' + "\\n".join(own[2].split()[:14]) + '"}]'), ("d", 7, "pad " * 50000 + own[3])]
    df = spark.createDataFrame(records, "origin string, row_key bigint, text string")
    got = sorted(tuple(x) for x in L.leaks(df, items).collect())
    assert got == [("d", 1, 1), ("d", 7, 3), ("s", 6, 2)]
    assert sorted(tuple(x) for x in L.leaks(df, items, block_items=1).collect()) == got
    assert L.leaks(df.limit(0), items).count() == 0 and L.leaks(df, items.limit(0)).count() == 0


def test_pieces_follow_the_error_budget():
    from siltstone.llm.leakage import Matcher, piece_length

    assert piece_length(28, 6, 12) == 5 and piece_length(28, 3, 12) == 2
    for stretch, per_edit in ((28, 6), (28, 3), (20, 4), (7, 7), (10, 2)):
        assert piece_length(stretch, per_edit, 99) == min(n // (n // per_edit + 1) for n in range(stretch, 2000))
    item = [f"w{i}" for i in range(28)]
    broken = [f"x{i}" if i % 3 == 2 and i < 27 else w for i, w in enumerate(item)]  # nine edits where nine are allowed
    assert Matcher([(1, item)], " ", 12, 28, 3).found(broken) == [1]
    assert Matcher([(1, item)], " ", 12, 28, 6).found(broken) == []
