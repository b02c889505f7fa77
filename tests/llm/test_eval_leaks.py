import random

import numpy as np
from pyspark.sql import functions as F

from mergewell.llm import eval_leaks as E


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items, n, edits):
    """(doc, item): fewest edits, over all pairs of windows."""
    out = {}
    for d, text in docs:
        w = E.words_of(text)
        for i, t in items:
            v = E.words_of(t)
            x, y = ([s[a : a + n] for a in range(len(s) - n + 1)] for s in (w, v))
            if d is None or not x or not y:
                continue
            ids = {k: j for j, k in enumerate(sorted({z for s in x + y for z in s}))}
            x, y = (np.array([[ids[z] for z in s] for s in side]) for side in (x, y))
            least = int(E.distances(np.repeat(x, len(y), 0), np.tile(y, (len(x), 1))).min())
            if least <= edits:
                out[d, i] = least
    return out


def found(D, I, **how):
    got = [tuple(x) for x in E.find_leaks(D, I, **how).collect()]
    assert len({x[:2] for x in got}) == len(got)
    return {x[:2]: x[2] for x in got}


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randint(0, 30)) for _ in range(n)]


def planted(r, edits):
    items = [(i, " ".join(words(r, 30))) for i in range(12)]
    docs = []
    for d in range(24):
        w = words(r, 60)
        passage = items[d % 12][1].split()[5:20]
        for _ in range(edits):
            passage[r.randrange(15)] = "changed"
        docs.append((d, " ".join(w[:30] + passage + w[30:])))
    return docs, items


def test_no_edits_equals_brute_force(spark):
    r = random.Random(4)
    docs, items = planted(r, 0)
    docs += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", " -- ")), (103, " ".join(items[0][1].split()[:11])), (1, docs[1][1]), (None, items[3][1])]
    items += [(50, "too short"), (51, None), (0, items[0][1])]
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    I = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 12, 0)
    assert want and {k: v for k, v in found(D, I).items() if v == 0} == want == found(D, I, edits=0)
    assert E.find_leaks(D.limit(0), I).count() == 0 and E.find_leaks(D, I.limit(0)).count() == 0


def test_recall_of_the_defaults(spark):
    r = random.Random(1)
    docs, items = [], []
    for k in range(5):
        one, more = planted(r, 1)
        docs += [(24 * k + d, t) for d, t in one]
        items += [(12 * k + i, t) for i, t in more]
    want = brute(docs, items, 12, 1)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # Precision is 1; the passages with an edit are found as often as promised.
    assert set(got) <= set(want) and all(v >= want[k] for k, v in got.items())
    assert len(want) > 100 and len(got) >= 0.98 * len(want)


def test_recall_with_two_edits(spark):
    docs, items = planted(random.Random(2), 2)
    want = brute(docs, items, 12, 2)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits=2, recall=0.95)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and want


def test_distances():
    r = random.Random(6)
    a, b = (np.array([[r.randint(0, 3) for _ in range(7)] for _ in range(300)]) for _ in range(2))
    assert E.distances(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_filter_holds_all_members(spark):
    r = np.random.default_rng(3)
    members, others = (r.integers(-(2**63), 2**63 - 1, n) for n in (5000, 20_000))
    f = E.BitFilter.of(spark.createDataFrame([(int(x),) for x in members], "h long"), 5000)
    assert f.has(members.view(np.uint64)).all() and f.has(others.view(np.uint64)).mean() < 0.02


def test_long_text(spark):
    items = [(1, " ".join(words(random.Random(1), 20)))]
    doc = "x " * 300_000 + items[0][1]
    assert found(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == {(1, 1): 0}
