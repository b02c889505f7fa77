import random

from pyspark.sql import functions as F

from mergewell.llm import truncation as T

NOUNS = "harbour garden library market kitchen tunnel orchard bridge school archive".split()
VERBS = "supports surrounds replaces rivals slows covers attracts welcomes".split()
ENDS = ["near the old station", "despite rising costs", "for the third year", "across the valley"]


def sentence(r):
    return f"The {r.choice('quiet early wooden public late'.split())} {r.choice(NOUNS)} {r.choice(VERBS)} every {r.choice(NOUNS)} {r.choice(ENDS)}."


def page(r):
    return f"Home | News | Help\n\n{r.choice('Quiet Early Wooden'.split())} {r.choice(NOUNS)}\n\n" + "\n\n".join(" ".join(sentence(r) for _ in range(r.randint(2, 4))) for _ in range(3))


def corpus():
    r = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        t, k = page(r), i % 10
        if k == 0:  # cut somewhere within the last sentences
            at = len(t) - r.randint(3, 60)
            while t[at - 1] in ". \n":
                at -= 1
            t = t[:at] + r.choice(["", "", "…", "...", " [...]", " (more)"])
            cut.add(i)
        elif k < 4:
            t += r.choice(["\n\nHome | News | Help", "\n\n© 2020 Example Press", "\n\nRead more »"])
        rows.append((i, t, "en", f"s{i % 3}"))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    rows += [(9001, None, "en", "s0"), (9002, "", None, None), (9003, " \n ", "en", "s0"), (9004, "Not found.", "EN-us", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    got = {r.doc_id for r in T.truncated(df).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.02 * len(got)
    # A copy of a cut text counts too.
    again = df.unionByName(df.filter(F.col("doc_id") == 10).withColumn("doc_id", F.lit(7777).cast("long")))
    assert {10, 7777} <= {r.doc_id for r in T.truncated(again).collect()} or 10 not in got
    # However many copies it has: they don't speak for each other.
    many = df.unionByName(df.filter("doc_id = 20").crossJoin(spark.range(300)).select((F.col("id") + 20_000).alias("doc_id"), "text", "lang", "source", "score"))
    assert 20 not in got or {20, 20_000, 20_299} <= {r.doc_id for r in T.truncated(many).collect()}
    rates = {r.source: r for r in T.truncation_rates(df).collect()}
    assert set(rates) == {"s0", "s1", "s2", None} and rates[None].texts == 0 and rates[None].share is None
    assert sum(r.truncated for r in rates.values()) == len(got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert T.truncated(df).count() == 0 and T.truncation_rates(df).count() == 0


def test_marks():
    assert T.split_mark("The valley is…") == ("The valley is", True)
    assert T.split_mark("Done.\n\nRead more »")[1] is False
    assert T.split_mark("ï»¿ \n") == ("", False)
    assert T.split_mark("abc [...] ")[0] == "abc" and T.split_mark("  ") == ("", False)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word and " * 200_000, "en", "s")], "doc_id long, text string, lang string, source string")
    assert T.truncated(df).count() in (0, 1)


def test_every_language_has_its_valley_at_any_size():
    def bins(at, n):
        return {b: 0 if abs(b - at) < 2 else n for b in range(-40, -20)}

    found = T.valleys({"en": bins(-28, 100), "ja": bins(-34, 100), "few": {-50: 1}})
    assert found["en"] > T.DEFAULT_THRESHOLD > found["ja"]
    assert T.valleys({"xx": {-50: 1}}) == {"xx": T.DEFAULT_THRESHOLD}
