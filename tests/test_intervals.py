import random
from datetime import datetime

from pyspark.sql import functions as F

from mergewell.functions.months import is_ongoing, month_index, month_text
from mergewell.operators.intervals import employment_periods, merge_intervals

MONTHS = {
    "March 2020": "2020-03", "mar. 2020": "2020-03", " MAR 2020 ": "2020-03", "Dec '14": "2014-12", "Dec '87": "1987-12", "2019": "2019-01", "October 21, 2020": "2020-10", "2019/06": "2019-06", "2019.06": "2019-06",
    "2018-03": "2018-03", "2020-01-15": "2020-01", "7-2018": "2018-07", "18 Sep 2020": "2020-09", "18/03/2010": "2010-03", "January, 2019": "2019-01", "13/2020": None, "2O19": None, "unknown": None, "??/2019": None, "": None, "-": None,
}


def test_months(spark):
    df = spark.createDataFrame([(k,) for k in MONTHS], "d string")
    assert {r.d: r.m for r in df.select("d", month_text(month_index(F.col("d"))).alias("m")).collect()} == MONTHS


def test_ongoing(spark):
    words = {"Present": True, " to date": True, "till date": True, None: True, "": True, "2020": False, "unknown": False}
    df = spark.createDataFrame([(k,) for k in words], "d string")
    assert {r.d: r.o for r in df.select("d", is_ongoing(F.col("d")).alias("o")).collect()} == words


def brute(rows):
    out = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and b >= a:
            out.setdefault(k, set()).update(range(a, b + 1))
    got = set()
    for k, months in out.items():
        spans, m = [], sorted(months)
        for x in m:
            if spans and spans[-1][1] + 1 == x:
                spans[-1][1] = x
            else:
                spans.append([x, x])
        got |= {(k, "period", a, b) for a, b in spans} | {(k, "gap", p[1] + 1, n[0] - 1) for p, n in zip(spans, spans[1:])}
    return got


def test_random_intervals_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, 4, None]), a := r.choice([None, *range(24000, 24200)]), None if a is None else a + r.randint(-3, 12)) for _ in range(400)]
    rows += rows[:50]  # repeated rows
    df = spark.createDataFrame(rows, "k int, a int, b int").withColumn("_s", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {tuple(x) for x in merge_intervals(df, "k", F.col("a"), F.col("b")).collect()}
    assert got == brute(rows)
    assert merge_intervals(df.limit(0), "k", F.col("a"), F.col("b")).count() == 0


def test_employment(spark):
    records = spark.createDataFrame([(1, datetime(2023, 5, 9)), (2, None), (3, datetime(2020, 1, 1))], "raw_id long, extracted_at timestamp")
    e = [
        (1, "2018-01", "2018-06", False), (1, "2018-07", "Mar 2019", None), (1, "2021", "2021-02", True), (1, "tbc", "2022", False), (1, "2016-05", "tbc", False), (1, "2017-05", "2016-01", False),
        (2, "2019", None, False), (2, "2015-03", "2015-03", False), (3, "2021-01", None, True), (4, "2020", "2021", False),
    ]
    df = spark.createDataFrame(e, "raw_id long, start_date string, end_date string, is_current boolean").withColumn("extracted_at", F.lit("clash"))
    got = {tuple(r) for r in employment_periods(df, records).collect()}
    assert got == {(1, "period", "2018-01", "2019-03"), (1, "gap", "2019-04", "2020-12"), (1, "period", "2021-01", "2023-05"), (2, "period", "2015-03", "2015-03"), (4, "period", "2020-01", "2021-01")}
