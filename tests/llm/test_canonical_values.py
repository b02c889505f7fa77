import random

import pytest
from pyspark.sql import functions as F

from mergewell.llm.canonical_values import canonical_values, match_places, match_skills, pigeonhole_pairs

SKILLS = [(501, "Quillbase", ["QUIQ"]), (510, "Corvane.js", []), (527, "Wexel#", ["WEXX"]), (528, "Brisk++", []), (531, "Quern/2", []), (533, "Sift & Sort", []), (540, "Copperline VPN", []), (563, "Payroll Reporting", []), (574, "Contract Auditing", ["CAQ3"]), (578, "Fraud Modeling", []), (580, "Fraud Migration", []), (606, "Speech Forecasting", [])]
PLACES = [(1, "Sarayipur", "Ostara", "IN", "India", []), (2, "Grünau", "Westrau", "DE", "Germany", []), (3, "Murkbury", "Loweth", "GB", "United Kingdom", []), (4, "Murkbury", "Valmont", "FR", "France", []), (5, "Great Wapta", "Lakeland", "CA", "Canada", ["Zorkahaven"]), (6, "Peñalejón", "Serranía", "ES", "Spain", []), (7, "Whistle Junction", "Tallowa", "US", "United States", [])]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(SKILLS, "skill_id long, name string, aliases array<string>"), spark.createDataFrame(PLACES, "location_id long, city string, state string, country_code string, country string, aliases array<string>")


def test_skills(spark, refs):
    cases = {
        "quillbase": 501, "Quilbase": 501, "QUIQ": 501, "Corvane": 510, "corvane js": 510, "Lumet.js": -1, "Wexel Sharp": 527, "Birsk++": 528, "quern/2 - expert": 531, "Sift and Sort": 533, "Copperline": 540, "PayrollReporting": 563,
        "Reporting (Payroll)": 563, "Reporting, Payroll": 563, "reporting of payroll": 563, "Payr. Reporting": 563, "Contract Audi.": 574, "caq3": 574, "7 yrs Contract Auditing (advanced)": 574, "Fradu Migrtaion": 580, "Fraud Reporting": -1,
        "Payroll Modeling": -1, "working knowledge of Speech Forecasting v3": 606, "Chess": -1, 'Fraud Modelling "live"': 578,
    }
    got = {r.value: r.ref_id for r in match_skills(spark, spark.createDataFrame([(c,) for c in cases], "value string"), refs[0]).collect()}
    assert got == cases


def test_places(spark, refs):
    cases = {
        "Sarayipur": 1, "sarayipur, India": 1, "India - Saraypiur": 1, "Gruenau, Germany": 2, "Grunau DE": 2, "near Grünau 12345, DE": 2, "Murkbury": 3, "Murkbury, FR": 4, "murkbury, Great Britain": 3, "Gt Wapta, CA": 5, "ZORKAHAVEN CA": 5,
        "Greater Great Wapta Area, Canada": 5, "penalejon": 6, "Serranía, Peñalejón (ES)": 6, "Whistle Jct, US": 7, "WhistleJunction": 7, "India": -1, "Remote": -1, "Lakeland": -1, "Xochimalpa, Mexico": -1, "Murkbury, Norway": -1,
    }
    got = {r.value: r.ref_id for r in match_places(spark, spark.createDataFrame([(c,) for c in cases], "value string"), refs[1]).collect()}
    assert got == cases


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_pigeonhole_join_misses_nothing(spark):
    r = random.Random(6)
    keys = sorted({"".join(r.choice("abcd") for _ in range(r.randint(4, 14))) for _ in range(60)})

    def mutate(s):
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(s) + 1)
            s = r.choice([s[:k] + r.choice("abcd") + s[k:], s[:k] + s[k + 1 :], s[:k] + r.choice("abcd") + s[k + 1 :]])
        return s

    long = "".join(r.choice("abcd") for _ in range(90))
    keys += [long, "abcde"]
    forms = sorted({mutate(r.choice(keys)) for _ in range(200)} | {long[:40] + "x" + long[41:], "abc", "x" * 100_000})
    got = {(x.form, x.key): x.distance for x in pigeonhole_pairs(spark, spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame([(k, True) for k in keys], "key string, fuzzy boolean")).collect()}
    k = lambda s: 0 if len(s) < 5 else 2 if len(s) < 10 else 4
    want = {(f, s): distance(f, s) for f in forms for s in keys if abs(len(f) - len(s)) <= k(s) and len(f) >= 3 and k(s) and distance(f, s) <= k(s)}
    assert got == want and {f for f, _ in got} >= {"abc", long[:40] + "x" + long[41:]}


def test_table(spark, refs):
    c = spark.createDataFrame([(1, ["Quillbase", "", None, "Chess", "Quillbase"]), (2, []), (3, None), (1, ["Quillbase"]), (4, ["x" * 100_000])], "raw_id long, skills array<string>").withColumn("value", F.lit("clash"))
    q = spark.createDataFrame([(1, "Sarayipur"), (2, None), (3, " "), (3, "Nowhere at all")], "row_id long, location string").withColumn("ref_id", F.lit(5))
    got = sorted(tuple(r) for r in canonical_values(c, q, *refs).collect())
    assert got == sorted([("skills", 1, 0, 501), ("skills", 1, 3, -1), ("skills", 1, 4, 501), ("skills", 1, 0, 501), ("skills", 4, 0, -1), ("location", 1, 0, 1), ("location", 3, 0, -1)])
    assert canonical_values(c.limit(0), q.limit(0), *refs).count() == 0
    assert {r.ref_id for r in canonical_values(c, q, *(x.limit(0) for x in refs)).collect()} == {-1}
