import pytest
from pyspark.sql import functions as F

from mergewell import fixed
from mergewell.functions import fuzzy, normal as N


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


CASES = [
    (N.normalize_email, {"Ilse.Korvandahl@Mailbay.COM": ("ilse.korvandahl@mailbay.com", True, 1.0), "already@lower.com": ("already@lower.com", True, 1.0), "bad@@double.com": ("bad@@double.com", False, 0.3), "a@b": ("a@b", False, 0.5), "": (None, False, 0.0), None: (None, False, 0.0)}),
    (N.normalize_name, {"ILSE KORVANDAHL": ("Ilse Korvandahl", True, 0.9), "john o'brien": ("John O'Brien", True, 0.9), "Ilse Korvandahl": ("Ilse Korvandahl", True, 1.0), "ludwig van beethoven": ("Ludwig van Beethoven", True, 0.9), "jean de la": ("Jean de La", True, 0.9), "Mack mcdonald": ("MacK McDonald", True, 0.9), "anna - marie": ("Anna - Marie", True, 0.9), "  ": (None, False, 0.0)}),
    (N.normalize_url, {"linkedin.com/in/p": ("https://linkedin.com/in/p", True, 0.9), "https://github.com/j/": ("https://github.com/j", True, 1.0), "HTTP://LinkedIn.com/A/?q=1#f": ("http://linkedin.com/A?q=1", True, 1.0), "https://": ("https://", False, 0.3)}),
    (N.normalize_date, {"March 2021": ("2021-03", True, 1.0), "2021-06-15": ("2021-06", True, 1.0), "06/2021": ("2021-06", True, 1.0), "2019": ("2019-01", True, 0.7), "2020 March": ("2020-03", True, 1.0), "2020 Mar 15": ("2020-03", True, 1.0), "20200315": ("2020-03", True, 1.0), "20201315": ("20201315", False, 0.3), "March 15 2020 10:00": ("2020-03", True, 1.0), "15/03/2020 10:00:59 PM": ("2020-03", True, 1.0), "2020-03-15T10:00:00Z": ("2020-03", True, 1.0), "Present": (None, True, 1.0), "Now": (None, True, 1.0), "not-a-date-xyz": ("not-a-date-xyz", False, 0.3)}),
    (N.normalize_phone, {"+91-90123-45678": ("+919012345678", True, 1.0), "+1 (415) 555-0192": ("+14155550192", True, 1.0), "+44 20 7946 0958": ("+442079460958", True, 1.0), "09012345679": ("+919012345679", True, 0.85), "not-a-phone": ("not-a-phone", False, 0.3), "": (None, False, 0.0)}),
    (N.normalize_skill, {"python": ("Python", True, 1.0), "reactjs": ("React", True, 1.0), "pyspark": ("Apache Spark", True, 1.0), "scikit learn": ("Scikit-learn", True, 1.0), "mysql": ("MySQL", True, 1.0), "SomeObscureTool2024XYZ": ("Someobscuretool2024Xyz", False, 0.6)}),
]


@pytest.mark.parametrize("f,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, f, cases):
    for (text, want), r in zip(cases.items(), run(spark, f, list(cases))):
        assert (r.value, r.success, float(r.factor)) == want, text


def test_country(spark):
    table = N.country_table(spark)
    cases = {"IN": "IN", "India": "IN", "IND": "IN", "Bangalore, India": "IN", "USA": "US", "United States": "US", "San Francisco, USA": "US", "viet nam": "VN", "Atlantis": None, "": None}
    assert [r.value for r in run(spark, lambda c: N.normalize_country(c, table), list(cases))] == list(cases.values())


def test_country_parts_are_tried_from_the_left(spark):
    r = run(spark, lambda c: N.normalize_country(c, N.country_table(spark)), ["Bangalore, India"])[0]
    assert (r.method, float(r.factor)) == ("city_to_country_inference", 0.75)


def test_platforms(spark):
    assert run(spark, N.infer_platform, ["https://netflix.com", "https://GitHub.com/x", "http://a.b"]) == ["twitter", "github", "other"]


def test_ids(spark):
    a, b, c, d = run(spark, N.candidate_id, ["ilse.korvandahl@mailbay.com", " ILSE.korvandahl@Mailbay.com", None, ""])
    assert a == b == "d40bd9c9-4360-503e-b104-071bcce5c6a5" and len({a, c, d}) == 3


def test_distinct_emails(spark):
    df = spark.createDataFrame([(["a@b.com", "A@B.COM", "c@d.com", "a@b.com"],)], "v array<string>")
    assert df.select(N.distinct_emails(F.col("v")).alias("r")).first().r == ["a@b.com", "c@d.com"]


def test_fuzzy_pruning_changes_nothing():
    choices = tuple(fixed.SKILLS)
    nearest = fuzzy.nearest_in(choices, 82.0)
    for text in ("pythn", "kuberntes", "data enginering", "docker2", "tensor flow", "xyzzy", "react native", "machine lerning", "s"):
        best = max((fuzzy.weighted_ratio(text, c), -k) for k, c in enumerate(choices))
        assert nearest(text) == ((choices[-best[1]], best[0]) if best[0] >= 82 else None)


def test_tables():
    assert (len(fixed.SKILLS), len(fixed.HEADERS), len(fixed.COUNTRY_ALIASES), len(fixed.CITIES)) == (156, 64, 21, 43)
