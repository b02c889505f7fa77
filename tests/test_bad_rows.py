import csv
import io
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mergewell.operators.bad_rows import bad_rows, load_lines, rfc4180_cells, row_errors, well_formed

# A row of the table is one record, so a line break outside of quotes ends nothing.
FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'


def test_quoting_against_a_regex_and_the_standard_reader(spark):
    import random

    r = random.Random(5)
    lines = ["".join(r.choice('ab",\n ') for _ in range(r.randint(0, 12))) for _ in range(3000)] + ['"a""b",c', '""', '"",""', 'a"b', '"a"b', '"a\nb",c', "a\nb", "\u0001,\"\u0001,\u0001a\""]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", well_formed(F.col("l")).alias("ok"), rfc4180_cells(F.col("l")).alias("cells")).collect()
    for x in got:
        assert x.ok == bool(re.fullmatch(f"{FIELD}(?:,{FIELD})*", x.l)), repr(x.l)
        if x.ok and x.l and not re.search(r"[\r\n]", re.sub(r'"(?:[^"]|"")*"', "", x.l)):
            assert x.cells == next(csv.reader(io.StringIO(x.l, newline=""))), repr(x.l)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=10), min_size=1, max_size=5))
def test_written_records_come_back(spark, cells):
    line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    r = spark.createDataFrame([(line,)], "l string").select(well_formed(F.col("l")).alias("ok"), rfc4180_cells(F.col("l")).alias("c")).first()
    assert r.ok and r.c == cells


YEARS = {"5": 1, " 5 ": 1, "5+": 1, "5+ Years": 1, "1 - 2 yrs": 1, "1-2": 1, "7.0": 1, "60": 1, "": 1, None: 1, "61": 0, "ten+": 0, "2O": 0, "-2": 0, "1..2": 0, "33½": 0, "5 months": 0, "1 to 2": 0, "~5": 0, "4 yr": 1, "null": 0}
PHONES = {"+1 (415) 555-0192": 1, "0049 535 4133635": 1, "5354133635": 1, "+1 720 555 8288 x544": 1, "+1 720 555 8288 ext44": 1, "": 1, None: 1, "N/A": 0, "123": 0, "+": 0, "+49+5351463511": 0, "5351463511@": 0, "12345678901234567890": 0}


def test_values(spark):
    loaded = spark.createDataFrame([(i, None, y) for i, y in enumerate(YEARS)] + [(100 + i, p, None) for i, p in enumerate(PHONES)], "row_id long, phone string, years_experience string")
    lines = spark.createDataFrame([(1, "a"), (2, None), (3, ",,5,,,,,99"), (4, '"x,,,,,,,'), (5, ",,,,,,,3"), (5, ",,,,,,,3"), (3, ",,5,,,,,99"), (6, "")], "line_id long, line string").withColumn("reason", F.lit("clash"))
    got = {tuple(r) for r in bad_rows(lines, loaded).collect()}
    want = {("recruiter", i, "years_experience") for i, y in enumerate(YEARS) if not YEARS[y]} | {("recruiter", 100 + i, "phone") for i, p in enumerate(PHONES) if not PHONES[p]}
    want |= {("recruiter_lines", 1, "column_count"), ("recruiter_lines", 2, "column_count"), ("recruiter_lines", 3, "phone"), ("recruiter_lines", 3, "years_experience"), ("recruiter_lines", 4, "quoting"), ("recruiter_lines", 6, "column_count")}
    assert got == want
    assert {(r.row_id, tuple(r.reasons)) for r in row_errors(lines, loaded).filter("row_id = 3 and origin = 'recruiter_lines'").collect()} == {(3, ("phone", "years_experience"))}
    assert [r.line_id for r in load_lines(lines).collect()] == [5, 5]
    nameless = spark.createDataFrame([(None, ",,,,,,,99"), (None, ",,,,,,,9"), (None, None)], "line_id long, line string")
    assert [(r.line_id, r.years_experience) for r in load_lines(nameless).collect()] == [(None, "9")]
    broken = spark.createDataFrame([(1, "a,,,,,,x\ny,5"), (2, "a\tb\nc"), (3, "a, b,,,,,,x\ny,,5")], "line_id long, line string")
    assert {(r.row_id, r.reason) for r in bad_rows(broken, loaded.limit(0)).collect()} == {(2, "column_count"), (3, "column_count")}
    assert bad_rows(lines.limit(0), loaded.limit(0)).count() == 0


def test_very_long_line(spark):
    line = '"' + 'x""' * 200_000 + '",,,,,,,1'
    assert bad_rows(spark.createDataFrame([(1, line)], "line_id long, line string"), spark.createDataFrame([], "row_id long, phone string, years_experience string")).count() == 0
