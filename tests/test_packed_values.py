import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mergewell.operators.packed_values import parse_cell, split_packed

CASES = {
    "a; b ;c": ["a", "b", "c"], "[a, b (c, d), \"e, f\"]": ["a", "b (c, d)", "e, f"], "1. a b 2. c 3. d": ["a b", "c", "d"], "1) x 2) y": ["x", "y"],
    "'A, B', C; \"x \"\"live\"\"\"": ["A, B", "C", 'x "live"'], '["P \\"pro\\" edition", "b"]': ['P "pro" edition', "b"], "a, b and c": ["a", "b", "c"], "; x ;": ["x"],
    "a, ,b, ,c": ["a", "b", "c"], "- a\n- b-c\n- d/e": ["a", "b-c", "d/e"], "• a\n• b": ["a", "b"], "Arbor/IO / Quern/2": ["Arbor/IO", "Quern/2"], "x (v2; v3), y": ["x (v2; v3)", "y"],
    "A  B，C、D": ["A  B", "C", "D"], "a\tb": ["a", "b"], "a · b • c": ["a", "b", "c"], "“a, b”;c": ["a, b", "c"], '""': [], ";": [], " ": [], "": [], "a,a": ["a", "a"], "Andes": ["Andes"], "C++, R&D and Go": ["C++", "R&D", "Go"],
}


@pytest.mark.parametrize("cell", CASES)
def test_grammar(cell):
    assert [v for v, _ in parse_cell(cell)] == CASES[cell]


def test_malformed_quotes_and_groups_backtrack_with_a_flag():
    assert parse_cell('a, "b; c') == [("a", None), ('"b', "open_quote"), ("c", None)]
    assert parse_cell("a (b, c") == [("a (b", "open_group"), ("c", None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii", categories=("Ll", "Lu", "Nd")), min_size=1, max_size=8), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", "\n", "\t", " / "]))
def test_round_trip(values, separator):
    assert [v for v, _ in parse_cell(separator.join(f'"{v}"' for v in values))] == values


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_parses_into_clean_values(text):
    for value, _ in parse_cell(text):
        assert value and value == value.strip(" \t\n\r")


def test_table(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (1, "a;b", "y"), (2, None, "z"), (3, "", None), (None, "q", None), (4, "w," * 50_000, None)], "row_id long, skills string, value string").withColumn("pos", F.lit("clash"))
    got = split_packed(df, "row_id", "skills")
    assert got.columns == ["id", "pos", "value", "error"]
    rows = sorted(((r.id, r.pos, r.value) for r in got.filter("id is null or id < 4").collect()), key=str)
    assert rows == sorted([(1, 0, "a"), (1, 1, "b"), (1, 0, "a"), (1, 1, "b"), (None, 0, "q")], key=str)
    assert got.filter("id = 4").count() == 50_000
    assert split_packed(df.limit(0), "row_id", "skills").count() == 0


@pytest.mark.parametrize("piece", ["(,", "'a,", "“a,", '"a,', "'a\\',", "“a,”b,", ' and (', '"a""b,', "'", "   "])
def test_time_grows_with_the_length(piece):
    import time

    began = time.process_time()
    parse_cell(piece * (500_000 // len(piece)))
    parse_cell("x, " + piece * (500_000 // len(piece)) + "'z'”q")
    assert time.process_time() - began < 10


def test_what_is_known_of_a_cell_changes_no_value():
    assert [v for v, _ in parse_cell("'a,'b',c'")] == ["a,'b", "c'"]
    assert parse_cell("(a (b, c), d") == [("(a (b", "open_group"), ("c)", None), ("d", None)]
