"""Separation of rows that fail to parse or to validate (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mergewell.functions.normal import bind

FIELDS = ("full_name", "email", "phone", "location", "linkedin_url", "headline", "skills", "years_experience")

_NUMBER = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*\+?"
#: The rule table. pattern: over the trimmed lower-case cell (years) or the stripped cell (phone);
#: groups of numbers that must not exceed most; drop: characters removed first.
RULES = (
    # column, reason, fold, drop, pattern, most
    ("years_experience", "years_experience", True, "", rf"^{_NUMBER}\s*(?:-\s*{_NUMBER})?\s*(?:years?|yrs?)?$", 60.0),
    ("phone", "phone", False, r"[ .()\-]", r"^(?:\+|00)?[0-9]{10,13}(?:(?:x|ext)[0-9]{1,5})?$", None),
)


def rfc4180_pieces(line: Column) -> Column:
    """The pieces of a record between its quotes: those at even places stand outside of quoted fields."""
    return F.split(line, '"', -1)


def well_formed(line: Column) -> Column:
    """Whether a record is well formed by RFC 4180; linear, without backtracking.

    The table gives each record's bounds, so a line break ends none: outside of quotes it is a character like others.
    """

    def check(p: Column) -> Column:
        n = F.size(p)

        def good(x: Column, i: Column) -> Column:
            inner = (i > 0) & (i < n - 1)
            left = (i == 0) | (x == "") | x.startswith(",")  # after a closing quote
            right = (i == n - 1) | (x == "") | x.endswith(",")  # before an opening quote
            # An empty piece between two quotes is a doubled quote.
            return (i % 2 == 1) | (left & right & (~inner | (x == "") | (x.startswith(",") & x.endswith(","))))

        return (n % 2 == 1) & F.forall(F.transform(p, good), lambda ok: ok)

    return bind(rfc4180_pieces(line), check)


def rfc4180_cells(line: Column) -> Column:
    """The unquoted fields of a well-formed record; commas within quotes are masked while it is split."""
    masked = F.transform(
        rfc4180_pieces(line),
        lambda x, i: F.when(i % 2 == 1, F.replace(F.replace(x, F.lit("\u0001"), F.lit("\u0001a")), F.lit(","), F.lit("\u0001c"))).otherwise(x),
    )
    cells = F.split(F.array_join(masked, '"'), ",", -1)

    def unquote(x: Column) -> Column:
        inner = F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        inner = F.replace(F.replace(inner, F.lit("\u0001c"), F.lit(",")), F.lit("\u0001a"), F.lit("\u0001"))
        return F.when(x.startswith('"'), inner).otherwise(x)

    return F.transform(cells, unquote)


def _invalid(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells (origin, row_id, column, value) with the reason of each value that breaks its rule."""
    joined = cells.join(F.broadcast(rules), "column")  # the rule table is a constant of two rows
    blank = F.col("value").isNull() | F.col("value").rlike(r"(?U)^\s*$")
    t = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    t = F.when(F.col("fold"), F.lower(t)).otherwise(t)
    t = F.when(F.col("drop") != "", F.regexp_replace(t, F.col("drop"), F.lit(""))).otherwise(t)
    numbers = [F.expr(f"try_cast(nullif(regexp_extract(_t, pattern, {k}), '') AS double)") for k in (1, 2)]
    high = F.col("most").isNotNull() & (F.coalesce(F.greatest(*numbers), F.lit(0.0)) > F.col("most"))
    checked = joined.withColumn("_t", t).withColumn("_hit", F.expr("regexp_like(_t, pattern)"))
    # The groups are read only where the pattern matched; a pattern without groups has no bound.
    bad = ~blank & (~F.col("_hit") | F.when(F.col("_hit") & F.col("most").isNotNull(), high).otherwise(False))
    return checked.filter(bad).select("origin", "row_id", "reason")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "column string, reason string, fold boolean, drop string, pattern string, most double")


def _cell_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(origin, row_id, column, value): the named values of each row, one per row."""
    pairs = [F.struct(F.lit(k).alias("column"), v.alias("value")) for k, v in values.items()]
    return df.select("origin", "row_id", F.inline(F.array(*pairs)))


def parse_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """(origin, row_id, _key, cells, reason) of CSV records as text; _key is a hash of the text.

    reason is ``quoting`` (not well formed by RFC 4180), ``column_count`` (well formed, but not eight fields; a
    null line counts as this) or null; cells is null unless reason is.
    """
    got = lines.select(F.lit("recruiter_lines").alias("origin"), F.col(id_col).cast("long").alias("row_id"), F.col(line_col).alias("_line"))
    got = got.withColumn("_key", F.xxhash64("_line"))
    got = got.withColumn("_ok", well_formed(F.col("_line"))).withColumn("_cells", F.when(F.col("_ok"), rfc4180_cells(F.col("_line"))))
    reason = F.when(~F.col("_ok"), "quoting").when(F.col("_line").isNull() | (F.size("_cells") != len(FIELDS)), "column_count")
    return got.select("origin", "row_id", "_key", F.when(reason.isNull(), F.col("_cells")).alias("cells"), reason.alias("reason"))


def bad_rows(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """(origin, row_id, reason): one row per reason for which a record can't be loaded.

    Records of ``lines`` can have any reason, rows of ``loaded`` only that of an impossible value. Parsed cells are
    exploded into row, column and value, joined with the rule table and validated. Narrow but for the last
    step, which makes repeated (row, reason) pairs one. Null and blank values are valid; empty tables give none.
    """
    rules = rule_table(lines.sparkSession)
    parsed = parse_lines(lines)
    structural = parsed.filter("reason is not null").select("origin", "row_id", "reason")
    of_lines = _cell_rows(parsed.filter("reason is null"), {r[0]: F.get("cells", F.lit(FIELDS.index(r[0]))) for r in RULES})
    source = loaded.select(F.lit("recruiter").alias("origin"), F.col("row_id").cast("long").alias("row_id"), *(F.col(r[0]).alias(f"_{r[0]}") for r in RULES))
    of_loaded = _cell_rows(source, {r[0]: F.col(f"_{r[0]}") for r in RULES})
    return structural.unionByName(_invalid(of_lines.unionByName(of_loaded), rules)).distinct()


def row_errors(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """(origin, row_id, reasons): the errors of each failing row, aggregated and sorted."""
    return bad_rows(lines, loaded).groupBy("origin", "row_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def load_lines(lines: DataFrame, id_col: str = "line_id") -> DataFrame:
    """The records of ``lines`` that have no error, as columns: line_id and the eight fields (blank is null).

    An anti-join against the errors keeps the clean rows, so one that fails any rule isn't loaded at all, with or without an id.
    """
    parsed = parse_lines(lines, id_col)
    rules = rule_table(lines.sparkSession)
    # A row is known by its id and a hash of its text, so one with a null id is told from others, too.
    good = parsed.filter("reason is null").select(F.struct("row_id", "_key").alias("row_id"), "origin", "cells")
    cells = _cell_rows(good, {r[0]: F.get("cells", F.lit(FIELDS.index(r[0]))) for r in RULES})
    bad = _invalid(cells, rules).select("row_id").distinct().alias("b")
    clean = good.alias("g").join(bad, (F.col("g.row_id._key") == F.col("b.row_id._key")) & F.col("g.row_id.row_id").eqNullSafe(F.col("b.row_id.row_id")), "left_anti")
    return clean.select(F.col("row_id.row_id").alias("line_id"), *(F.nullif(F.trim(F.col("cells")[i]), F.lit("")).alias(f) for i, f in enumerate(FIELDS)))
