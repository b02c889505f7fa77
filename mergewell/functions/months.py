"""Month arithmetic and the reading of dates typed by people, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names, and words for an end that hasn't come.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ONGOING = (
    "present", "current", "currently", "now", "ongoing", "today", "to date", "till date", "until now", "till now", "to present",
    "till present", "until present", "to now", "date", "up to now", "till today", "until today", "to today", "continuing", "at present",
)

_NAME = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"
#: (pattern over the trimmed lower-case text, group of the year, group of the month or None for a bare year)
_FORMS = (
    ("^([0-9]{4})$", 1, None),
    ("^([0-9]{4})[-/.]([0-9]{1,2})(?:[-/.][0-9]{1,2})?(?:[t ][0-9:.z+]*)?$", 1, 2),
    ("^([0-9]{1,2})[-/.]([0-9]{4})$", 2, 1),
    ("^" + _NAME + "[.,]?[ -]*([0-9]{4})$", 2, 1),
    ("^" + _NAME + "[.,]? *['’]([0-9]{2})$", 2, 1),
    ("^" + _NAME + "[.,]? +[0-9]{1,2}(?:st|nd|rd|th)?,? +([0-9]{4})$", 2, 1),
    ("^[0-9]{1,2}(?:st|nd|rd|th)?[ -]+" + _NAME + "[.,]?[ -]+([0-9]{4})$", 2, 1),
)
_DAY_FIRST = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"


def clean_text(c: Column) -> Column:
    """c without outer white space, inner runs of it as one blank, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def _year(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(F.length(c) == 2, n + F.when(n >= 50, 1900).otherwise(2000)).otherwise(n)


def _month(c: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(c, 1, 3)).cast("int")
    return F.when(c.rlike("^[0-9]"), c.try_cast("int")).otherwise(named)


def month_index(c: Column) -> Column:
    """Months since year 0 of a date as typed; null if it can't be read. A bare year is its January.

    Two numbers before a year are day and month (if only one of them can be a month, that one is).
    """

    def read(t: Column) -> Column:
        out = []
        for pattern, y, m in _FORMS:
            month = F.lit(1) if m is None else _month(F.regexp_extract(t, pattern, m))
            year = _year(F.regexp_extract(t, pattern, y))
            out.append(F.when(t.rlike(pattern) & month.between(1, 12), year * 12 + month - 1))
        a, b = (F.regexp_extract(t, _DAY_FIRST, k).try_cast("int") for k in (1, 2))
        month = F.when(b.between(1, 12) & a.between(1, 31), b).when(a.between(1, 12) & b.between(1, 31), a)
        out.append(F.when(t.rlike(_DAY_FIRST), _year(F.regexp_extract(t, _DAY_FIRST, 3)) * 12 + month - 1))
        return F.coalesce(*out)

    # The lambda binds the cleaned text once; written out in every branch, it would outgrow the code limit of a method.
    return F.get(F.transform(F.array(clean_text(c)), read), F.lit(0))


def is_ongoing(c: Column) -> Column:
    """Whether a date as typed is null, blank or says that the period goes on."""
    return c.isNull() | (clean_text(c) == "") | clean_text(c).isin(*ONGOING)


def month_text(index: Column) -> Column:
    """``YYYY-MM`` of a month index; null for null."""
    return F.when(index.isNotNull(), F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int")))
