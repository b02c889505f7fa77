"""Résumés as raw records: text of a PDF file, and its structure by Catalyst expressions over the text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mergewell import fixed
from mergewell.functions.normal import bind, strip
from mergewell.operators.merge import EDUCATION, EXPERIENCE, as_raw
from mergewell.sources.registry import REGISTRY

_I = "(?i)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def find_emails(text: Column) -> Column:
    """Addresses in order of appearance, each once (by its exact letters)."""
    return F.array_distinct(_all(text, rf"\b{fixed.EMAIL}\b"))


def find_phones(text: Column) -> Column:
    """Numbers of 7 to 15 digits in order of appearance, trimmed, each once."""
    found = F.filter(_all(text, fixed.PHONE), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(7, 15))
    return F.array_distinct(F.transform(found, strip))


def find_links(text: Column) -> Column:
    """LinkedIn, then GitHub, then other addresses, each once."""
    linkedin, github = _all(text, f"(?U){_I}{fixed.LINKEDIN}"), _all(text, f"(?U){_I}{fixed.GITHUB}")
    others = F.filter(_all(text, f"(?U){_I}{fixed.URL}"), lambda u: ~F.lower(u).contains("linkedin") & ~F.lower(u).contains("github"))
    return F.array_distinct(F.concat(linkedin, github, others))


def heading(line: Column) -> Column:
    """The section that a line opens as a heading, or null: at most 60 characters, not ending in a full stop."""
    t = strip(line)
    out = None
    for name, pattern in fixed.HEADINGS:
        at = t.rlike(f"(?U){_I}^(?:{pattern})$")
        out = F.when(at, name) if out is None else out.when(at, name)
    return F.when((F.length(t) <= 60) & ~t.endswith("."), out)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u0085  ]")


def sections(text: Column) -> Column:
    """map<section, array<line>>: lines under each heading; those before the first are ``header``.

    A heading of the section that is open is content; a section that is opened again replaces its earlier lines.
    """
    zero = F.struct(F.lit("header").alias("now"), F.create_map(F.lit("header"), F.array().cast("array<string>")).cast("map<string,array<string>>").alias("m"))

    def put(m: Column, k: Column, lines: Column) -> Column:
        others = F.map_filter(m, lambda key, _: key != k)
        return F.map_concat(others, F.map_from_arrays(F.array(k), F.array(lines)))

    def add(acc: Column, line: Column) -> Column:
        def use(h: Column) -> Column:
            opens = h.isNotNull() & (h != acc["now"])
            opened = F.struct(h.alias("now"), put(acc["m"], h, F.array().cast("array<string>")).alias("m"))
            longer = F.struct(acc["now"].alias("now"), put(acc["m"], acc["now"], F.concat(F.try_element_at(acc["m"], acc["now"]), F.array(line))).alias("m"))
            return F.when(opens, opened).otherwise(longer)

        return bind(heading(line), use)

    return F.aggregate(lines_of(text), zero, add, lambda acc: acc["m"])


def name_of(header: Column) -> Column:
    """The first line of at least two words that has at most 60 characters and is no address, link or number."""

    def fits(t: Column) -> Column:
        return (t != "") & (F.length(t) <= 60) & ~t.contains("@") & ~F.lower(t).contains("http") & ~t.rlike(r"^[0-9\s+\-().]+$") & t.rlike(r"(?U)\S\s+\S")

    return F.get(F.filter(F.transform(header, strip), fits), F.lit(0))


def headline_of(summary: Column) -> Column:
    return F.get(F.filter(F.transform(summary, strip), lambda t: F.length(t) > 5), F.lit(0))


def years_in(text: Column) -> Column:
    """The first "n years" of a text, n in digits or as a word up to twenty."""
    words = F.create_map(*(F.lit(x) for i, w in enumerate(fixed.NUMBER_WORDS) for x in (w, float(i))))
    number, word = (F.regexp_extract(text, f"{_I}{fixed.YEARS}", k) for k in (1, 2))
    return F.when(number != "", number.try_cast("double")).when(word != "", F.try_element_at(words, F.lower(word)))


def skills_in(lines: Column) -> Column:
    """Parts of the lines between commas, bars, bullets and line ends, without odd signs, of 2 to 59 characters, each once."""
    parts = F.split(F.array_join(lines, "\n"), r"[,|•·\n]+")
    clean = F.transform(parts, lambda p: strip(F.regexp_replace(p, r"(?U)[^\w\s+#./\-]", "")))
    return F.array_distinct(F.filter(clean, lambda c: F.length(c).between(2, 59)))


def blocks(lines: Column, boundary: Callable[[Column], Column]) -> Column:
    """Lines in blocks: a boundary line starts a new one if the current one isn't empty."""
    zero = F.array().cast("array<array<string>>")

    def add(acc: Column, line: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = (F.size(acc) == 0) | boundary(line)
        return F.when(fresh, F.concat(acc, F.array(F.array(line)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(line)))))

    texts = F.transform(F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), zero, add), lambda b: F.array_join(F.filter(F.transform(b, strip), lambda x: x != ""), " "))
    return F.filter(texts, lambda t: t != "")


def experience_in(lines: Column) -> Column:
    """Jobs: a block per line with a range of dates; title and company are its first parts without the range."""
    pattern = f"{_I}{fixed.DATE_RANGE}"

    def entry(t: Column) -> Column:
        start, end = (F.nullif(F.regexp_extract(t, pattern, k), F.lit("")) for k in (1, 2))
        current = F.coalesce(end.rlike("(?i)^(?:present|current|now)"), F.lit(False))
        rest = F.regexp_replace(F.regexp_replace(t, pattern, ""), r"^[ –—|\-]+|[ –—|\-]+$", "")
        parts = F.filter(F.transform(F.split(rest, r"\s*[|@–—,]\s*|\s{2,}"), strip), lambda p: p != "")
        none = F.lit(None).cast("string")
        return F.struct(F.get(parts, F.lit(0)).alias("title"), F.get(parts, F.lit(1)).alias("company"), start.alias("start_date"), F.when(~current, end).alias("end_date"), current.alias("is_current"), t.alias("description"), none.alias("location"))

    return F.transform(blocks(lines, lambda x: x.rlike(pattern)), entry).cast(EXPERIENCE)


def education_in(lines: Column) -> Column:
    """Degrees: a block per line with a date or a degree; the institution is the block without both."""
    span, degree = f"{_I}{fixed.DATE_RANGE}", f"{_I}(?U){fixed.DEGREE}"

    def entry(t: Column) -> Column:
        d = F.regexp_extract(t, degree, 1)
        start, end = (F.nullif(F.regexp_extract(t, span, k), F.lit("")) for k in (1, 2))
        rest = F.regexp_replace(F.when(d != "", F.replace(t, d, F.lit(""))).otherwise(t), span, "")
        place = F.nullif(F.regexp_replace(rest, r"^[ ,|–—]+|[ ,|–—]+$", ""), F.lit(""))
        return F.struct(place.alias("institution"), F.nullif(d, F.lit("")).alias("degree"), F.lit(None).cast("string").alias("field_of_study"), start.alias("start_date"), end.alias("end_date"), F.lit(None).cast("double").alias("gpa"))

    starts = f"{_I}{fixed.DATE}|{fixed.DEGREE_LINE}"
    return F.transform(blocks(lines, lambda x: x.rlike(starts)), entry).cast(EDUCATION)


def parse_resumes(texts: DataFrame, text_col: str = "text", entity_col: str = "entity_id", seq_col: str = "rec_seq", file_col: str = "source_file") -> DataFrame:
    """Raw records of résumé texts, with raw_text. Blank and null texts give none; the place is never set. Narrow."""
    df = texts.filter(F.coalesce(strip(F.col(text_col)), F.lit("")) != "").withColumn("_m", sections(F.col(text_col)))
    part = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    optional = lambda c, t: (F.col(c) if c in texts.columns else F.lit(None)).cast(t).alias(c)
    got = df.select(
        optional(entity_col, "string"), optional(seq_col, "long"), F.lit("resume_pdf").alias("source"), optional(file_col, "string"), name_of(part("header")).alias("full_name"), find_emails(F.col(text_col)).alias("emails"),
        find_phones(F.col(text_col)).alias("phones"), find_links(F.col(text_col)).alias("links"), headline_of(part("summary")).alias("headline"), years_in(F.col(text_col)).cast("string").alias("years_experience"),
        skills_in(part("skills")).alias("skills"), experience_in(part("experience")).alias("experience"), education_in(part("education")).alias("education"), F.col(text_col).alias("raw_text"),
    )
    return as_raw(got.withColumnsRenamed({entity_col: "entity_id", seq_col: "rec_seq", file_col: "source_file"})) if text_col else got


def pdf_text(content: bytes, most_pages: int = 20) -> str:
    """Text of the first pages, joined by line breaks; empty if the file can't be read or no PDF library is there."""
    try:
        import fitz
    except ImportError:
        return ""
    try:
        with fitz.open(stream=content, filetype="pdf") as doc:
            return "\n".join(page.get_text() for k, page in enumerate(doc) if k < most_pages).strip()
    except Exception:
        return ""


@REGISTRY.register
class ResumePdf:
    """PDF résumés; ``text_of`` turns a file's bytes into text and can be replaced; by default the first ``max_pages`` are read. No text,
    no record."""

    source_type = "resume_pdf"

    max_pages = 20

    def __init__(self, text_of: Callable[[bytes], str] | None = None) -> None:
        self.text_of = text_of

    def can_handle(self, path: str) -> bool:
        return str(path).lower().endswith(".pdf")

    def extract(self, spark: SparkSession, path: str) -> DataFrame:
        if not any(c in str(path) for c in "*?[{") and not os.path.exists(path):
            raise FileNotFoundError(path)
        most = self.max_pages
        text_of = self.text_of or (lambda content: pdf_text(content, most))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array([text_of(x) if x else "" for x in b.to_pylist()], pa.string())

        files = spark.read.format("binaryFile").load("file://" + os.path.abspath(path))
        texts = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("source_file"), F.arrow_udf(run, "string")("content").alias("text"), F.lit(0).cast("long").alias("rec_seq"))
        return parse_resumes(texts)
