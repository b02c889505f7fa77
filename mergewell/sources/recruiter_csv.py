"""Recruiter CSV files as raw records."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mergewell import fixed
from mergewell.functions.normal import first_number, strip
from mergewell.operators.merge import RAW, as_raw
from mergewell.sources.registry import REGISTRY

#: Bytes of a file read on the driver to find its header and its encoding's first fault.
HEADER_BYTES, PROBE_BYTES = 1 << 16, 1 << 20


def resolve_headers(headers: list[str]) -> dict[str, int]:
    """field -> place of its column: of several headers of one field the first counts, unknown ones are left aside."""
    known = fixed.HEADERS
    out: dict[str, int] = {}
    for i, h in enumerate(headers):
        field = known.get(h.strip().lower())
        if field and field not in out:
            out[field] = i
    return out


def cell(c: Column) -> Column:
    """A cell without outer white space, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def split_skills(c: Column) -> Column:
    """The parts of a cell between commas, semicolons and bars, without blanks; empty for none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|]+"), strip), lambda x: x != "")


def is_empty_row(cells: list[Column]) -> Column:
    return F.forall(F.array(*cells), lambda x: F.coalesce(strip(x), F.lit("")) == "")


def encoding_of(path: str) -> str:
    """UTF-8, or ISO-8859-1 if the file isn't valid UTF-8. Reads the file in pieces; nothing is kept."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as f:
        try:
            while piece := f.read(PROBE_BYTES):
                decoder.decode(piece)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return "ISO-8859-1"
    return "UTF-8"


def _header(path: str, encoding: str) -> list[str] | None:
    with open(path, encoding="utf-8-sig" if encoding == "UTF-8" else "latin-1", newline="") as f:
        return next(csv.reader(f), None)


def to_raw(cells: DataFrame, columns: list[str], header: list[str], source_file: Column, entity: Column, seq: Column) -> DataFrame:
    """Rows of cells (string columns) under a header as raw records; rows with all cells blank are left out."""
    at = resolve_headers(header)
    get = lambda f: cell(F.col(f"`{columns[at[f]]}`")) if f in at and at[f] < len(columns) else F.lit(None).cast("string")
    one = lambda f: F.filter(F.array(get(f)), lambda x: x.isNotNull())
    rows = cells.filter(~is_empty_row([F.col(f"`{c}`") for c in columns]))
    return as_raw(rows.select(
        entity.alias("entity_id"), seq.alias("rec_seq"), F.lit("recruiter_csv").alias("source"), source_file.alias("source_file"), get("full_name").alias("full_name"), one("email").alias("emails"),
        one("phone").alias("phones"), get("location").alias("location"), one("linkedin_url").alias("links"), get("headline").alias("headline"),
        first_number(get("years_experience")).cast("string").alias("years_experience"), split_skills(get("skills")).alias("skills"),
    ))


@REGISTRY.register
class RecruiterCsv:
    """One CSV file with a header row: quoted fields, doubled quotes and line breaks within quotes; UTF-8 (a byte order
    mark is dropped) or else Latin-1. An empty file or one without a header gives no record; a missing one raises
    FileNotFoundError. Cells are text, never typed by inference; surplus cells are dropped, missing ones null."""

    source_type = "recruiter_csv"

    def can_handle(self, path: str) -> bool:
        return str(path).lower().endswith(".csv")

    def extract(self, spark: SparkSession, path: str) -> DataFrame:
        path = str(path)
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        encoding = encoding_of(path)
        header = _header(path, encoding)
        if not header:
            return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in RAW.items()))
        columns = [f"c{i}" for i in range(len(header))]
        cells = (
            spark.read.schema(", ".join(f"{c} string" for c in columns))
            .options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding, enforceSchema=True, mode="PERMISSIVE").csv("file://" + os.path.abspath(path))
        )
        cells = cells.withColumn("_seq", F.monotonically_increasing_id())
        return to_raw(cells, columns, header, F.lit(os.path.basename(path)), F.lit(None).cast("string"), F.col("_seq"))
