"""The queries of the problems whose operators live in the core: 1, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewell.operators.bad_rows import bad_rows
from mergewell.operators.intervals import employment_periods
from mergewell.operators.packed_values import split_packed
from mergewell.runtime import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_packed(read(spark, sf_dir, "recruiter"), "row_id", "skills")
    return found.selectExpr("id AS row_id", "pos", "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment_periods(read(spark, sf_dir, "raw_experience"), read(spark, sf_dir, "raw_candidate"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows(read(spark, sf_dir, "recruiter_lines"), read(spark, sf_dir, "recruiter"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found}

_ORACLE_P4 = r"""
WITH typed AS (
  SELECT raw_id, 's' AS side, entry_id, is_current, start_date AS d FROM raw_experience
  UNION ALL SELECT raw_id, 'e', entry_id, is_current, end_date FROM raw_experience),
clean AS (
  SELECT *, lower(regexp_replace(trim(d, ' ' || chr(9) || chr(10)), '\s+', ' ', 'g')) AS t FROM typed),
shaped AS (
  SELECT *, CASE
    WHEN regexp_full_match(t, '[0-9]{4}') THEN t || '-01'
    WHEN regexp_full_match(t, '[0-9]{4}[-/.][0-9]{1,2}([-/.][0-9]{1,2})?') THEN regexp_replace(t, '^([0-9]{4})[-/.]([0-9]{1,2}).*$', '\1-\2')
    WHEN regexp_full_match(t, '[0-9]{1,2}[-/.][0-9]{4}') THEN regexp_replace(t, '^([0-9]{1,2})[-/.]([0-9]{4})$', '\2-\1')
    WHEN regexp_full_match(t, '[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}') THEN
      CASE WHEN CAST(split_part(regexp_replace(t, '[-/.]', '/', 'g'), '/', 2) AS int) <= 12 THEN regexp_replace(t, '^[0-9]+[-/.]([0-9]+)[-/.]([0-9]{4})$', '\2-\1')
           ELSE regexp_replace(t, '^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]{4})$', '\3-\1') END
    WHEN regexp_matches(t, '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]?[ -]*[0-9]{4}$') THEN right(t, 4) || '-' || left(t, 3)
    WHEN regexp_matches(t, '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]? *''[0-9]{2}$') THEN (CASE WHEN right(t, 2) >= '50' THEN '19' ELSE '20' END) || right(t, 2) || '-' || left(t, 3)
    WHEN regexp_matches(t, '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]? +[0-9]{1,2}(st|nd|rd|th)?,? +[0-9]{4}$') THEN right(t, 4) || '-' || left(t, 3)
    WHEN regexp_matches(t, '^[0-9]{1,2}(st|nd|rd|th)?[ -]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]?[ -]+[0-9]{4}$')
      THEN right(t, 4) || '-' || regexp_extract(t, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)')
    END AS y FROM clean),
numbered AS (
  SELECT *, CAST(left(y, 4) AS int) AS yy, coalesce(try_cast(substr(y, 6) AS int),
    list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(y, 6))) AS mm FROM shaped),
months AS (SELECT *, CASE WHEN mm BETWEEN 1 AND 12 THEN yy * 12 + mm - 1 END AS m FROM numbered),
entries AS (
  SELECT s.raw_id, s.m AS a, CASE
    WHEN s.is_current OR s2.t IS NULL OR s2.t = '' OR s2.t IN ('present','current','currently','now','ongoing','today','to date','till date')
      THEN year(r.extracted_at AT TIME ZONE 'UTC') * 12 + month(r.extracted_at AT TIME ZONE 'UTC') - 1 ELSE s2.m END AS b
  FROM months s JOIN months s2 ON s.entry_id = s2.entry_id AND s.side = 's' AND s2.side = 'e' JOIN raw_candidate r ON r.raw_id = s.raw_id),
kept AS (SELECT * FROM entries WHERE a IS NOT NULL AND b >= a),
flagged AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY raw_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM kept),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY raw_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM flagged),
periods AS (SELECT raw_id, n, min(a) AS a, max(b) AS b FROM islands GROUP BY raw_id, n),
led AS (SELECT *, lead(a) OVER (PARTITION BY raw_id ORDER BY a) AS nxt FROM periods),
both_kinds AS (
  SELECT raw_id, 'period' AS kind, a, b FROM led
  UNION ALL SELECT raw_id, 'gap', b + 1, nxt - 1 FROM led WHERE nxt IS NOT NULL)
SELECT raw_id, kind, printf('%04d-%02d', a // 12, a % 12 + 1) AS first_month, printf('%04d-%02d', b // 12, b % 12 + 1) AS last_month FROM both_kinds
"""

# The table gives the bounds of a record: a line break outside of quotes is a character like others.
_FIELD = r'("([^"]|"")*"|[^",]*)'
_YEARS = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*\+?"
_ORACLE_P5 = rf"""
WITH lines AS (
  SELECT line_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') AS ok FROM recruiter_lines),
cells AS (
  SELECT line_id, line, ok, list_transform(regexp_extract_all(',' || line, ',{_FIELD}'), lambda x: substr(x, 2)) AS c FROM lines),
plain AS (
  SELECT line_id, ok, len(c) AS n, list_transform(c, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS c FROM cells),
vals AS (
  SELECT 'recruiter_lines' AS origin, line_id AS row_id, c[8] AS years, c[3] AS phone FROM plain WHERE ok AND n = 8
  UNION ALL SELECT 'recruiter', row_id, years_experience, phone FROM recruiter),
norm AS (
  SELECT origin, row_id, lower(trim(years, ' ' || chr(9) || chr(10) || chr(13))) AS y, regexp_replace(phone, '[ .()\-]', '', 'g') AS p FROM vals),
found AS (
  SELECT 'recruiter_lines' AS origin, line_id AS row_id, 'quoting' AS reason FROM plain WHERE NOT ok
  UNION ALL SELECT 'recruiter_lines', line_id, 'column_count' FROM plain WHERE line IS NULL OR (ok AND n <> 8)
  UNION ALL SELECT origin, row_id, 'years_experience' FROM norm WHERE y IS NOT NULL AND y <> '' AND NOT (
    regexp_full_match(y, '{_YEARS}\s*(-\s*{_YEARS})?\s*(years?|yrs?)?')
    AND len(list_filter(regexp_extract_all(y, '[0-9]+(\.[0-9]*)?|\.[0-9]+'), lambda v: try_cast(v AS double) > 60)) = 0)
  UNION ALL SELECT origin, row_id, 'phone' FROM norm WHERE p IS NOT NULL AND p <> ''
    AND NOT regexp_full_match(p, '(\+|00)?[0-9]{{10,13}}((x|ext)[0-9]{{1,5}})?'))
SELECT DISTINCT origin, row_id, reason FROM found
""".replace("SELECT line_id, ok, len(c)", "SELECT line_id, line, ok, len(c)")

ORACLE = {"p4_found": _ORACLE_P4, "p5_found": _ORACLE_P5}
