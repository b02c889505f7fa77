"""Queries for the operators of the merge engine on the given tables, each with the same result in DuckDB's SQL where SQL can give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mergewell import fixed
from mergewell.functions import normal as N
from mergewell.operators import long_form as L, merge as M
from mergewell.operators.projection import FieldConfig, ProjectionConfig, project, project_json
from mergewell.operators.validation import E164, UUID, metrics, validate
from mergewell.plans.pipeline import merge_all
from mergewell.runtime import read
from mergewell.settings import Settings
from mergewell.sources import recruiter_csv as C, resume as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = "2026-07-01T00:00:00"
ALL_RECORDS = Settings(now=NOW)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- events as entities with several sources --------------------------------------------------------------------------

_KINDS = {"signup": (1, "1.00"), "purchase": (2, "0.85"), "click": (3, "0.70"), "view": (4, "0.80"), "error": (5, "0.75")}
_DIM = "(VALUES " + ", ".join(f"('{k}', {p}, CAST({r} AS DECIMAL(3,2)))" for k, (p, r) in _KINDS.items()) + ") AS dim(source, priority, reliability)"
_FIRST = f"""
  SELECT user_id, event_type AS source, ts, event_id, json_extract_string(props, '$.k') AS k, value, dim.priority, dim.reliability FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) e JOIN {_DIM} ON dim.source = e.event_type WHERE n = 1"""


def _dim(c: Column, place: int, kind: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for s, v in _KINDS.items() for x in (s, v[place]))), c).cast(kind)


def _first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type: a record of a source."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*_KINDS))
    raw = e.withColumns({"entity_id": F.col("user_id").cast("string"), "source": F.col("event_type"), "rec_seq": F.expr("unix_micros(CAST(ts AS TIMESTAMP))"), "source_file": F.lpad(F.col("event_id").cast("string"), 20, "0")})
    return M.first_records(raw, 1).select("user_id", "source", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"), "value", _dim(F.col("source"), 0, "int").alias("priority"), _dim(F.col("source"), 1, "decimal(3,2)").alias("reliability"))


@query(f"SELECT user_id, source, ts, event_id, k FROM ({_FIRST})")
def first_record_per_source(spark, sf_dir):
    return _first_events(spark, sf_dir).select("user_id", "source", "ts", "event_id", "k")


def _decisions(spark, sf_dir) -> DataFrame:
    e = _first_events(spark, sf_dir)
    return L.resolve(e, ["user_id"], F.col("k"), N.compare_key(F.col("k")), [F.col("priority"), F.col("source"), F.col("event_id")], {"source": F.col("source"), "priority": F.col("priority"), "reliability": F.col("reliability")})


_DECIDED = f"""
  first AS ({_FIRST}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, source, event_id) AS r FROM first WHERE k IS NOT NULL),
  decided AS (
    SELECT w.user_id, w.k AS value, w.source, w.priority, w.reliability, count(*) FILTER (WHERE lower(trim(o.k)) = lower(trim(w.k))) AS agreed,
      count(DISTINCT lower(trim(o.k))) AS n_values, count(*) AS n_rows FROM ranked w JOIN ranked o ON w.user_id = o.user_id AND w.r = 1 GROUP BY ALL)"""
_SCORE = "CAST(round(least(CAST(reliability * CAST(0.9 AS DECIMAL(4,3)) * CAST(least(1 + (agreed - 1) * 0.05, 1.2) AS DECIMAL(8,4)) AS DECIMAL(20,9)), CAST(1 AS DECIMAL(20,9))), 4) AS DECIMAL(6,4))"


@query(f"WITH {_DECIDED} SELECT user_id, value, source, agreed, n_values > 1 AS had_conflict FROM decided")
def resolve_scalar(spark, sf_dir):
    return _decisions(spark, sf_dir).select("user_id", "value", "source", "agreed", "had_conflict")


@query(f"WITH {_DECIDED} SELECT user_id, value, source, agreed, n_values > 1 AS had_conflict, {_SCORE} AS score FROM decided")
def field_confidence(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.select("user_id", "value", "source", "agreed", "had_conflict", L.score(F.col("reliability"), F.lit("0.900").cast("decimal(4,3)"), F.col("agreed")).alias("score"))


@query(f"""WITH {_DECIDED}, texts AS (
  SELECT w.user_id, any_value(w.value) AS value, any_value(w.source) AS source, any_value(w.priority) AS priority, any_value(w.n_rows) AS n, any_value(w.n_values) AS n_values,
    string_agg(o.source, ', ' ORDER BY o.r) AS sources, string_agg('''' || o.source || ''' → ''' || o.k || '''', '; ' ORDER BY o.r) FILTER (WHERE o.r > 1) AS losers
  FROM decided w JOIN ranked o ON w.user_id = o.user_id GROUP BY w.user_id)
SELECT user_id, CASE WHEN n = 1 THEN 'Single source ''' || source || ''' provided this value. No conflict to resolve.'
  WHEN n_values > 1 THEN 'Conflict detected across ' || n || ' sources. Chose ''' || value || ''' from ''' || source || ''' (priority=' || priority || '). Discarded: ' || losers || '. Priority order is deterministic per SOURCE_PRIORITY config.'
  ELSE 'All ' || n || ' sources agree on this value (' || sources || '). Chose from highest-priority source ''' || source || '''.' END AS reason FROM texts""")
def conflict_reason(spark, sf_dir):
    e = _first_events(spark, sf_dir).filter("k is not null")
    c = F.array_sort(F.collect_list(F.struct("priority", "source", "event_id", F.struct(F.col("k").alias("value")).alias("n"))))  # at most one record per type
    keys = F.transform("c", lambda x: N.compare_key(x["n"]["value"]))
    agreed = F.size(F.filter(keys, lambda k: k == F.get(keys, F.lit(0))))
    return e.groupBy("user_id").agg(c.alias("c")).select("user_id", M.reason("k", F.col("c"), agreed, F.size(F.array_distinct(keys)) > 1).alias("reason"))


@query(f"WITH {_DECIDED} SELECT user_id, 'k' AS field, source AS winner_source, value AS winner_value, priority AS winner_priority, agreed AS agreed_sources, n_rows - 1 AS n_alternatives FROM decided WHERE n_values > 1")
def decision_log(spark, sf_dir):
    d = _decisions(spark, sf_dir).filter("had_conflict")
    return d.select("user_id", F.lit("k").alias("field"), F.col("source").alias("winner_source"), F.col("value").alias("winner_value"), F.col("priority").alias("winner_priority"), F.col("agreed").alias("agreed_sources"), (F.col("n_rows") - 1).alias("n_alternatives"))


@query(f"""WITH first AS ({_FIRST}), long AS (
    SELECT user_id, 'full_name' AS field, k AS v, source, priority, reliability, event_id FROM first UNION ALL SELECT user_id, 'headline', CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR), source, priority, reliability, event_id FROM first
    UNION ALL SELECT user_id, 'skills', CAST(event_id % 3 AS VARCHAR), source, priority, reliability, event_id FROM first),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY priority, source, event_id) AS r FROM long WHERE v IS NOT NULL),
  decided AS (SELECT w.user_id, w.field, w.reliability, count(*) FILTER (WHERE o.v = w.v) AS agreed FROM ranked w JOIN ranked o ON w.user_id = o.user_id AND w.field = o.field AND w.r = 1 GROUP BY ALL),
  scored AS (SELECT user_id, field, {_SCORE} AS score, CAST(CASE field WHEN 'full_name' THEN 1.5 WHEN 'headline' THEN 0.8 ELSE 1.2 END AS DECIMAL(3,1)) AS w FROM decided)
SELECT user_id, ((2 * CAST(sum(score * w) * 100000 AS BIGINT) + CAST(sum(w) * 10 AS BIGINT)) // (2 * CAST(sum(w) * 10 AS BIGINT))) / 10000.0 AS overall FROM scored WHERE score > 0 GROUP BY user_id""")
def overall_confidence(spark, sf_dir):
    e = _first_events(spark, sf_dir)
    values = {"full_name": F.col("k"), "headline": (F.floor("value") % 5).cast("string"), "skills": (F.col("event_id") % 3).cast("string")}
    long = e.select("user_id", "source", "priority", "reliability", "event_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("v")) for f, v in values.items()))))
    d = L.resolve(long, ["user_id", "field"], F.col("v"), F.col("v"), [F.col("priority"), F.col("source"), F.col("event_id")], {"reliability": F.col("reliability")})
    scored = d.select("user_id", "field", L.score(F.col("reliability"), F.lit("0.900").cast("decimal(4,3)"), F.col("agreed")).alias("score"))
    return L.overall(scored, ["user_id"]).select("user_id", F.col("overall").cast("double").alias("overall"))


@query("""WITH u AS (
  SELECT user_id, json_extract_string(props, '$.k') AS key, min(struct_pack(a := dim.priority, b := dim.source, c := ts, d := event_id)) AS f, count(*) - 1 AS repeats
  FROM events e JOIN """ + _DIM + """ ON dim.source = e.event_type WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2)
SELECT user_id, key, f.b AS source, repeats, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rank FROM u""")
def list_union_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*_KINDS))
    order = [_dim(F.col("event_type"), 0, "int"), F.col("event_type"), F.col("ts"), F.col("event_id")]
    return L.union_distinct(e, ["user_id"], F.get_json_object("props", "$.k"), order, {"source": F.col("event_type")})


@query("SELECT user_id, count(*) - count(DISTINCT json_extract_string(props, '$.k')) AS duplicates_removed FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY user_id")
def duplicates_removed(spark, sf_dir):
    return list_union_dedup(spark, sf_dir).groupBy("user_id").agg(F.sum("repeats").alias("duplicates_removed"))


# Places for the segments of customers, and the codes of their countries.
_COUNTRIES = {"BUILDING": ("India", "IN"), "MACHINERY": ("Germany", "DE"), "AUTOMOBILE": ("United States", "US"), "FURNITURE": ("France", "FR"), "HOUSEHOLD": ("nowhere", None)}
_CODE = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in _COUNTRIES.items() if c) + " END"
_COUNTRY = "CASE segment " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in _COUNTRIES.items()) + " END"


@query(f"""WITH s AS (
  SELECT c_nationkey AS entity, 1 AS priority, c_mktsegment AS segment, c_name AS city, c_custkey AS id FROM customer
  UNION ALL SELECT s_nationkey, 2, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END, s_name, s_suppkey FROM supplier),
c AS (SELECT *, {_CODE} AS code, city || ', ' || {_COUNTRY} AS raw FROM s),
w AS (SELECT entity, arg_min(code, struct_pack(a := priority, b := id)) FILTER (WHERE code IS NOT NULL) AS code, arg_min(raw, struct_pack(a := priority, b := id)) AS raw FROM c GROUP BY entity)
SELECT CAST(w.entity AS VARCHAR) AS entity, w.code AS country, arg_max(c.city, struct_pack(a := c.priority, b := c.id)) AS city, any_value(w.raw) AS raw FROM w JOIN c ON c.entity = w.entity AND c.code = w.code GROUP BY w.entity, w.code""")
def location_merge(spark, sf_dir):
    country = F.try_element_at(F.create_map(*(F.lit(x) for k, (n, _) in _COUNTRIES.items() for x in (k, n))), F.col("segment"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity"), F.lit("recruiter_csv").alias("source"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("city"), F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity"), F.lit("resume_pdf").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("segment"), F.col("s_name").alias("city"), F.col("s_suppkey").alias("id"))
    raw = c.unionByName(s).select(F.col("entity").cast("string").alias("entity_id"), F.col("id").alias("rec_seq"), "source", F.concat("city", F.lit(", "), country).alias("location"))
    # A nation holds a 25th of all customers, so they aren't gathered.
    located = L.places(M.normalize_records(M.first_records(M.as_raw(raw), None), ALL_RECORDS, fuzzy=False))
    return located.select(F.col("entity_id").alias("entity"), F.col("country_code").alias("country"), "city", "raw")


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"""WITH k AS (SELECT raw_id, entry_no, entry_id, coalesce(nullif(trim(lower(company), {_BLANK}), ''), chr(2)) || chr(1) || coalesce(nullif(trim(lower(title), {_BLANK}), ''), chr(2)) AS key FROM raw_experience),
f AS (SELECT *, row_number() OVER (PARTITION BY raw_id, key ORDER BY entry_no, entry_id) AS n FROM k)
SELECT raw_id, entry_no, entry_id FROM f WHERE n = 1""")
def experience_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "raw_experience")
    key = M._pair_key("company", "title")({"company": F.col("company"), "title": F.col("title")})
    return L.union_distinct(e, ["raw_id"], key, [F.col("entry_no"), F.col("entry_id")], {"entry_no": F.col("entry_no"), "entry_id": F.col("entry_id")}).select("raw_id", "entry_no", "entry_id")


@query(f"""WITH x AS (SELECT raw_id, unnest(education) AS e, generate_subscripts(education, 1) - 1 AS pos FROM raw_candidate),
f AS (SELECT raw_id, pos, e.institution AS institution, e.degree AS degree, row_number() OVER (PARTITION BY raw_id, coalesce(nullif(trim(lower(e.institution), {_BLANK}), ''), chr(2)), coalesce(nullif(trim(lower(e.degree), {_BLANK}), ''), chr(2)) ORDER BY pos) AS n FROM x)
SELECT raw_id, CAST(pos AS BIGINT) AS pos, institution, degree FROM f WHERE n = 1""")
def education_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "raw_candidate").select("raw_id", F.posexplode("education").alias("pos", "e"))
    key = M._pair_key("institution", "degree")({"institution": F.col("e.institution"), "degree": F.col("e.degree")})
    return L.union_distinct(e, ["raw_id"], key, [F.col("pos")], {"pos": F.col("pos").cast("long"), "institution": F.col("e.institution"), "degree": F.col("e.degree")}).select("raw_id", "pos", "institution", "degree")


@query("""WITH i AS (SELECT o_custkey, o_orderdate AS s, greatest(l_shipdate, o_orderdate) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY o_custkey ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS n FROM f),
p AS (SELECT o_custkey, n, min(s) AS s, max(t) AS t FROM g GROUP BY o_custkey, n)
SELECT o_custkey, CAST(sum(year(t) - year(s)) AS BIGINT) AS years FROM p GROUP BY o_custkey HAVING sum(year(t) - year(s)) > 0""")
def interval_union_years(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return L.interval_union_years(o.join(li, o["o_orderkey"] == li["l_orderkey"]), "o_custkey", F.col("o_orderdate"), F.greatest("l_shipdate", "o_orderdate"))


# --- scalar functions -------------------------------------------------------------------------------------------------


def _spread(df: DataFrame, keys: list[str], r: Column) -> DataFrame:
    return df.select(*keys, r.alias("_r")).select(*keys, "_r.value", "_r.success", F.col("_r.factor").cast("double").alias("factor"), "_r.method")


_EMAIL_SQL = f"regexp_full_match(l, '{fixed.EMAIL}')"


@query(rf"""WITH t AS (SELECT row_id, email, trim(email, {_BLANK}) AS s, lower(trim(email, {_BLANK})) AS l FROM recruiter)
SELECT row_id, nullif(l, '') AS value, coalesce(l <> '' AND {_EMAIL_SQL}, false) AS success,
  CAST(CASE WHEN coalesce(l, '') = '' THEN 0 WHEN length(l) - length(replace(l, '@', '')) <> 1 THEN 0.3 WHEN NOT {_EMAIL_SQL} THEN 0.5 ELSE 1 END AS DOUBLE) AS factor,
  CASE WHEN coalesce(l, '') = '' THEN 'empty_input' WHEN length(l) - length(replace(l, '@', '')) <> 1 THEN 'malformed_multiple_at_signs' WHEN NOT {_EMAIL_SQL} THEN 'format_invalid_kept_lowercased' WHEN s <> l THEN 'lowercased' ELSE 'already_lowercase' END AS method FROM t""")
def normalize_email(spark, sf_dir):
    return _spread(read(spark, sf_dir, "recruiter"), ["row_id"], N.normalize_email(F.col("email")))


@query("""WITH e AS (SELECT raw_id, emails, generate_subscripts(emails, 1) AS i, unnest(emails) AS e FROM raw_candidate), f AS (SELECT raw_id, i, e, row_number() OVER (PARTITION BY raw_id, lower(e) ORDER BY i) AS n FROM e),
g AS (SELECT raw_id, string_agg(e, chr(1) ORDER BY i) AS emails, count(*) AS n FROM f WHERE n = 1 GROUP BY raw_id)
SELECT r.raw_id, CASE WHEN r.emails IS NOT NULL THEN coalesce(g.emails, '') END AS emails, CAST(coalesce(g.n, 0) AS INT) AS n FROM raw_candidate r LEFT JOIN g ON r.raw_id = g.raw_id""")
def dedup_emails(spark, sf_dir):
    d = N.distinct_emails(F.col("emails"))
    return read(spark, sf_dir, "raw_candidate").select("raw_id", F.array_join(d, "\u0001").alias("emails"), F.coalesce(F.size(d), F.lit(0)).alias("n"))


_EDGE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _upper_first(x: str) -> str:
    return f"upper(({x})[1:1]) || lower(({x})[2:])"


@query(
    rf"""WITH t AS (SELECT row_id, regexp_replace(regexp_replace(full_name, '^{_EDGE}', ''), '{_EDGE}$', '') AS t FROM recruiter),
p AS (SELECT *, regexp_extract_all(t, '[^\s\x{{000B}}\-]+') AS w, regexp_extract_all(t, '[\s\x{{000B}}\-]+') AS g, regexp_matches(t, '^[\s\x{{000B}}\-]') AS gap FROM t),
c AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN list_contains([{', '.join(f"'{x}'" for x in fixed.PARTICLES)}], lower(x)) AND i < len(w) THEN lower(x)
  WHEN regexp_matches(lower(x), '^o''[a-z]') THEN 'O''' || {_upper_first('x[3:]')} WHEN regexp_matches(lower(x), '^mc[a-z]') THEN 'Mc' || {_upper_first('x[3:]')}
  WHEN regexp_matches(lower(x), '^mac[a-z]') THEN 'Mac' || {_upper_first('x[4:]')} ELSE {_upper_first('x')} END) AS cw FROM p),
n AS (SELECT row_id, t, array_to_string(list_transform(generate_series(1, greatest(len(w), len(g))), lambda i: CASE WHEN gap THEN coalesce(g[i], '') || coalesce(cw[i], '') ELSE coalesce(cw[i], '') || coalesce(g[i], '') END), '') AS name FROM c)
SELECT row_id, CASE WHEN t <> '' THEN name END AS value, coalesce(t, '') <> '' AS success, CAST(CASE WHEN coalesce(t, '') = '' THEN 0 WHEN name <> t THEN 0.9 ELSE 1 END AS DOUBLE) AS factor,
  CASE WHEN coalesce(t, '') = '' THEN 'empty_input' WHEN name <> t THEN 'normalized_case' ELSE 'already_proper_case' END AS method FROM n"""
)
def normalize_name(spark, sf_dir):
    return _spread(read(spark, sf_dir, "recruiter"), ["row_id"], N.normalize_name(F.col("full_name")))


@query(r"""SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS value, p_name <> list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS changed FROM part""")
def title_case(spark, sf_dir):
    n = N.normalize_name(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", n["value"].alias("value"), (n["method"] == "normalized_case").alias("changed"))


@query(r"""WITH l AS (SELECT doc_id, trim(url) AS t FROM documents WHERE url IS NOT NULL AND trim(url) <> ''), f AS (SELECT doc_id, regexp_matches(t, '(?i)^https?://') AS had, CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t ELSE 'https://' || t END AS u FROM l)
SELECT doc_id, lower(regexp_extract(u, '(?i)^(https?)://', 1)) || '://' || lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN length(regexp_extract(u, '(?i)^https?://[^/?#]*[^?#]*(\?[^#]*)', 1)) > 1 THEN regexp_extract(u, '(?i)^https?://[^/?#]*[^?#]*(\?[^#]*)', 1) ELSE '' END AS value,
  CASE WHEN had THEN 'url_normalized' ELSE 'url_scheme_added' END AS method FROM f""")
def normalize_url(spark, sf_dir):
    n = N.normalize_url(F.col("url"))
    return read(spark, sf_dir, "documents").filter("trim(url) <> ''").select("doc_id", n["value"].alias("value"), n["method"].alias("method"))


@query("SELECT raw_id, link, CASE " + " ".join(f"WHEN regexp_matches(link, '(?i){p}') THEN '{n}'" for n, p in fixed.PLATFORMS) + " ELSE 'other' END AS platform FROM (SELECT raw_id, unnest(links) AS link FROM raw_candidate)")
def infer_platform(spark, sf_dir):
    return read(spark, sf_dir, "raw_candidate").select("raw_id", F.explode("links").alias("link")).withColumn("platform", N.infer_platform(F.col("link")))


_LINK = r"CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t ELSE 'https://' || t END"
_URL_OF = r"""lower(regexp_extract(u, '(?i)^(https?)://', 1)) || '://' || lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN length(regexp_extract(u, '(?i)^https?://[^/?#]*[^?#]*(\?[^#]*)', 1)) > 1 THEN regexp_extract(u, '(?i)^https?://[^/?#]*[^?#]*(\?[^#]*)', 1) ELSE '' END"""


@query(f"""WITH l AS (SELECT source, trim(unnest(links)) AS t FROM raw_candidate), u AS (SELECT source, {_LINK} AS u FROM l WHERE t <> ''), k AS (SELECT source, {_URL_OF} AS key FROM u)
SELECT source, key, count(*) - 1 AS repeats, CASE """ + " ".join(f"WHEN regexp_matches(key, '(?i){p}') THEN '{n}'" for n, p in fixed.PLATFORMS) + """ ELSE 'other' END AS platform FROM k GROUP BY source, key""")
def links_union(spark, sf_dir):
    x = read(spark, sf_dir, "raw_candidate").select("raw_id", "source", F.posexplode("links").alias("pos", "link"))
    url = N.normalize_url(F.col("link"))["value"]
    return L.union_distinct(x, ["source"], url, [F.col("raw_id"), F.col("pos")], {"platform": N.infer_platform(url)}).drop("rank")


_MONTHS_SQL = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


@query(rf"""WITH t AS (SELECT entry_id, trim(start_date, {_BLANK}) AS t, lower(trim(start_date, {_BLANK})) AS l FROM raw_experience),
s AS (SELECT *, CASE
  WHEN regexp_full_match(t, '[0-9]{{4}}[-/.][0-9]{{1,2}}([-/.][0-9]{{1,2}})?') THEN regexp_replace(t, '^([0-9]{{4}})[-/.]([0-9]{{1,2}}).*$', '\1-\2')
  WHEN regexp_full_match(l, '([0-9]{{1,2}}(st|nd|rd|th)?[ -]+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]?[ -]+([0-9]{{1,2}}(st|nd|rd|th)?,? +)?[0-9]{{4}}') THEN right(t, 4) || '-' || list_position({_MONTHS_SQL}, regexp_extract(l, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'))
  WHEN regexp_full_match(t, '[0-9]{{1,2}}[-/.][0-9]{{4}}') THEN regexp_replace(t, '^([0-9]{{1,2}})[-/.]([0-9]{{4}})$', '\2-\1')
  WHEN regexp_full_match(l, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.,]? *''[0-9]{{2}}') THEN (CASE WHEN right(t, 2) >= '70' THEN '19' ELSE '20' END) || right(t, 2) || '-' || list_position({_MONTHS_SQL}, left(l, 3))
  WHEN regexp_full_match(t, '[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}') THEN right(t, 4) || '-' || CASE WHEN CAST(regexp_extract(t, '^[0-9]+') AS INT) <= 12 THEN regexp_extract(t, '^[0-9]+') ELSE regexp_extract(t, '^[0-9]+[-/.]([0-9]+)', 1) END END AS y FROM t),
m AS (SELECT *, CASE WHEN CAST(split_part(y, '-', 2) AS INT) BETWEEN 1 AND 12 THEN printf('%04d-%02d', CAST(split_part(y, '-', 1) AS INT), CAST(split_part(y, '-', 2) AS INT)) END AS ym FROM s)
SELECT entry_id, CASE WHEN coalesce(t, '') = '' OR l IN ('present','current','now','ongoing','till date','till now','to date','today','—','-') THEN NULL WHEN regexp_full_match(t, '[0-9]{{4}}') THEN t || '-01' ELSE coalesce(ym, t) END AS value,
  CASE WHEN coalesce(t, '') = '' THEN 'empty_input' WHEN l IN ('present','current','now','ongoing','till date','till now','to date','today','—','-') THEN 'present_marker' WHEN regexp_full_match(t, '[0-9]{{4}}') THEN 'year_only_defaulted_to_january' WHEN ym IS NOT NULL THEN 'dateutil_parse' ELSE 'unparseable_kept_as_is' END AS method FROM m""")
def normalize_date(spark, sf_dir):
    r = _spread(read(spark, sf_dir, "raw_experience"), ["entry_id"], N.normalize_date(F.col("start_date")))
    return r.select("entry_id", "value", "method")


@query()
def normalize_phone(spark, sf_dir):
    return _spread(read(spark, sf_dir, "recruiter"), ["row_id"], N.normalize_phone(F.col("phone")))


@query()
def normalize_country(spark, sf_dir):
    return _spread(read(spark, sf_dir, "recruiter"), ["row_id"], N.normalize_country(F.col("location"), N.country_table(spark)))


@query(rf"""WITH p AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(location, '[,/|]+'), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS a FROM recruiter)
SELECT row_id, CASE WHEN length(a[1]) < 50 THEN a[1] END AS city FROM p""")
def city_extract(spark, sf_dir):
    return read(spark, sf_dir, "recruiter").select("row_id", N.city_of(F.col("location")).alias("city"))


@query("SELECT raw_id, s AS original, CASE lower(trim(s)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(fixed.SKILLS.items())) + " END AS name FROM (SELECT raw_id, unnest(skills) AS s FROM raw_candidate) WHERE trim(s) <> ''")
def skill_exact(spark, sf_dir):
    s = read(spark, sf_dir, "raw_candidate").select("raw_id", F.explode("skills").alias("original")).filter("trim(original) <> ''")
    n = N.normalize_skill(F.col("original"))
    return s.select("raw_id", "original", F.when(n["success"], n["value"]).alias("name"))


@query()
def skill_fuzzy(spark, sf_dir):
    """The whole normalizer on the distinct spellings; Python sees each once."""
    from mergewell.functions.fuzzy import near_each

    s = read(spark, sf_dir, "raw_candidate").select(F.explode("skills").alias("original")).distinct()
    near = s.withColumn("near", F.get(near_each(F.array(F.lower(N.strip(F.col("original")))), tuple(fixed.SKILLS), 82.0), F.lit(0)))
    return _spread(near, ["original"], N.normalize_skill(F.col("original"), F.col("near")))


@query(r"""SELECT row_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(coalesce(skills, ''), '[,;|]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), 'string_agg', chr(1)) AS parts FROM recruiter""")
def skill_split(spark, sf_dir):
    s = C.split_skills(F.col("skills"))
    return read(spark, sf_dir, "recruiter").select("row_id", F.when(F.size(s) > 0, F.array_join(s, "\u0001")).alias("parts"))


@query("SELECT row_id, try_cast(nullif(regexp_extract(years_experience, '[0-9.]+', 0), '') AS DOUBLE) AS years FROM recruiter")
def years_parse(spark, sf_dir):
    return read(spark, sf_dir, "recruiter").select("row_id", N.first_number(F.col("years_experience")).alias("years"))


_CELLS = ("full_name", "email", "phone", "location", "linkedin_url", "headline", "skills", "years_experience")


@query("SELECT row_id, " + ", ".join(f"nullif(trim({c}, {_BLANK}), '') AS {c}" for c in _CELLS) + " FROM recruiter WHERE " + " OR ".join(f"coalesce(trim({c}, {_BLANK}), '') <> ''" for c in _CELLS))
def empty_row_filter(spark, sf_dir):
    df = read(spark, sf_dir, "recruiter")
    return df.filter(~C.is_empty_row([F.col(c) for c in _CELLS])).select("row_id", *(C.cell(F.col(c)).alias(c) for c in _CELLS))


@query("""WITH h AS (SELECT c_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(trim(c_name)))) AS h FROM customer)
SELECT c_name, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE h[17:17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
  WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS candidate_id FROM h""")
def candidate_uuid5(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_name", N.candidate_id(F.col("c_name")).alias("candidate_id"))


# --- résumé text ------------------------------------------------------------------------------------------------------


_WHOLE_EMAIL = rf"(?:^|[^\pL\pN_])({fixed.EMAIL})"


# A word with an accented letter, which addresses can't hold, ends in front of a sign: there the next place is where one can begin.
_ACCENTED_EMAIL = r"[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}][A-Za-z0-9_]*([.%+\-]" + fixed.EMAIL.replace("]+@", "]*@", 1) + ")"


@query(rf"""SELECT DISTINCT raw_id, unnest(list_concat(regexp_extract_all(raw_text, '{_ACCENTED_EMAIL}', 1), regexp_extract_all(regexp_replace(raw_text, '{_ACCENTED_EMAIL}', ' ', 'g'), '{_WHOLE_EMAIL}', 1))) AS email
FROM raw_candidate WHERE raw_text IS NOT NULL""")
def extract_emails(spark, sf_dir):
    return read(spark, sf_dir, "raw_candidate").select("raw_id", F.explode(R.find_emails(F.col("raw_text"))).alias("email"))


@query(rf"""WITH p AS (SELECT raw_id, unnest(regexp_extract_all(raw_text, '{fixed.PHONE}')) AS p FROM raw_candidate WHERE raw_text IS NOT NULL)
SELECT DISTINCT raw_id, trim(p, {_BLANK}) AS phone FROM p WHERE length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15""")
def extract_phones(spark, sf_dir):
    return read(spark, sf_dir, "raw_candidate").select("raw_id", F.explode(R.find_phones(F.col("raw_text"))).alias("phone"))


_WORD = r"[\pL\pN_\-]+"
_URL_SQL = fixed.URL.replace(r"[^\s<", r"[^\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}<")


@query(rf"""WITH t AS (SELECT 'd' || doc_id AS id, concat_ws(' ', text, url) AS t FROM documents UNION ALL SELECT 'r' || raw_id, concat_ws(' ', raw_text, array_to_string(links, ' ')) FROM raw_candidate),
u AS (
  SELECT id, unnest(regexp_extract_all(t, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/{_WORD}')) AS link FROM t
  UNION ALL SELECT id, unnest(regexp_extract_all(t, '(?i)(?:https?://)?(?:www\.)?github\.com/{_WORD}')) FROM t
  UNION ALL SELECT id, unnest(list_filter(regexp_extract_all(t, '(?i){_URL_SQL}'), lambda x: NOT contains(lower(x), 'linkedin') AND NOT contains(lower(x), 'github'))) FROM t)
SELECT DISTINCT id, link FROM u""")
def extract_urls(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat_ws(" ", "text", "url").alias("t"))
    r = read(spark, sf_dir, "raw_candidate").select(F.concat(F.lit("r"), F.col("raw_id").cast("string")), F.concat_ws(" ", "raw_text", F.array_join("links", " ")))
    return d.union(r).select("id", F.explode(R.find_links(F.col("t"))).alias("link"))


_HEADING = "CASE WHEN length(t) <= 60 AND NOT ends_with(t, '.') THEN CASE " + " ".join(f"WHEN regexp_full_match(t, '(?i)(?:{p})') THEN '{n}'" for n, p in fixed.HEADINGS) + " END END"
_LINES = rf"""
  split AS (SELECT raw_id, string_split_regex(raw_text, '\r\n|[\n\r\x{{000B}}\x{{000C}}\x{{0085}}\x{{2028}}\x{{2029}}]') AS a FROM raw_candidate WHERE raw_text IS NOT NULL),
  lines AS (SELECT raw_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM split),
  headed AS (SELECT *, {_HEADING} AS h FROM (SELECT *, trim(line, {_BLANK}) AS t FROM lines)),
  placed AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY raw_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'header') AS section,
    coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY raw_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'header') AS before FROM headed),
  opened AS (SELECT *, h IS NOT NULL AND h <> before AS opens, sum(CASE WHEN h <> before THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM placed)"""


@query(f"""WITH {_LINES}, newest AS (SELECT raw_id, section, max(g) AS g FROM opened GROUP BY ALL)
SELECT o.raw_id, o.section, coalesce(string_agg(o.line, chr(10) ORDER BY o.i) FILTER (WHERE NOT o.opens), '') AS text FROM opened o JOIN newest n ON o.raw_id = n.raw_id AND o.section = n.section AND o.g = n.g GROUP BY o.raw_id, o.section
UNION ALL SELECT raw_id, 'header', '' FROM opened WHERE i = 1 AND opens""")
def section_split(spark, sf_dir):
    m = read(spark, sf_dir, "raw_candidate").filter("raw_text is not null").select("raw_id", F.explode(R.sections(F.col("raw_text"))).alias("section", "lines"))
    return m.select("raw_id", "section", F.array_join("lines", "\n").alias("text"))


@query(f"WITH {_LINES} SELECT raw_id, " + ", ".join(f"count(*) FILTER (WHERE h = '{n}') > 0 AS has_{n}" for n, _ in fixed.HEADINGS) + ", any_value(line) FILTER (WHERE i = 1 AND NOT opens) AS first_line FROM opened GROUP BY raw_id")
def headings_found(spark, sf_dir):
    m = read(spark, sf_dir, "raw_candidate").filter("raw_text is not null").select("raw_id", R.sections(F.col("raw_text")).alias("m"))
    has = lambda k: F.coalesce(F.map_contains_key("m", k), F.lit(False)).alias(f"has_{k}")
    return m.select("raw_id", *(has(n) for n, _ in fixed.HEADINGS), F.get(F.try_element_at("m", F.lit("header")), F.lit(0)).alias("first_line"))


@query()
def resume_records(spark, sf_dir):
    t = read(spark, sf_dir, "raw_candidate").filter("raw_text is not null").select(F.col("raw_id").cast("string").alias("entity_id"), F.col("raw_id").alias("rec_seq"), "source_file", F.col("raw_text").alias("text"))
    return R.parse_resumes(t)


_WORD_YEARS = "CASE lower(word) " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(fixed.NUMBER_WORDS)) + " END"


@query(rf"""WITH t AS (
  SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'r' || raw_id, raw_text FROM raw_candidate UNION ALL SELECT 'p' || p_partkey, 'with over ' || (p_partkey % 30) || '+ years and ' || (p_partkey % 7) || ' years' FROM part
  UNION ALL SELECT 'n' || n_nationkey, 'nearly ' || ['five', 'Eleven', 'twenty', 'many'][n_nationkey % 4 + 1] || ' years of work' FROM nation),
f AS (SELECT id, regexp_extract(text, '(?i){fixed.YEARS}', 1) AS number, regexp_extract(text, '(?i){fixed.YEARS}', 2) AS word FROM t)
SELECT id, CASE WHEN number <> '' THEN try_cast(number AS DOUBLE) WHEN word <> '' THEN CAST({_WORD_YEARS} AS DOUBLE) END AS years FROM f""")
def years_from_prose(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), text("doc_id")).alias("id"), "text")
    r = read(spark, sf_dir, "raw_candidate").select(F.concat(F.lit("r"), text("raw_id")), "raw_text")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), text("p_partkey")), F.concat(F.lit("with over "), (F.col("p_partkey") % 30).cast("string"), F.lit("+ years and "), (F.col("p_partkey") % 7).cast("string"), F.lit(" years")))
    word = F.get(F.array(*map(F.lit, ("five", "Eleven", "twenty", "many"))), F.col("n_nationkey") % 4)
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("nearly "), word, F.lit(" years of work")))
    return d.union(r).union(p).union(n).select("id", R.years_in(F.col("text")).alias("years"))


# --- merge, projection, validation ------------------------------------------------------------------------------------


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_candidate as raw records; a profile address, else the record itself, is the entity."""
    c = read(spark, sf_dir, "raw_candidate")
    slug = F.array_min(F.filter(F.transform("links", lambda x: F.regexp_extract(F.lower(x), r"/in/([^/?#\s]+)", 1)), lambda s: s != ""))
    return M.as_raw(c.withColumns({"entity_id": F.coalesce(slug, F.concat(F.lit("raw-"), F.col("raw_id").cast("string"))), "rec_seq": F.col("raw_id")}))


def _merged(spark, sf_dir) -> DataFrame:
    return M.merge(raw_records(spark, sf_dir), ALL_RECORDS)


def _stable(m: DataFrame) -> DataFrame:
    """Random ids (of profiles without an address) made null, so that two evaluations agree."""
    return m.withColumn("candidate_id", F.when(F.size("emails") > 0, F.col("candidate_id")))


@query()
def merge_candidates(spark, sf_dir):
    m = _stable(_merged(spark, sf_dir))
    return m.select("entity_id", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "location.country_code", "location.city", "headline", "years_experience", F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"), F.col("overall_confidence").cast("double").alias("overall_confidence"), "duplicates_removed")


@query()
def provenance_long(spark, sf_dir):
    p = M.provenance(_merged(spark, sf_dir))
    return p.withColumn("confidence", F.col("confidence").cast("double"))


@query()
def merge_decisions(spark, sf_dir):
    return M.decision_log(_merged(spark, sf_dir)).select("entity_id", "field", "winner_source", "winner_value", "winner_priority", "agreed_sources", F.size("alternatives").alias("n_alternatives"), "reason")


@query()
def explanations(spark, sf_dir):
    x = M.explanation(_merged(spark, sf_dir))
    return x.select("entity_id", "field", "chosen_value", F.col("confidence").cast("double").alias("confidence"), "reason", "had_conflict", "source", "method", "notes")


@query()
def project_omit(spark, sf_dir):
    config = ProjectionConfig(fields={"full_name": FieldConfig(rename="name"), "candidate_id": FieldConfig(include=False), "years_experience": FieldConfig(rename="experience_years")}, include_confidence=True, missing_value_policy="omit")
    return project_json(_merged(spark, sf_dir), config)


# Events as raw records of five sources, all of whose fields SQL can normalize, too: the merge itself is compared.
_SOURCES = {"signup": "manual", "purchase": "recruiter_csv", "click": "resume_pdf", "view": "recruiter_notes", "error": "ats_json"}
_SOURCE_ROWS = ", ".join(f"('{k}', '{s}', {fixed.SOURCES[s][0]}, CAST({fixed.SOURCES[s][1]} AS DECIMAL(3,2)))" for k, s in _SOURCES.items())
_EVENT_MERGE = f"""
  e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, d.source, d.priority, d.reliability FROM events JOIN (VALUES {_SOURCE_ROWS}) AS d(event_type, source, priority, reliability) ON d.event_type = events.event_type),
  scalars AS (
    SELECT e.*, 'full_name' AS field, 'Ann K' || (k % 3) AS v, CAST(CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 1 END AS DECIMAL(4,3)) AS factor, CASE WHEN event_id % 2 = 0 THEN 'normalized_case' ELSE 'already_proper_case' END AS method FROM e WHERE k IS NOT NULL
    UNION ALL SELECT e.*, 'headline', 'Role ' || (k % 4), CAST(1 AS DECIMAL(4,3)), 'direct_string' FROM e WHERE k % 5 <> 0
    UNION ALL SELECT e.*, 'years_experience', CAST(CAST(event_id % 12 AS DOUBLE) AS VARCHAR), CAST(0.85 AS DECIMAL(4,3)), 'summary_regex_extraction' FROM e),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY priority, event_id) AS r FROM scalars),
  counted AS (SELECT x.user_id, x.field, count(*) FILTER (WHERE lower(x.v) = lower(y.v)) AS agreed, count(*) AS n, count(DISTINCT lower(x.v)) AS n_values
    FROM ranked x JOIN ranked y ON x.user_id = y.user_id AND x.field = y.field AND y.r = 1 GROUP BY 1, 2),
  chosen AS (SELECT w.*, o.agreed, o.n, o.n_values FROM ranked w JOIN counted o ON w.user_id = o.user_id AND w.field = o.field WHERE w.r = 1),
  members AS (
    SELECT e.*, 'emails' AS field, 0 AS pos, 'user' || (k % 7) || '@x.test' AS v, CAST(1 AS DECIMAL(4,3)) AS factor, 'lowercased' AS method, CAST(NULL AS VARCHAR) AS notes FROM e WHERE k IS NOT NULL
    UNION ALL SELECT e.*, 'skills', 0, CASE WHEN k % 2 = 0 THEN 'Python' ELSE 'JavaScript' END, CAST(1 AS DECIMAL(4,3)), 'exact_synonym_match', NULL FROM e WHERE k IS NOT NULL
    UNION ALL SELECT e.*, 'skills', 1, 'Made Up' || (k % 2), CAST(0.6 AS DECIMAL(4,3)), 'unknown_skill_kept_as_is', 'Skill ''made up' || (k % 2) || ''' not in synonym dictionary; kept as ''Made Up' || (k % 2) || '''' FROM e WHERE k IS NOT NULL),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id, field, v ORDER BY priority, event_id, pos) AS again FROM members),
  kept AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY priority, event_id, pos) AS r FROM firsts WHERE again = 1),
  lists AS (SELECT user_id, field, count(*) - count(DISTINCT v) AS repeats FROM members GROUP BY 1, 2),
  parts AS (
    SELECT user_id, field, source, reliability, factor, method, agreed, n_values > 1 AS had_conflict FROM chosen
    UNION ALL SELECT k.user_id, k.field, k.source, k.reliability, k.factor, k.method, l.repeats + 1, false FROM kept k JOIN lists l ON k.user_id = l.user_id AND k.field = l.field WHERE k.r = 1),
  bonuses AS (SELECT *, CAST(least(1 + (agreed - 1) * 0.05, 1.2) AS DECIMAL(8,4)) AS bonus FROM parts),
  scores AS (SELECT *, CAST(round(least(CAST(reliability * factor * bonus AS DECIMAL(20,9)), CAST(1 AS DECIMAL(20,9))), 4) AS DECIMAL(6,4)) AS score,
    CAST(CASE field WHEN 'full_name' THEN 1.5 WHEN 'emails' THEN 1.5 WHEN 'headline' THEN 0.8 WHEN 'skills' THEN 1.2 ELSE 1.0 END AS DECIMAL(3,1)) AS w FROM bonuses),
  texts AS (SELECT w.user_id, w.field, string_agg('''' || o.source || ''' → ''' || o.v || '''', '; ' ORDER BY o.r) FILTER (WHERE o.r > 1) AS losers, string_agg(o.source || '|' || o.v || '|' || o.factor, '; ' ORDER BY o.r) FILTER (WHERE o.r > 1) AS alternatives
    FROM chosen w JOIN ranked o ON w.user_id = o.user_id AND w.field = o.field GROUP BY 1, 2)"""
_CLASH = "'Conflict detected across ' || c.n || ' sources. Chose ''' || c.v || ''' from ''' || c.source || ''' (priority=' || c.priority || '). Discarded: ' || t.losers || '. Priority order is deterministic per SOURCE_PRIORITY config.'"


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as raw records: a user is an entity, the type tells the source."""
    text = lambda c: c.cast("string")
    k, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    source = F.create_map(*(F.lit(x) for kv in _SOURCES.items() for x in kv))
    return read(spark, sf_dir, "events").filter(F.col("event_type").isin(*_SOURCES)).select(
        text(F.col("user_id")).alias("entity_id"), i.alias("rec_seq"), F.try_element_at(source, F.col("event_type")).alias("source"),
        F.concat(F.when(i % 2 == 0, "ann k").otherwise("Ann K"), text(k % 3)).alias("full_name"), F.when(k % 5 != 0, F.concat(F.lit(" Role "), text(k % 4))).alias("headline"),
        F.array(F.concat(F.lit("User"), text(k % 7), F.lit("@X.test")), F.lit("no address")).alias("emails"), text(i % 12).alias("years_experience"),
        F.when(k.isNotNull(), F.array(F.when(k % 2 == 0, "PYTHON").otherwise("js"), F.concat(F.lit("made up"), text(k % 2)))).alias("skills"),
    )


def _merged_events(spark, sf_dir) -> DataFrame:
    return M.merge(event_records(spark, sf_dir), ALL_RECORDS, fuzzy=False)


@query(f"""WITH {_EVENT_MERGE},
  mails AS (SELECT user_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(v)) AS h FROM kept WHERE field = 'emails' AND r = 1),
  ids AS (SELECT user_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS candidate_id FROM mails),
  won AS (SELECT user_id, max(v) FILTER (WHERE field = 'full_name') AS full_name, max(v) FILTER (WHERE field = 'headline') AS headline, CAST(max(v) FILTER (WHERE field = 'years_experience') AS DOUBLE) AS years_experience, count(*) FILTER (WHERE n_values > 1) AS conflicts_resolved FROM chosen GROUP BY 1),
  had AS (SELECT user_id, string_agg(v, ',' ORDER BY r) FILTER (WHERE field = 'emails') AS emails, string_agg(v, ',' ORDER BY r) FILTER (WHERE field = 'skills') AS skills FROM kept GROUP BY 1),
  again AS (SELECT user_id, CAST(sum(repeats) AS BIGINT) AS duplicates_removed FROM lists GROUP BY 1),
  total AS (SELECT user_id, CAST(sum(score * w) * 100000 AS BIGINT) AS a, CAST(sum(w) * 10 AS BIGINT) AS b FROM scores WHERE score > 0 GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS entity_id, candidate_id, full_name, headline, years_experience, emails, skills, ((2 * a + b) // (2 * b)) / 10000.0 AS overall_confidence, duplicates_removed, conflicts_resolved
FROM won JOIN had USING (user_id) JOIN ids USING (user_id) JOIN again USING (user_id) JOIN total USING (user_id)""")
def merged_profiles(spark, sf_dir):
    m = metrics(_merged_events(spark, sf_dir), None, "candidate_id", "full_name", "headline", "years_experience", "emails", "skills")
    return m.select(
        "entity_id", "candidate_id", "full_name", "headline", "years_experience", F.array_join("emails", ",").alias("emails"), F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"),
        F.col("overall_confidence").cast("double").alias("overall_confidence"), F.col("duplicates_removed").cast("long").alias("duplicates_removed"), F.col("conflicts_resolved").cast("long").alias("conflicts_resolved"),
    )


@query(f"""WITH {_EVENT_MERGE} SELECT CAST(c.user_id AS VARCHAR) AS entity_id, c.field, c.source AS winner_source, c.v AS winner_value, c.priority AS winner_priority, c.agreed AS agreed_sources, t.alternatives, {_CLASH} AS reason
FROM chosen c JOIN texts t ON c.user_id = t.user_id AND c.field = t.field WHERE c.n_values > 1""")
def merged_decisions(spark, sf_dir):
    others = F.array_join(F.transform("alternatives", lambda x: F.concat_ws("|", x["source"], x["value"], x["factor"].cast("string"))), "; ")
    return M.decision_log(_merged_events(spark, sf_dir)).select("entity_id", "field", "winner_source", "winner_value", "winner_priority", "agreed_sources", others.alias("alternatives"), "reason")


@query(f"""WITH {_EVENT_MERGE} SELECT CAST(user_id AS VARCHAR) AS entity_id, field, r - 1 AS rank, source, v AS value, method, CAST(factor AS DOUBLE) AS confidence, NULL AS notes FROM ranked
UNION ALL SELECT CAST(user_id AS VARCHAR), field, r - 1, source, v, method, CAST(factor AS DOUBLE), notes FROM kept""")
def merged_provenance(spark, sf_dir):
    return M.provenance(_merged_events(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH {_EVENT_MERGE}, why AS (SELECT *, 'field=''' || field || ''' | score=' || CAST(CAST(score AS DOUBLE) AS VARCHAR) || ' = reliability(' || printf('%.2f', CAST(reliability AS DOUBLE)) || ') × norm_factor(' || printf('%.2f', CAST(factor AS DOUBLE))
  || ') × corroboration(' || printf('%.2f', CAST(bonus AS DOUBLE)) || ') | source=''' || source || ''' | method=''' || method || ''' | ' || CASE WHEN agreed > 1 THEN agreed || ' source(s) agree → bonus=' || printf('%.2f', CAST(bonus AS DOUBLE)) ELSE 'single source, no corroboration bonus' END AS text FROM scores)
SELECT CAST(y.user_id AS VARCHAR) AS entity_id, y.field, CAST(y.score AS DOUBLE) AS confidence, CASE WHEN y.had_conflict THEN {_CLASH} ELSE y.text END AS reason, y.had_conflict, y.source, y.method
FROM why y LEFT JOIN chosen c ON c.user_id = y.user_id AND c.field = y.field LEFT JOIN texts t ON t.user_id = y.user_id AND t.field = y.field""")
def confidence_explanation(spark, sf_dir):
    x = M.explanation(_merged_events(spark, sf_dir)).filter("confidence is not null")
    return x.select("entity_id", "field", F.col("confidence").cast("double").alias("confidence"), "reason", "had_conflict", "source", "method")


@query("""SELECT c_name AS candidate_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS name, CASE WHEN c_acctbal >= 0 THEN c_name END AS emails, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS experience_years FROM customer""")
def project_rename_null(spark, sf_dir):
    c, none = read(spark, sf_dir, "customer"), F.array().cast("array<string>")
    profile = {f: none.alias(f) for f in fixed.FIELDS} | {
        "candidate_id": F.col("c_name").alias("candidate_id"), "full_name": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("full_name"),
        "emails": F.when(F.col("c_acctbal") >= 0, F.array("c_name")).otherwise(none).alias("emails"), "years_experience": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("years_experience"),
    }
    renamed = {"full_name": "name", "years_experience": "experience_years"}
    config = ProjectionConfig(fields={f: FieldConfig(include=f in ("candidate_id", "full_name", "emails", "years_experience"), rename=renamed.get(f)) for f in fixed.FIELDS})
    return project(c.select(*profile.values()), config).withColumn("emails", F.array_join("emails", ","))


@query(rf"""WITH v AS (SELECT raw_id, list_concat(
  list_transform(list_filter(emails, lambda x: NOT contains(x, '@')), lambda x: 'emails: Suspicious email value: ''' || x || ''''),
  list_transform(list_filter(phones, lambda x: NOT regexp_matches(x, '{E164}')), lambda x: 'phones: Phone ''' || x || ''' does not appear to be in E.164 format.')) AS f FROM raw_candidate)
SELECT raw_id, CAST(len(f) AS INT) AS warning_count, '[VALID] 0 error(s), ' || len(f) || ' warning(s)' AS summary, coalesce(list_aggregate(f, 'string_agg', '; '), '') AS messages FROM v""")
def validate_rows(spark, sf_dir):
    df = read(spark, sf_dir, "raw_candidate").select("raw_id", "emails", "phones").withColumn("candidate_id", F.lit("09c12063-be5e-5676-b66f-44d8a488433f"))
    v = validate(df)
    return v.select("raw_id", "warning_count", "summary", F.array_join(F.transform("findings", lambda f: F.concat(f["field"], F.lit(": "), f["message"])), "; ").alias("messages"))


@query(rf"SELECT regexp_matches(c_name, '{UUID}') AS is_uuid, count(*) AS n FROM customer GROUP BY 1")
def uuid_check(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(F.col("c_name").rlike(UUID).alias("is_uuid")).agg(F.count(F.lit(1)).alias("n"))


@query()
def validation_summary(spark, sf_dir):
    return validate(_merged(spark, sf_dir)).groupBy("is_valid", "summary").agg(F.count(F.lit(1)).alias("n"))


@query()
def merge_metrics(spark, sf_dir):
    m = metrics(_merged(spark, sf_dir))
    return m.select("entity_id", "records_processed", F.array_join("sources_used", ",").alias("sources_used"), "conflicts_resolved", "duplicates_removed", "invalid_fields", "normalized_skills", "warning_count", F.col("overall_confidence").cast("double").alias("overall_confidence"), "output_fields", "validation_summary")


@query()
def report_html(spark, sf_dir):
    return merge_all(raw_records(spark, sf_dir), ALL_RECORDS).report
