import random
import time

import pytest
from pyspark.sql import Window, functions as F

from mergewell import fixed
from mergewell.functions import normal as N
from mergewell.operators import long_form as L, merge as M
from mergewell.operators.projection import FieldConfig, ProjectionConfig, project, project_json
from mergewell.operators.validation import metrics, validate, validate_json
from mergewell.settings import Settings

S = Settings(now="2026-07-01T00:00:00")
SCHEMA = ", ".join(f"{k} {v}" for k, v in M.RAW.items())
CSV = dict(entity_id="a", rec_seq=1, source="recruiter_csv", full_name="ilse korvandahl", emails=["Ilse.Korvandahl@Mailbay.COM", "ilse@otherbay.com"], phones=["+91-90123-45678"], location="Bangalore, India",
           links=["linkedin.com/in/ilsekorvandahl"], headline="Lead Platform Planner", years_experience="6.0", skills=["Rust", "apache kafka", "redis", "etl"])
PDF = dict(entity_id="a", rec_seq=2, source="resume_pdf", full_name="Ilse Korvandahl", emails=["ilse.korvandahl@mailbay.com"], phones=["+91-90123-45678"], location="Bangalore, IN", years_experience="6",
           skills=["Rust", "kafka", "Pandas", "Terraform"], experience=[("Platform Planner", "Torwander Works", "Jan 2020", "Present", True, None, None)], education=[("Westrau Institute", "M.Sc", "Hydrology", None, "2018", None)])
OTHER = dict(entity_id="c", rec_seq=2, source="resume_pdf", full_name="I. Korvandahl", emails=["ilse.korvandahl@mailbay.com"], phones=["+91-90123-45678"], location="Mumbai, India")


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in M.RAW) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def merged(spark):
    rows = [CSV, PDF, dict(CSV, entity_id="b"), dict(CSV, entity_id="c"), OTHER, dict(entity_id="z", rec_seq=1, source="github")]
    return M.merge(frame(spark, *rows), S).cache()


def test_golden_profiles(merged):
    r = {x.entity_id: x for x in merged.collect()}
    assert r["b"].candidate_id == "d40bd9c9-4360-503e-b104-071bcce5c6a5"
    assert (float(r["b"].overall_confidence), float(r["a"].overall_confidence)) == (0.9329, 0.9509)
    assert r["a"].duplicates_removed == 4 and r["a"].years_experience == 6.0
    assert [s.name for s in r["b"].skills] == ["Rust", "Apache Kafka", "Redis", "ETL"]
    assert r["b"].emails == ["ilse.korvandahl@mailbay.com", "ilse@otherbay.com"] and r["b"].phones == ["+919012345678"]
    assert (r["a"].experience[0].start_date, r["a"].experience[0].end_date, r["a"].experience[0].is_current) == ("2020-01", None, True)
    assert r["a"].education[0].institution == "Westrau Institute"
    assert (r["c"].location.city, r["c"].location.raw, r["c"].location.country_code) == ("Mumbai", "Bangalore, India", "IN")
    assert r["z"].full_name is None and float(r["z"].overall_confidence) == 0 and r["z"].emails == []


def test_audit(merged):
    log = M.decision_log(merged).collect()
    assert [(x.entity_id, x.field, x.winner_value, x.alternatives[0].value) for x in log] == [("c", "full_name", "Ilse Korvandahl", "I. Korvandahl")]
    assert log[0].reason == (
        "Conflict detected across 2 sources. Chose 'Ilse Korvandahl' from 'recruiter_csv' (priority=1). Discarded: 'resume_pdf' → 'I. Korvandahl'. Priority order is deterministic per SOURCE_PRIORITY config."
    )
    e = {(x.entity_id, x.field): x for x in M.explanation(merged).collect()}
    assert e[("b", "years_experience")].reason == "field='years_experience' | score=0.85 = reliability(1.00) × norm_factor(0.85) × corroboration(1.00) | source='recruiter_csv' | method='summary_regex_extraction' | single source, no corroboration bonus"
    assert e[("z", "headline")].reason == "Field not present in any source."
    p = M.provenance(merged).filter("entity_id = 'c' and field = 'full_name'").orderBy("rank").collect()
    assert [(x.source, x.value) for x in p] == [("recruiter_csv", "Ilse Korvandahl"), ("resume_pdf", "I. Korvandahl")]
    m = {x.entity_id: x for x in metrics(merged).collect()}
    assert (m["c"].conflicts_resolved, m["a"].duplicates_removed, m["a"].records_processed) == (1, 4, 2)


def test_derived_years(spark):
    jobs = [("x", "y", "2022", None, False, None, None), ("x", "z", "2019", "2021", False, None, None), ("x", "w", "2017", "2019", False, None, None), ("x", "q", "Marketing 2020", "Present", True, None, None)]
    r = M.merge(frame(spark, dict(entity_id="a", rec_seq=1, source="resume_pdf", experience=jobs, years_experience="3")), S).first()
    assert r.years_experience == 8.0 and "conflicts" in r.warnings[0]


def model(records):
    """The merge of scalars and lists written out plainly, for comparison."""
    out = {}
    by = {}
    for r in sorted(records, key=lambda r: (fixed.SOURCES.get(r["source"], (99,))[0], r["source"], r["rec_seq"])):
        by.setdefault(r["entity_id"], {}).setdefault(r["source"], r)
    for e, sources in by.items():
        rows = list(sources.values())
        heads = [(r["source"], r["headline"].strip()) for r in rows if r.get("headline")]
        seen, repeats = [], 0
        for r in rows:
            for x in r.get("emails") or []:
                x = x.strip().lower()
                if x.count("@") == 1 and x.endswith(".com"):
                    if x in seen:
                        repeats += 1
                    else:
                        seen.append(x)
        agreed = sum(h.lower() == heads[0][1].lower() for _, h in heads) if heads else 0
        out[e] = (heads[0][1] if heads else None, heads[0][0] if heads else None, agreed, seen, repeats)
    return out


def test_random_groups_against_a_plain_model_in_any_order(spark):
    r = random.Random(11)
    rows = []
    for i in range(300):
        rows.append(dict(entity_id=f"e{r.randint(0, 40)}", rec_seq=i, source=r.choice([*fixed.SOURCES, "unheard_of"]), headline=r.choice([None, "Dev", "dev ", "Ops", " QA"]), emails=r.choices(["a@x.com", "A@X.com", "b@x.com", "bad", "c@@x.com", ""], k=r.randint(0, 4))))
    want = model(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        m = M.merge(frame(spark, *rows).repartition(seed + 2), Settings(now=S.now, records_per_source=1), fuzzy=False)
        got = {x.entity_id: (x.headline, x.d_headline and x.d_headline.source, x.d_headline.agreed if x.d_headline else 0, x.emails, x.d_emails.repeats) for x in m.collect()}
        assert got == want


def test_edges(spark):
    df = frame(spark, dict(entity_id=None, rec_seq=1, source="manual", full_name="x"), dict(entity_id="a", rec_seq=1, source=None, full_name=" ", emails=[None, ""], skills=["", None])).withColumn("priority", F.lit("clash"))
    r = M.merge(df, S).collect()
    assert len(r) == 1 and r[0].full_name is None and r[0].skills == []
    assert M.merge(df.limit(0), S).count() == 0


def test_one_shuffle_on_the_entity(merged, spark):
    plan = M.merge_entities(M.normalize_records(frame(spark, CSV), S), S)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_projection(merged):
    config = ProjectionConfig.from_dict({"fields": {"full_name": {"rename": "name"}, "created_at": {"include": False}}, "missing_value_policy": "omit", "include_confidence": True, "include_provenance": True, "_comment": 1})
    import json

    rows = {r.entity_id: json.loads(r.candidate) for r in project_json(merged, config).collect()}
    assert rows["a"]["name"] == "Ilse Korvandahl" and "created_at" not in rows["a"] and "headline" not in rows["z"]
    assert rows["a"]["_confidence"]["name"]["score"] == 0.945 and rows["c"]["_provenance"]["name"][1]["value"] == "I. Korvandahl"
    assert rows["a"]["education"][0]["start_date"] is None  # nested nulls stay
    full = {r.entity_id: json.loads(r.candidate) for r in project_json(merged).collect()}
    assert list(full["z"]) == list(fixed.FIELDS) and full["z"]["emails"] is None
    assert project(merged, config).columns[1] == "name"
    with pytest.raises(Exception, match="is required but has no value"):
        project(merged, ProjectionConfig(missing_value_policy="error")).collect()
    with pytest.raises(ValueError):
        ProjectionConfig(fields={"full_name": FieldConfig(rename="emails")})
    with pytest.raises(ValueError):
        ProjectionConfig(missing_value_policy="maybe")


def test_config_files(tmp_path):
    p = tmp_path / "c.json"
    with pytest.raises(FileNotFoundError):
        ProjectionConfig.from_file(str(p))
    p.write_text("{")
    with pytest.raises(ValueError, match="Invalid JSON"):
        ProjectionConfig.from_file(str(p))
    p.write_text('{"fields": {"headline": {"include": false}}}')
    c = ProjectionConfig.from_file(str(p))
    assert not c.is_included("headline") and c.is_included("emails") and c.output_key_for("emails") == "emails"


def test_validation(merged, spark):
    v = {x.entity_id: x for x in validate(merged).collect()}
    assert v["a"].is_valid and v["a"].summary == "[VALID] 0 error(s), 0 warning(s)"
    cases = {"{}": (1, 0), '{"candidate_id":"x","phones":["not-e164"],"years_experience":"six","_confidence":{"full_name":{"score":1.5}}}': (2, 2), '{"candidate_id":5,"emails":"a","location":[],"overall_confidence":2}': (4, 0),
             '{"candidate_id":"09c12063-be5e-5676-b66f-44d8a488433f","emails":["a@b.c"],"years_experience":80}': (0, 1), "not json": (1, 0)}
    got = {r.candidate: (r.error_count, r.warning_count) for r in validate_json(spark.createDataFrame([(c,) for c in cases], "candidate string")).collect()}
    assert got == cases


def test_long_form_equals_plain_sums(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 5), r.choice(["x", "X ", "y", None]), r.randint(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "e int, v string, p int, i int")
    got = {x.e: (x.value, x.agreed, x.had_conflict) for x in L.resolve(df, ["e"], F.col("v"), F.lower(F.trim("v")), [F.col("p"), F.col("i")], {}).collect()}
    for e in range(6):
        own = sorted((p, i, v) for a, v, p, i in rows if a == e and v is not None)
        keys = [v.strip().lower() for _, _, v in own]
        assert got[e] == (own[0][2], keys.count(keys[0]), len(set(keys)) > 1)


def test_later_records_of_a_source_count(spark):
    later = dict(entity_id="a", rec_seq=9, source="recruiter_csv", full_name="Ilse K", emails=["late@otherbay.com", "ilse@otherbay.com"])
    r = M.merge(frame(spark, CSV, later), S, fuzzy=False).select("emails", "full_name", "duplicates_removed", "d_full_name.had_conflict").first()
    assert tuple(r) == (["ilse.korvandahl@mailbay.com", "ilse@otherbay.com", "late@otherbay.com"], "Ilse Korvandahl", 1, True)


def test_places_are_those_of_the_merge(spark):
    rng = random.Random(4)
    towns = ["Bangalore, India", "Pune, IN", "Lyon, France", "nowhere", None, "", "Bern", ", India", "Turin / France"]
    rows = [dict(entity_id=rng.choice("abcdef"), rec_seq=rng.choice([None, 1, 2, 3, i]), source=rng.choice(["recruiter_csv", "resume_pdf", "github", None]), location=rng.choice(towns)) for i in range(90)]
    rows += [dict(entity_id="none", rec_seq=1, source="github", location="nowhere"), dict(entity_id=None, rec_seq=1, source="github", location="Pune, IN")]
    raw = frame(spark, *rows)
    own = L.places(M.normalize_records(M.first_records(M.as_raw(raw), None), S, fuzzy=False)).collect()
    whole = M.merge(raw, S, fuzzy=False).filter("location is not null").select("entity_id", "location.country_code", "location.city", "location.raw").collect()
    assert len(whole) == 6 and sorted(own, key=repr) == sorted(whole, key=repr)


def test_deciding_costs_what_the_records_of_an_entity_do(spark):
    # Keys made anew for each key took over 100 times as long.
    def took(n):
        df = spark.range(n).select(F.collect_list(F.struct(F.lit("github").alias("source"), F.lit(1).alias("priority"), F.lit("0.75").cast("decimal(3,2)").alias("reliability"), N.result(F.concat(F.lit("Name "), (F.col("id") % 9).cast("string")), True, "1", F.lit("m"), F.lit("x")).alias("full_name"))).over(Window.partitionBy(F.lit(1))).alias("r")).limit(1)
        began = time.time()
        d = df.select(M.resolve("full_name", F.col("r"), S).alias("d")).select("d.agreed", "d.had_conflict", F.size("d.candidates").alias("n")).first()
        assert (d.agreed, d.had_conflict, d.n) == (-(-n // 9), True, n)
        return time.time() - began

    took(9)
    assert took(5400) < 20
