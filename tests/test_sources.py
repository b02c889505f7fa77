import glob
import json
import os

import pytest

from mergewell.cli import main, parse_args
from mergewell.operators.merge import RAW
from mergewell.plans.pipeline import Pipeline, PipelineInput, merge_all, write_tables
from mergewell.report import colour, render
from mergewell.settings import Settings
from mergewell.sources import resume
from mergewell.sources.recruiter_csv import RecruiterCsv, resolve_headers
from mergewell.sources.registry import REGISTRY, Registry
from mergewell.streaming.incremental import current_profiles, merge_stream

SCHEMA = ", ".join(f"{k} {v}" for k, v in RAW.items())


def rows(spark, path):
    return RecruiterCsv().extract(spark, str(path)).orderBy("rec_seq").collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "r.CSV"
    p.write_bytes('full_name,email,Name,skills,exp\n"A ""x"" B",a@b.co,zz,"a;b|c","5+"\n , ,,,\n"multi\nline",q@r.st,,"x",10-12,extra\nJosé,,,,\n'.encode("latin-1"))
    got = rows(spark, p)
    assert [(r.full_name, r.emails, r.skills, r.years_experience) for r in got] == [('A "x" B', ["a@b.co"], ["a", "b", "c"], "5.0"), ("multi\nline", ["q@r.st"], ["x"], "10.0"), ("José", [], [], None)]
    p.write_bytes(b"")
    assert rows(spark, p) == []
    p.write_bytes("﻿name,email\nA B,x@y.zz\n".encode())
    assert rows(spark, p)[0].full_name == "A B"
    p.write_text("foo,bar\n1,2\n")
    assert rows(spark, p)[0].full_name is None
    with pytest.raises(FileNotFoundError):
        RecruiterCsv().extract(spark, str(tmp_path / "none.csv"))


def test_headers():
    assert resolve_headers(["Title", " E-Mail ", "name", "full_name", "x", "City"]) == {"headline": 0, "email": 1, "full_name": 2, "location": 5}


def test_registry():
    r = Registry()

    @r.register
    class One:
        source_type = "one"

        def can_handle(self, path):
            return path.endswith(".one")

    assert r.get("one") is One and isinstance(r.instantiate("one"), One) and r.detect("a.one") and r.detect("a.two") is None
    with pytest.raises(KeyError, match="one"):
        r.get("two")
    with pytest.raises(AttributeError):
        r.register(type("Two", (), {}))
    r.register(One)
    assert r.replaced == ["one"] and list(r.all_registered()) == ["one"]
    r.clear()
    assert r.all_registered() == {}
    assert isinstance(REGISTRY.detect("x/Y.CSV"), RecruiterCsv) and REGISTRY.detect("cv.PDF").source_type == "resume_pdf"


TEXT = "Senior Software Engineer\nProfessional Summary\nHas over eight years of experience.\nExperience\nGoogle\n2022–Present\nGoogle\n2019–2021\nAmazon\n2017–2019\nEducation\nIIT Bombay, B.Tech 2014 - 2018"


def test_resume_text(spark):
    df = spark.createDataFrame([("a", "Jane Doe\njane.doe@example.com\n+1 (415) 555-0100\nSkills\nPython, React, SQL, R\nlinkedin.com/in/jane https://a.b/c"), ("b", TEXT), ("c", ""), ("d", None), ("e", "Skills\nA1\nSummary\nlong enough\nSkills\nB2"), ("f", "x" * 300_000)], "entity_id string, text string")
    r = {x.entity_id: x for x in resume.parse_resumes(df).collect()}
    assert set(r) == {"a", "b", "e", "f"}
    assert (r["a"].full_name, r["a"].emails, r["a"].phones, r["a"].skills[:3]) == ("Jane Doe", ["jane.doe@example.com"], ["+1 (415) 555-0100"], ["Python", "React", "SQL"])
    assert r["a"].links == ["linkedin.com/in/jane", "https://a.b/c"]
    assert (r["b"].full_name, r["b"].headline, r["b"].years_experience) == ("Senior Software Engineer", "Has over eight years of experience.", "8.0")
    assert [(e.title, e.start_date, e.end_date, e.is_current) for e in r["b"].experience][1:3] == [("Google", "2022", None, True), ("Amazon", "2019", "2021", False)]
    assert (r["b"].education[0].institution, r["b"].education[0].degree) == ("IIT Bombay", "B.Tech")
    assert r["e"].skills == ["B2"]  # a section that is opened again replaces the earlier one


def test_pdf_hook(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Jane Doe\nSkills\nPython")
    (tmp_path / "b.pdf").write_bytes(b"")
    got = resume.ResumePdf(lambda b: b.decode()).extract(spark, str(tmp_path / "*.pdf")).collect()
    assert [(r.source_file, r.full_name) for r in got] == [("a.pdf", "Jane Doe")]


def test_pipeline(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text('full_name,email,phone,location,linkedin_url,headline,skills,years_experience\n"mira oststein",Mira@x.com,+91-90123-45678,"Bangalore, India",linkedin.com/in/p,Senior <Data>,"python, react","5+"\nother,,,,,,,\n')
    seen = []
    out = Pipeline(spark, Settings(now="2026-01-01")).run(PipelineInput(csv_path=str(csv), resume_path=str(tmp_path / "no.pdf"), output_dir=str(tmp_path / "out")), lambda m, p: seen.append(p))
    assert out.is_valid and any("resume_pdf" in w for w in out.warnings) and seen == [5, 15, 40, 55, 65, 75, 85, 100]
    assert sorted(os.listdir(tmp_path / "out")) == ["candidate.json", "decision_log.json", "explanation.json", "metrics.json", "report.html"]
    c = json.loads((tmp_path / "out/candidate.json").read_text())
    assert (c["full_name"], c["overall_confidence"]) == ("Mira Oststein", 0.9329)
    page = (tmp_path / "out/report.html").read_text()
    assert "Senior &lt;Data&gt;" in page and "93.3%" in page
    with pytest.raises(ValueError):
        Pipeline(spark).run(PipelineInput())
    with pytest.raises(SystemExit):
        parse_args([])
    with pytest.raises(SystemExit):
        parse_args(["--csv", str(tmp_path / "none.csv")])
    # What is checked is the projected object: one without the id isn't valid.
    config = tmp_path / "c.json"
    config.write_text('{"fields": {"candidate_id": {"include": false}}}')
    out = Pipeline(spark, Settings(now="2026-01-01")).run(PipelineInput(csv_path=str(csv), config_path=str(config)))
    assert not out.is_valid and [(r.invalid_fields, r.validation_summary[:9]) for r in out.metrics.collect()] == [(1, "[INVALID]")]
    paths = write_tables(merge_all(spark.createDataFrame([], SCHEMA)), str(tmp_path / "tables"))
    assert set(paths) == {"candidate", "explanation", "metrics", "decision_log", "report"}


def test_command_line(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text("name\nA B\n")
    config = tmp_path / "c.json"
    config.write_text('{"missing_value_policy": "error"}')
    assert main(["--csv", str(csv), "--config", str(config), "--output-dir", str(tmp_path / "o"), "--quiet"]) == 1


def test_report():
    assert [colour(x) for x in (0.9, 0.7, 0.1)] == ["green", "orange", "crimson"]
    page = render({"full_name": "<A>", "experience": [{"title": "t", "description": "&" * 200}]}, [], {})
    assert "&lt;A&gt;" in page and page.count("&amp;") == 180 and "Skills" not in page and "Contact" in page


def test_stream(spark, tmp_path):
    def put(k, *records):
        spark.createDataFrame([tuple(r.get(c) for c in RAW) for r in records], SCHEMA).write.parquet(f"{tmp_path}/in/{k}")

    def drain():
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        merge_stream(s, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()

    put(1, dict(entity_id="a", rec_seq=1, source="recruiter_csv", full_name="A B", emails=["a@b.co"]), dict(entity_id="b", rec_seq=1, source="linkedin", full_name="C D"))
    drain()
    put(2, dict(entity_id="b", rec_seq=1, source="manual", full_name="Cee D"))
    drain()
    got = {r.entity_id: (r.full_name, r.sources_used) for r in current_profiles(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": ("A B", ["recruiter_csv"]), "b": ("Cee D", ["manual", "linkedin"])}
    # State that is there but can't be read stops the query: no record is lost silently.
    for part in glob.glob(f"{tmp_path}/state/batch=1/bucket=*/*.parquet"):
        with open(part, "wb") as f:
            f.write(b"broken")
    put(3, dict(entity_id="b", rec_seq=2, source="manual", full_name="D"))
    with pytest.raises(Exception):
        drain()
