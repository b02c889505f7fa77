"""The whole run: extract, merge, project, validate, write."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from mergewell.operators import merge as M
from mergewell.operators.projection import ProjectionConfig, as_json, json_value
from mergewell.operators.validation import metrics, validate_json
from mergewell.report import render_each
from mergewell.runtime import cut
from mergewell.settings import Settings
from mergewell.sources import recruiter_csv, resume  # noqa: F401  (they register themselves)
from mergewell.sources.registry import REGISTRY, Registry

Progress = Callable[[str, int], None]


@dataclass
class PipelineInput:
    """Paths by source type; first_record_only merges one record per source into the entity ``entity``."""

    csv_path: str | None = None
    resume_path: str | None = None
    config_path: str | None = None
    output_dir: str | None = None
    entity: str = "candidate"


@dataclass
class PipelineOutput:
    merged: DataFrame
    candidate: DataFrame
    explanation: DataFrame
    metrics: DataFrame
    decision_log: DataFrame
    report: DataFrame
    warnings: list[str] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    is_valid: bool = True


def merge_all(raw: DataFrame, settings: Settings = Settings(), config: ProjectionConfig = ProjectionConfig(), seconds: float | None = None, once: bool = False) -> PipelineOutput:
    """The stages over any number of entities, lazy but for the merge if ``once``: then it is written to the checkpoint
    folder first, so that all results share its random ids and none computes it again. What is validated is the projected object.
    The report is made of one row per entity, without a join."""
    merged = M.merge(raw, settings)
    merged = cut(merged) if once else merged
    checked = validate_json(merged.withColumn("candidate", as_json(merged, config)))
    figures = metrics(checked, seconds)
    shown = ("full_name", "headline", "overall_confidence", "emails", "phones", "location", "links", "skills", "experience", "education", "warnings")
    profile = json_value(F.struct(*(F.col(c).cast("double").alias(c) if c == "overall_confidence" else F.col(c) for c in shown)))
    entries = F.to_json(F.transform("_entries", lambda x: F.struct(x["field"].alias("field"), x["chosen_value"].alias("chosen_value"), x["confidence"].cast("double").alias("confidence"), x["reason"].alias("reason"))))
    texts = checked.withColumns({"profile": profile, "_entries": M.explained(checked)})
    numbers = F.to_json(F.struct(*(c for c in figures.columns if c != "entity_id")))
    kept = metrics(texts, seconds, "profile", "_entries")
    report = render_each(kept.select("entity_id", "profile", entries.alias("explained"), numbers.alias("figures")))
    candidate = checked.select("entity_id", "candidate", "is_valid", "summary")
    return PipelineOutput(merged, candidate, M.explanation(merged), figures, M.decision_log(merged), report)


def write_tables(out: PipelineOutput, output_dir: str) -> dict[str, str]:
    """Each result as a folder of JSON lines (report: of HTML texts), replaced as a whole by Spark's committer."""
    paths = {}
    for name in ("candidate", "explanation", "metrics", "decision_log", "report"):
        paths[name] = os.path.join(output_dir, name)
        df = getattr(out, name)
        df = df.select("entity_id", "candidate") if name == "candidate" else df
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(paths[name])
    return paths


def _plain(x: object) -> float | str:
    return float(x) if isinstance(x, Decimal) else str(x)


def _write(path: str, text: str) -> str:
    """Writes a small file so that readers see the old or the new one, never a part."""
    tmp = f"{path}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)
    return path


class Pipeline:
    """One candidate's run, with the five files of a run; any extractors, settings and progress callback."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), registry: Registry = REGISTRY) -> None:
        self.spark, self.settings, self.registry = spark, settings, registry

    def extract(self, inp: PipelineInput) -> tuple[DataFrame | None, list[str]]:
        """The first record of each given source; missing files, errors and empty sources become warnings."""
        found, warnings = None, []
        for kind, path in (("recruiter_csv", inp.csv_path), ("resume_pdf", inp.resume_path)):
            if not path:
                continue
            try:
                extractor = self.registry.instantiate(kind)
                if kind == "resume_pdf":
                    extractor.max_pages = self.settings.pdf_max_pages
                raw = M.as_raw(extractor.extract(self.spark, path)).orderBy("rec_seq").limit(1)
                rows = raw.collect()
            except Exception as e:  # a source that fails doesn't stop the others
                warnings.append(f"{kind}: {e}")
                continue
            if not rows:
                warnings.append(f"{kind}: no records in {path}")
                continue
            one = self.spark.createDataFrame(rows, raw.schema).withColumn("entity_id", F.lit(inp.entity))
            found = one if found is None else found.unionByName(one)
        return found, warnings

    def config(self, path: str | None, warnings: list[str]) -> ProjectionConfig:
        if not path:
            return ProjectionConfig.default()
        try:
            return ProjectionConfig.from_file(path)
        except (OSError, ValueError, TypeError) as e:
            warnings.append(f"config: {e}; the default is used")
            return ProjectionConfig.default()

    def run(self, inp: PipelineInput, progress: Progress | None = None) -> PipelineOutput:
        """ValueError if no path is given, or if a required field is missing under the policy ``error``."""
        tell = progress or (lambda message, percent: None)
        began = time.time()
        tell("Checking inputs", 5)
        if not (inp.csv_path or inp.resume_path):
            raise ValueError("give a CSV file or a résumé")
        tell("Extracting", 15)
        raw, warnings = self.extract(inp)
        tell("Merging", 40)
        if raw is None:
            warnings.append("No source data provided.")
            raw = self.spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in M.RAW.items()))
        tell("Reading the projection", 55)
        config = self.config(inp.config_path, warnings)
        out = merge_all(raw, self.settings, config, once=True)
        tell("Projecting", 65)
        try:
            found = out.candidate.collect()
        except Exception as e:
            if "missing_value_policy" in str(e):
                raise ValueError(str(e).split("\n")[0]) from e
            raise
        candidate = [r["candidate"] for r in found]
        tell("Validating", 75)
        out.is_valid = bool(found) and all(r["is_valid"] for r in found)
        out.warnings = warnings
        if inp.output_dir:
            tell("Writing", 85)
            os.makedirs(inp.output_dir, exist_ok=True)
            explained = {r["field"]: r.asDict(True) for r in out.explanation.collect()}
            for v in explained.values():
                v.pop("entity_id")
                v["chosen_value"] = json.loads(v["chosen_value"]) if v["chosen_value"] else None
            figures = [r.asDict(True) for r in out.metrics.withColumn("execution_time_seconds", F.lit(round(time.time() - began, 3))).collect()]
            log = [r.asDict(True) for r in out.decision_log.collect()]
            page = [r["html"] for r in out.report.collect()]
            dump = lambda x: json.dumps(x, indent=2, default=_plain, ensure_ascii=False)
            at = lambda name: os.path.join(inp.output_dir, name)
            out.paths = {
                "candidate": _write(at("candidate.json"), dump(json.loads(candidate[0])) if candidate else "{}"), "explanation": _write(at("explanation.json"), dump(explained)),
                "metrics": _write(at("metrics.json"), dump((figures or [{}])[0] | {"warnings": [*(figures[0]["warnings"] if figures else []), *warnings]})),
                "decision_log": _write(at("decision_log.json"), dump(log)), "report": _write(at("report.html"), page[0] if page else ""),
            }
        tell("Done", 100)
        return out
