"""Checks of canonical profiles: errors and warnings per row, and of JSON objects of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[45][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
E164 = r"^\+[1-9][0-9]{6,14}$"
FINDING = "array<struct<field:string,message:string,severity:string>>"


def _finding(when: Column, name: str, message: Column | str, severity: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.array(F.struct(F.lit(name).alias("field"), text.alias("message"), F.lit(severity).alias("severity")))).otherwise(F.array().cast(FINDING))


def _each(values: Column, bad, name: str, message) -> Column:
    found = F.filter(F.coalesce(values, F.array().cast("array<string>")), bad)
    return F.transform(found, lambda x: F.struct(F.lit(name).alias("field"), message(x).alias("message"), F.lit("warning").alias("severity")))


def check_candidate_id(c: Column) -> Column:
    none = F.coalesce(c, F.lit("")) == ""
    return F.concat(
        _finding(none, "candidate_id", "candidate_id is required but missing or empty", "error"),
        _finding(~none & ~c.rlike(UUID), "candidate_id", F.concat(F.lit("candidate_id '"), c, F.lit("' does not match UUID format")), "warning"),
    )


def findings(merged: DataFrame) -> Column:
    """The findings of a canonical profile; fields that a table lacks are left unchecked (candidate_id is an error then)."""
    has = set(merged.columns)
    out = [check_candidate_id(F.col("candidate_id") if "candidate_id" in has else F.lit(None).cast("string"))]
    if "emails" in has:
        out.append(_each(F.col("emails"), lambda x: ~x.contains("@"), "emails", lambda x: F.concat(F.lit("Suspicious email value: '"), x, F.lit("'"))))
    if "phones" in has:
        out.append(_each(F.col("phones"), lambda x: ~x.rlike(E164), "phones", lambda x: F.concat(F.lit("Phone '"), x, F.lit("' does not appear to be in E.164 format."))))
    if "years_experience" in has:
        y = F.col("years_experience")
        out.append(_finding((y < 0) | (y > 70), "years_experience", F.concat(F.lit("Unusual years_experience value: "), y.cast("string")), "warning"))
    if "overall_confidence" in has:
        v = F.col("overall_confidence")
        out.append(_finding((v < 0) | (v > 1), "overall_confidence", F.concat(F.lit("Must be in [0, 1], got "), v.cast("string")), "error"))
    if "location" in has:
        cc = F.col("location")["country_code"]
        out.append(_finding(~cc.rlike("^[A-Z]{2}$"), "location", F.concat(F.lit("country_code '"), cc, F.lit("' is not ISO Alpha-2")), "warning"))
    if "skills" in has:
        odd = F.filter(F.transform(F.coalesce("skills", F.array()), lambda s, i: F.when(F.coalesce(s["name"], F.lit("")) == "", i)), lambda i: i.isNotNull())
        out.append(F.transform(odd, lambda i: F.struct(F.lit("skills").alias("field"), F.concat(F.lit("Skill at index "), i.cast("string"), F.lit(" has no 'name'")).alias("message"), F.lit("warning").alias("severity"))))
    if "confidence" in has:
        bad = F.filter("confidence", lambda s: (s["c"]["score"] < 0) | (s["c"]["score"] > 1))
        out.append(F.transform(bad, lambda s: F.struct(F.concat(F.lit("_confidence."), s["field"]).alias("field"), F.concat(F.lit("Confidence score must be in [0, 1], got "), s["c"]["score"].cast("string")).alias("message"), F.lit("error").alias("severity"))))
    return F.concat(*out)


def _summary(found: Column) -> dict[str, Column]:
    errors, warnings = (F.size(F.filter(found, _of(s))) for s in ("error", "warning"))
    text = F.concat(F.when(errors == 0, "[VALID] ").otherwise("[INVALID] "), errors.cast("string"), F.lit(" error(s), "), warnings.cast("string"), F.lit(" warning(s)"))
    return {"is_valid": errors == 0, "error_count": errors, "warning_count": warnings, "summary": text}


def _of(severity: str):
    return lambda f: f["severity"] == severity


def validate(merged: DataFrame) -> DataFrame:
    """merged with findings, is_valid, error_count, warning_count and summary. Narrow."""
    df = merged.withColumn("findings", findings(merged))
    return df.withColumns(_summary(F.col("findings")))


def validate_json(rows: DataFrame, json_col: str = "candidate") -> DataFrame:
    """rows with the findings on a JSON object per row, whose types may be wrong: wrong types are errors."""
    j = F.try_parse_json(json_col)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(j, path, "variant")), r"^(\w+)", 1)
    text = lambda path: F.try_variant_get(j, path, "string")
    there = lambda k: F.coalesce(~k.isin("", "VOID"), F.lit(False))
    none = F.lit(None).cast("string")
    numeric = ("BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "INT", "SMALLINT", "TINYINT")
    cid = kind("$.candidate_id")
    out = [
        _finding(there(cid) & (cid != "STRING"), "candidate_id", F.concat(F.lit("candidate_id must be a string, got "), F.lower(cid)), "error"),
        F.when(~there(cid) | (cid == "STRING"), check_candidate_id(F.when(cid == "STRING", text("$.candidate_id")).otherwise(none))).otherwise(F.array().cast(FINDING)),
    ]
    for name in ("emails", "phones", "skills"):
        k = kind(f"$.{name}")
        out.append(_finding(there(k) & (k != "ARRAY"), name, F.concat(F.lit("Expected list, got "), F.lower(k)), "error"))
    for name, bad, say in (("emails", lambda x: ~x.contains("@"), lambda x: F.concat(F.lit("Suspicious email value: '"), x, F.lit("'"))), ("phones", lambda x: ~x.rlike(E164), lambda x: F.concat(F.lit("Phone '"), x, F.lit("' does not appear to be in E.164 format.")))):
        out.append(_each(F.filter(F.try_variant_get(j, f"$.{name}", "array<string>"), lambda x: x.isNotNull()), bad, name, say))
    for name in ("full_name", "name"):
        k = kind(f"$.{name}")
        out.append(_finding(there(k) & (k != "STRING"), name, F.concat(F.lit("Expected str, got "), F.lower(k)), "error"))
    for name in ("years_experience", "experience_years"):
        k, v = kind(f"$.{name}"), F.try_variant_get(j, f"$.{name}", "double")
        out.append(_finding(there(k) & ~k.isin(*numeric), name, F.concat(F.lit("Expected numeric, got "), F.lower(k)), "error"))
        out.append(_finding(k.isin(*numeric) & ((v < 0) | (v > 70)), name, F.concat(F.lit("Unusual years_experience value: "), v.cast("string")), "warning"))
    k, v = kind("$.overall_confidence"), F.try_variant_get(j, "$.overall_confidence", "double")
    out.append(_finding(there(k) & ~k.isin(*numeric), "overall_confidence", F.concat(F.lit("Expected float, got "), F.lower(k)), "error"))
    out.append(_finding(k.isin(*numeric) & ((v < 0) | (v > 1)), "overall_confidence", F.concat(F.lit("Must be in [0, 1], got "), v.cast("string")), "error"))
    k, cc = kind("$.location"), text("$.location.country_code")
    out.append(_finding(there(k) & (k != "OBJECT"), "location", F.concat(F.lit("Expected dict, got "), F.lower(k)), "error"))
    out.append(_finding(~cc.rlike("^[A-Z]{2}$"), "location", F.concat(F.lit("country_code '"), cc, F.lit("' is not ISO Alpha-2")), "warning"))
    k = kind("$._confidence")
    out.append(_finding(there(k) & (k != "OBJECT"), "_confidence", F.concat(F.lit("Expected dict, got "), F.lower(k)), "error"))
    scores = F.from_json(F.to_json(F.try_variant_get(j, "$._confidence", "variant")), "map<string,struct<score:double>>")
    bad = F.filter(F.coalesce(F.map_entries(scores), F.array()), lambda e: (e["value"]["score"] < 0) | (e["value"]["score"] > 1))
    out.append(F.transform(bad, lambda e: F.struct(F.concat(F.lit("_confidence."), e["key"]).alias("field"), F.concat(F.lit("Confidence score must be in [0, 1], got "), e["value"]["score"].cast("string")).alias("message"), F.lit("error").alias("severity"))))
    df = rows.withColumn("findings", F.concat(*out))
    return df.withColumns(_summary(F.col("findings")))


def metrics(merged: DataFrame, seconds: float | None = None, *more: str) -> DataFrame:
    """One row per entity with the figures of its merge, and ``more`` columns of merged; findings that merged bears already (of its projection) count instead of its own."""
    v = merged if "findings" in merged.columns else validate(merged)
    clashes = sum((F.coalesce(F.col(f"d_{f}")["had_conflict"], F.lit(False)).cast("int") for f in ("full_name", "headline", "years_experience", "location")), F.lit(0))
    return v.select(
        "entity_id", F.size("sources_used").alias("records_processed"), F.array_distinct("sources_used").alias("sources_used"), clashes.alias("conflicts_resolved"), "duplicates_removed",
        F.col("error_count").alias("invalid_fields"), F.size("skills").alias("normalized_skills"), "warnings", F.size("warnings").alias("warnings_total"), F.lit(seconds).cast("double").alias("execution_time_seconds"),
        "overall_confidence", "pipeline_version", F.col("created_at").alias("timestamp"), F.lit(7).alias("output_fields"), F.col("summary").alias("validation_summary"), *more,
    ).withColumnRenamed("warnings_total", "warning_count")
