"""Merge of the records of one entity from several sources by priority, with audit and confidence.

normalize_records is narrow. merge_entities shuffles once, on entity_id, and evaluates all fields over the few sorted
records of an entity with higher-order functions. With ``Settings.records_per_source`` an entity keeps so many records of
each source, cut by a window that Spark limits before the shuffle too; with None all are united, and a group is as large as its entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mergewell import fixed
from mergewell.functions import normal as N
from mergewell.functions.fuzzy import near_each
from mergewell.operators import long_form as L
from mergewell.settings import Settings

EXPERIENCE = "array<struct<title:string,company:string,start_date:string,end_date:string,is_current:boolean,description:string,location:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field_of_study:string,start_date:string,end_date:string,gpa:double>>"
RAW = {
    "entity_id": "string", "rec_seq": "long", "source": "string", "source_file": "string", "full_name": "string", "emails": "array<string>", "phones": "array<string>",
    "location": "string", "links": "array<string>", "headline": "string", "years_experience": "string", "skills": "array<string>", "experience": EXPERIENCE, "education": EDUCATION,
}
SCALARS = ("full_name", "headline", "years_experience", "location")
SCORED = ("full_name", "headline", "years_experience", "emails", "phones", "location", "skills")


def as_raw(df: DataFrame) -> DataFrame:
    """df with exactly the columns of a raw record; those that are missing are null. Extra columns are left out."""
    return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW.items()))


def first_records(raw: DataFrame, n: int | None = 1) -> DataFrame:
    """The first n records of each entity and source by rec_seq, all for None; entities without id are left out."""
    if n is None:
        return raw.filter("entity_id is not null")
    w = Window.partitionBy("entity_id", "source").orderBy(F.col("rec_seq").asc_nulls_last(), F.col("source_file").asc_nulls_last())
    return raw.filter("entity_id is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def priority(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for s, (p, _) in fixed.SOURCES.items() for x in (s, p)))
    return F.coalesce(F.try_element_at(table, source), F.lit(fixed.UNKNOWN_PRIORITY))


def reliability(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for s, (_, r) in fixed.SOURCES.items() for x in (s, r)))
    return F.coalesce(F.try_element_at(table, source), F.lit(fixed.UNKNOWN_RELIABILITY)).cast("decimal(3,2)")


def _each(values: Column, f) -> Column:
    """f of every filled value of an array; a null array is an empty one."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), f)


def _months(ym: Column) -> Column:
    return F.substring(ym, 1, 4).try_cast("int") * 12 + F.substring(ym, 6, 2).try_cast("int") - 1


def years_of(experience: Column, now: Column) -> Column:
    """Sum over the united periods of employment of the difference of calendar years; null if it isn't above 0.

    An entry without a readable start is skipped; without an end, or current, it runs to now; with an unreadable end, one
    that is a present-marker, or before the start, it is skipped.
    """

    def span(e: Column) -> Column:
        start, end = N.normalize_date(e["start_date"]), N.normalize_date(e["end_date"])
        first = F.when(N.valid_month(start["value"]), _months(start["value"]))
        open_end = F.coalesce(e["is_current"], F.lit(False)) | (F.coalesce(e["end_date"], F.lit("")) == "")
        last = F.when(open_end, _months(F.date_format(now, "yyyy-MM"))).when(N.valid_month(end["value"]), _months(end["value"]))
        return F.struct(first.alias("a"), last.alias("b"))

    spans = F.array_sort(F.filter(F.transform(F.coalesce(experience, F.array().cast(EXPERIENCE)), span), lambda s: s["a"].isNotNull() & (s["b"] >= s["a"])))
    zero = F.struct(F.lit(0).alias("years"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def add(acc: Column, s: Column) -> Column:
        joins = s["a"] <= acc["b"]
        closed = acc["years"] + F.coalesce(F.floor(acc["b"] / 12) - F.floor(acc["a"] / 12), F.lit(0)).cast("int")
        return F.when(joins, F.struct(acc["years"].alias("years"), acc["a"].alias("a"), F.greatest(acc["b"], s["b"]).alias("b"))).otherwise(
            F.struct(closed.alias("years"), s["a"].cast("int").alias("a"), s["b"].cast("int").alias("b"))
        )

    total = F.aggregate(spans, zero, add, lambda acc: acc["years"] + F.coalesce(F.floor(acc["b"] / 12) - F.floor(acc["a"] / 12), F.lit(0)).cast("int"))
    return F.when(total > 0, total.cast("double"))


def _years_result(experience: Column, typed: Column, now: Column) -> Column:
    def use(derived: Column) -> Column:
        explicit = N.first_number(typed)
        text = derived.cast("string")
        warning = F.when(F.abs(explicit - derived) >= 2.0, F.concat(F.lit("Summary-derived years_experience ("), explicit.cast("string"), F.lit(") conflicts with employment-date calculation ("), text, F.lit(")")))
        by_dates = N.result(text, True, "0.95", F.lit("employment_date_calculation"), F.to_json(experience), warning)
        by_text = N.result(explicit.cast("string"), True, "0.85", F.lit("summary_regex_extraction"), typed)
        return F.when(derived.isNotNull(), by_dates).when(explicit.isNotNull(), by_text)

    return N.bind(years_of(experience, now), use)


def normalize_records(raw: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """raw records with a normal result (functions.normal) for every field; narrow."""
    spark = raw.sparkSession
    table = N.country_table(spark)
    now = F.lit(settings.now).cast("timestamp") if settings.now else F.current_timestamp()
    df = as_raw(raw)
    low = lambda c: F.lower(N.strip(c))
    skills = F.filter(F.coalesce("skills", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    df = df.withColumn("skills", skills)
    if fuzzy:
        spellings = tuple(fixed.SKILLS)
        df = df.withColumn("_near", near_each(F.transform("skills", low), spellings, settings.skill_fuzzy_threshold))
        names = tuple(sorted(table["names"]))
        settled = N.normalize_country(F.col("location"), table)["success"]
        df = df.withColumn("_place", F.get(near_each(F.array(F.when(~settled, low(F.col("location")))), names, settings.country_fuzzy_threshold), F.lit(0)))
        n_skills = F.zip_with("skills", "_near", lambda s, m: N.normalize_skill(s, m, settings.skill_fuzzy_threshold))
        n_country = N.normalize_country(F.col("location"), table, F.col("_place"))
    else:
        n_skills = F.transform("skills", lambda s: N.normalize_skill(s))
        n_country = N.normalize_country(F.col("location"), table)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return df.select(
        "entity_id", "rec_seq", "source", "source_file", priority(F.col("source")).alias("priority"), reliability(F.col("source")).alias("reliability"),
        F.when(filled("full_name"), N.normalize_name(F.col("full_name"))).alias("full_name"), N.headline(F.col("headline")).alias("headline"),
        _years_result(F.col("experience"), F.col("years_experience"), now).alias("years_experience"),
        F.when(filled("location"), n_country).alias("location"), F.when(filled("location"), N.city_of(F.col("location"))).alias("city"), F.col("location").alias("place"),
        _each(F.col("emails"), N.normalize_email).alias("emails"), _each(F.col("phones"), lambda p: N.normalize_phone(p, settings.default_country)).alias("phones"),
        _each(F.col("links"), N.normalize_url).alias("links"), n_skills.alias("skills"), "experience", "education",
    )


# --- scalars ------------------------------------------------------------------------------------------------------


def confidence(field: str, source: Column, rel: Column, factor: Column, method: Column, agreed: Column, settings: Settings) -> Column:
    """Score and its parts: reliability x factor x bonus, at most 1; the bonus grows with the sources that agree."""
    bonus, rounded = L.bonus(agreed, settings), L.score(rel, factor, agreed, settings)
    note = F.when(agreed > 1, F.concat(agreed.cast("string"), F.lit(" source(s) agree → bonus="), F.format_string("%.2f", bonus.cast("double")))).otherwise("single source, no corroboration bonus")
    text = F.concat(
        F.lit(f"field='{field}' | score="), rounded.cast("double").cast("string"), F.lit(" = reliability("), F.format_string("%.2f", rel.cast("double")), F.lit(") × norm_factor("),
        F.format_string("%.2f", factor.cast("double")), F.lit(") × corroboration("), F.format_string("%.2f", bonus.cast("double")), F.lit(") | source='"), source, F.lit("' | method='"), method, F.lit("' | "), note,
    )
    return F.struct(
        rounded.alias("score"), rel.alias("source_reliability"), factor.alias("normalization_factor"), bonus.alias("corroboration_bonus"), text.alias("explanation")
    )


def reason(field: str, c: Column, agreed: Column, had_conflict: Column) -> Column:
    """Why the first of the sorted candidates c won."""
    first, n = F.get(c, F.lit(0)), F.size(c)
    sources = F.array_join(F.transform(c, lambda x: x["source"]), ", ")
    losers = F.array_join(F.transform(F.slice(c, 2, F.greatest(n, F.lit(1))), lambda x: F.concat(F.lit("'"), x["source"], F.lit("' → '"), x["n"]["value"], F.lit("'"))), "; ")
    alone = F.concat(F.lit("Single source '"), first["source"], F.lit("' provided this value. No conflict to resolve."))
    same = F.concat(F.lit("All "), n.cast("string"), F.lit(" sources agree on this value ("), sources, F.lit("). Chose from highest-priority source '"), first["source"], F.lit("'."))
    clash = F.concat(
        F.lit("Conflict detected across "), n.cast("string"), F.lit(" sources. Chose '"), first["n"]["value"], F.lit("' from '"), first["source"], F.lit("' (priority="), first["priority"].cast("string"),
        F.lit("). Discarded: "), losers, F.lit(". Priority order is deterministic per SOURCE_PRIORITY config."),
    )
    return F.when(n == 1, alone).when(had_conflict, clash).otherwise(same)


def resolve(field: str, records: Column, settings: Settings) -> Column:
    """The decision on a scalar field over an entity's sorted records; null if no record has a value.

    The value of the highest priority wins (ties: source name, then rec_seq). Values are compared without case and outer blanks.
    """
    candidates = F.transform(
        F.filter(records, lambda r: r[field]["value"].isNotNull()),
        lambda r: F.struct(r["source"].alias("source"), r["priority"].alias("priority"), r["reliability"].alias("reliability"), r[field].alias("n")),
    )

    def use(c: Column) -> Column:
        # The keys are bound: counting those that agree would make all of them anew for each.
        keys = F.transform(c, lambda x: N.compare_key(x["n"]["value"]))
        counted = lambda k: F.struct(F.size(F.filter(k, lambda x: x == F.get(k, F.lit(0)))).alias("agreed"), (F.size(F.array_distinct(k)) > 1).alias("clash"))
        return N.bind(F.struct(c.alias("c"), N.bind(keys, counted).alias("k")), chosen)

    def chosen(s: Column) -> Column:
        c, agreed, clash = s["c"], s["k"]["agreed"], s["k"]["clash"]
        first = F.get(c, F.lit(0))
        return F.when(F.size(c) > 0, F.struct(
            F.lit(field).alias("field"), first["n"]["value"].alias("value"), first["source"].alias("source"), first["priority"].alias("priority"), first["n"].alias("n"),
            clash.alias("had_conflict"), agreed.alias("agreed"), c.alias("candidates"), reason(field, c, agreed, clash).alias("reason"),
            confidence(field, first["source"], first["reliability"], first["n"]["factor"], first["n"]["method"], agreed, settings).alias("confidence"),
        ))

    return N.bind(candidates, use)


# --- lists --------------------------------------------------------------------------------------------------------


def _flat(field: str, records: Column, keep) -> Column:
    """All results of a list field in the order of the records, with their source, that satisfy keep."""
    one = lambda r: F.transform(F.filter(r[field], keep), lambda n: F.struct(r["source"].alias("source"), r["priority"].alias("priority"), r["reliability"].alias("reliability"), n.alias("n")))
    return F.flatten(F.transform(records, one))


def union(field: str, flat: Column, key, settings: Settings, accept=None) -> Column:
    """The first result per key and how often a key came again: struct kept, repeats, confidence.

    accept: which results may be kept; others only count as repeats of a key that was kept before.
    """
    accept = accept or (lambda x: F.lit(True))

    def use(f: Column) -> Column:
        # Positions of each key's first acceptable result, computed once and bound.
        good = F.transform(f, lambda x: F.when(accept(x), key(x["n"]["value"])))
        keys = F.transform(f, lambda x: key(x["n"]["value"]))
        at = N.bind(good, lambda g: F.transform(keys, lambda k: F.array_position(g, k)))
        return N.bind(F.arrays_zip(f.alias("x"), at.alias("at")), chosen)

    def chosen(z: Column) -> Column:
        first_of = F.filter(z, lambda y, i: accept(y["x"]) & (y["at"] == i + 1))
        kept = F.transform(first_of, lambda y: y["x"])
        repeats = F.size(F.filter(z, lambda y, i: (y["at"] > 0) & (y["at"] < i + 1)))
        first = F.get(kept, F.lit(0))
        scored = F.when(F.size(kept) > 0, confidence(field, first["source"], first["reliability"], first["n"]["factor"], first["n"]["method"], repeats + 1, settings))
        return F.struct(kept.alias("kept"), repeats.alias("repeats"), scored.alias("confidence"))

    return N.bind(flat, use)


def _entries(field: str, records: Column, kind: str, key) -> Column:
    """The first entry per key of a list of structs over the records; dates that aren't months become null."""
    every = F.flatten(F.transform(records, lambda r: F.coalesce(r[field], F.array().cast(kind))))

    def use(e: Column) -> Column:
        return N.bind(F.transform(e, key), lambda keys: F.filter(e, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    def dated(x: Column) -> Column:
        month = lambda c: N.bind(N.normalize_date(x[c])["value"], lambda v: F.when(N.valid_month(v), v))
        return x.withField("start_date", month("start_date")).withField("end_date", month("end_date"))

    return F.transform(N.bind(every, use), dated)


def _pair_key(a: str, b: str):
    text = lambda c: F.nullif(N.strip(F.lower(F.coalesce(c, F.lit("")))), F.lit(""))
    return lambda x: F.concat_ws("\u0001", F.coalesce(text(x[a]), F.lit("\u0002")), F.coalesce(text(x[b]), F.lit("\u0002")))


def merge_entities(normalized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per entity: the canonical profile, and for every field the decision behind it.

    Columns: entity_id, candidate_id, the 10 profile fields, d_<field> (decision or union of each scored field), links_kept,
    confidence (array<struct<field, ...>> of the scored fields that have a value), overall_confidence, warnings,
    duplicates_removed, pipeline_version, created_at. Random ids and created_at are those of the evaluation: write the result once.
    """
    what = [c for c in normalized.columns if c not in ("entity_id", "rec_seq", "source", "priority")]
    record = F.struct("priority", "source", "rec_seq", *what)
    df = normalized.groupBy("entity_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    r = F.col("records")
    df = df.withColumns({f"d_{f}": resolve(f, r, settings) for f in SCALARS})
    usable = lambda n: F.coalesce(n["value"], F.lit("")) != ""
    digits = lambda v: F.regexp_replace(v, r"[^0-9]", "")
    df = df.withColumns({
        "d_emails": union("emails", _flat("emails", r, lambda n: usable(n) & n["success"]), F.lower, settings),
        "d_phones": union("phones", _flat("phones", r, usable), digits, settings, accept=lambda x: x["n"]["success"]),
        "d_links": union("links", _flat("links", r, usable), lambda v: v, settings),
        "d_skills": union("skills", _flat("skills", r, usable), lambda v: v, settings),
        "experience": _entries("experience", r, EXPERIENCE, _pair_key("company", "title")),
        "education": _entries("education", r, EDUCATION, _pair_key("institution", "degree")),
    })
    country = F.col("d_location")["value"]
    cities = F.filter(r, lambda x: (x["location"]["value"] == country) & x["city"].isNotNull())
    scores = F.filter(
        F.array(*(F.when(F.col(f"d_{f}")["confidence"].isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(fixed.FIELD_WEIGHTS[f]).cast("decimal(3,1)").alias("weight"), F.col(f"d_{f}")["confidence"].alias("c"))) for f in SCORED)),
        lambda s: s.isNotNull(),
    )
    df = df.withColumn("confidence", scores)
    wide = lambda f: F.aggregate(F.filter("confidence", lambda s: s["c"]["score"] > 0), F.lit(0).cast("decimal(20,6)"), lambda acc, s: (acc + f(s)).cast("decimal(20,6)"))
    total = wide(lambda s: s["weight"])
    overall = F.when(total > 0, F.round(wide(lambda s: s["c"]["score"] * s["weight"]) / total, 4)).otherwise(0).cast("decimal(6,4)")
    scalar_warnings = [F.when(F.col(f"d_{f}")["n"]["warning"].isNotNull(), F.concat(F.lit(f"[{f}] "), F.col(f"d_{f}")["n"]["warning"])) for f in SCALARS[:3]]
    phone_warnings = F.transform(_flat("phones", r, lambda n: n["value"].isNotNull() & n["warning"].isNotNull()), lambda x: F.concat(F.lit("[phones] "), x["n"]["warning"]))
    skill_warnings = F.transform(F.filter(F.col("d_skills")["kept"], lambda x: x["n"]["warning"].isNotNull()), lambda x: F.concat(F.lit("[skills] "), x["n"]["warning"]))
    values = lambda f: F.transform(F.col(f"d_{f}")["kept"], lambda x: x["n"]["value"])
    now = F.lit(settings.now).cast("timestamp") if settings.now else F.current_timestamp()
    return df.select(
        "entity_id", N.candidate_id(F.get(values("emails"), F.lit(0))).alias("candidate_id"), F.col("d_full_name")["value"].alias("full_name"), values("emails").alias("emails"), values("phones").alias("phones"),
        F.when(country.isNotNull(), F.struct(F.try_element_at(cities, F.lit(-1))["city"].alias("city"), F.lit(None).cast("string").alias("state"), country.alias("country_code"), F.get(r, F.lit(0))["place"].alias("raw"))).alias("location"),
        F.transform(F.col("d_links")["kept"], lambda x: F.struct(x["n"]["value"].alias("url"), N.infer_platform(x["n"]["value"]).alias("platform"))).alias("links"),
        F.col("d_headline")["value"].alias("headline"), F.col("d_years_experience")["value"].cast("double").alias("years_experience"),
        F.transform(F.col("d_skills")["kept"], lambda x: F.struct(x["n"]["value"].alias("name"), F.coalesce(x["n"]["original"], x["n"]["value"]).alias("raw_name"), F.lit(None).cast("string").alias("category"))).alias("skills"),
        "experience", "education", *(f"d_{f}" for f in (*SCORED, "links")), "confidence", overall.alias("overall_confidence"),
        F.concat(F.filter(F.array(*scalar_warnings), lambda w: w.isNotNull()), phone_warnings, skill_warnings).alias("warnings"),
        (F.col("d_emails")["repeats"] + F.col("d_phones")["repeats"] + F.col("d_skills")["repeats"]).alias("duplicates_removed"),
        F.lit(settings.version).alias("pipeline_version"), now.alias("created_at"), F.transform(r, lambda x: x["source"]).alias("sources_used"),
    )


def merge(raw: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """Raw records to canonical profiles. An empty table gives an empty result."""
    return merge_entities(normalize_records(first_records(as_raw(raw), settings.records_per_source), settings, fuzzy), settings)


# --- audit --------------------------------------------------------------------------------------------------------


def provenance(merged: DataFrame) -> DataFrame:
    """(entity_id, field, rank, source, value, method, confidence, notes): winner (rank 0) and losers of scalars, kept values of lists."""

    def rows(field: str) -> Column:
        found = F.coalesce(F.col(f"d_{field}")["candidates" if field in SCALARS else "kept"], F.array())
        return F.transform(found, lambda x, i: F.struct(
            F.lit(field).alias("field"), i.alias("rank"), x["source"].alias("source"), x["n"]["value"].alias("value"), x["n"]["method"].alias("method"), x["n"]["factor"].alias("confidence"), x["n"]["warning"].alias("notes")))

    every = F.concat(*(rows(f) for f in (*SCALARS, "emails", "phones", "links", "skills")))
    return merged.select("entity_id", F.inline(every))


def decision_log(merged: DataFrame) -> DataFrame:
    """One row per conflict: entity_id, field, had_conflict, winner_source, winner_value, winner_priority, agreed_sources, alternatives, reason, timestamp."""
    d = F.filter(F.array(*(F.when(F.col(f"d_{f}")["had_conflict"], F.col(f"d_{f}")) for f in SCALARS)), lambda x: x.isNotNull())
    one = merged.select("entity_id", F.col("created_at").alias("timestamp"), F.explode(d).alias("d"))
    others = F.transform(F.slice("d.candidates", 2, F.size("d.candidates")), lambda x: F.struct(x["source"].alias("source"), x["n"]["value"].alias("value"), x["n"]["factor"].alias("factor")))
    return one.select(
        "entity_id", F.col("d.field").alias("field"), "timestamp", F.col("d.had_conflict").alias("had_conflict"), F.col("d.source").alias("winner_source"), F.col("d.value").alias("winner_value"),
        F.col("d.priority").alias("winner_priority"), F.col("d.agreed").alias("agreed_sources"), others.alias("alternatives"), F.col("d.reason").alias("reason"),
    )


def explained(merged: DataFrame) -> Column:
    """The entries of the explained fields of a profile, as an array."""

    def entry(field: str) -> Column:
        d = F.col(f"d_{field}")
        scalar = field in SCALARS
        first = F.get(d["candidates" if scalar else "kept"], F.lit(0))
        clash = F.coalesce(d["had_conflict"], F.lit(False)) if scalar else F.lit(False)
        others = F.transform(F.slice(d["candidates"], 2, F.greatest(F.size(d["candidates"]), F.lit(1))), lambda x: F.struct(x["source"].alias("source"), x["n"]["value"].alias("value"), x["n"]["factor"].alias("factor"))) if scalar else F.lit(None)
        chosen = F.to_json(F.struct(F.col(field).alias("v")), {"ignoreNullFields": "false"})
        why = d["confidence"]["explanation"]
        if scalar:
            why = F.when(clash, d["reason"]).otherwise(why)
        return F.struct(
            F.lit(field).alias("field"), F.regexp_extract(chosen, r'(?s)^\{"v":(.*)\}$', 1).alias("chosen_value"), d["confidence"]["score"].alias("confidence"), F.coalesce(why, F.lit("Field not present in any source.")).alias("reason"),
            clash.alias("had_conflict"), first["source"].alias("source"), first["n"]["method"].alias("method"), first["n"]["warning"].alias("notes"),
            F.when(clash, others).cast("array<struct<source:string,value:string,factor:decimal(4,3)>>").alias("alternatives"),
        )

    return F.array(*(entry(f) for f in SCORED))


def explanation(merged: DataFrame) -> DataFrame:
    """(entity_id, field, chosen_value as JSON, confidence, reason, had_conflict, source, method, notes, alternatives) of the seven explained fields."""
    return merged.select("entity_id", F.inline(explained(merged)))
