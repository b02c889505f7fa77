"""HTML report of a profile, rendered from JSON texts."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Scores from which a bar is green or amber, else it is red; length at which a description is cut.
GREEN, AMBER, CUT = 0.85, 0.65, 180
_STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}h1{margin:0}.chip{background:#eef;border-radius:1em;padding:.2em .8em;margin:.2em;display:inline-block}.cell{display:inline-block;min-width:9em;margin:.5em}"


def colour(score: float) -> str:
    return "green" if score >= GREEN else "orange" if score >= AMBER else "crimson"


def _e(x: object) -> str:
    return html.escape("" if x is None else str(x))


def _section(title: str, rows: list[str], always: bool = False) -> str:
    return f"<section><h2>{title}</h2>{''.join(rows)}</section>" if rows or always else ""


def render(profile: dict, explained: list[dict], figures: dict) -> str:
    """The report of one profile: empty sections are left out, but for Contact and Metrics."""
    score = float(profile.get("overall_confidence") or 0)
    place = profile.get("location") or {}
    where = ", ".join(str(x) for x in (place.get("city"), place.get("country_code")) if x)
    contact = [f"<p>{_e(x)}</p>" for x in (*(profile.get("emails") or []), *(profile.get("phones") or []), *([where] if where else []))]
    contact += [f'<p><a href="{_e(x.get("url"))}">{_e(x.get("platform"))}</a></p>' for x in profile.get("links") or []]
    skills = [f'<span class="chip">{_e(s.get("name"))}</span>' for s in profile.get("skills") or []]

    def job(x: dict) -> str:
        end = "Present" if x.get("is_current") else x.get("end_date")
        text = x.get("description") or ""
        text = text if len(text) <= CUT else text[:CUT] + "…"  # cut before it is escaped
        return f"<p><b>{_e(x.get('title'))}</b> {_e(x.get('company'))} <i>{_e(x.get('start_date'))} – {_e(end)}</i><br>{_e(text)}</p>"

    jobs = [job(x) for x in profile.get("experience") or []]
    degrees = [f"<p><b>{_e(x.get('institution'))}</b> {_e(x.get('degree'))} {_e(x.get('field_of_study'))} <i>{_e(x.get('end_date'))}</i></p>" for x in profile.get("education") or []]
    names = ("records_processed", "conflicts_resolved", "duplicates_removed", "invalid_fields", "normalized_skills", "execution_time_seconds")
    cells = [f'<span class="cell"><b>{_e(figures.get(n))}</b><br>{n.replace("_", " ")}</span>' for n in names]
    why = [f'<p><b style="color:{colour(float(x.get("confidence") or 0))}">{_e(x.get("field"))}</b> {_e(x.get("chosen_value"))}<br><small>{_e(x.get("reason"))}</small></p>' for x in explained]
    notes = [f"<p>{_e(w)}</p>" for w in profile.get("warnings") or []]
    body = (
        f'<header><h1>{_e(profile.get("full_name") or "Unknown")}</h1><p>{_e(profile.get("headline"))}</p><p style="color:{colour(score)}">{100 * score:.1f}%</p></header>'
        + _section("Contact", contact, True) + _section("Skills", skills) + _section("Work Experience", jobs) + _section("Education", degrees)
        + _section("Pipeline Metrics", cells, True) + _section("Field Explanations", why) + _section("Warnings", notes)
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_e(profile.get("full_name"))}</title><style>{_STYLE}</style></head><body>{body}</body></html>'


def render_each(df: DataFrame, profile: str = "profile", explained: str = "explained", figures: str = "figures") -> DataFrame:
    """df (entity_id and three JSON columns) as (entity_id, html); in Arrow batches, one row at a time."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, c in batches:
            yield pa.array([render(json.loads(x or "{}"), json.loads(y or "[]"), json.loads(z or "{}")) for x, y, z in zip(a.to_pylist(), b.to_pylist(), c.to_pylist())], pa.string())

    return df.select("entity_id", F.arrow_udf(run, "string")(profile, explained, figures).alias("html"))
