"""Normalizers as Catalyst expressions: each maps a typed value to the struct

    value, success, factor decimal(4,3), method, original, warning

A null or blank value gives value null, success false, factor 0 and method ``empty_input``. All are narrow and stay
in the JVM (functions over arrays are interpreted there, outside of generated code); none raises on any input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from mergewell import fixed
from mergewell.functions.months import MONTHS

RESULT = "struct<value: string, success: boolean, factor: decimal(4,3), method: string, original: string, warning: string>"


def strip(c: Column) -> Column:
    """c without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def result(value: Column, success: bool | Column, factor: str | Column, method: Column, original: Column, warning: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        value.cast("string").alias("value"), as_column(success).alias("success"), as_column(factor).cast("decimal(4,3)").alias("factor"), method.alias("method"),
        original.alias("original"), (F.lit(None).cast("string") if warning is None else warning).alias("warning"),
    )


def _or_empty(raw: Column, what: str, use: Callable[[Column], Column]) -> Column:
    """use(stripped) for a filled value, else the result for none."""
    none = F.lit(None).cast("string")
    empty = result(none, False, "0", F.lit("empty_input"), raw, F.lit(f"Empty {what} string"))
    return bind(strip(raw), lambda t: F.when(F.coalesce(t, F.lit("")) == "", empty).otherwise(use(t)))


def normalize_email(raw: Column) -> Column:
    def use(t: Column) -> Column:
        low = F.lower(t)
        ats = F.length(low) - F.length(F.replace(low, F.lit("@"), F.lit("")))
        many = result(low, False, "0.30", F.lit("malformed_multiple_at_signs"), raw, F.concat(F.lit("Email contains "), ats.cast("string"), F.lit(" '@' characters: '"), t, F.lit("'")))
        odd = result(low, False, "0.50", F.lit("format_invalid_kept_lowercased"), raw, F.concat(F.lit("Email did not pass format validation: '"), low, F.lit("'")))
        good = result(low, True, "1.0", F.when(t != low, "lowercased").otherwise("already_lowercase"), raw)
        return F.when(ats != 1, many).when(~low.rlike(rf"^{fixed.EMAIL}$"), odd).otherwise(good)

    return _or_empty(raw, "email", use)


def distinct_emails(values: Column) -> Column:
    """The addresses of an array, the first of those that differ in case only."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def title_case(t: Column) -> Column:
    """A name with each part capitalised, parts being apart by blanks or hyphens: particles stay small but at the end, O'x, Mcx and Macx get two capitals."""
    words = F.regexp_extract_all(t, F.lit(r"[^\s\-]+"), F.lit(0))
    gaps = F.regexp_extract_all(t, F.lit(r"[\s\-]+"), F.lit(0))
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))

    def cased(x: Column, last: Column) -> Column:
        low = F.lower(x)
        return (
            F.when(low.isin(*fixed.PARTICLES) & ~last, low)
            .when(low.rlike("^o'[a-z]"), F.concat(F.lit("O'"), capital(x.substr(F.lit(3), F.length(x)))))
            .when(low.rlike("^mc[a-z]"), F.concat(F.lit("Mc"), capital(x.substr(F.lit(3), F.length(x)))))
            .when(low.rlike("^mac[a-z]"), F.concat(F.lit("Mac"), capital(x.substr(F.lit(4), F.length(x)))))
            .otherwise(capital(x))
        )

    # A text may begin with a gap ("-x"); then gaps come before words.
    first_gap = t.rlike(r"^[\s\-]")
    done = bind(words, lambda w: F.transform(w, lambda x, i: cased(x, i == F.size(w) - 1)))
    pairs = F.zip_with(done, gaps, lambda w, g: F.when(first_gap, F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))).otherwise(F.concat(F.coalesce(w, F.lit("")), F.coalesce(g, F.lit("")))))
    return F.array_join(pairs, "")


def normalize_name(raw: Column) -> Column:
    def use(t: Column) -> Column:
        return bind(title_case(t), lambda n: result(n, True, F.when(n != t, "0.90").otherwise("1.0"), F.when(n != t, "normalized_case").otherwise("already_proper_case"), raw))

    return _or_empty(raw, "name", use)


def normalize_url(raw: Column) -> Column:
    """https:// is added where no scheme stands; scheme and host in lower case, no slash at the path's end, no fragment."""

    def use(t: Column) -> Column:
        had = t.rlike("(?i)^https?://")
        full = F.when(had, t).otherwise(F.concat(F.lit("https://"), t))
        parts = r"^(?i:(https?)://)([^/?#]*)([^?#]*)(\?[^#]*)?"
        piece = lambda k: F.regexp_extract(full, parts, k)
        query = F.when(F.length(piece(4)) > 1, piece(4)).otherwise("")
        clean = F.concat(F.lower(piece(1)), F.lit("://"), F.lower(piece(2)), F.regexp_replace(piece(3), "/+$", ""), query)
        bad = result(t, False, "0.30", F.lit("url_parse_failed"), raw, F.concat(F.lit("URL parse error: No hostname found in URL: '"), full, F.lit("'")))
        warn = F.when(~had, F.concat(F.lit("Added 'https://' scheme to '"), t, F.lit("'")))
        good = result(clean, True, F.when(had, "1.0").otherwise("0.90"), F.when(had, "url_normalized").otherwise("url_scheme_added"), raw, warn)
        return F.when(piece(2) == "", bad).otherwise(good)

    return _or_empty(raw, "URL", use)


def infer_platform(url: Column) -> Column:
    """The first platform whose pattern occurs anywhere in the address, else ``other``."""
    out = None
    for name, pattern in fixed.PLATFORMS:
        at = url.rlike(f"(?i){pattern}")
        out = F.when(at, name) if out is None else out.when(at, name)
    return out.otherwise("other")


_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_NAMED = "(?i)^(?:(?:[0-9]{1,2})(?:st|nd|rd|th)?[ -]+)?" + _MONTH + "[.,]?[ -]+(?:[0-9]{1,2}(?:st|nd|rd|th)?,? +)?([0-9]{4})$"
_SHORT_YEAR = "(?i)^" + _MONTH + "[.,]? *['’]([0-9]{2})$"
_YEAR_FIRST = "^([0-9]{4})[-/.]([0-9]{1,2})(?:[-/.][0-9]{1,2})?(?:[T ][0-9:.Z+]*)?$"
_YEAR_LAST = "^([0-9]{1,2})[-/.]([0-9]{4})$"
_YEAR_NAMED = "(?i)^([0-9]{4})[ ,./-]+" + _MONTH + "[.,]?(?:[ ,.-]+[0-9]{1,2}(?:st|nd|rd|th)?)?$"
_COMPACT = "^([0-9]{4})(0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$"
_TIME = r"(?i)[ ,T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?$"
_THREE = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"


def year_month(t: Column) -> Column:
    """``YYYY-MM`` of a date that names a month, with a time behind it or not, else null. Of two numbers before a year the first that
    can be is the month."""
    return bind(F.regexp_replace(t, _TIME, ""), _dated)


def _dated(t: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, _NAMED, 1), 1, 3))).cast("int")
    short = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, _SHORT_YEAR, 1), 1, 3))).cast("int")
    number = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    after = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, _YEAR_NAMED, 2), 1, 3))).cast("int")
    two = number(_SHORT_YEAR, 2)
    out = lambda y, m: F.when(m.between(1, 12), F.format_string("%04d-%02d", y, m))
    a, b = number(_THREE, 1), number(_THREE, 2)
    return F.coalesce(
        F.when(t.rlike(_YEAR_FIRST), out(number(_YEAR_FIRST, 1), number(_YEAR_FIRST, 2))),
        F.when(t.rlike(_NAMED), out(number(_NAMED, 2), named)),
        F.when(t.rlike(_YEAR_NAMED), out(number(_YEAR_NAMED, 1), after)),
        F.when(t.rlike(_COMPACT), out(number(_COMPACT, 1), number(_COMPACT, 2))),
        F.when(t.rlike(_YEAR_LAST), out(number(_YEAR_LAST, 2), number(_YEAR_LAST, 1))),
        F.when(t.rlike(_SHORT_YEAR), out(two + F.when(two >= 70, 1900).otherwise(2000), short)),
        F.when(t.rlike(_THREE) & a.between(1, 31) & b.between(1, 31), out(number(_THREE, 3), F.when(a <= 12, a).otherwise(b))),
    )


def normalize_date(raw: Column) -> Column:
    def use(t: Column) -> Column:
        none = F.lit(None).cast("string")
        year = result(F.concat(t, F.lit("-01")), True, "0.70", F.lit("year_only_defaulted_to_january"), raw, F.concat(F.lit("Only year provided; defaulted to "), t, F.lit("-01")))
        bad = result(t, False, "0.30", F.lit("unparseable_kept_as_is"), raw, F.concat(F.lit("Could not parse date: '"), t, F.lit("'")))
        read = bind(year_month(t), lambda m: F.when(m.isNotNull(), result(m, True, "1.0", F.lit("dateutil_parse"), raw)).otherwise(bad))
        return F.when(F.lower(t).isin(*fixed.PRESENT), result(none, True, "1.0", F.lit("present_marker"), raw)).when(t.rlike("^[0-9]{4}$"), year).otherwise(read)

    return _or_empty(raw, "date", use)


def valid_month(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}$")


def normalize_phone(raw: Column, default_country: str = "IN") -> Column:
    """E.164 by the calling codes and number lengths of a few regions (fixed.PHONE_REGIONS).

    An explicit code of another country is accepted with 7 to 15 digits in all; the method then says so.
    """
    regions = [default_country, *(r for r in fixed.PHONE_REGIONS if r != default_country)]

    def use(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?i)\s*(?:x|ext\.?)\s*[0-9]{1,5}$", "")
        digits = F.regexp_replace(bare, "[^0-9]", "")
        plain = bare.rlike(r"^[+0-9][0-9 ().\-/]*$|^\([0-9][0-9 ().\-/]*$")
        known = F.lit(False)
        for code, _, national in fixed.PHONE_REGIONS.values():
            known = known | digits.rlike(f"^{code}0?(?:{national})$")
        codes = "|".join(sorted({c for c, _, _ in fixed.PHONE_REGIONS.values()}))
        e164 = F.concat(F.lit("+"), F.regexp_replace(digits, f"^({codes})0?(?=[0-9]{{8,10}}$)", "$1"))
        plus = bare.startswith("+")
        other = plus & ~digits.rlike(f"^(?:{codes})") & digits.rlike("^[1-9][0-9]{6,14}$")
        out = F.when(plain & plus & known, result(e164, True, "1.0", F.lit("e164_explicit_country_code"), raw))
        out = out.when(plain & other, result(F.concat(F.lit("+"), digits), True, "1.0", F.lit("e164_other_country_code"), raw))
        for k, region in enumerate(regions):
            code, trunk, national = fixed.PHONE_REGIONS[region]
            own = F.regexp_replace(digits, f"^(?:00)?{code}(?=(?:{national})$)", "")
            own = F.regexp_replace(own, f"^{trunk}(?=(?:{national})$)", "") if trunk else own
            method = f"e164_assumed_region({region})" if not k else f"e164_fallback_region({region})"
            out = out.when(plain & ~plus & own.rlike(f"^(?:{national})$"), result(F.concat(F.lit(f"+{code}"), own), True, "0.85" if not k else "0.70", F.lit(method), raw))
        return out.otherwise(result(t, False, "0.30", F.lit("unparseable_kept_as_is"), raw, F.concat(F.lit("Could not parse phone number: '"), t, F.lit("'"))))

    return _or_empty(raw, "phone", use)


def headline(raw: Column) -> Column:
    t = strip(raw)
    return F.when(F.coalesce(raw, F.lit("")) != "", result(t, True, "1.0", F.lit("direct_string"), raw))


def first_number(raw: Column) -> Column:
    """The first run of digits and points as a number, null if it isn't one."""
    return F.nullif(F.regexp_extract(raw, "[0-9.]+", 0), F.lit("")).try_cast("double")


def city_of(location: Column) -> Column:
    """The first part of a place that isn't blank, if it has under 50 characters; no casing."""
    parts = F.filter(F.transform(F.split(location, r"[,/|]+"), strip), lambda p: p != "")
    return bind(F.get(parts, F.lit(0)), lambda p: F.when(F.length(p) < 50, p))


def literal_map(table: dict[str, str]) -> Column:
    """A constant map, given as one text: the optimizer makes a literal of it, and until then it is one expression and not two per entry."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in sorted(table.items()))), F.lit("\u0001"), F.lit("\u0002"))


def country_table(spark) -> dict[str, dict[str, str]]:
    """alpha2, alpha3 and name (lower case) -> ISO code, by the JVM's table and the fixed further names; about 250 entries each."""
    locale = spark._jvm.java.util.Locale
    two, three, names = {}, {}, {}
    for code in locale.getISOCountries():
        at = locale("", code)
        two[code], three[at.getISO3Country()], names[at.getDisplayCountry(locale.ENGLISH).lower()] = code, code, code
    return {"two": two, "three": three, "names": names | fixed.OFFICIAL_COUNTRIES}


def normalize_country(raw: Column, table: dict[str, dict[str, str]], near: Column | None = None) -> Column:
    """ISO code of a country as typed: code, name, alias, then part by part of a place (name, alias, city), then fuzzy.

    near: struct <name, score> of the nearest name by functions.fuzzy, or null; without it the fuzzy step is left out.
    """
    two, three, names = (literal_map(table[k]) for k in ("two", "three", "names"))
    aliases, cities = literal_map(fixed.COUNTRY_ALIASES), literal_map(fixed.CITIES)

    def use(t: Column) -> Column:
        low, up = F.lower(t), F.upper(t)
        exact = lambda v, m: F.when(v.isNotNull(), result(v, True, "1.0", F.lit(m), raw))

        def part(p: Column) -> Column:
            q = F.lower(p)
            by_name, by_alias, by_city = F.try_element_at(names, q), F.try_element_at(aliases, q), F.try_element_at(cities, q)
            return (
                F.when(by_name.isNotNull(), result(by_name, True, "0.90", F.lit("location_string_split"), raw, F.concat(F.lit("Extracted country from location string: '"), p, F.lit("'"))))
                .when(by_alias.isNotNull(), result(by_alias, True, "0.90", F.lit("location_string_alias"), raw))
                .when(by_city.isNotNull(), result(by_city, True, "0.75", F.lit("city_to_country_inference"), raw, F.concat(F.lit("Inferred country from city: '"), p, F.lit("'"))))
            )

        parts = F.filter(F.transform(F.transform(F.split(t, r"[,/|]+"), strip), part), lambda r: r.isNotNull())
        none = result(F.lit(None).cast("string"), False, "0", F.lit("no_match_found"), raw, F.concat(F.lit("Could not resolve country from: '"), t, F.lit("'")))
        steps = [
            F.when(up.rlike("^[A-Z]{2}$"), exact(F.try_element_at(two, up), "direct_alpha2")), F.when(up.rlike("^[A-Z]{3}$"), exact(F.try_element_at(three, up), "alpha3_to_alpha2")),
            exact(F.try_element_at(names, low), "exact_country_name"), exact(F.try_element_at(aliases, low), "alias_lookup"), F.get(parts, F.lit(0)),
        ]
        if near is not None:
            code = F.try_element_at(names, near["name"])
            method = F.concat(F.lit("fuzzy_country_match(score="), F.format_string("%.1f", near["score"]), F.lit(")"))
            warning = F.concat(F.lit("Fuzzy-matched '"), t, F.lit("' → '"), near["name"], F.lit("' ("), code, F.lit(")"))
            steps.append(F.when(near.isNotNull(), result(code, True, "0.65", method, raw, warning)))
        return F.coalesce(*steps, none)

    return _or_empty(raw, "country", use)


def python_title(t: Column) -> Column:
    """t with the first letter of each run of letters capital and the others small."""
    runs = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def normalize_skill(raw: Column, near: Column | None = None, threshold: float = 82.0) -> Column:
    """The canonical skill of a spelling, by the fixed table, then fuzzily; an unknown one is kept in title case.

    near: struct <name (the nearest spelling), score> by functions.fuzzy, or null.
    """
    table = literal_map(fixed.SKILLS)

    def use(t: Column) -> Column:
        title = python_title(t)
        unknown = result(title, False, "0.60", F.lit("unknown_skill_kept_as_is"), raw, F.concat(F.lit("Skill '"), t, F.lit("' not in synonym dictionary; kept as '"), title, F.lit("'")))
        steps = [bind(F.try_element_at(table, F.lower(t)), lambda s: F.when(s.isNotNull(), result(s, True, "1.0", F.lit("exact_synonym_match"), raw)))]
        if near is not None:
            factor = F.least(F.lit(0.95), F.round(F.lit(0.85) + (near["score"] - threshold) / (100.0 - threshold) * 0.10, 3))
            method = F.concat(F.lit("fuzzy_match(score="), F.format_string("%.1f", near["score"]), F.lit(", alias='"), near["name"], F.lit("')"))
            steps.append(F.when(near.isNotNull(), result(F.try_element_at(table, near["name"]), True, factor, method, raw)))
        return F.coalesce(*steps, unknown)

    return _or_empty(raw, "skill", use)


def compare_key(c: Column) -> Column:
    """What two values are compared by: text in lower case without outer white space."""
    return F.lower(strip(c.cast("string")))


def candidate_id(email: Column) -> Column:
    """UUID of version 5 in the DNS name space for an address (lower case, trimmed); a random one without an address.

    Random ids change with every evaluation: write them once.
    """
    name = F.encode(F.lower(strip(email)), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), name))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    fixed_id = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(F.coalesce(strip(email), F.lit("")) != "", fixed_id).otherwise(F.uuid())
