"""Free-entered values mapped to a canonical list (problem 2), in SQL only.

Distinct values are matched, not rows. Each value has a few readings (decorations taken off, parts turned round), each
reference entry a few keys. Equal readings and keys match at once. The rest goes through a partition-based pigeonhole join:
a key of length L that may differ by k edits is cut into k + 1 segments, of which at least one must occur unchanged
in any reading within k edits, at a place that the lengths allow; so readings give, for each length and segment,
the substrings at the few places possible, and an equality join on (length, segment number, text) finds all candidates.
Spark's levenshtein verifies them. What has no match comes back through an anti-join.

The reference side is small in rows but of no proven size, so nothing is broadcast by hint; Spark broadcasts it where its
measured size is under the configured threshold, and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewell.runtime import cut, sql

# Accented letters and what they are without.
_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįıłľñńňòóôõöōőřśšşťùúûüūůűųýÿžźżđ"
_PLAIN = "aaaaaaaaacccdeeeeeeeegiiiiiiillnnnooooooorssstuuuuuuuuyyzzzd"
# Words for levels and practice around a skill.
_LEVELS = "basic|beginner|elementary|intermediate|advanced|expert|proficient|strong|good|fluent|senior|junior|certified|some"
_LEAD = rf"^(?:(?:{_LEVELS})|(?:working |basic |good |sound )?knowledge of|experienced? (?:in|with)|skilled in|[0-9]+(?:[.,][0-9]+)?\\s*\\+?\\s*(?:yrs?|years?|months?)\\.?(?: of)?(?: experience)?(?: in| with| of)?)\\s+"
_TAIL = rf"(?:\\s*[-–—:,;]\\s*(?:{_LEVELS}|legacy|self-taught|certified|[0-9]+\\s*\\+?\\s*(?:yrs?|years?))|\\s*[\"“][^\"”]*[\"”](?: edition)?|\\s+edition|\\s+(?:v\\s*)?[0-9]+(?:[.][0-9x]+)*|\\s+v[0-9]+(?:[.][0-9x]+)*|\\s*\\((?:{_LEVELS}|v?[0-9][^()]*|[^()]*[|;,][^()]*|(?:[^()]*[^a-z()])?(?:yrs?|years?)(?:[^a-z()][^()]*)?)\\)|\\s*[.,;:])$"
# Shortened words of place names.
_PLACE_WORDS = {
    "gr": "great", "gt": "great", "grt": "great", "pt": "port", "ft": "fort", "st": "saint", "ste": "sainte", "mt": "mount", "spgs": "springs",
    "spg": "spring", "sprgs": "springs", "jct": "junction", "jctn": "junction", "jn": "junction", "n": "north", "s": "south", "e": "east", "w": "west",
    "riv": "riviere", "is": "island", "hts": "heights", "hbr": "harbour", "nth": "north", "sth": "south", "lk": "lake", "cpe": "cape", "nw": "new",
    "fls": "falls", "crk": "creek", "ctr": "center", "vlg": "village", "bch": "beach", "brg": "bridge",
}
# Further names of countries, by code.
_COUNTRY_WORDS = {
    "GB": "uk|u k|great britain|britain|england|scotland|wales|gbr|royaume uni|grossbritannien|reino unido|angleterre",
    "US": "usa|u s a|u s|america|united states of america|states|etats unis|vereinigte staaten|estados unidos|amerika",
    "DE": "deutschland|allemagne|alemania|deu|ger|brd", "FR": "frankreich|francia|fra", "ES": "espana|espagne|spanien|esp", "IN": "bharat|ind|hindustan|inde|indien",
    "AU": "aussie|aus|oz|australien|australie|down under", "CA": "can|kanada", "IT": "italia|italie|italien", "NL": "holland|nederland|pays bas", "CH": "schweiz|suisse|svizzera",
    "AT": "oesterreich|osterreich|autriche", "MX": "mejico", "BR": "brasil|bresil", "JP": "japon|nippon", "CN": "chine", "PT": "portugal", "SE": "sverige|suede", "NO": "norge|norvege", "DK": "danmark", "PL": "polska|pologne",
}


def _fold(x: str) -> str:
    """SQL: x in lower case without accents."""
    return f"translate(replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), '{_ACCENTED}', '{_PLAIN}')"


def _expand(x: str) -> str:
    """SQL: x in lower case with umlauts written as two letters."""
    out = f"lower({x})"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("ø", "oe"), ("å", "aa"), ("æ", "ae"), ("ñ", "ny")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{_ACCENTED}', '{_PLAIN}')"


def _spelled(x: str) -> str:
    """SQL: x with its signs in words."""
    for sign, word in (("&", "and"), ("+", "plus"), ("#", "sharp"), ("@", "at")):
        x = f"replace({x}, '{sign}', ' {word} ')"
    return x


def _words(x: str) -> str:
    """SQL: the letters and digits of x, words apart by one blank."""
    return rf"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}0-9]+', ' '))"


def _allowed(n: str) -> str:
    """SQL: edits allowed for a key of length n."""
    return f"CASE WHEN {n} < 5 THEN 0 WHEN {n} < 10 THEN 2 ELSE 4 END"


_SEGMENTS = f"""
WITH sized AS (SELECT DISTINCT key, length(key) AS n, {_allowed('length(key)')} AS k FROM {{keys}} WHERE fuzzy),
cut AS (SELECT DISTINCT key, n, k, explode(sequence(0, k)) AS i FROM sized WHERE k > 0)
SELECT key, n, k, i, substring(key, CAST(floor(i * n / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT)) AS segment FROM cut
"""

# Of a reading with m letters, against keys with n: segment i, which begins at p, can only stand at p + d with
# |d| <= i and |d - (m - n)| <= k - i; otherwise an earlier or a later segment matches as well. The least key with edits has five
# letters, of which two may be missing; only lengths that keys have are looked for.
_PROBES = f"""
WITH sized AS (SELECT DISTINCT form, length(form) AS m FROM {{forms}}),
lengths AS (SELECT form, m, explode(sequence(greatest(5, m - 4), m + 4)) AS n FROM sized WHERE m > 2),
bounded AS (SELECT l.form, l.m, l.n, {_allowed('l.n')} AS k FROM lengths l LEFT SEMI JOIN {{sizes}} z ON l.n = z.n WHERE abs(l.m - l.n) <= {_allowed('l.n')}),
parts AS (SELECT *, explode(sequence(0, k)) AS i FROM bounded WHERE k > 0),
places AS (
  SELECT *, CAST(floor(i * n / (k + 1)) AS INT) AS p, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT) AS w,
    greatest(-i, m - n - (k - i)) AS low, least(i, m - n + (k - i)) AS high FROM parts),
shifted AS (SELECT form, n, i, p, w, m, explode(sequence(low, high)) AS d FROM places WHERE low <= high)
SELECT form, n, i, substring(form, p + d + 1, w) AS segment FROM shifted WHERE p + d >= 0 AND p + d + w <= m
"""

_CANDIDATES = "SELECT DISTINCT p.form, s.key FROM {probes} p JOIN {segments} s ON p.n = s.n AND p.i = s.i AND p.segment = s.segment"


def pigeonhole_pairs(spark: SparkSession, forms: DataFrame, keys: DataFrame) -> DataFrame:
    """(form, key, distance) of all forms within the edits that a key's length allows; exact and complete, whatever the length.

    forms: column form; keys: columns key and fuzzy. Null forms and forms of one or two letters, from which every key is too far, have no pair.
    """
    segments = sql(spark, _SEGMENTS, keys=keys)
    sizes = sql(spark, "SELECT DISTINCT length(key) AS n FROM {keys} WHERE fuzzy", keys=keys)
    probes = sql(spark, _PROBES, forms=forms, sizes=sizes)
    found = sql(spark, _CANDIDATES, probes=probes, segments=segments)
    return sql(spark, f"""
        SELECT form, key, distance FROM (
          SELECT form, key, levenshtein(form, key, {_allowed('length(key)')}) AS distance FROM {{found}}) WHERE distance >= 0""", found=found)


def _skill_forms(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(value, rank, form, words, short): the readings of each typed skill."""
    strip = rf"trim(regexp_replace(regexp_replace(%s, '{_TAIL}', ''), '{_LEAD}', ''))"
    cleaned = "t"
    for _ in range(3):
        cleaned = strip % cleaned
    return sql(spark, rf"""
        WITH low AS (SELECT value, {_fold(r"trim(regexp_replace(value, '(?U)\\s+', ' '))")} AS t FROM {{values}}),
        clean AS (SELECT value, t, {cleaned} AS c FROM low),
        turned AS (SELECT value, t, c,
          regexp_extract(c, '^([^,()]+?)\\s*,\\s*([^,()]+)$', 1) AS a1, regexp_extract(c, '^([^,()]+?)\\s*,\\s*([^,()]+)$', 2) AS b1,
          regexp_extract(c, '^([^()]+?)\\s*\\(([^()]+)\\)$', 1) AS a2, regexp_extract(c, '^([^()]+?)\\s*\\(([^()]+)\\)$', 2) AS b2,
          regexp_extract(c, '^(\\S+) of (\\S.*)$', 1) AS a3, regexp_extract(c, '^(\\S+) of (\\S.*)$', 2) AS b3 FROM clean),
        readings AS (SELECT value, t, inline(array(
          named_struct('rank', 0, 'r', t), named_struct('rank', 1, 'r', c), named_struct('rank', 2, 'r', if(a1 = '', NULL, concat(b1, ' ', a1))),
          named_struct('rank', 3, 'r', if(a2 = '', NULL, concat(b2, ' ', a2))), named_struct('rank', 4, 'r', if(a3 = '', NULL, concat(b3, ' ', a3))),
          named_struct('rank', 5, 'r', if(a2 = '', NULL, a2)))) FROM turned)
        SELECT value, rank, replace({_words('r')}, ' ', '') AS form, {_words('r')} AS words,
          regexp_extract(r, '^(?:([a-z]{{2,7}})\\.\\s+([a-z]+)|([a-z]+)\\s+([a-z]{{2,7}})\\.?)$', 1) AS left_short,
          regexp_extract(r, '^([a-z]{{2,7}})\\.\\s+([a-z]+)$', 2) AS right_word,
          regexp_extract(r, '^([a-z]+)\\s+([a-z]{{2,7}})$', 1) AS left_word, if(rank = 1 AND t RLIKE '[.]', regexp_extract(r, '^([a-z]+)\\s+([a-z]{{2,7}})$', 2), '') AS right_short
        FROM readings WHERE r IS NOT NULL AND {_words('r')} <> ''""", values=values)


def match_skills(spark: SparkSession, values: DataFrame, skill_ref: DataFrame) -> DataFrame:
    """(value, ref_id) for every distinct typed skill; ref_id -1 for none."""
    names = sql(spark, rf"""
        SELECT skill_id AS ref_id, {_words(_fold('name'))} AS words, true AS fuzzy FROM {{ref}} WHERE name IS NOT NULL AND skill_id IS NOT NULL
        UNION ALL SELECT skill_id, {_words(_fold(_spelled('name')))}, true FROM {{ref}} WHERE name RLIKE '[&+#@]' AND skill_id IS NOT NULL
        UNION ALL SELECT skill_id, {_words(_fold("replace(name, '+', 'p')"))}, true FROM {{ref}} WHERE name LIKE '%+%' AND skill_id IS NOT NULL
        UNION ALL SELECT skill_id, {_words(_fold('a'))}, length(a) > 5 FROM (SELECT skill_id, explode(aliases) AS a FROM {{ref}}) WHERE a IS NOT NULL""", ref=skill_ref)
    # The first word of a longer name stands for it if no other entry begins so.
    keys = sql(spark, """
        WITH firsts AS (SELECT min(ref_id) AS ref_id, split_part(words, ' ', 1) AS w FROM {names} GROUP BY 2 HAVING count(DISTINCT ref_id) = 1),
        heads AS (SELECT f.ref_id, f.w FROM firsts f JOIN {names} n ON n.ref_id = f.ref_id AND n.words LIKE concat(f.w, ' %') WHERE length(f.w) >= 4)
        SELECT replace(words, ' ', '') AS key, words, min(ref_id) AS ref_id, bool_or(fuzzy) AS fuzzy, 0 AS weak FROM {names} WHERE words <> '' GROUP BY 1, 2
        UNION ALL SELECT h.w, h.w, min(h.ref_id), true, 1 FROM heads h LEFT ANTI JOIN {names} n ON h.w = replace(n.words, ' ', '') GROUP BY h.w""", names=names)
    # Keys and readings are used several times below.
    keys, forms = cut(keys), cut(_skill_forms(spark, values))
    exact = sql(spark, "SELECT f.value, k.ref_id, 0 AS tier, f.rank AS distance, 0 AS odd FROM {forms} f JOIN {keys} k ON f.form = k.key WHERE f.rank < 5", forms=forms, keys=keys)
    # Abbreviated words end with a full stop: equality on the other word and on the letters given.
    shorts = sql(spark, """
        WITH pairs AS (SELECT ref_id, split_part(words, ' ', 1) AS a, split_part(words, ' ', 2) AS b FROM {keys} WHERE weak = 0 AND words RLIKE '^[a-z]+ [a-z]+$'),
        lettered AS (SELECT *, explode(sequence(2, 7)) AS n FROM pairs)
        SELECT ref_id, concat('l:', substring(a, 1, n), ':', b) AS short FROM lettered WHERE n < length(a)
        UNION ALL SELECT ref_id, concat('r:', a, ':', substring(b, 1, n)) FROM lettered WHERE n < length(b)""", keys=keys)
    short_forms = sql(spark, """
        SELECT value, rank, concat('l:', left_short, ':', right_word) AS short FROM {forms} WHERE left_short <> '' AND right_word <> ''
        UNION ALL SELECT value, rank, concat('r:', left_word, ':', right_short) FROM {forms} WHERE left_word <> '' AND right_short <> ''""", forms=forms)
    abbreviated = sql(spark, "SELECT f.value, s.ref_id, 1 AS tier, f.rank AS distance, 0 AS odd FROM {f} f JOIN {s} s ON f.short = s.short", f=short_forms, s=shorts)
    settled = cut(exact.unionByName(abbreviated))
    left = cut(sql(spark, "SELECT f.* FROM {forms} f LEFT ANTI JOIN {s} s ON f.value = s.value WHERE f.rank BETWEEN 1 AND 4", forms=forms, s=settled))
    pairs = pigeonhole_pairs(spark, left, keys)
    # Over two edits count only where both words have at most two each: more would make another word of one.
    fuzzy = sql(spark, """
        SELECT f.value, k.ref_id, 2 AS tier, p.distance, CASE WHEN array_sort(split(f.form, '')) = array_sort(split(k.key, '')) THEN 0 ELSE 1 END AS odd
        FROM {pairs} p JOIN {left} f ON f.form = p.form JOIN {keys} k ON k.key = p.key
        WHERE k.fuzzy AND (p.distance <= 2 AND (weak = 0 OR length(k.key) >= 6) AND (p.distance <= 1 OR length(k.key) >= 6 OR array_sort(split(f.form, '')) = array_sort(split(k.key, ''))) OR (
          f.words RLIKE '^\\\\S+ \\\\S+$' AND k.words RLIKE '^\\\\S+ \\\\S+$'
          AND levenshtein(split_part(f.words, ' ', 1), split_part(k.words, ' ', 1), 2) >= 0
          AND levenshtein(split_part(f.words, ' ', 2), split_part(k.words, ' ', 2), 2) >= 0))""", pairs=pairs, left=left, keys=keys)
    return _resolved(spark, values, settled, fuzzy)


def _resolved(spark: SparkSession, values: DataFrame, *found: DataFrame) -> DataFrame:
    """(value, ref_id): the best match of each value, and -1 by anti-join for the values without any."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # Read twice below, by the union and by the anti-join.
    best = sql(spark, "SELECT value, min_by(ref_id, struct(tier, distance, odd, ref_id)) AS ref_id FROM {every} GROUP BY value", every=every)
    best = cut(best)
    return sql(spark, """
        SELECT value, CAST(ref_id AS BIGINT) AS ref_id FROM {best}
        UNION ALL SELECT v.value, CAST(-1 AS BIGINT) FROM {values} v LEFT ANTI JOIN {best} b ON v.value = b.value""", best=best, values=values)


def country_words(spark: SparkSession) -> DataFrame:
    """(word, code): the ways to write each country, from the JVM's ISO table and the fixed further names."""
    locale = spark._jvm.java.util.Locale
    rows = set()
    for code in locale.getISOCountries():
        at = locale("", code)
        rows |= {(code.lower(), code), (at.getISO3Country().lower(), code), (at.getDisplayCountry(locale.ENGLISH).lower(), code)}
    rows |= {(w, code) for code, words in _COUNTRY_WORDS.items() for w in words.split("|")}
    table = spark.createDataFrame(sorted(rows), "w string, code string")
    return sql(spark, f"SELECT DISTINCT {_words(_fold('w'))} AS word, code FROM {{t}}", t=table)


def match_places(spark: SparkSession, values: DataFrame, location_ref: DataFrame) -> DataFrame:
    """(value, ref_id) for every distinct typed place; ref_id -1 for none.

    A cell's parts (between commas, slashes, bars, brackets and spaced dashes, or before a country at the end) are read as
    towns; a country or state that the cell names must be the town's. Of several towns with equal claims
    the one with the smallest id is taken.
    """
    words = country_words(spark)
    parts = sql(spark, rf"""
        WITH low AS (SELECT value, regexp_replace(lower(value), '(?U)\\s+', ' ') AS t FROM {{values}}),
        cut AS (SELECT value, posexplode(split(t, '[,/|();]|\\s[-–—]\\s')) AS (pos, p) FROM low),
        bare AS (SELECT value, pos, trim(regexp_replace(regexp_replace(regexp_replace(p, '[0-9]+', ' '),
          '^\\s*(?:near|around|greater|in|at|city of|town of|outskirts of|close to|nr\\.?)\\s+', ''), '\\s+(?:metro(?:politan)?(?: area)?|area|region|city|and surroundings)\\s*$', '')) AS p FROM cut)
        SELECT value, pos, {_words(_fold('p'))} AS p FROM bare
        UNION SELECT value, pos, {_words(_expand('p'))} AS p FROM bare""", values=values)
    parts = cut(parts)
    # A part may end with a country in one, two or three words.
    tails = sql(spark, """
        WITH split_parts AS (SELECT value, pos, p, split(p, ' ') AS w FROM {parts} WHERE p <> ''),
        tailed AS (SELECT value, pos, p, w, explode(sequence(0, least(3, size(w)))) AS n FROM split_parts)
        SELECT value, pos, array_join(slice(w, 1, size(w) - n), ' ') AS head, if(n = 0, NULL, array_join(slice(w, size(w) - n + 1, n), ' ')) AS tail FROM tailed""", parts=parts)
    named = sql(spark, "SELECT DISTINCT t.value, t.pos, t.head, c.code FROM {tails} t JOIN {words} c ON t.tail = c.word", tails=tails, words=words)
    ref = sql(spark, "SELECT location_id AS ref_id, city, state, country_code, country, aliases FROM {ref} WHERE location_id IS NOT NULL", ref=location_ref)
    states = sql(spark, f"SELECT DISTINCT {_words(_fold('state'))} AS word, country_code AS code FROM {{ref}} WHERE state IS NOT NULL", ref=ref)
    cell_states = sql(spark, "SELECT DISTINCT p.value, s.word, s.code FROM {parts} p JOIN {states} s ON p.p = s.word", parts=parts, states=states)
    named = cut(named)
    countries = sql(spark, "SELECT value, collect_set(code) AS codes FROM {named} WHERE head = '' OR length(head) > 2 GROUP BY value", named=named)
    heads = sql(spark, "SELECT value, p AS words FROM {parts} WHERE p <> '' UNION SELECT value, head FROM {named} WHERE head <> ''", parts=parts, named=named)
    short = spark.createDataFrame([*_PLACE_WORDS.items(), ("gr", "grand")], "short string, long string")
    # Shortened words are spelled out: of each reading with one, a further reading per meaning.
    spelled = sql(spark, """
        WITH w AS (SELECT value, words, posexplode(split(words, ' ')) AS (i, word) FROM {heads}),
        longer AS (SELECT w.value, w.words, w.i, s.long FROM w JOIN {short} s ON w.word = s.short)
        SELECT value, words FROM {heads}
        UNION SELECT value, array_join(transform(split(words, ' '), (x, j) -> if(j = i, long, x)), ' ') FROM longer""", heads=heads, short=short)
    forms = cut(sql(spark, "SELECT DISTINCT value, replace(words, ' ', '') AS form FROM {spelled}", spelled=spelled))
    keys = sql(spark, f"""
        WITH named AS (SELECT ref_id, city AS name FROM {{ref}} UNION ALL SELECT ref_id, explode(aliases) FROM {{ref}})
        SELECT DISTINCT ref_id, replace({_words(_fold('name'))}, ' ', '') AS key, true AS fuzzy FROM named WHERE name IS NOT NULL
        UNION SELECT DISTINCT ref_id, replace({_words(_expand('name'))}, ' ', ''), true FROM named WHERE name IS NOT NULL""", ref=ref)
    keys = cut(keys)
    # The name of a country or a state alone isn't a town, unless a town has just that name.
    no_town = sql(spark, "SELECT word FROM {words} WHERE length(word) > 3 UNION SELECT word FROM {states}", words=words, states=states)
    exact = cut(sql(spark, "SELECT f.value, k.ref_id, 0 AS tier, 0 AS distance, 0 AS odd FROM {forms} f JOIN {keys} k ON f.form = k.key", forms=forms, keys=keys))
    left = cut(sql(spark, """
        SELECT f.* FROM {forms} f LEFT ANTI JOIN {exact} e ON f.value = e.value
        LEFT ANTI JOIN {no_town} n ON f.form = replace(n.word, ' ', '')""", forms=forms, exact=exact, no_town=no_town))
    pairs = pigeonhole_pairs(spark, left, keys)
    fuzzy = sql(spark, """
        SELECT f.value, k.ref_id, 1 AS tier, p.distance, CASE WHEN array_sort(split(f.form, '')) = array_sort(split(k.key, '')) THEN 0 ELSE 1 END AS odd
        FROM {pairs} p JOIN {left} f ON f.form = p.form JOIN {keys} k ON k.key = p.key
        WHERE p.distance <= CASE WHEN length(k.key) >= 15 THEN 3 WHEN length(k.key) >= 6 OR array_sort(split(f.form, '')) = array_sort(split(k.key, '')) THEN 2 ELSE 1 END""", pairs=pairs, left=left, keys=keys)
    found = exact.unionByName(fuzzy)
    checked = sql(spark, f"""
        SELECT f.value, f.ref_id, f.tier, f.distance, f.odd, r.country_code, {_words(_fold('r.state'))} AS state FROM {{found}} f JOIN {{ref}} r ON f.ref_id = r.ref_id""", found=found, ref=ref)
    kept = sql(spark, """
        WITH in_country AS (
          SELECT f.*, c.codes FROM {checked} f LEFT JOIN {countries} c ON f.value = c.value WHERE c.codes IS NULL OR array_contains(c.codes, f.country_code)),
        by_state AS (SELECT f.*, s.word IS NOT NULL AS same FROM in_country f LEFT JOIN {cell_states} s ON f.value = s.value AND f.state = s.word)
        SELECT value, ref_id, tier, distance, odd + if(same, 0, 2) AS odd FROM by_state""", checked=checked, countries=countries, cell_states=cell_states)
    best = sql(spark, "SELECT value, ref_id, tier, distance, odd FROM {kept}", kept=kept)
    return _resolved(spark, values, best)


def canonical_values(candidates: DataFrame, recruiters: DataFrame, skill_ref: DataFrame, location_ref: DataFrame) -> DataFrame:
    """(field, record_id, pos, ref_id): the entry that each typed skill and place stands for, -1 if there is none.

    One row per member of raw_candidate.skills and per recruiter.location cell that isn't null or blank; blank
    members are counted in pos. Null arrays, empty arrays and empty tables give no row; repeated rows stay. Only the columns
    named are read. Each distinct value is matched once; rows meet their value's result in one join, whose hot
    values Spark splits at run time (adaptive skew join).
    """
    spark = candidates.sparkSession
    skills = sql(spark, r"""
        SELECT 'skills' AS field, CAST(raw_id AS BIGINT) AS record_id, CAST(pos AS BIGINT) AS pos, value FROM (SELECT raw_id, posexplode(skills) AS (pos, value) FROM {t})
        WHERE value RLIKE '(?U)\\S'""", t=candidates)
    places = sql(spark, r"SELECT 'location' AS field, CAST(row_id AS BIGINT) AS record_id, CAST(0 AS BIGINT) AS pos, location AS value FROM {t} WHERE location RLIKE '(?U)\\S'", t=recruiters)
    out = []
    for rows, match, ref in ((skills, match_skills, skill_ref), (places, match_places, location_ref)):
        # Matching reads the distinct values several times: they are written once, to the shared checkpoint folder.
        values = cut(rows.select("value").distinct())
        matched = match(spark, values, ref)
        out.append(sql(spark, "SELECT r.field, r.record_id, r.pos, m.ref_id FROM {rows} r JOIN {m} m ON r.value = m.value", rows=rows, m=matched))
    return out[0].unionByName(out[1])
