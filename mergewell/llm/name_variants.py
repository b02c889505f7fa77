"""Spellings of one person's name in different rows (problem 6).

Names meet where rows share something: a contact (an address, a number, a profile) or, for rows without a contact in common, the
town and the headline together; call that a place of meeting. Names that meet at a place of few names are compared in one task
(local_names). At larger ones they are joined by pigeonhole segments: every part of a
name that may differ by k edits is cut into k + 1 segments, which form an inverted index by (place, length, segment number, text);
each part looks up the substrings at the places to which k edits can shift a segment. Two parts within k edits always share one.
A swap of two letters across a cut would break both segments, so the index also holds each part with that swap; full forms of
short names and halves of double names are parts, too, and a missing blank is found by the segments of the whole name.

From alike parts the names follow by equality: a name's pairs of parts, each part replaced by those like it, meet the pairs of
other names. So only names that have two parts in common, or a part and an initial, are ever compared, by banded edit
distance; bearers of one common given name don't meet. Rows tied by agreeing names form a graph, whose components are the persons.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mergewell.llm import names
from mergewell.llm.components import components
from mergewell.llm.contacts import SHARED_ABOVE, email_key, local_key, phone_key, profile_key
from mergewell.llm.local_names import ALL_PAIRS, LOCAL_NAMES, OVER, local_pairs, tied_rows
from mergewell.runtime import cut, sql

#: How alike two names must be (names.likeness) to be one person's, by what ties them.
NEEDED = {"email": 1, "local": 2, "phone": 2, "profile": 1, "copy": 1}


def with_names(df: DataFrame, column: str = "full_name") -> DataFrame:
    """df with ``name``, the canonical form of a typed name; equal strings are read once per batch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            d = b.dictionary_encode()
            yield pa.DictionaryArray.from_arrays(d.indices, pa.array([names.canonical(x) for x in d.dictionary.to_pylist()], pa.string())).dictionary_decode()

    read = F.arrow_udf(run, "string")
    return df.withColumn("name", read(F.col(column).cast("string")))


def _edits(form: str, n: str) -> str:
    """SQL: edits allowed for a form of length n; a whole name (it begins with =) may have two."""
    return f"CASE WHEN {form} LIKE '=%' THEN 2 WHEN {n} < 3 THEN 0 WHEN {n} < 8 THEN 1 ELSE 2 END"


# Places of meeting stand here as hashes, so that the many probes stay short; the join back compares the contacts themselves.
# A whole name without blanks is a part that begins with =, and so is that of the first and the last part.
_PARTS = """
WITH split_names AS (SELECT contact, split(name, ' ') AS w FROM {names}),
wholes AS (SELECT contact, w, concat('=', replace(array_join(w, ''), '-', '')) AS whole,
  concat('=', replace(concat(w[0], element_at(w, -1)), '-', '')) AS ends FROM split_names)
SELECT contact, part, bool_or(probes) AS probes FROM (
  SELECT contact, explode(w) AS part, true AS probes FROM wholes
  UNION ALL SELECT contact, whole, size(w) <> 2 FROM wholes WHERE length(whole) > 6
  UNION ALL SELECT contact, ends, true FROM wholes WHERE size(w) > 2 AND length(ends) > 6) GROUP BY contact, part
"""
_FORMS = """
WITH bare AS (SELECT contact, part, probes, replace(part, '-', '') AS form FROM {parts} WHERE length(part) > 1)
SELECT contact, part, probes, form FROM bare
UNION SELECT contact, part, probes, half FROM (SELECT contact, part, probes, explode(split(part, '-')) AS half FROM {parts} WHERE part LIKE '%-%' AND part NOT LIKE '=%') WHERE length(half) > 3
UNION SELECT b.contact, b.part, b.probes, n.full FROM bare b JOIN {nicknames} n ON b.form = n.short
"""
# Version 0 of a form is itself, version j has the letters at the j-th cut swapped, which changes the two segments there.
_INDEX = f"""
WITH sized AS (SELECT contact, part, form, length(form) AS n, {_edits('form', 'length(form)')} AS k FROM {{forms}}),
versions AS (SELECT contact, part, form, n, k, posexplode(transform(sequence(0, k), j -> CASE WHEN j = 0 THEN form ELSE
  overlay(form PLACING reverse(substring(form, CAST(floor(j * n / (k + 1)) AS INT), 2)) FROM CAST(floor(j * n / (k + 1)) AS INT)) END)) AS (j, version) FROM sized),
cuts AS (SELECT contact, part, form, n, k, version, explode(CASE WHEN j = 0 THEN sequence(0, k) ELSE sequence(j - 1, j) END) AS i FROM versions WHERE j = 0 OR version <> form)
SELECT xxhash64(contact, n, i, left(form, 1) = '=', substring(version, CAST(floor(i * n / (k + 1)) AS INT) + 1,
  CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT))) AS at, contact, part, form FROM cuts
UNION ALL SELECT xxhash64(contact, 'start of', form), contact, part, '' FROM {{forms}} WHERE length(form) > 2 AND form NOT LIKE '=%' AND form = replace(part, '-', '')
"""
# The places of a segment follow from the lengths, as in a partition-based join. Of two parts the longer one looks up the shorter.
_PROBE = f"""
WITH lengths AS (SELECT *, length(form) AS m, explode(sequence(greatest(2, length(form) - 2), length(form) + CASE WHEN form LIKE '=%' THEN 2 ELSE 0 END)) AS n FROM {{forms}} WHERE probes),
sized AS (SELECT *, {_edits('form', 'n')} AS k FROM lengths),
bounded AS (SELECT *, explode(sequence(0, k)) AS i FROM sized WHERE abs(m - n) <= k),
placed AS (SELECT *, CAST(floor(i * n / (k + 1)) AS INT) AS p, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT) AS w,
  greatest(-i, m - n - (k - i)) AS low, least(i, m - n + (k - i)) AS high FROM bounded),
shifted AS (SELECT *, explode(sequence(low, high)) AS d FROM placed WHERE low <= high)
SELECT xxhash64(contact, n, i, left(form, 1) = '=', substring(form, p + d + 1, w)) AS at, contact, part, form FROM shifted WHERE p + d >= 0 AND p + d + w <= m
UNION ALL SELECT xxhash64(contact, 'start of', left(form, n)), contact, part, '' FROM (
  SELECT contact, part, form, explode(sequence(3, length(form) - 1)) AS n FROM {{forms}} WHERE length(form) > 3 AND form NOT LIKE '=%' AND form = replace(part, '-', ''))
"""
# A swap of letters is two edits to levenshtein and one to the comparison that follows.
_NEAR = """
WITH met AS (SELECT s.contact, s.part AS x, p.part AS y FROM {index} s JOIN {probe} p ON s.at = p.at AND s.contact = p.contact
  WHERE s.part <> p.part AND (s.form = '' OR levenshtein(s.form, p.form, 4) >= 0)),
both_ways AS (SELECT contact, inline(array(named_struct('x', x, 'y', y), named_struct('x', y, 'y', x))) FROM met)
SELECT contact, x, y FROM both_ways UNION SELECT contact, part, part FROM {parts} UNION SELECT contact, '', '' FROM {parts}
"""
# The pairs of a name's parts in their order; a whole name has an empty partner.
_PAIRS = """
WITH split_names AS (SELECT contact, name, split(name, ' ') AS w FROM {names}),
firsts AS (SELECT contact, name, w, posexplode(w) AS (i, p) FROM split_names),
wholes AS (SELECT contact, name, w, explode(array_distinct(array(concat('=', replace(array_join(w, ''), '-', '')), concat('=', replace(concat(w[0], element_at(w, -1)), '-', ''))))) AS p FROM split_names)
SELECT contact, name, p, explode(slice(w, i + 2, size(w))) AS q FROM firsts
UNION ALL SELECT contact, name, p, '' FROM wholes WHERE length(p) > 6
"""


def nicknames(spark: SparkSession) -> DataFrame:
    """(short, full): the fixed table of short forms of given names."""
    rows = [(s, full) for full, shorts in names.NICKNAMES.items() for s in shorts.split()]
    return spark.createDataFrame(rows, "short string, full string")


def near_parts(named: DataFrame) -> DataFrame:
    """(contact, x, y): parts of names that meet in a contact and are alike, in both directions, and every part with itself."""
    spark = named.sparkSession
    parts = cut(sql(spark, _PARTS, names=named))
    forms = cut(sql(spark, _FORMS, parts=parts, nicknames=nicknames(spark)))
    return cut(sql(spark, _NEAR, index=sql(spark, _INDEX, forms=forms), probe=sql(spark, _PROBE, forms=forms), parts=parts))


def alike_names(named: DataFrame, near: DataFrame) -> DataFrame:
    """(contact, name_a, name_b), name_a < name_b: names that meet and have two alike parts, an alike part and an initial, or the
    same letters with blanks elsewhere. named: contact, name, made distinct; near: their near_parts."""
    spark = named.sparkSession
    pairs = sql(spark, _PAIRS, names=named)
    # Initials stand for themselves on one side, and for every part that begins so on the other.
    turned = sql(spark, """
        SELECT DISTINCT contact, name, t[0] AS p, t[1] AS q FROM (SELECT contact, name, explode(array(array(p, q), array(q, p), array(left(p, 1), q), array(q, left(p, 1)), array(p, left(q, 1)), array(left(q, 1), p))) AS t FROM {pairs})
        WHERE t[0] <> '' AND t[0] <> '='""", pairs=pairs)  # fmt: skip
    return sql(spark, """
        SELECT DISTINCT l.contact, least(l.name, r.name) AS name_a, greatest(l.name, r.name) AS name_b
        FROM {pairs} l JOIN {x} x ON l.contact = x.contact AND l.p = x.x JOIN {y} y ON l.contact = y.contact AND l.q = y.x
        JOIN {turned} r ON r.contact = l.contact AND r.p = x.y AND r.q = y.y WHERE l.name <> r.name""", pairs=pairs, x=near, y=near, turned=turned)  # fmt: skip


def one_part_names(named: DataFrame, near: DataFrame) -> DataFrame:
    """(contact, name_a, name_b), name_a < name_b: names that meet and have at least one part in common."""
    of = sql(named.sparkSession, "SELECT contact, name, part FROM (SELECT contact, name, explode(split(name, ' ')) AS part FROM {n}) WHERE length(part) > 1", n=named)
    return sql(named.sparkSession, """
        SELECT DISTINCT a.contact, a.name AS name_a, b.name AS name_b FROM {a} a JOIN {near} n ON a.contact = n.contact AND a.part = n.x
        JOIN {b} b ON b.contact = n.contact AND b.part = n.y WHERE a.name < b.name""", a=of, b=of, near=near)  # fmt: skip


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (name_a, name_b, ...) with ``like``, by banded edit distance of their parts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([names.likeness(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return pairs.withColumn("like", F.arrow_udf(run, "int")("name_a", "name_b"))


def agreeing(named: DataFrame, least: int = 2, local: int = LOCAL_NAMES) -> DataFrame:
    """(contact, name_a, name_b, like), name_a < name_b: the names that meet and whose likeness is least (2 or more) or more.

    named: contact, name, made distinct. Contacts of up to ``local`` names are looked at in one task each, without an index in shuffles.
    """
    found = cut(local_pairs(named, least, local))
    over = found.filter(F.col("like") == OVER).select("contact")
    found = found.filter(F.col("like") != OVER)
    if over.isEmpty():
        return found
    many = cut(named.select("contact", "name").join(over, "contact", "left_semi"))
    return found.unionByName(cut(compared(alike_names(many, near_parts(many))).filter(F.col("like") >= least)))


def shared_contacts(named: DataFrame, alike: DataFrame) -> DataFrame:
    """(contact): contacts of more than SHARED_ABOVE groups of alike names.

    named: contact, name, made distinct; alike: contact, name_a, name_b, like of their pairs. A name of several parts opens a
    group if no smaller name at the contact is like it, so the spellings of one person, however many, are one.
    """
    led = alike.filter("like >= 2").select("contact", F.col("name_b").alias("name"))
    each = named.filter("name like '% %'").select("contact", "name", F.lit(1).alias("n")).unionByName(led.distinct().select("contact", "name", F.lit(-1).alias("n")))
    # A name that something leads doesn't open a group: its row is taken away again.
    opened = each.filter("name like '% %'").groupBy("contact").agg(F.sum("n").alias("groups"))
    return cut(opened.filter(F.col("groups") > SHARED_ABOVE).select("contact"))


def recruiter_entries(recruiters: DataFrame) -> DataFrame:
    """(id, name, email, phone, profile, towns, places, contacts array<struct<kind, key>>) of each row with a readable name."""
    cells = ["full_name", "email", "phone", "linkedin_url", "location", "headline"]
    rows = with_names(recruiters.select("row_id", *cells)).filter("name is not null and row_id is not null")
    # The same row delivered twice: all cells are equal, and more than the name is there.
    filled = sum((F.col(c).isNotNull().cast("int") for c in cells), F.lit(0))
    headline = F.lower(F.trim("headline"))
    keyed = rows.select(
        F.col("row_id").cast("long").alias("id"), "name", F.when(filled > 1, F.hex(F.xxhash64(*cells))).alias("copy"), "location", headline.alias("headline"),
        email_key(F.col("email")).alias("email"), local_key(F.col("email")).alias("local"), phone_key(F.col("phone")).alias("phone"), profile_key(F.col("linkedin_url")).alias("profile"),
    )
    # An address cut short ties rows whose headlines are the same, too.
    local = F.when(F.col("local").isNotNull() & F.col("headline").isNotNull(), F.concat_ws("|", "local", "headline"))
    # Towns are written in many ways, so the parts of a cell meet by their first and by their last letters; whether they are alike is looked at later.
    parts = F.split(F.lower("location"), r"[,/|()]|\s[-–]\s")
    plain = F.transform(parts, lambda p: F.regexp_replace(F.translate(p, "àáâãäåçèéêëìíîïñòóôõöøùúûüý", "aaaaaaceeeeiiiinoooooouuuuy"), r"^\s*(?:near|greater)\s+|[^\p{L}]", ""))
    towns = F.array_distinct(F.filter(plain, lambda p: F.length(p) > 2))
    ends = F.array_distinct(F.flatten(F.transform(towns, lambda p: F.array(F.left(p, F.lit(4)), F.right(p, F.lit(4))))))
    meeting = F.transform(ends, lambda p: F.concat_ws("|", p, "headline"))
    ways = {"email": F.col("email"), "local": local, "phone": F.col("phone"), "profile": F.col("profile"), "copy": F.col("copy")}
    contacts = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in ways.items()))
    return keyed.select("id", "name", F.col("email").isNotNull().alias("email"), F.col("phone").isNotNull().alias("phone"), F.col("profile").isNotNull().alias("profile"),
                        towns.alias("towns"), F.when(F.col("headline").isNotNull(), meeting).alias("places"), F.filter(contacts, lambda c: c["key"].isNotNull()).alias("contacts"))


def met_names(hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, shared): kind, key, name_a, name_b, like of the names of hubs (kind, key, name) that agree at a contact, and kind, key of
    the contacts that many people share.

    Which contacts are shared follows from the names with two parts in common. Only at the others, and only where one part is enough, do
    names with one part in common meet. Contacts with the same set of names (address, number and profile of one person often are) are
    looked at once: the set is known by its size and two sums of hashes.
    """
    hubs = hubs.withColumn("contact", F.xxhash64("kind", "key"))
    digest = F.xxhash64("name")
    sets = hubs.groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("x"), F.sum(F.xxhash64("name", F.lit(1)).cast("decimal(38,0)")).alias("s"), F.any_value("kind").alias("kind"))
    enough = F.col("kind").isin([k for k, n in NEEDED.items() if n == 1])
    sets = cut(sets.filter("n > 1").select("contact", "n", "x", "s", enough.alias("weak")))
    first = sets.groupBy("n", "x", "s", "weak").agg(F.min("contact").alias("first"))
    by_set = cut(sets.join(first, ["n", "x", "s", "weak"]).select("contact", "first", "weak"))
    one = by_set.filter("contact = first").select("contact", "weak")
    some = cut(hubs.join(one, "contact").select("contact", "name", "weak"))
    named = some.select("contact", "name")
    found = cut(local_pairs(named, 1, ALL_PAIRS))
    over = found.filter(F.col("like") == OVER).select("contact")
    pairs = found.filter(F.col("like") != OVER)
    larger = not over.isEmpty()
    if larger:
        rest = cut(named.join(over, "contact", "left_semi"))
        pairs = pairs.unionByName(agreeing(rest))
    shared = shared_contacts(named, pairs)
    if larger:
        weak = cut(some.filter("weak").select("contact", "name").join(over, "contact", "left_semi").join(shared, "contact", "left_anti"))
        if not weak.isEmpty():
            pairs = pairs.unionByName(compared(one_part_names(weak, near_parts(weak))).filter("like = 1"))
    pairs = pairs.withColumnRenamed("contact", "first")
    keys = hubs.select("contact", "kind", "key").distinct().join(by_set.select("contact", "first"), "contact").select("first", "kind", "key")
    return pairs.join(keys, "first").select("kind", "key", "name_a", "name_b", "like"), shared.withColumnRenamed("contact", "first").join(keys, "first").select("kind", "key")


def same_person(recruiters: DataFrame) -> DataFrame:
    """(row_id, person): rows with a readable name and the person (its smallest row) that they name.

    Rows of one name at a contact are tied to the smallest of them, and those to each other where their names agree; at a contact that
    many people share only whole names of several parts do. Persons without a contact in common are then tied where town,
    headline and whole name agree, nothing contradicts (not both have an address, a number or a profile), and only one qualifies.
    Rows without any contact stand alone. Repeated rows and ties change nothing; columns other than those of the
    contacts and full_name aren't read; an empty table gives an empty result.
    """
    spark = recruiters.sparkSession
    rows = cut(recruiter_entries(recruiters))
    entries = rows.select("id", "name", F.inline("contacts"))
    # Contacts of few names and rows are looked at in one task each, larger ones through tables.
    needed = F.lit(99)
    for kind, n in NEEDED.items():
        needed = F.when(F.col("kind") == kind, n).otherwise(needed)
    entries = entries.withColumn("contact", F.xxhash64("kind", "key"))
    tied = cut(tied_rows(entries.withColumn("need", needed), ALL_PAIRS, SHARED_ABOVE))
    over = tied.filter("a is null").select("contact")
    edges = tied.filter("a is not null").select("a", "b")
    if n := over.count():
        # Few contacts (2 MB at most) go to the entries instead of the other way round.
        edges = edges.unionByName(_tied(cut(entries.join(F.broadcast(over) if n <= 100_000 else over, "contact", "left_semi").drop("contact"))))
    found = components(edges.distinct())
    persons = cut(rows.join(found, rows["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("person"), "name", "email", "phone", "profile", "towns", "places"))
    merged = components(_attached(persons))
    return persons.join(merged, persons["person"] == merged["node"], "left").select(F.col("id").alias("row_id"), F.coalesce("component", "person").alias("person"))


def _tied(entries: DataFrame) -> DataFrame:
    """(a, b): what local_names.tied_rows gives, of contacts of any size. entries: id, name, kind, key."""
    spark = entries.sparkSession
    hubs = cut(entries.groupBy("kind", "key", "name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    pairs, shared = (cut(x) for x in met_names(hubs.select("kind", "key", "name")))
    own = sql(spark, """
        SELECT e.id AS a, h.rep AS b FROM {e} e JOIN {h} h ON e.kind = h.kind AND e.key = h.key AND e.name = h.name
        LEFT JOIN {s} s ON e.kind = s.kind AND e.key = s.key WHERE e.id <> h.rep AND (s.key IS NULL OR e.name LIKE '% %')""", e=entries, h=hubs.filter("n > 1"), s=shared)  # fmt: skip
    least = F.lit(99)
    for kind, n in NEEDED.items():
        least = F.when(F.col("kind") == kind, n).otherwise(least)
    whole = (F.col("like") >= 3) & F.expr("name_a like '% %' or name_b like '% %'")
    agreed = pairs.join(shared.withColumn("shared", F.lit(True)), ["kind", "key"], "left").filter(F.when(F.col("shared"), whole).otherwise(F.col("like") >= least))
    across = sql(spark, """
        SELECT x.rep AS a, y.rep AS b FROM {p} p JOIN {x} x ON p.kind = x.kind AND p.key = x.key AND p.name_a = x.name
        JOIN {y} y ON p.kind = y.kind AND p.key = y.key AND p.name_b = y.name""", p=agreed, x=hubs, y=hubs)  # fmt: skip
    return own.unionByName(across)


# Bit 1 << m of present says that a person with the marks m is at the place; marks that share no bit don't contradict.
_COMPATIBLE = "EXISTS(sequence(0, 7), o -> (present & shiftleft(1, o)) <> 0 AND (o & marks) = 0 AND (o <> marks OR persons > 1))"


def _attached(rows: DataFrame) -> DataFrame:
    """(a, b): persons that town, headline and whole name make one.

    rows: those of all persons. Of address, number and profile none is known of both sides of a pair. A person with several such
    partners is tied to none of them, and nor are partners to one that has several, unless these don't contradict each other
    either. Places where nobody can be tied to another for that reason are left aside first.
    """
    spark = rows.sparkSession
    marks = sum((F.max(c).cast("int") * (1 << i) for i, c in enumerate(("email", "phone", "profile"))), F.lit(0))
    known = cut(rows.groupBy("person").agg(marks.alias("marks")))
    at = rows.filter(F.size("places") > 0).select("person", "name", "towns", "places").join(known, "person").select("person", "name", "towns", F.explode("places").alias("key"), "marks").distinct()
    present = at.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, marks)")).alias("present"), (F.max("person") != F.min("person")).cast("int").alias("more"))
    open_to = present.filter("more = 1").select("key", "present", (F.col("more") + 1).alias("persons"))
    at = cut(at.join(open_to, "key").filter(_COMPATIBLE).select("person", "name", "towns", "key", "marks"))
    named = at.select(F.xxhash64("key").alias("contact"), "name").distinct()
    alike = agreeing(named, 3)
    both = cut(alike.select("contact", "name_a", "name_b").unionByName(at.select(F.xxhash64("key").alias("contact"), F.col("name").alias("name_a"), F.col("name").alias("name_b")).distinct()))
    at = at.withColumn("contact", F.xxhash64("key"))
    near = sql(spark, """
        SELECT p.person AS a, q.person AS b, p.towns AS ta, q.towns AS tb FROM {w} w JOIN {p} p ON w.contact = p.contact AND w.name_a = p.name
        JOIN {q} q ON w.contact = q.contact AND w.name_b = q.name WHERE p.person <> q.person AND p.key = q.key AND (p.marks & q.marks) = 0""", p=at, q=at, w=both)  # fmt: skip
    near = near.filter("exists(ta, x -> exists(tb, y -> levenshtein(x, y) <= CASE WHEN least(length(x), length(y)) < 5 THEN 0 WHEN least(length(x), length(y)) < 10 THEN 2 ELSE 4 END))")
    met = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turned = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # How often an address, a number or a profile is known among a person and all its partners: once at most where nobody contradicts.
    times = " , ".join(f"sum((k.marks >> {i}) & 1) + any_value((o.marks >> {i}) & 1)" for i in range(3))
    sums = sql(spark, f"SELECT m.a AS person, count(*) AS n, greatest({times}) AS most FROM {{m}} m JOIN {{k}} k ON m.b = k.person JOIN {{o}} o ON m.a = o.person GROUP BY m.a", m=turned, k=known, o=known)
    fit = sql(spark, "SELECT person FROM {s} WHERE n = 1 OR most < 2", s=sums)
    return sql(spark, "SELECT m.a, m.b FROM {m} m JOIN {f} f ON m.a = f.person JOIN {g} g ON m.b = g.person", m=met, f=fit, g=fit)


def name_variants(recruiters: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows of one person whose full_name strings, both non-null, aren't identical."""
    persons = same_person(recruiters)
    named = recruiters.select(F.col("row_id").cast("long").alias("row_id"), "full_name").filter("full_name is not null").join(persons, "row_id")
    named = cut(named)
    a, b = named.alias("a"), named.alias("b")
    on = (F.col("a.person") == F.col("b.person")) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.full_name") != F.col("b.full_name"))
    return a.join(b, on).select(F.col("a.row_id").alias("row_id_a"), F.col("b.row_id").alias("row_id_b")).distinct()
