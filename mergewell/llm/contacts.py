"""What ties rows to persons besides names: addresses, numbers and profiles as typed, in comparable form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A contact that more groups of mutually alike names than this share is a switchboard, an agency or the like: it only ties whole names.
SHARED_ABOVE = 6


def email_key(c: Column) -> Column:
    """An address in lower case without blanks, with one at sign however it was typed; null if it isn't one."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+at\s+|@+|\s*\[at\]\s*|\(at\)", "@"), r"\s+|^mailto:|[.,;]+$", "")
    return F.when(t.rlike(r"^[^@]+@[^@]+\.[^@.]{2,}$"), t)


def local_key(c: Column) -> Column:
    """The part in front of the at sign, or the whole of an address cut short; null for none."""
    t = F.regexp_extract(F.regexp_replace(F.lower(F.trim(c)), r"\s+at\s+", "@"), r"^([^@\s]+)(?:@.*)?$", 1)
    return F.nullif(t, F.lit(""))


def phone_key(c: Column) -> Column:
    """The national part of a number, without its extension; null if it isn't one.

    A country's code and a trunk zero are typed or not, so the last nine digits stand for the number, all of them if there are
    only seven or eight. Fewer are an extension or a fragment, more than fifteen no number by E.164.
    """
    bare = F.regexp_replace(F.lower(c), r"(?:x|ext\.?|#)\s*[0-9]{1,5}\s*$", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    same = F.regexp_replace(digits, r"^(.)\1*$", "").eqNullSafe("")
    return F.when(F.length(digits).between(7, 15) & ~same & ~bare.rlike("[a-z]|[0-9]e[+]"), F.right(digits, F.lit(9)))


def profile_key(c: Column) -> Column:
    """The last part of a profile's address."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"(?:^|[./])[a-z0-9-]+\.[a-z]+/(?:in/|u/|user/|~)?([^/?#\s]+)/?(?:[?#].*)?$", 1), F.lit(""))
