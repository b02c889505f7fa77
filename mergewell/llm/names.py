"""Reading and comparing names of people as they are typed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that aren't part of a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor er eng sir dame rev herr frau m mme sr sra sri smt shri".split())
SUFFIXES = frozenset("jr sr ii iii iv phd msc mba md bsc ba ma mtech btech esq cpa pmp dds jd dphil meng beng mphil".split())
# Short forms of given names.
NICKNAMES = {
    "abigail": "abby abi gail", "alexander": "alex al sasha xander sandy lex alec", "aleksandr": "alex sasha alek", "alexandra": "alex sasha sandra lexi ali", "andrew": "andy drew",
    "anthony": "tony ant", "antonia": "toni tonia", "barbara": "barb babs", "benjamin": "ben benji benny", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "charlotte": "lottie charlie lotte",
    "christina": "chris tina christy", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby", "dmitri": "dima mitya", "dorothy": "dot dottie",
    "edward": "ed eddie ted teddy ned", "ekaterina": "katya kate", "elizabeth": "liz beth lizzie betty eliza lisa libby betsy", "emily": "em emmy", "francisco": "paco pancho frank cisco",
    "frederick": "fred freddie freddy", "friederike": "rike fritzi", "gabriel": "gabe", "gregory": "greg", "guadalupe": "lupe lupita", "ignacio": "nacho", "isabella": "bella izzy isa", "jacqueline": "jackie",
    "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hannes jo", "john": "johnny jack", "jonathan": "jon johnny", "joseph": "joe joey", "josephine": "josie jo", "jose": "pepe",
    "katherine": "kate kathy katie kat kathryn", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "leo len lenny", "madeleine": "maddie maddy", "margaret": "maggie meg peggy marge greta",
    "matthew": "matt matty", "maximilian": "max", "michael": "mike mick mikey", "nathaniel": "nate nathan nat", "nicholas": "nick nicky nico", "nicole": "nikki nicky", "patricia": "pat patty tricia trish",
    "patrick": "pat paddy rick", "philippa": "pippa pip", "rafael": "rafa rafi", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samantha": "sam sammy", "samuel": "sam sammy", "sebastian": "seb bastian basti", "stephanie": "steph stevie", "stephen": "steve stevie", "steven": "steve stevie", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic", "vladimir": "vova volodya", "william": "bill will billy willy liam", "yevgenia": "zhenya", "zachary": "zach zack zac",
}

_DIGITS = str.maketrans("01358", "olesb")
_SPECIAL = str.maketrans({"ø": "o", "æ": "ae", "ß": "ss", "ł": "l", "đ": "d", "ı": "i", "œ": "oe"})
_SHORT: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts.split():
        _SHORT.setdefault(_s, set()).add(_full)


_PLAIN = re.compile(r"[A-Za-z]{2,}(?: [A-Za-z]{2,})+").fullmatch
_UNUSUAL = TITLES | SUFFIXES | {"ph", "sc", "tech"}


def fold(text: str) -> str:
    """text in lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def tokens_of(name: str | None) -> tuple[str, ...]:
    """The parts of a name, given name first, without titles, degrees and accents; double names are one part."""
    if not name:
        return ()
    if _PLAIN(name):  # most names have nothing below
        words = name.lower().split(" ")
        if _UNUSUAL.isdisjoint(words):
            return tuple(words)
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name).strip()
    if "," in t:
        left, _, right = t.partition(",")
        words = re.findall(r"[^\W_]+", right.lower().replace(".", ""))
        t = left if not words or all(w in SUFFIXES for w in words) else f"{right.replace(',', ' ')} {left}"
    if not re.search(r"[\s_]", t.strip()):
        t = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", t)
    # Points after letters mark initials and short forms; a degree written with points stays together.
    t = re.sub(r"\b(?:ph\.?\s?d|m\.?\s?sc|b\.?\s?sc|m\.?b\.?a|b\.?tech|m\.?tech)\b\.?", " ", t, flags=re.I)
    out = []
    for w in re.split(r"[\s_.]+", fold(t)):
        w = re.sub(r"[^\w\-]", "", w)
        if any(c.isalpha() for c in w):
            w = w.translate(_DIGITS)
        w = "".join(c for c in w if c.isalpha() or c == "-").strip("-")
        if w:
            out.append(w)
    while len(out) > 2 and out[0] in TITLES:
        out.pop(0)
    if len(out) == 2 and out[0] in TITLES and len(out[0]) > 1 and len(out[1]) > 1 and out[0] not in ("ma", "er"):
        out.pop(0)
    while len(out) > 2 and out[-1] in SUFFIXES:
        out.pop()
    return tuple(out)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b, or most + 1 if there are more (banded)."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = most + 1
    before: list[int] = []
    row = [j if j <= most else big for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [big] * (m + 1)
        if i <= most:
            new[0] = i
        best = new[0]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            x = row[j - 1] + (a[i - 1] != b[j - 1])
            if row[j] + 1 < x:
                x = row[j] + 1
            if new[j - 1] + 1 < x:
                x = new[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < x:
                x = before[j - 2] + 1
            new[j] = x if x < big else big
            best = min(best, new[j])
        if best >= big:
            return big
        before, row = row, new
    return row[m]


def allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 8 else 2


FULL, INITIAL, NO = 2, 1, 0


@lru_cache(maxsize=500_000)
def part_likeness(a: str, b: str) -> int:
    """FULL: the same part, but for typos, short forms and half of a double name; INITIAL: one may be the other's initial."""
    if a == b:
        return INITIAL if len(a) == 1 else FULL
    if len(a) == 1 or len(b) == 1:
        return INITIAL if a[0] == b[0] else NO
    x, y = a.replace("-", ""), b.replace("-", "")
    k = allowed(min(len(x), len(y)))
    d = edits(x, y, k)
    if d <= k and (min(len(x), len(y)) > 4 or x[0] == y[0]):
        return FULL
    if (x in _SHORT and (y in _SHORT[x] or any(edits(y, f, 1) <= 1 for f in _SHORT[x]))) or (y in _SHORT and (x in _SHORT[y] or any(edits(x, f, 1) <= 1 for f in _SHORT[y]))):
        return FULL
    if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
        return FULL
    if x in _SHORT and y in _SHORT and _SHORT[x] & _SHORT[y]:
        return FULL
    if "-" in a or "-" in b:
        if any(len(p) > 3 and len(q) > 3 and edits(p, q, allowed(min(len(p), len(q)))) <= allowed(min(len(p), len(q))) for p in a.split("-") for q in b.split("-")):
            return FULL
    return NO


@lru_cache(maxsize=500_000)
def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """How far two names may be one person's: 3 both parts are alike, 2 one part and an initial, 1 one part only, 0 none.

    The first and the last part count, in either order. Middle names that differ make 1 of more.
    """
    if not a or not b:
        return 0
    x, y = "".join(a).replace("-", ""), "".join(b).replace("-", "")
    if x == y or (len(a) != len(b) and min(len(x), len(y)) >= 8 and x[0] == y[0] and edits(x, y, 2) <= (2 if min(len(x), len(y)) >= 12 else 1)):
        return 3
    if len(a) == 1 or len(b) == 1:
        one, many = (a, b) if len(a) == 1 else (b, a)
        joined = "".join(many).replace("-", "")
        if len(one[0]) >= 6 and (edits(one[0].replace("-", ""), joined, 2) <= 2 or edits(one[0].replace("-", ""), many[0] + many[-1].replace("-", ""), 2) <= 2):
            return 3
        return 1 if any(part_likeness(one[0], p) == FULL for p in many) else 0
    best = 0
    for g, s, middle in ((b[0], b[-1], b[1:-1]), (b[-1], b[0], b[1:-1])):
        first, last = part_likeness(a[0], g), part_likeness(a[-1], s)
        got = 3 if first == last == FULL else 2 if first and last and FULL in (first, last) else 1 if FULL in (first, last) else 0
        if got >= 2 and a[1:-1] and middle and not any(part_likeness(p, q) for p in a[1:-1] for q in middle):
            got = 1
        best = max(best, got)
    # A last name typed first in front of a middle name, or a middle name used as the given one.
    if best < 3 and (len(a) > 2 or len(b) > 2):
        left, used = list(b), 0
        for p in a:
            for q in left:
                if len(p) > 1 and len(q) > 1 and part_likeness(p, q) == FULL:
                    left.remove(q)
                    used += 1
                    break
        if used >= 2 and used == min(len(a), len(b)):
            best = 3
    return best


def canonical(name: str | None) -> str | None:
    """The parts of a name with one blank between; null for a name without letters."""
    t = tokens_of(name)
    return " ".join(t) if t else None
