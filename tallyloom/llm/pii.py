"""Personal information in free text (problem 1): found, and replaced by typed, linkable placeholders.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their formats, numbers without a
telling format only behind words that announce them. A person's name is a surname with a first name or initials, in any
order and case; first names, surnames, surname endings and the everyday words that look like them are fitted on a bounded
sample of labelled rows. Placeholders carry a format-preserving pseudonym: digits and letters are permuted by a keyed
Feistel network within their format, numbers that pass the rules of their kind among those that do, so the same number is
the same pseudonym in every document and spelling of its separators, and the key holder can undo it; dates of birth, if
asked for, are permuted among dates. Values without such a format carry a keyed tag.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feistel

TYPES = ("email", "identity_number", "phone", "street_address", "person_name")
#: Distinct labelled names, and labelled rows with their texts, that the name model is fitted on, taken in hash order.
LABELLED_NAMES, LABELLED_ROWS = 20_000, 20_000
#: A word that stands beside a first name or initial in a smaller share of its places is an everyday word.
NAME_SHARE = 0.2
#: Country calling codes of one and two digits; all others have three (fixed values).
ONE_DIGIT = ("1", "7")
TWO_DIGITS = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_EMAIL = re.compile(rf"[a-z0-9][\w.+-]*(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?){_LABEL}(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s){_LABEL})*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[a-z]{{2,24}}(?![\w-])", re.I)
_AT = re.compile(r"@|\(at\)|\[at\]", re.I)

_EXT = r"(?:,?\s?(?:ext\.?|x)\s?\d{1,5})?"
_PHONES = re.compile(
    rf"(?<![\w.+-])(?:\+?1[-. ]?)?(?:\(\d{{3}}\)\s?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}{_EXT}(?![\w-])"
    rf"|(?<![\w.])\+\d{{1,3}}(?:[ .-]?\(0\))?(?:[ .-]?\d{{1,4}}){{2,6}}{_EXT}(?![\w-])"
    rf"|(?<![\w.])\+\d{{9,15}}{_EXT}(?![\w-])"
    rf"|(?<![\w.+-])0\d{{2,4}}[ -]\d{{3,4}}[ -]?\d{{3,4}}{_EXT}(?![\w-])"
    rf"|(?<![\w.+-])0\d(?:[ .]\d{{2}}){{4}}(?![\w-])",
    re.I,
)
_PLAIN_PHONE = re.compile(rf"(?<![\w.+-])[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}(?![\w-])", re.I)
_PHONE_BEFORE = re.compile(r"(?i)(?:\b(?:call(?:back)?|text|tel|telephone|phone|line|reach|fax|mobile|cell|dial|sms|whatsapp)\b)[^.!?\n]{0,30}$")
_NOT_PERSONAL = re.compile(r"(?i)\b(?:job|run|order|invoice|ticket|case|serial|epoch|ref|reference|id|no reply|part|item|build|trace|queue|batch|po)\W{0,3}$")

_REFERENCE = re.compile(r"(?i)\b(?:job|run|order|invoice|ticket|case|serial|part|item|po|batch)\W{0,3}$")
_SSN = re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
_NINE = re.compile(r"(?<![\w.-])\d{9}(?![\w-])")
_NINE_BEFORE = re.compile(r"(?i)(?:\bssn|social security|\btax id|\btin|\bitin|\btax(?:payer)? (?:number|no)|identity check|identity number)\W*(?:no\.?|number|num|is)?\W*$")
_LICENCE = re.compile(r"(?<![\w-])[a-z]\d{3}-\d{4}-\d{4}(?![\w-])", re.I)
_INSURANCE = re.compile(r"(?<![\w-])[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?![\w-])", re.I)
_PASSPORT = re.compile(r"(?<![\w-])[a-z]{1,2}\d{6,9}(?![\w-])", re.I)
_PAPER_BEFORE = re.compile(r"(?i)(?:passport|licen[cs]e|national insurance|\bni|identity check|\bid card|tax id)\W*(?:no\.?|number|num|is)?\W*$")

_SUITE = r"(?:,? (?:suite|apt\.?|unit|flat|floor|room) ?\w+)?"
_STREETS = re.compile(
    rf"(?:flat \d+[a-z]?,? )?(?<![\w-])\d{{1,5}}[a-z]? (?:[nsew]\.? |old |new |upper |lower |north |south |east |west )?[^\W\d_]{{3,}} (street|st|road|rd|lane|ln|avenue|ave|court|ct|way|parkway|pkwy|close|crescent|drive|dr|boulevard|blvd|terrace|place|square|hill|grove|gardens|row|walk|mews|alley|quay|circle|highway|hwy)\b\.?{_SUITE}"
    r"|(?<![\w-])\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse) (?:du |de la |de l['’]|des |de |d['’])?[^\W\d_]{3,}"
    r"|\b(?:calle|avenida|plaza|paseo|via|viale|rua) (?:de la |del |de |da |do )?[^\W\d_]{3,},? \d{1,4}(?:, ?\d{1,2}[ºª°]?)?(?!\w)"
    r"|\b[^\W\d_]{2,}(?:straße|strasse|str\.|gasse|platz|allee) \d{1,4}[a-z]?(?!\w)",
    re.I,
)
#: Words of which one stands in every address, and endings of German street names (fixed values).
_STREET_WORDS = frozenset("street st road rd lane ln avenue ave court ct way parkway pkwy close crescent drive dr boulevard blvd terrace place square hill grove gardens row walk mews alley quay circle highway hwy rue chemin allée impasse calle avenida plaza paseo via viale rua".split())
_STREET_ENDS = ("straße", "strasse", "gasse", "platz", "allee", "str")
#: Stretches of digits long enough for a number worth a look, and words that announce lettered ones.
_NUMBERS = re.compile(r"\d[\d .()+-]{6,}\d")
_LETTERED = frozenset("passport licence license insurance ni identity".split())
#: Suffixes that are everyday words: in lower case they need an address context.
_EVERYDAY = {"way", "close", "place", "court", "square", "hill", "row", "walk", "drive", "st", "dr", "ct", "grove", "circle", "alley"}
_STREET_BEFORE = re.compile(r"(?i)\b(?:send|sent|deliver\w*|visit|moved|office|address|bill|replacement|site|ship\w*|lives?|from|at|to)\b[^.!?\n]{0,45}$")

_WORD = re.compile(r"(?:\bo['’](?=[^\W\d_]{2}))?[^\W\d_]+", re.I)
_BIRTH = re.compile(r"(?i)\b(?:born(?: on)?|birth(?:day|date)?|date of birth|dob)\b\W{0,3}(?:is |was )?(\d{4})([-/.])(\d{2})\2(\d{2})(?!\d)")


@dataclass
class Names:
    """First names, surnames, surname endings, and everyday words that are no surnames, fitted on labelled rows."""

    first: frozenset = field(default_factory=frozenset)
    endings: frozenset = field(default_factory=frozenset)
    last: frozenset = field(default_factory=frozenset)
    everyday: frozenset = field(default_factory=frozenset)

    @staticmethod
    def fit(names: list[str], texts: list[str] = ()) -> Names:
        """Endings are the last four letters of at least 0.4 % of the surnames; first names and surnames are those labelled.

        Everyday words are those of the labelled rows' texts that mostly stand without a first name or initial beside them.
        """
        model = Names.labelled(names)
        seen, named = model.places(texts)
        return replace(model, everyday=frozenset(w for w, n in seen.items() if named[w] < NAME_SHARE * n))

    @staticmethod
    def labelled(names: list[str]) -> Names:
        split = [w for n in names if len(w := _WORD.findall(n.lower())) >= 2]
        endings = Counter(w[-1][-4:] for w in split if len(w[-1]) >= 5)
        floor = max(1, round(0.004 * len(split)))
        first = frozenset(w[0] for w in split if len(w[0]) > 1)
        return Names(first, frozenset(e for e, n in endings.items() if n >= floor), frozenset(w[-1] for w in split))

    def places(self, texts: list[str]) -> tuple[Counter, Counter]:
        """How often each word stands in the texts, and how often beside a first name or initial."""
        seen: Counter = Counter()
        named: Counter = Counter()
        for t in texts:
            w = [x.lower() for x in _WORD.findall(t or "")]
            seen.update(w)
            named.update(x for i, x in enumerate(w) if any(n in self.first or len(n) == 1 for n in w[max(0, i - 1) : i] + w[i + 1 : i + 2]))
        return seen, named

    def like(self, word: str) -> bool:
        """Whether a lower-case word looks like a surname: labelled as one, or with the ending of one."""
        return (word in self.last or (len(word) >= 5 and word[-4:] in self.endings)) and word not in self.everyday

    def spans(self, text: str, low: str, vocabulary: set[str]) -> list[tuple[int, int]]:
        """Where a surname stands with a first name or initials before or behind it. ``low`` is the text in lower case.

        A word that does not look like a surname is one if it is written like a name, directly behind a first name that is
        too, and is no everyday word.
        """
        if len(low) != len(text) or (vocabulary.isdisjoint(self.first) and not any(self.like(w) for w in vocabulary)):
            return []
        words = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        out = []
        for i, (a, b) in enumerate(words):
            w = low[a:b]
            if not self.like(w):
                if i and low[slice(*words[i - 1])] in self.first and self._written(text, words[i - 1], (a, b)) and w not in self.first and w not in self.everyday:
                    out.append((words[i - 1][0], b))
                continue
            start, end = a, b
            j = i - 1
            while j >= 0:
                p, q = words[j]
                gap, prior = text[q:start], low[p:q]
                if prior in self.first and gap in (" ", "  ", "\n"):
                    start = p
                    break
                if q - p == 1 and gap in (". ", ".") and (p == 0 or not text[p - 1].isalnum()):
                    start, j = p, j - 1
                    continue
                break
            if start == a and i + 1 < len(words):
                p, q = words[i + 1]
                gap = text[b:p]
                if low[p:q] in self.first and gap in (", ", " ", ","):
                    end = q
                    if i + 2 < len(words) and words[i + 2][1] - words[i + 2][0] == 1 and text[q : words[i + 2][0]] == " " and text[words[i + 2][1] : words[i + 2][1] + 1] == ".":
                        end = words[i + 2][1] + 1
                elif q - p == 1 and gap in (", ", ",") and text[q : q + 1] == ".":
                    end = q + 1
            if (start, end) != (a, b):
                out.append((start, end))
        return out

    @staticmethod
    def _written(text: str, first: tuple[int, int], last: tuple[int, int]) -> bool:
        """Whether two words stand side by side, both with a capital and small letters or both in capitals."""
        a, b = text[slice(*first)], text[slice(*last)]
        plain = b.replace("'", "").replace("’", "")
        return text[first[1] : last[0]] == " " and len(b) > 1 and ((a.istitle() and b[0].isupper() and plain[1:].lower() != plain[1:].upper() and not b.isupper()) or (a.isupper() and b.isupper()))

    def parts(self, value: str) -> tuple[str, str]:
        """(surname, first name or initials) of a found name, in lower case."""
        words = _WORD.findall(value.lower())
        rest = [w for w in words if len(w) > 1 and (w not in self.first or self.like(w))]
        last = next((w for w in rest if self.like(w)), words[0] if "," in value else words[-1])
        given = list(words)
        given.remove(last)
        return last, " ".join(given)


def fit_names(tickets: DataFrame, bound: int = LABELLED_NAMES, rows: int = LABELLED_ROWS) -> Names:
    """Fit on at most ``bound`` distinct values of target.customer.name and the texts of ``rows`` labelled rows; the rest of the operator reads every row."""
    labelled = tickets.where("target.customer.name is not null")
    names = labelled.select(F.col("target.customer.name").alias("n")).distinct()
    known = sorted(r[0] for r in names.orderBy(F.xxhash64("n"), "n").limit(bound).collect())
    model = Names.labelled(known)
    if "input_text" not in tickets.columns:
        return model

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, named = model.places(b["input_text"])
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), "named": [named[w] for w in seen]})

    some = labelled.where("input_text is not null").select("input_text").orderBy(F.xxhash64("input_text"), "input_text").limit(rows)
    counts = some.mapInPandas(places, "word string, n long, named long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("named").alias("named"))
    return replace(model, everyday=frozenset(r[0] for r in counts.where(F.col("named") < NAME_SHARE * F.col("n")).select("word").collect()))


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of a text, in order, without overlaps; a null text has none."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    low = text.lower() if len(text.lower()) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)
    vocabulary = set(_WORD.findall(low))
    for stretch in _NUMBERS.finditer(text):
        window = max(0, stretch.start() - 3), min(len(text), stretch.end() + 16)
        for m in _SSN.finditer(text, *window):
            if not _REFERENCE.search(text[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "identity_number")
        for m in _NINE.finditer(text, *window):
            if _NINE_BEFORE.search(text[max(0, m.start() - 40) : m.start()]):
                add(m.start(), m.end(), "identity_number")
        for m in _LICENCE.finditer(text, *window):
            add(m.start(), m.end(), "identity_number")
        for m in _PHONES.finditer(text, *window):
            if 8 <= sum(c.isdigit() for c in re.split(r"(?i)ext|x", m.group())[0]) <= 15 and not _NOT_PERSONAL.search(text[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "phone")
        for m in _PLAIN_PHONE.finditer(text, *window):
            before = text[max(0, m.start() - 48) : m.start()]
            if not _NOT_PERSONAL.search(before) and _PHONE_BEFORE.search(before):
                add(m.start(), m.end(), "phone")
    if not vocabulary.isdisjoint(_LETTERED):
        for pattern in (_INSURANCE, _PASSPORT):
            for m in pattern.finditer(text):
                if _PAPER_BEFORE.search(text[max(0, m.start() - 40) : m.start()]):
                    add(m.start(), m.end(), "identity_number")
    if not vocabulary.isdisjoint(_STREET_WORDS) or any(w.endswith(_STREET_ENDS) for w in vocabulary):
        for m in _STREETS.finditer(text):
            suffix = m.group(1)
            if suffix and suffix.islower() and suffix in _EVERYDAY and not _STREET_BEFORE.search(text[max(0, m.start() - 60) : m.start()]):
                continue
            if suffix and suffix[0].isupper() and text[: m.start(1)].split()[-1].islower():
                continue  # "95 old Drive folders": a capitalised suffix needs a capitalised name
            add(m.start(), m.end(), "street_address")
    for a, b in names.spans(text, low, vocabulary):
        add(a, b, "person_name")
    return sorted(found)


def country_code(digits: str) -> int:
    """How many digits the country calling code has that a number begins with."""
    return 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


def valid(kind: str, value: str) -> bool:
    """Whether a number passes the rules of its kind: areas, groups and serials of social security numbers, and areas and exchanges of North American phone numbers.

    Kinds without rules pass. Numbers are found whether they pass or not; a pseudonym is drawn among those that do as the number does.
    """
    d = "".join(c for c in value if c.isdigit())
    if kind == "identity_number" and len(d) == 9 and not any(c.isalpha() for c in value):
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "phone" and len(d) in (10, 11) and (len(d) == 10 or d[0] == "1"):
        return d[-10] in "23456789" and d[-7] in "23456789" and d[-9:-7] != "11" and d[-6:-4] != "11"
    return True


def pseudonym(kind: str, value: str, key: bytes, keep: int = 0, invert: bool = False) -> str:
    """Another value of the same format that passes the rules of its kind if, and only if, this one does; ``invert`` undoes it."""
    passes, out = valid(kind, value), value
    while True:  # walk the cycle of the permutation to the next value that passes alike
        out = feistel.permute_format(out, key, keep=keep, invert=invert)
        if valid(kind, out) == passes:
            return out


def placeholder(kind: str, value: str, key: bytes, names: Names | None = None) -> str:
    """``[TYPE pseudonym]``. Country codes, trunk digits and extensions of phone numbers stay as they are.

    The tag of a name has up to three parts: one of the surname, one with the first initial and, if the first name is
    written out, one with that. So "A. Hartfield" is a beginning of what "Anna Hartfield" and "Hartfield, Anna" share.
    """
    if kind == "phone":
        number, ext = re.match(r"(?is)(.*?)(,?\s?(?:ext\.?|x)\s?\d+)?$", value).groups()
        digits = "".join(c for c in number if c.isdigit())
        if number.lstrip("(").startswith("+"):
            keep = country_code(digits) + ("(0)" in number)
        else:
            keep = len(digits) == 11 and digits[0] == "1" or digits[0] == "0"
        return f"[PHONE {pseudonym(kind, number, key, int(keep))}{ext or ''}]"
    if kind == "identity_number":
        return f"[IDENTITY_NUMBER {pseudonym(kind, value, key)}]"
    if kind == "birth_date":
        year, sep, month, day = re.match(r"(\d{4})(\D)(\d{2})\D(\d{2})", value).groups()
        return f"[BIRTH_DATE {feistel.permute_date(date(int(year), int(month), int(day)), key).isoformat().replace('-', sep)}]"
    if kind == "person_name":
        last, given = (names or Names()).parts(value)
        tags = [feistel.token(last, key), feistel.token(f"{last},{given[:1]}", key, 4)]
        if len(given.split(" ")[0]) > 1:
            tags.append(feistel.token(f"{last},{given.split(' ')[0]}", key))
        return f"[PERSON_NAME {'-'.join(tags)}]"
    plain = re.sub(r"\s*(?:@|\(at\)|\[at\])\s*", "@", value.lower()) if kind == "email" else value.lower()
    plain = re.sub(r"\s*\[dot\]\s*|\s*\(dot\)\s*|\sdot\s", ".", plain) if kind == "email" else " ".join(sorted(re.findall(r"\w+", plain)))
    return f"[{kind.upper()} {feistel.token(plain, key)}]"


def birth_dates(text: str) -> list[tuple[int, int, str]]:
    """Dates behind words that speak of a birth, in the 200 years that dates are permuted in."""
    out = []
    for m in _BIRTH.finditer(text):
        try:
            day = date(int(m[1]), int(m[3]), int(m[4]))
        except ValueError:
            continue
        if 0 <= (day - feistel.FIRST_DAY).days < feistel.DAYS:
            out.append((m.start(1), m.end(4), "birth_date"))
    return out


def redact(text: str | None, names: Names, key: bytes, dates: bool = False) -> tuple[str | None, list[str]]:
    """The text with placeholders, nothing else changed, and the types found; null stays null. ``dates`` adds dates of birth."""
    if text is None:
        return None, []
    found = find(text, names)
    if dates:
        found = sorted(found + [d for d in birth_dates(text) if all(d[1] <= a or d[0] >= b for a, b, _ in found)])
    out, at, kinds = [], 0, []
    for a, b, kind in found:
        out += [text[at:a], placeholder(kind, text[a:b], key, names)]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def redacted(rows: DataFrame, names: Names, key: bytes, table_name: str, record_id: str, text: str, dates: bool = False) -> DataFrame:
    """(table_name, record_id, text, pii_types, items) for every row with an id; whole texts, nulls stay null.

    Rows are handled one by one in Arrow batches: no shuffle, no limit on length.
    """
    known = rows.sparkSession.sparkContext.broadcast(names)  # at most LABELLED_NAMES names and the words of LABELLED_ROWS texts

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = known.value
        for b in batches:
            done = [redact(t, model, key, dates) for t in b["text"]]
            yield pd.DataFrame({"table_name": table_name, "record_id": b["record_id"], "text": [d[0] for d in done], "pii_types": [sorted(set(d[1])) for d in done], "items": [len(d[1]) for d in done]})

    picked = rows.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).where("record_id is not null")
    return picked.mapInPandas(work, "table_name string, record_id string, text string, pii_types array<string>, items long")


def types_found(results: DataFrame) -> DataFrame:
    """(table_name, record_id, pii_type), one row each."""
    return results.select("table_name", "record_id", F.explode("pii_types").alias("pii_type")).distinct()
