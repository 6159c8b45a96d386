"""Surrogates for personal data: detected entities get keyed replacements of their own type, script, gender and format.

A surrogate is the image of the entity under a keyed permutation of all values of its format (a Feistel network on the
format's index range, rotated so that no value maps to itself). So, for one key and without any table of the corpus:

* coreference: one entity has one surrogate in all documents, whatever its case or separators;
* distinctness: two entities of one format never share a surrogate, and formats (lengths, scripts, name lists) map to themselves;
* no entity is left as it was, unless its format has one value only.

`collisions` checks both properties over a whole table.

Types: email, ip, card (Luhn-valid; the surrogate is too), iban (check digits hold), phone, ssn, passport, birth (a date after
words that say so; the surrogate is a date in the same writing), key and secret (also the password of a URL), name. Numbers after
"version" are no addresses, names of saints and institutions no persons. Given names are those of a list, by gender and script, as written or in capitals. A capitalised word after a given name or a title is a family
name (initials and particles may stand between; hyphens and apostrophes belong to it), and so is every later or earlier mention of
that word in the same text, so that no mention is left beside its surrogate; so are the capitalised words after CUES. A family
name keeps its script, its vowels' and
consonants' places, and Slavic and Greek endings that tell gender. Names that are on no list and follow none stay: a limit.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import gcd, isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Common given names by script and gender.
GIVEN_NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Charlotte Claire Elena Elizabeth Emily Emma Hannah Ingrid Isabel Jennifer Jessica Julia Karen Laura Linda Maria Mary Nancy Olivia Patricia Sabine Sandra Sarah Sophie Susan Ursula".split(),
    ("latin", "m"): "Andrew Anthony Carlos Charles Christopher Daniel David Edward Francisco George Hans Henry James John Joseph Kevin Klaus Luis Matthew Michael Miguel Paul Peter Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
# Titles that a family name follows.
TITLES = ["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Prof", "Prof.", "Professor", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
# Words that a full name follows, words before a saint's name, words after a name that make it an institution's.
CUES = ["my name is", "My name is", "name:", "Name:", "NAME:"]
SAINTS = ("Saint ", "St. ", "St ", "San ", "Santa ", "Sankt ", "Sainte ")
INSTITUTION = re.compile(r"[ \xa0](?:University|College|Institute|School|Hospital|Street|Road|Avenue|Lane|Square|Airport|County|Inc|Ltd|LLC|GmbH|Corp)(?![\w])", re.IGNORECASE)
# Words that a secret follows.
SECRET_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "api-key"]

# Alphabets that a letter is moved within: vowels, consonants, vowels and consonants with marks.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "çñßšžčćđłńśźżřťďðþ"),
    "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ёіїєў", "ъьґџ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"),
}
# Endings of family names that tell gender; they are kept.
ENDINGS = ["ская", "ский", "цкая", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын", "όπουλος", "οπούλου", "ίδης", "ίδου", "άκης", "άκη", "ος", "ου", "ης", "ας"]
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"

EMAIL = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![\w-])")
NUMBERS = re.compile(r"[+(]?\d[\d().\- ]{4,40}\d")
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
PHONE = re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4} \d{3,4} \d{3,4})(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
#: A social security number without separators, a passport's number and a date of birth: only after words that say so.
SAID_SSN = re.compile(r"(?:\bSSN|social security(?: number| no\.?)?)(?: is)?[:# ]{1,3}(\d{9})(?!\d)", re.IGNORECASE)
PASSPORT = re.compile(r"\bpassport(?: number| no\.?)?(?: is)?[:# ]{1,3}([A-Z]{0,2}\d{6,9})(?![A-Za-z0-9])", re.IGNORECASE)
BIRTH = re.compile(r"(?:date of birth|\bDOB|\bborn(?: on)?)(?: is)?[: ]{1,3}((?:19|20)\d\d-\d\d-\d\d|\d\d[/.]\d\d[/.](?:19|20)\d\d)(?!\d)", re.IGNORECASE)
URL_SECRET = re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{4,200})@")
VERSION = re.compile(r"(?:version|release|build|ver\.?|\bv\.?) ?$", re.IGNORECASE)
#: First and last day of a surrogate date of birth.
BIRTH_DAYS = (dt.date(1900, 1, 1), dt.date(2029, 12, 31))
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(AKIA|ASIA)([A-Z0-9]{16})(?![A-Za-z0-9])")
SECRET = re.compile(r"(?:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.~-]{6,200})", re.IGNORECASE)
#: A word with its hyphens and apostrophes, less a possessive.
NAME = r"[^\W\d_]{2,40}(?:(?!['’][sS](?!\w))['’\-][^\W\d_]{1,40}){0,3}"
#: What follows a given name or a title: initials, particles, the family name.
FAMILY = re.compile(rf"[ \t\xa0]{{1,3}}(?:[^\W\d_]\.[ \t\xa0]{{0,3}}){{0,3}}(?:(?:van|von|der|den|de|del|della|di|la|le|du|dos|da|bin|ibn|al)[ \t\xa0]){{0,3}}((?:[OD]['’])?{NAME})(?![\w])")
#: Two words of a full name.
FULL = re.compile(rf"[ \t\xa0]{{1,3}}({NAME})[ \t\xa0]{{1,3}}(?:[^\W\d_]\.[ \t\xa0]{{0,3}}){{0,3}}((?:[OD]['’])?{NAME})(?![\w])")
WORDS = re.compile(rf"(?<![\w'’\-])(?:[OD]['’])?{NAME}(?![\w])")


class Permutation:
    """A keyed permutation of range(n) without fixed points (n > 1): Feistel rounds with cycle walking, around a rotation."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()
        self.bytes = min(64, max(16, n.bit_length() // 8 + 8))
        self.step = 1 + self._hash(255, n) % max(1, n - 1)
        while gcd(self.step, n) != 1:
            self.step = self.step % max(1, n - 1) + 1

    def _hash(self, i: int, x: int) -> int:
        data = self.tweak + bytes([0, i]) + x.to_bytes(x.bit_length() // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=self.bytes).digest(), "big")

    def _mix(self, x: int) -> int:
        while True:
            u, v = divmod(x, self.b)  # u in range(a), v in range(b)
            for i in range(self.ROUNDS):
                if i % 2:
                    v = (v + self._hash(i, u)) % self.b
                else:
                    u = (u + self._hash(i, v)) % self.a
            x = u * self.b + v
            if x < self.n:
                return x

    def _unmix(self, x: int) -> int:
        while True:
            u, v = divmod(x, self.b)
            for i in reversed(range(self.ROUNDS)):
                if i % 2:
                    v = (v - self._hash(i, u)) % self.b
                else:
                    u = (u - self._hash(i, v)) % self.a
            x = u * self.b + v
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._unmix((self._mix(x) + self.step) % self.n) if self.n > 1 else x


class Surrogates:
    """Replacements under one key. Each method takes an entity as written and returns it in the same writing."""

    def __init__(self, key: bytes):
        self.key = key
        self._permutation = lru_cache(4096)(lambda tweak, n: Permutation(key, tweak, n))
        self.of = lru_cache(100_000)(self._of)

    def __getstate__(self):
        return {"key": self.key}

    def __setstate__(self, state):
        self.__init__(state["key"])

    def spelled(self, kind: str, chars: str, alphabets: list[str | None]) -> str:
        """chars with each character that has an alphabet moved within it, all together as one number; case is kept."""
        low = "".join(map(_lower, chars))
        n = value = 1
        value, radices = 0, []
        for c, alphabet in zip(low, alphabets):
            if alphabet:
                value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
                radices.append(alphabet)
        shape = ",".join(a[:2] if a else f"={c}" for c, a in zip(low, alphabets))
        value = self._permutation(f"{kind}|{shape}", n)(value)
        drawn = []
        for alphabet in reversed(radices):
            value, k = divmod(value, len(alphabet))
            drawn.append(alphabet[k])
        out = [drawn.pop() if a else c for c, a in zip(chars, alphabets)]
        return "".join(o.upper() if c.isupper() and a and len(o.upper()) == 1 else o for o, c, a in zip(out, chars, alphabets))

    def _plain(self, kind: str, chars: str) -> str:
        return self.spelled(kind, chars, [DIGITS if c in DIGITS else LOWER if c.lower() in LOWER and len(c.lower()) == 1 else None for c in chars])

    def _of(self, kind: str, value: str) -> str:
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2].lower() == "example" else 1  # a reserved name stays one
        return f"{self._plain('local', local)}@" + ".".join([*(self._plain("label", x) for x in labels[:-kept]), *labels[-kept:]])

    def _ip(self, value: str) -> str:
        octets = [int(x) for x in value.split(".")]
        kept = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or (octets[0] == 172 and 16 <= octets[1] < 32) else 0
        x = int.from_bytes(bytes(octets[kept:]), "big")
        move = self._permutation(f"ip|{octets[:kept]}", 256 ** (4 - kept))
        while True:  # a public address stays one
            x = move(x)
            out = [*octets[:kept], *x.to_bytes(4 - kept, "big")]
            if kept or not (out[0] in (0, 10, 127) or out[0] >= 224 or out[:2] == [192, 168] or (out[0] == 172 and 16 <= out[1] < 32)) or octets[0] in (0, *range(224, 256)):
                return ".".join(map(str, out))

    def _card(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        body = digits[0] + self.spelled("card", digits[1:-1], [DIGITS] * (len(digits) - 2))
        return _written_as(value, body + str(-luhn(body + "0") % 10))

    def _iban(self, value: str) -> str:
        chars = value.replace(" ", "")
        body = self._plain("iban", chars[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + chars[:2] + "00")) % 97
        return _written_as(value, f"{chars[:2]}{check:02d}{body}")

    def _phone(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        tail = digits[-10:] if len(digits) >= 10 else digits[1:]
        return _written_as(value, digits[: len(digits) - len(tail)] + self.spelled("phone", tail, [DIGITS] * len(tail)))

    def _ssn(self, value: str) -> str:
        return _written_as(value, self.spelled("ssn", value.replace("-", ""), [DIGITS] * 9))

    def _passport(self, value: str) -> str:
        return self._plain("passport", value)

    def _birth(self, value: str) -> str:
        day_first = value[2] in "/."
        at = (value[6:], value[3:5], value[:2]) if day_first else value.split("-")
        first, last = BIRTH_DAYS
        days = (last - first).days + 1
        try:
            day = (dt.date(*map(int, at)) - first).days
        except ValueError:  # no day of the calendar
            return self._plain("birth", value)
        new = first + dt.timedelta(self._permutation("birth", days)(day % days))
        return f"{new.day:02d}{value[2]}{new.month:02d}{value[5]}{new.year}" if day_first else new.isoformat()

    def _key(self, value: str) -> str:
        return value[:4] + self.spelled("key", value[4:], [LOWER + DIGITS] * (len(value) - 4)).upper()

    def _secret(self, value: str) -> str:
        if all(c in "0123456789abcdef" for c in value):
            return self.spelled("hex", value, ["0123456789abcdef"] * len(value))
        return self._plain("secret", value)

    def _given(self, value: str) -> str:
        (script, gender), names = next((k, v) for k, v in GIVEN_NAMES.items() if value in v or value.capitalize() in v)
        exact = value in names
        new = names[self._permutation(f"given|{script}|{gender}", len(names))(names.index(value if exact else value.capitalize()))]
        return new if exact else new.upper()

    def _family(self, value: str) -> str:
        low = "".join(map(_lower, value))
        kept = max((len(e) for e in ENDINGS if low.endswith(e) and len(low) - len(e) >= 2), default=0)
        alphabets = [next((a for every in LETTERS.values() for a in every if c in a), None) if k < len(low) - kept else None for k, c in enumerate(low)]
        return self.spelled("family", value, alphabets)


def _lower(c: str) -> str:
    """A character in lower case; as it is where that would be several."""
    low = c.lower()
    return low if len(low) == 1 else c


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10


def _written_as(value: str, chars: str) -> str:
    """chars with the separators of value."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in value)


def _valid_iban(value: str) -> bool:
    chars = value.replace(" ", "")
    return 15 <= len(chars) <= 34 and int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1


_anchors = None


@lru_cache(4096)
def _is_given(name: str) -> bool:
    return any(name in v or name.capitalize() in v for v in GIVEN_NAMES.values())


def _anchor_words():
    """Automaton of the words that names and secrets are looked for at."""
    global _anchors
    if _anchors is None:
        import ahocorasick

        _anchors = ahocorasick.Automaton()
        for names in GIVEN_NAMES.values():
            for name in names:
                for form in (name, name.upper()):
                    _anchors.add_word(form, ("given", len(form) - 1))
        for title in TITLES:
            _anchors.add_word(title + " ", ("title", len(title)))
        for cue in CUES:
            _anchors.add_word(cue + " ", ("cue", len(cue)))
        for word in SECRET_WORDS:
            for form in {word, word.upper(), word.capitalize()}:
                _anchors.add_word(form, ("secret", len(form) - 1))
        for prefix in ("AKIA", "ASIA"):
            _anchors.add_word(prefix, ("key", 3))
        _anchors.make_automaton()
    return _anchors


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps; of two that overlap the stricter kind stays."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if "://" in text:
        found += [(*m.span(1), "secret") for m in URL_SECRET.finditer(text)]
    names: list[tuple[int, int, str]] = []
    for end, (kind, size) in _anchor_words().iter(text):
        start = end - size
        if kind == "key":
            if m := ACCESS_KEY.match(text, start):
                found.append((*m.span(), "key"))
        elif kind == "secret":
            if m := SECRET.match(text, start):
                found.append((*m.span(1), "secret"))
        elif kind == "cue":
            if m := FULL.match(text, end):
                names += [(*m.span(k), "given" if _is_given(m[k]) else "family") for k in (1, 2) if m[k][0].isupper()] if m[1][0].isupper() and m[2][0].isupper() else []
        elif (start == 0 or not text[start - 1].isalnum()) and not text.endswith(SAINTS, max(0, start - 8), start):
            stop = end + 1 if kind == "given" else end
            if kind == "given":
                if stop < len(text) and (text[stop].isalnum() or text[stop] == "_"):
                    continue
                names.append((start, stop, "given"))
            if (m := FAMILY.match(text, stop)) and m[1][0].isupper() and not _is_given(m[1]):
                names.append((*m.span(1), "family"))
    if families := {text[a:b].lower() for a, b, kind in names if kind == "family"}:
        # the other mentions of a family name in this text
        names += [(*m.span(), "family") for m in WORDS.finditer(text) if m[0][0].isupper() and m[0].lower() in families and not INSTITUTION.match(text, m.end())]
    if "0" <= max(text, default="") and NUMBERS.search(text):
        for kind, pattern, valid in (("iban", IBAN, _valid_iban), ("card", CARD, lambda v: not luhn(re.sub(r"\D", "", v))), ("ip", IP, None), ("ssn", SSN, None), ("phone", PHONE, lambda v: 8 <= sum(map(str.isdigit, v)) <= 15)):
            found += [(*m.span(), kind) for m in pattern.finditer(text) if (valid is None or valid(m[0])) and not (kind == "ip" and VERSION.search(text[max(0, m.start() - 10) : m.start()]))]
    low = text.lower()
    for kind, pattern, words in (("ssn", SAID_SSN, ("ssn", "social security")), ("passport", PASSPORT, ("passport",)), ("birth", BIRTH, ("birth", "dob", "born"))):
        if any(w in low for w in words):
            found += [(*m.span(1), kind) for m in pattern.finditer(text)]
    found += names
    order = {kind: k for k, kind in enumerate(("secret", "email", "key", "iban", "card", "ip", "ssn", "passport", "birth", "phone", "given", "family"))}
    out: list[tuple[int, int, str]] = []
    for entity in sorted(found, key=lambda e: (e[0], order[e[2]], -e[1])):
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
        elif order[entity[2]] < order[out[-1][2]]:
            out[-1] = entity
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end in the original, kind, surrogate) of each."""
    parts, done, log = [], 0, []
    for start, end, kind in entities(text):
        new = surrogates.of(kind, text[start:end])
        parts += [text[done:start], new]
        done = end
        log.append((start, end, kind, new))
    return ("".join([*parts, text[done:]]) if log else text), log


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """df with a struct (text, entities array of (start, end, kind, surrogate)) of each whole text. Map-only.

    Offsets count characters of the original text. A null text stays null with no entities, an empty one empty. Repeated rows and
    null ids are treated like others; an empty table gives no rows. A column of df that has the output's name is replaced; no
    other column is read.
    """
    prepare(df.sparkSession)
    surrogates = Surrogates(key)

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [replace(t, surrogates) if t is not None else (None, []) for t in texts]
            spans = [[{"start": a, "end": b, "kind": k, "surrogate": s} for a, b, k, s in log] for _, log in rows]
            yield pd.DataFrame({"text": [t for t, _ in rows], "entities": spans}, dtype=object)

    kind = "text string, entities array<struct<start: int, end: int, kind: string, surrogate: string>>"
    return df.withColumn(out_col, F.pandas_udf(column, kind)(F.col(text_col).cast("string")))


def collisions(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, originals): surrogates that stand for more than one entity or are the entity itself. None are expected.

    Entities are compared in lower case, without separators. Distinct (kind, entity, surrogate) rows are shuffled, not texts.
    """
    spans = pseudonymise(df.select(F.col(text_col).cast("string").alias("text")), key, "text", "pii").select("text", F.explode("pii.entities").alias("e"))
    plain = lambda c: F.lower(F.regexp_replace(c, r"[ ().-]", ""))
    pairs = spans.select("e.kind", plain(F.expr("substring(text, e.start + 1, e.end - e.start)")).alias("original"), plain(F.col("e.surrogate")).alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("originals"), F.max(F.col("original") == F.col("surrogate")).alias("same")).where("originals > 1 or same").drop("same")
