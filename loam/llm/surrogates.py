"""Detected entities and their keyed surrogates of the same type, format, script and gender.

A surrogate is drawn from its entity by a keyed one-way hash, so it tells nothing about the entity without the key. Drawing again
(``attempt`` 1, 2, ...) gives others; from attempt LONGER on they have more characters, so no format ever runs out of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

#: Given names by script and gender, for detection and for a surrogate's gender.
GIVEN = {
    "latin f": "anna maria laura julia sophie emma clara helena ingrid carmen lucia elena martha alice marie louise nora ida greta paula".split(),
    "latin m": "john peter thomas paul david martin robert carlos miguel pierre jean hans karl otto felix oscar victor hugo adam louis".split(),
    "cyrillic f": "анна мария елена ольга ирина наталья татьяна светлана галина вера".split(),
    "cyrillic m": "иван пётр сергей андрей николай михаил алексей дмитрий павел виктор".split(),
    "greek f": "μαρία ελένη άννα κατερίνα σοφία".split(),
    "greek m": "γιώργος νίκος δημήτρης κώστας γιάννης".split(),
}
LISTED = {name: k for k, names in GIVEN.items() for name in names}
#: What given names end with, by script and gender; before it stand syllables.
ENDINGS = {
    "latin f": "a ia ina ella ette elle anna lise".split(), "latin m": "o us an el ert on ian ius".split(),
    "cyrillic f": "а ия ина ана ена ида ла ника".split(), "cyrillic m": "ий ан ир ей слав мир он ил".split(),
    "greek f": "α ία ίνα ούλα ένη ώ".split(), "greek m": "ος ης ας ιος άκης ων".split(),
}
#: Consonants and vowels that names are made of.
SYLLABLES = {"latin": ("bdfghklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζθκλμνπρστφχ", "αεηιου")}
#: Characters of given names in a script without letters' case.
HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀兰霞平刚桂英华玉"
#: Letters that stand for each other where a text's letters need not be a name; vowels stay vowels.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àâéèêëîïôùûüáíóúñäöåæø", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")

TITLES = "Mr Mrs Ms Miss Mister Herr Frau Monsieur Madame Mme Señor Señora Dr Prof Господин Госпожа Κύριος Κυρία".split()
#: What stands before a person's name of two words or more, beside titles.
CONTEXTS = ["my name is ", "My name is ", "mein Name ist ", "Mein Name ist ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут ",
            "Sincerely, ", "Sincerely,\n", "Kind regards, ", "Kind regards,\n", "Best regards, ", "Best regards,\n", "From: ", "To: ", "Cc: ", "Signed-off-by: ", "Author: "]
#: Kinds of streets, before or after their name, and what may stand between.
STREETS = "street avenue road lane drive boulevard rue place calle avenida plaza via de du des del la le".split()
SUFFIXES = "straße strasse weg platz allee gasse".split()
#: A word of a name: with a capital in scripts that have them; up to four characters in others.
_WORD = r"(?:[\p{Lu}\p{Lt}][\w'’-]+|\p{Lo}{2,4}(?!\w))"
_CAPITAL = r"[\p{Lu}\p{Lt}][\w'’-]+"
#: First match wins.
PATTERNS = (
    ("secret", r"(?P<secret>(?<=[\"'])[A-Za-z0-9_\-+/=]{20,}(?=[\"'])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-fA-F]{32,64})(?![A-Za-z0-9]))"),
    ("email", r"(?P<email>[\w.+\-]*[\w+\-]@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"),
    ("iban", r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"),
    ("phone", r"(?P<phone>\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,5}){1,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])|(?<![\w.,\-/])0\d{2,4}[ /\-]\d{5,9}(?![\w\-]))"),
    ("ip", r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d))"),
    ("ssn", r"(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"),
    ("card", r"(?P<card>(?<![\w.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\w\-]))"),
    ("address", rf"(?P<address>(?<![\w.,\-])\d{{1,5}} (?:{_CAPITAL} ){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Boulevard)(?!\w)|(?<!\w)\p{{Lu}}\w*(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}[a-z]?(?!\w)|(?<![\w.,\-])\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le) )*{_CAPITAL}|(?<!\w)(?:Calle|Avenida|Plaza|Via) (?:(?:de|del|la) )*{_CAPITAL},? \d{{1,4}}(?!\w))"),
    ("name", rf"(?P<name>(?<=\b(?:TITLE)\.? )(?!(?:TITLE)\b){_WORD}(?: {_CAPITAL}){{0,2}}|(?<=CONTEXT)(?!(?:TITLE)\b){_CAPITAL}(?: {_CAPITAL}){{1,2}})"),
)


def _finder() -> re.Pattern:
    import regex

    return regex.compile("|".join(p.replace("TITLE", "|".join(TITLES)).replace("CONTEXT", "|".join(map(regex.escape, CONTEXTS))) for _, p in PATTERNS))


def maybe(raw: bytes, _digit=re.compile(rb"[0-9]"), _titles=tuple((t + x).encode() for t in TITLES for x in (" ", ". ")) + tuple(c.encode() for c in CONTEXTS)) -> bool:
    """Whether a text can hold an entity; cheap."""
    return _digit.search(raw) is not None or b"@" in raw or b'"' in raw or b"'" in raw or any(t in raw for t in _titles) or maybe_given(raw)


#: For bytes.translate: all but ASCII letters turn into spaces.
_LETTERS_ONLY = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_ASCII_GIVEN = frozenset(w.encode() for n in LISTED if n.isascii() for w in (n.title(), n.upper()))
_OTHER_GIVEN = tuple(w.encode() for n in LISTED if not n.isascii() for w in (n.title(), n.upper()))


def maybe_given(raw: bytes) -> bool:
    """Whether a text can hold a listed given name; cheap."""
    if not _ASCII_GIVEN.isdisjoint(raw.translate(_LETTERS_ONLY).split()):
        return True
    return not raw.isascii() and any(w in raw for w in _OTHER_GIVEN)


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    norm: str


def normal(kind: str, text: str) -> str:
    """What mentions of one entity share."""
    return text if kind == "secret" and not re.fullmatch("[0-9a-fA-F]+", text) else text.lower() if len(text.lower()) == len(text) else text


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _remainder(iban: str) -> int:
    """Of an IBAN (lower case), by 97; a correct one leaves 1."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


@lru_cache(4096)
def _neighbours(c: str) -> str:
    """The letters of a script without alphabets here that may stand for ``c``."""
    if "一" <= c <= "鿿":
        return HAN
    first = ord(c) - ord(c) % 64
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and x.islower() == c.islower())


def _alphabets(kind: str, text: str) -> list[str]:
    """For each character, those that may stand in its place (itself alone: it is kept)."""
    hexa = kind == "secret" and re.fullmatch("[0-9a-f]+", text) is not None
    keep = len(text)
    if kind == "email":
        host = text.rindex("@") + 1
        keep = max(host, text.rfind(".", host, text.rindex("."))) if text.count(".", host) > 1 else text.rindex(".")
    first = len(re.match(r"\+\d{1,3}(?=\D)|\+1|0|", text)[0]) if kind == "phone" else 2 if kind == "iban" else 1 if kind == "card" else 0
    out = []
    for i, c in enumerate(text):
        if i < first or i >= keep:
            out.append(c)
        elif hexa:
            out.append("0123456789abcdef")
        elif "0" <= c <= "9":
            out.append("0123456789")
        elif kind == "secret" and c.isascii() and c.isalpha():
            out.append("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        else:
            out.append(next((a for a in LETTERS if c in a), c))
    return out


class Draw:
    """Choices that a key, an entity and an attempt determine."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.key = hashlib.blake2b(key).digest()
        self.seed, self.blocks, self.left = f"{kind}\0{attempt}\0{norm}".encode(), 0, b""

    def __call__(self, choices):
        if len(self.left) < 8:
            self.left += hashlib.blake2b(b"%d " % self.blocks + self.seed, key=self.key).digest()
            self.blocks += 1
        x, self.left = int.from_bytes(self.left[:8], "little"), self.left[8:]
        return choices[x % len(choices)]


def _word(draw: Draw, word: str, more: int) -> str:
    """A name of the same script, and of the same length and ``more``; a last letter that tells the gender stays."""
    script = next((s for s, letters in SYLLABLES.items() for c in word if c in "".join(letters)), None)
    out, vowel = [], None
    for c in word:
        if not c.isalpha():
            out.append(c)
            vowel = None
        elif script is None:
            out.append(draw(_neighbours(c) or c))
        else:
            vowel = draw([False, False, True]) if vowel is None else not vowel
            out.append(draw(SYLLABLES[script][vowel]))
    if script in ("cyrillic", "greek") and len(word) > 4 and word[-1].isalpha():
        out[-1] = word[-1]
    at = 1 if len(out) > 1 and out[0].isalpha() else len(out)
    for _ in range(more):
        out.insert(at, draw(SYLLABLES[script][1] if script else _neighbours(next(c for c in word if c.isalpha()))))
    return "".join(out)


class Surrogates:
    """(kind, normal form, attempt) -> a surrogate's normal form, of the same kind, format, script and gender."""

    #: Attempts with the entity's own length; each later one has one character more.
    LONGER = 4

    def __init__(self, key: bytes):
        self.key = key

    def __call__(self, kind: str, norm: str, attempt: int = 0) -> str:
        draw, more = Draw(self.key, kind, norm, attempt), max(0, attempt - self.LONGER + 1)
        if kind == "name":
            return self._name(draw, norm, more)
        if kind == "address":
            return re.sub(r"\d+|[^\W\d_]+", lambda m: self._street(draw, m[0], more), norm)
        if kind == "ip":  # of octets as long as the entity's; later of any
            octets = [range(256) if more else range(*((0, 10), (10, 100), (100, 256))[len(p) - 1]) for p in norm.split(".")]
            return ".".join(str(draw(o)) for o in octets)
        alphabets = _alphabets(kind, norm)
        last = max((i for i, a in enumerate(alphabets) if len(a) > 1), default=len(alphabets) - 1)
        alphabets[last + 1 : last + 1] = [alphabets[last] if len(alphabets[last]) > 1 else "0123456789"] * more
        out = [draw(a) if len(a) > 1 else a for a in alphabets]
        if kind == "card":  # numbers that pass the check stay such numbers
            digits = [i for i, c in enumerate(out) if c.isdigit()]
            valid = luhn([int(c) for c in norm if c.isdigit()])
            out[digits[-1]] = draw([d for d in "0123456789" if luhn([int(out[i]) for i in digits[:-1]] + [int(d)]) == valid])
        if kind == "iban" and _remainder(norm) == 1:
            out[2:4] = "00"
            out[2:4] = f"{98 - _remainder(''.join(out)):02d}"
        return "".join(out)

    @staticmethod
    def _name(draw: Draw, word: str, more: int) -> str:
        group = LISTED.get(word)
        if group is None:
            return _word(draw, word, more)
        consonants, vowels = SYLLABLES[group.split()[0]]
        head = "".join(draw(consonants) + draw(vowels) for _ in range(1 + more)) + draw(consonants)
        return head + draw(ENDINGS[group])

    @staticmethod
    def _street(draw: Draw, word: str, more: int) -> str:
        if word.isdigit():
            return draw("123456789") + "".join(draw("0123456789") for _ in word[1:])
        if word in STREETS or len(word) == 1:
            return word
        suffix = next((s for s in SUFFIXES if word.endswith(s)), "")
        stem = word[: len(word) - len(suffix)]
        return (_word(draw, stem, more) if stem else "") + suffix


def dressed(surrogate: str, original: str) -> str:
    """The surrogate in the original's upper and lower case."""
    if len(surrogate) == len(original):
        return "".join(s.upper() if o.isupper() and len(s.upper()) == 1 else s for s, o in zip(surrogate, original, strict=True))
    if original.isupper() and len(original) > 1:
        return surrogate.upper()
    return surrogate[:1].upper() + surrogate[1:] if original[:1].isupper() else surrogate


def units(kind: str, norm: str) -> list[str]:
    """What gets a surrogate of its own: each word of a name, so that a part of it gets the whole's surrogate."""
    return norm.split(" ") if kind == "name" else [norm]


def replaced(kind: str, surrogates: list[str], original: str) -> str:
    """A mention's text, from the surrogates of its units."""
    parts = original.split(" ") if kind == "name" else [original]
    return " ".join(dressed(s, o) for s, o in zip(surrogates, parts, strict=True))


_POSSESSIVE = re.compile(r"['’][sS]?$")


class Detector:
    """Entities by PATTERNS; then listed given names with the surnames after them; then, of all names of the text, every
    other capitalised whole-word mention of the name or a part of it."""

    def __init__(self):
        import regex

        self.finder = _finder()
        given = "|".join(w for n in LISTED for w in (n.title(), n.upper()))
        self.given = regex.compile(rf"(?<![\w'’-])(?:{given})(?: {_CAPITAL}){{1,2}}")
        self.words = regex.compile(r"(?<![\w-])[\p{Lu}\p{Lt}\p{Lo}][\w'’-]*")
        self.titles = {t.lower() for t in TITLES}

    def _mentions(self, text: str, parts: set[str]) -> list[list[int]]:
        """Places of capitalised words in ``parts`` (a word may go on after an apostrophe); those a space apart are one."""
        out: list[list[int]] = []
        for m in self.words.finditer(text):
            word, end = m[0].lower(), len(m[0])
            while end > 0 and word[:end] not in parts:
                end = max(word.rfind("'", 0, end), word.rfind("’", 0, end))
            if end > 0 and len(word) == len(m[0]):
                start, end = m.start(), m.start() + end
                if out and out[-1][1] + 1 == start and text[out[-1][1]] == " ":
                    out[-1][1] = end
                else:
                    out.append([start, end])
        return out

    @staticmethod
    def _found(kind: str, start: int, text: str) -> Found:
        if kind == "name":
            text = _POSSESSIVE.sub("", text)
        return Found(kind, start, start + len(text), normal(kind, text))

    def _more(self, found: list[Found], places) -> list[Found]:
        """``found`` and those of ``places`` that overlap none of them."""
        taken = sorted((x.start, x.end) for x in found)
        starts = [a for a, _ in taken]
        new = [x for x in places if (k := bisect_left(starts, x.end)) == 0 or taken[k - 1][1] <= x.start]
        return sorted(found + new, key=lambda x: x.start)

    def __call__(self, text: str) -> list[Found]:
        found = [self._found(m.lastgroup, m.start(), m[0]) for m in self.finder.finditer(text)]
        if maybe_given(text.encode()):
            found = self._more(found, (self._found("name", m.start(), m[0]) for m in self.given.finditer(text)))
        parts = {w for x in found if x.kind == "name" for w in x.norm.split(" ")} - self.titles
        if parts:
            found = self._more(found, (self._found("name", a, text[a:b]) for a, b in self._mentions(text, parts)))
        return found
