"""Candidates for personal information in a text: where they are and what they look like.

Patterns are generous; the model in pii.py decides which candidates are real.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME, EMAIL, PHONE, IDENTITY, ADDRESS = "name", "email", "phone", "identity_number", "street_address"

_AT = r"(?:@|%40|&#64;| ?[\[(] ?at ?[\])] ?)"
_DOT = r"(?:\.| ?[\[(] ?dot ?[\])] ?| dot )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9À-ÿ](?:[\wÀ-ÿ.+-]{0,62}[\wÀ-ÿ+-])?"
EMAIL_RE = re.compile(rf"(?<![\w.+-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}|{_LOCAL} at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,24}})(?![\w-])", re.IGNORECASE)
_LOGIN_BEFORE = re.compile(r"[a-z]://[^\s/]*$")
_LOGIN_AFTER = re.compile(r":[\w.~-]*/[\w.~/-]|:[\w~-]+\.git\b")
#: Parts of every e-mail address, in lower case: a line without any of them has none.
_EMAIL_HINTS = ("@", "%40", "&#64;", " at ", "[at", "(at", "[ at", "( at")

#: Written forms of telephone and identity numbers; the first that fits counts.
NUMBER_FORMS = {
    "us": (PHONE, r"(?:\+1[ .-]?|1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?:,? ?(?:ext\.?|x) ?\d{1,6})?"),
    "plus": (PHONE, r"\+\d{1,3}(?:[ .-]?\(0?\)?\d{0,5}\)?)?(?:[ .-]?\d{1,5}){2,7}(?:,? ?(?:ext\.?|x) ?\d{1,6})?"),
    "prefix00": (PHONE, r"00[1-9]\d(?:[ .-]?\d{1,5}){2,5}[ .-]?\d{3,12}|00[1-9]\d \d{2,4} \d{5,10}"),
    "pairs": (PHONE, r"0\d(?:[ .-]\d\d){4}"),
    "area": (PHONE, r"\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,4}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|0\d{2} \d{7,8}"),
    "slash": (PHONE, r"0\d{2,4}/\d{3,8}(?:-\d{1,5})?"),
    "ssn": (IDENTITY, r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"),
    "nino": (IDENTITY, r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),
    "elevens": (IDENTITY, r"\d{2} \d{3} \d{3} \d{3}"),
    "twelves": (IDENTITY, r"\d{4} \d{4} \d{4}"),
    "birth": (IDENTITY, r"\d{6}[-+]\d{4}"),
    "letter": (IDENTITY, r"\d{8}-?[A-Z]"),
    "passport": (IDENTITY, r"[A-Z]\d{8}"),
    "nine": (IDENTITY, r"\d{9}"),
}
NUMBER_RE = re.compile(r"(?=[\d+(A-Z])(?<![\w.+\-/#@$%&])(?=[+(]?[A-Z]{0,2} ?\d)(?:" + "|".join(f"(?P<{k}>{p})" for k, (_, p) in NUMBER_FORMS.items()) + r")(?![\w@]|[-./:]\d)")

_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Row|Way|Blvd|Boulevard|Place|Pl|Square|Sq|Close|Gardens|Crescent|Hill|Grove|Mews|Parade|Highway|Parkway|Walk|Quay"
_FRENCH = "rue|avenue|boulevard|place|chemin|impasse|all[ée]e|quai|cours|route"
_SPANISH = r"Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Via|Viale|Rua"
_GERMAN = r"straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer|laan|straat|gracht|plein|gatan|vägen|vej"
_AM = "Am|An der|Im|Zum|Zur|Auf dem|Unter den"
_WORD = r"[A-ZÀ-Þ][\wÀ-ÿ'’-]+"
_NO = r"\d{1,5}[A-Za-z]?"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor)\.? ?\d{1,4}[A-Za-z]?,? )?"
#: Written forms of street addresses up to the street or house number, and what may follow on the line.
ADDRESS_FORMS = {
    "english": rf"{_UNIT}{_NO} (?:{_WORD} ){{1,3}}?(?:{_STREETS})\b\.?",
    "french": rf"{_UNIT}\d{{1,4}}(?: ?bis| ?ter|[a-z])?,? (?:{_FRENCH})(?: (?:de la|de l['’]|des|du|de|d['’]))? ?[\wÀ-ÿ'’-]+",
    "spanish": rf"(?:{_SPANISH}) (?:(?:de|del|la|las|los) )*{_WORD}(?: {_WORD})?,? \d{{1,4}}[a-z]?",
    "german": rf"[A-ZÀ-Þ][\wÀ-ÿ-]*(?:{_GERMAN}) {_NO}",
    "am": rf"(?:{_AM}) {_WORD} {_NO}",
}
_AFTER = rf"(?:,? (?:Apt|Apartment|Unit|Suite|Flat|Floor)\.? ?\d{{1,4}}[A-Za-z]?|, \d{{1,2}}[ºª°](?: [A-Z])?|, \d{{4,6}} {_WORD}(?: (?:{_WORD}|am|an|sur|der))*|, {_WORD}(?: (?:{_WORD}|am|an|sur|der))*(?: \d{{4,6}})?| \d{{5}})"
ADDRESS_RE = re.compile(r"(?<![\w.,/-])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in ADDRESS_FORMS.items()) + rf")(?P<rest>{_AFTER}*)")
#: Parts of every form, of the same words: a line without any of them has no address. True: the word ends there.
_ADDRESS_HINTS = (
    *[(f" {w}", True) for w in _STREETS.split("|")], *[(f" {w}", False) for w in _FRENCH.replace("all[ée]e", "allée|allee").split("|")], *[(f"{w} ", False) for w in _SPANISH.replace("\\", "").split("|")],
    *[(f"{w} ", False) for w in _GERMAN.replace("\\", "").split("|")], *[(f"{w} ", False) for w in _AM.split("|")],
)

PARTICLES = r"(?:(?:de|di|da|del|von|van|der|den|al|el|la|le|bin|ibn|zu|af)[ -])"
_SUR = rf"{PARTICLES}*(?:[^\W\d_]['’])?[^\W\d_]{{2,25}}(?:-[^\W\d_]{{2,24}}){{0,2}}"
_INITIALS = r"[A-Za-zÀ-ÿ]\.(?: ?[A-Za-zÀ-ÿ]\.){0,2}"
_SUR_RE = re.compile(rf" ({_SUR})(?![\w@])", re.IGNORECASE)
_BEFORE_RE = re.compile(rf"(?<![\w@.+-])({_SUR}), $", re.IGNORECASE)
_INITIAL_RE = re.compile(r" [^\W\d_]\.")
_FIRST_RE = re.compile(r"(?<=\. )(?=[^\W\d_])")
_INITIALS_BEFORE_RE = re.compile(r"(?<![\w.@-])(?<!\w['’])(?:[^\W\d_]\. ?){0,2}[^\W\d_]\. $")
_FIRST_SUR_RE = re.compile(rf"({_SUR})(?![\w@(=])", re.IGNORECASE)
_LAST_INITIALS_RE = re.compile(r", [^\W\d_a-zà-ÿ]\.(?: [^\W\d_a-zà-ÿ]\.)?(?![\w.])")
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_CAPITAL_BEFORE_RE = re.compile(r"(?<![\w@.'’+-])([^\W\d_a-zà-ÿ][^\W\d_A-ZÀ-Þ]{1,24})$")
_DIGIT = re.compile(r"\d")
_WORD_CHAR = re.compile(r"[\w@]")


@dataclass(slots=True)
class Candidate:
    start: int
    end: int
    kind: str
    form: str
    core: str  #: surname, digits or street: what repeats when the same thing is named again
    given: str = ""  #: the given name, in lower case


def lowered(text: str) -> str:
    """Lower case with the same length, so that positions stay valid."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> set[str]:
    """The words of a text that may be given names, in lower case: letters with hyphens, whole and up to each hyphen."""
    out = set()
    for w in set(_TOKEN.findall(lowered(text))):
        parts = w.split("-")
        out.update("-".join(parts[: i + 1]) for i in range(min(len(parts), 8)))
        out.add(w)
    return out


def lines_with(text: str, hints, searched: str | None = None) -> list[tuple[int, int]]:
    """Start and end of the lines that hold one of the hints: literals, or pairs (literal, whether a word must end there)."""
    searched = text if searched is None else searched
    found: set[tuple[int, int]] = set()
    for hint in hints:
        word, whole = hint if isinstance(hint, tuple) else (hint, False)
        at = searched.find(word)
        while at >= 0:
            after = at + len(word)
            if whole and after < len(text) and (text[after].isalnum() or text[after] == "_"):
                at = searched.find(word, after)
                continue
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            found.add((text.rfind("\n", 0, at) + 1, end))
            at = searched.find(word, end)
    return sorted(found)


def emails(text: str, low: str) -> list[Candidate]:
    out = []
    for a, b in lines_with(text, _EMAIL_HINTS, low):
        out += _emails(text, a, b)
    return out


def _emails(text: str, a: int, b: int) -> list[Candidate]:
    out = []
    for m in EMAIL_RE.finditer(text, a, b):
        s = m.group()
        # A login in a repository or database address is no e-mail address.
        if _LOGIN_BEFORE.search(text, max(0, m.start() - 80), m.start()) or _LOGIN_AFTER.match(text, m.end()):
            continue
        form = "at" if "@" in s else "escaped" if "%40" in s or "&#64;" in s else "bracket" if re.search(r"[\[(] ?at", s, re.IGNORECASE) else "words"
        out.append(Candidate(m.start(), m.end(), EMAIL, form, s.lower()))
    return out


def numbers(text: str) -> list[Candidate]:
    out = []
    for m in NUMBER_RE.finditer(text):
        form = m.lastgroup
        digits = re.sub(r"\D", "", m.group())
        if NUMBER_FORMS[form][0] == PHONE and not 7 <= len(digits) <= 20:
            continue
        out.append(Candidate(m.start(), m.end(), NUMBER_FORMS[form][0], form, digits))
    return out


def addresses(text: str) -> list[Candidate]:
    out = []
    for a, b in lines_with(text, _ADDRESS_HINTS):
        if _DIGIT.search(text, a, b):
            out += [Candidate(m.start(), m.end(), ADDRESS, next(k for k in ADDRESS_FORMS if m.group(k)), m.group()[: len(m.group()) - len(m.group("rest"))].lower()) for m in ADDRESS_RE.finditer(text, a, b)]
    return out


def names(text: str, low: str, given, lexicon: frozenset[str]) -> list[Candidate]:
    """given: an Aho-Corasick automaton of given names in lower case (None: no lexicon yet)."""
    out: list[Candidate] = []
    until = -1
    for last, word in given.iter(low) if given is not None else ():
        start, end = last + 1 - len(word), last + 1
        if start < until or (start and (_WORD_CHAR.match(low, start - 1) or low[start - 1] in "-.+" or (low[start - 1] in "'’" and start > 1 and low[start - 2].isalnum()))) or (end < len(low) and (_WORD_CHAR.match(low, end) or low[end] == "-")):
            continue
        before = _BEFORE_RE.search(text, max(0, start - 64), start)
        at, more = end, True
        while more:
            m = _INITIAL_RE.match(text, at)
            more = bool(m)
            if m:
                at = m.end()
                continue
            m = _SUR_RE.match(text, at)
            if m and m[1].lower() in lexicon:
                follow = _SUR_RE.match(text, m.end())
                if follow or before:
                    at, more = m.end(), True
        if before and before[1].lower() not in lexicon:
            out.append(Candidate(before.start(), at, NAME, "reversed", before[1].lower(), word))
        m = _SUR_RE.match(text, at)
        if m:
            out.append(Candidate(start, m.end(), NAME, "given", m[1].lower(), word))
            until = m.end()
        else:
            until = at
    for m in _FIRST_RE.finditer(text):
        i = m.end()
        if i < 3 or not text[i - 3].isalpha() or (i > 3 and (text[i - 4].isalnum() or text[i - 4] in "@-_")):
            continue
        front = _INITIALS_BEFORE_RE.search(text, max(0, i - 9), i)
        sur = _FIRST_SUR_RE.match(text, i) if front else None
        if sur:
            out.append(Candidate(front.start(), sur.end(), NAME, "initials", sur[1].lower()))
    for m in _LAST_INITIALS_RE.finditer(text):
        before = _BEFORE_RE.search(text, max(0, m.start() - 62), m.start() + 2)
        if before:
            out.append(Candidate(before.start(), m.end(), NAME, "reversed_initials", before[1].lower()))
    return out + unlisted(text, low, out, lexicon)


def unlisted(text: str, low: str, found: list[Candidate], lexicon: frozenset[str]) -> list[Candidate]:
    """Names whose given name is on no list: a capitalised word before a surname that a candidate of the same text has.

    Only a mention elsewhere makes them likely, so the skip edges decide them.
    """
    out = []
    taken = sorted((c.start, c.end) for c in found)
    for sur in sorted({c.core for c in found if c.form in ("given", "reversed") and len(c.core) > 2}):
        at = low.find(f" {sur}")
        while at >= 0:
            end = at + 1 + len(sur)
            m = _CAPITAL_BEFORE_RE.search(text, max(0, at - 32), at)
            whole = m and not (end < len(text) and (_WORD_CHAR.match(text, end) or text[end] == "-")) and text[at + 1].isupper()
            if whole and m[1].lower() not in lexicon and not any(a < end and m.start(1) < b for a, b in taken):
                out.append(Candidate(m.start(1), end, NAME, "unlisted", sur, m[1].lower()))
            at = low.find(f" {sur}", end)
    return out


def candidates(text: str, given, lexicon: frozenset[str]) -> list[Candidate]:
    """All candidates of a text, by position."""
    low = lowered(text)
    found = emails(text, low) + numbers(text) + addresses(text) + names(text, low, given, lexicon)
    return sorted(found, key=lambda c: (c.start, -c.end, c.kind))
