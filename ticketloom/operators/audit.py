"""Fifteen detectors of personal data that redaction may have missed.

They share nothing with the rewriting patterns: each reads the words around a cue, so
that a gap in a pattern shows here. Brackets hold placeholders, which never count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import regex

Finding = tuple[str, str]
_WORD = regex.compile(r"\[\w+\]|[@+]?[\p{L}\p{N}_][\p{L}\p{N}_'’\-]*|[.!?\n,]")
_STOP = frozenset(".!?\n")

GREETINGS = frozenset("hi hello hey dear hola bonjour hallo ciao olá merhaba привет здравствуйте вітаю".split())
HONORIFICS = frozenset("mr mrs ms miss dr prof sir madam señor señora herr frau monsieur madame".split())
CLOSINGS = frozenset("regards sincerely wishes thanks cheers truly yours saludos cordialement grüße grüßen saluti atenciosamente".split())
ROLES = frozenset("advisor adviser psychic expert reader astrologer tarologist medium mystic healer oracle guide coach".split())
SERVICES = frozenset("reading readings session sessions chat advice answer answers prediction predictions response consultation".split())
NAMED = (
    "name is", "me llamo", "mi nombre es", "je m'appelle", "mon nom est", "ich heiße", "mein name ist", "mi chiamo", "meu nome é", "me chamo", "nazywam się",
    "меня зовут", "мене звати", "benim adım", "ismim", "i am called", "call me",
)
INTRODUCED = ("i'm", "i am", "im", "this is", "ich bin", "soy", "je suis", "sono", "sou", "я", "jestem")
STREETS = frozenset("street st avenue ave road rd drive dr lane ln court ct boulevard blvd way place terrace straße strasse".split())
STREETS_BEFORE = frozenset("rue calle avenida via rua улица вулиця ulica".split())
CODES = frozenset("code otp kodu pin código codice kod код bestätigungscode".split())
BIRTH = frozenset("born birth birthday birthdate dob nacido nacida geboren né née nato nata родился родилась".split())
CONTACT = frozenset("phone mobile cell tel telephone call text whatsapp viber telegram number reach contact номер телефон".split())
# Capitalised words that are no names.
PLAIN = frozenset(
    """i i'm i've i'd i'll we we're you your you're it it's the a an this that these those there they he she my our and but so if or not no yes as at in on of for to from with by when what why how who
    please thank thanks sorry hello hi dear hey best kind regards sincerely team support customer user friend all everyone sir madam good morning afternoon evening is was are am do did does can could will would
    apple google paypal android iphone ios app store play monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    english spanish french german italian portuguese turkish polish ukrainian russian american british european call order card bank again also after before since because now then today""".split()
)


@dataclass(frozen=True)
class Word:
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower().replace("’", "'")

    @property
    def name(self) -> bool:
        """A word with a capital that could be a name."""
        return self.text[0].isupper() and len(self.text) > 1 and self.low not in PLAIN and self.low.removesuffix("'s") not in PLAIN


def words(text: str) -> list[Word]:
    return [Word(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]


def _after(ws: list[Word], i: int, n: int) -> Iterator[Word]:
    """Up to n words behind position i, commas aside, to the end of the sentence."""
    for w in ws[i + 1 :]:
        if w.text in _STOP or n == 0:
            return
        if w.text != ",":
            n -= 1
            yield w


def _cued(cues: frozenset[str], window: int, test: Callable[[Word], bool]) -> Callable[[str, list[Word]], Iterator[str]]:
    """The first word in the window behind a cue that passes the test, unless a placeholder stands before it."""

    def look(text: str, ws: list[Word]) -> Iterator[str]:
        for i, w in enumerate(ws):
            if w.low.strip("'") in cues:
                for x in _after(ws, i, window):
                    if x.text[0] == "[":
                        break
                    if test(x):
                        yield x.text
                        break

    return look


def _behind(phrases: tuple[str, ...], test: Callable[[Word], bool]) -> Callable[[str, list[Word]], Iterator[str]]:
    """The word right behind a phrase of one to three words."""
    split = [p.split() for p in phrases]

    def look(text: str, ws: list[Word]) -> Iterator[str]:
        low = [w.low for w in ws]
        for i in range(len(ws)):
            for p in split:
                j = i + len(p)
                if low[i:j] == p and j < len(ws) and test(ws[j]):
                    yield ws[j].text

    return look


def _digits(n: int, m: int) -> Callable[[Word], bool]:
    return lambda w: w.text.isdigit() and n <= len(w.text) <= m


def _sign_off(text: str, ws: list[Word]) -> Iterator[str]:
    for i, w in enumerate(ws):
        if w.low in CLOSINGS:
            rest = [x for x in ws[i + 1 :] if x.text not in ".!?\n,"]
            if 0 < len(rest) <= 3 and rest[0].name:
                yield rest[0].text


def _trailing(text: str, ws: list[Word]) -> Iterator[str]:
    last = regex.split(r"[.!?\n]\s*", text.rstrip(" .!?\n"))
    found = words(last[-1])
    if len(last) > 1 and 1 <= len(found) <= 3 and all(w.name for w in found):
        yield found[0].text


def _phone(text: str, ws: list[Word]) -> Iterator[str]:
    for m in regex.finditer(r"\+?\d[\d ().\-]{6,20}\d", text):
        n = sum(c.isdigit() for c in m[0])
        before = {w.low for w in words(text[max(0, m.start() - 30) : m.start()])}
        if 7 <= n <= 15 and (m[0][0] == "+" or before & CONTACT):
            yield m[0]


def _from_team(text: str, ws: list[Word]) -> Iterator[str]:
    for i, w in enumerate(ws[:-2]):
        if w.name and ws[i + 1].low == "from" and (ws[i + 2].low in {"the", "support", "customer", "team", "your"} or ws[i + 2].name):
            yield w.text


def _advisor(text: str, ws: list[Word]) -> Iterator[str]:
    for i, w in enumerate(ws):
        if w.low in ROLES:
            near = [x for x in _after(ws, i, 2)]
            if near and near[0].low in {"named", "called", "is"}:
                near = near[1:]
            if near and near[0].name:
                yield near[0].text


def _possessive(text: str, ws: list[Word]) -> Iterator[str]:
    for a, b in zip(ws, ws[1:], strict=False):
        if a.name and a.low.endswith("'s") and b.low in SERVICES:
            yield a.text


def _remnant(text: str, ws: list[Word]) -> Iterator[str]:
    for m in regex.finditer(r"\[(?:Name|Agent|Advisor)\][ \t]+([\p{L}][\p{L}'’\-]+)(?=[ \t]*(?:[,!\n]|$))", text):
        if m[1][0].isupper() and m[1].lower() not in PLAIN or text[m.end() : m.end() + 1] == ",":
            yield m[1]


def _handle(text: str, ws: list[Word]) -> Iterator[str]:
    for w in ws:
        if w.text[0] == "@" and len(w.text) > 3 and (w.start == 0 or text[w.start - 1].isspace() or text[w.start - 1] in "(,:;") and w.low[1:] not in PLAIN:
            yield w.text


def _address(text: str, ws: list[Word]) -> Iterator[str]:
    for i, w in enumerate(ws):
        if w.text.isdigit() and len(w.text) <= 5:
            near = list(_after(ws, i, 5))
            for k, x in enumerate(near):
                if k and x.low in STREETS and all(y.text[0].isupper() for y in near[:k]):
                    yield text[w.start : x.end]
                    break
        if w.low in STREETS_BEFORE and any(x.text.isdigit() for x in _after(ws, i, 4)):
            yield w.text


def _birth(text: str, ws: list[Word]) -> Iterator[str]:
    for w in ws:
        if w.low in BIRTH and (m := regex.match(r"[^.!?\n\[]{0,40}?(\d[\d:/.\-]*\d)", text[w.end :])):
            yield m[1]


DETECTORS: dict[str, Callable[[str, list[Word]], Iterator[str]]] = {
    "greeting": _cued(GREETINGS, 4, lambda w: w.name),
    "honorific": _cued(HONORIFICS, 1, lambda w: w.name),
    "sign-off": _sign_off,
    "trailing-name": _trailing,
    "phone": _phone,
    "from-team": _from_team,
    "advisor": _advisor,
    "possessive": _possessive,
    "after-placeholder": _remnant,
    "self-name": _behind(NAMED, lambda w: w.text[0].isalpha() and w.low not in PLAIN),
    "self-intro": _behind(INTRODUCED, lambda w: w.name),
    "confirmation-code": _cued(CODES, 3, _digits(4, 8)),
    "handle": _handle,
    "address": _address,
    "birth-data": _birth,
}


def findings(text: str | None) -> list[Finding]:
    """(category, token) of what still looks personal, in the order of the detectors."""
    ws = words(text or "")
    return [(category, token) for category, look in DETECTORS.items() for token in look(text or "", ws)]
