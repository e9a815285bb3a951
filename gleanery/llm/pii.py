"""Personal information in free text, found by a semi-Markov conditional random field.

The lattice of a text holds candidate segments of all kinds: every run of
capitalised words offers its segments of at most MAX_WORDS words (particles come
on top) as names, and patterns over-generate e-mails, phone numbers, identity
numbers, addresses, citations and companies, shorter variants included. A
candidate is scored as a whole, by its kind with its shape, its words and the
words around it; a dynamic programme chooses boundaries and types of all kinds
jointly. Where no candidates overlap nothing links two places, so each connected
stretch of candidates is decoded alone, exactly as the whole text would be. No
word is barred and no score is fixed: all weights come from ``fit``, maximum
likelihood (forward-backward over segments) on a bounded sample of documents
labelled by agreement of strong contexts and on the plain sentences written in
``plain_sentences``; they are kept in ``pii_weights.json``.
"""

from __future__ import annotations

import json
import math
import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, compress
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .skeleton import CYRILLIC, GREEK

#: Words of a name, particles not counted.
MAX_WORDS = 8
#: Stretches whose decoding a worker keeps, and the longest text kept as a key.
MEMO, MEMO_CHARS = 250_000, 160
#: Documents ``fit`` takes its lexicon from, and those it fits the weights to, at most.
LEXICON_DOCUMENTS, FIT_DOCUMENTS = 10_000, 3000
WEIGHTS = Path(__file__).with_name("pii_weights.json")
KINDS = ("name", "email", "phone", "id_number", "address")

# Words of names, of companies, of streets and of citations in the four languages.
PARTICLES = ["von der", "von dem", "von", "van der", "van den", "van", "de la", "de las", "de los", "de", "del", "della", "di", "du", "da", "dos", "das", "zu", "ten", "ter", "af", "y"]
PLACES = "Mill Cross Quay Terrace House Road Lane Street Close Mews Ave Avenue Court Square Gardens"
EN_STREET = "Road|Rd|Street|St|Lane|Ln|Close|Cl|Mews|Avenue|Ave|Terrace|Terr|Court|Ct|Square|Sq|Gardens|Gdns|Drive|Place|Way|Crescent|Row|Walk|Hill|Grove|Park"
FR_STREET = "rue|avenue|place|chemin|boulevard|impasse|quai|allée|cours|route|square"
DE_STREET = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer"
ES_STREET = "C/|Calle|Avda\\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía"

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶŁĻŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
_S = r"(?:[^\S\n]+(?:\r?\n)?[^\S\n]*|\r?\n[^\S\n]*)"
_W = rf"[{_UP}][\w­]*(?:[’'](?!s\b)[\w­]+|-[\w­]+)*"
_PART = "(?:" + "|".join(p.replace(" ", r"\s+") for p in PARTICLES) + ")"
_TOK = rf"[{_UP}](?:\.(?:-[{_UP}]\.)?|[\w­]*(?:[’'](?!s\b)[\w­]+|-[\w­]+)*)"
# Each pattern begins with a set of characters, so that the scan can skip to one; particles before it are looked for afterwards.
_GUARDED = f"(?=[adtvyz]){_PART}"
# A form of address with its full stop may stand inside a run.
_TITLE_STOP = r"\.(?:" + "|".join(rf"(?<=\b{t}\.)" for t in ("Dr", "Mr", "Sr", "Ms", "Sra", "Dña", "Mme", "Prof", "Ilma", "Ilmo", "Excmo", "Excma")) + ")"
_RUN = re.compile(rf"({_TOK}(?:(?:(?<=[A-ZÀ-Þ]{{2}}),|{_TITLE_STOP})?{_S}(?:{_GUARDED}{_S}){{0,3}}{_TOK})*)")
_LEAD = re.compile(rf"(?<![\w­@])(?:{_PART}{_S}){{1,3}}$")
_PART_WORDS = {w for p in PARTICLES for w in p.split()}
#: Last two characters of a particle that stands before a blank.
_PART_TAILS = {f" {p}"[-2:] for p in PARTICLES}
_TOKEN = re.compile(rf"[\w­](?:(?<=[{_UP}])\.(?:-[{_UP}]\.)?|[\w­]*(?:[’'-][\w­]+)*)")
_WORDS = re.compile(r"\S(?:(?<=[\w­])[\w­]*)?")

_AT = ("@", "[at]", "(at)", "[AT]", "(AT)")
_LOCAL = re.compile(r"(?<![\w.+%-])[\w+%-][\w.+%-]*$")
_HOST = re.compile(r"\w[\w-]*(?:(?:\.|\s?[\[(](?:dot|punkt|punto|point)[\])]\s?)\w[\w-]*)+", re.I)
_LABEL = re.compile(r"[\w-]*[^\W\d_][\w-]*")
_HOST_PART = re.compile(r"\w[\w-]*(?=\.\w)")
_FR_WORD = re.compile(rf"\s(?:{FR_STREET})\s")
# Starts at a digit or its opening mark, so that the scan can skip to one; letters before it are looked for afterwards.
_BLOB = re.compile(r"[+(0-9](?=[\d()\-/‐-–\xa0 \t.\r\n]{3})(?:(?:[\d()\-/‐-–\xa0 \t]|\.(?=\d)|\r?\n(?=\d)){3,24}[\dA-Z](?:\d{1,4}|(?:[ -]|\r?\n)?[A-Z])?(?![\w@’'])|(?<=[0-9])[0-9]{4,}(?:[ -]?[A-Z]\d{0,4})?(?![\w@’']))")
_BLOB_HEAD = re.compile(r"(?<![\w@#€$£])[A-Z]{1,3}(?:[ \xa0-]|\r?\n)?$")
_DATE = re.compile(r"(?:\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4})(?!\d)|\d{1,3}\.\d{3}$")
_POST = rf"[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}?\d[A-Z]{{2}}"
_TAIL = rf"(?:,{_S}\d{{5}}{_S}{_W}|{_S}in{_S}\d{{5}}{_S}{_W})?"
# Each pattern starts at what is rare, a number or a fixed word; what may stand before it is looked for afterwards.
_NUMBER_WORD = re.compile(rf"[0-9][a-z]?,?\s+(?:(?=[{_UP}])|(?:bis|ter|quater|{FR_STREET})\b)")
_NUMBER_FIRST = re.compile(
    rf"[0-9]++(?![./-])(?:[a-z]?{_S}(?:(?:{_W}{_S}){{1,3}}?(?:{EN_STREET})\b(?:\.(?=,|{_S}[A-Z]{{2}}\d))?(?P<en>,?{_S}(?:{_W},?{_S}{_POST}|{_POST})|,{_S}{_W}(?=[\s,.;:]))?|(?:{_W},?{_S}){{2,4}}(?P<bare>{_POST}))"
    rf"|(?:{_S}(?:bis|ter|quater)\b)?,?{_S}(?:{FR_STREET}){_S}(?:(?:de la|de|du|des|d'){_S}?)?{_W}(?P<fr>,{_S}\d{{5}}{_S}{_W}|{_S}à{_S}{_W})?)"
)
_BEFORE_NUMBER = re.compile(rf"(?:(?:Flat|Unit|Apt\.?){_S}\d+[a-z]?,{_S}|{_W}{_S}House,{_S})$")
_DE_END = re.compile(rf"(?:{DE_STREET}){_S}\d{{1,4}}(?:{_S}?[a-z]\b)?(?P<tail>,{_S}\d{{5}}{_S}{_W}|{_S}in{_S}\d{{5}}{_S}{_W})?")
_DE_START = re.compile(rf"{_W}$")
_WORD_FIRST = re.compile(
    rf"[ACIPRTZ](?:(?:m|n der|uf der|u[mr]){_S}{_W}{_S}\d{{1,4}}(?:{_S}?[a-z]\b)?(?P<de>,{_S}\d{{5}}{_S}{_W}|{_S}in{_S}\d{{5}}{_S}{_W})?"
    rf"|(?:(?:alle|vda\.|venida|laza|aseo|amino|onda|ravesía){_S}|/{_S}?)(?:de{_S}(?:la{_S})?)?{_W},?{_S}(?:n\.?º{_S}?)?\d{{1,4}}(?P<es>(?:,{_S}\d{{1,2}}º(?:{_S}[A-Z]\b)?)?(?:,{_S}\d{{5}}{_S}{_W}|,{_S}{_W})?))"
)
# Starts at the year; the bracket before it is looked for afterwards.
_REPORT = re.compile(r"[12][890]\d\d(?:[\])]\s+\d+\s+[A-Z][\w ]{0,12}?\s+\d+|\s+[A-Z]{2,}\s+\d+)")
_PARTY_WORD = re.compile(rf"[{_UP}]\.(?:[{_UP}]\.)*|{_W}")
_VERSUS = ("v", "v.", "c.", "./.")
_FIRM_END = re.compile(rf"\s(?:&{_S}(?:Daughters|Sons|Fils|Söhne|Co\.|Cía\.)(?:{_S}(?:Ltd|LLP|KG|plc)\b)?|y{_S}Cía\.?|(?:Ltd|LLP|plc|Inc|Holdings|Haulage|GmbH|AG|KG|eG|SARL|SAS|SA|Transports|Hermanos|Bau|S\.{_S}?A\.|S\.{_S}?L\.|S\.{_S}Coop\.)(?!\w)(?:{_S}(?:Ltd|LLP|plc|GmbH|AG|SARL|SAS|SA|S\.{_S}?L\.|S\.{_S}?A\.)(?!\w))?)")
_FIRM_WORD = re.compile(_W)

_ALIKE = {ord(p[0]): p[1] for p in f"{CYRILLIC} {GREEK}".split(" ")}
_FOREIGN = re.compile("[\u0370-\u052f]")


def level(text: str) -> str:
    """Look-alike letters as Latin ones; every character keeps its place."""
    return text.translate(_ALIKE) if _FOREIGN.search(text) else text


@lru_cache(maxsize=1 << 18)
def _norm(word: str) -> str:
    return unicodedata.normalize("NFKC", word).replace("\xad", "").lower()


def word_before(text: str, at: int) -> tuple[int, int]:
    """Place of the blank-separated word that ends last before ``at``; (0, 0) if there is none."""
    while at and text[at - 1].isspace():
        at -= 1
    s = text.rfind(" ", 0, at) + 1
    return at - len(text[s:at].split()[-1]) if at else 0, at


@lru_cache(maxsize=1 << 16)
def _last_two(raw: str) -> tuple[str, str] | None:
    got = _WORDS.findall(raw)[-2:]
    return None if len(got) < 2 else ("9" if got[0][0].isdigit() else _norm(got[0]), "9" if got[1][0].isdigit() else _norm(got[1]))


def _left(text: str, at: int) -> tuple[str, str]:
    """The two words or marks before a place."""
    q = text.rfind(" ", max(0, at - 60), max(0, text.rfind(" ", max(0, at - 40), max(0, at - 1))))
    if q >= 0 and (got := _last_two(text[q:at])):
        return got
    width = 64
    while True:  # long or missing words: wider until two words are whole
        lo = max(0, at - width)
        got = _WORDS.findall(text[lo:at])
        if len(got) > 2 or not lo:
            got = ["9" if w[0].isdigit() else _norm(w) for w in got[-2:]]
            return ("", *got)[-2:] if got else ("", "")
        width *= 2


@lru_cache(maxsize=1 << 16)
def _first_one(raw: str) -> str:
    m = _WORDS.search(raw)
    return "" if m is None else "9" if m[0][0].isdigit() else _norm(m[0])


def _right(text: str, at: int) -> str:
    """The word or mark after a place."""
    e = text.find(" ", at + 1, at + 40)
    if e >= 0 and (got := _first_one(text[at:e])):
        return got
    m = _WORDS.search(text, at)
    return "" if m is None else "9" if m[0][0].isdigit() else _norm(m[0])


# Words near a phone number and near an identity number.
PHONE_WORDS = "phone telephone tel tél mobile fax call called caller rang ring reach dial anruf anrufe rief telefon telefax mobil handy durchwahl appel appelé appela téléphone joindre portable llamada llamó llamar teléfono móvil registry greffe geschäftsstelle secretaría kanzlei"
ID_WORDS = "passport identity national ssn security licence license id passeport identité ausweis reisepass personalausweis personalnummer pasaporte documento dni nie identidad permiso sécurité sozialversicherung steuer nif tax"
_NEAR = {w: "phone" for w in PHONE_WORDS.split()} | {w: "id" for w in ID_WORDS.split()}


_SHORT = re.compile(r"[^\W\d_]{2,4}\.|[^\W\d_]\.")


@lru_cache(maxsize=1 << 16)
def _hint(raw: str) -> str:
    """Class of the last word about numbers among the last eight of the sentence a piece of text ends in."""
    words = re.split(r"\n\s*\n", raw)[-1].split()[-8:]
    for k in range(len(words) - 1, -1, -1):
        word = words[k]
        for w in _WORDS.findall(word):
            if got := _NEAR.get(_norm(w)):
                return got
        if word[-1] in ".;" and (k + 1 < len(words) and words[k + 1][0].isupper()) and not (_SHORT.fullmatch(word) and not (k and words[k - 1][0].isdigit())):
            return ""  # the sentence before
    return ""


def hint(text: str, a: int, b: int) -> str:
    """Class of the nearest word about numbers among the seven before or the one after."""
    s = a
    for _ in range(8):
        s = text.rfind(" ", 0, s)
        if s < 0:
            break
    near = _hint(text[s + 1 : a])
    if not near and text[b + 1 : b + 2] == "·":
        near = _NEAR.get(_first_one(text[b + 3 : word_end(text, b + 3)]), "")
    return near


def word_end(text: str, at: int) -> int:
    """End of the word that starts at a place."""
    m = _WORDS.match(text, at)
    return m.end() if m else at


_SAME = {ord(c): "9" for c in "012345678"} | {ord(c): "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}


@lru_cache(maxsize=1 << 14)
def _layout(s: str) -> str:
    return re.sub(r"\d+", lambda m: f"{len(m[0])}#", re.sub(r"\s+", " ", s))


def mask(s: str) -> str:
    """Layout of a number: lengths of digit runs, letters and marks."""
    return _layout(s.translate(_SAME))


# ---- features ----

# Given names, and capitalised words of calendar and map, in four languages.
GIVEN = "Anna Maria José Juan Carlos Luis Carmen Ana Antonio Manuel Elena Lucía Pablo Pedro Miguel Laura Marta Peter Hans Klaus Karl Heinz Petra Monika Sabine Ursula Wolfgang Jürgen Stefan Thomas Michael Andreas Julia Katharina Jean Pierre Marie Michel Philippe Isabelle Nathalie Catherine François Jacques Claire Sophie Camille Louis John James Robert William David Richard Mary Patricia Jennifer Linda Elizabeth Susan Sarah Emma Oliver George Harry Alice Margaret Charles"
NO_NAME = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember London Paris Berlin Madrid Chicago Vienna Munich Hamburg Barcelona Lyon Dublin Rome Europe England France Germany Spain Deutschland Österreich España Francia Allemagne Espagne European English French German Spanish Internet Passport Court State Parliament Ministry"
_CLASS = {_norm(w): "given" for w in GIVEN.split()} | {_norm(w): "other" for w in NO_NAME.split()}


def word_features(word: str) -> list[str]:
    """Features of one word of a name."""
    w = _norm(word)
    out = [f"N:w={w}", f"N:e={w[-4:]}", f"N:e3={w[-3:]}", f"N:b={w[:4]}"]
    if "-" in w:
        out += [f"N:w={x}" for x in w.split("-")]
    if re.fullmatch(r"(?:[bdfgklmnprst][aeiou]){2,5}", w):
        out.append("N:cv")
    if w in _CLASS:
        out.append(f"N:c={_CLASS[w]}")
    return out


def shape_of(tokens: list[str]) -> str:
    return "".join("P" if t.islower() else "I" if t.endswith(".") else "U" if len(t) > 1 and t.isupper() else "C" for t in tokens)


def span_features(low: list[str], shape: str, i: int, j: int, before: tuple[str, str], after: str) -> list[str]:
    """Whole-span features of tokens i..j as a name; ``low`` and ``shape`` are those of the run."""
    own = shape[i:j]
    l1 = low[i - 1] if i else before[1]
    l2 = low[i - 2] if i > 1 else before[1] if i == 1 else before[0]
    r1 = low[j] if j < len(low) else after
    out = ["N", f"N:s={own}", f"N:l={l1}", f"N:ll={l2} {l1}", f"N:r={r1}", f"N:s={own},l={l1}", f"N:l={l1},r={r1}"]
    if i and shape[i - 1] != "P":
        out.append("N:capbefore")
    if j < len(low):
        out.append("N:capafter")
    return out


def name_features(tokens: list[str], i: int, j: int, before: tuple[str, str], after: str) -> list[str]:
    shape = shape_of(tokens)
    out = span_features([_norm(t) for t in tokens], shape, i, j, before, after)
    for t, c in zip(tokens[i:j], shape[i:j]):
        if c in "CU":
            out += word_features(t)
    return out


def item_key(text: str, item: tuple[int, int, str, str]) -> tuple[str, str, str, str, str, str]:
    """What decides about a proposed item: kind, shape, words before and after, and for numbers the words about them."""
    a, b, kind, shape = item
    return kind, shape, *_left(text, a), _right(text, b), hint(text, a, b) if kind in ("phone", "id_number") else ""


def item_features(kind: str, shape: str, l2: str, l1: str, r: str, near: str) -> list[str]:
    """Whole-span features of a proposed item."""
    out = [kind, f"{kind}:l={l1}", f"{kind}:ll={l2} {l1}", f"{kind}:r={r}"]
    if kind in ("phone", "id_number"):
        out += [f"{kind}:m={shape}", f"{kind}:n={sum(map(int, re.findall('[0-9]+', shape)))}", f"{kind}:m={shape},l={l1}", f"{kind}:h={near}"]
    else:
        out += [f"{kind}:x={x}" for x in shape.split()]
    return out


# ---- candidates ----


def places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def _emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    marks = sorted((a, mark) for mark in _AT for a in places(text, mark))
    last = 0
    for a, mark in marks:
        b = a + len(mark)
        lo, last = last, b
        a -= a > lo and text[a - 1].isspace()
        b += b < len(text) and text[b].isspace()
        local, host = _LOCAL.search(text, max(lo, word_before(text, a)[0]), a), _HOST.match(text, b)
        if not local:
            continue
        form = "form=" + (mark if len(mark) == 1 else "at")
        if host is None:
            if m := _LABEL.match(text, b):
                yield local.start(), m.end(), "email", f"{form} nodot"
            continue
        if host[0][0].isdigit():
            form += " digit"
        yield local.start(), host.end(), "email", form
        if (k := max(map(local[0].rfind, ".+-%"))) > 0 and k + 1 < len(local[0]):
            yield local.start() + k + 1, host.end(), "email", f"{form} lcut"
        if m := _HOST_PART.match(text, b, host.end()):
            yield local.start(), m.end(), "email", f"{form} rcut"


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _BLOB.finditer(text):
        own = m[0]
        if len(own) < 6 or _DATE.match(own):
            continue
        n = sum(map(str.isdigit, own))
        if n < 6:
            continue
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "@#€$£_ \xa0-\n"):
            head = _BLOB_HEAD.search(text, max(0, a - 6), a)
            if head and _norm(head[0].strip(" -\xa0\r\n")) in _NEAR:  # the word that names the number
                pass
            elif head:
                a -= len(head[0])
            elif text[a - 1] not in " \xa0-\n":
                continue
        if n < 8 and text[a].isdigit() and own.isdigit():
            continue
        if n <= 16 and not text[a].isalpha():
            e = b - (1 if own[-1].isalpha() else 0)
            s = text[a:e].rstrip(" (./-\xa0")
            yield a, a + len(s), "phone", mask(s)
            if s.count("(") < s.count(")") and s[0].isdigit() and a and text[a - 1] == "(":
                yield a - 1, a + len(s), "phone", mask("(" + s)
        if "(" not in own and "+" not in own:
            yield a, b, "id_number", mask(text[a:b])
            if own[-1].isalpha() and own[-2] in " -\xa0" and text[b : b + 1].islower():
                yield a, b - 2, "id_number", mask(text[a : b - 2])


def _addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    for n in _NUMBER_WORD.finditer(text):
        a = n.start()
        while a and text[a - 1] in "0123456789" and n.start() - a < 4:
            a -= 1
        if n.start() - a > 3 or a and ((c := text[a - 1]).isalnum() or c in "_.,/-"):
            continue
        m = _NUMBER_FIRST.match(text, a)
        if not m:
            continue
        b = m.end()
        form = "form=bare" if m["bare"] else "form=fr" if m["fr"] or _FR_WORD.search(m[0]) else "form=en"
        tail = m["en"] or m["fr"] or ""
        form += " tail" if tail else ""
        lo = a
        for _ in range(2):
            lo = word_before(text, lo)[0]
        before = _BEFORE_NUMBER.search(text, max(0, lo), a)
        if before:
            yield before.start(), b, "address", f"{form} front"
            form += " lcut"
        yield a, b, "address", form
        if tail and not before:
            yield a, b - len(tail), "address", f"{form} rcut"
    for m in _DE_END.finditer(text):
        at = m.start() + 1
        if w := _DE_START.search(text, word_before(text, at)[0], at):
            tail = m["tail"] or ""
            yield w.start(), m.end(), "address", "form=de" + (" tail" if tail else "")
            if tail:
                yield w.start(), m.end() - len(tail), "address", "form=de tail rcut"
    for m in _WORD_FIRST.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        tail, form = m["de"] or m["es"] or "", "form=es" if m["es"] is not None else "form=dw"
        yield m.start(), m.end(), "address", form + (" tail" if tail else "")
        if tail:
            yield m.start(), m.end() - len(tail), "address", f"{form} tail rcut"


def _party(text: str, end: int) -> int:
    """Where the party begins that ends before ``end``: capitalised words, initials, particles, & and y, as far as they go."""
    best = at = end
    while True:
        s, e = word_before(text, at)
        word = text[s:e]
        if not word:
            break
        if word[0] in "(«“\"'" and len(word) > 1:
            s, word = s + 1, word[1:]
        if word != "Re" and (m := _PARTY_WORD.match(word)) and (m.end() == len(word) or best == end and word[m.end() :] == "."):
            best = s
            if s and not text[s - 1].isspace():
                return best
        elif best == end or not (word in ("&", "y") or word in _PART_WORDS):
            break
        at = s
    return _lead(text, best) if best < end else end


def _lead(text: str, a: int) -> int:
    """Start of the particles before a capitalised word, if there are any."""
    if a > 2 and text[a - 1].isspace() and text[a - 3 : a - 1] in _PART_TAILS and (m := _LEAD.search(text, max(0, a - 60), a)):
        return m.start()
    return a


def _citations(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _REPORT.finditer(text):
        first = at = m.start()
        if text[first + 4] in ")]":
            if not first or text[first - 1] not in "[(":
                continue
            first = at = first - 1
        elif first and text[first - 1].isalnum():
            continue
        while at and text[at - 1].isspace():
            at -= 1
        if at and text[at - 1] == ",":
            at -= 1
        elif first == m.start():
            continue
        yield first, m.end(), "citation", "report"
        right = _party(text, at)
        if right == at:
            continue
        s, e = word_before(text, right)
        versus = text[s:e]
        if versus in _VERSUS:
            left = _party(text, s)
            yield (left if left < s else s), m.end(), "citation", "versus"
            if left < s and (inner := _PARTY_WORD.match(text, left)) and inner.end() < s and text[inner.end()].isspace() and (w := text[inner.end() :  s].strip()) and w[0].isupper():
                yield s - len(text[inner.end() : s].lstrip()), m.end(), "citation", "versus lcut"
        elif versus == "Re":
            yield s, m.end(), "citation", "re"


def _firms(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _FIRM_END.finditer(text):
        e = m.start()
        while e and text[e - 1].isspace():
            e -= 1
        starts, at = [], e
        while len(starts) < 4:  # the pattern of a firm's name: up to four words, & between them
            s, w_end = word_before(text, at)
            word = text[s:w_end]
            if word == "&" and starts:
                at = s
                continue
            k = _FIRM_WORD.search(word)
            if not k or k.end() != len(word):
                break
            starts.append(s + k.start())
            at = s
            if k.start():
                break
        form = "end=" + re.sub(r"\s+", "_", m[0].strip())
        for k, a in enumerate(starts):
            yield a, m.end(), "company", f"{form} n={k + 1}" + (" lcut" if k + 1 < len(starts) else "")


def proposals(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, shape) of what the patterns propose, sorted; proposals overlap."""
    return sorted([*_emails(text), *_numbers(text), *_addresses(text), *_citations(text), *_firms(text)])


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Feature weights."""
    return json.loads(WEIGHTS.read_text()) if WEIGHTS.exists() else {}


def best_set(spans: list[tuple[int, int, float, object]]) -> list[object]:
    """What the best set of disjoint spans (start, end, score, what) holds, in order; a gap scores 0."""
    spans = sorted((s for s in spans if s[2] > 0), key=lambda s: s[1])
    ends, best, back = [], [0.0], []
    for s in spans:
        k = bisect_right(ends, s[0])
        take = best[k] + s[2]
        back.append(k if take > best[-1] else -1)
        best.append(max(take, best[-1]))
        ends.append(s[1])
    out, k = [], len(spans)
    while k:
        if back[k - 1] >= 0:
            out.append(spans[k - 1][3])
            k = back[k - 1]
        else:
            k -= 1
    return out[::-1]


def best_names(spans: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    """``best_set`` for segments of a run of n words, given by start and end, that all score over 0."""
    best, back, at = [0.0] * (n + 1), [-1] * (n + 1), 0
    for i, j, s in [*spans, (n, n, 0.0)]:
        while at < i:
            at += 1
            if best[at] <= best[at - 1]:
                best[at], back[at] = best[at - 1], -1
        s += best[i]
        if s > best[j]:
            best[j], back[j] = s, i
    out = []
    while n:
        if back[n] >= 0:
            out.append((back[n], n))
            n = back[n]
        else:
            n -= 1
    return out[::-1]


def name_spans(tokens: list[str]) -> list[tuple[int, int]]:
    """Segments of a run that may be a name: they end in a capitalised word, and no word of them holds a digit."""
    n = len(tokens)
    part = [t.islower() for t in tokens]
    good = [not p and not t.endswith(".") for p, t in zip(part, tokens)]
    bad = [g and not t.isalpha() and any(map(str.isdigit, t)) for g, t in zip(good, tokens)]
    out = []
    for i in range(n):
        words = 0
        for j in range(i + 1, n + 1):
            words += not part[j - 1]
            if bad[j - 1] or words > MAX_WORDS:
                break
            if good[j - 1]:
                out.append((i, j))
    return out


def begin(text: str, a: int, b: int) -> int:
    """Where a run matched at a..b begins: its particles count, the rest of a word begun before it does not; -1 if nothing is left."""
    c = text[a - 1] if a else " "
    if c.isspace():
        return _lead(text, a)
    if c.isalnum() or c in "_@\xad":
        t = _TOKEN.search(text, a, b)  # a capital inside a word; the run goes on after it
        nxt = t and _TOKEN.search(text, t.end(), b)
        return nxt.start() if nxt else -1
    return a


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Places of runs of capitalised words, with the particles before them."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        a = begin(text, a, b)
        if a >= 0:
            yield a, b


def grouped(found: list[tuple]) -> list[list]:
    """Items in groups that overlap: [start, end, items, []]."""
    out: list[list] = []
    for p in found:
        if out and p[0] < out[-1][1]:
            out[-1][1] = max(out[-1][1], p[1])
            out[-1][2].append(p)
        else:
            out.append([p[0], p[1], [p], []])
    return out


def stretches(text: str, found: list[tuple]) -> Iterator[tuple[list[tuple[int, int]], list[tuple]]]:
    """Connected stretches of overlapping candidates: (runs, proposals)."""
    every = sorted([(a, b, None) for a, b in runs(text)] + [(p[0], p[1], p) for p in found], key=lambda x: x[:2])
    for _, _, own, _ in grouped(every):
        yield [x[:2] for x in own if x[2] is None], [x[2] for x in own if x[2] is not None]


def words_of(run: str) -> list[str]:
    """The words of a run, as _TOKEN finds them."""
    if run.isalpha():
        return [run]
    return run.split(" ") if run.replace(" ", "").isalpha() and "  " not in run else _TOKEN.findall(run)


def cuts_of(run: str, words: list[str], at: int = 0) -> list[tuple[int, int]]:
    """Places of the words of a run that begins at ``at``."""
    out, e = [], 0
    for w in words:
        s = run.index(w, e)
        e = s + len(w)
        out.append((at + s, at + e))
    return out


_START = itemgetter(1)
_NOTHING = [""]
_UNKNOWN = (math.inf, math.inf)
#: Words that may lead a name; the articles do so only after another particle.
_LEAD_ARTICLES = {"der", "den", "dem"}
_LEADS = _PART_WORDS - _LEAD_ARTICLES
#: Marks the bounds of runs of several words.
MULTI = 1e6


class Kept(dict):
    """A bounded memo of a function of short texts; None means infinity and is not kept."""

    def __init__(self, f: Callable[[str], object]):
        super().__init__()
        self.f = f

    def __missing__(self, text: str) -> object:
        got = self.f(text)
        if got is None:
            return math.inf
        if len(self) >= MEMO:
            self.clear()
        if len(text) < 64:
            self[text] = got
        return got


class Decoder:
    def __init__(self, w: dict[str, float]):
        # In binary fractions, so that sums are exact and no order of adding decides.
        self.w = w = {f: round(v * 2**20) / 2**20 for f, v in w.items()}
        self.memo, self.tokens, self.item_scores, self.met = {}, {}, {}, set()
        self.bounds, self.befores, self.afters = Kept(self.bound), Kept(self.word_before), Kept(self.word_after)
        # The weights of names again, by what they look up.
        self.bias, self.cap_before, self.cap_after = (w.get(f, 0.0) for f in ("N", "N:capbefore", "N:capafter"))
        self.by_shape, self.left, self.right = {}, {}, {}
        self.left2, self.shape_left, self.left_right = defaultdict(dict), defaultdict(dict), defaultdict(dict)
        for f, v in w.items():
            kind, _, x = f.partition("=")
            if kind == "N:s":
                own, comma, l1 = x.partition(",l=")
                if comma:
                    self.shape_left[l1][own] = v
                else:
                    self.by_shape[own] = v
            elif kind == "N:l":
                l1, comma, r1 = x.partition(",r=") if x != ",r=" and not x.startswith(",,r=") else (",", ",r=" if x.startswith(",,r=") else "", x[4:])
                if comma:
                    self.left_right[l1][r1] = v
                else:
                    self.left[l1] = v
            elif kind == "N:ll":
                l2, l1 = x.split(" ", 1)
                self.left2[l1][l2] = v
            elif kind == "N:r":
                self.right[x] = v
        # The most a name can gain from the word l1 before it, whatever stands farther left and to its right.
        most = lambda of: {l1: max(0.0, *x.values()) for l1, x in of.items()}
        self.most2, self.most_right, most_shape = most(self.left2), most(self.left_right), most(self.shape_left)
        every = {*self.left, *self.most2, *self.most_right, *most_shape}
        self.most_any = {l1: self.left.get(l1, 0.0) + self.most2.get(l1, 0.0) + self.most_right.get(l1, 0.0) + most_shape.get(l1, 0.0) for l1 in every}
        self.most_plain = {l1: v - most_shape.get(l1, 0.0) + self.shape_left.get(l1, {}).get("C", 0.0) for l1, v in self.most_any.items()}

    def token(self, word: str) -> tuple:
        """What names look up about a word of a run.

        Normal form, shape, score, whether it may stand in a name; then what a name
        gains beside it: the start after it, the same by the word before, by the
        name's shape and by the word after the name, the end before it.
        """
        shape, w = shape_of([word]), _norm(word)
        score = sum(self.w.get(f, 0.0) for f in word_features(word)) if shape in "CU" else 0.0
        start = self.bias + self.left.get(w, 0.0) + (self.cap_before if shape != "P" else 0.0)
        got = w, shape, score, shape in "PI" or word.isalpha() or not any(map(str.isdigit, word)), start, self.left2.get(w), self.shape_left.get(w), self.left_right.get(w), self.right.get(w, 0.0) + self.cap_after
        if len(self.tokens) >= MEMO:
            self.tokens.clear()
        if len(word) < MEMO_CHARS:
            self.tokens[word] = got
        return got

    def names(self, words: list[str], before: tuple[str, str], after: str, least: float = 0.0) -> list[tuple[int, int, float]]:
        """(i, j, score) of the segments of a run that score over ``least``; scores are those of ``name_features``."""
        tokens, by_shape = self.tokens, self.by_shape
        own = [tokens.get(t) or self.token(t) for t in words]
        n, out = len(own), []
        l2, l1 = before
        first, seconds, shapes, rights = self.bias + self.left.get(l1, 0.0), self.left2.get(l1), self.shape_left.get(l1), self.left_right.get(l1)
        last = self.right.get(after, 0.0)
        if 0 < n < 3 and own[0][1] == "C" == own[-1][1] and own[0][3] and own[-1][3]:  # the usual run, written out
            one = by_shape.get("C", 0.0)
            if seconds:
                first += seconds.get(l2, 0.0)
            a, b = own[0], own[-1]
            first += a[2]
            plain = shapes.get("C", 0.0) + one if shapes else one
            if n == 1:
                total = first + plain + last
                if rights:
                    total += rights.get(after, 0.0)
                return [(0, 1, total)] if total > least else out
            total = first + plain + b[8]
            both = first + b[2] + by_shape.get("CC", 0.0) + last
            if rights:
                total += rights.get(b[0], 0.0)
                both += rights.get(after, 0.0)
            if shapes:
                both += shapes.get("CC", 0.0)
            if total > least:
                out.append((0, 1, total))
            if both > least:
                out.append((0, 2, both))
            _, _, _, _, total, seconds, shapes, rights, _ = a
            total += b[2] + one + last
            if seconds:
                total += seconds.get(l1, 0.0)
            if shapes:
                total += shapes.get("C", 0.0)
            if rights:
                total += rights.get(after, 0.0)
            if total > least:
                out.append((1, 2, total))
            return out
        for i in range(n):
            start = first + seconds.get(l2, 0.0) if seconds else first
            shape, count = "", 0
            for j in range(i, n):
                _, c, score, fit_, _, _, _, _, _ = own[j]
                if not fit_:
                    break
                shape += c
                if c == "P":
                    continue
                count += 1
                if count > MAX_WORDS:
                    break
                if c == "I":
                    continue
                start += score
                if j + 1 < n:
                    word = own[j + 1]
                    total = start + by_shape.get(shape, 0.0) + word[8]
                    if rights:
                        total += rights.get(word[0], 0.0)
                else:
                    total = start + by_shape.get(shape, 0.0) + last
                    if rights:
                        total += rights.get(after, 0.0)
                if shapes:
                    total += shapes.get(shape, 0.0)
                if total > least:
                    out.append((i, j + 1, total))
            l2 = l1
            l1, _, _, _, first, seconds, shapes, rights, _ = own[i]
        return out

    def bound(self, run: str) -> float | None:
        """The most a segment of a run scores, what stands around the run aside; MULTI more where the run is no plain word."""
        if not run.isalpha():
            if len(self.met) >= MEMO:
                self.met.clear()
            if run not in self.met:  # worth its work where a run comes again
                self.met.add(run)
                return None
        words = words_of(run)
        own = [self.tokens.get(t) or self.token(t) for t in words]
        if len(own) == 1 and own[0][1] == "C":
            return own[0][2] + self.bias + self.by_shape.get("C", 0.0) if own[0][3] else -math.inf
        most2, most_right, n = self.most2, self.most_right, len(words)
        # The word before the run may add to a name from the second word on, the word after it to a name at the end.
        beside = lambda i, j: (most2.get(own[0][0], 0.0) if i == 1 else 0.0) + (most_right.get(own[i - 1][0], 0.0) if i and j == n else 0.0)
        return MULTI + max((s + beside(i, j) for i, j, s in self.names(words, ("\0", "\0"), "\0", -math.inf)), default=-math.inf)

    def word_before(self, word: str) -> tuple[float, float]:
        """The most a plain word and any run can gain from the last blank-separated word before it."""
        last = _WORDS.findall(word)[-1] if word else ""
        if not last or last in _LEADS:  # a particle may belong to the name
            return _UNKNOWN
        l1 = _first_one(last)
        return self.most_plain.get(l1, 0.0), max(0.0, self.most_any.get(l1, 0.0))

    def word_after(self, word: str) -> float:
        """What a name gains from the blank-separated word, or what is left of it, after it."""
        return self.right.get(_first_one(word), 0.0) if word else math.inf

    def items(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, score, kind) of proposals that score over 0; others are in no best set."""
        out, scores = [], self.item_scores
        at = end = -1
        for a, b, kind, shape in proposals(text):
            number = kind in ("phone", "id_number")
            if a != at or number and near is None:
                at, left, near = a, _left(text, a), hint(text, a, b) if number else None
            if b != end:
                end, right = b, _right(text, b)
            key = (kind, shape, *left, right, near if number else "")
            got = scores.get(key)
            if got is None:
                got = sum(self.w.get(f, 0.0) for f in item_features(*key))
                if len(scores) >= MEMO:
                    scores.clear()
                scores[key] = got
            if got > 0:
                out.append((a, b, got, kind))
        return out

    def run_alone(self, own: str, before: tuple[str, str], after: str) -> tuple[tuple[int, int], ...]:
        """Names of a run nothing else overlaps, as places in it."""
        key = (own, before, after)
        got = self.memo.get(key)
        if got is None:
            words = words_of(own)
            spans = self.names(words, before, after)
            if len(spans) > 1:
                spans = best_names(spans, len(words))
            if spans:
                cut = cuts_of(own, words)
                got = tuple([(cut[x[0]][0], cut[x[1] - 1][1]) for x in spans])
            else:
                got = ()
            if len(own) < MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[key] = got
        return got

    def find(self, raw: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every item of a text, in order."""
        if not raw:
            return []
        text = level(raw)
        parts = _RUN.split(text)  # gap, run, gap, run, ..., gap
        runs_, gaps = parts[1::2], parts[::2]
        n = len(runs_)
        ends = list(accumulate(map(len, parts)))  # of gaps at 0, 2, ..., of runs at 1, 3, ...
        starts, ends = ends[0:-1:2], ends[1::2]
        # Most runs score under 0 whatever stands farther away from them.
        bounds, before, after = self.bounds, self.befores, self.afters
        left = [(_UNKNOWN if (w := (g.rsplit(None, 1) or _NOTHING)[-1]) in _LEAD_ARTICLES and g.rsplit(None, 2)[-2:-1] and g.rsplit(None, 2)[-2].endswith(("von", "van")) else before[w]) if (c := g[-1:]) == " " or c == "\n" else _UNKNOWN if not c or c.isspace() or c.isalnum() or c in "_@\xad" else before[g.rsplit(None, 1)[-1]] for g in gaps[:-1]]
        right = [after[w[0]] if len(w := g.split(None, 1)) > 1 or w and not ((c := g[-1]).isalnum() or c in "_\xad") else math.inf for g in gaps[1:]]
        open_ = [s + x[0] + y > 0 if s < MULTI / 2 else s - MULTI + x[1] + (y if y > 0 else 0.0) > 0 for s, x, y in zip(map(bounds.__getitem__, runs_), left, right)]
        out: list[tuple[str, int, int]] = []
        groups = grouped(self.items(text))
        at = 0
        while at < len(groups):  # a run and the items it meets are one stretch
            group = groups[at]
            lo = hi = bisect_right(ends, group[0])
            while hi < n and starts[hi] < group[1]:
                group[1] = max(group[1], ends[hi])
                hi += 1
                while at + 1 < len(groups) and groups[at + 1][0] < group[1]:
                    more = groups.pop(at + 1)
                    group[1] = max(group[1], more[1])
                    group[2].extend(more[2])
            items = group[2]
            spans = [(a, b, s, (k, a, b)) for a, b, s, k in items]
            for k in range(lo, hi):
                if open_[k]:
                    b = ends[k]
                    a = begin(text, starts[k], b)
                    if a < 0:
                        continue
                    words = words_of(own := runs_[k] if a == starts[k] else text[a:b])
                    if named := self.names(words, _left(text, a), _right(text, b)):
                        cut = cuts_of(own, words, a)
                        spans += [(x := cut[i][0], y := cut[j - 1][1], s, ("name", x, y)) for i, j, s in named]
            out += [x for x in (best_set(spans) if len(spans) > 1 else [spans[0][3]]) if x[0] in KINDS]
            open_[lo:hi] = [False] * (hi - lo)
            at += 1
        for k in compress(range(n), open_):
            a, b, run = starts[k], ends[k], runs_[k]
            lead = a if left[k] is not _UNKNOWN and text[a - 1] == " " else begin(text, a, b)
            if lead < 0:
                continue
            if lead != a:
                run = text[lead:b]
            gap, word = gaps[k], gaps[k + 1][:24].split(None, 1)
            near = (lead == a and len(gap) < 48 and _last_two(gap)) or _left(text, lead)
            after = _first_one(word[0]) if len(word) > 1 else _right(text, b)
            if run.isalpha():  # one word
                if self.names([run], near, after):
                    out.append(("name", lead, b))
                continue
            for x, y in self.run_alone(run, near, after):
                out.append(("name", lead + x, lead + y))
        out.sort(key=_START)
        return out


@lru_cache(maxsize=1)
def shared_decoder() -> Decoder:
    """A worker's decoder, kept from task to task."""
    return Decoder(weights())


# ---- fitting ----

# Forms of address, and words of the parties' line, before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Judge Justice Witness Herr Frau Richter Richterin Zeuge Zeugin Monsieur Madame M. Mme Mlle Me Maître Don Doña don doña D. Dña. Sr. Sra. BETWEEN ENTRE Rechtsstreit Counsel président conseillère conseiller"
STRONG = re.compile(rf"(?:(?<![\w.])(?:{'|'.join(map(re.escape, TITLES.split()))}|Richter(?:in)? am {_W}|le président|la (?:présidente|conseillère)){_S})((?:(?:{_TOK}|{_PART}){_S}){{0,4}}{_W})")


def lexicon(texts: Iterable[str], rounds: int = 3) -> set[str]:
    """Words that stand as names: after a form of address, or mostly beside such words.

    Words also seen without a capital, forms of address and courts are left out.
    """
    strong, lower, found, led = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        for m in STRONG.finditer(text):
            strong.update(_norm(t) for t in _TOKEN.findall(m[1]) if len(t) > 2 and not t.islower())
        lower.update(re.findall(r"(?<![\w’'@.+-])[a-zà-ÿ]{3,}(?![\w’'@+-]|\.\w)", text))
        led.update(_norm(w) for w in _LED.findall(text))
        for a, b in runs(text):
            run = tuple(_norm(t) for t in _TOKEN.findall(text, a, b) if not t.islower())
            found[run] += 1
    total = Counter()
    for run, n in found.items():
        for w in run:
            total[w] += n
    barred = lambda w: max(lower[w], led[w]) > 0.2 * total[w] or w in _TITLE_WORDS or w in _NOT_NAMES or len(w) < 3 or not w[0].isalpha() or any(c.isdigit() for c in w)
    words = {w for w, n in strong.items() if n >= 2 and n >= 0.15 * total[w] and not barred(w)}
    for _ in range(rounds):
        beside = Counter()
        for run, n in found.items():
            for k, w in enumerate(run):
                near = run[max(0, k - 2) : k] + run[k + 1 : k + 3]
                if any(x in words for x in near) or (k and run[k - 1] in _TITLE_WORDS):
                    beside[w] += n
        words |= {w for w, n in beside.items() if n >= 3 and n >= 0.5 * total[w] and not barred(w)}
    return words


_TITLE_WORDS = {_norm(t).rstrip(".") for t in TITLES.split()} | {"excmo", "ilma", "sr", "sra", "dña", "deputy", "vorsitzender", "vorsitzende"}
_COURTS = {"landgericht", "amtsgericht", "tribunal", "audiencia", "juzgado", "cour", "appel", "chambre", "sociale", "sala", "segunda", "bench", "gericht"}
_ARTICLES = {"der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "vom", "zum", "zur", "im", "am", "the", "a", "an", "le", "la", "les", "l", "du", "un", "une", "el", "los", "las", "del", "al", "una"}
_LED = re.compile(rf"\b(?:{'|'.join(_ARTICLES)})\s+({_W})")
_NOT_NAMES = {"landgericht", "amtsgericht", "gericht", "court", "tribunal", "audiencia", "juzgado", "sala", "chambre", "cour", "bench", "abs", "mill", "cross", "quay", "terrace"}


def chosen(items: list[tuple[int, int, str, str]], text: str) -> set[tuple[int, int, str]]:
    """Labels of proposals: the whole variant, numbers only where a word near them says what they are."""
    out = set()
    for p in sorted(items, key=lambda p: (p[0] - p[1], p[0])):
        a, b, kind, shape = p
        if kind in ("phone", "id_number"):
            yes = hint(text, a, b) == ("phone" if kind == "phone" else "id")
        else:
            yes = not re.search(r"\b(?:lcut|rcut|nodot|digit)\b", shape) and not (kind == "address" and _left(text, a)[1] in _NO_PLACE)
        if yes and not any(x < b and a < y for x, y, _ in out):
            out.add((a, b, kind))
    return out


def outside(text: str) -> str:
    """The text with labelled items blanked: a surname is often met in citations and firms, which say nothing of it."""
    parts, at = [], 0
    for a, b, _ in sorted(chosen(proposals(text), text)):
        parts += [text[at:a], "·" * (b - max(a, at))]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def gold_names(tokens: list[str], before: tuple[str, str], after: str, words: set[str]) -> list[tuple[int, int]]:
    """Segments of a run that are names by the lexicon and the forms of address."""
    gold, i, n = [], 0, len(tokens)
    low = [*before, *map(_norm, tokens)]
    court = [k for k in range(n) if low[k + 1] in _COURTS and low[k] != "am" or low[k + 1] in ("de", "of") and low[k] in _COURTS]
    inside = [t[0].isupper() and not t.endswith(".") and any(p in words or p[:3] == "mac" and p[3:] in words for p in (_norm(t), *_norm(t).split("-"))) and k not in court for k, t in enumerate(tokens)]
    while i < n:
        j = i
        while j < n and (inside[j] or tokens[j].islower() or (tokens[j].endswith(".") and len(tokens[j]) == 2)):
            j += 1
        while j > i and not inside[j - 1]:
            j -= 1
        s = i
        title = _norm(tokens[i - 1]) in _TITLE_WORDS if i else before[1] in _TITLE_WORDS or before[1] == "."
        while s < j and tokens[s].islower() and not title:
            s += 1
        if j > s and any(inside[s:j]) and not (j < n and tokens[j] in PLACES.split()) and after not in ("&",):
            # "D. Perrin Ibarguera": the first initial is the form of address where one stands first
            if tokens[s] in ("D.", "M.") and j - s > 1 and before[1] not in (",",):
                s += 1
            gold.append((s, j))
        i = max(j, i + 1)
    return gold


def lattices(text: str, words: set[str], names: list[tuple[int, int]] | None = None) -> Iterator[tuple[tuple, frozenset]]:
    """Lattices of a text with their labels: (spans (i, j, features) over ranks of positions, the (i, j, kind) that hold).

    Names are labelled by ``words`` outside the other labels, or are given.
    """
    for own, items in stretches(text, proposals(text)):
        good = chosen(items, text)
        spans = [(p[0], p[1], p[2], tuple(item_features(*item_key(text, p)))) for p in items]
        for a, b in own:
            cut = [t.span() for t in _TOKEN.finditer(text, a, b)]
            tokens, before, after = [text[x:y] for x, y in cut], _left(text, a), _right(text, b)
            spans += [(cut[i][0], cut[j - 1][1], "name", tuple(name_features(tokens, i, j, before, after))) for i, j in name_spans(tokens)]
            if names is not None:
                good |= {(x, y, "name") for x, y in names if a <= x and y <= b}
                continue
            part: list[tuple[int, int]] = []
            for x in [*cut, None]:  # labelled items split the run
                if x is not None and not any(s < x[1] and x[0] < e for s, e, _ in good if _ != "name"):
                    if not part or not any(part[-1][1] <= s < x[0] for s, *_ in good):
                        part.append(x)
                        continue
                if part:
                    good |= {(part[i][0], part[j - 1][1], "name") for i, j in gold_names([text[s:e] for s, e in part], _left(text, part[0][0]), _right(text, part[-1][1]), words)}
                part = [x] if x is not None and not any(s < x[1] and x[0] < e for s, e, _ in good) else []
        rank = {x: k for k, x in enumerate(sorted({y for s in spans for y in s[:2]}))}
        if spans:
            yield tuple((rank[a], rank[b], k, fs) for a, b, k, fs in spans), frozenset((rank[a], rank[b], k) for a, b, k in good if a in rank and b in rank)


# Words after which a number is no house number.
_NO_PLACE = {"§", "art", "nr", "no", "n", "núm", "article", "artículo", "abs", "section"}
# Sentences of no collection, with {n} for a full name, {s} for a surname, {c} for a word of calendar or map, {i}, {p} and {a} for an identity number, a phone number and an address.
PLAIN = """{n} lives in {c} and works for the city.|On {c} {n} went to {c}.|{n} called from {c} last {c}.|We met {n} in {c}.|The letter from {n} came on {c}.|{c} was cold that year.|Mrs {s} spoke to {n}.|Yesterday {n} said that {c} is near.|In {c} the office is closed on {c}.|The office in {c} is closed.|{n} and {n} signed it.|It was written by {n}, of {c}.|Please write to {n} before {c}.|They moved from {c} to {c} in {c}.|Passport no. {i} was lost.|The SSN {i} is on file.|Her passport {i} and phone {p} were noted.|Call {p} today.|The phone number is {p}.|Invoice {i} was paid.|Order no. {i} came late.|{n} lives at {a}.|The house at {a} was sold.
{n} wohnt in {c}.|Am {c} kam {n} nach {c}.|Frau {s} traf {n} in {c}.|Der Brief von {n} kam im {c}.|In {c} ist das Amt am {c} geschlossen.|Gestern sagte {n}, dass {c} nahe ist.|{n} und {n} haben unterschrieben.|Das Amt in {c} bleibt zu.|Der Reisepass {i} fehlt.|Telefon {p} ist besetzt.|Die Rechnung {i} ist bezahlt.
{n} habite à {c}.|Madame {s} a vu {n} à {c}.|La lettre de {n} est arrivée en {c}.|Hier {n} a dit que {c} est proche.|Le bureau de {c} est fermé.|{n} et {n} ont signé.|Le passeport {i} manque.|Le téléphone {p} sonne.|La facture {i} est payée.
{n} vive en {c}.|La señora {s} vio a {n} en {c}.|La carta de {n} llegó en {c}.|Ayer {n} dijo que {c} está cerca.|La oficina de {c} está cerrada.|{n} y {n} firmaron.|El pasaporte {i} falta.|El teléfono {p} suena.|La factura {i} está pagada."""
ID_FORMS, PHONE_FORMS = ("AA9999999", "999-99-9999", "A99999999", "99999999A", "C99A9AA99", "99 99 99 99 999"), ("+44 99 9999 9999", "(999) 999-9999", "999-999-9999", "099 99999999", "99 99 99 99 99", "999 999 999")
SURNAMES = "Smith Jones Taylor Brown Wilson Walker Wright Green Hall Clarke Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Martin Bernard Dubois Moreau Laurent Lefebvre Girard García Rodríguez González Gonzalez Fernández López Martínez Sánchez Pérez Gómez Villanueva Torres Romero".split()


def plain_sentences(n: int = 15_000, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sentences with the places of their names; given names and surnames are drawn from short public lists."""
    rng = random.Random(seed)
    forms = [f for line in PLAIN.split("\n") for f in line.split("|")]
    given, other = GIVEN.split(), NO_NAME.split()
    for _ in range(n):
        text, names = "The case is old. ", []
        digits = lambda form: "".join(str(rng.randint(0, 9)) if c == "9" else rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in form)
        for part in re.split(r"(\{[nscipa]\})", rng.choice(forms)):
            if part in ("{n}", "{s}"):
                s = rng.choice(SURNAMES)
                if part == "{n}":
                    s = f"{rng.choice(given)} {rng.choice(('', '', '', rng.choice(given) + ' ', rng.choice(given)[0] + '. ', 'de la ', 'von '))}{s}{rng.choice(('', '', '', ' y ' + rng.choice(SURNAMES), ' ' + rng.choice(SURNAMES)))}"
                names.append((len(text), len(text) + len(s)))
                text += s
            else:
                text += rng.choice(other) if part == "{c}" else digits(rng.choice(ID_FORMS)) if part == "{i}" else digits(rng.choice(PHONE_FORMS)) if part == "{p}" else digits(f"9{rng.choice(('', '9'))} {rng.choice(('Broadway', 'Cornmarket', 'Old Quay', 'The Green', 'Strand'))}, {rng.choice(('Ashby', 'Kirkton', 'Weston'))} AA9 9AA") if part == "{a}" else part
        yield text + " That is all.", names


def fit(texts: list[str], epochs: int = 8, rate: float = 0.6, decay: float = 1e-4) -> dict[str, float]:
    """Weights by maximum likelihood (AdaGrad) on a bounded sample of labelled texts.

    Features must occur in two lattices; weights under 0.02 are dropped.
    """
    texts = [level(t) for t in texts[:LEXICON_DOCUMENTS] if t]
    words = lexicon(outside(t) for t in texts)
    jobs: Counter = Counter()
    for t in texts[:FIT_DOCUMENTS]:
        jobs.update(lattices(t, words))
    for t, names in plain_sentences():
        jobs.update(lattices(t, words, names))
    seen: Counter = Counter()
    for (spans, _), n in jobs.items():
        for *_, fs in spans:
            for f in set(fs):
                seen[f] += n
    keep = {f for f, n in seen.items() if n >= 2}
    work = [([(i, j, [f for f in fs if f in keep]) for i, j, _, fs in spans], [(i, j, k) in gold for i, j, k, _ in spans], 1 + max(j for _, j, *_ in spans), min(n, 20)) for (spans, gold), n in jobs.items()]
    w: dict[str, float] = defaultdict(float)
    g2: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        for spans, right, size, n in work:
            scores = [sum(w[f] for f in fs) for _, _, fs in spans]
            for (_, _, fs), yes, p in zip(spans, right, marginals(size, spans, scores)):
                d = yes - p
                if abs(d) > 1e-3:
                    d *= math.sqrt(n)
                    for f in fs:
                        g = d - decay * w[f]
                        g2[f] += g * g
                        w[f] += rate * g / math.sqrt(g2[f])
    return {f: round(v, 3) for f, v in sorted(w.items()) if abs(v) >= 0.02}


def marginals(n: int, spans: list, scores: list[float]) -> list[float]:
    """Probability of each segment: forward-backward over positions, with gaps of weight 1."""

    def add(x: float, y: float) -> float:
        if x < y:
            x, y = y, x
        return x + math.log1p(math.exp(y - x)) if y > -1e300 else x

    ends, starts = defaultdict(list), defaultdict(list)
    for k, (i, j, _) in enumerate(spans):
        ends[j].append(k), starts[i].append(k)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        fwd[e] = fwd[e - 1]
        for k in ends[e]:
            fwd[e] = add(fwd[e], fwd[spans[k][0]] + scores[k])
    for s in range(n - 1, -1, -1):
        bwd[s] = bwd[s + 1]
        for k in starts[s]:
            bwd[s] = add(bwd[s], scores[k] + bwd[spans[k][1]])
    return [math.exp(min(0.0, fwd[i] + scores[k] + bwd[j] - fwd[n])) for k, (i, j, _) in enumerate(spans)]


# ---- operators ----


def find_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos), one row per item; positions count characters from 0.

    Null, empty and blank texts give no rows; repeated rows give theirs again;
    an empty table gives none. Text of any length is read to its end.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared_decoder()
        for b in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, s, e in decoder.find(t):
                    at.append(i), kinds.append(k), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "kind", "start_pos", "end_pos"])

    return rows.mapInArrow(run, f"id {kind}, kind string, start_pos int, end_pos int").withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each item replaced by a placeholder of its type, such as ``[NAME]``; null stays null."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared_decoder()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                parts, at = [], 0
                for k, s, e in decoder.find(t):
                    parts += [t[at:s], f"[{k.upper()}]"]
                    at = e
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})
