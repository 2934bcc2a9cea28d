"""Personal data in whole texts, found as written and behind disguises, as spans of the source.

Four kinds are looked for: email, ip, card (13 to 19 digits that pass the Luhn
sum) and phone (9 to 15 digits after a plus sign).  The detectors run on the text
as it is (base spans), then on a normalised copy.  That copy is made by
transducers, each a list of edits (start, end, replacement): look-alike letters,
digits and signs of other scripts become ASCII and invisible ones go; spelled
digits become digits; ``at``, ``dot`` and ``plus`` in their disguises become signs.
Every character of the copy keeps the source range it came from, so a span found
there is mapped back to source characters.  It is added if it lies apart from the
base spans of its kind; an address may also be longer than a base one inside it.

Detectors take linear time: an address is looked for around each ``@``, number
patterns use possessive repeats and start only at the start of a run.

Edge cases: a null text counts as empty and has no spans; a null id is passed
through; repeated rows are scanned each; an empty table gives no rows; other
columns are ignored.  Lone disguises stay alone: a plain ``at`` counts only with a
disguised dot, or before a domain if the name before it has a digit or a sign.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import texts

KINDS = ("email", "ip", "card", "phone")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"

# Letters of other scripts that look like ASCII ones.
LETTERS = dict(
    zip(
        "аеорсухіѕԁкмтвнјԝɡһԛАВЕКМНОРСТХІЅЈαορικντυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıոսօ",
        "aeopcyxisdkmtbhjwghqABEKMHOPCTXISJaopikvtuxABEZHIKMNOPTYXinuo",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
DOTS = "。․．｡"
DASHES = "‐‑‒–—−"
# Names of the digits in the languages of the texts.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Last labels of domains after which a plain "at" and "dot" are taken for an address.
ENDINGS = "com org net edu gov info biz io co uk de fr es it eu us ca au ch at nl be ru cn jp test example".split()

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    value: str


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        digit *= 1 + place % 2
        total += digit - 9 * (digit > 9)
    return total % 10 == 0


def emails(text):
    """Leftmost non-overlapping addresses: the run of name characters before an ``@`` and a dotted domain after it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            low = match.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def _ips(text):
    for match in IP.finditer(text):
        if all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in match.group().split("."))):
            yield match.span()


def _cards(text):
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _phones(text):
    for match in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in match.group()) <= 15:
            yield match.span()


DETECTORS = dict(zip(KINDS, (emails, _ips, _cards, _phones), strict=True))


def detected(text):
    """(kind, start, end) by kind, then start."""
    return [(kind, start, end) for kind, detector in DETECTORS.items() for start, end in detector(text)]


class Traced:
    """A text whose every character knows the source range [low, high) it came from."""

    def __init__(self, text):
        self.text = text
        self.low = np.arange(len(text), dtype=np.int64)
        self.high = self.low + 1
        self.changed = False

    def edit(self, edits):
        """Apply edits (start, end, replacement), in order and apart; a replacement covers the whole source of its edit."""
        edits = list(edits)
        if not edits:
            return
        starts, ends, news = zip(*edits, strict=True)
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        starts, ends, sizes = np.array(starts), np.array(ends), np.array([len(n) for n in news])
        depth = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, ends, -1)
        kept = np.cumsum(depth[:-1]) == 0
        before = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
        places = np.repeat(starts - before, sizes)
        self.low = np.insert(self.low[kept], places, np.repeat(self.low[starts], sizes))
        self.high = np.insert(self.high[kept], places, np.repeat(self.high[ends - 1], sizes))
        self.text = "".join(parts) + self.text[at:]
        self.changed = True

    def source(self, start, end):
        return int(self.low[start]), int(self.high[end - 1])


@lru_cache(1)
def _alike():
    """ASCII for each character that stands for an ASCII one, and a pattern of them all."""
    table = dict(LETTERS) | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(DOTS, ".") | dict.fromkeys(DASHES, "-")
    for code in chain(range(0xA0, 0x3000), range(0xFE50, 0xFFE7), range(0x1D400, 0x1D800), range(0x1FBF0, 0x1FBFA)):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if char not in table and unicodedata.decimal(char, None) is not None:
            table[char] = str(unicodedata.decimal(char))
        elif char not in table and len(plain) == 1 and " " <= plain <= "~":
            table[char] = plain
    few = "".join(re.escape(c) for c in table if c < "\U00010000")
    return table, re.compile(f"[{few}\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9]")


def _letters(text):
    table, pattern = _alike()
    for match in pattern.finditer(text):
        char = match.group()
        if char not in table:
            continue
        if char in DASHES:  # a dash joins only digits; elsewhere it is punctuation
            near = text[max(0, match.start() - 1) : match.end() + 1]
            if not (len(near) == 3 and near[0].isdigit() and near[2].isdigit()):
                continue
        yield match.start(), match.end(), table[char]


_NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
_DOT_WORD = r"(?:dot|punkt|point|punto)"
_SPELLED = re.compile(rf"(?<!\w)(?:{_NUMBER})(?:[\x20,-]{{1,2}}(?:{_NUMBER}))*(?!\w)", re.I)
_ONE = re.compile(_NUMBER, re.I)
_BEFORE = re.compile(rf"(?:\+|(?<!\w)(?:{_DOT_WORD}|plus)[\])}}]?)[\x20-]?$", re.I)
_AFTER = re.compile(rf"[\x20-]?[\[({{]?{_DOT_WORD}(?!\w)", re.I)
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\x20-]?$"), re.compile(r"[\x20-]?[0-9]")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl|]{0,19}[0-9])[0-9OoIl|]{2,}(?![A-Za-z0-9])")
_ROUND = str.maketrans("OoIl|", "00111")


def _spelled(text):
    """Runs of three digit names and more become digits; shorter ones only beside a plus or a dot or between digits."""
    for match in _SPELLED.finditer(text):
        names = list(_ONE.finditer(text, *match.span()))
        if len(names) < 3:
            head = text[max(0, match.start() - 9) : match.start()]
            beside = _BEFORE.search(head) or _AFTER.match(text, match.end())
            if not beside and not (_DIGIT_BEFORE.search(head) and _DIGIT_AFTER.match(text, match.end())):
                continue
        for name, after in zip(names, [*names[1:], None], strict=True):
            yield name.start(), after.start() if after else name.end(), str(DIGITS[name.group().lower()])


def _mixed(text):
    """Letters that look like digits, within words that hold digits."""
    for match in _MIXED.finditer(text):
        if not match.group().isdigit():
            for at, char in enumerate(match.group(), match.start()):
                if char in "OoIl|":
                    yield at, at + 1, char.translate(_ROUND)


# Disguises are short: signs lie at most three blanks apart, labels of a domain have at most 63 characters.
_WRAPPED = r"[\[({{<][\x20\t]{{0,3}}(?:{})[\x20\t]{{0,3}}[\])}}>]"
_WRAPPED_AT = re.compile(_WRAPPED.format("at|@|arroba|ät") + "|&#64;|&commat;", re.I)
_WRAPPED_DOT = re.compile(_WRAPPED.format(rf"{_DOT_WORD}|\."), re.I)
_LABEL = "[A-Za-z0-9-]{1,63}"
_SPELLED_DOT = rf"[\x20\t_]{{1,3}}{_DOT_WORD}[\x20\t_]{{1,3}}"
_SPACED_DOT = r"[\x20\t]{1,3}\.[\x20\t]{0,3}"
_PLAIN_AT = re.compile(
    rf"(?<=[A-Za-z0-9])(?P<at>[\x20\t_-]{{1,3}}(?:at|@|arroba)[\x20\t_-]{{1,3}}|[\x20\t]{{1,3}}@|@[\x20\t]{{1,3}})"
    rf"(?P<domain>{_LABEL}(?:(?:{_SPELLED_DOT}|{_SPACED_DOT}|\.){_LABEL}){{1,10}})",
    re.I,
)
_PLAIN_DOT = re.compile(f"{_SPELLED_DOT}|{_SPACED_DOT}", re.I)
_AFTER_AT = re.compile(rf"(?<=@){_LABEL}(?:(?:{_SPELLED_DOT}|\.){_LABEL}){{1,10}}", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+$")
_NUMBER_DOT = re.compile(
    rf"(?<=[0-9])(?:[\x20\t]{{0,3}}[\[({{]?{_DOT_WORD}[\])}}]?[\x20\t]{{0,3}}|{_SPACED_DOT}|\.[\x20\t]{{1,3}})(?=[0-9])", re.I
)
_PLUS = re.compile(r"(?<!\w)plus[\x20\t-]{0,3}(?=\(?[0-9])", re.I)


def _wrapped(pattern, new):
    """The sign for each match, blanks around it included."""

    def edits(text):
        low = 0
        for match in pattern.finditer(text):
            start, end = match.span()
            while start > low and text[start - 1] in " \t":
                start -= 1
            while end < len(text) and text[end] in " \t":
                end += 1
            low = end
            yield start, end, new

    return edits


def _known_ending(domain):
    return re.split(r"[^A-Za-z0-9-]+", domain)[-1].lower() in ENDINGS


def _plain_at(text):
    """Spaced signs of an address: the at with a disguised dot or after a name with a digit or sign, and its dots."""
    for match in _PLAIN_AT.finditer(text):
        domain = match.group("domain")
        dots = list(_PLAIN_DOT.finditer(text, *match.span("domain")))
        name = _NAME.search(text, max(0, match.start() - 64), match.start())
        marked = name and re.search(r"[0-9._%+-]", name.group())
        if _known_ending(domain) and (dots or marked):
            yield *match.span("at"), "@"
            for dot in dots:
                yield *dot.span(), "."


def _later_dots(text):
    for match in _AFTER_AT.finditer(text):
        if _known_ending(match.group()):
            for dot in _PLAIN_DOT.finditer(text, *match.span()):
                yield *dot.span(), "."


def _every(pattern, new):
    return lambda text: ((*match.span(), new) for match in pattern.finditer(text))


_SIGN = "dot|punkt|point|punto|\\."
# Each with a linear-time pattern that every text it would edit matches; case is ignored.
TRANSDUCERS = (
    (None, _letters),
    (
        rf"(?:{_NUMBER})[ ,-][ ,-]?(?:{_NUMBER})[ ,-][ ,-]?(?:{_NUMBER})|[0-9][ -]?(?:{_NUMBER})[ ,-]{{0,2}}(?:{_NUMBER}|[0-9])"
        rf"|(?:\+|{_DOT_WORD}[\])}}]?|plus)[ -]?(?:{_NUMBER})|(?:{_NUMBER})[ -]?[\[({{]?{_DOT_WORD}",
        _spelled,
    ),
    (r"\b[0-9]+[OoIl|]|\b[OoIl|]+[0-9]|[|][0-9]|[0-9][|]", _mixed),
    (rf"[0-9][ \t]{{0,3}}[\[({{]?(?:{_DOT_WORD}|\.[ \t]|[ \t]\.)", _every(_NUMBER_DOT, ".")),
    (r"plus[ \t-]{0,3}\(?[0-9]", _every(_PLUS, "+")),
    (r"[\[({<][ \t]{0,3}(?:at|@|arroba|ät)[ \t]{0,3}[\])}>]|&#64;|&commat;", _wrapped(_WRAPPED_AT, "@")),
    (rf"[\[({{<][ \t]{{0,3}}(?:{_SIGN})[ \t]{{0,3}}[\])}}>]", _wrapped(_WRAPPED_DOT, ".")),
    (
        rf"(?:[ \t_-](?:at|@|arroba)[ \t_-]{{1,3}}|[ \t]@|@[ \t]{{1,3}})[A-Za-z0-9-]+(?:[ \t_]+{_DOT_WORD}[ \t_]+|[ \t]+\.[ \t]*|\.)[A-Za-z0-9-]",
        _plain_at,
    ),
    (rf"@[A-Za-z0-9-][A-Za-z0-9.-]*[ \t_]+{_DOT_WORD}[ \t_]", _later_dots),
)
BASE_SIGNS = (
    r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    r"[0-9](?:[ -]?[0-9]){12}",
    r"\+[0-9][ ().0-9-]+[0-9]",
)


def _holds(values, pattern):
    """Whether an Arrow string column, or each of its values, holds a pattern (None: a look-alike), in linear time."""
    if pattern is None:
        return pc.match_substring_regex(values, pattern=_alike()[1].pattern)
    return pc.match_substring_regex(values, pattern=pattern, ignore_case=True)


def normalised(text) -> Traced:
    traced = Traced(text)
    for pattern, transducer in TRANSDUCERS:
        if _holds(pa.scalar(traced.text), pattern).as_py():
            traced.edit(transducer(traced.text))
    return traced


def find_spans(text: str, disguised: bool = True) -> list[Span]:
    """All spans by kind, then start; base spans first among equal starts.

    ``disguised`` may be false for a text that no transducer edits.
    """
    base = detected(text)
    spans = [Span(kind, start, end, True, text[start:end]) for kind, start, end in base]
    traced = normalised(text) if disguised else None
    if traced is not None and traced.changed:
        held = {kind: ([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS}
        for kind, start, end in detected(traced.text):
            low, high = traced.source(start, end)
            starts, ends = held[kind]
            last = bisect_left(starts, high) - 1  # the last base span that starts before the end of this one
            apart = last < 0 or ends[last] <= low
            if apart or (kind == "email" and low <= starts[last] and high > ends[last]):
                spans.append(Span(kind, low, high, False, traced.text[start:end]))
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, not s.base, s.end))


def signs(column):
    """Per text: whether a detector may find something in it, and whether a transducer may edit it."""
    base = reduce(pc.or_, [_holds(column, pattern) for pattern in BASE_SIGNS])
    disguised = reduce(pc.or_, [_holds(column, pattern) for pattern, _ in TRANSDUCERS])
    return base.to_pylist(), disguised.to_pylist()


def personal_data(docs: DataFrame) -> DataFrame:
    """Every row with doc_id and its spans: kind, start, end (code points), whether base, and the plain value."""

    def run(batches):
        for batch in batches:
            column = batch.column("text").fill_null("")
            found = [
                [span._asdict() for span in find_spans(text.as_py(), disguised)] if base or disguised else []
                for text, base, disguised in zip(column, *signs(column), strict=True)
            ]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their SHA-256, and all spans as text (kind:start:end, comma-joined)."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), added
    )
