"""Personal data in whole texts, also when it is disguised, with spans in source characters.

The base patterns are searched as they stand. Then a transducer rewrites the text: look-alike
characters become the ASCII ones they imitate, invisible ones vanish, spelled digits become
digits, and bracketed or spaced "at" and "dot" become their signs; a bare "at" or a spaced sign only
before a host. It keeps the source position of every character it writes, so whatever the same
patterns find in its output maps back to a source span. Spans that touch none found before are added,
and those of which one found before is a fragment; base spans always stay.

Cases: a null text is empty and has no spans. Text without a trigger is not rewritten. Repeated
rows are kept. An empty table gives an empty table. Other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import small_batches, spread

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the look-behind give the same leftmost
# matches without trying again inside a run.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Characters of other scripts and the ASCII ones they imitate.
CONFUSABLE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ј": "J", "Ѕ": "S", "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "τ": "t", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v",
    "·": ".", "•": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
#: Code points searched for characters that Unicode itself calls a form of an ASCII one: the basic plane, and the
#: blocks of mathematical letters and digits, of enclosed letters, and of segmented digits.
SEARCHED = (range(0x80, 0x3100), range(0xA000, 0xD800), range(0xFE00, 0x10000), range(0x10400, 0x11E00), range(0x1D400, 0x1D800), range(0x1E140, 0x1E960), range(0x1F100, 0x1F200), range(0x1FBF0, 0x1FBFA))
#: Marks that only overlay a letter, and selectors of its variants, are as good as invisible.
MARKS = (range(0x300, 0x370), range(0xFE00, 0xFE10))


def imitated(c: str) -> str | None:
    """The ASCII character that ``c`` is a form of by Unicode's tables; None if there is none. Raised and lowered ones are footnotes."""
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    kind = unicodedata.decomposition(c)
    plain = unicodedata.normalize("NFKC", c) if kind.startswith("<") and not kind.startswith(("<super>", "<sub>")) else c
    return plain if plain != c and len(plain) == 1 and " " <= plain <= "~" else None


def _tables() -> tuple[dict[str, str], str]:
    forms, unseen = dict(CONFUSABLE), [chr(k) for r in MARKS for k in r]
    for c in map(chr, [k for r in SEARCHED for k in r]):
        if unicodedata.category(c) == "Cf" and c <= "\uffff":
            unseen.append(c)
        elif form := imitated(c):
            forms[c] = form
    return forms, "".join(unseen)


LOOK_ALIKE, INVISIBLE = _tables()

# Names of digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Names of the signs, top-level labels that make a dotted name after a bare "at" a host, and countries' labels that are no words.
AT_NAMES = ("at", "arobase", "arroba", "klammeraffe")
DOT_NAMES = ("dot", "punkt", "point", "punto")
PLUS_NAMES = ("plus", "más")
TOP_LABELS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "dev", "app", "xyz", "online", "site", "shop", "store",
    "tech", "cloud", "blog", "example", "test", "invalid", "local",
)
COUNTRIES = (
    "ar", "au", "br", "ca", "ch", "cl", "cn", "co", "cz", "dk", "eu", "fi", "fr", "gr", "hk", "hu", "ie", "jp", "kr", "mx", "nl", "nz", "pl", "pt",
    "ro", "ru", "se", "sg", "tr", "tw", "ua", "uk", "za",
)

_SWAP = str.maketrans(LOOK_ALIKE)
_ODD = frozenset(LOOK_ALIKE) | frozenset(INVISIBLE)
_GONE = re.compile(f"[{re.escape(INVISIBLE)}]")
# grouped by their first letter, so that most words are passed over at once
_NAMES = "|".join(f"{a}(?:{'|'.join(sorted((n[1:] for n in SPELLED if n[0] == a), key=len, reverse=True))})" for a in sorted({n[0] for n in SPELLED}))
_AT, _DOTTED, _PLUS = ("(?:" + "|".join(names) + ")" for names in (AT_NAMES, DOT_NAMES, PLUS_NAMES))
_OPEN, _SHUT = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_HELD_DOT = rf"{_OPEN}(?:{_DOTTED}|\.){_SHUT}"
_DOT = rf"(?:\.|\s{{1,3}}{_DOTTED}\s{{1,3}}|_{_DOTTED}_|{_HELD_DOT})"
_LABEL = "[a-z0-9-]{1,63}"
_SURE = "(?:" + "|".join([*TOP_LABELS, *COUNTRIES, "de", "es"]) + ")"
_HOST = (
    rf"(?!www\.)(?:(?:{_LABEL}{_DOT}){{1,8}}{_SURE}|(?:{_LABEL}\.){{1,8}}[a-z]{{2}}|(?:{_LABEL}{_DOT}){{0,7}}{_LABEL}{_HELD_DOT}[a-z]{{2,24}})"
    r"(?![a-z0-9_@/-]|\.[a-z0-9])"
)
_NUMBER = rf"(?:\b(?:{_NAMES})\b|[0-9]{{1,3}})(?:[\s,-]{{1,2}}(?:(?:{_NAMES})|[0-9])\b){{0,2}}"
_SIGN = re.compile(
    rf"(?P<at>{_OPEN}(?:{_AT}|@){_SHUT}|(?<=[a-z0-9])_{_AT}_(?={_LABEL}(?:_{_DOTTED}_|\.(?:com|org|net|edu|gov)\b))"
    rf"|(?:\s{{1,3}}{_AT}\s{{1,3}}|\s{{1,3}}@\s{{0,3}}|(?<=[a-z0-9])@\s{{1,3}})(?=(?P<host>{_HOST})))"
    rf"|(?P<octets>\b{_NUMBER}(?:{_DOT}{_NUMBER}){{3}}\b)"
    rf"|(?P<dot>{_HELD_DOT}|(?<=[a-z0-9])(?:\s{{1,3}}{_DOTTED}\s{{1,3}}|_{_DOTTED}_)(?=[a-z0-9]))"
    rf"|(?P<plus>\b{_PLUS}\s{{1,3}}(?=[0-9]|(?:{_NAMES})\b))"
    rf"|(?P<digits>\b(?:{_NAMES}|[0-9])(?:[\s,.-]{{0,2}}\b(?:{_NAMES}|[0-9])\b){{6,}})",
    re.IGNORECASE,
)
# searched in lower case
_TRIGGER = re.compile(
    rf"[\[({{<]\s{{0,3}}(?:{_AT}|{_DOTTED}|@|\.)\s{{0,3}}[\])}}>]|\s{_DOTTED}\s|_{_AT}_|_{_DOTTED}_"
    rf"|\s(?:{_AT}\s{{1,3}}|@\s{{0,3}}){_LABEL}{_DOT}[a-z0-9]|@\s{{1,3}}{_LABEL}{_DOT}[a-z0-9]"
    rf"|\b(?:{_NAMES})[\s,.-]{{1,2}}(?:{_NAMES}|[0-9])\b|\b{_PLUS}\s{{1,3}}(?:{_NAMES}|[0-9])"
)
# Words before "at" and a host in prose, where no address is meant.
_PROSE = frozenset(
    "a about also am an and are available be been but buy by can check find follow for found from he her here him hosted i is it join listed live located look looked "
    "looking looks me met more not now online or order ours out page pages published read register see seen shop site start starts that the them there they this "
    "to up us visit was we website were work worked working works you".split()
)
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_HELD = re.compile(r"[\[({<]")
_BLANKS = re.compile(r"[\s,-]+")
_DOTS = re.compile(_DOT, re.IGNORECASE)
_NAME = re.compile(rf"\b(?:{_NAMES})\b", re.IGNORECASE)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and then start."""
    found = [Span("email", *x) for x in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(Span("phone", *m.span()))
    return found


class Rewritten:
    """A text with the way back to its source: for each pass, only where its changes lie before and after."""

    def __init__(self, text: str):
        self.text = text
        self.passes: list[tuple[array, array, array, array]] = []

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Put each string in the place of text[a:b]; its characters share the source range."""
        if not changes:
            return
        texts, done, shift = [], 0, 0
        lows, highs, news, ends = (array("q") for _ in range(4))
        for a, b, new in changes:
            texts += [self.text[done:a], new]
            lows.append(a)
            highs.append(b)
            news.append(a + shift)
            ends.append(a + shift + len(new))
            done, shift = b, shift + len(new) - (b - a)
        self.text = "".join([*texts, self.text[done:]])
        self.passes.append((lows, highs, news, ends))

    def source(self, span: Span) -> Span:
        low, last = span.start, span.end - 1
        for lows, highs, news, ends in reversed(self.passes):
            k, j = bisect_right(news, low) - 1, bisect_right(news, last) - 1
            if k >= 0:
                low = lows[k] if low < ends[k] else low - ends[k] + highs[k]
            if j >= 0:
                last = highs[j] - 1 if last < ends[j] else last - ends[j] + highs[j]
        return Span(span.kind, low, last + 1)


def _in_prose(text: str, at: int, host: str) -> bool:
    """Whether the word before an "at" can't be a mailbox, or the host is two sentences without a blank between."""
    before = _WORD_BEFORE.search(text, max(0, at - 64), at).group()
    return before.lower() in _PROSE or before.endswith(".") or host.rpartition(".")[2].istitle()


def rewrite(text: str) -> Rewritten:
    """The transducer: look-alikes, invisible characters, then signs and spelled digits."""
    out = Rewritten(text.translate(_SWAP))
    out.replace([(*m.span(), "") for m in _GONE.finditer(out.text)])
    changes = []
    for m in _SIGN.finditer(out.text):
        kind = m.lastgroup
        if kind == "octets":
            parts = _DOTS.split(m.group())
            changes.append((*m.span(), ".".join(_BLANKS.sub("", _NAME.sub(lambda n: SPELLED[n.group().lower()], p)) for p in parts)))
        elif kind == "at" and m["host"] and not _HELD.search(m["host"]) and _in_prose(out.text, m.start(), m["host"]):
            continue
        elif kind == "digits":
            lo = m.start()
            changes += [(lo + n.start(), lo + n.end(), SPELLED[n.group().lower()]) for n in _NAME.finditer(m.group())]
        else:
            changes.append((*m.span(), {"at": "@", "dot": ".", "plus": "+"}[kind]))
    out.replace(changes)
    # digits that were spelled one by one close up; what stood between them belongs to the number
    if any(len(n) == 1 and n.isdigit() for *_, n in changes):
        out.replace([(*m.span(), "") for m in re.finditer(r"(?<=\b[0-9])[\s,]{1,2}(?=[0-9]\b)", out.text)])
    return out


def _goes_beyond(span: Span, held: Span) -> bool:
    """Whether ``span`` properly contains ``held``, or is of its kind and not inside it."""
    inside = held.start <= span.start and span.end <= held.end
    return not inside and (span.kind == held.kind or (span.start <= held.start and held.end <= span.end))


class Held:
    """Spans by kind. A kind's spans come in order of their starts and don't overlap, so those that touch another are found by bisection."""

    def __init__(self) -> None:
        self.spans: dict[str, list[Span]] = {}

    def add(self, span: Span) -> None:
        self.spans.setdefault(span.kind, []).append(span)

    def touching(self, span: Span) -> Iterator[Span]:
        for mine in self.spans.values():
            k = bisect_right(mine, span.start, key=lambda s: s.end)
            while k < len(mine) and mine[k].start < span.end:
                yield mine[k]
                k += 1


def find_all(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and then start."""
    if not text:
        return [], []
    base = find(text)
    if not (_TRIGGER.search(text.lower()) or not (text.isascii() or _ODD.isdisjoint(text))):
        return base, base
    out, more, held, added = rewrite(text), [], Held(), Held()
    for span in base:
        held.add(span)
    for span in map(out.source, find(out.text)):
        if all(_goes_beyond(span, other) for spans in (held, added) for other in spans.touching(span)):
            more.append(span)
            added.add(span)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s.kind), s.start))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``(doc_id, base_spans, spans)`` of ``documents(doc_id, text)``."""
    small_batches(documents.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_all(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([[s._asdict() for s in f[k]] for f in found], _SPAN) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base_spans", "spans"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(search, f"doc_id long, base_spans {_SPANS}, spans {_SPANS}")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in angle brackets; null stays null."""
    small_batches(documents.sparkSession)

    def clean(text: str | None) -> str | None:
        parts, done = [], 0
        for _, a, b, kind in sorted((s.start, s.start, s.end, s.kind) for s in find_all(text)[1]):
            if b > done:
                parts += [text[done : max(a, done)], f"<{kind}>" if a >= done else ""]
                done = b
        return "".join([*parts, text[done:]]) if done else text

    at = documents.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return documents.mapInArrow(replace, documents.schema)
