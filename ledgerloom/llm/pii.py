"""Personal data in texts: patterns propose spans, validators confirm them, context words move the score.

Patterns of certain shapes stand by themselves; others (national ids, unspaced phone numbers,
dates) count only where words nearby speak for them, so plain numbers are left alone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_of, bounded, rows_out, type_of, whole_texts

#: Characters before and after a span in which context words are looked for.
CONTEXT = 48
#: Score from which a span is reported.
LEAST_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


_SEPARATORS = re.compile("[ -]")


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters count from 10, the rest by 97 is 1."""
    compact = _SEPARATORS.sub("", iban).upper()
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def issued_ssn(text: str) -> bool:
    """No number is issued with an area of 000, 666 or 900 up, a group of 00 or a serial of 0000."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def calendar_date(text: str) -> bool:
    """A day that exists, from 1900 to 2100, in the order year-month-day or day.month.year or month/day/year."""
    a, b, c = map(int, re.split("[-/.]", text))
    for y, m, d in ((a, b, c),) if len(text.split("-")) == 3 else ((c, b, a), (c, a, b)):
        try:
            if 1900 <= dt.date(y, m, d).year <= 2100:
                return True
        except ValueError:
            pass
    return False


def dialled_number(text: str) -> bool:
    """Area codes begin with 2 to 9, and not all digits are the same."""
    d = _digits(text)
    return d[0] in "23456789" and len(set(d)) > 1


def random_text(text: str) -> bool:
    """Letters and digits as mixed as in drawn text: at least three bits a character."""
    counts = Counter(text).values()
    bits = sum(n * math.log2(len(text) / n) for n in counts) / len(text)
    return bits >= 3 and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Detector:
    """``propose`` gives spans left to right; each passes ``confirm`` or goes. ``score`` is without
    context; a word of ``context`` nearby adds 0.4, one of ``against`` takes 0.3, up to 1."""

    kind: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    score: float = 1.0
    context: re.Pattern | None = None
    hint: str = ""
    against: re.Pattern | None = None


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@domain.more``, found from each @ so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _pattern(source: str, flags: int = 0) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(source, flags)
    return lambda text: (m.span() for m in compiled.finditer(text))


#: The length of a country's IBANs; other countries are tried at every length.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
    }.items()
    for c in countries.split()
}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
_IBAN_MORE = re.compile(r"(?:[ -]?[A-Za-z0-9]){11,30}")
_USUAL = re.compile(r"[A-Z0-9 ]+")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs from every start. What follows may look like more groups, so each group border is
    tried as the end: the one of the country's length first, then the longer before the shorter. In lower case or
    with hyphens, as other codes are written too, only the country's length counts."""
    start = _IBAN_START.search(text)
    while start:
        more, found = _IBAN_MORE.match(text, start.end()), None
        if more:
            length, usual = IBAN_LENGTHS.get(start[0][:2].upper()), lambda e: _USUAL.fullmatch(text, start.start(), e)  # noqa: B023
            fits = lambda e: len(_SEPARATORS.sub("", text[start.start() : e])) == length  # noqa: B023, E731
            borders = [e for e in range(more.end(), more.start() + 10, -1) if text[e - 1] not in " -" and not (e < len(text) and text[e].isascii() and text[e].isalnum()) and (fits(e) or usual(e))]
            borders.sort(key=lambda e: not fits(e))
            found = next((e for e in borders if mod97(text[start.start() : e])), None)
        if found:
            yield start.start(), found
        start = _IBAN_START.search(text, found or start.end())


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _words(source: str) -> re.Pattern:
    return re.compile(rf"\b(?:{source})\b", re.I)


_CALL = _words("phone|call|tel|mobile|fax|dial|telefon|tél|teléfono")

#: The base kinds, in the order in which their spans are listed. A match that fails its check is
#: dropped whole; context moves their scores, but none below what is reported. Digits start a match only where none stands before, which finds the same spans
#: as trying every digit, without trying long runs again and again.
BASE = (
    Detector("email", emails, lambda s: True, 0.9, hint="@"),
    Detector("ip", _pattern(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda s: all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split("."))), 0.85, _words("ip|host|server|address|login"), ".", _words("version|section|chapter|release")),
    Detector("card", _pattern(r"[0-9](?:[ -]?[0-9])+"), lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d), 0.8, _words("card|visa|mastercard|credit|payment|karte|carte|tarjeta")),
    Detector("phone", _pattern(r"\+[0-9][ ().0-9-]+[0-9]"), lambda s: 8 <= len(_digits(s)) <= 15, 0.8, _CALL, "+"),
)

#: What the method adds. National ids and unmarked phone numbers need a context word.
ADDED = (
    Detector("iban", ibans, mod97, 0.9),
    Detector("ssn", _pattern(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), issued_ssn, 0.3, re.compile(r"\b(?:ssn|social security|tax id)\b", re.I), "-"),
    Detector("local_phone", _pattern(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"), dialled_number, 0.3, _CALL, "", _words("order|invoice|serial|part number|tracking")),
    Detector("birth_date", _pattern(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9])"), calendar_date, 0.2, re.compile(r"\b(?:born|birth|birthday|dob|geboren|née?|nacid[oa])\b", re.I)),
    Detector("secret", _pattern(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"), random_text, 0.3, re.compile(r"(?<![A-Za-z])(?:tokens?|secrets?|passw(?:or)?d|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|credentials?|bearer)(?![A-Za-z])", re.I)),
)

_ANY_DIGIT = re.compile(r"[0-9]")


def spans_of(kind: Detector, text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of one kind's spans, in code points, end exclusive."""
    out = []
    for start, end in kind.propose(text):
        if not kind.confirm(text[start:end]):
            continue
        score = kind.score
        if kind.context or kind.against:
            near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
            score += 0.4 * bool(kind.context and kind.context.search(near)) - 0.3 * bool(kind.against and kind.against.search(near))
        if score >= LEAST_SCORE:
            out.append((start, end, min(1.0, score)))
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
    """The base spans and the added ones of a text, by kind and start; added spans that touch a
    base span are left out, so no place is reported twice."""
    text = text or ""
    if not ("@" in text or _ANY_DIGIT.search(text)):
        return [], []
    base = [(k.kind, *s) for k in BASE if k.hint in text for s in spans_of(k, text)]
    more = [(k.kind, *s) for k in ADDED if k.hint in text for s in spans_of(k, text)]
    more = [m for m in more if not any(m[1] < b[2] and b[1] < m[2] for b in base)]
    return base, more


def _listed(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redacted(text: str | None) -> str | None:
    """The text with each found span replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    base, more = find(text)
    if not base and not more:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document: doc_id, spans array<struct<kind, start, end, score, base>>, digest columns.

    A span is as long as it is found, whatever its length: keys of any size are one span. Null and
    empty texts have no spans; repeated rows give repeated rows; texts are searched
    whole; an empty table gives no rows.
    """
    source = whole_texts(docs, id_col, text_col)
    counts = ", ".join(f"n_{k.kind} long" for k in BASE)
    ddl = f"doc_id {type_of(source, 'doc_id')}, {counts}, n_added long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            columns = [[sum(s[0] == k.kind for s in base) for base, _ in found] for k in BASE]
            listed = [_listed(base) for base, _ in found]
            every = [_listed(base + more) for base, more in found]
            rows = [[{"kind": k, "start": a, "end": b, "score": s, "base": i < len(base)} for i, (k, a, b, s) in enumerate(base + more)] for base, more in found]
            others = [len(more) for _, more in found]
            yield rows_out(schema, [batch.column("doc_id"), *columns, others, [hashlib.sha256(x.encode()).hexdigest() for x in listed], every, rows])

    return source.mapInArrow(run, ddl)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; every row and every other column stays.

    Null texts stay null and empty ones empty, long texts are searched whole, repeated rows are
    redacted alike, and an empty table gives no rows.
    """
    at, types = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            columns = batch.columns
            columns[at] = pa.array([redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, types)
