"""Personal data in whole texts, plain or disguised, by offset-preserving transducers.

Plain identifiers are found in the text as it is. Disguised ones are found in a
normalised text, which three transducers make one after another:

* homoglyphs: letters, digits and signs that look like ASCII ones become these, and
  characters without width go;
* spelled digits: runs of digit words ("five five one") become digits;
* at and dot disguises: "(at)", " at ", "[dot]", " dot " and their kin become signs.

A transducer only notes where it changed something, so that the place of every
normalised character in the source text is known by a search among few notes. Spans
that are found in the normalised text and touch a change are mapped back; those that
meet a plain span of their kind are left out. All patterns read a text in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tideglass.llm.common import map_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# What the definitions of the kinds say, written so that no character is tried twice:
# runs are taken whole (they end where the class ends) and only begin where no run is under way.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and without overlaps."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        # what lies before this sign is read no more
        end = found.end() if found else at + 1
        if found:
            yield start, end
        at = text.find("@", end)


def addresses(text: str) -> Iterator[Span]:
    """``[0-9]+(\\.[0-9]+){3}`` of parts of at most 255."""
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    rest = sum(map(int, digits[-1::-2]))
    return (rest + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    """``[0-9]([ -]?[0-9])+`` of 16 to 19 digits that pass Luhn's check."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    """``\\+[0-9][ ().0-9-]+[0-9]`` of 8 to 15 digits."""
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        number = m.group().rstrip(" ().-") if m else ""
        # a sign, a digit, something and a digit
        if len(number) >= 4:
            if 8 <= len(_NO_DIGIT.sub("", number)) <= 15:
                yield at, at + len(number)
            at += len(number) - 1
        at = text.find("+", at + 1)


_FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of identifiers of each kind as they stand: leftmost, without overlaps within a kind."""
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


class Notes:
    """A changed text: what was changed, and where each of its places lies in the text before."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement) of the source, in order and without overlaps."""
        out, at, length = [], 0, 0
        #: Changes by their places in the new text, with those in the source.
        self.starts: list[int] = []
        self.changes: list[tuple[int, int, int]] = []
        for start, end, new in edits:
            out.append(source[at:start])
            length += start - at
            self.starts.append(length)
            self.changes.append((length + len(new), start, end))
            out.append(new)
            length += len(new)
            at = end
        out.append(source[at:])
        self.text = "".join(out)

    def _place(self, place: int, last: bool) -> int:
        """Where the character at ``place`` begins in the source, or where it ends."""
        k = bisect_right(self.starts, place) - 1
        # changes that left nothing stand before the character
        if k < 0:
            return place + last
        new_end, start, end = self.changes[k]
        if place < new_end:
            return end if last else start
        return end + place - new_end + last

    def back(self, span: Span) -> Span:
        """The source's span of a span of the new text."""
        return self._place(span[0], False), self._place(span[1] - 1, True)

    def touches(self, span: Span) -> bool:
        """Whether something was changed within a span of the new text."""
        k = bisect_right(self.starts, span[0]) - 1
        return k >= 0 and self.changes[k][0] > span[0] or k + 1 < len(self.starts) and self.starts[k + 1] < span[1]


# Letters of other scripts that look like the Latin ones under them.
_ALIKE = (
    ("абеорсухівкмнтѕјһԁԛԝѵɡӏАВЕКМНОРСТУХЅІЈԚԜҮ", "abeopcyxibkmhtsjhdqwvglABEKMHOPCTYXSIJQWY"),
    ("αεικνορτυχϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aeiknoptuxcABEZHIKMNOPTYXC"),
)
_LETTERS = {ord(a): b for theirs, ours in _ALIKE for a, b in zip(theirs, ours, strict=True)}


@lru_cache(1 << 12)
def ascii_of(character: str) -> str | None:
    """What a character looks like in ASCII (nothing for one without width), or None."""
    code = ord(character)
    if code in _LETTERS:
        return _LETTERS[code]
    category = unicodedata.category(character)
    if category == "Cf":
        return ""
    if category == "Nd":
        return str(unicodedata.decimal(character))
    if category == "Zs":
        return " "
    if category == "Pd" or character == "−":
        return "-"
    if character in "․。｡":
        return "."
    like = unicodedata.normalize("NFKC", character)
    return like if like != character and like.isascii() and like.isalnum() | (like in "@.+%_()[]{}") else None


#: Accented Latin letters mean themselves.
_FOREIGN = re.compile(r"[^\x00-\x7F\u00C0-\u024F]+")


def plain_letters(text: str) -> Notes:
    """Homoglyphs as ASCII."""
    edits = []
    if not text.isascii():
        for run in _FOREIGN.finditer(text):
            for k, c in enumerate(run.group(), run.start()):
                new = ascii_of(c)
                if new is not None:
                    edits.append((k, k + 1, new))
    return Notes(text, edits)


# Digit words of English, German, French and Spanish.
_DIGITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_TIMES = {"double": 2, "triple": 3}
_SPELLED = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_DOTS = "dot|punkt|point|punto"
_TOKEN = re.compile(rf"(?:(double|triple)[ -])?({_SPELLED})(?!\w)|([0-9]+)(?!\w)|({_DOTS})(?!\w)")
_PART = rf"(?:(?:(?:double|triple)[ -])?(?:{_SPELLED})|[0-9]+|{_DOTS})(?!\w)"
#: Digits, digit words and words for dots after each other.
_NUMERAL = re.compile(rf"(?<!\w)(plus[ -])?{_PART}(?:(?:, ?|[ -]){_PART})++")
#: A digit of letters' shape beside digits.
_SHAPED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*+[0-9])[0-9OoIl]{2,}+(?![A-Za-z0-9])")
_SHAPES = str.maketrans("OoIl", "0011")


def _spelled(numeral: re.Match) -> list[tuple[int, int, str]]:
    """Changes that make digits of a numeral with digit words and at least two digits; none for any other."""
    parts = [m for m in _TOKEN.finditer(numeral.string, numeral.end(1) if numeral[1] else numeral.start(), numeral.end())]
    if not any(m[2] for m in parts) or sum(1 for m in parts if not m[4]) < 2:
        return []
    edits = [(numeral.start(), parts[0].start(), "+")] if numeral[1] and not parts[0][4] else []
    before = None
    for m in parts:
        # neighbours are one number where one of them is a word
        joined = before is not None and not before[4] and not m[4] and (before[2] or m[2])
        if m[2]:
            edits.append((before.end() if joined else m.start(), m.end(), str(_DIGITS[m[2]]) * _TIMES.get(m[1], 1)))
        elif joined:
            edits.append((before.end(), m.start(), ""))
        before = m
    return edits


def plain_digits(text: str) -> Notes:
    """Spelled digits, and letters that stand for digits beside digits, as digits."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    edits = [e for m in _NUMERAL.finditer(low) for e in _spelled(m)]
    shaped = [(m.start(), m.end(), new) for m in _SHAPED.finditer(text) if (new := m.group().translate(_SHAPES)) != m.group()]
    # a shaped token has a letter, and so is no part of a numeral
    return Notes(text, sorted(edits + shaped))


# Words for the signs in English, German, French and Spanish.
_AT, _DOT = r"(?:at|ät|arobase|arroba|@)", rf"(?:{_DOTS}|\.)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BARE_DOT = rf" (?:{_DOTS}) (?=[A-Za-z0-9])"
_HELD_DOT = rf" ?{_OPEN} ?{_DOT} ?{_CLOSE} ?(?=[A-Za-z0-9])"
_HELD_AT = rf" ?{_OPEN} ?{_AT} ?{_CLOSE} ?(?=[A-Za-z0-9])"
_DISGUISE = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:(?P<held_at>{_HELD_AT}| ?@ ?(?=[A-Za-z0-9]))|(?P<held_dot>{_HELD_DOT})|(?P<bare_at> (?:at|arobase|arroba) (?=[A-Za-z0-9]))|(?P<bare_dot>{_BARE_DOT}))", re.I)
_MAY_BE = re.compile(rf"{_OPEN} ?(?:{_AT}|{_DOT}) ?{_CLOSE}| (?:{_DOTS}) | @|@ ", re.I)
_DOMAIN_RUN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++")


def plain_signs(text: str) -> Notes:
    """Disguised at and dot signs as signs.

    An at is one before a name with dots, plain or disguised; a bare word only before
    disguised ones. A dot is one between digits, in the domain after such an at, or
    in the name before it. So prose stays as it is.
    """
    if not _MAY_BE.search(text):
        return Notes(text, [])
    marks = [(m.start(), m.end(), m.lastgroup) for m in _DISGUISE.finditer(text)]
    signs: dict[int, str] = {}
    domain = -1
    for k, (start, end, kind) in enumerate(marks):
        run = _DOMAIN_RUN.match(text, end)
        follows = marks[k + 1] if k + 1 < len(marks) else (-1, -1, "")
        if kind.endswith("at"):
            dotted = run is not None and follows[0] == run.end() and follows[2].endswith("dot")
            if dotted or kind == "held_at" and run is not None and "." in run.group():
                signs[k], domain = "@", run.end()
        elif start == domain or text[start - 1].isdigit() and text[end].isdigit():
            signs[k] = "."
            domain = run.end() if start == domain and run is not None else domain
    name = -1
    for k in range(len(marks) - 1, -1, -1):
        start, end, kind = marks[k]
        if signs.get(k) == "@":
            name = start
        elif kind.endswith("dot") and k not in signs and (run := _LOCAL_RUN.match(text, end)) and run.end() == name:
            signs[k], name = ".", start
    return Notes(text, [(marks[k][0], marks[k][1], signs[k]) for k in sorted(signs)])


TRANSDUCERS = (plain_letters, plain_digits, plain_signs)


def spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain, added) spans of each kind, in code points: as they stand, and what the normalised text shows beside them."""
    plain, added = plain_spans(text), {kind: [] for kind in KINDS}
    steps, now = [], text
    for transducer in TRANSDUCERS:
        notes = transducer(now)
        if notes.changes:
            steps.append(notes)
            now = notes.text
    if not steps:
        return plain, added
    for kind, found in plain_spans(now).items():
        own, ends = plain[kind], [e for _, e in plain[kind]]
        for span in found:
            touched = False
            for notes in reversed(steps):
                touched = touched or notes.touches(span)
                span = notes.back(span)
            k = bisect_right(ends, span[0])
            if touched and not (k < len(own) and own[k][0] < span[1]):
                added[kind].append(span)
    return plain, added


def listed(found: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by kind, then start, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(found[kind]))


def _found(kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([listed(side) for side in pair], pa.string()) for pair in zip(*[(p, {k: p[k] + a[k] for k in KINDS}) for p, a in rows], strict=True)] if rows else [pa.array([], pa.string())] * 2
            numbers = [pa.array([len(p[k]) for p, _ in rows], pa.int64()) for k in KINDS]
            yield pa.record_batch([batch.column(0), *numbers, pa.array([sum(map(len, a.values())) for _, a in rows], pa.int64()), *columns], names=["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base", "spans"])

    return work


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base and spans of every whole text.

    The counts and ``base`` are of plain identifiers, ``n_added`` of disguised ones,
    ``spans`` lists both: ``kind:start:end`` in code points of the text as it came.
    Null and empty texts have none. Null and repeated ids are rows like others; an
    empty table gives an empty result; other columns play no part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[doc_id].dataType
    counts = ", ".join(f"n_{k} long" for k in (*KINDS, "added"))
    return map_slices(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), _found(to_arrow_type(field)), f"doc_id {field.simpleString()}, {counts}, base string, spans string", rows=256)
