"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a text and finds anchors: at-signs, plus signs, digits, schemes and identifier
cues. From each anchor a small deterministic parser expands to the boundaries of an address or number and validates it.
Parsers skip what an earlier span of their kind covers, so each stretch of text is parsed at most once a kind, also in
very long runs of digits or word characters.

Base kinds (leftmost, not overlapping within a kind): email, ip, card (13 to 19 digits, Luhn), phone (9 to 15 digits).
Added to these: a card or phone number in a longer run of numbers. Added kinds, where no base span lies: url_user (the user
part of a scheme://user@ authority), ip6, iban (with or without a cue: the length of its country, mod 97) and account (a
number or key behind an identifier cue such as ``ssn``, ``account``, ``token =`` or ``passport``; behind a password's cue and
a colon or equals sign any run with letters and digits).

Defined results: a null or empty text has no spans; places are code points, ends exclusive; repeated rows count each for
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded_batches, release

#: Texts of a batch that are held as strings at once.
SLICE = 512
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url_user", "ip6", "iban", "account")
ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}
Span = tuple[str, int, int]

#: Fixed: identifier cues, lower case. What follows one is an account if it has the form of one.
CUES = ("iban", "ssn", "passport", "account", "acct", "token", "secret", "api_key", "apikey", "password", "passwd", "api-key", "access_key", "konto", "compte", "cuenta")
#: Fixed: those whose value may be any run of characters.
SECRETS = frozenset(("password", "passwd", "secret"))
SCHEMES = ("://", "mailto:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"[\x20().0-9-]+")
_GROUPED = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}?(?![\x20.-]?[0-9]{2,4}(?![0-9.]))")
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+")
_AUTHORITY = re.compile(r"[^\s/?#@]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_HEX = frozenset("0123456789ABCDEFabcdef:")
_IP6 = re.compile(r"[0-9A-Fa-f:]+")
_SECRET = re.compile(r"[\x20\t]?[:=][\x20\t]?")
_RUN = re.compile(r"[^\s,;\"'<>]+")
#: Fixed: characters of a bank account number by country, as the standard's registry lists them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_CUED = re.compile(r"(?i)(?:\x20?(?:number|no|nr|id|key)\b)?\.?\x20{0,2}(?:is\x20|[:=#]\x20{0,2})?[\"']?([A-Za-z0-9])(?=[A-Za-z0-9_-]{4,}?[A-Za-z0-9])")
_KEY = re.compile(r"(?i)[A-Za-z0-9_-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def automaton():
    """Anchors with the parsers that they start."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", ":", *"0123456789", *SCHEMES, *{v for c in CUES for v in (c, c.upper(), c.capitalize())}):
        found.add_word(word, word)
    found.make_automaton()
    return found


def _is_digit(text: str, i: int) -> bool:
    return 0 <= i < len(text) and "0" <= text[i] <= "9"


class Parser:
    """Spans of one text; for each kind, ``done`` is the place up to which it needs no more parsing."""

    def __init__(self, text: str):
        self.text, self.base, self.added = text, [], []
        self.done = dict.fromkeys((*BASE_KINDS, "digits", "ip6", "iban"), 0)
        self.local_at = 0  # local parts reach back to here at most
        self.authority = 0  # end of the latest stretch that may be user:password
        self.run = (0, 0, 0, 0)  # the latest run of a secret: begin and end of it, end of the secret, last place with a letter and a digit on
        self.key = (0, 0, 0, 0)  # the latest key: begin and end of its run, end of the key, last place with four digits on

    def at_sign(self, at: int) -> None:
        text, start = self.text, at
        while start > self.local_at and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            self.base.append(("email", start, m.end()))
            self.local_at = m.end()
        else:
            self.local_at = max(self.local_at, at)  # a local part has no at-sign

    def digit(self, at: int) -> None:
        """The first digit of a run may begin an ip and a card; the rest of the run is skipped."""
        if at < self.done["digits"]:
            return
        text = self.text
        run = _DIGITS.match(text, at)
        self.done["digits"] = run.end()
        if at >= 2 and run.end() - at >= 2 and at - 2 >= self.done["iban"]:
            self.iban(at - 2)
        if at >= self.done["ip"] and run.end() < len(text) and text[run.end()] == "." and (m := _IP.match(text, at)):
            self.done["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                self.base.append(("ip", at, m.end()))
        if at >= self.done["card"] and (m := _NUMBER.match(text, at)):
            self.done["card"] = m.end()
            if m.end() - at >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    self.base.append(("card", at, m.end()))
                elif len(digits) > 16 or len(m[0]) > len(digits):
                    self.cards_within(at, m[0])

    def iban(self, start: int) -> None:
        """An account number of its country's length that stands alone; single spaces may part it."""
        text = self.text
        length = IBAN_LENGTHS.get(text[start : start + 2])
        if not length or (start and text[start - 1].isalnum()) or not (m := _IBAN.match(text, start, start + 2 * length)):
            return
        at = taken = 0
        for at, c in enumerate(m[0], 1):
            taken += c != " "
            if taken == length:
                break
        stop = start + at
        if taken == length and not (stop < len(text) and text[stop].isalnum()) and mod97(m[0][:at].replace(" ", "")):
            self.added.append(("iban", start, stop))
            self.done["iban"] = stop

    def colon(self, at: int) -> None:
        """The run of hexadecimal digits and colons around a colon, if it is an address."""
        if at < self.done["ip6"]:
            return
        text, start = self.text, at
        while start > self.done["ip6"] and text[start - 1] in _HEX:
            start -= 1
        stop = self.done["ip6"] = _IP6.match(text, at).end()
        run = text[start:stop]
        if not 6 <= len(run) <= 39 or (start and (text[start - 1].isalnum() or text[start - 1] in "_.")) or (stop < len(text) and (text[stop].isalnum() or text[stop] in "_.")):
            return
        if run.count(":") >= 2 and sum(c != ":" for c in run) >= 4 and not run.isalpha() and any(c.isdigit() for c in run):
            try:
                ipaddress.IPv6Address(run)
            except ValueError:
                return
            self.added.append(("ip6", start, stop))

    def cards_within(self, at: int, run: str) -> None:
        """Cards in a run of digits that isn't one itself: a group that stands alone, or four groups of four."""
        groups = [(g.start(), g.end()) for g in _DIGITS.finditer(run)]
        for i, (start, end) in enumerate(groups):
            four = groups[i : i + 4]
            if 13 <= end - start <= 19 and end - start < len(run) and luhn(run[start:end]):
                self.added.append(("card", at + start, at + end))
            elif len(groups) > 4 and len(four) == 4 and all(b - a == 4 for a, b in four) and luhn("".join(run[a:b] for a, b in four)):
                self.added.append(("card", at + start, at + four[-1][1]))

    def plus(self, at: int) -> None:
        if at < self.done["phone"] or not _is_digit(self.text, at + 1):
            return
        if m := _PHONE.match(self.text, at + 2):
            end = m.end()
            while end > at + 3 and not _is_digit(self.text, end - 1):
                end -= 1
            if end > at + 3:
                self.done["phone"] = end
                if 9 <= (n := sum("0" <= c <= "9" for c in self.text[at:end])) <= 15:
                    self.base.append(("phone", at, end))
                elif n > 15 and (m := _GROUPED.match(self.text, at)) and not _is_digit(self.text, m.end()) and 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    self.added.append(("phone", at, m.end()))  # other numbers follow

    def scheme(self, end: int) -> None:
        text = self.text
        if end >= self.authority:
            self.authority = _AUTHORITY.match(text, end).end()
        stop = self.authority
        if stop < len(text) and text[stop] == "@" and (m := _USER.match(text, end, stop)) and (m.end() == stop or text[m.end()] == ":"):
            self.added.append(("url_user", end, stop))

    def key_from(self, start: int) -> tuple[int, int]:
        """The end of the key whose run holds ``start``, and the last place from which it has four digits (-1: none)."""
        text = self.text
        if not self.key[0] <= start < self.key[1]:
            stop = end = _KEY.match(text, start).end()
            while text[end - 1] in "_-":
                end -= 1
            at, digits = end, 0
            while digits < 4 and at > start:
                at -= 1
                digits += text[at].isdigit()
            self.key = (start, stop, end, at if digits == 4 else -1)
        return self.key[2:]

    def run_from(self, start: int) -> tuple[int, int]:
        """The end of the run that holds ``start``, and the last place from which it has a letter and a digit (-1: none)."""
        if not self.run[0] <= start < self.run[1]:
            m = _RUN.match(self.text, start)
            if not m:
                return start, -1
            run = m[0].rstrip("_-.?)]}")
            letter = next((i for i in range(len(run) - 1, -1, -1) if run[i].isalpha()), -1)
            digit = next((i for i in range(len(run) - 1, -1, -1) if run[i].isdigit()), -1)
            self.run = (start, m.end(), start + len(run), start + min(letter, digit) if min(letter, digit) >= 0 else -1)
        return self.run[2:]

    def cue(self, start: int, end: int) -> None:
        text = self.text
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            return
        if text[start:end].lower() in SECRETS and (m := _SECRET.match(text, end)):
            stop, last = self.run_from(m.end())
            if stop - m.end() >= 6 and m.end() <= last:
                self.added.append(("account", m.end(), stop))
                return
        if m := _CUED.match(text, end):
            stop, four = self.key_from(m.start(1))
            if m.start(1) <= four:
                self.added.append(("account", m.start(1), stop))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and added spans that no base span overlaps."""
    parser = Parser(text)
    for last, word in automaton().iter(text):
        if word == "@":
            parser.at_sign(last)
        elif word == "+":
            parser.plus(last)
        elif word == ":":
            parser.colon(last)
        elif len(word) == 1:
            parser.digit(last)
        elif word in SCHEMES:
            parser.scheme(last + 1)
        else:
            parser.cue(last + 1 - len(word), last + 1)
    base = sorted(parser.base, key=lambda s: (ORDER[s[0]], s[1]))
    if not parser.added:
        return base, []
    taken: dict[str, tuple[list[int], list[int]]] = {}  # begins and ends by origin and kind, each in order and disjoint
    for kind, start, end in base:
        begins, ends = taken.setdefault(f"base {kind}", ([], []))
        begins.append(start)
        ends.append(end)
    added = []
    for kind, start, end in sorted(set(parser.added), key=lambda s: (ORDER[s[0]], s[1], -s[2])):
        if not any((i := bisect_left(begins, end)) and ends[i - 1] > start for begins, ends in taken.values()):
            added.append((kind, start, end))
            begins, ends = taken.setdefault(kind, ([], []))
            begins.append(start)
            ends.append(end)
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, max(1, whole.num_rows), SLICE)):
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text or "")
                kinds = [s[0] for s in base]
                both = sorted(base + added, key=lambda s: (ORDER[s[0]], s[1]))
                rows.append((*map(kinds.count, BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earliest, then longest, counts."""
    base, added = find(text)
    out, at = [], 0
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        elif end > at:
            pass
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with personal data in ``text_col`` replaced; null stays null, other columns pass as they are."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts = [t if t is None else redact_text(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))
            release()

    at = docs.columns.index(text_col)
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name may hold a dot
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
