"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass their own validation (check digits, ranges, the calendar) are permuted by a keyed Feistel
network over exactly the values their format can hold: the pseudonym is again valid, has the same length and
separators, and equal values get equal pseudonyms in every document, so records stay linked. Nothing is stored; who
has the key can invert it.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import logging
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold.llm.common import map_arrow, table

ROUNDS = 8
KEY_SETTING = "spark.lexfold.pii.key"  # the session setting that op7 takes its key from
DEMO_KEY = b"set a secret key of your own in production"

BOX = r"[\w\u0300-\u036f.%+-]"  # characters of a mailbox, of any script
# Where each kind can begin, in order of preference at the same start.
PATTERN = re.compile(
    rf"""(?u:(?<!{BOX})(?<!{BOX}')(?P<email>{BOX}+(?:'{BOX}+)*@(?:[^\W_](?:[^\W_]|[\u0300-\u036f-])*\.)+(?:xn--[A-Za-z0-9-]+|[^\W\d_]{{2,}})(?![\w-])))"""
    r"""|(?<![A-Za-z0-9])(?P<iban>[A-Za-z]{2}\d{2}(?:\x20?[A-Za-z0-9]{4}){2,7}(?:\x20?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])"""
    r"""|(?<![A-Za-z0-9.+-])(?:"""
    r"""(?P<ip>(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![A-Za-z0-9]|\.\d))"""
    r"""|(?P<iso>\d{4}-\d{1,2}-\d{1,2}(?=T\d|(?![A-Za-z0-9-])))"""
    r"""|(?P<dmy>\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![A-Za-z0-9]))"""
    r"""|(?P<ssn>\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-]))"""
    r"""|(?P<abroad>00[1-9]\d{0,2}[\x20./-](?:\(\d{2,4}\)|\d{2,4})(?:[\x20.-]?\d{2,4}){2,3}(?![A-Za-z0-9]))"""
    r"""|(?P<card>\d(?:[\x20-]?\d){12,}(?![A-Za-z0-9])))"""
    r"""|(?<![A-Za-z0-9])(?P<phone>(?:\+\d{1,3}[\x20.-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[\x20.-]?\d{2,4}){2,3}(?![A-Za-z0-9])|\(\d{3}\)\x20?\d{3}-\d{4}(?![A-Za-z0-9]))""",
    re.A,
)
# A run of digit groups ends where a date or number of its own format begins.
WITHIN = re.compile(r"(?<=\x20)(?:(?P<iso>\d{4}-\d{1,2}-\d{1,2}(?=T\d|(?![A-Za-z0-9-])))|(?P<ssn>\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])))", re.A)
KINDS = ("email", "iban", "ip", "iso", "dmy", "ssn", "abroad", "card", "phone")
YEARS = range(1500, 2100)  # of a number that is taken for a date
ERA = 200  # years of which a date stays in its own


@lru_cache(maxsize=24)
def days_like(era: int, month: int, day: int) -> list[datetime.date]:
    """Days of an era of like format: months below the tenth or not, days below the tenth, up to the twelfth, or later.

    Dates are permuted within these, so that one that can only be read day or month first stays so, one written
    without zeros keeps its length, and each is linked to the same date in every other format.
    """
    months = (range(1, 10), range(10, 13))[month]
    days = lambda y, m: (range(1, 10), range(10, 13), range(13, calendar.monthrange(y, m)[1] + 1))[day]
    return [datetime.date(y, m, d) for y in range(era, era + ERA) for m in months for d in days(y, m)]


class Feistel:
    """Keyed permutation of range(n), for any n."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, tweak: str, k: int, x: int, n: int) -> int:
        wide = (n.bit_length() + 7) // 8 + 8
        out = b""
        while len(out) < wide:
            out += hashlib.blake2b(f"{tweak}|{k}|{x}|{len(out)}".encode(), key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(out[:wide], "big") % n

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # walk along the cycle until within range
            left, right = divmod(x, b)
            for k in range(0, ROUNDS, 2):
                left = (left + self._f(tweak, k, right, a)) % a
                right = (right + self._f(tweak, k + 1, left, b)) % b
            x = left * b + right
            if x < n:
                return x

    def invert(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(tweak, k + 1, left, b)) % b
                left = (left - self._f(tweak, k, right, a)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


@lru_cache(maxsize=None)  # a code point each
def _alphabet(c: str) -> str:
    """What c may become: digits, letters of its case, or beyond ASCII what is of its category in its block of 256."""
    for known in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"):
        if c in known:
            return known
    first = ord(c) & ~255
    return "".join(x for x in map(chr, range(max(first, 128), first + 256)) if unicodedata.category(x) == unicodedata.category(c) and x.isalnum())


def _radices(s: str) -> tuple[int, int]:
    """A string's number in mixed radix, by the alphabet of each character, and how many there are of its form."""
    x, n = 0, 1
    for c in s:
        letters = _alphabet(c)
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    return x, n


def _like(s: str, x: int) -> str:
    out = []
    for c in reversed(s):
        letters = _alphabet(c)
        x, d = divmod(x, len(letters))
        out.append(letters[d])
    return "".join(reversed(out))


def _refill(form: str, chars: str) -> str:
    """form with its letters and digits replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _shape(s: str) -> str:
    ascii_ = {"0": "9", "A": "A", "a": "a"}
    return "".join(ascii_.get(first := _alphabet(c)[0], first) for c in s)


Step = Callable[[int, int, str], int]


def _text(step: Step, kind: str, s: str) -> str:
    x, n = _radices(s)
    return _like(s, step(x, n, f"{kind}:{_shape(s)}"))


def pseudonym(kind: str, value: str, step: Step) -> str | None:
    """The pseudonym of a value of this kind, or None when it doesn't validate. step: Feistel.permute or .invert."""
    plain = re.sub(r"[^A-Za-z0-9]", "", value)
    if kind == "email":
        local, _, host = value.partition("@")
        bare = "".join(filter(str.isalnum, local))
        return bare and f"{_refill(local, _text(step, kind, bare))}@{host}" or None
    if kind == "card":
        if not (13 <= len(plain) <= 19 and plain[0] in "23456" and luhn_digit(plain[:-1]) == plain[-1]):
            return None
        if plain[0] == "2":  # 16 digits that begin with 2221 to 2720
            low, n = 2221 * 10**11, 500 * 10**11
            if len(plain) != 16 or not 0 <= int(plain[:-1]) - low < n:
                return None
            body = str(low + step(int(plain[:-1]) - low, n, "card2"))
            return _refill(value, body + luhn_digit(body))
        body = plain[0] + _text(step, f"card{plain[0]}", plain[1:-1])
        return _refill(value, body + luhn_digit(body))
    if kind == "iban":
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = _text(step, f"iban{plain[:2]}", plain[4:])
        return _refill(value, plain[:2] + iban_check(plain[:2], rest) + rest)
    if kind == "ip":
        parts = value.split(".")  # each part keeps its number of digits
        first, size = zip(*(((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts))
        x = 0
        for p, low, n in zip(parts, first, size):
            x = x * n + int(p) - low
        x, out = step(x, math.prod(size), "ip" + "".join(str(len(p)) for p in parts)), []
        for low, n in zip(first[::-1], size[::-1]):
            x, d = divmod(x, n)
            out.append(str(low + d))
        return ".".join(out[::-1])
    if kind in ("iso", "dmy"):
        parts = re.findall(r"\d+", value)
        y, m, d = parts if kind == "iso" else parts[::-1]
        us = kind == "dmy" and int(m) > 12 >= int(d)  # month first
        if us:
            m, d = d, m
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None
        if day.year not in YEARS:
            return None
        alike = days_like(day.year // 100 * 100 - (day.year // 100 + 1) % 2 * 100, int(day.month > 9), int(day.day > 9) + int(day.day > 12))
        to = alike[step(bisect.bisect_left(alike, day), len(alike), f"{alike[0]:%Y%m%d}")]
        y, m, d = str(to.year), str(to.month).zfill(len(m)), str(to.day).zfill(len(d))
        return _refill(value, y + m + d if kind == "iso" else m + d + y if us else d + m + y)
    if kind == "ssn":
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        if not valid(plain):
            return None
        while not valid(plain := _text(step, kind, plain)):
            pass
        return _refill(value, plain)
    if kind == "abroad":  # as with +
        new = pseudonym("phone", "+" + value[2:], step)
        return new and "00" + new[1:]
    if kind == "phone":
        if not 9 <= len(plain) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})", value)
        if country and country[1].startswith("1"):
            head = "1"
        else:
            head = country[1] if country else ""
        tail = plain[len(head) :]
        tail = _text(step, f"phone{head}", tail)
        return _refill(value, head + tail)
    raise ValueError(kind)


def _cards(text: str, start: int, end: int, step: Step) -> tuple[list[tuple[int, int, str]], int]:
    """start, end and pseudonym of the cards in a run of digit groups, and where to search on.

    A card may stand beside other numbers, so all spans of whole groups are tried, the longest first. The last group
    is left to the search when no card takes it: a date, address or mailbox may begin there.
    """
    for m in WITHIN.finditer(text, start, min(len(text), end + 1)):
        if pseudonym(m.lastgroup, m[0], step) is not None:
            end = m.start()
            break
    else:
        m = None
    groups = [g.span() for g in re.finditer(r"[0-9]+", text[start:end])]
    spans = []
    for i, (a, _) in enumerate(groups):
        digits = 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 13:
                spans.append((-digits, i, j, start + a, start + groups[j][1]))
    taken, found = [False] * len(groups), []
    for _, i, j, a, b in sorted(spans):
        if not any(taken[i : j + 1]) and (new := pseudonym("card", text[a:b], step)) is not None:
            taken[i : j + 1] = [True] * (j + 1 - i)
            found.append((a, b, new))
    after = end if m or taken[-1] or len(groups) == 1 else start + groups[-1][0]
    return sorted(found), after


def rewrite(text: str, step: Step, known: dict[tuple[str, str], str | None] | None = None) -> tuple[str, list[tuple[str, int, int, str]]]:
    """text with pseudonyms, and (kind, start, end, value) of what was replaced, in code points of the original."""
    known = {} if known is None else known
    out, spans, last, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        if kind == "card":
            found, at = _cards(text, m.start(kind), m.end(kind), step)
            for start, end, new in found:
                out += [text[last:start], new]
                spans.append((kind, start, end, text[start:end]))
                last = end
            continue
        value = m[kind]
        if (kind, value) not in known:
            if len(known) > 100_000:
                known.clear()
            known[kind, value] = pseudonym(kind, value, step)
        new = known[kind, value]
        if new is None and kind == "iban":  # words that follow may have been taken into it
            ends = [x.start() for x in re.finditer(r"\x20", value)]
            value, new = next(((value[:e], x) for e in reversed(ends) if (x := pseudonym(kind, value[:e], step))), (value, None))
        if new is None:
            at = m.start() + len(value) if kind not in ("iban", "abroad") else m.start() + 4
            continue
        start = m.start(kind)
        out += [text[last:start], new]
        spans.append(("phone" if kind == "abroad" else kind, start, start + len(value), value))
        last = at = start + len(value)
    return "".join([*out, text[last:]]) if out else text, spans


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default) with text replaced, then pii_spans: array of kind, start, end.

    Null text stays null with no spans. Rows are rewritten one by one, repeated ones alike; an empty table stays
    empty; columns of other names pass through. Where one is named pii_spans, underscores are added to the name of
    the last column. Hosts of addresses stay as they are.
    """
    columns = docs.columns if columns is None else columns
    name = "pii_spans"
    while any(c.lower() == name for c in columns):
        name += "_"
    rows = docs.select(*(F.col(f"`{c}`") for c in columns))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(span))])
    where = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, known = Feistel(key).permute, {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, spans = [], []
            for t in b.column(where).to_pylist():
                new, found = (None, []) if t is None else rewrite(t, step, known)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found])
            out = [pa.array(texts, pa.string()) if i == where else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(spans, kind)], [*columns, name])

    return map_arrow(rows, run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local["):
        logging.getLogger(__name__).warning("%s is not set: pseudonyms are made with the key of the source code, with which anyone can undo them", KEY_SETTING)
    rows = pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else DEMO_KEY, columns=["doc_id", "text"])
    kind = F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"), F.array_join(kind, ",").alias("spans"))
