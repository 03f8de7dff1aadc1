"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network.

A value is taken as digits of mixed radix, whatever its format allows at each place, and split in two
halves; rounds add a keyed hash of one half to the other, modulo that half's size. This permutes the
format's values: equal values have equal pseudonyms in all documents, different ones stay different.
Values that fail their kind's check (Luhn, mod 97, a date of the calendar, octets up to 255) are left.

Kinds: payment cards (Luhn kept), phone numbers, IPv4 addresses, dates, US social security numbers,
IBANs (check digits kept right), e-mail local parts, access keys and hexadecimal secrets. An e-mail's host stays
in clear, so that documents can still be grouped by provider; hosts of one person's own name them.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import sys
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.kernel import utf8
from sessionlake.llm.shared import columns
from sessionlake.session import ship

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KINDS = ("card", "phone", "ip", "date", "ssn", "iban", "email", "key", "secret")


def permute(value: int, left: int, right: int, key: bytes, kind: str) -> int:
    """A keyed permutation of the numbers below left * right."""
    a, b = divmod(value, right)
    for k in range(ROUNDS):
        part, size = (b, left) if k % 2 == 0 else (a, right)
        digest = hashlib.blake2b(f"{kind}|{left}|{right}|{k}|{part}".encode(), key=key, digest_size=32).digest()
        if k % 2 == 0:
            a = (a + int.from_bytes(digest, "big")) % size
        else:
            b = (b + int.from_bytes(digest, "big")) % size
    return a * right + b


def permute_text(text: str, key: bytes, kind: str, alphabets: Callable[[str], str] | None = None) -> str:
    """Permutes the letters and digits of text, each within its own class; other characters stay."""
    alphabets = alphabets or (lambda c: _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "")
    places = [(i, s) for i, c in enumerate(text) if (s := alphabets(c))]
    if not places:
        return text
    value, sizes = 0, [len(s) for _, s in places]
    for i, s in places:
        value = value * len(s) + s.index(text[i])
    half = len(sizes) // 2
    left = right = 1
    for s in sizes[:half]:
        left *= s
    for s in sizes[half:]:
        right *= s
    value = permute(value, left, right, key, f"{kind}|{sizes}")
    out = list(text)
    for i, s in reversed(places):
        value, d = divmod(value, len(s))
        out[i] = s[d]
    return "".join(out)


def _luhn(digits: str) -> int:
    """What the digit sum lacks to be a multiple of 10 when a last digit is put behind."""
    return -sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or _luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = permute_text(digits[:-1], key, "card")
    while body[0] == "0":  # a walk along the permutation's cycle, back to numbers that begin as cards do
        body = permute_text(body, key, "card")
    new = iter(body + str(_luhn(body)))
    return re.sub(r"\d", lambda _: next(new), text)


#: Least and most digits of national numbers, without the country's code; of other countries 7 to 12.
_NATIONAL = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9),
    "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 11), "51": (8, 9), "52": (10, 10), "53": (8, 8), "54": (10, 11),
    "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10),
    "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10),
}


def _country(text: str) -> str:
    """The country's code, however the digits behind it are grouped."""
    digits = re.match(r"\+(\d{1,3})", text)[1]
    return next((digits[:n] for n in (1, 2) if digits[:n] in _NATIONAL), digits)


def _phone(text: str, key: bytes) -> str | None:
    at = 1 + len(_country(text)) if text[0] == "+" else 0
    if not 7 <= sum(c.isdigit() for c in text[at:]) <= 15:
        return None
    return text[:at] + permute_text(text[at:], key, "phone")


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 16, 1 << 16, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


@cache
def _days() -> tuple[dict[int, tuple[bool, int]], dict[bool, list[int]]]:
    """Days in two classes, those whose day of the month could be a month and the others: class and number of each day, and each class's days."""
    numbers, days = {}, {True: [], False: []}
    for n in range(_FIRST, _LAST + 1):
        early = date.fromordinal(n).day <= 12
        numbers[n] = early, len(days[early])
        days[early].append(n)
    return numbers, days


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"\D", text)
    year_first = len(parts[0]) == 4
    y, m, d = map(int, parts if year_first else reversed(parts))
    swapped = not year_first and m > 12 >= d  # month before day
    try:
        day = date(y, d, m) if swapped else date(y, m, d)
    except ValueError:
        return None
    numbers, days = _days()
    if day.toordinal() not in numbers:
        return None
    # Each class is permuted within itself, so a day has one pseudonym in all spellings, and month-first ones stay readable as such.
    early, value = numbers[day.toordinal()]
    side = isqrt(len(days[early]) - 1) + 1
    value = permute(value, side, side, key, f"date|{early}")
    while value >= len(days[early]):
        value = permute(value, side, side, key, f"date|{early}")
    new = date.fromordinal(days[early][value])
    sep = re.search(r"\D", text)[0]
    order = (new.year, new.month, new.day) if year_first else (new.month, new.day, new.year) if swapped else (new.day, new.month, new.year)
    width = 1 if any(len(p) == 1 for p in parts) else 2  # parts without a leading 0 stay without
    return sep.join(f"{x:04d}" if x > 31 else f"{x:0{width}d}" for x in order)


def _ssn(text: str, key: bytes) -> str | None:
    bad = lambda t: t[:3] in ("000", "666") or t[0] == "9" or t[4:6] == "00" or t[7:] == "0000"
    if bad(text):
        return None
    new = permute_text(text, key, "ssn")
    while bad(new):
        new = permute_text(new, key, "ssn")
    return new


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: Characters of a country's IBANs.
_IBANS = dict(zip("NO BE DK FI NL SI AT EE LT LU LV HR CH LI DE GB IE BG RS ME BA AE IL CZ SK ES SE TR RO PL HU PT FR IT SM GR CY MC SA QA".split(), map(int, "15 16 18 18 18 19 20 20 20 20 21 21 21 21 22 22 22 22 22 22 20 23 23 24 24 24 24 26 24 28 28 25 27 27 27 27 28 27 24 29".split()), strict=True))


def _iban(text: str, key: bytes) -> str | None:
    plain = re.sub(r"[ -]", "", text)
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_text(plain[4:], key, f"iban{plain[:2]}")
    new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    return re.sub(r"[A-Z0-9]", lambda _: next(new), text)


def _email(text: str, key: bytes) -> str | None:
    local, _, host = text.rpartition("@")
    return f"{permute_text(local, key, 'email')}@{host}"


def _key(text: str, key: bytes) -> str | None:
    return text[:4] + permute_text(text[4:], key, "key", lambda c: _DIGITS + _UPPER)


def _secret(text: str, key: bytes) -> str | None:
    if not re.search(r"\d", text) or not re.search(r"[a-f]", text, re.I):
        return None
    hexes = _DIGITS + ("ABCDEF" if re.search(r"[A-F]", text) else "abcdef")
    return permute_text(text, key, "secret", lambda c: hexes) if set(text) <= set(hexes) else None


_MAKE = dict(zip(KINDS, (_card, _phone, _ip, _date, _ssn, _iban, _email, _key, _secret), strict=True))
_PATTERNS = dict(
    email=r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    key=r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    iban=r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    secret=r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])",
    ip=r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    ssn=r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
    date=r"(?<![\w/.-])(?:\d{4}-\d\d-\d\d(?=T\d\d)|(?:\d{4}-\d\d?-\d\d?|\d{4}/\d\d?/\d\d?|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4}|\d\d?-\d\d?-\d{4})(?![\w/-]|\.\d))",
    phone=r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    card=r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
)
#: In this order: the first kind that fits and whose check holds has the text.
PATTERN = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PATTERNS.items()))
_ORDER = tuple(_PATTERNS)
_ALONE = {kind: re.compile(p) for kind, p in _PATTERNS.items()}
_REGULAR = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}


def _regular(text: str) -> bool:
    """Whether a card is written without groups or in the usual ones."""
    groups = tuple(map(len, re.split(r"[ -]", text)))
    return len(groups) == 1 or groups in _REGULAR


def _readings(kind: str, text: str) -> list[str]:
    """The match and its parts up to a separator, the likeliest first: a pattern takes in a number that follows."""
    if kind not in ("card", "phone", "iban"):
        return [text]
    parts = [text, *(text[: m.start()] for m in reversed(list(re.finditer(r"[ .-]", text))))]
    if kind == "card":
        return sorted(parts, key=lambda p: not _regular(p))
    if kind == "iban":
        return sorted(parts, key=lambda p: len(re.sub(r"[ -]", "", p)) != _IBANS.get(p[:2], 0))
    if text[0] != "+":
        return [text]
    code = _country(text)
    least, most = _NATIONAL.get(code, (7, 12))
    digits = lambda p: sum(c.isdigit() for c in p.replace("(0)", "")) - len(code)
    return [*(p for p in parts if least <= digits(p) <= most), text]


def _value(text: str, m: re.Match, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value that begins where m does: the first reading of the first kind whose check holds."""
    for kind in _ORDER[_ORDER.index(m.lastgroup) :]:
        own = m if kind == m.lastgroup else _ALONE[kind].match(text, m.start())
        for part in _readings(kind, own[0]) if own else ():
            new = _MAKE[kind](part, key)
            if new is not None:
                return kind, m.start() + len(part), new
    return None


_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def _in_script(new: str, old: str) -> str:
    """A pseudonym in the digits of the script that the value is written in; where scripts are mixed, digit by digit, further ones as the last."""
    zeros = [ord(c) - unicodedata.decimal(c) for c in old if c.isdecimal()]
    at, out = 0, []
    for c in new:
        if c.isdecimal():
            c, at = chr(zeros[min(at, len(zeros) - 1)] + int(c)), at + 1
        out.append(c)
    return "".join(out)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each value found in it.

    Decimal digits of any script are read as what they count, so a value has the same pseudonym in all of them, and written in their own script.
    """
    if _OTHER_DIGIT.search(text):
        plain = _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)  # as long as the text
        spans = [(kind, a, b, _in_script(new, text[a:b])) for kind, a, b, new in _values(plain, key)]
    else:
        spans = _values(text, key)
    out, at = [], 0
    for _, start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return ("".join([*out, text[at:]]) if spans else text), spans


def _values(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    spans, pos = [], 0
    while m := PATTERN.search(text, pos):
        value = _value(text, m, key)
        if value is None:
            pos = m.start() + 1
            while pos < m.end() and text[pos].isalnum() and text[pos - 1].isalnum():
                pos += 1
            continue
        kind, pos, new = value
        spans.append((kind, m.start(), pos, new))
    return spans


_HINT = np.zeros(256, bool)
_HINT[[*range(0x30, 0x3A), 0x40]] = True


@cache
def _digit_leads() -> np.ndarray:
    """Whether digits of other scripts begin with a byte."""
    out = np.zeros(256, bool)
    out[[chr(c).encode()[0] for c in range(0x80, sys.maxunicode + 1) if chr(c).isdecimal()]] = True
    return out


def rows_with_hints(column: pa.Array) -> np.ndarray:
    """Rows whose text has a decimal digit or @, without which no kind matches."""
    data, offsets = utf8(column)

    def has(marked: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(marked[data])
        return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])

    plain = has(_HINT)
    for row in np.flatnonzero(has(_digit_leads()) & ~plain).tolist():
        plain[row] = _OTHER_DIGIT.search(column[row].as_py()) is not None
    return np.flatnonzero(plain)


def pseudonymise_documents(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with pseudonyms in text_col; other columns as they are. With counts, a column pii_<kind> for each kind comes behind.

    A null text stays null and an empty one empty; texts without such values keep every byte. Each row is
    treated by itself: repeated rows give repeated rows, an empty table gives none. A column of docs named
    like a count is replaced. One scan, no shuffle; memory is a batch of rows.
    """
    ship(docs.sparkSession)
    names = [f"pii_{k}" for k in KINDS]
    docs = docs.drop(*names) if counts else docs
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(where)
            number = np.zeros((len(KINDS), batch.num_rows), np.int64)
            mask, new = np.zeros(batch.num_rows, bool), []
            for row in rows_with_hints(column).tolist():
                text, spans = pseudonymise(column[row].as_py(), key)
                if spans:
                    mask[row] = True
                    new.append(text)
                    for kind, *_ in spans:
                        number[KINDS.index(kind), row] += 1
            out = list(batch.columns)
            if new:
                out[where] = pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
            yield pa.RecordBatch.from_arrays(out + ([pa.array(x) for x in number] if counts else []), names=batch.schema.names + (names if counts else []))

    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.LongType()) for n in names] * counts)
    return docs.mapInArrow(run, schema)


KEY_CONF = "spark.sessionlake.pii.key"
_own_keys: dict[str, bytes] = {}


def secret_key(spark: SparkSession) -> bytes:
    """The key in the session's spark.sessionlake.pii.key. Where none is set, one drawn for this Spark application.

    Values stay linked within what one key has written. A drawn key is kept nowhere, so nobody can undo its pseudonyms,
    and another application's pseudonyms differ; set the key, as a secret, where they must agree.
    """
    said = spark.conf.get(KEY_CONF, None)
    if said:
        return hashlib.blake2b(said.encode(), digest_size=32).digest()
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise_documents(docs, secret_key(spark), counts=True)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: the same rows and columns, with pseudonyms in text and, where there is such a column, n_chars as the new text has.

    A null text stays null and keeps its n_chars; repeated rows stay repeated; an empty table gives none; other columns stay as they are.
    """
    out = pseudonymise_documents(docs, secret_key(spark))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))).select(*columns(*docs.columns))
