"""Format-preserving pseudonyms for validated numbers, dates and addresses.

A value is found by its shape, validated (Luhn and IBAN check digits, SSN and octet ranges, the calendar)
and replaced by the image of a keyed Feistel permutation within its own format. Separators, lengths and
check digits stay right, so the pseudonym is again a valid value of the same kind; equal values have equal
pseudonyms in all documents, however they are punctuated, and different values have different ones. A date
keeps its pseudonym in all its forms: the day is permuted under one key among the days whose month and day
take as many digits (days of 10 to 12, which can be read as months, apart from later ones). With the key
``restore`` inverts the replacement. Where several numbers stand a blank or hyphen apart, cards in
one group or grouped as printed are read first; other readings rest on check digits alone, so there a
pseudonym may by chance read as another span, and ``restore`` then isn't exact.

Kinds: card (13 to 19 digits, Luhn), iban, ssn, phone (international, country code kept), ipv4, email (the
domain stays, the local part is permuted), date (yyyy-mm-dd, d.m.yyyy, m/d/yyyy and, where the first number
is over 12, d/m/yyyy; from 1900 to 2099, and the pseudonym lies there too). Numbers that fail validation
are left alone.

Defined cases: null texts stay null, empty ones empty; rows are treated one by one, so repeated rows get
equal results; null ids are carried; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec
from .common import narrow

ROUNDS = 8

_SHAPES = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<!\d)(?P<iso>\d{4}-\d{2}-\d{2})(?!\d|-\d)"
    r"|(?<![\d.])(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?<![\d.])(?P<dots>\d{1,2}\.\d{1,2}\.\d{4})(?!\.?\d)"
    r"|(?<![\d/])(?P<slash>\d{1,2}/\d{1,2}/\d{4})(?!/?\d)"
    r"|(?<![\d+])(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\d)"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?!-?\d)"
    r"|(?<!\d)(?P<card>\d(?:[ -]?\d){12,18})"
)
_RUN = re.compile(r"\d+(?:[ -]\d+)*")
_GROUP = re.compile(r"\+?[A-Za-z0-9]+")
#: how cards are grouped when printed; a number so written is a card before other readings are tried
_PRINTED = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN = {c: n for n, names in _LENGTHS.items() for c in names.split()}
#: calling codes of one and of two digits; all others have three
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_FIRST = date(1900, 1, 1).toordinal()
_DAYS = date(2099, 12, 31).toordinal() - _FIRST + 1


class Cipher:
    """Keyed permutations of digit strings and number ranges."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key, self.inverse = key if len(key) <= 64 else hashlib.blake2b(key).digest(), inverse

    def _round(self, kind: str, n: int, other: tuple[int, ...], modulus: int) -> int:
        mac = hashlib.blake2b(f"{kind}|{n}|{other}".encode(), key=self.key, digest_size=24)
        return int.from_bytes(mac.digest(), "big") % modulus

    def symbols(self, xs: list[int], radix: int, kind: str) -> list[int]:
        """A permutation of the strings of this length over 0..radix-1."""
        n, sign = len(xs), -1 if self.inverse else 1
        if n == 0:
            return []
        if n == 1:
            return [(xs[0] + sign * self._round(kind, 0, (radix,), radix)) % radix]
        half = n // 2
        parts = [_number(xs[:half], radix), _number(xs[half:], radix)]
        size = [half, n - half]
        for r in reversed(range(ROUNDS)) if self.inverse else range(ROUNDS):
            a, modulus = r % 2, radix ** size[r % 2]
            parts[a] = (parts[a] + sign * self._round(kind, r, (n, radix, parts[1 - a]), modulus)) % modulus
        return _digits(parts[0], radix, half) + _digits(parts[1], radix, n - half)

    def below(self, x: int, size: int, kind: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """A permutation of the valid numbers of 0..size-1, by walking the cycle of a larger one."""
        width = max(2, len(str(size - 1)))
        while True:
            x = _number(self.symbols(_digits(x, 10, width), 10, kind), 10)
            if x < size and valid(x):
                return x


def _number(xs: list[int], radix: int) -> int:
    out = 0
    for x in xs:
        out = out * radix + x
    return out


def _digits(x: int, radix: int, width: int) -> list[int]:
    out = []
    for _ in range(width):
        x, r = divmod(x, radix)
        out.append(r)
    return out[::-1]


def luhn(xs: list[int]) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(xs))) % 10 == 0


def _card(xs: list[int]) -> bool:
    return luhn(xs) and len(set(xs)) > 1


def _cards(run: str) -> dict[int, int]:
    """Start and end of the cards in a run of digit groups, each of whole groups.

    First the groups that are printed as cards are, or that are one by themselves; then, between them and
    from left to right, the longest valid number from each group on.
    """
    at = [m.span() for m in re.finditer(r"\d+", run)]
    sizes, taken, out = [b - a for a, b in at], [False] * len(at), {}

    def take(i: int, k: int) -> bool:
        a, b = at[i][0], at[i + k - 1][1]
        if any(taken[i : i + k]) or not _card([int(x) for x in run[a:b] if x.isdigit()]):
            return False
        taken[i : i + k] = [True] * k
        out[a] = b
        return True

    for i, n in enumerate(sizes):
        if not (13 <= n <= 19 and take(i, 1)):
            any(sizes[i : i + len(p)] == p and take(i, len(p)) for p in _PRINTED)
    for i in range(len(at)):
        fits, total = [], 0
        for k, n in enumerate(sizes[i : i + 19], 1):
            total += n
            if total > 19 or taken[i + k - 1]:
                break
            if total >= 13:
                fits.append(k)
        any(take(i, k) for k in reversed(fits))
    return out


def _iban(text: str, start: int, end: int) -> int:
    """The end of the IBAN at ``start``, of its country's length or else the longest valid one; -1 if there is none."""
    ends = [k for k in range(end, start, -1) if text[k - 1].isalnum() and not text[k : k + 1].isalnum()]
    for k in ends:
        flat = text[start:k].replace(" ", "")
        if len(flat) == _IBAN.get(flat[:2], len(flat)) and 15 <= len(flat) <= 34 and 2 <= int(flat[2:4]) <= 98 and _mod97(flat) == 1:
            return k
    return -1


def _fill(shape: str, chars: list[str]) -> str:
    """The shape with its letters and digits replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _moved(c: Cipher, n: int) -> date:
    """The image of a day among those whose month and day are written with as many digits."""

    def alike(x: int) -> tuple[bool, bool, bool]:
        d = date.fromordinal(_FIRST + x)
        return d.month < 10, d.day < 10, d.day > 12

    mine = alike(n)
    return date.fromordinal(_FIRST + c.below(n, _DAYS, "date", lambda x: alike(x) == mine))


def pseudonym(kind: str, s: str, c: Cipher) -> str | None:
    """The pseudonym of a value of this shape; None if it isn't valid."""
    xs = [int(x) for x in s if x.isdigit()]
    if kind == "card":
        if not _card(xs):
            return None
        head = c.symbols(xs[:-1], 10, "card")
        while len(set(head)) == 1 and luhn(head + head[:1]):
            head = c.symbols(head, 10, "card")
        return _fill(s, [str(x) for x in head + [next(k for k in range(10) if luhn([*head, k]))]])
    if kind == "iban":
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
            return None
        body = flat[4:]
        at = [k for k, x in enumerate(body) if x.isdigit()], [k for k, x in enumerate(body) if not x.isdigit()]
        out = list(body)
        for where, radix, base, tag in ((at[0], 10, 48, "iban9"), (at[1], 26, 65, "ibanA")):
            for k, x in zip(where, c.symbols([ord(body[k]) - base for k in where], radix, tag + flat[:2])):
                out[k] = chr(base + x)
        check = 98 - _mod97(flat[:2] + "00" + "".join(out))
        # 97 + 1 and 0 + 1 are one residue; the canonical check digits are 02 to 98, and only they are taken
        return _fill(s, [*flat[:2], *f"{check:02d}", *out]) if 2 <= int(flat[2:4]) <= 98 else None
    if kind == "ssn":
        ok = lambda v: v // 1_000_000 not in (0, 666) and v // 1_000_000 < 900 and v // 10_000 % 100 > 0 and v % 10_000 > 0
        v = _number(xs, 10)
        return _fill(s, list(f"{c.below(v, 10**9, 'ssn', ok):09d}")) if ok(v) else None
    if kind == "phone":
        code = next((k for k in (1, 2) if "".join(map(str, xs[:k])) in _CODES), 3)
        if not 8 <= len(xs) <= 15:
            return None
        return _fill(s, [str(x) for x in xs[:code] + c.symbols(xs[code:], 10, f"phone{xs[:code]}")])
    if kind == "ipv4":
        parts = s.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        v = c.below(_number([int(p) for p in parts], 256), 1 << 32, "ipv4")
        return ".".join(str(x) for x in _digits(v, 256, 4))
    if kind == "email":
        local, _, domain = s.partition("@")
        out = list(local)
        for radix, base, test in ((10, 48, str.isdigit), (26, 97, str.isalpha)):
            where = [k for k, x in enumerate(local) if test(x)]
            for k, x in zip(where, c.symbols([ord(local[k].lower()) - base for k in where], radix, f"email{radix}{domain.lower()}")):
                out[k] = chr(base + x) if not local[k].isupper() else chr(base + x).upper()
        return "".join(out) + "@" + domain
    p = [int(x) for x in re.split(r"[-./]", s)]
    if kind == "iso":
        n = _day(*p)
        return None if n is None else _moved(c, n).isoformat()
    swap = kind == "slash" and p[0] <= 12
    n = _day(p[2], p[0], p[1]) if swap else _day(p[2], p[1], p[0])
    if n is None:
        return None
    d = _moved(c, n)
    wide = [len(x) for x in re.split(r"[./]", s)[:2]]
    a = [d.month, d.day] if swap else [d.day, d.month]
    return ("." if kind == "dots" else "/").join([f"{a[0]:0{wide[0]}d}", f"{a[1]:0{wide[1]}d}", f"{d.year:04d}"])


def rewrite(text: str, c: Cipher) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds replaced in order."""
    kinds: list[str] = []
    out, done, at, cards, known = [], 0, 0, {}, 0
    while m := _SHAPES.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "card":
            if start >= known:
                run = _RUN.match(text, start)
                cards, known = {start + a: start + b for a, b in _cards(run.group()).items()}, run.end()
            end = cards.get(start, -1)
        elif kind == "iban":
            end = _iban(text, start, end)
        new = pseudonym(kind, text[start:end], c) if end >= 0 else None
        if new is not None:
            kinds.append(kind)
            out += [text[done:start], new]
            done = at = end
        elif kind in ("card", "iban", "phone"):  # what follows the first group may be a value
            at = _GROUP.match(text, start).end()
        else:
            at = end
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """doc_id, text, replaced: every document, its text with pseudonyms, and how many there are.

    Whoever has the key can invert the pseudonyms, so it belongs in no source and no table.
    """
    rows = narrow(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cipher(key, inverse)
        for b in batches:
            data, offsets = vec.flat(b.column(1))
            digits = np.flatnonzero((data >= 48) & (data < 58) | (data == 64))
            has = np.searchsorted(digits, offsets[1:]) > np.searchsorted(digits, offsets[:-1])
            texts, n = b.column(1).to_pylist() if has.any() else [], np.zeros(len(b), np.int64)
            for i in np.flatnonzero(has):
                texts[i], kinds = rewrite(texts[i], c)
                n[i] = len(kinds)
            column = pa.array(texts, b.column(1).type) if n.any() else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(n)], names=["doc_id", "text", "replaced"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, replaced long")


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, True)
