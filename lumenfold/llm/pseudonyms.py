"""Format-preserving pseudonyms for personal numbers and dates (operator 4).

Each finding is validated, mapped to an integer below the size of its format's domain,
permuted there by a keyed Feistel network with cycle walking, and written back in the same
format. Equal values so stay equal everywhere, without any table of them.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: balanced Feistel rounds on the next even number
    of bits, repeated until the result is below ``size``."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(_ROUNDS):
            digest = hashlib.blake2b(right.to_bytes(width, "big") + bytes([r]) + tweak, key=key, digest_size=max(8, width)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _card(m: str, key: bytes) -> str | None:
    digits = re.sub(r"[^0-9]", "", m)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, b"card%d" % len(digits))).zfill(len(digits) - 1)
    return _refill(m, body + luhn_digit(body))


def _ip(m: str, key: bytes) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = 0
    for p in parts:
        value = value * 256 + int(p)
    value = permute(value, 1 << 32, key, b"ip")
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _phone(m: str, key: bytes) -> str | None:
    digits = re.sub(r"[^0-9]", "", m)
    keep = len(digits) - 10 if m.startswith("+") and len(digits) > 10 else 0
    if not 7 <= len(digits) - keep <= 12:
        return None
    own = digits[keep:]
    return _refill(m, digits[:keep] + str(permute(int(own), 10 ** len(own), key, b"phone%d" % len(own))).zfill(len(own)))


def _social(m: str, key: bytes) -> str | None:
    area, group, serial = m.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    value = permute(value, len(areas) * 99 * 9999, key, b"social")
    rest, serial_new = divmod(value, 9999)
    area_new, group_new = divmod(rest, 99)
    return f"{areas[area_new]:03d}-{group_new + 1:02d}-{serial_new + 1:04d}"


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(m: str, key: bytes) -> str | None:
    parts = re.split(r"([-./])", m)
    numbers = parts[0::2]
    month_first = False
    try:
        if len(numbers[0]) == 4:
            day = datetime.date(int(numbers[0]), int(numbers[1]), int(numbers[2]))
        else:
            month_first = int(numbers[1]) > 12
            first, second = int(numbers[0]), int(numbers[1])
            day = datetime.date(int(numbers[2]), first if month_first else second, second if month_first else first)
    except ValueError:
        return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    new = datetime.date.fromordinal(_FIRST + permute(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, b"date"))
    if len(numbers[0]) == 4:
        return f"{new.year:04d}{parts[1]}{new.month:02d}{parts[3]}{new.day:02d}"
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:02d}{parts[1]}{second:02d}{parts[3]}{new.year:04d}"


def _iban(m: str, key: bytes) -> str | None:
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None

    def check(country: str, body: str) -> str:
        return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"

    country, body = plain[:2], plain[4:]
    if check(country, body) != plain[2:4]:
        return None
    new = _permute_classes(body, key, b"iban" + country.encode())
    out = iter(country + check(country, new) + new)
    return "".join(c if c == " " else next(out) for c in m)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permute_classes(text: str, key: bytes, tweak: bytes) -> str:
    """Permute the ASCII letters and digits of ``text`` together, each within its class."""
    kinds = [next((k for k in _CLASSES if c in k), "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join("0aA"[_CLASSES.index(k)] if k else c for c, k in zip(text, kinds, strict=True))
    value = permute(value, size, key, tweak + shape.encode())
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            value, at = divmod(value, len(k))
            c = k[at]
        out.append(c)
    return "".join(reversed(out))


def _email(m: str, key: bytes) -> str | None:
    """Case doesn't tell addresses apart: the lower-cased local part is permuted, and capitals
    stand where they stood."""
    local, domain = m.rsplit("@", 1)
    if not re.search(r"[A-Za-z0-9]", local):
        return None
    new = _permute_classes(local.lower(), key, b"email@" + domain.lower().encode())
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + "@" + domain


#: Kinds in order of precedence at one place, with their pattern and pseudonym.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _social),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])", _phone),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", _card),
)


def compile_kinds() -> list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]]:
    return [(name, re.compile(pattern), new) for name, pattern, new in KINDS]


#: Kinds whose patterns can take in what follows a value, and what may not follow one.
_ENDS = {"iban": re.compile(r"(?![A-Za-z0-9])"), "card": re.compile(r"(?![0-9A-Za-z])")}


def _findings(text: str, name: str, pattern: re.Pattern, valid: Callable[[str], str | None]) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the longest valid value at each place. Where the longest
    match fails, its shorter ends at group borders are tried; the search resumes right after
    an accepted value, and one character on from where none is."""
    m = pattern.search(text)
    while m:
        end, new = m.end(), valid(m.group())
        if new is None and name in _ENDS:
            border = _ENDS[name]
            for end in range(m.end() - 1, m.start(), -1):
                if not border.match(text, end):
                    continue
                shorter = pattern.match(text, m.start(), end)
                if shorter is None or shorter.end() != end:
                    continue
                new = valid(shorter.group())
                if new is not None:
                    break
        if new is not None:
            yield m.start(), end, new
        m = pattern.search(text, m.start() + 1 if new is None else end)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS = "._%+-"


def _addresses(text: str, pattern: re.Pattern, valid: Callable[[str], str | None]) -> Iterator[tuple[int, int, str]]:
    """The same for e-mail addresses, from each ``@`` outwards: local parts hold none, so no
    character is looked at for more than one."""
    stop = 0
    at = text.find("@")
    while at >= 0:
        m = pattern.match(text, at)
        start = at
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and text[start] in _SIGNS:
            start += 1
        new = valid(text[start : m.end()]) if m and start < at else None
        if new is not None:
            yield start, m.end(), new
        stop = m.end() if new is not None else at + 1
        at = text.find("@", stop)


_SEED = re.compile(r"[0-9@]")


def pseudonymize(text: str, key: bytes, kinds: list, cache: dict) -> tuple[str, dict[str, int]]:
    """The text with validated findings replaced, and how many of each kind."""
    found: dict[str, int] = {}
    if not _SEED.search(text):
        return text, found
    spans: list[tuple[int, int, int, str]] = []
    for rank, (name, pattern, new) in enumerate(kinds):

        def valid(value: str, name: str = name, new: Callable[[str, bytes], str | None] = new) -> str | None:
            if (name, value) not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[name, value] = new(value, key)
            return cache[name, value]

        seen = _addresses(text, pattern, valid) if name == "email" else _findings(text, name, pattern, valid)
        spans += [(rank, a, b, made) for a, b, made in seen]
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text)) if spans else b""
    for rank, a, b, new in sorted(spans):
        if not any(used[a:b]):
            used[a:b] = b"\1" * (b - a)
            taken.append((a, b, new))
            name = kinds[rank][0]
            found[name] = found.get(name, 0) + 1
    parts, at = [], 0
    for a, b, new in sorted(taken):
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), found


def pseudonymized(docs: DataFrame, key: bytes, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (default id_col), text with pseudonyms, n_pii and a map of counts
    by kind.

    Cards pass the Luhn check, IBANs the mod-97 check, dates exist between 1900 and 2099,
    address bytes are below 256 and social numbers are assignable; what fails stays as it
    is; of a card or IBAN that something follows, the longest part that passes is taken. A date
    whose second number can't be a month is read month first. Pseudonyms pass the same checks.
    E-mail addresses keep their domain and the places of their capitals, and link whatever
    their case. Kinds take precedence as in KINDS, then the earlier value. One key gives one
    value one pseudonym in all documents.

    A null text stays null with no findings, an empty one empty. Very long texts are read
    whole, in time linear in their length. Repeated rows change alike; null ids stay null. An
    empty table gives no rows. Other columns are ignored, so their names can't clash.
    """
    keep = [id_col] if keep is None else keep
    names = [name for name, _, _ in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, cache = compile_kinds(), {}
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts, counts = [], []
                for text in part.column(len(keep)).to_pylist():
                    new, found = (None, {}) if text is None else pseudonymize(text, key, kinds, cache)
                    texts.append(new)
                    counts.append([(k, found[k]) for k in names if k in found])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([sum(n for _, n in c) for c in counts], pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))],
                    names=[*(f"k{j}" for j in range(len(keep))), "text", "n_pii", "kinds"],
                )

    own = docs.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    out = own.mapInArrow(run, f"{fields}, text string, n_pii long, kinds map<string,long>")
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "text", "n_pii", "kinds")
